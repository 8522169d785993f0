"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear (logistic) model over hashed words and word
beginnings, whose further inputs are the probabilities of the categories before it. Those inputs are learnt
from out-of-fold predictions: the labelled rows are dealt into FOLDS by a hash of doc_id, and each row's
probability of an earlier category comes from a model that has not seen its fold, so a later model does not
come to trust an overfitted one. For scoring each category's model is fitted to all labelled rows.

The labels know two flags. The chain goes over three categories made of them: `junk` (quality 0), `toxic`
and `toxic_junk` (both). Models are fitted on the driver to at most TRAIN_ROWS labelled documents, those with
the least hash of doc_id; a model's weights are those of the INPUTS most telling hashed inputs, chosen anew in each
fold among those in at least LEAST_ROWS rows (rarer ones say nothing of other documents). Every document is scored.

Defined results: null and empty texts are scored as texts without words; a null doc_id stays null and is
never learned from; labelled rows with other labels than 0 and 1 are ignored; a category without both kinds
of label has its mean as probability (0.0 without any); repeated rows are repeated in the result; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches
from .quality import first_rows, labelled

CATEGORIES = ("junk", "toxic", "toxic_junk")
BUCKETS, BEGINNINGS = 1 << 22, range(3, 9)
TRAIN_ROWS, FOLDS, INPUTS, LEAST_ROWS = 10_000, 3, 6_000, 3
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.1, 1e-4
#: Words that a worker remembers.
KNOWN = 100_000
_WORD = re.compile(r"[^\W\d_]+|\||[!?]{2,}|[%&$#*]{3,}")


class Features(dict):
    """Word to the buckets of itself and its beginnings; as many words as a worker remembers."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= KNOWN:
            self.clear()
        names = [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if n < len(word))]
        value = np.array([xxhash.xxh32_intdigest(x) % BUCKETS for x in names], np.int32)
        if len(word) <= 64:
            self[word] = value
        return value


_features = Features()


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def buckets(text: str | None) -> np.ndarray:
    found = [_features[w] for w in words(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


class Linear:
    """Logistic regression over chosen buckets (binary) and some probabilities (as log odds)."""

    def __init__(self, rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, seed: int = 5):
        self.constant = float(y.mean()) if len(y) else 0.0
        self.chosen, self.w, self.u, self.bias = np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]), 0.0
        self.fitted = 0 < self.constant < 1
        if not self.fitted:
            return
        n, pos = _counts(rows), _counts([r for r, t in zip(rows, y) if t])
        ratio = np.abs(np.log((pos + 0.5) / (y.sum() + 1)) - np.log((n - pos + 0.5) / ((1 - y).sum() + 1)))
        telling = np.where(n >= LEAST_ROWS, ratio * np.sqrt(n), 0)
        best = np.sort(np.argsort(-telling, kind="stable")[:INPUTS])
        self.chosen = best[telling[best] > 0]
        kept = [self.places(r) for r in rows]
        logits = _logit(earlier)
        rng, count = np.random.default_rng(seed), len(self.chosen)
        self.w, seen_w, seen_u, seen_b = np.zeros(count), np.full(count, 1e-3), np.full(len(self.u), 1e-3), 1e-3
        self.bias = float(np.log(self.constant / (1 - self.constant)))
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                k = order[at : at + BATCH]
                flat = np.concatenate([kept[i] for i in k])
                row = np.repeat(np.arange(len(k)), [len(kept[i]) for i in k])
                raw = self.bias + np.bincount(row, self.w[flat], len(k)) + logits[k] @ self.u
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[k]) / len(k)
                gw = np.bincount(flat, error[row], count) + DECAY * self.w
                gu = logits[k].T @ error + DECAY * self.u
                gb = error.sum()
                seen_w, seen_u, seen_b = seen_w + gw**2, seen_u + gu**2, seen_b + gb**2
                self.w -= RATE * gw / np.sqrt(seen_w)
                self.u -= RATE * gu / np.sqrt(seen_u)
                self.bias -= RATE * gb / np.sqrt(seen_b)

    def places(self, row: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.chosen, row), max(0, len(self.chosen) - 1))
        return at[self.chosen[at] == row] if len(self.chosen) else at[:0]

    def probability(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(rows), self.constant)
        raw = np.array([self.w[self.places(r)].sum() for r in rows]) + self.bias + _logit(earlier) @ self.u
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """Rows that have each bucket, some hundred rows at a time."""
    out = np.zeros(BUCKETS)
    for i in range(0, len(rows), 500):
        out += np.bincount(np.concatenate(rows[i : i + 500]), minlength=BUCKETS)
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Chain:
    def __init__(self, rows: list[np.ndarray], targets: np.ndarray, fold: np.ndarray):
        self.models: list[Linear] = []
        self.thresholds: list[float] = []
        outside = np.zeros((len(rows), 0))
        for c in range(targets.shape[1]):
            y, own = targets[:, c].astype(float), np.zeros(len(rows))
            self.models.append(Linear(rows, outside, y))
            for f in range(FOLDS):
                here, there = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                if len(here):
                    own[here] = Linear([rows[i] for i in there], outside[there], y[there]).probability([rows[i] for i in here], outside[here])
            outside = np.column_stack([outside, own])
            tried = np.arange(0.2, 0.51, 0.05)
            f1 = [2 * (y * (own >= t)).sum() / max(1, y.sum() + (own >= t).sum()) for t in tried]
            self.thresholds.append(float(tried[len(tried) - 1 - int(np.argmax(f1[::-1]))]))

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        earlier = np.zeros((len(rows), 0))
        for model in self.models:
            earlier = np.column_stack([earlier, model.probability(rows, earlier)])
        return earlier


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Chain:
    def features(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column("doc_id"),
            "quality": batch.column("quality"),
            "toxic": batch.column("toxic"),
            "row": [buckets(t).astype("<i4").tobytes() for t in batch.column("text").to_pylist()],
        }

    known = map_batches(labelled(docs, labels, ["quality", "toxic"], most), features, "doc_id long, quality int, toxic int, row binary")
    t = first_rows(known.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))), most, F.xxhash64("doc_id"), "doc_id", F.xxhash64("row"), "quality", "toxic")
    junk, toxic = 1 - t.column("quality").to_numpy(), t.column("toxic").to_numpy()
    rows = [np.frombuffer(r, "<i4") for r in t.column("row").to_pylist()]
    return Chain(rows, np.column_stack([junk, toxic, junk * toxic]), t.column("fold").to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, p_<category> for each of CATEGORIES in the chain's order, and toxic.

    toxic: p_toxic reaches the threshold from 0.2 to 0.5 with the best F1 on the out-of-fold predictions, 0.5 on ties."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chain = spark.sparkContext.broadcast(fitted(docs, labels))  # at most INPUTS weights for each category
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scores(batch: pa.RecordBatch) -> dict:
        p = chain.value.probabilities([buckets(t) for t in batch.column(1).to_pylist()])
        return {"doc_id": batch.column(0), "toxic": p[:, 1] >= chain.value.thresholds[1]} | {f"p_{c}": p[:, i] for i, c in enumerate(CATEGORIES)}

    return map_batches(docs, scores, "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")
