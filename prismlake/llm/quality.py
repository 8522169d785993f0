"""Document quality by a factorisation machine.

Inputs are hashed words (each distinct word of a document, the vector scaled to length 1), statistics of the
text's structure, and its length as metadata, each statistic both as a standardised number and as one of
BINS quantile ranges. The machine adds to a linear score the interactions of all pairs of inputs through
factors of rank RANK, in time linear in the inputs: half of (sum of v x)^2 - sum of (v x)^2, by factor.

It is fitted on the driver to at most TRAIN_ROWS labelled documents, those with the least hash of their
doc_id; every document is scored. doc_id, lang, source and the labels are no inputs.

Defined results: null and empty texts get the score of a document without words; a null doc_id is not held
out and never learned from; labelled rows without a label of 0 or 1 are ignored; repeated labels weigh more
(as repeated rows do); without labels of both kinds every score is the labels' mean (0.5 without any);
repeated rows are repeated in the result; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches

BUCKETS, RANK, BINS = 1 << 16, 6, 8
TRAIN_ROWS, STEPS, BATCH, RATE, DECAY = 8_000, 500, 128, 0.1, 1e-4
THRESHOLD, HELD_OUT = 0.7, 2
#: Words that a worker remembers.
KNOWN = 100_000

_MARKS = [re.compile(x) for x in (r"[|]", r"[!?]{2}", r"[%&$#*@^~=+<>\\{}\[\]_]", r"^[^a-zà-ÿ]*[A-ZÀ-Þ]{2}[^a-zà-ÿ]*$", r"\d", r"^[A-ZÀ-Þ]", r"[.,;:]$", r"://|www\.")]
STATS = len(_MARKS) + 9


class Words(dict):
    """Word to its length, its bucket and the marks it bears, packed in one integer; as many as a worker remembers."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        marks = 0 if word.isalpha() and word.islower() else sum(bool(m.search(word)) << i for i, m in enumerate(_MARKS))  # letters bear none
        bare = word.lower().strip(".,;:!?|%&$#*\"'()")
        bucket = xxhash.xxh32_intdigest(bare) % BUCKETS
        value = len(word) << 24 | bucket << 8 | marks
        if len(word) <= 64:
            self[word] = value
        return value


_words = Words()


def inputs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of a text, and its statistics."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n = len(words)
    packed = np.fromiter(map(_words.__getitem__, words), np.int64, n)
    stats = np.zeros(STATS)
    if n:
        for i in range(len(_MARKS)):
            stats[i] = np.count_nonzero(packed & (1 << i)) / n
        sizes = packed >> 24
        sorted_words = np.sort(packed)
        runs = np.diff(np.flatnonzero(np.concatenate([[True], sorted_words[1:] != sorted_words[:-1], [True]])))
        stats[len(_MARKS) :] = (
            sizes.mean(), sizes.std(), len(runs) / n, runs.max() / n, np.count_nonzero(packed[1:] == packed[:-1]) / n,
            len(set(lines)) / len(lines), len(lines) / n, np.log1p(n), np.log1p(len(text)),
        )
    return np.unique(packed >> 8 & 0xFFFF), stats


class Machine:
    """Parameters: edges of the statistics' ranges, their means and deviations, linear weights and factors."""

    def __init__(self, stats: np.ndarray, seed: int = 7):
        self.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        self.mean, self.deviation = stats.mean(axis=0), stats.std(axis=0) + 1e-9
        n = BUCKETS + STATS * (BINS + 1)
        self.bias, self.w = 0.0, np.zeros(n, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (n, RANK)).astype(np.float32)

    def rows(self, buckets: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns and values of all rows' inputs, and where each row begins."""
        z = np.clip((stats - self.mean) / self.deviation, -3, 3)
        first = BUCKETS + np.arange(STATS) * (BINS + 1)
        bins = np.stack([np.searchsorted(self.edges[s], stats[:, s], side="right") for s in range(STATS)], axis=1)
        columns, values, scale = [], [], 1 / np.sqrt(STATS)
        for r, b in enumerate(buckets):
            columns += [b, first, first + 1 + bins[r]]
            values += [np.full(len(b), 1 / np.sqrt(max(1, len(b)))), z[r] * scale, np.full(STATS, scale)]
        starts = np.cumsum([0] + [len(b) + 2 * STATS for b in buckets])[:-1]
        return np.concatenate(columns), np.concatenate(values).astype(np.float32), starts

    def raw(self, columns: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[columns] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[columns] * values, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(buckets, stats))[0].astype(float), -30, 30)))

    def fit(self, buckets: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
        """Adagrad over the logistic loss."""
        rng, n = np.random.default_rng(seed), len(self.w)
        self.bias = float(np.log(labels.mean() / (1 - labels.mean())))
        seen_w, seen_v, seen_b = np.full(n, 1e-3, np.float32), np.full((n, RANK), 1e-3, np.float32), 1e-3
        order = np.concatenate([rng.permutation(len(labels)) for _ in range(-(-STEPS * BATCH // len(labels)))])
        for at in range(0, STEPS * BATCH, BATCH):
            k = order[at : at + BATCH]
            columns, values, starts = self.rows([buckets[i] for i in k], stats[k])
            raw, sums = self.raw(columns, values, starts)
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[k]) / len(k)).astype(np.float32)
            row = np.repeat(np.arange(len(k)), np.diff([*starts, len(columns)]))
            used, slot = np.unique(columns, return_inverse=True)
            g = error[row] * values
            gw = np.bincount(slot, g, len(used)) + DECAY * self.w[used]
            vx = self.v[columns] * values[:, None]
            gv = np.stack([np.bincount(slot, g * (sums[row, f] - vx[:, f]), len(used)) for f in range(RANK)], axis=1) + DECAY * self.v[used]
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            self.w[used] -= RATE * gw / np.sqrt(seen_w[used])
            self.v[used] -= RATE * gv / np.sqrt(seen_v[used])
            gb = float(error.sum())
            seen_b += gb * gb
            self.bias -= RATE * gb / np.sqrt(seen_b)
        return self


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, targets: list[str], most: int) -> DataFrame:
    """doc_id, text and targets of labelled rows that aren't held out: those of the `most` labels with the least hash of
    doc_id. Documents that share an id are all there; who collects rows limits them by first_rows()."""
    known = labels.where(F.col("doc_id").isNotNull() & ~is_held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(t).cast("int").alias(t) for t in targets))
    for t in targets:
        known = known.where(F.col(t).isin(0, 1))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most `most` rows of a few integers


def first_rows(rows: DataFrame, most: int, *key: F.Column | str) -> pa.Table:
    """Of rows of labelled() the first `most` by key, which must not depend on the order in which rows arrive."""
    return rows.orderBy(*key).limit(most).toArrow()


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine | float:
    """The machine, or where one kind of label is missing their mean."""

    def features(batch: pa.RecordBatch) -> dict:
        found = [inputs(t) for t in batch.column("text").to_pylist()]
        return {"label": batch.column("quality"), "buckets": [b.astype("<u2").tobytes() for b, _ in found], "stats": [s.tolist() for _, s in found]}

    got = map_batches(labelled(docs, labels, ["quality"], most), features, "label int, buckets binary, stats array<double>")
    t = first_rows(got, most, F.xxhash64("buckets", "stats"), "label")
    y = t.column("label").to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    buckets = [np.frombuffer(x, "<u2").astype(np.int64) for x in t.column("buckets").to_pylist()]
    stats = np.array(t.column("stats").to_pylist())
    return Machine(stats).fit(buckets, stats, y)


def quality(docs: DataFrame, labels: DataFrame, *, carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document doc_id, held_out, score (0 to 1, higher is better) and predicted (1 if score >= threshold).

    carry names further columns of docs to hand through.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(fitted(docs, labels))  # a fixed number of parameters, 2 MB
    carry = [c for c in carry or [] if c != "doc_id"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
    types = dict(docs.dtypes)

    def scores(batch: pa.RecordBatch) -> dict:
        machine = model.value
        if isinstance(machine, float):
            score = np.full(batch.num_rows, machine)
        elif batch.num_rows:
            buckets, stats = zip(*(inputs(t) for t in batch.column("text").to_pylist()))
            score = machine.score(list(buckets), np.array(stats))
        else:
            score = np.empty(0)
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= threshold).astype(np.int32)} | {c: batch.column(c) for c in carry}

    out = map_batches(docs, scores, ", ".join(["doc_id long, score double, predicted int", *(f"`{c}` {types[c]}" for c in carry)]))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", "predicted", *carry)
