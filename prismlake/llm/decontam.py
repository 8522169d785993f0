"""Benchmark decontamination by a distributed positional inverted index.

The index is a table with a row for each segment (some hundred training documents): the sorted hashes of the
segment's terms, and for each term the positions of its tokens in the segment, where a document's positions
follow the one before it after a gap of places without a token. A phrase is looked up by intersecting its
terms' lists, each shifted by the term's offset in the phrase, from the rarest term on; most phrases end at
a term that the segment lacks. Proximity matches allow up to `slop` other words in between.

Benchmark phrases come to the segments in blocks of at most PHRASES, one after the other, so what is
broadcast has a fixed bound however large the benchmark is.

Defined results: null texts have no words; a null doc_id stays null; items with a null item_id are ignored;
repeated items are one item, as items_sha256 has each id once, and so are items that share an id; repeated
documents are repeated in the result; empty tables give empty or clean results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, map_batches, staged, text_bytes, word_hashes

WINDOW, PHRASES, SEGMENT = 8, 20_000, 250_000
GAP = 64  # places between two documents

#: Bytes that are no part of a word: \x00-\x2F \x3A-\x60 \x7B-\x7F, after A-Z have been lower-cased.
_SPACES = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text_bytes(text).lower().translate(_SPACES).split()


def phrases_of(text: str | None, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Hashes of the words of each window; a text of fewer words, but not none, is one."""
    h = word_hashes(words(text)).tolist()
    return [tuple(h[i : i + window]) for i in range(max(1, len(h) - window + 1))] if h else []


# ---- index


def _segment(ids: list, hashes: list[np.ndarray]) -> dict:
    starts = np.cumsum([0] + [len(h) + GAP for h in hashes])
    place = np.concatenate([s + np.arange(len(h), dtype=np.int64) for s, h in zip(starts, hashes)]).astype(np.int32)
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    every, place = every[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    # positions as differences within a term's list, which pack better
    steps = np.diff(place, prepend=0).astype("<i4")
    steps[first] = place[first]
    return {"segment": uuid.uuid4().hex, "doc_ids": ids, "lengths": [len(h) for h in hashes], "terms": every[first].astype("<u8").tobytes(), "first": first.astype("<i4").tobytes(), "steps": steps.tobytes()}


_INDEX = "segment string, doc_ids array<long>, lengths array<int>, terms binary, first binary, steps binary"


def build_index(docs: DataFrame, tokens: int = SEGMENT) -> DataFrame:
    """One row for each segment of about `tokens` tokens (at least one document), written to the shared folder."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = word_hashes(words(text))
                if ids and held + len(h) + GAP > tokens:
                    yield pa.RecordBatch.from_pylist([_segment(ids, hashes)], schema=schema)
                    ids, hashes, held = [], [], 0
                ids.append(doc_id)
                hashes.append(h)
                held += len(h) + GAP
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(ids, hashes)], schema=schema)
        give_back()

    return staged(docs.mapInArrow(run, _INDEX), "index")


class Segment:
    """A segment's lists, opened for lookups."""

    def __init__(self, row: dict):
        self.doc_ids, self.lengths = row["doc_ids"], np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(np.concatenate([[0], self.lengths + GAP]))[:-1]
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.first = np.frombuffer(row["first"], "<i4").astype(np.int64)
        self.ends = np.concatenate([self.first[1:], [len(row["steps"]) // 4]])
        self.steps = np.frombuffer(row["steps"], "<i4")
        self.opened: dict[int, np.ndarray] = {}  # at most the segment's tokens

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of terms, -1 for those that the segment lacks."""
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, -1) if len(self.terms) else np.full(len(hashes), -1)

    def places(self, term: int) -> np.ndarray:
        if term not in self.opened:
            self.opened[term] = np.cumsum(self.steps[self.first[term] : self.ends[term]], dtype=np.int64)
        return self.opened[term]

    def exact(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which the terms follow one another."""
        size = self.ends[terms] - self.first[terms]
        found = None
        for k in np.argsort(size, kind="stable"):
            if found is None:
                found = self.places(terms[k]) - k
                continue
            if not len(found):
                break
            other = self.places(terms[k]) - k
            at = np.searchsorted(other, found)
            at[at == len(other)] = 0
            found = found[other[at] == found]
        return found

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the first term from which all others follow in the same document, in order and with at most
        slop words in between."""
        # places less offsets lie in a match within slop of each other: what the rarest terms rule out isn't followed
        order = np.argsort(self.ends[terms] - self.first[terms], kind="stable")
        about = self.places(terms[order[0]]) - order[0]
        for k in order[1:]:
            other = self.places(terms[k])
            at = np.searchsorted(other, about + (k - slop))
            at[at == len(other)] = 0
            about = about[np.abs(other[at] - k - about) <= slop]
            if not len(about):
                return about
        start = self.places(terms[0])
        k = np.searchsorted(about, start)
        k[k == len(about)] = 0
        start = at = start[(about[k] >= start) & (about[k] - start <= slop)]
        for t in terms[1:]:
            other = self.places(t)
            k = np.searchsorted(other, at, side="right")
            ok = k < len(other)
            start, at = start[ok], other[k[ok]]
            inside = at - start <= len(terms) - 1 + slop
            start, at = start[inside], at[inside]
        return start[self.document(start) == self.document(at)]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


# ---- benchmark phrases


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, most: int = PHRASES) -> Iterator[list[tuple[str, tuple]]]:
    """The benchmark's distinct (item_id, phrase), most of them at a time; the driver holds one block."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    block: dict = {}
    for row in rows.toLocalIterator():
        for phrase in phrases_of(row.text, window):
            block[row.item_id, phrase] = None
            if len(block) >= most:
                yield list(block)
                block = {}
    if block:
        yield list(block)


_MATCHES = "segment string, place int, doc_id long, n_words long, hit binary, items array<string>, near array<string>"


def _match(index: DataFrame, block: list[tuple[str, tuple]], slop: int) -> DataFrame:
    """For each document of the index what the block's phrases hit in it: a bit for each word, and item ids."""
    by_size: dict[int, dict[tuple, list[str]]] = {}
    for item, phrase in block:
        by_size.setdefault(len(phrase), {}).setdefault(phrase, []).append(item)
    table = {n: (np.array(list(x), np.uint64), list(x.values())) for n, x in by_size.items()}
    phrases = index.sparkSession.sparkContext.broadcast(table)

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in _MATCHES.split(", ")}
        for row in batch.to_pylist():
            seg = Segment(row)
            total = int(seg.lengths.sum() + GAP * len(seg.lengths))
            hit = np.zeros(total + 1, np.int32)
            items: dict[int, set] = {}
            close: dict[int, set] = {}
            for n, (hashes, owners) in phrases.value.items():
                terms = seg.find(hashes.ravel()).reshape(hashes.shape)
                for k in np.flatnonzero((terms >= 0).all(axis=1)):
                    at = seg.exact(terms[k])
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + n, -1)
                    for d in np.unique(seg.document(at)):
                        items.setdefault(int(d), set()).update(owners[k])
                    if slop:
                        for d in np.unique(seg.document(seg.near(terms[k], slop))):
                            close.setdefault(int(d), set()).update(owners[k])
            bits = np.cumsum(hit) > 0
            for d, (doc_id, start, many) in enumerate(zip(seg.doc_ids, seg.starts, seg.lengths)):
                own = bits[start : start + many]
                values = (row["segment"], d, doc_id, int(many), np.packbits(own).tobytes() if own.any() else None, sorted(items.get(d, ())), sorted(close.get(d, ())))
                for c, v in zip(out.values(), values):
                    c.append(v)
        return out

    return map_batches(index, rows, _MATCHES)


def _finish(batch: pa.RecordBatch, least: int) -> dict:
    n_hit, n_items, digest, close = [], [], [], []
    for hits, items, near in zip(*(batch.column(c).to_pylist() for c in ("hit", "items", "near"))):
        bits = [np.unpackbits(np.frombuffer(h, np.uint8)) for h in hits if h]
        n_hit.append(int(np.bitwise_or.reduce(bits).sum()) if bits else 0)
        found = sorted({x for part in items for x in part})
        n_items.append(len(found))
        digest.append(hashlib.sha256(",".join(found).encode()).hexdigest())
        close.append(len({x for part in near for x in part}))
    return {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": n_hit, "n_items": n_items, "items_sha256": digest, "contaminated": [n >= least for n in n_items], "n_near_items": close}


def contamination(docs: DataFrame, benchmark: DataFrame, *, least: int = 2, window: int = WINDOW, slop: int = 0, most: int = PHRASES) -> DataFrame:
    """Per document doc_id, n_words, n_hit (words in an occurrence of a window), n_items (items with one),
    items_sha256 (of their sorted ids), contaminated (n_items >= least) and n_near_items (proximity matches)."""
    index = build_index(docs)
    found, parts = None, 0
    for block in phrase_blocks(benchmark, window, most):
        one = _match(index, block, slop)
        found, parts = one if found is None else found.unionByName(one), parts + 1
    if found is None:
        found = _match(index, [], slop)
    if parts > 1:
        found = found.groupBy("segment", "place", "doc_id", "n_words").agg(*(F.collect_list(c).alias(c) for c in ("hit", "items", "near")))
    else:
        found = found.select("doc_id", "n_words", *(F.array(c).alias(c) for c in ("hit", "items", "near")))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"
    return map_batches(found, lambda batch: _finish(batch, least), schema)
