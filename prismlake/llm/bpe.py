"""Byte-level BPE by overlapping chunks.

A text is cut into chunks that overlap. Every chunk is pre-tokenised on its own, from its own first character,
so its first pieces may be wrong. Two neighbours are stitched at the first position of their overlap at which
both have a piece boundary: the pattern never looks behind, so from a common boundary on both go the same way.
Where the overlap has no common boundary (one piece that is longer than it), matching goes on from the last
sure boundary until it meets one of the next chunk. The pieces are then encoded one by one, each by merging its
bytes by rank; that merge is tiktoken's. Decoding concatenates the tokens' raw bytes.

Chunks of texts of over SPREAD characters are rows of their own, pre-tokenised all over the cluster, once for
equal texts however many copies there are; those of other texts are pre-tokenised where their text was read.

Defined results: a null text counts as empty (no tokens, digests of no bytes); a null doc_id stays null;
repeated rows give repeated rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, join_counted, map_batches, staged

#: Characters in a chunk, characters it reaches into the next one, and of those the last ones that are not sure.
CHUNK, OVERLAP, UNSURE = 2_048, 256, 8
#: Characters of a text whose chunks are dealt over the cluster, and chunks in a batch of theirs.
SPREAD, ROWS = 65_536, 1_000
#: Pieces whose ids a worker remembers.
KNOWN = 50_000


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Bpe(dict):
    """Ranks of a vocabulary file (lines of base64 token and rank) and the pattern of its pieces.

    As a dictionary it leads from pieces to their ids, as many as it remembers.
    """

    def __init__(self, ranks: bytes, pattern: str):
        super().__init__()
        if "(?<" in pattern:
            raise ValueError("a pattern that looks behind can't be stitched")
        pairs = (line.split() for line in ranks.splitlines() if line)
        known = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(known.values()) + 1)
        for token, rank in known.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=known, special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        found = packed(self.merge(piece))
        if len(piece) <= 64:
            self[piece] = found
        return found

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """Ids of the pieces as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, pieces))

    def count(self, piece: str) -> int:
        return len(self[piece]) // 4

    def boundaries(self, text: str) -> list[int]:
        """Where the pieces of text begin, and its end."""
        out, at = [0], 0
        for piece in self.pattern.findall(text):
            at += len(piece)
            out.append(at)
        return out

    def stitch(self, text: str, chunks: list[list[int]], size: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Boundaries of the whole text from those of its chunks, each counted from its chunk's start."""
        sure, base = chunks[0], 0  # boundaries that are right, counted from base
        out: list[int] = []
        for k in range(1, len(chunks)):
            start, stop, theirs = k * size, min(len(text), base + size + overlap), chunks[k]
            last = bisect_left(sure, stop - base - UNSURE)
            first = bisect_left(sure, start - base, 0, last)
            both = set(theirs[: bisect_right(theirs, stop - start)])
            meet = next((i for i in range(first, last) if base + sure[i] - start in both), None)
            if meet is not None:
                out += [base + x for x in sure[:meet]]
                at = base + sure[meet]
            else:
                out += [base + x for x in sure[: max(0, last - 1)]]
                at, both = base + sure[max(0, last - 1)], set(theirs)
                while at - start not in both and at < len(text):
                    out.append(at)
                    at = self.pattern.match(text, at).end()
            sure = theirs[bisect_left(theirs, at - start) :] or [at - start]  # else one piece goes on past all of this chunk
            base = start
        return out + [base + x for x in sure]

    def pieces(self, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """Pieces of a text, by chunks where it is longer than one."""
        if len(text) <= size:
            return self.pattern.findall(text)
        cut = [text[i : i + size + overlap] for i in range(0, len(text), size)]
        marks = self.stitch(text, [self.boundaries(c) for c in cut], size, overlap)
        return [text[a:b] for a, b in zip(marks, marks[1:])]

    def encode(self, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        return self.encode_pieces(self.pieces(text, size, overlap))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[int, str], Bpe] = {}


def loaded(ranks: bytes, pattern: str) -> Bpe:
    """The vocabulary, built once in a worker."""
    key = (hash(ranks), pattern)
    if key not in _loaded:
        _loaded[key] = Bpe(ranks, pattern)
    return _loaded[key]


def read_ranks(path: str) -> bytes:
    """A vocabulary file has a fixed size (under 2 MB here); it goes to the workers with the code."""
    with open(path, "rb") as f:
        return f.read()


def digests(bpe: Bpe, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(
    docs: DataFrame, ranks: bytes, pattern: str, *, with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD
) -> DataFrame:
    """Per document the number of tokens and digests of its ids and of what they decode to; with_ids adds the ids."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(ranks)
    results = RESULT.partition(", ")[2] + (", ids binary" if with_ids else "")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def rows(batch: pa.RecordBatch) -> dict:
        bpe = loaded(known.value, pattern)
        n, a, b, ids = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids_of = bpe.encode(text or "", chunk, overlap)
            for out, value in zip((n, a, b), digests(bpe, ids_of)):
                out.append(value)
            if with_ids:
                ids.append(ids_of)
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b, "ids": ids}

    length = F.length("text")
    short = map_batches(docs.where(F.coalesce(length, F.lit(0)) <= spread), rows, f"doc_id long, {results}")

    long = docs.where(length > spread).withColumn("digest", F.sha2("text", 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = range(0, len(text), chunk)
                for i in range(0, len(starts), ROWS):
                    some = starts[i : i + ROWS]
                    yield pa.RecordBatch.from_pydict({"digest": [digest] * len(some), "k": pa.array(range(i, i + len(some)), pa.int64()), "part": [text[x : x + chunk + overlap] for x in some]})

    def pretokenise(batch: pa.RecordBatch) -> dict:
        bpe = loaded(known.value, pattern)
        marks = [np.asarray(bpe.boundaries(p), "<i4").tobytes() for p in batch.column("part").to_pylist()]
        return {c: batch.column(c) for c in ("digest", "k", "part")} | {"marks": marks}

    def join_up(group: pd.DataFrame) -> pd.DataFrame:
        bpe = loaded(known.value, pattern)
        group = group.sort_values("k")
        text = "".join(p[:chunk] for p in group.part)
        marks = bpe.stitch(text, [np.frombuffer(m, "<i4").tolist() for m in group.marks], chunk, overlap)
        ids = bpe.encode_pieces([text[a:b] for a, b in zip(marks, marks[1:])])
        row = [group.digest.iloc[0], *digests(bpe, ids)] + [ids] * with_ids
        give_back()
        return pd.DataFrame([row], columns=["digest", *(c.split()[0] for c in results.split(", "))])

    each = long.groupBy("digest").agg(F.first("text").alias("text"))
    parts = each.mapInArrow(cut, "digest string, k long, part string").repartition("digest", "k")
    done = map_batches(parts, pretokenise, "digest string, k long, part string, marks binary").groupBy("digest").applyInPandas(join_up, f"digest string, {results}")
    done = staged(done.join(long.groupBy("digest").agg(F.count("*").alias("many")), "digest"), "long")
    found = join_counted(long.select("doc_id", "digest"), done, ["digest"], small="octet_length(ids) < 65536" if with_ids else "true")
    return short.unionByName(found.drop("digest", "many"))


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and text of rows with ids as encode_documents(with_ids=True) gives them."""
    spread = encoded.sparkSession.sparkContext.broadcast(ranks)

    def rows(batch: pa.RecordBatch) -> dict:
        bpe = loaded(spread.value, pattern)
        return {"doc_id": batch.column(0), "text": [bpe.decode(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), rows, "doc_id long, text string")
