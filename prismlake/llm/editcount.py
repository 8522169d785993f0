"""Token counts of edited documents.

A document's pieces (pre-tokens) hang in a segment tree: leaves hold the lengths and token counts of up to
LEAF pieces, inner nodes the sums below them. An edit finds its place by descending the tree, re-encodes the
pieces it touches plus the few before it that could see it (a piece's match looks at most CONTEXT characters
past its end), goes on until a new boundary meets an old one behind the edit, and updates the sums above the
leaves it changed. The rest of the document is not looked at.

Defined results: a null text is empty; edits are applied in the order of (seq, start, stop, text), each in the text that the
ones before it left; places beyond the text's end mean its end, a stop before the start means the start; a
null replacement is empty; edits with a null doc_id, seq, start or stop are ignored, as are those of
documents that don't exist; repeated edits apply as often as they come; rows that share a doc_id get the
same edits; a null doc_id has none; empty tables give empty ones; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, loaded
from .common import Bloom, bounded_batches, map_batches, staged

LEAF, CONTEXT = 64, 4


class TokenTree:
    """Pieces of one text with their token counts, under sums."""

    def __init__(self, bpe: Bpe, text: str):
        self.bpe, self.text, self.encoded = bpe, text, 0
        pieces = bpe.pattern.findall(text)
        self._plant([len(p) for p in pieces], [bpe.count(p) for p in pieces])

    def _plant(self, sizes: list[int], counts: list[int]) -> None:
        self.leaves = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)] or [([], [])]
        self.base = 1
        while self.base < len(self.leaves):
            self.base *= 2
        self.sums = [(0, 0)] * (2 * self.base)
        for i, (s, c) in enumerate(self.leaves):
            self.sums[self.base + i] = (sum(s), sum(c))
        for i in range(self.base - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + c, b + d)

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, piece and start of the piece that holds character `at` (the last piece at the end)."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if at >= start + self.sums[node][0] and self.sums[node + 1][0]:
                start += self.sums[node][0]
                node += 1
        leaf = node - self.base
        sizes = self.leaves[leaf][0]
        ends, total = [], start
        for s in sizes:
            total += s
            ends.append(total)
        k = min(bisect_right(ends, at), max(0, len(sizes) - 1))
        return leaf, k, ends[k - 1] if k else start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace text[start:stop] by new."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        leaf, k, at = self._find(max(0, start - CONTEXT))
        before, shift = self.text, start + len(new) - stop
        self.text = before[:start] + new + before[stop:]
        # old boundaries from here on, as they lie in the new text; those inside the edit don't count
        last, piece, old = leaf, k, at
        sizes, counts = [], []
        while at < len(self.text):
            while old + shift < at or old < stop:
                if last >= len(self.leaves):
                    break
                if piece >= len(self.leaves[last][0]):
                    last, piece = last + 1, 0
                    continue
                old += self.leaves[last][0][piece]
                piece += 1
            if old >= stop and old + shift == at:
                break
            end = self.bpe.pattern.match(self.text, at).end()
            sizes.append(end - at)
            counts.append(self.bpe.count(self.text[at:end]))
            self.encoded += end - at
            at = end
        else:
            last, piece = len(self.leaves), 0
        head = self.leaves[leaf]
        if last >= len(self.leaves):
            tail, last = ([], []), len(self.leaves) - 1
        else:
            tail = (self.leaves[last][0][piece:], self.leaves[last][1][piece:])
        self.leaves[leaf] = (head[0][:k] + sizes + (tail[0] if last == leaf else []), head[1][:k] + counts + (tail[1] if last == leaf else []))
        for i in range(leaf + 1, last):
            self.leaves[i] = ([], [])
        if last > leaf:
            self.leaves[last] = tail
        if len(self.leaves[leaf][0]) > 4 * LEAF:
            flat = [[x for s in self.leaves for x in s[j]] for j in (0, 1)]
            self._plant(*flat)
            return
        nodes = set()
        for i in range(leaf, last + 1):
            self.sums[self.base + i] = (sum(self.leaves[i][0]), sum(self.leaves[i][1]))
            nodes.add((self.base + i) // 2)
        while nodes and 0 not in nodes:
            for i in nodes:
                self._add(i)
            nodes = {i // 2 for i in nodes}


_RESULT = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_encoded long"


def edited_counts(docs: DataFrame, edits: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Per document doc_id, n_tokens, n_edits, n_tokens_edited and n_chars_encoded (characters encoded for the edits).

    edits: doc_id, seq, start, stop (characters), text.
    """
    bounded_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file, under 2 MB
    ok = edits.where("doc_id is not null and seq is not null and start is not null and stop is not null")
    of_doc = ok.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("seq", "start", "stop")), F.coalesce("text", F.lit("")).alias("text")))).alias("edits")
    )
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of_doc = staged(of_doc, "edits")
    may = Bloom(of_doc.select("doc_id"))  # documents without edits needn't be shuffled
    edited = may.rows(docs, "doc_id").join(of_doc, "doc_id", "left")
    plain = may.rows(docs, "doc_id", hit=False).withColumn("edits", F.lit(None).cast(of_doc.schema["edits"].dataType))

    def count(batch: pa.RecordBatch) -> dict:
        bpe = loaded(spread.value, pattern)
        out: list[list] = [[], [], [], []]
        for text, todo in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
            if not todo:
                n = len(bpe.encode(text or "")) // 4
                values = (n, 0, n, 0)
            else:
                tree = TokenTree(bpe, text or "")
                n = tree.tokens
                for e in todo:
                    tree.edit(e["start"], e["stop"], e["text"])
                values = (n, len(todo), tree.tokens, tree.encoded)
            for column, v in zip(out, values):
                column.append(v)
        return {"doc_id": batch.column("doc_id")} | dict(zip(("n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"), out))

    return map_batches(edited, count, _RESULT).unionByName(map_batches(plain, count, _RESULT))


#: What a redaction replaces: mail addresses, web addresses, network addresses, and long numbers. An address's name
#: begins where its run of characters does and is taken whole, so that a long word is read once.
PRIVATE = re.compile(r"(?P<MAIL>(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++)|(?P<URL>https?://\S+)|(?P<IP>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<NUMBER>\+?\d[\d ()-]{6,}\d)")


def redactions(docs: DataFrame) -> DataFrame:
    """Edits that replace personal data by names of their kinds, from the last to the first of a document."""
    bounded_batches(docs.sparkSession)

    def find(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "seq": [], "start": [], "stop": [], "text": []}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = [m for m in PRIVATE.finditer(text or "")] if doc_id is not None else []
            for i, m in enumerate(reversed(found)):
                for c, v in zip(out.values(), (doc_id, i, m.start(), m.end(), f"<{m.lastgroup}>")):
                    c.append(v)
        return out

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, find, "doc_id long, seq long, start long, stop long, text string")
