"""Removal of repeated passages by a sparse, hash-compared suffix sort.

A byte goes if a string of 400 bytes that covers it also starts anywhere else in the corpus. Not every suffix
needs sorting to find those strings: every window of that length chooses one of its substrings of `gram` bytes
by the least prefix-polynomial hash (leftmost on a tie), so equal windows choose the same substring at the same
place in them. The chosen positions (about one in 137) are anchors. Anchors whose substrings are unique are done
with. For the others the context, all that windows over the anchor can reach, decides: contexts that occur twice
are repeated as a whole. What is left, contexts that differ from each other but share their anchor, is sorted as
suffixes.

For that sort prefix hashes of polynomials modulo 2^64 compare two suffixes in logarithmic time: a binary
search finds the length of the common extension, the next byte decides. Suffixes start `lo` bytes before the
anchor, for a range [lo, hi] of offsets, and are compared over the bytes that all windows with these offsets
have in common. Suffixes without an equal neighbour are done with; those whose whole range of windows has an
equal neighbour are repeated, after their bytes have been compared (collision verification); the rest is
halved. Where an anchor has two contexts, two such searches, to its right and to its left, find all they share.
Groups of more than GROUP contexts at one anchor are split the same way by Spark aggregations, with 128-bit
digests as keys and the least and greatest bytes of a key compared, until they are small or decided, so that no
anchor is ever one task's work. Only contexts that are equal as a whole aren't compared by their bytes: their
192 bits of hashes of two kinds (64 of the polynomial, 128 of xxh3) stand for them.

The same is done to the texts as sequences of words (each a symbol of 32 bits of its hash), with windows of
more than WORDS_LEAST words: passages that another document has too, however few bytes their words have.

Defined results: a null text is empty; a null doc_id stays null; repeated rows are separate documents, so
each counts as a repetition of the other; texts below 400 bytes can only lose nothing; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Bloom, bounded_batches, give_back, join_counted, map_batches, staged, text_bytes, word_hashes

LENGTH, WORDS_LEAST = 400, 50


@dataclass(frozen=True)
class Windows:
    """Windows of `length` symbols that each choose a substring of `gram` symbols; across: in different documents only."""

    length: int
    gram: int
    dtype: str
    across: bool

    @property
    def reach(self) -> int:
        """The farthest an anchor is from its window's start."""
        return self.length - self.gram

    def symbols(self, data: bytes) -> np.ndarray:
        if self.dtype == "u1":
            return np.frombuffer(data, np.uint8)
        return word_hashes(data.split()).astype(self.dtype)


#: By number: windows of bytes, windows of words.
KINDS = (Windows(LENGTH, 128, "u1", False), Windows(WORDS_LEAST + 1, 16, "<u4", True))
#: Symbols hashed at once, contexts sorted at once, and contexts of one anchor that one task may get.
BLOCK, BATCH, GROUP = 1 << 18, 5_000, 5_000

_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the 0..n and its inverse modulo 2^64 to the 0..n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, BLOCK + 4 * LENGTH) + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Prefix:
    """Polynomial hashes of any substring of some symbols, from the hashes of its prefixes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self._mixed((self.sums[start + length] - self.sums[start]) * self.down[start])

    def hashes(self, first: int, last: int, length: int) -> np.ndarray:
        """The same of all substrings of a length that start in [first, last)."""
        return self._mixed((self.sums[first + length : last + length] - self.sums[first:last]) * self.down[first:last])

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, at most `most`: all of it, or by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        whole = (self.sums[a + high] - self.sums[a]) * self.down[a] == (self.sums[b + high] - self.sums[b]) * self.down[b]
        low[whole] = high[whole]
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k] + 1) >> 1
            same = (self.sums[a[k] + middle] - self.sums[a[k]]) * self.down[a[k]] == (self.sums[b[k] + middle] - self.sums[b[k]]) * self.down[b[k]]
            low[k[same]] = middle[same]
            high[k[~same]] = middle[~same] - 1
        return low

    def common_before(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for what ends before a and b."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k] + 1) >> 1
            i, j = a[k] - middle, b[k] - middle
            same = (self.sums[a[k]] - self.sums[i]) * self.down[i] == (self.sums[b[k]] - self.sums[j]) * self.down[j]
            low[k[same]] = middle[same]
            high[k[~same]] = middle[~same] - 1
        return low

    def less(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        at = self.common(a, b, most)
        k = np.minimum(at, most - 1)
        return (at < most) & (self.data[a + k] < self.data[b + k])


def suffix_order(text: Prefix, start: np.ndarray, depth: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes at `start` by group and then by their first `depth` bytes (the same within a group).

    A bottom-up mergesort of all groups at once: in every round neighbouring runs are merged by finding each
    suffix's rank in the other run with a binary search over hash comparisons.
    """
    order = np.argsort(group, kind="stable")
    _, first, size = np.unique(group[order], return_index=True, return_counts=True)
    begin, end = np.repeat(first, size), np.repeat(first + size, size)  # of the group at each place
    width, longest = 1, int(size.max(initial=0))
    place = np.arange(len(order))
    while width < longest:
        left_start = begin + (place - begin) // (2 * width) * (2 * width)
        split, stop = np.minimum(left_start + width, end), np.minimum(left_start + 2 * width, end)
        is_left = place < split
        low = np.where(is_left, split, left_start)
        high = np.where(is_left, stop, split)
        base = low.copy()
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k]) >> 1
            own, other = order[place[k]], order[middle]
            # ties go to the left run: a right suffix comes after all equal left ones
            lefts = is_left[k]
            x, y = np.where(lefts, other, own), np.where(lefts, own, other)
            less = text.less(start[x], start[y], depth[x])
            goes_on = np.where(lefts, less, ~less)
            low[k[goes_on]] = middle[goes_on] + 1
            high[k[~goes_on]] = middle[~goes_on]
        rank = low - base
        target = np.where(is_left, place, left_start + (place - split)) + rank
        merged = np.empty_like(order)
        merged[target] = order
        order, width = merged, 2 * width
    return order


def equal_classes(text: Prefix, start: np.ndarray, depth: np.ndarray, group: np.ndarray, verify: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the number of its class (equal group and equal first `depth` symbols) and the class's size.

    Suffixes whose hash is the only one of its kind in the group are classes of their own; the others are sorted.
    """
    hashes = text.hash(start, depth)
    by_hash = np.lexsort((hashes, group))
    new = np.concatenate([[True], (hashes[by_hash][1:] != hashes[by_hash][:-1]) | (group[by_hash][1:] != group[by_hash][:-1])]) if len(start) else np.empty(0, bool)
    alone = np.zeros(len(start), bool)
    alone[by_hash] = new & np.append(new[1:], True)
    rest = np.flatnonzero(~alone)
    label = np.empty(len(start), np.int64)
    label[rest] = _sorted_classes(text, start[rest], depth[rest], group[rest], verify)
    label[alone] = label[rest].max(initial=-1) + 1 + np.arange(np.count_nonzero(alone))
    return label, np.bincount(label)[label] if len(label) else label


def _sorted_classes(text: Prefix, start: np.ndarray, depth: np.ndarray, group: np.ndarray, verify: bool) -> np.ndarray:
    """For each suffix the number of its class, by sorting and comparing neighbours."""
    order = suffix_order(text, start, depth, group)
    a, b = order[:-1], order[1:]
    same = group[a] == group[b]
    k = np.flatnonzero(same)
    same[k] = text.common(start[a[k]], start[b[k]], depth[a[k]]) >= depth[a[k]]
    if verify:
        for x in np.flatnonzero(same):
            i, j, n = start[a[x]], start[b[x]], depth[a[x]]
            same[x] = text.data[i : i + n].tobytes() == text.data[j : j + n].tobytes()
    label = np.empty(len(order), np.int64)
    label[order] = np.concatenate([[0], np.cumsum(~same)]) if len(order) else []
    return label


def anchors(data: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of one text, polynomial hashes of their grams and, of another kind, so that no text
    collides in both, 128-bit digests of their contexts."""
    n, found = len(data), []
    windows = n - w.length + 1
    span = w.reach + 1  # grams in a window
    for at in range(0, windows, BLOCK):
        stop = min(at + BLOCK, windows)  # windows that start in [at, stop)
        low, high = max(0, at - w.length), min(n, stop + 2 * w.length)
        text = Prefix(data[low:high])
        grams = text.hashes(at - low, stop + w.reach - low, w.gram)
        index = np.arange(len(grams), dtype=np.uint64)
        value = (grams & ~np.uint64(0xFFFFF)) | index
        padded = np.full(-(-len(value) // span) * span, np.uint64(2**64 - 1))
        padded[: len(value)] = value
        rows = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: stop - at], ahead[span - 1 : span - 1 + stop - at])
        chosen = np.unique((least & np.uint64(0xFFFFF)).astype(np.int64))
        p = chosen + at
        left, right = np.minimum(p, w.reach), np.minimum(n - p, w.length)
        raw, size = data[low:high].tobytes(), data.itemsize
        i, j = size * (p - left - low), size * (p + right - low)
        digests = b"".join(xxh3_128_digest(raw[x:y], k) for x, y, k in zip(i.tolist(), j.tolist(), left.tolist()))
        found.append((p, grams[chosen], np.frombuffer(digests, "<i8").reshape(-1, 2)))
    p, gram, context = (np.concatenate(x) for x in zip(*found))
    p, first = np.unique(p, return_index=True)
    return p, gram[first], context[first]


_ANCHORS = "kind int, h1 long, h2 long, size long, pos long, gram long, c1 long, c2 long, weight long, docs long"
_MARKS = "kind int, h1 long, h2 long, a long, b long"


def _anchor_rows(batch: pa.RecordBatch) -> dict:
    """Anchors by text and kind. Of anchors with one context only one row is kept for a text, with their number as
    weight (1 for words); docs is 1 in one of the rows of a gram. Of bytes, reaches that are repeated within
    their text come as rows of their own with weight 0, and in `gram` and `c1` the reach."""
    parts: list[list] = [[] for _ in _ANCHORS.split(", ")]
    for h1, h2, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        text = text_bytes(raw.as_py())
        for kind, w in enumerate(KINDS):
            data = w.symbols(text)
            if len(data) < w.length:
                continue
            p, gram, context = anchors(data, w)
            _, first, inverse, count = np.unique(context[:, 0], return_index=True, return_inverse=True, return_counts=True)
            one = np.zeros(len(first), np.int64)
            one[np.unique(gram[first], return_index=True)[1]] = 1
            rows = [p[first], gram[first].view(np.int64), context[first, 0], context[first, 1], np.ones_like(count) if w.across else count, one]
            again = np.flatnonzero(count[inverse] > 1)
            if len(again) and not w.across:
                a, b = merged(np.maximum(p[again] - w.reach, 0), np.minimum(p[again] + w.length, len(data)))
                none = np.zeros_like(a)
                rows = [np.concatenate(x) for x in zip(rows, [a, a, b, none, none, none])]
            many = len(rows[0])
            for out, x in zip(parts, (np.full(many, kind, np.int32), np.full(many, h1), np.full(many, h2), np.full(many, len(data)), *rows)):
                out.append(x)
    names = [c.split()[0] for c in _ANCHORS.split(", ")]
    return {c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in zip(names, parts)}


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the intervals [a, b) as disjoint ones that don't touch, in order."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    last = np.concatenate([new[1:], [True]])
    return a[new], b[last]


class Contexts:
    """Contexts of some whole groups of one kind: their symbols one after the other, and where the anchors are in them."""

    def __init__(self, table: pa.Table, w: Windows):
        bodies = table.column("body").to_pylist()
        self.w, self.text = w, Prefix(np.frombuffer(b"".join(bodies), w.dtype))
        size = np.array([len(x) for x in bodies], np.int64) // np.dtype(w.dtype).itemsize
        self.weight, self.left, self.pos, self.h1, self.h2 = (table.column(c).to_numpy() for c in ("weight", "l", "pos", "h1", "h2"))
        self.right = size - self.left
        self.anchor = np.cumsum(size) - size + self.left
        self.found: list[tuple] = []  # contexts, begin and end of what is repeated

    def same_bytes(self, i: int, j: int, n: int) -> bool:
        return self.text.data[i : i + n].tobytes() == self.text.data[j : j + n].tobytes()

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """What context i of an anchor shares with the only other one, j, if that is as long as a window."""
        w, text = self.w, self.text
        if w.across:  # of one text they tell nothing, unless one of them is in several
            other = (self.h1[i] != self.h1[j]) | (self.h2[i] != self.h2[j]) | (self.weight[i] + self.weight[j] > 2)
            i, j = i[other], j[other]
        before = text.common_before(self.anchor[i], self.anchor[j], np.minimum(self.left[i], self.left[j]))
        after = text.common(self.anchor[i], self.anchor[j], np.minimum(self.right[i], self.right[j]))
        k = np.flatnonzero(before + after >= w.length)
        for x in k:
            a, b = self.anchor[i[x]], self.anchor[j[x]]
            if not self.same_bytes(a - before[x], b - before[x], before[x] + after[x]):  # a collision: count the symbols
                left, right = min(self.left[i[x]], self.left[j[x]]), min(self.right[i[x]], self.right[j[x]])
                unequal = text.data[a : a + right] != text.data[b : b + right]
                after[x] = unequal.argmax() if unequal.any() else right
                unequal = (text.data[a - left : a] != text.data[b - left : b])[::-1]
                before[x] = unequal.argmax() if unequal.any() else left
        k = k[before[k] + after[k] >= w.length]
        for item in (i[k], j[k]):
            self.found.append((item, self.pos[item] - before[k], self.pos[item] + after[k]))

    def several(self, label: np.ndarray, many: np.ndarray, item: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which classes are repeated: those of several contexts, or across texts, of several texts."""
        if not self.w.across or not len(item):
            return many > 1
        texts = np.unique(np.stack([label, self.h1[item], self.h2[item]]), axis=1)[0]
        return (many > 1) & ((np.bincount(texts)[label] > 1) | (np.bincount(label, known)[label] > 0))

    def sort(self, item: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Contexts of larger groups, by halving their ranges of offsets. known: in several texts or places anyway."""
        w, text, known = self.w, self.text, self.weight[item] > 1
        while len(item):
            fits = (self.left[item] >= lo) & (self.right[item] >= w.length - hi)
            item, group, lo, hi, known = (x[fits] for x in (item, group, lo, hi, known))
            if not len(item):
                break
            label, many = equal_classes(text, self.anchor[item] - lo, w.length - hi + lo, group, verify=False)
            keep = self.several(label, many, item, known)
            item, lo, hi, group, known = (x[keep] for x in (item, lo, hi, label, known))
            k = np.flatnonzero((self.left[item] >= hi) & (self.right[item] >= w.length - lo))
            if len(k):
                label, many = equal_classes(text, self.anchor[item[k]] - hi[k], w.length - lo[k] + hi[k], group[k], verify=True)
                alike = self.several(label, many, item[k], known[k])
                done = k[alike]
                self.found.append((item[done], self.pos[item[done]] - hi[done], self.pos[item[done]] + w.length - lo[done]))
                # those that are alike go on as one of them, for the others to compare with
                one = done[np.unique(label[alike], return_index=True)[1]]
                known[one] = True
                keep = np.ones(len(item), bool)
                keep[done] = False
                keep[one] = True
                item, lo, hi, group, known = (x[keep] for x in (item, lo, hi, group, known))
            # a group that has shrunk to one has nothing left to compare
            size = np.bincount(group, minlength=1)[group] if len(group) else group
            on = (lo < hi) & (size > 1)
            item, lo, hi, group, known = (x[on] for x in (item, lo, hi, group, known))
            middle = (lo + hi) >> 1
            item, known, group = np.concatenate([item, item]), np.concatenate([known, known]), np.concatenate([2 * group, 2 * group + 1])
            lo, hi = np.concatenate([lo, middle + 1]), np.concatenate([middle, hi])


def _resolve(table: pa.Table, number: np.ndarray) -> pa.RecordBatch | None:
    """Repeated reaches of the contexts of some whole groups, by their numbers."""
    kinds, out = table.column("kind").to_numpy(), []
    for kind, w in enumerate(KINDS):
        rows = np.flatnonzero(kinds == kind)
        if not len(rows):
            continue
        own = table.take(pa.array(rows))
        c, lo, hi = Contexts(own, w), own.column("lo").to_numpy(), own.column("hi").to_numpy()
        _, first, group, size = np.unique(number[rows], return_index=True, return_inverse=True, return_counts=True)
        two = first[size == 2]  # rows of a group lie together
        c.pairs(two, two + 1)
        rest = np.flatnonzero(size[group] > 2)
        c.sort(rest, group[rest], lo[rest], hi[rest])
        if c.found:
            i, a, b = (np.concatenate(x) for x in zip(*c.found))
            once = c.weight[i] == 1  # the others are known to be repeated
            i, a, b = i[once], a[once], b[once]
            out.append((np.full(len(i), kind, np.int32), c.h1[i], c.h2[i], a, b))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=[c.split()[0] for c in _MARKS.split(", ")])


def _resolve_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by g1 and g2; whole groups are sorted some thousand contexts at a time."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        g1, g2 = t.column("g1").to_numpy(), t.column("g2").to_numpy()
        out = _resolve(t, np.cumsum(np.concatenate([[0], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])])))
        held.clear()
        if out is not None:
            yield out

    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) + batch.num_rows >= BATCH:
            # up to the last group that ends in this batch
            g1, g2 = batch.column("g1").to_numpy(), batch.column("g2").to_numpy()
            if held:
                last = held[-1].slice(held[-1].num_rows - 1)
                g1, g2 = np.concatenate([last.column("g1").to_numpy(), g1]), np.concatenate([last.column("g2").to_numpy(), g2])
            ends = np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + (0 if held else 1)
            if len(ends):
                if ends[-1]:
                    held.append(batch.slice(0, ends[-1]))
                yield from flush()
                batch = batch.slice(ends[-1])
        held.append(batch)
    if held:
        yield from flush()
    give_back()


_CONTEXTS = "kind int, g1 long, g2 long, lo long, hi long, weight long, h1 long, h2 long, pos long, l long, body binary"
_HALVES = _CONTEXTS + ", u1 long, u2 long, whole binary"


def _split(batch: pa.RecordBatch) -> dict:
    """Both halves of every row's range that its context reaches, with digests of the core and of the whole."""
    out: dict[str, list] = {c.split()[0]: [] for c in _HALVES.split(", ")}

    def digest(kind: int, lo: int, hi: int, data: bytes) -> np.ndarray:
        return np.frombuffer(hashlib.blake2b(f"{kind} {lo} {hi} ".encode() + data, digest_size=16).digest(), "<i8")

    for row in batch.to_pylist():
        w, middle, left, body = KINDS[row["kind"]], (row["lo"] + row["hi"]) >> 1, row["l"], row["body"]
        size = np.dtype(w.dtype).itemsize
        right = len(body) // size - left
        for lo, hi in ((row["lo"], middle), (middle + 1, row["hi"])):
            if lo > hi or left < lo or right < w.length - hi:
                continue
            core = body[size * (left - lo) : size * (left + w.length - hi)]
            whole = body[size * (left - hi) : size * (left + w.length - lo)] if left >= hi and right >= w.length - lo else None
            row["g1"], row["g2"] = digest(row["kind"], lo, hi, core)
            row["u1"], row["u2"] = (None, None) if whole is None else digest(row["kind"], lo, hi, whole)
            row |= {"lo": lo, "hi": hi, "whole": whole}
            for c in out:
                out[c].append(row[c])
    return out


def _compared(todo: DataFrame, group: int) -> DataFrame:
    """Marks of contexts that share an anchor."""
    marks = None
    plain, key = todo.columns, ["g1", "g2"]

    def also(found: DataFrame) -> None:
        nonlocal marks
        marks = found if marks is None else marks.unionByName(found)

    while True:
        todo = staged(todo, "contexts")
        sizes = staged(todo.groupBy(*key).agg(F.count("*").alias("many")), "sizes")
        some = not sizes.where(F.col("many") > group).isEmpty()
        counted = join_counted(todo, sizes, key) if some else todo
        small = counted.where(F.col("many").between(2, group)).drop("many") if some else todo
        also(small.repartition(*key).sortWithinPartitions(*key).mapInArrow(_resolve_groups, _MARKS))
        if not some:
            return marks
        halves = staged(map_batches(counted.where(F.col("many") > group), _split, _HALVES), "halves")
        # whole ranges that occur twice are repeated; one of them goes on as partner of the others
        whole = halves.where("u1 is not null").groupBy("u1", "u2").agg(
            F.count("*").alias("many"), F.min(F.struct("h1", "h2", "pos")).alias("one"), F.min("whole").alias("least"), F.max("whole").alias("most"), F.max("kind").alias("k"),
            F.max("weight").alias("known"), (F.min("h1") < F.max("h1")).alias("texts"),
        )
        across = "k = " + " OR k = ".join(str(i) for i, w in enumerate(KINDS) if w.across)
        alike = whole.where(f"many > 1 AND least = most AND (NOT ({across}) OR texts OR known > 1)").select("u1", "u2", "many", "one")
        halves = halves.drop("whole").where("u1 is not null or lo < hi")
        alike = staged(alike, "alike")
        asked = join_counted(Bloom(alike.select(F.xxhash64("u1", "u2"))).rows(halves.withColumn("u", F.xxhash64("u1", "u2")), "u").drop("u"), alike, ["u1", "u2"])
        others = halves.where("lo < hi").join(alike.select("u1", "u2"), ["u1", "u2"], "left_anti")
        halves = asked.unionByName(others, allowMissingColumns=True)
        length = F.element_at(F.array(*(F.lit(w.length) for w in KINDS)), F.col("kind") + 1)
        reach = [(F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") + length - F.col("lo")).alias("b")]
        also(halves.where("many > 1 AND weight = 1").select("kind", "h1", "h2", *reach))
        goes_on = F.col("many").isNull() | (F.col("one") == F.struct("h1", "h2", "pos"))
        halves = halves.where(goes_on & (F.col("lo") < F.col("hi"))).withColumn("weight", F.when(F.col("many") > 1, 2).otherwise(F.col("weight")).cast("long"))
        todo = halves.select(*plain)


def _bodies(batch: pa.RecordBatch) -> dict:
    """The contexts of a text that are to be compared."""
    out: dict[str, list] = {c.split()[0]: [] for c in _CONTEXTS.split(", ")}
    for h1, h2, raw, places in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "text", "places"))):
        text = text_bytes(raw)
        symbols = {k: KINDS[k].symbols(text) for k in {p["kind"] for p in places}}
        for p in places:
            w, data = KINDS[p["kind"]], symbols[p["kind"]]
            low, high = max(0, p["pos"] - w.reach), min(len(data), p["pos"] + w.length)
            row = (p["kind"], p["gram"], p["kind"], 0, w.reach, p["weight"], h1, h2, p["pos"], p["pos"] - low, data[low:high].tobytes())
            for c, value in zip(out.values(), row):
                c.append(value)
    return out


def repeated_reaches(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(kind, h1, h2, a, b): by text (two 64-bit hashes) the ranges of bytes or of words that are repeated; they may overlap."""
    keyed = docs.where(F.octet_length("text") > 2 * WORDS_LEAST).select(*_text_key(), "text")
    found = staged(map_batches(keyed, _anchor_rows, _ANCHORS), "anchors")
    own = found.where("weight = 0").select("kind", "h1", "h2", F.col("gram").alias("a"), F.col("c1").alias("b"))
    rows = found.where("weight > 0")
    across = F.col("kind").isin([i for i, w in enumerate(KINDS) if w.across])
    total = F.sum(F.when(across, F.col("docs")).otherwise(F.col("weight")))
    again = staged(rows.groupBy("gram").agg(total.alias("total"), F.count("*").alias("many")).where("total > 1").select("gram", "many"), "again")
    rows = staged(join_counted(Bloom(again.select("gram")).rows(rows.drop("docs"), "gram"), again, ["gram"]).drop("many"), "shared")

    key = ["kind", "gram", "c1", "c2"]
    one = [F.first(c).alias(c) for c in ("h1", "h2", "pos", "size")]  # of one and the same row, as none is null
    contexts = staged(rows.groupBy(*key).agg(F.sum("weight").alias("weight"), F.count("*").alias("many"), *one), "contexts")
    twice = contexts.where("weight > 1").select(*key, "many")
    at = F.col("kind") + 1
    back, length = (F.element_at(F.array(*(F.lit(x) for x in xs)), at) for xs in ([w.reach for w in KINDS], [w.length for w in KINDS]))
    reach = [F.greatest(F.col("pos") - back, F.lit(0)).alias("a"), F.least(F.col("pos") + length, "size").alias("b")]
    equal = join_counted(rows.drop("weight"), twice, key).select("kind", "h1", "h2", *reach)

    several = contexts.groupBy("gram").agg(F.count("*").alias("many"), F.min("weight").alias("least")).where("many > 1 and least = 1").select("gram", "many")
    todo = join_counted(contexts.drop("many"), staged(several, "several"), ["gram"])
    places = F.collect_list(F.struct("kind", "gram", F.least("weight", F.lit(2)).cast("long").alias("weight"), "pos")).alias("places")
    todo = staged(todo.groupBy("h1", "h2").agg(places), "places")  # of one text each
    # one row for each text, so that copies of a text aren't all cut
    texts = Bloom(todo.select("h1")).rows(keyed, "h1").dropDuplicates(["h1", "h2"]).join(todo, ["h1", "h2"])
    return own.unionByName(equal).unionByName(_compared(map_batches(texts, _bodies, _CONTEXTS), group))


def _text_key() -> list:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")]


def _runs(batch: pa.RecordBatch) -> dict:
    """Each text's ranges, those that overlap or touch as one."""
    out = []
    for ranges in batch.column("ranges").to_pylist():
        own: list[dict] = []
        for kind in range(len(KINDS)):
            ab = np.array([(r["a"], r["b"]) for r in ranges if r["kind"] == kind], np.int64)
            if len(ab):
                own += [{"kind": kind, "a": a, "b": b} for a, b in zip(*(x.tolist() for x in merged(ab[:, 0], ab[:, 1])))]
        out.append(own)
    return {"h1": batch.column("h1"), "h2": batch.column("h2"), "runs": out}


_RANGES = "array<struct<kind:int,a:long,b:long>>"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"
_WORD = re.compile(rb"[^\x09-\x0d ]+")


def _everywhere(data: bytes, runs: list[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of one kind, and where else in the same text their windows are: of a context that a text has
    several times only one place is known."""
    w = KINDS[kind]
    symbols = w.symbols(data)
    windows = Prefix(symbols).hashes(0, len(symbols) - w.length + 1, w.length)
    known = np.concatenate([np.arange(r["a"], r["b"] - w.length + 1) for r in runs])
    at = np.flatnonzero(np.isin(windows, windows[known]))
    return merged(at, at + w.length)


def _without(data: bytes, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside the ranges, and how many maximal ranges there are."""
    if not len(a):
        return data, 0
    x, y = merged(a, b)
    return b"".join(data[i:j] for i, j in zip([0, *y], [*x, len(data)])), len(x)


def _cut(batch: pa.RecordBatch, with_kept: bool) -> dict:
    out: dict[str, list] = {c.split()[0]: [] for c in _RESULT.split(", ")[1:]} | {"kept": []}
    for text, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "runs"))):
        data, n, rest = text_bytes(text), 0, None
        a, b = (np.array([r[x] for r in runs or [] if r["kind"] == 0], np.int64) for x in "ab")
        kept, spans = _without(data, a, b)
        some = [r for r in runs or [] if r["kind"] == 1]
        if some:
            first, last = _everywhere(data, some, 1)
            n = len(first)
            if with_kept:
                words = np.array([m.span() for m in _WORD.finditer(data)])
                a, b = np.concatenate([a, words[first, 0]]), np.concatenate([b, words[last - 1, 1]])
        if with_kept and text is not None:
            rest = _without(data, a, b)[0].decode("utf-8", "ignore")
        for c, value in zip(out.values(), (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), n, rest)):
            c.append(value)
    return {"doc_id": batch.column("doc_id")} | out


def without_repeats(docs: DataFrame, *, with_kept: bool = False, carry: list[str] | None = None, group: int = GROUP) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and n_passages: runs of
    more than 50 words, by white space, that another document has too.

    with_kept adds the text without repeated strings and without these passages, and without characters of which
    bytes were cut (null for a null text). carry names further columns of docs to hand through (a string, long or
    double each).
    """
    bounded_batches(docs.sparkSession)
    carry = carry or []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    ranges = repeated_reaches(docs, group).distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct("kind", "a", "b")).alias("ranges"))  # of one text each
    runs = staged(map_batches(ranges, _runs, f"h1 long, h2 long, runs {_RANGES}"), "runs")
    rows, types = docs.select("*", *_text_key()), dict(docs.dtypes)
    schema = ", ".join([*_RESULT.split(", "), *["kept string"] * with_kept, *(f"`{c}` {types[c]}" for c in carry)])

    def cut(batch: pa.RecordBatch) -> dict:
        return _cut(batch, with_kept) | {c: batch.column(c) for c in carry}

    # texts without runs aren't shuffled; those of many copies get theirs by broadcast
    may = Bloom(runs.select("h1"))
    plain = may.asked(rows, "h1").withColumn("runs", F.lit(None).cast(_RANGES))
    plain = map_batches(plain, lambda batch: cut(batch.filter(pa.array(~may.test(batch)))), schema)
    hit = may.rows(rows, "h1")
    copies = hit.groupBy("h1", "h2").agg(F.count("*").alias("many")).join(runs, ["h1", "h2"], "left")
    hit = join_counted(hit, staged(copies, "copies"), ["h1", "h2"], small="coalesce(size(runs), 0) <= 64")
    return plain.unionByName(map_batches(hit.drop("h1", "h2", "many"), cut, schema))
