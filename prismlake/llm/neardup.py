"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A document is the set of its distinct word shingles. Its signature holds SLOTS minimum hashes of 16 bits
each; the distance of two signatures is the number of slots in which they differ. Signatures are split into
CHUNKS runs of WIDTH slots. By the pigeonhole principle two signatures with a distance of at most
CHUNKS * (ERRORS + 1) - 1 = 23 have a chunk with at most ERRORS differences, and the index enumerates all
places where those may be: a key is a chunk without ERRORS of its slots. So every pair within the distance
shares a key. Two sets with a similarity of 0.75 differ in more than ERRORS slots of one chunk with
probability 0.262, in all twelve chunks with 1.0e-7; for higher similarities much less.

Keys only propose; every proposal whose sizes allow a link is decided on the full shingle sets. Equal sets are
first folded into one class, named by the 64-bit hash of one of its rows (id and text), so that texts without an
id, or with the id of another text, take part as well. In each bucket every class is then held against the
bucket's first and last class (linear in the bucket), and confirmed links are contracted to components. What is
left are buckets that hold several components. Those of them that may be linked by their sizes are connected to
families, whose sets are then compared block by block, all of a block at once: blocks hold sets of about one
size, only blocks of neighbouring sizes meet, and not two blocks of one component. Only links that join
components leave a block. So no group of copies is ever expanded into pairs, and no candidate is dropped.

Defined results: a null or wordless text has no shingles and no links; a null doc_id takes part through its
text and has its component, or null (and is kept) where no row with an id is in it; rows that share a doc_id
but not their text are judged by their own texts; repeated rows are repeated in the result; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, bounded_batches, give_back, join_counted, map_batches, staged, text_bytes, word_hashes

SHINGLE = 5
CHUNKS, WIDTH, ERRORS = 12, 4, 1
SLOTS = CHUNKS * WIDTH
#: Followers that go with one copy of their leader, bytes of sets in a block of a family, fewest and most sets in one.
FOLLOWERS, BLOCK_BYTES, MEMBERS = 64, 1 << 20, (16, 1024)
#: Edges up to which one task finds the components (8 MB); more are left to rounds over all of the cluster.
TOGETHER = 500_000

_rng = np.random.default_rng(20_240_501)
_MULTIPLY = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)
_STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text with fewer words has the one of all its words."""
    words = text_bytes(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    size = min(size, len(words))
    many = len(words) - size + 1
    total = np.full(many, size, np.uint64)
    for i in range(size):
        total = mixed(total + h[i : i + many] * _STEP[i])
    return np.unique(total)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS 16-bit minimum hashes for each set; none may be empty."""
    everything = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SLOTS), np.uint16)
    for k in range(SLOTS):
        out[:, k] = mixed(np.minimum.reduceat((everything ^ _FLIP[k]) * _MULTIPLY[k], starts)).astype(np.uint16)
    return out


def keys_of(sig: np.ndarray) -> np.ndarray:
    """The index keys of signatures, one row each; a key also says which slots it has."""
    columns, wide = [], sig.astype(np.int64)
    for c in range(CHUNKS):
        for kept in combinations(range(WIDTH), WIDTH - ERRORS):
            key = np.full(len(sig), len(columns), np.int64)
            for slot in kept:
                key = (key << 16) | wide[:, c * WIDTH + slot]
            columns.append(key)
    return np.stack(columns, axis=1)


def _sketch(batch: pa.RecordBatch) -> dict:
    sets = [shingles(t) for t in batch.column(1).to_pylist()]
    some = [s for s in sets if len(s)]
    sig = iter(signatures(some)) if some else iter(())
    digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    return {
        "doc_id": batch.column(0),
        "row": batch.column(2),
        "n_shingles": [len(s) for s in sets],
        "d1": [int.from_bytes(d[:8], "little", signed=True) for d in digest],
        "d2": [int.from_bytes(d[8:], "little", signed=True) for d in digest],
        "sig": [next(sig).astype("<u2").tobytes() if len(s) else None for s in sets],
    }


def _keys(batch: pa.RecordBatch) -> dict:
    keys = keys_of(np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, SLOTS))
    cid, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), keys.shape[1]) for c in ("cid", "n"))
    return {"cid": cid, "n": n, "key": keys.ravel()}


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, part, role): a leader's text, then its followers'; gives the pairs that are linked."""
    group, leaders = None, []
    for batch in batches:
        found = []
        for a, part, role, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "b", "text"))):
            if (a, part) != group:
                group, leaders = (a, part), []
            own = shingles(text)
            if not role:
                leaders.append(own)
                continue
            for other in leaders:
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both and 100 * both >= percent * (len(own) + len(other) - both):
                    found.append((a, b))
                    break
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})
    give_back()


def row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def texts_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each class, and some others' texts that pass the Bloom filter; repeated rows' texts once."""
    name = classes.columns[0]
    return Bloom(classes).rows(docs.select(F.col("row").alias(name), "text"), name).dropDuplicates([name])


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets are linked.

    The texts of b are dealt over parts of a's followers, so that no leader with many of them is one task's work.
    """
    pairs = staged(pairs.distinct(), "pairs")
    counts = pairs.groupBy("a").agg(F.count("*").alias("many"))
    pairs = join_counted(pairs, counts, ["a"]).withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / FOLLOWERS)).cast("long"))
    leads = pairs.select("a", "part").distinct().select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"))
    rows = staged(leads.unionByName(pairs.select("a", "part", F.lit(1).alias("role"), "b")), "roles")
    rows = rows.join(texts_of(rows.select("b"), docs), "b")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return rows.mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by some integer keys, whole."""
    group, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns])) + 1
        for x, y in zip([0, *cuts], [*cuts, batch.num_rows]):
            if (own := tuple(c[x] for c in columns)) != group:
                if held:
                    yield pa.Table.from_batches(held)
                group, held = own, []
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over the places 0..n-1."""

    def __init__(self, start: np.ndarray):
        """Places of the same start value are together from the first."""
        _, first, inverse = np.unique(start, return_index=True, return_inverse=True)
        self.up = first[inverse]

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self) -> np.ndarray:
        while not np.array_equal(self.up, higher := self.up[self.up]):
            self.up = higher
        return self.up

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of a family, sorted by (family, i, j): a spanning forest of the links between components.

    The intersections of one set with all others of the pair of blocks are counted at once.
    """
    for t in sorted_groups(batches, ["family", "i", "j"]):
        cid, comp, block, i, j = (t.column(c).to_numpy() for c in ("cid", "comp", "block", "i", "j"))
        _, where, many = np.unique(comp, return_inverse=True, return_counts=True)
        if len(many) < 2:
            continue
        sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(size) - size
        mark = np.zeros(flat.max(initial=0) + 1, np.int64)
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        forest, edges = Forest(comp), []
        for x in np.flatnonzero(where != many.argmax()):  # a pair of two components has one side here, or both
            rest = right if block[x] == i[0] else left
            roots = forest.roots()
            rest = rest[(roots[rest] != roots[x]) & (100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x]))]
            if not len(rest):
                continue
            own = flat[starts[x] : starts[x] + size[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], starts)[rest]
            mark[own] = 0
            for y in rest[100 * both >= percent * (size[rest] + size[x] - both)]:
                if forest.join(x, y):
                    edges.append((cid[x], cid[y]))
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], schema=EDGES)
    give_back()


def size_range(n: str, percent: int) -> Column:
    """Number of a range of sizes: linked sets lie in the same or in neighbouring ranges."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100 / percent + 0.01))).cast("long")


def kindred(apart: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between components whose classes share a bucket and may be linked by their sizes; some more, never less.

    apart: key, comp, range. Each (key, range) names its least component; all others of it, and the least one of the next
    range, are connected to that.
    """
    cells = apart.groupBy("key", "range").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("many"))
    cells = staged(cells, "cells")
    inside = join_counted(apart, cells.where("least < most").select("key", "range", "least", "many"), ["key", "range"])
    inside = inside.where("comp <> least").select(F.col("least").alias("a"), F.col("comp").alias("b"))
    up = cells.select("key", (F.col("range") + 1).alias("range"), F.col("least").alias("below"))
    across = cells.join(up, ["key", "range"]).where("least <> below").select(F.least("least", "below").alias("a"), F.greatest("least", "below").alias("b"))
    return inside.unionByName(across).distinct()


def family_links(kin: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between different components of the same family (what the kin edges connect).

    classes: cid, comp, n_shingles. A family's classes of one range of sizes are dealt into blocks: those of a component
    with enough of them into blocks of their own, the others together.
    """
    families = components(kin).toDF("comp", "family")
    grown = classes.join(families, "comp").withColumn("range", size_range("n_shingles", percent))
    grown = staged(grown, "families")
    room = F.least(F.lit(MEMBERS[1]), F.greatest(F.lit(MEMBERS[0]), F.lit(BLOCK_BYTES) / (8 * F.max("n_shingles"))))
    sizes = grown.groupBy("family", "range", "comp").agg(F.count("*").alias("n"), room.alias("room"))
    large = sizes.where("n > room").select("family", "range", "comp", F.ceil(F.col("n") / F.col("room")).alias("own"))
    rest = sizes.where("n <= room").groupBy("family", "range").agg(F.ceil(F.sum("n") / F.min("room")).alias("shared"))
    dealt = grown.join(large, ["family", "range", "comp"], "left").join(rest, ["family", "range"], "left")
    pure = F.when(F.col("own").isNotNull(), F.col("comp"))
    number = F.pmod(F.xxhash64("cid"), F.coalesce("own", "shared"))
    dealt = dealt.select("family", "cid", "comp", "range", pure.alias("pure"), F.xxhash64("range", F.coalesce(pure, F.lit(0)), pure.isNull(), number).alias("block"))
    dealt = staged(dealt, "dealt")
    blocks = dealt.select("family", "range", "block", "pure").distinct()
    other = blocks.toDF("family", "r", "other", "q")
    near = F.explode(F.array(F.col("range"), F.col("range") + 1)).alias("r")
    two = blocks.select("family", "range", "block", "pure", near).join(other, ["family", "r"]).where("(r > range OR block <= other) AND NOT coalesce(pure = q, false)")
    two = two.select("family", F.col("block").alias("i"), F.col("other").alias("j"))
    sides = two.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = dealt.select("family", "cid", "comp", "block").join(sides, ["family", "block"])

    def sets(batch: pa.RecordBatch) -> dict:
        return {"cid": batch.column(0), "shingles": [shingles(x).astype("<u8").tobytes() for x in batch.column(1).to_pylist()]}

    texts = staged(map_batches(texts_of(dealt.select("cid"), docs).select("cid", "text"), sets, "cid long, shingles binary"), "shingles")
    rows = rows.join(texts, "cid").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return rows.mapInArrow(lambda batches: _linked(batches, percent), "a long, b long")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all edges (u, v): roots are hooked onto the least one beside them until none is left to."""
    table = pa.Table.from_batches(list(batches), schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    many = table.num_rows
    nodes, flat = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    u, v = flat[:many], flat[many:]
    up = np.arange(len(nodes))
    while not np.array_equal(up[u], up[v]):
        x, y = up[u], up[v]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, higher := up[up]):
            up = higher
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "comp": pa.array(nodes[up], pa.int64())})
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes that have an edge (a, b); comp is the least node. edges are read several times.

    Up to TOGETHER edges are one task's work. More go by alternating large-star and small-star steps. Each step takes
    minima by node and joins them with the node's edges, a hub's without a shuffle; after every round the edges are
    written to the shared folder. It ends when a round changes nothing, in about log(nodes) rounds.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if edges.count() <= TOGETHER:  # a round is a dozen stages, all of which the driver keeps in mind
        return edges.coalesce(1).mapInArrow(_together, "node long, comp long")

    def largest(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many")).withColumn("m", F.least("u", "m"))
        return join_counted(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    def smallest(e: DataFrame) -> DataFrame:  # u > v in every edge
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))
        return join_counted(e, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = staged(edges.distinct(), "edges")
    was = None
    while (seen := state(now)) != was and seen[0]:
        was = seen
        stars = staged(largest(now).distinct(), "stars")
        now = staged(smallest(stars).distinct(), "edges")
    label = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return label.union(label.select(F.col("comp").alias("node"), "comp").distinct())


def grouped(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per document doc_id, row (hash of id and text), n_shingles, group (null without shingles; the same for what
    is linked, at any remove) and component_id (smallest doc_id of the group, or its own without shingles).

    Two documents are linked when 100 * |both sets| >= percent * |either set|.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", row_hash())
    sets = staged(map_batches(docs, _sketch, "doc_id long, row long, n_shingles long, d1 long, d2 long, sig binary"), "sets")

    same = ["d1", "d2", "n_shingles"]
    some = sets.where("n_shingles > 0").groupBy(*same)
    classes = some.agg(F.min("row").alias("cid"), F.min("doc_id").alias("id"), F.count("*").alias("many"), F.first("sig").alias("sig"))
    classes = staged(classes, "classes")

    keys = map_batches(classes.select("cid", F.col("n_shingles").alias("n"), "sig"), _keys, "cid long, n long, key long")
    shared = keys.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("many")).where("lo < hi")
    sizes = classes.select("cid", "n_shingles")
    shared = shared.join(sizes.toDF("lo", "lo_n"), "lo").join(sizes.toDF("hi", "hi_n"), "hi")  # a class is in few keys
    buckets = staged(join_counted(keys, staged(shared, "shared"), ["key"]), "buckets")

    star = buckets.selectExpr("lo AS a", "lo_n AS x", "cid AS b", "n AS y").union(buckets.selectExpr("cid", "n", "hi", "hi_n"))
    star = star.where(f"a < b AND 100 * least(x, y) >= {percent} * greatest(x, y)").select("a", "b").distinct()
    links = staged(confirmed(star, docs, percent), "links")
    comps = staged(components(links), "components")

    sizes = sizes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    sizes = staged(sizes.select("cid", "comp", "n_shingles"), "sizes")
    apart = buckets.where("many > 3").select("key", "cid", "n").join(sizes.select("cid", "comp"), "cid").select("key", "comp", size_range("n", percent).alias("range"))
    mixed_keys = apart.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("many")).where("least < most")
    apart = staged(join_counted(apart, staged(mixed_keys.select("key", "many"), "mixed"), ["key"]).select("key", "comp", "range"), "apart")
    kin = staged(kindred(apart, percent), "kin")
    if not kin.isEmpty():
        more = staged(family_links(kin, sizes, docs, percent), "links")
        if not more.isEmpty():
            comps = staged(components(links.union(more)), "components")

    smallest = classes.join(comps.withColumnRenamed("node", "cid"), "cid").groupBy("comp").agg(F.min("id").alias("least"))
    named = classes.join(comps.join(smallest, "comp").withColumnRenamed("node", "cid"), "cid", "left")
    named = named.select(*same, "many", F.coalesce("comp", "cid").alias("group"), F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least")).alias("least"))
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    rows = join_counted(sets.select("doc_id", "row", *same), staged(named, "named"), same, "left")
    return rows.select("doc_id", "row", F.col("n_shingles").cast("long").alias("n_shingles"), "group", component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per document doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (it is that one)."""
    result = grouped(docs, percent).select("doc_id", "n_shingles", "component_id")
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
