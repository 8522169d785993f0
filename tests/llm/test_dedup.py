import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from prismlake.llm import common, neardup, suffixdedup


def sentence(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, words, share):
    out = words.split()
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    return sets, [min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("members,followers,hot", [(neardup.MEMBERS, neardup.FOLLOWERS, common.HOT), ((2, 3), 2, 3)])
def test_near_duplicates(documents, monkeypatch, members, followers, hot):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "FOLLOWERS", followers)
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(5)
    texts = [sentence(rng, rng.randint(1, 90)) for _ in range(40)]
    for share in (0.01, 0.02, 0.03, 0.04, 0.05):
        base = sentence(rng, 200)
        texts += [base] + [edited(rng, base, share) for _ in range(12)]
    texts += ["A b C", "a B c", "a b", "", "   ", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(9999, None), (None, texts[0] + " "), (None, sentence(rng, 50))]
    sets, comps = brute_components(rows)
    got = neardup.near_duplicates(documents(rows)).collect()
    want = [(i, len(s), (c if s else i), i == (c if s else i)) for (i, _), s, c in zip(rows, sets, comps)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_near_duplicates_repeated_rows_and_empty(documents):
    rows = [(2, "one two three four five six"), (2, "one two three four five six"), (1, "ONE two three four five six")]
    got = [tuple(r) for r in neardup.near_duplicates(documents(rows)).orderBy("doc_id").collect()]
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]
    assert neardup.near_duplicates(documents([])).count() == 0


def test_near_copies_without_id(documents):
    """Texts without an id link and bridge; of texts that share an id each is judged by itself."""
    rng = random.Random(8)
    words = sentence(rng, 350).split()
    moved = [" ".join(words[k : k + 300]) for k in (0, 25, 50)]  # only neighbours are linked
    alone, other = sentence(rng, 60), sentence(rng, 60)
    rows = [(8, moved[0]), (None, moved[1]), (None, moved[1]), (9, moved[2]), (None, alone), (None, alone + " z"), (20, alone[::-1]), (20, other), (7, other + " z")]
    sets, comps = brute_components(rows)
    assert comps == [8, 8, 8, 8, None, None, 20, 7, 7]
    got = neardup.near_duplicates(documents(rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, len(s), c, i == c)) for (i, _), s, c in zip(rows, sets, comps))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, x) for x in range(501, 540)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_components_in_few_jobs(spark, tmp_path, monkeypatch):
    """Chains, hubs and loops are one short run, with the result of the rounds that more edges take."""
    rng = random.Random(2)
    names = rng.sample(range(-(10**12), 10**12), 1000)
    edges = list(zip(names[:300], names[1:301])) + [(names[400], x) for x in names[401:600]] + [(x, x) for x in names[900:]]
    edges += [(rng.choice(names[600:800]), rng.choice(names[600:800])) for _ in range(150)] + [(b, a) for a, b in edges[:50]]
    rng.shuffle(edges)
    spark.createDataFrame(edges, "a long, b long").repartition(8).write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    context = spark.sparkContext
    context.setJobGroup("components", "")
    got = sorted(map(tuple, neardup.components(edges).collect()))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("components")) <= 4
    monkeypatch.setattr(neardup, "TOGETHER", 0)
    assert got == sorted(map(tuple, neardup.components(edges).collect()))
    assert neardup.components(edges.limit(0)).count() == 0


def test_pigeonhole():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**16, (300, neardup.SLOTS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.permutation(neardup.SLOTS)[: neardup.CHUNKS * (neardup.ERRORS + 1) - 1]] ^= 1
    assert all(set(x) & set(y) for x, y in zip(neardup.keys_of(a).tolist(), neardup.keys_of(b).tolist()))


def test_slots_are_independent():
    """At a similarity of 0.75 as many chunks of a signature are good for a key as independent slots would give."""
    rng = np.random.default_rng(6)
    sets = [x for _ in range(6000) for both in [rng.integers(0, 2**63, 60).astype(np.uint64)] for x in (np.append(both, rng.integers(0, 2**63, 10).astype(np.uint64)), np.append(both, rng.integers(0, 2**63, 10).astype(np.uint64)))]
    sig = neardup.signatures([np.sort(x) for x in sets])
    differ = (sig[::2] != sig[1::2]).reshape(-1, neardup.CHUNKS, neardup.WIDTH).sum(axis=2)
    good = (differ <= neardup.ERRORS).sum(axis=1)
    p = 0.75**4 + 4 * 0.75**3 * 0.25
    assert abs(good.mean() / neardup.CHUNKS - p) < 0.01
    assert abs(good.var() / (neardup.CHUNKS * p * (1 - p)) - 1) < 0.1


def brute_passages(texts):
    n = suffixdedup.WORDS_LEAST + 1
    words = [t.split() for t in texts]
    seen = {}
    for k, w in enumerate(words):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(k)
    for w in words:
        covered = np.zeros(len(w) + 2, int)
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i : i + n])]) > 1:
                covered[i + 1] += 1
                covered[i + n + 1] -= 1
        yield int((np.diff((np.cumsum(covered) > 0).astype(int)) == 1).sum())


def brute_cut(texts):
    n = suffixdedup.LENGTH
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                covered[i] += 1
                covered[i + n] -= 1
        gone = np.cumsum(covered)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        yield len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("group,hot", [(suffixdedup.GROUP, common.HOT), (5, 4)])
def test_repeats(documents, monkeypatch, group, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(7)
    passages = [sentence(rng, n, 800) for n in (20, 51, 60, 75, 85, 100, 300)]
    near = sentence(rng, 400, 800)
    texts = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(0, 60), 800)]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), sentence(rng, rng.randint(0, 30), 800)]
        texts.append(" ".join(parts))
    texts += [edited(rng, near, 0.01) for _ in range(15)] + ["ab" * 900, "é" * 500, "x" * 399, "x" * 400, "short", "", texts[0], passages[6]]
    texts += [passages[5][:-1] + "?" + sentence(rng, 5), "?" + passages[5][1:], passages[4][:399], passages[4][:400]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, texts[3])]
    data = [(t or "").encode() for _, t in rows]
    want = [(i, *x, n) for (i, _), x, n in zip(rows, brute_cut(data), brute_passages(data))]
    assert sum(n > 0 and x[1] == 0 for (*_, n), x in zip(want, brute_cut(data))) > 0  # passages of few bytes
    got = suffixdedup.without_repeats(documents(rows), group=group).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_kept_text(documents):
    rng = random.Random(8)
    shared = "ü" * 250
    rows = [(1, "a" + shared + "1 " + sentence(rng, 20)), (2, "b" + shared + "2 " + sentence(rng, 20)), (3, None)]
    got = {r.doc_id: r for r in suffixdedup.without_repeats(documents(rows), with_kept=True, carry=["lang"]).collect()}
    assert got[1].kept == rows[0][1].replace(shared, "") and got[1].lang == "en" and got[3].kept is None
    words = " ".join(random.Random(9).choices("abcdefghij", k=51))  # 101 bytes
    rows = [(1, "x " + words + " y"), (2, words + "\nz"), (3, words.replace(" ", "  ", 1)), (4, words[2:])]
    got = {r.doc_id: (r.kept, r.n_removed, r.n_passages) for r in suffixdedup.without_repeats(documents(rows), with_kept=True).collect()}
    assert got == {1: ("x  y", 0, 1), 2: ("\nz", 0, 1), 3: ("", 0, 1), 4: (words[2:], 0, 0)}
    assert suffixdedup.without_repeats(documents([])).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    text = suffixdedup.Prefix(data)
    start, group = rng.integers(0, 2900, 500), rng.integers(0, 7, 500)
    order = suffixdedup.suffix_order(text, start, np.full(500, 60), group)
    keys = [(int(group[i]), data[start[i] : start[i] + 60].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_anchors_cross_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 110, 9000).astype(np.uint8)
    whole = [suffixdedup.anchors(data, w) for w in suffixdedup.KINDS]
    monkeypatch.setattr(suffixdedup, "BLOCK", 1000)
    assert all(np.array_equal(a, b) for x, w in zip(whole, suffixdedup.KINDS) for a, b in zip(x, suffixdedup.anchors(data, w)))
