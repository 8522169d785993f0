"""The pipeline's stages against brute force, each on its predecessor's rows."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken
from test_dedup import brute_components
from test_models import brute_hits

import __spark_entry__
import corpus_pipeline
from prismlake.llm import quality, suffixdedup

SF = "/root/testdata/sf0.001"


def kept_bytes(texts):
    """Without strings of 400 bytes that start anywhere else, and without passages of over 50 words of other texts."""
    n, many, seen, passages = suffixdedup.LENGTH, suffixdedup.WORDS_LEAST + 1, {}, {}
    words = [list(re.finditer(rb"[^ \t-\r]+", t)) for t in texts]
    for k, (t, w) in enumerate(zip(texts, words)):
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
        for i in range(len(w) - many + 1):
            passages.setdefault(tuple(m.group() for m in w[i : i + many]), set()).add(k)
    for t, w in zip(texts, words):
        keep = np.ones(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                keep[i : i + n] = False
        for i in range(len(w) - many + 1):
            if len(passages[tuple(m.group() for m in w[i : i + many])]) > 1:
                keep[w[i].start() : w[i + many - 1].end()] = False
        yield bytes(np.frombuffer(t, np.uint8)[keep])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(160)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good, one, cut, clean, tokens = (f for _, f in corpus_pipeline.STAGES)
    have = lambda df: {r.doc_id: r.text for r in df.collect()}

    first = good(spark, docs, SF)
    assert first.columns == corpus_pipeline.COLUMNS
    accepted = {r.doc_id for r in quality.quality(docs, labels).where("predicted = 1").collect()}
    assert have(first) == {i: t for i, t in have(docs).items() if i in accepted}

    rows = sorted(have(docs).items())  # the next stages on more rows than the first keeps
    second = one(spark, docs, SF)
    _, comps = brute_components(rows)
    assert have(second) == {i: t for (i, t), c in zip(rows, comps) if i == c}

    third = cut(spark, docs, SF)
    assert third.columns == corpus_pipeline.COLUMNS
    assert have(third) == {i: b.decode("utf-8", "ignore") for (i, _), b in zip(rows, kept_bytes([t.encode() for _, t in rows]))}
    assert all(r.n_chars == len(r.text) for r in third.collect())

    fourth = clean(spark, docs, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert have(fourth) == {r[0]: t for r, (_, t) in zip(brute_hits(rows, items), rows) if not r[5]}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda t: hashlib.sha256(np.array(whole.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in tokens(spark, docs, SF).collect()} == {i: digest(t) for i, t in rows}


def test_run_and_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table go through all stages."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (2, plain, "en", "src0", len(plain)), (2, plain, "en", "src0", len(plain)), (3, f"{plain} " * 200, None, None, 1)]
    for name, content in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(content, schema).write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").limit(0 if name == "none" else 1000).write.parquet(f"{folder}/{t}.parquet")
        scored = quality.quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
        kept = {r.doc_id for r in scored.where("predicted = 1").collect()}
        got = [(r.doc_id, r.n_tokens > 0) for r in corpus_pipeline.run(spark, folder).collect()]
        # 2 is there twice, and 3 has nearly the same shingles
        want = [(i, some) for i, some in ((None, False), (1, False), (2, True)) if i in kept]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_rows_survive_once(spark):
    """Of each group of near copies one row is left, with its text, also where ids or rows are repeated or null."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = {k: " ".join(f"{k}{i}" for i in range(200)) for k in "abcde"}
    rows = [(2, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b"), (None, "c"), (4, "c"), (5, "d"), (5, "e")]
    rows = [(i, text[k]) for i, k in rows] + [(None, text["a"] + " more"), (None, text["b"] + " more"), (6, ""), (6, ""), (7, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], schema)
    second = corpus_pipeline.one_of_each(spark, docs, SF)
    assert second.columns == corpus_pipeline.COLUMNS and second.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in second.collect()), key=str)
    b = next(t for i, t in got if i is None and t)  # of the copies without any id either
    assert b.startswith(text["b"])
    want = sorted([(2, text["a"]), (None, b), (4, text["c"]), (5, text["d"]), (5, text["e"]), (6, ""), (7, ""), (None, None)], key=str)
    assert got == want
    third = corpus_pipeline.without_repeats(spark, second, SF)
    assert sorted(((r.doc_id, r.text or "") for r in third.collect()), key=str) == sorted(((i, t or "") for i, t in want), key=str)


def test_entry():
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)
