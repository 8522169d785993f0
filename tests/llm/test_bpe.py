import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from prismlake.llm import bpe, common, editcount, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
PARTS = ["a", "b", " ", "  ", "\n", "'", "'ll", "l", "é", "1", "!", "😀", "\t", "x" * 40, " " * 30, "字", "́", " word"]


@pytest.fixture(scope="module")
def whole():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_chunks_equal_whole(whole):
    own, rng = bpe.Bpe(RANKS, PATTERN), random.Random(1)
    for _ in range(800):
        t = text(rng, rng.randint(0, 60))
        ids = np.frombuffer(own.encode(t, 20, 12), "<u4").tolist()
        assert ids == whole.encode_ordinary(t)
        assert own.decode(own.encode(t, 20, 12)) == t.encode()


def test_piece_longer_than_chunks(whole):
    own = bpe.Bpe(RANKS, PATTERN)
    t = "start " + "a" * 500 + " end" + " " * 300 + "z"
    assert np.frombuffer(own.encode(t, 50, 20), "<u4").tolist() == whole.encode_ordinary(t)


def test_no_lookbehind():
    with pytest.raises(ValueError):
        bpe.Bpe(RANKS, r"(?<=a)b|.")


def test_table(documents, whole):
    rng = random.Random(2)
    long = text(rng, 900)
    rows = [(1, None), (2, ""), (None, "null id"), (3, "tie"), (3, "tie"), (4, long), (4, long), (5, text(rng, 900))]
    got = bpe.encode_documents(documents(rows), RANKS, PATTERN, chunk=200, overlap=64, spread=400)
    want = []
    for i, t in rows:
        ids = np.array(whole.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    back = bpe.decode_documents(bpe.encode_documents(documents(rows), RANKS, PATTERN, with_ids=True), RANKS, PATTERN)
    assert sorted(str(tuple(r)) for r in back.collect()) == sorted(str((i, t or "")) for i, t in rows)
    assert bpe.encode_documents(documents([]), RANKS, PATTERN).count() == 0


def test_hot_long_text(documents, whole, monkeypatch):
    """Copies of a long text are encoded once and get its result without meeting in one task."""
    monkeypatch.setattr(common, "HOT", 5)
    rng = random.Random(5)
    hot, other = (" ".join(text(rng, 9) for _ in range(300)) for _ in range(2))
    rows = [(None if i % 2 else i, hot) for i in range(12)] + [(50, other), (51, hot[:-1])]
    got = bpe.encode_documents(documents(rows), RANKS, PATTERN, chunk=100, overlap=30, spread=500, with_ids=True).collect()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in got) == sorted(str((i, len(whole.encode_ordinary(t)))) for i, t in rows)
    assert {bytes(r.ids) for r in got if r.doc_id == 51} == {np.array(whole.encode_ordinary(hot[:-1]), "<u4").tobytes()}


def test_given_documents(whole, spark):
    """The query's own sizes on whole texts; most characters are those of texts of several chunks."""
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_byte_bpe(spark, folder).collect()}
    ids = {i: np.array(whole.encode_ordinary(t), "<u4").tobytes() for i, t in texts.items()}
    assert got == {i: (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, x in ids.items()}
    assert sum(len(t) for t in texts.values() if len(t) > bpe.CHUNK) > 0.5 * sum(map(len, texts.values()))


@pytest.mark.parametrize("piece", ["a", "a@", "a.b-", "1-", "1 (", "+", "http://", "1.2.3."])
def test_redactions_read_long_words_once(piece):
    began = time.time()
    list(editcount.PRIVATE.finditer(piece * 200_000))
    assert time.time() - began < 10


def test_edits_equal_new_text(whole):
    own, rng = bpe.Bpe(RANKS, PATTERN), random.Random(3)
    for k in range(300):
        tree = editcount.TokenTree(own, text(rng, rng.choice([0, 3, 40, 300])))
        t = tree.text
        for _ in range(6):
            a = rng.randint(0, len(t) + 2)
            b = a + rng.randint(0, 12) if rng.random() < 0.8 else a + 400
            new = text(rng, rng.randint(0, 6) if rng.random() < 0.9 else 500)
            low = min(a, len(t))
            t = t[:low] + new + t[min(max(b, low), len(t)) :]
            tree.edit(a, b, new)
            assert tree.text == t and tree.tokens == len(whole.encode_ordinary(t))


def test_edits_reencode_little(whole):
    own = bpe.Bpe(RANKS, PATTERN)
    tree = editcount.TokenTree(own, "some words here " * 20_000)
    tree.edit(100_000, 100_004, "changed")
    assert tree.encoded < 60 and tree.tokens == len(whole.encode_ordinary(tree.text))


def test_edit_table(spark, documents, whole):
    docs = documents([(1, "mail a.b@c.org now"), (2, None), (3, "plain"), (None, "x@y.zz"), (3, "plain")])
    edits = spark.createDataFrame([(1, 0, 5, 14, "<M>"), (1, 1, 0, 0, "To: "), (2, 0, 9, 3, "new"), (7, 0, 0, 1, "z"), (3, 0, None, 1, "z"), (None, 0, 0, 1, "z")], "doc_id long, seq long, start long, stop long, text string")
    got = {(r.doc_id, r.n_edits): (r.n_tokens, r.n_tokens_edited) for r in editcount.edited_counts(docs, edits, RANKS, PATTERN).collect()}
    n = lambda t: len(whole.encode_ordinary(t))
    assert got == {(1, 2): (n("mail a.b@c.org now"), n("To: mail <M> now")), (2, 1): (0, n("new")), (3, 0): (n("plain"),) * 2, (None, 0): (n("x@y.zz"),) * 2}
    redacted = editcount.edited_counts(docs, editcount.redactions(docs), RANKS, PATTERN)
    assert {r.n_tokens_edited for r in redacted.where("doc_id = 1").collect()} == {n("mail <MAIL> now")}
    assert editcount.edited_counts(documents([]), edits, RANKS, PATTERN).count() == 0
