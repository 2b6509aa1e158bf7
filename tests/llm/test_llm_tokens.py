import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from matchloom.llm import tokens

TEXTS = [
    "", None, "plain words here", "a  b \n c   \n\n d\t\x1c!\x1cq    x  ", "!\x1cb <|endoftext|> Á ́x 12 34   ", "   ", "\n", "x  \ny    z", "can't WON'T it's", "日本語 テスト 😀 é",
    "word " * 3000, "x" * 20000, "'s 's''s", "tab\there\r\n\r\nend", "!\x1cb <|endoftext|> Á ́x 12 34   ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, "b", 1, "k", 2) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "b", 1, "k", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, bucket int, payload string, kind int")


def test_counts_are_the_librarys(docs):
    t = tokens._library(P.path("word_bpe_49k.json"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect())
    want = []
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want.append((str(r.doc_id), len((r.text or "").encode()), n, n > 2048))
    assert got == sorted(want)


def test_ids_are_the_librarys_and_decode_to_the_text(docs):
    e = tokens.encoding(P.path("byte_bpe_multi_50k.tiktoken"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), bytes(r.decoded)) for r in tokens.bpe_round_trip(docs, whole=True).collect())
    want = []
    for r in docs.collect():
        t = r.text or ""
        ids = e.encode_ordinary(t)
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids), t.encode()))
    assert got == sorted(want)


def test_blocks_may_end_anywhere(docs, monkeypatch):
    from matchloom.llm import lm, wordblocks as W

    rows = [(i, t.encode() if t else None, i % 2) for i, t in enumerate(TEXTS)]
    import pyarrow as pa

    monkeypatch.setattr(W, "PACK_BYTES", 90)
    b = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int8())], ["id", "text", "mark"])
    path = P.path("byte_bpe_multi_50k.tiktoken")
    parts = [r for x in W._split(lambda: lm._Counting(path), 3, 4, 200)(iter([b])) for r in x.to_pylist()]
    pieces = [W.unpack(r["payload"]) for r in parts if r["kind"] == W.PIECES]
    assert len({r["block"] for r in parts}) > 3 and sum(len(p[1]) for p in pieces) > 0
    assert sorted(i for r in parts if r["kind"] == W.DOCS for i in W.unpack(r["payload"])[0]) == list(range(len(TEXTS)))
    own = [len((t or "").encode().split()) for i, t in enumerate(TEXTS) if i % 2]
    assert sum(int(p[2].sum()) for p in pieces) == sum(own) and sum(int(p[4].sum()) for p in pieces) == sum(own) + len(own)
    for b, p in ((r["bucket"], p) for r, p in zip([r for r in parts if r["kind"] == W.PIECES], pieces)):
        assert all((b << W.NUMBER_BITS) // 3 <= int(x) < (b + 1 << W.NUMBER_BITS) // 3 for x in W.unspread(p[3]))


def test_blocks_and_buckets_are_dealt_out_evenly(spark):
    from pyspark.sql import functions as F

    from matchloom.llm import wordblocks as W

    keys = [W.block_key(p, n, 13) for p in range(13) for n in range(3)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(13)).alias("s")).groupBy("s").count().collect()
    assert sorted(r["count"] for r in got) == [3] * 13 and len(set(keys)) == 39


def test_totals_of_numbers(monkeypatch):
    from matchloom.llm import wordblocks as W

    rng = np.random.default_rng(2)
    monkeypatch.setattr(W, "MERGED", 50)
    own = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (100, 0, 200, 1)]
    counts = [rng.integers(0, 9, len(x)).astype(np.uint32) for x in own]
    want = {}
    for x, c in zip(own, counts):
        for k, n in zip(x.tolist(), c.tolist()):
            want[k] = want.get(k, 0) + n
    assert [g.tolist() for g in W.totals(own, counts)] == [[want[k] for k in x.tolist()] for x in own]


def test_long_white_space(spark):
    texts = [" " * 5_000_000, "\n" * 2_000_000 + "a", "x" + " " * 1_000_000 + "y", "end" + "\t " * 500_000, "\U0001246f" + " " * 1_000_000 + "\U0001246f z"]
    got = {r.doc_id: r for r in tokens.bpe_round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    e = tokens.encoding(P.path("byte_bpe_multi_50k.tiktoken"))
    # a run of white space is one match, but for the last character before a word
    plain = [[texts[0]], [texts[1][:-2], "\n", "a"], ["x", " " * 999_999, " y"], ["end", "\t " * 500_000], None]
    for i, cut in enumerate(plain):
        assert got[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()
        if cut:
            ids = [x for c in cut for x in e._encode_single_piece(c)]
            assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_every_character_has_the_librarys_ids():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    e, encode = tokens.encoding(path), tokens.encode_pieces(path)
    for start in range(0, 0x110000, 64):
        if 0xD800 <= start < 0xE000:
            continue
        text = "".join(f" {chr(c)}b{chr(c)}1" for c in range(start, start + 64, 1 if start < 0x3000 else 9))
        pieces = [m for w in tokens.led_words(text.encode()) for m in tokens.matches(w)]
        assert encode(pieces, None)[1].tolist() == e.encode_ordinary(text), hex(start)


def test_special_strings_are_the_librarys(spark):
    t = tokens._library(P.path("word_bpe_49k.json"))
    texts = ["a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "<|endoftext", "ĀĀ \x00x", "İẞ ÅÅ", "x<y <b>"]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_empty(docs):
    assert tokens.token_counts(docs.limit(0)).count() == 0
    assert tokens.bpe_round_trip(docs.limit(0)).count() == 0
