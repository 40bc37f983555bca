"""Power-of-two packing against plain tokenization."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marketloom.llm import packing
from marketloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")

PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, expected, limit):
    """Each id in exactly one piece; sequences are full powers of two, of one document, gapless from 0."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        assert len({r.doc_id for r in pieces}) == 1
        total = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == total
            total += r.length
        assert total <= limit and total & (total - 1) == 0
    docs = {}
    for r in sorted(rows, key=lambda r: r.start):
        docs.setdefault(r.doc_id, []).append(r)
    assert set(docs) == set(expected)
    for d, pieces in docs.items():
        ids = expected[d]
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces[:-1]]))
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        yield from ((r, ids[r.start : r.start + r.length]) for r in pieces)


def test_query_equals_plain_tokenization(spark, sf):
    rows = QUERIES["op11_packing"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r, ids in check(rows, {d: plain_ids(t) for d, t in texts.items()}, 2048):
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())


ODD = [
    (1, "Don't cut  me\tHERE\n\x0bor\xa0there", "x"), (2, None, None), (3, "", "x"), (4, " \n ", "x"), (None, "one TWO", "x"),
    (6, "a <|endoftext|> b<|startoftext|>c", "x"), (7, "é ́e ΟΔΟΣ ΟΔΟΣ. \x1c! \x85? 漢字かな 12th  z", "x"),
    (9, "a!!b12'll''s ~tilde~ ##end## x\x00y \x1f \x7f O'REILLY'S don't've été!! l'été's… élan…! É.É! naïve's' ñ'll'", "x"), (8, " ".join(f"Word{i % 977}'s" for i in range(40_000)), "x"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, length string").repartition(3)
    rows = packing.pack(df, tokenizer=PATH, limit=256).collect()
    for r, ids in check(rows, {d: plain_ids(t) for d, t, _ in ODD}, 256):
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
    assert len({r.sequence_id for r in rows}) == len(rows)
    whole = packing.pack(df, tokenizer=PATH, limit=256, by_words=False)
    key = lambda r: (r.doc_id or 0, r.start)
    assert [(r.doc_id, r.start, r.ids) for r in sorted(whole.collect(), key=key)] == [(r.doc_id, r.start, r.ids) for r in sorted(rows, key=key)]
    assert packing.pack(df.limit(0), tokenizer=PATH).count() == 0


def test_repeated_rows_and_full_word_table(spark, monkeypatch):
    df = spark.createDataFrame([(5, "same words here")] * 4, "doc_id bigint, text string")
    rows = packing.pack(df, tokenizer=PATH).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 4 * len(packing.binary_lengths(len(plain_ids("same words here")), 2048))
    small = packing.Encoder(PATH, True, max_words=2)
    for text in ("a b c d", "c d e f g", "a a a"):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == plain_ids(text)[:-1]
        assert max(len(small.known), len(small.old), len(small.pieces)) <= 8


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000, 4096])
def test_binary_lengths(n):
    out = packing.binary_lengths(n, 256)
    assert sum(out) == n and out == sorted(out, reverse=True)
    assert all(k & (k - 1) == 0 and k <= 256 for k in out)
    assert len(set(out) - {256}) == len([k for k in out if k < 256])


def test_buckets_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id bigint, text string")
    packing.write_buckets(packing.pack(df, tokenizer=PATH, limit=16), f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b")
    assert back.where("octet_length(ids) <> 4 * length").count() == 0
    assert sum(r.length for r in back.collect()) == sum(len(plain_ids("word " * i)) for i in range(40))
