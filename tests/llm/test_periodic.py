"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from marketloom.llm import periodic
from marketloom.llm.queries import QUERIES


def plain_runs(words):
    """All periods, all stretches; a stretch counts with its smallest period."""
    n, found = len(words), {}
    x = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]]).astype(int)
        turns = np.flatnonzero(np.diff(same))
        for s, m in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if m + q - s >= max(24, 3 * q):
                found.setdefault((s, m + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def got_of(documents):
    return periodic.runs([periodic.numbered([str(w).encode() for w in d]) for d in documents])


def test_transform_and_its_inverse():
    rng = np.random.default_rng(1)
    for n in (2, 16, 64, 1024, 1 << 17):
        for p, g in periodic.PRIMES:
            b = 3 if n < 5000 else 1
            x, y = (rng.integers(0, p, (n, b), np.uint64) for _ in range(2))
            fx = periodic.transform(x, p, g)
            assert (periodic.inverse(fx, p, g) == x * np.uint64(n) % np.uint64(p)).all()
            if n <= 64:
                z = periodic.inverse(periodic._reduce(fx * periodic.transform(y, p, g), np.uint64(p)), p, g)
                for k in range(n):
                    want = [sum(int(x[i, c]) * int(y[(k - i) % n, c]) for i in range(n)) * n % p for c in range(b)]
                    assert z[k].tolist() == want


@pytest.mark.parametrize("seed", range(6))
def test_random_documents(seed):
    rng = random.Random(seed)
    documents = []
    for _ in range(120):
        d = []
        for _ in range(rng.randint(0, 5)):
            kind, size = rng.random(), rng.randint(1, 60)
            letters = rng.choice(["ab", "abc", "abcdefgh", "x"])
            unit = [rng.choice(letters) for _ in range(size if kind < 0.7 else rng.randint(1, 4))]
            d += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
            d += [f"w{rng.random()}" for _ in range(rng.choice([0, 0, 1, 30]))]
        documents.append(d)
    assert got_of(documents) == [plain_runs(d) for d in documents]


def test_strings_with_many_runs_and_all_borders():
    fib = ["a", "ab"]
    while len(fib[-1]) < 2500:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    borders = [list(f"{'z' * s}") + list("abcdefghijklmnopqrstu"[:q]) * 3 + ["y"] * 5 for s in range(9) for q in (7, 8, 9, 15, 16, 17)]
    same = [["x"] * n for n in (22, 23, 24, 25, 300)]
    gaps = [(["a"] * 40 + ["z"]) * 12]
    documents = [list(fib[-1]), thue, *borders, *same, *gaps, [], ["one"]]
    assert got_of(documents) == [plain_runs(d) for d in documents]


def test_large_numbers_need_several_primes():
    rng = random.Random(5)
    unit = [f"u{i}" for i in range(9000)]
    d = [f"v{i}" for i in range(20_000)] + unit * 3 + unit[:17] + [rng.choice("pq") for _ in range(500)]
    assert got_of([d])[0][0] == (20_000, 27_017, 9000)
    assert [r for r in got_of([d])[0][1:]] == [(s + 47_017, n, q) for s, n, q in plain_runs(d[47_017:])]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    words = [w.decode() for w in words]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(plain_collapse(words, found)),
    )


def test_query_equals_plain_search(spark, sf):
    rows = QUERIES["op13_periodic_runs"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == expected(r.doc_id, texts[r.doc_id]), r.doc_id
    assert sum(r.n_runs > 0 for r in rows) >= len(rows) // 20


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    many = [(i, f"{'a b ' * 20} {i} " + "x " * (i % 50), "r", 1) for i in range(60)]
    rows = [(None, None, None, None), (1, "", "r", 2), (2, " \t\n", "r", 2), (3, long, "r", 2), (3, long, "r", 2), (None, "q " * 30, "r", 2), (5, "Q q " * 12, "r", 3), *many]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, __row int").repartition(3)
    got = periodic.find(df)
    assert got.select("__row.*").columns == ["doc_id", "runs", "__row"]
    want = []
    for d, t, *_ in rows:
        words = (t or "").split()
        want.append((d or 0, len(words), plain_runs(words), plain_collapse(words, plain_runs(words))))
    assert sorted((r["__row"].doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()) == sorted(want)
    assert periodic.find(df.limit(0)).count() == 0
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    result = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, (tuple(r) for r in result))) == sorted(map(repr, ((d, *expected(d, t)) for d, t, *_ in rows)))
