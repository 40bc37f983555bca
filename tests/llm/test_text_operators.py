"""Line dedup, decontamination, SimHash and the language model against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, linededup, lm, simhash
from marketloom.llm.common import fold

LONG = " ".join(f"w{i % 700}" for i in range(30_000))
ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row string, n_hit int, fp int, k1 int, items string"


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing column names."""
    base = [
        (1, "alpha beta gamma\nshared line\nown", "en", "a", 3, "x", 1, 1, 1, "i"),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "x", 1, 1, 1, "i"),
        (4, " \t\n ", "en", "a", 0, "x", 1, 1, 1, "i"),
        (5, LONG, "en", "b", 9, "x", 1, 1, 1, "i"),
        (None, "alpha beta gamma\nSHARED LINE \nother", "en", "b", 3, "x", 1, 1, 1, "i"),
        (7, "one two", "en", "b", 3, "x", 1, 1, 1, "i"),
        (7, "one two", "en", "b", 3, "x", 1, 1, 1, "i"),
    ]
    return spark.createDataFrame(base, ODD_SCHEMA)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain_lines(texts, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\f\r").encode().lower()
    seen = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_plain_version(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    rows = docs.collect()
    expected = sorted((r.doc_id, *x) for r, x in zip(rows, plain_lines([r.text for r in rows], 3)))
    got = linededup.dedup(docs, min_docs=3, batches=3).select("__row.doc_id", "n_lines", "n_dropped", "kept")
    assert sorted(map(tuple, got.collect())) == expected
    assert sum(x[2] for x in expected) > 0


def test_line_dedup_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = docs.collect()
    expected = sorted(plain_lines([r.text for r in rows], 2))
    got = linededup.dedup(docs, min_docs=2)
    assert sorted(tuple(r)[1:] for r in got.collect()) == expected
    assert linededup.dedup(docs.limit(0)).count() == 0
    assert got.select("__row.*").columns == docs.columns


def test_line_runs_do_not_depend_on_batches(spark):
    docs = spark.createDataFrame([(f"a\nb{i % 3}\nc{i}",) for i in range(24)], "text string")
    keyed = linededup.keyed_lines(docs).collect()
    for parts in (1, 5, 12):
        runs = linededup.LineRuns(spark, threshold=8, fanout=2)
        for k in range(parts):
            runs.add(spark.createDataFrame(keyed[k::parts], f"k1 bigint, k2 bigint, keys {linededup.KEYS}"))
        assert runs.frequent().count() == 4  # a and b0, b1, b2
        assert sum(len(level) for level in runs.levels) <= 4


def plain_hits(text, items, n):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i : i + n])].add(str(item))
    w = words(text)
    hit, found = set(), set()
    for size in {len(x) for x in windows}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= windows[tuple(w[i : i + size])]
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_broadcast", [8_000_000, 0])
def test_decontamination_in_place_and_joined(spark, max_broadcast):
    items = [
        (1, "The quick brown fox jumps over the lazy dog"), (2, "quick, brown FOX jumps"), (3, "été"), (4, None), (5, "..."),
        (6, "the quick brown fox"), (None, "nothing here counts"), (6, "the quick brown fox"),
    ]
    texts = [
        "A quick brown fox jumps; the quick brown fox jumped over", "été été", "nothing here counts", "", None,
        "over the lazy dog ran the quick brown fox jumps over", LONG + " the quick brown fox",
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_hit int, items string")
    got = {
        r[0]: (r.n_words, r.n_hit, list(r["items"]))
        for r in decontaminate.scan(docs, bench, n=4, max_broadcast=max_broadcast).select("__row.doc_id", "n_words", "n_hit", "items").collect()
    }
    expected = {i: plain_hits(t, items, 4) for i, t in enumerate(texts)}  # items without an id hit, but are not listed
    assert got == {i: (n, hit, [x for x in found if x != "None"]) for i, (n, hit, found) in expected.items()}


def test_decontamination_edges(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.scan(docs, none).where("n_hit > 0").count() == 0
    bench = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    cut = decontaminate.remove_spans(spark.createDataFrame([(1, "So: one, two; three.")], "doc_id bigint, text string"), bench)
    assert cut.first().text == "So: three."
    assert decontaminate.remove_documents(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_spans_of_mixed_lengths(spark, n):
    """Overlapping, touching and nested windows; the removed words are those of the plain version."""
    rng = random.Random(n)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 7, 9])))) for i in range(8)]
    texts = [", ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = decontaminate.scan(docs, bench, n=n).collect()
    for r in found:
        assert (r.n_words, r.n_hit, r["items"]) == plain_hits(r["__row"].text, items, n)
        spans = [(s.start, s.stop) for s in r.spans]
        assert all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, n=n).collect()}
    for r in found:
        words = r["__row"].text.split(", ") if r["__row"].text else []
        left = [w for i, w in enumerate(words, 1) if not any(s.start <= i <= s.stop for s in r.spans)]
        assert re.findall("[a-z]", cut[r["__row"].doc_id]) == left


def test_spans_in_linear_time(spark):
    """A quarter of a million words with a hit every other one."""
    text = " ".join(f"x{i} bad word" for i in range(80_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "bad word")], "item_id bigint, text string")
    r = decontaminate.scan(docs, bench).first()
    assert (r.n_words, r.n_hit, len(r.spans)) == (240_000, 160_000, 80_000)
    assert len(decontaminate.remove_spans(docs, bench).first().text.split()) == 80_000


def plain_print(text, k=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints):
    """doc -> smallest doc reachable over prints at two bits or fewer; by union-find over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(prints):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return {doc: low[find(i)] for i, (doc, _) in enumerate(prints)}


def test_fingerprints_equal_plain_version(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text").collect()
    docs = [r for r in rows if len(r.text) < 3000][:60] + [(-1, LONG), (-2, None), (-3, "one two"), (-4, " ")]
    for _, text in [tuple(d) for d in docs]:
        assert simhash.fingerprint(text) % (1 << 64) == plain_print(text)


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_have_the_components_of_all_pairs(spark, crowd):
    import random

    rng = random.Random(3)
    prints = set()
    for _ in range(12):  # clouds of prints a few bits apart, and strangers
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 25])):
            prints.add(at)
            at ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                at ^= 1 << rng.randrange(64)
            if rng.random() < 0.2:
                at ^= 1 << rng.randrange(64)
    for b in (0, 5, 31, 32, 40, 63):
        prints.add((1 << b) | 7)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    expected = plain_components([(s, s % (1 << 64)) for s in signed])
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    edges = simhash.links(df, crowd=crowd)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {s: roots.get(s, s) for s in signed} == expected


def test_simhash_groups(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    rows = docs.collect()
    expected = plain_components([(r.doc_id, simhash.fingerprint(r.text) % (1 << 64)) for r in rows])
    got = simhash.group(docs).select("__row.doc_id", "component_id", "fingerprint").collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(int(r.fingerprint, 16) == simhash.fingerprint(t) % (1 << 64) for r in got for i, t in rows if i == r.doc_id)
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_simhash_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash.group(docs)
    assert got.count() == docs.count()
    zero = got.where(F.col("fingerprint") == "0" * 16).select("__row.doc_id", "component_id").collect()
    assert sorted(r[0] for r in zero) == [2, 3, 4] and {r[1] for r in zero} == {2}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def plain_lm(rows, order, mass, train, add=0.1):
    counts = [collections.Counter() for _ in range(order + 1)]
    texts = []
    for doc, text in rows:
        w = ["<s>", *((text or "").encode().lower().split()), "</s>"]
        texts.append((doc, w))
        for k in range(1, order + 1) if train(doc) else ():
            for i in range(len(w) - k + 1):
                counts[k][tuple(w[i : i + k])] += 1
    n = sum(v for k, v in counts[1].items() if k != ("<s>",))
    v = sum(k != ("<s>",) for k in counts[1])

    def p(context, w):
        if not context:
            return (counts[1][(w,)] + add) / (n + add * (v + 1))
        k = len(context)
        return (counts[k + 1][(*context, w)] + mass * p(context[1:], w)) / (counts[k][context] + mass)

    for doc, w in texts:
        base = sum(math.log10(p((), x)) for x in w[1:])
        full = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))
        yield doc, len(w) - 1, sum(counts[1][(x,)] > 0 for x in w[1:]), n, base, full


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_equals_plain_version(spark, sf, order):
    docs = documents(spark, sf).select("doc_id", "text").repartition(3)
    train = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    expected = {r[0]: r[1:] for r in plain_lm([tuple(r) for r in docs.collect()], order, 20.0, train)}
    got = lm.score(docs, fold(F.col("doc_id"), 10) != 0, order=order, mass=20.0, block_tokens=5000, range_tokens=4000)
    rows = got.collect()
    assert len(rows) == len(expected)
    for r in rows:
        n, known, total, base, full = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(full)


def test_lm_beats_single_words_on_held_out_text(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    held = lm.score(docs, fold(F.col("doc_id"), 10) != 0).where("NOT train")
    base, full = held.agg(F.sum("base_score"), F.sum("score")).first()
    assert full > base + 0.02 * abs(base)


def test_lm_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = lm.score(docs, F.col("doc_id") != 5).collect()
    assert len(got) == 8 and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert {r.train for r in got if r.doc_id is None or r.doc_id == 5} == {False}
    untrained = lm.score(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)}
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_query_digests(spark, sf):
    from marketloom.llm.queries import QUERIES

    r = QUERIES["op1_line_dedup"](spark, sf).where("n_dropped = 0").first()
    text = documents(spark, sf).where(F.col("doc_id") == r.doc_id).first().text
    assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
