"""Classifiers by held-out accuracy, search by recall, archives by round trip, mixing by its totals."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import ann, langid, mixing, quality, urlfilter, warc
from marketloom.llm.queries import QUERIES, RULES

ODD = "doc_id bigint, text string, lang string, source string, score double, __row string, x int, size int, predicted int"


def odd_docs(spark):
    rows = [
        (1, "Hello there, this is text.", "en", "a", 1.0, "x", 1, 1, 1),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 1.0, "x", 1, 1, 1),
        (4, "12 34 !!", "en", None, 1.0, "x", 1, 1, 1),
        (5, "wort " * 40_000, "de", "a", 1.0, "x", 1, 1, 1),
        (None, "Hello again", "en", "b", 1.0, "x", 1, 1, 1),
        (7, "same row", "en", "b", 1.0, "x", 1, 1, 1),
        (7, "same row", "en", "b", 1.0, "x", 1, 1, 1),
    ]
    return spark.createDataFrame(rows, ODD)


def test_quality_on_held_out_labels(spark, sf):
    folder = sf.replace("0.001", "0.01")
    scored = QUERIES["op6_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = scored.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(held) > 40 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert scored.where("score < 0 OR score > 1").count() == 0


def test_trees_agree_with_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.4)).astype(float)
    forest = quality.fit(x, y, trees=15, depth=3)
    assert np.mean((forest.score(x) > 0.5) == y) > 0.97
    for row, p in zip(x[:20], forest.score(x)[:20]):
        total = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (7, 1), (7, 0)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model)
    assert got.count() == 8 and got.select("__row.*").columns == docs.columns
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.train(docs, labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_language_on_held_out_documents(spark, sf):
    folder = sf.replace("0.001", "0.01")
    got = QUERIES["op4_langid"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_forward_pass_equals_plain_convolution():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    model = langid.fit(x, ["a", "b", "a", "c", "b"], per_width=3, epochs=1)
    pooled = (model._maps(x).max(axis=1) + model.bias).clip(0)
    z = pooled @ model.dense + model.out
    expected = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(model.forward(x), expected, atol=1e-5)
    assert langid.windows(b"a" * 193).shape == (2, langid.WINDOW)


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    model = langid.train(docs)
    rows = langid.predict(docs, model).select("__row.doc_id", "lang_pred", "score").collect()
    und = sorted(r.doc_id for r in rows if r.lang_pred == "und")
    assert len(rows) == 8 and und == [2, 3, 4]
    assert {r.lang_pred for r in rows} <= {"und", "en", "de"} and all(0 <= r.score <= 1 for r in rows)
    assert langid.train(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def plain_nearest(rows, is_query, k):
    for q, v in rows:
        if is_query(q):
            s = sorted(((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q))[:k]
            yield q, [(i, -x) for x, i in s]


def test_ann_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    exact = dict(plain_nearest(rows, lambda i: i % 20 == 0, 20))
    got: dict = {}
    for r in QUERIES["op5_ann"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(exact) and all(len(x) == 20 for x in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) / 20 for q in exact])
    assert recall >= 0.9
    vectors = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(np.dot(np.float64(vectors[q]), np.float64(vectors[i])), abs=1e-12) for i, s in found)


@pytest.mark.parametrize("hashes", [1, 2])
def test_ann_of_odd_rows(spark, hashes):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 3 ** (i % 4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]  # ties
    sound = list(rows)
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [1.0]), (None, [1.0] * 6)]
    rows += [rows[0]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, id string, rank int")
    # All axes probed: nothing is missed, so ties, order and blocks can be compared exactly.
    got: dict = {}
    found = ann.search(df, F.pmod("id", F.lit(20)) == 0, k=5, probe_share=1.0, hashes=hashes, tables=2, block_rows=7)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    expected = {q: [(i, round(s, 9)) for i, s in x] for q, x in plain_nearest(sound, lambda i: i % 20 == 0, 5)}
    if hashes == 1:
        assert got == expected
    else:
        assert set(got) == set(expected) and all(len(x) == 5 for x in got.values())
    few = ann.search(df.where("vec_id IN (0, 1, 2)"), F.pmod("id", F.lit(20)) == 0, k=5, probe_share=0.01, tables=1)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_url_rules_equal_plain_version(spark, sf):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    urls += [
        None, "", "no scheme", "http://NET/", "http://net", "https://a.net/x?y", "http://x.example.NET/en/1#f", "ftp://org/fr/ä",
        "http://notnet/", "a://b://c/d", "http://example.com/de/\nx", "http://Éa.org/fr/", "http://e.net?q", "http://example.net/EN/",
    ]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    model = urlfilter.train(urlfilter.label_by_rules(df, RULES))
    rows = urlfilter.judge(df, RULES, model).select("__row.page_id", "host", "path", "rule", "verdict").collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_url_model_learns(spark):
    table = [(f"a{i}.casino.biz", f"/win/{i}", 1) for i in range(40)] + [(f"b{i}.school.edu", f"/library/{i}", 0) for i in range(40)]
    model = urlfilter.train(spark.createDataFrame([*table, (None, "/", 1), *table[:3]], "host string, path string, block int"))
    urls = spark.createDataFrame([(1, "http://z.casino.biz/win/x"), (2, "http://q.school.edu/library/y")], "page_id int, url string")
    got = {r[0]: r.verdict for r in urlfilter.judge(urls, [], model).select("__row.page_id", "verdict").collect()}
    assert got == {1: "block", 2: "allow"}
    none = urlfilter.train(spark.createDataFrame([], "host string, path string, block int"))
    assert {r.verdict for r in urlfilter.judge(urls, [], none).collect()} == {"allow"}
    assert urlfilter.judge(urls.limit(0), RULES, none).count() == 0


def test_url_filter_is_native(spark, sf):
    plan = QUERIES["op7_urlfilter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.choices(range(40), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_warc_round_trip(spark):
    big, other = "ä" * 600 + "\r\n\r\nWARC/1.1\r\n", "b" * 1000
    html = [big, big, None, "", "x" * 999, "x" * 999, other, big, other + "c", other, "\r\n\r", "y" * 3_000_000]
    urls = ["http://B.com/a", "http://a.b.com/", None, "", "no", "http://b.com/a", "http://b.com/\r\nx: y", *["http://b.com/z"] * 5]
    rows = [(i, u, h, "r", 1) for i, (u, h) in enumerate(zip(urls, html))]
    rows += [(None, "http://b.com/", big, "r", 1), rows[7], (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string, ts int").repartition(3)
    index = warc.merge(warc.read_runs(spark, warc.write(df, per_file=3)), per_range=4)
    got = index.orderBy("range_no", "place").collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    keep = {big: 7, other: 9}
    for r in got:
        body = (html[r.page_id] if r.page_id is not None else (big if r.url else None)) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(body.encode()), hashlib.sha1(body.encode()).hexdigest())
        revisit = body in keep and keep[body] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", keep[body]) if revisit else ("response", None))
    keys = [(r.url_key, r.ts) for r in got]
    assert keys == sorted(keys) and len({r.range_no for r in got}) > 1
    assert warc.roundtrip(df.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 50, 400):
        sizes = [rng.choice([0, 1, 5, 5, 40, 300]) for _ in range(n)]
        probs = [0.3] * n
        p = mixing.fly(sizes, probs, rng)
        assert sum(0 < x < 1 for x in p) <= 2
        assert sum(p) == pytest.approx(0.3 * n) and sum(s * x for s, x in zip(sizes, p)) == pytest.approx(0.3 * sum(sizes))
        assert all(x in (0.0, 1.0) for x in mixing.land(sizes, p))


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        goal = {s: cap * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and goal[s] > cap * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_targets_and_totals(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 20, 90])), rng.choice(["b", "B", "é", "z", None])) for i in range(600)]
    rows += [((1 << 60) + i, "w " * 4, "tiny") for i in range(3)] + [(7000, None, "none"), (None, "w w", "b"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id bigint, text string, source string, size int, target string")
    got = mixing.mix(df, block_rows=40).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    goal = plain_targets(sizes)
    for source, target in goal.items():
        mine = [r for r in got if r.source == source]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[source] for r in mine)
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 91
    again = mixing.mix(df.repartition(5), block_rows=40).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_materialises_copies(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s"), (3, "d e f", "t")], "doc_id bigint, text string, source string")
    mixed = mixing.mix(docs)
    words = sum(len(r.text.split()) for r in mixing.materialise(docs, mixed).collect())
    assert words == sum(r.taken for r in mixed.collect())
