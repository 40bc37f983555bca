"""Rows, classes and words that an operator must not lose."""

import pytest

from marketloom.llm import decontaminate, langid, mixing, urlfilter


@pytest.mark.parametrize("max_broadcast", [8_000_000, 0])
def test_items_without_id_contaminate(spark, max_broadcast):
    bench = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "four five")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "So one two three"), (2, "four five"), (3, "two one")], "doc_id bigint, text string")
    found = decontaminate.scan(docs, bench, n=3, max_broadcast=max_broadcast)
    got = {r[0]: (r.n_hit, list(r["items"])) for r in found.select("__row.doc_id", "n_hit", "items").collect()}
    assert got == {1: (3, []), 2: (2, ["7"]), 3: (0, [])}
    kept = decontaminate.remove_documents(docs, bench, n=3, max_broadcast=max_broadcast)
    assert [r.doc_id for r in kept.collect()] == [3]


@pytest.mark.parametrize("share", [0.1, 0.3, 2.3])
def test_mix_of_equal_rows_is_exact(spark, share):
    docs = spark.createDataFrame([(None, "a b c d e", "s")] * 1000 + [(1, "", "s")] * 3, "doc_id bigint, text string, source string")
    got = mixing.mix(docs, share=share, block_rows=64).collect()
    assert len(got) == 1003
    assert sum(r.taken for r in got) == round(5000 * share)
    assert max(r.taken for r in got if r.size) - min(r.taken for r in got if r.size) <= 1
    assert all(r.taken == pytest.approx(r.copies * r.size) for r in got if r.size)


def test_rare_url_label_keeps_the_table_small(spark, monkeypatch):
    sizes = []

    class Learner(urlfilter.LogisticRegression):
        def fit(self, df):
            sizes.append({r.label: (r["count"], r.w) for r in df.groupBy("label").agg(
                urlfilter.F.count("*").alias("count"), urlfilter.F.sum("__weight").alias("w")).collect()})
            return super().fit(df)

    monkeypatch.setattr(urlfilter, "LogisticRegression", Learner)
    table = [(f"h{i}.net", f"/p/{i}", 1) for i in range(3000)] + [("only.edu", "/library", 0)]
    model = urlfilter.train(spark.createDataFrame(table, "host string, path string, block int"), max_rows=20)
    assert model.fitted is not None
    assert sizes[0][0.0][0] == 1 and 1 <= sizes[0][1.0][0] <= 40
    assert sizes[0][1.0][1] == pytest.approx(300 * sizes[0][1.0][0])


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, f"word{chr(97 + k % 26)} " * 5, f"x{k}") for k in range(70) for i in range(3 if k else 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert langid.train(docs, epochs=0).langs == sorted({r[2] for r in rows})
