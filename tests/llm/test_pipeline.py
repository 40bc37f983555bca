"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline
from marketloom.llm import decontaminate, simhash
from marketloom.session import stage
from tests.llm.test_minhash import plain_roots
from tests.llm.test_text_operators import plain_hits, plain_lines


def key(doc_id):
    return -1 if doc_id is None else doc_id


def test_stages(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {"start": docs}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf), f"test_{name}")
        kept[name] = docs
        if name != "mixing":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = {r.doc_id for r in kept["start"].collect()}
    good = {r.doc_id for r in kept["quality"].collect()}
    clean = [d for d in before if labels.get(d) == 1]
    assert sum(d in good for d in clean) >= 0.97 * len(clean)
    junk = [d for d in before if labels.get(d) == 0]
    assert sum(d not in good for d in junk) >= 0.8 * len(junk)

    lines = {r.doc_id: r for r in kept["line_dedup"].collect()}
    assert set(lines) == good
    assert all(r.n_chars == len(r.text) for r in lines.values())

    near = {r.doc_id for r in kept["near_dedup"].collect()}
    assert near == set(plain_roots([(d, r.text) for d, r in lines.items()]).values())

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    flagged = decontaminate.scan(kept["near_dedup"], bench).where(decontaminate.is_contaminated())
    bad = {r[0] for r in flagged.select("__row.doc_id").collect()}
    assert {r.doc_id for r in kept["decontaminate"].collect()} == near - bad
    assert {r.doc_id for r in kept["mixing"].collect()} == near - bad


def test_empty_documents(spark, sf, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_through_the_chain(spark, sf, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns; each stage against its plain version."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    some = docs.limit(60).collect()
    passage = bench.first().text
    long = "\n".join(r.text for r in some[:40] if r.text) * 3
    rows = [tuple(r) for r in some] + [tuple(r) for r in some[:10]]
    rows += [(None, some[1].text, None, None, None), (10_001, None, "en", "web", 0), (10_002, "", "en", "web", 0), (10_003, "", None, None, 0)]
    rows += [(10_004, long, "en", "web", len(long)), (10_005, passage, "en", None, len(passage)), (10_006, f"{some[3].text} end", "en", "web", 1)]
    rows += [(20_000 + i, f"Shared line of all\n{some[20 + i].text}", "en", "hot", 1) for i in range(12)]
    clash = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row int, __text string, kept string, node int, bands string, a int, size int"
    table = spark.createDataFrame([(*r, 7, "t", "k", 8, "b", 9, 10) for r in rows], clash)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    before, names = table, [n for n, _ in corpus_pipeline.STAGES]
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, before, str(tmp_path)), f"odd_{name}")
        was, now = before.collect(), after.collect()
        if name != names[-1]:
            assert after.columns == table.columns
            assert {tuple(r)[5:] for r in now} <= {(7, "t", "k", 8, "b", 9, 10)}
        if name == "quality":
            assert {(r.doc_id, r.text) for r in now} <= {(r.doc_id, r.text) for r in was}
            assert len(now) >= 40
        if name == "line_dedup":
            cut = sorted((key(r.doc_id), x[2], x[1]) for r, x in zip(was, plain_lines([r.text for r in was], 10)))
            assert sorted((key(r.doc_id), r.text or "") for r in now) == [(d, t) for d, t, _ in cut]
            assert sum(x[2] for x in cut) >= 10
        if name == "near_dedup":
            ids = [(i, r.text) for i, r in enumerate(was)]
            groups = {}
            for i, root in plain_roots(ids).items():
                groups.setdefault(root, []).append(was[i].doc_id)
            best = [min((d for d in g if d is not None), default=None) for g in groups.values()]
            assert sorted(key(r.doc_id) for r in now) == sorted(key(d) for d in best)
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in bench.collect()]
            clean = [r for r in was if not (h := plain_hits(r.text, items, 13))[1] or 20 * h[1] < h[0]]
            assert sorted(key(r.doc_id) for r in now) == sorted(key(r.doc_id) for r in clean)
        if name == "mixing":
            assert sorted(key(r.doc_id) for r in now) == sorted(key(r.doc_id) for r in was)
        before = after


def test_fingerprints_link_where_shingle_sets_do_not(spark, tmp_path):
    """Repeats change a set of shingles, but not the fingerprint: one text ten times over is the text twenty times over."""
    line = "one two three four five six seven eight nine ten"
    a, b = " ".join([line] * 40), " ".join([line] * 41)
    other = " ".join(f"w{i}" for i in range(60))
    near = " ".join([*(f"w{i}" for i in range(60)), "w60"])
    apart = " ".join(f"x{i}" for i in range(60))
    odd = " ".join(f"{line} {k}" for k in ("p", "q", "r", "s")) + f" {a}"
    rows = [(1, a), (2, b), (3, other), (4, near), (5, apart), (6, odd), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    prints = {d: simhash.fingerprint(t) for d, t in rows}
    jaccard = plain_roots([(d, t or "") for d, t in rows])
    assert (prints[1] ^ prints[6]).bit_count() <= 2 and jaccard[1] != jaccard[6]
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 7]
