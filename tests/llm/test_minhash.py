"""Near-duplicates of the pipeline: Jaccard similarity of five-word shingles, against all pairs."""

import random

import corpus_pipeline
from marketloom.llm import minhash, simhash


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_roots(rows):
    """Smallest id of each component, from all pairs at 0.8 or more."""
    sets = {d: plain_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}


def test_near_dedup_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = plain_roots(rows)
    apart = {a for a, r in expected.items() if a != r and plain_set(dict(rows)[a]) != plain_set(dict(rows)[r])}
    assert apart
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(expected.values())


def test_chains_and_a_large_group(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    rows = []

    def edited(base, edits):
        w = list(base)
        for at in rng.sample(range(len(w)), edits):
            w[at] = rng.choice(words)
        return w

    for _ in range(8):  # a chain: neighbours are near, the ends are not
        w = rng.choices(words, k=120)
        for _ in range(6):
            rows.append(w)
            w = edited(w, 2)
    base = rng.choices(words, k=150)  # copies of one text, many of them near the base only
    rows += [base] + [edited(base, rng.randint(1, 6)) for _ in range(150)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = minhash.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["__row"].doc_id: r.component_id for r in got} == plain_roots(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (None, "a b c d e f"), (None, "A b c d e f"), (4, "one two"), (6, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.group(df)
    assert sorted((r["__row"].doc_id or 0, r.component_id or 0) for r in got.collect()) == [
        (0, 0), (0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6)
    ]
    kept = simhash.keep_one(df, grouped_by=minhash.group)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6]
    assert simhash.keep_one(df.limit(0), grouped_by=minhash.group).count() == 0


def test_a_crowd_of_edited_copies(spark):
    """Buckets larger than the bound for pairs: many copies are near others but not near the text they come from."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=150)
    rows = []
    for _ in range(300):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 6, 7, 8])):
            w[at] = rng.choice(words)
        rows.append(w)
        if rng.random() < 0.3:
            v = list(w)
            v[rng.randrange(150)] = "x"
            rows.append(v)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    expected = plain_roots(rows)
    got = minhash.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), crowd=16).collect()
    found = {r["__row"].doc_id: r.component_id for r in got}
    assert all(expected[d] == expected[c] for d, c in found.items())  # no false link
    linked = [d for d in expected if expected[d] != d]
    assert len(linked) > 200
    assert sum(found[d] != d for d in linked) >= 0.99 * len(linked)


def test_one_member_of_a_crowd_is_near(spark):
    """A part of one text of a crowd has 0.8 of that text, and a little less of each of the others, which are nearly the same."""
    rows, expected = [], {}
    for c in range(4):
        first = len(rows)
        base = [f"c{c}w{k}" for k in range(1003)]
        rows += [base + [f"c{c}own{k}"] for k in range(150)]
        rows.append(rows[first][-804:])
        part, own, other = (plain_set(" ".join(rows[k])) for k in (-1, first, first + 1))
        assert len(part & own) >= 0.8 * len(part | own) and len(part & other) < 0.8 * len(part | other)
        expected |= {i: first for i in range(first, len(rows))}
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = minhash.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["__row"].doc_id: r.component_id for r in got} == expected


def test_pairs_of_a_crowd_are_all_met(spark):
    """Sets of all sizes, many at exactly the similarity, some already in one component."""
    rng = random.Random(5)
    sets = []
    for _ in range(100):
        s = rng.sample(range(400), rng.choice([1, 2, 4, 5, 9, 10, 20, 45, 90]))
        for _ in range(rng.randint(1, 8)):
            sets.append(sorted(s))
            drop = rng.randint(0, max(1, len(s) // 5))
            s = rng.sample(s, max(1, len(s) - drop)) + rng.sample(range(400, 800), rng.choice([0, 0, len(s) // 10, len(s) // 5]))
    sets = [list(s) for s in {tuple(sorted(set(s))) for s in sets}]
    named = [(bytes([i // 256, i % 256]), s, bytes([rng.randrange(60)])) for i, s in enumerate(sets)]
    crowd = spark.createDataFrame([(a, len(s), r) for a, s, r in named], "node binary, n long, root binary")
    grams = spark.createDataFrame([(a, s) for a, s, _ in named], "node binary, grams array<long>")
    near = minhash._alike(crowd, grams, 0.8)
    wanted = set()
    for a, x, r in named:
        for b, y, q in named:
            common = len(set(x) & set(y))
            if a < b and r != q and common >= 0.8 * (len(x) + len(y) - common):
                wanted.add((a, b))
    met = [(bytes(p.a), bytes(p.b)) for p in near.collect()]
    assert len(wanted) > 100 and len(met) == len(set(met)) and wanted <= set(met)
    root = {a: r for a, _, r in named}
    assert all(root[a] != root[b] for a, b in met)
