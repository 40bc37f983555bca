"""Near-duplicates by the Jaccard similarity of their word shingles.

A document is the set of its five-word shingles; documents with the same set are one class, and only classes are
compared. Candidates share a band of minhashes: 24 bands of five find a pair at similarity 0.8 with probability
0.9999. Every candidate pair is verified on the whole sets, so no link is an estimate.

A bucket is not simply paired up. First each member is verified against the bucket's lead, the member that meets most others
over all bands: of many edited copies that is the text they come from. Links make components. Then, in buckets of up
to 16 classes, members of different components are paired. Larger buckets that still hold several components are a crowd:
its classes meet by their rarest shingles, as many as it takes for every pair at the similarity to share one (``_alike``).
No pair of a crowd is left out, and of those far apart few meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import simhash
from marketloom.llm.common import bounded_batches, stage, text_key
from marketloom.llm.simhash import components

BANDS, ROWS = 24, 5
_CLASS = math.log(1.05)
_SLACK = 1e-6
"""For bounds on whole numbers that are computed in doubles."""
_CHUNK = 1024
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3: a bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted; fewer words than a shingle: the whole sequence is one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h64 = xxhash.xxh64_intdigest
    w = np.fromiter((h64(x) for x in words), np.uint64, len(words))
    width = min(size, len(w))
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = _mixed(h * _ODD + w[k : k + n])
    return np.unique(h)


def bands(grams: np.ndarray) -> list[int]:
    """A signed 64-bit value for each band; no shingles: none."""
    if not len(grams):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), _CHUNK):
        part = grams[None, at : at + _CHUNK] * _MUL[:, None]
        part += _ADD[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    low = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key * _ODD + low[:, k])
    return key.view(np.int64).tolist()


def _prints(docs: DataFrame, size: int, marked: bool = False) -> DataFrame:
    """For ``__row, __text``: ``__row``, ``t1, t2`` (text key), ``node`` (128 bits of the shingle set),
    ``n`` (its size), ``bands``; ``marked``: and ``fp``, the SimHash fingerprint."""
    bounded_batches(docs.sparkSession)
    t1, t2 = text_key(F.coalesce(F.col("__text"), F.lit("")))
    source = docs.select("__row", t1.alias("t1"), t2.alias("t2"), "__text")
    added = {"node": F.lit(b""), "n": F.lit(0).cast("long"), "bands": F.array().cast("array<long>")}
    if marked:
        added["fp"] = F.lit(0).cast("long")
    schema = source.select("__row", "t1", "t2", *[c.alias(k) for k, c in added.items()]).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, keys = [], [], []
            for t in b.column(3):
                grams = shingles(t.as_py(), size)
                node.append(xxhash.xxh3_128_digest(grams.tobytes()))
                n.append(len(grams))
                keys.append(bands(grams))
            new = [pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            if marked:
                new.append(pa.array([simhash.fingerprint(t.as_py()) for t in b.column(3)], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *new], names=names)

    return source.mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, grams`` (shingle hashes) of the classes ``node, t1, t2``, from one of the rows with that text."""
    t1, t2 = text_key(F.coalesce(F.col("__text"), F.lit("")))
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), F.coalesce("__text", F.lit("")).alias("__text"))
    source = texts.join(wanted, ["t1", "t2"]).select("node", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [shingles(t.as_py(), size).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["node", "grams"])

    return source.mapInArrow(run, "node binary, grams array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have that similarity or more."""
    of_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    both = of_b.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def _fits(a: str, b: str, similarity: float) -> Column:
    """The sizes of two sets allow the similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """``root`` for each member by the links so far, and only buckets that hold several components."""
    roots = stage(components(links), "minhash_roots").withColumnRenamed("root", "r")
    placed = stage(
        members.join(roots, "node", "left").select("bucket", "m", "node", "n", F.coalesce("r", "node").alias("root")), "minhash_placed"
    )
    ends = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return stage(placed.join(ends.select("bucket"), "bucket"), "minhash_mixed")


def _across(mixed: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one bucket in different components whose sizes allow the similarity."""
    p, q = mixed.alias("p"), mixed.alias("q")
    met = p.join(q, (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.root") < F.col("q.root")))
    return met.where(_fits("p.n", "q.n", similarity)).select(_pair("p.node", "q.node")).select("pair.*").distinct()


def _pair(a: str, b: str) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("pair")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / _CLASS).cast("int")


def _alike(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of ``node, n, root`` in different components, all that have the similarity among them.

    The shingles of each set stand in one order, those held by fewest sets first. Two sets of n and m shingles at similarity
    s have s / (1 + s) x (n + m) of them in common or more, and behind the first of these neither set has fewer. So that
    one stands at a place i where (n - i) (1 + s) / s - n is m or more, and likewise in the other set: pairs meet by such
    places, the larger set looking up the classes of sizes that its place allows. Shingles of one set alone take up
    places, but meet nothing: a copy with many words of its own makes no pairs.
    """
    held = crowd.join(sets, "node").select("node", "n", "root", F.explode("grams").alias("gram"))
    shared = held.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
    listed = held.join(shared, "gram").groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("list"))
    own = F.col("n") - F.size("list")
    places = F.floor(F.col("n") * (1 - similarity) + _SLACK) + 1
    met = listed.select("node", "n", "root", own.alias("own"), F.slice("list", F.lit(1), F.greatest(places - own, F.lit(0)).cast("int")).alias("list"))
    met = met.select("node", "n", "root", "own", F.posexplode("list").alias("k", "e"))
    most = (F.col("n") - F.col("own") - F.col("k")) * ((1 + similarity) / similarity) - F.col("n") + _SLACK
    entries = stage(met.select("node", "n", "root", F.col("e.gram").alias("gram"), most.alias("most")), "minhash_entries")
    lower = entries.where("most >= n").withColumn("size", _size_class(F.col("n")))
    least, largest = F.ceil(F.col("n") * similarity - _SLACK), F.floor(F.least("most", "n"))
    upper = entries.where(largest >= least).withColumn("size", F.explode(F.sequence(_size_class(least), _size_class(largest))))
    # Where sets of one component crowd at a place, only those of others look for partners there.
    count = lower.groupBy("gram", "size", "root").agg(F.count("*").alias("m"))
    main = stage(count.groupBy("gram", "size").agg(F.max(F.struct("m", "root")).alias("l")).select("gram", "size", F.col("l.root").alias("main")), "minhash_main")
    lower, upper = lower.join(main, ["gram", "size"]), upper.join(main, ["gram", "size"])

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        on = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.root") != F.col("y.root"))
        fits = _fits("x.n", "y.n", similarity) & (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most"))
        return x.join(y, on & fits).select(_pair("x.node", "y.node")).select("pair.*").distinct()

    other = F.col("root") != F.col("main")
    return pairs(upper.where(other), lower).unionByName(pairs(upper.where(~other), lower.where(other))).distinct()


def links(classes: DataFrame, docs: DataFrame, *, size: int, similarity: float, crowd: int = 16) -> DataFrame:
    """Links ``a, b`` between classes (``node, n, t1, t2, bands``) at ``similarity`` or more. Their components are those
    of all pairs that share a bucket, and in crowds of all pairs of their classes."""
    table = stage(classes.select("node", "n", F.explode("bands").alias("bucket")), "minhash_table")
    sizes = table.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    met = stage(table.join(sizes, "bucket"), "minhash_members")
    popular = stage(met.groupBy("node").agg(F.sum("m").alias("popular")), "minhash_popular")
    leads = met.join(popular, "node").groupBy("bucket").agg(F.max(F.struct("popular", "node", "n")).alias("l"))
    leads = stage(leads.select("bucket", F.col("l.node").alias("lead"), F.col("l.n").alias("lead_n")), "minhash_leads")
    sets = stage(
        _sets(docs, classes.select("node", "t1", "t2").join(popular.select("node"), "node", "left_semi"), size).dropDuplicates(["node"]),
        "minhash_sets",
    )
    led = met.join(leads, "bucket").where((F.col("node") != F.col("lead")) & _fits("n", "lead_n", similarity))
    stars = stage(led.select(_pair("lead", "node")).select("pair.*").distinct(), "minhash_stars")
    found = stage(_verified(stars, sets, similarity), "minhash_found")
    mixed = _rooted(met, found)
    near = _alike(mixed.where(F.col("m") > crowd).select("node", "n", "root").distinct(), sets, similarity)
    near = near.unionByName(_across(mixed.where(F.col("m") <= crowd), similarity)).distinct().join(stars, ["a", "b"], "left_anti")
    return found.unionByName(stage(_verified(stage(near, "minhash_near"), sets, similarity), "minhash_more"))


def _simhash_links(printed: DataFrame, max_bits: int) -> DataFrame:
    """Links ``a, b`` that join classes whose documents have SimHash fingerprints at ``max_bits`` or fewer: between
    fingerprints (8 bytes, classes have 16), and from a class to those of its fingerprints that link anything."""
    marks = stage(printed.select("node", "fp").distinct(), "minhash_marks")
    near = stage(simhash.links(marks.select("fp").distinct(), max_bits=max_bits), "minhash_simhash")
    shared = marks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    wanted = shared.unionByName(near.select(F.col("a").alias("fp"))).unionByName(near.select(F.col("b").alias("fp"))).distinct()
    as_node = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    own = marks.join(wanted, "fp", "left_semi").select(F.col("node").alias("a"), as_node("fp").alias("b"))
    return own.unionByName(near.select(as_node("a").alias("a"), as_node("b").alias("b")))


def group(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = 5, similarity: float = 0.8, crowd: int = 16,
    max_bits: int | None = None,
) -> DataFrame:
    """Near-duplicate groups: the columns of ``docs`` without the text as struct ``__row``, with ``fingerprint``
    (the group, 32 hex digits) and ``component_id`` (smallest doc_id of the group).

    Words are cut at white space, A-Z count as a-z. Null or empty text, or only white space: one group. Fewer words
    than a shingle: the whole sequence is one. Null doc_id: takes part, but names a group only if it has no other id
    (then null). Repeated rows and ids: each row is returned. Empty table: empty result.

    With ``max_bits``, documents whose SimHash fingerprints differ in that many bits or fewer are linked as well
    (``simhash.links``, three-word shingles), and a group is what both kinds of links reach.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    docs = docs.select(row.alias("__row"), F.col(f"`{text}`").alias("__text"))
    printed = stage(_prints(docs, size, max_bits is not None), "minhash_prints")
    classes = stage(
        printed.groupBy("node").agg(
            F.min("n").alias("n"), F.min(f"__row.`{doc_id}`").alias("least"), F.min(F.struct("t1", "t2")).alias("t"),
            F.min("bands").alias("bands"),
        ).select("node", "n", "least", "t.*", "bands"),
        "minhash_classes",
    )
    edges = links(classes, docs, size=size, similarity=similarity, crowd=crowd)
    if max_bits is not None:
        edges = edges.unionByName(_simhash_links(printed, max_bits))
    rooted = stage(
        classes.join(components(edges).withColumnRenamed("root", "r"), "node", "left").select(
            "node", "least", F.coalesce("r", "node").alias("root")
        ),
        "minhash_rooted",
    )
    named = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "minhash_named")
    of_node = stage(rooted.join(named, "root").select("node", "root", "component_id"), "minhash_components")
    return printed.join(of_node, "node").select("__row", F.lower(F.hex("root")).alias("fingerprint"), "component_id")
