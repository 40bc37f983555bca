"""Benchmark decontamination with DataFrame functions only.

Benchmark items are normalised to words and cut into windows of n words. Their hashes and words form a
hash set that travels with the tasks as one constant: an array of buckets, addressed by hash. Each
document is scanned in place: the hash of every window of its words is looked up, hits are verified
word by word, and the covered words are counted. Documents are neither exploded nor shuffled.

The set is sent along only up to ``max_broadcast`` characters, measured before. A larger benchmark is joined on
128-bit window hashes instead, with both sides distributed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, stage, text_key

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ROW, _WORDS = "__row", "__words"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def windows_of(benchmark: DataFrame, n: int, text: str, item_id: str) -> DataFrame:
    """Distinct windows: ``len, w`` (words, space-joined), ``items`` (ids as text; empty if only null ids have it)."""
    words = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), words_of(F.col(f"`{text}`")).alias("words"))
    size = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    each = words.where(size > 0).select(
        "item", F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("win")
    )
    return each.groupBy(F.size("win").alias("len"), F.array_join("win", " ").alias("w")).agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


def _hash(len_: int, at: Column) -> Column:
    return F.xxhash64(F.slice(F.col(_WORDS), at, len_))


def _starts(len_: int) -> Column:
    n = F.size(_WORDS)
    return F.when(n >= len_, F.sequence(F.lit(1), n - len_ + 1)).otherwise(F.array().cast("array<int>"))


def _hits_in_place(windows: DataFrame, lengths: list[int], count: int) -> Column:
    """Array of (start, stop, items) found by looking each window of the document up in the set."""
    buckets = max(16, 2 * count)
    found = []
    for len_ in lengths:
        entry = windows.where(F.col("len") == len_).withColumn("h", F.xxhash64(F.split("w", " ")))
        # One constant instead of one expression for each window.
        rows = [
            r.b
            for r in entry.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket"))
            .agg(F.collect_list(F.struct("h", "w", "items")).alias("e"))
            .select(F.to_json(F.struct("bucket", "e")).alias("b"))
            .collect()
        ]
        found.append(_lookup(_literal_buckets(rows, buckets), buckets, len_))
    return F.concat(*found) if len(found) > 1 else found[0]


def _lookup(table: Column, buckets: int, len_: int) -> Column:
    """Windows of one length that are in the set, verified by their words."""

    def bucket(h: Column) -> Column:
        return F.element_at(table, (F.pmod(h, F.lit(buckets)) + 1).cast("int"))

    hashes = F.transform(_starts(len_), lambda i: _hash(len_, i))
    at = F.array_compact(
        F.transform(hashes, lambda h, i: F.when(F.exists(bucket(h), lambda e: e["h"] == h), i + 1))
    )

    def verified(i: Column) -> Column:
        seen = F.array_join(F.slice(F.col(_WORDS), i, len_), " ")
        return F.transform(
            F.filter(bucket(_hash(len_, i)), lambda e: e["w"] == seen),
            lambda e: F.struct(i.alias("start"), (i + len_ - 1).alias("stop"), e["items"].alias("items")),
        )

    return F.flatten(F.transform(at, verified))


def _literal_buckets(rows: list[str], buckets: int) -> Column:
    table: list[list] = [[] for _ in range(buckets)]
    for r in rows:
        x = json.loads(r)
        table[x["bucket"]] = x["e"]
    schema = "array<array<struct<h:bigint,w:string,items:array<string>>>>"
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), schema)


def _hits_joined(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``k1, k2`` (text key) and ``hits`` for texts with hits; both sides are shuffled by window."""
    text1, text2 = text_key(F.coalesce(F.col("__text"), F.lit("")))
    keyed = docs.select(text1.alias("k1"), text2.alias("k2"), words_of(F.col("__text")).alias(_WORDS))
    win = stage(
        windows.select("len", "items", *[c.alias(n) for n, c in zip(("h1", "h2"), text_key(F.col("w")))]), "decon_windows"
    )

    def pair(len_: int):
        return lambda i: F.struct(
            F.lit(len_).alias("len"),
            i.alias("start"),
            *[c.alias(n) for n, c in zip(("h1", "h2"), text_key(F.array_join(F.slice(F.col(_WORDS), i, len_), " ")))],
        )

    every = F.concat(*[F.transform(_starts(len_), pair(len_)) for len_ in lengths])
    hits = keyed.select("k1", "k2", F.explode(every).alias("x")).select("k1", "k2", "x.*")
    return (
        hits.join(win, ["len", "h1", "h2"])
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("start", (F.col("start") + F.col("len") - 1).alias("stop"), "items")).alias("hits"))
    )


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    n: int = 13,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    max_broadcast: int = 8_000_000,
) -> DataFrame:
    """Contamination of each document, as columns beside ``__row`` (the document's columns).

    ``n_words``; ``spans``, disjoint word ranges (start, stop; from 1) covered by windows; ``n_hit``,
    words in them; ``items``, ids of the items with a window in the document, sorted as text.

    Null or empty text: no words, no hits. An item with fewer than n words is one window, one without
    words none. An item with a null id counts for spans and hits, but is not listed; one with a null text has no words. Items
    with the same window are all reported. Repeated documents are each scanned. Empty benchmark: no hits. Other columns of docs are kept in ``__row`` and may have
    any name.
    """
    windows = stage(windows_of(benchmark, n, item_text, item_id), "decon_set")
    chars = F.sum(F.length("w") + 40 + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x) + 3))
    count, size, lengths = windows.agg(F.count("*"), chars, F.sort_array(F.collect_set("len"))).first()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW), F.col(f"`{text}`").alias("__text")
    )
    empty = F.array().cast("array<struct<start:int,stop:int,items:array<string>>>")
    if not count:
        found = rows.select(_ROW, words_of(F.col("__text")).alias(_WORDS)).select(
            _ROW, F.size(_WORDS).alias("n_words"), empty.alias("hits")
        )
    elif size <= max_broadcast:
        found = rows.select(_ROW, words_of(F.col("__text")).alias(_WORDS)).select(
            _ROW, F.size(_WORDS).alias("n_words"), _hits_in_place(windows, lengths, count).alias("hits")
        )
    else:
        hits = stage(_hits_joined(rows, windows, lengths), "decon_hits")
        k1, k2 = text_key(F.coalesce(F.col("__text"), F.lit("")))
        found = (
            rows.withColumns({"k1": k1, "k2": k2})
            .join(hits, ["k1", "k2"], "left")
            .select(_ROW, F.size(words_of(F.col("__text"))).alias("n_words"), F.coalesce("hits", empty).alias("hits"))
        )
    # A generator of one row keeps what is above it from being worked out again for each mention.
    bounds = F.struct(
        F.col("n_words").cast("long").alias("n_words"),
        F.array_sort(F.transform("hits", lambda h: h["start"])).alias("starts"),
        F.array_sort(F.transform("hits", lambda h: h["stop"])).alias("stops"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"),
    )
    sorted_once = found.select(_ROW, F.inline(F.array(bounds)))
    merged_once = sorted_once.select(_ROW, "n_words", _merged().alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"] + 1)
    # A generator of one row: a later filter on n_hit stays above it. Pushed below, it would repeat the
    # whole scan inside its condition.
    once = F.inline(F.array(F.struct("n_words", "spans", n_hit.alias("n_hit"), "items")))
    return merged_once.select(_ROW, once)


def _merged() -> Column:
    """Disjoint spans from the sorted ``starts`` and ``stops`` of overlapping ones, in linear time.

    With both sorted on their own, a span of the union begins where a start lies behind the stop of the place before, and
    ends where a stop lies before the start of the next place.
    """
    begins = F.filter("starts", lambda x, i: (i == 0) | (x > F.get("stops", i - 1)))
    ends = F.filter("stops", lambda x, i: (i == F.size("stops") - 1) | (F.get("starts", i + 1) > x))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))


def is_contaminated(ratio_inverse: int = 20) -> Column:
    """At least one hit word in so many words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * ratio_inverse >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without the contaminated ones; the others stay as they are."""
    return scan(docs, benchmark, **options).where(~is_contaminated()).select(f"{_ROW}.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """Documents with every hit word taken out of the text, whatever its share."""
    original = F.col(f"{_ROW}.`{text}`")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    scanned = scan(docs, benchmark, text=text, **options).select(_ROW, "n_words", "spans", (F.col("n_hit") > 0).alias("hit"))
    # One flag for each word: gaps and spans in turn.
    gap = lambda s, k: s["start"] - 1 - F.when(k > 0, F.get("spans", k - 1)["stop"]).otherwise(0)
    flags = F.transform(
        "spans", lambda s, k: F.concat(F.array_repeat(F.lit(False), gap(s, k)), F.array_repeat(F.lit(True), s["stop"] - s["start"] + 1))
    )
    some = F.when(F.col("hit"), original)
    parts = F.struct(
        F.regexp_extract_all(some, F.lit(word), F.lit(0)).alias("words"), F.split(some, word).alias("between"), F.flatten(flags).alias("gone"), "hit"
    )
    once = scanned.select(_ROW, F.inline(F.array(parts)))
    kept = F.transform("words", lambda w, i: F.when(F.get("gone", i), "").otherwise(F.concat(w, F.get("between", i + 1))))
    new = F.when(F.col("hit"), F.concat(F.get("between", F.lit(0)), F.array_join(kept, ""))).otherwise(original)
    return once.select(*[(new if c == text else F.col(f"{_ROW}.`{c}`")).alias(c) for c in docs.columns])
