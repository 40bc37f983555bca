"""The operators of this subpackage as queries over the supplied tables, with SQL where SQL can tell the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import ann, conversations, decontaminate, langid, linededup, lm, mixing, packing, periodic, quality, simhash, urlfilter, warc
from marketloom.llm.common import WORD, fold, read
from marketloom.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


_OP1_SQL = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT d.r, d.doc_id, u.pos, u.line,
         translate(trim(u.line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered d, (
    SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos
  ) u
), frequent AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM frequent)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM frequent)), '')) AS kept_sha256
FROM lines GROUP BY r, doc_id
"""


@query("op1_line_dedup", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents, dropped everywhere."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs, min_docs=10, min_chars=1).select(
        "__row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@query("op2_lm_score")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a bigram automaton; every tenth id is held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, fold(F.col("doc_id"), 10) != 0, order=2)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


_OP3_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM item_words, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s(i) WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM doc_words, (SELECT DISTINCT n FROM windows), unnest(generate_series(1, len(w) - n + 1)) AS s(i)
), hits AS (
  SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN windows w ON p.n = w.n AND p.win = w.win
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS s(k) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""".replace(r"\\x", r"\x")


@query("op3_decontaminate", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside 13-word windows of the benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.scan(docs, read(spark, sf_dir, "benchmark"), n=13).select(
        "__row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


@query("op4_langid")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the two thirds of them that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "__row.doc_id", (fold(F.col("__row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )


@query("op5_ann")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by inner product."""
    return ann.search(read(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0, k=20)


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels are learned from four fifths of the ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = quality.train(docs, labels)
    return quality.score(docs, model, threshold=0.3).select(
        "__row.doc_id", (fold(F.col("__row.doc_id"), 5) == 0).alias("held_out"), "score", "predicted"
    )


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("op7_urlfilter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the model learns from the URLs that a rule settles."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    model = urlfilter.train(urlfilter.label_by_rules(pages, RULES))
    return urlfilter.judge(pages, RULES, model).select("__row.page_id", "host", "path", "rule", "verdict")


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 3-word shingles, at most two differing bits."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.group(docs).select("__row.doc_id", "fingerprint", "component_id")


_OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (
  SELECT body, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY body
)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN keep IS NOT NULL AND keep <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep <> p.page_id THEN keep END AS refers_to
FROM p LEFT JOIN g ON p.n >= 1000 AND p.body = g.body
"""


@query("op9_warc", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back, from the merged index."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.roundtrip(pages, min_revisit=1000).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating, and share all words; no document is taken more than three times."""
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of power-of-two lengths up to 2,048, of one document each."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def repeating(docs: DataFrame) -> DataFrame:
    """Every tenth document (by h = crc32 of the id) repeats a unit of its own words from a place of its own on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    some = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "w", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    )
    g, n = F.floor(F.col("h") / 10), F.greatest(F.size("w"), F.lit(1))
    a = (g % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
    unit = F.slice("w", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    return some.select("doc_id", F.when(F.size("w") > 0, changed).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of them made to repeat."""
    found = periodic.find(repeating(read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = periodic.strongest().alias("best")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select("__row.doc_id", "runs", "collapsed", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000).cast("long") * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped (not ``live``), emptied, without ends of sentences, repeated or given to the user by crc32 of their
    place. Nulls count as one space."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    some = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        F.pmod(F.crc32(name.cast("binary")), F.lit(20)).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    row = F.struct(F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return some.select("conv_id", "turn", (F.col("kind") != 0).alias("live"), F.explode(F.array_repeat(row, times)).alias("r")).select(
        "conv_id", "turn", "live", "r.role", "r.text"
    )


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"""


def _edit(cost: str, letter: str, after: str, line: str | None) -> str:
    text = f"list_prepend({line}, {after}.t)" if line else f"{after}.t"
    return f"{{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 't': {text}}}"


def _options(state: int) -> str:
    """Edits of one row in SQL, the cheapest first."""
    wanted = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
    to = {"user": "f2", "assistant": "f3"}[wanted]
    out = [_edit("2", "D", f"f{state}", None)]
    out.append(f"CASE WHEN fault < 2 AND initial = '{wanted[0]}' THEN {_edit('5 * fault', 'K', to, 'line')} END")
    if state == 0:
        out.append(f"CASE WHEN fault < 2 AND initial = 's' THEN {_edit('5 * fault', 'K', 'f1', 'line')} END")
    renamed = f"'{wanted}:' || text"
    out.append(f"CASE WHEN fault < 2 THEN {_edit('1 + 5 * fault', 'R', to, renamed)} END")
    return f"list_sort(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL))[1] AS b{state}"


def _inserting(state: int, to: str) -> str:
    wanted = "assistant" if state == 2 else "user"
    inserted = _edit("5", "I", to, f"'{wanted}:'")
    return f"list_sort([b{state}, {inserted}])[1] AS f{state}"


_OP12_SQL = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor({_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")}, 4294967295) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS nth
  FROM base WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), nth) AS i FROM damaged
), marked AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, role || ':' || text AS line,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 3
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM ordered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 3) AS blank,
         count_if(fault = 2) AS duplicate, count_if(fault = 1) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), walked AS (
  SELECT conv_id, max(i) + 1 AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS f0,
         {{'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS f1,
         {{'c': 5::BIGINT, 'a': 'I', 't': ['assistant:']}} AS f2, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS f3
  FROM marked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_inserting(0, "f2")}, {_inserting(1, "f2")}, f2, f3
  FROM (
    SELECT *, {_inserting(2, "b3")}, {_inserting(3, "b2")}
    FROM (
      SELECT m.conv_id, m.i, {", ".join(_options(k) for k in range(4))}
      FROM walked w JOIN marked m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = w.i - 1
    )
  )
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.f0.c, 0) AS cost, coalesce(w.f0.a, '') AS audit,
       sha256(coalesce(array_to_string(w.f0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN walked w ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = 1
"""


@query("op12_conversation_repair", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, the cheapest edits that repair each, and a digest of the result."""
    fixed = conversations.repair(damaged(read(spark, sf_dir, "conversations")), live="live")
    digests = conversations.digests(fixed.turns).withColumnRenamed("conv_id", "of")
    table = fixed.conversations
    return table.join(digests, table["conv_id"].eqNullSafe(digests["of"]), "left").select(
        *table.columns, F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )
