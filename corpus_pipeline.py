"""A training corpus from the documents table, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. ``run`` writes
every stage as Parquet under ``spark.checkpoint.dir`` and reads it back. All stages but the last return
the columns of ``docs``, whatever their names; nulls, empty and long texts, ties, repeated rows and
empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, linededup, minhash, mixing, quality, simhash
from marketloom.llm.common import fold, read
from marketloom.session import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below the threshold go."""
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = quality.train(docs, labels)
    return quality.score(docs, model, threshold=0.3).where("predicted = 1").select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines found in ten documents or more go, n_chars follows. A text that loses every
    line stays as an empty document."""
    cut = linededup.dedup(docs, min_docs=10, min_chars=1)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    columns = [
        F.when(changed, new[c]).otherwise(F.col(f"__row.`{c}`")).alias(c) if c in new else F.col(f"__row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return cut.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of documents linked by fingerprints at two bits or fewer, or by a Jaccard
    similarity of 0.8 or more on five-word shingles, that with the smallest id stays."""
    return simhash.keep_one(docs, grouped_by=minhash.group, size=5, similarity=0.8, max_bits=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a twentieth of their words in benchmark windows go; the
    others stay as they are."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"), n=13)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: how many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None
"""SQL has neither the trees nor the minhashes; tests hold each stage against a plain version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
