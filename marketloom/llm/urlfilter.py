"""URL filters: host and path rules first, a logistic regression on character n-grams for the rest.

Everything is DataFrame functions and Spark's own DataFrame-based learner: the n-grams of host and path
are hashed into a fixed number of features, the regression is fitted on a small labelled URL table,
and the model scores inside the scan. No Python runs on executors and nothing is shuffled but the
labelled table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Rule = tuple[str, str, str]
"""host, path, verdict."""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does. Ties: the first by code point."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _ngrams(text: Column, tag: str, sizes: Sequence[int]) -> Column:
    """Tagged character n-grams, with marks at both ends."""
    marked = F.concat(F.lit("\x02"), ascii_lower(text), F.lit("\x03"))
    return F.concat(*[_grams(marked, tag, n) for n in sizes])


def _grams(marked: Column, tag: str, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.concat(F.lit(tag), F.substr(marked, i, F.lit(n))))


class UrlModel:
    """Hashed n-grams and the fitted regression; without two classes, one verdict for all."""

    def __init__(self, features: int, sizes: Sequence[int]):
        self.sizes = tuple(sizes)
        self.hashing = HashingTF(numFeatures=features, inputCol="__grams", outputCol="__features")
        self.fitted: LogisticRegressionModel | None = None
        self.only = 0.0

    def vectors(self, df: DataFrame) -> DataFrame:
        """Adds ``__grams`` and ``__features`` to a table with ``__host`` and ``__path``."""
        grams = F.concat(_ngrams(F.col("__host"), "h", self.sizes), _ngrams(F.col("__path"), "p", self.sizes))
        return self.hashing.transform(df.withColumn("__grams", grams))

    def verdicts(self, df: DataFrame) -> DataFrame:
        """Adds ``__block``: 1.0 where the model would block."""
        if self.fitted is None:
            return df.withColumn("__block", F.lit(self.only))
        return self.fitted.transform(self.vectors(df)).drop("__grams", "__features", "__raw", "__prob")


def train(
    labelled: DataFrame, *, features: int = 1 << 14, sizes: Sequence[int] = (3, 4), ridge: float = 0.01, max_rows: int = 4000
) -> UrlModel:
    """Fits on a table of ``host, path, block`` (0 or 1); nulls and repeats are left out.

    Of a larger table, about ``max_rows`` rows with the lowest hashes are used, half of them for each label at most;
    weights restore the labels' shares. A row with both labels counts for each. No rows: the model allows everything; one class: that class.
    """
    rows = labelled.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("block").cast("double").alias("label"))
    rows = rows.where("__host IS NOT NULL AND __path IS NOT NULL AND label IS NOT NULL").distinct()
    model = UrlModel(features, sizes)
    n, low, high = rows.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if not n or low == high:
        model.only = low or 0.0
        return model
    share = {0.0: 1.0, 1.0: 1.0}
    if n > max_rows:
        each = dict(rows.groupBy("label").count().collect())
        share = {v: min(1.0, max_rows / 2 / each[v]) for v in share}
        place = F.pmod(F.xxhash64("__host", "__path"), F.lit(1 << 40))
        bound = {v: int((1 << 40) * s) for v, s in share.items()}
        rows = rows.where(place < F.when(F.col("label") == 1.0, bound[1.0]).otherwise(bound[0.0]))
    rows = rows.withColumn("__weight", F.when(F.col("label") == 1.0, 1 / share[1.0]).otherwise(1 / share[0.0]))
    # A small table, in one partition and in order, so that sums do not depend on the cluster.
    rows = model.vectors(rows).coalesce(1).sortWithinPartitions("__host", "__path", "label")
    learner = LogisticRegression(
        featuresCol="__features", labelCol="label", predictionCol="__block", rawPredictionCol="__raw",
        probabilityCol="__prob", weightCol="__weight", regParam=ridge, maxIter=50,
    )
    model.fitted = learner.fit(rows)
    return model


def label_by_rules(urls: DataFrame, rules: Sequence[Rule], *, url: str = "url") -> DataFrame:
    """A labelled URL table: the URLs that a rule settles, with its verdict."""
    parts = urls.select(host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("host", "path", verdict.alias("v")).where("v IS NOT NULL").select(
        "host", "path", (F.col("v") == "block").cast("int").alias("block")
    )


def judge(urls: DataFrame, rules: Sequence[Rule], model: UrlModel, *, url: str = "url") -> DataFrame:
    """``__row`` (the columns of ``urls``), ``host``, ``path``, ``rule`` (null if none fits), ``verdict``.

    Null URL or one without ``://``: host and path are empty and the model decides. Repeated rows are
    each judged; empty table: empty result; other columns may have any name.
    """
    parts = urls.select(
        F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("__row"),
        host_of(F.col(f"`{url}`")).alias("__host"),
        path_of(F.col(f"`{url}`")).alias("__path"),
    )
    name, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    by_model = F.when(F.col("__block") == 1.0, "block").otherwise("allow")
    return model.verdicts(parts).select(
        "__row",
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        name.alias("rule"),
        F.coalesce(verdict, by_model).alias("verdict"),
    )
