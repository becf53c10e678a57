"""Scores of an extraction against expected keys, and the stability of repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn over distinct keys."""
    e = expected.select(*keys).distinct().withColumn("wanted", F.lit(True))
    a = actual.select(*keys).distinct().withColumn("given", F.lit(True))
    both = e.join(a, keys, "full_outer")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias
    return both.agg(n(F.col("wanted").isNotNull() & F.col("given").isNotNull())("tp"), n(F.col("wanted").isNull())("fp"), n(F.col("given").isNull())("fn"))


def variant_pairs(names: DataFrame) -> DataFrame:
    """shorter, longer: distinct names where the words of one are some of the other's. Joined by a shared word, not all pairs."""
    own = names.select("name").distinct().withColumn("words", F.array_distinct(F.split(F.lower(F.trim("name")), r"\s+")))
    by_word = own.select("name", "words", F.explode("words").alias("word"))
    other = by_word.select(F.col("name").alias("longer"), F.col("words").alias("more"), "word")
    pairs = by_word.join(other, "word").filter(F.size("words") < F.size("more")).select(F.col("name").alias("shorter"), "longer", "words", "more").distinct()
    return pairs.filter(F.size(F.array_except("words", "more")) == 0).select("shorter", "longer")


def stability(runs: DataFrame) -> DataFrame:
    """common, all, jaccard of the keys that every one of the runs has. runs: run, key."""
    n = runs.select("run").distinct().agg(F.count("*").alias("runs"))
    per = runs.distinct().groupBy("key").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n))
    return per.agg(F.sum((F.col("n") == F.col("runs")).cast("long")).alias("common"), F.count("*").alias("all")).withColumn("jaccard", F.col("common") / F.col("all"))


def gaps(rows: DataFrame, value: str) -> DataFrame:
    """Nearest-rank p50, p95 and the maximum."""
    return rows.agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.max(value).alias("max"))


def confusion_of_relationships(expected: DataFrame, actual: DataFrame, entities: DataFrame) -> DataFrame:
    """tp, fp, fn of relationships by the names of their ends and their type. expected: source, target, type (names); actual: src, dst,
    type (ids); entities: id, name. An edge with an end that names nothing is a false positive."""
    named = actual.join(entities.select(F.col("id").alias("src"), F.col("name").alias("source")), "src", "left").join(entities.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst", "left")
    lost = named.filter("source is null or target is null").select("src", "dst", "type").distinct().agg(F.count("*").alias("lost"))
    known = confusion(expected, named.filter("source is not null and target is not null"), ["source", "target", "type"])
    return known.crossJoin(F.broadcast(lost)).select("tp", (F.col("fp") + F.col("lost")).alias("fp"), "fn")
