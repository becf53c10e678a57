"""Entities in time: filters, timelines, relations between all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.temporal import relate

RELATIONS = ("equals", "before", "after", "during", "contains", "overlaps")
MAX_PAIRS = 500_000


def interval(lower: Column, upper: Column) -> Column:
    return F.struct(lower.cast("timestamp").alias("lower"), upper.cast("timestamp").alias("upper"))


def in_interval(entities: DataFrame, query: Column, relations: tuple[str, ...] = ("equals", "during", "contains", "overlaps")) -> DataFrame:
    """Entities (with ``bounds``) whose relation to the query is wanted, with that ``relation``."""
    if not set(relations) <= set(RELATIONS):
        raise ValueError(f"no such relation among {relations}")
    return entities.withColumn("relation", relate(F.col("bounds"), query)).filter(F.col("relation").isin(*relations))


def timeline(entities: DataFrame, query: Column | None = None, entity_type: str | None = None) -> DataFrame:
    """Dated entities in order of time: unbounded starts first, unbounded ends last, then id; of one type, or touching an interval, if given."""
    if entity_type is not None:
        entities = entities.filter(F.col("entity_type") == entity_type)
    found = entities.filter("bounds is not null") if query is None else in_interval(entities, query)
    return found.orderBy(*time_order())


def time_order() -> list[Column]:
    return [F.col("bounds.lower").asc_nulls_first(), F.col("bounds.upper").asc_nulls_last(), F.col("id").asc()]


def relations_in_interval(entities: DataFrame, query: Column, *, relations: tuple[str, ...] = RELATIONS, entity_type: str | None = None, max_pairs: int | None = MAX_PAIRS, within: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """The relations between the entities that touch an interval."""
    if entity_type is not None:
        entities = entities.filter(F.col("entity_type") == entity_type)
    return relation_pairs(in_interval(entities, query).drop("relation"), relations, max_pairs, within)


def relation_pairs(entities: DataFrame, relations: tuple[str, ...] = RELATIONS, max_pairs: int | None = MAX_PAIRS, within: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """first, second, relation of every pair within a tenant; after and during are turned into before and contains.

    More than ``max_pairs`` pairs are an error (counted before any is made); None lifts that. The join is by tenant.
    """
    keys = list(within)
    if max_pairs is not None:
        n = entities.filter("bounds is not null").groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        if n > max_pairs:
            raise ValueError(f"{int(n)} pairs; {max_pairs} are allowed")
    dated = entities.filter("bounds is not null")
    a = dated.select(*keys, F.col("id").alias("a"), F.col("bounds").alias("x"))
    b = dated.select(*keys, F.col("id").alias("b"), F.col("bounds").alias("y"))
    related = a.join(b, keys).filter("a < b").withColumn("r", relate(F.col("x"), F.col("y")))
    turned = F.col("r").isin("after", "during")
    out = related.select(*keys, F.when(turned, F.col("b")).otherwise(F.col("a")).alias("first"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("second"), F.when(F.col("r") == "after", "before").when(F.col("r") == "during", "contains").otherwise(F.col("r")).alias("relation"))
    return out.filter(F.col("relation").isin(*relations))
