"""Merging entities: preferred versions, property strategies, redirected edges, undo."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("prefer_canonical", "prefer_merged", "union", "most_recently_observed")
FIELDS = ("description", "external_ids", "properties")


def stable_json(properties: Column) -> Column:
    """A map as JSON in order of its keys, for comparing only."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties))))


def preference(confidence: Column, has_temporal: Column, description: Column, name: Column, extent_json: Column, properties: Column) -> Column:
    """The total order of entity versions as a struct: the greatest is preferred."""
    text = F.coalesce(description, F.lit(""))
    return F.struct(
        confidence.alias("p1"), has_temporal.alias("p2"), F.length(text).alias("p3"), description.isNotNull().alias("p4"), text.alias("p5"), name.alias("p6"),
        F.coalesce(extent_json, F.lit("")).alias("p7"), F.size(properties).alias("p8"), stable_json(properties).alias("p9"),
    )


def edge_preference(confidence: Column, properties: Column) -> Column:
    return F.struct(confidence.alias("p1"), F.size(properties).alias("p2"), stable_json(properties).alias("p3"))


def best_version(versions: DataFrame, keys: list[str], order: Column, ordinal: str | None = None) -> DataFrame:
    """The preferred row of each key; of equally preferred ones the first by ``ordinal``. One aggregation, no window sort."""
    ranked = F.struct(order.alias("order"), (-F.col(ordinal)).alias("nth")) if ordinal else order
    row = F.struct(*[F.col(c) for c in versions.columns])
    return versions.groupBy(*keys).agg(F.max_by(row, ranked).alias("best")).select("best.*")


def last_write(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key in a batch."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.col(ordinal)).alias("r")).select("r.*")


def first_write(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.col(ordinal)).alias("r")).select("r.*")


def check_policy(default: str, overrides: Mapping[str, str]) -> None:
    for s in (default, *overrides.values()):
        if s == "deep_merge":
            raise NotImplementedError("deep_merge is declared and not implemented")
        if s not in STRATEGIES:
            raise ValueError(f"no strategy {s!r}")
    if default == "union":
        raise ValueError("union can't be the default: only properties take lists")
    for path, s in overrides.items():
        field = path.split(".")[0]
        if field not in FIELDS:
            raise ValueError(f"{path!r} names no mergeable field")
        if s == "union" and field != "properties":
            raise ValueError(f"union isn't legal on {path!r}")


def strategy_for(path: Column, default: str, overrides: Mapping[str, str]) -> Column:
    """The exact path, then its field, then the default."""
    if not overrides:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    return F.coalesce(table[path], table[F.substring_index(path, ".", 1)], F.lit(default))


def resolve(claims: DataFrame, keys: list[str], default: str = "prefer_canonical", overrides: Mapping[str, str] | None = None) -> DataFrame:
    """keys, values (one, or all for union), strategy. claims: keys (among them ``path``), ordinal (0 is the canonical
    entity), value array<string>, observed_at, confidence, origin. A key present with a NULL value is a claim too."""
    check_policy(default, overrides or {})
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "value")))
    latest = F.max_by(F.struct("value"), F.struct("observed_at", "confidence", "origin"))
    agg = claims.groupBy(*keys).agg(ordered.alias("c"), latest.alias("latest")).withColumn("strategy", strategy_for(F.col("path"), default, overrides or {}))
    return agg.select(
        *keys, "strategy",
        F.when(F.col("strategy") == "prefer_canonical", F.col("c")[0]["value"])
        .when(F.col("strategy") == "prefer_merged", F.col("c")[F.least(F.lit(1), F.size("c") - 1)]["value"])
        .when(F.col("strategy") == "union", F.array_distinct(F.flatten(F.transform("c", lambda x: F.coalesce(x["value"], F.array(F.lit(None).cast("string")))))))
        .otherwise(F.col("latest.value")).alias("values"),
    )


def property_claims(members: DataFrame) -> DataFrame:
    """group_id, path, ordinal, value, observed_at, confidence, origin of every property key. members: group_id, ordinal, id,
    properties map<string,array<string>>, observed_at, confidence."""
    return members.select("group_id", "ordinal", F.col("id").alias("origin"), "observed_at", "confidence", F.explode("properties").alias("key", "value")).select(
        "group_id", F.concat(F.lit("properties."), F.col("key")).alias("path"), "ordinal", "value", "observed_at", "confidence", "origin"
    )


def changed_edges(edges: DataFrame, merged: DataFrame, order: Column | None = None, *also: str) -> DataFrame:
    """The edges that a merge changes with all their columns; where they lead (s, d), and whether they stay (stays). Of ``also``, further columns
    of ``merged``, what the groups at either end have, as src_ and dst_ of that name."""
    group = merged.select(F.col("absorbed").alias("m"), F.col("canonical").alias("to"), *also).unionByName(merged.select(F.col("canonical").alias("m"), F.col("canonical").alias("to"), *also)).distinct()
    mapped = edges
    for end in ("src", "dst"):
        mapped = mapped.join(group.select(F.col("m").alias(end), F.col("to").alias(f"to_{end}"), *[F.col(c).alias(f"{end}_{c}") for c in also]), end, "left")
    moved = mapped.filter("to_src is not null or to_dst is not null").withColumns({"s": F.coalesce("to_src", "src"), "d": F.coalesce("to_dst", "dst")})
    best = Window.partitionBy("s", "d", "type").orderBy(*([order.desc()] if order is not None else []), F.desc("id"))
    ranked = moved.withColumn("nth", F.row_number().over(best)).withColumn("stays", (F.col("s") != F.col("d")) & (F.col("nth") == 1))
    return ranked.filter(~(F.col("stays") & (F.col("s") == F.col("src")) & (F.col("d") == F.col("dst"))))


def plan_redirections(edges: DataFrame, merged: DataFrame, order: Column | None = None) -> DataFrame:
    """Edges that a merge changes: id, before_src, before_dst, type, after_src, after_dst (NULL: the edge goes).

    merged: absorbed, canonical. Edges that become loops go; of several with the same ends and type the preferred one stays
    (``order``, then the greatest id); edges that stay as they are aren't listed.
    """
    changed = changed_edges(edges, merged, order)
    return changed.select("id", F.col("src").alias("before_src"), F.col("dst").alias("before_dst"), "type", F.when(F.col("stays"), F.col("s")).alias("after_src"), F.when(F.col("stays"), F.col("d")).alias("after_dst"))


def apply_redirections(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """id, src, dst, type after the plan."""
    joined = edges.select("id", "src", "dst", "type").join(plan.select("id", "after_src", "after_dst", F.lit(True).alias("hit")), "id", "left")
    return joined.filter("hit is null or after_src is not null").select("id", F.coalesce("after_src", "src").alias("src"), F.coalesce("after_dst", "dst").alias("dst"), "type")


def undo_redirections(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """The edges as they were before the plan."""
    kept = edges.join(plan.select("id"), "id", "left_anti").select("id", "src", "dst", "type")
    return kept.unionByName(plan.select("id", F.col("before_src").alias("src"), F.col("before_dst").alias("dst"), "type"))
