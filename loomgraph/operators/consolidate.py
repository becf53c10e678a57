"""Merges end to end: what a merge does to fields and edges, the event that records it, and its undoing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import merge

#: of plan_fields: the entities of each group; ordinal 0 is the canonical one.
MEMBER = "group_id, ordinal, id, description, external_ids map<string,string>, properties map<string,array<string>>, observed_at, confidence"
_NO_IDS = "cast(map() as map<string,string>)"
_NO_PROPERTIES = "cast(map() as map<string,array<string>>)"


def field_claims(members: DataFrame) -> DataFrame:
    """The claims of ``merge.resolve``: a description that is there, and every key of external_ids and properties, also with a NULL."""
    base = ["group_id", "ordinal", F.col("id").alias("origin"), "observed_at", "confidence"]
    said = members.filter("description is not null").select(*base, F.lit("description").alias("path"), F.array("description").alias("value"))
    ids = members.select(*base, F.explode("external_ids").alias("key", "v")).select(*[c if isinstance(c, str) else "origin" for c in base], F.concat(F.lit("external_ids."), "key").alias("path"), F.array("v").alias("value"))
    return said.unionByName(ids).unionByName(merge.property_claims(members).select(*said.columns))


def plan_fields(members: DataFrame, default: str = "prefer_canonical", overrides: Mapping[str, str] | None = None) -> DataFrame:
    """group_id, before, after: structs of the three mergeable fields of the canonical entity. ``after`` is whole, since a key that it
    leaves out is a key that goes; description is NULL when nobody has one."""
    resolved = merge.resolve(field_claims(members), ["group_id", "path"], default, overrides)

    def of(field: str, value: Column) -> Column:
        pairs = F.collect_list(F.when(F.col("path").startswith(field + "."), F.struct(F.substring("path", len(field) + 2, 1 << 20).alias("key"), value.alias("value"))))
        return F.map_from_entries(F.array_sort(pairs))

    first = F.col("values")[0]
    after = resolved.groupBy("group_id").agg(
        F.max(F.when(F.col("path") == "description", first)).alias("description"), of("external_ids", first).alias("external_ids"), of("properties", F.col("values")).alias("properties")
    )
    own = members.filter("ordinal = 0").select("group_id", F.struct("description", "external_ids", "properties").alias("before"))
    made = F.struct("description", F.coalesce("external_ids", F.expr(_NO_IDS)).alias("external_ids"), F.coalesce("properties", F.expr(_NO_PROPERTIES)).alias("properties"))
    return own.join(after, "group_id", "left").select("group_id", "before", made.alias("after"))


def refused(asked: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """event_id, problem of the merges that can't be made: no_canonical, into_alias, absorbed_twice, itself. asked: event_id, canonical, absorbed."""
    one = asked.select("event_id", "canonical", F.explode("absorbed").alias("absorbed"))
    known, gone = entities.select(F.col("id").alias("canonical")), aliases.select("alias")
    checks = [
        asked.join(known, "canonical", "left_anti").select("event_id", F.lit("no_canonical").alias("problem")),
        asked.join(gone, F.col("canonical") == F.col("alias"), "left_semi").select("event_id", F.lit("into_alias").alias("problem")),
        one.join(gone, F.col("absorbed") == F.col("alias"), "left_semi").select("event_id", F.lit("absorbed_twice").alias("problem")),
        one.filter("absorbed = canonical").select("event_id", F.lit("itself").alias("problem")),
    ]
    found = checks[0]
    for c in checks[1:]:
        found = found.unionByName(c)
    return found.distinct()


def require_possible(asked: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``asked``, or an error that names a merge that can't be made."""
    bad = refused(asked, entities, aliases).first()
    if bad:
        raise ValueError(f"merge {bad['event_id']}: {bad['problem']}")
    return asked


def plan_edges(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """event_id, before, after: one row for each edge that a merge changes (``after`` NULL: it goes). A merge of a hub changes more edges
    than one row holds, so what only needs the edges takes them from here. asked and edges as of ``plan_merges``."""
    merged = asked.select("event_id", "canonical", F.explode("absorbed").alias("absorbed"))
    order = merge.edge_preference(F.col("confidence"), F.coalesce("properties", F.expr(_NO_IDS)))
    moved = merge.changed_edges(edges, merged, order, "event_id")

    def edge(src: str, dst: str) -> Column:
        return F.struct("id", F.col(src).alias("src"), F.col(dst).alias("dst"), "type", "confidence", "properties")

    return moved.select(F.least("src_event_id", "dst_event_id").alias("event_id"), edge("src", "dst").alias("before"), F.when(F.col("stays"), edge("s", "d")).alias("after"))


def plan_merges(asked: DataFrame, entities: DataFrame, edges: DataFrame, aliases: DataFrame, default: str = "prefer_canonical", overrides: Mapping[str, str] | None = None) -> DataFrame:
    """event_id, canonical, absorbed, redirections, resolution of each asked merge: the payload of a ``merged`` event.

    asked: event_id, canonical, absorbed; the merges share no entity. entities: id, description, external_ids, properties,
    observed_at, confidence; edges: id, src, dst, type, confidence, properties. A merge that can't be made is an error;
    absorbed ids without an entity are left out of the field plan.
    """
    require_possible(asked, entities, aliases)
    pairs = asked.select("event_id", "canonical", F.posexplode("absorbed").alias("nth", "id"))
    members = pairs.select("event_id", "id", (F.col("nth") + 1).alias("ordinal")).unionByName(asked.select("event_id", F.col("canonical").alias("id"), F.lit(0).alias("ordinal")))
    full = members.join(entities, "id").select(F.col("event_id").alias("group_id"), "ordinal", "id", "description", "external_ids", "properties", "observed_at", "confidence")
    fields = plan_fields(full, default, overrides)
    redirections = plan_edges(asked, edges).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("before", "after")), lambda x, y: F.when(x["before"]["id"] < y["before"]["id"], -1).otherwise(1)).alias("redirections"))
    resolution = fields.join(asked.select(F.col("event_id").alias("group_id"), "canonical"), "group_id").select(F.col("group_id").alias("event_id"), F.struct(F.col("canonical").alias("entity_id"), "before", "after").alias("resolution"))
    return asked.join(redirections, "event_id", "left").join(resolution, "event_id", "left").select("event_id", "canonical", "absorbed", "redirections", "resolution")


def plan_undo(merged: DataFrame) -> DataFrame:
    """event_id, canonical, absorbed, restored, fields of merges (the rows of ``plan_merges``): the payload of an ``undone`` event."""
    restored = F.transform(F.coalesce("redirections", F.expr("array()")), lambda r: r["before"])
    return merged.select("event_id", "canonical", "absorbed", restored.alias("restored"), F.col("resolution.before").alias("fields"))


def report(merged: DataFrame) -> DataFrame:
    """event_id, canonical, n_absorbed, n_redirected, n_removed of each merge."""
    moved = F.coalesce("redirections", F.expr("array()"))
    return merged.select("event_id", "canonical", F.size("absorbed").alias("n_absorbed"), F.size(F.filter(moved, lambda r: r["after"].isNotNull())).alias("n_redirected"), F.size(F.filter(moved, lambda r: r["after"].isNull())).alias("n_removed"))


def tally(asked: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows of ``report`` from the edges of ``plan_edges``, which are counted and not gathered."""
    gone = F.col("after").isNull()
    counts = planned.groupBy("event_id").agg(F.count_if(~gone).alias("moved"), F.count_if(gone).alias("gone"))
    told = asked.join(counts, "event_id", "left")
    return told.select("event_id", "canonical", F.size("absorbed").alias("n_absorbed"), *[F.coalesce(c, F.lit(0)).cast("int").alias(n) for c, n in (("moved", "n_redirected"), ("gone", "n_removed"))])
