"""Reads of the entity and edge tables: pages, lookups, directions, neighbourhoods, aliases, referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import materialise


def find_entities(entities: DataFrame, tenant_id: str, *, normalized_name: str | None = None, entity_type: str | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
    """A page in order of id. The cursor is a pushed-down filter, so no page reads those before it."""
    if limit is not None and limit < 0:
        raise ValueError("limit is negative")
    for column, value in (("normalized_name", normalized_name), ("entity_type", entity_type)):
        if value is not None:
            entities = entities.filter(F.col(column) == value)
    if after is not None:
        entities = entities.filter(F.col("id") > after)
    page = entities.filter(F.col("tenant_id") == tenant_id).orderBy("id")
    return page if limit is None else page.limit(limit)


def get_entities(entities: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ``ids``; missing ids are silently absent, repeats count once."""
    return entities.join(ids.select(key), key, "left_semi")


def touching(edges: DataFrame, ids: DataFrame | None = None, one: str | None = None, *, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """Edges at one id or at any of a table of ids, each once."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no direction {direction!r}")
    if types is not None:
        edges = edges.filter(F.col("type").isin(types))
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    if one is not None:
        hit: Column = F.lit(False)
        for end in ends:
            hit = hit | (F.col(end) == one)
        return edges.filter(hit)
    at = ids.select(F.col("id").alias("at")).distinct()
    found = [edges.join(at, F.col(end) == F.col("at"), "left_semi") for end in ends]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1]).dropDuplicates(["id"])


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an endpoint outside the tenant's entities."""
    known = entities.select("id")
    lost = edges.join(known.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(known.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return lost.select(edges.columns).dropDuplicates(["id"])


def topology(edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges inside the tenant, and the dangling ones."""
    known = entities.select("id")
    whole = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return whole.select(edges.columns), dangling(edges, entities)


def require_endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``edges``, or an error that names one without its endpoint."""
    lost = dangling(edges, entities).select("id").first()
    if lost:
        raise LookupError(f"edge {lost[0]} has an endpoint that is no entity")
    return edges


def neighbors(edges: DataFrame, origins: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """origin, id, hops: everything within ``depth`` undirected hops of each origin, the origin itself left out."""
    if depth < 0:
        raise ValueError("depth is negative")
    if types is not None:
        edges = edges.filter(F.col("type").isin(types))
    # each side is joined as it is: edges both ways, made distinct, would be held twice over to find the few at a frontier
    ways = [edges.select(F.col(x).alias("from"), F.col(y).alias("dst")) for x, y in (("src", "dst"), ("dst", "src"))]
    seen = origins.select(F.col("id").alias("origin"), F.col("id"), F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        out, back = [frontier.join(w, F.col("id") == F.col("from")).select("origin", F.col("dst").alias("id")) for w in ways]
        step = out.unionByName(back).distinct()
        frontier = step.join(seen, ["origin", "id"], "left_anti").withColumn("hops", F.lit(hop))
        if hop < depth:
            frontier = materialise(frontier)
        seen = seen.unionByName(frontier)
    return seen.filter("hops > 0")


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """alias, canonical: every alias with the end of its chain; an id that is no alias stands for itself and has no row.

    Pointers jump twice as far each round, so the rounds grow with the logarithm of the longest chain, and every round is
    cut off from the one before. What still moves after enough rounds for the longest possible chain is a cycle: an error.
    """
    jumps = materialise(aliases.select("alias", "canonical"))
    for _ in range(jumps.count().bit_length() + 1):
        up = jumps.select(F.col("alias").alias("via"), F.col("canonical").alias("further"))
        new = materialise(jumps.join(up, F.col("canonical") == F.col("via"), "left").select("alias", F.coalesce("further", "canonical").alias("canonical"), F.col("further").isNotNull().alias("moved")))
        jumps = new.select("alias", "canonical")
        if new.filter("moved").isEmpty():
            return jumps
    raise LookupError("aliases form a cycle")


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def neighbour_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """id, names: the distinct normalized names around each entity, in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    named = both.join(entities.select(F.col("id").alias("dst"), "normalized_name"), "dst")
    return named.groupBy(F.col("src").alias("id")).agg(F.collect_set("normalized_name").alias("names"))


def passages(members: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The first passages that mention a group's members: group, chunk id, place. ``members``: group, entity_id, rank."""
    from pyspark.sql import Window

    mentions = chunks.select(F.col("id").alias("chunk_id"), "source_id", "chunk_index", F.explode("entity_ids").alias("entity_id"))
    order = F.struct("rank", "source_id", "chunk_index", "chunk_id")
    once = members.join(mentions, "entity_id").groupBy("group", "chunk_id").agg(F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("o"))
    return once.select("group", "chunk_id", place.alias("place")).filter(F.col("place") <= limit)
