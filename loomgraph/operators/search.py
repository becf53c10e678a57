"""Exact vector search, rank fusion, and the entity and passage retrievers built of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.similarity import lexical_score
from loomgraph.functions.text import normalize_name, query_keys
from loomgraph.functions.vectors import cosine_score, has_zero_norm
from loomgraph.operators import lexical
from loomgraph.operators.ranking import placed

RRF_K, OVERFETCH = 60, 3
MODES = ("hybrid", "semantic", "lexical")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])


def knn(vectors: DataFrame, query: list[float], k: int | None, *, tenant_id=None, types: list[str] | None = None, min_score: float | None = None, vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``score``, best first, ties by id. Every filter comes before the cut; one scan and a bounded sort."""
    if tenant_id is not None:
        vectors = vectors.filter(F.col("tenant_id") == tenant_id)
    if types is not None:
        vectors = vectors.filter(F.col("entity_type").isin(types))
    scored = vectors.filter(F.col(vector).isNotNull()).withColumn("score", cosine_score(F.col(vector), literal(query)))
    scored = scored.filter(F.col("score") >= min_score) if min_score is not None else scored.filter("score is not null")
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def reject_zero_norm(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vectors``, or an error that names one without a direction."""
    bad = vectors.filter(has_zero_norm(F.col(vector))).select("id").first()
    if bad:
        raise ValueError(f"vector {bad[0]} has zero norm")
    return vectors


def fuse(rankings: dict[str, DataFrame], k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """id, score, and the score of each channel (NULL where it didn't rank the row). Ranks alone count, first is 1."""
    parts = []
    for name, ranking in rankings.items():
        first = ranking.groupBy("id").agg(F.max("score").alias("score"))
        parts.append(placed(first, F.desc("score"), "id").select("id", F.lit(name).alias("channel"), "score", "place"))
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    own = [F.max(F.when(F.col("channel") == n, F.col("score"))).alias(f"{n}_score") for n in rankings]
    fused = joined.groupBy("id").agg(F.sum(1.0 / (F.lit(constant) + F.col("place"))).alias("score"), *own)
    return fused if k is None else fused.orderBy(F.desc("score"), "id").limit(k)


def lexical_entities(entities: DataFrame, query: str, k: int | None, *, types: list[str] | None = None, properties: list[str] = ()) -> DataFrame:
    """id, score of the entities that share a blocking key with the query. Entities bring ``blocking_keys``."""
    if types is not None:
        entities = entities.filter(F.col("entity_type").isin(types))
    q = F.lit(query)
    block = entities.filter(F.arrays_overlap("blocking_keys", query_keys(q)))
    scored = block.select("id", lexical_score(q, F.col("name"), normalize_name(F.col("name")), [F.col(p) for p in properties]).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def _checked(query: str, k: int, mode: str, channels: dict) -> list[str]:
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}")
    if not query.strip():
        raise ValueError("the query is blank")
    if k < 1:
        raise ValueError("k must be positive")
    wanted = ["semantic", "lexical"] if mode == "hybrid" else [mode]
    for w in wanted:
        if channels[w] is None:
            raise ValueError(f"{w} search needs its table")
    return wanted


def retrieve(query: str, k: int, *, entities: DataFrame, vectors: DataFrame | None = None, embed=None, mode: str = "hybrid", types: list[str] | None = None, overfetch: int = OVERFETCH) -> DataFrame:
    """The fused entities, hydrated after the cut: a match without an entity is dropped and not replaced."""
    wanted = _checked(query, k, mode, {"semantic": vectors if embed else None, "lexical": entities})
    depth, found = k * overfetch, {}
    if "semantic" in wanted:
        found["semantic"] = knn(vectors, embed(query), depth, types=types).select("id", "score")
    if "lexical" in wanted:
        found["lexical"] = lexical_entities(entities, query, depth, types=types)
    return fuse(found, k).join(entities.drop("blocking_keys"), "id")


def retrieve_chunks(terms: list[str], query: str, k: int, *, chunks: DataFrame, embed=None, mode: str = "hybrid", overfetch: int = OVERFETCH, min_score: float | None = None) -> DataFrame:
    """The fused passages. ``chunks`` bring ``embedding`` for the semantic channel; ``lexical`` mode needs none."""
    wanted = _checked(query, k, mode, {"semantic": chunks if embed else None, "lexical": chunks})
    depth, found = k * overfetch, {}
    if "semantic" in wanted:
        found["semantic"] = knn(chunks, embed(query), depth, min_score=min_score).select("id", "score")
    if "lexical" in wanted:
        found["lexical"] = lexical.rank(chunks, terms, depth).select("id", "score")
    return fuse(found, k)
