"""Vector functions in double precision over array<float>, inside the JVM."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_score(a: Column, b: Column) -> Column:
    """(1 + cos) / 2 in 0..1; NULL where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, clamp((F.lit(1.0) + dot(a, b) / norm) / 2))


def has_zero_norm(a: Column) -> Column:
    """Every component's square is 0 in single precision."""
    return F.forall(a, lambda x: (x.cast("float") * x.cast("float")).cast("float") == F.lit(0.0).cast("float"))


def fake_embedding_of(text: str, dimension: int, prefix: str = "") -> list[float]:
    """A unit vector from a stream of SHA-256 bytes: the same for the same text, everywhere."""
    out: list[float] = []
    turn = 0
    while len(out) < dimension:
        out += [(b - 127.5) / 127.5 for b in hashlib.sha256(f"{turn}\0{prefix}{text}".encode()).digest()]
        turn += 1
    out = out[:dimension]
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out]


def fake_embedding(text: Column, dimension: int = 64, prefix: str = "") -> Column:
    """The deterministic stand-in of an embedding model; a model is an Arrow function of the same shape."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fake_embedding_of(x, dimension, prefix) for x in column.to_pylist()], pa.list_(pa.float32()))

    return run(text)


def entity_type_of(metadata: Column) -> Column:
    """The reserved key ``entity_type`` of metadata in JSON, if its value is a string; NULL otherwise."""
    value = F.try_variant_get(F.try_parse_json(metadata), "$.entity_type", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(metadata), "$.entity_type", "string"))
