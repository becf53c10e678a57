"""Domain vocabularies: entity and relationship types, loaded from YAML, validated, and applied as small tables."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXEMPT = "related_to"


def type_id(value: str) -> str:
    return re.sub("_+", "_", re.sub(r"[\s-]+", "_", value.strip().lower())).strip("_")


def validate(raw: Any, name: str = "domain") -> dict:
    """The vocabulary in normal form, or an error that says what is wrong with it."""
    if not isinstance(raw, dict):
        raise ValueError(f"{name}: not a mapping")
    for field in ("domain_id", "display_name", "entity_types", "relationship_types"):
        if field not in raw:
            raise ValueError(f"{name}: {field} is missing")
    out = {**raw, "domain_id": type_id(str(raw["domain_id"])), "version": str(raw.get("version", "1.0.0"))}
    if not re.fullmatch(r"\d+\.\d+\.\d+", out["version"]):
        raise ValueError(f"{name}: version {out['version']!r} isn't of the form 1.2.3")
    for kind in ("entity_types", "relationship_types"):
        out[kind] = [{**t, "id": type_id(str(t["id"]))} for t in raw[kind]]
        ids = [t["id"] for t in out[kind]]
        if not all(i.isidentifier() for i in ids) or len(set(ids)) < len(ids):
            raise ValueError(f"{name}: {kind} holds a bad or repeated id")
    known = {t["id"] for t in out["entity_types"]}
    for t in out["relationship_types"]:
        for end in ("valid_source_types", "valid_target_types"):
            t[end] = [type_id(x) for x in t.get(end) or []]
            if not set(t[end]) <= known:
                raise ValueError(f"{name}: {t['id']} names an entity type that isn't declared")
    return out


def load_text(content: str, name: str = "domain") -> dict:
    import yaml

    try:
        return validate(yaml.safe_load(content), name)
    except yaml.YAMLError as e:
        raise ValueError(f"{name}: {e}") from e


def load_file(path: str | Path) -> dict:
    return load_text(Path(path).read_text(encoding="utf-8"), str(path))


def load_all(folder: str | Path, *, ignore_errors: bool = False) -> dict[str, dict]:
    """By domain id, from every ``.yaml`` file."""
    found: dict[str, dict] = {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        try:
            schema = load_file(path)
        except ValueError:
            if not ignore_errors:
                raise
            continue
        found[schema["domain_id"]] = schema
    return found


def check_file(path: str | Path) -> tuple[bool, str | None]:
    try:
        load_file(path)
    except (ValueError, OSError) as e:
        return False, str(e)
    return True, None


def get(schemas: dict[str, dict], domain_id: str) -> dict:
    return schemas[type_id(domain_id)]


def summaries(schemas: dict[str, dict]) -> list[dict]:
    """In order of the display names."""
    listed = [
        {"domain_id": s["domain_id"], "display_name": s["display_name"], "entity_types": [t["id"] for t in s["entity_types"]], "relationship_types": [t["id"] for t in s["relationship_types"]], "entity_type_count": len(s["entity_types"]), "relationship_type_count": len(s["relationship_types"])}
        for s in schemas.values()
    ]
    return sorted(listed, key=lambda s: s["display_name"])


def with_entity_type(schemas: dict[str, dict], entity_type: str) -> list[dict]:
    return [s for s in schemas.values() if type_id(entity_type) in {t["id"] for t in s["entity_types"]}]


def permitted_types(schema: dict, kind: str = "entity_types") -> tuple[str, ...]:
    return tuple(t["id"] for t in schema[kind])


def system_prompt(schema: dict) -> str:
    lines = [f"Extract entities and relationships of the domain {schema['display_name']}.", "Entity types:"]
    lines += [f"- {t['id']}: {t.get('description', '')}".rstrip(": ") for t in schema["entity_types"]]
    lines += ["Relationship types:", *[f"- {t['id']} ({', '.join(t['valid_source_types']) or 'any'} -> {', '.join(t['valid_target_types']) or 'any'})" for t in schema["relationship_types"]]]
    return "\n".join(lines)


def type_table(spark: SparkSession, schema: dict) -> DataFrame:
    """relationship_type, sources, targets: as many rows as the vocabulary has relationship types."""
    rows = [(t["id"], t["valid_source_types"], t["valid_target_types"]) for t in schema["relationship_types"]]
    return spark.createDataFrame(rows, "relationship_type string, sources array<string>, targets array<string>")


def validate_edges(edges: DataFrame, types: DataFrame) -> DataFrame:
    """``edges`` (type, source_type, target_type) with ``problem``: unknown_type, bad_source, bad_target, or NULL."""
    known = edges.join(F.broadcast(types), edges["type"] == types["relationship_type"], "left")
    fits = lambda allowed, kind: (F.size(allowed) == 0) | F.array_contains(allowed, F.col(kind))
    problem = (
        F.when(F.col("type") == EXEMPT, None).when(F.col("relationship_type").isNull(), "unknown_type")
        .when(~fits(F.col("sources"), "source_type"), "bad_source").when(~fits(F.col("targets"), "target_type"), "bad_target")
    )
    return known.withColumn("problem", problem.cast("string")).drop("relationship_type", "sources", "targets")
