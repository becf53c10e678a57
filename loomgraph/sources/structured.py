"""Entities stated in pages: JSON-LD items and Open Graph properties."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS: dict[str, str] = {
    name: kind
    for kind, names in {
        "person": "Person Author",
        "organization": "Organization Corporation Company NGO LocalBusiness SportsOrganization GovernmentOrganization EducationalOrganization",
        "location": "Place City Country Landmark AdministrativeArea PostalAddress GeoCoordinates",
        "event": "Event Festival Hackathon CourseInstance " + " ".join(f"{x}Event" for x in "Sports Music Social Food Sale Dance Comedy Literary Theater Business Delivery Education Screening Exhibition Publication VisualArts Childrens".split()),
        "product": "Product ProductModel IndividualProduct Book Movie MusicAlbum VideoGame " + " ".join(f"{x}Application" for x in "Software Mobile Web".split()),
        "document": "CreativeWork WebPage BlogPosting Report " + " ".join(f"{x}Article" for x in ("", "News", "Tech", "Scholarly")),
        "date": "Date DateTime",
        "concept": "Thing Intangible",
    }.items()
    for name in names.split()
}
NAMES = ("name", "headline", "title", "alternateName", "legalName")
NESTED = frozenset("about mentions sponsor funder performer organizer author creator publisher brand worksFor memberOf location address".split())
KEPT = frozenset(
    "url image logo email telephone address location geo author creator publisher brand worksFor memberOf jobTitle category genre keywords price priceCurrency offers review ratingValue aggregateRating".split()
) | {f"date{x}" for x in ("Published", "Created", "Modified")} | {f"{x}Date" for x in ("start", "end")}
ENTITY = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("properties", T.StringType()),
    T.StructField("external_ids", T.StringType()), T.StructField("method", T.StringType()), T.StructField("confidence", T.DoubleType()),
])


def _first(value: Any) -> Any:
    return (value[0] if value else None) if isinstance(value, list) else value


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True)


def _name(item: dict) -> str | None:
    for field in NAMES:
        if item.get(field):
            return str(_first(item[field]))
    return " ".join(p for p in (item.get("givenName"), item.get("familyName")) if p).strip() or None


def _flat(value: Any) -> Any:
    if isinstance(value, dict):
        return next((value[k] for k in ("name", "@value", "url") if value.get(k)), value)
    return value


def _entity(item: dict) -> dict | None:
    kind, name = _first(item.get("@type")), _name(item)
    if not kind or not name:
        return None
    ids = {"schema_org_id": item["@id"]} if item.get("@id") else {}
    if item.get("sameAs"):
        ids["same_as"] = [item["sameAs"]] if isinstance(item["sameAs"], str) else item["sameAs"]
    kept = {k: _flat(v) for k, v in item.items() if k in KEPT and v}
    return {"type": KINDS.get(kind, "concept"), "name": name, "description": _text(_first(item.get("description"))), "properties": json.dumps(kept, sort_keys=True), "external_ids": json.dumps(ids, sort_keys=True), "method": "schema_org", "confidence": 0.95}


def json_ld_entities(text: str | None) -> list[dict]:
    """Of an item or a list of items, each with the typed items one level inside it. Broken JSON gives none."""
    try:
        items = json.loads(text) if text else []
    except ValueError:
        return []
    out = []
    for item in items if isinstance(items, list) else [items]:
        if isinstance(item, dict):
            inner = [x for field in item if field in NESTED for x in (item[field] if isinstance(item[field], list) else [item[field]]) if isinstance(x, dict)]
            out += [e for e in map(_entity, [item, *inner]) if e]
    return out


def json_ld(text: Column) -> Column:
    """array<struct> of the entities in a JSON-LD text."""

    @F.arrow_udf(T.ArrayType(ENTITY))
    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(f.name, pa.float64() if f.name == "confidence" else pa.string()) for f in ENTITY]))
        return pa.array([json_ld_entities(x) for x in column.to_pylist()], kind)

    return run(text)


def og_kind(og_type: Column) -> Column:
    low = F.lower(og_type)
    return (
        F.when(low.isin("website", "article", "blog", "music.song", "music.playlist", "video.episode"), "document")
        .when(low == "profile", "person").when(low.isin("product", "book", "music.album", "video.movie"), "product")
        .when(low.isin("place", "business.business"), "location").otherwise("concept")
    )


def open_graph(og: Column) -> Column:
    """struct of the entity of a map of Open Graph properties (without their ``og:``); NULL without a title. JVM only."""
    kind = F.coalesce(og["type"], F.lit("website"))
    pairs = {"url": "url", "image": "image", "site_name": "site_name", "locale": "locale"}
    more = {"published_time": "article:published_time", "author": "article:author", "section": "article:section"}
    price = {"price_amount": "product:price:amount", "price_currency": "product:price:currency"}

    def put(names: dict[str, str], when: Column | None) -> list[Column]:
        return [F.struct(F.lit(k).alias("key"), (og[v] if when is None else F.when(when, og[v])).alias("value")) for k, v in names.items()]

    entries = F.array(*put(pairs, None), *put(more, kind.startswith("article")), *put(price, kind.startswith("product")))
    properties = F.to_json(F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))
    return F.when(F.coalesce(og["title"], F.lit("")) != "", F.struct(
        og_kind(kind).alias("type"), og["title"].alias("name"), og["description"].alias("description"), properties.alias("properties"),
        F.lit("{}").alias("external_ids"), F.lit("open_graph").alias("method"), F.lit(0.8).alias("confidence"),
    ))


_META = r"(?i)<meta(?:\s+[^\s=>\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*\s*/?>"
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"


def _attribute(tag: Column, names: str) -> Column:
    """The value of the first of these attributes of a tag, in whatever quotes; NULL without it."""
    pattern = rf"(?i)\s(?:{names}){_VALUE}"
    return F.when(tag.rlike(pattern), F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))


def open_graph_of(html: Column) -> Column:
    """map of a page's Open Graph properties, ``og:`` left out: the attributes of each meta tag in any order, the first of a name."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(_META), F.lit(0)), lambda t: F.struct(F.lower(_attribute(t, "property|name")).alias("key"), _attribute(t, "content").alias("value")))
    own = F.transform(F.filter(tags, lambda t: t["key"].rlike("^(?:og|article|product):") & t["value"].isNotNull()), lambda t: F.struct(F.regexp_replace(t["key"], "^og:", "").alias("key"), t["value"].alias("value")))
    names = F.transform(own, lambda t: t["key"])
    return F.map_from_entries(F.filter(own, lambda t, i: F.array_position(names, t["key"]) == i + 1))


_SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def page_entities(pages: DataFrame) -> DataFrame:
    """page_id and the fields of every entity that a page states in JSON-LD or Open Graph."""
    stated = F.flatten(F.transform(F.regexp_extract_all("html", F.lit(_SCRIPT), 1), lambda s: F.array(s)))
    texts = pages.select("page_id", F.explode(stated).alias("ld")).select("page_id", F.inline(json_ld(F.col("ld"))))
    og = pages.filter(F.col("html").rlike("(?i)og:title")).select("page_id", open_graph_of(F.col("html")).alias("og"))
    graph = og.select("page_id", open_graph(F.col("og")).alias("e")).filter("e is not null").select("page_id", "e.*")
    return texts.unionByName(graph)
