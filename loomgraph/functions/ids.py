"""Deterministic ids: digests and name-based UUIDs (version 5), in the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of relationship and alias ids. Stores that already hold ids made under another namespace pass their own.
RELATIONSHIPS = str(uuid.uuid5(uuid.NAMESPACE_URL, "urn:loomgraph:relationship"))


def uuid5(namespace: Column, name: Column) -> Column:
    """RFC 9562 version 5 of a UUID in text form and a name."""
    digest = F.sha1(F.concat(F.unhex(F.regexp_replace(namespace, "-", "")), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def chunk_id(source_id: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.encode(source_id, "UTF-8"), F.lit(b"\0"), F.encode(text, "UTF-8")), 256)


def entity_id(tenant_id: Column, source_id: Column, entity_type: Column, normalized_name: Column) -> Column:
    return uuid5(uuid5(uuid5(tenant_id, source_id), entity_type), normalized_name)


def relationship_id(source: Column, target: Column, relationship_type: Column, namespace: str = RELATIONSHIPS) -> Column:
    return uuid5(uuid5(uuid5(F.lit(namespace), source), target), relationship_type)


def document_stream(tenant_id: Column, source_id: Column) -> Column:
    """The stream of one document; NULL for a blank source, which has none."""
    return F.when(F.trim(source_id) != "", uuid5(tenant_id, source_id))


def consolidation_stream(tenant_id: Column) -> Column:
    return tenant_id


def alias_id(tenant_id: Column, alias_entity_id: Column, prefix: str = "alias") -> Column:
    return uuid5(F.lit(str(uuid.NAMESPACE_OID)), F.concat(F.lit(prefix + ":"), tenant_id, F.lit(":"), alias_entity_id))
