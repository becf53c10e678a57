"""Merkle fingerprints of documents.

Leaves are the hashes of the paragraphs (lines with more than white space, as they stand), the level above holds
sections, and the root covers the sections in order. A section ends before a blank line, and after a paragraph whose hash
begins with 0 or 1: such ends depend on the paragraph alone, so an insertion changes the sections around it and no others.
Hashes are the first 32 hexadecimal digits of SHA-256, with another prefix for each level. Equal roots mean equal
paragraphs and sections; where roots differ, only sections that differ are opened to find the edited paragraphs.

Rows: a NULL text has a NULL fingerprint and equals nothing; an empty or blank one has no sections and the root of the
empty list; repeated rows have equal fingerprints; very long texts are read whole, and compared in time linear in their
paragraphs; rows without a doc_id have a root, but are nobody's base and have none; rows that share a doc_id are compared each by
its own text, never with each other; further columns of any name pass through ``fingerprint``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import materialise

FINGERPRINT = T.StructType([
    T.StructField("root", T.StringType()),
    T.StructField("sections", T.ArrayType(T.StringType(), False)),
    T.StructField("paragraphs", T.ArrayType(T.StringType(), False)),
    T.StructField("section_of", T.ArrayType(T.IntegerType(), False)),
])


def _hash(level: str, content: str) -> str:
    return hashlib.sha256((level + content).encode("utf-8")).hexdigest()[:32]


def tree(text: str | None) -> dict | None:
    """root; section hashes; paragraph hashes; the section number of each paragraph."""
    if text is None:
        return None
    paragraphs: list[str] = []
    section_of: list[int] = []
    sections: list[list[str]] = []
    opened = False
    for line in text.split("\n"):
        if not line.strip():
            opened = False
            continue
        leaf = _hash("P", line)
        if not opened:
            sections.append([])
            opened = True
        sections[-1].append(leaf)
        paragraphs.append(leaf)
        section_of.append(len(sections) - 1)
        if leaf[0] in "01":
            opened = False
    hashes = [_hash("S", "".join(leaves)) for leaves in sections]
    return {"root": _hash("R", "".join(hashes)), "sections": hashes, "paragraphs": paragraphs, "section_of": section_of}


def fingerprint(text: Column) -> Column:
    arrow = pa.struct([("root", pa.string()), ("sections", pa.list_(pa.string())), ("paragraphs", pa.list_(pa.string())), ("section_of", pa.list_(pa.int32()))])

    @F.arrow_udf(FINGERPRINT)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([tree(x.as_py()) for x in column], arrow)

    return run(text)


def edited(own: dict, base: dict) -> list[int]:
    """Numbers of the paragraphs of ``own`` that lie in sections ``base`` lacks and whose hash no opened section of ``base`` has:
    the sections that both trees have aren't opened. Linear in the paragraphs of both."""
    here, there = set(own["sections"]), set(base["sections"])
    leaves = {p for p, s in zip(base["paragraphs"], base["section_of"]) if base["sections"][s] not in here}
    return [i for i, (p, s) in enumerate(zip(own["paragraphs"], own["section_of"])) if own["sections"][s] not in there and p not in leaves]


def edited_paragraphs(fp: Column, base: Column) -> Column:
    """array<int> of ``edited``; NULL where a fingerprint is."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def run(own: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([edited(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(own, other)], pa.list_(pa.int32()))

    return run(fp, base)


def compare_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, root, sections, paragraphs of every row; equal_to, base, edited.

    equal_to: the smallest other doc_id with this root, if smaller than doc_id. base: of the documents with another root that
    are the first to hold one of this document's distinct sections or paragraphs, the one that holds most of them first (ties:
    smallest doc_id); edited: the numbers of the paragraphs that differ from it. NULL where there is no base. A paragraph that
    many documents share has one first holder like any other, so pairs stay linear in the paragraphs.
    """
    prints = materialise(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    owner = prints.groupBy("fp.root").agg(F.min("doc_id").alias("first"))
    parts = prints.filter("doc_id is not null").select(
        "doc_id", F.col("fp.root").alias("root"), F.explode(F.array_distinct(F.transform(F.concat("fp.sections", "fp.paragraphs"), lambda h: F.xxhash64(h)))).alias("part")
    )
    holders = parts.groupBy("part").agg(F.min(F.struct("doc_id", "root")).alias("holder"))
    shared = parts.join(holders, "part").filter("holder.doc_id < doc_id and holder.root <> root").groupBy("doc_id", F.col("root"), F.col("holder.doc_id").alias("base"), F.col("holder.root").alias("base_root")).agg(F.count("*").alias("n"))
    best = shared.groupBy("doc_id", "root").agg(F.min_by(F.struct("base", "base_root"), F.struct((-F.col("n")).alias("n"), F.col("base"), F.col("base_root"))).alias("b"))
    one = prints.filter("doc_id is not null").groupBy("doc_id", F.col("fp.root").alias("root")).agg(F.first("fp").alias("fp"))
    pairs = best.join(one.withColumnRenamed("fp", "own"), ["doc_id", "root"])
    pairs = pairs.join(one.select(F.col("doc_id").alias("base_id"), F.col("root").alias("base_of"), F.col("fp").alias("other")), (F.col("b.base") == F.col("base_id")) & (F.col("b.base_root") == F.col("base_of")))
    edits = pairs.select(F.col("doc_id").alias("e_doc"), F.col("root").alias("e_root"), F.col("b.base").alias("base"), edited_paragraphs(F.col("own"), F.col("other")).alias("edited"))
    rows = prints.select("doc_id", F.col("fp.root").alias("root"), F.size("fp.sections").alias("sections"), F.size("fp.paragraphs").alias("paragraphs"))
    rows = rows.join(owner.withColumnRenamed("root", "o_root"), F.col("root") == F.col("o_root"), "left")
    rows = rows.join(edits, (F.col("doc_id") == F.col("e_doc")) & (F.col("root") == F.col("e_root")), "left")
    return rows.select("doc_id", "root", F.when(F.col("root").isNotNull(), F.col("sections")).alias("sections"), F.when(F.col("root").isNotNull(), F.col("paragraphs")).alias("paragraphs"), F.when(F.col("first") < F.col("doc_id"), F.col("first")).alias("equal_to"), "base", "edited")


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), marked AS (
  SELECT *, NOT regexp_matches(line, '\\S') AS blank, left(sha256('P' || line), 32) AS leaf FROM lines
), cut AS (
  SELECT *, coalesce(lag(blank OR leaf[1] IN ('0', '1')) OVER (PARTITION BY doc_id ORDER BY pos), false) AS fresh FROM marked
), grouped AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM cut
), leaves AS (
  SELECT doc_id, leaf, dense_rank() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS sec,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM grouped WHERE NOT blank
), secs AS (
  SELECT doc_id, sec, left(sha256('S' || string_agg(leaf, '' ORDER BY i)), 32) AS section FROM leaves GROUP BY doc_id, sec
), roots AS (
  SELECT d.doc_id, left(sha256('R' || coalesce(string_agg(s.section, '' ORDER BY s.sec), '')), 32) AS root, count(s.sec) AS sections,
    (SELECT count(*) FROM leaves l WHERE l.doc_id = d.doc_id) AS paragraphs
  FROM documents d LEFT JOIN secs s USING (doc_id) GROUP BY d.doc_id
), owner AS (SELECT root, min(doc_id) AS first FROM roots GROUP BY root),
parts AS (SELECT doc_id, section AS part FROM secs UNION SELECT doc_id, leaf FROM leaves),
holders AS (SELECT part, min(doc_id) AS holder FROM parts GROUP BY part),
shared AS (
  SELECT s.doc_id, h.holder, count(*) AS n
  FROM parts s JOIN holders h USING (part) JOIN roots a ON a.doc_id = s.doc_id JOIN roots b ON b.doc_id = h.holder
  WHERE h.holder < s.doc_id AND a.root <> b.root GROUP BY 1, 2
), best AS (
  SELECT doc_id, holder AS base FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, holder) AS k FROM shared) WHERE k = 1
), edits AS (
  SELECT b.doc_id, b.base, (
    SELECT list(CAST(l.i AS INTEGER) ORDER BY l.i) FROM leaves l JOIN secs s ON s.doc_id = l.doc_id AND s.sec = l.sec
    WHERE l.doc_id = b.doc_id
      AND NOT EXISTS (SELECT 1 FROM secs o WHERE o.doc_id = b.base AND o.section = s.section)
      AND NOT EXISTS (
        SELECT 1 FROM leaves m JOIN secs t ON t.doc_id = m.doc_id AND t.sec = m.sec WHERE m.doc_id = b.base AND m.leaf = l.leaf
          AND NOT EXISTS (SELECT 1 FROM secs u WHERE u.doc_id = b.doc_id AND u.section = t.section))
  ) AS edited FROM best b
)
SELECT r.doc_id, r.root, CAST(r.sections AS INTEGER) AS sections, CAST(r.paragraphs AS INTEGER) AS paragraphs,
  CASE WHEN o.first < r.doc_id THEN o.first END AS equal_to, e.base, CASE WHEN e.base IS NOT NULL THEN coalesce(e.edited, []) END AS edited
FROM roots r JOIN owner o USING (root) LEFT JOIN edits e USING (doc_id)
"""
