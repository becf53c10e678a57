"""Lines that occur in too many documents.

Lines are normalised (lower case, runs of blanks to one space, trimmed), hashed to 96 bits and exploded with their document and
position, once: the written table of (document, position, hash) gives the counts, then the positions to drop. Lines in more than
``max_documents`` distinct documents are dropped everywhere, and the rest is put together again by position. Blanks are
space, tab, carriage return, vertical tab, form feed and the no-break space.

Rows: blank lines are kept and never counted; NULL text stays NULL; a document left without lines has the empty text;
rows with one doc_id count as one document, all rows without a doc_id as one more; a line many times in one document
counts once, and so do repeated rows, which all lose the same; a line in exactly ``max_documents`` documents stays; texts of any
length are handled whole, in time linear in their length; further columns of any name pass through, but for one called
``lines_dropped``, which is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise

MAX_DOCUMENTS = 10

#: Runs of blanks that aren't a single space; line feeds never belong to one.
_RUN = r"[\t\r\x0B\f ][ \t\r\x0B\f ]*| [ \t\r\x0B\f ]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, at, a, b: the hash (a, b) of every line that isn't blank, and its position. Each line is normalised once."""
    plain = F.regexp_replace(F.lower(F.col("text")), _RUN, " ")
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(plain)).alias("at", "line"))
    trimmed = lines.select("doc_id", "text_hash", "at", F.trim("line").alias("line")).filter("line <> ''")
    return trimmed.select("doc_id", "text_hash", "at", F.xxhash64("line").alias("a"), F.hash("line").alias("b"))


def frequent_lines(keys: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """a, b: the hash of each line in more than ``max_documents`` documents; documents: in how many."""
    documents = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    return keys.groupBy("a", "b").agg(documents.alias("documents")).filter(F.col("documents") > max_documents)


def drop_frequent_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``docs`` without the frequent lines, and how many each lost (``lines_dropped``).

    The keys, the frequent ones and then each document's positions are written tables of known size: they are broadcast below
    the session's threshold and shuffled beyond it.
    """
    keys = materialise(line_keys(docs), "line-keys")
    frequent = materialise(frequent_lines(keys, max_documents).select("a", "b"), "frequent-lines")
    hits = keys.join(frequent, ["a", "b"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("bad"))
    hits = materialise(hits, "line-hits")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(row, F.xxhash64("text").alias("text_hash")).alias("d").join(
        hits.hint("shuffle_hash").alias("h"), F.col("d.row.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash")), "left"
    )
    text, bad = F.col("d.row.text"), F.col("h.bad")
    lines = _lines(text)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), bad), lambda at: F.get(lines, at))
    dropped = F.when(bad.isNull() | text.isNull(), 0).otherwise(F.size(bad))
    return joined.select(
        *[F.col(f"d.row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "lines_dropped")],
        F.when(dropped == 0, text).when(F.size(bad) == F.size(lines), "").otherwise(F.array_join(kept, "\n")).alias("text"),
        dropped.alias("lines_dropped"),
    )


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, trim(regexp_replace(lower(line), '[ \\t\\r\\v\\f\\x{{00A0}}]+', ' ', 'g')) AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) > {MAX_DOCUMENTS}
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM frequent)), '') AS text,
    count(*) FILTER (WHERE k IN (SELECT k FROM frequent)) AS lines_dropped
  FROM keyed GROUP BY doc_id
)
SELECT doc_id, text, CAST(lines_dropped AS INTEGER) AS lines_dropped FROM rebuilt
"""
