"""Merkle fixity audit of web-archive files.

A file's records are the leaves (SHA-256 of the record's bytes), in order of their offsets. Each leaf has a ``seal``, the hash of its
offset, length and digest. A node covers a fixed range of offsets, ``RANGE`` bytes at the lowest level and ``fan_out`` times as
many a level further up, to one root a file; its seal is the hash of its children's seals in order. A record that is lost or
moved therefore changes the nodes whose ranges hold it and no others. Replicas are compared by seals from the roots down: a
level's nodes are looked at only below parents that differ, so equal files cost one comparison, and intact records at other
offsets or with other lengths differ too.

Rows: records with a NULL file, digest or offset, or one below 0, can't be placed and are reported apart (``unplaced``); repeated rows of one
file and offset count once, in order of their digest; a record that only one replica has is ``missing`` or ``extra``; pages of
any length are hashed whole, an empty or NULL one is a record with an empty body; equal replicas, and two empty ones, give no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise

FAN_OUT, RANGE = 16, 1 << 16
RECORDS_A_FILE = 500
_PLACED = "file is not null and offset >= 0 and digest is not null"


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A response record of the WARC 1.1 format: header block, the page, two line ends."""
    body = F.coalesce(F.encode(html, "UTF-8"), F.to_binary(F.lit(""), F.lit("utf-8")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archive(pages: DataFrame, records_a_file: int = RECORDS_A_FILE) -> DataFrame:
    """file, offset, length, digest, page_id: the pages as records of archive files, in order of page_id."""
    content = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    records = pages.select(F.floor(F.coalesce(F.col("page_id"), F.lit(-1)) / records_a_file).alias("file"), "page_id", F.octet_length(content).cast("long").alias("length"), F.sha2(content, 256).alias("digest"))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.select("file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest", "page_id")


def seals(records: DataFrame) -> DataFrame:
    """file, offset, length, digest, seal of the records that can be placed; repeated ones count once."""
    placed = records.filter(_PLACED).groupBy("file", "offset").agg(F.min(F.struct("digest", "length")).alias("r"))
    content = F.concat_ws("|", F.col("offset").cast("string"), F.coalesce(F.col("r.length").cast("string"), F.lit("-")), F.col("r.digest"))
    return placed.select("file", "offset", F.col("r.length").alias("length"), F.col("r.digest").alias("digest"), F.sha2(content, 256).alias("seal"))


def trees(primary: DataFrame, replica: DataFrame, fan_out: int = FAN_OUT, range_bytes: int = RANGE) -> list[DataFrame]:
    """The levels of both replicas' trees, leaves first. Leaves: file, at (offset), and ``mine`` and ``theirs``, structs of length,
    digest and seal. Nodes: file, at (number of the range), and their seals ``mine`` and ``theirs``; NULL where a replica has
    nothing there. The number of levels follows the largest offset; each is written once.
    """
    sides = seals(primary).withColumn("own", F.lit(True)).unionByName(seals(replica).withColumn("own", F.lit(False)))
    leaf = F.struct("length", "digest", "seal")
    level = sides.groupBy("file", F.col("offset").alias("at")).agg(F.first(F.when(F.col("own"), leaf), True).alias("mine"), F.first(F.when(~F.col("own"), leaf), True).alias("theirs"))
    levels = [materialise(level, "leaves")]
    high = levels[0].agg(F.max("at")).first()[0]
    width, of = range_bytes, "seal"
    while high is not None:
        parts = []
        for side in ("mine", "theirs"):
            own = F.col(f"{side}.seal") if of == "seal" else F.col(side)
            ordered = F.array_sort(F.collect_list(F.when(own.isNotNull(), F.struct("at", own.alias("seal")))))
            parts.append(F.when(F.size(ordered) > 0, F.sha2(F.array_join(F.transform(ordered, lambda x: x["seal"]), ""), 256)).alias(side))
        level = levels[-1].groupBy("file", F.floor(F.col("at") / width).alias("range")).agg(*parts).withColumnRenamed("range", "at")
        levels.append(materialise(level, "ranges"))
        high //= width
        width, of = fan_out, ""
        if high == 0:
            break
    return levels


def descend(levels: list[DataFrame], fan_out: int = FAN_OUT, range_bytes: int = RANGE) -> list[DataFrame]:
    """What differs on each level, roots first, leaves last: only rows below nodes that differ are compared."""
    found: list[DataFrame] = []
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if found:
            above = found[-1].select(F.col("file").alias("a_file"), F.col("at").alias("a_at"))
            level = level.join(above, (F.col("file") == F.col("a_file")) & (F.floor(F.col("at") / (fan_out if k else range_bytes)) == F.col("a_at")), "left_semi")
        found.append(level.filter(~F.col("mine").eqNullSafe(F.col("theirs"))))
    return found


def audit(primary: DataFrame, replica: DataFrame, fan_out: int = FAN_OUT, range_bytes: int = RANGE) -> DataFrame:
    """Where the replicas differ: file, offset, length, kind (corrupt, missing, extra, unplaced), primary and replica digest, and the
    file's primary and replica root (NULL where a replica lacks the file, and of unplaced records)."""
    levels = trees(primary, replica, fan_out, range_bytes)
    roots = levels[-1].filter("at = 0").select(F.col("file").alias("r_file"), F.col("mine").alias("primary_root"), F.col("theirs").alias("replica_root")) if len(levels) > 1 else None
    differing = descend(levels, fan_out, range_bytes)[-1]
    kind = F.when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("corrupt")
    columns = ["file", F.col("at").alias("offset"), F.coalesce("mine.length", "theirs.length").alias("length"), kind.alias("kind"), F.col("mine.digest").alias("primary_digest"), F.col("theirs.digest").alias("replica_digest")]
    if roots is None:
        found = differing.select(*columns, F.lit(None).cast("string").alias("primary_root"), F.lit(None).cast("string").alias("replica_root"))
    else:
        found = differing.join(roots, F.col("file") == F.col("r_file")).select(*columns, "primary_root", "replica_root")
    none = F.lit(None).cast("string")
    lost = [
        x.filter(f"not coalesce({_PLACED}, false)").select(
            "file", "offset", "length", F.lit("unplaced").alias("kind"), (F.col("digest") if own else none).alias("primary_digest"), (none if own else F.col("digest")).alias("replica_digest"),
            none.alias("primary_root"), none.alias("replica_root"),
        )
        for own, x in ((True, primary), (False, replica))
    ]
    return found.unionByName(lost[0]).unionByName(lost[1])
