"""Repeated passages, found as runs of consecutive sentences.

A text is cut into sentences; every run of ``run`` consecutive sentences, and of as many more as it takes to have ``min_words``
words, is hashed; runs are joined on their hash over the whole corpus; the first occurrence (smallest doc_id, then position)
stays and every sentence that a later occurrence covers is removed. Sentences end at ``. ! ?`` or a line break. One of more
than ``LONG`` words is divided at commas, semicolons and colons, and what is still longer after the words with the smallest hash
of any ``WINDOW`` neighbours, so at least every ``WINDOW`` words: those cuts depend on the words around them alone, so a passage
pasted into the middle of a sentence is cut the same everywhere. At either end at most ``LONG`` words of it are cut otherwise;
the 27 or more that are left of over 50 are at least three sentences, so any such repeat has a run in common with the first.
Case, punctuation and white space don't count. Hashes have 64 bits: of 10^12 runs about one in 10^7 meets
another by chance.

Rows: NULL and empty texts come back as they are; rows equal in doc_id and text are one document (both keep or lose the
same); rows with one doc_id but different texts are different documents, ordered by a hash of the text; NULL doc_id sorts
first; a repeat within one document counts too; texts of any length are cut whole; further columns of any name pass through ``remove_repeats``, but for one called
``sentences_removed``, which is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import materialise

RUN, MIN_WORDS, LONG, WINDOW = 3, 12, 12, 8

_word = re.compile(r"([^\W_]+)([\W_]*)")
_end = re.compile(r"[.!?\n]")
_pause = re.compile(r"[,;:]")


def _anchors(words: list[str]) -> set[int]:
    """Places of the words with the smallest hash (the first of equal ones) of each ``WINDOW`` consecutive words."""
    hashes = [zlib.crc32(w.encode("utf-8")) * 0x9E3779B1 & 0xFFFFFFFF for w in words]
    found = set()
    best = -1
    for end in range(WINDOW - 1, len(hashes)):
        start = end - WINDOW + 1
        if best < start:
            best = min(range(start, end + 1), key=hashes.__getitem__)
        elif hashes[end] < hashes[best]:
            best = end
        found.add(best)
    return found


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence with a word; a span reaches to the next sentence's first word."""
    first = _word.search(text)
    if first is None:
        return []
    found: list[tuple[int, int, list[str]]] = []
    at = first.start()
    ends = _end.search

    def close(part: list[tuple[str, str]]) -> None:
        nonlocal at
        start = at
        for word, gap in part:
            at += len(word) + len(gap)
        found.append((start, at, [word.lower() for word, _ in part]))

    def divide(part: list[tuple[str, str]], by: int) -> None:
        if len(part) <= LONG or by == 2:
            close(part)
            return
        piece: list[tuple[str, str]] = []
        anchors = _anchors([word.lower() for word, _ in part]) if by else ()
        for k, pair in enumerate(part):
            piece.append(pair)
            if (_pause.search(pair[1]) is not None) if by == 0 else k in anchors:
                divide(piece, by + 1)
                piece = []
        if piece:
            divide(piece, by + 1)

    current: list[tuple[str, str]] = []
    for pair in _word.findall(text):
        current.append(pair)
        if pair[1] != " " and ends(pair[1]) is not None:
            divide(current, 0)
            current = []
    if current:
        divide(current, 0)
    return found


def runs(text: str | None, run: int, min_words: int) -> tuple[list[int], list[int], list[int]]:
    """64-bit hashes of the runs, the number of each one's first sentence, and how many it has: ``run``, or more where those
    have fewer than ``min_words`` words."""
    units = sentences(text) if text else []
    hashes, at, lengths = [], [], []
    keys = [" ".join(u[2]) for u in units]
    total = np.cumsum([0, *(len(u[2]) for u in units)])
    ends = np.searchsorted(total, total[:-1] + min_words).tolist()
    for k in range(len(units) - run + 1):
        end = max(k + run, ends[k])
        if end <= len(units):
            hashes.append(xxhash.xxh3_64_intdigest("\n".join(keys[k:end])) - (1 << 63))
            at.append(k)
            lengths.append(end - k)
    return hashes, at, lengths


def run_hashes(text: str | None, run: int, min_words: int) -> tuple[list[int], list[int]]:
    """64-bit hashes of the runs, and the number of each one's first sentence."""
    return runs(text, run, min_words)[:2]


def _runs(text: Column, run: int, min_words: int) -> Column:
    item = pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType())])))
    def run_udf(column: pa.Array) -> pa.Array:
        done = [runs(x.as_py(), run, min_words) for x in column]
        offsets = pa.array(np.cumsum([0, *(len(h) for h, _, _ in done)]), pa.int32())
        values = pa.StructArray.from_arrays([pa.array([x for d in done for x in d[k]], f.type) for k, f in enumerate(item)], fields=list(item))
        return pa.ListArray.from_arrays(offsets, values)

    return run_udf(text)


def _without(text: Column, covered: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for t, d in zip(texts.to_pylist(), drops.to_pylist()):
            if t and d:
                units = sentences(t)
                kept = [t[: units[0][0]]]
                gone = set(d)
                kept += [t[a:b] for k, (a, b, _) in enumerate(units) if k not in gone]
                t = "".join(kept)
            out.append(t)
        return pa.array(out, pa.string())

    return cut(text, covered)


def covered_sentences(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, covered: numbers of the sentences in runs that occurred before. Only documents with any.

    The runs are written and counted by hash, which combines before the shuffle; only those of repeated hashes are looked at
    again, and the smallest of each hash combines before the shuffle too, so a run in a third of all documents is no single task.
    """
    found = materialise(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(_runs(F.col("text"), run, min_words))), "runs")
    hot = materialise(found.groupBy("hash").count().filter("count > 1").select("hash"), "repeated-hashes")
    repeated = materialise(found.join(hot, "hash", "left_semi"), "repeated-runs")
    place = F.struct("doc_id", "text_hash", "at")
    first = repeated.groupBy("hash").agg(F.min(place).alias("first")).withColumnRenamed("hash", "f_hash")
    later = repeated.join(first, repeated["hash"] == first["f_hash"]).filter(~place.eqNullSafe(F.col("first")))
    return (
        later.groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("at", "n")).alias("starts"))
        .select("doc_id", "text_hash", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))).alias("covered"))
    )


def remove_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated sentences cut from ``text``, and how many (``sentences_removed``)."""
    hits = materialise(covered_sentences(docs.select("doc_id", "text"), run, min_words), "covered")
    names = [c for c in docs.columns if c not in ("text", "sentences_removed")]
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("text_hash")).alias("d").join(
        hits.hint("shuffle_hash").alias("h"), F.col("d.row.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash")), "left"
    )
    return joined.select(
        *[F.col(f"d.row.`{c}`").alias(c) for c in names],
        _without(F.col("d.row.text"), F.col("h.covered")).alias("text"),
        F.coalesce(F.size("h.covered"), F.lit(0)).alias("sentences_removed"),
    )
