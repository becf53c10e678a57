"""Passage ranking: term tables, corpus statistics over the whole tenant, candidates, BM25."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import tokens
from loomgraph.sources.shared import materialise

K1, B = 1.2, 0.75


def term_table(chunks: DataFrame, *, exact: bool = False) -> DataFrame:
    """tenant_id, id, term, tf: the inverted index. Written once; queries probe it by term."""
    return chunks.select("tenant_id", "id", F.explode(tokens(F.col("text"), exact=exact)).alias("term")).groupBy("tenant_id", "id", "term").agg(F.count("*").alias("tf"))


def index_rows(chunks: DataFrame, *, exact: bool = False) -> DataFrame:
    """tenant_id, id, term, tf, doc_length of every passage, which comes in one row: its terms are counted as runs of its sorted tokens, so nothing
    is shuffled."""

    def runs(words: Column) -> Column:
        begins = F.filter(F.transform(words, lambda x, i: F.when((i == 0) | (x != F.get(words, i - 1)), i)), lambda i: i.isNotNull())
        length = F.size(words)
        # each array is bound to a variable, or it would be made anew for every element
        return F.flatten(F.transform(F.array(begins), lambda at: F.transform(at, lambda i, k: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(at, k + 1), length) - i).cast("long").alias("tf"), length.alias("doc_length")))))

    words = F.array(F.array_sort(tokens(F.col("text"), exact=exact)))
    return chunks.filter("text is not null").select("tenant_id", "id", F.inline(F.flatten(F.transform(words, runs))))


def lengths(chunks: DataFrame, *, exact: bool = False) -> DataFrame:
    """tenant_id, id, doc_length."""
    return chunks.select("tenant_id", "id", F.size(tokens(F.col("text"), exact=exact)).alias("doc_length"))


def query_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """tenant_id, n_docs, avg_doc_length over all passages of the tenant."""
    return lengths(chunks).groupBy("tenant_id").agg(F.count("*").alias("n_docs"), F.avg("doc_length").alias("avg_doc_length"))


def document_frequencies(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """tenant_id, term, df of every asked term; 0, not missing, where no passage has it."""
    found = term_table(chunks).join(F.broadcast(terms), "term").groupBy("tenant_id", "term").agg(F.count("*").alias("df"))
    asked = chunks.select("tenant_id").distinct().crossJoin(F.broadcast(terms))
    return asked.join(found, ["tenant_id", "term"], "left").select("tenant_id", "term", F.coalesce("df", F.lit(0)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.when(n > 0, F.log1p((n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """One term's share of the score."""
    ratio = F.when(average > 0, length / average).otherwise(0.0)
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))


def _is(term: str) -> Callable[[Column], Column]:
    return lambda word: word == term


def rank(chunks: DataFrame, terms: list[str], k: int | None, candidates: int | None = None, *, exact: bool = False) -> DataFrame:
    """tenant_id, id, score of the best passages; only positive scores, ties by id.

    One pass over the texts yields lengths and the frequencies of the few asked terms, which are written; corpus statistics cover
    the whole tenant; ``candidates`` cuts by (distinct matched terms, id) before scoring. Nothing is shuffled but the matches.
    Where the terms are stored already, ``rank_indexed`` reads no text.
    """
    asked = sorted(set(terms))
    words = tokens(F.col("text"), exact=exact)
    counts = chunks.select("tenant_id", "id", F.array(words).alias("w")).select("tenant_id", "id", F.inline(F.transform("w", lambda w: F.struct(
        F.size(w).alias("length"), *[F.size(F.filter(w, _is(t))).alias(f"tf{j}") for j, t in enumerate(asked)]
    ))))
    counted = materialise(counts, "term-counts")
    stats = counted.groupBy("tenant_id").agg(F.count("*").alias("n"), F.avg("length").alias("average"), *[F.sum((F.col(f"tf{j}") > 0).cast("long")).alias(f"df{j}") for j in range(len(asked))])
    matched = sum(((F.col(f"tf{j}") > 0).cast("int") for j in range(len(asked))), F.lit(0))
    hits = counted.withColumn("matched", matched).filter("matched > 0")
    if candidates is not None:
        hits = hits.orderBy(F.desc("matched"), "id").limit(candidates)
    scored = hits.join(stats, "tenant_id")
    score = sum((F.when(F.col(f"tf{j}") > 0, bm25(F.col(f"tf{j}"), F.col(f"df{j}"), F.col("n"), F.col("length"), F.col("average"))).otherwise(0.0) for j in range(len(asked))), F.lit(0.0))
    ranked = scored.select("tenant_id", "id", "matched", score.alias("score")).filter("score > 0")
    return ranked if k is None else ranked.orderBy(F.desc("score"), "id").limit(k)


def rank_indexed(terms: DataFrame, lengths: DataFrame, asked: list[str], k: int | None, candidates: int | None = None) -> DataFrame:
    """The ranking of ``rank`` from a written index: ``terms`` (tenant_id, term, id, tf, doc_length), sorted or partitioned by term,
    and ``lengths`` (tenant_id, id, doc_length). Reads the asked terms' rows; only matches are shuffled."""
    hits = terms.filter(F.col("term").isin(sorted(set(asked))))
    stats = lengths.groupBy("tenant_id").agg(F.count("*").alias("n"), F.avg("doc_length").alias("average"))
    df = hits.groupBy("tenant_id", "term").agg(F.count("*").alias("df"))
    found = hits.join(df, ["tenant_id", "term"]).join(stats, "tenant_id")
    share = bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("doc_length"), F.col("average"))
    ranked = found.groupBy("tenant_id", "id").agg(F.count("*").alias("matched"), F.sum(share).alias("score"))
    if candidates is not None:
        ranked = ranked.orderBy(F.desc("matched"), "id").limit(candidates)
    ranked = ranked.filter("score > 0")
    return ranked if k is None else ranked.orderBy(F.desc("score"), "id").limit(k)
