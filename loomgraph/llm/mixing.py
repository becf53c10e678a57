"""Mixing sources to target weights by exact subset sums.

Documents are counted by source and exact token length. Each source gets a token budget from its weight; the histogram of
lengths alone decides how many documents of each length to take: first a proportional share of every length, then the
longest that fit, and what remains of the budget is filled by a bounded-knapsack dynamic program over the lengths left.
If the best sum is not reached, more of the share is handed back to the program until it is, or until the program holds
everything and its sum is the best there is. Within each length the documents with the smallest seeded hashes are taken.

Tokens are runs of non-space characters unless ``tokens`` gives another count.

Rows: documents without tokens (NULL or empty text) cost nothing and stay; NULL is a source like any other; ties of the
seeded hash are broken by doc_id and a hash of the text; repeated rows are documents of their own; very long texts are one length each; a source with weight 0
or without a weight keeps only documents without tokens; further columns of any name pass through, but for one called
``n_tokens``, which is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise, words

#: ``KEEP``: the share of all weighted tokens that a mixture without a total has at least.
#: ``BINS``: ranges of the seeded hashes, a power of two.
SEED, SMOOTHING, KEEP, BINS = 17, 0.7, 0.9, 4096


def _fill(items: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Counts of each length with the largest sum up to ``room``; items: (length, how many there are)."""
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    via = np.full(room + 1, -1, dtype=np.int32)
    for k, (length, count) in enumerate(items):
        fresh = np.flatnonzero(reach[: max(0, room + 1 - length)])
        for _ in range(min(count, room // length)):
            fresh = fresh[fresh + length <= room] + length
            fresh = fresh[~reach[fresh]]
            if not len(fresh):
                break
            via[fresh] = k
            reach[fresh] = True
        if reach[room]:
            break
    total = int(np.flatnonzero(reach)[-1])
    taken: dict[int, int] = {}
    while total:
        length = items[via[total]][0]
        taken[length] = taken.get(length, 0) + 1
        total -= length
    return taken


def fit(lengths: Mapping[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their tokens come as close to ``budget`` as they can, from below."""
    lengths = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    available = sum(n * c for n, c in lengths.items())
    if available <= budget:
        return dict(lengths)
    unit = math.gcd(*lengths)
    best = budget // unit * unit
    if best <= 0:
        return {}
    share, found = best / available, {}
    released = 0.0
    while True:
        part = share * (1 - released)
        taken = {n: int(c * part) for n, c in lengths.items()}
        room = best - sum(n * c for n, c in taken.items())
        if released < 1:  # the longest first, while more room is left than the program should have
            least = max(lengths) * (2 if released == 0 else 8)
            for n in sorted(lengths, reverse=True):
                if room > least:
                    more = min(lengths[n] - taken[n], (room - least) // n)
                    if more > 0:
                        taken[n] += more
                        room -= more * n
        left = sorted(((n // unit, lengths[n] - taken[n]) for n in lengths if taken[n] < lengths[n]), reverse=True)
        for n, c in _fill(left, room // unit).items():
            taken[n * unit] += c
            room -= n * unit * c
        total = best - room
        if total > sum(n * c for n, c in found.items()):
            found = {n: c for n, c in taken.items() if c}
        if room == 0 or released == 1:
            return found
        released = min(1.0, max(0.05, released * 4))


def budgets(histogram: DataFrame, weights: Mapping[str, float] | None, total: int | None, smoothing: float) -> DataFrame:
    """source, budget. Without weights a source weighs its tokens to the power of ``smoothing``. A source too short for its
    share of ``total`` gives all it has, and the rest is spread over the others by weight. Without a total it is the largest
    that every source with a weight can meet, but no less than ``KEEP`` of their tokens, so no small source dictates it."""
    sums = histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("available"))
    if weights is None:
        weight = F.pow(F.col("available").cast("double"), F.lit(smoothing))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sums = sums.withColumn("weight", F.when(F.col("available") > 0, weight).otherwise(0.0))
    # by how soon a source is short: at rate r the sum of min(available, r * weight) is the least of (what the k shortest have)
    # + r * (weights of the others) over all k, so the rate for a total is the largest of the rates for each k
    short = Window.orderBy(F.col("available") / F.col("weight"), "source")
    before = short.rowsBetween(Window.unboundedPreceding, -1)
    steps = sums.filter("weight > 0").select(
        (F.col("available") / F.col("weight")).alias("own"), "available",
        F.coalesce(F.sum("available").over(before), F.lit(0)).alias("given"), F.sum("weight").over(short.rowsBetween(0, Window.unboundedFollowing)).alias("others"),
    )
    asked = F.sum("available").over(Window.partitionBy()) * F.lit(KEEP) if total is None else F.lit(float(total))
    rates = steps.withColumn("asked", asked).agg(F.min("own").alias("least"), F.max((F.col("asked") - F.col("given")) / F.col("others")).alias("rate"))
    whole = rates.select((F.greatest("least", "rate") if total is None else F.col("rate")).alias("rate"))
    budget = F.floor(F.col("weight") * F.col("rate") + F.lit(1e-6))
    return sums.crossJoin(F.broadcast(whole)).select("source", F.coalesce(F.least(budget, F.col("available")), F.lit(0)).cast("long").alias("budget"))


def plan(histogram: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """source, tokens, take: how many documents of each length. One task for each source, over its histogram only."""

    def run(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        taken = fit(dict(zip(groups["tokens"].tolist(), groups["n"].tolist())), int(groups["budget"].iloc[0]))
        out = pd.DataFrame({"tokens": list(taken), "take": list(taken.values())}, dtype="int64")
        out.insert(0, "source", groups["source"].iloc[0])
        return out.astype({"source": object})

    limits = budgets(histogram, weights, total, smoothing).select(F.col("source").alias("of"), "budget")
    counted = histogram.join(limits, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return counted.groupBy("source").applyInPandas(run, "source string, tokens long, take long")


def _edges(measured: DataFrame, takes: DataFrame) -> DataFrame:
    """source, tokens, edge, ties, of_them: the last (draw, doc_id, tie) that each partly taken length takes, how many rows have
    it, and how many of those are taken. The rows of a length are counted in ``BINS`` ranges of their draws, so only those in the
    range with the edge are ranked, and a hot length isn't sorted in one task."""
    on = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("tokens") == F.col("p_tokens"))
    rows = measured.join(takes.filter("take < n").drop("n"), on).withColumn("bin", F.shiftright("draw", 64 - BINS.bit_length() + 1))
    counted = rows.groupBy("source", "tokens", "take", "bin").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("source", "tokens").orderBy("bin"))
    edge = counted.withColumn("upto", upto).filter("upto >= take and upto - c < take")
    edge = edge.select(F.col("source").alias("e_source"), F.col("tokens").alias("e_tokens"), F.col("bin").alias("e_bin"), (F.col("take") - F.col("upto") + F.col("c")).alias("left"))
    near = rows.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("tokens") == F.col("e_tokens")) & (F.col("bin") == F.col("e_bin")))
    near = near.groupBy("source", "tokens", "left", F.struct("draw", "doc_id", "tie").alias("edge")).agg(F.count("*").alias("ties"))
    near = near.withColumn("upto", F.sum("ties").over(Window.partitionBy("source", "tokens").orderBy("edge")))
    return near.filter("upto >= left and upto - ties < left").select("source", "tokens", "edge", "ties", (F.col("left") - F.col("upto") + F.col("ties")).alias("of_them"))


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None, *, smoothing: float = SMOOTHING, seed: int = SEED, tokens: Column | None = None
) -> DataFrame:
    """The selected rows of ``docs``, with their token count (``n_tokens``).

    Counts and draws are written once without the texts; histogram, plan and edges come from there, with one row for each source
    and length. The rows themselves meet that table in one join, broadcast below the session's threshold, and aren't ranked.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "n_tokens"]).alias("row")
    count = (words(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens")
    keys = [F.col("source"), count, F.xxhash64(F.lit(seed), "doc_id").alias("draw"), F.col("doc_id"), F.xxhash64("text").alias("tie")]
    measured = materialise(docs.select(*keys), "token-counts").filter("tokens > 0")
    histogram = materialise(measured.groupBy("source", "tokens").agg(F.count("*").alias("n")), "lengths")
    planned = plan(histogram, weights, total, smoothing).select(F.col("source").alias("p_source"), F.col("tokens").alias("p_tokens"), "take")
    takes = materialise(planned.join(histogram, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("tokens") == F.col("p_tokens"))).select("p_source", "p_tokens", "take", "n"), "mixture")
    edges = _edges(measured, takes).select(F.col("source").alias("e_source"), F.col("tokens").alias("e_tokens"), "edge", "ties", "of_them")
    cells = takes.join(edges, F.col("p_source").eqNullSafe(F.col("e_source")) & (F.col("p_tokens") == F.col("e_tokens")), "left").select("p_source", "p_tokens", "edge", "ties", "of_them")
    cells = materialise(cells, "length-edges")
    rows = docs.select(row, *keys)
    met = rows.filter("tokens > 0").join(cells, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("tokens") == F.col("p_tokens")))
    met = met.withColumn("own", F.struct("draw", "doc_id", "tie"))
    chosen = met.filter(F.col("edge").isNull() | (F.col("own") < F.col("edge")) | (F.col("own") == F.col("edge")) & (F.col("of_them") == F.col("ties"))).select("row", "tokens")
    if not cells.filter("of_them < ties").isEmpty():  # repeated rows at an edge: any of them serve
        tied = met.filter((F.col("own") == F.col("edge")) & (F.col("of_them") < F.col("ties")))
        nth = F.row_number().over(Window.partitionBy("source", "tokens").orderBy("own"))
        chosen = chosen.unionByName(tied.withColumn("nth", nth).filter("nth <= of_them").select("row", "tokens"))
    free = rows.filter("tokens = 0").select("row", "tokens")
    return chosen.unionByName(free).select("row.*", F.col("tokens").alias("n_tokens"))
