"""Deterministic greedy modularity, one level. The sweep depends on its order, so a tenant's graph is one group."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ranking import placed
from loomgraph.sources.shared import materialise

PASSES = 100


def detect(nodes: Iterable[str], edges: Iterable[tuple[str, str, float]], resolution: float = 1.0) -> dict[str, str]:
    """node -> the smallest member of its community. Parallel edges add up; nodes move in order of id to the community with
    the greatest gain, ties to the one with the smallest member; at most ``PASSES`` sweeps."""
    if resolution < 0:
        raise ValueError("resolution is negative")
    names = sorted(set(nodes))
    place = {n: i for i, n in enumerate(names)}
    around: list[dict[int, float]] = [{} for _ in names]
    strength = [0.0] * len(names)
    total = 0.0
    for a, b, w in edges:
        if not math.isfinite(w) or w <= 0:
            raise ValueError(f"weight {w} of {a} and {b}")
        i, j = place[a], place[b]
        total += w
        strength[i] += w
        strength[j] += w
        if i != j:
            around[i][j] = around[i].get(j, 0.0) + w
            around[j][i] = around[j].get(i, 0.0) + w
    home = list(range(len(names)))
    inside = [{i} for i in home]
    mass = strength[:]
    for _ in range(PASSES if total else 0):
        quiet = True
        for i, own in enumerate(strength):
            was = home[i]
            inside[was].remove(i)
            mass[was] -= own
            pull = {was: 0.0}
            for j, w in around[i].items():
                pull[home[j]] = pull.get(home[j], 0.0) + w
            ranked = [(w - resolution * own * mass[c] / (2 * total), -min(inside[c], default=-1), c) for c, w in pull.items()]
            to = max(ranked)[2]
            inside[to].add(i)
            mass[to] += own
            home[i] = to
            quiet = quiet and to == was
        if quiet:
            break
    smallest = {c: names[min(m)] for c, m in enumerate(inside) if m}
    return {n: smallest[home[i]] for i, n in enumerate(names)}


def _homes(start: np.ndarray, other: np.ndarray, weight: np.ndarray | None, strength: np.ndarray, total: float, resolution: float) -> np.ndarray:
    """The home of each node after the moves of ``detect``. The neighbours of node i lie from start[i] to start[i + 1]; without weights all are 1."""
    n = len(strength)
    home = np.arange(n, dtype=np.int32)
    own, mass, ends, size = strength.tolist(), strength.tolist(), start.tolist(), [1] * n
    heaps: dict[int, list[int]] = {}  # of the members of what somebody joined; who left stays in one until it comes up

    def rank(c: int) -> int:
        if not size[c]:
            return 1
        heap = heaps.setdefault(c, [c])
        while home[heap[0]] != c:
            heappop(heap)
        return -heap[0]

    for _ in range(PASSES if total else 0):
        quiet = True
        for i in range(n):
            low, high = ends[i], ends[i + 1]
            if low == high:
                continue
            was, o = int(home[i]), own[i]
            size[was] -= 1
            mass[was] -= o
            near = home[other[low:high]]
            if high - low < 64:
                pull = {was: 0.0}
                for c, w in zip(near.tolist(), [1.0] * (high - low) if weight is None else weight[low:high].tolist()):
                    pull[c] = pull.get(c, 0.0) + w
            else:
                seen, at = np.unique(near, return_inverse=True)
                pull = {was: 0.0} | dict(zip(seen.tolist(), np.bincount(at, None if weight is None else weight[low:high]).astype(float).tolist()))
            gains = [(w - resolution * o * mass[c] / (2 * total), c) for c, w in pull.items()]
            best = max(gains)[0]
            tied = [c for g, c in gains if g == best]
            home[i] = -1
            to = tied[0] if len(tied) == 1 else max((rank(c), c) for c in tied)[1]
            home[i] = to
            size[to] += 1
            mass[to] += o
            if to != was or len(tied) > 1:
                heappush(heaps.setdefault(to, [to]), i)
            quiet = quiet and to == was
        if quiet:
            break
    return home


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """tenant_id, id, community. nodes: tenant_id, id; edges: tenant_id, src, dst, weight. Parallel edges are summed before the graph of a
    tenant comes to one task, in order and as numbers: 4 bytes for either end of a distinct edge, and 8 more where weights differ from 1."""
    once = edges.groupBy("tenant_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    known = materialise(placed(nodes.select("tenant_id", "id").distinct(), "tenant_id", "id", name="nth"), "nodes")
    numbered = once
    for end, nth in (("src", "i"), ("dst", "j")):
        numbered = numbered.join(known.select("tenant_id", F.col("id").alias(end), F.col("nth").alias(nth)), ["tenant_id", end], "left").drop(end)
    numbered = materialise(numbered.select("tenant_id", "i", "j", "weight"), "numbered")
    rows = known.select("tenant_id", F.col("nth").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("weight"))
    rows = rows.unionByName(numbered).unionByName(numbered.filter("i <> j").select("tenant_id", F.col("j").alias("i"), F.col("i").alias("j"), "weight"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, total, runs, others, weights = None, -1, 0.0, [], [], []
        for batch in batches:
            i, j, w = (batch.column(c) for c in ("i", "j", "weight"))
            there = j.is_valid().to_numpy(zero_copy_only=False)
            if i.null_count or (np.diff(i.to_numpy()) < 0).any():
                raise KeyError("an edge has an end that is no node, or edges are out of order")
            first = int(i[0].as_py()) if first is None else first
            last = int(i[-1].as_py()) - first
            i = i.to_numpy()[there] - first
            if not len(i):
                continue
            j, w = j.drop_null().to_numpy() - first, w.fill_null(np.nan).to_numpy(zero_copy_only=False)[there]
            if not (np.isfinite(w) & (w > 0)).all():
                raise ValueError("a weight isn't positive")
            loop = i == j
            total += float(np.where(loop, w, w / 2).sum())
            at = np.flatnonzero(np.diff(i, prepend=-1))
            runs.append((i[at].astype(np.int32), np.add.reduceat(~loop, at, dtype=np.int64), np.add.reduceat(np.where(loop, 2 * w, w), at)))
            others.append(j[~loop].astype(np.int32))
            weights.append(len(others[-1]) if (w == 1).all() else w[~loop])
        count, strength = np.zeros(last + 2, np.int64), np.zeros(last + 1)
        for i, n, w in runs:
            count[i + 1] += n
            strength[i] += w
        other = np.concatenate(others) if others else np.zeros(0, np.int32)
        weight = None if all(isinstance(w, int) for w in weights) else np.concatenate([np.ones(w) if isinstance(w, int) else w for w in weights])
        del runs, others, weights
        home = _homes(np.cumsum(count), other, weight, strength, total, resolution)
        leader = np.full(last + 1, last + 1, np.int64)
        np.minimum.at(leader, home, np.arange(last + 1))
        for k in range(0, last + 1, 1 << 16):
            part = leader[home[k : k + (1 << 16)]] + first
            yield pa.RecordBatch.from_pydict({"tenant_id": pa.array([key[0].as_py()] * len(part), pa.string()), "nth": pa.array(np.arange(k, k + len(part)) + first), "leader": pa.array(part)})

    ordered = rows.repartition("tenant_id").sortWithinPartitions("tenant_id", "i", "j")
    found = materialise(ordered.groupBy("tenant_id").applyInArrow(run, "tenant_id string, nth long, leader long"), "communities")
    named = found.join(known.select("nth", "id"), "nth")
    return named.join(known.select(F.col("nth").alias("leader"), F.col("id").alias("community")), "leader").select("tenant_id", "id", "community")


def shown_members(found: DataFrame, degrees: DataFrame, limit: int = 25, min_size: int = 2) -> DataFrame:
    """community, id, rank, size: the best connected members of each community of ``min_size`` or more."""
    from pyspark.sql import Window

    by = Window.partitionBy("tenant_id", "community")
    ranked = found.join(degrees, "id", "left").withColumns({"size": F.count("*").over(by), "rank": F.row_number().over(by.orderBy(F.coalesce("degree", F.lit(0)).desc(), "id"))})
    return ranked.filter((F.col("size") >= min_size) & (F.col("rank") <= limit)).select("tenant_id", "community", "id", "rank", "size")


def theme_prompts(shown: DataFrame, entities: DataFrame) -> DataFrame:
    """tenant_id, community, prompt: one line a member, best connected first."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit(")"))
    named = shown.join(entities.select("id", "name", "entity_type"), "id").withColumn("line", line)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return named.groupBy("tenant_id", "community").agg(F.array_join(listed, "\n").alias("prompt"))


def themes(prompts: DataFrame, model, *, skip_failed: bool = False) -> DataFrame:
    """tenant_id, community, title, summary, failed. ``model``: text -> (title, summary), called once a community in its task."""

    def run(frames):
        for frame in frames:
            out = []
            for t, c, p in zip(frame["tenant_id"], frame["community"], frame["prompt"]):
                try:
                    out.append((t, c, *model(p), False))
                except Exception:
                    if not skip_failed:
                        raise
                    out.append((t, c, None, None, True))
            yield pd.DataFrame(out, columns=["tenant_id", "community", "title", "summary", "failed"])

    return prompts.select("tenant_id", "community", "prompt").mapInPandas(run, "tenant_id string, community string, title string, summary string, failed boolean")
