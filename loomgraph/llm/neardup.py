"""Near duplicates by edit similarity: Order MinHash candidates, banded alignment.

A text's k-mers (of ``WORDS`` lower-case words, one less below ``LONG`` words) are labelled with their occurrence number. Each of
``SKETCHES`` hash functions picks the two smallest labelled k-mers and keeps them in text order, so two texts agree in a sketch
the likelier the closer they are by edits, not only by content. Texts of up to ``SHORT`` words can differ by one word only: they
meet by the text without each of its words, always. Texts that agree in a sketch are a bucket; each member is aligned with the bucket's smallest
node. Buckets that hold more than one group after that are compared pair by pair across the groups, in blocks, so every two
texts of a bucket are aligned, or connected already, or have bags of words too far apart to be similar. Nothing is capped: the
bags (``BAG`` bytes a text) make a bucket that a common passage fills cheap, but its comparisons grow with its square. Pairs as
similar as ``SIMILARITY`` meet with a probability above 0.9 even where the edits are spread evenly: 1 - (1 - J^2)^48 with
J = 1/4 is 0.95 for long texts.

Alignment: edit distance over words in a band as wide as the similarity allows (bit-parallel, exact inside the band).
Similarity = 1 - distance / words of the longer text. Groups are the connected components of the aligned pairs.

Rows: equal texts are one node and always a group, empty ones too; a NULL text is a duplicate of nothing and stays; texts
without words match only equal texts; very long texts are sketched and aligned whole; of a group the row with the smallest doc_id stays (NULL first; of repeated
rows one); an empty table gives no groups; further columns pass through.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import discard, materialise, release, remembered

WORDS, SKETCHES, SIMILARITY, SEED = 3, 48, 0.8, 41
#: Words of the longest text that is keyed without each of its words (it differs by one word from any as similar as 0.8), and of
#: the shortest with k-mers of ``WORDS`` words. Hashes that are made at once.
SHORT, LONG, TOGETHER = 9, 60, 1 << 15
#: Counts in a bag of words; members in a block of a bucket.
BAG, BLOCK = 128, 1024

_word = re.compile(r"[^\W_]+")
_U = np.uint64
#: Distinct words that a worker remembers.
REMEMBERED = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_ids(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    known = remembered("neardup.words")
    if len(known) > REMEMBERED:
        known.clear()
    get = known.get
    out = []
    for w in _word.findall(text.lower()):
        k = get(w)
        if k is None:
            k = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(k)
    return np.array(out, dtype=_U)


def labelled(ids: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A hash of each k-mer and its occurrence number (0 for the first of its kind)."""
    k = min(words, len(ids))
    n = len(ids) - k + 1
    h = np.zeros(n, dtype=_U)
    for j in range(k):
        h = _mix(h * _U(31) + ids[j : j + n])
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    nth = np.empty(n, dtype=_U)
    nth[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return _mix(h + nth * _U(0x9E3779B97F4A7C15))


def kmer_words(n: int) -> int:
    """Words in a k-mer for two texts of which the longer has ``n`` words."""
    return WORDS - 1 if n < LONG else WORDS


def sketch(text: str | None, least: float = SIMILARITY, sketches: int = SKETCHES, seed: int = SEED) -> list[int]:
    """The signed 64-bit keys under which a text meets others; none without words.

    The longer of two texts decides what both are keyed by, so a text has the keys for every length that one as similar as
    ``least`` can have: up to ``SHORT`` words, the text and (where a similar text may differ) the text without each of its
    words; beyond, for each hash function the two smallest labelled k-mers in text order.
    """
    ids = word_ids(text) if text else np.zeros(0, dtype=_U)
    n = len(ids)
    if not n:
        return []
    longest = math.floor(n / least + 1e-9)
    keys: set[int] = set()
    if n <= SHORT:
        keys.add(xxhash.xxh3_64_intdigest(ids.tobytes(), seed=seed))
        if math.floor((1 - least) * n + 1e-9):
            keys.update(xxhash.xxh3_64_intdigest(np.delete(ids, k).tobytes(), seed=seed) for k in range(n))
    if longest > SHORT:
        for k in {kmer_words(max(n, SHORT + 1)), kmer_words(longest)}:
            keys.update(_smallest(labelled(ids, k), _salts(sketches, seed + k)))
    return [x - (1 << 63) for x in sorted(keys)]


def _smallest(marks: np.ndarray, salts: np.ndarray) -> list[int]:
    """For each salt a hash of the two smallest marks in their order."""
    if len(marks) < 2:
        return _mix(marks[0] ^ salts).tolist()
    first, second = np.empty(len(salts), dtype=np.int64), np.empty(len(salts), dtype=np.int64)
    step = max(1, TOGETHER // len(marks))
    for at in range(0, len(salts), step):
        v = marks[None, :] ^ salts[at : at + step, None]
        v *= _U(0xBF58476D1CE4E5B9)
        v ^= v >> _U(32)
        v *= _U(0x94D049BB133111EB)
        row = np.arange(len(v))
        first[at : at + step] = low = v.argmin(axis=1)
        v[row, low] = _U(0xFFFFFFFFFFFFFFFF)
        second[at : at + step] = v.argmin(axis=1)
    x, y = marks[np.minimum(first, second)], marks[np.maximum(first, second)]
    return _mix(_mix(x * _U(31) + y) ^ salts).tolist()


@functools.lru_cache(maxsize=8)
def _salts(sketches: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, sketches + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def distance(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``. Bit vectors over the band of diagonals within ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    start, ends = 0, min(len(a), len(b))
    while start < ends and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    cut, ends = 0, min(len(a), len(b))
    while cut < ends and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    if cut:
        a, b = a[:-cut], b[:-cut]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if not n:
        return m if m <= most else None
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    if 2 * most + 1 >= m:
        return _whole(at, b, m, most)
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down, score = full & ~((1 << most) - 1), 0, most
    top, beside, shift = 1 << (width - 1), 1 << (width - 2) if width > 1 else 0, -most
    worst = most + n - (m - most)
    for i in range(n):
        x = at.get(b[i], 0)
        x = (x << -shift if shift < 0 else x >> shift) & full
        d = ((((x & up) + up) ^ up) | x | down) & full
        right = (down | ~(d | up)) & full
        left = d & up
        if i < m - most:
            if not d & top:
                score += 1
        else:
            if right & beside:
                score += 1
            if left & beside:
                score -= 1
            beside >>= 1
        if score > worst:
            return None
        d >>= 1
        up = (left | ~(d | right)) & full
        down = d & right
        shift += 1
    return score if score <= most else None


def _whole(at: dict[int, int], b: list[int], m: int, most: int) -> int | None:
    """The same where the band covers every diagonal."""
    full = (1 << m) - 1
    up, down, score, last = full, 0, m, 1 << (m - 1)
    for x in b:
        x = at.get(x, 0)
        d = (((x & up) + up) ^ up) | x | down
        right = (down | ~(d | up)) & full
        left = d & up
        if right & last:
            score += 1
        elif left & last:
            score -= 1
        right = (right << 1 | 1) & full
        up = ((left << 1) | ~(d | right)) & full
        down = right & d
    return score if score <= most else None


def similar(a: list[int], b: list[int], least: float = SIMILARITY) -> float | None:
    """The similarity of two word sequences if it is at least ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = math.floor((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most or longer - sum((Counter(a) & Counter(b)).values()) > most:
        return None
    d = distance(a, b, most)
    return None if d is None else 1 - d / longer


def _sketches(least: float):
    """Arrow batches of (a, b, text) to (a, b, key). Copies of a text inside one task give keys once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keys, counts = [], []
            for x, y, text in zip(a, b, batch.column("text")):
                own = [] if (x, y) in seen else sketch(text.as_py(), least)
                seen.add((x, y))
                keys += own
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(c, dtype=np.int64), counts)) for c in (a, b)] + [pa.array(keys, pa.int64())], schema=schema)
        seen, a, b, keys, counts = set(), [], [], [], []
        release()

    return run


def _sequence(text: Column) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        done = pa.array([(word_ids(x.as_py()) >> _U(32)).astype(np.uint32).tobytes() for x in column], pa.binary())
        release()
        return done

    return run(text)


def _aligned(a: Column, b: Column, least: float) -> Column:
    @F.arrow_udf(T.DoubleType())
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        def ids(x: bytes) -> list[int]:
            return np.frombuffer(x, dtype=np.uint32).tolist()

        done = pa.array([similar(ids(x), ids(y), least) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())
        release()
        return done

    return run(a, b)


def bag(words: bytes) -> bytes:
    """How many words have each value of their last bits, 255 at most."""
    counts = np.bincount(np.frombuffer(words, dtype=np.uint32) & np.uint32(BAG - 1), minlength=BAG)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _bag(words: Column) -> Column:
    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([bag(x) for x in column.to_pylist()], pa.binary())

    return run(words)


def node(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _verified(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """The (leader, node) pairs whose texts are similar, with the similarity."""
    own = pairs.join(sequences.select(F.col("node"), F.col("words").alias("x")), "node")
    both = own.join(sequences.select(F.col("node").alias("leader"), F.col("words").alias("y")), "leader")
    return both.select("leader", "node", _aligned(F.col("x"), F.col("y"), least).alias("similarity")).filter("similarity is not null")


def near_in_block(nodes: np.ndarray, groups: np.ndarray, sizes: np.ndarray, bags: np.ndarray, left: np.ndarray, right: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``left`` and ``right`` (of ``left`` alone if None) in different groups whose words can be similar: half of
    the difference of the bags and of the sizes is never more than the edit distance."""
    other = left if right is None else right
    other = other[np.argsort(sizes[other], kind="stable")]
    left = other if right is None else left
    ordered, against, found_a, found_b = sizes[other], bags[other], [], []
    ends = np.searchsorted(ordered, sizes[left] / least + 1e-6, "right")
    begins = np.arange(1, len(left) + 1) if right is None else np.searchsorted(ordered, sizes[left] * least - 1e-6, "left")
    for x, lo, hi in zip(left.tolist(), begins.tolist(), ends.tolist()):
        if lo < hi:
            gap = np.abs(against[lo:hi] - bags[x]).sum(axis=1) + np.abs(ordered[lo:hi] - sizes[x])
            near = gap <= 2 * np.floor((1 - least) * np.maximum(ordered[lo:hi], sizes[x]) + 1e-9)
            y = other[lo:hi][near]
            y = y[(groups[y] != groups[x]).any(axis=1)]
            found_a.append(np.full(len(y), x))
            found_b.append(y)
    return (nodes[np.concatenate(found_a)], nodes[np.concatenate(found_b)]) if found_a else (nodes[:0], nodes[:0])


def _block_pairs(least: float):
    """Arrow batches of members, sorted by key and blocks, to the pairs of nodes worth an alignment."""
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("leader", kind), ("node", kind)])

    def structs(x: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x[:, 0], pa.int64()), pa.array(x[:, 1], pa.int64())], fields=list(kind))

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: table[c].to_numpy() for c in table.column_names if c != "bag"}
        nodes, groups = np.stack([col["na"], col["nb"]], 1), np.stack([col["ca"], col["cb"]], 1)
        bags = np.frombuffer(b"".join(table["bag"].to_pylist()), dtype=np.uint8).reshape(-1, BAG).astype(np.int16)
        place = np.stack([col["key"], col["i"], col["j"]], 1)
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        found = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
            at = np.arange(lo, hi)
            inside = col["i"][lo] == col["j"][lo]
            mine = at if inside else at[col["block"][lo:hi] == col["i"][lo]]
            found.append(near_in_block(nodes, groups, col["size"], bags, mine, None if inside else np.setdiff1d(at, mine), least))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        swap = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])
        a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
        both = np.unique(np.concatenate([a, b], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([structs(both[:, :2]), structs(both[:, 2:])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            start = int(np.flatnonzero((place != place[-1]).any(axis=1))[-1] + 1) if (place != place[-1]).any() else 0
            if held and (start or any(held[-1].column(c)[-1].as_py() != int(place[0][k]) for k, c in enumerate(("key", "i", "j")))):
                held.append(batch.slice(0, start))
                yield from pairs(pa.Table.from_batches(held))
                held = []
            elif start:
                yield from pairs(pa.Table.from_batches([batch.slice(0, start)]))
            held.append(batch.slice(start))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _crossing(buckets: DataFrame, labels: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """The pairs (leader, node) of one bucket that the leaders left in different groups, without those whose bags of words are
    too far apart. A bucket is compared in pairs of blocks of about ``BLOCK`` members."""
    placed = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low <> high")
    mixed = mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    known = sequences.select("node", "bag", F.expr("cast(octet_length(words) / 4 as int)").alias("size"))
    members = placed.join(mixed, "key").join(known, "node").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "node"), "blocks").cast("int"))
    spread = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "size", "bag",
        F.col("node.a").alias("na"), F.col("node.b").alias("nb"), F.col("component.a").alias("ca"), F.col("component.b").alias("cb"),
    )
    ranked = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = ranked.mapInArrow(_block_pairs(least), "leader struct<a:long,b:long>, node struct<a:long,b:long>").distinct()
    tried = buckets.filter("node <> leader").select("leader", "node").distinct()
    return pairs.join(tried, ["leader", "node"], "left_anti")


def buckets_of(texts: DataFrame, least: float) -> DataFrame:
    """key, node, leader of the keys that two or more texts have; the leader is the smallest node. texts: node, text.

    Which keys those are comes from the smallest and the greatest of each key, which combine before the shuffle, as the leader does
    among the members that are left: no bucket is gathered in one task.
    """
    keyed = texts.select("node.a", "node.b", "text").mapInArrow(_sketches(least), "a long, b long, key long")
    members = materialise(keyed, "sketches")
    shared = members.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low <> high").select("key")
    met = materialise(members.join(shared, "key", "left_semi").select("key", F.struct("a", "b").alias("node")).distinct(), "bucket-members")
    discard(members)
    leaders = met.groupBy("key").agg(F.min("node").alias("leader"))
    buckets = materialise(met.join(leaders, "key"), "buckets")
    discard(met)
    return buckets


def similar_nodes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs of nodes (leader, node, similarity) that connect the groups."""
    texts = docs.filter("text is not null").select(node(F.col("text")).alias("node"), "text")
    buckets = buckets_of(texts, least)
    candidates = buckets.select("node").distinct()
    sequences = texts.join(candidates.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sequences = sequences.select("node", _sequence(F.col("text")).alias("words")).select("node", "words", _bag(F.col("words")).alias("bag"))
    sequences = materialise(sequences, "word-sequences")
    first = materialise(_verified(buckets.filter("node <> leader").select("leader", "node").distinct(), sequences, least), "aligned")
    labels = components(first)
    second = materialise(_verified(_crossing(buckets, labels, sequences, least), sequences, least), "aligned-crossing")
    discard(buckets, sequences, labels)
    return first.unionByName(second)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), of the undirected (leader, node) edges.

    Each round takes the smallest label around every node and follows labels of labels, and is written, so rounds grow with
    the logarithm of the longest chain.
    """
    both = materialise(edges.select(F.col("leader").alias("u"), F.col("node").alias("v")).unionByName(edges.select(F.col("node").alias("u"), F.col("leader").alias("v"))).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")), "labels")
    while True:
        around = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        near = labels.join(around, labels["node"] == around["u"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("on"), F.col("component").alias("above"))
        new = near.join(up, near["component"] == up["on"], "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component"))
        new = materialise(new.select("node", "component", (F.col("was") != F.col("component")).alias("moved")), "labels")
        discard(labels)
        labels = new
        if new.filter("moved").isEmpty():
            discard(both)
            return new


def _places(docs: DataFrame) -> DataFrame:
    """node, doc_id, row: the rows with a text, numbered. Written without the texts, so a row keeps its number."""
    return materialise(docs.filter("text is not null").select("doc_id", node(F.col("text")).alias("node"), F.monotonically_increasing_id().alias("row")), "places")


def _grouped(places: DataFrame, labels: DataFrame) -> DataFrame:
    return places.join(labels.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


_ORDER = ("doc_id", "node", "row")


def groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id (the doc_id that stays), keep: every row of the groups of two or more rows. A group's smallest row and size
    combine before the shuffle, so a group may hold any share of the rows."""
    rows = _grouped(_places(docs), components(similar_nodes(docs, least)))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), *_ORDER)
    best = rows.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(best, "component").select("doc_id", F.col("best.doc_id").alias("group_id"), (F.col("row") == F.col("best.row")).alias("keep"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group. The texts are shuffled once, by their node and doc_id; none is sorted or gathered by group."""
    labels, places = components(similar_nodes(docs, least)), _places(docs)
    counted = _grouped(places.groupBy("node", "doc_id").agg(F.count("*").alias("n")), labels)
    best = counted.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "node", "n")).alias("best"))
    kept = materialise(best.select("best.node", F.col("best.doc_id").alias("kept_id"), "best.n"), "kept")
    discard(labels, places)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    texts = docs.filter("text is not null").select(row, node(F.col("text")).alias("own node")).join(kept.hint("shuffle_hash"), (F.col("own node") == F.col("node")) & F.col("row.doc_id").eqNullSafe(F.col("kept_id")))
    once = texts.filter("n = 1").select("row")
    if not kept.filter("n > 1").isEmpty():  # repeated rows: the first that is met
        once = once.unionByName(texts.filter("n > 1").groupBy("node").agg(F.first("row").alias("row")).select("row"))
    return once.select("row.*").unionByName(docs.filter("text is null"))
