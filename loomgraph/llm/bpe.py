"""Byte-pair encoding by forced boundaries.

A merge only ever yields a vocabulary token, so two neighbouring bytes that occur inside no token are certainly cut
apart. The 256 x 256 table of such pairs comes from the vocabulary alone. A text is cut at every certain boundary that
is also safe for the pre-tokenizer (see ``cut_table``), the fragments are encoded independently, each distinct one once
per worker, and their ids are concatenated. The result equals encoding the whole text.

Rows: NULL text gives NULL tokens; an empty text gives an empty list; a text with no certain boundary is one fragment
and is encoded whole, as very long texts are; repeated rows are encoded alike; an empty table gives no rows; further columns of any
name pass through.
"""

from __future__ import annotations

import base64

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import in_parts, parts, release, remembered

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text that are cut and looked up at once, and distinct fragments that a worker remembers.
CHUNK_BYTES = 1 << 20
REMEMBERED = 100_000

ENCODED = T.StructType([
    T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
    T.StructField("fragments", T.IntegerType()),
    T.StructField("round_trip", T.BooleanType()),
])


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pairs_inside(vocabulary: dict[bytes, int]) -> np.ndarray:
    """[256, 256] bool: the byte pairs that occur inside some token."""
    inside = np.zeros((256, 256), dtype=bool)
    for token in vocabulary:
        b = np.frombuffer(token, dtype=np.uint8)
        inside[b[:-1], b[1:]] = True
    return inside


def cut_table(vocabulary: dict[bytes, int]) -> np.ndarray:
    """[65536] bool: cut between these two bytes.

    Certain are the pairs inside no token. Of those only pairs are used whose left byte is visible ASCII and whose right
    byte is no apostrophe: then the cut lies between characters, no fragment ends in white space (the pre-tokenizer looks
    ahead there) and none begins with what would newly read as a contraction, so fragments split as the whole text does.
    """
    cut = ~pairs_inside(vocabulary)
    cut[:0x21] = False
    cut[0x7F:] = False
    cut[:, ord("'")] = False
    return cut.ravel()


class Encoder:
    """Encodes texts with one vocabulary; lives as long as its Python worker."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.vocabulary = read_vocabulary(path)
        self.cut = cut_table(self.vocabulary)
        self.whole = tiktoken.Encoding("loomgraph", pat_str=PATTERN, mergeable_ranks=self.vocabulary, special_tokens={})
        self.bytes_of = {i: token for token, i in self.vocabulary.items()}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool: list[int] = []
        self.ends: list[int] = [0]
        self.frozen = (np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _learn(self, fragment: bytes) -> int:
        self.pool.extend(self.whole.encode_ordinary(fragment.decode("utf-8")))
        self.ends.append(len(self.pool))
        self.known[fragment] = at = len(self.ends) - 2
        return at

    def chunk(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of the texts that end at ``ends`` in ``data``; tokens and fragments of each text."""
        if len(self.known) > REMEMBERED:
            self._forget()
        b = np.frombuffer(data, dtype=np.uint8)
        is_cut = np.zeros(len(b) + 1, dtype=bool)
        if len(b) > 1:
            is_cut[1:-1] = self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        is_cut[ends] = True
        is_cut[0] = False
        at = np.flatnonzero(is_cut)
        stops = at.tolist()
        get, learn = self.known.get, self._learn
        fragments = [data[i:j] for i, j in zip([0, *stops[:-1]], stops)]
        which = [k if (k := get(f)) is not None else learn(f) for f in fragments]
        if len(self.pool) != len(self.frozen[0]):
            self.frozen = (np.array(self.pool, dtype=np.int32), np.array(self.ends, dtype=np.int64))
        pool, bounds = self.frozen
        k = np.array(which, dtype=np.int64)
        first, n = bounds[k], bounds[k + 1] - bounds[k]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(total[-1]) + np.repeat(first - total[:-1], n)]
        upto = np.searchsorted(at, ends, side="right")
        upto = np.where(ends == 0, 0, upto)
        return ids, np.diff(total[upto], prepend=0), np.diff(upto, prepend=0)

    def texts(self, texts: list[str | None]) -> list[tuple[np.ndarray, int, bool] | None]:
        """(ids, number of fragments, whether decoding gives the text again) of each text; None of None."""
        out: list[tuple[np.ndarray, int, bool] | None] = [None] * len(texts)
        rows: list[int] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal rows, parts, size
            if rows:
                ends = np.cumsum([len(p) for p in parts])
                ids, tokens, fragments = self.chunk(b"".join(parts), ends)
                start = 0
                for row, part, n, f in zip(rows, parts, tokens.tolist(), fragments.tolist()):
                    own = ids[start : start + n]
                    out[row] = (own, f, self.decode_bytes(own.tolist()) == part)
                    start += n
            rows, parts, size = [], [], 0

        for row, text in enumerate(texts):
            if text is None:
                continue
            part = text.encode("utf-8")
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= CHUNK_BYTES:
                flush()
        flush()
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encoder(path: str) -> Encoder:
    known = remembered("bpe.encoder")
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


_KIND = pa.struct([("tokens", pa.list_(pa.int32())), ("fragments", pa.int32()), ("round_trip", pa.bool_())])


def _encoded(column: pa.Array, vocabulary: str) -> pa.StructArray:
    done = encoder(vocabulary).texts(column.to_pylist())
    offsets = np.cumsum([0, *(0 if x is None else len(x[0]) for x in done)])
    ids = np.concatenate([np.zeros(0, np.int32), *(x[0] for x in done if x is not None)])
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
            pa.array([None if x is None else x[1] for x in done], pa.int32()),
            pa.array([None if x is None else x[2] for x in done], pa.bool_()),
        ],
        fields=list(_KIND),
        mask=pa.array([x is None for x in done], pa.bool_()),
    )


def encode(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """struct(tokens, fragments, round_trip) of a text; NULL of NULL. ``vocabulary`` must be readable on every worker."""

    @F.arrow_udf(ENCODED)
    def run(column: pa.Array) -> pa.Array:
        return in_parts(column, lambda part: _encoded(part, vocabulary), _KIND)

    return run(text)


def decode(tokens: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """The text of a list of ids; NULL of NULL. Ids that end inside a character give U+FFFD there; unknown ids raise."""

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        of = encoder(vocabulary).decode_bytes
        return pa.array([None if not x.is_valid else of(x.as_py()).decode("utf-8", "replace") for x in column], pa.string())

    return run(tokens)


def in_small_batches(vocabulary: str):
    """Arrow batches of texts (last column) and columns to keep, to those columns and what the texts give. What goes back holds
    one of the ``parts`` of a batch, so neither side holds the tokens of a whole batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in parts(batch.column(batch.num_columns - 1)):
                rows = batch.slice(at.start, at.stop - at.start)
                *kept, texts = rows.columns
                done = _encoded(texts, vocabulary)
                columns = [pc.if_else(done.is_valid(), x, None) for x in (done.field(k) for k in range(len(_KIND)))]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*batch.schema.names[:-1], *(f.name for f in _KIND)])
        release()

    return run


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, tokens, fragments and round_trip of every row of ``docs``, in one pass without a shuffle."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    return rows.mapInArrow(in_small_batches(vocabulary), T.StructType([*rows.schema.fields[:-1], *ENCODED.fields]))
