"""Encoding of texts with a public byte-level BPE vocabulary.

Texts are split by the vocabulary's pattern; each piece is merged with a segment tree over the ranks
of adjacent pairs, whose root names the leftmost pair of lowest rank. A merge updates three leaves
and their paths, so a piece of n bytes takes O(n log n), however long it is. Pieces recur, so each
task keeps the ids of pieces it has seen.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..staging import spread

#: Where the vocabulary files lie, unless a path is given.
FOLDER = os.environ.get("TARNMILL_TOKENIZERS", "/opt/tokenizers")
#: The split pattern that belongs to the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a task keeps; when full the store starts anew. Only speed depends on it.
KEPT = 400_000
#: Pieces longer than this many characters are not kept.
KEPT_CHARS = 64

_NONE = 1 << 62


class PairTree:
    """Least rank over adjacent pairs, leftmost among equals; the leaves are pair positions."""

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        keys = [(r << 32) | i if r < _NONE >> 32 else _NONE for i, r in enumerate(ranks)]
        tree = [_NONE] * size + keys + [_NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def best(self) -> int:
        """Position of the leftmost pair of the lowest rank, or -1."""
        top = self.tree[1]
        return -1 if top == _NONE else top & 0xFFFFFFFF

    def put(self, i: int, rank: int | None) -> None:
        tree, j = self.tree, i + self.size
        tree[j] = _NONE if rank is None else (rank << 32) | i
        j >>= 1
        while j:
            a, b = tree[2 * j], tree[2 * j + 1]
            least = a if a < b else b
            if tree[j] == least:
                break
            tree[j] = least
            j >>= 1


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: whole if the vocabulary has it, else by merges until no pair is mergeable."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none = _NONE >> 32
    tree = PairTree([ranks.get(piece[i : i + 2], none) for i in range(n - 1)])
    while (i := tree.best()) >= 0:
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        k = after[i] = after[j]
        if j < n - 1:
            tree.put(j, None)
        if k < n:
            before[k] = i
            tree.put(i, ranks.get(parts[i] + parts[k]))
        else:
            tree.put(i, None)
        if before[i] >= 0:
            h = before[i]
            tree.put(h, ranks.get(parts[h] + parts[i]))
    return tuple(ranks[p] for p in parts if p is not None)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Encoder(dict):
    """Piece -> ids, filled as pieces come up."""

    def __init__(self, raw: bytes):
        import regex

        super().__init__()
        self.ranks, self.pieces = read_ranks(raw), regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = merge_piece(piece.encode("utf-8"), self.ranks)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for a null or empty one."""
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.pieces(text)))) if text else 0


def vocabulary(name: str = "byte_bpe_50k", path: str | None = None) -> bytes:
    with open(path or os.path.join(FOLDER, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def _free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _apply(df: DataFrame, text: str, out: str, kind: T.DataType, arrow, make, path: str | None, keep: list[str] | None) -> DataFrame:
    keep = [c for c in df.columns if c != text] if keep is None else keep
    if out in keep:
        raise ValueError(f"column {out} is there already; name another")
    src = spread(df.select(*[df[c] for c in keep], df[text].alias(_free_name(df, "text_"))))
    raw = df.sparkSession.sparkContext.broadcast(vocabulary(path=path))  # a file of fixed size
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(raw.value)
        for b in batches:
            # Few texts at a time, so that long ones don't fill the worker's memory with ids.
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                made = make(enc, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*part.schema.names[:-1], out])

    return src.mapInArrow(run, schema)


def _ids(enc: Encoder, texts: list[str | None]) -> pa.Array:
    import numpy as np

    offsets, parts = [0], []
    for t in texts:
        ids = np.array(enc.encode(t), dtype=np.int32)
        parts.append(ids)
        offsets.append(offsets[-1] + len(ids))
    flat = np.concatenate(parts) if parts else np.array([], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """`df` with the text replaced by its token ids (array of int). Null and empty texts give an
    empty array, blank ones are encoded as they stand, strings that look like special tokens are
    ordinary text. No shuffle; rows are kept as they are, repeats included."""
    return _apply(df, text, out, T.ArrayType(T.IntegerType(), False), pa.int32(), _ids, path, keep)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """`df` with the text replaced by its number of tokens (bigint), 0 for null and empty texts."""
    return _apply(df, text, out, T.LongType(), pa.int64(), lambda enc, texts: pa.array([enc.count(t) for t in texts], pa.int64()), path, keep)
