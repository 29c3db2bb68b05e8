"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

A text is cut into pieces by the vocabulary's pattern; each piece is merged on its own. For a piece, the
leaves of a segment tree are its byte positions; a leaf holds the rank of the pair that begins there and
each node the leftmost minimum below it. A merge takes the root, joins two neighbours of a linked list of
live positions and updates three leaves, so a piece of n bytes takes n log n steps, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabularies are; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary is broadcast; a larger file is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces a worker remembers; then it begins anew. Only speed depends on it.
REMEMBERED = 1 << 17
#: Longest piece, in characters, that is remembered.
REMEMBERED_LENGTH = 64

_NONE = 1 << 62


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id of a vocabulary file with one base64 token and its rank a line."""
    file = Path(path)
    if file.stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.read_bytes().splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece. Of equal ranks the leftmost pair merges first. Empty: no ids."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    rank = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(at: int, value: int) -> None:
        k = at + size
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    mask = (1 << shift) - 1
    while (least := tree[1]) != _NONE:
        i = least & mask
        j = after[i]
        k = after[j]
        parts[i] += parts[j]
        after[i] = k
        put(j, _NONE)
        if k < n:
            before[k] = i
            r = rank(parts[i] + parts[k])
            put(i, _NONE if r is None else r << shift | i)
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            r = rank(parts[h] + parts[i])
            put(h, _NONE if r is None else r << shift | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[parts[i]])
        i = after[i]
    return ids


class Encoder(dict):
    """Piece (str) -> ids, computed when first asked for and remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        super().__init__()
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = merge(raw, self.ranks) if whole is None else [whole]
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one. Strings of special tokens are ordinary text."""
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []


#: One encoder for each vocabulary and worker process, kept over tasks.
_ENCODERS: dict[str, Encoder] = {}


class _Encode:
    def __init__(self, ranks, key: str, pattern: str, id_column: str, ids_column: str) -> None:
        self.ranks, self.key, self.pattern, self.id_column, self.ids_column = ranks, key, pattern, id_column, ids_column

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(self.key)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[self.key] = Encoder(self.ranks.value, self.pattern)
        for batch in batches:
            offsets, flat = np.zeros(batch.num_rows + 1, np.int32), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    flat.extend(chain.from_iterable(map(encoder.__getitem__, encoder.pieces(text))))
                offsets[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [self.id_column, self.ids_column])


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, ids_column: str = "ids") -> DataFrame:
    """(id, ids array<int>): one row for each row of documents, null and empty texts with an empty list.

    Nothing is shuffled; a very long text costs n log n for its longest piece. The vocabulary, of checked
    size, is broadcast.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    key = hashlib.sha256(Path(vocabulary).read_bytes() + pattern.encode()).hexdigest()
    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(_Encode(ranks, key, pattern, id_column, ids_column), f"`{id_column}` {kind}, `{ids_column}` array<int>")
