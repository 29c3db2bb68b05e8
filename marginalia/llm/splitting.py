"""Cutting of oversized texts at natural boundaries, by dynamic programming over boundary positions.

A state is a token at which a piece starts. From it lead cuts after any token within reach: more than ``overlap`` and at most
``max_tokens`` tokens on. A cut costs a penalty (none at a natural boundary) plus its imbalance, the squared share by which the
piece falls short of the limit; the last piece, which takes all that is left, costs its imbalance too. A state's value is the cost
of its best cut plus the value of the state that this leads to. The table of all states is filled from the end of the text.

Costs are added up in one of two orders. TOTAL: the sum over all pieces is least. FIRST: pieces are compared one after the
other from the front, the first difference decides. The cuts of one state all cost something else there, so the cheapest
cut of each state is the best, whatever follows: the latest natural boundary in reach, or the limit if there is none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters with the Unicode property White_Space.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
#: What ends a sentence, and what may close it after that.
SENTENCE_END = re.compile(r"""[.!?。]["')\]”’]*\Z""")

_TOKEN = re.compile(f"[^{WHITE_SPACE}]+")
#: What a cut off any natural boundary costs; more than any imbalance, which is below 1.
CUT_PENALTY = 2.0
TOTAL, FIRST = "total", "first"
#: Windows of cuts that are compared at a time.
_ROWS = 1 << 20


def tokens_and_boundaries(text: str) -> tuple[list[str], list[int]]:
    """The tokens of a text, and after how many tokens natural boundaries lie (ascending; the end is none)."""
    tokens: list[str] = []
    boundaries: list[int] = []
    last_end = 0
    for m in _TOKEN.finditer(text):
        if tokens and (SENTENCE_END.search(tokens[-1][-16:] if len(tokens[-1]) > 16 and tokens[-1][-1] not in "\"')]”’" else tokens[-1]) or text.count("\n", last_end, m.start()) >= 2):
            boundaries.append(len(tokens))
        tokens.append(m.group())
        last_end = m.end()
    return tokens, boundaries


def table(n: int, boundaries: list[int], max_tokens: int, overlap: int, order: str = TOTAL) -> tuple[np.ndarray, np.ndarray]:
    """(end, value) of every state 0 ... n - 1: where its piece ends in the best division of what is left, and what that costs.

    Of equal costs the later end wins.
    """
    width = max_tokens - overlap  # cuts of a state, the latest first: after max_tokens, ..., overlap + 1 tokens
    penalty = np.full(n + 1, CUT_PENALTY)
    penalty[list(boundaries)] = 0.0
    short = np.arange(width) / max_tokens
    imbalance = short * short
    end, value = np.full(n, n, np.int64), np.zeros(n)
    inner = max(0, n - max_tokens)  # states from there on are the last piece's
    rest = (max_tokens - (n - np.arange(inner, n))) / max_tokens
    value[inner:] = rest * rest
    if not inner:
        return end, value
    windows = np.lib.stride_tricks.sliding_window_view(penalty, width)[overlap + 1 : overlap + 1 + inner, ::-1]
    if order == FIRST:
        cost = np.zeros(inner)
        step = max(1, _ROWS // width)
        for a in range(0, inner, step):
            costs = windows[a : a + step] + imbalance
            best = costs.argmin(axis=1)
            end[a : a + len(best)] = np.arange(a, a + len(best)) + max_tokens - best
            cost[a : a + len(best)] = costs[np.arange(len(best)), best]
        for s in range(inner - 1, -1, -1):
            value[s] = cost[s] + value[end[s] - overlap]
    else:
        for s in range(inner - 1, -1, -1):
            costs = windows[s] + imbalance + value[s + 1 : s + 1 + width][::-1]
            best = int(costs.argmin())
            end[s], value[s] = s + max_tokens - best, costs[best]
    return end, value


def pieces(n: int, boundaries: list[int], max_tokens: int, overlap: int, order: str = TOTAL) -> list[tuple[int, int]]:
    """[start, end) of each piece over n tokens: ends beyond start + overlap, at most max_tokens tokens a piece.

    Consecutive pieces share exactly ``overlap`` tokens. At most max_tokens tokens left are the last piece.
    No token: no piece.
    """
    if not (max_tokens >= 1 and 0 <= overlap < max_tokens):
        raise ValueError("need max_tokens >= 1 and 0 <= overlap < max_tokens")
    if order not in (TOTAL, FIRST):
        raise ValueError("order must be total or first")
    if n <= 0:
        return []
    ends, _ = table(n, boundaries, max_tokens, overlap, order)
    out, start = [], 0
    while True:
        out.append((start, int(ends[start])))
        if out[-1][1] == n:
            return out
        start = out[-1][1] - overlap


def content_hash(tokens: list[str]) -> str:
    return hashlib.sha256(" ".join(tokens).encode("utf-8", "surrogatepass")).hexdigest()


class _Split:
    def __init__(self, order: str, id_column: str, oversized_only: bool) -> None:
        self.order, self.id_column, self.oversized_only = order, id_column, oversized_only

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text, most, overlap in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not text or most is None or overlap is None or not (most >= 1 and 0 <= overlap < most):
                    continue
                tokens, boundaries = tokens_and_boundaries(text)
                if self.oversized_only and len(tokens) <= most:
                    continue
                for k, (start, end) in enumerate(pieces(len(tokens), boundaries, most, overlap, self.order)):
                    for column, value in zip(out, (key, k, start, end, content_hash(tokens[start:end])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.column(0).type), pa.array(np.array(out[1], np.int32)), pa.array(np.array(out[2], np.int64)), pa.array(np.array(out[3], np.int64)), pa.array(out[4], pa.string())],
                [self.id_column, "chunk_index", "start_token", "end_token", "content_hash"],
            )


def split(
    items: DataFrame, id_column: str = "document_id", text_column: str = "content", max_column: str = "max_tokens", overlap_column: str = "overlap_tokens", order: str = TOTAL, oversized_only: bool = True
) -> DataFrame:
    """(id, chunk_index int, start_token, end_token, content_hash): the pieces of each item.

    oversized_only: items within their limit give no row; else they give one piece. Null, empty and blank
    texts, null limits and limits that make no sense (below 1, or overlap outside [0, limit)) give no row.
    Repeated items count once. Texts stay where they are; only the result is shuffled, to drop repeats.
    """
    kind = items.schema[id_column].dataType.simpleString()
    cut = items.select(id_column, text_column, max_column, overlap_column).mapInArrow(
        _Split(order, id_column, oversized_only), f"`{id_column}` {kind}, chunk_index int, start_token bigint, end_token bigint, content_hash string"
    )
    return cut.distinct()
