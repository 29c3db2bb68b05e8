"""Evaluation passages inside training texts, by pigeonhole edit matching.

Texts become their words (longest runs of Unicode letters and digits, lower-cased) joined by single spaces.
Every run of ``window`` words of a test item is a needle. With a budget of e character edits a needle is
cut into e + 1 pieces of whole words that share no character; the blanks between them belong to none, and a
piece may lie within longer words. So an edit breaks one piece at most, and any text within e edits of the
needle holds at least one piece unchanged.
All pieces of all items are sought at once by an Aho-Corasick automaton. Each hit is verified by Myers' bit-parallel edit
distance around its place; a distance of 0 stands only if the words there are whole words, else it is 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a needle, and the edits in it that still count.
WINDOW, BUDGET = 12, 2
#: Characters of passages that one reading of the documents takes on (they are broadcast), and that one automaton holds.
ITEM_CHARACTERS, BLOCK_CHARACTERS = 32 << 20, 400_000
#: Automata a worker keeps, and characters of documents it gathers before it goes on to the next if there are several.
HELD, GATHERED = 4, 32 << 20

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)] if text else []


def myers(pattern: str, text: str, most: int) -> int:
    """The least edit distance of pattern to any substring of text, or most + 1 if it is above ``most``."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        best = min(best, score)
    return best if best <= most else most + 1


class Needles:
    """The needles of some items, and the automaton over their pieces.

    A needle is the number of its first word among all words of all passages; where words lie, and where a piece stands, is
    kept in arrays. So a passage costs its words and the automaton's nodes for them, however many needles overlap.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, budget: int = BUDGET) -> None:
        if window < budget + 1:
            raise ValueError("a window must have a word for each piece")
        self.window, self.budget = window, budget
        passages: dict[str, list[int]] = {}
        for item, passage in items:
            found = words(passage)
            if len(found) >= window:
                passages.setdefault(" ".join(found), []).append(item)
        self.items, self.lines = list(passages.values()), list(passages)
        parts = [line.split(" ") for line in self.lines]
        self.words: list[str] = [w for own in parts for w in own]
        size = np.array([len(own) for own in parts], np.int64)
        self.first = np.r_[0, np.cumsum(size)].astype(np.int64)  # of each passage its first word
        self.passage = np.repeat(np.arange(len(parts)), size).astype(np.int32)  # of each word its passage
        length = np.array([len(w) + 1 for w in self.words], np.int64)
        place = np.r_[0, np.cumsum(length)]
        self.place = (place[:-1] - np.repeat(place[self.first[:-1]], size)).astype(np.int64)  # of each word where it begins in its line
        ends = np.linspace(0, window, budget + 2).astype(int)
        #: Words of a piece -> how many words of the needle come before it, for each piece of that size.
        self.before: dict[int, list[int]] = {}
        for a, b in zip(ends, ends[1:], strict=False):
            self.before.setdefault(int(b - a), []).append(int(a))
        number: dict[str, int] = {}
        uses: list[list[int]] = []
        self.pieces: list[tuple[int, int]] = []  # characters, words
        for p, own in enumerate(parts):
            for n in self.before:
                for i in range(len(own) - n + 1):
                    piece = " ".join(own[i : i + n])
                    k = number.setdefault(piece, len(number))
                    if k == len(uses):
                        uses.append([])
                        self.pieces.append((len(piece), n))
                    uses[k].append(int(self.first[p]) + i)
        self.uses_from = np.r_[0, np.cumsum([len(u) for u in uses])].astype(np.int64)
        self.uses = np.array([w for u in uses for w in u], np.int32)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, k in number.items():
            self.automaton.add_word(piece, k)
        if number:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> dict[int, int]:
        """Item -> least distance of any of its needles to the text, for those within the budget."""
        found = words(text) if self.words else []
        if not found:
            return {}
        line = f" {' '.join(found)} "
        best: dict[int, int] = {}  # by passage
        seen: set[tuple[int, int]] = set()
        for end, k in self.automaton.iter(line):
            length, n = self.pieces[k]
            start = end - length + 1
            for word in self.uses[self.uses_from[k] : self.uses_from[k + 1]].tolist():
                p = int(self.passage[word])
                if best.get(p) == 0:
                    continue
                for before in self.before[n]:
                    needle = word - before
                    if needle < self.first[p] or needle + self.window > self.first[p + 1]:
                        continue
                    at = start - int(self.place[word] - self.place[needle])
                    if (needle, at) not in seen:
                        seen.add((needle, at))
                        self._verify(line, p, needle, at, best)
        out: dict[int, int] = {}
        for p, distance in best.items():
            for item in self.items[p]:
                out[item] = min(distance, out.get(item, distance))
        return out

    def _verify(self, line: str, p: int, needle: int, at: int, best: dict[int, int]) -> None:
        """Lower the passage's least distance by the needle's to the text around ``at``, if that is less."""
        e = self.budget
        most = min(e, best.get(p, e + 1) - 1)
        if most < 0 or not self._plausible(line, at, needle):
            return
        last = needle + self.window - 1
        own = self.lines[p][int(self.place[needle]) : int(self.place[last]) + len(self.words[last])]
        low, high = max(0, at - e), at + len(own) + e
        distance = myers(own, line[low:high], most)
        if distance == 0 and line.find(f" {own} ", max(0, at - 1), high + 1) < 0:
            distance = 1  # equal text that starts or ends within a longer word
        if distance <= most:
            best[p] = distance

    def _plausible(self, line: str, at: int, needle: int) -> bool:
        """False only if more edits than the budget are certain.

        Matched characters lie within the budget of their place. So a word that isn't found around its place
        holds an edit, which it may share with one neighbour only (a blank between them), and each of its
        letters that doesn't occur around it at all is an edit of its own.
        """
        e, letters, run, shared = self.budget, 0, 0, 0
        base = int(self.place[needle])
        for place, word in zip(self.place[needle : needle + self.window].tolist(), self.words[needle : needle + self.window], strict=True):
            place -= base
            low = at + place - e
            if line.find(word, low if low > 0 else 0, at + place + len(word) + e) >= 0:
                run = 0
                continue
            run += 1
            shared += run & 1
            if shared > e:
                return False
            around = line[low if low > 0 else 0 : at + place + len(word) + e]
            letters += sum(c not in around for c in set(word))
            if letters > e:
                return False
        return True


#: The needles a worker process has built, kept over tasks, the latest used last.
_BUILT: dict[str, Needles] = {}


def _needles(key: str, items, window: int, budget: int) -> Needles:
    needles = _BUILT.pop(key, None) or Needles(items.value, window, budget)
    while len(_BUILT) >= HELD:
        del _BUILT[next(iter(_BUILT))]
    _BUILT[key] = needles
    return needles


class _Search:
    """Texts against all blocks of items: with one block batch by batch, with several over as many batches as may be gathered."""

    def __init__(self, blocks: list[tuple[str, object]], window: int, budget: int, columns: tuple[str, str]) -> None:
        self.blocks, self.window, self.budget, self.columns = blocks, window, budget, columns

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(self.blocks) == 1 or size >= GATHERED:
                yield from self.found(held)
                held, size = [], 0
        if held:
            yield from self.found(held)

    def found(self, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [d for batch in batches for d in batch.column(0).to_pylist()]
        texts = [t for batch in batches for t in batch.column(1).to_pylist()]
        best: list[dict[int, int]] = [{} for _ in docs]
        for key, items in self.blocks:
            needles = _needles(key, items, self.window, self.budget)
            for own, text in zip(best, texts, strict=True):
                for item, distance in needles.search(text).items():
                    own[item] = min(distance, own.get(item, distance))
        rows = [(doc, item, distance) for doc, own in zip(docs, best, strict=True) for item, distance in own.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], batches[0].column(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], [*self.columns, "distance"]
        )


def _blocks(items: list[tuple[int, str | None]]) -> list[list[tuple[int, str | None]]]:
    """Items in blocks of BLOCK_CHARACTERS, a longer one alone."""
    out, size = [[]], 0
    for item in items:
        n = len(item[1] or "")
        if out[-1] and size + n > BLOCK_CHARACTERS:
            out.append([])
            size = 0
        out[-1].append(item)
        size += n
    return out


def leaks(
    documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", passage_column: str = "passage", window: int = WINDOW, budget: int = BUDGET
) -> DataFrame:
    """(doc id, item id, distance): documents with text within ``budget`` edits of ``window`` words of an item.

    distance is the least over all places; 0 means that the words stand there consecutively. Null and empty
    texts and passages, and passages with fewer words than the window, match nothing. Documents are never shuffled and are read
    once for every ITEM_CHARACTERS of passages, which are broadcast in blocks; a worker holds the automata of a few blocks at
    a time. A document that repeats in the input repeats here.
    """
    spark = documents.sparkSession
    own = items.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("bigint").alias("i"), F.col(passage_column).alias("p")).distinct()
    readings = max(1, -(-(own.agg(F.sum(F.length("p"))).first()[0] or 0) // ITEM_CHARACTERS))
    kind = documents.schema[id_column].dataType.simpleString()
    found = None
    for reading in range(readings):
        rows = own if readings == 1 else own.where(F.pmod(F.xxhash64("i"), F.lit(readings)) == reading)
        listed = sorted(((r.i, r.p) for r in rows.collect()), key=lambda x: (x[0], x[1] or ""))  # about ITEM_CHARACTERS
        blocks = [(f"{hash(tuple(b))}-{window}-{budget}", spark.sparkContext.broadcast(b)) for b in _blocks(listed)]
        part = documents.select(id_column, text_column).mapInArrow(_Search(blocks, window, budget, (id_column, item_column)), f"`{id_column}` {kind}, `{item_column}` bigint, distance int")
        found = part if found is None else found.unionByName(part)
    return found
