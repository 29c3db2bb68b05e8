"""The most similar vectors of every vector, by additive quantisation.

A vector is approximated by a sum of one codeword from each of several full-dimensional codebooks. Codes
come from a beam search over the residuals; the codebooks are fitted on a bounded sample, every row is
indexed. The first codes of the beam's hypotheses name the cells a vector belongs to; cells that the sample
shows to be large are divided by further codes. Within a cell a query scores all codes by lookup tables
(inner products with the codewords, added up and divided by the stored norm); the best are reranked with the
exact vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.runtime import cut_lineage, hash_sample

#: Rows the codebooks are fitted on: any of the distinct ones among those of the least hashes of their ids. All rows are indexed.
SAMPLE = 16_384
#: Rows beside them at least, if there are any, that tell how far approximations of rows not fitted on are off.
HELD_OUT = 2_048
#: Rows at most that tell how cells are filled: one of TREE_SHARE, at least SAMPLE and HELD_OUT.
TREE_SAMPLE, TREE_SHARE = 131_072, 64
#: Rows of the sample that a cell must have to be divided on their account.
TOLD = 4
BOOKS, WORDS = 16, 64
#: Hypotheses of the beam search, which are also the cells a row is listed in.
BEAM = 5
#: The same where few rows ask, at least and at most; chosen for a recall above 0.9 (measured in tests and by p1_recall).
SEARCH_BEAM = (96, 512)
#: Rows a cell should have; larger ones are divided by further codes, and after the last by salt.
CELL = 384
#: Codes that may name a cell: (WORDS + 1) ** DEPTHS must fit a bigint.
DEPTHS = 10
#: Candidates of a query in a cell that are reranked.
SHORTLIST = 64
#: Distinct vectors whose copies a task counts at a time.
REMEMBERED = 1 << 17
#: A vector that one of so many sampled rows has, and so many of them at least, has its list broadcast to its rows.
HOT_SHARE, HOT_COPIES = 1_000, 8
#: Queries that are compared with all rows at a time where recall is measured.
QUERY_BLOCK = 4_096
#: Deviations of its error that a lookup-table score may lie below the wanted similarity for an exact look.
DEVIATIONS = 4.0


def normalised(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def usable(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the usable embeddings: exactly ``dimensions`` values, none null, NaN or infinite, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    place = np.flatnonzero(lengths == dimensions)
    if not len(place):
        return place, np.zeros((0, dimensions), np.float32)
    flat = column.take(pa.array(place)).flatten()
    values = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # nulls become NaN
    good = np.isfinite(values).all(axis=1) & values.any(axis=1)
    return place[good], np.ascontiguousarray(values[good])


@dataclass
class Quantiser:
    """Codebooks (books, words, dimensions) and, for each depth, the sorted prefixes that are divided further."""

    books: np.ndarray
    divided: list[np.ndarray]
    salts: dict[int, int]
    least: int = 1  # codes that name a cell at least
    spread: float = 0.0  # root mean square tangent between vectors and their approximations

    def slack(self, similarity: float) -> float:
        """How far the score of a pair of that similarity may lie below it: the score's error is the part of one vector
        off the other times the part of the approximation off its vector, two directions independent of each other."""
        off = np.sqrt(max(0.0, 1 - similarity**2))
        return DEVIATIONS * off * self.spread / np.sqrt(max(1, self.shape[2] - 1)) + 2e-3

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.books.shape

    # -- encoding ----------------------------------------------------------
    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(codes n x books, prefixes by depth n x hypotheses): the best codes, and the hypotheses' prefixes, best first."""
        n, (m, k, d) = len(x), self.shape
        residual, cost = x[:, None, :], np.zeros((n, 1), np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        prefixes, depth = [], max(len(self.divided) + 1, self.least)
        prefix = np.zeros((n, 1), np.int64)
        rows = np.arange(n)[:, None]
        for b in range(m):
            book = self.books[b]
            h = residual.shape[1]
            total = (cost[:, :, None] - 2 * (residual.reshape(-1, d) @ book.T).reshape(n, h, k) + (book * book).sum(1)).reshape(n, h * k)
            keep = min(beam if b < depth else min(beam, 2), h * k)
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < h * k else np.tile(np.arange(h * k), (n, 1))
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(total, best, 1), axis=1, kind="stable"), 1)
            parent, word = best // k, best % k
            cost = np.take_along_axis(total, best, 1)
            residual = residual[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
            if b < depth:
                prefix = prefix[rows, parent] * (k + 1) + word + 1
                prefixes.append(prefix)
        return codes[:, 0], prefixes

    def cells(self, prefixes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(home n, listed n x c): the cell each row asks in, and the cells it is listed in (-1: none more).

        The cell of a hypothesis is its shortest prefix that isn't divided.
        """
        k1 = self.shape[1] + 1
        found = []
        for depth, prefix in enumerate(prefixes):
            cell, known = np.full_like(prefix, -1), np.zeros(prefix.shape, bool)
            for up in range(depth, -1, -1):  # from the shortest prefix on
                short = prefix // k1**up
                level = depth - up
                leaf = ~known & (level + 1 >= min(self.least, len(prefixes))) & (~np.isin(short, self.divided[level]) if level < len(self.divided) else True)
                cell[leaf] = short[leaf]
                known |= leaf
            found.append(cell)
        every = np.concatenate(found[::-1], axis=1)
        home = every[:, 0]
        every = every[:, : 2 * prefixes[-1].shape[1]]  # the deepest hypotheses first; a deep tree lists a row in no more cells
        ordered = np.sort(every, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        return home, ordered

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(self.shape[0]))


def _sums(x: np.ndarray, to: np.ndarray, k: int) -> np.ndarray:
    """The sum of the rows of each of k groups."""
    return (to[None, :] == np.arange(k)[:, None]).astype(np.float32) @ x


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
        count = np.bincount(near, minlength=k)
        total = _sums(x, near, k)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
    return centres.astype(np.float32)


def fit(sample: np.ndarray, population: int, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, cell: int = CELL, rounds: int = 8, sweeps: int = 2, seed: int = 7) -> Quantiser:
    """Codebooks from unit vectors: residual k-means, then sweeps of beam encoding and joint refitting of all codewords."""
    rng = np.random.default_rng(seed)
    every, held = sample, sample
    if len(every) > SAMPLE:  # rows come in any order, even sorted
        order = np.random.default_rng(seed).permutation(len(every))
        sample, held = every[order[:SAMPLE]], every[order[SAMPLE : 2 * SAMPLE]]
    residual, made = sample.copy(), []
    for _ in range(books):
        book = _means(residual, words, rounds, rng)
        near = np.argmin((book * book).sum(1) - 2 * (residual @ book.T), axis=1)
        residual = residual - book[near]
        made.append(book)
    q = Quantiser(np.stack(made), [], {})
    for _ in range(sweeps):
        codes, _ = q.encode(sample, beam)
        error = sample - q.decode(codes)
        for b in range(books):
            target = error + q.books[b][codes[:, b]]
            count = np.bincount(codes[:, b], minlength=words)
            total = _sums(target, codes[:, b], words)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], q.books[b]).astype(np.float32)
            error = target - book[codes[:, b]]
            q.books[b] = book
    codes, _ = q.encode(held, beam)
    near = q.decode(codes)
    cosine = np.einsum("ij,ij->i", held, near) / np.maximum(np.linalg.norm(near, axis=1), 1e-6)
    q.spread = float(np.sqrt(np.mean(1 / np.clip(cosine, 0.1, 1.0) ** 2 - 1)))
    # Cells that the sample doesn't tell about have as many codes as an even spread would need.
    q.least = max(1, min(books, DEPTHS, int(np.log(max(population / cell, 1)) / np.log(max(words, 2)))))
    # The tree of cells: a prefix is divided while the sample says that more than ``cell`` rows have it.
    scale = population / len(every)
    depths = min(books, DEPTHS)
    q.divided = [np.zeros(0, np.int64)] * (depths - 1)
    parts = [q.encode(every[i : i + 8192], beam)[1] for i in range(0, len(every), 8192)]
    prefixes = [np.concatenate(p) for p in zip(*parts, strict=True)]
    q.divided = []
    for depth, prefix in enumerate(prefixes):
        own = prefix[:, 0]
        if depth:
            own = own[np.isin(own // (words + 1), q.divided[-1])]
        values, count = np.unique(own, return_counts=True)
        large = values[(count * scale > cell) & (count >= TOLD)] if depth < depths - 1 else values[:0]
        # What is still large and isn't divided, too few rows of the sample telling how or no code being left, is salted.
        whole = ~np.isin(values, large)
        q.salts |= {int(p): int(-(-c * scale // (4 * cell))) for p, c in zip(values[whole], count[whole], strict=True) if c * scale > 4 * cell}
        if len(large):
            q.divided.append(large)
        else:
            break
    return q


#: Columns of the rows that meet in a cell. side: salt * 2, plus 1 for rows that ask. mark: half of the print of the
#: vector (two hashes of it). payload: codes and norm of a listed row, print and half-precision vector of one that asks.
_CELL_SCHEMA = "cell bigint, side int, mark bigint, id bigint, payload binary"


class _ToCells:
    """Rows (id, embedding, print) -> the rows that meet in cells.

    A task keeps the ``copies`` least ids of each distinct vector as listed rows and one row that asks: of
    equal vectors no other can be among the nearest when ties go to the least id. So copies of one
    vector, however many, shuffle a few rows for each task.
    """

    def __init__(self, quantiser, dimensions: int, copies: int, every_cell_asks: bool, role: str, beam: int) -> None:
        self.quantiser, self.dimensions, self.copies, self.every_cell_asks, self.role, self.beam = quantiser, dimensions, copies, every_cell_asks, role, beam

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = self.quantiser.value
        seen: dict[tuple[int, int], set[int]] = {}
        for batch in batches:
            place, raw = usable(batch.column(1), self.dimensions)
            ids = batch.column(0).take(pa.array(place)).to_numpy(zero_copy_only=False)
            prints = np.stack([batch.column(i).take(pa.array(place)).to_numpy(zero_copy_only=False) for i in (2, 3)], axis=1)
            keep = []
            for i, (p, key) in enumerate(zip(map(tuple, prints.tolist()), ids.tolist(), strict=True)):
                if len(seen) >= REMEMBERED and p not in seen:
                    seen.clear()  # costs a few more rows of vectors with copies, nothing else
                own = seen.setdefault(p, set())
                if len(own) < self.copies:
                    if key not in own:
                        own.add(key)
                        keep.append(i)
                elif key < (most := max(own)) and key not in own:  # an earlier id takes the place of a later one
                    own.remove(most)
                    own.add(key)
                    keep.append(i)
            step = min(2048, max(64, 40_000 // self.beam))  # a wide beam takes few rows at a time
            for start in range(0, len(keep), step):
                part = np.array(keep[start : start + step])
                yield from self.rows(q, ids[part], np.ascontiguousarray(prints[part]), normalised(raw[part]))

    def rows(self, q: Quantiser, ids: np.ndarray, prints: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes, prefixes = q.encode(x, self.beam)
        home, listed = q.cells(prefixes)
        norm = np.einsum("ij,ij->i", x, q.decode(codes)).astype(np.float32)
        out: list[tuple] = []
        if "listed" in self.role:
            r, c = (np.arange(len(ids)), None) if self.every_cell_asks else np.nonzero(listed >= 0)
            out.append((home if c is None else listed[r, c], r, 0))
        if "asks" in self.role:
            r, c = np.nonzero(listed >= 0) if self.every_cell_asks else (np.arange(len(ids)), None)
            out.append((home if c is None else listed[r, c], r, 1))
        marks = np.ascontiguousarray(prints[:, 0])
        for cell, row, kind in out:
            n = np.array([q.salts.get(c, 1) for c in cell.tolist()]) if q.salts else np.ones(len(cell), int)
            if kind:  # asks in every salt of the cell
                salt = np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, int)
                cell, row = np.repeat(cell, n), np.repeat(row, n)
                own = [p.tobytes() + v.tobytes() for p, v in zip(prints, x.astype(np.float16), strict=True)]
            else:
                salt = marks[row] % n
                own = [c.tobytes() + v.tobytes() for c, v in zip(codes, norm, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int64()), pa.array((salt * 2 + kind).astype(np.int32)), pa.array(marks[row]), pa.array(ids[row], pa.int64()), pa.array([own[r] for r in row], pa.binary())],
                ["cell", "side", "mark", "id", "payload"],
            )


class _Score:
    """Streams rows sorted by (cell, side, mark, id); yields (asks, h1, h2, near, score) of promising pairs."""

    def __init__(self, quantiser, floor: float, shortlist: int, copies: int) -> None:
        self.quantiser, self.floor, self.shortlist, self.copies = quantiser, floor, shortlist, copies

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = self.quantiser.value
        held: list[pa.RecordBatch] = []
        open_cell = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy() >> 1
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1])])
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if (cell[a], salt[a]) != open_cell:
                    if held:
                        yield from self.scored(q, pa.Table.from_batches(held))
                    held, open_cell = [], (cell[a], salt[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from self.scored(q, pa.Table.from_batches(held))

    def scored(self, q: Quantiser, table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        kind, marks, ids = table["side"].to_numpy() & 1, table["mark"].to_numpy(), table["id"].to_numpy()
        split = int(np.searchsorted(kind, 1))
        if not split or split == len(kind):
            return
        # Listed: of each vector the least ids, each once. Asking: the least id of each vector.
        fresh = np.r_[True, (marks[1:split] != marks[: split - 1]) | (ids[1:split] != ids[: split - 1])]
        unique = np.flatnonzero(fresh)
        first = np.r_[True, marks[unique][1:] != marks[unique][:-1]]
        group = np.cumsum(first) - 1
        rank = np.arange(len(unique)) - np.flatnonzero(first)[group]
        size = np.bincount(group)[group]
        keep = rank < self.copies
        listed, size = unique[keep], size[keep]
        asking = split + np.flatnonzero(np.r_[True, marks[split + 1 :] != marks[split:-1]])
        m, k, d = q.shape
        payload = table["payload"]
        raw = np.frombuffer(b"".join(payload.take(pa.array(listed)).to_pylist()), np.uint8).reshape(len(listed), m + 4)
        at = raw[:, :m].astype(np.int64) + np.arange(m) * k
        norm = np.ascontiguousarray(raw[:, m:]).view(np.float32).ravel()
        weight = 1 / np.where(norm > 1e-3, norm, 1e-3)
        asked = payload.take(pa.array(asking)).to_pylist()
        queries = np.frombuffer(b"".join([p[16:] for p in asked]), np.float16).reshape(-1, d).astype(np.float32)
        prints = np.frombuffer(b"".join([p[:16] for p in asked]), np.int64).reshape(-1, 2)
        near, near_mark = ids[listed], marks[listed]
        books = q.books.reshape(m * k, d).T
        for a in range(0, len(asking), 256):
            own = asking[a : a + 256]
            tables = queries[a : a + 256] @ books  # (queries, books * words): the lookup tables
            for b in range(0, len(listed), 65_536):
                part = at[b : b + 65_536]
                score = tables[:, part[:, 0]]
                for j in range(1, m):
                    score += tables[:, part[:, j]]
                score *= weight[b : b + 65_536]
                r, c = self.promising(score)
                other = (near_mark[c + b] != marks[own[r]]) | (size[c + b] > 1)  # a vector without copies needn't meet itself
                r, c = r[other], c[other]
                if len(r):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[own[r]], pa.int64()), pa.array(prints[a + r, 0]), pa.array(prints[a + r, 1]), pa.array(near[c + b], pa.int64()), pa.array(score[r, c])],
                        ["asks", "h1", "h2", "near", "score"],
                    )

    def promising(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of at most ``shortlist`` scores of each row that reach the floor."""
        many = self.shortlist + self.copies
        if np.isfinite(self.floor):
            hit = score >= self.floor
            if hit.sum(1).max(initial=0) <= many:
                return np.nonzero(hit)
        if score.shape[1] > many:
            best = np.argpartition(-score, many - 1, axis=1)[:, :many]
        else:
            best = np.tile(np.arange(score.shape[1]), (len(score), 1))
        r = np.repeat(np.arange(len(score)), best.shape[1])
        c = best.ravel()
        keep = score[r, c] >= self.floor
        return r[keep], c[keep]


class _Exact:
    """(h1, h2, near, a, b) -> the exact cosine of the embeddings a and b in place of them."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dimensions).astype(np.float64) for i in (3, 4))
            cosine = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.clip(cosine, -1, 1))], ["h1", "h2", "near", "similarity"])


def _base(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, h1, h2): rows with an id and a vector, and two hashes of it, which are the same for equal vectors and hardly for others."""
    base = rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return base.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def nearest(
    rows: DataFrame, k: int, id_column: str = "id", vector_column: str = "embedding", dimensions: int = 64, queries: DataFrame | None = None,
    min_similarity: float | None = None, sample: int | None = None, beam: int | None = None, shortlist: int = SHORTLIST, cell: int = CELL,
) -> DataFrame:
    """(id, near, similarity, place): for each usable vector its k most similar others by cosine, place from 1.

    queries: the rows that ask (a subset of rows' ids with the same columns); all if None. min_similarity:
    leave out less similar ones. Ties go to the least id. Unusable vectors (null, other width, null, NaN or
    infinite values, all zero) neither ask nor are found. Rows of equal id are copies and count once. Empty
    input gives an empty result. sample: rows to fit on, by default SAMPLE for the codebooks and up to TREE_SAMPLE for the
    cells; SAMPLE of them, whichever way they are sorted, fit the codebooks. The result is approximate in which candidates are seen; every similarity is exact.

    beam: hypotheses of the rows that ask, by default BEAM, or as many as ``search_beam`` says if there are queries.

    If all rows ask, every row's codes (a few bytes) go to the cells of all its hypotheses and its vector asks in its
    home cell only; with few queries these ask in all their cells instead. Cells hold about ``cell`` rows, so the
    work is proportional to the number of rows. Vectors are shuffled twice: in half precision to score, in full to rerank.
    """
    spark = rows.sparkSession
    base = _base(rows, id_column, vector_column)
    sized = base.where(F.size("v") == dimensions)
    population = sized.count()
    wanted = sample or min(TREE_SAMPLE, max(SAMPLE + HELD_OUT, population // TREE_SHARE))
    picked = hash_sample(sized, "id", wanted, population).select("v", "h1", "h2").toArrow()
    place, raw = usable(picked["v"], dimensions)
    schema = "id bigint, near bigint, similarity double, place int"
    if not len(raw):
        return spark.createDataFrame([], schema)
    # Copies share all codes and are listed a few times only: they needn't divide cells.
    distinct = np.unique(normalised(raw), axis=0)
    fitted = fit(distinct, -(-population * len(distinct) // len(raw)), words=min(WORDS, len(distinct)), cell=cell)
    quantiser = spark.sparkContext.broadcast(fitted)
    if beam is None:
        beam = BEAM if queries is None else search_beam(population)
    copies = k + 1
    if queries is None:
        met = base.mapInArrow(_ToCells(quantiser, dimensions, copies, False, "listed asks", beam), _CELL_SCHEMA)
        asking = base
    else:
        asking = _base(queries, id_column, vector_column)
        met = base.mapInArrow(_ToCells(quantiser, dimensions, copies, True, "listed", BEAM), _CELL_SCHEMA).unionByName(
            asking.mapInArrow(_ToCells(quantiser, dimensions, copies, True, "asks", beam), _CELL_SCHEMA)
        )
    floor = -np.inf if min_similarity is None else min_similarity - fitted.slack(min_similarity)
    # A row asks or is listed in one cell only, whichever way, so a pair comes out once. Of equal vectors, whose cells
    # are equal too, the least id stands for all.
    pairs = (
        met.repartition("cell", F.col("side").bitwiseAND(-2))
        .sortWithinPartitions("cell", "side", "mark", "id")
        .mapInArrow(_Score(quantiser, floor, shortlist, copies), "asks bigint, h1 bigint, h2 bigint, near bigint, score float")
    )
    if min_similarity is None:
        best = Window.partitionBy("asks").orderBy(F.desc("score"), "near")
        pairs = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= shortlist + copies)
    vectors = base.select("id", "v").dropDuplicates(["id"])
    exact = (
        pairs.join(vectors.withColumnsRenamed({"id": "asks", "v": "a"}), "asks")
        .join(vectors.withColumnsRenamed({"id": "near", "v": "b"}), "near")
        .select("h1", "h2", "near", "a", "b")
        .mapInArrow(_Exact(dimensions), "h1 bigint, h2 bigint, near bigint, similarity double")
    )
    if min_similarity is not None:
        exact = exact.where(F.col("similarity") >= min_similarity)
    # One list for each vector, one longer than asked for: each of its rows leaves itself out.
    ranked = F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), "near")))
    lists = exact.groupBy("h1", "h2").agg(F.slice(ranked, 1, k + 1).alias("top"))
    members = asking.select("id", "h1", "h2").dropDuplicates(["id"])
    hot = _hot_prints(picked, place)
    if hot:  # lists of vectors with very many copies go to their rows, which stay where they are
        few = F.broadcast(spark.createDataFrame(hot, "h1 bigint, h2 bigint"))
        lists = cut_lineage(lists)
        met = members.join(F.broadcast(lists.join(few, ["h1", "h2"], "left_semi")), ["h1", "h2"]).unionByName(members.join(few, ["h1", "h2"], "left_anti").join(lists, ["h1", "h2"]))
    else:
        met = members.join(lists, ["h1", "h2"])
    others = F.slice(F.filter("top", lambda x: x["near"] != F.col("id")), 1, k)
    return met.select("id", F.posexplode(others).alias("at", "x")).select("id", "x.near", (-F.col("x.s")).alias("similarity"), (F.col("at") + 1).alias("place"))


def search_beam(population: int) -> int:
    """Hypotheses of rows that ask where few do, which are the cells they ask in: more as there are more cells."""
    return min(SEARCH_BEAM[1], max(SEARCH_BEAM[0], int(population**0.5 / 2.5)))


def _hot_prints(picked: pa.Table, place: np.ndarray) -> list[tuple[int, int]]:
    """The prints of vectors that a thousandth of the sampled rows or more have: at most HOT_SHARE."""
    prints = np.stack([picked[c].take(pa.array(place)).to_numpy() for c in ("h1", "h2")], axis=1)
    values, count = np.unique(prints, axis=0, return_counts=True)
    return [(int(a), int(b)) for (a, b), n in zip(values, count, strict=True) if n >= HOT_COPIES and n * HOT_SHARE >= len(place)]


class _Brute:
    """(id, v) against a block of queries: the k most similar of the rows of a task for each query."""

    def __init__(self, queries, dimensions: int, k: int) -> None:
        self.queries, self.dimensions, self.k = queries, dimensions, k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, q = self.queries.value
        most = 2 * self.k  # twice: a row may come again in a later batch
        ids, scores = np.full((len(asks), most), -1, np.int64), np.full((len(asks), most), -2.0)
        for batch in batches:
            place, raw = usable(batch.column(1), self.dimensions)
            own = batch.column(0).take(pa.array(place)).to_numpy(zero_copy_only=False)
            own, first = np.unique(own, return_index=True)
            x = raw[first].astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for a in range(0, len(asks), 128):  # few queries at a time: their scores are held together
                b = min(a + 128, len(asks))
                score = q[a:b] @ x.T
                score[asks[a:b, None] == own[None, :]] = -2.0
                best = np.argpartition(-score, most - 1, axis=1)[:, :most] if score.shape[1] > most else np.broadcast_to(np.arange(score.shape[1]), score.shape)
                near, value = np.concatenate([ids[a:b], own[best]], axis=1), np.concatenate([scores[a:b], np.take_along_axis(score, best, 1)], axis=1)
                order = np.lexsort((near, -value), axis=1)[:, :most]
                ids[a:b], scores[a:b] = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        r, c = np.nonzero(scores > -1.5)
        yield pa.RecordBatch.from_arrays([pa.array(asks[r]), pa.array(ids[r, c]), pa.array(scores[r, c])], ["id", "near", "similarity"])


def brute_force(rows: DataFrame, queries: DataFrame, k: int, id_column: str = "id", vector_column: str = "embedding", dimensions: int = 64) -> DataFrame:
    """(id, near, similarity): the k most similar rows of each query by comparing it with all, to measure recall by.

    Queries go through in blocks of about QUERY_BLOCK, each broadcast; rows are read once a block and only each task's best are shuffled.
    """
    spark = rows.sparkSession
    base, asking = _base(rows, id_column, vector_column).select("id", "v"), _base(queries, id_column, vector_column).select("id", "v").where(F.size("v") == dimensions).dropDuplicates(["id"])
    found = None
    blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    for block in range(blocks):
        got = asking.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        place, raw = usable(got["v"], dimensions)
        x = raw.astype(np.float64)
        held = spark.sparkContext.broadcast((got["id"].take(pa.array(place)).to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)))
        part = base.mapInArrow(_Brute(held, dimensions, k), "id bigint, near bigint, similarity double")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "near")
    return found.groupBy("id", "near").agg(F.max("similarity").alias("similarity")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
