"""Exact top-k inner products by pivot-table elimination.

Vectors become whole numbers, floor(256 x). The index keeps each vector's length and its distances to `PIVOTS` pivots, rows of a bounded sample picked one
after the other, each the farthest from the span of those before. A distance d bounds an inner product: 2 q.x = |q|^2 + |x|^2 - d(q, x)^2.
The table gives two lower bounds of d(q, x), and the larger counts: the largest |d(q, p) - d(x, p)| over the pivots, and the distance of the
projections of both onto the pivots' span, which their distances to the pivots determine, together with the difference of what is left of
either length. Rows are evaluated in the order of that bound, a run at a time, until no bound left reaches the query's k-th score. The products
themselves are exact whole numbers; bounds get a slack far above the rounding of the numbers that they are made of. The second bound is never
the smaller one, for the pivots lie in their span: it alone is taken for whole tiles of queries and rows, where it is one matrix product.

Queries and rows are packed into blocks, dealt out to the lines and columns of a grid, and meet in its cells by one shuffle on the cell's number.
A cell is one task's: it holds its rows, as many as fit `SLAB` bytes, and takes its blocks of queries one after the other. The cells are so few
that all copies of blocks together stay in proportion to the vectors. There is no join, so none that copies could be broadcast for, and no block
goes through the driver.

Nulls, ties and odd input: vectors that are null or hold a null or non-finite component, and rows without an id, take no part;
vectors of different length are compared as if the shorter ended in zeros; ties go to the smaller id; rows that repeat an id are candidates each, and
a query is one row per id (the largest vector in array order) that skips every row of its own id. Scores outside 64 bits are cut to them.
Where squares leave the range of doubles nothing is eliminated. Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from workpulse.llm.storage import stored

K = 5
EVERY = 50  # queries are the rows whose id is divisible by it
SCALE = 256.0
PIVOTS = 48
SAMPLE = 2000  # rows that pivots are picked from
ROWS, QUERIES = 4096, 1024  # of a block
RUN = 128  # rows evaluated at once in the order of their bounds
EXACT = 1 << 53  # whole numbers up to it are exact doubles
SINGLE = 1 << 24  # and up to it exact single floats
SLAB = 64 << 20  # bytes of the rows that a task holds
COPIES = 8  # of each row, queries' copies counted as such, to keep more tasks busy
STRIP, TILE = 256, 4096  # queries and rows whose bounds are looked at together
DENSE = 32  # from one in so many pairs on, the products of all pairs of a tile are made
GATHERED = 8 << 20  # bytes of vectors that are put side by side for their products


def _whole(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: the whole numbers of the vectors that take part, as doubles."""
    # floor() of a double is a bigint and would cut very large components; they are whole numbers as they are.
    scaled = lambda c: F.lit(SCALE) * c.cast("double")
    whole = lambda c: F.when(F.abs(c.cast("double")) < F.lit(float(1 << 50)), F.floor(scaled(c)).cast("double")).otherwise(scaled(c))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(SCALE) * c.cast("double")) < F.lit(float("inf"))))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    return good.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", whole).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    out = np.zeros((len(column), width))
    lengths = column.value_lengths().to_numpy()
    inside = np.arange(width) < lengths[:, None]
    out[inside] = column.flatten().to_numpy()
    return out


def _packed(rows: DataFrame, size: int, groups: int, width: int, kind: type) -> DataFrame:
    """``n, ids, v, line`` of blocks of up to ``size`` rows, dealt out in turn to ``groups`` lines."""

    def pack(batches):
        line = TaskContext.get().partitionId() * 0x9E3779B1 % (1 << 32) % groups
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                ids, v = part.column(0).to_numpy().astype("<i8"), _matrix(part.column(1), width).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([v.tobytes()]), pa.array([line], pa.int32())], ["n", "ids", "v", "line"])
                line = (line + 1) % groups

    return rows.select("vec_id", "v").mapInArrow(pack, "n int, ids binary, v binary, line int")


def _grid(count: int, asked: int, most: int, tasks: int) -> tuple[int, int]:
    """Lines of rows and columns of queries: no line of more than ``most`` rows, and cells for ``tasks`` unless they would be tiny or copies many.

    Each row is copied to every column and each query to every line; the best grid of ``n`` cells makes 2 sqrt(n count asked) copies.
    """
    tasks = max(1, min(tasks, -(-count * asked // (ROWS * QUERIES)), (COPIES // 2) ** 2 * count // asked))
    lines = max(-(-count // most), min(tasks, round((tasks * count / asked) ** 0.5)), 1)
    return lines, -(-tasks // lines)


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of one vector with rows, as int64."""
    if exact:
        return (x @ q).astype(np.int64)
    wide = x.astype(object)
    whole = np.array([[int(c) for c in row] for row in wide], object).reshape(x.shape) @ np.array([int(c) for c in q], object)
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in whole], np.int64)


def _better(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores.astype(np.float64) if np.abs(scores).max(initial=0) < EXACT else -scores.astype(object)))[:k] if len(scores) else []
    return scores[order], ids[order]


class Pivots:
    """Rows of ``sample``, each the farthest from the span of those before; those that add nearly nothing are left out."""

    def __init__(self, sample: np.ndarray, most: int = PIVOTS):
        rest, picked = sample.copy(), []
        squares = (rest * rest).sum(1)
        least = 1e-4 * squares.max(initial=0)
        for _ in range(min(most, *sample.shape)):
            at = int(squares.argmax())
            if squares[at] <= least or not squares[at] > 0:
                break
            picked.append(at)
            along = rest[at] / np.sqrt(squares[at])
            rest -= np.outer(rest @ along, along)
            squares = (rest * rest).sum(1)
        self.rows = sample[picked]
        self.squares = (self.rows * self.rows).sum(1)
        # The inverse of the pivots' triangular factor turns products with the pivots into coordinates of the projection.
        self.turn = np.linalg.inv(np.linalg.cholesky(self.rows @ self.rows.T)).T if picked else np.zeros((0, 0))

    def table(self, v: np.ndarray) -> np.ndarray:
        """Squared length of each row, then its distances to the pivots."""
        squares = (v * v).sum(1)
        return np.column_stack([squares, np.sqrt(np.maximum(squares[:, None] + self.squares - 2 * v @ self.rows.T, 0))])


class Block:
    """Some rows with their part of the pivot table."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, table: np.ndarray, pivots: Pivots):
        self.ids, self.v, self.squares, self.far = ids, v, table[:, 0], table[:, 1:]
        self.inside = (self.squares[:, None] + pivots.squares - self.far**2) / 2 @ pivots.turn  # coordinates of the projection onto the span
        self.left = np.sqrt(np.maximum(self.squares - (self.inside * self.inside).sum(1), 0))

    def highest(self, square: float, far: np.ndarray, inside: np.ndarray, left: float) -> np.ndarray:
        """The largest product that each row can have with a query of which this is known."""
        around = ((self.inside - inside) ** 2).sum(1) + (self.left - left) ** 2
        if len(far):
            around = np.maximum(around, np.abs(self.far - far).max(1) ** 2)
        out = (square + self.squares - around) / 2 + 1e-6 * (square + self.squares + 1)
        return np.where(np.isfinite(out), out, np.inf)

    def factors(self) -> np.ndarray:
        """Products of these rows with the `Slab.asking` ones of queries are the highest products of both."""
        return np.column_stack([self.inside, self.left, np.ones(len(self.ids)), self.squares])

    def search(self, queries: "Block", best: dict, k: int, exact: bool) -> int:
        """Bring the ``best`` scores of each query up to date; give the number of rows that were evaluated."""
        if exact:
            kind = _kind(max(self.squares.max(initial=0), queries.squares.max(initial=0)))
            asked = Slab([queries], kind)
            scores, owners = asked.nothing(k)
            for i, q in enumerate(asked.ids.tolist()):
                had = best.get(q, ((), ()))
                scores[i, : len(had[0])], owners[i, : len(had[0])] = had
            evaluated = Slab([self], kind).search(asked, scores, owners)
            for i, q in enumerate(asked.ids.tolist()):
                there = np.isfinite(scores[i])
                best[q] = (scores[i, there].astype(np.int64), owners[i, there])
            return evaluated
        evaluated = 0
        for i, q in enumerate(queries.ids.tolist()):
            scores, owners = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            vector = queries.v[i]
            highest = self.highest(queries.squares[i], queries.far[i], queries.inside[i], queries.left[i])
            order = np.argsort(-highest, kind="stable")
            for at in range(0, len(order), RUN):
                run = order[at : at + RUN]
                if len(scores) == k:
                    run = run[highest[run] >= scores[-1]]
                    if not len(run):
                        break
                evaluated += len(run)
                run = run[self.ids[run] != q]
                products = _products(vector, self.v[run], exact)
                if len(scores) == k:
                    good = products >= scores[-1]
                    products, run = products[good], run[good]
                if len(run):
                    scores, owners = _better(np.concatenate([scores, products]), np.concatenate([owners, self.ids[run]]), k)
            best[q] = (scores, owners)
        return evaluated


def _kind(largest: float) -> type:
    """The floats that are exact for products of whole vectors up to this squared length, and for every partial sum of them."""
    return np.float32 if largest * 4 < SINGLE else np.float64


def _merge(scores: np.ndarray, owners: np.ndarray, at: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
    """Put scores that were ``found``, ``at`` says for which query, among the best of each."""
    k, touched = scores.shape[1], np.unique(at)
    who = np.concatenate([np.repeat(touched, k), at])
    found, ids = np.concatenate([scores[touched].ravel(), found]), np.concatenate([owners[touched].ravel(), ids])
    order = np.lexsort((ids, -found, who))
    taken = order[np.searchsorted(who[order], touched)[:, None] + np.arange(k)]
    scores[touched], owners[touched] = found[taken], ids[taken]


class Slab:
    """The rows of some blocks in the order of their ids, for bounds and products of whole tiles. The products must be exact in ``kind``."""

    def __init__(self, blocks, kind: type):
        parts = [(b.ids, b.v.astype(kind), b.factors().astype(kind)) for b in blocks]
        self.ids = np.concatenate([p[0] for p in parts])
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.v, self.factors = self.ids[order], np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order]

    def nothing(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and their owners for each row as a query that has met none."""
        return np.full((len(self.ids), k), -np.inf), np.full((len(self.ids), k), np.iinfo(np.int64).max)

    def asking(self) -> np.ndarray:
        """The factors of queries; with the last two, a slack for rounding is part of the product."""
        out, slack = self.factors.copy(), 1e-5 if self.factors.dtype == np.float32 else 1e-6
        out[:, -2], out[:, -1] = slack * (self.factors[:, -1] + 1), slack
        return out

    def search(self, queries: "Slab", scores: np.ndarray, owners: np.ndarray) -> int:
        """Bring the best ``scores`` and their ``owners``, a line for each query, up to date; give the number of rows that were evaluated."""
        evaluated, asking = 0, queries.asking()
        for i in range(0, len(queries.ids), STRIP):
            strip = slice(i, i + STRIP)
            for j in range(0, len(self.ids), TILE):
                tile = slice(j, j + TILE)
                highest = asking[strip] @ self.factors[tile].T
                evaluated += _meet(highest, queries.ids[strip], queries.v[strip], self.ids[tile], self.v[tile], scores[strip], owners[strip])
        return evaluated


def _dots(q: np.ndarray, x: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows of both."""
    out, size = np.empty(len(at)), max(1, GATHERED // (x.itemsize * x.shape[1]))
    for i in range(0, len(at), size):
        out[i : i + size] = np.einsum("ij,ij->i", q[at[i : i + size]], x[row[i : i + size]])
    return out


def _meet(highest: np.ndarray, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, scores: np.ndarray, owners: np.ndarray) -> int:
    """Bring the best of some queries up to date with some rows, by the ``highest`` product of each pair; give the number of pairs evaluated."""
    begins, ends = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    for i in np.flatnonzero(begins < ends):
        highest[i, begins[i] : ends[i]] = -np.inf  # rows of its own
    evaluated = 0
    if len(new := np.flatnonzero(np.isneginf(scores[:, -1]))):
        # A query without a k-th score gets one from the run of its highest bounds.
        size = min(RUN, len(ids))
        row = np.argpartition(highest[new], -size, axis=1)[:, -size:].ravel()
        at = np.repeat(new, size)
        other = highest[at, row] > -np.inf
        at, row = at[other], row[other]
        _merge(scores, owners, at, _dots(q, x, at, row), ids[row])
        highest[at, row] = -np.inf
        evaluated += len(at)
    least = np.maximum(scores[:, -1:], np.finfo(highest.dtype).min).astype(highest.dtype)
    reach = highest >= least
    left = np.count_nonzero(reach)
    if left * DENSE > reach.size:
        products = q @ x.T
        reach &= products >= least
        at, row = np.divmod(np.flatnonzero(reach), len(ids))
        found = products[at, row].astype(np.float64)
    else:
        at, row = np.divmod(np.flatnonzero(reach), len(ids))
        found = _dots(q, x, at, row)
    last = scores[at, -1]
    better = (found > last) | (found == last) & (ids[row] < owners[at, -1])
    if better.any():
        _merge(scores, owners, at[better], found[better], ids[row[better]])
    return evaluated + left


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each query."""
    spark = vectors.sparkSession
    rows = stored(_whole(vectors), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm), F.sum((F.col("vec_id") % every == 0).cast("bigint"))).first()
    schema = "query_id bigint, vec_id bigint, score bigint"
    if not facts[0] or not facts[3]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    count, width, largest, asked = facts[0], max(1, facts[1]), facts[2], facts[3]
    # By Cauchy-Schwarz the largest squared norm bounds every product and every partial sum of squares of it.
    exact = largest * 4 < EXACT and np.isfinite(largest)
    kind = _kind(largest) if exact else np.float64
    narrow = next((t for t in (np.int16, np.int32) if largest < float(np.iinfo(t).max) ** 2), np.float64)  # holds the components of all vectors
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    pivots = Pivots(_matrix(sample, width) if np.isfinite(largest * 4) else np.zeros((0, width)))

    most = max(1, SLAB // (np.dtype(kind).itemsize * (width + min(width, PIVOTS) + 4)))
    lines, columns = _grid(count, asked, most, 4 * spark.sparkContext.defaultParallelism)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    along = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Many blocks in each line, so that lines are even.
    held = _packed(rows, max(1, min(ROWS, count // (8 * lines))), lines, width, narrow).withColumn("column", along(columns)).withColumn("asked", F.lit(False))
    asking = _packed(queries, QUERIES, columns, width, narrow).withColumnRenamed("line", "column").withColumn("line", along(lines)).withColumn("asked", F.lit(True))
    both = held.unionByName(asking).select((F.col("line") * columns + F.col("column")).alias("cell"), "asked", "n", "ids", "v")
    met = both.repartitionById(lines * columns, F.col("cell")).sortWithinPartitions("cell", "asked")

    def block(parts):
        ids = np.concatenate([np.frombuffer(p["ids"], "<i8") for p in parts])
        v = np.concatenate([np.frombuffer(p["v"], narrow).reshape(p["n"], width) for p in parts]).astype(np.float64)
        return Block(ids, v, pivots.table(v), pivots)

    def answers(rows_held, parts):
        if exact:
            waiting = Slab([block(parts)], kind)
            scores, owners = waiting.nothing(k)
            rows_held.search(waiting, scores, owners)
            at, place = np.nonzero(np.isfinite(scores))
            found = waiting.ids[at], owners[at, place], scores[at, place].astype(np.int64)
        else:
            best = {}
            rows_held.search(block(parts), best, k, exact)
            found = np.repeat([*best], [len(s) for s, _ in best.values()]), *(np.concatenate([b[i] for b in best.values()]) for i in (1, 0))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    def evaluate(batches):
        cell, parts, waiting, rows_held = None, [], [], None
        for part in (p for batch in batches for p in batch.to_pylist()):
            if part["cell"] != cell:
                if waiting:
                    yield answers(rows_held, waiting)
                cell, parts, waiting, rows_held = part["cell"], [], [], None
            if not part["asked"]:
                parts.append(part)
                continue
            if parts:
                rows_held, parts = Slab((block([p]) for p in parts), kind) if exact else block(parts), []
            if rows_held is None:
                continue
            waiting.append(part)
            if sum(p["n"] for p in waiting) >= QUERIES:
                yield answers(rows_held, waiting)
                waiting = []
        if waiting:
            yield answers(rows_held, waiting)

    near = met.mapInArrow(evaluate, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
