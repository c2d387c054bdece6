"""Approximate nearest neighbours by stable random projections and a kd-tree.

Vectors are projected to ``M`` Gaussian (2-stable) dimensions, where the ratio of a projected squared distance to the
true one is chi-square distributed with ``M`` degrees of freedom. One kd-tree over the projections holds every vector: its
upper splits come from a sample of at most ``SAMPLE_ROWS`` rows and deal all rows to cells of about ``CELL_ROWS``; below, each
cell has leaves of ``LEAF`` rows. A cell that is larger, as the sample's splits are too few, is dealt to pieces by hash, each with leaves of its own.

A query takes its projected neighbours one after the other, the nearest first, in batches that grow from ``FIRST`` on, and verifies
them by their true score, until the stopping test holds: the chance that a vector which beats the k-th best so far lies
at this projected distance or beyond is under ``1 - confidence``. Leaves and cells whose boxes are beyond that distance are not opened. It goes to
the nearest cell first and carries its k-th best score from cell to cell: next to up to ``NEXT_CELLS`` of the nearest cells, then to all others that the
test leaves open. So about ``confidence`` of the true neighbours are found, at what share of the vectors depends on the data: few where they lie near a
surface of few dimensions, a third to a half where 64 dimensions are independent, as in the given table.

Largest inner product is turned into least distance by one more dimension that lifts all candidates to one norm.
Equal vectors are indexed once, with their k + 1 smallest ids, found by a window whose limit Spark applies before the
shuffle; so a vector that fills a third of the table costs one entry. Equal query vectors are searched once.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with null
id or another dimension than the first (smallest id) row's; a repeated id is one candidate with the best of its vectors, and one query whose
candidates are those of all its vectors; ties go to the smaller id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.session import saved

M = 24
LEAF = 256
#: Projected neighbours that are verified together at first.
FIRST = 64
CELL_ROWS = 4096
SAMPLE_ROWS = 20_000
NEXT_CELLS = 6
#: Queries that a cell handles at a time, and that one group of a cell's queries holds at the mean.
CHUNK_ROWS, GROUP_QUERIES = 2048, 32_768


def chi_square_cdf(x: np.ndarray, dims: int = M) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.zeros_like(x)
    for i in range(dims // 2):
        total += term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def chi_square_quantile(share: float, dims: int = M) -> float:
    low, high = 0.0, 1e4
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(np.array([middle]), dims)[0] < share else (low, middle)
    return high


def kd_leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree that halves the widest dimension."""
    stack, leaves = [np.arange(len(points))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            leaves.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, axis], len(rows) // 2)
        stack += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
    return leaves


#: A tree of splits: (axis, value, left, right), or the number of a cell.
Splits = tuple | int


def kd_splits(points: np.ndarray, n_cells: int) -> Splits:
    """Splits of a sample at medians of the widest dimension into ``n_cells`` cells at most."""
    count = 0

    def build(rows: np.ndarray, cells: int) -> Splits:
        nonlocal count
        if cells > 1 and len(rows) > 1:
            part = points[rows]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            value = float(np.quantile(part[:, axis], (cells // 2) / cells))
            low = part[:, axis] < value
            if low.any() and not low.all():
                return axis, value, build(rows[low], cells // 2), build(rows[~low], cells - cells // 2)
        count += 1
        return count - 1

    return build(np.arange(len(points)), n_cells)


def cells_of(points: np.ndarray, splits: Splits) -> np.ndarray:
    out, stack = np.zeros(len(points), np.int32), [(np.arange(len(points)), splits)]
    while stack:
        rows, node = stack.pop()
        if isinstance(node, int):
            out[rows] = node
        else:
            axis, value, left, right = node
            low = points[rows, axis] < value
            stack += [(rows[low], left), (rows[~low], right)]
    return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all boxes."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[:, d] - points[:, d, None], points[:, d, None] - high[:, d]), 0)
        out += gap**2
    return out


def may_hold(bound: np.ndarray, norms: np.ndarray, kth: np.ndarray, confidence: float) -> np.ndarray:
    """Whether the stopping test does not hold yet, at squared projected distance ``bound`` and k-th best score ``kth``; ``norms``: squared norm of the query plus that of all candidates."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        reach = np.maximum(norms - 2 * kth, 0)
        ratio = np.where(reach > 0, bound / reach, np.where(bound > 0, np.inf, 0.0))
    return ~np.isfinite(kth) | (chi_square_cdf(np.minimum(ratio, 1e6)) < confidence)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def search(vectors: np.ndarray, projected: np.ndarray, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, norms: np.ndarray, k: int, confidence: float) -> tuple[list[np.ndarray], int]:
    """For each query the rows of a cell that belong to its k best (ties too), given the k-th best score from elsewhere; and how many pairs were verified."""
    leaves = kd_leaves(projected)
    rows = np.concatenate(leaves)
    starts = np.cumsum([0, *map(len, leaves)])
    vectors, projected = vectors[rows], projected[rows]  # a leaf's rows stand together
    bound = box_distances(own, np.minimum.reduceat(projected, starts[:-1]), np.maximum.reduceat(projected, starts[:-1]))
    lengths, limit, verified, out = np.einsum("ij,ij->i", projected, projected), chi_square_quantile(confidence), 0, []
    for q, query in enumerate(queries):
        best, stop = np.full(k, kth[q]), limit * max(norms[q] - 2 * kth[q], 0) if np.isfinite(kth[q]) else np.inf
        opened = np.flatnonzero(bound[q] < stop)
        some = np.arange(len(rows)) if len(opened) == len(leaves) else np.concatenate([np.zeros(0, np.int64), *(np.arange(starts[x], starts[x + 1]) for x in opened)])
        distance = np.maximum(lengths[some] - 2 * (projected[some] @ own[q]) + own[q] @ own[q], 0)
        near = distance < stop
        some, distance = some[near], distance[near]
        order = np.argsort(distance, kind="stable")
        some, distance = some[order], distance[order]
        at, size, scores = 0, FIRST, []
        while at < len(some) and (at == 0 or distance[at] < stop):
            batch = some[at : at + size]
            if at:
                batch = batch[: np.searchsorted(distance[at : at + size], stop)]
            scores.append(vectors[batch] @ query)
            at += len(batch)
            size *= 2
            best = np.partition(np.concatenate([best, scores[-1]]), -k)[-k:]
            stop = limit * max(norms[q] - 2 * best.min(), 0) if np.isfinite(best.min()) else np.inf
        verified += at
        scores = np.concatenate(scores) if scores else np.zeros(0)
        least = best.min()
        out.append(rows[some[:at][scores >= least - 1e-9 * abs(least)]] if np.isfinite(least) else rows[some[:at]])
    return out, verified


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 becomes 0.0


def nearest(vectors: DataFrame, k: int = 20, divisor: int = 20, confidence: float = 0.9, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``divisor``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    facts = rows.agg(F.count("*").alias("n"), F.min_by(F.size("v"), "vec_id").alias("dims"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == facts.dims)
    top = facts.norm * (1 + 1e-9)
    planes = np.random.default_rng(seed).standard_normal((facts.dims + 1, M))

    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = saved(rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    asked = rows.where(F.col("vec_id") % divisor == 0).dropDuplicates()
    asked = saved(asked.withColumn("query", F.xxhash64("v")))

    def projection(x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(top**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.hstack([x, lift[:, None]]) @ planes

    # the sample: the rows of the least hashes
    n = distinct.count()
    sample = distinct.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS).toArrow()
    n_cells = max(1, min(-(-n // CELL_ROWS), SAMPLE_ROWS // 8))
    pieces = -(-n // (2 * CELL_ROWS * n_cells))  # of a cell, so that no group grows with the table
    splits = kd_splits(projection(matrix(sample.column("v"))), n_cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = projection(matrix(batch.column("v"))) if batch.num_rows else np.zeros((0, M))
            yield pa.RecordBatch.from_arrays([pa.array(cells_of(p, splits)), batch.column("v"), batch.column("ids"), pa.FixedSizeListArray.from_arrays(p.reshape(-1), M).cast(pa.list_(pa.float64()))], names=["cell", "v", "ids", "p"])

    index = saved(distinct.mapInArrow(place, "cell int, v array<double>, ids array<long>, p array<double>"))
    corner = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(M)]
    boxes = index.groupBy("cell").agg(*corner).orderBy("cell").collect()  # 2 * M numbers a cell, at most SAMPLE_ROWS // 8 cells
    names = np.array([b.cell for b in boxes])
    low, high = (np.array([[b[f"{x}{i}"] for i in range(M)] for b in boxes]) for x in ("low", "high"))

    def visits(start: int, stop: int):
        """Rows (cell, query, v, kth) of the start-th to the stop-th nearest cells of each query, as long as the test does not hold."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q, kth = matrix(batch.column("v")), batch.column("kth").to_numpy(zero_copy_only=False)
                bound = box_distances(q @ planes[:-1], low, high)
                order = np.argsort(bound, axis=1, kind="stable")[:, start:stop]
                on = may_hold(np.take_along_axis(bound, order, 1), (np.einsum("ij,ij->i", q, q) + top**2)[:, None], kth[:, None], confidence)
                row, at = np.nonzero(on)
                some = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(names[order[row, at]].astype(np.int32)), some.column("query"), some.column("v"), some.column("kth")], names=["cell", "query", "v", "kth"])

        return run

    found_kind = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def look(cell: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(cell) and len(asking):
            data, p, ids = matrix(cell.column("v")), matrix(cell.column("p")), cell.column("ids").to_pylist()
            for at in range(0, len(asking), CHUNK_ROWS):
                some = asking.slice(at, CHUNK_ROWS)
                q, kth = matrix(some.column("v")), some.column("kth").to_numpy()
                norms = np.einsum("ij,ij->i", q, q) + top**2
                for name, x, got in zip(some.column("query").to_pylist(), q, search(data, p, q, q @ planes[:-1], kth, norms, k + 1, confidence)[0], strict=True):
                    if len(got):
                        exact = (data[got] * x).sum(axis=1)
                        whose = np.concatenate([ids[i] for i in got]).astype(np.int64)
                        score = np.repeat(exact, [len(ids[i]) for i in got])
                        kept = np.lexsort((whose, -score))[: k + 1]
                        out.append((np.full(len(kept), name), whose[kept], score[kept]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, found_kind.types, strict=True)], schema=found_kind)

    def visited(queries: DataFrame, start: int, stop: int) -> DataFrame:
        """Groups of a cell and some of its queries; a cell goes to the groups that ask for it."""
        rows = queries.mapInArrow(visits(start, stop), "cell int, query long, v array<double>, kth double")
        cells = index.withColumn("group", F.lit(0)).withColumn("piece", F.pmod(F.xxhash64("v"), F.lit(pieces)).cast("int"))
        rows = rows.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(n_groups)).cast("int"))
        if n_groups > 1:
            rows = saved(rows)
            asks = rows.select("cell", F.col("group").alias("asks")).distinct()
            cells = cells.drop("group").join(asks, "cell").withColumnRenamed("asks", "group")
        keys = ["cell", "piece", "group"]
        rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        return cells.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(look, "query long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return saved(found.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("n", rank).where(F.col("n") <= k + 1))

    queries = saved(asked.groupBy("query", "v").agg(F.lit(float("-inf")).alias("kth")))
    n_groups = -(-queries.count() // GROUP_QUERIES)
    found = best(visited(queries, 0, 1))
    for start, stop in ((1, 1 + NEXT_CELLS), (1 + NEXT_CELLS, len(names))):
        if start < len(names):
            kth = found.groupBy("query").agg(F.max(F.when(F.col("n") == k + 1, F.col("score"))).alias("known"))
            queries = queries.join(kth, "query", "left").select("query", "v", F.coalesce("known", "kth").alias("kth"))
            found = best(found.drop("n").unionByName(visited(queries, start, stop)))
    members = asked.select("query", F.col("vec_id").alias("query_id")).join(found.select("query", "vec_id", "score"), "query").where("vec_id <> query_id")
    members = members.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return members.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
