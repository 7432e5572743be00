"""Exact top-k by inner product with multi-resolution segment statistics.

Each vector is cut into segments; a segment's mean and deviation bound from below its share of
the squared distance to another vector, and so, the norms being known, bound the inner product
from above.  Bounds over few long segments come first, over more short ones for what is left,
and exact products only for pairs whose bound reaches the query's k-th best score so far.

Rows lie in blocks of like coarse statistics.  Every query first meets the block it lies in
itself; its k-th best score there is what others must reach.  The statistics of two blocks
(ranges of the segment means, greatest deviations) bound all products between them: only pairs
of blocks whose bound reaches the least of the queries' scores are shipped, query block to row
block, so what is copied goes with the pairs that can matter.  Where nothing can be told apart
(vectors that are pure noise) all pairs of blocks remain; a row is then copied once for every
``QUERY_BLOCK`` queries.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
do rows with a null id; only vectors of equal length are compared; a query's own row is every
row with its id; a query row that repeats counts once, a candidate row that repeats is
ranked as often as it is there; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

QUERY_BLOCK = 16_384
ROW_BLOCK = 16_384
#: Queries and rows that are scored at a time within a pair of blocks.
CHUNK, STRIPE = 1_024, 2_048
#: Pairs of blocks that one task compares by their statistics.
BLOCK_PAIRS = 1_000_000
#: Numbers of segments, coarse to fine.
LEVELS = (4, 16)
#: Numbers of a coarse sketch: a mean and a deviation for each segment.
WIDTH = 2 * LEVELS[0]


def sketch(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled segment means and deviations: their products bound the vectors' products from above."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    columns = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, low:high]
        mean = part.mean(axis=1)
        columns += [mean * np.sqrt(high - low), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.column_stack(columns) if columns else np.zeros((len(x), 1))


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of the block for each query, if they reach its ``least`` score: positions of queries, ids of rows, scores."""
    query_levels = [sketch(queries, n) for n in LEVELS]
    reach = np.sqrt((queries**2).sum(axis=1))
    at = np.zeros(0, dtype=np.int64)
    ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    floor = np.full(len(queries), -np.inf) if least is None else least.copy()
    for low in range(0, len(rows), STRIPE):
        some, some_ids = rows[low : low + STRIPE], row_ids[low : low + STRIPE]
        slack = 1e-9 * np.outer(reach, np.sqrt((some**2).sum(axis=1))) + 1e-6
        q, r = np.nonzero(query_levels[0] @ sketch(some, LEVELS[0]).T + slack >= floor[:, None])
        for level, n in zip(query_levels[1:], LEVELS[1:], strict=True):
            if len(q) * 4 < slack.size:
                kept = np.einsum("ij,ij->i", level[q], sketch(some, n)[r]) + slack[q, r] >= floor[q]
                q, r = q[kept], r[kept]
        exact = np.einsum("ij,ij->i", queries[q], some[r]) if len(q) * 4 < slack.size else (queries @ some.T)[q, r]
        kept = (exact >= floor[q]) & (query_ids[q] != some_ids[r])
        at = np.concatenate([at, q[kept]])
        ids = np.concatenate([ids, some_ids[r[kept]]])
        scores = np.concatenate([scores, np.rint(exact[kept]).astype(np.int64)])
        order = np.lexsort([ids, -scores, at])
        at, ids, scores = at[order], ids[order], scores[order]
        start = np.searchsorted(at, np.arange(len(queries)))
        place = np.arange(len(at)) - start[at]
        at, ids, scores, place = at[place < k], ids[place < k], scores[place < k], place[place < k]
        last = place == k - 1
        floor[at[last]] = np.maximum(floor[at[last]], scores[last])
    return at, ids, scores


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arrays = column.combine_chunks()
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arrays), -1) if len(arrays) else flat.reshape(0, 0)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the ``k`` largest integer inner products of each query.

    Components become ``floor(scale * x)``; ties go to the smaller id.  Sums must stay below 2**53.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("id", "asks", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("x"))
    rows = written(rows.mapInArrow(_sketched, f"id long, asks boolean, x array<long>, d int, mark long, at long, {_fields('s')}"), "sketched-vectors")
    total = rows.agg(F.count("*"), F.count_if("asks"), *[F.avg(f"s{i}") for i in range(0, WIDTH, 2)]).first()
    n, asking, means = total[0], total[1], [m or 0.0 for m in total[2:]]
    # Blocks: by the side of the average on which the first segments' means lie (at most 2 ** LEVELS[0]
    # cells), each cell then cut by chance to the size wanted by its own count.
    bits = min(len(means), max(0, (n // ROW_BLOCK).bit_length() - 1))
    cell = sum(((F.col(f"s{2 * i}") > m).cast("int") * (1 << i) for i, m in enumerate(means[:bits])), F.lit(0)).cast("int")
    rows = rows.withColumn("cell", cell)
    held = {r["cell"]: (r["n"], r["asking"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).collect()}

    def part(size: int, which: int, key: Column) -> Column:
        first, blocks = 0, []
        for at, counts in sorted(held.items()):
            parts = max(1, -(-counts[which] // size))
            blocks.append(F.when(F.col("cell") == at, first + F.pmod(F.xxhash64("id", key), F.lit(parts))))
            first += parts
        return F.coalesce(*blocks, F.lit(0)).cast("int")

    rows = rows.withColumn("rb", part(ROW_BLOCK, 0, F.col("at"))).withColumn("qb", part(QUERY_BLOCK, 1, F.col("mark"))).drop("cell", "at")
    asked = rows.filter("asks").dropDuplicates(["id", "mark", "x"])

    def own(table: pa.Table) -> pa.Table:
        return _floors(table, k)

    # A query's k best of its own block: what any other row must reach.
    first = rows.select("id", "mark", "asks", "x", "d", "rb").groupBy("d", "rb").applyInArrow(own, "id long, mark long, least double")
    floors = written(first.groupBy("id", "mark").agg(F.max("least").alias("least")), "query-floors")
    asked = written(asked.join(floors, ["id", "mark"]).select("id", "mark", "x", "d", "qb", "least", *[f"s{i}" for i in range(WIDTH)]), "asking-vectors")
    pairs = written(_block_pairs(rows, asked, n, asking), "block-pairs")
    left = asked.select("id", "mark", "x", "least", "d", "qb").join(pairs, ["d", "qb"])
    right = rows.select("id", "x", "d", "rb").join(pairs, ["d", "rb"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, query_ids, marks, least = _matrix(left["x"]), left["id"].to_numpy(), left["mark"].to_numpy(), left["least"].to_numpy()
        table, ids = _matrix(right["x"]), right["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        table, ids = table[order], ids[order]
        found = [(np.zeros(0, np.int64),) * 3]
        if len(table):
            for low in range(0, len(queries), CHUNK):
                at, hits, scores = best_of_block(queries[low : low + CHUNK], query_ids[low : low + CHUNK], table, ids, k, least[low : low + CHUNK])
                found.append((at + low, hits, scores))
        at, hits, scores = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": query_ids[at], "mark": marks[at], "vec_id": hits, "score": scores})

    met = left.groupBy("d", "qb", "rb").cogroup(right.groupBy("d", "qb", "rb")).applyInArrow(meet, "query_id long, mark long, vec_id long, score long")
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")))
    discard(floors)
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fields(prefix: str) -> str:
    return ", ".join(f"{prefix}{i} double" for i in range(WIDTH))


def _sketched(batches):
    """Rows with their length, a digest of the vector, their number in the partition (by which repeated rows are dealt) and the coarse statistics."""
    done = 0
    for batch in batches:
        lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
        sketches, marks = np.zeros((len(lengths), WIDTH)), np.zeros(len(lengths), dtype=np.int64)
        for d in np.unique(lengths[lengths > 0]):
            which = np.flatnonzero(lengths == d)
            x = flat[(ends[which] - d)[:, None] + np.arange(d)]
            found = sketch(x, LEVELS[0])
            sketches[which, : found.shape[1]] = found
            marks[which] = [int.from_bytes(hashlib.md5(v.tobytes(), usedforsecurity=False).digest()[:8], "little", signed=True) for v in x]
        columns = [pa.array(lengths, pa.int32()), pa.array(marks), pa.array(np.arange(done, done + len(lengths))), *map(pa.array, sketches.T)]
        done += len(lengths)
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "d", "mark", "at", *[f"s{i}" for i in range(WIDTH)]])


def _floors(table: pa.Table, k: int) -> pa.Table:
    """Of a block of rows, the k-th best score of each query in it (minus infinity if it meets fewer)."""
    asks = np.flatnonzero(table["asks"].to_numpy(zero_copy_only=False))
    x, ids, marks = _matrix(table["x"]), table["id"].to_numpy(), table["mark"].to_numpy()
    order = np.argsort(ids, kind="stable")
    least = np.full(len(asks), -np.inf)
    for low in range(0, len(asks), CHUNK):
        some = asks[low : low + CHUNK]
        at, _, scores = best_of_block(x[some], ids[some], x[order], ids[order], k)
        full = np.flatnonzero(np.bincount(at, minlength=len(some)) >= k)
        last = np.searchsorted(at, full, side="right") - 1  # hits come by query, best first
        least[low + full] = scores[last]
    return pa.table({"id": ids[asks], "mark": marks[asks], "least": least})


def _block_pairs(rows: DataFrame, asked: DataFrame, n: int, asking: int) -> DataFrame:
    """``d``, ``qb``, ``rb``: pairs of blocks between which some product may reach the least score wanted."""
    means, deviations = range(0, WIDTH, 2), range(1, WIDTH, 2)
    ranges = lambda p: [f(f"s{i}").alias(f"{p}{side}{i}") for i in means for f, side in ((F.min, "low"), (F.max, "high"))] + [F.max(f"s{i}").alias(f"{p}dev{i}") for i in deviations]
    salts = max(1, -(-n * asking // (ROW_BLOCK * QUERY_BLOCK * BLOCK_PAIRS)))
    q = asked.groupBy("d", "qb").agg(F.min("least").alias("least"), *ranges("q")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    r = rows.groupBy("d", "rb").agg(*ranges("r")).withColumn("salt", F.pmod(F.xxhash64("rb"), F.lit(salts)).cast("int"))
    bound = F.lit(0.0)
    for i in means:
        bound += F.greatest(*[F.col(f"q{x}{i}") * F.col(f"r{y}{i}") for x in ("low", "high") for y in ("low", "high")])
    for i in deviations:
        bound += F.col(f"qdev{i}") * F.col(f"rdev{i}")
    slack = F.abs(bound) * 1e-9 + 1e-6
    return q.join(r, ["d", "salt"]).filter((F.col("least") == float("-inf")) | (bound + slack >= F.col("least"))).select("d", "qb", "rb")
