"""Exact top-k by inner product: columnar branch-and-bound.

Vectors lie in vertical blocks (one row for each dimension). Scores accumulate over blocks of dimensions; after each,
candidates whose partial score plus the remaining-mass bound |q rest| |c rest| can't reach the k-th best so far are
dropped and the rest compacted. Each query block first meets one block, and the k-th score found there is a bound that
the query carries into all other blocks; these return only what reaches it.
Scores beyond 64 bits count as the nearest 64-bit number, so those tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

CANDIDATES, QUERIES, DIMENSIONS, CHUNK = 8192, 512, 16, 2048
EXACT = 2.0**52
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, transform=None) -> DataFrame:
    """(id, v) of rows with an id and a vector of finite numbers; v as doubles, after `transform` of each component."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(ok).select(F.col(id_col).cast("long").alias("id"), (F.transform(v, transform) if transform else v).alias("v"))


def _blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """rows with the number of its block, of `count`, by a hash of the id: the same whenever a task runs again, and neither copies nor clusters gather in one."""
    return rows.withColumn(name, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(count)).cast("int"))


def _vertical(rows: pa.StructScalar | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and the (dims, n) matrix of a block; shorter vectors are filled with 0."""
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    lists = rows.field("v")
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    m = np.zeros((len(ids), dims))
    m[np.arange(dims)[None, :] < n[:, None]] = flat
    return ids, np.ascontiguousarray(m.T)


def _rest(m: np.ndarray) -> np.ndarray:
    """Norms of the dimensions from each block's begin on: (blocks + 1, n)."""
    sums = np.add.reduceat(m * m, np.arange(0, len(m), DIMENSIONS), axis=0)
    return np.sqrt(np.concatenate([np.cumsum(sums[::-1], axis=0)[::-1], np.zeros((1, m.shape[1]))]))


def search_block(q_ids, q, bounds, c_ids, c, k: int, best: dict) -> None:
    """Adds to best[query] = (scores, ids), k at most, what the candidates of one block have to offer at a query's bound or above."""
    if len(q) == 0 or q.shape[1] == 0 or c.shape[1] == 0:
        return
    exact = np.abs(q).max() * np.abs(c).max() * len(q) < EXACT
    q_rest, c_rest = _rest(q), _rest(c)
    for at in range(0, c.shape[1], CHUNK):
        part, ids, rest = c[:, at : at + CHUNK], c_ids[at : at + CHUNK], c_rest[:, at : at + CHUNK]
        first = q[:DIMENSIONS].T @ part[:DIMENSIONS]
        for j, own in enumerate(q_ids):
            scores, names = best.get(own, (np.zeros(0), np.zeros(0, np.int64)))
            least = max(scores.min() if len(scores) >= k else -np.inf, bounds[j])
            acc, left = first[j], np.flatnonzero(ids != own)
            acc = acc[left]
            for b in range(1, len(q_rest)):
                if np.isfinite(least) and exact:
                    bound = acc + q_rest[b, j] * rest[b, left]
                    keep = bound >= least - 1e-6 * (1 + abs(least))
                    if not keep.all():
                        left, acc = left[keep], acc[keep]
                d = b * DIMENSIONS
                if not len(left) or d >= len(q):
                    break
                acc = acc + q[d : d + DIMENSIONS, j] @ (part[d : d + DIMENSIONS] if len(left) == part.shape[1] else part[d : d + DIMENSIONS, left])
            if not exact:
                whole = [int(x) for x in q[:, j]]
                acc = np.array([min(max(sum(a * int(v) for a, v in zip(whole, part[:, i], strict=True)), LEAST), MOST) for i in left], dtype=object)
            if exact and np.isfinite(bounds[j]):
                left, acc = left[acc >= bounds[j]], acc[acc >= bounds[j]]
            if len(left):
                scores, names = np.concatenate([scores, acc]), np.concatenate([names, ids[left]])
                if len(scores) > 4 * k and exact:
                    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                    scores, names = scores[scores >= cut], names[scores >= cut]
                order = sorted(range(len(scores)), key=lambda i: (-scores[i], names[i]))[:k]
                best[own] = scores[order], names[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of whole-numbered vectors, ties to the smaller id.

    queries, candidates: (id, v) as usable() gives. Rows with a query's id are not its candidates; repeated queries are
    answered once, with the smallest of their vectors, repeated candidates count each; shorter vectors are filled with 0;
    empty tables give no rows.
    """
    dims, n_c = candidates.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    q_dims, n_q = queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    dims, c_blocks, q_blocks = max(dims, q_dims, 1), max(1, -(-n_c // CANDIDATES)), max(1, -(-n_q // QUERIES))
    c = _blocks(candidates, c_blocks, "c_block").groupBy("c_block").agg(F.collect_list(F.struct("id", "v")).alias("c_rows"))
    q = _blocks(queries.groupBy("id").agg(F.min("v").alias("v")), q_blocks, "q_block")
    row = F.collect_list(F.struct("id", "v", "bound")).alias("q_rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                best: dict = {}
                rows = batch.column("q_rows")[i].values
                bounds = rows.field("bound").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                search_block(*_vertical(rows, dims), bounds, *_vertical(batch.column("c_rows")[i].values, dims), k, best)
                n = [len(s) for s, _ in best.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(list(best), np.int64), n)),
                        pa.array(np.concatenate([x for _, x in best.values()]) if best else [], pa.int64()),
                        pa.array([int(v) for s, _ in best.values() for v in s], pa.int64()),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    schema = "query_id long, vec_id long, score long"
    first = q.withColumn("bound", F.lit(None).cast("long")).groupBy("q_block").agg(row).withColumn("c_block", F.pmod("q_block", F.lit(c_blocks)).cast("int"))
    found = written(first.join(c, "c_block").select("q_rows", "c_rows").mapInArrow(search, schema), "first")
    if c_blocks > 1:
        bound = found.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "bound")
        rest = q.join(bound, "id", "left").groupBy("q_block").agg(row)
        rest = rest.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))).where(F.col("c_block") != F.pmod("q_block", F.lit(c_blocks)))
        found = found.unionByName(rest.join(c, "c_block").select("q_rows", "c_rows").mapInArrow(search, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every vector whose id is divisible by 20, components taken as floor(64 x)."""
    e = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", lambda x: F.floor(x * 64).cast("double"))
    return top_k(e.where("id % 20 = 0"), e, 20)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     x AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
           FROM x q JOIN x c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
