"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks; each block of queries meets each block of
candidates once per round in a task of its own, which scores all pairs of the
two blocks. The k-th highest score of each query is located in a few rounds:
tasks count scores in the bins of the query's present interval, the counts
are added up, and the bin that holds the k-th score is the next interval,
until it is one value wide. A last round keeps the scores from that value on,
and ties fall to the smaller id. A task reports only bins from the top down to
its own k-th score, and of the last round its own k best, since nothing below
can be among the k best of all; no score that could be is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

K = 20
SCALE = 64
#: Vectors per block, and bits of the score found per round.
CANDIDATES, QUERIES, BITS = 4096, 1024, 8
#: Size of scores from which a result is an error: bins of the whole interval
#: between both signs are longs.
TOP = 2 ** 62 - 1


def _usable(vector: str):
    x = F.col(vector)
    # doubles from 2^52 on are whole, and floor's long would not hold them all
    whole = F.transform(x, lambda v: F.when(F.abs(v.cast("double")) * SCALE < 2.0 ** 52, F.floor(v.cast("double") * SCALE).cast("double"))
                        .otherwise(v.cast("double") * SCALE))
    plain = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return whole, x.isNotNull() & plain


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def made(dim):
            ids, rows = held.pop(dim)
            data = np.concatenate(rows).reshape(len(ids), dim)
            kind = np.float32 if np.abs(data).max(initial=0) < 2 ** 24 else np.float64
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]),
                 pa.array([data.astype(kind).tobytes()])], ["dim", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = v.values.to_numpy(zero_copy_only=False)
                ids, rows = held.setdefault(len(x), ([], []))
                ids.append(i)
                rows.append(x)
                if len(ids) == size:
                    yield made(len(x))
        for dim in list(held):
            yield made(dim)
    return run


def _numbered(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Staged blocks with numbers 0, 1, ... and how many there are."""
    blocks = stage(vectors.mapInArrow(_blocks(size), "dim int, ids binary, data binary"), name)
    keyed = stage(blocks.select("*", F.monotonically_increasing_id().alias("key")), name)
    # only block keys, a few bytes per thousand vectors, are numbered in order
    order = keyed.select("key").withColumn("no", F.row_number().over(Window.orderBy("key")) - 1)
    return keyed.join(order, "key").drop("key")


def _matrix(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(data) == 4 * dim * len(i) else np.float64
    return i, np.frombuffer(data, kind).reshape(len(i), dim)


def scores(query: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, those beyond ``TOP`` as
    ``TOP``. Rows with components that a long's sum may not hold are multiplied
    as Python's integers."""
    safe = np.sqrt(2.0 ** 61 / max(1, query.shape[1]))
    far = [np.flatnonzero(np.abs(x).max(axis=1, initial=0) >= safe) for x in (query, candidate)]
    near = [x for x in (query, candidate)]
    for i, rows in enumerate(far):
        if len(rows):
            near[i] = near[i].copy()
            near[i][rows] = 0
    bound = np.abs(near[0]).max(initial=0).astype(float) * np.abs(near[1]).max(initial=0).astype(float) * max(1, query.shape[1])
    kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64
    out = (near[0].astype(kind) @ near[1].astype(kind).T).astype(np.int64)
    if len(far[0]):
        out[far[0]] = _long(_integers(query[far[0]]) @ _integers(candidate).T)
    if len(far[1]):
        out[:, far[1]] = _long(_integers(query) @ _integers(candidate[far[1]]).T)
    return out


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _long(x: np.ndarray) -> np.ndarray:
    return np.array([max(-TOP, min(TOP, v)) for v in x.ravel().tolist()], np.int64).reshape(x.shape)


def _cells(batches: Iterator[pa.RecordBatch], k: int):
    """Per cell: query ids, candidate ids, scores (own rows marked), state."""
    for b in batches:
        for row in range(b.num_rows):
            get = {n: b.column(i)[row] for i, n in enumerate(b.schema.names)}
            dim = get["dim"].as_py()
            q, x = _matrix(get["q_ids"].as_py(), get["q_data"].as_py(), dim)
            c, y = _matrix(get["c_ids"].as_py(), get["c_data"].as_py(), dim)
            s = scores(x, y)
            same = q[:, None] == c
            state = {n: np.frombuffer(get[n].as_py(), np.int64) for n in ("lo", "need")}
            yield q, c, s, same, state


def _histogram(width: int, step: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, _c, s, same, state in _cells(batches, k):
            bins = (s - state["lo"][:, None]) // step
            bins[same | (bins < 0) | (bins >= width)] = -1
            out = ([], [], [])
            for i in range(len(q)):
                count = np.bincount(bins[i][bins[i] >= 0], minlength=width)
                above = np.cumsum(count[::-1])[::-1] - count
                at = np.flatnonzero((count > 0) & (above < state["need"][i]))
                out[0].append(np.full(len(at), q[i]))
                out[1].append(at)
                out[2].append(count[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out],
                                             ["query_id", "bin", "count"])
    return run


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, c, s, same, state in _cells(batches, k):
            out = ([], [], [])
            keep = (s >= state["lo"][:, None]) & ~same
            for i in range(len(q)):
                at = np.flatnonzero(keep[i])
                at = at[np.lexsort((c[at], -s[i, at]))[:k]]
                if np.abs(s[i, at]).max(initial=0) >= TOP:
                    raise OverflowError(f"a score of query {q[i]} is beyond 2^62")
                out[0].append(np.full(len(at), q[i]))
                out[1].append(c[at])
                out[2].append(s[i, at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out],
                                             ["query_id", "vec_id", "score"])
    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of highest score
    for each query, all if there are fewer, ties to the smaller id.

    Both tables have ``vec_id`` and ``vector``; the score is the inner product
    of floor(64 x). A query's own id is no candidate of it. Rows with a NULL id,
    or whose vector is NULL or holds NULL or non-finite components, take no
    part; a score beyond 2^62 among the ``k`` highest is an error; vectors meet only those of their own length. Of rows with one query id
    the smallest vector asks; repeated candidate rows each count."""
    whole, usable = _usable(vector)
    c = candidates.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))
    q = (queries.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))
         .groupBy("vec_id").agg(F.min("v").alias("v")))
    spark = candidates.sparkSession
    q = stage(q, "queries")
    n = q.count()
    if n == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    bound = c.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)))).first()[0]
    most = q.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))).first()[0]
    reach = (bound or 0) * (most or 0)
    # from 2^52 on the doubles that it was added up from may be rounded
    reach = int(min(float(TOP), reach if reach < 2 ** 52 else reach * (1 + 1e-9)))
    reach = min(TOP, reach)
    bits, low = (2 * reach + 1).bit_length(), -reach
    cb = _numbered(c, CANDIDATES, "candidate-blocks")
    qb = stage(_numbered(q.repartition(-(-n // QUERIES)), QUERIES, "query-blocks").select(
        F.col("no").alias("q_no"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "query-blocks")
    cb = cb.select(F.col("no").alias("c_no"), "dim", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    left = cb.join(qb.select("q_no", "dim"), "dim")

    def cells(state: DataFrame) -> DataFrame:
        """Each pair of blocks with the state of its queries, one row each."""
        right = qb.join(state, "q_no").join(cb.select("c_no", "dim"), "dim").drop("dim")
        return left.join(right, ["c_no", "q_no"])

    def states(rows: DataFrame) -> DataFrame:
        return rows.groupBy("q_no").applyInArrow(_states, "q_no bigint, lo binary, need binary")

    places = qb.select("q_no", "q_ids").mapInArrow(_places, "q_no bigint, query_id bigint, place int")
    found = places.select("*", F.lit(low).alias("lo"), F.lit(k).cast("bigint").alias("need"))
    while bits > 0:
        take = min(BITS, bits)
        bits -= take
        step = 1 << bits
        counted = (cells(states(found)).mapInArrow(_histogram(1 << take, step, k), "query_id bigint, bin bigint, count bigint")
                   .groupBy("query_id", "bin").agg(F.sum("count").alias("count")))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reach = counted.withColumn("upto", F.sum("count").over(down)).join(found.select("query_id", "need"), "query_id")
        hit = (reach.where("upto >= need").groupBy("query_id").agg(F.max("bin").alias("bin"), F.max_by(
            F.col("upto") - F.col("count"), "bin").alias("above")))
        # with fewer than k scores no bin reaches the number: keep from the lowest on
        found = stage(found.join(hit, "query_id", "left").select(
            "q_no", "query_id", "place", F.when(F.col("bin").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("bin") * step).alias("lo"),
            F.when(F.col("bin").isNull(), F.col("need")).otherwise(F.col("need") - F.col("above")).alias("need")), "found")
    best = cells(states(found)).mapInArrow(_best(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for no, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            i = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), no), pa.int64()), pa.array(i),
                                              pa.array(np.arange(len(i)), pa.int32())], ["q_no", "query_id", "place"])


def _states(rows: pa.Table) -> pa.Table:
    order = np.argsort(rows.column("place").to_numpy())
    lo, need = (rows.column(n).to_numpy()[order].astype(np.int64) for n in ("lo", "need"))
    return pa.table({"q_no": pa.array([rows.column("q_no")[0].as_py()], pa.int64()),
                     "lo": pa.array([lo.tobytes()]), "need": pa.array([need.tobytes()])})


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
