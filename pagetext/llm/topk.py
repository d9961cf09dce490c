"""Exact top-k inner products over norm-sorted vectors.

Vectors are turned into integers, floor(256 * x). They are stored in blocks by
descending length (a range shuffle, so the first blocks hold the longest), each
vector with its coordinates after an SVD rotation of all vectors, so the first
coordinates hold most of the length. Every query first meets the longest
block, which gives it a k-th score to beat. A block is left out for a block of
queries when the product of the largest lengths cannot beat the smallest such
score (Cauchy-Schwarz); within a pair of blocks a partial sum over the first
rotated coordinates plus the product of the two residual lengths bounds each
inner product, and only candidates whose bound reaches the k-th score are
multiplied out, in exact integers.

The query set is stated (vec_id divisible by ``every``) and meets all rows
block by block: work is queries times rows at worst, memory is one pair of
blocks, and each pair returns at most k rows a query.

Vectors that are null or hold a null or non-finite component take no part.
Vectors of different dimension do not meet. Rows, not ids, are compared:
repeated rows are candidates of each other, a row is never its own. A null
vec_id is never a query; as a candidate it sorts after equal scores. Products
must fit a long: |floor(256 x)| up to 2^31 times the dimension below 2^63.
Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

K = 5
EVERY = 50
SCALE = 256
CANDIDATES, QUERIES = 4096, 512     # vectors in a block
LEADING = 16                         # rotated coordinates summed before the bound
SALTS = 32
EXACT_FLOAT = 2.0 ** 53
NO_ID = np.iinfo(np.int64).max


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, norm, v array<long>) of the rows that take part."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("e", lambda x: F.floor(x * SCALE).cast("long"))
    e = e.where(F.col("e").isNotNull() & fine).select("vec_id", v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("vec_id", F.size("v").alias("dim"), norm.alias("norm"), "v")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), dim)


def second_moments(vectors: DataFrame) -> DataFrame:
    """(dim, i, total array<double>): the rows of V'V, summed over all vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims[dims > 0]).tolist():
                x = matrix(b.column("v").filter(pa.array(dims == dim)), dim).astype(float)
                total[dim] = total.get(dim, 0.0) + x.T @ x
        for dim, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim * dim, dim, np.int64)), pa.array(np.repeat(np.arange(dim), dim)),
                                              pa.array(np.tile(np.arange(dim), dim)), pa.array(t.ravel())], names=["dim", "i", "j", "x"])
    return vectors.select("dim", "v").mapInArrow(run, "dim long, i long, j long, x double").groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The right singular vectors per dimension, largest first (dim^2 numbers come to the driver)."""
    sums: dict[int, np.ndarray] = {}
    for r in second_moments(vectors).collect():
        sums.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["i"], r["j"]] = r["x"]
    return {d: np.linalg.eigh((s + s.T) / 2)[1][:, ::-1].copy() for d, s in sums.items()}


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, block, n, largest, ids, rows, v): vectors packed by descending length. ``row`` names a row for good."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def pack(dim: int, block: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held.pop(dim))
            v = matrix(t.column("v"), dim) if dim else np.zeros((t.num_rows, 0), np.int64)
            ids = t.column("vec_id").combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.array([dim]), pa.array([block]), pa.array([t.num_rows]), pa.array([max(t.column("norm").to_pylist())]),
                 pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([t.column("row").to_pylist()], pa.list_(pa.int64())),
                 pa.array([np.ascontiguousarray(v, np.int64).tobytes()], pa.binary())],
                names=["dim", "block", "n", "largest", "ids", "rows", "v"])
        part, made, count = None, 0, {}
        for b in batches:
            if b.num_rows:
                part = b.column("part")[0].as_py() if part is None else part
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                mine = b.filter(pa.array(dims == dim))
                while mine.num_rows:
                    room = rows - count.get(dim, 0)
                    held.setdefault(dim, []).append(mine.slice(0, room))
                    count[dim] = count.get(dim, 0) + min(room, mine.num_rows)
                    mine = mine.slice(min(room, mine.num_rows))
                    if count[dim] == rows:
                        yield pack(dim, (part << 32) | made)
                        made, count[dim] = made + 1, 0
        for dim in list(held):
            yield pack(dim, (part << 32) | made)
            made += 1
    named = vectors.withColumn("part", F.spark_partition_id().cast("long"))
    return named.select("vec_id", "dim", "norm", "row", "part", "v").mapInArrow(
        run, "dim long, block long, n long, largest double, ids array<long>, rows array<long>, v binary")


def multiply(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T in exact integers: through doubles where every sum fits their mantissa."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < EXACT_FLOAT:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x @ y.T


def best_of_pair(q: dict, c: dict, rotation: np.ndarray | None, beat: np.ndarray, k: int):
    """Per query of block ``q`` its k best candidates of block ``c`` that reach ``beat``:
    (query index, candidate index, score)."""
    x, y = q["v"], c["v"]
    allowed = q["rows"][:, None] != c["rows"][None, :]
    if rotation is not None and np.isfinite(beat).any():
        xr, yr = x.astype(float) @ rotation, y.astype(float) @ rotation
        lead = min(LEADING, x.shape[1])
        rest = lambda m: np.sqrt((m[:, lead:] ** 2).sum(1))
        bound = xr[:, :lead] @ yr[:, :lead].T + np.outer(rest(xr), rest(yr))
        slack = 1e-9 * np.outer(np.linalg.norm(xr, axis=1), np.linalg.norm(yr, axis=1)) + 1e-6
        allowed &= bound + slack >= beat[:, None]
    rows, cols = allowed.any(1), allowed.any(0)
    if not rows.any():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    ri, ci = np.flatnonzero(rows), np.flatnonzero(cols)
    score = multiply(x[ri], y[ci])
    allowed = allowed[np.ix_(ri, ci)]
    ids = c["ids"][ci]
    qs, cs, ss = [], [], []
    by_id = np.argsort(ids, kind="stable")
    for a in range(len(ri)):
        mine = by_id[allowed[a][by_id]]
        s = score[a][mine]
        if len(s) > k:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            mine, s = mine[s >= cut], s[s >= cut]
        top = np.argsort(-s, kind="stable")[:k]
        qs.append(np.full(len(top), ri[a]))
        cs.append(ci[mine[top]])
        ss.append(s[top])
    return np.concatenate(qs), np.concatenate(cs), np.concatenate(ss)


def search_pairs(pairs: DataFrame, turn: dict[int, np.ndarray], k: int) -> DataFrame:
    """(query_row, query_id, vec_id, row, score) of each pair of blocks."""
    def unpack(b: pa.RecordBatch, i: int, side: str) -> dict:
        dim = b.column("dim")[i].as_py()
        ids = b.column(f"{side}_ids")[i].values
        n = len(ids)
        return {"ids": ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), "null": ids.is_null().to_numpy(zero_copy_only=False),
                "rows": b.column(f"{side}_rows")[i].values.to_numpy(), "v": np.frombuffer(b.column(f"{side}_v")[i].as_py(), np.int64).reshape(n, dim)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, c = unpack(b, i, "q"), unpack(b, i, "c")
                dim = b.column("dim")[i].as_py()
                beat = b.column("beat")[i].values
                beat = np.full(len(q["rows"]), -np.inf) if beat is None else beat.to_numpy().astype(float)
                a, j, s = best_of_pair(q, c, turn.get(dim), beat, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q["rows"][a]), pa.array(q["ids"][a]), pa.array(c["ids"][j], mask=c["null"][j]), pa.array(c["rows"][j]), pa.array(s)],
                    names=["query_row", "query_id", "vec_id", "row", "score"])
    return pairs.mapInArrow(run, "query_row long, query_id long, vec_id long, row long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query row."""
    # rows get their name once, when stored
    vectors = stored(integer_vectors(embeddings).withColumn("row", F.monotonically_increasing_id()), "vectors")
    turn = rotations(vectors)

    def by_length(rows: DataFrame, n: int) -> DataFrame:
        """Longest first, one range of lengths per partition; equal lengths are spread by the hash of the row."""
        order = [F.col("norm").desc(), F.xxhash64("row")]
        return rows.repartitionByRange(max(n, 1), *order).sortWithinPartitions(*order)

    n = vectors.count()
    asked = vectors.where(F.col("vec_id") % every == 0)
    c = stored(blocks(by_length(vectors, -(-n // CANDIDATES)), CANDIDATES), "candidate-blocks")
    q = stored(blocks(by_length(asked, -(-n // (every * QUERIES))), QUERIES), "query-blocks")
    cs = c.select("dim", F.col("block").alias("c_block"), F.col("largest").alias("c_largest"), F.col("ids").alias("c_ids"),
                  F.col("rows").alias("c_rows"), F.col("v").alias("c_v"))
    qs = q.select("dim", F.col("block").alias("q_block"), F.col("largest").alias("q_largest"), F.col("ids").alias("q_ids"),
                  F.col("rows").alias("q_rows"), F.col("v").alias("q_v"))

    # the longest block of each dimension first
    longest = c.groupBy("dim").agg(F.max_by("block", F.struct("largest", (-F.col("block")).alias("b"))).alias("first"))
    firsts = cs.join(longest, (cs["dim"] == longest["dim"]) & (F.col("c_block") == F.col("first")), "left_semi")
    begin = qs.join(firsts, "dim").withColumn("beat", F.lit(None).cast("array<long>"))
    found = stored(top(search_pairs(begin, turn, k), k).select("query_row", "query_id", "vec_id", "row", "score", "rank"), "first-block")

    # per query block the score to beat of each query, in block order
    at = q.select("dim", "block", F.posexplode("rows").alias("at", "query_row"))
    kth = found.where(F.col("rank") == k).select("query_row", F.col("score").alias("kth"))
    none = F.lit(-(1 << 62))
    beats = (at.join(kth, "query_row", "left").groupBy("dim", F.col("block").alias("q_block"))
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("kth", none).alias("kth")))), lambda s: s["kth"]).alias("beat")))
    beats = stored(beats, "scores-to-beat")
    # block numbers only; both sides carry a salt, so one dimension is not one task
    plan = (c.select("dim", F.col("block").alias("c_block"), F.col("largest").alias("c_largest")).join(longest, "dim")
            .where("c_block != first").withColumn("salt", F.pmod(F.xxhash64("c_block"), F.lit(SALTS))))
    asks = (q.select("dim", F.col("block").alias("q_block"), F.col("largest").alias("q_largest"))
            .join(beats.select("dim", "q_block", F.array_min("beat").alias("least")), ["dim", "q_block"])
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))))
    pairs = (asks.join(plan, ["dim", "salt"]).where(F.col("q_largest") * F.col("c_largest") * (1 + 1e-9) >= F.col("least"))
             .select("dim", "q_block", "c_block"))
    full = (pairs.join(qs.drop("q_largest"), ["dim", "q_block"]).join(beats, ["dim", "q_block"])
            .join(cs.drop("c_largest"), ["dim", "c_block"]))
    more = search_pairs(full.repartition("q_block", "c_block"), turn, k)
    every_one = found.drop("rank").unionByName(more)
    return top(every_one, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
