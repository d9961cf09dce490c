"""Edit distance as a column of a table of pairs, with very long pairs cut into cells.

Pairs whose matrix exceeds ``WHOLE`` cells of ``cell`` by ``cell`` do not stay in one row: both
sequences are stored in pieces, and each round computes one anti-diagonal of cells as
Spark rows. A cell takes the border of the cell on its left (two bits a row) and of the
one above (one step a column) from the round before, which is stored. Only cells that a
path of at most k edits can reach are computed; k starts at an eighth of the longer
sequence and grows by four while the result exceeds it, so the result is exact.

A pair with a null text has no distance. Repeated rows and rows of any other columns are
kept as they are; a column called as the new one is replaced. ``pairs`` is read twice (long pairs, others): pass a deterministic plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edit_distance import WORD, char_distance, pair_of_codes, py_split, sweep_cell, token_distance
from .flatten import stored

CELL = 65_536               # rows and columns of a cell, a multiple of 64
WHOLE = 16                  # cells of a pair that one task still treats
CELLS_A_TASK = 16           # about

STATE = "pid long, i int, j int, value long, pv binary, mv binary, steps binary"


def with_distance(pairs: DataFrame, ref: str, hyp: str, name: str, tokens: bool = False, cell: int = CELL,
                  whole: int = WHOLE) -> DataFrame:
    """``pairs`` with the edit distance of two text columns, over characters or white-space tokens."""
    pairs = pairs.drop(name)
    measure = token_distance if tokens else char_distance
    near = pairs.withColumn(name, measure(F.col(ref), F.col(hyp)))
    # n characters hold at most (n + 1) / 2 tokens
    cells = F.length(ref).cast("double") * F.length(hyp) / (4 if tokens else 1)
    is_long = F.coalesce(cells > float(cell) * cell * whole, F.lit(False))
    far = pairs.where(is_long).select(F.monotonically_increasing_id().alias("pid"), F.struct(*pairs.columns).alias("whole_row"),
                                      F.col(ref).alias("ref"), F.col(hyp).alias("hyp"))
    far = stored(far, "long-pairs")
    if far.isEmpty():
        return near
    found = long_distances(far.select("pid", "ref", "hyp"), tokens, cell)
    far = far.join(found, "pid").select("whole_row.*", F.col("distance").alias(name))
    return pairs.where(~is_long).withColumn(name, measure(F.col(ref), F.col(hyp))).unionByName(far)


def pieces(rows: DataFrame, side: str, tokens: bool, cell: int) -> DataFrame:
    """(pid, at, ``side``): the sequence in pieces of ``cell`` elements, tokens joined by blanks."""
    whole = rows.select("pid", (py_split(F.col(side)) if tokens else F.col(side)).alias("whole"))
    size = F.size("whole") if tokens else F.length("whole")
    cut = whole.where(size > 0).select("pid", "whole", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / cell).cast("int"))).alias("at"))
    first = F.col("at") * cell + 1
    piece = F.array_join(F.slice("whole", first, cell), " ") if tokens else F.col("whole").substr(first, F.lit(cell))
    return cut.select("pid", "at", piece.alias(side))


def long_distances(rows: DataFrame, tokens: bool, cell: int) -> DataFrame:
    """(pid, distance) of stored rows (pid, ref, hyp)."""
    parts = {side: stored(pieces(rows, side, tokens, cell), f"pieces-{side}") for side in ("ref", "hyp")}
    size = lambda side: F.size(py_split(F.col(side))) if tokens else F.length(side)
    sizes = stored(rows.select("pid", size("ref").cast("long").alias("m"), size("hyp").cast("long").alias("n")), "pair-sizes")
    done = [sizes.where("least(m, n) = 0").select("pid", F.greatest("m", "n").alias("distance"))]
    k = F.greatest(F.lit(1), F.abs(F.col("m") - F.col("n")), F.floor(F.greatest("m", "n") / 8))
    todo = sizes.where("least(m, n) > 0").withColumn("k", k.cast("long"))
    while not todo.isEmpty():
        found = stored(within_band(todo, parts["ref"], parts["hyp"], tokens, cell), "band-results")
        done.append(found.where("distance <= k").select("pid", "distance"))
        todo = stored(found.where("distance > k").select("pid", "m", "n", F.least("distance", F.col("k") * 4).alias("k")), "wider-bands")
    return reduce(DataFrame.unionByName, done)


def within_band(todo: DataFrame, patterns: DataFrame, texts: DataFrame, tokens: bool, cell: int) -> DataFrame:
    """``todo`` (pid, m, n, k) with ``distance``, exact where it is at most k."""
    spark = todo.sparkSession
    rows, columns = (F.floor((F.col(c) - 1) / cell).cast("int") for c in ("m", "n"))
    grid = stored(todo.withColumns({"last_i": rows, "last_j": columns}), "grids")
    size = grid.agg(F.max(F.col("last_i") + F.col("last_j")).alias("last"), F.sum(F.least("last_i", "last_j") + 1).alias("cells")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size["cells"]) // CELLS_A_TASK))
    run = cell_runner(tokens)
    state, ends = None, []
    for d in range(size["last"] + 1):
        cells = grid.where(F.col("last_i") + F.col("last_j") >= d).select("*", F.explode(F.sequence(
            F.greatest(F.lit(0), F.lit(d) - F.col("last_j")), F.least("last_i", F.lit(d)))).alias("i"))
        cells = cells.withColumn("j", F.lit(d) - F.col("i")).where(reached(cell))
        if state is None:
            border = [F.lit(None).cast(t).alias(c) for c, t in BORDERS]
            cells = cells.select("pid", "i", "j", *border)
        else:
            left = state.select("pid", "i", (F.col("j") + 1).alias("j"), F.col("value").alias("left_value"), "pv", "mv")
            above = state.select("pid", (F.col("i") + 1).alias("i"), "j", F.col("value").alias("above_value"), "steps")
            cells = cells.select("pid", "i", "j").join(left, ["pid", "i", "j"], "left").join(above, ["pid", "i", "j"], "left")
        cells = cells.join(patterns.withColumnRenamed("at", "i"), ["pid", "i"]).join(texts.withColumnRenamed("at", "j"), ["pid", "j"])
        cells = cells.select("pid", "i", "j", *[c for c, _ in BORDERS], "ref", "hyp").repartition(tasks, "pid", "i", "j")
        state = stored(cells.mapInArrow(run, STATE), "cells")
        ends.append(state.join(grid.select("pid", F.col("last_i").alias("i"), F.col("last_j").alias("j")), ["pid", "i", "j"], "left_semi")
                    .select("pid", F.col("value").alias("distance")))
    return todo.join(reduce(DataFrame.unionByName, ends), "pid")


BORDERS = [("left_value", "long"), ("pv", "binary"), ("mv", "binary"), ("above_value", "long"), ("steps", "binary")]


def reached(cell: int) -> Column:
    """Whether cell (i, j) has a place at most k off the diagonal."""
    return (F.abs(F.col("i") - F.col("j")) - 1) * cell + 1 <= F.col("k")


def cell_runner(tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                c = {n: b.column(n)[r].as_py() for n in b.schema.names}
                pattern, text = pair_of_codes(c["ref"], c["hyp"], tokens)
                words = -(-len(pattern) // WORD)
                above = np.ones(len(text), np.int8) if c["steps"] is None else np.frombuffer(c["steps"], np.int8)
                if c["pv"] is None:     # nothing on the left is reached: each row is one more than the last
                    pv, mv = np.full(words, ~np.uint64(0)), np.zeros(words, np.uint64)
                    value = len(pattern) + (0 if c["above_value"] is None else c["above_value"] - int(above.sum(dtype=np.int64)))
                else:
                    pv, mv = (np.frombuffer(c[n], np.uint64).copy() for n in ("pv", "mv"))
                    value = c["left_value"]
                steps = sweep_cell(pattern, text, pv, mv, above)
                value += int(steps.sum(dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c["pid"]], pa.int64()), pa.array([c["i"]], pa.int32()), pa.array([c["j"]], pa.int32()),
                     pa.array([value], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (pv, mv, steps)]],
                    names=["pid", "i", "j", "value", "pv", "mv", "steps"])
    return run
