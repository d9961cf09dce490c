"""MinHash near-duplicates with HyperMinHash sketches.

A document's set is its distinct ``shingle``-word shingles (words
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a shorter text is one shingle, a text
without words is empty and linked with nothing. Two documents are linked when
100 * |A and B| >= 80 * |A or B|; a component is what links reach.

Method (HyperMinHash, Yu and Weber 2017):

1. One hash per shingle deals it to one of 200 buckets; a bucket keeps the
   smallest value as a register of leading-zero count and ten mantissa bits. An
   empty bucket borrows from the first non-empty one in its own fixed probe
   order, so small sets fill all registers consistently.
2. A node is a row, by the hash of its doc_id and text; rows with equal sets form a
   class, and one of them goes on.
3. Forty bands of five registers are join keys. A linked pair (similarity 0.8)
   meets in no band with probability (1 - 0.8^5)^40 = 1.2e-7.
4. In each bucket every member is paired with the smallest one, the pivot; a pivot's
   pairs are dealt over slices by their number, each with a copy of its sketch and set,
   so no key grows with a group. Pairs pass a
   collision-corrected estimate of the similarity (cut five standard errors
   below 0.8), then are confirmed on the full sets.
5. Buckets whose members still lie in several components are searched whole, on
   the full sets, in blocks of bounded size; a block returns links between
   components only, no more than it has members. So every pair that shares a band
   is connected or has been compared, and copies are never expanded into pairs.

Shingles are compared by 64-bit hashes. Repeated rows are equal sets. Rows that
share a doc_id are one document to ``near_duplicates``, whatever their texts: each
keeps its links, and they share a component. ``drop_near_duplicates`` judges each row
by its own text, so unlike rows of one doc_id stay. A row whose doc_id is null takes
no part: its component is null and it is kept. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import LOWER, U64, chunks, flat, mix, span_hashes, words
from .tables import shuffle_files_removed, small_side, stored

REGISTERS, BANDS = 200, 40
MANTISSA_BITS = 10
PERCENT = 80
ESTIMATE_CUT = 0.65       # 0.8 less five standard errors of 200 registers
BLOCK = 512               # members of a bucket compared at once
SLICE = 8192              # shingles multiplied out at once
SLICE_PAIRS = 256         # pairs of a pivot that meet in one slice, about
PIVOT = ["a", "slices", "slice"]
IDS_BROADCAST = 1_000_000   # rows of two long columns at most: 16 MB
SALT_A, SALT_B = U64(0x8CB92BA72F3D8DD7), U64(0xA0761D6478BD642F)
EMPTY = np.iinfo(np.uint64).max

SKETCH = "doc_id long, uid long, n_shingles long, print_a long, print_b long, registers binary, bands array<long>"


# ------------------------------------------------------------------ sets and sketches
def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit shingle hash), distinct, by text number."""
    data = LOWER[data]
    starts, ends, text = words(data, offsets)
    h = span_hashes(data, starts, ends)
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])

    def fold(at: np.ndarray, n: int) -> np.ndarray:
        acc = mix(h[at] + U64(n))
        for i in range(1, n):
            acc = mix(acc * SALT_A + h[at + i])
        return acc

    whole = np.flatnonzero(text[:max(len(text) - size + 1, 0)] == text[size - 1:]) if len(text) >= size else np.zeros(0, int)
    of, value = [text[whole]], [fold(whole, size)]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        of.append(short)
        value.append(fold(first[short], n))
    of, value = np.concatenate(of), np.concatenate(value)
    # one 64-bit sort key: text number above the leading bits of the hash
    bits = max(int(len(offsets)).bit_length(), 1)
    order = np.argsort((of.astype(U64) << U64(64 - bits)) | (value >> U64(bits)))
    of, value = of[order], value[order]
    keep = np.ones(len(of), bool)
    keep[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return of[keep], value[keep]


@lru_cache(maxsize=1)
def probe_ranks() -> np.ndarray:
    """ranks[i, j]: when bucket i asks bucket j; itself first."""
    rng = np.random.default_rng(2017)
    ranks = np.empty((REGISTERS, REGISTERS), np.int16)
    for i in range(REGISTERS):
        order = rng.permutation(REGISTERS)
        order = np.concatenate([[i], order[order != i]])
        ranks[i, order] = np.arange(REGISTERS)
    return ranks


def compress(value: np.ndarray) -> np.ndarray:
    """32-bit values as leading-zero count and mantissa, in 16 bits."""
    bits = np.frexp(value.astype(np.float64))[1].astype(np.uint64)
    rest = (value << (U64(33) - bits)) & U64(0xFFFFFFFF)
    return (((U64(32) - bits) << U64(MANTISSA_BITS)) | (rest >> U64(32 - MANTISSA_BITS))).astype(np.uint16)


def registers(of: np.ndarray, value: np.ndarray, n_texts: int) -> np.ndarray:
    """(texts, REGISTERS) of uint16; rows of empty sets are meaningless."""
    low = np.full(n_texts * REGISTERS, EMPTY, np.uint64)
    bucket = ((value >> U64(32)) * U64(REGISTERS)) >> U64(32)
    np.minimum.at(low, of * REGISTERS + bucket.astype(np.int64), value & U64(0xFFFFFFFF))
    low = low.reshape(n_texts, REGISTERS)
    filled = low != EMPTY
    ranks = probe_ranks()
    for t in np.flatnonzero(~filled.all(1) & filled.any(1)):
        own = np.flatnonzero(filled[t])
        low[t] = low[t][own[ranks[:, own].argmin(1)]]
    low[~filled.any(1)] = 1
    return compress(low)


def band_keys(regs: np.ndarray) -> np.ndarray:
    parts = regs.reshape(len(regs), BANDS, REGISTERS // BANDS).astype(U64)
    acc = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(U64)), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        acc = mix(acc * SALT_B + parts[:, :, i])
    return acc


def row_uid() -> Column:
    """What names a row: a hash of doc_id and text; null without doc_id."""
    doc_id = F.col("doc_id").cast("long")
    return F.when(doc_id.isNotNull(), F.xxhash64(doc_id, F.col("text").cast("string")))


def with_uid(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_uid().alias("uid"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document: set size, two set fingerprints, registers, band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column("text"))
            of, value = shingles(data, offsets, shingle)
            n = np.bincount(of, minlength=b.num_rows)
            regs = registers(of, value, b.num_rows)
            prints = []
            for salt in (SALT_A, SALT_B):
                total = np.concatenate([[U64(0)], np.cumsum(mix(value * salt))])
                edge = np.concatenate([[0], np.cumsum(n)])
                prints.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
            keys = band_keys(regs).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("uid"), pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]),
                 pa.array([r.tobytes() for r in regs], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))],
                names=["doc_id", "uid", "n_shingles", "print_a", "print_b", "registers", "bands"])
    return with_uid(docs).mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, shingle: int, carry: str) -> DataFrame:
    """(doc_id, ``carry`` column, shingles): the full sets of the given documents."""
    kind = dict(docs.dtypes)[carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column("text"))
            of, value = shingles(data, offsets, shingle)
            edge = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b.num_rows))])
            sets = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(carry), sets], names=["doc_id", carry, "shingles"])
    return docs.select("doc_id", carry, "text").mapInArrow(run, f"doc_id long, {carry} {kind}, shingles array<long>")


# ------------------------------------------------------------------ estimate
def expected_collisions(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that two unrelated registers agree: for each leading-zero count, cell
    width times the integral of the product of the two densities of the minimum."""
    m_a, m_b = np.maximum(n_a / REGISTERS, 1.0), np.maximum(n_b / REGISTERS, 1.0)
    s = m_a + m_b - 1.0
    total = np.zeros(len(s))
    for zeros in range(32):
        low, high = 2.0 ** -(zeros + 1), 2.0 ** -zeros
        total += low / (1 << MANTISSA_BITS) * m_a * m_b / s * ((1 - low) ** s - (1 - high) ** s)
    return total


def jaccard_estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    chance = expected_collisions(n_a, n_b)
    return np.clip((equal / REGISTERS - chance) / (1 - chance), 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), REGISTERS) for s in (a, b))
    return pd.Series(jaccard_estimate((x == y).sum(1), n_a.to_numpy(float), n_b.to_numpy(float)))


# ------------------------------------------------------------------ links and components
def slices_of(size: Column) -> Column:
    """Parts, a power of two, that the pairs of a pivot in a bucket are dealt over."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(size / SLICE_PAIRS)))).cast("long")


def sliced(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")))


def copied(pivots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pivots`` (a and what it carries) once for each slice of its pairs."""
    of = pairs.select("a", "slices").distinct()
    return pivots.join(of, "a").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b, slices) whose full sets are similar enough."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with_b = small_side(sliced(pairs).select(F.col("b").alias("doc_id"), F.struct(*PIVOT).alias("pivot")), IDS_BROADCAST)
    with_a = small_side(stored(pairs.select(F.col("a").alias("doc_id")).distinct(), "pivots"), IDS_BROADCAST)
    left = (shingle_sets(ids.join(with_b, "doc_id"), shingle, "pivot")
            .select("pivot.*", F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")))
    right = (shingle_sets(ids.join(with_a, "doc_id").withColumn("own", F.col("doc_id")), shingle, "own")
             .select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")))
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return left.join(copied(right, pairs), PIVOT).where(both * 100 >= either * PERCENT).select("a", "b").distinct()


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction: every node hands its neighbours (large: the larger
    ones, small: the smaller ones and itself) to its smallest neighbour."""
    e = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    j = e.join(least, "a")
    if large:
        return j.where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    return stored(star(star(edges, True), False), "stars")


def all_stars(edges: DataFrame) -> bool:
    """No node points to two, and none to a node that points on."""
    forked = edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo != hi")
    on = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return forked.isEmpty() and on.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, for each node with a link.
    Alternating large-star and small-star steps (Kiveris et al. 2014)."""
    edges = contracted(links.select("a", "b"))
    while not all_stars(edges):
        edges = contracted(edges)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def known_connections(links: DataFrame) -> DataFrame:
    """(node, component) after one contraction: equal labels are connected, though not
    all that is connected has equal labels yet."""
    return contracted(links).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of rows with cols. Shingles of one set only count for
    nothing; the others are multiplied out in slices of bounded width."""
    size = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = column.ravel()
    keep = times[column] > 1
    of, column = of[keep], np.unique(column[keep], return_inverse=True)[1].ravel()
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((len(rows), len(cols)), np.float64)
    for low in range(0, int(column.max(initial=-1)) + 1, SLICE):
        lo, hi = np.searchsorted(column, [low, low + SLICE])
        x = np.zeros((len(sets), SLICE), np.float32)
        x[of[lo:hi], column[lo:hi] - low] = 1.0
        out += x[rows] @ x[cols].T
    return out.astype(np.int64)


def links_between_components(members: DataFrame) -> DataFrame:
    """Links (a, b) that join the components still apart within each bucket, found on
    the full sets. Buckets are cut into cells; each pair of cells is a group of at
    most about ``2 * BLOCK`` documents. A group returns no more links than it has members."""
    cells = F.ceil(F.col("size") / BLOCK).cast("int")
    cell = F.pmod(F.xxhash64("node"), cells).cast("int")
    m = members.withColumn("cell", cell).withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    m = m.withColumns({"low": F.least("cell", "other"), "high": F.greatest("cell", "other")})

    def compare(group: pa.Table) -> pa.Table:
        node, comp = group.column("node").to_numpy(), group.column("component").to_numpy()
        cell = group.column("cell").to_numpy()
        low = group.column("low")[0].as_py()
        same = low == group.column("high")[0].as_py()
        rows = np.arange(len(node)) if same else np.flatnonzero(cell == low)
        cols = np.arange(len(node)) if same else np.flatnonzero(cell != low)
        a, b = [], []
        if len(rows) and len(cols) and len(np.unique(comp)) > 1:
            lists = group.column("shingles").combine_chunks()
            edge, flat_sets = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [flat_sets[edge[i]:edge[i + 1]] for i in range(len(node))]
            n = np.array([len(x) for x in sets])
            both = shared_counts(sets, rows, cols)
            near = both * 100 >= (n[rows][:, None] + n[cols][None, :] - both) * PERCENT
            near &= comp[rows][:, None] != comp[cols][None, :]
            root = {c: c for c in comp.tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c
            for i, j in zip(*np.nonzero(near)):
                x, y = find(int(comp[rows[i]])), find(int(comp[cols[j]]))
                if x != y:
                    root[x] = y
                    a.append(min(node[rows[i]], node[cols[j]]))
                    b.append(max(node[rows[i]], node[cols[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return m.groupBy("band", "low", "high").applyInArrow(compare, "a long, b long").distinct()


PRINTS = ["print_a", "print_b", "n_shingles"]


def linked_classes(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches of all rows; classes: prints, node, least (doc_id, uid); links between nodes)."""
    keyed = with_uid(docs).select(F.col("uid").alias("doc_id"), "text")
    sk = stored(sketches(docs, shingle), "sketches")
    classes = sk.where("n_shingles > 0 and uid is not null").groupBy(*PRINTS).agg(
        F.min("uid").alias("node"), F.min(F.struct("doc_id", "uid")).alias("least"))
    classes = stored(classes, "classes")
    # a class's sketch is that of its node
    nodes = sk.join(classes.select("node", *[F.col(c).alias(f"c_{c}") for c in PRINTS]),
                    (F.col("uid") == F.col("node")) & (F.col("print_a") == F.col("c_print_a"))
                    & (F.col("print_b") == F.col("c_print_b")) & (F.col("n_shingles") == F.col("c_n_shingles")), "left_semi")
    nodes = stored(nodes.select(F.col("uid").alias("node"), "n_shingles", "registers", "bands").dropDuplicates(["node"]), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).where("size > 1")
    buckets = buckets.withColumn("slices", slices_of(F.col("size")))
    members = stored(bands.join(buckets, "band").distinct(), "bucket-members")

    info = nodes.select("node", "n_shingles", "registers")
    side = lambda c: info.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    # a pivot meets its many near copies in slices, each with a copy of its sketch
    star = members.where("node != pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.max("slices").alias("slices"))
    star = stored(star, "star-candidates")
    star = sliced(star).join(side("b"), "b").join(copied(side("a"), star), PIVOT)
    star = star.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
    star = star.where(estimate("r_a", "r_b", "n_a", "n_b") >= ESTIMATE_CUT).select("a", "b", "slices")
    links = stored(confirmed(keyed, stored(star, "star-pairs"), shingle), "star-links")

    # buckets whose members are not known to be connected, one of those with equal members
    m = members.where("size > 2").join(stored(known_connections(links), "known-connections"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = (m.groupBy("band", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                           F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
             .where("lo != hi").groupBy("size", "who").agg(F.min("band").alias("band")).select("band"))
    m = stored(m.join(stored(apart, "open-buckets"), "band").select("band", "size", "node", "component"), "open-members")
    wanted = small_side(stored(m.select(F.col("node").alias("doc_id")).distinct(), "open-nodes"), IDS_BROADCAST)
    ids = keyed.join(wanted, "doc_id")
    sets = shingle_sets(ids.withColumn("own", F.col("doc_id")), shingle, "own").select(F.col("doc_id").alias("node"), "shingles")
    more = stored(links_between_components(m.join(sets, "node")), "more-links")
    return sk, classes, links.unionByName(more)


def class_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with the smallest (doc_id, uid) of their component as ``least``."""
    comps = components(links)
    c = stored(classes.join(comps, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component"), "class-roots")
    least = c.groupBy("root").agg(F.min("least").alias("least"))
    return stored(c.drop("least").join(least, "root"), "class-components")


def of_rows(sk: DataFrame, c: DataFrame) -> DataFrame:
    """Each row with ``least`` of its class; null for rows without words or doc_id."""
    c = c.select(*[F.col(x).alias(f"c_{x}") for x in PRINTS], "least")
    return sk.select("doc_id", "uid", *PRINTS).join(c, [F.col(x) == F.col(f"c_{x}") for x in PRINTS] + [F.col("uid").isNotNull()], "left")


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    with shuffle_files_removed(docs.sparkSession):
        return document_components(docs, shingle)


def document_components(docs: DataFrame, shingle: int) -> DataFrame:
    sk, classes, links = linked_classes(docs, shingle)
    # rows of one doc_id are one document: their classes are linked with the smallest of them
    several = stored(sk.where("uid is not null").groupBy("doc_id").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"))
                     .where("lo != hi").select(F.col("doc_id").alias("shared")), "shared-ids")
    shared = sk.join(small_side(several, IDS_BROADCAST), F.col("doc_id") == F.col("shared")).where("n_shingles > 0")
    of_class = classes.select("node", *[F.col(x).alias(f"c_{x}") for x in PRINTS])
    shared = stored(shared.join(of_class, [F.col(x) == F.col(f"c_{x}") for x in PRINTS]).select("doc_id", "node").distinct(), "shared-classes")
    hub = shared.groupBy("doc_id").agg(F.min("node").alias("a"))
    same = shared.join(hub, "doc_id").where("node != a").select("a", F.col("node").alias("b"))
    c = class_components(classes, links.unionByName(same))
    # a row without words goes with the other rows of its doc_id
    wordless = (shared.select("doc_id", "node").join(c.select("node", F.col("least.doc_id").alias("with")), "node")
                .groupBy(F.col("doc_id").alias("shared")).agg(F.min("with").alias("with")))
    out = of_rows(sk, c).join(small_side(stored(wordless, "wordless"), IDS_BROADCAST), F.col("doc_id") == F.col("shared"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "with", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each component (the smallest doc_id) left; same columns. Each
    row counts by its own text; of repeated rows one stays; rows without doc_id or words all stay."""
    with shuffle_files_removed(docs.sparkSession):
        return without_repeats(docs, shingle)


def without_repeats(docs: DataFrame, shingle: int) -> DataFrame:
    sk, classes, links = linked_classes(docs, shingle)
    found = stored(of_rows(sk, class_components(classes, links)).where("least is not null").select("uid", F.col("least.uid").alias("stays")), "near-duplicates")
    drop = small_side(stored(found.where("uid != stays").select(F.col("uid").alias("gone")).distinct(), "dropped"), IDS_BROADCAST)
    often = found.where("uid = stays").groupBy("uid").count().where("count > 1")
    often = small_side(stored(often.select(F.col("uid").alias("often")), "repeated"), IDS_BROADCAST)
    packed = docs.select(row_uid().alias("uid"), F.struct(*docs.columns).alias("whole_row"))
    left = packed.join(drop, F.col("uid") == F.col("gone"), "left_anti")
    once = left.join(often, F.col("uid") == F.col("often"), "left_anti")
    again = left.join(often, F.col("uid") == F.col("often"), "left_semi").dropDuplicates(["uid"])
    return once.unionByName(again).select("whole_row.*")
