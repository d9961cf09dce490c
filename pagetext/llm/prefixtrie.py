"""Conversation prefix trie: splitter-skeleton.

Conversations become paths of turns; a node is a distinct prefix. Paths are
range-partitioned in lexicographic order into shards. The first path of each
shard is a splitter, and the trie of the splitters' paths is the skeleton: a
node with members in two shards is a prefix of the splitter between them, so
every node outside the skeleton lies whole in one shard. The splitters are
broadcast; each task walks its sorted shard once with a stack, finishes all
other nodes, and emits partial aggregates of the skeleton nodes, which are
summed by node and rolled up along the skeleton.

Bounds. A path is cut into blocks of ``DEPTH`` turns, so a row holds at most
that many whatever a conversation's length; a block is keyed by a 128-bit hash
of all turns before it and forms a trie of its own, whose root's sums are handed
to the block above. A block whose prefix only one conversation has needs no trie:
its nodes are the conversation's own. Only prefixes that two conversations share
take rounds, one per ``DEPTH`` shared turns. Splitters: one row of at most 1.3 KB
a shard. Skeleton: at most ``DEPTH`` + 1 nodes a shard, rolled up on the driver.
Positions of turns are counted by sorted range and carried from range to range,
so one conversation may hold any share of the rows. The ids that end at a skeleton
node are hashed as a stream of chunks.

Turns are compared by the MD5 of role and text (128 bits). Order: turn (null
first), equal turns by that hash. Rows without conv_id belong to no
conversation and are left out; repeated rows are turns of their own. An empty
table has no nodes, not even a root. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_side, stored, text_or_empty

DEPTH = 64            # turns of a path in one row
KEY = 16              # bytes of a turn's hash
HEADS = 6             # a rebuilt conversation starts with fewer turns than this of its base
SHARD_ROWS = 200_000
CHUNK_IDS = 4096      # ids of a skeleton node hashed from one row
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
FIELDS = [f.split()[0] for f in NODE.split(", ")]
# What a shard emits: finished nodes (of a skeleton parent, if any), roots of blocks below the first,
# partial sums of skeleton nodes, and chunks of ids that end at them.
FOUND = ("kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, skeleton long, p1 long, p2 long, chars long, below_children long, "
         "below_leaves long, below_saved long, part long, ids string")
FOUND_SCHEMA = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in FOUND.split(", ")])


# ------------------------------------------------------------------ paths
def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, part, at, key, chars; runs: conv_id, part, first, before,
    n): the turns in order by sorted range, and for each conversation in each
    range the number of its turns in earlier ranges."""
    role, text = text_or_empty("role"), text_or_empty("text")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.char_length(text).cast("int").alias("chars"))
    order = ["conv_id", "turn", "key"]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = (turns.repartitionByRange(n, *order).sortWithinPartitions(*order)
             .withColumn("at", F.monotonically_increasing_id()))
    turns = stored(turns, "trie-turns").withColumn("part", F.shiftright("at", 33))
    runs = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # one row per conversation and range: few, however many turns it has
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def rebuilt_blocks(conversations: DataFrame) -> DataFrame:
    """The rebuilt paths in blocks of ``DEPTH`` turns: conv_id, block, keys
    (binary), chars, last, x1 and x2 (hash of the block), a stored table."""
    turns, runs = numbered_turns(conversations)
    runs = stored(runs, "trie-runs")
    head_size = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 100
    place = F.col("at") - F.col("first") + F.col("before")
    heads = (turns.where("conv_id % 100 = 0").join(runs.where(F.col("before") < HEADS - 1), ["conv_id", "part"])
             .select("conv_id", place.alias("pos"), "key", "chars").where(F.col("pos") < HEADS - 1)
             .groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "key", "chars"))).alias("head")))
    # at most a hundred conversations share a base
    convs = (runs.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
             .select("conv_id", "n_own", head_size.alias("h"), base.alias("base"))
             .join(heads, "base", "left")
             .withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("h"))))
             .withColumn("n_head", F.greatest(F.size("head"), F.lit(0)))
             .withColumn("n_turns", F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))))
    convs = stored(convs.select("conv_id", "h", "head", "n_head", "n_turns"), "trie-heads")
    own = (turns.join(runs.join(convs.select("conv_id", "h", "n_head", "n_turns"), "conv_id"), ["conv_id", "part"])
           .where(place >= F.col("h"))
           .select("conv_id", (place - F.col("h") + F.col("n_head")).alias("pos"), "key", "chars", "n_turns"))
    # a conversation without turns keeps one row without key; so does, in the next block, one that ends with its block:
    # it is a member of the node that block starts from
    at_edge = convs.where(f"n_turns > 0 and n_turns % {DEPTH} = 0").select(
        "conv_id", F.col("n_turns").alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("chars"), "n_turns")
    first = (convs.select("conv_id", "n_turns", F.posexplode_outer("head").alias("pos", "t"))
             .select("conv_id", F.col("pos").cast("long").alias("pos"), "t.key", "t.chars", "n_turns"))
    turn = F.when(F.col("key").isNotNull(), F.struct("pos", "key", "chars"))
    both = first.unionByName(own).unionByName(at_edge)
    blocks = both.groupBy("conv_id", F.coalesce(F.expr(f"pos div {DEPTH}"), F.lit(0)).alias("block")).agg(
        F.array_sort(F.collect_list(turn)).alias("path"), F.first("n_turns").alias("n_turns"),
        F.coalesce(F.bit_xor(F.when(F.col("key").isNotNull(), F.xxhash64(F.lit(1), "pos", "key"))), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor(F.when(F.col("key").isNotNull(), F.xxhash64(F.lit(2), "pos", "key"))), F.lit(0)).alias("x2"))
    return stored(blocks.select(
        "conv_id", "block", F.unhex(F.array_join(F.col("path.key"), "")).alias("keys"),
        F.col("path.chars").alias("chars"), "x1", "x2",
        (F.col("n_turns") <= (F.col("block") + 1) * DEPTH).alias("last"),
        (F.col("n_turns") >= DEPTH).alias("long")), "trie-blocks")


def with_prefixes(blocks: DataFrame) -> DataFrame:
    """Blocks with p1, p2 (hash of the turns before) and q1, q2 (hash up to its end)."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a row here is 64 turns of a long conversation, and 32 bytes wide
    long = blocks.where("long").select("conv_id", "block", *[
        F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"p{i}") for i in (1, 2)])
    short = blocks.where("not long").withColumns({"p1": F.lit(0).cast("long"), "p2": F.lit(0).cast("long")})
    both = short.unionByName(blocks.where("long").join(long, ["conv_id", "block"]))
    return both.withColumns({f"q{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}).drop("x1", "x2", "long")


# ------------------------------------------------------------------ shards
def common_turns(a: tuple, b: tuple) -> int:
    """Turns that two paths (p1, p2, keys) share; -1 in different tries."""
    if a[0] != b[0] or a[1] != b[1]:
        return -1
    x, y = a[2], b[2]
    low, high = 0, min(len(x), len(y)) // KEY
    while low < high:                                  # longest equal prefix, in turns
        mid = (low + high + 1) // 2
        if x[:mid * KEY] == y[:mid * KEY]:
            low = mid
        else:
            high = mid - 1
    return low


class Skeleton:
    """The trie of the splitters. Node (i, d): the first d turns of splitter i, the
    first that has them; its number is i * (DEPTH + 1) + d."""

    def __init__(self, splitters: list[tuple]):
        self.splitters = splitters
        # owners[j]: runs (depth up to which, splitter) in ascending depth
        self.owners: list[list[tuple[int, int]]] = []
        for j, s in enumerate(splitters):
            shared = common_turns(splitters[j - 1], s) if j else -1
            runs = [(min(d, shared), i) for d, i in self.owners[-1]] if j else []
            kept: list[tuple[int, int]] = []
            for d, i in runs:
                if d > (kept[-1][0] if kept else -1):
                    kept.append((d, i))
            if len(s[2]) // KEY > shared:
                kept.append((len(s[2]) // KEY, j))
            self.owners.append(kept)

    def number(self, j: int, depth: int) -> int:
        runs = self.owners[j]
        return runs[bisect_right(runs, (depth - 1, len(self.splitters)))][1] * (DEPTH + 1) + depth

    def parent(self, number: int) -> int | None:
        j, depth = divmod(number, DEPTH + 1)
        return self.number(j, depth - 1) if depth else None

    def trie(self, number: int) -> tuple[int, int]:
        return self.splitters[number // (DEPTH + 1)][:2]


class Frame:
    """An open node of the walk."""
    __slots__ = ("number", "n", "least", "children", "leaves", "saved", "chars", "below", "ends", "ids", "waiting")

    def __init__(self, number: int | None, chars: int):
        self.number, self.chars = number, chars
        self.n = self.children = self.leaves = self.saved = 0
        self.least = None
        self.below = (0, 0, 0)
        self.ends = None       # hash of the ids that end here
        self.ids: list[str] = []
        self.waiting: list[tuple] = []   # finished children, until the smallest member is known


class ShardWalk:
    """One pass over a sorted shard; ``found`` holds rows of ``FOUND``."""

    def __init__(self, part: int, skeleton: Skeleton, block: int):
        self.part, self.skeleton, self.block = part, skeleton, block
        self.stack: list[Frame] = []
        self.path: tuple | None = None
        self.found: list[tuple] = []

    def emit(self, kind, conv=None, depth=None, parent=None, n=None, children=None, leaves=None, saved=None, sha=None,
             skeleton=None, trie=(None, None), chars=None, below=(None, None, None), ids=None):
        self.found.append((kind, conv, depth, parent, n, children, leaves, saved, sha, skeleton, *trie, chars, *below,
                           self.part, ids))

    def chunk(self, f: Frame) -> None:
        self.emit("ids", skeleton=f.number, ids=",".join(f.ids))
        f.ids = []

    def pop(self) -> None:
        f = self.stack.pop()
        depth, up = len(self.stack), self.stack[-1] if self.stack else None
        if up is not None:
            up.n += f.n
            up.least = f.least if up.least is None else min(up.least, f.least)
        for row in f.waiting:
            self.emit("node", row[0], row[1], f.least, *row[2:])
        if f.number is not None:
            if f.ids:
                self.chunk(f)
            self.emit("part", f.least, depth, n=f.n, children=f.children, leaves=f.leaves, saved=f.saved,
                      skeleton=f.number, chars=f.chars, below=f.below)
            return
        children = f.children + f.below[0]
        leaves = f.leaves + f.below[1] if children else 1
        saved = f.saved + f.below[2]
        if not depth and self.block:              # the node itself belongs to the block above
            self.emit("root", f.least, n=f.n, children=children, leaves=leaves, saved=saved, trie=self.path[:2])
            return
        saved += (f.n - 1) * f.chars
        sha = f.ends.hexdigest() if f.ends else EMPTY_SHA
        row = (f.least, self.block * DEPTH + depth, f.n, children, leaves, saved, sha)
        if up is None or up.number is not None:
            self.emit("node", row[0], row[1], None, *row[2:], skeleton=None if up is None else up.number)
        else:
            up.waiting.append(row)
        if up is not None:
            up.children += 1
            up.leaves += leaves
            up.saved += saved

    def close(self) -> None:
        while self.stack:
            self.pop()

    def add(self, conv: int, path: tuple, chars: list, last: bool, below: tuple) -> None:
        shared = common_turns(self.path, path) if self.path is not None else -1
        while len(self.stack) > shared + 1:
            self.pop()
        self.path = path
        on_skeleton, j = -1, 0
        for i in (self.part, self.part + 1):
            if i < len(self.skeleton.splitters):
                d = common_turns(self.skeleton.splitters[i], path)
                if d > on_skeleton:
                    on_skeleton, j = d, i
        for depth in range(len(self.stack), len(path[2]) // KEY + 1):
            number = self.skeleton.number(j, depth) if depth <= on_skeleton else None
            self.stack.append(Frame(number, chars[depth - 1] if depth else 0))
        f = self.stack[-1]
        f.n += 1
        f.least = conv if f.least is None else min(f.least, conv)
        if not last:
            f.below = below
        elif self.block and not path[2]:
            pass                                  # its end stands in the block above
        elif f.number is not None:
            f.ids.append(str(conv))
            if len(f.ids) >= CHUNK_IDS:
                self.chunk(f)
        elif f.ends is None:
            f.ends = hashlib.sha256(str(conv).encode())
        else:
            f.ends.update(f",{conv}".encode())


def found_batches(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), FOUND_SCHEMA)], schema=FOUND_SCHEMA)


def trie_level(spark, rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(nodes, roots) of the tries of one block number; rows: conv_id, p1, p2, keys,
    chars, last, below_children, below_leaves, below_saved."""
    order = ["p1", "p2", "keys", "conv_id"]
    rows = stored(rows, "trie-level")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // SHARD_ROWS + 1)
    shards = stored(rows.repartitionByRange(n, *order).withColumn("shard", F.spark_partition_id()), "trie-shards")
    # one splitter a shard; shards are numbered without gaps
    firsts = (shards.groupBy("shard").agg(F.min(F.struct("p1", "p2", "keys", "conv_id")).alias("s"))
              .orderBy("shard").select("shard", "s.p1", "s.p2", "s.keys").collect())
    skeleton = Skeleton([(r["p1"], r["p2"], bytes(r["keys"])) for r in firsts])
    number = spark.createDataFrame([(r["shard"], i) for i, r in enumerate(firsts)], "shard int, part int")
    shared = spark.sparkContext.broadcast(skeleton)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("part", "conv_id", "p1", "p2", "keys", "chars", "last",
                                                     "below_children", "below_leaves", "below_saved")]
            for part, conv, p1, p2, keys, chars, last, *below in zip(*cols):
                if w is None or w.part != part:
                    if w is not None:
                        w.close()
                        if w.found:
                            yield found_batches(w.found)
                    w = ShardWalk(part, shared.value, block)
                w.add(conv, (p1, p2, keys), chars, last, tuple(below))
                if len(w.found) >= 8192:
                    yield found_batches(w.found)
                    w.found = []
        if w is not None:
            w.close()
            yield found_batches(w.found)

    dealt = (shards.join(F.broadcast(number), "shard").drop("shard")
             .repartitionById(max(len(firsts), 1), F.col("part")).sortWithinPartitions("part", *order))
    found = stored(dealt.mapInArrow(walk, FOUND), "trie-found")
    return finished(spark, found, skeleton, block)


def finished(spark, found: DataFrame, skeleton: Skeleton, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Skeleton nodes from their partial sums, and the nodes below them with their parents."""
    parts = (found.where("kind = 'part'").groupBy("skeleton")
             .agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
                  *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                  *[F.max(c).alias(c) for c in ("below_children", "below_leaves", "below_saved")]).collect())
    sums = {r["skeleton"]: r.asDict() for r in parts}
    for s in sums.values():
        s["n_children"] += s["below_children"]
        s["n_leaves"] += s["below_leaves"]
        s["saved_tokens"] += s["below_saved"]
    nodes, roots = [], []
    for number, s in sorted(sums.items(), key=lambda x: -x[1]["depth"]):
        if not s["n_children"]:
            s["n_leaves"] = 1
        above = sums.get(skeleton.parent(number))
        if not s["depth"] and block:
            roots.append((*skeleton.trie(number), s["n_children"], s["n_leaves"], s["saved_tokens"]))
            nodes.append((number, s["conv_id"], None, None, None, None, None, None))
            continue
        s["saved_tokens"] += (s["n_convs"] - 1) * s["chars"]
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += s["n_leaves"]
            above["saved_tokens"] += s["saved_tokens"]
        nodes.append((number, s["conv_id"], block * DEPTH + s["depth"], above and above["conv_id"], s["n_convs"],
                      s["n_children"], s["n_leaves"], s["saved_tokens"]))
    upper = spark.createDataFrame(nodes, "skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, "
                                         "n_children long, n_leaves long, saved_tokens long")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            for number, ids in zip(b.column("skeleton").to_pylist(), b.column("ids").to_pylist()):
                if number != at:
                    if h is not None:
                        yield pa.RecordBatch.from_pydict({"skeleton": [at], "sha": [h.hexdigest()]})
                    at, h = number, hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
        if h is not None:
            yield pa.RecordBatch.from_pydict({"skeleton": [at], "sha": [h.hexdigest()]})

    # rows of one path stand in the order of their ids, so a chunk's first id orders the chunks of a node
    chunks = found.where("kind = 'ids'").select("skeleton", F.split("ids", ",")[0].cast("long").alias("from"), "ids")
    ends = chunks.repartition("skeleton").sortWithinPartitions("skeleton", "from").mapInArrow(hashes, "skeleton long, sha string")
    known = upper.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA)))
    below = found.where("kind = 'node'").select(*FIELDS, "skeleton").join(
        small_side(upper.select("skeleton", F.col("conv_id").alias("above"))), "skeleton", "left")
    below = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*FIELDS)
    all_nodes = below.unionByName(known.where("depth is not null").select(*FIELDS))
    if not block:
        return all_nodes, None
    tops = found.where("kind = 'root'").select("p1", "p2", "n_children", "n_leaves", "saved_tokens")
    return all_nodes, tops.unionByName(spark.createDataFrame(
        roots, "p1 long, p2 long, n_children long, n_leaves long, saved_tokens long"))


def own_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of blocks whose prefix no other conversation has."""
    size = F.size("chars")
    here = (F.col("i") + 1 == size) & F.col("last")
    d = rows.where(size > 0).select("conv_id", "block", "last", "chars", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return d.select("conv_id", (F.col("block") * DEPTH + F.col("i") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
                    one.alias("n_convs"), F.when(here, none).otherwise(one).alias("n_children"), one.alias("n_leaves"),
                    none.alias("saved_tokens"),
                    F.when(here, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY_SHA).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    blocks = with_prefixes(rebuilt_blocks(conversations))
    deeper = blocks.where("block > 0")
    shared = (deeper.groupBy("block", "p1", "p2").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
              .select("block", "p1", "p2", F.lit(True).alias("shared")))
    shared = stored(shared, "trie-shared")
    marked = stored(deeper.join(shared, ["block", "p1", "p2"], "left"), "trie-deeper")
    levels = [r["block"] for r in shared.groupBy("block").agg(F.count(F.lit(1))).collect()]   # one row per DEPTH shared turns
    nodes = own_nodes(marked.where("shared is null"))
    roots = None
    for block in range(max(levels, default=0), -1, -1):
        rows = marked.where(F.col("block") == block).where("shared") if block else blocks.where("block = 0")
        goes_on = ~F.col("last")
        if roots is None:
            below = [F.when(goes_on, F.lit(v)).otherwise(0).cast("long").alias(c) for c, v in
                     (("below_children", 1), ("below_leaves", 1), ("below_saved", 0))]
        else:
            roots = roots.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), "n_children", "n_leaves", "saved_tokens")
            rows = rows.join(roots, ["q1", "q2"], "left")
            below = [F.when(goes_on, F.coalesce(c, F.lit(v))).otherwise(0).cast("long").alias(name) for name, c, v in
                     (("below_children", "n_children", 1), ("below_leaves", "n_leaves", 1), ("below_saved", "saved_tokens", 0))]
        found, roots = trie_level(spark, rows.select("conv_id", "p1", "p2", "keys", "chars", "last", *below), block)
        nodes = nodes.unionByName(found)
    return nodes.select(*FIELDS)
