"""LM scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions; the decision after bits ``p`` of the byte
(node number 1 followed by those bits) has its own context tree over the
``DEPTH`` bytes before it (Willems, Shtarkov, Tjalkens 1995; Volf 2002). At a
context the Krichevsky-Trofimov estimate Pe of its training counts is mixed
with the product of its children: Pw = (Pe + product) / 2, at full depth
Pw = Pe. The trained tree predicts a bit by w * KT + (1 - w) * (prediction one
byte deeper) with w = Pe / (2 Pw), so all depths take part. A text is its UTF-8
bytes and an end mark; 0xFF, which UTF-8 never uses, is that mark and stands
for the bytes before the text. The score is the log10 probability of the whole
text, the code length per byte its bits over the symbols.

How it runs: the rows are written once, numbered into blocks of ``BLOCK_BYTES``
of text; both passes read that table, so a row keeps its block however the
scans are split. A pass over the blocks emits, per block, the distinct words and (context, byte) grams with their
training counts. Totals come from a shuffle on the word or gram; the tree is
computed per pair of preceding bytes (a group has at most 2^24 grams whatever
the input) and above that on one row per byte and node. Each block then gets
back the counts and probabilities of its own words and grams and scores its
texts; a word or gram that is not among them is an error. No table of the whole
model goes to any task or to the driver.

Nulls: a null text is empty (one end mark); a null doc_id counts as the empty
id. Repeated rows are scored (and learned) each. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import LOWER, U64, chunks, flat, span_hashes, words
from .tables import stored

DEPTH = 4            # bytes of context; a gram packs DEPTH + 1 bytes into a long
MARK = 0xFF
FOLDS, HELD_OUT_FOLD = 7, 2
BLOCK_BYTES, ROW_BYTES = 96 << 20, 16       # text of a block (plus at most one text); added for each row
MERGE_ROWS, OUT_ROWS = 200_000, 50_000      # entries held before a merge; rows of an output batch
LN10 = float(np.log(10.0))


def is_held_out(doc_id: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(FOLDS)) == HELD_OUT_FOLD


def in_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out, block: rows numbered into blocks of at most ``BLOCK_BYTES``
    and one text. The numbers follow the partitions of this scan: store before use."""
    size = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            _, offsets = flat(b.column("text"))
            at = seen + offsets + ROW_BYTES * np.arange(len(offsets))
            block = (b.column("part").to_numpy().astype(np.int64) << 32) + at[:-1] // size
            seen = int(at[-1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "text", "held_out")], pa.array(block)],
                                             names=["doc_id", "text", "held_out", "block"])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_held_out(F.col("doc_id")).alias("held_out"),
                    F.spark_partition_id().alias("part"))
    return d.mapInArrow(run, "doc_id long, text string, held_out boolean, block long")


# ------------------------------------------------------------------ symbols of a chunk
def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text number) of each byte and end mark, in order; the last byte of a
    gram is the symbol, the one before it the most recent context byte."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    text = np.repeat(np.arange(n), lengths + 1)
    stream = np.full(len(data) + n * (DEPTH + 1), MARK, np.uint8)
    stream[np.arange(len(data)) + np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, lengths)] = data
    at = np.arange(len(text)) + text * DEPTH
    wide = stream.astype(U64)
    packed = wide[:len(wide) - DEPTH].copy()
    for i in range(1, DEPTH + 1):
        packed <<= U64(8)
        packed |= wide[i:len(wide) - DEPTH + i]
    return packed[at], text


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return values[edge], np.diff(np.append(edge, len(values)))


def take_texts(batch: pa.RecordBatch, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return flat(batch.column("text").filter(pa.array(keep)))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow binary column."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[index])])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a first occurrence, sum) of each distinct key, by key."""
    if not len(keys):
        return np.zeros(0, np.int64), counts
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    return order[edge], np.add.reduceat(counts[order], edge)


class BlockCounts:
    """Distinct words and grams of one block with their training counts. What chunks add
    is merged whenever it has doubled, so memory follows the distinct entries."""

    def __init__(self, block: int):
        self.block, self.held, self.limit = block, [], MERGE_ROWS
        self.grams, self.gram_counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.hashes, self.word_counts, self.words = np.zeros(0, U64), np.zeros(0, np.int64), pa.array([], pa.large_binary())

    def add(self, batch: pa.RecordBatch) -> None:
        trained = np.array(batch.column("trained").to_pylist(), dtype=bool)
        for flag in (True, False):
            data, offsets = take_texts(batch, trained == flag)
            if len(offsets) < 2:
                continue
            g, n = distinct(grams(data, offsets)[0])
            data = LOWER[data]
            starts, ends, _ = words(data, offsets)
            h = span_hashes(data, starts, ends)
            first, count = summed(h, np.ones(len(h), np.int64))
            self.held.append((g, n * flag, h[first], count * flag, gather(data, starts[first], ends[first])))
        if sum(len(x[0]) + len(x[2]) for x in self.held) > self.limit:
            self.merge()

    def merge(self) -> None:
        g, gn, h, hn, w = zip((self.grams, self.gram_counts, self.hashes, self.word_counts, self.words), *self.held)
        self.held = []
        g, h = np.concatenate(g), np.concatenate(h)
        first, self.gram_counts = summed(g, np.concatenate(gn))
        self.grams = g[first]
        first, self.word_counts = summed(h, np.concatenate(hn))
        self.hashes = h[first]
        self.words = pa.concat_arrays([x.cast(pa.large_binary()) for x in w]).take(pa.array(first))
        self.limit = max(MERGE_ROWS, len(self.grams) + len(self.hashes))
        pa.default_memory_pool().release_unused()

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for at in range(0, len(self.grams), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            gram = pa.array(self.grams[part].view(np.int64))
            yield self.batch(gram, pa.nulls(len(gram), pa.binary()), self.gram_counts[part])
        for at in range(0, len(self.hashes), OUT_ROWS):
            word = self.words.slice(at, OUT_ROWS).cast(pa.binary())
            yield self.batch(pa.nulls(len(word), pa.int64()), word, self.word_counts[at:at + OUT_ROWS])

    def batch(self, gram: pa.Array, word: pa.Array, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(count), self.block, np.int64)), gram, word, pa.array(count.astype(np.int64))],
                                          names=["block", "gram", "word", "n"])


def block_counts(docs: DataFrame) -> DataFrame:
    """(block, gram or word, n): what each block holds, n its training count (may be 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in chunks(batches, "text"):
            blocks = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if now is None or now.block != blocks[lo]:
                    if now is not None:
                        yield from now.rows()
                    now = BlockCounts(blocks[lo])
                now.add(b.slice(lo, hi - lo))
        if now is not None:
            yield from now.rows()
    return docs.select("block", "trained", "text").mapInArrow(run, "block long, gram long, word binary, n long")


# ------------------------------------------------------------------ the tree
def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 12, brought back by the recurrence."""
    shift = np.zeros_like(x)
    for i in range(12):
        shift += np.log(x + i)
    y = x + 12
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    zeros, ones = zeros.astype(float), ones.astype(float)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def weighted(log_pe: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln Pw, w) of inner nodes."""
    log_pw = np.logaddexp(log_pe, log_children) - np.log(2.0)
    return log_pw, np.exp(log_pe - np.log(2.0) - log_pw)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


class Subtree:
    """All nodes whose context ends in two given bytes, for the grams of that group.
    levels[0] holds the two-byte contexts, levels[-1] the full ones."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        symbol = gram & 0xFF
        self.node = np.stack([(1 << k) | (symbol >> (8 - k)) for k in range(8)])      # (8, grams)
        self.bit = np.stack([(symbol >> (7 - k)) & 1 for k in range(8)])
        n = np.broadcast_to(n, self.node.shape)
        self.levels = []
        keys = (gram >> 8)[None, :] * 256 + self.node
        inverse = None
        for depth in range(DEPTH, 1, -1):
            mask = (1 << (8 * depth)) - 1
            if inverse is None:
                key, inverse = np.unique((keys >> 8 & mask) << 8 | self.node, return_inverse=True)
                inverse = inverse.ravel()
                ones = np.bincount(inverse, weights=(n * self.bit).ravel(), minlength=len(key))
                total = np.bincount(inverse, weights=n.ravel(), minlength=len(key))
                self.leaf = inverse.reshape(self.node.shape)
                log_pe = log_kt(total - ones, ones)
                level = {"key": key, "ones": ones, "zeros": total - ones, "pw": log_pe, "w": np.ones(len(key))}
            else:
                below = self.levels[0]
                key, parent = np.unique((below["key"] >> 8 & mask) << 8 | (below["key"] & 0xFF), return_inverse=True)
                parent = parent.ravel()
                below["parent"] = parent
                add = lambda v: np.bincount(parent, weights=v, minlength=len(key))
                ones, zeros = add(below["ones"]), add(below["zeros"])
                log_pw, w = weighted(log_kt(zeros, ones), add(below["pw"]))
                level = {"key": key, "ones": ones, "zeros": zeros, "pw": log_pw, "w": w}
            self.levels.insert(0, level)

    def log10(self, known: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol, given for the nodes of levels[0]
        what the shallower depths contribute and the weight they leave."""
        for i, level in enumerate(self.levels):
            if i:
                known, rest = known[level["parent"]], rest[level["parent"]]
            known = known + rest * level["w"] * kt_one(level["zeros"], level["ones"])
            rest = rest * (1 - level["w"])
        p = known[self.leaf]
        return np.log(np.where(self.bit == 1, p, 1 - p)).sum(0) / LN10


def top_nodes(counts: DataFrame) -> DataFrame:
    """(pair, node, zeros, ones, log_pw) of the two-byte contexts."""
    def run(group: pa.Table) -> pa.Table:
        top = Subtree(group.column("gram").to_numpy(), group.column("n").to_numpy()).levels[0]
        pair = group.column("pair")[0].as_py()
        return pa.table({"pair": np.full(len(top["key"]), pair), "node": top["key"] & 0xFF, "zeros": top["zeros"],
                         "ones": top["ones"], "log_pw": top["pw"]})
    return counts.groupBy("pair").applyInArrow(run, "pair long, node long, zeros double, ones double, log_pw double")


def upper_levels(top: DataFrame) -> DataFrame:
    """(last, node, known, rest): what the contexts of no and of one byte contribute to
    each node, and the weight left for deeper ones. Rows: at most 256 bytes times 255
    nodes, so the aggregate is small whatever the input."""
    one = top.groupBy(F.col("pair").bitwiseAND(F.lit(0xFF)).alias("last"), "node").agg(
        *[F.sum(c).alias(c) for c in ("zeros", "ones", "log_pw")])

    def run(group: pa.Table) -> pa.Table:
        z1, o1 = group.column("zeros").to_numpy(), group.column("ones").to_numpy()
        pw1, w1 = weighted(log_kt(z1, o1), group.column("log_pw").to_numpy())
        z0, o0 = z1.sum(keepdims=True), o1.sum(keepdims=True)
        _, w0 = weighted(log_kt(z0, o0), pw1.sum(keepdims=True))
        known = w0 * kt_one(z0, o0) + (1 - w0) * w1 * kt_one(z1, o1)
        return pa.table({"last": group.column("last"), "node": group.column("node"), "known": known, "rest": (1 - w0) * (1 - w1)})
    return one.groupBy("node").applyInArrow(run, "last long, node long, known double, rest double")


def gram_scores(counts: DataFrame) -> DataFrame:
    """(gram, log10_p) from (gram, pair, n), where pair is the two bytes before the symbol."""
    top = stored(top_nodes(counts), "ctw-top")
    upper = stored(upper_levels(top), "ctw-upper")
    per_pair = (top.select("pair", "node", F.col("pair").bitwiseAND(F.lit(0xFF)).alias("last"))
                .join(upper, ["last", "node"]).select("pair", "node", "known", "rest"))

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        gram = group.column("gram").to_numpy()
        tree = Subtree(gram, group.column("n").to_numpy())
        node = above.column("node").to_numpy()
        order = np.argsort(node)
        at = order[np.searchsorted(node[order], tree.levels[0]["key"] & 0xFF)]
        score = tree.log10(above.column("known").to_numpy()[at], above.column("rest").to_numpy()[at])
        return pa.table({"gram": gram, "log10_p": score})
    return counts.groupBy("pair").cogroup(per_pair.groupBy("pair")).applyInArrow(run, "gram long, log10_p double")


# ------------------------------------------------------------------ scoring
class Lookup:
    """Values by 64-bit key: a direct-mapped table, with binary search for keys that share a slot.
    A key that is not there raises."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(int(len(keys)).bit_length() + 2, 4)
        self.slot_of = np.zeros(1 << self.bits, np.int32)
        self.slot_of[self.slots(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return self.values[:0]
        if not len(self.keys):
            raise KeyError("keys looked up in an empty table")
        at = self.slot_of[self.slots(keys)].astype(np.int64)
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
        if (self.keys[at[other]] != keys[other]).any():
            raise KeyError("a word or gram of a block is missing from its table")
        return self.values[at]


def score_block(docs: pa.Table, known: pa.Table, total: int, distinct_tokens: int, ends: int) -> pa.Table:
    """Scores of one block's texts, given the counts and probabilities of all its words and grams."""
    gram = known.column("gram").combine_chunks()
    is_gram = gram.is_valid().to_numpy(zero_copy_only=False)
    gram_score = Lookup(gram.filter(pa.array(is_gram)).to_numpy().view(U64), known.column("value").to_numpy()[is_gram])
    data, offsets = flat(known.column("word").combine_chunks().filter(pa.array(~is_gram)))
    word_count = Lookup(span_hashes(data, offsets[:-1], offsets[1:]), known.column("value").to_numpy()[~is_gram])
    log_total = np.log10(total + 1.0 * (distinct_tokens + 1))
    out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
    rows = docs.combine_chunks().to_batches()
    for b in chunks(rows, "text"):
        data, offsets = flat(b.column("text"))
        n = len(offsets) - 1
        g, text = grams(data, offsets)
        out["score"].append(np.bincount(text, weights=gram_score(g), minlength=n))
        data = LOWER[data]
        starts, stops, text = words(data, offsets)
        c = word_count(span_hashes(data, starts, stops))
        out["n_tokens"].append(np.bincount(text, minlength=n) + 1)
        out["n_known"].append(np.bincount(text, weights=c > 0, minlength=n).astype(np.int64) + (ends > 0))
        base = np.bincount(text, weights=np.log10(c + 1.0) - log_total, minlength=n)
        out["base_score"].append(base + np.log10(ends + 1.0) - log_total)
        out["n_bytes"].append(np.diff(offsets))
    pa.default_memory_pool().release_unused()
    result = {k: np.concatenate(v) for k, v in out.items()}
    bits = -result["score"] * (LN10 / np.log(2.0)) / (result.pop("n_bytes") + 1)
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": result["n_tokens"],
                     "n_known": result["n_known"], "train_tokens": np.full(docs.num_rows, total),
                     "base_score": result["base_score"], "score": result["score"], "bits_per_byte": bits})


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10 probabilities), bits_per_byte."""
    d = stored(in_blocks(docs), "ctw-texts", "zstd")
    held = stored(block_counts(d.withColumn("trained", ~F.col("held_out"))), "ctw-blocks")

    by_word = held.where("word is not null")
    # a word has one row per block (more only where a split cuts one), so its window partition is short
    word_values = by_word.select("block", F.lit(None).cast("long").alias("gram"), "word",
                                 F.sum("n").over(Window.partitionBy("word")).cast("double").alias("value"))
    by_gram = held.where("gram is not null")
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("pair")
    counts = stored(by_gram.groupBy("gram").agg(F.sum("n").alias("n")).select("gram", pair, "n"), "ctw-grams")
    scores = stored(gram_scores(counts), "ctw-scores")
    gram_values = by_gram.select("block", "gram").join(scores, "gram").select(
        "block", "gram", F.lit(None).cast("binary").alias("word"), F.col("log10_p").alias("value"))

    ends = d.where("not held_out").count()
    w = by_word.groupBy("word").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    total, kinds = int(w["total"] or 0) + ends, int(w["distinct"] or 0) + (ends > 0)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        return score_block(texts, known, total, kinds, ends)

    return (d.groupBy("block").cogroup(word_values.unionByName(gram_values).groupBy("block"))
            .applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                               "base_score double, score double, bits_per_byte double"))
