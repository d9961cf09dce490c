"""Token-id files: canonical length-limited Huffman coding.

Documents are put in ascending doc_id order by range (null first, equal ids by
text hash), tokenised, an end id is appended to each, and the ids are coded by
their global counts. A file set is a folder with

* ``codebook``: (id, bits); the canonical codes follow from the lengths, which
  package-merge keeps within ``MAX_BITS``;
* ``blocks``: one row per block of at most ``BLOCK`` ids: part, row and offset
  (the place of its first id: range, document in the range, id in the document),
  ``payload`` (the codes, most significant bit first), ``checkpoints`` (bit
  offset of every ``LANE``-th id, 32-bit little-endian), and of each document the
  doc_id and how many of its ids the block holds;
* ``starts``: for each block the number of ids before it.

A block is decoded on its own: all stretches between checkpoints advance side
by side, each step looking up the next ``MAX_BITS`` bits of every stretch in one
table. A document may span blocks; CRC-32 values of its pieces are combined.

Bounds: a block, whatever a text's length; the codebook is as long as the
vocabulary; one row per range to the driver's window. Rows that are wholly equal
are spread over ranges by their scan order, which their result does not depend
on. A null or empty text has the end id only; an empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_table_path
from .bytebpe import encoder
from .packed import chunks, flat
from .tables import shuffle_files_removed, stored, text_or_empty

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
MAX_BITS = 18
BLOCK = 1 << 17
TEXT_BYTES = 1 << 22       # texts encoded at once
LANE = 128
BLOCK_SCHEMA = ("part int, row long, offset long, n_ids long, payload binary, checkpoints binary, "
                "doc_ids array<long>, lengths array<int>, whole array<boolean>")


# ------------------------------------------------------------------ ids
def token_ids(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """part, row (order within the part), doc_id, ids (packed), in ascending doc_id order over parts and rows."""
    order = ["doc_id", "tie", "scan"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"),
                       F.monotonically_increasing_id().alias("scan"), "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = placed.select(F.spark_partition_id().alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, True)
        end = bpe.packed([end_id])
        for b in chunks(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], bpe.encode_all(b.column("text"), end)], names=["part", "row", "doc_id", "ids"])
    return placed.mapInArrow(run, "part int, row long, doc_id long, ids binary")


def id_counts(tokens: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    """How often each id occurs: one vector per task, summed by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            ids = flat(b.column("ids"))[0].view(dtype)
            for at in range(0, len(ids), BLOCK):
                counts += np.bincount(ids[at:at + BLOCK], minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])
    out = np.zeros(size, np.int64)
    # at most one row per id of the vocabulary
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


# ------------------------------------------------------------------ codes
def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``limit`` bits (package-merge: Larmore, Hirschberg 1990); 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit into codes of {limit} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    used = used[np.lexsort((used, counts[used]))]
    weights = counts[used].astype(np.float64) if counts.sum() < 1 << 53 else counts[used].astype(object)
    # each level: items of the level below packed in pairs, merged with the single ids by weight
    singles, packages = [], np.zeros(0, weights.dtype)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        singles.append(order < n)
        merged = merged[order]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * n - 2          # items taken from the topmost level; each package among them takes two below
    for level in reversed(singles):
        chosen = int(level[:take].sum())
        lengths[used[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


class Codebook:
    """Canonical codes by (length, id), and the table that decodes them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.codes = np.zeros(len(lengths), np.uint32)
        self.top = int(lengths.max(initial=1))
        room = (1 << (self.top - lengths[order])).astype(np.int64)     # table entries of each code
        first = np.concatenate([[0], np.cumsum(room)]).astype(np.int64)
        if first[-1] > 1 << self.top:
            raise ValueError("the lengths are no prefix code")
        self.codes[order] = first[:-1] >> (self.top - lengths[order])
        self.ids = np.zeros(1 << self.top, np.uint32)
        self.ids[:first[-1]] = np.repeat(order, room)
        self.bits = np.zeros(1 << self.top, np.uint8)       # 0: no code
        self.bits[:first[-1]] = np.repeat(lengths[order], room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(payload, checkpoints) of one block."""
        bits = self.lengths[ids].astype(np.int64)
        if not bits.all():
            raise KeyError("an id without a code")
        ends = np.cumsum(bits)
        at = ends - bits
        word = self.codes[ids] << (32 - bits - (at & 7)).astype(np.uint32)      # at most 25 bits from a byte's edge
        byte, size = at >> 3, int(ends[-1] + 7 >> 3)
        out = np.zeros(size + 4, np.float64)
        for i in range(4):     # codes share no bits, so sums of bytes are their union
            out += np.bincount(byte + i, weights=(word >> np.uint32(24 - 8 * i)) & np.uint32(255), minlength=size + 4)
        return out[:size].astype(np.uint8).tobytes(), at[::LANE].astype("<u4").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ids of one block (``<u4``)."""
        data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        out = np.zeros((LANE, len(at)), "<u4")
        shift, last = np.uint32(32 - self.top), len(window) - 1
        full = n - (len(at) - 1) * LANE          # ids of the last stretch
        for step in range(min(LANE, n)):
            if step == full:
                at = at[:-1]
            code = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> shift
            out[step, :len(at)] = self.ids[code]
            bits = self.bits[code]
            if not bits.all():
                raise ValueError("the payload holds a code that the codebook has not")
            at = at + bits
        return out.T.reshape(-1)[:n].copy()


# ------------------------------------------------------------------ writing
def block_rows(batches: Iterator[pa.RecordBatch], book: Codebook, dtype: np.dtype) -> Iterator[dict]:
    """Blocks of consecutive rows of one part; a long document is cut at block ends."""
    start, ids, docs, held = None, [], [], 0

    def flush() -> dict:
        whole = np.concatenate(ids)
        payload, checkpoints = book.encode(whole)
        return {"part": start[0], "row": start[1], "offset": start[2], "n_ids": len(whole), "payload": payload,
                "checkpoints": checkpoints, "doc_ids": [d[0] for d in docs], "lengths": [d[1] for d in docs],
                "whole": [d[2] for d in docs]}
    expected = None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("part", "row", "doc_id")]
        for part, row, doc_id, value in zip(*columns, b.column("ids")):
            if held and (part, row) != expected:
                yield flush()
                ids, docs, held = [], [], 0
            expected = (part, row + 1)
            of_doc, at = np.frombuffer(value.as_buffer(), dtype), 0
            while at < len(of_doc):
                if not held:
                    start = (part, row, at)
                piece = of_doc[at:at + BLOCK - held]
                ids.append(piece)
                docs.append((doc_id, len(piece), len(piece) == len(of_doc)))
                held += len(piece)
                at += len(piece)
                if held == BLOCK:
                    yield flush()
                    ids, docs, held = [], [], 0
    if held:
        yield flush()


BLOCK_ARROW = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("offset", pa.int64()), ("n_ids", pa.int64()),
                         ("payload", pa.binary()), ("checkpoints", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
                         ("lengths", pa.list_(pa.int32())), ("whole", pa.list_(pa.bool_()))])


def write_token_file(docs: DataFrame, folder: str, path: str = TOKENIZER, end_id: int = END_ID) -> None:
    """All documents as token ids in ``folder``."""
    spark = docs.sparkSession
    bpe = encoder(path, True)
    size, dtype = max(bpe.size, end_id + 1), bpe.dtype
    with shuffle_files_removed(spark):
        tokens = stored(token_ids(docs, path, end_id), "token-ids", "zstd")
        lengths = code_lengths(id_counts(tokens, size, dtype))
        book = spark.sparkContext.broadcast(Codebook(lengths))
        spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").write.parquet(f"{folder}/codebook")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in block_rows(batches, book.value, dtype):
                yield pa.RecordBatch.from_pylist([block], schema=BLOCK_ARROW)
        tokens.mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks", compression="none")
        blocks = spark.read.parquet(f"{folder}/blocks").select("part", "row", "offset", "n_ids")
        before = Window.rowsBetween(Window.unboundedPreceding, -1)
        # one row per range in a single window: bounded by the number of ranges
        parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
            "ids_before", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0))).drop("n")
        starts = blocks.join(parts, "part").withColumn("start", F.col("ids_before") + F.coalesce(
            F.sum("n_ids").over(before.partitionBy("part").orderBy("row", "offset")), F.lit(0)))
        starts.select("part", "row", "offset", "start").write.parquet(f"{folder}/starts")


# ------------------------------------------------------------------ reading
def codebook(spark: SparkSession, folder: str) -> Codebook:
    rows = spark.read.parquet(f"{folder}/codebook").collect()       # one row per id of the vocabulary
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    lengths[[r["id"] for r in rows]] = [r["bits"] for r in rows]
    return Codebook(lengths)


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and block: part, row, offset (of the piece in its document), doc_id, ids."""
    book = spark.sparkContext.broadcast(codebook(spark, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = book.value.decode(r["payload"], r["checkpoints"], r["n_ids"]).view("<i4")
                ends = np.concatenate([[0], np.cumsum(r["lengths"])])
                n = len(r["lengths"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.arange(n) + r["row"]),
                     pa.array(np.where(np.arange(n) == 0, r["offset"], 0)), pa.array(r["doc_ids"], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                    names=["part", "row", "offset", "doc_id", "ids"])
    return spark.read.parquet(f"{folder}/blocks").mapInArrow(run, "part int, row long, offset long, doc_id long, ids array<int>")


POLYNOMIAL = 0xEDB88320       # of CRC-32, bits reversed


def times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32 (reversed bits)."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings in a row, from theirs and the bytes of the second."""
    shift, power, n = 1 << 31, 1 << 23, length        # x^0 and x^8
    while n:
        if n & 1:
            shift = times(shift, power)
        power = times(power, power)
        n >>= 1
    return times(shift, first) ^ second


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    book = spark.sparkContext.broadcast(codebook(spark, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = memoryview(book.value.decode(r["payload"], r["checkpoints"], r["n_ids"]).tobytes())
                ends = np.concatenate([[0], np.cumsum(r["lengths"])])
                n = len(r["lengths"])
                crc = [zlib.crc32(ids[4 * a:4 * e]) for a, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["row"])), pa.array(np.full(n, r["offset"])),
                     pa.array(np.arange(n) + r["row"]), pa.array(r["doc_ids"], pa.int64()), pa.array(ends[:-1]),
                     pa.array(np.array(r["lengths"], np.int64)), pa.array(crc, pa.int64()), pa.array(r["whole"])],
                    names=["part", "row", "offset", "doc_row", "doc_id", "at", "n_tokens", "crc", "whole"])
    pieces = spark.read.parquet(f"{folder}/blocks").mapInArrow(
        run, "part int, row long, offset long, doc_row long, doc_id long, at long, n_tokens long, crc long, whole boolean")
    pieces = pieces.join(spark.read.parquet(f"{folder}/starts"), ["part", "row", "offset"]).withColumn("start", F.col("start") + F.col("at"))
    pieces = stored(pieces, "token-pieces")
    whole = pieces.where("whole").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    # a text is one value, so its pieces are some ten thousand at most
    cut = (pieces.where("not whole").groupBy("part", "doc_row")
           .agg(F.first("doc_id", True).alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
                F.array_sort(F.collect_list(F.struct("start", "n_tokens", "crc"))).alias("pieces")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for of_doc in b.column("pieces").to_pylist():
                crc = 0
                for p in of_doc:
                    crc = crc_joined(crc, p["crc"], 4 * p["n_tokens"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return whole.unionByName(cut.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_file_digests(docs: DataFrame) -> DataFrame:
    """Write all documents to a new folder below the shared one, and read it back."""
    folder = new_table_path(docs.sparkSession, "token-file")
    write_token_file(docs, folder)
    return document_digests(docs.sparkSession, folder)
