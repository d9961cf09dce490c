"""Cross-tokenizer alignment with an identity-map fast path.

Each text is encoded by two tokenizers whose tokens are runs of its bytes. Byte
places where tokens of both end cut them into groups. Two tokens are linked if
their byte ranges overlap; every stretch between neighbouring ends (of either)
is one link. The weight of an id pair is the number of documents that hold it
linked; a document reports how many of its links have the highest weight that
their A id has anywhere, and the sum of their weights.

Identity map: an array from each A id to the B id of the same bytes, made once
from the two vocabularies. Links of that kind (all exact one-to-one groups, and
the rare equal pair inside a longer group) are counted in one vector as long as
A's vocabulary per task. Only the other links enter the pair shuffle, merged to
distinct pairs per block of documents before it.

Three passes: tokenise and align, storing each document's distinct links with
their number; count; bring each block's pair counts back to it. Documents are
tokenised once. Bounds: blocks of ``BLOCK_BYTES`` of text (or one text); two
vectors of the vocabulary's length on the driver and in tasks; no pair table is
ever whole anywhere. A pair that every document holds has one row per block.

Texts null, empty, or that B does not keep byte for byte have no tokens. Equal
rows are documents of their own. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encoder
from .packed import chunks
from .tables import stored

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
BLOCK_BYTES = 8 << 20
LONG = 1 << 20         # characters from which a text is encoded in parts that cannot touch each other
MARK = "▁"
ALIGNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


class Pieces:
    """Ids of a sentencepiece model file and the bytes they stand for."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.is_byte = [m.is_byte(i) for i in range(len(names))]
        none = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(len(names))]
        self.bytes_of = [b"" if no else bytes([int(p[3:-1], 16)]) if byte else p.replace(MARK, " ").encode()
                         for p, byte, no in zip(names, self.is_byte, none)]
        # no piece goes on over a blank after another character, so a text may be cut there
        self.cuts = not any(MARK in p.lstrip(MARK) for p, byte, no in zip(names, self.is_byte, none) if not (byte or no))

    def encode(self, text: str) -> list[int]:
        """Ids of blank + text, which the model adds itself."""
        if len(text) <= LONG or not self.cuts:
            return self.model.encode(text, num_threads=1)
        ids, at = [], 0
        while at < len(text):
            end = at + LONG
            while True:      # to the next blank that follows another character
                end = text.find(" ", end)
                if end < 0 or text[end - 1] != " ":
                    break
                end += 1
            if end < 0 or end + 1 == len(text):
                end = len(text)
            ids += self.model.encode(text[at:end], num_threads=1)
            at = end + 1     # the model puts the blank back
        return ids


class Aligner:
    """Both vocabularies, the identity map, and the alignment of a batch of texts."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path, False), Pieces(b_path)
        self.a_length = np.array([len(x) for x in self.a.bytes_of], np.int64)
        self.b_length = np.array([len(x) for x in self.b.bytes_of], np.int64)
        of_bytes: dict[bytes, int] = {}
        for i, x in enumerate(self.b.bytes_of):
            if x and (x not in of_bytes or self.b.is_byte[of_bytes[x]] and not self.b.is_byte[i]):
                of_bytes[x] = i
        #: B id with the same bytes as each A id, -1 where there is none
        self.identity = np.array([of_bytes.get(x, -1) if x else -1 for x in self.a.bytes_of], np.int64)
        self.a_bits, self.b_bits = (int(n).bit_length() for n in (len(self.a_length), len(self.b_length)))
        width = len(str(max(len(self.a_length), len(self.b_length))))
        numbers = np.arange(max(len(self.a_length), len(self.b_length)))
        tens = 10 ** np.arange(width - 1, -1, -1)
        self.digits = (numbers[:, None] // tens % 10 + ord("0")).astype(np.uint8)
        self.shown = (numbers[:, None] >= tens) | (tens == 1)

    def tokens(self, text: str | None) -> tuple[np.ndarray, list[int]]:
        """Ids by A and B; none if B does not keep the text."""
        if text:
            b = self.b.encode(text)
            if b"".join(map(self.b.bytes_of.__getitem__, b)) == b" " + text.encode():
                return np.frombuffer(self.a.encode(" " + text), self.a.dtype), b
        return np.zeros(0, self.a.dtype), []

    def written(self, a, b, a_last, b_last, a_group, b_group, ends) -> list[str]:
        """Digest of each document's groups; ``ends``: (A, B) tokens up to each document's end."""
        n_groups = int(a_last.sum())
        a_to = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=n_groups))])
        b_to = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=n_groups))])
        n, width = len(a) + len(b), self.digits.shape[1]
        a_at, b_at = np.arange(len(a)) + b_to[a_group], np.arange(len(b)) + a_to[b_group + 1]
        cells, shown = np.empty((n, width + 1), np.uint8), np.ones((n, width + 1), bool)
        cells[a_at, :width], cells[b_at, :width] = self.digits[a], self.digits[b]
        shown[a_at, :width], shown[b_at, :width] = self.shown[a], self.shown[b]
        cells[a_at, width] = np.where(a_last, ord("|"), ord(","))
        cells[b_at, width] = np.where(b_last, ord(";"), ord(","))
        upto = np.concatenate([[0], np.cumsum(shown.sum(1))])
        text = memoryview(cells[shown].tobytes())
        stops = upto[ends.sum(1)].tolist()
        return [hashlib.sha256(text[s:e - 1]).hexdigest() if e > s else "" for s, e in zip([0, *stops], stops)]

    def align(self, texts: list[str | None]) -> dict[str, object]:
        """Columns of ``ALIGNED`` besides block and doc_id."""
        tokens = [self.tokens(t) for t in texts]
        docs = np.arange(len(texts))
        n_a, n_b = (np.array([len(t[i]) for t in tokens], np.int64) for i in (0, 1))
        a = np.concatenate([t[0] for t in tokens]).astype(np.int64)
        b = np.array([i for t in tokens for i in t[1]], np.int64)
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        size = int(a_end[-1]) if len(a_end) else 0
        ends_a, ends_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        ends_a[a_end], ends_b[b_end] = True, True
        a_last, b_last = ends_b[a_end], ends_a[b_end]
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        # one link for each stretch between neighbouring ends; it lies in one token of each kind
        ends = ends_a | ends_b
        place = np.flatnonzero(ends)
        of_a, of_b = np.cumsum(ends_a)[place] - ends_a[place], np.cumsum(ends_b)[place] - ends_b[place]
        link_a, link_b = a[of_a], b[of_b]
        link_doc = np.repeat(docs, n_a)[of_a]
        doc_of_a = np.repeat(docs, n_a)
        same = self.identity[link_a] == link_b
        key, count = np.unique(link_doc[same] << self.a_bits | link_a[same], return_counts=True)
        other = ~same
        pair_key, pair_count = np.unique((link_doc[other] << self.a_bits | link_a[other]) << self.b_bits | link_b[other],
                                         return_counts=True)
        pair_a, pair_b = pair_key >> self.b_bits & (1 << self.a_bits) - 1, pair_key & (1 << self.b_bits) - 1

        def lists(doc: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32()), pa.array(values, kind))
        key_doc, pair_doc = key >> self.a_bits, pair_key >> self.a_bits + self.b_bits
        upto = np.stack([np.cumsum(n_a), np.cumsum(n_b)], 1)
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_of_a, weights=a_last, minlength=len(texts)).astype(np.int64),
                "n_links": np.bincount(link_doc, minlength=len(texts)),
                "groups_sha256": self.written(a, b, a_last, b_last, a_group, b_group, upto),
                "same": lists(key_doc, key & (1 << self.a_bits) - 1, pa.int32()), "same_n": lists(key_doc, count, pa.int32()),
                "pairs": lists(pair_doc, pair_a << 32 | pair_b, pa.int64()), "pairs_n": lists(pair_doc, pair_count, pa.int32())}


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of files."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """One row per document: its block, its numbers of tokens, groups and links, and its distinct links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, block, held = TaskContext.get().partitionId() << 32, 0, 0
        for b in chunks(batches, "text"):
            texts = b.column("text").to_pylist()
            columns = aligner(a_path, b_path).align(texts)
            yield pa.RecordBatch.from_pydict({"block": np.full(len(texts), first + block), "doc_id": b.column("doc_id"), **columns})
            held += b.column("text").nbytes
            if held >= BLOCK_BYTES:
                block, held = block + 1, 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def partial_counts(docs: DataFrame, size: int) -> DataFrame:
    """(block, pair, n): documents of a block (or a part of it) that hold a pair; block -1:
    documents of a task that hold the identity link of the A id ``pair``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, at, pairs = np.zeros(size, np.int64), None, []

        def rows(block: int, pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": np.full(len(pair), block), "pair": pair, "n": n})
        for b in batches:
            same += np.bincount(flat_list(b.column("same"))[0], minlength=size)
            blocks = b.column("block").to_numpy()
            values, row = flat_list(b.column("pairs"))
            for block in dict.fromkeys(blocks.tolist()):
                if at is not None and block != at:
                    yield rows(at, *np.unique(np.concatenate(pairs), return_counts=True))
                    pairs = []
                at = block
                pairs.append(values[blocks[row] == block])
        if at is not None:
            yield rows(at, *np.unique(np.concatenate(pairs), return_counts=True))
        seen = np.flatnonzero(same)
        yield rows(-1, seen, same[seen])
    return docs.select("block", "same", "pairs").mapInArrow(run, "block long, pair long, n long")


def align_tokenizers(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    size = encoder(a_path, False).size
    rows = stored(aligned(docs, a_path, b_path), "align-docs", "zstd")
    partial = stored(partial_counts(rows, size), "align-partial")
    held = partial.where("block >= 0")
    counts = stored(held.groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")

    same, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    # at most one row per id of A's vocabulary, twice
    for r in partial.where("block < 0").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        same[r["pair"]] = best[r["pair"]] = r["n"]
    for r in counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = max(best[r["a"]], r["n"])
    vectors = spark.sparkContext.broadcast((same, best))

    of_block = held.select("block", "pair").distinct().join(counts, "pair")

    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        same, best = vectors.value
        n_docs = group.num_rows
        pair, n = known.column("pair").to_numpy(), known.column("n").to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        total, top = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        a, row = flat_list(group.column("same"))
        times = flat_list(group.column("same_n"))[0].astype(np.int64)
        np.add.at(total, row, times * same[a])
        np.add.at(top, row, times * (same[a] == best[a]))
        linked, row = flat_list(group.column("pairs"))
        times = flat_list(group.column("pairs_n"))[0].astype(np.int64)
        if len(linked):
            at = np.minimum(np.searchsorted(pair, linked), len(pair) - 1)
            if not len(pair) or (pair[at] != linked).any():
                raise KeyError("a pair of a block is missing from its counts")
            np.add.at(total, row, times * n[at])
            np.add.at(top, row, times * (n[at] == best[linked >> 32]))
        return pa.table({**{c: group.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                         "n_best": top, "count_sum": total, "groups_sha256": group.column("groups_sha256")})
    return rows.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(run, RESULT)
