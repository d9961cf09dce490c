"""J6 spelling candidates and T7 spelling correction.

Candidates within two edits (insert, delete, replace, adjacent swap) are found
as an equi-join of distinct tokens with lexicon words on keys that any such
pair shares, and verified exactly:

* words up to ``SHORT`` characters: their variants with up to two characters
  deleted (at most 106), against those of the token;
* longer words: five segments. Two edits touch at most four of them (an
  adjacent swap at most two), so one is found in the token unchanged, at most
  two places off: keys are (word length, segment number, segment).

Keys are 64-bit hashes, computed for all tokens of a length at once. Of a token's
keys only those go on whose place is marked in a bitmap of the words' keys, which
has ``PLACES`` bits whatever the lexicon holds. Keys are linear in the length of a
token; no length is cut. Only distinct tokens that need correction are joined,
never token occurrences; a text meets the corrections of its own distinct tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edit_distance import py_split
from .flatten import stored

SHORT = 14
SEGMENTS = 5
# Tokens that are left alone.
NUMBER_RE = r"^[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?$"
PUNCTUATION_RE = r"^[!-/:-@\[-`{-~]$"


# Hash of a string: the sum of its code points' hashes times the powers of an odd number, so that
# parts of it are differences of prefix sums.
U64 = np.uint64
POWER = 0x9E3779B97F4A7C15
INVERSE = pow(POWER, -1, 1 << 64)
PLACES = 1 << 26          # bits of the bitmap of keys: 8 MB
ROWS = 2048               # strings hashed at once


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    """(strings, length + 1) of a table of code points."""
    n = codes.shape[1]
    powers = np.cumprod(np.full(n, POWER, U64)) * U64(INVERSE)
    out = np.zeros((len(codes), n + 1), U64)
    np.cumsum(_mixed(codes.astype(U64) + U64(1)) * powers, axis=1, out=out[:, 1:])
    return out


def _deletion_keys(sums: np.ndarray) -> np.ndarray:
    """Keys of the strings with up to two characters left out."""
    n = sums.shape[1] - 1
    one, two = U64(INVERSE), U64(INVERSE * INVERSE % (1 << 64))
    end = sums[:, -1:]
    less_one = sums[:, :-1] + (end - sums[:, 1:]) * one
    i, j = np.triu_indices(n, 1)
    less_two = sums[:, i] + (sums[:, j] - sums[:, i + 1]) * one + (end - sums[:, j + 1]) * two
    return _mixed(np.concatenate([end, less_one, less_two], axis=1))


def _segments(length: int) -> list[tuple[int, int, int]]:
    """(number, start, end) of the segments of a word."""
    return [(i, i * length // SEGMENTS, (i + 1) * length // SEGMENTS) for i in range(SEGMENTS)]


def _segment_key(sums: np.ndarray, length: int, i: int, start: int, end: int) -> np.ndarray:
    part = (sums[:, end] - sums[:, start]) * U64(pow(INVERSE, start, 1 << 64))
    return _mixed(part ^ U64((length * SEGMENTS + i + 1) * POWER % (1 << 64)))


def _word_keys(sums: np.ndarray) -> np.ndarray:
    n = sums.shape[1] - 1
    if n <= SHORT:
        return _deletion_keys(sums)
    return np.stack([_segment_key(sums, n, *s) for s in _segments(n)], axis=1)


def _token_keys(sums: np.ndarray) -> np.ndarray:
    n = sums.shape[1] - 1
    keys = [_deletion_keys(sums)] if n <= SHORT + 2 else []
    for length in range(max(n - 2, SHORT + 1), n + 3):
        for i, start, end in _segments(length):
            keys += [_segment_key(sums, length, i, start + off, end + off)[:, None]
                     for off in range(-2, 3) if start + off >= 0 and end + off <= n]
    return np.concatenate(keys, axis=1)


def _keyed(strings: DataFrame, column: str, keys_of, marked: Broadcast | None = None) -> DataFrame:
    """(``column``, k): a row for each key of each string; with ``marked`` only keys marked there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column)
            values = texts.to_pylist()
            size = np.array([len(v) for v in values], np.int64)
            codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), "<u4")
            first = np.cumsum(size) - size
            for n in np.unique(size).tolist():
                of_length = np.flatnonzero(size == n)
                for low in range(0, len(of_length), ROWS):
                    rows = of_length[low:low + ROWS]
                    keys = keys_of(_prefix_sums(codes[first[rows][:, None] + np.arange(n)]))
                    keep = np.ones(keys.shape, bool)
                    if marked is not None:
                        place = keys & U64(PLACES - 1)
                        keep = (marked.value[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1
                    yield pa.RecordBatch.from_arrays([texts.take(pa.array(rows[np.nonzero(keep)[0]])), pa.array(keys[keep].view(np.int64))],
                                                     names=[column, "k"])
    return strings.select(column).where(F.col(column).isNotNull()).mapInArrow(run, f"{column} string, k long")


def _key_bitmap(keys: DataFrame) -> np.ndarray:
    """Which places (the last bits) the keys k take; at most PLACES / 32,768 rows of 4 KB to the driver."""
    place = F.col("k").bitwiseAND(F.lit(PLACES - 1)) + 1          # these functions count from one
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(PLACES // 8, np.uint8)
    for r in rows:
        out[(r["n"] - 1) * 4096:r["n"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _swaps(s: Column) -> Column:
    """All variants with two neighbouring characters exchanged."""
    swap = lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.lit(1)), F.substring(s, i, F.lit(1)),
                              F.substring(s, i + 2, F.length(s)))
    return F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), swap)).otherwise(F.array().cast("array<string>"))


def edit_distance_upto2(a: Column, b: Column) -> Column:
    """0, 1 or 2 when ``b`` is within that many edits of ``a`` (adjacent swaps
    count as one edit), else NULL."""
    near = lambda x, y, k: F.levenshtein(x, y, k) >= 0
    # A swap counts 2 at most in the plain distance. So two edits have a plain distance of
    # 4 only if both are swaps, of 3 only if one is or both are; at 2 one swap may explain it.
    plain = F.levenshtein(a, b, 4)
    sa, sb = _swaps(a), _swaps(b)
    # swaps keep the characters, one more edit changes one: the variants are made only where that holds
    foreign = F.length(F.call_function("translate", a, b, F.lit("")))
    same_length = (F.length(a) == F.length(b)) & (foreign == 0)
    swap_and_edit = F.exists(sa, lambda x: near(x, b, 1)) | F.exists(sb, lambda x: near(a, x, 1))
    return (F.when(plain < 0, F.lit(None).cast("int")).when(plain <= 1, plain)
            .when(plain == 2, F.when(same_length & F.array_contains(sa, b), 1).otherwise(2))
            .when(same_length & F.arrays_overlap(sa, sb), 2)
            .when((plain == 3) & (F.abs(F.length(a) - F.length(b)) <= 1) & (foreign <= 1) & swap_and_edit, 2))


def word_totals(lexicon: DataFrame) -> DataFrame:
    """(word, freq): frequencies summed over the languages that hold the word."""
    return lexicon.groupBy("word").agg(F.sum("freq").alias("freq"))


def spell_candidates(tokens: DataFrame, lexicon: DataFrame, token: str = "tok") -> DataFrame:
    """``(tok, word, freq, dist)`` for every lexicon word within two edits
    of each distinct token."""
    lex = word_totals(lexicon)
    toks = tokens.select(F.col(token).alias("tok")).distinct()
    word_keys = stored(_keyed(lex, "word", _word_keys).distinct(), "word-keys")
    marked = tokens.sparkSession.sparkContext.broadcast(_key_bitmap(word_keys))
    words = word_keys.join(lex, "word")
    pairs = _keyed(toks, "tok", _token_keys, marked).join(words, "k").select("tok", "word", "freq").distinct()
    return pairs.withColumn("dist", edit_distance_upto2(F.col("tok"), F.col("word"))).where(F.col("dist").isNotNull())


def best_correction(candidates: DataFrame) -> DataFrame:
    """Per token the nearest distance class, there the highest frequency, ties -> smallest word."""
    best = F.min(F.struct(F.col("dist"), (-F.col("freq")).alias("f"), F.col("word"))).alias("b")
    return candidates.groupBy("tok").agg(best).select("tok", F.col("b.word").alias("fix"))


def spell_correct(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Split on whitespace, replace each unknown token by its best candidate
    (looked up lower-cased; none -> the token itself), re-join with single blanks.

    Known words (any case), numbers and single punctuation marks stay as they are
    and are not searched for."""
    toks = docs.select(key, F.explode(F.array_distinct(py_split(F.col(text)))).alias("t")).withColumn("tok", F.lower("t"))
    alone = F.col("tok").rlike(NUMBER_RE) | F.col("tok").rlike(PUNCTUATION_RE)
    unknown = toks.where(~alone).select("tok").distinct().join(lexicon.select(F.col("word").alias("tok")).distinct(), "tok", "left_anti")
    fixes = stored(best_correction(spell_candidates(unknown, lexicon)), "spelling-fixes")
    as_bytes = lambda c: F.col(c).cast("binary").alias(c)
    of_key = toks.join(fixes, "tok").groupBy(key).agg(F.collect_list(F.struct(as_bytes("t"), as_bytes("fix"))).alias("c"))
    of_key = of_key.select(key, F.col("c.t").alias("t"), F.col("c.fix").alias("fix"))
    texts = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.col(text).cast("binary")).alias("texts"))
    out = texts.join(of_key, key, "left").select(key, "texts", "t", "fix")
    out = out.mapInArrow(_respelt, f"{key} {dict(docs.dtypes)[key]}, fixed string")
    # documents without any token become ''
    return docs.join(out, key, "left").withColumn(text, F.coalesce("fixed", F.lit(""))).drop("fixed")


def _respelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the tokens ``t`` replaced by ``fix``. Texts that share a key are one, token by token."""
    for b in batches:
        out = []
        for texts, t, fix in zip(*(b.column(c).to_pylist() for c in ("texts", "t", "fix"))):
            known = dict(zip(t or (), fix or ()))
            words = [[known.get(w, w) for w in x.split()] for x in texts]      # bytes: ASCII white space, as py_split
            if len(words) == 1:
                out.append(b" ".join(words[0]))
            else:
                out.append(b" ".join(w for _, w in sorted(p for ws in words for p in enumerate(ws))))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[b.schema.names[0], "fixed"])
