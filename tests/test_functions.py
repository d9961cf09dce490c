import random
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetext.functions.edit_distance import levenshtein
from pagetext.functions import language as lang
from pagetext.functions import normalize as norm
from pagetext.operators import metrics, spelling
from pagetext.params import alias_columns



def dp(a, b):
    prev = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        cur = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ", max_size=30), st.text(alphabet="abcé ", max_size=30))
def test_bit_parallel_levenshtein_matches_dp(a, b):
    assert levenshtein(a, b) == dp(a, b)


def test_token_levenshtein():
    assert levenshtein("a b c".split(), "a c d".split()) == 2


def one(spark, col, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_normalize_date_and_currency(spark):
    out = one(spark, norm.normalize_columns(F.col("s"))["text"], "tanggal 1/2/2023 harga rp 1.234,56")
    assert "2023" in out and "IDR" in out
    assert out == "tanggal 01-02-2023 harga IDR 123456"


def test_number_grouping(spark):
    assert one(spark, norm.norm_numbers(F.col("s")), "1.234,56 dan 1.5 dan 3,14 dan 12345") == \
        "1234.56 dan 15 dan 3.14 dan 12345"


def test_emails_urls_lowercased(spark):
    cols = norm.normalize_columns(F.col("s"))
    df = spark.createDataFrame([("Mail A@B.COM see https://X.com/Q",)], "s string")
    r = df.select(cols["text"].alias("t"), cols["emails"].alias("e"), cols["urls"].alias("u")).first()
    assert r["e"] == ["a@b.com"] and r["u"] == ["https://x.com/q"]
    assert r["t"] == "Mail a@b.com see https://x.com/q"


def test_language_heuristic(spark):
    h = lang.language_heuristic(F.col("s"))
    assert one(spark, h, "Halo apa kabar kamu sedang di mana") == "id"
    assert one(spark, h, "Please pay this invoice within seven days") == "en"
    assert one(spark, h, "   ") == "mix"


def test_resolve_engine_language(spark):
    r = lang.resolve_engine_language(F.col("s"))
    sch = "s array<string>"
    assert one(spark, r, ["auto"], sch) == "en"
    assert one(spark, r, ["id", "en"], sch) == "en"
    assert one(spark, r, ["ru", "en"], sch) == "multilingual"
    assert one(spark, r, ["ru"], sch) == "cyrillic"


def test_alias_columns(spark):
    df = spark.createDataFrame([(0.11,)], "text_det_db_thresh double")
    r = alias_columns(df).first().asDict()
    assert r == {"text_det_thresh": 0.11}


def report(spark, groups):
    rows = [(g, v) for g, vals in groups.items() for v in vals]
    df = spark.createDataFrame(rows, "endpoint string, seconds double").repartition(5)
    return {r["endpoint"]: r for r in metrics.latency_report(df).collect()}


def test_latency_report_is_exact_for_all_kinds_of_groups(spark):
    rng = random.Random(3)
    groups = {"spread": [round(rng.expovariate(3), 4) for _ in range(6001)] + [None], "one": [0.7], "two": [0.5, 0.1],
              "zeros": [0.0] * 900, "ties": [0.25] * 50, "mostly zero": [0.0] * 19000 + [round(0.02 + i * 1e-6, 6) for i in range(1000)],
              "few": [0.1, 0.2, 0.3], None: [1.0, 2.0, 4.0, 8.0]}
    got = report(spark, groups)
    for g, vals in groups.items():
        xs = sorted(0.0 if v is None else v for v in vals)
        assert got[g]["count"] == len(xs) and abs(got[g]["p50"] - statistics.median(xs)) < 1e-12
        want = xs[0] if len(xs) == 1 else statistics.quantiles(xs, n=20)[18]
        if len(xs) > 2:
            assert abs(got[g]["p95"] - want) < 1e-9
        else:
            assert got[g]["p95"] is not None
    assert got["zeros"]["throughput"] is None and got["one"]["throughput"] == 1 / 0.7


def test_spell_candidates_brute_force(spark):
    rng = random.Random(5)
    words = ["hello", "help", "world", "word", "sword", "abc", "a", "be"] + ["".join(rng.choice("abcde") for _ in range(n)) for n in (13, 14, 15, 16, 22, 37)]
    toks = ["helol", "wrod", "abc", "xyz", "helpx", "wordl", "", "ab", "b"]

    def edited(w):
        w = list(w)
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(w) - 1)
            kind = rng.randrange(4)
            if kind == 0:
                w[i], w[i + 1] = w[i + 1], w[i]
            elif kind == 1:
                del w[i]
            elif kind == 2:
                w.insert(i, "z")
            else:
                w[i] = "q"
        return "".join(w)
    toks = sorted(set(toks) | {edited(w) for w in words[8:] for _ in range(12)})
    lex = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, freq long")
    tk = spark.createDataFrame([(t,) for t in toks], "tok string")
    got = {(r.tok, r.word, r.dist) for r in spelling.spell_candidates(tk, lex).collect()}

    def osa_free(a, b):
        # unrestricted Damerau-Levenshtein by brute force (small strings)
        from functools import lru_cache

        @lru_cache(None)
        def d(a, b):
            if not a or not b:
                return len(a) + len(b)
            best = min(d(a[1:], b) + 1, d(a, b[1:]) + 1, d(a[1:], b[1:]) + (a[0] != b[0]))
            if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
                best = min(best, d(a[2:], b[2:]) + 1)
            return best
        return d(a, b)
    want = {(t, w, osa_free(t, w)) for t in toks for w in words if osa_free(t, w) <= 2}
    assert got == want


def test_spell_correct_leaves_numbers_marks_and_known_words(spark):
    lex = spark.createDataFrame([("en", "the", 5), ("en", "date", 3), ("id", "data", 2), ("en", "data", 2), ("en", "a", 9)], "lang string, word string, freq long")
    docs = spark.createDataFrame([(1, "The 12 - 3.5 dats"), (2, ""), (3, None), (4, " Data\n,  1e5 DATE qqqqqq ")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in spelling.spell_correct(docs, lex).collect()}
    assert got == {1: "The 12 - 3.5 data", 2: "", 3: "", 4: "Data , 1e5 DATE qqqqqq"}


def test_blank_text_has_no_vote(spark):
    from pagetext.operators import votes
    cand = spark.createDataFrame([(1, 0, "en", 0.9), (2, 0, "en", 0.9)], "doc_id long, rank int, code string, prob double")
    texts = spark.createDataFrame([(1, " \n"), (2, "x"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["language"] for r in votes.language_votes(cand, texts).collect()} == {1: "mix", 2: "en", 3: "mix"}


def test_normalise_without_matches_is_unchanged(spark):
    for value in ("plain words only", "", None, "A@B.CO and a@b.co twice A@B.CO"):
        out = one(spark, norm.normalize_columns(F.col("s"))["text"], value)
        assert out == (value.lower().replace("a@b.co", "a@b.co") if value and "@" in value else value)


def test_spelling_joins_only_marked_keys(spark):
    """Keys of tokens that no word has are left out before the join."""
    import numpy as np
    from pagetext.operators import spelling
    words = spark.createDataFrame([("invoice", 3), ("uncharacteristically", 1)], "word string, freq long")
    toks = spark.createDataFrame([("invocie",), ("qqqqqqqqqq",), ("uncharacteristicaly",), ("",)], "tok string")
    keys = spelling._keyed(words, "word", spelling._word_keys)
    bits = spelling._key_bitmap(keys)
    assert 0 < int(np.unpackbits(bits).sum()) <= keys.select("k").distinct().count()
    marked = spark.sparkContext.broadcast(bits)
    found = spelling._keyed(toks, "tok", spelling._token_keys, marked).groupBy("tok").count().collect()
    assert {r["tok"] for r in found} == {"invocie", "uncharacteristicaly"}


def test_texts_that_share_a_key_are_corrected_as_one(spark):
    from pagetext.operators import spelling
    lex = spark.createDataFrame([("en", "date", 3)], "lang string, word string, freq long")
    docs = spark.createDataFrame([(1, "dat zz"), (1, "yyy"), (None, "dat")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in spelling.spell_correct(docs, lex).collect())
    assert got == [("1", "date yyy zz"), ("1", "date yyy zz"), ("None", "")]


def test_language_computes_its_scores_once(spark):
    """The text is lowered once, not once for each place that reads a score."""
    from pagetext.functions import language as lang
    df = spark.createDataFrame([("x",)], "s string").select(lang.language_heuristic(F.col("s")).alias("l"))
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") == 1
