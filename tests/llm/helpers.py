"""Small tables with the odd cases every operator must stand."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ba", "de", "ki", "lo", "mu") for b in ("ra", "sen", "tol") for c in ("a", "ix", "or", "um")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents(seed=1, n=60):
    """Prose with exact and near copies, a hot source, nulls, empty, very long and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append([i, prose(rng, rng.randint(1, 80)), "en", "hot" if i % 3 else f"s{i % 7}"])
    for i in range(10):                                   # exact copies
        rows.append([100 + i, rows[5][1], "en", "hot"])
    long = prose(rng, 400).split(" ")
    rows.append([200, " ".join(long), "en", "hot"])
    for i in range(12):                                   # near copies, each with its own edit
        w = list(long)
        w[rng.randrange(400)] = f"edit{i}"
        rows.append([201 + i, " ".join(w), "en", None])
    rows += [[300, None, None, None], [301, "", "en", "s1"], [302, " \t\n ", "en", "s1"], [303, "One", "en", "s2"], [304, "one", "en", "s2"],
             [305, "Ñandú ÉTÉ 日本語 😀 mit Wörtern", "de", "s2"], [306, prose(rng, 30_000), "en", "big"], [None, "no id here", "en", "s1"],
             [None, "no id here", "en", "s1"], [307, "same row twice", "en", "s1"], [307, "same row twice", "en", "s1"]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def frame(spark, rows, schema=DOCS, clashing=()):
    """A DataFrame of the rows; ``clashing``: further columns with those names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema)
    for c in clashing:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def on_disk(spark, tmp_path, df, name):
    """Written and read again: some operators want file-backed tables."""
    path = str(tmp_path / f"{name}.parquet")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)
