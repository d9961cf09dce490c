import json
import os
import struct
import tempfile
import zlib


from pagetext.operators import evaluate
from pagetext.sources import files, readers


def png_bytes(w, h, rgb):
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scan_and_decode_images(spark):
    d = tempfile.mkdtemp(prefix="pagetext-img-")
    with open(os.path.join(d, "a.png"), "wb") as f:
        f.write(png_bytes(4, 2, (10, 20, 30)))
    with open(os.path.join(d, "b.PNG"), "wb") as f:
        f.write(b"not an image")
    with open(os.path.join(d, "c.txt"), "w") as f:
        f.write("x")
    listing = files.list_files(spark, d)
    assert [os.path.basename(r.path) for r in files.scan_images(listing).collect()] == ["a.png", "b.PNG"]
    imgs = {os.path.basename(r.path): r for r in files.read_images(spark, d).collect()}
    assert (imgs["a.png"].image.height, imgs["a.png"].image.width, imgs["a.png"].placeholder) == (2, 4, False)
    assert imgs["b.PNG"].placeholder and imgs["b.PNG"].image.width == 10
    px = files.image_pixels(files.read_images(spark, d).where("not placeholder"))
    # BGR order: c=0 is blue (30), c=2 is red (10)
    vals = {(r.c, r.v) for r in px.select("c", "v").distinct().collect()}
    assert vals == {(0, 30), (1, 20), (2, 10)}


def test_read_lexicon(spark):
    d = tempfile.mkdtemp(prefix="pagetext-lex-")
    with open(os.path.join(d, "en.txt"), "w") as f:
        f.write("Hello\nhello\nworld\n\n")
    with open(os.path.join(d, "id.txt"), "w") as f:
        f.write("halo\n")
    got = {(r.lang, r.word, r.freq) for r in readers.read_lexicon(spark, d, ("en", "id", "ms")).collect()}
    assert got == {("en", "hello", 2), ("en", "world", 1), ("id", "halo", 1)}


def test_read_eval_sets_and_pairing(spark):
    d = tempfile.mkdtemp(prefix="pagetext-eval-")
    preds = [{"text": "helo wrld", "language": "en"}, {"text": "abc"}]
    truth = ["hello world", "abd"]
    with open(os.path.join(d, "pred.json"), "w") as f:
        json.dump(preds, f)
    with open(os.path.join(d, "truth.jsonl"), "w") as f:
        f.write("\n".join(json.dumps({"text": t}) for t in truth))
    p, t = readers.read_eval_sets(spark, os.path.join(d, "pred.json"), os.path.join(d, "truth.jsonl"))
    pairs = evaluate.pair_eval(p, t)
    m = evaluate.mean_cer_wer(evaluate.score_pairs(pairs)).first()
    assert m.n == 2
    assert abs(m.mean_cer - (2 / 11 + 1 / 3) / 2) < 1e-12
    assert abs(m.mean_wer - (2 / 2 + 1 / 1) / 2) < 1e-12


def test_write_results_round_trip(spark):
    from pagetext.session import new_table_path
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    path = new_table_path(spark, "test-out")
    readers.write_results(df, path)
    back = spark.read.schema("doc_id long, text string").json(path)
    assert sorted(back.collect()) == sorted(df.collect())


def test_size_guard(spark):
    from pagetext.params import Params
    df = spark.createDataFrame([("a", 20 * 1024 * 1024), ("b", 20 * 1024 * 1024 + 1)], "path string, length long")
    got = {r.path: (r.accepted, r.reason) for r in files.size_guard(df, Params()).collect()}
    assert got == {"a": (True, None), "b": (False, "File too large")}


def test_eval_sets_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """The query's predictions and truths are folders of part files, paired by line number."""
    from pagetext.plans import catalog
    n = 200
    rows = [((7 * i) % n, f"ref {i}\nnext", "" if i % 50 == 0 else f"hyp {i}") for i in range(n)]
    monkeypatch.setattr(catalog.fx, "fx_wer", lambda spark, sf: spark.createDataFrame(rows, "doc_id long, ref string, hyp string"))
    monkeypatch.setattr(catalog, "new_table_path", lambda spark, name: str(tmp_path / name))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = [tuple(r) for r in catalog.q_read_eval_sets(spark, "").orderBy("row_id").collect()]
    finally:
        spark.conf.set(key, before)
    assert got == [(i, r, h) for i, r, h in sorted(rows)]
    assert all(len(list((tmp_path / name).glob("part-*"))) > 1 for name in ("predictions", "truths"))
