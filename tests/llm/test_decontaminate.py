import re
from collections import defaultdict

from pagetext.llm import decontaminate as dc

from .helpers import DOCS, frame, odd_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def by_hand(docs, items, window=10):
    win = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - window, 0) + 1) if w else ():
            win[tuple(w[s:s + window])].add(i)
    out = []
    for r in docs:
        w, hit, found = words(r[1]), set(), set()
        for size in {len(k) for k in win}:
            for s in range(len(w) - size + 1):
                if items_here := win.get(tuple(w[s:s + size])):
                    found |= items_here
                    hit.update(range(s, s + size))
        out.append((r[0], len(w), len(hit), tuple(sorted(map(str, found)))))
    return sorted(out, key=repr)


def planted():
    docs = odd_documents()
    long = docs[70][1].split(" ")
    items = [(1, " ".join(docs[20][1].split(" ")[:25])), (2, " ".join(long[100:140]).upper()), (3, "one"), (10, " ".join(long[105:118])),
             (4, None), (5, ""), (6, "?!"), (7, "never seen words here"), (8, "ñandú étÉ 日本語"), (2, " ".join(long[100:140])), (None, "same row twice")]
    docs.append((400, "ΣΑΣ ΣΑΣ. İ x K " + " ".join(long[95:150]).replace(" ", "\n- "), "en", "s", 0))
    docs.append((401, "Ñandú éTÉ 日本語 and ñandú étÉ 日本語", "en", "s", 0))
    return docs, items


def got(spark, docs, items, **columns):
    d = frame(spark, docs, clashing=("words", "term", "phrase"))
    b = frame(spark, items, "item_id long, text string", clashing=("position",))
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in dc.contamination(d, b).collect()], key=repr)


def test_matches_brute_force(spark):
    docs, items = planted()
    items = [x for x in items if x[0] is not None]
    want = by_hand(docs, items)
    assert got(spark, docs, items) == want
    assert sum(1 for r in want if r[2]) > 10


def test_empty_tables(spark):
    docs, items = planted()
    assert got(spark, [], items) == []
    assert all(r[2] == 0 for r in got(spark, docs, []))
    assert dc.drop_contaminated(frame(spark, docs), frame(spark, [], "item_id long, text string")).count() == len(docs)


def test_drop_contaminated_keeps_the_rest(spark):
    docs, items = planted()
    hit = {r[0] for r in by_hand(docs, items) if r[2]}
    df = frame(spark, docs, clashing=("text_hash", "whole_row", "bad_doc_id"))
    left = dc.drop_contaminated(df, frame(spark, items, "item_id long, text string"))
    assert left.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r[0]) for r in docs if r[0] not in hit)


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha x beta y gamma", "", "", 0), (2, "gamma beta alpha", "", "", 0), (3, "alpha " + "z " * 40 + "beta gamma", "", "", 0)], DOCS)
    items = frame(spark, [(1, "alpha beta gamma")], "item_id long, text string")
    terms = dc.phrase_terms(dc.phrases(items))
    rare = dc.anchors(terms, dc.term_frequencies(docs, terms.select("term").distinct()), per_phrase=3)
    index = dc.build_index(docs, rare)
    assert {r["doc_id"] for r in dc.proximity_matches(index, rare, slop=4).collect()} == {1, 2}
    assert dc.phrase_matches(index, rare).count() == 0
