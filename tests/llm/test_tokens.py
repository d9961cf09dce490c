import pytest

from pagetext.llm import tokens

from .helpers import DOCS, frame, odd_documents

ODD = ["", "  two  blanks ", "\n\nx\n", "▁▁ a", "日本語 ñandú\x00 😀😀 z", "a" * 3000, "line\r\ntab\t end ", " ", "<0x41> <unk>"]


@pytest.fixture(scope="module")
def public_model():
    from tokenizers import Tokenizer, models, normalizers
    v = tokens.vocabulary()
    low = min(s for _, s in v)
    t = Tokenizer(models.Unigram([("<unk>", low)] + [(f"<0x{i:02X}>", low) for i in range(256)] + list(v), 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_counts_equal_the_public_library(spark, public_model):
    rows = odd_documents() + [(900 + i, t, "", "", 0) for i, t in enumerate(ODD) if "<0x" not in t]
    got = tokens.token_counts(frame(spark, rows, clashing=("n_tokens",))).collect()
    assert len(got) == len(rows)
    by_text = {r[1]: len(public_model.encode(r[1], add_special_tokens=False).ids) if r[1] else 0 for r in rows}
    ids = {(r[0], len((r[1] or "").encode())): by_text[r[1]] for r in rows}
    for r in got:
        assert r["n_tokens"] == ids[r["doc_id"], r["n_bytes"]]


def test_ties_keep_the_earlier_start():
    c = tokens.Counter((("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bc", -2.0), ("c", -1.0), ("abc", -3.0)))
    assert c.viterbi("abc") == (1, -3.0) and c.viterbi("ab") == (1, -2.0) and c.viterbi("bca") == (2, -3.0)


def test_unknown_characters_count_their_bytes():
    c = tokens.Counter((("a", -1.0),))
    assert c.viterbi("aéa") == (4, -13.0) and c.viterbi("日")[0] == 3


def test_a_piece_across_a_cut_is_refused():
    with pytest.raises(ValueError):
        tokens.Counter((("a▁b", -1.0),))


def test_empty_table(spark):
    assert tokens.token_counts(frame(spark, [], DOCS)).count() == 0


def test_long_parts_are_not_kept():
    from pagetext.llm import tokens
    c = tokens.Counter(tokens.vocabulary())
    assert c.count("語" * 5000) > 0 and c.count("plain words") > 0
    assert c and max(map(len, c)) <= tokens.MEMORY_PART
