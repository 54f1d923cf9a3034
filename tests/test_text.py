"""Golden values and an independent model of the text functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from imprintmatch.functions import text as T


def run(spark, expr, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("o"))
    return [r.o for r in sorted(rows.collect(), key=lambda r: r.i)]


GOLDEN = {
    "d-w1 pac": "D-W PAC", "DW15 abc": "DW5 ABC", "space 10": "PAC", "XPAC": "PAC", "IMPACT PACKX": "IMPACT PACKX", "P 5": "",
    "D-W DW X9": "D-W", "--": "--", "A-B AB": "A-B", "r.x 7-5": "7-5", "P-AC": "P-AC", "straße-9": "STRASSE-9",
}


def test_post_fix_golden(spark):
    assert run(spark, T.post_fix_imprint, list(GOLDEN)) == [
        GOLDEN[k] if k != "space 10" else "PAC" for k in GOLDEN
    ]


def test_variants_golden(spark):
    got = run(spark, T.ocr_variants, ["AB", "S0-1", "D-W PAC", "", None])
    assert got[0] == ["A8", "AB"]
    assert got[1] == ["501", "S01", "S0I", "SO1", "50-1", "S0-1", "S0-I", "SO-1"]
    assert got[2] == ["D-WPAC", "DW PAC", "D-W PAC"]
    assert got[3] == got[4] == []


def test_rank_variants_golden(spark):
    got = [set(x) for x in run(spark, T.rank_variants, ["D-W", "DW", "SC", "10", "VVV", "A"])]
    assert got == [{"D-VV", "D-W", "DVV", "DW"}, {"DVV", "DW"}, {"CC", "SC", "SS"}, {"10", "1O", "I0", "IO"}, {"VVV", "WV"}, set()]


def test_more_variants_golden(spark):
    """One kind of slip at a time, at all its places; the shortest spellings first."""
    got = run(spark, T.ocr_variants, ["1i", " s5 z2 ", "b-8", "0o0", "-", "AAAA"])
    assert got[0] == ["11", "1I", "II"]
    assert got[1] == ["S5Z2", "55 Z2", "S5 22", "S5 Z2", "S5 ZZ", "SS Z2"]
    assert got[2] == ["88", "B8", "BB", "8-8", "B-8", "B-B"]
    assert got[3] == ["000", "0O0", "OOO"]
    assert got[4] == ["", "-"] and got[5] == ["AAAA"]
    assert len(run(spark, T.ocr_variants, ["0O 1I-5S 2Z 8B"])[0]) == 12


def test_more_rank_variants_golden(spark):
    """Two replacements in a row; single characters are no spelling."""
    got = [set(x) for x in run(spark, T.rank_variants, ["W", "S0", "1-O", "dw15", "CCC"])]
    assert got == [{"VV"}, {"S0", "C0", "SO", "CO"}, {"1-O", "1O", "I-O", "1-0", "IO", "10", "I-0", "I0"}, {"DW5", "DVV5"}, {"CCC", "SSS"}]


def random_texts(n=300):
    rnd = random.Random(5)
    return ["".join(rnd.choice("ABDWPACVSOI01258Z-. xß가") for _ in range(rnd.randint(0, 9))) for _ in range(n)]


def test_properties_of_variants(spark):
    texts = random_texts()
    for text, found in zip(texts, run(spark, T.ocr_variants, texts)):
        own = text.upper().strip()
        assert len(found) <= 12 and found == sorted(set(found), key=lambda x: (len(x), x))
        assert (not own) == (not found) and (len(found) == 12 or not own or own in found)
        for x in found:  # a variant differs in hyphens, spaces, or one kind of character
            a, b = own.replace("-", "").replace(" ", ""), x.replace("-", "").replace(" ", "")
            assert len(a) == len(b) and len({(p, q) for p, q in zip(a, b) if p != q}) <= 1
    tokens = [t for x in texts for t in re.findall(r"[A-Z0-9\-]{2,}", x)]
    for token, found in zip(tokens, run(spark, T.rank_variants, tokens)):
        assert found == sorted(set(found)) and all(len(x) >= 2 for x in found)
        assert all(x.replace("-", "") in found or len(x.replace("-", "")) < 2 for x in found)
        if not re.search("DW1|D-W1", token):
            assert token in found


def test_normalize_and_tokens(spark):
    assert run(spark, T.normalize_ocr, [" a?b  c\n7 ", None, "é"]) == ["A B C 7", "", ""]
    assert run(spark, lambda c: T.normalize_ocr(c, basic=True), ["a?b c"]) == ["AB C"]
    assert run(spark, T.tokens, ["a b2 c.dd --", None]) == [["B2", "DD", "--"], []]


@pytest.mark.parametrize("t,w,basic", [("D-W", 70, 70), ("DVV", 70, 35), ("PAC", 60, 60), ("AB", 35, 35)])
def test_weight(spark, t, w, basic):
    assert run(spark, T.token_weight, [t]) == [w]
    assert run(spark, lambda c: T.token_weight(c, basic=True), [t]) == [basic]


def test_aliases(spark):
    assert run(spark, T.shape_aliases, ["타원형", " 원형", None, ""]) == [["타원형", "장방형"], [" 원형"], [], []]
    assert run(spark, T.color_aliases_prefilter, ["연두+주황", "하양+", None]) == [["연두", "녹색", "초록", "초록색", "주황"], ["하양", "흰색", "백색", ""], []]
    assert run(spark, T.color_aliases_rank, [" 주황 ", "+"]) == [["주황", "주황색", "연주황", "적주황"], []]


def test_notes_and_levels(spark):
    assert run(spark, lambda c: T.match_level(c.cast("int")), ["120", "119", "70", "69"]) == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert run(spark, lambda c: T.pill_note(c, F.lit("mid")), ["", "A"]) == ["OCR 실패; prefilter=mid", "prefilter=mid"]
