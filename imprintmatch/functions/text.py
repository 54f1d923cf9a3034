"""Imprint text: cleaning, tokens and spelling variants as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a token.
TOKEN = r"[A-Z0-9\-]{2,}"
#: A mark read with one letter too many on either side, and how it is meant.
PAC, PAC_ANYWHERE = r"\b[A-Z]?PAC[A-Z]?\b", "[A-Z]?PAC[A-Z]?"
#: Slips of one pair of marks, and what tokens are worth: the two known marks, and all others.
DW_SLIPS = (("D-W1", "D-W"), ("DW1", "DW"))
WEIGHTS = {"DW": 70, "PAC": 60, "other": 35}

#: Characters that readers confuse, tried one swap at a time.
READER_SWAPS = (("0", "O"), ("O", "0"), ("1", "I"), ("I", "1"), ("5", "S"), ("S", "5"), ("2", "Z"), ("Z", "2"), ("8", "B"), ("B", "8"))
#: Replacements tried twice in a row when tokens are compared.
RANK_SWAPS = (("VV", "W"), ("W", "VV"), ("S", "C"), ("C", "S"), ("0", "O"), ("O", "0"), ("1", "I"), ("I", "1"))
MOST_VARIANTS = 12

#: Colour names that count as one, for the pre-filter and for the score.
PREFILTER_COLORS = {"연두": ["연두", "녹색", "초록", "초록색"], "하양": ["하양", "흰색", "백색"], "노랑": ["노랑", "황색"], "파랑": ["파랑", "청색"]}
RANK_COLORS = {
    "주황": ["주황", "주황색", "연주황", "적주황"],
    "빨강": ["빨강", "적색", "빨간", "적"],
    "하양": ["하양", "흰색", "백색"],
    "파랑": ["파랑", "청색", "파란"],
    "노랑": ["노랑", "황색", "노란"],
    "연두": ["연두", "녹색", "초록", "초록색"],
}
OVAL, OBLONG, ROUND = "타원형", "장방형", "원형"


def strip(c: Column) -> Column:
    """Without white space at either end; trim() would drop spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _upper(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit("")))


def _none() -> Column:
    return F.array().cast("array<string>")


def replaced(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def _without_slips(c: Column) -> Column:
    for slip, meant in DW_SLIPS:
        c = replaced(c, slip, meant)
    return c


def unhyphened(c: Column) -> Column:
    return replaced(c, "-", "")


def normalize_ocr(c: Column, basic: bool = False) -> Column:
    """Upper case with other characters as spaces (basic: removed) and single spaces."""
    if basic:
        kept = F.regexp_replace(_upper(c), r"(?U)[^A-Z0-9.\-\s]+", "")
        return F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", " "), "^ | $", "")
    kept = F.regexp_replace(_upper(c), r"[^A-Z0-9.\-\s]+", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(_upper(c), F.lit(TOKEN), F.lit(0))


def norm_token(c: Column) -> Column:
    return strip(unhyphened(_upper(c)))


def print_tokens(front: Column, back: Column) -> Column:
    both = F.concat(F.coalesce(front, F.lit("")), F.lit(" "), F.coalesce(back, F.lit("")))
    return F.array_distinct(tokens(both))


def post_fix_imprint(c: Column, basic: bool = False) -> Column:
    """A reading with usual slips mended; two known pairs of marks replace all else they stand with."""
    if basic:
        return F.trim(F.regexp_replace(F.regexp_replace(_upper(c), PAC_ANYWHERE, "PAC"), r"\s+", " "))
    s = F.trim(F.regexp_replace(F.regexp_replace(_upper(c), r"[^A-Z0-9\-\s.]", " "), r"\s+", " "))
    s = F.regexp_replace(_without_slips(s), PAC, "PAC")
    every = F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))
    keys = F.transform(every, unhyphened)
    first = F.filter(every, lambda t, i: F.array_position(keys, unhyphened(t)) == i + 1)
    shown = F.transform(first, lambda t: F.when(unhyphened(t) == "DW", F.lit("D-W")).otherwise(t))
    dw, pac = F.array_contains(shown, "D-W"), F.array_contains(shown, "PAC")
    return F.when(dw & pac, F.lit("D-W PAC")).when(dw, F.lit("D-W")).when(pac, F.lit("PAC")).otherwise(F.array_join(shown, " "))


def ocr_variants(c: Column) -> Column:
    """Up to MOST_VARIANTS spellings, the shortest first, then by code point."""
    s = strip(_upper(c))
    flat = unhyphened(s)
    every = [s, flat, replaced(s, " ", "")] + [replaced(x, a, b) for a, b in READER_SWAPS for x in (s, flat)]
    ordered = F.array_sort(F.transform(F.array_distinct(F.array(*every)), lambda x: F.struct(F.length(x).alias("n"), x.alias("s"))))
    return F.when(s == "", _none()).otherwise(F.slice(ordered, 1, MOST_VARIANTS).getField("s"))


def query_tokens(imprint: Column) -> Column:
    """Tokens of an imprint and of all its variants."""
    return F.array_distinct(F.flatten(F.transform(F.concat(F.array(F.coalesce(imprint, F.lit(""))), ocr_variants(imprint)), tokens)))


def rank_norm(c: Column, basic: bool = False) -> Column:
    s = strip(_upper(c))
    return s if basic else _without_slips(s)


def rank_tokens(c: Column, basic: bool = False) -> Column:
    return F.regexp_extract_all(rank_norm(c, basic), F.lit(TOKEN), F.lit(0))


def item_rank_tokens(front: Column, back: Column, basic: bool = False) -> Column:
    return F.array_union(rank_tokens(front, basic), rank_tokens(back, basic))


def _swapped(strings: Column) -> Column:
    """All strings after one swap each; a swap that finds nothing gives a string that is there already."""
    return F.flatten(F.transform(strings, lambda s: F.array(*[replaced(s, a, b) for a, b in RANK_SWAPS])))


def rank_variants(t: Column, basic: bool = False) -> Column:
    """The spellings under which a target token may stand on an item, in code point order."""
    s = rank_norm(t, basic)
    base = F.array(s, unhyphened(s))
    if basic:
        return F.when(s == "", _none()).otherwise(F.array_sort(F.array_distinct(base)))
    # Two rounds; a round keeps its input, as a no-op swap returns it.
    out = F.transform(_swapped(F.array_distinct(_swapped(F.array_distinct(base)))), lambda x: x)
    out = F.array_distinct(F.concat(base, out, F.transform(out, unhyphened)))
    return F.array_sort(F.filter(out, lambda x: F.length(x) >= 2))


def token_weight(t: Column, basic: bool = False) -> Column:
    flat = unhyphened(rank_norm(t, basic))
    strong = flat.isin("DW") if basic else flat.isin("DW", "DVV")
    return F.when(strong, WEIGHTS["DW"]).when(rank_norm(t, basic) == "PAC", WEIGHTS["PAC"]).otherwise(WEIGHTS["other"])


def match_level(score: Column) -> Column:
    return F.when(score >= 120, "HIGH").when(score >= 70, "MEDIUM").otherwise("LOW")


def shape_aliases(c: Column, stripped: bool = False) -> Column:
    """Shapes that a guess stands for; none without a guess."""
    s = strip(c) if stripped else c
    pair = F.array(F.lit(OVAL), F.lit(OBLONG))
    return F.when(c.isNull() | (c == ""), _none()).when(s.isin(OVAL, OBLONG), pair).otherwise(F.array(s))


def _aliases(parts: Column, names: dict[str, list[str]]) -> Column:
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), F.array(p)))))


def color_aliases_prefilter(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), _none()).otherwise(_aliases(F.split(c, "[+,/ ]+"), PREFILTER_COLORS))


def color_aliases_rank(c: Column, basic: bool = False) -> Column:
    s = strip(c)
    parts = F.array(s) if basic else F.filter(F.split(s, r"[+,/\s]+"), lambda p: p != "")
    return F.when(c.isNull() | (c == ""), _none()).otherwise(_aliases(parts, RANK_COLORS))


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def candidate_view(prefix: str = "") -> Column:
    """The shown fields of a catalogue row whose columns may carry a prefix."""
    col: Callable[[str], Column] = lambda n: F.col(prefix + n)
    return F.struct(
        _given(col("item_name")).alias("item_name"),
        _given(col("entp_name")).alias("entp_name"),
        F.coalesce(_given(col("print_front")), _given(col("print_back"))).alias("imprint"),
        _given(col("color_class1")).alias("color"),
        _given(col("drug_shape")).alias("shape"),
    )


def pill_note(imprint: Column, mode: Column, policy: str = "batch") -> Column:
    """policy: batch (pre-filter mode), single or basic."""
    failed = F.coalesce(imprint, F.lit("")) == ""
    if policy == "basic":
        return F.when(failed, F.lit("OCR 실패"))
    if policy == "single":
        return F.lit("single")
    return F.concat(F.when(failed, F.lit("OCR 실패; ")).otherwise(F.lit("")), F.lit("prefilter="), mode)
