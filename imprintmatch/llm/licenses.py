"""License scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by shunting-yard."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further notices that give a label but are not counted.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "reserved",
}

#: An identifier tag as words, and as it stands in a text.
TAG = "spdx license identifier"
TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
#: Words of fields and phrases that name a licence, and what follows them on their line.
FIELD_WORDS = ("license", "licence", "licenses", "licences", "licensed", "licenced")
FIELD = re.compile(
    r"(?<![\w-])(?:licen[cs]es?[\"']?[ \t]*(?::|=>?)[ \t]*[\[({]?|(?:dual[ -])?licen[cs]ed[ \t]+(?:(?:under|as|with)[ \t]+)?(?:(?:the|either)[ \t]+)?(?:terms[ \t]+of[ \t]+(?:the[ \t]+)?)?)([^\r\n]*)", re.I
)
#: The edition of the lists of phrases and identifiers below and above.
LIST_VERSION = "2"

#: Labels of licence identifiers by their first part (lower case); the longest that fits counts.
FAMILIES = {
    "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "gfdl": "gfdl", "apache": "apache", "mit": "mit", "mpl": "mpl", "epl": "epl",
    "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "bsl": "bsl", "cc0": "cc0", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "unlicense": "public-domain", "zlib": "zlib", "artistic": "artistic", "wtfpl": "wtfpl",
    "eupl": "eupl", "cddl": "cddl", "ofl": "ofl", "python": "python", "postgresql": "postgresql", "openssl": "openssl", "ncsa": "ncsa", "x11": "mit",
}
_FAMILY = re.compile(rf"({'|'.join(sorted(map(re.escape, FAMILIES), key=len, reverse=True))})(?=$|[-+.]|v?\d)")
#: Identifiers of no known family: references, and names with a version.
_OTHER = re.compile(r"(licenseref|documentref)-|(?=.*-)(?=.*\d)[a-z]")
#: Labels that may be used without conditions on what is made of a text.
PERMISSIVE = frozenset({"apache", "bsd", "bsl", "cc0", "cc-by", "isc", "mit", "ncsa", "postgresql", "public-domain", "python", "wtfpl", "zlib"})

RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()/,]|[A-Za-z0-9.+:-]+")
#: A slash between identifiers offers a choice, a comma lists what holds together.
SIGNS = {"/": "or", ",": "and"}
COMMENT_END = re.compile(r"--+!?>|\*+/|\?>|%>|[#*%-]\}|\*\)")


class ExpressionError(ValueError):
    pass


def to_postfix(expression: str) -> list[str]:
    """An and/or/with expression in postfix order; or binds least, with most; all from the left."""
    out, held, operand = [], [], True
    for token in TOKEN.findall(expression):
        word = SIGNS.get(token, token.lower())
        if word in RANK:
            if operand:
                raise ExpressionError(f"{token} has no left side")
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif token == "(":
            if not operand:
                raise ExpressionError("no operator before (")
            held.append(token)
        elif token == ")":
            if operand:
                raise ExpressionError("nothing before )")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ExpressionError(") without (")
            held.pop()
        else:
            if not operand:
                raise ExpressionError(f"no operator before {token}")
            out.append(token)
            operand = False
    if operand:
        raise ExpressionError("nothing at the end")
    while held:
        if held[-1] == "(":
            raise ExpressionError("( without )")
        out.append(held.pop())
    return out


def family(identifier: str) -> str:
    known = identifier.lower()
    found = _FAMILY.match(known)
    return FAMILIES[found[1]] if found else known.rstrip("+")


def is_licence(word: str) -> bool:
    """Whether a word can be a licence identifier rather than prose."""
    return bool(_FAMILY.match(word.lower()) or _OTHER.match(word.lower()))


def permits(expression: str, allowed: set[str]) -> bool:
    """Whether the labels in allowed are enough for the expression."""
    stack: list[bool] = []
    for token in to_postfix(expression):
        if token not in RANK:
            stack.append(family(token) in allowed)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if token == "with" else left or right if token == "or" else left and right)
    return stack[0]


def labels_of(expression: str) -> set[str]:
    """The labels of an expression's licences, exceptions aside, or none if it cannot be read."""
    stack: list[set[str]] = []
    try:
        for token in to_postfix(expression):
            if token not in RANK:
                stack.append({family(token)})
                continue
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left | right)
    except ExpressionError:
        return set()
    return stack[0]


def leading_expression(line: str, known: bool = False) -> str:
    """The longest part at the start of a line that is an expression; "" if there is none.  known: of known families only.

    It ends at the end of a comment and of a sentence at the latest.  Read once from the left, as nothing
    that follows mends what cannot be read.
    """
    tokens, good, operand, depth, exception = [], 0, True, 0, False
    for m in TOKEN.finditer(COMMENT_END.split(line, maxsplit=1)[0]):
        token = SIGNS.get(m[0]) or m[0].rstrip(".:")
        if token.lower() in RANK or token == ")":
            if operand:
                break
            operand, exception = token != ")", token.lower() == "with"
            depth -= token == ")"
        elif token == "(" or ("exception" in token.lower() or "-" in token if exception else _FAMILY.match(token.lower()) if known else is_licence(token)):
            if not operand:
                break
            operand, exception = token == "(", False
            depth += token == "("
        else:
            break
        if depth < 0:
            break
        tokens.append(token)
        if not operand and not depth:
            good = len(tokens)
        if token != m[0] and m[0] not in SIGNS:
            break
    return " ".join(tokens[:good])


#: Bytes to a normal form: A-Z to lower case, ASCII that is neither letter nor digit to a space.
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def phrase_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *MORE_PHRASES, TAG, *FIELD_WORDS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: str, automaton: ahocorasick.Automaton, allowed: frozenset[str] = PERMISSIVE) -> dict:
    """Counts, places and labels of one text, and whether the allowed labels suffice for it."""
    words = text.encode("utf-8", "surrogatepass").translate(_FORM).split()
    row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "permitted": None}
    normal = f" {b' '.join(words).decode('latin-1')} "
    hits = [(end - len(phrase) - 1, phrase) for end, phrase in automaton.iter(normal)]
    if not hits:
        return row
    starts = sorted(at for at, phrase in hits if phrase in BASE_PHRASES)
    base = {BASE_PHRASES[phrase] for _, phrase in hits if phrase in BASE_PHRASES}
    more = {MORE_PHRASES[phrase] for _, phrase in hits if phrase in MORE_PHRASES}
    tagged: set[str] = set()
    permitted = base | more <= allowed
    named: set[str] = set()
    seen = {phrase for _, phrase in hits}
    lines = [(tagged, leading_expression(line)) for line in TAGGED.findall(text)] if TAG in seen else []
    lines += [(named, leading_expression(line, known=True)) for line in FIELD.findall(text)] if not seen.isdisjoint(FIELD_WORDS) else []
    for found, expression in lines:
        if expression:
            found |= labels_of(expression)
            permitted = permitted and permits(expression, allowed)
    more |= named
    if starts:
        row["n_base"] = len(starts)
        row["first_word"], row["last_word"] = (normal.count(" ", 0, at) for at in (starts[0], starts[-1]))
    row["base_labels"], row["labels"] = ",".join(sorted(base)), ",".join(sorted(base | more | tagged))
    row["permitted"] = permitted if base | more | tagged else None
    row["score"] = 1.0 if tagged else 0.9 if base or named else 0.6 if more else 0.0
    return row


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permitted boolean"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, permitted.

    Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z.  Base phrases are counted at
    every place; labels of tags, of licence fields ("License: MIT", "licensed under MIT or ...") and of further notices are
    added.  score: 1 with a readable identifier tag, 0.9 with a base phrase or a field that names a known
    licence, 0.6 with another notice, else 0.

    permitted: whether the allowed labels are enough for every notice and, as its and, or and with are
    evaluated, for every readable tag; null without any label.

    Cases: null and empty texts have no words and no labels (empty strings), null places and null permitted;
    of a tag's line the longest leading part that can be read counts, and gives no label if there is none; a
    text of any length is scanned whole; ties do not arise; repeated rows are all returned; only the id and
    the text are read, so other columns cannot clash; an empty table gives no rows.
    """

    def scan(batches):
        automaton = phrase_automaton()
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permitted", pa.bool_())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                rows.append({"doc_id": doc_id} | scan_text(text.as_py() or "", automaton, allowed))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(scan, f"doc_id long, {COLUMNS}")
