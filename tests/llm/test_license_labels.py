"""Labels, scores and permission of whole texts against what was put into them."""

import random

import pytest

from imprintmatch.llm import licenses as L

NAMES = {"MIT": "mit", "Apache-2.0": "apache", "GPL-3.0-only": "gpl", "LGPL-2.1+": "lgpl", "BSD-3-Clause": "bsd", "CDDL-1.0": "cddl", "OFL-1.1": "ofl", "Zlib": "zlib", "LicenseRef-house": "licenseref-house"}
NOTICES = {"MIT License": ("mit", True), "apache LICENSE": ("apache", True), "GNU General Public License": ("gpl", True), "Mozilla Public License": ("mpl", False), "All rights reserved": ("reserved", False), "public-domain": ("public-domain", False)}


def tree(rnd, depth):
    """(expression, labels, whether PERMISSIVE is enough)"""
    if depth == 0 or rnd.random() < 0.3:
        name = rnd.choice(list(NAMES))
        text = name + rnd.choice(["", "", " WITH Classpath-exception-2.0"])
        return text, {NAMES[name]}, NAMES[name] in L.PERMISSIVE
    op = rnd.choice(["AND", "or", "OR", "and"])
    (a, la, pa), (b, lb, pb) = tree(rnd, depth - 1), tree(rnd, depth - 1)
    return f"({a} {op} {b})", la | lb, pa and pb if op.lower() == "and" else pa or pb


def test_labels_equal_what_was_put_in(make_docs):
    rnd, texts, want = random.Random(5), [], []
    for _ in range(400):
        labels, base, permitted, tagged, lines = set(), set(), True, False, []
        for _ in range(rnd.randrange(4)):
            kind = rnd.randrange(3)
            if kind == 0:
                text, own, ok = tree(rnd, 3)
                lines.append(rnd.choice(["SPDX-License-Identifier: {}", "/* spdx-license-identifier: {} */", "<!-- SPDX-License-Identifier: {} -->", "# SPDX-License-Identifier: {} and text"]).format(text))
                labels, permitted, tagged = labels | own, permitted and ok, True
            elif kind == 1:
                text = rnd.choice(list(NOTICES))
                lines.append(f"see the {text}, which")
                labels.add(NOTICES[text][0])
                permitted = permitted and NOTICES[text][0] in L.PERMISSIVE
                base |= {NOTICES[text][0]} if NOTICES[text][1] else set()
            else:
                lines.append("nothing of that kind")
        texts.append("\n".join(lines))
        want.append((",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if tagged else 0.9 if base else 0.6 if labels else 0.0, permitted if labels else None))
    docs = make_docs(texts).selectExpr("*", "'x' as labels", "1.0 as score", "true as permitted")
    rows = L.scan_licenses(docs.union(docs)).collect()
    got = {}
    for r in rows:
        assert got.setdefault(r.doc_id, r) == r
    assert len(rows) == 2 * len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.base_labels, r.labels, r.score, r.permitted) == w, texts[i]


PROSE = {"(MIT OR Apache-2.0) and text": "apache,mit", "MIT with the usual notice": "mit", "mitigation": "", "see LICENSE": "", "Foo-1.0 OR bar": "foo-1.0", "GPLv2 or later": "gpl"}


@pytest.mark.parametrize("line", PROSE)
def test_prose_is_no_identifier(line):
    assert L.scan_text(f"SPDX-License-Identifier: {line}", L.phrase_automaton())["labels"] == PROSE[line]


def test_allowed_is_a_parameter(make_docs):
    docs = make_docs(["SPDX-License-Identifier: GPL-3.0 OR MPL-2.0", None])
    assert [r.permitted for r in L.scan_licenses(docs, allowed=frozenset({"mpl"})).orderBy("doc_id").collect()] == [True, None]
