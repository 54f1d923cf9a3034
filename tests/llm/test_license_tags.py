"""Tags with something behind their expression."""

import time

import pytest

from imprintmatch.llm import licenses as L

TAGS = {
    "<!-- SPDX-License-Identifier: MIT -->": "mit", "SPDX-License-Identifier: MIT. See the file.": "mit", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */ int x;": "apache,mit",
    "SPDX-License-Identifier: MIT OR": "mit", "SPDX-License-Identifier: MIT OR (GPL-2.0": "mit", 'SPDX-License-Identifier: "MIT" OR "GPL-2.0"': "gpl,mit",
    "SPDX-License-Identifier: MIT. Or see the file": "mit", "SPDX-License-Identifier: -- MIT": "", "SPDX-License-Identifier: (MIT": "", "SPDX-License-Identifier: MIT) x": "mit",
}


@pytest.mark.parametrize("text", TAGS)
def test_leading_part(text):
    row = L.scan_text(text, L.phrase_automaton())
    assert (row["labels"], row["score"]) == (TAGS[text], 1.0 if TAGS[text] else 0.0)


def test_long_line():
    began = time.process_time()
    assert L.leading_expression("MIT OR " * 50000 + "(") == "MIT OR " * 49999 + "MIT"
    assert time.process_time() - began < 5


LINES = {
    "SPDX-License-Identifier:\nMIT-style people": ("", 0.0), "SPDX-License-Identifier:\tMIT\nand more": ("mit", 1.0), "SPDX-License-Identifier: MIT/Apache-2.0": ("apache,mit", 1.0), "SPDX-License-Identifier: MIT, Apache-2.0, see": ("apache,mit", 1.0),
    "License: MIT": ("mit", 0.9), '"license": "MIT",': ("mit", 0.9), "license = 'GPL-3.0-only'": ("gpl", 0.9), "Licence: (MIT OR Apache-2.0)": ("apache,mit", 0.9), "dual licensed MIT OR GPL-2.0": ("gpl,mit", 0.9),
    "Licensed under the Apache-2.0 and MIT.": ("apache,mit", 0.9), "licensed under the terms of the MPL-2.0": ("mpl", 0.9), "driving license: valid": ("", 0.0), "licensed practitioners": ("", 0.0), "License: version-2": ("", 0.0), "sublicense: MIT": ("", 0.0),
    "license:\nMIT": ("", 0.0), '"licenses": ["MIT", "ISC"]': ("isc,mit", 0.9),
}


@pytest.mark.parametrize("text", LINES)
def test_tags_and_fields_on_their_own_line(text):
    row = L.scan_text(text, L.phrase_automaton())
    assert (row["labels"], row["score"]) == LINES[text]


def test_permission_of_lists():
    scan = lambda text: L.scan_text(text, L.phrase_automaton(), frozenset({"mit"}))["permitted"]
    assert scan("License: MIT/GPL-2.0") and scan("dual licensed MIT OR GPL-2.0") and not scan("License: MIT, GPL-2.0")
