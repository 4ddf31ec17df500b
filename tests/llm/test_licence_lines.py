"""Licences: several known lines in one sentence, sentences in the gap of a rule, and notices of the GNU family."""

import pytest

from factloom.llm import licences


def names(text: str) -> list[str]:
    return [m["license"] for m in licences.recognise(text)]


def test_lines_without_marks():
    text = "NOTICE\nLicensed under CC BY 4.0\nReleased under the MIT License\n  other words\nLicensed under the Apache License, Version 2.0"
    found = licences.recognise(text)
    assert [(m["license"], text[m["start"] : m["end"]]) for m in found] == [("CC-BY-4.0", "Licensed under CC BY 4.0"), ("MIT", "Released under the MIT License"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0")]


def test_sentences_in_the_gap_of_a_rule():
    s = licences.SENTENCES
    text = " ".join([s["mit-permission"][0], "Licensed under the Apache License, Version 2.0.", s["mit-notice"][0], "Words.", s["released-ccby4"][0], s["mit-warranty"][0]])
    found = licences.recognise(text)
    assert [m["license"] for m in found] == ["MIT", "Apache-2.0", "CC-BY-4.0"] and found[0]["rule"] == "mit-text"
    assert found[0]["start"] < found[1]["start"] < found[2]["start"] < found[0]["end"]


def test_notices_and_titles():
    gnu = "This {} is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    assert names(gnu.format("program", ":", "General Public License", ",", "3")) == ["GPL-3.0-or-later"]
    assert names(gnu.format("program", ";", "General Public License", ";", "2")) == ["GPL-2.0-or-later"]
    assert names(gnu.format("library", ";", "Lesser General Public License", ";", "2.1")) == ["LGPL-2.1-or-later"]
    assert names(gnu.format("library", ":", "Lesser General Public License", ",", "3")) == ["LGPL-3.0-or-later"]
    assert names(gnu.format("program", ":", "Affero General Public License", ",", "3")) == ["AGPL-3.0-or-later"]
    assert names("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy") == ["MPL-2.0"]
    assert names("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007") == ["GPL-3.0"]
    assert names("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS") == ["Apache-2.0"]


def test_every_rule_fires():
    for licence, rule, order in licences.RULES:
        first = [licences.SENTENCES[k][0] for k in order]
        if rule.endswith("-named"):
            first = [f"It is made available under the terms of the {first[0]}."]
        found = licences.recognise("Words before.\n" + "\n".join(first) + "\nWords after.")
        assert (licence, rule) in {(m["license"], m["rule"]) for m in found}, rule
    assert len({licence for licence, _, _ in licences.RULES}) > 80


def test_notices_by_hand():
    cases = {
        "Licensed under the MIT License, see LICENSE": "MIT", "SPDX-License-Identifier: MIT": "MIT", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;": "GPL-2.0-or-later",
        "# This file is distributed under the terms of the Mozilla Public License, v. 2.0": "MPL-2.0", "This library is licensed under the GNU Lesser General Public License v3.0.": "LGPL-3.0-only",
        "Released under CC0 1.0 Universal": "CC0-1.0", "This is free and unencumbered software released into the public domain.": "Unlicense", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0",
        "License: Apache-2.0": "Apache-2.0", "It is made available under the Boost Software License, Version 1.0.": "BSL-1.0", "Distributed under the AGPLv3\n": "AGPL-3.0-only",
        "This project is licensed under the BSD 3-Clause License - see the LICENSE.md file for details": "BSD-3-Clause",
    }
    for text, want in cases.items():
        assert names(text) == [want], text
    for text in ("The MIT License is short.", "MIT", "He released under the table a dog.", "Licensed under water.", "License: see below", "It was made available under the bridge."):
        assert names(text) == [], text


def brute(text: str) -> set[str]:
    """Licences whose single-sentence notices stand in a text, word by word, by a search over all phrases."""
    import itertools
    import re

    words = " " + " ".join(re.findall(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*", text.lower())) + " "
    return {k for k, forms in licences.NAMES.items() for f, s, a in itertools.product(forms, licences.SAYING, ("", "the ", "a ")) if f" {s} {a}{licences.normalise(f)} " in words}


def test_documents_hold_no_other_notice(spark):
    """Every notice that a plain search finds in the documents is recognised, and nothing is recognised without words of its licence."""
    from factloom.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    got = {r.doc_id: set(r.licenses) for r in licences.scan_licences(docs).collect()}
    plain = {r.doc_id: brute(r.text) for r in docs.collect() if " under " in r.text}
    longer = {"CC-BY-4.0": {"CC-BY-NC-4.0"}}
    missed = {(d, k) for d, want in plain.items() for k in want - got[d] if not longer.get(k, set()) & want}
    assert sum(map(bool, plain.values())) > 5 and not missed, sorted(missed)[:5]
    assert all(not found or brute(r.text) or "licen" in r.text.lower() for r in docs.collect() for found in [got[r.doc_id]])


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{0}
THIS SOFTWARE IS PROVIDED BY THE REGENTS "AS IS"."""
ENDORSE = "3. Neither the name of {0} may be used to endorse or promote products derived from this software without specific prior written permission."


@pytest.mark.parametrize(("text", "want"), [
    (BSD.format(ENDORSE.format("Google Inc. nor the names of its contributors").replace("Google Inc.", "Google Inc")), ["BSD-3-Clause"]),
    (BSD.format(ENDORSE.format("the University nor the names of its contributors")), ["BSD-3-Clause"]),
    (BSD.format(ENDORSE.format("the copyright holder nor the names of its contributors")), ["BSD-3-Clause"]),
    (BSD.format(""), ["BSD-2-Clause"]),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
    ("# SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0)\nimport x", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
    ("/* SPDX-License-Identifier: GPL-2.0+ */", ["GPL-2.0-or-later"]), ("SPDX-License-Identifier: Nobody-1.0 OR MIT", []),
    ("Licensed under GPL-3.0-or-later.", ["GPL-3.0-or-later"]), ("Dual licensed under MIT and GPL v2.", ["GPL-2.0-only", "MIT"]), ("Published under the MIT License.", ["MIT"]), ("The code is MIT licensed.", ["MIT"]),
    ("# License\n\nMIT\n\nMore.", ["MIT"]), ("# Licence\n\nNothing here.", []), ("MIT\n\nA school.", []), ("Beer is licensed.", []),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
])
def test_named_holders_expressions_and_headings(text, want):
    assert sorted({m["license"] for m in licences.recognise(text)}) == want
