"""License recognition by known sentences and ordered rules over their identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import in_small_batches, text_slices, texts_of

# Known licence sentences, as public licence texts have them, under the identifiers that rules name.
SENTENCES = {
    "released-mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License."],
    "released-apache2": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "This project is licensed under the Apache License 2.0."],
    "released-gpl3": ["This work is licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License, version 3."],
    "released-gpl2": ["This work is licensed under the GNU General Public License, version 2.", "This program is licensed under the GNU General Public License, version 2."],
    "released-ccbync4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "released-ccby4": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "mit-permission": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "isc-permission": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd-permission": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "apache2-comply": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    # sentences as the marks of sentences() cut them: GNU notices end one at ':' and ';'
    "gpl2-free": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."],
    "lgpl21-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-free": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2."],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "agpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation;"],
    "later-2": ["either version 2 of the License, or (at your option) any later version."],
    "later-21": ["either version 2.1 of the License, or (at your option) any later version."],
    "later-3": ["either version 3 of the License, or (at your option) any later version."],
    "mpl2-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "apache2-title": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "mit0-permission": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "0bsd-permission": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "zlib-permission": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "boost-permission": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "wtfpl-permission": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "postgres-permission": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "ofl-notice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "gfdl13-title": ["GNU Free Documentation License Version 1.3, 3 November 2008"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
}
#: Licences by the ordered sentence identifiers that tell them; the first rule that fits at a place wins, so
#: longer rules stand before those that they contain.
RULES = [
    ("MIT", "mit-text", ["mit-permission", "mit-notice", "mit-warranty"]),
    ("BSD-3-Clause", "bsd3-text", ["bsd-permission", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "bsd2-text", ["bsd-permission", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", "apache2-header", ["released-apache2", "apache2-comply", "apache2-copy"]),
    ("GPL-3.0-or-later", "gpl3-header", ["gpl-free", "gpl-warranty"]),
    ("GPL-3.0-or-later", "gpl3-terms", ["gpl-terms", "later-3"]),
    ("GPL-2.0-or-later", "gpl2-terms-later", ["gpl-terms", "later-2"]),
    ("LGPL-2.1-or-later", "lgpl21-terms", ["lgpl-terms", "later-21"]),
    ("LGPL-3.0-or-later", "lgpl3-terms", ["lgpl-terms", "later-3"]),
    ("AGPL-3.0-or-later", "agpl3-terms", ["agpl-terms", "later-3"]),
    ("GPL-3.0-or-later", "gpl3-sentence", ["gpl-free"]),
    ("GPL-2.0-or-later", "gpl2-sentence", ["gpl2-free"]),
    ("LGPL-2.1-or-later", "lgpl21-sentence", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", "lgpl3-sentence", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", "agpl3-sentence", ["agpl3-free"]),
    ("GPL-2.0-only", "gpl2-only-sentence", ["gpl2-terms"]),
    ("MPL-2.0", "mpl2-sentence", ["mpl2-terms"]),
    ("GPL-3.0", "gpl3-title", ["gpl3-title"]),
    ("GPL-2.0", "gpl2-title", ["gpl2-title"]),
    ("LGPL-3.0", "lgpl3-title", ["lgpl3-title"]),
    ("LGPL-2.1", "lgpl21-title", ["lgpl21-title"]),
    ("AGPL-3.0", "agpl3-title", ["agpl3-title"]),
    ("Apache-2.0", "apache2-title", ["apache2-title"]),
    ("ISC", "isc-text", ["isc-permission"]),
    ("MIT-0", "mit0-text", ["mit0-permission"]),
    ("0BSD", "0bsd-text", ["0bsd-permission"]),
    ("Zlib", "zlib-text", ["zlib-permission"]),
    ("Unlicense", "unlicense-text", ["unlicense-free"]),
    ("BSL-1.0", "boost-text", ["boost-permission"]),
    ("WTFPL", "wtfpl-text", ["wtfpl-permission"]),
    ("PostgreSQL", "postgres-text", ["postgres-permission"]),
    ("OFL-1.1", "ofl-notice", ["ofl-notice"]),
    ("EPL-2.0", "epl2-notice", ["epl2-notice"]),
    ("MPL-2.0", "mpl2-title", ["mpl2-title"]),
    ("GFDL-1.3", "gfdl13-title", ["gfdl13-title"]),
    ("MIT", "mit-notice-line", ["released-mit"]),
    ("Apache-2.0", "apache2-notice-line", ["released-apache2"]),
    ("GPL-3.0-only", "gpl3-notice-line", ["released-gpl3"]),
    ("GPL-2.0-only", "gpl2-notice-line", ["released-gpl2"]),
    ("CC-BY-NC-4.0", "ccbync4-notice-line", ["released-ccbync4"]),
    ("CC-BY-4.0", "ccby4-notice-line", ["released-ccby4"]),
]
# SPDX identifiers of licences, and the names that notices call them by.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT", "MIT/Expat License", "Expat License"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License"],
    "0BSD": ["BSD Zero Clause License", "0BSD License", "Zero-Clause BSD License"],
    "BSD-1-Clause": ["BSD 1-Clause License", "BSD-1-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License", "FreeBSD License", "BSD 2-Clause \"Simplified\" License", "2-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License", "New BSD License", "Modified BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "3-clause BSD license"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software License"],
    "ISC": ["ISC License"],
    "X11": ["X11 License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA Open Source License"],
    "PostgreSQL": ["PostgreSQL License"],
    "Python-2.0": ["Python License 2.0", "Python Software Foundation License", "PSF License"],
    "PHP-3.01": ["PHP License v3.01", "PHP License, version 3.01"],
    "Ruby": ["Ruby License"],
    "Vim": ["Vim License"],
    "curl": ["curl License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "WTFPL": ["Do What The F*ck You Want To Public License", "WTFPL", "WTFPL License"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero v1.0 Universal License"],
    "Apache-1.1": ["Apache Software License 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License 2.0"],
    "Artistic-1.0": ["Artistic License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "AFL-3.0": ["Academic Free License 3.0", "Academic Free License v. 3.0", "Academic Free License version 3.0"],
    "OSL-3.0": ["Open Software License 3.0", "Open Software License v. 3.0", "Open Software License version 3.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0", "Educational Community License 2.0"],
    "MS-PL": ["Microsoft Public License", "Microsoft Public License (Ms-PL)"],
    "MS-RL": ["Microsoft Reciprocal License", "Microsoft Reciprocal License (Ms-RL)"],
    "MulanPSL-2.0": ["Mulan PSL v2", "Mulan Permissive Software License, Version 2"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL-1.1 License"],
    "LPPL-1.3c": ["LaTeX Project Public License 1.3c", "LaTeX Project Public License, version 1.3c"],
    "GPL-1.0-only": ["GNU General Public License, version 1", "GNU General Public License v1.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GPL v2", "GPL version 2", "GPL-2.0", "GPLv2 License", "GPL-2.0 License"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later", "GPLv2+", "GPL-2.0+", "GPL v2 or later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL v3", "GPL version 3", "GPL-3.0", "GPLv3 License", "GPL-3.0 License"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later", "GPLv3 or later", "GPLv3+", "GPL-3.0+", "GPL v3 or later"],
    "LGPL-2.0-only": ["GNU Library General Public License, version 2", "GNU Library General Public License v2"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL v2.1", "LGPL-2.1", "LGPL-2.1 License"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later", "GNU Lesser General Public License v2.1 or later"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL v3", "LGPL-3.0", "LGPL-3.0 License"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later", "GNU Lesser General Public License v3.0 or later"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL v3", "AGPL-3.0", "AGPL-3.0 License"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "GNU Affero General Public License v3.0 or later"],
    "GFDL-1.3-only": ["GNU Free Documentation License, version 1.3", "GNU Free Documentation License v1.3"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0 License"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "European Union Public License 1.2", "EUPL, Version 1.2", "EUPL v1.2"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0", "CDDL 1.0 License"],
    "CPL-1.0": ["Common Public License 1.0", "Common Public License, Version 1.0"],
    "QPL-1.0": ["Q Public License 1.0", "Q Public License version 1.0"],
    "BUSL-1.1": ["Business Source License 1.1", "Business Source License, Version 1.1"],
    "ODbL-1.0": ["Open Database License 1.0", "Open Data Commons Open Database License v1.0"],
    "ODC-By-1.0": ["Open Data Commons Attribution License 1.0", "Open Data Commons Attribution License v1.0"],
    "PDDL-1.0": ["Open Data Commons Public Domain Dedication and License 1.0", "ODC Public Domain Dedication and License 1.0"],
}
# Conditions of Creative Commons licences and their long names; each of them in several versions.
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _k, _long in CREATIVE.items():
    for _v, _kind in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        NAMES[f"CC-{_k}-{_v}"] = [f"CC {_k} {_v}", f"CC-{_k}-{_v}", f"CC {_k} {_v} License", f"Creative Commons {_long} {_v} {_kind} License", f"Creative Commons {_long} {_v} License"]
# What notices say before the name of a licence, and after it.
SAYING = ["licensed under", "dual licensed under", "dual-licensed under", "published under", "released under", "distributed under", "made available under", "available under", "provided under"]
SUBJECTS = ["", "this project is", "this software is", "this work is", "this program is", "this package is", "this library is", "this file is", "this code is", "it is", "the code is", "the project is"]
ENDINGS = ["", "see LICENSE", "see the LICENSE file", "see LICENSE for details", "see the LICENSE file for details", "see LICENSE.md for details", "see the LICENSE.md file for details", "see the file LICENSE for details"]
for _id, _names in NAMES.items():
    SENTENCES[f"named-{_id}"] = [*_names, _id, f"SPDX-License-Identifier: {_id}", f"License: {_id}", f"License: {_names[0]}"]
    RULES.append((_id, f"{_id}-named", [f"named-{_id}"]))
#: Identifiers that only a notice or a tag names: what a bare name stands for has to be said before it.
_TAGGED = re.compile(r"^(?:spdx-license-identifier|license) ")
_NOTICE = re.compile(rf"^(?:(?:{'|'.join(x for x in SUBJECTS if x)}) )?(?:{'|'.join(SAYING)}) (?:(?:the|a|an) )?(?:terms of (?:the )?)?")

#: Other sentences that may stand between two of a rule.
MAX_GAP = 3

# neither the colon of a tag nor the dot of "v." ends a sentence
_END = re.compile(r"(?<!\s[Vv])[.!?;](?=\s|[!?]|$)|(?<![Ii]dentifier)(?<![Ll]icense)(?<![Ll][Ii][Cc]ENSE):(?=\s|$)|\n\s*\n|\r\n\s*\r\n")
_WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*\+?")


def normalise(sentence: str) -> str:
    """Lower-case words and numbers only, so quotes, list marks, line breaks and comment signs don't matter."""
    return " ".join(_WORD.findall(sentence.lower()))


KNOWN = {normalise(s): k for k, forms in SENTENCES.items() if not k.startswith("named-") for s in forms}
#: Names and tags of licences; a name counts only in a notice.
NAMED = {normalise(s): k for k, forms in SENTENCES.items() if k.startswith("named-") for s in forms}
#: Sentences with a place for whoever holds the copyright, over normalised words.
_HOLDER = r"(?:[^ ]+ ){1,16}"
SLOTS = [
    (re.compile(rf"neither the names? of {_HOLDER}nor the names? of (?:its|their|any|the|other) (?:[^ ]+ ){{0,3}}?contributors may be used to endorse or promote products derived from this software without specific prior written permission"), "bsd-endorse"),
    (re.compile(rf"neither the names? of {_HOLDER}may be used to endorse or promote products derived from this software without specific prior written permission"), "bsd-endorse"),
    (re.compile(rf"the names? of {_HOLDER}may not be used to endorse or promote products derived from this software without specific prior written permission"), "bsd-endorse"),
]
#: Said of a licence that the words name: "this code is MIT licensed".
_LICENSED = re.compile(rf"^(?:(?:{'|'.join(x for x in SUBJECTS if x)}) )?(.{{1,80}}) licen[sc]ed$")
_HEADING = {"license", "licence", "licensing", "licenses"}


def expression(words: str) -> str | None:
    """The licences that names or SPDX identifiers joined by and, or and with tell, as `expression:A|B WITH C`; None
    where one of them is unknown."""
    if words in NAMED:
        return NAMED[words]
    terms, known = re.split(r" (?:and/or|and|or) (?!later)", words), []
    for term in terms:
        name, *more = term.split(" with ")
        name = name.removeprefix("the ")
        if (of := NAMED.get(name)) is None or len(more) > 1 or (more and more[0] not in EXCEPTIONS):
            return None
        known.append(of.removeprefix("named-") + (f" WITH {EXCEPTIONS[more[0]]}" if more else ""))
    return "expression:" + "|".join(dict.fromkeys(known)) if len(known) > 1 or " WITH " in known[0] else f"named-{known[0]}"


# SPDX identifiers of exceptions to licences.
EXCEPTIONS = {x.lower(): x for x in ("Classpath-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1", "Linux-syscall-note", "LLVM-exception", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "OpenSSL-exception", "Qt-GPL-exception-1.0", "u-boot-exception-2.0")}
_ENDINGS = sorted({" " + normalise(e) for e in ENDINGS if e}, key=len, reverse=True)
#: Every known sentence holds one of these, so a text without any holds no known sentence.
ANCHORS = ("licens", "permission", "permitted", "redistribution", "warranty", "copyright", *(f"{x.split()[-2]} under" for x in SAYING), "public domain")
assert all(any(a in s for a in ANCHORS) for s in KNOWN)
_LONGEST = max(len(s.split()) for s in KNOWN)


def identify_sentence(words: str) -> str | None:
    """The identifier of a normalised sentence: known as it stands, or a notice or tag that names a licence."""
    if (name := KNOWN.get(words)) is not None:
        return name
    if m := _TAGGED.match(words):
        return NAMED.get(words) or expression(words[m.end() :])
    if m := _NOTICE.match(words):
        rest = words[m.end() :]
        if name := expression(rest):
            return name
        for e in _ENDINGS:
            if rest.endswith(e):
                return expression(rest[: -len(e)])
    if (m := _LICENSED.match(words)) and m[1] in NAMED:
        return NAMED[m[1]]
    if "endorse" in words:
        return next((name for pattern, name in SLOTS if pattern.fullmatch(words)), None)
    return None


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets of sentences, each with the mark that ends it."""
    out, start = [], 0
    for m in _END.finditer(text):
        out.append((start, m.end()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def known_sentences(text: str) -> list[tuple[int, str, int, int]]:
    """Number, identifier and offsets of the known sentences of a text.

    A sentence may also begin or end with a line: where a whole one is unknown, its runs of whole lines are tried,
    each as long as a known sentence can be, and after a known one those that follow it.
    """
    out, headed = [], False
    for k, (x, y) in enumerate(sentences(text)):
        low, after = text[x:y].lower(), headed
        headed = False
        if not after and not any(a in low for a in ANCHORS):
            continue
        found, words = [], normalise(low)
        headed = words in _HEADING
        if name := identify_sentence(words) or (NAMED.get(words) if after else None):
            found.append((name, x, y))
        else:
            edges = [x, *(x + m.end() for m in re.finditer("\n", text[x:y])), y]
            i = 0
            while i < len(edges) - 1:
                start, step = edges[i], i + 1
                for j in range(i + 1, len(edges)):
                    words = normalise(text[start : edges[j]])
                    if name := identify_sentence(words):
                        found.append((name, start, edges[j]))
                        step = j
                        break
                    if words.count(" ") >= _LONGEST:
                        break
                i = step
        for name, x, y in found:
            whole = text[x:y]
            out.append((k, name, x + len(whole) - len(whole.lstrip()), x + len(whole.rstrip())))
    return out


def recognise(text: str) -> list[dict]:
    """Licences in a text: sentences to identifiers, then identifiers to rules."""
    low = text.lower()
    if not any(a in low for a in ANCHORS):
        return []
    out = _apply(known_sentences(text))
    return sorted(out, key=lambda m: (m["start"], m["end"]))


def _apply(ids: list[tuple[int, str, int, int]]) -> list[dict]:
    """Rules over known sentences; those that stood in the gaps of a rule are looked at by themselves."""
    out, at = [], 0
    while at < len(ids):
        if ids[at][1].startswith("expression:"):
            out += [{"license": x, "rule": "expression", "start": ids[at][2], "end": ids[at][3]} for x in ids[at][1].removeprefix("expression:").split("|")]
            at += 1
            continue
        for licence, rule, order in RULES:
            took, j = [], at
            for want in order:
                while j < len(ids) and ids[j][1] != want and (not took or ids[j][0] - ids[took[-1]][0] <= MAX_GAP + 1):
                    j += 1 if took else len(ids)
                if j >= len(ids) or ids[j][1] != want or (took and ids[j][0] - ids[took[-1]][0] > MAX_GAP + 1):
                    break
                took.append(j)
                j += 1
            if len(took) == len(order):
                out.append({"license": licence, "rule": rule, "start": ids[took[0]][2], "end": ids[took[-1]][3]})
                if j - at > len(took):
                    out += _apply([x for i, x in enumerate(ids[at:j], at) if i not in took])
                at = j
                break
        else:
            at += 1
    return out


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_licences(docs: DataFrame) -> DataFrame:
    """Licences of every document, in order of place.

    Returns doc_id, licenses (distinct names, sorted), matches array<struct<license, rule, start, end>> with
    offsets in code points.  Null and empty texts have none; empty tables give empty results; repeated rows are
    scanned each; other columns are not read; long texts are scanned whole.
    """

    in_small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = [recognise(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([sorted({m["license"] for m in f}) for f in found], pa.list_(pa.string())), pa.array(found, _MATCH)], names=["doc_id", "licenses", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licenses array<string>, matches array<struct<license string, rule string, start int, end int>>")
