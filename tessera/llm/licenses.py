"""Licence scans: sentences map to identifiers, and identifier sequences match ordered licence rules.

A sentence ends at . ! ? or ; before white space, or where a blank line or the text ends; a
line without letters and digits (a bare comment mark) is blank. A line may begin one, so a notice under an unfinished
line counts; a line's end inside a sentence is white space. Sentences are lower-cased to their letters and
digits. A known sentence is found across such ends within it ("v. 2.0", a blank line around an address)
and counts once; it may end at a colon, without a mark where another known one follows at once, and as an SPDX line with
its line. <> in a known sentence stands for one to MOST_BLANK words (a holder's name). A rule is an ordered list of sentence
identifiers; at most GAP unknown sentences may stand between two of them. Where rules overlap, the
one with more sentences wins, then the one that begins first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from .common import beside, session

GAP, MOST_BLANK = 2, 8
# Sentences of public licence notices.
SENTENCES = {
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); ",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE <> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND <> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-liability": "IN NO EVENT SHALL <> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "gpl-or-later": "<> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-or-later": "<> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "<> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-or-later": "<> is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-or-later": "<> is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-or-later": "<> is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "<> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "bsd-allowed": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <>.",
    "bsd-names": "Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY <> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL <> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib-thanks": "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "epl1-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-waived": "To the extent possible under law, <> has waived all copyright and related or neighboring rights to <>.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "public-domain": "This work is in the public domain.",
    "public-domain-placed": "This file is in the public domain.",
    "public-domain-released": "Released into the public domain.",
    "gpl3-body": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl3-freedom": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "gpl2-body": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gpl-copies": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "apache-body": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "apache-licensor": "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "mpl2-body": "\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.",
    "all-rights": "All rights reserved.",
}
RULES = [
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-see")), ("Apache-2.0", ("apache-grant",)),
    ("MIT", ("mit-grant", "mit-as-is", "mit-liability")), ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability")), ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant", "isc-as-is", "isc-liability")), ("0BSD", ("0bsd-grant",)),
    ("GPL-3.0-or-later", ("gpl-or-later", "gpl-hope", "gpl-implied", "gpl-details")), ("GPL-3.0-or-later", ("gpl-or-later",)),
    ("GPL-2.0-or-later", ("gpl2-or-later", "gpl-hope", "gpl-implied", "gpl-details")), ("GPL-2.0-or-later", ("gpl2-or-later",)),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-implied", "gpl-details")), ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-or-later", "gpl-hope", "gpl-implied", "lgpl-details")), ("LGPL-2.1-or-later", ("lgpl21-or-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-or-later", "gpl-hope", "gpl-implied", "lgpl-details")), ("LGPL-3.0-or-later", ("lgpl3-or-later",)),
    ("AGPL-3.0-or-later", ("agpl-or-later", "gpl-hope", "gpl-implied", "agpl-details")), ("AGPL-3.0-or-later", ("agpl-or-later",)),
    ("BSD-2-Clause", ("bsd-allowed", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-allowed", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liability")),
    ("BSD-4-Clause", ("bsd-allowed", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names", "bsd-as-is", "bsd-liability")),
    ("BSD", ("all-rights", "bsd-allowed")), ("BSD", ("bsd-allowed",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-thanks", "zlib-altered", "zlib-notice")), ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)), ("MPL-2.0", ("mpl2-subject", "mpl2-copy")), ("MPL-2.0", ("mpl2-subject",)), ("EPL-2.0", ("epl2-terms",)), ("EPL-1.0", ("epl1-terms",)),
    ("CC0-1.0", ("cc0-dedicated",)), ("CC0-1.0", ("cc0-waived",)), ("Unlicense", ("unlicense",)), ("BSD", ("bsd-style",)),
    ("Public-Domain", ("public-domain",)), ("Public-Domain", ("public-domain-placed",)), ("Public-Domain", ("public-domain-released",)), ("GPL-3.0", ("gpl-copies", "gpl3-body", "gpl3-freedom")), ("GPL-3.0", ("gpl3-body",)),
    ("GPL-2.0", ("gpl-copies", "gpl2-body")), ("GPL-2.0", ("gpl2-body",)), ("GPL-3.0", ("gpl3-freedom",)), ("GNU", ("gpl-copies",)), ("Apache-2.0", ("apache-body", "apache-licensor")), ("Apache-2.0", ("apache-body",)), ("Apache-2.0", ("apache-licensor",)), ("MPL-2.0", ("mpl2-body",)),
    ("All-rights-reserved", ("all-rights",)),
]
# How texts name a licence after "under the".
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "MIT": ("MIT License", "MIT"), "ISC": ("ISC License",), "Zlib": ("zlib License",),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GNU GPL v3 or later", "GPLv3+"), "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GNU GPL v2 or later", "GPLv2+"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPLv3", "GPLv3"), "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPLv2", "GPLv2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPLv3", "LGPLv3"), "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPLv2.1", "LGPLv2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPLv3", "AGPLv3"), "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "BSD": ("BSD License",), "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"), "EPL-2.0": ("Eclipse Public License 2.0",), "BSL-1.0": ("Boost Software License, Version 1.0",), "Unlicense": ("Unlicense",),
}
# Statements around a name, the elements of Creative Commons licences, and SPDX identifiers beside the licences above.
_HOW = ("Released", "Licensed", "Distributed", *(f"This {what} is {done}" for what in ("work", "project", "software", "program", "code", "file") for done in ("licensed", "released", "distributed")))
STATEMENTS = [f"{how} under {terms}{{}}." for how in _HOW for terms in ("", "the ", "the terms of the ")]
#: Where a statement about a project goes on.
POINTERS = ("see the LICENSE file for details", "see the LICENSE file for more details", "see LICENSE for details", "see the [LICENSE](LICENSE) file for details", "see the [LICENSE.md](LICENSE.md) file for details", "see [LICENSE](LICENSE)")
STATEMENTS += [f"This project is {done} under the {{}} - {where}." for done in ("licensed", "released") for where in POINTERS]
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
SPDX = ["GPL-2.0", "GPL-3.0", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "MIT-0", "BSD-1-Clause", "Artistic-2.0", "WTFPL", "PostgreSQL", "Python-2.0", "OFL-1.1"]


def _stated() -> Iterator[tuple[str, str, str]]:
    """(licence, identifier, sentence) of the statements that name a licence."""
    for licence, names in NAMES.items():
        for name in names:
            for i, way in enumerate(STATEMENTS):
                yield licence, f"{licence}-named", way.format(name)
    for code, name in COMMONS.items():
        for version, where in (("4.0", "4.0 International"), ("3.0", "3.0 Unported")):
            for form in (f"a Creative Commons {name} {where} License", f"the Creative Commons {name} {where} License", f"the Creative Commons {name} {version} License", f"CC {code} {version}"):
                for how in ("This work is licensed", "Licensed", "Released"):
                    yield f"CC-{code}-{version}", f"CC-{code}-{version}-named", f"{how} under {form}."
        for how in ("This work is licensed", "Licensed", "Released"):
            yield f"CC-{code}", f"CC-{code}-named", f"{how} under CC {code}."
    for licence in sorted(({x for x, _ in RULES} | set(SPDX)) - {"All-rights-reserved", "BSD", "GNU", "Public-Domain"}) + [f"CC-{c}-{v}" for c in COMMONS for v in ("3.0", "4.0")]:
        yield licence, f"spdx-{licence}", f"SPDX-License-Identifier: {licence}"


def catalogue_sentences() -> list[tuple[str, str]]:
    """(identifier, sentence) of all known sentences; sentences that mean the same share an identifier."""
    return [*SENTENCES.items(), *((name, text) for _, name, text in _stated())]


def catalogue_rules() -> list[tuple[str, tuple[str, ...]]]:
    return RULES + list(dict.fromkeys((licence, (name,)) for licence, name, _ in _stated()))


#: An SPDX line whose expression names more than one licence or an exception.
_SPDX = re.compile(r"(?im)^(.*?SPDX-License-Identifier:)[ \t]*(\(?[\w.+-]+\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[\w.+-]+\)*)+)(.*)$")


def plain_spdx(text: str) -> str:
    """SPDX expressions as a line for each licence that they name; exceptions after WITH name none. ``+`` means or later."""

    def lines(m: re.Match) -> str:
        parts = re.split(r"[ \t]+(?:AND|OR)[ \t]+", re.sub(r"[ \t]+WITH[ \t]+[()]*[\w.+-]+", "", m.group(2), flags=re.I), flags=re.I)
        names = [p.strip("()") for p in parts]
        return "\n".join(f"{m.group(1)} {n[:-1] + '-or-later' if n.endswith('+') else n}" for n in names) + (f"\n{m.group(3)}" if m.group(3).strip() else "")

    return _SPDX.sub(lines, text) if "spdx" in text.lower() else text


_END = re.compile(r"[.!?;](?=\s|$)|\n(?:[^\w\n]|_)*(?=\n)")
_COLON = re.compile(r":(?=\s|$)")
_WORD = re.compile(r"[a-z0-9]+")
_SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "https": "http"}


def tokens(text: str) -> list[str]:
    return [_SAME.get(w, w) for w in _WORD.findall(text.lower())]


def anchors(known: Iterable[list[str]]) -> list[str]:
    """Words, as texts spell them, of which every text with a known sentence holds one: they cover all sentences, long ones first."""
    left, chosen = [set(k) for k in known], []
    while left:
        count: dict[str, int] = {}
        for words in left:
            for w in words:
                count[w] = count.get(w, 0) + 1
        best = max(count, key=lambda w: (count[w] * len(w) ** 5, w))
        chosen.append(best)
        left = [words for words in left if best not in words]
    return [spelt for w in chosen for spelt in (w, *(k for k, v in _SAME.items() if v == w and w not in k))]


class Catalogue:
    """Known sentences as a trie over their normalised words, and the rules over their identifiers."""

    def __init__(self, sentences: Iterable[tuple[str, str]], rules: list[tuple[str, tuple[str, ...]]]):
        self.trie: dict = {}
        words = []
        for name, text in sentences:
            parts = [tokens(p) for p in text.split("<>")]
            if not any(parts):
                raise ValueError(f"a known sentence needs words: {name}")
            words.append([w for p in parts for w in p])
            node = self.trie
            for i, p in enumerate(parts):
                for w in ([None] if i else []) + p:
                    node = node.setdefault(w, {})
            node[""] = name
        self.anchors = anchors(words)
        self.rules = sorted(rules, key=lambda r: -len(r[1]))

    def may_hold(self, text: str) -> bool:
        """Whether a text can hold a known sentence; others need not be cut."""
        low = text.lower()
        return any(w in low for w in self.anchors)

    def ends(self, words: list[str], first: int, stops: set[int]) -> list[tuple[int, str]]:
        """(end, name) of the known sentences that begin at a word, the longest first. Blanks hold no sentence's end."""
        out, open_ = [], [(self.trie, first)]
        while open_:
            node, at = open_.pop()
            if "" in node:
                out.append((at, node[""]))
            if at < len(words) and words[at] in node:
                open_.append((node[words[at]], at + 1))
            if None in node:
                for n in range(1, min(MOST_BLANK, len(words) - at) + 1):
                    open_.append((node[None], at + n))
                    if at + n in stops:
                        break
        return sorted(set(out), reverse=True)

    def identify(self, text: str) -> list[str | None]:
        """The identifier of each sentence in order, None where it is unknown. An SPDX expression is a sentence for each licence."""
        text = plain_spdx(text)
        words: list[str] = []
        begins, ends, colons, lines = [], set(), set(), set()  # where lines and sentences begin, where these end
        start = 0
        for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
            for line in text[start:end].split("\n"):
                begins.append(len(words))
                first, *more = _COLON.split(line)
                words += tokens(first)
                for part in more:
                    colons.add(len(words))
                    words += tokens(part)
                lines.add(len(words))
            start = end
            ends.add(len(words))
        ends.discard(0)
        found = self._places(words, sorted(set(begins)), ends, colons, lines)
        out: list[str | None] = []
        done = 0  # a known sentence stands for the unfinished lines before it, too
        stops = sorted(ends)
        at = 0
        for first, last, name in found:
            while at < len(stops) and stops[at] <= first:
                if stops[at] > done:
                    out.append(None)
                at += 1
            out.append(name)
            done = last
        return out + [None] * sum(x > done for x in stops[at:])

    def _places(self, words: list[str], begins: list[int], ends: set[int], colons: set[int], lines: set[int]) -> list[tuple[int, int, str]]:
        """(first word, end, name) of the known sentences, in order, none within another.

        One ends where a sentence of the text ends, or where the next known one begins.
        """
        good: dict[int, tuple[int, str]] = {}
        named = set(begins) if None in self.trie else set()
        for first in range(len(words) - 1, -1, -1):
            if words[first] in self.trie or first in named:
                for last, name in self.ends(words, first, ends):
                    if last in ends or last in colons or last in good or name.startswith("spdx-") and last in lines:
                        good[first] = last, name
                        break
        out: list[tuple[int, int, str]] = []
        done = 0
        for first in begins:
            while first >= done and first in good:
                done, name = good[first]
                out.append((first, done, name))
                if done not in ends:
                    first = done
        return out

    def licences(self, names: list[str | None]) -> list[tuple[str, int, int, int]]:
        """(licence, number of its sentences, first, last sentence) of the rules that match, in order of place."""
        found = []
        for licence, rule in self.rules:
            for first in (i for i, n in enumerate(names) if n == rule[0]):
                at, ok = first, True
                for wanted in rule[1:]:
                    near = range(at + 1, min(len(names), at + 2 + GAP))
                    nxt = next((i for i in near if names[i] == wanted), None)
                    if nxt is None or any(names[i] is not None for i in range(at + 1, nxt)):
                        ok = False
                        break
                    at = nxt
                if ok:
                    found.append((licence, len(rule), first, at))
        taken, out = [], []
        for m in sorted(found, key=lambda m: (-m[1], m[2], m[0])):
            if all(m[3] < a or m[2] > z for a, z in taken):
                taken.append(m[2:])
                out.append(m)
        return sorted(out, key=lambda m: m[2])


def license_matches(docs: DataFrame, sentences: Iterable[tuple[str, str]] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """doc_id, license, n_sentences, first_sentence, last_sentence: a row per licence rule matched in a text.

    Sentences are numbered from 0. Null and empty texts match nothing; repeated rows are reported each, with their ids as
    they are, null ones too; a licence stated twice has two rows.
    """
    session(docs.sparkSession)
    sentences = list(catalogue_sentences() if sentences is None else sentences)
    rules = catalogue_rules() if rules is None else rules

    def work(lists):
        catalogue = Catalogue(sentences, rules)
        for texts in lists:
            rows = [(i, *m) for i, t in enumerate(texts) if t and catalogue.may_hold(t) for m in catalogue.licences(catalogue.identify(t))]
            names = ("place", "license", "n_sentences", "first_sentence", "last_sentence")
            columns = {n: [r[k] for r in rows] for k, n in enumerate(names)}
            yield columns["place"], columns

    return beside(docs.select("doc_id", "text"), work, "license string, n_sentences int, first_sentence int, last_sentence int")
