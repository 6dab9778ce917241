"""Licence texts in other spellings, and what is none."""

import re

from sightline.llm import licenses as li

SCHEMA = "doc_id long, text string, license string, digest string, whole string"


def test_found_and_not_found(spark):
    mit = "Copyright (c) 2019 Some Body\n\n" + li.TEXTS["MIT"].replace("sublicense", "sub-license").upper()
    rows = [(1, mit), (2, "Some prose.\n  licensed under the APACHE LICENCE version 2.0!\nMore prose."),
            (3, "Released under the MIT License."), (4, "We like the MIT License very much."), (5, None), (6, ""),
            (None, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
            (3, "Released under the MIT License."), (7, "Prose first.\n\n" + li.TEXTS["ISC"] + "\n\nProse after."),
            (8, "word license " * 50_000), (9, li.TEXTS["MIT"].replace("free of charge", "for a fee"))]
    # of the first text, the whole and its heading line are known
    got = li.licenses(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)).collect()
    assert sorted(((r.id, r.whole, list(r.licenses), r.n_matches) for r in got), key=repr) == sorted([
        (1, "MIT", ["MIT"], 2), (2, None, ["Apache-2.0"], 1), (3, "MIT", ["MIT"], 1), (4, None, [], 0), (5, None, [], 0),
        (6, None, [], 0), (None, None, ["CC-BY-NC-4.0", "GPL-3.0"], 2), (3, "MIT", ["MIT"], 1), (7, None, ["ISC"], 1),
        (8, None, [], 0), (9, None, ["MIT"], 1)], key=repr)


def test_every_known_text_has_a_trigger_and_one_licence(spark):
    known = li.known_digests(spark).collect()
    assert len({r.digest for r in known}) == len(known)
    texts = [g.format(n) for names in li.NAMES.values() for n in names for g in li.GRANTS] + list(li.TEXTS.values())
    assert all(any(t in x.lower() for t in li.TRIGGERS) for x in texts)


def test_names_in_any_punctuation(spark):
    """Every known name and grant with its blanks and marks replaced, and the hyphenated identifiers."""
    texts = [(i, g.format(n)) for i, names in li.NAMES.items() for n in names for g in li.GRANTS]
    rows = [(i, re.sub(r"[^\w]+", lambda m, b=b: b, x)) for i, x in texts for b in ("-", "  ", "\n", " * ", "_")]
    rows += [(i, g.format(i)) for i in li.NAMES if i.startswith("CC-BY") for g in li.GRANTS]
    docs = spark.createDataFrame([(k, x, i, "b", "c") for k, (i, x) in enumerate(rows)], SCHEMA)
    got = {r.id: r.whole for r in li.licenses(docs).collect()}
    assert [(i, x) for k, (i, x) in enumerate(rows) if got[k] != i] == []


BSD = """Copyright (c) 2019, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
OWNER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""


def test_entire_texts(spark):
    mit = li.TEXTS["MIT"].partition("\n\n")[2]
    wanted = {mit: "MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n" + mit: "MIT", BSD.format(""): "BSD-2-Clause",
              "BSD 2-Clause License\n\n" + BSD.format(""): "BSD-2-Clause", BSD.format(THIRD): "BSD-3-Clause",
              "BSD 3-Clause License\n\n" + BSD.format(THIRD): "BSD-3-Clause", li._UNLICENSE: "Unlicense", GPL: "GPL-3.0",
              GPL.replace("version 3", "version 2"): "GPL-2.0", li._MPL + "http://mozilla.org/MPL/2.0/.": "MPL-2.0",
              "My own terms:\ndo as you like.": "Own", "my OWN terms do as you like": "Own", "My own terms.": None}
    docs = spark.createDataFrame([(k, x, "a", "b", "c") for k, x in enumerate(wanted)], SCHEMA)
    known = spark.createDataFrame([("Own", "My own terms: do as you like")], "license string, text string")
    expected = list(wanted.values())
    assert [r.whole for r in sorted(li.licenses(docs, known=known).collect())] == expected
    assert [r.whole for r in sorted(li.licenses(docs).collect())] == [None if w == "Own" else w for w in expected]
    entire = li._entire()
    assert {i for i, _ in entire} == {*li.NAMES, "Zlib"}
    texts = spark.createDataFrame(entire, "license string, text string")
    assert texts.where(~li.may_be_known(texts.text)).count() == 0


def test_empty_table(spark):
    assert li.licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_identifiers_and_copyright_lines_without_a_year(spark):
    isc = li.TEXTS["ISC"].partition("\n\n")[2]
    wanted = {"SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "License: MIT": "MIT",
              "Licensed under MIT": "MIT", "Licensed under GPL-3.0": "GPL-3.0", "Licensed under the GPL-2": "GPL-2.0",
              "Released under BSD-3-Clause.": "BSD-3-Clause", "# SPDX-License-Identifier: (Apache-2.0)": "Apache-2.0", "MIT license": "MIT",
              "Copyright Jane Doe\n\n" + isc: "ISC", "Copyright by Jane van Doe\n\n" + isc: None, "Copyright J. Doe and Some Corp.\n" + isc: "ISC",
              "Copyright is a matter of law\n" + isc: None, "Copyright Holders And Contributors\n" + isc: None,
              "SPDX-License-Identifier: Something-1.0": None, "MIT": None}
    docs = spark.createDataFrame([(k, x, "a", "b", "c") for k, x in enumerate(wanted)], SCHEMA)
    got = [r.whole for r in sorted(li.licenses(docs).collect())]
    assert [(x, w, g) for (x, w), g in zip(wanted.items(), got) if w != g] == []


def test_equals_digests_in_plain_python(spark):
    """Every unit of some texts made canonical by other means and looked up in a dictionary."""
    import hashlib

    def plain(text):
        lines = [x for x in text.split("\n") if not re.match(r"\s*copyright \(c\)", x, re.I)]
        words = " ".join(re.findall(r"[^\W_]+", "\n".join(lines).lower()))
        for other, one in li.SPELLINGS.items():
            words = words.replace(other, one)
        return hashlib.sha256(words.encode()).hexdigest()

    known = {r.digest: r.license for r in li.known_digests(spark).collect()}
    texts = [f"Intro {i}.\n\nCopyright (c) 20{i:02d} X\n{t}\n\nReleased under {n}.\nLast line" for i, (t, n) in enumerate(
        (li.TEXTS[t], n) for t in li.TEXTS for n in ("the MIT Licence", "CC-BY-SA 4.0", "nothing at all", "GPLv3"))]
    texts += list(li.TEXTS.values())
    docs = spark.createDataFrame([(k, x, "a", "b", "c") for k, x in enumerate(texts)], SCHEMA)
    for r in li.licenses(docs).collect():
        text = texts[r.id]
        units = {text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")}
        hits = {d: known[d] for d in map(plain, units) if d in known}
        assert (r.whole, list(r.licenses), r.n_matches) == (known.get(plain(text)), sorted(set(hits.values())), len(hits))
