"""Licence texts by canonical digest, in DataFrame functions only.

A text is made canonical - copyright lines dropped, lower case, punctuation made single blanks, equivalent spellings made
one - and its SHA-256 is hash-joined to the digests of known licence texts, made canonical the same way. The units
compared in full are the whole document, its blocks between blank lines, and its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import col, keyed

# Licence names by identifier, sentences that grant them, full texts of short licences, spellings.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License"],
    "MIT": ["MIT License", "MIT Licence"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GPLv2", "GNU GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GPLv3", "GNU GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "Unlicense": ["Unlicense"],
}
GRANTS = ["Licensed under {}", "Licensed under the {}", "Released under the {}", "Released under {}",
          "This work is licensed under the {}", "This work is licensed under {}", "This work is licensed under a {}",
          "This software is licensed under the {}", "This project is licensed under the {}",
          "Distributed under the {}", "Available under the {}", "License: {}", "{}"]
TAGS = ["SPDX-License-Identifier: {}", "SPDX-License-Identifier: ({})", "The {} license", "{} license", "{} licensed"]
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
}
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS "
        "PROVIDED BY THE {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {} BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_BY = [("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"),
           ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"),
           ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("AUTHORS AND CONTRIBUTORS", "AUTHORS OR CONTRIBUTORS")]
_BSD_THIRD = ["Neither the name of the {} nor the names of {}contributors may be used to endorse or promote products derived from this "
              "software without specific prior written permission. ".format(*x)
              for x in [("copyright holder", "its "), ("copyright holders", "its "), ("copyright holders", "their "),
                        ("author", "its "), ("author", ""), ("authors", "their ")]]
_BSD_THIRD.append("The name of the author may not be used to endorse or promote products derived from this software without specific "
                  "prior written permission. ")
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GNU = ("This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by "
        "the Free Software Foundation{version}. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more "
        "details.{end}")
_GNU_ENDS = ["", " You should have received a copy of the GNU {kind} along with this {what}. If not, see <http://www.gnu.org/licenses/>."]
_GNU_ENDS += [" You should have received a copy of the GNU {kind} along with this {what}; if not, write to the Free Software Foundation, "
              "Inc., " + place for place in ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, "
                                             "Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")]
_GNU_KINDS = [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
              ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
              ("AGPL-3.0", "Affero General Public License", "3")]
_MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at ")
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {}"
_CC0 = ("To the extent possible under law, the {} associated CC0 with this work {} waived all copyright and related or neighboring "
        "rights to this work.")
_CC = [("CC-BY-4.0", "Attribution", "by"), ("CC-BY-SA-4.0", "Attribution-ShareAlike", "by-sa"),
       ("CC-BY-NC-4.0", "Attribution-NonCommercial", "by-nc"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives", "by-nd")]


def _entire() -> list[tuple[str, str]]:
    """Identifier and text of every short licence and notice in its usual variants, each with and without a heading."""
    mit, isc = TEXTS["MIT"].partition("\n\n")[2], TEXTS["ISC"].partition("\n\n")[2]
    bodies = [("MIT", mit), ("MIT", mit.replace("permission notice shall", "permission notice (including the next paragraph) shall")),
              ("ISC", isc), ("ISC", isc.replace("and/or distribute", "and distribute")), ("Zlib", TEXTS["Zlib"]),
              ("Apache-2.0", TEXTS["Apache-2.0"]), ("Unlicense", _UNLICENSE),
              ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
              ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org>")]
    for by in _BSD_BY:
        for one, two, three in (("1. ", "2. ", "3. "), ("(1) ", "(2) ", "(3) "), ("a. ", "b. ", "c. "), ("* ", "* ", "* ")):
            bodies.append(("BSD-2-Clause", _BSD.format(one, two, "", *by)))
            bodies += [("BSD-3-Clause", _BSD.format(one, two, three + x, *by)) for x in _BSD_THIRD]
    for i, kind, number in _GNU_KINDS:
        for what in ("program", "library", "software", "file"):
            for version in (f", either version {number} of the License, or (at your option) any later version", f", version {number} of "
                            "the License", f"; either version {number} of the License, or (at your option) any later version",
                            f"; version {number} of the License", f"; version {number}"):
                bodies += [(i, _GNU.format(what=what, colon=":", kind=kind, version=version, end=e.format(what=what, kind=kind)))
                           for e in _GNU_ENDS]
    bodies += [("MPL-2.0", _MPL + x) for x in ("https://mozilla.org/MPL/2.0/.", "https://www.mozilla.org/MPL/2.0/.")]
    bodies += [("EPL-2.0", _EPL.format(v) + x + "https://www.eclipse.org/legal/epl-2.0" + y)
               for v in ("2.0", "v2.0", "v. 2.0") for x in (" which is available at ", ", which is available at ", " which accompanies this "
               "distribution, and is available at ") for y in ("/", "/ SPDX-License-Identifier: EPL-2.0")]
    bodies += [("CC0-1.0", _CC0.format(*who) + x) for who in (("person who", "has"), ("author(s)", "have")) for x in (
        "", " You should have received a copy of the CC0 legalcode along with this work. If not, see "
        "<http://creativecommons.org/publicdomain/zero/1.0/>.")]
    bodies += [(i, f"This work is licensed under {a} Creative Commons {name} 4.0 International License. To view a copy of this license, "
                f"visit http://creativecommons.org/licenses/{path}/4.0/{x}") for i, name, path in _CC for a in ("the", "a") for x in (
                    "", " or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.")]
    names = {**NAMES, "Zlib": ["zlib License"], "Unlicense": ["Unlicense"]}
    out = []
    for i, body in bodies:
        short = i.removesuffix("-Clause").replace("-", " ")
        for name in [*names[i], i]:
            out += [(i, f"{head}\n\n{body}") for head in (name, f"The {name}", f"{name} ({short})", f"The {name} ({short})")]
        out.append((i, body))
    return out


SPELLINGS = {"licence": "license", "sub license": "sublicense", "organisation": "organization", "favour": "favor",
             "acknowledgement": "acknowledgment", "non commercial": "noncommercial", "merchantibility": "merchantability",
             "copyright owner": "copyright holder", "https": "http", "per cent": "percent", "fulfilment": "fulfillment",
             "share alike": "sharealike", "no derivatives": "noderivatives", "non infringement": "noninfringement"}
# a line that names whose the copyright is: with a year or sign, or nothing but capitalised names behind the word
_NAME = r"(?-i:[A-ZÀ-Þ][\p{L}\d.'’-]*)"
COPYRIGHT_LINE = (r"(?im)^[ \t]*(copyright\b(?=.*(\d{4}|\(c\)|©))|\(c\)|©|all rights reserved|copyright(?: by)? (?!(?:the )?(?:holder|notice|"
                  r"owner|law|statement|act|licen[cs])s?\b)(?-i:[A-ZÀ-Þ](?:[\p{L}'’-]*\p{Ll}[\p{L}'’-]*|\.))(?:,? (?:and |& )?" + _NAME
                  + r"){0,5}[.,]?[ \t\r]*$)[^\n]*$")
# every canonical text has one of these, so a unit without any, however spelled, needs no digest
TRIGGERS = ("licen", "gpl", "cc by", "cc0", "mpl", "permission", "permitted", "public domain", "released under", "distributed under",
            "available under")
BETWEEN = r"[^\p{L}\p{N}]+"  # what a blank of a canonical text may have been


def canonical(text: Column) -> Column:
    text = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    text = F.trim(F.regexp_replace(text, BETWEEN, " "))
    for other, one in SPELLINGS.items():  # of whatever marks and line breaks their words had between them
        text = F.replace(text, F.lit(other), F.lit(one))
    return text


def may_be_known(unit: Column) -> Column:
    """Whether the canonical text can hold a trigger, told from the text as it is."""
    low = F.lower(unit)
    return F.greatest(*[low.rlike(t.replace(" ", BETWEEN)) if " " in t else F.contains(low, F.lit(t)) for t in TRIGGERS])


def _identifiers(i: str) -> list[str]:
    """An identifier as files and manifests have it."""
    short = [i.removesuffix(".0")] if i.startswith(("GPL", "LGPL", "AGPL")) else []
    return [x + end for x in (i, *short) for end in (("", "-only", "-or-later", "+") if "GPL" in i else ("",))]


def known_digests(spark: SparkSession) -> DataFrame:
    """license, digest: a fixed small table, built from names, identifiers and grants by rule, and from the full texts."""
    rows = [(i, g.format(n)) for i, names in NAMES.items() for n in names for g in GRANTS] + list(TEXTS.items()) + _entire()
    rows += [(i, g.format(x)) for i in [*NAMES, "Zlib"] for x in _identifiers(i) for g in [*GRANTS[:-1], *TAGS]]
    return _digests(spark.createDataFrame(rows, "license string, text string"))


def _digests(texts: DataFrame) -> DataFrame:
    return texts.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             known: DataFrame | None = None) -> DataFrame:
    """id, whole, licenses, n_matches: one row per row of ``docs``.

    ``whole`` is the licence that the entire text is (null: none), ``licenses`` the sorted distinct licences of the text,
    its blocks or its lines, ``n_matches`` the number of distinct units found. Null and empty texts have none. Repeated
    rows share their result. An empty table gives no rows. ``known`` (license, text) adds texts to the fixed table.
    """
    own, keys = keyed(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")), "id", "text")
    # the units are exploded one list after the other, so a text is never copied more than once per list
    lists = [F.array("text"), F.split("text", r"\n[ \t\r]*\n", -1), F.split("text", "\n", -1)]
    found = None
    for k, units in enumerate(lists):
        part = own.select(*keys, F.explode(units).alias("unit"))
        if known is None:  # given texts need not have any trigger
            part = part.where(may_be_known(F.col("unit")))
        part = part.select(*keys, F.sha2(canonical(F.col("unit")), 256).alias("digest"), F.lit(k == 0).alias("is_whole"))
        found = part if found is None else found.unionByName(part)
    table = F.broadcast(known_digests(docs.sparkSession))
    if known is not None:  # of any size, so the planner picks the join
        table = known_digests(docs.sparkSession).unionByName(_digests(known.select("license", "text"))).distinct()
    hits = (found.join(table, "digest").groupBy(*keys)
            .agg(F.min(F.when(F.col("is_whole"), F.col("license"))).alias("whole"),
                 F.array_sort(F.collect_set("license")).alias("licenses"), F.count_distinct("digest").alias("n_matches")))
    return own.select("id", *keys).join(hits, keys, "left").select(
        "id", "whole", F.coalesce("licenses", F.expr("array()").cast("array<string>")).alias("licenses"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))
