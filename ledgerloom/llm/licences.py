"""Licence recognition by sentence rules.

Sentences are levelled and looked up in a table of licence sentences; the identifiers found stand for the text, in its
order. Rules are runs of identifiers, tried in turn; a run that matches is used up.
"""

from __future__ import annotations

from itertools import chain

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and their identifiers.
SENTENCES = {
    "MITname": ["Released under the MIT License.", "This project is licensed under the MIT License.",
                "Licensed under the MIT License.", "The MIT License (MIT)", "MIT License",
                "SPDX-License-Identifier: MIT"],
    "MITgrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions:"],
    "MITnotice": ["The above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the Software."],
    "MITwarranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
                    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                    "NONINFRINGEMENT."],
    "MITliability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
                     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "APACHE2name": ["Licensed under the Apache License, Version 2.0.", "Apache License, Version 2.0",
                    "SPDX-License-Identifier: Apache-2.0",
                    "Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "APACHE2only": ["you may not use this file except in compliance with the License."],
    "APACHE2copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "APACHE2warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the "
                        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                        "either express or implied."],
    "APACHE2see": ["See the License for the specific language governing permissions and limitations under the License."],
    "GPL3name": ["This work is licensed under the GNU General Public License, version 3.",
                 "SPDX-License-Identifier: GPL-3.0-only", "Licensed under the GNU General Public License, version 3."],
    "GPL2name": ["This work is licensed under the GNU General Public License, version 2.",
                 "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU General Public License, version 2."],
    "GPLfree3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."],
    "GPLfree2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation; either version 2 of the "
                 "License, or (at your option) any later version."],
    "GPLhope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "GPLsee": ["See the GNU General Public License for more details."],
    "MPL2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
             "SPDX-License-Identifier: MPL-2.0"],
    "MPL2copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at "
                 "https://mozilla.org/MPL/2.0/."],
    "BSDredist": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met:"],
    "BSDsource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and "
                  "the following disclaimer."],
    "BSDbinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                  "and the following disclaimer in the documentation and/or other materials provided with the "
                  "distribution."],
    "BSDendorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                   "or promote products derived from this software without specific prior written permission."],
    "ISCgrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                 "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
                 "copies."],
    "CCBYNC4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CCBYSA4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CCBY4": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain."],
    "RESERVED": ["All rights reserved."],
}
#: Rules in the order they are tried, longer runs first: identifiers in a row, licence.
RULES = [
    (["MITgrant", "MITnotice", "MITwarranty", "MITliability"], "MIT"),
    (["APACHE2name", "APACHE2only", "APACHE2copy", "APACHE2warranty", "APACHE2see"], "Apache-2.0"),
    (["BSDredist", "BSDsource", "BSDbinary", "BSDendorse"], "BSD-3-Clause"),
    (["BSDredist", "BSDsource", "BSDbinary"], "BSD-2-Clause"),
    (["GPLfree3", "GPLhope", "GPLsee"], "GPL-3.0-or-later"),
    (["GPLfree2", "GPLhope", "GPLsee"], "GPL-2.0-or-later"),
    (["MPL2", "MPL2copy"], "MPL-2.0"),
    (["ISCgrant"], "ISC"),
    (["GPLfree3"], "GPL-3.0-or-later"),
    (["GPLfree2"], "GPL-2.0-or-later"),
    (["GPL3name"], "GPL-3.0"),
    (["GPL2name"], "GPL-2.0"),
    (["APACHE2name"], "Apache-2.0"),
    (["MITname"], "MIT"),
    (["MPL2"], "MPL-2.0"),
    (["CCBYNC4"], "CC-BY-NC-4.0"),
    (["CCBYSA4"], "CC-BY-SA-4.0"),
    (["CCBY4"], "CC-BY-4.0"),
    (["CC0"], "CC0-1.0"),
    (["UNLICENSE"], "Unlicense"),
]
#: A sentence ends at a line's end, or after one of these marks and blanks.
MARK = r"([.!?])[ \t]+"
#: A blank line; it ends a sentence where lines are joined.
GAP = r"\n([ \t\r]*\n)+"
LEVEL = r"[^\p{L}\p{N}]+"


def _level_text(sentence: str) -> str:
    return regex.sub(LEVEL, " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Levelled sentence: identifier. Of a sentence with marks inside, the longest part stands for it."""
    out: dict[str, str] = {}
    for name, texts in SENTENCES.items():
        for text in texts:
            parts = regex.sub(MARK, "\\1\n", text).split("\n")
            out[max(map(_level_text, parts), key=len)] = name
    return out


def _sentences(text: Column) -> Column:
    """Levelled, non-empty sentences of a text."""
    parts = F.split(F.regexp_replace(text, MARK, "$1\n"), "\n")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), LEVEL, " "))), lambda s: s != "")


def _unwrapped(text: Column) -> Column:
    """Each paragraph as one line."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, GAP, "\x01"), r"[ \t\r\n]+", " "), F.lit("\x01"), F.lit("\n"))


def _identifiers(sentences: Column, table: Column) -> Column:
    return F.filter(F.transform(sentences, lambda s: F.try_element_at(table, s)), lambda i: i.isNotNull())


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, licences, unmatched for every row of docs (doc_id, text).

    Sentences are read line by line and with lines joined, for texts with wrapped lines; the reading with more known
    sentences counts (the first if equal). n_sentences counts lines' sentences. licences names what the rules found, in their order and each once, joined by commas; unmatched counts identifiers
    that no rule used. Identifiers are in a row if no other identifier is between them; unknown sentences may be.
    A text without a known sentence has no licences; a null or empty text has no sentences. Repeated rows give repeated
    results, other columns are ignored, an empty table gives no rows. Nothing is shuffled.
    """
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known_sentences().items())])
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", _sentences(text).alias("sentences"),
                       _sentences(_unwrapped(text)).alias("unwrapped"))
    rows = rows.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"),
                       _identifiers(F.col("sentences"), table).alias("by_line"),
                       _identifiers(F.col("unwrapped"), table).alias("joined"))
    rows = rows.withColumn("ids", F.when(F.size("joined") > F.size("by_line"), F.col("joined")).otherwise(
        F.col("by_line")))
    rows = rows.withColumn("run", F.concat(F.lit(" "), F.array_join(F.transform(
        "ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), " "), F.lit(" ")))
    run, names = F.col("run"), []
    for i, (ids, licence) in enumerate(RULES):
        wanted = " ".join(f"<{x}>" for x in ids)
        rows = rows.withColumn(f"hit{i}", F.contains(run, F.lit(f" {wanted} ")))
        rows = rows.withColumn("run", F.when(F.col(f"hit{i}"), F.replace(run, F.lit(wanted), F.lit("|"))).otherwise(run))
        names.append(F.when(F.col(f"hit{i}"), F.lit(licence)))
    found = F.array_distinct(F.array_compact(F.array(*names)))
    return rows.select(
        "doc_id", "n_sentences", F.size("ids").cast("bigint").alias("n_known"),
        F.array_join(found, ",").alias("licences"),
        F.size(F.filter(F.split("run", " "), lambda x: F.startswith(x, F.lit("<")))).cast("bigint").alias("unmatched"))
