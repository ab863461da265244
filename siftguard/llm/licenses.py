"""Licence scans: documents compared to licence notices and texts by Dice over word bigrams.

Built-in functions only. ``scan_licenses`` compares single lines with the notices whose size
allows the required coefficient. ``scan_texts`` takes a document as one sequence of words, so
that wrapped texts and notices within paragraphs are found. Before either, a document (and a
line) must hold one of a few words, chosen so that no text without any of them can reach the
coefficient with any notice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftguard.session import materialize, spread

# Notices by licence; fixed values, given as they are worded in practice.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.",),
}

# Licence texts and headings that scan_texts compares besides the notices, numbered after them.
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder "
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "GPL-2.0": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
}


def _words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised notice."""
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _templates(notices: dict[str, tuple[str, ...]]) -> list[tuple[str, int, list[str]]]:
    return [(name, i, bigrams(text)) for name, texts in notices.items() for i, text in enumerate(texts) if bigrams(text)]


def anchors(templates: list[tuple[str, int, list[str]]], num: int, den: int) -> list[str]:
    """Words of which any text that reaches num / den with a notice has at least one.

    Such a text shares at least num / (2 den - num) of the notice's bigrams. Words are taken,
    longest first, until the bigrams without any of them are fewer than that.
    """
    chosen: set[str] = set()
    for _, _, grams in templates:
        words = sorted({w for g in grams for w in g.split()}, reverse=True)
        words.sort(key=lambda w: (w not in chosen, -len(w)))
        for word in [None, *words]:
            if word:
                chosen.add(word)
            free = sum(not chosen & set(g.split()) for g in grams)
            if free * (2 * den - num) < num * len(grams):
                break
    return sorted(chosen)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan_licenses(
    docs: DataFrame, notices: dict[str, tuple[str, ...]] = NOTICES, num: int = 4, den: int = 5
) -> DataFrame:
    """Lines that match a licence notice with a Dice coefficient of at least num / den.

    Returns doc_id, line (from 1), license, notice (its number among the licence's), n_bigrams
    of the line, n_shared and dice, one row per line and matching notice. Text is normalised:
    A-Z lower-cased, all but ASCII letters and digits taken as spaces; bigrams count once. Null
    and empty texts and lines of fewer than two words match nothing; repeated rows and ids
    give rows each; a null id is returned as it is; other columns are ignored.
    """
    templates = _templates(notices)
    if not templates:
        templates = [("", 0, [])]
    # One pass over the text; the words are tried where a word begins. ASCII case only.
    holds = f"(?i)(?<![a-z0-9])(?:{'|'.join(anchors(templates, num, den)) or '(?!)'})(?![a-z0-9])"
    words = F.split(F.trim(F.regexp_replace(_lower(F.col("raw")), "[^a-z0-9]+", " ")), " ")
    lines = (
        spread(docs.select("doc_id", "text")).filter(F.col("text").rlike(holds))
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).filter(F.col("raw").rlike(holds))
        .select("doc_id", (F.col("at") + 1).alias("line"), words.alias("words")).filter(F.size("words") >= 2)
    )
    pairs = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda i: F.concat(F.element_at("words", i), F.lit(" "), F.element_at("words", i + 1)),
    ))
    known = F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(i).alias("notice"), F.array(*map(F.lit, grams)).alias("grams"))
        for name, i, grams in templates
    ])
    # Dice is at most twice the smaller size over the sum of sizes.
    fits = lambda t: (2 * den * F.least(F.size(t["grams"]), F.size("grams")) >= num * (F.size(t["grams"]) + F.size("grams")))
    opened = lines.select("doc_id", "line", pairs.alias("grams")).select(
        "doc_id", "line", "grams", F.explode(F.filter(known, fits)).alias("t")
    )
    shared = F.size(F.array_intersect("grams", "t.grams"))
    total = F.size("grams") + F.size("t.grams")
    return opened.select(
        "doc_id", "line", F.col("t.license").alias("license"), F.col("t.notice").alias("notice"),
        F.size("grams").alias("n_bigrams"), shared.alias("n_shared"), (2 * shared / total).alias("dice"),
        (2 * den * shared >= num * total).alias("matches"),
    ).filter("matches").drop("matches")


def with_texts(notices: dict[str, tuple[str, ...]] = NOTICES, texts: dict[str, tuple[str, ...]] = TEXTS) -> dict[str, tuple[str, ...]]:
    """Notices and, numbered after them, texts of each licence."""
    return {name: notices.get(name, ()) + texts.get(name, ()) for name in [*notices, *(t for t in texts if t not in notices)]}


def scan_texts(
    docs: DataFrame, notices: dict[str, tuple[str, ...]] | None = None, num: int = 4, den: int = 5
) -> DataFrame:
    """Passages of whole texts that match a notice or licence text with Dice of at least num / den.

    A text is one sequence of words across its lines, normalised as in ``scan_licenses``. All
    windows that begin and end with a bigram of the notice (others only lower the coefficient)
    and have at most (2 den - num) / num times its words are compared by their distinct bigrams.
    Matching windows of a notice that share a bigram's place are one passage, of which the best
    window is returned, among equals the first, then the shortest: doc_id, line (of its first
    word, from 1), word (its place in the text, from 1), n_words, license, notice, n_bigrams,
    n_shared and dice. Without ``notices`` NOTICES and TEXTS are compared. Null and empty texts
    match nothing; repeated rows and ids give rows each; other columns are ignored.
    """
    notices = with_texts() if notices is None else notices
    templates = _templates(notices)
    if not templates:
        templates = [("", 0, [])]
    holds = f"(?i)(?<![a-z0-9])(?:{'|'.join(anchors(templates, num, den)) or '(?!)'})(?![a-z0-9])"
    known = F.array(*[
        F.struct(
            F.lit(name).alias("license"), F.lit(i).alias("notice"), F.array(*map(F.lit, grams)).cast("array<string>").alias("grams"),
            F.lit(-(-num * len(grams) // (2 * den - num))).alias("least"),
            # Places of bigrams in the longest window.
            F.lit((2 * den - num) * len(_words(notices[name][i] if name else "")) // num - 1).alias("most"),
        )
        for name, i, grams in templates
    ])
    every = F.array(*[F.lit(g) for g in sorted({g for _, _, grams in templates for g in grams})]).cast("array<string>")
    split = lambda raw: F.filter(
        F.split(F.regexp_replace(_lower(raw), "[^a-z0-9]+", " "), " "), lambda x: x != ""
    )
    by_line = (
        spread(docs.select("doc_id", "text")).filter(F.col("text").rlike(holds))
        .select("doc_id", F.transform(F.split("text", "\n"), split).alias("by_line"))
        .select("doc_id", F.transform("by_line", F.size).alias("counts"), F.flatten("by_line").alias("words"))
        .filter(F.size("words") >= 2)
    )
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda i: F.concat(F.element_at("words", i), F.lit(" "), F.element_at("words", i + 1)),
    )
    # A window shares at least num / (2 den - num) of a notice's bigrams; most texts do not as a whole.
    shares = lambda t: (F.size(t["grams"]) > 0) & (F.size(F.array_intersect("some", t["grams"])) >= t["least"])
    texts = materialize(
        by_line.select(F.monotonically_increasing_id().alias("row"), "doc_id", "counts", pairs.alias("all")), "licence-texts"
    )
    of = ["row", "license", "notice"]
    opened = (
        texts.select("row", F.array_intersect("all", every).alias("some"))
        .select("row", F.explode(F.filter(known, shares)).alias("t")).select("row", "t.license", "t.notice", "t.grams", "t.most")
    )
    # Of equal bigrams a window counts the one whose last occurrence lies before the window.
    again = Window.partitionBy("row", "gram").orderBy("at")
    places = texts.select("row", F.posexplode("all").alias("i", "gram")).select("row", "gram", (F.col("i") + 1).alias("at"))
    places = places.withColumn("before", F.coalesce(F.lag("at").over(again), F.lit(0)))
    marked = places.join(opened, "row").select(
        *of, "at", "before", F.array_contains("grams", F.col("gram")).alias("hit"), F.size("grams").alias("size"), "most"
    )
    # Every place with what follows it, as far as the longest window reaches.
    longest = max([1, *((2 * den - num) * len(_words(notices[name][i] if name else "")) // num - 1 for name, i, _ in templates)])
    along = Window.partitionBy(*of).orderBy("at")
    ahead = F.collect_list(F.struct("at", "before", "hit")).over(along.rowsBetween(0, longest - 1))
    starts = marked.withColumn("ahead", ahead).filter("hit").withColumn("ahead", F.slice("ahead", F.lit(1), F.col("most")))
    size = F.col("size")
    nothing = F.struct(
        *[F.lit(0).alias(c) for c in ("n", "shared", "end", "last", "best_n", "best_shared")], F.lit(0.0).alias("dice")
    )

    def further(done: Column, x: Column) -> Column:
        """One place more in the window: its counts, the last match, and the best one."""
        new = x["before"] < F.col("at")
        n, shared = done["n"] + new.cast("int"), done["shared"] + (new & x["hit"]).cast("int")
        meets = x["hit"] & (2 * den * shared >= num * (n + size))
        dice = 2 * shared / (n + size)
        better = meets & (dice > done["dice"])
        pick = lambda a, b: F.when(better, a).otherwise(b)
        return F.struct(
            n.alias("n"), shared.alias("shared"), F.when(meets, x["at"]).otherwise(done["end"]).alias("end"),
            pick(x["at"], done["last"]).alias("last"), pick(n, done["best_n"]).alias("best_n"),
            pick(shared, done["best_shared"]).alias("best_shared"), pick(dice, done["dice"]).alias("dice"),
        )

    windows = starts.select(*of, "at", F.aggregate("ahead", nothing, further).alias("w")).filter("w.end > 0")
    # Windows that share a place are one passage.
    reached = F.max("w.end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = windows.withColumn("fresh", F.coalesce(F.col("at") > reached, F.lit(True)).cast("int"))
    passages = fresh.withColumn("passage", F.sum("fresh").over(along)).groupBy(*of, "passage").agg(F.min(F.struct(
        (-F.col("w.dice")).alias("d"), F.col("at").alias("first"), F.col("w.last").alias("last"), F.col("w.best_n").alias("n"),
        F.col("w.best_shared").alias("shared"),
    )).alias("best"))
    best = F.col("best")
    line = F.aggregate(
        "counts", F.struct(F.lit(0).alias("seen"), F.lit(0).alias("line")),
        lambda done, n: F.when(
            done["seen"] < F.col("best.first"), F.struct((done["seen"] + n).alias("seen"), (done["line"] + 1).alias("line"))
        ).otherwise(done),
    )["line"]
    return passages.join(texts.select("row", "doc_id", "counts"), "row").select(
        "doc_id", line.alias("line"), best["first"].alias("word"), (best["last"] - best["first"] + 2).alias("n_words"),
        "license", "notice", best["n"].alias("n_bigrams"), best["shared"].alias("n_shared"), (-best["d"]).alias("dice"),
    )


def scan_sql(notices: dict[str, tuple[str, ...]] = NOTICES, num: int = 4, den: int = 5) -> str:
    """DuckDB twin of scan_licenses on documents."""
    rows = ", ".join(
        "('{}', {}, [{}])".format(name, i, ", ".join(f"'{g}'" for g in grams)) for name, i, grams in _templates(notices)
    )
    return rf"""
WITH t(license, notice, tg) AS (VALUES {rows}),
s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS line, [x FOR x IN regexp_split_to_array(
        translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') IF x <> ''] AS ws
      FROM s, unnest(range(1, len(ls) + 1)) r(i)),
g AS (SELECT doc_id, line, list_distinct([ws[j] || ' ' || ws[j + 1] FOR j IN range(1, len(ws))]) AS lg
      FROM l WHERE len(ws) >= 2),
m AS (SELECT doc_id, line, license, notice, len(lg) AS a, len(tg) AS b, len(list_intersect(lg, tg)) AS c FROM g, t)
SELECT doc_id, CAST(line AS INTEGER) AS line, license, notice, CAST(a AS INTEGER) AS n_bigrams, CAST(c AS INTEGER) AS n_shared,
       2 * c / (a + b) AS dice
FROM m WHERE 2 * {den} * c >= {num} * (a + b)
"""
