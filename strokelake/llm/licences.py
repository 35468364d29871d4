"""Licence scan: normalised passages against licence templates by Dice coefficient over word bigrams.

Each whole text, line and sentence is a passage, and so is each run of consecutive lines or sentences outside the passages that
match by themselves, so that a wrapped or several-sentence notice inside a larger text is compared whole. A template is only compared with passages whose number of bigrams lies within
the bounds that the threshold leaves open, and only texts that hold a word without which no template can be reached are taken
apart at all; neither bound loses a match.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts and notices, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


#: Words that are too common to tell a licence by.
COMMON = frozenset("a an and any as at be by can for from in is it its may not of on or that the this to under with you".split())


def template_words(text: str) -> list[str]:
    """Lower-case runs of a-z and 0-9."""
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams that a passage can have if its Dice coefficient with n bigrams is to reach the threshold."""
    ratio = threshold / (2 - threshold)
    return math.ceil(n * ratio - 1e-9), math.floor(n / ratio + 1e-9)


def required_words(templates: dict[str, tuple[str, ...]], threshold: float) -> list[str]:
    """Words of which every passage that reaches a template holds one, rare-looking words first.

    A match needs more than a fixed number of the template's bigrams; words are added until the bigrams without any of them
    are fewer than that.
    """
    chosen: list[str] = []
    for text in (t for texts in templates.values() for t in texts):
        grams = template_bigrams(text)
        need = size_bounds(len(grams), threshold)[0]
        free = [g for g in grams if not set(g.split()) & set(chosen)]
        while len(free) >= need:
            best = max({w for g in free for w in g.split()}, key=lambda w: (w not in COMMON and not w.isdigit(), sum(w in g.split() for g in free) * (len(w) - 1), w))
            chosen.append(best)
            free = [g for g in free if best not in g.split()]
    return sorted(set(chosen))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grams(words: Column) -> Column:
    """Bigrams of two words or more, in order."""
    n = F.size(words)
    return F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def _sums(counts: Column) -> Column:
    """0 and the running sums of an array."""
    return F.aggregate(counts, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _firsts(grams: Column) -> Column:
    """For each bigram 1 if it stands nowhere before, else 0."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    marked = _let(placed, lambda p: F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), F.when((k > 0) & (F.get(p, k - 1)["g"] == x["g"]), 0).otherwise(1).alias("new"))))
    return F.transform(F.sort_array(marked), lambda x: x["new"])


def _runs(units: Column, threshold: float, templates: dict[str, tuple[str, ...]]) -> Column:
    """``array<struct<minus, name>>``: matching runs of two units or more, from ``array<struct<words, free>>``; native.

    Runs hold free units only. For a template, a run starts at a unit with bigrams of it, since others only lower the
    coefficient; of the ends of a start the best one counts, and of runs that overlap, whatever their templates, the best one.
    Ends are left out where fewer bigrams of the template, or more distinct bigrams, lie between than a match can have.
    """
    listed = [(name, template_bigrams(text)) for name, texts in sorted(templates.items()) for text in texts]
    bounds = [size_bounds(len(mine), threshold) for _, mine in listed]
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, mine)).alias("mine"), F.lit(low).alias("low"), F.lit(high).alias("high")) for (name, mine), (low, high) in zip(listed, bounds)])
    nothing = F.lit(None).cast("struct<minus:double,name:string,first:int,last:int>")

    def of_template(t: Column, u: Column, grams: Column, at: Column, news: Column) -> Column:
        """The best run of each start; ``at`` holds the places of the units' first words, ``news`` the first occurrences in each unit."""
        last = F.size(u) - 1

        def of_hits(hits: Column) -> Column:
            def of_start(i: Column) -> Column:
                def step(state: Column, j: Column) -> Column:
                    # A unit's last bigram leads into the next unit, so hits may count one too many, and one is taken off the new ones.
                    many, fresh, n = state["hits"] + F.get(hits, j), state["fresh"] + F.get(news, j), F.get(at, j + 1) - F.get(at, i) - 1
                    stop = state["stop"] | ~F.get(u, j)["free"] | (fresh - 1 > t["high"]) | (state["best"].isNotNull() & (n > t["high"]))

                    def measured(part: Column) -> Column:
                        dice = 2.0 * F.size(F.array_intersect(part, t["mine"])) / (F.size(F.array_distinct(part)) + F.size(t["mine"]))
                        run = lambda d: F.struct((-d).alias("minus"), t["name"].alias("name"), i.alias("first"), j.alias("last"))
                        return _let(dice, lambda d: F.when((d >= threshold) & (state["best"].isNull() | (-d < state["best"]["minus"])), run(d)).otherwise(state["best"]))

                    best = F.when(~stop & (j > i) & (many >= t["low"]), _let(F.slice(grams, F.get(at, i) + 1, n), measured)).otherwise(state["best"])
                    return F.struct(best.alias("best"), stop.alias("stop"), many.alias("hits"), fresh.alias("fresh"))

                start = F.struct(nothing.alias("best"), F.lit(False).alias("stop"), F.lit(0).alias("hits"), F.lit(0).alias("fresh"))
                return F.aggregate(F.sequence(i, last), start, step, lambda x: x["best"])

            starts = F.filter(F.sequence(F.lit(0), last - 1), lambda i: F.get(u, i)["free"] & (F.get(hits, i) > 0))
            return F.filter(F.transform(starts, of_start), lambda x: x.isNotNull())

        inside = lambda x, k: F.size(F.filter(F.slice(grams, F.get(at, k) + 1, F.size(x["words"])), lambda g: F.array_contains(t["mine"], g)))
        return _let(F.transform(u, inside), of_hits)

    def of_able(able: Column, u: Column, grams: Column) -> Column:
        in_units = lambda at: lambda flags: F.transform(u, lambda x, k: F.aggregate(F.slice(flags, F.get(at, k) + 1, F.size(x["words"])), F.lit(0), lambda a, f: a + f))
        runs = lambda at: _let(_let(_firsts(grams), in_units(at)), lambda news: F.flatten(F.transform(able, lambda t: of_template(t, u, grams, at, news))))
        each = F.sort_array(_let(_sums(F.transform(u, lambda x: F.size(x["words"]))), runs))
        apart = lambda kept, x: F.forall(kept, lambda k: (k["last"] < x["first"]) | (x["last"] < k["first"]))
        none = F.array().cast("array<struct<minus:double,name:string,first:int,last:int>>")
        plain = lambda kept: F.transform(kept, lambda k: F.struct(k["minus"].alias("minus"), k["name"].alias("name")))
        return F.aggregate(each, none, lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept), plain)

    empty = F.array().cast("array<struct<minus:double,name:string>>")

    def of_units(u: Column) -> Column:
        able = lambda g: F.filter(known, lambda t: F.size(F.array_intersect(g, t["mine"])) >= t["low"])
        found = lambda g: _let(able(g), lambda a: F.when(F.size(a) > 0, of_able(a, u, g)).otherwise(empty))
        return _let(_grams(F.flatten(F.transform(u, lambda x: x["words"]))), found)

    return _let(units, lambda u: F.when((F.size(u) >= 2) & F.exists(u, lambda x: x["free"]), of_units(u)).otherwise(empty))


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, licences, licence, dice, n_matches`` for each row.

    ``licences`` are the identifiers found, sorted; ``licence`` is the one with the highest coefficient (ties: the first by
    name), null if there is none, and ``dice`` its coefficient, else 0. ``n_matches`` counts the matching lines, sentences
    and, if it isn't one line or sentence, the whole text, and the runs of lines or sentences outside these. Null and empty texts match nothing; repeated rows each give a
    row; a null id stays; other columns are not read; an empty table gives an empty result.
    """
    templates = templates or TEMPLATES
    rows = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    needed = F.col("_text").rlike(rf"(?<![a-z0-9])(?:{'|'.join(required_words(templates, threshold))})(?![a-z0-9])")
    whole = F.array("_text")
    sentences = lambda line: F.split(line, r"(?<=[.!?])[\x20\x09-\x0D]+")
    words = lambda p: F.array_remove(F.split(p, "[^a-z0-9]+"), "")
    parts = F.flatten(F.transform(F.split("_text", "\n"), lambda line: F.array_union(F.array(line), sentences(line))))
    passages = F.when(needed, F.array_union(whole, parts)).otherwise(F.array().cast("array<string>"))
    lines = F.when(needed, F.transform(F.split("_text", "\n"), lambda line: F.filter(F.transform(sentences(line), words), lambda w: F.size(w) > 0)))
    rows = rows.select(id_col, passages.alias("_passages"), F.coalesce(lines, F.array().cast("array<array<array<string>>>")).alias("_lines"))
    # A passage as its words, then as its distinct bigrams.
    rows = rows.select(id_col, "_lines", F.filter(F.transform("_passages", words), lambda w: F.size(w) >= 2).alias("_words"))
    rows = rows.select(id_col, "_lines", "_words", F.transform("_words", lambda w: F.array_distinct(_grams(w))).alias("_grams"))

    def best(gram: Column) -> Column:
        """The best template of a passage; comparing is left out where the sizes rule a match out."""
        found = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                mine = template_bigrams(text)
                low, high = size_bounds(len(mine), threshold)
                dice = 2.0 * F.size(F.array_intersect(gram, F.array(*map(F.lit, mine)))) / (F.size(gram) + len(mine))
                found.append(F.when(F.size(gram).between(low, high), F.when(dice >= threshold, F.struct((-dice).alias("minus"), F.lit(name).alias("name")))))
        return F.array_min(F.array(*found))

    matched = F.filter(F.zip_with("_grams", "_words", lambda g, w: F.struct(best(g).alias("best"), w.alias("words"))), lambda x: x["best"].isNotNull())
    rows = rows.select(id_col, "_lines", matched.alias("_matched"))
    is_match = lambda w: F.exists("_matched", lambda m: m["words"] == w)
    marked = lambda taken: lambda line: _let(taken | is_match(F.flatten(line)), lambda t: F.transform(line, lambda w: F.struct(w.alias("words"), (~(t | is_match(w))).alias("free"))))
    units = _let(is_match(F.flatten(F.flatten("_lines"))), lambda taken: F.flatten(F.transform("_lines", marked(taken))))
    rows = rows.select(id_col, F.concat(F.transform("_matched", lambda m: m["best"]), _runs(units, threshold, templates)).alias("_found"))
    top = F.array_min("_found")
    return rows.select(
        id_col,
        F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["name"]))).alias("licences"),
        top["name"].alias("licence"),
        F.coalesce(-top["minus"], F.lit(0.0)).alias("dice"),
        F.size("_found").cast("long").alias("n_matches"),
    )
