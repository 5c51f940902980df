"""Licence notices in documents by the Dice coefficient over word bigrams; built-in functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.shared import empty_if_null

DICE = 0.8
COMMON = frozenset("a and as at by file for in is it of on or that the this to under use with work".split())

# The wording of public licence notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-line": "This library is licensed under the GNU Lesser General Public License.",
    "agpl-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def least_shared(size: int, dice: float) -> int:
    """Bigrams of a template that a text must share to reach ``dice``, even if it has no others."""
    return max(1, math.ceil(dice * size / (2 - dice) - 1e-9))


def anchors(templates: dict[str, list[str]], dice: float) -> list[str]:
    """Words of which every text that matches some template has one: so many bigrams hold one of them that
    too few are left without. The longest words are taken first, as they are the rarest, common ones last."""
    chosen: set[str] = set()
    for grams in templates.values():
        for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w)):
            if sum(not chosen & set(g.split()) for g in grams) < least_shared(len(grams), dice):
                break
            chosen.add(word)
    return sorted(chosen)


def _bigram_set(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, kind, unit, license, score)``: units of each text whose Dice coefficient reaches ``dice``.

    Units are the lines and the paragraphs (between blank lines) of more than one line, numbered from 0.
    Texts are lower-cased and what isn't a-z or 0-9 parts words; the coefficient compares sets of word
    bigrams. Units of fewer than two words, null and empty texts match nothing; a unit may match several
    templates; repeated rows are reported as often as they occur. Other columns are not read.

    Two bounds drop candidates that cannot match: a text must hold one of ``anchors``, and a unit is
    compared with the templates whose size admits the coefficient.
    """
    grams = {name: bigrams(normal_words(t)) for name, t in templates.items()}
    words = anchors(grams, dice)
    has_anchor = lambda c: F.lower(c).rlike(f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])")
    low = min(least_shared(len(g), dice) for g in grams.values())
    text = empty_if_null(F.col(text_col))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(has_anchor(F.col("text")))
    cut = lambda kind, end: F.struct(F.lit(kind).alias("kind"), F.split("text", end).alias("parts"))
    units = own.select("id", F.explode(F.array(cut("line", "\n"), cut("paragraph", "\n[ \t\r]*\n"))).alias("cut"))
    every = units.select("id", "cut.kind", F.posexplode("cut.parts").alias("unit", "piece"))
    pieces = every.where(has_anchor(F.col("piece")) & ((F.col("kind") == "line") | F.contains("piece", F.lit("\n")))).withColumn("unit", F.col("unit").cast("long"))
    split = pieces.select("id", "kind", "unit", F.split(F.trim(F.regexp_replace(F.lower("piece"), "[^a-z0-9]+", " ")), " ").alias("words"))
    sized = split.where(F.size("words") > low).select("id", "kind", "unit", F.monotonically_increasing_id().alias("row"), _bigram_set(F.col("words")).alias("grams"))
    counted = sized.select("id", "kind", "unit", "row", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    known = docs.sparkSession.createDataFrame(
        [(x, name, len(g), least_shared(len(g), dice), math.floor((2 - dice) / dice * len(g) + 1e-9)) for name, g in grams.items() for x in g],
        "gram string, license string, of int, low int, high int",
    )
    # The templates are a constant of this module or an argument, a few hundred rows, never data.
    shared = counted.join(F.broadcast(known), "gram").where(F.col("size").between(F.col("low"), F.col("high")))
    score = 2 * F.count("*") / (F.col("size") + F.col("of"))
    scored = shared.groupBy("row", "id", "kind", "unit", "license", "size", "of").agg(score.alias("score"))
    return scored.where(F.col("score") >= dice).select(F.col("id").alias(id_col), "kind", "unit", "license", "score")
