"""Licence scan with a positional index of rare licence words.

Texts become words: runs of letters, digits and non-ASCII characters, A-Z lower-cased. Templates are
standard passages of licences, each with a key phrase that must stand complete. The index holds the
places of every telling word in the templates. A first pass over all texts counts how many have each
word. Of each key phrase the word with the highest inverse document frequency leads: where a text has
it, the template is proposed at the relative place, and every word of the key phrase is verified
there, so neither the number of licences in a text nor other texts decide which labels it gets. For
verified places the index is joined with the text's licence words, postings that agree on the relative
place are intersected, and the score is the largest share of a template's weight that agrees, rounded
to six places. Base phrases are verified word by word.

Only DataFrame expressions; the index and the word weights are bounded by the templates. Null and
empty texts have no words and no labels. Repeated rows are judged each for itself. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Fixed values: (label, standard passage of the licence, key phrase in it).
PASSAGES = [
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "GNU General Public License version 3"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc.", "GNU General Public License version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "GNU Lesser General Public License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "Apache License Version 2 0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "Permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistribution and use in source and binary forms"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License v 2 0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.", "Eclipse Public License v 2 0"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt.", "Boost Software License Version 1 0"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free and unencumbered software released into the public domain"),
    ("cc-by-nc", "This work is licensed under CC BY-NC 4.0. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.", "CC BY NC"),
    ("cc-by-sa", "This work is licensed under CC BY-SA 4.0. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.", "CC BY SA"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.", "Creative Commons Attribution"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law. CC0 1.0 Universal Public Domain Dedication.", "CC0 1 0 Universal"),
]
# Words that tell nothing.
STOP = "a all an and any are as at be but by can for from if in into is it not of on one or other that the this to under use was which will with you".split()


def _plain(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, "".join(c.lower() if c.isascii() else c for c in text)) if w]


#: (label, words, place of the key phrase, its words)
TEMPLATES = []
for _label, _text, _key in PASSAGES:
    _words, _phrase = _plain(_text), _plain(_key)
    TEMPLATES.append((_label, _words, next(i for i in range(len(_words)) if _words[i : i + len(_phrase)] == _phrase), _phrase))


def _bound(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def postings() -> list[tuple[str, int, int]]:
    """(word, template number, place) of all telling words."""
    return [(w, k, i) for k, (_, words, _, _) in enumerate(TEMPLATES) for i, w in enumerate(words) if w not in STOP]


def vocabulary() -> list[str]:
    """The telling words of all templates."""
    return sorted({w for w, *_ in postings()})


def _words(text: Column) -> Column:
    return F.filter(F.split(_lowered(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _lowered(text: Column) -> Column:
    """A-Z lower-cased; the two other characters whose lower case is ASCII become non-ASCII ones first."""
    t = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    return F.lower(t)


def _phrases(words: Column, starts: list[tuple[int, int, list[str], int]]) -> Column:
    """Places (p, k) of phrases in words. starts: (k, place of the leading word in the phrase, phrase, what to take off p)."""
    leads = sorted({phrase[at] for _, at, phrase, _ in starts})
    found = F.filter(F.transform(words, lambda w, i: F.when(w.isin(leads), F.struct(w.alias("w"), i.alias("p")))), lambda x: x.isNotNull())

    def complete(x: Column, at: int, phrase: list[str]) -> Column:
        same = [x.w == phrase[at], x.p >= at, *(F.coalesce(F.get(words, x.p + (i - at)) == w, F.lit(False)) for i, w in enumerate(phrase) if i != at)]
        return reduce(lambda a, b: a & b, same)

    def places(found: Column) -> Column:
        def one(k: int, at: int, phrase: list[str], off: int) -> Column:
            return F.transform(F.filter(found, lambda x: complete(x, at, phrase)), lambda x: F.struct((x.p - off).alias("p"), F.lit(k).alias("k")))

        return F.concat(*(one(*start) for start in starts))

    return _bound(found, places)


def _read(text: Column, idf) -> Column:
    """Of a text: the number of words, places of base phrases and of templates, and where there are any, licence words with places."""
    base = [(k, 0, phrase.split(), 0) for k, (phrase, _) in enumerate(BASE)]
    leads = []
    for k, (_, _, first, phrase) in enumerate(TEMPLATES):
        at = max(range(len(phrase)), key=lambda i: (phrase[i] not in STOP, idf(phrase[i]), -i))
        leads.append((k, at, phrase, first + at))
    known = vocabulary()

    def of_words(words: Column) -> Column:
        telling = F.filter(F.transform(words, lambda w, i: F.when(w.isin(known), F.struct(w.alias("w"), i.alias("p")))), lambda x: x.isNotNull())
        return _bound(_phrases(words, leads), lambda found: F.struct(F.size(words).cast("long").alias("n_words"), _phrases(words, base).alias("base"), found.alias("found"), F.when(F.size(found) > 0, telling).alias("words")))

    return _bound(_words(text), of_words)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, base places, labels of base and of both, score."""
    spark = docs.sparkSession
    known = vocabulary()
    distinct = F.array_distinct(F.filter(_words(F.col(text_col)), lambda w: w.isin(known)))
    counted = docs.select(F.explode(F.concat(F.array(F.lit("")), distinct)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    df = {r.word: r.df for r in counted.collect()}  # bounded by the templates' words; the empty one counts texts
    n = df.get("", 0)
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 0.05

    read = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), _read(F.col(text_col), idf).alias("r"))
    held = written(read.select("doc_id", "row", "r.n_words", "r.base", "r.found", "r.words"), "licence-words")

    whole: dict[int, float] = {}
    for w, k, _ in postings():
        whole[k] = whole.get(k, 0.0) + idf(w)
    index = spark.createDataFrame([(w, k, i, idf(w)) for w, k, i in postings()], "w string, template int, at int, weight double")
    totals = spark.createDataFrame([(k, label, whole[k]) for k, (label, *_) in enumerate(TEMPLATES)], "template int, label string, whole double")

    matched = held.where(F.size("found") > 0)
    looked = matched.select("row", "found", F.explode("words").alias("x")).select("row", "found", "x.w", "x.p").join(F.broadcast(index), "w")
    place = F.col("p") - F.col("at")
    agreed = looked.where(F.exists("found", lambda f: (f.k == F.col("template")) & (f.p == place))).groupBy("row", "template", place.alias("place")).agg(F.sum("weight").alias("weight"))
    found = agreed.join(F.broadcast(totals), "template").groupBy("row").agg(F.max(F.least(F.col("weight") / F.col("whole"), F.lit(1.0))).alias("best"))

    name = lambda k, labels: F.element_at(F.array(*(F.lit(label) for label in labels)), k + 1)
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: name(b.k, [label for _, label in BASE]))))
    labels = F.transform("found", lambda f: name(f.k, [label for label, *_ in TEMPLATES]))
    places = F.transform("base", lambda b: b.p.cast("long"))
    return held.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, labels)), ",").alias("labels"),
        F.round(F.coalesce("best", F.lit(0.0)), 6).alias("score"),
    )
