"""License scan with a positional index of rare tokens, in DataFrame operations only.

Templates are word sequences: names, openings and distinctive paragraphs of public licences. Document frequencies of all template words are counted over the
whole corpus; the words of each template with the highest inverse frequency go into a positional index
(word -> template, place in the template). A document's indexed words are looked up, each with the few
words around it; postings of one template meet where they agree on its start (place in the document
less place in the template). There the mandatory key phrase is verified word by word, and the share of
the template that stands in place, weighted by inverse frequency, is the score.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm.tables import with_row


class Template(NamedTuple):
    label: str
    text: str
    key: str  # must stand in place
    base: bool = False  # a phrase of the contract: all its words must stand


# The phrases of the contract.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)
# Openings of public licences.
MORE = (
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("boost", "boost software license", "boost software license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    Template("cc-by", "creative commons attribution", "creative commons attribution"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("isc", "permission to use copy modify and or distribute this software", "copy modify and or distribute this software"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person", "hereby granted free of charge"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
# Distinctive paragraphs of public licences, each with what must stand in it word by word.
PARAGRAPHS = tuple(
    Template(label, *(" ".join(re.findall(r"[a-z0-9]+", part.lower())) for part in (text, key)))
    for label, text, key in (
        (
            "mit",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
            "use, copy, modify, merge, publish, distribute, sublicense",
        ),
        (
            "bsd",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
            "in the documentation and/or other materials provided with the distribution",
            "must retain the above copyright notice, this list of conditions and the following disclaimer",
        ),
        (
            "isc",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies",
            "for any purpose with or without fee is hereby granted",
        ),
        (
            "apache",
            "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
            "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under "
            "the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
            "you may not use this file except in compliance with the License",
        ),
        (
            "gpl",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
            "under the terms of the GNU General Public License as published by the Free Software Foundation",
        ),
        (
            "lgpl",
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
            "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
            "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ),
        (
            "mpl",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
            "this file, You can obtain one at http://mozilla.org/MPL/2.0",
            "This Source Code Form is subject to the terms",
        ),
        (
            "unlicense",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
            "compiled binary, for any purpose, commercial or non-commercial, and by any means",
            "copy, modify, publish, use, compile, sell, or distribute this software",
        ),
        (
            "zlib",
            "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any "
            "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
            "commercial applications, and to alter it and redistribute it freely",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications",
        ),
        (
            "boost",
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
            "documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
            "use, reproduce, display, distribute, execute, and transmit the Software",
        ),
    )
)
TEMPLATES = BASE + MORE + PARAGRAPHS
RARE_WORDS = 2  # indexed words per template
LEAST_SCORE = 0.7  # for templates that are not base phrases
LEAST_WEIGHT = 0.1  # of a word that every document holds

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> DataFrame:
    """(word, n): the documents that hold each word of ``vocabulary``, counted over all of them."""
    found = F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    return docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def rare_token_index(docs: DataFrame, templates=TEMPLATES, rare: int = RARE_WORDS, text_col: str = "text") -> DataFrame:
    """(word, template, place, label, base, words, weights, key_from, key_size, need), one row per posting.

    As many rows as the templates have rare words, whatever the corpus.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    counts = {r["word"]: r["n"] for r in document_frequencies(docs, vocabulary, text_col).collect()}  # <= vocabulary
    total, rows = docs.count(), []
    for number, t in enumerate(templates):
        words, key = t.text.split(), t.key.split()
        idf = [math.log((1 + total) / (1 + counts.get(w, 0))) + LEAST_WEIGHT for w in words]
        start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        places = sorted(range(start, start + len(key)), key=lambda i: (-idf[i], i))[:rare]
        for place in places:
            rows.append((words[place], number, place, t.label, t.base, words, idf, start, key, len(places)))
    return spark.createDataFrame(
        rows,
        "word string, template int, place int, label string, base boolean, words array<string>, weights array<double>, key_from int, key_words array<string>, need int",
    )


def license_places(docs: DataFrame, templates=TEMPLATES, rare: int = RARE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row and template start the verified match: (_row, id, n_words, label, base, start, score).

    Every document has at least one row; the others of its columns are null if nothing was found.
    A null text has no words; rows with equal ids stay apart; other columns are not read.
    """
    index = rare_token_index(docs, templates, rare, text_col)
    # How many words before and after an indexed word its templates reach.
    ahead = F.size("words") - F.col("place")
    reach = {r[0]: (r[1], r[2]) for r in index.groupBy("word").agg(F.max("place"), F.max(ahead)).collect()}  # <= vocabulary
    wanted = sorted(reach)
    back_of, size_of = (F.create_map(*[F.lit(x) for w in wanted for x in (w, f(*reach[w]))]) for f in (lambda b, a: b, lambda b, a: b + a))
    source = with_row(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    split = source.select("_row", "_id", words_of(F.col("_text")).alias("words"))
    n = F.size("words")
    at = F.filter(F.sequence(F.lit(0), n), lambda i: F.get("words", i).isin(wanted))
    # Each indexed word with the words around it; ``back`` is how many of them stand before it.
    def placed(i: Column) -> Column:
        word = F.get("words", i)
        back = F.least(i, back_of[word])
        return F.struct(i.alias("at"), word.alias("word"), back.alias("back"), F.slice("words", i - back + 1, size_of[word] + 1).alias("around"))

    seen = F.transform(at, placed)
    hits = split.select("_row", "_id", n.cast("long").alias("n_words"), F.explode_outer(seen).alias("h"))
    postings = hits.join(F.broadcast(index), F.col("h.word") == F.col("word"), "left")
    place = F.col("place")
    first = F.col("h.back") - place  # where the template starts within ``around``
    here = lambda j: F.when(first + j >= 0, F.get("h.around", first + j))
    in_place = lambda words, start: F.forall(F.transform(words, lambda w, j: F.coalesce(here(start + j) == w, F.lit(False))), lambda x: x)
    weight = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    standing = F.aggregate(
        F.transform("words", lambda w, j: F.when(here(j) == w, F.get("weights", j)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x
    )
    verified = postings.select(
        "_row", "_id", "n_words", "template", "label", "base", "need", "place",
        (F.col("h.at") - place).cast("long").alias("start"),
        in_place(F.col("key_words"), F.col("key_from")).alias("key_stands"),
        F.least(F.lit(1.0), standing / weight).alias("score"),
    )
    met = verified.groupBy("_row", "_id", "n_words", "template", "label", "base", "start").agg(
        (F.count_distinct("place") == F.first("need")).alias("agree"),
        F.bool_and("key_stands").alias("key_stands"), F.max("score").alias("score"),
    )
    good = F.col("agree") & F.col("key_stands") & (F.col("base") | (F.col("score") >= LEAST_SCORE))
    blank = {c: F.when(good, F.col(c)).alias(c) for c in ("label", "base", "start", "score")}
    return met.select("_row", F.col("_id").alias(id_col), "n_words", *blank.values())


def license_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: base places, labels and score. No finding: null starts, empty labels, score 0."""
    id_col = options.get("id_col", "doc_id")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  at most one item per label
    start = F.when(F.col("base"), F.col("start"))
    return license_places(docs, **options).groupBy("_row", id_col, "n_words").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    ).drop("_row")
