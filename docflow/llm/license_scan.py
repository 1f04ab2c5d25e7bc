"""License scans with a positional index of rare words.

Base: the places where the words of a fixed phrase stand consecutively.  The
method adds labels: passages of licence texts and notices are kept as an index from
word to (passage, position).  IDF, measured over all documents, picks the words: of
each passage those of the highest IDF that carry most of its weight.  Each occurrence
of an indexed word votes for its passages at its relative position with its IDF, and
the postings that agree on one position are intersected.  A passage counts when the
agreeing words carry enough of the weight of its indexed words and its mandatory
phrases stand at that position.  All indexed words of a document vote.

All is done with DataFrame functions.  One pass over the texts counts the documents of
each passage word, a second keeps the places of indexed words and of phrase words
near them; the rest works on those, by joins, so a text of many hits costs no more than
its hits.  The passages and their words are a fixed table, so what is broadcast, or
counted on the driver, is bounded.

Defined results: a null text counts as empty.  Rows are judged one by one, so
repeats are judged alike, and null ids are kept.  With an empty table the result is
empty.  Other input columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import ascii_lower, let, materialize

#: Runs of ASCII letters and digits (either case) and of characters beyond ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: The label of a notice that tells something only where no licence stands beside it: many licence texts begin with it.
RESERVED = "proprietary"

# Fixed values: (label, passage of a public licence text, or notice; mandatory phrases).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses", "in compliance with the license"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["permission notice shall be included", "substantial portions"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted", "free of charge"]),
    ("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "version 2 of the license"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "version 3 of the license"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["lesser general public license", "free software foundation"]),
    ("lgpl", "Licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["affero general public license", "free software foundation"]),
    ("agpl", "Licensed under the GNU Affero General Public License", ["affero general public license"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["endorse or promote products", "specific prior written permission"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["permission to use copy modify", "fee is hereby granted"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license", "source code form"]),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", ["boost software license"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ["in no event will the authors be held liable"]),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", ["altered source versions must be plainly marked"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["attribution noncommercial 4 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["attribution sharealike 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc0", "the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work", ["associated cc0 with", "waived all copyright"]),
    ("cc0", "Released under CC0 1.0 Universal", ["cc0 1 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software"]),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", ["verbatim or modified copies", "as long as the name is changed"]),
    # Heads of whole texts.
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", ["gnu general public license version 2 june 1991"]),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ["gnu general public license version 3 29 june 2007"]),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", ["lesser general public license version 2 1"]),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ["lesser general public license version 3"]),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", ["affero general public license version 3"]),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ["apache license version 2 0 january 2004"]),
    ("apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.", ["use reproduction and distribution as defined by sections 1 through 9"]),
    ("mpl-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.", ["mozilla public license version 2 0", "owns covered software"]),
    ("epl-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE", ["eclipse public license v 2 0"]),
    ("bsl-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", ["boost software license version 1 0"]),
    ("cc0", "CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES", ["cc0 1 0 universal"]),
    (RESERVED, "All rights reserved", ["all rights reserved"]),
]

#: Part of a passage's IDF that its indexed words carry, and how many places of it at most.
INDEX_WEIGHT = 0.8
INDEX_PLACES = 16
#: Part of the weight of a passage's indexed words that words at one relative position must carry.
COVERAGE = 0.6


def _words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())


PASSAGES = [(label, _words(text), [p.split() for p in phrases]) for label, text, phrases in TEMPLATES]


def _needs(words: list[str], phrases: list[list[str]]) -> dict[int, str]:
    """The places of a passage's mandatory phrases and their words."""
    out: dict[int, str] = {}
    for phrase in phrases:
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out |= {at + k: w for k, w in enumerate(phrase)}
    return out


def _index(idf: dict[str, float]) -> list[list[int]]:
    """Of each passage, the places of its highest-IDF words that carry enough of its weight."""
    out = []
    for _, words, _ in PASSAGES:
        order = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))
        whole, got, places = sum(idf[w] for w in words), 0.0, []
        for i in order[:INDEX_PLACES]:
            if got >= INDEX_WEIGHT * whole:
                break
            places.append(i)
            got += idf[words[i]]
        out.append(places)
    return out


def _reach(index: list[list[int]], idf: dict[str, float]) -> tuple[set[str], int]:
    """Words whose places are looked for, and how far from the nearest one a phrase word may stand."""
    anchors, reach = set(), 0
    for (_, words, phrases), places in zip(PASSAGES, index, strict=True):
        anchors |= {words[i] for i in places}
        reach = max([reach, *(min(abs(at - i) for i in places) for at in _needs(words, phrases))])
    for phrase in map(str.split, BASE):
        at = max(range(len(phrase)), key=lambda i: idf[phrase[i]])
        anchors.add(phrase[at])
        reach = max(reach, at, len(phrase) - 1 - at)
    return anchors, reach


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """IDF of every passage and base word over all documents, on the driver: one number a word of the fixed table."""
    words = sorted({w for _, ws, _ in PASSAGES for w in ws} | {w for phrase in BASE for w in phrase.split()})
    # One row a document and word of the table; lower() is exact for these up to a few foreign letters.
    found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.lower(w)), lambda w: w.isin(words)))
    rows = _texts(docs).select(F.explode(F.concat(F.array(F.lit("")), found)).alias("word"))
    df = {r["word"]: r["count"] for r in rows.groupBy("word").count().collect()}
    n = df.get("", 0)
    return {w: max(math.log((n + 1) / (df.get(w, 0) + 0.5)), 1e-6) for w in words}


def places(docs: DataFrame, anchors: set[str], reach: int) -> DataFrame:
    """doc_id, row, n_words and hits: (at, word) of every anchor and of phrase words within reach, in order."""
    wanted = sorted({w for _, ws, phrases in PASSAGES for p in phrases for w in p} | {w for phrase in BASE for w in phrase.split()} | anchors)
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def near(ws: Column, at: Column) -> Column:
        # From each anchor's reach, without what the one before has reached.
        def own(p: Column, i: Column) -> Column:
            low = F.greatest(F.lit(0), p - reach, F.when(i > 0, F.get(at, i - 1) + reach + 1).otherwise(0))
            high = F.least(F.size(ws) - 1, p + reach)
            spread = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(spread, lambda k: F.struct(k.cast("long").alias("at"), ascii_lower(F.get(ws, k)).alias("word")))

        return F.filter(F.flatten(F.transform(at, own)), lambda x: x["word"].isin(wanted))

    def hits(ws: Column) -> Column:
        # lower() may fold characters beyond ASCII onto an anchor; the words kept are held against A-Z only.
        at = F.filter(F.transform(ws, lambda w, i: F.when(F.lower(w).isin(sorted(anchors)), i)), lambda i: i.isNotNull())
        return let(at, lambda a: near(ws, a))

    both = let(found, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), hits(ws).alias("hits")))
    rows = _texts(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), both.alias("found"))
    return rows.select("doc_id", "row", "found.n_words", "found.hits")


def _starts(hits: Column, phrase: str) -> Column:
    """Places (words from 0) where the phrase's words stand consecutively."""
    words = phrase.split()
    here = lambda x, i: [(F.get(hits, i + k)["word"] == w) & (F.get(hits, i + k)["at"] == x["at"] + k) for k, w in enumerate(words)]

    def match(x: Column, i: Column) -> Column:
        out = F.lit(True)
        for one in here(x, i):
            out = out & F.coalesce(one, F.lit(False))
        return out

    return F.transform(F.filter(hits, match), lambda x: x["at"])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and labels, the method's labels and score."""
    spark = docs.sparkSession
    idf = inverse_frequencies(docs)
    index = _index(idf)
    rows = materialize(places(docs, *_reach(index, idf)), "op2-places")

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(_starts(F.col("hits"), phrase), lambda at: F.struct(at.alias("at"), F.lit(label).alias("label")))

    def table(columns: str, entries: list[tuple]) -> DataFrame:
        """Literal rows, as many as the fixed table has."""
        names = columns.split()
        rows = [F.struct(*[F.lit(value).alias(name) for name, value in zip(names, entry, strict=True)]) for entry in entries]
        return F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))

    postings = table("template word position idf", [(t, PASSAGES[t][1][i], i, idf[PASSAGES[t][1][i]]) for t, own in enumerate(index) for i in own])
    weights = table("template label weight", [(t, PASSAGES[t][0], sum(idf[PASSAGES[t][1][i]] for i in own)) for t, own in enumerate(index)])
    needs = [(t, at, w) for t, (_, words, phrases) in enumerate(PASSAGES) for at, w in _needs(words, phrases).items()]
    counts = table("template needed", [(t, sum(n[0] == t for n in needs)) for t in range(len(PASSAGES))])
    # Postings at a relative position: all indexed words of the passage vote there.
    placed = rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.at", "hit.word")
    votes = placed.join(postings, "word").select("row", "template", (F.col("at") - F.col("position")).alias("begin"), "idf")
    agreed = votes.groupBy("row", "template", "begin").agg(F.sum("idf").alias("got")).join(weights, "template")
    agreed = agreed.withColumn("score", F.least(F.col("got") / F.col("weight"), F.lit(1.0))).where(F.col("score") >= COVERAGE)
    agreed = materialize(agreed.select("row", "template", "begin", "label", "score"), "op2-agreed")
    # Mandatory phrases: each of their words must stand at its own place behind the passage's begin.
    asked = agreed.join(table("template offset word", needs), "template").withColumn("at", F.col("begin") + F.col("offset"))
    verified = asked.join(placed, ["row", "at", "word"]).groupBy("row", "template", "begin", "label", "score").count()
    verified = verified.join(counts, "template").where(F.col("count") == F.col("needed"))
    best = verified.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))  # a label each at most
    out = rows.withColumn("base", F.flatten(F.array(*[labelled(*item) for item in BASE.items()]))).join(best, "row", "left")
    base = F.array_distinct(F.transform("base", lambda x: x["label"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    every = F.concat(base, F.coalesce("more", F.array().cast("array<string>")))
    licences = F.filter(every, lambda x: x != RESERVED)
    every = F.when(F.size(licences) > 0, licences).otherwise(every)
    at = F.transform("base", lambda x: x["at"])
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(every).alias("labels"),
        F.coalesce(F.greatest("best", F.when(F.size("base") > 0, F.lit(0.5))), F.lit(0.0)).alias("score"),
    )
