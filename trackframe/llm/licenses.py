"""License notices found by a positional index of rare words, in DataFrame functions only.

The index holds, for each template, its rarest words (by document frequency in the scanned
table itself) with their positions. A file looks up those of its words that are in the
index; every posting gives a shift (place in the file minus place in the template), and
words of one notice agree on the shift up to SLACK. Where enough of a template's rare
words agree, its mandatory key phrases are checked, and its label is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.llm.frames import cut_lineage, stored

#: Fixed values of the contract: phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Parameter: notices in use, with the phrases that each must hold word for word.
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee", "appear in all copies")),
    ("apache", "Licensed under the Apache License, Version 2.0.", ("apache license", "version 2 0")),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "except in compliance with the license")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("the gnu general public license", "free software foundation")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("without any express or implied warranty", "the authors be held liable")),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software", "public domain")),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", ("cc0 1 0",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("attribution sharealike",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("attribution noncommercial",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
)

#: rare words of a template in the index: half of its distinct words, so many at most
RARE = 16
#: words that a notice may have gained or lost between two of its rare words, in all
SLACK = 8
#: share of a template's rare words that must agree on the shift
AGREE = (3, 5)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, GAP), lambda w: w != "")


def template_words(spark, templates: tuple = TEMPLATES) -> DataFrame:
    """template (number), label, word, place: every word of every template; as many rows as the parameter has words."""
    rows = [(k, label, text) for k, (label, text, _) in enumerate(templates)]
    listed = spark.createDataFrame(rows, "template int, label string, text string")
    return listed.select("template", "label", F.posexplode(words_of(F.col("text"))).alias("place", "word"))


def rare_index(docs_words: DataFrame, templates: DataFrame, rare: int = RARE) -> DataFrame:
    """template, label, word, place, k (number of the word in its template), size (its indexed words).

    docs_words(words): document frequencies are counted over all of its rows; the lowest, then
    the smaller word, goes in first. A word that no document holds is the rarest.
    """
    vocabulary = [r["word"] for r in templates.select("word").distinct().collect()]  # words of the parameter
    seen = docs_words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("word"))
    df = cut_lineage(seen.groupBy("word").agg(F.count("*").alias("df")))
    own = templates.select("template", "word").distinct().join(df, "word", "left").na.fill(0, ["df"])
    by = W.partitionBy("template")
    own = own.withColumn("k", F.row_number().over(by.orderBy("df", "word"))).withColumn("half", F.least(F.lit(rare), F.ceil(F.count("*").over(by) / 2).cast("int")))
    own = own.where(F.col("k") <= F.col("half")).select("template", "word", F.col("k") - 1, F.col("half").alias("size")).toDF("template", "word", "k", "size")
    return templates.join(own, ["template", "word"])


def places_of(words: Column, phrase: str, label: str) -> Column:
    first, *rest = phrase.split()

    def here(w: Column, i: Column) -> Column:
        whole = w == first
        for d, token in enumerate(rest, 1):
            whole = whole & (F.get(words, i + d) == token)
        return F.when(whole, F.struct(i.alias("place"), F.lit(label).alias("label")))

    found = F.filter(F.transform(words, here), lambda x: x.isNotNull())
    return F.when(F.array_contains(words, first), found).otherwise(F.array().cast("array<struct<place:int,label:string>>"))


def phrase_places(words: Column, phrases: tuple = PHRASES) -> Column:
    """Array of (place, label): every place where a phrase's words stand consecutively."""
    return F.concat(*[places_of(words, phrase, label) for phrase, label in phrases])


def find_licenses(docs: DataFrame, templates: tuple = TEMPLATES, rare: int = RARE, slack: int = SLACK, agree: tuple[int, int] = AGREE) -> DataFrame:
    """docs(doc_id, text) -> one row for each row of docs.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. Base labels come
    from PHRASES and always stay; a template's label is added where a share of at least `agree`
    of its rare words (two at least) stands at one shift, give or take `slack`, and the file
    holds all its key phrases. score is the largest such share, at least 0.5 with a base label,
    0 without any label. Null and empty texts have no words; labels of nothing are the empty
    string; repeated rows are each reported; an empty table gives no rows.

    The texts are read twice, once for document frequencies, once for the file's rare words;
    only those words, not texts, are shuffled. Index and key phrases are as large as the
    templates, a parameter; a file with many hits is split by (template, shift).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    index = cut_lineage(rare_index(docs, template_words(spark, templates), rare))
    rare_words = [r["word"] for r in index.select("word").distinct().collect()]  # a part of the parameter's words
    keys = sorted({p for _, _, phrases in templates for p in phrases})

    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare_words), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), phrase_places(F.col("words")).alias("base"), hits.alias("hits"), "words"
    )
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    held = F.filter(F.array(*[F.when(F.contains(joined, F.lit(f" {p} ")), F.lit(p)) for p in keys]), lambda p: p.isNotNull())
    no_keys = F.array().cast("array<string>")
    files = stored(read.select("row", "doc_id", "n_words", "base", "hits", F.when(F.size("hits") > 1, held).otherwise(no_keys).alias("keys")))

    # A shift lies in two windows of 2 * slack words, each slack further than the last, so that shifts up to slack apart share one.
    votes = (
        files.where(F.size("hits") > 1).select("row", F.explode("hits").alias("h")).select("row", "h.word", "h.at")
        .join(F.broadcast(index), "word")
        .withColumn("window", F.floor((F.col("at") - F.col("place")) / slack))
        .select("row", "template", "label", "size", "k", F.explode(F.array("window", F.col("window") - 1)).alias("window"))
    )
    agreed = votes.groupBy("row", "template", "label", "size", "window").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits"))
    agreed = agreed.groupBy("row", "template", "label", "size").agg(F.max(F.bit_count("bits")).alias("matched"))
    agreed = agreed.where((F.col("matched") >= 2) & (F.col("matched") * agree[1] >= F.col("size") * agree[0]))

    needs = spark.createDataFrame([(k, list(phrases)) for k, (_, _, phrases) in enumerate(templates)], "template int, needs array<string>")
    verified = agreed.join(F.broadcast(needs), "template").join(files.where(F.size("keys") > 0).select("row", "keys"), "row").where(F.size(F.array_except("needs", "keys")) == 0)
    given = verified.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("matched") / F.col("size")).alias("share"))

    own = F.array_sort(F.array_distinct(F.col("base.label")))
    none = F.array().cast("array<string>")
    out = files.select("row", "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.place").cast("long").alias("first_word"), F.array_max("base.place").cast("long").alias("last_word"), own.alias("own"))
    return out.join(given, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("own") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
