"""Licence scan by diagonal voting, in DataFrame functions only.

The rolling word k-grams of each text are hashed and joined to the positions of the same k-grams in the templates
(a fixed table, some hundred rows, broadcast). Phrases have k = 2, paragraphs of licence texts a larger k. Grams
that no template has are left out before the join by the set of all template hashes. A hit at word p of the text
and word q of a template votes for diagonal p - q. Votes are counted per text, template and diagonal, with partial
sums before the shuffle; neighbouring diagonals (words added or missing) are merged, and a merged span is verified
by its share of the template's grams and by its length. A phrase counts as found only where one diagonal has all
of its grams.

Defined cases: null text counts as empty; a null doc_id and repeated rows are rows like others; a text without
words or without hits has no labels, null first_word and last_word and score 0; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Paragraphs of well-known licence texts that no other licence has, and their labels.
NOTICES = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions:""": "mit",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
    the License. You may obtain a copy of the License at""": "apache",
    """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
    an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
    specific language governing permissions and limitations under the License.""": "apache",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
    version.""": "gpl",
    """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
    details.""": "gpl",
    "This work is licensed under the GNU General Public License": "gpl",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met:""": "bsd",
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer.""": "bsd",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at""": "mpl",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies.""": "isc",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
    or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""": "unlicense",
    """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
    it and redistribute it freely, subject to the following restrictions:""": "zlib",
    """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
    accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
    transmit the Software""": "boost",
}
#: Words of a paragraph's grams.
GRAM = 4
#: Diagonals that far apart are merged; share of a paragraph's grams and length against its own that a span needs.
SLACK, LEAST_SHARE, MOST_LENGTH = 3, 0.5, 1.5

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(col: str):
    """Words of a text, A-Z in lower case; null counts as empty."""
    low = F.translate(F.coalesce(F.col(col).cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BREAK), "")


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_grams(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """gram, size, template, label, exact, place, grams (of the template), length (words): one row per gram of a template."""
    rows = []
    for number, (text, label, size, exact) in enumerate([(t, n, 2, True) for t, n in phrases.items()] + [(t, n, k, False) for t, n in notices.items()]):
        w = _template_words(text)
        if len(w) < size:
            raise ValueError(f"a template needs {size} words or more")
        grams = len(w) - size + 1
        rows += [(" ".join(w[i : i + size]), size, number, label, exact, i, grams, len(w)) for i in range(grams)]
    return spark.createDataFrame(rows, "gram string, size int, template int, label string, exact boolean, place int, grams int, length int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, k: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices."""
    known = template_grams(docs.sparkSession, phrases, notices, k)
    hashed = lambda size: F.xxhash64(F.lit(size), *[F.get(F.split("gram", " "), F.lit(i)) for i in range(size)])
    known = known.withColumn("hash", F.when(F.col("size") == 2, hashed(2)).otherwise(hashed(k)))
    hashes = sorted({r[0] for r in known.select("hash").collect()})  # the template table, fixed
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), words(text_col).alias("w"))

    def grams(size):
        """Place, size and hash of the rolling grams that some template may have."""
        rolled = F.transform("w", lambda x, i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.lit(size), x, *[F.get("w", i + j) for j in range(1, size)]).alias("h")))
        return F.filter(rolled, lambda g: g["h"].isin(hashes))

    found = grams(2) if k == 2 else F.concat(grams(2), grams(k))
    rolled = rows.select("row_id", "doc_id", F.size("w").cast("long").alias("n_words"), "w", F.explode_outer(found).alias("g"))
    rolled = rolled.select("row_id", "doc_id", "n_words", "g.at", "g.h", F.expr("array_join(slice(w, g.at + 1, g.size), ' ')").alias("words"))
    hits = rolled.join(F.broadcast(known), (F.col("h") == F.col("hash")) & (F.col("words") == F.col("gram")), "left")
    # Grams without a hit fall together into one row a text before anything is shuffled.
    facts = ["row_id", "doc_id", "n_words", "template", "label", "exact", "grams", "size", "length"]
    at = F.when(F.col("template").isNotNull(), F.col("at"))
    votes = hits.groupBy(*facts, (F.col("at") - F.col("place")).cast("long").alias("diagonal")).agg(
        F.count("template").alias("votes"), F.min(at).alias("low"), (F.max(at) + F.col("size")).alias("high")
    )
    whole = F.col("exact") & (F.col("votes") == F.col("grams"))
    along = Window.partitionBy("row_id", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SLACK, F.lit(True)) | F.col("exact")
    runs = votes.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*facts, "run").agg(
        F.sum("votes").alias("votes"),
        F.min("low").cast("long").alias("low"),
        F.max("high").cast("long").alias("high"),
        F.sum(F.when(whole, 1).otherwise(0)).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_place"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_place"),
    )
    share = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    like = ~F.col("exact") & (share >= LEAST_SHARE) & (F.col("high") - F.col("low") <= F.col("length") * MOST_LENGTH)
    found = (F.col("places") > 0) | like
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    per_text = spans.groupBy("row_id", "doc_id", "n_words").agg(
        F.sum("places").cast("long").alias("n_base"),
        F.min("first_place").alias("first_word"),
        F.max("last_place").alias("last_word"),
        joined(F.col("places") > 0).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found, share)), F.lit(0.0)).alias("score"),
        F.count(F.when(like, 1)).alias("n_notices"),
    )
    return per_text.drop("row_id")
