"""Licence scan: passages compared to licence templates by the Dice coefficient over word bigrams. DataFrame functions only.

Method: texts are normalised (A-Z lower-cased, words are runs of ASCII letters, digits and non-ASCII characters, copyright
lines' years play no part because digits are words like others) and cut into passages at line breaks; the whole text is a
passage too when it has several. A passage of ``n`` distinct bigrams can reach the threshold t only with templates of
t / (2 - t) * n to (2 - t) / t * n bigrams: passages outside the bounds of all templates are dropped before their bigrams
are made. The rest meet the templates' bigrams in a join, shared bigrams are counted inside tasks first, and
Dice = 2 * shared / (n + m) decides. The template side is a parameter table whose size is checked.

Defined results: null or empty text and passages of fewer than two words match nothing; a passage that occurs in several
documents, or several times in one, is found in each (``n_passages`` counts the passages that match a template); repeated
rows count as one document; rows without an id count as one document; templates of fewer than two words are left out;
columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MOST_TEMPLATES = 10_000

#: Short notices and headers, as their licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("proprietary", "All rights reserved."),
)
_WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template_id int, license string, template string")


def words(text):
    """Words of a text column in order."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORDS), F.lit(0))


def bigrams(w):
    """Distinct pairs of neighbouring words of a word array, each as one string; none for fewer than two words."""
    n = F.size(w)
    return F.when(n > 1, F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))),
                                                     lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))


def scan(documents: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, dice, n_passages): per document and licence the best coefficient, and the passages that reach the threshold."""
    known = templates.select("template_id", "license", bigrams(words(F.col("template"))).alias("b")).withColumn("m", F.size("b")).where("m > 0")
    bounds = known.agg(F.count("*").alias("k"), F.min("m").alias("low"), F.max("m").alias("high")).first()
    if bounds["k"] > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates: scan with parts of them")
    # A little wider than the exact bounds, whose floats can be too large by their last bit.
    reach = threshold / (2 - threshold) * (1 - 1e-9)
    low, high = (bounds["low"] or 1) * reach, (bounds["high"] or 0) / reach
    text = documents[text_col].cast("string")
    # Generators keep what they make: words and bigrams are made once, whatever is asked of them afterwards.
    lines = documents.select(documents[id_col].alias("id"), text.alias("text"), F.split(text, "\n", -1).alias("lines")).where("text is not null")
    cut = lines.select("id", "text", "lines", F.explode(F.array(F.transform("lines", words))).alias("parts"))
    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.col("text").alias("passage"), F.flatten("parts").alias("w")))).otherwise(
        F.array().cast("array<struct<passage:string,w:array<string>>>"))
    each = F.zip_with("lines", "parts", lambda p, w: F.struct(p.alias("passage"), w.alias("w")))
    # n distinct bigrams hold at most n + 1 distinct words, and a text of k words has at most k - 1 bigrams.
    passages = cut.select("id", F.inline(F.filter(F.concat(each, whole), lambda x: (F.size(x["w"]) > 1) & (F.size(x["w"]) - 1 >= low) & (
        F.size(F.array_distinct(x["w"])) - 1 <= high))))
    found = passages.select("id", "passage", F.explode(F.array(bigrams(F.col("w")))).alias("b")).withColumn("n", F.size("b")).where(F.col("n").between(low, high))
    parts = F.broadcast(known.select("template_id", "license", "m", F.explode("b").alias("bigram")))
    terms = found.select("id", F.xxhash64("passage").alias("p"), F.xxhash64(F.lit(1), F.col("passage")).alias("q"), "n", F.explode("b").alias("bigram"))
    # The largest coefficient the sizes allow, computed as the coefficient itself is: at the border both round alike.
    within = 2 * F.least("n", "m") / (F.col("n") + F.col("m")) >= threshold
    shared = terms.join(parts, "bigram").where(within).groupBy("id", "p", "q", "n", "template_id", "license", "m").agg(
        F.count_distinct("bigram").alias("c"))
    dice = shared.withColumn("dice", 2 * F.col("c") / (F.col("n") + F.col("m"))).where(F.col("dice") >= threshold)
    return dice.groupBy("id", "license").agg(F.max("dice").alias("dice"), F.count_distinct("p", "q").alias("n_passages"))
