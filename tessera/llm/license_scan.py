"""License scans by diagonal voting, as joins and aggregates.

All rolling k-grams of the documents' words are joined by hash to the places of the templates' k-grams.
A match votes for a diagonal, the place in the document minus the place in the template.  Diagonals
with too few votes leave, neighbouring ones merge, so that words put in or left out don't break a match,
and the span is verified: enough of the template's k-grams must have been found in it, the last one
too, in about its length.  Short templates go by word pairs, longer ones by longer k-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, quoted

#: Phrases and their labels; every place where a phrase's words stand consecutively counts.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Well-known wordings of licenses and notices, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Whole licenses, and their labels.
LICENSES = {
    """
    permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
    software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
    distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
    the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions
    of the software the software is provided as is without warranty of any kind express or implied including but not limited to the
    warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders
    be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
    connection with the software or the use or other dealings in the software
    """: "mit-text",
    """
    permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
    above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
    warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be
    liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
    whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of
    this software
    """: "isc-text",
    """
    redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are
    met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors
    as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
    particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
    special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or
    profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including
    negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage
    """: "bsd-2-clause-text",
    """
    licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain
    a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
    distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
    see the license for the specific language governing permissions and limitations under the license
    """: "apache-2.0-notice",
    """
    this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
    the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope
    that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
    see the gnu general public license for more details
    """: "gpl-3.0-notice",
    """
    this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
    arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
    applications and to alter it and redistribute it freely subject to the following restrictions
    """: "zlib-text",
}
#: Offset of diagonals that still merge; share of a notice's k-grams that verifies it.
DRIFT, ENOUGH = 2, 0.7
#: Words of a k-gram for templates of so many words or more; a diagonal counts with one vote in so many k-grams.
GRAMS, VOTES = {0: 2, 24: 4}, 50
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def gram_words(length: int) -> int:
    """k for a template of this many words."""
    return max(k for least, k in GRAMS.items() if length >= least)


def gram_hash(k: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(k), *words)


def template_tables(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> tuple[DataFrame, DataFrame]:
    """(t, i, gram) of each template's k-grams, and (t, length, label, exact, grams)."""
    rows, names = [], []
    for t, (phrase, label, exact) in enumerate(templates):
        words = phrase.split()
        k = gram_words(len(words))
        rows += [(t, i, k, words[i : i + k]) for i in range(len(words) - k + 1)]
        names.append((t, len(words), label, exact, len(words) - k + 1, k))
    places = spark.createDataFrame(rows, "t int, i int, k int, words array<string>")
    by_k = F.coalesce(*[F.when(F.col("k") == k, gram_hash(k, [F.col("words")[j] for j in range(k)])) for k in set(GRAMS.values())])
    return places.select("t", "i", by_k.alias("gram")), spark.createDataFrame(names, "t int, length int, label string, exact boolean, grams int, k int")


def scan_licenses(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``phrases`` count exactly, at every place; ``notices`` (else ``NOTICES`` and ``LICENSES``) count where a
    span verifies; any number, of any length from two words.  ``labels`` are the distinct sorted labels of
    both, comma-joined; ``score`` is the largest share of a template's k-grams in a span, 1 for a phrase;
    ``spans`` lists (label, first_word, words, share).

    Null and empty texts have no words; a document without matches has null places, empty labels and score
    0.  Texts of any length are taken whole.  Rows that repeat id and text are scanned once and given as
    often as they stand; null ids are a value like any other; other columns aren't read.
    """
    templates = [(p, v, True) for p, v in (PHRASES if phrases is None else phrases).items()]
    templates += [(p, v, False) for p, v in (NOTICES | LICENSES if notices is None else notices).items()]
    if any(len(p.split()) < 2 for p, _, _ in templates):
        raise ValueError("a template needs two words")
    places, names = template_tables(documents.sparkSession, templates)
    sizes = sorted({gram_words(len(p.split())) for p, _, _ in templates}) or [2]
    text = quoted(text_column).cast("string")
    clean = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    words = documents.select(F.xxhash64(quoted(id_column), text).alias("row"), quoted(id_column).alias("id"), F.split(clean, " ").alias("words"))
    words = words.withColumn("n_words", F.when(F.col("words")[0] == "", 0).otherwise(F.size("words")).cast("long"))
    run_of = F.arrays_zip(*[(F.col("words") if j == 0 else F.slice("words", j + 1, F.size("words"))).alias(f"w{j}") for j in range(sizes[-1])])
    each = words.select("row", "id", "n_words", F.posexplode(run_of).alias("at", "run"))
    grams = F.array(*[gram_hash(k, [F.col(f"run.w{j}") for j in range(k)]) for k in sizes])
    each = each.select("row", "id", "n_words", "at", F.posexplode(grams).alias("kind", "gram"))
    # The first gram of each document goes along unmatched too: it stands for the document.
    matched = each.join(F.broadcast(places), "gram", "left").where(F.col("t").isNotNull() | (F.col("at") == 0) & (F.col("kind") == 0))
    matched = matched.groupBy("row", "id", "n_words", "t", "i", "at").agg(F.count("*").alias("times"))
    matched = matched.withColumn("diagonal", F.col("at") - F.col("i")).join(F.broadcast(names), "t", "left")
    on_one = Window.partitionBy("row", "t", "diagonal")
    voted = matched.withColumn("votes", F.count("*").over(on_one)).where(F.col("t").isNull() | (F.col("at") == 0) | (VOTES * F.col("votes") >= F.col("grams")))
    order = Window.partitionBy("row", "t").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    fresh_run = (step.isNull() | (step > F.when(F.col("exact"), 0).otherwise(DRIFT))).cast("int")
    runs = voted.withColumn("fresh", F.when(F.col("t").isNull(), 0).otherwise(fresh_run)).withColumn("run", F.sum("fresh").over(order))
    found = runs.groupBy("row", "id", "n_words", "t", "length", "label", "exact", "grams", "k", "run", "i").agg(F.min("at").alias("from"), F.max("at").alias("to"), F.max("times").alias("times"))
    merged = found.groupBy("row", "id", "n_words", "t", "length", "label", "exact", "grams", "k", "run").agg(
        F.count("i").alias("n"), F.min("from").alias("from"), F.max("to").alias("to"), F.max("i").alias("last"), F.max("times").alias("times")
    )
    share = F.col("n") / F.col("grams")
    ended = F.col("last") == F.col("grams") - 1  # a version stands at the end
    n_span = F.col("to") - F.col("from") + F.col("k")
    good = F.when(F.col("exact"), share == 1).otherwise(ended & (share >= ENOUGH) & (n_span <= 2 * F.col("length")))
    spans = merged.select("row", "id", "n_words", "times", "label", "exact", F.col("from").cast("long").alias("from"), n_span.cast("long").alias("words"), F.when(good, share).alias("share"))
    base = F.col("share").isNotNull() & F.col("exact")
    span = F.struct("label", F.col("from").alias("first_word"), "words", "share")
    summed = spans.groupBy("row", "id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("from"))).alias("first_word"), F.max(F.when(base, F.col("from"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("share").isNotNull(), span))).alias("spans"), F.max("times").alias("times"),
    )
    labels = F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["label"])))
    out = summed.select("id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score", "spans", "times")
    return out.where("times = 1").unionByName(out.where("times > 1").withColumn("times", F.explode(F.array_repeat("times", F.col("times").cast("int"))))).drop("times")
