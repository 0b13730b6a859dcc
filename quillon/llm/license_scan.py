"""License scans by diagonal voting (built-in functions only).

Every rolling word 3-gram of a text is hashed and joined to the positions of that 3-gram in the templates. A hit
votes for the diagonal (position in text - position in template). Votes are counted per document, template and
diagonal as a bit mask over template positions; neighbouring diagonals, which a few inserted or missing words
produce, are merged; a merged span counts when its mask covers enough of the template.

Phrases are short templates that must be covered whole on one diagonal, which is the same as standing
consecutively. The longer templates are opening sentences of public licences and need only `coverage`.

Defined results: a null text counts as empty and has no words; places are counted once for each start; rows that
repeat a doc_id are scanned by themselves; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import text_of

#: What separates words (a fixed value): ASCII but for letters and digits.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that give a label wherever they stand (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Sentences of the public licence texts (fixed values).
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
    "apache org licenses license 2 0": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution noncommercial": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


@dataclass(frozen=True)
class LicenseOptions:
    coverage: float = 0.6  # of a template's 3-grams, for a label
    neighbours: int = 3  # diagonals at most so far apart are merged


#: Words that no text holds, for they are made of a separator: every text ends with one gram of them.
END = "\x00"
GRAM = 3


def _templates() -> list[tuple]:
    rows: list[tuple] = [(END, END, END, -1, 0, 1, "", False)]
    for i, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()]):
        words = text.split(" ")
        grams = len(words) - GRAM + 1
        if not 1 <= grams <= 62:
            raise ValueError("a template has 3 to 64 words")
        rows += [(*words[p : p + GRAM], i, p, grams, label, i < len(PHRASES)) for p in range(grams)]
    return rows


def words_of(column: str = "text") -> Column:
    """The words, perhaps between empty strings. Only A-Z lower-case to letters that the templates hold."""
    return F.split(F.lower(text_of(column)), NO_WORD)


def scan_licenses(docs: DataFrame, options: LicenseOptions = LicenseOptions()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of docs."""
    spark = docs.sparkSession
    table = spark.createDataFrame(
        _templates(), "t0 string, t1 string, t2 string, template int, at int, grams int, label string, base boolean"
    ).withColumn("gram", F.xxhash64("t0", "t1", "t2"))
    lead = (F.get("words", F.lit(0)) == "").cast("int")
    tail = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    every = F.lit(2**31 - 1)
    grams = (
        docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), words_of().alias("words"))
        .withColumns({"lead": lead, "n_words": (F.size("words") - lead - tail).cast("long")})
        .withColumn("words", F.concat("words", F.array(*[F.lit(END)] * GRAM)))
        .select(
            "doc_id", "row_no", "lead", "n_words",
            F.posexplode(F.arrays_zip(
                F.col("words").alias("w0"), F.slice("words", F.lit(2), every).alias("w1"), F.slice("words", F.lit(3), every).alias("w2"),
            )).alias("pos", "g"),
        )
        .select(
            "doc_id", "row_no", "n_words", (F.col("pos") - F.col("lead")).cast("long").alias("pos"),
            F.col("g.w0").alias("w0"), F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2"),
            F.xxhash64("g.w0", "g.w1", "g.w2").alias("gram"),
        )
    )
    # The templates are a fixed table of a few hundred rows. Words are compared too: no hit rests on a hash alone.
    hits = grams.join(F.broadcast(table), "gram").filter("w0 = t0 AND w1 = t1 AND w2 = t2")
    row = ["doc_id", "row_no", "n_words"]
    kind = ["template", "grams", "label", "base"]
    diagonals = hits.groupBy(*row, *kind, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask")
    )
    along = Window.partitionBy(*row, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > options.neighbours
    # A phrase stands on one diagonal; longer templates may drift over neighbouring ones.
    opens = (F.col("base") | F.coalesce(apart, F.lit(True))).cast("int")
    spans = (
        diagonals.withColumn("opens", opens)
        .withColumn("span", F.sum("opens").over(along))
        .groupBy(*row, *kind, "span")
        .agg(F.bit_or("mask").alias("mask"), F.min("diagonal").alias("start"))
        .withColumn("covered", F.bit_count("mask") / F.col("grams"))
    )
    real = F.col("template") >= 0
    whole = real & F.col("base") & (F.col("covered") == 1.0)
    found = whole | (real & ~F.col("base") & (F.col("covered") >= options.coverage))
    joined = lambda ok: F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("label")))), ",")
    return spans.groupBy(*row).agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).alias("first_word"),
        F.max(F.when(whole, F.col("start"))).alias("last_word"),
        joined(whole).alias("base_labels"),
        joined(found).alias("labels"),
        F.max(F.when(real, F.col("covered")).otherwise(0.0)).alias("score"),
    ).drop("row_no")
