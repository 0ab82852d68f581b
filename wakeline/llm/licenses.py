"""License scans by diagonal voting. DataFrame functions only.

Hashes of all rolling word trigrams of a text meet the trigram positions of license templates in a join;
hits vote for diagonals (text position less template position), neighbouring diagonals merge, and a merged
span counts if its words cover enough of the template and of the span itself. Licenses share much of their wording:
where spans lie on one another, the template that is covered best names the license.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wakeline.session import stage

from .common import body, let, lower_az, row_key, upto

GRAM = 3
NEAR = 3  # diagonals this close belong to one span: words put in or left out
MIN_COVERAGE = 0.4
MISSING = 0.01  # of the square of a template's length: no word of a notice of nine, two of 15, nine of 30
MIN_SPAN = 0.75

# What ends a word, and the phrases of the base labels.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public licenses and usual notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "released under cc by 4 0"),
    ("cc-by-sa", "released under cc by sa 4 0"),
    ("cc-by-nc", "released under cc by nc 4 0"),
    ("apache-2", "apache license version 2 0"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license version 2 1"),
    ("lgpl", "gnu lesser general public license version 3"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license version 3"),
    ("gpl-2", "gnu gpl v2"),
    ("gpl-3", "gnu gpl v3"),
    ("lgpl", "gnu lgpl v3"),
    ("agpl", "gnu agpl v3"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-2", "spdx license identifier gpl 2 0"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("lgpl", "spdx license identifier lgpl 2 1"),
    ("lgpl", "spdx license identifier lgpl 3 0"),
    ("agpl", "spdx license identifier agpl 3 0"),
    ("bsd", "spdx license identifier bsd 2 clause"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("isc", "spdx license identifier isc"),
    ("unlicense", "spdx license identifier unlicense"),
    ("cc-by", "spdx license identifier cc by 4 0"),
    ("cc-by-sa", "spdx license identifier cc by sa 4 0"),
    ("cc-by-nc", "spdx license identifier cc by nc 4 0"),
    ("all-rights-reserved", "all rights reserved"),
]


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(text), BREAK), "")


def _grams(w: Column) -> Column:
    return F.transform(upto(F.size(w) - (GRAM - 1)), lambda i: F.xxhash64(*[w[i + j] for j in range(GRAM)]))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """label, template, n_template, h, tpos: one row per trigram of a template; the list is a fixed parameter."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, label string, text string")
    frame = frame.select("template", "label", license_words(F.col("text")).alias("w"))
    return frame.select("template", "label", F.size("w").alias("n_template"), F.posexplode(_grams(F.col("w"))).alias("tpos", "h"))


def _ordinals(starts: Column, n: int = GRAM) -> Column:
    """The distinct words that windows of ``n`` words at ``starts`` cover."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(*[p + j for j in range(n)]))))


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """key, label, template, first_word, end_word, covered (words), coverage (of the template), purity (of the span).

    Of spans that lie on one another by more than half of the shorter, those stay whose template fits best (coverage
    times purity), then those with most covered words; equal ones all stay. Rows with one id and one text are one document; null and
    short texts have no trigram.
    """
    grams = template_grams(docs.sparkSession, templates or TEMPLATES)
    texts = docs.select(row_key().alias("key"), F.posexplode(let(license_words(body()), _grams)).alias("pos", "h"))
    # the template list is code, a few hundred trigrams
    hits = texts.join(F.broadcast(grams), "h").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    votes = hits.groupBy("key", "template", "label", "n_template", "diagonal").agg(
        F.collect_set("pos").alias("at"), F.collect_set("tpos").alias("tat")
    )
    # windows over the diagonals that one document has with one template
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    votes = votes.withColumn("fresh", F.when(step <= NEAR, 0).otherwise(1))
    votes = votes.withColumn("span", F.sum("fresh").over(order))
    spans = votes.groupBy("key", "template", "label", "n_template", "span").agg(
        _ordinals(F.flatten(F.collect_list("at"))).alias("words"),
        F.size(_ordinals(F.flatten(F.collect_list("tat")))).alias("covered"),
    )
    first, end = F.array_min("words"), F.array_max("words") + 1
    spans = spans.select(
        "key",
        "label",
        "template",
        "n_template",
        first.cast("long").alias("first_word"),
        end.cast("long").alias("end_word"),
        F.col("covered").cast("long").alias("covered"),
        (F.col("covered") / F.col("n_template")).alias("coverage"),
        (F.size("words") / (end - first)).alias("purity"),
    )
    missing = F.col("n_template") - F.col("covered")
    whole = missing <= F.floor(F.col("n_template") * F.col("n_template") * F.lit(MISSING) + 1e-9)
    spans = spans.where(whole & (F.col("coverage") >= MIN_COVERAGE) & (F.col("purity") >= MIN_SPAN)).drop("n_template")
    names = [c for c in spans.columns if c != "key"]
    # the verified spans of one document, a few for each license it names
    per_doc = spans.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("spans"))

    def beaten(x: Column) -> Column:
        size = lambda y: y["end_word"] - y["first_word"]
        shared = lambda y: F.least(x["end_word"], y["end_word"]) - F.greatest(x["first_word"], y["first_word"])
        fit = lambda y: F.struct(y["coverage"] * y["purity"], y["covered"])
        better = lambda y: fit(y) > fit(x)
        return F.exists("spans", lambda y: (y["label"] != x["label"]) & (2 * shared(y) > F.least(size(x), size(y))) & better(y))

    return per_doc.select("key", F.inline(F.filter("spans", lambda x: ~beaten(x))))


def _places(w: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand one after another; most texts lack one of them and are not searched."""
    parts = phrase.split()
    here = lambda i: F.slice(w, i + 1, len(parts)) == F.array(*map(F.lit, parts))
    rare = max(parts, key=len) if len(max(parts, key=len)) > 3 else parts[0]
    return F.when(
        F.array_contains(w, rare), F.filter(upto(F.size(w) - (len(parts) - 1)), here)
    ).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans for every row of ``docs``.

    score: 1 where a base phrase stands, else the largest template coverage of the verified spans, else 0.
    A null text is empty; rows with one id and one text each get that document's row; an empty table gives an
    empty result; other columns are not read.
    """

    def base(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            *[_places(w, phrase).alias(label) for phrase, label in PHRASES.items()],
        )

    rows = docs.select(row_key().alias("key"), let(license_words(body()), base).alias("b"))
    rows = stage(rows, "licenses")
    found = license_spans(docs, templates).groupBy("key").agg(
        F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"), F.count("*").alias("n_spans")
    )
    rows = rows.join(found, "key", "left")
    names = sorted(PHRASES.values())
    places = F.concat(*[F.col(f"b.`{x}`") for x in names])
    own = F.filter(
        F.array(*[F.when(F.size(F.col(f"b.`{x}`")) > 0, F.lit(x)) for x in names]), lambda x: x.isNotNull()
    )
    none = F.array().cast("array<string>")
    return rows.select(
        "key",
        F.col("b.n_words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
