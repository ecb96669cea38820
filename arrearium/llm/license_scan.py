"""License scans: a positional rare-token index over licence notices.

Every notice becomes postings (word, template, position). Its rarest words nominate alignments (template, file
position - template position): those of highest IDF, as many as weigh together more than an alignment may lack, so
that whatever reaches the coverage holds one of them, whatever else stands in its file. The postings of all licence
words are intersected at nominated alignments only; one counts when its IDF-weighted coverage is high enough and
every word of the template's mandatory key phrase stands in place.

Document frequencies are counted over the whole table. One pass tokenizes (inside the row, built-in
functions only) and leaves just the licence words with their positions; that small table is made durable
and everything after it moves only those words.

Defined results: null and empty texts have n_words 0, no labels and score 0; rows are scanned one by one, so
repeated rows and null ids are scanned each for itself; an empty table gives an empty table; columns of the
input with the names of output columns are replaced, others are carried along by `license_scan`'s caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import durable, let, lower_ascii

#: Phrases of the base rule and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Fixed values: (label, notice, mandatory key phrase); public licence notices in lower case, without punctuation.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "public domain by waiving all"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file"),
]

#: Words too common to be postings; a key phrase is verified on its other words, in place.
COMMON = "a all and any are as at by for his her in into is it may not of on or the this to use used via we with without you your".split()

#: Runs of ASCII characters that belong to no word, upper-case letters being words before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
COVERAGE = 0.7


def scan_words(text: Column) -> Column:
    """Words of a text, with A-Z lower-cased."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def postings(templates: list[tuple[str, str, str]] = TEMPLATES) -> list[tuple[str, int, str, int, bool]]:
    """(word, template number, label, position, belongs to the key phrase); as many rows as the notices have rare words."""
    rows = []
    for t, (label, notice, key) in enumerate(templates):
        words, phrase = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        rows += [(w, t, label, i, at <= i < at + len(phrase)) for i, w in enumerate(words) if w not in COMMON]
    return rows


def rare_postings(weighed: DataFrame, totals: DataFrame, coverage: float) -> DataFrame:
    """The rarest postings of each template, until what they weigh together is more than an alignment may lack.

    An alignment that reaches the coverage isn't without all of them. Ties in weight go by position.
    """
    before = F.coalesce(F.sum("idf").over(W.partitionBy("t").orderBy(F.desc("idf"), "tpos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return weighed.withColumn("__before", before).join(totals, "t").filter(F.col("__before") <= F.col("whole") * (1 - coverage + 1e-9))


def license_scan(
    docs: DataFrame,
    templates: list[tuple[str, str, str]] = TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score and `places` (label, start, coverage)."""
    spark, index = docs.sparkSession, postings(templates)
    keys = [(p.split(), label) for p, label in phrases]
    vocabulary = sorted({w for w, *_ in index} | {w for p, _ in keys for w in p if w not in COMMON})

    def places_of(phrase: list[str], label: str, words: Column, hits: Column) -> Column:
        a = next(i for i, w in enumerate(phrase) if w not in COMMON)

        def here(h: Column) -> Column:
            ok = h["word"] == phrase[a]
            for k, w in enumerate(phrase):
                ok = ok & F.coalesce(F.get(words, h["pos"] + (k - a)) == w, F.lit(False))
            return ok

        return F.transform(F.filter(hits, here), lambda h: F.struct((h["pos"] - a).alias("pos"), F.lit(label).alias("label")))

    def base(words: Column, hits: Column) -> Column:
        return F.concat(*[places_of(phrase, label, words, hits) for phrase, label in keys])

    def scan(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word")))), lambda h: h.isNotNull())
        return let(hits, lambda h: F.struct(F.size(words).cast("bigint").alias("n_words"), h.alias("hits"), base(words, h).alias("base")))

    s = F.col("__scan")
    scanned = durable(
        docs.select(F.col(f"`{id_col}`").alias("__id"), let(scan_words(F.col(f"`{text}`")), scan).alias("__scan")).select(
            F.monotonically_increasing_id().alias("__row"),
            "__id",
            s["n_words"].alias("n_words"),
            s["hits"].alias("__hits"),
            F.size(s["base"]).cast("bigint").alias("n_base"),
            F.array_min(F.transform(s["base"], lambda x: x["pos"])).cast("bigint").alias("first_word"),
            F.array_max(F.transform(s["base"], lambda x: x["pos"])).cast("bigint").alias("last_word"),
            F.array_distinct(F.transform(s["base"], lambda x: x["label"])).alias("__base"),
        )
    )
    hits = scanned.filter(F.size("__hits") > 0).select("__row", F.explode("__hits").alias("h")).select("__row", "h.pos", "h.word")
    # One row for each word of the notices: bounded by the templates, not by the corpus.
    idf = hits.groupBy("__row", "word").agg(F.lit(1).alias("one")).groupBy("word").agg(F.count("*").alias("df"))
    n_docs = scanned.count()
    idf = idf.select("word", F.log((F.lit(n_docs) + 1.0) / F.col("df")).alias("idf"))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("tpos", T.IntegerType()), T.StructField("is_key", T.BooleanType())])
    posts = spark.createDataFrame(index, schema)
    # A word that no document has weighs as much as one that a single document has.
    weighed = durable(posts.join(F.broadcast(idf), "word", "left").withColumn("idf", F.coalesce("idf", F.log(F.lit(n_docs) + 1.0))))
    totals = weighed.groupBy("t").agg(F.sum("idf").alias("whole"), F.sum(F.col("is_key").cast("int")).alias("n_keys"))
    rare = rare_postings(weighed, totals, coverage)
    start = (F.col("pos") - F.col("tpos")).alias("start")
    nominated = hits.join(F.broadcast(rare.select("word", "t", "tpos")), "word").select("__row", "t", start).distinct()
    aligned = (
        hits.join(F.broadcast(weighed), "word")
        .select("__row", "t", "label", start, "idf", "is_key")
        .join(nominated, ["__row", "t", "start"], "left_semi")
        .groupBy("__row", "t", "label", "start")
        .agg(F.sum("idf").alias("found"), F.sum(F.col("is_key").cast("int")).alias("keys"))
        .join(F.broadcast(totals), "t")
        .withColumn("coverage", F.col("found") / F.col("whole"))
        .filter((F.col("keys") == F.col("n_keys")) & (F.col("coverage") >= coverage))
    )
    places = aligned.groupBy("__row").agg(
        F.max("coverage").alias("__best"),
        F.collect_set("label").alias("__labels"),
        F.sort_array(F.collect_list(F.struct("start", "label", "coverage"))).alias("places"),
    )
    none = F.array().cast("array<string>")
    out = scanned.join(places, "__row", "left")
    return out.select(
        F.col("__id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("__base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", F.coalesce("__labels", none))), ",").alias("labels"),
        F.greatest(F.least(F.coalesce("__best", F.lit(0.0)), F.lit(1.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        "places",
    )
