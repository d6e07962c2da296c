"""License scan by diagonal voting.

Templates are short fixed phrases.  All rolling word k-grams (k = 2) of the documents are joined by hash to
the positions of the same k-gram in a template; the words themselves confirm the hash.  A hit votes
for the diagonal (place in the document minus place in the template).  A diagonal with all votes is an exact place of the
phrase.  For the other wordings, neighbouring diagonals, from one to ``DRIFT`` further, are merged to a span, so words of a span are in the
template's order with at most DRIFT words put in.  The span is verified by what it holds of the template: the k-gram that
tells the wording from others, and enough of the rest, so that one changed or missing word passes and scattered ones don't.

Hits are aggregated by (document, template, diagonal) before they are shuffled; the templates are a
fixed list of a few hundred k-grams, so their broadcast has a known size.

Cases: null and empty texts have no words and no labels; rows that repeat an id and its text are read alike and give a
row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import following, repeated, row_key, words

K = 2
DRIFT = 2
SHARE = 0.6

#: Phrases whose every place counts, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings that are recognised with gaps and changed words: label, and the k-gram that tells it from other labels (the dedications to the public domain share theirs).
WORDINGS = {
    "licensed under cc by nc": ("cc-by-nc", "by nc"),
    "licensed under cc by sa": ("cc-by-sa", "by sa"),
    "licensed under cc by nd": ("cc-by-nd", "by nd"),
    "creative commons attribution noncommercial license": ("cc-by-nc", "attribution noncommercial"),
    "creative commons attribution sharealike license": ("cc-by-sa", "attribution sharealike"),
    "creative commons attribution noderivatives license": ("cc-by-nd", "attribution noderivatives"),
    "licensed under a creative commons attribution license": ("cc-by", "attribution license"),
    "released under the cc0 1 0 universal public domain dedication": ("cc0", "domain dedication"),
    "released under the mit license": ("mit", "mit license"),
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("mit", "hereby granted"),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", "and or"),
    "licensed under the apache license version": ("apache", "apache license"),
    "this work is licensed under the gnu general public license version": ("gpl", "gnu general"),
    "gnu lesser general public license": ("lgpl", "lesser general"),
    "gnu affero general public license": ("agpl", "affero general"),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", "binary forms"),
    "this source code form is subject to the terms of the mozilla public license": ("mpl", "mozilla public"),
    "made available under the terms of the eclipse public license": ("epl", "eclipse public"),
    "this is free and unencumbered software released into the public domain": ("unlicense", "unencumbered software"),
    "released into the public domain": ("public-domain", "public domain"),
}


def template_rows() -> list[tuple]:
    """(template, label, base, last k-gram, hits a span needs, place of the telling k-gram, words) of each phrase."""
    rows = []
    for phrase, (label, telling) in [(p, (v, None)) for p, v in BASE_PHRASES.items()] + list(WORDINGS.items()):
        w = phrase.split(" ")
        n = len(w) - K + 1
        tells = next((i for i in range(n) if telling == " ".join(w[i:i + K])), 0)
        rows.append((len(rows), label, telling is None, n - 1, n if telling is None else max(2, min(n - 2, math.ceil(SHARE * n))), tells, w))
    return rows


def templates(spark: SparkSession) -> DataFrame:
    """One row per template position: template, label, base, last, need, tells, t_pos, g0, g1."""
    rows = [(*head, i, w[i], w[i + 1]) for *head, w in template_rows() for i in range(len(w) - K + 1)]
    kinds = "template int, label string, base boolean, last int, need int, tells int, t_pos int, g0 string, g1 string"
    return spark.createDataFrame(rows, kinds).withColumn("key", F.xxhash64("g0", "g1"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans by document (id and text hash; ``copies``: number of such rows), template and first diagonal (``start``), whether ``exact`` and whether verified, and their share of the template; a
    document without any has one row without a template."""
    at = (docs.select(row_key(id_col, text_col).alias("doc"), words(F.col(text_col)).alias("w"))
              .select("doc", F.size("w").cast("long").alias("n_words"), following(F.col("w"), K).alias("z"))
              .select("doc", "n_words", F.posexplode_outer("z").alias("pos", "v")))
    voted = at.join(F.broadcast(templates(docs.sparkSession)),
                    (F.xxhash64("v.w0", "v.w1") == F.col("key")) & (F.col("v.w0") == F.col("g0")) & (F.col("v.w1") == F.col("g1")), "left")
    voted = voted.where(F.col("key").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0))
    diagonals = (voted.groupBy("doc", "template", "label", "base", "last", "need", "tells", (F.col("pos") - F.col("t_pos")).cast("long").alias("start"))
                      .agg(F.max("n_words").alias("n_words"), F.collect_set("t_pos").alias("met"), F.count(F.lit(1)).alias("votes")))
    near = Window.partitionBy("doc", "template").orderBy("start").rangeBetween(0, DRIFT)
    spans = diagonals.withColumn("held", F.array_distinct(F.flatten(F.collect_list("met").over(near))))
    # A row votes once for a place of the template on a diagonal, so votes beyond that are of rows that repeat the id and the text.
    copies = F.floor(F.col("votes") / F.greatest(F.size("met"), F.lit(1))).cast("long")
    return spans.select("doc", copies.alias("copies"), "n_words", "template", "label", "base", "start", (F.size("met") == F.col("last") + 1).alias("exact"),
                        (F.array_contains("held", F.col("tells")) & (F.size("held") >= F.col("need"))).alias("verified"), (F.size("held") / (F.col("last") + 1)).alias("share"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spans = license_spans(docs, id_col, text_col)
    base = F.col("base") & F.col("exact")
    kept = base | (~F.col("base") & F.col("verified"))
    listed = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return repeated(spans.groupBy("doc").agg(
        F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(kept).alias("labels"),
        F.coalesce(F.max(F.when(kept, F.least(F.col("share"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
    ).select(F.col("doc.id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "copies"), "copies")
