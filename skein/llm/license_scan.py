"""License scan: MinHash bands over text windows retrieve templates, shingles verify them.

Words are lower-cased runs of letters and digits; a shingle is three words in a
row.  Windows of ``WINDOW`` shingles overlap by half.  A window or template
part has one minimum per hash function, and every function is a band of one
row: a window that holds a part of ``n`` shingles whole shares a band with it
with probability 1 - (1 - n / WINDOW) ** BANDS, over 0.9998 for one shingle and
more with every further one; both windows over a passage count.
Windows that hold no template shingle at all cannot share a minimum, so their
minima are not computed.  A retrieved template is verified exactly: the share
of its distinct shingles (compared as words) that stand within its own length
around the window must reach ``CONTAINMENT``.

Templates are a fixed, short list, so the joined side is bounded by it.  Null
and empty texts, and texts of one or two words, have no shingles and no licenses.
Repeated rows repeat; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import stored

# Well-known license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted.",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
NOT_WORD = r"[^\p{L}\p{N}]+"
WINDOW = 8
STEP = WINDOW // 2
BANDS = 64
BROADCAST_WORDS = 20_000
CONTAINMENT = 0.9


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _hashes(words: str) -> Column:
    """Shingle hashes in order; empty for fewer than three words."""
    w = F.col(words)
    return F.when(
        F.size(words) > 2,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
    ).otherwise(F.array().cast("array<bigint>"))


def _spelled(words: str) -> Column:
    """Shingles as text, in order."""
    w = F.col(words)
    return F.when(
        F.size(words) > 2,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2])),
    ).otherwise(F.array().cast("array<string>"))


def _bands(shingles: Column) -> Column:
    """One (band, minimum) per hash function."""
    return F.array(
        *[
            F.struct(
                F.lit(b).alias("band"),
                F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(b)))).alias("least"),
            )
            for b in range(BANDS)
        ]
    )


def _windows(count: Column) -> Column:
    """Start shingles of the windows over ``count`` shingles."""
    last = F.greatest(F.ceil((count - WINDOW) / STEP), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * STEP)


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license, words, shingles, hashes) of every template."""
    rows = spark.createDataFrame(sorted(texts.items()), "license string, text string")
    worded = rows.withColumn("words", _words(F.col("text"))).withColumn("hashes", _hashes("words"))
    return worded.select("license", "words", F.array_distinct(_spelled("words")).alias("shingles"), "hashes")


def find_licenses(
    docs: DataFrame, texts: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id`` and ``licenses`` (license, containment, first word), by name."""
    spark = docs.sparkSession
    known = templates(spark, texts)
    # The template list is a parameter of the call; its own shingles and lengths come back from it.
    sizes = F.size("words")
    hashes, reach, n_words = known.select(
        F.array_distinct(F.flatten(F.collect_list("hashes"))), F.max(sizes), F.sum(sizes)
    ).first()
    parts = known.select(
        "license", "shingles", F.explode(_windows(F.size("hashes"))).alias("at"), "hashes"
    ).select("license", "shingles", F.explode(_bands(F.slice("hashes", F.col("at") + 1, F.lit(WINDOW)))).alias("b"))
    parts = parts.select("license", "shingles", "b.band", "b.least").distinct()

    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("row", F.xxhash64("doc_id", "text"))
    shingled = base.select("doc_id", "row", _words(F.col("text")).alias("words")).withColumn("hashes", _hashes("words"))
    h = F.col("hashes")
    spots = F.filter(
        F.transform(h, lambda x, i: F.when(x.isin(hashes), i)), lambda i: i.isNotNull()
    )
    shingled = shingled.withColumn("spots", spots)
    # Every window that covers a spot: two of them, but at the ends of the text.
    last = F.greatest(F.ceil((F.size("hashes") - WINDOW) / STEP), F.lit(0)).cast("int")
    near = F.array_distinct(
        F.flatten(
            F.transform(
                "spots",
                lambda i: F.array(
                    F.least(F.floor(i / STEP).cast("int"), last),
                    F.least(F.greatest(F.floor(i / STEP).cast("int") - 1, F.lit(0)), last),
                ),
            )
        )
    )
    # The outer form: a filter on the array would be pushed down and split the words anew for each.
    windows = shingled.withColumn("k", F.explode_outer(near)).filter("k is not null")
    windows = windows.withColumn("at", F.col("k") * STEP)
    around = F.greatest(F.col("at") - reach, F.lit(0))
    windows = windows.select(
        "doc_id",
        "row",
        "at",
        F.slice("hashes", F.col("at") + 1, F.lit(WINDOW)).alias("own"),
        around.alias("from"),
        F.slice("words", around + 1, F.lit(2 * reach + WINDOW + 1)).alias("words"),
    )
    banded = windows.select("doc_id", "row", "at", "from", "words", F.explode(_bands(F.col("own"))).alias("b"))
    # The templates are bounded by a check of their words; past it the join is left to Spark.
    side = F.broadcast(parts) if n_words <= BROADCAST_WORDS else parts
    met = banded.join(
        side, (F.col("b.band") == parts["band"]) & (F.col("b.least") == parts["least"])
    ).select("doc_id", "row", "at", "from", "license", "shingles", "words")
    met = met.withColumn("spelled", _spelled("words"))
    there = F.array_intersect("shingles", "spelled")
    checked = met.withColumn("containment", F.size(there) / F.size("shingles")).filter(
        F.col("containment") >= CONTAINMENT
    )
    known_here = F.transform("spelled", lambda x: F.array_contains("shingles", x))
    first = F.col("from") + F.array_position(known_here, True) - 1
    found = checked.groupBy("doc_id", "row", "license").agg(
        F.max("containment").alias("containment"), F.min(first).alias("first_word")
    )
    by_row = found.groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("license", "containment", "first_word"))).alias("licenses")
    )
    by_row = stored(by_row, "licenses").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "licenses")
    rows = base.select("doc_id", "row")
    same = rows["doc_id"].eqNullSafe(by_row["_id"]) & (rows["row"] == by_row["_row"])
    none = F.array().cast("array<struct<license:string,containment:double,first_word:bigint>>")
    return rows.join(by_row, same, "left").select("doc_id", F.coalesce("licenses", none).alias("licenses"))
