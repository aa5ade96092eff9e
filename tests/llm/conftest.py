from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Small document tables: docs([(id, text), ...]) or docs([(id, text, lang), ...])."""

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", f"src{i % 3}", None if r[1] is None else len(r[1]))
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    """Nulls anywhere, empty and very long texts, repeated rows, ties."""
    words = " ".join(f"wört{i % 977} and the {i}" for i in range(20_000))
    return [
        (1, None),
        (2, ""),
        (3, "   \n\t "),
        (4, "short"),
        (5, words),
        (5, words),
        (6, words[:-9]),
        (7, "!!!\x00\x1c   é"),
        (8, "same text here"),
        (9, "same text here"),
        (9, "other text of the same id"),
        (None, "no id"),
        (10, "𝔘nicode 💥 text"),
    ]


@pytest.fixture
def with_clashes():
    """Extra columns whose names an operator may use inside."""

    def add(df):
        from pyspark.sql import functions as F

        for name in ("spans", "shard", "slot", "grp", "words", "key", "_row", "_key", "kept", "n", "row", "size"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return add
