from __future__ import annotations

import random

import brute
from pyspark.sql import functions as F

from skein.llm import label_shards, quality_rules
from skein.llm.queries import op2_label_propagation_shards, op9_distribution_divergence

SF_DIR = f"{brute.TESTDATA}/sf0.001"


def test_quality_counts_of_the_table(spark):
    got = {r["doc_id"]: r for r in op9_distribution_divergence(spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = brute.quality(r["text"])
        assert {k: got[r["doc_id"]][k] for k in want} == want
        assert not (want["base_failed"] and got[r["doc_id"]]["kept"])


def test_quality_counts_of_odd_rows(docs, odd_rows, with_clashes):
    repeated = "a b c d a b c d\n\nx\nx\n#% |\r\n x" * 3
    rows = [*odd_rows, (20, repeated), (21, "a b"), (22, "a b c"), (23, "one two three\vone two three")]
    got = quality_rules.measure(with_clashes(docs(rows))).collect()
    names = list(brute.quality(""))
    want = sorted(repr((r[0], list(brute.quality(r[1]).values()))) for r in rows)
    assert sorted(repr((r["doc_id"], [r[k] for k in names])) for r in got) == want
    assert quality_rules.measure(docs([])).count() == 0


def prose(i, n=120):
    words = ("the of and to in a is that for it was on are as with be river stone light " + "walk garden paper").split()
    draw = random.Random(i)
    return " ".join(draw.choice(words) for _ in range(n)) + "."


def test_divergent_texts_go_and_all_columns_stay(docs, with_clashes):
    good = [(i, prose(i)) for i in range(150)]
    noise = " ".join(f"{i}#%" for i in range(300))
    shout = " ".join(f"QXZ{chr(65 + i % 26)}{chr(65 + i // 26 % 26)}!!" for i in range(300))
    df = with_clashes(docs([*good, (1000, noise), (1001, shout), (1002, None), (1003, "")]))
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {1000, 1001, 1002, 1003}
    sound = {i for i, t in good if not brute.quality(t)["base_failed"]}
    assert sound <= ids


def in_language(lang, i, n=120):
    draw = random.Random(i)
    common = quality_rules.COMMON_WORDS[lang]
    weights = [1 / (k + 1) for k in range(len(common))]
    rest = ["".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(4)) for _ in range(n)]
    return " ".join(draw.choices(common, weights)[0] if draw.random() < 0.3 else w for w in rest)


def test_lower_case_gibberish_and_wrong_languages_go(docs):
    good = [(1000 * k + i, in_language(lang, i), lang) for k, lang in enumerate(("en", "de", "fr", "es")) for i in range(200)]
    draw = random.Random(7)
    words = ["".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(4)) for _ in range(3000)]
    bad = [(9000, " ".join(words), "en"), (9001, " ".join(words[:60]), "de"), (9002, " ".join([*words[:150], *["the"] * 3]), "en")]
    wrong = [("de", "en"), ("fr", "es"), ("es", "fr"), ("en", "de"), ("es", "en")]
    bad += [(9100 + i, in_language(a, 500 + i, 300), b) for i, (a, b) in enumerate(wrong)]
    unlisted = [(9200, " ".join(words), "xx")]
    got = {r["doc_id"]: r for r in quality_rules.measure(docs([*good, *bad, *unlisted])).collect()}
    assert not any(brute.quality(t)["base_failed"] for _, t, _ in bad)
    assert [i for i, *_ in bad if got[i]["kept"]] == []
    assert [i for i, t, _ in [*good, *unlisted] if not got[i]["kept"] and not brute.quality(t)["base_failed"]] == []
    assert got[9000]["word_distance"] is not None and got[9200]["word_distance"] is None


def check_shards(placed, rows, shards):
    assert len(placed) == len(rows)
    facts = sorted((r[0] is None, r[0] or 0, *brute.shard_facts(r[1])) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in placed) == facts
    by = {}
    for r in placed:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))


def test_shards_of_the_table(spark):
    placed = op2_label_propagation_shards(spark, SF_DIR).collect()
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    check_shards(placed, [tuple(r) for r in rows], 40)
    assert {r["law"] for r in placed} == {"rows"} and {r["grown_shard"] for r in placed} == {None}


def test_shards_keep_groups_together_and_split_a_hot_one(docs, odd_rows, with_clashes):
    rows = [(i, "hot") for i in range(100)] + [(200 + i, f"pair {i // 2}") for i in range(200)]
    rows += [(400 + i, f"alone {i}") for i in range(140)]
    placed = label_shards.assign_shards(docs(rows), shards=6).collect()
    check_shards(placed, rows, 6)
    homes = {}
    for r in placed:
        if 200 <= r["doc_id"] < 400:
            homes.setdefault((r["doc_id"] - 200) // 2, set()).add(r["shard"])
    assert sum(len(h) == 1 for h in homes.values()) >= 27
    hot = {}
    for r in placed:
        if r["doc_id"] < 100:
            hot[r["shard"]] = hot.get(r["shard"], 0) + 1
    assert max(hot.values()) >= 40
    check_shards(label_shards.assign_shards(with_clashes(docs(odd_rows)), shards=3).collect(), odd_rows, 3)
    assert label_shards.assign_shards(docs([]), shards=3).count() == 0


def test_moves_keep_group_totals(spark):
    counts = spark.createDataFrame([(b"a", 0, 5), (b"a", 1, 9), (b"b", 0, 1), (b"b", 2, 1)], "grp binary, shard int, n bigint")
    moved = label_shards.propagate(counts, [6, 10, 6])
    totals = {bytes(r["grp"]): r["s"] for r in moved.groupBy("grp").agg(F.sum("n").alias("s")).collect()}
    assert totals == {b"a": 14, b"b": 2}
