from __future__ import annotations

import re

import brute

from skein.llm import license_scan
from skein.llm.queries import op3_minhash_license_windows

SF_DIR = f"{brute.TESTDATA}/sf0.001"


def words_of(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def shingles(words):
    return [" ".join(p) for p in zip(words, words[1:], words[2:], strict=False)]


def test_notices_are_found_where_they_stand(docs):
    filler = "river stone walk garden paper light " * 5
    rows = []
    for i, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        for lead in range(0, 12, 3):
            rows.append((100 * i + lead, " ".join(filler.split()[:lead]) + f" {text} " + filler, name))
    got = {r["doc_id"]: r["licenses"] for r in license_scan.find_licenses(docs([r[:2] for r in rows])).collect()}
    for doc, text, name in rows:
        found = {x["license"]: x for x in got[doc]}
        assert name in found and found[name]["containment"] == 1.0
        start = found[name]["first_word"]
        notice = words_of(license_scan.TEMPLATES[name])
        assert words_of(text)[start : start + 2] == notice[:2]


def test_clean_and_partial_texts_have_none(docs, odd_rows, with_clashes):
    rows = [*odd_rows, (50, "all of the rights that we reserved"), (51, "Released under the sun, the MIT dome")]
    out = license_scan.find_licenses(with_clashes(docs(rows))).collect()
    assert len(out) == len(rows) and not any(r["licenses"] for r in out)
    assert license_scan.find_licenses(docs([])).count() == 0


def test_every_document_of_the_table(spark):
    got = {r["doc_id"]: set(r["licenses"].split(",")) - {""} for r in op3_minhash_license_windows(spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    known = {n: words_of(t) for n, t in license_scan.TEMPLATES.items()}
    assert len(got) == len(rows)
    for r in rows:
        joined = " " + " ".join(words_of(r["text"])) + " "
        verbatim = {n for n, w in known.items() if f" {' '.join(w)} " in joined}
        assert verbatim <= got[r["doc_id"]]
        own = set(shingles(words_of(r["text"])))
        for name in got[r["doc_id"]]:
            assert len(own & set(shingles(known[name]))) >= 0.9 * len(set(shingles(known[name])))
