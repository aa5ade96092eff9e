from __future__ import annotations

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from skein.llm import piece_lattice
from skein.llm.queries import op5_piece_lattice_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF_DIR = f"{brute.TESTDATA}/sf0.001"


def best_path(unit):
    """Viterbi by its definition, over all segmentations' prefixes."""
    pieces = piece_lattice.load_pieces(MODEL)
    ids = {t: i for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)) if k == "normal"}
    marked = unit.replace("▁", "﷐").replace(" ", "▁")
    best = [(0.0, [])]
    for end in range(1, len(marked) + 1):
        options = []
        for size in range(1, min(16, end) + 1):
            piece = ids.get(marked[end - size : end])
            score, path = best[end - size]
            if piece is not None:
                options.append((score + pieces.scores[piece], -size, [*path, piece]))
            elif size == 1:
                raw = unit[end - 1].encode()
                options.append((score + pieces.fallback, -size, [*path, *(int(pieces.byte_ids[b]) for b in raw)]))
            else:
                options.append((-np.inf, -size, path))
        top = max(options, key=lambda o: (o[0], o[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


def ids_of(units):
    return [np.frombuffer(raw, "<i4").tolist() for raw in piece_lattice.segment(MODEL, units)]


UNITS = [" hello", "world", " Straßenbahn", "\n", " ", "漢字", " ☃☃", " ▁▁x", "!!!", " the", "é", " a" + "b" * 40, "𝔘n"]


def test_segments_equal_the_definition():
    assert ids_of(UNITS) == [best_path(u) for u in UNITS]


WHOLE = [
    "def f(x):\n        if x:\n            return {'a_{i}': x->_next, '__(': (__x)}\n",
    "$x_{i}_{\\\\alpha}$  and   5 m². Then ²²._ __init__.py\n\n    ",
    " " * 37 + "deep" + " " * 16 + "\n" + " " * 5,
    "Plain prose, no indent; 漢字 ▁▁ ☃ it's 1 234_567.",
]


def test_whole_texts_take_the_best_path_of_the_whole_lattice():
    for text in WHOLE:
        ids = np.frombuffer(piece_lattice.encode_texts(MODEL, [text])[0], "<i4").tolist()
        assert ids == best_path(" " + text)


def test_every_piece_can_be_produced_by_some_unit():
    pieces = piece_lattice.load_pieces(MODEL)
    normal = [t.replace("▁", " ") for t, k in zip(pieces.texts, pieces.kinds, strict=True) if k == "normal"]
    assert [t for t in normal if len(piece_lattice.UNITS.findall(t)) != 1] == []
    assert max(map(len, normal)) <= piece_lattice.MAX_PIECE


def test_relational_plan_equals_the_batch_form(spark):
    units = spark.createDataFrame([(u,) for u in UNITS], "unit string")
    got = {r["unit"]: r["ids"] for r in piece_lattice.encode_units(units, MODEL).collect()}
    assert [got[u] for u in UNITS] == ids_of(UNITS)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80))
def test_round_trip(text):
    ids = np.frombuffer(piece_lattice.encode_texts(MODEL, [text])[0], "<i4").tolist()
    assert piece_lattice.decode_ids(MODEL, ids) == text


def test_units_cover_the_text():
    text = "a_1  b½ é\n\n_ 12,x ▁\x85"
    assert "".join(piece_lattice.units_of(text)) == " " + text


def test_frames_and_odd_rows(docs, odd_rows, with_clashes):
    coded = piece_lattice.encode(with_clashes(docs(odd_rows)), MODEL)
    back = piece_lattice.decode(coded, MODEL).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in odd_rows)
    assert piece_lattice.encode(docs([]), MODEL).count() == 0


def test_every_document_of_the_table(spark):
    rows = op5_piece_lattice_tokens(spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r["round_trip"] and r["n_tokens"] > 0 for r in rows)
