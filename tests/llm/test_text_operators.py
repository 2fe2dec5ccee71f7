"""Splitting, encoding, mixture, reading level and pair counts against brute force or exact round trips."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convograph.llm import cooccurrence, encode, mixture, reading_level, split

# ------------------------------------------------------------------ splitting


@settings(max_examples=60, deadline=None)
@given(st.text("ab. \n\r,é́-", max_size=400), st.integers(5, 60), st.integers(0, 40))
def test_pieces_cover_the_text(text, most, overlap):
    out = split.pieces(text, most, overlap)
    if len(text) <= most:
        assert out == [(0, len(text))]
        return
    over = min(overlap, most // 2)
    assert "".join(text[max(a, prev) : b] for (a, b), prev in zip(out, [0, *(b for _, b in out)])) == text
    assert all(0 < b - a <= most for a, b in out)
    assert all(a2 <= b1 and b1 - a2 <= over and b2 > b1 for (_, b1), (a2, b2) in zip(out, out[1:]))


def test_cuts_at_topic_change(noise):
    one, two = "The river carries water stones. " * 12, "Engines burn diesel fuel quickly. " * 12
    cut = split.pieces(one + two, len(one) + 150, 0)[0][1]
    assert cut == len(one)
    assert all(b - a <= 50 for a, b in split.pieces("x" * 500, 50, 10))


def test_split_operator(spark):
    texts = spark.createDataFrame([("t", "1", 1, "ab. " * 50), ("t", "2", 2, None), ("t", "3", 3, "ab"), ("t", "1", 1, "ab. " * 50), ("z", "4", 4, "ab. " * 50)], "tab string, rec_id string, row_key long, text string")
    limits = spark.createDataFrame([("t", "text", 60, None)], "table_name string, field string, max_chars int, overlap_chars int")
    out = split.split_oversized(texts, limits)
    assert {r.rec_id for r in out.collect()} == {"1"}
    assert split.split_oversized(texts.where("false"), limits).count() == 0


# ------------------------------------------------------------------ encoding


@pytest.fixture(scope="module")
def codec():
    return encode.Codec(encode.default_path(), leaf=5)


@settings(max_examples=200, deadline=None)
@given(st.text("ab1 \n\t'sé漢😀.<|>", max_size=80))
def test_tree_equals_direct(codec, text):
    ids = codec.encode(text)
    assert ids == codec.direct(text)
    assert codec.decode(ids) == text


def test_encoding_operator(spark):
    docs = spark.createDataFrame([(1, "hi <|endoftext|>", "x"), (2, "", "x"), (3, None, "x"), (4, "long words " * 30_000, "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encoded(docs).collect()}
    direct = encode.Codec(encode.default_path()).direct
    assert got == {1: direct("hi <|endoftext|>"), 2: [], 3: [], 4: direct("long words " * 30_000)} and 50256 not in got[1]
    assert {r.doc_id: r.text for r in encode.decoded(encode.encoded(docs)).collect()} == {1: "hi <|endoftext|>", 2: "", 3: "", 4: "long words " * 30_000}
    assert encode.encoded(docs.where("false")).count() == 0


# ------------------------------------------------------------------ mixture


def test_mixture(spark, noise):
    docs = [(i, noise(5 + i % 9), ("big", "small ", "SMALL")[0 if i % 5 else 1 + i % 2]) for i in range(600)] + [(901, None, "big"), (902, "", "small"), (903, "x", None), (904, "x", "other")]
    goal = [("big", 0.5, 1), ("small", 0.3, 2), ("absent", 0.2, 9)]
    taken, report = mixture.mixture(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(goal, "source string, target_share double, max_repeats int"))
    rep = {r.source: r for r in report.collect()}
    got = taken.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.times <= {"big": 1, "small": 2}[r.source] for r in got)
    assert abs(rep["big"].actual_share - 0.625) < 0.01 and abs(rep["small"].actual_share - 0.375) < 0.01
    assert rep["absent"].no_documents and rep["absent"].tokens == 0
    assert rep["small"].tokens == sum(r.n_tokens * r.times for r in got if r.source == "small")
    again, _ = mixture.mixture(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string"), spark.createDataFrame(goal, "source string, target_share double, max_repeats int"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    none, _ = mixture.mixture(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame(goal, "source string, target_share double, max_repeats int"))
    assert none.count() == 0


# ------------------------------------------------------------------ reading level


def test_reading_level_on_held_out_samples(spark, small):
    rows = pd.read_parquet(f"{small}/level_samples.parquet").sort_values("sample_id")
    rows = rows.sample(frac=1, random_state=4)
    fit, held = rows.iloc[:140], rows.iloc[140:]
    model = reading_level.fit(fit.text.tolist(), fit.reading_level.tolist())
    out = next(reading_level._scorer(model, 20)(iter([pd.DataFrame({"doc_id": held.sample_id.to_numpy(), "text": held.text.to_numpy()})])))
    want = held.set_index("sample_id").reading_level
    assert len(out) == len(held) and (out.reading_level.to_numpy() == want[out.doc_id].to_numpy()).mean() >= 0.9


def test_reading_level_rows(spark, small):
    samples = spark.read.parquet(f"{small}/level_samples.parquet")
    easy = samples.where("reading_level = 1").first().text
    md = f"---\na: b\n---\n\n# Head words here\n\n{easy} {easy} {easy}\n\n```\ncode the the\n```\n| the | table |"
    docs = spark.createDataFrame([(1, md, 9), (2, None, 9), (3, "", 9), (4, "Wir haben den Ordner und die Zeit. " * 30, 9), (5, "too short", 9)], "doc_id long, text string, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading_level.reading_levels(docs, samples).collect()}
    assert got == {1: 1}
    assert reading_level.reading_levels(docs, samples.where("false")).count() == 0
    assert reading_level.prose(md).strip() == f"{easy} {easy} {easy}"


def test_sparse_sums(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    rows, cols, vals = r.integers(0, 9, 60), r.integers(0, 7, 60), r.normal(size=60)
    dense = np.zeros((9, 7))
    np.add.at(dense, (rows, cols), vals)
    w, g, keep = r.normal(size=(7, 3)), r.normal(size=(9, 3)), np.arange(9) % 3 > 0
    for most in (0, 1000):
        monkeypatch.setattr(reading_level.Sparse, "DENSE", most)
        x = reading_level.Sparse(rows, cols, vals, (9, 7))
        assert np.allclose(x.times(w), dense @ w, atol=1e-5) and np.allclose(x.transposed_times(g), dense.T @ g, atol=1e-5)
        assert np.allclose(x.part(keep).times(w), dense[keep] @ w, atol=1e-5)


def test_long_texts_split_in_linear_time():
    import time

    text = " ".join(f"Word{i} alpha{i} beta{i} gamma{i} delta{i}." for i in range(25_000))
    began = time.time()
    out = split.pieces(text, 4_000, 200)
    assert len(text) > 900_000 and time.time() - began < 8 and out[-1][1] == len(text)


# ------------------------------------------------------------------ pair counts


def test_large_baskets_in_blocks(spark):
    lists = [(str(b), sorted(f"i{(b * 7 + k) % 60:02}" for k in range(n))) for b, n in enumerate((1, 2, 3, 8, 9, 17, 50))]
    got = Counter((r.x, r.y) for r in cooccurrence.light_pairs(spark.createDataFrame(lists, "id string, lv array<string>"), 4).collect())
    assert got == Counter(p for _, v in lists for p in combinations(v, 2))



@pytest.mark.parametrize("heavy", [1, 6, 1024])
def test_pairs_against_brute_force(spark, heavy):
    r = random.Random(heavy)
    names = [f"n{i}" for i in range(40)]
    baskets = [(str(b), r.sample(names[:8], r.randint(0, 3)) + r.choices(names, k=r.randint(0, 4)) + [None, ""]) for b in range(300)] + [("x", None), (None, names)]
    sets = {b: {x for x in v or [] if x} for b, v in baskets if b is not None}
    single = Counter(x for s in sets.values() for x in s)
    both = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    n = len(sets)
    want = {(a, b, c, single[a], single[b], n) for (a, b), c in both.items() if c >= 2 and c * n >= 1.5 * single[a] * single[b]}
    got = cooccurrence.pair_counts(spark.createDataFrame(baskets, "id string, items array<string>"), 2, 1.5, heavy)
    assert {tuple(x)[:6] for x in got.collect()} == want and want


def test_pairs_of_nothing(spark):
    assert cooccurrence.pair_counts(spark.createDataFrame([], "id string, items array<string>")).count() == 0
    edges = spark.createDataFrame([("p", "A b", "a_b", 1, ["x"]), ("p", "B", "a", None, None), ("p", "a", "b", None, None), ("q", "a", "b", 5, ["s", "p"])], "doc_path string, source string, target string, weight long, contexts array<string>")
    assert [tuple(r) for r in cooccurrence.accumulated_graph(edges).collect()] == [("a", "b", 5, 2, "p,s")]
