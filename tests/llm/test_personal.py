from __future__ import annotations

import pytest

from convograph.llm import personal as P

GIVEN = ["Neina", "Tueth", "Lunola", "Kelquaan", "Gorette", "Rixviola", "Haxtoris", "Brenlyan", "Juniel", "Baostola"]
FAMILY = ["Lunrixovar", "Haxmarley", "Kelfenley", "Nemisen", "Quazehausen", "Margoretti", "Sarpoquist", "Draostmont", "Mimiwick", "Viviovar"]
WORDS = "the and with from this that river stone garden method index letter table window branch shared planner dense cache vector ledger street lane".split()


@pytest.fixture(scope="module")
def finder():
    return P.fit([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY], WORDS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Send it to a.b+c@mail.example.com please.", [("email", "a.b+c@mail.example.com")]),
        ("login=o'neina(at)example.org was rejected", [("email", "o'neina(at)example.org")]),
        ("write to neina at inbox dot test now", [("email", "neina at inbox dot test")]),
        ("Call me on +1 (415) 555‑0137 after lunch.", [("phone", "+1 (415) 555‑0137")]),
        ("tel 020 7946 0084", [("phone", "020 7946 0084")]),
        ("She left four one five five five five zero one three nine there.", [("phone", "four one five five five five zero one three nine")]),
        ("my SSN is 666-38-0730", [("idnum", "666-38-0730")]),
        ("Please delete T57176469 (Ausweisnummer) from it.", [("idnum", "T57176469")]),
        ("I live at 126 Soldale Street\nLunville, ZZ 94888 now.", [("address", "126 Soldale Street\nLunville, ZZ 94888")]),
        ("Ship it to Cayvenweg 165a, 00279 Zehaxdorf, please.", [("address", "Cayvenweg 165a, 00279 Zehaxdorf")]),
        ("Please ask Neina K. Haxmarley about it.", [("name", "Neina K. Haxmarley")]),
        ("author: Nemisen, Lunola", [("name", "Nemisen, Lunola")]),
        ("The Haxmarley Method converges in 9 steps.", []),
        ("There were 55504343 rows. See ticket 2024-17-0076 of build 3.65.16 at 192.0.2.43:8029.", []),
        ("@cached_property took 83 ms in kit@73.32.0", []),
        ("Shared Planner and Dense Cache", []),
        ("", []), (" \n", []),
    ],
)
def test_spans(finder, text, want):
    assert [(s.kind, text[s.start : s.end]) for s in finder.find(text)] == want


def test_replacement_keeps_the_rest(finder):
    text = "Dear Neina Haxmarley, mail a@example.com or call 212-555-0151. Bye"
    assert finder.replace(text) == "Dear [NAME], mail [EMAIL] or call [PHONE]. Bye"


def test_held_out_sentences(finder):
    """Sentences by another seed: nearly all are found exactly."""
    made = P.training_sentences(GIVEN, FAMILY, seed=99, n=200)
    good = sum({(s.start, s.end, s.kind) for s in finder.find(t)} == gold for t, gold in made)
    assert good >= 180


def test_field_is_optimal(finder):
    """The dynamic programme equals trying all sets of spans that don't overlap."""
    from itertools import combinations

    text = "Call 212-555-0151 or 666-38-0730, Neina K. Haxmarley at 7 Soldale Ave., Apt. 12, Lunville"
    spans = P.candidates(text, finder.model, finder.flags)[:12]
    score = lambda s: sum(finder.weights.get(f, 0) for f in s.features) + finder.weights.get("bias:" + s.kind, 0)
    best = max(
        sum(map(score, c)) for n in range(len(spans) + 1) for c in combinations(spans, n)
        if all(a.end <= b.start or b.end <= a.start for a, b in combinations(c, 2))
    )
    assert abs(sum(map(score, P.best_spans(spans, finder.weights))) - best) < 1e-9


def test_operator_on_odd_rows(spark, finder):
    rows = spark.createDataFrame([("t", "1", 0, None, "x"), ("t", "2", 0, "", "x"), ("t", "3", 0, "a@example.com " * 3000, "x")], "tab string, rec_id string, part int, text string, val string")
    found = P.found_spans(rows.where("text is not null"), finder)
    assert found.count() == 3000 and found.select("val").distinct().count() == 1
    assert P.redacted(rows, finder).where("rec_id = '1'").first().text is None
    assert P.found_spans(rows.where("false"), finder).count() == 0


def test_ordinary_words_come_from_all_rows(spark, tmp_path):
    """A word met only after the first 3,000 rows counts, in chunks and in node names; a rare one doesn't."""
    texts = [(i, "the stone of the garden") for i in range(3_000)] + [(3_000 + i, "a plumbick of it") for i in range(200)] + [(4_000, "some rarely")]
    spark.createDataFrame(texts, "row_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(i, f"vector_index {i}") for i in range(3_000)] + [(3_000, "tarn_gelbick")], "i long, source string").coalesce(1).write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY], "name string, name_kind string").write.parquet(f"{tmp_path}/known_names.parquet")
    spark.createDataFrame([("A line.",)], "text string").write.parquet(f"{tmp_path}/level_samples.parquet")
    ordinary = P.fitted(spark, str(tmp_path)).model.ordinary
    assert {"plumbick", "garden", "tarn", "gelbick", "index"} <= ordinary and "rarely" not in ordinary


#: frames that are neither in the tables nor used in fitting
_OTHER = {
    "email": ["Drop a line to {} whenever you like.", "Our list owner is {}, be kind.", "cc: {}"],
    "phone": ["If it floods, call {} at once.", "Reception has telephone {} now.", "The cell {} is off."],
    "idnum": ["Officer, my passport reads {} in full.", "A card with social security number {} was found.", "licence {} belongs to a cook."],
    "address": ["Since spring she lives at {} with two cats.", "Mailing address: {}.", "Please deliver the piano to {} on Sunday."],
    "name": ["Yesterday {} told us a story.", "A poem by {} hangs there.", "Say hello, dear {}!"],
}
_NOTHING = ["The barn holds 48213377 nails.", "Screen 1920-1080-60 is fine.", "At 203.0.113.9:8080 nobody answers.", "Spec 7.14.2 was read on 2022-03-04.", "The Haxmarley Theorem is old.", "Golden Kettle and Wooden Spoon", "We baked 120 loaves in 14 ovens."]


def test_frames_not_used_in_fitting(finder):
    """Recall and precision on generated values in other frames."""
    import random

    r, hits, found, true = random.Random(77), 0, 0, 0
    for k in range(600):
        kind = P.KINDS[k % 5]
        head, tail = r.choice(_OTHER[kind]).split("{}")
        value = P._value(r, kind, GIVEN, FAMILY)
        text = f"{r.choice(_NOTHING)} {head}{value}{tail} {r.choice(_NOTHING)}"
        at = text.index(head + value) + len(head)
        got = {(s.start, s.end, s.kind) for s in finder.find(text)}
        hits, found, true = hits + ((at, at + len(value), kind) in got), found + len(got), true + 1
    assert hits >= 0.95 * true and hits >= 0.95 * found


def test_numbers_of_no_known_shape(finder):
    for text, want in (("call +999 12-34-56-78 today", "+999 12-34-56-78"), ("my passport is XY-1234-567", "XY-1234-567"), ("telephone (12) 345 67 89 please", "(12) 345 67 89")):
        assert [text[s.start : s.end] for s in finder.find(text)] == [want]
