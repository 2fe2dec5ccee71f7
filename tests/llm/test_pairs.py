from __future__ import annotations

import pytest

from convograph.llm import pairs as P

Q = "How do I sort the fast heuristic in Sarsolnet?"


@pytest.mark.parametrize(
    ("prompt", "answer", "is_html", "want"),
    [
        (Q, "", False, "empty"), (Q, "…", False, "empty"), (Q, "<p>&nbsp;</p>", True, "empty"),
        (Q, "I'm sorry, but I can't help with that.", False, "refusal"), (Q, "Dabei kann ich leider nicht helfen.", False, "refusal"),
        (Q, "Unfortunately the sort is slow. It takes a while to do.", False, None), (Q, "I can't see the whole file, but this should work: Use a sort here.", False, None),
        (Q, "> " + Q.upper(), False, "copy"), (Q, f"You asked: {Q}", False, "copy"), (Q, f"{Q}\n{Q}", False, "copy"), ("Prompted " + Q, f"<p>{Q}</p>", True, "copy"),
        (Q, f"{Q}\n\nUse the built-in sort of the tool, which is fast.", False, None),
        (Q, "Das liegt meistens an dem Ordner und nicht an der Zeit.", False, "language"), ("Translate this into German: The door is open.", "Die Tür ist offen und das ist gut.", False, None),
        (Q, "まず設定を測り、それから新しい索引を変えます。", False, "language"),
        (Q, "The sensor updates the list. Each commo", False, "truncated"), (Q, "Use this:\n\n```python\ndef f(x):\n    return x", False, "truncated"),
        (Q, "Use this:\n\n```python\ndef f(x):\n    return x\n```", False, None), (Q, "Do it so.\n\n- one part\n- the last step", False, None), (Q, "The tool does it. 👍", False, None),
        (Q, "The tool does it.\n\nSee the notes on Vector Index", False, None), (Q, "42", False, None), (Q, "<p>The tool sorts the lis<", True, "truncated"),
        (Q, "1. The tool sorts.\n2. The", False, "truncated"),
    ],
)
def test_rules(prompt, answer, is_html, want):
    assert P.judge(prompt, answer, is_html)[0] == want


def test_neighbours_and_spikes(spark):
    long = "The first step opens the list and the second one closes the door of the room"
    bullets = "The plan of the work is here:\n\n- the first item\n- the long room"
    rows = [("t", "cut", Q, bullets[:-3], False), ("t", "whole", Q, bullets + " and more.", False), ("t", "twin", Q, bullets[:-3], False), ("t", "null", Q, None, False)]
    rows += [("t", f"n{i}", Q, f"{long} {i}.", False) for i in range(30)]
    # a length limit of 300 characters cuts lists without any other sign
    rows += [("t", f"s{i}", Q, ("The plan of the work is here now:\n\n" + f"- item {i:02} " + "word " * 80)[:299] + "x", False) for i in range(60)]
    found = {r.rec_id: r.defect for r in P.defects(spark.createDataFrame(rows, "tab string, rec_id string, prompt string, answer string, is_html boolean")).collect()}
    assert found["cut"] == found["twin"] == "truncated" and found["null"] == "empty" and "whole" not in found and not any(k.startswith("n") and k != "null" for k in found)
    assert all(found[f"s{i}"] == "truncated" for i in range(60))
    assert P.defects(spark.createDataFrame([], "tab string, rec_id string, prompt string, answer string, is_html boolean")).count() == 0


def test_hot_answer_over_partitions(spark):
    """A shortened answer copied over several partitions is found in all of them."""
    whole = "The plan of the work is here:\n\n- the first item\n- the long room"
    rows = [("t", f"h{i:03}", Q, whole[:-3], False) for i in range(400)] + [("t", "whole", Q, whole + " and more.", False), ("t", "z", Q, "Zero is less than one.", False), ("t", "a", Q, "A thing is done.", False)]
    told = spark.createDataFrame(rows, "tab string, rec_id string, prompt string, answer string, is_html boolean")
    assert {(r.rec_id, r.defect) for r in P.defects(told).collect()} == {(f"h{i:03}", "truncated") for i in range(400)}


def test_previous_across_partitions(spark):
    rows = [("t", "hot", i, f"r{i:03}", "user") for i in range(200)] + [("t", "b", 1, "x", "user"), ("t", "b", 0, "y", "user")]
    out = P.with_previous(spark.createDataFrame(rows, "tab string, grp string, at long, rec_id string, speaker string"), ["tab", "grp"], ["at", "rec_id"])
    got = {r.rec_id: r.before.rec_id if r.before else None for r in out.collect()}
    assert got == {"r000": None, "y": None, "x": "y"} | {f"r{i:03}": f"r{i - 1:03}" for i in range(1, 200)}


def test_whole_tables(spark, small):
    p = P.prompt_answer_pairs(spark, small)
    assert p.count() == p.select("tab", "rec_id").distinct().count() > 50


def test_evidence(spark):
    """Neighbours and spikes decide before endings, whatever the length of the answer; copies make no spike."""
    rows = [("t", "short", Q, "Use the\n- old", False), ("t", "longer", Q, "Use the\n- older list.", False), ("t", "ends", Q, "It is an", False), ("t", "name", Q, "Vector Index", False)]
    rows += [("t", f"l{i}", Q, f"- w{i:02} and lists of it xy", False) for i in range(40)] + [("t", f"c{i}", Q, "- one and the same list", False) for i in range(90)]
    told = spark.createDataFrame(rows, "tab string, rec_id string, prompt string, answer string, is_html boolean")
    found = {r.rec_id: (r.defect, r.evidence) for r in P.judged_pairs(told).collect()}
    assert found == {"short": ("truncated", "shortened"), "ends": ("truncated", "ending")} | {f"l{i}": ("truncated", "limit") for i in range(40)}


def test_shortened_against_brute_force(spark):
    import random

    r = random.Random(5)
    texts = sorted({"".join(r.choices("ab", k=r.choice([1, 2, 3, 5, 8, 13]))) for _ in range(300)})
    rows = [("t", str(i), x, is_open, P.beginnings(x, is_open)) for i, x in enumerate(texts) for is_open in [r.random() < 0.5]]
    got = {x.rec_id for x in P.shortened(spark.createDataFrame(rows, "tab string, rec_id string, answer string, open boolean, begins array<long>")).collect()}
    assert got == {i for _, i, x, is_open, _ in rows if is_open and any(y != x and y.startswith(x) for y in texts)}
