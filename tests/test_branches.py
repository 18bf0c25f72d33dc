"""Literal tables, one line per branch, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tracelab.functions import extract as X
from tracelab.functions import scoring as S
from tracelab.functions import text as T
from tracelab.functions import verdicts as V


def run(spark, values, build):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("a"), F.col("b"))).collect()]


V5 = [
    ("", "", "empty"),
    (None, "", "empty"),
    ("<think>\nstill thinking", "", "unclosed_think"),
    ("<think>a</think>", "", "nothing_after_think"),
    ("<think>a</think>   \n ", "", "nothing_after_think"),
    ("<think>x <answer>42</answer></think>\n<answer>7</answer>", "7", "tag"),
    ("<think>a</think>b</think> <answer>9</answer>", "9", "tag"),
    ("so \\boxed{12} done <answer>3</answer>", "12", "boxed"),
    ("\\boxed{\\frac{1}{2}}", "\\frac{1", "boxed"),
    ("<ANSWER>\n5\n</ANSWER><answer>6</answer>", "5", "tag"),
    ("text <answer> 8 ", "8", "open_tag"),
    ("first\nThe answer is 11.\n", "11", "last_line"),
    ("<answer>Norway</answer>", "No", "tag"),
    ("<answer>2010 to 2015</answer>", "2015", "tag"),
    ("<answer>Yes, since the blue bar is higher</answer>", "Yes", "tag"),
    ("<answer>12 million</answer>", "12", "tag"),
    ("<answer>It is around 1,234 units overall</answer>", "1234", "tag"),
    ('<answer>"Blue"</answer>', "Blue", "tag"),
    ("<answer>**3.5**.</answer>", "3.5", "tag"),
    ("<answer>5k</answer>", "5", "tag"),
]


def test_answer_v5(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(V5)], "i int, response string")
    got = [(r["pred"], r["route"]) for r in X.v5(rows).orderBy("i").collect()]
    assert got == [(p, route) for _, p, route in V5]


TRAIN = [
    ("<answer>about 12 million</answer>", "12", "tag"),
    ("<ANSWER>12</ANSWER>", "12", "last_number"),
    ("<think>3</think> so 4 or 5", "5", "after_number"),
    ("<think>3</think>True", "yes", "after_line"),
    ("<answer>false</answer>", "no", "tag"),
    ("nothing here\nend", "end", "last_line"),
]


def test_answer_train(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(TRAIN)], "i int, response string")
    got = [(r["pred"], r["route"]) for r in X.train(rows).orderBy("i").collect()]
    assert got == [(p, route) for _, p, route in TRAIN]


SCORES = {
    S.relaxed_correctness: [("12%", "0.12", 1.0), ("0", "0", 1.0), ("0.0", "0", 0.0), ("105", "100", 1.0), ("106", "100", 0.0), ("Blue", "blue", 1.0)],
    S.relaxed_accuracy: [("$1,050", "1000", 1.0), ("3 million", "3", 1.0), ("0.005", "0", 1.0), ("0.02", "0", 0.0), ("a.", "A", 1.0)],
    S.closeness: [("5", "10", 1 / 1.5), ("x", "X", 1.0), ("0", "0", 1.0), ("1e3", "1000", 1.0)],
    S.text_match: [("", "a", 0.0), ("the Blue one", "blue", 1.0), ("true story", "yes", 1.0), ("nope", "yes", 0.0)],
    S.equal_first: [("0.0", "0", 1.0), ("0.001", "0", 0.0), ("96", "100", 1.0)],
}


@pytest.mark.parametrize("scorer", list(SCORES), ids=lambda f: f.__name__)
def test_scorers(spark, scorer):
    table = SCORES[scorer]
    got = run(spark, [(p, g) for p, g, _ in table], scorer)
    assert got == pytest.approx([x for _, _, x in table])


VERDICTS = {
    V.verdict_word: [("Verdict: Correct", 1), ("verdict:  incorrect", 0), ("no idea", None)],
    V.yes_no: [("Yes.", 1), ("well, no", 0), ("maybe it could be so, yes", None)],
    V.remote: [("Verdict: Incorrect", 0), ("Verdict: correct", 1), ("Verdict: ?", None), ("yes it is", 1), ("No", 0)],
    V.correctness: [("Correctness: Yes", 1), ("x\nCorrectness:\n no", 0), ("Yes", None)],
    V.json_score: [('{"score": 1}', 1), ('ok {"score": 1} bye', 1), ("broken {", 0), ("ERROR: {\"score\": 1}", 0)],
}


@pytest.mark.parametrize("dialect", list(VERDICTS), ids=lambda f: f.__name__)
def test_verdicts(spark, dialect):
    table = VERDICTS[dialect]
    assert run(spark, [(t, "") for t, _ in table], lambda a, b: dialect(a)) == [x for _, x in table]


def test_legacy_dialect_reads_incorrect_as_correct(spark):
    assert run(spark, [("Verdict: Incorrect", "")], lambda a, b: V.remote(a, "legacy")) == [1]


def test_axis_lines(spark):
    text = "Q1: yes\nQ2 - no\nQ3: NA\n q4: YES\nQ4: no"
    got = run(spark, [(text, "")], lambda a, b: V.axis_verdicts(a))[0]
    assert got == {"VALUE": 1, "LABEL": 0, "COUNT": None, "STRUCTURE": 0}


def test_number_patterns(spark):
    got = run(spark, [("2500 + 1500 = 4000", "")], lambda a, b: T.every(a, T.calc_pattern("compat")))[0]
    assert got == []
    got = run(spark, [("2500 + 1500 = 4000", "")], lambda a, b: T.every(a, T.calc_pattern("wide")))[0]
    assert got == ["2500 + 1500 = 4000"]
    assert run(spark, [("in 2015", "")], lambda a, b: T.every(a, T.NUMBER_PATTERNS["compat"]))[0] == ["201", "5"]


def test_to_number(spark):
    texts = ["1.", ".5", "+3", "1e3", "1.0d", "inf", "nan", " 2", ""]
    got = run(spark, [(t, "") for t in texts], lambda a, b: T.to_number(a))
    assert got == [1.0, 0.5, 3.0, 1000.0, None, None, None, None, None]


def test_rejoin(spark):
    got = run(spark, [("c", "r"), ("", "r"), ("c", None), (None, " ")], lambda a, b: T.rejoin(a, b))
    assert got == ["<think>\nr\n</think>\nc", "<think>\nr", "c", ""]
