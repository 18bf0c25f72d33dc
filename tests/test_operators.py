"""Brute-force checks of the operators SQL cannot check, and of the skew paths."""

import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tracelab.functions import scoring
from tracelab.functions.text import words
from tracelab.operators import cells, claims, corpus, process, qagen, rewards, scale, traces
from tracelab.plans import QUERIES
from tracelab.sources import readers
from tracelab.sources.fixtures import view


@pytest.mark.parametrize("lead", [1, 2])
def test_ordinals_are_positions_in_sorted_groups(spark, lead):
    rng = random.Random(3)
    rows = [(None if i % 5 == 0 else 1 if i % 3 else i, rng.choice([None, *range(9)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, o int, id int")
    got = {r["id"]: r["k"] for r in scale.ordinal_in_group(df, ["g"], ["o", "id"], "k", lead).collect()}
    groups: dict = {}
    for g, o, i in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, i))
    assert got == {i: k for members in groups.values() for k, (_, _, i) in enumerate(sorted(members))}


def test_quantiles_and_auc_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([rng.random() * 10, 2.5, -1.0]), rng.randrange(2)) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, v double, y int")
    got = {r["g"]: r for r in scale.exact_quantiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()}
    auc = {r["g"]: r["auc"] for r in cells.auc_by_group(df, ["g"], "v", "y").collect()}
    flipped = {r["g"]: r["auc"] for r in cells.auc_by_group(df.withColumn("v", -F.col("v")), ["g"], "v", "y").collect()}
    for g in "ab":
        vs = sorted(v for h, v, _ in rows if h == g)
        for name, q in (("lo", 0.1), ("mid", 0.5), ("hi", 0.9)):
            at = q * (len(vs) - 1)
            i = int(at)
            want = vs[i] + (vs[min(i + 1, len(vs) - 1)] - vs[i]) * (at - i)
            assert got[g][name] == pytest.approx(want)
        pos = [v for h, v, y in rows if h == g and y]
        neg = [v for h, v, y in rows if h == g and not y]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert auc[g] == pytest.approx(wins, abs=1e-6)
        assert auc[g] + flipped[g] == pytest.approx(1.0, abs=2e-6)


def test_best_match_against_brute_force(spark):
    rng = random.Random(7)
    pool = [0.0, 0.3, -2.0, 5.0, 6.0, 7.9, 8.0, 100.0, 130.0, -55.0, 1e6]
    table = [(c, float(rng.choice(pool))) for c in range(5) for _ in range(4)]
    asked = sorted({(c, float(rng.choice([0.29, 4.1, 5, 6.5, 8.1, -2.4, 110, 1e5, -50, 3e6, 7]))) for c in range(6) for _ in range(9)})
    values = spark.createDataFrame(asked, "chart_id int, n double")
    cell_rows = spark.createDataFrame(sorted(set(table)), "chart_id int, value double")
    for r in process.best_match(values, cell_rows).collect():
        want = max((1 / (1 + abs(r["n"] - t) / max(abs(t), 1e-10)) for c, t in table if c == r["chart_id"]), default=0.0)
        for limit in (0.8, 0.9):
            assert (r["best"] > limit) == (want > limit)


def test_one_wide_chart_is_matched_in_linear_work(spark):
    """Cells and mentions of one chart in one power of two: each mention meets its own cell."""
    n = 60_000
    cell_rows = spark.range(n).selectExpr("1L as chart_id", "65536.0D + id as value")
    values = spark.range(n).selectExpr("1L as chart_id", "65536.25D + id as n")
    near = process.nearest_cells(values, cell_rows)
    assert near.where("below != n - 0.25 or (above != n + 0.75 and n < 125535)").count() == 0
    assert near.where("above is null").count() == 1


TAINT_CASES = [  # worked out by hand: sentence rewards, mean
    ("<think>\nThe value is 100.\n</think>", 1.0),
    # right, wrong sum (0, taints 10 and 50), a use of 50 (0.3), untouched number
    ("<think>\nThe value is 100.\nThen 10 + 10 = 50 fails.\nLater 50 is used.\nStill 100 holds.\n</think>", (1 + 0 + 0.3 + 1) / 4),
    # a use of a tainted number taints nothing itself: 100 stays good
    ("<think>\nSo 10 + 10 = 50 fails.\nBoth 50 and 100 here.\nThen 100 again.\n</think>", (0 + 0.3 + 1) / 3),
    # division by zero is no failed sum, but 4 and 0 are far from the table
    ("<think>\nok: 10 / 0 = 4 hm\n</think>", 0.0),
    ("<think>\nno number\n100\n</think>", 0.0),
    ("no reasoning, 100", 0.0),
]


def test_taint_chain_cases(spark):
    rows = [(1, k, text) for k, (text, _) in enumerate(TAINT_CASES)]
    rows += [(2, 0, "<think>\nIt is 5 now.\nIt is 5 now.\nIt is 5 now.\n</think>")]  # no table
    rows += [(3, 0, TAINT_CASES[0][0])]  # a table without numbers
    df = spark.createDataFrame(rows, "group_id long, k int, response string")
    table = spark.createDataFrame([(1, 10.0), (1, 100.0), (3, None)], "chart_id long, value double")
    got = {(r["group_id"], r["k"]): r["taint"] for r in process.taint_chain(df, table, ["group_id", "k"], "group_id").collect()}
    assert got == {**{(1, k): pytest.approx(want, abs=1e-6) for k, (_, want) in enumerate(TAINT_CASES)}, (2, 0): 0.0, (3, 0): 0.0}


def test_segments_by_hand(spark):
    cases = [
        ("a b\n\nc\n\nd e f g", ["a b\n\nc", "d e f g"]),  # 2 + 1 words stay below 4; 3 + 4 do not
        ("", []),
        ("\n\n  \n\n", []),
        ("Aa b c. Dd e f. Gg h.", ["Aa b c. Dd e f.", "Gg h."]),  # 8 words are too many, 3 + 3 fit into 6
        ("Aa b c d e f g h", ["Aa b c d e f g h"]),  # one long sentence stays whole
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    for r in traces.segment_steps(df, "t", "s", low=4, high=6).collect():
        assert [s["text"] for s in r["s"]] == cases[r["i"]][1]


def test_segments_keep_the_text_and_the_bounds(spark):
    rng = random.Random(11)
    sentence = lambda: "Aa " + "bb " * rng.randrange(1, 12) + "c."
    texts = ["\n\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in traces.segment_steps(df, "t", "s", low=12, high=30).collect():
        parts = [s["text"] for s in r["s"]]
        assert " ".join(" ".join(parts).split()) == " ".join(texts[r["i"]].split())
        assert all(s["len"] == len(s["text"].split()) for s in r["s"])
        assert all(s["len"] <= 30 or s["text"].count(".") == 1 for s in r["s"])


def test_marker_split_by_hand(spark):
    s = ["x" * 89 + ".", "y" * 89 + ".", "z" * 89 + "."]
    cases = [
        ("Intro line here is long\nFirst, read the chart axis\nSo, it is 5 and more\n\nWait, check again please",
         ["Intro line here is long", "First, read the chart axis", "So, it is 5 and more", "Wait, check again please"]),
        ("An opening line of text\nNow, short\nstep 2 reads the legend", ["An opening line of text", "step 2 reads the legend"]),
        (" ".join(s), [f"{s[0]} {s[1]}", s[2]]),  # two of 90 characters fit into 200
        ("", []),
        ("\n".join(["A first line of words"] + [f"Step {i} goes on and on" for i in range(30)]),
         ["A first line of words"] + [f"Step {i} goes on and on" for i in range(30)]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    for r in traces.split_by_markers(df, "t", "p").collect():
        assert r["p"] == cases[r["i"]][1]
    assert [len(r["p"]) for r in traces.split_by_markers(df, "t", "p", 2).orderBy("i").collect()] == [2, 2, 2, 0, 2]


def test_near_fingerprints_against_brute_force(spark):
    rng = random.Random(17)
    train = [tuple(rng.randrange(2) for _ in range(64)) for _ in range(40)]
    test = []
    for i, bits in enumerate(train):
        other = list(bits)
        for at in rng.sample(range(64), i % 8):
            other[at] = 1 - other[at]
        test.append(tuple(other))
    train += train[:5] * 3  # copies

    def blocks(rows):
        df = spark.createDataFrame([(i, list(map(float, (2 * b - 1 for b in r)))) for i, r in enumerate(rows)], "id int, v array<double>")
        return df.select("id", *[c.alias(n) for n, c in corpus.sign_blocks(F.col("v")).items()])

    a = blocks(train)
    got = {r["id"]: (r["distance"], r["n_test"]) for r in a.join(corpus.near_fingerprints(a, blocks(test)), corpus.NAMES).collect()}
    for i, x in enumerate(train):
        near = [d for d in (sum(p != q for p, q in zip(x, y)) for y in test) if d < 5]
        assert got.get(i) == ((min(near), len(near)) if near else None)


def test_text_contamination_finds_copies(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "something else entirely, you see")], "doc_id int, text string")
    items = spark.createDataFrame([(7, "The quick brown fox jumps over it!")], "item_id int, text string")
    near = corpus.near_fingerprints(corpus.simhash_bits(docs, "doc_id", "text"), corpus.simhash_bits(items, "item_id", "text"))
    hit = corpus.simhash_bits(docs, "doc_id", "text").join(near, corpus.NAMES).select("doc_id", "distance").collect()
    assert [tuple(r) for r in hit] == [(1, 0)]


def test_auc_lift_improves_on_a_telling_second_feature(spark, sf):
    from tracelab.plans import QUERIES

    row = QUERIES["al_auc_lift"](spark, sf).first()
    assert 0 <= row["mc_only_auc"] <= 1 and 0 <= row["both_auc"] <= 1
    assert row["auc_lift"] == pytest.approx(row["both_auc"] - row["mc_only_auc"], abs=1e-6)


def test_block_f_questions_hold(spark, sf):
    table = view(spark, sf, "chart_cells")
    rows = qagen.block_f(qagen.column_facts(table), table).collect()
    labels: dict = {}
    for r in table.collect():
        labels.setdefault(r["chart_id"], set()).add(r["label"])
    kinds = {r["template"] for r in rows}
    assert kinds == {"hypothetical", "unanswerable", "multi_choice", "conversational"}
    for r in rows:
        if r["template"] == "unanswerable":
            assert r["entity"] in qagen.FICTIONAL and r["entity"] not in labels[r["chart_id"]] and r["entity"] in r["question"]
            assert r["answer_text"] == qagen.UNANSWERABLE
        if r["template"] == "multi_choice":
            assert r["options"]["ABCD".index(r["answer_text"])] == r["answer_num"]
            assert all(f"{letter}) {option:.2f}" in r["question"] for letter, option in zip("ABCD", r["options"]))
            wrong = [o for i, o in enumerate(r["options"]) if i != "ABCD".index(r["answer_text"])]
            assert all(0.09 <= abs(o - r["answer_num"]) / abs(r["answer_num"]) <= 0.31 for o in wrong)


def test_cells_sum_to_100_and_rewards_stay_in_range(spark, sf):
    from tracelab.plans.process import reward_rows

    dist = cells.cell_distribution(view(spark, sf, "rollouts"), ["bench"]).collect()
    assert all(sum(r[c] for c in cells.CELLS) == pytest.approx(100, abs=1e-4) for r in dist)
    rows = reward_rows(spark, sf, "rw_multiplicative")
    wrong = F.when(F.col("kind") == "augmented", F.col("reward"))
    low, high, most = rows.agg(F.min("reward"), F.max("reward"), F.max(wrong)).first()
    assert 0 <= low and high <= 1 and most < 1


def test_process_terms_without_table_or_reasoning(spark):
    rows = spark.createDataFrame(
        [(1, 0, "<think>5 + 5 = 10</think>"), (2, 0, "<think>5 and 0 and 1,999</think>"), (2, 1, "<think> </think><answer>3</answer>")],
        "group_id long, k int, response string",
    )
    table = spark.createDataFrame([(2, 5.0)], "chart_id long, value double")
    terms = process.process_terms(rows, table, ["group_id", "k"], "group_id")
    parts = process.components()
    got = {
        (r[0], r[1]): tuple(r)[2:]
        for r in terms.select("group_id", "k", parts["grounding"], parts["arithmetic"], process.reward_v1(), process.reward_v2()).collect()
    }
    assert got[(1, 0)] == (0.5, 0.5, 0.5, 0.0)
    assert got[(2, 0)] == (1.0, 0.5, pytest.approx(0.6 * 0.5 + 0.4 * 0.5), pytest.approx(0.6))
    assert got[(2, 1)] == (0.0, 0.0, 0.0, 0.0)


def test_length_penalties(spark):
    df = spark.createDataFrame([(0,), (250,), (300,), (450,), (500,), (900,)], "w int")
    got = df.select(rewards.length_penalty(F.col("w"), 2), rewards.length_penalty(F.col("w"), 3)).collect()
    assert [tuple(r) for r in got] == [pytest.approx(p) for p in ((0, 0), (0, 0), (0, 0.06), (0.1, 0.24), (0.2 * 200 / 300, 0.3), (0.2, 0.3))]


def test_jsonl_readers(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/rows.jsonl"
    with open(path, "w") as f:
        f.write('{"id": 1, "t": "a"}\n\n{"id": 2, "t": "b"}\n{broken\n')
    assert readers.read_jsonl(spark, path, "id int, t string", strict=False).count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl(spark, path, "id int, t string").collect()


def test_chart_csv_reader(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{path}/c1.csv", "w") as f:
        f.write("name,x,y\na,1,2\nb,3,n/a\n")
    rows = readers.read_chart_csv(spark, path).collect()
    assert sorted((r["label"], r["col"], r["raw"]) for r in rows) == [("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3"), ("b", "y", "n/a")]


def test_append_resume_twice_adds_nothing(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    rows = spark.createDataFrame([(1, "ok"), (2, "ERROR: x"), (3, "ok")], "id int, raw string")
    readers.append_resume(rows, path, ["id"])
    readers.append_resume(rows, path, ["id"])
    assert spark.read.parquet(path).count() == 3
    again = spark.createDataFrame([(2, "ok now"), (2, "ok now"), (4, "new")], "id int, raw string")
    done = readers.append_resume(again, path, ["id"], raw="raw")
    assert spark.read.parquet(path).where("id = 2").count() == 1  # its bucket was replaced
    assert {r["id"]: r["raw"] for r in done.collect()} == {1: "ok", 2: "ok now", 3: "ok", 4: "new"} and done.count() == 4


def test_status_and_report_sinks(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.createDataFrame([(1, "success"), (2, "failure")], "id int, status string")
    readers.write_by_status(rows, f"{path}/s")
    readers.write_report(rows, f"{path}/r")
    assert spark.read.parquet(f"{path}/s").where("status = 'failure'").count() == 1
    assert spark.read.json(f"{path}/r").count() == 2


def test_stream_restart_scores_each_file_once(spark):
    from tracelab.streaming import jobs

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    first = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id int, raw string")
    first.write.parquet(f"{base}/in")
    schema = first.schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{base}/in")
    jobs.run_available(stream(), f"{base}/out", f"{base}/state")
    jobs.run_available(stream(), f"{base}/out", f"{base}/state")
    assert spark.read.parquet(f"{base}/out").count() == 5
    spark.createDataFrame([(9, "new")], "id int, raw string").write.mode("append").parquet(f"{base}/in")
    jobs.run_available(stream(), f"{base}/out", f"{base}/state")
    assert spark.read.parquet(f"{base}/out").count() == 6


def test_late_keys_and_open_windows_are_kept(spark):
    from tracelab.streaming import jobs

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "id int, ts timestamp, kind string, value double"
    batch = lambda ids, day: spark.createDataFrame([(i, f"2024-01-{day} 12:00:00", "a", 1.0) for i in ids], "id int, ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = lambda: spark.readStream.schema(schema).parquet(f"{base}/in")
    for ids, day in ((range(100), "20"), ([*range(100, 200), 5, 5], "01")):  # the second file is older and repeats a key
        batch(ids, day).write.mode("append").parquet(f"{base}/in")
        jobs.dedupe_available(stream(), "id", f"{base}/once", f"{base}/s1")
        jobs.totals_available(jobs.reward_windows(stream(), "ts", "kind", "value"), f"{base}/sums", f"{base}/s2", ["window_start", "kind"])
    assert spark.read.parquet(f"{base}/once").count() == spark.read.parquet(f"{base}/once").select("id").distinct().count() == 200
    assert sorted(r["n"] for r in spark.read.parquet(f"{base}/sums").collect()) == [100, 102]


@pytest.mark.parametrize("small", [1, 3, 64])
def test_small_and_big_charts_count_alike(spark, monkeypatch, small):
    """The in-row counts of small charts and the joins of big ones agree, with null keys and charts without a table."""
    rng = random.Random(13)
    say = lambda: " ".join(rng.choice(["Item", "a_b", "5", "5.2", "-7", "1,999", "0", "60", "word", "1 + 2 = 3"]) for _ in range(rng.randrange(70)))
    keyed = [(c, k, f"<think>{say()}</think><answer>{rng.randrange(9)}</answer>") for c in (1, 2, 3, 4, None) for k in range(12)]
    rows = spark.createDataFrame(keyed, "group_id long, k int, response string")
    cell = [(1, "Item 1", "a_b", 5.0), (1, "x", "a_b", -7.0), (2, "9", "8", 61.0), (3, "Item", "q", None)] + [(4, f"n{i} a_b", "item", float(i)) for i in range(90)]
    table = spark.createDataFrame(cell, "chart_id long, label string, col string, value double")

    def terms():
        plain = process.process_terms(rows, table, ["group_id", "k"], "group_id").drop("response").collect()
        anchored = process.anchored_terms(rows, table, ["group_id", "k"], "group_id").drop("response").collect()
        return {r[:2]: r.asDict() for r in plain}, {r[:2]: r.asDict() for r in anchored}

    want = terms()
    monkeypatch.setattr(process, "SMALL", small)
    got = terms()
    assert got == want
    numbers = {(r["group_id"], r["k"]): r["n_numbers"] for r in process.grounding_counts(rows, table, ["group_id", "k"], "group_id", "response").collect()}
    assert any(v for v in numbers.values()) and len(numbers) > 40
    assert sum(r["n_anchored"] or 0 for r in want[1].values()) > 0


def test_process_terms_move_no_numbers(spark):
    """A response with many numbers on a small chart shuffles no row per number: no explode outside the route of big charts."""
    rows = spark.range(3).selectExpr("id AS group_id", "0 AS k", "concat('<think>', repeat('7 ', 500), '</think>') AS response")
    table = spark.range(3).selectExpr("id AS chart_id", "7.0D AS value")
    terms = process.process_terms(rows, table, ["group_id", "k"], "group_id")
    assert {(r["n_numbers"], r["n_match_tight"]) for r in terms.collect()} == {(500, 500)}
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert "_big" in plan and plan.count("aggregate(") > 0


def final_plan(df):
    """What adaptive execution ended with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("terms", [process.process_terms, process.anchored_terms])
def test_no_big_chart_leaves_one_route(spark, terms):
    """Where no chart is big, responses are read and scored once: the route of big charts and its ranks are gone when the job ends."""
    rows = spark.range(40).selectExpr("id % 9 AS group_id", "id AS k", "concat('<think>item ', id, ' is 7 + 1 = 8</think>') AS response")
    table = spark.range(30).selectExpr("id % 9 AS chart_id", "concat('item ', id) AS label", "'q' AS col", "CAST(id AS DOUBLE) AS value")
    plan = final_plan(terms(rows, table, ["group_id", "k"], "group_id").repartition(2))
    assert not any(part in plan for part in ("Window", "Generate", "monotonically"))


def test_conditional_variance_scores_a_response_once(spark, sf):
    plan = final_plan(QUERIES["sg_conditional_variance"](spark, sf))
    assert plan.count("RLIKE(response") == 1


def test_simhash_moves_no_word(spark):
    """Votes are summed before they move, by id; rows of one id vote together, and copies of a word each vote."""
    import hashlib

    texts = [(1, "a b b"), (1, "c, A"), (2, " ."), (None, "x y x"), (3, "a B; b"), (3, None)]
    bits = corpus.simhash_bits(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", "text")
    assert bits._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    said: dict = {}
    for key, text in texts:
        said.setdefault(key, []).extend(re.findall(r"\w+", (text or "").lower()))

    def blocks(words):
        halves = [[int(hashlib.md5(w.encode()).hexdigest()[8 * i : 8 * i + 8], 16) for w in words] for i in (0, 1)]
        signs = [int(2 * sum(h >> i & 1 for h in half) > len(words)) for half in halves for i in range(32)]
        ends = [sum(corpus.BLOCKS[:i]) for i in range(len(corpus.BLOCKS) + 1)]
        return tuple(int("".join(map(str, signs[a:b])), 2) for a, b in zip(ends, ends[1:]))

    assert {r[0]: tuple(r[1:]) for r in bits.collect()} == {k: blocks(w) for k, w in said.items() if w}


def test_words_and_scores_of_odd_texts(spark):
    texts = [None, "", "  ", " a\tb\nc ", "one", "TRUE", "yes, so", "7 million", "$7.0", "0", "7%"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "p string, g string")
    both = pairs.select("p", "g", scoring.closeness(F.col("p"), F.col("g")), scoring.text_match(F.col("p"), F.col("g")), words(F.col("p"))).collect()
    got = {r[:2]: r[2:] for r in both}
    assert [got[(t, "one")][2] for t in texts] == [None, 0, 0, 3, 1, 1, 2, 2, 1, 1, 1]
    assert got[("$7.0", "7%")][0] == 1.0 and got[("0", "0")][0] == 1.0 and got[("one", "7%")][0] == 0.0 and got[(None, "one")][0] == 0.0
    assert got[("TRUE", "yes, so")][1] == 0.0 and got[("yes, so", "yes, so")][1] == 1.0 and got[("", "")][1] == 0.0 and got[("7 million", "7%")][1] == 0.0


def test_facts_of_short_and_long_columns_alike(spark, monkeypatch):
    rng = random.Random(17)
    rows = [(c, i, rng.choice([f"n{i}", None]), col, rng.choice([None, 1.0, 2.5, -3.0, float(i)])) for c in (1, 2, 3, None) for col in ("a", "b") for i in range(rng.choice([1, 3, 9, 70]))]
    table = spark.createDataFrame([*rows, (4, 0, "x", None, 1.0)], "chart_id long, row_idx int, label string, col string, value double")
    got = {r[:2]: r for r in qagen.column_facts(table).collect()}
    want = {r[:2]: r for r in qagen.long_column_facts(table).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for key, r in want.items():
        assert all(got[key][c] == (pytest.approx(v) if isinstance(v, float) else v) for c, v in r.asDict().items())
    monkeypatch.setattr(qagen, "SMALL", 2)
    assert {r[:2]: r["median_v"] for r in qagen.column_facts(table).collect()} == {k: r["median_v"] for k, r in want.items()}


def said_claims(rng):
    """Texts with claims of every pattern, near misses, and pieces that only almost belong to a pattern."""
    parts = ["The Value of item", "North-East", " is ", "is", " IS  -4", " equals 5.5", "=7 million", ": 12%", " (", "(3)", "(-2.5)", "5", " for Region B is 7", "highest value is Item 3",
             "largest=x y", "Smallest category is", "\n", ", ", " this ", "Is 9K", "x" * 40, " ", "\tis\t3", "value of é is 4", "-0", "MINIMUM  Region = a-b"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(9)))


def test_claims_are_the_groups_of_every_pattern(spark):
    rng = random.Random(23)
    rows = [(i, rng.choice([0, 1]), said_claims(rng)) for i in range(600)] + [(None, 0, "North is 4"), (900, 0, None), (901, 0, "")]
    steps = spark.createDataFrame(rows, "group_id long, k int, text string")
    got = {(r["group_id"], r["k"], r["type"], r["entity"].lower(), r["value"], r["comparator"]): (r["entity"], r["unit"]) for r in claims.regex_claims(steps, ["group_id", "k"], "text").collect()}
    want = {}
    blanks = " \n\t\r\x0b\x0c"
    for g, k, text in rows:
        for i, (pattern, e, v) in enumerate(claims.VALUE_PATTERNS):
            for m in re.finditer(pattern, text or "", re.ASCII):
                unit = (m[3] or None) if i == claims.WITH_UNIT else None
                want.setdefault((g, k, "value", m[e].strip(blanks).lower(), float(m[v]), None), (m[e].strip(blanks), unit))
        for m in re.finditer(claims.SUPERLATIVE, text or "", re.ASCII):
            want.setdefault((g, k, "categorical", m[2].strip(blanks).lower(), None, m[1].lower()), (m[2].strip(blanks), None))
    # the unit of a claim is the first one said
    assert got.keys() == want.keys() and len(want) > 400
    assert {key: e for key, (e, _) in got.items()} == {key: e for key, (e, _) in want.items()}
    found = {(r["group_id"], r["k"]): r["f"] for r in steps.select("group_id", "k", claims.has_claim(F.col("text")).alias("f")).collect()}
    assert {key for key, f in found.items() if f} == {key[:2] for key in want}


def test_claims_search_each_pattern_once(spark):
    """One search for the hits of a pattern; the groups come from the hits. It took nine searches for four patterns."""
    steps = spark.range(1).selectExpr("id AS group_id", "0 AS k", "concat('North is ', id, '%') AS text")
    rows = claims.regex_claims(steps, ["group_id", "k"], "text")
    assert [(r["entity"], r["value"], r["unit"]) for r in rows.collect()] == [("North", 0.0, "%")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == len(claims.VALUE_PATTERNS) + 1


def test_fallback_queue_joins_nothing(spark, sf):
    """Claims of a step are looked for in its row: the queue moves lines once, to number them."""
    rows = QUERIES["cl_fallback_queue"](spark, sf)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() > 0


@pytest.mark.parametrize("small", [0, 3])
def test_taint_chain_in_the_row_and_by_joins_alike(spark, monkeypatch, small):
    rng = random.Random(29)
    parts = ["Item 12 is 5", "5 + 8 = 13", "5 + 8 = 14.5", "about 61.2 and 5.1", "1,250 ≈ 0", "no number", "0.004 or -7", "4 / 0 = 4", "3 * 2 = 6 - 1 = 9", "n 5", "88 99 5.2 5.3 61 62 63 64 65 1 2"]
    body = lambda: "\n".join(rng.choice(parts) for _ in range(rng.randrange(7)))
    forms = ["<think>{}</think> <answer>3</answer>", "<think>{}</think>", "{}</think>", "<think>{}", "{}"]
    rows = [(c, None if k == 11 else k, rng.choice(forms[:2] + forms).format(body())) for c in (1, 2, 3, 4, 5, None) for k in range(12)] + [(1, 50, None)]
    said = spark.createDataFrame(rows, "group_id long, k int, response string")
    cell = [(1, 5.0), (1, 13.0), (1, 13.0), (2, 61.0), (2, 0.0), (2, -7.0), (3, None), *[(4, float(i)) for i in range(90)], (None, 5.0)]
    table = spark.createDataFrame(cell, "chart_id long, value double")

    def chains():
        return sorted((r["group_id"] or 0, r["k"] or 0, r["response"] or "", round(r["taint"], 9)) for r in process.taint_chain(said, table, ["group_id", "k"], "group_id").collect())

    want = chains()
    monkeypatch.setattr(process, "SMALL", small)
    assert chains() == want and len(want) == len(rows)
    assert len({taint for *_, taint in want}) > 8
    assert all(taint == 0 for g, _, _, taint in want if g in (0, 3, 5))


def test_taint_chain_moves_no_numbers(spark):
    """Only the route of big charts has a row per sentence and number; the others fold in the row."""
    rows = spark.range(3).selectExpr("id AS group_id", "0 AS k", "concat('<think>', repeat('seven is 7\n', 200), '</think>') AS response")
    table = spark.range(3).selectExpr("id AS chart_id", "7.0D AS value")
    scored = process.taint_chain(rows, table, ["group_id", "k"], "group_id")
    assert [r["taint"] for r in scored.collect()] == [1.0] * 3
    small = scored._jdf.queryExecution().analyzed().children().head()
    plan = small.toString()
    assert "aggregate(" in plan and "generate" not in plan.lower()


def test_scorers_read_each_answer_once(spark):
    """Texts are cleaned and numbers read once a row; a scorer cleaned an answer at each of its uses."""
    answers = ["5", "5.2%", "$1,000", "1000 million", "abc", "ABC.", " 7 kg", "0", "0.004", "", None, "1e3", "-5", "Yes", "yes ", "5,2", "nan", "%", "3 K", "İ"]
    rows = spark.createDataFrame([(p, g) for p in answers for g in answers], "pred string, gold string")
    scored = rows.select("pred", "gold", scoring.relaxed_accuracy(F.col("pred"), F.col("gold")).alias("a"), scoring.relaxed_match(F.col("pred"), F.col("gold")).alias("m"))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2
    blanks = " \n\t\r\x0b\x0c"

    def want(p, g, clean):
        if p is None or g is None:
            return 0.0
        p, g = clean(p), clean(g)
        number = lambda s: float(s.strip(blanks)) if re.search(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", s.strip(blanks)) else None
        x, y = number(p), number(g)
        if x is None or y is None:
            return float(p.strip(blanks).lower() == g.strip(blanks).lower() if clean is accurate else p.lower() == g.lower())
        return float(abs(x) < 0.01 if y == 0 else abs(x - y) / abs(y) <= 0.05)

    bare = lambda s: re.sub(r"[,%$]", "", s.strip(blanks))

    def accurate(s):
        return re.sub(r"[,%$]", "", re.sub(scoring.UNITS, "", s.strip(blanks), flags=re.ASCII).strip(blanks)).rstrip(".")

    for r in scored.collect():
        assert (r["a"], r["m"]) == (want(r["pred"], r["gold"], accurate), want(r["pred"], r["gold"], bare)), r


def test_old_answer_is_scored_below_the_new_search(spark, sf):
    """The scores cut the generated code of the rescoring in two; one piece was too large to be compiled."""
    from tracelab.plans.answers import rescored

    plan = rescored(spark, sf).groupBy("model").agg(F.avg("old_score"), F.avg("new_score"))
    lines = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "AS old_score" in line or "AS new_score" in line]
    assert len(lines) == 2 and "AS old_score" in lines[1] and "AS new_score" not in lines[1]


@pytest.mark.parametrize("small", [0, 2])
def test_facts_of_short_and_long_methods_alike(spark, monkeypatch, small):
    rng = random.Random(31)
    rows = [
        (c, m, i // rng.choice([1, 1, 2]), rng.choice([None, float(rng.randrange(9)), 2.5]), float(rng.randrange(3)), rng.choice([9.0, None]))
        for c in (1, 2, 3, None) for m in (7, 8, 9, None) for i in range(rng.choice([1, 2, 3, 5, 90]))
    ]
    rows += rows[::7]
    points = spark.createDataFrame(rows, "chart_id long, method long, row int, y double, y_lower double, y_upper double")
    shape = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    per = lambda: sorted(map(str, map(shape, qagen.method_facts(points).drop("mid_width", "mid_y", "mean_width", "max_y", "min_y", "med", "iqr").collect())))
    got, picks = per(), {str(r[:1]): r for r in qagen.method_facts(points).collect()}
    monkeypatch.setattr(qagen, "SMALL", small)
    assert per() == got and len(got) == 4
    monkeypatch.undo()
    # the facts of each method by itself, so that every one is picked
    alone = points.withColumn("chart_id", F.expr("chart_id * 100 + method"))
    facts = lambda: sorted(str(sorted(map(str, shape(r)))) for r in qagen.method_facts(alone.dropDuplicates(["chart_id", "method", "row"])).collect())
    want = facts()
    monkeypatch.setattr(qagen, "SMALL", small)
    assert facts() == want and len(want) == 10 and picks


def test_short_methods_are_joined_with_nothing(spark):
    """Once no method is long, rows of methods meet in one stage: no join of rows with their own counts is left to run."""
    points = spark.range(60).selectExpr("id % 5 AS chart_id", "id % 15 AS method", "CAST(id AS INT) AS row", "CAST(id AS DOUBLE) AS y", "0.0D AS y_lower", "9.0D AS y_upper")
    facts = qagen.method_facts(points)
    assert {(r["n_methods"], r["n_rows"]) for r in facts.collect()} == {(3, 12)}
    final = facts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in final


def test_violins_deal_lines_and_orders_by_rows_and_number_none(spark, monkeypatch, tmp_path):
    """More rows make more tasks of the same size, lines and orders move once, and no row is numbered or read for bands."""
    line = "CAST(id % 900 AS BIGINT) AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, CAST(id % 50 AS DOUBLE) AS l_quantity"
    line += ", 1.0D AS l_extendedprice, 0.1D AS l_discount, 0.0D AS l_tax, TIMESTAMP'2020-01-01' AS l_shipdate"
    spark.range(3000).selectExpr(*line.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(900).selectExpr("id AS o_orderkey", "id % 90 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(scale, "TASK_ROWS", 100)
    asked = QUERIES["qa_sci_violin"](spark, str(tmp_path))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "l_discount" not in plan and "Window" not in plan
    assert len(re.findall(r"hashpartitioning\([lo]_orderkey#\d+L?, 30\), REPARTITION_BY_NUM", plan)) == 2
    assert asked.where("template = 'sci_violin_range'").count() == 90


def test_lines_without_an_order_are_not_dealt(spark, sf, tmp_path):
    """Dealt lines are numbered as others are; those of no order, which join with nothing, do not meet in one task."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 > 0, F.col("l_orderkey")))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    plain, dealt = view(spark, str(tmp_path), "lines").where("group_id IS NOT NULL"), view(spark, str(tmp_path), "lines", 5)
    assert dealt.count() == plain.count() and dealt.exceptAll(plain).isEmpty()
