"""Streams, sinks, grouped fits and other jobs whose state or order matters: restarts, crashes, partitions, hand-made cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tracelab.operators import corpus as K
from tracelab.operators import logistic as L
from tracelab.operators import traces as G
from tracelab.operators.cells import cell_of
from tracelab.operators.scale import exact_mean
from tracelab.plans.cells import auc_lift
from tracelab.sources import readers
from tracelab.streaming import jobs

DAY = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
EVENT = "event_id bigint, ts timestamp, kind string, value double"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def source(spark, folder):
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(folder)


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet") if p.is_file()}


def test_dedupe_stream_keeps_late_and_null_keys(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), tmp_path / "out", str(tmp_path / "state")
    put(spark, folder, "a", [(1, DAY, "x", 1.0), (1, DAY, "x", 1.0), (None, DAY, "x", 2.0), (2, DAY, "x", 3.0)])
    run = lambda: jobs.dedupe_available(source(spark, folder), "event_id", str(out), state)
    run()
    before = files(out)
    put(spark, folder, "b", [(2, DAY, "x", 3.0), (None, DAY, "x", 2.0), (3, DAY - dt.timedelta(days=900), "x", 4.0)])
    query = run()  # a restart goes on from the state
    rows = spark.read.parquet(str(out)).collect()
    assert sorted((r["event_id"] is not None, r["event_id"] or 0) for r in rows) == [(False, 0), (True, 1), (True, 2), (True, 3)]
    assert query.lastProgress.numInputRows == 3  # the second batch read its own rows only
    assert all(files(out)[p] == t for p, t in before.items())
    run()
    assert spark.read.parquet(str(out)).count() == 4
    assert spark.conf.get(jobs.PROVIDER, None) != jobs.ROCKSDB


def test_telemetry_rewrites_only_touched_windows(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), tmp_path / "out", str(tmp_path / "state")
    rng = random.Random(1)
    first = [(i, DAY + dt.timedelta(hours=rng.randrange(96)), rng.choice("xyz"), rng.random()) for i in range(300)] + [(400, DAY, None, None)]
    put(spark, folder, "a", first)
    moments = lambda: jobs.reward_windows(source(spark, folder), "ts", "kind", "value")
    run = lambda: jobs.totals_available(moments(), str(out), state, ["window_start", "kind"])
    run()
    before = files(out)
    late = [(500, DAY + dt.timedelta(hours=1), "x", 0.99), (501, DAY + dt.timedelta(days=30), "y", 0.5)]
    put(spark, folder, "b", late)
    run()
    after = files(out)
    gone = set(before) - set(after)
    assert len(gone) == 1 and all(after[p] == t for p, t in before.items() if p in after)  # of the old windows, the late row's alone
    table = spark.read.schema(moments().schema).parquet(str(out))
    got = {(r["window_start"].date(), r["kind"]): r for r in jobs.telemetry(table, "window_start", "kind").collect()}
    want = {}
    for _, ts, kind, value in first + late:
        want.setdefault((ts.date(), kind), []).append(value)
    assert set(got) == set(want)
    total = [v for values in want.values() for v in values if v is not None]
    for key, values in want.items():
        values = [v for v in values if v is not None]
        assert got[key]["n"] == len(values)
        if values:
            mean = sum(values) / len(values)
            assert math.isclose(got[key]["reward_mean"], mean)
            assert math.isclose(got[key]["reward_std"], math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)), abs_tol=1e-9)
    whole = jobs.telemetry(jobs.merged_moments(table.withColumn("one", F.lit(1)), ["one"]), "one").first()
    mean = sum(total) / len(total)
    assert whole["n"] == len(total) and math.isclose(whole["reward_mean"], mean)
    assert math.isclose(whole["reward_std"], math.sqrt(sum((v - mean) ** 2 for v in total) / len(total)))


SCORED = "id bigint, part string, score double, raw string"


def on_disk(spark, path):
    return sorted((r["id"] is not None, r["id"] or 0, r["score"], r["raw"]) for r in spark.read.parquet(path).collect())


def test_resume_sink_after_crashes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    rows = lambda made: spark.createDataFrame(made, SCORED)
    readers.append_resume(rows([(i, "p", float(i), "ok") for i in range(40)] + [(40, "p", None, "ERROR: x"), (None, "p", 1.0, "ok")]), path, ["id"], "raw")
    old = files(tmp_path / "out")
    more = rows([(3, "p", 99.0, "ok"), (40, "p", 40.0, "ok"), (41, "p", 41.0, "ok"), (41, "p", 41.0, "ok"), (None, "p", 5.0, "ok")])
    swap = readers._swap_in
    calls = []

    def crash(*args):
        calls.append(args)
        if len(calls) == 2:  # new buckets are complete, none is swapped in
            raise RuntimeError("crash")
        swap(*args)

    monkeypatch.setattr(readers, "_swap_in", crash)
    with pytest.raises(RuntimeError):
        readers.append_resume(more, path, ["id"], "raw")
    assert len(on_disk(spark, path)) == 42
    monkeypatch.setattr(readers, "_swap_in", swap)
    got = readers.append_resume(more, path, ["id"], "raw")
    want = sorted([(True, i, float(i), "ok") for i in range(42)] + [(False, 0, 1.0, "ok")])
    assert on_disk(spark, path) == want and got.count() == len(want) and got.columns == ["id", "part", "score", "raw"]
    again = {p.parent.name for p in set(files(tmp_path / "out")) - set(old) if p.parent.parent.name == "out" and p.parent.name.startswith("key_bucket")}
    assert len(again) <= 2  # the buckets of 40 and 41
    readers.append_resume(more, path, ["id"], "raw")
    assert on_disk(spark, path) == want


def newton(rows, features, steps=60):
    """Ridge logistic fit by plain loops and elimination."""
    k = len(features) + 1
    c = [0.0] * k
    for _ in range(steps):
        g = [0.0] + [-v for v in c[1:]]
        h = [[float(i == j and i > 0) for j in range(k)] for i in range(k)]
        for r in rows:
            x = [1.0] + [r[f] for f in features]
            q = 1 / (1 + math.exp(-sum(a * b for a, b in zip(c, x))))
            for i in range(k):
                g[i] += (r["y"] - q) * x[i]
                for j in range(k):
                    h[i][j] += q * (1 - q) * x[i] * x[j]
        for i in range(k):
            for j in range(i + 1, k):
                f = h[j][i] / h[i][i]
                h[j] = [a - f * b for a, b in zip(h[j], h[i])]
                g[j] -= f * g[i]
        for i in reversed(range(k)):
            g[i] = (g[i] - sum(h[i][j] * g[j] for j in range(i + 1, k))) / h[i][i]
        c = [a + b for a, b in zip(c, g)]
    return c


def test_grouped_fits_match_single_ones(spark):
    rng = random.Random(2)
    rows = []
    for group in range(6):
        for _ in range(150):
            a, b = rng.randrange(7) / 6, rng.randrange(11) / 10
            rows.append({"g": group, "a": a, "b": b, "y": int(rng.random() < 1 / (1 + math.exp(-(group - 2) * (a - 0.5) - 3 * (b - 0.4))))})
    rows += [{"g": 9, "a": 0.1, "b": 0.2, "y": 1}] * 5  # one label: no fit
    df = spark.createDataFrame(rows, "g int, a double, b double, y int").groupBy("g", "a", "b", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    got = {r["g"]: r for r in L.fit_groups(df.cache(), ["g"], {"one": ["a"], "two": ["a", "b"]}).collect()}
    assert sorted(got) == list(range(6))
    for group, r in got.items():
        own = [x for x in rows if x["g"] == group]
        for name, features in (("one", ["a"]), ("two", ["a", "b"])):
            for j, value in enumerate(newton(own, features)):
                assert math.isclose(r[f"{name}_{j}"], value, abs_tol=1e-8)


def test_lift_of_constant_scores(spark):
    rows = [(0, 0.5, 0.1 * (i % 5), i % 2) for i in range(20)]
    got = auc_lift(spark.createDataFrame(rows, "g int, m double, p double, outcome int"), ["g"]).first()
    assert got["mc_only_auc"] == 0.5 and got["n"] == 20


@pytest.mark.parametrize("parts", [1, 8, 211])
def test_means_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(3)
    rows = []
    for g in range(300):
        values = [rng.randrange(11) / 10 for _ in range(rng.randrange(1, 6))]
        rows += [(g, v) for v in values + [1 - v for v in values]]  # every mean is a half
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
    got = df.groupBy("g").agg(exact_mean(F.col("v")).alias("m")).select(cell_of(F.lit(1), F.col("m")).alias("c")).distinct().collect()
    assert [r["c"] for r in got] == ["grounded_correct"]


def test_class_pairs_restore_all_pairs(spark):
    rng = random.Random(4)
    base = [[rng.random() - 0.5 for _ in range(64)] for _ in range(30)]
    vectors = []
    for i in range(240):
        v = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            j = rng.randrange(64)
            v[j] = -v[j]
        vectors.append((i, v))
    df = spark.createDataFrame(vectors, "id int, v array<double>")
    df = df.select("id", *[c.alias(n) for n, c in K.sign_blocks(F.col("v")).items()])
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    pairs = K.near_pairs(K.fingerprint_classes(train, "id", "train"), K.fingerprint_classes(test, "id", "test"))
    pairs = pairs.join(K.class_members(train, "id", "train").withColumnRenamed("id", "a"), "train_class").join(K.class_members(test, "id", "test").withColumnRenamed("id", "b"), "test_class")
    got = sorted((r["a"], r["b"], r["distance"]) for r in pairs.collect())
    bits = {i: [x > 0 for x in v] for i, v in vectors}
    want = [(a, b, d) for a in bits if a % 3 for b in bits if b % 3 == 0 if (d := sum(x != y for x, y in zip(bits[a], bits[b]))) < 5]
    assert got == sorted(want) and len(want) > 200


def test_reasoning_of_every_form(spark):
    rows = ['{"r": "one\\ntext"}', '{"r": ["a", "", null, "b", 5]}', '{"r": null}', "{}", '{"r": []}', '{"r": 7}', "{broken", None]
    value = F.try_variant_get(F.try_parse_json("j"), "$.r", "variant")
    got = spark.createDataFrame([(x,) for x in rows], "j string").select(K.reasoning_text(value).alias("t")).collect()
    assert [r["t"] for r in got] == ["one\ntext", "a\nb\n5", "", "", "", "7", "", ""]


def test_entities_of_both_shapes(spark):
    rows = [
        ("long", 0, ["name", "v"]), ("long", 1, [" a ", "1"]), ("long", 2, ["", "2"]), ("long", 3, ["b", "x"]), ("long", 4, ["c"]), ("long", 5, ["d", "4", "9"]),
        ("wide", 0, ["name", "p", " "]), ("wide", 1, ["a", "1", "2"]), ("wide", 2, ["", "3", "4"]), ("wide", 3, ["b", "", "5", "6"]), ("none", 1, ["a", "1"]),
    ]
    df = spark.createDataFrame(rows, "chart string, at int, cells array<string>")
    got = K.entity_pairs(df, "chart", "at", "cells", lambda raw: F.expr("try_cast(_raw AS double)"))
    want = {("long", "a", 1.0), ("long", "d", 4.0), ("wide", "a (p)", 1.0), ("wide", "a", 2.0), ("wide", "p", 3.0), ("wide", "b", 5.0)}
    assert {tuple(r) for r in got.collect()} == want


def test_listing_opens_no_file(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "image int, t string").write.partitionBy("image").text(str(tmp_path / "i"))
    listed = readers.listed_files(spark, str(tmp_path / "i"))
    assert listed.count() == 2 and "content" not in listed._jdf.queryExecution().executedPlan().toString()


def test_pilot_takes_the_first(spark):
    rows = [(i, "ab"[i % 2], i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, s string, n_steps bigint")
    got = {r["s"]: tuple(r)[1:] for r in G.pilot(df, "id", ["s"], 12).collect()}
    valid = [(i, s, n) for i, s, n in rows if n]
    for s in "ab":
        mine = [n for i, x, n in valid[:12] if x == s]
        assert got[s] == (len(mine), sum(1 for i, x, n in valid[12:] if x == s), sum(mine), 8 * sum(mine))
    assert G.pilot(df, "id", ["s"], 100).agg(F.sum("n_left")).first()[0] == 0


def test_taint_bounds_taint_the_same(spark):
    from tracelab.operators.process import taint_bounds

    rng = random.Random(5)
    rows = [([rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 3) for _ in range(400)] + [0.0, 1e-12],) for _ in range(4)]
    for r in spark.createDataFrame(rows, "v array<double>").select("v", taint_bounds(F.col("v")).alias("b")).collect():
        assert set(r["b"]) <= set(r["v"]) and len(r["b"]) < len(r["v"])
        gap = lambda x, ts: any(abs(x - t) / max(abs(t), 1e-10) < 0.05 for t in ts)
        for _ in range(3000):
            x = rng.choice(r["v"]) * rng.uniform(0.9, 1.1)
            assert gap(x, r["v"]) == gap(x, r["b"])


def test_taint_chain_of_ten_thousand_numbers(spark):
    import time

    from tracelab.operators.process import taint_chain

    cells = spark.createDataFrame([(1, 0, "a", "v", 5.0)], "chart_id bigint, row_idx int, label string, col string, value double")
    took = []
    for n in (2_500, 10_000):
        text = "\n".join(f"we read {7 + i % 900} and {11 + i * 37 % 900} here" for i in range(n // 2))
        rows = spark.createDataFrame([(1, 0, f"<think>{text}</think>")], "group_id bigint, k int, response string")
        start = time.time()
        taint_chain(rows, cells, ["group_id", "k"], "group_id").collect()
        took.append(time.time() - start)
    assert took[1] < 30
