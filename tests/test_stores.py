"""Vectors by id and profiles that merge."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import profile_state as ps
from vellum.operators.vector_store import look_up, write_store


def test_look_ups_leave_the_vectors_in_place(spark, tmp_path):
    rows = [(f"k{i % 50}", i, [float(i), 1.0]) for i in range(300)] + [(None, 1, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id string, n long, v array<double>")
    name = write_store(vectors, "id", "v", "n", path=str(tmp_path / "store"), buckets=16)
    asked = spark.createDataFrame([(f"k{i}", i) for i in range(60)] + [(None, -1)], "id string, a long").repartition(5)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = look_up(asked, name, "id", "v")
        plan = out._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("FileScan parquet"):] if plan.index("FileScan parquet") > plan.index("Exchange") else plan
        assert plan.count("Exchange hashpartitioning(id") == 1 and "Bucketed: true" in plan and "Exchange" not in side
        got = {r.a: r.v for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE {name}")
    assert got == {**{i: [250.0 + i, 1.0] if i < 50 else None for i in range(60)}, -1: None}


def test_states_of_halves_make_the_state_of_the_whole(spark):
    rng = random.Random(3)
    rows = [(i % 2, rng.gauss(0, 10) if i % 11 else None, f"v{rng.randrange(3000)}", None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "half int, x double, s string, none long")
    whole = ps.read_profile(ps.profile_state(df, ["x", "s", "none"])).collect()
    halves = ps.profile_state(df, ["x", "s", "none"], ["half"])
    assert halves.count() == 6
    merged = {r.column: r for r in ps.read_profile(ps.merge_states(halves)).collect()}
    x = sorted(r[1] for r in rows if r[1] is not None)
    for r in whole:
        m = merged[r.column]
        assert (m.n_rows, m.n_null, m.n_distinct, m.min, m.max) == (r.n_rows, r.n_null, r.n_distinct, r.min, r.max)
    m = merged["x"]
    assert m.n_null == 20_000 - len(x) and m.mean == pytest.approx(sum(x) / len(x))
    for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        rank = sum(v <= m[name] for v in x) / len(x)
        assert abs(rank - q) < 0.03
    assert abs(m.n_distinct - len(set(x))) < 0.06 * len(set(x)) and abs(merged["s"].n_distinct - len({r[2] for r in rows})) < 200
    assert merged["s"].q50 is None and merged["none"].n_null == 20_000 and merged["none"].mean is None
    empty = ps.read_profile(ps.merge_states(ps.profile_state(df.filter(F.lit(False)), ["x"], ["half"])))
    assert empty.count() == 0


@pytest.mark.parametrize("keep", [4, 25, 1000])
def test_bounds_of_frequent_values_hold_after_merges(spark, keep):
    rng = random.Random(5)
    rows = [(i % 6, f"v{min(rng.randrange(200), rng.randrange(200))}" if i % 13 else None, i % 3) for i in range(6000)]
    df = spark.createDataFrame(rows, "part int, s string, n int")
    truth = {}
    for _, s, n in rows:
        for c, v in (("s", s), ("n", str(n))):
            if v is not None:
                truth[c, v] = truth.get((c, v), 0) + 1
    state = ps.frequent_state(df, ["s", "n"], ["part"], keep)
    thirds = ps.merge_frequent(state.withColumn("third", F.col("part") % 3), ["part"], ["third"], keep)
    for merged in (ps.merge_frequent(state, ["part"], keep=keep), ps.merge_frequent(thirds, ["third"], keep=keep)):
        got = {(r.column, r.value): r for r in merged.collect()}
        assert all(r.low <= truth[at] <= r.high for at, r in got.items())
        missed = {c: next(r.missed for at, r in got.items() if at[0] == c) for c in ("s", "n")}
        assert all(at in got or n <= missed[at[0]] for at, n in truth.items())
        assert missed["n"] == 0 and all(got["n", str(v)].low == truth["n", str(v)] for v in range(3))
        assert sum(at[0] == "s" for at in got) == min(keep, 200 if keep > 200 else keep, len([a for a in truth if a[0] == "s"]))
        if keep == 1000:
            assert all(r.low == r.high == truth[at] for at, r in got.items()) and missed["s"] == 0
    assert all(r.missed <= 1000 / (keep + 1) for r in state.collect())
    assert ps.merge_frequent(ps.frequent_state(df.limit(0), ["s"], ["part"], keep), ["part"], keep=keep).count() == 0
