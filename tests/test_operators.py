"""Operators against plain Python on small tables."""

import random
import statistics
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortpulse.operators.aggregate import count_where, flag, one, share_of_total, sums_by_attribute, value_counts
from cohortpulse.operators.fanout import as_bigint, fact_profile, join_profile, multiplicity, product
from cohortpulse.operators.median import fill_with_group_median, group_median
from cohortpulse.operators.quality import (
    contents_report,
    counts_report,
    null_conditions,
    orphan_counts,
    shape_report,
)
from cohortpulse.operators.rank import top_n
from cohortpulse.plans.story import at_risk_of, most_contacted
from tests.helpers import rows


def test_share_of_total(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] + [(None,)], "k string")
    assert set(rows(share_of_total(df, "k"))) == {("a", 2, 50.0), ("b", 1, 25.0), (None, 1, 25.0)}


def test_count_where(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 3)], "k string, v int")
    assert set(rows(count_where(df, ["k"], "n", big=F.col("v") > 0))) == {("a", 2, 1), ("b", 1, 1)}
    assert rows(count_where(df.filter("false"), [], "n", big=F.col("v") > 0)) == [(0, 0)]


def test_sums_by_attribute_equals_join_then_group(spark):
    rng = random.Random(1)
    fact = [(rng.choice("abcdex"), rng.randint(0, 9)) for _ in range(300)] + [("a", 1)] * 300
    entity = [("a", "g1"), ("b", "g1"), ("c", "g2"), ("d", "g2"), ("d", "g2"), ("e", None)]
    df = spark.createDataFrame(fact, "id string, v int")
    es = spark.createDataFrame(entity, "id string, g string")
    ours = sums_by_attribute(df, es, "id", ["g"], {"n": one(), "big": flag(F.col("v") > 4), "s": F.col("v")})
    plain = df.join(es, "id").groupBy("g").agg(F.count("*"), F.count_if(F.col("v") > 4), F.sum("v"))
    assert sorted(rows(ours), key=str) == sorted(rows(plain), key=str)


def test_value_counts(spark):
    df = spark.createDataFrame([("a", True), ("a", None), (None, False)], "s string, b boolean")
    assert set(rows(value_counts(df, "s", "b"))) == {("s", "a", 2), ("b", "true", 1), ("b", "false", 1)}


def _naive_median(pairs):
    groups = {}
    for g, v in pairs:
        if g is not None and v is not None and v == v:
            groups.setdefault(g, []).append(v)
    return {g: statistics.median(vs) for g, vs in groups.items()}


@pytest.mark.parametrize("seed", range(3))
def test_group_median_equals_statistics(spark, seed):
    rng = random.Random(seed)
    pairs = [
        (rng.choice(["p", "q", None]), rng.choice([None, rng.random(), rng.randint(0, 9) / 10])) for _ in range(500)
    ]
    pairs += [("hot", 0.5)] * 2000 + [("hot", rng.uniform(-3, 1e6)) for _ in range(1999)]
    pairs += [("two", 1.0), ("two", 2.0), ("one", -7.25), ("none", None)]
    pairs += [("far", v) for v in (1e300, -1e300, 250.0, 5.0, 1e18)]
    df = spark.createDataFrame(pairs, "g string, v double")
    assert dict(rows(group_median(df, "g", "v"))) == _naive_median(pairs)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.sampled_from("ab"),
            st.one_of(st.floats(-100, 100), st.floats(999_000, 1_001_000), st.sampled_from([float("nan"), 1e6, 0.0])),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_group_median_property(spark, pairs):
    pairs = [("hot", 1e6 + k % 701) for k in range(2500)] + pairs
    df = spark.createDataFrame(pairs, "g string, v double")
    assert dict(rows(group_median(df, "g", "v"))) == _naive_median(pairs)


def test_group_median_with_a_rough_bracket(spark):
    """The bracket is only a guess: with a coarse sketch the result is the same."""
    rng = random.Random(9)
    pairs = [("g", rng.choice([0.5, rng.gauss(0, 1e6)])) for _ in range(3001)]
    df = spark.createDataFrame(pairs, "g string, v double").repartition(7)
    assert dict(rows(group_median(df, "g", "v", sketch=8, margin=0.0))) == _naive_median(pairs)


def test_fill_builds_without_running_a_job(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None)], "g string, v double")
    spark.sparkContext.setJobGroup("median-build", "")
    fill_with_group_median(df, "g", "v")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("median-build")
    spark.sparkContext.setJobGroup("other", "")


def test_fill_with_group_median(spark):
    given_rows = [
        (1, "a", 3.0),
        (2, "a", None),
        (3, "a", 5.0),
        (4, None, 7.0),
        (5, None, None),
        (6, "b", None),
        (7, "c", 1.0),
        (8, "c", 2.0),
        (9, "c", 4.0),
        (10, "c", 8.0),
        (11, "c", None),
    ]
    df = spark.createDataFrame(given_rows, "i int, g string, v double")
    filled = {r.i: r.v for r in fill_with_group_median(df, "g", "v").collect()}
    assert filled == {1: 3, 2: 4, 3: 5, 4: None, 5: None, 6: None, 7: 1, 8: 2, 9: 4, 10: 8, 11: 3}


def test_fill_joins_by_shuffle_when_medians_are_too_large_to_broadcast(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, v double")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted(rows(fill_with_group_median(df, "g", "v"))) == [("a", 1.0), ("a", 1.0), ("b", 2.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _star(spark):
    rng = random.Random(5)
    ids = ["a", "b", "c", "d", "e"]
    entities = spark.createDataFrame([(i,) for i in ids], "id string")
    x = [(rng.choice(ids[:3] + ["lost"]), rng.randint(0, 1)) for _ in range(12)]
    y = [(rng.choice(ids[1:4]), rng.choice([None, rng.randint(40, 110)])) for _ in range(9)]
    return entities, spark.createDataFrame(x, "id string, bad int"), spark.createDataFrame(y, "id string, score int")


def test_fanout_algebra_equals_naive_join(spark):
    entities, x, y = _star(spark)
    naive = (
        entities.join(x, "id", "left")
        .join(y, "id", "left")
        .groupBy("id")
        .agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*"), F.sum("score") / F.count("score"))
    )
    facts = {
        "x": (x, {"bad": F.col("bad")}),
        "y": (y, {"score_sum": F.col("score"), "scores": flag(F.col("score").isNotNull())}),
    }
    nx, ny = multiplicity(F.col("n_x")), multiplicity(F.col("n_y"))
    for profiled in (entities.join(fact_profile("id", facts), "id", "left"), join_profile(entities, "id", facts)):
        algebra = profiled.select(
            "id",
            F.coalesce(product(F.col("bad"), ny), F.lit(0)),
            product(nx, ny),
            F.col("score_sum") / F.nullif(F.col("scores"), F.lit(0)),
        )
        assert sorted(rows(algebra), key=str) == sorted(rows(naive), key=str)


def test_fact_profile_keeps_unknown_keys(spark):
    _, x, _ = _star(spark)
    counts = Counter(r.id for r in x.collect())
    assert {r.id: r.n_x for r in fact_profile("id", {"x": (x, {})}).collect()} == counts


def test_product_is_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(2**40, 2**40), (3, 4), (None, 2)], "a bigint, b bigint")
    found = df.select(product(F.col("a"), F.col("b")).alias("p"))
    assert rows(found) == [(2**80,), (12,), (None,)]
    assert rows(found.where("p < 100").select(as_bigint(F.col("p")))) == [(12,)]
    with pytest.raises(Exception, match="exceeds 64 bits"):
        rows(found.select(as_bigint(F.col("p"))))
    with pytest.raises(Exception, match="exceeds 38 digits"):
        rows(df.select(product(*[F.col("a")] * 4)))


def test_students_with_counts_beyond_64_bits_come_first(spark):
    big = 4 * 10**9
    schema = (
        "Student_ID string, Full_Name string, Grade_Level string, copies bigint, n_messages bigint, n_performance bigint,"
        " score_sum bigint, scores bigint, n_attendance bigint, present bigint, missed bigint"
    )
    given_rows = [("S1", "a", "g", 1, 3, 2, 100, 2, 10, 0, 5), ("S2", "b", "g", 1, big, big, 100, 2, 50, 0, big)]
    df = spark.createDataFrame(given_rows, schema)
    assert [(r.Student_ID, r.Message_Count) for r in most_contacted(df).collect()] == [("S2", big * big), ("S1", 6)]
    found = {r.Student_ID: r.Missed_Assignments for r in at_risk_of(df).collect()}
    assert found == {"S1": 5 * 10 * 2 * 3, "S2": 50 * big**3}


def test_orphan_counts(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "id string")
    x = spark.createDataFrame([("a",), ("z",), ("z",), ("y",), (None,)], "id string")
    y = spark.createDataFrame([("b",), ("z",)], "id string")
    empty = y.filter("false")
    found = orphan_counts(entities, "id", {"x": x, "y": y, "empty": empty})
    assert rows(found) == [("x", 3), ("y", 1), ("empty", 0)]


def test_reports(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("c", 1)], "k string, `v_%` int")
    assert rows(shape_report({"t": df})) == [("t", 3, 2)]
    assert rows(contents_report({"t": df})) == [("t", 3, 2, 3)]
    assert rows(counts_report({"t": (df, null_conditions(df))})) == [("t", 3, 2, "k", 1), ("t", 3, 2, "v_%", 2)]


def test_top_n_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("c", 1), ("a", 1), ("b", 1), ("d", 0)], "id string, v int")
    assert [r.id for r in top_n(df, 2, F.desc("v"), "id").collect()] == ["a", "b"]
    assert [r.id for r in top_n(df, 2, F.asc("v"), "id").collect()] == ["d", "a"]
    same_id = spark.createDataFrame([("a", 1, n) for n in "zyxw"], "id string, v int, name string")
    for seed in range(4):
        assert [r.name for r in top_n(same_id.orderBy(F.rand(seed)), 2, F.desc("v"), "id").collect()] == ["w", "x"]


def test_reports_take_any_column_name(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int").toDF("it's", "`odd` \"name\"")
    assert rows(counts_report({"t": (df, null_conditions(df))}))[1][3:] == ('`odd` "name"', 1)
