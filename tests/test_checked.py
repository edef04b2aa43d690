"""Joins that hold their inputs to their promises, scans of unlike parts, committed tables."""

import datetime as dt

import pytest

from saltern.operators.checked import JoinError, checked_join
from saltern.sources.committed import CommittedTable, cached
from saltern.sources.scans import available, scan_parts


def test_a_join_keeps_every_left_row_and_counts_partners(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (3, 30), (None, 40), (None, 41)], "k int, y int")
    j = checked_join(left, right, ["k"], coverage=0.5)
    assert sorted(map(tuple, j.rows.collect()), key=str) == sorted([(1, "a", 10), (1, "b", 10), (2, "c", None), (None, "d", None)], key=str)
    assert j.verify() == 0.5
    j = checked_join(left, right, ["k"], coverage=0.98)
    j.rows.collect()
    with pytest.raises(JoinError, match="50.00% of 4"):
        j.verify()
    none = checked_join(left.where("false"), right, ["k"], coverage=0.98)
    assert none.rows.collect() == [] and none.verify() == 1.0


def test_duplicate_keys_fail_the_action(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (1, 11)], "k int, y int")
    with pytest.raises(Exception, match="right side: several rows for 1"):
        checked_join(left, right, ["k"]).rows.collect()
    with pytest.raises(Exception, match="left side: several rows for 1"):
        checked_join(left, right.where("y = 10"), ["k"], "one_to_one").rows.collect()
    ok = checked_join(spark.createDataFrame([(1, "a"), (None, "n"), (None, "n")], "k int, x string"), right.where("y = 10"), ["k"], "one_to_one")
    assert sorted(map(tuple, ok.rows.collect()), key=str) == [(1, "a", 10), (None, "n", None), (None, "n", None)]
    with pytest.raises(ValueError, match="columns on both sides: x"):
        checked_join(left, left, ["k"])
    with pytest.raises(ValueError, match="unknown validation"):
        checked_join(left, right, ["k"], "many_to_many")


def test_a_checked_join_scans_each_side_once(spark, tmp_path):
    for name in ("l", "r"):
        spark.range(50).selectExpr("id as k", f"id * 2 as {name}").write.parquet(str(tmp_path / name))
    j = checked_join(spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r")), ["k"])
    j.rows.collect()
    assert j.verify() == 1.0
    assert j.rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 2


def test_parts_of_several_schemas(spark, tmp_path):
    at = lambda k: str(tmp_path / k)
    spark.sql("select 1L as id, true as flag, double('inf') as x, 'drop' as other").write.parquet(at("a"))
    spark.sql("select 2 as id, 0.5 as flag, '7.5' as x, date'2020-01-01' as day").write.parquet(at("b"))
    spark.sql("select 3.0 as id, float('nan') as x").write.parquet(at("c"))
    spark.sql("select 4L as id, false as flag, 2.0d as x, 'drop' as other").write.parquet(at("d"))
    spark.sql("select 'x' as nothing").write.parquet(at("e"))
    wanted = {"id": "long", "flag": "double", "x": "float", "day": "date"}
    df = scan_parts(spark, [at(k) for k in "abcde"], wanted)
    assert df.dtypes == [("id", "bigint"), ("flag", "double"), ("x", "float"), ("day", "date")]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, 1.0, None, None), (2, 0.5, 7.5, dt.date(2020, 1, 1)), (3, None, None, None), (4, 0.0, 2.0, None), (None, None, None, None)], key=str)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4 and "other" not in plan and "nothing" not in plan
    assert scan_parts(spark, [], wanted).collect() == []
    flags = scan_parts(spark, [at("b")], {"flag": "boolean", "x": "long", "id": "string"}).collect()
    assert [tuple(r) for r in flags] == [(True, 7, "2")]


def test_optional_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert available(df, ["a"], ["b", "c", "a"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match=r"\['c'\]"):
        available(df, ["c"], [])


def test_a_resumed_run_makes_what_is_missing(spark, tmp_path):
    t = CommittedTable(spark, str(tmp_path / "t"))
    days = spark.sql("select explode(sequence(date'2020-01-01', date'2020-01-04')) as date")
    rows = days.selectExpr("date", "explode(array(0L, 1L)) as id")
    schema = "date date, id long"
    assert t.missing(days).count() == 4 and t.read(schema).count() == 0
    assert t.commit(rows.where("date < '2020-01-03'")) == 4
    # a write that is killed before its manifest leaves a part that no reader sees
    rows.write.partitionBy("date").parquet(f"{t.path}/data/part=killed")
    assert t.read(schema).count() == 4 and sorted(str(r.date) for r in t.missing(days).collect()) == ["2020-01-03", "2020-01-04"]
    assert t.commit(rows) == 4 and t.commit(rows) == 0  # the dates that were there stay as they were
    assert sorted((str(r.date), r.id) for r in t.read(schema).collect()) == sorted((f"2020-01-0{d}", i) for d in range(1, 5) for i in range(2))
    assert t.missing(days).count() == 0


def test_a_failed_write_commits_nothing(spark, tmp_path):
    t = CommittedTable(spark, str(tmp_path / "t"))
    bad = spark.range(3).selectExpr("date'2020-01-01' as date", "if(id = 2, raise_error('stop'), id) as id")
    with pytest.raises(Exception, match="stop"):
        t.commit(bad)
    assert t.manifest().count() == 0 and t.read("date date, id long").count() == 0


def test_the_cache_builds_once_for_the_same_parameters(spark, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    at = str(tmp_path / "cache")
    for n in (3, 3, 4, 3):
        assert cached(spark, at, {"n": n, "model": "ridge"}, lambda n=n: build(n)).count() == n
    assert built == [3, 4]
    with pytest.raises(Exception, match="stop"):
        cached(spark, at, {"n": 9}, lambda: spark.range(1).selectExpr("raise_error('stop') as x"))
    assert cached(spark, at, {"n": 9}, lambda: build(9)).count() == 9
