"""Compaction by planned sizes, lookups that skip files."""

import random
import uuid

import pytest

from quarry.sources import io as sio


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_first_fit_decreasing(seed):
    rnd = random.Random(seed)
    files = [("f%d" % i, rnd.randint(0, 130)) for i in range(60)]
    got = sio.plan_groups(files, 100)
    want, room = [], []
    for path, n in sorted(files, key=lambda f: (-f[1], f[0])):
        at = next((i for i, r in enumerate(room) if n <= r), None) if n <= 100 else None
        if at is None:
            want.append([])
            room.append(100)
            at = len(want) - 1
        want[at].append(path)
        room[at] = max(-1, room[at] - n)
    assert got == want
    sizes = dict(files)
    assert sum(sum(sizes[p] for p in g) * 2 < 100 for g in got) <= 1
    assert sio.plan_groups([], 100) == [] and sio.plan_groups([("a", 5)], 100) == [["a"]]


def test_compact_bounds_files_and_keeps_rows(spark, tmp_path):
    rows = spark.range(6000).selectExpr("id", "md5(cast(id as string)) as t")
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    rows.repartition(3).write.option("maxRecordsPerFile", 70).parquet(src)
    rows.selectExpr("id + 6000 as id", "t").coalesce(1).write.mode("append").parquet(src)  # one file above the target
    target = 60_000
    assert max(n for _, n in sio.list_files(spark, src)) > target
    n = sio.compact(spark, src, dst, target, order_by="id")
    files = [(p, b) for p, b in sio.list_files(spark, dst)]
    back = spark.read.parquet(dst)
    assert back.count() == 12000 and back.exceptAll(rows.unionAll(rows.selectExpr("id + 6000", "t"))).isEmpty()
    assert max(b for _, b in files) <= target and n == len(files)
    for p, _ in files:
        ids = [r["id"] for r in spark.read.parquet(p).select("id").coalesce(1).collect()]
        assert ids == sorted(ids)


def test_compact_of_an_empty_table(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.range(0).write.parquet(src)
    sio.compact(spark, src, dst)
    assert spark.read.parquet(dst).collect() == []


def test_lookup_leaves_the_session_alone_and_pushes_ranges(spark, tmp_path):
    path, key = str(tmp_path / "t"), "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(key, "10")
    sio.write_by_id(spark.range(0, 80_000), path, 8)
    want = [5, 7, 30_001, 79_999, 90_000, *range(40_000, 41_000, 3)]
    got = sio.lookup(spark.read.parquet(path), spark.createDataFrame([(i,) for i in [*want, None]], "id long"))
    assert sorted(r["id"] for r in got.collect()) == sorted(i for i in want if i < 80_000)
    assert spark.conf.get(key, "10") == before
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan  # the ranges reach the scan
    none = sio.lookup(spark.read.parquet(path), spark.createDataFrame([(None,)], "id long"))
    assert none.collect() == []
    names = spark.createDataFrame([("n%05d" % i,) for i in range(500)], "id string")
    assert sio.lookup(names, names.where("id > 'n00100'")).count() == 399


def test_lookup_in_buckets_shuffles_the_request_only(spark, monkeypatch):
    table = "buckets_" + uuid.uuid4().hex[:8]
    sio.write_buckets(spark.range(0, 50_000).selectExpr("id", "id * 2 as v"), table, 8)
    try:
        monkeypatch.setattr(sio, "MAX_PUSHED_IDS", 100)
        ids = spark.range(0, 100_000, 5).select("id")
        got = sio.lookup_buckets(spark, table, ids)
        assert got.count() == 10_000 and got.where("v <> id * 2 or id % 5 <> 0").isEmpty()
        plan = got._jdf.queryExecution().executedPlan().toString()
        scan = plan[:plan.rindex(table)]
        assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 2  # distinct and join of the request
        few = sio.lookup_buckets(spark, table, spark.createDataFrame([(3,), (60_000,)], "id long"))
        assert [r["v"] for r in few.collect()] == [6] and scan
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_many_groups_and_many_large_files_take_few_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sio, "GROUPS_PER_JOB", 2)
    monkeypatch.setattr(sio, "FILES_PER_JOB", 8)
    src, dst = str(tmp_path / "a b+c%20"), str(tmp_path / "dst")
    rows = spark.range(8000).selectExpr("id", "md5(cast(id as string)) as t")
    rows.where("id < 4000").repartition(2).write.option("maxRecordsPerFile", 50).parquet(src)
    rows.where("id >= 4000").coalesce(1).write.option("maxRecordsPerFile", 200).mode("append").parquet(src)  # 20 files above the target
    sizes, target = dict(sio.list_files(spark, src)), 6000
    large = sum(n > target for n in sizes.values())
    groups = [g for g in sio.plan_groups(list(sizes.items()), target) if sizes[g[0]] <= target]
    assert large == 20 and len(groups) > 16
    tracker, tag = spark.sparkContext.statusTracker(), "compact-" + uuid.uuid4().hex
    spark.sparkContext.setJobGroup(tag, tag)
    n = sio.compact(spark, src, dst, target, order_by="id")
    jobs = len(tracker.getJobIdsForGroup(tag))
    spark.sparkContext.setJobGroup("", "")
    files = sio.list_files(spark, dst)
    back = spark.read.parquet(dst)
    assert back.columns == ["id", "t"] and back.count() == 8000 and back.exceptAll(rows).isEmpty()
    assert n == len(files) and max(b for _, b in files) <= target
    assert jobs < 60
    for p, _ in files:
        ids = [r["id"] for r in spark.read.parquet(p).select("id").coalesce(1).collect()]
        assert ids == sorted(ids)
