"""Problem 5: fingerprints, recomputation of changed partitions only, failures in between, and the pending versions."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserine.operators.incremental import IncrementalTable, PartitionedSource, changed_partitions, current_versions, fingerprints, pending_versions, with_partition

SCHEMA = "k string, v string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def compute(df, parts=None):
    return df.select("k", F.upper("v").alias("u"), "part")


def result(t):
    return sorted((r.k or "", r.u or "") for r in t.result("k string, u string, part int").collect())


def test_fingerprints_are_additive(spark):
    rows = [(f"k{i % 50}", f"v{i}") for i in range(300)] + [(None, "x"), ("k", None), (None, None), ("k1", "v1"), ("k1", "v1")]
    df = with_partition(table(spark, rows), ["k"], 7)
    a = {r.part: (r.n, r.low, r.high) for r in fingerprints(df, ["k", "v"]).collect()}
    b = {r.part: (r.n, r.low, r.high) for r in fingerprints(df.repartition(5).orderBy(F.rand()), ["k", "v"]).collect()}
    assert a == b and sum(x[0] for x in a.values()) == len(rows)
    swapped = with_partition(table(spark, [("a", None), (None, "a")]), ["k"], 1)
    other = with_partition(table(spark, [(None, None), ("a", "a")]), ["k"], 1)
    assert changed_partitions(fingerprints(swapped, ["k", "v"]), fingerprints(other, ["k", "v"])).count() == 1


def test_incremental_table(spark, tmp_path):
    t = IncrementalTable(spark, str(tmp_path / "t"), ["k"], ["k", "v"], 16)
    rows = [(f"k{i}", f"v{i}") for i in range(100)]
    assert t.run(table(spark, rows), compute) == 16 and len(result(t)) == 100
    assert t.run(table(spark, random.sample(rows, 100)), compute) == 0
    rows[3] = ("k3", "new")
    seen = []

    def watched(df, parts):
        seen.append(df.count())
        return compute(df)

    assert t.run(table(spark, rows), watched) == 1 and seen[0] < 30 and ("k3", "NEW") in result(t)
    # A run that fails before or after the results are written is repeated as a whole.
    rows[4] = ("k4", "later")

    def broken(df, parts):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        t.run(table(spark, rows), broken)
    dealt = with_partition(table(spark, rows), ["k"], 16)
    half = dealt.join(dealt.where("k = 'k4'").select("part"), "part", "left_semi")
    t._write(compute(half).withColumn("__mark", F.lit(False)), "result")
    assert t.run(table(spark, rows), compute) == 1 and ("k4", "LATER") in result(t) and len(result(t)) == 100
    assert t.run(table(spark, rows[:50]), compute) > 0 and len(result(t)) == 50
    assert t.run(table(spark, []), compute) > 0 and result(t) == []


def test_partitions_left_without_results_are_replaced(spark, tmp_path):
    t = IncrementalTable(spark, str(tmp_path / "t"), ["k"], ["k", "v"], 4)
    kept = lambda df, parts: df.where("v <> 'gone'").select("k", F.upper("v").alias("u"), "part")
    assert t.run(table(spark, [(f"k{i}", "v") for i in range(8)]), kept) == 4 and len(result(t)) == 8
    assert t.run(table(spark, [(f"k{i}", "gone") for i in range(8)]), kept) == 4 and result(t) == []
    assert t.run(table(spark, [(f"k{i}", "gone") for i in range(8)]), kept) == 0 and result(t) == []


def test_only_changed_partitions_of_a_stored_source_are_read(spark, tmp_path):
    source = PartitionedSource(spark, str(tmp_path / "s"), ["k"], ["k", "v"], 16)
    t = IncrementalTable(spark, str(tmp_path / "t"), ["k"], ["k", "v"], 16)
    source.append(table(spark, [(f"k{i}", f"v{i}") for i in range(200)] + [("hot", "x")] * 100), "one")
    assert t.run(source, compute) == 16 and len(result(t)) == 300
    source.append(table(spark, [("k3", "more")]), "two")
    source.append(table(spark, [("k3", "more")]), "two")  # delivered again
    whole = sum(len(f.inputFiles()) for f in [source.rows()])
    read = []

    def watched(df, parts):
        scanned = df.select("k", "v", "part")
        read.append((parts, len(scanned.select("part").distinct().collect()), scanned.count()))
        plan = scanned._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan, plan
        return compute(df)

    assert t.run(source, watched) == 1 and whole >= 17
    assert read[0][1] == 1 and read[0][2] < 150 and len(result(t)) == 301 and ("k3", "MORE") in result(t)
    # A batch whose fingerprints were not written does not count, and its repetition does.
    source._delete("fingerprints/batch=two")
    assert t.run(source, compute) == 1 and len(result(t)) == 300
    source.append(table(spark, [("k3", "more")]), "two")
    assert t.run(source, compute) == 1 and len(result(t)) == 301 and t.run(source, compute) == 0


def versions(r, n):
    day = datetime(2026, 1, 1)
    files, cache = [], []
    for i in range(n):
        repo, path = r.choice(["a", "b", None]), r.choice(["x", "y", "z", None]) if i % 7 == 0 else f"p{r.randint(0, n // 2)}"
        text = r.choice([None, "", f"t{r.randint(0, 5)}"])
        files.append((i, repo, path, text, day + timedelta(days=r.randint(0, 3))))
        h = hashlib.sha256((text or "other").encode()).hexdigest()
        for _ in range(r.randint(0, 2)):
            cache.append((repo, path, r.choice([h, h.upper(), "sha256:" + h, "00", None]), r.randint(1, 6), day + timedelta(hours=r.randint(0, 9)), r.choice([("m",), ("m",), None])))
    return files, cache


def test_pending_versions(spark):
    r = random.Random(12)
    files, cache = versions(r, 120)
    runs = [(1, "success"), (2, "failed"), (3, "success"), (4, "running"), (5, "success"), (6, None)]
    good = {k for k, s in runs if s == "success"}
    want = set()
    latest = {}
    for f in files:
        key = (f[1], f[2])
        if key not in latest or (f[4], f[0]) > (latest[key][4], latest[key][0]):
            latest[key] = f
    for key, f in latest.items():
        rows = [c for c in cache if (c[0], c[1]) == key and c[3] in good and c[5] is not None]
        norm = lambda h: h and h.lower().removeprefix("sha256:")
        best = max(rows, key=lambda c: (c[3], c[4], norm(c[2]) or ""), default=None)
        if best is None or f[3] is None or norm(best[2]) != hashlib.sha256(f[3].encode()).hexdigest():
            want.add(f[0])
    df = spark.createDataFrame([(*f, "clash") for f in [*files, files[0]]], "file_id bigint, repo string, path string, content string, modified_at timestamp, hash string")
    cf = spark.createDataFrame(cache, "repo string, path string, content_hash string, run_id bigint, cached_at timestamp, module struct<language:string>")
    rf = spark.createDataFrame(runs, "run_id bigint, status string")
    for partitions in (1, 64):
        assert {x.file_id for x in pending_versions(df, cf, rf, partitions).collect()} == want
    assert {x.file_id for x in pending_versions(df, cf.limit(0), rf).collect()} == {f[0] for f in latest.values()}
    assert pending_versions(df.limit(0), cf, rf).count() == 0 and current_versions(df).count() == len(latest)
