"""Streams give what batches give."""

from tesserine.streaming.watch import latest_by_key


def test_latest_by_key(spark, tmp_path):
    rows = [(i, i % 5, f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "t int, k int, v string")
    df.repartition(9).write.parquet(str(tmp_path / "in"))
    got = {r.k: r.v for r in latest_by_key(spark, str(tmp_path / "in"), df.schema, ["k"], ["t"]).collect()}
    assert got == {k: f"v{35 + k}" for k in range(5)}


def test_repeated_batches_and_a_lost_state(spark, tmp_path):
    import shutil

    import pytest

    from tesserine.streaming.watch import upsert_latest

    folder = str(tmp_path / "state")
    run = upsert_latest(spark, folder, ["k"], ["t"], 4)
    make = lambda rows: spark.createDataFrame(rows, "t int, k int, v string")
    read = lambda: sorted((r.k, r.v) for r in spark.read.parquet(folder).collect())
    run(make([(1, k, "a") for k in range(8)]), 0)
    stamps = {f: f.stat().st_mtime_ns for f in (tmp_path / "state").glob("part=*/*.parquet")}
    for _ in range(2):  # the second time as after a failure
        run(make([(2, 3, "b"), (0, 4, "late")]), 1)
        assert read() == [(k, "b" if k == 3 else "a") for k in range(8)]
    left = {f for f in (tmp_path / "state").glob("part=*/*.parquet") if f in stamps and f.stat().st_mtime_ns == stamps[f]}
    assert left  # partitions without keys of the batch stay as they were
    shutil.rmtree(folder)
    with pytest.raises(RuntimeError):
        run(make([(3, 1, "c")]), 2)


def test_change_source(spark, tmp_path):
    from tesserine.sources import files

    root = tmp_path / "root"
    root.mkdir()
    (root / "a.py").write_text("x = 1")
    (root / "_b.py").write_text("y = 1")
    files.register(spark)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def once():
        q = spark.readStream.format("repository_changes").option("root", str(root)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.path, r.op) for r in spark.read.parquet(out).collect())

    assert once() == [("_b.py", "write"), ("a.py", "write")]
    (root / "a.py").unlink()
    assert ("a.py", "delete") in once()
