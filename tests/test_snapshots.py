"""Versioned snapshots: isolation of readers, conflicts, failed writes, rollback, vacuum."""

import os

import pytest
from docweft.operators import dedup
from docweft.sources.snapshots import SnapshotConflict, SnapshotTable, changes
from pyspark.sql import functions as F


def rows(spark, n, add=0):
    return spark.range(n).select("id", F.concat(F.lit("s"), F.col("id") + add).alias("status"), (F.col("id") * 2).alias("size"))


def values(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.create(rows(spark, 40), ["id"], parts=4)
    return t


def test_upserts_equal_the_batch_operators(spark, table):
    before = table.read()
    new = rows(spark, 60, 100).unionByName(rows(spark, 60, 200))
    assert table.insert_absent(new, "status") == 2
    want = before.unionByName(dedup.insert_if_absent(before, new, ["id"], order="status"))
    assert values(table.read()) == values(want)
    patches = spark.createDataFrame([(3, "x", None), (50, None, 7), (999, "none", 1)], "id long, status string, size long")
    assert table.patch(patches) == 3
    assert values(table.read()) == values(dedup.patch_by_key(want, patches, ["id"]))
    assert values(before) == values(rows(spark, 40))  # a frame that was read stays at its version
    assert values(table.read(2)) == values(want)
    assert {(r.id, r.change) for r in changes(table.read(2), table.read(3), ["id"]).collect()} == {(3, "changed"), (50, "changed")}


def test_only_touched_parts_are_written(spark, table):
    old = table.manifest()
    table.patch(spark.createDataFrame([(3, "x")], "id long, status string"))
    new = table.manifest()
    assert sum(old.folders[p] != new.folders[p] for p in old.folders) == 1
    assert table.patch(spark.createDataFrame([], "id long, status string")) == 2  # nothing to do, no version


def test_failed_write_changes_nothing(spark, table):
    bad = spark.createDataFrame([(3, "x")], "id long, status string").withColumn("status", F.expr("raise_error('no')").cast("string"))
    with pytest.raises(Exception, match="no"):
        table.patch(bad)
    assert table.versions() == [1] and values(table.read()) == values(rows(spark, 40))
    # a writer that died while it wrote the manifest
    with open(os.path.join(table.path, "_commits", f"{2:010d}"), "w") as f:
        f.write("{")
    assert table.manifest().version == 1
    assert table.patch(spark.createDataFrame([(3, "x")], "id long, status string")) == 3


def test_concurrent_writers(spark, table):
    base = table.manifest()
    parts = {r.id: r.p for r in table._dealt(rows(spark, 40), base).select("id", F.col("_part").alias("p")).collect()}
    other = next(i for i in parts if parts[i] != parts[0])
    mine = table._write(table._dealt(rows(spark, 40).where(f"pmod(xxhash64(id), 4) = {parts[0]}"), base), [parts[0]])
    table.patch(spark.createDataFrame([(other, "first")], "id long, status string"))
    assert table._publish(base, mine) == 3  # other parts: both stay
    assert dict((r[0], r[1]) for r in values(table.read()))[other] == "first"
    table.patch(spark.createDataFrame([(0, "again")], "id long, status string"))
    with pytest.raises(SnapshotConflict):
        table._publish(base, mine)
    assert table.versions()[-1] == 4
    with pytest.raises(SnapshotConflict):
        table.create(rows(spark, 3), ["id"])


def test_rollback_and_vacuum(spark, table):
    for i in range(3):
        table.patch(spark.createDataFrame([(i, "x")], "id long, status string"))
    assert table.roll_back(1) == 5 and values(table.read()) == values(rows(spark, 40))
    assert table.vacuum(keep=1) >= 1
    assert table.versions() == [5] and values(table.read()) == values(rows(spark, 40))


def test_empty_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "e"))
    with pytest.raises(FileNotFoundError):
        t.read()
    t.create(rows(spark, 0), ["id"], parts=2)
    assert t.read().count() == 0
    t.insert_absent(rows(spark, 5), "status")
    assert values(t.read()) == values(rows(spark, 5))
