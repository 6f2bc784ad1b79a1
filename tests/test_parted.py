"""Tables in parts: untouched files, crashes, clashes, retries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hostloom.sources import tables as R
from hostloom.sources import writers as K
from hostloom.sources.parted import ClashError, PartedTable, append_once, batch_appender


def rows_of(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def files_of(table):
    return {p: sorted(f.name for f in Path(folder).iterdir()) for p, folder in table.parts().items()}


@pytest.fixture
def table(spark, tmp_path):
    made = PartedTable(spark, str(tmp_path / "t"), "id", parts=8)
    made.replace(spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 2).alias("n")))
    return made


def test_merge_touches_only_its_parts(spark, table):
    before, rows = files_of(table), rows_of(table)
    assert len(before) == 8 and len(rows) == 100
    part = lambda k: str(spark.range(1).select(F.pmod(F.xxhash64(F.lit(k).cast("bigint")), F.lit(8))).first()[0])
    new = spark.createDataFrame([(7, "seven"), (7, "SEVEN"), (1000, None)], "id bigint, name string")
    assert table.merge(new, ["name"]) == 2
    touched = {part(7), part(1000)}
    after = files_of(table)
    assert {p for p in before if before[p] != after[p]} == touched
    want = sorted([r for r in rows if r[0] != 7] + [(7, "seven", 14), (1000, None, None)], key=repr)
    assert rows_of(table) == want
    table.merge(new, ["name"])
    assert rows_of(table) == want  # merging again changes nothing
    assert table.merge(new.limit(0), ["name"]) == 3  # no rows, no version
    plan = table.read([part(7)])
    assert {r["id"] for r in plan.collect()} == {r[0] for r in want if part(r[0]) == part(7)}
    assert all(f"hl_part={part(7)}/" in f for f in plan.inputFiles())


def test_delete_and_drop(spark, table):
    before = files_of(table)
    table.delete(F.col("id") == 5)
    after = files_of(table)
    assert sum(before[p] != after[p] for p in before) == 1 and len(rows_of(table)) == 99
    version = table.version()
    assert table.delete(F.col("id") == 5) == version  # nothing meets it
    assert table.delete(F.lit(None).cast("boolean")) == version
    first = sorted(after)[0]
    gone = {r["id"] for r in table.read([first]).collect()}
    table.drop([first, "no such part"])
    assert files_of(table) == {p: f for p, f in after.items() if p != first}
    assert {r[0] for r in rows_of(table)} == set(range(100)) - gone - {5}
    table.delete(F.lit(True))
    assert rows_of(table) == [] and table.parts() == {}
    table.merge(spark.createDataFrame([(1, "a")], "id bigint, name string"), ["name"])
    assert rows_of(table) == [(1, "a", None)]


def test_a_crash_before_the_commit_changes_nothing(spark, table, monkeypatch):
    rows, version = rows_of(table), table.version()
    new = spark.createDataFrame([(1, "x")], "id bigint, name string")

    def crash(*_):
        raise OSError("the driver died")

    with monkeypatch.context() as broken:
        broken.setattr(table, "_commit", crash)
        with pytest.raises(OSError, match="died"):
            table.merge(new, ["name"])
    assert rows_of(table) == rows and table.version() == version
    table.merge(new, ["name"])
    assert (1, "x", 2) in rows_of(table)
    left = len(list((Path(table.path) / "data").iterdir()))
    assert table.sweep(keep=1) == []  # too young: it could be a running change
    assert len(table.sweep(keep=1, older_than_s=0)) == 1
    assert len(list((Path(table.path) / "data").iterdir())) == left - 1 and (1, "x", 2) in rows_of(table)


def test_of_two_writers_one_is_told(spark, table, monkeypatch):
    other = PartedTable(spark, table.path, "id", parts=8)
    write = table._write

    def meanwhile(rows):
        out = write(rows)
        other.delete(F.col("id") == 3)
        return out

    with monkeypatch.context() as slow:
        slow.setattr(table, "_write", meanwhile)
        with pytest.raises(ClashError):
            table.merge(spark.createDataFrame([(1, "x")], "id bigint, name string"), ["name"])
    assert (1, "n1", 2) in rows_of(table) and 3 not in {r[0] for r in rows_of(table)}
    table.merge(spark.createDataFrame([(1, "x")], "id bigint, name string"), ["name"])
    assert (1, "x", 2) in rows_of(table) and 3 not in {r[0] for r in rows_of(table)}


def test_parts_must_follow_from_the_key(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path / "d"), "id", part=F.col("day"))
    table.replace(spark.createDataFrame([(1, "a"), (2, None)], "id bigint, day string"))
    assert set(table.parts()) == {"a", "none"}
    with pytest.raises(ValueError, match="follow from its key"):
        table._change(*table._state(), spark.createDataFrame([(1, "b")], "id bigint, day string"), ["a"])
    with pytest.raises(ValueError, match="letters"):
        table.replace(spark.createDataFrame([(1, "a b")], "id bigint, day string"))
    with pytest.raises(ValueError, match="no version"):
        PartedTable(spark, str(tmp_path / "none"), "id").read()


def test_versioned_table_tells_a_clash_and_starts_from_nothing(spark, tmp_path):
    table = K.VersionedTable(spark, str(tmp_path / "v"))
    table.merge(spark.createDataFrame([(1, "a"), (1, "b")], "id int, name string"), "id", ["name"])
    assert [tuple(r) for r in table.read().collect()] == [(1, "b")]
    table.replace(spark.createDataFrame([(2, "x")], "id int, name string"))
    with pytest.raises(ClashError):
        table.replace(spark.createDataFrame([(3, "y")], "id int, name string"), base=1)
    assert [tuple(r) for r in table.read().collect()] == [(2, "x")] and table.version() == 2


def test_a_run_appended_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = spark.createDataFrame([("u", 1.0, "2024-01-01 10:00:00"), ("u", 2.0, "2024-01-02 10:00:00")], "url string, p double, t string").withColumn("observed_at", F.to_timestamp("t"))
    append_once(rows.where("p = 1"), path, "r1")
    append_once(rows, path, "r2")
    append_once(rows.where("p = 2"), path, "r2")  # the retry found one row less: the first try's is gone
    assert sorted((r["run"], r["p"]) for r in spark.read.parquet(path).collect()) == [("r1", 1.0), ("r2", 2.0)]
    assert R.by_day(spark, path, "2024-01-02", "2024-01-03").count() == 1
    K.outbox(rows.withColumnRenamed("observed_at", "at"), str(tmp_path / "o"), run="a")
    K.outbox(rows.withColumnRenamed("observed_at", "at"), str(tmp_path / "o"), run="a")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    with pytest.raises(ValueError, match="run names"):
        append_once(rows, path, "a/b")


def test_a_stream_that_fails_after_its_write_appends_once(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(50).select("id", F.timestamp_seconds(F.col("id") * 5000).alias("observed_at")).repartition(3).write.parquet(source)
    append, tries = batch_appender(path, "log"), []

    def fails_once(rows, batch):
        append(rows, batch)
        tries.append(batch)
        if len(tries) == 2:
            raise RuntimeError("lost after the write")

    def start():
        stream = spark.readStream.schema("id bigint, observed_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.foreachBatch(fails_once).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost after the write"):
        start()
    start()
    assert len(tries) == 4 and len(set(tries)) == 3
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(50))
