import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from moveproof.sources import load, measured, writers
from moveproof.sources.versioned import NoSuchVersion, VersionedTable
from test_sources import put


def keys(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_append_replace_and_earlier_versions(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "t"))
    assert table.write(spark.range(3)) == 0
    assert table.write(spark.range(3, 5)) == 1
    before = table.read(spark)
    assert table.write(spark.range(7, 9).withColumn("more", F.lit("x")), replace=True) == 2
    table.write(spark.range(9, 10))
    assert keys(table.read(spark)) == [7, 8, 9] and table.read(spark).columns == ["id", "more"]
    assert keys(before) == keys(table.read(spark, 1)) == [0, 1, 2, 3, 4]
    assert [(r.version, r.rows) for r in table.history(spark).orderBy("version").collect()] == [(0, 3), (1, 2), (2, 2), (3, 1)]
    with pytest.raises(NoSuchVersion):
        table.read(spark, 9)


@pytest.mark.parametrize("step", ["data-", "_manifest"])
def test_a_reload_that_breaks_off_leaves_the_old_rows(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    writers.write_table(spark.range(5), path, "skip")
    write = DataFrameWriter.parquet

    def broken(self, path, *args, **options):
        if step in path.rsplit("/", 1)[1] and self._df.columns != ["version", "folder", "replaces", "rows"] or (
                step == "_manifest" and path.endswith(step) and self._df.take(1)):
            if step == "data-":  # half of the rows are there when the driver goes
                write(self, path)
            raise RuntimeError("lost")
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(RuntimeError):
        writers.write_table(spark.range(100, 103), path, "reload")
    monkeypatch.undo()
    assert keys(writers.read_table(spark, path)) == [0, 1, 2, 3, 4]
    writers.write_table(spark.range(100, 103), path, "reload")
    assert keys(writers.read_table(spark, path)) == [100, 101, 102]
    gone = VersionedTable(path).vacuum(spark)
    assert len(gone) == 2 and keys(writers.read_table(spark, path)) == [100, 101, 102]


def test_vacuum_keeps_what_kept_versions_need(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "t"))
    for i in range(4):
        table.write(spark.range(i, i + 1), replace=i == 2)
    assert table.vacuum(spark, keep=3) == []
    assert len(table.vacuum(spark, keep=2)) == 2
    assert keys(table.read(spark)) == [2, 3] and keys(table.read(spark, 2)) == [2]


def test_unwritten_table(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "t"))
    with pytest.raises(NoSuchVersion):
        table.read(spark)
    assert table.read(spark, schema=spark.range(0).schema).count() == 0
    table.write(spark.range(0))
    assert keys(table.read(spark)) == []


def test_measures_are_those_of_the_written_rows(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("x"),
                                 F.when(F.col("id") % 4 == 0, float("nan")).otherwise(1.0).alias("y")).repartition(5)
    checks = {"x": F.col("x") > 10}
    got = measured.measured_write(df, str(tmp_path / "t"), measured.table_measures(df.schema, checks))
    assert got == {"rows": 100, "nulls:id": 0, "nulls:x": 34, "nulls:y": 25,
                   "failed:x": 100 - sum(i % 3 > 0 and i > 10 for i in range(100))}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_history_of_a_load_is_measured_by_the_writing_job(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    put(folder, "a.csv", "n\n1\n2\n")
    put(folder, "a2.csv", "n\n3\nx\n")
    put(folder, "empty.csv", "n\n")
    options = dict(table_names={"a": "t", "a2": "t", "empty": "t"}, types={"t": {"n": "BIGINT"}})

    def run(target):
        rows = load.ingest(spark, str(folder), str(tmp_path / target), "r1", **options).drop("load")
        return sorted(map(tuple, rows.collect()))

    monkeypatch.setattr(load, "OBSERVED_FILES", 0)
    counted = run("counted")
    monkeypatch.undo()

    def no_second_pass(*args):
        raise AssertionError("the stored rows were counted in a pass of their own")

    monkeypatch.setattr(writers, "load_history", no_second_pass)
    assert run("observed") == counted
    assert [(r[1], r[5], r[6], r[7]) for r in counted] == [
        ("a.csv", 2, 0, "SUCCESS"), ("a2.csv", 0, 1, "FAILED"), ("empty.csv", 0, 0, "SUCCESS")]
