from moveproof.sources.load import ingest, read_loaded
from test_sources import put

MAPPING = {"manual": {"CustomerID": "customer_id", "FirstName": "first_name"}}
TYPES = {"customers": {"customer_id": "BIGINT"}, "events": {"n": "BIGINT"}}


def load(spark, base, run, **options):
    rows = ingest(spark, f"{base}/in", f"{base}/out", run,
                  table_names={"Customer Records": "customers"}, column_mapping=MAPPING,
                  types=TYPES, **options).collect()
    return {r["file"]: (r["status"], r["rows_inserted"]) for r in rows}


def test_load_skip_evolve_and_reload(spark, tmp_path):
    base, folder = str(tmp_path), tmp_path / "in"
    put(folder, "Customer Records.csv", "CustomerID, FirstName \n1,Ann\n2,Bob\n")
    put(folder, "events.json", '[{"n": 1}, {"n": 2, "kind": "x"}]')
    put(folder, "readme.txt", "not data")
    assert load(spark, base, "r1") == {
        "Customer Records.csv": ("SUCCESS", 2), "events.json": ("SUCCESS", 2),
        "readme.txt": ("UNSUPPORTED", 0)}
    customers = read_loaded(spark, f"{base}/out", "customers")
    assert dict(customers.dtypes) == {"customer_id": "bigint", "first_name": "string"}
    assert load(spark, base, "r2") == {}  # same name, same content

    put(folder, "Customer Records.csv", "CustomerID,City\n3,Oslo\n")
    assert load(spark, base, "r3") == {"Customer Records.csv": ("SUCCESS", 1)}
    got = sorted((r["customer_id"], r["first_name"], r["city"])
                 for r in read_loaded(spark, f"{base}/out", "customers").collect())
    assert got == [(1, "Ann", None), (2, "Bob", None), (3, None, "Oslo")]

    put(folder, "Customer Records.csv", "CustomerID,Extra\n4,1\n")
    assert load(spark, base, "r4", strict=True) == {"Customer Records.csv": ("FAILED", 0)}
    assert load(spark, base, "r5", mode="reload")["Customer Records.csv"] == ("SUCCESS", 1)
    assert read_loaded(spark, f"{base}/out", "customers").count() == 1


def test_a_file_with_a_bad_row_loads_nothing(spark, tmp_path):
    base, folder = str(tmp_path), tmp_path / "in"
    put(folder, "customers.csv", "CustomerID,FirstName\n1,Ann\nx,Bob\n")
    assert load(spark, base, "r1") == {"customers.csv": ("FAILED", 0)}
    assert read_loaded(spark, f"{base}/out", "customers").count() == 0
    held = spark.read.parquet(f"{base}/out/_quarantine/customers").collect()
    assert len(held) == 2 and {r["error"] for r in held} == {None, "customer_id: not BIGINT"}
    put(folder, "customers.csv", "CustomerID,FirstName\n1,Ann\n2,Bob\n")
    assert load(spark, base, "r2") == {"customers.csv": ("SUCCESS", 2)}


def test_missing_required_column_and_collision(spark, tmp_path):
    base, folder = str(tmp_path), tmp_path / "in"
    put(folder, "customers.csv", "FirstName\nAnn\n")
    put(folder, "other.csv", "a,A \n1,2\n")
    got = load(spark, base, "r1", required={"customers": ["customer_id"]})
    assert got == {"customers.csv": ("FAILED", 0), "other.csv": ("FAILED", 0)}


def test_one_bad_file_does_not_end_the_run(spark, tmp_path):
    base, folder = str(tmp_path), tmp_path / "in"
    put(folder, "events.json", '{"n": 1}\n{"n": oops\n')
    put(folder, "good.json", '{"n": 1}\n{"n": 2}\n')
    put(folder, "more.csv", "a,b\n1,2\n")
    assert load(spark, base, "r1") == {
        "events.json": ("FAILED", 0), "good.json": ("SUCCESS", 2), "more.csv": ("SUCCESS", 1)}
    held = spark.read.parquet(f"{base}/out/_quarantine/events").collect()
    assert sorted(str(r["error"]) for r in held) == ["None", "malformed line"]


def test_a_run_that_broke_off_is_repeated_without_doubles(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    base, folder = str(tmp_path), tmp_path / "in"
    put(folder, "customers.csv", "CustomerID,FirstName\n1,Ann\n")
    put(folder, "events.json", '{"n": 1}\n')
    write = DataFrameWriter.parquet

    def broken(self, path, *args, **options):
        if path.endswith("_history") and any("r1" in str(r) for r in self._df.take(1)):
            raise RuntimeError("lost")
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    try:
        load(spark, base, "r1")
        raise AssertionError("the run went on")
    except RuntimeError:
        monkeypatch.undo()
    assert load(spark, base, "r1") == {"customers.csv": ("SUCCESS", 1), "events.json": ("SUCCESS", 1)}
    assert read_loaded(spark, f"{base}/out", "customers").count() == 1
    assert load(spark, base, "r2") == {}


def test_files_of_a_table_under_different_headers(spark, tmp_path):
    base, folder = str(tmp_path), tmp_path / "in"
    for i, text in enumerate(("CustomerID,FirstName\n1,Ann\n", "first_name,customer_id\nBob,2\n")):
        put(folder, f"customers.{i}.csv", text)
    rows = ingest(spark, f"{base}/in", f"{base}/out", "r1", column_mapping=MAPPING,
                  table_names={"customers.0": "customers", "customers.1": "customers"}).collect()
    assert {r["status"] for r in rows} == {"SUCCESS"}
    got = read_loaded(spark, f"{base}/out", "customers").select("customer_id", "first_name").collect()
    assert sorted(map(tuple, got)) == [("1", "Ann"), ("2", "Bob")]


def test_values_beyond_32_bits_and_many_decimals(spark, tmp_path):
    base, folder = str(tmp_path), tmp_path / "in"
    put(folder, "big.csv", "n,p\n3000000000,1.234567\n")
    rows = ingest(spark, f"{base}/in", f"{base}/out", "r1", types={"big": {"n": "INTEGER", "p": "NUMERIC"}})
    assert rows.first()["status"] == "SUCCESS"
    row = read_loaded(spark, f"{base}/out", "big").first()
    assert row["n"] == 3000000000 and float(row["p"]) == 1.234567
    put(folder, "fine.csv", "p\n0.1234567890123456789\n")
    rows = ingest(spark, f"{base}/in", f"{base}/out", "r2", types={"fine": {"p": "NUMERIC"}})
    assert rows.first()["status"] == "FAILED"
