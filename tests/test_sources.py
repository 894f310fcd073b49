import hashlib
import json

import pytest
from pyspark.sql import functions as F

from moveproof.operators import shape
from moveproof.sources import readers, writers


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder / name)


def test_encodings(spark, tmp_path):
    cases = {"utf8": "é".encode(), "bom": b"\xef\xbb\xbf" + "é".encode(), "cp1252": b"\x80uro",
             "latin1": b"\x81\xe9"}
    wanted = {"utf8": "é", "bom": "é", "cp1252": "€uro", "latin1": "\x81é"}
    for name, raw in cases.items():
        bom, body = (raw[:3], raw[3:]) if name == "bom" else (b"", raw)
        path = put(tmp_path / name, "a.csv", bom + b" id ,name\n1," + body + b"\n2,\n")
        got = [tuple(r) for r in readers.read_csv(spark, path).collect()]
        assert got == [("1", wanted[name]), ("2", None)], name


def test_mixed_folder_keeps_every_row(spark, tmp_path):
    put(tmp_path / "m", "a.csv", "id,note\n1,plain\n")
    put(tmp_path / "m", "b.csv", b"id,note\n2,caf\xe9\n")
    put(tmp_path / "m", "c.csv", 'id,note\n3,"two\nlines, ""quoted"""\n4,x\n')
    got = {r["id"]: r["note"] for r in readers.read_csv(spark, str(tmp_path / "m")).collect()}
    assert got == {"1": "plain", "2": "café", "3": 'two\nlines, "quoted"', "4": "x"}


def test_every_file_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "h"
    put(folder, "a.csv", "id,name\n1,ann\n3,cy\n")
    put(folder, "b.csv", "\n name , id\nbob,2\n")
    put(folder, "c.csv", "id,name,extra\n4,dan,x\n")
    put(folder, "d.csv", '"id","na\nme"\n5,eve\n')
    got = sorted(map(tuple, readers.read_csv(spark, str(folder)).select("id", "name", "extra", "`na\nme`").collect()))
    assert got == [("1", "ann", None, None), ("2", "bob", None, None), ("3", "cy", None, None),
                   ("4", "dan", "x", None), ("5", None, None, "eve")]


def test_array_items_that_are_no_objects(spark, tmp_path):
    path = put(tmp_path / "arr", "a.json", '[1, {"a": 1, "n": {"q": 1.5}},\n null, "s", {"a": 2, "b": [1]}]')
    df = readers.read_json(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "array<bigint>", "n": "struct<q:double>"}
    assert sorted((r["a"] or 0) for r in df.collect()) == [0, 0, 0, 1, 2]
    assert readers.read_json(spark, path, "a int").agg(F.sum("a")).first()[0] == 3
    only = put(tmp_path / "arr2", "a.json", "[1, 2]")
    assert readers.read_json(spark, only).count() == 2


def test_only_empty_is_null_for_loads(spark, tmp_path):
    path = put(tmp_path / "n", "a.csv", 'a,b\n"",NA\n" ",null\n')
    df = readers.read_csv(spark, path)
    assert [tuple(r) for r in df.collect()] == [(None, "NA"), (" ", "null")]
    assert [tuple(r) for r in readers.na_to_null(df).collect()] == [(None, None), (" ", None)]


def test_json_forms(spark, tmp_path):
    objects = [{"a": 1}, {"b": "x", "a": 2}]
    forms = {
        "array": json.dumps(objects), "pretty": json.dumps(objects, indent=2),
        "lines": "\n".join(map(json.dumps, objects)) + "\n\n",
    }
    for name, text in forms.items():
        path = put(tmp_path / name, "a.json", text)
        got = sorted((r["a"], r["b"]) for r in readers.read_json(spark, path).collect())
        assert got == [(1, None), (2, "x")], name
    tricky = put(tmp_path / "tricky", "a.json", '[\n{"a": 1, "b": "}]\\""},\n{"a": 2}\n]')
    assert readers.read_json(spark, tricky).count() == 2
    one = put(tmp_path / "one", "a.json", json.dumps({"a": 1, "n": {"c": [1]}}, indent=1))
    assert readers.read_json(spark, one).first()["n"]["c"] == [1]
    both = tmp_path / "both"
    put(both, "a.json", forms["pretty"])
    put(both, "b.json", '{"a": 3}\n{"c": true}')
    assert readers.read_json(spark, str(both)).count() == 4


def test_long_strings(spark, tmp_path):
    text = 'say "x" {[ ' * 60000
    path = put(tmp_path / "long", "a.json", "\n".join(json.dumps({"t": text}) for _ in range(3)))
    assert [len(r["t"]) for r in readers.read_json(spark, path).collect()] == [len(text)] * 3
    row = put(tmp_path / "longcsv", "a.csv", "t\n" + "word " * 100000 + "\n")
    assert len(readers.read_csv(spark, row).first()["t"]) == 500000


def test_bad_lines(spark, tmp_path):
    path = put(tmp_path / "bad", "a.json", '{"a": 1}\n{"a": oops\n{"a": 3}\n')
    assert sorted(r["a"] for r in readers.read_json(spark, path, "a int", "skip").collect()) == [1, 3]
    kept = readers.read_json(spark, path, "a int, _corrupt_record string", "keep")
    assert sorted(r["_corrupt_record"] is None for r in kept.collect()) == [False, True, True]
    with pytest.raises(Exception):
        readers.read_json(spark, path, "a int", "fail").collect()
    first = put(tmp_path / "first", "a.json", '{"a": [1,\n{"a": 2}\n{"a": 3}\n')
    with pytest.raises(Exception):
        readers.read_json(spark, first, "a int", "fail").collect()
    with pytest.raises(ValueError):
        readers.read_json(spark, path, bad_lines="other")


def test_suffix_picks_the_reader(spark, tmp_path):
    folder = tmp_path / "s"
    csv, js = put(folder, "a.csv", "x\n1\n"), put(folder, "b.json", '{"x": 1}')
    put(folder, "notes.txt", "?")
    assert readers.read_dataset(spark, csv).first()["x"] == "1"
    assert readers.read_dataset(spark, js).first()["x"] == 1
    with pytest.raises(ValueError):
        readers.read_dataset(spark, str(folder / "notes.txt"))
    found = readers.unsupported_files(spark, str(folder)).collect()
    assert [(r["dataset"], r["issue_type"]) for r in found] == [("notes.txt", "UNSUPPORTED_FILE")]


def test_file_digests(spark, tmp_path, monkeypatch):
    def digests(files):
        folder = tmp_path / f"c{len(list(tmp_path.iterdir()))}"
        for name, data in files.items():
            put(folder, name, data)
        return {r["file"]: r["digest"] for r in writers.file_digests(spark, str(folder)).collect()}

    lines = [f"line {i}" for i in range(500)]
    text = "\n".join(lines) + "\n"
    variants = {
        "same": text, "again": text, "reordered": "\n".join(lines[::-1]) + "\n", "open": text[:-1],
        "crlf": text.replace("\n", "\r\n"), "cr": text.replace("\n", "\r"), "bom": "\ufeff" + text,
        "latin": text.encode() + b"\xe9", "blank": "\n",
    }
    for block in (1 << 16, 64):  # the block's size changes digests, never what they tell apart
        monkeypatch.setattr(writers, "BLOCK_LINES", block)
        got = digests(variants)
        assert None not in got.values() and got["same"] == got["again"]
        assert len(set(got.values())) == len(variants) - 1
    whole = digests(variants)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert digests(variants) == whole  # however the file is cut for reading
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_load_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    five = spark.range(5)
    writers.write_table(five, path, "skip")
    writers.write_table(five, path, "force")
    assert writers.read_table(spark, path).count() == 10
    writers.write_table(five, path, "reload")
    assert writers.read_table(spark, path).count() == 5
    with pytest.raises(ValueError):
        writers.write_table(five, path, "incremental")


def test_failed_or_changed_files_load_again(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, digest string")
    history = spark.createDataFrame(
        [("a", "1", "SUCCESS"), ("b", "2", "FAILED"), ("c", "0", "SUCCESS")],
        "file string, digest string, status string")
    assert {r["file"] for r in writers.unprocessed(files, history).collect()} == {"b", "c"}


def test_strict_schema(spark):
    stored = spark.createDataFrame([(1,)], "a int")
    more = spark.createDataFrame([(2, 3)], "a int, b int")
    assert shape.evolve(stored, more).columns == ["a", "b"]
    assert shape.evolve(None, more).count() == 1
    for current in (stored, None):
        with pytest.raises(shape.StrictSchemaError):
            shape.evolve(current, more, strict=True)


def test_stamp_skips_tables_without_the_column(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert shape.stamped(df, F.current_timestamp()).columns == ["a"]


def test_quarantine_keeps_every_row(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("x", ""), (None, "2024-13-01")],
                               "n string, d string")
    out = shape.quarantine(df, {"n": "INTEGER", "d": "DATE"}, ["n"])
    assert [r["error"] for r in out.collect()] == [
        None, "n: not INTEGER", "d: not DATE; n: missing"]


def test_materialized_view_is_empty_until_refreshed(spark, tmp_path):
    view = writers.MaterializedView(spark.range(7), str(tmp_path / "mv"))
    assert view.read().count() == 0
    view.refresh()
    assert view.read().count() == 7


def test_paths_are_decoded_only_where_encoded(spark, tmp_path):
    """Decoding costs more than reading a line, so plain names pass without it; all names come back as given."""
    names = ["plain.txt", "a b+c.txt", "50%.txt", "ü%2B.txt"]
    for name in names:
        (tmp_path / name).write_text("x\ny\n")
    frame = spark.read.text(str(tmp_path)).select(readers.file_name().alias("name"), readers.file_path().alias("path"))
    found = {tuple(r) for r in frame.collect()}
    assert {n for n, _ in found} == set(names)
    assert {p.rsplit("/", 1)[1] for _, p in found} == set(names)
    for column in (readers.file_name(), readers.file_path()):
        plan = spark.read.text(str(tmp_path)).select(column.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN Contains" in plan or "CASE WHEN contains" in plan, plan
