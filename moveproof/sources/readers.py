"""CSV, JSON, table and JDBC sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof import rules
from moveproof.functions.names import clean_header
from moveproof.operators.profile import union_all

SUPPORTED = (".csv", ".json")

# --- fixed values: bytes that windows-1252 leaves undefined; the others from 80 to 9f are text ---
UNDEFINED_CP1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_WINDOWS_BYTES = [b for b in range(0x80, 0xA0) if b not in UNDEFINED_CP1252]
_UNDEFINED_PATTERN = "[" + "".join(rf"\x{b:02x}" for b in UNDEFINED_CP1252) + "]"
_AS_LATIN = "".join(map(chr, _WINDOWS_BYTES))
_AS_WINDOWS = bytes(_WINDOWS_BYTES).decode("cp1252")


def _decoded(path):
    """Only what is percent-encoded is decoded, since this is done for every row."""
    return F.when(path.contains("%"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


def file_path():
    """Path of the file a row was read from, as it was given; Spark percent-encodes it."""
    return _decoded(F.col("_metadata.file_path"))


def file_name():
    return _decoded(F.substring_index(F.col("_metadata.file_path"), "/", -1))


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def inspect_text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per file: is it UTF-8, is it windows-1252, do quoted fields span lines, and its header.

    Reads lines, not whole files, so a large file is checked by many tasks;
    only one row per file reaches the result. The header is the first line
    that is not blank.
    """
    lines = spark.read.text(_paths(path)).select(
        file_path().alias("file"), F.col("value"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    )
    single_bytes = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    return lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"),
        F.bool_and(~single_bytes.rlike(_UNDEFINED_PATTERN)).alias("is_cp1252"),
        F.bool_or(quotes % 2 == 1).alias("spans_lines"),
        F.min_by(F.hex(F.col("value").cast("binary")), F.when(F.trim("value") != "", F.col("at")))
        .alias("header"),
        F.min_by(quotes % 2, F.when(F.trim("value") != "", F.col("at"))).alias("open_header"),
        F.count(F.lit(1)).alias("lines"),
    )


def _csv_options(row) -> tuple[str, bool, str]:
    """Files that one reader can take together: encoding, quoting and header are the same."""
    header = row["header"] or ""
    if row["open_header"]:  # a quoted name with a line break: its first line does not tell the header
        header = row["file"]
    if row["is_utf8"]:
        return "UTF-8", row["spans_lines"], header
    return ("windows-1252" if row["is_cp1252"] else "ISO-8859-1"), row["spans_lines"], header


def _read_group(
    spark: SparkSession, files: list[str], encoding: str, multi_line: bool, file_column: str | None
):
    """One encoding; windows-1252 is read byte for byte and its extra characters are mapped."""
    windows = encoding == "windows-1252"
    raw = spark.read.csv(
        files, header=True, inferSchema=False, encoding="ISO-8859-1" if windows else encoding,
        multiLine=multi_line, escape='"', nullValue="", emptyValue="",
    )
    names = [c.translate(str.maketrans(_AS_LATIN, _AS_WINDOWS)) if windows else c
             for c in raw.columns]
    values = [F.col(f"`{c}`") for c in raw.columns]
    if windows:
        values = [F.translate(v, _AS_LATIN, _AS_WINDOWS) for v in values]
    # a quoted empty field arrives as an empty string and is a null as well
    return raw.select(*[
        F.when(v != "", v).alias(clean_header(n)) for v, n in zip(values, names)
    ], *([file_name().alias(file_column)] if file_column else []))


def csv_groups(
    spark: SparkSession, path: str | list[str], inspect: bool = True, file_column: str | None = None
) -> list[DataFrame]:
    """CSV files as text columns, one frame for the files of one header, encoding and quoting."""
    groups: dict[tuple, list[str]] = {("UTF-8", False, ""): _paths(path)}
    if inspect:
        groups = {}
        for row in inspect_text_files(spark, path).collect():  # one row per file
            groups.setdefault(_csv_options(row), []).append(row["file"])
        if len(groups) <= 1:  # the usual case: list the folder once, not every file
            groups = {next(iter(groups), ("UTF-8", False, "")): _paths(path)}
    return [
        _read_group(spark, files, encoding, multi_line, file_column)
        for (encoding, multi_line, _), files in sorted(groups.items())
    ]


def read_csv(
    spark: SparkSession, path: str | list[str], inspect: bool = True, file_column: str | None = None
) -> DataFrame:
    """A CSV table as text columns: cleaned headers, empty string as null, nothing else changed.

    Files are grouped by header, encoding and whether quoted fields span lines, so
    every file is read under its own header; the union matches columns by name. Only
    files that need the unsplittable multi-line parser get it. `file_column` adds the file's name.
    """
    return union_all(csv_groups(spark, path, inspect, file_column))


def na_to_null(df: DataFrame) -> DataFrame:
    """Text values that spell a missing value become null (the profiling read)."""
    return df.select(*[
        (
            F.when(~F.col(f"`{f.name}`").isin(list(rules.NA_TOKENS)), F.col(f"`{f.name}`"))
            if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        ).alias(f.name)
        for f in df.schema.fields
    ])


def json_layout(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per file: is it one document spread over lines, or JSON line by line; is it an array.

    In a document some lines open brackets that later lines close, and all
    brackets balance over the file. Lines that are broken on their own leave
    either no open line or no balance. Counted per line, so a file of any size
    is checked by many tasks.
    """
    lines = spark.read.text(_paths(path)).select(
        file_path().alias("file"), F.trim("value").alias("line"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    ).filter(F.col("line") != "")
    # possessive, so that long strings are matched without recursion
    bare = F.regexp_replace("line", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    opened = F.length(F.regexp_replace(bare, r"[^{\[]", ""))
    closed = F.length(F.regexp_replace(bare, r"[^}\]]", ""))
    return lines.select("file", "at", F.substring("line", 1, 1).alias("begin"),
                        (opened - closed).alias("balance")).groupBy("file").agg(
        (F.bool_or(F.col("balance") != 0) & (F.sum("balance") == 0)).alias("is_document"),
        (F.min_by("begin", "at") == "[").alias("is_array"),
        F.count(F.lit(1)).alias("lines"),
    )


# variant type names -> the types that the JSON reader would give
_TYPE_NAMES = ((r"\bOBJECT<", "STRUCT<"), (r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE"),
               (r"\bVARIANT\b", "STRING"), (r"\bVOID\b", "STRING"))


def _read_arrays(spark: SparkSession, files: list[str], multi_line: bool, schema, file_column) -> DataFrame:
    """Files of JSON arrays; an item that is no object becomes a row without values."""
    whole = spark.read.option("multiLine", multi_line).option("singleVariantColumn", "_all").json(files)
    named = whole.select(file_name().alias("_of"), "_all")
    is_array = F.schema_of_variant("_all").startswith("ARRAY")
    # a line of its own that is no array stands for itself
    listed = F.when(is_array, F.col("_all").try_cast("array<variant>")).otherwise(F.array("_all"))
    items = named.select("_of", F.explode(listed).alias("item"))
    item = F.when(F.schema_of_variant("item").startswith("OBJECT"), F.col("item"))
    if schema is None:
        found = items.agg(F.schema_of_variant_agg(item)).first()[0] or "VOID"
        for pattern, name in _TYPE_NAMES:
            found = re.sub(pattern, name, found)
        schema = T.StructType.fromDDL(found[len("STRUCT<"):-1]) if found.startswith("STRUCT<") else T.StructType()
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    values = [F.try_variant_get(item, f"$['{f.name}']", f.dataType.simpleString()).alias(f.name)
              for f in schema.fields]
    return items.select(*values, *([F.col("_of").alias(file_column)] if file_column else []))


def read_json(
    spark: SparkSession, path: str | list[str], schema=None, bad_lines: str = "fail",
    file_column: str | None = None,
) -> DataFrame:
    """JSON arrays, single objects and NDJSON; the columns are the union of all keys.

    Files whose lines are JSON on their own are read line by line (splittable),
    the others as one document each. An item of an array that is no object is a row
    without values. `bad_lines`: 'fail' raises, 'skip' drops the line, 'keep' leaves
    it in `_corrupt_record`. `file_column` adds the file's name.
    """
    if bad_lines not in ("fail", "skip", "keep"):
        raise ValueError(f"unknown bad-line policy {bad_lines!r}")
    mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad_lines]
    groups: dict[tuple[bool, bool], list[str]] = {}
    for row in json_layout(spark, path).collect():  # one row per file
        groups.setdefault((bool(row["is_document"]), bool(row["is_array"])), []).append(row["file"])
    if len(groups) <= 1:  # one layout throughout: list the folder once
        groups = {next(iter(groups), (False, False)): _paths(path)}
    frames = []
    for (multi_line, is_array), files in sorted(groups.items()):
        if is_array and mode != "PERMISSIVE":
            frames.append(_read_arrays(spark, files, multi_line, schema, file_column))
            continue
        reader = spark.read.option("mode", mode).option("multiLine", multi_line)
        reader = reader.schema(schema) if schema is not None else reader
        raw = reader.json(files)
        frames.append(raw.select(*[F.col(f"`{c}`") for c in raw.columns],
                                 *([file_name().alias(file_column)] if file_column else [])))
    return union_all(frames)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path)
    if path.lower().endswith(".json"):
        return read_json(spark, path)
    raise ValueError(f"unsupported file {path}; expected one of {SUPPORTED}")


def unsupported_files(spark: SparkSession, folder: str) -> DataFrame:
    """Findings for files in the folder that no reader takes."""
    return unsupported_names(spark.read.format("binaryFile").load(folder).select("path"))  # content is not read


def unsupported_names(files: DataFrame) -> DataFrame:
    """Findings for listed files (`path`) whose suffix no reader takes, as a catalog or a bucket inventory lists them."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.filter(~suffix.isin(list(SUPPORTED))).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("dataset"),
        F.lit("UNSUPPORTED_FILE").alias("issue_type"), F.lit("LOW").alias("severity"),
    )


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower, upper,
    partitions: int, **options,
) -> DataFrame:
    """A relational table read by ranges of a key, one connection per partition."""
    return (
        spark.read.format("jdbc").options(
            url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower),
            upperBound=str(upper), numPartitions=str(partitions), **options,
        ).load()
    )
