"""Logical types: from Spark types, from values, from names, and to physical types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moveproof import rules
from moveproof.functions.names import strip
from moveproof.functions.rates import cases

# Decimals that a loaded number keeps; one with more is refused, never rounded.
SCALE = 18
# logical type -> Spark type a loaded column gets; whole numbers get room for any that detection admits
SPARK_TYPES = {
    "INTEGER": T.LongType(),
    "BIGINT": T.LongType(),
    "NUMERIC": T.DecimalType(38, SCALE),
    "TEXT": T.StringType(),
    "VARCHAR": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "BOOLEAN": T.BooleanType(),
}


def logical_type(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return "INTEGER"
    if isinstance(dtype, T.LongType):
        return "BIGINT"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "NUMERIC"
    if isinstance(dtype, T.DateType):
        return "DATE"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    return "TEXT"


# one bit per shape of a value
_INTEGER, _NUMERIC, _DATE, _TIMESTAMP, _OTHER = 1, 2, 4, 8, 16


_NUMBER = r"-?[0-9]+(\.[0-9]+)?"
_DAY = r"(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_CLOCK = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"


def _shape(value: Column) -> Column:
    """The bit of the one shape a stripped value has.

    One pattern admits all shapes; single characters then tell them apart, and
    only values that look like dates are parsed.
    """
    single_space = F.regexp_replace(value, r"\s+", " ")
    valid_date = F.try_to_timestamp(value, F.lit("yyyy-M-d")).isNotNull()
    valid_stamp = F.try_to_timestamp(single_space, F.lit("yyyy-M-d H:m:s")).isNotNull()
    return (
        F.when(~value.rlike(rf"^({_NUMBER}|{_DAY}(\s+{_CLOCK})?)$"), _OTHER)
        .when(F.contains(value, F.lit(":")), F.when(valid_stamp, _TIMESTAMP).otherwise(_OTHER))
        .when(F.instr(value, "-") > 1, F.when(valid_date, _DATE).otherwise(_OTHER))
        .when(F.contains(value, F.lit(".")), _NUMERIC)
        .otherwise(_INTEGER)
    )


def detect_types(df: DataFrame, dataset: str) -> DataFrame:
    """The narrowest logical type that every non-blank value of each text column fits.

    One scan: rows become (column number, value) pairs that are folded to one
    row per column inside each task, so only columns x tasks rows are shuffled.
    A column with no value at all is TEXT.
    """
    names = F.array(*[F.lit(c) for c in df.columns])
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), strip(F.col(f"`{c}`").cast("string")).alias("value"))
        for i, c in enumerate(df.columns)
    ])))
    filled = F.when(F.col("value") != "", F.col("value"))
    folded = pairs.groupBy("ordinal").agg(
        F.count(filled).alias("filled_values"),
        F.coalesce(F.bit_or(F.when(filled.isNotNull(), _shape(F.col("value")))), F.lit(_OTHER))
        .alias("shapes"),
    ).withColumn("column", F.element_at(names, F.col("ordinal") + 1))
    shapes = F.col("shapes")
    detected = (
        F.when(shapes == _INTEGER, "INTEGER")
        .when(shapes.isin(_NUMERIC, _INTEGER | _NUMERIC), "NUMERIC")
        .when(shapes == _DATE, "DATE").when(shapes == _TIMESTAMP, "TIMESTAMP").otherwise("TEXT")
    )
    return folded.select(
        F.lit(dataset).alias("dataset"), "column", "ordinal", "filled_values",
        detected.alias("detected_type"),
    )


def datatype_registry(
    df: DataFrame, table: str, key: str, previous: DataFrame
) -> DataFrame:
    """Detected type, selected type and a sample per column of a text table.

    `previous` (table, column, selected_type) carries earlier choices over
    unless they are blank; the sample is the value of the row with the lowest key.
    """
    first = df.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(key)).alias("r"))
    samples = first.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("r").getField(c).alias("sample_value"))
        for c in df.columns
    ])))
    detected = detect_types(df, table).withColumnRenamed("dataset", "table")
    chosen = usable_type(F.col("selected_type"))
    return detected.join(previous, ["table", "column"], "left").join(samples, "column").select(
        "table", "column", "detected_type",
        F.coalesce(chosen, F.col("detected_type")).alias("selected_type"),
        F.coalesce("sample_value", F.lit("")).alias("sample_value"),
    )


def usable_type(col: Column) -> Column:
    """A type entry that counts: not null, not blank, not the word 'null'."""
    text = strip(col)
    return F.when((text != "") & (F.lower(text) != "null"), text)


def resolved_type(selected: Column, detected: Column) -> Column:
    return F.coalesce(
        usable_type(selected), usable_type(detected), F.lit(rules.DEFAULT_LOGICAL_TYPE)
    )


def physical_type(logical: Column, target: str) -> Column:
    """Physical type on MYSQL / POSTGRESQL / MSSQL; null when the logical type is unknown."""
    key = target.strip().upper()
    if key not in rules.PHYSICAL_TYPES:
        raise ValueError(f"unknown target database {target!r}")
    entries = F.create_map(*[F.lit(x) for kv in rules.PHYSICAL_TYPES[key].items() for x in kv])
    return F.try_element_at(entries, F.upper(strip(logical)))


def hinted_type(name: Column) -> Column:
    return cases(
        (F.lower(name).isin(list(words)), F.lit(physical))
        for words, physical, _ in rules.NAME_HINTS
    ).otherwise(rules.NAME_HINT_DEFAULT)


def hinted_key(name: Column) -> Column:
    words = [w for group, _, is_key in rules.NAME_HINTS if is_key for w in group]
    return F.lower(name).isin(words)


def cast_to(col: Column, logical: str) -> Column:
    """Value as the logical type's Spark type, null where it does not fit.

    A date or time must be written in full; a plain cast would take '2024' for
    the first of January.
    """
    if logical in ("TEXT", "VARCHAR"):
        return col
    value = strip(col.cast("string"))
    fitted = value.try_cast(SPARK_TYPES[logical])
    if logical == "NUMERIC":
        rounded = value.rlike(rf"\.[0-9]{{{SCALE}}}[0-9]*[1-9]") | value.rlike(r"[eE]-")
        return F.when(~rounded, fitted)
    if logical == "DATE":
        return F.when(value.rlike(rf"^{_DAY}$"), fitted)
    if logical == "TIMESTAMP":
        return F.when(value.rlike(rf"^{_DAY}([ T]+{_CLOCK}(\.[0-9]+)?)?$"), fitted)
    return fitted
