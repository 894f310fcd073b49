"""Canonical and compact forms of values, row fingerprints, display formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGEST_FROM = 64  # octets; a SHA-256 in hex is exactly this long


def _sorted_fields(col: Column, dtype: T.DataType) -> Column:
    """The same value with struct fields and map entries in key order, at any depth."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        ordered = F.struct(
            *[_sorted_fields(col.getField(f.name), f.dataType).alias(f.name) for f in fields]
        )
        return F.when(col.isNotNull(), ordered)
    if isinstance(dtype, T.ArrayType):
        if not _has_fields(dtype.elementType):
            return col
        return F.transform(col, lambda x: _sorted_fields(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.struct(
                e["key"].alias("key"), _sorted_fields(e["value"], dtype.valueType).alias("value")
            ),
        )
        ordered = F.array_sort(
            entries,
            lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
        )
        return F.map_from_entries(ordered)
    return col


def _has_fields(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_fields(dtype.elementType)
    return isinstance(dtype, (T.StructType, T.MapType))


def canonical_json(col: Column, dtype: T.DataType) -> Column:
    """JSON text in which equal nested values are equal strings."""
    return F.to_json(_sorted_fields(col, dtype), {"ignoreNullFields": "false"})


def canonical_json_text(col: Column) -> Column:
    """Key-sorted form of a flat JSON object held as text."""
    parsed = F.from_json(col, "map<string,string>")
    return canonical_json(parsed, T.MapType(T.StringType(), T.StringType()))


def compact(col: Column) -> Column:
    """Text as it is when short, as its SHA-256 when long.

    Every value of 64 octets or more is replaced, so a digest can never be
    mistaken for a stored value, and no shuffle carries whole documents.
    """
    return F.when(F.octet_length(col) < DIGEST_FROM, col).otherwise(F.sha2(col, 256))


def comparable(col: Column, dtype: T.DataType) -> Column:
    """A groupable stand-in for a value: NaN is null, nesting is canonical, long text is a digest."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    if isinstance(dtype, T.StringType):
        return compact(col)
    if isinstance(dtype, T.BinaryType):
        return F.sha2(col, 256)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return compact(canonical_json(col, dtype))
    if isinstance(dtype, T.VariantType):
        return compact(F.to_json(col))
    return col


def is_missing(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def hashable(col: Column, dtype: T.DataType) -> Column:
    """Input for a hash or sketch: plain values as they are, NaN as null, nesting as canonical JSON.

    Unlike `comparable` this leaves long text alone, since only its hash is
    kept. Nested values are printed, because a hash of the value itself skips
    nulls inside it and would give [1, null] and [null, 1] one result.
    """
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return canonical_json(col, dtype)
    if isinstance(dtype, T.VariantType):
        return F.to_json(col)
    return col


_INTEGRAL = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
_DIGITS = (3, 5, 10, 19)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which values of both types are compared; text when nothing closer holds both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    whole = [_INTEGRAL.index(t) if t in _INTEGRAL else None for t in (a, b)]
    if None not in whole:
        return _INTEGRAL[max(whole)]
    if all(isinstance(t, T.NumericType) for t in (a, b)):
        if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (a, b)):
            return T.DoubleType()
        sizes = [(t.precision - t.scale, t.scale) if i is None else (_DIGITS[i], 0)
                 for t, i in zip((a, b), whole)]
        scale = max(s for _, s in sizes)
        return T.DecimalType(min(38, max(p for p, _ in sizes) + scale), scale)
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampType() if T.TimestampType() in (a, b) else T.TimestampNTZType()
    return T.StringType()


def common_layout(left: T.StructType, right: T.StructType, leave: list[str] = ()) -> list[tuple]:
    """(name, type) of the columns of either side in name order; a side without one has nulls there."""
    sides = [{f.name: f.dataType for f in s.fields if f.name not in leave} for s in (left, right)]
    return [
        (name, common_type(*(s.get(name, T.NullType()) for s in sides)))
        for name in sorted(set(sides[0]) | set(sides[1]))
    ]


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def row_hashes(df: DataFrame, layout: list[tuple] | None = None) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes of a row, in the order and types of a layout.

    The null flags are hashed too, because xxhash64 skips nulls and would give
    ('a', null) and (null, 'a') one value.
    """
    own = {f.name: f.dataType for f in df.schema.fields}
    args = []
    for name, dtype in layout if layout is not None else own.items():
        if name not in own:
            args += [F.lit(None).cast("string"), F.lit(True)]
            continue
        c, have = F.col(f"`{name}`"), own[name]
        value = hashable(c, have) if _nested(have) or have == dtype else hashable(c.cast(dtype), dtype)
        args += [value, c.isNull()]
    return F.xxhash64(F.lit(1), *args), F.xxhash64(F.lit(2), *args)


def multiset_hash(first: Column, second: Column, weight: Column | None = None) -> list[Column]:
    """Order-insensitive sums over the 16-bit quarters of two row hashes.

    Sums (unlike xor) do not cancel repeated rows; a sum of quarters stays
    inside a long for 2**47 rows of one group, more than any table holds.
    """
    out = []
    for h in (first, second):
        for shift in (48, 32, 16, 0):
            part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0xFFFF))
            out.append(F.sum(part if weight is None else F.when(weight, part).otherwise(0)))
    return out


def _two(col: Column) -> Column:
    """Exact ties (odd eighths) to even before two places are printed, as C-style printing does."""
    return F.when(col * 8 == F.floor(col * 8), F.bround(col, 2)).otherwise(col)


def show_number(col: Column) -> Column:
    return F.coalesce(F.format_number(col, 0), F.lit("-"))


def show_percentage(col: Column) -> Column:
    return F.when(col.isNull(), "-").otherwise(
        F.format_string("%.2f%%", _two(col.cast("double")))
    )


def show_bytes(col: Column) -> Column:
    """Binary units up to TB, two places."""
    size = col.cast("double")
    out = F.when(size.isNull(), "-")
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        out = out.when(size < 1024.0 ** (power + 1),
                       F.format_string(f"%.2f {unit}", _two(size / 1024.0 ** power)))
    return out.otherwise(F.format_string("%.2f TB", _two(size / 1024.0 ** 4)))


def show_duration(col: Column) -> Column:
    """'s seconds', 'm min s sec' or 'h hr m min s sec'."""
    total = col.cast("double")
    seconds = _two(total % 60)
    minutes = F.floor(total / 60)
    return (
        F.when(total.isNull(), "N/A")
        .when(total < 60, F.format_string("%.2f seconds", _two(total)))
        .when(minutes < 60, F.format_string("%d min %.2f sec", minutes, seconds))
        .otherwise(F.format_string("%d hr %d min %.2f sec", F.floor(minutes / 60),
                                   minutes % 60, seconds))
    )


def iso_text(col: Column, dtype: T.DataType) -> Column:
    """Date or timestamp as ISO 8601 text; microseconds only where there are any."""
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    fine = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.date_format(col, "SSSSSS") == "000000", whole).otherwise(fine)


def json_safe(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, decimals as doubles; everything else as it is."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = iso_text(c, f.dataType)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)
