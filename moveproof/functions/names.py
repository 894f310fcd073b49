"""Name styles, clean-up, overrides and mapping precedence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moveproof.functions.rates import cases

STYLES = ("snake_case", "kebab-case", "camelCase", "PascalCase", "lowercase", "UPPERCASE", "preserve")


class NameCollision(ValueError):
    """Two source names ended on one target name under the 'fail' strategy."""


# --- fixed values: the characters that count as white space when a value is stripped ---
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def clean_header(name: str) -> str:
    return name.replace("\ufeff", "").strip()


def _capitalized(part: Column) -> Column:
    return F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substring(part, 2, 2**31 - 1)))


def styled(col: Column, style: str) -> Column:
    """The name in one of `STYLES`; word borders come from case changes and separators."""
    if style not in STYLES:
        raise ValueError(f"unknown naming style {style!r}; expected one of {STYLES}")
    if style == "preserve":
        return col
    if style == "lowercase":
        return F.lower(col)
    if style == "UPPERCASE":
        return F.upper(col)
    words = F.regexp_replace(col, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    words = F.regexp_replace(words, r"([a-z0-9])([A-Z])", "$1_$2")
    words = F.regexp_replace(words, f"[-.{WHITE_SPACE}]+", "_")
    if style == "snake_case":
        return F.lower(words)
    if style == "kebab-case":
        return F.translate(F.lower(words), "_", "-")
    parts = F.split(words, "_")
    if style == "PascalCase":
        return F.array_join(F.transform(parts, _capitalized), "")
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).otherwise(_capitalized(p))), ""
    )


def replaced(col: Column, pairs) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def tidied(col: Column) -> Column:
    """Trimmed, single underscores, none at the ends; null when nothing is left."""
    out = F.regexp_replace(strip(col), r"_{2,}", "_")
    out = F.regexp_replace(out, r"^_+|_+$", "")
    return F.when(out != "", out)


def looked_up(col: Column, entries: dict[str, str]) -> Column:
    """Exact entry, else the first entry equal up to case, else null."""
    if not entries:
        return F.lit(None).cast("string")
    folded: dict[str, str] = {}
    for key, value in entries.items():
        folded.setdefault(key.lower(), value)
    exact, loose = (
        F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (entries, folded)
    )
    return F.coalesce(F.try_element_at(exact, col), F.try_element_at(loose, F.lower(col)))


def resolved(col: Column, style: str = "snake_case", replacements=(), overrides=None) -> Column:
    """Override if there is one, else replacements, style and clean-up."""
    return F.coalesce(
        looked_up(col, overrides or {}), tidied(styled(replaced(col, replacements), style))
    )


def normalized(
    col: Column,
    trim: bool = True,
    replacements=(),
    lower: bool = True,
    split_camel: bool = False,
    collapse: bool = True,
    strip_ends: bool = True,
) -> Column:
    """The older, flag-driven normalisation used by the column mapping file.

    Lower-casing runs before the camel split, so the split only acts when
    lower-casing is off.
    """
    out = strip(col) if trim else col
    out = replaced(out, replacements)
    if lower:
        out = F.lower(out)
    if split_camel:
        out = F.lower(F.regexp_replace(out, r"([A-Z])", "_$1"))
    if collapse:
        out = F.regexp_replace(out, r"_{2,}", "_")
    if strip_ends:
        out = F.regexp_replace(out, r"^_+|_+$", "")
    return out


def dictionary_mapped(col: Column, dictionary: dict[str, str]) -> Column:
    """First dictionary word that equals the name, or occurs in it, decides."""
    folded = F.lower(col)
    pairs = []
    for word, target in dictionary.items():
        low = F.lit(word.lower())
        pairs.append((folded == low, F.lit(target)))
        pairs.append((F.contains(folded, low), F.replace(folded, low, F.lit(target.lower()))))
    return cases(pairs).otherwise(col) if pairs else col


def column_target(
    col: Column, manual=None, dictionary=None, ignore=(), replacements=(), **flags
) -> Column:
    """Target column name; null for an ignored column.

    Precedence: ignore list, manual entry (exact, then any case), dictionary,
    normalisation.
    """
    cleaned = strip(col)
    mapped = normalized(
        replaced(dictionary_mapped(cleaned, dictionary or {}), replacements),
        replacements=replacements, **flags,
    )
    target = F.coalesce(looked_up(cleaned, manual or {}), mapped)
    if not ignore:
        return target
    return F.when(~F.lower(cleaned).isin([c.lower() for c in ignore]), target)


def table_target(col: Column, mapping: dict[str, str], **flags) -> Column:
    """Target table name: exact entry, normalised entry, then per entry equal or contained."""
    norm = normalized(col, **flags)
    if not mapping:
        return norm
    entries = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    loose = cases(
        (F.contains(F.lower(norm), F.lit(key.lower())), F.lit(value))
        for key, value in mapping.items()
    )
    return F.coalesce(
        F.try_element_at(entries, col), F.try_element_at(entries, norm), loose.otherwise(norm)
    )


def suffixed(targets: list[str], strategy: str = "suffix", separator: str = "_", start: int = 2):
    """Column list of one table with repeated names numbered in arrival order.

    A numbered name that is already taken moves on to the next free number.
    """
    if strategy not in ("fail", "suffix"):
        raise ValueError(f"unknown collision strategy {strategy!r}")
    used: set[str] = set()
    following: dict[str, int] = {}
    out = []
    for name in targets:
        if name in used and strategy == "fail":
            raise NameCollision(f"several source columns map to {name!r}")
        final = name
        while final in used:
            n = following.get(name, start)
            following[name] = n + 1
            final = f"{name}{separator}{n}"
        used.add(final)
        out.append(final)
    return out
