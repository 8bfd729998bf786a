"""Paths and lines as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line beside the line feed, and what is blank.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strings(values: Iterable[str]) -> Column:
    """An array of fixed strings; one constant of the plan."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def lookup(table: dict[str, str], key: Column) -> Column:
    """What a fixed table has for a key, or null; the table is one constant of the plan."""
    pairs = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in table.items())), F.lit("\x1e"), F.lit("\x1f"))
    return F.try_element_at(pairs, key)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lines(content: Column) -> Column:
    """Lines without their ends; an end at the very end starts no further line."""
    fed = F.translate(F.replace(content, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))
    cut = F.split(F.when(content.rlike(f"[{LINE_ENDS}]"), fed).otherwise(content), "\n", -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)


def physical_loc(content: Column) -> Column:
    ends = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (ends + F.when((content != "") & ~content.endswith("\n"), 1).otherwise(0)).cast("int")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading or final dot starts none."""
    return F.regexp_replace(name(path), "(?s)(?<=.)\\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(name(path), "(?s)^.+(\\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    """The folder, '' at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def in_folder(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def ancestors(path: Column) -> Column:
    """Folders above the file's own, nearest first, without the root."""
    cut = parts(path)
    n = F.size(cut) - 2  # folders above the own one
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(cut, 1, i), "/")))


def any_part(path: Column, values: Iterable[str]) -> Column:
    return F.arrays_overlap(parts(F.lower(path)), strings(values))


def _quoted(values: Iterable[str]) -> str:
    return "|".join(f"\\Q{v}\\E" for v in values)


def contains_any(c: Column, values: Iterable[str]) -> Column:
    return c.rlike(_quoted(values))


def starts_any(c: Column, values: Iterable[str]) -> Column:
    return c.rlike(f"^(?:{_quoted(values)})")


def slug(c: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and dashes as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9-]", "-"), "-+", "-"), "^-|-$", "")


def matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def filled(c: Column) -> Column:
    """None for the empty string."""
    return F.nullif(c, F.lit(""))
