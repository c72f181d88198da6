"""Text predicates and small text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like(column: Column, pattern: str) -> Column:
    """SQL LIKE without regard to case, % and _ live and no escape character: one that the pattern lacks is named."""
    escape = next(ch for ch in "\\!#~^`\x01" if ch not in pattern)
    return F.call_function("ilike", column, F.lit(pattern), F.lit(escape)) if escape != "\\" else column.ilike(pattern)


def starts(column: Column, value: str) -> Column:
    return like(column, f"{value}%")


def ends(column: Column, value: str) -> Column:
    return like(column, f"%{value}")


def contains(column: Column, value: str) -> Column:
    return like(column, f"%{value}%")


def filled(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def sanitize(column: Column) -> Column:
    """A label of letters, digits, dot, underscore and hyphen; `unknown` where nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(column, "[^A-Za-z0-9._-]", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(clean)


def tsv(column: Column) -> Column:
    """A cell: null is empty, tabs and line ends are spaces."""
    return F.coalesce(F.regexp_replace(column.cast("string"), "[\t\r\n]", " "), F.lit(""))


def dedup_key(src_ip: Column, event_type: Column, line: Column) -> Column:
    """src_ip|event_type where there is either, else the first 64 characters of the record."""
    src, kind = F.coalesce(src_ip, F.lit("")), F.coalesce(event_type, F.lit(""))
    return F.when((src != "") | (kind != ""), F.concat_ws("|", src, kind)).otherwise(F.substring(line, 1, 64))


def human_bytes(n: int) -> str:
    """1,536 is 1.5 KB."""
    size = float(n)
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{int(size)} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"
