"""Code tables of syslog and of self-describing formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities by code, facilities by code (the others are unknown), and words for severities.
SEVERITIES = ["emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug"]
FACILITIES = {
    0: "kern", 1: "user", 2: "mail", 3: "daemon", 4: "auth", 5: "syslog", 6: "lpr", 7: "news", 8: "uucp", 9: "cron", 10: "authpriv", 11: "ftp",
    16: "local0", 17: "local1", 18: "local2", 19: "local3", 20: "local4", 21: "local5", 22: "local6", 23: "local7",
}
WORDS = {
    "emergency": ["emerg", "emergency", "panic"],
    "alert": ["alert"],
    "critical": ["crit", "critical", "fatal"],
    "error": ["err", "error"],
    "warning": ["warn", "warning"],
    "notice": ["notice"],
    "informational": ["info", "informational"],
    "debug": ["debug", "trace"],
}
LEVELS = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def choose(column: Column, table: dict, otherwise=None) -> Column:
    """CASE over a small table."""
    out = None
    for key, value in table.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out.otherwise(otherwise)


def severity_of_priority(priority: Column) -> Column:
    return choose(F.pmod(priority, F.lit(8)), dict(enumerate(SEVERITIES)))


def facility_of_priority(priority: Column) -> Column:
    return F.when(priority.isNotNull(), choose(F.floor(priority / 8), FACILITIES, "unknown"))


def severity_of_word(word: Column) -> Column:
    return choose(F.lower(F.trim(word)), {w: s for s, ws in WORDS.items() for w in ws})


def cef_severity(value: Column) -> Column:
    n = value.try_cast("int")
    return F.when(n.between(0, 3), "debug").when(n.between(4, 6), "notice").when(n.between(7, 8), "warning").otherwise("error")


def leef_severity(value: Column) -> Column:
    n = value.try_cast("int")
    return F.when(n.between(0, 2), "debug").when(n.between(3, 5), "notice").when(n.between(6, 8), "warning").otherwise("error")


def level_rank(level: Column) -> Column:
    return choose(F.lower(level), LEVELS, 0)
