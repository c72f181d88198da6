"""Search: the query language over the event table and over alerts."""

from __future__ import annotations

from collections.abc import Callable, Collection
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import timeutil
from ..model import EngineError
from ..plans.dsl import Query, parse
from ..plans.predicates import compile_expr

DEFAULT_CAP = 150


def event_field(df: DataFrame) -> Callable[[str], Column]:
    """A column of the table, else a key of `fields` where there is such a map, else null."""

    def resolve(name: str) -> Column:
        if name in df.columns:
            return df[name].cast("string")
        return F.get(F.array(df["fields"][name]), F.lit(0)) if "fields" in df.columns else F.lit(None).cast("string")

    return resolve


def alert_field(df: DataFrame, event_first: bool = False) -> Callable[[str], Column]:
    """Top level, then the event, then the first sample event; or, as correlations have it, the event before the top level."""

    def resolve(name: str) -> Column:
        found = [df[name].cast("string")] if name in df.columns and dict(df.dtypes)[name].split("<")[0] not in ("array", "map", "struct") else []
        if "event" in df.columns:
            found.insert(0 if event_first else len(found), df["event"][name])
        if "sample_events" in df.columns:
            found.append(F.get(df["sample_events"], F.lit(0))[name])
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return resolve


def bounded(df: DataFrame, after: str | None = None, before: str | None = None, window: str | None = None, now: datetime | None = None) -> DataFrame:
    """Rows of whole hours, both ends included, by the partition columns dt and hh."""
    if window and (after or before):
        raise EngineError("a window excludes after and before")
    a, b = timeutil.parse_time(after) if after else None, timeutil.parse_time(before) if before else None
    if window:
        a, b = timeutil.parse_window(window, now or datetime.now(timeutil.UTC)).hours()
    return df.filter(timeutil.hour_range(F.col("dt"), F.col("hh"), a, b)) if a or b else df


def run(df: DataFrame, query: str | Query, mode: str = "index", fields: Collection[str] | None = None, cap: int | None = None, order: Collection[str] = ()) -> DataFrame:
    """The rows or groups that a query asks for. cap: the limit where the query sets none. order: what makes a limit of
    rows repeatable. The line of an event is its column `line`; without one, and for alerts, the record as JSON."""
    q = parse(query, fields) if isinstance(query, str) else query
    resolve = (alert_field if mode == "json" else event_field)(df)
    line = df["line"] if "line" in df.columns else F.to_json(F.struct("*"))
    out = df.filter(compile_expr(q.where, resolve, line, mode)) if q.where is not None else df
    limit = q.limit if q.limit is not None else cap
    if q.group_by:
        keys = [F.coalesce(resolve(f), F.lit("")).alias(f) for f in q.group_by]
        out = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
        order = [F.desc("count"), *q.group_by]
        if limit is not None:
            out = out.orderBy(*order).limit(limit)
        if q.select:
            out = out.select(*[F.col(f) if f in (*q.group_by, "count") else F.lit(None).cast("string").alias(f) for f in q.select])
        return out
    if limit is not None:
        out = (out.orderBy(*order) if order else out).limit(limit)
    return out.select(*[resolve(f).alias(f) for f in q.select]) if q.select else out


def raw_scan(df: DataFrame, needle: str | None = None, line: str = "line") -> DataFrame:
    """Lines that hold the needle, letter for letter; all without one."""
    return df.filter(F.col(line).contains(needle)) if needle else df
