"""The command line: python -m logquern COMMAND. A data folder holds `events` (the event table), `alerts/ruled`,
`alerts/correlated` and `alerts/acks` (JSON lines). A command gives its exit code: 0, or 1 where a search or a list of alerts
finds nothing or what was asked can't be done."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session, timeutil
from .functions.text import human_bytes
from .model import ACK, ALERT, CORRELATED, EngineError
from .operators import aggregate as a
from .operators import alerts as al
from .operators import digest, ingest, parsers, search
from .operators.extract import shipped as shipped_extraction
from .plans import rules as rl
from .plans import suppress as sp
from .sources import config, lines, sinks

NOW_LAG = timedelta(seconds=300)  # the digest looks at what came before, so that late events are there


class Command:
    """What commands share: the session, the data folder, and where output goes."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace, out: Callable[[str], None], now: datetime):
        self.spark, self.args, self.out, self.now = spark, args, out, now

    def folder(self, *parts: str) -> str:
        return str(Path(self.args.data_dir, *parts))

    def table(self, path: str, schema: str | None = None) -> DataFrame | None:
        """None where there is no such table yet."""
        try:
            if schema is None:
                return self.spark.read.parquet(path)
            return lines.alerts(self.spark, path, schema)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def events(self) -> DataFrame:
        found = self.table(self.folder("events"))
        if found is None:
            raise EngineError(f"no events under {self.args.data_dir}")
        return found

    def show(self, df: DataFrame, form: str) -> int:
        """Rows as they come from the cluster, one at a time; how many there were."""
        n = 0
        if form == "tsv":
            self.out("\t".join(df.columns))
        for row in sinks.render(df, "json" if form == "json" else "tsv").toLocalIterator():
            self.out(row["value"])
            n += 1
        return n


def status(c: Command) -> int:
    """Size, files and newest file by source, and the hours that the table has."""
    events = c.events()
    found = a.file_status(events)
    c.out(f"Total size: {human_bytes(found.total)}")
    for row in found.by_source:
        c.out(f"  {row['_source_type']:<20} {row['files']:>5} files  last={int(row['last'].timestamp())}")
    hours = [f"{r['dt']}-{r['hh']:02d}" for r in events.select("dt", "hh").distinct().orderBy("dt", "hh").collect()]
    c.out(f"Hours ({len(hours)}):")
    for hour in hours:
        c.out(f"  {hour}")
    if c.args.verbose:
        for name, kind in events.dtypes:
            c.out(f"  {name}: {kind}")
    return 0


def stats(c: Command) -> int:
    """Events by source; field coverage of one source; or counts by interval."""
    events = c.events()
    source = c.args.source
    own = events.filter(F.col("_source_type") == source) if source else events
    if c.args.interval:
        window = timeutil.parse_window(c.args.last, c.now)
        key = "event_type" if source and "event_type" in events.columns else "_source_type"
        return 0 if c.show(a.trend_table(own, key, F.col("event_sec"), window, timeutil.parse_duration(c.args.interval), ungrouped=bool(source)), c.args.format) else 1
    if source:
        fields = [n for n in events.columns if n not in ("fields", "line", "_raw", "dt", "hh")]
        return 0 if c.show(a.coverage(own, fields), c.args.format) else 1
    return 0 if c.show(a.group_count(events, "_source_type").orderBy(F.desc("count"), "_source_type"), c.args.format) else 1


def _capped(c: Command, df: DataFrame) -> int:
    """The rows, up to the default cap unless the query sets its own limit; a notice on stderr where there are more."""
    query = search.parse(c.args.query) if c.args.query else None
    cap = None if c.args.no_limit or (query and query.limit is not None) else search.DEFAULT_CAP
    found = df.limit(cap + 1) if cap else df
    if cap and (n := found.count()) > cap:
        print(f"only the first {cap} of more than {n - 1} rows; --no-limit shows all", file=sys.stderr)
        found = df.limit(cap)
    return 0 if c.show(found, c.args.format) else 1


def search_(c: Command) -> int:
    events = search.bounded(c.events(), c.args.after, c.args.before, c.args.window, c.now)
    if c.args.raw:
        return _capped(c, search.raw_scan(events, c.args.query).select("line"))
    return _capped(c, search.run(events, c.args.query, order=["event_sec", "rec_id"] if "rec_id" in events.columns else ()))


def alerts(c: Command) -> int:
    """Alerts that aren't acknowledged (all of them with --all), or an acknowledgement."""
    if c.args.ack:
        al.acknowledge(c.spark, c.folder("alerts", "acks"), c.args.ack, note=c.args.note)
        return 0
    ruled = c.table(c.folder("alerts", "ruled"), ALERT)
    correlated = c.table(c.folder("alerts", "correlated"), CORRELATED)
    found = correlated if c.args.correlated else ruled
    if found is None:
        return 1
    acks = c.table(c.folder("alerts", "acks"), ACK)
    if not c.args.all and not c.args.correlated and acks is not None:
        found = al.open_alerts(found, acks)
    if c.args.query:
        found = search.run(found, c.args.query, mode="json")
    return 0 if c.show(found, c.args.format) else 1


def digest_(c: Command) -> int:
    settings = digest.Config.load(c.args.config) if c.args.config else digest.Config()
    window = timeutil.parse_window(c.args.window, c.now - NOW_LAG)
    ruled = c.table(c.folder("alerts", "ruled"), ALERT)
    found = digest.report(c.events(), window, settings, ruled, timeutil.parse_duration(c.args.interval))
    c.out(digest.render(found, c.args.format))
    return 0


def tail(c: Command) -> int:
    """Events that come from now on; with --no-follow those that are there, and an end."""
    events = c.events()
    if c.args.no_follow:
        found = search.run(events, c.args.query) if c.args.query else events
        c.show(found.select("line") if "line" in found.columns else found, "json")
        return 0
    stream = c.spark.readStream.schema(events.schema).parquet(c.folder("events")).filter(F.col("_received") >= F.lit(c.now))
    stream = search.run(stream, c.args.query) if c.args.query else stream

    def each(batch: DataFrame, _: int) -> None:
        c.show(batch.select("line") if "line" in batch.columns else batch, "json")

    query = stream.writeStream.foreachBatch(each).trigger(processingTime="200 milliseconds").start()
    query.awaitTermination(c.args.seconds)
    query.stop()
    return 0


def retention(c: Command) -> int:
    gone = sinks.retention(c.spark, c.folder("events"), c.args.days, c.now.date(), confirmed=c.args.yes)
    acks = c.table(c.folder("alerts", "acks"), ACK)
    if acks is not None:
        kept = sinks.compact_acks(acks, int((c.now - timedelta(days=c.args.days)).timestamp())).collect()  # a person wrote each
        c.spark.createDataFrame(kept, ACK).coalesce(1).write.mode("overwrite").json(c.folder("alerts", "acks"))
    c.out(f"{len(gone)} days deleted: {', '.join(gone)}")
    return 0


def _normalizer(path: str | None) -> config.Normalizer:
    return config.normalizer(path) if path else config.Normalizer(overrides=parsers.shipped_overrides(), rules=shipped_extraction())


def dry_run(c: Command) -> int:
    """What normalization and rules make of a file: shares and hits."""
    own = _normalizer(c.args.config)
    events = ingest.normalize(lines.read(c.spark, c.args.file), F.lit(c.now), own.overrides, own.rules).cache()
    rate = a.normalization_rate(events).first()
    c.out(f"{rate['total']:,} lines, {rate['normalized']:,} normalized ({rate['pct'] or 0:.1f} %)")
    c.show(a.group_count(events, "_source_type", "_format").orderBy(F.desc("count"), "_source_type", "_format"), "tsv")
    rules = rl.load_rules(c.args.rules) if c.args.rules else rl.shipped()
    resolve = search.event_field(events)
    suppressed = sp.suppressed(sp.load_suppressions(c.args.suppress), resolve) if c.args.suppress else None
    hits = rl.match_rules(events, rules, resolve, events["line"], suppressed)
    c.show(a.group_count(hits, "rule_id", "level").orderBy(F.desc("count"), "rule_id"), "tsv")
    events.unpersist()
    return 0


def validate(c: Command) -> int:
    """Reads every file; reports what can't be read, and fields that are indexed and not produced, or the other way round."""
    bad = 0

    def tried(what: str, read: Callable):
        nonlocal bad
        try:
            found = read()
            c.out(f"ok   {what}")
            return found
        except (EngineError, OSError, ValueError, KeyError) as e:
            bad += 1
            c.out(f"bad  {what}: {e}")

    indexed = tried("sources", lambda: config.index_fields(c.args.sources)) if c.args.sources else None
    own = tried("normalizer", lambda: _normalizer(c.args.config))
    for path in rl.rule_files(c.args.rules) if c.args.rules else []:
        tried(str(path), lambda path=path: rl.read_rule(path))
    for what, path, read in (("correlations", c.args.correlations, config.correlations), ("suppressions", c.args.suppress, sp.load_suppressions), ("digest", c.args.digest, digest.Config.load)):
        if path:
            tried(what, lambda: read(path))
    if indexed and own:
        missing, unused = config.cross_check(own.rules, indexed)
        c.out(f"produced, not indexed: {', '.join(sorted(missing)) or '-'}")
        c.out(f"indexed, not produced: {', '.join(sorted(unused)) or '-'}")
    return 1 if bad else 0


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logquern")
    top.add_argument("--data-dir", default="data")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable[[Command], int], *options: tuple) -> None:
        p = sub.add_parser(name, help=(run.__doc__ or "").splitlines()[0] if run.__doc__ else None)
        p.set_defaults(run=run)
        for flag, settings in options:
            p.add_argument(flag, **settings)

    yes, form = {"action": "store_true"}, ("--format", {"choices": ("json", "tsv", "tsv-noheader"), "default": "json"})
    add("status", status, ("--verbose", yes))
    add("stats", stats, ("--source", {}), ("--interval", {}), ("--last", {"default": "24h"}), form)
    add("search", search_, ("query", {}), ("--after", {}), ("--before", {}), ("--window", {}), ("--no-limit", yes), ("--raw", yes), form)
    add("alerts", alerts, ("--query", {}), ("--all", yes), ("--correlated", yes), ("--ack", {}), ("--note", {}), form)
    add("digest", digest_, ("--window", {"default": "24h"}), ("--interval", {"default": "1h"}), ("--config", {}), ("--format", {"choices": ("text", "json"), "default": "text"}))
    add("tail", tail, ("--query", {}), ("--no-follow", yes), ("--seconds", {"type": float, "default": None}))
    add("retention", retention, ("--days", {"type": int, "required": True}), ("--yes", yes))
    add("dry-run", dry_run, ("file", {}), ("--config", {}), ("--rules", {}), ("--suppress", {}))
    add("validate", validate, ("--sources", {}), ("--config", {}), ("--rules", {}), ("--correlations", {}), ("--suppress", {}), ("--digest", {}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: Callable[[str], None] = print, now: datetime | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or session.build()
    try:
        return args.run(Command(spark, args, out, now or datetime.fromtimestamp(time.time(), UTC)))
    except (EngineError, ValueError) as e:
        print(f"logquern: {e}", file=sys.stderr)
        return 1
