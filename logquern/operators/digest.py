"""The digest: one window against its baseline, section by section. Sections are DataFrames; only `report` collects them."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Ordered
from pyspark.sql import functions as F

from ..functions.text import filled
from ..model import EngineError
from ..timeutil import Window, literal
from . import aggregate as a
from .search import event_field


@dataclass
class Config:
    spike_threshold_pct: float = 50.0
    new_source_always_flag: bool = True
    min_count: int = 5
    unparsed_min_events: int = 50
    coverage_lookback_hours: int = 24
    new_destination_always_flag: bool = True
    wan_interface: str = "re1"
    top_blocked_limit: int = 20
    concentration_threshold_pct: float = 80.0

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Sections volume, coverage, network and alerts; what a file doesn't set keeps its default."""
        found = tomllib.loads(Path(path).read_text())
        given: dict = {}
        for section, keys in SECTIONS.items():
            own = found.pop(section, {})
            if unknown := set(own) - set(keys):
                raise EngineError(f"{path}: unknown key {section}.{sorted(unknown)[0]}")
            given |= own
        if found:
            raise EngineError(f"{path}: unknown block {sorted(found)[0]!r}")
        return cls(**given)


# The sections and keys of a digest's configuration, the event types of its lists, and what makes a storm.
SECTIONS = {
    "volume": ("spike_threshold_pct", "new_source_always_flag", "min_count"),
    "coverage": ("unparsed_min_events", "coverage_lookback_hours"),
    "network": ("new_destination_always_flag", "wan_interface", "top_blocked_limit"),
    "alerts": ("concentration_threshold_pct",),
}
AUTH_FAILURES = ("ssh_auth_failure", "ssh_auth_timeout", "vpn_auth_failure", "vpn_tls_error")
SUCCESSES = ("ssh_auth_success",)
TRANSITIONS = ("unit_started", "unit_stopped", "unit_stopping", "unit_failed")
STORM_GAP_SECONDS, STORM_UNITS = 300, 5


def at() -> Column:
    return F.col("event_sec")


def cold_start(events: DataFrame, window: Window) -> DataFrame:
    """earliest, and whether what is known of the baseline is less than half of it."""
    before = window.baseline()
    known = F.timestamp_diff("SECOND", F.greatest(F.col("earliest"), literal(before.start)), literal(before.end))
    return events.agg(F.min(at()).alias("earliest")).withColumn("cold", F.coalesce(known < before.length.total_seconds() / 2, F.lit(True)))


def gone_silent(events: DataFrame, window: Window) -> DataFrame:
    return a.only_in(events, "_source_type", at(), window.baseline(), window)


def new_sources(events: DataFrame, window: Window) -> DataFrame:
    return a.only_in(events, "_source_type", at(), window, window.baseline())


def unparsed(events: DataFrame, window: Window, least: int = 50) -> DataFrame:
    return a.group_count(events.filter(window.contains(at()) & ~F.col("_normalized")), "app_name").filter(F.col("count") > least)


def completeness(raw: DataFrame, indexed: DataFrame) -> DataFrame:
    """Hours with fewer indexed events than raw ones: dt, hh, raw, indexed."""
    count = lambda df, name: df.groupBy("dt", "hh").agg(F.count(F.lit(1)).alias(name))
    return count(raw, "raw").join(count(indexed, "indexed"), ["dt", "hh"], "left").withColumn("indexed", F.coalesce("indexed", F.lit(0))).filter("indexed < raw")


def index_lag(raw: DataFrame, indexed: DataFrame) -> DataFrame:
    """Seconds from the newest indexed event to the newest raw one."""
    newest = lambda df, name: df.agg(F.max(at()).alias(name))
    return newest(raw, "raw").join(newest(indexed, "indexed"), F.lit(True)).select(F.timestamp_diff("SECOND", "indexed", "raw").alias("lag_s"))


def blocked(events: DataFrame, window: Window) -> DataFrame:
    return events.filter(window.contains(at()) & (F.col("_source_type") == "filterlog") & (F.col("action") == "BLOCK"))


def inbound(events: DataFrame, window: Window, interface: str | None = None) -> DataFrame:
    own = events.filter(window.contains(at()) & (F.col("_source_type") == "filterlog") & (F.col("action") == "ALLOW"))
    if interface and "interface" in events.columns:
        own = own.filter((F.col("interface") == interface) & (F.col("direction") == "in"))
    return a.group_count(own, "src_ip", "dst_ip", "dst_port")


def new_destinations(events: DataFrame, window: Window) -> DataFrame:
    """dst_ip, dst_port, count and first_seen (of the address, whatever the port) of addresses that the baseline lacks."""
    before = window.baseline()
    allowed = events.filter((F.col("_source_type") == "filterlog") & (F.col("action") == "ALLOW") & filled(F.col("dst_ip")))
    by_port = allowed.filter(window.contains(at()) | before.contains(at())).groupBy("dst_ip", "dst_port").agg(F.count_if(window.contains(at())).alias("count"), F.count_if(before.contains(at())).alias("old"), F.min(F.when(window.contains(at()), at())).alias("first"))
    by_ip = by_port.groupBy("dst_ip").agg(F.sum("old").alias("old"), F.min("first").alias("first_seen"), F.collect_list(F.struct("dst_port", "count")).alias("ports"))
    return by_ip.filter("old = 0").select("dst_ip", "first_seen", F.inline("ports")).filter("count > 0").select("dst_ip", "dst_port", "count", "first_seen")


def _auth(events: DataFrame, window: Window, types: tuple[str, ...] = AUTH_FAILURES) -> DataFrame:
    return events.filter(window.contains(at()) & F.col("event_type").isin(*types) & filled(F.col("src_ip")))


def auth_failures(events: DataFrame, window: Window, types: tuple[str, ...] = AUTH_FAILURES) -> DataFrame:
    return a.breakdown(_auth(events, window, types), "src_ip", ["_source_type", "event_type"])


def alert_summary(alerts: DataFrame, window: Window) -> DataFrame:
    """rule_id, count, title and level as first seen, and whether the rule is new in the window."""
    time = F.timestamp_seconds("timestamp").cast("timestamp_ntz")
    return alerts.filter(time < literal(window.end)).groupBy("rule_id").agg(F.count_if(window.contains(time)).alias("count"), F.min_by("rule_title", "timestamp").alias("rule_title"), F.min_by("level", "timestamp").alias("level"), (F.min(time) >= literal(window.start)).alias("first_time")).filter("count > 0")


def listed(events: DataFrame, window: Window, names: dict[str, str], where: Column) -> DataFrame:
    """The window's events that meet a condition: timestamp and named fields, '' where one lacks."""
    resolve = event_field(events)
    cells = [F.coalesce(resolve(field), F.lit("")).alias(name) for name, field in names.items()]
    return events.filter(window.contains(at()) & where).select(at().alias("timestamp"), *cells)


def successes(events: DataFrame, window: Window, types: tuple[str, ...] = SUCCESSES) -> DataFrame:
    return listed(events, window, {"src_ip": "src_ip", "username": "username", "source": "_source_type"}, F.col("event_type").isin(*types))


def sudo_commands(events: DataFrame, window: Window) -> DataFrame:
    names = {"username": "username", "target_user": "target_user", "command": "command"}
    return listed(events, window, names, (F.col("_source_type") == "sudo") & (F.col("event_type") == "sudo_command"))


def config_changes(events: DataFrame, window: Window) -> DataFrame:
    return listed(events, window, {"admin_user": "admin_user", "src_ip": "src_ip", "page": "pfsense_page"}, F.col("event_type") == "pfsense_config_change")


def critical_events(events: DataFrame, window: Window) -> DataFrame:
    names = {"source": "_source_type", "event_type": "event_type", "severity": "severity"}
    return listed(events, window, names, event_field(events)("severity").isin("critical", "emergency"))


def service_restarts(events: DataFrame, window: Window) -> DataFrame:
    """unit, count, first_seen, last_seen, and the number of the storm that the unit belongs to, or null. Units in order of
    first_seen, each at most STORM_GAP_SECONDS after the one before, are a storm if they are STORM_UNITS or more. The order
    is over units, a row for each, not over events."""
    unit = event_field(events)("unit")
    own = events.filter(window.contains(at()) & (F.col("_source_type") == "systemd") & F.col("event_type").isin(*TRANSITIONS) & filled(unit))
    units = own.groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("count"), F.min(at()).alias("first_seen"), F.max(at()).alias("last_seen"))
    order = Ordered.orderBy("first_seen", "unit")
    gap = F.timestamp_diff("SECOND", F.lag("first_seen").over(order), F.col("first_seen"))
    units = units.withColumn("opens", F.coalesce(gap > STORM_GAP_SECONDS, F.lit(True)).cast("int"))
    units = units.withColumn("cluster", F.sum("opens").over(order))
    size = F.count(F.lit(1)).over(Ordered.partitionBy("cluster"))
    return units.withColumn("size", size).select("unit", "count", "first_seen", "last_seen", F.when(F.col("size") >= STORM_UNITS, F.col("cluster")).alias("storm"))


def storms(restarts: DataFrame) -> DataFrame:
    own = restarts.filter("storm IS NOT NULL").groupBy("storm")
    return own.agg(F.count(F.lit(1)).alias("unit_count"), F.array_sort(F.collect_list("unit")).alias("units"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).drop("storm")


def report(events: DataFrame, window: Window, config: Config | None = None, alerts: DataFrame | None = None, interval: timedelta = timedelta(hours=1), raw: DataFrame | None = None) -> dict:
    """Every section, collected whole: only top_blocked is cut, after its order. Lists are as long as the window makes
    them, so a large window needs a driver that holds them; take the sections' own functions to write them instead.
    raw: the raw events (with _normalized, app_name, dt and hh), which completeness, lag and unparsed lines come from."""
    config = config or Config()
    day = window.lookback(timedelta(hours=config.coverage_lookback_hours))
    start = min(window.baseline().start, day.baseline().start)
    span = events.filter((at() >= literal(start)) & (at() < literal(window.end))).cache()
    rows = lambda df, *order: [r.asDict(True) for r in df.orderBy(*order).collect()]
    cold = bool(cold_start(events, window).first()["cold"])
    out = {
        "window": {"start": window.start.isoformat(), "end": window.end.isoformat(), "baseline_start": window.baseline().start.isoformat(), "baseline_end": window.start.isoformat()},
        "coverage": _coverage(events, span, window, day, config, cold, raw),
        "volume": rows(a.volume(span, "_source_type", at(), window, config.spike_threshold_pct, config.min_count, config.new_source_always_flag, cold).withColumnRenamed("_source_type", "source"), F.desc("count"), "source"),
        "network": _network(span, window, config, interval, rows),
        "auth": {
            "failures": _failures(rows(a.group_count(_auth(span, window), "src_ip", "_source_type", "event_type"), F.desc("count"), "src_ip", "_source_type", "event_type")),
            "successes": rows(successes(span, window), "timestamp", "src_ip", "username"),
            "sudo": rows(sudo_commands(span, window), "timestamp", "username", "command"),
        },
        "alerts": _alerts(alerts, window, config, rows),
        "notable": _notable(span, window, rows),
    }
    span.unpersist()
    return out


def _coverage(events: DataFrame, span: DataFrame, window: Window, day: Window, config: Config, cold: bool, raw: DataFrame | None) -> dict:
    names = lambda df: [r[0] for r in df.orderBy("_source_type").collect()]
    day_cold = bool(cold_start(events, day).first()["cold"])
    raw = events if raw is None else raw
    newest = lambda df: df.agg(F.max(at())).first()[0]
    latest_raw, latest = newest(raw), newest(events)
    missing = completeness(raw.filter(window.contains(at())), span.filter(window.contains(at()))) if {"dt", "hh"} <= set(raw.columns) & set(events.columns) else None
    return {
        "sources_reporting": span.filter(window.contains(at()) & filled(F.col("_source_type"))).select("_source_type").distinct().count(),
        "gone_silent": names(gone_silent(span, day)),
        "new_sources": [] if day_cold else names(new_sources(span, day)),
        "unparsed_high_volume": [r.asDict() for r in unparsed(raw, window, config.unparsed_min_events).orderBy(F.desc("count"), "app_name").collect()] if {"_normalized", "app_name"} <= set(raw.columns) else [],
        "latest_raw": latest_raw,
        "latest_indexed": latest,
        "index_lag_seconds": int((latest_raw - latest).total_seconds()) if latest_raw and latest else None,
        "incomplete_buckets": [r.asDict() for r in missing.orderBy("dt", "hh").collect()] if missing is not None else [],
        "cold_start": cold,
        "coverage_cold_start": day_cold,
    }


def _network(span: DataFrame, window: Window, config: Config, interval: timedelta, rows: Callable) -> dict:
    shut = blocked(span, window)
    new = rows(new_destinations(span, window), F.desc("count"), "dst_ip", "dst_port") if config.new_destination_always_flag else []
    return {
        "block_trend": [r["count"] for r in a.series(shut, at(), window, interval).orderBy("bucket").collect()],
        "top_blocked": rows(a.top(shut, ["src_ip", "protocol"] if "protocol" in shut.columns else ["src_ip"], config.top_blocked_limit), F.desc("count"), "src_ip"),
        "inbound": rows(inbound(span, window, config.wan_interface), F.desc("count"), "src_ip", "dst_ip", "dst_port"),
        "new_destinations": new,
    }


def _failures(found: list[dict]) -> list[dict]:
    """A row for each address, with its counts by source and event type."""
    by: dict[str, dict] = {}
    for r in found:
        own = by.setdefault(r["src_ip"], {"src_ip": r["src_ip"], "count": 0, "by_source": []})
        own["count"] += r["count"]
        own["by_source"].append({"source": r["_source_type"], "event_type": r["event_type"], "count": r["count"]})
    return sorted(by.values(), key=lambda r: (-r["count"], r["src_ip"]))


def _alerts(alerts: DataFrame | None, window: Window, config: Config, rows: Callable) -> dict:
    found = rows(alert_summary(alerts, window), F.desc("count"), "rule_id") if alerts is not None else []
    total, warning = sum(r["count"] for r in found), None
    if found and 100 * found[0]["count"] / total > config.concentration_threshold_pct:
        warning = f"rule '{found[0]['rule_id']}' accounts for {100 * found[0]['count'] / total:.0f}% of alerts this window"
    return {"total": total, "by_rule": found, "first_time_rules": [r["rule_id"] for r in found if r["first_time"]], "concentration_warning": warning}


def _notable(span: DataFrame, window: Window, rows: Callable) -> dict:
    restarts = service_restarts(span, window).cache()
    out = {
        "config_changes": rows(config_changes(span, window), "timestamp", "admin_user", "page"),
        "service_restarts": rows(restarts.filter("storm IS NULL").drop("storm"), F.desc("count"), "unit"),
        "boot_storms": rows(storms(restarts), "first_seen"),
        "critical_events": rows(critical_events(span, window), "timestamp", "source", "event_type"),
    }
    restarts.unpersist()
    return out


LEVELS = "▁▂▃▄▅▆▇█"


def sparkline(counts: list[int], spike_pct: float = 100.0) -> str:
    """Bars, if the largest stands out from the mean by more than spike_pct per cent; else `stable`."""
    mean, most = sum(counts) / max(len(counts), 1), max(counts, default=0)
    if not mean or (most - mean) / mean * 100 <= spike_pct:
        return "stable"
    return "".join(LEVELS[round(v / most * 7)] for v in counts)


def render(found: dict, form: str = "text") -> str:
    if form == "json":
        return json.dumps(found, indent=2, default=str, ensure_ascii=False)
    window, coverage, network, auth, notable = (found[k] for k in ("window", "coverage", "network", "auth", "notable"))
    span = f"{window['start']} – {window['end']}"
    cells = lambda r, *keys: "  " + "  ".join(str(r[k]) if r[k] is not None else "" for k in keys)
    part = lambda title, lines: [f"=== {title} ===", "", *(lines or ["  (none)"]), ""]
    out = part(f"COVERAGE ({span})", [f"  {k}: {', '.join(map(str, v)) if isinstance(v, list) else v}" for k, v in coverage.items()])
    out += part(f"VOLUME ({span} vs {window['baseline_start']} – {window['baseline_end']})", [f"  {r['source']}: {r['count']:,} (before: {r['baseline']:,}){' ' + r['flag'] if r['flag'] else ''}" for r in found["volume"]])
    out += part("FIREWALL TRENDS (BLOCK)", [f"  {sparkline(network['block_trend'])}"])
    out += part("TOP BLOCKED SOURCE IPs", [cells(r, "src_ip", "count") for r in network["top_blocked"]])
    out += part("INBOUND ALLOWED", [cells(r, "src_ip", "dst_ip", "dst_port", "count") for r in network["inbound"]])
    out += part("NEW OUTBOUND DESTINATIONS (vs baseline)", [cells(r, "dst_ip", "dst_port", "count", "first_seen") for r in network["new_destinations"]])
    out += part("AUTHENTICATION FAILURES (all sources)", [cells(r, "src_ip", "count") + "  " + ", ".join(f"{x['source']}/{x['event_type']}: {x['count']}" for x in r["by_source"]) for r in auth["failures"]])
    out += part("SUCCESSFUL LOGINS / ACCESS", [cells(r, "timestamp", "src_ip", "username", "source") for r in auth["successes"]])
    out += part("PRIVILEGE ESCALATION (sudo)", [cells(r, "timestamp", "username", "target_user", "command") for r in auth["sudo"]])
    warning = found["alerts"]["concentration_warning"]
    out += part("ALERTS", [f"  total: {found['alerts']['total']:,}"] + [f"  {r['rule_id']} [{r['level']}] {r['count']:,}{' (first time)' if r['first_time'] else ''}" for r in found["alerts"]["by_rule"]] + ([f"  {warning}"] if warning else []))
    lines = [cells(r, "timestamp", "admin_user", "src_ip", "page") for r in notable["config_changes"]]
    lines += [f"  {r['unit']}: {r['count']}x transition(s)" for r in notable["service_restarts"]]
    lines += [f"  {r['unit_count']} units from {r['first_seen']} to {r['last_seen']}: {', '.join(r['units'])}" for r in notable["boot_storms"]]
    lines += [cells(r, "timestamp", "source", "event_type", "severity") for r in notable["critical_events"]]
    return "\n".join(out + part("NOTABLE EVENTS", lines))
