"""From raw lines to the event table: envelope, parsing, source label, extraction, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import severity_of_word
from ..functions.text import filled, sanitize
from . import extract, parsers

SYNONYMS = {"src_ip": "src", "dst_ip": "dst", "src_port": "spt", "dst_port": "dpt"}
SELF_DESCRIBING = ("cef", "leef", "json", "json_array", "xml", "yaml")
ENVELOPE = "_raw string, _source string, _source_type string, _host string, _facility string, _severity string, _timestamp string"


def unwrap(lines: DataFrame, raw: str = "value") -> DataFrame:
    """value: the inner line of an envelope, else the line itself; _env_...: what the envelope says, null without one."""
    env = F.from_json(F.when(F.col(raw).startswith("{"), F.col(raw)), ENVELOPE, {"mode": "PERMISSIVE"})
    names = lines.columns
    lines = lines.withColumn("env", F.when(env["_raw"].isNotNull(), env))
    of = {"timestamp": F.col("env._timestamp"), "host": F.col("env._host"), "severity": F.col("env._severity"), "source": F.coalesce("env._source_type", "env._source")}
    return lines.select(*[F.coalesce("env._raw", raw).alias(raw) if n == raw else F.col(n) for n in names], *[v.alias(f"_env_{k}") for k, v in of.items()])


def canonical_app(name: Column) -> Column:
    return F.when(name.isin("sshd-session", "sshd-auth"), "sshd").when(name == "CRON", "cron").otherwise(name)


def fill_from_envelope(df: DataFrame) -> DataFrame:
    p = F.col("parsed")
    return df.withColumn("parsed", p.withField("timestamp", F.coalesce(p["timestamp"], "_env_timestamp")).withField("hostname", F.coalesce(p["hostname"], "_env_host")).withField("severity", F.coalesce(p["severity"], severity_of_word(F.col("_env_severity")))).withField("app_name", canonical_app(p["app_name"])))


def source_type(named: str | None = None) -> Column:
    """The label of the source: as told, of an override, envelope, application, format, host, else unknown."""
    p = F.col("parsed")
    own = F.when(p["format"].isin(*SELF_DESCRIBING), p["format"])
    return sanitize(F.coalesce(F.lit(named), F.nullif(F.col("source_label"), F.lit("")), F.nullif(F.col("_env_source"), F.lit("")), F.nullif(p["app_name"], F.lit("")), own, F.nullif(p["hostname"], F.lit("")), F.lit("unknown")))


def flatten(df: DataFrame, now: Column) -> DataFrame:
    """Columns of the event table; envelope values come before fields of their name, but where force_severity turns that
    round for the severity."""
    p = F.col("parsed")
    of = lambda k: F.nullif(F.get(F.array(p["fields"][k]), F.lit(0)), F.lit(""))
    for name, other in SYNONYMS.items():
        value = F.coalesce(of(name), of(other))
        df = df.withColumn(f"_{name}", value)
    added = F.map_filter(F.create_map(*[x for n in SYNONYMS for x in (F.lit(n), F.col(f"_{n}"))]), lambda _, v: v.isNotNull())
    fields = F.map_concat(F.map_filter(p["fields"], lambda k, _: ~k.isin(*SYNONYMS)), added)
    severity = F.when(F.col("force_severity"), F.coalesce(of("severity"), p["severity"])).otherwise(F.coalesce(p["severity"], of("severity")))
    at = parsers.event_time(p["timestamp"], now)
    time = F.coalesce(at, now)
    out = df.select(
        time.alias("event_time"), F.date_trunc("second", time).cast("timestamp_ntz").alias("event_sec"), at.isNotNull().alias("dated"), F.coalesce(p["timestamp"], F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"), now.alias("_received"),
        F.col("_source_type"), p["format"].alias("_format"), (p["format"] != "plain").alias("_normalized"), F.col("source_addr"), *[p[n].alias(n) for n in ("hostname", "app_name", "proc_id", "msg_id", "facility", "message")], severity.alias("severity"),
        F.trim(F.col("_raw")).alias("_raw"), fields.alias("fields"), time.cast("date").alias("dt"), F.hour(time).alias("hh"),
    )
    return out.withColumn("rec_id", F.sha2(F.concat_ws("|", "_source_type", F.col("event_sec").cast("string"), "_raw"), 256)).withColumn("line", flat_line())


def flat_line() -> Column:
    """The flat record as JSON with sorted keys, without nulls."""
    head = [F.lit(x) if i % 2 == 0 else F.col(n).cast("string") for n in ("timestamp", "_source_type", "_format", "source_addr", "hostname", "app_name", "proc_id", "msg_id", "severity", "facility", "message", "_raw") for i, x in enumerate((n, n))]
    every = F.map_concat(F.col("fields"), F.map_filter(F.create_map(*head), lambda _, v: v.isNotNull()))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(every))))


def in_time(since=None, until=None, drop_undated: bool = False) -> Column:
    """By the event's own time, both ends included; undated events pass unless dropped."""
    out = F.lit(True)
    if since is not None:
        out &= F.col("event_time") >= F.lit(since)
    if until is not None:
        out &= F.col("event_time") <= F.lit(until)
    return F.when(F.col("dated"), out).otherwise(not drop_undated)


def normalize(lines: DataFrame, now: Column, overrides: list[parsers.Override] | None = None, rules: list[extract.ExtractRule] | None = None, source: str | None = None, since=None, until=None, drop_undated: bool = False) -> DataFrame:
    """Events of lines (value, source_addr). now: what stands in for a time that a line lacks, and gives its year.
    overrides and rules: the standard ones, unless given. since, until, drop_undated: as in in_time."""
    overrides = parsers.shipped_overrides() if overrides is None else overrides
    df = unwrap(lines.filter(filled(F.col("value")))).withColumn("_raw", F.col("value"))
    df = parsers.parse(df, "value", overrides)
    if "source_label" not in df.columns:
        df = df.withColumn("source_label", F.lit(None).cast("string"))
    df = fill_from_envelope(df).withColumn("_source_type", source_type(source)).withColumn("_format", F.col("parsed.format"))
    df = extract.apply(df, extract.shipped() if rules is None else rules)
    out = flatten(df, now)
    return out.filter(in_time(since, until, drop_undated)) if since is not None or until is not None or drop_undated else out


def promote(events: DataFrame, names: list[str]) -> DataFrame:
    """Fields as columns, '' where an event has none."""
    return events.select("*", *[F.coalesce(F.get(F.array(F.col("fields")[n]), F.lit(0)), F.lit("")).alias(n) for n in names if n not in events.columns])
