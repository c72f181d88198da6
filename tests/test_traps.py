"""Behaviour that a careless reader of the formats and dialects gets wrong."""

import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from logquern.operators import ingest, search
from logquern.plans import rules as rl
from logquern.timeutil import Window

NOW = datetime(2026, 7, 2, 3, 4, 5, tzinfo=UTC)


def events(spark, *lines):
    return ingest.normalize(spark.createDataFrame([(x, "s") for x in lines], "value string, source_addr string"), F.lit(NOW))


def test_marker_behind_the_tag(spark):
    """A syslog header takes `CEF` for the program's name: the marker is looked for in the whole line."""
    rows = events(spark, "<13>Jul  1 03:04:05 gw CEF:0|v|p|1|7|name|5|src=1.2.3.4", "<13>Jul  1 03:04:05 gw LEEF:1.0|v|p|1|id|src=1.2.3.4\tsev=9").collect()
    assert [(r._format, r.fields["src_ip"], r.hostname) for r in rows] == [("cef", "1.2.3.4", "gw"), ("leef", "1.2.3.4", "gw")]


def test_lenient_dialect(spark):
    """List values are dropped, an all-list selection matches everything, `1 of a* or 1 of b*` is one glob, `1 of them`
    leaves keywords out, an unknown modifier never matches."""
    rule = lambda i, **detection: rl.load_rule({"id": i, "title": i, "detection": detection}, strict=False)
    rules = [
        rule("list", s={"x": ["1", "2"]}, condition="s"),
        rule("glob", a1={"x": "1"}, b1={"x": "1"}, condition="1 of a* or 1 of b*"),
        rule("one", a1={"x": "1"}, b1={"x": "2"}, condition="1 of a*"),
        rule("them", a1={"x": "9"}, keywords=["hit"], condition="1 of them"),
        rule("modifier", s={"x|re": "1"}, condition="s"),
        rule("unknown", s={"x": "1"}, condition="t"),
    ]
    df = spark.createDataFrame([(1, "1", "a hit")], "id int, x string, line string").withColumn("_source_type", F.lit("s"))
    got = rl.match_rules(df, rules, search.event_field(df), df["line"]).collect()
    assert [r.rule_id for r in got] == ["list", "one"]


def test_serialized_record(spark):
    """Keywords and raw_contains search the record as JSON with sorted keys."""
    (row,) = events(spark, '{"b": "x \\"quoted\\" y", "a": 1}').collect()
    assert list(json.loads(row.line)) == sorted(json.loads(row.line)) and '\\"quoted\\"' in row.line


def test_undated_lines(spark):
    """A line without a readable time goes by the time it came; the time filter lets it pass unless told otherwise."""
    lines = ("<13>1 not-a-time host app - - - hello", "<13>1 2026-06-01T00:00:00Z host app - - - old", "<13>1 2026-07-01T00:00:00Z host app - - - new")
    df = spark.createDataFrame([(x, "s") for x in lines], "value string, source_addr string")
    rows = {r.message: r for r in ingest.normalize(df, F.lit(NOW)).collect()}
    assert (rows["hello"].dated, rows["hello"].event_time, str(rows["hello"].dt), rows["hello"].hh) == (False, datetime(2026, 7, 2, 3, 4, 5), "2026-07-02", 3)
    since = datetime(2026, 6, 15, tzinfo=UTC)
    assert {r.message for r in ingest.normalize(df, F.lit(NOW), since=since).collect()} == {"hello", "new"}
    assert {r.message for r in ingest.normalize(df, F.lit(NOW), since=since, drop_undated=True).collect()} == {"new"}


def test_new_destination_ignores_the_port(spark):
    from logquern.operators import digest

    at = lambda h, m: datetime(2026, 7, 1, h, m)
    rows = [(at(14, 5), "9.9.9.9", "80"), (at(14, 9), "9.9.9.9", "443"), (at(13, 5), "8.8.8.8", "53"), (at(14, 1), "8.8.8.8", "99")]
    df = spark.createDataFrame(rows, "event_sec timestamp_ntz, dst_ip string, dst_port string").withColumn("_source_type", F.lit("filterlog")).withColumn("action", F.lit("ALLOW"))
    window = Window(datetime(2026, 7, 1, 14, tzinfo=UTC), datetime(2026, 7, 1, 15, tzinfo=UTC))
    got = sorted((r.dst_ip, r.dst_port, r.first_seen) for r in digest.new_destinations(df, window).collect())
    assert got == [("9.9.9.9", "443", at(14, 5)), ("9.9.9.9", "80", at(14, 5))]
