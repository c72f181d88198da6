"""Commands over a data folder, sinks, rebuild modes, notification, and what plans push down."""

import json
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logquern import cli
from logquern.operators import ingest, search
from logquern.plans import rules as rl
from logquern.sources import sinks
from logquern.streaming import pipeline

NOW = datetime(2026, 7, 1, 15, 5, tzinfo=UTC)
SSH = "<86>1 2026-07-01T{}:05:0{}+00:00 myhost sshd 1234 - - Failed password for root from 203.0.113.5 port 22 ssh2"
OTHER = "<86>1 2026-07-01T14:30:00+00:00 myhost sudo 9 - - bob : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/id"
FIELDS = ["src_ip", "dst_ip", "dst_port", "action", "interface", "direction", "event_type", "username", "target_user", "command", "unit", "admin_user", "pfsense_page"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    lines = [SSH.format(hour, i) for hour in (13, 14) for i in range(hour - 10)] + [OTHER, "nothing known"]
    events = ingest.promote(ingest.normalize(spark.createDataFrame([(x, "s") for x in lines], "value string, source_addr string"), F.lit(NOW)), FIELDS)
    sinks.write_events(events, str(folder / "events"))
    stored = spark.read.parquet(str(folder / "events"))
    hits = rl.match_rules(stored, rl.shipped(), search.event_field(stored), stored["line"])
    alerts = hits.select(F.lit("ruled").alias("type"), "rule_id", "rule_title", "level", F.create_map(F.lit("src_ip"), F.col("src_ip")).alias("event"), F.unix_timestamp("event_time").alias("timestamp"))
    sinks.write_alerts(alerts, str(folder / "alerts" / "ruled"))
    return folder


@pytest.fixture
def run(spark, data):
    def call(*argv):
        out = []
        code = cli.main(["--data-dir", str(data), *map(str, argv)], spark, out.append, NOW)
        return code, out

    return call


def test_status_and_stats(run):
    code, out = run("status", "--verbose")
    assert code == 0 and any("sshd" in x and "files" in x for x in out) and "  src_ip: string" in out
    code, out = run("stats", "--format", "tsv")
    assert code == 0 and out[:2] == ["_source_type\tcount", "sshd\t7"]
    code, out = run("stats", "--interval", "1h", "--last", "2026-07-01T13..2026-07-01T15", "--format", "tsv-noheader")
    assert out[0] == "sshd\t3\t4\t7"
    code, out = run("stats", "--source", "sshd")
    assert {"field": "src_ip", "filled": 7, "total": 7, "pct": 100.0} in [json.loads(x) for x in out]


def test_search(run, capsys, monkeypatch):
    code, out = run("search", "SELECT username, src_ip WHERE src_ip == '203.0.113.5'")
    assert code == 0 and len(out) == 7 and json.loads(out[0]) == {"username": "root", "src_ip": "203.0.113.5"}
    assert run("search", "src_ip == '1.2.3.4'") == (1, [])
    assert len(run("search", "src_ip == '203.0.113.5'", "--after", "2026-07-01T14")[1]) == 4
    assert run("search", "((")[0] == 1
    monkeypatch.setattr(search, "DEFAULT_CAP", 2)
    assert len(run("search", "src_ip == '203.0.113.5'")[1]) == 2 and "--no-limit" in capsys.readouterr().err
    assert len(run("search", "src_ip == '203.0.113.5'", "--no-limit")[1]) == 7


def test_alerts_and_ack(run):
    before = len(run("alerts")[1])
    assert before >= 14 and run("alerts", "--correlated")[0] == 1
    assert run("alerts", "--ack", "1001-ssh-brute-force", "--note", "seen")[0] == 0
    assert len(run("alerts")[1]) == before - 7 and len(run("alerts", "--all")[1]) == before
    assert len(run("alerts", "--all", "--query", "src_ip == '203.0.113.5'")[1]) == 14


def test_digest_and_tail(run):
    code, out = run("digest", "--window", "2026-07-01T14..2026-07-01T15", "--format", "json")
    found = json.loads(out[0])
    assert code == 0 and found["auth"]["failures"][0]["count"] == 4 and found["auth"]["sudo"][0]["command"] == "/bin/id"
    code, out = run("tail", "--no-follow", "--query", "src_ip == '203.0.113.5'")
    assert code == 0 and len(out) == 7


def test_dry_run_and_validate(run, tmp_path):
    (tmp_path / "x.log").write_text(OTHER + "\nplain\n")
    code, out = run("dry-run", tmp_path / "x.log")
    assert code == 0 and out[0] == "2 lines, 1 normalized (50.0 %)" and any(x.startswith("1002-sudo-execution") for x in out)
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "good.yml").write_text("id: a\ntitle: A\ndetection:\n  s:\n    x: 1\n  condition: s\n")
    (tmp_path / "rules" / "bad.yaml").write_text("id: b\ntitle: B\ndetection:\n  s:\n    x: 1\n  condition: t\n")
    (tmp_path / "s.toml").write_text('[source.sshd]\nindex_fields = ["src_ip", "never_made"]\n')
    code, out = run("validate", "--rules", tmp_path / "rules", "--sources", tmp_path / "s.toml")
    assert code == 1 and sum(x.startswith("bad") for x in out) == 1 and any("never_made" in x for x in out)
    with pytest.warns(UserWarning):
        assert [r.id for r in rl.load_rules(tmp_path / "rules")] == ["a"]


def test_retention(spark, run, data, tmp_path):
    assert run("retention", "--days", "0")[0] == 1
    spark.read.parquet(str(data / "events")).write.partitionBy("dt", "hh").parquet(str(tmp_path / "events"))
    out = []
    assert cli.main(["--data-dir", str(tmp_path), "retention", "--days", "1"], spark, out.append, NOW + timedelta(days=3)) == 0
    assert out == ["1 days deleted: dt=2026-07-01"]


def test_rebuild(spark, data, tmp_path):
    path = str(tmp_path / "t")
    events = spark.read.parquet(str(data / "events")).cache()
    by_hour = lambda: {r.hh: r["count"] for r in spark.read.parquet(path).groupBy("hh").count().collect()}
    sinks.reindex_all(events, path)
    want = by_hour()
    assert want[13] == 3 and want[14] == 5
    sinks.backfill(events.filter("_source_type = 'sshd'"), path, [("2026-07-01", 13)])
    assert by_hour() == want
    sinks.backfill(events.filter("_source_type = 'sudo'"), path, [("2026-07-01", 14)])
    assert by_hour() == want | {14: 1}
    sinks.backfill(events, path)
    assert by_hour() == want
    sinks.reindex_new(events.filter("hh < 15"), path)
    assert by_hour() == want
    sinks.reindex_all(events.filter("hh = 13"), path)
    assert by_hour() == {13: 3}


def test_pushdown(spark, data):
    """Equality of a column reaches the scan, hours prune partitions."""
    events = spark.read.parquet(str(data / "events"))
    found = search.run(search.bounded(events, "2026-07-01T14", "2026-07-01T14"), "SELECT username WHERE src_ip == '203.0.113.5'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "EqualNullSafe(src_ip,203.0.113.5)" in scan and "PartitionFilters: []" not in scan and "Python" not in plan
    assert "_raw" not in scan.split("ReadSchema:")[1]
    assert len(found.collect()) == 4


def test_notify_without_replay(spark, tmp_path):
    schema = "type string, rule_id string, rule_title string, level string, timestamp long"
    now = int(time.time())
    row = lambda rule, at: spark.createDataFrame([("ruled", rule, "t", "high", at)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    row("old", now - 3600)
    sent = []

    def once():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        pipeline.notify(stream, str(tmp_path / "ck"), sent.append, once=True).awaitTermination(60)

    once()
    assert sent == []
    row("new", now + 5)
    once()
    once()
    assert [r["rule_id"] for r in sent] == ["new"]


def test_alert_sink_and_order(spark, tmp_path):
    alerts = spark.createDataFrame([("r", 10), ("s", 11)], "rule_id string, timestamp long")
    correlated = spark.createDataFrame([("c", 11)], "correlation_id string, chain_end long")
    assert [r.rule_id or r.correlation_id for r in pipeline.in_order(alerts, correlated).collect()] == ["r", "c", "s"]
    sinks.write_alerts(alerts, str(tmp_path / "a"), F.lit(NOW))
    assert [p.name for p in sorted((tmp_path / "a" / "dt=2026-07-01").iterdir())] == ["hh=15"]
