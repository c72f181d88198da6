import json
import time

import pytest
from pyspark.sql import functions as F

from logquern.model import EngineError
from logquern.operators import digest, extract, ingest, parsers
from logquern.sources import config, sinks


def test_ssh_line_in_an_envelope(spark):
    raw = "Jul  1 13:05:09 gw sshd[77]: Failed password for invalid user bob from 203.0.113.5 port 4242 ssh2"
    lines = [(json.dumps({"_raw": raw, "_source": "auth"}), "10.0.0.1"), ("not json {", "s"), ('{"a": {"b": 1}, "msg": "hi"}', "s"), ("", "s")]
    df = spark.createDataFrame(lines, "value string, source_addr string")
    ssh = [r for r in extract.shipped() if r.when["app_name"] == "sshd"][:3]
    rows = {r._raw: r for r in ingest.normalize(df, F.lit("2026-07-02").cast("timestamp"), rules=ssh).collect()}
    r = rows[raw]
    assert (r._source_type, r.app_name, r.hostname, str(r.event_time)) == ("auth", "sshd", "gw", "2026-07-01 13:05:09")
    assert r.fields["username"] == "bob" and r.fields["src_ip"] == "203.0.113.5" and r.fields["event_type"] == "ssh_auth_failure"
    assert not rows["not json {"]._normalized
    assert rows['{"a": {"b": 1}, "msg": "hi"}'].fields["a.b"] == "1"
    assert len(rows) == 3
    line = json.loads(r.line)
    assert list(line) == sorted(line) and line["src_ip"] == "203.0.113.5"


def test_filterlog(spark):
    v4 = "66,,,170,re1,match,pass,in,4,0x0,,128,40625,0,none,17,udp,350,0.0.0.0,255.255.255.255,68,67,330"
    v6 = "5,,,1,igb0,match,block,in,6,0x00,0,255,ICMPv6,58,32,fe80::1,ff02::1"
    df = spark.createDataFrame([(v4,), (v6,), ("a,b",), (v4.replace("pass", "rdr"),)], "m string")
    ok, rec = parsers.filterlog(F.col("m"))
    rows = df.select(ok.alias("ok"), rec["fields"].alias("f")).collect()
    assert [r.ok for r in rows] == [True, True, False, False]
    assert rows[0].f == {"action": "ALLOW", "direction": "in", "interface": "re1", "protocol": "UDP", "src_ip": "0.0.0.0", "dst_ip": "255.255.255.255", "src_port": "68", "dst_port": "67"}
    assert rows[1].f["protocol"] == "ICMPV6" and rows[1].f["src_ip"] == "fe80::1" and "src_port" not in rows[1].f


def test_translate():
    assert extract.translate(r"(?P<a_b>x)(?:y)\((?P<c>z)(w)") == (r"(x)(?:y)\((z)(w)", {"a_b": 1, "c": 2})


def test_normalizer_file(tmp_path):
    (tmp_path / "10.toml").write_text(
        """
[listen]  # ports
udp_port = 5514
[[overrides.rule]]
contains = "[UFW "
source = "iptables"
[[overrides.rule]]
contains = " filterlog "
reparse = true
reparse_as = "filterlog"
remap = { src = "src_ip", dst = "dst_ip" }
extra = "other"
[[extract.rule]]
app_name = "sshd"
from = "message"
pattern = "^(?P<n>\\d+) # not a comment"
pattern = "b"
[[extract.rule]]
app_name = "sshd"
n = "7"
set = { kind = "k", severity = "warning" }
force_severity = true
"""
    )
    (tmp_path / "20.toml").write_text('[listen]\nbind = "::"\n[storage]\ndata_dir = "d"\n[[overrides.rule]]\nsource_ip = "10."\nformat = "cef"\n')
    found = config.normalizer(tmp_path)
    assert found.listen == {"bind": "::"} and found.storage == {"data_dir": "d"}
    assert [(o.contains, o.source, o.reparse, o.reparse_as, o.format, o.source_ip) for o in found.overrides] == [("[UFW ", "iptables", False, "", "", ""), (" filterlog ", "", True, "filterlog", "", ""), ("", "", False, "", "cef", "10.")]
    assert found.overrides[1].rename == {"src": "src_ip", "dst": "dst_ip", "extra": "other"}
    assert [(r.when, r.patterns, r.set, r.force_severity) for r in found.rules] == [({"app_name": "sshd"}, ["^(?P<n>\\d+) # not a comment", "b"], {}, False), ({"app_name": "sshd", "n": "7"}, [], {"kind": "k", "severity": "warning"}, True)]
    (tmp_path / "20.toml").write_text("[[override]]\n")
    with pytest.raises(EngineError):
        config.normalizer(tmp_path)


def test_other_files(tmp_path):
    file = tmp_path / "x.toml"
    file.write_text('[source.sshd]\nindex_fields = ["src_ip", "username"]\n[source.default]\nindex_fields = ["dst_ip"]\n')
    assert config.index_fields_by_source(file) == {"sshd": ["src_ip", "username"], "default": ["dst_ip"]}
    assert {"src_ip", "username", "dst_ip"} <= config.index_fields(file)
    file.write_text('[[rule]]\nid = "a"\ntitle = "A"\njoin_field = "src_ip"\nwindow_seconds = 60\nordered = false\n[[rule.step]]\nrule_id = "x"\nmin_count = 3\n[[rule.step]]\nrule_id = "y"\n')
    (rule,) = config.correlations(file)
    assert (rule.steps, rule.window, rule.ordered, rule.join_field) == ((("x", 3), ("y", 1)), 60, False, "src_ip")
    for text in ("[[rules]]\n", "[[rule]]\nid = 'a'\njoin_field = 'b'\n"):
        file.write_text(text)
        with pytest.raises(EngineError):
            config.correlations(file)
    file.write_text("[volume]\nmin_count = 7\n[coverage]\nunparsed_min_events = 3\n[network]\ntop_blocked_limit = 2\n[alerts]\nconcentration_threshold_pct = 60\n")
    got = digest.Config.load(file)
    assert (got.min_count, got.unparsed_min_events, got.top_blocked_limit, got.concentration_threshold_pct, got.coverage_lookback_hours) == (7, 3, 2, 60, 24)
    file.write_text("[volume]\nnoise = 7\n")
    with pytest.raises(EngineError):
        digest.Config.load(file)


def test_xml(spark):
    long = "<e><!-- a comment --><msg>" + "x" * (1 << 20) + "</msg></e>"
    lines = spark.createDataFrame([(long, "s"), ("<!DOCTYPE e [<!ENTITY x 'y'>]><e>&x;</e>", "s"), ("<e a='1'><b>2</b></e>", "s")], "value string, source_addr string")
    rows = [r.parsed for r in parsers.parse(lines).collect()]
    assert [r.format for r in rows] == ["xml", "plain", "xml"] and len(rows[0].message) == 1 << 20
    assert rows[2].fields == {"e.@a": "1", "e.b": "2"}


def test_planning_is_quick(spark):
    """All formats, the standard overrides and every standard rule; one Python call for nested formats."""
    lines = spark.createDataFrame([("x", "s")], "value string, source_addr string")
    ingest.normalize(lines, F.current_timestamp())._jdf.queryExecution().executedPlan()  # classes are loaded
    start = time.time()
    plan = ingest.normalize(lines, F.current_timestamp())._jdf.queryExecution().executedPlan().toString()
    assert time.time() - start < 6 and plan.count("ArrowEvalPython") <= 1


def test_upsert_twice(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "2024-01-01", 1), ("b", "y", "2024-01-01", 2), ("a", "x", "2024-01-01", 1)], "rec_id string, _source_type string, dt string, hh int")
    sinks.upsert(rows, str(tmp_path / "t"))
    sinks.upsert(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_render(spark):
    df = spark.createDataFrame([("a\tb", None)], "x string, y string")
    assert sinks.render(df).first()[0] == '{"x":"a\\tb","y":null}'
    assert sinks.render(df, "tsv").first()[0] == "a b\t"
