"""Streams: lines to events, counts by event time, datagrams, TCP framing, side files and acknowledgements."""

import socket
from datetime import UTC, datetime

from pyspark.sql import functions as F

from logquern.operators import alerts as al
from logquern.operators import search
from logquern.sources import lines, sinks, udp
from logquern.streaming import pipeline

NOW = datetime(2026, 7, 1, 15, 5, tzinfo=UTC)
LINE = "<86>1 2026-07-01T14:0{}:00+00:00 myhost sshd 1 - - Failed password for root from 203.0.113.5 port 22 ssh2\n"


def test_store_events(spark, tmp_path):
    """Each file of a folder once, whatever the number of starts."""
    folder, path = tmp_path / "in", str(tmp_path / "events")
    folder.mkdir()

    def once():
        stream = lines.follow(spark, str(folder))
        pipeline.store_events(stream, path, str(tmp_path / "ck"), F.lit(NOW), once=True).awaitTermination(120)
        return spark.read.parquet(path).count()

    (folder / "a.log").write_text(LINE.format(1) + LINE.format(2) + "\n")
    assert once() == 2 and once() == 2
    (folder / "b.log").write_text(LINE.format(3))
    assert once() == 3
    row = spark.read.parquet(path).filter("event_sec = '2026-07-01 14:03:00'").first()
    assert (row._source_type, row.fields["src_ip"], row.hh) == ("sshd", "203.0.113.5", 14)


def test_rate(spark, tmp_path):
    rows = [(datetime(2026, 7, 1, 14, 0, s, tzinfo=UTC), "a" if s % 2 else "b") for s in range(0, 60, 10)] + [(datetime(2026, 7, 1, 14, 1, 5, tzinfo=UTC), "a")]
    spark.createDataFrame(rows, "event_time timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pipeline.rate(spark.readStream.schema("event_time timestamp, k string").parquet(str(tmp_path / "in")), "k")
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.window.start.minute, r.k, r["count"]) for r in spark.table("rates").collect()) == [(0, "b", 6), (1, "a", 1)]


def test_datagrams():
    reader = udp.UdpReader({"host": "127.0.0.1", "port": "0", "seconds": "0.5"})
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for text in (b"one\n", b"two \xff"):
        out.sendto(text, reader.socket.getsockname())
    rows, offset = reader.read({"seen": 0})
    assert [r[0] for r in rows] == ["one", "two �"] and offset == {"seen": 2}
    reader.socket.close()
    out.close()


def test_octet_counts(spark):
    df = spark.createDataFrame([("12 <13>hello",), ("5 plain",), ("no 5 count",)], "value string")
    assert [r.value for r in lines.strip_octet_count(df).collect()] == ["<13>hello", "plain", "no 5 count"]


def test_sidecar_and_acks(spark, tmp_path):
    events = spark.createDataFrame([("t", "a\tb", None, "k", "low", "sshd")], "timestamp string, src_ip string, dst_ip string, event_type string, severity string, _source_type string")
    sinks.write_sidecar(events, str(tmp_path / "side"))
    text = max((p.read_text().splitlines() for p in (tmp_path / "side").glob("*.csv")), key=len)
    assert text[0] == "timestamp\tsrc_ip\tdst_ip\tevent_type\tseverity\tsource" and text[1].split("\t")[1] == "a b"
    al.acknowledge(spark, str(tmp_path / "acks"), "r", 5, "note")
    al.acknowledge(spark, str(tmp_path / "acks"), "r", 9)
    acks = spark.read.schema("rule_id string, timestamp long, note string").json(str(tmp_path / "acks"))
    assert [(r.rule_id, r.acked) for r in al.watermarks(acks).collect()] == [("r", 9)]
    assert [r.timestamp for r in sinks.compact_acks(acks, 6).collect()] == [9]


def test_field_order(spark):
    """Top level first, or the event first, as correlations have it."""
    df = spark.createDataFrame([("top", {"ip": "event"})], "ip string, event map<string,string>")
    both = df.select(search.alert_field(df)("ip").alias("a"), search.alert_field(df, event_first=True)("ip").alias("b")).first()
    assert tuple(both) == ("top", "event")
