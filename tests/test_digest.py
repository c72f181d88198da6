from datetime import UTC, datetime, timedelta

from logquern.operators import digest
from logquern.sources.events import load_events
from logquern.timeutil import Window, parse_window


def test_report(spark):
    events = load_events(spark, "/root/testdata/sf0.001")
    window = Window(datetime(2024, 1, 16, tzinfo=UTC), datetime(2024, 1, 23, tzinfo=UTC))
    found = digest.report(events, window, interval=timedelta(days=1))
    assert found["coverage"]["sources_reporting"] == 5
    assert sum(found["network"]["block_trend"]) == digest.blocked(events, window).count() and len(found["network"]["block_trend"]) == 7
    assert sum(r["count"] for r in found["volume"]) == events.filter(window.contains(digest.at())).count()
    text = digest.render(found)
    assert "=== VOLUME" in text and digest.render(found, "json").startswith("{")


def test_sparkline():
    assert digest.sparkline([0, 0, 8, 0]) == "▁▁█▁"
    assert digest.sparkline([3, 3, 3]) == "stable"


def test_windows():
    w = parse_window("24h", datetime(2024, 1, 2, tzinfo=UTC))
    assert (w.start, w.baseline().start) == (datetime(2024, 1, 1, tzinfo=UTC), datetime(2023, 12, 31, tzinfo=UTC))


def test_report_is_whole(spark):
    """More than 1,000 groups in each section: all of them, the largest first."""
    events = spark.sql(
        """
        SELECT TIMESTAMP_NTZ'2024-01-16 01:00:00' AS event_sec, source AS _source_type, 'ALLOW' AS action, type AS event_type, true AS _normalized,
          concat('10.0.', id div 250, '.', id % 250) AS src_ip, concat('10.1.', id div 250, '.', id % 250) AS dst_ip, '443' AS dst_port, 're1' AS interface, 'in' AS direction
        FROM (SELECT id, explode(sequence(1, if(id = 1200, 3, 1))) FROM range(1500)), VALUES ('filterlog', 'allow'), ('sshd', 'ssh_auth_failure') AS t(source, type)
        """
    )
    found = digest.report(events, Window(datetime(2024, 1, 16, tzinfo=UTC), datetime(2024, 1, 17, tzinfo=UTC)))
    for rows, n in ((found["network"]["inbound"], "count"), (found["network"]["new_destinations"], "count"), (found["auth"]["failures"], "count")):
        assert len(rows) == 1500 and rows[0][n] == 3 and rows[1][n] == 1
    assert found["network"]["inbound"][0]["src_ip"] == found["auth"]["failures"][0]["src_ip"] == "10.0.4.200"
