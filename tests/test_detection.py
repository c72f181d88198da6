import random

import pytest
from pyspark.sql import functions as F

from logquern.model import EngineError
from logquern.operators import alerts as al
from logquern.operators import search, stateful
from logquern.plans import rules as rl
from logquern.plans import suppress as sp


def test_strict_and_lenient():
    spec = {"id": "x", "title": "x", "detection": {"s": {"a": ["1", "2"]}, "condition": "s"}}
    with pytest.raises(EngineError):
        rl.load_rule(spec)
    assert rl.load_rule(spec, strict=False).selections == {"s": []}
    with pytest.raises(EngineError):
        rl.load_rule({"id": "x", "title": "x", "detection": {"s": {"a": "1"}, "condition": "all_of_them"}})
    assert rl.load_rule({"id": "x", "title": "x", "status": "deprecated", "detection": {"condition": "s"}}) is None


def test_suppression_of_missing_field(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, u string")
    of = sp.suppressed([sp.parse_suppression({"rule_id": "r", "condition": "u != a"})], search.event_field(df))
    assert [r.id for r in df.filter(of("r")).collect()] == [2]
    assert df.filter(of("other")).count() == 0
    assert sp.parse_suppression({"rule_id": "r", "condition": "contains(u, a)"}) is None


def test_dedup_boundary(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate([0, 1, 3, 5, 6, 12])], "key string, timestamp long, tie long")
    assert sorted(r.timestamp for r in stateful.dedup(df, ["key"], "timestamp", "tie", 5).collect()) == [0, 5, 12]
    assert stateful.dedup(df, ["key"], "timestamp", "tie", 0).count() == 6


def fire(rule, *alerts):
    chain = stateful.Chain(rule)
    return [f for r, t in alerts if (f := chain.feed(r, t))]


def test_chains():
    ordered = stateful.ChainRule("o", "o", "ip", (("a", 3), ("b", 1)), 300, True)
    assert [(f["chain_start"], f["chain_end"], f["step_counts"]) for f in fire(ordered, ("a", 0), ("a", 1), ("a", 2), ("b", 3))] == [(0, 3, [3, 1])]
    assert not fire(ordered, ("b", 0), ("a", 1), ("a", 2), ("a", 3))
    assert not fire(ordered, ("a", 0), ("a", 1), ("a", 2), ("b", 301))
    assert fire(ordered, ("a", 0), ("a", 1), ("a", 2), ("b", 300))
    assert fire(ordered, ("b", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 4))[0]["chain_start"] == 0  # opened by what doesn't count
    twice = stateful.ChainRule("t", "t", "ip", (("a", 1), ("a", 1)), 300, True)
    assert len(fire(twice, ("a", 0))) == 1
    many = stateful.ChainRule("m", "m", "ip", (("a", 5),), 60, False)
    assert not fire(many, *[("a", i) for i in range(4)])
    assert len(fire(many, *[("a", i) for i in range(10)])) == 2


def test_chain_frames(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice(["", "1.1.1.1", "2.2.2.2"]), rng.randrange(2000), i) for i in range(300)]
    rule = stateful.ChainRule("o", "o", "ip", (("a", 2), ("b", 1)), 100, True)
    df = spark.createDataFrame(rows, "rule_id string, ip string, timestamp long, tie long")
    got = sorted((r.join_value, r.chain_start, r.chain_end) for r in stateful.chains(df, [rule]).collect())
    want = []
    for ip in ("1.1.1.1", "2.2.2.2"):
        own = sorted((t, k, r) for r, i, t, k in rows if i == ip)
        want += [(ip, f["chain_start"], f["chain_end"]) for f in fire(rule, *[(r, t) for t, _, r in own])]
    assert got == sorted(want) and got


def test_streaming_agrees(spark, tmp_path):
    from logquern.streaming import state

    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["1.1.1.1", "2.2.2.2"]), rng.randrange(500), i, "s") for i in range(120)]
    schema = "rule_id string, ip string, timestamp long, tie long, sample string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    rule = stateful.ChainRule("o", "o", "ip", (("a", 2), ("b", 1)), 100, True)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, out, want in (
        ("d", state.dedup(stream, ["rule_id", "ip"], window=5), stateful.dedup(df, ["rule_id", "ip"], "timestamp", "tie", 5).select("timestamp", "tie")),
        ("c", state.chains(stream, [rule]), stateful.chains(df, [rule]).select("join_value", "chain_start", "chain_end")),
    ):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_acks_and_levels(spark):
    alerts = spark.createDataFrame([("r", 999), ("r", 1000), ("r", 1001), ("q", 1), (None, 5)], "rule_id string, timestamp long")
    acks = spark.createDataFrame([("r", 500, None), ("r", 1000, "seen")], "rule_id string, timestamp long, note string")
    assert sorted(r.timestamp for r in al.open_alerts(alerts, acks).collect()) == [1, 5, 1001]
    levels = spark.createDataFrame([("ruled", x) for x in ("low", "medium", "high", "critical", "info")] + [("correlated", None)], "type string, level string")
    assert sorted(r.priority for r in al.notifiable(levels).collect()) == ["critical", "high", "high"]
