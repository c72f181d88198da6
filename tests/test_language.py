import random

import pytest
from pyspark.sql import functions as F

from logquern.model import EngineError
from logquern.operators import search
from logquern.plans.dsl import And, Compare, Not, Or, RawContains, parse


def test_precedence():
    e = parse("a == 1 OR NOT b = 2 AND c <> 3").where
    assert e == Or((Compare("a", "eq", "1"), And((Not(Compare("b", "eq", "2")), Compare("c", "ne", "3")))))
    assert parse("NOT NOT a == x").where == Not(Not(Compare("a", "eq", "x")))


def test_clauses():
    q = parse("SELECT a, b WHERE any(c) and raw_contains('x y') GROUP BY d LIMIT 5")
    assert (q.select, q.group_by, q.limit) == (("a", "b"), ("d",), 5)
    assert q.where == And((Compare("c", "any"), RawContains("x y")))
    assert parse("").where is None


@pytest.mark.parametrize("bad", ["a ==", "a == 'x", "nope(a)", "startswith(a)", "cidr_match(a, '10.0.0.0/33')", "cidr_match(a,'x')", "a == 1 LIMIT z", "a == 1 b", "(a == 1", "a ! b", "1x-y == 3", "GROUP a"])
def test_errors(bad):
    with pytest.raises(EngineError):
        parse(bad)


def test_unknown_field():
    with pytest.raises(EngineError):
        parse("zzz == 1", {"a"})
    assert parse("SELECT zzz WHERE a == 1", {"a"}).select == ("zzz",)


ROWS = [("user1", "10.0.0.5", "a_b"), ("", "10.1.0.5", "aXb"), ("USER2", "x", "100%"), (None, "10.0.0.255", "")]


def evaluate(e, row, mode):
    """The language by hand."""
    import re

    value = lambda f: dict(zip(("u", "ip", "t"), row))[f]
    match e:
        case Compare():
            v = value(e.field)
            if mode == "index":
                v = v or ""
            elif v is None:
                return False
            like = lambda p: re.fullmatch("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in p), v, re.I | re.S) is not None
            if e.op == "eq":
                return v == e.value
            if e.op == "ne":
                return v != e.value
            if e.op == "any":
                return v != ""
            if e.op == "cidr_match":
                return bool(re.fullmatch(r"10\.0\.\d+\.\d+", v))
            low, want = v.lower(), e.value.lower()
            if mode == "json":
                return {"startswith": low.startswith(want), "endswith": low.endswith(want), "contains": want in low}[e.op]
            return like({"startswith": f"{e.value}%", "endswith": f"%{e.value}", "contains": f"%{e.value}%"}[e.op])
        case Not():
            return not evaluate(e.item, row, mode)
        case And():
            return all(evaluate(x, row, mode) for x in e.items)
        case Or():
            return any(evaluate(x, row, mode) for x in e.items)


@pytest.mark.parametrize("mode", ["index", "json"])
def test_random_expressions(spark, mode):
    rng = random.Random(3)

    def leaf():
        f = rng.choice(["u", "t"])
        op = rng.choice(["==", "!=", "startswith", "endswith", "contains", "any", "cidr"])
        v = rng.choice(["user1", "user", "_", "a_b", "%", "100%", "b"])
        if op in ("==", "!="):
            return f"{f} {op} '{v}'"
        if op == "any":
            return f"any({f})"
        return "cidr_match(ip, '10.0.0.0/16')" if op == "cidr" else f"{op}({f}, '{v}')"

    def tree(d):
        if d == 0 or rng.random() < 0.3:
            return leaf()
        return rng.choice([f"({tree(d - 1)} AND {tree(d - 1)})", f"({tree(d - 1)} OR {tree(d - 1)})", f"NOT {tree(d - 1)}"])

    df = spark.createDataFrame(ROWS, "u string, ip string, t string")
    queries = [tree(3) for _ in range(25)]
    from logquern.plans.predicates import compile_expr

    got = df.select(*[compile_expr(parse(q).where, lambda n: F.col(n), F.lit(""), mode).alias(f"q{i}") for i, q in enumerate(queries)]).collect()
    for i, q in enumerate(queries):
        assert [r[i] for r in got] == [evaluate(parse(q).where, row, mode) for row in ROWS], q


def test_groups_and_limits(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "k string, v string")
    assert [tuple(r) for r in search.run(df, "GROUP BY k LIMIT 2").collect()] == [("a", 2), ("", 1)]
    assert search.run(df, "v == x", cap=1).count() == 1
    assert search.run(df, "SELECT none WHERE v == y").collect()[0][0] is None


def test_alert_fields(spark):
    df = spark.createDataFrame([("r1", {"src_ip": "1.2.3.4"}, None), (None, None, [{"src_ip": "5.6.7.8"}])], "rule_id string, event map<string,string>, sample_events array<map<string,string>>")
    assert [r[0] for r in search.run(df, "SELECT src_ip", mode="json").collect()] == ["1.2.3.4", "5.6.7.8"]
    assert search.run(df, "rule_id != r2", mode="json").count() == 1
    assert search.run(df, "NOT rule_id == r2", mode="json").count() == 2
