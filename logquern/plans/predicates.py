"""Syntax trees as Boolean columns, in the two modes of the language.

index: the event table. A missing field is '' (so a != holds on it); text tests follow LIKE: % and _ are live, and case
doesn't count.
json: alerts. A test of a missing field is false, whatever the test; text tests are literal and case doesn't count.

No leaf is ever null, so NOT is two-valued.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import net, text
from .dsl import And, Compare, Expr, Not, Or, RawContains

Resolver = Callable[[str], Column]


def index_leaf(c: Column, e: Compare) -> Column:
    if e.op == "eq" and e.value:
        return c.eqNullSafe(F.lit(e.value))  # reaches the scan, as a comparison of a coalesce would not
    c = F.coalesce(c, F.lit(""))
    match e.op:
        case "eq":
            return c == e.value
        case "ne":
            return c != e.value
        case "any":
            return c != ""
        case "startswith":
            return text.starts(c, e.value)
        case "endswith":
            return text.ends(c, e.value)
        case "contains":
            return text.contains(c, e.value)
    return net.in_network(c, e.value)


def json_leaf(c: Column, e: Compare) -> Column:
    low, value = F.lower(c), e.value.lower()
    match e.op:
        case "eq":
            out = c == e.value
        case "ne":
            out = c != e.value
        case "any":
            out = c != ""
        case "startswith":
            out = low.startswith(value)
        case "endswith":
            out = low.endswith(value)
        case "contains":
            out = low.contains(value)
        case _:
            out = net.in_network(c, e.value)
    return F.coalesce(out, F.lit(False))


LEAVES = {"index": index_leaf, "json": json_leaf}


def compile_expr(e: Expr | None, resolve: Resolver, line: Column, mode: str = "index") -> Column:
    go = lambda x: compile_expr(x, resolve, line, mode)
    match e:
        case None:
            return F.lit(True)
        case Compare():
            return LEAVES[mode](resolve(e.field), e)
        case RawContains():
            return F.coalesce(line.contains(e.value), F.lit(False))
        case Not():
            return ~go(e.item)
        case And():
            return reduce(lambda a, b: a & b, map(go, e.items))
        case Or():
            return reduce(lambda a, b: a | b, map(go, e.items))
    raise TypeError(e)
