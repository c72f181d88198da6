"""Suppression: conditions of equality, inequality and network, by rule. A test of a missing field is false either way."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EngineError
from .dsl import And, Compare, Expr, Not, Or, parse
from .predicates import compile_expr


@dataclass
class Suppression:
    rule_id: str
    where: Expr
    reason: str = ""
    expires: date | None = None

    def expired(self, today: date) -> bool:
        """An expired one still suppresses; it is for a warning."""
        return self.expires is not None and self.expires < today


def _allowed(e: Expr) -> bool:
    match e:
        case Compare():
            return e.op in ("eq", "ne", "cidr_match")
        case Not():
            return _allowed(e.item)
        case And() | Or():
            return all(map(_allowed, e.items))
    return False


def parse_suppression(spec: dict) -> Suppression | None:
    """None where the condition can't be read."""
    try:
        q = parse(str(spec.get("condition", "")))
    except EngineError:
        return None
    if q.where is None or not _allowed(q.where) or q.select or q.group_by or q.limit is not None:
        return None
    expires = spec.get("expires")
    return Suppression(str(spec.get("rule_id", "")), q.where, str(spec.get("note", spec.get("reason", ""))), date.fromisoformat(expires) if isinstance(expires, str) else expires)


def load_suppressions(path: str | Path) -> list[Suppression]:
    """A file that is no TOML is an error; a block that can't be read is left out."""
    blocks = tomllib.loads(Path(path).read_text()).get("suppress", [])
    return [s for b in blocks if (s := parse_suppression(b))]


def shipped() -> list[Suppression]:
    """The standard suppressions."""
    # Rule, condition and the day from which each is due for review, in order.
    blocks = [
        ("1007-haproxy-tls-probe", 'cidr_match(src_ip, "93.152.208.0/24")', "2026-10-05"),
        ("1007-haproxy-tls-probe", 'cidr_match(src_ip, "199.45.154.0/23")', "2026-10-05"),
        ("1007-haproxy-tls-probe", 'src_ip == "217.103.119.155"', "2026-09-10"),
        ("1007-haproxy-tls-probe", 'src_ip == "192.168.178.12"', None),
        ("1009-firewall-port-scan", 'cidr_match(dst_ip, "224.0.0.0/4") OR dst_ip == "255.255.255.255"', "2026-09-08"),
        ("1009-firewall-port-scan", 'dst_ip == "ff02::2" OR dst_ip == "ff02::c" OR dst_ip == "ff02::16" OR dst_ip == "ff02::fb"', "2026-09-08"),
        ("1012-haproxy-connect-volume", 'cidr_match(src_ip, "194.53.160.0/22")', "2026-10-19"),
        ("1012-haproxy-connect-volume", 'src_ip == "217.103.119.155"', "2026-10-19"),
    ]
    return [parse_suppression({"rule_id": rule, "condition": condition, "expires": expires}) for rule, condition, expires in blocks]


def suppressed(rules: list[Suppression], resolve: Callable[[str], Column]) -> Callable[[str], Column]:
    """Whether an event is suppressed for a rule."""

    def of(rule_id: str) -> Column:
        own = [compile_expr(s.where, resolve, F.lit(""), "json") for s in rules if s.rule_id == rule_id]
        return reduce(lambda a, b: a | b, own, F.lit(False))

    return of
