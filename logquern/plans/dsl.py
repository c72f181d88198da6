"""The query language: tokens, syntax tree and parser.

    query      := [SELECT names] [WHERE] [expr] [GROUP BY names] [LIMIT n]
    expr       := term {OR term};  term := factor {AND factor};  factor := {NOT} primary
    primary    := "(" expr ")" | field (== | = | != | <>) value | function "(" [arg {"," arg}] ")"
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass

from ..functions.net import parse_cidr
from ..model import EngineError, identifier


class DslError(EngineError):
    pass


@dataclass(frozen=True)
class Compare:
    """op: eq, ne, startswith, endswith, contains, cidr_match or any (whose value is empty)"""

    field: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class RawContains:
    value: str


@dataclass(frozen=True)
class Not:
    item: Expr


@dataclass(frozen=True)
class And:
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Or:
    items: tuple[Expr, ...]


Expr = Compare | RawContains | Not | And | Or


@dataclass(frozen=True)
class Query:
    select: tuple[str, ...] = ()
    where: Expr | None = None
    group_by: tuple[str, ...] = ()
    limit: int | None = None


KEYWORDS = {"SELECT", "WHERE", "GROUP", "BY", "LIMIT", "AND", "OR", "NOT"}
TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<op>==|=|!=|<>)|(?P<mark>[(),])|(?P<word>[A-Za-z0-9_][A-Za-z0-9_./:-]*)|(?P<bad>\S))""")
ARITY = {"startswith": 2, "endswith": 2, "contains": 2, "cidr_match": 2, "any": 1, "raw_contains": 1}


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value): kind is text, op, mark, word, or a keyword."""
    out, at = [], 0
    while m := TOKEN.match(text, at):
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "bad":
            raise DslError("unterminated quoted string" if value in "'\"" else f"unexpected character {value!r}")
        if kind == "word" and value.upper() in KEYWORDS:
            kind = value = value.upper()
        out.append((kind, value[1:-1] if kind == "text" else value))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str, fields: Collection[str] | None = None):
        self.left, self.at, self.fields = tokens(text), 0, fields

    def peek(self, k: int = 0) -> str:
        return self.left[self.at + k][0] if self.at + k < len(self.left) else "end"

    def next(self, *kinds: str) -> str:
        if self.peek() not in kinds:
            found = f"{self.left[self.at][1]!r}" if self.at < len(self.left) else "the end"
            raise DslError(f"expected {' or '.join(kinds)}, found {found}")
        self.at += 1
        return self.left[self.at - 1][1]

    def mark(self, value: str) -> None:
        if self.next("mark") != value:
            raise DslError(f"expected {value!r}")

    def is_mark(self, value: str) -> bool:
        return self.peek() == "mark" and self.left[self.at][1] == value

    def query(self) -> Query:
        select = group_by = ()
        where = limit = None
        if self.peek() == "SELECT":
            self.at += 1
            select = self.names(check=False)
        if self.peek() == "WHERE":
            self.at += 1
        if self.peek() not in ("GROUP", "LIMIT", "end"):
            where = self.expr()
        if self.peek() == "GROUP":
            self.at += 1
            self.next("BY")
            group_by = self.names()
        if self.peek() == "LIMIT":
            self.at += 1
            number = self.next("word", "text")
            if not number.isdigit():
                raise DslError(f"LIMIT needs a number, found {number!r}")
            limit = int(number)
        self.next("end") if self.peek() != "end" else None
        return Query(select, where, group_by, limit)

    def names(self, check: bool = True) -> tuple[str, ...]:
        out = [self.name(check)]
        while self.is_mark(","):
            self.at += 1
            out.append(self.name(check))
        return tuple(out)

    def name(self, check: bool = True) -> str:
        return self.field(self.next("word", "text"), check)

    def field(self, name: str, check: bool = True) -> str:
        try:
            identifier(name)
        except EngineError as e:
            raise DslError(str(e)) from None
        if check and self.fields is not None and name not in self.fields:
            raise DslError(f"unknown field {name!r}")
        return name

    def expr(self) -> Expr:
        items = [self.term()]
        while self.peek() == "OR":
            self.at += 1
            items.append(self.term())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def term(self) -> Expr:
        items = [self.factor()]
        while self.peek() == "AND":
            self.at += 1
            items.append(self.factor())
        return items[0] if len(items) == 1 else And(tuple(items))

    def factor(self) -> Expr:
        if self.peek() == "NOT":
            self.at += 1
            return Not(self.factor())
        return self.primary()

    def primary(self) -> Expr:
        if self.is_mark("("):
            self.at += 1
            out = self.expr()
            self.mark(")")
            return out
        name = self.next("word", "text")
        if self.peek() == "op":
            op = self.next("op")
            return Compare(self.field(name), "eq" if op in ("=", "==") else "ne", self.next("word", "text"))
        if self.is_mark("("):
            return self.call(name.lower())
        raise DslError(f"expected an operator or '(' after {name!r}")

    def call(self, function: str) -> Expr:
        self.mark("(")
        args = []
        if not self.is_mark(")"):
            args.append(self.next("word", "text"))
            while self.is_mark(","):
                self.at += 1
                args.append(self.next("word", "text"))
        self.mark(")")
        if function not in ARITY:
            raise DslError(f"unknown function {function!r}")
        if len(args) != ARITY[function]:
            raise DslError(f"{function}() takes {ARITY[function]} arguments, not {len(args)}")
        if function == "raw_contains":
            return RawContains(args[0])
        if function == "cidr_match":
            try:
                parse_cidr(args[1])
            except EngineError as e:
                raise DslError(str(e)) from None
        return Compare(self.field(args[0]), function, *args[1:])


def parse(text: str, fields: Collection[str] | None = None) -> Query:
    return Parser(text, fields).query()
