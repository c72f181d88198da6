"""Detection rules: selections of fields, a condition over them, and their compilation to one projection.

A rule is a mapping with id, title, level, logsource and detection (named selections and a condition). In a selection all
fields must match; a key may carry a modifier (contains: without case, startswith and endswith: with case). The condition
joins names of selections, `1 of them` and `1 of prefix*` with and, or, not and parentheses. `keywords` is a list of
strings of which one must occur anywhere in the record, without case.

strict (the default) rejects what the lenient dialect silently misreads: list values (there dropped, so that an all-list
selection matches everything), unknown modifiers (there a field of that name) and unknown selections (there false).
"""

from __future__ import annotations

import fnmatch
import re
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EngineError

MODIFIERS = ("contains", "startswith", "endswith")
#: Predicates of one projection; more are spread over several, to keep generated methods small.
PER_PROJECTION = 50


@dataclass
class Rule:
    id: str
    title: str
    level: str
    condition: tuple
    selections: dict[str, list[tuple[str, str, object]]] = field(default_factory=dict)
    keywords: list[str] = field(default_factory=list)
    logsource: dict[str, str] = field(default_factory=dict)


def load_rule(spec: dict, strict: bool = True) -> Rule | None:
    """None for rules that are incomplete or deprecated."""
    detection = spec.get("detection") or {}
    if spec.get("status") == "deprecated" or not spec.get("id") or not spec.get("title") or not isinstance(detection.get("condition"), str):
        return None
    selections: dict[str, list[tuple[str, str, object]]] = {}
    keywords: list[str] = []
    for name, body in detection.items():
        if name == "condition":
            continue
        if name == "keywords":
            keywords = [str(k) for k in body]
            continue
        if not isinstance(body, dict):
            if strict:
                raise EngineError(f"rule {spec['id']}: selection {name} is no mapping")
            continue
        tests = []
        for key, value in body.items():
            base, _, modifier = key.partition("|")
            if modifier and modifier not in MODIFIERS:
                if strict:
                    raise EngineError(f"rule {spec['id']}: unknown modifier {modifier}")
                base, modifier = key, ""
            if isinstance(value, list | dict):
                if strict:
                    raise EngineError(f"rule {spec['id']}: {key} has a nested value")
                continue
            tests.append((base, modifier or "equals", value))
        selections[name] = tests
    names = [*selections, *(["keywords"] if keywords else [])]
    text = detection["condition"].strip()
    if not strict and text.startswith("1 of "):  # the lenient dialect takes all that follows for one glob
        glob = text[5:].strip()
        condition = ("any", [n for n in selections if glob == "them" or fnmatch.fnmatchcase(n, glob)])
    else:
        condition = Condition(text, names, strict).parse()
    source = {k: str(v) for k, v in (spec.get("logsource") or {}).items() if k in ("service", "product", "category") and v}
    return Rule(str(spec["id"]), str(spec["title"]), str(spec.get("level", "")), condition, selections, keywords, source)


def rule_files(folder: str | Path) -> list[Path]:
    return sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yml", ".yaml"))


def read_rule(path: str | Path, strict: bool = True) -> Rule | None:
    import yaml

    try:
        spec = yaml.safe_load(Path(path).read_text())
    except yaml.YAMLError as e:
        raise EngineError(f"{path}: {e}") from None
    return load_rule(spec, strict) if isinstance(spec, dict) else None


def load_rules(folder: str | Path, strict: bool = True) -> list[Rule]:
    """The rules of all *.yml and *.yaml files below a folder. A file that can't be read is left out with a warning."""
    found = []
    for path in rule_files(folder):
        try:
            rule = read_rule(path, strict)
        except EngineError as e:
            warnings.warn(f"rule left out: {e}", stacklevel=2)
            continue
        if rule is not None:
            found.append(rule)
    return found


class Condition:
    """Recursive descent over or, and, not, parentheses, names and `1 of`. A tree of ("or"|"and", items), ("not", item),
    ("ref", name) and ("any", names)."""

    def __init__(self, text: str, names: Iterable[str], strict: bool):
        self.left = re.findall(r"[()]|[^\s()]+", text)
        self.names, self.strict = list(names), strict

    def parse(self) -> tuple:
        out = self.some("or", lambda: self.some("and", self.factor))
        if self.left:
            raise EngineError(f"condition goes on with {self.left[0]!r}")
        return out

    def some(self, word: str, part: Callable[[], tuple]) -> tuple:
        items = [part()]
        while self.left and self.left[0].lower() == word:
            self.left.pop(0)
            items.append(part())
        return items[0] if len(items) == 1 else (word, items)

    def factor(self) -> tuple:
        if not self.left:
            raise EngineError("condition ends early")
        word = self.left.pop(0)
        if word.lower() == "not":
            return ("not", self.factor())
        if word == "(":
            out = self.some("or", lambda: self.some("and", self.factor))
            if not self.left or self.left.pop(0) != ")":
                raise EngineError("condition lacks a ')'")
            return out
        if word == "1" and self.left[:1] == ["of"]:
            self.left.pop(0)
            glob = self.left.pop(0) if self.left else ""
            own = [n for n in self.names if n != "keywords"]
            return ("any", own if glob == "them" else [n for n in own if fnmatch.fnmatchcase(n, glob)])
        if self.strict and word not in self.names:
            raise EngineError(f"condition names an unknown selection {word!r}")
        return ("ref", word)


def test(column: Column, kind: str, value: object) -> Column:
    text = ("true" if value else "false") if isinstance(value, bool) else str(value)
    match kind:
        case "equals":
            out = column == text
        case "contains":
            out = F.lower(column).contains(text.lower())
        case "startswith":
            out = column.startswith(text)
        case _:
            out = column.endswith(text)
    return F.coalesce(out, F.lit(False))


def compile_rule(rule: Rule, resolve: Callable[[str], Column], line: Column) -> Column:
    """Never null. The cheap test of the source comes first."""
    every = lambda columns: reduce(lambda a, b: a & b, columns, F.lit(True))
    some = lambda columns: reduce(lambda a, b: a | b, columns, F.lit(False))

    def selection(name: str) -> Column:
        if name == "keywords" and rule.keywords:
            return some([F.coalesce(F.lower(line).contains(k.lower()), F.lit(False)) for k in rule.keywords])
        return every([test(resolve(f), kind, value) for f, kind, value in rule.selections[name]]) if name in rule.selections else F.lit(False)

    def go(node: tuple) -> Column:
        match node:
            case ("ref", name):
                return selection(name)
            case ("any", names):
                return some([selection(n) for n in names])
            case ("not", item):
                return ~go(item)
            case (word, items):
                return every(map(go, items)) if word == "and" else some(map(go, items))
        raise TypeError(node)

    source = every([F.coalesce(resolve("_source_type").contains(v), F.lit(False)) for v in rule.logsource.values()])
    return source & go(rule.condition)


def match_rules(events: DataFrame, rules: list[Rule], resolve: Callable[[str], Column], line: Column, suppressed: Callable[[str], Column] | None = None) -> DataFrame:
    """A row for each event and rule that matches, in the order of rules: all columns of events and rule_id, rule_title,
    level. One pass over the events, whatever the number of rules."""
    hits = []
    for i in range(0, len(rules), PER_PROJECTION):
        cells = []
        for rule in rules[i : i + PER_PROJECTION]:
            hit = compile_rule(rule, resolve, line)
            if suppressed is not None:
                hit &= ~suppressed(rule.id)
            cells.append(F.when(hit, F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.title).alias("rule_title"), F.lit(rule.level).alias("level"))))
        hits.append(F.filter(F.array(*cells), lambda x: x.isNotNull()))
    if not hits:
        return events.limit(0).select("*", *[F.lit(None).cast("string").alias(n) for n in ("rule_id", "rule_title", "level")])
    names = events.columns
    for k, cell in enumerate(hits):
        events = events.withColumn(f"_hits{k}", cell)
    every = F.concat(*[F.col(f"_hits{k}") for k in range(len(hits))])
    return events.withColumn("_hit", F.explode(every)).select(*names, "_hit.*")


def shipped(strict: bool = True) -> list[Rule]:
    """The standard pack."""
    return [load_rule(s, strict) for s in PACK]


def _pack() -> list[dict]:
    def rule(number: int, name: str, title: str, level: str, service: str, detection: dict) -> dict:
        source = {"service": service} if service else {}
        return {"id": f"{number}-{name}", "title": title, "level": level, "logsource": source, "detection": detection}

    def of_type(source: str, kind: str, **more: str) -> dict:
        return {"selection": {"_source_type": source, "event_type": kind, **more}}

    def only(source: str, kind: str) -> dict:
        return of_type(source, kind) | {"condition": "selection"}

    # What the rules of the standard pack look for, each in its rule's own order.
    cron = {
        "s_wget": {"command|contains": "wget "},
        "s_curl": {"command|contains": "curl "},
        "s_revshell": {"command|contains": "bash -i"},
        "s_devtcp": {"command|contains": "/dev/tcp/"},
        "s_nc": {"command|contains": "nc -"},
        "s_pipe_sh": {"command|contains": "| sh"},
        "s_pipe_bash": {"command|contains": "| bash"},
        "s_python_c": {"command|contains": "python -c"},
        "s_base64": {"command|contains": "base64 -d"},
    }
    sudo = {
        "p_bash": {"command|contains": "/bash"},
        "p_sh": {"command|endswith": "/sh"},
        "p_dash": {"command|contains": "/dash"},
        "p_zsh": {"command|contains": "/zsh"},
        "p_su": {"command|contains": "/su"},
        "p_passwd": {"command|contains": "/passwd"},
        "p_visudo": {"command|contains": "visudo"},
        "p_useradd": {"command|contains": "useradd"},
    }
    prompts = [
        "ignore all previous instructions",
        "ignore previous instructions",
        "disregard all previous instructions",
        "system override",
        "administrator directive",
        "disregard all open tickets",
        "soc-notify",
        "siemctl retention",
    ]
    inside = {"filter": {"src_ip|startswith": "10.0."}, "condition": "selection and not filter"}
    fields = {"selection_sshd": {"_source_type": "sshd"}, "selection_cron": {"_source_type": "cron"}, "keywords": prompts, "condition": "(selection_sshd or selection_cron) and keywords"}
    connect = {"selection": {"_source_type": "haproxy", "message|startswith": "Connect from "}, "condition": "selection"}
    return [
        rule(1001, "ssh-brute-force", "SSH Brute Force Detection", "medium", "sshd", only("sshd", "ssh_auth_failure")),
        rule(1002, "sudo-execution", "Sudo Execution Monitoring", "low", "sudo", only("sudo", "sudo_command")),
        rule(1003, "iptables-deny", "IPTables Firewall Deny", "low", "iptables", only("iptables", "firewall_block")),
        rule(1004, "suspicious-ssh", "Suspicious Internal SSH from External IP", "high", "sshd", of_type("sshd", "ssh_auth_failure") | inside),
        rule(1005, "ssh-login-success", "SSH Login Success", "info", "sshd", only("sshd", "ssh_auth_success")),
        rule(1006, "cron-suspicious-command", "Suspicious Cron Command", "high", "cron", of_type("cron", "cron_exec") | cron | {"condition": "selection and 1 of s_*"}),
        rule(1007, "haproxy-tls-probe", "Unauthorized TLS Probe of Reverse Proxy", "medium", "haproxy", only("haproxy", "tls_handshake_failure")),
        rule(1008, "sudo-privilege-escalation", "Sudo Root Shell or Sensitive Binary", "high", "sudo", of_type("sudo", "sudo_command", target_user="root") | sudo | {"condition": "selection and 1 of p_*"}),
        rule(1009, "firewall-port-scan", "Firewall Block (filterlog)", "low", "filterlog", only("filterlog", "firewall_block")),
        rule(1010, "local-auth-failure", "Local Authentication Failure", "medium", "unix_chkpwd", only("unix_chkpwd", "local_auth_failure")),
        rule(1011, "prompt-injection-log-fields", "Prompt-Injection-Shaped Content in Log Fields", "high", "", fields),
        rule(1012, "haproxy-connect-volume", "HAProxy Connect Volume (correlation signal)", "low", "haproxy", connect),
    ]


PACK = _pack()
