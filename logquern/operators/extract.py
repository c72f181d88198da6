"""Field extraction: regular expressions with named groups over parsed records, in order.

Captures fill only empty fields, so an earlier pattern wins; `set` writes over. A later rule sees what earlier ones found.
Rules are compiled to one expression of the fields map for each application, so that a line meets only its own rules.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EngineError
from .parsers import computed, remembered

ENVELOPE = ("facility", "severity", "timestamp", "hostname", "app_name", "proc_id", "msg_id", "message")


@dataclass
class ExtractRule:
    when: dict[str, str] = field(default_factory=dict)
    patterns: list[str] = field(default_factory=list)
    set: dict[str, str] = field(default_factory=dict)
    source: str = "message"
    force_severity: bool = False


def translate(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern without names for its groups, and the number of each name: Java allows no underscore in names."""
    names: dict[str, int] = {}
    number = 0

    def bare(m: re.Match) -> str:
        nonlocal number
        if m[0].startswith("\\"):
            return m[0]
        if m[1] is not None:
            number += 1
            names[m[1]] = number
            return "("
        if m[0] == "(":
            number += 1
        return m[0]

    out = re.sub(r"\\.|\(\?P?<([A-Za-z_]\w*)>|\(\?|\(", bare, pattern)
    try:
        re.compile(re.sub(r"\(\?P?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern))
    except re.error as e:
        raise EngineError(f"bad pattern {pattern!r}: {e}") from None
    return out, names


def resolve(name: str) -> Column:
    if name in ("_source_type", "source"):
        return F.col("_source_type")
    if name in ("_raw", "_format"):
        return F.col(name)
    return F.col(f"_head_{name}") if name in ENVELOPE else F.get(F.array(F.col("_fields")[name]), F.lit(0))


def _without(fields: Column, names: list[str]) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


def produced(rule: ExtractRule) -> set[str]:
    return set(rule.set) | {n for p in rule.patterns for n in NAMES.findall(p)}


NAMES = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


def disjoint(a: ExtractRule, b: ExtractRule) -> bool:
    """Whether no record meets both: they ask for different values of the same name of the envelope."""
    return any(n in ENVELOPE and n in b.when and b.when[n] != v for n, v in a.when.items())


def levels(rules: list[ExtractRule]) -> list[list[ExtractRule]]:
    """Rules by steps: a rule stands in a later step than those whose findings it reads; in a step, in their order."""
    at: list[int] = []
    for i, rule in enumerate(rules):
        reads = {*rule.when, rule.source, *(n for p in rule.patterns for n in NAMES.findall(p))}
        own = 0
        for k, before in enumerate(rules[:i]):
            if not disjoint(before, rule):
                if produced(before) & reads:
                    own = max(own, at[k] + 1)
                elif produced(before) & produced(rule):
                    own = max(own, at[k])
        at.append(own)
    return [[r for r, k in zip(rules, at) if k == step] for step in range(max(at, default=-1) + 1)]


def _step(rules: list[ExtractRule]) -> Column:
    """_fields after rules of one step, none of which reads what another one finds."""
    new: dict[str, list[Column]] = {}
    written: dict[str, list[Column]] = {}
    for rule in rules:
        hit = F.lit(True)
        for name, value in rule.when.items():
            hit &= F.coalesce(resolve(name) == value, F.lit(False))
        for pattern in rule.patterns:
            try:
                java, names = translate(pattern)
            except EngineError:
                continue
            text = resolve(rule.source)
            for name, i in names.items():
                new.setdefault(name, []).append(F.when(hit & text.rlike(java), F.nullif(F.regexp_extract(text, java, i), F.lit(""))))
        for name, value in rule.set.items():
            written.setdefault(name, []).insert(0, F.when(hit, F.lit(value)))
    names = [*dict.fromkeys([*new, *written])]
    if not names:
        return F.col("_fields")
    before = lambda n: F.get(F.array(F.col("_fields")[n]), F.lit(0))
    value = lambda n: F.coalesce(*written.get(n, []), F.nullif(before(n), F.lit("")), *new.get(n, []), before(n))
    added = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), value(n))]), lambda _, v: v.isNotNull())
    return F.map_concat(_without(F.col("_fields"), names), added)


@remembered
def _steps(key: str) -> list[tuple[str, Column]]:
    """The columns that rules (as text, to be a key) compute one after the other."""
    rules = [ExtractRule(**r) for r in json.loads(key)]
    every = lambda r: reduce(lambda x, y: x & y, [F.coalesce(resolve(n) == v, F.lit(False)) for n, v in r.when.items()], F.lit(True))
    out = []
    for step in levels(rules):
        if forced := [every(r) for r in step if r.force_severity]:
            out.append(("force_severity", F.col("force_severity") | reduce(lambda x, y: x | y, forced)))
        changed = F.when(F.lit(False), F.col("_fields"))
        for app in dict.fromkeys(r.when["app_name"] for r in step if "app_name" in r.when):
            own = [replace(r, when={k: v for k, v in r.when.items() if k != "app_name"}) for r in step if r.when.get("app_name", app) == app]
            changed = changed.when(resolve("app_name") == app, _step(own))
        out.append(("_fields", changed.otherwise(_step([r for r in step if "app_name" not in r.when]))))
    return out


def apply(df: DataFrame, rules: list[ExtractRule]) -> DataFrame:
    """df (with parsed, _source_type) with what rules find put into parsed.fields, and the flag force_severity. Rules
    whose pattern can't be read are left out. A step of rules is one expression, which a record's application picks its
    own part of."""
    columns, heads = [n for n in df.columns if n != "parsed"], ("format", *ENVELOPE)
    df = df.select(*columns, F.col("parsed.fields").alias("_fields"), *[F.col(f"parsed.{n}").alias(f"_head_{n}") for n in heads], F.lit(False).alias("force_severity"))
    for name, value in _steps(json.dumps([asdict(r) for r in rules])):
        df = computed(df, name, value)
    return df.select(*columns, "force_severity", F.struct(*[F.col(f"_head_{n}").alias(n) for n in heads], F.col("_fields").alias("fields")).alias("parsed"))


def shipped() -> list[ExtractRule]:
    """The standard rules: what applications write, and the event types that it tells."""
    ip, out = r"(?P<src_ip>\d+\.\d+\.\d+\.\d+|[0-9A-Fa-f:]+)", []

    def app(name: str, *patterns: str) -> None:
        out.append(ExtractRule({"app_name": name}, list(patterns)))

    def kinds(name: str, key: str, table: dict[str, str], severity: str = "") -> None:
        for value, kind in table.items():
            out.append(ExtractRule({"app_name": name, key: value}, [], {"event_type": kind} | ({"severity": severity} if severity else {}), force_severity=bool(severity)))

    app("sshd", rf"(?P<auth_action>Accepted|Failed) (?P<auth_method>\S+) for (?:invalid user )?(?P<username>\S*) from {ip} port (?P<src_port>\d+)(?: ssh2: (?P<key_type>\S+) (?P<key_fingerprint>\S+))?", r"session (?P<session_action>opened|closed) for user (?P<username>[^\s(]+)", rf"(?P<sshd_invalid>Invalid user) (?P<username>\S*) from {ip}(?: port (?P<src_port>\d+))?", rf"(?P<sshd_event>Did not receive identification string) from {ip}(?: port (?P<src_port>\d+))?", rf"Connection (?P<conn_action>closed|reset) by (?:authenticating user |invalid user )?(?:(?P<username>\S+) )?{ip} port (?P<src_port>\d+)", rf"(?P<ssh_disconnected>Received disconnect|Disconnected) from (?:user (?P<username>\S+) |authenticating user \S+ )?{ip} port (?P<src_port>\d+)", r"(?P<auth_action>Timeout) before authentication")
    kinds("sshd", "auth_action", {"Timeout": "ssh_auth_timeout", "Failed": "ssh_auth_failure", "Accepted": "ssh_auth_success"})
    kinds("sshd", "session_action", {"opened": "ssh_session_open", "closed": "ssh_session_close"})
    kinds("sshd", "conn_action", {"closed": "ssh_conn_closed", "reset": "ssh_conn_reset"})
    kinds("sshd", "sshd_invalid", {"Invalid user": "ssh_invalid_user"})
    kinds("sshd", "sshd_event", {"Did not receive identification string": "ssh_scanner"})
    kinds("sshd", "ssh_disconnected", {"Received disconnect": "ssh_disconnect", "Disconnected": "ssh_disconnect"})
    app("kernel", r"\[UFW (?P<ufw_action>[A-Z]+)\]", r"IN=(?P<in_iface>\S+)", r"SRC=(?P<src_ip>\S+)", r"DST=(?P<dst_ip>\S+)", r"PROTO=(?P<protocol>\S+)", r"SPT=(?P<src_port>\d+)", r"DPT=(?P<dst_port>\d+)", r"TTL=(?P<ttl>\d+)", r"LEN=(?P<pkt_len>\d+)")
    kinds("kernel", "ufw_action", {"BLOCK": "firewall_block", "ALLOW": "firewall_allow", "AUDIT": "firewall_audit"})
    app("sudo", r"^\s*(?P<username>\S+) : .*?TTY=(?P<tty>\S+) ; PWD=(?P<pwd>\S+) ; USER=(?P<target_user>\S+) ; (?P<sudo_action>COMMAND)=(?P<command>.*)$", r"(?P<sudo_event>authentication failure)", r"session (?P<session_action>opened|closed) for user (?P<target_user>[^\s(]+)")
    kinds("sudo", "sudo_action", {"COMMAND": "sudo_command"})
    kinds("sudo", "sudo_event", {"authentication failure": "sudo_auth_failure"})
    kinds("sudo", "session_action", {"opened": "sudo_session_open", "closed": "sudo_session_close"})
    app("systemd", r"^(?P<action>Started|Starting|Stopped|Stopping) (?P<unit>\S+)", r"^(?P<action>Failed) to start (?P<unit>\S+)", r"^(?:Started|Starting) (?P<systemd_session>Session) (?P<session_id>\S+) of [Uu]ser (?P<username>\S+?)\.?$")
    kinds("systemd", "action", {"Started": "unit_started", "Starting": "unit_starting", "Stopped": "unit_stopped", "Stopping": "unit_stopping", "Failed": "unit_failed"})
    kinds("systemd", "systemd_session", {"Session": "session_start"})
    kinds("filterlog", "action", {"BLOCK": "firewall_block", "ALLOW": "firewall_allow"})
    app("openvpn", r"(?P<openvpn_tls>TLS Error|AUTH_FAILED)", r"(?P<openvpn_restart>SIGUSR1|process restarting)", r"(?P<openvpn_link>UDPv4|TCPv4|UDPv6) link", r"(?P<openvpn_timeout>Inactivity timeout)", r"\[AF_INET\](?P<src_ip>[\d.]+):(?P<src_port>\d+)")
    kinds("openvpn", "openvpn_tls", {"TLS Error": "vpn_tls_error", "AUTH_FAILED": "vpn_auth_failure"})
    kinds("openvpn", "openvpn_restart", {"SIGUSR1": "vpn_restart", "process restarting": "vpn_restart"})
    kinds("openvpn", "openvpn_link", {"UDPv4": "vpn_link_up", "TCPv4": "vpn_link_up"})
    kinds("openvpn", "openvpn_timeout", {"Inactivity timeout": "vpn_timeout"})
    app("php-fpm", r"(?P<pfsense_page>/\S+\.php): (?P<pfsense_change>Configuration Change): (?P<admin_user>[^@\s]+)@(?P<src_ip>\d+\.\d+\.\d+\.\d+)", r"(?P<pfsense_page>/\S+\.php): (?P<pfsense_login>Successful login) for user '(?P<admin_user>[^']+)' from: (?P<src_ip>[\d.]+)")
    kinds("php-fpm", "pfsense_change", {"Configuration Change": "pfsense_config_change"})
    kinds("php-fpm", "pfsense_login", {"Successful login": "pfsense_admin_login"}, "notice")
    app("haproxy", r"^(?:Connect from )?(?P<src_ip>[\d.]+):(?P<src_port>\d+)", r"\] (?P<frontend>\S+?)/\S+: (?P<haproxy_tls>SSL handshake failure)", r"\] (?P<frontend>[^\s/]+) (?P<backend>[^\s/]+)/", r'"(?P<http_method>[A-Z]+) (?P<http_uri>\S+)')
    kinds("haproxy", "haproxy_tls", {"SSL handshake failure": "tls_handshake_failure"}, "warning")
    app("cron", r"^\((?P<cron_user>[^)]+)\) (?P<cron_action>CMD) \((?P<command>.*)\)\s*$")
    kinds("cron", "cron_action", {"CMD": "cron_exec"})
    app("systemd-logind", r"^(?P<logind_new>New session) '?(?P<session_id>[^\s']+)'? of user '?(?P<username>[^\s'.]+)'?(?: with class '(?P<session_class>[^']+)' and type '(?P<session_type>[^']+)')?", r"^Session (?P<session_id>\S+) (?P<logind_out>logged out)", r"^(?P<logind_removed>Removed session) (?P<session_id>[^\s.]+)")
    kinds("systemd-logind", "logind_new", {"New session": "session_new"})
    kinds("systemd-logind", "logind_out", {"logged out": "session_logout"})
    kinds("systemd-logind", "logind_removed", {"Removed session": "session_removed"})
    app("unix_chkpwd", r"(?P<chkpwd_result>password check failed) for user \((?P<username>[^)]+)\)")
    kinds("unix_chkpwd", "chkpwd_result", {"password check failed": "local_auth_failure"}, "warning")
    app("suricata", r"\[(?P<gid>\d+):(?P<sid>\d+):(?P<rev>\d+)\] (?P<alert_msg>.*?) \[Classification: (?P<classification>[^\]]*)\] \[Priority: (?P<priority>\d+)\] \{(?P<protocol>\w+)\} (?P<src_ip>[\d.]+):(?P<src_port>\d+) -> (?P<dst_ip>[\d.]+):(?P<dst_port>\d+)")
    kinds("suricata", "gid", {"1": "ids_alert"})
    return out
