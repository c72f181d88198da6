"""Parsers of single log lines, as native expressions; only nested JSON, XML and YAML use Python, in one call for each line
that is null for lines of other formats.

`parse` tries, after override rules: RFC 5424 and RFC 3164 behind a priority, JSON object, JSON array, CEF, LEEF, RFC 3164
without priority, logfmt, CSV, XML, YAML, plain text. Each parser is a pair: does it accept a line, and the record. What
follows a syslog header may be parsed once more (CEF, LEEF, JSON). `parse` computes a line's format once, then the groups
of that format's one pattern, then the record, each as a column that the next step refers to: so a line meets its own
format only, and the plan stays small.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..functions.codes import cef_severity, facility_of_priority, leef_severity, severity_of_priority, severity_of_word

HEAD = ("facility", "severity", "timestamp", "hostname", "app_name", "proc_id", "msg_id", "message")
SCHEMA = "struct<format:string," + ",".join(f"{n}:string" for n in HEAD) + ",fields:map<string,string>>"
ISO = r"\d{4}-\d\d-\d\dT[^ ]+"
BSD = r"[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d"

Parser = tuple[Column, Column]
TEXTS = MapType(StringType(), StringType())  # no DDL text: workers import this module without a session


def no_fields() -> Column:
    return F.create_map().cast("map<string,string>")


def record(format: str | Column, fields: Column | None = None, **head: Column | None) -> Column:
    cells = [(F.lit(format) if isinstance(format, str) else format).alias("format"), *[(head.get(n) if head.get(n) is not None else F.lit(None)).cast("string").alias(n) for n in HEAD], (fields if fields is not None else no_fields()).alias("fields")]
    return F.struct(*cells).cast(SCHEMA)


def group(column: Column, pattern: str, i: int = 1) -> Column:
    """The i-th group, null where the pattern doesn't match or the group is empty."""
    return F.when(column.rlike(pattern), F.nullif(F.regexp_extract(column, pattern, i), F.lit("")))


def pairs(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def first_of(fields: Column, *names: str) -> Column:
    return F.coalesce(*[F.get(F.array(fields[n]), F.lit(0)) for n in names])


def unescape(column: Column, chars: str) -> Column:
    return F.regexp_replace(column, rf"\\([{re.escape(chars)}])", "$1")


def groups(column: Column, pattern: str, n: int) -> Column:
    """The first n groups of a pattern, null where one is empty."""
    return F.array(*[F.nullif(F.regexp_extract(column, pattern, i), F.lit("")) for i in range(1, n + 1)])


def at(found: Column, i: int) -> Column:
    return F.get(found, F.lit(i - 1))


RFC5424 = r"(?s)^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: ?(.*))?$"


def is_rfc5424(raw: Column) -> Column:
    return raw.rlike(RFC5424) & F.coalesce(F.regexp_extract(raw, RFC5424, 1).try_cast("int") < 256, F.lit(False))


def rfc5424_record(found: Column) -> Column:
    get = lambda i: F.nullif(at(found, i), F.lit("-"))
    priority = at(found, 1).try_cast("int")
    item = r'([^\s="\]]+)="((?:[^"\\]|\\.)*)"'
    sd = F.coalesce(get(7), F.lit(""))
    fields = pairs(F.regexp_extract_all(sd, F.lit(item), 1), F.transform(F.regexp_extract_all(sd, F.lit(item), 2), lambda v: unescape(v, '"\\]')))
    message = F.regexp_replace(F.coalesce(at(found, 8), F.lit("")), "^\ufeff", "")
    return record("rfc5424", fields, facility=facility_of_priority(priority), severity=severity_of_priority(priority), timestamp=get(2), hostname=get(3), app_name=get(4), proc_id=get(5), msg_id=get(6), message=message)


def rfc5424(raw: Column) -> Parser:
    return is_rfc5424(raw), rfc5424_record(groups(raw, RFC5424, 8))


def rfc3164_pattern(priority: bool | None = None) -> str:
    """priority: whether one must, must not, or (None) may stand in front."""
    lead = {True: r"<(\d{1,3})>", False: "()", None: r"(?:<(\d{1,3})>)?"}[priority]
    return rf"(?s)^{lead}({BSD}|{ISO}) (\S+) (?:([^\s\[\]:]+)(?:\[([^\]\s]*)\])?: ?)?(.*)$"


def rfc3164_record(found: Column) -> Column:
    number = at(found, 1).try_cast("int")
    return record("rfc3164", facility=facility_of_priority(number), severity=severity_of_priority(number), timestamp=at(found, 2), hostname=at(found, 3), app_name=at(found, 4), proc_id=at(found, 5), message=F.coalesce(at(found, 6), F.lit("")))


def rfc3164(raw: Column, priority: bool | None = None) -> Parser:
    pattern = rfc3164_pattern(priority)
    return raw.rlike(pattern), rfc3164_record(groups(raw, pattern, 6))


def flatten(value: object, path: str = "", out: dict | None = None) -> dict[str, str]:
    """Objects by dotted path; arrays stay as JSON text, null is left out."""
    out = {} if out is None else out
    if isinstance(value, dict):
        for k, v in value.items():
            flatten(v, f"{path}.{k}" if path else str(k), out)
    elif value is not None:
        out[path] = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return out


def _flat_json(text: str | None) -> dict | None:
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    if isinstance(found, list):
        out: dict[str, str] = {}
        for i, v in enumerate(found):
            flatten(v, str(i), out)
        return out
    return flatten(found) if isinstance(found, dict) else None


def _flat_xml(text: str | None) -> dict | None:
    from xml.etree import ElementTree

    if not text or "<!DOCTYPE" in text or "<!ENTITY" in text:  # entities of its own are refused
        return None
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None
    out: dict[str, str] = {}

    def walk(node, path: str) -> None:
        for k, v in node.attrib.items():
            out[f"{path}.@{k}"] = v
        if node.text and node.text.strip():
            out[path] = node.text.strip()
        for child in node:
            walk(child, f"{path}.{child.tag}")

    walk(root, root.tag)
    return out


def _flat_yaml(text: str | None) -> dict | None:
    out, item = {}, 0
    for line in (text or "").splitlines():
        if m := re.match(r"^\s*([A-Za-z_][\w.-]*):\s+(.*)$", line):
            out[m[1]] = m[2].strip().strip("\"'")
        elif m := re.match(r"^\s*-\s+(.*)$", line):
            out[f"[{item}]"] = m[1].strip()
            item += 1
    return out or None


YAML_LINE = r"(?m)^(---|\s*[A-Za-z_][\w.-]*: .+|- .+)$"
YAML_KEY = r"^\s*[a-z_][\w.-]*: .+$"


def _nested(text: str | None) -> dict | None:
    """The flat fields of a line whose format has nested values; its name stands under the empty key."""
    if not text:
        return None
    for name, lead, parser in (("json", r"\{", _flat_json), ("json_array", r"\[", _flat_json), ("xml", "<[A-Za-z?]", _flat_xml), ("yaml", "", _flat_yaml)):
        if re.match(lead, text) and (name != "yaml" or _looks_yaml(text)) and (found := parser(text)) is not None:
            return found | {"": name}
    return None


def _looks_yaml(text: str) -> bool:
    return bool(re.search(YAML_LINE, text) and ("\n" in text or re.search(YAML_KEY, text)))


nested = F.udf(_nested, TEXTS, useArrow=True)
flat_json = F.udf(_flat_json, TEXTS, useArrow=True)
flat_xml = F.udf(_flat_xml, TEXTS, useArrow=True)
flat_yaml = F.udf(_flat_yaml, TEXTS, useArrow=True)


def _described(format: str | Column, fields: Column, message: Column | None = None) -> Column:
    """A record of a format whose keys say what they are."""
    return record(
        format, fields, message=message if message is not None else first_of(fields, "message", "msg", "text"), timestamp=first_of(fields, "timestamp", "time", "@timestamp", "ts"), hostname=first_of(fields, "hostname", "host"),
        app_name=first_of(fields, "app_name", "appname", "application", "app", "service", "caller"), proc_id=first_of(fields, "pid", "proc_id"), severity=severity_of_word(first_of(fields, "severity", "level")),
    )


def json_object(raw: Column, nested: bool = True) -> Parser:
    """nested=False: one level, native; inner objects stay as text."""
    # A copy of a guard before the function keeps Python from lines of other formats.
    guarded = F.when(raw.startswith("{"), raw)
    fields = flat_json(guarded) if nested else F.from_json(guarded, "map<string,string>", {"mode": "PERMISSIVE"})
    return raw.startswith("{") & fields.isNotNull(), _described("json", fields)


def json_array_record(text: Column, fields: Column) -> Column:
    return record("json_array", fields, message=F.concat(F.json_array_length(text).cast("string"), F.lit(" JSON array elements")))


def json_array(raw: Column) -> Parser:
    guarded = F.when(raw.startswith("["), raw)
    fields = flat_json(guarded)
    return raw.startswith("[") & fields.isNotNull(), json_array_record(guarded, fields)


_BAR = r"((?:[^|\\]|\\.)*)"
CEF = rf"(?s)^CEF:(\d+)\|{_BAR}\|{_BAR}\|{_BAR}\|{_BAR}\|{_BAR}\|{_BAR}\|(.*)$"


def cef_record(found: Column) -> Column:
    get = lambda i: unescape(F.coalesce(at(found, i), F.lit("")), "|\\")
    rest = F.coalesce(at(found, 8), F.lit(""))
    item = r"([\w.\[\]]+)=((?:[^=\\]|\\.)*?)(?=\s+[\w.\[\]]+=|\s*$)"
    values = F.transform(F.regexp_extract_all(rest, F.lit(item), 2), lambda v: unescape(v, "=\\"))
    head = F.create_map(*[x for k, i in (("version", 1), ("vendor", 2), ("product", 3), ("device_version", 4), ("signature_id", 5), ("name", 6), ("severity", 7)) for x in (F.lit(f"cef.{k}"), get(i))])
    fields = F.map_concat(pairs(F.regexp_extract_all(rest, F.lit(item), 1), values), head)
    return record("cef", fields, severity=cef_severity(get(7)), app_name=get(3), msg_id=get(5), message=F.coalesce(first_of(fields, "msg"), get(6)), timestamp=first_of(fields, "rt", "end"), hostname=first_of(fields, "dhost"))


def cef(raw: Column) -> Parser:
    return raw.rlike(CEF), cef_record(groups(raw, CEF, 8))


LEEF = r"(?s)^LEEF:([12])(?:\.0)?\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"


def leef_record(found: Column) -> Column:
    get = lambda i: F.coalesce(at(found, i), F.lit(""))
    rest = get(6)
    named = r"(?s)^(x[0-9A-Fa-f]{2}|0x[0-9A-Fa-f]{2}|[^|=])\|(.*)$"
    second = (get(1) == "2") & rest.rlike(named)
    own = F.regexp_extract(rest, named, 1)
    mark = F.when(second, F.when(own.rlike("^0?x[0-9A-Fa-f]{2}$"), F.char(F.conv(F.regexp_extract(own, "x(..)$", 1), 16, 10).cast("long"))).otherwise(own)).otherwise("\t")
    attrs = F.when(second, F.regexp_extract(rest, named, 2)).otherwise(rest)
    spaced = r"([\w.-]+)=(.*?)(?=\s+[\w.-]+=|\s*$)"
    items = F.filter(F.split(attrs, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E"))), lambda x: x.contains("="))
    by_mark = pairs(F.transform(items, lambda x: F.trim(F.substring_index(x, "=", 1))), F.transform(items, lambda x: F.regexp_replace(x, "^[^=]*=", "")))
    by_space = pairs(F.regexp_extract_all(attrs, F.lit(spaced), 1), F.regexp_extract_all(attrs, F.lit(spaced), 2))
    fields = F.when(attrs.contains(mark), by_mark).otherwise(by_space)
    return record("leef", fields, severity=F.when(first_of(fields, "sev").isNotNull(), leef_severity(first_of(fields, "sev"))), app_name=get(3), msg_id=get(5), message=F.coalesce(first_of(fields, "msg", "message"), get(5)), timestamp=first_of(fields, "devTime"), hostname=first_of(fields, "srcName"))


def leef(raw: Column) -> Parser:
    return raw.rlike(LEEF), leef_record(groups(raw, LEEF, 6))


LOGFMT = r'([A-Za-z_][\w.-]*)=("(?:[^"\\]|\\.)*"|\S*)'


def logfmt_fields(raw: Column) -> Column:
    values = F.transform(F.regexp_extract_all(raw, F.lit(LOGFMT), 2), lambda v: F.when(v.rlike('(?s)^".*"$'), unescape(F.regexp_replace(v, '^"|"$', ""), '"\\')).otherwise(v))
    rest = F.trim(F.regexp_replace(raw, LOGFMT, ""))
    bare = F.regexp_extract_all(rest, F.lit(r"(?<!\S)([A-Za-z_][\w.-]*)(?!\S)"), 1)
    return F.map_concat(pairs(bare, F.transform(bare, lambda _: F.lit("true"))), pairs(F.regexp_extract_all(raw, F.lit(LOGFMT), 1), values))


def is_logfmt(raw: Column) -> Column:
    return F.regexp_count(raw, F.lit(r"(?:^|\s)[A-Za-z_][\w.-]*=")) >= 2


def logfmt(raw: Column) -> Parser:
    return is_logfmt(raw), _described("logfmt", logfmt_fields(raw))


def csv(raw: Column) -> Parser:
    """The separator (comma, tab, bar or semicolon) that occurs most often, twice at least; columns are col_0, col_1, ..."""
    count = lambda ch: F.length(raw) - F.length(F.replace(raw, F.lit(ch), F.lit("")))
    most = F.greatest(*[count(ch) for ch in ",\t|;"])
    mark = F.when(count(",") == most, ",").when(count("\t") == most, "\t").when(count("|") == most, "|").otherwise(";")
    cells = F.regexp_extract_all(F.concat(raw, mark), F.concat(F.lit('("(?:[^"]|"")*"|[^'), F.when(mark == "\t", r"\t").otherwise(mark), F.lit(']*)['), mark, F.lit("]")), 1)
    clean = F.transform(cells, lambda v: F.when(v.rlike('(?s)^".*"$'), F.replace(F.regexp_replace(v, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(v)))
    keys = F.transform(cells, lambda _, i: F.concat(F.lit("col_"), i.cast("string")))
    return most >= 2, record("csv", pairs(keys, clean), message=raw)


def xml_record(raw: Column, fields: Column) -> Column:
    named = F.map_values(F.map_filter(fields, lambda k, _: k.rlike(r"\.(message|msg|text)$")))
    return record("xml", fields, message=F.coalesce(F.get(named, F.lit(0)), F.regexp_extract(raw, r"<([A-Za-z][\w.-]*)", 1)))


def xml(raw: Column) -> Parser:
    fields = flat_xml(F.when(raw.rlike(r"^<[A-Za-z?]"), raw))
    return raw.rlike(r"^<[A-Za-z?]") & fields.isNotNull(), xml_record(raw, fields)


def looks_yaml(raw: Column) -> Column:
    return raw.rlike(YAML_LINE) & (raw.contains("\n") | raw.rlike(YAML_KEY))


def yaml(raw: Column) -> Parser:
    fields = flat_yaml(F.when(looks_yaml(raw), raw))
    return looks_yaml(raw) & fields.isNotNull(), _described("yaml", fields)


def plain(raw: Column) -> Parser:
    return F.lit(True), record("plain", message=F.trim(raw))


def filterlog(message: Column) -> Parser:
    """The firewall's comma-separated record; columns depend on the IP version and protocol."""
    cell = lambda i: F.nullif(F.trim(F.get(F.split(message, ","), F.lit(i))), F.lit(""))
    n, four = F.size(F.split(message, ",")), cell(8) == "4"
    proto, src, dst, ports = ((F.when(four, cell(a)).otherwise(cell(b))) for a, b in ((16, 12), (18, 15), (19, 16), (20, 17)))
    has_ports = F.lower(proto).isin("tcp", "udp") & (n > F.when(four, 21).otherwise(18))
    second = F.when(four, cell(21)).otherwise(cell(18))
    items = [("action", F.when(cell(6) == "pass", "ALLOW").otherwise("BLOCK")), ("direction", cell(7)), ("interface", cell(4)), ("protocol", F.upper(proto)), ("src_ip", src), ("dst_ip", dst), ("src_port", F.when(has_ports, ports)), ("dst_port", F.when(has_ports, second))]
    fields = F.map_filter(F.create_map(*[x for k, v in items for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    ok = cell(6).isin("block", "pass") & cell(8).isin("4", "6") & (n >= F.when(four, 20).otherwise(17))
    return F.coalesce(ok, F.lit(False)), record("filterlog", fields)


PARSERS: dict[str, Callable[[Column], Parser]] = {
    "rfc5424": rfc5424, "rfc3164": rfc3164, "json": json_object, "json_array": json_array, "cef": cef, "leef": leef, "logfmt": logfmt, "csv": csv, "xml": xml, "yaml": yaml, "filterlog": filterlog, "plain": plain,
}


@dataclass
class Override:
    """The first whose conditions all hold decides. source_ip and starts_with are beginnings."""

    source_ip: str = ""
    starts_with: str = ""
    contains: str = ""
    format: str = ""
    source: str = ""
    rename: dict[str, str] = field(default_factory=dict)
    reparse: bool = False
    reparse_as: str = ""

    def when(self, raw: Column, addr: Column) -> Column:
        out = F.lit(True)
        for value, test in ((self.source_ip, addr.startswith), (self.starts_with, raw.startswith), (self.contains, raw.contains)):
            if value:
                out &= test(value)
        return out


def renamed(fields: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_keys(fields, lambda k, _: F.coalesce(F.get(F.array(table[k]), F.lit(0)), k))


# What lines hold whose source the standard overrides name, in their order.
LABELS = (
    ("[UFW ", "iptables"),
    ("pam_unix(proxmox-ve-auth:auth)", "proxmox-ve-auth"),
    ("haproxy: starting old pid:", "haproxy"),
    ("haproxy: started new pid:", "haproxy"),
    ("[Suricata] Suricata LOGS ROTATION", "suricata-logrotate"),
    ("[Suricata] Logs Mgmt job rotated", "suricata-logrotate"),
    ("Unhandled message: interface=org.freedesktop.DBus", "dbus-daemon"),
    ("FW1.homelab.lan nginx", "pfsense-webui"),
    ("kerneloops.service: Referenced but unset environment variable", "kerneloops"),
)


def shipped_overrides() -> list[Override]:
    """The standard overrides: sources that lines name wrongly, and the firewall's record behind its syslog header."""
    found = [Override(contains=text, source=label) for text, label in LABELS]
    return [found[0], Override(contains=" filterlog ", reparse=True, reparse_as="filterlog"), *found[1:]]


def _kind(raw: Column) -> Column:
    """The format of a line by native tests alone; null where only nested formats or plain text are left."""
    with_priority, bare = raw.rlike(rfc3164_pattern(True)), raw.rlike(rfc3164_pattern(False))
    syslog = F.when(is_rfc5424(raw), "rfc5424").when(with_priority, "rfc3164")
    out = F.when(raw.startswith("<"), syslog).when(raw.rlike(CEF), "cef").when(raw.rlike(LEEF), "leef").when(bare, "rfc3164")
    return F.coalesce(out, F.when(is_logfmt(raw), "logfmt").when(csv(raw)[0], "csv"))


def _found(raw: Column, kind: Column) -> Column:
    """The groups of the format's pattern."""
    out = F.when(kind == "rfc5424", groups(raw, RFC5424, 8)).when(kind == "rfc3164", groups(raw, rfc3164_pattern(), 6))
    return out.when(kind == "cef", groups(raw, CEF, 8)).when(kind == "leef", groups(raw, LEEF, 6))


def _syslog(kind: Column) -> Column:
    return F.coalesce(kind.isin("rfc5424", "rfc3164"), F.lit(False))


def _message(kind: Column, found: Column) -> Column:
    """The message behind a syslog header."""
    return F.when(kind == "rfc5424", at(found, 8)).when(kind == "rfc3164", at(found, 6))


def _without_mark(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, _: k != "")


def remembered(make: Callable) -> Callable:
    """make, whose columns are built once for each gateway and arguments: building them costs thousands of calls."""
    known: dict[tuple, object] = {}

    def of(*key):
        place = (id(SparkContext._gateway), *key)
        if place not in known:
            known[place] = make(*key)
        return known[place]

    return of


@remembered
def _steps(line: str) -> list[tuple[str, Column]]:
    """The columns that detect computes one after the other, from the column of that name."""
    raw, kind, found, inner, inside, outer = (F.col(n) for n in (line, "_kind", "_found", "_inner", "_inside", "parsed"))
    behind = _message(kind, found)
    asked = F.when(_syslog(kind), F.when(F.ltrim(behind).startswith("{"), F.ltrim(behind)))
    asked = asked.when(raw.rlike(r"^[{\[]") | (kind.isNull() & (raw.rlike("^<[A-Za-z?]") | looks_yaml(raw))), raw)
    mark = F.get(F.array(F.col("_nested")[""]), F.lit(0))
    # The format at last: nested formats that come before what native tests found, then that, then the other nested ones.
    first = F.when(~_syslog(kind) & mark.isin("json", "json_array"), mark)
    format = F.coalesce(first, kind, F.when(mark.isin("xml", "yaml"), mark), F.lit("plain"))
    chosen, fields, is_ = F.col("_format_"), F.col("_map"), lambda name: F.col("_format_") == name
    map_ = F.when(chosen.isin("json", "json_array", "xml", "yaml"), _without_mark(F.col("_nested"))).when(is_("logfmt"), logfmt_fields(raw))
    record_ = F.when(is_("rfc5424"), rfc5424_record(found)).when(is_("rfc3164"), rfc3164_record(found)).when(is_("cef"), cef_record(found)).when(is_("leef"), leef_record(found))
    record_ = record_.when(is_("csv"), csv(raw)[1]).when(is_("xml"), xml_record(raw, fields)).when(is_("json_array"), json_array_record(raw, fields))
    record_ = record_.when(chosen.isin("json", "yaml", "logfmt"), _described(chosen, fields)).otherwise(plain(raw)[1])
    # The second pass, for what a syslog line carries.
    carried = F.when(_syslog(kind), F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)(CEF:\d+\|.*)", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"(?s)(LEEF:[12].*)", 1), F.lit(""))))
    held = F.when(inner.rlike(CEF), groups(inner, CEF, 8)).when(inner.rlike(LEEF), groups(inner, LEEF, 6))
    second = F.when(inside.isNotNull() & inner.startswith("CEF"), cef_record(inside)).when(inside.isNotNull(), leef_record(inside))
    second = second.when(_syslog(kind) & (mark == "json"), _described(F.lit("json"), _without_mark(F.col("_nested"))))
    merged = F.when(F.col("_second").isNotNull(), merge(outer, F.col("_second"))).otherwise(outer)
    return [("_kind", _kind(raw)), ("_found", _found(raw, kind)), ("_nested", nested(asked)), ("_format_", format), ("_map", map_), ("parsed", record_), ("_inner", carried), ("_inside", held), ("_second", second), ("parsed", merged)]


def detect(lines: DataFrame, raw: str) -> DataFrame:
    """lines with the record of the first parser that accepts a line, and what its syslog header carries, as `parsed`."""
    names = lines.columns
    for name, value in _steps(raw):
        lines = computed(lines, name, value)
    return lines.select(*names, "parsed")


def merge(outer: Column, inner: Column) -> Column:
    """A record within another: fields, severity, message id and a message of the inner one win; it fills other gaps."""
    win = lambda n: F.coalesce(F.nullif(inner[n], F.lit("")), outer[n])
    fill = lambda n: F.coalesce(outer[n], inner[n])
    fields = F.map_concat(outer["fields"], inner["fields"], F.create_map(F.lit("_transport"), outer["format"]))
    return F.struct(inner["format"].alias("format"), outer["facility"].alias("facility"), win("severity").alias("severity"), fill("timestamp").alias("timestamp"), fill("hostname").alias("hostname"), fill("app_name").alias("app_name"), fill("proc_id").alias("proc_id"), win("msg_id").alias("msg_id"), win("message").alias("message"), fields.alias("fields")).cast(SCHEMA)


def second_pass(raw: Column, found: Column) -> Column:
    """What any line carries: CEF or LEEF anywhere in the line, or a message that is a JSON object."""
    inner_cef, inner_leef, message = F.regexp_extract(raw, r"(?s)(CEF:\d+\|.*)", 1), F.regexp_extract(raw, r"(?s)(LEEF:[12].*)", 1), F.ltrim(found["message"])
    out = F.when(F.lit(False), found)
    for guard, (ok, inner) in ((inner_cef != "", cef(inner_cef)), (inner_leef != "", leef(inner_leef)), (message.startswith("{"), json_object(message))):
        out = out.when(guard & F.coalesce(ok, F.lit(False)), merge(found, inner))
    return out.otherwise(found)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however often what follows uses it: the optimizer writes a projected
    expression into each of its uses, but not one that a generator makes."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def parse(lines: DataFrame, raw: str = "value", overrides: list[Override] = ()) -> DataFrame:
    """lines with columns of SCHEMA as `parsed`, and `source_label` where an override names one. Expects source_addr."""
    line, addr = F.col(raw), F.col("source_addr") if "source_addr" in lines.columns else F.lit("")
    lines = detect(lines, raw)
    forced, label = F.when(F.lit(False), F.col("parsed")), F.when(F.lit(False), "")
    for o in overrides:
        hit, found = o.when(line, addr), F.col("parsed")
        if o.format:
            ok, own = PARSERS[o.format](line)
            found = F.when(F.coalesce(ok, F.lit(False)), own).otherwise(found)
        if o.reparse_as:
            marker = {"cef": r"(?s)(CEF:.*)", "leef": r"(?s)(LEEF:.*)"}.get(o.reparse_as)
            payload = F.coalesce(F.nullif(F.regexp_extract(line, marker, 1), F.lit("")), found["message"]) if marker else found["message"]
            ok, inner = PARSERS[o.reparse_as](payload)
            found = F.when(F.coalesce(ok, F.lit(False)), merge(found, inner)).otherwise(found)
        elif o.reparse:
            found = second_pass(line, found)
        if o.rename:
            found = found.withField("fields", renamed(found["fields"], o.rename))
        if o.format or o.reparse_as or o.reparse or o.rename:
            forced = forced.when(hit, found)
        else:
            forced = forced.when(hit, F.col("parsed"))
        label = label.when(hit, F.lit(o.source or None))
    if overrides:
        lines = computed(lines.withColumn("source_label", label), "parsed", forced.otherwise(F.col("parsed")))
    return lines


def event_time(text: Column, now: Column) -> Column:
    """RFC 3339, ISO without a zone (UTC), or BSD time in the year of `now`; else null."""
    bsd = F.regexp_replace(F.concat(F.year(now).cast("string"), F.lit(" "), text), " +", " ")
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))
    naive = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]"), F.try_to_timestamp(text))
    return F.coalesce(zoned, naive, F.when(text.rlike(rf"^{BSD}$"), F.try_to_timestamp(bsd, F.lit("yyyy MMM d HH:mm:ss"))))
