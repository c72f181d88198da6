"""Field names and schemas of events, alerts and acknowledgements."""

from __future__ import annotations

import re

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")

#: Columns that every event table has, whatever sources are configured.
MANDATORY = ("timestamp", "_source_type", "severity", "source_addr", "hostname", "app_name")

ALERT = "type string, rule_id string, rule_title string, level string, event map<string,string>, timestamp long"
CORRELATED = (
    "type string, correlation_id string, correlation_title string, join_field string, join_value string, window_seconds long, "
    "chain_start long, chain_end long, step_counts array<long>, sample_events array<map<string,string>>"
)
ACK = "rule_id string, timestamp long, note string"


class EngineError(ValueError):
    """What a user of the engine got wrong."""


def identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise EngineError(f"not a field name: {name!r}")
    return name
