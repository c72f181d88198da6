"""Keyed state over time, as folds: repeated alerts and chains of alerts.

Both are folds over a key's rows in order of (time, tie-break). They run as grouped maps over rows that Spark sorts by key
and time, one row after another, so a hot key is never gathered: only its state is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Dedup:
    """An alert passes unless one of its key passed less than `window` seconds before. State changes only when one passes."""

    window: int
    last: int | None = None

    def passes(self, at: int) -> bool:
        if self.window and self.last is not None and at - self.last < self.window:
            return False
        self.last = at
        return True


@dataclass(frozen=True)
class ChainRule:
    """steps: (rule_id, least count). ordered: steps count one after the other."""

    id: str
    title: str
    join_field: str
    steps: tuple[tuple[str, int], ...]
    window: int = 300
    ordered: bool = True


@dataclass
class Chain:
    """State of one rule and join value. The window is anchored at the first alert of any step, whether or not it counts,
    and an alert more than `window` seconds after that starts anew. An alert whose rule stands in several steps may
    advance several at once. A complete chain fires and is forgotten."""

    rule: ChainRule
    start: int | None = None
    counts: list[int] | None = None
    step: int = 0
    samples: list[list] | None = None

    def feed(self, rule_id: str, at: int, event=None) -> dict | None:
        if all(rule_id != r for r, _ in self.rule.steps):
            return None
        if self.start is None or at - self.start > self.rule.window:
            self.start, self.step = at, 0
            self.counts, self.samples = [0] * len(self.rule.steps), [[] for _ in self.rule.steps]
        for i, (wanted, least) in enumerate(self.rule.steps):
            if wanted != rule_id or (i != self.step if self.rule.ordered else self.counts[i] >= least):
                continue
            self.counts[i] += 1
            if len(self.samples[i]) < 3:
                self.samples[i].append(event)
            if self.rule.ordered and self.counts[i] >= least:
                self.step += 1
        if self.step < len(self.rule.steps) if self.rule.ordered else any(n < least for n, (_, least) in zip(self.counts, self.rule.steps)):
            return None
        out = {"chain_start": self.start, "chain_end": at, "step_counts": self.counts, "sample_events": [s for own in self.samples for s in own][:5]}
        self.start = None
        return out


def _sorted(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, time, tie)


def dedup(alerts: DataFrame, keys: list[str], time: str, tie: str, window: int) -> DataFrame:
    """The alerts that pass. time: seconds (long); tie orders alerts of one second."""
    names = alerts.columns
    if not window:
        return alerts

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keep = []
            for *key, at in zip(*(batch.column(k).to_pylist() for k in (*keys, time))):
                if key != now or state is None:
                    now, state = key, Dedup(window)
                keep.append(state.passes(at))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return _sorted(alerts, keys, time, tie).mapInArrow(each, alerts.schema).select(*names)


CHAINS = "correlation_id string, correlation_title string, join_field string, join_value string, window_seconds long, chain_start long, chain_end long, step_counts array<long>, sample_events array<string>"


def chains(alerts: DataFrame, rules: list[ChainRule], time: str = "timestamp", tie: str = "tie") -> DataFrame:
    """Correlated alerts of alerts (rule_id, time, tie, sample, and the join fields as columns); a missing or empty join
    value takes no part. Each alert goes once to every rule that names it."""
    by_id = {r.id: r for r in rules}
    cells = [F.when(F.col("rule_id").isin([s for s, _ in r.steps]) & (F.coalesce(F.col(r.join_field), F.lit("")) != ""), F.struct(F.lit(r.id).alias("chain"), F.col(r.join_field).alias("value"))) for r in rules]
    sample = F.col("sample") if "sample" in alerts.columns else F.lit(None).cast("string")
    routed = alerts.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("to"), "rule_id", F.col(time).alias("at"), F.col(tie).alias("tie"), sample.alias("sample"))
    routed = routed.select("to.chain", "to.value", "rule_id", "at", "tie", "sample")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for chain, value, rule_id, at, sample in zip(*(batch.column(k).to_pylist() for k in ("chain", "value", "rule_id", "at", "sample"))):
                if (chain, value) != now:
                    now, state = (chain, value), Chain(by_id[chain])
                if fired := state.feed(rule_id, at, sample):
                    r = by_id[chain]
                    out.append({"correlation_id": r.id, "correlation_title": r.title, "join_field": r.join_field, "join_value": value, "window_seconds": r.window, **fired})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("correlation_id", pa.string()), ("correlation_title", pa.string()), ("join_field", pa.string()), ("join_value", pa.string()), ("window_seconds", pa.int64()), ("chain_start", pa.int64()), ("chain_end", pa.int64()), ("step_counts", pa.list_(pa.int64())), ("sample_events", pa.list_(pa.string()))]))

    return _sorted(routed, ["chain", "value"], "at", "tie").mapInArrow(each, CHAINS)


def shipped_chains() -> list[ChainRule]:
    """The standard correlations."""
    # Their names, titles, steps and windows.
    return [
        ChainRule("cred-brute-force-success", "SSH Credential Guessing Followed by Login Success", "src_ip", (("1001-ssh-brute-force", 3), ("1005-ssh-login-success", 1)), 300, True),
        ChainRule("external-ssh-then-sudo", "Suspicious External SSH Probe Followed by Sudo Execution", "src_ip", (("1004-suspicious-ssh", 1), ("1002-sudo-execution", 1)), 600, False),
        ChainRule("sustained-brute-force", "Sustained SSH Brute Force from Single IP", "src_ip", (("1001-ssh-brute-force", 10),), 600, False),
        ChainRule("port-scan", "Port Scan / Network Reconnaissance", "src_ip", (("1009-firewall-port-scan", 15),), 120, False),
        ChainRule("haproxy-connect-flood", "HAProxy Connect Volume Flood", "src_ip", (("1012-haproxy-connect-volume", 100),), 3600, False),
    ]
