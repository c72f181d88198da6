"""The folds of operators.stateful as streaming state: same classes, same results on the same ordered input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stateful import Chain, ChainRule, Dedup


class DedupProcessor(StatefulProcessor):
    def __init__(self, window: int, names: list[str], time: str, ttl_ms: int | None):
        self.window, self.names, self.time, self.ttl = window, names, time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = Dedup(self.window, self.last.get()[0] if self.last.exists() else None)
        batch = pd.concat(list(rows)).sort_values([self.time, "tie"], kind="stable")
        kept = batch[[state.passes(int(t)) for t in batch[self.time]]]
        if state.last is not None:
            self.last.update((state.last,))
        yield kept[self.names]

    def close(self) -> None:
        pass


def dedup(alerts: DataFrame, keys: list[str], time: str = "timestamp", window: int = 5, ttl_s: int | None = None) -> DataFrame:
    """A stream of alerts (with `tie`) without those that come too soon after one of their key."""
    if not window:
        return alerts
    processor = DedupProcessor(window, alerts.columns, time, 1000 * ttl_s if ttl_s else None)
    return alerts.groupBy(*keys).transformWithStateInPandas(processor, alerts.schema, "Append", "ProcessingTime" if ttl_s else "None")


CHAIN_STATE = "start long, counts array<long>, step int, samples array<array<string>>"
OUT = "correlation_id string, join_value string, window_seconds long, chain_start long, chain_end long, step_counts array<long>, sample_events array<string>"


class ChainProcessor(StatefulProcessor):
    def __init__(self, rules: dict[str, ChainRule], ttl_ms: int | None):
        self.rules, self.ttl = rules, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chain", CHAIN_STATE, self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rule = self.rules[key[0]]
        chain = Chain(rule)
        if self.state.exists():
            start, counts, step, samples = self.state.get()
            if start is not None:
                chain.start, chain.counts, chain.step, chain.samples = int(start), [int(n) for n in counts], int(step), [list(s) for s in samples]
        batch = pd.concat(list(rows)).sort_values(["timestamp", "tie"], kind="stable")
        out = []
        for rule_id, at, sample in zip(batch["rule_id"], batch["timestamp"], batch["sample"]):
            if fired := chain.feed(rule_id, int(at), sample):
                out.append({"correlation_id": rule.id, "join_value": key[1], "window_seconds": rule.window, **fired})
        if chain.start is None:
            self.state.clear()
        else:
            self.state.update((chain.start, chain.counts, chain.step, chain.samples))
        yield pd.DataFrame(out, columns=["correlation_id", "join_value", "window_seconds", "chain_start", "chain_end", "step_counts", "sample_events"])

    def close(self) -> None:
        pass


def chains(alerts: DataFrame, rules: list[ChainRule], ttl_s: int | None = None) -> DataFrame:
    """A stream of alerts (rule_id, timestamp, tie, sample, join fields) to correlated alerts."""
    cells = [F.when(F.col("rule_id").isin([s for s, _ in r.steps]) & (F.coalesce(F.col(r.join_field), F.lit("")) != ""), F.struct(F.lit(r.id).alias("chain"), F.col(r.join_field).alias("value"))) for r in rules]
    routed = alerts.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("to"), "rule_id", "timestamp", "tie", "sample").select("to.chain", "to.value", "rule_id", "timestamp", "tie", "sample")
    processor = ChainProcessor({r.id: r for r in rules}, 1000 * ttl_s if ttl_s else None)
    return routed.groupBy("chain", "value").transformWithStateInPandas(processor, OUT, "Append", "ProcessingTime" if ttl_s else "None")
