"""Ingestion state and evidence under ``transformWithState``: value state for each source and a timer for each boundary.

Events: ``edition_id, source_id, at`` (timestamp), ``hash, fetched, succeeded, boundary`` (timestamp: the next material boundary of the edition, or
null). The observed hash moves with every fetch, the success hash with a success, and neither with a failed fetch. A success makes
evidence, which a timer ends at its boundary when the watermark passes it; a later success before that renews it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEYS = ("edition_id", "source_id")
OUT = "edition_id string, source_id string, kind string, at timestamp, observed_hash string, success_hash string, fetch_status string, evidence string"
STATE = "observed_hash string, success_hash string, checked_at long, fetch_status string, evidence string, boundary long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(x) -> int | None:
    return None if x is None or pd.isna(x) else int(pd.Timestamp(x).value // 1000)


class SourceEvidence(StatefulProcessor):
    """Gives the state of a source after each event (``kind = 'state'``) and its end of evidence (``kind = 'expired'``)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("source", STATE)

    def _row(self, key, kind: str, at: int, s: tuple) -> pd.DataFrame:
        return pd.DataFrame({"edition_id": [key[0]], "source_id": [key[1]], "kind": [kind], "at": [pd.Timestamp(at * 1000)], "observed_hash": [s[0]], "success_hash": [s[1]], "fetch_status": [s[3]], "evidence": [s[4]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = tuple(self.state.get()) if self.state.exists() else (None, None, None, None, None, None)
        events = sorted((micros(e.at), bool(e.fetched), bool(e.succeeded), e.hash, micros(e.boundary)) for part in rows for e in part.itertuples())
        due = s[5]
        for at, fetched, succeeded, digest, boundary in events:
            if s[2] is not None and at < s[2]:
                continue  # a late event never takes back what a newer one has set
            if s[4] is not None and s[5] is not None and s[5] <= at:  # the boundary lies between two events of one batch
                s = (*s[:4], None, None)
                yield self._row(key, "expired", due, s)
            good = fetched and succeeded
            s = (digest if fetched else s[0], digest if good else s[1], at, "ok" if fetched else "failed", digest if good else s[4], boundary if good else s[5])
            due = s[5]
            yield self._row(key, "state", at, s)
        self.state.update(s)
        if s[4] is not None and s[5] is not None:
            self.handle.registerTimer(-(-s[5] // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = tuple(self.state.get()) if self.state.exists() else None
        # a timer of a boundary that a later success has replaced finds another boundary in the state
        if s is not None and s[4] is not None and s[5] is not None and -(-s[5] // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            at, s = s[5], (*s[:4], None, None)
            self.state.update(s)
            yield self._row(key, "expired", at, s)

    def close(self) -> None:
        pass


def source_evidence(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The changes of state and the expiries of a stream of events; the session must use the RocksDB state store (:data:`STORE`)."""
    return events.withWatermark("at", late).groupBy(*KEYS).transformWithStateInPandas(SourceEvidence(), OUT, "Update", "EventTime")
