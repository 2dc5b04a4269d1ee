"""The verification state of pages as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidara.operators.evidence_history import OUTCOME, STICKY_ERRORS

RECHECK_DAYS = 7
PAGE_STATE = "blocked string, blocked_since date, checked date, due long"


class PageState(StatefulProcessor):
    """One page: its block and last check, the verdict of each claim, and apart from these the verdicts of people.

    Rows are those of ``evidence_history.attempt_facts``; the rules are those of ``evidence_history.replay``, kept from one
    micro-batch to the next. Rows of a batch are taken in the order of ``at`` and ``seq``. A page that no check
    has reached for more than RECHECK_DAYS of event time yields a row of status ``DUE``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", PAGE_STATE)
        self.verified = handle.getMapState("verified", "claim string", "holds boolean")
        self.manual = handle.getMapState("manual", "claim string", "verdict boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blocked, since, checked, due = self.page.get() if self.page.exists() else (None, None, None, None)
        told, reached = [], None
        for row in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples(index=False):
            claim = (row.claim,)
            if row.kind == "manual":
                self.manual.updateValue(claim, (bool(row.verdict),))
                continue
            by_hand = self.manual.getValue(claim)[0] if self.manual.containsKey(claim) else None
            consulted = None if row.forced else by_hand
            unchanged = ambiguous = queued = False
            error = row.error if isinstance(row.error, str) else None
            known = self.verified.getValue(claim)[0] if self.verified.containsKey(claim) else None
            if blocked and not row.forced:
                status, unchanged, queued = self._said(consulted, blocked), True, consulted is None
            elif error:
                status = error
                if error in STICKY_ERRORS:
                    blocked, since, queued = error, since if blocked else row.at.date(), by_hand is None
            elif row.not_modified and not row.forced and known is not None:
                status, unchanged, reached = self._said(known, None), True, row.at
            elif row.body_chars < row.claim_chars:
                status = self._said(consulted, "PAGE_TOO_SHORT" if row.body_chars else "EMPTY_RESPONSE")
                unchanged, queued = consulted is not None, consulted is None
            else:
                self.verified.updateValue(claim, (bool(row.holds),))
                status, ambiguous, blocked, since, reached = self._said(bool(row.holds), None), bool(row.holds and row.hits > 1), None, None, row.at
            checked = reached.date() if reached is not None else checked
            told.append((*key, row.claim, row.at, row.seq, status, unchanged, ambiguous, queued, blocked, since, checked))
        if reached is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = int((reached.to_pydatetime().replace(tzinfo=timezone.utc) + timedelta(days=RECHECK_DAYS)).timestamp() * 1000) + 1
            self.handle.registerTimer(due)
        self.page.update((blocked, since, checked, due))
        yield _outcome(told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        blocked, since, checked, due = self.page.get()
        self.page.update((blocked, since, checked, None))
        yield _outcome([(*key, None, pd.Timestamp(due - 1, unit="ms"), None, "DUE", False, False, False, blocked, since, checked)])

    @staticmethod
    def _said(verdict: bool | None, otherwise: str | None) -> str | None:
        return otherwise if verdict is None else "GOOD" if verdict else "BAD"

    def close(self) -> None:
        pass


def _outcome(rows: list[tuple]) -> pd.DataFrame:
    columns = [field.split(" ")[0] for field in OUTCOME.split(", ")]
    return pd.DataFrame(rows, columns=columns).astype({"seq": "Int64"})


def keep_evidence_state(facts: DataFrame, late: str = "1 day") -> DataFrame:
    """The outcomes of a stream of attempts (columns FACTS), with the state of each page kept by its URL.

    State lies in the checkpoint of the query that writes the result, so a query started again goes on where it was
    stopped. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Attempts that come later than ``late``
    after newer ones are left out.
    """
    return facts.withWatermark("at", late).groupBy("url").transformWithStateInPandas(PageState(), OUTCOME, "Append", "EventTime")
