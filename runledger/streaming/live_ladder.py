"""F2, K10, G3 live: a ladder of bounds per unit that goes on as verdicts come in, within a budget of time.

Rows (see ROW) of a unit: an ask names its ladder and budget, a run reports the verdict of one bound and what it took. Each
verdict is answered at once by a decision: the next bound to run after an unknown one, or the end. No rung waits for a later one, and
none is asked for twice. A unit whose budget is used up, by what its runs took or by a timer of event time
since it was asked, is deferred: it ends without a verdict, which never counts as a pass. A row behind that time finds it deferred,
whether the timer has rung by then or not, so batches make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = "unit string, at timestamp, kind string, ladder array<int>, budget_s double, k int, verdict string, took_s double"
#: decision: request (run next_k), settled (a verdict other than unknown), exhausted (unknown at the last bound), deferred, rejected (a ladder that is empty or does not rise) or ignored (nothing waits for it).
DECISION = "unit string, at timestamp, decision string, k int, verdict string, next_k int, spent_s double"


def rises(ladder: list[int] | None) -> bool:
    return bool(ladder) and ladder[0] is not None and ladder[0] >= 1 and all(b is not None and a < b for a, b in zip(ladder, ladder[1:], strict=False))


class UnitLadder(StatefulProcessor):
    """Ladder, next rung, seconds spent and budget of a unit; nothing is kept once it has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("ladder", "rungs array<int>, rung int, spent_s double, budget_s double, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.state.get() if self.state.exists() else None
        for row in sorted(rows, key=lambda r: (r.at, r.kind != "ask", r.k or 0, r.verdict or "", r.took_s or 0.0)):
            if now is not None and 0 <= now[4] < row.at.timestamp() * 1000:  # its timer is due, whether it has rung or not
                self.handle.deleteTimer(now[4])
                yield self._deferred(key, now)
                now = None
            now, said = self._asked(now, row) if row.kind == "ask" else self._ran(now, row)
            k, verdict, next_k, spent = said[1:]
            yield Row(unit=key[0], at=row.at, decision=said[0], k=k, verdict=verdict, next_k=next_k, spent_s=spent)
        if now is None:
            self.state.clear()
        else:
            self.state.update(now)

    def _asked(self, now, row):
        if now is not None:
            return now, ("ignored", None, None, now[0][now[1]], now[2])
        if not rises(row.ladder):
            return None, ("rejected", None, None, None, 0.0)
        due = int(row.at.timestamp() * 1000 + 1000 * row.budget_s) if row.budget_s is not None else -1
        if due >= 0:
            self.handle.registerTimer(due)
        return (list(row.ladder), 0, 0.0, row.budget_s, due), ("request", None, None, row.ladder[0], 0.0)

    def _ran(self, now, row):
        if now is None or row.k != now[0][now[1]]:
            return now, ("ignored", row.k, row.verdict, None if now is None else now[0][now[1]], now[2] if now else None)
        rungs, rung, spent, budget, due = now
        spent += row.took_s or 0.0
        verdict = row.verdict or "unknown"
        if verdict != "unknown":
            return self._ended(due), ("settled", row.k, verdict, None, spent)
        if rung + 1 == len(rungs):
            return self._ended(due), ("exhausted", row.k, verdict, None, spent)
        if budget is not None and spent >= budget:
            return self._ended(due), ("deferred", row.k, verdict, rungs[rung + 1], spent)
        return (rungs, rung + 1, spent, budget, due), ("request", row.k, verdict, rungs[rung + 1], spent)

    def _ended(self, due):
        if due >= 0:
            self.handle.deleteTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self.state.get() if self.state.exists() else None
        if now is not None and now[4] == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self._deferred(key, now)

    def _deferred(self, key, now) -> Row:
        rungs, rung, spent, _, due = now
        return Row(unit=key[0], at=datetime.fromtimestamp(due / 1000), decision="deferred", k=None, verdict=None, next_k=rungs[rung], spent_s=spent)

    def close(self) -> None:
        pass


def decisions(rows: DataFrame, late: str = "1 minute") -> DataFrame:
    """The decisions on a stream of asks and runs; rows later than `late` behind the newest one are dropped."""
    return rows.withWatermark("at", late).groupBy("unit").transformWithState(UnitLadder(), DECISION, "Append", "EventTime")
