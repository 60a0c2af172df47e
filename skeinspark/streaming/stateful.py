"""Custom state with timers: sessions of users that a timer emits when the watermark has passed their end."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

# Workers get this module with the processor, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "user_id long, start timestamp, finish timestamp, n long, kinds long, most string, total double"


class Sessions(StatefulProcessor):
    """Open sessions of one user: a list of spans, a map of counts of each span's event types, and the timer that is set.

    Rows may come in any order within the watermark: a row that lies between two spans joins them. A span
    is emitted by a timer once no row that could still come can reach it, and its state is dropped.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "start long, last long, n long, total double")
        self.counts = handle.getMapState("counts", "start long, kind string", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def _load(self) -> tuple[list[list], dict[tuple, int]]:
        return sorted(list(s) for s in self.spans.get()), {tuple(k): v[0] for k, v in self.counts.iterator()}

    def _store(self, spans: list[list], counts: dict[tuple, int]) -> None:
        """Write what is open and set the timer of the span that ends first; with nothing open, leave nothing."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        if not spans:
            for state in (self.spans, self.counts, self.timer):
                state.clear()
            return
        self.spans.put([tuple(s) for s in spans])
        open_ = {s[0] for s in spans}
        for key, n in counts.items():
            if key[0] in open_:
                self.counts.updateValue(key, (n,))
            elif self.counts.containsKey(key):
                self.counts.removeKey(key)
        at = min(s[1] for s in spans) // 1000 + self.gap + 1
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def _merged(self, spans: list[list], counts: dict[tuple, int]) -> list[list]:
        """Spans in order, joined where they are less than a gap apart; counts move to the joined span."""
        out: list[list] = []
        for start, last, n, total in sorted(spans):
            if out and start < out[-1][1] + self.gap * 1000:
                held = out[-1]
                held[1], held[2], held[3] = max(held[1], last), held[2] + n, held[3] + total
                for key in [k for k in counts if k[0] == start and start != held[0]]:
                    moved = (held[0], key[1])
                    counts[moved] = counts.get(moved, 0) + counts[key]
                    counts[key] = 0
            else:
                out.append([start, last, n, total])
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        spans, counts = self._load()
        for pdf in rows:
            # Runs of rows less than a gap apart, so that state grows with sessions and not with rows.
            pdf = pdf.sort_values("micros")
            run = (pdf["micros"].diff() >= self.gap * 1000).cumsum()
            start = pdf.groupby(run)["micros"].transform("min")
            for s, last, n, total in zip(*(pdf.groupby(run)[c].agg(f).tolist() for c, f in (("micros", "min"), ("micros", "max"), ("micros", "size"), ("value", "sum")))):
                spans.append([int(s), int(last), int(n), float(total)])
            for (s, kind), n in pdf.groupby([start, pdf["event_type"].fillna("")]).size().items():
                counts[int(s), kind] = counts.get((int(s), kind), 0) + int(n)
        self._store(self._merged(spans, counts), counts)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans, counts = self._load()
        self.timer.clear()  # it has fired
        passed = timerValues.getCurrentWatermarkInMs()
        done = [s for s in spans if s[1] + self.gap * 1000 <= passed * 1000]
        rows = []
        for start, last, n, total in done:
            kinds = {k[1]: c for k, c in counts.items() if k[0] == start and c}
            rows.append((key[0], start, last + self.gap * 1000, n, len(kinds), min(kinds, key=lambda k: (-kinds[k], k.encode())), total))
        self._store([s for s in spans if s not in done], counts)
        out = pd.DataFrame(rows, columns=["user_id", "start", "finish", "n", "kinds", "most", "total"])
        if rows:
            yield out.assign(**{c: pd.to_datetime(out[c], unit="us") for c in ("start", "finish")})


def timed_sessions(stream: DataFrame, gap_minutes: int = 30, lateness: str = "1 hour") -> DataFrame:
    """user_id, start, finish, n, kinds (different event types), most (the most frequent one, ties to the first by bytes) and total, for each session of a user.

    A session ends ``gap_minutes`` after its last row and is emitted once the watermark has passed that. Rows
    without a time are left out, as are rows behind the watermark; a null type counts as an
    empty one and a null value as 0, and null users are one user. A user without open sessions has no state.
    """
    rows = stream.withWatermark("ts", lateness).filter("ts is not null")
    told = rows.select("user_id", "ts", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"), F.unix_micros("ts").alias("micros"))
    return told.groupBy("user_id").transformWithStateInPandas(Sessions(gap_minutes * 60_000), OUTPUT, "Append", "EventTime")
