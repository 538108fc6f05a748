"""Chat changes as a stream: messages are folded in state by thread, and a thread that has been quiet for a while is given as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmere.operators import chat

_MESSAGE = "thread_ts string, author_id string, text string, author_name string, channel_name string, seq long, first_seq long, changes long"
#: kind: message (a row that was created or changed, PENDING) or thread (the whole thread, after it was quiet).
OUTPUT = "kind string, connection_id string, channel_id string, thread string, message_ts string, thread_ts string, author_id string, text string, author_name string, channel_name string, seq long, changes long"


def _shown(value) -> str | None:
    return None if value is None or value != value else str(value)


class Threads(StatefulProcessor):
    """A thread's messages under their times. Changes may come in any order: the first by seq creates a message, the last renews it."""

    def __init__(self, quiet_ms: int, ttl_ms: int):
        self._quiet, self._ttl = quiet_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._messages = handle.getMapState("messages", "message_ts string", _MESSAGE, ttlDurationMs=self._ttl or None)
        self._timer = handle.getValueState("timer", "at long", ttlDurationMs=self._ttl or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        changed: dict[str, tuple] = {}
        latest = 0
        for frame in rows:
            for r in frame.itertuples(index=False):
                ts = str(r.message_ts)
                old = changed.get(ts) or (self._messages.getValue((ts,)) if self._messages.containsKey((ts,)) else None)
                changed[ts] = self._applied(tuple(old) if old is not None else None, r)
                latest = max(latest, int(r.at_ms))
        for ts, message in changed.items():
            self._messages.updateValue((ts,), message)
        if self._quiet:
            due = latest + self._quiet
            if self._timer.exists():
                before = int(self._timer.get()[0])
                due = max(due, before)
                self._handle.deleteTimer(before)
            self._handle.registerTimer(due)
            self._timer.update((due,))
        yield pd.DataFrame([self._row("message", key, ts, m) for ts, m in changed.items()], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    @staticmethod
    def _applied(old: tuple | None, r) -> tuple:
        made = (_shown(r.thread_ts), _shown(r.author_id))
        renewed = (_shown(r.text), _shown(r.author_name), _shown(r.channel_name))
        if old is None:
            return (*made, *renewed, int(r.seq), int(r.seq), 1)
        created = made if int(r.seq) < old[6] else tuple(old[:2])
        last = renewed if int(r.seq) >= old[5] else tuple(old[2:5])
        return (*created, *last, max(int(r.seq), old[5]), min(int(r.seq), old[6]), old[7] + 1)

    def _row(self, kind: str, key, ts: str, m: tuple) -> tuple:
        return (kind, key[0], key[1], key[2], ts, *m[:6], m[7])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lines = sorted(((float(k[0]), k[0], tuple(v)) for k, v in self._messages.iterator()), key=lambda x: x[:2])
        text = "\n".join(": ".join(p for p in (m[3], m[2]) if p) for _, _, m in lines)
        self._timer.clear()
        row = ("thread", key[0], key[1], key[2], None, None, None, text, None, lines[-1][2][4] if lines else None, max((m[5] for _, _, m in lines), default=0), len(lines))
        yield pd.DataFrame([row], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def folded(changes: DataFrame, quiet: str | None = None, late: str = "1 hour", days: int = 0) -> DataFrame:
    """Rows of OUTPUT for a stream of chat.changes() with at (the time of the change). Needs the RocksDB state store.

    Every created or changed message comes out; of a message's rows that with most changes is its last, and it is as chat.folded() has it, in whatever order
    changes come. With quiet (seconds), a thread in which nothing changed for so long by the watermark comes out whole, again after each later change.
    days bounds how long a quiet thread's messages are remembered; a change after that makes a row as if it were the first. 0: always.
    """
    rows = changes.withColumn("at_ms", F.unix_millis("at"))
    if quiet:
        rows = rows.withWatermark("at", late)
    processor = Threads(int(quiet) * 1000 if quiet else 0, days * 86_400_000)
    return rows.groupBy("connection_id", "channel_id", "thread").transformWithStateInPandas(processor, OUTPUT, "Append", "eventTime" if quiet else "processingTime")


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each message in what folded() gave."""
    own = rows.where("kind = 'message'")
    return own.groupBy(*chat.KEY).agg(F.max_by(F.struct("thread", *chat.CREATED, *chat.RENEWED, "seq"), "changes").alias("m")).select(*chat.KEY, "m.*")
