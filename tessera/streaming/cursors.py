"""A cursor carried across a stream: entries located forward in their source as they arrive, in any order and any number of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.passages import plain, step

OUTPUT = "key long, pos long, start long, end long, how string"


class ForwardCursor(StatefulProcessor):
    """For each key: its source's text, the cursor and the number of the next entry, and entries that came before their turn.

    Entries are numbered from 0. An entry waits until its source and all entries before it are there. When the watermark is ``idle``
    milliseconds past a key's last row, its waiting entries come out as ``expired``, and its state is cleared.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.source = handle.getValueState("source", "t string")
        self.place = handle.getValueState("place", "cursor long, next long")
        self.waiting = handle.getMapState("waiting", "pos long", "t string")

    def handleInputRows(self, key, rows, timerValues):
        latest = 0
        for pdf in rows:
            latest = max(latest, int(pdf["at"].astype("datetime64[ms]").astype("int64").max()))
            for pos, t, kind in zip(pdf["pos"], pdf["t"], pdf["kind"]):
                if kind == 0:
                    self.source.update((t,))
                else:
                    self.waiting.updateValue((int(pos),), (t,))
        for timer in list(self.handle.listTimers()):
            latest = max(latest, timer - self.idle)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle)
        if not self.source.exists():
            return
        source = self.source.get()[0]
        cursor, following = self.place.get() if self.place.exists() else (0, 0)
        out = []
        while self.waiting.containsKey((following,)):
            needle = self.waiting.getValue((following,))[0]
            self.waiting.removeKey((following,))
            at, how, cursor = step(source, needle, cursor)
            out.append((key[0], following, at if at >= 0 else None, at + len(needle) if at >= 0 else None, how))
            following += 1
        self.place.update((cursor, following))
        yield self.rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        late = sorted(k[0] for k in self.waiting.keys())
        yield self.rows([(key[0], pos, None, None, "expired") for pos in late])
        for state in (self.source, self.place, self.waiting):
            state.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def rows(out):
        import pandas as pd

        frame = pd.DataFrame(out, columns=["key", "pos", "start", "end", "how"])
        return frame.astype({"key": "int64", "pos": "int64", "start": "Int64", "end": "Int64", "how": "object"})


def located_stream(rows: DataFrame, key: str, pos: str, text: str, is_source: str, at: str, idle: int = 600_000, lateness: str = "1 hour") -> DataFrame:
    """key, pos, start, end, how of a stream's entries, as ``passages.located_forward`` gives them for whole tables.

    ``rows`` has both sources (``is_source`` true, one for each key) and entries, with the time ``at`` of each; keys are whole numbers. The
    session's state store must be RocksDB's.
    """
    shaped = rows.withWatermark(at, lateness).select(F.col(at).alias("at"), F.col(key).cast("long").alias("key"), F.col(pos).cast("long").alias("pos"), plain(F.col(text)).alias("t"), F.when(F.col(is_source), 0).otherwise(1).alias("kind"))
    return shaped.groupBy("key").transformWithStateInPandas(ForwardCursor(idle), OUTPUT, "Append", "EventTime")
