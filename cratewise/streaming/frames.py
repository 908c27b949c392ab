"""Frame labelling as frames arrive (R2): the hold-until-beaten rule with state per track.

:func:`label_stream` orders frames by their index alone and keeps a track for ever;
:func:`label_timed` goes by event time, lets early frames wait and forgets tracks that ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequences import HOLD, MARGIN, hysteresis_step

CHUNK = 512  # waiting frames in one entry of the state


def label_stream(frames: DataFrame, key: str, margin: float = MARGIN, hold: int = HOLD, contiguous: bool = False) -> DataFrame:
    """(key, frame_idx, style, late) for a stream of (key, frame_idx, top).

    Within a micro-batch rows are ordered by index. With ``contiguous`` the frames of a
    track count 0, 1, 2, ...: one that comes early waits in the state until those before
    it are there, so batches may come in any order. Otherwise a later batch has later
    frames. A frame at or before the last one labelled, a replay or one that came too
    late, does not move the state; it is given back with ``late`` true and no style.
    """
    kind = frames.schema[key].dataType.simpleString()
    top_kind = frames.schema["top"].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, rival, count, last, waiting = state.get if state.exists else (None, None, 0, -1, [])
        rows = pd.concat(list(batches))
        early = {int(w[0]): w[1] for w in waiting}
        out = []
        for idx, top in sorted(zip(rows["frame_idx"].tolist(), rows["top"], strict=True), key=lambda r: r[0]):
            if idx <= last or idx in early:
                out.append((keys[0], int(idx), None, True))
            else:
                early[int(idx)] = [(e["style"], e["score"]) for e in top]
        for idx in sorted(early):
            if contiguous and idx != last + 1:
                break
            held, rival, count = hysteresis_step((held, rival, count), [tuple(e) for e in early.pop(idx)], margin, hold)
            last = idx
            out.append((keys[0], last, held, False))
        state.update((held, rival, count, last, sorted(early.items())))
        yield pd.DataFrame(out, columns=[key, "frame_idx", "style", "late"])

    return frames.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, frame_idx long, style string, late boolean",
        f"held string, rival string, count long, last long, waiting array<struct<frame_idx:bigint,top:{top_kind}>>", "append", GroupStateTimeout.NoTimeout,
    )


class _TimedLabels(StatefulProcessor):
    """Per track: the held style as a value, waiting frames in chunks, one event-time timer.

    A row is (key, frame_idx, top, _ms). A chunk is one entry of two maps: its indices and
    times, and its tops. So the state is asked once a chunk and not once a frame, each a
    round trip. Of waiting frames only indices and times are read into memory; tops stay in
    the state store until it is their chunk's turn.
    """

    HELD = "held string, rival string, run long, last long, seen long, due long, chunks long"
    FIELDS = ("held", "rival", "run", "last", "seen", "due", "chunks")

    def __init__(self, name: str, margin: float, hold: int, contiguous: bool, idle: int) -> None:
        self.row, self.idle = Row(name, "frame_idx", "style", "late"), idle
        self.margin, self.hold, self.contiguous = margin, hold, contiguous

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.HELD)
        self.times = handle.getMapState("times", "chunk long", "frames array<long>, ms array<long>")
        self.tops = handle.getMapState("tops", "chunk long", "frames array<long>, tops array<array<struct<style:string,score:double>>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        track = self._load()
        early = self._waiting(track)
        fresh = {}  # tops of waiting frames that no chunk holds yet
        for row in rows:
            idx = row["frame_idx"]
            if idx <= track["last"] or idx in early:
                yield self.row(key[0], idx, None, True)
                continue
            track["seen"] = max(track["seen"], row["_ms"])
            top = [(e["style"], e["score"]) for e in row["top"]]
            if self.contiguous and idx == track["last"] + 1:
                yield self._label(key, track, idx, top)
            else:
                early[idx], fresh[idx] = (row["_ms"], None), top
                if len(fresh) == CHUNK:
                    self._file(track, early, fresh)
                    fresh = {}
        yield from self._release(key, track, early, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        track = self._load()
        track["due"] = None  # that timer has gone off
        yield from self._release(key, track, self._waiting(track), {}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        known = self.held.get()
        return dict(zip(self.FIELDS, (None, None, 0, -1, 0, None, 0) if known is None else known, strict=True))

    def _waiting(self, track: dict) -> dict:
        """{index: (time, chunk)} of the frames that wait."""
        if not track["chunks"]:
            return {}
        return {i: (ms, chunk) for (chunk,), (frames, times) in self.times.iterator() for i, ms in zip(frames, times, strict=True)}

    def _file(self, track: dict, early: dict, tops: dict, chunk: int | None = None) -> None:
        """Store ``tops`` as a new chunk, or as what is left of an old one."""
        if chunk is None:
            chunk = track["chunks"]
            track["chunks"] += 1
        frames = sorted(tops)
        self.times.updateValue((chunk,), (frames, [early[i][0] for i in frames]))
        self.tops.updateValue((chunk,), (frames, [tops[i] for i in frames]))
        for i in frames:
            early[i] = (early[i][0], chunk)

    def _label(self, key, track: dict, idx: int, top: list) -> Row:
        state = (track["held"], track["rival"], track["run"])
        track["held"], track["rival"], track["run"] = hysteresis_step(state, top, self.margin, self.hold)
        track["last"] = idx
        return self.row(key[0], idx, track["held"], False)

    def _release(self, key, track: dict, early: dict, fresh: dict, passed: int) -> Iterator[Row]:
        """Label what need not wait any more, then set the timer or let the track go."""
        due, opened = None, {}
        for idx in sorted(early):
            ms, chunk = early[idx]
            if ms > passed and not (self.contiguous and idx == track["last"] + 1):
                due = ms
                break
            if chunk is None:
                top = fresh.pop(idx)
            else:
                if chunk not in opened:
                    # as plain tuples: rows that were read from the state cannot be written back
                    frames, tops = self.tops.getValue((chunk,))
                    opened[chunk] = {i: [tuple(e) for e in top] for i, top in zip(frames, tops, strict=True)}
                top = opened[chunk].pop(idx)
                if not opened[chunk]:
                    del opened[chunk]
                    self.times.removeKey((chunk,))
                    self.tops.removeKey((chunk,))
            yield self._label(key, track, idx, top)
        for chunk, tops in opened.items():
            self._file(track, early, tops, chunk)
        if fresh:
            self._file(track, early, fresh)
        if due is None:
            track["chunks"] = 0
            due = track["seen"] + self.idle
            if due <= passed:
                if track["due"] is not None:
                    self.handle.deleteTimer(track["due"])
                self.held.clear()
                return
        if due != track["due"]:
            if track["due"] is not None:
                self.handle.deleteTimer(track["due"])
            self.handle.registerTimer(due)
        track["due"] = due
        self.held.update(tuple(track[c] for c in self.FIELDS))


def _millis(time: str) -> Column:
    """Event time in milliseconds, rounded up: once the watermark is there, nothing earlier can come."""
    return F.ceil(F.unix_micros(time) / 1000).cast("long")


def label_timed(
    frames: DataFrame, key: str, time: str, delay: str = "10 minutes", idle: int = 86400, contiguous: bool = False,
    margin: float = MARGIN, hold: int = HOLD,
) -> DataFrame:
    """(key, frame_idx, style, late) for a stream of (key, frame_idx, top, time), in whatever order it comes.

    Within a track later frames have higher indices. A frame waits in the state until the
    watermark, ``delay`` behind the latest time seen, has passed its time, for nothing
    before it can come then. With ``contiguous`` the frames of a track count 0, 1, 2, ...
    and one is labelled as soon as all before it are there; the watermark only closes gaps
    left by frames that never came. So the styles are those of batch hysteresis over the
    labelled frames, however batches are cut and ordered.

    * Rows at or before the watermark on arrival are dropped and counted by Spark
      (``numRowsDroppedByWatermark``). A replayed frame, or one before the last labelled
      one, comes back with ``late`` true and no style and changes nothing.
    * A track with nothing waiting leaves the state ``idle`` seconds after its last frame
      by event time. If it comes again after that it starts anew, from index 0 with
      ``contiguous``.
    * Frames with a null time never pass a watermark: they are left out. A frame with an
      empty or null ``top`` is left out as well.

    The state store must be RocksDB; the session is set to it.
    """
    spark = frames.sparkSession
    # Map state and timers exist for this provider only.
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    kind = frames.schema[key].dataType.simpleString()
    timed = frames.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a zoned time
    sound = timed.where(F.col(time).isNotNull() & (F.size("top") > 0)).withWatermark(time, delay)
    rows = sound.select(key, F.col("frame_idx").cast("long").alias("frame_idx"), "top", time, _millis(time).alias("_ms"))
    processor = _TimedLabels(key, margin, hold, contiguous, idle * 1000)
    return rows.groupBy(key).transformWithState(
        processor, f"{key} {kind}, frame_idx long, style string, late boolean", "append", "EventTime"
    )
