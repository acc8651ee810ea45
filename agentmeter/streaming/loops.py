"""Retry loops over a stream: one open run of errors in keyed state for each session.

A session's results follow each other, so its state is the last call asked and how often in a row it
failed, whatever the session's length. A timer closes a session that is idle: the run that was open
then comes out like one that another result ended.
"""

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from agentmeter.model import RETRY_LOOP_MIN

STEP = ("session", "chunk", "pos", "idx", "tool", "hash", "is_error", "denied", "at")
_STATE = "tool string, hash string, streak long, denied long, chunk long, pos long, timer long"
_LOOP = "session string, tool string, hash string, streak long, denied long, chunk long, pos long"


class RetryLoops(StatefulProcessor):
    def __init__(self, idle_ms: int, least: int = RETRY_LOOP_MIN) -> None:
        self.idle_ms, self.least = idle_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        if key[0] is None:
            return
        runs = self._runs(batch.sort_values(["chunk", "pos", "idx"], kind="stable", ignore_index=True))
        held = self.open.get() if self.open.exists() else None
        first = runs[0]
        if held is not None:
            tool, digest, streak, denied, chunk, pos, timer = held
            self.handle.deleteTimer(timer)
            if first["is_error"] and (first["tool"], first["hash"]) == (tool, digest):
                first |= {"streak": first["streak"] + streak, "denied": first["denied"] + denied, "chunk": chunk, "pos": pos}
            else:
                kept = {"tool": tool, "hash": digest, "streak": streak, "denied": denied, "chunk": chunk, "pos": pos}
                runs.insert(0, kept | {"is_error": True})
        last = runs.pop()
        if last["is_error"]:
            newest = batch["at"].max()
            seen = timerValues.getCurrentWatermarkInMs() if pd.isna(newest) else int(newest.timestamp() * 1000)
            timer = seen + self.idle_ms
            self.open.update((*(last[c] for c in ("tool", "hash", "streak", "denied", "chunk", "pos")), timer))
            self.handle.registerTimer(timer)
        elif held is not None:
            self.open.clear()
        yield from self._loops(key[0], runs)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            held = dict(zip(("tool", "hash", "streak", "denied", "chunk", "pos"), self.open.get()[:6], strict=True))
            self.open.clear()
            yield from self._loops(key[0], [held | {"is_error": True}])

    def _runs(self, rows: pd.DataFrame) -> list[dict]:
        """Maximal runs of rows with the same call and outcome, in order."""
        state = rows[["tool", "hash", "is_error"]].astype(object)
        before = state.shift()
        same = ((state == before) | (state.isna() & before.isna())).all(axis=1)
        if len(same):
            same.iloc[0] = False
        grouped = rows.groupby((~same).cumsum(), sort=True)
        runs = grouped.agg(
            tool=("tool", "first"), hash=("hash", "first"), is_error=("is_error", "first"), streak=("pos", "size"),
            denied=("denied", "sum"), chunk=("chunk", "first"), pos=("pos", "first"),
        )
        plain = {"is_error": bool, "streak": int, "denied": int, "chunk": int, "pos": int}
        return [r | {c: kind(r[c]) for c, kind in plain.items()} for r in runs.to_dict("records")]

    def _loops(self, session: str, runs: list[dict]) -> Iterator[pd.DataFrame]:
        found = [r for r in runs if r["is_error"] and r["streak"] >= self.least]
        if found:
            frame = pd.DataFrame(found)
            frame["session"] = session
            yield frame[["session", "tool", "hash", "streak", "denied", "chunk", "pos"]]


def retry_loops(results: DataFrame, late: str, idle: str) -> DataFrame:
    """(session, tool, hash, streak, denied, chunk, pos) of each loop once a later result or ``idle`` ended it.

    ``results`` are joined results, ``STEP``; a session's rows come in scan order from batch to batch and in any order
    within one. A batch holds what one session adds to it in memory, so its size is set by the
    source's limits (files, bytes or offsets a trigger). Rows without a session only move the watermark.
    """
    idle_ms = _milliseconds(results, idle)
    steps = results.select(*STEP).withColumns(
        {"denied": F.col("denied").cast("bigint"), "at": F.col("at").cast("timestamp")}
    )
    return (
        steps.withWatermark("at", late)
        .groupBy("session")
        .transformWithStateInPandas(RetryLoops(idle_ms), _LOOP, "Append", "EventTime")
    )


def _milliseconds(rows: DataFrame, interval: str) -> int:
    spark = rows.sparkSession
    whole = f"timestampdiff(MILLISECOND, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + INTERVAL {interval})"
    return spark.sql(f"SELECT {whole}").first()[0]
