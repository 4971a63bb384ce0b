"""Spells of a stream of sightings with state of our own: one state for each key, for all grace periods at once.

Sightings of runs that the watermark has not passed yet wait in the state, as a set, so that a run seen twice counts once
and the order of arrival within the watermark's delay plays no role. Once a run is passed it is settled: it goes on with
the open spell of each grace or opens a new one. A timer wakes the key when its next run settles, or when an open spell
has missed so many runs that nothing can continue it; that spell is then given out, and a key with nothing open keeps no
state. What is open can be read from the checkpoint at any time.

The stream needs the RocksDB state store: `spark.conf.set(*STORE)` before it starts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.session import ship
from .spells import index_time

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RUN_MS = 86_400_000
SPELL = "key string, grace int, start_idx int, last_seen_idx int, sightings int"
STATE = "waiting array<int>, grace array<int>, first array<int>, last array<int>, sightings array<int>"

#: grace -> [first run, last run, sightings] of its open spell.
Open = dict[int, list[int]]


def settle(open_: Open, runs: Iterable[int], graces: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """Adds settled runs, in order, to the open spells; gives the spells (grace, first, last, sightings) that they end."""
    ended = []
    for run in runs:
        for g in graces:
            spell = open_.get(g)
            if spell and run - spell[1] - 1 < g:
                spell[1], spell[2] = run, spell[2] + 1
                continue
            if spell:
                ended.append((g, *spell))
            open_[g] = [run, run, 1]
    return ended


def overdue(open_: Open, passed: int) -> list[tuple[int, int, int, int]]:
    """Takes out the spells that no run from `passed` on can continue."""
    return [(g, *open_.pop(g)) for g in sorted(open_) if passed - open_[g][1] - 1 >= g]


class Splitter(StatefulProcessor):
    def __init__(self, graces: tuple[int, ...]):
        self.graces = graces

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("spells", STATE)

    def load(self) -> tuple[set[int], Open]:
        if not self.state.exists():
            return set(), {}
        waiting, *columns = self.state.get()
        return set(waiting), {g: [a, b, n] for g, a, b, n in zip(*columns, strict=True)}

    def advance(self, key: tuple, waiting: set[int], open_: Open, watermark: int) -> Iterator[pd.DataFrame]:
        """Settles what the watermark has passed, keeps the rest, and asks to be woken when there will be something to do."""
        passed = max(watermark, 0) // RUN_MS  # runs before this one are settled
        ready = sorted(r for r in waiting if r < passed)
        ended = settle(open_, ready, self.graces) + overdue(open_, passed)
        waiting = waiting - set(ready)
        due = [min(waiting) + 1] if waiting else []
        due += [last + g + 1 for g, (_, last, _) in open_.items()]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due:
            self.handle.registerTimer(min(due) * RUN_MS)
            held = sorted(open_)
            self.state.update((sorted(waiting), held, *([open_[g][i] for g in held] for i in range(3))))
        else:
            self.state.clear()
        if ended:
            yield pd.DataFrame([(key[0], *e) for e in ended], columns=[c.split()[0] for c in SPELL.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        waiting, open_ = self.load()
        for frame in rows:
            waiting.update(frame["run_idx"].astype(int).tolist())
        yield from self.advance(key, waiting, open_, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self.advance(key, *self.load(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def ended_spells(seen: DataFrame, graces: Iterable[int], delay_runs: int = 0) -> DataFrame:
    """(key, grace, start_idx, last_seen_idx, sightings) of a stream (key, run_idx), each once nothing can continue it, in append mode.

    Sightings may come in any order, and repeatedly, up to `delay_runs` runs late; later ones are left out, as are rows
    without a key or run. With the spells that `open_spells` reads, that is what `panel.spells` gives for all sightings.
    """
    ship(seen.sparkSession)
    timed = seen.where("key IS NOT NULL AND run_idx IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("run_idx").cast("int").alias("run_idx"))
    # a run is timed by its end, and the watermark stays half a day off those times: runs that it has passed are settled
    timed = timed.withColumn("ts", index_time(F.col("run_idx") + 1)).withWatermark("ts", f"{delay_runs} days 12 hours")
    return timed.groupBy("key").transformWithStateInPandas(Splitter(tuple(sorted(set(graces)))), SPELL, "Append", "EventTime")


def open_spells(spark: SparkSession, checkpoint: str, graces: Iterable[int]) -> DataFrame:
    """(key, grace, start_idx, last_seen_idx, sightings) that the stream with this checkpoint has not given out yet.

    Runs that wait are added as if no other came before them, so what they end already is given, too.
    """
    ship(spark)
    graces = tuple(sorted(set(graces)))
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "spells").load().select("key.key", "value.*")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, waiting, *columns in f.itertuples(index=False):
                open_ = {int(g): [int(a), int(b), int(n)] for g, a, b, n in zip(*columns, strict=True)}
                ended = settle(open_, map(int, sorted(waiting)), graces)
                out += [(key, *e) for e in ended] + [(key, g, *open_[g]) for g in sorted(open_)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SPELL.split(", ")])

    return state.mapInPandas(fold, SPELL)
