"""Replays of a panel as a stream, against the spells of all its sightings."""

import random

import pytest

from tenura.operators import panel as pn
from tenura.streaming import panel_stream as ps

GRACES = (1, 3, 7)


def replay(spark, folder, batches, delay=0):
    """(ended spells, open spells) after each list of (key, run_idx) has been a batch of its own."""
    spark.conf.set(*ps.STORE)
    seen, out, state = (f"{folder}/{n}" for n in ("seen", "out", "state"))
    kind = "key string, run_idx int"
    ended = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(seen)
        stream = spark.readStream.schema(kind).parquet(seen)
        query = ps.ended_spells(stream, GRACES, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        ended.append(spark.read.schema(ps.SPELL).parquet(out).count())
    rows = lambda df: sorted(map(tuple, df.collect()))
    return rows(spark.read.schema(ps.SPELL).parquet(out)), rows(ps.open_spells(spark, state, GRACES)), ended


def whole(spark, sightings):
    rows = sorted({(k, r) for k, r in sightings if k is not None and r is not None})
    seen = spark.createDataFrame(rows, "key string, run_idx int")
    runs = seen.select("run_idx").distinct()
    return sorted(map(tuple, pn.spells(seen, runs, GRACES).select("key", "grace", "start_idx", "last_seen_idx", "sightings").collect()))


@pytest.fixture
def panel():
    rnd = random.Random(7)
    return [(f"k{k}", r) for k in range(40) for r in range(24) if rnd.random() < rnd.choice([0.15, 0.6])]


def test_a_replay_by_runs_gives_all_spells(spark, tmp_path, panel):
    batches = [[(k, r) for k, r in panel if r // 6 == b] for b in range(4)]
    batches[1] += [(None, 7), ("k1", None), *batches[1][:5]]  # rows without a key or run, and repeats
    ended, open_, counts = replay(spark, tmp_path, batches)
    assert sorted(ended + open_) == whole(spark, panel)
    assert not set(ended) & set(open_) and counts == sorted(counts) and counts[1] > 0
    last = max(r for _, r in panel)
    assert all(last - e[3] >= e[1] for e in ended)  # none that a later run could go on with
    assert all(last - o[3] <= o[1] for o in open_)  # all others wait


def test_order_and_repeats_within_the_delay_play_no_role(spark, tmp_path, panel):
    rnd = random.Random(1)
    late = sorted(panel, key=lambda s: s[1] + rnd.uniform(0, 2.9))
    batches = [late[i::1][: len(late) // 3] if i == 0 else late[i * (len(late) // 3) : (i + 1) * (len(late) // 3) if i < 2 else None] for i in range(3)]
    batches[1] = batches[1] + batches[1][::2]
    ended, open_, _ = replay(spark, tmp_path, batches, delay=4)
    assert sorted(ended + open_) == whole(spark, panel) and ended


def test_keys_with_nothing_open_keep_no_state(spark, tmp_path):
    ended, open_, _ = replay(spark, tmp_path, [[("a", 0), ("b", 0)], [("b", 30)], [("c", 31)]])
    assert [e for e in ended if e[0] == "a"] == [("a", g, 0, 0, 1) for g in GRACES]
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "spells").load()
    assert {r["key"]["key"] for r in state.collect()} == {"b", "c"}
