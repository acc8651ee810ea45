"""Ordered operators against plain Python, with one hot key over many chunks."""

import random

import pytest
from pyspark.sql import functions as F

from agentmeter.operators import ordered

CHUNK = 7


def make_rows(seed, keys, rows, hot_share=0.4, chunk=CHUNK):
    """Scan-ordered rows in which one key holds a large share."""
    rnd = random.Random(seed)
    out = []
    for pos in range(rows):
        key = keys[0] if rnd.random() < hot_share else rnd.choice(keys)
        out.append((pos // chunk, pos, rnd.randrange(2), key, rnd.randrange(3), rnd.random() < 0.6))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("chunk", [1, CHUNK, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_latest_before(spark, seed, chunk):
    rows = make_rows(seed, ["", "a", "b", "c", "d"], 160, chunk=chunk)
    df = spark.createDataFrame(rows, "chunk long, pos long, idx long, key string, v int, is_source boolean")
    sources = df.filter("is_source").select("key", "chunk", "pos", "idx", "v")
    probes = df.filter("not is_source").select("key", "chunk", "pos", "idx", F.lit("p").alias("tag"))
    # A source in a probe's own position counts as earlier.
    probes = probes.union(sources.select("key", "chunk", "pos", "idx", F.lit("same")))
    got = {
        (r.pos, r.tag): r.hit.v if r.hit else None
        for r in ordered.latest_before(sources, probes, "key", "hit").collect()
    }
    want, last = {}, {}
    for _, pos, _, key, v, is_source in sorted(rows, key=lambda r: r[1]):
        if is_source:
            last[key] = v
            want[(pos, "same")] = v
        else:
            want[(pos, "p")] = last.get(key)
    assert got == want


@pytest.mark.parametrize("chunk", [1, CHUNK, 10**6])
@pytest.mark.parametrize("seed", [3, 4, 5])
def test_collapse_runs(spark, seed, chunk):
    rows = make_rows(seed, ["a", "b", "c"], 150, hot_share=0.5, chunk=chunk)
    df = spark.createDataFrame(rows, "chunk long, pos long, idx long, key string, v int, flag boolean")
    # Long equal stretches that span several chunks of the hot key.
    df = df.withColumn("v", F.when((F.col("pos") > 30) & (F.col("pos") < 90), 0).otherwise(F.col("v")))
    df = df.withColumn("flag", F.col("flag") | ((F.col("pos") > 30) & (F.col("pos") < 90)))
    measured = df.withColumn("n", F.lit(1))
    got = sorted(
        (r.key, r.v, r.flag, r.chunk, r.pos, r.n)
        for r in ordered.collapse_runs(measured, ["key"], ["v", "flag"], ["n"]).collect()
    )
    want, open_runs = [], {}
    for chunk, pos, _, key, v, flag in sorted(rows, key=lambda r: r[1]):
        if 30 < pos < 90:
            v, flag = 0, True
        run = open_runs.get(key)
        if run and run[1:3] == [v, flag]:
            run[5] += 1
        else:
            run = open_runs[key] = [key, v, flag, chunk, pos, 1]
            want.append(run)
    assert got == sorted(map(tuple, want))


@pytest.mark.parametrize("chunk", [1, CHUNK, 10**6])
def test_fill_forward(spark, chunk):
    rows = make_rows(6, ["f1", "f2"], 120, hot_share=0.7, chunk=chunk)
    df = spark.createDataFrame(rows, "chunk long, pos long, idx long, file string, v int, flag boolean")
    value = F.when(F.col("flag") & (F.col("v") == 1), F.concat(F.lit("m"), F.col("pos").cast("string")))
    got = {r.pos: r.filled for r in ordered.fill_forward(df, ["file"], value, "filled").collect()}
    want, last = {}, {}
    for _, pos, _, file, v, flag in sorted(rows, key=lambda r: r[1]):
        if flag and v == 1:
            last[file] = f"m{pos}"
        want[pos] = last.get(file)
    assert got == want


def test_rank_within(spark):
    rows = make_rows(7, ["x", "y"], 100, hot_share=0.8)
    df = spark.createDataFrame(rows, "chunk long, pos long, idx long, key string, v int, flag boolean")
    got = {r.pos: r.rank for r in ordered.rank_within(df, ["key"], ["pos"], "rank").collect()}
    want, seen = {}, {}
    for _, pos, _, key, _, _ in sorted(rows, key=lambda r: r[1]):
        seen[key] = want[pos] = seen.get(key, 0) + 1
    assert got == want


def test_first_and_last_per_key_combine_before_the_shuffle(spark):
    df = spark.range(1000).select(
        F.lit(0).cast("long").alias("chunk"), F.col("id").alias("pos"), F.lit("hot").alias("key"),
        (F.col("id") * 2).alias("v"),
    ).repartition(4)
    first = ordered.first_per_key(df, "key", "n")
    assert [(r.v, r.n) for r in first.collect()] == [(0, 1000)]
    assert [r.v for r in ordered.last_per_key(df, "key").collect()] == [1998]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_wide_rows_are_shuffled_once_and_nothing_runs_early(spark):
    df = spark.range(100).select(
        (F.col("id") % 9).cast("string").alias("key"), F.lit(0).cast("long").alias("chunk"),
        F.col("id").alias("pos"), F.lit(0).cast("long").alias("idx"), F.col("id").alias("v"),
    )
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    joined = ordered.latest_before(df.filter("v % 2 = 0"), df.filter("v % 2 = 1"), "key", "hit")
    assert len(tracker.getJobIdsForGroup(None)) == before
    lines = joined._jdf.queryExecution().executedPlan().toString().split("\n")
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(key" in line]
    wide = [i for i in exchanges if any("_probe" in line for line in lines[i + 1 : i + 4])]
    assert len(wide) == 1 and "chunk" in lines[wide[0]].split("hashpartitioning")[1].split(")")[0]
