"""The history of a stream equals that of all its reports, whatever the order they arrive in and wherever it stops."""

import datetime
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from provenir.streaming import history

START = datetime.datetime(2024, 1, 1)
SCHEMA = "report_id string, created timestamp, extra string"


def expected(rows, most):
    best = {}
    for key, at, _ in rows:
        if key is not None and at is not None:
            best[key] = max(at, best.get(key, at))
    return sorted(best.items(), key=lambda e: (e[1], e[0]), reverse=True)[:most]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_a_restart(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(f"r{r.randrange(60)}", START + datetime.timedelta(minutes=r.randrange(90)), "x") for _ in range(150)]
    rows += rows[:10] + [(None, START, "y"), ("none", None, "z")]
    r.shuffle(rows)
    most, parts = 7, 3
    stream = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    read = lambda: spark.read.parquet(f"{tmp_path}/out")
    for half in range(2):
        for i in range(2):
            k = half * 2 + i
            spark.createDataFrame(rows[k::4], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        history.keeping(stream(), f"{tmp_path}/out", f"{tmp_path}/state", most=most, parts=parts).awaitTermination()
        seen = [x for k in range(half * 2 + 2) for x in rows[k::4]]
        got = [(x.key, START + datetime.timedelta(microseconds=x.at - int(START.replace(tzinfo=datetime.UTC).timestamp() * 1e6))) for x in history.newest(read(), most).collect()]
        assert got == expected(seen, most)
    assert not read().where("not kept").isEmpty()
    left = history.newest(read(), 1000)
    assert left.count() <= most * parts  # what left is not held


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 20)), max_size=40), st.integers(1, 5), st.randoms())
def test_merging_in_any_order(pairs, most, r):
    mixed = list(pairs)
    r.shuffle(mixed)
    held = {}
    for i in range(0, len(mixed), 3):
        held = history.merged(held, mixed[i : i + 3], most)
    assert held == history.merged({}, pairs, most) == dict(expected([(k, at, None) for k, at in pairs], most))
