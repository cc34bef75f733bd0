import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktide.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def prepared(df):
    return negatives.prepared(df, "vec_id", "embedding", F.col("label"))


def mined(df, **how):
    rows = negatives.mine(prepared(df), F.col("id") % 10 == 0, **how).collect()
    return sorted(map(tuple, rows), key=str)


def plain(data):
    rows = []
    for i, vector, label in data:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in vector]
        rows.append((i, label, whole, i is not None and i % 10 == 0))
    return sorted(negatives.brute_force(rows), key=str)


def vectors(seed, count, width=6, steps=8):
    """Coarse components, so that scores tie often."""
    rng = random.Random(seed)
    return [
        (i, [rng.randint(-steps, steps) / 64 for _ in range(width)], rng.choice([0, 0, 0, 1, 2])) for i in range(count)
    ]


@pytest.mark.parametrize("block_rows", [7, 64, 10_000])
def test_equals_brute_force(spark, block_rows):
    data = vectors(1, 300)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert mined(df, block_rows=block_rows, anchor_rows=9) == plain(data)


def test_hard_rows(spark):
    data = vectors(2, 60, width=3)
    data += [(100, None, 1), (101, [0.1, None, 0.2], 1), (110, [float("nan"), 0.0, 0.0], 1), (120, [0.1, 0.2, 0.3], None),
             (130, [float("inf"), 0.0, 0.0], 0), (140, [], 1), (141, [], 0), (150, [0.0, 0.0, 0.0], 2), (160, [0.5], 2),
             (170, [3e5, -3e5, 0.1], 1), (171, [3e5, -2.9e5, 0.1], 0), (172, [2.9e5, -3e5, 0.1], 1),
             (None, [0.1, 0.1, 0.1], 1), (20, data[20][1], data[20][2]), (20, data[20][1], data[20][2]), (30, data[31][1], 7)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert mined(df, block_rows=16, anchor_rows=4) == plain(data)


def test_clashing_columns_and_empty_table(spark):
    data = vectors(3, 50)
    df = spark.createDataFrame(data, SCHEMA)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("uid", "id", "block", "score", "rank", "vector", "slot")])
    assert mined(clash) == plain(data)
    assert mined(df.limit(0)) == []


def block_of(matrix, labels):
    import pyarrow as pa

    n = len(matrix)
    table = pa.table({
        "uid": pa.array(range(n), pa.int64()), "id": pa.array(range(n), pa.int64()), "label": pa.array(labels, pa.int32()),
        "vector": pa.array(matrix.tolist(), pa.list_(pa.int64())), "block": pa.array([0] * n, pa.int32()),
    })
    return negatives.Lists(negatives._build(table).to_pylist()[0])


def test_search_stops_before_the_lists_end():
    rng = np.random.default_rng(4)
    matrix = rng.integers(-100, 100, (5000, 4))
    block = block_of(matrix, [0] * 5000)
    anchor = np.array([90, -3, 0, 50])
    everywhere = np.ones(5000, bool)
    low, high = np.array([-(2**62)]), np.array([2**62])
    best, _, depth = block.search(anchor, everywhere, low, high, 5)
    scores = matrix @ anchor
    assert depth < 2000
    assert best[0].tolist() == sorted(range(5000), key=lambda i: (-scores[i], i))[:5]


def test_ties_at_the_threshold_are_met():
    # Equal vectors: the smallest ids must win although every list starts with other rows.
    matrix = np.full((200, 3), 5)
    block = block_of(matrix, [0] * 200)
    best, _, depth = block.search(np.array([1, 1, -1]), np.ones(200, bool), np.array([-(2**62)]), np.array([2**62]), 3, 1)
    assert best[0].tolist() == [0, 1, 2] and depth == 200


def test_large_components_stay_exact():
    rng = np.random.default_rng(5)
    matrix = rng.integers(-(2**40), 2**40, (50, 2))
    block = block_of(matrix, [0] * 50)
    anchor = np.array([2**20 + 1, -(2**21) + 3])
    best, scores, _ = block.search(anchor, np.ones(50, bool), np.array([-(2**62)]), np.array([2**62]), 50)
    assert scores[best[0]].tolist() == sorted((int(a) * int(anchor[0]) + int(b) * int(anchor[1]) for a, b in matrix), reverse=True)


def test_tiles_are_not_broadcast(spark, monkeypatch):
    # Copies of the anchors for every block of rows look small to the planner, but grow with the square of the table.
    seen = []

    def broadcast(df):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
        for at, line in enumerate(lines):
            if "BroadcastExchange" in line:
                below = next((i for i in range(at + 1, len(lines)) if depth[i] <= depth[at]), len(lines))
                yield "\n".join(lines[at:below])

    def staged(df):
        seen.extend(broadcast(df))
        return stage(df)

    stage = negatives.stage
    monkeypatch.setattr(negatives, "stage", staged)
    df = spark.createDataFrame(vectors(6, 200), SCHEMA)
    found = negatives.mine(prepared(df), F.col("id") % 10 == 0, block_rows=8, anchor_rows=4)
    seen.extend(broadcast(found))
    assert seen, "the small sides of the result's joins"
    assert not [plan for plan in seen if "vectors" in plan]


def test_anchors_of_several_tasks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "HELD", 2)
    data = vectors(7, 300)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert mined(df, block_rows=40, anchor_rows=3) == plain(data)
