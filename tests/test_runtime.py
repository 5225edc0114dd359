import random

import pytest
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm import simhash
from stratalens.operators import components


@pytest.mark.parametrize("bound, bits", [(200_000, 23), (5, 23), (5, 7)])
def test_matching_splits_rows(spark, monkeypatch, bound, bits):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(runtime, "BITMAP_BITS", bits)
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(200)]), i, "c") for i in range(900)]
    wanted = {None, *range(0, 150, 3)}
    df = spark.createDataFrame(rows, "id long, key int, word string")
    keys = runtime.materialize(spark.createDataFrame([(k,) for k in wanted] * 2, "id long"))
    for keep in (True, False):
        out = runtime.matching(df, F.col("id"), keys, keep)
        assert out.columns == df.columns
        assert sorted(r.key for r in out.collect()) == [i for k, i, _ in rows if (k in wanted) == keep]


@pytest.mark.parametrize("least, most", [(1 << 15, 1), (10, 3)])
def test_few_rows_take_few_files(spark, monkeypatch, least, most):
    monkeypatch.setattr(runtime, "PACKED_ROWS", least)
    files = {}

    def written(df, name="part", drop=False):
        out = runtime.materialize(df, name, drop)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "materialize", written)
    monkeypatch.setattr(simhash, "materialize", written)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(i, " ".join(f"w{i // 3}x{j}" for j in range(30))) for i in range(30)], "doc_id long, text string")
        assert simhash.deduplicate(docs).count() == 10
        counted = list(files["links"])
        path = spark.createDataFrame([(i, i + 1) for i in range(14)], "src long, dst long")
        assert [r.component for r in components.connected_components(path).collect()] == [0] * 15
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    small = [n for name in ("step", "found", "least", "groups", "rooted", "final", "state") for n in files[name]]
    assert max(small + counted) <= most
    # more rows than may be broadcast stay as they are dealt
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 5)
    dealt = spark.range(0, 100, 1, 6)
    assert runtime.packed(dealt, 6).rdd.getNumPartitions() == 6 and runtime.packed(dealt, 5).rdd.getNumPartitions() == 1


def test_spread_keeps_rows(spark):
    df = spark.range(0, 1000, 1, 1).toDF("id")
    assert runtime.spread(df).rdd.getNumPartitions() == 8 and runtime.spread(df).count() == 1000
