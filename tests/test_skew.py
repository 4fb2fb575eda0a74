from collections import Counter

import pytest
from pyspark.sql import functions as F

from relgate.operators.skew import join_key_stats


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("hot_min, max_hot", [(10**9, 5), (1, 10**6), (50, 2), (50, 1), (1, 0)])
def test_every_row_is_matched_once(spark, hot_min, max_hot, adaptive):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 7}" if i % 2 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string")
    stats = (
        df.groupBy("k")
        .agg(F.count("*").alias("n"), F.min("id").alias("first"))
        .filter("n > 1 AND (k IS NULL OR k <> 'k3')")
    )
    sizes = Counter(k for _, k in rows)
    first = {}
    for i, k in rows:
        first.setdefault(k, i)
    expected = sorted((i, k, sizes[k], first[k]) for i, k in rows if k not in (None, "k3"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        found = join_key_stats(df, stats, "k", "n", hot_min, max_hot)
        assert found.columns == ["id", "k", "n", "first"]
        assert sorted(map(tuple, found.collect())) == expected
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
