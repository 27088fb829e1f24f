"""Sketches against exact answers; merged parts against the whole."""

import pytest

from tessera.functions import sketches as sk
from tessera.operators.frame import Frame
from tessera.sinks import to_parquet
from tessera.sources.files import from_parquet


def test_distinct_values_of_parts_stored_and_merged(spark, tmp_path):
    f = Frame(spark.range(60_000).selectExpr("id % 3 AS part", "id % 9000 AS v", "CAST(id % 500 AS double) AS d"))
    path = str(tmp_path / "parts")
    f.group_by("part").aggregate(sk.distinct_sketch("v").alias("s"), sk.distinct_sketch("d").alias("t")).write(to_parquet(path))
    merged = from_parquet(spark, path).aggregate(sk.merge_distinct("s").alias("s"), sk.merge_distinct("t").alias("t"))
    row = merged.with_entry("n", sk.distinct_estimate("s")).with_entry("m", sk.distinct_estimate("t")).fetch()[0]
    whole = f.aggregate(sk.distinct_sketch("v").alias("s")).with_entry("n", sk.distinct_estimate("s")).fetch()[0].n
    assert abs(row.n - 9000) < 3 * sk.distinct_error() * 9000 and abs(row.m - 500) < 3 * sk.distinct_error() * 500
    assert abs(row.n - whole) <= 0.02 * 9000


@pytest.mark.parametrize("p", [0.0, 0.01, 0.5, 0.9, 1.0])
def test_quantiles_of_parts(spark, p):
    f = Frame(spark.range(50_000).selectExpr("id % 7 AS part", "CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS v"))
    parts = f.group_by("part").aggregate(sk.quantile_sketch("v").alias("s"))
    row = parts.aggregate(sk.merge_quantiles("s").alias("s")).with_entry("q", sk.quantile("s", p)).with_entry("n", sk.seen("s")).with_entry("r", sk.rank_of("s", 25_000)).fetch()[0]
    assert row.n == 45_000 and abs(row.q - p * 50_000) <= 0.02 * 50_000 and abs(row.r - 0.5) < 0.02
    with pytest.raises(ValueError):
        sk.quantile("s", 2)
