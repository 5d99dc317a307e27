"""Values at the very limit of a comparison."""

from __future__ import annotations

import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from parley.operators import series
from parley.plans import QUERIES, SQL

from .compare import assert_same


def test_tenth_percentile_is_rounded_once(spark):
    dice = random.Random(3)
    rows = [(g, round(dice.expovariate(0.02), 2) - 100) for g in range(400) for _ in range(1 + g % 150)] + [(1, None)]
    given = pa.table({"g": [r[0] for r in rows], "v": [r[1] for r in rows]})
    expected = dict(duckdb.sql("select g, quantile_cont(v, 0.1) from given group by g").fetchall())
    found = series.tenth_percentiles(spark.createDataFrame(rows, "g long, v double"), ["g"], "v").collect()
    assert {r["g"]: r["tenth"] for r in found} == expected
    pairs = [(dice.random(), dice.uniform(-100, 100), dice.uniform(-100, 100)) for _ in range(500)]
    found = spark.createDataFrame(pairs, "a double, b double, c double")
    assert [r[0] for r in found.select(series.fused(*(found[x] for x in "abc"))).collect()] == [math.fma(*p) for p in pairs]


def test_price_just_over_the_limit(spark, tmp_path):
    pq.write_table(pa.table({"o_orderkey": [1, 2, 3], "o_custkey": [1, 1, 1], "o_totalprice": [400010.0, 400000.0, 399999.99]}), tmp_path / "orders.parquet")
    db = duckdb.connect()
    db.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet')")
    assert_same(QUERIES["src4_manifest_rows"](spark, str(tmp_path)), SQL["src4_manifest_rows"], db)
