"""Numbering and capping windows against plain lists, under settings that split and coalesce shuffles."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brightmill.operators.windows import capped, numbered, quantile_bucket


def test_numbers_don_t_depend_on_partitions(spark):
    rng = random.Random(1)
    values = sorted(rng.sample(range(-(10**12), 10**12), 3000) + list(range(5000, 9000)))
    df = spark.createDataFrame([(x, str(x)) for x in values], "first long, url string").groupBy("url").agg(F.min("first").alias("first"))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for partitions, size in (("200", "300k"), ("200", "1k"), ("3", "64m")):
            spark.conf.set(names[0], partitions)
            spark.conf.set(names[1], size)
            assert [(r.first, r.number) for r in numbered(df, "first", "number").orderBy("first").select("first", "number").collect()] == [(x, i) for i, x in enumerate(values, 1)]
    finally:
        for n in names:
            spark.conf.set(n, before[n])
    assert numbered(df.limit(0), "first", "number").count() == 0


def test_capped_samples(spark):
    sizes = {"a": 0, "b": 7, "c": 10, "d": 11, "e": 16, "f": 17, "g": 100}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    random.Random(2).shuffle(rows)
    left = {}
    for k, n in sizes.items():
        kept = []
        for i in range(n):
            kept.append(i)
            if len(kept) > 10:
                kept = kept[-5:]
        left[k] = kept
    got = capped(spark.createDataFrame(rows, "k string, i int"), ["k"], [F.desc("i")], 10, 5).collect()
    assert sorted(map(tuple, got)) == sorted((k, i) for k, kept in left.items() for i in kept)


def test_an_outlier_leaves_buckets_equal(spark):
    df = spark.range(20_000).selectExpr("id as first").union(spark.createDataFrame([(10**15,)], "first long"))
    sizes = [r["count"] for r in df.select(quantile_bucket(df, "first", 200).alias("b")).groupBy("b").count().collect()]
    assert sum(sizes) == 20_001 and max(sizes) <= 200
    assert numbered(df, "first", "number").where("first = 1000000000000000").first().number == 20_001
