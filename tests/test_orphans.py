"""Orphan references against brute force, with the cases the docstring defines."""

import datetime as dt
import random

from pyspark.sql import functions as F

from kgweave.operators.orphans import orphan_references, orphan_report

REFS = "rid bigint, key string, at timestamp_ntz, loaded_at string, since string"
RECORDS = "key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, at string"


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=6 * n)


def brute(refs, records):
    out = set()
    for rid, key, at, *_ in refs:
        if key is None or not key.strip():
            continue
        mine = [(a, b) for k, a, b, _ in records if k == key and a is not None and (b is None or b > a)]
        if not mine or (at is not None and not any(a <= at and (b is None or b > at) for a, b in mine)):
            out.add(rid)
    return out


def run(spark, refs, records, **kw):
    found = orphan_references(spark.createDataFrame(refs, REFS).drop("since"), spark.createDataFrame(records, RECORDS), **kw)
    return found


def test_against_brute_force(spark):
    rng = random.Random(1)
    keys = [None, "", " ", *"abcdefgh"]
    records = [(rng.choice(keys), day(rng.choice([None, *range(40)])), day(rng.choice([None, *range(40)])), "x") for _ in range(80)]
    refs = [(i, "a" if i % 3 == 0 else rng.choice([*keys, "zz"]), day(rng.choice([None, *range(45)])), "x", "y") for i in range(400)]
    for share in (0.0001, 0.2, 1.0):
        got = {r["rid"] for r in run(spark, refs + refs[:20], records + records[:9], share=share).select("rid").collect()}
        assert got == brute(refs, records)


def test_defined_results(spark):
    refs = [(1, "a", day(4), None, None), (2, "a", day(8), None, None), (3, "a", None, None, None), (4, "b", None, None, None), (5, None, day(1), None, None), (6, "  ", day(1), None, None), (7, "x" * 100_000, day(1), None, None)]
    records = [("a", day(4), day(8), None), ("a", day(5), day(5), None), (None, day(1), None, None)]
    assert {r["rid"] for r in run(spark, refs, records).collect()} == {2, 4, 7}


def test_empty_tables(spark):
    refs, records = [(1, "a", day(1), None, None)], [("a", day(1), None, None)]
    assert run(spark, [], records).count() == 0
    assert run(spark, refs, []).count() == 1
    assert run(spark, refs, records).count() == 0


def test_report(spark):
    refs = [(i, "a" if i % 2 else "b", day(i), None, None) for i in range(10)]
    df = spark.createDataFrame(refs, REFS).withColumn("side", F.lit("s"))
    lost = orphan_references(df, spark.createDataFrame([("a", day(0), None, None)], RECORDS))
    row = orphan_report(lost, df, ["side"]).collect()[0]
    assert (row["n_references"], row["n_keys"], row["n_orphans"], row["n_orphan_keys"]) == (10, 2, 5, 1)
