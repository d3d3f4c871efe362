from datetime import datetime as D

from pyspark.sql import functions as F

from lotmill.operators.orphans import Child, Parent, orphan_report, orphans

KIDS = "row_id bigint, lot string, at timestamp_ntz, ref_key string, step int"
REG = "lot string, a timestamp_ntz, z timestamp_ntz, kind int"


def run(spark, kids, reg, rows_per_group=50_000):
    k, r = spark.createDataFrame(kids, KIDS), spark.createDataFrame(reg, REG)
    return orphans([Parent("reg", r, F.col("lot"), F.col("a"), F.col("z"))], [Child("k", k, "reg", F.col("lot"), F.col("row_id"), F.col("at"))], rows_per_group)


def test_validity_is_inclusive_then_exclusive(spark):
    kids = [(i, "x", D(2025, 1, d), None, None) for i, d in enumerate((1, 2, 3, 4))]
    found = run(spark, kids, [("x", D(2025, 1, 2), D(2025, 1, 4), 9)])
    assert sorted(r.row_id for r in found.collect()) == [0, 3]


def test_nulls_repeats_and_inverted_validities(spark):
    kids = [(1, None, D(2025, 1, 1), None, None), (2, "x", None, None, None), (3, "x", D(2025, 1, 5), None, None), (3, "x", D(2025, 1, 5), None, None), (4, "y", D(2025, 1, 5), None, None)]
    reg = [("x", D(2025, 1, 6), D(2025, 1, 2), 0), ("x", None, None, 0), (None, D(2025, 1, 1), None, 0), ("y", D(2025, 1, 1), None, 0), ("y", D(2025, 1, 1), None, 0)]
    assert sorted(r.row_id for r in run(spark, kids, reg).collect()) == [2, 3, 3]


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    assert run(spark, [(1, "x", D(2025, 1, 1), None, None)], []).count() == 1
    assert orphan_report(run(spark, [], [])).count() == 0


def test_hot_key_is_salted_without_changing_the_result(spark):
    kids = [(i, "hot" if i % 3 else "cold", D(2025, 1, 1 + i % 28), None, None) for i in range(3000)]
    reg = [("hot", D(2025, 1, 5), D(2025, 1, 9), 0), ("hot", D(2025, 1, 8), D(2025, 1, 20), 0), ("cold", D(2025, 1, 20), None, 0)]
    whole, cut = run(spark, kids, reg), run(spark, kids, reg, rows_per_group=50)
    a, b = (sorted(r.row_id for r in x.collect()) for x in (whole, cut))
    want = [i for i in range(3000) if not (5 <= 1 + i % 28 < 20 if i % 3 else 1 + i % 28 >= 20)]
    assert a == b == want


def test_several_parents_without_validity(spark):
    k = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, ref string").withColumn("at", F.lit(None).cast("timestamp_ntz"))
    p, q = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("b",)], "k string")
    found = orphans([Parent("p", p, F.col("k")), Parent("q", q, F.col("k"))], [Child("t", k.withColumn("at", F.lit("2025-01-01").cast("timestamp_ntz")), "p", F.col("ref"), F.col("id"), F.col("at"))])
    assert [(r.row_id, r.parent_table) for r in found.collect()] == [(2, "p")]
