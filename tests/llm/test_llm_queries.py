"""The training-data queries against their SQL, and the results' invariants, on the smallest tables."""

import pytest
from oracle import SF, check

from lotmill.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, name):
    check(spark, name, q.QUERIES[name], q.SQL[name])


def test_splits_keep_lots_together_and_reach_the_shares(spark):
    from pyspark.sql import functions as F

    from lotmill.functions.names import picture, plain_lot

    dealt = q.p4_assignment(spark, SF)
    rows = spark.read.parquet(f"{SF}/manifest.parquet").select("row_id", plain_lot(F.col("lot_id")).alias("lot"), picture(F.col("visa_source")).alias("pic")).join(dealt, "row_id")
    assert rows.count() == spark.read.parquet(f"{SF}/manifest.parquet").count()
    for key in ("lot", "pic"):
        assert rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0


def test_containers_hold_every_token(spark):
    from pyspark.sql import functions as F

    from lotmill.llm.tokens import count_tokens

    packed, docs = q.p6_containers(spark, SF), spark.read.parquet(f"{SF}/documents.parquet")
    want = count_tokens(docs).agg(F.sum("tokens")).first()[0]
    caps = {r.spec_id: r.capacity_tokens for r in spark.read.parquet(f"{SF}/pack_specs.parquet").collect()}
    for spec, cap in caps.items():
        mine = packed.where(F.col("spec_id") == spec)
        assert mine.agg(F.sum("tokens")).first()[0] == want and mine.select("doc_id").distinct().count() == docs.count()
        assert mine.groupBy("container_id").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] <= cap
        assert mine.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).where((F.col("n") > 1) & (F.col("t") <= cap)).count() == 0


def test_mixture_respects_caps(spark):
    uses, caps = q.p7_uses(spark, SF), spark.read.parquet(f"{SF}/mix_targets.parquet")
    assert uses.join(caps, "source").where("uses > max_repeat").count() == 0
    shares = q.p7_shares(spark, SF).collect()
    assert abs(sum(r.actual_share for r in shares) - 1) < 1e-9 and len(shares) == caps.count()


def test_truncation_rates_agree_with_the_documents(spark):
    from pyspark.sql import functions as F

    rates = q.p8_rates(spark, SF)
    assert rates.agg(F.sum("truncated")).first()[0] == q.p8_found(spark, SF).count()
    assert rates.agg(F.sum("documents")).first()[0] == spark.read.parquet(f"{SF}/documents.parquet").count()
