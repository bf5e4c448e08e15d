"""Calls of the subjects that have images: others go before lines and orders meet."""

import pytest
from pyspark.sql import functions as F

from cortexloom.operators import linear
from cortexloom.plans import analytic
from cortexloom.plans.surrogate import Study


class Seen(Exception):
    pass


def test_orders_of_others_meet_no_lines(spark, sf_dir, monkeypatch):
    def gwas(geno, subjects):
        raise Seen(geno._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(linear, "gwas", gwas)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with more images than are broadcast: only small sides go below an aggregation by themselves
    try:
        with pytest.raises(Seen) as plan:
            analytic.significant_voxels(spark, sf_dir)
    finally:
        spark.conf.set(key, before)
    text = str(plan.value)  # what comes first in the plan runs last
    assert -1 < text.index("Aggregate [l_partkey") < text.index("LeftSemi")


@pytest.mark.parametrize("few", [True, False])
def test_calls_of_subjects(spark, sf_dir, few):
    """Same as all calls without those of others; subjects that are there twice or have no orders change nothing."""
    s = Study(spark, sf_dir)
    ids = s.table("customer").select(F.col("c_custkey").alias("iid")).where("iid % 7 = 3" if few else "true")
    odd = ids.unionByName(ids).unionByName(spark.createDataFrame([(10**9,), (None,)], "iid long"))
    want = {tuple(r) for r in s.geno.join(ids, "iid", "left_semi").select("variant", "iid", "dosage").collect()}
    got = [tuple(r) for r in s.geno_of(odd).select("variant", "iid", "dosage").collect()]
    assert len(got) == len(want) > 0 and set(got) == want
