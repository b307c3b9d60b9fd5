"""Published fixture figures (FIXTURES.md §2.3-2.4) reproduced by the Spark chain."""

import pytest
from pyspark.sql import functions as F

from ebbflow.plans.pipeline import Chain

from conftest import SF_MID, SF_SMALL


@pytest.mark.parametrize("sf,ge65,ge95,median,rate", [(SF_SMALL, 22, 0, 35, 0.287), (SF_MID, 236, 8, 38, 0.351)])
def test_scorecard_distribution(spark, sf, ge65, ge95, median, rate):
    s = Chain.shared(spark, sf).scored()
    r = s.agg(F.count_if(F.col("points") >= 65).alias("a"), F.count_if(F.col("points") >= 95).alias("b"),
              F.median("points").alias("m"), F.avg("is_churn").alias("r")).first()
    assert (r["a"], r["b"], r["m"]) == (ge65, ge95, median)
    assert r["r"] == pytest.approx(rate, abs=5e-4)


def test_customers_without_history_and_label_a_rate(spark):
    ds = Chain.shared(spark, SF_MID, "v2").dataset()
    assert ds.where(F.col("has_transactions_data") == 0).count() == 2
    assert ds.agg(F.avg("is_churn")).first()[0] == pytest.approx(0.4693, abs=5e-5)
    v1 = Chain.shared(spark, SF_MID, "v1").dataset()
    assert v1.where(F.col("has_transactions_data") == 0).count() == 4
    assert v1.agg(F.avg("is_churn")).first()[0] == pytest.approx(0.4707, abs=5e-5)


def test_member_coverage_and_negative_tenure(spark):
    ds = Chain.shared(spark, SF_MID, "v2").dataset()
    assert ds.where(F.col("tenure_days_at_cutoff") < 0).count() == 142
    n = ds.count()
    assert ds.agg(F.avg("has_members_data")).first()[0] == pytest.approx(1 - 167 / n, abs=0.01)
