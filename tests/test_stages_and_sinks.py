"""Stage runner, required-input guard, sinks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ebbflow.sources import readers, stages


def test_run_stage_builds_once_then_reuses(spark):
    root = tempfile.mkdtemp(prefix="ebbflow-stage-", dir="/tmp")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("C+1/=", 1)], "msno string, n int")

    a = stages.run_stage(spark, "demo", build, cutoff=20010131, root=root)
    b = stages.run_stage(spark, "demo", build, cutoff=20010131, root=root)
    assert len(calls) == 1 and a.collect() == b.collect()
    assert dict(b.dtypes)["msno"] == "string"
    assert os.path.exists(f"{root}/demo/cutoff=20010131/_SUCCESS")


def test_require_stage_names_missing_stage(spark):
    root = tempfile.mkdtemp(prefix="ebbflow-stage-", dir="/tmp")
    with pytest.raises(stages.MissingStageError, match="risk_scoring_predictions"):
        stages.require_stage(spark, "risk_scoring_predictions", root=root)


def test_csv_sink_round_trip_and_queue_export(spark, chain_small):
    out = tempfile.mkdtemp(prefix="ebbflow-sink-", dir="/tmp")
    df = chain_small.predictions().select("msno", "risk_tier", "risk_score_full")
    readers.write_table(df, f"{out}/pred", fmt="csv")
    back = spark.read.option("header", True).schema(df.schema).csv(f"{out}/pred")
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    readers.export_queue(chain_small.lookup().where(F.col("risk_tier") == "High"), f"{out}/queue",
                         ["msno", "risk_tier", "calibrated_probability"])
    assert spark.read.option("header", True).csv(f"{out}/queue").columns == ["msno", "risk_tier", "calibrated_probability"]


def test_summary_document_json_round_trip(spark, chain_small):
    from ebbflow.operators import summary
    out = tempfile.mkdtemp(prefix="ebbflow-json-", dir="/tmp")
    doc = summary.risk_summary_document(chain_small)
    readers.write_json_document(doc, f"{out}/summary")
    back = readers.read_json_document(spark, f"{out}/summary", doc.schema).first()
    assert [t["tier"] for t in back["risk_tiers"]] == ["High", "Medium", "Low"]
    assert back["recommended_thresholds"]["high_risk_threshold"] >= back["recommended_thresholds"]["medium_risk_threshold"]


def test_train_and_test_share_columns(spark):
    from ebbflow.plans.pipeline import Chain
    from conftest import SF_SMALL
    assert set(Chain(spark, SF_SMALL, "v1").dataset().columns) == set(Chain(spark, SF_SMALL, "v2").dataset().columns)


def test_sanity_checks_pass_on_test_tables(chain_small):
    from ebbflow.operators import quality
    checks = quality.sanity_checks(chain_small.labels(), chain_small.dataset(), chain_small.round.cutoff)
    quality.raise_on_fail(checks)
    st = {r["check"]: r["status"] for r in checks.collect()}
    assert st["row_count_preserved"] == "PASS" and st["key_unique"] == "PASS" and st["max_last_transaction_date"] == "PASS"


def test_raise_on_fail(spark):
    from ebbflow.operators import quality
    bad = spark.createDataFrame([("key_unique", 1.0, "FAIL")], "check string, value double, status string")
    with pytest.raises(quality.QualityCheckFailed):
        quality.raise_on_fail(bad)


def test_jobs_write_every_stage_and_reuse(spark):
    from ebbflow.plans import jobs
    from conftest import SF_SMALL
    root = tempfile.mkdtemp(prefix="ebbflow-jobs-", dir="/tmp")
    ds = jobs.build_dataset(spark, SF_SMALL, "v2", root)
    assert ds.count() == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    out = jobs.scoring_chain(spark, SF_SMALL, "v2", root)
    assert out["marketing_action_plan"].count() == 7
    for name in out:
        path = stages.stage_path(spark, name, 20010131, root, stages.input_identity(spark, SF_SMALL))
        assert os.path.exists(f"{path}/_SUCCESS"), name
    again = jobs.scoring_chain(spark, SF_SMALL, "v2", root)  # reuse, no rebuild
    assert again["risk_value_matrix"].count() == 3


def test_two_inputs_under_one_root_do_not_mix(spark):
    from ebbflow.plans import jobs
    from conftest import SF_MID, SF_SMALL
    root = tempfile.mkdtemp(prefix="ebbflow-jobs-", dir="/tmp")
    counts = [jobs.build_dataset(spark, sf, "v2", root).count() for sf in (SF_SMALL, SF_MID, SF_SMALL)]
    assert counts == [150, 1500, 150]


def test_scoring_chain_needs_the_committed_dataset(spark):
    from ebbflow.plans import jobs
    from conftest import SF_SMALL
    root = tempfile.mkdtemp(prefix="ebbflow-jobs-", dir="/tmp")
    with pytest.raises(stages.MissingStageError, match="modeling_dataset"):
        jobs.scoring_chain(spark, SF_SMALL, "v2", root)


@pytest.mark.parametrize("value", [None, 1.5, -0.1])
def test_bad_probabilities_are_never_committed(spark, value):
    from ebbflow.operators import quality
    from ebbflow.plans import jobs
    df = spark.createDataFrame([("a", 0.5), ("b", value)], "msno string, calibrated_probability double")
    with pytest.raises(quality.QualityCheckFailed):
        jobs.checked_probabilities(df, ["calibrated_probability"])


def test_shared_stage_is_pruned_and_pushed(spark):
    from ebbflow.plans.pipeline import Chain
    from conftest import SF_SMALL
    s = Chain.shared(spark, SF_SMALL).scored()
    plan = s.where(F.col("msno") == "C+1/=").select("msno", "risk_score_full")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(msno,C+1/=)" in plan and "ReadSchema: struct<msno:string,risk_score_full:double>" in plan


def test_no_shared_folder_on_a_cluster_is_an_error():
    from ebbflow import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(session.SharedFolderMissing):
        session.ensure_checkpoint_dir(Session())
