"""Batch jobs: the build-dataset lifecycle and the scoring-to-action chain as
stage outputs (A5, A7, A8, A9, D36).

    python -m ebbflow.plans.jobs --sf-dir /root/testdata/sf0.01 --round v2 [--root <shared folder>]

Each stage is written once under the stage root (default: ``spark.checkpoint.dir``
+ ``/stages``, i.e. the shared folder the cluster names) and reused when it is
already committed, so a rerun after a lost executor or driver only computes the
missing stages.  Quality checks run inside the job and raise on FAIL before
anything downstream is written.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.operators import quality, scoring
from ebbflow.operators import segments as SG
from ebbflow.operators import summary
from ebbflow.plans.pipeline import Chain
from ebbflow.sources import readers, stages


def build_dataset(spark: SparkSession, sf_dir: str, round_: str = "v2", root: str | None = None):
    """§3.1: features at the round's cutoff -> checks -> modeling dataset stage."""
    ch = Chain(spark, sf_dir, round_)
    cutoff, source = ch.round.cutoff, stages.input_identity(spark, sf_dir)

    def build():
        ds = ch.build_dataset()
        quality.raise_on_fail(quality.sanity_checks(ch.labels(), ds, cutoff))
        return ds

    return stages.run_stage(spark, "modeling_dataset", build, cutoff, root, source=source)


def checked_probabilities(df, columns: list[str]):
    """The frame, once every probability is known to be there and inside [0, 1]."""
    wrong = [F.col(c).isNull() | ~F.col(c).between(0.0, 1.0) for c in columns]
    bad = df.where(F.expr("false") if not wrong else reduce(lambda a, b: a | b, wrong)).count()
    if bad:
        raise quality.QualityCheckFailed(f"{bad} calibrated probabilities missing or outside [0, 1]")
    return df


def scoring_chain(spark: SparkSession, sf_dir: str, round_: str = "v2", root: str | None = None) -> dict:
    """§3.2: predictions, segments, value tiers, matrix, plan, calibrated probabilities and the
    summary document, each a committed stage output.  The chain starts from the committed modeling
    dataset and later stages read it, so a rerun computes only what is missing."""
    source = stages.input_identity(spark, sf_dir)
    ch = Chain(spark, sf_dir, round_)
    cutoff = ch.round.cutoff
    dataset = stages.require_stage(spark, "modeling_dataset", cutoff, root, source=source)

    def run(name, build):
        return stages.run_stage(spark, name, build, cutoff, root, source=source)

    # every later stage reads the committed scores
    ch.use_scored(run("scored_customers", lambda: scoring.attach_scorecard(dataset)))
    out = {}
    out["risk_scoring_predictions"] = run("risk_scoring_predictions", lambda: ch.predictions().select(
        "msno", "is_churn", "risk_score_full", "risk_score_proxy_controlled", "risk_tier"))
    out["risk_scoring_threshold_analysis"] = run("risk_scoring_threshold_analysis", ch.sweep)
    out["customer_segments"] = run("customer_segments", lambda: SG.customer_segments(ch.predictions()))
    out["customer_value_tiers"] = run("customer_value_tiers", lambda: SG.customer_value_tiers(ch.value_tiers()))
    out["risk_value_matrix"] = run("risk_value_matrix", lambda: SG.risk_value_matrix(ch.value_tiers()))
    out["marketing_action_plan"] = run("marketing_action_plan", lambda: SG.action_plan_full(ch.customer_actions()))
    # the range check runs before the write: a failing stage is never committed
    out["calibrated_probabilities"] = run("calibrated_probabilities", lambda: checked_probabilities(
        ch.calibrated().select("msno", "is_churn", "risk_tier", "calib_split", "risk_score_full", "calibrated_probability",
                               "risk_score_proxy_controlled", "calibrated_probability_proxy_controlled"),
        ["calibrated_probability", "calibrated_probability_proxy_controlled"]))
    doc_path = stages.stage_path(spark, "risk_scoring_summary", cutoff, root, source)
    readers.write_json_document(summary.risk_summary_document(ch), doc_path)
    return out


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--round", default="v2", choices=sorted(C.ROUNDS))
    ap.add_argument("--root", default=None, help="stage root (default: spark.checkpoint.dir/stages)")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    from ebbflow.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    build_dataset(spark, args.sf_dir, args.round, args.root)
    for name, df in scoring_chain(spark, args.sf_dir, args.round, args.root).items():
        print(name, df.count())


if __name__ == "__main__":
    main()
