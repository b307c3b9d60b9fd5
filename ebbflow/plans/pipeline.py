"""The scoring-to-action chain as one lazily built DataFrame graph.

``Chain(spark, sf_dir, round)`` exposes each stage as a DataFrame.  Fixed-size
intermediate results (the two tier thresholds, the two tercile edges, the
population baselines) are computed once per chain and passed on as literals;
everything else stays lazy so Catalyst prunes columns and pushes filters into
the scans of each query.  The shared chain writes the scored table (read by six
consumers) once as a Parquet stage, so each consumer reads only its columns and
pushes its filters.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.config import ROUNDS
from ebbflow.operators import features, keyindex, scoring, states
from ebbflow.session import ensure_checkpoint_dir
from ebbflow.sources.buckets import bucketed_stage
from ebbflow.sources.stages import input_identity, run_stage
from ebbflow.sources.testdata import TestTables


_SHARED: dict = {}


class Chain:
    """One prediction round over one set of input tables.

    ``Chain(...)`` is the plain lazy graph.  ``Chain.shared(...)`` (what the
    registered queries use) returns one chain per (application, input identity,
    round) whose scored table - read by every downstream stage - is written
    once as Parquet below ``spark.checkpoint.dir`` (lineage cut, survives
    executor loss, column pruning and pushed filters for every reader), and whose fixed-size intermediate results
    (thresholds, tercile edges, calibrators) are computed once."""

    def __new__(cls, spark: SparkSession, sf_dir: str, round_: str = "v2", persist: bool = False):
        if persist:
            # files replaced under the same path get a chain of their own
            known = _SHARED.get((spark.sparkContext.applicationId, sf_dir, round_))
            if known is not None and known.source == input_identity(spark, sf_dir):
                return known
        return super().__new__(cls)

    def __init__(self, spark: SparkSession, sf_dir: str, round_: str = "v2", persist: bool = False):
        if getattr(self, "_initialised", False):
            return
        self.spark = spark
        self.sf_dir = sf_dir
        self.round = ROUNDS[round_]
        self.tables = TestTables(spark, sf_dir)
        self.persist = persist
        self.source = input_identity(spark, sf_dir) if persist else None
        self._initialised = True
        if persist:
            _SHARED[(spark.sparkContext.applicationId, sf_dir, round_)] = self

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str, round_: str = "v2") -> "Chain":
        return cls(spark, sf_dir, round_, persist=True)

    # -- sources --------------------------------------------------------------
    def transactions(self) -> DataFrame:
        return self.tables.transactions()

    def transactions_to_cutoff(self) -> DataFrame:
        """Fact rows a feature may see; the bound reaches the scan."""
        return self.tables.transactions(date_to=self.round.cutoff)

    def members(self) -> DataFrame:
        return self.tables.members()

    def labels(self) -> DataFrame:
        return self.tables.labels(self.round)

    # -- features -------------------------------------------------------------
    def transaction_features(self) -> DataFrame:
        return features.transaction_features(self.transactions_to_cutoff(), self.round.cutoff,
                                             expire_floor=self.round.expire_floor)

    def member_features(self) -> DataFrame:
        return features.member_features(self.members(), self.round.cutoff)

    def dataset(self) -> DataFrame:
        if self.persist:
            # the materialised scored table holds every dataset column
            return self.scored().select(*[F.col("is_churn_behavioural").alias("is_churn") if c == "is_churn" else c
                                          for c in features.MODELING_COLUMNS])
        return self.build_dataset()

    def build_dataset(self) -> DataFrame:
        return features.modeling_dataset(self.labels(), self.members(), self.transactions_to_cutoff(), self.round.cutoff,
                                         expire_floor=self.round.expire_floor)

    # -- merged states, in buckets of the customer -------------------------------
    def _bucketed(self, name: str, build, cutoff: int | None = None, sort: list[str] | None = None) -> DataFrame:
        ensure_checkpoint_dir(self.spark)
        return bucketed_stage(self.spark, name, build, sort=sort, cutoff=cutoff,
                              source=self.source or input_identity(self.spark, self.sf_dir))

    def monthly_states(self) -> DataFrame:
        """States by customer and month over the whole fact: one stage for every cutoff and round."""
        return self._bucketed("monthly_states", lambda: states.partial_states(
            states.with_month(self.transactions()), ["msno", "month"]), sort=["month", "msno"])

    def state_at(self, cutoff: int) -> DataFrame:
        """The state of each customer at a cutoff: whole months from the stage, the edge month from the fact."""
        edge = states.edge_month(cutoff)
        return states.state_at(self.monthly_states(), cutoff, self.tables.transactions(*edge) if edge else None)

    def snapshot(self, cutoff: int) -> DataFrame:
        """The state at a cutoff as a stage of its own, to go on from."""
        return self._bucketed("customer_states", lambda: self.state_at(cutoff), cutoff)

    def features_from_states(self, state: DataFrame) -> DataFrame:
        return features.features_of(states.aggregates(state), self.round.cutoff, self.round.expire_floor)

    def dataset_from_states(self) -> DataFrame:
        """The modeling dataset over stages in equal buckets: states are merged and labels, members and features
        joined where they lie."""
        labels = self._bucketed("labels", self.labels, self.round.cutoff)
        members = self._bucketed("members", self.members)
        return features.assemble(labels, features.member_features(members, self.round.cutoff),
                                 self.features_from_states(self.state_at(self.round.cutoff)))

    # -- scoring --------------------------------------------------------------
    @cached_property
    def _scored(self) -> DataFrame:
        def build():
            return scoring.attach_scorecard(self.build_dataset())
        # a stage named by input and cutoff: another session over the same input reads it
        return self.committed("scored_chain", build) if self.persist else build()

    def use_scored(self, df: DataFrame) -> None:
        """Read the scored table from a committed stage instead of building it."""
        self.__dict__["_scored"] = df

    def scored(self) -> DataFrame:
        return self._scored

    def sweep(self, score: str = "risk_score_full") -> DataFrame:
        return scoring.threshold_sweep(self.scored(), score)

    @cached_property
    def thresholds(self) -> tuple[float, float]:
        """(medium, high) selected on the full-model sweep."""
        return scoring.collect_thresholds(self.sweep())

    def predictions(self) -> DataFrame:
        medium, high = self.thresholds
        return scoring.assign_tiers(self.scored(), medium, high)

    def committed(self, name: str, build, options: dict[str, str] | None = None) -> DataFrame:
        """The committed stage ``name`` of this input and cutoff, written first if it is not there."""
        ensure_checkpoint_dir(self.spark)
        return run_stage(self.spark, name, build, self.round.cutoff, options=options,
                         source=self.source or input_identity(self.spark, self.sf_dir))

    # -- segments / value / plan ---------------------------------------------
    def segments(self) -> DataFrame:
        from ebbflow.operators import segments
        return segments.assign_segments(self.predictions())

    @cached_property
    def tercile_edges(self) -> tuple[float | None, float | None]:
        from ebbflow.operators import segments
        return segments.collect_tercile_edges(self.scored())

    def value_tiers(self) -> DataFrame:
        from ebbflow.operators import segments
        e1, e2 = self.tercile_edges
        return segments.assign_value_tiers(self.segments(), e1, e2)

    def customer_actions(self) -> DataFrame:
        from ebbflow.operators import segments
        return segments.customer_actions(self.value_tiers())

    # -- calibration ------------------------------------------------------------
    @cached_property
    def calib_split(self) -> DataFrame:
        from ebbflow.operators import calibration as CA
        return CA.with_calib_split(self.predictions())

    @cached_property
    def calibrators(self) -> dict:
        from ebbflow.operators import calibration as CA
        full, proxy = CA.Calibrator.for_scores(self.calib_split, ["risk_score_full", "risk_score_proxy_controlled"])
        return {"full": full, "proxy_controlled": proxy}

    def calibration_comparison(self) -> DataFrame:
        from ebbflow.operators import calibration as CA
        parts = [CA.method_comparison(self.calib_split, cal, m) for m, cal in self.calibrators.items()]
        return parts[0].unionByName(parts[1])

    @cached_property
    def winners(self) -> dict:
        from ebbflow.operators import calibration as CA
        rows = CA.pick_winner(self.calibration_comparison()).collect()  # one row per model
        return {r["model"]: r["winner"] for r in rows}

    def calibrated(self) -> DataFrame:
        """The winning calibrator of each model applied to every customer."""
        df = self.calib_split
        cals, win = self.calibrators, self.winners
        df = cals["full"].add(df, win["full"], "calibrated_probability")
        return cals["proxy_controlled"].add(df, win["proxy_controlled"], "calibrated_probability_proxy_controlled")

    def lookup(self) -> DataFrame:
        """The customer-360 table (segments + scores + value + calibrated)."""
        from ebbflow.operators import serving
        return serving.customer_360(self)

    def lookup_by_key(self) -> DataFrame:
        """The customer-360 table in the order of its keys, with bloom filters: for reads of one key."""
        return self.committed("lookup_by_key", lambda: keyindex.key_ordered(self.lookup()), keyindex.bloom_options("msno"))

    def search_key(self, needle: str) -> DataFrame:
        """Key, tier and segment of the customers whose key holds the needle, from posting lists."""
        table = self.lookup_by_key()
        lists = self.committed("key_postings", lambda: keyindex.postings(table, keep=["risk_tier", "segment"]))
        counts = self.committed("key_posting_counts", lambda: keyindex.posting_counts(lists))
        return keyindex.search(table, lists, counts, needle)

    def unpersist(self) -> None:
        _SHARED.pop((self.spark.sparkContext.applicationId, self.sf_dir, self.round.name), None)
