"""Candidates of several reviewers: selected, grouped by place, and joined with verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_CONFIDENCE, PER_LENS = 80, 3


def select(candidates: DataFrame, changed: DataFrame, least: int = LEAST_CONFIDENCE, per_lens: int = PER_LENS) -> DataFrame:
    """Candidates (lens, seq, slug, path, line, confidence, ...) on changed paths (path) with enough confidence: of each lens
    the first ``per_lens`` in order of seq, a slug once. Adds finding_id, lens and slug together."""
    kept = candidates.where(F.col("confidence") >= least).join(changed.select("path").distinct(), "path", "left_semi")
    first = kept.withColumn("rn_", F.row_number().over(Window.partitionBy("lens", "slug").orderBy("seq"))).where("rn_ = 1")
    few = first.withColumn("rn_", F.row_number().over(Window.partitionBy("lens").orderBy("seq"))).where(F.col("rn_") <= per_lens).drop("rn_")
    return few.withColumn("finding_id", F.concat_ws(":", "lens", F.coalesce("slug", F.lit(""))))


def group(selected: DataFrame) -> DataFrame:
    """(path, line, first_seq, findings): groups of one place, ordered by their first candidate."""
    return selected.groupBy("path", "line").agg(F.min("seq").alias("first_seq"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "finding_id"))), lambda x: x["finding_id"]).alias("findings"))


def verify(selected: DataFrame, verdicts: DataFrame, least: int = LEAST_CONFIDENCE) -> DataFrame:
    """Selected candidates with their outcome: ``confirmed`` needs that verdict, confidence and evidence; ``refuted`` the
    verdict; all else, no verdict included, is ``unverified``. Of several verdicts on a finding the first (seq) counts."""
    v = verdicts.withColumn("rn_", F.row_number().over(Window.partitionBy("finding_id").orderBy("seq"))).where("rn_ = 1")
    v = v.select(F.col("finding_id").alias("f_"), "verdict", F.col("confidence").alias("verdict_confidence"), F.trim(F.coalesce("evidence", F.lit(""))).alias("verdict_evidence"))
    j = selected.join(v, F.col("finding_id") == F.col("f_"), "left").drop("f_")
    sure = (F.col("verdict") == "confirmed") & (F.col("verdict_confidence") >= least) & (F.col("verdict_evidence") != "")
    return j.withColumn("outcome", F.when(F.coalesce(sure, F.lit(False)), "confirmed").when(F.col("verdict") == "refuted", "refuted").otherwise("unverified"))


def counts(verified: DataFrame) -> DataFrame:
    """(confirmed, refuted, unverified, high_priority)."""
    o = F.col("outcome")
    return verified.agg(
        F.count_if(o == "confirmed").alias("confirmed"), F.count_if(o == "refuted").alias("refuted"), F.count_if(o == "unverified").alias("unverified"),
        F.count_if((o == "confirmed") & F.lower("severity").isin("critical", "major")).alias("high_priority"),
    )
