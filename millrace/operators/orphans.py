"""References to records that do not exist, are deleted, or come later.

Parent and child keys are put in long form under the parent table's tag and grouped by (parent table, key, hour): a
map-side combining aggregate, so that a hot key costs a few rows a task. What a child needs of the hours before its own
is a running maximum over those groups, whose number per key is bounded by the hours the data spans, never by its rows.
Only children that share the hour of one of their parents are compared with parent rows themselves, by an equi-join on
(table, key, hour) that adaptive execution may split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for "never deleted".
FOREVER = "9999-12-31 23:59:59"
#: Columns of the long form; inputs are projected to these, so that other columns of theirs can clash with nothing.
_T, _K, _H = "ref_table", "ref_key", "ref_hour"


@dataclass(frozen=True)
class Parent:
    """Rows of ``df`` under the tag ``table`` hold from ``created`` until ``deleted`` (None: for good)."""

    df: DataFrame
    table: str
    key: str
    created: str = "created_at"
    deleted: str | None = "deleted_at"


@dataclass(frozen=True)
class Child:
    """Rows of ``df`` that refer by ``key`` to the parent tag ``table`` at the time ``created``."""

    df: DataFrame
    record_type: str
    table: str
    key: str
    record_id: str = "record_id"
    created: str = "created_at"


def normal_key(c: Column) -> Column:
    """Without surrounding white space and letter case; null when nothing is left."""
    bare = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def _hour(c: Column) -> Column:
    return F.date_trunc("hour", c.cast("timestamp_ntz")).cast("timestamp_ntz")


def _parents(parents: list[Parent]) -> DataFrame:
    out = None
    for p in parents:
        until = F.col(p.deleted).cast("timestamp_ntz") if p.deleted else F.lit(None).cast("timestamp_ntz")
        one = p.df.select(
            F.lit(p.table).alias(_T),
            normal_key(F.col(p.key)).alias(_K),
            F.col(p.created).cast("timestamp_ntz").alias("from_t"),
            F.coalesce(until, F.lit(FOREVER).cast("timestamp_ntz")).alias("until_t"),
        ).where(F.col(_K).isNotNull())
        out = one if out is None else out.unionByName(one)
    return out.withColumn(_H, _hour(F.col("from_t")))


def _children(children: list[Child]) -> DataFrame:
    out = None
    for c in children:
        one = c.df.select(
            F.lit(c.record_type).alias("record_type"),
            F.col(c.record_id).alias("record_id"),
            F.lit(c.table).alias(_T),
            normal_key(F.col(c.key)).alias(_K),
            F.col(c.created).cast("timestamp_ntz").alias("at_t"),
        ).where(F.col(_K).isNotNull())
        out = one if out is None else out.unionByName(one)
    return out.withColumn(_H, _hour(F.col("at_t")))


def find_orphans(children: list[Child], parents: list[Parent]) -> DataFrame:
    """(record_type, record_id, ref_table, ref_key, created_month, reason), one distinct row per orphan reference.

    reason: ``missing`` no parent row has the key; ``late`` all of them came after the child; ``deleted`` otherwise.
    Null and blank references give nothing. A child without a time can't be held by any parent: ``missing`` or
    ``deleted``, its month null. A parent without a time has its key but never holds. Repeated rows of either side
    change nothing. Empty parents make every reference ``missing``; empty children give an empty result.
    """
    up, down = _parents(parents), _children(children)
    long = up.select(_T, _K, _H, F.lit(True).alias("is_parent"), "from_t", "until_t").unionByName(
        down.select(_T, _K, _H, F.lit(False).alias("is_parent")), allowMissingColumns=True
    )
    # A deletion at or before the creation never holds, but the row still has the key and the time.
    groups = long.groupBy(_T, _K, _H).agg(
        F.max("is_parent").alias("here"),
        F.min("from_t").alias("first_t"),
        F.max(F.when(F.col("until_t") > F.col("from_t"), F.col("until_t"))).alias("last_t"),
        F.max(~F.col("is_parent")).alias("wanted"),
    )
    whole = Window.partitionBy(_T, _K)
    # Hour order with nulls first: parents without a time are passed by everyone but give no times.
    before = whole.orderBy(F.col(_H).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    status = (
        groups.withColumn("known", F.max("here").over(whole))
        .withColumn("earliest", F.min("first_t").over(before))
        .withColumn("reach", F.max("last_t").over(before))
        .withColumn("timeless", F.max(F.col("here") & F.col("first_t").isNull()).over(whole))
        .where("wanted")
        .select(_T, _K, _H, "known", "earliest", "reach", "timeless", F.coalesce(F.col("here") & F.col(_H).isNotNull(), F.lit(False)).alias("close"))
    )
    s = status.select(F.col(_T).alias("t_"), F.col(_K).alias("k_"), F.col(_H).alias("h_"), "known", "earliest", "reach", "timeless", "close")
    left = down.join(s, (F.col(_T) == F.col("t_")) & (F.col(_K) == F.col("k_")) & F.col(_H).eqNullSafe(F.col("h_")))
    # Held by a parent of an earlier hour: done with.
    open_ = left.where(~F.coalesce(F.col("at_t").isNotNull() & (F.col("reach") > F.col("at_t")), F.lit(False)))
    seen = F.when(F.col("at_t").isNotNull() & F.col("earliest").isNotNull(), True).otherwise(False)
    keep = ["record_type", "record_id", _T, _K, "at_t"]
    far = open_.where(~F.col("close")).select(*keep, "known", seen.alias("seen"), "timeless")
    p = up.select(F.col(_T).alias("pt"), F.col(_K).alias("pk"), F.col(_H).alias("ph"), "from_t", "until_t")
    near = (
        open_.where("close")
        .select(*keep, _H, "known", seen.alias("seen"), "timeless")
        .join(p, (F.col(_T) == F.col("pt")) & (F.col(_K) == F.col("pk")) & (F.col(_H) == F.col("ph")) & (F.col("from_t") <= F.col("at_t")), "left")
        .groupBy(*keep)
        .agg(
            F.max("known").alias("known"),
            F.max(F.col("seen") | F.col("from_t").isNotNull()).alias("seen"),
            F.max("timeless").alias("timeless"),
            F.max(F.coalesce(F.col("until_t") > F.col("at_t"), F.lit(False))).alias("held"),
        )
        .where("not held")
        .drop("held")
    )
    late = ~F.col("seen") & ~F.coalesce(F.col("timeless"), F.lit(False)) & F.col("at_t").isNotNull()
    reason = F.when(~F.coalesce(F.col("known"), F.lit(False)), "missing").when(late, "late").otherwise("deleted")
    return (
        far.unionByName(near)
        .select("record_type", "record_id", _T, _K, F.date_format("at_t", "yyyy-MM").alias("created_month"), reason.alias("reason"))
        .distinct()
    )


def count_orphans(orphans: DataFrame, by: tuple[str, ...] = ("record_type", "created_month", "reason")) -> DataFrame:
    """Orphan references per record type, period and reason."""
    return orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("orphan_count"))
