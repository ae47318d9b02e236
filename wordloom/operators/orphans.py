"""References to records that do not exist, found by runs of parent keys.

Parent keys are compressed into runs of consecutive integers.  Each reference is
matched as-of to the run that starts at or before it; a key beyond the run's end
has no parent.  A run also carries from when and until when its keys are valid.  It
holds only keys that are valid over all the time in which its bucket is referred to;
any other key is a run of its own, so that its own times decide.  What is left for an
exact check against the parent rows are references to ids stored in several versions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import shuffle_partitions
from wordloom.storage import materialize


@dataclass(frozen=True)
class Reference:
    """One referring column: ``frame`` holds ``key``, ``at`` (load time) and ``row``."""

    field: str
    target: str
    frame: DataFrame
    key: str
    at: str
    row: str
    skip: Column | None = None


@dataclass(frozen=True)
class Parent:
    """A referred table: ``frame`` holds ``id``, ``since`` and ``until`` (null: still valid)."""

    target: str
    frame: DataFrame
    id: str
    since: str
    until: str


#: Keys per bucket, a power of two: a run never crosses a bucket, so buckets are independent.
BUCKET_BITS = 14
#: References that one task matches at most, about.
TASK_ROWS = 1 << 21
#: Hot buckets up to which their list is broadcast.
HOT_LISTED = 100_000
_FAR = "TIMESTAMP_NTZ'9999-12-31 23:59:59'"


def key_runs(parents: Sequence[Parent], bits: int = BUCKET_BITS, spans: DataFrame | None = None) -> DataFrame:
    """Runs of consecutive parent ids: target, bucket, run_start, run_end and four bounds.

    ``sure_from``/``sure_to``: every id of the run is valid in [from, to).
    ``never_before``/``never_from``: no id of the run is valid before / from then on.
    ``spans`` (target, bucket, first_at, last_at): when a bucket is referred to; a key
    that is not valid all that time is a run of its own, and so is an id stored in
    several differing versions, which is never "sure", so that its references go to the
    exact check.  Null ids are left out.
    """
    far, frames = F.expr(_FAR), []
    for p in parents:
        frames.append(
            p.frame.select(
                F.lit(p.target).alias("target"),
                F.col(p.id).cast("bigint").alias("id"),
                F.col(p.since).cast("timestamp_ntz").alias("since"),
                F.coalesce(F.col(p.until).cast("timestamp_ntz"), far).alias("until"),
            ).where("id is not null and since is not null")
        )
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    ids = rows.groupBy("target", "id").agg(
        F.min("since").alias("s0"), F.max("since").alias("s1"), F.min("until").alias("u0"), F.max("until").alias("u1")
    )
    one = (F.col("s0") == F.col("s1")) & (F.col("u0") == F.col("u1"))
    ids = ids.select(
        "target", "id", F.shiftright("id", bits).alias("bucket"),
        F.when(one, F.col("s1")).otherwise(far).alias("sure_from"), "u0", "s0", "u1",
    )
    calm = F.col("sure_from") < far
    if spans is not None:
        ids = ids.join(spans.select("target", "bucket", "first_at", "last_at"), ["target", "bucket"], "left")
        calm &= F.coalesce((F.col("sure_from") <= F.col("first_at")) & (F.col("u0") > F.col("last_at")), F.lit(True))
    ids = ids.withColumn("calm", calm)
    w = Window.partitionBy("target", "bucket", "calm").orderBy("id")
    return (
        ids.withColumn("island", F.when(F.col("calm"), F.col("id") - F.row_number().over(w)).otherwise(F.col("id")))
        .groupBy("target", "bucket", "calm", "island")
        .agg(
            F.min("id").alias("run_start"), F.max("id").alias("run_end"),
            F.max("sure_from").alias("sure_from"), F.min("u0").alias("sure_to"),
            F.min("s0").alias("never_before"), F.max("u1").alias("never_from"),
        )
        .drop("calm", "island")
    )


def dangling_references(references: Sequence[Reference], parents: Sequence[Parent], bits: int = BUCKET_BITS) -> DataFrame:
    """Rows whose reference finds no parent valid at their load time.

    Returns ref_field, ref_month (``yyyy-MM`` of the load time), row_key and
    ref_key, one row per distinct referring row.  A null reference is no case; a
    null load time never finds a parent and comes out with a null month; a parent
    without load time is never valid.  A bucket with many references (a hot key)
    is spread over salts, and the runs of that bucket alone are repeated for them.
    """
    spark = parents[0].frame.sparkSession
    frames = []
    for r in references:
        f = r.frame.where(F.col(r.key).isNotNull())
        if r.skip is not None:
            f = f.where(~F.coalesce(r.skip, F.lit(False)))
        frames.append(
            f.select(
                F.lit(r.field).alias("ref_field"), F.lit(r.target).alias("target"),
                F.col(r.key).cast("bigint").alias("ref_key"), F.col(r.at).cast("timestamp_ntz").alias("at"),
                F.col(r.row).cast("bigint").alias("row_key"),
            )
        )
    refs = frames[0]
    for f in frames[1:]:
        refs = refs.unionByName(f)
    refs = refs.withColumn("bucket", F.shiftright("ref_key", bits))

    # Buckets above an equal share: fewer than the tasks, and their list is one row each.
    spans = refs.groupBy("target", "bucket").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    spans = materialize(spans, "reference-spans")
    total = spans.agg(F.sum("count")).first()[0] or 0
    tasks = max(shuffle_partitions(spark), -(-total // TASK_ROWS))
    share = max(1, -(-total // (4 * tasks)))
    salts = spans.where(F.col("count") > share).select("target", "bucket", F.ceil(F.col("count") / share).alias("salts"))

    runs = key_runs(parents, bits, spans).join(salts, ["target", "bucket"], "left")
    runs = runs.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.coalesce("salts", F.lit(1)) - 1).cast("int"))))
    # The list is joined to all references without moving them while it is small.
    few = salts.count() <= HOT_LISTED
    refs = refs.join(F.broadcast(salts) if few else salts, ["target", "bucket"], "left")
    refs = refs.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row_key"), F.col("salts"))).cast("int"))

    bounds = ["run_end", "sure_from", "sure_to", "never_before", "never_from"]
    left = runs.select("target", "bucket", "salt", F.col("run_start").alias("pos"), F.lit(0).alias("kind"), F.struct(*bounds).alias("run"))
    right = refs.select("target", "bucket", "salt", F.col("ref_key").alias("pos"), F.lit(1).alias("kind"), "ref_field", "row_key", "at")
    w = Window.partitionBy("target", "bucket", "salt").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = (
        left.unionByName(right, allowMissingColumns=True)
        .repartition(tasks, "target", "bucket", "salt")
        .withColumn("run", F.last("run", ignorenulls=True).over(w))
        .where("kind = 1")
    )
    open_ = matched.where(
        "run is null or pos > run.run_end or at is null or at < run.sure_from or at >= run.sure_to"
    ).withColumn(
        "surely", F.expr("run is null or pos > run.run_end or at is null or at < run.never_before or at >= run.never_from")
    )
    cases = open_.select("ref_field", "target", F.col("pos").alias("ref_key"), "at", "row_key", "surely").distinct()

    # Ids in several versions: ask the parent rows.  Settled cases carry a key of their own row instead of
    # the parent's, so that they pass the anti join spread out and without a match.
    live = None
    for p in parents:
        f = p.frame.select(
            F.lit(p.target).alias("p_target"), F.col(p.id).cast("bigint").alias("p_id"),
            F.col(p.since).cast("timestamp_ntz").alias("since"), F.col(p.until).cast("timestamp_ntz").alias("until"),
        ).where("p_id is not null and since is not null")
        live = f if live is None else live.unionByName(f)
    asked = cases.withColumn("ask_target", F.when(F.col("surely"), F.lit("")).otherwise(F.col("target"))).withColumn(
        "ask", F.when(F.col("surely"), F.col("row_key")).otherwise(F.col("ref_key"))
    )
    found = asked.join(
        live,
        (F.col("ask_target") == F.col("p_target")) & (F.col("ask") == F.col("p_id"))
        & (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at"))),
        "left_anti",
    )
    return found.select("ref_field", F.date_format("at", "yyyy-MM").alias("ref_month"), "row_key", "ref_key")
