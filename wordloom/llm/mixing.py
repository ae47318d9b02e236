"""Mixing sources to target shares along a time-varying curriculum.

Each source has a weight at every moment of training, a schedule of points joined by
lines; the default is one line from ``share * (1 - tilt)`` to ``share * (1 + tilt)``.
Over the whole run a source takes its share of all tokens, whatever its schedule.
Integrating the schedule gives the tokens of the source used up to a moment; its
inverse gives every record, by the tokens before it in its source, the moment at which
it is used.  The records are then sorted by that position.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.prefixsum import prefix_sum
from wordloom.storage import materialize

#: Records that one window sums, about: hash ranges per source follow from it.
CHUNK_ROWS = 1 << 16
#: How much the largest source's weight rises over the run; the others fall so that all stay in balance.
TILT = 0.3
#: Order of the records of a source inside a chunk.
ORDER = ["h", "id", "tokens"]


@dataclass(frozen=True)
class Plan:
    """What is taken of one source: ``demand`` tokens, ``passes`` whole ones and ``rest`` tokens of another."""

    source: str
    share: float
    tilt: float
    supply: int
    demand: float
    passes: int
    rest: float
    points: tuple[tuple[float, float], ...] = ()

    def schedule(self) -> tuple[tuple[float, float], ...]:
        """Moments from 0 to 1 and weights there, with a mean of 1."""
        return self.points or ((0.0, 1 - self.tilt), (1.0, 1 + self.tilt))


def normalised(points: Sequence[tuple[float, float]]) -> tuple[tuple[float, float], ...]:
    """A schedule from 0 to 1 (its ends are carried on) whose mean weight is 1."""
    ps = sorted((float(t), float(w)) for t, w in points)
    if not ps or ps[0][0] < 0 or ps[-1][0] > 1 or any(w < 0 for _, w in ps) or len({t for t, _ in ps}) < len(ps):
        raise ValueError("a schedule needs moments between 0 and 1, each once, and weights of 0 or more")
    ps = ([(0.0, ps[0][1])] if ps[0][0] > 0 else []) + ps + ([(1.0, ps[-1][1])] if ps[-1][0] < 1 else [])
    area = sum((u - t) * (v + w) / 2 for (t, v), (u, w) in zip(ps, ps[1:], strict=False))
    if area <= 0:
        raise ValueError("a schedule must have a weight above 0 somewhere")
    return tuple((t, w / area) for t, w in ps)


def curriculum(shares: Mapping[str, float], tilt: float = TILT) -> dict[str, float]:
    """Slopes per source whose share-weighted sum is 0, so that the weights add up to 1 at every moment.

    The slope rises with the source's share, from the smallest source to the largest.
    """
    mean = sum(s * s for s in shares.values())
    spread = max((abs(s - mean) for s in shares.values()), default=0) or 1
    return {k: tilt * (s - mean) / spread for k, s in shares.items()}


def plan_mix(supply: Mapping[str, int], targets: Mapping[str, tuple[float, int]], tilt: float = TILT, schedules: Mapping[str, Sequence[tuple[float, float]]] | None = None) -> list[Plan]:
    """The largest mix in which every source that has tokens keeps its share within its repeats.

    Sources without tokens, without target or with a cap below 1 take no part; the
    shares of the others are scaled to add up to 1.  ``schedules`` give (moment, weight)
    points per source in place of the default line; at a moment sources are mixed in
    proportion to share times weight.
    """
    there = {s: (share, cap) for s, (share, cap) in targets.items() if supply.get(s, 0) > 0 and share and share > 0 and cap and cap > 0}
    whole = sum(share for share, _ in there.values())
    if not there:
        return []
    shares = {s: share / whole for s, (share, _) in there.items()}
    total = min(cap * supply[s] / shares[s] for s, (_, cap) in there.items())
    slopes, plans = curriculum(shares, tilt), []
    for s, (_, cap) in sorted(there.items()):
        demand = min(total * shares[s], cap * supply[s])
        passes = min(cap, math.floor(demand / supply[s] + 1e-12))
        rest = 0.0 if passes == cap else max(0.0, demand - passes * supply[s])
        points = normalised(schedules[s]) if schedules and s in schedules else ()
        plans.append(Plan(s, shares[s], slopes[s], supply[s], demand, passes, rest, points))
    return plans


def position(used: Column, points: Sequence[tuple[float, float]]) -> Column:
    """The moment at which the share ``used`` of a source's demand is reached.

    Inverts the integral of the schedule, line by line, in the form without cancellation.
    """
    out, before = F.lit(1.0), []
    for (t, v), (u, w) in zip(points, points[1:], strict=False):
        before.append((t, u, v, (w - v) / (u - t), (before[-1][5] if before else 0.0), (before[-1][5] if before else 0.0) + (u - t) * (v + w) / 2))
    for t, u, v, slope, start, end in reversed(before):
        rest = used - start
        root = v + F.sqrt(F.greatest(F.lit(0.0), F.lit(v * v) + 2 * slope * rest))
        out = F.when(used < end, F.least(F.lit(u), t + F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / root))).otherwise(out)
    return F.when(used <= 0, F.lit(0.0)).otherwise(out)


def source_name(source: Column) -> Column:
    """A source without blanks at its ends, in lower case."""
    return F.lower(F.btrim(source, F.lit(" \t\xa0")))


#: Gaps are filled until they are below this share of a source's demand or nothing more fits.
SLACK = 0.002


def _partial_pass(rows: DataFrame, plans: list[Plan]) -> DataFrame:
    """Add ``picked``: whether a record is in the partial pass of its source.

    Records are taken in order while they fit; where a long one does not, the gap it
    leaves is filled, again in order, from those that do, until no record fits any more.
    What is left open then shows in the shares reached.
    """
    gaps, k = {p.source: p.rest for p in plans}, 0
    rows = rows.withColumn("picked", F.lit(False))
    while True:
        gap = F.coalesce(*[F.when(F.col("source") == s, F.lit(g)) for s, g in gaps.items()], F.lit(0.0))
        fits = ~F.col("picked") & (F.col("tokens") <= gap)
        counted = rows if not k else prefix_sum(rows.withColumn("_t", F.when(fits, F.col("tokens")).otherwise(0)), "chunk", ORDER, "_t", "ahead", within=["source"])
        ahead = F.col("before") if not k else F.col("ahead")
        counted = counted.withColumn("picked", F.col("picked") | (fits & (ahead + F.col("tokens") <= gap))).drop("_t", "ahead")
        rows = materialize(counted, f"mix-pass-{k}")
        taken = {r["source"]: r["t"] for r in rows.where("picked").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
        before, gaps, k = gaps, {p.source: p.rest - taken.get(p.source, 0) for p in plans}, k + 1
        if all(gaps[p.source] <= SLACK * p.demand or (k > 1 and gaps[p.source] == before[p.source]) for p in plans):
            break
    return rows


def mix(records: DataFrame, plans: list[Plan], id: str, source: str, tokens: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The mix as training order: ``id``, source, copy, tokens, position; sorted by position.

    Records of a source are taken in the order of a hash of their id.  Records of
    other sources, without source or without tokens are left out; rows with equal ids
    are records of their own.  Each source gets its whole passes and, of one more, as
    many records as fit the rest of its demand.
    """
    names = [p.source for p in plans]
    of = lambda field, kind: F.coalesce(*[F.when(F.col("source") == p.source, F.lit(getattr(p, field))) for p in plans], F.lit(0)).cast(kind)
    rows = records.select(F.col(id).cast("bigint").alias("id"), F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens"))
    if not plans:
        return rows.where("false").select(F.col("id").alias(id), "source", F.lit(0).alias("copy"), "tokens", F.lit(0.0).alias("position"))
    rows = rows.where(F.col("source").isin(names) & (F.col("tokens") > 0)).withColumn("h", F.xxhash64("id"))
    bits = max(1, math.ceil(math.log2(max(2, rows.count() / chunk_rows))))
    rows = rows.withColumn("chunk", F.shiftrightunsigned("h", 64 - bits))
    rows = _partial_pass(prefix_sum(rows, "chunk", ORDER, "tokens", "before", within=["source"]), plans)
    copies = of("passes", "int") + F.when(F.col("picked"), 1).otherwise(0)
    taken = rows.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    # The partial pass is the beginning of another one; records that fill its gaps are spread over it.
    middle = F.col("before") + F.col("tokens") / 2
    filler = (F.col("copy") == of("passes", "int")) & (middle > of("rest", "double"))
    inside = F.when(filler, middle * of("rest", "double") / of("supply", "double")).otherwise(middle)
    used = F.least(F.lit(1.0), (F.col("copy") * of("supply", "double") + inside) / of("demand", "double"))
    moments = F.coalesce(*[F.when(F.col("source") == p.source, position(F.col("_used"), p.schedule())) for p in plans], F.lit(1.0))
    return taken.withColumn("_used", used).withColumn("position", moments).select(F.col("id").alias(id), "source", "copy", "tokens", "position").orderBy("position", "source", id, "copy")
