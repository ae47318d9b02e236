"""Filling containers of fixed capacity: sum-of-squares packing in independent groups.

An item goes to the fill level for which the sum of squared counts of partially
filled containers grows least; the counts are kept in an array by level.  Items
are dealt to groups by hash, each group is packed online in one task, and the
containers that stay open are packed again, as items, in a second round.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.storage import materialize

#: Items that one task packs on average; the number of groups follows from it.
GROUP_ITEMS = 16_384
#: A container's number is its group's number, shifted, plus its place there: room for 2^24 containers of a group and 2^37 groups.
_SHIFT = 24
#: Containers of the second round are numbered from here.
_SECOND = 1 << 62


class SumOfSquares:
    """Online packing of sizes 1..capacity; ``place`` returns the container's number."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)  # by fill level; 0 and capacity stay at 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, bool]:
        """Container for an item, and whether it is now full."""
        b, c = self.capacity, self.counts
        level, best = 0, 2 * c[size] + 1 if size < b else 0
        if size < b:
            # A move from level l to l + size changes the sum by 2 (N[l + size] - N[l]) + 2; to the full level it only takes away.
            change = 2 * (c[size + 1 : b + 1] - c[1 : b - size + 1]) + 2
            change[-1] -= 1
            change[c[1 : b - size + 1] == 0] = np.iinfo(np.int64).max
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal levels the fullest
            if change[k] <= best:
                level = k + 1
        if level:
            container = self.at[level].pop()
            c[level] -= 1
        else:
            container, self.made = self.made, self.made + 1
        now = level + size
        if now < b:
            c[now] += 1
            self.at[now].append(container)
        return container, now == b


def _pack_group(key: str, columns: list[str]):
    """Pack the rows of each (capacity, group); contents come out when a container is full or the group ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, packer, held, out = None, None, {}, []

        def flush(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[*columns, "number", "full"])

        def end() -> None:
            for number, items in held.items():
                out.extend((*item, number, False) for item in items)
            held.clear()

        for batch in batches:
            for row in batch[["capacity", "grp", key, "piece", "tokens"]].itertuples(index=False, name=None):
                if row[:2] != group:
                    end()
                    group, packer = row[:2], SumOfSquares(int(row[0]))
                number, full = packer.place(int(row[4]))
                held.setdefault(number, []).append(row)
                if full:
                    out.extend((*item, number, True) for item in held.pop(number))
            if len(out) > 50_000:
                yield flush(out)
                out.clear()
        end()
        if out:
            yield flush(out)

    return run


def _packed(items: DataFrame, key: str, count: int) -> DataFrame:
    """Columns capacity, grp, key, piece, tokens, number, full."""
    columns = ["capacity", "grp", key, "piece", "tokens"]
    parts = max(1, -(-count // GROUP_ITEMS))
    dealt = items.select("capacity", F.col("grp").cast("bigint"), F.col(key).cast("bigint"), F.col("piece").cast("bigint"), F.col("tokens").cast("bigint"))
    dealt = dealt.repartition(parts, "capacity", "grp").sortWithinPartitions("capacity", "grp", F.xxhash64(key, "piece"), key, "piece")
    return dealt.mapInPandas(_pack_group(key, columns), f"capacity bigint, grp bigint, {key} bigint, piece bigint, tokens bigint, number bigint, full boolean")


def pack(items: DataFrame, id: str, tokens: str, capacities: Mapping[str, int], group_items: int = GROUP_ITEMS) -> DataFrame:
    """Assign every item to a container of each capacity.

    Returns container (the kind), capacity, container_id, ``id``, piece, token_start
    and tokens.  An item larger than the capacity is cut: full pieces have containers
    of their own, the rest is packed like any item.  Items without tokens (null or 0)
    come out once per kind with a null container_id and 0 tokens.  Rows with equal ids
    are items of their own.  The result depends only on the rows, not on the cluster.
    """
    if not 0 < group_items <= 1 << (_SHIFT - 2):
        raise ValueError(f"group_items must be between 1 and {1 << (_SHIFT - 2)}")
    spark = items.sparkSession
    kinds = spark.createDataFrame([(k, int(v)) for k, v in capacities.items()], "container string, capacity bigint")
    sized = materialize(items.select(F.col(id).cast("bigint").alias(id), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("total")), "pack-sizes")
    wanted = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(int(v)).cast("bigint").alias("capacity")) for k, v in capacities.items()])
    each = sized.withColumn("kind", F.explode(wanted)).select("kind.*", id, "total")
    empty = each.where("total = 0").select("container", "capacity", F.lit(None).cast("bigint").alias("container_id"), id, F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("token_start"), F.col("total").alias("tokens"))

    pieces = each.where("total > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(total - 1) div capacity"))))
    pieces = pieces.withColumn("tokens", F.least("capacity", F.col("total") - F.col("piece") * F.col("capacity")))
    n = max(1, sized.count())
    groups = max(1, -(-n // group_items))
    if groups >= 1 << (61 - _SHIFT):
        raise ValueError("too many groups to number their containers: raise group_items")
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64(id, "piece"), F.lit(groups)))
    first = materialize(_packed(pieces, id, n * len(capacities)), "pack-first")

    first = first.withColumn("container_id", F.shiftleft("grp", _SHIFT) + F.col("number"))
    left = first.where("not full").groupBy("capacity", F.col("container_id").alias("unit")).agg(F.sum("tokens").alias("tokens"))
    left = materialize(left, "pack-open")
    m = max(1, left.count())
    again = max(1, -(-m // group_items))
    second = _packed(left.select("capacity", F.pmod(F.xxhash64("unit"), F.lit(again)).alias("grp"), "unit", F.lit(0).alias("piece"), "tokens"), "unit", m)
    moved = second.select("capacity", F.col("unit").alias("container_id"), (F.lit(_SECOND) + F.shiftleft("grp", _SHIFT) + F.col("number")).alias("final"))
    reopened = first.where("not full").join(moved, ["capacity", "container_id"]).withColumn("container_id", F.col("final")).drop("final")
    done = first.where("full").unionByName(reopened)
    named = done.join(F.broadcast(kinds), "capacity").select(
        "container", "capacity", "container_id", id, "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), "tokens"
    )
    return named.unionByName(empty)


def fill(assignment: DataFrame) -> DataFrame:
    """Per container: kind, capacity, items, tokens and share filled."""
    return (
        assignment.where("container_id is not null")
        .groupBy("container", "capacity", "container_id")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
        .withColumn("filled", F.col("tokens") / F.col("capacity"))
    )
