"""Frequencies of all n-grams up to a length, by suffix sorting.

Every position of a record gives one suffix, cut to ``sigma`` terms.  Suffixes are
routed by their first term and sorted in reverse lexicographic order, so that all
suffixes with a common prefix lie together, longer ones first.  One pass over the
sorted suffixes then keeps a stack with one open n-gram per length and closes it
when the next suffix differs there.

Instead of sets of record ids a suffix carries its novelty: how many of its
prefixes the same record has already shown further left.  Prefixes longer than that
are new to the record, so records are counted exactly by adding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import shuffle_partitions

#: Distinct suffixes that one mapper combines before it passes them on.
COMBINE = 200_000
#: Suffixes from which hot prefixes are told, about.
SAMPLED = 500_000


def _emit(sigma: int, hot: frozenset):
    """Records (terms, weight) to combined suffixes.

    Columns: g1..g<sigma>, from_len (shortest prefix that this row counts for), seen
    (novelty), total, records, route (number of terms that decide the task).
    """

    def table(counts: dict) -> pa.RecordBatch:
        keys, values = list(counts), list(counts.values())
        cols = {f"g{k + 1}": pa.array([s[k] if len(s) > k else None for s, *_ in keys], pa.string()) for k in range(sigma)}
        for k, name in enumerate(("from_len", "seen", "route"), 1):
            cols[name] = pa.array([x[k] for x in keys], pa.int32())
        for k, name in enumerate(("total", "records")):
            cols[name] = pa.array([x[k] for x in values], pa.int64())
        return pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            for terms, weight in zip(batch["terms"].to_pylist(), batch["weight"].to_pylist(), strict=True):
                known: set = set()
                for i in range(len(terms)):
                    suffix = tuple(terms[i : i + sigma])
                    seen = 0
                    for n in range(len(suffix), 0, -1):
                        if suffix[:n] in known:
                            seen = n
                            break
                        known.add(suffix[:n])
                    depth = 0
                    while depth < len(suffix) and suffix[: depth + 1] in hot:
                        depth += 1
                        key = (suffix[:depth], depth, min(seen, depth), depth)
                        c = counts.setdefault(key, [0, 0])
                        c[0] += weight
                        c[1] += 1
                    if depth < len(suffix):
                        c = counts.setdefault((suffix, depth + 1, seen, depth + 1), [0, 0])
                        c[0] += weight
                        c[1] += 1
                if len(counts) >= COMBINE:
                    yield table(counts)
                    counts = {}
        if counts:
            yield table(counts)

    return run


def _stack(sigma: int):
    """Sorted suffixes to n-grams, whole batches at a time; the stack is what stays open between them."""
    names = [f"g{k + 1}" for k in range(sigma)]
    numbers = ["from_len", "seen", "total", "records"]

    def close(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        n = t.num_rows
        g = [t[c].combine_chunks() for c in names]
        from_len, seen, total, records = (t[c].to_numpy() for c in numbers)
        same, ngrams, out, open_ = np.ones(n - 1, bool), [], [], []
        for length in range(1, sigma + 1):
            col = g[length - 1]
            valid = col.is_valid().to_numpy(zero_copy_only=False)
            same = same & pc.fill_null(pc.equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(valid & np.concatenate(([True], ~same)))
            if not len(starts):
                break
            counted = valid & (from_len <= length)
            tot = np.add.reduceat(np.where(counted, total, 0), starts)
            rec = np.add.reduceat(np.where(counted & (seen < length), records, 0), starts)
            rows = np.add.reduceat(counted.astype(np.int64), starts)
            if valid[-1] and not last:  # the last row's own prefix stays open
                open_.append((length, tot[-1], rec[-1], rows[-1]))
                starts, tot, rec, rows = starts[:-1], tot[:-1], rec[:-1], rows[:-1]
            keep = np.flatnonzero(rows > 0)
            at = pa.array(starts[keep])
            parts = [c.take(at).to_pylist() for c in g[:length]]
            ngrams += [list(x) for x in zip(*parts, strict=True)]
            out.append(np.stack([np.full(len(keep), length), tot[keep], rec[keep]]))
        figures = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        batch = pa.RecordBatch.from_pydict({"ngram": pa.array(ngrams, pa.list_(pa.string())), "n": pa.array(figures[0], pa.int32()), "total": pa.array(figures[1], pa.int64()), "records": pa.array(figures[2], pa.int64())})
        tail = {c: pa.array([g[k][n - 1].as_py() if k < o[0] else None for o in open_], pa.string()) for k, c in enumerate(names)}
        # A row of the stack counts for its own length only; shorter ones first keeps each length together.
        tail["from_len"] = pa.array([o[0] if o[3] else sigma + 1 for o in open_], pa.int32())
        tail["seen"] = pa.array([0] * len(open_), pa.int32())
        tail["total"] = pa.array([int(o[1]) for o in open_], pa.int64())
        tail["records"] = pa.array([int(o[2]) for o in open_], pa.int64())
        return batch, pa.table(tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table({c: batch[c] for c in [*names, *numbers]})  # with the stack's own field types, whatever may be null
            out, stack = close(t if stack is None else pa.concat_tables([stack, t]), last=False)
            if out.num_rows:
                yield out
        if stack is not None and stack.num_rows:
            yield close(stack, last=True)[0]

    return run


def _slices(n: int):
    return lambda i: F.slice("terms", i, n)


def _hot_prefixes(records: DataFrame, sigma: int, share: int) -> frozenset:
    """Prefixes that begin about a ``share``-th of all suffixes or more, by a sample of records.

    At most ``share`` per length, so the list is bounded.  A suffix that begins with one
    is routed by one term more, and the hot prefix is counted apart; that decides only
    where rows are counted, not what is counted, so a sample does.
    """
    if sigma < 2:
        return frozenset()
    total = records.select(F.sum(F.size("terms"))).first()[0] or 0
    some = records.sample(min(1.0, SAMPLED / max(total, 1)), seed=1) if total > SAMPLED else records
    starts = lambda n: F.sequence(F.lit(1), F.size("terms") - (n - 1))
    grams = None
    for n in range(1, sigma):
        of_n = some.where(F.size("terms") >= n).select(F.explode(F.transform(starts(n), _slices(n))).alias("g"))
        grams = of_n if grams is None else grams.unionByName(of_n)
    least = max(1000 * min(total, SAMPLED) // max(total, 1), min(total, SAMPLED) // share, 1)
    found = {tuple(r["g"]) for r in grams.groupBy("g").count().where(F.col("count") > least).select("g").collect()}
    # A prefix is asked for only below a hot one.
    return frozenset(g for g in found if all(g[:k] in found for k in range(1, len(g))))


def ngram_frequencies(df: DataFrame, terms: str, sigma: int, weight: str | None = None) -> DataFrame:
    """Every n-gram of up to ``sigma`` terms: ngram, n, total and records.

    ``terms`` is an array of strings, one record per row; null terms are left out
    before positions are counted, null or empty arrays give nothing.  ``total`` sums
    ``weight`` (null as 0; default 1) over occurrences, ``records`` counts rows that
    hold the n-gram at least once.  Repeated rows are records of their own.
    """
    width = shuffle_partitions(df.sparkSession)
    w = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    records = df.select(F.filter(F.col(terms), lambda x: x.isNotNull()).alias("terms"), w.cast("bigint").alias("weight")).where(F.size("terms") > 0)
    hot = _hot_prefixes(records, sigma, 4 * width)
    g = [f"g{k + 1}" for k in range(sigma)]
    schema = ", ".join(f"{c} string" for c in g) + ", from_len int, seen int, route int, total bigint, records bigint"
    routed = [F.when(F.col("route") > k, F.col(c)) for k, c in enumerate(g)]
    if sigma == 1:
        # Every term is a suffix of its own: nothing to do outside the JVM.
        one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        row = lambda x, w, r: F.struct(x.alias("g1"), w.alias("w"), r.alias("r"))
        several = F.concat(F.transform("terms", lambda x: row(x, F.col("weight"), zero)), F.transform(F.array_distinct("terms"), lambda x: row(x, zero, one)))
        each = records.select(F.explode(F.when(F.size("terms") == 1, F.array(row(F.col("terms")[0], F.col("weight"), one))).otherwise(several)).alias("x")).select("x.*")
        suffixes = each.groupBy("g1").agg(F.sum("w").alias("total"), F.sum("r").alias("records")).select("*", F.lit(1).alias("from_len"), F.lit(0).alias("seen"))
    else:
        suffixes = records.mapInArrow(_emit(sigma, hot), schema)
    return (
        suffixes.repartition(width, *[F.col(g[0])] if not hot else [F.xxhash64(*routed)])
        .sortWithinPartitions(*[F.col(c).desc_nulls_last() for c in g])
        .mapInArrow(_stack(sigma), "ngram array<string>, n int, total bigint, records bigint")
    )
