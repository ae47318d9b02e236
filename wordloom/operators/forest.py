"""Parent links of unknown depth: paths, depths, roots, descendants and cycles.

Nodes are dealt to fragments that fit one task.  Inside a fragment each node's
chain is contracted to where it leaves the fragment; the exits that are nodes
elsewhere form a smaller forest of the same shape, which is solved the same way
until it fits one fragment, and its answers then expand the fragments.  Each
round writes one table to the shared folder; there is no loop over depths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.storage import materialize

#: Nodes per fragment: one Python worker holds about 100 bytes a node, or its paths, while it is solved.
FRAGMENT_NODES = 1 << 18
#: Stands for "none" in the arrays; no id may have this value.
NONE = np.iinfo(np.int64).min

#: One link of the (contracted) forest: from ``id`` over ``hops`` original nodes to ``parent``.
#: ``low`` is the smallest id on the way, ``top`` the last node before ``parent``, ``cycle`` the
#: cycle into which the chain is known to run; with paths also ``seg``, the ids on the way, topmost first.
_LINK = "id bigint, parent bigint, hops bigint, low bigint, top bigint, cycle bigint"
_SEGMENT = ", seg array<bigint>"


def contract(ids: np.ndarray, parent: np.ndarray, hops: np.ndarray, low: np.ndarray, top: np.ndarray, cycle: np.ndarray):
    """Contract the chains inside one fragment by pointer doubling; ``ids`` are sorted and unique.

    Returns per node the exit (first node outside the fragment, or NONE) and the
    hops, low, top and cycle of the whole way there.
    """
    n = len(ids)
    at = np.minimum(np.searchsorted(ids, parent), n - 1)
    local = (ids[at] == parent) & (parent != NONE)
    jump, ended = np.where(local, at, np.arange(n)), ~local
    length, least = np.where(ended, 0, hops), low.copy()
    # After k passes a pointer has gone 2^k links, or stands at its chain's end.
    for _ in range(n.bit_length() + 1):
        settled = ended[jump].all()
        length, least, jump = length + length[jump], np.minimum(least, least[jump]), jump[jump]
        if settled:
            break
    endless = ~ended[jump]  # the pointer is on the cycle, and its own way covers all of the cycle
    return (
        np.where(endless, NONE, parent[jump]),
        np.where(endless, 0, length + hops[jump]),
        least,
        top[jump],
        np.where(endless, least[jump], cycle[jump]),
    )


def segments(ids: np.ndarray, parent: np.ndarray, seg: list) -> list:
    """Per node the ids from just below its exit down to itself (anything for endless chains)."""
    index, out = {v: i for i, v in enumerate(ids.tolist())}, [None] * len(ids)
    up = parent.tolist()
    for start in range(len(ids)):
        chain, i = [], start
        while i is not None and out[i] is None:
            chain.append(i)
            out[i] = []  # met again only inside a cycle
            i = index.get(up[i])
        path = [] if i is None else out[i]
        for k in reversed(chain):
            path = out[k] = path + seg[k]
    return out


def _fragment(with_paths: bool):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by("id")
        col = lambda name: t[name].fill_null(NONE).to_numpy()
        ids, parent = col("id"), col("parent")
        exit_, hops, low, top, cycle = contract(ids, parent, col("hops"), col("low"), col("top"), col("cycle"))
        null = lambda a: pa.array(a, mask=a == NONE)
        out = pa.table({"id": ids, "parent": null(exit_), "hops": hops, "low": low, "top": top, "cycle": null(cycle)})
        if with_paths:
            out = out.append_column("seg", pa.array(segments(ids, parent, t["seg"].to_pylist()), pa.list_(pa.int64())))
        yield from out.to_batches(max_chunksize=20_000)

    return solve


def _place(links: DataFrame, level: int, parts: int, nodes: int) -> DataFrame:
    """Deal the links to fragments.

    A node goes where its own id points or, by a coin of (id, round), where its
    parent's id points: a quarter of all links then lie inside a fragment however
    many fragments there are, so even one endless chain shrinks in every round.
    Children of a parent with very many children always go by their own id; there
    are fewer than 8 x parts such parents, and by their size the list is broadcast or not.
    """
    if parts == 1:
        return links.coalesce(1)
    many = links.where("parent is not null").groupBy("parent").count().where(F.col("count") > max(1, nodes // (8 * parts)))
    many = many.select("parent", F.lit(True).alias("many"))
    stays = (F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == 0) | F.col("parent").isNull() | F.col("many").isNotNull()
    home = F.when(stays, F.col("id")).otherwise(F.col("parent"))
    return links.join(many, "parent", "left").repartition(parts, F.xxhash64(home, F.lit(level))).drop("many")


def _solve(links: DataFrame, level: int, nodes: int, with_paths: bool, fragment_nodes: int) -> DataFrame:
    """Per node of ``links``: id, root, hops (nodes from the root down to it), cycle, path, dangling."""
    parts = 1 if nodes <= fragment_nodes else -(-2 * nodes // fragment_nodes)
    schema = _LINK + (_SEGMENT if with_paths else "")
    names = [x.split()[0] for x in schema.split(", ")]
    placed = _place(links.select(*names), level, parts, nodes).select(*names)
    solved = materialize(placed.mapInArrow(_fragment(with_paths), schema), f"forest-{level}")
    above = None
    if parts > 1:
        exits = solved.where("parent is not null").select(F.col("parent").alias("id")).distinct()
        quotient = materialize(solved.join(exits, "id", "left_semi"), f"forest-quotient-{level}")
        if size := quotient.count():
            above = _solve(quotient, level + 1, size, with_paths, fragment_nodes)
    if above is None:
        # No node is left above: an exit without a row is a missing parent.
        path = [F.col("seg").alias("path")] if with_paths else []
        return solved.select("id", F.col("top").alias("root"), "hops", "cycle", *path, F.col("parent").isNotNull().alias("dangling"))
    above = above.select(*(F.col(c).alias("parent" if c == "id" else f"x_{c}") for c in above.columns))
    found = F.col("x_root").isNotNull()
    path = [F.when(found, F.concat("x_path", "seg")).otherwise(F.col("seg")).alias("path")] if with_paths else []
    return solved.join(above, "parent", "left").select(
        "id",
        F.coalesce("x_root", "top").alias("root"),
        (F.coalesce("x_hops", F.lit(0)) + F.col("hops")).alias("hops"),
        F.coalesce("cycle", "x_cycle").alias("cycle"),
        *path,
        F.when(found, F.col("x_dangling")).otherwise(F.col("parent").isNotNull()).alias("dangling"),
    )


def hierarchy(df: DataFrame, id: str = "id", parent: str = "parent", root_marker: int | None = -1, with_paths: bool = True, fragment_nodes: int = FRAGMENT_NODES) -> DataFrame:
    """Resolve every node's chain of parents.

    Returns, one row per distinct non-null id: id, root, depth (links to the root, 0
    for the root itself), path (ids from the root down to the node, if
    ``with_paths``), dangling (the root names a parent that has no row) and cycle_id.
    A node on a cycle or leading into one has only id and cycle_id, the smallest id
    on that cycle.  ``root_marker`` or null marks a root; a missing parent makes the
    lowest existing node of the chain its root.  If an id has several parents the
    smallest counts; rows repeated in full count once.
    """
    p = F.col(parent).cast("bigint")
    if root_marker is not None:
        p = F.when(p != root_marker, p)
    one = df.select(F.col(id).cast("bigint").alias("id"), p.alias("parent")).where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    none = F.lit(None)
    links = one.select(
        "id", "parent", F.lit(1).cast("bigint").alias("hops"), F.col("id").alias("low"), F.col("id").alias("top"),
        none.cast("bigint").alias("cycle"), *([F.array("id").alias("seg")] if with_paths else []),
    )
    links = materialize(links, "forest-links")
    solved = _solve(links, 0, links.count(), with_paths, fragment_nodes)
    ends = F.col("cycle").isNull()
    return solved.select(
        "id",
        F.when(ends, F.col("root")).alias("root"),
        F.when(ends, F.col("hops") - 1).alias("depth"),
        *([F.when(ends, F.col("path")).alias("path")] if with_paths else []),
        F.when(ends, F.col("dangling")).alias("dangling"),
        F.col("cycle").alias("cycle_id"),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """Every (id, descendant, distance) with distance >= 1, from the paths of :func:`hierarchy`."""
    size = F.size("path")
    return (
        resolved.where(F.col("path").isNotNull())
        .select(F.col("id").alias("descendant"), size.alias("n"), F.posexplode("path").alias("k", "ancestor"))
        .where(F.col("ancestor") != F.col("descendant"))
        .select(F.col("ancestor").alias("id"), "descendant", (F.col("n") - 1 - F.col("k")).cast("bigint").alias("distance"))
    )


def path_words(resolved: DataFrame, nodes: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``words``: the path as words, in path order; a node whose word is unknown gives null there.

    ``nodes``: id, word (a word id); ``words``: id, word.  Of several rows per id the smallest word counts.
    """
    names = nodes.where("id is not null").groupBy("id").agg(F.min("word").alias("word_id"))
    terms = words.where("id is not null").groupBy(F.col("id").alias("word_id")).agg(F.min("word").alias("term"))
    named = names.join(terms, "word_id", "left").select(F.col("id").alias("node"), "term")
    steps = resolved.where(F.col("path").isNotNull()).select("id", F.posexplode("path").alias("k", "node"))
    spelled = (
        steps.join(named, "node", "left")
        .groupBy("id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("words"))
    )
    return resolved.join(spelled, "id", "left")
