"""Near duplicates of embeddings: NN-descent over a random-projection start, exact in dense groups, audited."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.components import components
from tickloom.llm.shared import save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COSINE = 0.9
LIST = 8
BLOCK = 256
JOIN_ROWS = 64
PIECE = 512
#: Cells of saturated vectors have this angle around their first member at most; so many cells meet at once.
CELL = 0.15
CELLS = 2048
ROUNDS = 2
RECALL = 0.95
#: Vectors whose neighbours are counted by brute force to measure recall (130 KB at 64 dimensions).
AUDIT = 256
PLANES = 24
SLACK = 1e-5


def trees_for(count: int, cosine: float = COSINE, target: float = 0.98) -> int:
    """Trees in which a pair at ``cosine`` meets in a block at least once with probability ``target``."""
    side = 1 - math.acos(cosine) / math.pi
    meet = 0.85 * side ** max(1.0, math.log2(max(count, 1) / BLOCK))
    return max(4, math.ceil(math.log(1 - target) / math.log(1 - meet)))


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(row, id, unit)``; ``unit`` is null for vectors that link with nothing."""
    numbers = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    top = F.array_max(F.transform("numbers", lambda x: F.abs(x)))
    length = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    own = vectors.select(F.col(id_col).alias("id"), numbers.alias("numbers")).withColumn("good", F.col("numbers").isNotNull() & ~F.exists("numbers", bad))
    scaled = own.withColumn("scaled", F.when(F.col("good") & (top > 0), F.transform("numbers", lambda x: x / top)))
    sized = scaled.withColumn("length", length)
    return sized.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("scaled", lambda x: x / F.col("length")).alias("unit"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32)


def first_lists(nodes: DataFrame, trees: range, cosine: float) -> DataFrame:
    """``(src, dst, sim, spans)``: the best of each block of ``BLOCK`` neighbours in the order of each tree's signs.

    Rows with ``spans`` are links that together connect all that a block links, however many links it has.

    Range partitions cut equal codes too, so a dense group fills many blocks and no task more than others.
    """

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["unit"].map(len)):
                unit = _stack(part["unit"])
                for tree in trees:
                    planes = np.random.default_rng([5, tree, dim]).standard_normal((dim, PLANES)).astype(np.float32)
                    signs = (unit @ planes > 0) @ (1 << np.arange(PLANES)[::-1])
                    yield pd.DataFrame({"tree": tree, "dim": dim, "code": signs, "node": part["node"].to_numpy(), "unit": list(unit)})

    coded = nodes.select("node", "unit").mapInPandas(code, "tree int, dim int, code int, node long, unit array<float>")
    ordered = coded.repartitionByRange("tree", "dim", "code", F.xxhash64("node", "tree")).sortWithinPartitions("tree", "dim", "code", F.xxhash64("node", "tree"))

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby(["tree", "dim"]):
                for a in range(0, len(part), BLOCK):
                    piece = part.iloc[a : a + BLOCK]
                    yield best(piece["node"].to_numpy(), _stack(piece["unit"]), LIST, cosine)

    return ordered.mapInPandas(pick, "src long, dst long, sim float, spans boolean")


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a symmetric link matrix: each row's link to its parent in a spanning forest (-1 at roots), and its root."""
    parent, root = np.full(len(near), -1), np.arange(len(near))
    left = near.any(axis=1)
    while left.any():
        first = int(left.argmax())
        left[first] = False
        front = np.array([first])
        while len(front):
            reach = near[front] & left
            fresh = np.flatnonzero(reach.any(axis=0))
            parent[fresh], root[fresh] = front[reach[:, fresh].argmax(axis=0)], first
            left[fresh] = False
            front = fresh
    return parent, root


def best(node: np.ndarray, unit: np.ndarray, k: int, cosine: float, floor: np.ndarray | None = None) -> pd.DataFrame:
    """The ``k`` most similar others of each node, above its floor if it has one, and links that span the rest."""
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(node) - 1)
    if k < 1:
        return pd.DataFrame({"src": node[:0], "dst": node[:0], "sim": sim[:0, 0], "spans": node[:0] > 0})
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    src, dst, value = np.repeat(node, k), node[top.reshape(-1)], np.take_along_axis(sim, top, 1).reshape(-1)
    keep = src != dst
    if floor is not None:
        keep &= value > np.repeat(floor, k)
    out = pd.DataFrame({"src": src[keep], "dst": dst[keep], "sim": value[keep], "spans": False})
    if sim.max() < cosine - SLACK:
        return out
    # What single precision leaves open is passed on pair by pair where the sure links don't connect it.
    parent, root = spanning((sim >= cosine + SLACK) & (node[:, None] != node[None, :]))
    a = np.flatnonzero(parent >= 0)
    b = parent[a]
    x, y = np.nonzero(np.triu((np.abs(sim - cosine) < SLACK) & (root[:, None] != root[None, :])))
    a, b = np.concatenate([a, x]), np.concatenate([b, y])
    return pd.concat([out, pd.DataFrame({"src": node[a], "dst": node[b], "sim": sim[a, b], "spans": True})], ignore_index=True)


def shortest(lists: DataFrame, k: int = LIST) -> DataFrame:
    """The ``k`` best entries of each node's list (``listed``), and all spanning links that were met.

    A node has at most a list's entries from each block it was in, and as a ``src`` one spanning link.
    """
    by = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    merged = lists.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.bool_or("spans").alias("spans"))
    return merged.withColumn("listed", F.row_number().over(by) <= k).where("listed or spans")


def descend(nodes: DataFrame, lists: DataFrame, cosine: float) -> DataFrame:
    """One NN-descent round: the neighbours of a node, in both directions, are compared with each other.

    A hub's neighbours are dealt out over groups of ``JOIN_ROWS``; none is left out. Pairs that would enter
    neither's list aren't emitted, but for links that span what the others link.
    """
    met = lists.drop("listed")
    lists = lists.where("listed").drop("listed")
    floors = lists.groupBy("src").agg(F.min("sim").alias("floor"), F.count("*").alias("n"))
    known = nodes.join(floors, nodes["node"] == floors["src"], "left").select(
        F.col("node").alias("member"), "unit", F.when(F.col("n") >= LIST, F.col("floor")).otherwise(F.lit(-2.0)).cast("float").alias("floor")
    )
    both = lists.select(F.col("src").alias("at"), F.col("dst").alias("member")).unionByName(lists.select(F.col("dst").alias("at"), F.col("src").alias("member")))
    sizes = both.groupBy("at").agg(F.ceil(F.count("*") / JOIN_ROWS).alias("groups"))
    dealt = both.join(sizes, "at").select("at", F.pmod(F.xxhash64("at", "member"), F.col("groups")).alias("group"), "member")
    rows = dealt.distinct().join(known, "member").withColumn("unit", F.col("unit").cast("array<float>")).repartition("at", "group").sortWithinPartitions("at", "group")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            at, group = frame["at"].to_numpy(), frame["group"].to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (group[1:] != group[:-1])) + 1
            yield solve(frame, [0, *cuts.tolist()])
            held = frame.iloc[cuts[-1] if len(cuts) else 0 :]
        if held is not None:
            yield solve(held, [0, len(held)])

    def solve(frame: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        node, floor, units = frame["member"].to_numpy(), frame["floor"].to_numpy(), frame["unit"].to_numpy()
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = units[a:b]
            if b - a > 1 and len({len(u) for u in own}) == 1:
                out.append(best(node[a:b], np.stack(own), LIST, cosine, floor[a:b]))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"src": [], "dst": [], "sim": [], "spans": []})

    return shortest(met.unionByName(rows.mapInPandas(run, "src long, dst long, sim float, spans boolean")))


def verified(nodes: DataFrame, lists: DataFrame, cosine: float) -> DataFrame:
    """``(src, dst)`` with src < dst whose double-precision cosine reaches the threshold."""
    near = lists.where(F.col("sim") >= cosine - SLACK).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    one, two = (nodes.select(F.col("node").alias(c), F.col("unit").alias(f"{c}_unit")) for c in ("src", "dst"))
    dot = F.aggregate(F.zip_with("src_unit", "dst_unit", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return near.join(one, "src").join(two, "dst").where(dot >= cosine).select("src", "dst")


def bridges(nodes: DataFrame, groups: DataFrame, full: DataFrame, cosine: float) -> DataFrame:
    """``(src, dst)``: links that join all ``groups(node, root)`` between which two saturated vectors link.

    Two vectors with full lists above the threshold may name nobody of the other's group. Saturated vectors
    are put into cells around a first member; two cells of different groups can hold a link only if the
    first members' angle is at most the threshold's plus both radii. Such cells are compared in full, unless
    first members connect their groups already, so no link between groups is left to chance.
    """
    own = full.join(groups, full["src"] == groups["node"]).select("root", "node").join(nodes.select("node", "unit"), "node")
    sizes = own.groupBy("root").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    dealt = own.join(sizes, "root").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))

    def cover(frame: pd.DataFrame) -> pd.DataFrame:
        node, unit = frame["node"].to_numpy(), np.stack(frame["unit"].to_numpy())
        angle = np.arccos(np.clip(unit @ unit.T, -1, 1))
        cell, radius = np.full(len(node), -1), np.zeros(len(node))
        for i in range(len(node)):
            if cell[i] < 0:
                mine = (cell < 0) & (angle[i] <= CELL)
                mine[i] = True
                cell[mine], radius[i] = i, angle[i][mine].max()
        return pd.DataFrame({"root": frame["root"], "cell": node[cell], "node": node, "unit": list(unit), "radius": radius})

    members = save(dealt.groupBy("root", "piece").applyInPandas(cover, "root long, cell long, node long, unit array<double>, radius double"), "cells")
    firsts = members.where("cell = node").select("root", "cell", "unit", "radius", F.size("unit").alias("dim"))
    pieces = max(1, math.ceil(firsts.count() / CELLS))
    rows = (
        firsts.withColumn("piece", F.pmod(F.xxhash64("cell"), F.lit(pieces)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        .withColumn("low", F.least("piece", "other"))
        .withColumn("high", F.greatest("piece", "other"))
    )
    limit = math.acos(cosine)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        cell, radius, piece = (frame[c].to_numpy() for c in ("cell", "radius", "piece"))
        unit = np.stack(frame["unit"].to_numpy())
        _, group = np.unique(frame["root"].to_numpy(), return_inverse=True)
        dot = unit @ unit.T
        apart = group[:, None] != group[None, :]
        if frame["low"].iloc[0] != frame["high"].iloc[0]:
            apart &= piece[:, None] != piece[None, :]
        a, b = np.nonzero((dot >= cosine) & apart)
        linked = np.zeros((group.max() + 1,) * 2, bool)
        linked[group[a], group[b]] = True
        parent, root = spanning(linked)
        sure = parent[group[a]] == group[b]
        a, b = a[sure], b[sure]
        _, once = np.unique(group[a], return_index=True)
        a, b = a[once], b[once]
        apart &= (root[:, None] != root[None, :])[group[:, None], group[None, :]]
        x, y = np.nonzero(np.triu(apart & (np.arccos(np.clip(dot, -1, 1)) <= limit + radius[:, None] + radius[None, :] + 1e-6)))
        return pd.DataFrame({"src": cell[np.concatenate([a, x])], "dst": cell[np.concatenate([b, y])], "sure": np.arange(len(a) + len(x)) < len(a)})

    met = save(rows.groupBy("dim", "low", "high").applyInPandas(meet, "src long, dst long, sure boolean"), "cell-pairs")
    open_pairs = met.where("not sure").select("src", "dst")
    asked = open_pairs.select("src", "dst", F.inline(F.array(*[F.struct(F.col(c).alias("cell"), F.lit(c == "src").alias("left")) for c in ("src", "dst")])))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        left = frame["left"].to_numpy()
        node, unit = frame["node"].to_numpy(), np.stack(frame["unit"].to_numpy())
        dot = unit[left] @ unit[~left].T
        a, b = np.unravel_index(dot.argmax(), dot.shape)
        found = dot[a, b] >= cosine
        return pd.DataFrame({"a": node[left][[a]][:found], "b": node[~left][[b]][:found]})

    exact = asked.join(members.select("cell", "node", "unit"), "cell").groupBy("src", "dst").applyInPandas(compare, "a long, b long")
    both = met.where("sure").select("src", "dst").unionByName(exact.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return both.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def dense_counts(nodes: DataFrame, groups: DataFrame, cosine: float) -> DataFrame:
    """``(node, links, weight)`` inside each of ``groups(node, root)``, by exact comparison in pieces.

    Lists that are full above the threshold are enlarged to their whole group. Every two pieces of
    ``PIECE`` members meet once; only counts leave a task.
    """
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    rows = (
        groups.join(sizes, "root")
        .join(nodes, "node")
        .withColumn("piece", piece)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("root", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "node", "unit", "copies")
    )

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        unit, piece, copies = np.stack(frame["unit"].to_numpy()), frame["piece"].to_numpy(), frame["copies"].to_numpy()
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        if frame["low"].iloc[0] != frame["high"].iloc[0]:
            near &= piece[:, None] != piece[None, :]
        return pd.DataFrame({"node": frame["node"], "links": near.sum(axis=1), "weight": near @ copies})

    found = rows.groupBy("root", "low", "high").applyInPandas(count, "node long, links long, weight long")
    return found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))


def audit(nodes: DataFrame, counted: DataFrame, cosine: float) -> tuple[int, int]:
    """(links found, links there) of the ``AUDIT`` nodes with the smallest hashes, against all nodes."""
    asked = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "unit").collect()
    by: dict[int, list] = {}
    for r in asked:
        by.setdefault(len(r["unit"]), []).append((r["node"], r["unit"]))
    known = {d: (np.array([n for n, _ in own]), np.array([u for _, u in own])) for d, own in by.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["unit"].map(len)):
                if dim in known:
                    node, unit = known[dim]
                    near = np.stack(part["unit"].to_numpy()) @ unit.T >= cosine
                    near &= part["node"].to_numpy()[:, None] != node[None, :]
                    yield pd.DataFrame({"there": [int(near.sum())]})

    there = nodes.select("node", "unit").mapInPandas(run, "there long").agg(F.sum("there")).first()[0] or 0
    mine = nodes.sparkSession.createDataFrame([(r["node"],) for r in asked], "node long")
    found = counted.join(F.broadcast(mine), "node").agg(F.sum("links")).first()[0] or 0
    return found, there


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", tries: int = 4
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row.

    Links join different rows whose cosine (double precision) is at least ``cosine``; vectors of another
    dimension, null or zero vectors and those with null or non-finite components link with nothing. Copies
    are compared once and counted each. A component's id is its smallest row id (null only if it has no
    other). Repeated ids are rows of their own; other columns are not read.

    Lists start from blocks of random-projection trees (their number follows from the count and the
    threshold), and NN-descent rounds refine them. Links met beyond a list's end still join their groups, and
    saturated vectors of different groups are compared through cells, so that two linked dense groups are
    one; groups with saturated lists are then compared exactly, the links between their parts too. Recall
    against brute force is measured on a sample; below ``recall`` more trees are added, ``tries`` times at
    most, after which an error names the recall reached.
    """
    rows = save(unit_rows(vectors, id_col, vector_col), "vectors")
    classes = rows.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    nodes = save(classes, "vector-classes")
    trees, lists, first = trees_for(nodes.count(), cosine), None, 0
    for _ in range(tries):
        start = first_lists(nodes, range(first, first + trees), cosine)
        lists = save(shortest(start if lists is None else start.unionByName(lists.drop("listed"))), "lists")
        for _ in range(ROUNDS):
            lists = save(descend(nodes, lists, cosine), "lists")
        edges = save(verified(nodes, lists, cosine), "links")
        groups = save(components(edges), "groups")
        full = lists.where("listed").groupBy("src").agg(F.min("sim").alias("least"), F.count("*").alias("n")).where((F.col("n") >= LIST) & (F.col("least") >= cosine - SLACK))
        across = save(bridges(nodes, groups, full, cosine), "bridges")
        if across.take(1):
            edges = edges.unionByName(across)
            groups = save(components(edges), "groups")
        dense = full.join(groups, full["src"] == groups["node"]).select("root").distinct()
        exact = dense_counts(nodes, groups.join(dense, "root", "left_semi"), cosine)
        open_edges = edges.join(groups, edges["src"] == groups["node"]).join(dense, "root", "left_anti").select("src", "dst")
        both = open_edges.unionByName(open_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        weights = nodes.select(F.col("node").alias("dst"), "copies")
        plain = both.join(weights, "dst").groupBy("src").agg(F.count("*").alias("links"), F.sum("copies").alias("weight"))
        counted = save(exact.unionByName(plain.withColumnRenamed("src", "node")), "link-counts")
        found, there = audit(nodes, counted, cosine)
        if found >= recall * there:
            break
        first, trees = first + trees, 2 * trees
    else:
        raise RuntimeError(f"recall {found / there:.3f} after {first} trees is below {recall}")
    per_class = (
        nodes.select("unit", "node", "copies")
        .join(groups, "node", "left")
        .join(counted, "node", "left")
        .select(
            F.col("unit").alias("same"),
            F.coalesce("root", "node").alias("root"),
            (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    placed = rows.join(per_class, rows["unit"] == per_class["same"], "left").select("row", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", -F.col("row") - 1).alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(least, "root").select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
