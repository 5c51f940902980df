"""Near duplicates by SimHash fingerprints, linked through sharded BK-trees."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.components import components
from tickloom.llm.shared import free_name, release, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SHARD_ROWS = 2_048
FOREST_ROWS = 65_536


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash: a bit is 1 if more than half of the word shingles' XXH64 (seed 42) have it.

    A-Z are lower-cased and words are runs of non-blank bytes; a text with fewer than ``width`` words
    is one shingle, a text without words (null, empty, blank) is zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = len(words) - width + 1
    spans = zip((end - size)[:n].tolist(), end[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], 42) for a, b in spans), "<u8", n))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` have, as a signed number; zero without any."""
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")
        # Blocks of 255 rows cannot overflow a byte.
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_of(text: Column, width: int) -> Column:
    """The fingerprint of a text column; Arrow batches through ``fingerprint``, no shuffle."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return run(text)


def shard_keys(radius: int, blocks: int) -> list[list[tuple[int, int]]]:
    """Bit ranges (start, length) of each shard family.

    Two fingerprints within ``radius`` differ in at most ``radius`` of the blocks, so they agree on
    some ``blocks - radius`` of them: every such choice of blocks is one family.
    """
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    ranges = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [list(c) for c in combinations(ranges, blocks - radius)]


class Forest:
    """BK-trees of many shards, built and searched together, level by level.

    A child hangs on its parent under their integer Hamming distance; the first value that arrives
    under a distance becomes the child, as in one-by-one insertion.
    """

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        order = np.argsort(shard, kind="stable")
        self.value = value[order]
        self.shards, first = np.unique(shard[order], return_index=True)
        self.root = first
        n = len(order)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        is_root = np.zeros(n, bool)
        is_root[first] = True
        at = np.repeat(first, np.diff(np.append(first, n)))
        todo = np.flatnonzero(~is_root)
        at = at[todo]
        while len(todo):
            slot = at * (BITS + 1) + np.bitwise_count(self.value[todo] ^ self.value[at])
            slots, head, inverse = np.unique(slot, return_index=True, return_inverse=True)
            child = todo[head]
            self.parent[child], self.edge[child] = slots // (BITS + 1), slots % (BITS + 1)
            rest = np.ones(len(todo), bool)
            rest[head] = False
            todo, at = todo[rest], child[inverse][rest]
        # Children of a node lie together, sorted by their distance to it.
        kids = np.flatnonzero(self.parent >= 0)
        self.slots = self.parent[kids] * (BITS + 1) + self.edge[kids]
        by = np.argsort(self.slots)
        self.kids, self.slots = kids[by], self.slots[by]

    def within(self, shard: np.ndarray, value: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (query, node) within ``radius``; only edges with |edge - distance| <= radius are followed."""
        found = np.searchsorted(self.shards, shard)
        found[found == len(self.shards)] = 0
        query = np.flatnonzero(self.shards[found] == shard)
        node = self.root[found[query]]
        while len(query):
            far = np.bitwise_count(value[query] ^ self.value[node]).astype(np.int64)
            near = far <= radius
            yield query[near], node[near]
            base = node * (BITS + 1)
            low = np.searchsorted(self.slots, base + np.maximum(far - radius, 0))
            high = np.searchsorted(self.slots, base + np.minimum(far + radius, BITS), side="right")
            width = high - low
            query = np.repeat(query, width)
            skip = np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width)
            node = self.kids[np.repeat(low, width) + skip]


def _spanning(shard: np.ndarray, value: np.ndarray, is_tree: np.ndarray, is_query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, value) that connect what lies within ``radius`` inside each shard; one per value at most."""
    forest = Forest(shard[is_tree], value[is_tree])
    asks = np.flatnonzero(is_query)
    values, place = np.unique(np.concatenate([forest.value, value[asks]]), return_inverse=True)
    node_at, query_at = place[: len(forest.value)], place[len(forest.value) :]
    left, right = [], []
    for step in range(0, len(asks), FOREST_ROWS // 4):
        part = asks[step : step + FOREST_ROWS // 4]
        for query, node in forest.within(shard[part], value[part], radius):
            a, b = query_at[step + query], node_at[node]
            left.append(a[a != b])
            right.append(b[a != b])
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(values))
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    linked = label != np.arange(len(values))
    return values[linked], values[label[linked]]


def links(fps: DataFrame, radius: int = 4, blocks: int = 6, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(src, dst)``: edges that join all of the distinct ``fps.fp`` within ``radius`` bits of each other.

    Shards are the fingerprints that agree on some blocks (see ``shard_keys``), so no pair within the
    radius is lost. A shard above ``shard_rows`` is dealt into pieces and every two pieces meet as one
    group, so no task holds more than two pieces at once, however hot a block value is. Each group
    builds its BK-tree and follows only edges within the radius; the edges it gives span its links, so
    a cluster of g fingerprints yields at most g of them and never all pairs.
    """
    families = [
        F.struct(
            F.lit(i).alias("family"),
            F.xxhash64(*[F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << size) - 1)) for start, size in family]).alias("shard"),
        )
        for i, family in enumerate(shard_keys(radius, blocks))
    ]
    rows = fps.select("fp", F.inline(F.array(*families)))
    sizes = rows.groupBy("family", "shard").count().where(F.col("count") > shard_rows)
    pieces = F.coalesce(F.ceil(F.col("count") / shard_rows), F.lit(1)).cast("int")
    dealt = (
        rows.join(sizes, ["family", "shard"], "left")
        .withColumn("pieces", pieces)
        .withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(
            F.xxhash64("family", "shard", F.least("piece", "other"), F.greatest("piece", "other")).alias("group"),
            "fp",
            (F.col("piece") <= F.col("other")).alias("is_tree"),
            (F.col("piece") >= F.col("other")).alias("is_query"),
        )
        .repartition("group")
        .sortWithinPartitions("group", "fp")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            group = rows["group"].to_numpy()
            again = np.zeros(len(group), bool)
            again[1:] |= group[1:] == group[:-1]
            again[:-1] |= group[1:] == group[:-1]
            rows = rows[again]
            if rows.empty:
                return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
            fp = rows["fp"].to_numpy().astype("<i8").view("<u8")  # bitwise_count drops the sign of signed values
            out = _spanning(rows["group"].to_numpy(), fp, rows["is_tree"].to_numpy(), rows["is_query"].to_numpy(), radius)
            return pd.DataFrame({"src": out[0].view("<i8"), "dst": out[1].view("<i8")})

        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= FOREST_ROWS:
                rows = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(rows["group"].to_numpy(), rows["group"].iloc[-1]))
                yield solve(rows.iloc[:cut])
                held = [rows.iloc[cut:]]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(run, "src long, dst long")


def classify(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``fps(id, fp, ...)`` with ``component_id`` (smallest id of the component) and ``root`` (its smallest fp)."""
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(classes.select("fp"), radius, blocks))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(heads, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(
    docs: DataFrame, radius: int = 4, width: int = 4, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, fp, component_id)`` of every row: the smallest id reachable through fingerprint links.

    Null texts count as empty; texts without words have fingerprint zero and link like any other. Null
    ids are passed over by the minimum (null only if a component has no other). Repeated rows come out
    as often as they came in; other columns of ``docs`` are not read.
    """
    fps = save(docs.select(F.col(id_col).alias("id"), fingerprint_of(F.col(text_col), width).alias("fp")), "fingerprints")
    return classify(fps, radius, blocks).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(
    docs: DataFrame, radius: int = 9, width: int = 5, blocks: int = 11, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each near-duplicate component: the one with the smallest id (null last).

    The defaults take five-word shingles and nine bits; a fingerprint only estimates the similarity of the
    sets (``keep_one_similar`` decides by it). Of rows that tie in the id any one stays. All
    columns come out as they were, whatever their names.
    """
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    own = docs.withColumn(fp, fingerprint_of(F.col(text_col), width)).withColumn(row, F.monotonically_increasing_id())
    table = save(own, "documents")
    found = classify(table.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row")), radius, blocks)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least"))
    return table.join(kept.select(F.col("least.row").alias(row)), row, "left_semi").drop(fp, row)


#: MinHash bands and values in each; a pair at similarity 0.8 shares a band with probability 0.9996.
BANDS = 20
BAND_ROWS = 5
#: Texts of one bucket that are compared at once, with as many others.
BUCKET_ROWS = 128
#: Bits by which fingerprints of two sets at similarity 0.8 may differ; more with probability 0.000013 at most (4 of 5
#: shingles common; 0.0000002 for long texts, 9.7 bits on average). Two unrelated ones are as near with probability 0.08.
REACH = 26
#: Shingles counted in this many texts come last in each text's order, at most ``OFTEN_KEPT`` of them.
OFTEN = 8
OFTEN_KEPT = 65_536
#: Shingles that a task counts, or hands on, at once.
SHINGLES_AT_ONCE = 1 << 20
#: Nodes at most that are broadcast to pick their texts.
FEW_NODES = 131_072


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted XXH64 values of the distinct word shingles, with words as in ``fingerprint``."""
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    if not words:
        return np.zeros(0, np.uint64)
    grams = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), "<u8", len(grams)))


def bands_of(shingles: np.ndarray) -> list[int]:
    """One key for each band of the set's minimum hashes."""
    rng = np.random.default_rng(7)
    factor, shift = rng.integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64)
    factor = factor * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * factor + shift).min(axis=0), out=least)
    return [int(np.int64(np.uint64(xxhash.xxh64_intdigest(part.tobytes(), i)).view("<i8"))) for i, part in enumerate(least.reshape(BANDS, BAND_ROWS))]


def similar(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= similarity * (len(one) + len(two) - both)


def repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one of ``sets`` holds, and in how many; long lists are counted in parts."""
    shingles, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    ends = np.cumsum([len(x) for x in sets]) // SHINGLES_AT_ONCE
    for part in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(ends)) + 1):
        if len(part):
            values, counts = np.unique(np.concatenate([sets[i] for i in part]), return_counts=True)
            shingles.append(values[counts > 1])
            times.append(counts[counts > 1])
    return np.concatenate(shingles), np.concatenate(times)


def leading(shingles: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, those in the sorted ``often`` after all others; two sets at ``similarity`` share one.

    A set that held none of them would share less than ``similarity`` of this one.
    """
    common = np.zeros(len(shingles), bool)
    if len(often):
        common = often[np.minimum(np.searchsorted(often, shingles), len(often) - 1)] == shingles
    count = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1
    return np.concatenate([shingles[~common], shingles[common]])[:count]


def _within_reach(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Pairs i > j of ``fps`` within ``radius`` bits, from one BK-tree of the distinct values."""
    values, at = np.unique(fps.astype("<i8").view("<u8"), return_inverse=True)
    one_shard = np.zeros(len(values), np.int64)
    near = np.zeros((len(values), len(values)), bool)
    for query, node in Forest(one_shard, values).within(one_shard, values, radius):
        near[query, node] = True
    return zip(*np.nonzero(np.tril(near[at][:, at], -1)), strict=True)


def often_shared(counts: DataFrame) -> np.ndarray:
    """The sorted shingles of ``counts(often, times)`` with ``OFTEN`` or more; the most frequent ones if too many."""
    table = save(counts.groupBy("often").agg(F.sum("times").alias("n")).where(F.col("n") >= OFTEN), "often")
    least, kept = OFTEN, 0
    for n, values in sorted(table.groupBy("n").count().collect(), reverse=True):
        kept += values
        if kept > OFTEN_KEPT:
            least = n + 1
            break
    rows = table.where(F.col("n") >= least).select("often").collect()
    release(table)
    return np.sort(np.array([r.often for r in rows], "<i8").view("<u8"))


def rest_pairs(heads: DataFrame, groups: DataFrame, often: np.ndarray, similarity: float, width: int) -> DataFrame:
    """``(src, dst)``: pairs of ``heads(node, text)`` from different ``groups(node, root)``, all those at ``similarity`` among them.

    The shingles that two texts share either lead in both or come after the ``leading`` ones of the text whose leading ones
    end first, and after the last that leads in both. So what they share leading and the lesser rest bound what they share
    at all; these bounds and that of the sizes are exact and know no fingerprints or bands. The order of the shingles only decides how many other pairs
    pass. The rows of a shingle are dealt into pieces of which every two meet.
    """

    def flat(held: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
        counts = [len(x) for _, _, x in held]
        token = np.concatenate([x for _, _, x in held]).view("<i8")
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
        node, size = (np.repeat(np.array([x[i] for x in held], t), counts) for i, t in ((0, np.int64), (1, np.int32)))
        return pd.DataFrame({"token": token, "node": node, "size": size, "place": place})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for frame in frames:
            for node, text in zip(frame["node"], frame["text"], strict=True):
                shingles = shingle_set(text, width)
                if len(shingles):
                    held.append((node, len(shingles), leading(shingles, often, similarity)))
                    rows += len(held[-1][2])
                if rows > SHINGLES_AT_ONCE // 4:
                    yield flat(held)
                    held, rows = [], 0
        if held:
            yield flat(held)

    leads = save(heads.select("node", "text").mapInPandas(run, "token long, node long, size int, place int"), "leads")
    rooted = leads.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least <> most")
    dealt = (
        rooted.join(mixed.select("token", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("pieces")), "token")
        .withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
        .select("token", "node", "size", "place", "root", "pieces", "piece")
    )
    dealt = save(dealt, "dealt")
    own = ("node", "size", "place", "root")
    one = dealt.select("token", F.col("piece").alias("low"), F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("high"), *[F.col(c).alias(f"{c}_1") for c in own])
    two = dealt.select("token", F.explode(F.sequence(F.lit(0), "piece")).alias("low"), F.col("piece").alias("high"), *[F.col(c).alias(f"{c}_2") for c in own])
    longer = F.greatest("size_1", "size_2")
    meet = (
        ((F.col("low") < F.col("high")) | (F.col("node_1") < F.col("node_2"))) & (F.col("root_1") != F.col("root_2"))
        & (F.least("size_1", "size_2") >= similarity * longer - 1e-6)
    )
    least = similarity / (1 + similarity) * (F.col("size_1") + F.col("size_2")) - 1e-6
    rests = [F.ceil(similarity * longer - 1e-9), F.col("size_1") - F.col("place_1"), F.col("size_2") - F.col("place_2")]
    found = one.join(two, ["token", "low", "high"]).where(meet)
    found = found.select(F.least("node_1", "node_2").alias("src"), F.greatest("node_1", "node_2").alias("dst"), (F.least(*rests) - 1 - least).alias("over"))
    pairs = save(found.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("over").alias("over")).where("n + over >= 0").select("src", "dst"), "rest")
    release(leads)
    release(dealt)
    return pairs


def _few(nodes: DataFrame) -> DataFrame:
    """``nodes`` written, to be broadcast if there are few of them."""
    table = save(nodes, "nodes")
    return F.broadcast(table) if table.count() <= FEW_NODES else table


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The ``pairs(src, dst)`` of ``texts(node, text)`` whose shingle sets reach ``similarity``; only texts in a pair are shuffled."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(shingle_set(x, width), shingle_set(y, width), similarity) for x, y in zip(a, b, strict=True)], dtype=bool)

    nodes = _few(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    wanted = texts.select("node", "text").join(nodes, "node", "left_semi")
    one, two = (wanted.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text")) for c in ("src", "dst"))
    return save(pairs.join(one, "src").join(two, "dst").where(near("src_text", "dst_text")).select("src", "dst"), "similar")


def similar_groups(texts: DataFrame, spare: DataFrame, similarity: float, width: int, often: np.ndarray | None = None) -> DataFrame:
    """``(node, root)`` of the texts of ``texts(node, text, fp, bands)`` but ``spare(node)`` whose shingle sets are linked at ``similarity``.

    A bucket of a band is a shard of fingerprints, with its first text as the root of its BK-tree. Children of the root
    within ``REACH`` bits are verified by their sets. Shards that then still hold several groups get whole trees, in
    pieces of which every two meet, and what lies within ``REACH`` bits there is verified unless linked before; so no
    link between groups of a shard is left out. With ``often`` the pairs that share no band or differ in more bits are
    found too (``rest_pairs``).
    """
    heads = texts.join(_few(spare), "node", "left_anti")
    buckets = save(heads.select("node", "fp", F.explode("bands").alias("bucket")), "buckets")
    root = F.min(F.struct("node", "fp"))
    shared = buckets.groupBy("bucket").agg(root.alias("first"), F.count("*").alias("n")).where("n > 1")
    held = save(buckets.join(shared, "bucket"), "shared-buckets")

    edge = F.bit_count(F.col("first.fp").bitwiseXOR(F.col("fp")))
    children = held.where((F.col("first.node") != F.col("node")) & (edge <= REACH))
    pairs = save(children.select(F.col("first.node").alias("src"), F.col("node").alias("dst")).distinct(), "children")
    edges = verified(pairs, texts, similarity, width)
    groups = save(components(edges), "groups")
    rooted = held.join(groups, "node", "left").select("bucket", "node", "fp", "n", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    dealt = (
        rooted.join(mixed, "bucket")
        .withColumn("pieces", F.ceil(F.col("n") / BUCKET_ROWS).cast("int"))
        .withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("bucket", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "node", "fp", "root")
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        node, label = frame["node"].to_numpy(), frame["root"].to_numpy().copy()
        src, dst = [], []
        if (label != label[0]).any():
            sets = [shingle_set(t, width) for t in frame["text"]]
            for i, j in _within_reach(frame["fp"].to_numpy(), REACH):
                if label[i] != label[j] and similar(sets[i], sets[j], similarity):
                    src.append(node[i])
                    dst.append(node[j])
                    label[label == label[j]] = label[i]
        return pd.DataFrame({"src": src, "dst": dst}, dtype="int64")

    dealt = save(dealt, "dealt")
    wanted = texts.select("node", "text").join(_few(dealt.select("node").distinct()), "node", "left_semi")
    more = dealt.join(wanted, "node").groupBy("bucket", "low", "high").applyInPandas(compare, "src long, dst long")
    edges = edges.unionByName(more)
    if often is None:
        return components(edges)
    edges = save(edges, "edges")
    found = save(components(edges), "groups")
    return components(edges.unionByName(verified(rest_pairs(heads, found, often, similarity, width), texts, similarity, width)))


def keep_one_similar(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", complete: bool = False
) -> DataFrame:
    """One row of ``docs`` for each group linked by the Jaccard similarity of word shingles; rows as in ``keep_one``.

    Fingerprints of the shingle sets are searched by BK-trees in shards. Agreement on some of 64 bits gives no shards for
    pairs as far apart as 0.8, so a text's shards are its MinHash bands (a pair at 0.8 shares none with probability
    0.0004, less above), and ``REACH`` is the radius in them. A pair is linked only if its shingle sets reach
    ``similarity``. Rows with equal sets are one group. ``complete`` goes on from there to the pairs that share no band or
    whose fingerprints differ in more bits, so that every pair at ``similarity`` is linked.
    """
    sign, row = free_name(docs, "sign"), free_name(docs, "row")

    @F.pandas_udf("bands array<long>, same binary, fp long, often array<long>, times array<long>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
        often, times = [None] * len(sets), [None] * len(sets)
        if sets and complete:
            # The first row carries the counts of its batch.
            shingles, counts = repeated(list(dict(zip(same, sets, strict=True)).values()))
            often[0], times[0] = shingles.view("<i8"), counts
        return pd.DataFrame(
            {"bands": [bands_of(x) for x in sets], "same": same, "fp": np.array([majority(x) for x in sets], "int64"), "often": often, "times": times}
        )

    table = save(docs.withColumn(sign, signed(F.col(text_col))).withColumn(row, F.monotonically_increasing_id()), "documents")
    rows = table.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(f"{sign}.same").alias("same"))
    classes = save(rows.groupBy("same").agg(F.min("row").alias("node"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least")), "shingle-classes")
    texts = table.select(F.col(row).alias("node"), F.col(text_col).alias("text"), F.col(f"{sign}.fp").alias("fp"), F.col(f"{sign}.bands").alias("bands"))
    often = None
    if complete:
        counts = table.select(F.explode(F.arrays_zip(F.col(f"{sign}.often").alias("often"), F.col(f"{sign}.times").alias("times"))).alias("x"))
        often = often_shared(counts.select("x.often", "x.times"))
    spare = rows.select(F.col("row").alias("node")).join(classes.select("node"), "node", "left_anti")
    groups = similar_groups(texts, spare, similarity, width, often)
    kept = classes.join(groups, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least"))
    return table.join(kept.select(F.col("least.row").alias(row)), row, "left_semi").drop(sign, row)
