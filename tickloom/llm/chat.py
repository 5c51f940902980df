"""Chat logs that grew turn by turn, cut down to the longest snapshots and rendered; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.shared import empty_if_null, save

#: Turns of a rendered row; a longer conversation goes on in further parts.
PART_TURNS = 4_096


def _term(salt: int) -> Column:
    """What one turn adds to a prefix hash; its place is part of it, so that the sum depends on the order."""
    return F.xxhash64(F.lit(salt), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def numbered(turns: DataFrame) -> DataFrame:
    """``turns(conv, turn, role, text)`` with ``place`` (from 1) and the hashes ``a, b`` of the turns so far.

    A conversation may hold a third of all rows, so it isn't numbered in one window: turn numbers are cut
    into ranges, ranges are numbered and summed one by one, and a window over the ranges of a
    conversation gives each what came before it.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = turns.withColumn("block", F.floor(F.col("turn") / PART_TURNS))
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    sizes = ranged.groupBy("conv", "block").count()
    earlier = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(F.col("conv").alias("c"), F.col("block").alias("k"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    local = ranged.withColumn("local", F.row_number().over(inside))
    placed = local.join(offset, F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("k"))).select(
        "conv", "block", "turn", "role", "text", (F.col("offset") + F.col("local")).alias("place")
    )
    summed = placed.withColumns({"ta": _term(1), "tb": _term(2)})
    running = Window.partitionBy("conv", "block").orderBy("place")
    totals = summed.groupBy("conv", "block").agg(F.bit_xor("ta").alias("xa"), F.bit_xor("tb").alias("xb"))
    zero = F.lit(0).cast("long")
    carried = totals.select(
        F.col("conv").alias("c"),
        F.col("block").alias("k"),
        F.coalesce(F.bit_xor("xa").over(earlier), zero).alias("xa"),
        F.coalesce(F.bit_xor("xb").over(earlier), zero).alias("xb"),
    )
    rolled = summed.withColumns({"ta": F.bit_xor("ta").over(running), "tb": F.bit_xor("tb").over(running)})
    return rolled.join(carried, F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("k"))).select(
        "conv", "turn", "role", "text", "place", F.col("ta").bitwiseXOR(F.col("xa")).alias("a"), F.col("tb").bitwiseXOR(F.col("xb")).alias("b")
    )


def maximal(rows: DataFrame) -> DataFrame:
    """``(conv, n)`` of the conversations that no longer one begins with; of equal ones the smallest id's.

    ``rows`` come from ``numbered``. Hot prefixes meet pre-aggregated: one row per (length, hashes).
    """
    ends = rows.groupBy("conv").agg(F.max(F.struct("place", "a", "b")).alias("end")).select("conv", F.col("end.place").alias("n"), F.col("end.a").alias("a"), F.col("end.b").alias("b"))
    sizes = ends.select(F.col("conv").alias("c"), "n")
    inner = rows.join(sizes, F.col("conv").eqNullSafe(F.col("c"))).where("place < n").select(F.col("place").alias("n"), "a", "b").distinct()
    heads = ends.groupBy("n", "a", "b").agg(F.min(F.struct(F.col("conv").isNull().alias("last"), "conv")).alias("least"))
    return heads.join(inner, ["n", "a", "b"], "left_anti").select(F.col("least.conv").alias("conv"), "n")


def render(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """ChatML text of the kept conversations: ``(conv, part, n_turns, text)``, ``PART_TURNS`` turns a part."""
    line = F.concat(F.lit("<|im_start|>"), empty_if_null(F.col("role")), F.lit("\n"), empty_if_null(F.col("text")), F.lit("<|im_end|>\n"))
    own = rows.join(kept.select(F.col("conv").alias("c"), "n"), F.col("conv").eqNullSafe(F.col("c")))
    parts = own.groupBy("conv", "n", F.floor((F.col("place") - 1) / PART_TURNS).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("text")
    )
    return parts.select("conv", "part", F.col("n").alias("n_turns"), "text")


def collapse(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rendered maximal conversations: ``(conv, part, n_turns, text)``.

    A conversation goes if a longer one begins with all its turns (role and text, in order of turn, then
    role and text), or if an equal one has a smaller id. Null roles and texts equal only nulls and are
    rendered empty; null turns come first; rows with a null id form one conversation, which loses ties;
    repeated rows are turns of their own. Other columns are not read.
    """
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = save(numbered(own), "turns")
    return render(rows, maximal(rows)).withColumnRenamed("conv", conv_col)
