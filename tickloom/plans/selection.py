"""Queries for ranking, selection, sampling and set operations (K1-K3, K5-K10; K4 is one_position_trades)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import selection as sel
from tickloom.operators.ordered import row_numbers
from tickloom.operators.windows import every_kth
from tickloom.plans.registry import query
from tickloom.plans.stats_trading import POLICY_DAYS, TAPE, policy_days, selected, tape
from tickloom.plans.views import HOUR

POLS = f"SELECT policy, side, sum(labelled)::BIGINT AS labelled, sum(markout_sum) / nullif(sum(labelled), 0) AS mean FROM ({POLICY_DAYS}) GROUP BY 1, 2"


def policies(v):
    n = F.sum("labelled")
    return policy_days(v).groupBy("policy", "side").agg(n.alias("labelled"), F.try_divide(F.sum("markout_sum").cast("double"), F.nullif(n, F.lit(0)).cast("double")).alias("mean"))


@query("stable_ranking", f"SELECT *, row_number() OVER (PARTITION BY side ORDER BY mean DESC NULLS LAST, labelled DESC, policy) AS rank FROM ({POLS})", dbl="mean")
def stable_ranking(v):
    return sel.ranked(policies(v), ["side"], [F.col("mean").desc_nulls_last(), F.col("labelled").desc(), F.col("policy").asc()])


@query("tail_select", f"{TAPE} SELECT seg, g_us, day, gross FROM sel", dbl="gross")
def tail_select(v):
    return selected(v).select("seg", "g_us", "day", "gross")


@query("non_overlapping", f"{TAPE} SELECT seg, g_us, day, gross FROM tape", dbl="gross")
def non_overlapping(v):
    return tape(v).select("seg", "g_us", "day", "gross")


@query(
    "stratified_sample",
    "SELECT event_type, ord FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(ord::VARCHAR)) AS n FROM ev) WHERE n <= 25",
)
def stratified_sample(v):
    return sel.stratified_first(v.ev, ["event_type"], F.md5(F.col("ord").cast("string")), 25).select("event_type", "ord")


@query(
    "stride_sample",
    """WITH r AS (SELECT seg, ord, row_number() OVER (PARTITION BY seg ORDER BY ts_us) AS rn, count(*) OVER (PARTITION BY seg) AS n FROM prints),
       s AS (SELECT seg, floor(i * (n - 1) / 99.0)::BIGINT + 1 AS rn FROM (SELECT seg, max(n) AS n FROM r GROUP BY 1), range(0, 100) t(i))
       SELECT 'stride' AS how, seg, ord FROM r WHERE (rn - 1) % 7 = 0 UNION ALL SELECT 'spaced', r.seg, r.ord FROM r JOIN (SELECT DISTINCT * FROM s) s ON s.seg = r.seg AND s.rn = r.rn
       UNION ALL SELECT 'cadence', seg, ts_us FROM (SELECT seg, g_us AS ts_us FROM grid) WHERE ts_us % 14400000000 = 0""",
)
def stride_sample(v):
    p = v.prints.select("seg", "ord", "ts_us")
    stride = every_kth(p, ["seg"], "ts_us", 7, v.time).select(F.lit("stride").alias("how"), "seg", "ord")
    spaced = sel.evenly_spaced(p, ["seg"], "ts_us", 100, v.time).select(F.lit("spaced").alias("how"), "seg", "ord")
    cadence = v.grid.where(F.col("g_us") % (4 * HOUR) == 0).select(F.lit("cadence").alias("how"), "seg", F.col("g_us").alias("ord"))
    return stride.unionByName(spaced).unionByName(cadence)


@query(
    "dedupe_first",
    """SELECT uid, k, arg_min(ord, ts_us) AS ord, min(ts_us) AS ts_us, count(*) > 1 AS had_duplicates FROM lifecycle GROUP BY 1, 2""",
)
def dedupe_first(v):
    d = v.lifecycle.select("uid", "k", "ord", "ts_us")
    first = sel.first_by_key(d, ["uid", "k"], ["ts_us"])
    n = d.groupBy("uid", "k").agg((F.count("*") > 1).alias("had_duplicates"))
    return first.join(n, ["uid", "k"])


@query(
    "union_all_by_name",
    """SELECT 'all' AS grain, NULL::BIGINT AS grp, NULL::BIGINT AS blk, count(*) AS n, sum(x1)::BIGINT AS x1 FROM wide UNION ALL SELECT 'grp', grp, NULL, count(*), sum(x1)::BIGINT FROM wide GROUP BY grp
       UNION ALL SELECT 'blk', NULL, blk, count(*), sum(x1)::BIGINT FROM wide GROUP BY blk""",
)
def union_all_by_name(v):
    def at(grain, *keys):
        return v.wide.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x1").alias("x1")).withColumn("grain", F.lit(grain))

    return at("grp", "grp").unionByName(at("blk", "blk"), allowMissingColumns=True).unionByName(at("all"), allowMissingColumns=True)


@query(
    "set_intersect_except",
    """SELECT 'common' AS part, day FROM (SELECT day FROM bars WHERE market = 0 INTERSECT SELECT day FROM bars WHERE market = 1)
       UNION ALL SELECT 'funding_only', day FROM (SELECT day FROM funding EXCEPT SELECT day FROM bars)""",
)
def set_intersect_except(v):
    spot, perp = (v.bars.where(F.col("market") == m).select("day") for m in (0, 1))
    common = spot.intersect(perp).select(F.lit("common").alias("part"), "day")
    only = v.funding.select("day").exceptAll(v.bars.select("day").distinct()).select(F.lit("funding_only").alias("part"), "day")
    return common.unionByName(only)


@query("top_n", "SELECT id, x1, x2 FROM wide ORDER BY x1 DESC, id LIMIT 50")
def top_n(v):
    return v.wide.select("id", "x1", "x2").orderBy(F.col("x1").desc(), "id").limit(50)
