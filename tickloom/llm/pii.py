"""Personal data by patterns, and unseen identifiers by bootstrapped contexts; built-in functions only.

Base kinds are regular expressions. Their matches are seeds: the words around a seed are a pattern, and
patterns and the identifier-like tokens that they surround form a graph. Patterns are scored by the
confidence of their instances, instances by that of their patterns, round by round; what confident
patterns surround is reported as kind ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.shared import empty_if_null, save

KINDS = ("email", "ip", "card", "phone", "id")
# Possessive forms of the base patterns: they match the same, without backtracking. A match starts at the
# start of a run of its first characters, or where the match before it ended.
REGEX = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "id": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CONTEXT = 80
ROUNDS = 3
#: Distinct seeds that a pattern needs, and the confidences at which patterns and instances count.
SUPPORT = 3.0
PATTERN = 0.6
INSTANCE = 0.8
MIN_ID = 5


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by 10."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", found.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(kind == "card", n.between(12, 19) & _luhn(F.when(n.between(12, 19), digits).otherwise("0")))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _words(text: Column) -> Column:
    """Lower-cased words with digits levelled, as patterns compare them."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"\s+"), lambda w: w != "")


def occurrences(rows: DataFrame) -> DataFrame:
    """All matches of ``rows(id, content, text)``: ``(id, content, kind, begin, finish, value, patterns)``.

    A text is split at the matches of each kind; the lengths of what lies between, summed up, give the
    places in code points. Rows equal in id and content are one document.
    """
    text = F.col("text")
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+")), "id": F.lit(True)}
    cuts = [
        F.when(may[k], F.struct(F.lit(k).alias("kind"), F.split(text, REGEX[k], -1).alias("between"), F.regexp_extract_all(text, F.lit(REGEX[k]), F.lit(0)).alias("found")))
        for k in KINDS
    ]
    cut = rows.where(text.rlike("[0-9@]")).select("id", "content", F.explode(F.array(*cuts)).alias("cut")).where("cut is not null")
    zipped = cut.select(
        "id",
        "content",
        "cut.kind",
        F.arrays_zip(F.col("cut.between").alias("left"), F.col("cut.found").alias("found"), F.slice("cut.between", 2, F.size("cut.found")).alias("right")).alias("parts"),
    )
    each = zipped.select("id", "content", "kind", F.posexplode("parts").alias("n", "part")).where("part.found is not null")
    before = _words(F.substring("part.left", -CONTEXT, CONTEXT))
    after = _words(F.substring("part.right", 1, CONTEXT))
    near = each.select(
        "id",
        "content",
        "kind",
        "n",
        F.length("part.left").alias("gap"),
        F.col("part.found").alias("found"),
        F.slice(F.reverse(before), 1, 2).alias("before"),
        F.get(after, F.lit(0)).alias("after"),
    ).dropDuplicates(["id", "content", "kind", "n"])
    upto = Window.partitionBy("id", "content", "kind").orderBy("n")
    placed = near.withColumn("finish", F.sum(F.col("gap") + F.length("found")).over(upto))
    # Punctuation around an identifier-like token isn't part of it.
    headless = F.when(F.col("kind") == "id", F.regexp_replace("found", r"^[^\p{L}0-9+]+", "")).otherwise(F.col("found"))
    bare = F.when(F.col("kind") == "id", F.regexp_replace("headless", r"[^\p{L}0-9]+$", "")).otherwise(F.col("headless"))
    trimmed = placed.withColumn("headless", headless).withColumn("value", bare)
    first, second = F.get("before", F.lit(0)), F.get("before", F.lit(1))
    patterns = F.array(F.concat(F.lit("1 "), first), F.concat(F.lit("2 "), second, F.lit(" "), first), F.concat(F.lit("3 "), first, F.lit(" _ "), F.col("after")))
    return trimmed.where(_valid(F.col("kind"), F.col("found")) & ((F.col("kind") != "id") | (F.length("value") >= MIN_ID))).select(
        "id",
        "content",
        "kind",
        (F.col("finish") - F.length("headless")).alias("begin"),
        (F.col("finish") - F.length("headless") + F.length("value")).alias("finish"),
        "value",
        F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"),
    )


def without_base(found: DataFrame) -> DataFrame:
    """``found`` without the identifier-like tokens that overlap a base match of their document."""
    base = F.col("kind") != "id"
    upto = Window.partitionBy("id", "content").orderBy("begin").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy("id", "content").orderBy("begin").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    seen = found.withColumns({"reached": F.max(F.when(base, F.col("finish"))).over(upto), "next": F.min(F.when(base, F.col("begin"))).over(onward)})
    free = (F.coalesce("reached", F.lit(-1)) <= F.col("begin")) & (F.col("next").isNull() | (F.col("next") >= F.col("finish")))
    return seen.where(base | free).drop("reached", "next")


def confident(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(value)``: unseen identifier-like tokens that confident patterns surround.

    A pattern's confidence for a kind is the share of that kind among its distinct instances, in terms of
    their confidences, if they sum up to ``SUPPORT`` at least; an unseen instance's is the chance that not
    all of its confident patterns err. Hot patterns and values are summed before each join.
    """
    edges = save(found.select("kind", "value", F.explode("patterns").alias("pattern")).distinct(), "pii-graph")
    sizes = edges.groupBy("pattern").agg(F.count_distinct("value").alias("size"))
    seeds = edges.where("kind <> 'id'").select("value", "kind", F.lit(1.0).alias("trust")).distinct()
    unseen = edges.where("kind = 'id'").select("value", "pattern")
    trusted = seeds
    for _ in range(rounds):
        good = (
            edges.select("value", "pattern")
            .distinct()
            .join(trusted, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("trust").alias("sum"))
            .where(F.col("sum") >= SUPPORT)
            .join(sizes, "pattern")
            .where(F.col("sum") / F.col("size") >= PATTERN)
            .select("pattern", "kind", (F.col("sum") / F.col("size")).alias("share"))
        )
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-9)))))
        reached = unseen.join(good, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("trust")).where(F.col("trust") >= INSTANCE)
        trusted = save(seeds.unionByName(reached), "pii-trust")
    return trusted.join(seeds.select("value").distinct(), "value", "left_anti").select("value").distinct()


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, content, kind, begin, finish, value)``: one row per span; see ``find`` for documents."""
    text = empty_if_null(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    found = save(occurrences(rows), "pii-matches")
    free = save(without_base(found), "pii-free")
    new = free.where("kind = 'id'").join(confident(free), "value", "left_semi")
    columns = ["id", "content", "kind", "begin", "finish", "value"]
    return free.where("kind <> 'id'").select(columns).unionByName(new.select(columns))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, content, spans)`` of every row of ``docs``: an array of (begin, order, kind, finish, value), sorted.

    Places are code points, ``finish`` exclusive, ``order`` is the kind's place in ``KINDS``. Null and empty
    texts have no spans; repeated rows come out as often as they came in; other columns are not read.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("begin", order.alias("order"), "kind", "finish", "value")
    by_document = spans(docs, id_col, text_col).groupBy(F.col("id").alias("i"), F.col("content").alias("c")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(empty_if_null(F.col(text_col))).alias("content"))
    joined = rows.join(by_document, F.col("id").eqNullSafe(F.col("i")) & (F.col("content") == F.col("c")), "left")
    none = F.array().cast("array<struct<begin:bigint,order:bigint,kind:string,finish:bigint,value:string>>")
    return joined.select(F.col("id").alias(id_col), "content", F.coalesce("spans", none).alias("spans"))
