"""Removal of repeated passages through content-defined chunks of lines; built-in functions only.

A *line* ends at a line break or at a sentence end (``.``, ``!`` or ``?`` and one blank); one of more than
``LONG_LINE`` characters is cut further, after clauses and words with certain last letters, so that a passage without
sentence ends has lines too. Lines are hashed and a rolling hash runs over two line hashes, across line
breaks. A chunk is a line of ``OWN_WORDS`` words or more; of shorter lines, one joins the next where its
rolling hash is the largest of three. The choice depends on nearby lines only: text put in front shifts no
later boundary.

A *unit* is the first of 1, 2, 4, 8 or 16 successive chunks, from any boundary on, that has ``UNIT_WORDS``
words. Inside a repeated run of lines at most four short lines at its start and two at its end lie
outside the boundaries that both places share, so a run of 51 words holds a unit. Runs of units with equal
keys are compared byte by byte with their first place and grown line by line as long as the lines around them
are equal too; what is left of that with ``MIN_WORDS`` words or more is removed. So a repeated run of whole
lines goes whole. If a key collides, its run stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.shared import empty_if_null, free_name, release, save, scratch

#: Words that a removed passage must have; shorter ones (headers, notices, single remarks) stay.
MIN_WORDS = 24
UNIT_WORDS = 12
OWN_WORDS = 5
#: Lines around a unit that it can grow by on either side.
AROUND = 12
LONG_LINE = 300
#: Bytes of text in one bucket of the laid out table.
BUCKET_BYTES = 64 << 20
#: Bits of a position that hold the line number; a text has fewer than 2 ** 31 bytes.
LINE_BITS = 31
LINE_END = "(?<=[.!?] |\n)"
WORD_END = "(?<=[,;:dosy] |[。、])"
MARK = "\u0001"


def _bound(value: Column, make) -> Column:
    """``make(value)`` with ``value`` computed once, however often ``make`` names it."""
    return F.transform(F.array(value), make)[0]


def _lines(text: Column) -> Column:
    """The lines of a text; joined without a separator they are the text again."""
    marked = text
    for end in (". ", "! ", "? ", "\n"):
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    lines = F.when(F.contains(text, F.lit(MARK)), F.split(text, LINE_END)).otherwise(F.split(marked, MARK))
    # The number of bytes is at hand, that of characters is counted.
    is_long = lambda x: (F.octet_length(x) > LONG_LINE) & (F.length(x) > LONG_LINE)
    cut = lambda all_lines: F.flatten(F.transform(all_lines, lambda x: F.when(is_long(x), F.split(x, WORD_END)).otherwise(F.array(x))))
    return _bound(lines, lambda all_lines: F.when(F.exists(all_lines, is_long), cut(all_lines)).otherwise(all_lines))


def _words(line: Column) -> Column:
    """Words by blanks, or one per twelve characters where that is more (scripts without blanks)."""
    by_blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + F.when(line.endswith(" "), 0).otherwise(1)
    # Characters are counted only where the bytes are enough for more words.
    return _bound(by_blanks, lambda n: F.when(F.octet_length(line) < n * 12 + 12, n).otherwise(F.greatest(n, F.floor(F.length(line) / 12).cast("int"))))


def line_units(rows: DataFrame) -> DataFrame:
    """``rows(seq, text)`` as ``(seq, cuts, ends, keys)``, arrays of the chunks of each text.

    A unit begins at each of ``cuts`` (line numbers) but the last; it ends before the line in ``ends`` and has the
    hash of its line hashes in ``keys``, both null where the text ends before it has its words. Every step is
    an array function of its row. Rolling hashes and words of longer runs of chunks are made only
    where shorter ones don't settle a boundary or a unit.
    """
    split = rows.select("seq", _lines(F.col("text")).alias("lines"))
    hashed = split.select("seq", F.size("lines").alias("n"), F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", _words).alias("words"))
    rolled = lambda i: F.xxhash64(F.coalesce(F.get("h", i - 2), F.lit(0).cast("long")), F.get("h", i - 1))

    def closes(i: Column) -> Column:
        long = (F.get("words", i - 1) >= OWN_WORDS) | (i == F.col("n")) | (F.get("words", i) >= OWN_WORDS)
        before = F.when(i == 1, F.lit(0).cast("long")).otherwise(rolled(i - 1))
        return long | (before >= rolled(i)) | (rolled(i) < rolled(i + 1))

    cut = hashed.select("seq", "n", "h", "words", F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.col("n")), closes)).alias("cuts"))
    several = lambda b, e: F.aggregate(F.slice("words", b + 1, e - b), F.lit(0), lambda s, w: s + w)
    total = lambda b, i: _bound(F.get("cuts", i + 1), lambda e: F.when(e == b + 1, F.get("words", b)).otherwise(several(b, e)))
    totals = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), total)
    table = cut.select("seq", "h", "cuts", F.when(F.size("cuts") == F.col("n") + 1, F.col("words")).otherwise(totals).alias("chunks"))

    def end(words: Column, i: Column) -> Column:
        choice, so_far, m = None, words, 1
        while m <= 16:
            choice = (F if choice is None else choice).when(so_far >= UNIT_WORDS, F.get("cuts", i + m))
            # Words of twice as many chunks; null where the text ends before.
            for k in range(m, 2 * m):
                so_far = so_far + F.get("chunks", i + k)
            m *= 2
        return choice

    chosen = table.select("seq", "h", "cuts", F.transform("chunks", end).alias("ends"))

    def key(end: Column, i: Column) -> Column:
        begin = F.get("cuts", i)
        one, two = F.get("h", begin), F.get("h", begin + 1)
        return F.when(end == begin + 1, one).when(end == begin + 2, F.xxhash64(one, two)).when(end.isNotNull(), F.xxhash64(F.slice("h", begin + 1, end - begin)))

    return chosen.select("seq", "cuts", "ends", F.transform("ends", key).alias("keys"))


def number(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``(id, place, seq)`` of the different documents, and the bytes of all texts.

    ``place`` hashes id and text; documents equal in both are one. ``seq`` counts from 0 by id (nulls last)
    and place, so one number tells which of two documents comes first.
    """
    text = F.col(text_col)
    ids = save(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), empty_if_null(text)).alias("place"), F.octet_length(text).alias("bytes")), "line-ids")
    size = ids.agg(F.sum("bytes")).first()[0] or 0
    ordered = ids.select("id", "place").distinct().orderBy(F.col("id").asc_nulls_last(), "place")
    sorted_ = save(ordered.withColumn("at", F.monotonically_increasing_id()), "line-order")
    release(ids)
    # Above its lower 33 bits the number holds the partition; one row per partition tells what lies before it.
    part = F.shiftright("at", 33)
    counts = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    seq = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    numbered = save(sorted_.join(F.broadcast(before), part == F.col("part")).select("id", "place", seq.alias("seq")), "line-numbers")
    release(sorted_)
    return numbered, size


def lay_out(docs: DataFrame, numbers: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` as a table bucketed by ``place``, and the names of its columns ``place`` and ``seq``.

    All later joins with the texts follow its layout, so whole texts are shuffled once. Buckets are as many
    as the text bytes ask for, never fewer than the session's shuffle partitions.
    """
    spark = docs.sparkSession
    place, seq = free_name(docs, "place"), free_name(docs, "seq")
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"laid_{uuid.uuid4().hex}"
    placed = docs.withColumn(place, F.xxhash64(F.col(id_col), empty_if_null(F.col(text_col)))).repartition(buckets, place)
    other = numbers.select(F.col("id").alias("id__"), F.col("place").alias("place__"), F.col("seq").alias(seq)).repartition(buckets, "place__")
    id_, other_id = placed[id_col], other["id__"]
    # The ids aren't compared by ``=``: as join keys they would have the texts dealt out by id and place.
    same_id = F.coalesce((id_ <= other_id) & (id_ >= other_id), id_.isNull() & other_id.isNull())
    laid = placed.join(other.hint("shuffle_hash"), (placed[place] == other["place__"]) & same_id).drop("id__", "place__")
    laid.write.bucketBy(buckets, place).option("compression", "zstd").option("path", scratch(spark, "line-texts")).saveAsTable(name)
    return spark.table(name), place, seq


def repeated_runs(units: DataFrame) -> DataFrame:
    """``(seq, begin, end, first_seq, first_begin)``: the runs of lines that repeat the first place of their units.

    A position is a document's number and a line number in one integer, so counting shuffles two numbers per
    unit, pre-aggregated, and a unit that a third of all documents share is no hot group. Units of a document
    that touch and have their first places in one other, as far apart, are one run.
    """
    all_keys = units.select("seq", "cuts", "ends", F.posexplode("keys").alias("i", "key")).where("key IS NOT NULL")
    begin, end = F.get("cuts", F.col("i")), F.get("ends", F.col("i"))
    found = all_keys.select("key", F.shiftleft("seq", LINE_BITS).bitwiseOR(begin).alias("at"), (end - begin).alias("n"))
    firsts = found.groupBy("key").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select("key", "first")
    # One row per key and partition is held, so the units needn't be sorted.
    others = found.join(firsts.hint("shuffle_hash"), "key").where("at <> first")
    seq, begin = F.shiftright("at", LINE_BITS), F.col("at").bitwiseAND((1 << LINE_BITS) - 1).cast("int")
    placed = others.select(seq.alias("seq"), (F.col("at") - F.col("first")).alias("apart"), begin.alias("begin"), (begin + F.col("n")).alias("end"))
    line = Window.partitionBy("seq", "apart").orderBy("begin", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = placed.withColumn("opens", F.coalesce(reach < F.col("begin"), F.lit(True)).cast("int"))
    numbered = opened.withColumn("run", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("seq", "apart", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    first = F.shiftleft("seq", LINE_BITS).bitwiseOR(F.col("begin")) - F.col("apart")
    return runs.select("seq", "begin", "end", F.shiftright(first, LINE_BITS).alias("first_seq"), first.bitwiseAND((1 << LINE_BITS) - 1).cast("int").alias("first_begin"))


def _around(lines: Column, begin: Column, n: Column) -> tuple[Column, Column, Column]:
    """``n`` lines from ``begin`` on, those before them (the nearest first) and those after."""
    left = F.reverse(F.slice(lines, F.greatest(begin - AROUND, F.lit(0)) + 1, F.least(begin, F.lit(AROUND))))
    return F.slice(lines, begin + 1, n), left, F.slice(lines, begin + n + 1, AROUND)


def _shared(x: Column, y: Column) -> Column:
    """The number of equal leading lines."""
    equal = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return (F.array_position(F.concat(equal, F.array(F.lit(False))), F.lit(False)) - 1).cast("int")


def _of_document(laid: DataFrame, place: str, seq: str, found: DataFrame) -> Column:
    """Equal places and numbers. The numbers aren't compared by ``=``: as join keys they would have the laid out
    texts shuffled anew, since their layout goes by ``place`` alone."""
    return (laid[place] == found["place__"]) & (laid[seq] <= found["seq__"]) & (laid[seq] >= found["seq__"])


def repeats(laid: DataFrame, numbers: DataFrame, place: str, seq: str, text_col: str) -> DataFrame:
    """``(place__, seq__, runs)``: of each document with repeats its runs ``(begin, core, left, right)``, the lines of
    their first places with up to ``AROUND`` lines on either side.

    A place in a text is earlier if its (``seq``, line) is smaller. Only the first place of a unit stays.
    """
    saved = save(line_units(laid.select(F.col(seq).alias("seq"), empty_if_null(F.col(text_col)).alias("text"))), "line-units")
    runs = save(repeated_runs(saved), "line-runs")
    release(saved)
    places = numbers.select("seq", F.col("place").alias("place__"))
    n = F.col("end") - F.col("begin")
    wanted = runs.select(F.col("first_seq").alias("seq"), F.col("first_begin").alias("begin"), n.alias("n")).distinct()
    asked = wanted.groupBy("seq").agg(F.collect_list(F.struct("begin", "n")).alias("runs")).join(places, "seq").withColumnRenamed("seq", "seq__")

    def read(lines: Column, z: Column) -> Column:
        core, left, right = _around(lines, z["begin"], z["n"])
        return F.struct(z["begin"].alias("first_begin"), z["n"].alias("n"), core.alias("core"), left.alias("left"), right.alias("right"))

    read_all = _bound(_lines(empty_if_null(F.col(text_col))), lambda lines: F.transform("runs", lambda z: read(lines, z)))
    # What is asked of a bucket is less than its texts, which needn't be sorted so.
    asked = asked.hint("shuffle_hash")
    sources = save(laid.join(asked, _of_document(laid, place, seq, asked)).select(F.col("seq__").alias("first_seq"), read_all.alias("runs")), "line-sources")
    given = runs.withColumn("n", n).join(places, "seq").join(sources.select("first_seq", F.inline("runs")).dropDuplicates(["first_seq", "first_begin", "n"]), ["first_seq", "first_begin", "n"])
    return given.groupBy("place__", F.col("seq").alias("seq__")).agg(F.collect_list(F.struct("begin", "core", "left", "right")).alias("runs"))


def remove(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated passages, and ``removed``: the number of lines taken out of each text.

    All rows stay; a text of which nothing is left becomes empty. Null and empty texts come out as they
    were, with zero removed, and so do texts of any length without a repeat. Other columns, whatever their
    names, come out unchanged.
    """
    numbers, size = number(docs, id_col, text_col)
    laid, place, seq = lay_out(docs, numbers, size, id_col, text_col)
    found = repeats(laid, numbers, place, seq, text_col)
    runs, lines = (free_name(laid, c) for c in ("runs", "lines"))
    other = found.withColumnRenamed("runs", runs)
    joined = laid.join(other.hint("shuffle_hash"), _of_document(laid, place, seq, other), "left").drop("place__", "seq__")

    def grown(all_lines: Column, z: Column) -> Column:
        n = F.size(z["core"])
        core, left, right = _around(all_lines, z["begin"], n)
        b, e = z["begin"] - _shared(left, z["left"]), z["begin"] + n + _shared(right, z["right"])
        return F.when(core == z["core"], F.sequence(b, e - 1)).otherwise(F.array().cast("array<int>"))

    def stay(all_lines: Column, repeated: Column) -> Column:
        following = F.transform(repeated, lambda i: i + 1)
        spans = F.zip_with(F.array_except(repeated, following), F.array_except(following, repeated), lambda b, e: F.struct(b.alias("begin"), e.alias("end")))
        words = lambda z: F.aggregate(F.slice(all_lines, z["begin"] + 1, z["end"] - z["begin"]), F.lit(0), lambda s, x: s + _words(x))
        gone = F.flatten(F.transform(F.filter(spans, lambda z: words(z) >= min_words), lambda z: F.sequence(z["begin"], z["end"] - 1)))
        return F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)

    def work(all_lines: Column) -> Column:
        repeated = F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda z: grown(all_lines, z)))))
        return F.struct(all_lines.alias("lines"), _bound(repeated, lambda r: stay(all_lines, r)).alias("stay"))

    cut = F.when(F.col(runs).isNotNull(), _bound(_lines(F.col(text_col)), work))
    parts = joined.select(*[F.col(c) for c in docs.columns], cut.alias(lines))
    left = F.array_join(F.transform(F.col(lines)["stay"], lambda i: F.get(F.col(lines)["lines"], i)), "")
    return parts.select(
        *[F.when(F.col(lines).isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(F.col(lines).isNull(), 0).otherwise(F.size(F.col(lines)["lines"]) - F.size(F.col(lines)["stay"])).alias(free_name(docs, "removed")),
    )
