"""Fill-in-middle examples: texts cut at line bounds by one match of a pattern built for each row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.shared import empty_if_null

#: A line with its break, or what follows the last break.
LINE = r"[^\n]*\n|[^\n]+"
SEED = 7
#: Texts of a hundred that are cut, and cut ones of a hundred that give the suffix first.
CUT = 100
SUFFIX_FIRST = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draw(hashes: Column, i: int) -> Column:
    """The ``i``-th group of eight hexadecimal digits as an unsigned number."""
    return F.conv(F.substring(hashes, 8 * i - 7, 8), 16, 10).cast("long")


def _quoted(mark: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", mark)


def _parts(output: Column) -> Column:
    """The pieces between the marks; no piece holds a mark, so the split gives back what was put together."""
    return F.split(output, "|".join(re.escape(m) for m in (PREFIX, SUFFIX, MIDDLE)), -1)


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of each row, in one pass without a shuffle.

    ``n`` counts the units of the whole text. The hash of seed and id draws two places among the ``n + 1`` unit
    bounds; the pattern ``(unit{a}+)(unit{b-a}+)(rest)`` then captures prefix, middle and suffix in one match, and
    the replacement writes them in the order of ``form``: psm or spm, or plain for texts left as they are. The
    counted groups are possessive, so the match keeps no way back, needs no stack and takes time linear in the text
    however long it is.

    Null texts count as empty, and empty texts and texts that hold a mark are plain with null lengths. A null id draws
    as an empty one. Repeated rows give equal rows; other columns of ``docs`` aren't carried, so none can clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), empty_if_null(F.col(text_col)).alias("text"))
    drawn = rows.select(
        "id",
        "text",
        F.regexp_count("text", F.lit(unit)).cast("long").alias("n"),
        F.sha2(F.concat(F.lit(f"{seed}:"), empty_if_null(F.col("id").cast("string"))), 256).alias("h"),
    )
    one, two = (_draw(F.col("h"), i) % (F.col("n") + 1) for i in (1, 2))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_draw(F.col("h"), 3) % 100 >= cut)
    placed = drawn.select(
        "id",
        "text",
        "n",
        F.when(plain, "plain").when(_draw(F.col("h"), 4) % 100 < suffix_first, "spm").otherwise("psm").alias("form"),
        F.least(one, two).alias("a"),
        F.greatest(one, two).alias("b"),
    )
    group = lambda count: F.concat(F.lit(f"((?:{unit}){{"), count, F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), group(F.col("a")), group(F.col("b") - F.col("a")), F.lit(r"([\s\S]*+)\z"))
    p, s, m = _quoted(PREFIX), _quoted(SUFFIX), _quoted(MIDDLE)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    written = placed.select(
        "id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output")
    )
    parts = written.withColumn("parts", F.when(F.col("form") != "plain", _parts(F.col("output"))))
    prefix_at = F.when(F.col("form") == "spm", 2).otherwise(1)
    return parts.select(
        F.col("id").alias(id_col),
        "n",
        "form",
        F.length(F.get("parts", prefix_at)).cast("long").alias("prefix_chars"),
        F.length(F.get("parts", F.lit(3))).cast("long").alias("middle_chars"),
        "output",
    )


def restored(output: Column, form: Column) -> Column:
    """The text from which an example was made."""
    parts = _parts(output)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
