"""The registered queries of this package, each with the DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import chat, decontaminate, fim, hardneg, langid, licenses, linededup, neighbours, packing, pii, quality, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query()
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["finish"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS[:4]]
    base = F.filter("spans", lambda s: s["kind"] != "id")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query(
    """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
), p AS (
  SELECT *, string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM t
), kept AS (
  SELECT min(conv_id) AS conv_id FROM p
  WHERE place = n AND prefix NOT IN (SELECT prefix FROM p WHERE place < n) GROUP BY prefix
)
SELECT conv_id, 0::BIGINT AS part, n AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM t JOIN kept USING (conv_id) GROUP BY conv_id, n
"""
)
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


# Base32 of a SHA-1 digest from its hex form: five hex digits are four base-32 digits.
BASE32 = """
array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '')
"""


@query(
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = warc.read(warc.write(pages, min_bytes=0), pages.schema["page_id"].dataType)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(name, " ".join(licenses.normal_words(t))) for name, t in licenses.TEMPLATES.items())


@query(
    f"""
WITH w AS (SELECT license, string_split(words, ' ') AS w FROM (VALUES {_TEMPLATE_ROWS}) t(license, words)),
tg AS (SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
u AS (
  SELECT doc_id, 'line' AS kind, unnest(range(len(p))) AS unit, unnest(p) AS piece
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, 'paragraph' AS kind, unnest(range(len(p))) AS unit, unnest(p) AS piece
    FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n') AS p FROM documents)
  ) WHERE contains(piece, chr(10))
), uw AS (
  SELECT doc_id, kind, unit, string_split(trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u
), ug AS (
  SELECT doc_id, kind, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM uw WHERE len(w) > 1
), hit AS (
  SELECT doc_id, kind, unit, license, 2.0::DOUBLE * len(list_intersect(ug.g, tg.g)) / (len(ug.g) + len(tg.g)) AS score
  FROM ug JOIN tg ON len(ug.g) <= 2 * len(tg.g) AND len(tg.g) <= 2 * len(ug.g)
)
SELECT * FROM hit WHERE score >= {licenses.DICE}
"""
)
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.remove(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "removed", "text")


@query(
    f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {neighbours.COSINE}
), reach(src, dst) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.src, l.dst FROM reach r JOIN link l ON r.dst = l.src
), least AS (
  SELECT src AS vec_id, min(dst) AS component_id FROM reach GROUP BY src
)
SELECT vec_id, (SELECT count(*) FROM link WHERE src = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least
"""
)
def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS tokens FROM documents
), rounded AS (
  SELECT tokens, greatest(length(bin(tokens)) - 7, 0) AS s FROM sized
), hist AS (
  SELECT (((tokens + (1::BIGINT << s) - 1) >> s) << s) AS size, count(*) AS n, sum(tokens)::BIGINT AS total
  FROM rounded GROUP BY 1
), sums AS (
  SELECT row_number() OVER w AS j, size, (sum(n) OVER w)::BIGINT AS cn, (sum(total) OVER w)::BIGINT AS ct
  FROM hist WINDOW w AS (ORDER BY size)
), dp(k, j, cost, cuts) AS (
  SELECT 1, j, size * cn - ct, [size] FROM sums
  UNION ALL
  SELECT any_value(d.k) + 1, b.j, min(d.cost + b.size * (b.cn - a.cn) - (b.ct - a.ct)),
    arg_min(list_append(d.cuts, b.size), (d.cost + b.size * (b.cn - a.cn) - (b.ct - a.ct), d.j))
  FROM dp d JOIN sums a ON a.j = d.j JOIN sums b ON b.j > d.j
  WHERE d.k < {packing.BUCKETS} GROUP BY b.j
), chosen AS (
  SELECT cuts FROM dp WHERE j = (SELECT max(j) FROM sums) ORDER BY k DESC LIMIT 1
), bounded AS (
  SELECT doc_id, tokens, len(list_filter(cuts, lambda c: c < tokens))::INT AS bucket,
    list_min(list_filter(cuts, lambda c: c >= tokens)) AS bound
  FROM sized, chosen
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY tokens, doc_id) - 1 AS r,
    greatest(1, {packing.BUDGET} // bound) AS take
  FROM bounded
)
SELECT doc_id, tokens, bucket, bound, r // take AS batch, r % take AS slot FROM ranked
"""
)
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "tokens", "bucket", "bound", "batch", "slot")


@query(
    r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS d
  FROM t
), placed AS (
  SELECT doc_id, text, u, n, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
      WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM placed
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
)
def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.examples(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query()
def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query(
    """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
)
def op13_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)
