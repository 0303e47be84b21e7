"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact, jaccard, langid, licenses, mixing, negatives, packing, quality, substring, urls, viewing
from .cluster import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_texts(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


#: What a made-up conversation -7 says in both of its turns.
AWKWARD = "\\### Assistant: </turn> ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(AWKWARD).alias("text"))
    return chat.digest(chat.render(chat.reconstruct(chat.log_of(rows.unionByName(two)))))


def op12_view_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewing.maintained(spark, *[table(spark, sf_dir, name) for name in ("sale_lines", "sales", "clients", "vendors", "nation")])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = negatives.hard_negatives(table(spark, sf_dir, "embeddings"))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The unsigned crc32 of an ASCII text t.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(t, ''), lambda c: CAST(ascii(c) AS BIGINT))),
lambda acc, c: list_reduce(list_prepend(xor(acc, c), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _lived(table: str, key: str) -> str:
    return f"(SELECT * EXCLUDE (t, h), CASE WHEN h % 7 < (h // 7) % 7 THEN h % 7 ELSE -1 END AS a, CASE WHEN h % 7 < (h // 7) % 7 THEN (h // 7) % 7 ELSE 7 END AS d FROM (SELECT *, {_CRC} AS h FROM (SELECT *, {key} AS t FROM {table})))"


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SQL = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM later),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM
       (SELECT doc_id, w, least(5, len(w)) AS k, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op9_benchmark_decontamination": f"""
WITH dw AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
bw AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM bn)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, sizes WHERE len(w) >= k),
hit AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM pos) p
        JOIN win ON win.k = p.k AND win.g = p.g),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op10_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_FOLD} AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op11_chat_formatting": rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '{AWKWARD}'), (-7, 1, 'assistant', '{AWKWARD}')),
t AS (SELECT conv_id, turn, role, text, replace(replace(role, '\', '\\'), '<|', '<\|') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS x FROM rows),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(length('<|start|>' || r || '<|text|>' || x || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c""",
    "op12_view_maintenance": f"""
WITH l AS (SELECT sale_id, item_id, vendor_id, a, d, CAST(floor(100 * amount + 0.5) * (100 - floor(100 * discount + 0.5)) AS BIGINT) AS cents FROM {_lived("sale_lines", "'l' || sale_id || ':' || line_no")} WHERE amount IS NOT NULL),
s AS (SELECT sale_id, client_id, a, d, date_diff('day', DATE '1970-01-01', CAST(sold_at AS DATE)) AS part FROM {_lived("sales", "'s' || sale_id")} WHERE sold_at IS NOT NULL),
c AS (SELECT client_id, a, d, n_regionkey FROM {_lived("clients", "'c' || client_id")} JOIN nation ON nation_id = n_nationkey),
v AS (SELECT vendor_id, n_regionkey FROM vendors JOIN nation ON nation_id = n_nationkey),
j AS (SELECT c.n_regionkey AS region, part, cents, client_id, item_id, greatest(l.a, s.a, c.a) AS a, least(l.d, s.d, c.d) AS d
FROM l JOIN s USING (sale_id) JOIN c USING (client_id) JOIN v ON v.vendor_id = l.vendor_id AND v.n_regionkey = c.n_regionkey)
SELECT CAST(b AS INTEGER) AS batch, region, part, count(*) AS n_lines, CAST(sum(cents) AS BIGINT) AS revenue, min(cents) AS min_revenue, count(DISTINCT client_id) AS n_clients, count(DISTINCT item_id) AS n_items
FROM j JOIN range(7) t(b) ON j.a <= b AND b < j.d GROUP BY ALL""",
    "op13_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5)
SELECT * FROM (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score) WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
