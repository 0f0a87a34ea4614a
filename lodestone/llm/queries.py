"""The operators' queries over whole tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, decontaminate, htmltext, labelled_pages, linededup, neighbours, packing, setjoin, sharding, sstable, urlfilter
from .store import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards by version 1 of the slot map; grown_shard by version 2, with 41. Bytes are summed a slot, and version 3 is version 1 rebalanced by them, which the law `key` can't follow. All are stored; rows are placed by what is read back."""
    docs, folder = table(spark, sf_dir, "documents"), new_path(spark, "slot-map")
    summed = sharding.stored_bytes(docs, folder)
    first = sharding.SlotMap.initial(40)
    balanced = replace(first.rebalanced(sharding.weights(summed)), version=3)
    current, larger, _ = sharding.stored(spark, folder, first, first.grown(), balanced)
    placed = sharding.place(docs, current, larger, summed=summed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "virtual_slot_bytes")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.write_and_read(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classify.fit(docs, table(spark, sf_dir, "labels"), "quality")
    scored = classify.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", classify.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ids=False)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = htmltext.train(labelled_pages.pages())
    out = htmltext.extract(table(spark, sf_dir, "pages"), model, keep=["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = decontaminate.hit_words()
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_sharding, op4_ngram_jaccard, op5_token_sstable, op6_quality, op7_packing, op8_html_text, op9_fingerprint, op10_decontaminate)
}

SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text FROM documents),
l AS (SELECT r, doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
bad AS (SELECT line FROM l WHERE length(line) >= {linededup.MIN_CHARS} GROUP BY line HAVING count(DISTINCT site) >= {linededup.MIN_SITES}),
m AS (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.line = bad.line),
k AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

_A, _B = urlfilter.UPPER, urlfilter.LOWER
SQL["op2_url_filter"] = f"""
WITH r(host, path, verdict) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)}),
p AS (SELECT row_number() OVER () AS n, page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
u AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_A}', '{_B}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT u.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC) AS best
      FROM u JOIN r ON (u.host = r.host OR suffix(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.n = m.n AND m.best = 1"""

#: crc32 by its table, which is made from the polynomial; slots, owners and growth as in sharding.SlotMap.
SQL["op3_sharding"] = """
WITH RECURSIVE b(n, c, k) AS (SELECT n, n, 0 FROM range(256) t(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
t AS (SELECT list(c ORDER BY n) AS crc FROM b WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT r, hex(encode(text)) AS hex FROM d),
x AS (SELECT r, list_transform(range(1, length(hex), 2), lambda i: CAST('0x' || substr(hex, i, 2) AS BIGINT)) AS bytes FROM h),
c AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, y: xor(s >> 8, crc[(xor(s, y) & 255) + 1])), 4294967295) AS text_crc32 FROM x, t),
s AS (SELECT d.r, doc_id, CAST(strlen(text) + 16 AS BIGINT) AS size, text_crc32, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 8192 AS INTEGER) AS virtual_slot FROM d JOIN c USING (r)),
v AS (SELECT *, CAST(virtual_slot % 40 AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id, text_crc32, size) - 1 AS slot,
CASE WHEN (virtual_slot // 40 + 1 + shard) % 41 = 0 THEN 40 ELSE shard END AS grown_shard, virtual_slot, CAST(sum(size) OVER (PARTITION BY virtual_slot) AS BIGINT) AS virtual_slot_bytes FROM v"""
SQL["op4_ngram_jaccard"] = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_A}', '{_B}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[p : p + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM i JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(r, o) AS (SELECT r, r FROM d UNION SELECT c.r, l.b FROM c JOIN l ON c.o = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id FROM d JOIN c ON d.r = c.r JOIN d o ON c.o = o.r LEFT JOIN n ON d.r = n.r GROUP BY d.r, d.doc_id, n.n"""
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_B}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op10_decontaminate"] = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT r, m, p, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
h AS (SELECT r, p, dg.m, item FROM dg JOIN win ON dg.m = win.m AND dg.g = win.g),
q AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM h) GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (r) LEFT JOIN f USING (r)"""
