"""The queries of this folder with the SQL that they must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.llm import (exact_dedup, language_id, line_dedup, lm_scoring, minhash, mixing, packing, periodic_runs, pq_dedup,
                           spelling, substring_dedup, trie_bpe, warc)
from newsgauge.llm.shared import crc_of_id, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary(), capacity=1024)


def op3_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), _vocabulary(), held_out_of=3)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.resolve_revisits(warc.read_archives(spark, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), min_docs=5, min_chars=40)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = trie_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), _vocabulary())
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids_sha256", "decoded_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"), held_out_of=10)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_table(spark, sf_dir, "documents"), min_chars=7, min_count=2, damage_every=31)
    return spelling.spelling_variants(words, ratio=10)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which about every tenth goes on, from some word, by repeating the words from there."""
    words, h = F.col("_words"), F.col("_h")
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, 1, a), again), 1, n), " ")
    hit = docs.withColumn("_h", crc_of_id(F.col("doc_id"))).withColumn(
        "_words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))))
    return hit.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_runs(_table(spark, sf_dir, "documents")), exponent=4, least_length=6)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.minus")).alias("length"),
        F.col("_best.period").alias("period"), F.floor(-1000 * F.col("_best.minus") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most_epochs=2)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pq_near_dedup": op3_pq_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_mixing": op13_mixing,
}

#: The alphabet of base 32, by five bits from three hex digits.
_BASE32_SQL = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
    ((instr('0123456789abcdef', substr(sha || '00', 1 + CAST(i * 5 // 4 AS INT), 1)) - 1) * 256
     + (instr('0123456789abcdef', substr(sha || '00', 2 + CAST(i * 5 // 4 AS INT), 1)) - 1) * 16
     + (instr('0123456789abcdef', substr(sha || '00', 3 + CAST(i * 5 // 4 AS INT), 1)) - 1))
    >> CAST(7 - (i * 5) % 4 AS INT)) & 31 AS INT), 1) FOR i IN range(32)], '')"""

#: The table of CRC-32 (polynomial 0xEDB88320 reversed), and the checksum of a list of bytes by it.
_CRC_TABLE_SQL = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""


def _crc_sql(codes: str) -> str:
    return (f"xor(list_reduce(list_concat([4294967295], CAST({codes} AS BIGINT[])), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def _draw_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


_MIRROR_SQL = f"((({_draw_sql("key || ':' || r")} % full_blocks) - x) % full_blocks + full_blocks) % full_blocks"

ORACLES = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 34)) AS i, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS run FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY run) AS c FROM h) WHERE c > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM r),
k AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
o AS (SELECT doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN k USING (doc_id)),
e AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS x FROM w),
t AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.i) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i
      WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT o.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM o LEFT JOIN t USING (doc_id)""",
    "op3_pq_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_count(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
c(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id WHERE c.root < l.b),
m AS (SELECT id, min(root) AS root FROM c GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op5_warc_revisits": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS sha, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32_SQL} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM h""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE_SQL},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, n, {_crc_sql("flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))")} AS h FROM d, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM v, generate_series(1, length(word)) AS s(i)),
p AS (SELECT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM g a JOIN v b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM g a JOIN v b ON a.less = b.word),
m AS (SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form,
  CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN m USING (word)),
c(word, last, form) AS (SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.form IS NULL""",
    "op12_periodic_runs": rf"""
WITH {_CRC_TABLE_SQL},
t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  {_crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))")} AS h FROM documents, crc),
a AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM t),
b AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
e AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w
  FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM b)),
o AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM e) WHERE c >= 4),
m AS (SELECT y.doc_id, y.i, y.i - x.i AS q FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= y.n),
s AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM m) GROUP BY doc_id, q, part),
l AS MATERIALIZED (SELECT * FROM s WHERE length >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.doc_id = l.doc_id AND k.q < l.q AND k.start <= l.start
  AND k.start + k.length >= l.start + l.length)),
x AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, q := q), (-length, start, q)) AS best,
  string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(start + q, start + length - 1)) AS i FROM r),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY e.i) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = e.doc_id AND g.i = e.i) GROUP BY doc_id)
SELECT b.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length,
  CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM b LEFT JOIN x ON x.doc_id = b.doc_id LEFT JOIN k ON k.doc_id = b.doc_id""",
    "op13_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  {_draw_sql("'0:group:' || doc_id")} % (count(*) OVER () // 512 + 1) AS grp FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST(idx % 3 AS INT) + 1]::DOUBLE AS weight, CAST(2 * size AS DOUBLE) AS most, sum(size) OVER () * 1.5::DOUBLE AS total FROM s),
z AS (SELECT *, total - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w WINDOW o AS (ORDER BY most / weight, idx)),
f AS (SELECT rest, weights FROM z WHERE rest * weight / weights < most ORDER BY most / weight, idx LIMIT 1),
c AS MATERIALIZED (SELECT z.source, z.idx, z.size, least(z.most, coalesce(f.rest * z.weight / f.weights, z.most)) AS target FROM z LEFT JOIN f ON true),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS wanted, (size + 1023) // 1024 AS blocks, size // 1024 AS full_blocks FROM c),
n AS MATERIALIZED (SELECT *, CASE WHEN size > 0 THEN wanted // size * blocks + (wanted % size + 1023) // 1024 ELSE 0 END AS quota FROM q),
y AS (SELECT idx, quota, coalesce(sum(quota) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM n),
u AS (SELECT slot, {_draw_sql("'0:slot:' || slot")} % (SELECT sum(quota) FROM n) AS u FROM range((SELECT CAST(sum(quota) AS BIGINT) FROM n)) AS r(slot)),
a AS MATERIALIZED (SELECT slot, y.idx AS drew, row_number() OVER (PARTITION BY y.idx ORDER BY slot) - 1 AS k FROM u JOIN y ON u.u >= y.lo AND u.u < y.lo + y.quota),
t AS (SELECT n.idx, n.quota, count(a.slot) AS draws FROM n LEFT JOIN a ON a.drew = n.idx GROUP BY n.idx, n.quota),
b AS MATERIALIZED (SELECT *, coalesce(sum(greatest(0, draws - quota)) OVER o, 0) AS over_lo, coalesce(sum(greatest(0, quota - draws)) OVER o, 0) AS short_lo
  FROM t WINDOW o AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT a.drew AS idx, a.k FROM a JOIN b ON b.idx = a.drew WHERE a.k < b.quota
  UNION ALL SELECT e.idx, e.draws + b.over_lo + a.k - b.quota - e.short_lo FROM a JOIN b ON b.idx = a.drew
    JOIN b e ON b.over_lo + a.k - b.quota >= e.short_lo AND b.over_lo + a.k - b.quota < e.short_lo + greatest(0, e.quota - e.draws) WHERE a.k >= b.quota),
h AS (SELECT g.idx, size, wanted, full_blocks, k // blocks AS epoch, k % blocks AS turn, '0:block:' || g.idx || ':' || (k // blocks) AS key FROM g JOIN n ON n.idx = g.idx),
x AS (SELECT idx, CASE WHEN turn < full_blocks THEN list_reduce(list_concat([turn], range({mixing.ROUNDS})), lambda x, r:
    CASE WHEN {_draw_sql(f"key || ':' || r || ':swap:' || greatest(x, {_MIRROR_SQL})")} % 2 = 1 THEN {_MIRROR_SQL} ELSE x END) ELSE turn END AS block,
  least(1024, wanted - epoch * size - turn * 1024) AS take FROM h),
p AS (SELECT d.*, s.idx, row_number() OVER () AS r, coalesce(sum(d.size) OVER (PARTITION BY s.idx ORDER BY grp, doc_id NULLS LAST, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source),
m AS (SELECT p.r, CAST(sum(greatest(0, least(start + size, block * 1024 + take) - greatest(start, block * 1024))) AS BIGINT) AS taken
  FROM p JOIN x ON x.idx = p.idx AND block * 1024 < start + size AND block * 1024 + 1024 > start GROUP BY p.r)
SELECT doc_id, p.size, c.size AS source_size, target, coalesce(taken, 0) AS taken FROM p JOIN c ON c.idx = p.idx LEFT JOIN m ON m.r = p.r""",
}
