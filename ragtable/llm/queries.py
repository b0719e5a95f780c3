"""Registered queries of the operators here: opN_<name> over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import let
from ..session import ensure_checkpoint_dir, read_table
from . import chat, decontam, licenses, line_rules, mixing, near_dedup, neighbours, periodic, quality, resampling, suffix_dedup, toxicity, url_graph
from .kernels import bound_batches

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    return read_table(spark, sf_dir, "documents")


@_query("op1_minhash_near_dedup")
def op1(spark, sf_dir):
    return near_dedup.near_duplicate_components(_documents(spark, sf_dir), k=2, percent=80)


OP3_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
ranked AS (
  SELECT source, s, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::INT AS k FROM totals),
weighted AS (SELECT source, s, (k + 1)::BIGINT AS w, (ARRAY[-0.5, 0.0, 0.5])[k + 1]::DOUBLE AS slope FROM ranked),
rounds AS (  -- cap, reshare the excess by weight, until none is above
  SELECT 0 AS i, source, s, w, slope, false AS capped, (SELECT sum(s) FROM weighted)::DOUBLE / (SELECT sum(w) FROM weighted) * w AS target FROM weighted
  UNION ALL
  SELECT i + 1, source, s, w, slope, over, CASE WHEN over THEN (3 * s)::DOUBLE
         ELSE (total - coalesce(sum(3 * s) FILTER (WHERE over) OVER (), 0))::DOUBLE / (sum(w) FILTER (WHERE NOT over) OVER ()) * w END
  FROM (SELECT *, capped OR target > 3 * s AS over, sum(s) OVER () AS total FROM rounds) WHERE i < 40),
shares AS (SELECT source, s, target, floor(target + 0.5)::BIGINT AS d, slope FROM rounds WHERE i = 40),
placed AS (
  SELECT z.doc_id, z.size, h.s, h.target, h.d, h.slope,
         (sum(z.size) OVER (PARTITION BY z.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - z.size)::BIGINT AS c
  FROM sized z JOIN shares h ON z.source IS NOT DISTINCT FROM h.source),
taken AS (
  SELECT *, CASE WHEN s > 0 THEN d // s ELSE 0 END AS whole, greatest(0, least(size, d - (CASE WHEN s > 0 THEN d // s ELSE 0 END) * s - c)) AS rest FROM placed)
SELECT doc_id, size, s AS source_size, target, (whole * size + rest)::BIGINT AS taken,
       CASE WHEN whole * size + rest > 0 THEN round(c::DOUBLE / d * 2 / (1.0::DOUBLE - slope + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + slope * (c::DOUBLE / d) * 4)), 9) END AS position
FROM taken
"""


@_query("op3_mix_sources", OP3_SQL)
def op3(spark, sf_dir):
    return mixing.document_order(mixing.mix_sources(_documents(spark, sf_dir))).drop("source")


@_query("op7_suffix_array_dedup")
def op7(spark, sf_dir):
    return suffix_dedup.repeat_digest(_documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
found AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query("op10_benchmark_decontamination", OP10_SQL)
def op10(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = decontam.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "decon.n_words", decontam.n_hit().alias("n_hit"), F.size("decon.items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "decon.items"), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(role, '%', '%25'), '<|', '%3C|') AS r, replace(replace(text, '%', '%25'), '<|', '%3C|') AS x FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>') + length(r) + length('<|text|>') + length(x) + length('<|end|>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@_query("op2_chat_format", OP2_SQL)
def op2(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(chat.format_conversations(turns)).drop("n_tokens")


@_query("op4_quality_ranking")
def op4(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(quality.fold(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@_query("op5_license_scan")
def op5(spark, sf_dir):
    return licenses.scan_licenses(_documents(spark, sf_dir))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS ruled
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
j AS (SELECT p.page_id, host, path, rule, ruled FROM p LEFT JOIN fit USING (page_id)),
seed AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM j WHERE host <> '' GROUP BY host)
-- these pages link within their hosts only, where propagation leaves every host its seed
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM j LEFT JOIN seed USING (host)
"""


@_query("op6_url_link_graph", OP6_SQL)
def op6(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    return url_graph.judge_pages(read_table(spark, sf_dir, "pages"))


@_query("op8_line_rules")
def op8(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return line_rules.line_rules(docs, line_rules.train(docs, read_table(spark, sf_dir, "labels")))


@_query("op9_toxicity")
def op9(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(quality.fold(F.col("doc_id"), 3) != 1)
    model, marks = toxicity.fit(docs, labels)
    scored = toxicity.with_toxicity(docs, model, marks)
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


#: CRC-32 of a list of bytes; DuckDB has no such function
CRC_SQL = """
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i))"""


def _crc_sql(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295::BIGINT)"


OP11_SQL = rf"""
WITH {CRC_SQL},
d AS (
  SELECT doc_id, w, len(w)::BIGINT AS n, {_crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} AS h
  FROM (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents), crc),
e AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM d),
f AS (SELECT *, CASE WHEN a < n THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM e),
words AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
long AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT doc_id, start, length, q FROM long r
  WHERE NOT EXISTS (FROM long s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
listed AS (
  SELECT doc_id, count(*)::BIGINT AS n_runs, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs_sha256,
         list(struct_pack(start := start, length := length, q := q) ORDER BY length DESC, start, q)[1] AS best FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.q::BIGINT AS period,
       (1000 * best.length // best.q)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def repetitive_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten (by CRC of its doc_id) repeats a stretch of itself to its end."""
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")).otherwise(F.lit(""))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


@_query("op11_periodic_runs", OP11_SQL)
def op11(spark, sf_dir):
    found = periodic.periodic_runs(repetitive_texts(_documents(spark, sf_dir)).select("doc_id", "text")).select("doc_id", "periodic.*")
    best = periodic.longest_run(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


OP12_SQL = rf"""
WITH {CRC_SQL},
w AS (
  SELECT doc_id, true AS ours, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT NULL, false, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (
  SELECT ours, doc_id, array_to_string(w[i : i + k - 1], ' ') AS feature
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
named AS (
  SELECT feature, {_crc_sql("list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: ('0x' || x)::BIGINT)")} % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM f), crc),
b AS (SELECT ours, doc_id, bucket FROM f JOIN named USING (feature)),
counts AS (
  SELECT i AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM (SELECT unnest(range(10000)) AS i)
  LEFT JOIN (SELECT bucket, count(*) FILTER (WHERE ours) AS s, count(*) FILTER (WHERE NOT ours) AS t FROM b GROUP BY bucket) ON bucket = i),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT doc_id, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM b JOIN gains USING (bucket) WHERE ours GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (doc_id) WHERE ours),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 5 // 100 AS most FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END::BIGINT AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""


@_query("op12_importance_resampling", OP12_SQL)
def op12(spark, sf_dir):
    return resampling.resample(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: what an exact search returns; the graph search finds the same rows on the given small tables, and tests hold its recall on larger ones
OP13_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@_query("op13_nearest_neighbours", OP13_SQL)
def op13(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return neighbours.Index(vectors, keep=6).search(queries, k=5)
