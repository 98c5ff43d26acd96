"""Queries over whole tables: each applies one operator with its production parameters and
derives the digest columns of the query's contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, bitplanes, bpe, exact, mixing, pii, quality, secrets, simhash, warc
from .shared import documents

PII_KEY = "lagweave demonstration key"
END_ID = 2


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    base = F.filter("found", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.spell(base), 256).alias("base_sha256"), secrets.spell(F.col("found")).alias("spans"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(documents(spark, sf_dir))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(documents(spark, sf_dir), PII_KEY)


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bitplanes.encode_to_shards(spark, documents(spark, sf_dir), path, END_ID).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return done.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.sections(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_secret_scan, op3_exact_dedup, op4_pii_surrogates, op5_token_planes,
                                   op6_byte_bpe, op7_simhash, op8_token_attribution, op9_quality_hosts, op10_warc)}

def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _by_encoding(values: dict[str, float | str]) -> str:
    shown = " ".join(f"WHEN '{e}' THEN '{v}'" if isinstance(v, str) else f"WHEN '{e}' THEN {v!r}::DOUBLE" for e, v in values.items())
    return f"CASE encoding {shown} END"


def _secret_sql() -> str:
    """The scan in SQL: matches by pattern, positions by running sums, the battery, and the
    false-discovery control by bins."""
    words = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"""({words})["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("\\'", "''")
    found = " UNION ALL ".join(f"SELECT rid, doc_id, {k} AS kind, regexp_extract_all(text, '{x}') AS hits, string_split_regex(text, '{x}') AS gaps FROM d"
                               for k, x in enumerate((assign, secrets.LONG_ACCESS, secrets.LONG_HEX, secrets.CANDIDATE)))
    encoding = " ".join(f"WHEN regexp_matches(body, '{x}') THEN '{e}'" for e, x, _, _ in secrets.ENCODINGS[:-1]) + f" ELSE '{secrets.ENCODINGS[-1][0]}'"
    size, change, match = (_by_encoding({e: r[i] for e, r in secrets.rates().items()}) for i in range(3))
    alphabet = _by_encoding({e: a for e, _, a, _ in secrets.ENCODINGS})
    below = lambda z: f"1 / (1 + exp(-(1.5976 * greatest(-8.0, least(8.0, {z})) + 0.070566 * pow(greatest(-8.0, least(8.0, {z})), 3))))"
    spread = lambda p: f"((n - 1) * {p} * (1 - {p}))"
    equal = "(n * (n - 1) / 2 * match)"
    p_uniform = below(f"((chi2 - (size / n * (2 * {equal} + n) - n) + size / n) / (size / n * 2 * sqrt(2 * {equal})))")
    vowels = below(f"((changes + 0.5 - (n - 1) * {secrets.NATURAL_VOWELS}) / sqrt{spread(secrets.NATURAL_VOWELS)})")
    mixed = "1 - " + below(f"((changes - 0.5 - (n - 1) * {secrets.NATURAL_CHANGE}) / sqrt{spread(secrets.NATURAL_CHANGE)})")
    p_serial = below(f"(abs(serial_z) - CASE WHEN letters THEN 0.0 ELSE sqrt(n) * {secrets.NATURAL_SERIAL} END)")
    log = lambda p: f"ln(greatest({p}, 1e-30))"
    z_uniform = "(pow(greatest(chi2, 0) / (size - 1), 1 / 3::DOUBLE) - (1 - 2 / (9 * (size - 1)))) / sqrt(2 / (9 * (size - 1)))"
    z_runs = f"(changes - (n - 1) * change) / sqrt{spread('change')}"
    names = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(secrets.KINDS))
    spelled = f"CASE kind {names} END || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
h AS (SELECT rid, doc_id, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM m WHERE len(hits) > 0),
o AS (SELECT *, (sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY rid, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM h WINDOW w AS (PARTITION BY rid, kind ORDER BY i ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, start + length(hit) AS stop FROM o),
base AS (SELECT rid, kind, start, stop FROM s WHERE kind IN (1, 2) OR (kind = 0 AND length(regexp_extract(hit, '{assign}', 2)) >= 12)),
t0 AS (SELECT rid, kind, start, stop, hit, translate(rtrim(hit, '='), '{secrets.DASHES[0]}', '{secrets.DASHES[1]}') AS body FROM s
  WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base y WHERE y.rid = s.rid AND y.start < s.stop AND s.start < y.stop)),
t1 AS (SELECT *, CASE {encoding} END AS encoding, string_split(body, '') AS c FROM t0),
t2 AS (SELECT *, encoding IN ('lower', 'upper') AS letters, {alphabet} AS alphabet, {size} AS size, {change} AS change, {match} AS match, len(c)::DOUBLE AS n FROM t1),
t3 AS (SELECT *, list_transform(c, lambda x: (instr(alphabet, x) - 1)::BIGINT) AS v,
  list_transform(c, lambda x: CASE WHEN letters THEN CASE WHEN contains('{secrets.VOWELS}', x) THEN 1 ELSE 0 END WHEN x BETWEEN '0' AND '9' THEN 0 WHEN x BETWEEN 'a' AND 'z' THEN 1 WHEN x BETWEEN 'A' AND 'Z' THEN 2 ELSE 3 END) AS k,
  list_sum(list_transform(list_distinct(c), lambda x: pow(len(list_filter(c, lambda y: y = x)), 2))) AS squares FROM t2),
t4 AS (SELECT *, list_sum(v)::DOUBLE AS sv, list_sum(list_transform(v, lambda x: x * x))::DOUBLE AS q, list_sum(list_transform(range(2, len(v) + 1), lambda i: v[i] * v[i - 1]))::DOUBLE AS lag,
  len(list_filter(range(2, len(k) + 1), lambda i: k[i] <> k[i - 1] AND k[i] < 3 AND k[i - 1] < 3 AND NOT (k[i - 1] = 2 AND k[i] = 1)))::DOUBLE AS changes FROM t3),
t5 AS (SELECT *, size / n * squares - n AS chi2, CASE WHEN n * q - sv * sv > 0
  THEN (n * lag - sv * (2 * sv - v[1] - v[len(v)]) + (n - 1) / n * sv * sv) / (n * q - sv * sv) * sqrt(n) ELSE 99.0 END AS serial_z FROM t4),
t6 AS (SELECT *, abs({z_uniform}) < {secrets.MAX_Z} AND abs({z_runs}) < {secrets.MAX_Z} AND abs(serial_z) < {secrets.MAX_Z} AND encoding <> 'decimal' AS uniform,
  -({log(p_uniform)} + {log(f"CASE WHEN letters THEN {vowels} ELSE {mixed} END")} + {log(p_serial)}) AS joint FROM t5),
t7 AS (SELECT rid, kind, start, stop, floor(log2(length(hit))) AS class,
  CAST(least({secrets.BINS}, floor(-10 * log10(greatest(CASE WHEN uniform THEN least(1.0, exp(-joint) * (1 + joint + joint * joint / 2)) ELSE 1.0 END, 1e-30)))) AS INTEGER) AS bin FROM t6),
b AS (SELECT class, bin, sum(count(*)) OVER (PARTITION BY class ORDER BY bin DESC) AS rank, sum(count(*)) OVER (PARTITION BY class) AS m FROM t7 GROUP BY class, bin),
l AS (SELECT class, min(bin) AS least_bin FROM b WHERE pow(10.0, -bin / 10.0) <= {secrets.FDR} * rank / m GROUP BY class),
added AS (SELECT rid, kind, start, stop FROM t7 JOIN l USING (class) WHERE bin >= least_bin),
a AS (SELECT * FROM base UNION ALL SELECT * FROM added),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg({spelled}, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3) AS own, string_agg({spelled}, ',' ORDER BY start, kind, stop) AS spans FROM a GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


ORACLES = {
    "op2_secret_scan": _secret_sql(),
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS points
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)""",
    "op9_quality_hosts": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM g WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(u.lines, 0)::BIGINT AS n_lines,
         coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id)),
r4 AS (SELECT *, n_words < {quality.MIN_WORDS} AS f0, 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS f1, 100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * n_words AS f2,
  100 * n_dup_lines > {quality.MAX_DUP_LINE_PERCENT} * n_lines AS f3 FROM f),
b AS (SELECT *, f0 OR f1 AS base_failed FROM r4),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE fails) AS bad FROM (SELECT source, unnest([0, 1, 2, 3]) AS rule, unnest([f0, f1, f2, f3]) AS fails FROM b) GROUP BY source, rule),
m AS (SELECT rule, avg(bad / n) AS mean, var_pop(bad / n) AS var, avg(1.0 / n) AS inverse FROM h GROUP BY rule),
p AS (SELECT rule, mean, CASE WHEN var - mean * (1 - mean) * inverse > 0
             THEN least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * inverse) - 1, {quality.LEAST_PRIOR}), {quality.MOST_PRIOR}) ELSE {quality.MOST_PRIOR} END AS size FROM m),
j AS (SELECT source, bool_or((bad + mean * size) / (n + size) >= [{", ".join(str(quality.HOST_LIMITS[r]) for r in quality.RULES)}][rule + 1]) AS host_failed FROM h JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.source""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= {warc.MIN_BYTES} THEN max(page_id) OVER (PARTITION BY h) END AS first_id FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM q""",
}
