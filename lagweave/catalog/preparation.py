"""Preprocessing, encoding and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preprocess, validation
from ..operators.encoding import encode, fit_mapping, mapping_table
from ..sources.tables import numeric_projection
from .inputs import table

LINE = "merchant_id, card_token_id, status, capture_method, amount, qty"
LINE_SQL = """raw AS (SELECT l_suppkey AS merchant_id, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey END AS card_token_id, CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_linestatus END AS status,
  l_returnflag AS capture_method, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS qty, l_shipdate AS created_at, l_orderkey, l_linenumber FROM lineitem)"""
PART_SQL = "cards AS (SELECT p_partkey AS id, p_brand AS card_brand FROM part WHERE p_partkey % 5 <> 0)"
SUPP_SQL = "merchants AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS document_type, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS merchant_category_code FROM supplier WHERE s_suppkey % 9 <> 0)"


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("merchant_id"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")).alias("card_token_id"),
                     F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("status"), F.col("l_returnflag").alias("capture_method"),
                     F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("qty"),
                     F.col("l_shipdate").alias("created_at"), "l_orderkey", "l_linenumber")


def _cards(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("card_brand"))


def _merchants(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 9 <> 0")
    return s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("document_type"),
                    F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey").cast("string")).alias("merchant_category_code"))


def zero_fill(spark, sf_dir):
    return preprocess.zero_fill(_lines(spark, sf_dir)).select("merchant_id", "card_token_id", "status", "capture_method", F.col("amount").cast("double").alias("amount"), "qty", "l_orderkey", "l_linenumber")


def enrich_left_joins(spark, sf_dir):
    done = preprocess.enrich(_lines(spark, sf_dir), _cards(spark, sf_dir), _merchants(spark, sf_dir).drop("merchant_category_code"))
    return done.select("merchant_id", "card_token_id", "card_brand", "document_type", F.col("amount").cast("double").alias("amount"), "l_orderkey", "l_linenumber")


def _coded(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("merchant_category_code", F.when(F.col("l_orderkey") % 4 == 0, "own"))


def resolve_mcc_coalesce(spark, sf_dir):
    done = preprocess.enrich(_coded(spark, sf_dir), None, _merchants(spark, sf_dir))
    return done.groupBy("merchant_category_code").agg(F.count("*").alias("n"))


def sort_dataset(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("event_timestamp", F.col("ts"))
    return preprocess.dataset_layout(ev).select("event_id", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


def _encoding_inputs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("merchant_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("payment_method"), "o_orderkey")
    data = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("merchant_id"), F.when(F.col("c_custkey") % 200 == 0, "train").otherwise("test").alias("split"))
    return o, data


MAP_SQL = """o AS (SELECT o_custkey AS merchant_id, o_orderstatus AS status, o_orderpriority AS payment_method, o_orderkey FROM orders),
train AS (SELECT c_custkey AS merchant_id FROM customer WHERE c_custkey % 200 = 0),
seen AS (SELECT DISTINCT 'status' AS family, status AS category FROM o SEMI JOIN train USING (merchant_id) WHERE status IS NOT NULL
  UNION ALL SELECT DISTINCT 'payment_method', payment_method FROM o SEMI JOIN train USING (merchant_id) WHERE payment_method IS NOT NULL),
map AS (SELECT family, category, CAST(row_number() OVER (PARTITION BY family ORDER BY category) - 1 AS INTEGER) AS code FROM seen)"""
COLUMNS = ("status", "payment_method")


def fit_label_mapping(spark, sf_dir):
    o, data = _encoding_inputs(spark, sf_dir)
    return mapping_table(o, data, COLUMNS)


def encode_labels(spark, sf_dir):
    o, data = _encoding_inputs(spark, sf_dir)
    return encode(o, fit_mapping(o, data, COLUMNS)).select("o_orderkey", "status", "payment_method")


def numeric_projection_epoch(spark, sf_dir):
    return numeric_projection(table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("day", F.col("o_orderdate").cast("date")))


def null_percentages(spark, sf_dir):
    return validation.null_report(_lines(spark, sf_dir).select(*LINE.split(", "))).withColumn("null_percent", F.format_string("%.6f%%", "null_percent"))


def nulls_compare_tables(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("merchant_id", "status", "qty")
    return validation.compare_nulls(lines, preprocess.enrich(_lines(spark, sf_dir), _cards(spark, sf_dir)).select("merchant_id", "status", "qty", "card_brand"))


def _code_tables(spark, sf_dir):
    tx = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("merchant_id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("merchant_category_code"))
    return tx, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "F").when(F.col("c_custkey") % 3 == 1, "O").alias("merchant_category_code"))


CODE_SQL = """tx AS (SELECT o_custkey AS merchant_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS code FROM orders),
m AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' END AS code FROM customer),
c AS (SELECT merchant_id, code, count(*) AS n FROM tx WHERE merchant_id IS NOT NULL GROUP BY ALL),
x AS (SELECT c.merchant_id, c.code, m.code AS mcode, n FROM c JOIN m ON c.merchant_id = m.id WHERE c.code IS DISTINCT FROM m.code)"""


def code_mismatches_detail(spark, sf_dir):
    return validation.code_mismatches(*_code_tables(spark, sf_dir))


def code_mismatches_summary(spark, sf_dir):
    return validation.code_mismatch_summary(*_code_tables(spark, sf_dir))


def multi_code_merchants(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("merchant_category_code"))
    return validation.multiple_codes(o)


def sort_violation_first(spark, sf_dir):
    """Of the whole table as stored, which is by order key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("merchant_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return validation.first_sort_violation(validation.stored_positions(o), "position")


def row_count_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.agg(F.count("*").alias("rows")).withColumn("projected_rows", F.lit(numeric_projection(li).count()).cast("long"))


QUERIES = {f.__name__: f for f in (zero_fill, enrich_left_joins, resolve_mcc_coalesce, sort_dataset, fit_label_mapping, encode_labels, numeric_projection_epoch, null_percentages,
                                   nulls_compare_tables, code_mismatches_detail, code_mismatches_summary, multi_code_merchants, sort_violation_first, row_count_check)}

ORACLES = {
    "zero_fill": f"""WITH {LINE_SQL} SELECT merchant_id, coalesce(card_token_id, 0) AS card_token_id, coalesce(status, '0') AS status, capture_method, amount::DOUBLE AS amount,
      coalesce(qty, 0.0) AS qty, l_orderkey, l_linenumber FROM raw""",
    "enrich_left_joins": f"""WITH {LINE_SQL}, {PART_SQL}, {SUPP_SQL} SELECT merchant_id, coalesce(card_token_id, 0) AS card_token_id, coalesce(card_brand, '0') AS card_brand,
      coalesce(document_type, '0') AS document_type, amount::DOUBLE AS amount, l_orderkey, l_linenumber FROM raw LEFT JOIN cards ON card_token_id = cards.id LEFT JOIN merchants ON merchant_id = merchants.id""",
    "resolve_mcc_coalesce": f"""WITH {LINE_SQL}, {SUPP_SQL} SELECT coalesce(CASE WHEN l_orderkey % 4 = 0 THEN 'own' END, m.merchant_category_code, '0') AS merchant_category_code, count(*) AS n
      FROM raw LEFT JOIN merchants m ON merchant_id = m.id GROUP BY 1""",
    "sort_dataset": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "fit_label_mapping": f"WITH {MAP_SQL} SELECT family, category, code FROM map",
    "encode_labels": f"""WITH {MAP_SQL} SELECT o_orderkey, CAST(coalesce(a.code, (SELECT count(*) FROM map WHERE family = 'status')) AS INTEGER) AS status,
      CAST(coalesce(b.code, (SELECT count(*) FROM map WHERE family = 'payment_method')) AS INTEGER) AS payment_method
      FROM o LEFT JOIN map a ON a.family = 'status' AND a.category = o.status LEFT JOIN map b ON b.family = 'payment_method' AND b.category = o.payment_method""",
    "numeric_projection_epoch": """SELECT o_orderkey, o_custkey, o_totalprice, epoch_us(o_orderdate) AS o_orderdate, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
      CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS day FROM orders""",
    "null_percentages": f"""WITH {LINE_SQL}, c AS (SELECT unnest([{', '.join(f"{{'c': '{c}', 'r': count(*), 'n': count(*) - count({c})}}" for c in LINE.split(', '))}]) AS s FROM raw)
      SELECT s.c AS "column", s.r AS rows, s.n AS null_count, printf('%.6f%%', 100.0 * s.n / s.r) AS null_percent FROM c""",
    "nulls_compare_tables": f"""WITH {LINE_SQL}, c AS (SELECT unnest([{', '.join(f"{{'c': '{c}', 'r': count(*), 'n': count(*) - count({c})}}" for c in ('merchant_id', 'status', 'qty'))}]) AS s FROM raw)
      SELECT s.c AS "column", s.r AS original_rows, s.n AS original_null_count, 100.0::DOUBLE * s.n / s.r AS original_null_percent, s.r AS transformed_rows, 0::BIGINT AS transformed_null_count, 0.0::DOUBLE AS transformed_null_percent FROM c
      UNION ALL SELECT 'card_brand', NULL, NULL, NULL, count(*), 0, 0.0 FROM raw""",
    "code_mismatches_detail": f"WITH {CODE_SQL} SELECT merchant_id, code AS transaction_merchant_category_code, mcode AS merchant_merchant_category_code, n AS transaction_count FROM x",
    "code_mismatches_summary": f"""WITH {CODE_SQL} SELECT merchant_id, mcode AS merchant_category_code, string_agg(coalesce(code, 'NULL'), ', ' ORDER BY code NULLS FIRST) AS transaction_codes,
      sum(n)::BIGINT AS mismatch_transaction_count, sum(CASE WHEN code IS NULL THEN n ELSE 0 END)::BIGINT AS null_transaction_count FROM x GROUP BY merchant_id, mcode""",
    "multi_code_merchants": """SELECT o_custkey AS merchant_id, count(DISTINCT o_orderpriority) AS merchant_code_count, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS merchant_codes
      FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""",
    "sort_violation_first": """WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey)::BIGINT AS position, o_custkey AS m, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders),
      l AS (SELECT *, lag(m) OVER (ORDER BY position) AS pm, lag(t) OVER (ORDER BY position) AS pt FROM p)
      SELECT position, pm AS previous_merchant, m AS merchant, pt AS previous_created, t AS created FROM l WHERE m < pm OR (m = pm AND t < pt) ORDER BY position LIMIT 1""",
    "row_count_check": "SELECT count(*) AS rows, count(*) AS projected_rows FROM lineitem",
}
