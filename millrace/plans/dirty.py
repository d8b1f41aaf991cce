"""Dirty orders, made by SQL from the driver's star schema, the same in Spark and in DuckDB.

o_orderkey % 100 says what is wrong with an order; see `_CASES`. Items are its line items in a fixed order, with whole
prices. SQL_HEAD holds the statement in DuckDB's dialect, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.schema import RAW_COLUMNS

UNKNOWN = "غير معروف"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'تم التسليم' WHEN 'O' THEN 'قيد الشحن' ELSE 'مؤكد' END"


def _sql(dialect: str) -> str:
    spark = dialect == "spark"
    stamp = (lambda f: f"date_format(o_orderdate, '{f[0]}')") if spark else (lambda f: f"strftime(o_orderdate, '{f[1]}')")
    iso, day_first = stamp(("", "%Y-%m-%dT%H:%M:%S")), stamp(("dd-MM-yyyy HH:mm:ss", "%d-%m-%Y %H:%M:%S"))
    if spark:
        iso = "concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T', date_format(o_orderdate, 'HH:mm:ss'))"
    items = "array_join(transform(array_sort(collect_list(struct(rn, item))), x -> x.item), ',')" if spark else "string_agg(item, ',' ORDER BY rn)"
    return f"""
line AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn, l_orderkey % 100 AS k,
    l_partkey, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS p
  FROM lineitem),
item AS (
  SELECT l_orderkey, rn, q * p AS t,
    '{{"sku":"SKU-' || CAST(l_partkey AS STRING) || '","name":"منتج ' || CAST(rn AS STRING) || '","qty":' || CAST(CASE WHEN rn = 1 AND k IN (72, 90) THEN -q WHEN rn = 1 AND k = 92 THEN 0 ELSE q END AS STRING)
    || ',"unit_price":' || CASE WHEN rn = 1 AND k IN (74, 75, 89) THEN '"{UNKNOWN}"' WHEN rn = 1 AND k = 93 THEN CAST(-p AS STRING) ELSE CAST(p AS STRING) END
    || ',"total":' || CASE WHEN rn = 1 AND k IN (73, 75, 89) THEN '"{UNKNOWN}"' WHEN rn = 1 AND k = 90 THEN CAST(q * p + 1 AS STRING) WHEN rn = 1 AND k = 91 THEN CAST(q * p - 1 AS STRING) ELSE CAST(q * p AS STRING) END || '}}' AS item
  FROM line),
basket AS (SELECT l_orderkey, CAST(sum(t) AS BIGINT) AS goods, {items} AS items FROM item GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey, o_orderkey % 100 AS k, o_orderdate, o_orderstatus, o_custkey, c_name, coalesce(goods, 0) + 2000 AS total, '[' || coalesce(items, '') || ']' AS items
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN basket ON o_orderkey = l_orderkey),
dirty AS (
  SELECT o_orderkey,
    CASE k WHEN 80 THEN '' WHEN 98 THEN 'ORD-' || CAST(o_orderkey + 1 AS STRING) ELSE 'ORD-' || CAST(o_orderkey AS STRING) END AS order_id,
    CASE k WHEN 68 THEN {day_first} WHEN 82 THEN '2025-19-45 99:70:00' ELSE {iso} END AS order_date,
    CASE k WHEN 64 THEN '  ' || {_STATUS} || ' ' WHEN 86 THEN 'حالة غير معروفة' ELSE {_STATUS} END AS status,
    CASE WHEN k IN (81, 94) THEN '' ELSE 'CUST-' || CAST(o_custkey AS STRING) END AS customer_id,
    coalesce(c_name, '') AS customer_name,
    CASE k WHEN 66 THEN '+967 ' WHEN 87 THEN '' ELSE '' END || CASE k WHEN 87 THEN '12345' ELSE '7' || lpad(CAST(o_custkey % 100000000 AS STRING), 8, '0') END AS customer_phone,
    CASE k WHEN 67 THEN 'user..' || CAST(o_custkey AS STRING) || '@@example.com' WHEN 88 THEN 'user-without-domain' WHEN 94 THEN 'user@@nowhere' ELSE 'user.' || CAST(o_custkey AS STRING) || '@example.com' END AS customer_email,
    'صنعاء' AS city, 'التحرير' AS district, 'توصيل' AS delivery_type,
    CASE k WHEN 63 THEN 'ألفان' ELSE '2000' END AS delivery_cost, 'نقدي' AS payment_method,
    CASE k WHEN 69 THEN 'مدفوع' ELSE 'تم الدفع' END AS payment_status,
    CAST(CASE k WHEN 89 THEN total - 1 ELSE total END AS STRING) AS payment_amount,
    CASE k WHEN 65 THEN 'ريال يمني' WHEN 85 THEN 'عملة' ELSE 'YER' END AS currency,
    CASE WHEN k = 60 THEN translate(CAST(total AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩') || '٫٠'
      WHEN k = 61 THEN CAST(CAST(floor(total / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(total % 1000 AS STRING), 3, '0')
      WHEN k = 62 THEN CAST(total AS STRING) || ' ريال' WHEN k = 70 THEN CAST(total + 1 AS STRING) WHEN k IN (71, 94) THEN '???' ELSE CAST(total AS STRING) END AS total_amount,
    CASE WHEN k IN (83, 94) THEN 'not-json' WHEN k = 84 THEN '[]' ELSE items END AS items_json
  FROM base)"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and the 17 source columns, dealt over the cluster as the splits of a CSV would be (`orders` is one split)."""
    text = "WITH " + _sql("spark") + " SELECT * FROM dirty"
    for name, after in (("lineitem", "FROM "), ("orders", "FROM "), ("customer", "JOIN ")):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"millrace_{name}")
        text = text.replace(f"{after}{name}", f"{after}millrace_{name}")
    return spark.sql(text).repartition("o_orderkey")


def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as raw rows of one run, numbered by order key."""
    from pyspark.sql import functions as F

    rows = dirty_orders(spark, sf_dir)
    return rows.select(
        "o_orderkey", F.lit("run-dirty").alias("run_id"), F.lit("orders.csv").alias("source_file"), F.lit("/data/orders.csv").alias("source_path"), (F.col("o_orderkey") + 2).cast("long").alias("source_row_number"),
        F.lit(True).alias("source_row_number_available"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("ingested_at"), F.lit("pyspark").alias("engine_used"), F.lit(0).alias("spark_partition_id"),
        F.lit(None).cast("string").alias("csv_corrupt_record"), F.lit(None).cast("array<string>").alias("extra_values"), F.struct(*RAW_COLUMNS).alias("raw_record"),
    )


SQL_HEAD = "WITH " + _sql("duckdb")
