"""Driver tables and the retail transaction view built over them.

The driver tables hold no nulls, so the view injects defects with integer
arithmetic on the row keys; any engine computes the same defects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlint.functions.scalars import bool_text
from ledgerlint.schema import MASTER_END, MASTER_START, VIEW_COLUMNS
from ledgerlint.session import spread

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")

# Row identity of the view: unique at every driver scale.
ROW_ID_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                  "l_shipdate")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _h() -> F.Column:
    return (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17
            + F.col("l_suppkey") * 7 + F.col("l_linenumber") * 3)


def retail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed transaction table: lineitem x orders x part with injected defects.

    Columns: the five row-id keys, then the eleven transaction columns in
    ``VIEW_COLUMNS`` (price, quantity, total are doubles; discount boolean).
    Only the columns used are read (pruned at the parquet scan); the joins
    are plain equi-joins, AQE picks broadcast at runtime from measured sizes.
    """
    # A fact file stored as one row group is read by one task; spread it so
    # the per-row work uses every core. Large inputs are left as they are,
    # so the join with orders keeps AQE's skew-join splitting.
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"), list(ROW_ID_COLUMNS))
    od = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate"))
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(pt, li.l_partkey == pt.p_partkey))
    h = _h()
    n = F.substring(F.col("p_brand"), 7, 10).cast("int")
    ab = F.substring(F.col("p_type"), 1, 3)
    txn_num = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string")
    txn_num = F.when(F.length(txn_num) < 7, F.lpad(txn_num, 7, "0")).otherwise(txn_num)
    base_price = (F.lit(5.0) + F.lit(1.5) * (n - 1)
                  + F.when(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"),
                           F.lit(0.5)).otherwise(F.lit(0.0)))
    item_no = n.cast("string")
    c = VIEW_COLUMNS
    return j.select(
        *[F.col(k) for k in ROW_ID_COLUMNS],
        F.when(h % 97 == 0, F.lit("TXN_BAD"))
         .otherwise(F.concat(F.lit("TXN_"), txn_num)).alias(c.transaction_id),
        F.when(h % 89 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("CUST_"), F.col("o_custkey").cast("string")))
         .alias(c.customer_id),
        F.when(h % 83 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("p_type")).alias(c.category),
        F.when(h % 10 == 0, F.lit(None).cast("string"))
         .when(h % 71 == 1, F.concat(F.lit("Item_"), item_no, F.lit("_ZZZ")))
         .otherwise(F.concat(F.lit("Item_"), item_no, F.lit("_"), ab)).alias(c.item),
        F.when(h % 21 == 0, F.lit(None).cast("double"))
         .when(h % 50 == 7, base_price + 1.0)
         .otherwise(base_price).alias(c.price),
        F.when(h % 21 == 5, F.lit(None).cast("double"))
         .when(h % 67 == 2, F.col("l_quantity") + 0.5)
         .otherwise(F.col("l_quantity")).alias(c.quantity),
        F.when(h % 21 == 5, F.lit(None).cast("double"))
         .when(h % 61 == 3, base_price * F.col("l_quantity") + 1.0)
         .otherwise(base_price * F.col("l_quantity")).alias(c.total),
        F.when(h % 59 == 4, F.lit("Crypto"))
         .when(F.col("l_returnflag") == "R", F.lit("Digital Wallet"))
         .when(F.col("l_returnflag") == "A", F.lit("Credit Card"))
         .otherwise(F.lit("Cash")).alias(c.payment),
        F.when(h % 53 == 6, F.lit(None).cast("string"))
         .when(F.col("l_linestatus") == "O", F.lit("Online"))
         .otherwise(F.lit("In-store")).alias(c.location),
        F.when(h % 47 == 8, F.lit("2024-02-30"))
         .when(h % 43 == 9, F.lit(None).cast("string"))
         .otherwise(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")).alias(c.date),
        F.when(h % 3 == 0, F.lit(None).cast("boolean"))
         .otherwise(F.col("l_discount") >= 0.05).alias(c.discount),
    )


def retail_text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text form of the view: every transaction column as a string.

    This is what a CSV of the table holds; the mixed-type rules read it.
    Booleans render as ``True`` / ``False``.
    """
    v = retail_view(spark, sf_dir)
    c = VIEW_COLUMNS
    out = [F.col(k) for k in ROW_ID_COLUMNS]
    for name in c.all():
        if name == c.discount:
            out.append(bool_text(F.col(name)).alias(name))
        else:
            out.append(F.col(name).cast("string").alias(name))
    return v.select(*out)


def view_price_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective-dated price master for the view.

    Every (part type, brand) pair seen in ``part`` (at most 6 x 25 = 150), in
    two periods: 1995-1998 at the base price, 1999-2001 at base + 0.5. Built
    from the data by Spark; its size is bounded by the type x brand domain.
    """
    pt = read_table(spark, sf_dir, "part").select("p_brand", "p_type")
    n = F.substring(F.col("p_brand"), 7, 10).cast("int")
    pairs = pt.select(n.alias("n"), F.col("p_type")).distinct()
    periods = F.array(
        F.struct(F.lit("1995-01-01").alias("s"), F.lit("1998-12-31").alias("e"),
                 F.lit(0.0).alias("bump")),
        F.struct(F.lit("1999-01-01").alias("s"), F.lit("2001-12-31").alias("e"),
                 F.lit(0.5).alias("bump")),
    )
    return (pairs.select("n", "p_type", F.explode(periods).alias("p"))
            .select(
                F.concat(F.lit("Item_"), F.col("n").cast("string"), F.lit("_"),
                         F.substring(F.col("p_type"), 1, 3)).alias("Item"),
                (F.lit(5.0) + F.lit(1.5) * (F.col("n") - 1) + F.col("p.bump"))
                .alias("Price Per Unit"),
                F.col("p.s").alias("Start_date"),
                F.col("p.e").alias("End_date")))


def price_master_from_facts(df: DataFrame, item: str, price: str,
                            start: str = MASTER_START, end: str = MASTER_END) -> DataFrame:
    """Distinct (item, price) pairs seen in the facts, with a constant range.

    Rows with a missing item or price are dropped; sorted by item as text.
    """
    return (df.select(F.col(item).alias("Item"), F.col(price).alias("Price Per Unit"))
              .na.drop()
              .dropDuplicates()
              .withColumn("Start_date", F.lit(start))
              .withColumn("End_date", F.lit(end))
              .orderBy(F.col("Item").asc_nulls_last(), F.col("Price Per Unit")))
