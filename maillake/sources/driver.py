"""Mail views over the driver's TPC-H-like tables.

The driver ships no mailbox, so the mail star schema is derived from its
tables (same shapes, same key relations):

* ``messages``   orders joined to customer (one row per order = message)
* ``addresses``  customers and suppliers, address text built from the name
* ``recipients`` lineitem rows (message = order, recipient = supplier)
* ``mailboxes``  nations (base folders) plus label folders
* ``mail_labels`` label rows for urgent mail of some folders
* ``mail_events`` events (user = sender, event type = folder)
* ``bodies`` / ``html_bodies`` / ``threads``: documents / pages / conversations

Every view is a lazy DataFrame; only the columns a query uses reach the
Parquet scan (Catalyst prunes through the projections).  The same
definitions exist as SQL text in ``maillake.plans.oracle`` for the DuckDB
check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mail views (shared with the SQL twin in plans/oracle.py).
SUPPLIER_ID_OFFSET = 10_000_000      # supplier address ids start here
LABEL_MAILBOX_OFFSET = 100           # label folder id = 100 + base folder id
LABEL_FOLDER_EVERY = 5               # base folders with id % 5 = 0 get a label folder
LABELLED_PRIORITY = "1-URGENT"       # messages of that priority carry the label
ADDRESS_DOMAIN_SUFFIX = ".example.org"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def message_id_expr(orderkey: Column, custkey: Column, orderdate: Column) -> Column:
    """Message-ID of the derived view: customer and month, NULL for every 10th order.

    The (customer, month) key repeats, which gives the view real duplicate ids.
    """
    return (F.when(orderkey % 10 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(custkey.cast("string"), F.lit("-"),
                                F.date_format(orderdate, "yyyy-MM"))))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages; the folder is the customer's nation.

    The customer side is grouped on its key, so Catalyst knows it is unique:
    a query that does not use ``mailbox`` loses the join (and its shuffle of
    every order) entirely; one that does gets the aggregate's hash
    partitioning for the join.  (Every order has its customer in the driver
    data, so this left join returns what an inner join would.)
    """
    o = table(spark, sf_dir, "orders")
    c = (table(spark, sf_dir, "customer").groupBy("c_custkey")
         .agg(F.max("c_nationkey").alias("c_nationkey")))
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    return j.select(
        F.col("o_orderkey").alias("rowid"),
        message_id_expr(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")).alias("message_id"),
        F.col("o_custkey").alias("sender"),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit("Re: ")).otherwise(F.lit("")),
                 F.col("o_orderpriority")).alias("subject"),
        F.col("o_orderdate").alias("date_sent"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
         .when(F.col("o_orderstatus") == "P", 2).cast("int").alias("flags"),
        F.col("c_nationkey").cast("long").alias("mailbox"),
        F.floor(F.col("o_totalprice")).cast("long").alias("bytes"),
        F.col("o_orderpriority").alias("priority"),
    )


def _address_text(name: Column, nation_name: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(name, "#", ".")), F.lit("@"),
                    F.lower(nation_name), F.lit(ADDRESS_DOMAIN_SUFFIX))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation has 25 rows by construction of the schema: a proven size bound.
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    cust = (table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("rowid"),
                    _address_text(F.col("c_name"), F.col("n_name")).alias("address"),
                    F.lit("").alias("comment")))
    supp = (table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
            .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .select((F.col("s_suppkey") + F.lit(SUPPLIER_ID_OFFSET)).alias("rowid"),
                    _address_text(F.col("s_name"), F.col("n_name")).alias("address"),
                    F.lit("").alias("comment")))
    return cust.unionByName(supp)


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("message_rowid"),
        F.when(F.col("l_linestatus") == "O", 0).when(F.col("l_linestatus") == "F", 1)
         .cast("int").alias("type"),
        (F.col("l_suppkey") + F.lit(SUPPLIER_ID_OFFSET)).alias("address_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_shipdate").alias("date_received"),
    )


def mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = n.select(F.col("n_nationkey").cast("long").alias("rowid"),
                    F.lower(F.col("n_name")).alias("url"),
                    F.lit(None).cast("long").alias("source"))
    lab = (n.filter(F.col("n_nationkey") % LABEL_FOLDER_EVERY == 0)
           .select((F.col("n_nationkey") + LABEL_MAILBOX_OFFSET).cast("long").alias("rowid"),
                   F.concat(F.lit("label/"), F.lower(F.col("n_name"))).alias("url"),
                   F.col("n_nationkey").cast("long").alias("source")))
    return base.unionByName(lab)


def mail_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return (m.filter((F.col("priority") == LABELLED_PRIORITY)
                     & (F.col("mailbox") % LABEL_FOLDER_EVERY == 0))
            .select(F.col("rowid").alias("message_rowid"),
                    (F.col("mailbox") + LABEL_MAILBOX_OFFSET).alias("mailbox_id")))


def mail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("sender"),
                    F.col("event_type").alias("folder"), "value", "props")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def html_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


class MailViews:
    """Bundle of the views for one driver folder (lazy; nothing is read until used)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name):
        fn = VIEWS.get(name)
        if fn is None:
            if name in RAW_TABLES:
                return table(self.spark, self.sf_dir, name)
            raise AttributeError(name)
        return fn(self.spark, self.sf_dir)


VIEWS = {
    "messages": messages, "addresses": addresses, "recipients": recipients,
    "mailboxes": mailboxes, "mail_labels": mail_labels, "mail_events": mail_events,
    "bodies": bodies, "html_bodies": html_bodies, "threads": threads,
}
RAW_TABLES = ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split()
