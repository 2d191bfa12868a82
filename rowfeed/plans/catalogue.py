"""Queries over the driver's tables, one or more for each operator, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowfeed.functions import promote
from rowfeed.functions.codecs import Tensor, uniform_length
from rowfeed.functions.hashing import split_bounds
from rowfeed.functions.predicates import InIntersection, InLambda, InSet, InVector, Negate, Reduce, Split
from rowfeed.operators import batching, index, sampling
from rowfeed.operators.aggregate import RootMeanSquare, aggregate
from rowfeed.operators.joins import band_join, overlap_join
from rowfeed.operators.ngram import NGram
from rowfeed.operators.prefix import Running, as_of_join, running
from rowfeed.operators.transform import Transform
from rowfeed.schema import Field, Schema
from rowfeed.sinks.converter import convert
from rowfeed.sinks.writer import attach, copy, load_indexes, store_indexes, stored_schema, write_groups
from rowfeed.sources import rowgroups
from rowfeed.sources.scan import Scan
from rowfeed.staging import Workspace
from rowfeed.streaming import stream as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with row groups of 1000 ids, and the time in microseconds."""
    df = rowgroups.logical(table(spark, sf_dir, "events"), "event_id", 1000)
    return df.withColumn("us", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")))


EVENTS = "(SELECT *, event_id // 1000 AS rg, epoch_us(ts) AS us FROM events)"
U = "(('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"

# Scans and projections


@query("SELECT r_regionkey, r_name FROM region")
def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan(f"{sf_dir}/region.parquet").frame(spark)


@query("SELECT o_orderkey // 1000 AS rg, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, count(*) AS n_rows FROM orders GROUP BY 1")
def logical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowgroups.summary(rowgroups.logical(table(spark, sf_dir, "orders"), "o_orderkey", 1000), "o_orderkey")


@query("SELECT (k // 1000)::BIGINT AS batch, count(*) AS n_rows FROM (SELECT row_number() OVER () - 1 AS k FROM orders) GROUP BY 1")
def scan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the batches that a reader of exact batches gives, counted where the rows are."""
    rows = batching.batches(Scan(f"{sf_dir}/orders.parquet", ["o_orderkey"]).frame(spark), 1000, ["o_orderkey"])
    return rows.groupBy(F.col("batch_id").alias("batch")).agg(F.count("*").alias("n_rows"))


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders")
def physical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All row groups of the files, read by their manifest."""
    return rowgroups.physical(spark, f"{sf_dir}/orders.parquet", columns=["o_orderkey"]).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def scan_multi_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan([f"{sf_dir}/nation.parquet", f"{sf_dir}/nation.parquet"], ["n_nationkey", "n_name"]).frame(spark)


@query("SELECT count(l_orderkey) AS n FROM lineitem")
def sql_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT count(l_orderkey) AS n FROM parquet.`{sf_dir}/lineitem.parquet`")


def _grouped(spark: SparkSession, sf_dir: str, size: int = 1000) -> str:
    """A copy of `events` with a row group for each run of ids, many in a file, in the order that folders of their numbers would have; its folder."""
    path = f"{Workspace(spark).path}/events"
    rows = rowgroups.logical(table(spark, sf_dir, "events"), "event_id", size)
    write_groups(rows.withColumn("rg", F.concat(F.lit("rg="), F.col("rg").cast("string"), F.lit("/"))), path, "rg", ["event_id"])
    return path


@query(f"SELECT rg, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n_rows FROM {EVENTS} GROUP BY rg")
def rowgroup_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files' row groups by their manifest, put together by the bounds that footers have."""
    found = rowgroups.manifest(spark, _grouped(spark, sf_dir), bounds=["event_id"]).select(F.expr("bounds.event_id.low div 1000").alias("rg"), (F.col("high") - F.col("low")).alias("n"))
    firsts = rowgroups.summary(events(spark, sf_dir), "event_id").select("rg", "first_id", "last_id")
    return found.groupBy("rg").agg(F.sum("n").alias("n_rows")).join(firsts, "rg").select("rg", "first_id", "last_id", "n_rows")


@query("SELECT (o_orderkey_rank // 500)::BIGINT AS rg, count(*) AS n_rows, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS o_orderkey_rank FROM orders) GROUP BY 1")
def rowgroups_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowgroups.summary(rowgroups.by_count(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 500), "o_orderkey")


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan(f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).frame(spark)


@query("SELECT l_extendedprice, l_discount FROM lineitem")
def project_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan(f"{sf_dir}/lineitem.parquet", ["l_(ext|dis).*"]).frame(spark)


# Predicates


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def pred_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan(f"{sf_dir}/events.parquet", ["event_id", "event_type"], predicate=InSet(["click", "error"], "event_type")).frame(spark)


@query("SELECT doc_id FROM documents WHERE list_has_any(string_split(lower(text), ' '), ['para', 'dans', 'with'])")
def pred_in_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("words"))
    return InIntersection(["para", "dans", "with"], "words").filter(docs).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def pred_in_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = InLambda(["o_totalprice", "o_orderstatus"], lambda price, status, least: (price > least) & (status == "O"), 150000)
    return Scan(f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], predicate=keep).frame(spark)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
def pred_in_lambda_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan(f"{sf_dir}/orders.parquet", ["o_orderkey"], predicate=InLambda(["o_orderkey"], lambda k, r: k % 7 == r, 3, python=True)).frame(spark)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"SELECT doc_id, quality FROM {LABELLED} WHERE quality IS NULL OR quality NOT IN (1)")
def pred_in_negate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Negate(InSet([1], "quality")).filter(_labelled(spark, sf_dir)).select("doc_id", "quality")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R') AND l_linestatus IN ('O')")
def pred_reduce_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Reduce([InSet(["R"], "l_returnflag"), InSet(["O"], "l_linestatus")], all)
    return Scan(f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber"], predicate=keep).frame(spark)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R') OR l_linestatus IN ('O')")
def pred_reduce_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Reduce([InSet(["R"], "l_returnflag"), InSet(["O"], "l_linestatus")], any)
    return Scan(f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber"], predicate=keep).frame(spark)


@query("SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) = 1")
def pred_reduce_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Reduce([InSet(["O"], "o_orderstatus"), InSet(["1-URGENT"], "o_orderpriority")], lambda flags: sum(flags) == 1)
    return Scan(f"{sf_dir}/orders.parquet", ["o_orderkey"], predicate=keep).frame(spark)


FRACTIONS = [0.5, 0.3, 0.2]


def _split(i: int) -> None:
    low, high = split_bounds(FRACTIONS, i)
    half = "(('0x' || substr(md5(o_orderkey::VARCHAR), {0}, 16))::UBIGINT)::HUGEINT"

    @query(f"SELECT o_orderkey FROM orders WHERE ({half.format(1)} * 2 + {half.format(17)}) % 9223372036854775807 >= {low} AND ({half.format(1)} * 2 + {half.format(17)}) % 9223372036854775807 < {high}", f"pred_split_{i}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Scan(f"{sf_dir}/orders.parquet", ["o_orderkey"], predicate=Split(FRACTIONS, i, "o_orderkey")).frame(spark)


for _i in range(3):
    _split(_i)


@query("SELECT c_custkey, c_mktsegment || ' 100%' AS segment FROM customer WHERE c_mktsegment IN ('BUILDING')")
def pred_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on the column that a dataset is partitioned by, with values that paths have to encode."""
    path = f"{Workspace(spark).path}/customer"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(" 100%")).alias("segment"))
    rows.repartition("segment").write.partitionBy("segment").parquet(path)
    return Scan(path, predicate=InSet(["BUILDING 100%"], "segment")).frame(spark)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 100000) OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus != 'F')")
def filters_dnf(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = [[("o_orderstatus", "=", "O"), ("o_totalprice", ">", 100000)], [("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("o_orderstatus", "!=", "F")]]
    return Scan(f"{sf_dir}/orders.parquet", ["o_orderkey", "o_orderstatus"], filters=clauses).frame(spark)


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity * 2 > 60 AND l_discount < 0.05")
def pred_vectorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = InVector(["l_quantity", "l_discount"], lambda f: (f.l_quantity * 2 > 60) & (f.l_discount < 0.05))
    return Scan(f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"], predicate=keep).frame(spark)


# Row-group indexes, selectors, shards


@query(f"SELECT DISTINCT event_type AS value, rg FROM {EVENTS}")
def index_build_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.ValueIndex("by_type", "event_type").entries(events(spark, sf_dir))


@query("SELECT DISTINCT value, rg FROM (SELECT unnest(string_split(lower(text), ' ')) AS value, doc_id // 100 AS rg FROM documents)")
def index_build_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rowgroups.logical(table(spark, sf_dir, "documents"), "doc_id", 100).withColumn("words", F.split(F.lower("text"), " "))
    return index.ValueIndex("by_word", "words").entries(docs)


@query(f"SELECT DISTINCT true AS value, doc_id // 100 AS rg FROM {LABELLED} WHERE quality IS NOT NULL")
def index_build_notnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.NotNullIndex("labelled", "quality").entries(rowgroups.logical(_labelled(spark, sf_dir), "doc_id", 100))


@query(f"SELECT user_id AS value, count(DISTINCT rg) AS n_rg FROM {EVENTS} GROUP BY 1")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stats(index.ValueIndex("by_user", "user_id").entries(events(spark, sf_dir)))


@query("SELECT event_type AS value, count(DISTINCT event_id // 10) AS n_rg FROM events GROUP BY 1")
def index_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index kept as bitmaps of row-group numbers; their bits counted."""
    rows = rowgroups.logical(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 10)
    found = index.bitmaps(index.ValueIndex("by_type", "event_type").entries(rows))
    return found.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n_rg"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, true AS near FROM events WHERE event_id // 1000 % 3 = 0")
def index_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of row groups, merged for some of them: whether the distinct count is within 6 % of the exact one, and the median's rank within 3 %."""
    rows = events(spark, sf_dir)
    some = index.merged(index.sketches(rows, ["user_id", "value"]).where("rg % 3 = 0"), [0.5]).first()  # one row
    rank = F.avg((F.col("value") <= F.lit(some["value_quantiles"][0])).cast("double"))
    exact = rows.where("rg % 3 = 0").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), rank.alias("rank"))
    return exact.select("n", "users", ((F.abs(F.lit(some["user_id_distinct"]) - F.col("users")) <= F.col("users") * 0.06) & (F.abs(F.col("rank") - 0.5) <= 0.03)).alias("near"))


def _selected(spark: SparkSession, sf_dir: str, selector: index.Selector) -> DataFrame:
    """Rows of the selected groups, by ranges of their keys, which go to the reader as filters."""
    found = index.build_indexes(events(spark, sf_dir), [index.ValueIndex("by_id", "event_id"), index.ValueIndex("by_user", "user_id")])
    scan = Scan(f"{sf_dir}/events.parquet", ["event_id"], key="event_id", group_size=1000, selector=selector, indexes=found)
    return rowgroups.logical(scan.frame(spark), "event_id", 1000)


BY_ID = f"(SELECT rg FROM {EVENTS} WHERE event_id IN (2, 1800))"
BY_USER = f"(SELECT rg FROM {EVENTS} WHERE user_id IN (1, 2))"


@query(f"SELECT event_id, rg FROM {EVENTS} WHERE rg IN {BY_ID}")
def select_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, index.Single("by_id", [2, 1800]))


@query(f"SELECT event_id, rg FROM {EVENTS} WHERE rg IN {BY_ID} AND rg IN {BY_USER}")
def select_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, index.Intersect([index.Single("by_id", [2, 1800]), index.Single("by_user", [1, 2])]))


@query(f"SELECT event_id, rg FROM {EVENTS} WHERE rg IN {BY_ID} OR rg IN {BY_USER}")
def select_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, index.Union([index.Single("by_id", [2, 1800]), index.Single("by_user", [1, 2])]))


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey // 500) % 5 = 0")
def shard_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan(f"{sf_dir}/orders.parquet", ["o_orderkey"], key="o_orderkey", group_size=500, shard_index=0, shard_count=5).frame(spark)


@query("SELECT (o_orderkey // 100) % 5 AS shard, count(*) AS n FROM orders GROUP BY 1")
def shard_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = Scan(f"{sf_dir}/orders.parquet", ["o_orderkey"], key="o_orderkey", group_size=100)
    parts = [scan.where(shard_index=i, shard_count=5).frame(spark).agg(F.count("*").alias("n")).select(F.lit(i).cast("bigint").alias("shard"), "n") for i in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events")
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a dataset's own row groups together: each one reads its groups only."""
    scan, out = Scan(_grouped(spark, sf_dir, 250), ["event_id"], shard_index=0, shard_count=3), None
    for i in range(3):
        part = scan.where(shard_index=i).frame(spark)
        out = part if out is None else out.union(part)
    return out.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


#: Folders of a partitioned copy, however many groups of ids there are.
PARTITIONS = 16


@query("SELECT event_id, value FROM events WHERE event_id // 250 IN (1, 3, 8)")
def shard_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on the partition column with shards: files of other partitions aren't opened, and of theirs only row groups whose bounds may match."""
    path, wanted = f"{Workspace(spark).path}/parts", [1, 3, 8]
    rows = table(spark, sf_dir, "events").withColumn("g", F.expr("event_id div 250"))
    write_groups(rows.withColumns({"rg": F.col("g"), "part": F.pmod("g", F.lit(PARTITIONS))}), path, "rg", ["event_id"], "part")
    keep = Reduce([InSet(wanted, "g"), InSet([g % PARTITIONS for g in wanted], "part")], all)
    scan, out = Scan(path, ["event_id", "value"], predicate=keep, shard_index=0, shard_count=3), None
    for i in range(3):
        part = scan.where(shard_index=i).frame(spark)
        out = part if out is None else out.union(part)
    return out


@query("SELECT event_id, event_type FROM events WHERE event_id < 3500 AND user_id % 5 = 2")
def scan_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups by their footers, then by a Python predicate on its own column, then the other columns."""
    keep = InLambda(["user_id"], lambda user: user % 5 == 2, python=True)
    return Scan(_grouped(spark, sf_dir), ["event_id", "event_type"], predicate=keep, filters=[("event_id", "<", 3500)], seed=1).frame(spark)


@query("SELECT event_id FROM events")
def scan_foreign_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of files whose names have no suffix, as other writers leave them."""
    path = f"{Workspace(spark).path}/foreign"
    table(spark, sf_dir, "events").select("event_id").repartition(4).write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, status in enumerate(files.listStatus(folder)):
        if status.getPath().getName().endswith(".parquet"):
            files.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{k:06d}_0"))
    scan = Scan(path, ["event_id"], shard_index=0, shard_count=2)
    return scan.frame(spark).union(scan.where(shard_index=1).frame(spark))


@query(f"SELECT event_id, rg, floor((row_number() OVER (PARTITION BY rg ORDER BY event_id) - 1)::DOUBLE / (count(*) OVER (PARTITION BY rg)::DOUBLE / least(count(*) OVER (PARTITION BY rg), 7)))::BIGINT AS part FROM {EVENTS}")
def row_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.row_drop(events(spark, sf_dir).select("event_id", "rg"), 7, ["event_id"])


PARTS = "(SELECT *, floor((row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1)::DOUBLE / (count(*) OVER (PARTITION BY o_orderkey // 1000)::DOUBLE / least(count(*) OVER (PARTITION BY o_orderkey // 1000), 7)))::BIGINT AS part FROM orders)"


@query(f"SELECT o_orderkey FROM {PARTS} WHERE part = 2 AND o_orderstatus = 'O'")
def scan_drop_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sub-split of the rows as they are, of which the predicate keeps some."""
    return Scan(f"{sf_dir}/orders.parquet", ["o_orderkey"], key="o_orderkey", group_size=1000, predicate=InSet(["O"], "o_orderstatus"), drop_parts=7, drop_part=2).frame(spark)


# Order, epochs, mixes, batches


@query(f"SELECT rg, row_number() OVER (ORDER BY md5('7:0:' || rg)) AS rg_rank FROM (SELECT DISTINCT rg FROM {EVENTS})")
def shuffle_rowgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rank_rowgroups(events(spark, sf_dir), 7)


@query(f"SELECT event_id, rg, row_number() OVER (PARTITION BY rg ORDER BY md5('7:0:' || event_id), event_id) AS row_rank FROM {EVENTS}")
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rank_rows(events(spark, sf_dir).select("event_id", "rg"), 7, "event_id")


@query("SELECT g, row_number() OVER (ORDER BY md5('7:0:' || n)) AS place FROM (SELECT g, row_number() OVER (ORDER BY 'rg=' || g || '/') - 1 AS n FROM (SELECT DISTINCT event_id // 1000 AS g FROM events))")
def seeded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a seeded read gives the row groups of files; their rows aren't moved."""
    rows = Scan(_grouped(spark, sf_dir), ["event_id"], seed=7, shuffle_rows=True).ordered(spark)
    first = rows.withColumn("at", F.monotonically_increasing_id()).groupBy(F.expr("event_id div 1000").alias("g")).agg(F.min("at").alias("at"))
    return first.select("g", F.row_number().over(Window.orderBy("at")).cast("bigint").alias("place"))


BOUNDED = f"""SELECT event_id, pos, row_number() OVER (ORDER BY pos + floor({U.format("'7:' || event_id")} * 100)::BIGINT, pos) - 1 AS shuffled_pos
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)"""


@query(BOUNDED)
def shuffle_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bounded_shuffle(table(spark, sf_dir, "events").select("event_id"), 100, 7, "event_id")


@query(f"SELECT round(abs(corr(pos::DOUBLE, shuffled_pos::DOUBLE)), 9) AS abs_corr FROM ({BOUNDED})")
def shuffle_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.displacement(shuffle_bounded(spark, sf_dir)).select(F.round("abs_corr", 9).alias("abs_corr"))


@query("SELECT n_nationkey, n_name, epoch FROM nation, (SELECT unnest(range(3)) AS epoch)")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.epochs(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 3)


@query("""SELECT s_suppkey, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5((11 + epoch) || ':' || s_suppkey), s_suppkey) AS epoch_rank
FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 64), (SELECT unnest(range(2)) AS epoch)""")
def inmem_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.inmem_epochs(table(spark, sf_dir, "supplier").select("s_suppkey"), 64, 2, 11, "s_suppkey")


@query(f"""WITH slot AS (SELECT n AS slot, CASE WHEN {U.format("'7:' || n")} < 0.3 THEN 0 ELSE 1 END AS source FROM (SELECT unnest(range(400000)) AS n)),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM slot),
src AS (SELECT 0 AS source, c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer
        UNION ALL SELECT 1, s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier),
j AS (SELECT slot, k.source::BIGINT AS source, id FROM k LEFT JOIN src USING (source, k))
SELECT slot, source, id FROM j WHERE slot < (SELECT min(slot) FROM j WHERE id IS NULL)""")
def weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return sampling.weighted_mix([a, b], [0.3, 0.7], 7, ["id", "id"]).select("slot", "source", "id")


ORDERED = "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"


@query(f"SELECT o_orderkey, pos // 64 AS batch_id, pos % 64 AS batch_pos FROM {ORDERED} WHERE pos // 64 < n // 64")
def rebatch_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batches(table(spark, sf_dir, "orders").select("o_orderkey"), 64, ["o_orderkey"], keep_partial=False)


@query(f"SELECT pos // 64 AS batch_id, count(*) AS n_rows, string_agg(o_orderkey::VARCHAR, ',' ORDER BY pos) AS rows FROM {ORDERED} GROUP BY 1")
def batch_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batching.collected(table(spark, sf_dir, "orders").select("o_orderkey"), 64, ["o_orderkey"], "o_orderkey")
    return out.select("batch_id", "n_rows", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("rows"))


# Windows of consecutive rows


def _steps(windows: DataFrame, by: str) -> DataFrame:
    steps = [c for c in windows.columns if c.startswith("t_")]
    return windows.select(by, "start_ts", *[F.col(f"{s}.event_id").alias(f"id_{s[2:]}") for s in steps])


def _lead_sql(by: str, leads: list[int], threshold: int, name: Callable[[int], str] = str) -> str:
    last = max(leads)
    steps = ", ".join(f"lead(event_id, {k}) OVER w AS id_{name(k)}" for k in leads)
    gaps = " AND ".join(f"lead(us, {k + 1}) OVER w - lead(us, {k}) OVER w <= {threshold}" for k in range(last)) or "true"
    return f"SELECT {by}, start_ts, {', '.join(f'id_{name(k)}' for k in leads)} FROM (SELECT {by}, us AS start_ts, {steps}, ({gaps}) AS fits, lead(us, {last}) OVER w AS end_ts FROM {EVENTS} WINDOW w AS (PARTITION BY {by} ORDER BY us, event_id)) WHERE fits AND end_ts IS NOT NULL"


HOUR = 3_600_000_000
#: Rows of a block where a query divides keys whatever they have.
BLOCK = 2048


@query(_lead_sql("user_id", [0, 1, 2], 24 * 3 * HOUR))
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = NGram({i: ["event_id", "us"] for i in range(3)}, 24 * 3 * HOUR, "us")
    return _steps(spec.windows_spread(events(spark, sf_dir), "user_id", ["event_id"]), "user_id")


@query(_lead_sql("rg", [0, 1], HOUR))
def ngram_by_rowgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = NGram({0: ["event_id", "us"], 1: ["event_id"]}, HOUR, "us")
    return _steps(spec.windows(events(spark, sf_dir), "rg", ["event_id"]), "rg")


@query(f"SELECT start_ts, id_0, id_1 FROM ({_lead_sql('rg', [0, 1], HOUR)})")
def ngram_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the files' own row groups, made by the tasks that read them."""
    micros = Transform({"us": F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))})
    scan = Scan(_grouped(spark, sf_dir), ["event_id", "ts"], transform=micros, ngram=NGram({0: ["event_id", "us"], 1: ["event_id"]}, HOUR, "us"))
    return _steps(scan.frame(spark), "rg").drop("rg")


@query(_lead_sql("rg", [0], 0))
def ngram_len1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(NGram({0: ["event_id", "us"]}, 0, "us").windows(events(spark, sf_dir), "rg", ["event_id"]), "rg")


@query(_lead_sql("rg", [0, 3], HOUR, lambda k: "m1" if k == 0 else "2"))
def ngram_sparse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(NGram({-1: ["event_id", "us"], 2: ["event_id"]}, HOUR, "us").windows(events(spark, sf_dir), "rg", ["event_id"]), "rg")


@query(_lead_sql("event_type", [0, 1], HOUR))
def ngram_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys with many rows each: their windows are made in blocks, in more tasks than there are keys."""
    return _steps(NGram({0: ["event_id", "us"], 1: ["event_id"]}, HOUR, "us").windows_spread(events(spark, sf_dir), "event_type", ["event_id"], size=BLOCK), "event_type")


ORDER_PAIRS = """SELECT o_orderkey // 1000 AS rg, o_orderkey AS start_ts, lead(o_orderkey) OVER w AS end_ts, {0} FROM {1}
WINDOW w AS (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey)"""


@query(f"SELECT rg, start_ts AS id_0, end_ts AS id_1, part FROM ({ORDER_PAIRS.format('part', PARTS)}) WHERE end_ts - start_ts <= 3")
def ngram_row_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every sub-split: each is in the part of its first row, and goes on into the next part."""
    scan = Scan(f"{sf_dir}/orders.parquet", key="o_orderkey", group_size=1000, drop_parts=7, ngram=NGram({0: ["o_orderkey"], 1: ["o_orderkey"]}, 3, "o_orderkey"))
    out = None
    for part in range(7):
        w = scan.where(drop_part=part).frame(spark).select("rg", F.col("t_0.o_orderkey").alias("id_0"), F.col("t_1.o_orderkey").alias("id_1"), F.lit(part).cast("bigint").alias("part"))
        out = w if out is None else out.union(w)
    return out


@query(f"SELECT rg, start_ts, c0, c1 FROM ({ORDER_PAIRS.format('o_totalprice * 2 AS c0, lead(o_totalprice) OVER w * 2 AS c1', 'orders')}) WHERE end_ts - start_ts <= 3")
def ngram_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of transformed rows."""
    double = Transform({"twice": F.col("o_totalprice") * 2}, removed=["o_totalprice"])
    scan = Scan(f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], key="o_orderkey", group_size=1000, transform=double, ngram=NGram({0: ["o_orderkey", "twice"], 1: ["twice"]}, 3, "o_orderkey"))
    return scan.frame(spark).select("rg", "start_ts", F.col("t_0.twice").alias("c0"), F.col("t_1.twice").alias("c1"))


@query(f"SELECT id_0 AS event_id_0, id_2 AS event_id_1 FROM ({_lead_sql('rg', [0, 2], HOUR)})")
def ngram_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = NGram({0: ["event_id"], 2: ["event_id"]}, HOUR, "us")
    return spec.flatten(spec.windows(events(spark, sf_dir), "rg", ["event_id"]))


@query(f"""WITH g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {72 * HOUR} THEN 0 ELSE 1 END AS fresh FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY us)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS island FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY us) - 1 AS k, count(*) OVER (PARTITION BY user_id, island) AS size,
  lead(event_id) OVER (PARTITION BY user_id, island ORDER BY us) AS id_1 FROM i)
SELECT user_id, us AS start_ts, event_id AS id_0, id_1 FROM n WHERE k % 2 = 0 AND k + 1 < size""")
def ngram_no_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = NGram({0: ["event_id", "us"], 1: ["event_id"]}, 72 * HOUR, "us", overlap=False)
    return _steps(spec.windows(events(spark, sf_dir), "user_id", ["event_id"]), "user_id")


# Transforms, types, writers


@query("SELECT l_orderkey, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def transform_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edit = Transform({"net": F.expr("l_extendedprice * (1 - l_discount)")}, removed=["l_extendedprice", "l_discount"])
    return Scan(f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"], transform=edit).frame(spark)


@query("SELECT o_orderkey, o_custkey FROM orders")
def transform_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan(f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"], transform=Transform(removed=["o_totalprice"])).frame(spark)


@query("SELECT o_totalprice, o_orderkey FROM orders")
def transform_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan(f"{sf_dir}/orders.parquet", transform=Transform(selected=["o_totalprice", "o_orderkey"])).frame(spark)


@query("SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem")
def transform_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    def double(frame):  # noqa: ANN001, ANN202
        frame["twice"] = frame["l_quantity"] * 2
        return frame.drop(columns=["l_quantity"])

    edit = Transform(func=double, edited=[Field("twice", "float64")], removed=["l_quantity"])
    return Scan(f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], transform=edit).frame(spark)


@query("SELECT n_nationkey, upper(n_name) || '!' AS shout FROM nation")
def transform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    edit = Transform(func=lambda r: r | {"shout": r["n_name"].upper() + "!"}, by_row=True, edited=[Field("shout", "str")], removed=["n_name"])
    return Scan(f"{sf_dir}/nation.parquet", ["n_nationkey", "n_name"], transform=edit).frame(spark)


@query("SELECT min(len(embedding)) = max(len(embedding)) AS uniform, max(len(embedding))::BIGINT AS width FROM embeddings")
def array_uniform_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(uniform_length(F.col("embedding")).alias("uniform"), F.max(F.size("embedding")).cast("bigint").alias("width"))


@query("SELECT event_id, epoch_us(ts) * 1000 AS ts, event_type, value FROM events")
def sanitize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promote.to_tf(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"))


@query("SELECT doc_id, (toxic = 1)::SMALLINT AS is_toxic FROM labels")
def sanitize_torch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promote.to_torch(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_toxic")))


@query("SELECT l_orderkey, l_extendedprice::FLOAT::DOUBLE AS price, l_linenumber FROM lineitem")
def converter_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("price"), "l_linenumber")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # small files
        df = convert(rows, f"{Workspace(spark).path}/kept").frame(spark)
    return df.withColumn("price", F.col("price").cast("double"))


@query(f"SELECT doc_id, quality FROM {LABELLED} WHERE quality IS NOT NULL")
def copy_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset written and copied, columns by pattern and rows without nulls."""
    path = Workspace(spark).path
    _labelled(spark, sf_dir).write.parquet(f"{path}/labelled")
    return copy(spark, f"{path}/labelled", f"{path}/copied", ["doc_.*", "qual.*"], ["quality"])


BY_PATH = "(SELECT g, row_number() OVER (ORDER BY 'g=' || g || '/') - 1 AS rg FROM (SELECT DISTINCT event_id // 1000 AS g FROM events))"


@query(f"SELECT event_type AS value, string_agg(DISTINCT rg::VARCHAR, ',' ORDER BY rg::VARCHAR) AS rgs FROM events JOIN {BY_PATH} ON event_id // 1000 = g GROUP BY event_type")
def index_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over the files' row groups that was stored beside them and read again."""
    path = _grouped(spark, sf_dir)
    store_indexes(spark, path, [index.ValueIndex("by_type", "event_type")])
    found = load_indexes(spark, path)["by_type"]
    return found.groupBy("value").agg(F.array_join(F.array_sort(F.collect_set(F.col("rg").cast("string"))), ",").alias("rgs"))


@query("SELECT vec_id, label, sum(x)::BIGINT AS total, count(*) AS width FROM (SELECT vec_id, label, floor(unnest(embedding)::DOUBLE * 1024)::BIGINT AS x FROM embeddings) GROUP BY vec_id, label")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored as encoded tensors with a schema attached to the files, decoded in the tasks that read them."""
    path, field = f"{Workspace(spark).path}/tensors", Field("embedding", np.float32, (None,), Tensor())
    kinds = "vec_id bigint, label int, embedding binary"

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(embedding=[bytes(field.encoding.encode(field, np.asarray(v, np.float32))) for v in f["embedding"]])

    table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").mapInPandas(encode, kinds).write.parquet(path)
    attach(spark, path, Schema("vectors", [Field("vec_id", np.int64), Field("label", np.int32), field]))
    stored = stored_schema(spark, path).fields["embedding"]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            arrays = [stored.encoding.decode(stored, v).astype(float) for v in f["embedding"]]
            yield f[["vec_id", "label"]].assign(total=[int(np.floor(a * 1024).sum()) for a in arrays], width=[len(a) for a in arrays])

    return Scan(path).frame(spark).mapInPandas(decode, "vec_id bigint, label int, total bigint, width bigint")


# Streams: files that are there are taken in one go, and what waits for the watermark stays out


def _streamed(spark: SparkSession, sf_dir: str, query: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """What a streaming query over `events` has given when all files are read."""
    work = Workspace(spark).path
    events(spark, sf_dir).select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{work}/in")
    return streaming.run_available(query(lambda: streaming.stream(spark, f"{work}/in")), f"{work}/out", f"{work}/checkpoint")


@query("""SELECT day, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) AS day, event_type FROM events)
WHERE day + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has passed, counted by type."""
    found = _streamed(spark, sf_dir, lambda events: streaming.tumbling(events(), "ts", "1 day", "1 hour", ["event_type"], "value"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT p.event_id, c.event_id AS click_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts >= p.ts - INTERVAL 1 HOUR AND c.ts <= p.ts + INTERVAL 12 HOUR WHERE p.event_type = 'purchase' AND c.event_type = 'click'")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined by user and time."""
    def both(events: Callable[[], DataFrame]) -> DataFrame:
        left, right = (events().where(F.col("event_type") == t) for t in ("purchase", "click"))
        return streaming.near_in_time(left, right, ["user_id"], "ts", "ts", "1 hour", "12 hours", "1 hour", "1 hour").select("event_id", F.col("event_id_right").alias("click_id"))

    return _streamed(spark, sf_dir, both)


@query(f"""SELECT key, first, second, gap_ms FROM (SELECT user_id AS key, event_id AS second, ms, lag(event_id) OVER w AS first, ms - lag(ms) OVER w AS gap_ms, max(ms) OVER () AS latest
FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)) WHERE gap_ms <= {24 * HOUR // 1000} AND ms < latest - 3600000""")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in time of each user, put in order by timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streaming.ROCKSDB)
    try:
        return _streamed(spark, sf_dir, lambda events: streaming.pairs(events(), "user_id", "ts", "event_id", 24 * HOUR // 1000, "1 hour"))
    finally:
        spark.conf.set(name, before)


# What Spark offers on the same data


@query("""SELECT n_name, sum((l_extendedprice * 100)::DECIMAL(18, 0) * (100 - (l_discount * 100)::DECIMAL(18, 0)))::DECIMAL(38, 0) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    cents = (F.col("l_extendedprice") * 100).cast("decimal(18,0)") * (F.lit(100) - (F.col("l_discount") * 100).cast("decimal(18,0)"))
    return joined.groupBy("n_name").agg(F.sum(cents).cast("decimal(38,0)").alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 3")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    any_order = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(any_order, "c_custkey", "left_anti")


@query("""SELECT event_id, last_click FROM (SELECT event_id, event_type,
  last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events)
WHERE event_type = 'purchase'""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click before each purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("last_click"))
    return as_of_join(e.where("event_type = 'purchase'"), clicks, ["user_id"], "ts", "ts", ["last_click"], exact=False, tie=["last_click"]).select("event_id", "last_click")


@query("""SELECT event_id, sum(cents) OVER w AS total, count(*) OVER w AS n, max(cents) OVER w AS highest
FROM (SELECT *, (value * 100)::BIGINT AS cents FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values of few keys with many rows each."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.rint(F.col("value") * 100).cast("bigint").alias("cents"))
    run = {"total": Running("sum", "cents"), "n": Running("row_number"), "highest": Running("max", "cents")}
    return running(rows, ["event_type"], ["ts"], run, ["event_id"], BLOCK).select("event_id", "total", "n", "highest")


@query("SELECT event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id DESC)")
def rank_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks with many ties, of few keys with many rows each."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return running(rows, ["event_type"], ["-user_id"], {"rank": Running("rank"), "dense": Running("dense_rank")}, ["event_id"], BLOCK).select("event_id", "rank", "dense")


SPAN = "epoch_us(ts) AS a, epoch_us(ts) + CASE WHEN event_id % 50 = 0 THEN 1728000000000 ELSE event_id % 7 * 600000000 END AS b"


@query(f"""SELECT p.event_id, c.event_id AS other_id FROM (SELECT *, {SPAN} FROM events WHERE event_type = 'purchase') p JOIN (SELECT *, {SPAN} FROM events WHERE event_type = 'click') c
ON p.user_id = c.user_id AND p.a < p.b AND c.a < c.b AND p.a < c.b AND c.a < p.b""")
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of minutes and of weeks that overlap."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", F.col("us").alias("a"), F.expr("us + CASE WHEN event_id % 50 = 0 THEN 1728000000000 ELSE event_id % 7 * 600000000 END").alias("b"))
    both = overlap_join(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), ("a", "b"), ("a", "b"), ["user_id"])
    return both.select("event_id", F.col("event_id_right").alias("other_id"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 2.5")
def join_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances that are near each other, without a key in common."""
    return band_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_acctbal", "s_acctbal", 2.5).select("c_custkey", "s_suppkey")


@query("SELECT p.event_id, c.event_id AS click_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts > p.ts AND c.ts <= p.ts + INTERVAL 6 HOUR WHERE p.event_type = 'purchase' AND c.event_type = 'click'")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within six hours after a purchase. The join is by user and span of six hours, a purchase in two spans, so a user with very many events is spread."""
    e = table(spark, sf_dir, "events").withColumn("span", F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div {6 * HOUR}"))
    p = e.where("event_type = 'purchase'").withColumn("span", F.explode(F.array("span", F.col("span") + 1))).alias("p")
    c = e.where("event_type = 'click'").alias("c")
    near = F.expr("p.user_id = c.user_id AND p.span = c.span AND c.ts > p.ts AND c.ts <= p.ts + INTERVAL 6 HOUR")
    return p.join(c, near).select(F.col("p.event_id").alias("event_id"), F.col("c.event_id").alias("click_id"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, len(json_keys(props))::BIGINT AS n_keys FROM events")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.size(F.json_object_keys("props")).cast("bigint").alias("n_keys"))


@query("SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 100")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey").limit(100)


@query("SELECT o_orderpriority, round(sqrt(avg(o_totalprice * o_totalprice)), 4) AS rms FROM orders GROUP BY o_orderpriority")
def udaf_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of one's own whose states merge, rounded as its SQL."""
    found = aggregate(table(spark, sf_dir, "orders"), ["o_orderpriority"], {"rms": (RootMeanSquare(), ["o_totalprice"])})
    return found.select("o_orderpriority", F.round("rms", 4).alias("rms"))


@query("SELECT n_nationkey, upper(word) AS word FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation)")
def udtf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of one's own, joined laterally."""

    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str) -> Iterator[tuple[str]]:
            for w in (text or "").split(" "):
                yield (w.upper(),)

    spark.udtf.register("rowfeed_words", Words)
    table(spark, sf_dir, "nation").createOrReplaceTempView("rowfeed_nation")
    return spark.sql("SELECT n_nationkey, word FROM rowfeed_nation, LATERAL rowfeed_words(n_name)")


@query("SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem")
def distinct_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()


def bounds_are_exact() -> bool:
    """The bounds of splits cover all buckets once."""
    ends = [split_bounds(FRACTIONS, i) for i in range(len(FRACTIONS))]
    return ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False)) and Fraction(ends[-1][1]) >= Fraction(2**63 - 2)
