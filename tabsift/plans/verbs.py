"""One query for each relational verb, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsift.functions import na
from tabsift.operators import relational as R
from tabsift.plans.registry import query, read, rounded


@query("SELECT r_name AS region, r_regionkey AS id FROM region")
def p1_select_rename(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").withColumnRenamed("r_name", "region").select("region", F.col("r_regionkey").alias("id"))


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def p2_select_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem")
    return t.select([c for c in t.columns if c.endswith("key")])


@query("SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS gross, round(o_totalprice * 1.1 - o_totalprice, 4) AS tax FROM orders")
def p3_mutate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "orders").withColumn("gross", F.col("o_totalprice") * 1.1).withColumn("tax", F.col("gross") - F.col("o_totalprice")).select("o_orderkey", "gross", "tax"), 4)


@query("SELECT lower(r_name) AS r_name, lower(CAST(r_regionkey AS VARCHAR)) AS r_regionkey FROM region")
def p4_mutate_all(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "region").select("r_name", "r_regionkey")
    return t.select(*[F.lower(F.col(c).cast("string")).alias(c) for c in t.columns])


@query("SELECT p_partkey, TRY_CAST(regexp_extract(p_name, '([0-9]+)', 1) AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS bad FROM part")
def p5_try_cast(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", na.as_number(F.regexp_extract("p_name", "([0-9]+)", 1)).alias("n"), na.as_number(F.lit("inf")).alias("bad"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 40 AND l_discount < 0.02) OR l_tax = 0.08")
def p6_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").filter(((F.col("l_quantity") > 40) & (F.col("l_discount") < 0.02)) | (F.col("l_tax") == 0.08)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT')")
def p7_in(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").isin("1-URGENT")).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN nullif(c_acctbal, 0) IS NULL THEN NULL WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS side FROM customer")
def p8_if_else(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", na.if_else(F.nullif("c_acctbal", F.lit(0.0)) > 0, F.lit("in"), F.lit("out")).alias("side"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' END AS side FROM nation")
def p9_recode(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("n_regionkey")
    return read(spark, d, "nation").select("n_nationkey", F.when(r == 0, "south").when(r == 1, "west").when(r == 2, "east").alias("side"))


@query("SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind, coalesce(nullif(user_id, 1), 0) AS uid FROM events")
def p10_p11_coalesce_fill(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("click")), F.lit("none")).alias("kind"), F.nullif("user_id", F.lit(1)).alias("uid"))
    return e.na.fill({"uid": 0})


@query("SELECT r_name AS region_name, r_regionkey AS region_key FROM region")
def p12_clean_names(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_names(read(spark, d, "region").select(F.col("r_name").alias("Region Name"), F.col("r_regionkey").alias("regionKey")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 0 THEN NULL WHEN l_quantity < 10 THEN '[0,10)' WHEN l_quantity < 100 THEN '[10,100)' WHEN l_quantity < 1000 THEN '[100,1000)' ELSE '[1000,Inf)' END AS bin FROM lineitem")
def p13_cut(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    b = F.when(q < 0, None).when(q < 10, "[0,10)").when(q < 100, "[10,100)").when(q < 1000, "[100,1000)").otherwise("[1000,Inf)")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b.alias("bin"))


@query("SELECT l_suppkey, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS returned FROM lineitem GROUP BY 1")
def p15_a13_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "lineitem").groupBy("l_suppkey").agg(na.share(F.col("l_returnflag"), "R").alias("returned")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN nullif(l_tax, 0) IS NOT NULL THEN greatest(l_tax, l_discount) END AS hi, CASE WHEN nullif(l_tax, 0) IS NOT NULL THEN least(l_tax, l_discount) END AS lo FROM lineitem")
def p16_row_max(spark: SparkSession, d: str) -> DataFrame:
    t = F.nullif("l_tax", F.lit(0.0))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", na.row_max(t, F.col("l_discount")).alias("hi"), na.row_min(t, F.col("l_discount")).alias("lo"))


@query("SELECT o_orderstatus, printf('%d (%.1f)', n, round_even(100.0 * n / sum(n) OVER (), 1)) AS cell FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def p17_a12_n_percent(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    pct = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return n.select("o_orderstatus", F.format_string("%d (%.1f)", F.col("n"), F.bround(pct, 1)).alias("cell"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_inner(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def j2_left(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY l_orderkey) = count(*) OVER (PARTITION BY l_orderkey) AS all_returned FROM lineitem")
def j3_flag_update(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", na.holds_everywhere(F.col("l_returnflag") == "R", Window.partitionBy("l_orderkey")).alias("all_returned"))


@query("SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000")
def j4_right(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").filter("c_acctbal > 9000")
    return c.join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").select("n_name", "c_custkey")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k")
def j5_full(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = read(spark, d, "supplier").filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j6_anti(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def j7_semi(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders").filter("o_totalprice > 100000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("""SELECT p.event_id, s.value AS last_value, epoch_us(s.ts) AS found_at FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def j8_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("at").alias("found_at"), F.col("value").alias("last_value"))
    hit = R.nearest(e.filter("event_type = 'purchase'").select("event_id", "user_id", "at"), clicks, ["user_id"], "at", "found_at", ["last_value"])
    return hit.select("event_id", "last_value", F.col("found_at_found").alias("found_at"))


@query("SELECT r_name, d FROM region, range(1, 10) t(d)")
def j9_cross(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").select("r_name").crossJoin(F.broadcast(spark.range(1, 10).select(F.col("id").alias("d"))))


@query("SELECT a.o_orderkey, count(*) AS earlier FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey <= a.o_orderkey GROUP BY 1")
def j11_triangular(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("earlier"))


@query("""WITH a AS (SELECT l_orderkey AS pmcid, l_linenumber AS "row", l_quantity AS q FROM lineitem WHERE l_suppkey % 2 = 0), b AS (SELECT l_orderkey AS pmcid, l_linenumber AS "row", l_tax AS t FROM lineitem WHERE l_tax < 0.05),
    s AS (SELECT x.pmcid FROM (SELECT pmcid, max("row") AS m FROM a GROUP BY 1) x JOIN (SELECT pmcid, max("row") AS m FROM b GROUP BY 1) y ON x.pmcid = y.pmcid AND x.m = y.m)
    SELECT coalesce(a.pmcid, b.pmcid) AS pmcid, coalesce(a."row", b."row") AS "row", q, t FROM (SELECT * FROM a WHERE pmcid IN (SELECT pmcid FROM s)) a FULL JOIN (SELECT * FROM b WHERE pmcid IN (SELECT pmcid FROM s)) b ON a.pmcid = b.pmcid AND a."row" = b."row" """)
def j13_same_shape(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem")
    a = l.filter("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("pmcid"), F.col("l_linenumber").alias("row"), F.col("l_quantity").alias("q"))
    b = l.filter("l_tax < 0.05").select(F.col("l_orderkey").alias("pmcid"), F.col("l_linenumber").alias("row"), F.col("l_tax").alias("t"))
    return R.same_shape_merge(a, b, ["pmcid", "row"])


@query("SELECT n_name, c.n AS customers, s.n AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def j14_many_left(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t, k, n: read(spark, d, t).groupBy(F.col(k).alias("key")).agg(F.count(F.lit(1)).alias(n))
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return R.merge_all([nation, count("customer", "c_nationkey", "customers"), count("supplier", "s_nationkey", "suppliers")], ["key"]).drop("key")


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS weighted FROM events GROUP BY 1")
def a1_a2_tally(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("weighted"))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi, median(l_quantity) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 4) AS var FROM lineitem GROUP BY 1")
def a3_aggregates(spark: SparkSession, d: str) -> DataFrame:
    q = "l_quantity"
    out = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(q).alias("s"), F.avg(q).alias("m"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.percentile(q, F.lit(0.5)).alias("med"), F.stddev_samp(q).alias("sd"), F.var_samp(q).alias("var"))
    return out.withColumns({"s": F.round("s", 2), "m": F.round("m", 6), "sd": F.round("sd", 6), "var": F.round("var", 4)})


@query("SELECT l_orderkey, CASE WHEN count(nullif(l_tax, 0)) = count(*) THEN round(sum(l_tax), 6) END AS tax FROM lineitem GROUP BY 1")
def a4_strict_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "lineitem").groupBy("l_orderkey").agg(na.strict_sum(F.nullif("l_tax", F.lit(0.0))).alias("tax")))


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr FROM lineitem GROUP BY 1")
def a5_quantiles(spark: SparkSession, d: str) -> DataFrame:
    p = lambda x: F.percentile("l_extendedprice", F.lit(x))
    return rounded(read(spark, d, "lineitem").groupBy("l_suppkey").agg(p(0.25).alias("q1"), (p(0.75) - p(0.25)).alias("iqr")), 4)


@query("SELECT user_id, mode, n FROM (SELECT user_id, event_type AS mode, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def a6_first_mode(spark: SparkSession, d: str) -> DataFrame:
    return na.first_mode(read(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT source, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def a7_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def a9_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1 AS duplicated FROM orders")
def a10_duplicated(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicates(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "duplicated")


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P", count(*) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def a11_cross_tab(spark: SparkSession, d: str) -> DataFrame:
    return R.cross_tab(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_orderkey, bool_or(l_tax = 0) AS any_free, bool_and(l_quantity > 5) AS all_big FROM lineitem GROUP BY 1")
def a14_any_all(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_tax") == 0).alias("any_free"), F.bool_and(F.col("l_quantity") > 5).alias("all_big"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(corr(l_tax, l_discount), 6) AS s FROM lineitem")
def a15_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.corr("l_tax", "l_discount").alias("s")))


@query("SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'click', count(*) FROM orders) GROUP BY 1")
def a20_recount(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    b = read(spark, d, "orders").agg(F.lit("click").alias("reason"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(b).groupBy("reason").agg(F.sum("n").alias("n"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS nth FROM orders")
def w1_w3_w4_windows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return read(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(w.orderBy("o_orderkey")).alias("before"), F.dense_rank().over(w.orderBy("o_orderpriority")).alias("rank"), F.row_number().over(w.orderBy("o_orderkey")).alias("nth"))


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def w5_first_last(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_orderkey").alias("first"), F.max_by("o_orderkey", "o_orderkey").alias("last"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def w6_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return read(spark, d, "events").select("event_id", na.carry_forward(x, ["user_id"], ["event_id"]).alias("last_purchase"))


@query("SELECT event_id, CAST(sum(j) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS segment FROM (SELECT event_id, user_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 100 THEN 1 ELSE 0 END AS j FROM events)")
def w7_segments(spark: SparkSession, d: str) -> DataFrame:
    return R.segments(read(spark, d, "events"), ["user_id"], "event_id", 100).select("event_id", "segment")


@query("SELECT c_custkey, round(c_acctbal - median(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS off FROM customer")
def w8_from_median(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    m = c.groupBy("c_nationkey").agg(F.percentile("c_acctbal", F.lit(0.5)).alias("m"))
    return rounded(c.join(m, "c_nationkey").select("c_custkey", (F.col("c_acctbal") - F.col("m")).alias("off")), 4)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o1_o2_top(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")



@query("SELECT 'c' AS id, c_custkey AS key, c_mktsegment AS seg FROM customer UNION ALL SELECT 's', s_suppkey, NULL FROM supplier")
def u1_bind_rows(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.lit("c").alias("id"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("seg"))
    return c.unionByName(read(spark, d, "supplier").select(F.lit("s").alias("id"), F.col("s_suppkey").alias("key")), allowMissingColumns=True)


@query("SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 12) GROUP BY 1")
def u3_difference(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(read(spark, d, "supplier").filter("s_nationkey < 12").select("s_nationkey"))


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_tax))")
def r1_melt(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "name", "value")


@query("""SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS BIGINT) AS "F_n", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS BIGINT) AS "O_n", max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS "F_hi", max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS "O_hi" FROM orders GROUP BY 1""")
def r2_pivot_wider(spark: SparkSession, d: str) -> DataFrame:
    wide = read(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("hi"))
    return wide.select("o_custkey", *[F.nullif(F.coalesce(f"{s}_n", F.lit(0)), F.lit(0)).alias(f"{s}_n") for s in "FO"], "F_hi", "O_hi")


@query("SELECT p_partkey, p[1] AS a, p[2] AS b, p[3] AS c, p[4] AS e FROM (SELECT p_partkey, string_split(p_type, ' ') AS p FROM part)")
def r3_separate(spark: SparkSession, d: str) -> DataFrame:
    return R.split_columns(read(spark, d, "part"), "p_type", ["a", "b", "c", "e"], " ").select("p_partkey", "a", "b", "c", "e")


@query("SELECT concat_ws(' ', n_name, CAST(n_nationkey AS VARCHAR)) AS label FROM nation")
def r4_unite(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string")).alias("label"))


@query("SELECT n_name FROM (SELECT n_name, unnest(range(0, n_regionkey)) FROM nation)")
def r5_replicate(spark: SparkSession, d: str) -> DataFrame:
    return R.replicate(read(spark, d, "nation"), F.col("n_regionkey")).select("n_name")


@query("SELECT l_linenumber AS r, l_orderkey AS c, l_quantity AS value FROM lineitem WHERE l_orderkey < 50")
def r6_transpose(spark: SparkSession, d: str) -> DataFrame:
    long = read(spark, d, "lineitem").filter("l_orderkey < 50").select(F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"), F.col("l_quantity").alias("value"))
    return long.select(F.col("c").alias("r"), F.col("r").alias("c"), "value")


@query("SELECT user_id, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS click, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchase FROM events GROUP BY 1")
def r7_indicators(spark: SparkSession, d: str) -> DataFrame:
    return R.indicators(read(spark, d, "events"), "user_id", "event_type", ["click", "purchase"])
