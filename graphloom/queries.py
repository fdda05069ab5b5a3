"""The registered queries of the engine, each with its text and an equivalent for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import function_queries
from graphloom.operators import search
from graphloom.sources import load_model
from graphloom.streaming import tumbling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(function_queries.QUERIES)
ORACLES: dict[str, str] = dict(function_queries.ORACLES)


def text(name: str, tables: str, query: str, oracle: str | None, flat: tuple[str, ...] = (), explode: str = "", **params) -> None:
    """Register a text. ``flat`` are Spark SQL items that turn nested results into plain columns; ``explode`` a list."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load_model(spark, sf_dir, tuple(tables.split())).query(query, **params)
        if explode:
            df = df.withColumn("x", F.explode(F.expr(explode)))
        return df.selectExpr(*flat) if flat else df

    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


text("select_project_alias", "customer", "SELECT c_name AS nom, c_acctbal FROM customer", "SELECT c_name AS nom, c_acctbal FROM customer")
text("select_where_param", "customer", "SELECT c_name AS nom, c_acctbal FROM customer WHERE c_acctbal > $least AND c_mktsegment IN ['BUILDING', 'MACHINERY']", "SELECT c_name AS nom, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')", least=1000)
text("select_star", "nation", "SELECT * FROM nation", "SELECT * FROM nation")
text("select_omit", "customer", "SELECT * OMIT c_acctbal FROM customer", "SELECT * EXCLUDE (c_acctbal) FROM customer")
text("select_omit_nested", "customer", "SELECT * OMIT p.c_acctbal FROM (SELECT c_custkey, { c_name: c_name, c_acctbal: c_acctbal } AS p FROM customer)", "SELECT c_custkey, c_name FROM customer", ("c_custkey", "p.*"))
text("select_destructure", "customer", "SELECT p.{c_name, c_acctbal} FROM (SELECT { c_name: c_name, c_acctbal: c_acctbal, z: 1 } AS p FROM customer)", "SELECT c_name, c_acctbal FROM customer", ("p.*",))
text("select_value", "customer", "SELECT VALUE c_name FROM customer WHERE c_custkey < 50", "SELECT c_name FROM customer WHERE c_custkey < 50")
text("select_only", "customer", "SELECT * FROM ONLY customer:1", "SELECT * FROM customer WHERE c_custkey = 1")
text("select_record_string", "nation", "SELECT n_name FROM 'nation:7'", "SELECT n_name FROM nation WHERE n_nationkey = 7")
text("select_two_tables", "customer supplier", "SELECT c_name, s_name FROM customer, supplier", "SELECT c_name, NULL AS s_name FROM customer UNION ALL SELECT NULL, s_name FROM supplier")
text("select_subquery", "orders", "SELECT o_orderkey, big FROM (SELECT o_orderkey, o_totalprice > 100000 AS big FROM orders) WHERE big", "SELECT o_orderkey, true AS big FROM orders WHERE o_totalprice > 100000")
text("select_in_subquery", "orders customer", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT VALUE o_custkey FROM orders WHERE o_totalprice > 300000)", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
text("order_limit_start", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 START 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
text("split_explode", "orders", "SELECT o_orderkey, w FROM (SELECT o_orderkey, string::split(o_orderpriority, '-') AS w FROM orders) SPLIT w", "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM orders")
text("fetch_record", "orders customer", "SELECT o_orderkey, o_custkey FROM orders FETCH o_custkey", "SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey", ("o_orderkey", "o_custkey.c_name", "o_custkey.c_acctbal"))
text("fetch_nested", "orders customer nation", "SELECT o_orderkey, o_custkey FROM orders FETCH o_custkey, o_custkey.c_nationkey", "SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey", ("o_orderkey", "o_custkey.c_nationkey.n_name"))
text("link_path", "orders customer", "SELECT o_orderkey, o_custkey.c_name AS who FROM orders WHERE o_custkey.c_acctbal > 9000", "SELECT o_orderkey, c_name AS who FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")
text("graph_out", "orders lineitem part", "SELECT o_orderkey, ->lineitem->part.{p_partkey, p_name} AS parts FROM orders", "SELECT o_orderkey, p_partkey, p_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey", ("o_orderkey", "x.p_partkey", "x.p_name"), "parts")
text("graph_out_ids", "orders lineitem part", "SELECT o_orderkey, ->lineitem->part AS parts FROM orders", "SELECT o_orderkey, count(l_partkey) AS n, coalesce(sum(l_partkey), 0)::BIGINT AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey", ("o_orderkey", "cast(size(parts) as bigint) n", "cast(aggregate(parts, 0L, (a, b) -> a + b) as bigint) total"))
text("graph_in", "orders lineitem part", "SELECT p_partkey, <-lineitem<-orders.* AS found FROM part", "SELECT p_partkey, o_orderkey, o_totalprice FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey", ("p_partkey", "x.o_orderkey", "x.o_totalprice"), "found")
text("graph_condition", "orders lineitem part", "SELECT o_orderkey, ->(lineitem WHERE l_quantity > 45)->part.p_name AS names FROM orders", "SELECT o_orderkey, p_name AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 JOIN part ON l_partkey = p_partkey", ("o_orderkey", "x"), "names")
text("graph_count", "orders lineitem part", "SELECT o_orderkey, array::len(->lineitem) AS n FROM orders WHERE array::len(->lineitem) > 3", "SELECT o_orderkey, count(*)::INT AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(*) > 3")
text("group_by", "lineitem", "SELECT l_returnflag, l_linestatus, count() AS n, math::sum(l_quantity) AS qty, math::mean(l_extendedprice) AS price, math::percentile(l_discount, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 6) AS price, round(quantile_cont(l_discount, 0.9), 6) AS p90 FROM lineitem GROUP BY ALL", ("l_returnflag", "l_linestatus", "n", "qty", "round(price, 6) price", "round(p90, 6) p90"))
text("group_all", "orders", "SELECT count() AS n, math::min(o_totalprice) AS least, math::max(o_totalprice) AS most, count(o_totalprice > 100000) AS big FROM orders GROUP ALL", "SELECT count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most, count_if(o_totalprice > 100000)::BIGINT AS big FROM orders")
text("group_alias", "orders", "SELECT time::year(o_orderdate) AS y, count() AS n FROM orders GROUP BY y", "SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY ALL")
text("group_math", "lineitem", "SELECT l_shipmode, math::median(l_quantity) AS med, math::stddev(l_tax) AS sd, math::variance(l_tax) AS va, math::spread(l_quantity) AS sp, math::trimean(l_quantity) AS tri, math::midhinge(l_quantity) AS mid FROM (SELECT l_returnflag AS l_shipmode, l_quantity, l_tax FROM lineitem) GROUP BY l_shipmode", "SELECT l_returnflag AS l_shipmode, median(l_quantity) AS med, round(stddev_samp(l_tax), 9) AS sd, round(var_samp(l_tax), 9) AS va, max(l_quantity) - min(l_quantity) AS sp, (quantile_cont(l_quantity, .25) + 2 * median(l_quantity) + quantile_cont(l_quantity, .75)) / 4 AS tri, (quantile_cont(l_quantity, .25) + quantile_cont(l_quantity, .75)) / 2 AS mid FROM lineitem GROUP BY 1", ("l_shipmode", "med", "round(sd, 9) sd", "round(va, 9) va", "sp", "tri", "mid"))
text("update_set", "orders", "UPDATE orders SET o_orderstatus = 'X', o_totalprice += 1 WHERE o_totalprice > 200000; SELECT * FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders", ("o_orderkey", "o_orderstatus", "o_totalprice"))
text("update_merge", "nation", "UPDATE nation MERGE { n_name: 'none' } WHERE n_regionkey = 2; SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'none' ELSE n_name END AS n_name, n_regionkey FROM nation")
text("upsert", "nation", "UPSERT nation:3 SET n_name = 'three'; UPSERT nation:99 SET n_name = 'new', n_nationkey = 99, n_regionkey = 1; SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'three' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'new', 1")
text("create", "region", "CREATE region CONTENT { r_regionkey: 9, r_name: $label }; SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT 9, 'south'", label="south")
text("insert_values", "region", "INSERT INTO region (r_regionkey, r_name) VALUES (7, 'a'), (8, 'b'); SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT 7, 'a' UNION ALL SELECT 8, 'b'")
text("insert_ignore", "region", "INSERT IGNORE INTO region [{ r_regionkey: 0, r_name: 'x' }, { r_regionkey: 8, r_name: 'b' }]; SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT 8, 'b'")
text("delete_where", "nation", "DELETE nation WHERE n_regionkey = 1; SELECT * FROM nation", "SELECT * FROM nation WHERE NOT coalesce(n_regionkey = 1, false)")
text("relate", "orders lineitem part", "RELATE orders:1->lineitem->part:5 SET l_linenumber = 99, l_quantity = 3; SELECT l_orderkey, l_partkey, l_quantity FROM lineitem", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem UNION ALL SELECT 1, 5, 3.0")
text("knn", "embeddings", "SELECT vec_id, vector::distance::knn() AS d FROM embeddings WHERE embedding <|10|> $v", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], list_transform(range(64), lambda x: 0.1)), 5) AS d FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], list_transform(range(64), lambda x: 0.1)), vec_id LIMIT 10", ("vec_id", "round(d, 5) d"), v=[0.1] * 64)
text("fn_string", "customer", "SELECT c_custkey, string::uppercase(c_name) AS u, string::len(c_name) AS n, string::slice(c_name, 2, 4) AS s, string::replace(c_name, 'u', '_') AS r, string::slug(c_name) AS g, string::reverse(c_name) AS v, string::starts_with(c_name, 'Cust') AS w, string::contains(c_name, '9') AS c, string::repeat('ab', 2) AS p, string::concat(c_name, '-', c_mktsegment) AS k FROM customer", "SELECT c_custkey, upper(c_name) AS u, length(c_name)::INT AS n, substring(c_name, 3, 4) AS s, replace(c_name, 'u', '_') AS r, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS g, reverse(c_name) AS v, starts_with(c_name, 'Cust') AS w, contains(c_name, '9') AS c, 'abab' AS p, c_name || '-' || c_mktsegment AS k FROM customer")
text("fn_crypto", "customer", "SELECT c_custkey, crypto::md5(c_name) AS m, crypto::sha1(c_name) AS s1, crypto::sha256(c_name) AS s2, encoding::base64::encode(c_name) AS b FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2, base64(c_name::BLOB) AS b FROM customer")
text("fn_blake3", "nation", "SELECT n_nationkey, crypto::blake3(n_name) AS h, crypto::pbkdf2::compare(crypto::pbkdf2::generate(n_name), n_name) AS ok FROM nation", None)
text("fn_parse", "pages", "SELECT page_id, parse::url::host(url) AS h, parse::url::scheme(url) AS s, parse::url::path(url) AS p FROM pages", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages")
text("fn_time", "orders", "SELECT o_orderkey, time::year(o_orderdate) AS y, time::month(o_orderdate) AS m, time::day(o_orderdate) AS d, time::wday(o_orderdate) AS w, time::yday(o_orderdate) AS yd, time::week(o_orderdate) AS k, time::unix(o_orderdate) AS u, time::is::leap_year(o_orderdate) AS l, time::format(time::floor(o_orderdate, 7d), 'yyyy-MM-dd') AS f FROM orders", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, isodow(o_orderdate)::INT AS w, dayofyear(o_orderdate)::INT AS yd, weekofyear(o_orderdate)::INT AS k, epoch(o_orderdate)::BIGINT AS u, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS l, strftime(make_timestamp(epoch_us(o_orderdate) - epoch_us(o_orderdate) % 604800000000), '%Y-%m-%d') AS f FROM orders")
text("fn_array", "lineitem", "SELECT k, array::len(q) AS n, array::first(q) AS f, array::last(q) AS l, math::median(q) AS m, math::sum(array::slice(q, 1, 2)) AS s, array::any(q, |$e| $e > 40) AS a, array::at(q, -1) AS t, array::len(array::distinct(q)) AS d FROM (SELECT k, array::sort(q) AS q FROM (SELECT l_orderkey AS k, l_quantity AS q FROM lineitem GROUP BY k))", "SELECT k, len(q)::INT AS n, q[1] AS f, q[-1] AS l, list_median(q) AS m, coalesce(list_sum(q[2:3]), 0) AS s, len(list_filter(q, lambda e: e > 40)) > 0 AS a, q[-1] AS t, len(list_distinct(q))::INT AS d FROM (SELECT l_orderkey AS k, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1)")
text("fn_math", "part", "SELECT p_partkey, math::round(p_retailprice) AS r, math::sqrt(p_size) AS q, math::pow(p_size, 2) AS p, math::clamp(p_size, 10, 20) AS c, math::log(p_retailprice, 10) AS l, math::lerp(0, p_size, 0.5) AS e, math::fixed(p_retailprice, 1) AS f, math::abs(-p_size) AS a FROM part", "SELECT p_partkey, round(p_retailprice) AS r, round(sqrt(p_size), 9) AS q, pow(p_size, 2) AS p, least(greatest(p_size, 10), 20)::INT AS c, round(log10(p_retailprice), 9) AS l, p_size * 0.5::DOUBLE AS e, round(p_retailprice, 1) AS f, abs(p_size) AS a FROM part", ("p_partkey", "r", "round(q, 9) q", "p", "c", "round(l, 9) l", "e", "f", "a"))
text("fn_vector", "embeddings", "SELECT vec_id, vector::magnitude(embedding) AS m, vector::dot(embedding, embedding) AS d, vector::similarity::cosine(embedding, $v) AS c, vector::distance::manhattan(embedding, $v) AS h FROM embeddings", "SELECT vec_id, round(sqrt(list_inner_product(e, e)), 5) AS m, round(list_inner_product(e, e), 5) AS d, round(list_cosine_similarity(e, v), 5) AS c, round(list_sum(list_transform(e, lambda x: abs(x - 0.1))), 5) AS h FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(range(64), lambda x: 0.1::DOUBLE) AS v FROM embeddings)", ("vec_id", "round(m, 5) m", "round(d, 5) d", "round(c, 5) c", "round(h, 5) h"), v=[0.1] * 64)
text("fn_type", "events", "SELECT event_id, type::string(user_id) AS s, type::int(value) AS i, type::is::string(props) AS t, type::is::number(value) AS n, type::is::datetime(ts) AS d, meta::tb(type::string(event_type)) AS m FROM events", "SELECT event_id, user_id::VARCHAR AS s, trunc(value)::BIGINT AS i, true AS t, true AS n, true AS d, event_type AS m FROM events")
text("fn_if_cast", "orders", "SELECT o_orderkey, IF o_totalprice > 200000 THEN 'big' ELSE IF o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, <string> o_custkey AS c, o_orderstatus ?? 'none' AS s FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, o_custkey::VARCHAR AS c, coalesce(o_orderstatus, 'none') AS s FROM orders")
text("fn_user", "orders", "DEFINE FUNCTION fn::net($a: number) { RETURN $a * 0.5 }; SELECT o_orderkey, fn::net(o_totalprice) AS net FROM orders", "SELECT o_orderkey, o_totalprice * 0.5::DOUBLE AS net FROM orders")
text("where_operators", "customer", "SELECT c_custkey FROM customer WHERE c_name CONTAINS '7' AND !(c_acctbal < 0) AND c_mktsegment NOT IN ['BUILDING'] AND c_nationkey IS NOT NULL", "SELECT c_custkey FROM customer WHERE contains(c_name, '7') AND NOT (c_acctbal < 0) AND c_mktsegment NOT IN ('BUILDING') AND c_nationkey IS NOT NULL")


text("graph_both", "orders lineitem part", "SELECT p_partkey, <->lineitem AS found FROM part", "SELECT p_partkey, l_orderkey || ':' || l_linenumber AS x FROM part JOIN lineitem ON p_partkey = l_partkey", ("p_partkey", "x"), "found")
text("graph_wrong_end", "orders lineitem part nation", "SELECT n_nationkey, ->lineitem AS a, <-lineitem<-orders.o_orderkey AS b FROM nation", "SELECT n_nationkey, 0 AS a, 0 AS b FROM nation", ("n_nationkey", "size(a) a", "size(b) b"))
text("graph_wildcard", "orders lineitem part", "SELECT o_orderkey, ->?->part AS parts FROM orders", "SELECT o_orderkey, l_partkey AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey", ("o_orderkey", "x"), "parts")
text("graph_filtered", "orders lineitem part", "SELECT o_orderkey, ->lineitem->part.p_name AS names FROM orders WHERE o_totalprice > 300000 AND array::len(->lineitem) > 2", "SELECT o_orderkey, p_name AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_totalprice > 300000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 2)", ("o_orderkey", "x"), "names")
text("fetch_omit", "orders customer", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000 FETCH o_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000", ("o_orderkey", "o_custkey.c_name"))
text("select_value_fetch", "orders customer", "SELECT VALUE o_custkey FROM orders WHERE o_totalprice > 300000 FETCH o_custkey", "SELECT c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000", ("o_custkey.c_custkey", "o_custkey.c_name"))
text("select_nested_path", "customer", "SELECT p.q.c_name AS a, p.q.z AS z FROM (SELECT { q: { c_name: c_name, z: c_acctbal } } AS p FROM customer)", "SELECT c_name AS a, c_acctbal AS z FROM customer")
text("select_field_all", "customer", "SELECT p.* FROM (SELECT { c_name: c_name, c_acctbal: c_acctbal } AS p FROM customer)", "SELECT c_name, c_acctbal FROM customer", ("p.*",))
text("select_array_source", "region", "SELECT VALUE value * 2 FROM [1, 2, 3]", "SELECT unnest([2, 4, 6]) AS value")
text("value_statement", "region", "RETURN 1 + 2 * 3", "SELECT 7 AS value")
text("update_return_before", "nation", "UPDATE nation SET n_name = 'x' WHERE n_regionkey = 2 RETURN BEFORE", "SELECT * FROM nation WHERE n_regionkey = 2")
text("update_return_after", "nation", "UPDATE nation SET n_name = 'x' WHERE n_regionkey = 2 RETURN AFTER", "SELECT n_nationkey, 'x' AS n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
text("update_return_fields", "nation", "UPDATE nation SET n_name = 'x' WHERE n_regionkey = 2 RETURN n_nationkey, string::concat(n_name, '!') AS loud", "SELECT n_nationkey, 'x!' AS loud FROM nation WHERE n_regionkey = 2")
text("update_return_diff", "nation", "UPDATE nation SET n_name = 'CHINA', n_regionkey += 1 WHERE n_regionkey = 2 RETURN DIFF", "SELECT CASE WHEN n_name <> 'CHINA' THEN 'replace /n_name \"CHINA\" | ' ELSE '' END || 'replace /n_regionkey 3' AS d FROM nation WHERE n_regionkey = 2", ("array_join(transform(diff, x -> concat_ws(' ', x.op, x.path, x.value)), ' | ') d",))
text("delete_return_before", "nation", "DELETE nation WHERE n_regionkey = 1 RETURN BEFORE", "SELECT * FROM nation WHERE n_regionkey = 1")
text("insert_subquery", "region nation", "INSERT INTO region (SELECT n_nationkey + 10 AS r_regionkey, n_name AS r_name FROM nation); SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT n_nationkey + 10, n_name FROM nation")
text("insert_update", "region", "INSERT INTO region [{ r_regionkey: 0, r_name: 'x' }, { r_regionkey: 8, r_name: 'b' }] ON DUPLICATE KEY UPDATE r_name = 'seen'; SELECT * FROM region", "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'seen' ELSE r_name END AS r_name FROM region UNION ALL SELECT 8, 'b'")
text("group_product", "lineitem", "SELECT k, math::product(v) AS p FROM (SELECT l_orderkey AS k, l_linenumber - 3 AS v FROM lineitem WHERE l_quantity > 25) GROUP BY k", "SELECT l_orderkey AS k, round(product(l_linenumber - 3), 4) + 0 AS p FROM lineitem WHERE l_quantity > 25 GROUP BY 1", ("k", "round(p, 4) + 0D p"))
text("group_ranks", "lineitem", "SELECT l_returnflag, math::nearestrank(l_quantity, 0.9) AS r, math::top(l_quantity, 2) AS t, math::bottom(l_quantity, 2) AS b, math::interquartile(l_quantity) AS i FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_disc(l_quantity, 0.9) AS r, max(l_quantity, 2)[2] AS t, min(l_quantity, 2)[2] AS b, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS i FROM lineitem GROUP BY 1", ("l_returnflag", "r", "t[1] t", "b[1] b", "i"))
text("group_times", "events", "SELECT event_type, time::max(ts) AS last, time::min(ts) AS first FROM events GROUP BY event_type", "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first FROM events GROUP BY 1", ("event_type", "date_format(last, 'yyyy-MM-dd HH:mm:ss.SSSSSS') last", "date_format(first, 'yyyy-MM-dd HH:mm:ss.SSSSSS') first"))


def _query(f):
    QUERIES[f.__name__.strip("_")] = f
    return f


@_query
def topk_group(spark, sf_dir):
    """The two dearest orders of each customer; Spark limits each group before the shuffle."""
    engine = load_model(spark, sf_dir, ("orders",))
    from pyspark.sql import Window

    df = engine.query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return df.withColumn("rank", rank).where("rank <= 2")


ORACLES["topk_group"] = "SELECT o_custkey, o_orderkey, o_totalprice, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2"


@_query
def fetch_array(spark, sf_dir):
    """Orders of each customer as an array of links, fetched."""
    engine = load_model(spark, sf_dir, ("orders", "customer"))
    lists = engine.query("SELECT o_custkey AS id, o_orderkey AS links FROM orders GROUP BY id")
    from graphloom.kinds import array, record

    engine.register("baskets", lists.withColumn("links", F.array_sort("links")), "id", kinds={"links": array(record("orders"))})
    df = engine.query("SELECT id, links FROM baskets FETCH links")
    return df.select(F.col("id").alias("who"), F.posexplode("links").alias("pos", "o")).select("who", "pos", "o.o_orderkey", "o.o_totalprice")


ORACLES["fetch_array"] = "SELECT o_custkey AS who, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS pos, o_orderkey, o_totalprice FROM orders"


@_query
def relate_bulk(spark, sf_dir):
    """Customers and their nations as edges."""
    from graphloom.operators.writes import relate

    pairs = load_model(spark, sf_dir, ("customer",)).query("SELECT c_custkey, c_nationkey FROM customer")
    return relate(pairs, "c_custkey", "c_nationkey", unique=True).withColumnsRenamed({"in": "src", "out": "dst"})


ORACLES["relate_bulk"] = "SELECT DISTINCT c_custkey AS src, c_nationkey AS dst FROM customer"


@_query
def tumbling_hours(spark, sf_dir):
    df = load_model(spark, sf_dir, ("events",)).catalog.source("events").df
    out = tumbling(df, "ts", "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), by=("event_type",))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


ORACLES["tumbling_hours"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@_query
def search_bm25(spark, sf_dir):
    docs = load_model(spark, sf_dir, ("documents",)).catalog.source("documents").df
    return search.bm25(docs, "doc_id", "text", "license software").select("doc_id", F.round("score", 5).alias("score"))


ORACLES["search_bm25"] = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM documents),
c AS (SELECT doc_id, len(w) n, len(list_filter(w, lambda x: x = 'license')) a, len(list_filter(w, lambda x: x = 'software')) b FROM t),
s AS (SELECT count(*) d, avg(n) m, count_if(a > 0) da, count_if(b > 0) db FROM c)
SELECT doc_id, round(ln(1 + (d - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (d - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 5) AS score
FROM c, s WHERE a > 0 OR b > 0"""


@_query
def json_props(spark, sf_dir):
    """The shape and a member of the JSON of events."""
    df = load_model(spark, sf_dir, ("events",)).catalog.source("events").df
    v = F.try_parse_json("props")
    return df.select("event_id", F.schema_of_variant(v).startswith("OBJECT").alias("is_object"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


ORACLES["json_props"] = "SELECT event_id, json_type(props) = 'OBJECT' AS is_object, (props->>'k')::BIGINT AS k FROM events"
