"""Registered relational queries: joins, grouped summaries, dated filters, set checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.operators import matching, relational as rel
from sluice.plans.catalog import query
from sluice.sources.tables import table


@query("""SELECT c_custkey, (SELECT coalesce(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus), '') FROM orders WHERE o_custkey = c_custkey) AS statuses,
  (SELECT coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS priorities,
  n_name AS nation, (SELECT coalesce(bool_or(o_totalprice > 400000), false) FROM orders WHERE o_custkey = c_custkey) AS large FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def customer_sets(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))  # 25 nations
    out = rel.with_sets(c, "c_custkey", statuses=(o, "o_orderstatus"), priorities=(o.where("o_totalprice > 200000"), "o_orderpriority"))
    large = o.groupBy("c_custkey").agg(F.bool_or(F.col("o_totalprice") > 400000).alias("large"))
    out = out.join(large, "c_custkey", "left")
    return out.select("c_custkey", F.array_join("statuses", ",").alias("statuses"), F.array_join("priorities", ",").alias("priorities"), "nation", F.coalesce("large", F.lit(False)).alias("large"))


@query("""SELECT o_orderkey, l_linenumber, s_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = 3 WHERE o_orderpriority = '1-URGENT'""")
def urgent_lines(spark, d):
    s = table(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    j = o.join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey").join(s, "l_suppkey", "left")
    return j.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "s_name")


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_shipdate FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_tax > 0.04""")
def composite_key_join(spark, d):
    l = table(spark, d, "lineitem")
    back = l.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").distinct()
    return l.where("l_tax > 0.04").select("l_orderkey", "l_linenumber", "l_shipdate").join(back, ["l_orderkey", "l_linenumber"])


@query("""SELECT cur.o_orderkey, cur.o_orderstatus AS status, prev.o_orderstatus AS before, prev.o_orderstatus IS NOT NULL AND prev.o_orderstatus <> cur.o_orderstatus AS changed
  FROM orders cur LEFT JOIN orders prev ON prev.o_orderkey = cur.o_orderkey - 1 AND prev.o_custkey % 2 = 0""")
def previous_state(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_custkey")
    prev = o.where("o_custkey % 2 = 0").select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("status").alias("before"))
    j = o.join(prev, "o_orderkey", "left")
    return j.select("o_orderkey", "status", "before", (F.col("before").isNotNull() & (F.col("before") != F.col("status"))).alias("changed"))


@query("""SELECT n_nationkey, coalesce(n, 0) AS customers, coalesce(balance, -1) AS balance FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) ON c_nationkey = n_nationkey""")
def nations_with_defaults(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return table(spark, d, "nation").select("n_nationkey").join(c, "n_nationkey", "left").na.fill({"customers": 0, "balance": -1.0})


_PLACED = """SELECT l_orderkey AS page, l_linenumber AS id, l_partkey % 4 AS x, l_suppkey % 3 AS y, l_orderkey % 2 AS side FROM lineitem"""


@query(f"""WITH b AS ({_PLACED}), l AS (SELECT *, row_number() OVER (PARTITION BY page, x, y ORDER BY id) r FROM b), m AS (SELECT *, row_number() OVER (PARTITION BY page, x, y ORDER BY id) r FROM b WHERE id % 2 = 0)
  SELECT coalesce(l.page, m.page) AS page, l.id AS left_id, m.id AS right_id FROM l FULL JOIN m ON l.page = m.page AND l.x = m.x AND l.y = m.y AND l.r = m.r""")
def positional_blocks(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 4).cast("double").alias("x"), (F.col("l_suppkey") % 3).cast("double").alias("y"))
    return rel.positional_match(b, b.where("id % 2 = 0"), "page", ["x", "y"], "id")


@query("""SELECT s_suppkey, r_name FROM supplier JOIN region ON contains(s_name, lower(substr(r_name, 1, 1))) OR contains(lower(substr(r_name, 1, 1)), s_name)""")
def substring_names(spark, d):
    r = table(spark, d, "region").select("r_name", F.lower(F.substring("r_name", 1, 1)).alias("part"))
    return rel.named_either_way(table(spark, d, "supplier").select("s_suppkey", "s_name"), r, "s_name", "part").select("s_suppkey", "r_name")


@query("""SELECT o_orderpriority, coalesce(sum(CASE WHEN o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01' THEN o_totalprice::DECIMAL(12,2) END), 0)::DECIMAL(22,2) AS spent, count(*) AS calls FROM orders GROUP BY 1""")
def monthly_spend(spark, d):
    month = rel.in_month("o_orderdate", F.lit("1996-02-17").cast("timestamp_ntz"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.coalesce(F.sum(F.when(month, F.col("o_totalprice").cast("decimal(12,2)"))), F.lit(0)).cast("decimal(22,2)").alias("spent"), F.count("*").alias("calls"))


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT coalesce(sum(l_quantity), 0) FROM lineitem WHERE l_returnflag = 'R') AS returned,
  (SELECT max(ts) FROM events) AS last_event""")
def overall_summary(spark, d):
    one = [
        table(spark, d, "customer").agg(F.count("*").alias("customers")), table(spark, d, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("open_orders")),
        table(spark, d, "lineitem").where("l_returnflag = 'R'").agg(F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("returned")), table(spark, d, "events").agg(F.max("ts").alias("last_event")),
    ]
    out = one[0]
    for x in one[1:]:  # one row each
        out = out.crossJoin(x)
    return out


@query("""SELECT l_partkey, count(*) AS n, CASE WHEN count(*) > 0 THEN floor(sum(l_quantity) / count(*) + 0.5)::BIGINT ELSE 0 END AS mean FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 200""")
def busiest_parts(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.floor(F.sum("l_quantity") / F.count("*") + 0.5).alias("mean"))
    return g.orderBy(F.desc("n"), "l_partkey").limit(200)


@query("""WITH s(event_type, stage, place) AS (VALUES ('view', 'intake', 1), ('click', 'intake', 1), ('purchase', 'check', 2)), j AS (SELECT coalesce(stage, 'other') AS stage, coalesce(place, 3) AS place, value FROM events e LEFT JOIN s ON e.event_type = s.event_type)
  SELECT stage, max(place) AS place, count(*) AS n, max(value) AS most FROM j GROUP BY 1""")
def stage_rollup(spark, d):
    stage = F.when(F.col("event_type").isin("view", "click"), "intake").when(F.col("event_type") == "purchase", "check").otherwise("other")
    place = F.when(F.col("stage") == "intake", 1).when(F.col("stage") == "check", 2).otherwise(3)
    return table(spark, d, "events").withColumn("stage", stage).groupBy("stage").agg(F.max(place).alias("place"), F.count("*").alias("n"), F.max("value").alias("most"))


@query("""SELECT n_nationkey, source, n FROM (SELECT c_nationkey AS n_nationkey, 'customer' AS source, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier GROUP BY 1) WHERE n_nationkey % 2 = 0""")
def nation_references(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0")
    return rel.reference_counts(n, "n_nationkey", customer=table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), supplier=table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"))


@query("""SELECT event_type, count(*) FILTER (WHERE regexp_matches(json_extract_string(props, '$.k'), '^-?\\d+(\\.\\d+)?$') AND json_extract_string(props, '$.k')::DOUBLE >= 50) AS high, count(*) FILTER (WHERE json_extract_string(props, '$.none') IS NULL) AS without FROM events GROUP BY 1""")
def json_predicates(spark, d):
    k = rel.safe_number(F.get_json_object("props", "$.k"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(k >= 50).alias("high"), F.count_if(F.get_json_object("props", "$.none").isNull()).alias("without"))


@query("""SELECT o_custkey FROM orders GROUP BY 1 HAVING list_has_all(['F', 'O'], list(DISTINCT o_orderstatus))""")
def contained_statuses(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return g.where(F.size(F.array_except("s", F.array(F.lit("F"), F.lit("O")))) == 0).select("o_custkey")


@query("""SELECT k, 'missing' AS side FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 48 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL
  SELECT k, 'unknown' FROM (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 48)""")
def registry_difference(spark, d):
    return rel.differences(table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("k")), table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), "k")


@query("""SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'""")
def distinct_pairs(spark, d):
    return table(spark, d, "lineitem").where("l_linestatus = 'F'").select("l_suppkey", "l_partkey").dropDuplicates(["l_suppkey", "l_partkey"])


@query("""WITH v AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '  ' || role || ' x' ELSE upper(role) || '  X ' END AS word FROM conversations)
  SELECT conv_id, arg_min(word, turn) AS word, min(turn) AS turn FROM v GROUP BY conv_id, upper(trim(regexp_replace(word, '\\s+', ' ', 'g')))""")
def first_spellings(spark, d):
    word = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), F.col("role"), F.lit(" x"))).otherwise(F.concat(F.upper("role"), F.lit("  X ")))
    return rel.first_spelling(table(spark, d, "conversations").select("conv_id", "turn", word.alias("word")), ["conv_id"], "word", "turn")


@query("""WITH p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT -5), c AS (SELECT k, count(*) n FROM p GROUP BY 1)
  SELECT coalesce(o_orderkey, k) AS k, CASE WHEN o_orderkey IS NULL THEN 'foreign' WHEN n IS NULL THEN 'lost' ELSE 'doubled' END AS fault FROM orders FULL JOIN c ON k = o_orderkey WHERE o_orderkey IS NULL OR n IS NULL OR n > 1""")
def partition_check(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return rel.partition_faults(o, [o.where("k % 3 = 0"), o.where("k % 4 = 1"), spark.createDataFrame([(-5,)], "k long")], "k")


@query("""SELECT user_id, coalesce(latest, TIMESTAMP '1970-01-01') AS latest, n FROM (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-10') AS latest, count(*) AS n FROM events GROUP BY 1) ORDER BY latest DESC NULLS LAST, user_id LIMIT 40""")
def latest_purchases(spark, d):
    sure = F.when((F.col("event_type") == "purchase") & (F.col("ts") <= F.lit("2024-01-10").cast("timestamp_ntz")), F.col("ts"))
    g = table(spark, d, "events").groupBy("user_id").agg(F.max(sure).alias("latest"), F.count("*").alias("n"))
    g = g.orderBy(F.desc_nulls_last("latest"), "user_id").limit(40)
    return g.select("user_id", F.coalesce("latest", F.lit("1970-01-01").cast("timestamp_ntz")).alias("latest"), "n")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'escalated' WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'queued' END AS status,
  greatest(0, epoch_ms(TIMESTAMP '1996-01-01') - epoch_ms(o_orderdate)) AS elapsed, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority FROM orders""")
def order_transitions(spark, d):
    s = F.col("o_orderstatus")
    status = F.when((s == "O") & (F.col("o_totalprice") > 300000), "escalated").when(s == "O", "running").when(s == "F", "done").otherwise("queued")
    elapsed = tx.elapsed_ms(F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"), elapsed.alias("elapsed"), F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("priority"))


@query("""SELECT page, kind, id, row_number() OVER (PARTITION BY page, kind ORDER BY y, x, id) - 1 AS rank FROM (SELECT l_orderkey AS page, l_returnflag AS kind, l_linenumber AS id, l_partkey % 7 AS x, l_suppkey % 5 AS y FROM lineitem)""")
def ranks_in_type(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 7).alias("x"), (F.col("l_suppkey") % 5).alias("y"))
    return rel.renumber(b, ["page", "kind"], ["y", "x", "id"], "rank").select("page", "kind", "id", "rank")


@query("""WITH t AS (SELECT event_type AS k, count(*) AS n, min(event_id) AS s FROM events WHERE event_id < 500 GROUP BY 1), x AS (SELECT 'k' || (event_id % 7) AS k, event_id FROM events UNION ALL SELECT event_type, event_id FROM events WHERE event_id >= 500), g AS (SELECT k, count(*) AS n, min(event_id) AS s FROM x GROUP BY 1)
  SELECT coalesce(t.k, g.k) AS k, coalesce(t.n, 0) + coalesce(g.n, 0) AS n, coalesce(t.s, g.s) AS s, t.n IS NULL AS created FROM t FULL JOIN g ON t.k = g.k""")
def observed_candidates(spark, d):
    e = table(spark, d, "events")
    target = e.where("event_id < 500").groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("s"))
    new = e.select(F.concat(F.lit("k"), F.col("event_id") % 7).alias("k"), F.col("event_id").alias("s")).union(e.where("event_id >= 500").select("event_type", "event_id"))
    return rel.counted_upsert(target, new, "k", "n", "s")


@query("""SELECT date_trunc('hour', ts) AS bucket_at, sha256('v1' || chr(10) || event_type) AS fingerprint, 'v' || (event_id % 2) AS release, count(*) AS n, min(event_id) AS sample FROM events GROUP BY ALL""")
def error_rollup(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("bucket_at"), tx.fingerprint(F.col("event_type")).alias("fingerprint"), F.concat(F.lit("v"), F.col("event_id") % 2).alias("release")).agg(F.count("*").alias("n"), F.min("event_id").alias("sample"))


@query("""SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus) AS digest, md5(o_orderpriority) AS short, '{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}' AS body FROM orders""")
def order_digests(spark, d):
    body = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus"), 256).alias("digest"), F.md5(F.col("o_orderpriority").cast("binary")).alias("short"), body.alias("body"))


@query("""WITH p AS (SELECT o_orderpriority AS e, CASE WHEN o_orderkey % 7 = 0 THEN '9-PHANTOM' WHEN o_orderkey % 5 = 0 THEN '5-LOW' ELSE o_orderpriority END AS g FROM orders),
  c AS (SELECT coalesce(a.l, b.l) AS l, coalesce(s, 0) AS s, coalesce(tp, 0) AS tp, coalesce(said, 0) AS said FROM (SELECT e AS l, count(*) s, count(*) FILTER (WHERE e = g) tp FROM p GROUP BY 1) a FULL JOIN (SELECT g AS l, count(*) said FROM p GROUP BY 1) b ON a.l = b.l)
  SELECT round(sum(tp) / sum(s), 9) AS micro_recall, round(sum(tp) / sum(said), 9) AS micro_precision, round(avg(CASE WHEN s > 0 THEN tp / s END), 9) AS macro_recall,
  round(avg(CASE WHEN s >= 3 THEN CASE WHEN tp > 0 THEN 2.0 * tp / (s + said) ELSE 0 END END), 9) AS macro_f1, count(*) FILTER (WHERE s = 0) AS phantom, count(*) FILTER (WHERE s BETWEEN 1 AND 2) AS rare FROM c""")
def classification_summary(spark, d):
    guess = F.when(F.col("o_orderkey") % 7 == 0, "9-PHANTOM").when(F.col("o_orderkey") % 5 == 0, "5-LOW").otherwise(F.col("o_orderpriority"))
    return matching.overall(matching.confusion(table(spark, d, "orders").select(F.col("o_orderpriority").alias("expected"), guess.alias("predicted"))))


@query("""SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%1' AND c_nationkey IS NOT NULL AND regexp_matches(lpad(c_custkey::VARCHAR, 9, '7'), '^\\d{9}$')""")
def guarded_rows(spark, d):
    c = rel.where_given(table(spark, d, "customer"), prefix=rel.contains_text("c_name", "customer#", prefix=True), nation=rel.tri_state("c_nationkey", False), shape=tx.kpp_ok(F.lpad(F.col("c_custkey").cast("string"), 9, "7")), last=F.col("c_name").endswith("1"))
    return c.select("c_custkey")


@query("""SELECT c_custkey, c_acctbal, CASE WHEN o IS NULL THEN 'none' ELSE 'some' END AS has FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_totalprice > 300000) ON o = c_custkey WHERE o IS NULL""")
def unassigned_customers(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("o")).distinct()
    j = table(spark, d, "customer").join(o, "c_custkey", "left")
    return rel.where_given(j, unassigned=rel.tri_state("o", True)).select("c_custkey", "c_acctbal", F.lit("none").alias("has"))


@query("""WITH f AS (SELECT l_orderkey AS document, 'f' || l_linenumber AS code, l_quantity AS value FROM lineitem)
  SELECT document, max(value) FILTER (WHERE code = 'f1') AS f1, max(value) FILTER (WHERE code = 'f2') AS f2 FROM f GROUP BY 1""")
def facts_by_document(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.concat(F.lit("f"), F.col("l_linenumber")).alias("code"), F.col("l_quantity").alias("value"))
    return f.groupBy("document").pivot("code", ["f1", "f2"]).agg(F.max("value"))


@query("""SELECT user_id, event_id, ts, lo, hi FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) lo, max(event_id) OVER (PARTITION BY user_id) hi, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r FROM events WHERE event_id > 250) WHERE r <= 10""")
def log_after(spark, d):
    e = table(spark, d, "events").where("event_id > 250")
    ends = e.groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return rel.newest(e, ["user_id"], [F.col("event_id").asc()], 10).join(ends, "user_id").select("user_id", "event_id", "ts", "lo", "hi")


@query("""WITH g AS (SELECT o_orderkey AS ord, 'A-' || (o_orderkey % 300) AS act, 'Работа; ' || (o_orderkey % 70) AS title, CASE WHEN o_orderkey % 4 < 3 THEN 'ООО «Org ' || (o_orderkey % 4) || '»' END AS org FROM orders),
  c AS (SELECT s_suppkey AS work, unnest([CASE WHEN s_suppkey % 2 = 0 THEN 'A-' ELSE 'А-' END || (s_suppkey % 150), 'B-' || s_suppkey]) AS no, 'РАБОТА ' || (s_suppkey % 50) AS title, 'Org ' || (s_suppkey % 3) AS org FROM supplier),
  h AS (SELECT ord, work, 1 AS rung, 1.0 AS score, g.org LIKE '%' || c.org || '%' AS same FROM g JOIN c ON act = no UNION SELECT ord, work, 2, 0.85, g.org LIKE '%' || c.org || '%' FROM g JOIN c ON act = replace(no, 'А', 'A')
    UNION SELECT ord, work, 3, 0.9, g.org LIKE '%' || c.org || '%' FROM g JOIN c ON lower(replace(g.title, '; ', ' ')) = lower(c.title)),
  t AS (SELECT ord, min(rung) AS rung FROM h GROUP BY 1), x AS (SELECT ord, rung, max(score) AS score, count(*) AS n, count(*) FILTER (WHERE same) AS m, min(work) AS one, min(work) FILTER (WHERE same) AS own FROM h JOIN t USING (ord, rung) GROUP BY 1, 2)
  SELECT ord, CASE WHEN n = 1 OR m = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state, CASE WHEN n = 1 THEN score::DOUBLE WHEN m = 1 THEN 0.8::DOUBLE END AS score, CASE WHEN n = 1 THEN one WHEN m = 1 THEN own END AS work FROM g LEFT JOIN x USING (ord)""")
def transfer_groups(spark, d):
    k, one = F.col("o_orderkey"), F.lit(1).alias("doc")
    act = F.concat(F.lit("A-"), k % 300)
    org = F.when(k % 4 < 3, F.concat(F.lit("ООО «Org "), k % 4, F.lit("»")))
    g = table(spark, d, "orders").select(one, k.alias("ord"), tx.doc_no(act).alias("act_norm"), tx.doc_no_folded(act).alias("act_folded"), F.concat(F.lit("Работа; "), k % 70).alias("title"), org.alias("contractor"))
    s = F.col("s_suppkey")
    numbers = F.array(F.concat(F.when(s % 2 == 0, "a-").otherwise("а-"), s % 150), F.concat(F.lit("B-"), s))
    c = table(spark, d, "supplier").select(one, s.alias("work"), F.concat(F.lit("Org "), s % 3).alias("contractor"), F.concat(F.lit("РАБОТА "), s % 50).alias("title"), numbers.alias("numbers"))
    return matching.match_groups(g, c).drop("doc")
