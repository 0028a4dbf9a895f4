"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.operators import geometry, matching, relational as rel
from sluice.sources.tables import table
from sluice.streaming import journal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""SELECT date_trunc('hour', ts) AS bucket_at, event_type, count(*) AS n, sum(value) AS total, max(value) AS largest,
  arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2""")
def journal_hourly_rollup(spark, d):
    return journal.hourly_rollup(table(spark, d, "events"), ["event_type"], "value")


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13)""")
def scope_objects(spark, d):
    return rel.scoped(table(spark, d, "orders"), "engineer", object_keys=[1, 2, 3, 5, 8, 13], obj="o_custkey").select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE false")
def scope_empty(spark, d):
    return rel.scoped(table(spark, d, "orders"), "engineer", object_keys=[], obj="o_custkey").select("o_orderkey")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 500)
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""")
def keyset_page_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return rel.keyset_page(o, ["o_orderdate", "o_orderkey"], ["1997-01-01 00:00:00", 500], 50).select("o_orderkey", "o_orderdate")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%r#000%' AND c_mktsegment = 'BUILDING'""")
def optional_filters(spark, d):
    return rel.where_given(table(spark, d, "customer"), name=rel.contains_text("c_name", "R#000"), segment=F.col("c_mktsegment") == "BUILDING", balance=None).select("c_custkey", "c_name")


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')""")
def anti_join_customers(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')
  OR EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1)""")
def semi_join_any(spark, d):
    c = table(spark, d, "customer")
    urgent = c.join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    region = c.join(table(spark, d, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return urgent.select("c_custkey").union(region.select("c_custkey")).distinct()


@query("""SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders,
  (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O') AS open_orders,
  (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders o WHERE o.o_custkey = c.c_custkey) AS latest FROM customer c""")
def readiness_counts(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    latest = o.groupBy("c_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    out = rel.with_counts(table(spark, d, "customer").select("c_custkey"), "c_custkey", orders=o, open_orders=o.where("o_orderstatus = 'O'"))
    return out.join(latest, "c_custkey", "left")


@query("""SELECT n_name, o_orderpriority, count(DISTINCT o_orderkey) AS orders, sum(l_extendedprice * (1 - l_discount)) AS revenue
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def star_join_revenue(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count_distinct("o_orderkey").alias("orders"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low,
  min(value) AS least, max(value) AS most, arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS last_value,
  quantile_cont(value, 0.5) AS median FROM events GROUP BY 1""")
def job_summary(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(v > 50).alias("high"), F.count_if(v <= 50).alias("low"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.max_by(v, F.when(v.isNotNull(), F.struct("ts", "event_id"))).alias("last_value"), F.percentile(v, 0.5).alias("median"),
    )


@query("""WITH calls AS (SELECT l_returnflag AS k, count(*) AS calls FROM lineitem WHERE l_quantity > 10 GROUP BY 1),
  bad AS (SELECT l_returnflag AS k, count(*) AS defects FROM lineitem WHERE l_discount >= 0.08 GROUP BY 1)
  SELECT b.k, defects, calls, CASE WHEN calls > 0 THEN defects / calls::DOUBLE END AS rate FROM bad b LEFT JOIN calls c ON b.k IS NOT DISTINCT FROM c.k""")
def defect_rate(spark, d):
    l = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "k")
    calls = l.where("l_quantity > 10").groupBy(F.col("k").alias("k2")).agg(F.count("*").alias("calls"))
    bad = l.where("l_discount >= 0.08").groupBy("k").agg(F.count("*").alias("defects"))
    return bad.join(calls, F.col("k").eqNullSafe(F.col("k2")), "left").select("k", "defects", "calls", F.when(F.col("calls") > 0, F.col("defects") / F.col("calls")).alias("rate"))


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 3""")
def newest_per_user(spark, d):
    return rel.newest(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id", "ts")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) - 1 AS position FROM lineitem""")
def renumbered_lines(spark, d):
    return rel.renumber(table(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber"]).select("l_orderkey", "l_linenumber", "position")


@query("""WITH kept AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 15), span AS (SELECT l_orderkey, min(l_linenumber) lo, max(l_linenumber) hi FROM kept GROUP BY 1)
  SELECT l_orderkey, p::INT AS l_linenumber FROM (SELECT l_orderkey, unnest(range(lo, hi + 1)) AS p FROM span) s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.l_orderkey = s.l_orderkey AND k.l_linenumber = p)""")
def missing_lines(spark, d):
    return rel.missing_positions(table(spark, d, "lineitem").where("l_quantity > 15"), "l_orderkey", "l_linenumber")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS current_act FROM events""")
def carry_forward(spark, d):
    e = table(spark, d, "events")
    return rel.carried_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "current_act").select("event_id", "user_id", "current_act")


@query("""SELECT user_id, event_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS neighbour_mean FROM
  (SELECT *, lag(value) OVER w a, lead(value) OVER w b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def neighbours(spark, d):
    return rel.neighbour_mean(table(spark, d, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", "neighbour_mean")


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey - 1 END AS parent FROM orders),
  chain AS (SELECT node, node AS ancestor, parent AS up, 0 AS depth FROM t UNION ALL SELECT c.node, t.node, t.parent, c.depth + 1 FROM chain c JOIN t ON t.node = c.up)
  SELECT node, ancestor, depth FROM chain""")
def revision_chain(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderkey") - 1).alias("parent"))
    return rel.ancestor_chain(o, "o_orderkey", "parent")


@query("""WITH v AS (SELECT o_custkey AS k, o_orderkey AS version, o_orderdate AS effective_from, o_orderdate + INTERVAL 400 DAY AS effective_to FROM orders)
  SELECT k, version FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY effective_from DESC, version DESC) r FROM v
  WHERE effective_from <= TIMESTAMP '1996-06-01' AND effective_to >= TIMESTAMP '1996-06-01') WHERE r = 1""")
def effective_version(spark, d):
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("effective_from"), (F.col("o_orderdate") + F.expr("INTERVAL 400 DAY")).alias("effective_to"))
    live = rel.effective_on(v, F.lit("1996-06-01").cast("timestamp_ntz"))
    return rel.newest(live, ["k"], [F.col("effective_from").desc(), F.col("version").desc()]).select("k", "version")


@query("""SELECT k, sum(n)::BIGINT AS n, max(m) AS m FROM (SELECT event_type AS k, 1 AS n, value AS m FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, 1, value FROM events WHERE event_id % 2 = 1) GROUP BY 1""")
def upsert_accumulate(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("k"), F.lit(1).cast("long").alias("n"), F.col("value").alias("m"))
    return rel.accumulate(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"), ["k"], sums=["n"], maxima=["m"])


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events
  WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY) WHERE r <= 5""")
def retention_prune(spark, d):
    return journal.pruned(table(spark, d, "events"), "user_id", "ts", "event_id", F.lit("2024-01-31").cast("timestamp_ntz"), 10, 5).select("user_id", "event_id", "ts")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r FROM events),
  w AS (SELECT user_id, event_id, ts, r, ts AS last, true AS keep FROM o WHERE r = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.ts, o.r, CASE WHEN o.ts >= w.last + INTERVAL 86400 SECOND THEN o.ts ELSE w.last END, o.ts >= w.last + INTERVAL 86400 SECOND FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
  SELECT user_id, event_id FROM w WHERE keep""")
def sample_thinning(spark, d):
    return journal.thinned(table(spark, d, "events"), ["user_id"], 86400).select("user_id", "event_id")


@query("""SELECT user_id, before, after FROM (SELECT user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_id AS after FROM events) WHERE after - before > 1""")
def replay_gaps(spark, d):
    return journal.sequence_gaps(table(spark, d, "events"), "user_id", "event_id")


@query(f"""SELECT o_orderkey, translate(regexp_replace(upper('№ ' || o_orderkey || '/а–' || (o_orderkey % 7)), '[–—]', '-', 'g'), ' №', '') AS number,
  translate(translate(regexp_replace(upper('№ ' || o_orderkey || '/а–' || (o_orderkey % 7)), '[–—]', '-', 'g'), ' №', ''), '{tx.NUMBER_FROM}', '{tx.NUMBER_TO}') AS folded FROM orders""")
def document_numbers(spark, d):
    raw = F.concat(F.lit("№ "), F.col("o_orderkey"), F.lit("/а–"), F.col("o_orderkey") % 7)
    return table(spark, d, "orders").select("o_orderkey", tx.doc_no(raw).alias("number"), tx.doc_no_folded(raw).alias("folded"))


_DIGIT = "substr(inn, {i}, 1)::INT"
_SUM10 = " + ".join(f"{w} * {_DIGIT.format(i=i + 1)}" for i, w in enumerate(tx.INN10))


@query(f"""SELECT o_orderkey, ({_SUM10}) % 11 % 10 = substr(inn, 10, 1)::INT AS ok FROM (SELECT o_orderkey, lpad(((o_orderkey * 7919 + 1234567890) % 10000000000)::VARCHAR, 10, '0') AS inn FROM orders)""")
def taxpayer_checksum(spark, d):
    inn = F.lpad(((F.col("o_orderkey") * 7919 + 1234567890) % 10000000000).cast("string"), 10, "0")
    return table(spark, d, "orders").select("o_orderkey", tx.inn_ok(inn).alias("ok"))


@query("""WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'A-' ELSE 'А-' END || (o_orderkey % 5000) AS e, 'A-' || (o_orderkey % 5000) AS f FROM orders),
  ge AS (SELECT e, count(*) n, min(id) id FROM d GROUP BY 1), gf AS (SELECT f, count(*) n, min(id) id FROM d GROUP BY 1)
  SELECT l_orderkey AS row_id, CASE WHEN ge.n = 1 THEN 'matched' WHEN ge.n > 1 THEN 'ambiguous' WHEN gf.n = 1 THEN 'matched' WHEN gf.n > 1 THEN 'ambiguous' ELSE 'missing' END AS state,
  CASE WHEN ge.n = 1 THEN 1.0::DOUBLE WHEN ge.n > 1 THEN NULL WHEN gf.n = 1 THEN 0.85::DOUBLE END AS score, CASE WHEN ge.n = 1 THEN ge.id WHEN ge.n > 1 THEN NULL WHEN gf.n = 1 THEN gf.id END AS document_id
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN ge ON ge.e = 'А-' || (l_orderkey % 9000) LEFT JOIN gf ON gf.f = 'A-' || (l_orderkey % 9000)""")
def match_ladder(spark, d):
    even = F.when(F.col("o_orderkey") % 2 == 0, "a-").otherwise("а-")
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.concat(even, F.col("o_orderkey") % 5000).alias("number"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id")).distinct().withColumn("number", F.concat(F.lit("№ А-"), F.col("row_id") % 9000))
    return matching.match_rows(rows, docs)


@query("""WITH p AS (SELECT o_orderstatus AS expected, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS predicted FROM orders),
  g AS (SELECT expected AS label, count(*) AS support, count(*) FILTER (WHERE expected = predicted) AS tp FROM p GROUP BY 1), s AS (SELECT predicted AS label, count(*) AS said FROM p GROUP BY 1),
  j AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(said, 0) AS said FROM g FULL JOIN s USING (label))
  SELECT label, support, tp, said - tp AS fp, support - tp AS fn, CASE WHEN said > 0 THEN tp / said::DOUBLE END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE END AS recall,
  CASE WHEN said > 0 AND support > 0 AND tp > 0 THEN 2 * (tp / said::DOUBLE) * (tp / support::DOUBLE) / (tp / said::DOUBLE + tp / support::DOUBLE) ELSE 0 END AS f1 FROM j""")
def confusion_metrics(spark, d):
    return matching.confusion(table(spark, d, "orders").select(F.col("o_orderstatus").alias("expected"), F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise(F.col("o_orderstatus")).alias("predicted")))


def _boxes(spark, d):
    l = table(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 80) / 100.0, (F.col("l_suppkey") % 80) / 100.0
    return l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("kind"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity") / 100.0).alias("x1"), (y + F.lit(0.2)).alias("y1"), F.col("l_extendedprice").alias("score"))


_BOXES = """b AS (SELECT l_orderkey AS page, l_linenumber AS id, (l_partkey % 80) / 100.0::DOUBLE AS x0, (l_suppkey % 80) / 100.0::DOUBLE AS y0, (l_partkey % 80) / 100.0::DOUBLE + l_quantity / 100.0::DOUBLE AS x1, (l_suppkey % 80) / 100.0::DOUBLE + 0.2::DOUBLE AS y1 FROM lineitem)"""


@query(f"""WITH {_BOXES}, j AS (SELECT a.page, a.id AS id1, c.id AS id2, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s FROM b a JOIN b c ON a.page = c.page AND a.id < c.id)
  SELECT page, id1, id2, round(i / (s - i), 6) AS iou FROM j WHERE i > 0""")
def box_overlaps(spark, d):
    b = _boxes(spark, d).select("page", "id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    a, c = b.select("page", F.col("id").alias("id1"), F.col("box").alias("a")), b.select("page", F.col("id").alias("id2"), F.col("box").alias("c"))
    j = a.join(c, "page").where("id1 < id2").where(geometry.intersection(F.col("a"), F.col("c")) > 0)
    return j.select("page", "id1", "id2", F.round(geometry.iou(F.col("a"), F.col("c")), 6).alias("iou"))


@query(f"""WITH RECURSIVE {_BOXES.replace(" FROM lineitem", ", l_returnflag AS kind, l_extendedprice AS score FROM lineitem")}, o AS (SELECT b.*, row_number() OVER (PARTITION BY page, kind ORDER BY score DESC, id) AS r FROM b),
  w AS (SELECT page, kind, 1::BIGINT AS r, [r] AS kept FROM o WHERE r = 1 UNION ALL SELECT w.page, w.kind, o.r, CASE WHEN EXISTS (SELECT 1 FROM o k WHERE k.page = o.page AND k.kind = o.kind AND list_contains(w.kept, k.r)
    AND greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0)) >= 0.5 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (o.x1 - o.x0) * (o.y1 - o.y0)
    - greatest(0, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0, least(k.y1, o.y1) - greatest(k.y0, o.y0)))) THEN w.kept ELSE list_append(w.kept, o.r) END
  FROM w JOIN o ON o.page = w.page AND o.kind = w.kind AND o.r = w.r + 1)
  SELECT o.page, o.id, o.kind, o.score FROM (SELECT page, kind, arg_max(kept, r) AS kept FROM w GROUP BY 1, 2) f JOIN o ON o.page = f.page AND o.kind = f.kind AND list_contains(f.kept, o.r)""")
def box_suppression(spark, d):
    return geometry.suppress(_boxes(spark, d), "page", "kind").select("page", "id", "kind", "score")


@query(f"""WITH {_BOXES}, xs AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) xb FROM (SELECT page, x0 AS x FROM b UNION SELECT page, x1 FROM b)),
  ys AS (SELECT page, y, lead(y) OVER (PARTITION BY page ORDER BY y) yb FROM (SELECT page, y0 AS y FROM b UNION SELECT page, y1 FROM b)),
  c AS (SELECT DISTINCT xs.page, x, xb, y, yb FROM xs JOIN ys ON xs.page = ys.page JOIN b ON b.page = xs.page AND x0 <= x AND x1 >= xb AND y0 <= y AND y1 >= yb)
  SELECT page, round(sum((xb - x) * (yb - y)), 6) AS covered FROM c GROUP BY 1""")
def page_coverage(spark, d):
    return geometry.union_area(_boxes(spark, d), "page").select("page", F.round("covered", 6).alias("covered"))


@query("""SELECT 'lineitem.l_orderkey' AS broken, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
  UNION ALL SELECT 'lineitem.quantity', count(*) FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 49)
  UNION ALL SELECT 'lineitem.unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def data_quality(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    named = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("broken"), "n")
    orphan = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    twice = l.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    return named(orphan, "lineitem.l_orderkey").union(named(l.where("NOT (l_quantity BETWEEN 1 AND 49)"), "lineitem.quantity")).union(named(twice, "lineitem.unique"))


@query("""SELECT event_type, sha256('v1' || chr(10) || event_type || chr(10) || regexp_replace('user ' || user_id || ' spent ' || event_id, '[0-9]+', '<n>', 'g')) AS fingerprint, count(*) AS n FROM events GROUP BY 1, 2""")
def error_fingerprints(spark, d):
    message = F.concat(F.lit("user "), F.col("user_id"), F.lit(" spent "), F.col("event_id"))
    return table(spark, d, "events").groupBy("event_type", tx.fingerprint(F.col("event_type"), tx.error_template(message)).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> '' GROUP BY 1""")
def document_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(tx.lines(F.col("text"))).alias("x")).groupBy("doc_id").agg(F.count("*").alias("lines"))


from sluice.plans import answers, checks, intake, layout, ledger, registers, requisites, scalars, segments, states  # noqa: E402,F401
