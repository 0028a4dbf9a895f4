"""Registered queries on document intake: types, fields, imports, tiles, settings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import detection, documents, imports
from sluice.plans.catalog import query
from sluice.sources.tables import table

_TYPES = (
    documents.DocType("english", 2, ("th", "of", "an"), ("\\|",)),
    documents.DocType("german", 2, ("der", "die", "ein"), ("\\|",)),
    documents.DocType("opening", 1, ("the ", "The "), heading_lines=5),
    documents.DocType("late", 1, ("el ",), heading_lines=40),
    documents.DocType("general", 9, (".",), fallback=True),
)
_LINE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^[\\s>]*#{1,6}\\s*', ''), '^[\\s>*+-]+', ''), '[*_`]', '', 'g'), '^\\s*\\|\\s*', ''), '\\s*\\|\\s*$', ''), '[\\s\\x{a0}]+', ' ', 'g'))"
_ZONE = f"""z AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: {_LINE}), lambda x: x <> '') AS zone FROM documents WHERE text IS NOT NULL)"""


def _headings(pattern: str, t: documents.DocType) -> str:
    return f"list_filter(range(1, least({max(20, t.heading_lines)}, len(zone)) + 1), lambda i: regexp_matches(zone[i], '(?i)^(?:{pattern}).{{0,80}}$') AND (i = 1 OR NOT ends_with(zone[i - 1], ':')))"


def _hit(rank: int, t: documents.DocType) -> str:
    at = f"coalesce({', '.join(f'{_headings(a, t)}[1]' for a in t.anchors)})"
    no = "".join(f" AND len({_headings(n, t)}) = 0" for n in t.negatives)
    return f"SELECT doc_id, '{t.code}' AS code, {t.priority} AS priority, {rank} AS rank, {at} - 1 AS line_index FROM z WHERE {at} IS NOT NULL{no}"


_MATCHED = f"{_ZONE}, m AS ({' UNION ALL '.join(_hit(i, t) for i, t in enumerate(_TYPES) if not t.fallback)})"


@query(f"WITH {_MATCHED} SELECT doc_id, code, priority, line_index FROM m")
def type_matches(spark, d):
    return documents.match_types(table(spark, d, "documents"), "doc_id", "text", _TYPES).select("doc_id", "code", "priority", "line_index")


@query(f"""WITH {_MATCHED}, t AS (SELECT *, max(priority) OVER (PARTITION BY doc_id) AS top FROM m)
  SELECT doc_id, arg_min(code, (-priority, rank)) AS code, CASE WHEN count(*) FILTER (priority = top) = 1 THEN 'resolved' ELSE 'ambiguous' END AS state,
  array_to_string(list(code ORDER BY -priority, rank)[2:], ',') AS alternatives FROM t GROUP BY 1""")
def type_resolution(spark, d):
    found = documents.resolve_types(documents.match_types(table(spark, d, "documents"), "doc_id", "text", _TYPES), "doc_id")
    return found.withColumn("alternatives", F.array_join("alternatives", ","))


_MARKDOWN = "'Intro ' || o_orderkey || chr(10) || '| a | b |' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '| --- | :-: |' || chr(10) ELSE '' END || repeat('| x | ' || o_custkey || ' |' || chr(10), (o_orderkey % 4)::INT) || 'end' || chr(10) || '| c |'"


@query("""SELECT o_orderkey, 1 AS start, 1 + (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + o_orderkey % 4 AS n_lines, 2 AS n_columns, o_orderkey % 2 = 0 AS has_header,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 ELSE 1 + o_orderkey % 4 END AS n_rows FROM orders
  UNION ALL SELECT o_orderkey, 3 + (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + o_orderkey % 4, 1, 1, false, 1 FROM orders""")
def markdown_tables(spark, d):
    md = F.expr(_MARKDOWN.replace("(o_orderkey % 4)::INT", "cast(o_orderkey % 4 as int)"))
    return documents.table_runs(table(spark, d, "orders").select("o_orderkey", md.alias("md")), "o_orderkey", "md")


@query("""SELECT o_orderkey, 0 AS page_index, 1 AS ordinal, 'text' AS kind, 'b' || o_custkey AS block_id, 'status ' || o_orderstatus || chr(10) || o_orderpriority AS body FROM orders
  UNION ALL SELECT o_orderkey, 1, 2, 'stamp', 's' || o_orderkey, 'seal' FROM orders WHERE o_orderkey % 3 = 0""")
def export_blocks(spark, d):
    text = F.expr("""'# Title' || chr(10) || '## Page 1' || chr(10) || '### BLOCK #1 [TEXT]: b' || o_custkey || chr(10) || 'status ' || o_orderstatus || chr(10) || o_orderpriority || chr(10)
      || CASE WHEN o_orderkey % 3 = 0 THEN '## Page 2' || chr(10) || '### BLOCK #2 [STAMP]: s' || o_orderkey || chr(10) || 'seal' ELSE '' END""")
    return documents.export_blocks(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query("""WITH h AS (SELECT conv_id, turn, 'heading' AS code, CASE WHEN regexp_matches(text, '^([a-z]+ion)') THEN regexp_extract(text, '^([a-z]+ion)', 1) ELSE regexp_extract(text, '([a-z]+ing)', 1) END AS value,
  CASE WHEN regexp_matches(text, '^([a-z]+ion)') THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM conversations WHERE regexp_matches(text, '^([a-z]+ion)|([a-z]+ing)')
  UNION ALL SELECT conv_id, turn, 'number', regexp_extract(text, '([0-9]+)', 1), 0.35::DOUBLE FROM conversations WHERE regexp_matches(text, '([0-9]+)')), p AS (SELECT DISTINCT * FROM h)
  SELECT conv_id, code, value, confidence, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, code ORDER BY confidence DESC, turn, value) r FROM p) WHERE r = 1""")
def best_fields(spark, d):
    fields = [documents.Field("heading", (("^([a-z]+ion)", 0.9), ("([a-z]+ing)", 0.8))), documents.Field("number", (("([0-9]+)", 0.35),))]
    return documents.extract_fields(table(spark, d, "conversations"), "conv_id", "turn", "text", fields)


@query("""WITH r AS (SELECT c_custkey AS row_no, 'N' || (c_custkey % 700) AS k, c_acctbal < 0 AS negative, c_nationkey % 5 = 0 AS banned FROM customer),
  s AS (SELECT *, NOT negative AND NOT banned AS sound FROM r), f AS (SELECT k, min(row_no) AS first FROM s WHERE sound GROUP BY 1)
  SELECT row_no, array_to_string(list_filter([CASE WHEN negative THEN 'negative' END, CASE WHEN banned THEN 'banned' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN NOT sound THEN 'error' WHEN row_no > first THEN 'duplicate_in_file' WHEN EXISTS (SELECT 1 FROM supplier WHERE 'N' || s_suppkey = s.k) THEN 'duplicate_in_catalog' ELSE 'create' END AS verdict FROM s LEFT JOIN f USING (k)""")
def import_verdicts(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_no"), F.concat(F.lit("N"), F.col("c_custkey") % 700).alias("k"), "c_acctbal", "c_nationkey")
    known = table(spark, d, "supplier").select(F.concat(F.lit("N"), F.col("s_suppkey")).alias("k"))
    out = imports.import_verdicts(rows, known, "k", "row_no", {"negative": F.col("c_acctbal") < 0, "banned": F.col("c_nationkey") % 5 == 0})
    return out.select("row_no", F.array_join("reasons", ",").alias("reasons"), "verdict")


@query("""WITH o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'returned' ELSE 'draft' END AS status, CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS day, o_orderkey % 8 <> 0 AS named, o_orderkey % 9 = 0 AS held FROM orders)
  SELECT k AS o_orderkey, CASE WHEN status <> 'draft' AND named THEN day + INTERVAL 900 DAY END AS due, NOT held AND status <> 'draft' AND named AND day IS NOT NULL AND day + INTERVAL 900 DAY <= TIMESTAMP '1999-01-01' AS deletable,
  array_to_string(list_filter([CASE WHEN held THEN 'legal_hold' END, CASE WHEN status = 'draft' OR NOT named THEN 'decision_pending' END, CASE WHEN status <> 'draft' AND named AND day IS NULL THEN 'invalid_decision_date' END,
    CASE WHEN status <> 'draft' AND named AND day + INTERVAL 900 DAY > TIMESTAMP '1999-01-01' THEN 'retention_not_expired' END], lambda x: x IS NOT NULL), ',') AS blocks FROM o""")
def retention_decisions(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(s == "F", "approved").when(s == "O", "returned").otherwise("draft")
    decided = F.when(k % 8 == 0, None).when(k % 7 != 0, F.col("o_orderdate").cast("string")).otherwise("вчера")
    r = imports.retention(status, decided, (k % 9 == 0).cast("int"), 900, F.lit("1999-01-01").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.due").cast("timestamp_ntz").alias("due"), "r.deletable", F.array_join("r.blocks", ",").alias("blocks"))


@query("""SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AS whole FROM lineitem GROUP BY 1""")
def contiguous_groups(spark, d):
    return imports.contiguous(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, sha256('v1' || chr(10) || string_agg(l_linenumber || '|' || l_returnflag, chr(10) ORDER BY l_linenumber || '|' || l_returnflag)) AS digest FROM lineitem GROUP BY 1""")
def bundle_digest(spark, d):
    return imports.canonical_hash(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_returnflag"])


@query("""SELECT event_type, le, (SELECT count(*) FROM events x WHERE x.event_type = t.event_type AND value <= le) AS n FROM (SELECT DISTINCT event_type FROM events) t, (VALUES (10.0::DOUBLE), (50.0), (250.0)) b(le)""")
def value_histogram(spark, d):
    return imports.histogram(table(spark, d, "events"), "event_type", "value", [10, 50, 250])


@query("""WITH w AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS parent_id FROM events)
  SELECT parent_id, event_id, CASE WHEN value > 50 THEN 'protocol' ELSE 'annex' END AS link FROM w WHERE parent_id IS NOT NULL AND event_type <> 'purchase'""")
def graph_links(spark, d):
    return imports.linked_children(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase", "event_id", F.when(F.col("value") > 50, "protocol").otherwise("annex"))


@query("""SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 3 = 0 THEN ['c', 'x'] ELSE ['a', 'b', 'c'] END, ',') AS roles, 1 + p_size % 2 AS limit_a,
  CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 7 END AS limit_b, CASE WHEN p_partkey % 3 = 0 THEN 'R1' ELSE 'R1,R2' END AS codes FROM part""")
def effective_settings(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("int")
    base = p.select("p_partkey", F.array(*map(F.lit, "abc")).alias("roles"), F.create_map(F.lit("a"), 1 + size % 2, F.lit("b"), F.lit(7)).alias("limits"), F.array(F.lit("R1"), F.lit("R2")).alias("codes"))
    over = p.where("p_partkey % 3 = 0").select("p_partkey", F.array(F.lit("c"), F.lit("x")).alias("roles"), F.create_map(F.lit("b"), size).alias("limits"), F.array(F.lit("R2")).alias("off"))
    out = imports.effective_settings(base, [over], "p_partkey", ["roles"], ["limits"], "off", "codes")
    return out.select("p_partkey", F.array_join("roles", ",").alias("roles"), F.col("limits")["a"].alias("limit_a"), F.col("limits")["b"].alias("limit_b"), F.array_join("codes", ",").alias("codes"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
  s AS (SELECT vec_id, i AS index, v AS score, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rank FROM e) SELECT vec_id, rank, index, score FROM s WHERE rank <= 5""")
def tile_top_scores(spark, d):
    return detection.top_scores(table(spark, d, "embeddings"), "vec_id", F.col("embedding"), 5)


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, max(v) AS top FROM e GROUP BY 1)
  SELECT vec_id, round(1 / sum(exp(v - top)), 9) AS largest FROM e JOIN m USING (vec_id) GROUP BY 1""")
def class_probabilities(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(detection.softmax(F.col("embedding"))), 9).alias("largest"))


@query("""WITH p AS (SELECT p_partkey AS page, 600 + p_size * 40 AS w0, 500 + p_size * 30 AS h0 FROM part),
  xs AS (SELECT DISTINCT page, w0, h0, x FROM (SELECT page, w0, h0, unnest(range(0, greatest(w0 - 640, 0) + 1, 560)) AS x FROM p UNION ALL SELECT page, w0, h0, greatest(w0 - 640, 0) FROM p)),
  ys AS (SELECT DISTINCT page, w0, h0, x, y FROM (SELECT page, w0, h0, x, unnest(range(0, greatest(h0 - 640, 0) + 1, 560)) AS y FROM xs UNION ALL SELECT page, w0, h0, x, greatest(h0 - 640, 0) FROM xs))
  SELECT page, x, y, least(640, w0) AS w, least(640, h0) AS h FROM ys""")
def tile_plan(spark, d):
    size = F.col("p_size").cast("int")
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("page"), (600 + size * 40).alias("w0"), (500 + size * 30).alias("h0"))
    return detection.plan_tiles(pages, "page", "w0", "h0", 640, 80)
