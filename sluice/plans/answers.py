"""Registered queries on detection and recognition answers, marked values and canonical JSON, over given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.operators import detection, privacy, recognition
from sluice.plans.catalog import query
from sluice.sources.tables import dealt, spread, table, written

# ---------------------------------------------------------------- detection
_NUMBERED = "SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem"
#: the boxes of a page by their number, as shares of their tile: kind, corners, score
_BOXES = {
    1: ("text", 0.1, 0.1, 0.3, 0.15, 0.9), 2: ("image", 0.5, 0.5, 0.7, 0.7, 0.55), 3: ("text", 0.1, 0.8, 0.3, 0.84, 0.7), 4: ("text", 0.31, 0.8, 0.5, 0.84, 0.5),
    5: ("stamp", 0.5, 0.1, 0.6, 0.2, 0.35), 6: ("text", 0.02, 0.02, 0.98, 0.98, 0.95), 7: ("text", 0.2, 0.2, 0.2005, 0.4, 0.8),
}
_TALL = 560 * 40


def _detected(spark, d) -> tuple[DataFrame, DataFrame]:
    """Pages of one tile or several, and their boxes; every third page has its first box twice."""
    #: numbering, pages, verdicts and counts go by page, and stay where the rows are dealt to
    dealt(table(spark, d, "lineitem"), 500_000, "l_orderkey").createOrReplaceTempView("answers_lineitem")
    rows = spark.sql(_NUMBERED.replace("FROM lineitem", "FROM answers_lineitem"))
    n, k = F.col("n"), F.col("page")
    of = lambda i, other: F.coalesce(*[F.when(n == m, F.lit(b[i])) for m, b in _BOXES.items()], F.lit(other))
    again = (n == 2) & (k % 3 == 0)
    corner = lambda i, other, twice: F.when(again, F.lit(twice)).otherwise(of(i, other))
    boxes = rows.select(
        "page", n.alias("id"), corner(0, "text", "text").alias("kind"), F.when(n == 6, 560).otherwise(0).alias("tx"), F.when(n > 7, (n - 7) * 560).otherwise(0).cast("int").alias("ty"), F.lit(640).alias("tw"), F.lit(640).alias("th"),
        corner(1, 0.1, 0.105).alias("x0"), corner(2, 0.1, 0.1).alias("y0"), corner(3, 0.3, 0.3).alias("x1"), corner(4, 0.15, 0.15).alias("y1"), F.when((n == 5) & (k % 2 == 1), 0.25).otherwise(corner(5, 0.45, 0.6)).alias("score"),
    )
    pages = rows.select("page").distinct().select("page", F.lit(2000).alias("width"), F.lit(_TALL).alias("height"), F.when(F.col("page") % 5 == 0, 1).otherwise(2).alias("tiles"))
    return pages, boxes


def _px(n: int) -> str:
    """A box's corners on its page as SQL."""
    kind, x0, y0, x1, y1, score = _BOXES[n]
    off = 560 if n == 6 else 0
    return f"'{kind}' AS kind, round(({x0} * 640 + {off}) / 2000.0, 9)::DOUBLE AS x0, round({y0} * 640 / {_TALL}.0, 9)::DOUBLE AS y0, round(({x1} * 640 + {off}) / 2000.0, 9)::DOUBLE AS x1, round({y1} * 640 / {_TALL}.0, 9)::DOUBLE AS y1, {score}::DOUBLE AS score"


@query(f"""WITH b AS ({_NUMBERED}) SELECT page, {_px(1)} FROM b WHERE n = 1 UNION ALL SELECT page, {_px(2)} FROM b WHERE n = 2 AND page % 3 <> 0
  UNION ALL SELECT page, 'text', round(64 / 2000.0, 9), round(0.8 * 640 / {_TALL}.0, 9), round(CASE WHEN count(*) = 2 THEN 0.5 ELSE 0.3 END * 640 / 2000.0, 9), round(0.84 * 640 / {_TALL}.0, 9), 0.7 FROM b WHERE n IN (3, 4) GROUP BY page
  UNION ALL SELECT page, {_px(5)} FROM b WHERE n = 5 AND page % 2 = 0 UNION ALL SELECT page, {_px(6)} FROM b WHERE n = 6 AND page % 5 = 0
  UNION ALL SELECT page, 'text', round(64 / 2000.0, 9), round((64 + (n - 7) * 560) / {_TALL}.0, 9), round(192 / 2000.0, 9), round((96 + (n - 7) * 560) / {_TALL}.0, 9), 0.45 FROM b WHERE n > 7""")
def detected_pages(spark, d):
    pages, boxes = _detected(spark, d)
    out = detection.detect_pages(pages, boxes, {"text": 0.4, "stamp": 0.3}, 0.5)
    return out.select("page", "kind", *(F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")), "score")


@query(f"""WITH b AS (SELECT *, CASE WHEN n = 2 AND page % 3 <> 0 THEN 'image' WHEN n = 5 THEN 'stamp' ELSE 'text' END AS kind FROM ({_NUMBERED})) SELECT page, kind, count(*) FILTER (NOT (n = 5 AND page % 2 = 1) AND n <> 7 AND NOT (n = 6 AND page % 5 <> 0)) AS raw,
  (count(*) FILTER (n = 6)) AS full_tiles, count(*) FILTER (n = 6 AND page % 5 <> 0) AS rejected_full, count(*) FILTER (n = 7) AS rejected_thin FROM b GROUP BY 1, 2""")
def detection_counts(spark, d):
    return detection.detection_stats(*_detected(spark, d), 0.3)


@query("""WITH e AS (SELECT vec_id, vec_id % 3 AS t, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT vec_id, CASE WHEN t = 0 THEN 200 ELSE (floor(abs(v) * 255) % 256)::INTEGER END AS r, CASE WHEN t = 0 THEN 200 ELSE (floor(abs(v) * 510) % 256)::INTEGER END AS g, CASE WHEN t = 0 THEN 200 ELSE 7 END AS b FROM e),
  s AS (SELECT vec_id, stddev_pop((r * 19595 + g * 38470 + b * 7471 + 32768) // 65536) AS d FROM c GROUP BY 1) SELECT vec_id, round(d, 6) AS deviation, d < 1 AS blank FROM s""")
def blank_tiles(spark, d):
    v, plain = F.abs(F.col("v").cast("double")), F.col("vec_id") % 3 == 0
    shade = lambda x: F.when(plain, 200).otherwise(x).cast("int")
    pixels = table(spark, d, "embeddings").select("vec_id", F.explode("embedding").alias("v")).select("vec_id", shade(F.floor(v * 255) % 256).alias("r"), shade(F.floor(v * 510) % 256).alias("g"), shade(F.lit(7)).alias("b"))
    return detection.blank_tiles(pixels, ["vec_id"]).withColumn("deviation", F.round("deviation", 6))


# ---------------------------------------------------------------- archives
def _archives(spark, d) -> DataFrame:
    """An order is an archive: a text and an image block on page 1, a stamp there and, for every second order, two on
    page 2. Of five orders one has no layout, one a page that the layout doesn't know, one lacks page 2."""
    k = F.col("o_orderkey").cast("string")
    form = F.col("o_orderkey") % 5
    page_1 = F.concat(
        F.lit("# Export\n**Stamp:** Code: D-"), k, F.lit(" | Stage: doc\n## Page 1 \n> **Model:** x\n### BLOCK #1 [TEXT]: t"), k, F.lit("\nline "), k, F.lit("\n\n\n\nend  \n> **Stamp:** Code: S-"), k, F.lit(" | Sheet: 2 | code: last | Note: a:b | Empty: \n"),
        F.lit("### BLOCK #2 [IMAGE]: i"), k, F.lit("\n**[IMAGE]** Type: plan | Zone: "), F.col("o_orderstatus"), F.lit(" | Level:\nlost line\n**Summary:** short\n\nand long\n**Entities:** wall, , "), F.col("o_orderpriority"), F.lit(",door\nafter\n**Verification:**\nseen\n"),
    )
    page_2 = F.concat(F.lit("## Page 2\n> **Stamp:** Object: house\n### BLOCK #3 [TABLE]: t3\n| a |\n"))
    page_9 = F.when(form == 3, "## Page 9\nalien\n> **Stamp:** Code: x").otherwise("")
    layout = F.concat(
        F.lit('{"generated_at":"2024-01-01","pages":[{"page_index":0,"width_px":100,"height_px":200,"rotation":90},{"page_index":1,"width_px":10,"height_px":20,"rotation":0}],"blocks":[{"block_id":"L'), k,
        F.lit('","ordinal":1,"page_index":0,"block_type":"text","coords_norm":[0,0,0.5,1]},{"block_id":null,"ordinal":2,"page_index":0,"block_type":"image","coords_norm":[1,2]},{"block_id":"s1","ordinal":null,"page_index":0,"block_type":"stamp"},{"block_id":"x","ordinal":7,"page_index":0,"block_type":"other"},'),
        F.lit('{"block_id":"p3","ordinal":3,"page_index":1,"block_type":"text"},{"block_id":"s2","ordinal":8,"page_index":1,"block_type":"stamp"},{"block_id":"s3","ordinal":9,"page_index":1,"block_type":"stamp"}]}'),
    )
    return spread(table(spark, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("doc"), F.concat(page_1, F.when(form == 4, "").otherwise(page_2), page_9).alias("markdown"), F.when(form != 0, layout).alias("layout"))


@query("""WITH o AS (SELECT o_orderkey AS doc, o_orderkey % 5 AS form, 'line ' || o_orderkey || chr(10) || chr(10) || 'end' AS a, '**[IMAGE]** Type: plan | Zone: ' || o_orderstatus || ' | Level:' || chr(10) || 'lost line' || chr(10) || '**Summary:** short' || chr(10) || chr(10) || 'and long' || chr(10) || '**Entities:** wall, , ' || o_orderpriority || ',door' || chr(10) || 'after' || chr(10) || '**Verification:**' || chr(10) || 'seen' AS b FROM orders)
  SELECT doc, 0 AS page_index, CASE WHEN form = 0 THEN 0 ELSE 90 END AS rotation, CASE WHEN form > 0 THEN 100 END AS width, CASE WHEN form > 0 THEN 200 END AS height, replace(a, 'end', 'end  ') || chr(10) || b AS text FROM o
  UNION ALL SELECT doc, 1, 0, CASE WHEN form > 0 THEN 10 END, CASE WHEN form > 0 THEN 20 END, CASE WHEN form = 4 THEN '' ELSE '| a |' END FROM o""")
def archive_pages(spark, d):
    return recognition.canonical_pages(_archives(spark, d))["pages"]


@query("""WITH o AS (SELECT o_orderkey AS doc, o_orderkey % 5 AS form, o_orderkey AS k, * FROM orders), none AS (SELECT NULL)
  SELECT doc, 0 AS page_index, 'text' AS kind, CASE WHEN form = 0 THEN 't' || k ELSE 'L' || k END AS block_id, 1 AS ordinal, CASE WHEN form > 0 THEN '0.0,0.0,0.5,1.0' END AS coords, 'line ' || k || chr(10) || chr(10) || 'end' AS text, NULL AS image, NULL AS stamp FROM o
  UNION ALL SELECT doc, 0, 'image', 'i' || k, 2, NULL, NULL, 'plan//' || o_orderstatus || '//short' || chr(10) || 'and long//wall;' || o_orderpriority || ';door/seen', NULL FROM o
  UNION ALL SELECT doc, 1, 'text', CASE WHEN form = 0 THEN 't3' ELSE 'p3' END, 3, NULL, '| a |', NULL, NULL FROM o WHERE form <> 4
  UNION ALL SELECT doc, 0, 'stamp', 's1', NULL, NULL, NULL, NULL, 'last//2//// Note=a:b' FROM o WHERE form > 0
  UNION ALL SELECT doc, 1, 'stamp', 's2', 8, NULL, NULL, NULL, CASE WHEN form = 4 THEN 'D-' || k || '/doc////// ' ELSE '///house/// ' END FROM o WHERE form > 0
  UNION ALL SELECT doc, 1, 'stamp', 's3', 9, NULL, NULL, NULL, CASE WHEN form = 4 THEN '////// ' ELSE 'D-' || k || '/doc///// ' END FROM o WHERE form > 0
  UNION ALL SELECT doc, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM o WHERE false""".replace("/doc////// '", "/doc///// '"))
def archive_blocks(spark, d):
    b = recognition.canonical_pages(_archives(spark, d))["blocks"]
    part = lambda s, names: F.array_join(F.array(*[F.coalesce(F.col(f"{s}.{n}"), F.lit("")) for n in names]), "/")
    image = F.when(F.col("kind") == "image", F.concat_ws("/", part("image", ["image_type", "axes", "zone", "level", "summary", "description"]), F.array_join("image.entities", ";"), F.coalesce("image.verification", F.lit(""))))
    extra = F.array_join(F.transform(F.map_entries(F.col("stamp.extra")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    stamp = F.when(F.col("kind") == "stamp", F.concat_ws(" ", part("stamp", recognition.STAMP_FIELDS), extra))
    return b.select("doc", "page_index", "kind", "block_id", "ordinal", F.array_join(F.col("coords").cast("array<string>"), ",").alias("coords"), "text", image.alias("image"), stamp.alias("stamp"))


@query("""SELECT o_orderkey AS doc, 8 AS page_index, 'page_not_in_layout' AS code, 1 AS n FROM orders WHERE o_orderkey % 5 = 3 UNION ALL SELECT o_orderkey, 8, 'stamp_lines_dropped', 1 FROM orders WHERE o_orderkey % 5 = 3
  UNION ALL SELECT o_orderkey, 1, 'page_missing', 1 FROM orders WHERE o_orderkey % 5 = 4 UNION ALL SELECT o_orderkey, unnest([0, 1]), 'stamp_lines_dropped', 1 FROM orders WHERE o_orderkey % 5 = 0""")
def archive_faults(spark, d):
    return recognition.canonical_pages(_archives(spark, d))["faults"]


# ---------------------------------------------------------------- places and layouts
def _blocks(spark, d, moved: bool) -> DataFrame:
    """A line is a block of its order's page; on the other side every eleventh part has moved and every thirteenth is gone."""
    at = F.col("l_suppkey") % 7 / 10.0
    x1 = at + F.when(F.lit(moved) & (F.col("l_partkey") % 11 == 0), 0.3).otherwise(0.2)
    points = F.when(F.col("l_linenumber") == 2, F.array(F.struct(at.alias("x"), F.lit(-0.0000001).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("doc"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("id"), F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") % 2 == 0, "image").otherwise("text").alias("kind"), F.lit("rect").alias("shape"),
        at.alias("x0"), at.alias("y0"), x1.alias("x1"), F.lit(1.0).alias("y1"), F.col("l_linenumber").alias("sort_order"), points.alias("points"), "l_partkey",
    )
    return rows.where(F.col("l_partkey") % 13 != 0).drop("l_partkey") if moved else rows.drop("l_partkey")


@query("""WITH a AS (SELECT l_orderkey AS page, l_linenumber % 2 AS kind, l_linenumber AS o, (l_suppkey % 7 / 10.0)::DECIMAL(9, 6) AS x, 0.2 AS w, l_partkey AS p, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity || '-' || l_extendedprice AS id FROM lineitem),
  g AS (SELECT *, page || '|' || CASE kind WHEN 0 THEN 'image' ELSE 'text' END || '|rect|' || x || '|' || x || '|' || (x + w)::DECIMAL(9, 6) || '|1.000000|' || CASE WHEN o = 2 THEN x || ',0.000000' ELSE '' END AS g FROM a),
  h AS (SELECT page, kind, o, p, id, page || '|' || CASE kind WHEN 0 THEN 'image' ELSE 'text' END || '|rect|' || x || '|' || x || '|' || (x + CASE WHEN p % 11 = 0 THEN 0.3 ELSE 0.2 END)::DECIMAL(9, 6) || '|1.000000|' || CASE WHEN o = 2 THEN x || ',0.000000' ELSE '' END AS g FROM a WHERE p % 13 <> 0),
  l AS (SELECT page, g || '|#' || row_number() OVER (PARTITION BY page, kind ORDER BY o, g, id) AS key FROM g), r AS (SELECT page, g || '|#' || row_number() OVER (PARTITION BY page, kind ORDER BY o, g, id) AS key FROM h)
  SELECT CASE WHEN r.key IS NULL THEN 'lost' WHEN l.key IS NULL THEN 'foreign' ELSE 'matched' END AS state, coalesce(l.page, r.page) AS page, count(*) AS n FROM l FULL JOIN r ON l.page = r.page AND l.key = r.key GROUP BY 1, 2""")
def matched_blocks(spark, d):
    out = recognition.match_blocks(_blocks(spark, d, False), _blocks(spark, d, True))
    return out.groupBy("state", F.split(F.coalesce("local", "remote"), "-")[0].cast("long").alias("page")).agg(F.count("*").alias("n"))


def _assembled(spark, d) -> tuple[DataFrame, DataFrame]:
    """A customer is a delivery, its orders are pages with one block each; some deliveries have a fault of each kind."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").select(c.alias("doc"), k.alias("k"))
    bad = lambda n: F.col("doc") % 40 == n
    pages = o.where(~bad(1)).select("doc", F.col("k").alias("page")).unionByName(o.where(bad(2)).select("doc", F.col("k").alias("page")))
    one = o.select("doc", F.concat(F.lit("b"), "k").alias("block"), F.col("k").alias("page"), F.lit("text").alias("kind"), (F.col("k") % 9).cast("int").alias("sort_order"), F.when(bad(3), 0.9).otherwise(0.1).alias("x0"), F.lit(0.1).alias("y0"), F.lit(0.5).alias("x1"), F.lit(1.0).alias("y1"))
    frozen = one.unionByName(one.where(bad(4)))
    results = o.where(~bad(5)).select(
        "doc", F.concat(F.lit("b"), "k").alias("block"), F.when(bad(6), "other").otherwise(F.concat(F.lit("b"), "k")).alias("layout_block"), F.when(bad(7), "image").otherwise("text").alias("kind"), F.when(bad(8), -1).otherwise(F.col("k") % 9).cast("int").alias("ordinal"), F.concat(F.lit("r"), "k").alias("result"),
    )
    alien = o.where(bad(9)).select("doc", F.concat(F.lit("z"), "k").alias("block"), F.lit("z").alias("layout_block"), F.lit("text").alias("kind"), F.lit(0).alias("ordinal"), F.lit("r").alias("result"))
    return recognition.assemble(pages, frozen, results.unionByName(alien))


@query("SELECT o_custkey AS doc, o_orderkey AS page, 1 AS place, 'b' || o_orderkey AS block, 'text' AS kind, 'r' || o_orderkey AS result FROM orders WHERE o_custkey % 40 = 0 OR o_custkey % 40 > 9")
def assembled_blocks(spark, d):
    return _assembled(spark, d)[0]


@query("""WITH o AS (SELECT o_custkey AS doc, o_custkey % 40 AS f, o_orderkey AS k FROM orders) SELECT doc, CASE f WHEN 1 THEN 'page_missing' WHEN 2 THEN 'page_twice' WHEN 3 THEN 'coordinates' WHEN 4 THEN 'block_twice' WHEN 5 THEN 'no_result' WHEN 6 THEN 'other_block' WHEN 7 THEN 'other_kind' WHEN 8 THEN 'other_ordinal' ELSE 'foreign_result' END AS code,
  CASE WHEN f = 9 THEN 'z' || k WHEN f <> 2 THEN 'b' || k END AS block, CASE WHEN f NOT IN (4, 9) THEN k::VARCHAR END AS page FROM o WHERE f BETWEEN 1 AND 9""")
def layout_faults(spark, d):
    return _assembled(spark, d)[1]


# ---------------------------------------------------------------- marked values
_SALT = "sluice/scan/v1"


def _marked_texts(spark, d) -> DataFrame:
    """Texts of orders with a number, a certificate and a surname derived from their keys."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("ИНН 77"), F.lpad(k, 8, "0"), F.lit(", счёт 4"), F.lpad(k, 12, "0"), F.lit("; сертификат "), F.upper(F.translate(F.md5(k), "0123456789", "abcdefabcd")), F.lit(", подписал ИВАНОВ"), F.when(F.col("o_orderkey") % 2 == 0, "ИЧ").otherwise(""), F.lit(" А. А. ООО Мост-"), F.col("o_custkey") % 10)
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", text.alias("text"))


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey % 10 AS c, '77' || lpad(o_orderkey::VARCHAR, 8, '0') AS inn, '4' || lpad(o_orderkey::VARCHAR, 12, '0') AS acc, translate(md5(o_orderkey::VARCHAR), '0123456789', 'abcdefabcd') AS cert FROM orders),
  id AS (SELECT DISTINCT k, v FROM (SELECT k, inn AS v FROM o UNION ALL SELECT k, unnest([substr(acc, 1, 10), substr(acc, 2, 10), substr(acc, 3, 10), substr(acc, 4, 10), substr(acc, 1, 12), substr(acc, 2, 12), acc]) FROM o))
  SELECT k AS o_orderkey, 'id' AS kind, v AS value FROM id WHERE sha256('{_SALT}' || v) LIKE '%0' UNION ALL SELECT k, 'cert', cert FROM o WHERE sha256('{_SALT}' || cert) LIKE '%0'
  UNION ALL SELECT k, 'surname', unnest(['иванов', 'ванов']) FROM o UNION ALL SELECT k, 'surname', 'ванович' FROM o WHERE k % 2 = 0 UNION ALL SELECT k, 'org', 'ООО Мост-3' FROM o WHERE c = 3""")
def marked_values(spark, d):
    texts = _marked_texts(spark, d)
    fixed = spark.createDataFrame([(x,) for x in ("иванов", "ванов", "ванович", "сидоров")], "value string").select(F.lit("surname").alias("kind"), "value")
    digest = F.sha2(F.concat(F.lit(_SALT), F.col("value")), 256)
    known = privacy.candidates(texts, "o_orderkey", "text", ("id", "cert")).select("kind", digest.alias("digest")).where(F.col("digest").endswith("0")).distinct()
    markers = known.unionByName(fixed.select("kind", digest.alias("digest")))
    return privacy.scan(texts, "o_orderkey", "text", written(markers), _SALT, slow=False, names=("ООО Мост-3",))


@query(f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS r FROM documents WHERE text IS NOT NULL), w AS (SELECT DISTINCT doc_id, substr(r, i, n) AS v FROM (SELECT doc_id, r, n, unnest(range(1, length(r) - n + 2)) AS i FROM (SELECT doc_id, r, unnest([10, 12, 13, 15]) AS n FROM r) WHERE length(r) >= n))
  SELECT doc_id, v AS value FROM w WHERE sha256('{_SALT}' || v) LIKE '%0'""")
def marked_documents(spark, d):
    docs = table(spark, d, "documents")
    digest = F.sha2(F.concat(F.lit(_SALT), F.col("value")), 256)
    markers = written(privacy.candidates(docs, "doc_id", "text", ("id",)).select("kind", digest.alias("digest")).where(F.col("digest").endswith("0")).distinct())
    return privacy.scan(docs, "doc_id", "text", markers, _SALT, slow=False).select("doc_id", "value")


# ---------------------------------------------------------------- canonical JSON
def _orders_of_keys(event: Column, value: Column, props: Column) -> tuple[Column, Column]:
    q = F.concat(F.lit('"'), event, F.lit('"'))
    one = F.concat(F.lit('{"b": '), q, F.lit(', "a": {"z": [1.50, {"y": null, "x": true}], "p": '), props, F.lit('}}'))
    two = F.concat(F.lit('{ "a":{"p":'), props, F.lit(',"z":[1.5,{"x":true,"y":null}]},"b":'), q, F.lit("}"))
    return one, two


@query("""WITH e AS (SELECT event_id, '{"a":{"p":' || replace(props, ' ', '') || ',"z":[1.5,{"x":true,"y":null}]},"b":"' || event_type || '"}' AS canon FROM events) SELECT event_id, canon, sha256(canon) AS digest, true AS same FROM e""")
def canonical_props(spark, d):
    one, two = _orders_of_keys(F.col("event_type"), F.col("value"), F.col("props"))
    e = table(spark, d, "events").select("event_id", tx.canonical_json(one).alias("canon"), tx.canonical_json(two).alias("other"))
    return e.select("event_id", "canon", F.sha2("canon", 256).alias("digest"), (F.col("canon") == F.col("other")).alias("same"))


# ---------------------------------------------------------------- answers of models
#: an answer's forms by the key {k}: what it says, the object in it, its failure class when "b" was missed
_ANSWERS = (
    ('{"b": {k}, "a": "x"}', '{"a":"x","b":{k}}', "invalid"), ('<think>{"no": 1}</think>\n```json\n{"a": {k}}\n```', '{"a":{k}}', "fixable_genre"), ('Answer: {"b": "}{\\"", "c": [{k}, {"d": null}]} and {"e": 1}', '{"b":"}{\\"","c":[{k},{"d":null}]}', "invalid"),
    ("no object {k}", None, "fixable_genre"), ("[{k}, 2]", None, "fixable_genre"), ("text {k} { not closed", None, "fixable_genre"), ("``` \n{k}\n```", None, "fixable_genre"), ("{bad {k}} {\"b\": 1}", None, "fixable_genre"),
)


def _said(i: int) -> str:
    def one(x: str | None) -> str:
        if x is None:
            return "NULL"
        out = "'" + x.replace("\\", "' || chr(92) || '").replace("\n", "' || chr(10) || '").replace("{k}", "' || CAST(o_orderkey AS STRING) || '") + "'"
        return out

    return f"CASE o_orderkey % {len(_ANSWERS)} {' '.join(f'WHEN {n} THEN {one(a[i])}' for n, a in enumerate(_ANSWERS))} END"


@query(f"SELECT o_orderkey, {_said(1)} AS object, {_said(2)} AS failure FROM orders")
def model_answers(spark, d):
    raw = F.expr(_said(0))
    given = spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", raw.alias("raw"))
    return given.select("o_orderkey", recognition.extract_json(recognition.strip_noise(F.col("raw"))).alias("object"), recognition.failure_class(F.col("raw"), F.array(F.lit("b"))).alias("failure"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'empty_fragments' WHEN 1 THEN 'table_ragged_rows' ELSE '' END AS text_warnings, CASE WHEN o_orderkey % 5 = 0 THEN 'stamp_all_fields_blank' ELSE '' END AS stamp_warnings,
  CASE o_orderkey % 5 WHEN 1 THEN 'stamp_prose_document_code' WHEN 2 THEN 'stamp_prose_document_code' END AS invalid FROM orders""")
def answer_verdicts(spark, d):
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    ragged = F.concat(F.lit('{"fragments":[{"kind":"paragraph","text":"x"},{"kind":"table","rows":[["'), key, F.lit('","b"],["c"]]}]}'))
    text = F.when(k % 4 == 0, '{"fragments":[]}').when(k % 4 == 1, ragged).otherwise('{"fragments":[{"kind":"table","rows":[["a"],["b"]]}]}')
    prose = "настоящий документ описывает порядок приёмки работ на этом большом объекте"
    code = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.lit(prose)).when(k % 5 == 2, F.repeat(F.lit("А"), 161)).when(k % 5 == 3, F.lit("НАСТОЯЩИЙ ДОКУМЕНТ ОПИСЫВАЕТ ПОРЯДОК ПРИЁМКИ РАБОТ НА ЭТОМ БОЛЬШОМ ОБЪЕКТЕ")).otherwise(F.concat(F.lit("ИД-"), key))
    stamp = F.concat(F.lit('{"document_code":"'), code, F.lit('","stage":null,"signatures":[],"revisions":[]}'))
    v = recognition.stamp_verdict(stamp)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(recognition.text_warnings(text), ",").alias("text_warnings"), F.array_join(v["warnings"], ",").alias("stamp_warnings"), v["invalid"].alias("invalid"))
