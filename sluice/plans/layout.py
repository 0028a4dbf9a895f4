"""Registered queries over pages, blocks and documents built from orders.

An order shows one of a few forms, chosen by its key; the SQL lists what each form must give,
worked out by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import documents, geometry
from sluice.plans.catalog import query
from sluice.sources.tables import table


def _shown(spark, d, forms: list[tuple], schema: str, form: str):
    """Rows of the forms, for every order that shows them: the column form becomes the order's key."""
    n = max(f[[c.split()[0] for c in schema.split(", ")].index(form)] for f in forms)
    small = F.broadcast(spark.createDataFrame(forms, schema).withColumnRenamed(form, "_form"))  # a few rows of this file
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias(form), (F.col("o_orderkey") % n + 1).alias("_form"))
    return keys.join(small, "_form").drop("_form")


def _given(values: str, names: str, n: int) -> str:
    """The SQL of what forms 1 to n give, the first of the names being the form."""
    form, *rest = names.split(", ")
    return f"SELECT o_orderkey AS {form}, {', '.join(rest)} FROM orders JOIN (VALUES {values}) t(_form, {', '.join(rest)}) ON o_orderkey % {n} + 1 = _form"


_TYPES = (
    documents.DocType("act", 5, ("акт",), ("акт сверки",), ("освидетельств",)), documents.DocType("passport", 4, ("паспорт",)), documents.DocType("certificate", 5, ("сертификат", "сертификат соответствия")), documents.DocType("act_any", 5, ("акт скрытых",)),
)
_PAGES = (
    (1, "# АКТ № 5\nосвидетельствования"), (2, "Приложения:\nАкт № 1\nПаспорт насоса"), (3, "Акт сверки\nАкт"), (4, "АКТ скрытых работ"), (5, "\n".join(f"строка {i}" for i in range(20)) + "\nАкт"), (6, "к Акт"), (7, "паспорт " + "x" * 90),
)


@query(_given("""(1, 'act', 0, 1), (2, 'passport', 2, 0), (4, 'act', 0, 0), (4, 'act_any', 0, 0)""", "page, code, line_index, body_hits", 7))
def heading_types(spark, d):
    pages = _shown(spark, d, _PAGES, "page int, text string", "page")
    return documents.match_types(pages, "page", "text", _TYPES).select("page", "code", "line_index", "body_hits")


@query(_given("""(1, 'act', 'resolved', ''), (2, 'passport', 'resolved', ''), (4, 'act', 'ambiguous', 'act_any')""", "page, code, state, alternatives", 7))
def heading_resolution(spark, d):
    pages = _shown(spark, d, _PAGES, "page int, text string", "page")
    return documents.resolve_types(documents.match_types(pages, "page", "text", _TYPES), "page").withColumn("alternatives", F.array_join("alternatives", ","))


@query(_given("""(1, 'annex', 'Приложение к акту № 7/2', '7/2'), (2, 'copy', 'КОПИЯ ВЕРНА', NULL)""", "page, code, line, parent", 3))
def page_roles(spark, d):
    roles = (documents.PageRole("annex", (r"приложени[ея].*?№\s*(\S+)",), ("перечень приложений",)), documents.PageRole("copy", ("копия верна",)))
    pages = _shown(spark, d, [(1, "Приложение к акту № 7/2"), (2, "текст\n**КОПИЯ ВЕРНА**"), (3, "Перечень приложений\nПриложение № 1")], "page int, text string", "page")
    return documents.match_roles(pages, "page", "text", roles)


@query(_given("""(1, 'act', false), (2, 'other_quality', true), (3, 'unknown_document', true)""", "id, code, is_fallback", 3))
def fallback_types(spark, d):
    rows = _shown(spark, d, [(1, "act", "works"), (2, None, "quality"), (3, None, None)], "id int, code string, kind string", "id")
    return documents.fallback_types(rows, "code", "kind", {"quality": "other_quality"}).drop("kind")


@query(_given("""(1, 1, 0, 'header', 'a/b'), (1, 1, 1, 'separator', '---/:-:'), (1, 1, 2, 'data', 'x/'), (1, 5, 0, 'separator', '--'), (1, 5, 1, 'data', 'y')""", "id, start, row_no, kind, cells", 1))
def table_lines(spark, d):
    rows = _shown(spark, d, [(1, "intro\n| **a** | b |\n|---|:-:|\n| x | |\nend\n|--|\n|y|")], "id int, text string", "id")
    return documents.table_rows(rows, "id", "text").withColumn("cells", F.array_join("cells", "/"))


@query(_given("""(1, 2, 'Раздел 1')""", "id, pos, title", 1))
def bold_titles(spark, d):
    return documents.bold_lines(_shown(spark, d, [(1, "| a |\nтекст **не весь**\n** Раздел 1 **")], "id int, text string", "id"), "id", "text")


@query(_given("""(1, 'two' || chr(10) || chr(10) || 'three' || chr(10) || chr(10) || 'last')""", "page, text", 1))
def page_texts(spark, d):
    rows = [(1, None, "text", "last"), (1, 3, "text", "three"), (1, 2, "text", "two"), (1, 1, "stamp", "seal"), (1, 4, "text", " ")]
    return documents.page_texts(_shown(spark, d, rows, "page int, ordinal int, kind string, body string", "page"), "page", "ordinal", "kind", "body")


@query("""SELECT 'ТРУБА' || m AS product_key, CASE WHEN m % 3 = 0 THEN 'steel' END AS category, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS documents, count(DISTINCT CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 END) AS batches
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 20 % 3 = 0 THEN 'СТАЛЬНАЯ' ELSE '' END || o_orderkey % 20 AS m0, o_orderkey % 20 AS m FROM orders WHERE o_orderkey % 50 <> 49) GROUP BY m""".replace("'ТРУБА' || m AS", "'ТРУБА' || min(m0) AS"))
def derived_materials(spark, d):
    """Twenty products, spelled in three ways; every fiftieth order names none."""
    k = F.col("o_orderkey")
    kind = F.concat(F.when(k % 20 % 3 == 0, "стальная ").otherwise(""), k % 20)
    name = F.when(k % 50 == 49, " ").when(k % 3 == 0, F.concat(F.lit("Труба "), kind)).when(k % 3 == 1, F.upper(F.concat(F.lit("труба  "), kind))).otherwise(F.concat(F.lit("труба - "), kind))
    df = table(spark, d, "orders").select(k.alias("document_id"), name.alias("product"), F.when(k % 4 < 3, F.concat(F.lit("п"), k % 4)).alias("batch_no"), F.lit(None).cast("string").alias("heat_no"), F.lit(None).cast("date").alias("made_at"))
    return documents.materials(df, [("steel", "стальн|арматур")]).select("product_key", "category", F.array_join("documents", ",").alias("documents"), F.size("batches").alias("batches"))


@query(_given("""(1, 'text', 0.0, 0.0, 9.0, 2.0, 0.9), (1, 'text', 20.0, 0.0, 24.0, 2.0, 0.5), (1, 'image', 0.0, 0.0, 1.0, 1.0, 0.4)""", "page, kind, x0, y0, x1, y1, score", 1))
def merged_text_boxes(spark, d):
    rows = [(1, "text", 0.0, 0.0, 4.0, 2.0, 0.7), (1, "text", 20.0, 0.0, 24.0, 2.0, 0.5), (1, "text", 5.0, 0.0, 9.0, 2.0, 0.9), (1, "image", 0.0, 0.0, 1.0, 1.0, 0.4)]
    return geometry.merge_text_boxes(_shown(spark, d, rows, "page int, kind string, x0 double, y0 double, x1 double, y1 double, score double", "page"), "page", "kind")


@query(_given("""(1, 'a'), (3, 'b')""", "id, kind", 3))
def thresholded_boxes(spark, d):
    rows = _shown(spark, d, [(1, "a", 0.3), (2, "b", 0.4), (3, "b", 0.5)], "id int, kind string, score double", "id")
    return geometry.above_threshold(rows, "kind", "score", {"a": 0.2}, 0.5).drop("score")


@query(_given("""(1, 0, '', 0.5, 2), (1, 1, 'missing_expected_stamp,neighbor_mismatch', 0.4, 1), (1, 2, '', 0.5, 2), (1, 3, 'blank_page_candidate,no_blocks', 0.0, 0), (1, 4, 'bbox_out_of_page,degenerate_geometry,suspicious_overlap', 0.6, 3)""", "doc, page, flags, coverage, n_blocks", 1))
def attention_flags(spark, d):
    two = lambda p: [(1, p, "text", 0.0, 0.0, 0.5, 0.5), (1, p, "text", 0.5, 0.0, 1.0, 0.5)]
    rows = [*two(0), (1, 1, "image", 0.0, 0.0, 0.4, 1.0), *two(2), (1, 4, "text", 0.0, 0.0, 0.5, 1.2), (1, 4, "text", 0.0, 0.0, 0.5, 1.0), (1, 4, "stamp", 0.9, 0.9, 0.9, 1.0)]
    blocks = _shown(spark, d, rows, "doc int, page int, kind string, x0 double, y0 double, x1 double, y1 double", "doc")
    limits = {"side": 0.001, "tiny": 0.01, "overlap": 0.5, "blank": 0.05, "low": 0.2, "neighbours": 2, "change": 0.5, "stamp": 1}
    out = geometry.page_flags(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.array(*map(F.lit, range(5)))).alias("page")), blocks, "doc", "page", limits)
    return out.withColumns({"flags": F.array_join("flags", ","), "coverage": F.round("coverage", 6)})
