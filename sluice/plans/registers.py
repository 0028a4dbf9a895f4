"""Registered queries on registers, over pages built from orders and lineitem, and their SQL.

A customer's orders are the register: an order is a page, its lines are rows. The SQL reads what
each line must give from its key, not from the printed text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import cells
from sluice.operators import registries
from sluice.plans.catalog import query
from sluice.sources.tables import given_up, stored, table, written

#: lines of customers of every kind; a line's number is n within its customer
_LINES = """SELECT o_custkey AS doc, o_orderkey AS page, l_linenumber AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n,
  dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, l_partkey AS part, l_suppkey AS supp FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
#: what a line shows: kind 0 and 1 plain, 2 with a term, 3 continuation, 4 tail of a cell, 5 without a number, 6 an impossible date, 7 too few cells, 8 a repeated position, 9 a gap after it
_KIND = "(part + supp) % 10"


def _days(df: DataFrame) -> DataFrame:
    """Dates as text."""
    return df.select(*(F.col(c).cast("string").alias(c) if t == "date" else c for c, t in df.dtypes))


def _orders(spark, d) -> DataFrame:
    """Orders (doc, page, lines) with their lines in order. Lines that tie show the same, so nothing else breaks ties."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page")).agg(F.sort_array(F.collect_list(line)).alias("lines"))


def _numbered(orders: DataFrame) -> DataFrame:
    """(doc, page, p, lines): the columns of _LINES and kind, by order; a customer's orders lie in one partition, in order."""
    by = Window.partitionBy("doc").orderBy("page")
    before = F.sum(F.size("lines")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.size("lines")
    o = orders.select("doc", "page", "lines", F.row_number().over(by).alias("p"), before.alias("before"))
    line = lambda x, i: F.struct(x["line"], x["part"], x["supp"], (F.col("before") + i + 1).alias("n"), ((x["part"] + x["supp"]) % 10).alias("kind"))
    return o.select("doc", "page", "p", F.transform("lines", line).alias("lines"))


def _pages(orders: DataFrame, printed: Callable[[Column], Column], before: Column, after: Column) -> DataFrame:
    """Pages (doc, page, text): what stands before the rows, the rows in order, what stands after."""
    body = F.array_join(F.transform("lines", printed), "\n")
    return _numbered(orders).select("doc", "page", F.concat_ws("\n", before, body, after).alias("text"))


def _text(c: Column) -> Column:
    return c.cast("string")


def annex_pages(orders: DataFrame) -> DataFrame:
    def printed(x: Column) -> Column:
        kind, n = x["kind"], _text(x["n"])
        no = F.concat(F.lit("№ А-"), _text(x["part"]))
        number = F.when(kind == 2, F.concat(no, F.lit(" с 01.02.2024 по 03.04.2025"))).when(kind == 5, "").when(kind == 6, F.concat(no, F.lit(" от 31.02.2024"))).when(kind == 4, "").otherwise(F.concat(no, F.lit(" от 05.06.2024")))
        position = F.when(kind.isin(3, 4), "").otherwise(F.when(kind == 8, F.lit("1")).otherwise(n))
        cell = [position, F.concat(F.lit("Паспорт "), _text(x["supp"])), number, F.concat(F.lit("Завод "), x["supp"] % 7), F.when(kind == 6, "30.02.2024").otherwise("")]
        row = F.concat(F.lit("| "), F.array_join(F.array(*cell), " | "), F.lit(" |"))
        short = F.concat(F.lit("| "), n, F.lit(" | обрыв |"))
        return F.when(kind == 7, short).otherwise(row)

    header = F.lit("| № п/п | Наименование документа | **Номер** | Организация | Дата |")
    rule, section = F.lit("|---|---|---|---|---|"), F.concat(F.lit("**Раздел "), F.col("doc") % 2, F.lit("**"))
    #: the first page opens the register, with or without the rule below its header; later ones go on below an empty header
    before = F.when(F.col("p") == 1, F.concat_ws("\n", F.lit("**Объект: дом**"), header, F.when(F.col("doc") % 3 != 0, rule), F.lit("| 1 | 2 | 3 | 4 | 5 |"))).otherwise(F.concat_ws("\n", section, F.lit("| | | | | |"), rule))
    return _pages(orders, printed, before, F.lit("подпись"))


#: the rows that a register must give; a page that holds no positioned row of full width closes it
_ANNEX = f"""l AS (SELECT *, {_KIND} AS kind FROM ({_LINES})), good AS (SELECT doc, page, p, bool_or(kind NOT IN (3, 4, 7)) OR p = 1 AS ok FROM l GROUP BY 1, 2, 3),
  ended AS (SELECT doc, min(p) AS q FROM good WHERE NOT ok GROUP BY 1), held AS (SELECT l.*, coalesce(l.p < q, true) AS inside, l.p = q AS shut FROM l LEFT JOIN ended USING (doc)),
  numbered AS (SELECT *, CASE WHEN kind = 8 THEN 1 WHEN kind NOT IN (3, 4, 7) THEN n END AS pos FROM held WHERE inside),
  carried AS (SELECT *, last_value(pos IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n) AS row_no, CASE WHEN p > 1 THEN 'Раздел ' || (doc % 2) END AS section FROM numbered),
  got AS (SELECT * FROM carried WHERE kind NOT IN (4, 7) AND NOT (kind = 3 AND row_no IS NULL) AND row_no <= 9999)"""


@query(f"""WITH {_ANNEX} SELECT doc, page, row_no::INTEGER AS row_no, kind = 3 AS continuation, section, 'Паспорт ' || supp AS name, CASE WHEN kind <> 5 THEN 'А-' || part END AS number, 'Завод ' || (supp % 7) AS org,
  CASE WHEN kind <> 5 THEN 'А-' || part END AS number_norm, CASE WHEN kind <> 5 THEN 'A-' || part END AS number_folded, CASE WHEN kind NOT IN (2, 5, 6) THEN '2024-06-05' END AS issued_at,
  CASE WHEN kind = 2 THEN '2024-02-01' END AS valid_from, CASE WHEN kind = 2 THEN '2025-04-03' END AS valid_to, kind = 6 AS date_bad FROM got""")
def annex_registers(spark, d):
    return _days(registries.annex_rows(registries.annex_records(annex_pages(_orders(spark, d)), True))).drop("seq")


@query(f"""WITH {_ANNEX}, seen AS (SELECT doc, section, row_no, count(*) AS k, lag(row_no) OVER (PARTITION BY doc, section ORDER BY row_no) AS b FROM got WHERE kind <> 3 GROUP BY 1, 2, 3)
  SELECT doc, page, 'wrong_width' AS code, NULL::INTEGER AS row_no, '2/5' AS detail FROM numbered WHERE kind = 7
  UNION ALL SELECT doc, page, 'cell_tail', NULL, 'Паспорт ' || supp FROM carried WHERE kind = 4 OR (kind = 3 AND row_no IS NULL)
  UNION ALL SELECT doc, page, 'bad_date', row_no::INTEGER, NULL FROM got WHERE kind = 6 UNION ALL SELECT doc, page, 'no_number', row_no::INTEGER, NULL FROM got WHERE kind = 5
  UNION ALL SELECT DISTINCT doc, page, 'header_recovered', NULL, NULL FROM l WHERE p = 1 AND doc % 3 = 0 UNION ALL SELECT DISTINCT doc, page, 'register_closed', NULL, NULL FROM held WHERE shut
  UNION ALL SELECT doc, NULL, 'position_repeated', row_no::INTEGER, section FROM (SELECT doc, section, row_no, unnest(range(1, k)) FROM seen) UNION ALL SELECT doc, NULL, 'position_missing', r::INTEGER, section FROM (SELECT doc, section, unnest(range(b + 1, row_no)) AS r FROM seen WHERE b IS NOT NULL)""")
def annex_remarks(spark, d):
    return registries.annex_warnings(written(registries.annex_records(annex_pages(_orders(spark, d)), True)))


@query(f"""WITH {_ANNEX}, filed AS (SELECT s_suppkey AS document, CASE WHEN s_suppkey % 2 = 0 THEN 'А-' ELSE 'A-' END || (s_suppkey * 3) AS number FROM supplier WHERE s_suppkey % 11 <> 0),
  e AS (SELECT number, count(*) AS k, min(document) AS document FROM filed GROUP BY 1), f AS (SELECT replace(number, 'А', 'A') AS number, count(*) AS k, min(document) AS document FROM filed GROUP BY 1)
  SELECT got.doc, page, row_no::INTEGER AS row_no, CASE WHEN e.k = 1 OR (e.k IS NULL AND f.k = 1) THEN 'matched' WHEN e.k > 1 OR f.k > 1 THEN 'ambiguous' ELSE 'missing' END AS state, CASE WHEN e.k = 1 THEN 1.0::DOUBLE WHEN e.k IS NULL AND f.k = 1 THEN 0.85 END AS score,
  CASE WHEN e.k = 1 THEN e.document WHEN e.k IS NULL AND f.k = 1 THEN f.document END AS document FROM got LEFT JOIN e ON kind <> 5 AND e.number = 'А-' || part LEFT JOIN f ON kind <> 5 AND f.number = 'A-' || part""")
def registry_matches(spark, d):
    """Every register against the same filed documents, register documents aside."""
    rows = registries.annex_rows(registries.annex_records(annex_pages(_orders(spark, d)), True))
    s = F.col("s_suppkey")
    filed = table(spark, d, "supplier").select(F.lit(1).alias("doc"), s.alias("document"), F.concat(F.when(s % 2 == 0, "А-").otherwise("A-"), s * 3).alias("number"), F.when(s % 11 == 0, registries.REGISTRY_TYPE).otherwise("passport").alias("doc_type"))
    flat = rows.select(F.lit(1).alias("doc"), F.struct("doc", "page", "row_no", "seq").alias("seq"), "number", "number_norm")
    out = registries.match_registry(flat, filed)
    return out.select("seq.doc", "seq.page", "seq.row_no", "state", "score", "document")


def transfer_pages(orders: DataFrame) -> DataFrame:
    """Even customers hand over form b, odd ones form a; a line of kind 0 opens a group."""
    doc = F.col("doc")

    def printed(x: Column) -> Column:
        kind, part, supp = x["kind"], x["part"], x["supp"]
        date = F.when(kind == 1, "до 05.06.2026").when(kind == 2, "c 01.02.2024 по 03.04.2025").when(kind == 3, "май 2024").when(kind == 4, "31.02.2024").when(kind == 5, "02.2024").otherwise("07.08.2024")
        number = F.when(kind == 6, "б/н").otherwise(F.concat(F.lit("№"), _text(part), F.lit("/А")))
        cell_a = [F.when(kind == 0, F.concat(_text(x["n"]), F.lit("."))).otherwise(""), F.concat(F.lit("Акт; "), _text(supp)), number, date, F.lit("2 шт.")]
        cell_b = [F.concat(F.lit("1."), _text(x["line"])), F.when(kind == 7, "АОСР на бетон").otherwise(F.concat(F.lit("Паспорт "), _text(supp))), number, date, F.concat(F.lit("Завод "), supp % 7), F.lit("3"), F.lit("46-47")]
        row = lambda c: F.concat(F.lit("| "), F.array_join(F.array(*c), " | "), F.lit(" |"))
        banner = F.concat(F.lit("| | Работы "), _text(part), F.lit(" (ООО Мост "), supp % 3, F.lit(") | | | | | |"))
        return F.when(doc % 2 == 1, row(cell_a)).when(kind == 0, F.concat_ws("\n", banner, row(cell_b))).when(kind == 8, "| обрыв | x |").otherwise(row(cell_b))

    a, b = "| № п/п | Наименование документа | Номер документа | Дата | Кол-во экз. |\n|---|---|---|---|---|", "| № п/п | Наименование документов | № документа | Дата | Организация | Кол-во листов | Страница по списку |\n|---|---|---|---|---|---|---|"
    head = F.concat(F.lit("Реестр передачи № R-"), _text(doc), F.lit("\nОбъект: дом "), _text(doc))
    folder = F.when(doc % 2 == 1, "папка № 4/2\nИсполнитель работ: ООО Мост").otherwise("| Номер папки | №7 |")
    first = F.concat_ws("\n", head, folder, F.lit(""), F.when(doc % 2 == 1, a).otherwise(b))
    return _pages(orders, printed, F.when(F.col("p") == 1, first).otherwise("| | | | | |\n|---|---|---|---|---|"), F.lit(""))


#: what the lines must give: rows before the first group are none; groups and rows count from 0; a group of form b takes its act from its first line of kind 7 with a number
_TRANSFER = f"""l AS (SELECT *, {_KIND} AS kind, doc % 2 = 1 AS a FROM ({_LINES})), x AS (SELECT *, (count(*) FILTER (WHERE kind = 0) OVER (PARTITION BY doc ORDER BY n)) - 1 AS grp FROM l WHERE a OR kind <> 8),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n) - 1 AS ord FROM x WHERE grp >= 0)"""


@query(f"""WITH {_TRANSFER} SELECT doc, ord::INTEGER AS ord, grp::INTEGER AS grp, CASE WHEN NOT a THEN '1.' || line WHEN kind = 0 THEN n::VARCHAR END AS row_no, CASE WHEN a THEN 'Акт; ' || supp WHEN kind = 7 THEN 'АОСР на бетон' ELSE 'Паспорт ' || supp END AS name,
  CASE WHEN kind = 6 THEN 'б/н' ELSE part || '/А' END AS number, CASE WHEN NOT a THEN 'Завод ' || (supp % 7) END AS org, CASE WHEN kind <> 6 THEN part || '/А' END AS number_norm, CASE WHEN kind <> 6 THEN part || '/A' END AS number_folded,
  CASE WHEN kind IN (0, 6, 7, 8, 9) THEN '2024-08-07' END AS issued_at, CASE WHEN kind = 2 THEN '2024-02-01' END AS valid_from, CASE kind WHEN 1 THEN '2026-06-05' WHEN 2 THEN '2025-04-03' END AS valid_to,
  CASE WHEN NOT a THEN 3 END AS sheets, CASE WHEN a THEN 2 END AS copies, CASE WHEN NOT a THEN '46-47' END AS pages, kind = 4 AS date_bad, kind IN (3, 5) AS month_only FROM r""")
def transfer_registers(spark, d):
    return _days(registries.transfer_rows(registries.transfer_records(transfer_pages(_orders(spark, d)), True)))


@query(f"""WITH {_TRANSFER}, acts AS (SELECT doc, grp, arg_min(part || '/А', ord) AS act, min(ord) AS first FROM r WHERE NOT a AND kind = 7 GROUP BY 1, 2)
  SELECT r.doc, r.grp::INTEGER AS ord, CASE WHEN a THEN n::VARCHAR END AS group_no, CASE WHEN a THEN 'Акт ' || supp ELSE 'Работы ' || part END AS title, CASE WHEN NOT a THEN 'ООО Мост ' || (supp % 3) END AS contractor,
  CASE WHEN a THEN part || '/А' ELSE act END AS act_number, CASE WHEN a THEN part || '/А' ELSE act END AS act_norm, replace(CASE WHEN a THEN part || '/А' ELSE act END, 'А', 'A') AS act_folded, first::INTEGER AS act_row FROM r LEFT JOIN acts ON acts.doc = r.doc AND acts.grp = r.grp WHERE kind = 0""")
def transfer_register_groups(spark, d):
    return registries.transfer_groups(written(registries.transfer_records(transfer_pages(_orders(spark, d)), True)))


@query(f"""WITH {_TRANSFER}, acts AS (SELECT DISTINCT doc, grp FROM r WHERE NOT a AND kind = 7)
  SELECT doc, page, 'row_before_groups' AS code, NULL::INTEGER AS at, CASE WHEN a THEN 'Акт; ' || supp WHEN kind = 7 THEN 'АОСР на бетон' ELSE 'Паспорт ' || supp END AS detail FROM x WHERE grp < 0 UNION ALL SELECT doc, page, 'wrong_width', NULL, '2/7' FROM l WHERE NOT a AND kind = 8
  UNION ALL SELECT doc, NULL, 'date_without_day', (ord + 1)::INTEGER, NULL FROM r WHERE kind IN (3, 5) UNION ALL SELECT doc, NULL, 'bad_date', (ord + 1)::INTEGER, NULL FROM r WHERE kind = 4
  UNION ALL SELECT r.doc, NULL, 'no_act_number', (r.grp + 1)::INTEGER, 'Работы ' || part FROM r LEFT JOIN acts ON acts.doc = r.doc AND acts.grp = r.grp WHERE NOT a AND kind = 0 AND acts.doc IS NULL""")
def transfer_remarks(spark, d):
    return registries.transfer_warnings(written(registries.transfer_records(transfer_pages(_orders(spark, d)), True)))


@query(f"""WITH {_TRANSFER} SELECT DISTINCT doc, CASE WHEN a THEN 'a' ELSE 'b' END AS form, 'R-' || doc AS registry_no, CASE WHEN a THEN '4/2' ELSE '7' END AS folder_no, 'Объект: дом ' || doc AS object, CASE WHEN a THEN 'ООО Мост' END AS contractor FROM l""")
def transfer_register_heads(spark, d):
    return registries.transfer_heads(written(registries.transfer_records(transfer_pages(_orders(spark, d)), True)))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN o_orderdate::DATE::VARCHAR END AS valid_to, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate::DATE::VARCHAR END AS issued_at, o_orderkey % 6 IN (2, 3) AS month_only FROM orders""")
def transfer_dates(spark, d):
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    k = F.col("o_orderkey") % 6
    cell = F.when(k == 0, day).when(k == 1, F.concat(F.lit("действителен до "), day)).when(k == 2, F.date_format("o_orderdate", "MM.yyyy")).when(k == 3, F.concat(F.lit("сентябрь "), F.year("o_orderdate"))).when(k == 4, "нет").otherwise("")
    out = table(spark, d, "orders").select("o_orderkey", cells.transfer_date_cell(cell).alias("c"))
    return _days(out.select("o_orderkey", "c.valid_to", "c.issued_at", "c.month_only"))


#: what was filed, by the lines that opened groups: works, and the documents of their lines
_FILED = """works AS (SELECT doc, grp AS work, 'Мост ' || (supp % 2) AS contractor, CASE WHEN part % 3 = 0 THEN 'РАБОТЫ ' || part ELSE 'Иное ' || part END AS title FROM r WHERE kind = 0 AND part % 5 <> 0),
  documents AS (SELECT r.doc, grp AS work, ord AS document, CASE WHEN (a AND kind = 0) OR (NOT a AND kind = 7) THEN 'aosr_act' ELSE 'passport' END AS doc_type, CASE WHEN kind = 6 THEN NULL WHEN part % 4 = 0 THEN part || '/A' ELSE part || '/А' END AS number,
    CASE WHEN part % 9 = 0 THEN '2024-01-01' ELSE '2024-08-07' END AS issued, CASE WHEN supp % 8 = 0 THEN 'Иной' WHEN supp % 8 = 1 THEN '' ELSE 'ООО «Завод ' || (supp % 7) || '»' END AS org, CASE WHEN supp % 10 = 0 THEN 5 ELSE 3 END AS sheets FROM r JOIN works ON works.doc = r.doc AND works.work = r.grp WHERE part % 6 <> 1)"""


def _reconciled(spark, d, name: str) -> DataFrame:
    """One table of the reconciliation, without the work that only others need."""
    orders = given_up(stored(_orders(spark, d)))
    records = given_up(stored(registries.transfer_records(transfer_pages(orders), True)))
    groups, rows = stored(registries.transfer_groups(records)), registries.transfer_rows(records)
    _numbered(orders).select("doc", "page", "p", F.inline("lines")).drop("kind").createOrReplaceTempView("registers_lines")
    given = _TRANSFER.replace(_LINES, "SELECT * FROM registers_lines").replace("count(*) FILTER (WHERE kind = 0) OVER", "count(CASE WHEN kind = 0 THEN 1 END) OVER")
    #: the numbered lines once, for works and documents; filed says of a line whether its group's work is
    opened = "last_value(CASE WHEN kind = 0 THEN part % 5 <> 0 END) IGNORE NULLS OVER (PARTITION BY doc ORDER BY n ROWS UNBOUNDED PRECEDING) AS filed"
    given_up(stored(spark.sql(f"WITH {given} SELECT doc, ord, grp, kind, a, part, supp, {opened} FROM r"))).createOrReplaceTempView("registers_filed")
    filed = "WITH " + _FILED.replace("FROM r JOIN works ON works.doc = r.doc AND works.work = r.grp WHERE", "FROM r WHERE filed AND").replace("FROM r ", "FROM registers_filed AS r ")
    works = spark.sql(f"{filed} SELECT * FROM works")
    documents = spark.sql(f"{filed} SELECT *, CAST(NULL AS STRING) AS title, CAST(issued AS DATE) AS issued_at, array(org) AS organisations FROM documents")
    out = registries.reconcile(groups, rows, works, documents, "registers" if name == "verdicts" else name)
    if name != "verdicts":
        return out[name]
    orders.select("doc").distinct().createOrReplaceTempView("registers_docs")
    expected = spark.sql("SELECT doc, CASE WHEN doc % 7 = 0 THEN 'R-0' ELSE 'r-' || doc END AS number, CASE WHEN doc % 2 = 1 THEN '4/2' WHEN doc % 5 = 0 THEN NULL ELSE '7' END AS folder_no FROM registers_docs")
    return registries.register_verdicts(out["registers"], registries.transfer_heads(records), expected)


_RECONCILED = f"""{_TRANSFER}, {_FILED}, acts AS (SELECT doc, grp, arg_min(part || '/А', ord) AS act FROM r WHERE NOT a AND kind = 7 GROUP BY 1, 2),
  g AS (SELECT r.doc, r.grp, CASE WHEN a THEN part || '/А' ELSE act END AS act, CASE WHEN a THEN 'Акт ' || supp ELSE 'Работы ' || part END AS title, CASE WHEN NOT a THEN 'ООО Мост ' || (supp % 3) END AS needle FROM r LEFT JOIN acts ON acts.doc = r.doc AND acts.grp = r.grp WHERE kind = 0),
  c AS (SELECT works.*, number FROM works LEFT JOIN documents ON documents.doc = works.doc AND documents.work = works.work AND doc_type = 'aosr_act' AND number IS NOT NULL),
  h AS (SELECT DISTINCT g.doc, grp, work, 1 AS rung, needle LIKE '%' || contractor || '%' AS same FROM g JOIN c ON c.doc = g.doc AND act = number UNION SELECT g.doc, grp, work, 2, needle LIKE '%' || contractor || '%' FROM g JOIN c ON c.doc = g.doc AND replace(act, 'А', 'A') = replace(number, 'А', 'A')
    UNION SELECT g.doc, grp, work, 3, needle LIKE '%' || contractor || '%' FROM g JOIN c ON c.doc = g.doc AND lower(g.title) = lower(c.title)),
  t AS (SELECT doc, grp, min(rung) AS rung FROM h GROUP BY 1, 2), k AS (SELECT h.doc, h.grp, count(*) AS n, count(*) FILTER (WHERE same) AS m, min(work) AS one, min(work) FILTER (WHERE same) AS own FROM h JOIN t ON t.doc = h.doc AND t.grp = h.grp AND t.rung = h.rung GROUP BY 1, 2),
  d AS (SELECT g.doc, g.grp, CASE WHEN n = 1 OR m = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS gstate, CASE WHEN n = 1 THEN one WHEN m = 1 THEN own END AS work FROM g LEFT JOIN k ON k.doc = g.doc AND k.grp = g.grp),
  e1 AS (SELECT doc, work, number, count(*) AS k, min(document) AS document FROM documents WHERE number IS NOT NULL GROUP BY 1, 2, 3), e2 AS (SELECT doc, work, replace(number, 'А', 'A') AS number, count(*) AS k, min(document) AS document FROM documents WHERE number IS NOT NULL GROUP BY 1, 2, 3),
  w AS (SELECT r.doc, r.ord, r.grp, d.work, CASE WHEN a AND kind <> 0 THEN NULL WHEN a THEN n::VARCHAR ELSE '1.' || line END AS row_no, r.kind, r.a, r.supp, CASE WHEN e1.k = 1 OR (e1.k IS NULL AND e2.k = 1) THEN 'matched' WHEN e1.k > 1 OR e2.k > 1 THEN 'ambiguous' ELSE 'missing' END AS state,
    CASE WHEN e1.k = 1 THEN 1.0::DOUBLE WHEN e1.k IS NULL AND e2.k = 1 THEN 0.85 END AS score, CASE WHEN e1.k = 1 THEN e1.document WHEN e1.k IS NULL AND e2.k = 1 THEN e2.document END AS document FROM r JOIN d ON d.doc = r.doc AND d.grp = r.grp
    LEFT JOIN e1 ON e1.doc = d.doc AND e1.work = d.work AND kind <> 6 AND e1.number = part || '/А' LEFT JOIN e2 ON e2.doc = d.doc AND e2.work = d.work AND kind <> 6 AND e2.number = part || '/A'),
  v AS (SELECT w.*, array_to_string(list_filter([CASE WHEN kind IN (0, 6, 7, 8, 9) AND issued <> '2024-08-07' THEN 'issued_at' END, CASE WHEN NOT w.a AND org <> '' AND NOT contains(org, 'Завод ' || (w.supp % 7)) THEN 'organization' END, CASE WHEN NOT w.a AND sheets <> 3 THEN 'sheets' END], lambda x: x IS NOT NULL), ',') AS mismatches
    FROM w LEFT JOIN documents q ON q.doc = w.doc AND q.document = w.document),
  extra AS (SELECT documents.* FROM documents WHERE EXISTS (SELECT 1 FROM d WHERE d.doc = documents.doc AND d.work = documents.work) AND NOT EXISTS (SELECT 1 FROM w WHERE w.doc = documents.doc AND w.document = documents.document)),
  per AS (SELECT works.doc, works.work, title, EXISTS (SELECT 1 FROM d WHERE d.doc = works.doc AND d.work = works.work) AS found, (SELECT count(*) FROM extra WHERE extra.doc = works.doc AND extra.work = works.work) AS extra_documents,
    count(v.ord) AS rows_total, count(*) FILTER (v.state = 'matched') AS rows_matched, count(*) FILTER (v.state = 'missing') AS rows_missing, count(*) FILTER (v.state = 'ambiguous') AS rows_ambiguous, count(*) FILTER (v.mismatches <> '') AS rows_field_mismatch
    FROM works LEFT JOIN v ON v.doc = works.doc AND v.work = works.work GROUP BY 1, 2, 3)"""
_COUNTERS = "rows_total, rows_matched, rows_missing, rows_ambiguous, rows_field_mismatch"


@query(f"WITH {_RECONCILED} SELECT doc, ord::INTEGER AS ord, grp::INTEGER AS grp, work, row_no, state, score, document, mismatches FROM v")
def reconciled_rows(spark, d):
    return _reconciled(spark, d, "rows").select("doc", "ord", "grp", "work", "row_no", "state", "score", "document", F.array_join("mismatches", ",").alias("mismatches"))


@query(f"""WITH {_RECONCILED} SELECT doc, work, title, CASE WHEN found THEN 'matched' ELSE 'extra' END AS state, CASE WHEN found AND rows_missing + rows_ambiguous + rows_field_mismatch + extra_documents = 0 THEN 'clean' ELSE 'mismatch' END AS verdict, {_COUNTERS}, extra_documents FROM per""")
def reconciled_works(spark, d):
    return _reconciled(spark, d, "works")


@query(f"WITH {_RECONCILED} SELECT doc, work, document, doc_type, number FROM extra")
def extra_documents(spark, d):
    return _reconciled(spark, d, "extra").drop("title")


@query(f"""WITH {_RECONCILED}, gs AS (SELECT doc, count(*) AS groups_total, count(*) FILTER (gstate = 'matched') AS groups_matched, count(*) FILTER (gstate = 'missing') AS groups_missing, count(*) FILTER (gstate = 'ambiguous') AS groups_ambiguous FROM d GROUP BY 1),
  rs AS (SELECT doc, count(*) AS rows_total, count(*) FILTER (state = 'matched') AS rows_matched, count(*) FILTER (state = 'missing') AS rows_missing, count(*) FILTER (state = 'ambiguous') AS rows_ambiguous, count(*) FILTER (mismatches <> '') AS rows_field_mismatch FROM v GROUP BY 1),
  ws AS (SELECT doc, count(*) AS works_total, count(*) FILTER (NOT found) AS works_extra, sum(extra_documents)::BIGINT AS extra_documents FROM per GROUP BY 1)
  SELECT gs.doc, groups_total, groups_matched, groups_missing, groups_ambiguous, {_COUNTERS}, coalesce(works_total, 0) AS works_total, coalesce(works_extra, 0) AS works_extra, coalesce(extra_documents, 0) AS extra_documents FROM gs JOIN rs USING (doc) LEFT JOIN ws USING (doc)""")
def reconciled_registers(spark, d):
    return _reconciled(spark, d, "registers").drop("sound")


@query(f"""WITH {_RECONCILED}, bad AS (SELECT doc FROM d WHERE gstate <> 'matched' UNION SELECT doc FROM v WHERE state <> 'matched' OR mismatches <> '' UNION SELECT doc FROM per WHERE NOT found UNION SELECT doc FROM extra),
  reg AS (SELECT doc, bool_or(doc IN (SELECT doc FROM r)) AS has_rows, bool_or(doc IN (SELECT doc FROM works)) AS has_works FROM l GROUP BY 1)
  SELECT doc, doc > 0 AND doc % 7 = 0 AS header_mismatch, CASE WHEN NOT has_rows AND has_works THEN 'unparsed' WHEN doc IN (SELECT doc FROM bad) OR (doc > 0 AND doc % 7 = 0) THEN 'mismatch' ELSE 'clean' END AS verdict FROM reg""")
def register_verdicts(spark, d):
    return _reconciled(spark, d, "verdicts")


@query(f"WITH {_RECONCILED} SELECT DISTINCT h.doc, h.work FROM h JOIN t ON t.doc = h.doc AND t.grp = h.grp AND t.rung = h.rung")
def named_works(spark, d):
    return _reconciled(spark, d, "named")
