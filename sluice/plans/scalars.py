"""Scalar functions over cells built from orders; the SQL gives the results worked out by hand.

The key of an order chooses the form of its cell, and stands in the cell wherever {k} does (day 1 to
28: {d}, month 1 to 12: {m}, two digits each: {dd}, {mm}).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import cells, text as tx
from sluice.plans.catalog import query
from sluice.sources.tables import table

#: what a place-holder stands for, in SQL that Spark and the oracle both read
_HELD = {
    "{k}": "CAST(o_orderkey AS STRING)", "{d}": "CAST(1 + o_orderkey % 28 AS STRING)", "{m}": "CAST(1 + o_orderkey % 12 AS STRING)",
    "{dd}": "lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')", "{mm}": "lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0')",
}


def _sql(v: str | None, form: int) -> str:
    """A cell as an expression over o_orderkey; line breaks and quotes are spelled out."""
    if v is None:
        return f"WHEN {form} THEN NULL"
    out = f"'{v.replace(chr(39), chr(39) * 2)}'".replace("\n", "' || chr(10) || '").replace("\\", "' || chr(92) || '").replace("\x01", "' || chr(1) || '")
    for held, sql in _HELD.items():
        out = out.replace(held, f"' || {sql} || '")
    return f"WHEN {form} THEN {out}"


def golden(name: str, f: Callable[[Column], Column], *cases: tuple[str | None, str | None]) -> None:
    """A query (o_orderkey, given, result) over orders, result being text; fields of a struct are parted by |."""
    which = lambda i: f"CASE o_orderkey % {len(cases)} {' '.join(_sql(c[i], form) for form, c in enumerate(cases))} END"

    def run(spark, d):
        given = table(spark, d, "orders").select("o_orderkey", F.expr(which(0)).cast("string").alias("given"))
        return given.select("o_orderkey", "given", f(F.col("given")).cast("string").alias("result"))

    run.__name__ = name
    GOLDEN[name] = (f, cases)
    query(f"SELECT o_orderkey, {which(0)} AS given, {which(1)} AS result FROM orders")(run)


#: every function with its cells, for tests over the cells alone
GOLDEN: dict[str, tuple[Callable[[Column], Column], tuple]] = {}


def _parts(c: Column, *names: str, doubles: tuple[str, ...] = ()) -> Column:
    return F.concat_ws("|", *[F.coalesce(tx.plain_number(c[n]) if n in doubles else c[n].cast("string"), F.lit("-")) for n in names])


golden("doc_numbers_plain", tx.doc_no, ("№ {k}–а/7", "{k}-А/7"), ("‘RU’ .MCC;\u20091`", "RU.MCC1"), ("Д-RU.\u00adPA01", "Д-RU.PA01"), (None, None), ("", ""))
golden("doc_numbers_folded", tx.doc_no_folded, ("РОСС RU Д-RU.PA01.B.{k}/23", "POCCPUД-PU.PA01.B.{k}/23"), ("РОСС RU Д-РУ.РА01.В.{k}/23", "POCCPUД-PU.PA01.B.{k}/23"))
golden(
    "requirements", lambda c: _parts(cells.requirement(c), "kind", "lo", "hi", "unit", doubles=("lo", "hi")),
    ("4 ± 0,2 мм", "range|3.8|4.2|мм"), ("не менее {k}\nпо ГОСТ", "min|{k}.0|-|по"), ("до 3, не более {k}\n", "max|-|{k}.0|-"), ("4 +/- 0,2", "range|3.8|4.2|-"), ("800 +200/-100", "range|700.0|1000.0|-"), ("от {d} до 1{k} МПа", "range|{d}.0|1{k}.0|МПа"), ("3…5", "range|3.0|5.0|-"), ("3 — 5", "range|3.0|5.0|-"),
    ("не менее 3, не более 5 %", "range|3.0|5.0|%"), ("не ниже {k}", "min|{k}.0|-|-"), ("≤ 0,5 мм", "max|-|0.5|мм"), ("не превышает 2", "max|-|2.0|-"), ("4,25 кг", "exact|4.25|4.25|кг"), ("по проекту", "unparsed|-|-|-"), ("", "unparsed|-|-|-"),
    ("М-150", "unparsed|-|-|-"),
)
golden("measured_values", lambda c: tx.plain_number(cells.measured(c)), ("факт {k},5 мм", "{k}.5"), ("({k})", "{k}.0"), ("соответствует", None), ("М150", None), ("-3", "-3.0"))
golden(
    "norms_against_facts", lambda c: cells.compared(cells.requirement(F.substring_index(c, ";", 1)), cells.measured(F.substring_index(c, ";", -1))),
    ("{k};{k}.4", "ok"), ("{k};{k}.6", "violated"), ("4,25;4,254", "ok"), ("4,25;4,26", "violated"), ("не менее 3;2,9", "violated"), ("3…5;5", "ok"), ("по проекту;5", "undecidable"), ("3;нет", "undecidable"),
)
golden(
    "norm_rows", lambda c: F.array_join(F.transform(cells.norm_rows(c), lambda r: F.concat_ws("/", r["indicator"], r["norm"], r["fact"])), "|"),
    ('[{"name": "толщина", "норма": "4", "fact": 4.1}, {"indicator": "x"}]', "толщина/4/4.1"), ("[]", ""), ("нет", None),
)
golden("printed_dates", cells.printed_date, ("31.02.2024", None), ("{d}.{m}.2024", "2024-{mm}-{dd}"), ("«{d}» мая 2026 г.", "2026-05-{dd}"), ("от 9 марта 2026", "2026-03-09"), ("30 февраля 2024", None), ("скоро", None))
golden(
    "number_cells", lambda c: _parts(cells.number_cell(c), "number", "valid_from", "valid_to", "issued_at", "comparable"),
    ("№RU.MCC.{k} с {d}.10.2024 по 01.{m}.2028", "RU.MCC.{k}|2024-10-{dd}|2028-{mm}-01|-|true"), ("№{k}/48 от; {dd}.10.2024", "{k}/48|-|-|2024-10-{dd}|true"), ("б/н от 01.02.2025", "б/н|-|-|2025-02-01|false"), ("; ", "-|-|-|-|false"), ("№ 5 от 31.04.2026", "5|-|-|-|true"),
)
golden("date_cells", lambda c: _parts(cells.date_cell(c), "valid_from", "valid_to", "issued_at"), ("{dd}.12.2024 г.", "-|-|2024-12-{dd}"), ("01.01.2024 31.12.2025", "2024-01-01|2025-12-31|-"), ("c 1.2.2024 по 1.3.2024", "2024-02-01|2024-03-01|-"), ("31.04.2026", "-|-|-"))
golden("sheet_counts", cells.count_cell, ("{dd} шт.", "{d}"), ("3", "3"), ("1{k}0000", None), ("5 л", None))
golden("observed_titles", tx.observed_title, ("| **Акт №{k}** от {dd}.02.2024 |", "АКТ"), ("# 1. Паспорт насоса {k}.", "ПАСПОРТ НАСОСА {k}"), ("№ 5", "№ 5"), ("Журнал учёта 12.05.2026", "ЖУРНАЛ УЧЕТА"), ("--", ""))
golden("registry_names", tx.registry_name, ("Сертификат; качества;; А{k}", "Сертификат качества А{k}"), (" a  b ", "a b"))
golden("person_keys", tx.person_key, ("Иванов Иван Петрович", "ИВАНОВИП"), ("Иванов И.П.", "ИВАНОВИП"), ("  ", ""), ("Петров-Водкин К. С.", "ПЕТРОВВКС"), ("Ёлкин, {k} Пётр", "ЕЛКИНП"))
golden("organisation_keys", tx.org_key, ("ООО «Вектор-М» {k}", "OOOBEKTOPM{k}"), ("АО Мост", "AOMOCT"))
golden("phrases", tx.phrase, ("Ёмкость № {k}", "ЕМКОСТЬ{k}"), ("a-b", "AB"))
golden("marks", tx.mark, ("А{k}С", "A{k}C"), ("СТУ-1", "CTU1"), ("CTU-1", "CTU1"), ("Ст. 3-сп", "CT3CП"))
golden("standards", lambda c: F.concat_ws("|", tx.standard_without_year(c), tx.standard_year(c)), ("СТО {k} - 005-2015", "CTO {k}-005|2015"), ("ГОСТ 5781-82", "ГOCT 5781-82"), ("ТУ 14-1-2011 (изм. 1)", "TU 14-1|2011"))
golden(
    "error_templates", tx.error_template,
    ("at 2024-01-02T03:04:05Z id {k} of 'bob'", "at <timestamp> id <n> of <value>"), ('relation "page_assignments" does not exist', 'relation "page_assignments" does not exist'), ("column 'a b' is null", "column <value> is null"),
    ("Key (id)=({k}) exists «x»", "Key (id)=(<value>) exists <value>"), ("00112233445566778899  t1 $2", "<hex> t1 $2"), ("x" * 305, "x" * 300 + "…"),
)
golden("sql_templates", tx.sql_template, ("SELECT * FROM t\n WHERE a IN (1, {k}, 3) AND b = 'x''y' AND c = $2", "SELECT * FROM t WHERE a IN (?) AND b = ? AND c = ?"))
golden("sql_verbs", tx.sql_verb, ("  Update t set a=1", "update"), ("BEGIN", "other"), ("with x as (select 1) select 1", "with"))
golden("path_templates", tx.path_template, ("/api/works/{k}/files?x={k}", "/api/works/:id/files"), ("/r/0b5e1f6a-1111-2222-3333-444455556666", "/r/:id"), ("/v1/a{k}", "/v1/a{k}"))
golden("redacted_links", lambda c: F.concat_ws("|", tx.redact_urls(c)[0], tx.redact_urls(c)[1].cast("string")), ("see https://a.b/{k}?d and http://x.y)", "see [link] and [link])|2"), ("none {k}", "none {k}|0"))
golden("filled_templates", lambda c: tx.filled(c, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))), ("{a}+{b}={c} {k}", "1+2={c} {k}"), ("", ""))
golden("clipped_texts", lambda c: tx.clip(c, 5), ("abcd{k}00", "abcd…"), ("abcde", "abcde"))
golden("column_letters", lambda c: tx.column_letter(c.cast("int")), ("0", "A"), ("25", "Z"), ("26", "AA"), ("701", "ZZ"), ("702", "AAA"))
golden("escaped_xml", tx.escape_xml, ('<a b="c">&\'', "&lt;a b=&quot;c&quot;&gt;&amp;&apos;"), ("x\x01y", "xy"))
golden("six_decimals", lambda c: tx.six_decimals(c.cast("double")), ("-0.0000001", "0.000000"), ("0.1234567", "0.123457"), ("{k}", "{k}.000000"), ("-2", "-2.000000"))
golden("taxpayer_faults", tx.digits_verdict, ("7707083893", None), ("7707083894", "checksum"), ("77070838", "length"), ("{k}", "length"), ("77O", "not_digits"), ("", "empty"), ("500100732259", None))
golden("registration_numbers", tx.ogrn_ok, ("1027700132195", "true"), ("1027700132196", "false"), ("{k}", "false"), ("304500116000157", "true"), (None, None))
golden("kpp_shapes", tx.kpp_ok, ("770801001", "true"), ("77080100", "false"), ("{dd}0801001", "true"))
golden("strengths", lambda c: cells.strength_percent(F.nullif(F.split(c, ";")[0], F.lit("")).cast("double"), F.split(c, ";")[1].cast("double"), F.split(c, ";")[2].cast("double")), ("95;1;2", "95.0"), (";30;40", "75.0"), (";30;0", None))
golden("plain_lines", lambda c: F.array_join(tx.lines(c), "|"), ("## Title {k}\n\n- one\n1. two\n| **x**  y |\n> # q", "Title {k}|one|1. two|x y|q"))
golden("backoffs", lambda c: tx.backoff_ms(c.cast("int")), ("1", "5000"), ("3", "20000"), ("1{k}", "600000"), ("9", "600000"))
