"""Pages to documents, registers, archives, and the cells and shapes that queries over tables don't hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sluice.functions import cells, text as tx
from sluice.operators import detection, documents, matching, privacy, recognition, registries, relational, segmentation
from sluice.plans import scalars

PAGE = "revision int, ordinal int, page int, file int, rotation int, text string, blocks array<string>, manual struct<label:string,doc_type:string,role:string>"


def pages(spark, *texts, blocks=("text",)):
    return spark.createDataFrame([(1, i, i, 1, 0, t, list(blocks), None) for i, t in enumerate(texts)], PAGE)


def given(case, k):
    held = {"{k}": str(k), "{d}": str(1 + k % 28), "{m}": str(1 + k % 12), "{dd}": f"{1 + k % 28:02}", "{mm}": f"{1 + k % 12:02}"}
    for a, b in held.items():
        case = case.replace(a, b) if case is not None else None
    return case


@pytest.mark.parametrize("name", sorted(scalars.GOLDEN))
def test_cells(spark, name):
    f, cases = scalars.GOLDEN[name]
    rows = [(given(a, k), given(b, k)) for a, b in cases for k in (3, 40)]
    out = spark.createDataFrame(rows, "given string, want string").select("want", f(F.col("given")).cast("string").alias("got")).collect()
    assert all(r.got == r.want for r in out), [tuple(r) for r in out if r.got != r.want]


def test_look_alikes_fold_both_alphabets(spark):
    r = spark.range(1).select(tx.mark(F.lit("СТУ-1")).alias("a"), tx.mark(F.lit("CTU-1")).alias("b"), tx.person_key(F.lit("Петров-Водкин К. С.")).alias("p")).first()
    assert r.a == r.b == "CTU1" and r.p == "ПЕТРОВВКС"


def test_bounds_run_over_lines(spark):
    r = spark.range(1).select(cells.requirement(F.lit("не менее 3\nпо ГОСТ")).alias("r")).first().r
    assert (r.kind, r.lo, r.unit) == ("min", 3.0, "по")


def test_types_windows_fallbacks_and_alternatives(spark):
    types = (
        documents.DocType("late", 3, ("акт",), heading_lines=5), documents.DocType("low", 1, ("акт",)), documents.DocType("top", 5, ("акт",)), documents.DocType("twin", 5, ("акт",)),
        documents.DocType("deep", 2, ("глубокий",), heading_lines=30), documents.DocType("any", 9, (".",), fallback=True),
    )
    text = "\n".join([f"строка {i}" for i in range(11)] + ["Акт"] + ["x"] * 12 + ["Глубокий"])
    df = spark.createDataFrame([(1, text)], "id int, text string")
    r = documents.resolve_types(documents.match_types(df, "id", "text", types), "id").first()
    assert (r.code, r.state, list(r.alternatives)) == ("top", "ambiguous", ["twin", "late", "deep", "low"])


# ---------------------------------------------------------------- segmentation
TYPES = (documents.DocType("act", 5, ("акт",)), documents.DocType("cert", 5, ("сертификат соответствия",)))
ROLES = (documents.PageRole("annex_continuation", (r"^приложение к сертификату № (\S+)",), attaches=True), documents.PageRole("doc_continuation", (r"лист \d+ из \d+",), attaches=True), documents.PageRole("copy_stamp", ("копия верна",), attaches=True))


def labels(spark, *texts, blocks=("text",)):
    return [(r.label, r.rung) for r in segmentation.classify_pages(pages(spark, *texts, blocks=blocks), TYPES, ROLES).orderBy("ordinal").collect()]


def test_ladder_prefers_counters_to_headings(spark):
    got = labels(spark, "АКТ № 1\nЛист 2 из 3", "АКТ № 1\nЛист 1 из 3", "Лист 1 из 3", "СЕРТИФИКАТ\nСООТВЕТСТВИЯ", "Сертификат\nсоответствия", "АКТ СВЕРКИ", "Перечень:\nАКТ № 5", None)
    assert got == [("I-DOC", "counter"), ("B-DOC", "anchor"), ("U", "none"), ("B-DOC", "glued"), ("B-DOC", "unknown_heading"), ("B-DOC", "anchor"), ("U", "none"), ("U", "none")]
    assert labels(spark, "", blocks=("image",)) == [("U", "image_only")]
    assert labels(spark, "x", blocks=("image", "stamp")) == [("B-DOC", "blocks")]


def test_places_are_those_of_the_raw_text(spark):
    text = "\r\n  ## **АКТ № 7** |\r\nтело"
    r = segmentation.classify_pages(pages(spark, text), TYPES, ROLES).first()
    assert text[r.char_start : r.char_end] == r.title == "АКТ № 7"


def decoded(spark, *texts):
    classified = segmentation.classify_pages(pages(spark, *texts), TYPES, ROLES)
    out = segmentation.decode(classified, ROLES)
    assert segmentation.unaccounted(classified, out).count() == 0
    return [(r.document, r.place, r.reason) for r in out.orderBy("ordinal").collect()]


def test_decoding(spark):
    assert decoded(spark, "Лист 2 из 3", "АКТ № AB-12345 от 1.2.2024", "Приложение к сертификату № AB-1234", "Приложение к сертификату № AB-99", "КОПИЯ ВЕРНА", "КОПИЯ ВЕРНА\nАКТ") == [
        (None, None, "continuation_before_documents"), (1, 1, None), (1, 2, None), (None, None, "parent_not_named"), (None, None, "role_apart"), (2, 1, None)]
    assert decoded(spark, "АКТ\n| a | b |\n|---|---|\n| 1 | 2 |", "| | |\n|---|---|\n| 3 | 4 |", "| x | y |\n|---|---|", "| 5 | 6 |", "| 7 |") == [
        (1, 1, None), (1, 2, None), (None, None, "no_signal"), (None, None, "no_signal"), (None, None, "no_signal")]
    # without any number on its pages a document takes an annex that follows directly
    assert decoded(spark, "АКТ", "Приложение к сертификату № 5", "текст", "Приложение к сертификату № 5") == [(1, 1, None), (1, 2, None), (None, None, "no_signal"), (1, 3, None)]


def test_a_revision_in_several_batches_is_one_stream(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert decoded(spark, "АКТ", *["Лист 2 из 3"] * 6) == [(1, i, None) for i in range(1, 8)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_quotes(spark):
    text = "# **Акт** осмотра\n| a  b |\nконец.txt (1)"
    cases = [("Акт осмотра a b", "Акт** осмотра\n| a  b"), ("конец.txt (1)", "конец.txt (1)"), ("конецxtxt", None), ("  ", None), ("осмотра\n> a", "осмотра\n| a"), (None, None)]
    df = spark.createDataFrame([(i, text, q) for i, (q, _) in enumerate(cases)], "id int, text string, q string")
    for r in df.select("id", segmentation.locate_quote(F.col("text"), F.col("q")).alias("s")).collect():
        assert (text[r.s.char_start : r.s.char_end] if r.s else None) == cases[r.id][1]


# ---------------------------------------------------------------- registers
def annex(spark, *texts):
    records = registries.annex_records(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, page int, text string"))
    rows = [(r.row_no, r.continuation, r.section, r.name, r.number, str(r.issued_at) if r.issued_at else None) for r in registries.annex_rows(records).orderBy("seq").collect()]
    return rows, sorted((r.code, r.row_no, r.detail) for r in registries.annex_warnings(records).collect())


HEAD = "| № п/п | Наименование документа | Номер документа | Организация |\n|---|---|---|---|"


def test_annex_register_over_pages(spark):
    rows, said = annex(spark, f"**Объект**\n{HEAD}\n| 1 | Паспорт | №5 от 01.02.2024 | Завод |\n| | хвост | | |\n| | Сертификат | С-7 | |", "**Качество**\n| | | | |\n|---|---|---|---|\n| 3 | Акт | б/н | |\n| 3 | Акт | | |", "нет таблиц", f"{HEAD}\n| 9 | Новый | Н-1 | |")
    assert rows == [(1, False, None, "Паспорт", "5", "2024-02-01"), (1, True, None, "Сертификат", "С-7", None), (3, False, "Качество", "Акт", "б/н", None), (3, False, "Качество", "Акт", None, None), (9, False, None, "Новый", "Н-1", None)]
    assert said == sorted([("cell_tail", None, "хвост"), ("no_number", 3, None), ("position_repeated", 3, "Качество"), ("register_closed", None, None), *[("position_missing", n, None) for n in range(2, 9)]], key=str) or set(said) == {
        ("cell_tail", None, "хвост"), ("no_number", 3, None), ("position_repeated", 3, "Качество"), ("register_closed", None, None), *[("position_missing", n, None) for n in range(2, 9)]}


def test_annex_register_without_a_recognised_header(spark):
    rows, said = annex(spark, "| 1 | Паспорт | 5 |\n| 2 | Акт | 6 |")
    assert rows == [] and said == [("header_not_recognised", None, None)]


def transfer(spark, *texts):
    return registries.transfer_records(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, page int, text string"))


FORM_B = "| № п/п | Наименование документов | № документа | Дата | Кол-во листов | Страница по списку |\n|---|---|---|---|---|---|"


def test_transfer_register_form_b(spark):
    records = transfer(spark, f"Реестр № 5-К\n{FORM_B}\n| | Работы; бетон (ООО Мост) | | | | |\n| 1.1 | АОСР | | 01.02.2024 | 2 | 1-2 |\n| 1.2 | Акт освидетельствования | №7 | 02.2024 | 3 шт. | 3 |\n**Сдал:**\n| 9 | после | 1 | | 1 | 1 |", f"{FORM_B}\n| 2 | и на других страницах | 1 | | 1 | 1 |")
    g = registries.transfer_groups(records).first()
    assert (g.title, g.contractor, g.act_number, g.act_row) == ("Работы бетон", "ООО Мост", "7", 1)
    assert [(r.row_no, r.sheets, r.month_only) for r in registries.transfer_rows(records).orderBy("ord").collect()] == [("1.1", 2, False), ("1.2", 3, True)]
    assert {r.code for r in registries.transfer_warnings(records).collect()} == {"date_without_day"}
    assert registries.transfer_heads(records).first().registry_no == "5-К"


def test_transfer_register_limits(spark):
    class Small(registries._Transfer):
        def __init__(self):
            super().__init__(max_rows=2, max_groups=1)

    form_a = "| № п/п | Наименование | Номер | Кол-во экз. |\n|---|---|---|---|"
    df = spark.createDataFrame([(1, 0, f"{form_a}\n| 1 | A | 1 | 1 |\n| | b | 2 | 1 |\n| | c | 3 | 1 |"), (2, 0, f"{form_a}\n| 1 | A | 1 | 1 |\n| 2 | B | 2 | 1 |"), (3, 0, "без шапки")], "doc int, page int, text string")
    schema = registries.transfer_records(df).schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ")
    kinds = [(r.doc, r.kind) for r in registries._streamed(df, Small, schema).orderBy("doc", "seq").collect()]
    assert kinds == [(1, "head"), (1, "group"), (1, "row"), (1, "row"), (1, "too_many_rows"), (2, "head"), (2, "group"), (2, "row"), (2, "too_many_groups"), (3, "head")]


def test_groups_are_narrowed_by_contractor(spark):
    groups = spark.createDataFrame([(1, 0, "A1", "A1", "t", "ООО Мост-Строй"), (1, 1, "A1", "A1", "t", "Другой"), (1, 2, None, None, "Бетон ", None), (1, 3, "Z", "Z", "нет", None), (2, 0, "A1", "A1", "t", None)], "doc int, ord int, act_norm string, act_folded string, title string, contractor string")
    works = spark.createDataFrame([(1, 10, "мост-строй", "x", ["a1", "A-1"]), (1, 11, None, "y", ["A1", "№ A1"]), (1, 12, "z", "БЕТОН", None)], "doc int, work int, contractor string, title string, numbers array<string>")
    got = {(r.doc, r.ord): (r.state, r.score, r.work) for r in matching.match_groups(groups, works).collect()}
    assert got == {(1, 0): ("matched", 0.8, 10), (1, 1): ("ambiguous", None, None), (1, 2): ("matched", 0.9, 12), (1, 3): ("missing", None, None), (2, 0): ("missing", None, None)}
    assert {r.work for r in matching.named_works(groups, works).collect()} == {10, 11, 12}


def test_empty_registers(spark):
    none = spark.createDataFrame([], "doc int, page int, text string")
    assert registries.annex_rows(registries.annex_records(none)).count() == 0
    assert registries.transfer_groups(registries.transfer_records(none)).count() == 0


# ---------------------------------------------------------------- the rest
def test_image_sections(spark):
    lines = ["before", "**[IMAGE]** Type: plan | Zone:", "lost", "**Description:** one", "", "two", "**Entities:** a, ,b", "lost", "**Description:** three"]
    r = spark.range(1).select(recognition.image_fields(F.array(*map(F.lit, lines))).alias("i")).first().i
    assert (r.image_type, r.zone, r.description, r.entities, r.summary) == ("plan", None, "one\ntwo\nthree", ["a", "b"], None)


def test_stamp_fields(spark):
    r = spark.range(1).select(recognition.stamp_fields(F.lit("Code: a | CODE: b:c | X: 1 | x | : y | Z:")).alias("s"), recognition.stamp_fields(F.lit(None).cast("string")).alias("n")).first()
    assert (r.s.code, r.s.extra) == ("b:c", {"X": "1"}) and r.n.code is None and r.n.extra == {}


def test_scan_with_slow_digests(spark):
    import hashlib

    salt = "s"
    slow = hashlib.scrypt(b"1234567890", salt=b"s", n=2**15, r=8, p=1, maxmem=192 << 20, dklen=32).hex()
    fast = hashlib.sha256("sиванов".encode()).hexdigest()
    markers = spark.createDataFrame([("id", slow), ("surname", fast)], "kind string, digest string")
    texts = spark.createDataFrame([(1, "ИНН 1234567890, Иванов"), (2, "91234567890 ИВАНОВА"), (3, None), (4, "нет")], "id int, text string")
    got = sorted((r.id, r.kind, r.value) for r in privacy.scan(texts, "id", "text", markers, salt, names=("нет",)).collect())
    assert got == [(1, "id", "1234567890"), (1, "surname", "иванов"), (2, "id", "1234567890"), (2, "surname", "иванов"), (4, "org", "нет")]


def test_canonical_json(spark):
    rows = ['{"b":1.0,"a":[{"z":null,"y":"q"}]}', '{"a": [ {"y": "q", "z": null} ], "b": 1}', "nope", None, '{"a":1,"a":2}']
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(tx.canonical_json(F.col("x")).alias("c")).collect()]
    assert got == ['{"a":[{"y":"q","z":null}],"b":1}'] * 2 + [None] * 3


def test_detection_without_extent_and_ties(spark):
    pages_ = spark.createDataFrame([(1, 0, 100, 1), (2, 100, 100, 1)], "page int, width int, height int, tiles int")
    boxes = spark.createDataFrame([(p, i, "text", 0, 0, 100, 100, 0.0, 0.0, 0.95, 0.95, 0.9) for p in (1, 2) for i in (1, 2)], "page int, id int, kind string, tx int, ty int, tw int, th int, x0 double, y0 double, x1 double, y1 double, score double")
    assert [(r.page, r.x1) for r in detection.detect_pages(pages_, boxes, {}, 0.5).collect()] == [(2, 0.95)]


def test_long_chains_and_cycles(spark):
    n = 3000
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") % 1000 > 0, F.col("id") - 1).alias("parent"))
    out = relational.ancestor_chain(chain, "node", "parent")
    assert out.count() == 3 * 1000 * 1001 // 2 and out.agg(F.max("depth")).first()[0] == 999
    with pytest.raises(ValueError):
        relational.ancestor_chain(spark.createDataFrame([(1, 2), (2, 1)], "node int, parent int"), "node", "parent")
