"""Faults that only larger tables or odd texts show."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import cells, text as tx

DIR = "/root/testdata/sf0.001"


def test_large_numbers_have_no_exponent(spark):
    given = [10000000.0, 18999999.0, 12345678.25, -10000000.0, 0.00001, 3.8, 1.0]
    df = spark.createDataFrame([(x,) for x in given], "x double")
    assert [r[0] for r in df.select(tx.plain_number(F.col("x"))).collect()] == ["10000000.0", "18999999.0", "12345678.25", "-10000000.0", "0.00001", "3.8", "1.0"]
    norm = spark.createDataFrame([("12345678,25", "12345678,5"), ("12345678,25", "12345678,254")], "norm string, fact string")
    assert [r[0] for r in norm.select(cells.compared(cells.requirement(F.col("norm")), cells.measured(F.col("fact")))).collect()] == ["violated", "ok"]


def test_requisites_do_not_join_page_texts(spark):
    from sluice.plans.catalog import QUERIES

    plan = QUERIES["requisites"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join " in x and "page#" in x]


def test_marks_in_texts_are_no_hits(spark):
    from sluice.operators import fields

    text = "№ 5\x01\x02 от 01.02.2024; ГОСТ 1-\x012 ГОСТ 1"
    df = spark.createDataFrame([(1, 1, text)], "doc int, page int, text string")
    got = {(r.code, r.value, text[r.char_start : r.char_end]) for r in fields.field_hits(df, fields.BASE).collect()}
    assert {("number", "5\x01\x02", "5\x01\x02"), ("gost_tu", "ГОСТ 1-", "ГОСТ 1-"), ("gost_tu", "ГОСТ 1", "ГОСТ 1")} <= got


def test_quotes_of_doubled_marks(spark):
    from sluice.operators.segmentation import locate_quote

    given = [("a\nfoo ||\nb", "foo ||\nb"), ("x foo |_|", "foo |_|"), ("foo |\u00a0\nbar", "foo |\u00a0\nbar"), ("foo|\u2028\nbar", "foo|\u2028\nbar"), ("x", None), (None, "x"), ("a b", "  ")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "i int, text string, quote string").select("i", locate_quote(F.col("text"), F.col("quote")).alias("s")).orderBy("i")
    assert [r.s and given[r.i][0][r.s.char_start : r.s.char_end] for r in df.collect()] == ["foo ||\nb", "foo", "foo |\u00a0\nbar", "foo|\u2028\nbar", None, None, None]


def test_located_quotes_of_odd_texts(spark, tmp_path):
    from sluice.plans.catalog import QUERIES

    texts = ["| - foo bar", "x|---|---| a", "`#tag and", "foo ||", None, "", "> | > foo"]
    rows = [(7 * i if i else None, t) for i, t in enumerate(texts)] + [(50 * i, t) for i, t in enumerate(texts, 9)] + [(50 * i + 1, t) for i, t in enumerate(texts, 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.same for r in QUERIES["located_quotes"](spark, str(tmp_path)).collect()} == {True}


def test_cells_of_registers_are_read_once(spark):
    from sluice.operators import registries

    pages = spark.createDataFrame([(1, 1, "x")], "doc int, page int, text string")
    for rows in (registries.transfer_rows(registries.transfer_records(pages)), registries.annex_rows(registries.annex_records(pages))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") <= 4 and plan.count("translate(") <= 4


def test_odd_cells_read_as_before(spark):
    given = ["№№ 5; ", " №5", "№ №5", "б/н", "Б.Н.", "", ";:", "a  b", "5 с 01.02.2024 по 30.02.2024", "5 от 1.2.2024", "по 1.2.2024 по 2.2.2024", None]
    df = spark.createDataFrame([(x,) for x in given], "x string").select(cells.number_cell(F.col("x")).alias("n"), cells.transfer_date_cell(F.col("x")).alias("d"), tx.doc_no(F.lower("x")).alias("k")).collect()
    assert [r.n.number for r in df] == ["5", "№5", "№5", "б/н", "б/н", None, None, "a b", "5", "5", "по 1.2.2024 по 2.2.2024", None]
    assert [r.n.comparable for r in df] == [True, True, True, False, False, False, False, True, True, True, True, None]
    assert [str(r.d.valid_from) for r in df][8:11] == ["2024-02-01", "None", "2024-02-01"] and str(df[9].d.issued_at) == "2024-02-01"
    assert [r.k for r in df] == ["5", "5", "5", "Б/Н", "Б.Н.", "", ":", "AB", "5С01.02.2024ПО30.02.2024", "5ОТ1.2.2024", "ПО1.2.2024ПО2.2.2024", None]


def test_register_pages_end_lines_in_two_ways(spark):
    from sluice.operators import registries

    got = [list(registries.blocks(text)) for text in (" | **a** | b |\r\n|---|:-:|\n|x| ", "|\n||\n**T**")]
    assert got == [[("table", (["a", "b"], [["x"]]))], [("table", (None, [[""]])), ("bold", "T")]]


def test_rows_are_joined_once_with_their_spellings(spark):
    from sluice.operators import matching

    rows = spark.createDataFrame([(1, "A-1"), (2, "А-1"), (3, "A-2"), (4, "x"), (5, None), (6, "№")], "row_id int, number string")
    docs = spark.createDataFrame([(10, "A-1"), (11, "А-2"), (12, "Х"), (13, "Х"), (14, "")], "document_id int, number string")
    out = matching.match_rows(rows, docs)
    assert sum(x.lstrip(" :+-").startswith("Join ") for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
    assert [tuple(r) for r in out.orderBy("row_id").collect()] == [(1, "matched", 1.0, 10), (2, "matched", 0.85, 10), (3, "matched", 0.85, 11), (4, "ambiguous", None, None), (5, "missing", None, None), (6, "missing", None, None)]


def test_tables_are_cut_inside_their_row(spark):
    from sluice.operators import documents

    texts = ["|a|\n|-|\n|x|\n\n|--|\n|y|\n|-|", "no", "", None, "|z|\r\n|b|", "||", "|a|b|\n|-|-|\n|c|\ntext\n|d|"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows, runs = documents.table_rows(df, "id", "text"), documents.table_runs(df, "id", "text")
    for out in (rows, runs):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan
    assert [r.kind[0] for r in rows.where("id = 0").orderBy("start", "row_no").collect()] == list("hsdsdd")
    assert sorted(tuple(r) for r in runs.collect()) == [(0, 0, 3, 1, True, 1), (0, 4, 3, 1, False, 2), (4, 0, 2, 1, False, 2), (5, 0, 1, 1, False, 1), (6, 0, 3, 2, True, 1), (6, 4, 1, 1, False, 1)]


def test_archives_are_matched_inside_their_row(spark):
    from sluice.operators import recognition

    layout = '{"pages":[{"page_index":0,"width_px":1,"height_px":2,"rotation":0},{"page_index":2,"width_px":3,"height_px":4,"rotation":0}],"blocks":[{"block_id":"a","ordinal":1,"page_index":0,"block_type":"text"},{"block_id":"b","ordinal":1,"page_index":0,"block_type":"image","coords_norm":[0,0,1,1]},{"block_id":"s","page_index":0,"block_type":"stamp"},{"block_id":"t","page_index":2,"block_type":"stamp"},{"block_id":"u","ordinal":5,"page_index":2,"block_type":"text"}]}'
    md = "**Stamp:** Code: own\n## Page 1\n### BLOCK #1 [TEXT]: m\none\n### BLOCK #2 [TEXT]: n\ntwo\n> **Stamp:** Code: x\n## Page 1\nagain\n## Page 99999999999\n> **Stamp:** Code: y"
    given = spark.createDataFrame([(1, md, layout), (2, md, None), (3, None, layout), (4, "", "no json"), (5, "## Page 1", '{"pages":[]}')], "doc int, markdown string, layout string")
    out = recognition.canonical_pages(given)
    for df in out.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
    pages = sorted(((r.doc, r.page_index, r.width, r.text) for r in out["pages"].collect()), key=str)
    assert pages == sorted([(1, 0, 1, "one\ntwo"), (1, 0, 1, "again"), (1, 2, 3, ""), (2, 0, None, "one\ntwo"), (2, 0, None, "again"), (2, None, None, ""), (3, 0, 1, ""), (3, 2, 3, ""), (5, 0, None, "")], key=str)
    blocks = sorted(((r.doc, r.page_index, r.kind, r.place, r.block_id, r.coords, r.text, r.stamp and r.stamp.code) for r in out["blocks"].collect()), key=str)
    assert blocks == sorted([
        (1, 0, "text", 0, "b", [0.0, 0.0, 1.0, 1.0], "one", None), (1, 0, "text", 1, "n", None, "two", None), (1, 0, "stamp", 1_000_000, "s", None, None, "x"), (1, 0, "stamp", 1_000_000, "s", None, None, "own"), (1, 2, "stamp", 1_000_000, "t", None, None, "own"),
        (2, 0, "text", 0, "m", None, "one", None), (2, 0, "text", 1, "n", None, "two", None), (3, 0, "stamp", 1_000_000, "s", None, None, None), (3, 2, "stamp", 1_000_000, "t", None, None, None),
    ], key=str)
    faults = sorted(((r.doc, r.page_index, r.code, r.n) for r in out["faults"].collect()), key=str)
    assert faults == sorted([(1, 0, "page_twice", 2), (1, None, "page_not_in_layout", 1), (1, 2, "page_missing", 1), (1, None, "stamp_lines_dropped", 1), (2, 0, "page_twice", 2), (2, 0, "stamp_lines_dropped", 1), (2, None, "stamp_lines_dropped", 1), (3, 0, "page_missing", 2), (3, 2, "page_missing", 1)], key=str)


def test_marked_values_of_kinds_without_markers_are_not_cut(spark):
    from sluice.operators import privacy

    df = spark.createDataFrame([(1, "ИНН 7712345678, подписал ИВАНОВ"), (2, None)], "id int, text string")
    digest = F.sha2(F.concat(F.lit("s"), F.col("value")), 256)
    marked = lambda *rows: spark.createDataFrame(rows, "kind string, value string").select("kind", digest.alias("digest"))
    out = privacy.scan(df, "id", "text", marked(("id", "7712345678"), ("other", "x")), "s", slow=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "surname" not in plan and "strategy=broadcast" in plan
    assert [tuple(r) for r in out.collect()] == [(1, "id", "7712345678")]
    assert privacy.scan(df, "id", "text", marked(("other", "x")), "s").collect() == []
    assert [tuple(r) for r in privacy.scan(df, "id", "text", marked(("surname", "ванов")), "s").collect()] == [(1, "surname", "ванов")]


def test_kinds_with_many_markers_are_found_too(spark, monkeypatch):
    from sluice.operators import privacy

    monkeypatch.setattr(privacy, "FEW", 1)
    df = spark.createDataFrame([(1, "7712345678 1234567890 ИВАНОВ")], "id int, text string")
    digest = F.sha2(F.concat(F.lit("s"), F.col("value")), 256)
    markers = spark.createDataFrame([("id", "7712345678"), ("id", "1234567890"), ("surname", "иванов")], "kind string, value string").select("kind", digest.alias("digest"))
    assert sorted(r.value for r in privacy.scan(df, "id", "text", markers, "s", slow=False).collect()) == ["1234567890", "7712345678", "иванов"]


def test_pieces_are_cut_from_runs_in_lower_case(spark):
    from sluice.operators import privacy

    df = spark.createDataFrame([("ab ABCD abcd ABCDE", "abc"), (None, None), ("x", "")], "t string, u string")
    got = df.select(F.sort_array(privacy.windows(F.col("t"), "[a-zA-Z]+", (3, 5))).alias("w"), privacy.windows(F.col("t"), "[a-zA-Z]+", (3, 5)).alias("x"))
    assert [r.w for r in got.collect()] == [["abc", "abcde", "bcd", "cde"], None, []]
    assert got.select("x")._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_documents_classify_their_pages_once(spark):
    from sluice.plans.catalog import QUERIES

    plan = QUERIES["decoded_documents"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "копия верна" not in plan


def test_detections_stay_where_their_pages_are_dealt_to(spark):
    from sluice.plans.catalog import QUERIES
    from sluice.sources.tables import dealt

    plan = QUERIES["detection_counts"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0
    assert dealt(spark.range(1000), 10, "id").rdd.getNumPartitions() == 100


def test_flags_need_one_shuffle(spark):
    from sluice.operators import geometry

    t = {"side": 0.001, "tiny": 0.01, "overlap": 0.5, "blank": 0.05, "low": 0.2, "neighbours": 2, "change": 0.5, "stamp": 1}
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (None, 5), (2, None)], "doc int, page int")
    blocks = spark.createDataFrame([(1, 0, "text", 0.0, 0.0, 0.5, 0.5), (1, 0, "text", 0.25, 0.25, 0.5, 1.0), (1, 0, None, 0.9, 0.9, 0.9, 1.0), (1, 7, "text", 0.0, 0.0, 1.0, 1.0), (None, 5, "text", 0.0, 0.0, 1.0, 1.0)], "doc int, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    out = geometry.page_flags(pages, blocks, "doc", "page", t)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(((r.doc, r.page, r.coverage, r.n_blocks) for r in out.collect()), key=str) == sorted([(1, 0, 0.375, 3), (1, 1, 0.0, 0), (1, 1, 0.0, 0), (None, 5, 0.0, 0), (2, None, 0.0, 0)], key=str)


def test_covered_area_of_odd_boxes(spark):
    from sluice.operators import geometry

    boxes = [(1, 0.0, 0.0, 2.0, 1.0), (1, 1.0, 0.0, 3.0, 2.0), (1, 0.5, 0.0, 1.5, 0.5), (2, 1.0, 0.0, 1.0, 5.0), (3, 2.0, 0.0, 1.0, 1.0), (4, None, 0.0, 1.0, 1.0), (5, 0.0, 3.0, 1.0, 2.0), (5, 0.0, 2.5, 1.0, 4.0), (None, 0.0, 0.0, 1.0, 1.0)]
    out = geometry.union_area(spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double"), "page")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 5.0), (5, 1.5)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
