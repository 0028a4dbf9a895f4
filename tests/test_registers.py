"""What registers shuffle, and their reconciliation on odd inputs."""

from __future__ import annotations

import datetime
import time
from pathlib import Path

from pyspark.sql import functions as F

from sluice.operators import matching, registries
from sluice.plans.catalog import QUERIES

DIR = "/root/testdata/sf0.001"
DAY, LATER = datetime.date(2024, 1, 1), datetime.date(2024, 2, 1)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def joins(df) -> int:
    return sum(x.lstrip(" :+-").startswith("Join ") for x in optimized(df).splitlines())


def test_register_pages_are_shuffled_as_lines(spark):
    for name in ("transfer_registers", "annex_registers"):
        plan = optimized(QUERIES[name](spark, DIR))
        assert "MapInArrow" in plan and "RepartitionByExpression" not in plan
        #: only the table itself names what would break ties
        assert plan.count("l_extendedprice") == 1


def test_verdicts_take_registers_from_stored_orders(spark):
    assert "l_orderkey" not in optimized(QUERIES["register_verdicts"](spark, DIR))


def test_groups_meet_their_candidates_once(spark):
    groups = spark.createDataFrame([(1, 0, "A-1", "A-1", "t", "x"), (1, 1, "А-2", "A-2", "Работы", "мост"), (2, 0, None, None, None, None)], "doc int, ord int, act_norm string, act_folded string, title string, contractor string")
    works = spark.createDataFrame([(1, 5, "Мост", "работы", ["A-1", "a-1"]), (1, 6, "ООО Мост", "РАБОТЫ", None), (1, 7, "Иной", "работы", ["A-2", "А-1"]), (2, 8, None, None, None)], "doc int, work int, contractor string, title string, numbers array<string>")
    out = matching.match_groups(groups, works)
    assert joins(out) == 2
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, "matched", 1.0, 5), (1, 1, "matched", 0.85, 7), (2, 0, "missing", None, None)]


def _given(spark):
    groups = [(1, 0, "A-1", "A-1", "t", ""), (1, 1, "Z", "Z", "t", ""), (2, 0, None, None, "Б", None), (None, 0, "A-1", "A-1", "t", "")]
    rows = [
        (1, 0, 0, "A-1", "A-1", None, DAY, 3), (1, 1, 0, "А-1", "А-1", "ООО «Завод»", DAY, 3), (1, 2, 0, "A-2", "A-2", "Иной", LATER, 4), (1, 3, 0, "б/н", None, None, None, None),
        (1, 4, 1, "A-1", "A-1", None, None, None), (1, 5, 7, "A-1", "A-1", None, None, None), (1, 6, 0, "A-3", "A-3", None, None, None), (None, 0, 0, "A-1", "A-1", None, None, None),
    ]
    works = [(1, 10, "", "t10"), (1, 11, "", "t11"), (2, 20, "", "б"), (None, 10, "", "t"), (3, 30, "", None)]
    documents = [
        (1, 10, 100, "aosr_act", "A-1", DAY, ["Завод"], 3, None), (1, 10, 101, "passport", "А-2", DAY, ["Завод", None], 3, None), (1, 10, 102, "passport", "A-3", None, None, None, None), (1, 10, 103, "passport", "A-3", None, [], None, "x"),
        (1, 10, 104, "passport", "", None, None, None, None), (1, 11, 100, "passport", "A-9", None, None, None, None), (1, 10, None, "passport", "A-7", None, None, None, None), (2, 20, 200, "passport", None, None, None, None, None), (None, 10, 1, "aosr_act", "A-1", None, None, None, None),
    ]
    of = spark.createDataFrame
    return (
        of(groups, "doc int, ord int, act_norm string, act_folded string, title string, contractor string"), of(rows, "doc int, ord int, grp int, number string, number_norm string, org string, issued_at date, sheets int").withColumn("row_no", F.lit("1")),
        of(works, "doc int, work int, contractor string, title string"), of(documents, "doc int, work int, document int, doc_type string, number string, issued_at date, organisations array<string>, sheets int, title string"),
    )


def test_rows_meet_documents_in_one_shuffle(spark):
    given = _given(spark)
    rows = registries.reconcile(*given, "rows")["rows"]
    assert joins(rows) == 0 and optimized(rows).count("RepartitionByExpression") == 1
    got = sorted(((r.doc, r.ord, r.work, r.state, r.score, r.document, r.mismatches) for r in rows.collect()), key=str)
    assert got == sorted([
        (1, 0, 10, "matched", 1.0, 100, []), (1, 1, 10, "matched", 0.85, 100, []), (1, 2, 10, "matched", 0.85, 101, ["issued_at", "organization", "sheets"]), (1, 3, 10, "missing", None, None, []),
        (1, 4, None, "missing", None, None, []), (1, 5, None, "missing", None, None, []), (1, 6, 10, "ambiguous", None, None, []), (None, 0, None, "missing", None, None, []),
    ], key=str)
    extra = registries.reconcile(*given, "extra")["extra"]
    assert sorted((tuple(r) for r in extra.collect()), key=str) == sorted([(1, 10, 102, "passport", "A-3", None), (1, 10, 103, "passport", "A-3", "x"), (1, 10, 104, "passport", "", None), (1, 10, None, "passport", "A-7", None), (2, 20, 200, "passport", None, None)], key=str)


def test_counters_of_odd_inputs(spark):
    out = registries.reconcile(*_given(spark), "registers")
    works = sorted(((r.doc, r.work, r.state, r.verdict, r.rows_total, r.rows_matched, r.rows_missing, r.rows_ambiguous, r.rows_field_mismatch, r.extra_documents) for r in out["works"].collect()), key=str)
    assert works == sorted([(1, 10, "matched", "mismatch", 5, 3, 1, 1, 1, 4), (1, 11, "extra", "mismatch", 0, 0, 0, 0, 0, 0), (2, 20, "matched", "mismatch", 0, 0, 0, 0, 0, 1), (None, 10, "extra", "mismatch", 0, 0, 0, 0, 0, 0), (3, 30, "extra", "mismatch", 0, 0, 0, 0, 0, 0)], key=str)
    registers = {(r.doc, r.groups_total): tuple(r)[2:] for r in out["registers"].collect()}
    assert registers[1, 2] == (1, 1, 0, 7, 3, 3, 1, 1, 2, 1, 4, False) and registers[2, 1] == (1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, False) and registers[3, 0] == (0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, False)


def test_shuffles_are_given_up(spark):
    from sluice.sources.tables import given_up, stored

    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    size = lambda: sum(f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data") if f.exists())
    before = size()
    out = stored(spark.range(2_000_000).withColumn("x", F.hash("id")).repartition("x"))
    assert size() - before > 5_000_000
    given_up(out)
    end = time.time() + 60
    while size() - before > 1_000_000 and time.time() < end:
        time.sleep(0.2)
    assert size() - before < 1_000_000 and out.count() == 2_000_000
