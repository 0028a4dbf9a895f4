"""Registered rule queries over a document graph made of the tables, and their SQL.

The SQL states each rule on its own: (code, ok, conf, low), ok being true, false or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import rules
from sluice.plans.catalog import query
from sluice.sources.tables import table


def _verdicts(facts: str, before: str = "") -> str:
    return f"""WITH {before}f(code, ok, conf, low) AS ({facts}),
      s AS (SELECT code, CASE WHEN ok IS NULL OR (NOT ok AND conf < 0.75) THEN 'u' WHEN ok THEN 'k' ELSE 'o' END AS st, low FROM f)
      SELECT code, CASE WHEN count(*) FILTER (WHERE st = 'o') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE st = 'u') > 0 THEN 'undetermined' ELSE 'pass' END AS verdict, count(*) AS checked,
      count(*) FILTER (WHERE st = 'o') AS open, count(*) FILTER (WHERE st = 'u') AS undetermined, count(*) FILTER (WHERE st = 'o' AND NOT low) AS blocking FROM s GROUP BY 1"""


def _snapshot(spark: SparkSession, codes: list[str], off: tuple[str, ...] = ()) -> DataFrame:
    return spark.createDataFrame([(c, c not in off, "error", True) for c in codes], "code string, enabled boolean, severity string, deterministic boolean")


def _acts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    works = F.concat(F.lit("Кладка "), k % 6, F.lit(" объём "), k % 4 + 1, F.lit(",5 м3"))
    acts = table(spark, d, "orders").select(
        k.alias("act_id"), F.concat(F.lit("А-"), k % 1400).alias("number"), day.alias("starts"), F.date_add(day, (k % 11 - 1).cast("int")).alias("ends"), F.date_add(day, 10).alias("act_date"),
        F.concat(F.lit("Объект "), k % 3).alias("object_name"), F.when(k % 10 != 0, F.concat(F.lit("«ОБЪЕКТ» "), k % 4)).alias("card_name"),
        F.when(k % 5 == 0, "ООО Мост").otherwise("ООО «Вектор»").alias("inspecting_org"), F.lit("ооо вектор").alias("contractor_org"), works.alias("works"),
        F.when(k % 13 != 0, "ось 1").alias("works_place"), F.when(k % 7 != 0, F.concat(F.lit("КЖ-"), k % 50, F.when(k % 2 == 0, " изм. 1").otherwise(""))).alias("cipher"),
        F.when(k % 9 == 0, F.upper(works)).otherwise("Отделка").alias("next_works"), F.when(k % 4 == 0, "реестр 1").alias("registry_ref"),
        F.when(k % 2 == 0, r"^А-\d{1,3}$").alias("number_pattern"), F.concat(F.lit("по схеме "), k % 3 + 1, F.lit(".5м3")).alias("scheme_text"), F.when(k % 17 == 0, 0.5).otherwise(0.95).alias("confidence"),
    )
    line = table(spark, d, "lineitem")
    materials = line.select(F.col("l_orderkey").alias("act_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("material_id"))
    signers = line.select(F.col("l_orderkey").alias("act_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("signer_id"), F.when(F.col("l_linenumber") % 2 == 0, "contractor").otherwise("supervision").alias("role"), F.when(F.col("l_tax") > 0.01, "п-1").alias("order_number"), F.col("l_shipdate").alias("order_date"))
    ciphers = spark.range(40).select(F.concat(F.lit("кж-"), "id").alias("cipher"), (F.col("id") % 3 != 0).alias("is_active"))
    documents = table(spark, d, "orders").select(k.alias("document_id"), F.lit("aosr").alias("doc_type"), (k > 0).alias("is_known"))
    return {"acts": acts, "materials": materials, "signers": signers, "ciphers": ciphers, "documents": documents}


_ACT = """a AS (SELECT o_orderkey AS k, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 11 - 1)::INT AS e, o_orderdate::DATE + 10 AS t, CASE WHEN o_orderkey % 17 = 0 THEN 0.5 ELSE 0.95 END AS c FROM orders),
  n AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_linenumber % 2) AS roles FROM lineitem GROUP BY 1), """
_ACT_FACTS = """SELECT 'AOSR.HDR.010', CASE WHEN k % 10 <> 0 THEN k % 3 = k % 4 END, c, false FROM a
  UNION ALL SELECT 'AOSR.ACT.030', k % 1400 < 1000, c, false FROM a WHERE k % 2 = 0
  UNION ALL SELECT 'AOSR.ACT.031', s <= e AND e <= t, c, false FROM a
  UNION ALL SELECT 'AOSR.SGN.040', coalesce(roles = 2, false), c, false FROM a LEFT JOIN n USING (k)
  UNION ALL SELECT 'AOSR.SGN.041', l_tax > 0.01, NULL, false FROM lineitem
  UNION ALL SELECT 'AOSR.SGN.042', k % 5 <> 0, c, true FROM a
  UNION ALL SELECT 'AOSR.P1.050', k % 13 <> 0, c, false FROM a
  UNION ALL SELECT 'AOSR.P2.060', k % 2 = 0, c, false FROM a WHERE k % 7 <> 0
  UNION ALL SELECT 'AOSR.P2.061', k % 50 < 40 AND (k % 50) % 3 <> 0, c, false FROM a WHERE k % 7 <> 0
  UNION ALL SELECT 'AOSR.P3.071', k % 4 = 0, c, false FROM a JOIN n USING (k) WHERE n > 5
  UNION ALL SELECT 'AOSR.P4.081', k % 4 = k % 3, c, false FROM a
  UNION ALL SELECT 'AOSR.P7.090', k % 9 <> 0, c, false FROM a
  UNION ALL SELECT 'XS.130', k = min(k) OVER (PARTITION BY k % 1400), c, false FROM a"""


@query(_verdicts(_ACT_FACTS, _ACT))
def act_rules(spark, d):
    codes = ["AOSR.HDR.010", "AOSR.ACT.030", "AOSR.ACT.031", "AOSR.SGN.040", "AOSR.SGN.041", "AOSR.SGN.042", "AOSR.P1.050", "AOSR.P2.060", "AOSR.P2.061", "AOSR.P3.071", "AOSR.P4.081", "AOSR.P7.090", "XS.130"]
    return rules.run_rules(_acts(spark, d), _snapshot(spark, codes), codes=codes)[1]


@query("""SELECT * FROM (VALUES ('AOSR.P1.050', 'n_a', 0, 0, 0, 0), ('CERT.600', 'n_a', 0, 0, 0, 0), ('MAT.110', 'n_a', 0, 0, 0, 0), ('XS.130', 'skipped', 0, 0, 0, 0)) t(code, verdict, checked, open, undetermined, blocking)""")
def gated_rules(spark, d):
    graph = _acts(spark, d)
    graph["documents"] = graph["documents"].withColumn("is_known", F.lit(False))
    codes = ["AOSR.P1.050", "CERT.600", "MAT.110", "XS.130"]
    return rules.run_rules(graph, _snapshot(spark, codes, off=("XS.130",)), codes=codes, profile_ready=False)[1]


def _certificates(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    graph = _acts(spark, d)
    ship, n, q = F.col("l_shipdate").cast("date"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    graph["certificates"] = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cert_id"), F.col("l_orderkey").alias("act_id"), ship.alias("issued_at"), F.when(n != 3, F.date_sub(ship, 30)).alias("valid_from"), F.when(n % 4 != 0, F.date_add(ship, 60)).alias("valid_to"),
        F.when(n % 2 == 1, F.date_add(ship, 400)).alias("prolonged_to"), F.when(q > 5, F.date_sub(ship, q)).alias("made_at"), F.when(n != 6, ship).alias("shipped_at"),
        F.when(n % 2 == 0, "mix_quality_doc").otherwise("certificate").alias("doc_type"), (n != 4).alias("is_known"),
    )
    return graph


_CERT = f"""{_ACT}c AS (SELECT l_shipdate::DATE AS i, CASE WHEN l_linenumber <> 3 THEN l_shipdate::DATE - 30 END AS vf, CASE WHEN l_linenumber % 4 <> 0 THEN l_shipdate::DATE + 60 END AS vt,
  CASE WHEN l_linenumber % 2 = 1 THEN l_shipdate::DATE + 400 END AS pt, CASE WHEN l_quantity::INT > 5 THEN l_shipdate::DATE - l_quantity::INT END AS m, l_linenumber AS n, e, t FROM lineitem JOIN a ON k = l_orderkey), """


@query(_verdicts("""SELECT 'DATE.300', CASE WHEN vf IS NULL AND t > vt THEN false ELSE t >= vf AND (vt IS NULL OR t <= vt) END, NULL, false FROM c
  UNION ALL SELECT 'DATE.302', vt >= DATE '1997-01-01', NULL, false FROM c WHERE vt IS NOT NULL UNION ALL SELECT 'DATE.303', vf <= DATE '1997-01-01', NULL, false FROM c WHERE vf IS NOT NULL
  UNION ALL SELECT 'DATE.304', pt >= t, NULL, false FROM c WHERE pt IS NOT NULL AND vt < t UNION ALL SELECT 'DATE.310', i <= t, NULL, false FROM c
  UNION ALL SELECT 'DATE.311', t - i <= 900, NULL, false FROM c WHERE i <= t UNION ALL SELECT 'DATE.312', m <= e, NULL, false FROM c UNION ALL SELECT 'DATE.320', CASE WHEN n <> 6 THEN abs(i - e) <= 90 END, NULL, false FROM c WHERE n % 2 = 0 AND n <> 4""", _CERT))
def date_rules(spark, d):
    codes = ["DATE.300", "DATE.302", "DATE.303", "DATE.304", "DATE.310", "DATE.311", "DATE.312", "DATE.320"]
    today = {"today": "1997-01-01"}
    return rules.run_rules(_certificates(spark, d), _snapshot(spark, codes), {"DATE.302": today, "DATE.303": today, "DATE.311": {"days": 900}, "DATE.320": {"days": 90}}, codes)[1]


def _evidence(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("certificate", "passport", "tech_passport", "conclusion"))), (k % 4 + 1).cast("int"))
    documents = part.select(k.alias("document_id"), kind.alias("doc_type"), (k % 11 != 0).alias("is_known"), F.when(k % 5 != 0, F.concat(F.lit("N"), k)).alias("number"), F.when(k % 6 != 0, day).alias("issued_at"), day.alias("valid_from"), F.date_add(day, (k % 7 - 1).cast("int")).alias("valid_to"))
    state = F.when(k % 9 == 0, "missing").when(k % 10 == 0, "ambiguous").otherwise("matched")
    rows = part.select(k.alias("row_id"), state.alias("match_state"), F.when(state == "matched", k).alias("matched_document_id"))
    norms = part.select(k.alias("norm_id"), F.when(k % 8 == 0, "по проекту").otherwise(F.concat(F.lit("не менее "), k % 5, F.lit(", не более 20"))).alias("norm"), F.concat(F.col("p_size"), F.lit(" мм")).alias("fact"))
    materials = part.select(k.alias("material_id"), F.when(k % 2 == 0, "steel").when(k % 3 == 0, "paint").otherwise("sand").alias("category"))
    evidence = part.where("p_partkey % 3 <> 1").select(k.alias("material_id"), F.explode(F.when(k % 4 == 0, F.array(F.lit("passport"), F.lit("certificate"))).otherwise(F.array(F.lit("passport")))).alias("doc_type"))
    matrix = spark.createDataFrame([("steel", ["passport"], [["certificate", "declaration"]]), ("paint", ["passport"], [])], "category string, required array<string>, any_of array<array<string>>")
    batches = part.select(k.alias("batch_id"), k.alias("material_id"), F.when(k % 7 != 0, F.concat(F.lit("ООО «Завод "), k % 3, F.lit("»"))).alias("manufacturer"))
    certificates = part.select(k.alias("material_id"), F.concat(F.lit("ооо завод "), k % 2).alias("manufacturer"))
    references = part.select(k.alias("material_id"), F.explode(F.array(F.lit("СТО 1-2015"), F.when(k % 3 == 0, "СТО 1-2011").when(k % 3 == 1, "CTO 1 - 2015").otherwise("СТО 1"))).alias("standard"))
    strengths = part.select(k.alias("strength_id"), (k % 50).alias("act_id"), (k % 30).cast("int").alias("age_days"), F.when(k % 4 == 0, 90.0).alias("percent"), F.col("p_size").cast("double").alias("actual"), F.lit(25.0).alias("required"))
    external = spark.createDataFrame([("sro", True), ("nrs", False)], "registry string, available boolean")
    asked = part.select("p_partkey", day.alias("day"), F.explode(F.array(F.lit("sro"), F.lit("nrs"))).alias("registry"))
    asked = asked.select(F.concat_ws("-", "p_partkey", "registry").alias("number_id"), "registry", F.concat(F.lit("с-"), k % 20).alias("number"), "day")
    records = spark.range(15).select(F.lit("sro").alias("registry"), F.concat(F.lit("C-"), "id").alias("number"), F.lit("2024-03-01").cast("date").alias("valid_from"), F.when(F.col("id") % 2 == 0, F.lit("2024-08-01").cast("date")).alias("valid_to"))
    return {"documents": documents, "registry_rows": rows, "norms": norms, "materials": materials, "evidence": evidence, "matrix": matrix, "batches": batches, "certificates": certificates, "references": references, "strengths": strengths, "external": external, "external_numbers": asked, "external_records": records}


_PART = "p AS (SELECT p_partkey AS k, p_size AS z, DATE '2024-01-01' + (p_partkey % 300)::INT AS d FROM part), "


@query(_verdicts("""SELECT 'CERT.600', k % 5 <> 0 AND k % 7 >= 1, NULL, false FROM p WHERE k % 4 = 0 AND k % 11 <> 0
  UNION ALL SELECT 'PASS.611', k % 5 <> 0 AND k % 6 <> 0, NULL, false FROM p WHERE k % 4 = 1 AND k % 11 <> 0 UNION ALL SELECT 'TP.620', k % 5 <> 0, NULL, false FROM p WHERE k % 4 = 2 AND k % 11 <> 0
  UNION ALL SELECT 'CONCL.660', k % 5 <> 0 AND k % 6 <> 0, NULL, false FROM p WHERE k % 4 = 3 AND k % 11 <> 0
  UNION ALL SELECT 'PASS.610', CASE WHEN k % 8 <> 0 THEN z >= k % 5 AND z <= 20 END, NULL, false FROM p
  UNION ALL SELECT 'REG.100', k % 9 <> 0, NULL, false FROM p UNION ALL SELECT 'REG.101', k % 9 <> 0 AND k % 10 <> 0, NULL, false FROM p WHERE k % 11 <> 0
  UNION ALL SELECT 'REG.102', CASE WHEN k % 9 = 0 OR k % 10 <> 0 THEN true END, NULL, false FROM p
  UNION ALL SELECT 'MAT.110', CASE WHEN k % 2 = 0 THEN k % 3 <> 1 AND k % 4 = 0 ELSE true END, NULL, false FROM p WHERE k % 2 = 0 OR k % 3 = 0
  UNION ALL SELECT 'MAT.111', CASE WHEN k % 7 <> 0 THEN k % 3 = k % 2 END, NULL, false FROM p
  UNION ALL SELECT 'MAT.112', CASE WHEN k % 3 = 0 THEN false WHEN k % 3 = 1 THEN true END, NULL, false FROM p
  UNION ALL SELECT 'LAB.650', CASE WHEN k % 4 = 0 THEN 90 ELSE z / 25.0 * 100 END >= CASE WHEN k % 30 < 28 THEN 70 ELSE 100 END, NULL, k % 30 < 28 FROM p
  UNION ALL SELECT 'LAB.651', max(k % 30) >= 28, NULL, false FROM p GROUP BY k % 50
  UNION ALL SELECT 'EXT.SRO.140', CASE WHEN k % 20 >= 15 THEN false ELSE d >= DATE '2024-03-01' AND ((k % 20) % 2 = 1 OR d <= DATE '2024-08-01') END, NULL, false FROM p
  UNION ALL SELECT 'EXT.NRS.141', NULL, NULL, false FROM p""", _PART))
def evidence_rules(spark, d):
    codes = ["CERT.600", "PASS.611", "TP.620", "CONCL.660", "PASS.610", "REG.100", "REG.101", "REG.102", "MAT.110", "MAT.111", "MAT.112", "LAB.650", "LAB.651", "EXT.SRO.140", "EXT.NRS.141"]
    return rules.run_rules(_evidence(spark, d), _snapshot(spark, codes), codes=codes)[1]


def _parties(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k = F.col("s_suppkey")
    inn = F.lpad(((k * 7919 + 1234567890) % 10000000000).cast("string"), 10, "0")
    s = table(spark, d, "supplier")
    parties = s.select(k.alias("party_id"), F.col("s_name").alias("name"), F.when(k % 5 != 0, F.concat(F.lit(" "), inn)).alias("inn"), F.concat(inn, F.lit("123")).alias("ogrn"), (k % 6 != 0).alias("is_active"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))
    protocols = s.select(k.alias("protocol_id"), k.alias("batch_id"), day.alias("tested_at"), F.lit("2024-02-01").cast("date").alias("accredited_to"), F.when(k % 3 != 0, F.lit("2024-02-10").cast("date")).alias("calibrated_to"), F.concat(F.lit("RA.RU."), k % 9).alias("attestat"))
    laboratories = spark.range(6).select(F.concat(F.lit("ra ru "), "id").alias("attestat"), F.lit("2024-01-10").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    acts = s.select(k.alias("act_id"), F.lit("2024-01-20").cast("date").alias("act_date"))
    batches = s.select(k.alias("batch_id"), k.alias("act_id"))
    stamps = s.select(k.alias("stamp_id"), day.alias("signed_at"), F.lit("2024-01-05").cast("date").alias("valid_from"), F.lit("2024-02-05").cast("date").alias("valid_to"), F.element_at(F.array(*map(F.lit, ("embedded", "absent", "unreadable"))), (k % 3 + 1).cast("int")).alias("probe"))
    documents = s.select(k.alias("document_id"), F.lit("aosr").alias("doc_type"), F.lit(True).alias("is_known"))
    return {"parties": parties, "protocols": protocols, "laboratories": laboratories, "acts": acts, "batches": batches, "stamps": stamps, "documents": documents}


_SUPPLIER = "x AS (SELECT s_suppkey AS k, lpad(((s_suppkey * 7919 + 1234567890) % 10000000000)::VARCHAR, 10, '0') AS inn, DATE '2024-01-01' + (s_suppkey % 60)::INT AS d FROM supplier), "
_INN = "(" + " + ".join(f"{w} * substr(inn, {i + 1}, 1)::INT" for i, w in enumerate((2, 4, 10, 3, 5, 9, 4, 6, 8))) + ") % 11 % 10 = substr(inn, 10, 1)::INT"


@query(_verdicts(f"""SELECT 'AOSR.HDR.020', k % 5 <> 0, NULL, false FROM x UNION ALL SELECT 'AOSR.HDR.021', {_INN}, NULL, false FROM x WHERE k % 5 <> 0
  UNION ALL SELECT 'AOSR.HDR.022', (inn || '12')::BIGINT % 11 % 10 = 3, NULL, false FROM x UNION ALL SELECT 'REF.121', k % 6 <> 0, NULL, false FROM x
  UNION ALL SELECT 'DATE.330', d <= DATE '2024-02-01', NULL, false FROM x UNION ALL SELECT 'DATE.331', CASE WHEN k % 3 <> 0 THEN d <= DATE '2024-02-10' END, NULL, false FROM x
  UNION ALL SELECT 'DATE.332', CASE WHEN k % 9 < 6 THEN d >= DATE '2024-01-10' END, NULL, false FROM x UNION ALL SELECT 'DATE.372', d <= DATE '2024-01-23', NULL, false FROM x
  UNION ALL SELECT 'SIG.STAMP.370', d BETWEEN DATE '2024-01-05' AND DATE '2024-02-05', NULL, false FROM x UNION ALL SELECT 'SIG.PDF.371', CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END, NULL, false FROM x""", _SUPPLIER))
def party_rules(spark, d):
    codes = ["AOSR.HDR.020", "AOSR.HDR.021", "AOSR.HDR.022", "REF.121", "DATE.330", "DATE.331", "DATE.332", "DATE.372", "SIG.STAMP.370", "SIG.PDF.371"]
    return rules.run_rules(_parties(spark, d), _snapshot(spark, codes), codes=codes)[1]


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 11 - 1)::INT AS e, o_orderkey % 17 = 0 AS soft FROM orders), f AS (
  SELECT CASE WHEN soft THEN 0 ELSE 1 END AS hard FROM o WHERE NOT (s <= e AND e <= s + 10) UNION ALL SELECT CASE WHEN soft THEN 0 ELSE 1 END FROM o WHERE k % 13 = 0)
  SELECT 3 AS rules, 0 AS passed, 2 AS failed, 0 AS undetermined, 0 AS not_applicable, 1 AS skipped, count(*) AS findings, sum(hard)::BIGINT AS blocking, count(*) AS errors, 0 AS warnings, 0 AS infos FROM f""")
def rule_run_counts(spark, d):
    codes = ["AOSR.ACT.031", "AOSR.P1.050", "XS.130"]
    found, verdicts = rules.run_rules(_acts(spark, d), _snapshot(spark, codes, off=("XS.130",)), codes=codes)
    return rules.run_summary(verdicts, found)


@query("""SELECT o_orderkey AS target_id FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0""")
def blocking_findings(spark, d):
    codes = ["AOSR.P1.050"]
    found, _ = rules.run_rules(_acts(spark, d), _snapshot(spark, codes), codes=codes)
    return found.where("is_blocking").select(F.col("target_id").cast("long").alias("target_id"))


@query(_verdicts("""SELECT 'AOSR.ACT.031', s <= e AND e <= t, c, false FROM a UNION ALL SELECT 'XS.130', k = min(k) OVER (PARTITION BY k % 1400), c, false FROM a
  UNION ALL SELECT 'AOSR.P3.070', l_partkey % 3 <> 0, NULL, false FROM lineitem""", _ACT))
def rule_verdicts(spark, d):
    graph = _acts(spark, d)
    graph["evidence"] = graph["materials"].where("split(material_id, '-')[2] % 3 <> 0")
    codes = ["AOSR.ACT.031", "XS.130", "AOSR.P3.070"]
    return rules.run_rules(graph, _snapshot(spark, codes), codes=codes)[1]


def _repeated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A small graph once for every order: ids are ten times the order's key and the row's own; directories stand once."""
    keys = table(spark, d, "orders").select("o_orderkey")

    def made(rows: list[tuple], schema: str) -> DataFrame:
        small = spark.createDataFrame(rows, schema)
        ids = [c for c in small.columns if c.endswith("_id")]
        if not ids:
            return small
        return keys.withColumn("_all", F.lit(1)).join(F.broadcast(small.withColumn("_all", F.lit(1))), "_all").select(*((F.col("o_orderkey") * 10 + F.col(c)).alias(c) if c in ids else c for c in small.columns))  # a few rows of this file

    return {
        "documents": made([(1, "aosr", True, "A-1", None, None, None, None), (2, "declaration", True, "Д-2", "2024-01-01", "2024-02-01", None, None), (3, "declaration", True, "Д-3", "2024-03-01", "2024-02-01", None, None), (4, "refusal_letter", True, "п 4", None, None, "2024-01-01", None), (5, "scheme", True, "с", None, None, None, "A-1"), (6, "scheme", True, "с", None, None, None, None)],
                          "document_id int, doc_type string, is_known boolean, number string, valid_from string, valid_to string, issued_at string, act_ref string"),
        "parties": made([(1, "ООО «Вектор»", "7707083893", "1027700132195"), (2, "вектор", "7707083893", "1"), (3, "Никто", None, None), (4, "ооо вектор", None, "1027700132195")], "party_id int, name string, inn string, ogrn string"),
        "directory": made([("ООО Вектор", "7707083893", "1027700132195")], "name string, inn string, ogrn string"),
        "annexes": made([(1, "д-2"), (2, "A-1"), (3, "А-1"), (4, "нет")], "annex_id int, number string"),
        "objects": made([(1, True), (2, False), (3, None)], "object_id int, is_active boolean"),
        "external": made([("sched", True)], "registry string, available boolean"),
        "external_numbers": made([(1, "sched", "Ш-1", "2024-05-01"), (2, "sched", "Ш-9", "2024-05-01")], "number_id int, registry string, number string, day string").withColumn("day", F.col("day").cast("date")),
        "external_records": made([("sched", "ш-1", "2024-01-01", None)], "registry string, number string, valid_from string, valid_to string").withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")}),
        "mill_certificates": made([(1, 1, "А240С"), (2, 1, "A400"), (3, 2, "A400"), (4, 1, " ")], "cert_id int, act_id int, mark string"),
        "design_marks": made([(1, "A240C")], "act_id int, mark string"),
        "acts": made([(1, "бетон В7,5 и B25 F150"), (2, "кладка")], "act_id int, works string"),
        "mixes": made([(1, 1, "B7,5"), (2, 1, "В30"), (3, 2, "B25")], "mix_id int, act_id int, mix_class string"),
        "stamps": made([(1, 5)], "stamp_id int, document_id int"),
    }


@query("""SELECT code, verdict, checked * n AS checked, open * n AS open, undetermined * n AS undetermined, blocking * n AS blocking FROM (VALUES ('AOSR.HDR.023', 'fail', 4, 1, 2, 1), ('AOSR.P4.080', 'fail', 4, 1, 0, 1), ('DECL.601', 'fail', 2, 1, 0, 1), ('REFUS.670', 'pass', 1, 0, 0, 0), ('REF.120', 'fail', 3, 1, 1, 1), ('EXT.SCHED.142', 'fail', 2, 1, 0, 1),
  ('MILL.630', 'fail', 4, 1, 2, 1), ('MIX.640', 'fail', 3, 1, 1, 1), ('SCH.680', 'fail', 2, 1, 0, 1)) t(code, verdict, checked, open, undetermined, blocking), (SELECT count(*) AS n FROM orders)""")
def repeated_rules(spark, d):
    codes = ["AOSR.HDR.023", "AOSR.P4.080", "DECL.601", "REFUS.670", "REF.120", "EXT.SCHED.142", "MILL.630", "MIX.640", "SCH.680"]
    return rules.run_rules(_repeated(spark, d), _snapshot(spark, codes), codes=codes)[1]
