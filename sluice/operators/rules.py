"""Three-valued validation rules over a document graph of keyed DataFrames.

A rule is a function (graph, parameters) -> rows (target_id, state, message, confidence,
severity): state ``open`` for a defect, ``undetermined`` where a value can't be read, ``ok``
for a target that was looked at and found well. ``judged`` makes them from a three-valued
column.

The engine (``run_rules``) takes the rules that the snapshot enables, in order of their
codes. A rule that needs a document type which no confidently typed document has, or a
section profile that isn't set up, is n_a. Open findings read with less than min_confidence
soften to undetermined. A finding may lower the severity of its rule, not raise it; it
blocks if it is open, of a blocking deterministic rule, and still an error. Verdict: fail if any
finding is open, else undetermined if any, pass if something was checked, else n_a.

Graph tables, keyed by act_id, document_id and so on, may be absent where no chosen rule
reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import cells
from sluice.functions.text import digits_of, doc_no, doc_no_folded, inn_ok, mark, ogrn_ok, org_key, phrase, standard_without_year, standard_year

Graph = dict[str, DataFrame]
MIN_CONFIDENCE = 0.75
SEVERITIES = ("info", "warning", "error")


@dataclass(frozen=True)
class Rule:
    code: str
    evaluate: Callable[[Graph, dict], DataFrame]
    doc_type: str | None = None
    profile: bool = False


RULES: dict[str, Rule] = {}


def rule(code: str, doc_type: str | None = None, profile: bool = False):
    def keep(f: Callable[[Graph, dict], DataFrame]) -> Callable[[Graph, dict], DataFrame]:
        RULES[code] = Rule(code, f, doc_type, profile)
        return f

    return keep


def judged(df: DataFrame, target: str, ok: Column, message: str, severity: Column | None = None) -> DataFrame:
    """ok null: undetermined; false: open. A column confidence of df is the finding's."""
    state = F.when(ok.isNull(), "undetermined").when(~ok, "open").otherwise("ok")
    confidence = F.col("confidence") if "confidence" in df.columns else F.lit(None)
    low = F.lit(None) if severity is None else severity
    return df.select(F.col(target).cast("string").alias("target_id"), state.alias("state"), F.lit(message).alias("message"), confidence.cast("double").alias("confidence"), low.cast("string").alias("lowered"))


def filled(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) != "" for n in names])


def within(day: str, start: str, end: str) -> Column:
    """Null where the day or the start is unknown; an open end never passes."""
    return (F.col(day) >= F.col(start)) & (F.col(end).isNull() | (F.col(day) <= F.col(end)))


def present(df: DataFrame, keys: DataFrame, on: str | Sequence[str], into: str = "has") -> DataFrame:
    """df with a flag that tells whether keys has its key; counted per key before the join."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*on).distinct().withColumn(into, F.lit(True)), on, "left").withColumn(into, F.coalesce(into, F.lit(False)))


# ---------------------------------------------------------------- acts
@rule("AOSR.HDR.010", "aosr")
def object_name(graph: Graph, p: dict) -> DataFrame:
    a, b = phrase(F.col("object_name")), phrase(F.col("card_name"))
    return judged(graph["acts"], "act_id", F.when((a != "") & (b != ""), F.contains(a, b) | F.contains(b, a)), "object name differs from its card")


@rule("AOSR.HDR.020", "aosr")
def party_fields(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["parties"], "party_id", filled(*p.get("fields", ("name", "inn", "ogrn"))), "a party's details are not complete")


@rule("AOSR.HDR.021", "aosr")
def party_inn(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["parties"].where(filled("inn")), "party_id", inn_ok(digits_of(F.col("inn"))), "check digits of the taxpayer number differ")


@rule("AOSR.HDR.022", "aosr")
def party_ogrn(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["parties"].where(filled("ogrn")), "party_id", ogrn_ok(digits_of(F.col("ogrn"))), "check digit of the registration number differs")


@rule("AOSR.HDR.023", "aosr")
def party_in_directory(graph: Graph, p: dict) -> DataFrame:
    """By taxpayer number, then registration number, then name; the other two must agree."""
    known = graph["directory"].select(F.col("inn").alias("d_inn"), F.col("ogrn").alias("d_ogrn"), org_key(F.col("name")).alias("d_name"))
    parties = graph["parties"].withColumn("k", org_key(F.col("name")))
    out = parties
    for mine, theirs in (("inn", "d_inn"), ("ogrn", "d_ogrn"), ("k", "d_name")):
        one = known.where(f"{theirs} is not null").groupBy(theirs).agg(F.min(F.struct("d_inn", "d_ogrn", "d_name")).alias(f"by_{mine}"))
        out = out.join(one, F.col(mine) == F.col(theirs), "left").drop(theirs)
    hit = F.coalesce("by_inn", "by_ogrn", "by_k")
    return judged(out, "party_id", F.when(hit.isNotNull(), (hit["d_inn"] == F.col("inn")) & (hit["d_ogrn"] == F.col("ogrn")) & (hit["d_name"] == F.col("k"))), "details differ from the directory")


@rule("AOSR.ACT.030", "aosr")
def number_form(graph: Graph, p: dict) -> DataFrame:
    """The object's pattern is data; objects without one are not looked at."""
    return judged(graph["acts"].where("number_pattern is not null"), "act_id", F.rlike("number", "number_pattern"), "act number has not the object's form")


@rule("AOSR.ACT.031", "aosr")
def dates_in_order(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["acts"], "act_id", (F.col("starts") <= F.col("ends")) & (F.col("ends") <= F.col("act_date")), "start, end and act date are out of order")


@rule("AOSR.SGN.040", "aosr")
def signer_roles(graph: Graph, p: dict) -> DataFrame:
    roles = p.get("roles", ("contractor", "supervision"))
    signed = graph["signers"].groupBy("act_id").agg(F.collect_set("role").alias("roles"))
    missing = F.array_except(F.array(*map(F.lit, roles)), F.coalesce("roles", F.array().cast("array<string>")))
    return judged(graph["acts"].join(signed, "act_id", "left"), "act_id", F.size(missing) == 0, "a required signer is missing")


@rule("AOSR.SGN.041", "aosr")
def signer_orders(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["signers"], "signer_id", filled("order_number", "order_date"), "the signer's order is not named")


@rule("AOSR.SGN.042", "aosr")
def inspector_is_contractor(graph: Graph, p: dict) -> DataFrame:
    a, b = org_key(F.col("inspecting_org")), org_key(F.col("contractor_org"))
    return judged(graph["acts"], "act_id", F.when((a != "") & (b != ""), a == b), "the inspecting organisation is not the contractor", F.lit("warning"))


@rule("AOSR.P1.050", "aosr")
def works_named(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["acts"], "act_id", filled("works", "works_place"), "works or their place are not named")


@rule("AOSR.P2.060", "aosr")
def cipher_revision(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["acts"].where(filled("cipher")), "act_id", F.col("cipher").rlike(r"(?iu)изм\.?\s*\d+|rev\.?\s*\d+"), "the cipher names no revision")


@rule("AOSR.P2.061", "aosr")
def cipher_known(graph: Graph, p: dict) -> DataFrame:
    known = graph["ciphers"].where("is_active").select(doc_no_folded(F.col("cipher")).alias("k"))
    acts = graph["acts"].where(filled("cipher")).withColumn("k", doc_no_folded(F.regexp_replace("cipher", r"(?iu)\s*(изм|rev)\.?\s*\d+.*$", "")))
    return judged(present(acts, known, "k"), "act_id", F.col("has"), "the cipher is not in the catalogue")


@rule("AOSR.P3.070", "aosr")
def material_evidence(graph: Graph, p: dict) -> DataFrame:
    return judged(present(graph["materials"], graph["evidence"], "material_id"), "material_id", F.col("has"), "no evidence document")


@rule("AOSR.P3.071", "aosr")
def many_materials(graph: Graph, p: dict) -> DataFrame:
    n = graph["materials"].groupBy("act_id").agg(F.count("*").alias("n")).where(F.col("n") > p.get("most", 5))
    return judged(graph["acts"].join(n, "act_id"), "act_id", filled("registry_ref"), "many materials and no reference to a registry")


@rule("AOSR.P4.080", "aosr")
def annexes_present(graph: Graph, p: dict) -> DataFrame:
    listed = graph["annexes"].withColumns({"e": doc_no(F.col("number")), "f": doc_no_folded(F.col("number"))})
    numbers = graph["documents"].select(doc_no(F.col("number")).alias("e"), doc_no_folded(F.col("number")).alias("f"))
    found = present(present(listed, numbers, "e", "exact"), numbers, "f", "folded")
    return judged(found, "annex_id", F.col("exact") | F.col("folded"), "a listed annex is missing")


@rule("AOSR.P4.081", "aosr")
def quantities_agree(graph: Graph, p: dict) -> DataFrame:
    """Of the quantities by unit in the scheme and in item 1 one must be the same; acts with one side only aren't looked at."""

    def by_unit(name: str) -> Column:
        got = F.regexp_extract_all(F.lower(name), F.lit(r"(?iu)\d+(?:[.,]\d+)?\s*(?:м2|м3|шт|кг|т|м)(?![а-яё0-9])"), F.lit(0))
        return F.array_distinct(F.transform(got, lambda x: F.replace(F.regexp_replace(x, r"\s+", ""), F.lit(","), F.lit("."))))

    j = graph["acts"].withColumns({"q1": by_unit("works"), "q2": by_unit("scheme_text")})
    return judged(j.where((F.size("q1") > 0) & (F.size("q2") > 0)), "act_id", F.arrays_overlap("q1", "q2"), "quantities in scheme and item 1 differ")


@rule("AOSR.P7.090", "aosr")
def next_works_differ(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["acts"].where(filled("works", "next_works")), "act_id", phrase(F.col("works")) != phrase(F.col("next_works")), "next works are these works")


@rule("XS.130", "aosr")
def duplicate_numbers(graph: Graph, p: dict) -> DataFrame:
    acts = graph["acts"].withColumn("k", doc_no_folded(F.col("number")))
    first = acts.where("k <> ''").groupBy("k").agg(F.min("act_id").alias("first_id"))
    return judged(acts.join(first, "k"), "act_id", F.col("act_id") == F.col("first_id"), "another act has the same number")


# ---------------------------------------------------------------- registry, materials, references
@rule("REG.100")
def registry_row_missing(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["registry_rows"], "row_id", F.col("match_state") != "missing", "no document for a registry row")


@rule("REG.101")
def document_extra(graph: Graph, p: dict) -> DataFrame:
    named = graph["registry_rows"].where("matched_document_id is not null").select(F.col("matched_document_id").alias("document_id"))
    return judged(present(graph["documents"].where("is_known"), named, "document_id"), "document_id", F.col("has"), "a document that no registry row names")


@rule("REG.102")
def registry_row_ambiguous(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["registry_rows"], "row_id", F.when(F.col("match_state") != "ambiguous", True), "several documents for a registry row")


@rule("MAT.110", profile=True)
def evidence_pack(graph: Graph, p: dict) -> DataFrame:
    """matrix: category, required ARRAY, any_of ARRAY<ARRAY>; materials outside it aren't looked at."""
    have = graph["evidence"].groupBy("material_id").agg(F.collect_set("doc_type").alias("have"))
    j = graph["materials"].join(F.broadcast(graph["matrix"]), "category").join(have, "material_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))  # a row a category
    return judged(j, "material_id", (F.size(F.array_except("required", "have")) == 0) & F.forall("any_of", lambda g: F.arrays_overlap(g, F.col("have"))), "the evidence pack is not complete")


@rule("MAT.111")
def manufacturer_covered(graph: Graph, p: dict) -> DataFrame:
    maker = org_key(F.col("manufacturer"))
    covered = graph["certificates"].select("material_id", maker.alias("maker"))
    batches = graph["batches"].withColumn("maker", maker)
    return judged(present(batches, covered.where("maker <> ''"), ["material_id", "maker"]), "batch_id", F.when(F.col("maker") != "", F.col("has")), "no certificate covers the manufacturer")


@rule("MAT.112")
def one_edition(graph: Graph, p: dict) -> DataFrame:
    refs = graph["references"].select("material_id", standard_without_year(F.col("standard")).alias("base"), standard_year(F.col("standard")).alias("year"))
    g = refs.groupBy("material_id", "base").agg(F.count_distinct("year").alias("years"), F.count_if(F.col("year").isNull()).alias("bare"), F.count("*").alias("n")).where("n > 1")
    return judged(g.withColumn("target", F.concat_ws(":", "material_id", "base")), "target", F.when(F.col("years") > 1, False).when(F.col("bare") == 0, True), "editions of one standard differ")


@rule("REF.120")
def object_active(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["objects"], "object_id", F.col("is_active"), "the object is closed")


@rule("REF.121")
def parties_active(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["parties"], "party_id", F.col("is_active"), "the counterparty is closed")


def external(code: str, message: str) -> None:
    """A number is looked up in a registry table (registry, number, valid_from, valid_to); a registry
    that isn't available leaves the finding undetermined."""

    @rule(code)
    def looked_up(graph: Graph, p: dict) -> DataFrame:
        name = code.split(".")[1].lower()
        ready = graph["external"].where((F.col("registry") == name) & F.col("available")).limit(1).count() > 0  # a row a registry
        asked = graph["external_numbers"].where(F.col("registry") == name)
        if not ready:
            return judged(asked, "number_id", F.lit(None).cast("boolean"), message)
        known = graph["external_records"].where(F.col("registry") == name).groupBy(doc_no_folded(F.col("number")).alias("k")).agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
        j = asked.withColumn("k", doc_no_folded(F.col("number"))).join(known, "k", "left")
        return judged(j, "number_id", F.when(F.col("valid_from").isNull(), False).otherwise(within("day", "valid_from", "valid_to")), message)


external("EXT.SRO.140", "no membership in force")
external("EXT.NRS.141", "no specialist entry in force")
external("EXT.SCHED.142", "no schedule entry in force")


# ---------------------------------------------------------------- dates: certificates joined with their acts
def _used(graph: Graph) -> DataFrame:
    return graph["certificates"].join(graph["acts"].select("act_id", "act_date", F.col("ends").alias("works_end")), "act_id")


def dated(code: str, ok: Callable[[dict], Column], message: str, where: str = "true", doc_type: str | None = None) -> None:
    @rule(code, doc_type)
    def check(graph: Graph, p: dict) -> DataFrame:
        return judged(_used(graph).where(where), "cert_id", ok(p), message)


def _days(a: str, b: str) -> Column:
    return F.abs(F.datediff(a, b))


dated("DATE.300", lambda p: within("act_date", "valid_from", "valid_to"), "certificate is not valid on the act's date")
dated("DATE.302", lambda p: F.col("valid_to") >= F.lit(p.get("today")).cast("date"), "certificate has expired", "valid_to is not null")
dated("DATE.303", lambda p: F.col("valid_from") <= F.lit(p.get("today")).cast("date"), "certificate is not in force yet", "valid_from is not null")
dated("DATE.304", lambda p: F.col("prolonged_to") >= F.col("act_date"), "the prolongation does not reach the act", "prolonged_to is not null and valid_to < act_date")
dated("DATE.310", lambda p: F.col("issued_at") <= F.col("act_date"), "document was issued after use")
dated("DATE.311", lambda p: F.datediff("act_date", "issued_at") <= p.get("days", 3650), "document is too old", "issued_at <= act_date")
dated("DATE.312", lambda p: F.col("made_at") <= F.col("works_end"), "batch was made after the works")
dated("DATE.320", lambda p: _days("shipped_at", "works_end") <= p.get("days", 0), "mix was shipped on another day than it was used", "doc_type = 'mix_quality_doc' and is_known")


def on_test_day(code: str, end: str, message: str) -> None:
    @rule(code)
    def check(graph: Graph, p: dict) -> DataFrame:
        return judged(graph["protocols"], "protocol_id", F.col("tested_at") <= F.col(end), message)


on_test_day("DATE.330", "accredited_to", "accreditation had ended on the day of the test")
on_test_day("DATE.331", "calibrated_to", "calibration had ended on the day of the test")


@rule("DATE.332")
def laboratory_listed(graph: Graph, p: dict) -> DataFrame:
    known = graph["laboratories"].groupBy(phrase(F.col("attestat")).alias("k")).agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
    j = graph["protocols"].withColumn("k", phrase(F.col("attestat"))).join(known, "k", "left")
    return judged(j, "protocol_id", within("tested_at", "valid_from", "valid_to"), "laboratory was not accredited on the day of the test")


@rule("DATE.372")
def protocol_covers(graph: Graph, p: dict) -> DataFrame:
    """Each batch of an act has a protocol not later than the grace period after the act."""
    tested = graph["protocols"].groupBy("batch_id").agg(F.min("tested_at").alias("tested_at"))
    j = graph["batches"].join(graph["acts"].select("act_id", "act_date"), "act_id").join(tested, "batch_id", "left")
    return judged(j, "batch_id", F.coalesce(F.col("tested_at") <= F.date_add("act_date", p.get("grace", 3)), F.lit(False)), "no protocol covers the batch")


@rule("SIG.STAMP.370")
def stamp_valid(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["stamps"], "stamp_id", within("signed_at", "valid_from", "valid_to"), "the signature's certificate was not in force")


@rule("SIG.PDF.371")
def signature_probe(graph: Graph, p: dict) -> DataFrame:
    return judged(graph["stamps"], "stamp_id", F.when(F.col("probe") == "embedded", True).when(F.col("probe") == "absent", False), "no embedded signature")


# ---------------------------------------------------------------- evidence documents
def complete(code: str, doc_type: str, fields: Sequence[str], term: tuple[str, str] | None = None) -> None:
    """Documents of a type with all required fields, and a term that does not end before it begins."""

    @rule(code, doc_type)
    def check(graph: Graph, p: dict) -> DataFrame:
        ok = filled(*fields)
        if term:
            ok = ok & F.coalesce(F.col(term[0]) <= F.col(term[1]), F.lit(True))
        return judged(graph["documents"].where((F.col("doc_type") == doc_type) & F.col("is_known")), "document_id", ok, "required details are missing or out of order")


complete("CERT.600", "certificate", ("number", "valid_from", "valid_to"), ("valid_from", "valid_to"))
complete("DECL.601", "declaration", ("number", "valid_from", "valid_to"), ("valid_from", "valid_to"))
complete("PASS.611", "passport", ("number", "issued_at"))
complete("TP.620", "tech_passport", ("number",))
complete("CONCL.660", "conclusion", ("number", "issued_at"))
complete("REFUS.670", "refusal_letter", ("number", "issued_at"))


@rule("PASS.610", "passport")
def norms_met(graph: Graph, p: dict) -> DataFrame:
    """Rows of norm and fact; undetermined where either isn't a number."""
    state = cells.compared(cells.requirement(F.col("norm")), cells.measured(F.col("fact")))
    return judged(graph["norms"], "norm_id", F.when(state != "undecidable", state == "ok"), "a measured value breaks its norm")


@rule("MILL.630")
def steel_mark(graph: Graph, p: dict) -> DataFrame:
    allowed = graph["design_marks"].groupBy("act_id").agg(F.collect_set(mark(F.col("mark"))).alias("allowed"))
    m = mark(F.col("mark"))
    return judged(graph["mill_certificates"].join(allowed, "act_id", "left"), "cert_id", F.when((m != "") & F.col("allowed").isNotNull(), F.array_contains("allowed", m)), "the steel mark is not the design's")


@rule("MIX.640")
def mix_class(graph: Graph, p: dict) -> DataFrame:
    """The classes (B25, В7,5) named in item 1 include the passport's."""
    named = F.transform(F.regexp_extract_all("works", F.lit(r"(?iu)(?<![\p{L}\d])[BВ]\d{1,3}(?:[.,]5)?"), F.lit(0)), lambda x: F.replace(mark(F.replace(x, F.lit(","), F.lit("p"))), F.lit("P"), F.lit(",")))
    j = graph["mixes"].join(graph["acts"].select("act_id", named.alias("named")), "act_id")
    mine = F.replace(mark(F.replace(F.col("mix_class"), F.lit(","), F.lit("p"))), F.lit("P"), F.lit(","))
    return judged(j, "mix_id", F.when(F.size("named") > 0, F.array_contains("named", mine)), "the mix is not of the design's class")


@rule("LAB.650")
def strength_by_age(graph: Graph, p: dict) -> DataFrame:
    """Design age 28 days: the full strength; before that its share by days, as information only."""
    share = cells.strength_percent(F.col("percent"), F.col("actual"), F.col("required"))
    early = F.col("age_days") < p.get("design_age", 28)
    return judged(graph["strengths"], "strength_id", share >= F.when(early, p.get("early_percent", 70)).otherwise(100), "strength is below the required", F.when(early, "info"))


@rule("LAB.651")
def accepted_at_design_age(graph: Graph, p: dict) -> DataFrame:
    oldest = graph["strengths"].groupBy("act_id").agg(F.max("age_days").alias("age"))
    return judged(oldest, "act_id", F.col("age") >= p.get("design_age", 28), "no protocol at the design age")


@rule("SCH.680", "scheme")
def scheme_bound(graph: Graph, p: dict) -> DataFrame:
    schemes = graph["documents"].where("doc_type = 'scheme'")
    return judged(present(schemes, graph["stamps"].where("document_id is not null"), "document_id"), "document_id", filled("act_ref") & F.col("has"), "the scheme is not bound to an act or not stamped")


def run_rules(graph: Graph, snapshot: DataFrame, parameters: dict[str, dict] | None = None, codes: Sequence[str] | None = None, profile_ready: bool = True, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(findings, verdicts). snapshot: code, enabled, severity, deterministic, and blocking if it says so.

    Verdicts: code, verdict (skipped, n_a, fail, undetermined, pass), checked, open, undetermined, blocking.
    """
    chosen = sorted(codes or RULES)
    if "blocking" not in snapshot.columns:
        snapshot = snapshot.withColumn("blocking", F.lit(True))
    types = {r[0] for r in graph["documents"].where("is_known").select("doc_type").distinct().collect()} if any(RULES[c].doc_type for c in chosen) else set()  # a row a type
    gated = {c for c in chosen if (RULES[c].profile and not profile_ready) or (RULES[c].doc_type and RULES[c].doc_type not in types)}
    parts = [RULES[c].evaluate(graph, (parameters or {}).get(c, {})).withColumn("code", F.lit(c)) for c in chosen if c not in gated]
    none = snapshot.sparkSession.createDataFrame([], "target_id string, state string, message string, confidence double, lowered string, code string")
    found = reduce(DataFrame.unionByName, parts, none).join(F.broadcast(snapshot), "code").where("enabled")  # one row a rule
    soft = (F.col("state") == "open") & (F.col("confidence") < min_confidence)
    found = found.withColumn("state", F.when(soft, "undetermined").otherwise(F.col("state")))
    order = F.array(*map(F.lit, SEVERITIES))
    lower = F.array_position(order, F.col("lowered")) < F.array_position(order, F.col("severity"))
    found = found.withColumn("severity", F.when(F.col("lowered").isNotNull() & lower, F.col("lowered")).otherwise(F.col("severity"))).drop("lowered")
    found = found.withColumn("is_blocking", F.col("blocking") & (F.col("state") == "open") & F.col("deterministic") & (F.col("severity") == "error"))
    worst = found.groupBy("code").agg(
        F.count("*").alias("checked"), F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") == "undetermined").alias("undetermined"), F.count_if("is_blocking").alias("n_blocking")
    )
    n_a = F.col("code").isin(list(gated)) | (F.coalesce("checked", F.lit(0)) == 0)
    verdict = F.when(~F.col("enabled"), "skipped").when(n_a, "n_a").when(F.col("open") > 0, "fail").when(F.col("undetermined") > 0, "undetermined").otherwise("pass")
    every = snapshot.where(F.col("code").isin(chosen)).join(worst, "code", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(n) for c, n in (("checked", "checked"), ("open", "open"), ("undetermined", "undetermined"), ("n_blocking", "blocking"))]
    return found.where("state <> 'ok'"), every.select("code", verdict.alias("verdict"), *zero)


def run_summary(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counters of a run."""
    v = verdicts.agg(F.count("*").alias("rules"), *[F.count_if(F.col("verdict") == x).alias(n) for x, n in (("pass", "passed"), ("fail", "failed"), ("undetermined", "undetermined"), ("n_a", "not_applicable"), ("skipped", "skipped"))])
    f = findings.agg(F.count("*").alias("findings"), F.count_if("is_blocking").alias("blocking"), *[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))])
    return v.crossJoin(f)  # one row each
