"""Requisites of documents: patterns over page texts with places, merged over a document's pages.

Every field is data: how its hits merge, and stages of patterns whose first group is the value. A stage's
hits are built-in expressions over the text (the pieces between matches give their places), so
a page is read inside its row; only hits are shuffled, by document and field.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.cells import MONTHS
from sluice.functions.text import inn_ok, ogrn_ok, once

# fixed values: how sure a hit is that stands behind its label, has a shape of its own, is a weak sign, or fails its check digits
LABELLED, SHAPED, WEAK, FAILED = 0.9, 0.8, 0.35, 0.45
# fixed values: dates in figures and in words
NUMERIC = r"\d{1,2}\.\d{1,2}\.\d{4}"
VERBAL = rf"[«\"']?\s*\d{{1,2}}\s*[»\"']?\s*(?:{'|'.join(MONTHS)})[а-я]*\s*\d{{4}}"
DATE = f"(?:{NUMERIC}|{VERBAL})"
# fixed values: words behind a number sign that are no numbers, and what stands around the dates of a signature stamp
NO_NUMBERS = ("док", "п/п", "пп", "партии", "плавки")
STAMP_BEFORE, STAMP_AFTER = r"(?iu)[0-9A-F]{16,}|ЭЛЕКТРОННОЙ\s+ПОДПИСЬЮ|Отпечаток\s+и\s+реквизиты", r"(?iu)^\s*\d{1,2}:\d{2}\s*UTC|^\s*UTC"
BEFORE_CHARS, AFTER_CHARS = 160, 24


@dataclass(frozen=True)
class Stage:
    """A pattern whose first group is the value; only: number (no stop word) or unsigned (outside a signature stamp)."""

    pattern: str
    confidence: float
    only: str | None = None


@dataclass(frozen=True)
class Field:
    """merge: text, date, number or list."""

    code: str
    merge: str
    stages: tuple[Stage, ...]


def _one(code: str, pattern: str, confidence: float = LABELLED, merge: str = "text", only: str | None = None) -> Field:
    return Field(code, merge, (Stage(pattern, confidence, only),))


def _dated(*labels: str) -> str:
    return rf"(?iu)(?:{'|'.join(labels)})\s*[:;]?\s*({DATE})"


# fixed values: the patterns of the requisites
_TAIL = r"(?:[^\S\n]+(?:\d+|(?!ООО|ОАО|ЗАО|ПАО|АО|ИП|ГОСТ|ТУ|СТО|СП|ОТ|ПО|ДО|ВЫДАН|С)[A-ZА-Я][0-9A-ZА-Я./\-]*)){0,4}"
_STANDARD, _BATCH = r"(?iu)((?:ГОСТ(?:\s+Р)?|СТО|ТУ)\s+[0-9][0-9A-ZА-Я./-]*)", r"(?iu)парти[ияюе][^0-9№]{0,15}(?:№|N)?\s*([0-9][^\s|,;]*)"
BASE = (
    Field("number", "text", (Stage(rf"№\s*([^\s|]+{_TAIL})(?=\s*(?:от|с)\s+{DATE}|[\s,;.]|\z)", LABELLED, "number"), Stage(r"(?:^|\n)\s*N\s*([^\s|]+)", WEAK, "number"))),
    _one("blank_number", r"(?iu)бланк[а-я]*\s*(?:№|N)?\s*([0-9]{4,}[^\s|]*)", SHAPED),
    Field("issued_at", "date", (Stage(_dated(r"дата\s+выдачи", r"дата\s+регистрации", "выдан[аон]?"), LABELLED), Stage(rf"(?iu)(?:^|[\s|(])от\s*[;,]?\s*({DATE})", LABELLED), Stage(f"({NUMERIC})", WEAK, "unsigned"))),
    _one("valid_from", rf"(?iu)(?:^|[\s|(])[сc]\s*[;,]?\s*({DATE})\s*[;,]?\s*по\s", merge="date", only="unsigned"),
    Field("valid_to", "date", (Stage(rf"(?iu)\sпо\s*[;,]?\s*({DATE})", LABELLED, "unsigned"), Stage(rf"(?iu)действ[а-я]*\s+до\s*[;,]?\s*({DATE})", LABELLED, "unsigned"))),
    _one("issuer_accreditation", r"(?iu)((?:RA|РА)\.(?:RU|РУ)\.?[0-9A-ZА-Я]{2,12})", SHAPED),
    _one("issuer_accreditation_valid_to", rf"(?iu)аккредитаци[а-я]*[^.\n]{{0,40}}?до\s*[;,]?\s*({DATE})", merge="date"),
    _one("manufacturer_inn", r"(?iu)ИНН\s*[:;]?\s*(\d{9,12})"),
    _one("gost_tu", _STANDARD, SHAPED, "list"),
    Field("okpd2", "text", (Stage(r"(?iu)ОКПД\s*2?\s*[:;]?\s*(\d{2}(?:\.\d{1,3}){1,4})", LABELLED), Stage(r"(?iu)ОК\s*;?\s*034-2014[^\d]{0,40}(\d{2}(?:\.\d{1,3}){2,4})", SHAPED))),
    _one("tnved", r"(?iu)ТН\s*ВЭД[^0-9]{0,30}(\d[\d\s]{3,13}\d)"),
    _one("batch_no", _BATCH),
    _one("heat_no", r"(?iu)плавк[аиуе][^0-9№]{0,15}(?:№|N)?\s*([0-9][^\s|,;]*)"),
    _one("manufactured_at", _dated(r"дата\s+изготовлени[яе]", "изготовлен[аоы]?"), merge="date"),
)
TYPED = (
    _one("batch_number", _BATCH),
    _one("order_number", r"(?iu)приказ[а-я]*\s*(?:№|N)\s*([^\s|,;]+)"),
    _one("order_date", rf"(?iu)приказ[а-я]*[^\n]{{0,40}}?от\s*({DATE})", merge="date"),
    _one("act_date", rf"(?iu)акт[а-я]*[^\n]{{0,40}}?от\s*({DATE})", merge="date"),
    _one("tested_at", _dated(r"дата\s+испытани[йяе]", "испытан[аоы]"), merge="date"),
    _one("sampled_at", _dated(r"дата\s+(?:и\s+время\s+)?отбора"), merge="date"),
    _one("made_at", _dated(r"дата\s+изготовления\s+образцов"), merge="date"),
    _one("measured_at", _dated(r"дата\s+измерени[йяе]"), merge="date"),
    _one("shipped_at", _dated(r"дата\s+отгрузки", "отгружен[аоы]?"), merge="date"),
    _one("valid_until", rf"(?iu)срок\s+действи[яю][^\n]{{0,20}}?до\s*({DATE})", merge="date"),
    _one("nd_reference", _STANDARD, SHAPED, "list"),
    _one("nd_requirements", _STANDARD, SHAPED, "list"),
    _one("concrete_class", r"(?:^|[\s|(])((?:В|B)\s?\d{1,3}(?:[,.]\d)?)(?=[\s|,;)]|\z)", SHAPED),
    _one("frost_resistance", r"(?iu)(?:^|[\s|(])(F\s?\d{2,3})(?=[\s|,;)]|\z)", SHAPED),
    _one("water_resistance", r"(?iu)(?:^|[\s|(])(W\s?\d{1,2})(?=[\s|,;)]|\z)", SHAPED),
    _one("steel_class", r"(?:^|[\s|(])([АA]\s?\d{3}[СCНH]?)(?=[\s|,;)]|\z)", SHAPED),
    _one("age_days", r"(?iu)возраст[^\d\n]{0,40}(\d{1,3})\s*сут", merge="number"),
    _one("test_pressure", r"(?iu)(?:испытательн[а-я]*\s+)?давлени[ея][^\d\n]{0,20}(\d+(?:[.,]\d+)?\s*(?:МПа|кПа|бар))"),
    _one("registry_number", r"(?iu)ОГРН(?:ИП)?\s*[:;]?\s*(\d{11,16})"),
)
FIELDS = {f.code: f for f in BASE + TYPED}
#: small letters that stand in every hit of a field: texts without any of them are not searched
_SIGNS = {
    "blank_number": ("бланк",), "valid_to": ("по", "до"), "issuer_accreditation": ("ra.", "ра."), "issuer_accreditation_valid_to": ("аккредитаци",), "manufacturer_inn": ("инн",), "gost_tu": ("гост", "сто", "ту"), "nd_reference": ("гост", "сто", "ту"), "nd_requirements": ("гост", "сто", "ту"),
    "okpd2": ("окпд", "034-2014"), "tnved": ("вэд",), "batch_no": ("парти",), "batch_number": ("парти",), "heat_no": ("плавк",), "manufactured_at": ("изготовлен",), "order_number": ("приказ",), "order_date": ("приказ",), "act_date": ("акт",), "tested_at": ("испытан",), "sampled_at": ("отбора",),
    "made_at": ("образцов",), "measured_at": ("измерени",), "shipped_at": ("отгру",), "valid_until": ("действи",), "age_days": ("возраст",), "test_pressure": ("давлени",), "registry_number": ("огрн",),
}
_CHECKS = {"manufacturer_inn": inn_ok, "registry_number": ogrn_ok}


_HITS = "array<struct<value:string,confidence:double,char_start:int,char_end:int>>"


def unmarked(text: Column) -> Column:
    """The text with the marks of ``hits`` as another control character, so that its characters keep their places."""
    return F.when(text.rlike("[\x01-\x03]"), F.translate(text, "\x01\x02\x03", "\x04\x04\x04")).otherwise(text)


def hits(text: Column, stage: Stage, safe: Column | None = None) -> Column:
    """ARRAY<STRUCT(value, confidence, char_start, char_end)> of a stage in the order of the text; safe is its ``unmarked``.

    Places: one scan writes marks around every match and its value; the parts between the marks
    add up to the text, and the value stands where it first occurs in its match.
    """
    marked = F.regexp_replace(unmarked(text) if safe is None else safe, stage.pattern, "\x01$0\x02$1\x03")
    value = lambda x: F.substring_index(F.substring_index(x, "\x03", 1), "\x02", -1)
    size = lambda x: F.length(x) - F.length(value(x)) - 2

    def placed(parts: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(parts, 2, i), F.length(F.get(parts, F.lit(0))), lambda acc, x: acc + size(x))
        at = F.transform(F.slice(parts, 2, F.size(parts)), lambda x, i: F.struct(F.length(value(x)).alias("n"), (before(i) + F.instr(F.substring_index(x, "\x02", 1), value(x)) - 1).alias("a")))
        of = lambda x: F.substring(text, x["a"] + 1, x["n"])
        return F.transform(at, lambda x: F.struct(F.trim(F.regexp_replace(of(x), r"^\s+|\s+$", "")).alias("value"), F.lit(stage.confidence).alias("confidence"), x["a"].alias("char_start"), (x["a"] + x["n"]).alias("char_end")))

    made = once(F.split(marked, "\x01", -1), placed)
    if stage.only == "number":
        bare = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, "^[«»\"'‚„]+", ""), "[«»\"'‚„.,;:]+$", ""))
        first = lambda v: F.lower(F.regexp_replace(F.regexp_extract(bare(v), r"^\S+", 0), "[.:]+$", ""))
        return F.filter(made, lambda h: (bare(h["value"]) != "") & ~first(h["value"]).isin(*NO_NUMBERS))
    if stage.only == "unsigned":
        begin = lambda h: F.greatest(h["char_start"] - BEFORE_CHARS, F.lit(0))
        before = lambda h: F.substring(text, begin(h) + 1, h["char_start"] - begin(h))
        after = lambda h: F.substring(text, h["char_end"] + 1, F.lit(AFTER_CHARS))
        return F.filter(made, lambda h: ~before(h).rlike(STAMP_BEFORE) & ~after(h).rlike(STAMP_AFTER))
    return made


def field_hits(pages: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """(doc, page, code, place, value, confidence, char_start, char_end): of each page and field the first stage with hits."""
    text = F.coalesce("text", F.lit(""))

    def first(stages: Sequence[Column]) -> Column:
        return stages[0] if len(stages) == 1 else once(stages[0], lambda a: F.when(F.size(a) > 0, a).otherwise(first(stages[1:])))

    def found(f: Field) -> Column:
        whole = first([hits(F.col("text"), s, F.col("safe")) for s in f.stages])
        signs = [F.contains(F.col("low"), F.lit(w)) for w in _SIGNS.get(f.code, ())]
        return F.when(reduce(lambda a, b: a | b, signs), whole).otherwise(F.array().cast(_HITS)) if signs else whole

    every = F.array(*[F.struct(F.lit(f.code).alias("code"), found(f).alias("hits")) for f in fields])
    return pages.select("doc", "page", text.alias("text"), F.lower(text).alias("low"), unmarked(text).alias("safe")).select("doc", "page", F.inline(every)).select("doc", "page", "code", F.posexplode("hits").alias("place", "h")).select("doc", "page", "code", "place", "h.*")


def _iso(c: Column) -> Column:
    words = rf"(?iu)(\d{{1,2}})\D+?({'|'.join(MONTHS)})[а-я]*\D+?(\d{{4}})"
    part = lambda g: F.regexp_extract(c, words, g)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2)))
    figures = F.when(c.rlike(rf"^{NUMERIC}$"), F.try_to_date(c, "d.M.yyyy"))
    return F.coalesce(figures, F.try_to_date(F.concat_ws(".", part(1), month.cast("string"), part(3)), "d.M.yyyy"))


def merged(found: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """(doc, code, value_text, value_date, value_num, value_list, confidence, page, char_start, char_end).

    The surest hit of a document counts, the first among equals; values whose check digits fail are less sure.
    A date that is no day leaves its field out. Lists hold every value once, case and spaces aside,
    in the order of the text, and are as sure as their weakest.
    """
    kind = F.coalesce(*[F.when(F.col("code").isin(*codes), F.lit(m)) for m in ("text", "date", "number", "list") if (codes := [f.code for f in fields if f.merge == m])])
    failed = reduce(lambda a, b: a | b, [(F.col("code") == c) & ~ok(F.col("value")) for c, ok in _CHECKS.items()])
    h = found.withColumns({"confidence": F.when(F.coalesce(failed, F.lit(False)), FAILED).otherwise(F.col("confidence")), "merge": kind})
    row = F.struct("value", "confidence", "page", "char_start", "char_end")
    best = h.where("merge <> 'list'").groupBy("doc", "code", "merge").agg(F.min_by(row, F.struct(-F.col("confidence"), "page", "place")).alias("b")).select("doc", "code", "merge", "b.*")
    day = F.when(F.col("merge") == "date", _iso(F.col("value")))
    none = F.lit(None)
    single = best.withColumn("day", day).where("merge <> 'date' or day is not null").select(
        "doc", "code", F.when(F.col("merge") == "text", F.col("value")).alias("value_text"), F.col("day").alias("value_date"), F.when(F.col("merge") == "number", F.col("value")).alias("value_num"),
        none.cast("array<string>").alias("value_list"), "confidence", "page", "char_start", "char_end",
    )
    key = F.upper(F.regexp_replace("value", r"\s+", " "))
    once = h.where("merge = 'list'").groupBy("doc", "code", key.alias("k")).agg(F.min_by(F.struct("page", "place", "value", "confidence", "char_start", "char_end"), F.struct("page", "place")).alias("r"))
    items = once.groupBy("doc", "code").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # distinct values of one document
    values = F.transform("rs", lambda r: r["value"])
    listed = items.select(
        "doc", "code", F.array_join(values, "; ").alias("value_text"), none.cast("date").alias("value_date"), none.cast("string").alias("value_num"), values.alias("value_list"), F.array_min(F.transform("rs", lambda r: r["confidence"])).alias("confidence"),
        *[F.col("rs")[0][c].alias(c) for c in ("page", "char_start", "char_end")],
    )
    return single.unionByName(listed)


def extract(pages: DataFrame, typed: DataFrame, schemas: Mapping[str, Sequence[str]]) -> DataFrame:
    """Requisites of documents: pages (doc, page, text), typed (doc, doc_type, confident), schemas type -> codes.

    The base fields are looked for in every document, a type's own only where the type is sure.
    """
    more = [FIELDS[c] for c in dict.fromkeys(c for codes in schemas.values() for c in codes) if c in FIELDS and FIELDS[c] not in BASE]
    base = field_hits(pages, BASE)
    sure = typed.where("confident and doc_type is not null").select("doc", "doc_type")
    wanted = F.coalesce(*[F.when(F.col("doc_type") == t, F.array(*map(F.lit, codes))) for t, codes in schemas.items()], F.array().cast("array<string>"))
    own = field_hits(pages.join(sure, "doc").select("doc", "page", "text"), more).join(sure, "doc").where(F.array_contains(wanted, F.col("code"))).drop("doc_type") if more else base.limit(0)
    return merged(base.unionByName(own), [*BASE, *more])
