"""Cells of printed tables as column expressions: norms and measurements, dates, numbers with dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.text import clean_doc_no, once, plain_number

# fixed values: stems of the months in order, as dates spell them out
MONTHS = ("январ", "феврал", "март", "апрел", "ма", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр")
# fixed values: words and signs that begin a lower and an upper bound
AT_LEAST = r"не\s+менее|не\s+ниже|не\s+меньше|≥|>="
AT_MOST = r"не\s+более|не\s+выше|не\s+больше|не\s+превыша\p{L}*|≤|<="
_NUM = r"([-+]?\d+(?:[.,]\d+)?)"
_BARE = r"(\d+(?:[.,]\d+)?)"
# fixed values: how cells print a day, a term and a day of issue
DAY = r"(\d{1,2}\.\d{1,2}\.\d{4})"


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\u00a0\u202f]", " "))


def _group(c: Column, pattern: str, g: int) -> Column:
    return F.regexp_extract(c, pattern, g)


def _value(c: Column, pattern: str, g: int) -> Column:
    return F.replace(_group(c, pattern, g), F.lit(","), F.lit(".")).try_cast("double")


def requirement(c: Column) -> Column:
    """STRUCT(kind, lo, hi, unit) of a norm; kind range, min, max, exact or unparsed.

    The first form that is found counts: centre with one tolerance, centre with two, от … до,
    two numbers around dots or a long dash, bounds in words (both make a range), one number.
    """
    text = _spaced(c)
    # fixed values: the forms in which norms are printed; after a bound the rest may run over lines
    both = rf"(?iu){_NUM}\s*(?:±|\+/-|\+-)\s*{_NUM}(.*)$"
    each = rf"(?iu){_NUM}\s*\+\s*{_BARE}\s*/\s*-\s*{_BARE}(.*)$"
    span = rf"(?iu)от\s*{_NUM}\s*до\s*{_NUM}(.*)$"
    dots = rf"(?iu){_NUM}\s*(?:\.\.\.|…|―|—)\s*{_NUM}(.*)$"
    low, high = rf"(?iu)(?:{AT_LEAST})\s*{_NUM}((?s:.*))$", rf"(?iu)(?:{AT_MOST})\s*{_NUM}((?s:.*))$"
    one = rf"(?iu)^\s*{_NUM}\s*(.*)$"
    null = F.lit(None).cast("double")

    def made(kind: str, lo: Column, hi: Column, rest: Column | None) -> Column:
        unit = F.nullif(F.regexp_extract(F.regexp_replace(rest, r"^[\s)]+", ""), r"^([^\s,;]{1,16})", 1), F.lit("")) if rest is not None else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), unit.alias("unit"))

    has = text.rlike
    centre = lambda p: _value(text, p, 1)
    return (
        F.when(has(both), made("range", centre(both) - F.abs(_value(text, both, 2)), centre(both) + F.abs(_value(text, both, 2)), _group(text, both, 3)))
        .when(has(each), made("range", centre(each) - _value(text, each, 3), centre(each) + _value(text, each, 2), _group(text, each, 4)))
        .when(has(span), made("range", _value(text, span, 1), _value(text, span, 2), _group(text, span, 3)))
        .when(has(dots), made("range", _value(text, dots, 1), _value(text, dots, 2), _group(text, dots, 3)))
        .when(has(low) & has(high), made("range", _value(text, low, 1), _value(text, high, 1), _group(text, high, 2)))
        .when(has(low), made("min", _value(text, low, 1), null, _group(text, low, 2)))
        .when(has(high), made("max", null, _value(text, high, 1), _group(text, high, 2)))
        .when(has(one), made("exact", _value(text, one, 1), _value(text, one, 1), _group(text, one, 2)))
        .when(c.isNotNull(), made("unparsed", null, null, None))
    )


def measured(c: Column) -> Column:
    """The first number of a cell that stands at its start, after a space or a bracket; else null."""
    return _value(_spaced(c), rf"(?:^|[\s(]){_NUM}", 1)


def compared(norm: Column, value: Column) -> Column:
    """ok, violated or undecidable. An exact norm allows half a unit of its last printed digit."""
    exact = norm["lo"]
    decimals = F.length(F.regexp_extract(plain_number(exact), r"\.(?!0$)(\d+)$", 1))
    slack = F.greatest(F.abs(exact) * 1e-9, 0.5 * F.pow(F.lit(10.0), -decimals))
    inside = (
        F.when(norm["kind"] == "exact", F.abs(value - exact) <= slack)
        .otherwise((norm["lo"].isNull() | (value >= norm["lo"])) & (norm["hi"].isNull() | (value <= norm["hi"])))
    )
    return F.when(norm.isNull() | (norm["kind"] == "unparsed") | value.isNull(), "undecidable").when(inside, "ok").otherwise("violated")


def norm_rows(c: Column) -> Column:
    """ARRAY<STRUCT(indicator, norm, fact)> of a JSON array of objects with several spellings of the keys."""
    names = {"indicator": ("indicator", "name", "показатель", "parameter"), "norm": ("norm", "requirement", "норма", "nd"), "fact": ("fact", "actual", "факт", "value")}
    rows = F.from_json(c, "array<map<string,string>>")
    first = lambda r, keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at(r, F.lit(k))), F.lit("")) for k in keys], F.lit(""))
    made = F.transform(rows, lambda r: F.struct(*[first(r, keys).alias(n) for n, keys in names.items()]))
    return F.filter(made, lambda r: (r["norm"] != "") | (r["fact"] != ""))


def _date(c: Column, pattern: str, at: int = 1) -> Column:
    return F.try_to_date(F.nullif(_group(c, pattern, at), F.lit("")), "d.M.yyyy")


def printed_date(c: Column) -> Column:
    """A date in figures (all of the cell), or with its month spelled out; null if there is no such day."""
    text = F.trim(c)
    words = rf"(?iu)(\d{{1,2}})\D+?({'|'.join(MONTHS)})[а-я]*\D+?(\d{{4}})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(_group(text, words, 2)))
    spelled = F.try_to_date(F.concat_ws(".", _group(text, words, 1), month.cast("string"), _group(text, words, 3)), "d.M.yyyy")
    return F.coalesce(F.when(text.rlike(rf"^{DAY}$"), _date(text, rf"^{DAY}$")), F.when(text.rlike(words), spelled))


# fixed values: a term and a day of issue behind a number
_RANGE = rf"(?iu)(?:^|[\s;,(])[сc]\s*[;,]?\s*{DAY}\s*[;,]?\s*по\s*[;,]?\s*{DAY}"
_ISSUED = rf"(?iu)(?:^|[\s;,(])от\s*[;,]?\s*{DAY}"


def _days(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(DAY), F.lit(0))


def _is_term(c: Column, days: Column) -> Column:
    """Whether a cell with these days prints a term; fewer than two days never do."""
    return (F.size(days) > 1) & c.rlike(_RANGE)


def number_cell(c: Column) -> Column:
    """STRUCT(number, valid_from, valid_to, issued_at, comparable) of «№ … с d1 по d2» or «№ … от d».

    «б/н» is a number that compares with none.
    """
    known = once(_days(c), lambda days: F.struct(c.alias("c"), _is_term(c, days).alias("term"), ((F.size(days) > 0) & c.rlike(_ISSUED)).alias("issued")))

    def read(k: Column) -> Column:
        head = F.when(k["term"], F.regexp_replace(k["c"], rf"{_RANGE}(?s:.*)$", "")).when(k["issued"], F.regexp_replace(k["c"], rf"{_ISSUED}(?s:.*)$", "")).otherwise(k["c"])
        return once(clean_doc_no(head), lambda no: once(F.struct(no.alias("no"), no.rlike(r"(?iu)^б\s*[/\\.]?\s*н\.?$").alias("without")), lambda n: made(k, n["no"], n["without"])))

    def made(k: Column, no: Column, without: Column) -> Column:
        return F.struct(
            F.when(without, "б/н").otherwise(F.nullif(no, F.lit(""))).alias("number"), F.when(k["term"], _date(k["c"], _RANGE, 1)).alias("valid_from"), F.when(k["term"], _date(k["c"], _RANGE, 2)).alias("valid_to"),
            F.when(~k["term"] & k["issued"], _date(k["c"], _ISSUED)).alias("issued_at"), (~without & (no != "")).alias("comparable"),
        )

    return once(known, read)


def date_cell(c: Column) -> Column:
    """STRUCT(valid_from, valid_to, issued_at): a term, two dates as a term, one date as the issue."""
    return once(_days(c), lambda days: _dates(c, days))


def _dates(c: Column, days: Column) -> Column:
    """The dates of a cell whose days are known."""
    none = F.lit(None).cast("date")
    day = lambda i: F.try_to_date(days[i], "d.M.yyyy")
    made = lambda a, b, i: F.struct(a.alias("valid_from"), b.alias("valid_to"), i.alias("issued_at"))
    return F.when(_is_term(c, days), made(_date(c, _RANGE, 1), _date(c, _RANGE, 2), none)).when(F.size(days) > 1, made(day(0), day(1), none)).when(F.size(days) == 1, made(none, none, day(0))).otherwise(made(none, none, none))


def transfer_date_cell(c: Column) -> Column:
    """STRUCT(valid_from, valid_to, issued_at, month_only): as date_cell, «до d» as the end of a term; a month
    without its day is no date, but is told apart from an empty cell."""
    # fixed values: an end alone, a month in figures, a month in words
    until, figures = rf"(?iu)(?:^|[\s;,(])(?:действ[а-яё]*\s+)?до\s*[;,]?\s*{DAY}", r"(?:^|[^\d.])(\d{1,2})\.(\d{4})(?!\s*\d)"
    words = r"(?iu)(январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)[а-яё]*\.?\s*\.?\s*(\d{4})"
    none = F.lit(None).cast("date")
    made = lambda a, b, i, m: F.struct(a.alias("valid_from"), b.alias("valid_to"), i.alias("issued_at"), m.alias("month_only"))

    def read(days: Column) -> Column:
        end = (F.size(days) > 0) & ~_is_term(c, days) & c.rlike(until)
        dated = once(_dates(c, days), lambda p: made(p["valid_from"], p["valid_to"], p["issued_at"], F.lit(False)))
        return F.when(end, made(none, _date(c, until), none, F.lit(False))).when(F.size(days) > 0, dated).otherwise(made(none, none, none, c.rlike(figures) | c.rlike(words)))

    return once(_days(c), read)


def count_cell(c: Column) -> Column:
    """One to four digits, шт. after them or not."""
    return F.regexp_extract(c, r"(?iu)^\s*(\d{1,4})\s*(?:шт\.?)?\s*$", 1).try_cast("int")


def strength_percent(direct: Column, actual: Column, required: Column) -> Column:
    return F.coalesce(direct, F.when(required > 0, actual / required * 100))


def relevant_date(basis: Column, made: Column, shipped: Column, works_end: Column, act: Column) -> Column:
    """The date that a document must be valid on: of production, delivery or application, each
    falling back to the end of the works, then the act."""
    own = F.when(basis == "production", F.coalesce(made, shipped)).when(basis == "delivery", F.coalesce(shipped, made))
    return F.when(basis.isin("production", "delivery", "application"), F.coalesce(own, works_end, act))
