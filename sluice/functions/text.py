"""Scalar text functions as column expressions: normal forms, checksums, masks, templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters that a document number may spell a dash with
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d"
# fixed values: Cyrillic capitals and their Latin look-alikes, for document numbers
NUMBER_FROM, NUMBER_TO = "АВЕКМНОРСТХУR", "ABEKMHOPCTXUP"
# fixed values: the wider table of look-alikes, for names and standards
NAME_FROM, NAME_TO = "АВЕКМНОРСТХУІЅЈ", "ABEKMHOPCTXUISJ"
# fixed values: any character but those that most numbers are made of, which are their own capitals (capitals cost more than a look)
MAY_BE_LOWER = "[^A-ZА-ЯЁ0-9 №/.-]"
# fixed values: white space in patterns
SPACES = " \t\n\x0b\f\r"
# fixed values: characters that a document number is compared without (spaces, quotes, number sign, soft hyphen, semicolon)
NUMBER_DROPPED = SPACES + "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff;\u00ad№\"'`«»“”„‘’"
# fixed values: words after which a database quotes the name of a schema object
SCHEMA_WORDS = "relation|column|constraint|table|index|type|function|schema|role|database|sequence|view|trigger|operator|extension|policy"
MESSAGE_LENGTH = 300
# fixed values: weights of the check digits
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def doc_no(c: Column) -> Column:
    """Upper case, one kind of dash, without spaces, number sign, quotes, semicolons."""
    upper = F.when(c.rlike(MAY_BE_LOWER), F.upper(c)).otherwise(c)
    return F.translate(upper, DASHES + NUMBER_DROPPED, "-" * len(DASHES))


def doc_no_folded(c: Column) -> Column:
    return folded(doc_no(c))


def folded(key: Column) -> Column:
    """A comparison key with Latin letters for their look-alikes."""
    return F.translate(key, NUMBER_FROM, NUMBER_TO)


def fold_homoglyphs(c: Column) -> Column:
    return F.translate(F.upper(c), NAME_FROM, NAME_TO)


def standard(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold_homoglyphs(c), "[\"'`«»]", ""), r"[\s\u00a0]+", " "), r"\s*-\s*", "-"))


_YEAR = r"-((?:19|20)\d{2})(?:\s*\(.*\))?$"


def standard_without_year(c: Column) -> Column:
    return F.regexp_replace(standard(c), _YEAR, "")


def standard_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(standard(c), _YEAR, 1), F.lit(""))


def org_key(c: Column) -> Column:
    """Comparison form: look-alikes folded, letters and digits only. The legal form stays in it:
    after the fold it is spelled in Latin letters, which the list of forms is not."""
    return F.regexp_replace(fold_homoglyphs(c), r"[^\p{L}\p{N}]+", "")


def phrase(c: Column) -> Column:
    """Letters and digits in upper case, Ё as Е."""
    return F.regexp_replace(F.translate(F.upper(c), "Ё", "Е"), r"[^\p{L}\p{N}]+", "")


def org_name(c: Column) -> Column:
    """Import form: upper, Ё as Е, without quotes, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.upper(c), "Ё", "Е"), "[\"'«»“”„]", ""), r"\s+", " "))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def mark(c: Column) -> Column:
    return F.regexp_replace(fold_homoglyphs(c), r"[\s.\-]+", "")


def line(c: Column) -> Column:
    """A line without heading, list, quote and emphasis marks, outer pipes and double spaces."""
    # fixed values: the marks that may lead a line, and its outer pipes
    for mark_ in (r"^[\s>]*#{1,6}\s*", r"^[\s>*+-]+", r"[*_`]", r"^\s*\|\s*", r"\s*\|\s*\z"):
        c = F.regexp_replace(c, mark_, "")
    return F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " "))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r?\n"), line), lambda x: x != "")


def error_template(c: Column) -> Column:
    """A message with timestamps, uuids, long hex, key values, quoted values and numbers masked.

    Quoted names after one of SCHEMA_WORDS stay: other tables are other defects. Their quotes
    are set aside as control characters while the other quoted values are masked.
    """
    held = {"'": ("\x01", "'", "\x01"), '"': ("\x02", '"', "\x02"), "«": ("\x03", "»", "\x04")}
    # fixed values: the forms that are masked, in this order, and what stands for them
    for pattern, to in (
        (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<timestamp>"),
        (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
        (r"(?i)\b[0-9a-f]{16,}\b", "<hex>"),
        (r"\)=\([^)]*\)", ")=(<value>)"),
    ):
        c = F.regexp_replace(c, pattern, to)
    for opening, (left, closing, right) in held.items():
        c = F.regexp_replace(c, rf"(?i)\b({SCHEMA_WORDS})(\s+){opening}([A-Za-z_][A-Za-z0-9_]{{0,62}}){closing}", f"$1$2{left}$3{right}")
    c = F.regexp_replace(c, "'[^']*'|\"[^\"]*\"|«[^»]*»", "<value>")
    c = F.regexp_replace(c, r"(?<![\w$<])\d+(?:\.\d+)?", "<n>")
    c = F.translate(c, "\x01\x02\x03\x04", "'\"«»")
    c = F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " "))
    return F.when(F.length(c) > MESSAGE_LENGTH, F.concat(F.substring(c, 1, MESSAGE_LENGTH), F.lit("…"))).otherwise(c)


def fingerprint(*parts: Column, version: str = "v1") -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(version), *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def _control(c: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(c, i + 1, 1).try_cast("int") * w
    return total % 11 % 10


def inn_ok(c: Column) -> Column:
    """Check digits of a 10- or 12-digit taxpayer number; null stays null."""
    digit = lambda i: F.substring(c, i, 1).try_cast("int")
    ten = c.rlike(r"^\d{10}$") & (_control(c, INN10) == digit(10))
    twelve = c.rlike(r"^\d{12}$") & (_control(c, INN11) == digit(11)) & (_control(c, INN12) == digit(12))
    return F.when(c.isNotNull(), F.coalesce(ten, F.lit(False)) | F.coalesce(twelve, F.lit(False)))


def ogrn_ok(c: Column) -> Column:
    body = lambda n: F.substring(c, 1, n - 1).try_cast("long")
    last = lambda n: F.substring(c, n, 1).try_cast("int")
    short = c.rlike(r"^\d{13}$") & (body(13) % 11 % 10 == last(13))
    long = c.rlike(r"^\d{15}$") & (body(15) % 13 % 10 == last(15))
    return F.when(c.isNotNull(), F.coalesce(short, F.lit(False)) | F.coalesce(long, F.lit(False)))


def kpp_ok(c: Column) -> Column:
    return c.rlike(r"^\d{9}$")


def backoff_ms(attempt: Column, base: int = 5_000, cap: int = 600_000) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def iso_instant(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def registry_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, ";+", " "), r"[\s\u00a0]+", " "))


def clean_doc_no(c: Column) -> Column:
    """A number as printed: without number signs before it and punctuation around it."""
    bare = F.btrim(F.ltrim(F.ltrim(c, F.lit("№")), F.lit(SPACES)), F.lit(SPACES + ";,:"))
    return F.trim(F.regexp_replace(bare, r"\s{2,}", " "))


def observed_title(c: Column) -> Column:
    """What kind of document a title names: no Markdown, numbers, dates, end punctuation; where
    nothing is left, the title with its number."""
    tidy = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"[\s\u00a0]+", " ")), r"[\s.,;:\-–—]+$", ""))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[|>]", " "), r"^[\s#*_-]+", " "), r"[*_`]", " ")
    upper = F.translate(F.upper(F.regexp_replace(plain, r"^\s*\d+[.)]\s+", " ")), "Ё", "Е")
    day = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(upper, r"№\s*\S+", " "), rf"(^|\s)ОТ\s+{day}", " "), rf"\b{day}\b", " ")
    return F.when(tidy(kind) == "", tidy(upper)).otherwise(tidy(kind))


def person_key(c: Column) -> Column:
    """Surname and initials in one word, however the given names are written: ИВАНОВИП."""
    words = F.filter(F.split(F.translate(F.upper(c), "Ё", "Е"), r"[^\p{L}]+"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda x, i: F.when(i == 0, x).otherwise(F.substring(x, 1, 1))), "")


def sql_template(c: Column) -> Column:
    """A statement without its literals and numbers, on one line."""
    x = F.regexp_replace(F.regexp_replace(c, r"'(?:[^']|'')*'", "?"), r"\$\d+|\b\d+(?:\.\d+)?\b", "?")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)"))


def sql_verb(c: Column) -> Column:
    verb = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return F.when(verb.isin("select", "insert", "update", "delete", "with"), verb).otherwise("other")


def path_template(c: Column) -> Column:
    """A route without its query and its ids (uuids, numbers)."""
    x = F.regexp_replace(F.substring_index(c, "?", 1), r"(?i)/[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?=/|$)", "/:id")
    return F.regexp_replace(x, r"/\d+(?=/|$)", "/:id")


def redact_urls(c: Column) -> tuple[Column, Column]:
    """(text without absolute addresses, how many there were)."""
    url = r"https?://[^\s<>\"')\]]+"
    return F.regexp_replace(c, url, "[link]"), F.regexp_count(c, F.lit(url))


def filled(template: Column, values: Column) -> Column:
    """{name} place-holders replaced by the map's values; unknown ones stay."""
    return F.aggregate(F.map_entries(values), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def clip(c: Column, budget: int) -> Column:
    return F.when(F.length(c) > budget, F.concat(F.substring(c, 1, budget - 1), F.lit("…"))).otherwise(c)


def column_letter(i: Column) -> Column:
    """Spreadsheet letters of a column number from 0 (up to three letters)."""
    letter = lambda n: F.char(65 + n)
    two, three = i - 26, i - 26 - 676
    return (
        F.when(i < 26, letter(i)).when(two < 676, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def escape_xml(c: Column) -> Column:
    x = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def plain_number(c: Column) -> Column:
    """A double in its shortest digits, never with an exponent (up to 20 digits before and 18 behind the point)."""
    said = c.cast("string")
    digits = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.contains(said, F.lit("E")) & (F.abs(c) >= 1e-18), F.coalesce(digits, said)).otherwise(said)


def six_decimals(c: Column) -> Column:
    """Fixed text of a coordinate; zero has no sign."""
    x = F.format_string("%.6f", c)
    return F.when(x == "-0.000000", "0.000000").otherwise(x)


def elapsed_ms(end: Column, start: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp")))


def digits_verdict(c: Column) -> Column:
    """Why a taxpayer number is no such number: empty, not_digits, length, checksum; null if it is one."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty").when(~c.rlike(r"^\d+$"), "not_digits").when(~F.length(c).isin(10, 12), "length").when(~inn_ok(c), "checksum")


def canonical_json(c: Column) -> Column:
    """A JSON value with its keys in order at every depth, without spaces; decimals without trailing zeros.

    Null where the text is no JSON or an object has a key twice. Numbers written with an exponent
    come out as doubles do.
    """
    return F.to_json(F.try_parse_json(c))
