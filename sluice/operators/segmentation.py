"""Page streams to documents: what each page is, which pages need a second look, where documents begin and end.

classify_pages decides every page by itself: built-in expressions over its lines, no shuffle but
for the page before (notes only). decode needs the pages of a revision in order: they are
dealt by revision, sorted and streamed; the state is one open document, never a revision.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import line
from sluice.operators.documents import HEADING_LINES, DocType, PageRole, ranked, role_matches, type_matches
from sluice.operators.fields import once

# fixed values: how sure a decision of each rung is
SURE = {"manual": 1.0, "anchor": 0.9, "ambiguous": 0.5, "glued": 0.6, "counter": 0.7, "role": 0.75, "blocks": 0.35, "unknown_heading": 0.65, "none": 0.0}
# fixed values: the roles that win when a page has several, in this order
ROLE_ORDER = ("annex_continuation", "doc_continuation", "copy_stamp", "signature_visual", "blank")
# fixed values: words that open the heading of a document of whatever kind
OPENERS = ("АКТ", "ПРОТОКОЛ", "ПАСПОРТ", "СЕРТИФИКАТ", "ДЕКЛАРАЦИЯ", "ЗАКЛЮЧЕНИЕ", "ВЕДОМОСТЬ", "ЖУРНАЛ", "РЕЕСТР", "РАЗРЕШЕНИЕ", "ПРИКАЗ", "ДОВЕРЕННОСТЬ", "СПРАВКА", "СВИДЕТЕЛЬСТВО", "ОТЧЁТ", "ОТЧЕТ", "ПИСЬМО")
# fixed values: how far a boundary is to be trusted by its source, and the limits below which a person looks
BOUNDARY = {"manual": 1.0, "anchor": 0.9, "llm": 0.8, "blocks": 0.4}
CONFIDENT_BOUNDARY, HIGH_CONFIDENCE = 0.8, 0.7
# fixed values: sheet counters, as one phrase or as two fields of a form
PHRASE = r"(?iu)^(?:лист|страница)\s+(\d{1,3})\s+из\s+(\d{1,3})(?![0-9A-Za-z_])"
SHEET, SHEETS = r"(?iu)(?:^|[|\s])лист\s+(\d{1,3})\s*(?:\||$)", r"(?iu)(?:^|[|\s])листов\s+(\d{1,3})\s*(?:\||$)"
# fixed values: limits of glued headings, unknown headings and parent numbers below an anchor
GLUE_CHARS, GLUE_LINES, UNKNOWN_LINES, UNKNOWN_CHARS, PARENT_LINES, PARENT_CHARS, PARENT_WORDS, FOUND_INSIDE = 24, 3, 3, (6, 160), 2, (5, 60), 4, 6
SCHEME, UNKNOWN = "exec_scheme", "unknown_document"
_LEADING = (r"^[\s>]*#{1,6}\s*", r"^[\s>*+-]+", r"^\s*\|\s*")
_STRING = lambda: F.lit(None).cast("string")


# ---------------------------------------------------------------- lines with their places
def _first(zone: Column, ok) -> Column:
    """Index of the first line that ok holds for, else null."""
    return F.nullif(F.array_position(F.transform(zone, lambda x: F.coalesce(ok(x), F.lit(False))), True), F.lit(0)) - 1


def _raw_start(raws: Column, i: Column) -> Column:
    """Where raw line i starts, in characters; lines are parted by one line feed."""
    return F.when(i == 0, 0).otherwise(F.length(F.array_join(F.slice(raws, 1, F.greatest(i, F.lit(1))), "\n")) + 1)


def _core(raw: Column) -> Column:
    """A raw line without leading markup."""
    for mark in _LEADING:
        raw = F.regexp_replace(raw, mark, "")
    return raw


def _span(raws: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """[start, end) of the content of raw lines first to last."""
    a, b = F.get(raws, first), F.get(raws, last)
    start = _raw_start(raws, first) + F.length(a) - F.length(_core(a))
    end = _raw_start(raws, last) + F.length(b) - F.length(_core(b)) + F.length(F.regexp_replace(_core(b), r"[\s |*_`]+$", ""))
    return start.cast("int"), end.cast("int")


def with_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """withColumns whose results are computed once: later filters and columns read them, and don't repeat their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


# ---------------------------------------------------------------- the ladder
def _decision(label: str | Column, rung: str, sure: float | Column, source: str = "anchor", **of: Column) -> Column:
    text = lambda name: of.get(name, _STRING()).cast("string").alias(name)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(label).alias("label"), text("doc_type"), of.get("outcome", F.lit("none")).alias("outcome"), text("title"), text("role"), text("parent"),
        lit(sure).cast("double").alias("confidence"), F.lit(rung).alias("rung"), F.lit(source).alias("source"), of.get("alternatives", F.array().cast("array<string>")).alias("alternatives"),
        of.get("ambiguous", F.lit(False)).alias("ambiguous"), of.get("first", F.lit(None)).cast("int").alias("first"), of.get("last", of.get("first", F.lit(None))).cast("int").alias("last"),
    )


def _like(pattern: str, x: Column) -> Column:
    return x.rlike(pattern)


def _counter(zone: Column) -> Column:
    """STRUCT(n, total, at) of a sheet counter, or null."""
    number = lambda x, p, g: F.regexp_extract(x, p, g).try_cast("int")
    phrase, sheet, sheets = (_first(zone, partial(_like, p)) for p in (PHRASE, SHEET, SHEETS))
    at = lambda i: F.get(zone, i)
    made = lambda n, total, i: F.struct(n.alias("n"), total.alias("total"), i.cast("int").alias("at"))
    return F.when(phrase.isNotNull(), made(number(at(phrase), PHRASE, 1), number(at(phrase), PHRASE, 2), phrase)).when(
        sheet.isNotNull() & sheets.isNotNull(), made(number(at(sheet), SHEET, 1), number(at(sheets), SHEETS, 1), sheet)
    )


def _fragment(x: Column) -> Column:
    """Short, in capitals, without an end mark: may be part of a torn heading."""
    return (F.length(x) <= GLUE_CHARS) & ~x.rlike(r"[.,;:!?)\]»\"'–—-]$") & x.rlike(r"\p{Lu}") & (x == F.upper(x))


def _glued(zone: Column, lines: int) -> Column:
    """ARRAY<STRUCT(text, first, last)> of two and three neighbouring fragments joined."""
    n = F.least(F.size(zone), F.lit(lines))
    piece = lambda i, size: F.slice(zone, i + 1, size)
    ok = lambda i, size: (i + size <= n) & F.forall(piece(i, size), _fragment)
    made = lambda i, size: F.when(ok(i, size), F.struct(F.array_join(piece(i, size), " ").alias("text"), i.alias("first"), (i + size - 1).alias("last")))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_compact(F.array(*[made(i, size) for size in range(2, GLUE_LINES + 1)])))
    return F.when(n > 0, F.flatten(each)).otherwise(F.array().cast("array<struct<text:string,first:int,last:int>>"))


def _parent_below(zone: Column, anchor: Column) -> Column:
    """The number that stands up to two lines below an anchor of the form «К …»."""
    below = F.slice(zone, F.greatest(F.array_position(zone, anchor), F.lit(0)).cast("int") + 1, PARENT_LINES)
    bare = F.transform(below, lambda x: F.trim(F.regexp_replace(x, r"^№\s*", "")))
    ok = lambda x: F.length(x).between(*PARENT_CHARS) & x.rlike(r"\d") & ~x.rlike(r"^\d{1,2}[./]\d{1,2}[./]\d{2,4}\s*(?:г\.?)?$") & (F.size(F.split(x, r"\s+")) <= PARENT_WORDS)
    return F.when(anchor.rlike(r"(?iu)^К\s"), F.get(F.filter(bare, ok), F.lit(0)))


def _named(code: str, r: Column) -> Column:
    return r["code"] == code


def _first_sheet(r: Column) -> Column:
    """A sheet counter that says 1 continues nothing."""
    return (r["code"] == "doc_continuation") & r["line"].rlike(PHRASE) & (F.regexp_extract(r["line"], PHRASE, 1).try_cast("int") == 1)


def _unknown_heading(zone: Column) -> Column:
    """Index of a line at the very top that opens a document of no known kind."""
    at = F.sequence(F.lit(0), F.least(F.size(zone), F.lit(UNKNOWN_LINES)) - 1)
    x = lambda i: F.get(zone, i)
    listed = lambda i: F.coalesce((i > 0) & F.endswith(F.get(zone, i - 1), F.lit(":")), F.lit(False))
    ok = lambda i: F.length(x(i)).between(*UNKNOWN_CHARS) & ~F.contains(x(i), F.lit("|")) & ~x(i).rlike(r"[.,;:]$") & ~listed(i) & F.upper(x(i)).rlike(rf"^(?:{'|'.join(OPENERS)})(?:$|[^\p{{L}}])")
    return F.when(F.size(zone) > 0, F.get(F.filter(at, ok), F.lit(0)))


def classify_pages(pages: DataFrame, types: Sequence[DocType], roles: Sequence[PageRole], heading_lines: int = HEADING_LINES) -> DataFrame:
    """One decision a page: pages (revision, ordinal, page, file, rotation, text, blocks, manual) with
    label, doc_type, outcome, title, role, parent, confidence, rung, source, alternatives, ambiguous,
    char_start, char_end, notes.

    The first rung that decides counts: the label of a person; a sheet counter beyond 1; a heading
    of a known type; a heading torn over lines; picture and stamp; a role of the page; a
    picture alone; a heading of an unknown document; nothing. blocks is an array of kinds, manual
    a STRUCT(label, doc_type, role) or null. Labels: B-DOC begins a document, I-DOC goes on, A-ROLE
    serves, U says nothing. Notes (a new file, another rotation) decide nothing. Places are
    characters of the text. A null text is empty and has no places; null blocks are none.
    """
    raws = F.split(F.coalesce("text", F.lit("")), "\n")
    held = F.filter(F.transform(raws, lambda x, i: F.struct(line(x).alias("x"), i.alias("i"))), lambda r: r["x"] != "")
    df = with_values(pages, {"_raws": raws, "_held": held})
    df = with_values(df, {"_zone": F.transform("_held", lambda r: r["x"])})
    zone = F.col("_zone")
    df = with_values(df, {"_counter": _counter(zone), "_types": ranked(type_matches("_zone", types, heading_lines)), "_glue": _glued(zone, heading_lines), "_roles": role_matches("_zone", roles)})
    #: glued lines stand before the page's own; only what they match counts
    df = with_values(df, {"_aug": F.concat(F.transform("_glue", lambda g: g["text"]), "_zone")})
    n_glued = F.size("_glue")
    df = with_values(df, {"_torn": F.when((F.size("_types") == 0) & (n_glued > 0), ranked(F.filter(type_matches("_aug", types, n_glued + heading_lines), lambda m: m["line_index"] < F.size("_glue")))), "_kept": F.filter("_roles", lambda r: ~_first_sheet(r)), "_heading": _unknown_heading(zone)})

    top = lambda c: F.get(F.col(c), F.lit(0))
    found = lambda c: (top(c)["code"], F.transform(F.slice(c, 2, 1000), lambda m: m["code"]), F.size(F.filter(c, lambda m: m["priority"] == top(c)["priority"])) > 1)
    code, others, tie = found("_types")
    torn, torn_others, torn_tie = found("_torn")
    at = top("_types")["line_index"]
    glue = F.get(F.col("_glue"), top("_torn")["line_index"])
    state = lambda several: F.when(several, "uncertain").otherwise("known")
    blocks = F.coalesce("blocks", F.array().cast("array<string>"))
    role = F.coalesce(*[F.get(F.filter("_kept", partial(_named, code)), F.lit(0)) for code in ROLE_ORDER], top("_kept"))
    df = with_values(df, {"_role": role})
    df = with_values(df, {"_parent": F.coalesce("_role.parent", F.when(F.col("_role.code") == "annex_continuation", _parent_below(zone, F.col("_role.line"))))})
    role, parent, heading = F.col("_role"), F.col("_parent"), F.col("_heading")
    manual = F.col("manual")
    ladder = F.coalesce(
        F.when(manual.isNotNull(), _decision(manual["label"], "manual", SURE["manual"], "manual", doc_type=manual["doc_type"], outcome=F.when(manual["doc_type"].isNull(), "none").otherwise("known"), role=manual["role"])),
        F.when(F.col("_counter.n") > 1, _decision("I-DOC", "counter", SURE["counter"], role=F.lit("doc_continuation"), first=F.col("_counter.at"))),
        F.when(code.isNotNull(), _decision("B-DOC", "anchor", F.when(tie, SURE["ambiguous"]).otherwise(SURE["anchor"]), doc_type=code, outcome=state(tie), title=top("_types")["line"], alternatives=others, ambiguous=tie, first=at)),
        F.when(torn.isNotNull(), _decision("B-DOC", "glued", SURE["glued"], doc_type=torn, outcome=state(torn_tie), title=glue["text"], alternatives=torn_others, ambiguous=torn_tie, first=glue["first"], last=glue["last"])),
        F.when(F.array_contains(blocks, "image") & F.array_contains(blocks, "stamp"), _decision("B-DOC", "blocks", SURE["blocks"], "blocks", doc_type=F.lit(SCHEME), outcome=F.lit("uncertain"))),
        F.when(role.isNotNull(), _decision(F.when(role["code"] == "doc_continuation", "I-DOC").otherwise("A-ROLE"), "role", SURE["role"], role=role["code"], parent=parent)),
        F.when((blocks == F.array(F.lit("image"))) & (F.size(zone) == 0), _decision("U", "image_only", SURE["none"])),
        F.when(heading.isNotNull(), _decision("B-DOC", "unknown_heading", SURE["unknown_heading"], outcome=F.lit("other"), title=F.get(zone, heading), first=heading)),
        _decision("U", "none", SURE["none"]),
    )
    df = with_values(df, {"_d": ladder})
    raw_at = lambda c: F.get(F.col("_held"), F.col(f"_d.{c}"))["i"]
    start, end = _span(F.col("_raws"), raw_at("first"), raw_at("last"))
    placed = F.col("_d.first").isNotNull() & F.col("text").isNotNull() & (end > start)
    by = Window.partitionBy("revision").orderBy("ordinal")
    note = lambda c, name: F.when(F.lag(c).over(by) != F.col(c), F.lit(name))
    df = df.withColumns({"char_start": F.when(placed, start), "char_end": F.when(placed, end), "notes": F.array_compact(F.array(note("file", "new_file"), note("rotation", "rotated")))})
    quote = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    named = [f"_d.{c}" for c in ("label", "doc_type", "outcome")]
    title = F.when(F.col("_d.rung") == "anchor", F.coalesce(quote, "_d.title")).otherwise(F.col("_d.title")).alias("title")
    rest = [f"_d.{c}" for c in ("role", "parent", "confidence", "rung", "source", "alternatives", "ambiguous")]
    return df.select(*pages.columns, *named, title, *rest, "char_start", "char_end", "notes")


def pages_needing_llm(classified: DataFrame) -> DataFrame:
    """Pages without a signal that no person has labelled."""
    return classified.where((F.col("label") == "U") & (F.col("source") != "manual"))


# ---------------------------------------------------------------- documents
def fold_number(c: Column) -> Column:
    """A number without spaces, quotes and number signs, with one kind of dash, in capitals."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[\\s №\"'«»]", ""), "[–—−]", "-")


def page_numbers(text: Column) -> Column:
    """All numbers that a page names behind a number sign, folded."""
    found = F.flatten(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_extract_all(line(x), F.lit(r"№\s*([^\n|]{1,60})"), F.lit(1))))
    cut = F.transform(found, lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?iu)\s+(?:от|к)\s(?s:.*)$", "")))
    return F.transform(F.filter(cut, lambda x: x.rlike(r"[\p{L}\p{N}]")), fold_number)


def _rows(text: Column) -> Column:
    """ARRAY<STRUCT(columns, separator, empty)> of the table lines of a page."""
    table = F.filter(F.transform(F.split(text, r"\r?\n"), lambda c: F.trim(c)), lambda x: x.rlike(r"^\|.+\|$"))
    cells = F.transform(table, lambda x: F.split(F.substring(x, F.lit(2), F.length(x) - 2), r"\|"))
    return F.transform(cells, lambda c: F.struct(F.size(c).alias("columns"), F.forall(c, lambda x: x.rlike(r"^\s*:?-{2,}:?\s*$")).alias("separator"), F.forall(c, lambda x: F.trim(x) == "").alias("empty")))


def decode(classified: DataFrame, roles: Sequence[PageRole]) -> DataFrame:
    """Every page once: (revision, ordinal, page, document, place, reason).

    document counts a revision's documents from 1 and is null for pages that belong to none, with the
    reason. B-DOC opens a document, I-DOC goes on. A page with a role is attached if its role
    attaches by itself: an annex where its parent's number stands on the pages of the open
    document (or, where that names no number, directly behind it), others directly behind a
    page of it. U is attached only where it goes on with the table of the page before. Ties of
    ordinal go by page. Pages are streamed by revision; the state is the numbers and the folded
    text of the open document.
    """
    text = F.coalesce("text", F.lit(""))
    rows = _rows(text)
    last = F.try_element_at("_rows", F.lit(-1))
    attaches = F.coalesce(*[F.when(F.col("role") == r.code, F.lit(r.attaches)) for r in roles], F.lit(False)) if roles else F.lit(False)
    df = classified.select("revision", "ordinal", "page", "label", "role", "parent", attaches.alias("attaches"), page_numbers(text).alias("numbers"), fold_number(text).alias("folded"), fold_number(F.col("parent")).alias("needle"), "text")
    df = with_values(df, {"_rows": rows}).drop("text")
    first, second = F.get("_rows", F.lit(0)), F.get("_rows", F.lit(1))
    headless = ~first["separator"] & ~(F.coalesce(second["separator"], F.lit(False)) & ~first["empty"])
    df = df.withColumns({"opens_with": F.when(headless, first["columns"]), "ends_with": F.when(F.size("_rows") > 0, last["columns"])}).drop("_rows")
    kinds = {f.name: f.dataType.simpleString() for f in classified.schema}
    schema = f"revision {kinds['revision']}, ordinal {kinds['ordinal']}, page {kinds['page']}, document int, place int, reason string"
    return df.repartition("revision").sortWithinPartitions("revision", "ordinal", "page").mapInPandas(_decoded, schema)


class _Open:
    """What must be known of the open document and the page before."""

    def __init__(self, revision):
        self.revision, self.document, self.place, self.beside = revision, 0, 0, False
        self.numbers, self.folded, self.ends_with = set(), [], None

    def refusal(self, p) -> str | None:
        """Why a page is not attached; null if it is."""
        if not self.document:
            return "role_before_documents" if p.label == "A-ROLE" else "continuation_before_documents"
        if p.label == "I-DOC":
            return None
        if p.label != "A-ROLE":
            goes_on = self.beside and pd.notna(p.opens_with) and p.opens_with == self.ends_with
            return None if goes_on else "no_signal"
        if p.role is None:
            return "unknown_role"
        if p.role == "blank":
            return "blank"
        if not p.attaches:
            return "role_not_attached"
        if p.role == "annex_continuation":
            if p.parent is None:
                return "annex_without_parent"
            if self.numbers:
                inside = p.needle in self.numbers or len(p.needle) >= FOUND_INSIDE and p.needle in "".join(self.folded)
                return None if p.needle and inside else "parent_not_named"
            return None if self.beside else "annex_apart"
        return None if self.beside else "role_apart"

    def take(self, p) -> tuple[int | None, int | None, str | None]:
        if p.label == "B-DOC":
            self.document, self.place, self.numbers, self.folded = self.document + 1, 0, set(), []
            reason = None
        else:
            reason = self.refusal(p)
        self.beside, self.ends_with = reason is None, p.ends_with
        if reason:
            return None, None, reason
        self.place += 1
        self.numbers.update(p.numbers)
        self.folded.append(p.folded)
        return self.document, self.place, None


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = None
    for frame in frames:
        out = []
        for p in frame.itertuples(index=False):
            if state is None or p.revision != state.revision:
                state = _Open(p.revision)
            out.append((p.revision, p.ordinal, p.page, *state.take(p)))
        made = pd.DataFrame(out, columns=["revision", "ordinal", "page", "document", "place", "reason"])
        yield made.astype({"document": "Int32", "place": "Int32"})


def unaccounted(pages: DataFrame, decoded: DataFrame) -> DataFrame:
    """(page, given, decided) of pages that are not decided exactly as often as they are given: none, if all is well."""
    given = pages.groupBy("page").agg(F.count("*").alias("given"))
    out = decoded.groupBy("page").agg(F.count("*").alias("decided"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return given.join(out, "page", "full").select("page", n("given").alias("given"), n("decided").alias("decided")).where("given <> decided")


def documents_of(classified: DataFrame, decoded: DataFrame, types: Sequence[DocType]) -> DataFrame:
    """(revision, document, doc_type, title, type_confidence, boundary_confidence, needs_review, observed_title, pages).

    A document takes what its first page says; one of no known kind gets the general type of the
    group that its nearest candidate is in.
    """
    groups = {t.code: t.group for t in types}
    general = {t.group: t.code for t in types if t.fallback and t.code != UNKNOWN}
    hint = F.coalesce("doc_type", F.get("alternatives", F.lit(0)))
    named = F.coalesce(*[F.when(hint == code, F.lit(general.get(group, UNKNOWN))) for code, group in groups.items()], F.lit(UNKNOWN))
    other = F.col("outcome") == "other"
    boundary = F.coalesce(*[F.when(F.col("source") == s, F.least("confidence", F.lit(v)) if s == "llm" else F.lit(v)) for s, v in BOUNDARY.items()])
    review = (F.col("source") != "manual") & (F.col("ambiguous") | (F.col("outcome") == "uncertain") | (boundary < CONFIDENT_BOUNDARY) | (F.col("confidence") < HIGH_CONFIDENCE))
    quote = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    said = F.struct(
        F.when(other, named).otherwise(F.col("doc_type")).alias("doc_type"), F.coalesce("title", quote).alias("title"), F.when(F.col("outcome") == "none", 0.0).otherwise(F.col("confidence")).alias("type_confidence"),
        boundary.alias("boundary_confidence"), review.alias("needs_review"), F.when(other, F.col("title")).alias("observed_title"),
    )
    j = decoded.where("document is not null").join(classified.where("label = 'B-DOC'").select("revision", "page", said.alias("said")), ["revision", "page"], "left")
    g = j.groupBy("revision", "document").agg(F.min_by("said", "place").alias("s"), F.count("*").alias("pages"))
    return g.select("revision", "document", "s.*", "pages")


# ---------------------------------------------------------------- quotes
def locate_quote(text: Column, quote: Column) -> Column:
    """STRUCT(char_start, char_end) of a quote in a raw text, compared without markup and by single spaces; null if it isn't there.

    The text is projected: leading and trailing marks of a line, emphasis marks and all but the
    first of several spaces fall out; every kept character keeps its place in the raw text.
    """
    pad = lambda n: F.repeat(F.lit("\x01"), n)
    #: raw lines with everything that is not content blanked out by a mark (\x01); their characters keep their places
    bare = lambda x, core, kept: F.concat(pad(F.length(x) - F.length(core)), kept, pad(F.length(core) - F.length(kept)))
    blank = lambda x: once(_core(x), lambda core: once(F.regexp_replace(core, r"[\s |*_`]+\z", ""), lambda kept: bare(x, core, kept)))
    shown = F.regexp_replace(F.array_join(F.transform(F.split(text, "\n"), blank), " "), "[*_`]", "\x01")
    #: a needle's words in order, with marks allowed inside words and any spaces and marks between them; pipes that end its lines are none of them
    lines = F.transform(F.split(quote, r"\r?\n"), lambda x: F.regexp_replace(line(x), "[\\s |]+\\z", ""))
    words = F.filter(F.split(F.array_join(F.filter(lines, lambda x: x != ""), " "), " "), lambda w: w != "")
    one = lambda w: F.array_join(F.transform(F.split(w, ""), lambda ch: F.concat(F.lit("\\Q"), ch, F.lit("\\E"))), "\x01*")
    pattern = F.array_join(F.transform(words, one), "[\\s \x01]*[\\s ][\\s \x01]*")
    at = lambda s, hit: F.when(hit != "", once(F.instr(s, hit) - 1, lambda a: F.struct(a.alias("char_start"), (a + F.length(hit)).alias("char_end"))))
    found = lambda p: once(shown, lambda s: once(F.call_function("regexp_extract", s, p, F.lit(0)), lambda hit: at(s, hit)))
    return once(pattern, lambda p: F.when(p != "", found(p)))
