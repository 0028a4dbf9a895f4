"""Answers of recognition: archives to pages and blocks, blocks matched by place, results laid on a frozen layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import once, six_decimals
from sluice.operators.segmentation import with_values

# fixed values: the headings and marked lines of an archive's Markdown
PAGE, BLOCK = r"## Page (\d+)\s*", r"### BLOCK #(\d+) \[([A-Z]+)\]: (\S+)\s*"
STAMP_LINE, DOC_STAMP = r"^> \*\*Stamp:\*\*\s*(.+)$", r"^\*\*Stamp:\*\*\s*(.+)$"
# fixed values: the named fields of a stamp and of an image's first line
STAMP_FIELDS = ("code", "stage", "sheet", "object", "name", "organization", "revisions")
IMAGE_FIELDS = {"type": "image_type", "axes": "axes", "zone": "zone", "level": "level"}
_LAYOUT = "generated_at string, pages array<struct<page_index:int,width_px:int,height_px:int,rotation:int>>, blocks array<struct<block_id:string,ordinal:int,page_index:int,block_type:string,coords_norm:array<double>>>"
_GIVEN = "array<struct<block_id:string,ordinal:int,page_index:int,block_type:string,coords:array<double>>>"
_WRITTEN = "array<struct<place:int,ordinal:int,kind:string,block_id:string,lines:array<string>>>"


def _pairs(line: Column) -> Column:
    """ARRAY<STRUCT(k, low, v)> of `Key: value | Key: value`, without empty keys and values; low is the key in lower case."""
    parts = F.filter(F.split(line, r"\|"), lambda x: F.contains(x, F.lit(":")))
    value = lambda x: F.trim(F.substring(x, F.instr(x, F.lit(":")) + 1, F.length(x)))
    made = F.transform(parts, lambda x: once(F.trim(F.substring_index(x, ":", 1)), lambda k: F.struct(k.alias("k"), F.lower(k).alias("low"), value(x).alias("v"))))
    return F.filter(made, lambda p: (p["k"] != "") & (p["v"] != ""))


def _last(pairs: Column, key: str) -> Column:
    """The value of the last pair of a key, case aside."""
    return F.try_element_at(F.filter(pairs, lambda p: p["low"] == key), F.lit(-1))["v"]


def stamp_fields(line: Column) -> Column:
    """STRUCT of a stamp line's named fields and a map of all others; the last of a key counts. All null for a null line."""

    def extra(pairs: Column) -> Column:
        value = lambda other, k: F.element_at(F.filter(other, lambda p: p["k"] == k), -1)["v"]
        found = lambda other: once(F.array_distinct(F.transform(other, lambda p: p["k"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: value(other, k))))
        return once(F.filter(pairs, lambda p: ~p["low"].isin(*STAMP_FIELDS)), found)

    pairs = F.coalesce(_pairs(line), F.array().cast("array<struct<k:string,low:string,v:string>>"))
    return once(pairs, lambda p: F.struct(*[_last(p, f).alias(f) for f in STAMP_FIELDS], extra(p).alias("extra")))


def image_fields(lines: Column) -> Column:
    """STRUCT(image_type, axes, zone, level, summary, description, entities, verification) of the lines of an image block.

    A section runs from its head to the next head; blank lines fall out. Later heads of a kind add to it; of
    entities the last head counts.
    """
    heads = {"image": r"\*\*\[IMAGE\]\*\*", **{n: rf"\*\*{n.title()}:\*\*" for n in ("summary", "description", "entities", "verification")}}
    first = lambda p: F.substring_index(p, "\n", 1)
    none = F.array().cast("array<string>")

    def fields(pieces: Column) -> Column:
        #: the pieces below heads of a kind, without the head's own mark
        below = lambda n: F.transform(F.filter(pieces, lambda p: F.startswith(p, F.lit(heads[n].replace("\\", "")))), lambda p: F.regexp_replace(p, rf"\A{heads[n]}[^\S\n]*", ""))

        def section(name: str) -> Column:
            text = F.filter(F.split(F.array_join(below(name), "\n"), "\n"), lambda x: F.trim(x) != "")
            return F.nullif(F.trim(F.array_join(text, "\n")), F.lit(""))

        named = F.try_element_at(below("entities"), F.lit(-1))
        entities = F.filter(F.transform(F.split(first(named), ","), lambda c: F.trim(c)), lambda x: x != "")
        rest = [section("summary").alias("summary"), section("description").alias("description"), F.coalesce(entities, none).alias("entities"), section("verification").alias("verification")]
        said = F.flatten(F.transform(below("image"), lambda p: _pairs(first(p))))
        return once(said, lambda x: F.struct(*[_last(x, k).alias(v) for k, v in IMAGE_FIELDS.items()], *rest))

    return once(F.split(F.array_join(lines, "\n"), rf"(?m)^(?={'|'.join(heads.values())})"), fields)


def _collapsed(lines: Column) -> Column:
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _sections(markdown: Column) -> Column:
    """ARRAY<STRUCT(page_index, section)> of a text: from each page heading to the next."""
    pieces = F.filter(F.split(markdown, rf"(?m)^(?={PAGE}$)"), lambda x: x.rlike(rf"\A{PAGE}(\n|\z)"))
    no = lambda x: F.regexp_extract(F.substring_index(x, "\n", 1), rf"^{PAGE}$", 1).try_cast("int")
    return F.transform(pieces, lambda x: F.struct((no(x) - 1).alias("page_index"), x.alias("section")))


def _plain(rows: Column) -> Column:
    """Lines without headings of blocks and provenance."""
    return F.filter(rows, lambda r: ~(F.startswith(r, F.lit("### BLOCK #")) & r.rlike(rf"^{BLOCK}$")) & ~F.startswith(r, F.lit("> **")))


def _page_lines(section: Column) -> Column:
    return _plain(F.slice(F.split(section, "\n"), 2, 1_000_000))


def _page_stamps(section: Column) -> Column:
    """The stamp lines of a page."""
    found = F.filter(F.split(section, "\n"), lambda r: F.startswith(r, F.lit("> **Stamp:**")) & r.rlike(STAMP_LINE))
    return F.transform(found, lambda r: F.trim(F.regexp_extract(r, STAMP_LINE, 1)))


def _page_blocks(section: Column) -> Column:
    """ARRAY<STRUCT(place, ordinal, kind, block_id, lines)> of a page."""
    parts = F.filter(F.split(section, rf"(?m)^(?={BLOCK}$)"), lambda x: x.rlike(rf"\A{BLOCK}(\n|\z)"))

    def made(rows: Column, i: Column) -> Column:
        head = lambda g: F.regexp_extract(F.get(rows, F.lit(0)), rf"^{BLOCK}$", g)
        return F.struct(i.alias("place"), head(1).try_cast("int").alias("ordinal"), F.when(head(2) == "IMAGE", "image").otherwise("text").alias("kind"), head(3).alias("block_id"), _plain(F.slice(rows, 2, 1_000_000)).alias("lines"))

    return F.transform(parts, lambda x, i: once(F.split(x, "\n"), lambda rows: made(rows, i)))


def archive_sections(archives: DataFrame) -> DataFrame:
    """(doc, page_index, lines, blocks, stamps) of the Markdown of archives (doc, markdown): one row a page heading.

    blocks is an ARRAY<STRUCT(place, ordinal, kind, block_id, lines)>; lines are those without headings and provenance.
    The text is split at its headings inside its row: no shuffle.
    """
    pages = archives.select("doc", F.inline(_sections(F.col("markdown"))))
    return pages.select("doc", "page_index", _page_lines(F.col("section")).alias("lines"), _page_blocks(F.col("section")).alias("blocks"), _page_stamps(F.col("section")).alias("stamps"))


def canonical_pages(archives: DataFrame) -> dict[str, DataFrame]:
    """Tables pages, blocks and faults of archives (doc, markdown, layout), one row an archive; layout is JSON or null.

    pages: (doc, page_index, rotation, width, height, text), from the layout where there is one, else from the
    Markdown. blocks: (doc, page_index, kind, place, block_id, ordinal, coords, text, image, stamp): text and image blocks of the
    Markdown, with ids and places of the layout's block of their ordinal, then the layout's stamps; stamp
    lines of the page are dealt to them in order, the document's own stamp stands in for one that is
    missing. faults: (doc, page_index, code, n): pages that stand twice, are not in the layout or
    lack in the Markdown though blocks are on them, and stamp lines without a block.
    An archive's text and layout are matched inside its row: no shuffle.
    """
    before = F.split(F.get(F.split(F.col("markdown"), rf"(?m)^(?={PAGE}$)"), F.lit(0)), "\n")
    own = F.try_element_at(F.filter(before, lambda r: r.rlike(DOC_STAMP)), F.lit(-1))
    starts_with_page = F.col("markdown").rlike(rf"\A{PAGE}(\n|\z)")
    laid = with_values(archives.select("doc", "markdown", "layout"), {"l": F.from_json("layout", _LAYOUT)})
    block = lambda b: F.struct(*[b[c].alias(c) for c in ("block_id", "ordinal", "page_index", "block_type")], F.when(F.size(b["coords_norm"]) == 4, b["coords_norm"]).alias("coords"))
    laid = with_values(laid, {
        "sections": F.coalesce(_sections(F.col("markdown")), F.array().cast("array<struct<page_index:int,section:string>>")), "has": F.coalesce(F.size("l.pages") > 0, F.lit(False)),
        "doc_stamp": F.when(~starts_with_page, F.trim(F.regexp_extract(own, DOC_STAMP, 1))),
        "given": F.coalesce(F.transform(F.filter("l.blocks", lambda b: b["block_type"].isin("text", "image", "stamp")), block), F.array().cast(_GIVEN)),
    }).select("doc", "sections", "has", "doc_stamp", "given", F.when(F.col("has"), F.col("l.pages")).alias("sheets"))
    return {"pages": _canonical_pages(laid), "blocks": _canonical_blocks(laid), "faults": _canonical_faults(laid)}


def _on(page: Column, rows: Column) -> Column:
    """Those of an array's rows that are on a page; no row is on a page without a number."""
    return F.filter(rows, lambda r: F.coalesce(r["page_index"] == page, F.lit(False)))


def _canonical_pages(laid: DataFrame) -> DataFrame:
    text = lambda s: _collapsed(_page_lines(s["section"]))
    row = lambda page, rotation, width, height, text: F.struct(page.alias("page_index"), rotation.alias("rotation"), width.alias("width"), height.alias("height"), text.alias("text"))
    no = F.lit(None).cast("int")
    sheet = lambda p, text: row(p["page_index"], p["rotation"], p["width_px"], p["height_px"], text)
    written = lambda p: once(_on(p["page_index"], F.col("sections")), lambda found: F.when(F.size(found) == 0, F.array(sheet(p, F.lit("")))).otherwise(F.transform(found, lambda s: sheet(p, text(s)))))
    full = F.flatten(F.transform("sheets", written))
    bare = F.transform("sections", lambda s: row(s["page_index"], F.lit(0), no, no, text(s)))
    return laid.select("doc", F.inline(F.when(F.col("has"), full).otherwise(bare)))


def _canonical_blocks(laid: DataFrame) -> DataFrame:
    stamp_blocks = F.filter("given", lambda b: b["block_type"] == "stamp")
    df = with_values(laid, {"stamped": stamp_blocks})
    #: pages of the text, and those that only the layout lists stamps on
    known = lambda p: F.coalesce(F.exists("sections", lambda s: s["page_index"] == p), F.lit(False))
    apart = F.filter(F.array_distinct(F.transform("stamped", lambda b: b["page_index"])), lambda p: ~known(p))
    each = F.concat(F.col("sections"), F.transform(apart, lambda p: F.struct(p.alias("page_index"), F.lit(None).cast("string").alias("section"))))
    df = df.select("doc", "doc_stamp", "given", "stamped", F.inline(each))
    page, section = F.col("page_index"), F.col("section")
    alone = section.isNull()
    none = F.array().cast("array<string>")
    here = F.when(alone, F.filter("stamped", lambda b: b["page_index"].eqNullSafe(page))).otherwise(_on(page, F.col("stamped")))
    df = with_values(df, {"written": F.coalesce(_page_blocks(section), F.array().cast(_WRITTEN)), "stamp_lines": F.coalesce(_page_stamps(section), none), "here": here, "placed": _on(page, F.col("given"))})
    n = F.size("stamp_lines")
    #: of layout blocks with one ordinal the last counts
    of = lambda b: F.try_element_at(F.filter("placed", lambda g: F.coalesce(g["ordinal"] == b["ordinal"], F.lit(False))), F.lit(-1))
    raw = lambda kind, place, block_id, ordinal, coords, lines, source: F.struct(kind.alias("kind"), place.cast("int").alias("place"), block_id.alias("block_id"), ordinal.alias("ordinal"), coords.alias("coords"), lines.alias("lines"), source.alias("source"))
    body = F.transform("written", lambda b: once(of(b), lambda j: raw(b["kind"], b["place"], F.coalesce(j["block_id"], b["block_id"]), b["ordinal"], j["coords"], b["lines"], F.lit(None).cast("string"))))
    #: stamps in the order in which the layout lists them
    source = lambda i: F.coalesce(F.get(F.col("stamp_lines"), i), F.when((i == n) & (n < F.size("here")), F.col("doc_stamp")))
    stamps = F.transform("here", lambda b, i: raw(F.lit("stamp"), i + 1_000_000, b["block_id"], b["ordinal"], b["coords"], none, source(i)))
    out = df.select("doc", "page_index", F.inline(F.concat(body, stamps)))
    is_ = lambda kind, value: F.when(F.col("kind") == kind, value)
    return out.select(
        "doc", "page_index", "kind", "place", "block_id", "ordinal", "coords", is_("text", _collapsed(F.col("lines"))).alias("text"),
        is_("image", image_fields(F.col("lines"))).alias("image"), is_("stamp", stamp_fields(F.col("source"))).alias("stamp"),
    )


def _canonical_faults(laid: DataFrame) -> DataFrame:
    row = lambda page, code, n: F.struct(page.alias("page_index"), F.lit(code).alias("code"), n.cast("int").alias("n"))
    at = F.transform("sections", lambda s: F.struct(s["page_index"].alias("page_index"), F.size(_page_stamps(s["section"])).alias("n")))
    df = with_values(laid, {"at": at, "bodies": F.filter("given", lambda b: b["block_type"] != "stamp"), "stamped": F.filter("given", lambda b: b["block_type"] == "stamp")})
    numbers = F.transform("at", lambda s: s["page_index"])
    times = F.transform(F.array_distinct(numbers), lambda p: row(p, "page_twice", F.size(F.filter("at", lambda s: s["page_index"].eqNullSafe(p)))))
    twice = F.filter(times, lambda r: r["n"] > 1)
    alien = F.transform(F.filter("at", lambda s: F.size(_on(s["page_index"], F.col("sheets"))) == 0), lambda s: row(s["page_index"], "page_not_in_layout", F.lit(1)))
    absent = F.filter("sheets", lambda p: F.size(_on(p["page_index"], F.col("at"))) == 0)
    lost = F.filter(F.transform(absent, lambda p: row(p["page_index"], "page_missing", F.size(_on(p["page_index"], F.col("bodies"))))), lambda r: r["n"] > 0)
    loose = F.filter(F.transform("at", lambda s: row(s["page_index"], "stamp_lines_dropped", s["n"] - F.size(_on(s["page_index"], F.col("stamped"))))), lambda r: r["n"] > 0)
    none = F.array().cast("array<struct<page_index:int,code:string,n:int>>")
    by_sheet = F.when(F.col("has"), F.concat(alien, lost)).otherwise(none)
    return df.select("doc", F.inline(F.concat(twice, by_sheet, loose)))


# ---------------------------------------------------------------- places
def geometry_key(df: DataFrame) -> Column:
    """Page, kinds and coordinates of a block (page, kind, shape, x0, y0, x1, y1, points) as text of six decimals."""
    points = F.array_join(F.transform("points", lambda p: F.concat(six_decimals(p["x"]), F.lit(","), six_decimals(p["y"]))), ";")
    return F.concat_ws("|", F.col("page").cast("string"), "kind", "shape", *[six_decimals(F.col(c)) for c in ("x0", "y0", "x1", "y1")], F.coalesce(points, F.lit("")))


def match_blocks(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(doc, local, remote, state): blocks (doc, id, page, kind, shape, x0, y0, x1, y1, sort_order, points) paired by place.

    The key is a block's geometry and its rank on the page among blocks of its kind, by order, then geometry,
    so equal boxes pair in order. State matched, lost (local alone) or foreign (remote alone).
    """
    def keyed(df: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("doc", "page", "kind").orderBy("sort_order", "_g", "id"))
        return df.withColumn("_g", geometry_key(df)).select("doc", F.concat_ws("|#", "_g", rank.cast("string")).alias("key"), F.col("id").alias(name))

    j = keyed(local, "local").join(keyed(remote, "remote"), ["doc", "key"], "full")
    return j.select("doc", "local", "remote", F.when(F.col("remote").isNull(), "lost").when(F.col("local").isNull(), "foreign").otherwise("matched").alias("state"))


# ---------------------------------------------------------------- results on a layout
def assemble(pages: DataFrame, frozen: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results laid on a frozen layout: (doc, page, place, block, kind, result) in page order, and all discrepancies.

    pages: (doc, page); frozen: (doc, block, page, kind, sort_order, x0, y0, x1, y1); results: (doc, block, layout_block,
    kind, ordinal, result), block being the key it came under. A document with any discrepancy gives no
    rows: (doc, code, block, page) says why.
    """
    said = lambda df, code: df.select("doc", F.lit(code).alias("code"), *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in ("block", "page")])
    more = lambda df, by: df.groupBy("doc", by).agg(F.count("*").alias("n")).where("n > 1").select("doc", by, F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    #: of blocks given twice the first by page and order counts
    one = frozen.groupBy("doc", "block").agg(F.min(F.struct("page", "sort_order", "kind", "x0", "y0", "x1", "y1")).alias("f")).select("doc", "block", "f.*")
    known = pages.select("doc", "page").distinct()
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    sound = F.col("x0") <= F.col("x1")
    for ok in (F.col("y0") <= F.col("y1"), *(b.between(0, 1) & ~F.isnan(b) for b in box)):
        sound = sound & ok
    r = results.select("doc", "block", "layout_block", F.col("kind").alias("r_kind"), "ordinal", "result")
    j = one.join(r, ["doc", "block"], "left").withColumn("has", F.col("result").isNotNull())
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    faults = said(more(pages, "page"), "page_twice")
    for df, code in (
        (more(frozen, "block"), "block_twice"), (one.join(known, ["doc", "page"], "left_anti"), "page_missing"), (one.where(~F.coalesce(sound, F.lit(False))), "coordinates"), (j.where("not has"), "no_result"),
        (j.where("has").where(differs("layout_block", "block")), "other_block"), (j.where("has").where(differs("r_kind", "kind")), "other_kind"), (j.where("has").where(differs("ordinal", "sort_order")), "other_ordinal"),
        (r.join(one.select("doc", "block"), ["doc", "block"], "left_anti"), "foreign_result"),
    ):
        faults = faults.unionByName(said(df, code))
    place = F.row_number().over(Window.partitionBy("doc", "page").orderBy("sort_order", "block"))
    laid = j.where("has").join(faults.select("doc").distinct(), "doc", "left_anti").select("doc", "page", place.alias("place"), "block", "kind", "result")
    return laid, faults


# ---------------------------------------------------------------- answers of models
# fixed values: limits beyond which a document code is prose, and the fields of a stamp answer
CODE_MOST, PROSE_CHARS, PROSE_WORDS, PROSE_LOWER = 160, 60, 6, 3
STAMP_SCALARS = ("document_code", "project_name", "sheet_name", "stage", "sheet_number", "total_sheets", "organization")


def strip_noise(c: Column) -> Column:
    """An answer without its thoughts and without the fence around it."""
    # fixed values: the forms of thoughts and fences
    bare = F.regexp_replace(F.regexp_replace(c, r"(?iu)<think\b[^>]*>[\s\S]*?</think>", ""), r"^\s+|\s+$", "")
    fence = r"^```[a-zA-Z0-9_-]*[ \t]*\r?\n([\s\S]*?)\r?\n?```\z"
    return F.when(bare.rlike(fence), F.regexp_replace(F.regexp_extract(bare, fence, 1), r"^\s+|\s+$", "")).otherwise(bare)


def _object(c: Column) -> Column:
    """A JSON object as text with its keys in order; null for anything else."""
    j = F.to_json(F.try_parse_json(c))
    return F.when(F.startswith(j, F.lit("{")), j)


def _balanced(c: Column) -> Column:
    """From the first { to the } that closes it, braces inside strings aside; null if none does."""
    tail = F.substring(c, F.nullif(F.instr(c, F.lit("{")), F.lit(0)), F.length(c))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("i"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        quoted, escaped = s["quoted"], s["escaped"]
        depth = s["depth"] + F.when(~quoted & (ch == "{"), 1).when(~quoted & (ch == "}"), -1).otherwise(0)
        i = s["i"] + 1
        over = F.when(s["end"] > 0, s["end"]).when(~quoted & (ch == "}") & (depth == 0), i).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(ch == '"', ~quoted | escaped).otherwise(quoted).alias("quoted"), (quoted & ~escaped & (ch == "\\")).alias("escaped"), i.alias("i"), over.alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step, lambda s: s["end"])
    return F.when(end > 0, F.substring(tail, F.lit(1), end))


def extract_json(c: Column) -> Column:
    """The JSON object that an answer is, or the first balanced one inside it, with its keys in order; else null."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    parsed = F.to_json(F.try_parse_json(text))
    return F.when(parsed.isNotNull(), F.when(F.startswith(parsed, F.lit("{")), parsed)).otherwise(_object(_balanced(text)))


def looks_like_prose(c: Column) -> Column:
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    lower = F.regexp_count(c, F.lit(r"(?<![\p{L}\p{N}_])[а-яё]{5,}(?![\p{L}\p{N}_])"))
    return (F.length(c) > CODE_MOST) | ((F.length(c) > PROSE_CHARS) & (words > PROSE_WORDS) & (lower >= PROSE_LOWER))


def text_warnings(answer: Column) -> Column:
    """Warnings of a text answer (JSON): no fragments; a table whose rows differ in length."""
    found = F.coalesce(F.from_json(answer, "fragments array<struct<kind:string,rows:array<array<string>>>>")["fragments"], F.array().cast("array<struct<kind:string,rows:array<array<string>>>>"))
    ragged = F.exists(found, lambda f: (f["kind"] == "table") & (F.size(F.array_distinct(F.transform(f["rows"], lambda r: F.size(r)))) > 1))
    return F.array_compact(F.array(F.when(F.size(found) == 0, "empty_fragments"), F.when(F.coalesce(ragged, F.lit(False)), "table_ragged_rows")))


def stamp_verdict(answer: Column) -> Column:
    """STRUCT(warnings, invalid) of a stamp answer (JSON): a code that is prose makes it useless, nothing read is a warning."""
    s = F.from_json(answer, ", ".join(f"{c} string" for c in STAMP_SCALARS) + ", signatures array<string>, revisions array<string>")
    empty = (F.coalesce(F.size(s["signatures"]), F.lit(0)) <= 0) & (F.coalesce(F.size(s["revisions"]), F.lit(0)) <= 0)
    for c in STAMP_SCALARS:
        empty = empty & (F.trim(F.coalesce(s[c], F.lit(""))) == "")
    code = F.trim(F.coalesce(s["document_code"], F.lit("")))
    prose = (code != "") & looks_like_prose(code)
    return F.struct(F.when(~prose & empty, F.array(F.lit("stamp_all_fields_blank"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(prose, "stamp_prose_document_code").alias("invalid"))


def failure_class(raw: Column, missing: Column) -> Column:
    """fixable_genre where an answer holds no object, or lacks one of the fields that a check missed; else invalid."""
    found = extract_json(strip_noise(raw))
    keys = F.map_keys(F.from_json(found, "map<string,string>"))
    lacks = F.exists(missing, lambda m: ~F.array_contains(keys, m))
    return F.when(found.isNull() | F.coalesce(lacks, F.lit(False)), "fixable_genre").otherwise("invalid")
