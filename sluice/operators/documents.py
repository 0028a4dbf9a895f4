"""Document texts as rows: tables in Markdown, page exports, types by anchors, fields by patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import lines, once, phrase, redact_urls

TRAILING = 80
HEADING_LINES = 20


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) for every line, pos from 0."""
    return df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))


def row_cells(line: Column) -> Column:
    """Cells of a |...| line without bold marks; null for other lines."""
    inner = F.regexp_extract(line, r"^\s*\|(.*)\|\s*$", 1)
    return F.when(line.rlike(r"^\s*\|.*\|\s*$"), F.transform(F.split(inner, r"\|"), lambda c: F.trim(F.replace(c, F.lit("**"), F.lit("")))))


def is_separator(cells: Column) -> Column:
    return (F.size(cells) > 0) & F.forall(cells, lambda c: c.rlike(r"^:?-+:?$"))


def _tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, rows, first, second): every run of |...| lines, and whether its first and second rows are separators.

    Runs are cut from the array of a text's lines at its edges, inside its row: no shuffle, no window.
    """
    held = df.select(key, F.inline(F.array(F.struct(F.transform(F.split(text, r"\r?\n"), row_cells).alias("_cells")))))
    has = lambda i: F.get("_cells", i).isNotNull()
    edges = lambda step: F.filter(F.sequence(F.lit(0), F.size("_cells") - 1), lambda i: has(i) & ~has(i + step))
    held = held.select(key, "_cells", F.inline(F.array(F.struct(edges(-1).alias("a"), edges(1).alias("b")))))
    cut = F.transform(F.arrays_zip("a", "b"), lambda z: F.struct(z["a"].alias("start"), F.slice("_cells", z["a"] + 1, z["b"] - z["a"] + 1).alias("rows")))
    sep = lambda i: F.coalesce(is_separator(F.get("rows", F.lit(i))), F.lit(False))
    return held.select(key, F.inline(cut)).select(key, "start", "rows", sep(0).alias("first"), sep(1).alias("second"))


def table_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, row_no, kind, cells) of all lines of Markdown tables; kind header, separator or data.

    A table is a run of |...| lines. If its first line is a separator it has no header, if its
    second is one the first is the header; later separators are data.
    """
    row = _tables(df, key, text).select(key, "start", "first", "second", F.posexplode("rows").alias("row_no", "cells"))
    below = ~F.col("first") & F.col("second")
    kind = F.when(F.col("first") & (F.col("row_no") == 0), "separator").when(below & (F.col("row_no") == 0), "header").when(below & (F.col("row_no") == 1), "separator").otherwise("data")
    return row.select(key, "start", "row_no", kind.alias("kind"), "cells")


def table_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Tables: (key, start, n_lines, n_columns, has_header, n_rows)."""
    n, header = F.size("rows").cast("long"), ~F.col("first") & F.col("second")
    marks = F.when(F.col("first"), 1).when(F.col("second"), 2).otherwise(0)  # lines that are no data
    return _tables(df, key, text).select(key, "start", n.alias("n_lines"), F.size(F.get("rows", F.lit(0))).alias("n_columns"), header.alias("has_header"), (n - marks).alias("n_rows"))


def bold_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, title) of lines that are bold as a whole: section titles between tables."""
    bold = r"^\s*\*\*(.+?)\*\*\s*$"
    return text_lines(df, key, text).where(F.col("line").rlike(bold)).select(key, "pos", F.trim(F.regexp_extract("line", bold, 1)).alias("title"))


def export_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_index, ordinal, kind, block_id, body) of an export: ``## Page N`` headings, N from
    1, hold ``### BLOCK #i [KIND]: id`` blocks; the lines up to the next heading are the block's
    body, without absolute links. Blocks before the first page are none.

    The text is split at its headings inside its row: no shuffle.
    """
    # fixed values: the headings of the export format
    page, block = r"(?m)^## Page (\d+)[ \t]*$", r"(?m)^### BLOCK #(\d+) \[([A-Z]+)\]: (\S+)[ \t]*$"
    sections = df.select(key, F.explode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), r"(?m)^(?=## Page \d+[ \t]*$)")).alias("section"))
    no = F.regexp_extract("section", r"\A## Page (\d+)[ \t]*$(?s:.*)".replace("$", r"(?=\n|\z)"), 1).try_cast("int")
    sections = sections.withColumn("page_index", no - 1).where("page_index >= 0")
    parts = sections.select(key, "page_index", F.explode(F.split("section", r"(?m)^(?=### BLOCK #\d+ \[[A-Z]+\]: \S+[ \t]*$)")).alias("part")).where(F.col("part").startswith("### BLOCK #"))
    head = F.substring_index("part", "\n", 1)
    of = lambda g: F.regexp_extract(head, block, g)
    body = F.btrim(F.substring(F.col("part"), F.length(head) + 1, F.length("part")), F.lit(" \n"))
    return parts.select(key, "page_index", of(1).cast("int").alias("ordinal"), F.lower(of(2)).alias("kind"), of(3).alias("block_id"), redact_urls(body)[0].alias("body"))


@dataclass(frozen=True)
class DocType:
    code: str
    priority: int
    anchors: tuple[str, ...]
    negatives: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    heading_lines: int = 0
    group: str | None = None
    fallback: bool = False


def _headings(zone: str, pattern: str, n: Column) -> Column:
    """Indexes of those of the first n lines that the pattern begins, with at most TRAILING more
    characters; lines after one that ends in a colon are items of a list, no headings."""
    at = F.sequence(F.lit(0), F.least(F.size(zone), n) - 1)
    after_colon = lambda i: (i > 0) & F.coalesce(F.endswith(F.get(F.col(zone), i - 1), F.lit(":")), F.lit(False))
    return F.filter(F.when(F.size(zone) > 0, at).otherwise(F.array().cast("array<int>")), lambda i: F.get(F.col(zone), i).rlike(f"(?iu)^(?:{pattern}).{{0,{TRAILING}}}$") & ~after_colon(i))


def _any(zone: str, pattern: str) -> Column:
    return F.exists(zone, lambda x: x.rlike(f"(?iu){pattern}"))


def _type_said(zone: str, t: DocType, rank: int, hints: Column, at: Column) -> Column:
    return F.struct(F.lit(t.code).alias("code"), F.lit(t.priority).alias("priority"), F.lit(rank).alias("rank"), F.get(F.col(zone), at).alias("line"), at.alias("line_index"), hints.alias("body_hits"))


def type_matches(zone: str, types: Sequence[DocType], base: Column | int = HEADING_LINES) -> Column:
    """ARRAY<STRUCT(code, priority, rank, line, line_index, body_hits)> over an array column of lines:
    types one of whose anchors is a heading, unless a negative anchor is one.

    Headings stand in the first base lines; a type that asks for a longer window gets it. The
    first anchor with a heading names the line; rank is the type's place in the catalogue.
    General types are never matched. The types are few and known when the plan is made:
    each is one built-in expression over the lines, in one pass without a join.
    """
    found = []
    for rank, t in enumerate(types):
        if t.fallback:
            continue
        window = F.greatest(F.lit(base) if isinstance(base, int) else base, F.lit(t.heading_lines))
        hit = F.coalesce(*[F.get(_headings(zone, a, window), F.lit(0)) for a in t.anchors])
        ok = hit.isNotNull()
        for n in t.negatives:
            ok = ok & (F.size(_headings(zone, n, window)) == 0)
        hints = F.lit(0)
        for h in t.hints:
            hints = hints + _any(zone, h).cast("int")
        said = partial(_type_said, zone, t, rank, hints)
        found.append(F.when(ok, once(hit, said)))
    return F.array_compact(F.array(*found))


def match_types(df: DataFrame, key: str, text: str, types: Sequence[DocType], base: int = HEADING_LINES) -> DataFrame:
    """(key, code, priority, rank, line, line_index, body_hits): the types that a text's headings name."""
    rows = df.select(key, lines(F.col(text)).alias("zone"))
    return rows.select(key, F.explode(type_matches("zone", types, base)).alias("t")).select(key, "t.*")


@dataclass(frozen=True)
class PageRole:
    code: str
    anchors: tuple[str, ...]
    negatives: tuple[str, ...] = ()
    attaches: bool = False


def _role_said(r: PageRole, anchor: str, x: Column) -> Column:
    parent = once(F.trim(F.regexp_extract(x, f"(?iu){anchor}", 1)), lambda p: F.nullif(p, F.lit(""))) if re.compile(anchor).groups else F.lit(None).cast("string")
    return F.when(x.isNotNull(), F.struct(F.lit(r.code).alias("code"), x.alias("line"), parent.alias("parent")))


def _unless(veto: Column, hit: Column) -> Column:
    return F.when(hit.isNotNull() & ~veto, hit)


def role_matches(zone: str, roles: Sequence[PageRole]) -> Column:
    """ARRAY<STRUCT(code, line, parent)> over an array column of lines: roles with an anchor anywhere on
    the page and no negative one; the first group of the anchor, if it has one, names the parent document."""
    found = []
    for r in roles:
        on = lambda p: F.get(F.filter(zone, lambda x: x.rlike(f"(?iu){p}")), F.lit(0))
        said = [once(on(a), partial(_role_said, r, a)) for a in r.anchors]
        veto = reduce(lambda a, b: a | b, [_any(zone, n) for n in r.negatives], F.lit(False))
        found.append(once(F.coalesce(*said), partial(_unless, veto)))
    return F.array_compact(F.array(*found))


def match_roles(df: DataFrame, key: str, text: str, roles: Sequence[PageRole]) -> DataFrame:
    """(key, code, line, parent): the roles that a page's lines name."""
    rows = df.select(key, lines(F.col(text)).alias("zone"))
    return rows.select(key, F.explode(role_matches("zone", roles)).alias("r")).select(key, "r.*")


def fallback_types(df: DataFrame, code: str, group: str, fallbacks: dict[str, str], default: str = "unknown_document") -> DataFrame:
    """Documents without a type get the general type of their group, else the default."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in fallbacks.items() for x in kv]), F.coalesce(group, F.lit("")))
    return df.withColumn("is_fallback", F.col(code).isNull()).withColumn(code, F.coalesce(code, named, F.lit(default)))


def page_texts(blocks: DataFrame, page: str, ordinal: str, kind: str, body: str) -> DataFrame:
    """(page, text): a page's blocks in order, unnumbered ones last, stamps left out."""
    part = F.struct(F.col(ordinal).isNull(), F.col(ordinal), F.col(body))
    shown = F.array_sort(F.collect_list(F.when((F.col(kind) != "stamp") & (F.trim(body) != ""), part)))
    return blocks.groupBy(page).agg(F.array_join(F.transform(shown, lambda x: x[body]), "\n\n").alias("text"))


def materials(documents: DataFrame, categories: Sequence[tuple[str, str]]) -> DataFrame:
    """(product_key, category, documents, batches) of documents (document_id, product, batch_no, heat_no,
    made_at): equal product names are one material, its batches the distinct numbers and dates."""
    key = phrase(F.col("product"))
    kind = F.coalesce(*[F.when(F.col("product").rlike(f"(?iu){p}"), F.lit(c)) for c, p in categories], F.lit(None).cast("string"))
    batch = F.when(F.coalesce("batch_no", "heat_no").isNotNull(), F.struct("batch_no", "heat_no", "made_at"))
    named = documents.withColumn("product_key", key).where("product_key <> ''")
    return named.groupBy("product_key").agg(F.min_by(kind, "document_id").alias("category"), F.array_sort(F.collect_set("document_id")).alias("documents"), F.array_sort(F.collect_set(batch)).alias("batches"))


def ranked(matches: Column) -> Column:
    """Matches from the highest priority down, in catalogue order among equals."""
    keyed = F.array_sort(F.transform(matches, lambda m: F.struct((-m["priority"]).alias("p"), m["rank"].alias("r"), m.alias("m"))))
    return F.transform(keyed, lambda k: k["m"])


def resolve_types(matches: DataFrame, key: str) -> DataFrame:
    """(key, code, state, alternatives): the highest priority wins, the first of the catalogue among
    equals; all others are alternatives. Several at the top are ambiguous."""
    all_ = ranked(F.collect_list(F.struct("code", "priority", "rank")))  # one entry a type at most
    g = matches.groupBy(key).agg(all_.alias("all"))
    tied = F.size(F.filter("all", lambda x: x["priority"] == F.col("all")[0]["priority"]))
    return g.select(key, F.col("all")[0]["code"].alias("code"), F.when(tied == 1, "resolved").otherwise("ambiguous").alias("state"), F.transform(F.slice("all", 2, 1000), lambda x: x["code"]).alias("alternatives"))


@dataclass(frozen=True)
class Field:
    """Stages of (pattern with one group, confidence); the first with a hit wins on a page."""

    code: str
    stages: tuple[tuple[str, float], ...]


def extract_fields(pages: DataFrame, doc: str, page: str, text: str, fields: Sequence[Field]) -> DataFrame:
    """(doc, code, value, confidence, page): the best hit of each field over a document's
    pages, the earliest on ties."""
    found = []
    for f in fields:
        stages = [
            F.when(F.col(text).rlike(p), F.struct(F.lit(f.code).alias("code"), F.regexp_extract(text, p, 1).alias("value"), F.lit(c).alias("confidence"))) for p, c in f.stages
        ]
        found.append(F.coalesce(*stages))
    hits = pages.select(doc, page, F.explode(F.array_compact(F.array(*found))).alias("h")).select(doc, page, "h.*")
    best = F.min_by(F.struct("value", "confidence", page), F.struct(-F.col("confidence"), F.col(page)))
    return hits.groupBy(doc, "code").agg(best.alias("b")).select(doc, "code", "b.value", "b.confidence", f"b.{page}")
