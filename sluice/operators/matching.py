"""Matching ladders: exact key, then folded key, by counted joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import doc_no, doc_no_folded, folded, registry_name


def match_rows(rows: DataFrame, documents: DataFrame, scope: Sequence[str] = (), kept: Sequence[str] = (), facts: Sequence[str] = ()) -> DataFrame:
    """rows (row_id, number), documents (document_id, number) -> state, score, document; within equal scope columns.

    Exact key: one hit matches with 1.0, more are ambiguous; else the folded key: 0.85.
    Counted per key before the join, so a hot key costs one row. Equal keys are equal when folded: the rows
    are joined once, by the folded key, with its spellings. kept: more columns of rows; facts: of the matched document.
    """
    at = list(scope)
    d = documents.withColumn("e", doc_no(F.col("number"))).withColumn("f", folded(F.col("e"))).where("e <> ''")
    spelled = d.groupBy(*at, "f", "e").agg(F.count("*").alias("n"), F.min(F.struct("document_id", *facts)).alias("one"))
    keys = spelled.groupBy(*at, "f").agg(F.collect_list(F.struct("e", "n", "one")).alias("spellings"), F.sum("n").alias("fold_n"), F.min("one").alias("fold"))
    r = rows.withColumn("e", doc_no(F.col("number"))).withColumn("f", folded(F.col("e")))
    j = r.join(keys, [*at, "f"], "left").withColumn("exact", F.get(F.filter("spellings", lambda s: s["e"] == F.col("e")), F.lit(0)))
    n, two = F.col("exact.n"), F.col("fold_n") == 1
    state = F.when(n == 1, "matched").when(n > 1, "ambiguous").when(two, "matched").when(F.col("fold_n") > 1, "ambiguous").otherwise("missing")
    score = F.when(n == 1, 1.0).when(n > 1, None).when(two, 0.85)
    doc = F.when(n == 1, F.col("exact.one")).when(n > 1, None).when(two, F.col("fold"))
    return j.select(*at, "row_id", *kept, state.alias("state"), score.alias("score"), doc.alias("_d")).select(*at, "row_id", *kept, "state", "score", "_d.document_id", *(f"_d.{c}" for c in facts))


def never_named(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that no row names, ambiguous hits counting as names."""
    r = rows.select(doc_no(F.col("number")).alias("e"), doc_no_folded(F.col("number")).alias("f"))
    d = documents.withColumns({"e": doc_no(F.col("number")), "f": doc_no_folded(F.col("number"))})
    exact = d.select("e").distinct()
    loose = r.join(exact, "e", "left_anti").select("f").distinct()
    return d.join(r.select("e").distinct(), "e", "left_anti").join(loose, "f", "left_anti").select("document_id")


def confusion(pairs: DataFrame) -> DataFrame:
    """Per class from (expected, predicted): tp, fp, fn, precision, recall, f1."""
    gold = pairs.groupBy(F.col("expected").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("expected") == F.col("predicted")).alias("tp"))
    said = pairs.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("said"))
    j = gold.join(said, "label", "full").na.fill(0, ["support", "tp", "said"])
    p, r = F.when(F.col("said") > 0, F.col("tp") / F.col("said")), F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    return j.select("label", "support", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def overall(classes: DataFrame) -> DataFrame:
    """One row from ``confusion``: micro and macro figures; macro F1 over classes with three or
    more expected rows; phantom classes are only predicted, rare ones have one or two rows."""
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    return classes.agg(
        F.round(share("tp", "support"), 9).alias("micro_recall"), F.round(share("tp", F.col("tp") + F.col("fp")), 9).alias("micro_precision"), F.round(F.avg("recall"), 9).alias("macro_recall"),
        F.round(F.avg(F.when(F.col("support") >= 3, F.coalesce("f1", F.lit(0.0)))), 9).alias("macro_f1"), F.count_if(F.col("support") == 0).alias("phantom"), F.count_if(F.col("support").between(1, 2)).alias("rare"),
    )


#: rungs of groups in order: key and score
_RUNGS = (("k1", 1.0), ("k2", 0.85), ("k3", 0.9))


def _title(c: Column) -> Column:
    return F.lower(registry_name(c))


def _candidate_keys(candidates: DataFrame) -> DataFrame:
    """(doc, rung, key, work, contractor), once for each key that a candidate has."""
    numbers = F.coalesce("numbers", F.array().cast("array<string>"))
    of = lambda rung, key: F.struct(F.lit(rung).alias("rung"), key.alias("key"))
    keys = F.array_distinct(F.concat(F.transform(numbers, lambda x: of(1, doc_no(x))), F.transform(numbers, lambda x: of(2, doc_no_folded(x))), F.array(of(3, _title(F.col("title"))))))
    return candidates.select("doc", F.inline(keys), "work", "contractor").where("key <> ''")


def _rungs() -> Column:
    """The keys of a group by rung: array of (rung, key)."""
    return F.array(F.struct(F.lit(1).alias("rung"), F.col("act_norm").alias("key")), F.struct(F.lit(2).alias("rung"), F.col("act_folded").alias("key")), F.struct(F.lit(3).alias("rung"), _title(F.col("title")).alias("key")))


def _group_keys(groups: DataFrame) -> DataFrame:
    """(doc, ord, rung, key): the keys of a group by rung."""
    return groups.select("doc", "ord", F.inline(_rungs())).where("key <> ''")


def _decided(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, ord, rung, key): each group's first rung with any candidate."""
    known = _candidate_keys(candidates).select("doc", "rung", "key").distinct()
    hit = _group_keys(groups).join(known, ["doc", "rung", "key"])
    return hit.groupBy("doc", "ord").agg(F.min(F.struct("rung", "key")).alias("b")).select("doc", "ord", "b.rung", "b.key")


def match_groups(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, ord, state, score, work): groups (doc, ord, act_norm, act_folded, title, contractor) against
    candidates (doc, work, contractor, title, numbers) of the same doc.

    Rungs: act number exact 1.0, folded 0.85, title (lower case, as it stands) 0.9; the first rung
    with any candidate counts. Several candidates are narrowed to those whose contractor's name
    contains the group's or is contained in it: one left matches with 0.8; more, or none, leave the
    group ambiguous. Candidates are summed by contractor before the join, so a number that many
    works share costs as many rows as it has contractors.
    """
    by = _candidate_keys(candidates).groupBy("doc", "rung", "key", "contractor").agg(F.count("*").alias("n"), F.min("work").alias("one"))
    own = groups.select("doc", "ord", F.inline(_rungs()), _title(F.col("contractor")).alias("needle")).where("key <> ''")
    a, b = F.col("needle"), F.lower("contractor")
    same = F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))
    #: one shuffle for both sums: by rung, then the first rung of each group
    pairs = own.join(by, ["doc", "rung", "key"]).select("doc", "ord", "rung", "n", "one", same.alias("same")).repartition("doc", "ord")
    each = pairs.groupBy("doc", "ord", "rung").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("m"), F.min(F.when(F.col("same"), F.col("one"))).alias("own"))
    best = each.groupBy("doc", "ord").agg(F.min_by(F.struct("rung", "n", "one", "m", "own"), "rung").alias("b")).select("doc", "ord", "b.*")
    j = groups.select("doc", "ord").join(best, ["doc", "ord"], "left")
    alone, narrowed = F.col("n") == 1, F.col("m") == 1
    rung = F.coalesce(*[F.when(F.col("rung") == i, F.lit(score)) for i, (_, score) in enumerate(_RUNGS, 1)])
    return j.select(
        "doc", "ord", F.when(alone | narrowed, "matched").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("state"),
        F.when(alone, rung).when(narrowed, 0.8).alias("score"), F.when(alone, F.col("one")).when(narrowed, F.col("own")).alias("work"),
    )


def named_works(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, work) of candidates that stood to choose for any group; all others are extra."""
    named = _decided(groups, candidates).select("doc", "rung", "key").distinct()
    return _candidate_keys(candidates).join(named, ["doc", "rung", "key"], "left_semi").select("doc", "work").distinct()
