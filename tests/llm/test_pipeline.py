"""The corpus pipeline against a plain Python version of its stages."""

from __future__ import annotations

import random

import corpus_pipeline
from sluice.llm import lines, pieces, toxicity

from .test_operators import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, path, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_documents_without_terms_go_by_their_score(spark, tmp_path):
    path = written(spark, tmp_path, [(i, f"word{i} here") for i in range(10)] + [(10, None), (11, ""), (12, "...")], [(i, 1) for i in range(10)])
    docs, labels = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "labels"))
    assert all(r.predicted == 1 for r in toxicity.toxicity_report(docs, labels).collect())
    assert corpus_pipeline.drop_toxic(spark, docs, path).count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs, written(spark, tmp_path / "clean", [(0, "x")], [(0, 0)])).count() == 13


def test_run(spark, tmp_path):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdefghijklm", k=n))
    line = lambda: " ".join(word(rng.randint(3, 7)) for _ in range(10))
    bad = [f"zz{word(5)}" for _ in range(8)]
    rows = [(i, "\n".join(line() for _ in range(4))) for i in range(60)] + [(60 + i, " ".join(rng.choices(bad, k=12))) for i in range(20)]
    rows += [(80, rows[0][1]), (81, rows[1][1].split("\n")[2] + "\n" + line()), (82, None), (83, "")]
    base = [word(5) for _ in range(80)]
    rows += [(84, "\n".join([" ".join(base[:40]), " ".join(base[40:])])), (85, " ".join(base))]
    labels = [(i, int(60 <= i < 80)) for i in range(80)]
    kept = {i: t for i, t in rows if not 60 <= i < 80}
    seats: dict[str, list] = {}
    for i, t in sorted(kept.items()):
        for p, x in enumerate((t or "").split("\n")):
            if c := lines.compared(x):
                seats.setdefault(c, []).append((i, p))
    same = components(dict.fromkeys(seats), {c: {c[k : k + 5] for k in range(max(1, len(c) - 4))} for c in seats})
    first: dict[str, tuple] = {}
    for c, at in seats.items():
        first[same[c]] = min([*at, *([first[same[c]]] if same[c] in first else [])])
    gone = {s for c, at in seats.items() for s in at if s != first[same[c]]}
    clean = {}
    for i, t in kept.items():
        parts = [x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone]
        if not any((i, p) in gone for p in range(9)):
            clean[i] = t
        elif any(x.strip() for x in parts):
            clean[i] = "\n".join(parts)
    w = {i: (t or "").split() for i, t in clean.items()}
    groups = components(clean, {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} if x else set() for i, x in w.items()})
    want = {i: clean[i] or "" for i in set(groups.values())}
    assert 80 not in want and 81 in want and 85 not in want
    out = corpus_pipeline.run(spark, written(spark, tmp_path, rows, labels))
    got = pieces.decode(out).select("doc_id", "rank", "decoded_text").collect()
    assert {(r.doc_id, r.decoded_text or "") for r in got} == set(want.items())
    assert len({(r.doc_id, r["rank"]) for r in got}) == len(got)
