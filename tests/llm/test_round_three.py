"""Centroids, Merkle manifest and language of texts, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import centroids, common, dedup, langid, manifest


# ---------------------------------------------------------------- centroids
def plain_lloyd(rows, k=16, rounds=3, size=64, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]))
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cent = [v for _, v in first]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cent]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        groups = {}
        for _, v, c, _ in assign():
            groups.setdefault(c, []).append(v)
        cent = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(cent)]
    return assign(), cent


def test_centroids_against_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(80)]
    rows += [(80, None), (81, [1.0] * 63), (82, [float("nan")] * 64), (83, [float("inf"), *[0.0] * 63]), (84, [None, *[0.0] * 63]), (85, []), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    rows += [(90 + i, [0.0] * 64) for i in range(4)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    want, cent = plain_lloyd(rows)
    inertia = {}
    for _, _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    sha = lambda c: hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()
    expected = sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia.values()), sha(c)) for i, _, c, d in want)
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster_report(df).collect())
    assert got == expected


def test_centroids_of_huge_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 30, 300]) for _ in range(64)]) for i in range(20)]
    got, cent = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    want, expected = plain_lloyd(rows, k=3)
    assert cent == expected
    assert sorted((r.vec_id, r.cluster) for r in got.collect()) == sorted((i, c) for i, _, c, _ in want)
    assert all(r.distance == min(d, centroids.MOST) for r, (_, _, _, d) in zip(sorted(got.collect()), sorted(want, key=lambda w: w[0]), strict=True))


def test_centroids_ties_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(6)], schema)
    assert {(r.cluster, r.distance) for r in centroids.cluster_report(same).collect()} == {(0, 0)}
    assert centroids.cluster_report(spark.createDataFrame([], schema)).count() == 0
    assert centroids.cluster_report(spark.createDataFrame([(1, None)], schema)).count() == 0


# ---------------------------------------------------------------- manifest
def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(leaves):
    """Root, and for each leaf its list of (run, place)."""
    level, way, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for j in range(len(leaves)):
            way[j].append((runs[at[j] // 8], at[j] % 8))
            at[j] //= 8
        level = [h("".join(r)) for r in runs]
    return level[0], way


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    leaf = lambda r, text: h("".join(map(field, (r[0], r[1], r[2], r[3], text))))
    trees = {}
    for r in rows:
        text = r[4]
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        low = text if text is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees.setdefault(r[2], []).append((-1 if r[0] is None else r[0], leaf(r, text), leaf(r, low), r[0]))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:2])
    made = {t: plain_tree([x[1] for x in trees[t]]) for t in langs}
    root, above = plain_tree([made[t][0] for t in langs])
    out = []
    for t, top in zip(langs, above, strict=True):
        for (_, own, low, i), way in zip(trees[t], made[t][1], strict=True):
            proof = h("".join("".join(run[:p] + run[p + 1 :]) for run, p in way + top))
            node = low
            for run, p in way + top:
                node = h("".join([*run[:p], node, *run[p + 1 :]]))
            out.append((-1 if i is None else i, own, made[t][0], root, proof, node, node == root))
    return sorted(out)


def documents(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", None]), rng.choice(langs), i, "".join(rng.choice("aB é\n") for _ in range(rng.randint(0, 9)))) for i in range(n)]
    return rows


DOC = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, part string, size string, run string"


@pytest.mark.parametrize("n,langs", [(0, ["x"]), (1, ["x"]), (8, ["x"]), (9, ["x"]), (65, ["x", None]), (700, ["x", "y", None, "", "é", "z", "w", "v", "u", "t"])])
def test_manifest_against_plain_trees(spark, monkeypatch, n, langs):
    monkeypatch.setattr(manifest, "PART_ROWS", 37)  # unaligned edges in every tree
    rows = documents(n, langs)
    if n > 60:
        rows += [rows[3], rows[3], (None, None, None, None, None), (5, "a", "x", 0, None), (10**12, "é" * 3, "x", -4, "A" * 100_000)]
    got = manifest.manifest_report(spark.createDataFrame([(*r, "t", 1, "p", "s", "r") for r in rows], DOC).repartition(3)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == (plain_manifest(rows) if rows else [])


def test_node_records_make_the_whole_tree(spark, monkeypatch):
    monkeypatch.setattr(manifest, "PART_ROWS", 50)
    leaves = [(("x", "y")[i % 3 == 0], i, h(str(i))) for i in range(500)]
    rows, records, roots = manifest.manifest(common.materialize(spark.createDataFrame(leaves, "tree string, ord long, leaf string")))
    want, seen = {}, {(r.tree, r.level, r.idx): r.node for r in records.collect()}
    for t in "xy":
        level = [x[2] for x in leaves if x[0] == t]
        k = 0
        while len(level) > 1:
            k += 1
            level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
            want |= {(t, k, i): x for i, x in enumerate(level)}
        assert {r.tree: r.root for r in roots.collect()}[t] == level[0]
    assert seen == want and records.count() == len(want)


def test_stack_carries_and_leaves_peaks():
    s = manifest.Stack(8)
    out = [n for i in range(3, 75) for n in s.push(i, h(str(i)))]
    assert [(n[0], n[1]) for n in out if n[3]] == [(1, i) for i in range(1, 9)]  # positions 3-7 wait, the run of runs 0-7 misses its first
    assert [(n[0], n[1]) for n in out if not n[3]] == [(0, i) for i in range(3, 8)] + [(1, i) for i in range(1, 8)]
    assert [(n[0], n[1]) for n in s.peaks()] == [(0, 72), (0, 73), (0, 74), (1, 8)]


# ---------------------------------------------------------------- language
TONGUES = {"aa": "the and thing other then with", "bb": "ñandú ción de los mente que", "cc": "schön und der straße über ich"}


def spoken(lang, n, rng):
    return " ".join(rng.choice(TONGUES[lang].split()) for _ in range(n))


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    net = langid.Network(3, seed=4, hidden=4)
    for layer in (net.ahead, net.back):
        layer.tables, layer.inner = [t.astype(np.float64) for t in layer.tables], [u.astype(np.float64) for u in layer.inner]
    x, label = rng.integers(97, 103, (3, 6)).astype(np.uint8), np.array([0, 2, 1])
    _, grads = net.loss(x, label)
    for w, g in zip(net.weights, grads, strict=True):
        for at in {tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)} | ({(98, 1)} if w.shape[0] == 256 else set()):
            kept, step = w[at], 1e-2
            w[at] = kept + step
            up = net.loss(x, label)[0]
            w[at] = kept - step
            down = net.loss(x, label)[0]
            w[at] = kept
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def plain_pool(net, text: str, languages: int):
    """Every byte's probabilities, window by window, one byte after the other."""
    raw = text.encode()
    folded = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    bent = lambda v: v / (1 + np.abs(v))

    def states(layer, seq):
        hid, out = np.zeros(langid.HIDDEN), []
        for b in seq:
            z, r = ((1 + bent(layer.tables[k][b] + hid @ layer.inner[k])) / 2 for k in (0, 1))
            c = bent(layer.tables[2][b] + (r * hid) @ layer.inner[2])
            hid = hid + z * (c - hid)
            out.append(hid)
        return out

    total, step = np.zeros(languages), langid.STEPS - 2 * langid.MARGIN
    for mine in range(0, len(raw), step):
        until = min(mine + step, len(raw))
        lo, hi = max(mine - langid.MARGIN, 0), min(until + langid.MARGIN, len(raw))
        ahead, back = states(net.ahead, folded[lo:hi]), states(net.back, folded[lo:hi][::-1])[::-1]
        for i in range(mine, until):
            if chr(raw[i]).isascii() and not chr(raw[i]).isalpha():
                continue
            s = np.concatenate([ahead[i - lo], back[i - lo]]) @ net.out + net.bias
            total += np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    return total


def test_pooling_against_a_plain_network():
    rng = random.Random(1)
    net = langid.Network(3)
    texts = ["", "a", "Ab 9", spoken("bb", 300, rng), "9 9 9", spoken("aa", 44, rng), "x" * 240, "é" * 121]
    data, at = common.text_bytes(pa.array(texts))
    got = langid.pooled(net, 3, data, at)
    for g, t in zip(got, texts, strict=True):
        assert g == pytest.approx(plain_pool(net, t, 3), rel=1e-3, abs=1e-4)


def test_languages_held_out(spark):
    rng = random.Random(7)
    rows = [(i, spoken(lang, rng.randint(3, 200), rng), lang) for i, lang in enumerate(rng.choices(list(TONGUES), k=400))]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !", "bb"), (1003, "中", "aa"), (1004, spoken("cc", 9000, rng), None), (None, spoken("aa", 50, rng), "bb")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd + rows[:40]], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    got = langid.language_report(df).collect()
    assert len(got) == 446
    pred = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [pred[i].lang_pred == lang for i, _, lang in rows if pred[i].held_out]
    assert len(held) > 60 and np.mean(held) >= 0.98
    assert [(pred[i].lang_pred, pred[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert pred[1003].lang_pred in TONGUES and pred[1004].lang_pred == "cc" and pred[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_report(df).collect()}
    assert all(again[r.doc_id][0] == r.lang_pred for r in got)


def test_no_language_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.language_report(spark.createDataFrame([], schema)).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.language_report(spark.createDataFrame([(1, "abc", None), (2, None, "x")], schema)).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in langid.language_report(spark.createDataFrame([(i, "abc def", "only") for i in range(9)], schema)).collect()} == {"only"}


# ---------------------------------------------------------------- near copies of one id
def test_near_dedup_loses_no_text_of_a_repeated_id(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40))
    a, b, c, d = (text() for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (6, b), (7, c), (7, d), (7, c), (8, d), (None, a), (9, None), (2, c)]
    left = dedup.near_dedup(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string"))
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted([(3, a), (2, c), (-1, a), (9, ""), *((i, t) for i, t in [(6, b), (8, d)])])


def test_near_dedup_keeps_one_row_of_each_text(spark):
    texts = [" ".join(str(j * i) for j in range(30)) for i in range(1, 4)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[1])]
    left = dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.text for r in left.collect()) == sorted(texts)


def test_model_noise_and_normalisers():
    import numpy as np

    from sluice.llm import lm

    rng = np.random.default_rng(0)
    model = lm.Model(rng.integers(1, 50, 1000).astype(float))
    c = rng.integers(0, 7, 500)
    x = model.cumulative[c * lm.CLASS] + rng.random((4, 500)) * (model.cumulative[(c + 1) * lm.CLASS] - model.cumulative[c * lm.CLASS])
    assert (model.within(c, x) == np.searchsorted(model.cumulative, x, "right") - 1).all()
    logits = np.array([[500.0, 500.0], [-500.0, -np.inf], [1.0, 1.0]], dtype=np.float32)
    assert np.allclose(lm._log_sum(logits), [500 + np.log(2), -500, 1 + np.log(2)])
    one, two, symbol = (rng.integers(0, 1000, 3000) for _ in range(3))
    one[1500:], two[1500:] = one[:1500], two[:1500]
    assert np.allclose(model.log10(one, two, symbol)[:5], [model.log10(one[[i]], two[[i]], symbol[[i]])[0] for i in range(5)], atol=1e-5)
