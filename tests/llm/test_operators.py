"""The operators on a small table with nulls, empties, ties, repeats, long texts and odd columns."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import ann, bm25, common, dedup, lines, lm, mixing, pieces, sharding, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, id string, component string"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    rows: list[tuple[int | None, str | None]] = []
    for i in range(60):
        rows.append((i, "\n".join(make(rng.randint(8, 30)) for _ in range(rng.randint(1, 5)))))
    base = make(120)
    for i in range(60, 75):
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(75, rows[0][1]), (76, rows[0][1]), (77, None), (78, ""), (79, " \n\t "), (80, "one two"), (81, "One  TWO"), (82, make(30_000)), (83, "x" * 5_000), (84, "ñandú ▁ 中文 🙂\r\nend"), (None, make(12)), (3, rows[3][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "a", "b", "c") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t: str | None) -> list[bytes]:
    return (t or "").encode().lower().split()


def components(items: dict, sets: dict, percent: int = 75) -> dict:
    parent = {i: i for i in items}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = list(items)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(find(keys[a]), find(keys[b]))] = min(find(keys[a]), find(keys[b]))
    return {i: find(i) for i in items}


def test_near_duplicates(docs, none):
    by = {i: t for i, t in texts() if i is not None}
    w = {i: words(t) for i, t in by.items()}
    sets = {i: ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} if x else set()) for i, x in w.items()}
    want = components(by, sets)
    got = dedup.dedup_report(docs).collect()
    assert len(got) == len(texts())
    assert all(r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == want[r.doc_id]) for r in got if r.doc_id is not None)
    left = dedup.near_dedup(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.select("doc_id").collect()} == {*want.values(), None}
    assert dedup.dedup_report(none).count() == 0


def test_lines(docs, none):
    by = {i: t for i, t in texts() if i is not None}
    seats = collections.defaultdict(list)
    for i, t in sorted(by.items()):
        for p, x in enumerate((t or "").split("\n")):
            if c := lines.compared(x):
                seats[c].append((i, p))
    sets = {c: {c[k : k + lines.SHINGLE] for k in range(max(1, len(c) - lines.SHINGLE + 1))} for c in seats}
    comp = components(dict.fromkeys(seats), sets)
    groups = collections.defaultdict(list)
    for c, at in seats.items():
        groups[comp[c]] += at
    null_lines = {lines.compared(t) for i, t in texts() if i is None}
    gone = {s for g, at in groups.items() for s in sorted(at)[1:]}
    got = {(r.doc_id, p) for r in lines.line_report(docs.where("doc_id is not null")).collect() for p in r.removed}
    assert got == gone and null_lines
    assert lines.dedup_lines(docs).columns == docs.columns
    assert lines.line_report(none).count() == 0 and lines.dedup_lines(none).count() == 0


def test_lines_with_one_change(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    rows, want = [], set()
    for i in range(0, 120, 3):
        line = " ".join(word(6) for _ in range(rng.randint(12, 16)))  # 83 to 111 characters
        short = line[:48] + "yz"
        rows += [(i, f"{line}\n{short}"), (i + 1, line.replace(line.split()[5], word(6))), (i + 2, short[:20] + "#" + short[21:])]
        want |= {(i + 1, 0), (i + 2, 0)}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, p) for r in lines.line_report(d).collect() for p in r.removed} == want


def test_mixing(docs, none):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(texts())
    by = collections.defaultdict(list)
    for r in got:
        by[r.target, r.source_size].append(r)
    total = sum(r.size for r in got)
    assert abs(sum(t for t, _ in by) - total) < 1e-6 * total
    for (target, size), rows in by.items():
        assert target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_report(none).count() == 0


def test_mixing_is_a_pareto_sample(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(1, int(2 ** rng.uniform(0, 9)))), f"s{i % 3}") for i in range(3000)]
    rows = [(i, t.replace("", " ") if i % 2 else t, s) for i, t, s in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_report(d).collect()}
    drawn = collections.defaultdict(list)
    for r in mixing._sized(d, 0).collect():
        drawn[r.source].append(r)
    shares = []
    for group in drawn.values():
        target, size = got[group[0].doc_id].target, sum(r.size for r in group)
        whole = math.floor(target / size)
        left = target - whole * size
        m = {r.doc_id: math.sqrt(2 ** (r.size.bit_length() - 1)) for r in group if r.size}
        lo, hi = 0.0, 10.0
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(1, c * m[r.doc_id]) * r.size for r in group if r.size) < left else (lo, c)
        p = {i: min(1, lo * x) for i, x in m.items()}
        q = {r.doc_id: 0 if p[r.doc_id] > 1 - 1e-9 else r.u / (1 - r.u) / (p[r.doc_id] / (1 - p[r.doc_id])) for r in group if r.size}
        extra, sum_ = set(), 0
        for r in sorted((r for r in group if r.size), key=lambda r: (q[r.doc_id], r.doc_id)):
            if sum_ + r.size / 2 <= left:
                extra.add(r.doc_id)
            sum_ += r.size
        assert all(got[r.doc_id].copies == whole + (r.doc_id in extra) for r in group)
        for k in {x for x in p.values() if 0.02 < x < 0.98}:
            same = [i for i, x in p.items() if x == k]
            if len(same) > 60:
                shares.append((sum(i in extra for i in same) / len(same) - k) / math.sqrt(k * (1 - k) / len(same)))
    assert len(shares) > 3 and max(map(abs, shares)) < 4


def test_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 20, "d": 0, None: 500}, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    target, free, left = {}, set(size), 1530.0
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3 * size[s] for s in over} if over else share
        left, free = left - sum(3 * size[s] for s in over), free - over
        if not over:
            break
    assert all(abs(got[s] - target[s]) < 1e-6 for s in size)


def test_sharding(docs, none):
    got = sharding.assign_shards(docs, 6).collect()
    assert len(got) == len(texts())
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    t = {i: x for i, x in texts() if i is not None}
    assert all(r.size == len((t[r.doc_id] or "").encode()) + 8 for r in got if r.doc_id is not None)
    assert all(r.text_crc32 == zlib.crc32(t[r.doc_id].encode()) for r in got if r.doc_id is not None and t[r.doc_id] is not None)
    assert sharding.assign_shards(none).count() == 0


def test_shards_hold_equal_bytes(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("abcdef ", k=int(2 ** rng.uniform(3, 9)))), "s", i) for i in range(4000)] + [(5000 + i, "the same text again " * 6, "s", i) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, slot string, _c long")
    size = collections.Counter()
    for r in sharding.assign_shards(d, 8).collect():
        size[r.shard] += r.size
    mean = sum(size.values()) / 8
    assert len(size) == 8 and all(abs(x - mean) < 0.02 * mean for x in size.values())
    sharding.write_shards(d, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and sorted(back.columns) == ["_c", "doc_id", "shard", "slot", "text"]
    assert {r.shard for r in back.select("shard").distinct().collect()} == set(range(8))


def test_language_model(docs, none):
    rows = texts()
    count = collections.Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    t = {i: x for i, x in rows if i is not None}
    for r in lm.lm_scores(docs).collect():
        if r.doc_id is None:
            continue
        w = [*words(t[r.doc_id]), None]
        assert r.train_tokens == n and r.n_tokens == len(w) and r.n_known == sum(count[x] > 0 for x in w)
        assert abs(r.base_score - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert lm.lm_scores(none).count() == 0


def _symbol_of(fitted, word):
    """Symbol of a word (None: the end), and what its ending takes off its probability."""
    if word is None:
        return 0, 0.0
    at = {int(h): int(i) for h, i in zip(fitted.symbols.hash, fitted.symbols.symbol, strict=True)}.get(common.string_hash(word), -1)
    if at >= 0:
        return at, 0.0
    raw = word
    tail = int(common.mix(np.array([raw[-1] * 257 + (raw[-2] if len(raw) > 1 else 0)], dtype=np.uint64))[0] % lm.TAILS)
    return 1 + tail, math.log10(fitted.size[tail] + 1)


def test_language_model_scores_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 40)
    rng = random.Random(5)
    pool = [f"w{i}x{i * 7 % 11}" for i in range(90)]
    texts_ = {i: " ".join(rng.choices(pool, weights=range(90, 0, -1), k=rng.randint(0, 30))) for i in range(60)} | {60: None, 61: "", 62: "unseen w1x7 UNSEEN"}
    train = spark.createDataFrame([(i, t) for i, t in texts_.items() if i < 50], "doc_id long, text string")
    fitted = lm.fit(train)
    count = collections.Counter(w for i, t in texts_.items() if i < 50 for w in words(t))
    theta = fitted.model.theta.astype(float)
    a, b, t, u = theta[: lm.SYMBOLS], theta[lm.SYMBOLS : 2 * lm.SYMBOLS], theta[2 * lm.SYMBOLS : 3 * lm.SYMBOLS], theta[3 * lm.SYMBOLS :]

    def dist(one, two):
        r = a[one] + b[two]
        r[-1] = 1
        p = np.exp(t @ r).reshape(-1, lm.CLASS)
        c = np.exp(u @ r)
        share = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
        return (share * (c / c.sum())[:, None]).ravel()

    assert abs(dist(0, 0).sum() - 1) < 1e-6 and abs(dist(66, 3).sum() - 1) < 1e-6
    doc = spark.createDataFrame(list(texts_.items()), "doc_id long, text string").withColumn("held_out", F.lit(False))
    for r in lm.score(doc, fitted).collect():
        one = two = 0
        plain = 0.0
        for w in [*words(texts_[r.doc_id]), None]:
            s, inside = _symbol_of(fitted, w)
            plain += math.log10(dist(one, two)[s]) - inside + (math.log10(count[w] + 1) if 0 < s <= lm.TAILS else 0)
            one, two = s, one
        assert abs(plain - r.score) < 1e-3 * max(1, r.n_tokens), (r.doc_id, plain, r.score)


def test_sampled_nce_learns_a_conditional():
    rng = np.random.default_rng(1)
    table = np.array([[0.9, 0.09, 0.01], [0.01, 0.1, 0.89], [0.3, 0.3, 0.4]])
    at = lm.FIRST_WORD + np.array([0, 100, 101])  # in two classes
    one = rng.integers(0, 3, 60_000)
    nxt = (rng.random(len(one))[:, None] > table[one].cumsum(1)).sum(1)
    counts = np.zeros(lm.FIRST_WORD + 102)
    counts[at] = np.bincount(nxt)
    model, touched = lm.Model(counts), np.zeros(3 * lm.SYMBOLS + lm.CLASSES, dtype=np.int64)
    zero = np.zeros(len(one), dtype=np.int64)
    for lo in range(0, len(one), 500):
        i = slice(lo, lo + 500)
        model.step(at[one[i]], zero[i], at[nxt[i]], rng, touched)
    p = np.array([[10 ** model.log10(at[[x]], zero[:1], at[[y]])[0] for y in range(3)] for x in range(3)])
    assert np.abs(p - table).max() < 0.08, p


def test_toxicity(spark, docs, none):
    rows = [(i, f"plain words number {i} and {i * 7} here") for i in range(200)] + [(i, f"you are a vilest zzcur {i} thing") for i in range(200, 280)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _ in rows] + [(5, 0), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(d, labels).collect()}
    assert len(got) == 282
    held = [r for r in got.values() if r.held_out and r.doc_id < 280]
    assert np.mean([r.predicted == (r.doc_id >= 200) for r in held]) > 0.95
    assert got[900].predicted == 0 and got[901].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.drop_toxic(d, labels).columns == d.columns
    assert toxicity.toxicity_report(none, labels).count() == 0
    assert toxicity.toxicity_report(docs, labels.where("false")).where("score <> 0").count() == 0


def test_toxicity_is_cosine_over_all_words(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choices("klmnop", k=rng.randint(3, 7))) for _ in range(300)]
    texts_ = {i: " ".join(rng.choices(plain, k=rng.randint(5, 40))) for i in range(300)} | {i: f"zzrare {rng.choice(plain)}" for i in range(300, 306)}
    texts_ |= {1000: "zzrare never seen", 1001: " ".join([*plain, "zzrare", "unseenword"])}
    d = spark.createDataFrame(list(texts_.items()), "doc_id long, text string")
    labels = {i: int(i >= 280) for i in range(306)}
    got = {r.doc_id: r for r in toxicity.toxicity_report(d, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    terms = {i: collections.Counter(w[:4] for w in x.split()) for i, x in texts_.items()}
    df = collections.Counter(t for c in terms.values() for t in c)
    vectors = {}
    for i, c in terms.items():
        v = {t: (1 + math.log(n)) * math.log((len(texts_) + 1) / df[t]) for t, n in c.items()}
        vectors[i] = {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()}
    train = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    for q in (1000, 1001, *[i for i in labels if i not in train][:30]):
        want = sorted(((sum(w * vectors[i].get(t, 0) for t, w in vectors[q].items()), -i) for i in train), reverse=True)[:3]
        want = [(-i, s) for s, i in want if s > 0]
        assert [e.doc_id for e in got[q].evidence] == [i for i, _ in want]
        assert np.allclose([e.cosine for e in got[q].evidence], [s for _, s in want])
    assert got[1000].score > got[1001].score


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(0)
    rows = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(1, 6), replace=False)} for _ in range(700)]
    index = toxicity.Index(rows, rng.integers(0, 2, 700), np.arange(700), rng.random(40) + 0.1)
    dense = np.zeros((700, 40))
    for i, r in enumerate(rows):
        t, w = index.vector(r)
        dense[i, t] = w
    for q in range(50):
        s = dense @ dense[q]
        want = np.lexsort((np.arange(700), -s))[:15]
        got = index.nearest(rows[q])
        assert np.allclose([x for x, _ in got], s[want][s[want] > 0])


def test_pieces_sampling_is_fair():
    v = pieces.vocabulary(pieces.MODEL)
    text, n = "the cat\nñx", 3000
    found = pieces.Sampler(v, pa.array([text] * n), np.arange(n, dtype=np.uint64), 2)
    paths = found.sample()
    weight = collections.Counter()
    for p in paths:
        ids, size = found.ids([x[0] for x in p])
        cut = np.split(ids, np.cumsum(size)[:-1])
        keys = [tuple(c.tolist()) for c in cut]
        assert len(set(keys)) == len(keys)
        for k, x in zip(keys, p, strict=True):
            weight[k, round(x[1], 9)] += 1 / x[2] / n
    likely = [(k, w) for k, w in weight.items() if k[1] > math.log(0.05)]
    assert likely and all(abs(w - 1) < 0.15 for _, w in likely)


def test_pieces(docs, none):
    got = pieces.encode_report(docs).collect()
    assert all(r.decoded for r in got)
    assert {r.doc_id for r in got} == {i for i, _ in texts()}
    assert {(r.doc_id, r["rank"], r.ids_hash) for r in got} == {(r.doc_id, r["rank"], r.ids_hash) for r in pieces.encode_report(docs.repartition(7)).collect()}
    e = pieces.decode(pieces.encode(docs.drop("id")))
    assert e.where("not decoded_text <=> coalesce(text, '')").count() == 0
    assert pieces.encode_report(none).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:200] = v[100]
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(600)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, []), (1200, [None] * 16), (1250, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit = 0
    assert set(got) == set(range(0, 600, 50))
    for q, found in got.items():
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(600), -s))[:5]
        assert len(found) == 5 and all(abs(s[i] - x) < 1e-9 for i, x in found)
        hit += len({i for i, _ in found} & set(want.tolist()))
    assert hit >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[150]] == [100, 101, 102, 103, 104]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def test_neighbours_over_several_shards(spark):
    rng = np.random.default_rng(6)
    n = 3 * ann.SHARD_NODES
    v = rng.normal(size=(n, 24)).astype(np.float32)
    rows = pa.table({"vec_id": np.arange(n), "embedding": list(v), "_q": ["x"] * n})
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append(r.vec_id)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, n, 100):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & set(got[q]))
    assert all(len(x) == 5 for x in got.values()) and len(got) == len(range(0, n, 100)) and hit >= 0.9 * 5 * len(got)


def test_urls(spark):
    rows = [(0, None), (1, "nothing"), (2, "http://A.Com/x?y#z"), (3, "https://www.example.com/en/a"), (4, "https://b.example.com/en/a"), (5, "http://x.net/es/1"), (6, "http://x.net/de/1"), (7, "http://notcom/x"), (8, "http://x.com"), (9, "http://x.org?q=://y")]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 2, 9)] == [("", ""), ("", ""), ("a.com", "/x"), ("x.org", "")]
    assert [(got[i].rule, got[i].verdict) for i in (2, 3, 4, 5)] == [("com/", "allow"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block")]
    assert all(got[i].rule is None and got[i].verdict in ("allow", "block") for i in (0, 1, 6, 7, 8, 9))
    assert urls.judge_urls(df.where("false")).count() == 0


def test_url_verdicts_against_plain_version(spark):
    rng = random.Random(4)
    hosts = [f"{w}{rng.randint(1, 99)}.{t}" for w in ("shop", "news", "cdn") for t in ("com", "org", "net", "example.com") for _ in range(4)]
    rows = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'x'])}/{rng.randint(1, 300)}{rng.choice(['', '.html', '.php', '?a=1&b=2'])}") for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(50)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}

    def parts(u):
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        return rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]

    def features(u, without):
        h, p = parts(u)
        q = u.split("?", 1)[1] if "?" in u else ""
        share = [h.count(c) / len(h) for c in set(h)]
        f = [len(u), len(h), len(p), sum(1 for x in p.split("/") if x), h.count(".") + 1, sum(c.isdigit() for c in u) / len(u), -sum(x * math.log2(x) for x in share), h.count("-"), len([x for x in q.split("&") if x]), max(map(len, h.split("."))), float(u.startswith("https:"))]
        ending = p.rsplit(".", 1)[1] if "." in p and p.rsplit(".", 1)[1].isalpha() else ""
        for table, key in ((suffix, h.split(".")[-1]), (ends, ending)):
            b, g = table[key]
            if without and u in label:
                b, g = b - label[u] * count[u], g - (1 - label[u]) * count[u]
            b, g = b * (bad + good) / 2 / max(bad, 1), g * (bad + good) / 2 / max(good, 1)
            f.append((b + urls.SMOOTHING / 2) / (b + g + urls.SMOOTHING))
        return f

    label = {u: float(got[i].verdict == "block") for i, u in rows if got[i].rule}
    count = collections.Counter(u for _, u in rows)
    suffix, ends = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for u, y in label.items():
        h, p = parts(u)
        for table, key in ((suffix, h.split(".")[-1]), (ends, p.rsplit(".", 1)[1] if "." in p and p.rsplit(".", 1)[1].isalpha() else "")):
            table[key][0 if y else 1] += count[u]
    bad, good = sum(count[u] for u, y in label.items() if y), sum(count[u] for u, y in label.items() if not y)
    train = sorted(label)
    bias, trees = urls.fit_trees(np.array([features(u, True) for u in train]), np.array([label[u] for u in train]), np.array([count[u] for u in train], dtype=float))
    want = urls.tree_scores(np.array([features(u, False) for _, u in rows]), bias, trees)
    assert np.allclose([got[i].score for i, _ in rows], want, atol=1e-6)
    assert all(got[i].verdict == ("block" if w >= 0.5 else "allow") for (i, _), w in zip(rows, want, strict=True) if got[i].rule is None)


def test_trees_separate():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.7)).astype(float)
    bias, trees = urls.fit_trees(x[:1000], y[:1000])
    assert ((urls.tree_scores(x[1000:], bias, trees) >= 0.5) == y[1000:]).mean() > 0.95


def test_bm25(docs, none):
    rows = {i: words(t) for i, t in texts() if i is not None}
    d = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    q = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")
    tf = {i: collections.Counter(w) for i, w in rows.items()}
    df = collections.Counter(x for c in tf.values() for x in c)
    n, mean = len(rows), sum(map(len, rows.values())) / len(rows)
    got = collections.defaultdict(list)
    for r in bm25.search(d, q).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for i in range(0, 90, 10):
        if not rows.get(i):
            assert i not in got
            continue
        score = {}
        for j, c in tf.items():
            s = sum(m * math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * len(rows[j]) / mean)) for x, m in tf[i].items() if x in c)
            if s > 0:
                score[j] = s
        want = sorted(score.values(), reverse=True)[:10]
        assert np.allclose([s for _, s in got[i]], want, atol=1e-6)
        assert all(abs(score[j] - s) < 1e-6 for j, s in got[i])
    assert bm25.search(none, none.select(F.col("doc_id").alias("query_id"), "text")).count() == 0
