"""Findings of the third review: keys of lines, components of large groups."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from sluice.llm import common, lines


def test_keys_give_pairs_or_groups_once():
    """A key of few lines gives its pairs, a large one its lines; equal lines of a key count once."""
    key = np.array([5] * 4 + [6] * 40 + [7] + [8] * 2, dtype=np.uint64)
    h = np.array([3, -2, 9, 3, *range(100, 120), *range(100, 120), 1, 4, 4], dtype=np.int64)
    order = np.random.default_rng(1).permutation(len(key))
    blobs = lines._dealt(key[order], h[order], 3)
    assert sorted(set(blobs.column("b").to_pylist())) == [0, 1, 2]
    got = pa.Table.from_batches(lines._met(iter([blobs]))).to_pylist()
    assert sorted((r["x"], r["y"]) for r in got if r["key"] is None) == [(-2, 3), (-2, 9), (3, 9)]
    assert sorted((r["key"], r["x"]) for r in got if r["y"] is None) == [(6, x) for x in range(100, 120)]


def test_lines_compare_as_before():
    odd = ["A  b", " a\tb ", "x Y", "ΑΣ\nΣ", "İ a", "", " ", "one Two\nThree ", "\r\nq"]
    for text in odd:
        assert lines.compared_lines(text) == [lines.compared(x) for x in text.split("\n")]


def test_similar_is_exact():
    r = random.Random(3)
    one = ["".join(r.choice("abc ") for _ in range(r.randrange(1, 90))) for _ in range(300)]
    two = [x[:20] + r.choice(["", "q", "zz"]) + x[20:] for x in one]

    def grams(x: str) -> set[str]:
        return {x[k : k + lines.SHINGLE] for k in range(max(1, len(x) - lines.SHINGLE + 1))}

    want = [100 * len(grams(x) & grams(y)) >= 75 * len(grams(x) | grams(y)) for x, y in zip(one, two, strict=True)]
    assert lines.similar(one, two).tolist() == want and 0 < sum(want) < 300


def test_components_of_stars_and_paths(spark):
    r = random.Random(5)
    star = [(1_000_000, x) for x in range(100, 400)]  # its centre is its largest node
    path = [(x, x + 1) for x in range(2000, 2100)]
    wild = [(r.randrange(5000, 5400), r.randrange(5000, 5400)) for _ in range(250)]
    edges = star + path + wild + star[:5] + [(b, a) for a, b in path[:9]]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted((x.node, x.component) for x in got) == sorted((x, root(x)) for x in list(parent))
