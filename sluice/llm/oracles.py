"""SQL of the training-data operators that SQL can express."""

from __future__ import annotations


def centroids(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds written out, one centroid table a round."""
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, vec_id, kept.v, c, d FROM kept JOIN LATERAL (SELECT c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM c{i}) ON true
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j)""")
            steps.append(f"""n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM m{i} GROUP BY c)""")
            steps.append(f"""c{i + 1} AS (SELECT c{i}.c, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} ON n{i}.c = c{i}.c)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""


def _tree(name: str, leaves: str, levels: int) -> list[str]:
    """Levels of a forest (tree, idx, h) as tables name_0 ..; runs of siblings as name_r1 .. ."""
    out = [f"{name}_0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY ord NULLS FIRST, h) - 1 AS idx, h, count(*) OVER (PARTITION BY tree) AS n, ord FROM {leaves})"]
    for k in range(1, levels + 1):
        out.append(f"""{name}_r{k} AS (SELECT tree, idx // 8 AS idx, string_agg(h, '' ORDER BY idx) AS run FROM {name}_{k - 1} WHERE n > {8 ** (k - 1)} GROUP BY tree, idx // 8)""")
        out.append(f"""{name}_{k} AS (SELECT tree, idx, sha256(run) AS h, n FROM {name}_r{k} JOIN (SELECT tree, max(n) AS n FROM {name}_0 GROUP BY tree) USING (tree))""")
    tops = " UNION ALL ".join([f"SELECT tree, h FROM {name}_0 WHERE n = 1", *(f"SELECT tree, h FROM {name}_{k} WHERE n > {8 ** (k - 1)} AND n <= {8 ** k}" for k in range(1, levels + 1))])
    return [*out, f"{name}_top AS ({tops})"]


def manifest(levels: int = 9, langs: int = 3) -> str:
    """The trees level by level, up to 8**levels documents a lang and 8**langs langs."""
    lit = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({lit('doc_id')} || {lit('source')} || {lit('lang')} || {lit('n_chars')} || {lit(text)})"
    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""
    azlower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sib = lambda run, at: f"coalesce(substr({run}, 1, (64 * ({at}))::BIGINT) || substr({run}, (64 * ({at}) + 65)::BIGINT), '')"
    put = lambda run, at, h: f"CASE WHEN {run} IS NULL THEN {h} ELSE sha256(substr({run}, 1, (64 * ({at}))::BIGINT) || {h} || substr({run}, (64 * ({at}) + 65)::BIGINT)) END"
    steps = [
        """crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i::BIGINT, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))""",
        f"""doc AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf('text')} AS leaf, CASE WHEN coalesce({crc} % 3 = 0, false) THEN {leaf(azlower)} ELSE {leaf('text')} END AS tampered FROM documents, crc_table)""",
        "leaves AS (SELECT tree, doc_id AS ord, leaf AS h FROM doc)",
        *_tree("d", "leaves", levels),
        "subs AS (SELECT '' AS tree, tree AS ord, h FROM d_top)",
        *_tree("s", "subs", langs),
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM doc)",
    ]
    joins = [f"LEFT JOIN d_r{k} ON d_r{k}.tree = x.tree AND d_r{k}.idx = x.p // {8 ** k}" for k in range(1, levels + 1)] + [f"LEFT JOIN s_r{k} ON s_r{k}.idx = s_0.idx // {8 ** k}" for k in range(1, langs + 1)]
    at = [(f"d_r{k}.run", f"x.p // {8 ** (k - 1)} % 8") for k in range(1, levels + 1)] + [(f"s_r{k}.run", f"s_0.idx // {8 ** (k - 1)} % 8") for k in range(1, langs + 1)]
    steps.append(f"""way AS (SELECT x.doc_id, x.leaf, x.tampered, s_0.h AS subroot, (SELECT h FROM s_top) AS root, sha256({" || ".join(sib(*a) for a in at)}) AS proof_sha256,
  {", ".join(f"{run} AS run{i}, {a} AS at{i}" for i, (run, a) in enumerate(at))} FROM numbered x JOIN s_0 ON s_0.ord = x.tree {" ".join(joins)})""")
    fold = "tampered"
    for i in range(len(at)):
        steps.append(f"f{i} AS (SELECT * EXCLUDE (tampered), {put(f'run{i}', f'at{i}', 'tampered')} AS tampered FROM {f'f{i - 1}' if i else 'way'})")
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, {fold} AS folded_root, {fold} = root AS verified FROM f{len(at) - 1}"""
