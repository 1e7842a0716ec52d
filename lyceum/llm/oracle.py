"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

from lyceum.llm import decontaminate, lines

_BLANK = r"[ \t\n\v\f\r]+"


def line_dedup(min_sites: int = lines.MIN_SITES) -> str:
    return f"""
    WITH l AS (
      SELECT doc_id, source, t.line, t.i - 1 AS i
      FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS t(line, i)
    ), spread AS (
      SELECT trim(line) AS k, count(DISTINCT source) AS sites, min((doc_id, i)) FILTER (doc_id IS NOT NULL) AS first
      FROM l WHERE trim(line) <> '' GROUP BY ALL
    ), marked AS (
      SELECT l.doc_id, l.line, l.i,
             coalesce(s.sites >= {min_sites} AND (l.doc_id, l.i) <> s.first, FALSE) AS gone
      FROM l LEFT JOIN spread s ON trim(l.line) = s.k
    )
    SELECT doc_id, (count(*) FILTER (trim(line) <> ''))::INT AS n_lines, (count(*) FILTER (gone))::INT AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
    FROM marked GROUP BY doc_id"""


def contained_items(containment: float = decontaminate.CONTAINMENT, n: int = decontaminate.WORDS) -> str:
    def grams(table: str, key: str, sizes: str) -> str:
        return f"""
        SELECT DISTINCT {key}, list_slice(w, i, i + s - 1) AS g FROM (
          SELECT {key}, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM (
            SELECT {key}, w, {sizes} AS s FROM (
              SELECT {key}, [x FOR x IN string_split_regex(lower(text), '{_BLANK}') IF x <> ''] AS w FROM {table}))
          WHERE s > 0)"""

    return f"""
    WITH items AS ({grams('benchmark', 'item_id', f'least(len(w), {n})')}),
    docs AS ({grams('documents', 'doc_id', f'unnest(range(1, {n + 1}))')}),
    q AS (SELECT item_id, count(*) AS n_grams FROM items GROUP BY item_id)
    SELECT doc_id, item_id, n_grams, count(*) AS n_found, count(*) / n_grams AS containment
    FROM docs JOIN items USING (g) JOIN q USING (item_id)
    GROUP BY doc_id, item_id, n_grams HAVING count(*) >= ceil({containment} * n_grams - 1e-9)"""


ORACLE = {
    "op7_line_dedup": line_dedup(),
    "op4_decontamination": contained_items(),
}


def host_verdicts() -> str:
    from lyceum.llm import reputation as r

    suffixes = ", ".join(f"'{s}'" for s in r.SUFFIXES)
    name = r"regexp_extract(host, '^(?:[^@]*@)?([^:]*)', 1)"
    rules, verdicts = [], []
    for action, text in sorted(r.RULES, key=lambda x: -len(x[1])):
        host, _, rest = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')"
        rules.append(f"WHEN {fits} THEN '{text}'")
        verdicts.append(f"WHEN {fits} THEN '{action}'")

    def strength(table: str) -> str:
        return f"""(SELECT 1 / greatest(0.001::DOUBLE, least(0.5::DOUBLE, coalesce(
            sum(CASE WHEN n > 0 THEN n * pow(g / n - m, 2) - m * (1 - m) END)
            / nullif(sum(CASE WHEN n > 1 THEN (n - 1) * m * (1 - m) END), 0), 0))) - 1 FROM {table})"""

    def level(name: str, source: str) -> str:
        return f"""{name} AS (SELECT *, k * m + g AS a, k * (1 - m) + n - g AS b FROM (SELECT *, {strength(source)} AS k FROM {source}))"""

    return f"""
    WITH rest AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages
    ), split AS (
      SELECT page_id, translate(coalesce(regexp_extract(r, '^[^/?#]*', 0), ''), '{r.UPPER}', '{r.UPPER.lower()}') AS host,
             coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
    ), votes AS (
      SELECT doc_id AS page_id, (avg(quality) >= 0.5)::BIGINT AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
    ), host AS (
      SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS g,
             string_split({name}, '.') AS parts
      FROM split LEFT JOIN votes USING (page_id) GROUP BY host
    ), named AS (
      SELECT host, n, g, array_to_string(parts[-2:], '.') AS two, array_to_string(parts[-3:], '.') AS three, parts[-1] AS one FROM host
    ), keyed AS (
      SELECT host, n, g, CASE WHEN two IN ({suffixes}) THEN two ELSE one END AS suffix,
             CASE WHEN two IN ({suffixes}) THEN three ELSE two END AS domain FROM named
    ), s0 AS (
      SELECT suffix, sum(n) AS n, sum(g) AS g, (SELECT (sum(g) + 1) / (sum(n) + 2) FROM keyed) AS m FROM keyed GROUP BY suffix
    ), {level('s1', 's0')}, d0 AS (
      SELECT k.domain, k.suffix, sum(k.n) AS n, sum(k.g) AS g, any_value(a / (a + b)) AS m
      FROM keyed k JOIN s1 ON k.suffix = s1.suffix GROUP BY k.domain, k.suffix
    ), {level('d1', 'd0')}, h0 AS (
      SELECT k.host, k.n, k.g, a / (a + b) AS m FROM keyed k JOIN d1 ON k.domain = d1.domain
    ), {level('h1', 'h0')}, bounds AS (
      SELECT host, a / (a + b) AS mean, a + b + 1 AS w FROM h1
    ), judged AS (
      SELECT host, CASE WHEN least(1.0, mean + {r.Z} * sqrt(mean * (1 - mean) / w)) < {r.MIN_GOOD}
                         AND (SELECT sum(n) FROM keyed) > 0 THEN 'block' ELSE 'allow' END AS own FROM bounds
    )
    SELECT page_id, host, path, CASE {' '.join(rules)} END AS rule, CASE {' '.join(verdicts)} ELSE own END AS verdict
    FROM split JOIN judged USING (host)"""


ORACLE["op6_host_reputation"] = host_verdicts()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def set_components(share: int, n: int) -> str:
    """Links of all pairs that share a shingle, and what is reached over them."""
    return f"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
      FROM documents WHERE doc_id IS NOT NULL
    ), grams AS MATERIALIZED (
      SELECT DISTINCT doc_id, list_slice(w, i, i + {n} - 1) AS g FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
    ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
    ), edges AS MATERIALIZED (
      SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= {share} * (p.n + q.n - count(*))
    ), reach AS (
      SELECT a AS doc_id, a AS other FROM edges
      UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a
    ), least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
    FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id"""


def whole_number_clusters(k: int, rounds: int, seed: str) -> str:
    """Every round written out."""
    parts = [
        """kept AS MATERIALIZED (
      SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)""",
        f"""c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), v) - 1 AS c, v FROM kept
      QUALIFY row_number() OVER (ORDER BY sha256('{seed}' || vec_id), v) <= {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
      SELECT vec_id, k.v, min((list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(k.v, c.v)])::BIGINT, c)) AS m
      FROM kept k CROSS JOIN c{r} c GROUP BY vec_id, k.v)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
      SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (
        SELECT c, list(x ORDER BY i) AS v FROM (
          SELECT m[2] AS c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
          FROM (SELECT m, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY m[2], i) GROUP BY c) n ON n.c = c.c)""")
    return f"""
    WITH {', '.join(parts)}
    SELECT vec_id, m[2]::INT AS cluster, m[1] AS distance, sum(m[1]) OVER (PARTITION BY m[2])::BIGINT AS cluster_inertia,
           sum(m[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} c ON c.c = m[2]"""


def ranked_documents(top: int) -> str:
    def terms(table: str, key: str) -> str:
        return f"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM {table}"""

    return f"""
    WITH d AS MATERIALIZED ({terms('documents', 'doc_id')} WHERE doc_id IS NOT NULL),
    q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(t) AS t FROM ({terms('benchmark', 'item_id')})) GROUP BY ALL),
    total AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
    tf AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d) GROUP BY ALL),
    w AS (SELECT t, floor(1000 * ln((2 * any_value(total.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t),
    scored AS (
      SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * tf.n * total.n) // total.l))))::BIGINT AS score
      FROM q JOIN tf USING (t) JOIN w USING (t), total GROUP BY item_id, doc_id)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= {top}"""


def _newer() -> dict[str, str]:
    from lyceum.llm import centroids, lexical, setsketch

    return {
        "op11_setsketch_dedup": set_components(setsketch.SHARE, setsketch.WORDS),
        "op12_centroid_clustering": whole_number_clusters(centroids.CENTROIDS, centroids.ROUNDS, centroids.SEED),
        "op13_lexical_search": ranked_documents(lexical.TOP),
    }


ORACLE |= _newer()
