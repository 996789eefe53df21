"""Independent DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from statewalk.llm import license_scan, quality, secret_scan


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_sql(rules: quality.LineRules = quality.LineRules()) -> str:
    space = "[\\x20\\x09-\\x0D]"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i
              FROM (SELECT r, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS w FROM docs)),
    per_doc AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
    windows AS (SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' ||
                       lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
                FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows WHERE g IS NOT NULL)
              WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) AS t(k) GROUP BY r),
    lines AS (SELECT r, unnest(l) AS l, generate_subscripts(l, 1) AS i
              FROM (SELECT r, string_split(t, chr(10)) AS l FROM docs)),
    judged AS (SELECT r, l, i, len(list_filter(regexp_split_to_array(l, '{space}+'), lambda x: x <> '')) AS n,
                      len(regexp_split_to_array(l, '{space}+')) AS pieces,
                      length(regexp_replace(l, '{space}', '', 'g')) AS letters,
                      length(l) - length(regexp_replace(l, '[#*$%&<>{{}}~^=\\\\@_]', '', 'g')) AS decor,
                      length(l) - length(replace(replace(l, '!!', ''), '??', '')) AS doubled,
                      length(l) - length(regexp_replace(l, '[|»›•]', '', 'g')) AS seps
               FROM lines),
    line_stats AS (SELECT r, count(*) FILTER (WHERE n > 0) - count(DISTINCT l) FILTER (WHERE n > 0) AS n_dup_lines,
                     coalesce(sum(n) FILTER (WHERE NOT (
                        decor * 100 > letters * {rules.decoration_percent}
                        OR doubled * 50 > pieces * {rules.shout_percent}
                        OR seps >= {rules.navigation_separators}
                        OR regexp_matches(l, {_quoted(quality.NAVIGATION)})
                        OR (pieces <= {rules.boilerplate_words} AND regexp_matches(l, {_quoted(quality.BOILERPLATE)})))), 0)
                     AS kept_words
                   FROM judged GROUP BY r),
    base AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
                    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
                    coalesce(n_repeat_words, 0) AS n_repeat_words, kept_words
             FROM docs LEFT JOIN per_doc USING (r) LEFT JOIN covered USING (r) LEFT JOIN line_stats USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
             AND kept_words * 100 > n_words * {rules.kept_percent} AS kept
    FROM base"""


def license_sql() -> str:
    rules = ", ".join(
        f"({_quoted(r.label)}, {_quoted(r.keyword)}, {_quoted(r.pattern)}, {r.priority})"
        for r in license_scan.default_rules()
    )
    base = ", ".join(f"({_quoted(p)}, {_quoted(label)})" for p, label in license_scan.BASE)
    levels = " ".join(f"WHEN {k} THEN {v}" for k, v in license_scan.CERTAINTY.items())
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '{license_scan.SEPARATOR}'), lambda x: x <> '') AS w FROM documents),
    words AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM docs),
    ahead AS (SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2
              FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
    base AS (SELECT r, i, label FROM ahead JOIN (VALUES {base}) b(phrase, label)
             ON phrase = w || ' ' || w1 OR phrase = w || ' ' || w1 || ' ' || w2),
    per_base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
                        list(DISTINCT label) AS labels FROM base GROUP BY r),
    norm AS (SELECT r, CASE WHEN len(w) = 0 THEN '' ELSE ' ' || array_to_string(w, '  ') || ' ' END AS t FROM docs),
    hits AS (SELECT r, label, priority, rank, unnest(m) AS m, generate_subscripts(m, 1) AS k, g
             FROM (SELECT r, label, priority, row_number() OVER () AS rank, regexp_extract_all(t, pattern) AS m,
                          regexp_split_to_array(t, pattern) AS g
                   FROM norm JOIN (VALUES {rules}) v(label, keyword, pattern, priority)
                   ON contains(t, ' ' || keyword || ' ')) WHERE len(m) > 0),
    units AS (SELECT r, label, priority, rank, k, (length(m) - length(replace(m, ' ', ''))) // 2 AS n,
                     (length(g[k]) - length(replace(g[k], ' ', ''))) // 2 AS gap FROM hits),
    spans AS (SELECT r, label, priority, s, s + n AS e FROM (SELECT *, (sum(gap) OVER o + sum(n) OVER o - n)::BIGINT AS s
              FROM units WINDOW o AS (PARTITION BY r, rank ORDER BY k))),
    kept AS (SELECT DISTINCT r, label, priority FROM spans a WHERE NOT EXISTS (
                SELECT 1 FROM spans b WHERE b.r = a.r AND b.s <= a.s AND b.e >= a.e AND b.priority >= a.priority
                AND (b.s < a.s OR b.e > a.e OR b.priority > a.priority OR b.label < a.label))),
    per_kept AS (SELECT r, list(DISTINCT label) AS labels, max(CASE priority {levels} END) AS score FROM kept GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(k.labels, [])))), ',') AS labels,
           greatest(coalesce(score, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
    FROM docs LEFT JOIN per_base b USING (r) LEFT JOIN per_kept k USING (r)"""


def secret_sql() -> str:
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        parts.append(f"""SELECT r, {i} AS kind, '{r.kind}' AS name, {str(r.base).lower()} AS base, {r.least} AS least,
            regexp_extract_all(t, {_quoted(r.pattern)}) AS m, regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) AS p,
            regexp_split_to_array(t, {_quoted(r.pattern)}) AS g FROM docs""")
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    hits AS (SELECT r, kind, name, base, least, unnest(m) AS m, unnest(p) AS p, generate_subscripts(m, 1) AS k, g
             FROM ({" UNION ALL ".join(parts)})),
    placed AS (SELECT *, (sum(length(g[k])) OVER o + sum(length(m)) OVER o - length(m))::BIGINT AS s
               FROM hits WINDOW o AS (PARTITION BY r, kind ORDER BY k)),
    spans AS (SELECT r, kind, name, base, s, name || ':' || s || ':' || (s + length(m)) AS span FROM placed
              WHERE length(p) >= least),
    per_doc AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
                       count(*) FILTER (WHERE kind = 2) AS n_hex,
                       string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE base) AS base_spans,
                       string_agg(span, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN per_doc USING (r)"""


def jaccard_sql(n: int = 3, percent: int = 90) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array({lower}, '[\x20\x09-\x0D]+'),
                                                       lambda x: x <> '') AS w FROM documents),
    grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {n - 1}], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
               GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
              WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reached AS (SELECT doc_id, doc_id AS other FROM documents
                UNION SELECT r.doc_id, b.b FROM reached r JOIN arcs b ON r.other = b.a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)"""


def vectors_sql(cosine: float = 0.98) -> str:
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
             AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
              AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
    reached AS (SELECT vec_id, vec_id AS other FROM v
                UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
    comps AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
    counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM comps LEFT JOIN counts USING (vec_id)"""


def url_sql(rules) -> str:
    listed = ", ".join(f"({_quoted(r.verdict)}, {_quoted(r.host)}, {_quoted(r.path)})" for r in rules)
    return f"""
    WITH parts AS (SELECT page_id, row_number() OVER () AS r,
                     CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    urls AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    fits AS (SELECT r, max_by(v.host || v.path, length(v.host || v.path)) AS rule,
                    max_by(verdict, length(v.host || v.path)) AS verdict
             FROM urls u JOIN (VALUES {listed}) v(verdict, host, path)
             ON (u.host = v.host OR ends_with(u.host, '.' || v.host)) AND starts_with(u.path, v.path) GROUP BY r)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (r)"""


def audit_sql() -> str:
    return """
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    words AS (SELECT r, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM docs),
    first AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                     max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    flags AS (SELECT r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
                     100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 10 * length(d.t) AS c,
                     regexp_matches(d.t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e
              FROM docs d JOIN words USING (r) JOIN first f ON f.t = d.t LEFT JOIN marks USING (doc_id)),
    fails AS (SELECT r, part, good, toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([a, b, c, d, e]) AS fail FROM flags),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
               WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    out AS (SELECT o, r, min(instr(o, f)) FILTER (WHERE fail) AS hit FROM orders, fails GROUP BY o, r),
    cells AS (SELECT o, part, instr(o, f) AS step, f, good, toxic, fail, coalesce(hit, 9) AS hit,
                     sum(fail::INTEGER) OVER (PARTITION BY o, r) AS n_fails
              FROM out JOIN fails USING (r)),
    sums AS (SELECT part, o AS filter_order, step, f, count(*) FILTER (WHERE hit > step) AS kept, count(*) FILTER (WHERE hit = step) AS removed,
                    count(*) FILTER (WHERE fail AND hit < step) AS redundant, count(*) FILTER (WHERE fail AND n_fails = 1) AS unique_fails,
                    count(*) FILTER (WHERE hit = step AND good = 1) AS good_lost, count(*) FILTER (WHERE hit = step AND toxic = 1) AS toxic_lost
             FROM cells GROUP BY part, o, step, f)
    SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM sums"""


def leaks_sql(window: int = 10) -> str:
    def words(table: str, key: str) -> str:
        return f"""SELECT row_number() OVER () AS r, {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
            lambda x: x <> '') AS w FROM {table}"""

    return f"""
    WITH docs AS ({words("documents", "doc_id")}), items AS ({words("benchmark", "item_id")}),
    sized AS (SELECT item_id, w, least(len(w), {window}) AS n FROM items WHERE len(w) > 0),
    wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
             FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
    lengths AS (SELECT DISTINCT n FROM wins),
    places AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, lengths WHERE len(w) >= n),
    hits AS (SELECT r, i, p.n, item_id FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM places) p
             JOIN wins USING (n, g)),
    covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, range({window}) AS t(k) WHERE k < n GROUP BY r),
    found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
              FROM hits GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""


def oracle(url_rules=()) -> dict[str, str]:
    return {
        "op1_ngram_jaccard": jaccard_sql(),
        "op4_embedding_near_dedup": vectors_sql(),
        "op6_url_filters": url_sql(url_rules),
        "op8_quality_rules": quality_sql(),
        "op9_license_scan": license_sql(),
        "op10_secret_scan": secret_sql(),
        "op11_filter_audit": audit_sql(),
        "op13_decontamination": leaks_sql(),
    }
