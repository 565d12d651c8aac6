"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS ln, unnest(range(len(l))) AS i FROM cut),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM lines WHERE trim(ln, {_BLANK}) <> ''),
x AS (SELECT *, lead(ln) OVER (PARTITION BY doc_id ORDER BY p) AS nx FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY ln ORDER BY doc_id, p) AS n1, CASE WHEN nx IS NOT NULL THEN row_number() OVER (PARTITION BY ln, nx ORDER BY doc_id, p) END AS n2 FROM x),
g AS (SELECT doc_id, i, (n1 > 1 AND length(ln) - length(replace(ln, ' ', '')) >= 49) OR coalesce(n2 > 1, false) OR coalesce(lag(n2) OVER (PARTITION BY doc_id ORDER BY p) > 1, false) AS gone FROM f),
pairs AS (SELECT a.doc_id AS d, a.p, b.doc_id AS e, a.p - b.p AS diag FROM w a JOIN w b ON a.ln = b.ln AND (a.doc_id <> b.doc_id OR a.p <> b.p)),
runs AS (SELECT d, e, diag, p - row_number() OVER (PARTITION BY d, e, diag ORDER BY p) AS run FROM pairs),
longest AS (SELECT d, max(n) AS longest FROM (SELECT d, count(*) AS n FROM runs GROUP BY d, e, diag, run) GROUP BY d),
rest AS (SELECT lines.doc_id, count(g.i) AS n_lines, count(*) FILTER (g.gone) AS n_removed, coalesce(string_agg(ln, chr(10) ORDER BY lines.i) FILTER (g.gone IS NULL OR NOT g.gone), '') AS text FROM lines LEFT JOIN g ON g.doc_id = lines.doc_id AND g.i = lines.i GROUP BY 1)
SELECT rest.doc_id, n_lines, n_removed, coalesce(longest, 0) AS longest_repeat, CASE WHEN documents.text IS NOT NULL THEN md5(rest.text) END AS text_md5 FROM rest JOIN documents ON documents.doc_id = rest.doc_id LEFT JOIN longest ON longest.d = rest.doc_id
"""

OP7 = """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.i <> q.i),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _share(children: str, family: str, order: str, out: str) -> str:
    """Common table expressions that share each family's given budget among its children by weight and capacity."""
    by = f"(PARTITION BY {family} ORDER BY CASE WHEN weight > 0 THEN (capacity::HUGEINT * 1000000) // weight END NULLS LAST, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND "
    return f"""
{out}_1 AS (SELECT *, greatest(0, least(given, sum(capacity) OVER (PARTITION BY {family})) - coalesce(sum(capacity) OVER {by} 1 PRECEDING), 0))::HUGEINT AS remains,
  (sum(weight) OVER (PARTITION BY {family}) - coalesce(sum(weight) OVER {by} 1 PRECEDING), 0))::HUGEINT AS weights FROM {children}),
{out}_2 AS (SELECT *, weights > 0 AND capacity * weights <= remains * weight AS filled FROM {out}_1),
{out}_3 AS (SELECT *, first_value(CASE WHEN NOT filled THEN remains END IGNORE NULLS) OVER {by} CURRENT ROW) AS level_remains, first_value(CASE WHEN NOT filled THEN weights END IGNORE NULLS) OVER {by} CURRENT ROW) AS level_weights FROM {out}_2),
{out} AS (SELECT * EXCLUDE (remains, weights, filled, level_remains, level_weights, given), least(CASE WHEN level_remains IS NULL THEN capacity WHEN level_weights <= 0 THEN 0 ELSE (level_remains * weight) // level_weights END, capacity)::BIGINT AS budget FROM {out}_3)"""


def op8(domains: dict[str, int], languages: dict[str, int], share: tuple[int, int], epochs: int, seed: int) -> str:
    case = lambda column, weights: "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"
    return f"""
WITH docs AS (SELECT doc_id, lang, source, 'd' || coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS INTEGER) % 4, 0) AS domain,
  coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents),
leaves AS (SELECT domain, l, s, sum(n)::BIGINT AS available, (sum(n) * {epochs})::BIGINT AS capacity, {case('domain', domains)} AS w_domain, {case('l', languages)} AS w_lang FROM docs GROUP BY domain, l, s),
langs0 AS (SELECT domain, l, sum(capacity)::BIGINT AS capacity, max(w_domain) AS w_domain, max(w_lang) AS weight FROM leaves GROUP BY domain, l),
doms0 AS (SELECT domain, 0 AS everything, sum(capacity)::BIGINT AS capacity, max(w_domain) AS weight, (SELECT (sum(n) * {share[0]} // {share[1]})::HUGEINT FROM docs) AS given FROM langs0 GROUP BY domain),
{_share('doms0', 'everything', 'domain', 'doms')},
langs1 AS (SELECT langs0.*, doms.budget::HUGEINT AS given FROM langs0 JOIN doms USING (domain)),
{_share('langs1', 'domain', 'domain, l', 'langs')},
leaves1 AS (SELECT domain, l, s, available, capacity, 1 AS weight, langs.budget::HUGEINT AS given FROM leaves JOIN (SELECT domain, l, budget FROM langs) langs USING (domain, l)),
{_share('leaves1', 'domain, l', 'domain, l, s', 'plan')},
placed AS (SELECT docs.*, budget // available AS whole, budget % available AS remains, md5('{seed}:' || (budget // available) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM docs JOIN plan USING (domain, l, s) WHERE available > 0),
so_far AS (SELECT *, sum(n) OVER (PARTITION BY domain, l, s ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM placed),
copies AS (SELECT *, whole + CASE WHEN total <= remains THEN 1 ELSE 0 END AS copies FROM so_far)
SELECT doc_id, domain, lang, source, unnest(range(copies)) AS epoch, n AS n_tokens FROM copies WHERE copies > 0
"""


def op11(k: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    """Exact while sums of squares are below 2**53, as doubles are then."""
    d = "CAST(list_inner_product(v.v, c.c) * -2 + list_inner_product(c.c, c.c) + list_inner_product(v.v, v.v) AS BIGINT)"
    out = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, embedding AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, v AS c FROM (SELECT * FROM v ORDER BY h, e LIMIT {k}))"""]
    for i in range(rounds + 1):
        out.append(f"""
d{i} AS (SELECT v.r, c.k, {d} AS d FROM v, c{i} c),
a{i} AS (SELECT r, min(d) AS d, arg_min(k, d * {k} + k) AS k FROM d{i} GROUP BY r)""")
        if i < rounds:
            out.append(f"""
x{i} AS (SELECT a.k, v.v, unnest(range(1, {dim} + 1)) AS p FROM a{i} a JOIN v ON v.r = a.r),
m{i} AS (SELECT k, list(m ORDER BY p) AS c FROM (SELECT k, p, floor(sum(v[p]) / count(*)) AS m FROM x{i} GROUP BY k, p) GROUP BY k),
c{i + 1} AS (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)""")
    return f"""WITH {",".join(out)}
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.k = a.k"""


def _op12() -> str:
    # (cost, audit) as text that sorts by cost and then audit
    add = lambda cost, letter, b: f"lpad(CAST(CAST(substr({b}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({b}, 10)"
    more = "CASE WHEN f = 3 THEN 3 ELSE 0 END"
    moves, free = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}, {0: 2, 1: 2, 2: 3, 3: 2}
    row = []
    for s in range(4):
        kept = " ".join(f"WHEN ini = '{x}' THEN {add(more, 'K', f'b{t}')}" for x, t in moves[s].items())
        keep = f"CASE {kept} ELSE '999999999' END"
        rerole = add(f"3 + {more}", "R", f"b{free[s]}")
        row.append(f"least({add(4, 'D', f'b{s}')}, CASE WHEN f IN (1, 2) THEN '999999999' ELSE least({keep}, {rerole}) END) AS r{s}")
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS own, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(name, ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS d FROM c),
damaged AS (SELECT own, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i FROM damaged),
seen AS (SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY own, role, text ORDER BY i) AS nth FROM placed),
rows AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS f,
  coalesce(lag(ini) OVER (PARTITION BY own ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM seen),
counts AS (SELECT own, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS n FROM rows GROUP BY own),
best AS (SELECT own, n AS i, '000000000' AS b0, '000000006II' AS b1, '000000003I' AS b2, '000000000' AS b3 FROM counts
  UNION ALL SELECT own, i - 1, least(r0, {add(3, 'I', f"least(r2, {add(3, 'I', 'r3')})")}), least(r1, {add(3, 'I', f"least(r2, {add(3, 'I', 'r3')})")}), least(r2, {add(3, 'I', 'r3')}), least(r3, {add(3, 'I', 'r2')})
  FROM (SELECT best.own, best.i, {", ".join(row)} FROM best JOIN rows ON rows.own = best.own AND rows.i = best.i)),
audits AS (SELECT own, CAST(substr(b0, 1, 9) AS BIGINT) AS cost, substr(b0, 10) AS audit FROM best WHERE i = 0),
letters AS (SELECT own, unnest(string_split(audit, '')) AS x, unnest(range(1, length(audit) + 1)) AS p FROM audits WHERE audit <> ''),
steps AS (SELECT *, count(*) FILTER (x <> 'I') OVER (PARTITION BY own ORDER BY p) AS i, count(*) FILTER (x <> 'D') OVER (PARTITION BY own ORDER BY p) AS e FROM letters),
made AS (SELECT s.own, s.p, s.x, s.e, rows.role, rows.text, max(CASE WHEN s.e = 1 AND s.x = 'K' AND rows.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.own) AS first FROM steps s LEFT JOIN rows ON rows.own = s.own AND rows.i = s.i WHERE s.x <> 'D'),
texts AS (SELECT own, string_agg((CASE WHEN x = 'K' THEN role WHEN (e - first) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN x = 'I' THEN '' ELSE text END), chr(10) ORDER BY p) AS t FROM made GROUP BY own)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, own FROM c) o LEFT JOIN counts ON counts.own = o.own LEFT JOIN audits ON audits.own = o.own LEFT JOIN texts ON texts.own = o.own
"""


OP12 = _op12()


def op13(rules: list[tuple[str, str]]) -> str:
    """Pages that hold no canonical link and no refresh have no aliases, so here rules decide all; the tests hold aliases against a plain version."""
    given = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in rules)
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rule, name, start) AS (VALUES {given}),
fits AS (SELECT u.r, rules.rule, rules.verdict, row_number() OVER (PARTITION BY u.r ORDER BY length(rule) DESC, length(name) DESC) AS n FROM u JOIN rules ON (u.host = rules.name OR ends_with(u.host, '.' || rules.name)) AND starts_with(u.path, rules.start))
SELECT u.page_id, u.host, u.path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict FROM u LEFT JOIN fits ON fits.r = u.r AND fits.n = 1
"""
