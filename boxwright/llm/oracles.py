"""DuckDB equivalents of the queries that SQL can express, by query name."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quality() -> str:
    measures = (("marks", 33, False), ("length", 50, True), ("lines", 200, False), ("echoes", 33, False))
    levels = []
    for depth, keys in enumerate(("", "lang, ", "lang, source, ")):
        levels.append(
            f"""r{depth} AS (SELECT {keys}measure, bin, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total
                FROM (SELECT {keys}measure, bin, sum(n) AS n FROM sk GROUP BY ALL)),
            l{depth} AS (SELECT {keys}measure, 5 * min(bin) FILTER (upto * 4 >= total) AS q1, 5 * min(bin) FILTER (upto * 4 >= total * 3) AS q3, max(total) AS n FROM r{depth} GROUP BY ALL)"""
        )
    limits = ", ".join(f"max(q3 + 3 * greatest(q3 - q1, {w})) FILTER (measure = '{k}') AS {k}_hi, max(q1 - 3 * greatest(q3 - q1, {w})) FILTER (measure = '{k}') AS {k}_lo" for k, w, _ in measures)
    beyond = " OR ".join(f"coalesce({k} > {k}_hi, false)" + f" OR coalesce({k} < {k}_lo, false)" * both for k, _, both in measures)
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, least({k} // 5, 1000) AS bin FROM m WHERE n_words > 0" for k, _, _ in measures)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents),
    c AS (SELECT rid, doc_id, lang, source, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(text) - length(regexp_replace(text, '[!?#*$%&|<>=+~^@_{{}}\[\]/\\]', '', 'g')) AS BIGINT) AS n_marks,
        CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(len(ln) AS BIGINT) AS n_lines FROM d),
    u AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda j: array_to_string(w[j:j + 7], ' '))) AS t FROM c WHERE len(w) > 8),
    k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM u),
    rep AS (SELECT rid, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM k WHERE n >= 2) GROUP BY rid),
    ech AS (SELECT rid, count(*) AS n FROM (SELECT rid, x, lag(x) OVER (PARTITION BY rid ORDER BY i) AS p FROM (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM c)) WHERE x = p GROUP BY rid),
    m AS (SELECT c.*, coalesce(rep.n, 0) AS n_repeat_words, n_marks * 1000 // nullif(n_words, 0) AS marks, word_chars * 100 // nullif(n_words, 0) AS length,
        n_dup_lines * 1000 // nullif(n_lines, 0) AS lines, coalesce(ech.n, 0) * 1000 // nullif(n_words, 0) AS echoes FROM c LEFT JOIN rep USING (rid) LEFT JOIN ech USING (rid)),
    sk AS (SELECT lang, source, measure, bin, count(*) AS n FROM ({each}) GROUP BY ALL),
    {", ".join(levels)},
    pick AS (SELECT l2.lang, l2.source, l2.measure, CASE WHEN l2.n >= 50 THEN l2.q1 WHEN l1.n >= 50 THEN l1.q1 ELSE l0.q1 END AS q1,
        CASE WHEN l2.n >= 50 THEN l2.q3 WHEN l1.n >= 50 THEN l1.q3 ELSE l0.q3 END AS q3
        FROM l2 JOIN l1 ON l2.lang IS NOT DISTINCT FROM l1.lang AND l2.measure = l1.measure JOIN l0 ON l2.measure = l0.measure),
    t AS (SELECT lang, source, {limits} FROM pick GROUP BY lang, source),
    v AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {beyond} AS beyond
        FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept FROM v
    """


op6_quality_rules = _quality()


def _secrets() -> str:
    either = lambda names: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in names.split())
    assigned = lambda names, value: f"(?:{either(names)})[\"'']?\\x20*[:=]\\x20*[\"'']?" + value
    kinds = (
        ("assign", assigned("password passwd secret token api_?key", "([A-Za-z0-9+/_.=-]+)"), 8),
        ("access", "(AKIA[A-Z0-9]{12,})", 16),
        ("hex", "([0-9a-f]{32,})", 32),
        ("id", assigned("access_?key_?id client_?id account_?id user_?name login", "([A-Za-z0-9@._-]+)"), 4),
        ("key", "([A-Za-z0-9+/]{40,})", 40),
        ("endpoint", r"((?:https?|jdbc:[a-z]+|postgresql|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9@:%._/?=&+-]+|[A-Za-z0-9.-]{1,99}\.amazonaws\.com)", 8),
    )
    mixed = "AND (kind <> 4 OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')))"
    each = " UNION ALL ".join(
        f"""SELECT rid, kind, s, e FROM (SELECT rid, {k} AS kind, v, {least} AS least, CAST(sum(g + m) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e, e - m AS s FROM
        (SELECT rid, unnest(generate_series(1, len(a))) AS i, unnest(list_transform(a, lambda x: length(x))) AS m, unnest(v) AS v, unnest(list_transform(p[:len(a)], lambda x: length(x))) AS g FROM
        (SELECT rid, regexp_extract_all(t, '{p}') AS a, regexp_extract_all(t, '{p}', 1) AS v, string_split_regex(t, '{p}') AS p FROM d) WHERE len(a) > 0)) WHERE length(v) >= least {mixed}"""
        for k, (_, p, least) in enumerate(kinds)
    )
    names = "[" + ", ".join(f"'{k}'" for k, _, _ in kinds) + "]"
    listed = f"coalesce(string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind), '')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    sp AS ({each}),
    strong AS (SELECT * FROM sp WHERE kind < 3),
    weak AS (SELECT * FROM sp WHERE kind > 2 AND NOT EXISTS (SELECT 1 FROM strong x WHERE x.rid = sp.rid AND x.s < sp.e AND x.e > sp.s)),
    parts AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
    linked AS (SELECT * FROM weak a WHERE EXISTS (SELECT 1 FROM parts b WHERE a.rid = b.rid AND a.s <= b.e + 240 AND a.e >= b.s - 240 AND (a.kind IN (3, 5)) = (b.kind IN (0, 2, 4)))),
    b AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {listed} AS base FROM strong GROUP BY rid),
    a AS (SELECT rid, {listed} AS spans FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked) GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
    """


op1_secret_scan = _secrets()


def _urls() -> str:
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = lambda u: f"regexp_extract(coalesce({u}, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
    plain = lambda p: f"""CASE WHEN contains({p}, '/.') THEN list_reduce(list_prepend('', string_split({p}, '/')[2:]),
        lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN s = '.' THEN a ELSE a || '/' || s END) || CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN '/' ELSE '' END ELSE {p} END"""
    key = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || CASE WHEN {path(u)} = '' THEN '/' ELSE {plain(path(u))} END || regexp_extract(coalesce({u}, ''), '^(?s:.*?)://[^/?#]*[^?#]*(\\?[^#]*)', 1) END"
    tags = r"<(?:[Ll][Ii][Nn][Kk]|[Mm][Ee][Tt][Aa])\s[^>]*>"
    q = "[\"'']?"
    href = f"""CASE WHEN regexp_matches(tag, '[\\s"''][Rr][Ee][Ll]\\s*=\\s*{q}[Cc][Aa][Nn][Oo][Nn][Ii][Cc][Aa][Ll]\\b') THEN regexp_extract(tag, '[\\s"''][Hh][Rr][Ee][Ff]\\s*=\\s*{q}([^"''\\s>]+)', 1)
        WHEN regexp_matches(tag, '[\\s"''][Hh][Tt][Tt][Pp]-[Ee][Qq][Uu][Ii][Vv]\\s*=\\s*{q}[Rr][Ee][Ff][Rr][Ee][Ss][Hh]\\b') THEN regexp_extract(tag, '[Uu][Rr][Ll]\\s*=\\s*{q}([^"''\\s>]+)', 1) END"""
    folder = f"regexp_replace({path('url')}, '[^/]*$', '')"
    full = f"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href WHEN starts_with(href, '/') THEN 'http://' || {host('url')} || href
        WHEN starts_with(href, '#') THEN url WHEN starts_with(href, '?') THEN 'http://' || {host('url')} || {path('url')} || href
        ELSE 'http://' || {host('url')} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || href END"""
    rules = "(VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))"
    best = "SELECT {0}, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict FROM {1} x JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path) GROUP BY {0}"
    return f"""
    WITH RECURSIVE rules(verdict, host, path) AS (SELECT * FROM {rules}),
    p AS (SELECT row_number() OVER () AS rid, page_id, {host('url')} AS host, {path('url')} AS path, {key('url')} AS k FROM pages),
    t AS (SELECT url, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?(?:-->|\\z)', ' ', 'g'), '{tags}')) AS tag FROM pages),
    h AS (SELECT url, replace({href}, '&amp;', '&') AS href FROM t),
    e AS (SELECT {key('url')} AS a, {key('full_url')} AS b FROM (SELECT url, {full} AS full_url FROM h WHERE href <> '')),
    two AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
    reach(a, b) AS (SELECT a, a FROM two UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a),
    ends AS (SELECT DISTINCT b AS k, regexp_extract(b, '^([^/?]*)', 1) AS host, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS path FROM reach),
    own AS ({best.format('rid', 'p')}),
    theirs AS ({best.format('k', 'ends')}),
    via AS (SELECT a AS k, min(verdict) AS via FROM reach JOIN theirs ON reach.b = theirs.k GROUP BY a)
    SELECT page_id, host, path, rule, coalesce(verdict, via, 'allow') AS verdict FROM p LEFT JOIN own USING (rid) LEFT JOIN via ON p.k = via.k
    """


op8_url_filter = _urls()
