"""DuckDB SQL with the results of the operators that SQL can express, written over tables rather than plans."""

from __future__ import annotations

from lamina.llm import license_scan

_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x20\x09-\x0D]+"


def quality_sql(docs: str = "documents", result: str | None = None, least: int = 200) -> str:
    """The columns of op1, or those that result names, over the table docs."""
    shift = "greatest(length(bin(v)) - 6, 0)"
    result = result or "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"

    def limits(name: str, level: list[str]) -> str:
        keys = ", ".join(["rule", *level])
        return f"""{name}_sums AS (SELECT {keys}, b, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL),
        {name}_upto AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM {name}_sums),
        {name}_q AS (SELECT {keys}, min(b) FILTER (WHERE 4 * upto >= total) AS q1, min(b) FILTER (WHERE 4 * upto >= 2 * total) AS q2,
            min(b) FILTER (WHERE 4 * upto >= 3 * total) AS q3, max(total) AS total FROM {name}_upto GROUP BY {keys}),
        {name} AS (SELECT q.*, q3 + factor * greatest(q3 - q2, grain) AS high, greatest(q1 - factor * greatest(q2 - q1, grain), 0) AS low FROM {name}_q q JOIN rules USING (rule))"""

    return f"""
    WITH numbered AS (SELECT row_number() OVER () AS r, * FROM {docs}),
    texts AS (SELECT r, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM numbered),
    windows AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM texts WHERE len(w) >= 5),
    keyed AS (SELECT r, i, w[i:i+4] AS g FROM windows),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM keyed) WHERE c > 1),
    covered AS (SELECT r, count(DISTINCT i + d)::BIGINT AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS d) GROUP BY r),
    base AS (SELECT n.*, len(w)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed
        FROM numbered n JOIN texts USING (r) LEFT JOIN covered USING (r)),
    ratios AS (SELECT *, coalesce((1000 * n_symbols) // nullif(n_words, 0), 0) AS symbols, coalesce((1000 * word_chars) // nullif(n_words, 0), 0) AS word_length,
        coalesce((1000 * n_dup_lines) // nullif(n_lines, 0), 0) AS dup_lines, coalesce((1000 * n_repeat_words) // nullif(n_words, 0), 0) AS repeats FROM base),
    rules AS (SELECT * FROM (VALUES ('symbols', 6, 10), ('word_length', 12, 100), ('dup_lines', 6, 60), ('repeats', 6, 25)) v(rule, factor, grain)),
    vals AS (SELECT rule, lang, source, CASE rule WHEN 'symbols' THEN symbols WHEN 'word_length' THEN word_length WHEN 'dup_lines' THEN dup_lines ELSE repeats END AS v
        FROM ratios, rules WHERE NOT base_failed),
    sketch AS (SELECT rule, lang, source, (v >> {shift}) << {shift} AS b, count(*) AS n FROM vals GROUP BY ALL),
    {limits("c", [])},
    {limits("l", ["lang"])},
    {limits("g", ["lang", "source"])},
    languages AS (SELECT l.rule, l.lang, CASE WHEN l.total >= {least} THEN least(l.high, 2 * c.high) ELSE c.high END AS high,
        CASE WHEN l.total >= {least} THEN greatest(l.low, c.low // 2) ELSE c.low END AS low FROM l JOIN c USING (rule)),
    groups AS (SELECT g.rule, g.lang, g.source, CASE WHEN g.total >= {least} THEN least(g.high, 2 * l.high) ELSE l.high END AS high,
        CASE WHEN g.total >= {least} THEN greatest(g.low, l.low // 2) ELSE l.low END AS low FROM g JOIN languages l ON g.rule = l.rule AND g.lang IS NOT DISTINCT FROM l.lang),
    limits AS (SELECT lang, source, max(high) FILTER (WHERE rule = 'symbols') AS most_symbols, max(high) FILTER (WHERE rule = 'word_length') AS most_length,
        max(low) FILTER (WHERE rule = 'word_length') AS least_length, max(high) FILTER (WHERE rule = 'dup_lines') AS most_lines, max(high) FILTER (WHERE rule = 'repeats') AS most_repeats
        FROM groups GROUP BY lang, source),
    rated AS (SELECT r.*, NOT base_failed AND coalesce(symbols <= most_symbols AND word_length BETWEEN least_length AND most_length AND dup_lines <= most_lines AND repeats <= most_repeats, false) AS kept
        FROM ratios r LEFT JOIN limits f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source)
    SELECT {result} FROM rated"""


def line_dedup_sql(docs: str = "documents") -> str:
    """The columns of op9."""
    return f"""
    WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs}),
    lines AS (SELECT r, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM split),
    keyed AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    shared AS (SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 20 AND doc_id IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT keyed.*, coalesce(doc_id <> stays, false) AS gone FROM keyed LEFT JOIN shared USING (k))
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY r, doc_id"""


def mixing_sql(docs: str = "documents", result: str | None = None) -> str:
    """The columns of op3, or those that result names."""
    domain = "CASE coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT), 2) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'reference' ELSE 'forum' END"
    weights = [
        "CASE n.domain WHEN 'web' THEN 5 WHEN 'reference' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END",
        "CASE n.lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END",
        "1",
    ]
    levels, above = [], "tops"
    for depth, weight in enumerate(weights, 1):
        names = ["domain", "lang", "source"][:depth]
        part = f"PARTITION BY {', '.join(names[:-1])}" if depth > 1 else ""
        on = " AND ".join(f"a.{n} IS NOT DISTINCT FROM n.{n}" for n in names[:-1]) or "true"
        levels.append(f"""
        n{depth} AS (SELECT n.*, {weight} AS weight, a.budget FROM (SELECT {', '.join(names)}, sum(supply)::HUGEINT * 3 AS most FROM leaves GROUP BY {', '.join(names)}) n JOIN {above} a ON {on}),
        o{depth} AS (SELECT *, coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS used,
            (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weights FROM n{depth} WINDOW w AS ({part} ORDER BY most // weight, (most % weight) / weight, {names[-1]} NULLS FIRST)),
        f{depth} AS (SELECT *, most * weights <= (budget - used) * weight AS is_full FROM o{depth}),
        s{depth} AS (SELECT {', '.join(names)}, CASE WHEN is_full THEN most ELSE ((budget - coalesce((sum(most) FILTER (WHERE is_full) OVER ({part})), 0))::HUGEINT * weight) // ((sum(weight) FILTER (WHERE NOT is_full) OVER ({part}))::HUGEINT) END AS budget FROM f{depth})""")
        above = f"s{depth}"
    result = result or "doc_id, domain, lang, source, n_tokens, epoch"
    return f"""
    WITH ready AS (SELECT *, {domain} AS domain, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens FROM {docs}),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply FROM ready GROUP BY ALL),
    tops AS (SELECT (sum(supply) * 80 // 100)::HUGEINT AS budget FROM leaves),
    {','.join(levels)},
    plan AS (SELECT l.*, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS rest
        FROM leaves l JOIN s3 s ON l.domain IS NOT DISTINCT FROM s.domain AND l.lang IS NOT DISTINCT FROM s.lang AND l.source IS NOT DISTINCT FROM s.source),
    hashed AS (SELECT r.*, whole, rest, md5('17:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS h
        FROM ready r JOIN plan p ON r.domain IS NOT DISTINCT FROM p.domain AND r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source),
    placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM hashed),
    counted AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies FROM placed),
    chosen AS (SELECT *, unnest(range(copies::BIGINT)) AS epoch FROM counted)
    SELECT {result} FROM chosen"""


def license_sql(docs: str = "documents") -> str:
    """The columns of op8."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    templates = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in sorted(license_scan.TEMPLATES.items()))
    least = round(license_scan.LEAST_DICE * 100)
    words = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
    pairs = "SELECT {key}, w[i] || ' ' || w[i + 1] AS g, count(*) AS c FROM (SELECT *, unnest(range(1, len(w))) AS i FROM {of}) GROUP BY ALL"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {docs}),
    lines AS (SELECT r, string_split(text, chr(10)) AS l, list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: contains(p, chr(10))) AS p, text FROM docs),
    listed AS (SELECT r, CASE WHEN len(list_distinct(l)) > 1 THEN list_concat(l, p, [text]) ELSE l END AS u FROM lines),
    numbered AS (SELECT r, unnest(u) AS unit, generate_subscripts(u, 1) AS pos FROM listed),
    units AS (SELECT r, unit, min(pos) AS pos, {words('unit')} AS w FROM numbered GROUP BY r, unit),
    t AS (SELECT name, {words('body')} AS w FROM (VALUES {templates}) v(name, body)),
    tg AS ({pairs.format(key="name", of="t")}),
    near AS (SELECT r, pos, unit, units.w, name, len(units.w) - 1 + len(t.w) - 1 AS sizes FROM units JOIN t
        ON 200 * least(len(units.w) - 1, len(t.w) - 1) >= {least} * (len(units.w) - 1 + len(t.w) - 1) AND len(units.w) > 1),
    asked AS (SELECT DISTINCT r, pos, w FROM near),
    ug AS ({pairs.format(key="r, pos", of="asked")}),
    met AS (SELECT n.r, n.pos, n.unit, n.name, n.sizes, 2 * coalesce(sum(least(ug.c, tg.c)) FILTER (WHERE ug.c IS NOT NULL), 0)::BIGINT AS common
        FROM near n LEFT JOIN tg USING (name) LEFT JOIN ug ON ug.r = n.r AND ug.pos = n.pos AND ug.g = tg.g GROUP BY ALL),
    best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY r, pos ORDER BY common / sizes DESC, name) = 1),
    found AS (SELECT * FROM best WHERE 100 * common >= {least} * sizes QUALIFY row_number() OVER (PARTITION BY r, name ORDER BY common / sizes DESC, pos) = 1)
    SELECT doc_id, name AS license, common, sizes::BIGINT AS sizes, (1000000 * common // sizes)::BIGINT AS dice_ppm, sha256(unit) AS unit_sha256 FROM docs LEFT JOIN found USING (r)"""
