"""The rules in DuckDB's SQL, formulated on their own: RE2 has no lookaround, so where a rule looks around, the SQL cuts a text
into tokens and what stands between, and decides token by token.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import text_rules as R

N = chr(0xA0)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# What each rule matches and puts there, in RE2's dialect.
SIMPLE = {
    "ctrl-clean": (r"[\x{0000}-\x{0008}]|\x{000B}|\x{000C}|[\x{000E}-\x{001F}]|\x{00AD}|\x{200B}|\x{200C}|\x{200D}|\x{2060}|\x{FEFF}|\x{FFFD}", ""),
    "sp-ws": (r"(?: |\t|\r|\n)+", " "),
    "dash-multi": ("--+", "—"),
    "ell-dots": (r"\.\.\.+", "…"),
    "ell-spaced": (rf"\.(?:(?: |{N})*\.)(?:(?: |{N})*\.)+", "…"),
    "sp-before-punct": (rf"(?: |{N})+(,|\.|;|:|!|\?|…|\)|»|\]|“)", r"\1"),
    "sp-bracket": (rf"(\(|\[|«|„)(?: |{N})+", r"\1"),
    "sp-after-punct": (r"(,|;|:|!|\?)(\pL)", r"\1 \2"),
    "dash-hyphen": (" [-] ", " — "),
    "dash-endash": (" [–] ", " — "),
    "quotes-apos": (r"(\pL)(?:'|ʼ)(\pL)", r"\1’\2"),
    "sym-copy": (r"\(c\)|\(C\)", "©"),
    "sym-reg": (r"\(r\)|\(R\)", "®"),
    "sym-tm": (r"(?i)\(tm\)", "™"),
    "dup-comma": (",,+", ","),
    "nbsp-init": (rf"(\p{{Lu}})\.(?: |{N})+(\p{{Lu}})\.", rf"\1.{N}\2."),
    "nbsp-num": (rf"(\d)(?: |{N})+(%|‰|°|₽)|(№)(?: |{N})+(\d)", rf"\1\3{N}\2\4"),
    "nbsp-dash": (rf"([^\s{N}]) +(—)", rf"\1{N}\2"),
}


def _replace(t: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(replacement)}, 'g')"


def _count(t: str, pattern: str, replacement: str) -> str:
    return f"len(list_filter(regexp_extract_all({t}, {q(pattern)}), lambda m: {_replace('m', pattern, replacement)} <> m))"


def _nbsp(t: str) -> str:
    return f"length({t}) - length(replace({t}, {q(N)}, ''))"


def _tokens(t: str, pattern: str, rewrite: Callable[[str, str, str], str], hit: Callable[[str, str, str], str]) -> tuple[str, str]:
    """rewrite and hit get a token, what stands before it and what after it."""
    m, g = f"regexp_extract_all({t}, {q(pattern)})", f"string_split_regex({t}, {q(pattern)})"
    one = f"list_transform(range(1, len({m}) + 1), lambda k: {{'m': ({m})[k], 'g': ({g})[k], 'h': ({g})[k + 1]}})"
    out = f"(list_reduce(list_prepend('', list_transform({one}, lambda x: x.g || CASE WHEN {hit('x.m', 'x.g', 'x.h')} THEN {rewrite('x.m', 'x.g', 'x.h')} ELSE x.m END)), lambda a, b: a || b) || ({g})[-1])"
    return out, f"len(list_filter({one}, lambda x: {hit('x.m', 'x.g', 'x.h')}))"


def _simple(pattern: str, replacement: str) -> Callable[[str], tuple[str, str]]:
    return lambda t: (_replace(t, pattern, replacement), _count(t, pattern, replacement))


def _first(pattern: str, replacement: str) -> Callable[[str], tuple[str, str]]:
    return lambda t: (f"regexp_replace({t}, {q(pattern)}, {q(replacement)})", f"CAST(regexp_matches({t}, {q(pattern)}) AS BIGINT)")


def _prep(t: str) -> tuple[str, str]:
    pattern = rf"(?i)(^|[^\p{{L}}\p{{Nd}}])({'|'.join(R.SHORT_WORDS)}) ([\p{{L}}\p{{Nd}}])"
    # A short word may follow a short word: what one match ate, the next would need.
    out = _replace(_replace(t, pattern, rf"\1\2{N}\3"), pattern, rf"\1\2{N}\3")
    return out, f"({_nbsp(out)}) - ({_nbsp(t)})"


def _units(t: str) -> tuple[str, str]:
    long = "|".join(u for u in R.UNITS if len(u) > 1)
    short = "|".join(u for u in R.UNITS if len(u) == 1)
    out = _replace(t, rf"(?i)(\p{{Nd}}) ({long})($|[^\p{{L}}\p{{Nd}}])", rf"\1{N}\2\3")
    out = _replace(out, rf"(?i)(\p{{Nd}}) ({short})\.", rf"\1{N}\2.")
    return out, f"({_nbsp(out)}) - ({_nbsp(t)})"


def _abbr(t: str) -> tuple[str, str]:
    counts = []
    for a, b in (("т", "д|п|е|к|н|о"), ("н", "э"), ("и", "о")):
        pattern = rf"(?i)({a})\.[ \x{{00A0}}]+({b})\."
        counts.append(_count(t, pattern, rf"\1.{N}\2."))
        t = _replace(t, pattern, rf"\1.{N}\2.")
    return t, " + ".join(counts)


def _range(t: str) -> tuple[str, str]:
    body = lambda m: f"rtrim({m}, '-')"
    return _tokens(
        t, r"\p{Nd}[\p{Nd}-]*",
        lambda m, g, h: f"replace({body(m)}, '-', '–') || substr({m}, length({body(m)}) + 1)",
        lambda m, g, h: rf"regexp_full_match({body(m)}, '\p{{Nd}}{{1,4}}-\p{{Nd}}{{1,4}}') AND NOT regexp_matches({h}, '^\p{{L}}')",
    )


def _two_dots(t: str) -> tuple[str, str]:
    out, n = _tokens(t, r"\.+", lambda m, g, h: "'…'", lambda m, g, h: f"length({m}) = 2 AND right({g}, 1) NOT IN ('?', '!')")
    return out, n


def _dot_space(t: str) -> tuple[str, str]:
    short = ", ".join(q(a) for a in R.ABBREVIATIONS)
    token = lambda g: rf"regexp_extract({g}, '\p{{L}}*$')"
    return _tokens(
        t, r"\.", lambda m, g, h: "'. '",
        lambda m, g, h: rf"regexp_matches({g}, '\p{{Ll}}$') AND regexp_matches({h}, '^\p{{Lu}}') AND length({token(g)}) > 1 AND lower({token(g)}) NOT IN ({short})",
    )


def _letters(m: str, of: str) -> str:
    return f"length(regexp_replace({m}, '[^{of}]', '', 'g'))"


def _mixed(t: str) -> tuple[str, str]:
    cyr, lat = _letters("m", r"\p{Cyrillic}"), _letters("m", "A-Za-z")
    after = f"CASE WHEN {cyr} >= {lat} THEN translate(m, '{R.LATIN}', '{R.CYRILLIC}') ELSE translate(m, '{R.CYRILLIC}', '{R.LATIN}') END"
    return t, rf"len(list_filter(regexp_extract_all({t}, '\p{{L}}+'), lambda m: {cyr} > 0 AND {lat} > 0 AND {after} <> m))"


def _ocr(t: str) -> tuple[str, str]:
    cyr, digits = _letters("m", r"\p{Cyrillic}"), _letters("m", r"\p{Nd}")
    return t, rf"len(list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{Nd}}]+'), lambda m: {cyr} >= 2 AND {cyr} >= {digits} AND regexp_matches(m, '[036]')))"


#: rule -> SQL of the text after it, and of the number of its findings.
ORACLE: dict[str, Callable[[str], tuple[str, str]]] = {k: _simple(*v) for k, v in SIMPLE.items()}
ORACLE |= {
    "dialog-dash": _first(r"^([ \x{00A0}\t]*)[-–−]([ \x{00A0}\t])", r"\1—\2"),
    "dialog-dash-glue": _first(r"^([ \x{00A0}\t]*)[-–—−](\p{L})", r"\1— \2"),
    "nbsp-prep": _prep, "nbsp-units": _units, "nbsp-abbr": _abbr, "dash-range": _range, "ell-two": _two_dots, "dot-space": _dot_space, "mixed-alpha": _mixed, "ocr-digit": _ocr,
}

#: The dictionary: distinct lower-case Cyrillic words of the injected texts.
DICTIONARY = r"SELECT DISTINCT replace(w, 'ё', 'е') AS word FROM (SELECT unnest(regexp_extract_all(lower(t), '\p{Cyrillic}+')) AS w FROM d) WHERE length(w) >= 2"

_SPLIT = r"(\p{L}+)-[ \t\r\n]+(\p{Ll}\p{L}*)"
_HANGING = ", ".join(q(w) for w in R.SUSPENDED)


def dehyph_ctes(source: str, name: str) -> str:
    """CTEs: `name` with doc_id, t, n_joined, n_left."""
    return f"""{name}_m AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, {q(_SPLIT)}) AS m, string_split_regex(t, {q(_SPLIT)}) AS g FROM {source}),
{name}_x AS (SELECT doc_id, k, g[k] AS g, m[k] AS m, regexp_replace(m[k], {q(_SPLIT)}, '\\1\\2') AS joined, lower(regexp_extract(m[k], {q(_SPLIT)}, 2)) IN ({_HANGING}) AS hanging
  FROM (SELECT *, unnest(range(1, len(g) + 1)) AS k FROM {name}_m)),
{name} AS MATERIALIZED (SELECT doc_id, string_agg(x.g || CASE WHEN x.m IS NULL THEN '' WHEN NOT hanging AND w.word IS NOT NULL THEN joined ELSE x.m END, '' ORDER BY k) AS t,
    count(*) FILTER (x.m IS NOT NULL AND NOT hanging AND w.word IS NOT NULL) AS n_joined, count(*) FILTER (x.m IS NOT NULL AND NOT hanging AND w.word IS NULL) AS n_left
  FROM {name}_x x LEFT JOIN dict w ON w.word = replace(lower(x.joined), 'ё', 'е') GROUP BY doc_id)"""


def quote_ctes(source: str, name: str) -> str:
    """CTEs: `name` with doc_id, t, n. The depth is a running sum that is held at zero from below."""
    space = r"[\t\n\v\f\r \x{0085}\p{Z}]"
    return rf"""{name}_c AS (SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM {source} WHERE contains(t, '"')),
{name}_p AS (SELECT *, last_value(CASE WHEN c <> '"' THEN c END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name}_c),
{name}_o AS (SELECT *, before IS NULL OR regexp_matches(before, '{space}') OR contains('([{{<«„—–-/*', before) AS opens FROM {name}_p),
{name}_s AS (SELECT *, CASE WHEN c IN ('«', '„') OR c = '"' AND opens THEN 1 WHEN c IN ('»', '“') OR c = '"' THEN -1 ELSE 0 END AS step FROM {name}_o),
{name}_r AS (SELECT *, sum(step) OVER w AS s FROM {name}_s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{name}_d AS (SELECT *, s - step - least(0, coalesce(min(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS depth FROM {name}_r),
{name}_t AS (SELECT doc_id, string_agg(CASE WHEN c <> '"' THEN c WHEN opens THEN CASE WHEN depth > 0 THEN '„' ELSE '«' END WHEN depth >= 2 THEN '“' ELSE '»' END, '' ORDER BY i) AS t,
    count(*) FILTER (c = '"') AS n FROM {name}_d GROUP BY doc_id),
{name} AS MATERIALIZED (SELECT s.doc_id, coalesce(x.t, s.t) AS t, coalesce(x.n, 0) AS n FROM {source} s LEFT JOIN {name}_t x USING (doc_id))"""


def rule_query(rule: R.Rule, source: str) -> str:
    if rule.id == "quotes":
        return f"WITH d AS ({source}), {quote_ctes('d', 'o')} SELECT doc_id, t AS out, n AS n_findings FROM o"
    if rule.id == "dehyph":
        return f"WITH d AS MATERIALIZED ({source}), dict AS MATERIALIZED ({DICTIONARY}), {dehyph_ctes('d', 'o')} SELECT doc_id, t AS out, n_joined + n_left AS n_findings FROM o"
    out, n = ORACLE[rule.id]("t")
    return f"WITH d AS ({source}) SELECT doc_id, {out} AS out, CAST({n} AS BIGINT) AS n_findings FROM d"


def pipeline_ctes(enabled, source: str) -> tuple[str, str, list[tuple[str, str, str]]]:
    """CTEs of the steps, the last one's name, and for each step (rule, level, SQL of the total of its findings)."""
    parts = [f"d AS MATERIALIZED ({source})", f"dict AS MATERIALIZED ({DICTIONARY})"]
    blank = r"' ' || chr(9) || chr(10) || chr(13)"
    parts.append(f"s0 AS MATERIALIZED (SELECT doc_id, rtrim(ltrim(t, {blank}), {blank}) AS t, CAST(ltrim(t, {blank}) <> t AS INT) + CAST(rtrim(ltrim(t, {blank}), {blank}) <> ltrim(t, {blank}) AS INT) AS n FROM d)")
    counts = [("sp-trim", "A", "SELECT sum(n) FROM s0")]
    last = "s0"
    for k, rule in enumerate(R.STEPS, 1):
        on = rule.id in enabled
        if rule.level != "C" and not on:
            continue
        name = f"s{k}"
        if rule.id == "quotes":
            parts.append(quote_ctes(last, name))
            counts.append((rule.id, "B", f"SELECT sum(n) FROM {name}"))
        elif rule.id == "dehyph":
            parts.append(dehyph_ctes(last, name))
            counts += [(rule.id, "B", f"SELECT sum(n_joined) FROM {name}"), (rule.id, "C", f"SELECT sum(n_left) FROM {name}")]
        else:
            out, n = ORACLE[rule.id]("t")
            parts.append(f"{name} AS MATERIALIZED (SELECT doc_id, {out if on and rule.mutates else 't'} AS t, {n} AS n FROM {last})")
            counts.append((rule.id, rule.level, f"SELECT sum(n) FROM {name}"))
        last = name
    return "WITH " + ",\n".join(parts), last, counts


def pipeline_text(enabled, source: str) -> str:
    ctes, last, _ = pipeline_ctes(enabled, source)
    return f"{ctes}\nSELECT doc_id, t AS out FROM {last}"


def rollup(enabled, source: str) -> str:
    ctes, _, counts = pipeline_ctes(enabled, source)
    rows = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{level}' AS level, CAST(({n}) AS BIGINT) AS count" for r, level, n in counts)
    return f"{ctes}\nSELECT * FROM ({rows}) WHERE count > 0"


def contexts(rule_id: str, source: str, columns: str = "doc_id") -> str:
    """Findings with contexts of a rule that is one expression, as a query over doc_id, t of source."""
    p, r = (q(x) for x in SIMPLE[rule_id])
    return f"""SELECT {columns}, k, m AS before, regexp_replace(m, {p}, {r}, 'g') AS after, right(left(t, place), 12) || '⟦' || m || '⟧' || left(substr(t, place + length(m) + 1), 12) AS context
FROM (SELECT doc_id, t, k, m[k] AS m, CAST(list_sum(list_transform(g[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda s: length(s))), 0) AS BIGINT) AS place
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM {source})))
WHERE regexp_replace(m, {p}, {r}, 'g') <> m"""


def context_query(rule: R.Rule, source: str) -> str:
    return f"WITH d AS ({source}) SELECT doc_id, before, after, context FROM ({contexts(rule.id, 'd')})"


def _sources(enabled) -> dict[str, str]:
    """Rule -> the CTE with the text before it."""
    out, last = {}, "s0"
    for k, rule in enumerate(R.STEPS, 1):
        if rule.level == "C" or rule.id in enabled:
            out[rule.id], last = last, f"s{k}"
    return out


def first_findings(enabled, source: str, n: int) -> str:
    """Of each document and rule of SIMPLE the first findings."""
    ctes, _, _ = pipeline_ctes(enabled, source)
    before = _sources(enabled)
    rows = " UNION ALL ".join(contexts(i, before[i], f"doc_id, '{i}' AS rule_id, '{R.BY_ID[i].category}' AS category, '{R.BY_ID[i].level}' AS level") for i in SIMPLE)
    return f"{ctes}\nSELECT doc_id, rule_id, category, level, before, after, context FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY k) <= {n}"


def findings_of(rule_id: str, enabled, source: str, n: int) -> str:
    ctes, _, _ = pipeline_ctes(enabled, source)
    return f"{ctes}\nSELECT doc_id, before, after, context FROM ({contexts(rule_id, _sources(enabled)[rule_id])}) ORDER BY doc_id, k LIMIT {n}"


def report(enabled, source: str) -> str:
    """Rules by their number of findings, with the level of the first: only a split word's depends on the word."""
    ctes, _, counts = pipeline_ctes(enabled, source)
    rows = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{level}' AS level, CAST(({n}) AS BIGINT) AS count" for r, level, n in counts)
    split = f"s{[r.id for r in R.STEPS].index('dehyph') + 1}_x"
    first = f"SELECT CASE WHEN w.word IS NULL THEN 'C' ELSE 'B' END FROM {split} x LEFT JOIN dict w ON w.word = replace(lower(x.joined), 'ё', 'е') WHERE x.m IS NOT NULL AND NOT hanging ORDER BY doc_id, k LIMIT 1"
    return f"""{ctes}, r AS (SELECT rule_id, CAST(sum(count) AS BIGINT) AS count, min(level) AS level FROM ({rows}) WHERE count > 0 GROUP BY rule_id),
f AS (SELECT rule_id, count, CASE WHEN rule_id = 'dehyph' THEN ({first}) ELSE level END AS level FROM r)
SELECT *, CASE WHEN level = 'C' THEN 'suggested' ELSE 'applied' END AS kind FROM f"""
