"""The ordered typography and OCR-repair rules, as column expressions.

A container (a paragraph, title, verse, cell) is an array of text runs. Rules of scope "run" look at one run; those of scope
"container" see all runs of a container and carry state over their edges. A and B rules change the text where they are enabled and
are skipped where they aren't; C rules report in any case and change the text only where enabled, some never.

Every rule is native: a regular expression, or a fold over characters for quotes. Texts are columns of array<string>.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
NBSP = chr(0xA0)
SHORT_WORDS = "в во на по за до из изо от ото об обо о у к ко с со и а но да или не ни же бы ли то что как для при под над без".split()
UNITS = "кг г т ц мг км м см мм л мл руб р коп ч мин сек с тыс млн млрд в".split()
ABBREVIATIONS = "т тт см напр рис табл стр гл ср им г гг в вв до н э п пп др проч ул д кв".split()
SUSPENDED = "и или либо ни да а но".split()
CHAPTER_WORDS = "глава часть том книга пролог эпилог приложение".split()
LATIN, CYRILLIC = "aceopxykiABCEHKMOPTXY", "асеорхукіАВСЕНКМОРТХУ"
DIGITS, DIGIT_LETTERS = "036", "озб"
HEADING_LABEL = "‹заголовок›"

SPACES = "[ \\x{00A0}]"
TRIMMED = " \t\r\n"


@dataclass(frozen=True)
class Rule:
    """pattern: what a finding spans, in Java's dialect; replacement: of it, with $1, $2 for groups. before and after: what
    the finding shows, where that isn't the span and its replacement."""

    id: str
    name: str
    category: str
    level: str
    pattern: str = ""
    replacement: str = ""
    scope: str = "run"
    before: str | None = None
    after: str | None = None
    bare: str = ""  # pattern for the span alone, where `pattern` looks around it
    spans: str = ""  # pattern of the matches that change, where most don't
    hint: str = ""  # what stands in every text that the rule finds something in, where that is told much sooner than by the pattern
    needs: tuple[str, ...] = ()  # of these one stands in every text that the rule changes or finds something in
    near: int = 0  # the hint stands in so many characters at the text's beginning
    mutates: bool = True
    further: tuple[tuple[str, str], ...] = ()  # applied after the first, one after the other
    in_place: bool = False  # contexts show what the rule has changed before the span; lengths stay
    may_stay: bool = False  # some spans are replaced by themselves

    @property
    def passes(self) -> tuple[tuple[str, str], ...]:
        return ((self.pattern, self.replacement), *self.further)


_units_long = "|".join(sorted((u for u in UNITS if len(u) > 1), key=len, reverse=True))
_units_short = "|".join(u for u in UNITS if len(u) == 1)
_word = r"[\x{0400}-\x{0481}\p{L}\p{Nd}]"  # most letters are told by the range
#: By their first letters, so that few of them are tried.
_short = "|".join(f"{c}(?:{'|'.join(w[1:] for w in SHORT_WORDS if w[0] == c)})" for c in dict.fromkeys(w[0] for w in SHORT_WORDS))
#: A line of speech begins in so many characters, if it does.
SPEECH = 100

#: Names, patterns and replacements. In the order of their execution. Where a pattern looks behind over a distance, it does so after its first character has matched: at every
#: other place it would look in vain.
STEPS: tuple[Rule, ...] = (
    Rule("ctrl-clean", "Невидимые/битые символы", "ocr", "A", r"[[^ -~\x{0400}-\x{04FF}]&&[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{00AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{FFFD}]]", ""),
    Rule("sp-ws", "Лишние пробелы и переносы", "spacing", "A", r"[ \t\r\n]+", " ", spans=r"[\t\r\n][ \t\r\n]*| [ \t\r\n]+", needs=("  ", "\t", "\r", "\n")),
    Rule("dehyph", "Склейка переноса слова", "ocr", "B", r"(?<!\p{L})(\p{L}++)-[ \t\r\n]+(\p{Ll}\p{L}*)", "$1$2", scope="dictionary", hint=r"-(?<=\p{L}-)[ \t\r\n]", needs=("-",)),
    Rule("quotes", "Кавычки-ёлочки «…»", "typography", "B", scope="container"),
    Rule("dash-multi", "Двойной/тройной дефис → тире", "typography", "A", r"-{2,}", "—", needs=("--",)),
    Rule("ell-dots", "Три точки → многоточие", "typography", "A", r"\.{3,}", "…", needs=("...",)),
    Rule("ell-spaced", "Растянутое многоточие → …", "typography", "A", r"\.(?:[ \x{00A0}]*\.){2,}", "…"),
    Rule("dialog-dash", "Тире в начале реплики", "typography", "B", r"[-–−](?<=\A[ \x{00A0}\t]{0,99}[-–−])(?=[ \x{00A0}\t])", "—", scope="first", bare="[-–−]", hint=r"\A[ \x{00A0}\t]{0,99}[-–−]", near=SPEECH),
    Rule("dialog-dash-glue", "Пробел после тире реплики", "typography", "B", r"[-–—−](?<=\A[ \x{00A0}\t]{0,99}[-–—−])(?=\p{L})", "— ", scope="first", bare="[-–—−]", hint=r"\A[ \x{00A0}\t]{0,99}[-–—−]", near=SPEECH),
    Rule("sp-before-punct", "Пробел перед знаком препинания", "spacing", "A", r"[ \x{00A0}]+([,.;:!?…)»\]“])", "$1"),
    Rule("sp-bracket", "Пробелы внутри скобок и кавычек", "spacing", "A", r"([(\[«„])[ \x{00A0}]+", "$1", needs=("(", "[", "«", "„")),
    Rule("sp-after-punct", "Нет пробела после знака", "spacing", "A", r"([,;:!?])(\p{L})", "$1 $2"),
    Rule("dash-hyphen", "Дефис между пробелами → тире", "typography", "A", " - ", " — ", needs=(" - ",)),
    Rule("dash-range", "Числовой диапазон через тире", "typography", "B", r"(\p{Nd}(?<!\p{Nd}-{0,64}\p{Nd})\p{Nd}{0,3})-(\p{Nd}{1,4})(?!\p{Nd}|-+\p{Nd}|-*\p{L})", "$1–$2", bare=r"(\p{Nd}+)-(\p{Nd}+)", in_place=True, needs=("-",)),
    Rule("dash-endash", "Короткое тире – → длинное —", "typography", "B", " – ", " — ", needs=(" – ",)),
    Rule("quotes-apos", "Апостроф ’", "typography", "B", r"(\p{L})['\x{02BC}](\p{L})", "$1’$2", needs=("'", chr(0x2BC))),
    Rule("sym-copy", "(c) → ©", "typography", "A", r"\([cC]\)", "©", needs=("(c)", "(C)")),
    Rule("sym-reg", "(r) → ®", "typography", "A", r"\([rR]\)", "®", needs=("(r)", "(R)")),
    Rule("sym-tm", "(tm) → ™", "typography", "A", r"\([tT][mM]\)", "™", needs=("(t", "(T")),
    Rule("dup-comma", "Двойная запятая", "punctuation", "A", r",{2,}", ",", needs=(",,",)),
    Rule("nbsp-init", "Неразрывный пробел в инициалах", "typography", "B", r"(\p{Lu}\.)[ \x{00A0}]+(\p{Lu}\.)", f"$1{NBSP}$2", may_stay=True),
    Rule(
        "nbsp-abbr", "Неразрывный пробел в сокращениях", "typography", "B", r"(?iu)(т)\.[ \x{00A0}]+(д|п|е|к|н|о)\.", f"$1.{NBSP}$2.",
        may_stay=True, hint=r"\.[ \x{00A0}]+\p{L}\.", further=((r"(?iu)(н)\.[ \x{00A0}]+(э)\.", f"$1.{NBSP}$2."), (r"(?iu)(и)\.[ \x{00A0}]+(о)\.", f"$1.{NBSP}$2.")),
    ),
    Rule("nbsp-prep", "Неразрывный пробел после предлогов", "typography", "B", rf"(?iu)(?<!{_word})(?=[^ ]{{1,{max(map(len, SHORT_WORDS))}}} )({_short}) (?={_word})", f"$1{NBSP}", before=" ", after=NBSP, in_place=True),
    Rule("nbsp-num", "Неразрывный пробел с числами", "typography", "B", r"([0-9])[ \x{00A0}]+([%\x{2030}\x{00B0}\x{20BD}])|(\x{2116})[ \x{00A0}]+([0-9])", f"$1$3{NBSP}$2$4", may_stay=True, needs=("%", chr(0x2030), "°", chr(0x20BD), "№")),
    Rule(
        "nbsp-units", "Неразрывный пробел с единицами", "typography", "B", rf"(?iu)(\p{{Nd}}) ((?:{_units_long})|(?:{_units_short})(?=\.))(?!{_word})", f"$1{NBSP}$2",
        before=" ", after=NBSP, in_place=True,
    ),
    Rule("nbsp-dash", "Неразрывный пробел перед тире", "typography", "B", r"([^ \t\n\f\r\x{00A0}])[ ]+(\x{2014})", f"$1{NBSP}$2", needs=(" —",)),
    Rule("ell-two", "Две точки → многоточие?", "typography", "C", r"\.(?<![.?!]\.)\.(?!\.)", "…", bare=r"\.\.", needs=("..",)),
    Rule(
        "dot-space", "Пропущен пробел после точки", "punctuation", "C", rf"(\p{{Ll}})\.(?=\p{{Lu}})(?<=\p{{L}}\p{{Ll}}\.)(?<!(?iu:(?<!\p{{L}})(?:{'|'.join(ABBREVIATIONS)})\.))(\p{{Lu}})", "$1. $2",
        bare=r"(\p{Ll})\.(\p{Lu})",
    ),
    Rule("mixed-alpha", "Смешанный алфавит (лат/кир)", "ocr", "C", r"(?<!\p{L})(?=\p{L}*[A-Za-z])(?=\p{L}*\p{IsCyrillic})\p{L}+", mutates=False, may_stay=True, hint=r"[A-Za-z](?:(?=[\p{L}&&[^A-Za-z]])|(?<=[\p{L}&&[^A-Za-z]][A-Za-z]))"),
    Rule("ocr-digit", "Цифра вместо буквы в слове", "ocr", "C", rf"(?<!{_word})(?={_word}*[036])(?={_word}*\p{{IsCyrillic}}){_word}+", mutates=False, may_stay=True, hint=r"\p{Nd}(?:(?=\p{L})|(?<=\p{L}\p{Nd}))"),
)
#: On whole paragraphs, after all steps.
BLOCK_RULES: tuple[Rule, ...] = (
    Rule("page-number", "Номер страницы (OCR)", "structure", "C", scope="block", mutates=False),
    Rule("heading-detect", "Похоже на заголовок", "structure", "C", scope="block", mutates=False),
)
CATALOG = (*STEPS, *BLOCK_RULES)
BY_ID = {r.id: r for r in CATALOG}
DEFAULT = frozenset(r.id for r in STEPS if r.level != "C")


def literal(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with `name` bound to value: evaluated once, where a lambda would evaluate what it captures again and again."""
    return f"transform(array({value}), {name} -> {body})[0]"


# --- text ---


def replaced(rule: Rule, x: str) -> str:
    """SQL: x, a variable, after the rule."""
    own = x
    for pattern, replacement in rule.passes:
        x = f"regexp_replace({x}, {literal(pattern)}, {literal(replacement)})"
    return hinted(rule, own, x, own)


def hinted(rule: Rule, x: str, some: str, none: str) -> str:
    """SQL: some, or none where the rule's hint tells that it finds nothing in x."""
    of = f"left({x}, {rule.near})" if rule.near else x
    told = ["(" + " or ".join(f"contains({x}, {literal(n)})" for n in rule.needs) + ")"] if rule.needs else []
    told += [f"{of} rlike {literal(rule.hint)}"] if rule.hint else []
    return f"if({' and '.join(told)}, {some}, {none})" if told else some


_OPENERS = "([{<«„—–-/*"
#: Stands between runs while a whole container is folded; a private character that changes no state.
EDGE = chr(0xE000)
#: Stands around matches while a text is cut at them.
MARK = chr(0xE001)
#: Stands for quotes that open while a container's nesting is looked at.
OPEN = chr(0xE002)
_QUOTE = "[\"«„»“]"
#: A straight quote opens after what openers and blanks are, at the container's beginning, and after another one that does; edges between runs don't count.
_OPENING = rf"""(?=["{EDGE}])(?:\G|(?<=[\s\x{{0085}}\p{{Z}}(\[{{<«„—–\-/*]))({EDGE}*+)\""""
_NESTED = f"""[«„{OPEN}][^"»“«„{OPEN}]*+[«„{OPEN}]"""
_QUOTE_TOKENS = "[^\"«„»“]*[\"«„»“]|[^\"«„»“]+\\z"


def _quotes_fold(x: str) -> str:
    """SQL: x with straight quotes turned by nesting. The fold goes over the ends of pieces, each of which ends in a quote of any kind: between two
    quotes nothing matters but the last character. The state is the depth and the last emitted character."""
    own = f"replace(c, '{EDGE}', '')"
    end = f"named_struct('last', right(c, 1), 'prev', {_let('o', own, 'if(length(o) > 1, substring(o, -2, 1), null)')})"
    prev, last = "coalesce(e.prev, a.prev)", "e.last"
    opening = f"({prev} = '' or {prev} rlike '[\\\\s\\\\x{{0085}}\\\\p{{Z}}]' or instr({literal(_OPENERS)}, {prev}) > 0)"
    glyph = f"""case when {last} <> '"' then {last} when {opening} then if(a.depth > 0, '„', '«') else if(a.depth >= 2, '“', '»') end"""
    up = f"""({last} in ('«', '„') or {last} = '"' and {opening})"""
    down = f"""({last} in ('»', '“') or {last} = '"' and not {opening})"""
    glyphs = f"""aggregate(transform(s, c -> {end}), named_struct('depth', 0, 'prev', '', 'out', cast(array() as array<string>)),
      (a, e) -> named_struct(
        'depth', case when {up} then a.depth + 1 when {down} then greatest(a.depth - 1, 0) else a.depth end,
        'prev', {glyph},
        'out', array_append(a.out, {glyph})),
      a -> a.out)"""
    return _let("s", f"regexp_extract_all({x}, {literal(_QUOTE_TOKENS)}, 0)", f"array_join(zip_with(s, {glyphs}, (c, g) -> concat(left(c, length(c) - 1), g)), '')")


def quotes(runs: str) -> str:
    """SQL: the container's runs after the quotes rule. Which way a quote turns is told by what stands before it; the depth is folded only where quotes open inside others."""
    joined = f"array_join({runs}, '{EDGE}')"
    plain = f"replace(replace(y, '{OPEN}', '«'), '\"', '»')"
    turned = _let("x", joined, _let("y", f"regexp_replace(x, {literal(_OPENING)}, '$1{OPEN}')", f"if(contains(x, '{OPEN}') or y rlike {literal(_NESTED)}, {_quotes_fold('x')}, {plain})"))
    return f"""if(exists({runs}, r -> contains(r, '"')), split({turned}, '{EDGE}', -1), {runs})"""


def trim(runs: str) -> str:
    """SQL: leading blanks of the first run and trailing ones of the last go."""
    chars = "' \\t\\r\\n'"
    return f"transform({runs}, (r, i) -> if(i = 0, ltrim({chars}, if(i = size({runs}) - 1, rtrim({chars}, r), r)), if(i = size({runs}) - 1, rtrim({chars}, r), r)))"


def first_run(rule: Rule, runs: str) -> str:
    return f"transform({runs}, (r, i) -> if(i = 0, {replaced(rule, 'r')}, r))"


def step(rule: Rule, runs: str) -> str:
    """SQL: array<string> after a step that changes the text."""
    if rule.scope == "container":
        return quotes(runs)
    if rule.scope == "first":
        return first_run(rule, runs)
    return f"transform({runs}, r -> {replaced(rule, 'r')})"


# --- findings ---

#: Characters shown at either side of a finding.
CONTEXT = 12
FINDING = "array<struct<run_ord:int,match_ord:int,before:string,after:string,context:string,level:string>>"


def _changed(rule: Rule, m: str) -> tuple[str, str]:
    """SQL: what the finding shows before and after, for the span m."""
    if rule.before is not None:
        return literal(rule.before), literal(rule.after or "")
    if rule.id == "mixed-alpha":
        cyr = f"length(regexp_replace({m}, '[^\\\\p{{IsCyrillic}}]', ''))"
        lat = f"length(regexp_replace({m}, '[^A-Za-z]', ''))"
        return m, f"if({cyr} >= {lat}, translate({m}, '{LATIN}', '{CYRILLIC}'), translate({m}, '{CYRILLIC}', '{LATIN}'))"
    if rule.id == "ocr-digit":
        cyr = f"length(regexp_replace({m}, '[^\\\\p{{IsCyrillic}}]', ''))"
        digits = f"length(regexp_replace({m}, '[^\\\\p{{Nd}}]', ''))"
        return m, f"if({cyr} >= 2 and {cyr} >= {digits}, translate({m}, '{DIGITS}', '{DIGIT_LETTERS}'), {m})"
    return m, f"regexp_replace({m}, {literal(rule.bare or rule.pattern)}, {literal(rule.replacement)})"


def _pieces(x: str, pattern: str) -> str:
    """SQL: x cut into what stands between matches, and the matches: the one at even places, the other at odd ones. The text is looked through once,
    matches are marked and cut out; a text that holds the mark itself is looked through twice."""
    marked = f"regexp_replace({x}, {literal(pattern)}, '{MARK}$0{MARK}')"
    apart = f"flatten(zip_with(split({x}, {literal(pattern)}, -1), regexp_extract_all({x}, {literal(pattern)}, 0), (g, m) -> if(m is null, array(g), array(g, m))))"
    return f"if(instr({x}, '{MARK}') > 0, {apart}, split({marked}, '{MARK}', -1))"


def _spans(x: str, pattern: str, before: str, after: str, run: str, level: str, keep: str = "f.before <> f.after", seen: str = "t.m", extra: str = "''") -> str:
    """SQL: a finding for each match of the pattern in x. before and after may use the match, its number (from 0) and what `extra` makes of x, as t.m,
    t.k and t.z. seen: the match as contexts of later ones show it."""
    before, after, level = (v.replace("t.m", "t.p[2 * k + 1]").replace("t.k", "k") for v in (before, after, level))
    # Of a piece only its ends can be in a context, and of pieces no more than stand in so many characters, as matches aren't empty.
    n = CONTEXT
    left_ = f"if(length(t.tails[2 * k]) = {n}, t.tails[2 * k], right(array_join(slice(t.tails, greatest(2 * k + 1 - {2 * n}, 1), least(2 * k + 1, {2 * n + 1})), ''), {n}))"
    right_ = f"if(length(t.heads[2 * k + 2]) = {n}, t.heads[2 * k + 2], left(array_join(slice(t.heads, 2 * k + 3, {2 * n + 1}), ''), {n}))"
    row = f"named_struct('run_ord', {run}, 'match_ord', k, 'before', {before}, 'after', {after}, 'context', concat({left_}, '⟦', t.p[2 * k + 1], '⟧', {right_}), 'level', {level})"
    rows = f"filter(transform(sequence(0, cast(size(t.p) div 2 as int) - 1), k -> {row}), f -> {keep})"
    shown = "q" if seen == "t.m" else f"if(i % 2 = 1, {seen.replace('t.m', 'q')}, q)"
    ends = f"named_struct('p', p, 'tails', transform(p, (q, i) -> right({shown}, {n})), 'heads', transform(p, q -> left(q, {n})), 'z', {extra})"
    return _let("p", _pieces(x, pattern), f"if(size(p) > 1, {_let('t', ends, rows)}, cast(array() as {FINDING}))")


def run_findings(rule: Rule, x: str, run: str) -> str:
    """SQL: the findings in one run, in order; a span that the rule leaves as it is gives none."""
    out = []
    for pattern, replacement in rule.passes:
        one = Rule(rule.id, rule.name, rule.category, rule.level, pattern, replacement, before=rule.before, after=rule.after, bare=rule.bare if pattern == rule.pattern else "")
        before, after = _changed(one, "t.m")
        seen = "t.m" if not rule.in_place else after if rule.before is None else f"replace(t.m, {before}, {after})"
        out.append(_let("x", x, _spans("x", rule.spans or pattern, before, after, run, f"'{rule.level}'", seen=seen)))
        x = f"regexp_replace({x}, {literal(pattern)}, {literal(replacement)})"
    return out[0] if len(out) == 1 else f"concat({', '.join(out)})"


def quote_findings(before: str, after: str) -> str:
    """SQL: a finding for each straight quote, of runs before and after the rule; both have the same quotes, of any kind, at the same places."""
    pairs = f"zip_with({before}, {after}, (x, y) -> named_struct('x', x, 'y', y))"
    kinds = [f"regexp_extract_all(p_.{v}, {literal(_QUOTE)}, 0)" for v in "xy"]
    turned = f"filter(zip_with({kinds[0]}, {kinds[1]}, (q, g) -> if(q = '\"', g, null)), g -> g is not null)"
    return f"flatten(transform({pairs}, (p_, i_) -> {_spans('p_.x', chr(34), 't.m', 't.z[t.k]', 'i_', chr(39) + 'B' + chr(39), 'true', extra=turned)}))"


def trim_findings(before: str, after: str) -> str:
    """SQL: a finding for each end of the container that was trimmed."""
    chars = "' \\t\\r\\n'"
    first, last = f"element_at({before}, 1)", f"element_at({before}, -1)"
    left_ = f"ltrim({chars}, {first})"
    # In a container of one run the right end is trimmed after the left one.
    end = f"if(size({before}) = 1, {left_}, {last})"
    right_ = f"rtrim({chars}, {end})"

    def row(run: str, k: int, b: str, a: str) -> str:
        return f"named_struct('run_ord', {run}, 'match_ord', {k}, 'before', {b}, 'after', {a}, 'context', concat('⟦', {b}, '⟧ → ⟦', {a}, '⟧'), 'level', 'A')"

    rows = f"array({row('0', 0, first, left_)}, {row(f'size({before}) - 1', 1, end, right_)})"
    return f"if(size({before}) = 0, cast(array() as {FINDING}), filter({rows}, f -> f.before <> f.after))"


def findings(rule: Rule, before: str, after: str) -> str:
    """SQL: array of findings of a step, given the containers before and after it."""
    if rule.scope == "container":
        return quote_findings(before, after)
    if rule.scope == "first":
        return f"if(size({before}) = 0, cast(array() as {FINDING}), {run_findings(rule, f'element_at({before}, 1)', '0')})"
    return f"flatten(transform({before}, (r_, i_) -> {run_findings(rule, 'r_', 'i_')}))"


# --- how many findings, without what they show ---


def run_counts(rule: Rule, x: str) -> str:
    """SQL: how many findings the rule has in one run."""
    out, own = [], x
    for pattern, replacement in rule.passes:
        one = Rule(rule.id, rule.name, rule.category, rule.level, pattern, replacement, before=rule.before, after=rule.after, bare=rule.bare if pattern == rule.pattern else "")
        spans = f"regexp_extract_all({x}, {literal(rule.spans or pattern)}, 0)"
        if rule.may_stay:
            before, after = _changed(one, "m")
            spans = f"filter({spans}, m -> {before} <> {after})"
        out.append(hinted(rule, own, f"size({spans})", "0"))
        x = f"regexp_replace({x}, {literal(pattern)}, {literal(replacement)})"
    return " + ".join(out)


def _total(runs: str, count: str) -> str:
    return f"aggregate({runs}, 0, (a, r) -> a + {count})"


def counts(rule: Rule, before: str) -> list[tuple[str, str]]:
    """Level and SQL of the number of findings of a step, given the container before it."""
    if rule.scope == "dictionary":
        _, hanging, has = _split_words("m")
        of = lambda having: _total(before, hinted(_DEHYPH, "r", f"size(filter(regexp_extract_all(r, {literal(_DEHYPH.pattern)}, 0), m -> not {hanging} and {having}))", "0"))
        return [("B", of(has)), ("C", of(f"not {has}"))]
    if rule.scope == "container":
        return [("B", _total(before, "length(r) - length(replace(r, '\"', ''))"))]
    if rule.scope == "first":
        return [(rule.level, f"if(size({before}) = 0, 0, {run_counts(rule, f'element_at({before}, 1)')})")]
    return [(rule.level, _total(before, run_counts(rule, "r")))]


# --- words split by a hyphen ---

_DEHYPH = next(r for r in STEPS if r.id == "dehyph")
#: Stands in every run that will have a split word when invisible characters are gone.
SPLIT_SOON = rf"-{STEPS[0].pattern}*[ \t\r\n]"
SPLIT_HINT = rf"\p{{L}}{STEPS[0].pattern}*-{STEPS[0].pattern}*[ \t\r\n]"


def dictionary_form(x: str) -> str:
    return f"replace(lower({x}), 'ё', 'е')"


def _split_words(m: str) -> tuple[str, str, str]:
    """SQL: of a match the joined word, whether it is a hanging hyphen that stays, and whether the dictionary has it."""
    joined = f"regexp_replace({m}, {literal(_DEHYPH.pattern)}, '$1$2')"
    right = f"lower(regexp_extract({m}, {literal(_DEHYPH.pattern)}, 2))"
    hanging = f"{right} in ({', '.join(literal(w) for w in SUSPENDED)})"
    return joined, hanging, f"array_contains(known, {dictionary_form(joined)})"


def split_candidates(runs: str) -> str:
    """SQL: the dictionary forms that the container's split words would have."""
    joined, hanging, _ = _split_words("m")
    matches = f"filter(regexp_extract_all(r, {literal(_DEHYPH.pattern)}, 0), m -> not {hanging})"
    return f"array_distinct(flatten(transform({runs}, r -> transform({matches}, m -> {dictionary_form(joined)}))))"


def dehyph(runs: str) -> str:
    """SQL: runs with split words joined that are in the array `known`."""
    joined, hanging, has = _split_words("s.m[k]")
    piece = f"concat(s.g[k], case when k >= size(s.m) then '' when {hanging} then s.m[k] when {has} then {joined} else s.m[k] end)"
    found = f"named_struct('m', regexp_extract_all(r, {literal(_DEHYPH.pattern)}, 0), 'g', split(r, {literal(_DEHYPH.pattern)}, -1))"
    joined_up = _let("s", found, f"array_join(transform(sequence(0, size(s.g) - 1), k -> {piece}), '')")
    return f"transform({runs}, r -> {hinted(_DEHYPH, 'r', joined_up, 'r')})"


def dehyph_findings(runs: str) -> str:
    joined, hanging, has = _split_words("t.m")
    # A hanging hyphen shows no change, and so gives no finding.
    after = f"if({hanging}, t.m, {joined})"
    return f"flatten(transform({runs}, (r_, i_) -> {_spans('r_', _DEHYPH.pattern, 't.m', after, 'i_', f"if({has}, 'B', 'C')")}))"


# --- blocks ---


#: Unicode's white space.
BLANK = r"[\s\x{0085}\x{00A0}\p{Z}]"


def go_trim(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, rf"\A{BLANK}+|{BLANK}+\z", "")


def is_page_number(text: Column) -> Column:
    return go_trim(text).rlike(r"\A[0-9]{1,4}\z")


def is_heading(text: Column) -> Column:
    t = go_trim(text)
    keyword = t.rlike(rf"(?iu)\A({'|'.join(CHAPTER_WORDS)})([\t\n\f\r ]|\z)")
    capitals = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    # A long text without blanks at its ends isn't looked through.
    long = (F.length(text) > 60) & ~F.left(text, F.lit(1)).rlike(BLANK) & ~F.right(text, F.lit(1)).rlike(BLANK)
    return F.when(long, F.lit(False)).otherwise(F.length(t).between(2, 60) & ~t.rlike(r"[.!?:;,…]\z") & (keyword | capitals))


def clip(text: Column, n: int = 40) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)
