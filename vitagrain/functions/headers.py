"""Section headings, line classifiers and job headers (Spark SQL expression text)."""

from __future__ import annotations

from vitagrain.functions import dates as dt
from vitagrain.functions import lexicon as lx
from vitagrain.functions import sqltext as st
from vitagrain.functions import text as tx

# Words and shapes that decide what a line is.
TITLE_KEYWORD = (
    r"(?i)\b(engineer|developer|designer|manager|lead|architect|analyst|scientist|"
    r"specialist|consultant|director|officer|administrator|intern|coordinator|"
    r"strategist|producer|writer|marketer|recruiter|accountant|technician|"
    r"president|executive|founder|owner|principal|staff|senior|junior|head|"
    r"chief|cto|ceo|cfo|coo|vp|sre|swe|devops|fullstack|full[\s-]?stack)\b"
)
DEGREE_KEYWORD = (
    r"(?i)\b(bachelor|master|phd|doctorate|associate|diploma|degree|certificate|"
    r"bsc|msc|mba|b\.a\.|m\.a\.|b\.s\.|m\.s\.)\b"
)
SCHOOL_KEYWORD = r"(?i)\b(university|college|school|institute)\b"
ACTION_VERBS = (
    "Designed|Architected|Developed|Built|Implemented|Led|Created|Owned|Managed|Improved|"
    "Optimized|Engineered|Delivered|Launched|Established|Introduced|Drove|Spearheaded|"
    "Conducted|Collaborated"
)
DUTY_START = rf"(?i)^(?:{ACTION_VERBS})\b"
DUTY_SPLIT = rf"(?i)\s+(?=(?:{ACTION_VERBS})\b)"
PAGE_NOISE = (r"(?i)^(?:[/|.\-–—]*\s*)?(?:page\s+)?\d{1,3}(?:\s*(?:of|/)\s*\d{1,3})?"
              r"(?:\s*[/|.\-–—]*)?$")
LABEL_PREFIX = r"^[A-Za-z][A-Za-z /&]{1,30}:\s*"
SEPARATOR = r"\s*[-|–—@]\s*|\s*,\s*"
PLUS_ONE = r"^\+1[\s\-]+(?=\d{5}\b)"
EDGES = " |,-–—"
WIDE_EDGES = " |/-–—,"


# --- section headings -----------------------------------------------------------
def _heading_pattern() -> str:
    labels = sorted((h for hs in lx.SECTION_HEADINGS.values() for h in hs), key=len, reverse=True)
    gap = r"[ \t:|/\-–—•·]*+"
    return (rf"(?is)^({'|'.join(labels)})(?![\p{{L}}\p{{N}}]){gap}"
            rf"((?-i:\z|\([^0-9]{{0,39}}\z|[\p{{Lu}}\p{{Nd}}(\[].*))\z")


HEADING = _heading_pattern()


def _may_open_section(line: str) -> str:
    """Hash test on the first letters; spares most lines the pattern."""
    starts = sorted({h[:5] for hs in lx.SECTION_HEADINGS.values() for h in hs})
    return f"lower(left({line}, 5)) IN ({st.items(starts)})"


def heading(line: str) -> str:
    """struct(kind, rest): section kind, null for content, and glued content."""
    kinds = " ".join(f"WHEN lower(lb) IN ({st.items(hs)}) THEN '{k}'"
                     for k, hs in lx.SECTION_HEADINGS.items())
    rest = f"regexp_extract({line}, {st.raw(HEADING)}, 2)"
    label = f"regexp_extract({line}, {st.raw(HEADING)}, 1)"
    return st.let("lb", f"CASE WHEN {_may_open_section(line)} THEN {label} ELSE '' END", (
        f"named_struct('kind', CASE WHEN lb = '' THEN NULL {kinds} END, 'rest', CASE WHEN lb = '' THEN '' "
        f"WHEN {st.matches(rest, r'^[(][^0-9]{0,39}$')} THEN '' ELSE {rest} END)"
    ))


# --- line classifiers -------------------------------------------------------------
def _flags(line: str) -> str:
    r = st.collapse(line)
    return st.let("r", r, (
        f"named_struct('r', r, 'bullet', {st.matches('r', tx.BULLET)}, "
        f"'dated', {st.matches('r', dt.FULL_RANGE)}, 'duty', {st.matches('r', DUTY_START)}, "
        f"'kw', {st.matches('r', TITLE_KEYWORD)}, 'noise', {st.matches('r', PAGE_NOISE)})"
    ))


def _is_title(m: str) -> str:
    words = f"size(filter(split(translate({m}.r, '/|&', '   '), ' '), w -> w <> ''))"
    return (f"({m}.r <> '' AND length({m}.r) <= 100 AND NOT {m}.bullet AND NOT {m}.dated "
            f"AND NOT {m}.duty AND {m}.kw AND NOT right({m}.r, 1) IN ('.', ';', ',') "
            f"AND {words} BETWEEN 2 AND 14 "
            f"AND length({m}.r) - length(replace({m}.r, ',', '')) <= 1)")


def _is_company(m: str) -> str:
    spaces = f"length({m}.r) - length(replace({m}.r, ' ', ''))"
    return (f"({m}.r <> '' AND length({m}.r) <= 60 AND NOT {m}.noise AND NOT {m}.bullet "
            f"AND NOT {m}.dated AND NOT {m}.duty AND NOT {_is_title(m)} "
            f"AND ({st.matches(f'{m}.r', r'^[^\p{Ll}]')} "
            f"OR {st.matches(f'{m}.r', r'^[a-z]{1,4}[A-Z]')}) "
            f"AND {spaces} <= 5 AND NOT right({m}.r, 1) IN ('.', ';'))")


def is_company(line: str) -> str:
    """A short employer line."""
    return st.let("mc", _flags(line), _is_company("mc"))


def without_dates(line: str, edges: str = EDGES) -> str:
    return st.strip(st.replace(line, dt.FULL_RANGE), edges)


def line_kinds(line: str) -> str:
    """struct of every classifier of one line, each test run once."""
    employer = (
        "(k.company AND (contains(m.r, ' ') OR (m.r = upper(m.r) AND m.r <> lower(m.r)) "
        f"OR {st.matches('m.r', r'^[A-Z][a-zA-Z]*[A-Z][a-zA-Z0-9]+$')} "
        f"OR ({st.matches('m.r', '^[A-Z][A-Za-z0-9&.\x27-]{1,40}$')} AND NOT m.kw)))"
    )
    basic = (f"named_struct('title', {_is_title('m')}, 'company', {_is_company('m')}, "
             f"'boundary', NOT m.noise AND m.dated AND length({line}) < 160 "
             f"AND NOT right({line}, 1) IN ('.', ';'), "
             f"'date_only', {st.matches('m.r', dt.WHOLE_RANGE)}, "
             f"'remainder', CASE WHEN m.dated THEN {st.collapse(without_dates('m.r'))} ELSE '' END)")
    company_date = f"(k.remainder <> '' AND {is_company('k.remainder')})"
    combined = (f"(k.remainder <> '' AND ({st.matches('k.remainder', TITLE_KEYWORD)} "
                f"OR contains(m.r, '|')))")
    full = st.let("emp", employer, st.let("dh", f"({company_date} OR {combined})", (
        "named_struct('line', " + line + ", 'title', k.title, 'company', k.company, "
        "'boundary', k.boundary, 'date_only', k.date_only, 'bullet', m.bullet, "
        "'employer', emp, "
        "'trailing', NOT k.boundary AND NOT m.noise AND (k.title OR emp OR "
        "(m.kw AND NOT m.bullet AND (contains(m.r, '|') OR contains(m.r, '/')))), "
        f"'continues', m.r <> '' AND length({line}) < 160 AND NOT m.bullet AND NOT m.duty AND "
        "(k.date_only OR dh OR (NOT m.dated AND (k.company OR k.title OR emp))))"
    )))
    return st.let("m", _flags(line), st.let("k", basic, full))


def is_contact(line: str) -> str:
    """A name, address, link or phone line of the header block."""
    return st.let("cl", st.strip(line), (
        f"(cl <> '' AND ({st.matches('cl', tx.EMAIL)} OR {st.matches('cl', tx.PHONE)} "
        f"OR {st.matches('cl', tx.PROFILE_HINT)} OR (contains(cl, '|') AND length(cl) < 120) "
        f"OR (contains(cl, '\\t') AND length(cl) < 80) "
        f"OR (length(cl) <= 60 AND {st.matches('cl', tx.LOCATION)}) "
        f"OR (length(cl) <= 40 AND NOT contains(cl, '.') "
        f"AND length(cl) - length(replace(cl, ' ', '')) <= 2 "
        f"AND NOT {st.matches('cl', r'\p{Nd}')})))"
    ))


def is_prose(line: str) -> str:
    """A real summary paragraph."""
    return st.let("pl", st.strip(line), (
        f"(length(pl) >= 80 AND NOT {is_contact('pl')} "
        f"AND length(pl) - length(replace(pl, ' ', '')) >= 10)"
    ))


def is_name_only(line: str) -> str:
    return st.let("nl", st.collapse(line), (
        f"(nl <> '' AND NOT contains(nl, '@') AND NOT contains(nl, ',') "
        f"AND NOT {st.matches('nl', TITLE_KEYWORD)} AND length(nl) <= 40 "
        f"AND length(nl) - length(replace(nl, ' ', '')) <= 2 "
        f"AND NOT {st.matches('nl', r'\p{Nd}')})"
    ))


# --- title and company -----------------------------------------------------------------
LAST_SLASH = r"^(.*)/\s*(.*[–—,-].*)$"
FIRST_SLASH = r"^(.*?)/\s*(.*)$"


def slash_split(value: str) -> str:
    """struct(title, company) around the slash that separates them."""
    def at(pattern: str) -> str:
        left = f"regexp_replace(regexp_extract(v, {st.raw(pattern)}, 1), '[ /]+$', '')"
        return (f"named_struct('title', trim({left}), "
                f"'company', trim(regexp_extract(v, {st.raw(pattern)}, 2)))")

    return st.let("v", st.strip(value), (
        f"CASE WHEN NOT contains(v, '/') THEN named_struct('title', v, 'company', '') "
        f"WHEN {st.matches('v', LAST_SLASH)} THEN {at(LAST_SLASH)} ELSE {at(FIRST_SLASH)} END"
    ))


def pipe_split(value: str) -> str:
    """struct(title, company), null when the text does not name both."""
    by_pipe = st.let(
        "ps", f"filter(transform(split(w, {st.raw('[|]')}), x -> trim(x)), x -> x <> '')", (
            f"CASE WHEN size(ps) < 2 THEN NULL WHEN {st.matches('element_at(ps, -1)', TITLE_KEYWORD)} "
            f"AND NOT {is_company('element_at(ps, -1)')} THEN NULL ELSE "
            f"named_struct('title', array_join(slice(ps, 1, size(ps) - 1), ' | '), "
            f"'company', element_at(ps, -1)) END"))
    return st.let("w", st.collapse(value), st.let("sl", slash_split("w"), (
        f"CASE WHEN contains(w, '/') AND sl.title <> '' AND sl.company <> '' "
        f"AND NOT {st.matches('sl.company', TITLE_KEYWORD)} THEN sl ELSE {by_pipe} END"
    )))


DANGLING_NUMBER = r"\s*/\s*(\d{2,5})\s*$"


def _sides(lines: str) -> str:
    """struct(v, kw, company, piped) of each content line, dates removed."""
    return (
        f"transform({lines}, x -> " + st.let("dv", st.collapse(without_dates("x")), (
            f"named_struct('v', dv, 'kw', {st.matches('dv', TITLE_KEYWORD)}, "
            f"'company', {is_company('dv')}, 'piped', {pipe_split('dv')})")) + ")"
    )


def _pair(title: str, company: str) -> str:
    return f"named_struct('title', {title}, 'company', {company})"


def _two_lines(a: str, b: str) -> str:
    """Header of two content lines, in either order."""
    number = f"regexp_extract({a}.v, {st.raw(DANGLING_NUMBER)}, 1)"
    head = st.strip(st.replace(f"{a}.v", DANGLING_NUMBER), WIDE_EDGES)
    plain = _pair(f"{a}.v", f"{b}.v")
    swapped = _pair(f"{b}.v", f"CASE WHEN {a}.company THEN {a}.v ELSE '' END")
    numbered = _pair(f"coalesce(nullif({head}, ''), {a}.v)", f"concat({number}, ' ', {b}.v)")
    return (
        f"CASE WHEN {b}.kw AND NOT {a}.kw THEN coalesce({b}.piped, {swapped}) "
        f"WHEN {b}.company THEN CASE WHEN {number} <> '' THEN {numbered} ELSE {plain} END "
        f"ELSE coalesce({a}.piped, {plain}) END"
    )


def _one_line(a: str) -> str:
    """Header of a single content line."""
    parts = f"filter(transform(split({a}.v, {st.raw(SEPARATOR)}), x -> trim(x)), x -> x <> '')"
    by_separator = st.let("sp", parts, _pair(f"coalesce(get(sp, 0), {a}.v)", "coalesce(get(sp, 1), '')"))
    by_slash = st.let("ss", slash_split(f"{a}.v"), (
        f"CASE WHEN contains({a}.v, '/') AND ss.title <> '' AND ss.company <> '' THEN ss "
        f"ELSE {by_separator} END"))
    employer = _pair("''", f"{a}.v")
    return (f"CASE WHEN NOT {a}.kw AND {a}.company THEN {employer} "
            f"ELSE coalesce({a}.piped, {by_slash}) END")


def job_header(lines: str) -> str:
    """struct(title, company, dates) of up to three header lines."""
    found = f"regexp_extract(array_join(hl, ' | '), {st.raw(dt.FULL_RANGE)}, 0)"
    content = st.let("ct", f"filter(hl, x -> NOT {st.matches('x', dt.WHOLE_RANGE)})",
                     "CASE WHEN size(ct) = 0 THEN hl ELSE ct END")
    body = st.let("hs", _sides(f"slice({content}, 1, 2)"), st.let("ha", "get(hs, 0)", st.let(
        "hb", "get(hs, 1)", f"CASE WHEN hb IS NOT NULL THEN {_two_lines('ha', 'hb')} "
                            f"ELSE {_one_line('ha')} END")))
    return st.let("hl", f"filter(transform({lines}, x -> {st.strip('x')}), x -> x <> '')", (
        f"CASE WHEN size(hl) = 0 THEN named_struct('title', '', 'company', '', 'dates', '') ELSE "
        + st.let("tc", body, f"named_struct('title', tc.title, 'company', tc.company, "
                 f"'dates', trim({found}))") + " END"
    ))


def clip_title(title: str, limit: int = 120) -> str:
    """The title itself, never a duty sentence."""
    base = st.replace(st.collapse(tx.clean(title)), tx.JUNK_PREFIX)
    undutied = st.let("ds", f"split(c0, {st.raw(DUTY_SPLIT)}, 2)", (
        f"CASE WHEN size(ds) > 1 AND {st.matches('ds[0]', TITLE_KEYWORD)} "
        f"THEN {st.strip('ds[0]', WIDE_EDGES)} ELSE c0 END"))
    left, right = "substring_index(c1, ' | ', 1)", "substr(c1, instr(c1, ' | ') + 3)"
    unpiped = (f"CASE WHEN contains(c1, ' | ') AND length({right}) > 40 "
               f"AND {st.matches(right, r'^\p{Ll}')} AND NOT {st.matches(right, TITLE_KEYWORD)} "
               f"THEN trim({left}) ELSE c1 END")
    short = (f"CASE WHEN length(c2) > {limit} THEN "
             f"{st.strip(f'regexp_replace(left(c2, {limit}), {st.raw(" [^ ]*$")}, {chr(39) * 2})', WIDE_EDGES)} "
             f"ELSE c2 END")
    return st.let("c0", base, st.let("c1", undutied, (
        f"CASE WHEN {st.matches('c1', DUTY_START)} THEN '' ELSE "
        + st.let("c2", unpiped, tx.clean(short)) + " END"
    )))


def clip_company(company: str, title: str, limit: int = 80) -> str:
    """A short employer name without dates or duties."""
    base = st.replace(st.collapse(tx.clean(company)), tx.JUNK_PREFIX)
    undated = st.collapse(without_dates("e0", WIDE_EDGES))
    first = st.strip(f"get(split({undated}, {st.raw(DUTY_SPLIT)}, 2), 0)", WIDE_EDGES)
    return st.let("e0", base, (
        f"CASE WHEN e0 = '' OR {st.matches('e0', DUTY_START)} THEN '' ELSE "
        + st.let("e1", first, (
            f"CASE WHEN {st.matches('e1', DUTY_START)} OR length(e1) > {limit} "
            f"OR ({title} <> '' AND lower(e1) = lower({title})) THEN '' "
            f"ELSE {tx.clean('e1')} END")) + " END"
    ))


def header_reliable(title: str, company: str) -> str:
    return (f"({title} <> '' AND {company} <> '' AND lower({title}) <> lower({company}) AND NOT "
            f"({st.matches(company, dt.FULL_RANGE)} AND {st.matches(company, TITLE_KEYWORD)}))")


def degree_school(parts: str) -> str:
    """struct(degree, institution) of leftover education fragments."""
    def has(v: str, p: str) -> str:
        return st.matches(v, p)

    split = f"filter(transform(split(dp[0], {st.raw(SEPARATOR)}), x -> trim(x)), x -> x <> '')"
    degree = f"get(filter(dq, x -> {has('x', DEGREE_KEYWORD)}), 0)"
    school = f"get(filter(dq, x -> {has('x', SCHOOL_KEYWORD)}), 0)"
    single = st.let("dq", split, (
        f"CASE WHEN size(dq) = 0 THEN named_struct('degree', dp[0], 'institution', '') "
        f"WHEN {degree} IS NOT NULL OR {school} IS NOT NULL THEN named_struct('degree', "
        f"coalesce({degree}, dq[0]), 'institution', coalesce({school}, '')) "
        f"ELSE named_struct('degree', dq[0], 'institution', coalesce(get(dq, 1), '')) END"))
    return st.let("dp", parts, (
        f"CASE WHEN size(dp) = 0 THEN named_struct('degree', '', 'institution', '') "
        f"WHEN size(dp) >= 2 THEN CASE WHEN {has('dp[1]', DEGREE_KEYWORD)} "
        f"AND NOT {has('dp[0]', DEGREE_KEYWORD)} "
        f"THEN named_struct('degree', dp[1], 'institution', dp[0]) "
        f"ELSE named_struct('degree', dp[0], 'institution', dp[1]) END ELSE {single} END"
    ))
