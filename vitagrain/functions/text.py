"""Text cleaning, links, names, files and prose (Spark SQL expression text)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from vitagrain.functions import lexicon as lx
from vitagrain.functions import sqltext as st

# Characters and separators removed from extracted text.
BROKEN = (r"[\x{FFFD}\x{FFFC}\x{FEFF}\x{25A0}-\x{25FF}\x{2B1B}\x{2B1C}\x{E000}-\x{F8FF}"
          r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
# A superset of BROKEN that one bit table and one range decide: Java tests the parts of a class one by one.
MAYBE_BROKEN = "[" + "".join(rf"\x{c:02x}" for c in range(0x80) if c < 0x20 and c not in (9, 10, 13) or c == 0x7F) + r"\x{25A0}-\x{FFFF}]"
# Possessive classes instead of repeated groups: linear on any run, and no recursion.
REPEATED_PIPES = r"(?<!\s)\s*+\|\s*+\|[\s|]*+"
EDGE_SEPARATORS = r"^\s*+[|•][\s|•]*+|(?<![\s|•])\s*+[|•][\s|•]*+$"
JUNK_PREFIX = r"^[\s\x{FEFF}\x{FFFD}•●◦○□■▪▫?\-]+\s*"
MAJOR_PREFIX = r"(?i)^(major|degree|field of study)\s*:\s*"
BULLET = r"^\s*[•‣▪●◦○\-*\x{F000}-\x{F0FF}]\s+"
POSTING_BULLET = r"^\s*[•‣▪●◦○\-*–—]\s+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}-\x{2029}]"
LINE_BREAKS = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}-\x{2029}]+"  # where blank lines drop out anyway

# Contact, seniority, qualification and hedge patterns.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"\+?\d[\d\-.\s()]{7,}\d"
PHONE_TOKEN = r"^\+?\(?\d[\d\-.()]{5,}\d\)?$"
PROFILE_HINT = r"(?i)(linkedin\.com|\blinkedin\b|github\.com|/portfolio\b|\bportfolio\b\s*:)"
LOCATION = r"^[A-Z][A-Za-z .'\-]+,\s*[A-Z][A-Za-z .'\-]+$"
YEARS = r"(?i)(\d+)\+?\s*(?:-\s*\d+\s*)?\s*years?"
SENIORITY = [
    (r"(?i)\b(principal|staff)\b", "Principal/Staff"),
    (r"(?i)\bsenior\b|\bsr\.?\b", "Senior"),
    (r"(?i)\blead\b", "Lead"),
    (r"(?i)\bmid[\s-]?level\b|\bintermediate\b", "Mid-level"),
    (r"(?i)\bjunior\b|\bjr\.?\b|\bentry[\s-]?level\b|\bnew\s+grad\b", "Junior/Entry-level"),
]
QUALIFICATION = (r"(?i)degree|bachelor|master|b\.?s\.?c?\b|m\.?s\.?c?\b|phd|certification|"
                 r"certified|years?\s+of\s+experience")
INLINE_PREFERRED = (r"(?i)(nice[\s-]to[\s-]have|is a plus|would be a plus|preferred|bonus|"
                    r"good to have|desirable|ideally|optional)")
CERTIFICATION = (
    r"(?i)\b(AWS\s+Certified\s+[A-Za-z][A-Za-z ]{2,40}|"
    r"Microsoft\s+Certified\s+[A-Za-z][A-Za-z ]{2,40}|"
    r"Azure\s+(?:Solutions\s+)?[A-Za-z][A-Za-z ]{2,30}?\s+Certif\w*|"
    r"Google\s+Cloud\s+Certified\s+[A-Za-z][A-Za-z ]{2,40}|"
    r"GCP\s+Certified\s+[A-Za-z][A-Za-z ]{2,40}|"
    r"PMP|CAPM|CSM|CSPO|PSM|PSPO|CKA|CKAD|CKS|CISSP|CISM|CISA|Security\+|CompTIA\s+\w+|"
    r"ITIL(?:\s+v?\d)?|Certified\s+Scrum\s+Master|Certified\s+Kubernetes\s+[A-Za-z ]{2,30})\b"
)
CERTIFICATION_TAIL = (r"(?i)\s+(?:preferred|required|desired|is\s+a\s+plus|a\s+plus|"
                      r"nice\s+to\s+have|or\s+equivalent|equivalent)\.?\s*$")
TITLE_PREFIX = r"(?i)^(?:job\s*title|position|role|title)\s*:\s*(.+)$"
ROLE_WORD = (r"(?i)\b(engineer|developer|manager|architect|analyst|designer|scientist|lead|"
             r"director|specialist|consultant|administrator|programmer)\b")
HEDGE = (
    r"(?i)\b(do not have|don't have|not (?:listed|documented|available|on my resume)|"
    r"resume does not|cannot find|no (?:record|details|information) (?:on|in) my resume|"
    r"not in my resume|upon request|I would need to|"
    r"my documented (?:academic )?background begins)\b"
)
SUMMARY_DUMP = (r"(?is)\s+(?:Matched(?:\s+skills|\s+terms)?\s*:|Transferable(?:\s+skills)?\s*:|"
                r"Transferable experience with\b|Hands-on with\b).*$")
YEARS_SPAN = (r"(?i)(?:(?:over|more than|nearly|about|around|approximately)\s+)?"
              r"\d+\+?\s*(?:years?|yrs)")
TENURE_ROLE = r"(?i)\b(?:engineer|developer|lead|manager|architect|analyst)\b"


def lines(text: str) -> str:
    """Stripped non-blank lines of a text."""
    return (f"filter(transform(split({text}, {st.raw(LINE_BREAKS)}), x -> {st.strip('x')}), "
            f"x -> x <> '')")


def all_lines(text: str) -> str:
    """Stripped lines, blank ones kept so positions survive."""
    return f"transform(split({text}, {st.raw(LINE_BREAK)}), x -> {st.strip('x')})"


def _edge(value: str, characters: str) -> str:
    """Whether a text begins or ends with one of a list of literals."""
    return f"(left({value}, 1) IN ({characters}) OR right({value}, 1) IN ({characters}))"


SPACES, SEPARATORS = r"' ', '\t', '\n', '\r', '\u000B', '\u000C'", "'|', '•'"


def clean(text: str) -> str:
    """Drop glyphs that print as boxes, then tidy separators and blanks.

    Each rewrite only runs where a cheaper test says it can apply, and none is tried on a
    text that has nothing to tidy, so ordinary text pays for one fast pass.
    """
    broken = st.matches("z", MAYBE_BROKEN)
    blanks = "contains(z, '  ') OR contains(z, '\\t')"
    breaks = "contains(z, ' \\n') OR contains(z, '\\n ')"
    edges = _edge("z", f"{SPACES}, {SEPARATORS}")
    rules = [
        (f"contains(z, '|') AND {st.matches('z', REPEATED_PIPES)}", REPEATED_PIPES, "' | '"),
        (f"{edges} AND {_edge(st.strip('z'), SEPARATORS)}", EDGE_SEPARATORS, "''"),
        (blanks, r"[ \t]{2,}+|\t", "' '"),
        (breaks, r" +\n *|\n +", "'\\n'"),
        ("contains(z, '\\n\\n\\n')", r"\n{3,}", "'\\n\\n'"),
    ]
    out = f"CASE WHEN {broken} THEN {st.replace('z', BROKEN)} ELSE z END"
    for test, pattern, by in rules:
        out = st.let("z", out, f"CASE WHEN {test} THEN "
                               f"regexp_replace(z, {st.raw(pattern)}, {by}) ELSE z END")
    out = st.let("z", out, f"CASE WHEN {_edge('z', SPACES)} THEN {st.strip('z')} ELSE z END")
    untidy = f"contains(z, '|') OR {blanks} OR {breaks} OR contains(z, '\\n\\n\\n') OR {edges} OR {broken}"
    return st.let("z", f"coalesce({text}, '')", f"CASE WHEN {untidy} THEN {out} ELSE z END")


def clean_items(array: str) -> str:
    """Clean every item and drop the ones that become empty."""
    return f"filter(transform({array}, v -> {clean('v')}), v -> v <> '')"


def clean_extracted(text: str) -> str:
    """Also strip bullet glyphs and a leading field label."""
    out = st.replace(st.replace(clean(text), JUNK_PREFIX), MAJOR_PREFIX)
    return clean(st.strip(out, " |,-–—"))


# Scheme, user and host of a link.
AUTHORITY = r"^(?:[^/?#]*?://)?(?:[^/?#]*@)?+(\[[^\]/?#]*\]|[^/?#:@]*)"


# --- links ---------------------------------------------------------------------
def host(url: str) -> str:
    """Lower-case host without ``www.``; a missing scheme reads as https.

    The authority ends at the first slash, question mark or hash; what stands
    before an at sign in it, and a port, are no part of the host. Characters that
    a strict parser refuses (blanks, pipes, braces, underscores) do no harm.
    """
    u = st.strip(f"coalesce({url}, '')")
    return f"regexp_replace(lower(regexp_extract({u}, {st.raw(AUTHORITY)}, 1)), '^www[.]', '')"


def on_domain(host_text: str, domain: str) -> str:
    """The domain itself or a subdomain of it."""
    return st.let("hx", host_text, f"(hx = '{domain}' OR endswith(hx, '.{domain}'))")


def link_key(url: str) -> str:
    """Key under which trivial variants of one link coincide."""
    stripped = st.strip(f"coalesce({url}, '')")
    return f"lower(regexp_replace({stripped}, '/+$', ''))"


def link_reason(url: str) -> str:
    """Why a link is rejected, or an empty string."""
    return st.let("u", st.strip(f"coalesce({url}, '')"), (
        "CASE WHEN u = '' THEN 'empty link' "
        "WHEN NOT (startswith(u, 'http://') OR startswith(u, 'https://')) THEN 'bad scheme' "
        f"WHEN length(u) > {lx.MAX_LINK_LENGTH} THEN 'too long' ELSE '' END"
    ))


# Link sources in report order; anything else ranks last.
LINK_SOURCES = [["djinni.co"], ["dou.ua"], ["linkedin.com", "lnkd.in"]]


def link_rank(url: str) -> str:
    def hit(domain: str) -> str:
        return f"h = '{domain}'" if domain == "lnkd.in" else on_domain("h", domain)

    arms = " ".join(
        f"WHEN {' OR '.join(hit(d) for d in domains)} THEN {rank}"
        for rank, domains in enumerate(LINK_SOURCES)
    )
    return st.let("h", host(url), f"CASE {arms} ELSE {len(LINK_SOURCES)} END")


# --- names and files -------------------------------------------------------------
def file_component(value: str) -> str:
    """Safe part of a file name; case and inner blanks are kept."""
    out = st.replace(st.strip(value), r"[^A-Za-z0-9 _.-]")
    return st.strip(st.replace(st.replace(out, r"\s+", " "), r"_+", "_"), "_. ")


def export_name(name: str, stack: str, company: str) -> str:
    parts = [f"nullif({file_component(name)}, '')", f"nullif(lower({file_component(stack)}), '')",
             f"nullif(lower({file_component(company)}), '')"]
    return f"coalesce(nullif(concat_ws('_', {', '.join(parts)}), ''), 'Tailored_Resume')"


def file_stem(name: str) -> str:
    return f"coalesce(nullif({file_component(name)}, ''), 'Resume')"


def with_extension(base: str, extension: str) -> str:
    return st.let("e", f"regexp_replace(trim({extension}), '^[.]+', '')",
                  f"CASE WHEN e = '' THEN {base} ELSE concat({base}, '.', e) END")


def upload_reason(file_name: str, size: str) -> str:
    """Why a file is rejected at upload, or an empty string."""
    ext = f"lower(regexp_extract({file_name}, '[.]([^.]*)$', 1))"
    return (f"CASE WHEN NOT {ext} IN ({st.items(lx.UPLOAD_EXTENSIONS)}) THEN 'unsupported type' "
            f"WHEN {size} > {lx.MAX_UPLOAD_BYTES} THEN 'too large' "
            f"WHEN {size} = 0 THEN 'empty file' ELSE '' END")


def email(value: str) -> str:
    return f"lower({st.strip(value)})"


def email_valid(value: str) -> str:
    return (f"(contains({value}, '@') AND contains(element_at(split({value}, '@'), -1), '.') "
            f"AND NOT contains({value}, ' '))")


def first_name(name: str) -> str:
    words = f"split(replace(coalesce({name}, ''), ',', ' '), {st.raw(chr(92) + 's+')})"
    return (f"coalesce(get(filter(transform({words}, w -> lower(trim(BOTH '.' FROM w))), "
            f"w -> w <> ''), 0), '')")


def name_key(name: str) -> str:
    return f"lower({st.collapse(f'coalesce({name}, {chr(39) * 2})')})"


# --- posting fields --------------------------------------------------------------
def years_required(text: str) -> str:
    return st.let("y", f"regexp_extract({text}, {st.raw(YEARS)}, 1)",
                  "CASE WHEN y = '' THEN '' ELSE concat(y, '+ years') END")


def seniority(text: str, years: str) -> str:
    arms = " ".join(f"WHEN {st.matches(text, p)} THEN {st.text(label)}" for p, label in SENIORITY)
    return st.let("lv", f"CASE {arms} END", (
        f"CASE WHEN lv IS NULL THEN coalesce(nullif({years}, ''), 'Not specified') "
        f"WHEN {years} = '' THEN lv ELSE concat(lv, ' (', {years}, ')') END"
    ))


def business_domain(lower_text: str) -> str:
    arms = " ".join(f"WHEN contains({lower_text}, {st.text(k)}) THEN {st.text(v)}"
                    for k, v in lx.DOMAIN_CUES)
    return f"CASE {arms} ELSE '' END"


def certifications(text: str, limit: int | None = None) -> str:
    """Distinct certifications that a text names, sorted; all without a limit."""
    found = f"regexp_extract_all({text}, {st.raw(CERTIFICATION)}, 0)"
    trimmed = f"transform({found}, c -> {st.strip(st.replace(st.strip('c'), CERTIFICATION_TAIL))})"
    return st.first(f"array_sort(array_distinct(filter({trimmed}, c -> c <> '')))", limit)


def escaped(term: str) -> str:
    """A term as a literal inside a regular expression."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}#&-~/" and c not in "/#&~" else c for c in term)


def term_present(term: str, lower_text: str) -> str:
    return st.matches(lower_text, rf"\b{escaped(term)}\b")


#: Longest run of plain characters in a term; where the term stands alone this is a whole run of the text.
PLAIN_RUN = r"[a-z0-9]+"


def plain_runs(lower_text: str) -> str:
    """Distinct whole runs of plain characters of a lower-case text."""
    return f"array_distinct(regexp_extract_all({lower_text}, {st.raw(PLAIN_RUN)}, 0))"


def _run_of(term: str) -> str:
    return max(re.findall(PLAIN_RUN, term), key=len, default="")


def known(values: str, vocabulary: Iterable[str]) -> str:
    """The few of many values that a vocabulary has; by hash."""
    return f"array_intersect({values}, array({st.items(sorted(set(vocabulary)))}))"


def known_runs(lower_text: str, vocabulary: Iterable[str]) -> str:
    """Runs of a lower-case text that a term of the vocabulary needs to stand alone in it."""
    return known(plain_runs(lower_text), filter(None, map(_run_of, vocabulary)))


def vocabulary_hits(keywords: str, lower_text: str, vocabulary: list[str],
                    cap: int | None = None, runs: str | None = None) -> str:
    """Vocabulary terms in a text: more words first, then alphabetical.

    A term counts when it is a keyword or stands alone in the text; the pattern
    only runs where a plain substring test has already hit. ``runs``, where given, holds
    the text's runs that terms need (``known_runs``); without its run no term is looked for.
    """
    ordered = sorted(vocabulary, key=lambda t: (-len(t.split()), t))

    def possible(term: str) -> str:
        run = _run_of(term)
        return f"array_contains({runs}, {st.text(run)}) AND " if runs and run else ""

    tests = [
        f"CASE WHEN array_contains({keywords}, {st.text(t)}) OR ({possible(t)}contains({lower_text}, "
        f"{st.text(t)}) AND {term_present(t, lower_text)}) THEN {st.text(t)} END"
        for t in ordered
    ]
    hits = f"filter(array({', '.join(tests)}), t -> t IS NOT NULL)"
    return st.first(hits, cap)


# --- prose -------------------------------------------------------------------------
def truncated(value: str, limit: int, suffix: str = "\n...(truncated)") -> str:
    s = suffix.replace("\n", "\\n")
    return (f"CASE WHEN length({value}) > {limit} THEN concat(left({value}, {limit}), '{s}') "
            f"ELSE {value} END")


def prose_list(values: str, limit: int | None = None) -> str:
    """``a``, ``a and b`` or ``a, b, and c``."""
    return st.let("w", st.first(values, limit), (
        "CASE WHEN size(w) <= 1 THEN array_join(w, '') "
        "WHEN size(w) = 2 THEN concat(w[0], ' and ', w[1]) "
        "ELSE concat(array_join(slice(w, 1, size(w) - 1), ', '), ', and ', "
        "element_at(w, -1)) END"
    ))


def summary_prose(summary: str) -> str:
    """Strip keyword-dump tails and end with a full stop."""
    cut = st.replace(st.strip(f"coalesce({summary}, '')"), SUMMARY_DUMP)
    return st.let("s", f"regexp_replace({cut}, '[ ;,]+$', '')", (
        "CASE WHEN s = '' OR right(s, 1) IN ('.', '!', '?') THEN s ELSE concat(s, '.') END"
    ))


def replace_first(value: str, pattern: str, by: str) -> str:
    """Replace only the first match; ``by`` is an expression."""
    head = f"regexp_extract({value}, {st.raw(f'(?s)^(.*?)(?:{pattern})')}, 1)"
    whole = f"regexp_extract({value}, {st.raw(f'(?s)^.*?(?:{pattern})')}, 0)"
    return st.let("h", f"named_struct('head', {head}, 'size', length({whole}))",
                  f"concat(h.head, {by}, substr({value}, h.size + 1))")


def with_tenure(summary: str, phrase: str) -> str:
    """Put the career span into a summary: replace a stated count, else inject."""
    split = ("CASE WHEN contains(t, '. ') THEN named_struct("
             "'first', substring_index(t, '. ', 1), "
             "'rest', substr(t, length(substring_index(t, '. ', 1)) + 3), 'sep', true) "
             "ELSE named_struct('first', t, 'rest', '', 'sep', false) END")
    role = f"regexp_extract(p.first, {st.raw(TENURE_ROLE)}, 0)"
    joined = "trim(CASE WHEN p.rest <> '' THEN concat({0}, '. ', p.rest) ELSE {0} END)"
    with_word = replace_first("p.first", r"(?i)\bwith\b", f"concat('with ', {phrase}, ' of experience,')")
    with_role = replace_first("p.first", TENURE_ROLE,
                              f"concat({role}, ' with ', {phrase}, ' of experience')")
    bare = "regexp_replace(p.first, '[.]+$', '')"
    body = st.let("p", split, (
        f"CASE WHEN {st.matches('p.first', r'(?i)\bwith\b')} THEN {joined.format(with_word)} "
        f"WHEN {st.matches('p.first', TENURE_ROLE)} THEN {joined.format(with_role)} "
        f"WHEN p.sep THEN trim(concat({bare}, ' with ', {phrase}, ' of experience. ', p.rest)) "
        f"ELSE concat(regexp_replace(t, '[.]+$', ''), ' with ', {phrase}, ' of experience.') END"
    ))
    return st.let("t", st.strip(f"coalesce({summary}, '')"), (
        f"CASE WHEN {phrase} IS NULL OR t = '' THEN t "
        f"WHEN {st.matches('t', YEARS_SPAN)} THEN {replace_first('t', YEARS_SPAN, phrase)} "
        f"ELSE {body} END"
    ))


def labelled_lines(groups: list[tuple[str, str]]) -> str:
    """``Label: a, b`` per non-empty group."""
    parts = ", ".join(
        f"CASE WHEN size({value}) > 0 THEN concat('{label}: ', array_join({value}, ', ')) END"
        for label, value in groups
    )
    return f"filter(array({parts}), v -> v IS NOT NULL)"


def numbered(values: str) -> str:
    return (f"array_join(transform({values}, (v, i) -> concat(CAST(i + 1 AS STRING), '. ', v)), "
            f"'\\n')")


def distinct_folded(values: str) -> str:
    """Keep the first of values equal up to case, in order, dropping blanks.

    Sorting by (key, position) puts equal keys side by side, so the cost is
    that of two sorts whatever the number of repeats.
    """
    keyed = (f"sort_array(transform({values}, (v, i) -> "
             f"named_struct('k', lower({st.strip('v')}), 'i', i, 'v', v)))")
    firsts = "filter(kd, (s, j) -> s.k <> '' AND (j = 0 OR s.k <> get(kd, j - 1).k))"
    return st.let("kd", keyed, (
        f"transform(sort_array(transform({firsts}, s -> named_struct('i', s.i, 'v', s.v))), "
        f"s -> s.v)"
    ))


def skill_digest(values: str, limit: int | None = None) -> str:
    """The first distinct skills as one line."""
    joined = f"array_join({st.first(distinct_folded(values), limit)}, ', ')"
    return f"coalesce(nullif({joined}, ''), '(none listed)')"


def skill_category(term: str) -> str:
    """Skill group of a bare term, null when it is not a skill."""
    c = lx.CATEGORIES
    backend = [t for t in c["frameworks"] if t not in lx.FRONTEND_FRAMEWORKS]
    order = [("languages", c["programming_languages"]), ("frontend", lx.FRONTEND_FRAMEWORKS),
             ("backend", backend), ("cloud", c["cloud_platforms"]), ("devops", c["devops_tools"]),
             ("databases", c["databases"]), ("ai", c["ai_ml_tools"]),
             ("tools", c["methodologies"] + lx.EXTRA_TECHNOLOGIES)]
    arms = " ".join(f"WHEN k IN ({st.items(v)}) THEN '{g}'" for g, v in order)
    return st.let("k", f"lower({st.strip(term)})", f"CASE {arms} END")


def display_form(term: str, cv_skills: str) -> str:
    """The profile's own spelling, else capitals for acronyms, else first letter."""
    return st.let("q", st.strip(term), (
        f"coalesce(get(reverse(filter({cv_skills}, o -> lower(o) = lower(q))), 0), "
        f"CASE WHEN lower(q) IN ({st.items(lx.ACRONYMS)}) THEN upper(q) "
        f"ELSE concat(upper(left(q, 1)), substr(q, 2)) END)"
    ))


def dictionary_tag(hint: str, words: list[str], content: str = "''",
                   cues: list[tuple[str, str]] = ()) -> str:
    """Longest whole dictionary word in a hint, else the first content cue."""
    ranked = sorted(words, key=lambda w: (-len(w), w))
    arms = [f"WHEN {st.matches('hn', rf'(?i)\b{escaped(w)}\b')} THEN {st.text(w)}" for w in ranked]
    arms += [f"WHEN contains(lower({content}), {st.text(c)}) THEN {st.text(t)}" for c, t in cues]
    spaced = f"regexp_replace({hint}, '[_-]+', ' ')"
    return st.let("hn", spaced, f"CASE {' '.join(arms)} ELSE '' END")
