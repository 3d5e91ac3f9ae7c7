"""Free-text profiles to nested records.

Every step is a projection: a document stays in its row from text to record, so
the whole pipeline is one map stage whatever the corpus size. Steps are kept in
separate projections so that each intermediate array is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagrain.functions import dates as dt
from vitagrain.functions import headers as hd
from vitagrain.functions import sqltext as st
from vitagrain.functions import text as tx
from vitagrain.operators import lines as ln

EMPTY_TEXTS = "CAST(array() AS ARRAY<STRING>)"
MARKER = st.matches("x", tx.BULLET)
UNMARKED = st.strip(st.replace("x", tx.BULLET))


def _add(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned text, its lines without page labels, and their headings."""
    df = _add(docs, raw_text=tx.clean(text))
    df = _add(df, lines=f"filter({tx.lines('raw_text')}, x -> NOT {st.matches('x', hd.PAGE_NOISE)})")
    return _add(df, heads=f"transform(lines, x -> {hd.heading('x')})")


def with_sections(df: DataFrame) -> DataFrame:
    """Preamble and the content lines of each section."""
    df = _add(df, segments=ln.sections("lines", "heads"),
              n_preamble="coalesce(array_position(transform(heads, h -> h.kind IS NOT NULL), true), 0)")
    return _add(
        df,
        preamble="CASE WHEN n_preamble = 0 THEN lines ELSE "
                 "slice(lines, 1, CAST(n_preamble - 1 AS INT)) END",
        **{f"{kind}_lines": ln.section_lines("segments", kind)
           for kind in ("summary", "skills", "education", "languages", "certifications")},
        job_segments="transform(filter(segments, s -> s.kind = 'experience'), s -> "
                     f"transform(s.lines, x -> {hd.line_kinds('x')}))",
    )


def with_jobs(df: DataFrame) -> DataFrame:
    """Experience lines to structured jobs."""
    df = _add(df, islands=f"flatten(transform(job_segments, s -> {ln.job_islands('s')}))")
    df = _add(df, islands="transform(islands, j -> named_struct('kinds', j, "
                          f"'n', {ln.header_size('j')}))")
    df = _add(df, jobs="transform(islands, j -> named_struct("
                       "'header', transform(slice(j.kinds, 1, j.n), x -> x.line), "
                       "'body', transform(slice(j.kinds, j.n + 1, size(j.kinds)), x -> x.line)))")
    df = _add(df, jobs=f"transform(jobs, j -> named_struct('header', j.header, 'parsed', "
                       f"{hd.job_header('j.header')}, 'bullets', filter(transform("
                       f"{ln.merge_wrapped('j.body', MARKER, UNMARKED)}, b -> "
                       f"{tx.clean_extracted('b')}), b -> b <> '')))")
    df = _add(df, jobs=f"transform(jobs, j -> named_struct('header', j.header, "
                       f"'title', {hd.clip_title('j.parsed.title')}, "
                       f"'company', {tx.clean_extracted('j.parsed.company')}, "
                       f"'dates', {tx.clean_extracted('j.parsed.dates')}, 'bullets', j.bullets))")
    df = _add(df, jobs=f"transform(jobs, j -> named_struct('header', j.header, 'title', j.title, "
                       f"'company', {hd.clip_company('j.company', 'j.title')}, "
                       f"'dates', j.dates, 'bullets', j.bullets, "
                       f"'first_fits', size(j.bullets) > 0 AND {hd.is_company('get(j.bullets, 0)')}))")
    borrowed = "j.company = '' AND j.first_fits"
    df = _add(df, jobs=f"transform(jobs, j -> named_struct('header', j.header, 'title', j.title, "
                       f"'company', CASE WHEN {borrowed} THEN "
                       f"{hd.clip_company('get(j.bullets, 0)', 'j.title')} ELSE j.company END, "
                       f"'dates', j.dates, 'bullets', CASE WHEN {borrowed} THEN "
                       f"slice(j.bullets, 2, size(j.bullets)) ELSE j.bullets END))")
    later = (f"get(filter(transform(slice(j.header, 2, size(j.header)), x -> "
             f"{hd.clip_company(tx.clean_extracted('x'), 'j.title')}), "
             f"x -> x <> '' AND lower(x) <> lower(j.title)), 0)")
    return _add(df, experience=f"transform(jobs, j -> named_struct('title', j.title, 'company', "
                               f"CASE WHEN j.company = '' THEN coalesce({later}, '') "
                               f"ELSE j.company END, 'dates', j.dates, 'bullets', j.bullets))")


def contact(lines: str) -> str:
    """Contact details of the header block; the first match of each field wins.

    A fold, because what is left of a line for the location depends on which
    fields earlier lines already filled.
    """
    n_name = (f"array_position(transform(slice(cl, 2, size(cl)), x -> {hd.is_name_only('x')}), false)")
    head = f"CAST(CASE WHEN {n_name} = 0 THEN size(cl) ELSE {n_name} END AS INT)"
    token = (f"get(filter(split(q, {st.raw(chr(92) + 's+')}), "
             f"t -> {st.matches(st.strip('t', ',;'), tx.PHONE_TOKEN)}), 0)")
    start = ("named_struct('email', CAST(NULL AS STRING), 'phone', CAST(NULL AS STRING), "
             "'location', CAST(NULL AS STRING), 'linkedin', CAST(NULL AS STRING))")
    # Email first, then phone on what remains, then the link or the location.
    mail = f"CASE WHEN a.email IS NULL THEN nullif(regexp_extract(x, {st.raw(tx.EMAIL)}, 0), '') END"
    loose = f"nullif(regexp_extract(q, {st.raw(tx.PHONE)}, 0), '')"
    pick = (f"CASE WHEN a.phone IS NULL THEN coalesce({token}, {loose}) END")

    def drop(value: str, part: str) -> str:
        return (f"CASE WHEN {part} IS NULL THEN {value} ELSE trim(concat("
                f"substring_index({value}, {part}, 1), "
                f"substr({value}, instr({value}, {part}) + length({part})))) END")

    left = st.replace(st.strip("rm", hd.EDGES), hd.PLUS_ONE)
    segment = (f"get(filter(transform(split(x, '[|]'), s -> {st.strip('s', hd.EDGES)}), "
               f"s -> s <> '' AND {st.matches('s', tx.LOCATION)}), 0)")
    place = (
        f"CASE WHEN a.location IS NOT NULL OR link THEN a.location "
        f"WHEN em IS NOT NULL OR ph IS NOT NULL THEN {st.let('lf', left, chr(67) + 'ASE WHEN lf <> ' + chr(39) * 2 + ' AND length(lf) < 60 AND NOT contains(lf, ' + chr(39) + '@' + chr(39) + ') THEN lf END')} "
        f"ELSE {segment} END"
    )
    result = (f"named_struct('email', coalesce(a.email, em), "
              f"'phone', coalesce(a.phone, {st.strip('ph', ',;')}), 'location', {place}, "
              f"'linkedin', CASE WHEN link THEN x ELSE a.linkedin END)")
    body = st.let("em", mail, st.let("q", drop("x", "em"), st.let("ph", pick, st.let(
        "rm", drop("q", "ph"), st.let(
            "link", f"a.linkedin IS NULL AND {st.matches('x', tx.PROFILE_HINT)}", result)))))
    fold = f"aggregate(slice(cl, nn + 1, size(cl)), {start}, (a, x) -> {body})"
    return st.let("cl", lines, (
        f"CASE WHEN size(cl) = 0 THEN named_struct('name', 'Unknown', 'details', {start}) ELSE "
        + st.let("nn", head, f"named_struct('name', array_join(slice(cl, 1, nn), ' '), "
                             f"'details', {fold})") + " END"))


def education(lines: str) -> str:
    """Education entries: the second and later dated lines open a new block."""
    dated = ln.positions("el", st.matches("x", dt.FULL_RANGE))
    starts = (f"CASE WHEN size(el) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE "
              f"array_distinct(concat(array(0), slice({dated}, 2, size(el)))) END")
    parts = f"filter(transform(b, x -> {hd.without_dates('x', hd.EDGES + '()')}), x -> x <> '')"
    entry = (
        "named_struct('degree', " + tx.clean_extracted("ds.degree") + ", 'institution', "
        + tx.clean_extracted("ds.institution") + ", 'dates', " + tx.clean_extracted(
            f"regexp_extract(array_join(b, ' | '), {st.raw(dt.FULL_RANGE)}, 0)")
        + ", 'skip', " + st.matches("trim(array_join(pp, ' '))", r"(?i)^(bachelor|master)\s*:?\s*$")
        + ")")
    per_block = st.let("pp", parts, st.let("ds", hd.degree_school("pp"), entry))
    return st.let("el", lines, (
        f"transform(filter(transform({ln.slices('el', starts)}, b -> {per_block}), e -> NOT e.skip), "
        f"e -> named_struct('degree', e.degree, 'institution', e.institution, 'dates', e.dates))"))


def skills(lines: str, merge: bool = True, limit: int | None = None) -> str:
    """Distinct skill tokens, shorter than a limit if one is given; wrapped lines join the labelled line above."""
    source = ln.groups_from("kl", st.matches("x", hd.LABEL_PREFIX)) if merge else \
        "transform(kl, x -> array(x))"
    joined = f"transform({source}, g -> array_join(g, ' '))"
    pieces = (f"flatten(transform({joined}, x -> split({st.replace(tx.clean('x'), hd.LABEL_PREFIX)}, "
              f"'[,;|•/]')))")
    tokens = (f"filter(transform({pieces}, x -> {tx.clean(st.strip('x', ' .'))}), "
              f"x -> x <> ''{'' if limit is None else f' AND length(x) < {limit}'})")
    return st.let("kl", lines, tx.distinct_folded(tokens))


def structure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One nested record per document.

    A document whose jobs are absent or whose headers are unreliable keeps its
    text and is marked unstructured.
    """
    df = with_jobs(with_sections(with_lines(docs, text)))
    df = _add(df, is_structured="size(experience) > 0 AND forall(experience, j -> "
                                f"{hd.header_reliable('j.title', 'j.company')})")

    def kept(value: str, empty: str) -> str:
        return f"CASE WHEN is_structured THEN {value} ELSE {empty} END"

    df = _add(df, who=kept(contact("preamble"), contact(EMPTY_TEXTS)))
    no_jobs = "filter(experience, j -> false)"
    return df.selectExpr(
        key, "is_structured", "who.name AS name", "who.details AS contact",
        f"{kept(tx.clean('array_join(summary_lines, chr(32))'), chr(39) * 2)} AS summary",
        f"{kept(skills('skills_lines'), EMPTY_TEXTS)} AS skills_raw",
        f"{kept('experience', no_jobs)} AS experience",
        f"{kept(education('education_lines'), education(EMPTY_TEXTS))} AS education",
        f"{kept(raw_lines('languages_lines'), EMPTY_TEXTS)} AS languages_raw",
        f"{kept(raw_lines('certifications_lines'), EMPTY_TEXTS)} AS certifications_raw",
        "raw_text",
    )


def raw_lines(lines: str) -> str:
    return f"filter(transform({lines}, x -> {tx.clean_extracted('x')}), x -> x <> '')"


def flat_text(with_company: bool = False) -> str:
    """Searchable text of a record; spoken languages never count."""
    job = "array(j.title, j.company)" if with_company else "array(j.title)"
    parts = f"concat(array(summary), skills_raw, flatten(transform(experience, j -> concat({job}, j.bullets)))"
    if with_company:
        parts += (", flatten(transform(education, e -> array(e.degree, e.institution))), "
                  "certifications_raw")
    return f"CASE WHEN is_structured THEN array_join({parts}), ' ') ELSE raw_text END"
