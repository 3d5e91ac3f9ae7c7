"""Audit tailored profiles against their masters; close coverage gaps.

One row holds one master and its tailored form, so every rule is an array
expression and the whole audit is a single map stage. Each rule yields issue
rows (rule, job, detail); corrections restore or rewrite existing text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagrain.functions import dates as dt
from vitagrain.functions import lexicon as lx
from vitagrain.functions import sqltext as st
from vitagrain.functions import stacks as sk
from vitagrain.functions import text as tx
from vitagrain.operators import lines as ln

NO_ISSUES = "CAST(array() AS ARRAY<STRUCT<rule: STRING, job: INT, detail: STRING>>)"


def issue(rule: str, job: str, detail: str) -> str:
    return f"named_struct('rule', '{rule}', 'job', CAST({job} AS INT), 'detail', {detail})"


def when(test: str, entry: str) -> str:
    return f"CASE WHEN {test} THEN {entry} END"


def span(jobs: str, as_of: str) -> str:
    """struct(starts, ends) over all readable jobs, the end capped at ``as_of``."""
    periods = f"filter(transform({jobs}, j -> {dt.period('j.dates', as_of)}), p -> p IS NOT NULL)"
    return st.let("sps", periods, st.let("sp", (
        "CASE WHEN size(sps) > 0 THEN named_struct("
        "'starts', array_min(transform(sps, p -> p.starts)), "
        f"'ends', least(array_max(transform(sps, p -> p.ends)), trunc({as_of}, 'MM'))) END"
    ), "CASE WHEN sp.ends >= sp.starts THEN sp END"))


def span_months(jobs: str, as_of: str) -> str:
    return st.let("ss", span(jobs, as_of), dt.months_inclusive("ss.starts", "ss.ends"))


def experience_for_tenure() -> str:
    """Master jobs, or the tailored ones when the master has none."""
    return "CASE WHEN size(master) > 0 THEN master ELSE tailored END"


def drift_issues() -> str:
    """Fields of each job that differ from the master, by position."""
    tests = ", ".join(
        when(f"z.m.{f} <> '' AND trim(z.t.{f}) <> trim(z.m.{f})",
             issue(f"{f} drifted", "z.i + 1", f"z.t.{f}"))
        for f in ("title", "company", "dates"))
    zipped = ("transform(master, (m, i) -> named_struct('i', i, 'm', m, 't', get(tailored, i)))")
    return (f"CASE WHEN is_structured AND size(master) = size(tailored) THEN "
            f"flatten(transform({zipped}, z -> filter(array({tests}), x -> x IS NOT NULL))) "
            f"ELSE {NO_ISSUES} END")


def restored_jobs() -> str:
    """Tailored jobs with drifted header fields set back to the master's."""
    def keep(f: str) -> str:
        return (f"CASE WHEN get(master, i).{f} <> '' AND trim(j.{f}) <> trim(get(master, i).{f}) "
                f"THEN get(master, i).{f} ELSE j.{f} END")

    return (f"CASE WHEN is_structured AND size(master) = size(tailored) THEN transform(tailored, "
            f"(j, i) -> named_struct('title', {keep('title')}, 'company', {keep('company')}, "
            f"'dates', {keep('dates')}, 'bullets', j.bullets)) ELSE tailored END")


def bullets_where(jobs: str, test: str) -> str:
    """Distinct bullets of all jobs for which ``test`` (over ``x``) holds, so that a repeated one is read once."""
    every = f"flatten(transform({jobs}, j -> coalesce(j.bullets, CAST(array() AS ARRAY<STRING>))))"
    return f"filter(array_distinct({every}), x -> {test})"


def excess_positions(bullets: str, rivals: str) -> str:
    """Bullets naming a rival family beyond the allowance; ``rivals`` lists those that name one."""
    rival = ln.positions(bullets, f"array_contains({rivals}, x)")
    return st.let("xp", rival, f"slice(xp, {lx.COMPETING_ALLOWANCE + 1}, size(xp))")


def certification_issue() -> str:
    drift = ("is_structured AND size(master_certs) > 0 AND NOT tailored_certs <=> master_certs")
    cue = ("NOT is_structured AND size(tailored_certs) = 0 AND "
           "(contains(lower(raw_text), 'certif') OR contains(lower(raw_text), 'license'))")
    return (f"CASE WHEN {drift} THEN array({issue('certifications drifted', 'NULL', chr(39) * 2)}) "
            f"WHEN {cue} THEN array({issue('certifications missing', 'NULL', chr(39) * 2)}) "
            f"ELSE {NO_ISSUES} END")


def audit(rows: DataFrame, as_of: str, key: str = "doc_id") -> DataFrame:
    """(key, issues, is_clean, corrected jobs, certifications, summary)."""
    df = rows.withColumns({
        "drift": F.expr(drift_issues()), "jobs": F.expr(restored_jobs()),
        "primary": F.expr(sk.resolve("main_stack")),
        "cert_issue": F.expr(certification_issue()),
    })
    rivals = (f"CASE WHEN primary IS NULL THEN CAST(array() AS ARRAY<STRING>) "
              f"ELSE {bullets_where('jobs', sk.names_rival('x', 'primary'))} END")
    df = df.withColumn("jobs", F.expr(st.let("rv", rivals, (
        f"transform(jobs, j -> named_struct('title', j.title, "
        f"'new_title', {sk.neutral_title('j.title', 'primary')}, 'company', j.company, "
        f"'dates', j.dates, 'bullets', j.bullets, 'excess', CASE WHEN primary IS NULL "
        f"THEN CAST(array() AS ARRAY<INT>) ELSE {excess_positions('j.bullets', 'rv')} END))"))))
    df = df.withColumn("jobs", F.expr(
        f"transform(jobs, j -> named_struct('title', j.title, 'new_title', j.new_title, "
        f"'company', j.company, 'dates', j.dates, 'n_excess', size(j.excess), "
        f"'bullets', transform(j.bullets, (b, i) -> CASE WHEN array_contains(j.excess, i) "
        f"THEN {sk.toward('b', 'primary')} ELSE b END)))"))
    df = df.withColumn("jobs", F.expr(
        f"transform(jobs, j -> named_struct('title', j.title, 'new_title', j.new_title, "
        f"'company', j.company, 'dates', j.dates, 'n_excess', j.n_excess, "
        f"'n_before', size(j.bullets), 'bullets', "
        f"{ln.first_by_key('j.bullets', f'lower({st.collapse(chr(120))})')}, "
        f"'ends', {dt.period('j.dates', as_of)}.ends))"))
    df = df.withColumn("jobs", F.expr(st.let("dv", bullets_where("jobs", sk.may_name_technology("x")), (
        f"transform(jobs, j -> named_struct('title', j.title, 'new_title', j.new_title, "
        f"'company', j.company, 'dates', j.dates, 'n_excess', j.n_excess, "
        f"'n_before', j.n_before, 'n_after', size(j.bullets), 'ends', j.ends, 'bullets', j.bullets, "
        f"'final', transform(j.bullets, b -> CASE WHEN array_contains(dv, b) "
        f"THEN {sk.neutral_era('b', 'j.ends')} ELSE b END)))"))))
    df = df.withColumn("months", F.expr(span_months(experience_for_tenure(), as_of)))
    df = df.withColumn("phrase", F.expr(dt.tenure_phrase("months")))
    df = df.withColumn("new_summary", F.expr(tx.with_tenure("summary", "phrase")))

    def per_job(entries: list[str], job: str = "i + 1") -> str:
        return (f"flatten(transform(jobs, (j, i) -> filter(array({', '.join(entries)}), "
                f"x -> x IS NOT NULL)))")

    stack = per_job([
        when("j.new_title <> j.title", issue("title off stack", "i + 1", "j.new_title")),
        when("j.n_excess > 0", issue("bullets off stack", "i + 1", "CAST(j.n_excess AS STRING)")),
    ])
    counts = per_job([
        when("j.n_before > j.n_after",
             issue("duplicate bullets", "i + 1", "CAST(j.n_before - j.n_after AS STRING)")),
        when(f"j.n_after <> {lx.BULLETS_PER_JOB}",
             issue("bullet count", "i + 1", "CAST(j.n_after AS STRING)")),
    ])
    eras = per_job([
        when("NOT j.final <=> j.bullets", issue(
            "anachronism", "i + 1",
            f"array_join(array_sort(transform({sk.forbidden('j.ends')}, r -> r.rule_key)), ', ')")),
    ])
    tenure = (f"CASE WHEN new_summary <> coalesce(summary, '') AND phrase IS NOT NULL THEN "
              f"array({issue('tenure restated', 'NULL', 'phrase')}) ELSE {NO_ISSUES} END")
    df = df.withColumn("issues", F.expr(
        f"concat(drift, {stack}, cert_issue, {counts}, {eras}, {tenure})"))
    return df.selectExpr(
        key, "primary", "issues", "size(issues) = 0 AS is_clean",
        "transform(jobs, j -> named_struct('title', j.new_title, 'company', j.company, "
        "'dates', j.dates, 'bullets', j.final)) AS experience",
        "CASE WHEN is_structured AND size(master_certs) > 0 THEN master_certs "
        "ELSE tailored_certs END AS certifications",
        "new_summary AS summary",
    )


def unmeasured(bullets: str) -> str:
    """Bullets without any digit."""
    return f"filter({bullets}, b -> NOT {st.matches('b', r'\p{Nd}')})"


# --- gap closing ---------------------------------------------------------------------
def _bare(array: str) -> str:
    return f"transform({array}, e -> {st.strip('substring_index(e, ' + chr(39) + ' (related:' + chr(39) + ', 1)')})"


#: Marks a word boundary in a text; no stored text holds this character.
EDGE = "\\u0001"


def _edged(value: str) -> str:
    """A text with every word boundary marked, so that whole words are plain substrings."""
    return f"regexp_replace({value}, r'\\b', '{EDGE}')"


def _stands_alone(term: str, edged: str) -> str:
    """Whether a term stands alone in a marked text, as between two word boundaries."""
    return f"contains({edged}, concat('{EDGE}', trim(BOTH '{EDGE}' FROM {_edged(term)}), '{EDGE}'))"


def close_gaps(rows: DataFrame, key: str = "doc_id", woven: int | None = None) -> DataFrame:
    """Add supported skills a tailored profile omits and weave preferred ones in.

    ``woven`` bounds the preferred terms that enter the summary; all do by default.

    ``rows`` carries match lists (matched_skills, transferable_skills,
    preferred_matched, preferred_transferable), the grouped skills as an array
    of struct(grp, term), the profile's own skill spellings and the summary. Where it
    also carries the career ``phrase``, that enters the summary last of all.
    Terms are added in order and each one sees the text grown by earlier ones,
    hence the fold. ``notes`` tells what was done: (rule, detail).
    """
    preferred = tx.distinct_folded(f"concat(preferred_matched, {_bare('preferred_transferable')})")
    df = rows.withColumn("preferred", F.expr(preferred))
    df = df.withColumn("candidates", F.expr(
        f"array_distinct(concat(preferred, matched_skills, {_bare('transferable_skills')}))"))
    df = df.withColumn("start_text", F.expr(_edged("lower(array_join(transform(skills, s -> s.term), ' '))")))
    step = (
        "aggregate(candidates, named_struct('txt', start_text, 'added', "
        "CAST(array() AS ARRAY<STRUCT<grp: STRING, term: STRING, kind: STRING>>)), "
        "(a, c) -> " + st.let("t", f"lower({st.strip('c')})", st.let("g", tx.skill_category("c"), (
            f"CASE WHEN t = '' OR g IS NULL OR {_stands_alone('t', 'a.txt')} THEN a ELSE named_struct("
            f"'txt', concat(a.txt, ' ', {_edged('t')}), 'added', concat(a.added, array(named_struct("
            f"'grp', g, 'term', {tx.display_form('c', 'cv_skills')}, 'kind', "
            f"CASE WHEN exists(preferred, p -> lower(p) = lower(c)) THEN 'preferred' "
            f"ELSE 'matched/transferable' END)))) END"))) + ", a -> a.added)"
    )
    df = df.withColumn("added", F.expr(step))
    df = df.withColumn("clean_summary", F.expr(tx.summary_prose("summary")))
    missing = st.let("es", _edged("lower(clean_summary)"), f"filter(preferred, p -> NOT {_stands_alone('lower(p)', 'es')})")
    df = df.withColumn("woven", F.expr(st.first(missing, woven)))
    sentence = (f"concat('Additional strengths include ', {tx.prose_list('woven')}, "
                f"', aligned with this role\\'s preferred qualifications.')")
    df = df.withColumn("closed", F.expr(
        f"CASE WHEN size(woven) = 0 THEN clean_summary ELSE trim(concat(clean_summary, ' ', {sentence})) END"))
    restated = "phrase" in rows.columns
    df = df.withColumn("final", F.expr(tx.with_tenure("closed", "phrase") if restated else "closed"))
    note = "CASE WHEN {0} THEN named_struct('rule', '{1}', 'detail', {2}) END"
    notes = ", ".join([
        note.format(f"clean_summary <> {st.strip(chr(99) + 'oalesce(summary, ' + chr(39) * 2 + ')')}", "dump removed", "''"),
        note.format("size(woven) > 0", "preferred terms woven in", "array_join(woven, ', ')"),
        note.format("phrase IS NOT NULL AND final <> closed" if restated else "false", "tenure restated", "phrase" if restated else "''"),
    ])
    added = "transform(added, a -> named_struct('rule', 'skill added', 'detail', concat(a.term, ' (', a.grp, ', ', a.kind, ')')))"
    return df.selectExpr(
        key, "added", "woven", "final AS summary",
        f"concat({added}, filter(array({notes}), n -> n IS NOT NULL)) AS notes")
