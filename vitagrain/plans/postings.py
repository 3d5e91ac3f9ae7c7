"""Free-text postings to structured analyses: one projection per posting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagrain.functions import lexicon as lx
from vitagrain.functions import sqltext as st
from vitagrain.functions import text as tx
from vitagrain.functions import tokens as tk
from vitagrain.operators import lines as ln

# Posting headings by section; "none" clears the section.
HEADINGS = [
    ("required", r"(?i)^(requirements?|required\s+skills?|must[\s-]have|qualifications?|"
                 r"minimum\s+qualifications?|what\s+you.?ll\s+need|you\s+have|"
                 r"basic\s+qualifications?)\s*:?\s*$"),
    ("preferred", r"(?i)^(preferred|preferred\s+skills?|preferred\s+qualifications?|"
                  r"nice[\s-]to[\s-]have|bonus\s+points?|pluses?|good\s+to\s+have|desirable|"
                  r"additional\s+skills?|optional\s+skills?)\s*:?\s*$"),
    ("responsibilities", r"(?i)^(responsibilities|what\s+you.?ll\s+do|the\s+role|duties|"
                         r"day[\s-]to[\s-]day|key\s+responsibilities)\s*:?\s*$"),
    ("none", r"(?i)^(about(\s+us)?|role\s+overview|company|benefits|compensation|why\s+join|"
             r"the\s+team|overview|location|equal\s+opportunity|perks)\s*:?\s*$"),
]


def heading(line: str) -> str:
    """Section a line opens, null for content."""
    return "CASE " + " ".join(f"WHEN {st.matches(line, p)} THEN '{k}'" for k, p in HEADINGS) + " END"


def item(line: str) -> str:
    return st.strip(st.replace(line, tx.POSTING_BULLET))


def section_items(segments: str, longest: int | None = None) -> str:
    """(section, item) of every line, of any length unless `longest` is given; inline cues reroute to preferred."""
    short = "" if longest is None else f" AND length(x) <= {longest}"
    per_line = (
        f"transform(filter(transform(s.lines, x -> {item('x')}), "
        f"x -> x <> ''{short}), x -> named_struct('section', "
        f"CASE WHEN s.kind = 'required' AND {st.matches('x', tx.INLINE_PREFERRED)} "
        f"THEN 'preferred' ELSE s.kind END, 'item', x))")
    return f"flatten(transform(filter({segments}, s -> s.kind <> 'none'), s -> {per_line}))"


def of_section(items: str, section: str, limit: int | None = None) -> str:
    return st.first(f"transform(filter({items}, t -> t.section = '{section}'), t -> t.item)", limit)


def job_title(lines: str) -> str:
    """A labelled title in the first five lines, else a role line in the first three."""
    labelled = (f"get(filter(transform(slice({lines}, 1, 5), x -> regexp_extract(x, "
                f"{st.raw(tx.TITLE_PREFIX)}, 1)), x -> x <> ''), 0)")
    role = (f"get(filter(slice({lines}, 1, 3), x -> x <> '' AND length(x) <= 80 "
            f"AND {st.matches('x', tx.ROLE_WORD)}), 0)")
    return (f"coalesce({st.strip(labelled, ' -–—')}, {st.strip(role, ' -–—:')}, '')")


def analyse(postings: DataFrame, key: str = "item_id", text: str = "text", per_category: int | None = None,
            preferred: int | None = None, longest: int | None = None) -> DataFrame:
    """One structured analysis per posting.

    per_category and preferred bound the length of each list, longest the length of
    a line that counts; none of them cuts anything by default.
    """
    df = postings.withColumns({
        "keywords": F.expr(tk.keywords(text)),
        "lower_text": F.lower(text),
        "lines": F.expr(tx.all_lines(text)),
        "years": F.expr(tx.years_required(text)),
    })
    heads = f"transform(lines, x -> named_struct('kind', {heading('x')}, 'rest', ''))"
    df = df.withColumn("items", F.expr(section_items(ln.sections("lines", heads), longest)))
    df = df.withColumns({
        "required_skills": F.expr(of_section("items", "required", per_category)),
        "preferred_skills": F.expr(of_section("items", "preferred", preferred)),
        "responsibilities": F.expr(of_section("items", "responsibilities", per_category)),
    })
    both = "concat(required_skills, preferred_skills)"
    qualifies = st.matches("x", tx.QUALIFICATION)
    return df.selectExpr(
        key, text, "keywords", "required_skills", "preferred_skills",
        f"array_sort(array_intersect(keywords, {st.array(lx.TECHNOLOGIES)})) AS technologies",
        "responsibilities",
        f"{tx.seniority(text, 'years')} AS seniority",
        f"{job_title('lines')} AS target_job_title",
        *[f"{tx.vocabulary_hits('keywords', 'lower_text', terms, per_category)} AS {name}"
          for name, terms in lx.CATEGORIES.items()],
        f"{tx.business_domain('lower_text')} AS business_domain",
        f"{st.first(f'filter({both}, x -> {qualifies})', per_category)} AS qualifications",
        f"{tx.certifications(text, per_category)} AS certifications",
        "years AS required_years_experience",
    )


def requirement_text() -> str:
    """Structured requirement text of an analysis, else the whole posting."""
    fields = ("concat(required_skills, preferred_skills, technologies, responsibilities, "
              "methodologies, soft_skills, "
              "filter(array(target_job_title), t -> t <> ''))")
    return st.let("fs", fields, "CASE WHEN size(fs) > 0 THEN array_join(fs, ' ') ELSE text END")


def all_terms() -> str:
    """Union of every term source of an analysis."""
    lists = ", ".join(["technologies", *lx.MATCH_CATEGORIES])
    lines = (f"flatten(transform(concat(required_skills, preferred_skills), "
             f"x -> {tk.keywords('x')}))")
    return f"array_sort(array_distinct(concat({lists}, {lines})))"


def preferred_terms() -> str:
    """Meaningful terms of the preferred lines, with categorised terms they name."""
    known = st.items(sorted(set(lx.TECHNOLOGIES) | set(lx.CATEGORIES["methodologies"])))
    meaningful = (
        f"t NOT IN ({st.items(lx.PREFERRED_NOISE)}) AND (t IN ({known}) OR (length(t) >= 4 "
        f"AND {st.matches('translate(t, ' + chr(39) + './' + chr(39) + ', ' + chr(39) * 2 + ')', '^[A-Za-z0-9]+$')}))")
    tokens = (f"filter(flatten(transform(preferred_skills, x -> {tk.keywords('x')})), "
              f"t -> {meaningful})")
    named = (f"filter(concat({', '.join(lx.MATCH_CATEGORIES)}), "
             f"t -> contains(lower(array_join(preferred_skills, ' ')), t))")
    return f"array_sort(array_distinct(concat({tokens}, {named})))"
