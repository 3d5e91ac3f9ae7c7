"""Grouping of ordered lines inside one document (Spark SQL expression text).

A document is one row and its lines are one array, so state that depends on
earlier lines is expressed by positions: find the lines that open a group, then
slice between them. That is linear in the lines and needs no shuffle, no sort
and no window.
"""

from __future__ import annotations

from vitagrain.functions import sqltext as st


def positions(array: str, test: str) -> str:
    """Zero-based positions where ``test`` (over ``x``) holds."""
    return (f"filter(transform({array}, (x, i) -> CASE WHEN {test} THEN i END), "
            f"i -> i IS NOT NULL)")


def slices(array: str, starts: str) -> str:
    """Slices of an array, one from each start up to the next."""
    return st.let("ar", array, st.let("sa", starts, (
        "transform(sa, (s, j) -> slice(ar, s + 1, coalesce(get(sa, j + 1), size(ar)) - s))"
    )))


def groups_from(array: str, opens: str) -> str:
    """Groups opened by the first item and by every item where ``opens`` holds."""
    return st.let("ga", array, slices(
        "ga", f"array_distinct(concat(CASE WHEN size(ga) > 0 THEN array(0) ELSE "
              f"CAST(array() AS ARRAY<INT>) END, {positions('ga', opens)}))"))


def trailing_run(flags: str) -> str:
    """Length of the run of true values at the end of a boolean array."""
    return st.let("fl", flags, st.let("fp", "array_position(reverse(fl), false)",
                                      "CAST(CASE WHEN fp = 0 THEN size(fl) ELSE fp - 1 END AS INT)"))


def sections(lines: str, heads: str) -> str:
    """Segments (kind, lines) of a document; content glued to a heading is kept.

    ``heads`` runs parallel to ``lines`` and holds struct(kind, rest).
    """
    return st.let("sl", lines, st.let("sh", heads, st.let(
        "sp", positions("sh", "x.kind IS NOT NULL"), (
            "transform(sp, (p, j) -> named_struct('kind', get(sh, p).kind, 'lines', concat("
            "CASE WHEN get(sh, p).rest <> '' THEN array(get(sh, p).rest) "
            "ELSE CAST(array() AS ARRAY<STRING>) END, "
            "slice(sl, p + 2, coalesce(get(sp, j + 1), size(sl)) - p - 1))))"
        ))))


def section_lines(segments: str, kind: str) -> str:
    return f"flatten(transform(filter({segments}, s -> s.kind = '{kind}'), s -> s.lines))"


def job_islands(kinds: str) -> str:
    """Lines of each job of one experience segment.

    A boundary line opens a job. Title or employer lines parked at the end of
    the previous job move to the new one; before the first boundary only such
    lines are kept at all.
    """
    parts = (
        "transform(jb, (b, j) -> named_struct('open', get(jk, b), "
        "'body', slice(jk, b + 2, coalesce(get(jb, j + 1), size(jk)) - b - 1), "
        "'run', CASE WHEN j = size(jb) - 1 THEN 0 ELSE "
        + trailing_run("transform(slice(jk, b + 2, get(jb, j + 1) - b - 1), x -> x.trailing)")
        + " END))"
    )
    pending = "filter(slice(jk, 1, get(jb, 0)), x -> x.title OR x.company)"
    joined = (
        f"transform(jp, (q, j) -> concat(CASE WHEN j = 0 THEN {pending} "
        f"ELSE slice(get(jp, j - 1).body, size(get(jp, j - 1).body) - get(jp, j - 1).run + 1, "
        f"get(jp, j - 1).run) END, array(q.open), "
        f"slice(q.body, 1, size(q.body) - q.run)))"
    )
    return st.let("jk", kinds, st.let("jb", positions("jk", "x.boundary"), st.let(
        "jp", parts, joined)))


def header_size(kinds: str) -> str:
    """First line plus up to two more while they continue the header."""
    return (f"CASE WHEN NOT coalesce(get({kinds}, 1).continues, false) THEN 1 "
            f"WHEN NOT coalesce(get({kinds}, 2).continues, false) THEN 2 ELSE 3 END")


def merge_wrapped(lines: str, marker: str, strip_marker: str) -> str:
    """Join continuation lines onto the marked line above, if any line is marked."""
    merged = (f"filter(transform({groups_from('wl', marker)}, g -> array_join("
              f"transform(g, (x, i) -> CASE WHEN i = 0 THEN {strip_marker} ELSE x END), ' ')), "
              f"x -> x <> '')")
    return st.let("wl", lines, f"CASE WHEN exists(wl, x -> {marker}) THEN {merged} ELSE wl END")


def first_by_key(values: str, key: str) -> str:
    """Keep the first value of each key (over ``x``), in order."""
    keyed = f"sort_array(transform({values}, (x, i) -> named_struct('k', {key}, 'i', i, 'v', x)))"
    return st.let("kd", keyed, (
        "transform(sort_array(transform(filter(kd, (s, j) -> j = 0 OR s.k <> get(kd, j - 1).k), "
        "s -> named_struct('i', s.i, 'v', s.v))), s -> s.v)"))


def jobs_by_bullets(kinds: str) -> str:
    """Groups where a non-bullet that follows a bullet opens a new job.

    ``kinds`` is an array of struct(line, bullet).
    """
    opens = "NOT x.bullet AND i > 0 AND get(gb, i - 1).bullet"
    starts = (f"concat(CASE WHEN size(gb) > 0 THEN array(0) ELSE CAST(array() AS ARRAY<INT>) END, "
              f"{positions('gb', opens)})")
    return st.let("gb", kinds, slices("gb", starts))


def filled(jobs: str, size: int | None = None) -> str:
    """Each job's distinct bullets, topped up from its siblings' unseen ones."""
    own = "array_distinct(get(fj, i))"
    pool = f"array_except(flatten(filter(fj, (y, k) -> k <> i)), {own})"
    return st.let("fj", jobs, f"transform(fj, (x, i) -> {st.first(f'concat({own}, {pool})', size)})")


def aligned(questions: str, drafts: str) -> str:
    """Answer of each question: the draft of the same wording, else the first left.

    A fold, because every question consumes one draft. ``drafts`` holds
    struct(question, answer); the result is an array of nullable answers.
    """
    wording = st.collapse("{0}")
    hit = (f"CAST(array_position(transform(a.rest, d -> lower({wording.format('d.question')})), "
           f"lower(q)) AS INT)")
    use = f"CASE WHEN {hit} = 0 AND size(a.rest) > 0 THEN 1 ELSE {hit} END"
    step = st.let("u", use, (
        "named_struct('rest', filter(a.rest, (d, i) -> i <> u - 1), "
        "'out', concat(a.out, array(get(a.rest, u - 1).answer)))"))
    start = (f"named_struct('rest', filter({drafts}, d -> trim(d.answer) <> ''), "
             f"'out', CAST(array() AS ARRAY<STRING>))")
    return f"aggregate({questions}, {start}, (a, q) -> {step}, a -> a.out)"


def digest(jobs: str, n_jobs: int | None = None, n_bullets: int | None = None) -> str:
    """Short text of the first jobs and their first bullets, of all of them by default."""
    bullets = (f"array_join(transform({st.first('j.bullets', n_bullets)}, "
               f"b -> concat('  - ', b)), '\\n')")
    block = f"concat(j.title, ' at ', j.company, ' (', j.dates, ')\\n', {bullets})"
    joined = f"array_join(transform({st.first(jobs, n_jobs)}, j -> {block}), '\\n\\n')"
    return f"coalesce(nullif({joined}, ''), '(no experience listed)')"
