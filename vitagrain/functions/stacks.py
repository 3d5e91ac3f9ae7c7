"""Primary-stack families and era rules (Spark SQL expression text)."""

from __future__ import annotations

from vitagrain.functions import dates as dt
from vitagrain.functions import lexicon as lx
from vitagrain.functions import sqltext as st
from vitagrain.functions import text as tx

NOT_WORD_BEFORE, NOT_WORD_AFTER = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"


def _by_length(markers):
    return sorted(markers, key=len, reverse=True)


def resolve(stack: str) -> str:
    """Family of a free-text stack: its longest marker decides, order breaks ties."""
    ranked = sorted(
        ((m, f) for f, ms in lx.STACK_FAMILIES.items() for m in ms), key=lambda p: -len(p[0]))
    arms = " ".join(
        f"WHEN contains(hay, {st.text(m)}) OR contains(bare, {st.text(m.replace('.', ''))}) "
        f"THEN '{f}'" for m, f in ranked)
    hay = st.collapse(f"replace(replace(replace(lower(coalesce({stack}, '')), 'c#', 'csharp'), "
                      f"'f#', 'fsharp'), '#', ' ')")
    return st.let("hay", hay, st.let(
        "bare", "replace(hay, '.', '')", f"CASE WHEN hay = '' THEN NULL {arms} END"))


def _loose(marker: str) -> bool:
    """Markers matched anywhere; the rest must stand alone."""
    return " " in marker or "." in marker or "#" in marker


def _holds_any(markers, lower: str) -> str:
    """Whether a lower-case text holds a marker; one that holds another marker needs no test of its own."""
    folded = sorted({m.lower() for m in markers})
    least = [m for m in folded if not any(o != m and o in m for o in folded)]
    return " OR ".join(f"contains({lower}, {st.text(m)})" for m in least)


def _present(family: str, value: str, lower: str) -> str:
    markers = lx.STACK_FAMILIES[family]
    loose = [m for m in markers if _loose(m)]
    tests = [_holds_any(loose, lower)] if loose else []
    whole = [m for m in markers if not _loose(m)]
    if whole:
        words = "|".join(tx.escaped(m) for m in whole)
        hint = _holds_any(whole, lower)  # a match holds one of these
        tests.append(f"(({hint}) AND {st.matches(value, f'(?i){NOT_WORD_BEFORE}(?:{words}){NOT_WORD_AFTER}')})")
    return f"({' OR '.join(tests)})"


def competing(value: str, primary: str) -> str:
    """Rival families a text names, in family order."""
    tests = ", ".join(
        f"CASE WHEN {primary} <> '{f}' AND {_present(f, 'cv', 'cl')} THEN '{f}' END"
        for f in lx.STACK_FAMILIES)
    return st.let("cv", value, st.let("cl", "lower(cv)", (
        f"filter(array({tests}), f -> f IS NOT NULL)")))


def names_rival(value: str, primary: str) -> str:
    """Whether a text names a rival family."""
    tests = " OR ".join(f"({primary} <> '{f}' AND {_present(f, 'cv', 'cl')})" for f in lx.STACK_FAMILIES)
    return st.let("cv", value, st.let("cl", "lower(cv)", tests))


def _rivals(primary: str, bounded: bool) -> str:
    """One pattern over every rival marker, longest first."""
    markers = _by_length(m for f, ms in lx.STACK_FAMILIES.items() if f != primary for m in ms)
    parts = [
        tx.escaped(m) if _loose(m) and not bounded
        else f"{NOT_WORD_BEFORE}{tx.escaped(m)}{NOT_WORD_AFTER}" for m in markers
    ]
    return f"(?i)(?:{'|'.join(parts)})"


def toward(value: str, primary: str) -> str:
    """Rewrite rival wording onto the primary stack."""
    arms = []
    for family, markers in lx.STACK_FAMILIES.items():
        out = value
        for pattern, by in lx.STACK_REWRITES.get(family, []):
            out = st.replace(out, pattern, by)
        out = st.replace(out, _rivals(family, False), markers[0])
        out = f"regexp_replace({st.replace(out, r'\s{2,}', ' ')}, {st.raw(r'\s+([,/;|])')}, '$1')"
        arms.append(f"WHEN '{family}' THEN {st.strip(out, ' -–—/|,;')}")
    return f"CASE {primary} {' '.join(arms)} ELSE {value} END"


def neutral_title(title: str, primary: str) -> str:
    """Drop rival stack words from a title; keep seniority and role words."""
    arms = []
    for family in lx.STACK_FAMILIES:
        out = st.replace(title, _rivals(family, True), " ")
        for pattern, by in [(r"\s*[|/]\s*[|/]\s*", " / "), (r"\s{2,}", " "),
                            (r"\s*/\s*$", ""), (r"^\s*/\s*", "")]:
            out = st.replace(out, pattern, by)
        arms.append(f"WHEN '{family}' THEN coalesce(nullif({st.strip(out, ' -–—/|,')}, ''), {title})")
    return f"CASE {primary} {' '.join(arms)} ELSE {title} END"


# --- eras --------------------------------------------------------------------------
def era_rules() -> list[tuple[str, str, list[str]]]:
    """(key, introduction month, aliases): aliases of one month share a rule."""
    months: dict[str, list[str]] = {}
    for alias, month in lx.TECH_INTRODUCED.items():
        months.setdefault(month, []).append(alias)
    return [(min(names, key=lambda n: (len(n) > 4, len(n))), month, _by_length(names))
            for month, names in months.items()]


def _alias_test(alias: str, value: str, lower: str) -> str:
    """Whether a text, given with its lower-case form, names an alias; the pattern only runs where it can."""
    if " " in alias or "-" in alias:
        return f"contains({lower}, {st.text(alias)})"
    pattern = f"(?i){NOT_WORD_BEFORE}{tx.escaped(alias)}{NOT_WORD_AFTER}"
    return f"(contains({lower}, {st.text(alias.lower())}) AND {st.matches(value, pattern)})"


def era_rule_array() -> str:
    """Literal array of struct(rule_key, introduced)."""
    return "array(" + ", ".join(
        f"named_struct('rule_key', {st.text(k)}, 'introduced', DATE'{m}')"
        for k, m, _ in era_rules()) + ")"


def forbidden(ends: str) -> str:
    """Rules a job ending then may not mention; unknown ends forbid nothing."""
    return f"filter({era_rule_array()}, r -> NOT {dt.allows(ends, 'r.introduced')})"


def mentions(value: str) -> str:
    """struct(rule_key, alias, introduced) of every alias a text names."""
    tests = ", ".join(
        f"CASE WHEN {_alias_test(a, 'mv', 'ml')} THEN named_struct('rule_key', {st.text(k)}, "
        f"'alias', {st.text(a)}, 'introduced', DATE'{m}') END"
        for k, m, aliases in era_rules() for a in aliases)
    return st.let("mv", value, st.let("ml", "lower(mv)", f"filter(array({tests}), m -> m IS NOT NULL)"))


def may_name_technology(value: str) -> str:
    """Whether a text holds the letters of any alias; without them no era rule changes it."""
    return st.let("nl", f"lower({value})", f"({_holds_any(lx.TECH_INTRODUCED, 'nl')})")


def neutral_era(value: str, ends: str) -> str:
    """Replace mentions of technologies newer than the job with neutral wording.

    One pass looks for any such mention; only texts that have one go through the rules.
    """
    def newer(month: str) -> str:
        return f"NOT {dt.allows(ends, f'DATE{chr(39)}{month}{chr(39)}')}"

    found = " OR ".join(f"({newer(month)} AND ({' OR '.join(_alias_test(a, 'nv', 'nl') for a in aliases)}))"
                        for _, month, aliases in era_rules())
    out = "nv"
    for key, month, aliases in era_rules():
        named = " OR ".join(_alias_test(a, "ev", "lower(ev)") for a in aliases)
        new = "ev"
        is_protocol = "mcp" in aliases
        for alias, pattern, by in lx.ERA_SUBSTITUTIONS:
            if alias in aliases:
                new = st.replace(new, pattern, by)
        for alias in ([] if is_protocol else aliases):
            pattern = f"(?i){tx.escaped(alias)}" if " " in alias else \
                f"(?i){NOT_WORD_BEFORE}{tx.escaped(alias)}{NOT_WORD_AFTER}"
            new = st.replace(new, pattern, lx.ERA_FALLBACK)
        out = st.let("ev", out, f"CASE WHEN {newer(month)} AND ({named}) THEN {new} ELSE ev END")
    tidy = f"regexp_replace({st.replace('nw', r'\s{2,}', ' ')}, {st.raw(r'\s+([,.;:])')}, '$1')"
    changed = st.let("nw", out, f"CASE WHEN nw = nv THEN nv ELSE {st.strip(tidy, ' -–,;')} END")
    return st.let("nv", value, st.let("nl", "lower(nv)", f"CASE WHEN {found} THEN {changed} ELSE nv END"))
