"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from vitagrain.functions import lexicon as lx


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def tokens(text: str) -> str:
    """Distinct keyword list of a text expression."""
    raw = f"regexp_extract_all(lower({text}), '[A-Za-z][A-Za-z0-9+.#/_-]{{1,}}')"
    trimmed = f"list_transform(list_distinct({raw}), lambda t: trim(t, '.,-'))"
    parts = (f"flatten(list_transform(list_filter({trimmed}, lambda t: contains(t, '/')), "
             f"lambda t: list_transform(string_split(t, '/'), lambda p: trim(p, '.,-'))))")
    return (f"list_sort(list_distinct(list_filter(list_concat({trimmed}, {parts}), "
            f"lambda t: length(t) > 2 AND NOT list_contains([{quoted(lx.STOPWORDS)}], t))))")


def stem(t: str) -> str:
    arms = []
    roots: dict[str, list[str]] = {}
    for word, root in lx.WORD_FAMILIES.items():
        roots.setdefault(root, []).append(word)
    for root, words in roots.items():
        arms.append(f"WHEN {t} IN ({quoted(words)}) THEN '{root}'")
    return (
        f"CASE {' '.join(arms)} WHEN length({t}) <= 5 THEN {t} "
        f"WHEN suffix({t}, 'ies') AND length({t}) > 6 THEN {t}[:-4] || 'y' "
        f"WHEN suffix({t}, 'ing') AND length({t}) > 6 THEN {t}[:-4] "
        f"WHEN suffix({t}, 'edly') AND length({t}) > 7 THEN {t}[:-5] "
        f"WHEN suffix({t}, 'ed') THEN {t}[:-3] WHEN suffix({t}, 'es') THEN {t}[:-3] "
        f"WHEN suffix({t}, 's') THEN {t}[:-2] ELSE {t} END"
    )


def exploded(table: str, key: str, text: str = "text") -> str:
    """(key, term, stem) rows of a table."""
    return (f"SELECT {key}, term, {stem('term')} AS stem FROM "
            f"(SELECT {key}, unnest({tokens(text)}) AS term FROM {table})")
