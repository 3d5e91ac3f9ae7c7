"""Keyword tokens and stems as row-local arrays (Spark SQL expression text).

A text never leaves its row: tokens are de-duplicated before any further work,
so cost follows the number of distinct words rather than the text length.
"""

from __future__ import annotations

from vitagrain.functions import lexicon as lx
from vitagrain.functions import sqltext as st

# What counts as a token, and what is trimmed from its edges.
TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9+.#/_-]{1,}"
EDGE = "'.,-'"


def raw_tokens(text: str) -> str:
    """Distinct lower-case tokens, edges trimmed."""
    return (f"transform(array_distinct(regexp_extract_all(lower({text}), "
            f"{st.raw(TOKEN_PATTERN)}, 0)), t -> trim(BOTH {EDGE} FROM t))")


def with_slash_parts(tokens: str) -> str:
    """Tokens followed by the parts of every slash compound."""
    return st.let(
        "ts", tokens,
        f"concat(ts, flatten(transform(filter(ts, t -> contains(t, '/')), "
        f"t -> transform(split(t, '/'), p -> trim(BOTH {EDGE} FROM p)))))",
    )


def drop_stopwords(tokens: str) -> str:
    """Distinct tokens longer than two characters that are not stopwords."""
    return f"array_distinct(filter({tokens}, t -> length(t) > 2 AND t NOT IN ({st.items(lx.STOPWORDS)})))"


def keywords(text: str) -> str:
    """Sorted distinct keywords of a text."""
    return f"sort_array({drop_stopwords(with_slash_parts(raw_tokens(text)))})"


_FAMILY_MAP = "str_to_map({}, ',', ':')".format(
    st.text(",".join(f"{word}:{root}" for word, root in lx.WORD_FAMILIES.items()))
)


def stem(t: str) -> str:
    """Light stem: word family first, then one suffix from longer words.

    The membership test is a hash lookup, so the map is only searched for the
    few tokens that belong to a family.
    """
    return (
        f"CASE WHEN {t} IN ({st.items(lx.WORD_FAMILIES)}) THEN element_at({_FAMILY_MAP}, {t}) "
        f"WHEN length({t}) <= 5 THEN {t} "
        f"WHEN endswith({t}, 'ies') AND length({t}) > 6 "
        f"THEN concat(left({t}, length({t}) - 3), 'y') "
        f"WHEN endswith({t}, 'ing') AND length({t}) > 6 THEN left({t}, length({t}) - 3) "
        f"WHEN endswith({t}, 'edly') AND length({t}) > 7 THEN left({t}, length({t}) - 4) "
        f"WHEN endswith({t}, 'ed') THEN left({t}, length({t}) - 2) "
        f"WHEN endswith({t}, 'es') THEN left({t}, length({t}) - 2) "
        f"WHEN endswith({t}, 's') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def stem_each(keyword_array: str) -> str:
    """Stem of every keyword, in place."""
    return f"transform({keyword_array}, t -> {stem('t')})"


def stems(keyword_array: str) -> str:
    """Distinct stems of a keyword array."""
    return f"array_distinct({stem_each(keyword_array)})"
