"""URL rules by a bit-parallel wildcard automaton.

All globs are packed one after another into 64-bit words: a start bit for each
pattern, then a bit for each position. One Shift-And step moves every pattern
of every URL of a batch by one byte:

    state = ((state << 1) & accepts[byte]) | (state & stays[byte])

`*` stays on any byte but `/`, `**` on any byte, `?` is one byte but `/`; other
bytes are themselves. A pattern fits if its last bit is set after the last byte.

Rules name a host and a path: a rule fits the host and all its subdomains if
the path starts with the rule's. The canonical form is "." + host + path, so a
rule is the glob `*.host/path**`; the longest fitting rule wins (then the longer
host, then the first given).

Map only: no shuffle, and the masks are as large as the rules. Defined cases: a
null url or one without "://" has an empty host and path and fits no rule, and
what fits no rule gets the default verdict; repeated rows and extra columns pass
through, but for columns named host, path, rule or verdict, which are replaced;
very long urls are walked to their end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagrain.llm.common import flat_bytes, fresh, slices

#: (rule, verdict): host and path as one string, cut at the first slash.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block"))
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WildcardAutomaton:
    """Shift-And masks of many globs, over batches of byte strings."""

    def __init__(self, globs: Sequence[str]):
        start, final, accepts, stays, at = [], [], [], [], 0
        for glob in globs:
            start.append(at)
            rest = glob.encode()
            while rest:
                if rest.startswith(b"**"):
                    stays.append((at, range(256)))
                    rest = rest[2:]
                elif rest.startswith(b"*"):
                    stays.append((at, [b for b in range(256) if b != 47]))
                    rest = rest[1:]
                else:
                    at += 1
                    accepts.append((at, [b for b in range(256) if b != 47] if rest[:1] == b"?" else rest[:1]))
                    rest = rest[1:]
            final.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.start = self._bits(start)
        self.final = [(p // 64, np.uint64(p % 64)) for p in final]
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        for table, entries in ((self.accepts, accepts), (self.stays, stays)):
            for bit, byte_values in entries:
                table[list(byte_values), bit // 64] |= np.uint64(1 << bit % 64)

    def _bits(self, positions) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in positions:
            out[p // 64] |= np.uint64(1 << p % 64)
        return out

    def fits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean matrix, string by pattern, for strings given as bytes and offsets."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        low, sizes = offsets[:-1][order], sizes[order]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))  # strings longer than t come first
            now = state[:live]
            byte = data[low[:live] + t]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.accepts[byte]) | (now & self.stays[byte])
        out = np.zeros((len(order), len(self.final)), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] >> bit) & np.uint64(1)
        return out


def glob_of(rule: str) -> str:
    """The glob of a host and path rule over the canonical form."""
    host, slash, path = rule.partition("/")
    return f"*.{host.translate(str.maketrans(UPPER, LOWER))}{slash}{path}**"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """`host` and `path` of the url: after the first "://", up to `/`, `?` or `#`, then up to `?` or `#`."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(pages[url], pattern, 1), UPPER, LOWER)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")),
                              "path": F.coalesce(F.regexp_extract(pages[url], pattern, 2), F.lit(""))})


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = DEFAULT,
          url: str = "url") -> DataFrame:
    """The frame with host, path, rule (or null) and verdict of each url."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][0]), -len(rules[k][0].partition("/")[0]), k))
    ranked = [rules[k] for k in order]
    texts = np.array([r for r, _ in ranked] + [None], dtype=object)
    verdicts = np.array([v for _, v in ranked] + [default], dtype=object)
    globs = [glob_of(r) for r, _ in ranked]

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def decide(canonical: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = WildcardAutomaton(globs)
        for column in canonical:
            best = [np.zeros(0, np.int64)]
            for part in slices(column):
                fits = automaton.fits(*flat_bytes(part))
                best.append(np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked))
                            if len(ranked) else np.zeros(len(fits), np.int64))
            hit = np.concatenate(best)
            yield pa.StructArray.from_arrays(
                [pa.array(texts[hit].tolist(), pa.string()), pa.array(verdicts[hit].tolist(), pa.string())],
                names=["rule", "verdict"])

    parsed = with_host_path(pages, url)
    held = fresh(parsed, "judged")
    judged = parsed.withColumn(held, decide(F.concat(F.lit("."), "host", "path")))
    return judged.withColumns({"rule": judged[held]["rule"], "verdict": judged[held]["verdict"]}).drop(held)


def _sql_rules() -> str:
    return ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)


ORACLE = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
parsed AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
           regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '(?s)[?#].*$', '') AS path
    FROM cut),
rules(rule, rule_host, rule_path, verdict) AS (VALUES {_sql_rules()}),
fits AS (
    SELECT page_id, rule, verdict, row_number() OVER (
        PARTITION BY page_id ORDER BY length(rule) DESC, length(rule_host) DESC) AS place
    FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                          AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, '{DEFAULT}') AS verdict
FROM parsed p LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (page_id)
"""
