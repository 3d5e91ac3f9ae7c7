"""Benchmark decontamination by a prefix-filtered set join, in SQL functions only.

Items fall into windows of `window` words (an item of fewer is one window) and windows
into shingles of `shingle` words (a shorter window is one shingle). A window of s
shingles of which `share` must be found can miss s - ceil(share * s) of them, so one of
its s - ceil(share * s) + 1 rarest shingles occurs wherever the window does: these are
its prefix, and the only shingles that are joined. Rarity is counted over the whole
corpus.

One pass over the texts keeps, per document, its number of words and the places of
shingles that some window has; a bit table of fixed size tells them and merely spares
work, the joins decide. From these places come the counts, hence the prefixes, hence the
places worth joining. A joined place fixes where the window would lie (positional
bound), which must be inside the document (length bound); then its words are compared
with the window's, so the result is exact. Spans that hold are merged per text by a fold
over sorted starts.

Windows and items meet documents only through equal shingles; equal windows are joined
once, equal items expand after their windows have been found, and equal texts share the
row of hits that their digest names.

Defined cases: null and empty texts have no words, zero counts and are clean; very long
texts are taken whole; a document row without id or given twice has its own result row;
an item without words has no window; an item without id marks words but is neither
counted nor named; repeated item ids count once; empty tables give no rows or no hits;
extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagrain.llm.common import id_text, shared_folder, written

WINDOW, SHINGLE = 10, 5
#: Bits of the table that spares work.
SLOTS = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word after A-Z became a-z: digits, a-z and everything beyond ASCII.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def _words(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    plain = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def _bits(hashes: DataFrame) -> Column:
    """SLOTS bits, as an array of longs, with those of the hashes (column h) set: a scalar subquery of fixed size."""
    slot = f"h & {SLOTS - 1}L"
    found = hashes.selectExpr(f"shiftright({slot}, 6) AS word", f"shiftleft(1L, int({slot} & 63)) AS bit").groupBy("word").agg(
        F.bit_or("bit").alias("bits"))
    every = hashes.sparkSession.range(SLOTS // 64).select(F.col("id").alias("word")).join(found, "word", "left")
    return every.agg(F.expr("transform(array_sort(collect_list(struct(word, coalesce(bits, 0L) AS bits))), x -> x.bits)")
                     .alias("bits")).scalar()


def _has_bit(bits: str, value: str) -> str:
    slot = f"(({value}) & {SLOTS - 1}L)"
    return f"(shiftright(get({bits}, int(shiftright({slot}, 6))), int({slot} & 63)) & 1L) = 1L"


def _windows(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (text, words, classes of items) and the items of each class of equal items."""
    read = items.select("item_id", _words(F.col("text")).alias("words")).where("size(words) > 0")
    read = read.withColumn("class", F.md5(F.array_join("words", " ")))
    members = read.where("item_id IS NOT NULL").select("class", F.col("item_id").cast("string").alias("item")).distinct()
    whole = read.groupBy("class").agg(F.first("words").alias("words"))
    at = whole.selectExpr("class", "words", f"explode(sequence(1, greatest(size(words) - {window} + 1, 1))) AS at")
    cut = at.selectExpr("class", f"slice(words, at, {window}) AS words")
    windows = cut.groupBy(F.array_join("words", " ").alias("window")).agg(
        F.first("words").alias("words"), F.collect_set("class").alias("classes"))
    return windows.withColumn("parts", F.expr(f"least(size(words), {shingle})")), members


def _places(docs: DataFrame, bits: Column, sizes: list[int]) -> DataFrame:
    """Documents with key, n_words, the places of possible shingles and, where there are any, their words."""
    read = docs.select("doc_id", "text", _words(F.col("text")).alias("words"), bits.alias("bits"))
    found = [
        f"transform(filter(sequence(1, size(words) - {k - 1}), i -> "
        f"{_has_bit('bits', f'xxhash64(slice(words, i, {k}))')}), i -> struct(i, xxhash64(slice(words, i, {k})) AS h, {k} AS parts))"
        for k in sizes]
    guarded = [f"CASE WHEN size(words) >= {k} THEN {x} ELSE array() END" for k, x in zip(sizes, found)]
    kind = "array<struct<i: int, h: bigint, parts: int>>"
    places = f"cast(concat({', '.join(guarded)}) AS {kind})" if sizes else f"cast(array() AS {kind})"
    return read.selectExpr("doc_id", "md5(text) AS key", "size(words) AS n_words", "words", f"{places} AS places").selectExpr(
        "doc_id", "key", "n_words", "places", "CASE WHEN size(places) > 0 THEN words END AS words")


def _prefixes(windows: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """Windows by the hashes of their rarest shingles, as many as the share can't spare."""
    parts = windows.selectExpr("*", "explode(transform(sequence(1, size(words) - parts + 1), "
                               "i -> struct(i AS offset, xxhash64(slice(words, i, parts)) AS h))) AS s")
    ranked = parts.join(counts, [parts["s.h"] == counts["h"]], "left").groupBy("window").agg(
        F.first("words").alias("words"), F.first("classes").alias("classes"), F.first("parts").alias("parts"),
        F.array_sort(F.collect_list(F.expr("struct(coalesce(n, 0L) AS n, s.h AS h, s.offset AS offset)"))).alias("rare"))
    need = f"int(ceil({share} * size(rare)))"
    return ranked.selectExpr("words", "classes", "parts", f"{need} AS need", f"slice(rare, 1, size(rare) - {need} + 1) AS rare").selectExpr(
        "inline(rare)", "words", "classes", "parts", "need").where("n > 0").groupBy("h").agg(
        F.collect_list(F.struct("offset", "words", "classes", "parts", "need")).alias("windows"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: float = 1.0,
                 key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window occurs where at least `share` of its shingles stand in their places.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    listed = items.select(items[item_key].alias("item_id"), F.coalesce(items[item_text], F.lit("")).alias("text"))
    windows, members = _windows(listed, window, shingle)
    windows, members = written(windows, folder, "windows"), written(members, folder, "members")
    sizes = sorted(r.parts for r in windows.select("parts").distinct().collect())  # at most `shingle` values
    hashes = windows.selectExpr("explode(transform(sequence(1, size(words) - parts + 1), i -> xxhash64(slice(words, i, parts)))) AS h")
    rows = written(_places(id_text(docs, key, text), _bits(hashes), sizes), folder, "places")
    held = rows.where("words IS NOT NULL")

    counts = held.selectExpr("explode(places.h) AS h").groupBy("h").agg(F.count("*").alias("n"))
    prefixes = written(_prefixes(windows, counts, share), folder, "prefixes")
    reach = f"{window} - p.parts"
    tried = held.select("key", "n_words", "words", "places", _bits(prefixes.select("h")).alias("bits")).selectExpr(
        "key", "n_words", "words", f"explode(filter(places, p -> {_has_bit('bits', 'p.h')})) AS p").selectExpr(
        "key", "n_words", "p.h AS h", "p.i AS i", f"greatest(p.i - ({reach}), 1) AS low",
        f"slice(words, greatest(p.i - ({reach}), 1), {window} + ({reach})) AS near")
    start = "(i - w.offset + 1)"
    inside = f"{start} >= 1 AND {start} + size(w.words) - 1 <= n_words"
    equal = (f"slice(near, {start} - low + 1, size(w.words)) = w.words" if share >= 1 else
             f"size(filter(sequence(0, size(w.words) - w.parts), k -> slice(near, {start} - low + 1 + k, w.parts) = "
             "slice(w.words, k + 1, w.parts))) >= w.need")
    hits = tried.join(prefixes, "h").selectExpr(
        "key", f"inline(transform(filter(windows, w -> CASE WHEN {inside} THEN {equal} ELSE false END), "
               f"w -> struct({start} AS low, {start} + size(w.words) AS high, w.classes AS classes)))")
    hits = written(hits, folder, "hits")

    spans = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans")).selectExpr(
        "key", "aggregate(spans, struct(0 AS total, 0 AS upto), (s, x) -> struct("
               "s.total + greatest(x.high - greatest(x.low, s.upto), 0) AS total, greatest(s.upto, x.high) AS upto), s -> s.total) AS hit")
    named = hits.select("key", F.explode("classes").alias("class")).distinct().join(members, "class").groupBy("key").agg(
        F.array_sort(F.collect_set("item")).alias("names"))
    found = spans.join(named, "key", "left")
    clean = rows.where("words IS NULL").selectExpr("doc_id", "n_words", "0 AS hit", "cast(NULL AS array<string>) AS names")
    every = clean.unionByName(held.join(found, "key", "left").select("doc_id", "n_words", "hit", "names"))
    return every.selectExpr(
        "doc_id", "bigint(n_words) AS n_words", "bigint(coalesce(hit, 0)) AS n_hit", "bigint(coalesce(size(names), 0)) AS n_items",
        "sha2(coalesce(array_join(names, ','), ''), 256) AS items_sha256", "coalesce(hit, 0) > 0 AS contaminated")


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS g(i) WHERE len(ws) > 0),
dw AS (SELECT r, i, k, array_to_string(ws[i : i + k - 1], ' ') AS w
  FROM d, (SELECT DISTINCT k FROM iw) AS s, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS g(i)),
hit AS MATERIALIZED (SELECT r, i, k, item_id FROM dw JOIN iw USING (k, w)),
spans AS (SELECT DISTINCT r, i, k FROM hit),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM spans, unnest(range(i, i + k)) AS g(j) GROUP BY r),
m AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
