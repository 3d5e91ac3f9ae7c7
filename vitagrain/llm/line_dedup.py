"""Fuzzy line deduplication: MinHash bands, exact Jaccard, one line of each component stays.

Lines are compared by their characters, lower-cased and with runs of white space
as one space. Lines equal in that form are one class from the start (a group of
any size is signed once a task). A class's signature is a one-permutation MinHash
of its character shingles, which are sorted once: of each BINS bins, dealt by other bits of the
hash for each draw, one draw keeps the smallest hash, one the largest and one the smallest
of the upper half and then of the lower; an empty bin borrows the next filled one of its draw. Classes that agree in all
rows of a band are candidates: at the threshold of 0.8 a pair is missed with
probability (1 - 0.8^7)^24 = 0.36 %, at 0.9 with under 0.001 %. Unlike lines of one
language share a third to a half of their short shingles, so bands are long. Whether each of
256 parts of the hash range (more for long lines) holds an odd number of shingles goes along with a key and tells nearly all unlike lines
apart where they meet (see `linking.alike`; a pair at 0.8 fails that test less than once in 100,000). Exact Jaccard on the lines themselves decides, and `linking`
builds the components.

A changed character in mid-line costs `shingle` shingles on each side, so that at
0.8 such lines are linked from 10 * shingle - 1 characters on. FINE is what the
query and the pipeline use.

Of each component the line with the smallest (doc_id, hash of the text, line
number) stays. Texts are read twice, once to sign their lines and once for the lines of
candidate pairs; what the first pass finds is kept packed, many lines to a row.

Defined cases: null text is empty; blank lines take no part and stay; a line
shorter than a shingle is one shingle; rows equal in id and text get the same
result; null ids come after all others; an empty table gives no rows; extra
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagrain.llm.common import bit_table, fresh, held_bits, mix, shared_folder, slot_column, swept, written
from vitagrain.llm.linking import AGAIN_BITS, LEVELS, SKETCH, SLOT_BITS, TURNS, _longs, again_bits, bits_of, common, folded, key_slot, level_of, link
from vitagrain.llm.shingles import _PLACE, character_codes

SHINGLE = 8
#: Short enough for a changed character in a line of 29 characters.
FINE = 3
BANDS, ROWS = 24, 7
#: Bins and draws: with fewer bins each, fewer are empty and repeat another one. The bands use BANDS * ROWS of them.
BINS, DRAWS = 64, 3
NUM, DEN = 4, 5
#: Lines and characters that a task turns into signatures at a time (few enough for its caches), and at most two to the power LINE_BITS lines.
LINES, LINE_BITS, CHARACTERS = 512, 12, 1 << 16
#: Lines that a task remembers as signed, and that it packs into a row.
GIVEN, ROWS_OUT = 200_000, 4096
PACKED = ["places", "nodes", *(f"keys_{k}" for k in range(TURNS))]
PLACE = ["h1", "h2", "none", "doc_id", "text_hash", "line"]
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What a bin that borrows adds, by the distance it borrows from.
_AWAY = mix(np.arange(BINS + 1, dtype=np.uint64)) * (np.arange(BINS + 1) > 0).astype(np.uint64)
#: A random word for each place in a shingle and each code point below 65,536.
_CODES = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_WORDS: dict[int, np.ndarray] = {}
#: White space that a plain line does not have.
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["  ", " \n", "\n "]


def plain(line: str) -> str:
    """The form in which lines are compared."""
    return " ".join(line.lower().split())


def plain_lines(text: str) -> list[str]:
    """The plain forms of a text's lines; an ordinary text is lower-cased and split as a whole."""
    low = text.lower()
    odd = low[:1] == " " or low[-1:] == " " or any(x in low for x in _ODD)
    return [plain(x) for x in text.split("\n")] if odd else low.split("\n")


def line_hash(line: str, salt: int = 0) -> bytes:
    """128 bits of a plain line."""
    return blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16, salt=salt.to_bytes(8, "little")).digest()


def _words(place: int, codes: np.ndarray, wide: bool) -> np.ndarray:
    """The words of code points at one place of a shingle; wide if there may be some above 65,535."""
    if wide:
        return mix(mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * _PLACE[place])
    if place not in _WORDS:
        _WORDS[place] = mix(_CODES * _PLACE[place])
    return _WORDS[place].take(codes)


def distinct(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each non-empty line's distinct shingles in order, 52 bits below the line's number (at most 4096 lines), and how many.

    A shingle's hash is the exclusive or of its characters' words; a shorter line is one shingle.
    """
    codes = character_codes("".join(lines))
    wide = bool(codes.max(initial=0) >= len(_CODES))
    codes = codes.astype(np.int64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(lengths)
    runs = _words(0, codes, wide)
    keep = np.ones(len(codes), bool)
    for k in range(1, shingle):
        runs[: max(0, len(codes) - k)] ^= _words(k, codes[k:], wide)
        keep[ends[lengths > k] - k] = False
    for i in np.flatnonzero(lengths < shingle):  # the window must not reach into the next line
        low = ends[i] - lengths[i]
        runs[low] = np.bitwise_xor.reduce([_words(k, codes[low + k: low + k + 1], wide)[0] for k in range(lengths[i])])
        keep[low: ends[i]] = np.arange(lengths[i]) == 0
    hashes = runs[keep] >> np.uint64(LINE_BITS)
    hashes |= np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(64 - LINE_BITS), np.maximum(lengths - shingle + 1, 1))
    hashes.sort()
    first = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    hashes = hashes[first]
    return hashes, np.bincount((hashes >> np.uint64(64 - LINE_BITS)).astype(np.int64), minlength=len(lines))


def signatures(lines: list[str], shingle: int = SHINGLE, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each non-empty line: the number of distinct shingles, BANDS keys (ints) and the longs of its parts at a level."""
    hashes, n = distinct(lines, shingle)
    values, line = hashes << np.uint64(LINE_BITS), hashes >> np.uint64(64 - LINE_BITS)
    size = len(SKETCH) << level  # the top bits tell the long, bits that no level has among these the bit
    word = (line * np.uint64(size) + ((values >> np.uint64(32)) * np.uint64(size) >> np.uint64(32))).view(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    odd = np.zeros(len(lines) * size, np.uint64)
    odd[word[edge]] = np.bitwise_xor.reduceat(np.uint64(1) << (values >> np.uint64(48) & np.uint64(63)), edge)
    low = np.empty((len(lines), BINS, DRAWS), np.uint64)
    upper = values >> np.uint64(63) == 1
    for draw in range(DRAWS):
        place = (hashes >> np.uint64(6 * draw) & np.uint64(BINS - 1) | line << np.uint64(6)).view(np.int64)
        least = np.full(len(lines) * BINS, FULL)
        if draw == 0:  # of values with one place the last one written stays
            least[place[::-1]] = values[::-1]
        elif draw == 1:
            least[place] = values
        else:
            for part in (np.flatnonzero(~upper)[::-1], np.flatnonzero(upper)[::-1]):
                least[place[part]] = values[part]
        least = least.reshape(-1, BINS)
        filled = np.where(np.tile(least, 2) != FULL, np.arange(2 * BINS, dtype=np.int32), np.int32(4 * BINS))
        after = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        low[:, :, draw] = np.take_along_axis(least, after % BINS, axis=1) + _AWAY[after - np.arange(BINS, dtype=np.int32)]
    low = low.reshape(len(lines), -1)[:, : BANDS * ROWS]  # neighbours in a band are of several draws
    keys = (low.reshape(-1, BANDS, ROWS) * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64)
    keys = mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return n, (keys >> np.uint64(32)).astype(np.uint32).view(np.int32), odd.view(np.int64).reshape(-1, size)


def _lines(batches: Iterator[pa.RecordBatch], shingle: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Packed: the PLACE of every line that is not blank; nodes and keys, by level, of those that the task did not remember."""
    signed, marks, rows = [], [], []

    def sign(texts: list[str], own: list[bytes]) -> None:
        n, keys, bits = signatures(texts, shingle, LEVELS - 1)
        signed.append((np.frombuffer(b"".join(own), np.int64)[::2], n, keys, bits))

    def out() -> pa.RecordBatch:
        places = np.concatenate([np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2), np.array(rows, np.int64)], axis=1)
        packed = [(0, places, *[places[:0]] * (1 + TURNS))]
        if signed:
            node, n, keys, bits = (np.concatenate(c) for c in zip(*signed))
            levels = level_of(n)
            for level in range(LEVELS - 1, -1, -1):
                of = np.flatnonzero(levels == level)
                if len(of):
                    packed.append((level, places[:0], np.column_stack([node[of], n[of], bits[of]]), *np.split(keys[of], TURNS, axis=1)))
                bits = folded(bits) if level else bits
        for held in (signed, marks, rows):
            held.clear()
        level, *columns = zip(*packed)
        return pa.RecordBatch.from_arrays([pa.array(level, pa.int64()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in columns)],
                                          names=["level", *PACKED])

    given: set[bytes] = set()
    for batch in batches:
        texts, own, size = [], [], 0
        for key, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
            none, key = int(key is None), key or 0
            for number, line in enumerate(plain_lines(text)):
                if not line:
                    continue
                mark = line_hash(line, salt)
                marks.append(mark)
                rows.append((none, key, text_hash, number))
                if mark not in given:
                    if len(given) >= GIVEN:
                        given.clear()
                    given.add(mark)
                    own.append(mark)
                    texts.append(line)
                    size += len(line)
                    if len(texts) >= LINES or size >= CHARACTERS:
                        sign(texts, own)
                        texts, own, size = [], [], 0
                if len(rows) >= ROWS_OUT:
                    if texts:
                        sign(texts, own)
                        texts, own, size = [], [], 0
                    yield out()
        if texts:
            sign(texts, own)
    if rows:
        yield out()


def _asked(batches: Iterator[pa.RecordBatch], rows, lines, salt: int) -> Iterator[pa.RecordBatch]:
    """node and plain line of the lines in one bit table, of texts whose row is in the other, each once a task."""
    given = set()
    for batch in batches:
        batch = batch.filter(pa.array(held_bits(rows.value, batch.column(0).to_numpy())))
        for low in range(0, batch.num_rows, 200):
            found = {line_hash(line, salt): line for text in batch.column(1).slice(low, 200).to_pylist()
                     for line in plain_lines(text) if line}
            nodes = np.frombuffer(b"".join(found), np.int64)[::2]
            held = held_bits(lines.value, key_slot(np.ascontiguousarray(nodes)))
            out = [(node, line) for (mark, line), node, keep in zip(found.items(), nodes.tolist(), held) if keep and mark not in given]
            given.update(mark for mark, keep in zip(found, held) if keep)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())],
                                             names=["node", "items"])


def _places(batches: Iterator[pa.RecordBatch], *tables) -> Iterator[pa.RecordBatch]:
    """Places of the lines whose hash is in one of the bit tables (each with the bits of its slots)."""
    for batch in batches:
        for packed in batch.column(0):
            rows = _longs(packed, len(PLACE))
            hashes = np.ascontiguousarray(rows[:, 0])
            rows = rows[np.any([held_bits(table.value, key_slot(hashes, bits)) for table, bits in tables], axis=0)]
            columns = [pa.array(np.ascontiguousarray(c)) for c in rows.T]
            columns[3] = pa.array(np.ascontiguousarray(rows[:, 3]), mask=rows[:, 2] == 1)
            yield pa.RecordBatch.from_arrays([columns[k] for k in (0, 1, 3, 4, 5)], names=[PLACE[k] for k in (0, 1, 3, 4, 5)])


def measure_lines(left: pa.Array, right: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the lines' shingle sets; many lines are shingled at a time."""
    shared, united = np.zeros(len(left), np.int64), np.ones(len(left), np.int64)
    low52 = np.uint64((1 << 64 - LINE_BITS) - 1)
    for low in range(0, len(left), 500):
        pairs = [left.slice(low, 500).to_pylist(), right.slice(low, 500).to_pylist()]
        lines = list(dict.fromkeys(pairs[0] + pairs[1]))
        hashes, sizes = distinct(lines, shingle)
        hashes &= low52
        starts = np.concatenate([[0], np.cumsum(sizes)])
        number = {x: i for i, x in enumerate(lines)}
        a, b = (np.array([number[x] for x in side]) for side in pairs)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist()), low):
            shared[i] = common(hashes[starts[x]: starts[x + 1]], hashes[starts[y]: starts[y + 1]])
        united[low: low + len(a)] = sizes[a] + sizes[b]
    return shared, np.maximum(united - shared, 1)


def lost_lines(docs: DataFrame, num: int = NUM, den: int = DEN, shingle: int = SHINGLE, salt: int = 0) -> DataFrame:
    """doc_id, text_hash and `lost`: the numbers of the lines that go, for rows that lose some."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    folder = shared_folder(spark)
    swept(spark)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = texts.mapInArrow(lambda b: _lines(b, shingle, salt), "level long, " + ", ".join(f"{c} binary" for c in PACKED))
    signed = written(signed, folder, "signed")
    places = signed.where("length(places) > 0").select("places")

    def at(*tables) -> DataFrame:
        return places.mapInArrow(lambda b: _places(b, *tables), "h1 long, h2 long, doc_id long, text_hash long, line long")

    def fetch(asked: DataFrame, name: str) -> DataFrame:
        lines = send(bits_of(asked))
        rows = send(bit_table(at((lines, SLOT_BITS)).select("doc_id")))
        return texts.select(slot_column("doc_id").alias("slot"), "text").mapInArrow(
            lambda b: _asked(b, rows, lines, salt), "node long, items string").dropDuplicates(["node"])

    labels = link(signed.where("length(nodes) > 0"), fetch, lambda left, right: measure_lines(left, right, shingle), num, den, folder,
                  positional=False, bands=BANDS // TURNS)
    # lines that neither repeat nor have a component lose nothing
    tables = (send(bits_of(labels.select("node"))), SLOT_BITS), (send(again_bits(places, lambda x: _longs(x, len(PLACE))[:, 0])), AGAIN_BITS)
    rows = written(at(*tables), folder, "rows")
    for table, _ in tables:
        table.destroy()
    if rows.groupBy("h1").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).where("low < high").take(1):
        return lost_lines(docs, num, den, shingle, salt + 1)  # a node stood for two lines
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line")
    named = rows.join(labels.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    first = named.groupBy("component").agg(F.min(place).alias("stays"))
    lost = named.join(first, "component").where(~place.eqNullSafe(F.col("stays")))
    lost = written(lost.groupBy("doc_id", "text_hash").agg(F.collect_list("line").alias("lost")), folder, "lost")
    swept(spark)
    return lost


def dedup(docs: DataFrame, num: int = NUM, den: int = DEN, kept: str | None = None, every: str | None = None,
          shingle: int = SHINGLE) -> DataFrame:
    """All documents with lines left out of `text` (and `n_chars`, if there is one, counted anew).

    kept and every name columns for the numbers of lines with text after and before.
    """
    lost = lost_lines(docs, num, den, shingle)
    held = fresh(docs, "lost_lines")
    lost = lost.select(*(F.col(c).alias(f"{held}_{c}") for c in lost.columns))
    text = F.coalesce(docs["text"], F.lit(""))
    met = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(lost[f"{held}_doc_id"])
                    & (F.xxhash64(text) == lost[f"{held}_text_hash"]), "left")
    gone = F.col(f"{held}_lost")
    lines = F.split(text, "\n")
    left = F.when(gone.isNull(), docs["text"]).otherwise(F.array_join(
        F.filter(lines, lambda x, i: ~F.array_contains(gone, i.cast("long"))), "\n"))
    met = met.withColumn(f"{held}_text", left)
    filled = F.size(F.filter(lines, lambda x: x.rlike(r"\S")))
    columns = {"text": F.col(f"{held}_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length(F.col(f"{held}_text")).cast("long")
    out = [columns.get(c, met[c]).alias(c) for c in docs.columns]
    if every:
        out.append(filled.alias(every))
    if kept:
        out.append((filled - F.coalesce(F.size(gone), F.lit(0))).alias(kept))
    return met.select(*out)


def drop_emptied(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The deduplicated documents without those whose every line with text was left out."""
    kept, every = fresh(docs, "lines_kept"), fresh(docs, "lines_in_all")
    return dedup(docs, kept=kept, every=every, shingle=shingle).where(f"`{every}` = 0 OR `{kept}` > 0").drop(kept, every)
