"""op3, op4, op6: exact round trips against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from vitagrain.llm import bpe, packing, store, tokens

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
HELD = {n: tokenizers.Tokenizer.from_file(public_tokenizers.path(n)) for n in (BYTE, WORD)}


def ids(name, text):
    return np.array(HELD[name].encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


TEXTS = st.lists(st.sampled_from(list("ab Zéİß\u3000.,'\n\t  1日🙂\u0301s\x1f\x85") + ["<|endoftext|>", "the", "  "]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_codecs_equal_library(text):
    assert bpe.encoder(BYTE).encode(text) == ids(BYTE, text)
    assert bpe.encoder(BYTE).decode(ids(BYTE, text)) == HELD[BYTE].decode(
        HELD[BYTE].encode(text, add_special_tokens=False).ids, skip_special_tokens=False)
    for name in (BYTE, WORD):
        assert tokens.codec(name).encode(text) == ids(name, text)


@pytest.mark.parametrize("text", ["a İ, b", "x Straße. İİ!", "a\u3000 b", "a \x85b", " a", "a ", "THE Cat"])
def test_joints_and_case_equal_library(text):
    assert tokens.codec(WORD).encode(text) == ids(WORD, text)
    assert tokens.codec(BYTE).encode(text) == ids(BYTE, text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 400 + " " + "é" * 300, "x" * 65])
def test_long_words_merge_like_short_ones(text):
    assert bpe.encoder(BYTE).encode(text) == ids(BYTE, text)


def test_round_trip_of_odd_rows(odd, none):
    rows = bpe.round_trip(odd, BYTE).collect()
    assert len(rows) == odd.count()
    want = sorted(len(ids(BYTE, r.text)) // 4 for r in odd.select("text").collect())
    assert sorted(r.n_tokens for r in rows) == want
    assert bpe.round_trip(none, BYTE).collect() == []
    kept = bpe.decode(bpe.encode(odd, BYTE, out="made"), BYTE, ids="made")
    assert all((r.text or "") == r.decoded for r in kept.select("text", "decoded").collect())


def check_packing(rows, texts, capacity=4096):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    for key, text in texts.items():
        whole, at = ids(WORD, text) + b"\x02\0\0\0", 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole) // 4
            assert r.ids_crc32 == zlib.crc32(whole[4 * at: 4 * (at + r.length)])
            at += r.length
        assert at == len(whole) // 4


def test_packing(make, none, odd):
    texts = ["hello world " * n for n in (1, 3, 50, 700, 2049, 5000, 9)] + ["", None]
    check_packing(packing.digest(make(texts), WORD, 2).collect(), dict(enumerate(texts)))
    assert packing.digest(none, WORD, 2).collect() == []
    rows = packing.digest(odd, WORD, 2).collect()
    assert sum(r.length for r in rows) == sum(len(ids(WORD, r.text)) // 4 + 1 for r in odd.select("text").collect())


@given(st.integers(1, 20_000))
def test_cuts_cover_and_fill(n):
    made = packing.cuts(n)
    assert sum(made) == n and max(made) <= packing.CAPACITY and min(made) > 0
    empty = sum(4096 // (4096 // x) - x for x in made)
    assert n < 300 or empty <= 0.05 * n


def test_store(spark, make, odd, none, tmp_path):
    texts = ["one two three", None, "", "four five " * 3000, "six"] * 3
    store.write(make(texts), str(tmp_path / "a"), BYTE, end_id=0)
    start = 0
    for r in sorted(store.digest(spark, str(tmp_path / "a")).collect()):
        whole = ids(BYTE, texts[r.doc_id]) + b"\0\0\0\0"
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(whole) // 4, zlib.crc32(whole))
        start += r.n_tokens
    asked = spark.createDataFrame([(3,), (4,), (99,), (None,)], "doc_id long")
    found = {r.doc_id: bytes(r.ids) for r in store.lookup(spark, str(tmp_path / "a"), asked).collect()}
    assert found == {k: ids(BYTE, texts[k]) + b"\0\0\0\0" for k in (3, 4)}
    store.write(odd, str(tmp_path / "b"), BYTE, end_id=0)
    rows = store.scan(spark, str(tmp_path / "b")).collect()
    assert len(rows) == odd.count()
    assert sorted(r.occurrence for r in rows if r.doc_id == 5) == [0, 1, 2]
    again = store.lookup(spark, str(tmp_path / "b"), spark.createDataFrame([(5,), (None,)], "doc_id long")).collect()
    assert sorted((r.doc_id or -1, r.occurrence) for r in again) == [(-1, 0), (-1, 1), (5, 0), (5, 1), (5, 2)]
    store.write(none, str(tmp_path / "c"), BYTE, end_id=0)
    assert store.digest(spark, str(tmp_path / "c")).collect() == []


@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=300))
@settings(deadline=None, max_examples=40)
def test_index_is_minimal_and_perfect(keys):
    keys = np.array(sorted(keys), np.int64)
    turns = np.zeros(len(keys), np.uint32)
    seeds, slots, prints = store.build_index(store.key_hash(keys, turns))
    assert sorted(slots) == list(range(len(keys)))
    shard = {"seeds": seeds.tobytes(), "slots": slots.astype("<u4").tobytes(), "prints": prints.tobytes()}
    assert (store.find(shard, keys, turns) == np.arange(len(keys))).all()


def test_ids_that_do_not_fit_raise(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit into 2 bytes"):
        store.write(docs, str(tmp_path / "narrow"), BYTE, 70_000)
    store.write(docs, str(tmp_path / "wide"), BYTE, 70_000, width=4)


@pytest.mark.parametrize("name", [BYTE, WORD])
@pytest.mark.parametrize("text", ["en.\nOn the\nmat", "a\n's b\n1", "x\n<|endoftext|>\ny", "a&&&\nB!!, c'd.", "क़. b\nc", "a\n\nb", "a\n", "\na b",
                                  "a\r\nb", "a \nb", "a\x1cb\nc", "e\ńx", "İ...\nİ"])
def test_line_feeds_and_marks_equal_library(name, text):
    assert tokens.codec(name).encode(text) == ids(name, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"abİéक़'.<&\ń 1", "क़", "\n", " ", " the", "<|endoftext|>"]), max_size=30).map("".join))
def test_line_feeds_among_odd_characters(text):
    for name in (BYTE, WORD):
        assert tokens.codec(name).encode(text) == ids(name, text)


def test_words_around_line_feeds_are_kept_singly():
    assert tokens.pieces_of("a.\nB c") == ["a.", "\nB", "c"]
