"""op1, op2, op5, op10: against brute force on small fixtures."""

import hashlib
import random

import numpy as np
import pytest

from vitagrain.llm import line_dedup, linking, neural_lsh, ngram_join, queries, shingles, spotsigs


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i: i + k]) for i in range(len(w) - k + 1)}


def brute(sets, num, den):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) * den >= num * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return [root(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base[:20] + passage))
    hub = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(40):  # a large group: copies of one text, each edited elsewhere
        copy = list(hub)
        copy[(i * 7) % 150] = "edited"
        copy[(i * 11 + 3) % 150] = f"e{i}"
        texts.append(" ".join(copy))
    return texts + ["", None, "w1", "w1", "w1 w2 w3"]


def test_ngram_join_equals_brute_force(make, corpus):
    size, num, den = 4, 85, 100
    want = brute([shingle_set(t, size) for t in corpus], num, den)
    rows = sorted(ngram_join.classes(make(corpus), size, num, den).collect())
    assert [r.component_id for r in rows] == want
    assert [r.n_shingles for r in rows] == [len(shingle_set(t, size)) for t in corpus]


def test_one_of_each(make, corpus, odd, none):
    docs = make(corpus)
    kept = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    want = brute([shingle_set(t, 5) for t in corpus], 4, 5)
    assert kept == {k for k, c in enumerate(want) if k == c}
    out = ngram_join.one_of_each(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert sum(r.doc_id == 5 for r in rows) == 2  # one of the repeated rows, and the other text
    assert not any(r.doc_id == 7 for r in rows) and sum(not (r.text or "").strip() for r in rows) == 4
    assert ngram_join.one_of_each(none).collect() == []


def test_ngram_join_of_odd_rows(odd, none):
    rows = ngram_join.classes(odd, 4, 85, 100).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id == 7} == {5}
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 2)} == {(0, 1), (0, 2)}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert ngram_join.classes(none, 4, 85, 100).collect() == []


def test_shingles_are_those_of_the_words():
    texts = ["A b\tc\x0bd e", "", "a B c d E", " one ", "x" * 3_000_000 + " b c d", "a b c d " * 400_000]
    laid = b"".join(t.encode() for t in texts)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    made = shingles.word_shingles(np.frombuffer(laid, np.uint8), offsets, 4)
    assert [len(m) for m in made] == [len(shingle_set(t, 4)) for t in texts]
    assert (made[0] == made[2]).all()


def lines_left(texts):
    """Brute force: one line of each component of similar lines, blank lines stay."""
    where = [(i, n, line_dedup.plain(line)) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"))]
    forms = list(dict.fromkeys(p for _, _, p in where if p))
    sets = [{p[i: i + 8] for i in range(max(1, len(p) - 7))} for p in forms]
    group = dict(zip(forms, brute(sets, 4, 5)))
    seen, out = set(), [[] for _ in texts]
    for i, n, p in where:
        if not p or group[p] not in seen:
            out[i].append((texts[i] or "").split("\n")[n])
        seen.add(group.get(p))
    return ["\n".join(x) for x in out]


def test_line_dedup_equals_brute_force(make):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", str(i)]) for i in range(rng.randrange(1, 30)))
            for _ in range(60)]
    texts = []
    for _ in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 7))]
        lines = [x if rng.random() < 0.6 else x[:-1] + "q" for x in lines]
        texts.append("\n".join(lines + [""] * rng.randrange(2)))
    want = lines_left(texts)
    rows = sorted(line_dedup.dedup(make(texts), kept="kept", every="every").collect())
    assert [r.text for r in rows] == want
    assert [r.kept for r in rows] == [sum(bool(x.strip()) for x in t.split("\n")) for t in want]
    assert [r.n_chars for r in rows] == [len(t) for t in want]
    left = {r.doc_id for r in line_dedup.drop_emptied(make(texts)).collect()}
    assert left == {i for i, t in enumerate(want) if t.strip()}


def test_lines_changed_in_the_middle(spark, make, tmp_path):
    pairs = [("Copyright 2023 Example Media Group, all rights reserved", "Copyright 2024 Example Media Group, all rights reserved"),
             ("sign up for our newsletter to get the latest tips", "sign up for our newsletter to get the newest tips"),
             ("this page was last edited on 3 May 2021 by a member", "this page was last edited on 7 May 2021 by a member")]
    texts = [line for pair in pairs for line in pair] + ["an ordinary line of text that resembles none of the others"]
    sets = [{x.lower()[i: i + line_dedup.FINE] for i in range(len(x) - line_dedup.FINE + 1)} for x in texts]
    group = brute(sets, 4, 5)
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.op5_line_dedup(spark, str(tmp_path)).collect())
    assert [r.n_kept for r in rows] == [int(group.index(g) == i) for i, g in enumerate(group)]
    assert rows[0].n_kept == rows[4].n_kept == 1 and rows[1].n_kept == rows[5].n_kept == 0


def test_line_dedup_of_odd_rows(odd, none):
    out = line_dedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r.text for r in out.where("doc_id = 7").collect()} == {""}
    assert {r.text for r in out.where("doc_id = 1").collect()} == {None}
    assert line_dedup.dedup(none).collect() == []


def test_spot_signatures(make):
    texts = ["the cat of a small town was sleeping near the warm oven and the dog was watching",
             "die katze und der hund sind in dem haus mit dem roten dach und dem alten garten", None, "", "solo",
             "the cat of a small town was sleeping near the warm oven and the dog was watching"]
    rows = sorted(spotsigs.edited_likeness(make(texts)).collect())
    for i, r in enumerate(rows):
        own, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[0].fingerprint == rows[5].fingerprint and rows[5].near_next == 1 and rows[0].near_next == 0
    assert rows[0].near_edited > 0.2 and rows[2].near_next == 1


def test_spots_by_hand(spark):
    row = spotsigs.with_spots(spark.createDataFrame([("of red cars the blue old bikes",)], "text string"), "text", "s").selectExpr(
        "s", "array(hash('of', 'red', 'cars'), hash('the', 'blue', 'old')) AS w").first()
    assert sorted(row.s) == sorted(row.w)


def test_spot_signatures_of_odd_rows(odd, none):
    rows = spotsigs.edited_likeness(odd).collect()
    assert len(rows) == odd.count()
    assert spotsigs.edited_likeness(none).collect() == []


def test_pruned_likeness(spark):
    pairs = spark.createDataFrame([([1, 2, 3, 4, 5], [1, 2, 3, 4]), ([1, 2, 3], [1]), ([1], [1])], "a array<int>, b array<int>")
    assert spotsigs.near(pairs, "a", "b").count() == 2


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    v[500:900] = v[500]  # a large group of equal vectors
    table = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    rows = neural_lsh.search(table, "pmod(vec_id, 50) = 0").collect()
    got, hits = {}, 0
    for r in rows:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in range(0, 3000, 50):
        score = neural_lsh.cosines(v[q], v)
        score[q] = -9
        best = np.lexsort((np.arange(3000), -score))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert all(s == score[x] for x, s in got[q].values())
        hits += len({x for x, _ in got[q].values()} & set(best.tolist()))
        if 500 <= q < 900:
            assert [got[q][k][0] for k in range(1, 6)] == [x for x in range(500, 510) if x != q][:5]
    assert hits >= 0.9 * 5 * 60


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (50, [0.9, 0.1], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [1.0, None], 1),
            (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (6, [1.0], 1), (100, [1e-200, 1e-200], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neural_lsh.search(table, "pmod(vec_id, 50) = 0").collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 50), (0, 2, 100)]
    assert neural_lsh.search(table.limit(0), "pmod(vec_id, 50) = 0").collect() == []


def test_one_odd_vector_drops_no_other(spark):
    rng = random.Random(12)
    rows = [(0, [1.0])] + [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1, 201)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neural_lsh.search(table, "pmod(vec_id, 50) = 0").collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in (50, 100, 150, 200) for k in range(1, 6)]


def test_marks_never_rule_out_a_link_and_most_unlike_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        n, share = int(rng.integers(1, 600)), rng.choice([0.6, 0.8, 0.9, 0.95, 1.0])
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        other = base.copy()
        other[: n - int(n * share)] = rng.integers(0, 1 << 63, n - int(n * share), dtype=np.uint64)
        shared, both = len(np.intersect1d(base, other)), len(np.union1d(base, other))
        marks = [linking.marks_of(np.unique(x)) for x in (base, other)]
        odd = [linking.parity_of(np.unique(x)) for x in (base, other)]
        rows.append((*([int(c) for c in m] for m in marks + odd), len(np.unique(base)), len(np.unique(other)), shared / both))
    rows.append((None, [0] * 256, [0] * 8, [0] * 8, 40_000, 40_000, 0.9))
    df = spark.createDataFrame(rows, "a_marks array<tinyint>, b_marks array<tinyint>, a_parity array<long>, b_parity array<long>, n long, other_n long, near double")
    said = df.select("near", linking.may_reach(85, 100).alias("able"),
                     linking.may_differ(85, 100).alias("few")).collect()
    assert all(r.able and r.few for r in said if r.near >= 0.85)
    unlike = [r for r in said if r.near < 0.7]
    assert len(unlike) > 100 and max(sum(r.able for r in unlike), sum(r.few for r in unlike)) < 0.1 * len(unlike)
    assert linking.marks_of(np.arange(200, dtype=np.uint64)) is None


def test_unlike_lines_of_one_language_seldom_meet():
    rng = random.Random(21)
    parts = ["the", "ou", "er", "and", "ing", "th", "re", "he", "an", "in", "on", "at", "nd", "st", "es", "en", "of", "ti", "ed", "to"]
    lines = ["".join(rng.choice(parts) + " " * (rng.random() < 0.3) for _ in range(rng.randrange(30, 250))).strip() for _ in range(1500)]
    near = [x[:40] + "q" + x[41:] for x in lines]  # one character changed
    n, keys, bits = line_dedup.signatures(lines, line_dedup.FINE)
    assert [int(x) for x in n] == [len({x[i: i + 3] for i in range(len(x) - 2)}) for x in lines]
    pairs = sum(int((np.unique(band, return_counts=True)[1] ** 2).sum() - len(lines)) // 2 for band in keys.T)
    assert pairs < 0.05 * len(lines) ** 2 / 2  # bands of four rows: more pairs under keys than there are lines to pair
    other = line_dedup.signatures(near, line_dedup.FINE)
    rows, close = (np.column_stack([np.zeros(len(lines), np.int64), np.arange(len(lines)), m, m, b]) for m, b in ((n, bits), (other[0], other[2])))
    both, at = np.concatenate([rows, close]), np.arange(len(lines))
    alike = [len(a & b) >= 0.8 * len(a | b) for a, b in (({x[i: i + 3] for i in range(len(x) - 2)} for x in pair) for pair in zip(lines, near))]
    kept = (keys == other[1]).any(axis=1) & linking._alike(both, at, at + len(lines), 4, 5)
    assert sum(alike) > 1000 and kept[np.array(alike)].all()
    assert linking._alike(both, at, (at + 1) % len(lines), 4, 5).mean() < 0.01


def test_postings_meet_across_batches():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    keys = np.sort(np.concatenate([rng.integers(0, 300, 900), np.full(200, 77), np.full(linking.LIGHT, 500), np.full(linking.LIGHT + 1, 501)]))
    rows = np.column_stack([keys, rng.permutation(len(keys)), np.full(len(keys), 50), np.zeros((len(keys), 5), np.int64)])
    names = ["key", "node", "n", "own", *linking.SKETCH]
    for step in (1, 7, 64, 5000):
        batches = (pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i: i + step].T], names=names) for i in range(0, len(rows), step))
        out = [r for b in linking._meet(batches, 4, 5) for r in b.to_pylist()]
        many = {(r["key"], r["node"]) for r in out if r["other"] is None}
        pairs = {(r["node"], r["other"]) for r in out if r["other"] is not None}
        groups = {k: rows[keys == k, 1].tolist() for k in set(keys.tolist())}
        assert many == {(k, x) for k, g in groups.items() if len(g) > linking.LIGHT for x in g}
        assert pairs == {(a, b) for g in groups.values() if len(g) <= linking.LIGHT for a in g for b in g if a < b}


def test_long_unlike_lines_under_one_key_are_told_apart():
    """More than LIGHT unlike lines of one key, some on either side of a level's limit: their near pairs come out, nothing else does."""
    import types

    import pyarrow as pa
    rng = random.Random(33)
    parts = ["the", "ou", "er", "and", "ing", "th", "re", "he", "an", "in", "on", "at", "nd", "st", "es", "en", "of", "ti", "ed", "to", "u", "k", "m", "bl", "p", "gr", "y", "w"]
    lines = ["".join(rng.choice(parts) + " " * (rng.random() < 0.3) for _ in range(rng.randrange(100, 2500))).strip() for _ in range(3 * linking.LIGHT)]
    lines += [x[: len(x) - len(x) // 12] for x in lines]
    sets = [{x[i: i + 3] for i in range(len(x) - 2)} for x in lines]
    want = {(a, b) for b in range(len(lines)) for a in range(b) if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4}
    n, _, bits = line_dedup.signatures(lines, line_dedup.FINE, linking.LEVELS - 1)
    levels, rows = linking.level_of(n), []
    assert len(set(levels.tolist())) > 2 and any(levels[a] != levels[b] for a, b in want)
    for level in range(linking.LEVELS - 1, -1, -1):
        of = np.flatnonzero(levels == level)
        rows.append((level, np.column_stack([of, n[of], bits[of]]).tobytes(), np.full(len(of), 7, np.uint32).tobytes()))
        bits = linking.folded(bits) if level else bits
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["level", "nodes", "keys"])
    every = types.SimpleNamespace(value=np.full(1 << linking.AGAIN_BITS - 3, 255, np.uint8))
    packed = pa.Table.from_batches(linking._postings(iter([batch, batch]), every, 1, 0, 4, 5)).sort_by("part")
    out = [r for b in linking._meet(linking._unpacked(iter(packed.to_batches())), 4, 5) for r in b.to_pylist()]
    found = {(r["node"], r["other"]) for r in out}
    assert len(want) > 100 and want <= found and len(found) < 1.05 * len(want)


def test_components_of_many_edges_take_one_star(spark, tmp_path):
    """A large group of links is handed on as one edge a node: no join of the union-find sees its pairs."""
    edges = [(a, b) for a in range(0, 120, 2) for b in range(a + 2, 120, 2)] + [(201, 203), (203, -7), (500, 501)]
    rows = linking.components(spark.createDataFrame(edges, "a long, b long").repartition(4), str(tmp_path), "few").collect()
    assert {r.node: r.component for r in rows} == {**{k: 0 for k in range(0, 120, 2)}, 201: -7, 203: -7, -7: -7, 500: 500, 501: 500}
    assert len(rows) == 65 and spark.read.parquet(f"{tmp_path}/few_edges").count() == 62
    assert linking.components(spark.createDataFrame([], "a long, b long"), str(tmp_path), "none").collect() == []
