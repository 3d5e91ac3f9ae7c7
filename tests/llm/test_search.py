"""op11, op12, op13: against brute force on small fixtures, and with odd rows."""

import hashlib
import math
import random
import re

import pytest

from vitagrain.llm import clusters, contamination, mask_search

ITEMS = "item_id long, text string, key string, h long, words int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def benchmark(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], ITEMS)


def hit_rows(docs, items, window=10):
    """Brute force: every window of every item at every place of every document."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    out = []
    for doc_id, text in docs:
        words, hit, found = split(text), set(), set()
        for item_id, item in items:
            w = split(item)
            n = min(window, len(w))
            parts = {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i: i + n]) in parts:
                    hit |= set(range(i, i + n))
                    found |= {item_id} - {None}
        names = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["Über", "日本", "x1y"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    items = [(i, " ".join(passage[i: i + 14])) for i in range(0, 26, 3)]
    items += [(50, "W1 w2,W3"), (51, "lone"), (52, None), (53, " -- "), (54, "über " * 3), (None, "only the nameless one has this"),
              (0, "a second text under a used id counts for that same id here"), (60, items[2][1].upper().replace("Ü", "ü")), (61, items[0][1]), (62, "a a a a a a a a a a a a")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [" ".join(t.split()[:10] + passage[k: k + 9 + k] + t.split()[:5]) for k, t in enumerate(texts[:20])]
    texts += ["see W1-w2 w3 and ÜBER Über über über", "a LONE wolf", "a " * 30, None, "", "only the nameless one has this",
              "A second text; under a used id (counts for that same id) here", " ".join(passage), " ".join(passage)]
    docs = list(enumerate(texts)) + [(3, texts[3]), (None, " ".join(passage)), (4, "another text " + " ".join(passage[3:17]))]
    frame = spark.createDataFrame([(*r, "x", 1, "w") for r in docs], "doc_id long, text string, key string, places int, bits string")
    rows = contamination.contaminated(frame, benchmark(spark, items)).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == hit_rows(docs, items)
    assert sum(r.contaminated for r in rows) > 15


def test_contamination_by_share_of_shingles(spark, make):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(10)]
    edited = [[*item[:k], "edit", *item[k + 1:]] for k in range(10)]
    docs = make([" ".join(words[:7] + e + words[9:20]) for e in [item, *edited]])
    rows = sorted(contamination.contaminated(docs, benchmark(spark, [(1, " ".join(item))]), share=0.5).collect())
    # an edit at place k spoils the shingles of five that cover it; three of six must be left
    left = [6] + [sum(not k - 4 <= i <= k for i in range(6)) for k in range(10)]
    assert [r.contaminated for r in rows] == [x >= 3 for x in left]


def test_contamination_of_odd_rows(spark, odd, none):
    rows = contamination.contaminated(odd, benchmark(spark, [(1, "the lazy dog and then runs away from the farm"), (None, None), (None, "word")])).collect()
    assert len(rows) == odd.count()
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in rows}
    assert {(5, 21, 10, 1), (7, 21, 10, 1), (1, 0, 0, 0), (2, 0, 0, 0), (None, 0, 0, 0), (11, 1, 1, 0), (12, 0, 0, 0), (14, 1, 0, 0)} <= got
    assert max(r.n_hit for r in rows) == 20_000
    assert contamination.contaminated(none, benchmark(spark, [(1, "a b")])).collect() == []
    clean = contamination.contaminated(odd, benchmark(spark, [(1, "a b")]).limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.contaminated for r in clean)


def best_rows(docs, items, k=10):
    """Brute force: every document scored for every item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    read = [(i, split(t)) for i, t in docs]
    read = [(i, w) for i, w in read if w]
    every, length = len(read), sum(len(w) for _, w in read)
    out = []
    for item_id, item in items:
        scored = []
        for doc_id, w in read:
            m, score = 100 - 75 + 75 * len(w) * every // length, 0
            for t in split(item):
                df = sum(t in set(x) for _, x in read)
                weight = math.floor(1000 * math.log((2 * every + 2) / (2 * df + 1)))
                score += weight * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_terms, cells", [(mask_search.BLOCK_TERMS, mask_search.CELLS), (30, 400)])
def test_search_equals_brute_force(spark, monkeypatch, block_terms, cells):
    monkeypatch.setattr(mask_search, "CELLS", cells)
    rng = random.Random(7)
    vocabulary = [f"v{int(rng.paretovariate(0.6))}" for _ in range(300)] + ["Ärger", "ärger"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(7, texts[7]), (200, texts[7]), (None, texts[8]), (201, None), (202, ""), (203, "; ;"), (204, "V1 V1 ÄRGER")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(12)]
    items += [(20, " ".join(f"v{i}" for i in range(90))), (21, None), (22, "unknown words"), (3, items[3][1]), (23, items[4][1].upper()), (None, "v1")]
    frame = spark.createDataFrame([(*r, "x", 1, "w") for r in docs], "doc_id long, text string, n string, terms int, form string")
    rows = mask_search.search(frame, benchmark(spark, items), block_terms=block_terms).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == best_rows(docs, items)


def test_search_of_odd_rows(spark, odd, none):
    items = benchmark(spark, [(1, "lazy dog"), (2, "x" * 50_000), (3, "night WORD word")])
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    rows = mask_search.search(odd, items, k=4).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == best_rows(docs, [(1, "lazy dog"), (2, "x" * 50_000), (3, "night WORD word")], 4)
    assert mask_search.search(none, items).collect() == []
    assert mask_search.search(odd, items.limit(0)).collect() == []


def grouped(rows, dimensions, count, rounds):
    """Brute force: plain rounds over Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:count]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    total = [sum(d for d, c in near if c == j) for j in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total), digests[c]) for (i, _), (d, c) in zip(kept, near)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string, dots long"


@pytest.mark.parametrize("dimensions, count, rounds, n", [(6, 4, 10, 80), (3, 8, 2, 40), (4, 8, 3, 5)])
def test_clusters_equal_brute_force(spark, dimensions, count, rounds, n):
    rng = random.Random(dimensions)
    rows = [(i, [rng.choice((rng.gauss(0, 1), 0.25, -0.5)) for _ in range(dimensions)]) for i in range(n)]
    rows += [rows[0], (None, rows[1][1]), (n, None), (n + 1, [1.0]), (n + 2, [math.nan] * dimensions), (n + 3, [None] * dimensions),
             (n + 4, [math.inf] + [0.0] * (dimensions - 1)), (n + 5, rows[2][1]), (n + 6, []), (1, rows[3][1])]
    frame = spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows], VECTORS)
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]  # as 32-bit floats
    got = clusters.clustered(frame, dimensions=dimensions, clusters=count, rounds=rounds).collect()
    assert sorted((tuple(r) for r in got), key=repr) == grouped(exact, dimensions, count, rounds)


def test_clusters_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, [0.5, 0.5], 1, "", "", 1)], VECTORS)
    assert [tuple(r) for r in clusters.clustered(frame, dimensions=2).collect()] == [(None,) * 6]
    assert clusters.clustered(frame.limit(0), dimensions=2).collect() == []
    assert clusters.clustered(frame).collect() == []  # another length
    far = spark.createDataFrame([(1, [3e30, 0.0], 1, "", "", 1)], VECTORS)
    with pytest.raises(Exception, match="beyond the exact range"):
        clusters.clustered(far, dimensions=2).collect()
