import re
import string

import numpy as np
import xxhash

from tomeweave.llm import simhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_fingerprint(text, size=4):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(fps))]


def test_fingerprints():
    texts = ["", "One", "A b C d", "a b c d e f a b c d", "Ärger ÄRGER x\x0by", "w " * 300]
    got = simhash.fingerprints_of([t.encode() for t in texts])
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


def near_numbers(n, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n // 3, dtype=np.uint64)
    rows = [base]
    for _ in range(2):
        flips = np.zeros(len(base), np.uint64)
        for _ in range(3):
            flips |= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
        rows.append(rows[-1] ^ flips)
    return np.unique(np.concatenate(rows))


def test_forest_of_blocks_finds_every_link():
    fps = near_numbers(300)
    want = plain_components([int(x) for x in fps], 4)
    for block in (7, 64, 512):
        rows, roots = simhash.forest_of(fps, None, 4, block)
        parent = dict(zip(rows.tolist(), roots.tolist()))
        assert [parent.get(k, k) for k in range(len(fps))] == want
        assert len(rows) < len(fps)


def test_tiles_of_any_size_agree(spark):
    fps = near_numbers(240, 5)
    want = plain_components([int(x) for x in fps], 4)
    nodes = spark.createDataFrame([(k, int(x)) for k, x in enumerate(fps.view(np.int64).tolist())], "node bigint, fp bigint")
    for tile in (3, 40, 10_000):
        edges = simhash.links(nodes, tile_rows=tile).collect()
        parent = list(range(len(fps)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        assert [root(k) for k in range(len(fps))] == want


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fp == 0 and {by_id[k].component_id for k in (1, 2, 3)} == {1}
    assert [r.component_id for r in rows if r.doc_id == 5] == [5, 5] and by_id[None].component_id == 5
    assert simhash.near_duplicates(no_docs).count() == 0


def test_end_to_end_against_brute_force(spark):
    import random

    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 30, 200]))) for _ in range(60)]
    texts += [t + " one" for t in texts[:20]] + [t + " one more" for t in texts[:20]] + texts[:10]
    ids = [rng.choice([None, *range(50)]) for _ in texts]
    want = plain_components([plain_fingerprint(t) for t in texts], 4)
    least = {}
    for root, key in zip(want, ids, strict=True):
        if key is not None:
            least[root] = min(key, least.get(root, key))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(3)
    got = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in simhash.near_duplicates(df, tile_rows=16).collect())
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert got == sorted((str(k), signed(plain_fingerprint(t)), str(least.get(r))) for k, t, r in zip(ids, texts, want, strict=True))


def test_ids_of_unlike_texts_do_not_join_groups(spark):
    a, b = "the quick brown fox jumps over the lazy dog again", "completely different words are standing in this other text here"
    df = spark.createDataFrame([(1, a), (1, b), (5, a), (6, b)], "doc_id bigint, text string")
    rows = simhash.near_duplicates(df).collect()
    assert {r.component_id for r in rows} == {1} and len({r.group_fp for r in rows}) == 2


def jaccard(a, b, size=5):
    sets = []
    for t in (a, b):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_similar_groups_are_those_of_exact_similarity(spark):
    import random

    rng = random.Random(4)
    words = [f"v{k}" for k in range(600)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([30, 80, 200]))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.choice([1, 1, 2, 3, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "one two", "One two", "one two three", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for tile in (20, 100_000):
        got = {r.id: r.group for r in simhash.similar_groups(df, "id", tile_rows=tile).collect()}
        pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
        assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
        root = list(range(len(texts)))
        for i, j in pairs:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
        # Nothing is put together that exact similarity does not connect.
        assert all(root[i] == root[g] for i, g in got.items()) and len(got) == len(texts)


def test_pairs_of_a_large_group_are_a_forest():
    fps = np.unique(near_numbers(900, 11))
    found = simhash.pairs_of(fps, None, 13, 64)
    assert len(found) < len(fps) and all((int(fps[a]) ^ int(fps[b])).bit_count() <= 13 for a, b in found)
    want = plain_components([int(x) for x in fps], 13)
    forest = simhash.Forest(len(fps))
    for a, b in found:
        forest.join(np.array([a]), np.array([b]))
    assert forest.roots(np.arange(len(fps))).tolist() == want


def test_similar_groups_miss_no_pair(spark):
    import random

    rng = random.Random(7)
    words = [f"v{k}" for k in range(2_000)]
    common = [rng.choice(words) for _ in range(12)]
    base = [rng.choice(words) for _ in range(24)]
    texts = []
    for _ in range(120):
        # Short texts whose fingerprints lie far apart, many with one passage, at just the similarity or just below.
        own = [rng.choice(words) for _ in range(rng.choice([4, 9, 14, 24]))] + (common if rng.random() < 0.5 else [])
        for cut in (0, 1, 2, 3):
            texts.append(" ".join(own[cut:]))
    texts += [" ".join(base[:k]) for k in range(8, 25)] + ["", None, "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    root = list(range(len(texts)))
    for i, j in pairs:
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if r == old else r for r in root]
    prints = [plain_fingerprint(t, 5) for t in texts]
    assert any((prints[i] ^ prints[j]).bit_count() > 13 for i, j in pairs)
    got = {r.id: r.group for r in simhash.similar_groups(df, "id").collect()}
    root = {i: min(j for j in range(len(texts)) if root[j] == root[i]) for i in range(len(texts))}
    assert got == root


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    hashes = np.arange(0, 60, 3)
    ranks = rng.permutation(len(hashes))
    for _ in range(2_000):
        a = np.unique(rng.integers(0, 60, rng.integers(1, 40)))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(1, len(a) + 1)], rng.integers(0, 60, rng.integers(0, 3))]))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            both = len(np.intersect1d(*(simhash.prefix_of(x, 0.8, hashes, ranks) for x in (a, b))))
            assert both >= min(simhash._least(min(len(a), len(b))), len(np.intersect1d(a, b)))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = np.unique(rng.integers(-(2**63), 2**63, rng.integers(1, 500)))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(1, len(a) + 1)], rng.integers(-(2**63), 2**63, rng.integers(0, 60))]))
        x, y = (simhash.parities(s) for s in (a, b))
        while len(x) != len(y):
            x, y = (z[: len(z) // 2] ^ z[len(z) // 2 :] if len(z) > min(len(x), len(y)) else z for z in (x, y))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
    assert (simhash.parities(np.zeros(1, np.int64)) == [1]).all()


def test_sets_travel_only_for_possible_pairs(spark):
    import random

    rng = random.Random(11)
    base = [f"v{rng.randrange(10_000)}" for _ in range(300)]
    texts = [" ".join(base), " ".join(base[:-20]), " ".join(base[:150] + [f"w{k}" for k in range(150)]), " ".join(f"x{k}" for k in range(300)), " ".join(base[:20])]
    df = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    pairs = spark.createDataFrame([(i, j) for j in range(5) for i in range(j)], "src bigint, dst bigint")
    assert [tuple(r) for r in simhash._possible(df, pairs, 0.8, 5).collect()] == [(0, 1)]
    assert [tuple(r) for r in simhash._similar(df, pairs, 0.8, 5).collect()] == [(0, 1)]


def test_late_postings_do_not_meet(spark):
    # Two texts of 100 shingles each need an overlap of 89, so of 4 shared ones none stands behind place 15.
    rows = [(h, node, node, at, 100) for node in (1, 2) for h, at in zip(range(4), (1, 2, 3, 15))]
    rows += [(h, node, node, at, 100) for node in (3, 4) for h, at in zip(range(10, 14), (1, 2, 3, 16))]
    shared = spark.createDataFrame(rows, "h bigint, node bigint, group bigint, at int, n int")
    for star in (True, False):
        got = {tuple(sorted(r)) for r in simhash._across(shared, 0.8, star).collect()}
        assert got == {(1, 2)}


def test_shingles_of_few_texts_in_a_row_are_compared_last(spark):
    docs = spark.createDataFrame([(k, f"one two three four five own{k}") for k in range(3)], "id int, text string").coalesce(1)
    hashes, ranks = simhash._common_shingles(docs, docs["text"], 5)
    assert hashes.view(np.uint64).tolist() == [xxhash.xxh64_intdigest(b"one two three four five", 42)] and ranks.tolist() == [0]
