import random

import numpy as np
import pytest

from glyphaudit.llm import jaccard


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(texts, size, percent):
    sets = {d: shingles(t, size) for d, t in texts}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus():
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, base, line = [], [fresh(n) for n in (60, 120, 8, 200)], fresh(30)
    for i in range(90):
        words = list(base[i % 4]) if i % 3 else fresh(rng.randrange(1, 90))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        texts.append((i, " ".join(words + (line if i % 5 == 0 else []))))
    texts += [(200 + i, " ".join(base[1])) for i in range(10)]
    return texts + [(300, ""), (301, None), (302, "A b"), (303, "a B"), (304, "a b c"), (305, " \n "), (306, "a a a a a a a a")]


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_like_brute_force(docs_of, monkeypatch, size, percent):
    monkeypatch.setattr(jaccard, "COMMON_LEAST", 6)
    texts = corpus()
    got = jaccard.near_groups(docs_of(texts, extra=True), size, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts, size, percent)


def test_repeated_rows_beside_half_alike_texts(docs_of):
    """A text that is stored several times has its n-grams counted once."""
    texts = []
    for i in range(12):
        shared, own = [f"s{i}_{k}" for k in range(58)], lambda side, i=i: [f"{side}{i}_{k}" for k in range(45)]
        texts += [(2 * i, " ".join(shared + own("a")))] * (1 + i % 3) + [(2 * i + 1, " ".join(shared + own("b")))] * 2
    want = brute(texts, 4, 85)
    assert want[0] == (100, 0) and want[1] == (100, 1)
    got = jaccard.near_groups(docs_of(texts)).collect()
    assert len(got) == len(texts) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    nameless = jaccard.near_groups(docs_of([(None if d % 2 else d, t) for d, t in texts])).collect()
    assert len({r["component"] for r in nameless}) == 24


def test_copies_with_edits_of_their_own(docs_of, monkeypatch):
    """A family that shares common n-grams: members that link with the base, with one another only, or with none."""
    monkeypatch.setattr(jaccard, "COMMON_LEAST", 6)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = [(0, " ".join(base))]
    for i in range(1, 70):
        words = base[: rng.choice((120, 135, 150))]
        for k in rng.sample(range(8), rng.choice((1, 2, 4, 6))):
            words[k * 14] = f"e{i % 9}_{k}"
        texts.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs_of(texts)).collect()}
    assert got == brute(texts, 4, 85)
    assert len({c for _, c in got.values()}) > 3


@pytest.mark.parametrize("chains", [True, False])
def test_fragments_propose_every_pair(docs_of, monkeypatch, chains):
    """Without the links between neighbours, the index and probe entries alone find all components."""
    if not chains:
        monkeypatch.setattr(jaccard, "_chained", lambda classes, salts, percent: classes.select(*jaccard._pair("cid", "cid", "n", "n")).limit(0))
    monkeypatch.setattr(jaccard, "COMMON_LEAST", 5)
    texts = corpus()
    got = jaccard.near_groups(docs_of(texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts, 4, 85)


@pytest.mark.parametrize("edits", [2, 5])
def test_pairs_of_a_family_follow_its_size(docs_of, monkeypatch, edits):
    """Copies of one text, each with edits of its own, and no text in their middle: pairs that are put out stay near the number of members."""
    counts = {}
    put = jaccard.Scratch.put

    def counted(self, df, name, *more):
        out = put(self, df, name, *more)
        if name == "proposed" or name.startswith("some"):
            counts[name] = out.count()
        return out

    monkeypatch.setattr(jaccard.Scratch, "put", counted)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = []
    for i in range(240):
        words = list(base)
        for k in rng.sample(range(len(base)), edits):
            words[k] = f"x{i}_{k}"
        texts.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs_of(texts)).collect()}
    assert got == brute(texts, 4, 85)
    assert sum(counts.values()) <= 6 * len(texts), counts


def test_parity_bits_never_differ_in_more_than_the_sets_do():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    for _ in range(200):
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 700))) for _ in range(2))
        for longs in (jaccard.ODD, jaccard.WIDE):
            bits = sum(int(x).bit_count() for x in (jaccard.parity(a, longs) ^ jaccard.parity(b, longs)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b))


def test_sets_that_meet_in_one_hash_are_told_apart(spark):
    scratch = jaccard.Scratch(spark, "test")
    sets = spark.createDataFrame([(1, 7, 1, 5), (2, 7, 2, 5), (3, 7, 1, 5), (4, 8, 1, 5), (5, 0, 0, 0)], "doc_id long, cid long, alt long, n long")
    cid = {r["doc_id"]: r["cid"] for r in jaccard._told_apart(sets, scratch).collect()}
    assert cid[1] == cid[3] != cid[2] and len(set(cid.values())) == 4 and cid[5] == 0


def test_long_chain_is_one_component(docs_of):
    words = [f"c{i}" for i in range(400)]
    texts = [(i, " ".join(words[i * 3 : i * 3 + 100])) for i in range(60)]
    got = {r["component_id"] for r in jaccard.near_groups(docs_of(texts)).collect()}
    assert got == {0}


def test_one_of_each(docs_of):
    a, b = "the same words in every copy of it", "quite another text with other words in"
    out = jaccard.one_of_each(docs_of([(3, a), (1, a), (2, b), (1, a), (5, ""), (5, ""), (6, None), (None, b)], extra=True), 5, 80)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())) == sorted([(True, 1, a), (False, 0, b), (True, 5, ""), (True, 5, ""), (True, 6, "")])


def test_empty(docs_of):
    assert jaccard.near_groups(docs_of([])).count() == 0


def test_prefixes_of_similar_sets_meet():
    for n in range(1, 300):
        p = jaccard.prefix_length(n, 85)
        assert 1 <= p <= n and p == n - int(np.ceil(n * 85 / 100)) + 1


def test_words_are_hashed_together(monkeypatch):
    """Short words cost no call each; sets are those of the words, whatever stands beside a text."""
    long, calls = "y" * 17, []
    hashed = jaccard.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard.xxhash, "xxh3_64_intdigest", lambda x: calls.append(x) or hashed(x))
    texts = [None, "", " \n", "a", "A b", "a b c a b c a b", "a\0 b c d", "a\0\0 b c d", "é\x1c\x85\u3000 z\x0bc\td", f"{'x' * 8} {'x' * 9} {'x' * 15} {'x' * 16} {long} {long}z", " ".join(f"{i:x}" for i in range(3000))]
    sets = [jaccard.Shingles(4).of(t) for t in texts]
    assert set(calls) == {long.encode(), f"{long}z".encode()}
    assert all(np.array_equal(a, b) for a, b in zip(sets, jaccard.Shingles(4).each(texts), strict=True))
    own = {}
    for text, grams in zip(texts, sets, strict=True):
        words = text.encode().lower().split() if text else []
        want = {tuple(words)} if 0 < len(words) < 4 else {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
        assert len(want) == len(grams) == len(set(grams.tolist()))
        own |= {frozenset(want): frozenset(grams.tolist())}
    assert len(set(own.values())) == len(own)
    starts, _ = jaccard.word_hashes(b"ab  c" + b" d" * (jaccard.WORDS_AT_ONCE + 1))
    assert starts[:3].tolist() == [0, 4, 6] and len(starts) == jaccard.WORDS_AT_ONCE + 3


def test_entries_of_one_component_or_of_sizes_that_cannot_meet_are_not_kept(spark):
    """Two classes under an n-gram, which their sizes or places keep apart, or which are joined already, put nothing out."""
    none = [0] * jaccard.ODD
    sets = [(1, 100, [-9, -7]), (2, 120, [-9, -8]), (3, 100, [-6]), (4, 110, [-6]), (5, 100, [-5]), (6, 100, [-5]), (7, 100, [-4 - k for k in range(0, -12, -1)]), (8, 100, [-4 - k for k in range(0, -12, -1)])]
    classes = spark.createDataFrame([(c, n, p, none, []) for c, n, p in sets], "cid long, n long, prefix array<long>, odd array<long>, wide array<long>")
    roots = spark.createDataFrame([(c, 5 if c == 6 else c) for c, _, _ in sets], "node long, root long")
    kept = {(r["gram"], r["cid"], r["at"]) for r in jaccard._entries(classes, roots, 85).collect()}
    # Of 100 n-grams the first 9 are index entries: equal sizes can't first meet at a later place.
    assert kept == {(-6, 3, 0), (-6, 4, 0)} | {(-4 + k, c, k) for k in range(9) for c in (7, 8)}


def test_stars_are_components_at_once(spark, monkeypatch):
    """Edges that lead to the least node already are turned no more; new links are looked at between components only."""
    names, put = [], jaccard.Scratch.put
    monkeypatch.setattr(jaccard.Scratch, "put", lambda self, df, name, *more: names.append(name) or put(self, df, name, *more))
    links = spark.createDataFrame([(1, k) for k in range(2, 9)] + [(21, 20)], "a long, b long")
    found = {r["node"]: r["root"] for r in jaccard.components(links).collect()}
    assert found == {k: 1 for k in range(1, 9)} | {20: 20, 21: 20} and names == ["0"]
    roots = spark.createDataFrame([(k, 1 if k < 9 else k) for k in range(1, 12)], "node long, root long")
    more = spark.createDataFrame([(3, 10), (8, 10), (4, 5)], "a long, b long")
    out = jaccard._rooted(roots, more, jaccard.Scratch(spark, "test"), "roots")
    assert {r["node"]: r["root"] for r in out.collect()} == {k: 1 for k in range(1, 9)} | {9: 9, 10: 1, 11: 11}
    assert names == ["0", "0", "roots"]
