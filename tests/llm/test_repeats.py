import random

import numpy as np
import pytest

from glyphaudit.llm import repeats, suffixes


def brute(texts, window):
    """(n_words, kept) by (doc_id, text), earliest first."""
    seen, out = {}, {}
    for doc_id, text in sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        words = (text or "").encode().split()
        cut = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                cut[i : i + window] = [True] * window
            else:
                seen[key] = True
        out[doc_id, text] = (len(words), b" ".join(w for w, c in zip(words, cut, strict=True) if not c).decode())
    return out


def corpus(window, n=60):
    rng = random.Random(window)
    fresh = lambda k: " ".join(f"w{rng.randrange(400)}" for _ in range(k))
    shared = [fresh(window + e) for e in (0, 1, 30, 200)] + [fresh(window - 1)]
    line = "one very common line of words"
    texts = []
    for i in range(n):
        parts = [fresh(rng.randrange(0, 80)), rng.choice(shared), line, fresh(rng.randrange(0, 40)), rng.choice(shared) if i % 3 else ""]
        texts.append((i, ("\n" if i % 2 else "  ").join(parts)))
    texts += [(100 + i, texts[i % 5][1]) for i in range(20)]
    return texts + [(200, ""), (201, None), (202, "short"), (203, "a " * 300), (None, shared[2])]


@pytest.mark.parametrize("remove, window", [(repeats.remove_repeats, 20), (suffixes.remove_passages, 50)])
@pytest.mark.parametrize("chunk", [300, 2_500_000])
def test_like_brute_force(docs_of, monkeypatch, remove, window, chunk):
    monkeypatch.setattr(repeats, "CHUNK_WINDOWS", chunk)
    texts = corpus(window)
    expected = brute(texts, window)
    rows = remove(docs_of(texts, extra=True).repartition(3)).collect()
    assert len(rows) == len(texts)
    by_id = {d: v for (d, _), v in expected.items()}
    for r in rows:
        assert (r["n_words"], r["kept"]) == by_id[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("remove, window", [(repeats.remove_repeats, 20), (suffixes.remove_passages, 50)])
def test_windows_dealt_out_in_several_steps(docs_of, monkeypatch, remove, window):
    """Past ``2 ** FAN_BITS`` buckets, rows go through steps between; hot runs are compared by hashes."""
    monkeypatch.setattr(repeats, "FAN_BITS", 2)
    monkeypatch.setattr(repeats, "CHUNK_WINDOWS", 500)
    monkeypatch.setattr(suffixes, "GROUP", 4)
    texts = corpus(window)
    expected = {d: v for (d, _), v in brute(texts, window).items()}
    for r in remove(docs_of(texts).repartition(4)).collect():
        assert (r["n_words"], r["kept"]) == expected[r["doc_id"]], r["doc_id"]


def test_null_and_least_ids_are_two_documents(docs_of):
    """No doc_id stands for null inside; null comes first."""
    a, b = (" ".join(f"{x}{i}" for i in range(70)) for x in "ab")
    for remove in (repeats.remove_repeats, suffixes.remove_passages):
        for least in (f"{a} {b}", b):
            out = {r["doc_id"]: r["kept"] for r in remove(docs_of([(-(1 << 63), least), (None, a), (5, "z " + b)])).collect()}
            assert out == {None: a, -(1 << 63): b, 5: "z"}


def test_places_are_packed_without_loss():
    rng = np.random.default_rng(2)
    for n in (1, 500):
        docs, parts, starts = rng.integers(-9, 9, n), rng.integers(0, 2, n), rng.integers(0, 1 << 32, n).astype(np.uint32)
        for order in (np.arange(n), np.lexsort((starts, parts, docs))):
            got = repeats._unpack(repeats._pack(docs[order], parts[order], starts[order]))
            assert all((g == w[order]).all() for g, w in zip(got, (docs, parts, starts), strict=True))


def test_equality_takes_both_hashes():
    """Windows whose first hashes agree by chance are told apart by the second."""
    docs, none = np.array([1, 2, 3]), np.zeros(3, np.int64)
    late, _ = repeats.repeated(docs, none, none, np.full(3, 7, np.uint64), np.array([1, 2, 1], np.uint32), False)
    assert late.tolist() == [False, False, True]


@pytest.mark.parametrize("least, lead", [(6, 2), (9, 3)])
def test_sorted_suffixes_like_brute_force(least, lead):
    """Passages around suffixes with one leading run: all but the earliest of equal ones."""
    rng = random.Random(least)
    texts = [[rng.randrange(1, 4) for _ in range(rng.randrange(least, 40))] for _ in range(60)]
    rows = []
    for d, t in enumerate(texts):
        for at in range(0, len(t) - lead + 1, 2):
            low, high = max(0, at - (least - lead)), min(at, len(t) - least)
            if low <= high:
                rows.append((hash(tuple(t[at : at + lead])) % 1000, d, 0, at, low, high, t[low : high + least]))
    rows += rows[:5]
    seen, want = {}, set()
    for seed, d, _, at, low, high, _ in sorted(set((*r[:6], 0) for r in rows), key=lambda r: (r[1], r[3])):
        for s in range(low, high + 1):
            key = (seed, at - s, tuple(texts[d][s : s + least]))
            if seen.setdefault(key, (d, at)) != (d, at):
                want.add((d, s))
    got = suffixes.late_of(*(np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:6]), [r[6] for r in rows], least, lead)
    assert {(int(d), int(s)) for d, s in zip(got[0], got[2], strict=True)} == want


@pytest.mark.parametrize("remove", [repeats.remove_repeats, suffixes.remove_passages])
def test_repeated_rows_are_one_document(docs_of, remove):
    text = " ".join(f"v{i}" for i in range(80))
    rows = remove(docs_of([(1, text), (1, text), (1, "other " + text), (2, text)])).collect()
    kept = sorted((r["doc_id"], len(r["kept"].split())) for r in rows)
    assert len(rows) == 4 and kept.count((1, 80)) + kept.count((1, 81)) >= 1 and (2, 0) in kept
    same = [r["kept"] for r in rows if r["doc_id"] == 1 and r["n_words"] == 80]
    assert same[0] == same[1]


@pytest.mark.parametrize("remove", [repeats.remove_repeats, suffixes.remove_passages])
def test_empty(docs_of, remove):
    assert remove(docs_of([])).count() == 0


def test_in_place(docs_of):
    long = " ".join(f"v{i}" for i in range(90))
    clean = "clean\ntext  with  its own spaces"
    docs = docs_of([(1, long + " first"), (2, "second " + long), (3, clean), (4, long)], extra=True)
    out = {r["doc_id"]: r["text"] for r in suffixes.cleaned(docs).collect()}
    assert out == {1: long + " first", 2: "second", 3: clean}
    assert suffixes.cleaned(docs).columns == docs.columns
