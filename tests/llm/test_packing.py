import itertools
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from glyphaudit.llm import common, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_is_a_continuous_bijection():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert(points, bits)
        assert sorted(keys) == list(range(len(points)))
        path = points[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(pieces, texts):
    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert len(by_doc) == len(texts)
    for i, text in texts.items():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, packing.SEPARATOR]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            part = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids)
    for own_pieces in by_sequence.values():
        at = 0
        for p in sorted(own_pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == packing.LENGTH or at & (at - 1) == 0
    # Sequences at a power of two need no padding and no other length occurs, so none is padded.
    filled = sum(p["length"] for p in pieces)
    assert sum(sum(p["length"] for p in x) == packing.LENGTH for x in by_sequence.values()) >= filled // packing.LENGTH - 1


def test_pieces(docs_of):
    texts = ["", None, "the cat sat", "word " * 5000, *["same text here"] * 40, *[f"number {i} of many" * (i % 9) for i in range(60)]]
    pieces = packing.digest(packing.pack(docs_of(texts, extra=True), PATH)).collect()
    check(pieces, dict(enumerate(texts)))


def test_rows_equal_in_key_and_id_are_split(docs_of, monkeypatch):
    """One text under no doc_id in all rows still fills several ranges."""
    monkeypatch.setattr(packing, "RANGE_BYTES", 2000)
    pieces = packing.digest(packing.pack(docs_of([(None, "the same text " * 50)] * 300), PATH)).collect()
    assert sum(p["start"] == 0 for p in pieces) == 300
    ranges = {}
    for p in pieces:
        ranges[p["sequence_id"] >> 40] = ranges.get(p["sequence_id"] >> 40, 0) + p["length"]
    assert len(ranges) > 3 and max(ranges.values()) < 0.6 * sum(ranges.values())


def test_empty(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0


def test_finished_tasks_give_back_arrow_memory(monkeypatch):
    released = []

    class Pool:
        def release_unused(self):
            released.append(True)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common.slices([], 1)) == [] and released


def test_a_document_s_key_does_not_depend_on_its_neighbours():
    """Sums of projected tokens are a document's own, whatever comes before it; a document without tokens has the key of zero."""
    table = packing.projection(50_000)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50_000, n) for n in (3, 0, 700, 1, 0, 0, 90)]
    counts = np.array([len(d) for d in docs])
    keys = packing.curve_keys(np.concatenate(docs), counts, table)
    for d, key in zip(docs, keys, strict=True):
        assert packing.curve_keys(d, np.array([len(d)]), table)[0] == key
    mean = np.array([table[d].sum(axis=0, dtype=np.float64) / max(len(d), 1) for d in docs])
    unit = (np.arctan(4.0 * mean) / np.pi + 0.5) * (1 << packing.BITS)
    near = packing.hilbert(np.minimum(unit.astype(np.int64), (1 << packing.BITS) - 1))
    assert (near == keys).sum() >= 5
