import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphaudit.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGES = ["", "  ", "a", "abc" * 500, "It's we'll 12 don't!!", "Σσς ΑΣ İ", "naïve café é", "<|endoftext|>a<|startoftext|> <|x|>", "\x1c\x85  x y", "世界 नम́ ﬁ 😀", "a\x00b", "x" * 3000]


@pytest.fixture(scope="module")
def tools():
    reference = Tokenizer.from_file(PATH)
    reference.no_truncation()
    reference.no_padding()
    return bpe.WordBpe(bpe.read_model(PATH)), reference


def test_encoding_and_decoding(tools):
    own, reference = tools
    rng = random.Random(4)
    texts = EDGES + ["".join(rng.choice("abcdethinginstr'sΣσİñé12!?-_<>| \n") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["".join(rng.choice("aaabin gthe") for _ in range(60)) for _ in range(500)]
    for text in texts:
        ids = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode_bytes(ids).decode() == reference.decode(ids, skip_special_tokens=False)


def test_small_memory_gives_the_same(tools):
    small = bpe.WordBpe(bpe.read_model(PATH), cache_words=3)
    text = "the quick brown fox, the lazy dog! " * 20
    assert small.encode(text) == tools[0].encode(text)


def test_frame(docs_of, tools):
    out = bpe.encode_documents(docs_of([*EDGES, None, (None, "the"), (0, "")], extra=True), PATH).collect()
    assert len(out) == len(EDGES) + 3
    assert [r["ids"] for r in out if r["doc_id"] is None] == [tools[0].encode("the")]
    assert all(r["ids"] == [] and r["decoded"] == "" for r in out if r["doc_id"] == len(EDGES))
    assert bpe.encode_documents(docs_of([]), PATH).count() == 0


def test_single_characters_are_not_matched():
    """The automaton reports no token of one character: these are looked up, and every piece costs a match less a character."""
    own = bpe.WordBpe(bpe.read_model(PATH))
    matches = list(own._automaton.iter("unquestionably" + bpe._END))
    assert matches and all(back > 0 for _, (_, back) in matches)
    assert len(own._single) == 257 and own._single["q"] >= 0
