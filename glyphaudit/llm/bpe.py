"""Operator 8: exact byte-pair encoding by backtracking, and decoding by an offset table.

The vocabulary file is one of the public tokenizers' JSON files with word ends. An Aho-Corasick
automaton over all tokens of two characters and more gives the longest token at each position of a piece; where it has none, the character's own is the longest. Going left to
right, the longest token is taken that is compatible with the token before it; a pair is
compatible when merging the two tokens' characters together would leave the boundary between
them. Without any, the encoder steps back. Tokens never have to be merged pair by pair, and the
result is what merging by rank gives.

Texts: null counts as empty, an empty text has no tokens. Repeated rows and ties give equal
results; only the text column is read, so extra columns do no harm.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphaudit.llm.common import slices

#: Stands for the end of a word inside the automaton; no byte maps to it.
_END = "\x00"
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SIGMA = "Σ"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-end BPE vocabulary given as the JSON text of its file.

    ``cache_words``: how many distinct words are remembered before the memory is cleared.
    """

    def __init__(self, model_json: str, cache_words: int = 600_000):
        spec = json.loads(model_json)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        names = [""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name
        self._tables(names)
        self.code = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(split)
        self._symbol = _byte_symbols()

        keys = {name[: -len(self.suffix)] + _END if name.endswith(self.suffix) else name: i for name, i in vocab.items()}
        self._automaton = ahocorasick.Automaton()
        self._single = {c: keys.get(c, -1) for c in [*self._symbol, _END]}
        for key, i in keys.items():
            if len(key) > 1:
                self._automaton.add_word(key, (i, len(key) - 1))
        self._automaton.make_automaton()
        self._length = [0] * size
        self._shorter = [-1] * size
        for key, i in keys.items():
            self._length[i] = len(key)
            cut = next((keys[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in keys), -1)
            self._shorter[i] = cut
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        for a, b in merges:
            made = vocab[a + b]
            self._rank.setdefault((vocab[a], vocab[b]), made)
            self._parts.setdefault(made, (vocab[a], vocab[b]))
        self._compatible: dict[int, bool] = {}
        self.cache_words = cache_words
        self._words: dict[str, bytes] = {}

    # -- decoding ---------------------------------------------------------------------------
    def _tables(self, names: list[str]) -> None:
        encoded = [n.encode() for n in names]
        self.offsets = np.zeros(len(names) + 1, np.int64)
        np.cumsum([len(x) for x in encoded], out=self.offsets[1:])
        self.blob = b"".join(encoded)
        o = self.offsets.tolist()
        self._slices = [self.blob[o[i] : o[i + 1]] for i in range(len(names))]
        self._decimal = [str(i) for i in range(len(names))]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """Tokens cut from the offset table; this vocabulary has no decoder, so they are joined by spaces."""
        return b" ".join(map(self._slices.__getitem__, ids))

    def decimal(self, ids: Iterable[int]) -> bytes:
        return " ".join(map(self._decimal.__getitem__, ids)).encode()

    # -- encoding ---------------------------------------------------------------------------
    def _keeps(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the boundary between these two tokens.

        Both tokens are unmerged step by step, the later merge first. A merge across the boundary
        wins if it comes before the merges that already hold on both sides.
        """
        a, b, bound, parts, rank = left, right, 1 << 60, self._parts, self._rank
        while True:
            across = rank.get((a, b))
            if across is not None and across < bound:
                return False
            if a in parts and (a > b or b not in parts):
                bound, a = a, parts[a][1]
            elif b in parts:
                bound, b = b + 1, parts[b][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        """``_keeps`` from the pair-compatibility table, which fills as pairs are met."""
        pair = left << 32 | right
        known = self._compatible.get(pair)
        if known is None:
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
            known = self._compatible[pair] = self._keeps(left, right)
        return known

    def _symbols(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        return "".join(map(self._symbol.__getitem__, piece.encode("utf-8", "surrogatepass")))

    def _tokens(self, pieces: list[str]) -> Iterator[list[int]]:
        """Tokens of each piece, the pre-tokenizer's unit; the automaton reads all in one go, as no token goes on after a word's end."""
        symbols = _END.join([*map(self._symbols, pieces), ""])
        length, shorter, pairs, compatible = self._length, self._shorter, self._compatible.get, self.compatible
        longest = [*map(self._single.__getitem__, symbols), -1]
        for end, (i, back) in self._automaton.iter(symbols):
            longest[end - back] = i
        dead: set[int] = set()
        at = 0
        for piece in pieces:
            out: list[int] = []
            n, token, before = symbols.index(_END, at) + 1, longest[at], -1
            while at < n:
                while token >= 0:
                    to = at + length[token]
                    if before < 0:
                        if to not in dead:
                            break
                    else:
                        fits = pairs(before << 32 | token)
                        if (compatible(before, token) if fits is None else fits) and to not in dead:
                            break
                    token = shorter[token]
                if token >= 0:
                    out.append(token)
                    at, before = to, token
                    token = longest[at]
                else:
                    if not out:
                        raise ValueError(f"no tokens for {piece!r}")
                    dead.add(at)
                    token = out.pop()
                    before = out[-1] if out else -1
                    at -= length[token]
            yield out

    def _cut(self, word: str) -> list[str]:
        if word.isalpha():
            return [word]
        if word[:-1].isalpha() and word[-1] in ".,!?;:":
            return [word[:-1], word[-1]]
        return self._pieces.findall(word)

    def _learn(self, words: list[str]) -> list[bytes]:
        """Packed tokens of normalised runs of characters without white space."""
        known = self._words
        if len(known) >= self.cache_words:
            known.clear()
        cut = list(map(self._cut, words))
        new = list({p: None for pieces in cut for p in pieces if p not in known})  # a piece taken as a word is the same piece
        code, fresh = self.code, {}
        for piece, ids in zip(new, self._tokens(new), strict=True):
            fresh[piece] = array(code, ids).tobytes()
        known.update(fresh)
        out = []
        for word, pieces in zip(words, cut, strict=True):
            if len(pieces) == 1:
                out.append(known[pieces[0]])
            else:
                known[word] = ids = b"".join(map(known.__getitem__, pieces))
                out.append(ids)
        for x in fresh:
            if len(x) > 64:
                del known[x]
        for x in words:
            if len(x) > 64:
                known.pop(x, None)
        return out

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _SIGMA in text:  # str.lower() would look at the letters around it
                text = text.replace(_SIGMA, "σ")
        text = text.lower()
        words = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
        found = list(map(self._words.get, words))
        if None in found:
            missing = [k for k, ids in enumerate(found) if ids is None]
            for k, ids in zip(missing, self._learn([words[k] for k in missing]), strict=True):
                found[k] = ids
        return b"".join(found)

    def packed(self, text: str | None) -> bytes:
        """A text's ids one after another, as ``dtype``."""
        if not text:
            return b""
        if self._special is None or "<" not in text:
            return self._plain(text)
        at, out = 0, []
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), array(self.code, [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), self.dtype).tolist()


_LOADED: dict[str, WordBpe] = {}


def loaded(model_json: str) -> WordBpe:
    """One encoder for each vocabulary in a Python worker."""
    key = str(hash(model_json))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(model_json)
    return _LOADED[key]


def read_model(path: str) -> str:
    """The vocabulary file's text; read on the driver and sent along, so executors need no copy."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def n_ids(model_json: str) -> int:
    """One more than the largest id."""
    spec = json.loads(model_json)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` for every row of ``docs(doc_id, text, ...)``.

    ``vocabulary``: path of a tokenizer JSON file on the driver. Every row gives one row.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(model.value)
        for part in slices(batches, 4 << 20):
            packed = [bpe.packed(t) for t in part.column("text").to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(x) // bpe.dtype.itemsize for x in packed], out=offsets[1:])
            flat = np.frombuffer(b"".join(packed), bpe.dtype).astype(np.int32)
            decoded = [bpe.decode_bytes(np.frombuffer(x, bpe.dtype).tolist()) for x in packed]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, ids array<int>, decoded string")
