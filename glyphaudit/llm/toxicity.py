"""Operator 3: toxicity by compression distance with two zstandard dictionaries.

zstandard's dictionary trainer makes one dictionary of ordinary and one of toxic text. A window
of ``WINDOW`` words, lower case, is compressed with the ordinary dictionary, and with the toxic
one put behind it; its distance is how many bytes the toxic one saves. Where that reaches a
threshold, the window's words are compressed alone in the same way: a single word is told from
several that each save a little by a second threshold. Each byte is spelled as two, since zstandard
spends about three bytes on a match and would not tell short words apart.

Toxic documents consist of ordinary text for the most part, and so would the first toxic
dictionary. It is trained again, in ``ROUNDS`` steps, on what it picked out: windows of toxic
documents whose distance few ordinary windows reach, less the words in them that save nothing
or that only one document has. Both thresholds and the toxic dictionary's size, doubled from
``TOXIC_BYTES`` as long as there is text for it, are calibrated on labelled documents that the
dictionaries have not seen, by the loss of a logistic fit on the number and share of words
beyond both thresholds and on the largest distance; this fit gives the score.

Fitting takes at most ``MOST_TOXIC`` and ``MOST_ORDINARY`` labelled documents, drawn by a hash of
doc_id, none longer than ``LONGEST_TEXT`` characters, and weighs them back to their share among all labels.
Every window of every text is scored; words over ``LONGEST_WORD`` bytes count as several. Null and
empty texts have no windows and get the score of no evidence. Without two toxic and two ordinary
examples every score is the examples' share. Repeated rows get equal scores; an empty table gives no rows. Only
doc_id and text are read; columns that the caller has under the names of results are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphaudit.llm.common import slices

#: Labelled documents drawn for fitting, and characters of one at most.
MOST_TOXIC, MOST_ORDINARY, LONGEST_TEXT = 1200, 3000, 50_000
#: Words of a window.
WINDOW = 6
#: Bytes of the ordinary dictionary, of the first toxic one, and of the least one tried at the end.
ORDINARY_BYTES, FIRST_BYTES, TOXIC_BYTES = 65_536, 32_768, 1024
#: Times the toxic dictionary is trained again on what it picked out.
ROUNDS = 2
#: A word is kept for training if it saves so many bytes, and is in so many toxic documents.
LEAST_SAVED, LEAST_SHARE, LEAST_DOCUMENTS = 4, 0.01, 2
LONGEST_WORD = 40
#: Distances are kept within these bounds.
LEAST, MOST = -5, 32


def _spellings() -> list[np.ndarray]:
    rng = np.random.default_rng(3)
    return [rng.permutation(256).astype(np.uint8) for _ in range(2)]


_WIDE = _spellings()


def wide(data: bytes) -> bytes:
    """Two bytes for each, so a match covers twice the length."""
    a = np.frombuffer(data, np.uint8)
    return np.stack([p[a] for p in _WIDE], axis=1).tobytes()


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def pieces_of(text: str | None) -> list[bytes]:
    """Words, very long runs cut into pieces."""
    return [w[at : at + LONGEST_WORD] for w in words_of(text) for at in range(0, len(w), LONGEST_WORD)]


class _Distances:
    """What the toxic dictionary saves on windows and words."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(ordinary + toxic)
        self.alone: dict[bytes, int] = {}

    def one(self, spelled: bytes) -> int:
        return min(MOST, max(LEAST, len(self.ordinary.compress(spelled)) - len(self.toxic.compress(spelled))))

    def word(self, word: bytes) -> int:
        """Remembered for 200000 words at most."""
        d = self.alone.get(word)
        if d is None:
            if len(self.alone) > 200_000:
                self.alone.clear()
            d = self.alone[word] = self.one(wide(b" " + word + b" "))
        return d

    def windows(self, words: list[bytes]) -> list[int]:
        return [self.one(x) for x in spelled_windows(words)]

    def beyond(self, words: list[bytes], threshold: int) -> list[int]:
        """Distances of the words in windows that reach the threshold."""
        return [self.word(w) for i, d in enumerate(self.windows(words)) if d >= threshold for w in words[i * WINDOW : (i + 1) * WINDOW]]


def spelled_windows(words: list[bytes]) -> list[bytes]:
    """Runs of WINDOW words with a space on either side, spelled wide."""
    if not words:
        return []
    text = wide(b" " + b" ".join(words) + b" ")
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.r_[0, ends[WINDOW - 1 : -1 : WINDOW]].tolist()
    ends = np.r_[ends[WINDOW - 1 : -1 : WINDOW], ends[-1]].tolist()
    return [text[2 * x : 2 * y + 2] for x, y in zip(begins, ends, strict=True)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(13, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of the samples; with too little text for its trainer, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    #: Of windows, and of words within them.
    threshold: int = 0
    least: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    #: Every score, where there was nothing to learn from.
    fixed: float | None = None

    def opened(self) -> _Distances | None:
        return None if self.fixed is not None else _Distances(self.ordinary, self.toxic)

    def score(self, known: _Distances | None, text: str | None) -> float:
        if known is None:
            return float(self.fixed)
        words = pieces_of(text)
        return float(_sigmoid(_features(np.array(known.beyond(words, self.threshold), np.int64), len(words), self.least) @ self.weights))


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _features(d: np.ndarray, n_words: int, least: int) -> np.ndarray:
    """From distances of words in windows beyond the first threshold."""
    n = int((d >= least).sum())
    return np.array([1.0, np.log1p(n), np.sqrt(n / max(1, n_words)) * 4, (int(d.max()) if n else 0) / 8.0])


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge; ``each`` weighs the rows."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        gradient = x.T @ (each * (p - y)) + ridge * w
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sizes(whole: int) -> list[int]:
    """Sizes of the toxic dictionary to try, as long as there is text for them."""
    return [TOXIC_BYTES << k for k in range(32) if k == 0 or TOXIC_BYTES << k < 4 * whole]


def _once(texts: list[str]) -> list[str]:
    """Each text once, so that copies don't count as evidence."""
    return list(dict.fromkeys(texts))


def _picked(known: _Distances, toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[list[bytes]]:
    """Words of each toxic document that its dictionary picks out, window by window."""
    usual = np.array([d for words in ordinary for d in known.windows(words)] or [0])
    cut = max(1.0, float(np.percentile(usual, 99)))
    found = []
    for i, words in enumerate(toxic):
        for k, d in enumerate(known.windows(words)):
            if d > cut:
                found.append((i, [w for w in words[k * WINDOW : (k + 1) * WINDOW] if known.word(w) >= LEAST_SAVED]))
    seen: dict[bytes, set[int]] = {}
    for i, words in found:
        for w in words:
            seen.setdefault(w, set()).add(i)
    least = max(LEAST_DOCUMENTS, int(len(toxic) * LEAST_SHARE))
    kept = [[w for w in words if len(seen[w]) >= least] for _, words in found]
    return [words for words in kept if words]


def _of_picked(picked: list[list[bytes]], frequent: bytes, size: int) -> bytes:
    """The dictionary of picked words, window by window, with those in front that the trainer leaves out."""
    content = trained([wide(b" " + b" ".join(words) + b" ") for words in picked], size)
    known = _Distances(frequent, content)
    counts = Counter(w for words in picked for w in words)
    rest = [w for w, _ in sorted(counts.items(), key=lambda x: (x[1], x[0])) if known.word(w) < LEAST_SAVED]
    return wide(b" " + b" ".join(rest) + b" ")[-size:] + content if rest else content


def fit(toxic: list[str], ordinary: list[str], share: float | None = None) -> Model:
    """``share`` is that of toxic ones among all labels, where the examples are drawn with another."""
    n_t, n_o = len(toxic), len(ordinary)
    if share is None:
        share = n_t / (n_t + n_o) if n_t + n_o else 0.0
    if n_t < 2 or n_o < 2:
        return Model(fixed=share)
    half_t, half_o = ([pieces_of(t) for t in _once(x[::2])] for x in (toxic, ordinary))
    frequent = trained([x for words in half_o for x in spelled_windows(words)], ORDINARY_BYTES)
    samples = [x for words in half_t for x in spelled_windows(words)]
    content, picked = trained(samples, FIRST_BYTES), []
    for _ in range(ROUNDS):
        found = _picked(_Distances(frequent, content), half_t, half_o)
        if not found:
            break
        picked, whole = found, sum(2 * len(w) + 2 for w in {w for words in found for w in words})
        content = _of_picked(picked, frequent, max(2 * TOXIC_BYTES, min(FIRST_BYTES, whole)))
    y = np.r_[np.ones(len(toxic[1::2])), np.zeros(len(ordinary[1::2]))]
    each = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    later = [pieces_of(t) for t in toxic[1::2] + ordinary[1::2]]
    best, model = np.inf, Model()
    whole = sum(2 * len(w) + 2 for w in {w for words in picked for w in words}) if picked else FIRST_BYTES
    for size in _sizes(whole):
        content = _of_picked(picked, frequent, size) if picked else trained(samples, size)
        known = _Distances(frequent, content)
        seen = []
        for words in later:
            far = [(d, words[i * WINDOW : (i + 1) * WINDOW]) for i, d in enumerate(known.windows(words)) if d >= 1]
            seen.append((np.array([d for d, own in far for _ in own], np.int64), np.array([known.word(w) for _, own in far for w in own], np.int64)))
        for threshold in range(1, 9):
            for least in range(1, 13):
                x = np.stack([_features(alone[near >= threshold], len(words), least) for (near, alone), words in zip(seen, later, strict=True)])
                w = _logistic(x, y, each)
                p = np.clip(_sigmoid(x @ w), 1e-9, 1 - 1e-9)
                loss = -(each * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
                if loss < best - 1e-9:
                    best, model = loss, Model(frequent, content, threshold, least, w)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled documents that aren't held out."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))

    def drawn(toxic: bool, most: int) -> DataFrame:
        return marks.where((F.col("toxic") > 0) == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    # MOST_TOXIC + MOST_ORDINARY ids.
    ids = drawn(True, MOST_TOXIC).union(drawn(False, MOST_ORDINARY))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").where(F.length("text") <= LONGEST_TEXT).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").collect()
    toxic, ordinary = [r["text"] for r in rows if r["toxic"] > 0], [r["text"] for r in rows if r["toxic"] <= 0]
    # A class of which all labels are drawn keeps its texts' count; one that was cut counts as often as its labels.
    n = marks.agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") <= 0).alias("o")).first()
    a, b = len(toxic) * max(1.0, n["t"] / MOST_TOXIC), len(ordinary) * max(1.0, n["o"] / MOST_ORDINARY)
    return fit(toxic, ordinary, a / (a + b) if a + b else None)


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1, of every text, under a name of the caller's; one that is taken is refused."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the column {name} is there already: give another name")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = m.opened()
        for part in slices(batches, 4 << 20):
            scores = [m.score(known, t) for t in part.column("text").to_pylist()]
            yield part.append_column(name, pa.array(scores, pa.float64()))

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
