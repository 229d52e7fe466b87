"""What several operators share: bounded Arrow batches, word hashes, and a place that driver and executors share."""

import gc

import numpy as np
from pyspark.sql import SparkSession

from ..storage import shared_folder, written  # noqa: F401

#: Words whose values a worker keeps. Words come with a long tail, and the first many thousand cover most of a text.
CACHED_WORDS = 300_000
#: Longer words are never kept.
CACHED_LENGTH = 48

K1, K2, K3, K4, K5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
S32, S33 = np.uint64(32), np.uint64(33)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

PUNCTUATION_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def bound_batches(spark: SparkSession, rows: int = 2000, mb: int = 8) -> None:
    """Arrow batches of at most so many rows and about so many bytes, so that long texts don't fill a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Cache(dict):
    """word -> of(word), for at most CACHED_WORDS words."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        value = self.of(word)
        if len(self) < CACHED_WORDS and len(word) <= CACHED_LENGTH:
            self[word] = value
        return value


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


class WordTable:
    """How bytes make words: which end a word, and a random value for each other byte (one for A-Z and a-z alike)."""

    def __init__(self, breaks: set[int]):
        self.breaks = np.array([c in breaks for c in range(256)])
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * K1)
        self.values[65:91] = self.values[97:123]
        self.values[self.breaks] = 0


#: Words cut at ASCII white space, and words of letters and digits: all other ASCII signs end one.
SPACED = WordTable({32, *range(9, 14)})
PLAIN = WordTable({c for c in range(128) if not chr(c).isalnum()})
#: Powers of an odd number for the places in a word; longer words use them again, times another odd number.
PLACES = np.cumprod(np.full(4096, K2 | np.uint64(1)))


def hashed_words(text: str, table: WordTable) -> np.ndarray:
    """64-bit hashes of a text's words, upper and lower case of A-Z alike, in order: polynomials in the values of their
    bytes, for all words at once."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    gap = table.breaks[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(ends) < len(starts):
        ends = np.concatenate([ends, [len(data)]])
    first = starts[0]
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    longest = int((ends - starts).max())
    weights = PLACES[np.minimum(place, longest) & 4095]
    if longest > 4096:
        weights = weights * ((place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    sums = np.add.reduceat(table.values[data[first:]] * weights, starts - first)
    return mix(sums + (ends - starts).astype(np.uint64) * K5)


#: What a worker keeps between tasks, by its kind; one kind at a time, so stages of a pipeline don't add up.
_kept: dict[str, tuple] = {}


def kept(kind: str, key, make):
    """make()'s value for all tasks of this kind that a worker runs with this key; what other kinds kept is let go."""
    if kind not in _kept or _kept[kind][0] != key:
        _kept.clear()
        gc.collect()
        _kept[kind] = key, make()
    return _kept[kind][1]


def plain_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words without ASCII punctuation."""
    return text.encode("utf-8", "surrogatepass").lower().translate(PUNCTUATION_TO_SPACE).split()
