"""Benchmark decontamination by spaced seeds.

A seed is a mask over a window of words; positions where it is 0 are ignored. Windows of the test items are hashed under
each mask, windows of the documents likewise, and equal hashes are hits: they survive a substituted word wherever some
mask ignores it. Each hit fixes how an item would lie in the document; there the words are compared one by one, and a
document is contaminated by an item if enough of the words agree.

Test items are few beside the corpus. Their hashes go to every task in blocks of at most block_words words, one pass over
the documents for each block, so what is shipped has a fixed bound however large the benchmark is. A pass has no shuffle.

Defined results: a null or empty text holds nothing and matches nothing; items of fewer words than the shortest mask are
compared whole; repeated documents give repeated rows, repeated items too; null ids are kept; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .text import K1, K2, PLAIN, bound_batches, hashed_words, mix

#: 1: the word counts, 0: it is ignored. A hit needs four to seven words that agree in one of these patterns.
MASKS = ("111111", "11011011", "1110010111", "110101", "11001001")
#: A document holds an item if so much of the item's words agree where it lies, or so many words in a row of RUN.
COVERED, RUN, RUN_COVERED = 0.6, 20, 0.8

#: Hits, and words of items, that are looked at together.
AT_ONCE = 1 << 20

#: Random odd factors for the places of a window.
ODD = mix(np.arange(1, 65, dtype=np.uint64) * K1) | np.uint64(1)


def masked(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hashes of the windows of h under a mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64((number + 1) * int(K2) % 2**64))
    for k, on in enumerate(mask):
        if on == "1":
            total += h[k : k + n] * ODD[k]
    return mix(total)


class Items:
    """Test items ready for the search: all seeds, sorted, with a bit table before them."""

    def __init__(self, ids: list, hashes: list[np.ndarray], masks: tuple[str, ...] = MASKS):
        self.ids, self.masks = ids, masks
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        seeds, item, place = [], [], []
        for k, h in enumerate(hashes):
            for n, mask in enumerate(masks):
                s = masked(h, mask, n)
                seeds.append(s), item.append(np.full(len(s), k)), place.append(np.arange(len(s)))
        shortest = min(map(len, masks))
        self.whole = {}
        for k, h in enumerate(hashes):
            if 0 < len(h) < shortest:
                self.whole.setdefault(len(h), {}).setdefault(h.tobytes(), []).append(k)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        s = join(seeds, np.uint64)
        order = np.argsort(s, kind="stable")
        self.seeds, self.item, self.place = s[order], join(item, int)[order], join(place, int)[order]
        self.bits = max(16, int(len(s)).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.seeds >> np.uint64(64 - self.bits)] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, shifts), distinct within each pair of arrays: word k of the item would be word k + shift of the
        document. A window that many items share gives many; arrays hold AT_ONCE at most."""
        for n, mask in enumerate(self.masks):
            s = masked(h, mask, n)
            at = np.flatnonzero(self.table[s >> np.uint64(64 - self.bits)])
            low, high = np.searchsorted(self.seeds, s[at]), np.searchsorted(self.seeds, s[at], "right")
            at, low, times = at[low < high], low[low < high], (high - low)[low < high]
            upto = np.cumsum(times)
            cut = 0
            while cut < len(at):
                done = int(upto[cut - 1]) if cut else 0
                end = max(cut + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
                some = times[cut:end]
                where = np.arange(some.sum()) + np.repeat(low[cut:end] - (np.cumsum(some) - some), some)
                yield distinct(self.item[where], np.repeat(at[cut:end], some) - self.place[where])
                cut = end
        raw = h.tobytes()
        for length, of in self.whole.items():
            found = [(k, p) for p in range(len(h) - length + 1) for k in of.get(raw[8 * p : 8 * (p + length)], ())]
            if found:
                yield distinct(*np.array(found).T)

    def overlaps(self, h: np.ndarray) -> dict[int, tuple[int, int, float]]:
        """item -> (words that agree, where it begins, their share of the item) of its best place, if it is held; of
        several best ones the first."""
        best: dict[int, tuple[int, int, float]] = {}
        for items, shifts in self.hits(h):
            upto = np.cumsum(self.sizes[items])
            cut = 0
            while cut < len(items):
                end = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + AT_ONCE, "right")))
                for k, same, shift in zip(*self.held(h, items[cut:end], shifts[cut:end])):
                    if k not in best or (same, -shift) > (best[k][0], -best[k][1]):
                        best[k] = (same, shift, same / int(self.sizes[k]))
                cut = end
        return best

    def held(self, h: np.ndarray, items: np.ndarray, shifts: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Those of the items at their shifts that the document holds, with the number of words that agree: all words of
        all of them are compared at once."""
        sizes = self.sizes[items]
        begin = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        there = place + np.repeat(shifts, sizes)
        equal = (there >= 0) & (there < len(h))
        equal &= h[np.clip(there, 0, len(h) - 1)] == self.words[place + np.repeat(self.begins[items], sizes)]
        same = np.add.reduceat(equal, begin)
        held = same >= COVERED * sizes
        # RUN words in a row, inside both texts
        counted = np.concatenate([[0], np.cumsum(equal)])
        ends = np.minimum(np.arange(len(place)) + RUN, len(place))
        long_run = (place + RUN <= np.repeat(sizes, sizes)) & (counted[ends] - counted[:-1] >= RUN_COVERED * RUN)
        shared = np.minimum(sizes, len(h) - shifts) - np.maximum(0, -shifts)
        held |= (shared >= RUN) & (np.add.reduceat(long_run, begin) > 0)
        return items[held].tolist(), same[held].tolist(), shifts[held].tolist()


def distinct(items: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((shifts, items))
    items, shifts = items[order], shifts[order]
    fresh = np.r_[True, (items[1:] != items[:-1]) | (shifts[1:] != shifts[:-1])]
    return items[fresh], shifts[fresh]


HITS = "test_items"


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", masks: tuple[str, ...] = MASKS, block_words: int = 2_000_000) -> DataFrame:
    """The rows of docs with one more column, test_items: an array of the items that the row's text holds, each with
    words_agreeing long, start_word long (the item's first word in the text; may be negative) and share double. A
    column of that name is replaced."""
    spark, docs = docs.sparkSession, docs.drop(HITS)
    bound_batches(spark)
    hit = StructType([StructField(item_id, benchmark.schema[item_id].dataType), StructField("words_agreeing", LongType()), StructField("start_word", LongType()), StructField("share", DoubleType())])
    schema = StructType([*docs.schema.fields, StructField(HITS, ArrayType(hit))])
    kind, at, names = to_arrow_schema(schema).field(HITS).type, docs.columns.index("text"), [*docs.columns, HITS]

    def search(df: DataFrame, block: Items) -> DataFrame:
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shipped.value
            for b in batches:
                before = b.column(len(names) - 1).to_pylist() if b.num_columns == len(names) else [[]] * b.num_rows
                rows = []
                for text, old in zip(b.column(at).to_pylist(), before):
                    found = items.overlaps(hashed_words(text, PLAIN)) if text else {}
                    rows.append([*old, *({item_id: items.ids[k], "words_agreeing": n, "start_word": start, "share": share} for k, (n, start, share) in sorted(found.items()))])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names) - 1], pa.array(rows, kind)], names=names)

        return df.mapInArrow(run, schema)

    found, ids, hashes, words, passes = docs, [], [], 0, 0
    for row in benchmark.select(F.col(item_id), F.col("text")).where(F.col("text").isNotNull()).toLocalIterator():
        h = hashed_words(row[1], PLAIN)
        ids.append(row[0]), hashes.append(h)
        words += len(h)
        if words >= block_words:
            found, passes = search(found, Items(ids, hashes, masks)), passes + 1
            ids, hashes, words = [], [], 0
    return search(found, Items(ids, hashes, masks)) if ids or not passes else found


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and test item it holds: doc_id, item_id, words_agreeing, start_word, share."""
    found = mark_contaminated(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select("doc_id", F.explode(HITS).alias("_h")).select("doc_id", "_h.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no test item."""
    return mark_contaminated(docs, benchmark).where(F.size(HITS) == 0).drop(HITS)
