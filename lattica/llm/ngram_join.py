"""Exact Jaccard self-join of documents on their word n-grams, by vertical partitioning.

The global order of n-grams is the order of their hashes. It is cut into fragments twice.

1. To find candidates. If two sets differ in at most d n-grams and the order is cut into more than d fragments, some
   fragment holds the same n-grams of both. Sizes are dealt to classes such that linked sets lie in one class or in
   neighbouring ones; a class fixes d, and so the number of fragments. Each set emits a signature for each of its fragments
   (a hash of all n-grams in it), once for its class and once for the class below. Empty fragments say nothing and are left
   out; slack fragments make up for them. A set that leaves out more than the slack, and sets of small classes, also (or
   only) emit their first d + 1 n-grams, of which linked sets share one. So no link is lost, and no statistics or
   thresholds depend on the data.
2. To drop chance candidates. Sets that share a passage may share a signature. The order is cut once more, evenly into
   about half as many parts as a set has n-grams, and the numbers of n-grams in the parts are kept. The sum of their
   differences is at most what two sets differ by, so a pair with a larger sum can't link. Blocks of up to SMALL sets with
   one signature give all their pairs. Larger ones are dealt by hash to chunks whose tables of counts have a bounded size;
   a task takes two chunks and joins their sets breadth first, each being compared only with those not joined yet, so a
   group of near copies costs about as many comparisons as it has members.
3. To count. Sets that candidates tie together form clusters. A cluster of more than CHUNK sets is dealt to bands of sizes,
   as wide as the ratio that links allow, and a band to chunks of about CHUNK by hash; pairs of chunks of one band or of
   neighbouring ones are tiles. Of the texts, about those that are compared are shuffled, and once: see among(). For each
   tile and fragment a task counts the partial overlaps of all pairs as one matrix product; the matrices of a tile's
   fragments are then summed, pair by pair, and every sum is compared with the threshold exactly. What leaves a
   tile is a row for each set (its number of links and the root of its links in the tile), not a row for each pair.

Hot keys are split. A signature that occurs HOT times or more among the sets that a task has at hand is dealt by document,
and one row of it goes the common way to show others that it is shared. Joins on a key that very many rows have (copies of
one set, a cluster, a node of the link graph) are told apart by counts: see hot_join().

Equal sets are one class with one representative throughout; copies never meet as pairs. Links between classes are joined
to components. Every intermediate table is written to the shared folder.
"""

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, hot_join
from .text import K1, K2, K3, K4, S32, SPACED, bound_batches, hashed_words, mix, written

#: Sets of a block that are compared pair by pair; larger blocks are searched breadth first.
SMALL = 6
#: Cells of the table of counts of a searched chunk, two of which a task compares.
CELLS = 1 << 21
#: Times a signature occurs among the sets at hand from which on it is dealt by document, and to how many places.
HOT, DEALT = 64, 256
#: Sets of a tile's side, bands of sizes to the ratio of linked sets, and n-grams of a fragment that is counted at once.
CHUNK, BANDS, FRAGMENT = 256, 1, 256
#: Bits of the map of the documents whose texts are read once more; the words that hold them are broadcast.
BITS = 1 << 25
#: Distinct sets a task remembers so that copies in its partition emit nothing twice.
SEEN = 200_000

#: Random odd factors: the sums of two n-grams' word hashes, which are random themselves, are equal by chance alone.
ODD = mix(np.arange(1, 33, dtype=np.uint64) * K3) | np.uint64(1)


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words (lower-cased A-Z, cut at ASCII white space); with fewer
    words, of the whole sequence."""
    h = hashed_words(text or "", SPACED)
    if not len(h):
        return h
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, np.uint64(k * int(K4) % 2**64))
    for i in range(k):
        total += h[i : i + len(total)] * ODD[i % 32]
    return np.unique(mix(total))


class Classes:
    """Size classes for the threshold num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("0 < num < den is asked for")
        self.num, self.den, self.starts = num, den, [1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, (self.starts[-1] - 1) * self.den // self.num + 1))
        return int(np.searchsorted(self.starts, size, "right")) - 1

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def cut(self, cls: int) -> tuple[int, int, int]:
        """d, the number of fragments (0: none are cut) and how many a set may leave out."""
        self.of(self.starts[-1])
        most = self.starts[cls + 1] - 1
        d = (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        if d < 4:
            return d, 0, 0
        for slack in (s for r in (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 1) for s in (math.ceil(r * (d + 1)) + 1,)):
            m = d + 1 + slack
            mean = self.starts[cls] / m
            p = math.exp(-mean)
            if m * p + 3.5 * math.sqrt(m * p) <= slack:
                break
        return d, m, slack

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """Of a set, given as sorted hashes."""
        own, found = self.of(len(x)), []
        for cls in (own, own - 1) if own else (own,):
            d, m, slack = self.cut(cls)
            if not d:
                continue  # only equal sets are near enough
            salt = np.uint64((2 * cls + 1) * int(K1) % 2**64)
            left_out = slack + 1
            if m:
                part = ((x >> S32) * np.uint64(m)) >> S32
                begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                left_out = m - len(begin)
                found.append(mix(np.add.reduceat(mix(x + K2), begin) + salt + mix(part[begin] + K3)))
            if left_out > slack:
                found.append(mix(x[: d + 1] + salt + K4))
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _keys(x: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(x.tobytes())
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


def counts_by_part(x: np.ndarray) -> np.ndarray:
    """How many n-grams lie in each of 2^k even parts of the order, 2^k being from a quarter to half of the set's size; at
    most 255 are told, which only lessens differences."""
    k = max(0, len(x).bit_length() - 2)
    return np.minimum(np.bincount((x >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(x), np.int64), minlength=1 << k), 255).astype(np.uint8)


def folded(parts: np.ndarray, size: int) -> np.ndarray:
    """Counts in fewer, larger parts; a sum that was cut off at 255 stays a lower bound only if it is not used, so sets
    whose parts are that full are never folded."""
    return parts.astype(np.int32).reshape(size, -1).sum(1)


def may_link(a: bytes, n_a: int, b: bytes, n_b: int, num: int, den: int) -> bool:
    """Whether the counts by part allow den * intersection >= num * union."""
    if min(n_a, n_b) * den < max(n_a, n_b) * num:
        return False
    p, q = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if max(p.max(), q.max()) == 255:
        return True
    size = min(len(p), len(q))
    apart = int(np.abs(folded(p, size) - folded(q, size)).sum())
    return apart * (den + num) <= (n_a + n_b) * (den - num)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, the two halves of a hash of the set, and the counts by part."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [ngrams(t, n) for t in b.column(1).to_pylist()]
            keys = [_keys(x) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([k[h] for k in keys], pa.int64()) for h in (0, 1)), pa.array([counts_by_part(x).tobytes() for x in sets], pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "parts"])

    return docs.mapInArrow(of, "doc_id long, n_shingles long, k1 long, k2 long, parts binary")


SIGNATURES = "sig long, place int, doc_id long, shared boolean"


def placed(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Rows of SIGNATURES. place is 0 but for signatures that occur HOT times or more here: these are dealt by document,
    and their first row goes to place 0 too. shared: others have this signature for certain."""
    _, first, where, times = np.unique(sig, return_index=True, return_inverse=True, return_counts=True)
    hot = times[where] >= HOT
    place = np.where(hot, 1 + (mix(doc.view(np.uint64)) % np.uint64(DEALT)).astype(np.int32), 0).astype(np.int32)
    shown = first[times >= HOT]
    sig, doc = np.concatenate([sig, sig[shown]]), np.concatenate([doc, doc[shown]])
    place, hot = np.concatenate([place, np.zeros(len(shown), np.int32)]), np.concatenate([hot, np.ones(len(shown), bool)])
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(place), pa.array(doc), pa.array(hot)], names=["sig", "place", "doc_id", "shared"])


def _signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of the copies of a set in a partition only the first emits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(num, den), set()
        sigs, ids, total = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = ngrams(text, n)
                if doc is None or not len(x) or (key := _keys(x)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                sigs.append(classes.signatures(x)), ids.append(np.full(len(sigs[-1]), doc, np.int64))
                total += len(sigs[-1])
                if total > 500_000:
                    yield placed(np.concatenate(sigs), np.concatenate(ids))
                    sigs, ids, total = [], [], 0
        if total:
            yield placed(np.concatenate(sigs), np.concatenate(ids))

    return docs.mapInArrow(of, SIGNATURES)


BLOCKS = "kind int, a long, b long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (sig, place, doc_id, shared), sorted, of signatures that several sets have. kind 0: a pair (a, b) of a
    small block; kind 1: set b of the block a."""

    def out(sig: np.ndarray, place: np.ndarray, doc: np.ndarray, shared: np.ndarray) -> pa.RecordBatch | None:
        begin = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (place[1:] != place[:-1])])
        known = np.repeat(np.logical_or.reduceat(shared, begin), np.diff(np.r_[begin, len(sig)]))
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]
        sig, place, doc, known = sig[fresh], place[fresh], doc[fresh], known[fresh]
        begin = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (place[1:] != place[:-1])])
        size = np.diff(np.r_[begin, len(sig)])
        parts = []
        for m in range(2, SMALL + 1):
            at = begin[(size == m) & ~known[begin]]
            parts += [(np.zeros(len(at), np.int32), doc[at + i], doc[at + j]) for i in range(m) for j in range(i + 1, m)]
        large = (np.repeat(size, size) > SMALL) | known
        parts.append((np.ones(int(large.sum()), np.int32), sig[large], doc[large]))
        kind, a, b = (np.concatenate(x) for x in zip(*parts))
        if not len(kind):
            return None
        rows = np.unique(np.stack([kind.astype(np.int64), a, b]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), pa.array(rows[1]), pa.array(rows[2])], names=["kind", "a", "b"])

    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)]
    for batch in batches:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
        sig, place, doc, _ = held
        if len(sig) < 50_000:
            continue  # gather more rows first
        last = np.flatnonzero((sig != sig[-1]) | (place != place[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if len(sig) - cut > 25_000:  # of a large block, all but a tail that shows that it is large
            cut, start = len(sig) - 8 * SMALL, cut
            if min(len(np.unique(doc[start:cut])), len(np.unique(doc[cut:]))) <= SMALL:
                continue
        if b := out(*(h[:cut] for h in held)):
            yield b
        held = [h[cut:] for h in held]
    if len(held[0]) and (b := out(*held)):
        yield b


TIES = "u long, v long"


def _may_link_pairs(num: int, den: int):
    """Keeps the pairs (rows a, b, parts and sizes of both) that may link."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, pu, nu, pv, nv = (c.to_pylist() for c in b.columns)
            keep = pa.array([may_link(*x, num, den) for x in zip(pu, nu, pv, nv)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    return of


def _search_blocks(num: int, den: int):
    """Ties of each two chunks of a block (rows: block, i, j, doc_id, n, parts, sorted by block, i, j and n): a forest that
    joins all their sets that may link, directly or through others."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in _groups(batches, 3):
            rows = list({r[0]: r for r in rows}.values())  # repeated rows
            out += forest([r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows], num, den)
            if len(out) > 20_000:
                yield _batch(out, ["u", "v"], TIES)
                out = []
        if out:
            yield _batch(out, ["u", "v"], TIES)

    return of


def forest(docs: list[int], sizes: np.ndarray, parts: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Breadth first over sets in the order of their sizes; counts are compared in as many parts as the smallest has."""
    size = min(map(len, parts))
    full = np.array([max(p) == 255 for p in parts])
    table = np.stack([folded(np.frombuffer(p, np.uint8), size) for p in parts])
    left, found = np.ones(len(docs), bool), []
    for start in range(len(docs)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            k = todo.pop()
            others = np.flatnonzero(left)
            others = others[(sizes[others] * num <= sizes[k] * den) & (sizes[k] * num <= sizes[others] * den)]
            if not len(others):
                continue
            apart = np.abs(table[others] - table[k]).sum(1)
            near = others[(apart * (den + num) <= (sizes[others] + sizes[k]) * (den - num)) | full[others] | full[k]]
            left[near] = False
            todo += near.tolist()
            found += [(docs[k], docs[j]) for j in near]
    return found


def partial_overlaps(rows: list[np.ndarray], cols: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each of rows with each of cols (of rows, if None), as one product of bit matrices
    over the n-grams that occur more than once."""
    every = rows + (cols or [])
    values, where, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    shared = times[where] > 1
    number = np.cumsum(times > 1) - 1
    owner, column = owner[shared], number[where[shared]]
    counts = np.zeros((len(rows), len(cols) if cols else len(rows)), np.float64)
    width = max(1, (1 << 22) // len(every))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        bits = np.zeros((len(every), width), np.float32)
        bits[owner[a:b], column[a:b] - low] = 1
        left = bits[: len(rows)]
        counts += left @ (bits[len(rows) :] if cols else left).T
    return counts.astype(np.int32)


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal first `by` columns of sorted rows."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:by] != key:
                if held:
                    yield key, held
                key, held = row[:by], []
            held.append(row[by:])
    if held:
        yield key, held


SEGMENT = "cluster long, chunk long, tiles array<struct<i:long,j:long>>, fragment int, n long, doc_id long, k1 long, copies long, grams binary"
SEGMENT_NAMES = ["cluster", "chunk", "tiles", "fragment", "n", "doc_id", "k1", "copies", "grams"]
PARTIAL = "cluster long, i long, j long, fragment int, docs array<long>, sizes array<long>, copies array<long>, rows int, lengths binary, apart binary"


def _segments(members: DataFrame, n: int) -> DataFrame:
    """A row for each fragment of each member (columns doc_id, text, k1, k2, cluster, chunk, copies, fragments, tiles)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []

            def rows() -> pa.RecordBatch:
                cluster, chunk, row, *rest = zip(*out)
                kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary()]
                columns = [pa.array(cluster, pa.int64()), pa.array(chunk, pa.int64()), tiles.take(pa.array(row, pa.int32()))]
                return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, k) for x, k in zip(rest, kinds))], names=SEGMENT_NAMES)

            tiles = b.column(8)
            for at_row, (doc, text, k1, k2, cluster, chunk, copies, fragments) in enumerate(zip(*(c.to_pylist() for c in b.columns[:8]))):
                x = ngrams(text, n)
                if _keys(x) != (k1, k2):
                    continue  # another text of the same id
                at = np.searchsorted(((x >> S32) * np.uint64(fragments)) >> S32, np.arange(fragments + 1))
                out += [(cluster, chunk, at_row, f, len(x), doc, k1, copies, x[at[f] : at[f + 1]].tobytes()) for f in range(fragments)]
                if len(out) > 2000:
                    yield rows()
                    out = []
            if out:
                yield rows()

    return members.select("doc_id", "text", "k1", "k2", "cluster", "chunk", "copies", "fragments", "tiles").mapInArrow(of, SEGMENT)


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [ARROW[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial overlaps of a tile in a fragment; rows come sorted by tile, fragment, chunk, n, doc_id and k1. They are
    told as what they lack of the most they could be, in the narrowest integers: near copies lack little, so the matrices
    are small when they are shuffled."""
    names = [x.split()[0] for x in PARTIAL.split(", ")]
    out, size = [], 0
    for (cluster, i, j, fragment), rows in _groups(batches, 4):
        rows = list({(r[0], r[2], r[3]): r for r in rows}.values())  # repeated rows
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        first = sum(r[0] == i for r in rows)
        if i != j and first in (0, len(rows)):
            continue  # one of the chunks is empty
        counts = partial_overlaps(sets[:first], sets[first:] if i != j else None)
        lengths = np.array([len(x) for x in sets], np.int32)
        lack = most_shared(lengths, first) - counts
        lack = lack.astype(next(k for k in WIDTHS if lack.max() <= np.iinfo(k).max))
        out.append((cluster, i, j, fragment, [r[2] for r in rows], [r[1] for r in rows], [r[4] for r in rows], first, lengths.tobytes(), lack.tobytes()))
        size += lack.nbytes + 28 * len(rows)
        if size > 4 << 20:
            yield _batch(out, names, PARTIAL)
            out, size = [], 0
    if out:
        yield _batch(out, names, PARTIAL)


WIDTHS = (np.uint8, np.uint16, np.int32)
LINKED = "doc_id long, root long, links long"


def most_shared(lengths: np.ndarray, rows: int) -> np.ndarray:
    """The largest overlaps that sets of these lengths allow: of the first `rows` with the others, or with each other if
    there are no others."""
    rest = lengths[rows:] if rows < len(lengths) else lengths
    return np.minimum(lengths[:rows, None], rest[None, :])


def tile_links(docs: np.ndarray, sizes: np.ndarray, copies: np.ndarray, rows: int, counts: np.ndarray, num: int, den: int) -> list[tuple]:
    """(document, smallest document reachable in the tile, documents linked with it), of those that have links."""
    square = rows == len(docs)
    a, b = (sizes, sizes) if square else (sizes[:rows], sizes[rows:])
    linked = (num + den) * counts.astype(np.int64) >= num * (a[:, None] + b[None, :])
    if square:
        np.fill_diagonal(linked, False)
        links, whole = linked @ copies, linked
    else:
        links = np.concatenate([linked @ copies[rows:], copies[:rows] @ linked])
        whole = np.zeros((len(docs), len(docs)), bool)
        whole[:rows, rows:], whole[rows:, :rows] = linked, linked.T
    root = docs.copy()
    while True:
        near = np.where(whole, root[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(root, near)
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(whole.any(1))
    return list(zip(docs[some].tolist(), root[some].tolist(), links[some].tolist()))


def _sum(num: int, den: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in _groups(batches, 3):
            _, docs, sizes, copies, first, _, _ = rows[0]
            total = 0
            for *_, lengths, apart in rows:
                most = most_shared(np.frombuffer(lengths, np.int32), first)
                kind = next(k for k in WIDTHS if np.dtype(k).itemsize * most.size == len(apart))
                total = total + most - np.frombuffer(apart, kind).reshape(most.shape)
            out += tile_links(np.array(docs), np.array(sizes), np.array(copies), first, total, num, den)
            if len(out) > 20_000:
                yield _batch(out, ["doc_id", "root", "links"], LINKED)
                out = []
        if out:
            yield _batch(out, ["doc_id", "root", "links"], LINKED)

    return of


def among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose doc_id is not in wanted, so that they need not be shuffled: a map of BITS bits, one
    for each value of a hash, is broadcast as at most BITS / 64 words. Rows of a value that some wanted id has stay, so an
    exact join has to follow."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    word, bit = F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {BITS}L) % 64 AS INT))").alias("_bit")
    words = wanted.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    left = rows.select("*", word, bit).alias("l")
    return left.join(F.broadcast(words.alias("w")), F.expr("l._word = w._word AND (l._bit & w._bits) <> 0"), "left_semi").select(*rows.columns)


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_shingles (size of its set), component_id (smallest id reachable by links, itself
    included) and n_links (rows linked with it, copies of its set included). Two rows link when
    den * intersection >= num * union of their sets of word n-grams.

    Defined results: a null or empty text, or one of white space, has an empty set and no links; repeated rows are copies;
    of an id with several texts each row has the component of its own text; a row with a null id takes no part and its
    component is null; other columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(_sets(texts, n))
    rows = sets.count()
    key = ["k1", "k2"]
    usable = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n")))

    # candidates: only signatures that several sets have go on
    by_sig = Window.partitionBy("sig", "place").orderBy("doc_id")
    signatures = _signatures(texts, n, num, den).withColumn("_a", F.lag("doc_id").over(by_sig)).withColumn("_z", F.lead("doc_id").over(by_sig))
    shared = signatures.where("shared OR _a IS NOT NULL OR _z IS NOT NULL").select("sig", "place", "doc_id", "shared")
    blocks = written(shared.mapInArrow(_blocks, BLOCKS))
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in key]
    about = usable.groupBy("doc_id").agg(*ends, F.first("n_shingles").alias("n"), F.first("parts").alias("parts"))
    # an id with several texts has no one set, so its pairs are candidates as they are
    alike = "min_k1 = max_k1 AND min_k2 = max_k2"
    one, many = about.where(alike), about.where(f"NOT ({alike})").select("doc_id")
    left, right = (one.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("parts").alias(f"parts_{x}")) for x in "ab")
    pairs = blocks.where("kind = 0").select("a", "b").distinct()
    near = pairs.join(left, "a").join(right, "b").select("a", "b", "parts_a", "n_a", "parts_b", "n_b").mapInArrow(_may_link_pairs(num, den), TIES)
    large = blocks.where("kind = 1").select(F.col("a").alias("block"), F.col("b").alias("doc_id"))
    # chunks of a block: as many as its table of counts takes, whose width follows from the largest set's size
    in_blocks = written(large.join(one.select("doc_id", "n"), "doc_id"))
    sized = in_blocks.groupBy("block").agg(F.count("*").alias("sets"), F.max("n").alias("most"))
    sized = sized.select("block", "sets", F.ceil(F.col("sets") * F.col("most") / (2 * CELLS)).cast("int").alias("chunks")).where("chunks > 1")
    chunked = hot_join(in_blocks, sized, ["block"], "sets", in_blocks.count(), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunked = chunked.withColumn("c", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    tiled = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.least("c", "other")).withColumn("j", F.greatest("c", "other"))
    tiled = tiled.join(one.select("doc_id", "parts"), "doc_id")
    searched = tiled.select("block", "i", "j", "doc_id", "n", "parts").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "n", "doc_id").mapInArrow(_search_blocks(num, den), TIES)
    odd = pairs.join(many, pairs.a == many.doc_id, "left_semi").union(pairs.join(many, pairs.b == many.doc_id, "left_semi"))
    odd_blocks = large.join(many, "doc_id").groupBy("block").agg(F.min("doc_id").alias("v"))
    odd_large = large.join(odd_blocks, "block").select(F.col("doc_id").alias("u"), "v")
    several_of = classes.where("copies > 1").select(*key, "rep", "copies")
    copies = hot_join(usable.select("doc_id", *key), several_of, key, "copies", rows).where("doc_id <> rep").select("doc_id", "rep").distinct()
    clusters = components(near.union(searched).union(odd).union(odd_large).union(copies).toDF("u", "v"))
    of_rep = classes.join(clusters, classes.rep == clusters.node).select("k1", "k2", "rep", "copies", "n", F.col("component").alias("cluster"))
    of_rep = written(of_rep)
    several = of_rep.groupBy("cluster").agg(F.count("*").alias("sets"), F.max("n").alias("most")).where("sets > 1")
    members = hot_join(of_rep, several, ["cluster"], "sets", rows).withColumn("fragments", F.ceil(F.col("most") / FRAGMENT).cast("int"))
    ratio = math.log(den / num) / BANDS * (1 + 1e-9)  # so that rounding sets no linked sets more than BANDS bands apart
    band = F.when(F.col("sets") > CHUNK, F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio))).otherwise(F.lit(0)).cast("int")
    members = members.withColumn("band", band)
    in_band = members.groupBy("cluster", "band").agg(F.count("*").alias("in_band"), (F.max("sets") > CHUNK).alias("cut"))
    in_band = written(in_band.withColumn("chunks", F.ceil(F.col("in_band") / CHUNK).cast("int")))
    members = written(hot_join(members, in_band.drop("cut"), ["cluster", "band"], "in_band", rows).withColumn("chunk", chunk_number(F.col("band"), F.pmod(F.xxhash64(*key), F.col("chunks")))))

    # tiles: pairs of chunks whose sizes allow a link; more than BANDS bands apart they are beyond the ratio
    chunks = in_band.where("cut").select("cluster", "band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("h"))
    chunks = chunks.select("cluster", "band", chunk_number(F.col("band"), F.col("h")).alias("chunk"))
    left = chunks.select("cluster", F.col("chunk").alias("i"), F.explode(F.sequence(F.col("band"), F.col("band") + BANDS)).alias("band"))
    tiles = left.join(chunks.withColumnRenamed("chunk", "j"), ["cluster", "band"]).where("i <= j").select("cluster", "i", "j")
    of_chunk = tiles.select("cluster", F.col("i").alias("chunk"), "i", "j").union(tiles.where("i <> j").select("cluster", F.col("j").alias("chunk"), "i", "j"))

    # the text of a representative; with several rows of its id, the one whose set it is
    place = ["cluster", "i", "j"]
    tiles_of = of_chunk.groupBy("cluster", "chunk").agg(F.collect_list(F.struct("i", "j")).alias("tiles"))
    own = F.array(F.struct(F.col("chunk").alias("i"), F.col("chunk").alias("j")))
    wanted = members.join(tiles_of, ["cluster", "chunk"], "left").select("k1", "k2", "cluster", "chunk", "copies", "fragments", F.coalesce("tiles", own).alias("tiles"), F.col("rep").alias("doc_id"))
    found = among(texts, members.select(F.col("rep").alias("doc_id"))).join(wanted.hint("merge"), "doc_id")
    of_tile = _segments(found, n).select("*", F.explode("tiles").alias("tile")).select("cluster", "tile.i", "tile.j", "fragment", "chunk", "n", "doc_id", "k1", "copies", "grams")
    partial = of_tile.repartition(*place, "fragment").sortWithinPartitions(*place, "fragment", "chunk", "n", "doc_id", "k1").mapInArrow(_count, PARTIAL)
    linked = written(partial.repartition(*place).sortWithinPartitions(*place, "fragment").mapInArrow(_sum(num, den), LINKED))

    reached = components(linked.select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
    done = classes.join(reached, classes.rep == reached.node, "left").join(links, "rep", "left")
    done = done.select("k1", "k2", "copies", F.coalesce("component", "rep").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("l"))
    known = hot_join(sets.select("doc_id", "n_shingles", *key), done, key, "copies", rows, "left")
    takes_part = F.col("doc_id").isNotNull()
    links_of = F.when(takes_part, F.coalesce("l", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return known.select("doc_id", "n_shingles", F.when(takes_part, F.coalesce("c", "doc_id")).alias("component_id"), links_of.alias("n_links"))


def chunk_number(band: Column, h: Column) -> Column:
    """A number for a chunk of a cluster; chunks of lower bands have lower numbers."""
    return F.shiftleft(band.cast("long"), 40) + h.cast("long")
