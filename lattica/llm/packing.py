"""Hierarchical multi-length packing.

Documents become token ids, and pieces of them go to tiers of context sizes: whole windows of the longest size are cut
off first, what remains goes to the shortest tier that holds it. Each tier is packed from the longest down: a piece opens
a window, its gap takes the longest pieces of shorter tiers that fit, and what is left of the gap is closed by cutting one
piece, so a window is exactly as long as its tier. Sequences of powers of two are dealt to step groups of equal tokens,
the longest first.

One pass over the scan, without a shuffle: each partition packs its own documents and holds a batch of them and the
pieces that found no window yet. At its end these are laid end to end and cut into powers of two, so no sequence needs
padding at all. Sequence and group ids carry the partition's number, so they are unique, and a task that runs again gives
the same rows.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own; a null id is kept;
other columns are ignored; an empty table gives no rows.
"""

import bisect
import os
import re
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .text import CACHED_LENGTH, CACHED_WORDS, bound_batches, kept

TIERS = (512, 1024, 2048, 4096)
#: Sequences of the longest size that a step group holds.
STEP = 16


#: Of lower-case ASCII: runs of letters, single digits, runs of other signs.
PARTS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
#: Byte-level vocabularies write bytes that have no visible sign of their own as the signs from U+0100 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)).difference(VISIBLE)))}


class WordTokens:
    """Token ids of texts. White space always ends a token of the vocabularies this is used with, so the parts between
    spaces are encoded alone, and those that recur are encoded once."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.known = {"": b""}
        sample = ["Ab", "ab", "ab.", "."]
        a, b, c, d = (e.ids for e in self.tokenizer.encode_batch(sample, add_special_tokens=False))
        self.lowers = a == b
        assert c == b + d, "this vocabulary joins words and punctuation"
        self.code, self.most = "H" if self.kind.itemsize == 2 else "I", 2 * CACHED_WORDS
        self.model = self.tokenizer.model
        sample = ["ab", "straße", "ciónñga", "être", "ж", "thatwhwhthonion"]
        self.direct = [self._letters(w) for w in sample] == [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch(sample, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known = self.known
        texts = [t.lower() if self.lowers and t.isascii() and "<|" not in t else t for t in (t or "" for t in texts)]
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        found = [list(map(known.get, p)) for p in parts]
        gaps = [[i for i, v in enumerate(f) if v is None] if None in f else [] for f in found]
        new = self._new({p[i] for p, g in zip(parts, gaps) for i in g})
        for p, f, g in zip(parts, found, gaps):
            for i in g:
                f[i] = new[p[i]]
            f.append(self.end)
        if len(known) < self.most:
            known.update((w, v) for w, v in new.items() if len(w) <= CACHED_LENGTH)
        return [np.frombuffer(b"".join(f), self.kind) for f in found]

    def _letters(self, word: str) -> bytes:
        """The ids of a lower-case word of letters, which normalizer and pre-tokenizer would leave as it is."""
        return array(self.code, [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS))]).tobytes()

    def _new(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that are not known. Between letters, digits and other signs there is always a token's edge, so
        such parts are encoded, and known, alone."""
        known, letters, done, parts = self.known, self._letters, {}, {}
        for w in words:
            if self.direct and w.isalpha() and w.islower() and (w.isascii() or is_normalized("NFC", w)):
                done[w] = letters(w)
            elif self.lowers and w.isascii() and "'" not in w and "<|" not in w:
                parts[w] = PARTS.findall(w.lower())
            elif w[-1] in ".," and w[:-1].lower().isalpha():
                parts[w] = [w[:-1], w[-1]]
            else:
                parts[w] = [w]
        rest = []
        for x in {x for p in parts.values() for x in p}:
            if x in known:
                done[x] = known[x]
            elif x not in done:
                if self.direct and x.isalpha() and x.islower() and (x.isascii() or is_normalized("NFC", x)):
                    done[x] = letters(x)
                else:
                    rest.append(x)
        for at in range(0, len(rest), 4096):
            for x, e in zip(rest[at : at + 4096], self.tokenizer.encode_batch_fast(rest[at : at + 4096], add_special_tokens=False)):
                done[x] = array(self.code, e.ids).tobytes()
        for w, p in parts.items():
            if len(p) > 1 or w != p[0]:
                done[w] = b"".join(map(done.__getitem__, p))
        return done


def word_tokens(path: str, end_id: int) -> WordTokens:
    """One for all tasks that a worker runs, with what it knows."""
    return kept("tokens", (path, end_id), lambda: WordTokens(path, end_id))


class Packer:
    """Packs what add() is given into sequences; rows: the pieces of finished sequences."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step: int = STEP, first_id: int = 0):
        self.tiers, self.capacity, self.first = tiers, step * tiers[-1], first_id
        self.loose: list[tuple[int, int, int]] = []  # (length, document, start), sorted
        self.docs: dict[int, tuple] = {}  # number -> (id, token ids) of documents with loose pieces
        self.seen = self.sequences = self.groups = 0
        self.open: list[list[int]] = []  # [room, group]
        self.rows: list[tuple] = []

    def add(self, batch: list[tuple]) -> None:
        longest, full = self.tiers[-1], []
        for doc in batch:
            number, self.seen = self.seen, self.seen + 1
            self.docs[number] = doc
            cut = len(doc[1]) - len(doc[1]) % longest
            full += [[(longest, number, at)] for at in range(0, cut, longest)]
            if len(doc[1]) > cut:
                self.loose.append((len(doc[1]) - cut, number, cut))
        self.loose.sort()
        for tier in reversed(self.tiers):
            full += self._windows(tier)
        self._emit(full)

    def _windows(self, tier: int) -> list[list[tuple]]:
        """Full windows of one tier, from its own loose pieces and shorter ones."""
        found, shorter = [], max((t for t in self.tiers if t < tier), default=0)
        while self.loose and self.loose[-1][0] > shorter:
            if self.loose[-1][0] > tier or sum(p[0] for p in self.loose[-8:]) < tier and sum(p[0] for p in self.loose) < tier:
                break  # too little is left for this tier, or was for a longer one; it waits for the next batch
            window = [self.loose.pop()]
            gap = tier - window[0][0]
            while gap:
                at = bisect.bisect_right(self.loose, (gap, 1 << 62, 0))
                if at:
                    window.append(self.loose.pop(at - 1))
                else:  # all others are longer than the gap: cut the shortest
                    length, doc, start = self.loose.pop(0)
                    window.append((gap, doc, start))
                    bisect.insort(self.loose, (length - gap, doc, start + gap))
                gap -= window[-1][0]
            found.append(window)
        return found

    def finish(self) -> None:
        """Lays what is left end to end, and cuts it into sequences of powers of two."""
        full, left = [], sum(p[0] for p in self.loose)
        pieces = self.loose[::-1]
        while left:
            room = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            left -= room
            window = []
            while room:
                length, doc, start = pieces.pop()
                take = min(length, room)
                window.append((take, doc, start))
                if length > take:
                    pieces.append((length - take, doc, start + take))
                room -= take
            full.append(window)
        self.loose = []
        self._emit(full)

    def _emit(self, windows: list[list[tuple]]) -> None:
        for window in sorted(windows, key=lambda w: -sum(p[0] for p in w)):
            total = sum(p[0] for p in window)
            at = next((i for i, x in enumerate(self.open) if x[0] >= total), None)
            if at is None:
                self.open.append([self.capacity, self.groups])
                self.groups, at = self.groups + 1, len(self.open) - 1
            group = self.open[at][1]
            self.open[at][0] -= total
            if not self.open[at][0]:
                del self.open[at]
            offset = 0
            for length, number, start in window:
                doc, ids = self.docs[number]
                self.rows.append((doc, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), self.first + self.sequences, offset, total, self.first + group))
                offset += length
            self.sequences += 1
        waiting = {p[1] for p in self.loose}
        self.docs = {k: v for k, v in self.docs.items() if k in waiting}


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """One row per piece: the document's id, start and length of the piece in its tokens, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset in the sequence, sequence_length and step_group. Sequences are exactly as
    long as a tier, or a lesser power of two at a partition's end. tiers: ascending powers of two."""
    bound_batches(docs.sparkSession)
    longs = [StructField(x, LongType()) for x in ("doc_tokens", "sequence_id", "offset")]
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType()), *longs, StructField("sequence_length", IntegerType()), StructField("step_group", LongType())])
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer, end_id)
        packer = Packer(tiers, step, TaskContext.get().partitionId() << 36)

        def out(least: int) -> Iterator[pa.RecordBatch]:
            while len(packer.rows) > least:
                rows, packer.rows = packer.rows[:4096], packer.rows[4096:]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            packer.add(list(zip(ids, words.encode(texts))))
            yield from out(2048)
        packer.finish()
        yield from out(0)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pack, schema)


def pack_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of documents (columns doc_id and text), with a checksum in place of their ids."""
    return pack_documents(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
