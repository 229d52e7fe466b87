"""Secret scans: a linear-chain conditional random field over the tokens of a text, beside fixed patterns.

Tokens are what white space separates; where such a token holds several candidates or is long (minified JSON, CSV, query
strings), each of its parts between other signs is a token. Each gets a class from its shape (letters, digits, mixed case, length of its
longest run of secret characters, keyword, known prefix, sign of assignment and so on). The field scores the tags secret
begin (B), inside (I) and outside (O) of a token by its own class, the classes of its neighbours, and features of the
whole text, and of neighbouring tags; Viterbi's algorithm finds the best tagging of the whole text.

Where O leads by more than any change of the two transitions beside it can win back, O is the tag in every best tagging.
Such tokens are tagged by array operations, and Viterbi's recursion runs over the stretches between them; the tagging is
the same (tests compare it with the plain recursion).

The field is trained by gradient ascent on sequences drawn from a fixed seed, the same on every run; nothing is gathered
from the corpus. One pass over the scan, no shuffle.

Defined results: a null or empty text has no spans; repeated rows give repeated results; other columns are ignored.
"""

import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .text import Cache, bound_batches, kept

KINDS = ("assign", "access", "hex", "crf")
# The patterns of the base kinds. The second group of assign has 6 characters or more; the letters before it
# come in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
# Words that announce a secret, and prefixes of public key formats.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential", "private_key")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "npm_", "hf_")

B, I, O = range(3)
CORE = re.compile(r"[A-Za-z0-9+/_.-]{6,}=*")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: What no sign cuts in a token. A token is cut if it has SEVERAL runs of the shortest secret in training, or so many signs.
BODY = re.compile(r"(?:[\w+/.-]|:(?=//))+")
LEAST, SEVERAL, LONG = 16, 2, 64
TRIM = ".,;:!?\"'()[]{}<>#$%&*|"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and without overlap within a kind."""
    found = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return found


def cuts(token: str) -> list[int]:
    """Where the parts of a token that white space separates begin; signs stay with the part before them."""
    if len(token) <= SEVERAL * LEAST:
        return [0]
    bodies = list(BODY.finditer(token))
    if len(bodies) < 2 or (len(token) < LONG and sum(any(len(x) >= LEAST for x in RUN.findall(b[0])) for b in bodies) < SEVERAL):
        return [0]
    return [0, *(b.start() for b in bodies[1:])]


def tokens_of(text: str) -> list[str]:
    found = text.split()
    if max(map(len, found), default=0) <= SEVERAL * LEAST:
        return found
    return [t[a:b] for t in found for c in [cuts(t)] for a, b in zip(c, [*c[1:], len(t)])]


def token_class(token: str) -> tuple:
    """The features of a token's shape; few distinct ones, so that their scores are worked out once."""
    bare = token.strip(TRIM)
    if bare.isalpha() and not bare.isascii():
        return ("word",)
    low = bare.lower()
    keyword = any(k in low for k in KEYWORDS)
    if bare.isalpha() and not keyword and (bare.islower() or bare.istitle()):
        return ("word",)
    if not bare:
        return ("assigns",) if token in ("=", ":", ":=", "=>") else ("signs",)
    if bare.isdigit():
        return ("digits", f"digits {min(len(bare) // 4, 5)}")
    runs = RUN.findall(token)
    run = max(runs, key=len) if runs else ""
    lower, upper, digit = (sum(map(f, run)) for f in (str.islower, str.isupper, str.isdigit))
    found = ["keyword"] * keyword
    if keyword and re.search(r"[:=]\W*$", token):
        found.append("keyword assigns")
    if keyword and re.search(r"[:=]\W*\w", token):
        found.append("keyword and value")
    if any(bare.startswith(p) or f"={p}" in bare for p in PREFIXES):
        found.append("prefix")
    if "@" in token or "://" in token or bare.startswith("www."):
        found.append("address")
    found.append(f"length {min(len(run) // 8, 5)}")
    found.append(("l" if lower else "") + ("u" if upper else "") + ("d" if digit else ""))
    if len(run) >= 16:
        n = len(run)
        bits = -sum(c / n * math.log2(c / n) for c in (run.count(x) for x in set(run)))
        turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(run, run[1:]))
        found += [f"entropy {min(int(bits), 5)}", f"turns {min(4 * turns // n, 3)}"]
        if re.fullmatch(r"[0-9a-f]+", run):
            found.append("hex")
        if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run):
            found.append("uuid")
    return tuple(found)


def file_features(classes: int, words: int, signs: int) -> list[str]:
    """Of a whole text: how much of it is no plain word, and how long it is."""
    return [f"odd {min(10 * (classes - words) // max(classes, 1), 3)}", f"size {min(len(str(classes)), 5)}", f"signs {min(10 * signs // max(classes, 1), 2)}"]


def features(cls: tuple, before: tuple, before2: tuple, after: tuple) -> list[str]:
    return [*cls, *(f"-1 {x}" for x in before), *(f"-2 {x}" for x in before2), *(f"+1 {x}" for x in after)]


class Field:
    """weights: feature -> scores of the three tags; moves: scores of a tag after a tag; begin: of a text's first tag."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray, begin: np.ndarray):
        self.weights, self.moves, self.begin = weights, moves, begin
        # by how much other tags beside a token can favour B or I over O there
        win = [moves[a, x] - moves[a, O] + moves[x, b] - moves[O, b] for x in (B, I) for a in range(3) for b in range(3)]
        win += [begin[x] - begin[O] + moves[x, b] - moves[O, b] for x in (B, I) for b in range(3)]
        win += [moves[a, x] - moves[a, O] for x in (B, I) for a in range(3)] + [begin[x] - begin[O] for x in (B, I)]
        self.swing = float(max(win)) + 1e-6
        self.scores: dict[str, list[np.ndarray]] = {p: [] for p in ("", "-1 ", "-2 ", "+1 ")}
        self.classes: dict[tuple, int] = {}
        self.tokens = Cache(self._class)
        self.number(("word",)), self.number(("signs",)), self.number(("edge",))

    def number(self, cls: tuple) -> int:
        if (n := self.classes.get(cls)) is None:
            n = self.classes[cls] = len(self.classes)
            for p, rows in self.scores.items():
                rows.append(sum((self.weights.get(p + x, np.zeros(3)) for x in cls), np.zeros(3)))
        return n

    def _class(self, token: str) -> int:
        return self.number(token_class(token))

    def emissions(self, tokens: list[str]) -> np.ndarray:
        own = np.fromiter(map(self.tokens.__getitem__, tokens), np.int32, len(tokens))
        own_s, before, before2, after = (np.array(rows) for rows in self.scores.values())
        edge = np.array([2, 2], np.int32)
        around = np.concatenate([edge, own, edge[:1]])
        of_file = sum((self.weights.get(x, np.zeros(3)) for x in file_features(len(own), int((own == 0).sum()), int((own == 1).sum()))), np.zeros(3))
        return own_s[own] + before[around[1:-2]] + before2[around[:-3]] + after[around[3:]] + of_file

    def viterbi(self, e: np.ndarray, left: int | None = None, right: int | None = None) -> list[int]:
        """The best tags; left and right: the tags beside the stretch, where there are any."""
        score, back = e[0] + (self.begin if left is None else self.moves[left]), []
        for row in e[1:]:
            each = score[:, None] + self.moves
            back.append(each.argmax(0))
            score = each.max(0) + row
        tags = [int((score + (0 if right is None else self.moves[:, right])).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tag(self, tokens: list[str]) -> np.ndarray:
        """The best tags of a text's tokens."""
        tags = np.full(len(tokens), O, np.int8)
        if not tokens:
            return tags
        e = self.emissions(tokens)
        doubt = np.flatnonzero(e[:, O] - e[:, :O].max(1) <= self.swing)
        if len(doubt):
            for part in np.split(doubt, np.flatnonzero(np.diff(doubt) > 1) + 1):
                a, b = part[0], part[-1] + 1
                tags[a:b] = self.viterbi(e[a:b], None if a == 0 else O, None if b == len(tokens) else O)
        return tags

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the secrets lie that the field finds: the longest run of secret characters of each tagged token, tokens
        tagged inside joined to the one before if white space parts them."""
        tags = self.tag(tokens_of(text))
        if not (tags != O).any():
            return []
        found: list[tuple[int, int]] = []
        places = ((m.start() + a, m.start() + b, a == 0) for m in re.finditer(r"\S+", text) for c in [cuts(m[0])] for a, b in zip(c, [*c[1:], len(m[0])]))
        for n, (start, end, first) in enumerate(places):
            if tags[n] == O:
                continue
            cores = list(CORE.finditer(text, start, end))
            if not cores:
                continue
            core = max(cores, key=lambda c: c.end() - c.start())
            if tags[n] == I and first and found and n and tags[n - 1] != O:
                found[-1] = (found[-1][0], core.end())
            else:
                found.append((core.start(), core.end()))
        return found


def training_lines(n: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Sequences of tokens with their tags: invented prose with numbers, addresses and identifiers, and secrets in some."""
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ou", "ch", "de", "la", "que", "ción", "é"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 5)))
    some = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hexes = "0123456789abcdef"

    def secret() -> str:
        kind = r.randrange(6)
        if kind == 0:
            return r.choice(PREFIXES) + some(alnum, 16, 40)
        if kind == 1:
            return some(hexes, 24, 64)
        if kind == 2:
            return some(alnum + "+/", 24, 64) + "=" * r.randrange(3)
        if kind == 3:
            return some(alnum + "-_", 20, 44)
        if kind == 4:
            return "AKIA" + some(alnum[:26] + alnum[52:], 16, 16)
        return some(alnum, 16, 32)

    def plain() -> str:
        x = r.random()
        if x < 0.75:
            w = word()
            return (w.title() if r.random() < 0.1 else w) + r.choice(["", "", "", "", ".", ","])
        return r.choice([
            lambda: some("0123456789", 1, 6), lambda: some("0123456789", 13, 19), lambda: f"{word()}.{r.randrange(99)}@mail{r.randrange(9)}.example.com",
            lambda: f"https://www.{word()}.example.org/{word()}/{r.randrange(999)}", lambda: f"{word()}###", lambda: r.choice(["$$$", "###", "&&&", "%%%", "=", ":", "-"]),
            lambda: f"{some(hexes, 8, 8)}-{some(hexes, 4, 4)}-{some(hexes, 4, 4)}-{some(hexes, 4, 4)}-{some(hexes, 12, 12)}", lambda: f"+{r.randrange(1, 99)}-{some('0123456789', 3, 3)}-{some('0123456789', 6, 7)}",
            lambda: f"{word()}_{word()}", lambda: f"{word()}-{word()}-{word()}", lambda: f"{word()}{r.randrange(99)}", lambda: "".join(word() for _ in range(6)), lambda: r.choice(KEYWORDS),
            lambda: f"{r.randrange(1, 32)}/{r.randrange(1, 13)}/{r.randrange(1950, 2050)}", lambda: word().upper(), lambda: f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(20)}",
            lambda: f"{word()}%%%{word()}###{word()}", lambda: f"{word()}.{word()}.{word()}({word()})",
        ])()

    found = []
    for _ in range(n):
        tokens = [plain() for _ in range(r.randint(4, 24))]
        tags = [O] * len(tokens)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            at, s = r.randrange(len(tokens) + 1), secret()
            quote = r.choice(["", "", '"', "'"])
            value, key = quote + s + quote + r.choice(["", "", "###", ",", ";"]), r.choice(KEYWORDS)
            key = key.upper() if r.random() < 0.3 else key
            new = r.choice([[key, "=", value], [f"{key}:", value], [f"{key}={value}"], [key, ":", value], [value], ["Bearer", value]])
            mark = [O] * (len(new) - 1) + [B]
            if r.random() < 0.15:  # a block of lines
                more = [some(alnum + "+/", 40, 64) for _ in range(r.randint(1, 4))]
                new, mark = new + more, mark + [I] * len(more)
            tokens[at:at], tags[at:at] = new, mark
        found.append((tokens, tags))
    return found


@functools.lru_cache(maxsize=1)
def trained(lines: int = 1200, steps: int = 120, seed: int = 7) -> Field:
    """The field, fitted to training_lines() by gradient ascent (Adam) on the penalised log-likelihood."""
    data = training_lines(lines, seed)
    names: dict[str, int] = {}
    rows, longest = [], max(len(t) for t, _ in data)
    tags = np.full((lines, longest), -1)
    for k, (tokens, own) in enumerate(data):
        cls = [("edge",), ("edge",), *map(token_class, tokens), ("edge",)]
        whole = file_features(len(tokens), cls.count(("word",)), cls.count(("signs",)))
        tags[k, : len(own)] = own
        for t in range(len(tokens)):
            rows += [(k * longest + t, names.setdefault(f, len(names))) for f in features(cls[t + 2], cls[t + 1], cls[t], cls[t + 3]) + whole]
    at, of = np.array(rows).T
    mask = tags >= 0
    truth = np.zeros((lines, longest, 3))
    truth[mask, tags[mask]] = 1
    size = len(names)
    w = np.zeros(size * 3 + 12)
    m, v = np.zeros_like(w), np.zeros_like(w)
    last = mask.sum(1) - 1
    true_moves = np.zeros((3, 3))
    np.add.at(true_moves, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
    for step in range(1, steps + 1):
        weights, moves, begin = w[: size * 3].reshape(size, 3), w[size * 3 : -3].reshape(3, 3), w[-3:]
        e = np.stack([np.bincount(at, weights[of, y], lines * longest) for y in range(3)], 1).reshape(lines, longest, 3)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + begin
        for t in range(1, longest):
            forward[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + e[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            backward[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2), 0)
        total = np.logaddexp.reduce(forward[np.arange(lines), last], axis=1)
        p = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        both = np.exp(forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        gap = (truth - p).reshape(-1, 3)
        grad = np.concatenate([np.stack([np.bincount(of, gap[at, y], size) for y in range(3)], 1).ravel(), (true_moves - both.sum((0, 1))).ravel(), (truth - p)[:, 0].sum(0)]) - 0.5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = w[: size * 3].reshape(size, 3)
    return Field({f: weights[n] for f, n in names.items()}, w[size * 3 : -3].reshape(3, 3), w[-3:])


def kept_field(key: bytes, model: tuple) -> Field:
    """One for all tasks that a worker runs, with the classes of tokens it knows."""
    return kept("field", key, lambda: Field(*model))


def uncovered(text: str, span: tuple[int, int], base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that no base span (sorted) covers, without those of signs alone."""
    at, end = span
    for x, y, _ in [*base, (end, end, "")]:
        if x > at and any(map(str.isalnum, text[at : min(x, end)])):
            yield at, min(x, end)
        at = max(at, y)
        if at >= end:
            return


def text_spans(text: str | None, field: Field) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as listed: the base ones, and what they leave of those of the field."""
    if not text:
        return []
    found = base_spans(text)
    base = sorted(found)
    found += [(a, b, "crf") for span in field.spans(text) for a, b in uncovered(text, span, base)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def masked(text: str | None, spans: list[tuple[int, int, str]], mask: str) -> str | None:
    """The text with mask in place of each run of overlapping spans, which come by start."""
    at, parts = 0, []
    for a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if spans else text


def find_secrets(docs: DataFrame, text_col: str = "text", mask: str | None = None) -> DataFrame:
    """The rows of docs with one more column, secret_spans array<struct<kind, start, end>>: code points, end exclusive,
    by start, then kind as listed in KINDS. A column of that name is replaced. With mask, each run of overlapping spans in
    the texts is replaced by it; the spans are those of the texts as they were."""
    docs = docs.drop("secret_spans")
    bound_batches(docs.sparkSession)
    field = trained()
    model = (field.weights, field.moves, field.begin)
    key = field.moves.tobytes() + field.begin.tobytes()
    schema = StructType([*docs.schema.fields, StructField("secret_spans", SPANS)])
    kind = to_arrow_schema(schema).field("secret_spans").type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = kept_field(key, model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [text_spans(t, here) for t in texts]
            columns = list(batch.columns)
            if mask is not None:
                columns[at] = pa.array([masked(t, s, mask) for t, s in zip(texts, found)], columns[at].type)
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*names, "secret_spans"])

    names, at = docs.columns, docs.columns.index(text_col)
    return docs.mapInArrow(scan, schema)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows of docs with mask in place of each secret of their texts, in one pass; a column secret_spans goes."""
    return find_secrets(docs, text_col, mask).drop("secret_spans")


def secret_digest(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text")).drop("text")
    of = lambda *kinds: F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
