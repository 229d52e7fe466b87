"""Each operator against a brute-force version, and the defined results for odd input."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from lattica.llm import ann, chat, decontamination, graph, licenses, ngram_join, packing, queries, secrets, sharding, text, toxicity, warc

ODD_DOCS = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "one two"), (None, "a b c d e f g h i"), (6, "word " * 30000), (7, "x" * 100_000), (8, "\ud7ff ünï ￿ \x00 \x1c"), (9, "A. b! <|im_end|> \\")]
ODD_SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, long texts and columns with names that operators use inside."""
    df = spark.createDataFrame(ODD_DOCS, ODD_SCHEMA)
    return df.withColumn("n", F.lit(1)).withColumn("sig", F.lit("x")).withColumn("cluster", F.lit(None).cast("int")).withColumn("_t", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck.execute(queries.oracle_sql()[name]))


def test_hashed_words():
    r = random.Random(8)
    signs = [*"aAbB \t\n\x0b\x0c\r\x1c.,é𝄞\xa0\x00"]
    for table, cut in ((text.SPACED, rb"[^\x20\x09-\x0d]+"), (text.PLAIN, rb"[0-9a-z\x80-\xff]+")):
        seen = {}
        for _ in range(3000):
            t = "".join(r.choice(signs) for _ in range(r.randint(0, 20)))
            words = re.findall(cut, t.encode().lower())
            got = text.hashed_words(t, table)
            assert len(got) == len(words)
            for w, h in zip(words, got.tolist()):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
    long = ["x" * 10_000, "x" * 5_904 + "y" + "x" * 4_095, "x" * 10_001]
    assert len({text.hashed_words(t, text.SPACED)[0] for t in long}) == 3


# n-gram join


def brute_join(rows, n, num):
    def grams(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode("utf-8", "surrogatepass").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    comp = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            comp[find(k)] = min(comp.get(find(k), doc), doc)
    return sorted((doc if doc is not None else -1, len(sets[k]), comp[find(k)] if doc is not None else -1, links[k]) for k, (doc, _) in enumerate(rows))


def joined(df, n, num):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1, r.n_links) for r in ngram_join.jaccard_join(df, n, num, 100).collect())


def near_copies(seed, groups=6, copies=9):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = r.choices(vocabulary, k=60)
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice([3, 8, 15, 40, 200, 700]))
        for _ in range(copies):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(words) // 30])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                words += passage
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (1, 50)])
def test_join_finds_all_links(spark, n, num):
    rows = near_copies(n)
    assert joined(spark.createDataFrame(rows, ODD_SCHEMA).repartition(5), n, num) == brute_join(rows, n, num)


def test_join_with_tiles_fragments_and_large_blocks(spark, monkeypatch):
    for name, value in (("CHUNK", 7), ("FRAGMENT", 50), ("SMALL", 3), ("CELLS", 200), ("HOT", 4), ("DEALT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(graph, "HOT_ROWS", 5)
    monkeypatch.setattr(graph, "HOT_KEYS", 20)
    rows = near_copies(9, groups=3, copies=40) + [(1000 + k, "a b c d e f") for k in range(30)]
    assert joined(spark.createDataFrame(rows, ODD_SCHEMA), 4, 85) == brute_join(rows, 4, 85)


def test_few_rows_that_are_not_wanted_are_let_through(spark, monkeypatch):
    wanted = spark.range(-3000, 30_000, 3).toDF("doc_id")
    rows = spark.range(-3000, 30_000).toDF("doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    # 22,000 rows meet 11,000 of 2^25 bits: 7.2 pass by chance, with a deviation of 2.7; a map that is full lets all through
    for bits, most in ((1 << 25, 11_000 + 21), (64, 33_001)):
        monkeypatch.setattr(ngram_join, "BITS", bits)
        got = {r.doc_id for r in ngram_join.among(rows, wanted).collect()}
        assert got >= set(range(-3000, 30_000, 3)) and len(got) <= most
    assert ngram_join.among(rows, wanted.limit(0)).count() == 0


def test_join_of_odd_rows(odd, empty):
    got = joined(odd, 4, 85)
    assert got == brute_join(ODD_DOCS, 4, 85)
    shared = [(3, "a b c d e f g"), (None, "a b c d e f g"), (None, "a b c d e f g"), (5, "a b c d e f g"), (4, "x " * 9), (4, "y " * 9), (6, "y " * 9)]
    assert joined(odd.sparkSession.createDataFrame(shared, ODD_SCHEMA), 4, 85) == brute_join(shared, 4, 85)
    assert joined(empty, 4, 85) == []


def test_blocks_are_the_same_in_any_batches():
    import pyarrow as pa

    r = random.Random(3)
    rows = sorted({(r.randrange(40), r.randrange(3) // 2, r.randrange(30)) for _ in range(400)})
    rows = [(*x, x[1] > 0 or x[0] % 7 == 0) for x in rows]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["sig", "place", "doc_id", "shared"])
    once = {x for b in ngram_join._blocks(iter([batch])) for x in zip(*(c.to_pylist() for c in b.columns))}
    parts = {x for b in ngram_join._blocks(iter([batch.slice(k, 3) for k in range(0, len(rows), 3)])) for x in zip(*(c.to_pylist() for c in b.columns))}
    assert once == parts and {x[0] for x in once} == {0, 1}
    assert {x[1:] for x in once if x[0]} >= {(sig, doc) for sig, _, doc, shared in rows if shared}


def test_a_frequent_signature_is_dealt_by_document():
    sig = np.r_[np.full(300, 5), np.arange(100, 200)].astype(np.uint64)
    got = ngram_join.placed(sig, np.arange(400)).to_pydict()
    of = [(p, d, s) for g, p, d, s in zip(*got.values()) if g == 5]
    assert len({p for p, _, _ in of}) > 50 and all(s for *_, s in of) and sum(p == 0 for p, *_ in of) == 1
    assert {p for g, p, *_ in zip(*got.values()) if g != 5} == {0}


def test_signatures_meet_whatever_the_difference():
    r = np.random.default_rng(1)
    for num in (80, 85):
        classes = ngram_join.Classes(num, 100)
        for size in (6, 7, 20, 33, 100, 480, 3000):
            for _ in range(20):
                a = np.unique(r.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
                b = np.unique(np.concatenate([a[r.permutation(len(a))[: int(len(a) * r.uniform(0.88, 1))]], r.integers(0, 2**63, int(size * r.uniform(0, 0.12))).astype(np.uint64) * np.uint64(2)]))
                i = len(np.intersect1d(a, b))
                if 100 * i >= num * (len(a) + len(b) - i) and len(a) != i:
                    assert set(classes.signatures(a)) & set(classes.signatures(b))
                    assert ngram_join.may_link(ngram_join.counts_by_part(a).tobytes(), len(a), ngram_join.counts_by_part(b).tobytes(), len(b), num, 100)


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100, 102: 100}


# packing


def check_packing(rows, tokens):
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0
    for doc, ids in tokens.items():
        parts = sorted(documents[doc], key=lambda p: p.start)
        assert b"".join(p.ids for p in parts) == np.array(ids, "<u4").tobytes()
        assert all(p.doc_tokens == len(ids) for p in parts)
    return sequences


def test_packing_keeps_every_token(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "a\x1cb c d́ éÉ İI 'S don't<|endoftext|>x y\x85z ΑΣ ΣΑΣ ... a.. b., Straße. ÉTÉ, "), (-4, "Ab. " * 9000), (-5, "q" * 20000)]
    rows = docs.union(spark.createDataFrame(extra, ODD_SCHEMA)).collect()
    tokens = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows}
    found = packing.pack_documents(spark.createDataFrame(rows, ODD_SCHEMA).repartition(3), queries.tokenizer_path()).collect()
    sequences = check_packing(found, tokens)
    steps = {}
    for pieces in sequences.values():
        steps[pieces[0].step_group] = steps.get(pieces[0].step_group, 0) + pieces[0].sequence_length
    assert max(steps.values()) <= 16 * 4096


def test_word_tokens_are_the_tokenizers():
    words, r = packing.WordTokens(queries.tokenizer_path(), 2), random.Random(1)
    signs = [*"aAbBzZ019.,!?'\"<|>_-  \n\téÉßİıΣσς́ж中𝄞\x0b\x0c\x1c\x85\xa0 ﬁǅ", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "don't"]
    for _ in range(3000):
        t = "".join(r.choice(signs) for _ in range(r.randint(0, 25)))
        assert list(words.encode([t])[0]) == [*words.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_packer_in_any_batches():
    r = random.Random(5)
    for _ in range(200):
        lengths = [r.choice([1, 7, 300, 511, 512, 513, 1500, 3000, 4095, 4096, 9000]) for _ in range(r.randint(0, 40))]
        packer, at = packing.Packer(), 0
        while at < len(lengths):
            n = r.randint(1, 6)
            packer.add([(k, np.arange(k, k + lengths[k], dtype=np.uint16)) for k in range(at, min(at + n, len(lengths)))])
            at += n
        packer.finish()
        assert sum(x[2] for x in packer.rows) == sum(lengths) and not packer.loose


def test_packing_digest_of_odd_rows(odd, empty):
    rows = packing.pack_digest(odd, queries.tokenizer_path()).collect()
    null = [r for r in rows if r.doc_id == 1]
    assert [(r.length, r.doc_tokens, r.ids_crc32) for r in null] == [(1, 1, zlib.crc32(np.array([2], "<u4").tobytes()))]
    assert packing.pack_digest(empty, queries.tokenizer_path()).count() == 0


# secrets


def brute_base(t):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (p, least) in enumerate([(r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)], 1):
        found += [(m.start(), k, f"{['assign', 'access', 'hex'][k]}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if len(m[0]) >= least]
    return ",".join(x[2] for x in sorted(found))


TRICKY = ["password=token:abcdefgh", "token==abc TOKEN: 'aaaaaa' api_key=ſecret1 Tokeſ=123456", "é AKIAAKIA AKIA" + "A1" * 9 + "a", "f" * 23 + "g" + "0" * 24, "secret = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"###", "pass password: \nabcdefg", ""]


def test_base_spans(spark):
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = secrets.secret_digest(spark.createDataFrame(list(enumerate(texts)), ODD_SCHEMA)).collect()
    for r in rows:
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("crf")) == want


def test_the_field_tags_as_the_plain_recursion_does_and_learns():
    field = secrets.trained()
    right = wrong = 0
    for tokens, tags in secrets.training_lines(150, 99):
        got = field.tag(tokens)
        assert list(got) == field.viterbi(field.emissions(tokens))
        right += sum((a == b) for a, b in zip(tags, got))
        wrong += sum((a != b) for a, b in zip(tags, got))
    assert right / (right + wrong) > 0.98


def test_the_field_finds_what_no_pattern_knows_and_leaves_prose():
    field = secrets.trained()
    line = "the config has auth: ghp_9aZ3kLmN0pQrStUvWxYz12345678AbCd in it"
    spans = secrets.text_spans(line, field)
    assert any(k == "crf" and "ghp_9aZ3" in line[a:b] for a, b, k in spans)
    assert secrets.text_spans("Plain words stand here, and none of them is a secret at all.", field) == []


def test_several_secrets_in_a_token():
    """Every key of a text without spaces is found, and one beside a base span too."""
    field, r = secrets.trained(), random.Random(4)
    some = lambda n: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    forms = ['{{"stripe":"{}","github":"{}"}}', "id,{},name,{},7", "https://www.example.org/a?k={}&sig={}&page=2", "password={};{}", "a='{}';b='{}'"]
    for form in forms:
        for _ in range(10):
            keys = ("sk_live_" + some(24), "ghp_" + some(36)) if not form.startswith("password") else (some(46), "ghp_" + some(36))
            line = form.format(*keys)
            covered = {k for a, b, _ in secrets.text_spans(line, field) for k in range(a, b)}
            for key in keys:
                assert covered >= set(range(line.index(key), line.index(key) + len(key))), line
    many = {f"key{k}": "ghp_" + some(36) for k in range(200)}
    spans = secrets.text_spans(line := json.dumps(many, separators=(",", ":")), field)
    assert [line[a:b] for a, b, _ in spans] == list(many.values())


def test_key_words_count_in_long_tokens():
    r = random.Random(6)
    for form in ("access_key={}", '"credential":"{}"', "auth/{}"):
        key = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=60))
        assert "keyword" in secrets.token_class(form.format(key))
        assert any(line[a:b].endswith(key) for line in [f"see {form.format(key)} here"] for a, b, _ in secrets.text_spans(line, secrets.trained()))


def test_only_the_covered_part_of_a_span_is_dropped():
    part = lambda span, *base: list(secrets.uncovered("abcdefghij==", span, [(*x, "hex") for x in base]))
    assert part((0, 10)) == [(0, 10)] and part((0, 10), (0, 10)) == [] and part((2, 12), (0, 4), (6, 8)) == [(4, 6), (8, 12)]
    assert part((0, 12), (0, 10)) == [] and part((3, 6), (8, 10)) == [(3, 6)] and part((3, 6), (0, 2), (5, 9)) == [(3, 5)]


def test_redaction(spark, odd, empty):
    df = spark.createDataFrame([(1, "é token=abcdefgh x"), (2, None), (3, "clean")], ODD_SCHEMA)
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()] == ["é [SECRET] x", None, "clean"]
    assert secrets.secret_digest(odd).count() == len(ODD_DOCS) and secrets.secret_digest(empty).count() == 0


# warc


def test_archives_round_trip(spark, tmp_path):
    big = "y" * 1500 + "é"
    rows = [(1, "http://a/é \r\n", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "s"), (6, "u", "s"), (7, "u", big), (7, "u", big), (None, "u", big), (8, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write_archives(pages, f"file://{tmp_path}/w", frame=4096)
    back = warc.read_archives(index, f"file://{tmp_path}/w").collect()
    kinds = sorted(((r.archive_page_id, r.record_type, r.refers_to) for r in back), key=str)
    assert kinds == sorted([(1, "revisit", 7), (2, "revisit", 7), (7, "response", None), *((k, "response", None) for k in (3, 4, 5, 6, 7, 8, None))], key=str)
    payload = {r.archive_page_id: r.payload for r in back if r.record_type == "response"}
    assert payload[7] == big.encode() and payload[3] == b"" and len(payload[8]) == 3_000_000
    assert all(r.payload_digest == hashlib.sha1(big.encode()).hexdigest() for r in back if r.archive_page_id in (1, 2, 7))
    import zstandard

    whole = (tmp_path / "w" / index.first().archive).read_bytes()
    plain = b""
    with zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True) as r:
        plain = r.read()
    assert plain.startswith(b"WARC/1.1\r\n")  # an ordinary decompressor skips the seek table


def test_archives_of_no_pages(spark):
    assert warc.archive_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# sharding


def test_merges_are_of_similar_sizes_and_keep_every_shard():
    r = random.Random(2)
    for _ in range(100):
        sizes = [int(2 ** r.uniform(5, 24)) for _ in range(r.randint(0, 60))]
        groups = sharding.plan_merges(sizes, target=1 << 20, fan=4, smallest=1 << 10)
        assert sorted(k for g in groups for k in g) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in g) <= 1 << 20 for g in groups if len(g) > 1)


def test_versions_and_compaction(spark, tmp_path):
    shards = sharding.Shards(spark, f"file://{tmp_path}/s")
    rows = [(k, None if k % 7 == 0 else f"text {k}") for k in range(500)]
    df = spark.createDataFrame(rows + rows[:3], ODD_SCHEMA).withColumn("_shard", F.lit(1))
    assert shards.append(df.where("doc_id < 250"), rows=20) == 1
    assert shards.append(df.where("doc_id >= 250"), rows=20) == 2
    before = len(shards.manifest()["shards"])
    assert shards.compact(target=20_000, fan=4, smallest=500) == 3
    after = len(shards.manifest()["shards"])
    assert after < before
    count = lambda v: sorted((r.doc_id, r.text or "") for r in shards.read(v).collect())
    assert count(3) == count(2) == sorted((k, t or "") for k, t in rows + rows[:3])
    with pytest.raises(RuntimeError):
        shards.commit({"version": 2, "schema": None, "shards": []}, [], [], None)
    assert shards.vacuum() > 0
    assert count(3) == sorted((k, t or "") for k, t in rows + rows[:3])
    assert {r.__shard for r in shards.read().collect()} == {s["path"] for s in shards.manifest()["shards"]}


def test_sharding_query(spark, empty):
    got = {r.doc_id: (r.text_bytes, r.text_sha256) for r in queries.op6_sharding(spark, SF).collect()}
    want = {r.doc_id: (len(r.text.encode()), hashlib.sha256(r.text.encode()).hexdigest()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == want
    assert sharding.shard_digest(empty).count() == 0


# chats


def test_chats_of_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b<|im_sep|>\\"), (1, 2, "assistant", None), (1, 2, "assistant", "\\<|im_end|>\n"), (1, None, None, "first"), (1, 3, "ro\nle\\n<|", "x"), (None, 0, "assistant", "z"), (2, 0, "assistant", "é𝄞"), (2, 0, "assistant", "é𝄞")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_t", F.lit(1))
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in (1, 2, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for _, r, x in own]
        assert back[conv].loss_text == "".join(x for _, r, x in own if r == "assistant")
    assert chat.chat_digest(df.limit(0)).count() == 1


# toxicity


def test_toxic_texts_are_told_from_clean_ones(spark):
    r = random.Random(4)
    prose = [f"w{k}" for k in range(3000)]
    bad = ["grubling", "snarfel", "moldwort", "vexpel"]
    rows, labels = [], []
    for k in range(1200):
        words, toxic = r.choices(prose, k=r.randint(5, 300)), k % 8 == 0
        for _ in range(r.randint(1, 6) * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "s", ".", "ing"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, ODD_SCHEMA).withColumn("severity2", F.lit(0))
    known = spark.createDataFrame([x for x in labels if x[0] < 800] + [(5, None), (None, 1)], "doc_id long, toxic int")
    scored = {x.doc_id: x for x in toxicity.score_toxicity(docs, known).collect()}
    held = [(scored[k].toxic_rejected, bool(y)) for k, y in labels if k >= 800]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= x.severity <= 3 for x in scored.values())


def test_toxicity_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.toxic_rejected for x in toxicity.score_toxicity(odd, none).collect()] == [False] * len(ODD_DOCS)
    assert toxicity.score_toxicity(empty, none).count() == 0


def toxicity_sample():
    r = np.random.default_rng(0)
    rows = [(int(k % 4 == 0), np.unique(np.r_[r.integers(100, 2000, 30), np.arange(10)[: r.integers(1, 8)] if k % 4 == 0 else []]).astype(int)) for k in range(600)]
    y = np.array([y for y, _ in rows])
    t, c = (np.bincount(np.concatenate([x for z, x in rows if z == of]), minlength=2000) for of in (1, 0))
    has, mark = toxicity.worth(t.astype(float), c.astype(float), int((y == 1).sum()), int((y == 0).sum()))
    return toxicity.Sample(y, [x[has[x]] for _, x in rows], np.flatnonzero(has), np.flatnonzero(mark))


def test_thresholds_ascend_and_weights_are_shared():
    model = toxicity.fit(toxicity_sample())
    assert (np.diff(model.cuts) > 0).all()
    scores = np.linspace(-5, 25, 50)
    assert (np.diff(model.severity(scores)) > 0).all()


def test_the_fit_is_where_a_plain_likelihood_is_largest():
    sample = toxicity_sample()
    model, grades = toxicity.fit(sample, steps=3000), sample.grades()

    def likelihood(weights, cuts):
        total = 0.0
        for cells, g in zip(sample.cells, grades):
            score = sum(weights[k] for k in cells.tolist())
            above = [1.0, *(1 / (1 + np.exp(c - score)) for c in cuts), 0.0]
            total += np.log(above[g] - above[g + 1])
        return total / len(grades) - toxicity.RIDGE / 2 * sum(w * w for w in weights.values())

    best, step = likelihood(model.weights, model.cuts), 0.02
    for k in list(model.weights)[:6]:
        for by in (step, -step):
            assert likelihood(model.weights | {k: model.weights[k] + by}, model.cuts) <= best + 1e-5
    for k in range(3):
        for by in (step, -step):
            assert likelihood(model.weights, model.cuts + by * (np.arange(3) == k)) <= best + 1e-5


def test_severity_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    sample = toxicity.labelled_sample(docs, labels, 8000)
    # the sample, by plain counting
    toxic = {r.doc_id: int(r.toxic > 0) for r in labels.collect() if r.toxic is not None}
    of = lambda t: frozenset(b for w in text.plain_words(t or "") for b in toxicity.word_buckets(w))
    rows = {(toxic[r.doc_id], of(r.text)) for r in docs.collect() if r.doc_id in toxic}
    n = [sum(y == k for y, _ in rows) for k in (0, 1)]
    odds = {}
    for b in set().union(*(x for _, x in rows)):
        c, t = (sum(b in x for y, x in rows if y == k) for k in (0, 1))
        if t >= max(4, 0.01 * n[1]):
            odds[b] = np.log((t + 0.5) / (n[1] + 1)) - np.log((c + 0.5) / (n[0] + 1))
    assert sorted(sample.kept.tolist()) == sorted(b for b in odds if odds[b] > 2) and sorted(sample.marks.tolist()) == sorted(b for b in odds if odds[b] > 2.5)
    assert sorted(zip(sample.toxic.tolist(), map(sorted, (c.tolist() for c in sample.cells)))) == sorted((y, sorted(x & set(sample.kept.tolist()))) for y, x in rows)
    model = toxicity.fit(sample)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.collect():
        score = sum(model.weights.get(b, 0.0) for b in of(r.text))
        severity = sum(1 / (1 + np.exp(c - score)) for c in model.cuts)
        assert abs(got[r.doc_id].severity - severity) < 1e-9 and got[r.doc_id].toxic_rejected == (severity >= 0.5)


# decontamination


def test_items_are_found_through_substitutions_and_clean_texts_are_left():
    r = random.Random(6)
    vocabulary = [f"v{k}" for k in range(5000)]
    of = lambda words: text.hashed_words(" ".join(words), text.PLAIN)
    items = [r.choices(vocabulary, k=r.choice([3, 15, 30, 59])) for _ in range(40)]
    index = decontamination.Items(list(range(40)), [of(i) for i in items])
    for _ in range(300):
        words = r.choices(vocabulary, k=r.randint(0, 400))
        assert not index.overlaps(of(words))
        k = r.randrange(40)
        held = list(items[k])
        if len(held) >= 15:
            for p in range(r.randrange(7), len(held), 8):
                held[p] = "changed"
        at = r.randrange(len(words) + 1)
        found = index.overlaps(of(words[:at] + held + words[at:]))
        assert k in found and found[k][1] == at


def test_a_line_that_many_items_share_is_compared_in_bounded_steps(monkeypatch):
    r = random.Random(9)
    vocabulary = [f"v{k}" for k in range(500)]
    line = r.choices(vocabulary, k=8)
    of = lambda words: text.hashed_words(" ".join(words), text.PLAIN)
    items = [of(line + r.choices(vocabulary, k=r.randint(8, 40))) for _ in range(300)]
    index = decontamination.Items(list(range(300)), items)
    words = [w for _ in range(20) for w in [*line, *r.choices(vocabulary, k=7)]]
    doc = np.concatenate([of(words), items[7], of(words), items[9][:-2]])
    want = {}
    for k, item in enumerate(items):
        for shift in range(-len(item) + 1, len(doc)):
            a, b = max(0, -shift), min(len(item), len(doc) - shift)
            equal = item[a:b] == doc[a + shift : b + shift]
            runs = [equal[p : p + 20].sum() for p in range(len(equal) - 19)]
            if (equal.sum() >= 0.6 * len(item) or max(runs, default=0) >= 16) and (k not in want or equal.sum() > want[k][0]):
                want[k] = (int(equal.sum()), shift, equal.sum() / len(item))
    assert {7, 9} <= set(want) and index.overlaps(doc) == want
    monkeypatch.setattr(decontamination, "AT_ONCE", 100)
    assert index.overlaps(doc) == want


def test_contaminations_against_brute_force(spark, odd, empty):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(docs, bench).collect()}
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items if f" {t} " in f" {words(d.text)} "}
    assert want and want <= got and len(got) <= len(want) + 1
    blocks = {(r.doc_id, r.item_id) for r in decontamination.mark_contaminated(docs, bench, block_words=100).select("doc_id", F.explode("test_items").alias("h")).select("doc_id", "h.item_id").collect()}
    assert blocks == got
    odd_bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two")], "item_id long, text string")
    kept = decontamination.drop_contaminated(odd, odd_bench)
    assert kept.count() == len(ODD_DOCS) - 3 and kept.columns == odd.columns
    assert decontamination.drop_contaminated(empty, odd_bench).count() == 0


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh"), (2, None)], ODD_SCHEMA)
    for name in ("secret_spans", "test_items", "severity", "severity_grade", "toxic_rejected", "_h"):
        df = df.withColumn(name, F.lit("x"))
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()] == ["[SECRET]", None]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(df, none).where("toxic_rejected").count() == 0
    bench = spark.createDataFrame([(1, "token abcdefgh")], "item_id long, text string")
    assert [r.doc_id for r in decontamination.drop_contaminated(df, bench).collect()] == [2]
    assert decontamination.contaminations(df, bench).count() == 1


# neighbours


def brute_nearest(rows, queries_, k=5):
    best = {}
    for q, v in queries_:
        score = [(-float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), i) for i, x in rows if i != q]
        best[q] = [i for _, i in sorted(score)[:k]]
    return best


def test_neighbours_against_brute_force(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in t.collect()]
    got = {}
    for r in ann.nearest_of_table(t).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows, [x for x in rows if x[0] % 50 == 0])
    hit = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert got.keys() == want.keys() and hit / (5 * len(want)) >= 0.95


def test_graphs_of_several_shards_find_the_nearest_with_few_comparisons(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(12_000, 10)) @ r.normal(size=(10, 32)) + 0.05 * r.normal(size=(12_000, 32))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    ids = np.arange(0, len(x), 50)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[ids] @ unit.T
    near[np.arange(len(ids)), ids] = -2
    want = dict(zip(ids.tolist(), np.argsort(-near, axis=1)[:, :5].tolist()))
    got, compared = {}, []
    for row in ann.nearest(df, df.where("vec_id % 50 = 0"), shard=6000, beam=24).collect():  # two shards
        got.setdefault(row.query_id, set()).add(row.vec_id)
        compared.append(row.evaluated)
    recall = sum(len(got[q] & set(want[q])) for q in want) / (5 * len(want))
    assert recall >= 0.9 and np.mean(compared) <= 0.1 * len(x), (recall, np.mean(compared) / len(x))


def test_neighbours_with_ties_and_unusable_vectors(spark):
    r = np.random.default_rng(3)
    same_ = [1.0, 2.0, 3.0]
    rows = [(k, same_) for k in range(100)] + [(k, r.normal(size=3).tolist()) for k in range(100, 300)] + [(300, None), (350, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (450, [float("nan"), 1.0, 1.0]), (500, []), (None, same_), (7, same_)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("shard", F.lit("x"))
    got = {}
    for x in ann.nearest(df, df.where("vec_id % 50 = 0"), shard=64).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert set(got) == {0, 50, 100, 150, 200, 250}
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4]
    assert ann.nearest_of_table(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, same_), (1, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(x.query_id, x.vec_id) for x in ann.nearest_of_table(few).collect()] == [(0, 1)]


# licences


def test_every_known_sentence_has_an_anchor():
    for sentence in licenses.sentence_ids():
        assert any(a in sentence for a in licenses.ANCHORS) or sentence.endswith(" spdx")


MIT = "\n".join(["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal", "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:", "", "The above copyright notice and this permission notice shall be included in all", "copies or substantial portions of the Software."])


def test_licences(spark, odd, empty):
    rows = [(1, "Prose.\nReleased under the MIT License.\nMore"), (2, f"x\n\n{MIT}\n"), (3, "// SPDX-License-Identifier: Apache-2.0\ncode"), (4, "Licensed under CC BY-NC 4.0. All rights reserved."), (5, "no licence, free of charge")]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(rows, ODD_SCHEMA)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "CC-BY-NC-4.0,all-rights-reserved", 5: ""}
    assert licenses.scan_licenses(odd).count() == len(ODD_DOCS) and licenses.scan_licenses(empty).count() == 0
    assert json.dumps(sorted(dict(licenses.rules()).values()))


MIT_REST = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.'
BSD2 = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution."
BSD3 = BSD2 + "\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'
APACHE_REST = '\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'
GPL = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
ISC_REST = '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS.'
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
# In the order of licenses.RULES.
NOTICES = [f"{MIT}\n\n{MIT_REST}", MIT, BSD3, BSD2, APACHE + APACHE_REST, APACHE, GPL.format(":", ",", 3), GPL.format(":", ";", 2), GPL.format(";", ";", 3), GPL.format(";", ";", 2), ISC + ISC_REST, ISC, MPL, "This is free and unencumbered software released into the public domain.", "Copyright 2020 A. All rights reserved.", MIT.split("\n\n")[0], BSD2.split("\n\n")[0]]


def test_licence_rules_on_real_notices(spark):
    texts = [*NOTICES, *("# " + x.replace("\n", "\n# ") for x in (MPL, GPL.format(";", ";", 2).split("\n\n")[0]))]
    expected = [spdx for spdx, _ in licenses.RULES] + ["MPL-2.0", "GPL-2.0-or-later"]
    for spdx in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        for tag in (f"{spdx}-only", f"{spdx}-or-later"):
            texts.append(f"// SPDX-License-Identifier: {tag}\ncode"), expected.append(tag)
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), ODD_SCHEMA)).collect()}
    assert [got[k].licenses for k in range(len(texts))] == expected
    for k, (_, ids) in enumerate(licenses.RULES):
        assert "".join(f"<{x}>" for x in ids) in got[k].paragraph_ids


# pipeline


def test_stages_on_odd_rows(spark, odd, empty):
    stages = dict(pytest.importorskip("corpus_pipeline").STAGES)
    of = lambda df: df.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")}).withColumn("n_chars", F.lit(0).cast("long")).withColumn("start", F.lit(1)).withColumn("offset", F.lit("x"))
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect())
    every = sorted(-1 if k is None else k for k, _ in ODD_DOCS)
    for name in ("toxicity", "benchmark_decontamination", "secret_scans"):
        assert ids(stages[name](spark, of(odd), SF)) == every
    # 5 is a copy of 4, whose two equal rows stay together
    assert ids(stages["ngram_jaccard_join"](spark, of(odd), SF)) == [k for k in every if k != 5]
    packed = stages["packing"](spark, of(odd), SF).collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in packed}) == sorted(set(every)) and sum(r.length for r in packed if r.doc_id == 4) == 2 * next(r.doc_tokens for r in packed if r.doc_id == 4)
    for name, stage in stages.items():
        assert stage(spark, of(empty), SF).count() == 0
        if name != "packing":
            assert stage(spark, of(odd), SF).columns == of(odd).columns


def test_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(spark.createDataFrame(docs, ODD_SCHEMA), labels).where("toxic_rejected").collect()}
    kept = [d for d in docs if d[0] not in toxic]
    kept = [d for d, (i, _, comp, _) in zip(sorted(kept), brute_join(sorted(kept), 5, 80)) if i == comp]
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d[0] for d in kept if not any(f" {t} " in f" {words(d[1])} " for t in items)}
    rows = corpus_pipeline.run(spark, SF).collect()
    got = {r.doc_id for r in rows}
    assert got <= clean and len(got) >= len(clean) - 1
    from tokenizers import Tokenizer

    tok, field = Tokenizer.from_file(queries.tokenizer_path()), secrets.trained()
    for d, t in docs:
        if d in got:
            spans = secrets.text_spans(t, field)
            out, at = "", 0
            for a, b, _ in spans:
                if a >= at:
                    out += t[at:a] + "[SECRET]"
                at = max(at, b)
            ids = [*tok.encode(out + t[at:], add_special_tokens=False).ids, 2]
            parts = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
            assert parts == [(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n, _ in parts] and sum(p[1] for p in parts) == len(ids)
