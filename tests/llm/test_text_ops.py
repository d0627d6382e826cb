"""Tokenizer, language ID, token counts and near-duplicates against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tesserae.llm import bpe, langid, neardup, shards, token_counts

from ..conftest import SMALL

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, score double, token_ids string"
ODD = [None, "", " ", "\n\t ", "a", "é", "漢字 😀", "<|endoftext|>", "it's  <|endoftext|>we'll\r\n", "123 ½ Ⅷ !!!", "x" * 3000, "a b " * 5000]


def odd_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, 0.5, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "no id", None, "s", None, None), (1, "", "en", None, 0.5, "x"), (None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_bpe_equals_the_library(library):
    codec = bpe.codec(BPE)
    rnd = random.Random(5)
    signs = "aaabcde  \n\t'sdreTHE<|>éßñ漢字😀　\xa0\x1c\x85012½²Ⅷ!?.,-_"
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(300)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False), t
    some = [rnd.randrange(50257) for _ in range(500)]
    assert codec.decode(some) == library.decode(some, skip_special_tokens=False)


def test_gadgets_by_hand():
    # a b c; ab, then aba never forms from ab+a before b+a; aa shows that the left pair goes first
    labels = {0: b"a", 1: b"b", 2: b"ab", 3: b"aa", 4: b"abab"}
    m = bpe.MergeAutomaton(labels, [(0, 1, 2), (0, 0, 3), (2, 2, 4)])

    def merged(word):
        seq = [{97: 0, 98: 1}[c] for c in word]
        for u, v, w in [(0, 1, 2), (0, 0, 3), (2, 2, 4)]:
            out, i = [], 0
            while i < len(seq):
                if seq[i : i + 2] == [u, v]:
                    out.append(w)
                    i += 2
                else:
                    out.append(seq[i])
                    i += 1
            seq = out
        return seq

    rnd = random.Random(1)
    for _ in range(500):
        word = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 12)))
        assert m.encode(word) == merged(word), word


def test_bpe_frames(spark, library):
    docs = odd_docs(spark)
    got = bpe.digests(docs, BPE).collect()
    assert len(got) == docs.count()
    for r, d in zip(got, docs.collect(), strict=True):
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
    # a column that has the name of a new one is replaced, the others stay
    full = bpe.encoded(docs, BPE)
    assert full.columns == ["doc_id", "text", "lang", "source", "score", "token_ids", "n_tokens"]
    assert all(r.decoded == (r.text or "") for r in bpe.decoded(full, BPE).collect())
    assert bpe.digests(docs.limit(0), BPE).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "▁", "▁a", "ba"]
    lattice = langid.Lattice(pieces)
    prob = np.vstack([np.random.default_rng(0).random((len(pieces) + 1, 2)), np.zeros((1, 2))])

    def brute(word, k):
        word = "▁" + word
        return 1.0 if word == "▁" * 0 else _sum(word, prob[:, k], pieces)

    words = ["a", "ab", "abab", "abba", "xab", "a" * 17, "abxba", "b" * 11]
    want = [[math.log(brute(w, k)) for k in (0, 1)] for w in words]
    assert np.allclose(langid.forward(lattice, prob, words), want)
    long = langid.forward(lattice, prob / 10, ["ab" * 3000])  # far below the least double
    assert np.isfinite(long).all() and (long < -3000).all()


def _sum(word, p, pieces):
    up = [1.0]
    for i in range(1, len(word) + 1):
        up.append(sum(up[j] * (p[pieces.index(word[j:i])] if word[j:i] in pieces else p[len(pieces)] if j == i - 1 else 0) for j in range(i)))
    return up[-1]


def test_expected_counts_are_those_of_all_segmentations():
    pieces = ["a", "b", "ab", "▁", "ba"]
    lattice = langid.Lattice(pieces)
    p = np.append(np.random.default_rng(1).random(len(pieces) + 1), 0)
    want = np.zeros(len(pieces) + 1)

    def walk(word, at, used, prob):
        if at == len(word):
            for u in used:
                want[u] += 3 * prob / total
            return
        for end in range(at + 1, len(word) + 1):
            piece = word[at:end]
            if piece in pieces or end == at + 1:
                i = pieces.index(piece) if piece in pieces else len(pieces)
                walk(word, end, [*used, i], prob * p[i])

    for w in ("abba", "xab"):
        total = _sum("▁" + w, p, pieces)
        walk("▁" + w, 0, [], 1.0)
    assert np.allclose(langid.expected(lattice, p, ["abba", "xab"], [3, 3]), want)


def test_long_words_and_pieces_count():
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=PIECES)
    every = {p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
    have = set(langid.pieces(PIECES))
    assert every == have
    toy = ["a", "b", "ab", "▁", "ba", "abababababababab"]
    lattice = langid.Lattice(toy)
    prob = np.append(np.random.default_rng(1).random(len(toy) + 1), 0) / 10
    lengths = np.array([*map(len, toy), 1])
    for word in ("ab" * 25, "ab" * 70, "ax" * 60, "ab" * 3000):  # the pieces of each segmentation make up the word
        got = langid.expected(lattice, prob, [word, "abba"], [3, 2])
        assert np.isclose(got @ lengths, 3 * (len(word) + 1) + 2 * 5)
    word = "ab" * 70  # the derivative of the log-probability by that of a piece is its expected count
    for i in range(len(toy)):
        up, down = prob.copy(), prob.copy()
        up[i] *= 1 + 1e-5
        down[i] *= 1 - 1e-5
        (hi,), (lo,) = (langid.forward(lattice, x[:, None], [word])[0] for x in (up, down))
        assert np.isclose(langid.expected(lattice, prob, [word], [1])[i], (hi - lo) / 2e-5, rtol=1e-4, atol=1e-4)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identified(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    model = langid.fit(docs, PIECES)
    assert model[0] == ["en"]
    got = langid.predicted(docs, PIECES, model).collect()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if letters else "und") and (r.score == 1 if letters else r.score == 0)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identified(unlabelled, PIECES).collect()} == {"und"}
    assert langid.identified(docs.limit(0), PIECES).count() == 0


def test_token_counts_against_brute_force(spark):
    u = token_counts.model(PIECES)
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=PIECES)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    lp = {x: float(u.logp[i]) for i, x in enumerate(pieces)}

    def brute(word):
        word = "▁" + word
        up, best = [0.0], [(0.0, 0)]
        for i in range(1, len(word) + 1):
            ways = [(j, lp.get(word[j:i], float(u.logp[-2]) if j == i - 1 else None)) for j in range(max(0, i - 16), i)]
            ways = [(j, x) for j, x in ways if x is not None]
            top = max(up[j] + x for j, x in ways)
            up.append(top + math.log(sum(math.exp(up[j] + x - top) for j, x in ways)))
            best.append(max((best[j][0] + x, best[j][1] - 1) for j, x in ways))
        return -best[-1][1], up[-1]

    docs = odd_docs(spark)
    got = token_counts.counted(docs, PIECES).collect()
    for r, d in zip(got, docs.collect(), strict=True):
        ws = (d.text or "").split()
        each = {w: brute(w) for w in set(ws)}
        assert (r.doc_id, r.n_pretokens, r.n_tokens) == (d.doc_id, len(ws), sum(each[w][0] for w in ws))
        assert r.log_prob == pytest.approx(sum(each[w][1] for w in ws))
    assert token_counts.counted(docs.limit(0), PIECES).count() == 0


def brute_groups(rows, percent=85):
    def shingles(t):
        w = [x for x in (t or "").encode().lower().split()]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return [(d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True)]


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 7, 8, 40, 120, 400]))]
        for _ in range(rnd.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((n, " ".join(copy).upper() if rnd.random() < 0.1 else " \n".join(copy)))
            n += 1
    rnd.shuffle(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, rows[0][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    got = sorted(map(tuple, neardup.grouped(docs).collect()))
    assert got == sorted(brute_groups(rows))
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in got if r[3])


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(60):
        copy = list(base)
        for _ in range(rnd.choice([1, 2, 3, 6])):
            copy[rnd.randrange(150)] = f"v{rnd.randrange(9999)}"
        rows.append((n, " ".join(copy)))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "MOST", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.grouped(docs).collect())) == sorted(brute_groups(rows))


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e  f"), (3, "x"), (3, "x"), (None, "x"), (4, None), (None, None), (3, "other text")], "doc_id long, text string")
    got = sorted(map(tuple, neardup.grouped(docs).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (None, 2, None, True), (3, 1, 3, True), (3, 1, 3, True), (None, 1, 3, False), (4, 0, 4, True), (None, 0, None, True), (3, 1, 3, True)], key=repr)
    assert neardup.grouped(docs.limit(0)).count() == 0 and neardup.deduplicated(docs.limit(0)).count() == 0
    assert neardup.deduplicated(docs.filter("doc_id = 3")).count() == 1


def test_a_doc_id_over_several_texts_is_one_node(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    rows = [(0, b), (1, a), (1, b), (2, a), (1, None), (7, "x y z")]
    got = sorted(map(tuple, neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(0, 3, 0, True), (1, 3, 0, False), (1, 3, 0, False), (2, 3, 0, False), (1, 0, 1, True), (7, 1, 7, True)])
    rows = [(1, a), (1, a), (2, b), (None, "u v w"), (None, "U v w"), (None, "q"), (None, None), (None, None), (3, ""), (3, ""), (4, None), (4, "one two")]
    left = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in left), key=repr) == [1, 2, 3, 4, None, None, None, None]
    assert [r.text for r in left if r.doc_id == 4] == ["one two"] and sum(r.doc_id is None and r.text is None for r in left) == 2


def test_signatures_by_the_definition():
    rnd = np.random.default_rng(2)

    def plain(elements, m):
        sig = [2**64 - 1] * m
        for x in elements:
            perm = list(range(m))
            for level in range(m):
                r = int(neardup._mix(np.array([int(x) ^ ((level + 1) * 0x2545F4914F6CDD1D & (2**64 - 1))], np.uint64))[0])
                k = level + (((r >> 32) * (m - level)) >> 32)
                perm[level], perm[k] = perm[k], perm[level]
                sig[perm[level]] = min(sig[perm[level]], level << 32 | (r & 0xFFFFFFFF))
        return sig

    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 9, 60)] + [np.zeros(0, np.uint64)]
    got = neardup.signatures(sets, 24)
    for s, g in zip(sets, got.tolist(), strict=True):
        assert g == plain(s, 24)


def test_shingles_of_a_long_text_in_pieces(monkeypatch):
    text = " ".join(f"word{i % 97}é" for i in range(2000))
    whole = neardup.shingles(text)
    monkeypatch.setattr(neardup, "PIECE", 101)
    assert (neardup.shingles(text) == whole).all()


def test_shards(spark):
    docs = odd_docs(spark).unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("score", "double"), ("token_ids", "string"))]))
    got = shards.sharded(docs, [1.0] * 8).collect()
    assert len(got) == docs.count()
    of = {}
    for r in got:
        assert of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert 300 < sum(r.shard == s for r in got) < 460
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect()}
    import struct

    import xxhash

    for r in got[:200]:  # the law by hand: the key's flag for null, the key, the shard, each hashed with the last hash as seed
        if r.doc_id is not None:
            scores = []
            for s in range(8):
                h = xxhash.xxh64_intdigest(struct.pack("<i", 0), seed=42)
                h = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), seed=h)
                h = xxhash.xxh64_intdigest(struct.pack("<i", s), seed=h)
                scores.append(1 / -math.log(((h >> 12) + 0.5) / 2**52))
            assert r.shard == scores.index(max(scores))
    weighted = [r.shard for r in shards.sharded(docs, [1.0, 3.0]).collect()]
    assert 0.7 < sum(weighted) / len(weighted) < 0.8
    assert shards.sharded(docs.limit(0), [1.0]).count() == 0
