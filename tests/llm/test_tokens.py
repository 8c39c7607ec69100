import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, concat_cut, linmaxmatch, simple8b

TRICKY = [*"aZé9' \n\t.,!sStTmdrevlß½²", "'s", "'re", "'LL", " '", "  ", "İ", "中", "<|endoftext|>", "\xa0", "ſ", "é"]


def odd_texts(n=300, seed=5):
    pick = random.Random(seed)
    return ["".join(pick.choice(TRICKY) for _ in range(pick.randint(0, 30))) for _ in range(n)] + ["", None, "   ", "a " * 5000]


def brute(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_library(name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    texts = odd_texts()
    flat, count = bpe.Pieces(public_tokenizers.path(name)).encode(pa.array(texts, pa.string()), 1)
    want = [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert count.tolist() == [len(x) for x in want]
    assert flat.tolist() == [i for x in want for i in x]


def test_simple8b_words_round_trip():
    pick = np.random.default_rng(1)
    for n in (0, 1, 59, 1024, 1025, 5000):
        for top in (1, 2, 300, 50_000, 1 << 31, 1 << 59):
            ids = pick.integers(0, top, n).astype(np.uint64)
            words, at = simple8b.pack_words(ids)
            assert simple8b.unpack_words(words, at, n).tolist() == ids.tolist()
    words, _ = simple8b.pack_words(np.zeros(600, np.uint64))
    assert len(words) == 10


def test_simple8b_file(spark):
    texts = odd_texts(60)
    rows = [(i * 3 % 64, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, ids int").repartition(3)
    got = {r.doc_id: r for r in simple8b.read_ids(simple8b.write_ids(docs, public_tokenizers.path("word_bpe_49k.json")), True).collect()}
    start = 0
    for doc_id, text, *_ in sorted(rows):
        want = brute("word_bpe_49k.json", text)
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids) == (start, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert simple8b.read_ids(simple8b.write_ids(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_pack(spark):
    texts = odd_texts(60)
    docs = spark.createDataFrame([(i, t, 2) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(3)
    pieces = concat_cut.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 64, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in enumerate(texts):
        mine = sorted(by_doc[i], key=lambda p: p.start)
        assert [x for p in mine for x in p.ids] == brute("byte_bpe_50k.json", t)
        assert all(p.doc_tokens == sum(q.length for q in mine) for p in mine)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, mine in by_sequence.items():
        at = 0
        for p in sorted(mine, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or s == len(by_sequence) - 1
    assert concat_cut.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def greedy(word, vocabulary):
    n, longest = 0, max(map(len, vocabulary))
    while word:
        k = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in vocabulary)
        word, n = word[k:], n + 1
    return n


def test_longest_match_counts(spark):
    import re

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = set(linmaxmatch.read_vocabulary(path))
    texts = odd_texts(80) + ["Supercalifragilistic   unbelievable\n" * 3, "z" * 3000, "ÉCOLE École"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    for r in linmaxmatch.token_counts(docs, path).collect():
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        words = re.findall("[^\x20\x09-\x0d]+", lowered)
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w.encode(), vocabulary) for w in words))
    assert linmaxmatch.token_counts(docs.limit(0), path).count() == 0


def test_automaton_against_greedy_on_random_vocabularies():
    pick = random.Random(8)
    for _ in range(30):
        vocabulary = [bytes([b]) for b in range(256)] + [bytes(pick.choice(b" abc") for _ in range(pick.randint(2, 6))) for _ in range(pick.randint(0, 25))]
        words = [bytes(pick.choice(b"abc") for _ in range(pick.randint(1, 14))) for _ in range(60)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        got = linmaxmatch.Automaton(vocabulary).counts(data, ends - [len(w) for w in words], ends)
        assert got.tolist() == [greedy(b" " + w, set(vocabulary)) for w in words]


def test_long_words_alone_and_side_by_side_count_alike():
    """A word of megabytes takes seconds at most, and both ways agree around the length at which they change."""
    import time

    machine = linmaxmatch.automaton(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pick = np.random.default_rng(4)
    words = [bytes(pick.choice(np.frombuffer(b"etaoinshrdlu-_0123\xc3\xa9", np.uint8), n)) for n in (1, 2, 50, linmaxmatch.LONG - 1, linmaxmatch.LONG, linmaxmatch.LONG + 1, 5000)] + [b"a" * 4000, "é".encode() * 3000]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    assert machine.counts(data, starts, ends).tolist() == machine._together(data, starts, ends).tolist() == [machine._walk(w) for w in words]
    began = time.perf_counter()
    long = np.frombuffer(b"the-quick-brown-fox" * 100_000, np.uint8)
    assert machine.counts(long, np.array([0]), np.array([len(long)]))[0] > 100_000
    assert time.perf_counter() - began < 8
