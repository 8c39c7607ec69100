"""Repeated rows, null and repeated identifiers, ties and very long words, for the operators that other tests don't ask about them."""

import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import concat_cut, linmaxmatch, secret_crf, simple8b, url_gbt, warc_revisit

from .test_revisits import SCHEMA
from .test_revisits import brute as brute_revisits

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_secrets_of_repeated_rows_and_a_word_of_a_megabyte(spark):
    long = "z" * 1_000_000 + " password=abcd1234EFGH " + "0123456789abcdef" * 60_000
    rows = [(1, "token: abcdefgh12345678")] * 3 + [(None, "AKIA" + "A" * 12), (1, None), (2, long), (2, "nothing here")]
    got = sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex) for r in secret_crf.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 1, 0, 0)] * 3 + [(0, 0, 1, 0), (1, 0, 0, 0), (2, 1, 0, 1), (2, 0, 0, 0)])


def test_revisits_that_are_alike_or_have_no_url(spark):
    start = datetime(2024, 1, 1)
    row = lambda i, url, minutes, kind, status=200: (i, url, None if minutes is None else start + timedelta(minutes=minutes), kind, status, "1", None, "d", [("ETag", "1")], "x", 1)
    rows = [row(1, "a.org", 0, "response"), row(1, "a.org", 0, "response"), row(2, "a.org", 0, "response"), *[row(3, "a.org", 5, "revisit")] * 2, *[row(4 + i, None, i, "revisit") for i in range(40)], *[row(50 + i, "a.org", None, "revisit") for i in range(40)], row(99, "a.org", 0, "revisit")]
    got = warc_revisit.resolve(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    have = sorted(((r.record_id, r.verdict, r.refers_to, None if r.headers is None else [tuple(h) for h in r.headers]) for r in got), key=repr)
    assert have == sorted(brute_revisits(rows), key=repr) and sum(h[1] == "no response" for h in have) == 81


def test_token_files_of_repeated_and_null_identifiers(spark):
    rows = [(None, "b c"), (7, "x y"), (None, "a"), (7, "x y"), (7, None), (3, ""), (7, "word " * 9000)]
    tokenizer = Tokenizer.from_file(WORDS)
    got = simple8b.read_ids(simple8b.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS)).collect()
    encoded = sorted(((i is not None, i or 0, t or ""), tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((k[0], k[1], len(ids), crc(ids)) for k, ids in encoded)
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    starts = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert starts == [None, None, 3, 7, 7, 7, 7]


def test_packing_of_repeated_and_null_identifiers(spark):
    rows = [(None, "b c"), (7, "x y"), (7, "x y"), (None, None), (7, "some words " * 3000)]
    tokenizer = Tokenizer.from_file(BYTES)
    pieces = concat_cut.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BYTES, with_ids=True).collect()
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    placed = sorted((p.sequence_id * 2048 + p.offset, p.length) for p in pieces)
    assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False)) and sum(n for _, n in placed) == total
    by = {}
    for p in sorted(pieces, key=lambda p: p.sequence_id * 2048 + p.offset):
        if p.start == 0:
            by.setdefault(p.doc_id, []).append([])
        by[p.doc_id][-1] += p.ids
    for i in (None, 7):
        assert sorted(by[i]) == sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in rows if k == i)


def test_counts_of_repeated_rows_and_long_words(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(1, "the cat"), (1, "the cat"), (None, "the cat"), (None, None), (2, "é" * 400_000), (3, "the-cat" * 150_000)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_tokens) for r in linmaxmatch.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect())
    machine = linmaxmatch.automaton(path)
    want = []
    for i, t in rows:
        words = (t or "").lower().encode().split()
        want.append((i is None, i or 0, len(words), sum(machine._walk(w) for w in words)))
    assert got == sorted(want)


def test_urls_alike_have_verdicts_alike(spark):
    pick = random.Random(2)
    rows = [(i % 90, f"http://{pick.choice('abc')}{i % 30}.{pick.choice(['org', 'com/fr', 'com/de', 'net', 'com/en'])}/{i % 7}") for i in range(600)]
    got = url_gbt.judge(spark.createDataFrame(rows + rows[:100], "page_id long, url string"), [("allow", "org/"), ("allow", "com/fr/"), ("block", "com/de/")]).collect()
    assert len(got) == 700
    said, scores = {}, {}
    for r in got:
        said.setdefault((r.host, r.path), set()).add((r.verdict, r.score))
        if r.rule is None:
            scores.setdefault(r.score, set()).add(r.verdict)
    assert all(len(x) == 1 for x in said.values()) and all(len(x) == 1 for x in scores.values())
    again = url_gbt.judge(spark.createDataFrame(rows + rows[:100], "page_id long, url string"), [("allow", "org/"), ("allow", "com/fr/"), ("block", "com/de/")]).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
