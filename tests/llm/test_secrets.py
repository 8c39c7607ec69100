import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import arrays, secret_crf

FLAGS = re.ASCII | re.IGNORECASE
PATTERNS = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", FLAGS), 2, 8),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    (re.compile(r"[0-9a-f]+"), 0, 32),
]


def brute_base(text):
    return sorted((m.start(), k, m.end()) for k, (p, group, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[group]) >= least)


def odd_texts(seed, n=200):
    pick = random.Random(seed)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "é", "ſecret", " ", "  ", "=", ":", '"', "'", "abcdef0123456789", "AKIA", "ABCD1234EFGH", "x-Y", "\n", "0" * 16, "dead", "short"]
    return ["".join(pick.choice(bits) for _ in range(pick.randint(0, 25))) for _ in range(n)] + ["", None, "token=abctoken=abcdefgh12", "é" * 5000 + "token = abcdefgh1"]


def test_base_spans_and_query_columns(spark):
    texts = odd_texts(1)
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, spans string").repartition(3)
    got = {r.doc_id: r for r in secret_crf.find_secrets(docs, 50).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_base(t)
        joined = ",".join(f"{secret_crf.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert ",".join(":".join(x) for x in spans if x[0] != "crf") == joined
        assert spans == sorted(spans, key=lambda x: (int(x[1]), secret_crf.KINDS.index(x[0])))
    assert secret_crf.find_secrets(docs.limit(0)).count() == 0
    plain = spark.createDataFrame([(1, "nothing"), (None, None)], "doc_id long, text string")
    assert [r.spans for r in secret_crf.find_secrets(plain).collect()] == ["", ""]


def brute_tags(field, score):
    if not len(score):
        return []
    best, back = field.begin + score[0], []
    for s in score[1:]:
        options = best[:, None] + field.move
        back.append(options.argmax(0))
        best = options.max(0) + s
    tags = [int((best + field.end).argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


def test_viterbi_between_sure_tokens_is_exact():
    pick = np.random.default_rng(0)
    texts = [t or "" for t in odd_texts(2, 60)] + ["a b " * 300]
    data, offsets = arrays.buffer(pa.array(texts))
    tokens = secret_crf.Tokens(data, offsets, np.arange(len(texts)))
    for scale in (0.3, 2.0):
        emit = pick.normal(size=(secret_crf.TABLE * secret_crf.TEMPLATES, 3)) * scale
        emit[:, 0] += 0.4
        field = secret_crf.Field(emit, pick.normal(size=(3, 3)), pick.normal(size=3), pick.normal(size=3))
        tags, score = field.tags(tokens), field.scores(tokens)
        for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True):
            assert tags[a:b].tolist() == brute_tags(field, score[a:b])


def test_gradient_is_that_of_the_likelihood():
    import itertools

    pick = np.random.default_rng(3)
    field = secret_crf.Field(None, pick.normal(size=(3, 3)), pick.normal(size=3), pick.normal(size=3))
    score, gold = pick.normal(size=(1, 4, 3)), pick.integers(0, 3, (1, 4))
    emit, move, begin, end = secret_crf._likelihood_gradient(score, gold, np.ones((1, 4), bool), field)
    paths = list(itertools.product(range(3), repeat=4))
    value = [field.begin[p[0]] + field.end[p[-1]] + sum(score[0, k, t] for k, t in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths]
    weight = np.exp(value - np.max(value))
    weight /= weight.sum()
    want = np.zeros((4, 3))
    for p, w in zip(paths, weight, strict=True):
        for k, t in enumerate(p):
            want[k, t] -= w
    want[np.arange(4), gold[0]] += 1
    assert np.allclose(emit[0], want) and np.allclose(begin, want[0]) and np.allclose(end, want[-1])
    assert np.isclose(move.sum(), 0)


def test_field_finds_what_no_pattern_names(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("aeinorst") for _ in range(pick.randint(2, 8)))
    key = lambda n: "".join(pick.choice("0123456789abcdef") for _ in range(n))
    say = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f'{say(20)} token = "{key(40)}" {say(20)}' if i % 2 else say(40)) for i in range(400)]
    field = secret_crf.trained(spark.createDataFrame(rows, "doc_id long, text string"), 200)
    hidden = [(i, f'{say(15)} bearer = "{key(30)}" {say(15)}' if i % 2 else say(30)) for i in range(100)]
    got = {r.doc_id: r for r in secret_crf.scan(spark.createDataFrame(hidden, "doc_id long, text string"), field).collect()}
    assert sum(got[i].n_crf == 1 for i in range(1, 100, 2)) >= 40
    assert sum(got[i].n_crf for i in range(0, 100, 2)) <= 2


def test_masked_training_finds_planted_secrets_of_other_kinds(spark):
    """Keys of four alphabets, too short for the hex pattern, behind five words that no pattern names: precision and recall of exact spans."""
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("aeinorstüé") for _ in range(pick.randint(2, 8)))
    some = lambda letters, n: "".join(pick.choice(letters) for _ in range(n))
    say = lambda n: " ".join(pick.choice([word(), word(), word() + ".", some("0123456789", 16), word() + "@mail.example.com"]) for _ in range(n))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    rows = [(i, f'{say(60)} token = "{some(digits + "abcdef", 40)}" {say(60)}' if i % 3 == 0 else say(90)) for i in range(600)]
    field = secret_crf.trained(spark.createDataFrame(rows, "doc_id long, text string"), 150)
    planted, truth = [], set()
    for i in range(200):
        lead = pick.choice(["bearer = ", "signing_key: ", "credential = ", "auth = ", "passphrase: "])
        before, value = say(30) + " " + lead + '"', some(pick.choice([digits + "abcdef", low + digits, up + digits, low + up + digits + "+/"]), pick.randint(20, 31))
        truth.add((i, f"crf:{len(before)}:{len(before) + len(value)}"))
        planted.append((i, f'{before}{value}" {say(30)}'))
    planted += [(1000 + i, say(60)) for i in range(200)]
    got = {(r.doc_id, x) for r in secret_crf.scan(spark.createDataFrame(planted, "doc_id long, text string"), field).collect() for x in r.spans.split(",") if x.startswith("crf")}
    assert len(got & truth) >= 0.85 * len(truth) and len(got & truth) >= 0.9 * len(got)


def test_training_windows_come_from_texts_of_any_length(spark):
    long = "word and word " * 5000 + 'token = "0123456789abcdef0123456789abcdef" ' + "more words " * 5000
    docs = spark.createDataFrame([(None, long), (None, None), (1, ""), (2, "x y"), *[(3, long + str(i)) for i in range(30)]], "doc_id long, text string").repartition(3)
    rows = secret_crf.windows(docs, 5)
    assert [r.cued for r in rows].count(True) == 5 and [r.cued for r in rows].count(False) == 3
    assert all(len(r.window) <= secret_crf.WINDOW_BYTES and b"token" in r.window for r in rows if r.cued)
    assert secret_crf.windows(docs.limit(0), 5) == []
