"""The registered queries of this subpackage's operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import block_max, collocations, concat_cut, content_sort, cotrain, linmaxmatch, mixing, secret_crf, setsketch, simple8b, suffix_decontam, url_gbt, warc_revisit
from tessera.storage import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_secret_crf(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in all documents: pattern matches and what the field adds."""
    return secret_crf.find_secrets(table(spark, sf, "documents"))


def op2_content_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal documents, white space aside."""
    return content_sort.label(table(spark, sf, "documents"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


def op3_suffix_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    found = suffix_decontam.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at", "longest_item")


def op3_longest_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """The longest verbatim match of each document with a benchmark item, with item and place."""
    return suffix_decontam.longest_verbatim(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


OP3_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS n, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS s FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw CROSS JOIN sizes WHERE len(w) >= n),
hit AS (
  SELECT s.doc_id, s.i, s.n, win.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM spot) s JOIN win USING (n, s)),
marked AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
covered AS (SELECT doc_id, count(*) AS n_hit FROM marked GROUP BY doc_id),
dword AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS x FROM dw),
iword AS (SELECT item_id::VARCHAR AS item, unnest(range(len(w))) AS q, unnest(w) AS x FROM iw),
runs AS (SELECT doc_id, item, p, p - q AS d, p - row_number() OVER (PARTITION BY doc_id, item, p - q ORDER BY p) AS run FROM dword JOIN iword USING (x)),
verbatim AS (SELECT doc_id, item, count(*) AS k, min(p) AS p FROM runs GROUP BY doc_id, item, d, run),
longest AS (SELECT doc_id, k, p, item FROM verbatim QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, p, item) = 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(k, 0) AS longest_match, p AS longest_at, item AS longest_item
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


OP3_VERBATIM_SQL = f"SELECT doc_id, longest_match AS verbatim_words, longest_at AS verbatim_at, longest_item AS verbatim_item FROM ({OP3_SQL})"


def op4_warc_revisits(spark: SparkSession, sf: str) -> DataFrame:
    """Revisits of all pages, resolved as of their time."""
    found = warc_revisit.resolve(warc_revisit.records_of(table(spark, sf, "pages")))
    shown = F.concat_ws(";", F.transform("headers", lambda h: F.concat_ws(":", h["name"], h["value"])))
    seconds = lambda c: F.unix_timestamp(c).alias(c)
    return found.select("record_id", "canonical_url", seconds("ts"), "verdict", "refers_to", seconds("refers_ts"), "status", F.when(F.col("headers").isNotNull(), shown).alias("headers"))


OP4_SQL = r"""
WITH c0 AS (
  SELECT page_id AS n, md5(coalesce(html, '')) AS digest, 1704067200 + page_id * 60 AS fetched, strftime(to_timestamp(1704067200 + page_id * 60) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
c1 AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) AS params FROM c0),
c AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END AS canonical_url FROM c1),
response AS (
  SELECT canonical_url, fetched AS ts, n * 2 AS record_id, CASE WHEN n % 3 <> 0 THEN digest END AS etag, CASE WHEN n % 4 <> 0 THEN day END AS last_modified, digest FROM c WHERE n % 11 <> 0),
revisit AS (
  SELECT canonical_url, fetched + 86400 AS ts, n, n * 2 + 1 AS record_id, CASE WHEN n % 5 = 0 THEN 'other' WHEN n % 3 <> 0 THEN digest END AS etag, CASE WHEN n % 2 = 0 THEN day END AS last_modified,
    CASE WHEN n % 7 <> 0 THEN digest END AS digest FROM c),
best AS (
  SELECT v.record_id, r.record_id AS rid, r.ts AS rts, coalesce(v.etag = r.etag, v.last_modified = r.last_modified, v.digest = r.digest) AS agree, r.digest AS rdigest
  FROM revisit v JOIN response r ON r.canonical_url = v.canonical_url AND r.ts < v.ts
  QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.record_id DESC) = 1),
j AS (
  SELECT v.*, rid, rts, rdigest, CASE WHEN rid IS NULL THEN 'no response' WHEN agree IS NULL THEN 'unverified' WHEN agree THEN 'resolved' ELSE 'changed' END AS verdict FROM revisit v LEFT JOIN best USING (record_id))
SELECT record_id, canonical_url, ts, verdict, CASE WHEN verdict IN ('resolved', 'unverified') THEN rid END AS refers_to, CASE WHEN verdict IN ('resolved', 'unverified') THEN rts END AS refers_ts,
  CASE WHEN verdict IN ('resolved', 'unverified') THEN 200 END AS status,
  CASE WHEN verdict IN ('resolved', 'unverified') THEN 'Content-Type:text/html;ETag:' || rdigest || ';Expires:' || n || ';date:later' END AS headers
FROM j
"""


def op5_simple8b(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of all documents, written in Simple-8b files and read back."""
    docs = table(spark, sf, "documents")
    return simple8b.read_ids(simple8b.write_ids(docs, public_tokenizers.path("word_bpe_49k.json")))


def op6_longest_match(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy longest-match token counts of all documents."""
    return linmaxmatch.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_cotraining(spark: SparkSession, sf: str) -> DataFrame:
    """Quality scores of all documents."""
    return cotrain.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op8_concat_cut(spark: SparkSession, sf: str) -> DataFrame:
    """All documents' token ids in windows of 2048."""
    return concat_cut.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_setsketch(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of near-duplicate documents on shingles of four words."""
    return setsketch.near_duplicates(table(spark, sf, "documents"), shingle=4, alike=80)


OP9_SQL = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 3, 1) + 1)])) AS s FROM dw WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sizes UNION SELECT reach.node, edge.b FROM reach JOIN edge ON reach.seen = edge.a)
SELECT dw.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, dw.doc_id) AS component_id, coalesce(c, dw.doc_id) = dw.doc_id AS kept
FROM dw LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) r ON r.node = dw.doc_id
"""

#: The rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op10_url_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return url_gbt.judge(table(spark, sf, "pages"), URL_RULES)


def op11_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How many words a mix of all sources by weight takes of each document."""
    return mixing.taken(table(spark, sf, "documents"))


def op12_block_max(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 best documents for each benchmark item."""
    return block_max.search(block_max.build(table(spark, sf, "documents")), table(spark, sf, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP12_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}') AS w FROM documents),
stat AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM dw WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM dw) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN df USING (term) CROSS JOIN stat GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The first 2000 phrases of each language, of all documents."""
    return collocations.mine(table(spark, sf, "documents"))


OP13_SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
gram AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w CROSS JOIN (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, lang || chr(9) || phrase AS id, count(*) AS f FROM gram GROUP BY ALL),
cand AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
way AS (
  SELECT lang, size, phrase, a, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM cand UNION ALL
  SELECT lang, size, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM cand WHERE size = 3),
cuts AS (
  SELECT way.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM way JOIN f x ON x.id = way.lang || chr(9) || lp JOIN f y ON y.id = way.lang || chr(9) || rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (
  SELECT lang, p, max(a) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS p, a FROM cand WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN part ON part.lang = best.lang AND part.p = best.phrase WHERE most IS NULL OR size = 3 OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


QUERIES = {
    "op1_secret_crf": op1_secret_crf,
    "op2_content_sort": op2_content_sort,
    "op3_suffix_decontamination": op3_suffix_decontamination,
    "op3_longest_verbatim": op3_longest_verbatim,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_simple8b": op5_simple8b,
    "op6_longest_match": op6_longest_match,
    "op7_cotraining": op7_cotraining,
    "op8_concat_cut": op8_concat_cut,
    "op9_setsketch": op9_setsketch,
    "op10_url_trees": op10_url_trees,
    "op11_mixing": op11_mixing,
    "op12_block_max": op12_block_max,
    "op13_collocations": op13_collocations,
}
ORACLE = {"op2_content_sort": OP2_SQL, "op3_suffix_decontamination": OP3_SQL, "op3_longest_verbatim": OP3_VERBATIM_SQL, "op4_warc_revisits": OP4_SQL, "op9_setsketch": OP9_SQL, "op12_block_max": OP12_SQL, "op13_collocations": OP13_SQL}
