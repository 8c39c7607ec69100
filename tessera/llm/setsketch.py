"""Near-duplicate documents with SetSketch registers.

A sketch has ``REGISTERS`` registers.  A register takes the least exponential variable over a
set's shingles and keeps its exponent to the base ``BASE``, so registers of a union are the
maxima of the parts' registers and the registers of similar sets tend to be equal.

1.  Every text becomes a set of shingle keys, the set's size and fingerprint, and a sketch.  Equal
    sets are one class from here on, with the smallest doc_id as its name; copies are counted
    before the shuffle and never compared.
2.  Bands of ``ROWS`` registers deal classes into buckets.  Within a bucket each class is linked to
    the smallest only, so a bucket of n classes makes n - 1 links however large it is.  Components
    of these links are families: all that share buckets, closely alike or not.
3.  A family of up to ``BLOCK_CLASSES`` classes is read again with its texts.  Each
    pair's similarity is estimated from both sketches jointly, by likelihood; pairs whose estimate
    comes within ``SLACK`` standard errors of the threshold are confirmed or refused on full sets.
4.  In a larger family (a common header makes one of texts that are not alike) no text meets all others.  First
    each class is confirmed against the smallest class that shares a bucket with it, which joins the copies of one text.
    Then shingles are ordered by how many of the family's classes have them, and of each class the rarest are taken, so many
 that two sets as alike as asked share one of theirs (the prefix filter, which is exact).  Classes that share such a shingle and
    are not joined yet meet in blocks, where their pairs are confirmed as in step 3.  A shingle
    of a common header is among no class's rarest, so such a family costs work in proportion to its size.
5.  Components of the confirmed links are the near-duplicate groups.

Bands miss a pair of similarity 0.8 with a chance of about (1 - 0.8^ROWS)^BANDS = 3e-6.  The
rest is exact: full sets hold 64-bit keys of whole shingles.

Defined results: null and empty texts and texts without words have the empty set and link to
nothing; fewer words than a shingle give one shingle of all of them; repeated rows are members of
one class, and stay or go together; rows of one doc_id with different texts are told apart; a null doc_id goes with rows of the same set only, as a copy where another
has an identifier; doc_id is of an integer type, others are an error; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrays
from tessera.llm.components import components
from tessera.storage import written

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE = 1.001
RATE = 20.0
LARGEST = 65_534
SLACK = 5.0
#: A family or block has about this many classes and bytes of text at most.
BLOCK_CLASSES, BLOCK_BYTES = 1024, 8 << 20

_MULTIPLY = arrays.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_FLIP = arrays.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_PLACE = arrays.mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle keys of every text, one after the other, and how many each has."""
    data, offsets = arrays.buffer(column)
    _, keys, count = arrays.words(arrays.lower(data), offsets, arrays.SOLID)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.cumsum(count) - count
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    width = np.repeat(np.minimum(count, size), n)
    padded = np.concatenate([keys, np.zeros(size, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += np.where(width > k, padded[at + k], np.uint64(0)) * _PLACE[k]
    shingles = arrays.mix(total + width.astype(np.uint64))
    sets, sizes, begin = [], np.zeros(len(n), np.int64), 0
    for i, k in enumerate(n.tolist()):
        if k:
            own = np.sort(shingles[begin : begin + k])
            own = own[np.append(True, own[1:] != own[:-1])] if k > 1 else own
            sets.append(own)
            sizes[i] = len(own)
            begin += k
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def sketches(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of registers for every set; sets without keys have zeros."""
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), REGISTERS), np.uint16)
    if not len(full):
        return out
    begin = (np.cumsum(sizes) - sizes)[full]
    least = np.empty((REGISTERS, len(full)), np.uint64)
    for low in range(0, len(full), 64):  # few sets at a time stay in the cache
        rows = slice(low, min(low + 64, len(full)))
        a, b = begin[low], begin[low] + sizes[full[rows]].sum()
        own, at = keys[a:b], begin[rows] - a
        for i in range(REGISTERS):
            least[i, rows] = np.minimum.reduceat((own ^ _FLIP[i]) * _MULTIPLY[i], at)
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-uniform) / RATE
    out[full] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LARGEST + 1).astype(np.uint16)
    return out


def _likelihood(j: np.ndarray, above: np.ndarray, equal: np.ndarray, below: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarity j, given in how many registers the first set's value is larger, equal, smaller."""
    v, ratio = 1 - u, (BASE - 1) / BASE

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * ratio) / np.log(BASE)

    def safe(x):
        return np.log(np.maximum(x, 1e-12))

    up, down = chance(u - v * j), chance(v - u * j)
    return above * safe(up) + below * safe(down) + equal * safe(1 - up - down)


def estimate(above: np.ndarray, equal: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of largest likelihood for sets of n and m keys."""
    u = n / (n + m)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(24):  # the logarithm of the likelihood is concave
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = _likelihood(a, above, equal, below, u) > _likelihood(b, above, equal, below, u)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def reaches(least: float, above: np.ndarray, equal: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the estimate is ``least`` or more: the concave likelihood doesn't fall there yet."""
    u = n / (n + m)
    return _likelihood(least + 1e-6, above, equal, below, u) >= _likelihood(least - 1e-6, above, equal, below, u)


def prints(keys: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set, which tell sets apart."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (keys, arrays.mix(keys ^ np.uint64(0x5851F42D4C957F2D)))]
    return [(s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums]


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, print_a, print_b, sketch) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            keys, sizes = shingle_sets(batch.column("text"), shingle)
            registers = sketches(keys, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes), *map(pa.array, prints(keys, sizes)), pa.array([r.tobytes() for r in registers], pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "print_a", "print_b", "sketch"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, print_a long, print_b long, sketch binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): a row for every class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
                keys = arrays.mix((registers * _PLACE[:ROWS]).sum(2, dtype=np.uint64) + _FLIP[:BANDS]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("rep").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], ["key", "rep"])

    return classes.select(F.col("node").alias("rep"), "sketch").mapInArrow(run, f"key long, rep {classes.schema['node'].dataType.simpleString()}")


def bucket_links(classes: DataFrame) -> DataFrame:
    """(u, v): each class with the smallest of each bucket that it is in."""
    bands = band_keys(classes)
    # written, so that Spark can split the join where a bucket is very large
    least = written(bands.groupBy("key").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "buckets")
    return bands.join(least, "key").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()


def _confirmed(reps: np.ndarray, side: np.ndarray, label: np.ndarray, keys: np.ndarray, sizes: np.ndarray, registers: np.ndarray, alike: int) -> list[tuple[int, int]]:
    """Links within a block, or between the sides of a pair of blocks: a spanning forest of them; classes of one label are joined already."""
    n = len(reps)
    owner = np.repeat(np.arange(n), sizes)
    # only keys that two sets share matter for what they have in common
    _, code, often = np.unique(keys, return_inverse=True, return_counts=True)
    common = often[code] > 1
    code, owner = code[common], owner[common]
    most = np.bincount(owner, minlength=n)
    hopeful = np.flatnonzero(100 * most >= alike * sizes)  # else too few of its keys are in any other set
    hopeful = hopeful[np.argsort(sizes[hopeful], kind="stable")]
    ordered = sizes[hopeful]
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    parent = first[of].tolist()

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bounds = np.searchsorted(owner, np.arange(n + 1))
    mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    least = alike / 100 - SLACK * np.sqrt(alike / 100 * (1 - alike / 100) / REGISTERS)
    links = []
    for place, i in enumerate(hopeful.tolist()):
        # larger sets, up to the size at which the smaller set is too small a part
        end = np.searchsorted(ordered, sizes[i] * 100 // alike, "right")
        others = hopeful[place + 1 : end]
        others = others[(label[others] != label[i]) & ((side[i] < 0) | (side[others] != side[i]))]
        if not len(others):
            continue
        mine, theirs = registers[i], registers[others]
        equal, above = (theirs == mine).sum(1), (theirs < mine).sum(1)
        near = reaches(least, above, equal, REGISTERS - equal - above, np.full(len(others), sizes[i]), sizes[others])
        own = code[bounds[i] : bounds[i + 1]]
        mark[own] = True
        for j in others[near].tolist():
            a, b = root(i), root(j)
            if a != b:
                both = int(np.count_nonzero(mark[code[bounds[j] : bounds[j + 1]]]))
                if 100 * both >= alike * (int(sizes[i]) + int(sizes[j]) - both):
                    links.append((reps[i], reps[j]))
                    parent[a] = b
        mark[own] = False
    return links


def confirmed_links(members: DataFrame, shingle: int, alike: int) -> DataFrame:
    """(u, v): links that hold on full sets, within blocks of bounded size.

    members: family, block, rep, side (-1: all pairs count, else those of different sides), label (equal ones are joined), text, sketch, print_a.
    Of the texts of a class, those that aren't its own are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by family and block; the last group of a slice may go on in the next
        group, waiting = None, []

        def flush():
            if sum(len(w[0]) for w in waiting) < 2:
                return None
            links = _confirmed(*(np.concatenate(x) for x in zip(*waiting, strict=True)), alike)
            u, v = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in arrays.slices(batches):
            family, block, reps, side, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("family", "block", "rep", "side", "label"))
            keys, sizes = shingle_sets(batch.column("text"), shingle)
            own = prints(keys, sizes)[0] == batch.column("print_a").to_numpy(zero_copy_only=False)
            if not own.all():  # an identifier with several texts: the class has one of them
                batch, keys, sizes = batch.filter(pa.array(own)), keys[np.repeat(own, sizes)], sizes[own]
                family, block, reps, side, label = (x[own] for x in (family, block, reps, side, label))
            if not len(sizes):
                continue
            registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cuts = (np.flatnonzero((family[1:] != family[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if group != (family[low], block[low]):
                    if out := flush():
                        yield out
                    group = (family[low], block[low])
                    waiting.clear()
                waiting.append((reps[low:high], side[low:high], label[low:high], keys[ends[low] : ends[high]], sizes[low:high], registers[low:high]))
        if out := flush():
            yield out

    ordered = members.select("family", "block", "rep", "side", "label", "text", "sketch", "print_a").repartition("family", "block").sortWithinPartitions("family", "block")
    return ordered.mapInArrow(run, "u long, v long")


def _parts(classes: Column, shingles: Column) -> Column:
    """Into how many blocks so many classes with so many shingles go."""
    return F.ceil(F.greatest(classes / BLOCK_CLASSES, shingles * 7 / BLOCK_BYTES)).cast("int")


def star_blocks(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(family, block, rep, side, label): blocks in which the pairs (u, v) meet, all of v's in blocks of bounded size, each with v itself.

    sizes: node, n_shingles.
    """
    weighed = pairs.join(sizes.withColumnRenamed("node", "u"), "u")
    parts = weighed.groupBy("v").agg(_parts(F.count(F.lit(1)), F.sum("n_shingles")).alias("parts"))
    part = F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")
    others = pairs.join(parts, "v").select(F.col("v").alias("family"), part.alias("block"), F.col("u").alias("rep"), F.lit(1).alias("side"), F.col("u").alias("label"))
    centres = parts.select(F.col("v").alias("family"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.col("v").alias("rep"), F.lit(0).alias("side"), F.col("v").alias("label"))
    return others.unionByName(centres)


def rare_shingles(held: DataFrame, shingle: int, alike: int) -> DataFrame:
    """(family, key, node): of each class its rarest shingles, as many as the prefix filter needs, but for those that no other class of the family has.

    held: family, node, print_a, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.slices(batches):
            keys, sizes = shingle_sets(batch.column("text"), shingle)
            own = prints(keys, sizes)[0] == batch.column("print_a").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.view(np.int64)))
            whole = pa.RecordBatch.from_arrays([batch.column("family"), batch.column("node"), sets], ["family", "node", "keys"])
            yield whole.filter(pa.array(own))

    kind = held.schema["node"].dataType.simpleString()
    # an identifier that repeats with its text is one class
    sets = written(held.mapInArrow(run, f"family {kind}, node {kind}, keys array<long>").dropDuplicates(["node"]), "sets")
    single = sets.select("family", "node", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    often = single.groupBy("family", "key").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ordered = single.join(often, ["family", "key"]).groupBy("family", "node", "n").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("shared"))
    # a set of n shingles shares ceil(alike n / 100) with any that is as alike; its single shingles come first, and no other set has them
    need = F.col("n") - F.ceil(F.col("n") * alike / 100).cast("int") + 1 - (F.col("n") - F.size("shared"))
    return ordered.where(need > 0).select("family", "node", F.explode(F.slice("shared", 1, need)).alias("s")).select("family", "s.key", "node")


def shingle_blocks(postings: DataFrame) -> DataFrame:
    """(family, block, rep, side, label): blocks of classes that share a shingle, where these have several labels.

    Those of the shingle's commonest label, which are joined already, meet the others only; the others meet each other too.
    postings: family, key, node, label.
    """
    of = postings.groupBy("family", "key", "label").agg(F.count(F.lit(1)).alias("c"))
    groups = of.groupBy("family", "key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("a"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    parts = lambda n: F.ceil(n / BLOCK_CLASSES).cast("int")
    groups = groups.select("family", "key", "main", parts(F.col("a")).alias("pa"), parts(F.col("n") - F.col("a")).alias("pb"))
    met = postings.join(groups, ["family", "key"]).withColumn("is_main", F.col("label") == F.col("main"))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("pa")).otherwise(F.col("pb"))).cast("int"))
    place = lambda block, side: F.struct(block.alias("block"), side.alias("side"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    first = F.transform(count(F.col("pb")), lambda j: place(F.col("part") * F.col("pb") + j, F.lit(0)))
    second = F.transform(count(F.col("pa")), lambda i: place(i * F.col("pb") + F.col("part"), F.lit(1)))
    block = lambda j: F.col("pa") * F.col("pb") + F.least(j, F.col("part")) * F.col("pb") + F.greatest(j, F.col("part"))
    among = F.transform(count(F.col("pb")), lambda j: place(block(j), F.when(j == F.col("part"), -1).when(F.col("part") < j, 0).otherwise(1)))
    return met.select(F.xxhash64("family", "key").alias("family"), F.inline(F.when(F.col("is_main"), first).otherwise(F.concat(second, among))), F.col("node").alias("rep"), "label").select("family", "block", "rep", "side", "label")


def large_family_members(edges: DataFrame, held: DataFrame, shingle: int, alike: int) -> tuple[DataFrame, DataFrame]:
    """(u, v), the confirmed star links of families of more than a block; and the members of the blocks in which their other links are to be found.

    edges: those of ``bucket_links``; held: node, family, n_shingles, sketch, print_a, text of the classes of such families.
    """
    sizes, texts = held.select("node", "n_shingles"), held.select(F.col("node").alias("rep"), "text", "sketch", "print_a")
    stars = edges.join(sizes.select(F.col("node").alias("u")), "u", "left_semi").groupBy("u").agg(F.min("v").alias("v"))
    links = written(confirmed_links(star_blocks(written(stars, "stars"), sizes).join(texts, "rep"), shingle, alike), "star-links")
    # finer than components, which costs some pairs and no link
    label = links.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("label")).groupBy("node").agg(F.min("label").alias("label"))
    postings = rare_shingles(held, shingle, alike).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return links, shingle_blocks(written(postings, "postings")).join(texts, "rep")


def _grouped(docs: DataFrame, shingle: int, alike: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be of an integer type")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(described(texts, shingle), "sketches")
    same = ["n_shingles", "print_a", "print_b"]
    full = rows.where("n_shingles > 0")
    classes = written(full.groupBy(*same).agg(F.min("doc_id").alias("key"), F.first("sketch").alias("sketch")), "classes")
    # a class goes by its smallest doc_id, or by a hash where several classes have the same
    twice = written(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and key is not null").select("key", F.lit(True).alias("_twice")), "twice")
    classes = classes.join(twice, "key", "left").withColumn("node", F.when(F.col("_twice"), F.xxhash64(*same)).otherwise(F.col("key"))).drop("_twice")
    edges = written(bucket_links(classes.where("node is not null")), "edges")
    wanted = components(edges, plain=True).withColumnRenamed("component", "family").join(classes, "node")
    once = texts.where("text is not null").withColumnRenamed("doc_id", "key")
    held = written(once.join(wanted, "key").select("node", "family", "n_shingles", "sketch", "print_a", "text"), "held")
    large = written(held.groupBy("family").agg(_parts(F.count(F.lit(1)), F.sum("n_shingles")).alias("parts")).where("parts > 1").select("family"), "large")
    small = held.join(large, "family", "left_anti")
    members = small.select("family", F.lit(0).alias("block"), F.col("node").alias("rep"), F.lit(-1).alias("side"), F.col("node").alias("label"), "text", "sketch", "print_a")
    if large.isEmpty():
        links = confirmed_links(members, shingle, alike)
    else:
        stars, others = large_family_members(edges, held.join(large, "family", "left_semi"), shingle, alike)
        links = confirmed_links(members.unionByName(others), shingle, alike).unionByName(stars)
    groups = components(links)

    classed = classes.select(*same, "key", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not twice.isEmpty():  # a component's name is its smallest doc_id, which the hash of a class isn't
        classed = written(classed, "classed")
        classed = classed.drop("key").join(classed.groupBy("component").agg(F.min("key").alias("name")), "component", "left").withColumn("component", F.col("name"))
    classed = classed.select(*same, "component")
    found = rows.drop("sketch").join(classed, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = 5, alike: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    alike: 100 times the least similarity of a link.  doc_id is an integer column.
    """
    return _grouped(docs, shingle, alike).drop("text_hash")


def deduplicated(docs: DataFrame, shingle: int = 5, alike: int = 80) -> DataFrame:
    """The rows whose document stays, with the input's columns."""
    kept = _grouped(docs, shingle, alike).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(kept, rows["_id"].eqNullSafe(kept["_kept_id"]) & (rows["_hash"] == kept["_kept_hash"]), "left_semi").select("_row.*")
