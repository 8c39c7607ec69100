"""Which texts hold which terms, whatever the number of either.

An Aho-Corasick automaton of a block of terms reads each text once, however many terms there are.  A block has about ``BLOCK_CHARS`` characters of
terms.  One block is sent to the tasks that hold the texts, which aren't shuffled; of more, each is dealt to ``SHARES`` shares, and every text
meets every block in one share of it, which a hash chooses.  A task holds one automaton at a time and streams the texts past it.

For the other direction, terms that hold a text, swap the sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import written

#: Characters of terms in a block (an automaton takes some 100 bytes each at most), and shares among which its texts are dealt.
BLOCK_CHARS = 1 << 19
SHARES = 32


def _automaton(terms: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(term, i)
    found.make_automaton()
    return found


def _matches(ids: pa.Array, texts: list[str], automaton, terms: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, term), each term of a text once."""
    rows, said = [], []
    for i, text in enumerate(texts):
        held = sorted({k for _, k in automaton.iter(text)})
        rows += [i] * len(held)
        said += [terms[k] for k in held]
        if len(rows) > 100_000:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(said, pa.string())], ["id", "term"])
            rows, said = [], []
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(said, pa.string())], ["id", "term"])


def holders(texts: DataFrame, terms: DataFrame, block_chars: int | None = None) -> DataFrame:
    """(id, term): the rows whose text holds a term; texts: id, text; terms: term.

    Null and empty texts and terms match nothing; a pair of id and term comes once, also where the id has several texts.
    """
    limit = block_chars or BLOCK_CHARS
    wanted = written(terms.select(F.col("term").cast("string").alias("term")).where("term <> ''").distinct(), "terms")
    sized = texts.select("id", F.col("text").cast("string").alias("text")).where("text <> ''")
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("term", T.StringType())])
    blocks = max(1, -(-int(wanted.agg(F.sum(F.length("term"))).first()[0] or 0) // limit))
    if blocks == 1:
        listed = [r.term for r in wanted.collect()]  # a block

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = None
            for batch in batches:
                automaton = automaton or _automaton(listed)
                yield from _matches(batch.column("id"), batch.column("text").to_pylist(), automaton, listed)

        found = sized.mapInArrow(search, schema) if listed else texts.sparkSession.createDataFrame([], schema)
        return found.distinct()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, listed, automaton = None, [], None
        for batch in batches:
            block, share, term = (batch.column(c).to_pylist() for c in ("block", "share", "term"))
            begin = 0
            for i in range(batch.num_rows + 1):
                ends = i == batch.num_rows or (block[i], share[i]) != place or term[i] is not None
                if ends and begin < i and place is not None and term[begin] is None:
                    automaton = automaton or (_automaton(listed) if listed else None)
                    if automaton:
                        some = batch.slice(begin, i - begin)
                        yield from _matches(some.column("id"), some.column("text").to_pylist(), automaton, listed)
                if i == batch.num_rows:
                    break
                if (block[i], share[i]) != place:
                    place, listed, automaton, begin = (block[i], share[i]), [], None, i
                if term[i] is not None:  # a block's terms come before its texts
                    listed.append(term[i])
                    begin = i + 1

    every = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    none = F.lit(None)
    patterns = wanted.select(block, every, "term", none.cast(schema["id"].dataType).alias("id"), none.cast("string").alias("text"))
    dealt = sized.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("text"), F.lit(SHARES)).cast("int").alias("share"), none.cast("string").alias("term"), "id", "text")
    both = patterns.unionByName(dealt).repartition("block", "share").sortWithinPartitions("block", "share", F.col("term").isNull())
    return both.mapInArrow(stream, schema).distinct()


def either_way(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): texts of which one holds the other, each pair once; left: a, right: b.  Null and empty texts are in no pair."""
    a, b = (rows.select(F.col(c).alias(c)).where(F.col(c) != "").distinct() for rows, c in ((left, "a"), (right, "b")))
    within = holders(a.select(F.col("a").alias("id"), F.col("a").alias("text")), b.select(F.col("b").alias("term"))).select(F.col("id").alias("a"), F.col("term").alias("b"))
    around = holders(b.select(F.col("b").alias("id"), F.col("b").alias("text")), a.select(F.col("a").alias("term"))).select(F.col("term").alias("a"), F.col("id").alias("b"))
    return within.unionByName(around).distinct()
