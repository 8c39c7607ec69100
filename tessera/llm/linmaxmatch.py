"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie.  Each node has a failure link and the number of pieces popped on
taking it, both computed once: when no further byte matches, the automaton adds the count and goes
on at the link, never going back in the text.  So a word's number of pieces is known without
building any piece.

A word is a run without ASCII white space, after A-Z have been lower-cased, with one space in front: the
vocabulary's pieces that begin with a space begin words, the others go on.  The vocabulary holds every single
byte, so every word has a cover.  Different words of a slice step through the automaton side by side, once
each.

Defined results: null and empty texts have no words and no tokens; repeated rows are counted each; an
empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays


#: Words of more bytes are gone through one by one.
LONG = 1024


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file with a base64 piece and its rank on every line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """The trie of a vocabulary with failure links and popped counts."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                at = children[node].get(byte)
                if at is None:
                    at = children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = at
            final[node] = node != 0
        if len(children[0]) < 256 or not all(final[i] for i in children[0].values()):
            raise ValueError("the vocabulary must hold every single byte")
        link, popped = [0] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in children[node].items():
                    if final[child]:
                        link[child], popped[child] = 0, 1
                    else:
                        at, count = link[node], popped[node]
                        while byte not in children[at]:
                            count += popped[at]
                            at = link[at]
                        link[child], popped[child] = children[at][byte], count
                    below.append(child)
            level = below
        self.link, self.popped = np.array(link, np.int32), np.array(popped, np.int32)
        #: Rows that ``_walk`` has been at, as lists.
        self.known: dict[int, list[int]] = {}
        # a row of 256 next nodes for each node that has any; row 0 for those that have none
        inner = [i for i, c in enumerate(children) if c]
        self.row = np.zeros(len(children), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.full((len(inner) + 1, 256), -1, np.int32)
        for k, i in enumerate(inner, 1):
            self.next[k, list(children[i])] = list(children[i].values())

    def _walk(self, word: bytes) -> int:
        """Pieces of one word with a space in front, a byte at a time: for long words, which would be alone in a step over all words."""
        known, link, popped, row = self.known, self.link, self.popped, self.row
        node, count = int(self.next[row[0], 32]), 0
        for byte in word:
            while True:
                steps = known.get(node)
                if steps is None:
                    steps = known[node] = self.next[row[node]].tolist()
                to = steps[byte]
                if to >= 0:
                    break
                count += int(popped[node])
                node = int(link[node])
            node = to
        while node:
            count += int(popped[node])
            node = int(link[node])
        return count

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end] with a space in front."""
        long = np.flatnonzero(ends - starts > LONG)
        out = np.zeros(len(starts), np.int64)
        out[long] = [self._walk(data[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        rest = np.flatnonzero(ends - starts <= LONG)
        out[rest] = self._together(data, starts[rest], ends[rest])
        return out

    def _together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same of many words side by side: a step over all of them for each byte of the longest."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        starts, size = starts[order], size[order]
        node = np.full(len(starts), self.next[self.row[0], 32], np.int32)
        count = np.zeros(len(starts), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, "left"))
            byte = data[starts[:live] + k]
            to = self.next[self.row[node[:live]], byte]
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                at = node[stuck]
                count[stuck] += self.popped[at]
                node[stuck] = at = self.link[at]
                to[stuck] = found = self.next[self.row[at], byte[stuck]]
                stuck = stuck[found < 0]
            node[:live] = to
        rest = np.flatnonzero(node)
        while len(rest):  # what is left in the automaton at a word's end
            count[rest] += self.popped[node[rest]]
            node[rest] = self.link[node[rest]]
            rest = rest[node[rest] != 0]
        out = np.empty_like(count)
        out[order] = count
        return out


_made: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The worker's automaton for a vocabulary file."""
    if path not in _made:
        _made[path] = Automaton(read_vocabulary(path))
    return _made[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary)
        for batch in arrays.slices(batches):
            data, offsets = arrays.buffer(batch.column("text"))
            data = arrays.lower(data)
            starts, ends = arrays.runs(arrays.SOLID[data], offsets)
            _, first, which = np.unique(arrays.hashes(data, starts, ends), return_index=True, return_inverse=True)
            done = np.concatenate([[0], np.cumsum(machine.counts(data, starts[first], ends[first])[which])])
            at = np.searchsorted(starts, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(done[at]))], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
