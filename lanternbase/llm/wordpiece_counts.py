"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's trie has, for each node, a failure link and the number of pieces that are popped on the way along it, worked out once.
Greedy longest-match tokenization of a word then takes one pass: where no child fits, the count grows by the node's popped
pieces and the pass goes on at its failure node. No piece is built. Batches walk all their distinct words in
step, one byte at a time, in numpy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytesops import Words, binary_column, slices, xxh64
from .common import only
from .tokens import default_path, token_bytes


class Automaton:
    """Nodes 0 (root) and up. edges: sorted node * 256 + byte; target of each; fail and popped by node (-1: no way on)."""

    def __init__(self, vocabulary: set[bytes]):
        children: list[dict[int, int]] = [{}]
        depth, word = [0], [False]
        for token in sorted(vocabulary):
            node = 0
            for b in token:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    word.append(False)
                node = nxt
            word[node] |= node > 0
        fail, popped = [-1] * len(children), [0] * len(children)
        layer = [0]
        while layer:
            nxt = []
            for node in layer:
                for b, child in children[node].items():
                    nxt.append(child)
                    if word[child]:  # the whole node is one piece
                        fail[child], popped[child] = 0, 1
                        continue
                    z, n = fail[node], popped[node]
                    while z >= 0 and b not in children[z]:
                        n, z = n + popped[z], fail[z]
                    if z >= 0:
                        fail[child], popped[child] = children[z][b], n
            layer = nxt
        self.fail, self.popped = np.array(fail), np.array(popped)
        pairs = sorted((node << 8 | b, child) for node, c in enumerate(children) for b, child in c.items())
        self.edges = np.array([p[0] for p in pairs] + [np.iinfo(np.int64).max])
        self.target = np.array([p[1] for p in pairs] + [0])
        self.first = np.array([children[0].get(b, -1) for b in range(256)])

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child by byte, or -1."""
        key = node << 8 | byte
        at = np.searchsorted(self.edges, key)
        out = np.where(self.edges[at] == key, self.target[at], -1)
        return out

    def counts(self, buffer: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Pieces of each slice of the buffer; 1 (the unknown piece) for one that the vocabulary can't spell."""
        one = np.frombuffer(buffer, np.uint8)
        pieces = np.zeros(len(start), np.int64)
        node = np.zeros(len(start), np.int64)
        lost = np.zeros(len(start), bool)
        order = np.argsort(-length, kind="stable")
        longest = int(length.max(initial=0))
        upto = np.searchsorted(-length[order], -np.arange(longest + 1), side="left")
        for i in range(longest):
            live = order[: upto[i]]
            live = live[~lost[live]]
            todo = live
            byte = one[start[live] + i].astype(np.int64)
            while len(todo):
                nxt = self.step(node[todo], byte)
                ok = nxt >= 0
                node[todo[ok]] = nxt[ok]
                todo, byte = todo[~ok], byte[~ok]
                stuck = self.fail[node[todo]] < 0
                lost[todo[stuck]] = True
                todo, byte = todo[~stuck], byte[~stuck]
                pieces[todo] += self.popped[node[todo]]
                node[todo] = self.fail[node[todo]]
        live = np.flatnonzero((node > 0) & ~lost)
        while len(live):  # the end: pop what is left
            stuck = self.fail[node[live]] < 0
            lost[live[stuck]] = True
            live = live[~stuck]
            pieces[live] += self.popped[node[live]]
            node[live] = self.fail[node[live]]
            live = live[node[live] > 0]
        pieces[lost] = 1
        return pieces


_automata: dict[int, Automaton] = {}


def _automaton(content: str) -> Automaton:
    key = hash(content)
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(set(token_bytes(json.loads(content))))
    return _automata[key]


def count_pieces(automaton: Automaton, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words, and pieces, of each text."""
    words, pieces = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for i, j in slices([len(d) for d in docs], 4 << 20):
        w = Words(docs[i:j])
        n = np.diff(w.first)
        words[i:j] = n
        if not len(w.start):
            continue
        _, rep, where = np.unique(xxh64(w.buffer, w.start, w.length), return_index=True, return_inverse=True)
        each = automaton.counts(w.buffer, w.start[rep], w.length[rep])[where]
        total = np.concatenate([[0], np.cumsum(each)])
        pieces[i:j] = total[w.first[1:]] - total[w.first[:-1]]
    return words, pieces


def _count(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(spec.value)
        for batch in batches:
            words, pieces = count_pieces(automaton, binary_column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(pieces)], names=["doc_id", "n_words", "n_pieces"])

    return run


def piece_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_words, n_pieces of every row of ``docs`` (doc_id, text).

    A word (a run of characters other than space and U+0009 to U+000D) has as many pieces as greedy longest match over the byte-level
    vocabulary's tokens needs; one that can't be spelled counts as one unknown piece. The one trie
    holds all tokens, those led by a space, too, which no word can match. Texts and words of any length are counted whole. Null and empty texts have none. Null ids and
    repeated rows are kept; extra columns are ignored; an empty table gives an empty result.
    """
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    return only(docs, "doc_id", "text").mapInArrow(_count(spec), "doc_id long, n_words long, n_pieces long")
