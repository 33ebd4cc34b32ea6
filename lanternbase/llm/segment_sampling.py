"""Distinct sampled segmentations of texts over a piece vocabulary: Gumbel top-k without replacement by perturbed A-star search.

A text's lattice has an edge for each piece that fits at each position; characters without a piece take byte pieces. No piece goes on over
the beginning of a word, so the lattice is a chain of words' lattices, and a word's is worked out once for all its places. Backward sums give
the mass of every set of completions exactly, so the search needs no guess: a node is the set of segmentations that agree with a found one before
some word and take none of some choices there. A heap holds nodes by their perturbed log mass, which is the largest perturbed log probability of a segmentation
in them. The best node gives the next segmentation, drawn from the node's own distribution; what is left of the node falls apart into one node
for each word from there on, with Gumbel values conditioned on the parent's as their maximum. Segmentations leave in the order of their perturbed
log probabilities, which is a sample without replacement. The heap keeps as many nodes as segmentations are still asked for; the others can't
be reached. One more than asked for gives the threshold of the inclusion scores.

The searches of a batch of texts go on together, one segmentation each at a time, as numpy work on all their words; only the drawing at
a node's first word, which bars some choices, and words of over ``LONG`` characters go step by step.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, mix, ragged, slices
from .common import only

K, SEED = 4, 9
#: Temperature-like exponent of the prior over piece ids, and its offset: log p = -SLOPE * log(id + OFFSET), normalised.
SLOPE, OFFSET = 1.0, 3.0
SPACE = "▁"
#: Characters of a batch; characters (and steps of a walk) from which on a word is worked out alone.
BATCH, LONG = 1 << 20, 128
#: Log probabilities are added as integers, so that a text's results do not depend on the texts beside it.
UNIT = 2.0**34


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary with a prior that falls with a piece's id, as ids of BPE files ascend from frequent to rare."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = n_pieces = self.sp.get_piece_size()
        self.text = [self.sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte.items()}
        odd = {i for i in range(n) if self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)}
        weight = {i: -SLOPE * math.log(i + OFFSET) for i in range(n) if i not in odd}
        total = math.log(sum(math.exp(x) for x in weight.values()))
        self.log_p = {i: x - total for i, x in weight.items()}
        self.ids = {self.text[i]: i for i in weight if i not in self.bytes_of}
        self.longest = max(map(len, self.ids))
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece goes on over the beginning of a word")
        # of each length, the pieces' beginnings as hashes, and the piece that is no longer (or -1)
        self.begins = []
        for n in range(1, self.longest + 1):
            starts = dict.fromkeys((t[:n] for t in self.ids if len(t) >= n), -1)
            starts |= {t: i for t, i in self.ids.items() if len(t) == n}
            h = np.zeros(len(starts), U)
            for c in np.array([list(map(ord, t)) for t in starts], U).T:
                h = _roll(h, c)
            self.begins.append(Numbers(h, np.array(list(starts.values()), np.int32)))
        self.price = np.array([self.log_p.get(i, -np.inf) for i in range(n_pieces)])

    def normalize(self, text: str) -> str:
        """Spaces become the space sign, and one leads the text; an empty text stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation: exactly the one that was encoded, unless it held the space sign itself."""
        raw = b"".join(bytes([self.bytes_of[i]]) if i in self.bytes_of else self.text[i].encode() for i in ids)
        return raw.decode().replace(SPACE, " ")[1:]


def _roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * U(0x9E3779B97F4A7C15) + c + U(1))


class Numbers:
    """Numbers by hash, in two tables of ``SPARE`` or more slots an entry; the entries that find both their slots taken are searched."""

    SPARE = 8

    def __init__(self, hashes: np.ndarray, number: np.ndarray):
        self.shift = max(1, (self.SPARE * len(hashes)).bit_length())
        self.hashes, self.number = np.append(hashes, U(0)), np.append(number, np.int32(-1))
        # the last entry stands for an empty slot
        self.slots = np.full((2, 1 << self.shift), len(hashes), np.int32)
        left = np.arange(len(hashes), dtype=np.int32)
        for side in range(2):
            slot = self._slot(hashes[left], side)
            self.slots[side][slot] = left
            left = left[self.slots[side][slot] != left]
        order = np.argsort(hashes[left])
        self.rest = left[order]
        self.rest_hashes = hashes[self.rest]

    def _slot(self, h: np.ndarray, side: int) -> np.ndarray:
        return (h >> U(64 - self.shift if side else 16)) & U((1 << self.shift) - 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes have an entry, ascending, and their numbers."""
        entry = self.slots[0][self._slot(h, 0)]
        ok = self.hashes[entry] == h
        miss = np.flatnonzero(~ok)
        some = h[miss]
        second = self.slots[1][self._slot(some, 1)]
        hit = self.hashes[second] == some
        if len(self.rest):
            place = np.minimum(np.searchsorted(self.rest_hashes, some), len(self.rest) - 1)
            searched = self.rest_hashes[place] == some
            second, hit = np.where(searched, self.rest[place], second), hit | searched
        entry[miss[hit]] = second[hit]
        ok[miss[hit]] = True
        at = np.flatnonzero(ok & (entry < len(self.hashes) - 1))
        return at, self.number[entry[at]]


class Lattices:
    """The lattices of some words, edges by position, the longest first: where they lead, piece (below zero: a list of pieces), and their share of their position's completions.

    first: each word's first position, and their number; edge: each position's first edge, and their number. other: the share of a position's other edges.
    """

    def __init__(self, pieces: Pieces, words: pa.LargeStringArray):
        _, offsets, data = words.buffers()
        text = str(memoryview(data)[: int(np.frombuffer(offsets, np.int64)[len(words)])], "utf-8") if len(words) else ""
        self.size = pc.utf8_length(words).to_numpy().astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        n = len(text)
        symbol = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)
        end = np.repeat(self.first[1:].astype(np.int32), self.size)
        found = []
        live, h = np.arange(n, dtype=np.int32), np.zeros(n, U)
        for length, begins in enumerate(pieces.begins, 1):
            h = _roll(h, symbol[live + (length - 1)])
            at, ids = begins.find(h)
            live, h = live[at], h[at]
            is_piece = np.flatnonzero(ids >= 0)
            found.append((live[is_piece], length, ids[is_piece]))
            on = np.flatnonzero(live + length < end[live])
            live, h = live[on], h[on]
            if not len(live):
                break
        # a character without a piece takes byte pieces
        self.spelled: list[list[int]] = []
        plain = np.zeros(n, bool)
        if found:
            plain[found[0][0]] = True
        odd = np.flatnonzero(~plain)
        if len(odd):
            codes, which = np.unique(symbol[odd], return_inverse=True)
            self.spelled = [[pieces.byte[b] for b in chr(c).encode()] for c in codes.tolist()]
            found.insert(0, (odd, 1, -1 - which))
        many = np.zeros(n, np.int32)
        for at, _, _ in found:
            many[at] += 1
        self.edge = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        total = int(self.edge[-1])
        self.to, self.piece = np.empty(total, np.int32), np.empty(total, np.int32)
        spot = self.edge[:-1].copy()
        for at, length, ids in reversed(found):
            here = spot[at]
            self.to[here], self.piece[here] = at + length, ids
            spot[at] += 1
        price = pieces.price[self.piece] if total else np.zeros(0)
        if self.spelled:
            below = self.piece < 0
            price[below] = np.array([pieces.price[x].sum() for x in self.spelled])[-1 - self.piece[below]]
        # backward sums: positions as far from their word's end, together
        mass = np.zeros(n + 1)
        ahead = end - np.arange(n, dtype=np.int32)
        by = np.argsort(ahead, kind="stable")
        stop = np.searchsorted(ahead[by], np.arange(1, min(LONG, int(ahead.max(initial=0))) + 2))
        over = np.where(self.to < np.repeat(end, many), self.to, n)  # the end of a word has mass one
        share = np.empty(total)
        for a, b in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True):
            some = by[a:b]
            count = many[some]
            e = ragged(self.edge[some], count)
            cut = np.cumsum(count) - count
            term = price[e] + mass[over[e]]
            top = np.maximum.reduceat(term, cut)
            part = np.exp(term - np.repeat(top, count))
            whole = np.add.reduceat(part, cut)
            mass[some] = top + np.log(whole)
            share[e] = part / np.repeat(whole, count)
        for w in np.flatnonzero(self.size > LONG).tolist():
            begin = int(self.first[w])
            for i in range(begin + int(self.size[w]) - LONG - 1, begin - 1, -1):
                a, b = self.edge[i], self.edge[i + 1]
                term = price[a:b] + mass[over[a:b]]
                top = term.max()
                part = np.exp(term - top)
                whole = part.sum()
                mass[i] = top + math.log(whole)
                share[a:b] = part / whole
        self.share, self.log_share = share, np.log(share)
        self.units = np.round(self.log_share * UNIT).astype(np.int64)
        self.upto = self.other = share
        if n:
            # the share of the edges up to each, in integers, so that it does not depend on the words before
            upto = np.cumsum((share * 2.0**42).astype(np.int64))
            base = np.concatenate([[0], upto])[self.edge]
            self.upto = (upto - np.repeat(base[:-1], many)) / np.repeat((base[1:] - base[:-1]).astype(np.float64), many)
            self.upto[self.edge[1:] - 1] = 1.0
            large = share > 0.5
            self.other = 1.0 - share
            less = np.add.reduceat(np.where(large, 0.0, share), self.edge[:-1])
            self.other[large] = np.repeat(less, many)[large]

    def draw(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A path for each of some words: edges of all, length of each, log probability (in units), and that of its word's other paths."""
        m = len(word)
        length = np.zeros(m, np.int64)
        live, i, end = np.arange(m), self.first[word].astype(np.int32), self.first[word + 1].astype(np.int32)
        ends, seeds = end, seed
        steps = []
        for step in range(LONG):
            if not len(live):
                break
            u = _uniform(seeds, step)
            e = self.edge[i]
            on = np.flatnonzero(self.upto[e] <= u)
            while len(on):  # the last edge of a position goes up to 1
                e[on] += 1
                on = on[self.upto[e[on]] <= u[on]]
            steps.append((live, e))
            i = self.to[e]
            ok = i < ends
            length[live[~ok]] = step + 1
            on = np.flatnonzero(ok)
            live, i, ends, seeds = live[on], i[on], ends[on], seeds[on]
        more = {}
        for x, at in zip(live.tolist(), i.tolist(), strict=True):
            path, stop = [], int(end[x])
            while at < stop:
                if len(path) % LONG == 0:
                    chance = _uniform(np.full(LONG, seed[x]), LONG + len(path) + np.arange(LONG))
                e = int(self.edge[at])
                while self.upto[e] <= chance[len(path) % LONG]:
                    e += 1
                path.append(e)
                at = int(self.to[e])
            more[x] = path
            length[x] = LONG + len(path)
        start = np.cumsum(length) - length
        flat = np.zeros(int(length.sum()), np.int64)
        for step, (some, e) in enumerate(steps):
            flat[start[some] + step] = e
        for x, path in more.items():
            flat[start[x] + LONG : start[x] + length[x]] = path
        units = np.add.reduceat(self.units[flat], start) if m else np.zeros(0, np.int64)
        rest = -np.expm1(units / UNIT)
        # near one, the others' shares are added up
        near = np.flatnonzero(units > -UNIT / 1000)
        rest[near] = 0.0
        at, stop, before = start[near], start[near] + length[near], np.ones(len(near))
        while len(near):
            e = flat[at]
            rest[near] += before * self.other[e]
            before = before * self.share[e]
            at = at + 1
            ok = at < stop
            if not ok.all():
                near, at, stop, before = near[ok], at[ok], stop[ok], before[ok]
        with np.errstate(divide="ignore"):
            rest = np.log(rest)
        return flat, length, units, rest

    def draw_other(self, word: int, seed: int, taken: list[list[int]]) -> tuple[list[int], float]:
        """A path that is none of ``taken``, and the log share of all paths but it and those."""
        rng = random.Random(seed)
        at, end = int(self.first[word]), int(self.first[word + 1])
        children, terms = self._left(at, end, taken)
        node, path, met = 0, [], []
        while at < end:
            a = int(self.edge[at])
            weight = terms[node] if node is not None else self.log_share[a : int(self.edge[at + 1])].tolist()
            top = max(weight)
            e = rng.choices(range(a, a + len(weight)), [math.exp(w - top) for w in weight])[0]
            met.append((weight, e - a))
            node = children[node].get(e) if node is not None else None
            path.append(e)
            at = int(self.to[e])
        return path, self._without(met, path)

    def _without(self, met: list[tuple[list[float], int]], path: list[int]) -> float:
        """The log share of all paths but ``path`` and those of the tree, from the edges' log shares at each position of the path: edges beside it stay as they are."""
        below = -math.inf
        for (terms, i), e in zip(reversed(met), reversed(path), strict=True):
            terms[i] = float(self.log_share[e]) + below
            top = max(terms)
            below = top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else -math.inf
        return below

    def _left(self, begin: int, end: int, taken: list[list[int]]) -> tuple[list[dict[int, int]], list[list[float]]]:
        """Of the tree of the ``taken`` paths: children of each node by edge, and the log share of the other paths by each of its position's edges."""
        at, children = [begin], [{}]
        for path in taken:
            node = 0
            for e in path:
                if e not in children[node]:
                    children[node][e] = len(at)
                    at.append(int(self.to[e]))
                    children.append({})
                node = children[node][e]
        left, terms = [-math.inf] * len(at), [[] for _ in at]
        for node in range(len(at) - 1, -1, -1):
            if at[node] < end:
                a, b = int(self.edge[at[node]]), int(self.edge[at[node] + 1])
                mine = terms[node] = self.log_share[a:b].tolist()
                for e, child in children[node].items():
                    mine[e - a] += left[child]
                top = max(mine)
                if top > -math.inf:
                    left[node] = top + math.log(sum(math.exp(t - top) for t in mine))
        return children, terms


def _words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of normalised texts, one after the other, and how many each text has: a word begins with the text or with a run of space signs."""
    raw = [t.encode() for t in texts]
    edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    data = b"".join(raw)
    octets, (lead, *tail) = np.frombuffer(data, np.uint8), SPACE.encode()
    sign = np.flatnonzero(octets == lead)
    for i, octet in enumerate(tail, 1):
        sign = sign[octets[sign + i] == octet]
    new = np.zeros(len(data) + 1, bool)
    new[sign[np.diff(sign, prepend=-len(SPACE.encode()) - 1) != len(SPACE.encode())]] = True
    new[edge] = True
    start = np.flatnonzero(new)  # the last one is the end
    words = pa.Array.from_buffers(pa.large_string(), len(start) - 1, [None, pa.py_buffer(start), pa.py_buffer(data)])
    return words.dictionary_encode(), np.diff(np.searchsorted(start, edge))


def _uniform(seed: np.ndarray, count) -> np.ndarray:
    """Numbers in (0, 1) by seed and count."""
    with np.errstate(over="ignore"):
        h = mix(seed + (np.asarray(count).astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    return ((h >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


def _seed(seed: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Seeds of a row's parts."""
    with np.errstate(over="ignore"):
        return mix(seed + (count.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))


def _perturbed(mass: np.ndarray, at_most, u: np.ndarray) -> np.ndarray:
    """Gumbel values of sets with log mass ``mass`` that are conditioned to stay below ``at_most``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(mass > -np.inf, -np.logaddexp(-at_most, np.log(-np.log(u)) - mass), -np.inf)


def sample_together(pieces: Pieces, texts: list[str], seeds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the first, second, ... segmentation: (texts that have one, pieces of all, where each text's end, log probability, perturbed one, inclusion).

    Log probabilities are relative to all segmentations of the text. The inclusion score is the probability to exceed the perturbed value of the
    (k+1)-th; 1 if there is none. An empty text has one segmentation, without pieces.
    """
    coded, size = _words([pieces.normalize(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(size)])
    number = coded.indices.to_numpy().astype(np.int64)
    lattices = Lattices(pieces, coded.dictionary)
    n, m = len(texts), len(number)
    # of each round and word, its path: where in ``flat``, length and log probability
    flat, start, length, units = np.zeros(0, np.int64), *(np.zeros((k, m), np.int64) for _ in range(3))
    value = -np.log(-np.log(_uniform(seeds, 0)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    heaps: list[list] = [[] for _ in range(n)]
    active, at = np.arange(n), np.full(n, -1)
    parent, barred, fixed = np.zeros(n, np.int64), [()] * n, []
    for r in range(k):
        inst = ragged(base[active], size[active])
        of = np.repeat(np.arange(len(active)), size[active])
        position = inst - base[active][of]
        here = at[of]
        same = np.flatnonzero(position < here)
        words, rounds = inst[same], parent[of[same]]
        for x in (start, length, units):
            x[r, words] = x[rounds, words]
        rest = np.full(len(inst), -np.inf)
        fresh = np.flatnonzero(position > here)
        path, count, log_p, others = lattices.draw(number[inst[fresh]], _seed(seeds[active][of[fresh]], position[fresh] * (k + 1) + r))
        start[r, inst[fresh]] = len(flat) + np.cumsum(count) - count
        length[r, inst[fresh]], units[r, inst[fresh]], rest[fresh] = count, log_p, others
        changed = np.flatnonzero(position == here)
        count = np.array([len(p) for p, _ in fixed], np.int64)
        start[r, inst[changed]] = len(flat) + len(path) + np.cumsum(count) - count
        length[r, inst[changed]] = count
        units[r, inst[changed]] = [lattices.units[p].sum() for p, _ in fixed]
        rest[changed] = [x for _, x in fixed]
        flat = np.concatenate([flat, path, *(np.array(p, np.int64) for p, _ in fixed)])
        upto = np.cumsum(units[r, inst])
        edge = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(size[active])])]
        mass = (upto - units[r, inst] - edge[:-1][of]) / UNIT
        tail = np.flatnonzero(position >= here)
        x = np.full(len(inst), -np.inf)
        u = _uniform(_seed(seeds[active][of[tail]], position[tail] * (k + 1) + r), -1)
        x[tail] = _perturbed(mass[tail] + rest[tail], value[of[tail]], u)
        found.append((active, value, np.diff(edge) / UNIT))
        # the best nodes of each text; more than are asked for can't be reached: those below as many others, found before or each the best of a part of the text
        least = np.array([-heaps[t][-1][0] if len(heaps[t]) == k - r else -np.inf for t in active.tolist()])
        many = np.flatnonzero(np.isinf(least) & (size[active] >= k - r))
        if len(many):
            parts = size[active[many], None] * np.arange(k - r) // (k - r) + (np.cumsum(size[active]) - size[active])[many, None]
            # a part that ends before the next text's first one has a neighbour to stop at
            stops = np.concatenate([parts, parts[:, :1] + size[active[many], None]], axis=1).ravel()
            least[many] = np.maximum.reduceat(np.append(x, -np.inf), stops).reshape(len(many), -1)[:, :-1].min(axis=1)
        spots = np.flatnonzero((x >= least[of]) & (x > -np.inf))
        spots = spots[np.lexsort((-x[spots], of[spots]))]
        owner = of[spots]
        kept = np.arange(len(spots)) - np.searchsorted(owner, owner) < k - r
        spots, owner = spots[kept], owner[kept]
        for t, y, p in zip(owner.tolist(), x[spots].tolist(), position[spots].tolist(), strict=True):
            heap = heaps[active[t]]
            heap.append((-y, len(heap), r, p, (*barred[t], r) if p == at[t] else (r,)))
        nxt, state = [], []
        for t in active.tolist():
            heap = heaps[t]
            if heap:
                heap.sort(key=lambda node: node[:2])
                del heap[k - r :]
                nxt.append(t)
                if r + 1 < k:
                    state.append(heap.pop(0))
        if r + 1 == k or not nxt:
            break
        active = np.array(nxt)
        value = -np.array([node[0] for node in state])
        parent, at, barred = np.array([node[2] for node in state]), np.array([node[3] for node in state]), [node[4] for node in state]
        spot = base[active] + at
        seed = _seed(seeds[active], at * (k + 1) + r + 1)
        fixed = [lattices.draw_other(int(number[i]), int(s), [flat[start[q, i] : start[q, i] + length[q, i]].tolist() for q in taken]) for i, s, taken in zip(spot.tolist(), seed, barred, strict=True)]
    threshold = np.full(n, -np.inf)
    if len(found) == k:
        for t in active.tolist():
            if heaps[t]:
                threshold[t] = -heaps[t][0][0]
    spelled = np.array([x for s in lattices.spelled for x in s], np.int32)
    spelled_size = np.fromiter(map(len, lattices.spelled), np.int64, len(lattices.spelled))
    spelled_at = np.cumsum(spelled_size) - spelled_size
    for r, (some, perturbed, log_p) in enumerate(found):
        inst = ragged(base[some], size[some])
        piece = lattices.piece[flat[ragged(start[r, inst], length[r, inst])]]
        ends = np.concatenate([[0], np.cumsum(length[r, inst])])[np.cumsum(size[some])]
        if len(lattices.spelled) and (piece < 0).any():
            count = np.ones(len(piece), np.int64)
            odd = np.flatnonzero(piece < 0)
            which = -1 - piece[odd]
            count[odd] = spelled_size[which]
            upto = np.concatenate([[0], np.cumsum(count)])
            ends = upto[ends]
            wide = np.repeat(piece, count)
            wide[ragged(upto[odd], count[odd])] = spelled[ragged(spelled_at[which], spelled_size[which])]
            piece = wide
        kept = np.where(threshold[some] > -np.inf, -np.expm1(-np.exp(np.minimum(700.0, log_p - threshold[some]))), 1.0)
        yield some, piece.astype(np.int32), ends, log_p, perturbed, kept


def sample(pieces: Pieces, text: str, k: int, seed: int) -> list[tuple[list[int], float, float, float]]:
    """(ids, log probability, perturbed log probability, inclusion score) of up to ``k`` distinct segmentations of a text, best perturbed first."""
    return [(ids.tolist(), float(p[0]), float(g[0]), float(q[0])) for _, ids, _, p, g, q in sample_together(pieces, [text], np.array([seed], U), k)]


_pieces: dict[bytes, Pieces] = {}


def _held(model: bytes) -> Pieces:
    key = hashlib.md5(model, usedforsecurity=False).digest()
    if key not in _pieces:
        _pieces.clear()
        _pieces[key] = Pieces(model)
    return _pieces[key]


def _sample(model, k: int, seed: int, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _held(model.value)
        for whole in batches:
            texts = [t or "" for t in whole.column(keys).to_pylist()]
            named = [c.to_pylist() for c in whole.columns[:keys]]
            # the seed is the row's key: one row has one result wherever it is computed
            seeds = np.array([int.from_bytes(hashlib.blake2b(repr((seed, *(c[i] for c in named))).encode(), digest_size=8).digest()) for i in range(len(texts))], U)
            for a, b in slices([len(t) for t in texts], BATCH):
                for r, (some, ids, ends, *scores) in enumerate(sample_together(pieces, texts[a:b], seeds[a:b], k), 1):
                    columns = [whole.column(c).take(pa.array(a + some)) for c in range(keys)]
                    columns += [pa.array(np.full(len(some), r, np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids)), *map(pa.array, scores)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*whole.schema.names[:keys], "sample", "ids", "log_prob", "perturbed", "inclusion"])

    return run


RESULT = ("sample", "ids", "log_prob", "perturbed", "inclusion")


def sample_segmentations(rows: DataFrame, key: list[str], text: str = "text", k: int = K, seed: int = SEED, model: str | None = None) -> DataFrame:
    """The key columns, sample (from 1), ids, log_prob (of all segmentations of the text), perturbed and inclusion of up to ``k`` distinct segmentations.

    A row's samples depend on its key, its text and ``seed`` only, so repeated rows have equal results; equal perturbed values have probability zero,
    and of equal ones the earlier word's node goes first. Null texts are empty: one segmentation without pieces. Null keys are keys like any other. Work and
    memory of a text grow in proportion to its length. Extra columns are ignored; an empty table gives an empty result.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if {c.lower() for c in key} & set(RESULT):
        raise ValueError(f"a key column has a name of the result's: {RESULT}")
    with open(model or default_path(), "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    rows = only(rows, *key, text)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_sample(shared, k, seed, len(key)), f"{names}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double")


def decode_segmentations(samples: DataFrame, model: str | None = None) -> DataFrame:
    """``samples`` with column decoded: the text of ids; null for null ids, empty for none. All other columns stay."""
    with open(model or default_path(), "rb") as f:
        shared = samples.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decode(ids):
        pieces = _held(shared.value)
        return ids.map(lambda x: None if x is None else pieces.decode(list(x)))

    return samples.withColumn("decoded", decode("ids"))
