"""SentencePiece encoding by sampled segmentations without replacement, and decoding.

All segmentations of a text are paths of a lattice of vocabulary pieces. Gumbel top-k gives the k segmentations with the
largest perturbed log probabilities, which is a sample of k without replacement. They are found best first: the search
holds sets of paths (a fixed beginning, some next pieces ruled out), each with the exact maximum of its perturbed values,
drawn from a Gumbel distribution cut off at the maximum of the set it was split from. Taking the set with the largest
maximum, walking its best path, and splitting off what the path left aside gives the next segmentation; nothing is
rejected, and no path is found twice.

A BPE vocabulary has ranks, not probabilities, so a piece of rank r gets a probability in proportion to 1 / (r + 1).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 3
SMOOTHING = 1.0          # powers below 1 flatten the distribution of segmentations
SEED = 11
TEXT_BLOCK = 1 << 19     # characters of text worked on at a time
LEARN_BLOCK = 1 << 16    # nodes of new lattices made at a time
CACHED_EDGES = 1_000_000  # edges of lattices a task remembers before it starts afresh: about 50 MB with room to grow

FAINT = 40.0             # below exp(-40) a probability is less than the last digit of 1
DRAWN = 64               # random numbers made for each text at once

_SPACE = "▁"
_CHUNK = re.compile(f"{_SPACE}+[^{_SPACE}]*")
_SHIFT = np.uint64(11)
_END = 0x110000  # stands at the end of a chunk: above every sign, so no piece goes on behind it


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their numbers and log probabilities; what a task needs of a model, read once on the driver."""

    pieces: dict[str, int]
    log_p: dict[int, float]
    bytes_from: int  # number of the piece for byte 0

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        """From a SentencePiece model with byte fallback, in which no piece goes on behind a space."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        first = model.piece_to_id("<0x00>")
        plain = [i for i in range(model.vocab_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        if not model.is_byte(first) or any(p.strip(_SPACE) and _SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("the model must have byte fallback, and spaces only at the start of pieces")
        weights = [*plain, *range(first, first + 256)]
        total = math.log(sum(1 / (r + 1) for r in range(len(weights))))
        return cls(pieces, {i: -math.log(r + 1) - total for r, i in enumerate(weights)}, first)

    def texts(self) -> np.ndarray:
        """The bytes of every piece, by number."""
        out = np.full(max(self.log_p) + 1, b"", dtype=object)
        for piece, i in self.pieces.items():
            out[i] = piece.replace(_SPACE, " ").encode()
        out[self.bytes_from:self.bytes_from + 256] = [bytes([b]) for b in range(256)]
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Numbers inside (0, 1) that depend on key and step alone."""
    counted = np.atleast_1d(np.asarray(step, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((_mix(keys + counted) >> _SHIFT).astype(np.float64) + 0.5) / 2.0 ** 53


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    """Where a step of the trie is first looked for; the number of slots is a power of two."""
    return (keys * 0x9E3779B97F4A7C1 >> 20) & (slots - 1)


def _below(location: np.ndarray, bound: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at these locations, cut off at a bound; minus infinity at location minus infinity."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, -location + np.log(-np.log(u)))


def _plain(text: str) -> bool:
    """Whether every space of a text starts a chunk and nothing else does."""
    return bool(text) and "  " not in text and _SPACE not in text and text[0] != " "


class Lattices:
    """Lattices of chunks of text, node after node in flat arrays, remembered by chunk.

    A chunk has a node for each sign and one for its end. Edges of a node go from the longest piece to the shortest; `sure` is the log
    probability of an edge among those of its node, summed over all ways to go on, and `upto` the running sum of
    probabilities.
    """

    def __init__(self, vocabulary: Vocabulary, smoothing: float) -> None:
        self.vocabulary, self.smoothing = vocabulary, smoothing
        # A trie of the pieces: every beginning of a piece is a state, 0 the empty one.
        states = {"": 0}
        for piece in vocabulary.pieces:
            for n in range(1, len(piece) + 1):
                states.setdefault(piece[:n], len(states))
        self.longest = max(map(len, vocabulary.pieces))
        self.ends = np.array([vocabulary.pieces.get(p, -1) for p in states], np.int64)
        steps = [(states[p[:-1]], ord(p[-1]), i) for p, i in states.items() if p]
        begin, sign, child = (np.array(x, np.int64) for x in zip(*steps))
        keys = begin << 21 | sign
        self.slots = 1 << (3 * len(keys)).bit_length()
        self.step_keys, self.step_child = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
        slots = _slot(keys, self.slots)
        while len(keys):  # one step a slot; the others go to the next one
            _, first = np.unique(slots, return_index=True)
            first = first[self.step_keys[slots[first]] < 0]
            self.step_keys[slots[first]], self.step_child[slots[first]] = keys[first], child[first]
            keys, child, slots = (np.delete(x, first) for x in (keys, child, slots))
            slots = (slots + 1) & (self.slots - 1)
        self.log_p = np.full(max(vocabulary.log_p) + 1, -np.inf)
        for i, x in vocabulary.log_p.items():
            self.log_p[i] = x
        self.first, self.target, self.piece = (np.empty(0, np.int32) for _ in range(3))
        self.sure, self.upto = np.empty(0), np.empty(0)
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.spelled: dict[int, int] = {}  # sign without a piece -> place in `fallback`
        self.fallback = np.empty((0, 4), np.int32)  # byte pieces, -1 behind the last
        self.nodes = self.edges = 0  # of the arrays, which have room for more and are used again

    def _put(self, name: str, at: int, part: np.ndarray) -> None:
        """Append to one of the arrays, whose room is doubled where it ends."""
        own = getattr(self, name)
        if at + len(part) > len(own):
            own = np.concatenate([own[:at], np.empty(max(len(part), at) + len(part), own.dtype)])
            setattr(self, name, own)
        own[at:at + len(part)] = part

    def split(self, text: str) -> list[str]:
        """Chunks that no piece crosses, each without the space it begins with; an empty text has none."""
        if not text:
            return []
        if _plain(text):
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(_SPACE + text.replace(" ", _SPACE))]

    def _follow(self, states: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, states one sign further) of the states from which a piece goes on, in their order."""
        keys = states << 21 | signs
        slots = _slot(keys, self.slots)
        held = self.step_keys.take(slots)
        hit = held == keys
        open_ = np.flatnonzero(~hit & (held >= 0))
        while len(open_):
            slots[open_] = further = (slots.take(open_) + 1) & (self.slots - 1)
            held = self.step_keys.take(further)
            found = held == keys.take(open_)
            hit[open_[found]] = True
            open_ = open_[~found & (held >= 0)]
        on = np.flatnonzero(hit)
        return on, self.step_child.take(slots.take(on))

    def _bare(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, log probability) of signs without a piece, spelled in bytes."""
        distinct, which = np.unique(signs, return_inverse=True)
        numbers, weights = np.empty(len(distinct), np.int64), np.empty(len(distinct))
        for i, code in enumerate(distinct.tolist()):
            if code not in self.spelled:
                raw = [self.vocabulary.bytes_from + b for b in chr(code).replace(_SPACE, " ").encode("utf-8", "surrogatepass")]
                self.fallback = np.vstack([self.fallback, np.array([raw + [-1] * (4 - len(raw))], np.int32)])
                self.spelled[code] = len(self.fallback)
            numbers[i] = -self.spelled[code]
            row = self.fallback[self.spelled[code] - 1]
            weights[i] = self.log_p[row[row >= 0]].sum()
        return numbers[which], weights[which]

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(edges of each node; node, length, piece, log weight of each edge, node after node, longest first) for all pieces
        that start at nodes with `left` signs to the end of their chunk; a sign without a piece becomes its bytes."""
        begin = at = np.flatnonzero(left > 0)
        states, held, found = np.zeros(len(at), np.int64), np.zeros(len(codes), np.int64), []
        for n in range(1, self.longest + 1):
            on, states = self._follow(states, codes.take(at + (n - 1)))
            at, piece = at.take(on), self.ends.take(states)
            some = np.flatnonzero(piece >= 0)
            node, piece = at.take(some), piece.take(some)
            weight = self.log_p.take(piece)
            if n == 1:
                had = np.zeros(len(codes), bool)
                had[node] = True
                bare = begin[~had.take(begin)]
                number, bare_weight = self._bare(codes.take(bare))
                node, piece, weight = (np.concatenate(x) for x in ((node, bare), (piece, number), (weight, bare_weight)))
            shorter = held.take(node)
            found.append((node, shorter, n, piece, weight))
            held[node] = shorter + 1
            if not len(at):
                break
        last = np.cumsum(held) - 1
        size = int(last[-1]) + 1
        length, pieces, weights = np.empty(size, np.int64), np.empty(size, np.int32), np.empty(size)
        for node, shorter, n, piece, weight in found:
            place = last.take(node) - shorter
            length[place], pieces[place], weights[place] = n, piece, weight
        return held, np.repeat(np.arange(len(codes)), held), length, pieces, self.smoothing * weights

    def learn(self, new: list[str]) -> None:
        """Add the lattices of different chunks that are not remembered, many at once."""
        ends, start = np.cumsum([len(c) + 2 for c in new]), 0
        while start < len(new):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + LEARN_BLOCK)))
            self._learn(new[start:stop])
            start = stop

    def _learn(self, new: list[str]) -> None:
        whole = "".join([f"{_SPACE}{c}\0" for c in new])
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(c) + 2 for c in new])
        ends = np.cumsum(sizes) - 1  # the end nodes
        codes[ends] = _END
        left = np.repeat(ends, sizes) - np.arange(len(codes))
        base, edges = self.nodes, self.edges
        self.chunks.update(zip(new, (base + ends + 1 - sizes).tolist()))
        held, node, length, piece, weight = self._edges(codes, left)
        # Log of the summed weights of all ways from a node to the end of its chunk, from the end backwards: nodes as far
        # from their ends go together.
        to = node + length
        behind = np.repeat(left, held)
        by_left = np.argsort(behind.astype(np.uint16 if len(left) < 1 << 16 else np.uint32), kind="stable")
        own, onto, ahead = node.take(by_left), to.take(by_left), weight.take(by_left)
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        starts = np.unique(np.append(0, np.cumsum(np.bincount(behind))))
        cuts, repeats, owners = np.searchsorted(heads, starts).tolist(), np.diff(np.append(heads, len(own))), own[heads]
        total, starts = np.zeros(len(codes)), starts.tolist()
        for a, b, x, y in zip(starts, starts[1:], cuts, cuts[1:]):
            ways, groups = ahead[a:b] + total.take(onto[a:b]), heads[x:y] - a
            top = np.maximum.reduceat(ways, groups)
            spread = np.exp(ways - np.repeat(top, repeats[x:y]))
            total[owners[x:y]] = top + np.log(np.add.reduceat(spread, groups))
        sure = np.minimum(0.0, weight + total.take(to) - np.repeat(total, held))
        odds = np.exp(sure)
        after = np.cumsum(held)
        first, some = after - held, held > 0
        run = np.cumsum(odds)
        upto = run - np.repeat(run[first[some]] - odds[first[some]], held[some])
        upto[after[some] - 1] = 2.0
        target = np.where(behind > length, to + base, -1)
        self._put("first", base, first + edges)
        for name, part in (("target", target), ("piece", piece), ("sure", sure), ("upto", upto)):
            self._put(name, edges, part)
        self.nodes, self.edges = base + len(codes), edges + len(node)

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """The first nodes of the chunks of each text; lattices that are not remembered are made."""
        plain = [i for i, t in enumerate(texts) if _plain(t)]
        odd = [i for i, t in enumerate(texts) if not _plain(t)]
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        others = [self.split(texts[i]) for i in odd]
        flat = pa.concat_arrays([lists.flatten(), pa.array([c for chunks in others for c in chunks], pa.string())]).dictionary_encode()
        different = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.edges > CACHED_EDGES:
            self.clear()
        self.learn([c for c in different if c not in self.chunks])
        nodes = np.array([self.chunks[c] for c in different], np.int64)[flat.indices.to_numpy()]
        sizes = [*pc.list_value_length(lists).to_pylist(), *map(len, others)]
        out = [nodes[:0]] * len(texts)
        for i, end, size in zip([*plain, *odd], np.cumsum(sizes, dtype=np.int64).tolist(), sizes):
            out[i] = nodes[end - size:end]
        return out

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One random path from each node to the end of its chunk: its edges, walker after walker, and how many each took."""
        walker, counts, found = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), []
        while len(walker):
            u = _uniform(keys, len(found))
            edge = self.first.take(nodes)
            over = np.flatnonzero(u >= self.upto.take(edge))
            while len(over):
                edge[over] = further = edge.take(over) + 1
                over = over[u.take(over) >= self.upto.take(further)]
            found.append((walker, edge))
            counts[walker] = len(found)
            nodes = self.target.take(edge)
            on = np.flatnonzero(nodes >= 0)
            walker, nodes, keys = walker.take(on), nodes.take(on), keys.take(on)
        starts = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int32)
        for step, (walker, edge) in enumerate(found):
            edges[starts.take(walker) + step] = edge
        return edges, counts

    def others(self, edge: int, out: frozenset[int]) -> list[int]:
        """Edges of the same node, without those that are ruled out."""
        node = int(np.searchsorted(self.first[:self.nodes], np.int32(edge), side="right")) - 1  # behind ends of chunks, which have none
        end = self.first[node + 1]  # a node that has edges is not the last
        return [e for e in range(int(self.first[node]), int(end)) if e not in out]

    def numbers(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """The pieces of each path."""
        ends = np.cumsum([len(p) for p in paths], dtype=np.int64)
        pieces = self.piece[np.concatenate(paths)] if paths else self.piece[:0]
        spelled = np.flatnonzero(pieces < 0)
        if len(spelled):
            raw = self.fallback[-pieces[spelled] - 1]
            sizes = np.ones(len(pieces), np.int64)
            sizes[spelled] = (raw >= 0).sum(axis=1)
            pieces = np.repeat(pieces, sizes)
            pieces[pieces < 0] = raw[raw >= 0]
            ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
        return [pieces[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


class _Search:
    """The best-first search in the segmentations of one text."""

    def __init__(self, lattices: Lattices, nodes: np.ndarray, key: np.ndarray, drawn: np.ndarray, wanted: int) -> None:
        self.lattices, self.nodes, self.key, self.ready, self.wanted = lattices, nodes, key, drawn, wanted
        self.open: list[tuple] = []    # (maximum, path, place of the first free piece, pieces ruled out there, log p before)
        self.done: list[tuple] = []    # (maximum, path, log p)
        self.drawn = 0

    def _numbers(self, n: int) -> np.ndarray:
        """The next n uniform numbers of this text."""
        start, self.drawn = self.drawn, self.drawn + n
        if self.drawn <= len(self.ready):
            return self.ready[start:self.drawn]
        return _uniform(np.repeat(self.key, n), np.arange(start, self.drawn))

    def begin(self) -> float:
        """The maximum over all segmentations."""
        return float(-np.log(-np.log(self._numbers(1)[0])))

    def accept(self, maximum: float, path: np.ndarray, log_p: float, aside: list[tuple[float, int, float]]) -> None:
        """Emit a path, and hold the sets it left aside: (maximum, place of the free piece, log p before it)."""
        self.done.append((maximum, path, log_p))
        self._hold((top, path, place, frozenset([int(path[place])]), ahead) for top, place, ahead in aside)

    def _hold(self, entries) -> None:
        self.open += [e for e in entries if e[0] > -math.inf]
        self.open.sort(key=lambda e: -e[0])
        del self.open[self.wanted:]

    def turn(self) -> tuple | None:
        """Open the best set: (maximum, beginning of the path with its first free piece, place behind it, log p of it)."""
        if len(self.done) >= self.wanted or not self.open:
            return None
        top, path, place, out, before = self.open.pop(0)
        left = self.lattices.others(int(path[place]), out)
        odds = [math.exp(x) for x in self.lattices.sure[left].tolist()]
        u_edge, u_rest = self._numbers(2).tolist()
        pick, u_edge = 0, u_edge * sum(odds)
        while pick < len(left) - 1 and u_edge >= odds[pick]:
            u_edge -= odds[pick]
            pick += 1
        chosen, others = left[pick], sum(odds[:pick] + odds[pick + 1:])
        if others > 0:
            rest = _below(np.array([before + math.log(others)]), top, np.array([u_rest]))
            self._hold([(float(rest[0]), path, place, out | {chosen}, before)])
        return top, np.append(path[:place], chosen), place + 1, before + float(self.lattices.sure[chosen])

    def result(self) -> list[tuple]:
        """(path, log p, perturbed log p, inclusion) of each segmentation; inclusion is the probability that it is among the
        sampled, given the largest value that is not: 1 where all segmentations are."""
        threshold = self.open[0][0] if self.open else -math.inf
        return [(path, p, top, 1.0 if threshold == -math.inf else float(-np.expm1(-np.exp(min(p - threshold, 700.0)))))
                for top, path, p in self.done]


def _smallest(values: np.ndarray, own: np.ndarray, owners: int, wanted: int) -> np.ndarray:
    """Places of the `wanted` smallest finite values of each owner; values of an owner are neighbours."""
    sizes = np.bincount(own, minlength=owners)
    starts, left, found = (np.cumsum(sizes) - sizes)[sizes > 0], values.copy(), []
    for _ in range(min(wanted, int(sizes.max(initial=0)))):
        least = np.minimum.reduceat(left, starts)
        if not np.isfinite(least).any():
            break
        here = np.flatnonzero((left == np.repeat(least, sizes[sizes > 0])) & (left < np.inf))
        here = here[np.diff(own[here], prepend=-1) > 0]  # of equal values the first
        found.append(here)
        left[here] = np.inf
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _left_aside(lattices: Lattices, edges: np.ndarray, ends: np.ndarray, turns: list[tuple], turn: int, wanted: int
                ) -> tuple[list[list[tuple[float, int, float]]], list[float]]:
    """For the walks of all texts at once: the best sets that each left aside, and the log probability of its path.

    Places before which a path has less than exp(-FAINT) of the mass of its set are beyond what a double can tell.
    """
    counts = np.diff(ends, prepend=0)
    first = ends - counts
    begun = np.array([t[4] for t in turns])
    sure = lattices.sure[edges]
    run = np.concatenate([[0.0], np.cumsum(sure)])
    owner = np.repeat(np.arange(len(turns)), counts)
    within = run[:-1] - run[first][owner]
    log_p = (run[ends] - run[first] + begun).tolist()
    near = np.flatnonzero(within >= -FAINT)
    own, within = owner[near], within[near]
    # A Gumbel number is minus the log of an exponential one over its mass, so the largest are the first to come.
    place = near - first[own]
    keys = np.concatenate([t[0].key for t in turns])
    drawn = -np.log(_uniform(keys[own], place + ((turn + 1) << 32)))
    with np.errstate(divide="ignore"):
        times = drawn / (np.exp(within) * (0.0 - np.expm1(sure[near])))  # where nothing else leaves a node: never
    few = _smallest(times, own, len(turns), wanted)
    own, within, place = own[few], within[few] + begun[own[few]], place[few]
    maxima = -np.logaddexp(-np.array([t[1] for t in turns])[own], np.log(times[few]) - begun[own])
    aside: list[list[tuple[float, int, float]]] = [[] for _ in turns]
    for i, top, at, ahead in zip(own.tolist(), maxima.tolist(), place.tolist(), within.tolist()):
        aside[i].append((top, turns[i][3] + at, ahead))
    return aside, log_p


def segmentations(lattices: Lattices, texts: list[str], keys: list[str], wanted: int, seed: int) -> list[list[tuple]]:
    """(pieces, log p, perturbed log p, inclusion) of up to `wanted` segmentations of each text, best first.

    Each text is a function of itself, its key and the seed alone. The walks of all texts go in step.
    """
    nodes = lattices.places(texts)
    hashed = np.array([xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), seed) for key in keys], dtype=np.uint64)
    drawn = _uniform(hashed[:, None], np.arange(DRAWN)) if keys else []
    searches = [_Search(lattices, own, hashed[i:i + 1], drawn[i], wanted) for i, own in enumerate(nodes)]
    turns = [(s, s.begin(), np.empty(0, np.int64), 0, 0.0) for s in searches]
    turn = 0
    while turns:
        starts, before = [], []
        for search, _, path, place, _ in turns:
            # Chunks behind the fixed beginning; the last fixed piece may end inside its chunk.
            inside = int(lattices.target[path[place - 1]]) if place else -1
            ended = int((lattices.target[path[:place]] < 0).sum())
            starts.append(search.nodes[ended:] if inside < 0 else np.concatenate([[inside], search.nodes[ended + 1:]]))
            before.append(ended)
        sizes = np.array([len(own) for own in starts])
        to = np.cumsum(sizes)
        places = np.arange(to[-1]) + np.repeat(np.array(before) - (to - sizes), sizes)
        text_keys = np.repeat(np.concatenate([t[0].key for t in turns]), sizes)
        counted = (places + ((turn + 1) << 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        edges, steps = lattices.walk(np.concatenate(starts), _mix(text_keys + counted))
        ends = np.concatenate([[0], np.cumsum(steps)])[to]
        aside, log_p = _left_aside(lattices, edges, ends, turns, turn, wanted)
        again = []
        for i, ((search, top, path, place, before), piece) in enumerate(zip(turns, np.split(edges, ends[:-1]))):
            # What the fixed beginning left aside is held already; the free piece's own set too.
            search.accept(top, np.concatenate([path, piece]) if place else piece, log_p[i], aside[i])
            following = search.turn()
            if following:
                again.append((search, *following))
        turns, turn = again, turn + 1
    results = [s.result() for s in searches]
    ids = iter(lattices.numbers([way[0] for ways in results for way in ways]))
    return [[(next(ids), *way[1:]) for way in ways] for ways in results]


def decode_pieces(ids: list[int] | np.ndarray, texts: np.ndarray) -> str:
    """The text of pieces: their bytes, without the space that encoding puts first."""
    return b"".join(texts[np.asarray(ids, dtype=np.int64)].tolist())[1:].decode("utf-8", "replace")


def _restored(flat: np.ndarray, ends: np.ndarray, spelled: pa.Array, texts: list[str | None]) -> list[bool | None]:
    """Whether pieces, one list behind the other, decode to their texts; null for null."""
    taken = spelled.take(pa.array(flat))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64, len(flat) + 1)[ends].tolist()
    whole = memoryview(data) if data else b""
    return [None if t is None else bytes(whole[a:b])[1:] == t.encode() for t, a, b in zip(texts, at, at[1:])]


def encode(df: DataFrame, key: str, text: str, samples: int = SAMPLES, model: str = MODEL, smoothing: float = SMOOTHING,
           seed: int = SEED) -> DataFrame:
    """(key, rank, ids, log_prob, perturbed, inclusion, restored) for each sampled segmentation of each row.

    Up to `samples` different segmentations, ranked from 0 by perturbed log probability; fewer only where the text has
    fewer. `restored` says whether decoding gives the text back: always, but for texts that hold U+2581, which the
    vocabulary uses for a space. An empty text has one segmentation, of no pieces; a null text gives one row with null
    ids. Rows that share key and text get the same segmentations; a null key is hashed as the text `null`. An empty table
    gives no rows. Whole texts are encoded, however long; rows never meet, so there is no shuffle. Only the driver reads
    the model; tasks get its pieces.
    """
    vocabulary = Vocabulary.read(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, spelled = Lattices(vocabulary, smoothing), pa.array(vocabulary.texts().tolist(), pa.large_binary())

        def flush(keys: list, texts: list[str | None]) -> pa.RecordBatch:
            places = [i for i, t in enumerate(texts) if t is not None]
            found = segmentations(lattices, [texts[i] for i in places], ["null" if keys[i] is None else str(keys[i]) for i in places],
                                  samples, seed)
            rows = [(i, None, None, None, None, None) for i, t in enumerate(texts) if t is None]
            rows += [(i, rank, *way) for i, ways in zip(places, found) for rank, way in enumerate(ways)]
            ids = [r[2] for r in rows]
            ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids], dtype=np.int64)])
            flat = np.concatenate([np.empty(0, np.int32), *(x for x in ids if x is not None)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([x is None for x in ids] + [False])),
                                             pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[r[0]] for r in rows], kind), pa.array([r[1] for r in rows], pa.int32()), lists,
                 *(pa.array([r[j] for r in rows], pa.float64()) for j in (3, 4, 5)),
                 pa.array(_restored(flat, ends, spelled, [texts[r[0]] for r in rows]), pa.bool_())],
                ["key", "rank", "ids", "log_prob", "perturbed", "inclusion", "restored"])

        kind, keys, texts, held = None, [], [], 0
        for batch in source:
            kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0), batch.column(1)):
                keys.append(k.as_py())
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held > TEXT_BLOCK:
                    yield flush(keys, texts)
                    keys, texts, held = [], [], 0
        if keys:
            yield flush(keys, texts)

    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(batches, f"key {df.schema[key].dataType.simpleString()}, rank int, ids array<int>, log_prob double, "
                             "perturbed double, inclusion double, restored boolean")


def decode(df: DataFrame, ids: str, out: str = "text", model: str = MODEL) -> DataFrame:
    """The rows of `df` with `out`: the text of the pieces in `ids`; null for null. A column of that name is replaced."""
    vocabulary = Vocabulary.read(model)
    kept = [c for c in df.columns if c != out]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = vocabulary.texts()
        for batch in source:
            texts = [None if x is None else decode_pieces(x, spelled) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    rows = df.select(F.struct("*").alias("row"), F.col(ids).alias("ids"))
    back = rows.mapInArrow(batches, f"row {rows.schema['row'].dataType.simpleString()}, decoded string")
    return back.select(*(F.col("row")[c].alias(c) for c in kept), F.col("decoded").alias(out))


def document_pieces(documents: DataFrame) -> DataFrame:
    """The sampled segmentations of every document; the pieces of each as number and hash."""
    found = encode(documents.select("doc_id", "text"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "rank", F.size("ids").alias("n_pieces"),
                        F.xxhash64("ids").alias("ids_hash"),
                        "log_prob", "perturbed", "inclusion", "restored")
