"""Piece lattices over the characters of a text, and samples of distinct segmentations from them.

Pure numpy helpers for a bounded batch of texts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import sentencepiece
import xxhash

SPACE = 0x2581
CODE_BITS = 21
PAIR_BITS = 20
NO_PIECE = -1


class Pieces:
    """The pieces of a SentencePiece model as a tree over code points, with a log probability each.

    A model of merges has ranks, not probabilities: a piece of rank r gets the weight 1 / (r + 2) to the power of
    `sharpness`, normalised over all pieces. A character without a piece is spelled in UTF-8 byte pieces.
    """

    def __init__(self, path: str, sharpness: float = 1.0) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        rank = np.full(size, float(size))
        rank[plain] = [max(0.0, -model.get_score(i)) for i in plain]
        weight = (rank + 2.0) ** -sharpness
        self.log_p = np.log(weight / weight.sum())
        self.bytes_id = np.full(256, NO_PIECE, np.int64)
        self.text: list[bytes] = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.bytes_id[value], self.text[i] = i, bytes([value])
        # a literal U+2581 in a text is spelled in bytes, as its piece stands for a space
        strings = {i: [ord(c) for c in model.id_to_piece(i)] for i in plain}
        for i, codes in strings.items():
            self.text[i] = "".join(" " if c == SPACE else chr(c) for c in codes).encode()
        states: dict[tuple[int, int], int] = {}
        piece_of = [NO_PIECE]
        self.joined = np.zeros(1 << PAIR_BITS, bool)
        for i, codes in strings.items():
            state = 0
            for code in codes:
                state = states.setdefault((state, code), len(states) + 1)
                if state == len(piece_of):
                    piece_of.append(NO_PIECE)
            piece_of[state] = i
            pair = np.array(codes, np.int64)
            self.joined[self._pair(pair[:-1], pair[1:])] = True
        keys = np.array([(s << CODE_BITS) | c for s, c in states], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(states.values()), np.int64)[order]
        self.piece_of = np.array(piece_of, np.int64)
        self.first = np.full(1 << 16, NO_PIECE, np.int64)
        for (state, code), target in states.items():
            if state == 0 and code < 1 << 16:
                self.first[code] = target

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left * 0x9E3779B1 + right * 0x85EBCA6B) >> 9) & ((1 << PAIR_BITS) - 1)

    def codes(self, text: str) -> np.ndarray:
        """Code points with spaces as the mark and one before the text; a literal mark becomes -1."""
        found = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        found = np.where(found == SPACE, -1, np.where(found == 0x20, SPACE, found))
        return np.concatenate([[SPACE], found]) if len(found) else found

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Which characters start a unit: no piece reaches over a pair of characters that no piece has inside."""
        return np.concatenate([[True], ~self.joined[self._pair(codes[:-1], codes[1:])]])

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next tree state, or -1."""
        key = (state << CODE_BITS) | np.maximum(code, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (code >= 0), self.next[at], -1)

    def step_first(self, code: np.ndarray) -> np.ndarray:
        small = (code >= 0) & (code < 1 << 16)
        found = np.where(small, self.first[np.where(small, code, 0)], -1)
        wide = np.flatnonzero(~small & (code >= 0))
        if len(wide):
            found[wide] = self.step(np.zeros(len(wide), np.int64), code[wide])
        return found

    def spelled(self, code: int) -> list[int]:
        """The byte pieces of a character without a piece."""
        return [int(self.bytes_id[b]) for b in chr(SPACE if code < 0 else code).encode()]


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64."""
    found = np.full(n, base, np.uint64)
    found[:1] = 1
    return np.cumprod(found, dtype=np.uint64, out=found)


@dataclass
class Lattice:
    """The lattices of the distinct units of a batch.

    A node is a place in a unit; its edges are the pieces that start there, `edge_count` from `edge_first` on. `cdf`
    has the running shares of a node's edges in the exact distribution over segmentations of the rest of
    its unit, `log_share` the log of each share. `target` is the node after an edge, -1 at the end of the unit.
    """

    unit_of: np.ndarray
    start: np.ndarray
    edge_first: np.ndarray
    edge_count: np.ndarray
    cdf: np.ndarray
    log_share: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    node: np.ndarray
    last: np.ndarray
    code: np.ndarray


def _distinct(codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first unit of each kind, kind of each unit) of the units between cuts, by hash, then verified."""
    lengths = np.diff(np.concatenate([cuts, [len(codes)]]))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + 2).astype(np.uint64) * _powers(_BASE, len(codes)), dtype=np.uint64, out=sums[1:])
    hashes = (sums[cuts + lengths] - sums[cuts]) * _powers(_INVERSE, len(codes))[cuts] * np.uint64(129) + lengths.astype(np.uint64)
    order = np.argsort(hashes)
    new = np.concatenate([[True], np.diff(hashes[order]) != 0])
    sample = order[new]
    kind = np.empty(len(cuts), np.int64)
    kind[order] = np.cumsum(new) - 1
    same = lengths == lengths[sample][kind]
    spot = np.arange(len(codes)) - np.repeat(cuts - cuts[sample][kind], lengths)
    if same.all() and (codes[spot] == codes).all():
        return sample, kind
    return np.arange(len(cuts)), np.arange(len(cuts))  # two units of one hash: share nothing


def _edges(pieces: Pieces, code: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, pieces) of the edges of each size from 1 on, nodes ascending; characters without a piece have NO_PIECE."""
    state, at = pieces.step_first(code), np.arange(len(code))
    found = np.where(state >= 0, pieces.piece_of[np.maximum(state, 0)], NO_PIECE)
    result = [(at, found)]
    alive = (state >= 0) & (left > 1)
    at, state, size = at[alive], state[alive], 1
    while len(at):
        state = pieces.step(state, code[at + size])
        on = state >= 0
        at, state, size = at[on], state[on], size + 1
        found = pieces.piece_of[state]
        ends_here = found >= 0
        result.append((at[ends_here], found[ends_here]))
        more = left[at] > size
        at, state = at[more], state[more]
    return result


def build(pieces: Pieces, codes: np.ndarray, cuts: np.ndarray) -> Lattice:
    """Lattices of all units of a batch of code points; equal units share one."""
    sample, unit_of = _distinct(codes, cuts)
    lengths = np.diff(np.concatenate([cuts, [len(codes)]]))[sample]
    start = np.cumsum(lengths) - lengths
    nodes = int(lengths.sum())
    code = codes[np.repeat(cuts[sample] - start, lengths) + np.arange(nodes)]
    left = np.repeat(start + lengths, lengths) - np.arange(nodes)
    by_size = _edges(pieces, code, left)
    count = np.zeros(nodes, np.int64)
    for at, _ in by_size:
        count[at] += 1
    # edges lie by the characters left, so that the shares of shorter ends are known first
    order = np.argsort(left, kind="stable")
    first = np.empty(nodes, np.int64)
    ends = np.cumsum(count[order])
    first[order] = ends - count[order]
    total = int(ends[-1])
    node, size, piece = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    used = np.zeros(nodes, np.int64)
    for k, (at, found) in enumerate(by_size):
        spot = first[at] + used[at]
        used[at] += 1
        node[spot], size[spot], piece[spot] = at, k + 1, found
    value = pieces.log_p[np.maximum(piece, 0)]
    for k in np.flatnonzero(piece < 0):
        value[k] = pieces.log_p[pieces.spelled(int(code[node[k]]))].sum()
    target = np.where(size < left[node], node + size, -1)
    beta = np.zeros(nodes + 1)  # the last place stands for the end of any unit
    remaining = left[order]
    groups = np.flatnonzero(np.concatenate([[True], np.diff(remaining) != 0]))
    running = np.empty(total)
    for a, b in zip(groups, np.concatenate([groups[1:], [nodes]])):
        heads = order[a:b]
        low, high = first[heads[0]], ends[b - 1]
        inner, n = first[heads] - low, count[heads]
        x = value[low:high] + beta[target[low:high]]
        top = np.maximum.reduceat(x, inner)
        weight = np.exp(x - np.repeat(top, n))
        mass = np.add.reduceat(weight, inner)
        beta[heads] = top + np.log(mass)
        value[low:high] = x - np.repeat(beta[heads], n)
        summed = np.cumsum(weight)
        before = summed[inner] - weight[inner]
        running[low:high] = (summed - np.repeat(before, n)) / np.repeat(mass, n)
    last = np.zeros(total, bool)
    last[first + count - 1] = True
    return Lattice(unit_of, start, first, count, running, np.minimum(value, 0.0), target, piece, node, last, code)


def _uniform(key: np.ndarray, sample: np.ndarray | int, unit: np.ndarray, step: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1), of 32 bits, named by the row key, sample, unit of the row and step."""
    z = np.atleast_1d(key) + np.atleast_1d(np.asarray(sample, np.uint64)) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)
    z = z + unit.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + step.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.float64) * 2.0**-32 + 2.0**-33


#: No noise of `_uniform` lifts a branch more than this over its log probability.
MOST_NOISE = 23.0
STEPS_AT_ONCE = 256
#: Salts: which edge is drawn, the noise of the branches, and both again for a step that was opened before.
DRAW, NOISE, DRAW_AGAIN, NOISE_AGAIN = range(4)


class Path:
    """A segmentation found: its edges, and the branches that leave it, opened only as far as they can matter."""

    def __init__(self, edges: np.ndarray, owner: np.ndarray, at: np.ndarray, value: float, sample: int) -> None:
        self.edges, self.owner, self.at, self.value, self.sample = edges, owner, at, value, sample
        self.log_p = 0.0
        self.opened = 0
        self.ahead = 0.0
        self.taken: dict[int, tuple[int, ...]] = {}
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []  # first step, branch values, log probabilities before


class Search:
    """The best segmentations of one text under independent Gumbel noise, in falling order, without listing them.

    Segmentations are the leaves of a tree of choices, unit by unit and piece by piece. The largest noisy value
    below a node is Gumbel distributed around the node's log probability; one child of a node inherits it and the others'
    values are drawn below it. A best-first search that opens the branch with the largest value, its exact
    bound, so meets the segmentations in falling order: a sample without replacement. Branches late in
    a path wait behind an upper bound until that bound leads.
    """

    def __init__(self, lattice: Lattice, key: int) -> None:
        self.lattice, self.key = lattice, np.uint64(key)
        self.heap: list[tuple[float, int, int]] = []
        self.paths: list[Path] = []

    def add(self, path: Path, since: int = 0, ahead: float = 0.0) -> None:
        """Take in a path whose branches before step `since` belong to the path it left."""
        path.log_p = float(self.lattice.log_share[path.edges].sum())
        path.opened, path.ahead = since, ahead
        self.paths.append(path)
        for part in range(len(path.parts)):
            self._offer(len(self.paths) - 1, part)
        self._wait(len(self.paths) - 1)

    def _wait(self, number: int) -> None:
        path = self.paths[number]
        if path.opened < len(path.edges):
            heapq.heappush(self.heap, (-min(path.value, path.ahead + MOST_NOISE), number, -1))

    def _open(self, number: int) -> None:
        path = self.paths[number]
        a, b = path.opened, min(len(path.edges), path.opened + STEPS_AT_ONCE)
        logs = self.lattice.log_share[path.edges[a:b]]
        ahead = path.ahead + np.cumsum(logs) - logs
        u = _uniform(self.key, path.sample, path.owner[a:b], path.at[a:b], NOISE)
        with np.errstate(divide="ignore"):
            values = -np.logaddexp(-path.value, np.log(-np.log(u)) - ahead - np.log(-np.expm1(logs)))
        path.opened, path.ahead = b, path.ahead + float(logs.sum())
        path.parts.append((a, values, ahead))
        self._offer(number, len(path.parts) - 1)
        self._wait(number)

    def _offer(self, number: int, part: int) -> None:
        """The best branch of a part that is still there."""
        top = float(self.paths[number].parts[part][1].max())
        if top > -np.inf:
            heapq.heappush(self.heap, (-top, number, part))

    def lead(self) -> tuple[float, int, int] | None:
        """(value, path, part) of the best branch, or None when every segmentation was met."""
        while self.heap and self.heap[0][2] < 0:
            self._open(heapq.heappop(self.heap)[1])
        return (-self.heap[0][0], *self.heap[0][1:]) if self.heap else None

    def split(self, sample: int) -> tuple[Path, int, int] | None:
        """The beginning of the next best path, whose rest is still to be drawn, with the step and edge where it leaves."""
        best = self.lead()
        if best is None:
            return None
        heapq.heappop(self.heap)
        value, number, part = best
        lattice, path = self.lattice, self.paths[number]
        first, values, ahead = path.parts[part]
        spot = int(values.argmax())
        t, before = first + spot, float(ahead[spot])
        values[spot] = -np.inf
        self._offer(number, part)
        taken = path.taken.get(t, (int(path.edges[t]),))
        node = int(lattice.node[path.edges[t]])
        edges = np.arange(lattice.edge_first[node], lattice.edge_first[node] + lattice.edge_count[node])
        rest = edges[~np.isin(edges, taken)]
        running = np.cumsum(np.exp(lattice.log_share[rest]))
        here = path.owner[t : t + 1], path.at[t : t + 1]
        edge = int(rest[min(int(np.searchsorted(running, running[-1] * _uniform(self.key, sample, *here, DRAW_AGAIN)[0])), len(rest) - 1)])
        new = Path(np.append(path.edges[:t], edge), path.owner[: t + 1], path.at[: t + 1], value, sample)
        new.taken[t] = (*taken, edge)
        others = rest[rest != edge]
        if len(others):
            mass = before + float(np.log(np.exp(lattice.log_share[others]).sum()))
            noise = np.log(-np.log(_uniform(self.key, sample, *here, NOISE_AGAIN)))
            new.parts.append((t, -np.logaddexp(-value, noise - mass), np.array([before])))
        return new, t, edge


def _walk(lattice: Lattice, keys: np.ndarray, samples: np.ndarray, units: np.ndarray, local: np.ndarray, nodes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws the rest of each of some units from a node on: edges and their steps in order, and edges per unit."""
    count, began = np.zeros(len(units), np.int64), steps
    found, active = [], np.arange(len(units))
    while len(active):
        u = _uniform(keys[active], samples[active], local[active], steps, DRAW)
        edge = lattice.edge_first[nodes]
        over = np.flatnonzero((lattice.cdf[edge] < u) & ~lattice.last[edge])
        while len(over):  # a node has few edges
            edge[over] += 1
            over = over[(lattice.cdf[edge[over]] < u[over]) & ~lattice.last[edge[over]]]
        found.append((active, edge))
        count[active] += 1
        nodes = lattice.target[edge]
        on = nodes >= 0
        active, nodes, steps = active[on], nodes[on], steps[on] + 1
    place = np.cumsum(count) - count
    edges, at = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
    for turn, (active, edge) in enumerate(found):
        edges[place[active] + turn], at[place[active] + turn] = edge, began[active] + turn
    return edges, at, count


def best_segmentations(lattice: Lattice, bounds: np.ndarray, keys: list[int], k: int) -> list[tuple[list[Path], float]]:
    """For each text (units bounds[i] to bounds[i + 1]): up to k paths in falling order, and the next value, the threshold.

    The rests of all texts' paths are drawn together, one sample after the other.
    """
    searches = [Search(lattice, key) for key in keys]
    all_keys = np.array(keys, np.uint64)
    zero = np.zeros(1, np.int64)
    starts: list[tuple[int, Path, int, int, int]] = []  # (text, path so far, first unit, node, step)
    for i, key in enumerate(keys):
        if bounds[i + 1] > bounds[i]:
            value = float(-np.log(-np.log(_uniform(np.uint64(key), 0, zero, zero, NOISE_AGAIN)[0])))
            starts.append((i, Path(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), value, 0), 0, int(lattice.start[lattice.unit_of[bounds[i]]]), 0))
    for sample in range(k):
        _finish(lattice, bounds, all_keys, searches, starts)
        starts = []
        if sample + 1 == k:
            break
        for i, search in enumerate(searches):
            found = search.split(sample + 1)
            if found is not None:
                path, t, edge = found
                unit, node = int(path.owner[t]), int(lattice.target[edge])
                first = (unit, node, int(path.at[t]) + 1) if node >= 0 else (unit + 1, -1, 0)
                starts.append((i, path, *first))
    result = []
    for search in searches:
        lead = search.lead()
        result.append((search.paths, lead[0] if lead else -np.inf))
    return result


def _finish(lattice: Lattice, bounds: np.ndarray, keys: np.ndarray, searches: list[Search], starts: list[tuple[int, Path, int, int, int]]) -> None:
    """Draw the rests of all begun paths at once and hand them to their searches."""
    texts = np.array([s[0] for s in starts], np.int64)
    firsts = np.array([s[2] for s in starts], np.int64)
    sizes = bounds[texts + 1] - bounds[texts] - firsts
    ends = np.cumsum(sizes)
    local = np.arange(int(sizes.sum())) - np.repeat(ends - sizes - firsts, sizes)
    units = local + np.repeat(bounds[texts], sizes)
    nodes = lattice.start[lattice.unit_of[units]]
    steps = np.zeros(len(units), np.int64)
    for (_, _, _, node, step), at, n in zip(starts, (ends - sizes).tolist(), sizes.tolist()):
        if n and node >= 0:
            nodes[at], steps[at] = node, step
    samples = np.repeat(np.array([s[1].sample for s in starts], np.uint64), sizes)
    edges, at, count = _walk(lattice, np.repeat(keys[texts], sizes), samples, units, local, nodes, steps)
    owner = np.repeat(local, count)
    cut = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], ends])]
    for (i, path, _, _, _), low, high in zip(starts, cut[:-1].tolist(), cut[1:].tolist()):
        since = len(path.edges)
        ahead = float(lattice.log_share[path.edges].sum())
        path.edges = np.concatenate([path.edges, edges[low:high]])
        path.owner, path.at = np.concatenate([path.owner, owner[low:high]]), np.concatenate([path.at, at[low:high]])
        searches[i].add(path, since, ahead)


def row_key(name: object, seed: int) -> int:
    """The random key of a row: the same wherever and whenever it is drawn."""
    return xxhash.xxh64_intdigest(repr(name).encode(), seed)


def edge_ids(pieces: Pieces, lattice: Lattice, edges: np.ndarray) -> np.ndarray:
    """Piece ids of a path, characters without a piece spelled in bytes."""
    found = lattice.piece[edges]
    odd = np.flatnonzero(found < 0)
    if not len(odd):
        return found.astype(np.int32)
    parts, at = [], 0
    for k, node in zip(odd.tolist(), lattice.node[edges[odd]].tolist()):
        parts += [found[at:k], pieces.spelled(int(lattice.code[node]))]
        at = k + 1
    return np.concatenate([*parts, found[at:]]).astype(np.int32)


def decode_ids(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of a segmentation: spaces for marks, without the one that was put before it."""
    raw = b"".join(map(pieces.text.__getitem__, ids.tolist()))
    return (raw[1:] if raw[:1] == b" " else raw).decode()
