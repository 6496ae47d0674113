"""A causal self-attention language model in numpy over classes of token ids.

One attention layer adds to the log shares of a count model and predicts the group of the next id, then its class
within the group; inside a class, ids have smoothed corpus shares. So the probabilities of all ids add up to one, and no
matrix runs over the whole vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GROUPS = 32
MEMBERS = 32
CLASSES = GROUPS * MEMBERS
#: Classes with a single id each; the others share the remaining ids.
OWN = CLASSES * 15 // 16
DEPTH = 16
#: Tokens scored per window; each window also sees as many before them.
BLOCK = 16
LEARNING_RATE = 0.01
BATCH = 64
PRIOR = 15.0
LOG10E = float(np.log10(np.e))
#: Class index that stands before the first id of a text, and as the context of a word's first id.
BEGIN = CLASSES


@dataclass
class Vocabulary:
    """Classes of all ids, and the count model: what follows a class, and an id's share in its class."""

    class_of: np.ndarray
    ends_word: np.ndarray
    log_share: np.ndarray
    group_log: np.ndarray
    member_log: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray, first_counts: np.ndarray, ends_word: np.ndarray) -> Vocabulary:
        """Counts of all ids, and of those that begin a word; the table of successions is empty.

        The most frequent ids have classes of their own; the others are dealt by rank to classes of
        equal mass. Every id counts once more than seen, so each keeps a share.
        """
        order = np.lexsort((np.arange(len(counts)), -counts))
        own = max(1, min(len(counts), OWN))
        class_of = np.empty(len(counts), np.int64)
        class_of[order[:own]] = np.arange(own)
        rest = order[own:]
        smoothed = counts[rest] + 1.0
        mass = np.cumsum(smoothed) - smoothed
        class_of[rest] = own + np.minimum(CLASSES - own - 1, (mass * (CLASSES - own) / max(1.0, smoothed.sum())).astype(np.int64))
        class_of = class_of % GROUPS * MEMBERS + class_of // GROUPS  # neighbours in rank fall into different groups
        share = (counts + 1.0) / np.bincount(class_of, counts + 1.0, minlength=CLASSES)[class_of]
        log_share = np.empty((2, len(counts)))
        for row, n in enumerate((counts - first_counts, first_counts)):
            log_share[row] = np.log10((n + 5.0 * share) / (np.bincount(class_of, n, minlength=CLASSES)[class_of] + 5.0))
        totals = np.bincount(class_of, counts + 1.0, minlength=CLASSES)
        empty = cls(class_of, ends_word, log_share, np.zeros(0), np.zeros(0))
        return empty.with_successions(np.zeros((CLASSES + 1, CLASSES)), totals / totals.sum())

    def with_successions(self, follows: np.ndarray, shares: np.ndarray) -> Vocabulary:
        """The same classes, with how often each class follows each context; thin rows lean on `shares`."""
        joint = (follows + PRIOR * shares).reshape(CLASSES + 1, GROUPS, MEMBERS)
        by_group = joint.sum(2)
        group_log = np.log(np.maximum(by_group, 1e-12) / by_group.sum(1, keepdims=True))
        member_log = np.log(np.maximum(joint, 1e-12) / np.maximum(by_group, 1e-12)[..., None])
        return Vocabulary(self.class_of, self.ends_word, self.log_share, group_log.astype(np.float32), member_log.reshape(-1, MEMBERS).astype(np.float32))

    def contexts(self, before: np.ndarray) -> np.ndarray:
        """The context of the id after each id: its class, or BEGIN when a word ended."""
        return np.where(self.ends_word[before], BEGIN, self.class_of[before])


SHAPES = {
    "embed": (CLASSES + 1, DEPTH), "query": (DEPTH, DEPTH), "key": (DEPTH, DEPTH), "value": (DEPTH, DEPTH), "near": (2 * BLOCK,),
    "group": (DEPTH, GROUPS), "group_bias": (GROUPS,), "member": (GROUPS, DEPTH, MEMBERS), "member_bias": (GROUPS, MEMBERS),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Named views into one flat parameter vector."""
    views, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        views[name] = flat[at : at + size].reshape(shape)
        at += size
    return views


def fresh(seed: int = 7) -> np.ndarray:
    flat = np.random.default_rng(seed).normal(0, 0.3, SIZE).astype(np.float32)
    views = unpack(flat)
    for name, scale in (("near", 0), ("group_bias", 0), ("member_bias", 0), ("group", 0.1), ("member", 0.1)):
        views[name] *= scale
    return flat


_AGE = np.arange(2 * BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def gradient(flat: np.ndarray, vocabulary: Vocabulary, inputs: np.ndarray, contexts: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss of windows (n, 2 * BLOCK) of classes, and its gradient. Targets below 0 do not count."""
    p, grad = unpack(flat), np.zeros_like(flat)
    g = unpack(grad)
    past = _AGE >= 0
    x = p["embed"][inputs]
    q, k, v = x @ p["query"], x @ p["key"], x @ p["value"]
    scale = np.float32(1 / np.sqrt(DEPTH))
    weight = _softmax(np.where(past, q @ k.transpose(0, 2, 1) * scale + p["near"][np.maximum(_AGE, 0)], -np.inf))
    h = x + weight @ v
    counted = np.flatnonzero(targets.ravel() >= 0)
    n = max(1, len(counted))
    goal, context, own = targets.ravel()[counted], contexts.ravel()[counted], h.reshape(-1, DEPTH)[counted]
    goal_group, goal_member = goal // MEMBERS, goal % MEMBERS
    by_group = _softmax(own @ p["group"] + p["group_bias"] + vocabulary.group_log[context])
    at = np.arange(len(goal))
    loss = -float(np.log(np.maximum(by_group[at, goal_group], 1e-30)).sum()) / n
    by_group[at, goal_group] -= 1
    by_group /= np.float32(n)
    g["group"][:], g["group_bias"][:] = own.T @ by_group, by_group.sum(0)
    d_own = by_group @ p["group"].T
    for group in np.unique(goal_group):
        rows = np.flatnonzero(goal_group == group)
        z = own[rows] @ p["member"][group] + p["member_bias"][group] + vocabulary.member_log[context[rows] * GROUPS + group]
        share, here = _softmax(z), np.arange(len(rows))
        loss -= float(np.log(np.maximum(share[here, goal_member[rows]], 1e-30)).sum()) / n
        share[here, goal_member[rows]] -= 1
        share /= np.float32(n)
        g["member"][group], g["member_bias"][group] = own[rows].T @ share, share.sum(0)
        d_own[rows] += share @ p["member"][group].T
    dh = np.zeros((inputs.size, DEPTH), flat.dtype)
    dh[counted] = d_own
    dh = dh.reshape(*inputs.shape, DEPTH)
    dw, dv = dh @ v.transpose(0, 2, 1), weight.transpose(0, 2, 1) @ dh
    ds = weight * (dw - (dw * weight).sum(-1, keepdims=True))
    g["near"][:] = np.bincount(np.maximum(_AGE, 0).ravel(), (ds.sum(0) * past).ravel(), minlength=2 * BLOCK)
    dq, dk = ds @ k * scale, ds.transpose(0, 2, 1) @ q * scale
    flat_x = x.reshape(-1, DEPTH)
    for name, d in (("query", dq), ("key", dk), ("value", dv)):
        g[name][:] = flat_x.T @ d.reshape(-1, DEPTH)
    dx = (dh + dq @ p["query"].T + dk @ p["key"].T + dv @ p["value"].T).reshape(-1, DEPTH)
    order = np.argsort(inputs, axis=None, kind="stable")
    ids = inputs.ravel()[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(ids) != 0])) if len(ids) else np.zeros(0, np.int64)
    if len(ids):
        g["embed"][ids[starts]] = np.add.reduceat(dx[order], starts)
    return loss, grad


def train(flat: np.ndarray, vocabulary: Vocabulary, windows: np.ndarray, epochs: int, seed: int, rate: float = LEARNING_RATE) -> np.ndarray:
    """Adam over windows of 2 * BLOCK + 1 ids in seeded order; -2 is the begin mark, -1 fills up a short window."""
    flat = flat.copy()
    mean, square, step = np.zeros_like(flat), np.zeros_like(flat), 0
    draw = np.random.default_rng(seed)
    known = np.maximum(windows, 0)
    classes = np.where(windows >= 0, vocabulary.class_of[known], BEGIN)
    contexts = np.where(windows >= 0, vocabulary.contexts(known), BEGIN)[:, :-1]
    targets = np.where(windows >= 0, classes, -1)[:, 1:]
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            _, grad = gradient(flat, vocabulary, classes[part, :-1], contexts[part], targets[part])
            step += 1
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            flat -= np.float32(rate) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + np.float32(1e-8))
    return flat


class Scorer:
    """Scores whole texts: windows overlap by half, every token is scored once, with BLOCK tokens or more before it."""

    BLOCKS_AT_ONCE = 384

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray) -> None:
        p = unpack(flat.astype(np.float32))
        self.vocabulary = vocabulary
        self.embed = p["embed"]
        self.query = p["embed"] @ p["query"] * np.float32(1 / np.sqrt(DEPTH))
        self.key = p["embed"] @ p["key"]
        self.value = np.concatenate([p["embed"] @ p["value"], np.ones((CLASSES + 1, 1), np.float32)], axis=1)
        age = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
        near = np.exp(p["near"] - p["near"].max())
        self.mask = np.where(age >= 0, near[np.clip(age, 0, 2 * BLOCK - 1)], 0).astype(np.float32)
        self.p = p
        # no exponent can overflow when the largest products stay small, as they do; else exponents are clipped
        longest = lambda x: float(np.sqrt((x * x).sum(-1)).max())
        state = longest(p["embed"]) + longest(self.value[:, :-1])
        outer = max(longest(p["group"].T), longest(p["member"].transpose(0, 2, 1)))
        self.clipped = longest(self.query) * longest(self.key) > 60 or state * outer + np.abs(p["member_bias"]).max() + np.abs(p["group_bias"]).max() > 80

    def _chunk(self, own: np.ndarray, before: np.ndarray, opens: np.ndarray, goal: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the classes `goal` after the inputs `own` (blocks, BLOCK); `before` is the block before."""
        line = np.concatenate([before, own.ravel()])
        key, value = (self._overlapping(x.take(line, axis=0)) for x in (self.key, self.value))
        weight = self.query.take(own, axis=0) @ key.transpose(0, 2, 1)
        if self.clipped:
            np.minimum(weight, 60, out=weight)
        np.exp(weight, out=weight)
        weight *= self.mask
        weight[opens, :, :BLOCK] = 0
        mixed = weight @ value
        h = (self.embed.take(own, axis=0) + mixed[..., :-1] / mixed[..., -1:]).reshape(-1, DEPTH)
        group = goal // MEMBERS
        z = h @ self.p["group"] + self.p["group_bias"] + self.vocabulary.group_log.take(context, axis=0)
        found = z[np.arange(len(z)), group] - self._log_sum(z)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=GROUPS))
        z = self.vocabulary.member_log.take((context * GROUPS + group)[order], axis=0)
        sorted_h = h.take(order, axis=0)
        start = 0
        for k, end in enumerate(ends.tolist()):
            if end > start:
                z[start:end] += sorted_h[start:end] @ self.p["member"][k] + self.p["member_bias"][k]
            start = end
        found[order] += z[np.arange(len(z)), (goal % MEMBERS)[order]] - self._log_sum(z)
        return found

    def _log_sum(self, z: np.ndarray) -> np.ndarray:
        """Log of the summed exponentials of each row; the shares in every row keep it above zero."""
        return np.log(np.exp(np.minimum(z, 80) if self.clipped else z) @ np.ones(z.shape[1], np.float32))

    @staticmethod
    def _overlapping(rows: np.ndarray) -> np.ndarray:
        """Each block of rows with the block before it, as a view."""
        step, depth = rows.strides
        return np.lib.stride_tricks.as_strided(rows, (len(rows) // BLOCK - 1, 2 * BLOCK, rows.shape[1]), (BLOCK * step, step, depth), writeable=False)

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each id sequence (its end id included); zero for an empty one."""
        lengths = np.array([len(t) for t in texts], np.int64)
        blocks = -(-lengths // BLOCK)
        total = int(blocks.sum())
        if not total:
            return np.zeros(len(texts))
        ids = np.concatenate(texts)
        first = np.cumsum(blocks) - blocks
        ends = np.cumsum(lengths)
        spot = np.arange(len(ids)) + np.repeat(first * BLOCK - (ends - lengths), lengths)
        follows = np.ones(len(ids), bool)
        follows[(ends - lengths)[lengths > 0]] = False
        target = self.vocabulary.class_of[ids]
        last = np.concatenate([[0], ids[:-1]])
        context = np.where(follows, self.vocabulary.contexts(last), BEGIN)
        inputs, goals, around = (np.full(total * BLOCK, fill, np.int32) for fill in (BEGIN, 0, BEGIN))
        inputs[spot[follows]] = self.vocabulary.class_of[last[follows]]
        goals[spot], around[spot] = target, context
        inputs = inputs.reshape(total, BLOCK)
        opens = np.zeros(total, bool)
        opens[first[blocks > 0]] = True
        logp = np.empty(total * BLOCK, np.float32)
        for start in range(0, total, self.BLOCKS_AT_ONCE):
            stop = min(total, start + self.BLOCKS_AT_ONCE)
            own, flat = inputs[start:stop], slice(start * BLOCK, stop * BLOCK)
            before = inputs[max(0, start - 1)]
            logp[flat] = self._chunk(own, before, opens[start:stop], goals[flat], around[flat])
        per_id = logp[spot].astype(np.float64) * LOG10E + self.vocabulary.log_share[(context == BEGIN).astype(np.int8), ids]
        sums = np.concatenate([[0.0], np.cumsum(per_id)])
        return sums[ends] - sums[ends - lengths]
