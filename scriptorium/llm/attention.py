"""A small causal self-attention model on a stream of subword ids, in numpy: forward, backward and Adam.

Texts follow each other in one stream, each closed by the end (slot 0), so what precedes a
text's first id is always an end.  Position t sees itself and the ``CONTEXT`` - 1 positions
before it that belong to the same text, by masked attention with a bias for each distance,
and predicts the id that comes next.

Ids are read and predicted as slots.  The most frequent ids have a slot of their own; all
others share ``REST`` slots, and within a shared slot an id has its add-one frequency in all
training texts.  The softmax has two levels: ``GROUPS`` groups of ``MEMBERS`` slots, by
frequency, and the slots of the group that comes next.  Both see the context.  The
probabilities of all ids and the end together are one.

Windows of ``BLOCK`` queries overlap by ``CONTEXT`` keys; each position is predicted once.
"""

from __future__ import annotations

import numpy as np

BLOCK, CONTEXT = 16, 32
#: Width of vectors and of the hidden layer.
DIM, WIDE = 16, 32
GROUPS = MEMBERS = REST = 32
SLOTS = GROUPS * MEMBERS
SPAN = BLOCK + CONTEXT
#: Positions worked on at once: a few arrays of SPAN numbers for each stay in the cache.
CHUNK = 8192
#: distance from key to query within a window, and where it is allowed
DISTANCE = np.arange(BLOCK)[:, None] + CONTEXT - np.arange(SPAN)[None, :]
ALLOWED = (DISTANCE >= 0) & (DISTANCE < CONTEXT)
CLIPPED = np.clip(DISTANCE, 0, CONTEXT - 1)
FAR = np.float32(-1e9)
SAFE = 60.0
ONES = np.ones(MEMBERS, np.float32)
ONES_OF = lambda n: np.ones(n, np.float32)


def slots_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every id its slot, and the logarithm of its share of the slot."""
    own = SLOTS - 1 - REST
    order = np.lexsort((np.arange(len(counts)), -counts))
    slot = SLOTS - REST + np.arange(len(counts)) % REST
    slot[order[:own]] = 1 + np.arange(min(own, len(counts)))
    smoothed = counts + 1.0
    totals = np.bincount(slot, weights=smoothed, minlength=SLOTS)
    return slot, np.log(smoothed / totals[slot])


def fresh(seed: int, often: np.ndarray) -> dict[str, np.ndarray]:
    """First weights: what follows does not depend on the context, but on how ``often`` a slot is met."""
    draw = np.random.default_rng(seed)
    near = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    smoothed = (np.asarray(often, np.float64) + 1).reshape(GROUPS, MEMBERS)
    groups = smoothed.sum(axis=1)
    return {
        "token": (0.5 * draw.standard_normal((SLOTS, DIM))).astype(np.float32),
        "query": near(DIM, DIM), "key": near(DIM, DIM), "value": near(DIM, DIM), "place": np.zeros(CONTEXT, np.float32),
        "here": near(DIM, WIDE), "there": near(DIM, WIDE), "shift": np.zeros(WIDE, np.float32),
        "group": 0.1 * near(WIDE, GROUPS), "group_bias": np.log(groups / groups.sum()).astype(np.float32),
        "member": 0.1 * near(GROUPS, WIDE, MEMBERS), "member_bias": np.log(smoothed / groups[:, None]).astype(np.float32),
    }


def _windows(x: np.ndarray, fill) -> np.ndarray:
    """Overlapping windows (many, SPAN, ...) of a stream: ``CONTEXT`` before each block of BLOCK."""
    many = -(-len(x) // BLOCK)
    padded = np.full((CONTEXT + many * BLOCK, *x.shape[1:]), fill, x.dtype)
    padded[CONTEXT : CONTEXT + len(x)] = x
    step = padded.strides
    return np.lib.stride_tricks.as_strided(padded, (many, SPAN, *x.shape[1:]), (BLOCK * step[0], *step), writeable=False)


def _fold(windows: np.ndarray, n: int) -> np.ndarray:
    """Sums of what windows hold of each position: the reverse of :func:`_windows`."""
    many, ahead = len(windows), CONTEXT // BLOCK
    total = np.zeros((ahead + many, BLOCK, windows.shape[2]), np.float32)
    for k in range(ahead + 1):
        total[k : k + many] += windows[:, k * BLOCK : (k + 1) * BLOCK]
    return total.reshape(-1, windows.shape[2])[CONTEXT : CONTEXT + n]


class Tables:
    """What each slot contributes as query, key, value and hidden layer, for one state of the weights.

    The scores of a query are at most the longest query times the longest key, and hidden
    values are within one, so logits are at most the sums of their weights.  Where these bounds are
    below ``SAFE``, no exponential overflows and no sum of them vanishes; elsewhere the
    maximum of each row is subtracted first.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        token = weights["token"]
        self.weights = weights
        self.query = token @ (weights["query"] * np.float32(DIM**-0.5))
        self.key = token @ weights["key"]
        self.value = np.concatenate([token @ weights["value"], np.ones((SLOTS, 1), np.float32)], axis=1)  # the last sums the shares
        self.here = token @ weights["here"] + weights["shift"]
        self.mask = np.where(ALLOWED, weights["place"][CLIPPED], FAR).T.copy()
        longest = lambda x: float(np.sqrt((x * x).sum(axis=1).max()))
        self.safe = longest(self.query) * longest(self.key) + float(np.abs(weights["place"]).max()) < SAFE
        reach = lambda name: float((np.abs(weights[name]).sum(axis=-2) + np.abs(weights[f"{name}_bias"])).max())
        self.safe_logits = {name: reach(name) < SAFE for name in ("group", "member")}


def forward(tables: Tables, slot: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The hidden layer at every position of a stream, and what the backward pass needs."""
    n = len(slot)
    keys, values = _windows(tables.key[slot], 0), _windows(tables.value[slot], 1)  # queries behind the stream see ones
    many = len(keys)
    queries = np.zeros((many * BLOCK, DIM), np.float32)
    queries[:n] = tables.query[slot]
    queries = queries.reshape(many, BLOCK, DIM)
    shares = keys @ queries.transpose(0, 2, 1)  # by window, key, query
    shares += tables.mask
    parts = _windows(text, -1)
    mixed = np.flatnonzero(parts[:, 0] != parts[:, -1])  # texts come in runs: the other windows hold one
    if len(mixed):
        shares[mixed] = np.where(parts[mixed][:, :, None] == parts[mixed][:, None, CONTEXT:], shares[mixed], FAR)
    if not tables.safe:
        shares -= shares.max(axis=1, keepdims=True)
    np.exp(shares, out=shares)
    seen = shares.transpose(0, 2, 1) @ values
    total = seen[:, :, DIM:]
    seen = (seen[:, :, :DIM] / total).reshape(-1, DIM)[:n]
    hidden = seen @ tables.weights["there"]
    hidden += tables.here[slot]
    hidden /= 1 + np.abs(hidden)
    return hidden, (keys, values, queries, shares, total, seen)


def _logs(logits: np.ndarray, target: np.ndarray, safe: bool, slopes: bool = False) -> np.ndarray:
    """Logarithm of the target's share in the softmax of each row; with ``slopes`` the rows become the shares, less one at the target."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    at = np.arange(len(target)) * logits.shape[1] + target
    chosen = logits.ravel()[at]
    np.exp(logits, out=logits)
    total = logits @ ONES
    if slopes:
        logits /= total[:, None]
        logits.ravel()[at] -= 1
    return chosen - np.log(total)


def _by_group(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of positions by the group of their targets, and the bounds of each group in it."""
    group = (target // MEMBERS).astype(np.int16)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    return order, [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def predict(tables: Tables, slot: np.ndarray, text: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of every target slot, by chunks that also see the context before them."""
    weights, out = tables.weights, np.empty(len(slot), np.float32)
    for at in range(0, len(slot), CHUNK):
        begin, end = max(0, at - CONTEXT), at + CHUNK
        hidden = forward(tables, slot[begin:end], text[begin:end])[0][at - begin :]
        aim = target[at:end]
        logs = _logs(hidden @ weights["group"] + weights["group_bias"], aim // MEMBERS, tables.safe_logits["group"])
        order, groups = _by_group(aim)
        member, ranked, more = aim[order] % MEMBERS, hidden[order], np.empty_like(logs)
        for g, a, b in groups:
            more[a:b] = _logs(ranked[a:b] @ weights["member"][g] + weights["member_bias"][g], member[a:b], tables.safe_logits["member"])
        logs[order] += more
        out[at:end] = logs
    return out


def _summed(rows: np.ndarray, by: np.ndarray, first: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Sums of rows of equal slots."""
    out = np.zeros((SLOTS, rows.shape[1]), np.float32)
    out[slots] = np.add.reduceat(rows[by], first, axis=0)
    return out


def gradients(weights: dict, slot: np.ndarray, text: np.ndarray, target: np.ndarray) -> tuple[dict, float]:
    """Slopes of the mean loss of a stream by all weights, and the sum of the losses in nats."""
    n, tables, token = len(slot), Tables(weights), weights["token"]
    hidden, (keys, values, queries, shares, total, seen) = forward(tables, slot, text)
    out = {}
    slope = hidden @ weights["group"] + weights["group_bias"]
    loss = -float(_logs(slope, target // MEMBERS, tables.safe_logits["group"], True).sum())
    out["group"], out["group_bias"] = hidden.T @ slope, ONES_OF(n) @ slope
    down = slope @ weights["group"].T
    out["member"], out["member_bias"] = np.zeros_like(weights["member"]), np.zeros_like(weights["member_bias"])
    order, groups = _by_group(target)
    member, ranked, back = target[order] % MEMBERS, hidden[order], np.empty_like(hidden)
    for g, a, b in groups:
        slope = ranked[a:b] @ weights["member"][g] + weights["member_bias"][g]
        loss -= float(_logs(slope, member[a:b], tables.safe_logits["member"], True).sum())
        out["member"][g], out["member_bias"][g] = ranked[a:b].T @ slope, ONES_OF(b - a) @ slope
        back[a:b] = slope @ weights["member"][g].T
    down[order] += back
    left = 1 - np.abs(hidden)
    down *= left
    down *= left
    many = len(keys)
    to_seen = np.zeros((many * BLOCK, DIM + 1), np.float32)
    to_seen[:n, :DIM] = down @ weights["there"].T
    to_seen[:n, DIM] = -np.einsum("ij,ij->i", to_seen[:n, :DIM], seen)
    to_seen = to_seen.reshape(many, BLOCK, DIM + 1)
    to_seen /= total
    to_scores = values @ to_seen.transpose(0, 2, 1)  # the last value, one, takes off what the mean already has
    to_scores *= shares
    to_values = _fold(shares @ to_seen[:, :, :DIM], n)
    to_keys = _fold(to_scores @ queries, n)
    to_queries = (to_scores.transpose(0, 2, 1) @ keys).reshape(-1, DIM)[:n]
    out["place"] = np.bincount(CLIPPED.T.ravel(), weights=np.where(ALLOWED.T, to_scores.sum(axis=0), 0).ravel(), minlength=CONTEXT).astype(np.float32)
    out["there"], out["shift"] = seen.T @ down, ONES_OF(n) @ down
    by = np.argsort(slot.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.diff(slot[by], prepend=-1))
    slots = slot[by[first]]
    out["token"] = np.zeros_like(token)
    for name, found, scale in (("query", to_queries, DIM**-0.5), ("key", to_keys, 1), ("value", to_values, 1), ("here", down, 1)):
        summed = _summed(found, by, first, slots) * np.float32(scale)
        out[name] = token.T @ summed
        out["token"] += summed @ weights[name].T
    return {k: v / np.float32(n) for k, v in out.items()}, loss


class Adam:
    """Steps down the slopes, each weight at its own pace; ``weights`` change in place."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.steps = weights, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, slopes: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        pace = np.float32(rate * (1 - 0.98**self.steps) ** 0.5 / (1 - 0.9**self.steps))
        for k, slope in slopes.items():
            first, second = self.first[k], self.second[k]
            first += np.float32(0.1) * (slope - first)
            second += np.float32(0.02) * (slope * slope - second)
            self.weights[k] -= pace * first / (np.sqrt(second) + np.float32(1e-7))
