"""A causal self-attention model over classes of subwords, in numpy.

The output has two levels: a class is one of a block of classes, and a block is one of `BLOCKS`. Both are softmaxes of the same
hidden vector, so the chances of all classes sum to one, and a position is worked on by its target's block alone.
"""

from __future__ import annotations

import numpy as np

# Each window scores STRIDE positions, which see themselves, what stands before them in the window and CONTEXT earlier positions.
CONTEXT, STRIDE, WIDTH = 16, 48, 32
WINDOW = CONTEXT + STRIDE
# The most frequent subwords are classes of their own; the others share classes by frequency, with and without a word mark.
OWN, SHARED = 224, 32
CLASSES = OWN + SHARED
BLOCKS = 16
BLOCK = CLASSES // BLOCKS
START = CLASSES  # the class of positions before a text
PRIOR = 10  # so many positions weigh as much as what training starts from
BACK = np.float32(5)  # so many sightings in a row of counts weigh as much as the shares it falls back on
_SEE = np.tril(np.ones((STRIDE, WINDOW), np.float32), CONTEXT)


def classes(counts: np.ndarray, marked: np.ndarray, end: int) -> np.ndarray:
    """Class of every subword, from counts over the whole training corpus."""
    weight = counts + 0.5
    order = np.lexsort((np.arange(len(counts)), -counts))
    order = np.concatenate([[end], order[order != end]])
    kind = np.zeros(len(counts), np.int64)
    kind[order[:OWN]] = np.arange(min(OWN, len(order)))
    for half in (0, 1):
        rest = order[OWN:][marked[order[OWN:]] == half]
        mass = np.cumsum(weight[rest])
        share = np.minimum((mass - weight[rest]) / max(mass[-1], 1) * (SHARED // 2), SHARED // 2 - 1) if len(rest) else mass
        kind[rest] = OWN + half * (SHARED // 2) + share.astype(np.int64)
    return kind.astype(np.int16)


def shares(counts: np.ndarray, kind: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the whole training corpus says of a next subword: chance of its class after each class, and log10 of its share in
    its class after each class, both `(CLASSES + 1, ...)`.

    `pairs` are class before, subword and count. A class or subword seldom seen after a class falls back on its share anywhere:
    each row is a mixture of two distributions and sums to one.
    """
    before, piece, n = pairs
    weight = counts + 0.5
    total = np.bincount(kind, weight, CLASSES)
    alone = (weight / total[kind]).astype(np.float32)
    seen = np.bincount(before * CLASSES + kind[piece], n, (CLASSES + 1) * CLASSES).reshape(CLASSES + 1, CLASSES)
    chance = (seen + BACK * total / total.sum()) / (seen.sum(1, keepdims=True) + BACK)
    inside = np.zeros((CLASSES + 1, len(counts)), np.float32)
    inside[before, piece] = n
    for row, some in zip(inside, seen.astype(np.float32), strict=True):
        row += BACK * alone
        row /= some[kind] + BACK
        np.log10(row, out=row)
    return chance, inside


def start(chance: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters before training: small weights, always the same, and the chance of each block and class after each as bias."""
    draw = np.random.default_rng(7)
    new = lambda *size: (draw.standard_normal(size) * 0.3 / np.sqrt(size[0])).astype(np.float32)
    log = lambda x: np.log(np.maximum(x, 1e-9)).astype(np.float32)
    return {
        "second": np.zeros((CLASSES + 1, WIDTH), np.float32), "embed": (draw.standard_normal((CLASSES + 1, WIDTH)) * 0.3).astype(np.float32),
        "place": new(WINDOW, WIDTH), "q": new(WIDTH, WIDTH), "k": new(WIDTH, WIDTH), "v": new(WIDTH, WIDTH), "o": new(WIDTH, WIDTH),
        "out": new(WIDTH, CLASSES), "bias": log(chance), "block": new(WIDTH, BLOCKS), "block_bias": log(chance.reshape(-1, BLOCKS, BLOCK).sum(2))}


def pack(model: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters in one vector."""
    return np.concatenate([x.ravel() for x in model.values()])


def unpack(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters of a vector."""
    cuts = np.cumsum([x.size for x in like.values()])[:-1]
    return {k: x.reshape(like[k].shape).astype(np.float32, copy=False) for k, x in zip(like, np.split(vector, cuts), strict=True)}


def windows(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of joined texts of class ids, ends included: inputs, index of each scored target (-1 for none), the
    window's text. Every target is scored in one window."""
    offsets = np.cumsum(sizes) - sizes
    runs = -(-sizes // STRIDE)
    doc = np.repeat(np.arange(len(sizes)), runs)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)) * STRIDE
    at = first[:, None] + np.arange(WINDOW)[None, :] - CONTEXT  # input i is what stands before target i
    inside = (at >= 1) & (at <= sizes[doc][:, None])
    inputs = np.where(inside, flat[np.clip(offsets[doc][:, None] + at - 1, 0, len(flat) - 1)], START).astype(np.intp)
    goal = first[:, None] + np.arange(STRIDE)[None, :]
    target = np.where(goal < sizes[doc][:, None], offsets[doc][:, None] + goal, -1)
    return inputs, target, doc


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table; `mode` spares numpy a check of every index."""
    return np.take(table, at, axis=0, mode="clip")


def hidden(m: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Batched masked attention over windows; the last array is the hidden vector of each scored position.

    The last class picks rows of the biases; the one before it shifts and scales the last one's vector, as attention alone
    weighs the two but can't join them. Queries, keys and values come of one product.
    """
    x = _rows(m["embed"], inputs)
    x += m["place"]
    xq = x[:, CONTEXT:]
    every = (x.reshape(-1, WIDTH) @ np.hstack([m["q"] * np.float32(WIDTH ** -0.5), m["k"], m["v"]])).reshape(*x.shape[:2], 3 * WIDTH)
    q, k, v = every[:, CONTEXT:, :WIDTH], every[:, :, WIDTH:2 * WIDTH], every[:, :, 2 * WIDTH:]
    a = q @ k.transpose(0, 2, 1)
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= _SEE
    total = (a @ np.ones(WINDOW, a.dtype))[..., None]
    z = a @ v
    z /= total
    y = _rows(m["second"], inputs[:, CONTEXT - 1:-1])
    h = (z.reshape(-1, WIDTH) @ m["o"]).reshape(z.shape)
    h += xq
    h += y
    h += xq * y
    return x, y, q, k, v, a, total, z, h


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """In place, over the last axis; logits are bounded first."""
    np.clip(x, -60, 60, out=x)
    x -= np.log(np.exp(x) @ np.ones(x.shape[-1], x.dtype))[..., None]
    return x


def forward(m: dict[str, np.ndarray], inputs: np.ndarray) -> tuple[np.ndarray, ...]:
    """`hidden`, and the natural log of every class's chance at the scored positions."""
    found = hidden(m, inputs)
    h, last = found[-1], inputs[:, CONTEXT:]
    block = _log_softmax(h @ m["block"] + m["block_bias"][last])
    inside = _log_softmax((h @ m["out"] + m["bias"][last]).reshape(*last.shape, BLOCKS, BLOCK))
    return *found, (inside + block[..., None]).reshape(*last.shape, CLASSES)


def log_shares(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of each target class's share."""
    flat = _log_softmax(logits.reshape(-1, logits.shape[-1]))
    return flat[np.arange(len(flat)), target.ravel()].reshape(target.shape)


def _levels(m: dict[str, np.ndarray], h: np.ndarray, last: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Logits of all blocks and of the classes in the target's block, for positions in order of their target's block, and the run
    of positions of each block."""
    cuts = np.concatenate([[0], np.cumsum(np.bincount(goal // BLOCK, minlength=BLOCKS))])
    runs = [slice(*x) for x in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    block = h @ m["block"]
    block += _rows(m["block_bias"], last)
    inside = _rows(m["bias"].reshape(-1, BLOCK), last * BLOCKS + goal // BLOCK)
    for i, run in enumerate(runs):
        if run.start < run.stop:
            inside[run] += h[run] @ m["out"][:, i * BLOCK:(i + 1) * BLOCK]
    return block, inside, runs


def score(m: dict[str, np.ndarray], flat: np.ndarray, sizes: np.ndarray, batch: int = 32) -> np.ndarray:
    """log10 probability of the class sequence of each of some joined texts."""
    inputs, target, doc = windows(flat, sizes)
    goal, total = flat[np.maximum(target, 0)].astype(np.int64), np.zeros(len(sizes))
    for i in range(0, len(inputs), batch):
        some = slice(i, i + batch)
        h = hidden(m, inputs[some])[-1].reshape(-1, WIDTH)
        at = np.flatnonzero(target[some].ravel() >= 0)
        at = at[np.argsort((goal[some].ravel()[at] // BLOCK).astype(np.int8), kind="stable")]
        mine, last = goal[some].ravel()[at], inputs[some, CONTEXT:].ravel()[at]
        block, inside, _ = _levels(m, h[at], last, mine)
        each = np.arange(len(at))
        got = _log_softmax(block)[each, mine // BLOCK].astype(np.float64) + _log_softmax(inside)[each, mine % BLOCK]
        np.add.at(total, doc[some], np.bincount(at // STRIDE, got, len(inputs[some])))
    return total / np.log(10)


def _by(kind: np.ndarray, rows: np.ndarray, size: int = CLASSES + 1) -> np.ndarray:
    """Sums of rows by class."""
    kind = kind.ravel().astype(np.int16)
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    first = np.flatnonzero(np.diff(kind, prepend=-1))
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    if len(first):
        out[kind[first]] = np.add.reduceat(_rows(rows, order), first)
    return out


def gradient(m: dict[str, np.ndarray], inputs: np.ndarray, goal: np.ndarray, held: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the mean loss over the scored positions of some windows."""
    x, y, q, k, v, a, total, z, h = hidden(m, inputs)
    flat = lambda y: y.reshape(-1, y.shape[-1])
    at = np.flatnonzero(held.ravel())
    at = at[np.argsort((goal.ravel()[at] // BLOCK).astype(np.int8), kind="stable")]
    mine, last, some = goal.ravel()[at], inputs[:, CONTEXT:].ravel()[at], flat(h)[at]
    block, inside, runs = _levels(m, some, last, mine)
    each, weight = np.arange(len(at)), np.float32(1 / max(len(at), 1))
    for level, of in ((block, mine // BLOCK), (inside, mine % BLOCK)):
        np.clip(level, -60, 60, out=level)
        np.exp(level, out=level)
        level /= (level @ np.ones(level.shape[1], level.dtype))[:, None]
        level[each, of] -= 1
        level *= weight
    dsome, dout = block @ m["block"].T, np.zeros_like(m["out"])
    for i, run in enumerate(runs):
        if run.start < run.stop:
            own = slice(i * BLOCK, (i + 1) * BLOCK)
            dsome[run] += inside[run] @ m["out"][:, own].T
            dout[:, own] = some[run].T @ inside[run]
    dh = np.zeros_like(h)
    flat(dh)[at] = dsome
    a /= total
    dz = (flat(dh) @ m["o"].T).reshape(dh.shape)
    ds = dz @ v.transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", dz, z)[:, :, None]
    ds *= a
    every = np.zeros((*x.shape[:2], 3 * WIDTH), x.dtype)
    np.matmul(ds, k, out=every[:, CONTEXT:, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=every[:, :, WIDTH:2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), dz, out=every[:, :, 2 * WIDTH:])
    scale = np.float32(WIDTH ** -0.5)
    rows = np.zeros((*x.shape[:2], 2 * WIDTH), x.dtype)  # slopes of each input's own vector, and of the one it has as last but one
    np.matmul(flat(every), np.hstack([m["q"] * scale, m["k"], m["v"]]).T, out=flat(rows)[:, :WIDTH])
    place = rows[:, CONTEXT:, :WIDTH]
    place += dh
    place += dh * y
    np.multiply(dh, 1 + x[:, CONTEXT:], out=rows[:, CONTEXT - 1:-1, WIDTH:])
    both = _by(inputs, flat(rows))
    weights = flat(x).T @ flat(every)
    return {
        "second": both[:, WIDTH:], "embed": both[:, :WIDTH], "place": rows[:, :, :WIDTH].sum(0),
        "q": weights[:, :WIDTH] * scale, "k": weights[:, WIDTH:2 * WIDTH], "v": weights[:, 2 * WIDTH:], "o": flat(z).T @ flat(dh), "out": dout,
        "bias": _by(last * BLOCKS + mine // BLOCK, inside, (CLASSES + 1) * BLOCKS).reshape(m["bias"].shape),
        "block": some.T @ block, "block_bias": _by(last, block)}


def train(m: dict[str, np.ndarray], docs: list[np.ndarray], batch: int = 32, least: int = 400, rate: float = 1e-2) -> dict[str, np.ndarray]:
    """Adam over the windows of some texts, in an order that depends on them alone; small samples are gone through several times.

    What it begins with, the counts, is a normal prior that weighs as `PRIOR` positions do: a text seen once among many stays rare.
    """
    flat = np.concatenate(docs)
    inputs, target, _ = windows(flat, np.array([len(x) for x in docs]))
    goal, held = flat[np.maximum(target, 0)].astype(np.int64), target >= 0
    per = -(-len(inputs) // batch)
    epochs = max(1, -(-least // per))
    order = np.random.default_rng(len(inputs))
    step, total = 0, epochs * per
    vector, begin = pack(m), pack(m)
    m = unpack(vector, m)
    first, second, room = np.zeros((3, len(vector)), np.float32)
    pull = np.float32(PRIOR / max(len(flat), 1))
    for _ in range(epochs):
        deal = order.permutation(len(inputs))
        for i in range(0, len(deal), batch):
            step += 1
            pick = deal[i:i + batch]
            now = rate * min(1, step / 20) * (1 - 0.9 * step / total)
            slope = gradient(m, inputs[pick], goal[pick], held[pick])
            g = pack({k: slope[k] for k in m})
            np.subtract(vector, begin, out=room)
            room *= pull
            g += room
            first += np.float32(0.1) * (g - first)
            g *= g
            second += np.float32(0.01) * (g - second)
            np.sqrt(second, out=room)
            room *= np.float32((1 - 0.99 ** step) ** -0.5)
            room += np.float32(1e-8)
            np.divide(first, room, out=room)
            room *= np.float32(now / (1 - 0.9 ** step))
            vector -= room
            m = unpack(vector, m)
    return m
