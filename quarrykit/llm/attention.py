"""A small causal self-attention model over words given by their subword ids, in numpy.

A place's vector is made of the embeddings of all ids of its word (embed()), or is a row of "emb" where places are plain ids. One masked attention layer and one hidden layer give the logits of the next class. Training starts where they give the classes' frequencies.
"""

import numpy as np

DIM, HIDDEN = 16, 32
#: Inputs of a window, and how far one starts after the other: tokens between are context only, and each token is scored once.
WINDOW, STRIDE = 64, 48
BATCH = 32
NAMES = ("emb", "pos", "wq", "wk", "wv", "w1", "b1", "w2", "b2")


def start(classes: int, frequency: np.ndarray | None = None, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "emb": 0.5 * rng.standard_normal((classes, DIM)).astype(np.float32), "pos": 0.1 * rng.standard_normal((WINDOW, DIM)).astype(np.float32),
        "wq": draw(DIM, DIM), "wk": draw(DIM, DIM), "wv": draw(DIM, DIM), "w1": draw(2 * DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": np.zeros((HIDDEN, classes), np.float32),
        "b2": np.zeros(classes, np.float32) if frequency is None else np.log(frequency).astype(np.float32),
    }


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    return {k: v.shape for k, v in start(classes).items()}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def unpack(flat: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    all_shapes = shapes(classes)
    others = sum(int(np.prod(shape)) for k, shape in all_shapes.items() if k != "emb")
    all_shapes["emb"] = ((len(flat) - others) // DIM, DIM)  # ids may be more than the classes that they are told in
    out, at = {}, 0
    for k, shape in all_shapes.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


_PAST = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Rows of logits at a time, so that they stay in a core's cache, and the most that exp() takes without a shift.
ROWS, SAFE = 512, 60.0


def keep_memory() -> None:
    """Let the allocator keep arrays' memory for the next ones: the GNU library does so up to the size of the largest block that was ever given back."""
    np.empty(1 << 24, np.uint8)


def _exp(a: np.ndarray, most: float) -> np.ndarray:
    """exp(a) in place, up to a factor for each row; ``most`` bounds |a|."""
    if not most < SAFE:
        a -= a.max(-1, keepdims=True)
    return np.exp(a, out=a)


def _longest(x: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("...i,...i->...", x, x).max(initial=0)))


def _stretch(w: np.ndarray) -> float:
    """Just above the largest factor by which w lengthens a vector, by powers of its Gram matrix."""
    g = (w.T @ w).astype(np.float64)
    for _ in range(2):
        g = g @ g
    return float((g * g).sum()) ** (1 / 16)


def hidden(p: dict, ids: np.ndarray, vectors: np.ndarray | None = None) -> tuple:
    """ids: (windows, length), rows of ``vectors`` (the embeddings, unless given) -> the hidden layer, and what the backward pass needs."""
    length = ids.shape[1]
    x = (p["emb"] if vectors is None else vectors)[ids]
    x += p["pos"][:length]
    qkv = x @ np.concatenate([p["wq"] / x.dtype.type(np.sqrt(DIM)), p["wk"], p["wv"]], 1)
    q, k, v = qkv[..., :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    future = _longest(x) ** 2 * _stretch(p["wq"]) * _stretch(p["wk"]) / np.sqrt(DIM)
    if not future < SAFE:
        a += (_PAST[:length, :length] - 1) * np.float32(1e9)
    _exp(a, future)
    a *= _PAST[:length, :length]
    total = np.matmul(a, np.ones((length, 1), a.dtype))
    y = np.matmul(a, v)
    y /= total
    z = np.concatenate([x, y], 2)
    h = z @ p["w1"]
    h += p["b1"]
    np.maximum(h, 0, out=h)
    return h, (x, q, k, v, a, total, z)


def _classes(p: dict, h: np.ndarray, targets: np.ndarray):
    """For ROWS rows of h at a time: (slice, e, their sums, log probabilities of the targets); class c has the probability e[:, c] * exp(b2)[c] / sum."""
    bias = np.exp(p["b2"])
    most = _longest(h) * _longest(p["w2"].T)
    for i in range(0, len(h), ROWS):
        at = slice(i, i + ROWS)
        e = h[at] @ p["w2"]
        own = e[np.arange(len(e)), targets[at]]
        if not most < SAFE:
            own = own - e.max(1)
        sums = _exp(e, most) @ bias
        yield at, e, sums, own + p["b2"][targets[at]] - np.log(sums)


def log_probabilities(p: dict, ids: np.ndarray, targets: np.ndarray, some: np.ndarray, vectors: np.ndarray | None = None) -> np.ndarray:
    """Natural log probabilities, in one run, of the targets that the mask ``some`` names."""
    t = targets[some]
    h = hidden(p, ids, vectors)[0][some]
    return np.concatenate([np.zeros(0, h.dtype), *(log for _, _, _, log in _classes(p, h, t))])


def step(p: dict, ids: np.ndarray, targets: np.ndarray, weight: np.ndarray, vectors: np.ndarray | None = None) -> tuple[float, dict]:
    """Loss (mean over weighted places) and gradients; with ``vectors`` "x" is that of each place instead of "emb"."""
    h, (x, q, k, v, a, sums, z) = hidden(p, ids, vectors)
    flat = lambda m: m.reshape(-1, m.shape[-1])
    some = np.flatnonzero(weight)
    t, w, own = targets.ravel()[some], weight.ravel()[some].astype(h.dtype), flat(h)[some]
    w /= max(float(w.sum()), 1.0)
    bias, loss = np.exp(p["b2"]), 0.0
    g, wide = {"b2": np.zeros_like(p["b2"])}, np.zeros_like(p["w2"].T)
    dh, back = np.zeros_like(flat(h)), (p["w2"] * bias).T.copy()
    for at, e, total, log in _classes(p, own, t):
        loss -= float(log @ w[at])
        e[np.arange(len(e)), t[at]] -= total / bias[t[at]]
        r = w[at] / total
        g["b2"] += r @ e
        wide += e.T @ (own[at] * r[:, None])
        dh[some[at]] = (e @ back) * r[:, None]
    g["b2"] *= bias
    g["w2"] = wide.T * bias
    dh *= flat(h) > 0
    g["w1"], g["b1"] = flat(z).T @ dh, dh.sum(0)
    dz = (dh @ p["w1"].T).reshape(z.shape)
    dx, dy = dz[..., :DIM], dz[..., DIM:] / sums
    # a and sums are those before the division: a * (dy / sums . v - dy / sums . y) is the gradient of the scores
    inner = np.einsum("...i,...i->...", dy, z[..., DIM:])[..., None]
    ds = np.matmul(dy, v.transpose(0, 2, 1).copy())
    ds -= inner
    ds *= a
    dqkv = np.empty((*x.shape[:2], 3 * DIM), x.dtype)
    np.matmul(ds, k, out=dqkv[..., :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), dy, out=dqkv[..., 2 * DIM :])
    scale = x.dtype.type(1 / np.sqrt(DIM))
    turned = flat(x).T @ flat(dqkv)
    g["wq"], g["wk"], g["wv"] = turned[:, :DIM] * scale, turned[:, DIM : 2 * DIM], turned[:, 2 * DIM :]
    dx = dx + dqkv @ np.concatenate([p["wq"] * scale, p["wk"], p["wv"]], 1).T
    g["pos"] = np.zeros_like(p["pos"])
    g["pos"][: ids.shape[1]] = dx.sum(0)
    if vectors is None:
        g["emb"] = np.stack([np.bincount(ids.ravel(), column, len(p["emb"])) for column in flat(dx).T], 1)
    else:
        g["x"] = dx
    return loss, g


#: Ids of a word that are added for all words at a time; longer words are then added up one by one.
LONG = 12


def embed(emb: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The vector of each place, whose ids begin at its start: that of its first id, and the mean of those of all ids that follow."""
    n = np.diff(starts, append=len(ids))
    rest = np.zeros((len(starts), emb.shape[1]), emb.dtype)
    left = np.flatnonzero(n > 1)
    for j in range(1, LONG):
        rest[left] += emb.take(ids[starts[left] + j], axis=0)
        left = left[n[left] > j + 1]
    for i in left.tolist():
        rest[i] += emb[ids[starts[i] + LONG : starts[i] + n[i]]].sum(0)
    rest /= np.maximum(n - 1, 1).astype(emb.dtype)[:, None]
    rest += emb.take(ids[starts], axis=0)
    return rest


def embed_back(ids: np.ndarray, starts: np.ndarray, dx: np.ndarray, into: np.ndarray) -> None:
    """Add to ``into``, a row for each id, the gradients of the embeddings, from those of the vectors of embed()."""
    n = np.diff(starts, append=len(ids))
    share = np.repeat(1 / np.maximum(n - 1, 1), n).astype(dx.dtype)
    share[starts] = 1
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    rows = dx.take(np.repeat(np.arange(len(starts)), n)[order], axis=0)
    rows *= share[order][:, None]
    if len(own):
        into[own[first]] += np.add.reduceat(np.ascontiguousarray(rows.T, dtype=np.float64), first, axis=1).T


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, g: dict) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, x in self.p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.01 * (g[k] ** 2 - self.v[k])
            x -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(x.dtype)


def windows(ids: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over a text's ids, of which the first is what stands before the text: inputs, targets, first place to score, last place + 1.

    Window k takes inputs from k * stride on; all but the first leave WINDOW - stride places as context. Short ends are padded with 0.
    """
    n = len(ids) - 1
    count = 1 + max(0, -(-(n - WINDOW) // stride))
    at = np.arange(count)[:, None] * stride + np.arange(WINDOW + 1)
    padded = np.concatenate([ids, np.zeros(max(0, int(at[-1, -1]) + 1 - len(ids)), ids.dtype)])[at]
    first = np.where(np.arange(count) > 0, WINDOW - stride, 0)
    last = np.minimum(WINDOW, n - np.arange(count) * stride)
    return padded[:, :-1], padded[:, 1:], first, last
