"""A small causal self-attention model in numpy: forward and backward passes over batches of windows.

The next subword is predicted in three steps: a group of classes and a class of that group, each from the last subword and one masked
attention head over the window with relative position bias; then the subword within its class, by its share of corpus counts.
Batches are small enough that a task's working set stays in its core's cache.
"""

from __future__ import annotations

import numpy as np

T, STEP, DIM, GROUPS, MEMBERS, BATCH = 32, 24, 16, 8, 8, 128
MASK = np.where(np.tril(np.ones((T, T), bool)), np.float32(0), np.float32(-1e9))
LAG = np.where(MASK == 0, np.arange(T)[:, None] - np.arange(T)[None, :], 0)
GROUP_ONES = np.ones((GROUPS, 1), np.float32)
#: Exponents are held below this, so that sums of them stay finite.
STEEP = np.float32(60)
H = 2 * DIM + 1


def new_parameters(inputs: int, class_share: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Starts as the unigram model: the heads hold the classes' log shares, and all that reads the context gives nothing yet."""
    r = np.random.default_rng(seed)
    f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
    share = np.maximum(class_share, 1e-9).reshape(GROUPS, MEMBERS)
    p = {"E": f(inputs, DIM), "A": f(DIM, 3 * DIM), "R": np.zeros(T, np.float32), "G": np.zeros((H, GROUPS), np.float32), "M": np.zeros((GROUPS, H, MEMBERS), np.float32)}
    p["G"][-1] = np.log(share.sum(1))
    p["M"][:, -1] = np.log(share / share.sum(1, keepdims=True))
    return p


def attend(q: np.ndarray, kv: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """q (B, n, DIM) and keys and values with a last column of ones (B, T, 2 DIM + 1) -> what the unnormalized weights bring (B, n, DIM) and their sums, and they (B, n, T)."""
    s = np.matmul(q, np.ascontiguousarray(kv[..., :DIM].transpose(0, 2, 1)))
    s += bias
    exponents(s)
    return np.matmul(s, kv[..., DIM:]), s


def scaled(a: np.ndarray) -> np.ndarray:
    """The projections with the queries' scale in them."""
    return np.concatenate([a[:, :DIM] * np.float32(DIM**-0.5), a[:, DIM:]], 1)


def projected(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Queries, keys and values of e (N, DIM), and a column of ones."""
    out = np.empty((len(e), 3 * DIM + 1), e.dtype)
    out[:, -1] = 1
    np.matmul(e, a, out=out[:, :-1])
    return out


def by_group(p: dict) -> np.ndarray:
    """For each group the columns of both heads, group logits and the group's member logits: (GROUPS, H, GROUPS + MEMBERS)."""
    return np.concatenate([np.broadcast_to(p["G"], (GROUPS, H, GROUPS)), p["M"]], 2)


def heads(w: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """h, sorted by group, by the columns of each row's group; bounds are the groups' first rows."""
    z = np.empty((len(h), w.shape[2]), h.dtype)
    for g in range(GROUPS):
        a, b = bounds[g], bounds[g + 1]
        if a < b:
            np.matmul(h[a:b], w[g], out=z[a:b])
    return z


def exponents(z: np.ndarray) -> np.ndarray:
    np.minimum(z, STEEP, out=z)
    return np.exp(z, out=z)


def sorted_by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])


def loss_and_gradients(p: dict, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood in nats of classes y (B, T) where mask, and its gradients."""
    a, n = scaled(p["A"]), max(1, int(np.count_nonzero(mask)))
    e = np.take(p["E"], x.reshape(-1), axis=0)
    qkv = projected(e, a).reshape(*x.shape, -1)
    q, k, v = qkv[..., :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    o, s = attend(q, qkv[..., DIM:], p["R"][LAG] + MASK)
    o = o.reshape(-1, DIM + 1)
    total = np.repeat(o[:, DIM:], DIM + 1, axis=1)
    o /= total  # its last column becomes the heads' constant
    rows = np.flatnonzero(mask)
    goal = y.reshape(-1)[rows].astype(np.uint8)
    order, bounds = sorted_by_group(goal // MEMBERS)
    rows, goal = rows[order], goal[order]
    h = np.take(np.concatenate([e, o], 1), rows, axis=0)
    w = by_group(p)
    d = exponents(heads(w, h, bounds))
    # both softmaxes, over the number of predictions
    flat = d.reshape(-1, MEMBERS)
    flat /= (flat @ GROUP_ONES) * np.float32(n)
    at = np.empty((2, len(rows)), np.int64)
    at[:] = np.arange(0, d.size, GROUPS + MEMBERS)
    at[0] += goal // MEMBERS
    at[1] += goal % MEMBERS + np.uint8(GROUPS)
    picked = np.take(d, at)
    loss = -float(np.log(picked * n + 1e-30).sum()) / n
    np.put(d, at, picked - np.float32(1 / n))
    # the last row is for places that are masked, the last column for what the weights' normalization takes off
    to_o = w[:, DIM:].copy()
    to_o[:, -1] = 0
    dw, de, do = np.zeros_like(w), np.empty((len(rows) + 1, DIM), e.dtype), np.empty((len(rows) + 1, DIM + 1), e.dtype)
    de[-1], do[-1] = 0, 0
    for g in range(GROUPS):
        u, z = bounds[g], bounds[g + 1]
        if u < z:
            np.matmul(h[u:z].T, d[u:z], out=dw[g])
            np.matmul(d[u:z], w[g, :DIM].T, out=de[u:z])
            np.matmul(d[u:z], to_o[g].T, out=do[u:z])
    grad = {"G": dw[:, :, :GROUPS].sum(0), "M": np.ascontiguousarray(dw[:, :, GROUPS:])}
    back_to = np.full(len(e), len(rows))
    back_to[rows] = np.arange(len(rows))
    de, do = np.take(de, back_to, axis=0), np.take(do, back_to, axis=0)
    do /= total
    do[:, DIM] = -np.einsum("ij,ij->i", do, o)
    do = do.reshape(*x.shape, -1)
    ds = np.matmul(do, np.ascontiguousarray(v.transpose(0, 2, 1)))
    ds *= s
    grad["R"] = np.bincount(LAG.ravel(), ds.sum(0).ravel(), T).astype(np.float32)
    back = np.empty((*x.shape, 3 * DIM), e.dtype)
    np.matmul(ds, k, out=back[..., :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=back[..., DIM : 2 * DIM])
    np.matmul(s.transpose(0, 2, 1), do[..., :DIM], out=back[..., 2 * DIM :])
    de += back.reshape(-1, 3 * DIM) @ a.T
    # in short runs, which the product's library does faster
    runs = max(1, len(e) // 512)
    cut = len(e) // runs * runs
    grad["A"] = np.matmul(e[:cut].reshape(runs, -1, DIM).transpose(0, 2, 1), back.reshape(-1, 3 * DIM)[:cut].reshape(runs, -1, 3 * DIM)).sum(0)
    if cut < len(e):
        grad["A"] += e[cut:].T @ back.reshape(-1, 3 * DIM)[cut:]
    grad["A"][:, :DIM] *= np.float32(DIM**-0.5)
    # rows of the same input, next to each other, are summed
    order = np.argsort(x.reshape(-1).astype(np.uint16 if len(p["E"]) < 1 << 16 else np.int64), kind="stable")
    some = np.take(x.reshape(-1), order)
    first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
    grad["E"] = np.zeros_like(p["E"])
    grad["E"][some[first]] = np.add.reduceat(np.take(de, order, axis=0), first, axis=0)
    return loss, grad


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first scored place) of the overlapping windows over n predictions; each is scored in one window."""
    starts = np.arange(0, max(1, n - T + STEP), STEP)
    return starts, np.where(starts == 0, 0, T - STEP)


class Trainer:
    """Adam steps over batches of windows; each window of each id sequence given is learnt once."""

    def __init__(self, p: dict, rate: float = 0.01, seed: int = 3):
        self.rate, self.k, self.seen = rate, 0, 0
        self.flat = np.concatenate([a.ravel() for a in p.values()])
        ends = np.cumsum([a.size for a in p.values()])
        self.p = {n: self.flat[z - a.size : z].reshape(a.shape) for (n, a), z in zip(p.items(), ends, strict=True)}
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.random = np.random.default_rng(seed)

    def step(self, g: dict) -> None:
        self.k += 1
        rate, root = np.float32(self.rate / (1 - 0.9**self.k)), np.float32((1 - 0.99**self.k) ** -0.5)
        d = np.concatenate([g[n].ravel() for n in self.p])
        self.m += np.float32(0.1) * (d - self.m)
        d *= d
        d -= self.v
        d *= np.float32(0.01)
        self.v += d
        np.sqrt(self.v, out=d)
        d *= root
        d += np.float32(1e-8)
        np.divide(self.m, d, out=d)
        d *= rate
        self.flat -= d

    def learn(self, streams: list[np.ndarray], inputs_of: np.ndarray, class_of: np.ndarray) -> float:
        """One pass over the windows of these id sequences (each with its end ids), in shuffled order; the last step's loss."""
        streams = [ids for ids in streams if len(ids) > 1]
        if not streams:
            return 0.0
        begins = np.concatenate([[0], np.cumsum([len(ids) for ids in streams])])
        starts = np.concatenate([np.arange(b, z - 1, T) for b, z in zip(begins[:-1], begins[1:], strict=True)])
        last = begins[np.searchsorted(begins, starts, side="right")] - 1
        whole = np.concatenate([*streams, np.zeros(T + 1, streams[0].dtype)])
        x_all, y_all, places, loss = np.take(inputs_of, whole), np.take(class_of, whole), np.arange(T), 0.0
        order = self.random.permutation(len(starts))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            at = starts[some, None] + places
            mask = at < last[some, None]
            loss, g = loss_and_gradients(self.p, np.take(x_all, at), np.take(y_all, at + 1), mask)
            self.step(g)
            self.seen += int(np.count_nonzero(mask))
        return loss


def make_tables(p: dict) -> dict:
    """For scoring: what each input alone gives to query, key, value and, for each group, to both heads, and the heads' parts for what attention brings."""
    w = by_group(p)
    qkv = projected(p["E"], scaled(p["A"])).astype(np.float32)
    alone = np.einsum("id,gdc->igc", p["E"], w[:, :DIM]).astype(np.float32)
    return {"q": np.ascontiguousarray(qkv[:, :DIM]), "kv": np.ascontiguousarray(qkv[:, DIM:]), "bias": (p["R"][LAG] + MASK).astype(np.float32), "alone": alone.reshape(-1, GROUPS + MEMBERS), "from_head": np.ascontiguousarray(w[:, DIM:], np.float32)}


def score(p: dict, streams: list[np.ndarray], inputs_of: np.ndarray, class_of: np.ndarray, within: np.ndarray, tables: dict | None = None) -> np.ndarray:
    """Natural log probability of each id sequence given its first id; every later id is scored once."""
    t = tables or make_tables(p)
    if not streams:
        return np.zeros(0)
    starts, froms, sizes, owner, base = [], [], [], [], 0
    for i, ids in enumerate(streams):
        a, f = windows(len(ids) - 1)
        starts.append(a + base)
        froms.append(f)
        sizes.append(np.minimum(T, len(ids) - 1 - a))
        owner.append(np.full(len(a), i))
        base += len(ids)
    whole = np.concatenate([*streams, np.full(T + 1, streams[0][0])])
    starts, froms, sizes, owner = map(np.concatenate, (starts, froms, sizes, owner))
    out, places = np.zeros(len(streams)), np.arange(T)
    x_all, c_all, w_all = np.take(inputs_of, whole).astype(np.int64), np.take(class_of, whole).astype(np.uint8), np.take(within, whole)
    # where only the last places of a window are scored, only those ask
    for skip, some in ((0, np.flatnonzero(froms == 0)), (T - STEP, np.flatnonzero(froms))):
        for i in range(0, len(some), BATCH):
            mine = some[i : i + BATCH]
            at = starts[mine, None] + places
            x = np.take(x_all, at)
            rows = np.flatnonzero(places[skip:] < sizes[mine, None])
            o, _ = attend(np.take(t["q"], x[:, skip:], axis=0), np.take(t["kv"], x, axis=0), t["bias"][skip:])
            goal = np.take(at[:, skip:], rows) + 1
            c = np.take(c_all, goal)
            order, bounds = sorted_by_group(c // MEMBERS)
            rows, goal, c = rows[order], goal[order], c[order]
            o = np.take(o.reshape(-1, DIM + 1), rows, axis=0)
            o /= np.repeat(o[:, DIM:], DIM + 1, axis=1)
            z, group = heads(t["from_head"], o, bounds), c // MEMBERS
            z += np.take(t["alone"], np.take(x[:, skip:], rows) * GROUPS + group, axis=0)
            total = (exponents(z).reshape(-1, MEMBERS) @ GROUP_ONES).reshape(-1, 2)
            n = np.arange(0, z.size, GROUPS + MEMBERS)
            picked = np.take(z, n + group) * np.take(z, n + GROUPS + c % MEMBERS)
            got = np.log(picked / (total[:, 0] * total[:, 1]) + np.float32(1e-37)) + np.take(w_all, goal)
            out += np.bincount(owner[mine[rows // (T - skip)]], got, len(streams))
    return out
