"""A small causal self-attention model over token ids, in numpy.

One layer: embeddings of the last token, of the last two together (hashed) and of the
place in the window; masked attention; a rectified layer; then a softmax in two steps, over
classes of tokens and over the tokens of the class. Classes hold about equal shares of a
corpus, so frequent tokens share theirs with few others. Counts of the corpus enter as
fixed logits: of classes after each token, and of tokens within their class. Tokens that
the corpus lacks share the last class evenly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tramwise.llm.common import mix

#: Scores of the attention, and logits, stay within these bounds, so that sums of their
#: exponentials need no shift.
FAR, WIDE = np.float32(20), np.float32(60)
#: Tokens whose softmax is computed together, about, and over classes, which stay in the
#: processor's cache.
TOGETHER, NEAR = 1 << 15, 1 << 11
#: Tokens of neighbouring classes whose logits are computed together, at most.
UNITED = 32


@dataclass(frozen=True)
class Shape:
    """Sizes of the model, and how it learns."""

    width: int = 16
    keys: int = 8  # of the attention
    hidden: int = 16
    window: int = 32  # places
    stride: int = 28  # places that a window after the first scores
    pairs: int = 1 << 12  # hashed embeddings of two tokens
    smoothing: float = 8.0  # weight of all tokens' class counts beside one token's
    rate: float = 0.12
    batch: int = 64  # windows of a step
    slots: int = 64  # parts that the windows are dealt to,
    rounds: int = 4  # and rounds that share out all parts; without rounds nothing learns


class Layout:
    """Tokens in classes, from how often each occurs."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        seen = np.flatnonzero(counts)
        seen = seen[np.lexsort((seen, -counts[seen]))]
        self.size = len(counts)
        self.number = int(np.ceil(np.sqrt(len(seen)))) + 1  # classes, the last of them unseen
        share = np.cumsum(counts[seen]) / max(counts.sum(), 1)
        own = np.minimum((share * (self.number - 1) * (1 - 1e-9)).astype(np.int64), self.number - 2)
        # Numbers without gaps; few tokens may hold the shares of several classes.
        own = np.unique(own, return_inverse=True)[1] if len(seen) else own
        self.number = (int(own.max()) + 1 if len(seen) else 0) + 1
        self.members = seen  # class by class
        self.cuts = np.searchsorted(own, np.arange(self.number))
        self.classes = np.full(self.size, self.number - 1)
        self.classes[seen] = own
        self.place = np.full(self.size, -1)
        self.place[seen] = np.arange(len(seen))
        self.unseen = self.size - len(seen)

    def span(self, c: int) -> slice:
        """Places of the members of a class that the corpus has."""
        return slice(int(self.cuts[c]), int(self.cuts[c + 1]))

    def groups(self) -> list[tuple[int, int]]:
        """Ranges of neighbouring classes, small ones together, without those of one token."""
        found: list[tuple[int, int]] = []
        for c in np.flatnonzero(np.diff(self.cuts) > 1).tolist():
            first = found[-1][0] if found and found[-1][1] == c else c
            if self.cuts[c + 1] - self.cuts[first] > UNITED:
                first = c
            if first < c:
                found.pop()
            found.append((first, c + 1))
        return found


def kinds(layout: Layout) -> np.ndarray:
    """The class of each input: 0 and 1 for the inputs without one."""
    return np.r_[0, 1, layout.classes[layout.members] + 2]


class Model:
    """Weights and fixed logits. Inputs are places of the layout, shifted by two.

    Input 0 is the start of a text and 1 any token the corpus lacks.
    """

    def __init__(self, layout: Layout, follows: np.ndarray, within: np.ndarray, shape: Shape):
        """``follows`` counts, for each input, the class of the token after it.

        ``within`` counts, for each class of an input (see ``kinds``), the token after it.
        """
        self.layout, self.shape = layout, shape
        draw = np.random.default_rng(20240611)
        d, v = shape.width, len(layout.members)

        def random(*size, spread):
            return (draw.standard_normal(size) * spread).astype(np.float32)

        self.weights = {
            "one": random(v + 2, d, spread=0.3),
            "two": random(shape.pairs, d, spread=0.3),
            "at": random(shape.window, d, spread=0.1),
            "q": random(d, shape.keys, spread=d**-0.5),
            "k": random(d, shape.keys, spread=d**-0.5),
            "v": random(d, d, spread=d**-0.5),
            "o": random(d, d, spread=d**-0.5),
            "up": random(d, shape.hidden, spread=(2 / d) ** 0.5),
            "bend": np.zeros(shape.hidden, np.float32),
            "down": random(shape.hidden, d, spread=0.5 * shape.hidden**-0.5),
            "class": np.zeros((d, layout.number), np.float32),
            "token": np.zeros((v, d), np.float32),
        }
        whole = follows.sum(0) + np.r_[np.full(layout.number - 1, 0.5), 1.0]
        whole = whole / whole.sum()
        own = follows + shape.smoothing * whole
        self.class_logits = np.log(own / own.sum(1, keepdims=True)).astype(np.float32)
        held = within + shape.smoothing * (layout.counts[layout.members] + 0.5) / max(layout.counts.sum(), 1)
        for c in range(layout.number - 1):
            own = held[:, layout.span(c)]
            own /= own.sum(1, keepdims=True)
        held = np.log(held).astype(np.float32)
        # For each group of classes a row for each class and kind, open where the class is.
        self.groups, self.blocks = layout.groups(), []
        self.first, self.width = np.zeros((2, layout.number), np.int64)
        for c, end in self.groups:
            begin = layout.span(c).start
            block = np.full((end - c, len(held), layout.span(end - 1).stop - begin), -np.inf, np.float32)
            for i in range(c, end):
                own = layout.span(i)
                block[i - c, :, own.start - begin : own.stop - begin] = held[:, own]
            self.blocks.append(block.reshape(-1, block.shape[2]))
            self.first[c:end], self.width[c:end] = c, block.shape[2]
        self.least = min((np.min(t, where=t > -np.inf, initial=0) for t in (self.class_logits, held)))
        self.kinds = kinds(layout)
        self.mask = np.tri(shape.window, dtype=np.float32)  # no place sees a later one

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        return self.layout.place[ids] + 2

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for name, w in self.weights.items():
            self.weights[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def pair(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        spread = mix((before.astype(np.uint64) << np.uint64(32)) + last.astype(np.uint64))
        return (spread % np.uint64(self.shape.pairs)).astype(np.int64)

    def projection(self) -> np.ndarray:
        return np.concatenate([self.weights[name] for name in ("q", "k", "v")], 1)

    def hidden(self, before: np.ndarray, last: np.ndarray, full: bool = False, first: int = 0):
        """The last layer at each window's places from ``first`` on.

        With ``full`` what learning needs as well.
        """
        w = self.weights
        many, n = last.shape

        def times(t, name):
            return (_flat(t) @ w[name]).reshape(many, n - first, -1)

        pair = self.pair(before, last)
        x = w["one"].take(last, 0)
        x += w["two"].take(pair, 0)
        x += w["at"][:n]
        # Queries, keys and values in one product, and a column of ones.
        qkv = np.ones((many, n, 2 * self.shape.keys + self.shape.width + 1), x.dtype)
        qkv[..., :-1] = (_flat(x) @ self.projection()).reshape(many, n, -1)
        q, k, v = np.split(qkv, [self.shape.keys, 2 * self.shape.keys], -1)
        q = q[:, first:]
        q *= np.float32(self.shape.keys**-0.5)
        s = q @ k.transpose(0, 2, 1)
        np.clip(s, -FAR, FAR, out=s)
        np.exp(s, out=s)
        s *= self.mask[first:n, :n]
        a = s @ v  # the last column is the sum of the shares
        if full:
            s /= a[..., -1:]
        a = a[..., :-1] / a[..., -1:]
        z = times(a, "o")
        z += x[:, first:]
        m = times(z, "up")
        m += w["bend"]
        np.maximum(m, 0, out=m)
        h = times(m, "down")
        h += z
        return h, (pair, x, q, k, v[..., :-1], s, a, z, m)

    def far(self, h: np.ndarray) -> bool:
        """Whether a logit may lie beyond the bounds, by the lengths of vectors."""
        longest = [np.einsum("ij,ij->i", t, t).max(initial=0) for t in (self.weights["class"].T, self.weights["token"], h)]
        return not (max(longest[:2]) * longest[2]) ** 0.5 - self.least < 0.99 * WIDE

    def log_probability(self, h: np.ndarray, last: np.ndarray, target: np.ndarray, learn: dict | None = None):
        """Natural logs of the probability of each target; gradients into ``learn``.

        With ``learn`` the gradient by ``h`` is returned as well.
        """
        w, layout = self.weights, self.layout
        own = layout.classes[target]
        told = np.empty(len(target))
        ones = np.ones(max(layout.number, self.width.max()), h.dtype)
        far = self.far(h)
        if learn is not None:
            grad = np.empty_like(h)
            learn["class"], learn["token"] = np.zeros_like(w["class"]), np.zeros_like(w["token"])
        for first in range(0, len(target), NEAR):
            some = slice(first, first + NEAR)
            s = h[some] @ w["class"]
            s += self.class_logits.take(last[some], 0)
            if far:
                _bounded(s)
            flat, spot = s.reshape(-1), np.arange(len(s)) * layout.number + own[some]
            told[some] = flat.take(spot)
            total = _exponentials(s, ones)
            told[some] -= np.log(total)
            if learn is not None:
                s /= -total[:, None]
                flat[spot] += 1
                learn["class"] += h[some].T @ s
                np.matmul(s, w["class"].T, out=grad[some])
        # Class by class, everything in that order, so that a group of classes is a slice.
        order = _order(own, layout.number)
        own = own.take(order)
        cuts = np.searchsorted(own, np.arange(layout.number + 1)).tolist()
        h, first = h.take(order, 0), self.first.take(own)
        row = (own - first) * (layout.number + 2) + self.kinds.take(last.take(order))
        # In each group's logits, end to end: the cell of the target.
        cell = layout.place.take(target.take(order)) - layout.cuts.take(first)
        cell += (np.arange(len(own)) - np.take(cuts, first)) * self.width.take(own)
        inside, totals = np.zeros(len(own), h.dtype), np.ones(len(own), h.dtype)
        inside[cuts[-2] :] = -np.log(max(layout.unseen, 1))
        if learn is not None:
            back = np.zeros_like(h)
        for (c, end), block in zip(self.groups, self.blocks):
            if cuts[c] == cuts[end]:
                continue
            at, span = slice(cuts[c], cuts[end]), slice(layout.cuts[c], layout.cuts[end])
            held, token = h[at], w["token"][span]
            s = held @ token.T
            s += block.take(row[at], 0)
            if far:
                _bounded(s)
            flat, spot = s.reshape(-1), cell[at]
            inside[at] = flat.take(spot)
            totals[at] = total = _exponentials(s, ones)
            if learn is not None:
                s /= -total[:, None]
                flat[spot] += 1
                np.matmul(s.T, held, out=learn["token"][span])
                np.matmul(s, token, out=back[at])
        told[order] += inside.astype(np.float64) - np.log(totals)
        if learn is not None:
            grad[order] += back
        return told if learn is None else (told, grad)

    def gradients(self, before: np.ndarray, last: np.ndarray, target: np.ndarray, count: np.ndarray):
        """Sum of logs, number of tokens, gradients; ``count`` marks the places that count."""
        w = self.weights
        h, (pair, x, q, k, v, s, a, z, m) = self.hidden(before, last, full=True)
        g: dict[str, np.ndarray] = {}
        at = np.flatnonzero(count)
        told, own = self.log_probability(_flat(h).take(at, 0), last.take(at), target.take(at), g)
        dh = np.zeros_like(h)
        _flat(dh)[at] = own
        g["down"] = _flat(m).T @ _flat(dh)
        # Windows end to end, in one product each.
        dm = _times(dh, w["down"].T)
        dm *= m > 0
        g["up"], g["bend"] = _flat(z).T @ _flat(dm), _flat(dm).sum(0)
        dz = _times(dm, w["up"].T)
        dz += dh
        g["o"] = _flat(a).T @ _flat(dz)
        da = _times(dz, w["o"].T)
        ds = da @ v.transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", da, a)[..., None]  # the mean of ``ds`` by shares
        ds *= s
        dq = ds @ k
        dq *= np.float32(self.shape.keys**-0.5)
        back = np.concatenate([dq, ds.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ da], -1)
        parts = _flat(x).T @ _flat(back)
        g["q"], g["k"], g["v"] = np.split(parts, [self.shape.keys, 2 * self.shape.keys], 1)
        dx = _flat(back) @ self.projection().T
        dx += _flat(dz)
        g["at"] = np.zeros_like(w["at"])
        g["at"][: x.shape[1]] = dx.reshape(x.shape).sum(0)
        g["one"] = _gathered(last.ravel(), dx, len(w["one"]))
        g["two"] = _gathered(pair.ravel(), dx, len(w["two"]))
        return told.sum(), len(told), g


def _flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def _times(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (_flat(t) @ w).reshape(*t.shape[:-1], -1)


def _bounded(s: np.ndarray) -> None:
    np.minimum(s, WIDE, out=s)
    np.maximum(s, -WIDE, out=s, where=s > -np.inf)


def _exponentials(s: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The sums by rows of the exponentials of ``s``, which ``s`` turns into."""
    np.exp(s, out=s)
    return s @ ones[: s.shape[1]]


def _order(rows: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers from 0 on; numpy sorts 16 bits by radix."""
    return np.argsort(rows.astype(np.uint16) if below <= 1 << 16 else rows, kind="stable")


def _gathered(rows: np.ndarray, values: np.ndarray, below: int):
    """Different rows, and the sum of the values of each."""
    order = _order(rows, below)
    own = rows.take(order)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[first], np.add.reduceat(values.take(order, 0), first, axis=0)


class Learner:
    """Steps whose size falls with the squares of past gradients."""

    def __init__(self, model: Model):
        self.model = model
        # The weights that all change lie end to end, so that a step takes them together; of
        # embeddings some rows change.
        self.seen = {name: np.full(model.weights[name].shape, 1e-4, np.float32) for name in ("one", "two")}
        self.whole = [name for name in model.weights if name not in self.seen]
        self.weights = np.concatenate([model.weights[name].ravel() for name in self.whole])
        self.past = np.full(len(self.weights), 1e-4, np.float32)
        cuts = np.cumsum([model.weights[name].size for name in self.whole])[:-1]
        for name, own in zip(self.whole, np.split(self.weights, cuts)):
            model.weights[name] = own.reshape(model.weights[name].shape)

    def step(self, gradients: dict, tokens: int, rate: float) -> None:
        g = np.concatenate([gradients[name].ravel() for name in self.whole])
        g *= np.float32(1 / tokens)
        past = g * g
        self.past += past
        np.sqrt(self.past, out=past)
        g *= np.float32(rate)
        g /= past
        self.weights += g
        for name, seen in self.seen.items():
            rows, g = gradients[name]
            g *= np.float32(1 / tokens)
            past = g * g
            past += seen.take(rows, 0)
            seen[rows] = past
            np.sqrt(past, out=past)
            g *= np.float32(rate)
            g /= past
            self.model.weights[name][rows] += g


# -- Windows ------------------------------------------------------------------


def windows(sizes: np.ndarray, shape: Shape):
    """(text, number, first place, places) of the windows over texts of ``sizes`` tokens."""
    many = 1 + np.maximum(0, -(-(sizes - shape.window) // shape.stride))
    many[sizes == 0] = 0
    text = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = number * shape.stride
    return text, number, begin, np.minimum(shape.window, sizes[text] - begin)


class Texts:
    """Tokens of several texts end to end, and the two inputs before each."""

    def __init__(self, model: Model, ids: np.ndarray, sizes: np.ndarray):
        self.model, self.ids = model, ids
        self.first = np.cumsum(sizes) - sizes
        own = model.inputs(ids)
        start = np.zeros(len(ids), bool)
        start[self.first[sizes > 0]] = True
        self.last = np.r_[0, own[:-1]] if len(ids) else own
        self.last[start] = 0
        self.before = np.r_[0, self.last[:-1]] if len(ids) else own
        self.before[start] = 0


def logs(model: Model, ids: np.ndarray, sizes: np.ndarray, batch: int = 128) -> np.ndarray:
    """The natural log of each token's probability by the model.

    A window scores the places that no window before it did.
    """
    shape = model.shape
    text, number, begin, places = windows(sizes, shape)
    held = Texts(model, ids, sizes)
    found = np.zeros(len(ids))
    overlap = shape.window - shape.stride
    waiting: list[tuple] = []

    def settle():
        h, last, at = (np.concatenate(part) for part in zip(*waiting))
        waiting.clear()
        found[at] = model.log_probability(h, last, ids[at])

    # Windows of one length, first or later ones, need no filling up.
    alike = 2 * places + (number > 0)
    order = np.argsort(alike, kind="stable")
    groups = np.flatnonzero(np.r_[True, np.diff(alike[order]) > 0]) if len(order) else []
    tokens = 0
    for first, end in zip(groups, [*groups[1:], len(order)]):
        fresh = overlap if number[order[first]] else 0
        for at in range(first, end, batch):
            own = order[at : min(at + batch, end)]
            where = (held.first[text[own]] + begin[own])[:, None] + np.arange(places[own[0]])
            last = held.last[where]
            h, _ = model.hidden(held.before[where], last, first=fresh)
            waiting.append((_flat(h), last[:, fresh:].ravel(), where[:, fresh:].ravel()))
            tokens += len(waiting[-1][1])
            if tokens > TOGETHER:
                settle()
                tokens = 0
    if waiting:
        settle()
    return found


def totals(told: np.ndarray, sizes: np.ndarray, counted: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The log10 probability of each text, from the model's ``told`` (see ``logs``).

    A token's probability is ``counted`` and the share ``rest`` of the model's.
    """
    own = np.log(counted + rest * np.exp(told))
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), own, len(sizes)) / np.log(10)


def score(model: Model, ids: np.ndarray, sizes: np.ndarray, counted: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The log10 probability of each text (see ``totals``)."""
    return totals(logs(model, ids, sizes), sizes, counted, rest)


def learn(
    model: Model,
    before: np.ndarray,
    last: np.ndarray,
    ids: np.ndarray,
    sizes: np.ndarray,
    order: np.ndarray,
    rate: float,
) -> int:
    """Steps through windows in the order given; the number of tokens they held.

    ``before`` and ``last`` are the two inputs that lead to each window's first token.
    """
    learner, first = Learner(model), np.cumsum(sizes) - sizes
    own = model.inputs(ids)
    for at in range(0, len(order), model.shape.batch):
        some = order[at : at + model.shape.batch]
        places = sizes[some]
        n = int(places.max())
        inside = np.arange(n) < places[:, None]
        where = np.where(inside, first[some][:, None] + np.arange(n), 0)
        inputs = np.c_[before[some], last[some], own[where[:, :-1]]]
        _, tokens, g = model.gradients(inputs[:, :-1], inputs[:, 1:], ids[where], inside)
        learner.step(g, tokens, rate)
    return int(sizes[order].sum())
