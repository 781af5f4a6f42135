"""A small causal self-attention model over classes of subword ids, in numpy.

A position sees itself and the positions before it in its window. The output has two
levels: a group of classes, then a class of the group, so that a position costs the logits
of both levels and not those of all classes. What attention finds is added to the log
probabilities of groups and classes after the id before, which are counted over all
training texts; within a class an id has its counted share after the id before.
"""

import zlib

import numpy as np

#: Width of the hidden vectors, and positions of a window.
WIDTH, WINDOW = 16, 32
#: Positions that a window repeats from the one before it, as context only.
OVERLAP = 8
#: Classes at the input, and how many of them hold one frequent id each.
IN_CLASSES, IN_OWN = 1024, 960
#: Groups at the output, classes of each, and classes that hold one frequent id each.
GROUPS, MEMBERS, OUT_OWN = 16, 16, 192
#: Ids whose counts after each input class are kept; the last slot holds all others.
SLOTS = 2048
#: Windows of a step of training, and its rate.
STEP_WINDOWS, RATE = 256, 0.02
#: Windows whose arrays are worked on at a time.
BLOCK_WINDOWS = 128

NAMES = ("embed", "place", "into", "wo", "groups", "members")


class Vocabulary:
    """Classes and slots of ids from their counts; the last id ends a text, and comes before its first token."""

    def __init__(self, counts):
        counts = np.asarray(counts, np.float64) + 0.05
        self.end = len(counts) - 1
        order = np.lexsort([np.arange(len(counts)), -counts])
        place = np.empty(len(counts), np.int64)
        place[order] = np.arange(len(counts))
        self.in_class = np.where(place < IN_OWN, place, IN_OWN + place % (IN_CLASSES - IN_OWN)).astype(np.uint16)
        self.slot = np.minimum(place, SLOTS - 1).astype(np.uint16)
        mass = np.bincount(self.slot, counts, SLOTS)
        # The share of an id in its slot, and of a slot among all ids.
        self.in_slot = np.log(counts / mass[self.slot]).astype(np.float32)
        self.share = mass / mass.sum()
        # The slots behind the frequent ones are cut into classes of about equal mass.
        classes, rest = GROUPS * MEMBERS - OUT_OWN, mass[OUT_OWN:]
        middle = (np.cumsum(rest) - rest / 2) / max(rest.sum(), 1e-9)
        self.slot_class = np.arange(SLOTS)
        self.slot_class[OUT_OWN:] = OUT_OWN + np.minimum((middle * classes).astype(np.int64), classes - 1)
        self.slot_class = self.slot_class.astype(np.uint8)
        self.pairs(np.zeros((IN_CLASSES, SLOTS)))

    def pairs(self, counts):
        """Take in how often each slot came after each input class.

        A slot that came after few others falls back on its share among all ids; the
        weight of that is the number of different slots seen after the input class.
        """
        back = (counts > 0).sum(axis=1, keepdims=True) + 1.0
        chance = (counts + back * self.share) / (counts.sum(axis=1, keepdims=True) + back)
        first = np.unique(self.slot_class, return_index=True)
        classes = np.full((IN_CLASSES, GROUPS * MEMBERS), 1e-12)
        classes[:, first[0]] = np.maximum(np.add.reduceat(chance, first[1], axis=1), 1e-12)
        groups = classes.reshape(IN_CLASSES, GROUPS, MEMBERS).sum(axis=2)
        self.group_logs = np.log(groups).astype(np.float32)
        self.member_logs = np.log(classes.reshape(IN_CLASSES, GROUPS, MEMBERS) / groups[..., None]).astype(np.float32).reshape(-1, MEMBERS)
        self.slot_logs = np.log(np.maximum(chance, 1e-300) / classes[:, self.slot_class]).astype(np.float32)

    def within(self, before, ids):
        """Log probability of ids within their classes after input classes ``before``."""
        slot = self.slot[ids]
        return np.take(self.slot_logs, np.int64(SLOTS) * before + slot) + self.in_slot[ids]

    def out_class(self, ids):
        return self.slot_class[self.slot[ids]]


def initial(seed=23):
    rng = np.random.default_rng(seed)

    def draw(*shape):
        return (rng.normal(size=shape) / np.sqrt(WIDTH)).astype(np.float32)

    return {"embed": draw(IN_CLASSES, WIDTH), "place": 0.3 * draw(WINDOW, WIDTH), "into": draw(WIDTH, 3 * WIDTH), "wo": draw(WIDTH, WIDTH),
            "groups": np.zeros((WIDTH, GROUPS), np.float32), "members": np.zeros((GROUPS, WIDTH, MEMBERS), np.float32)}


def flat(parameters):
    return np.concatenate([parameters[n].ravel() for n in NAMES]).astype(np.float64)


def unflat(values, like):
    out, at = {}, 0
    for n in NAMES:
        size = like[n].size
        out[n] = values[at:at + size].reshape(like[n].shape).astype(np.float32)
        at += size
    return out


_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Exponents are held within these bounds instead of being shifted by their maximum.
BOUND = 60


def _exp(x):
    np.clip(x, -BOUND, BOUND, out=x)
    return np.exp(x, out=x)


def _scaled(p):
    """The input projection with the scale of the products of queries and keys in it."""
    into = p["into"].copy()
    into[:, :WIDTH] *= into.dtype.type(WIDTH ** -0.5)
    return into


def forward(p, inputs, start=0, into=None):
    """Hidden vectors of the positions from ``start`` of (n, WINDOW) input classes, and what the backward pass needs."""
    into = _scaled(p) if into is None else into
    x = np.take(p["embed"], inputs, axis=0)
    x += p["place"]
    # One more column of the values is one, so that the sums of weights come along.
    both = np.empty((*inputs.shape, 3 * WIDTH + 1), x.dtype)
    np.matmul(x.reshape(-1, WIDTH), into, out=both.reshape(-1, 3 * WIDTH + 1)[:, :-1])
    both[..., -1] = 1
    q, k, v = both[:, start:, :WIDTH], both[..., WIDTH:2 * WIDTH], both[..., 2 * WIDTH:]
    weights = _exp(q @ k.transpose(0, 2, 1))
    weights *= _SEEN[start:]
    mixed = weights @ v
    sums = mixed[..., -1:]
    mixed = mixed[..., :-1] / sums
    hidden = mixed.reshape(-1, WIDTH) @ p["wo"]
    hidden.reshape(mixed.shape)[...] += x[:, start:]
    return hidden, (x, q, k, v, weights, mixed, sums)


class _Runs:
    """Rows put in the order of a small number, and where the rows of each number lie."""

    def __init__(self, numbers, size):
        self.order = np.argsort(numbers, kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(numbers))
        stops = np.cumsum(np.bincount(numbers, minlength=size)).tolist()
        self.parts = [(g, slice(a, b)) for g, a, b in zip(range(size), [0, *stops], stops) if b > a]


def _levels(p, vocabulary, hidden, before, classes):
    """Exponents of both levels for target ``classes``, one above the other: of groups in the order of rows, of members by group."""
    n, before = len(classes), before.astype(np.intp)
    target, member = np.divmod(classes, classes.dtype.type(MEMBERS))
    runs = _Runs(target, GROUPS)
    by_group = np.take(hidden, runs.order, axis=0)
    values = np.empty((2 * n, MEMBERS), hidden.dtype)
    np.matmul(hidden, p["groups"], out=values[:n])
    for g, own in runs.parts:
        np.matmul(by_group[own], p["members"][g], out=values[n:][own])
    values[:n] += np.take(vocabulary.group_logs, before, axis=0)
    before *= GROUPS
    before += target
    values[n:] += np.take(vocabulary.member_logs, np.take(before, runs.order), axis=0)
    np.clip(values, -BOUND, BOUND, out=values)
    at = np.arange(0, 2 * n * MEMBERS, MEMBERS)
    at[:n] += target
    at[n:] += np.take(member, runs.order)
    found = np.take(values, at)
    np.exp(values, out=values)
    return values, values @ np.ones(MEMBERS, hidden.dtype), at, runs, by_group, found


def class_logs(p, vocabulary, hidden, before, classes):
    """Log probability of target ``classes``."""
    _, sums, _, runs, _, found = _levels(p, vocabulary, hidden, before, classes)
    logs = found - np.log(sums)
    n = len(classes)
    return logs[:n].astype(np.float64) + np.take(logs[n:], runs.place)


def gradients(p, vocabulary, inputs, targets, valid):
    """Mean loss over valid positions and its gradients; ``targets`` are output classes.

    Windows are worked on in blocks whose arrays stay in a core's cache.
    """
    n, into, loss = max(1, int(valid.sum())), _scaled(p), 0.0
    g = {name: np.zeros_like(p[name]) for name in NAMES}
    dx = np.empty((inputs.size, WIDTH), into.dtype)
    for start in range(0, len(inputs), BLOCK_WINDOWS):
        own = slice(start, start + BLOCK_WINDOWS)
        loss += _add_gradients(g, dx[own.start * WINDOW:own.stop * WINDOW], p, into, vocabulary, inputs[own], targets[own], valid[own], n)
    g["into"][:, :WIDTH] *= into.dtype.type(WIDTH ** -0.5)
    # Rows of one input class are added up behind one another.
    classes = inputs.ravel()
    counts = np.bincount(classes, minlength=IN_CLASSES)
    found = np.flatnonzero(counts)
    g["embed"][found] = np.add.reduceat(np.take(dx, np.argsort(classes, kind="stable"), axis=0), (np.cumsum(counts) - counts)[found])
    return loss, g


def _add_gradients(g, dx, p, into, vocabulary, inputs, targets, valid, n):
    """Add the gradients of a block to ``g``, those of the scaled projection for ``into``; ``dx`` takes those of the inputs."""
    hidden, (x, q, k, v, weights, mixed, sums) = forward(p, inputs, 0, into)
    e, level_sums, at, runs, by_group, found = _levels(p, vocabulary, hidden, inputs.ravel(), targets.ravel())
    rows, scale = inputs.size, (valid.ravel() / n).astype(hidden.dtype)
    scale = np.concatenate([scale, np.take(scale, runs.order)])
    loss = scale @ (np.log(level_sums) - found)
    e *= (scale / level_sums)[:, None]
    e.reshape(-1)[at] -= scale
    d, e = e[:rows], e[rows:]
    g["groups"] += hidden.T @ d
    back = np.empty_like(hidden)
    for number, part in runs.parts:
        g["members"][number] += by_group[part].T @ e[part]
        np.matmul(e[part], p["members"][number].T, out=back[part])
    np.matmul(d, p["groups"].T, out=dx)
    dx += np.take(back, runs.place, axis=0)
    g["wo"] += mixed.reshape(-1, WIDTH).T @ dx
    # One more column takes the mean over the weights off.
    dmixed = np.empty((*inputs.shape, WIDTH + 1), x.dtype)
    np.divide((dx @ p["wo"].T).reshape(x.shape), sums, out=dmixed[..., :-1])
    np.negative(np.einsum("abc,abc->ab", dmixed[..., :-1], mixed), out=dmixed[..., -1])
    dweights = dmixed @ v.transpose(0, 2, 1)
    dweights *= weights
    dboth = np.empty((*inputs.shape, 3 * WIDTH), x.dtype)
    np.matmul(dweights, k, out=dboth[..., :WIDTH])
    np.matmul(dweights.transpose(0, 2, 1), q, out=dboth[..., WIDTH:2 * WIDTH])
    np.matmul(weights.transpose(0, 2, 1), dmixed[..., :-1], out=dboth[..., 2 * WIDTH:])
    dboth = dboth.reshape(-1, 3 * WIDTH)
    g["into"] += x.reshape(-1, WIDTH).T @ dboth
    dx += dboth @ into.T
    g["place"] += dx.reshape(x.shape).sum(axis=0)
    return loss


class Trainer:
    """A copy of the parameters that goes on learning, by Adam, from one part of windows to the next."""

    def __init__(self, p, vocabulary, rate=RATE):
        self.p, self.vocabulary, self.rate, self.step = {n: x.copy() for n, x in p.items()}, vocabulary, rate, 0
        self.mean, self.square = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))

    def learn(self, inputs, targets, valid):
        """Every window once, in an order that the windows themselves decide."""
        order = np.random.default_rng(zlib.crc32(targets.tobytes())).permutation(len(inputs))
        for start in range(0, len(order), STEP_WINDOWS):
            rows = order[start:start + STEP_WINDOWS]
            _, g = gradients(self.p, self.vocabulary, inputs[rows], targets[rows], valid[rows])
            self.step += 1
            pace = self.rate / (1 + self.step / 100) ** 0.5 / (1 - 0.9 ** self.step)
            for n in NAMES:
                m, s = self.mean[n], self.square[n]
                m += 0.1 * (g[n] - m)
                s += 0.01 * (g[n] ** 2 - s)
                self.p[n] -= (pace * m / (np.sqrt(s / (1 - 0.99 ** self.step)) + 1e-8)).astype(np.float32)


def windows_of(lengths):
    """Windows over texts of so many ids each, the end counted: text, first position, first position that it scores.

    A later window begins ``OVERLAP`` positions before the first that it scores, so that
    every position is scored once and, but at a text's start, with context.
    """
    targets = np.asarray(lengths, np.int64) + 1
    step = WINDOW - OVERLAP
    count = 1 + np.maximum(0, -(-(targets - WINDOW) // step))
    text = np.repeat(np.arange(len(targets)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = number * step
    return text, first, np.where(number > 0, first + OVERLAP, 0)


class Laid:
    """Texts of ids behind one another, each between two ends, ready to be cut into windows."""

    def __init__(self, ids, lengths, vocabulary):
        lengths = np.asarray(lengths, np.int64)
        self.lengths = lengths
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        sequence = np.full(int(lengths.sum()) + len(lengths) + 1 + WINDOW, vocabulary.end, np.int32)
        sequence[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths) + 1] = ids
        self.inputs, self.ids = vocabulary.in_class[sequence], sequence

    def steps(self):
        """The input class and the target id of every step, once."""
        n = len(self.ids) - WINDOW - 1
        return self.inputs[:n], self.ids[1:n + 1]

    def windows(self, text, first, scored):
        """Input classes, target ids and validity of windows."""
        position = (first[:, None] + np.arange(WINDOW)).astype(np.int32)
        at = self.starts[text].astype(np.int32)[:, None] + position
        valid = (position >= scored[:, None]) & (position <= self.lengths[text][:, None])
        return self.inputs[at], self.ids[at + 1], valid


def log_probabilities(p, vocabulary, ids, lengths, batch=BLOCK_WINDOWS):
    """Natural log probability of each text of ``lengths`` ids, its end included."""
    laid, into = Laid(ids, lengths, vocabulary), _scaled(p)
    text, first, scored = windows_of(lengths)
    sums = np.empty(len(text))
    # Positions that a later window repeats are only looked back at.
    for start, windows in ((0, np.flatnonzero(scored == 0)), (OVERLAP, np.flatnonzero(scored))):
        for row in range(0, len(windows), batch):
            own = windows[row:row + batch]
            inputs, targets, valid = laid.windows(text[own], first[own], scored[own])
            hidden = forward(p, inputs, start, into)[0]
            kept = np.flatnonzero(valid[:, start:])
            before, want = inputs[:, start:].ravel()[kept], targets[:, start:].ravel()[kept]
            if len(kept) < len(hidden):
                hidden = np.take(hidden, kept, axis=0)
            found = class_logs(p, vocabulary, hidden, before, vocabulary.out_class(want)) + vocabulary.within(before, want)
            sums[own] = np.bincount(kept // (WINDOW - start), found, len(own))
    return np.bincount(text, sums, len(lengths))
