"""The arithmetic of a gated recurrent language model, in numpy.

Texts are sequences of units; a unit is the end, a frequent word, or a bucket of other words.
Units are dealt to classes, and the output softmax is factored: the class from the state, then
the unit in its class from the state. Gradients go back through windows of STEPS units; the state
goes on from window to window, so a text of any length is scored whole. Learning reads texts in
pieces of PIECE units, each from an empty state but with the unit before it as its first input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

CLASSES = 16
STATE = 16
STEPS = 8
#: Lanes of learning have so many units at least, so a packing makes about LANE / STEPS steps.
LANES, LANE = 256, 1 << 12
SCORED_LANES, SCORED_STEPS = 256, 32
PIECE = 1024
RATE = 0.5
FLOOR = 1e-5
#: Bounds of the parameters: exponents stay far from overflow.
BOUND = {"x": 12, "u": 2, "b": 4, "c": 3, "w": 3}
LEAST_CHANCE = 1e-30
#: Units of a packing of learning; the last one holds up to twice as many, so none is a small rest,
#: whose few lanes would make as many steps, and as large ones, as those of a whole packing.
PACKED = 1 << 20
#: Units of a packing of scoring. In a large one the longest text leaves few steps with few lanes.
SCORED_PACKED = 1 << 22


class Weights:
    """Parameters, by name, as float32 arrays."""

    def __init__(self, mass: np.ndarray):
        """``mass``: (CLASSES, size) unigram masses of the units, zero where there is none."""
        draw = np.random.default_rng(17)
        self.size = mass.shape[1]
        self.units = mass.size
        in_class = mass.sum(1)
        low = np.float64(1e-12)
        self.p = {
            # The last input is the start of a text.
            "x": draw.normal(0, 0.1, (self.units + 1, 3 * STATE)),
            "u": draw.normal(0, STATE**-0.5, (STATE, 3 * STATE)),
            "b": np.zeros(3 * STATE),
            # The last row is the bias: unigram masses, so an unfitted model is a unigram model.
            "c": draw.normal(0, 0.1, (STATE + 1, CLASSES)),
            "w": draw.normal(0, 0.05, (CLASSES, STATE + 1, self.size)),
        }
        self.p["c"][-1] = np.log(np.maximum(in_class / max(in_class.sum(), low), low))
        self.p["w"][:, -1] = np.log(np.maximum(mass / np.maximum(in_class, low)[:, None], low))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


class Packing:
    """Texts laid end to end in lanes of about equal length, the longest lane first.

    The lanes are kept one after the other in flat arrays, so the room they take is that of their
    units, however uneven they are.
    """

    def __init__(self, numbered: list[tuple], lanes: int, lane: int = 1):
        """``numbered``: (text number, units, inputs); ``lane``: units that make a lane worth while."""
        count = max(1, min(lanes, len(numbered), sum(len(x[1]) for x in numbered) // lane))
        heap = [(0, k) for k in range(count)]
        rows: list[list[tuple]] = [[] for _ in range(count)]
        for x in numbered:
            load, k = heapq.heappop(heap)
            rows[k].append(x)
            heapq.heappush(heap, (load + len(x[1]), k))
        rows.sort(key=lambda row: -sum(len(x[1]) for x in row))
        placed = [x for row in rows for x in row]
        self.loads = np.array([sum(len(x[1]) for x in row) for row in rows])
        self.first = np.cumsum(self.loads) - self.loads
        # One place more, which fills the ends of the lanes.
        self.units = np.concatenate([*[x[1] for x in placed], [-1]]).astype(np.int32)
        self.inputs = np.concatenate([*[x[2] for x in placed], [0]]).astype(np.int32)
        sizes = [len(x[1]) for x in placed]
        self.whose = np.append(np.repeat([x[0] for x in placed], sizes), -1).astype(np.int32)
        self.fresh = np.zeros(len(self.units), bool)
        self.fresh[np.cumsum(sizes) - sizes] = True

    def windows(self, steps: int, lanes: int) -> Iterator[tuple]:
        """(begin, units, inputs, fresh, text numbers), by step and lane.

        With few lanes left windows are longer, so that they hold about ``steps`` * ``lanes`` units.
        """
        at = 0
        while at < self.loads[0]:
            live = int(np.searchsorted(-self.loads, -at))
            size = min(steps * max(1, lanes // live), int(self.loads[0]) - at)
            step = at + np.arange(size)[:, None]
            place = np.where(step < self.loads[:live], step + self.first[:live], len(self.units) - 1)
            yield at, *(np.take(x, place) for x in (self.units, self.inputs, self.fresh, self.whose))
            at += size


def packings(texts: Iterator[tuple], lanes: int, sort: bool, most: int, lane: int = 1) -> Iterator[Packing]:
    """(units, inputs) of texts in packings of about ``most`` units, if no single text is longer.

    The last one holds what is left beside it, too.
    """
    whole, part, size = [], [], 0

    def pack(some: list[tuple]) -> Packing:
        # With the long ones first the lanes come out even; learning wants lengths mixed.
        return Packing(sorted(some, key=lambda x: -len(x[1])) if sort else some, lanes, lane)

    for number, (units, inputs) in enumerate(texts):
        part.append((number, units, inputs))
        size += len(units)
        if size >= most:
            if whole:
                yield pack(whole)
            whole, part, size = part, [], 0
    if whole or part:
        yield pack(whole + part)


def _with_inputs(texts: Iterator[np.ndarray], start: int, piece: int | None = None) -> Iterator[tuple]:
    """Units and, for each, the unit before it; of whole texts or of their pieces."""
    for text in texts:
        before = np.empty_like(text)
        before[:1], before[1:] = start, text[:-1]
        for a in range(0, len(text), piece or max(len(text), 1)):
            b = a + (piece or len(text))
            yield text[a:b], before[a:b]


def _forward(p: dict, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None) -> np.ndarray:
    """States after every step; with ``keep``, what the way back needs is added to it.

    Both gates and the new state lie one after the other at a step, so that each is contiguous.
    """
    n = STATE
    u = np.ascontiguousarray(p["u"].reshape(n, 3, n).transpose(1, 0, 2))
    # The inputs' parts become the gates and the new state in place.
    x = np.take(p["x"].reshape(-1, n), 3 * inputs[:, None] + np.arange(3, dtype=inputs.dtype)[:, None], axis=0)
    x += np.repeat(p["b"].reshape(3, 1, n), len(h), axis=1)
    starts = fresh.any(1).tolist()
    shape = len(inputs), len(h)
    out = np.empty((*shape, n), np.float32)
    g = np.empty((3, len(h), n), np.float32)
    of_gates, of_new, update = g[:2], g[2], x[:, :2]
    if keep is not None:
        keep += [np.empty((*shape, n), np.float32), x, np.empty((*shape, n), np.float32)]
    for t in range(len(inputs)):
        if starts[t]:
            h = h.copy()
            h[fresh[t]] = 0
        np.matmul(h, u, out=g)
        # Both gates at once, as 1 / (1 + exp(-a)); BOUND keeps the exponents finite.
        gates, new = update[t], x[t, 2]
        gates += of_gates
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        if keep is not None:
            keep[0][t], keep[2][t] = h, of_new
        of_new *= gates[1]
        new += of_new
        np.tanh(new, out=new)
        h = np.subtract(h, new, out=out[t])
        h *= gates[0]
        h += new
    return out


def _backward(kept: list, from_out: np.ndarray, fresh: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients at the gates and the new state: of the inputs' part, and of the states' part."""
    old, parts, g = kept
    n = STATE
    z, r, new = parts[:, 0], parts[:, 1], parts[:, 2]
    steps, live = fresh.shape
    # By how much what comes back changes the three: update gate, reset gate by the new state, new state.
    rest = 1 - z
    by_z = old - new
    by_z *= z
    by_z *= rest
    by_new = new * new
    np.subtract(1, by_new, out=by_new)
    by_new *= rest
    by_r = g * r
    by_r *= np.subtract(1, r, out=rest)
    grad_x = np.empty((steps, live, 3 * n), np.float32)
    grad_g = np.empty((steps, live, 3 * n), np.float32)
    later = np.zeros((live, n), np.float32)
    turned = np.ascontiguousarray(u.T)
    starts = fresh.any(1).tolist()
    for t in range(steps - 1, -1, -1):
        later += from_out[t]
        at_x, at_g, at_new = grad_x[t], grad_g[t], by_new[t]
        at_new *= later
        at_x[:, 2 * n :] = at_new
        np.multiply(later, by_z[t], out=at_x[:, :n])
        np.multiply(at_new, by_r[t], out=at_x[:, n : 2 * n])
        at_g[:, : 2 * n] = at_x[:, : 2 * n]
        np.multiply(at_new, r[t], out=at_g[:, 2 * n :])
        later *= z[t]
        later += at_g @ turned
        if starts[t]:
            later[fresh[t]] = 0
    return grad_x, grad_g


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each the sum of its values; rows that occur once are not added up."""
    # Short integers are sorted by radix.
    order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
    ordered = rows[order]
    new = np.empty(len(ordered) + 1, bool)
    new[:1], new[-1:] = True, True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:-1])
    bounds = np.flatnonzero(new)
    first, often = bounds[:-1], bounds[1:] - bounds[:-1]
    sums = np.take(values, order[first], axis=0)
    again = often > 1
    if again.any():
        size = often[again]
        some = np.take(values, order[np.repeat(again, often)], axis=0)
        sums[again] = np.add.reduceat(some, np.cumsum(size) - size, axis=0)
    return ordered[first], sums


def _with_one(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states in this order, each with a one for the bias."""
    out = np.ones((len(order), STATE + 1), np.float32)
    out[:, :-1] = np.take(states, order, axis=0)
    return out


def _by_class(units: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Places of the units (without the fill) by class; their classes and places in them; bounds of the classes."""
    kind = (units // size).astype(np.int16)
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    left = np.searchsorted(kind, 0)
    order, kind = order[left:], kind[left:].astype(np.intp)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=CLASSES))])
    return order, kind, units[order] - kind * size, bounds


def _states(table: np.ndarray, u: np.ndarray, places: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The states of ``_forward`` by step, model, lane, from parts of the inputs that have the bias already.

    The gates' parts in ``table`` and ``u`` are taken with the other sign. ``places``: rows of the table by step,
    part, model and lane.
    """
    starts = fresh.any(1).tolist()
    out = np.empty((len(places), *h.shape), np.float32)
    x, g = np.empty((2, 3, *h.shape), np.float32)
    gates, new, of_gates, of_new = x[:2], x[2], g[:2], g[2]
    for t in range(len(places)):
        if starts[t]:
            h = h.copy()
            h[:, fresh[t]] = 0
        np.take(table, places[t], axis=0, out=x, mode="clip")
        np.matmul(h, u, out=g)
        gates += of_gates
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        of_new *= gates[1]
        new += of_new
        np.tanh(new, out=new)
        h = np.subtract(h, new, out=out[t])
        h *= gates[0]
        h += new
    return out


def score(weights: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of every text's units."""
    return score_each([weights], texts)[0]


def score_each(models: list[Weights], texts: list[np.ndarray]) -> np.ndarray:
    """The same by model and text, for models of one size; their steps are made together."""
    size, n, count = models[0].size, STATE, len(models)
    ones = np.ones(max(CLASSES, size), np.float32)
    total = np.zeros((count, len(texts)))
    table = np.concatenate([m.p["x"] + m.p["b"] for m in models]).reshape(-1, 3, n)
    u = np.stack([m.p["u"].reshape(n, 3, n).transpose(1, 0, 2) for m in models], axis=1)
    np.negative(table[:, :2], out=table[:, :2])
    np.negative(u[:2], out=u[:2])
    parts = np.arange(3)[:, None, None] + 3 * len(models[0].p["x"]) * np.arange(count)[:, None]
    # Bounded weights make exponents safe without taking off the maximum.
    most = SCORED_LANES * SCORED_STEPS
    room = np.empty((most, size), np.float32)
    first = np.arange(most) * size
    for packing in packings(_with_inputs(iter(texts), models[0].units), SCORED_LANES, True, SCORED_PACKED):
        h = np.zeros((count, len(packing.loads), n), np.float32)
        for _, units, inputs, fresh, whose in packing.windows(SCORED_STEPS, SCORED_LANES):
            places = 3 * inputs[:, None, None].astype(np.intp) + parts
            every = _states(table.reshape(-1, n), u, places, fresh, h[:, : units.shape[1]])
            h = every[-1]
            # In the order of the classes.
            order, kind, inside, bounds = _by_class(units.ravel(), size)
            present = np.flatnonzero(bounds[1:] > bounds[:-1]).tolist()
            at, texts_at = np.arange(len(order)), whose.ravel()[order]
            for model, states, sums in zip(models, every.swapaxes(0, 1), total):
                p = model.p
                flat = _with_one(states.reshape(-1, n), order)
                e = flat @ p["c"]
                np.exp(e, out=e)
                chance = e[at, kind] / (e @ ones[:CLASSES])
                for c in present:
                    a, b = bounds[c : c + 2].tolist()
                    e = np.matmul(flat[a:b], p["w"][c], out=room[: b - a])
                    np.exp(e, out=e)
                    chance[a:b] *= np.take(room, first[: b - a] + inside[a:b]) / (e @ ones[:size])
                sums += np.bincount(texts_at, np.log(np.maximum(chance, LEAST_CHANCE)), len(texts))
    return total


def train(weights: Weights, texts: Iterator[np.ndarray], had: dict | None = None) -> tuple[int, dict]:
    """Fit ``weights`` to the texts by truncated backpropagation.

    Each parameter's step shrinks with the gradients it has had. Returns the number of units
    seen and these sums, from which a later call goes on.
    """
    p, size, n, seen = weights.p, weights.size, STATE, 0
    ones = np.ones(max(size, CLASSES), np.float32)
    places = np.arange(LANES * STEPS)
    # Room for the units of one class in a window, and for the gradients of all classes.
    room = np.empty((LANES * STEPS, size), np.float32)
    slots, first = room.reshape(-1), places * size
    changes = np.empty((CLASSES, n + 1, size), np.float32)
    had = had or {k: np.full(v.shape, FLOOR, np.float32) for k, v in p.items()}

    rate = np.float32(RATE)

    def step(name: str, gradient: np.ndarray, where: np.ndarray | None = None) -> None:
        some = isinstance(where, np.ndarray)
        sums, own = (np.take(x[name], where, axis=0) if some else x[name] for x in (had, p))
        square = gradient * gradient
        sums += square
        gradient *= rate
        gradient /= np.sqrt(sums, out=square)
        own -= gradient
        if some:
            had[name][where], p[name][where] = sums, own

    for packing in packings(_with_inputs(texts, weights.units, PIECE), LANES, False, PACKED, LANE):
        # Short windows at the end of a packing count for less.
        scale = np.float32(1 / (len(packing.loads) * STEPS))
        h = np.zeros((len(packing.loads), n), np.float32)
        # Windows are of STEPS, however few lanes are left.
        for turn, (at, units, inputs, fresh, _) in enumerate(packing.windows(STEPS, 1)):
            live = units.shape[1]
            keep: list = []
            states = _forward(p, inputs, fresh, h[:live], keep)
            h = states[-1]
            order, kind, inside, bounds = _by_class(units.ravel(), size)
            flat = _with_one(states.reshape(-1, n), order)
            seen += len(order)
            # The step shrinks along a packing, and the parameters stay in bounds.
            rate = np.float32(RATE * (1 - 0.9 * at / packing.loads[0]))
            if turn % 32 == 0:
                for name, most in BOUND.items():
                    part = p[name][..., :-1, :] if name in "cw" else p[name]
                    np.clip(part, -most, most, out=part)
                for bias in (p["c"][-1], p["w"][:, -1]):
                    np.clip(bias, -30, 8, out=bias)
            # Classes, then the units in each class.
            push = flat @ p["c"]
            np.exp(push, out=push)
            push *= (scale / (push @ ones[:CLASSES]))[:, None]
            push[places[: len(push)], kind] -= scale
            back = push @ p["c"][:-1].T
            step("c", flat.T @ push)
            present = np.flatnonzero(bounds[1:] > bounds[:-1])
            for k, c in enumerate(present.tolist()):
                a, b = bounds[c : c + 2].tolist()
                own, some = p["w"][c], flat[a:b]
                push = np.matmul(some, own, out=room[: b - a])
                np.exp(push, out=push)
                push *= (scale / (push @ ones[:size]))[:, None]
                slots[first[: b - a] + inside[a:b]] -= scale
                back[a:b] += push @ own[:-1].T
                np.matmul(some.T, push, out=changes[k])
            step("w", changes[: len(present)], present if len(present) < CLASSES else None)
            from_out = np.zeros(states.shape, np.float32)
            from_out.reshape(-1, n)[order] = back
            # Back through the window.
            grad_x, grad_g = _backward(keep, from_out, fresh, p["u"])
            grad_x = grad_x.reshape(-1, 3 * n)
            step("u", keep[0].reshape(-1, n).T @ grad_g.reshape(-1, 3 * n))
            step("b", grad_x.sum(0))
            touched, sums = _sums(inputs.ravel(), grad_x)
            step("x", sums, touched)
    return seen, had
