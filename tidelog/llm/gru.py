"""A gated recurrent language model with a class-factored output, in numpy.

A word's probability is that of its class times that of the word in its class. The
input of a step is the word before, or the end of the document before; documents
stand one after the other in lanes, and the state is zero where one begins. Training
runs backpropagation through windows of ``STEPS`` steps; the state goes on from window to window.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN, CLASSES, STEPS, LANES = 16, 48, 32, 512
RATE, UPDATES, CLIP = 0.08, 64, 5.0
#: States whose classes are told at once, so that their logits stay in a cache.
BLOCK = 2_048


@dataclass
class Model:
    """Parameters, and for each of the arrays its sum of squared slopes (Adagrad).

    The words of class ``k`` are ``bounds[k]`` to ``bounds[k + 1]``; words are in order of frequency.
    """

    bounds: np.ndarray
    arrays: dict[str, np.ndarray]
    squares: dict[str, np.ndarray]

    @property
    def words(self) -> int:
        return int(self.bounds[-1])

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for part in (self.arrays, self.squares) for a in part.values()])

    def load(self, flat: np.ndarray) -> Model:
        at, parts = 0, []
        for part in (self.arrays, self.squares):
            new = {}
            for name, a in part.items():
                new[name] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
                at += a.size
            parts.append(new)
        return Model(self.bounds, *parts)


def classes(counts: np.ndarray, number: int = CLASSES) -> np.ndarray:
    """Bounds of classes of about equal frequency; the last two words (rare, end) are classes of their own."""
    head = counts[:-2].astype(np.float64) + 1e-3
    share = np.cumsum(head) / max(head.sum(), 1e-9)
    cut = np.searchsorted(share, np.arange(1, number) / number) + 1
    n = len(head)
    return np.unique(np.concatenate(([0], cut[cut < n], [n, n + 1, n + 2])))


def start(counts: np.ndarray) -> Model:
    """A model that gives words their frequency: ``counts``, of the rare words and of the end last."""
    rng = np.random.default_rng(11)
    bounds = classes(counts)
    n, h = len(counts), HIDDEN
    smooth = counts.astype(np.float64) + 0.1
    per_class = np.add.reduceat(smooth, bounds[:-1])
    arrays = {
        "input": rng.normal(0, 0.1, (n, 3 * h)),
        "state": rng.normal(0, h**-0.5, (h, 3 * h)),
        "class_weight": np.zeros((h, len(per_class))),
        "class_bias": np.log(per_class / per_class.sum()),
        "word_weight": np.zeros((n, h)),
        "word_bias": np.log(smooth / np.repeat(per_class, np.diff(bounds))),
    }
    arrays = {k: a.astype(np.float32) for k, a in arrays.items()}
    return Model(bounds, arrays, {k: np.full(a.shape, 0.01, np.float32) for k, a in arrays.items()})


@dataclass
class Window:
    """Words before (``given``) and words to tell (``wanted``) of the lanes that go on, step by step.

    ``wanted`` is -1 where a lane is over; lanes of later windows are the first of these.
    """

    given: np.ndarray
    wanted: np.ndarray
    keep: np.ndarray
    owner: np.ndarray


def windows(docs: list[np.ndarray], end: int, lanes: int = LANES) -> Iterator[Window]:
    """Documents (each with its end) in lanes of about equal length, cut into windows."""
    count = max(1, min(lanes, len(docs)))
    heap = [(0, k) for k in range(count)]
    lane: list[list[int]] = [[] for _ in range(count)]
    for d in sorted(range(len(docs)), key=lambda d: (-len(docs[d]), d)):
        size, k = heapq.heappop(heap)
        lane[k].append(d)
        heapq.heappush(heap, (size + len(docs[d]), k))
    # The longest lanes first, so that those that are over drop out at the end.
    sizes = np.zeros(count, np.int64)
    for size, k in heap:
        sizes[k] = size
    order = np.argsort(-sizes, kind="stable")
    # The documents one after the other, lane by lane; a window takes its steps of each lane from there.
    members = [d for k in order for d in lane[k]]
    lengths = np.array([len(docs[d]) for d in members], np.int64)
    words = np.concatenate([docs[d] for d in members])
    owners = np.repeat(np.array(members, np.int32), lengths)
    begins = np.zeros(len(words), bool)
    begins[np.cumsum(lengths) - lengths] = True
    sizes = sizes[order]
    first = np.cumsum(sizes) - sizes
    for a in range(0, int(sizes[0]), STEPS):
        live = int((sizes > a).sum())
        step = np.arange(a, min(a + STEPS, int(sizes[0])))[:, None]
        at = np.minimum(first[:live] + step, len(words) - 1)
        on = step < sizes[:live]
        wanted = np.where(on, words[at].astype(np.int32), -1)
        given = np.where(on & ~begins[at], words[at - 1].astype(np.int32), end)
        keep = (~(on & begins[at])).astype(np.float32)
        yield Window(given, wanted, keep, np.where(on, owners[at], 0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Room:
    """Memory by name that is used again in every window, as fresh pages cost as much as the arithmetic."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size, old = math.prod(shape), self.held.get(name)
        if old is None or old.size < size or old.dtype != kind:
            old = self.held[name] = np.empty(size, kind)
        return old[:size].reshape(shape)


def _gates(a: np.ndarray) -> np.ndarray:
    """The columns of the three gates as arrays of their own, so that steps work on memory without gaps."""
    return np.ascontiguousarray(a.reshape(len(a), 3, HIDDEN).transpose(1, 0, 2))


def _rows(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``a`` at the places ``at``, whose order is free; a fourth of the time of ``a[at]``."""
    return np.take(a.reshape(-1, HIDDEN), at, axis=0)


def _begins(window: Window) -> list[np.ndarray]:
    """For each step the lanes in which a document begins."""
    step, lane = np.nonzero(window.keep == 0)
    return np.split(lane, np.searchsorted(step, np.arange(1, len(window.keep))))


def forward(model: Model, window: Window, state: np.ndarray, room: Room | None = None) -> tuple[np.ndarray, tuple]:
    """States after each step, and what the way back needs: those before, the gates, what ``reset`` weighs, and begins.

    They lie in ``room`` and hold until it is used again.
    """
    room, given = room or Room(), window.given
    into, inner = _gates(model.arrays["input"]), _gates(model.arrays["state"])
    kind, shape = inner.dtype, (*given.shape, HIDDEN)
    gates = room("gates", (3, *shape), kind)
    for gate, table in zip(gates, into):
        np.take(table, given, axis=0, out=gate, mode="clip")
    states, befores, kept = (room(name, shape, kind) for name in ("states", "befores", "kept"))
    three, one = room("three", (3, *shape[1:]), kind), room("one", shape[1:], kind)
    begins = _begins(window)
    for t in range(len(given)):
        before, two, (reset, stay, new) = befores[t], gates[:2, t], gates[:, t]
        before[:] = state
        if len(begins[t]):
            before[begins[t]] = 0
        np.matmul(before, inner, out=three)
        kept[t] = three[2]
        two += three[:2]
        _sigmoid(two)
        new += np.multiply(reset, three[2], out=one)
        np.tanh(new, out=new)
        state = np.subtract(before, new, out=states[t])
        state *= stay
        state += new
    return states, (befores, gates, kept, begins)


def _choice(logits: np.ndarray, pick: np.ndarray, room: Room, wrong: bool) -> np.ndarray:
    """Log-probabilities of the picked columns; if ``wrong``, ``logits`` become the slopes for the logits."""
    pick = np.arange(0, logits.size, logits.shape[1]) + pick
    with np.errstate(over="ignore"):
        exps = np.exp(logits, out=room("exps", logits.shape, logits.dtype))
    sums = np.log(exps.sum(axis=1))
    if not np.isfinite(sums).all():
        top = logits.max(axis=1, keepdims=True)
        sums = np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0]
    flat = logits.reshape(-1)
    told = np.take(flat, pick) - sums
    if wrong:
        logits -= sums[:, None]
        np.exp(logits, out=logits)
        np.negative(logits, out=logits)
        flat[pick] += 1
    return told


def _told(model: Model, states: np.ndarray, wanted: np.ndarray, slopes: dict | None, room: Room | None = None):
    """Log-probabilities of the wanted words; with ``slopes``, also the slope of their sum for the states."""
    a, bounds, room, wrong = model.arrays, model.bounds, room or Room(), slopes is not None
    kind = np.repeat(np.arange(len(bounds) - 1, dtype=np.int16), np.diff(bounds))[wanted]
    order = np.argsort(kind, kind="stable")
    states, wanted, kind = _rows(states, order), wanted[order], kind[order]
    told, whole = np.empty(len(wanted), states.dtype), len(wanted) if wrong else BLOCK
    logits = room("logits", (whole, len(bounds) - 1), states.dtype)
    for k in range(0, len(wanted), BLOCK):
        part = slice(k, min(k + BLOCK, len(wanted)))
        here = logits[part] if wrong else logits[: part.stop - k]
        np.matmul(states[part], a["class_weight"], out=here)
        here += a["class_bias"]
        told[part] = _choice(here, kind[part], room, wrong)
    if wrong:
        slopes["class_weight"], slopes["class_bias"] = states.T @ logits, logits.sum(axis=0)
        back = logits @ a["class_weight"].T
        slopes["word_weight"], slopes["word_bias"] = np.zeros_like(a["word_weight"]), np.zeros_like(a["word_bias"])
    edges = np.searchsorted(kind, np.arange(len(bounds)))
    for k in np.flatnonzero((np.diff(edges) > 0) & (np.diff(bounds) > 1)):
        part, own = slice(edges[k], edges[k + 1]), slice(bounds[k], bounds[k + 1])
        weight, bias, near = a["word_weight"][own], a["word_bias"][own], states[part]
        logits = np.matmul(near, weight.T, out=room("words", (len(near), len(bias)), states.dtype))
        logits += bias
        told[part] += _choice(logits, wanted[part] - bounds[k], room, wrong)
        if wrong:
            slopes["word_weight"][own] = logits.T @ near
            slopes["word_bias"][own] = logits.sum(axis=0)
            back[part] += logits @ weight
    undo = np.empty_like(order)
    undo[order] = np.arange(len(order))
    return (told[undo], _rows(back, undo)) if wrong else told[undo]


def score(model: Model, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-probability of each whole document."""
    total = np.zeros(len(docs))
    state, room = None, Room()
    for window in windows(docs, end):
        if state is None:
            state = np.zeros((window.given.shape[1], HIDDEN), np.float32)
        states, _ = forward(model, window, state[: window.given.shape[1]], room)
        state = states[-1]
        at = np.flatnonzero(window.wanted >= 0)
        told = _told(model, _rows(states, at), window.wanted.ravel()[at], None, room)
        total += np.bincount(window.owner.ravel()[at], told, len(docs))
    return total


def slopes(
    model: Model, window: Window, state: np.ndarray, room: Room | None = None
) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Slopes of the sum of log-probabilities in a window, the state after it, and the sum."""
    a, h, room = model.arrays, HIDDEN, room or Room()
    states, (befores, gates, kept, begins) = forward(model, window, state, room)
    at = np.flatnonzero(window.wanted >= 0)
    out: dict[str, np.ndarray] = {}
    told, back = _told(model, _rows(states, at), window.wanted.ravel()[at], out, room)
    wide = back.reshape(states.shape) if len(at) == window.wanted.size else np.zeros_like(states)
    if len(at) < window.wanted.size:
        wide.reshape(-1, h)[at] = back
    # Slopes of what goes into the gates: of the input's part, and, as ``reset`` weighs it, of the state's.
    outer = room("outer", gates.shape, gates.dtype)
    inner = room("inner", (*states.shape[:2], 3, h), states.dtype)
    weight, later, ones = a["state"].T, np.zeros_like(states[0]), room("three", gates[:2, 0].shape, states.dtype)
    for t in range(len(states) - 1, -1, -1):
        two, (reset, stay, new), (wipe, hold, fresh), slope = gates[:2, t], gates[:, t], outer[:, t], wide[t]
        slope += later
        np.subtract(befores[t], new, out=hold)
        hold *= slope
        np.subtract(1, two, out=ones)
        np.multiply(slope, ones[1], out=fresh)
        new *= new
        np.subtract(1, new, out=new)
        fresh *= new
        np.multiply(fresh, kept[t], out=wipe)
        outer[:2, t] *= two
        outer[:2, t] *= ones
        inner[t, :, :2] = outer[:2, t].transpose(1, 0, 2)
        np.multiply(fresh, reset, out=inner[t, :, 2])
        slope *= stay
        np.matmul(inner[t].reshape(-1, 3 * h), weight, out=later)
        later += slope
        if len(begins[t]):
            later[begins[t]] = 0
    out["state"] = befores.reshape(-1, h).T @ inner.reshape(-1, 3 * h)
    given = window.given.ravel().astype(np.uint16)  # numbers of 16 bits are sorted digit by digit
    order = np.argsort(given, kind="stable")
    given = given[order]
    first = np.flatnonzero(np.concatenate(([True], given[1:] != given[:-1])))
    out["input"] = np.concatenate([np.add.reduceat(_rows(x, order), first) for x in outer], axis=1)
    out["input_rows"] = given[first]
    return out, states[-1], float(told.sum())


def train(model: Model, docs: list[np.ndarray], end: int) -> tuple[float, int]:
    """One pass over the documents, in place: one step of Adagrad for each window. Returns log-probability and words."""
    size = sum(map(len, docs))
    lanes = int(np.clip(size // (STEPS * UPDATES), 16, LANES))
    total, words, state, room = 0.0, 0, None, Room()
    for window in windows(docs, end, lanes):
        if state is None:
            state = np.zeros((window.given.shape[1], HIDDEN), np.float32)
        found, state, told = slopes(model, window, state[: window.given.shape[1]], room)
        count = int((window.wanted >= 0).sum())
        total, words = total + told, words + count
        touched = found.pop("input_rows")
        norm = np.sqrt(sum(float((s * s).sum()) for s in found.values())) / count
        scale = np.float32(min(1.0, CLIP / max(norm, 1e-9)) / count**0.5)
        for name, slope in found.items():
            rows = touched if name == "input" else slice(None)
            slope *= scale
            square = model.squares[name][rows]
            square += slope * slope
            if name == "input":
                model.squares[name][rows] = square
            slope *= RATE
            slope /= np.sqrt(square)
            model.arrays[name][rows] += slope
    return total, words
