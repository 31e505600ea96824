"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a vector of two parts, both trained with the network.  The word
part is a row of a table, for the words that go with either label in the
training texts (it begins as their shrunken log odds ratio).  The character part
is the mean of the rows of the word's byte trigrams in another table, so that
unseen spellings have a vector, too.  Two GRUs read a window of words in both
directions, attention pools their states, a logistic unit scores the pool.
Windows overlap by half; all of them are scored, and a text's score is its most
toxic window's, calibrated on texts that the network has not been fitted to.

Fitting begins with the windows that hold the most telling words, then takes all
windows of a text at once: a text's logit is a soft maximum over its windows'.

Fitting takes a bounded sample of labelled rows on the driver: of either label at
most ``MOST_TRAINING``, by the order of a hash of their ids, until they have
``MOST_WORDS`` words.  Rows are taken whole, with all windows of their texts, however
long; the driver keeps numbers of words only.  Near copies among the texts are dropped first, so that a wrongly
labelled text with many copies does not count as many witnesses.  A fifth of the
texts are not fitted but calibrate the score.  Scoring covers every window of
every text, in batches of bounded size.

Defined results: null texts count as empty; an empty text is one window of
padding and gets that window's score; without labelled rows of both kinds every
score is the share of positive labels (0.5 if there are none); a text's score is
its highest window's, ties between windows make no difference; repeated rows get
equal scores; null ids are never held out and never learnt from; of a labelled id
with several texts the smallest text is learnt from; an empty table gives an
empty table; only the columns named are read, whatever others are called.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

MOST_TRAINING = 2000  #: labelled rows of either label that fitting takes at most
MOST_WORDS = 900_000  #: words of either label's rows from which on fitting takes no further rows; those that it takes are taken whole
WINDOW, STRIDE = 40, 20
HIDDEN, CODE = 8, 5
SIGNIFICANT = 2.8  #: standard errors by which a word must go with a label to have a row
TRIGRAMS = 1 << 14  #: rows of the table of trigrams
NEAR = 4  #: of four minima of hashes that a near copy has in common with an earlier text
DEVELOPMENT = 5  #: one of so many training texts calibrates
SOFT = 1e-3  #: windows with less of a text's soft maximum are taken as having none of its gradient
THRESHOLD = 0.7
TOGETHER = 2048  #: windows in a batch of texts, about
BATCH = 4096  #: windows scored at a time
GROUP_CHARS = 3_000_000  #: characters of text read at a time
EDGE = string.punctuation + "…“”‘’«»¿¡"


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case, punctuation still attached."""
    return text.lower().split()


def _trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words (each between two spaces), and where each word's begin."""
    raw = [w.encode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    flat = np.frombuffer(b"".join([b" " + r + b" " for r in raw]), dtype=np.uint8).astype(np.int64)
    all_at = (flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) * 40503 % 65521 % TRIGRAMS
    starts = np.cumsum(sizes + 2) - sizes - 2
    keep = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return all_at[keep], np.cumsum(sizes) - sizes


@dataclass
class Model:
    """All that scoring needs; small enough to travel with a task."""

    vocab: dict[str, int]
    word: np.ndarray
    trigram: np.ndarray
    par: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    losses: list[float] = field(default_factory=list)

    def inputs(self, words: list[str]) -> np.ndarray:
        """The vectors of words; row 0 is padding."""
        return Inputs(self, words).vectors(np.arange(len(words) + 1))


class Inputs:
    """The words of some texts as rows of the model's tables; number 0 is padding, word k has number k + 1."""

    def __init__(self, model: Model, words: list[str]) -> None:
        self.model = model
        get = model.vocab.get
        own = ((get(w, -1), w) for w in words)
        self.row = np.array([-1, *(r if r >= 0 else get(w.strip(EDGE), -1) for r, w in own)], dtype=np.int64)
        buckets, starts = _trigram_buckets(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.buckets = buckets
        self.size = np.concatenate([[0], np.diff(np.append(starts, len(buckets)))]).astype(np.int64)
        self.start = np.concatenate([[0], starts]).astype(np.int64)

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the numbered words, and which of the numbers each belongs to."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.repeat(self.start[numbers] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.buckets[at], np.repeat(np.arange(len(numbers)), size)

    def vectors(self, numbers: np.ndarray) -> np.ndarray:
        word, trigram = self.model.word, self.model.trigram
        out = np.zeros((len(numbers), word.shape[1] + trigram.shape[1]), dtype=np.float32)
        row = self.row[numbers]
        out[row >= 0, : word.shape[1]] = word[row[row >= 0]]
        buckets, _ = self.spread(numbers)
        some = self.size[numbers] > 0
        if some.any():
            size = self.size[numbers][some]
            out[some, word.shape[1] :] = np.add.reduceat(trigram[buckets], np.cumsum(size) - size, axis=0) / size[:, None]
        return out

    def gradients(self, numbers: np.ndarray, d_x: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(rows, gradient) of the word table and of the table of trigrams, from those of the vectors."""
        width = self.model.word.shape[1]
        row = self.row[numbers]
        buckets, owner = self.spread(numbers)
        shares = d_x[:, width:] / np.maximum(self.size[numbers], 1)[:, None]
        return _summed(row[row >= 0], d_x[row >= 0, :width]), _summed(buckets, shares[owner])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(values[order], at, axis=0)


def windows_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words; at least one."""
    return np.arange(0, max(1, n - STRIDE), STRIDE)


def _windowed(ids: np.ndarray) -> np.ndarray:
    """Word numbers of every window of a text; 0 pads."""
    starts = windows_of(len(ids))
    padded = np.zeros(int(starts[-1]) + WINDOW, dtype=np.int32)
    padded[: len(ids)] = ids
    return padded[starts[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _read(gates: np.ndarray, ids: np.ndarray, u: np.ndarray, backward: bool, trace: list | None = None) -> np.ndarray:
    """States (step, window, unit) of one GRU whose input parts per word are ``gates``."""
    n, steps = ids.shape
    h = np.zeros((n, HIDDEN), dtype=np.float32)
    states = np.empty((steps, n, HIDDEN), dtype=np.float32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        x, hu = gates[ids[:, t]], h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        if trace is not None:
            trace.append((t, h, z, r, new, hu[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        states[t] = h
    return states


def forward(par: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, traces: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Logits of windows; and states, attention and pool for the way back."""
    parts = [_read(x @ par[f"w{d}"] + par[f"b{d}"], ids, par[f"u{d}"], d == 1, traces and traces[d]) for d in (0, 1)]
    states = np.concatenate(parts, axis=2)
    score = states @ par["att"]
    score[(ids == 0).T & (ids != 0).any(axis=1)] = -1e9
    score -= score.max(axis=0)
    weight = np.exp(score)
    weight /= weight.sum(axis=0)
    pool = np.einsum("tn,tnh->nh", weight, states)
    return pool @ par["out"] + par["bias"][0], states, weight, pool


def gradients(par: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, slope) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Logits and gradients by back-propagation through time; ``slope`` maps logits to the loss's derivatives by them.

    The gradient ``x`` is that of the vectors.
    """
    traces: tuple[list, list] = ([], [])
    logit, states, weight, pool = forward(par, x, ids, traces)
    d_logit = slope(logit).astype(np.float32)
    grad = {"out": pool.T @ d_logit, "bias": np.array([d_logit.sum()], dtype=np.float32), "x": np.zeros_like(x)}
    d_pool = d_logit[:, None] * par["out"]
    d_weight = np.einsum("tnh,nh->tn", states, d_pool)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["att"] = np.einsum("tn,tnh->h", d_score, states)
    d_states = weight[:, :, None] * d_pool + d_score[:, :, None] * par["att"]
    for d in (0, 1):
        u = par[f"u{d}"]
        d_u = np.zeros_like(u)
        d_h = np.zeros((len(ids), HIDDEN), dtype=np.float32)
        gates, read = [], []
        for t, h, z, r, new, hu_new in reversed(traces[d]):
            d_h = d_h + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            d_new = d_h * (1 - z) * (1 - new * new)
            d_z = d_h * (h - new) * z * (1 - z)
            d_r = d_new * hu_new * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
            gates.append(np.concatenate([d_z, d_r, d_new], axis=1))
            read.append(ids[:, t])
            d_u += h.T @ d_hu
            d_h = d_h * z + d_hu @ u.T
        which, sums = _summed(np.concatenate(read), np.concatenate(gates))
        grad |= {f"u{d}": d_u, f"w{d}": x[which].T @ sums, f"b{d}": sums.sum(axis=0)}
        grad["x"][which] += sums @ par[f"w{d}"].T
    return logit, grad


def backward(par: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of windows with labels of their own."""
    logit, grad = gradients(par, x, ids, lambda v: weights * (_sigmoid(v.copy()) - y) / len(y))
    return float(np.mean(weights * (np.logaddexp(0, logit) - y * logit))), grad


def soft_maximum(logits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the soft maximum of its windows' logits (log of the mean of exponentials), and each window's share in it."""
    at = np.cumsum(sizes) - sizes
    top = np.maximum.reduceat(logits, at)
    power = np.exp(logits - np.repeat(top, sizes))
    total = np.add.reduceat(power, at)
    return top + np.log(total / sizes), power / np.repeat(total, sizes)


def _minhashes(words: list[str], k: int = 4) -> list[int]:
    """A few minima of hashed word triples: near copies share some."""
    if len(words) < 3:
        return []
    hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), dtype=np.uint64, count=len(words))
    triples = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]
    out = []
    for i in range(k):
        mixed = (triples ^ np.uint64(0x1234567 * (i + 1))) * np.uint64(0xD6E8FEB86659FD93 + 2 * i)
        out.append((i << 64) | int((mixed ^ (mixed >> np.uint64(29))).min()))
    return out


def training_text(text: str) -> str:
    """What fitting takes of a text: all of its words."""
    return " ".join(words_of(text))


class Texts:
    """Training texts as windows of word numbers; the texts themselves are not kept."""

    def __init__(self, rows: Iterable[tuple[str, int]]) -> None:
        number: dict[str, int] = {}
        first: dict[int, int] = {}
        self.cut: list[np.ndarray] = []
        self.label: list[int] = []
        self.labels_given: list[int] = []
        for given, label in rows:
            self.labels_given.append(label)
            words = words_of(given)
            marks = _minhashes(words)
            shared = Counter(first[m] for m in marks if m in first)
            if max(shared.values(), default=0) >= NEAR:
                continue
            for m in marks:
                first.setdefault(m, len(self.cut))
            self.cut.append(_windowed(np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.int32)))
            self.label.append(label)
        self.words = list(number)


def fit(rows: Iterable[tuple[str, int]], of_all: tuple[int, int] | None = None, epochs: int = 5, whole_epochs: int = 3, seed: int = 7) -> Model:
    """Train on (text, label) pairs; in place of a text also what :func:`training_text` takes of it.

    ``of_all``: how many negative and positive rows there are of which ``rows`` is a sample (none given: the sample itself).
    """
    rng = np.random.default_rng(seed)
    texts = Texts(rows)
    y = np.array(texts.label, dtype=np.float32)
    n_pos = int(y.sum())
    n_neg = len(y) - n_pos
    if not n_pos or not n_neg:
        share = sum(texts.labels_given) / len(texts.labels_given) if texts.labels_given else 0.5
        return Model({}, np.zeros((1, 1 + CODE), np.float32), np.zeros((TRIGRAMS, 1 + CODE), np.float32), {}, constant=share)
    # Every DEVELOPMENT-th text of either label stays out of all that is fitted and calibrates, if there are enough.
    rank = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y == 0))
    kept_out = (rank % DEVELOPMENT == 0) & (min(n_pos, n_neg) >= 4 * DEVELOPMENT)
    fitted = np.flatnonzero(~kept_out).tolist()
    own_cut, labels = [texts.cut[i] for i in fitted], y[fitted]
    model = _begin(own_cut, labels, texts.words, rng)
    inputs = Inputs(model, texts.words)
    optimiser = Adam(model)
    _descend_windows(optimiser, inputs, own_cut, labels, epochs, rng)
    _descend_texts(optimiser, inputs, own_cut, labels, whole_epochs, rng)
    calibrating = np.flatnonzero(kept_out).tolist() if kept_out.any() else list(range(len(y)))
    peaks = [_text_peak(model.par, inputs, texts.cut[i]) for i in calibrating]
    _calibrate(model, np.array(peaks), y[calibrating].astype(np.float64), of_all or (n_neg, n_pos))
    return model


def _text_peak(par: dict[str, np.ndarray], inputs: Inputs, ids: np.ndarray) -> float:
    """The highest window logit of one text."""
    names, local = _local(ids)
    return float(_window_logits(par, inputs.vectors(names), local).max())


def _begin(cut: list[np.ndarray], labels: np.ndarray, words: list[str], rng: np.random.Generator) -> Model:
    """A model whose tables hold log odds, with a random network."""
    n_pos = int(labels.sum())
    n_neg = len(labels) - n_pos
    bare: dict[str, int] = {}
    to_bare = np.array([-1, *(bare.setdefault(w.strip(EDGE), len(bare)) for w in words)], dtype=np.int64)
    df = np.zeros((2, len(bare)), dtype=np.int64)
    for ids, label in zip(cut, labels.astype(np.int64).tolist(), strict=True):
        own = np.unique(to_bare[np.unique(ids)])
        df[label, own[own >= 0]] += 1
    n, p = df + 0.5
    names = [w for w, many in zip(bare, p + n >= 4, strict=True) if many and w]
    at = np.array([bare[w] for w in names], dtype=np.int64)
    p, n = p[at], n[at]
    ratio, error = np.log(p / (n_pos + 1)) - np.log(n / (n_neg + 1)), np.sqrt(1 / p + 1 / n)
    # What remains of the log odds ratio at 1.5 standard errors: common words that differ a little stay small.
    odds = np.clip(np.sign(ratio) * np.maximum(0, np.abs(ratio) - 1.5 * error) / 3, -2, 2)
    strong = np.flatnonzero(np.abs(ratio / error) >= SIGNIFICANT)
    order = sorted(strong.tolist(), key=lambda i: names[i])
    vocab = {names[i]: k for k, i in enumerate(order)}
    word = rng.normal(0, 0.1, (max(1, len(order)), 1 + CODE)).astype(np.float32)
    word[: len(order), 0] = odds[order]
    trigram = rng.normal(0, 0.3, (TRIGRAMS, 1 + CODE)).astype(np.float32)
    buckets, starts = _trigram_buckets(names) if names else (np.empty(0, np.int64), np.empty(0, np.int64))
    told = np.zeros(len(names))
    told[order] = odds[order]
    value = np.repeat(told, np.diff(np.append(starts, len(buckets))))
    trigram[:, 0] = np.bincount(buckets, value, TRIGRAMS) / (np.bincount(buckets, minlength=TRIGRAMS) + 2)
    size = word.shape[1] + trigram.shape[1]
    par = {"att": np.zeros(2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
    for d in (0, 1):
        par |= {f"w{d}": rng.normal(0, 0.3, (size, 3 * HIDDEN)), f"u{d}": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"b{d}": np.zeros(3 * HIDDEN)}
    return Model(vocab, word, trigram, {k: v.astype(np.float32) for k, v in par.items()})


class Adam:
    """Adam over the network and, for the rows that a step touches, over the tables of words and trigrams."""

    def __init__(self, model: Model, rate: float = 0.01) -> None:
        self.model, self.rate, self.step = model, rate, 0
        self.whole = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.par.items()}
        self.rows = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("word", model.word), ("trigram", model.trigram))}

    def move(self, grad: dict[str, np.ndarray], inputs: Inputs, numbers: np.ndarray) -> None:
        """One step along the gradients of windows that hold the numbered words."""
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        par = self.model.par
        for k, (m, s) in self.whole.items():
            m += 0.1 * (grad[k] - m)
            s += 0.001 * (grad[k] ** 2 - s)
            par[k] = (par[k] - rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        for (name, table), (row, g) in zip((("word", self.model.word), ("trigram", self.model.trigram)), inputs.gradients(numbers, grad["x"]), strict=True):
            m, s = self.rows[name]
            m[row] += 0.1 * (g - m[row])
            s[row] += 0.001 * (g**2 - s[row])
            table[row] -= (0.1 * rate * m[row] / (np.sqrt(s[row]) + 1e-8)).astype(np.float32)


def _balance(y: np.ndarray) -> np.ndarray:
    """Weights by which both labels count the same."""
    return np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)


def _local(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of windows, padding first, and the windows in places of these."""
    names, local = np.unique(np.append(0, ids.ravel()), return_inverse=True)
    return names, local[1:].reshape(ids.shape).astype(np.int32)


def _descend_windows(optimiser: Adam, inputs: Inputs, cut: list[np.ndarray], labels: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Train on windows: of a positive text the one with the most telling words, of a negative one that and a random one."""
    word = inputs.model.word[:, 0]
    telling = np.where(inputs.row >= 0, word[inputs.row], 0)
    windows, y = [], []
    for ids, label in zip(cut, labels.tolist(), strict=True):
        most = int(np.argmax(telling[ids].max(axis=1)))
        for i in {most} if label else {most, int(rng.integers(len(ids)))}:
            windows.append(ids[i])
            y.append(label)
    # Without any word there is nothing toxic: padding alone is an example, too.
    empty = 1 + len(windows) // 50
    w_all, y_all = np.array(windows + [np.zeros(WINDOW, dtype=np.int32)] * empty), np.array(y + [0.0] * empty, dtype=np.float32)
    weights = _balance(y_all)
    size = min(128, max(16, len(y_all) // 8))
    for _ in range(max(epochs, min(30, -(-200 * size // len(y_all))))):
        order, losses = rng.permutation(len(y_all)), []
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            names, local = _local(w_all[pick])
            loss, grad = backward(optimiser.model.par, inputs.vectors(names), local, y_all[pick], weights[pick])
            losses.append(loss)
            optimiser.move(grad, inputs, names)
        optimiser.model.losses.append(float(np.mean(losses)))


def _descend_texts(optimiser: Adam, inputs: Inputs, cut: list[np.ndarray], labels: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Train on texts: the loss is that of the soft maximum over all of a text's windows."""
    weights, size = _balance(labels), min(64, max(8, len(labels) // 8))
    windows = np.array([len(c) for c in cut])
    for _ in range(epochs):
        order, losses = rng.permutation(len(labels)), []
        # Batches of so many texts, or of fewer with TOGETHER windows: what is kept for the way back stays small.
        full = np.cumsum(windows[order]) // TOGETHER * len(order) + np.arange(len(order)) // size
        for pick in np.split(order, np.flatnonzero(np.diff(full)) + 1):
            ids, counts = np.concatenate([cut[i] for i in pick.tolist()]), np.array([len(cut[i]) for i in pick.tolist()])
            par, y, w = optimiser.model.par, labels[pick], weights[pick]
            names, local = _local(ids)
            x = inputs.vectors(names)
            text, share = soft_maximum(_window_logits(par, x, local), counts)
            losses.append(float(np.mean(w * (np.logaddexp(0, text) - y * text))))
            slope = np.repeat(w * (1 / (1 + np.exp(-np.clip(text, -30, 30))) - y) / len(pick), counts) * share
            some = np.flatnonzero(share > SOFT)
            _, grad = gradients(par, x, local[some], lambda _, slope=slope[some]: slope)
            optimiser.move(grad, inputs, names)
        optimiser.model.losses.append(float(np.mean(losses)))


def _window_logits(par: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The logits of windows, BATCH at a time."""
    gates = [x @ par[f"w{d}"] + par[f"b{d}"] for d in (0, 1)]
    return np.concatenate([_logits(par, gates, ids[at : at + BATCH]) for at in range(0, len(ids), BATCH)])


def _calibrate(model: Model, peaks: np.ndarray, y: np.ndarray, of_all: tuple[int, int]) -> None:
    """Logistic regression of the label on a text's highest logit, by damped Newton steps.

    Labels weigh as the square roots of their numbers among all labelled rows, whatever their shares in the sample: between
    counting as often as they come, which hardly ever calls a rare label, and counting the same.
    """
    share = np.sqrt(np.array(of_all, dtype=np.float64))
    each = np.where(y > 0, share[1] / max(y.sum(), 1), share[0] / max((1 - y).sum(), 1))
    each /= each.mean()
    a, b = 1.0, 0.0
    mid, spread = peaks.mean(), peaks.std() + 1e-6
    v = (peaks - mid) / spread
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -30, 30)))
        w = each * p * (1 - p)
        g = np.array([(each * (p - y) * v).sum() + 1e-2 * a, (each * (p - y)).sum()])
        hess = np.array([[(w * v * v).sum() + 1e-2, (w * v).sum()], [(w * v).sum(), w.sum() + 1e-6]])
        delta = np.linalg.solve(hess, g)
        delta *= min(1.0, 2.0 / (np.abs(delta).max() + 1e-12))
        a, b = a - delta[0], b - delta[1]
    model.slope, model.shift = max(a, 1e-3) / spread, b - max(a, 1e-3) * mid / spread


def score_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of windows of each text."""
    if model.constant is not None:
        counts = np.array([len(windows_of(len(words_of(t)))) for t in texts], dtype=np.int64)
        return np.full(len(texts), model.constant), counts
    number: dict[str, int] = {}
    put = number.setdefault
    cut = [_windowed(np.array([put(w, len(number) + 1) for w in words_of(t)], dtype=np.int32)) for t in texts]
    peaks = _peaks(model.par, model.inputs(list(number)), cut)
    counts = np.array([len(c) for c in cut], dtype=np.int64)
    return 1 / (1 + np.exp(-np.clip(model.slope * peaks + model.shift, -30, 30))), counts


def _peaks(par: dict[str, np.ndarray], x: np.ndarray, cut: list[np.ndarray]) -> np.ndarray:
    """The highest window logit of each text."""
    counts, logits = np.array([len(c) for c in cut]), _window_logits(par, x, np.concatenate(cut))
    return np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(np.float64)


def _logits(par: dict[str, np.ndarray], gates: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Window logits without keeping what only training needs."""
    states = [_read(gates[d], ids, par[f"u{d}"], d == 1) for d in (0, 1)]
    score = states[0] @ par["att"][:HIDDEN] + states[1] @ par["att"][HIDDEN:]
    score[(ids == 0).T & (ids != 0).any(axis=1)] = -1e9
    score -= score.max(axis=0)
    weight = np.exp(score)
    value = states[0] @ par["out"][:HIDDEN] + states[1] @ par["out"][HIDDEN:]
    return (weight * value).sum(axis=0) / weight.sum(axis=0) + par["bias"][0]


# -- frames ------------------------------------------------------------------


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows that are not held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))
    order = F.xxhash64("_id")
    # At most MOST_TRAINING ids of either label: a proven bound for the broadcast and for what comes to the driver.
    sample = known.where("_y = 1").orderBy(order, "_id").limit(MOST_TRAINING).union(known.where("_y = 0").orderBy(order, "_id").limit(MOST_TRAINING))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    one = texts.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = [training_text(t.as_py()) for t in batch.column(2)]
            sizes = pa.array([t.count(" ") + 1 for t in taken], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(taken, pa.string()), sizes], names=["_id", "_y", "_taken", "_n"])

    kind = dict(one.dtypes)["_id"]
    whole = one.select("_id", "_y", "_text").mapInArrow(cut, f"_id {kind}, _y int, _taken string, _n long")
    before = F.sum("_n").over(Window.partitionBy("_y").orderBy(order, "_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = whole.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < MOST_WORDS).select("_id", "_y", "_taken").toArrow().sort_by("_id")
    of_all = dict(known.groupBy("_y").count().collect())
    pairs = ((rows.column("_taken")[i].as_py(), rows.column("_y")[i].as_py()) for i in range(len(rows)))
    return fit(pairs, (of_all.get(0, 0), of_all.get(1, 0)))


def _scored(slim: DataFrame, model: Model) -> DataFrame:
    """``slim`` (text, and any one column) without the text, with ``_score`` and ``_windows``."""
    other = slim.schema[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(batch):
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), GROUP_CHARS)))
                part = batch.slice(start, stop - start)
                scores, counts = score_texts(model, [t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(scores), pa.array(counts)], names=[other.name, "_score", "_windows"])
                start = stop

    return slim.mapInArrow(run, StructType([other, StructField("_score", DoubleType()), StructField("_windows", LongType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, ``_score`` and ``_windows``."""
    return _scored(docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id")), model)


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below the threshold; columns as they were, whatever their names."""
    # All of a document's columns travel in a struct, so none of their names can clash with ours.
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return _scored(rows, model).where(F.col("_score") < threshold).select("doc.*")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_windows").alias("n_windows"),
    )
