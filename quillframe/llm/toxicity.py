"""Operator 3: toxicity.

Method.  A bidirectional gated recurrent network with attention pooling, in numpy.  Each word enters as a word vector
beside the sum of its character 3- to 6-gram vectors over the root of their number; words and n-grams that few training documents hold have none, so
that rare words can't be learned by heart.  A text is scored in windows of ``WINDOW`` words, each of which overlaps half
of the next; its score comes from its most toxic windows (``TOP``), calibrated on documents kept from the training.

Training is on a bounded sample of labelled documents (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN``), on all windows of each, as in
scoring: the worst of a few windows would calibrate the worst of many wrongly.  Labels hold for documents,
so training goes in two phases: first each window has its document's label; then only the windows of toxic documents
that the first phase finds suspicious are positive, and all windows of clean ones negative.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import fold, small_batches, struct, table, ticket

WINDOW, STRIDE = 32, 16
WORD_BUCKETS, CHAR_BUCKETS = 2**16, 2**17
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 16, 10, 8
#: Lengths of the character n-grams, and training documents that a word or n-gram must stand in.
GRAMS, MIN_DOCS = (3, 4, 5, 6), 6
#: A document's figures are the means of so many of its worst windows.
TOP = (1, 2, 4)
#: Labelled documents that the network is fitted on at most (they are chosen by a hash of their id).
SAMPLE_TOXIC, SAMPLE_CLEAN = 600, 1200
#: Passes over the windows in the two phases, windows in a step at most (fewer if a pass would have under 100 steps),
#: and learning rate.
EPOCHS, BATCH, RATE = (3, 3), 256, 0.05
#: A toxic document's window is positive in the second phase if it looks worse than this share of clean windows.
QUANTILE = 0.995
CUT = 0.7
#: Words whose inputs a task remembers; the memory is emptied when it is full.
CACHE_WORDS = 200_000
#: Words whose inputs are made at once, and windows that go through the network at once (what they take fits a cache).
CHUNK_WORDS, AT_ONCE = 5000, 512
#: Words of a text that are scored at once, a multiple of ``STRIDE``.
PIECE_WORDS = 100_000

_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def word_list(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits, and of all that is beyond ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).decode("utf-8").split()


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket by word, start of each word, buckets by place, weights by place), n-grams of a length in a row.

    Words are marked at both ends; an n-gram that would leave its word has weight 0, others have 1.
    """
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(len(points))
    n, most = len(points), max(GRAMS)
    p = np.concatenate([points, np.zeros(most, np.uint32)])
    h, buckets = np.full(n, 17, np.uint32), []
    for k in range(most):
        h = (h ^ p[k : k + n]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        if k + 1 in GRAMS:
            buckets.append((h * np.uint32(2246822519) >> np.uint32(15)).astype(np.int64))
    weights = np.stack([left >= k for k in GRAMS])
    place = np.arange(n, dtype=np.uint32) - np.repeat(starts, sizes).astype(np.uint32)
    mixed = (points ^ (place * np.uint32(668265263))) * np.uint32(2654435761)
    mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(2246822519)
    total = np.add.reduceat(mixed, starts, dtype=np.uint32)
    word = ((total ^ (total >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)
    return word, starts, np.stack(buckets), weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _scattered(at: np.ndarray, values: np.ndarray, source: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of those rows ``values[source]`` that go to each; ``add.at`` took several times as long."""
    out, columns = np.empty((n, values.shape[1]), values.dtype), np.take(values, source, axis=0).astype(np.float64).T.copy()
    for k, column in enumerate(columns):
        out[:, k] = np.bincount(at, column, n)
    return out


@dataclass
class Words:
    """Rows of the vectors of words and of their known n-grams; the latter lie one word after another."""

    row: np.ndarray
    sizes: np.ndarray
    grams: np.ndarray

    def __post_init__(self) -> None:
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, at: np.ndarray) -> Words:
        sizes = self.sizes[at]
        shift = self.starts[at] - (np.cumsum(sizes) - sizes)
        return Words(self.row[at], sizes, self.grams[np.repeat(shift, sizes) + np.arange(sizes.sum())])


@dataclass
class Network:
    """Inside the network arrays have windows last, so that each operation runs over long stretches."""

    p: dict[str, np.ndarray]
    word_row: np.ndarray  # the row of each bucket's vector; row 0 is nothing and stays 0
    char_row: np.ndarray
    calibration: np.ndarray | None = None  # a weight for each of TOP and one for the constant

    @classmethod
    def fresh(cls, word_row: np.ndarray, char_row: np.ndarray, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        f = lambda *shape, s: r.normal(0, s, shape).astype(np.float32)
        p = {"word": f(int(word_row.max()) + 1, WORD_DIM, s=0.1), "char": f(int(char_row.max()) + 1, CHAR_DIM, s=0.3)}
        p["word"][0] = p["char"][0] = 0
        for way in "fb":
            p[f"x{way}"], p[f"u{way}"], p[f"c{way}"] = f(d, 3 * HIDDEN, s=d**-0.5), f(HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5), np.zeros(3 * HIDDEN, np.float32)
        p |= {"att": f(2 * HIDDEN, ATTENTION, s=0.3), "query": f(ATTENTION, s=0.3), "out": f(2 * HIDDEN, s=0.3), "bias": np.zeros(1, np.float32)}
        return cls(p, word_row, char_row)

    def words(self, words: list[str]) -> Words:
        word, starts, buckets, weights = hashed(words)
        rows = np.where(weights, self.char_row[buckets], 0).T
        known = rows > 0
        return Words(self.word_row[word], np.add.reduceat(known.sum(axis=1), starts), rows[known])

    def inputs(self, words: list[str] | Words) -> tuple[np.ndarray, tuple]:
        """One row of inputs for each word; and the words and the weight of each one's n-grams."""
        words = words if isinstance(words, Words) else self.words(words)
        some, share = words.sizes > 0, (1 / np.sqrt(np.maximum(1, words.sizes))).astype(np.float32)[:, None]
        char = np.zeros((len(some), CHAR_DIM), self.p["char"].dtype)
        if some.any():
            char[some] = np.add.reduceat(np.take(self.p["char"], words.grams, axis=0), words.starts[some])
        return np.concatenate([self.p["word"][words.row], char * share], axis=1), (words, share)

    def _both(self, kind: str) -> np.ndarray:
        return np.stack([self.p[f"{kind}{way}"] for way in "fb"])

    def _steps(self, gates: np.ndarray, windows: np.ndarray, keep: dict | None) -> np.ndarray:
        """Hidden states by time, way, unit and window, in the order in which each way goes.

        gates: one word a row, by way and gate; windows: word numbers, one window a row.
        """
        n, u = len(windows), self._both("u").swapaxes(1, 2)
        each = np.take(gates, windows.T, axis=0)
        h, zero = np.empty((WINDOW, 2, HIDDEN, n), gates.dtype), np.zeros((2, HIDDEN, n), gates.dtype)
        g = np.empty((2, 3 * HIDDEN, n), gates.dtype)
        for t in range(WINDOW):
            g[0], g[1] = each[t, :, : 3 * HIDDEN].T, each[WINDOW - 1 - t, :, 3 * HIDDEN :].T
            before = h[t - 1] if t else zero
            hu = u @ before
            zr = _gate(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
            new = np.tanh(g[:, 2 * HIDDEN :] + r * hn)
            if keep is not None:
                for k, v in zip("zrna", (z, r, new, hn), strict=True):
                    keep.setdefault(k, np.empty_like(h))[t] = v
            h[t] = new + z * (before - new)
        return h

    def forward(self, gates: np.ndarray, windows: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; real says which places hold a word."""
        steps = {} if keep is not None else None
        own = self._steps(gates, windows, steps)
        h = np.concatenate([own[:, 0], own[::-1, 1]], axis=1)
        a = np.tanh(self.p["att"].T @ h)
        e = np.where(real.T, self.p["query"] @ a, -1e9)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tb,thb->hb", e, h)
        if keep is not None:
            keep |= {"steps": steps, "own": own, "h": h, "a": a, "e": e, "pooled": pooled}
        return self.p["out"] @ pooled + self.p["bias"][0]

    def logits(self, gates: np.ndarray, windows: np.ndarray, real: np.ndarray) -> np.ndarray:
        """``forward``, some windows at a time."""
        return np.concatenate([self.forward(gates, windows[i : i + AT_ONCE], real[i : i + AT_ONCE]) for i in range(0, len(windows), AT_ONCE)])

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p[f"x{way}"] + self.p[f"c{way}"] for way in "fb"], axis=1)

    def gradient(self, words: list[str] | Words, windows: np.ndarray, real: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean loss of windows and its gradient by parameter; windows number into words."""
        p, keep = self.p, {}
        x, (words, share) = self.inputs(words)
        logit = self.forward(self.gates(x), windows, real, keep)
        q = _sigmoid(logit)
        loss = float(-(weight * np.where(target > 0, np.log(q + 1e-9), np.log(1 - q + 1e-9))).mean())
        d = (weight * (q - target) / len(target)).astype(x.dtype)
        h, a, e, own = keep["h"], keep["a"], keep["e"], keep["own"]
        g: dict[str, np.ndarray] = {"out": keep["pooled"] @ d, "bias": np.array([d.sum()])}
        d_pooled = p["out"][:, None] * d
        d_e = np.einsum("hb,thb->tb", d_pooled, h)
        d_score = e * (d_e - (e * d_e).sum(axis=0))
        d_a = d_score[:, None] * p["query"][:, None] * (1 - a * a)
        g["query"] = np.einsum("tb,tab->a", d_score, a)
        g["att"] = (h @ d_a.swapaxes(1, 2)).sum(axis=0)
        d_h = e[:, None] * d_pooled + p["att"] @ d_a
        d_own = np.stack([d_h[:, :HIDDEN], d_h[::-1, HIDDEN:]], axis=1)
        z, r, new, hn = (keep["steps"][k] for k in "zrna")
        before = np.concatenate([np.zeros_like(own[:1]), own[:-1]])
        to_z, to_n, to_r = (before - new) * z * (1 - z), (1 - z) * (1 - new * new), hn * r * (1 - r)
        u, back = self._both("u"), np.zeros_like(own[0])
        d_gates, d_hu = (np.empty((WINDOW, 2, 3 * HIDDEN, len(windows)), x.dtype) for _ in "gh")
        for t in range(WINDOW - 1, -1, -1):
            dh = back + d_own[t]
            dn = dh * to_n[t]
            d_hu[t, :, :HIDDEN], d_hu[t, :, HIDDEN : 2 * HIDDEN], d_hu[t, :, 2 * HIDDEN :] = dh * to_z[t], dn * to_r[t], dn * r[t]
            d_gates[t, :, 2 * HIDDEN :] = dn
            back = dh * z[t] + u @ d_hu[t]
        d_gates[:, :, : 2 * HIDDEN] = d_hu[:, :, : 2 * HIDDEN]
        d_u = (before @ d_hu.swapaxes(2, 3)).sum(axis=0)
        by_place = np.stack([d_gates[:, 0], d_gates[::-1, 1]]).transpose(0, 2, 1, 3).reshape(6 * HIDDEN, -1)
        places = windows.T.ravel()
        by_word = np.stack([np.bincount(places, v, len(x)) for v in by_place]).astype(x.dtype)
        d_x = np.zeros_like(x)
        for i, way in enumerate("fb"):
            part = by_word[i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN]
            g[f"u{way}"], g[f"x{way}"], g[f"c{way}"] = d_u[i], (part @ x).T, part.sum(axis=1)
            d_x += (p[f"x{way}"] @ part).T
        each = np.arange(len(x))
        g["word"] = _scattered(words.row, d_x[:, :WORD_DIM], each, len(p["word"]))
        g["char"] = _scattered(words.grams, d_x[:, WORD_DIM:] * share, np.repeat(each, words.sizes), len(p["char"]))
        g["word"][0] = g["char"][0] = 0
        return loss, g


def window_starts(n: int) -> list[int]:
    """Windows that cover n words: every ``STRIDE``-th word, and one that ends with the last word."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW + 1, STRIDE))
    return starts if starts[-1] + WINDOW == n else [*starts, n - WINDOW]


def cut(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, real) of one document's word numbers; places past the end repeat the last word and aren't real."""
    at = np.array(window_starts(len(ids)))[:, None] + np.arange(WINDOW)[None, :]
    return ids[np.minimum(at, len(ids) - 1)], at < len(ids)


@dataclass
class _Adagrad:
    rate: float
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        for k, v in g.items():
            s = self.seen.setdefault(k, np.full(v.shape, 1e-6, np.float32))
            s += v * v
            p[k] -= (self.rate * v / np.sqrt(s)).astype(np.float32)


def fit(texts: list[str], labels: list[int], seed: int = 3) -> Network:
    r = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in word_list(t)], dtype=np.int64) for t in texts]
    names = list(number)
    parts = []
    for d, (ids, y) in enumerate(zip(docs, labels, strict=True)):
        if len(ids):
            windows, real = cut(ids)
            parts.append((windows, real, np.full(len(windows), d), np.full(len(windows), y)))
    windows, real, owner, target = (np.concatenate(x) for x in zip(*parts, strict=True))
    train = np.array([d % 5 > 0 for d in range(len(docs))])[owner]
    network, optimizer = Network.fresh(*_known(names, docs), seed), _Adagrad(RATE)
    words = _joined([network.words(names[i : i + CHUNK_WORDS]) for i in range(0, len(names), CHUNK_WORDS)])  # hashed once for all steps

    def epoch(at: np.ndarray, weight: np.ndarray) -> None:
        at = r.permutation(at)
        size = max(16, min(BATCH, len(at) // 100))
        for i in range(0, len(at), size):
            b = at[i : i + size]
            used, local = np.unique(windows[b], return_inverse=True)
            _, g = network.gradient(words.take(used), local.reshape(-1, WINDOW), real[b], target[b], weight[b])
            optimizer.step(network.p, g)

    def logits() -> np.ndarray:
        parts = (words.take(np.arange(i, min(i + CHUNK_WORDS, len(names)))) for i in range(0, len(names), CHUNK_WORDS))
        gates = np.concatenate([network.gates(network.inputs(part)[0]) for part in parts])
        return network.logits(gates, windows, real)

    toxic, clean = train & (target > 0), train & (target == 0)
    balance = np.where(target > 0, 0.5 / max(1, toxic.sum()), 0.5 / max(1, clean.sum())) * train.sum()
    for _ in range(EPOCHS[0]):
        epoch(np.flatnonzero(train), balance)
    # A window of a toxic document counts as toxic if hardly any window of a clean document looks so bad.
    for _ in range(EPOCHS[1]):
        scores = logits()
        bad = toxic & (scores > np.quantile(scores[clean], QUANTILE))
        chosen = np.flatnonzero(clean | bad)
        weight = np.where(target > 0, 0.5 / max(1, bad.sum()), 0.5 / max(1, clean.sum())) * len(chosen)
        epoch(chosen, weight)
    scores = logits()
    kept = [d for d in range(len(docs)) if d % 5 == 0 and len(docs[d])] or [d for d in range(len(docs)) if len(docs[d])]
    bounds = np.searchsorted(owner, [kept, [d + 1 for d in kept]])
    figures = np.array([worst(scores[a:b]) for a, b in bounds.T])
    network.calibration = _calibrate(figures, np.array(labels)[kept])
    return network


def _joined(parts: list[Words]) -> Words:
    return Words(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("row", "sizes", "grams")))


def _known(names: list[str], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the word and n-gram buckets that stand in enough training documents."""
    every = Network({}, np.arange(WORD_BUCKETS), np.arange(1, CHAR_BUCKETS + 1))
    all_words = _joined([every.words(names[i : i + CHUNK_WORDS]) for i in range(0, len(names), CHUNK_WORDS)])
    words, grams = np.zeros(WORD_BUCKETS, np.int64), np.zeros(CHAR_BUCKETS, np.int64)
    for ids in docs:
        if len(ids):
            own = all_words.take(np.unique(ids))
            for count, at in ((words, own.row), (grams, own.grams - 1)):
                held = np.zeros(len(count), bool)
                held[at] = True
                count += held
    return tuple(np.where(n >= MIN_DOCS, np.cumsum(n >= MIN_DOCS), 0) for n in (words, grams))


def worst(scores: np.ndarray) -> np.ndarray:
    """Means of the worst 1, 2 and 4 window scores (of all, if there are fewer)."""
    top = np.sort(scores)[::-1]
    return np.array([top[:k].mean() for k in TOP])


def _calibrate(figures: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the figures, by Newton steps with a little shrinkage."""
    mean, scale = figures.mean(axis=0), figures.std(axis=0) + 1e-6
    x = np.concatenate([(figures - mean) / scale, np.ones((len(y), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = _sigmoid(x @ w)
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (q - y) + 0.5 * w)
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


class Scorer:
    """Scores texts; remembers the inputs of words."""

    def __init__(self, network: Network):
        self.network = network
        self._empty()

    def _empty(self) -> None:
        self.number: dict[str, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.filled = 0

    def _fill(self) -> None:
        names = list(self.number)[self.filled :] if self.filled < len(self.number) else []
        for i in range(0, len(names), CHUNK_WORDS):
            new = self.network.gates(self.network.inputs(names[i : i + CHUNK_WORDS])[0])
            while self.filled + len(new) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            self.gates[self.filled : self.filled + len(new)] = new
            self.filled += len(new)

    def _pieces(self, words: list[str]) -> Iterator[list[str]]:
        """Very long texts in pieces that have the whole text's windows between them, each in one piece."""
        for i in range(0, len(words), PIECE_WORDS):
            end = i + PIECE_WORDS + WINDOW - STRIDE
            yield words[min(i, max(0, len(words) - WINDOW)) : end]
            if end >= len(words):
                break

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text; 0 where there is no word."""
        best: list[list[float]] = [[] for _ in texts]  # the worst windows so far
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if not held:
                return
            self._fill()
            windows, real = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            s = self.network.logits(self.gates, windows, real)
            at = 0
            for d, own, _ in held:
                part = s[at : at + len(own)]
                at += len(own)
                best[d] = sorted([*best[d], *(part if len(part) <= TOP[-1] else np.partition(part, -TOP[-1])[-TOP[-1] :])])[-TOP[-1] :]
            held.clear()

        size = 0
        for d, text in enumerate(texts):
            for words in self._pieces(word_list(text)):
                if not words:
                    continue
                if len(self.number) + len(words) > CACHE_WORDS or size >= 8192:
                    flush()
                    size = 0
                    if len(self.number) + len(words) > CACHE_WORDS:
                        self._empty()
                number = self.number
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                held.append((d, *cut(ids)))
                size += len(held[-1][1])
        flush()
        w = self.network.calibration
        known = [i for i, b in enumerate(best) if b]
        out = np.zeros(len(texts))
        if known:
            out[known] = _sigmoid(np.array([worst(np.array(best[i])) for i in known]) @ w[:-1] + w[-1])
        return out


def sampled(labelled: DataFrame) -> DataFrame:
    """Of the rows (doc_id, toxic and others) of each label, the ``SAMPLE_TOXIC`` or ``SAMPLE_CLEAN`` with the least hashes of their ids."""
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    turn = ticket("doc_id")

    def least(label: int, n: int) -> DataFrame:
        # Twice as many as wanted are expected to be sorted, however large the table is.
        few = labelled.filter((F.col("toxic") == label) & (turn < (2 * n + 40) / max(1, sizes.get(label, 0))))
        return few.orderBy(turn, *labelled.columns).limit(n)

    return least(1, SAMPLE_TOXIC).union(least(0, SAMPLE_CLEAN))


def train(labelled: DataFrame) -> Network | None:
    """A network for (doc_id, text, toxic), fitted on a bounded sample; None unless both labels are there."""
    rows = sampled(labelled).collect()
    if len({r["toxic"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_toxicity(docs: DataFrame, network: Network | None, text_column: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if the score is ``CUT`` or more), replacing such columns.

    All windows of the whole text are scored.  Null and empty texts and texts without a word score 0; so do all texts
    if there is no network.  Equal texts get equal scores up to rounding; a score of exactly ``CUT`` is toxic; no rows
    give no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf(struct("score double, predicted int"))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for text in batches:
            s = scorer.scores(text.to_pylist()) if scorer else np.zeros(len(text))
            yield pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], ["score", "predicted"])

    names = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(F.struct(*names).alias("row"), run(F.col(text_column)).alias("new"))
    return out.select(*(F.col(f"row.`{n}`").alias(n) for n in names), "new.score", "new.predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull()).filter(~held_out).select("doc_id", "toxic")
    # Which labels to learn from is settled on ids alone, so that few texts travel.
    chosen = sampled(labels.join(docs.select("doc_id"), "doc_id", "left_semi"))
    network = train(docs.join(F.broadcast(chosen), "doc_id"))
    out = score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), network)
    return out.select("doc_id", "held_out", "score", "predicted")
