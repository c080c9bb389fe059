"""Toxicity of whole texts: a bidirectional gated recurrent network with attention
pooling over words and their characters, trained and applied in numpy.

A word enters as the sum of its own hashed vector and the mean of the vectors
of its three-byte pieces.  The text is cut into windows of ``WINDOW`` words
that overlap by ``WINDOW - STRIDE``; all of them are scored, and the text has
the highest score.  The fit sees at most ``FIT_DOCUMENTS`` labelled rows of at
most ``FIT_CHARS`` characters, taken in the order of a hash of their id; that
bound keeps the driver's share the same at every size of the corpus.

Null and empty texts hold no word: they get the score of one empty window.
Without any labelled row of both kinds every score is 0.  Rows come out as they
went in, repeated ones included; a column called ``score`` or ``predicted`` is
replaced.  A null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 48, 36
SIZE, HIDDEN = 16, 8
WORD_ROWS, PIECE_ROWS = 1 << 14, 1 << 13
FIT_DOCUMENTS, FIT_CHARS = 6_000, 12_000
THRESHOLD = 0.3
WINDOWS_PER_STEP, TEXTS_PER_LOOKUP = 2048, 64
CACHED_WORDS = 300_000

# Bytes of ASCII that end a word: everything but letters and digits.
_BREAKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split() if text else []


def windows_of(rows: np.ndarray) -> np.ndarray:
    """All windows of a text's words, the last one filled up with 0; one window
    of nothing for an empty text."""
    starts = range(0, max(1, len(rows) - (WINDOW - STRIDE)), STRIDE)
    padded = np.zeros(starts[-1] + WINDOW, rows.dtype)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def piece_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash rows of words, and of their three-byte pieces with where each word's begin."""
    data = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03", dtype=np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    with np.errstate(over="ignore"):
        power = np.uint32(0x01000193) ** np.arange(int(lengths.max()), dtype=np.uint32)
        weighed = data * power[np.arange(len(data)) - np.repeat(starts, lengths)]
        mixed = np.add.reduceat(weighed, starts, dtype=np.uint32) * np.uint32(0x9E3779B1)
        pieces = (data[:-2] * np.uint32(0x85EBCA6B) + data[1:-1]) * np.uint32(0xC2B2AE35) + data[2:]
        pieces = (pieces * np.uint32(0x27D4EB2F)) >> np.uint32(19)
    keep = np.ones(len(pieces), dtype=bool)
    ends = starts[1:]
    keep[ends - 1] = keep[ends - 2] = False  # pieces that reach into the next word
    return (mixed >> np.uint32(18)).astype(np.int64), pieces[keep].astype(np.int64), lengths - 2


@dataclass
class Network:
    """The weights; ``f`` reads forwards, ``b`` backwards."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    fitted: bool = False

    @classmethod
    def fresh(cls, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        weights = {"word": draw(WORD_ROWS, SIZE, scale=0.05), "piece": draw(PIECE_ROWS, SIZE, scale=0.1)}
        for way in "fb":
            weights[f"W{way}"] = draw(SIZE, 3 * HIDDEN, scale=SIZE**-0.5)
            weights[f"U{way}"] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            weights[f"c{way}"] = np.zeros(3 * HIDDEN, np.float32)
        weights["pool"] = draw(2 * HIDDEN, scale=0.3)
        weights["out"] = draw(2 * HIDDEN, scale=0.3)
        weights["bias"] = np.full(1, -1.0, np.float32)
        return cls(weights)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        rows, pieces, lengths = piece_table(words)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        mean = np.add.reduceat(self.weights["piece"][pieces], starts) / lengths[:, None]
        return self.weights["word"][rows] + mean.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_gru(x: np.ndarray, on: np.ndarray, u: np.ndarray, order: range, keep: list | None = None):
    """States for gate inputs ``x`` (windows, steps, 3 * HIDDEN); where ``on`` is 0
    the state stays.  ``keep`` collects what the way back needs."""
    h = np.zeros((x.shape[0], HIDDEN), np.float32)
    out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
    for t in order:
        a, b = x[:, t], h @ u
        gates = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
        move = (1 - z) * on[:, t, None]
        if keep is not None:
            keep.append((t, h, r, z, n, b[:, 2 * HIDDEN :]))
        h = h + move * (n - h)
        out[:, t] = h
    return out


def pool(states: np.ndarray, on: np.ndarray, w: dict[str, np.ndarray]):
    """Attention weights, the pooled state and the logit of each window."""
    e = states @ w["pool"]
    e = np.where(on > 0, e, -1e9)
    share = np.exp(e - e.max(axis=1, keepdims=True)) * (on > 0)
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-9)
    pooled = np.matmul(share[:, None, :], states)[:, 0]
    return share, pooled, pooled @ w["out"] + w["bias"][0]


class Scorer:
    """Scores texts; gate inputs of words met before come from a bounded table."""

    def __init__(self, network: Network):
        self.w = network.weights
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Rows of the table for words; row 0 stands for no word."""
        missing = [x for x in dict.fromkeys(words) if x not in self.rows]
        if missing:
            at = len(self.rows) + 1
            x = self.network.inputs(missing)
            gates = np.hstack([x @ self.w[f"W{way}"] + self.w[f"c{way}"] for way in "fb"])
            while at + len(missing) > len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(missing)] = gates
            self.rows.update(zip(missing, range(at, at + len(missing))))
        return np.fromiter(map(self.rows.__getitem__, words), dtype=np.int32, count=len(words))

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Logits of windows given as rows of the table, 0 where no word is."""
        out = np.empty(len(rows), np.float32)
        for at in range(0, len(rows), WINDOWS_PER_STEP):
            part = rows[at : at + WINDOWS_PER_STEP]
            steps = max(1, int((part > 0).sum(axis=1).max()))
            part = part[:, :steps]
            x, on = self.table[part], (part > 0).astype(np.float32)
            states = np.concatenate(
                [
                    run_gru(x[..., : 3 * HIDDEN], on, self.w["Uf"], range(steps)),
                    run_gru(x[..., 3 * HIDDEN :], on, self.w["Ub"], range(steps - 1, -1, -1)),
                ],
                axis=2,
            )
            out[at : at + WINDOWS_PER_STEP] = pool(states, on, self.w)[2]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The highest window score of each text, between 0 and 1."""
        if not self.network.fitted:
            return np.zeros(len(texts))
        best = np.full(len(texts), -np.inf)
        of: list[int] = []
        waiting: list[np.ndarray] = []

        def flush() -> None:
            if waiting:
                np.maximum.at(best, np.array(of), self.windows(np.vstack(waiting)))
                of.clear()
                waiting.clear()

        for first in range(0, len(texts), TEXTS_PER_LOOKUP):
            split = [words_of(text) for text in texts[first : first + TEXTS_PER_LOOKUP]]
            if len(self.rows) > CACHED_WORDS:
                flush()
                self.forget()
            found = self.lookup([x for words in split for x in words])
            ends = np.cumsum([len(words) for words in split])
            for i, rows in enumerate(np.split(found, ends[:-1]), first):
                cut = windows_of(rows)
                for at in range(0, len(cut), WINDOWS_PER_STEP):
                    waiting.append(cut[at : at + WINDOWS_PER_STEP])
                    of.extend([i] * len(waiting[-1]))
                    if len(of) >= WINDOWS_PER_STEP:
                        flush()
        flush()
        return 1 / (1 + np.exp(-best))


def _back_gru(grad: np.ndarray, keep: list, on: np.ndarray, u: np.ndarray, gx: np.ndarray, gu: np.ndarray) -> None:
    """Gradient through one direction, last step first."""
    gh = np.zeros((grad.shape[0], HIDDEN), np.float32)
    for t, h, r, z, n, bn in reversed(keep):
        g = gh + grad[:, t]
        m = on[:, t, None]
        gn = g * m * (1 - z) * (1 - n * n)
        gz = g * m * (h - n) * z * (1 - z)
        gr = gn * bn * r * (1 - r)
        gx[:, t] = np.hstack([gr, gz, gn])
        gb = np.hstack([gr, gz, gn * r])
        gu += h.T @ gb
        gh = g * (1 - m * (1 - z)) + gb @ u.T


class Trainer:
    """Adam over windows; each text counts by its highest window once the first
    passes have shown which words matter."""

    def __init__(self, network: Network, rate: float = 0.01):
        self.net, self.w, self.rate = network, network.weights, rate
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.steps = 0

    def step(self, rows, words, labels: np.ndarray) -> None:
        """``rows``: windows of numbers into ``words``, 0 where no word is."""
        w = self.w
        on = (rows > 0).astype(np.float32)
        hashes, pieces, lengths = words
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        mean = np.add.reduceat(w["piece"][pieces], starts) / lengths[:, None]
        x = np.vstack([np.zeros((1, SIZE), np.float32), w["word"][hashes] + mean.astype(np.float32)])
        steps, kept, states = rows.shape[1], {"f": [], "b": []}, []
        for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gates = x @ w[f"W{way}"] + w[f"c{way}"]
            states.append(run_gru(gates[rows], on, w[f"U{way}"], order, kept[way]))
        states = np.concatenate(states, axis=2)
        share, pooled, logit = pool(states, on, w)
        g = ((_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        grads = {"out": pooled.T @ g, "bias": np.array([g.sum()], np.float32)}
        gpooled = g[:, None] * w["out"]
        gshare = np.einsum("bth,bh->bt", states, gpooled)
        ge = share * (gshare - (share * gshare).sum(axis=1, keepdims=True))
        gstates = share[..., None] * gpooled[:, None] + ge[..., None] * w["pool"]
        grads["pool"] = np.einsum("bth,bt->h", states, ge)
        gxs = np.zeros_like(x)
        for i, way in enumerate("fb"):
            gx = np.zeros((*rows.shape, 3 * HIDDEN), np.float32)
            gu = np.zeros_like(w[f"U{way}"])
            part = gstates[..., i * HIDDEN : (i + 1) * HIDDEN]
            _back_gru(part, kept[way], on, w[f"U{way}"], gx, gu)
            flat = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(flat, rows.ravel(), gx.reshape(-1, 3 * HIDDEN))
            flat[0] = 0
            grads |= {f"U{way}": gu, f"W{way}": x.T @ flat, f"c{way}": flat.sum(axis=0)}
            gxs += flat @ w[f"W{way}"].T
        gword, gpiece = np.zeros_like(w["word"]), np.zeros_like(w["piece"])
        np.add.at(gword, hashes, gxs[1:])
        np.add.at(gpiece, pieces, np.repeat(gxs[1:] / lengths[:, None], lengths, axis=0))
        grads |= {"word": gword, "piece": gpiece}
        self.steps += 1
        for k, grad in grads.items():
            self.m[k] += 0.1 * (grad - self.m[k])
            self.v[k] += 0.001 * (grad * grad - self.v[k])
            move = self.m[k] / (1 - 0.9**self.steps) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-7)
            w[k] -= (self.rate * move).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7, least_steps: int = 500) -> Network:
    """Fit on labelled texts.  Labels of one kind only leave the network unfitted."""
    net = Network.fresh(seed)
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return net
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    windows = [
        windows_of(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in words_of(text)], np.int32))
        for text in texts
    ]
    words = np.array([b"", *vocabulary], dtype=object)
    if len(words) == 1:
        return net
    ends = np.cumsum([len(x) for x in windows])
    trainer, batch = Trainer(net), 64
    epochs = int(max(6, np.ceil(least_steps * batch / len(y))))
    warm, again = max(1, epochs // 4), max(1, epochs // 3)
    best = np.zeros(len(y), np.int64)
    for epoch in range(epochs):
        if epoch >= warm and (epoch - warm) % again == 0:
            scorer = Scorer(net)
            scorer.lookup(list(vocabulary))  # in order, so rows equal numbers
            logits = scorer.windows(np.vstack(windows))
            best = np.array([np.argmax(part) for part in np.split(logits, ends[:-1])])
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            picked = np.vstack(
                [windows[i][rng.integers(len(windows[i])) if epoch < warm else best[i]] for i in chosen]
            )
            own, rows = np.unique(picked, return_inverse=True)
            rows = rows.reshape(picked.shape) + (own[0] != 0)  # number 0 stays no word
            if own[-1] > 0:
                trainer.step(rows, piece_table(list(words[own[own > 0]])), y[chosen])
    net.fitted = True
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: checksum of the id as text, remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS, chars: int = FIT_CHARS) -> Network:
    """Train on the bounded sample of labelled rows.  Several labels of one id
    count as their highest; several texts of one id as the first in order."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = (
        docs.where(F.length("text") <= chars)
        .select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")  # at most `most` rows of two numbers
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .orderBy("doc_id")
        .collect()
    )
    return train([r.text for r in rows], [int(r.toxic > 0) for r in rows])


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """Add ``score`` and ``predicted``; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array(scorer.score(texts.to_pylist()), pa.float64())

    return docs.withColumn("score", toxicity("text")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
