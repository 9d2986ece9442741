"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled windows, and applied to
every byte of every text: texts are cut into windows of WINDOW bytes, each read in both directions from a zero state,
and every position gets a probability for each language. A document's probabilities are the means over all its positions.
Windows of many documents go through the network together, so a very long text is just more windows.

The sample has about SAMPLE_DOCS labelled documents (of rare languages more than their share), chosen by a hash of their ids, and WINDOWS_EACH windows of each, at
places spread over the text.

Defined results: a text that is null or has no letter gets `und` and score 0, as all do without labelled documents;
repeated rows get equal results; an empty table gives an empty result; only doc_id and text (and lang for training) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyband.llm.common import mapped, remainder, text_or_empty

SAMPLE_DOCS = 3_000
MOST_LANGUAGES, LEAST_EACH = 1_000, 50
WINDOWS_EACH = 2
WINDOW = 128
HIDDEN = 8
BATCH = 2048
UNKNOWN = "und"
#: Bytes of texts that go through the network together.
BLOCK_BYTES = 4_000_000


@dataclass(frozen=True)
class Direction:
    """table[byte]: the input's part of the update, reset and candidate gates; u: the state's part."""

    table: np.ndarray
    u: np.ndarray


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    ahead: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


# --- training -----------------------------------------------------------------------------------------------------------


def _read(part: Direction, data: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each of the steps in data[step, window], and what backpropagation needs."""
    h = np.zeros((data.shape[1], part.u.shape[0]))
    k = part.u.shape[0]
    states, kept = [], []
    for x in data:
        p, g = part.table[x], h @ part.u
        z, r = _sigmoid(p[:, :k] + g[:, :k]), _sigmoid(p[:, k : 2 * k] + g[:, k : 2 * k])
        n = np.tanh(p[:, 2 * k :] + r * g[:, 2 * k :])
        kept.append((h, z, r, n, g[:, 2 * k :]))
        h = n + z * (h - n)
        states.append(h)
    return np.stack(states), kept


def _unread(part: Direction, data: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of u, through all steps."""
    d_u, d_inputs = np.zeros_like(part.u), np.empty((*data.shape, part.table.shape[1]))
    d_h = np.zeros_like(kept[0][0])
    for t in range(len(data) - 1, -1, -1):
        h, z, r, n, g = kept[t]
        d = d_states[t] + d_h
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * g * r * (1 - r)
        d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_inputs[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_u += h.T @ d_g
        d_h = d * z + d_g @ part.u.T
    d_table = np.zeros_like(part.table)
    np.add.at(d_table, data.reshape(-1), d_inputs.reshape(-1, d_inputs.shape[2]))
    return d_table, d_u


def gradients(net: Network, data: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean log loss over all positions of data[step, window], and its gradients by table, u (ahead, back), out, bias."""
    ahead, kept_ahead = _read(net.ahead, data)
    back, kept_back = _read(net.back, data[::-1])
    both = np.concatenate([ahead, back[::-1]], axis=2)
    logits = both @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    each = np.arange(data.shape[1])
    loss = -np.log(np.maximum(p[:, each, labels], 1e-12)).mean()
    d_logits = p
    d_logits[:, each, labels] -= 1
    d_logits /= data.size
    d_both = d_logits @ net.out.T
    k = ahead.shape[2]
    d_ahead = _unread(net.ahead, data, kept_ahead, d_both[:, :, :k])
    d_back = _unread(net.back, data[::-1], kept_back, d_both[::-1, :, k:])
    flat = both.reshape(-1, 2 * k)
    return float(loss), [*d_ahead, *d_back, flat.T @ d_logits.reshape(len(flat), -1), d_logits.sum(axis=(0, 1))]


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], steps: int = 250, rate: float = 0.02, hidden: int = HIDDEN, seed: int = 3) -> Network:
    """Adam on batches of windows[window, step]; classes weigh as they come."""
    rng = np.random.default_rng(seed)
    k, c = hidden, len(languages)
    shapes = [(256, 3 * k), (k, 3 * k), (256, 3 * k), (k, 3 * k), (2 * k, c), (c,)]
    parts = [rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]

    def net() -> Network:
        return Network(languages, Direction(parts[0], parts[1]), Direction(parts[2], parts[3]), parts[4], parts[5])

    for step in range(1, steps + 1):
        rows = rng.integers(0, len(windows), min(128, len(windows)))
        # a part of the window is enough for a step; all parts come up
        start = int(rng.integers(0, windows.shape[1] - 63)) if windows.shape[1] > 64 else 0
        _, grads = gradients(net(), np.ascontiguousarray(windows[rows, start : start + 64].T), labels[rows])
        length = np.sqrt(sum((g * g).sum() for g in grads))
        now = rate * (1 - 0.9 * step / steps)
        for j, g in enumerate(grads):
            g *= min(1.0, 1.0 / max(length, 1e-12))
            first[j] += 0.1 * (g - first[j])
            second[j] += 0.01 * (g * g - second[j])
            parts[j] -= now * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
    return net()


def training_windows(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(lang, window) of about `most` labelled documents outside the held-out part: a bounded number of short rows.

    Of each of the MOST_LANGUAGES most frequent languages about LEAST_EACH documents at least, if it has as many.
    """
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(4) != 2))
    each = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in each.collect()}
    share = most / max(sum(counts.values()), 1)
    shares = [(lang, round(min(1.0, max(share, LEAST_EACH / n)) * 1_000_000)) for lang, n in counts.items()]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share long")
    picked = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.col("share"))
    data = F.col("text").cast("binary")
    room = F.greatest(F.octet_length(data) - WINDOW, F.lit(0)) + 1
    places = [F.pmod(F.xxhash64("doc_id", F.lit(13 + k)), room).cast("int") + 1 for k in range(WINDOWS_EACH)]
    rows = picked.select("lang", *(F.substring(data, place, F.lit(WINDOW)).alias(f"w{k}") for k, place in enumerate(places))).limit(2 * (most + LEAST_EACH * len(counts))).collect()
    return sorted((r["lang"], bytes(r[k + 1])) for r in rows for k in range(WINDOWS_EACH) if len(r[k + 1]) >= 8)


def fit(docs: DataFrame, most: int = SAMPLE_DOCS) -> Network | None:
    sample = training_windows(docs, most)
    if not sample:
        return None
    languages = tuple(sorted({lang for lang, _ in sample}))
    # a short window is repeated to full length
    windows = np.stack([np.frombuffer((w * (WINDOW // len(w) + 1))[:WINDOW], np.uint8) for _, w in sample])
    return train(windows, np.array([languages.index(lang) for lang, _ in sample]), languages)


# --- labelling ----------------------------------------------------------------------------------------------------------


def _steps(part: Direction, x: np.ndarray, valid: np.ndarray | None) -> Iterator[np.ndarray]:
    """The state [hidden, window] after each row of x; it is zero until a window's first valid byte."""
    table = np.ascontiguousarray(part.table.T.astype(np.float32))
    u = np.ascontiguousarray(part.u.T.astype(np.float32))
    k = u.shape[1]
    h = np.zeros((k, x.shape[1]), np.float32)
    for t in range(len(x)):
        p = np.take(table, x[t], axis=1)
        g = u @ h
        gates = p[: 2 * k]
        gates += g[: 2 * k]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        n = g[2 * k :]
        n *= gates[k:]
        n += p[2 * k :]
        np.tanh(n, out=n)
        h = h - n
        h *= gates[:k]
        h += n
        if valid is not None:
            h *= valid[t]
        yield h


def position_probabilities(net: Network, x: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, probabilities[language, window]) for the bytes x[step, window], last step first; length: valid bytes of each window."""
    valid = None if (length == len(x)).all() else (np.arange(len(x))[:, None] < length[None, :]).astype(np.float32)
    ahead = list(_steps(net.ahead, x, None))
    k = net.ahead.u.shape[0]
    left, right = net.out[:k].T.astype(np.float32), net.out[k:].T.astype(np.float32)
    bias = net.bias.astype(np.float32)[:, None]
    for t, h in zip(range(len(x) - 1, -1, -1), _steps(net.back, x[::-1], None if valid is None else valid[::-1]), strict=True):
        p = left @ ahead[t]
        p += right @ h
        p += bias
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        if valid is not None:
            p *= valid[t]
        yield t, p


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and document, first byte and length of each window, longest windows first."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    many = (size + WINDOW - 1) // WINDOW
    doc = np.repeat(np.arange(len(texts)), many)
    inside = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    start = np.repeat(np.cumsum(size) - size, many) + inside
    length = np.minimum(size[doc] - inside, WINDOW)
    order = np.argsort(-length, kind="stable")
    return np.frombuffer(b"".join(texts), np.uint8), doc[order], start[order], length[order]


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over all bytes of each text."""
    data, doc, start, length = _windows(texts)
    total = np.zeros((len(texts), len(net.languages)))
    for first in range(0, len(doc), BATCH):
        own, at, size = doc[first : first + BATCH], start[first : first + BATCH], length[first : first + BATCH]
        steps = np.arange(size.max())
        x = data[np.minimum(at[None, :] + steps[:, None], len(data) - 1)]
        mine = np.zeros((len(net.languages), len(own)), np.float64)
        for _, p in position_probabilities(net, x, size):
            mine += p
        for c in range(len(net.languages)):
            total[:, c] += np.bincount(own, mine[c], len(texts))
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def _label(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            p = pooled(net, texts)
            best = p.argmax(axis=1)
            columns = [pa.array(ids, pa.int64()), pa.array([net.languages[b] for b in best]), pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

        for batch in batches:
            for doc_id, has, data in zip(batch.column("doc_id").to_pylist(), batch.column("letters").to_pylist(), batch.column("data"), strict=True):
                if not has:
                    continue
                ids.append(doc_id)
                texts.append(data.as_buffer().to_pybytes())
                held += len(texts[-1])
                if held > BLOCK_BYTES:
                    yield block()
                    ids, texts, held = [], [], 0
            none = [i for i, has in zip(batch.column("doc_id").to_pylist(), batch.column("letters").to_pylist(), strict=True) if not has]
            if none:
                yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array([UNKNOWN] * len(none)), pa.array([0.0] * len(none))], names=["doc_id", "lang_pred", "score"])
        if ids:
            yield block()

    return run


def _rows(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.rlike(r"\p{L}").alias("letters"), text.cast("binary").alias("data"))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    rows = _rows(docs)
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return mapped(rows, _label(docs.sparkSession.sparkContext.broadcast(net)), "doc_id long, lang_pred string, score double")


def labelled_runs(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, start, stop, lang: runs of bytes that have one most likely language."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, scalar in zip(batch.column("doc_id").to_pylist(), batch.column("data"), strict=True):
                data, _, start, length = _windows([scalar.as_buffer().to_pybytes()])
                label = np.zeros(len(data), np.int64)
                for first in range(0, len(start), BATCH):
                    at, size = start[first : first + BATCH], length[first : first + BATCH]
                    x = data[np.minimum(at[None, :] + np.arange(size.max())[:, None], len(data) - 1)]
                    for t, p in position_probabilities(shared.value, x, size):
                        own = size > t
                        label[at[own] + t] = p.argmax(axis=0)[own]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(label)) + 1)) if len(label) else np.empty(0, np.int64)
                stops = np.append(cuts[1:], len(label))[: len(cuts)]
                columns = [pa.array([doc_id] * len(cuts), pa.int64()), pa.array(cuts), pa.array(stops), pa.array([shared.value.languages[label[c]] for c in cuts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "stop", "lang"])

    return mapped(_rows(docs), run, "doc_id long, start long, stop long, lang string")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from docs."""
    return predict(docs, fit(docs)).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
