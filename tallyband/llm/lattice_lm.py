"""Language-model scores: the likelihood of a text over all its segmentations into the pieces of an existing vocabulary.

A text is a row of words, each with a space before it, then one end. Pieces never cross a space, so the lattice of a text
is the lattices of its words in a row, and a word's marginal probability is found once for the whole table. The
forward recursion is in logarithms: ln a(j) = logsumexp over pieces that end at j of ln a(i) + ln p(piece). Words seen in
training are pieces of their own besides: the whole word is one more arc over its lattice, with the share
(count - DISCOUNT) / tokens; what the discounts leave is the weight of all other segmentations.

Piece weights start from the vocabulary's own order (a piece of rank r weighs 1 / (r + 1)) and are fitted to the training
documents by ROUNDS steps of expected counts over the table of all their words. There is a set of weights for each of
the most frequent languages of the training documents, and one for the rest. Which set a text was drawn from is summed out
like the segmentations, so scoring reads the text alone.

Counts of words come from a table that grows with the corpus; it has the words of all documents, so that each distinct word
is scored once. Words that make up at least 1 / HEAD of all training tokens are at most HEAD; these are broadcast. All
other words meet the table in a join, as rows (document, word, times), so nothing that grows with the corpus is
broadcast or sent to the driver.

Defined results: a null text is the empty text, whose one token is the end; a null id counts as the empty text in the
hash that holds rows out; a null lang is one of the rest; repeated rows are scored each; without training documents the
pieces keep their first weights; an empty table gives an empty result; only doc_id, text and, for training, lang are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyband.llm.byte_bpe import load_ranks
from tallyband.llm.common import larger, mapped, remainder, row_tag, text_or_empty, work_table

HEAD = 200_000
ROUNDS = 1
BLOCK_BYTES = 4_000_000
#: No vocabulary may have a longer piece (bytes); a lattice is as deep as its own longest piece.
LONGEST = 1024
#: Added to each piece's expected count.
ADDED = 0.01
#: Taken from each word's count for its other segmentations.
DISCOUNT = 0.6
#: Languages with piece weights of their own.
LANGUAGES = 6
#: The end of a text in the table of words: no word is empty.
END = b""


#: ln of a weight that stands for none.
NONE = -1e30
#: Pieces of up to so many bytes stand at most places; longer ones are summed up one by one.
DENSE = 3


class Lattice:
    """Pieces and their natural log weights. Pieces are found by walking a trie kept as a flat table of edges."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray | None = None):
        usable = [k for k, p in enumerate(pieces) if p and not any(c in b"\t\n\v\f\r " for c in p[1:]) and p[:1] not in (b"\t", b"\n", b"\v", b"\f", b"\r")]
        self.count = len(pieces)
        self.longest = max((len(pieces[k]) for k in usable), default=1)
        if self.longest > LONGEST:
            raise ValueError(f"a piece of more than {LONGEST} bytes")
        nodes = {b"": 0}
        edges: dict[int, int] = {}
        piece_of = [-1]
        for k in usable:
            piece = pieces[k]
            for cut in range(1, len(piece) + 1):
                part = piece[:cut]
                if part not in nodes:
                    nodes[part] = len(nodes)
                    piece_of.append(-1)
                    edges[nodes[piece[: cut - 1]] << 8 | piece[cut - 1]] = nodes[part]
            piece_of[nodes[piece]] = k
        self.piece_of = np.array(piece_of, np.int64)
        keys = np.array(sorted(edges), np.int64)
        bits = (4 * len(keys)).bit_length()
        self.mask = (1 << bits) - 1
        self._place(keys, np.array([edges[k] for k in keys.tolist()], np.int64))
        if log_p is None:  # the vocabulary's order
            weights = np.zeros(len(pieces))
            weights[usable] = 1 / (1 + np.array(usable))
            log_p = np.log(np.maximum(weights / weights.sum(), 1e-300))
        self.log_p = log_p

    @staticmethod
    def _closed(log_p: np.ndarray, kind: type) -> np.ndarray:
        return np.append(np.maximum(log_p, NONE), NONE).astype(kind)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: a key that finds its slot taken goes to the next."""
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.zeros(self.mask + 1, np.int64)
        at = self._hash(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 40503) ^ (keys >> 7)) & self.mask

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """Nodes below the edges; 0 where there is none."""
        at = self._hash(keys)
        found = np.where(self.keys[at] == keys, self.values[at], 0)
        open_ = np.flatnonzero((found == 0) & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            found[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return found

    def arcs(self, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length d + 1 the arcs of such pieces: place (byte * words + word, rising) and piece. data: words of one length as rows."""
        many, length = data.shape
        flat = np.ascontiguousarray(data.T).reshape(-1)
        where, node = np.arange(many * length), np.zeros(many * length, np.int64)
        out = []
        for d in range(min(self.longest, length)):
            inside = np.searchsorted(where, (length - d) * many)
            where, node = where[:inside], node[:inside]
            node = self._children(node << 8 | flat[where + d * many])
            alive = node > 0
            where, node = where[alive], node[alive]
            if not len(where):
                break
            piece = self.piece_of[node]
            ends = piece >= 0
            out.append((where[ends], piece[ends]))
        return out

    @staticmethod
    def _weighed(arcs: list[tuple[np.ndarray, np.ndarray]], log_p: np.ndarray, length: int, many: int) -> tuple[list, list]:
        """ln weights of the arcs: of the DENSE shortest lengths as matrices by byte and word, of others as (d, word, weight) for each byte."""
        dense, rest = [], [[] for _ in range(length)]
        for d, (where, piece) in enumerate(arcs):
            if d < DENSE:
                weights = np.full((length, many), NONE, log_p.dtype)
                weights.reshape(-1)[where] = log_p[piece]
                dense.append(weights)
                continue
            cuts = np.searchsorted(where, np.arange(length + 1) * many).tolist()
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[i], cuts[i + 1])
                rest[i].append((d, where[own] - i * many, log_p[piece[own]]))
        return dense, rest

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        """logsumexp, word by word."""
        if len(terms) == 1:
            return terms[0]
        top = np.maximum.reduce(terms)
        total = np.zeros_like(top)
        for t in terms:
            t -= top
            total += np.exp(t, out=t)
        return top + np.log(total, out=total)

    def _forward(self, dense: list, rest: list, length: int, many: int, kind: type) -> np.ndarray:
        """ln a(j) by place and word."""
        a = np.full((length + 1, many), NONE, kind)
        a[0] = 0
        ending: list[list] = [[] for _ in range(length + 1)]
        for i, own in enumerate(rest):
            for d, word, weight in own:
                ending[i + d + 1].append((i, word, weight))
        for j in range(1, length + 1):
            a[j] = self._sum([a[j - 1 - d] + dense[d][j - 1 - d] for d in range(min(len(dense), j))])
            for i, word, weight in ending[j]:
                a[j, word] = np.logaddexp(a[j, word], a[i, word] + weight)
        return a

    def _backward(self, dense: list, rest: list, length: int, many: int, kind: type) -> np.ndarray:
        b = np.full((length + 1, many), NONE, kind)
        b[length] = 0
        for i in range(length - 1, -1, -1):
            b[i] = self._sum([b[i + 1 + d] + dense[d][i] for d in range(min(len(dense), length - i))])
            for d, word, weight in rest[i]:
                b[i, word] = np.logaddexp(b[i, word], b[i + 1 + d, word] + weight)
        return b

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            most = max(1, 200_000 // (length + 1))
            for first in range(0, len(rows), most):
                own = rows[first : first + most]
                data = np.frombuffer(b"".join([b" " + words[r] for r in own.tolist()]), np.uint8).reshape(-1, length + 1)
                yield own, data

    def log_marginals(self, words: list[bytes], sets: np.ndarray | None = None, kind: type = np.float64) -> np.ndarray:
        """ln of each word's probability, summed over all its segmentations, by each set of ln weights (a row each)."""
        closed = [self._closed(w, kind) for w in (self.log_p[None, :] if sets is None else sets)]
        out = np.zeros((len(closed), len(words)))
        for rows, data in self._groups(words):
            many, length = data.shape
            arcs = self.arcs(data)
            for k, log_p in enumerate(closed):
                out[k, rows] = self._forward(*self._weighed(arcs, log_p, length, many), length, many, kind)[-1]
        return out

    def expected(self, words: list[bytes], times: np.ndarray, log_p: np.ndarray | None = None, kind: type = np.float64) -> np.ndarray:
        """How often each piece is used in the words, weighted by probability and by times."""
        closed = self._closed(self.log_p if log_p is None else log_p, kind)
        out = np.zeros(self.count)
        for rows, data in self._groups(words):
            many, length = data.shape
            arcs = self.arcs(data)
            dense, rest = self._weighed(arcs, closed, length, many)
            a = self._forward(dense, rest, length, many, kind)
            b = self._backward(dense, rest, length, many, kind) - a[length]
            for d, (where, piece) in enumerate(arcs):
                use = a.reshape(-1)[where] + closed[piece] + b.reshape(-1)[where + (d + 1) * many]
                out += np.bincount(piece, np.exp(use) * times[rows][where % many], self.count)
        return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _words(data: pa.Scalar) -> list[bytes]:
    """Words of a text in UTF-8; lower() and split() of bytes know A-Z and the six white spaces only."""
    return data.as_buffer().to_pybytes().lower().split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, part, n) of blocks of documents; part: the number of the document's language."""
    numbers: dict[int, _Numbers] = {}
    codes: dict[int, list[np.ndarray]] = {}
    held = 0

    def table() -> Iterator[pa.RecordBatch]:
        for part, own in numbers.items():
            times = np.bincount(np.concatenate(codes[part]), minlength=len(own))
            columns = [pa.array([*own, END], pa.binary()), pa.array(np.full(len(own) + 1, part, np.int32)), pa.array(np.append(times, len(codes[part])))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "part", "n"])

    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
            words = _words(data)
            own = numbers.setdefault(part, _Numbers())
            codes.setdefault(part, []).append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
            held += len(words)
            if held > 2_000_000:
                yield from table()
                numbers, codes, held = {}, {}, 0
    yield from table()


def word_counts(docs: DataFrame, languages: list[str], training: Column) -> DataFrame:
    """word (binary; the end is empty) of all tokens of docs, n of those in training documents, and c0, c1.. by language; the last is of all others."""
    part = F.lit(len(languages))
    for k, lang in enumerate(languages):
        part = F.when(F.col("lang") == lang, k).otherwise(part)
    part = F.when(training, part).otherwise(len(languages) + 1)
    rows = docs.select(part.cast("int").alias("part"), text_or_empty().cast("binary").alias("data"))
    found = mapped(rows, _counts, "word binary, part int, n long")
    each = [F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(len(languages) + 1)]
    n = F.sum(F.when(F.col("part") <= len(languages), F.col("n")).otherwise(0))
    return found.groupBy("word").agg(n.alias("n"), *each)


@dataclass(frozen=True)
class Model:
    """For each set: ln weights of pieces, ln share of texts and of the end, log10 weight of segmentations, tokens. parts: its column of counts."""

    parts: tuple[int, ...]
    log_p: np.ndarray
    log_share: np.ndarray
    log_end: np.ndarray
    log_rest: np.ndarray
    tokens: np.ndarray


def fit_lattice(counts: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """From a stored table of word counts. What comes to the driver is of the vocabulary's size."""
    sc = counts.sparkSession.sparkContext
    parts = [c for c in counts.columns if c[0] == "c"]
    is_end = F.col("word") == F.lit(END)
    sums = [F.coalesce(F.sum(x), F.lit(0)) for c in parts for x in (F.col(c), F.when(is_end, F.col(c)), F.when(~is_end & (F.col(c) > 0), 1))]
    tokens, ends, words = (np.array(x, np.float64) for x in np.array(counts.agg(*sums).first()).reshape(-1, 3).T)
    used = tuple(int(k) for k in np.flatnonzero(ends))
    first = Lattice(pieces).log_p
    if not used:
        return Model((), first[None, :], np.zeros(1), np.full(1, math.log(0.01)), np.full(1, math.log10(0.99)), np.zeros(1))
    shared, log_p = sc.broadcast(pieces), np.stack([first] * len(used))
    for _ in range(rounds):
        weights = sc.broadcast(log_p)

        def use(batches: Iterator[pa.RecordBatch], weights: Broadcast = weights) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(shared.value, weights.value[0])
            total = np.zeros((len(used), lattice.count))
            for batch in larger(batches):
                words = np.array(batch.column("word").to_pylist(), object)
                for k, part in enumerate(used):
                    n = batch.column(f"c{part}").to_numpy().astype(np.float64)
                    own = np.flatnonzero(n)
                    if len(own):
                        total[k] += lattice.expected(words[own].tolist(), n[own], weights.value[k], np.float32)
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], names=["k", "piece", "n"])

        found = mapped(counts.filter(~is_end & (F.col("n") > 0)), use, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(log_p.shape)
        total[found.column("k").to_numpy(), found.column("piece").to_numpy()] = found.column("n").to_numpy()
        total += ADDED
        log_p = np.log(total / total.sum(axis=1, keepdims=True))
    own = list(used)
    rest = (DISCOUNT * words[own] + 0.01) / (tokens[own] + 0.01)
    return Model(used, log_p, np.log(ends[own] / ends.sum()), np.log(ends[own] / (tokens[own] + 0.01)), np.log10(rest), tokens[own])


def _scored(pieces: Broadcast, model: Broadcast):
    """For each word and set: log10 of its probability, over its own arc, if it was counted, and its lattice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        lattice = Lattice(pieces.value, m.log_p[0])
        for batch in larger(batches):
            score = lattice.log_marginals(batch.column("word").to_pylist(), m.log_p, np.float32) / math.log(10) + m.log_rest[:, None]
            for k, part in enumerate(m.parts):
                n = batch.column(f"c{part}").to_numpy().astype(np.float64)
                own = np.flatnonzero(n)
                arc = np.log10((n[own] - DISCOUNT) / (m.tokens[k] + 0.01))
                score[k, own] = np.maximum(arc, score[k, own]) + np.log10(1 + 10 ** -np.abs(arc - score[k, own]))
            columns = [batch.column("word"), batch.column("n"), *(pa.array(x.astype(np.float32)) for x in score)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", *(f"s{k}" for k in range(len(score)))])

    return run


@dataclass(frozen=True)
class Head:
    """Frequent words: place of each, counts and scores (a row a set)."""

    place: dict[bytes, int]
    n: np.ndarray
    score: np.ndarray


def _postings(head: Broadcast, end_known: bool):
    """For blocks of documents: a row each document, with the sums of its frequent words, and one each (document, other word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Head = head.value
        base, sets = np.log10(known.n + 0.5), len(known.score)
        rows: list[int] = []
        ids: list = []
        codes: list[np.ndarray] = []
        numbers, held = _Numbers(), 0

        def block() -> pa.RecordBatch:
            words = list(numbers)
            place = np.fromiter((known.place.get(w, -1) for w in words), np.int64, len(words))
            n = np.array([len(x) for x in codes])
            doc, code = np.repeat(np.arange(len(codes)), n), np.concatenate(codes)
            often = place[code] >= 0
            where_often, at = doc[often], place[code[often]]
            pair, times = np.unique(doc[~often] * np.int64(len(words) + 1) + code[~often], return_counts=True)
            where, word = pair // (len(words) + 1), pair % (len(words) + 1)
            row = np.array(rows, np.int64)
            sums = [np.bincount(where_often, x[at], len(codes)).astype(np.float64) for x in (base, *known.score)]
            columns = [
                pa.concat_arrays([pa.array(row), pa.array(row[where])]),
                pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(len(pair), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(rows), pa.binary()), pa.array(words, pa.binary()).take(pa.array(word))]),
                pa.concat_arrays([pa.array(n + 1), pa.array(times)]),
                pa.concat_arrays([pa.array(np.bincount(where_often, minlength=len(codes)).astype(np.int64) + end_known), pa.nulls(len(pair), pa.int64())]),
                *(pa.concat_arrays([pa.array(x), pa.nulls(len(pair), pa.float64())]) for x in sums),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "word", "n", "known", "base", *(f"s{k}" for k in range(sets))])

        for batch in batches:
            for row, doc_id, data in zip(batch.column("tag").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("data"), strict=True):
                words = _words(data)
                rows.append(row)
                ids.append(doc_id)
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                held += len(data.as_buffer()) + 100
                if held > BLOCK_BYTES:
                    yield block()
                    rows, ids, codes, numbers, held = [], [], [], _Numbers(), 0
        if rows:
            yield block()

    return run


def score_documents(docs: DataFrame, path: str, training: Column, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    path: a vocabulary as lines of piece and rank, read by the driver alone. training: which rows to learn from.
    """
    sc = docs.sparkSession.sparkContext
    pieces = load_ranks(path)
    often = docs.filter(training & F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    counts = work_table(word_counts(docs, [r["lang"] for r in often], training), "lm-counts")
    is_end = F.col("word") == F.lit(END)
    known = F.when(F.col("n") > 0, 1)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(known).alias("v"), F.max(F.when(is_end, F.col("n"))).alias("ends")).first()
    fitted = fit_lattice(counts, pieces, rounds)
    sets = [f"s{k}" for k in range(len(fitted.log_p))]
    words = mapped(counts.filter(~is_end), _scored(sc.broadcast(pieces), sc.broadcast(fitted)), f"word binary, n long, {', '.join(f'{s} float' for s in sets)}")
    words = work_table(words, "lm-words")
    # At most `head` words can have a share of 1 / head each.
    top = words.filter((F.col("n") > 0) & (F.col("n") * head >= total.n)).toArrow()
    frequent = Head({w: k for k, w in enumerate(top.column("word").to_pylist())}, top.column("n").to_numpy(), np.stack([top.column(s).to_numpy() for s in sets]))
    rows = docs.select(row_tag(), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    schema = "row long, doc_id long, word binary, n long, known long, base double, " + ", ".join(f"{s} double" for s in sets)
    found = work_table(mapped(rows, _postings(sc.broadcast(frequent), bool(total.ends)), schema), "lm-postings")

    tail = found.filter("word is not null").select("row", "word", F.col("n").alias("times")).join(words, "word")
    tail = tail.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("tail_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("tail_known"),
        *(F.sum(F.col("times") * F.col(s)).alias(f"tail_{s}") for s in sets),
    )
    own = found.filter("word is null").drop("word").join(tail, "row", "left")
    nothing = F.lit(0.0)
    # log10 of the sum over sets
    each = [F.col(s) + F.coalesce(f"tail_{s}", nothing) + F.lit(float(fitted.log_share[k] + fitted.log_end[k]) / math.log(10)) for k, s in enumerate(sets)]
    own = own.withColumn("each", F.array(*each)).withColumn("top", F.array_max("each"))
    score = F.col("top") + F.log10(F.aggregate("each", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - F.col("top"))))
    floor = math.log10(total.n + 0.5 * (total.v + 1))
    end_base = math.log10((total.ends or 0) + 0.5)
    return own.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", nothing) + F.lit(end_base) - F.col("n") * F.lit(floor)).alias("base_score"),
        score.alias("score"),
    )


def training_part(held: int = 1, parts: int = 5) -> Column:
    return remainder(parts) != held
