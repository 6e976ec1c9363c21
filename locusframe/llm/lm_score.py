"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, scores documents.

Every token is predicted from the ``SIDE`` tokens before and after it, never from itself; a document's score is the
sum of the conditional log-probabilities of its tokens.  The output layer is two-level - a class, then a word in the
class - so each prediction is a proper distribution over the vocabulary at the cost of two small softmaxes.

The vocabulary comes from word counts over all documents.  The most frequent words are outputs of the network of
their own; the others share outputs by length and last character, and the probability of the word inside its
output is its share of the output's count.  The table of words grows with the corpus up to TABLE; words beyond it
have the mean count of such words of their output.  So the score is a distribution over all words of the corpus,
with room for one unseen word in each shared output.  Training goes over every window of every row, copies
included: a round takes one position of EVERY, the next round the positions after them.  Each task trains a copy of
the network on its rows and returns it, copies are averaged, weighted by their windows, and the next round starts
from the average; what the corpus sends grows with it.  Texts are turned into numbers of words once; both rounds and
the scores read those.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.scratch import Scratch

SIDE, DIM, CLASSES, PER_CLASS = 2, 16, 32, 32
#: In a round one row of DOCS and in it one window of EVERY trains, other ones in the next round: with as many rounds,
#: each window of all rows trains once; training rounds, windows of a step, learning rate.
DOCS, EVERY, ROUNDS, STEP, RATE = 1, 2, 2, 64, 0.5
#: Words in the table (some 200 bytes each in every worker), and words of it that have an embedding of their own.
TABLE, CONTEXT = 1 << 18, 1 << 15
#: Words kept of a task's counter at once before it is sent on.
COUNTER = 200_000
#: Steps whose indexes are made at once, windows of a step that share a product of the output layer, windows scored at once.
AHEAD, BLOCK, SCORED = 64, 16, 16384
#: Powers of e up to this one can be summed as they are.
LARGE = 60


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of anything but white space."""
    return (text or "").lower().split()


class Numbers(dict):
    """Numbers of the words of the table; a word beyond it has that of its shared output."""

    def __missing__(self, word: str) -> int:
        return Vocabulary.EDGE - Vocabulary.SPARE + Vocabulary.shared(word)


class Vocabulary:
    """Numbers of words. Below EDGE are the network's outputs: the most frequent words by rank, then the shared
    outputs; the other words of the table follow EDGE by rank, and a word beyond the table has its shared output."""

    SPARE = 8 * PER_CLASS
    EDGE = CLASSES * PER_CLASS

    def __init__(self, ranked: list[str], counts: list[int] | None = None, totals: dict[int, tuple[int, int]] | None = None):
        """counts are those of ranked; totals the (tokens, distinct words) of all words by shared()."""
        self.size = self.EDGE
        own = self.size - self.SPARE
        self.ranked = ranked[:own]
        rare = ranked[own:]
        self.number = Numbers({w: i for i, w in enumerate(self.ranked)} | {w: self.EDGE + 1 + i for i, w in enumerate(rare)})
        self.outputs = np.concatenate([np.arange(self.EDGE + 1), own + np.array([self.shared(w) for w in rare], dtype=np.int64)])
        self.rows = self.outputs.copy()
        self.rows[self.EDGE + 1 :][:CONTEXT] = self.EDGE + 1 + np.arange(len(rare))[:CONTEXT]
        n = np.array([1] * len(ranked) if counts is None else counts, dtype=np.float64)
        every, at = np.zeros((self.SPARE, 2)), self.outputs[self.EDGE + 1 :] - own
        for k, found in (totals or {}).items():
            every[k] = found
        for w, c in zip(self.ranked, n):
            every[self.shared(w)] -= (c, 1) if totals else 0
        inside, listed = np.bincount(at, n[own:], self.SPARE), np.bincount(at, minlength=self.SPARE)
        beyond, kinds = (every - np.stack([inside, listed], axis=1)).T if totals else np.zeros((2, self.SPARE))
        mass = inside + beyond + 1  # one for an unseen word
        rest = np.log((beyond + 1) / (kinds + 1) / mass)
        self.inside = np.concatenate([np.zeros(own), rest, [0.0], np.log(n[own:] / mass[at])])

    @classmethod
    def shared(cls, word: str) -> int:
        return (len(word) * 31 + ord(word[-1])) % cls.SPARE

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def windows(self, ids: np.ndarray, lo: int, hi: int, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows of the contexts and outputs of the targets at the positions lo..hi, or one of every so many."""
        near = slice(max(lo - SIDE, 0), hi + SIDE)
        c, _ = windows(self.rows[ids[near]], lo - near.start, min(hi, len(ids)) - near.start, every)
        return c, self.outputs[ids[lo:hi:every]]


class Network:
    """Position weights, class and word outputs, embeddings: of the outputs, of places beyond the text, then of as
    many more words as flat holds."""

    SHAPES = {"pos": (2 * SIDE, DIM), "hid": (DIM, DIM), "hb": (DIM,), "cls": (CLASSES, DIM), "cb": (CLASSES,), "out": (CLASSES * PER_CLASS, DIM), "ob": (CLASSES * PER_CLASS,), "emb": (CLASSES * PER_CLASS + 1, DIM)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([(rng.normal(size=s) * (0.0 if n in ("hb", "cb", "ob") else 0.3 if n == "emb" else 1 / np.sqrt(DIM)) + (0.5 if n == "pos" else 0.0)).ravel() for n, s in self.SHAPES.items()])
        self.flat = flat.astype(np.float32)
        at = 0
        for n, s in self.SHAPES.items():
            size = len(self.flat) - at if n == "emb" else int(np.prod(s))
            setattr(self, n, self.flat[at : at + size].reshape(-1, *s[1:]))
            at += size
        self.pairs = np.arange(self.emb.size // 2).reshape(len(self.emb), -1)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        mix = (self.pos[:, :, None] * self.hid).reshape(-1, DIM) / np.float32(2 * SIDE)
        return np.tanh(self.emb.take(context, axis=0).reshape(len(context), -1) @ mix + self.hb)

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | both sides) of each row."""
        out = np.empty(len(target), dtype=np.float32)
        for at in range(0, len(target), SCORED):
            rows = slice(at, at + SCORED)
            c, word = np.divmod(target[rows], PER_CLASS)
            h = self.hidden(context[rows])
            order = np.argsort(c.astype(np.int16), kind="stable")
            sorted_h, x = h.take(order, axis=0), np.empty((PER_CLASS, len(c)), dtype=np.float32)
            for lo, hi, k in _runs(c[order]):
                own = slice(k * PER_CLASS, (k + 1) * PER_CLASS)
                x[:, lo:hi] = self.out[own] @ sorted_h[lo:hi].T + self.ob[own, None]
            part = _log_share(self.cls @ h.T + self.cb[:, None], c)
            part[order] += _log_share(x, word[order])
            out[rows] = part
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient ascent on the mean log-probability of a batch."""
        self.steps(context, target, rate, len(target))

    def steps(self, context: np.ndarray, target: np.ndarray, rate: float, size: int) -> None:
        """A step for each size windows in turn, the last one for those left over."""
        whole = len(target) // size * size
        for lo in range(0, whole, AHEAD * size):
            part = slice(lo, min(lo + AHEAD * size, whole))
            self._steps(context[part], target[part], rate, size)
        if whole < len(target):
            self._steps(context[whole:], target[whole:], rate, len(target) - whole)

    def _steps(self, context: np.ndarray, target: np.ndarray, rate: float, n: int) -> None:
        """Steps of n windows each, which fill them.

        Windows of a step are sorted by class. A BLOCK of them touches outputs of a short range of classes, so its
        part of the output layer's gradient is a small product; other classes than the targets' get no part."""
        m = len(target) // n
        t = target.reshape(m, n)
        order = np.argsort((t // PER_CLASS).astype(np.int16), axis=1, kind="stable") + np.arange(0, m * n, n)[:, None]
        t, contexts = target.take(order), context.take(order, axis=0).reshape(m, -1)
        classes, block = t // PER_CLASS, np.arange(n) // BLOCK
        wanted = np.concatenate([classes, t % PER_CLASS], axis=1) + np.arange(2 * n) * PER_CLASS
        first = classes[:, ::BLOCK]
        wide = classes[:, np.minimum(np.arange(BLOCK, n + BLOCK, BLOCK), n) - 1] - first + 1
        ends = np.cumsum(wide * BLOCK, axis=1)
        places = (ends - wide * BLOCK - first)[:, block] + wide[:, block] * (np.arange(n) % BLOCK) + classes

        each = np.float32(rate)
        whole, part, share = each / np.float32(n) * 4, each / 8, np.float32(2 * SIDE)  # rows that few windows touch take larger steps
        # biases are a column (of the hidden layer a row) of their weights, for inputs of one
        out = np.concatenate([self.out, self.ob[:, None]], axis=1)
        cls = np.concatenate([self.cls, self.cb[:, None]], axis=1)
        hid = np.concatenate([self.hid, self.hb[None]])
        by_class, pos = out.reshape(CLASSES, PER_CLASS, DIM + 1), self.pos.reshape(-1)
        pairs = self.emb.reshape(-1).view(np.complex64)  # two numbers at once
        spread = np.zeros((2 * SIDE * DIM, DIM + 1), dtype=np.float32)
        spread_flat, diagonal = spread.reshape(-1), np.arange(2 * SIDE * DIM) * (DIM + 1) + np.arange(2 * SIDE * DIM) % DIM
        x, h, ones = np.empty((2 * n, PER_CLASS), dtype=np.float32), np.ones((n, DIM + 1), dtype=np.float32), np.ones((PER_CLASS, 1), dtype=np.float32)
        d_class, d_word, flat = x[:n], x[n:], x.reshape(-1)
        own, room = np.empty((n, PER_CLASS, DIM + 1), dtype=np.float32), np.empty((int(ends[:, -1].max()), PER_CLASS), dtype=np.float32)
        for i, (stop, width, start) in enumerate(zip(ends.tolist(), wide.tolist(), first.tolist())):
            e = self.emb.take(contexts[i], axis=0).reshape(n, -1)
            spread_flat[diagonal] = pos / share
            mean = np.dot(e, spread)
            mean[:, DIM] = 1
            a = np.dot(mean, hid)
            h[:, :DIM] = np.tanh(a, out=a)
            by_class.take(classes[i], axis=0, out=own, mode="clip")
            np.dot(h, cls.T, out=d_class)
            np.matmul(own, h[:, :, None], out=d_word[:, :, None])
            if x.max() > LARGE or x.min() < -LARGE:
                x -= np.maximum.reduce(x, axis=1, keepdims=True)
            np.exp(x, out=x)
            total = np.dot(x, ones)
            x /= np.negative(total, out=total)
            flat[wanted[i]] += 1
            d_h = np.dot(d_class, cls)
            d_h += np.matmul(d_word[:, None, :], own)[:, 0]
            a *= a
            d_pre = d_h[:, :DIM] * np.subtract(1, a, out=a)
            d_mean = np.dot(d_pre, hid.T)
            d_emb = np.dot(d_mean, spread.T)
            d_emb *= part
            hid += whole * np.dot(mean.T, d_pre)
            pos += whole / share * np.dot(e.T, d_mean).take(diagonal)
            cls += whole * np.dot(d_class.T, h)
            np.add.at(pairs, self.pairs.take(contexts[i], axis=0).reshape(-1), d_emb.reshape(-1).view(np.complex64))
            d_word *= part
            z = room[: stop[-1]]
            z[:] = 0
            z[places[i]] = d_word
            row = at = 0
            for end, w, k in zip(stop, width, start):
                size = min(BLOCK, n - row)
                rows = out[k * PER_CLASS : (k + w) * PER_CLASS]
                rows += np.dot(z[at : at + size * w].reshape(size, -1).T, h[row : row + size])
                row, at = row + size, end
        self.out[:], self.ob[:], self.cls[:], self.cb[:], self.hid[:], self.hb[:] = out[:, :DIM], out[:, DIM], cls[:, :DIM], cls[:, DIM], hid[:DIM], hid[DIM]


def _runs(c: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first row, end row, class) of each class of sorted ones."""
    edges = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]])).tolist()
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield lo, hi, int(c[lo])


def _log_share(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """log of the softmax of each column at the row wanted of it; x is overwritten."""
    x -= x.max(axis=0)
    own = x[wanted, np.arange(len(wanted))]
    return own - np.log(np.exp(x, out=x).sum(axis=0))


def windows(ids: np.ndarray, lo: int, hi: int, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of the positions lo..hi, or one of every so many; places beyond the text hold the number after the last word."""
    edge = np.full(SIDE, CLASSES * PER_CLASS, dtype=np.int64)
    padded = np.concatenate([edge, ids, edge])
    targets = ids[lo:hi:every]
    contexts = np.empty((len(targets), 2 * SIDE), dtype=np.int64)
    for i, offset in enumerate([*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]):
        contexts[:, i] = padded[lo + offset : hi + offset : every][: len(targets)]
    return contexts, targets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for text in b.column(0):
            found.update(words_of(text.as_py()))
            if len(found) > COUNTER:
                yield batch()
                found.clear()
    yield batch()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shared output, tokens, distinct words) of a task's words."""
    tokens, kinds = Counter(), Counter()
    for b in batches:
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            k = Vocabulary.shared(word)
            tokens[k] += n
            kinds[k] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.int32()), pa.array(list(tokens.values()), pa.int64()), pa.array([kinds[k] for k in tokens], pa.int64())], ["k", "tokens", "kinds"])


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The table of words of (word, n): all that occur as often as the rarest level of counts that fits in whole."""
    least, held = None, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if held + r["count"] > TABLE:
            break
        least, held = r["n"], held + r["count"]
    if held < min(CLASSES * PER_CLASS, TABLE):  # one level is larger than the table
        chosen = counts.orderBy(F.desc("n"), "word").limit(CLASSES * PER_CLASS)
    else:
        chosen = counts.where(F.col("n") >= least)
    ranked = sorted(((r["word"], r["n"]) for r in chosen.collect()), key=lambda x: (-x[1], x[0]))
    totals = counts.mapInArrow(_totals, "k int, tokens bigint, kinds bigint").groupBy("k").agg(F.sum("tokens"), F.sum("kinds")).collect()
    return Vocabulary([w for w, _ in ranked], [n for _, n in ranked], {r[0]: (r[1], r[2]) for r in totals})


def _numbered(vocabulary):
    """The last column of texts becomes one of numbers of words (little-endian, 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        for b in batches:
            numbers = [vocab.ids(words_of(text.as_py())).astype("<i4").tobytes() for text in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(numbers, pa.binary())], [*b.schema.names[:-1], "numbers"])

    return run


def _ids(vocab: Vocabulary, value: pa.Scalar) -> np.ndarray:
    """Numbers of the words of a text or, as _numbered leaves them, of its bytes."""
    if pa.types.is_binary(value.type) or pa.types.is_large_binary(value.type):
        return np.frombuffer(value.as_py(), dtype="<i4").astype(np.int64)
    return vocab.ids(words_of(value.as_py()))


def _train(vocabulary, start, round_no: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, vocab = Network(start.value.copy()), vocabulary.value
        held_c, held_t, held, done, row = [], [], 0, 0, 0

        def learn(least: int) -> int:
            nonlocal held_c, held_t, held
            c, t = np.concatenate(held_c), np.concatenate(held_t)
            n = len(t) // least * least
            net.steps(c[:n], t[:n], RATE / (1 + round_no), STEP)
            held_c, held_t, held = [c[n:]], [t[n:]], len(t) - n
            return n

        for b in batches:
            for text in b.column(0):
                row += 1
                if (row + round_no) % DOCS:
                    continue
                ids = _ids(vocab, text)
                for lo in range(0, len(ids), 16384):
                    c, t = vocab.windows(ids, lo + (row + round_no - lo) % EVERY, min(lo + 16384, len(ids)), EVERY)
                    held_c.append(c)
                    held_t.append(t)
                    held += len(t)
                    if held >= AHEAD * STEP:
                        done += learn(STEP)
        if held_t:
            done += learn(1)
        if done:
            width = 8192
            parts = [net.flat[i : i + width] for i in range(0, len(net.flat), width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(done)] * len(parts)), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())], ["part", "weight", "data"])

    return run


def _average(pdf):
    import pandas as pd

    total = pdf["weight"].sum()
    data = sum(np.frombuffer(d, dtype="<f4").astype(np.float64) * (w / total) for d, w in zip(pdf["data"], pdf["weight"]))
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "data": [data.astype("<f4").tobytes()]})


def train(docs: DataFrame, *, text_col: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, Network]:
    """The vocabulary from counts over all documents, the network from the windows of all rows.

    The driver receives the table of words and one averaged network; counts and copies of the network are
    combined on the executors.
    """
    return _fit(docs.select(F.col(text_col).cast("string").alias("text")), rounds)[:2]


def _fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Network, DataFrame]:
    """Vocabulary and network from the last column of rows, and rows with numbers of words in its place."""
    sc, scratch = rows.sparkSession.sparkContext, Scratch(rows.sparkSession, "lm")
    text = rows.select("text").where("text is not null")
    counts = scratch.cut(text.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    vocab, net = vocabulary(counts), Network()
    scratch.drop(counts)
    more = vocab.rows[Network.SHAPES["emb"][0] :][:CONTEXT]
    net = Network(np.concatenate([net.flat, net.emb[vocab.outputs[more]].ravel()]))  # from the row of the shared output
    shared = sc.broadcast(vocab)
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    numbered = scratch.cut(rows.mapInArrow(_numbered(shared), f"{kept}numbers binary"), "numbers")
    for r in range(rounds):
        start = sc.broadcast(net.flat)
        copies = numbered.select("numbers").mapInArrow(_train(shared, start, r), "part int, weight double, data binary")
        parts = copies.groupBy("part").applyInPandas(_average, "part int, data binary").orderBy("part").collect()
        if parts:
            net = Network(np.concatenate([np.frombuffer(p["data"], dtype="<f4") for p in parts]))
    return vocab, net, numbered


def _score(vocabulary, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = vocabulary.value, Network(weights.value)
        for b in batches:
            n = np.zeros(len(b), dtype=np.int64)
            total = np.zeros(len(b))
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def flush() -> None:
                if held:
                    c, t, row = (np.concatenate(x) for x in zip(*held))
                    np.add.at(total, row, net.log_prob(c, t).astype(np.float64))
                    held.clear()

            size = 0
            for i, text in enumerate(b.column(1)):
                ids = _ids(vocab, text)
                n[i] = len(ids)
                total[i] = vocab.inside[ids].sum()
                for lo in range(0, len(ids), 16384):
                    c, t = vocab.windows(ids, lo, min(lo + 16384, len(ids)))
                    held.append((c, t, np.full(len(t), i)))
                    size += len(t)
                    if size >= 16384:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total)], ["id", "n_tokens", "pll"])

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: tuple[Vocabulary, Network] | None = None) -> DataFrame:
    """(id, n_tokens, pll, pll_per_token, perplexity) for each row of docs, trained on them unless a model is given.

    pll is the sum over all tokens of the whole text of log p(word | SIDE words on both sides), that of a shared
    output and of the word inside it together.  A null text or
    one without tokens has n_tokens 0, pll 0 and null per-token figures.  Repeated rows score alike up to float
    rounding; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    vocab, net, rows = (*model, rows) if model else _fit(rows)
    out = rows.mapInArrow(_score(sc.broadcast(vocab), sc.broadcast(net.flat)), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, pll double")
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "pll", mean.alias("pll_per_token"), F.exp(-mean).alias("perplexity"))
