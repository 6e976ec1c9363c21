"""Language ID by segmentation-marginalised unigrams over a fixed public piece vocabulary.

For each language a probability of every vocabulary piece; a word's probability is the sum over all ways to cut it
into pieces, by the forward algorithm; a text's score is the product over its words.  Piece probabilities are
fitted by expectation-maximisation (forward-backward) on word counts of a bounded sample of labelled documents: the
executors sum expected counts, the driver holds one table of pieces by languages.  The priors are the languages' shares
among all documents that may be learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.llm.scratch import Scratch
from locusframe.llm.wordhash import U, mix

#: Documents a language (expected) that piece probabilities are fitted on, and rounds of the fit.
FIT_DOCS, EM_ROUNDS = 500, 4
#: Letters of words, padding included, that one vectorised pass takes (a longer word is a pass of its own).
PASS_LETTERS = 200_000
#: Words of a language that one call of the fit takes.
HELD_WORDS = 20_000
#: Forward sums are scaled anew after so many letters.
SCALE_EVERY = 8
#: Probability of a letter that is in no piece, alike for all languages.
UNKNOWN = 1e-9
#: Unit of expected counts: sums of whole numbers do not depend on their order.
UNIT = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = U(0x9E3779B97F4A7C15) | U(1)


def words_of(text: str | None) -> list[str]:
    """Runs of letters of any length, lower-cased."""
    return _LETTERS.findall((text or "").lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() for w in words) or any(c.isalpha() for w in words for c in w)


class Lattice:
    """Finds vocabulary pieces at all places of many words at once."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        keys = np.array([self._key(p) for p in pieces], dtype=U)
        self.bits = max(8, int(2 * max(1, self.n) - 1).bit_length() + 2)
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = keys
        for i, slot in enumerate(self._slot(keys)):
            while self.table[slot] >= 0:  # linear probing; lookups below follow the same way
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.table[slot] = i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) >> U(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def lookup(self, key: np.ndarray) -> np.ndarray:
        """Piece number of each key, -1 if none."""
        slot = self._slot(key)
        out = self.table[slot]
        wrong = (out >= 0) & (self.keys[out] != key)
        while wrong.any():
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.table[slot[wrong]]
            wrong &= (out >= 0) & (self.keys[out] != key)
        return out

    def edges(self, words: list[str], n: int) -> list[list[tuple[int, np.ndarray]]]:
        """For words (the mark of a word's start included) of up to n characters: at each end, (length, pieces)."""
        code = np.zeros((n, len(words)), dtype=U)
        for i, w in enumerate(words):
            code[: len(w), i] = np.frombuffer(w.encode("utf-32-le"), dtype="<u4")
        prefix = np.zeros((n + 1, len(words)), dtype=U)
        power = np.ones(n + 1, dtype=U)
        for i in range(n):
            prefix[i + 1] = prefix[i] * _BASE + code[i]
            power[i + 1 : i + 2] = power[i : i + 1] * _BASE
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
        for size in range(1, min(self.longest, n) + 1):
            piece = self.lookup((prefix[size:] - prefix[:-size] * power[size]).ravel()).reshape(n + 1 - size, -1)
            some = (piece >= 0).any(axis=1)
            for at in range(n + 1 - size) if size == 1 else np.flatnonzero(some).tolist():
                out[at + size - 1].append((size, piece[at]))
        return out


class Model:
    """Pieces, languages, log priors and piece probabilities (pieces + 2 rows: unknown letter, no piece)."""

    def __init__(self, pieces: list[str], langs: list[str], log_prior: np.ndarray, prob: np.ndarray):
        self.pieces, self.langs, self.log_prior = pieces, langs, log_prior
        self.lattice = Lattice(pieces)
        self.prob = np.vstack([prob, np.full((1, len(langs)), UNKNOWN), np.zeros((1, len(langs)))]) if len(prob) == len(pieces) else prob

    def __reduce__(self):
        return Model, (self.pieces, self.langs, self.log_prior, self.prob)

    def rows(self, size: int, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, piece, len(self.pieces) if size == 1 else len(self.pieces) + 1)

    def forward(self, edges, columns=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums (ends + 1 x words x languages), each to be multiplied by exp of its scale (same shape)."""
        return _scaled(edges, self.prob[:, columns], self.rows, np.ones((len(edges[0][0][1]), self.prob[:, columns].shape[1])), 0)

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, summed over all segmentations."""
        out = np.empty((len(words), len(self.langs)))
        for own, marked, size in _by_length(words):
            n = np.array([len(w) for w in marked])
            alpha, scale = self.forward(self.lattice.edges(marked, size))
            at = np.arange(len(marked))
            out[own] = np.log(alpha[n, at]) + scale[n, at]
        return out

    def expected(self, words: list[str], times: np.ndarray, lang: int) -> np.ndarray:
        """Expected uses of each piece in words of a language that occur so many times."""
        out = np.zeros(len(self.pieces) + 2)
        prob, column = self.prob[:, [lang]], slice(lang, lang + 1)
        for own, marked, size in _by_length(words):
            n, at = np.array([len(w) for w in marked]), np.arange(len(marked))
            edges = self.lattice.edges(marked, size)
            alpha, up = self.forward(edges, column)
            whole = np.log(alpha[n, at]) + up[n, at]
            beta, down = _backward(edges, prob, self.rows, n)
            found, uses = [], []
            for e, here in enumerate(edges, 1):
                inside = (n >= e)[:, None]
                for length, piece in here:
                    row = self.rows(length, piece)
                    with np.errstate(over="ignore", invalid="ignore"):
                        use = np.where(inside, alpha[e - length] * prob[row] * beta[e] * np.exp(up[e - length] + down[e] - whole), 0.0)
                    found.append(row)
                    uses.append(use[:, 0] * times[own])
            out += np.bincount(np.concatenate(found), np.concatenate(uses), len(out))
        return out[:-2]


def _scaled(edges, prob: np.ndarray, rows, start: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    alpha, scale = np.zeros((len(edges) + 1, *start.shape)), np.zeros((len(edges) + 1, *start.shape))
    alpha[at] = start
    since, log = 0, np.zeros(start.shape)
    for e, here in enumerate(edges, 1):
        for size, piece in here:
            part = alpha[e - size] * prob[rows(size, piece)]
            alpha[e] += part if e - size >= since else part * np.exp(scale[e - size] - log)
        if e % SCALE_EVERY == 0:  # every word and language by itself
            top = alpha[e]
            log = log + np.log(top)
            alpha[e] = 1.0
            since = e
        scale[e] = log
    return alpha, scale


def _backward(edges, prob: np.ndarray, rows, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sums and their scales, as in forward; words end after n letters each."""
    m, width = len(n), prob.shape[1]
    beta, scale = np.zeros((len(edges) + 1, m, width)), np.zeros((len(edges) + 1, m, width))
    after: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(len(edges) + 1)]
    for e, here in enumerate(edges, 1):
        for size, piece in here:
            after[e - size].append((size, piece))
    log = np.zeros((m, width))
    for e in range(len(edges), -1, -1):
        beta[e][n == e] = 1.0
        for size, piece in after[e]:
            beta[e] += np.where((n >= e + size)[:, None], beta[e + size] * prob[rows(size, piece)] * np.exp(scale[e + size] - log), 0.0)
        if e % SCALE_EVERY == 0:
            top = np.where(beta[e] > 0, beta[e], 1.0)
            log = log + np.log(top)
            beta[e] /= top
        scale[e] = log
    return beta, scale


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str], int]]:
    """(numbers, words with the mark of a word's start, most characters): words of like length together."""
    size = np.array([len(w) + 1 for w in words])
    bound = np.where(size <= 25, size, np.ceil(25 * 1.25 ** np.ceil(np.log(np.maximum(size, 25) / 25) / np.log(1.25) - 1e-9) + 1e-6)).astype(np.int64)
    for n in np.unique(bound):
        own = np.flatnonzero(bound == n)
        most = max(1, PASS_LETTERS // int(n))
        for lo in range(0, len(own), most):
            part = own[lo : lo + most]
            yield part, ["▁" + words[i] for i in part], int(size[part].max())


def vocabulary(path: str) -> list[str]:
    """The lower-case letter pieces of a sentencepiece model, its word mark included."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted({p for p in found if p == p.lower() and (p.replace("▁", "") or "a").isalpha() and "▁" not in p[1:]} | {"▁"})


def untrained(pieces: list[str], shares: dict[str, int]) -> Model:
    """Pieces that are likelier the shorter they are, and the languages' priors."""
    langs = sorted(shares)
    prior = np.log(np.array([shares[l] / sum(shares.values()) for l in langs]))
    start = (0.1 / np.array([len(p) for p in pieces]).clip(1) ** 2)[:, None].repeat(len(langs), axis=1)
    return Model(pieces, langs, prior, start / start.sum(axis=0))


def better(model: Model, expected: np.ndarray) -> Model:
    """The next model from expected uses (pieces x languages), lightly smoothed."""
    prob = expected + 0.01
    return Model(model.pieces, model.langs, model.log_prior, prob / prob.sum(axis=0))


def _expect(model):
    """(language, word, times) to (piece, language, expected uses in UNIT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        number = {l: i for i, l in enumerate(own.langs)}
        total: dict[int, np.ndarray] = {}
        held: dict[int, tuple[list[str], list[int]]] = {}

        def add(l: int) -> None:
            words, times = held.pop(l)
            uses = np.rint(own.expected(words, np.array(times, dtype=np.float64), l) * UNIT).astype(np.int64)
            total[l] = total[l] + uses if l in total else uses

        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words, times = held.setdefault(number[lang], ([], []))
                words.append(word)
                times.append(n)
                if len(words) >= HELD_WORDS:
                    add(number[lang])
        for l in list(held):
            add(l)
        for l, uses in total.items():
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), l, np.int32)), pa.array(uses[some])], ["piece", "lang", "uses"])

    return run


def fit(pieces: list[str], counts: DataFrame, shares: dict[str, int], rounds: int = EM_ROUNDS) -> Model:
    """counts: (lang, word, n). Expectation-maximisation of the piece probabilities; the driver receives the summed
    expected uses, a number for a piece and language."""
    model = untrained(pieces, shares)
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(model)
        uses = counts.mapInArrow(_expect(shared), "piece int, lang int, uses bigint").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        found = uses.toPandas()
        expected = np.zeros((len(pieces), len(model.langs)))
        expected[found["piece"].to_numpy(dtype=np.int64), found["lang"].to_numpy(dtype=np.int64)] = found["uses"].to_numpy(dtype=np.float64) / UNIT
        model = better(model, expected)
        shared.unpersist()
    return model


def crc_group(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.update((lang, w) for w in words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, *, vocab: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2) -> Model:
    """Learn from rows with an id, a text and a language whose crc32(id) mod 4 is not held_out.

    Shares of the languages count all of these rows, and all languages are learned.  Piece probabilities are fitted on
    all words of about FIT_DOCS documents a language, picked by hash.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (crc_group(id_col) != held_out))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shares = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not shares:
        return Model(vocabulary(vocab), [], np.zeros(0), np.zeros((0, 0)))
    of = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), of) < FIT_DOCS).select("lang", "text")
    counts = sample.mapInArrow(_word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # few rows and much work in each: dealt to all cores, which a merge of small partitions would undo
    counts = counts.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism), "lang", "word")
    return fit(vocabulary(vocab), Scratch(docs.sparkSession, "langid").cut(counts, "counts"), shares)


class Scorer:
    """Scores texts, remembering the words it has met (MEMO_BYTES of scores, or one batch of words, at most)."""

    MEMO_BYTES = 8 << 20

    def __init__(self, model: Model):
        self.model = model
        self.memo = self.MEMO_BYTES // (8 * max(1, len(model.langs)))
        self.number: dict[str, int] = {}
        self.table = np.zeros((self.memo, len(model.langs)))

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        split = [words_of(t) for t in texts]
        every = {w for s in split for w in s}
        new = list(every.difference(self.number))
        if len(self.number) + len(new) > self.memo:
            new, self.number = list(every), {}
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), len(self.model.langs)))
        if new:
            at = len(self.number)
            self.number.update(zip(new, range(at, at + len(new))))
            self.table[at : at + len(new)] = self.model.score(new)
        out = []
        for s in split:
            if not has_letter(s):
                out.append(("und", 0.0))
                continue
            total = self.model.log_prior + self.table[np.fromiter(map(self.number.__getitem__, s), np.int64, len(s))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _text(batch: pa.RecordBatch) -> pa.Array:
    """The last column, or the last field of a last column of rows."""
    last = batch.column(batch.num_columns - 1)
    return last.flatten()[-1] if pa.types.is_struct(last.type) else last


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            text, lo = _text(batch), 0
            while lo < len(batch):
                hi, size, texts = lo, 0, []
                while hi < len(batch) and (hi == lo or size < 1 << 20):
                    texts.append(text[hi].as_py())
                    size += len(texts[-1] or "")
                    hi += 1
                found = scorer.batch(texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in range(batch.num_columns)), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])
                lo = hi

    return run


def predict(docs: DataFrame, *, vocab: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs.

    lang_pred is a learned language, ``und`` with score 0 for a null text, one without letters, or if nothing
    could be learned; score is the posterior probability of lang_pred.  A row without id is not held out and not
    learned from.  Only the whole text decides a prediction, whatever its length; repeated rows are predicted alike;
    ties go to the first language by code point.  What other columns are called plays no part; an empty table gives no
    rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, vocab=vocab, id_col=id_col, text_col=text_col, lang_col=lang_col, held_out=held_out))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(crc_group(id_col) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_predict(model), f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, text string, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, *, vocab: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns, whose language is found with a posterior of min_score at least.

    Null texts, empty ones and others without letters go; see predict for the rest.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, vocab=vocab, id_col=id_col, text_col=text_col, lang_col=lang_col))
    # a row travels once, its text as the last field
    text = F.col(f"`{text_col}`").cast("string").alias(text_col)
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], text).alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(_predict(model), schema).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])
