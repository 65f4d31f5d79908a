"""Language ID by unigram pieces of a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece. A word's probability is the sum over all its segmentations into
pieces (forward algorithm); a text's is the product over its words. Probabilities are fitted by expectation
maximisation (forward-backward) on the words of a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled documents per language in the fitting sample, in expectation.
SAMPLE_DOCS = 2000
ROUNDS = 4
#: Words are cut into parts of so many characters; no piece crosses a cut.
PART = 24
#: Share of the probability spread over all pieces, and the probability of a character that no piece covers.
SMOOTH, UNKNOWN = 0.02, 1e-7
#: Words whose scores a worker keeps, and words whose arcs are held at a time.
CACHE_WORDS, ARC_WORDS = 400_000, 4_000
UND = "und"
#: Least gain of a letter over the flat model that an accepted text has.
LEAST_GAIN = 0.0
_WORD = re.compile(r"[^\W\d_]+")
#: The same for texts of the first 256 characters, in less than half the time; the signs that end a run aren't among its letters.
_LATIN_WORD = re.compile(f"[{''.join(c for c in map(chr, range(256)) if c.isalpha())}]+")
_GAP = "\n"


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, cut into parts of PART characters. Other characters that Python takes for a word's (as in m²) end a run."""
    lower = text.lower() if text else ""
    try:
        lower.encode("latin-1")
        out = _LATIN_WORD.findall(lower)
    except UnicodeEncodeError:
        out = _WORD.findall(lower)
        if out and not "".join(out).isalpha():
            out = [x for w in out for x in (w,) * w.isalpha() or "".join(c if c.isalpha() else " " for c in w).split()]
    if max(map(len, out), default=0) > PART:
        out = [w[i : i + PART] for w in out for i in range(0, len(w), PART)]
    return out


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of the public vocabulary that can stand in a word, with its mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (p for p in map(model.id_to_piece, range(model.vocab_size())) if not re.fullmatch(r"<.*>", p))
    return sorted({p.lower() for p in kept if p.strip("▁").isalpha() or p == "▁"})


class Lattice:
    """The arcs of many words: for each, pieces by end position. Probabilities are float64; PART keeps them in range."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.sizes = np.array([len(p) for p in pieces] + [1], np.int64)
        self.known = np.zeros(sys.maxunicode + 1, bool)
        self.known[[ord(p) for p in [_GAP, *pieces] if len(p) == 1]] = True

    def arcs(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """lengths, starts and groups (end, length, words, pieces) in the order of the ends. Each word gets the start mark."""
        text = _GAP.join("▁" + w for w in some)
        lengths = np.fromiter((len(w) + 1 for w in some), np.int64, len(some))
        starts = np.cumsum(lengths + 1) - lengths - 1
        end, piece = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2).T
        lone = np.flatnonzero(~self.known[np.frombuffer(text.encode("utf-32-le"), np.uint32)])
        end, piece = np.concatenate([end, lone]), np.concatenate([piece, np.full(len(lone), self.n)])
        size = self.sizes[piece]
        word = np.repeat(np.arange(len(some)), lengths + 1)[end]
        at = end - starts[word] + 1
        order = np.argsort((at * (PART + 2) + size).astype(np.int16), kind="stable")  # by end, then size: neither is over PART + 1
        word, at, size, piece = word[order], at[order], size[order], piece[order]
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(size) != 0)) + 1
        bounds = [0, *cut.tolist(), len(at)] if len(at) else []
        return lengths, starts, [(int(at[a]), int(size[a]), word[a:b], piece[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def forward(self, some: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word by language; p: language x (pieces and the unknown)."""
        out, of_piece = np.empty((len(some), len(p))), np.ascontiguousarray(p.T)
        for a in range(0, len(some), ARC_WORDS):
            part = some[a : a + ARC_WORDS]
            lengths, _, groups = self.arcs(part)
            alpha = np.zeros((PART + 2, len(part), len(p)))
            alpha[0] = 1
            for end, size, word, piece in groups:
                alpha[end, word] += alpha[end - size, word] * of_piece[piece]
            out[a : a + ARC_WORDS] = np.log(alpha[lengths, np.arange(len(part))])
        return out

    def expected(self, some: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for one language: forward-backward over the words, weighed by counts."""
        out = np.zeros(self.n + 1)
        for a in range(0, len(some), ARC_WORDS):
            part, n = some[a : a + ARC_WORDS], counts[a : a + ARC_WORDS]
            lengths, _, groups = self.arcs(part)
            alpha, beta = np.zeros((PART + 2, len(part))), np.zeros((PART + 2, len(part)))
            alpha[0] = 1
            for end, size, word, piece in groups:
                alpha[end, word] += alpha[end - size, word] * p[piece]
            each = np.arange(len(part))
            beta[lengths, each] = n / alpha[lengths, each]
            for end, size, word, piece in reversed(groups):
                flow = p[piece] * beta[end, word]
                beta[end - size, word] += flow
                out += np.bincount(piece, flow * alpha[end - size, word], self.n + 1)
        return out


@dataclass
class Model:
    pieces: list[str]
    langs: list[str]
    p: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def flat(cls, pieces: list[str], langs: list[str]) -> Model:
        """Every piece is as likely as any other."""
        p = np.full((len(langs), len(pieces) + 1), 1 / max(1, len(pieces)))
        p[:, -1] = UNKNOWN
        return cls(pieces, langs, p)

    def fitted(self, used: np.ndarray) -> Model:
        """The next round's model: used is how often each language is expected to have used each piece."""
        used = used.copy()
        used[:, -1] = 0
        p = (1 - SMOOTH) * used / np.maximum(used.sum(1, keepdims=True), 1e-300) + SMOOTH * Model.flat(self.pieces, self.langs).p
        p[:, -1] = UNKNOWN
        return Model(self.pieces, self.langs, p)

    @classmethod
    def fit(cls, pieces: list[str], counts: dict[str, dict[str, int]], rounds: int = ROUNDS) -> Model:
        """counts: by language, how often each word is seen. All in memory; fit() of this module does the same on Spark."""
        lattice, model = Lattice(pieces), cls.flat(pieces, sorted(k for k, v in counts.items() if v))
        for _ in range(rounds):
            used = [lattice.expected(list(n), np.fromiter(n.values(), float, len(n)), p) for n, p in zip(map(counts.get, model.langs), model.p, strict=True)]
            model = model.fitted(np.array(used).reshape(model.p.shape))
        return model


class Scorer:
    """Scores texts; keeps the scores of words it has seen."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.p = model.p
        self.rows: dict[str, int] = {}
        self.scores = np.empty((0, len(self.p)))

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text by row of p, and its letters."""
        seen = [words(t) for t in texts]
        flat = [w for s in seen for w in s]
        sums = np.zeros((len(texts), len(self.p)))
        if self.model.langs and flat:
            ids = np.fromiter(map(self.rows.get, flat, repeat(-1)), np.int64, len(flat))
            new = list(dict.fromkeys(flat[i] for i in np.flatnonzero(ids < 0).tolist()))
            if new:
                if len(self.rows) + len(new) > CACHE_WORDS:
                    self.rows, self.scores, new = {}, np.empty((0, len(self.p))), list(dict.fromkeys(flat))
                    ids[:] = -1
                self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
                self.scores = np.concatenate([self.scores, self.lattice.forward(new, self.p)])
                left = np.flatnonzero(ids < 0)
                ids[left] = np.fromiter((self.rows[flat[i]] for i in left.tolist()), np.int64, len(left))
            sizes = np.fromiter(map(len, seen), np.int64, len(seen))
            sums[sizes > 0] = np.add.reduceat(self.scores[ids], (np.cumsum(sizes) - sizes)[sizes > 0])
        return sums, np.array([sum(map(len, s)) for s in seen], np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.told(*self.sums(texts))

    def told(self, sums: np.ndarray, letters: np.ndarray) -> tuple[list[str], list[float]]:
        if not self.model.langs or not letters.any():
            return [UND] * len(sums), [0.0] * len(sums)
        sums = sums[:, : len(self.model.langs)]
        odds = np.exp(sums - sums.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        best = odds.argmax(1)
        return [self.model.langs[b] if s else UND for b, s in zip(best, letters, strict=True)], [float(o) if s else 0.0 for o, s in zip(odds.max(1), letters, strict=True)]


class Judge(Scorer):
    """A scorer that also sets each text's best language against a flat model."""

    def __init__(self, model: Model):
        super().__init__(model)
        if model.langs:
            flat = np.full((1, self.lattice.n + 1), 1 / self.lattice.n)
            flat[0, -1] = UNKNOWN
            self.p = np.concatenate([self.p, flat])
            self.scores = np.empty((0, len(self.p)))

    def judged(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """predict(), and by how much a letter is likelier in the best language than in the flat model (natural log); it doesn't grow with the text."""
        sums, letters = self.sums(texts)
        gains = (sums[:, :-1].max(1) - sums[:, -1]) / np.maximum(1, letters) if self.model.langs else np.zeros(len(sums))
        return *self.told(sums, letters), gains.tolist()


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id is none of them, but isn't learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the labelled documents that aren't held out: all words of about sample_docs of each language, chosen by hash.

    Each round's expectation is a Spark job over the words; collected are a count for each language and each piece. No
    labelled documents: a model without languages.
    """
    lang = F.col(lang_col).cast("string")
    able = docs.where(F.col(id_col).isNotNull() & lang.isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = {r["lang"]: r["n"] for r in able.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(vocabulary(path), [], np.empty((0, 0)))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n))))
    near = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < F.element_at(share, lang) * (1 << 30)
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}+"), F.lit(0)))
    counted = able.where(near).select(lang.alias("lang"), word.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = stage(counted.repartition(docs.sparkSession.sparkContext.defaultParallelism), "language-words")  # as bounded as the sample
    model = Model.flat(vocabulary(path), sorted(r["lang"] for r in counted.select("lang").distinct().collect()))
    for _ in range(ROUNDS):
        used = np.zeros_like(model.p)
        for r in _expected(counted, model).groupBy("lang", "piece").agg(F.sum("used").alias("used")).collect():  # languages x pieces
            used[r["lang"], r["piece"]] = r["used"]
        model = model.fitted(used)
    return model


def _expected(counted: DataFrame, model: Model) -> DataFrame:
    """(lang, piece, used), by places in the model: what the words of each task are expected to have used."""
    sent = counted.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, used = sent.value, np.zeros(sent.value.p.shape)
        lattice = Lattice(model.pieces)
        for batch in batches:
            counts: dict[str, dict[str, int]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = counts.setdefault(lang, {})
                for w in words(word):
                    own[w] = own.get(w, 0) + n
            for lang, own in counts.items():
                i = model.langs.index(lang)
                used[i] += lattice.expected(list(own), np.fromiter(own.values(), float, len(own)), model.p[i])
        i, piece = np.nonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(used[i, piece])], ["lang", "piece", "used"])

    return counted.mapInArrow(run, "lang int, piece int, used double")


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row of docs, from the text alone; und with score 0 for null texts and those without a letter."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model.key  # pieces x languages: bounded by the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(sent.value)
        scorer = _SCORERS[key]
        for batch in batches:
            langs, scores = [], []
            for a in range(0, batch.num_rows, 500):
                x, y = scorer.predict(batch.column(1)[a : a + 500].to_pylist())
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def digest(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """op10's columns for documents. An empty table gives no rows; without labelled documents all are und."""
    return predict(docs, fit(docs, path=path)).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5, path: str = VOCABULARY, least_gain: float = LEAST_GAIN) -> DataFrame:
    """docs without the rows whose language can't be told: no letter, a score of less than ``least``, or a gain of less than ``least_gain`` (letter noise, languages that were not learned)."""
    model = fit(docs, path=path)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Judge(sent.value)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for a in range(0, batch.num_rows, 500):  # a batch's texts are never all Python strings
                told = zip(*_SCORERS[key].judged(text[a : a + 500].to_pylist()), strict=True)
                yield batch.slice(a, 500).filter(pa.array([x != UND and s >= least and g >= least_gain for x, s, g in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def brute(word: str, pieces: dict[str, float]) -> float:
    """Log of the sum over all segmentations, one by one; for tests."""

    def total(rest: str) -> float:
        if not rest:
            return 1.0
        return sum(pieces[rest[:i]] * total(rest[i:]) for i in range(1, len(rest) + 1) if rest[:i] in pieces)

    return math.log(total("▁" + word))
