"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine.

Examples are at most ``EXAMPLES`` labelled documents (chosen by hash of the id); a bound on what
is sent to every task. Terms are words and the beginnings of longer words. The vocabulary is all
terms of the examples. How many documents hold each term is counted over the whole corpus,
summed in every task before the counts meet. Weights are (1 + ln tf) (ln((N + 1) / (df + 1)) + 1),
which is above zero however many copies a text has, times one plus ``STRENGTH`` times the
correlation of the term and the label among the examples; texts are unit vectors over the vocabulary.

Every document is a query, and its cosines with all examples are computed: those of terms that
many examples hold by a matrix product over some documents at once, the others by their lists of
examples. So the k nearest are exact (ties go to the lower place in the index).

The k nearest vote with the weight of their closeness. A logistic curve, fitted to votes on
the examples themselves, each without itself and its equal texts, makes the vote a probability.

Defined results: a null or blank text, and one with no term of the vocabulary, has no neighbour and
gets the curve's value for an even share of examples; equal texts get equal scores; an empty table
gives an empty table; with no usable labels or one class only, every score is that class's share
(0.5 with none). Texts are read whole. Other columns are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from snapcount.llm.common import add_columns, text_of, texts
from snapcount.llm.decontam import spans_of
from snapcount.llm.quality import labelled, remainder, sigmoid
from snapcount.session import ship_package

EXAMPLES = 4000
EXAMPLE_CHARS = 60_000
# How much the correlation of a term and the label adds to the term's weight: of 0, 10, 40 and 100 the one with the
# least log loss on learning rows alone, each scored without itself and its equals (0.156, 0.047, 0.060, 0.062).
STRENGTH = 10.0
NEIGHBOURS = 31
# Share of the examples from which on a term's weights are a row of the matrix.
DENSE = 0.05
# Documents, and terms of documents, whose cosines are computed at once; bounds the memory of a task.
AT_ONCE = 256
TERMS_AT_ONCE = 1 << 17
# Words whose places a task remembers; bounds its memory, others are looked up again.
KNOWN_WORDS = 400_000
BEGINNINGS = (5, 7)
WORD = re.compile(r"\w+")
EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
ARROW_EVIDENCE = to_arrow_schema(T.StructType([T.StructField("evidence", EVIDENCE)])).field(0).type


def counts(text: str) -> Counter:
    """Terms of a text: its words, and the beginnings of longer words."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        found[word] += n
        for size in BEGINNINGS:
            if len(word) > size:
                found[word[:size] + "-"] += n
    return found


class KnownWords(dict):
    """Places of the terms that a word is or begins with; the first ``KNOWN_WORDS`` words are remembered."""

    def __init__(self, by: list[dict[str, int]]) -> None:
        super().__init__()
        self.by = by

    def __missing__(self, word: str) -> tuple[int, ...]:
        whole, *begun = self.by
        found = [whole[word]] if word in whole else []
        for size, starts in zip(BEGINNINGS, begun):
            if len(word) <= size:
                break
            if (start := word[:size]) in starts:
                found.append(starts[start])
        places = tuple(found)
        if len(self) < KNOWN_WORDS:
            self[word] = places
        return places


class Vocabulary:
    """Places of terms, looked up without making the terms of a text."""

    def __init__(self, terms: list[str]) -> None:
        self.size = len(terms)
        self.by = [{} for _ in range(1 + len(BEGINNINGS))]
        for i, term in enumerate(terms):
            at = 1 + BEGINNINGS.index(len(term) - 1) if term.endswith("-") else 0
            self.by[at][term.rstrip("-")] = i
        # Only a shorter way to the same places.
        self.known = KnownWords(self.by)

    def held(self, text: str) -> np.ndarray:
        """Terms of the vocabulary that are in the text; a term may come more than once (as an index it adds once)."""
        places = map(self.known.__getitem__, set(WORD.findall(text.lower())))
        return np.fromiter(chain.from_iterable(places), dtype=np.int64)

    def found(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms, how often each is in the text) of the vocabulary's terms in the text, in their order."""
        words = Counter(WORD.findall(text.lower()))
        places = [self.known[w] for w in words]
        times = np.repeat(
            np.fromiter(words.values(), dtype=np.int64, count=len(words)),
            np.fromiter(map(len, places), dtype=np.int64, count=len(words)),
        )
        terms, at = np.unique(np.fromiter(chain.from_iterable(places), dtype=np.int64), return_inverse=True)
        return terms, np.bincount(at, times, minlength=len(terms))

    def __getstate__(self) -> dict:
        return {"size": self.size, "by": self.by}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"known": KnownWords(state["by"])}


@dataclass
class Index:
    """Examples by term, and what turns votes into scores."""

    vocabulary: Vocabulary
    term_weight: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    same: np.ndarray
    # Term w is held by example[post_at[w]:post_at[w + 1]], with these weights.
    post_at: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)
    # Rows of the terms that many examples hold, and the row of each term (-1: none); made where it is used.
    matrix: np.ndarray | None = None
    row: np.ndarray | None = None

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(words, weights) of a text as a unit vector."""
        words, tf = self.vocabulary.found(text)
        weight = (1 + np.log(tf)) * self.term_weight[words]
        norm = np.sqrt((weight * weight).sum())
        return words, weight / norm if norm else weight

    def fill(self) -> None:
        held = np.diff(self.post_at)
        often = np.flatnonzero(held > DENSE * len(self.ids))
        self.row = np.full(len(held), -1)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), len(self.ids)))
        at = spans_of(self.post_at[often], held[often])
        self.matrix[np.repeat(np.arange(len(often)), held[often]), self.example[at]] = self.weight[at]

    def cosines(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Cosine of each vector with each example; rounded, so that equal texts tie."""
        if self.matrix is None:
            self.fill()
        words = np.concatenate([w for w, _ in vectors])
        weight = np.concatenate([v for _, v in vectors])
        query = np.repeat(np.arange(len(vectors)), [len(w) for w, _ in vectors])
        row = self.row[words]
        often = row >= 0
        asked = np.zeros((len(vectors), len(self.matrix)))
        asked[query[often], row[often]] = weight[often]
        found = asked @ self.matrix
        words, weight, query = words[~often], weight[~often], query[~often]
        size = self.post_at[words + 1] - self.post_at[words]
        at = spans_of(self.post_at[words], size)
        place = np.repeat(query * len(self.ids), size) + self.example[at]
        found += np.bincount(place, self.weight[at] * np.repeat(weight, size), minlength=found.size).reshape(found.shape)
        return np.round(found, 12)

    def nearest(self, words: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None = None):
        """(examples, cosines) of the ``k`` nearest with a cosine above zero, nearest first."""
        return self.best(self.cosines([(words, weight)])[0], k, skip)

    def best(self, cosine: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        if skip is not None:
            cosine[skip] = 0
        least = np.partition(cosine, -k)[-k] if len(cosine) > k else 0.0
        best = np.flatnonzero((cosine >= least) & (cosine > 0))
        best = best[np.argsort(-cosine[best], kind="stable")][:k]
        return best, cosine[best]

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the toxic share among the nearest, weighted by closeness."""
        prior = (self.label.sum() + 0.5) / (len(self.label) + 1)
        closeness = cosine * cosine / (1.05 - np.minimum(cosine, 1))
        if len(best):
            closeness = closeness / max(closeness.max(), 1e-12)
        toxic = float(closeness @ self.label[best]) + 0.5 * prior
        return float(np.log(toxic / (closeness.sum() + 0.5 - toxic)))

    def judge(self, documents: list[str]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(score, examples, cosines) of each text."""
        a, b = self.curve
        vectors, held = [], 0
        for i, text in enumerate(documents, 1):
            vectors.append(self.vector(text))
            held += len(vectors[-1][0])
            if len(vectors) < AT_ONCE and held < TERMS_AT_ONCE and i < len(documents):
                continue
            for cosine in self.cosines(vectors):
                best, near = self.best(cosine, NEIGHBOURS)
                yield float(sigmoid(np.array(a + b * self.vote(best, near)))), best, near
            vectors, held = [], 0


def vocabulary_of(rows: list[tuple[int, str, int]]) -> list[str]:
    """All terms of (id, text, label) examples."""
    terms: set[str] = set()
    for _, text, _ in rows:
        terms.update(counts(text))
    return sorted(terms)


def association(held: np.ndarray, toxic: np.ndarray, n: int, bad: float) -> np.ndarray:
    """Size of the correlation with the label of terms that ``held`` examples hold, ``toxic`` of them toxic."""
    spread = held * (1 - held / n) * bad * (1 - bad / n)
    return np.abs(toxic - held * bad / n) / np.sqrt(np.where(spread > 0, spread, np.inf))


def build(rows: list[tuple[int, str, int]], df: dict[str, int], total: int) -> Index:
    """Index of (id, text, label) examples; ``df`` and ``total`` are counted over all documents."""
    terms = sorted(df)
    vocabulary = Vocabulary(terms)
    rows = sorted(rows, key=lambda r: (-r[2], r[1][:1], len(r[1]), r[0]))
    first: dict[str, int] = {}
    same = np.array([first.setdefault(t, i) for i, (_, t, _) in enumerate(rows)], dtype=np.int64)
    label = np.array([r[2] for r in rows], dtype=np.float64)
    held, toxic = np.zeros(len(terms)), np.zeros(len(terms))
    for (_, text, _), bad in zip(rows, label, strict=True):
        places = vocabulary.held(text)
        held[places] += 1
        toxic[places] += bad
    counted = np.array([df[t] for t in terms], dtype=np.float64)
    term_weight = (np.log((total + 1) / (counted + 1)) + 1) * (1 + STRENGTH * association(held, toxic, len(rows), label.sum()))
    index = Index(vocabulary, term_weight, np.array([r[0] for r in rows]), label, same, *(np.zeros(0, np.int64),) * 3)
    vectors = [index.vector(t) for _, t, _ in rows]
    vocabulary.known.clear()
    word = np.concatenate([w for w, _ in vectors])
    example = np.repeat(np.arange(len(rows)), [len(w) for w, _ in vectors])
    weight = np.concatenate([v for _, v in vectors])
    order = np.argsort(word, kind="stable")
    index.post_at = np.searchsorted(word[order], np.arange(len(terms) + 1))
    index.example, index.weight = example[order].astype(np.int32), weight[order]
    del word, example, weight, order
    votes = []
    for start in range(0, len(rows), AT_ONCE):
        for i, cosine in enumerate(index.cosines(vectors[start : start + AT_ONCE]), start):
            votes.append(index.vote(*index.best(cosine, NEIGHBOURS, np.flatnonzero(same == same[i]))))
    index.curve = logistic(np.array(votes), label)
    index.matrix = index.row = None
    return index


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 0.0, 1.0
    for _ in range(60):
        p = sigmoid(a + b * z)
        v = p * (1 - p) + 1e-6
        g = np.array([(y - p).sum() - 1e-2 * a, ((y - p) * z).sum() - 1e-2 * (b - 1)])
        h = np.array([[v.sum() + 1e-2, (v * z).sum()], [(v * z).sum(), (v * z * z).sum() + 1e-2]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    return float(a), float(b)


def document_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """How many documents hold each word of the vocabulary, and how many documents there are."""
    ship_package(docs.sparkSession)
    terms = Vocabulary(vocabulary)
    size = terms.size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held[-1] += 1
                held[terms.held(text)] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["w", "n"])

    summed = docs.select(text_of().alias("t")).mapInArrow(each, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    found, counted = summed.toArrow(), np.zeros(size + 1, dtype=np.int64)
    counted[found["w"].to_numpy()] = found["n"].to_numpy()
    return dict(zip(vocabulary, counted[:size].tolist(), strict=True)), int(counted[size])


def fit_on(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index | float:
    """Index of labelled rows whose crc32 of the id is not divisible by 5; a share if one class is missing."""
    sample = labelled(docs, labels, "toxic", remainder("doc_id", 5) != 0, examples, EXAMPLE_CHARS)
    rows = [(r["__id"], r["__text"], r["__label"]) for r in sample]
    classes = {y for _, _, y in rows}
    if len(classes) < 2:
        return float(classes.pop()) if classes else 0.5
    df, total = document_counts(docs, vocabulary_of(rows))
    return build(rows, df, total)


def score(docs: DataFrame, index: Index | float, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``evidence`` (the nearest examples); no shuffle."""

    def compute(batch: pa.RecordBatch) -> list:
        documents = texts(batch, text)
        if isinstance(index, float):
            return [[index] * len(documents), [[] for _ in documents]]
        place: dict[str, int] = {}
        places = np.array([place.setdefault(t, len(place)) for t in documents], dtype=np.int64)
        judged = list(index.judge(list(place)))
        if not judged:
            return [[], []]
        listed = np.cumsum([0, *(len(best) for _, best, _ in judged)])
        best = np.concatenate([best for _, best, _ in judged])
        cosine = np.concatenate([cosine for _, _, cosine in judged])
        parts = [index.ids[best], index.label[best], cosine]
        near = pa.StructArray.from_arrays(
            [pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(parts, ARROW_EVIDENCE.value_type, strict=True)],
            fields=list(ARROW_EVIDENCE.value_type),
        )
        evidence = pa.ListArray.from_arrays(pa.array(listed, pa.int32()), near, type=ARROW_EVIDENCE)
        return [pa.array(np.array([p for p, _, _ in judged])[places]), evidence.take(pa.array(places))]

    return add_columns(docs, [("score", T.DoubleType()), ("evidence", EVIDENCE)], compute)
