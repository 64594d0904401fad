"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line is described by counts over its own characters and
words and by the same counts of the lines before and after it; the chain adds weights for
the labels of two lines in a row. Forward and backward passes give each line its chance of
being bad; their mean, weighted by line length, is the quality of the document, brought to
a probability by a logistic curve.

Training knows labels of documents only. Lines take the label of their document; after a
first fit, lines of bad documents that the chain finds good are taken as good, and the chain is
fitted once more. It uses at most ``TRAIN_ROWS`` labelled documents of at most ``TRAIN_CHARS``
characters (chosen by hash); scoring reads every document whole.

Defined results: a null text counts as empty; an empty text is one empty line; a document
without an id is scored and never trained on; repeated rows get equal scores; an empty table
gives an empty table; with no usable labels, or one class only, every score is 0.5. Very long
texts are cut into lines by the batch, with memory in proportion to the text. Columns
other than the id and the text are carried or left, never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcount.llm.common import add_columns, text_of, texts

TRAIN_ROWS = 4000
TRAIN_CHARS = 60_000
# Characters whose lines are described at once.
CHARS_AT_ONCE = 1_000_000

NEWLINE, SPACE, LOWER, UPPER, DIGIT, STOP, SHOUT, BAR, SYMBOL = range(9)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each character of the basic plane; the last entry is for all beyond it."""
    table = np.full(65537, SYMBOL, dtype=np.uint8)
    for code in range(65536):
        kind = unicodedata.category(chr(code))
        if kind in ("Lu", "Lt"):
            table[code] = UPPER
        elif kind[0] in "LM":
            table[code] = LOWER
        elif kind == "Nd":
            table[code] = DIGIT
        elif kind[0] == "Z" or code in (9, 11, 12, 13):
            table[code] = SPACE
    for char in ".,;:'\"-()?":
        table[ord(char)] = STOP
    table[ord("!")], table[ord("|")], table[10] = SHOUT, BAR, NEWLINE
    return table


def own_features(block: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, characters of each line, lines of each text)."""
    joined = "\n".join(block) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = char_classes()[np.minimum(code, 65536)]
    ends = np.flatnonzero(kind == NEWLINE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    lines = np.fromiter((t.count("\n") + 1 for t in block), dtype=np.int64, count=len(block))
    count = len(ends)
    line = np.repeat(np.arange(count), length + 1)
    by_class = np.bincount(line * 9 + kind, minlength=9 * count).reshape(count, 9).astype(np.float64)

    inside = kind > SPACE
    begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    words = np.bincount(line[begin], minlength=count).astype(np.float64)
    alike = np.zeros((4, count))
    same_line = np.zeros(count)
    if len(begin):
        word = np.cumsum(np.bincount(begin, minlength=len(code))) - 1
        place = np.arange(len(code)) - begin[np.maximum(word, 0)]
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
            value = np.where(inside, (code.astype(np.uint64) + np.uint64(7)) * powers[np.maximum(place, 0)], np.uint64(0))
            hashed = np.add.reduceat(value, begin)
        of_line = line[begin]
        for lag in range(1, 5):
            if len(begin) > lag:
                same = (hashed[lag:] == hashed[:-lag]) & (of_line[lag:] == of_line[:-lag])
                alike[lag - 1] = np.bincount(of_line[lag:][same], minlength=count)
        with np.errstate(over="ignore"):
            total = np.zeros(count, dtype=np.uint64)
            np.add.at(total, of_line, hashed)
        same_line[1:] = (total[1:] == total[:-1]) & (words[1:] > 0)
        same_line[np.cumsum(lines) - lines] = 0
    size = np.maximum(length, 1)
    many = np.maximum(words, 1)
    letters = by_class[:, LOWER] + by_class[:, UPPER]
    features = np.column_stack(
        [
            by_class[:, UPPER] / np.maximum(letters, 1),
            by_class[:, SYMBOL] / size * 4,
            by_class[:, SHOUT] / size * 4,
            by_class[:, BAR] / size * 8,
            by_class[:, DIGIT] / size,
            by_class[:, STOP] / size * 4,
            by_class[:, SPACE] / size,
            (by_class[:, UPPER] > 0.7 * letters) & (letters > 3),
            by_class[:, SYMBOL] > 0.5 * many,
            by_class[:, BAR] > 0.25 * many,
            alike[0] / many,
            alike[1:].max(axis=0) / many,
            alike[0] > 2,
            same_line,
            np.minimum(np.log1p(length) / 8, 1.5),
            length == 0,
            np.minimum(letters / many / 12, 2),
            words < 4,
        ]
    )
    return features, length.astype(np.float64), lines


def line_features(block: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``own_features``, with the features of the neighbouring lines beside each line's own."""
    own, length, lines = own_features(block)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(lines)
    first, last = ends - lines, ends - 1
    edge = np.zeros((len(own), 2))
    before[first], after[last] = 0, 0
    edge[first, 0], edge[last, 1] = 1, 1
    return np.hstack([own, before, after, edge, np.ones((len(own), 1))]), length, lines


@dataclass
class Chain:
    """Weights of a fitted chain; ``step[i, j]`` is for label j after label i (1: bad)."""

    weights: np.ndarray
    step: np.ndarray
    curve: tuple[float, float]


class Steps:
    """Order in which the lines of many texts are walked side by side."""

    def __init__(self, lines: np.ndarray) -> None:
        self.order = np.argsort(-lines, kind="stable")
        self.lines = lines[self.order]
        self.first = (np.cumsum(lines) - lines)[self.order]
        self.active = np.searchsorted(-self.lines, -np.arange(int(self.lines[0]) if len(lines) else 0), "left")

    def forward(self, odds: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log odds of bad given all lines up to each line."""
        out = odds.copy()
        for t in range(1, len(self.active)):
            at = self.first[: self.active[t]] + t
            out[at] += passed(out[at - 1], step)
        return out

    def backward(self, odds: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log odds that the lines after each line add."""
        out = np.zeros_like(odds)
        for t in range(len(self.active) - 1, 0, -1):
            at = self.first[: self.active[t]] + t
            out[at - 1] = passed(out[at] + odds[at], step.T)
        return out


def passed(odds: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Log odds of the next label, from the log odds of this one."""
    return np.logaddexp(step[0, 1], odds + step[1, 1]) - np.logaddexp(step[0, 0], odds + step[1, 0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def badness(chance: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Mean chance of each text, by length of its lines (each line counts one more character)."""
    first = np.cumsum(lines) - lines
    return np.add.reduceat(chance * (length + 1), first) / np.add.reduceat(length + 1, first)


def fit(documents: list[str], good: np.ndarray, turns: int = 120) -> Chain | None:
    """Fit the chain on whole texts and their labels (1: good)."""
    if len(documents) == 0 or good.min() == good.max():
        return None
    x, length, lines = (np.concatenate(part) for part in zip(*map(line_features, blocks(documents)), strict=True))
    of = np.repeat(np.arange(len(lines)), lines)
    bad_share = 1 - good.mean()
    weight = np.where(good == 1, 0.5 / (1 - bad_share), 0.5 / bad_share)[of] / lines[of] / len(lines)
    label = (1.0 - good)[of]
    steps = Steps(lines)
    w, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    pair = np.flatnonzero(of[1:] == of[:-1])
    for stage in range(2):
        moment = np.zeros(len(w) + 4)
        square = np.zeros(len(w) + 4)
        for turn in range(1, turns + 1):
            odds = x @ w
            ahead, behind = steps.forward(odds, step), steps.backward(odds, step)
            chance = sigmoid(ahead + behind)
            slope = x.T @ (weight * (label - chance)) - 1e-4 * w
            joint = np.stack(
                [
                    i * ahead[pair] + step[i, j] + j * (odds[pair + 1] + behind[pair + 1])
                    for i in (0, 1)
                    for j in (0, 1)
                ]
            )
            joint = np.exp(joint - joint.max(axis=0))
            joint /= joint.sum(axis=0)
            seen = np.stack([(label[pair] == i) & (label[pair + 1] == j) for i in (0, 1) for j in (0, 1)])
            steps_slope = ((seen - joint) * weight[pair]).sum(axis=1) - 1e-4 * step.ravel()
            g = np.concatenate([slope, steps_slope])
            moment = 0.9 * moment + 0.1 * g
            square = 0.99 * square + 0.01 * g * g
            move = 0.15 * (moment / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
            w += move[:-4]
            step += move[-4:].reshape(2, 2)
        odds = x @ w
        chance = sigmoid(steps.forward(odds, step) + steps.backward(odds, step))
        if stage == 0:
            label = np.where((good[of] == 0) & (chance < 0.35), 0.0, label)
    z = spot(badness(chance, length, lines))
    a, b = 0.0, -1.0
    for _ in range(60):
        p = sigmoid(a + b * z)
        v = p * (1 - p) + 1e-6
        g = np.array([(good - p).sum() - 1e-2 * a, ((good - p) * z).sum() - 1e-2 * (b + 1)])
        h = np.array([[v.sum() + 1e-2, (v * z).sum()], [(v * z).sum(), (v * z * z).sum() + 1e-2]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    return Chain(w, step, (float(a), float(b)))


def spot(mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def blocks(documents: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``CHARS_AT_ONCE`` characters."""
    held: list[str] = []
    size = 0
    for text in documents:
        if held and size + len(text) > CHARS_AT_ONCE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def scores(chain: Chain | None, documents: list[str]) -> np.ndarray:
    """Chance of label 1 of each text."""
    out = np.full(len(documents), 0.5)
    if chain is None:
        return out
    at = 0
    for block in blocks(documents):
        to = at + len(block)
        x, length, lines = line_features(block)
        odds = x @ chain.weights
        steps = Steps(lines)
        chance = sigmoid(steps.forward(odds, chain.step) + steps.backward(odds, chain.step))
        out[at:to] = sigmoid(chain.curve[0] + chain.curve[1] * spot(badness(chance, length, lines)))
        at = to
    return out


def remainder(doc_id: str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % by


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_in: Column, rows: int, chars: int) -> list:
    """At most ``rows`` labelled texts of at most ``chars`` characters, chosen by hash of the id."""
    known = (
        labels.where(F.col(label).isin(0, 1) & held_in)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )
    short = docs.select(F.col("doc_id").alias("__id"), text_of().alias("__text"))
    # At most ``rows`` ids are broadcast.
    found = short.where(F.length("__text") <= chars).join(F.broadcast(known), "__id").limit(rows)
    return sorted(found.collect(), key=lambda r: (str(r["__id"]), r["__text"]))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Chain | None:
    """Fit on labelled rows whose crc32 of the id has a remainder by 3 other than 1."""
    sample = labelled(docs, labels, "quality", remainder("doc_id", 3) != 1, rows, chars)
    return fit([r["__text"] for r in sample], np.array([r["__label"] for r in sample], dtype=np.float64))


def score(docs: DataFrame, chain: Chain | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every text; no shuffle."""

    def compute(batch: pa.RecordBatch) -> list:
        return [pa.array(scores(chain, texts(batch, text)))]

    return add_columns(docs, [(out, T.DoubleType())], compute)


def keep_good(docs: DataFrame, chain: Chain | None, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score below ``least``."""
    return score(docs, chain, out="__score").where(F.col("__score") >= least).select(*docs.columns)
