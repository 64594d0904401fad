"""Arrow UDFs for the gestalt similarity ratio, which Spark does not have."""

from __future__ import annotations

import re
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from math import floor

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcount import constants as C

# Agreement is summed in whole billionths, so that the order and the number of
# reads cannot change a sum. (A plain loop over floats may break near ties otherwise.)
UNIT = 1_000_000_000
TOKEN_BONUS = 3 * UNIT // 2
LETTER_BONUS = 3 * UNIT // 100


@lru_cache(maxsize=1 << 16)
def ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio()


def units(value: float) -> int:
    return floor(value * UNIT + 0.5)


@lru_cache(maxsize=1 << 14)
def normalized(text: object) -> str:
    return re.sub(r"[^A-Z0-9]+", " ", str(text).upper()).strip()


def best_supported(reads: Sequence[str | None]) -> str | None:
    """The read that agrees most with all reads; ties: longer, then earlier."""
    texts = [t for t in (normalized(r) for r in reads if r not in (None, "")) if t]
    if not texts:
        return None
    distinct = list(dict.fromkeys(texts))
    if len(distinct) == 1:
        return distinct[0]
    squeezed = {text: text.replace(" ", "") for text in distinct}
    counts = dict.fromkeys(distinct, 0)
    for text in texts:
        counts[text] += 1

    def agreement(text: str) -> int:
        near = sum(units(ratio(squeezed[text], squeezed[o])) * n for o, n in counts.items())
        tokens = sum(word in C.CONSENSUS_TOKENS for word in text.split())
        return near + tokens * TOKEN_BONUS + min(len(text), 24) * LETTER_BONUS

    return max(distinct, key=lambda text: (agreement(text), len(text)))


@F.pandas_udf(T.DoubleType())
def seq_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if a is None or b is None else ratio(a, b)
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


@F.pandas_udf(T.StringType())
def text_consensus(reads: pd.Series) -> pd.Series:
    return reads.map(lambda r: None if r is None else best_supported(list(r)))


def refold(first: str | None, reads: Sequence[str]) -> str | None:
    """Pairwise re-vote from left to right, as summaries are merged one by one."""
    best = first
    for read in reads:
        best = best_supported([best, read])
    return best


@F.pandas_udf(T.StringType())
def merged_text(reads: pd.Series, rows: pd.Series) -> pd.Series:
    """Text of a merged group; a group of one row keeps its text as it is."""

    def merged(texts, count):
        texts = [] if texts is None else list(texts)
        if count == 1:
            return texts[0] if texts else None
        return refold(None, texts)

    return pd.Series([merged(t, n) for t, n in zip(reads, rows)], dtype=object)
