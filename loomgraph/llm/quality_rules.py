"""Operator 1: quality rules, base rules first and then boosted trees over document statistics."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.trees import Forest, fit_forest

SYMBOLS = "#*$%&|<>"
ONLY_SPACE = re.compile(r"[\x20\x09-\x0D]*\Z")
FEATURES = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
    "digit_share", "punct_share", "same_next_share", "top_word_share", "mean_line_words", "long_word_share",
]
#: more symbols, repeated lines, repeated windows or doubled words never raise the score
FALLING = {"symbol_share", "dup_line_share", "repeat_share", "same_next_share"}
MONOTONE = np.array([-1 if f in FALLING else 0 for f in FEATURES])
FIT_ROWS, FIT_CHARS = 12_000, 40_000_000


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of the whole text, and FEATURES."""
    text = common.as_text(text)
    words = common.words_of(text)
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0), [0.0] * len(FEATURES)
    space = sum(map(text.count, " \t\n\x0b\x0c\r"))
    chars = len(text) - space
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = sum((c - 1) for line, c in Counter(lines).items() if c > 1 and not ONLY_SPACE.match(line))
    repeats = 0
    if n >= 4:
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.fromiter(map(ids.__getitem__, words), np.int64, n)
        _, pair = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
        _, window, seen = np.unique(pair[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
        often = seen[window] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= often
        repeats = int(covered.sum())
        same, top, distinct = float((at[1:] == at[:-1]).mean()), float(np.bincount(at).max()) / n, len(ids) / n
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))[at]
        long = float((sizes > 20).mean())
    else:
        same, top, distinct, long = 0.0, 1 / n, len(set(words)) / n, 0.0
    upper = sum(map(str.isupper, text))
    digits = sum(map(text.count, "0123456789"))
    punct = sum(map(text.count, ".,;:!?"))
    return (n, chars, symbols, dup, repeats), [
        float(np.log1p(n)), chars / n, symbols / max(chars, 1), dup / len(lines), repeats / n, distinct,
        upper / max(chars, 1), digits / max(chars, 1), punct / max(chars, 1), same, top, n / len(lines), long,
    ]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def fit_rules(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Forest:
    """Fit on labels.quality of at most fit_rows rows and fit_chars characters; the driver gets statistics only."""
    rows = common.labelled_texts(documents, labels, ["quality"], fit_rows, fit_chars)

    def measure(batches):
        for b in batches:
            yield pd.DataFrame(
                {"doc_id": b.doc_id, "y": (b.quality > 0).astype("int32"), "x": [statistics(t)[1] for t in b.text]}
            )

    got = rows.select("doc_id", "text", "quality").mapInPandas(measure, "doc_id long, y int, x array<double>").toPandas()
    got = got.sort_values("doc_id")
    x = np.array(got.x.tolist(), float).reshape(-1, len(FEATURES))
    return fit_forest(x, got.y.to_numpy(float), MONOTONE)


def apply_rules(documents: DataFrame, forest: Forest, keep_at: float = 0.5) -> DataFrame:
    """One row per row of documents (doc_id, text): the base statistics, base_failed, quality_score and kept.

    kept is false where a base rule failed, else quality_score >= keep_at.  A null or empty text has no words, so
    it fails; repeated rows are scored one by one; a null doc_id is carried; other columns are not read.
    """
    common.small_batches(documents.sparkSession)

    def score(batches):
        def one(b):
            found = [statistics(t) for t in b.text]
            base = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
            p = forest.probability(np.array([f[1] for f in found]).reshape(-1, len(FEATURES)))
            failed = np.array([base_failed(r[0], r[4]) for r in base.tolist()], bool)
            out = pd.DataFrame({"doc_id": b.doc_id})
            for i, c in enumerate(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]):
                out[c] = base[:, i]
            return out.assign(base_failed=failed, quality_score=p, kept=~failed & (p >= keep_at))

        return common.frames(batches, one)

    return documents.select("doc_id", "text").mapInPandas(
        score,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, quality_score double, kept boolean",
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the trees' verdict on every document; fitted on the labelled rows of the same table."""
    documents = common.table(spark, sf_dir, "documents")
    return apply_rules(documents, fit_rules(documents, common.table(spark, sf_dir, "labels")))
