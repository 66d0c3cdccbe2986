"""Operator 2: toxicity by multiple-instance learning: noisy-or over sentence scores, trained from document labels."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common

BITS = 18
FIT_ROWS, FIT_CHARS = 12_000, 12_000_000
TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")
ENDS = ".!?\n"


def word_features(word: str, bits: int = BITS) -> list[int]:
    """Hashed features of a lower-cased word: itself, its first 3 to 6 and its last 4 characters."""
    parts = {f"w{word}", f"s{word[-4:]}", *(f"p{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n)}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for p in sorted(parts)]


@dataclass(frozen=True)
class SentenceModel:
    """P(sentence toxic) = sigmoid(bias + sum over its words of their features' weights)."""

    weights: np.ndarray
    bias: float


class Scorer:
    """Scores the sentences of a text; a sentence ends at . ! ? or a newline.  Word scores are cached per task."""

    def __init__(self, model: SentenceModel) -> None:
        self.model, self.known = model, {}

    def __call__(self, text: str) -> np.ndarray:
        """z of every sentence that has a word."""
        tokens = TOKEN.findall(text.lower())
        if len(self.known) > common.CACHE_LIMIT:
            self.known.clear()
        for t in set(tokens).difference(self.known):
            self.known[t] = np.nan if t[0] in ENDS else float(self.model.weights[word_features(t)].sum())
        z = np.fromiter(map(self.known.__getitem__, tokens), float, len(tokens))
        end = np.isnan(z)
        number = np.unique(np.cumsum(end)[~end], return_inverse=True)[1]
        return self.model.bias + np.bincount(number, z[~end]) if len(number) else np.zeros(0)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_noisy_or(
    vocabulary: list[str], token: np.ndarray, document: np.ndarray, sentence: np.ndarray, y: np.ndarray,
    bits: int = BITS, steps: int = 150, ridge: float = 1e-5, min_documents: int = 3,
) -> SentenceModel:
    """Full-batch Adam on the document log loss, where P(document) = 1 - prod over sentences of (1 - P(sentence)).

    token, document and sentence hold, for each word in order, its number in the vocabulary, its document and its
    sentence in that document.  Features in fewer than min_documents texts keep weight 0.  Weights are held at 0 or
    more: a word is evidence or nothing, so a long sentence of ordinary words cannot outweigh an offending one.
    Without both classes the model calls nothing toxic.
    """
    w = np.zeros(1 << bits)
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return SentenceModel(w, -8.0)
    # into flat arrays word by word: lists of all words' features would take most of the driver's memory
    flat, sizes = array("i"), np.empty(len(vocabulary), np.int32)
    for i, t in enumerate(vocabulary):
        found = word_features(t, bits)
        flat.extend(found)
        sizes[i] = len(found)
    of_word, feature = np.repeat(np.arange(len(vocabulary), dtype=np.int32), sizes), np.frombuffer(flat, np.int32)
    both, sent = np.unique(document.astype(np.int64) << 32 | sentence, return_inverse=True)
    sent = sent.astype(np.int32)
    doc_of = (both >> 32).astype(np.int32)
    n_words, n_sentences = len(vocabulary), len(both)
    in_docs = np.bincount(np.unique(token.astype(np.int64) * len(y) + document) // len(y), minlength=n_words)
    often = np.bincount(feature, in_docs[of_word], 1 << bits) >= min_documents
    of_word, feature = of_word[often[feature]], feature[often[feature]]
    used, col = np.unique(feature, return_inverse=True)
    u, bias = np.zeros(len(used)), -6.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        score = np.bincount(of_word, u[col], n_words)
        z = bias + np.bincount(sent, score[token], n_sentences)
        total = np.bincount(doc_of, softplus(z), len(y))
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
        dz = pull[doc_of] * sigmoid(z) / len(y)
        per_word = np.bincount(token, dz[sent], n_words)
        g = np.append(np.bincount(col, per_word[of_word], len(used)) + ridge * u, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        u, bias = np.maximum(u - move[:-1], 0), bias - move[-1]
    w[used] = u
    return SentenceModel(w, float(bias))


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows that may be learnt from: crc32 of the id as text is not a multiple of 5."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def fit_toxicity(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> SentenceModel:
    """Fit on at most fit_rows labelled rows and fit_chars characters of learnable rows."""
    rows = common.labelled_texts(documents, learnable(labels), ["toxic"], fit_rows, fit_chars)

    def features(batches):
        for b in batches:
            found = []
            for t in b.text:
                tokens = TOKEN.findall(t.lower())
                end = np.array([x[0] in ENDS for x in tokens], bool)
                number = np.unique(np.cumsum(end)[~end], return_inverse=True)[1]
                found.append(([x for x in tokens if x[0] not in ENDS], number.astype(np.int32)))
            yield pd.DataFrame(
                {"doc_id": b.doc_id, "y": (b.toxic > 0).astype("int32"), "words": [f[0] for f in found], "sents": [f[1] for f in found]}
            )

    got = rows.select("doc_id", "text", "toxic").mapInPandas(
        features, "doc_id long, y int, words array<string>, sents array<int>"
    ).toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    if not len(got):
        return fit_noisy_or([], np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0))
    words, sents = got["words"].combine_chunks(), got["sents"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    size = words.value_lengths().to_numpy(zero_copy_only=False)
    parts = (
        coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).copy(), np.repeat(np.arange(len(got), dtype=np.int32), size),
        sents.flatten().to_numpy(zero_copy_only=False).copy(), got["y"].to_numpy())
    del got, words, sents, coded
    common.give_back(documents.sparkSession)
    return fit_noisy_or(*parts)


def offending(text: str, scorer: Scorer, at_least: float) -> list[tuple[int, int, float]]:
    """(start, end, score) in characters of the sentences that score at_least or more."""
    spans, start = [], 0
    for m in re.finditer(r"[.!?\n]+|\Z", text):
        z = scorer(text[start : m.end()])
        if len(z) and (p := float(sigmoid(z.max()))) >= at_least:
            spans.append((start, m.end(), p))
        start = m.end()
    return spans


def score_toxicity(documents: DataFrame, model: SentenceModel, at: float = 0.5) -> DataFrame:
    """One row per row of documents (doc_id, text): score, predicted (1 if score >= at) and offending spans.

    A null or empty text has no sentence and scores 0; repeated rows are scored one by one; a null doc_id is
    carried; no other column is read.  spans lists (start, end, score) of sentences that alone reach `at`, or the
    highest one where only together they do.
    """
    common.small_batches(documents.sparkSession)

    def score(batches):
        scorer = Scorer(model)

        def one(b):
            scores, spans = np.zeros(len(b)), []
            for i, t in enumerate(b.text):
                t = common.as_text(t)
                z = scorer(t)
                scores[i] = -np.expm1(-softplus(z).sum())
                found = offending(t, scorer, min(at, float(sigmoid(z.max())) * (1 - 1e-9))) if scores[i] >= at else []
                spans.append([{"start": s, "end": e, "score": p} for s, e, p in found])
            return pd.DataFrame({"doc_id": b.doc_id, "score": scores, "predicted": (scores >= at).astype("int32"), "spans": spans})

        return common.frames(batches, one)

    return documents.select("doc_id", "text").mapInPandas(
        score, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"
    )


def toxicity_score(text: Column, model: SentenceModel) -> Column:
    """The score of a text column, row by row, for filters that keep all other columns where they are."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in parts:
            yield pd.Series([float(-np.expm1(-softplus(scorer(common.as_text(t))).sum())) for t in texts], dtype=float)

    return score(text)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learnt from labels that are not held out; a null id is never held out."""
    documents = common.table(spark, sf_dir, "documents")
    model = fit_toxicity(documents, common.table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_toxicity(documents, model).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")
