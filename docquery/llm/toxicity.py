"""Toxicity: a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed ones: of the whole lower-case word and
of its beginnings, so that inflected and compound forms share evidence.
Filters of several widths run over the whole text, each keeps its maximum, and
a logistic layer reads those.  Scores are shifted by a threshold for each
language, calibrated mostly on training rows set aside; the language is the one whose
word statistics (learned from the same rows) fit the text best, never a column.

Training takes a bounded sample: at most `per_class` ids of each label, chosen by
a seeded hash, and of each text the first `train_chars` characters.  Scoring reads every text whole.
Runs without white space above 40 characters are words by their letters, in pieces of up to 20, so that no word is long.

Defined cases: null and empty texts get the model's score for no words; rows
without a label, with a null id or of a held-out fold are never learned from;
of several rows with one id the text of least hash is learned from, its label being the largest given;
without rows of both labels every score is 0; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import learned_on, sample_per_group

BUCKETS = 1 << 17
#: Lengths of the beginnings of a word that have an embedding of their own.
BEGINNINGS = (3, 4, 5, 6, 7)
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSIONS = 12
#: Training texts that must have a feature for it to be learned: what one text has alone would be learned by heart.
LEAST_TEXTS = 3
#: Entries of a worker's table of known words; it is emptied when full.
CACHE = 150_000
_LETTERS = re.compile(r"[^\W\d_]+")
#: Longest run that is one word, and the pieces of longer ones.
_RUN = 40
_PIECES = re.compile(r"[^\W\d_]{1,20}")
_LANG_BUCKETS = 1 << 15


#: A language with fewer rows of either label shares the threshold of all.
LEAST_CALIBRATION = 6
#: Slope below zero, so that a filter that finds nothing still learns.
LEAK = 0.2


def _leak(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, LEAK * x)


def word_features(raw: str) -> list[int]:
    """Bucket numbers of a run of text between white space."""
    word = "".join(_LETTERS.findall(raw.lower()))
    return [zlib.crc32(word.encode()) % BUCKETS, *(zlib.crc32(word[:n].encode(), n) % BUCKETS for n in BEGINNINGS)]


@dataclass
class Model:
    """Weights; conv[k][o] maps an embedding at offset o to the filters of width k + 1."""

    embed: np.ndarray
    conv: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float = 0.0
    langs: list = field(default_factory=list)
    lang_fit: np.ndarray | None = None  # log likelihood by bucket and language
    shift: np.ndarray | None = None  # threshold by language, as a logit
    empty: bool = False

    @staticmethod
    def fresh(seed: int) -> Model:
        rng = np.random.default_rng(seed)
        conv = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype("f4") for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        embed = rng.normal(0, 0.05, (BUCKETS + 1, DIMENSIONS)).astype("f4")
        embed[BUCKETS] = 0  # of features that say nothing
        return Model(embed, conv, np.full(n, -0.1, "f4"), rng.uniform(0.2, 0.6, n).astype("f4"), -1.0)

    def project(self, features: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each offset: words x (sum of widths) x FILTERS."""
        x = self.embed[features].sum(axis=1)
        return np.concatenate([x @ c[o] for c in self.conv for o in range(len(c))], axis=1)

    def responses(self, parts: np.ndarray) -> np.ndarray:
        """Filter responses at each place; parts: project() of the words in text order, with len(WIDTHS) - 1 rows of padding behind each text."""
        n, at, out = len(parts), 0, []
        for width in WIDTHS:
            r = parts[:, at : at + FILTERS].copy()
            for o in range(1, width):
                r[: n - o] += parts[o:, at + o * FILTERS : at + (o + 1) * FILTERS]
            out.append(r)
            at += width * FILTERS
        return np.concatenate(out, axis=1)


_PAD = len(WIDTHS) - 1


class Words(dict):
    """Numbers words as they come; number 0 is the padding. Features of new words gather in one compact array."""

    def __init__(self):
        self.features = array("i")

    def __missing__(self, word: str) -> int:
        self.features.extend(word_features(word))
        n = self[word] = len(self) + 1
        return n

    def number(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if words and len(max(words, key=len)) > _RUN:
            words = [p for w in words for p in (_PIECES.findall(w) if len(w) > _RUN else (w,))]
        return np.array([*map(self.__getitem__, words), *[0] * _PAD], np.int32)

    def take_features(self) -> np.ndarray:
        """Features of the words that came since the last call, a row each."""
        rows = np.array(self.features, np.int32).reshape(-1, 1 + len(BEGINNINGS))
        self.features = array("i")
        return rows


def train(texts: list[str], labels: list[int], langs: list, *, weights: tuple[float, float], seed: int = 5, epochs: int = 10) -> Model:
    """Fit on four fifths of the rows, calibrate thresholds on the rest. weights: rows that a row of label 0 or 1 stands for."""
    y = np.array(labels, "f4")
    model = Model.fresh(seed)
    if len(set(labels)) < 2:
        model.empty = True
        return model
    words = Words()
    numbered = [words.number(x) for x in texts]
    features = np.concatenate([np.zeros((1, 1 + len(BEGINNINGS)), np.int32), words.take_features()])
    seen_in = np.zeros(BUCKETS + 1, np.int64)
    for seq in numbered:
        seen_in[np.unique(features[np.unique(seq)])] += 1
    every, features = features, np.where(seen_in[features] >= LEAST_TEXTS, features, BUCKETS)
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    aside[rng.permutation(len(y))[: len(y) // 5]] = len(y) >= 200
    fit = np.flatnonzero(~aside)
    by = [fit[y[fit] == c] for c in (0, 1)]
    most = max(map(len, by))
    batch = 32
    epochs = max(epochs, math.ceil(600 / max(1, 2 * most / batch)))
    sums = [np.full_like(p, 1e-4) for p in (*model.conv, model.bias, model.out)]
    embed_sum = np.full_like(model.embed, 1e-4)
    base_sum = 1e-4
    for epoch in range(epochs):
        rate = 0.15 * (1 - epoch / epochs) + 0.02
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(b), most) for b in by]))  # classes in equal parts
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            seqs = [numbered[r] for r in rows]
            ids = np.concatenate(seqs)
            uniq, inv = np.unique(ids, return_inverse=True)
            x = model.embed[features[uniq]].sum(axis=1)
            x[uniq == 0] = 0
            parts = np.concatenate([x @ c[o] for c in model.conv for o in range(len(c))], axis=1)[inv]
            resp = model.responses(parts)
            ends = np.cumsum([len(s) for s in seqs])
            places = np.stack([e - len(s) + resp[e - len(s) : e].argmax(axis=0) for e, s in zip(ends, seqs)])
            pooled = np.take_along_axis(resp, places, axis=0) + model.bias
            hidden = _leak(pooled)
            keep = rng.random(hidden.shape) > 0.2
            used = hidden * keep / 0.8
            p = 1 / (1 + np.exp(-(used @ model.out + model.base)))
            g = (p - y[rows]) / len(rows)
            dh = (g[:, None] * model.out * keep / 0.8) * np.where(pooled > 0, 1, LEAK)
            grads, dx = [], np.zeros_like(x)
            for k, (width, conv) in enumerate(zip(WIDTHS, model.conv)):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                d, where, gc = dh[:, cols], places[:, cols], np.zeros_like(conv)
                for o in range(width):
                    w = inv[np.minimum(where + o, len(inv) - 1)]
                    gc[o] = np.einsum("bf,bfd->df", d, x[w])
                    np.add.at(dx, w.ravel(), (d[:, :, None] * conv[o].T[None]).reshape(-1, DIMENSIONS))
                grads.append(gc)
            grads += [dh.sum(axis=0), used.T @ g]
            for p_, s_, g_ in zip((*model.conv, model.bias, model.out), sums, grads):
                s_ += g_ * g_
                p_ -= rate * g_ / np.sqrt(s_)
            np.maximum(model.out, 0, out=model.out)  # a filter is evidence for toxicity or none; nothing excuses what another found
            base_sum += float(g.sum()) ** 2
            model.base -= rate * float(g.sum()) / math.sqrt(base_sum)
            moved = np.flatnonzero(np.abs(dx).sum(axis=1) * (uniq > 0))
            spots = features[uniq[moved]].ravel()
            step = np.repeat(dx[moved], features.shape[1], axis=0).astype("f4")
            spots, step = spots[spots < BUCKETS], step[spots < BUCKETS]
            np.add.at(embed_sum, spots, step * step)
            np.subtract.at(model.embed, spots, rate * step / np.sqrt(embed_sum[spots]))

    model.embed[embed_sum[:, 0] <= np.float32(1e-4)] = 0  # never learned
    features = every
    _fit_languages(model, numbered, features, langs)
    logits, lang = _score(model, numbered, features)
    # rows set aside count four times, so that few of them in a language still outweigh what the fit has seen
    trust = np.where(aside, 4.0, 1.0) * np.where(y > 0, weights[1], weights[0])
    model.shift = np.full(max(1, len(model.langs)), _threshold(logits, y, trust), "f4")
    for k in range(len(model.langs)):
        own = lang == k
        if min(y[own].sum(), (1 - y[own]).sum()) >= LEAST_CALIBRATION:
            model.shift[k] = _threshold(logits[own], y[own], trust[own])
    return model


def _fit_languages(model: Model, numbered: list[np.ndarray], features: np.ndarray, langs: list) -> None:
    """Smoothed word frequencies by language."""
    model.langs = sorted({x for x in langs if x is not None})
    counts = np.full((_LANG_BUCKETS, max(1, len(model.langs))), 0.1)
    bucket = features[:, 0] % _LANG_BUCKETS
    for seq, lang in zip(numbered, langs):
        if lang is not None:
            np.add.at(counts[:, model.langs.index(lang)], bucket[seq[:-_PAD]], 1)
    model.lang_fit = np.log(counts / counts.sum(axis=0)).astype("f4")


def _threshold(logits: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The cut of least weighted error, where a row near the cut counts in part; so one odd row moves it little."""
    cuts = np.linspace(logits.min() - 2, logits.max() + 2, 600)
    wrong = 1 / (1 + np.exp(np.clip((logits[None, :] - cuts[:, None]) * np.where(y > 0, 1, -1), -30, 30)))
    return float(cuts[(wrong * weights).sum(axis=1).argmin()])


def _score(model: Model, numbered: list[np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logit, language number) of each text."""
    table = model.project(features)
    table[0] = 0
    fit = model.lang_fit[features[:, 0] % _LANG_BUCKETS]
    fit[0] = 0
    return _pool(model, numbered, table, fit)


def _pool(model: Model, numbered: list[np.ndarray], table: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    logits, langs = [], []
    at = 0
    while at < len(numbered):
        some, n = [], 0
        while at < len(numbered) and (not some or n + len(numbered[at]) < 30_000):  # places at once
            some.append(numbered[at])
            n += len(numbered[at])
            at += 1
        starts = np.cumsum([0, *map(len, some[:-1])])
        ids = np.concatenate(some)
        hidden = _leak(np.maximum.reduceat(model.responses(table[ids]), starts, axis=0) + model.bias)
        logits.append(hidden @ model.out + model.base)
        langs.append(np.add.reduceat(fit[ids], starts, axis=0).argmax(axis=1))
    return np.concatenate(logits), np.concatenate(langs)


class Scorer:
    """Scores texts with a table of known words."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.words, self.ready = Words(), 1
        n = sum(WIDTHS) * FILTERS
        self.table, self.fit = np.zeros((4096, n), "f4"), np.zeros((4096, len(self.model.langs) or 1), "f4")

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model.empty:
            return np.zeros(len(texts))
        if self.ready > CACHE:
            self.clear()
        numbered = [self.words.number(x) for x in texts]
        new = self.words.take_features()
        total = self.ready + len(new)
        if total > len(self.table):
            grow = lambda a: np.concatenate([a, np.zeros((max(total, 2 * len(a)) - len(a), a.shape[1]), "f4")])
            self.table, self.fit = grow(self.table), grow(self.fit)
        for k in range(0, len(new), 20_000):
            some = slice(self.ready + k, self.ready + min(len(new), k + 20_000))
            self.table[some] = self.model.project(new[k : k + 20_000])
            self.fit[some] = self.model.lang_fit[new[k : k + 20_000, 0] % _LANG_BUCKETS]
        self.ready = total
        logits, langs = _pool(self.model, numbered, self.table, self.fit)
        return 1 / (1 + np.exp(-np.clip(logits - self.model.shift[langs], -30, 30).astype(float)))


def fit(
    docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, train_chars: int = 65_536, folds: int = 5, held_out: int = 0, seed: int = 5,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic",
) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fold; the driver holds that sample only."""
    given = labels.where(learned_on(F.col(id_col), folds, held_out) & F.col(label_col).isin(0, 1))
    given = given.groupBy(id_col).agg(F.max(label_col).alias(label_col))
    counts = {r[0]: r[1] for r in given.groupBy(label_col).count().collect()}
    sample = sample_per_group(given, label_col, id_col, per_class, seed).select(F.col(id_col).alias("__id"), F.col(label_col).alias("y"))
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(sample), F.col("id") == F.col("__id"))  # at most 2 * per_class ids
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.left("text", F.lit(train_chars)).alias("text"), "lang")).alias("m")
    rows = sorted(rows.groupBy("id", "y").agg(one).select("id", "y", "m.text", "m.lang").collect(), key=lambda r: r.id)
    y = [r.y for r in rows]
    weights = tuple(counts.get(c, 0) / max(1, y.count(c)) for c in (0, 1))
    return train([r.text for r in rows], y, [r.lang for r in rows], weights=weights, seed=seed)


def score(text: Column, model: Model) -> Column:
    """Probability-like score of each whole text; 0.5 is the calibrated threshold."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series(np.concatenate([scorer(texts.iloc[a : a + 256].tolist()) for a in range(0, len(texts), 256)] or [np.zeros(0)]))

    return scores(text)


def score_documents(docs: DataFrame, model: Model, *, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs."""
    out = docs.select(
        F.col(id_col).alias("doc_id"), (~learned_on(F.col(id_col), folds, held_out)).alias("held_out"), score(F.col(text_col), model).alias("score")
    )
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
