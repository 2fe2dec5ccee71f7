"""Reading level of the English prose of each document, on the scale of graded samples.

Method. Every sentence gets a distribution over levels from a regularised softmax model whose features are
its words, the character n-grams of its words and its length; a document's expected level is the mean over
its sentences, weighted by words, and cut points calibrated on held-out folds of the samples turn it into a
level. Word and n-gram weights fold into one score vector per distinct word, which workers cache, so scoring
is one table look-up per word.

The model is fitted on at most ``max_samples`` labelled rows (the samples are a small fixed table), each fold in
a task of its own, on sparse features; all documents are scored.

Defined results: front matter, headings, code, tables and time stamps are no prose; text is English where
English function words dominate, whatever a language column says; documents with under ``least_words`` such
words (also null and empty texts) have no level; without samples of two levels there is no result.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convograph.llm.pairs import FUNCTION_WORDS
from convograph.sources.exports import table

LEAST_WORDS = 60
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_FRONT = re.compile(r"\A\s*---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_CODE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*\r?$|\Z)")
_LINES = re.compile(r"(?m)^[ \t]*(?:#{1,6}[ \t].*|\|.*|[-=*_ ]{3,}|\d{4}-\d\d-\d\d[T ][\d:.,]+\S*.*|>[ \t]*\[!.*)$")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]")
_BREAK = re.compile(r"\n[ \t\r]*\n|\n(?=[-*•] |\d+[.)] )")
_STOP = "\x00"
_END = re.compile(r"[.!?…][\"'”’)\]*_]*$")
_ENGLISH = frozenset(FUNCTION_WORDS["en"].split()) | frozenset("one while although since whenever whereas insofar may might must could cannot after near across within during between because then now out up them their its over no some any all".split())
_FOREIGN = frozenset(w for k, v in FUNCTION_WORDS.items() if k != "en" for w in v.split()) - _ENGLISH


def prose(text: str) -> str:
    """The text without front matter, code, headings, tables and link markup."""
    t = text
    if "---" in t:
        t = _FRONT.sub("", t)
    if "```" in t or "~~~" in t:
        t = _CODE.sub("\n\n", t)
    if "\n" in t or t[:1] in "#|":
        t = _LINES.sub("\n", t)
    return _LINK.sub(r"\1", t) if "[[" in t else t


def tokens(text: str) -> list[str]:
    """Stretches between white space, with ``_STOP`` where a paragraph or list item ends."""
    return _BREAK.sub(f" {_STOP} ", prose(text).lower()).split()


def token_words(token: str) -> list[str]:
    """Words of one stretch; addresses, links and code have none."""
    return [] if "@" in token or "://" in token or "`" in token else _WORD.findall(token)


def ends_sentence(token: str) -> bool:
    return token == _STOP or bool(_END.search(token))


def sentences(text: str) -> list[list[str]]:
    """Words (lower case) of each sentence of the prose."""
    out, now = [], []
    for t in tokens(text):
        now += token_words(t)
        if ends_sentence(t) and now:
            out.append(now)
            now = []
    return out + [now] if now else out


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


def _length_features(n_words: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Sentence length and mean word length, scaled to about 0 to 1, with their squares."""
    a, b = np.minimum(n_words, 80) / 40, letters / np.maximum(n_words, 1) / 10
    return np.stack([a, a * a, b, b * b], axis=1)


class LevelModel:
    """Softmax over levels per sentence, and cut points on a document's expected level."""

    def __init__(self, levels: list[int], weights: dict[str, np.ndarray], lengths: np.ndarray, bias: np.ndarray, cuts: list[float] | None = None) -> None:
        self.levels, self.weights, self.lengths, self.bias, self.cuts = levels, weights, lengths, bias, cuts or []

    def word(self, word: str) -> np.ndarray:
        """Score of one word: its own weight and the mean of its n-grams' weights."""
        zero, grams = np.zeros(len(self.levels)), _grams(word)
        return self.weights.get("w:" + word, zero) + sum((self.weights.get("g:" + g, zero) for g in grams), zero) / len(grams)

    def distributions(self, scores: np.ndarray, n_words: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Level distribution of each sentence from the summed scores of its words."""
        z = scores / np.maximum(n_words, 1)[:, None] + _length_features(n_words, letters) @ self.lengths + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def level(self, expected: float) -> int:
        return self.levels[sum(expected >= c for c in self.cuts)]


class Sparse:
    """Sentences × features: the non-zero values by row and by column, and up to ``DENSE`` cells a plain matrix too (faster, same sums)."""

    DENSE = 20_000_000

    def __init__(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, shape: tuple[int, int]) -> None:
        flat, inverse = np.unique(rows.astype(np.int64) * shape[1] + cols, return_inverse=True)
        self.shape, self.vals = shape, np.bincount(inverse, vals).astype(np.float32)
        self.rows, self.cols = flat // shape[1], flat % shape[1]
        self.by_col, self.dense = np.argsort(self.cols, kind="stable"), None
        if shape[0] * shape[1] <= self.DENSE:
            self.dense = np.zeros(shape, np.float32)
            self.dense[self.rows, self.cols] = self.vals

    @staticmethod
    def _sums(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        """Sums of rows of ``values`` per key; ``keys`` ascend."""
        out = np.zeros((n, values.shape[1]), np.float32)
        if len(keys):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            out[keys[starts]] = np.add.reduceat(values, starts, axis=0)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ w
        return self._sums(self.vals[:, None] * w[self.cols], self.rows, self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense.T @ g
        at = self.by_col
        return self._sums(self.vals[at, None] * g[self.rows[at]], self.cols[at], self.shape[1])

    def part(self, keep: np.ndarray) -> Sparse:
        """The rows that ``keep`` marks."""
        inside, place = keep[self.rows], np.cumsum(keep) - 1
        return Sparse(place[self.rows[inside]], self.cols[inside], self.vals[inside], (int(keep.sum()), self.shape[1]))


def _design(docs: list[list[list[str]]]) -> tuple[Sparse, list[str], np.ndarray]:
    """Feature matrix of all sentences, its feature names, and the document of each row."""
    names: dict[str, int] = {}
    rows, cols, vals, owner, lens = [], [], [], [], []
    k = 0
    for d, doc in enumerate(docs):
        for s in doc:
            for w in s:
                grams = _grams(w)
                for name, v in [("w:" + w, 1 / len(s)), *(("g:" + g, 1 / len(s) / len(grams)) for g in grams)]:
                    rows.append(k), cols.append(names.setdefault(name, len(names))), vals.append(v)
            owner.append(d), lens.append((len(s), sum(map(len, s))))
            k += 1
    size = np.array(lens, float).reshape(-1, 2)
    extra = _length_features(size[:, 0], size[:, 1])
    rows = np.concatenate([np.array(rows, np.int64), np.repeat(np.arange(k), extra.shape[1])])
    cols = np.concatenate([np.array(cols, np.int64), np.tile(len(names) + np.arange(extra.shape[1]), k)])
    vals = np.concatenate([np.array(vals) * 20, extra.ravel()])
    return Sparse(rows, cols, vals, (k, len(names) + extra.shape[1])), list(names), np.array(owner)


def _softmax_fit(x: Sparse, y: np.ndarray, n_levels: int, decay: float = 2e-3, steps: int = 120, rate: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Ridge-penalised softmax regression by accelerated gradient steps (features are scaled alike)."""
    w, b = np.zeros((x.shape[1], n_levels), np.float32), np.zeros(n_levels, np.float32)
    vw, vb, hot = w.copy(), b.copy(), np.eye(n_levels, dtype=np.float32)[y]
    for t in range(steps):
        lw, lb = w + 0.9 * vw, b + 0.9 * vb
        z = x.times(lw) + lb
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - hot) / len(y)
        vw, vb = 0.9 * vw - rate * (x.transposed_times(g) + decay * lw), 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def _expected(x: Sparse, owner: np.ndarray, size: np.ndarray, w: np.ndarray, b: np.ndarray, levels: list[int]) -> dict[int, float]:
    z = x.times(w) + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    e = (p / p.sum(axis=1, keepdims=True)) @ np.array(levels, float)
    return {int(d): float(np.average(e[owner == d], weights=size[owner == d])) for d in np.unique(owner)}


def _fit_fold(texts: list[str], labels: list[int], folds: int, fold: int) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Weights without the documents of a fold, and those documents' expected levels; all documents where ``fold == folds``."""
    docs, graded, levels = _graded(texts, labels)
    x, _, owner = _design(docs)
    size = np.array([len(s) for d in docs for s in d], float)
    y = np.array([levels.index(v) for v in graded])[owner]
    out = (np.random.default_rng(3).permutation(len(docs)) % folds)[owner] == fold
    if out.all():
        return np.empty(0), np.empty(0), {}
    w, b = _softmax_fit(x.part(~out), y[~out], len(levels))
    return w, b, _expected(x.part(out), owner[out], size[out], w, b, levels) if out.any() else {}


def _graded(texts: list[str], labels: list[int]) -> tuple[list[list[list[str]]], list[int], list[int]]:
    """Sentences and level of each usable sample, and the levels."""
    docs = [sentences(t or "") for t in texts]
    some = [i for i, d in enumerate(docs) if d and labels[i] is not None]
    graded = [int(labels[i]) for i in some]
    return [docs[i] for i in some], graded, sorted(set(graded))


def fit(texts: list[str], labels: list[int], folds: int = 5, spark: SparkSession | None = None) -> LevelModel | None:
    """Model and calibrated cut points from graded samples; None without two levels.

    With a session, the folds and the final model are fitted in a task each.
    """
    docs, graded, levels = _graded(texts, labels)
    if len(levels) < 2:
        return None
    names = _design(docs)[1]
    if spark is None:
        fitted = [_fit_fold(texts, labels, folds, f) for f in range(folds + 1)]
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(f, pickle.dumps(_fit_fold(texts, labels, folds, int(f)))) for f in pdf.id], columns=["fold", "fitted"])

        tasks = spark.range(0, folds + 1, 1, folds + 1).mapInPandas(run, "fold long, fitted binary")
        fitted = [pickle.loads(r.fitted) for r in sorted(tasks.collect(), key=lambda r: r.fold)]
    held: dict[int, float] = {}
    for _, _, found in fitted[:folds]:
        held |= found
    # The cut between two levels lies equally many standard deviations from both held-out means.
    cuts = []
    for low, high in zip(levels, levels[1:]):
        below, above = ([e for d, e in held.items() if graded[d] == v] or [float(v)] for v in (low, high))
        spread_low, spread_high = np.std(below) + 0.02, np.std(above) + 0.02
        cuts.append(float((np.mean(below) * spread_high + np.mean(above) * spread_low) / (spread_low + spread_high)))
    w, b, _ = fitted[folds]
    return LevelModel(levels, {n: w[i].astype(float) * 20 for i, n in enumerate(names)}, w[len(names) :].astype(float), b.astype(float), list(np.maximum.accumulate(cuts)))


def _vector(model: LevelModel, token: str) -> np.ndarray:
    """Level scores, words, letters, English words, foreign words, and whether a sentence ends."""
    ws = token_words(token)
    score = sum((model.word(w) for w in ws), np.zeros(len(model.levels)))
    return np.array([*score, len(ws), sum(map(len, ws)), sum(w in _ENGLISH for w in ws), sum(w in _FOREIGN for w in ws), ends_sentence(token)])


class _Memo(dict):
    """Token → row of the vector table, filled on first sight."""

    def __init__(self, model: LevelModel) -> None:
        self.model, self.rows, self.grid = model, [], np.zeros((0, len(model.levels) + 5))

    def __missing__(self, token: str) -> int:
        k = self[token] = len(self.rows)
        self.rows.append(_vector(self.model, token))
        return k

    def table(self) -> np.ndarray:
        if len(self.rows) > len(self.grid):
            self.grid = np.concatenate([self.grid, np.array(self.rows[len(self.grid) :])]).astype(np.float32)
        return self.grid


#: tokens kept by a worker; beyond it the memo starts anew, which costs time only
MEMO_TOKENS = 300_000


def _scorer(model: LevelModel, least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, levels = _Memo(model), np.array(model.levels, float)
        for pdf in (p.iloc[i : i + 500] for p in batches for i in range(0, len(p), 500)):  # bounds the token table
            if len(memo) > MEMO_TOKENS:
                memo = _Memo(model)
            codes, sizes = [], []
            for text in pdf.text:
                found = tokens(text)
                codes.extend(map(memo.__getitem__, found))
                sizes.append(len(found))
            if not codes:
                continue
            flat, sizes = memo.table()[np.array(codes)], np.array(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            begins = np.ones(len(flat), bool)
            begins[1:] = (flat[:-1, -1] > 0) | (owner[1:] != owner[:-1])
            starts = np.flatnonzero(begins)
            sums, owner = np.add.reduceat(flat, starts, axis=0), owner[starts]
            words, letters, english, foreign = sums[:, -5:-1].T
            counts = (words > 0) & (english >= 0.1 * words) & (english > foreign)
            level = model.distributions(sums[:, :-5], words, letters) @ levels
            n, w = len(pdf), np.where(counts, words, 0)
            total = np.bincount(owner, w, n)
            mean = np.bincount(owner, level * w, n) / np.maximum(total, 1)
            keep = total >= least_words
            yield pd.DataFrame({"doc_id": pdf.doc_id[keep], "reading_level": [model.level(e) for e in mean[keep]], "expected": mean[keep], "n_words": total[keep].astype(int)})

    return run


def reading_levels(docs: DataFrame, samples: DataFrame, least_words: int = LEAST_WORDS, max_samples: int = 2_000) -> DataFrame:
    """``doc_id, reading_level, expected, n_words`` of each document of ``doc_id, text`` with enough English prose."""
    schema = "doc_id long, reading_level long, expected double, n_words long"
    rows = samples.where(F.col("text").isNotNull() & F.col("reading_level").isNotNull()).select("text", "reading_level", "sample_id").orderBy("sample_id").limit(max_samples).collect()
    model = fit([r.text for r in rows], [r.reading_level for r in rows], spark=docs.sparkSession)
    some = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    return some.mapInPandas(_scorer(model, least_words), schema)


def document_levels(spark: SparkSession, where: str) -> DataFrame:
    return reading_levels(table(spark, where, "documents"), table(spark, where, "level_samples"))
