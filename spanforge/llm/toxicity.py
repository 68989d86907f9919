"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts the subsequences of three letters that they share, gaps allowed
within a span of eight letters, each weighted by decay^span: inserted characters cost weight but
leave an insult's subsequences in place.  It is scaled by each word's length, which is a conformal
scaling and keeps it a kernel.

Training sees a bounded sample (``MAX_LABELLED`` texts of each label, a documented parameter) of the
rows it is given, and of that sample's words the commonest ``COMMON`` clean ones, ``OTHERS`` more of the
clean ones drawn at random, ``WITNESSES`` witnesses and ``HARD`` clean ones that the machine had wrong,
which bounds the machine whatever the length of the texts; words of over ``WINDOW`` letters are learnt
by their first window.  Scoring knows no such bounds.  A text's label is known, the words that cause it are not, so witnesses are chosen
among a toxic text's words, first by how much more often a word is in toxic texts than in clean ones, then in
rounds by the machine itself.  Words are mapped to the landmarks' span (Nystroem); a squared-hinge
machine is solved there; a logistic curve over a text's three
highest margins, its number of words with a high one and its length gives the score.

With landmarks fixed, the decision is one table of weights per subsequence, so that scoring a word
costs one look-up per subsequence and no kernel evaluations, and a text of any length is read whole.

Words: lower case, common digit-for-letter swaps undone, other characters dropped; three or more
single letters in a row are also read as one word; words of over 24 letters are read in overlapping
windows.  The commonest letters have numbers of their own, all others share ``SHARED`` numbers.  Defined results: a null or empty text has the score of a text without words; without both
labels in the sample every score is the share of toxic rows in it (0 if none); repeated labels of an
id count once, toxic if any is.  Other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.tables import table

MAX_LABELLED = 2500
LANDMARKS = 96
SPAN = 8
DECAY = 0.7
WINDOW = 24
ALPHABET = 64
SHARED = 8
COMMON, OTHERS, WITNESSES, HARD = 4000, 12_000, 3000, 2000
TOP = 3
THRESHOLD = 0.7
CACHE = 400_000

_SWAPS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "!": "i", "$": "s"})
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’‘¿¡…–—|"
_NOT_LETTER = re.compile(r"[\W\d_]+")
_SINGLES = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){2,}[^\W\d_](?!\S)")


def clean_word(raw: str) -> str:
    """A raw run of characters as letters only, behind a mark for the word's beginning."""
    if raw.startswith("^"):
        return raw if raw[1:].isalpha() else clean_word(raw.lstrip("^"))
    w = raw.strip(_EDGES)
    if not w.isalpha():
        w = _NOT_LETTER.sub("", w.translate(_SWAPS)) if any(c.isalpha() for c in w) else ""
    return f"^{w}" if w else ""


def raw_words(text: str) -> set[str]:
    """The distinct raw words of a text, spelled-out ones joined."""
    low = text.lower()
    found = set(low.split())
    if _SINGLES.search(low):
        found.update("".join(m.split()) for m in _SINGLES.findall(low))
    return found


@dataclass
class Spelling:
    """Letters as small numbers: the commonest by rank, all others by their code among ``SHARED`` more.
    (Number 0 stands for no letter.)"""

    codes: dict[str, int]

    @classmethod
    def of(cls, words: list[str]) -> Spelling:
        count = Counter(c for w in words for c in w)
        return cls({c: i + 1 for i, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[: ALPHABET - 1 - SHARED])})

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all windows one after the other, the window of each letter, the word of each window."""
        get = self.codes.get
        parts, owner = [], []
        for k, w in enumerate(words):
            for at in range(0, max(len(w) - WINDOW // 2, 1), WINDOW // 2) if len(w) > WINDOW else (0,):
                parts.append(w[at : at + WINDOW])
                owner.append(k)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.fromiter((get(c) or ALPHABET - 1 - ord(c) % SHARED for p in parts for c in p), np.int32, int(lengths.sum()))
        return codes, np.repeat(np.arange(len(parts)), lengths), np.array(owner, np.int64)


def _pieces(codes: np.ndarray, window: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(windows, subsequences as numbers, weight) for each pair of gaps within the span."""
    n = len(codes)
    c = codes.astype(np.int64)
    for last in range(2, SPAN):
        if n <= last:
            return
        whole = np.flatnonzero((window[:-last] == window[last:]) & (c[:-last] > 0) & (c[last:] > 0))
        for mid in range(1, last):
            at = whole[c[whole + mid] > 0]
            yield window[at], (c[at] * ALPHABET + c[at + mid]) * ALPHABET + c[at + last], DECAY ** (last + 1)


def _scale(window: np.ndarray, n_windows: int) -> np.ndarray:
    """1 / norm of a window by its length."""
    lengths = np.bincount(window, minlength=n_windows)
    norm = np.zeros(WINDOW + 1)
    for n in range(3, WINDOW + 1):
        norm[n] = sum((last - 1) * (n - last) * DECAY ** (2 * last + 2) for last in range(2, min(SPAN, n)))
    return np.where(lengths >= 3, 1 / np.sqrt(np.maximum(norm[np.minimum(lengths, WINDOW)], 1e-12)), 0.0)


@dataclass
class Model:
    """A fitted machine: ``weights`` per subsequence, a bias, and a curve from a text's summary to its score."""

    spelling: Spelling
    weights: np.ndarray
    bias: float
    curve: tuple[float, ...]
    prior: float | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        """The highest margin over each word's windows."""
        out = np.full(len(words), self.bias)
        if not words:
            return out
        codes, window, owner = self.spelling.flat(words)
        total = np.zeros(len(owner))
        for w, u, weight in _pieces(codes, window):
            total += np.bincount(w, self.weights[u], minlength=len(owner)) * weight
        value = total * _scale(window, len(owner)) + self.bias
        np.maximum.at(out, owner, value)
        return out

    def score(self, told: np.ndarray) -> np.ndarray:
        """Scores of texts from what ``summary`` tells of them."""
        if self.prior is not None:
            return np.full(len(told), self.prior)
        z = _text_features(told) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score_texts(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        """Scores of whole texts; ``cache`` keeps raw words' margins, up to a bound."""
        found = [raw_words(t) if t else set() for t in texts]
        if len(cache) > CACHE:
            cache.clear()
        new = [w for w in set().union(*found) if w not in cache] if found else []
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            cache.update(zip(part, self.margins([clean_word(w) for w in part]).tolist(), strict=True))
        told = np.empty((len(texts), TOP + 2))
        for i, words in enumerate(found):
            told[i] = self.summary(((cache[w], w) for w in words), len(words))
        return self.score(told)

    def summary(self, margins: Iterable[tuple[float, str]], n_words: int) -> list[float]:
        """The highest margins of different words, how many words have one over 0.3, and how many there are."""
        high = sorted(((m, w) for m, w in margins if m > 0), reverse=True)
        best = {clean_word(w): m for m, w in reversed(high)}  # spellings of one word count once
        values = sorted(best.values(), reverse=True)
        return [*(values + [min(self.bias, 0.0)] * TOP)[:TOP], sum(m > 0.3 for m in values), n_words]


def _features(spelling: Spelling, words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of words against landmarks."""
    codes, window, owner = spelling.flat([w[:WINDOW] for w in words])
    pieces = list(_pieces(codes, window))
    scale = _scale(window, len(owner))
    out = np.zeros((len(words), len(landmarks)))
    for k, z in enumerate(landmarks):
        table_ = _weights(spelling, [z], np.ones(1))
        for w, u, weight in pieces:
            out[:, k] += np.bincount(w, table_[u], minlength=len(owner)) * weight
    return out * scale[:, None]


def _weights(spelling: Spelling, landmarks: list[str], beta: np.ndarray) -> np.ndarray:
    """Landmarks' scaled subsequence weights, summed with factors ``beta``."""
    codes, window, owner = spelling.flat([z[:WINDOW] for z in landmarks])
    scale = _scale(window, len(owner)) * beta
    out = np.zeros(ALPHABET**3)
    for w, u, weight in _pieces(codes, window):
        np.add.at(out, u, weight * scale[w])
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps for the primal support vector machine; the last column is the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        act = y * (x1 @ w) < 1
        xa = x1[act] * cost[act, None]
        new = np.linalg.solve(ridge + xa.T @ x1[act], xa.T @ y[act])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _text_features(told: np.ndarray) -> np.ndarray:
    """Inputs of the logistic curve from rows of ``Model.summary``."""
    return np.hstack([np.clip(told[:, :TOP], -2, 2), np.log1p(told[:, TOP:]), np.ones((len(told), 1))])


def _curve(told: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """A logistic curve over texts' summaries."""
    x = _text_features(told)
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(len(w) - 1, 0.3), 1e-6]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Fit on labelled whole texts."""
    y = np.array(toxic, float)
    sets = [{c for w in raw_words(t) if len(c := clean_word(w)) >= 4} for t in texts]
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    if not n_pos or not n_neg:
        return Model(Spelling({}), np.zeros(ALPHABET**3), 0.0, (0.0,) * (TOP + 3), prior=float(y.mean()) if len(y) else 0.0)
    pos, neg = Counter(), Counter()
    for s, t in zip(sets, y, strict=True):
        (pos if t else neg).update(s)
    odds = {w: np.log((c + 0.2) / (n_pos + 1)) - np.log((neg[w] + 0.2) / (n_neg + 1)) for w, c in pos.items()}
    rare = lambda w: 20 * neg[w] * n_pos <= pos[w] * n_neg  # noqa: E731  twenty times as often in toxic texts
    strong = lambda w: (pos[w] >= 2 and rare(w), odds[w] * np.sqrt(pos[w]), w)
    toxic_sets = [s for s, t in zip(sets, y, strict=True) if t]
    witnesses = Counter(w for s in toxic_sets for w in sorted(s, key=strong, reverse=True)[:3] if pos[w] >= min(3, n_pos) and rare(w))
    common = [w for w, _ in sorted(neg.items(), key=lambda x: (-x[1], x[0]))[:COMMON]]
    rng = np.random.default_rng(10)
    rest = sorted(set(neg) - set(common))
    negatives = [w for w in common if w not in witnesses] + [rest[i] for i in sorted(rng.choice(len(rest), min(len(rest), OTHERS), replace=False))] if rest else common
    spelling = Spelling.of(sorted(set(pos) | set(neg)))
    model, hard = None, []
    for _ in range(3):
        chosen = [w for w, _ in sorted(witnesses.items(), key=lambda x: (-x[1], x[0]))][:WITNESSES]
        if not chosen:
            chosen = sorted(odds, key=strong, reverse=True)[: max(1, min(50, len(odds)))]
        half = LANDMARKS // 2
        landmarks = chosen[:half] + (hard + negatives)[: LANDMARKS - min(half, len(chosen))]
        words = chosen + negatives + hard
        label = np.r_[np.ones(len(chosen)), -np.ones(len(negatives) + len(hard))]
        often = np.array([min(witnesses.get(w, 1), 30) if y_ > 0 else min(neg[w], 30) for w, y_ in zip(words, label, strict=True)], float)
        cost = 2000 * often / np.where(label > 0, often[label > 0].sum(), often[label < 0].sum())
        k = _features(spelling, words, landmarks)
        own = _features(spelling, landmarks, landmarks)
        value, vector = np.linalg.eigh((own + own.T) / 2)
        keep = value > 1e-6 * value[-1]
        root = vector[:, keep] / np.sqrt(value[keep])
        w, bias = _squared_hinge(k @ root, label, cost)
        model = Model(spelling, _weights(spelling, landmarks, root @ w), bias, (0.0,) * (TOP + 3))
        every = sorted(set(pos) | set(neg))
        margin = dict(zip(every, model.margins(every).tolist(), strict=True))
        hard = sorted((w for w in neg if margin[w] > -0.5), key=lambda w: (-margin[w], w))[:HARD]
        witnesses = Counter(w for s in toxic_sets for w in sorted((w for w in s if rare(w)), key=lambda w: (-margin[w], w))[:2] if margin[w] > 0)
    told = np.array([model.summary(((margin[w], w) for w in s), len(s)) for s in sets])
    model.curve = _curve(told, y)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, keep: Column | None = None, limit: int = MAX_LABELLED) -> tuple[list[str], list[int]]:
    """At most ``limit`` texts of each label, chosen by a hash of the id. The driver holds no more."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.where(keep) if keep is not None else chosen
    chosen = chosen.groupBy(F.col("doc_id").alias("_lid")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    out: tuple[list[str], list[int]] = ([], [])
    order = (F.xxhash64("_lid"), "_lid")
    for label in (0, 1):
        ids = chosen.where((F.col("_toxic") != 0) if label else (F.col("_toxic") == 0)).orderBy(*order).limit(limit)
        texts = docs.select(F.col("doc_id").alias("_did"), F.col("text").alias("_text")).join(F.broadcast(ids), F.col("_did") == F.col("_lid"))
        for row in texts.orderBy(*order, "_text").limit(limit).select("_text").collect():
            out[0].append(row[0] or "")
            out[1].append(label)
    return out


def scorer(spark: SparkSession, model: Model):
    """A column function from text to score. The model's size is fixed, so it is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for s in parts:
            texts = [t if isinstance(t, str) else None for t in s.tolist()]
            out = np.empty(len(texts))
            for k in range(0, len(texts), 256):
                out[k : k + 256] = shared.value.score_texts(texts[k : k + 256], cache)
            yield pd.Series(out)

    return score


def in_training(id_col: Column) -> Column:
    """Whether a row's label may be learnt from."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) != 1


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(*labelled_sample(docs, table(spark, sf_dir, "labels"), in_training(F.col("doc_id"))))
    scored = docs.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), scorer(spark, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
