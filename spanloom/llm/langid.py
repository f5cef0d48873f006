"""Language identification by hierarchical discrimination.

Byte 2- and 3-grams of the lower-cased letters are hashed to DIM features, as frequencies. A softmax model predicts the
language family; within it one-versus-one linear support vector machines separate the languages. All models are linear in
the mean of a text's gram features, so a whole text is scored in one pass over its bytes. Models are fitted on the driver
on a sample of about PER_LANG labelled texts of each language, whose features are kept sparse.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, slices, text_buffers, without

DIM, SCALE, PER_LANG = 8192, 40.0, 400
UNKNOWN = "und"
#: Families of ISO 639-1 codes; a code that is missing here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn ur pa mr gu ne si".split(),
    "semitic": "ar he am mt".split(),
}
_FAMILY = {code: f for f, codes in FAMILIES.items() for code in codes}
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def gram_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all grams, their weights (0 for grams that don't count) and the first gram of each text."""
    raw, at = text_buffers(pc.utf8_lower(texts.fill_null("")))
    n = len(at) - 1
    flat = np.full(len(raw) + 2 * n + 2, 32, np.uint8)  # a blank before and after each text
    begin = at[:-1] + 2 * np.arange(n)
    body = np.ones(len(flat), bool)
    body[begin] = body[at[1:] + 2 * np.arange(n) + 1] = False
    body[-2:] = False
    flat[body] = _KEEP[raw]
    x = flat.astype(np.uint32)
    two = (x[:-2] << 8) | x[1:-1]
    three = (two << 8) | x[2:]
    blank = x == 32
    w3 = ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))
    last = at[1:] + 2 * np.arange(n) + 1
    w3[last] = False
    w3[last - 1] = False
    w2 = ~(blank[:-2] & blank[1:-1])
    w2[last] = False
    h = np.uint32(2654435761)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    return np.stack([(three * h) >> shift, ((two + np.uint32(7 << 24)) * h) >> shift]), np.stack([w3, w2]), begin


def mean_outputs(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """SCALE times the mean over a text's grams of weights[feature]; weights: DIM x outputs."""
    features, counted, begin = gram_features(texts)
    out = np.zeros((len(begin), weights.shape[1]))
    if not len(begin):
        return out
    n = np.add.reduceat(counted.sum(0), begin)
    for f, w in zip(features, counted):
        for j in range(weights.shape[1]):
            out[:, j] += np.add.reduceat(np.where(w, weights[:, j][f], 0.0), begin)
    return SCALE * out / np.maximum(n, 1)[:, None]


class Sparse:
    """Rows of DIM features: the feature numbers and values of all rows, and where each row begins."""

    def __init__(self, at: list[np.ndarray], value: list[np.ndarray]):
        sizes = np.fromiter(map(len, at), np.int64, len(at))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.at = np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64)
        self.value = np.concatenate([*value, np.empty(0, np.float32)]).astype(np.float32)
        self.row = np.repeat(np.arange(len(at)), sizes)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def times(self, w: np.ndarray) -> np.ndarray:
        """The rows' products with one vector of weights."""
        return np.bincount(self.row, weights=self.value * w[self.at], minlength=len(self))

    def back(self, y: np.ndarray) -> np.ndarray:
        """The features' products with one number for each row."""
        return np.bincount(self.at, weights=self.value * y[self.row], minlength=DIM)

    def norms(self) -> np.ndarray:
        return np.bincount(self.row, weights=self.value**2, minlength=len(self))


def svm(x: Sparse, rows: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine on some rows, by dual coordinate descent; y: -1 or 1."""
    rng, alpha, w, b = np.random.default_rng(1), np.zeros(len(y)), np.zeros(DIM), 0.0
    norm = x.norms()[rows] + 1
    spans = [(x.at[i:j], x.value[i:j]) for i, j in zip(x.starts[rows].tolist(), x.starts[rows + 1].tolist())]
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, value = spans[i]
            a = min(max(alpha[i] - (y[i] * (value @ w[at] + b) - 1) / norm[i], 0), c)
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[at] += step * value
                b += step
                alpha[i] = a
    return np.append(w, b)


def softmax_model(x: Sparse, y: np.ndarray, classes: int, steps: int = 80) -> np.ndarray:
    """(DIM + 1) x classes weights of multinomial regression, by accelerated gradient descent."""
    w = v = np.zeros((DIM + 1, classes))
    rate, target = 4.0 / (2 + float(x.norms().mean())), np.eye(classes)[y]
    for t in range(steps):
        z = np.stack([x.times(v[:-1, j]) for j in range(classes)], 1) + v[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = (p - target) / len(x)
        g = np.vstack([np.stack([x.back(off[:, j]) for j in range(classes)], 1), off.sum(0)])
        new = v - rate * (g + 1e-5 * v)
        v, w = new + t / (t + 3) * (new - w), new
    return w


def _sigmoid_scale(margin: np.ndarray, y: np.ndarray) -> float:
    """The scale of a logistic curve through 0 that fits the margins best."""
    scales = np.array([0.5, 1, 2, 3, 4, 6])
    return float(scales[np.argmin([np.log1p(np.exp(-s * y * margin)).mean() for s in scales])])


class LanguageModel:
    def __init__(self, x: Sparse, langs: list[str]):
        self.langs = sorted(set(langs))
        family = [_FAMILY.get(code, code) for code in self.langs]
        self.families = sorted(set(family))
        self.members = [[i for i, f in enumerate(family) if f == name] for name in self.families]
        y = np.array([self.langs.index(code) for code in langs], int)
        of = np.array([self.families.index(f) for f in family], int)
        parts = [softmax_model(x, of[y], len(self.families))] if len(self.families) > 1 else []
        self.pairs = [(a, b) for m in self.members for a, b in combinations(m, 2)]
        self.scale = []
        for a, b in self.pairs:
            on = np.flatnonzero((y == a) | (y == b))
            sign = np.where(y[on] == a, 1.0, -1.0)
            w = svm(x, on, sign)
            self.scale.append(_sigmoid_scale(x.times(w[:-1])[on] + w[-1], sign))
            parts.append(w[:, None])
        self.weights = np.hstack(parts).astype(np.float32) if parts else np.zeros((DIM + 1, 0), np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        letter = np.asarray(pc.match_substring_regex(texts.fill_null(""), r"\pL").to_numpy(zero_copy_only=False), bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        z = mean_outputs(texts, self.weights[:-1]) + self.weights[-1]
        f = len(self.families) if len(self.families) > 1 else 0
        p = np.ones((len(texts), 1))
        if f:
            p = np.exp(z[:, :f] - z[:, :f].max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
        votes, sure = np.zeros((len(texts), len(self.langs))), np.ones((len(texts), len(self.langs)))
        for j, (a, b) in enumerate(self.pairs):
            q = 1 / (1 + np.exp(-np.clip(self.scale[j] * z[:, f + j], -40, 40)))
            votes[:, a] += (q >= 0.5) + 1e-3 * q
            votes[:, b] += (q < 0.5) + 1e-3 * (1 - q)
            sure[:, a] = np.minimum(sure[:, a], q)
            sure[:, b] = np.minimum(sure[:, b], 1 - q)
        best = p.argmax(1)
        own = np.zeros((len(self.families), len(self.langs)), bool)
        for i, m in enumerate(self.members):
            own[i, m] = True
        lang = np.where(own[best], votes, -1).argmax(1)
        row = np.arange(len(texts))
        score = np.where(letter, p[row, best] * sure[row, lang], 0.0)
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(lang.tolist(), letter.tolist())], score


def id_remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, mod k; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % k


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, per_lang: int = PER_LANG) -> LanguageModel:
    """Fits on about per_lang rows of each language (a sample by hash of id and length) among those where learn holds.

    Every language that any such row names is learned. A table without one gives a model that says UNKNOWN.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (learn if learn is not None else F.lit(True)))
    slim = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r[0]: r[1] for r in slim.groupBy("lang").count().collect()}  # the model holds each of these languages
    if not counts:
        return LanguageModel(Sparse([], []), [])
    share = F.element_at(F.create_map(*[F.lit(x) for code, n in sorted(counts.items()) for x in (code, min(1.0, per_lang / n))]), F.col("lang"))
    picked = slim.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                features, counted, begin = gram_features(part.column(0))
                ends = np.append(begin[1:], features.shape[1])
                rows = [np.bincount(features[:, a:b][counted[:, a:b]].astype(np.int64), minlength=DIM) for a, b in zip(begin, ends)]
                rows = [np.round(1e6 * r / max(r.sum(), 1)).astype(np.int32) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([np.flatnonzero(r).astype(np.int16).tobytes() for r in rows], pa.binary()), pa.array([r[r > 0].tobytes() for r in rows], pa.binary()), part.column(1)], ["at", "value", "lang"])

    got = picked.select("text", "lang").mapInArrow(run, "at binary, value binary, lang string").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    x = Sparse([np.frombuffer(r["at"], np.int16) for r in got], [np.frombuffer(r["value"], np.int32) * np.float32(SCALE / 1e6) for r in got])
    return LanguageModel(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text, UNKNOWN where it is null or has no letter, and a score from 0 to 1.

    Columns of docs called lang_name or score_name give way to the result's; others, whatever their names, stay. Repeated rows
    and null ids each keep their row, texts of any length are read whole, and an empty table gives no rows.
    """
    docs = without(docs, lang_name, score_name)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most DIM weights for each pair of languages
    schema = docs.withColumn(lang_name, F.lit("")).withColumn(score_name, F.lit(0.0)).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                lang, score = sent.value.predict(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], schema.names)

    return docs.mapInArrow(run, schema)
