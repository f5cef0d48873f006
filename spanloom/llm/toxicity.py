"""Toxicity by weak supervision.

Voters are lexicons, words and word beginnings whose rate labelled texts tell apart, and surface patterns. A generative label model (two hidden
classes; each voter has a firing rate in either) is fitted by expectation maximisation, anchored by the labels that may be
learned from as one more, imperfect voter. Voters that fire together beyond what the classes explain share their
evidence: each one's log odds are divided by one plus its residual correlations. The rates are then estimated anew over
all texts, labelled or not, from the counts of their vote patterns. A linear classifier over words and patterns is trained
on the posterior labels of the labelled sample, and it alone scores texts.

The one bound is MAX_LABELLED, the size of the labelled sample; voters are all that its evidence supports.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_MIX, mix, slices, span_hashes, stored, text_buffers, without

MAX_LABELLED, MIN_EVIDENCE, SWEEPS = 6000, 25.0, 2
PREFIXES = (4, 5, 6, 7, 8)
_PREFIX_SALT, _TIERS = np.uint64(0xA0761D6478BD642F), mix(np.arange(3, dtype=np.uint64))
#: Seed lexicons, each one voter.
LEXICONS = {
    "insults": "idiot idiots moron morons stupid dumb imbecile fool clown loser losers jerk".split(),
    "contempt": "worthless pathetic disgusting trash scum garbage vermin filth scumbag subhuman".split(),
    "hostility": "hate kill die destroy shut hell damn".split(),
    "vulgar": "fuck fucking shit bitch bastard asshole crap".split(),
    "german": "idioten trottel dumm abschaum dreckig wertlos arschloch hurensohn".split(),
    "french": "idiote imbécile connard salaud ordure débile crétin".split(),
    "spanish": "idiota imbécil estúpido basura inútil cabrón escoria".split(),
}
PATTERNS = ("shouting", "exclaims", "repeats_marks")
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def word_hash(words: list[str]) -> np.ndarray:
    """span_hashes() of single words."""
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        b = BYTE_MIX[np.frombuffer(w.encode(), np.uint8)]
        out[i] = span_hashes(b, np.array([0]), np.array([len(b)]))[0]
    return out


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, the text of each word, and of each pattern whether it holds."""
    plain, pat = text_buffers(texts)
    raw, at = text_buffers(pc.utf8_lower(texts.fill_null("")))
    n = len(at) - 1
    flat = np.full(len(raw) + n, 32, np.uint8)
    body = np.ones(len(flat), bool)
    body[at[1:] + np.arange(n)] = False
    flat[body] = raw
    ok = _LETTER[flat]
    # blanks, quotation marks and dashes beyond ASCII part words too
    e2 = np.flatnonzero((flat[:-2] == 0xE2) & (flat[1:-1] == 0x80))
    ok[e2] = ok[e2 + 1] = ok[e2 + 2] = False
    c2 = np.flatnonzero(flat[:-1] == 0xC2)
    ok[c2] = ok[c2 + 1] = False
    edge = np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(at[1:] + np.arange(n) + 1, s, "right")
    of = np.searchsorted(pat[1:], np.arange(len(plain)), "right")
    per = lambda m: np.bincount(of[m], minlength=n)
    upper, letters, bang = per((plain >= 65) & (plain <= 90)), per(((plain | 32) >= 97) & ((plain | 32) <= 122)), plain == 33
    twice = np.flatnonzero(bang[1:] & bang[:-1])
    patterns = np.stack([(upper > 0.5 * letters) & (letters >= 10), per(bang) >= 3, np.bincount(of[twice], minlength=n) > 0], 1) if len(plain) else np.zeros((n, 3), bool)
    return flat, s, e, doc, patterns


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of whole words and of their PREFIXES, by text: hash, text, how often; the texts' words and patterns."""
    flat, s, e, doc, patterns = word_spans(texts)
    mixed = BYTE_MIX[flat]
    h, d = [span_hashes(mixed, s, e)], [doc]
    for k in PREFIXES:
        on = np.flatnonzero(e - s > k)
        h.append(span_hashes(mixed, s[on], s[on] + k) + _PREFIX_SALT)
        d.append(doc[on])
    h, d = np.concatenate(h), np.concatenate(d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return h[first], d[first], np.diff(np.append(first, len(h))), np.bincount(doc, minlength=len(texts)), patterns


def tiers(count: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """A word or prefix is there; it makes up 0.5 % of the words; 1.5 %."""
    return [count > 0, 200 * count >= words, 200 * count >= 3 * words]


def features_of(h: np.ndarray) -> np.ndarray:
    """The feature numbers of hashes in each tier: tiers x hashes."""
    return np.stack([h + salt for salt in _TIERS])


def presence(texts: pa.Array, features: np.ndarray) -> np.ndarray:
    """texts x (features + PATTERNS): which features, by sorted numbers, and which patterns each text has."""
    out = np.zeros((len(texts), len(features) + len(PATTERNS)), bool)
    if len(features) and len(texts):
        wanted = np.unique(np.concatenate([features - salt for salt in _TIERS]))
        flat, s, e, doc, patterns = word_spans(texts)
        mixed, hs, ds = BYTE_MIX[flat], [], []
        for k in (0, *PREFIXES):
            on = np.flatnonzero(e - s > k)
            h = span_hashes(mixed, s[on], s[on] + k if k else e[on])
            h = h + _PREFIX_SALT if k else h
            hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
            hs.append(h[hit])
            ds.append(doc[on][hit])
        h, d = np.concatenate(hs), np.concatenate(ds)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        count, h, d = np.diff(np.append(first, len(h))), h[first], d[first]
        words = np.bincount(doc, minlength=len(texts))
        for number, on in zip(features_of(h), tiers(count, words[d])):
            at = np.minimum(np.searchsorted(features, number), len(features) - 1)
            ok = on & (features[at] == number)
            out[d[ok], at[ok]] = True
    else:
        patterns = word_spans(texts)[4] if len(texts) else out[:, :0]
    out[:, len(features) :] = patterns
    return out


def vote_matrix(x: np.ndarray, lexicons: list[list[int]], single: list[int], patterns: int) -> np.ndarray:
    """Votes of rows of presence(): each lexicon's, each single feature's, each pattern's, and whether all are silent."""
    votes = np.hstack([np.stack([x[:, at].any(1) for at in lexicons], 1), x[:, single], x[:, x.shape[1] - patterns :]]) > 0
    return np.hstack([votes, ~votes.any(1)[:, None]])


def log_odds(v: np.ndarray, found: dict) -> np.ndarray:
    """The label model's log odds of class 1 for rows of vote_matrix() without a label."""
    n = v.shape[1]
    return math.log(found["prior"] / (1 - found["prior"])) + v @ (np.log(found["fires_if_1"] / found["fires_if_0"]) * found["discount"])[:n]


def label_model(votes: np.ndarray, labels: np.ndarray, steps: int = 40, others=None, sweeps: int = SWEEPS) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of vote_matrix(); labels: 0, 1 or -1 where there is none. Also the rates and the discounts found.

    A voter that does not fire abstains. others, given what is found, returns the sums over all texts, without their labels, of the posterior
    times each vote, of the posterior, and the same of its complement; rates are estimated with them `sweeps` times.
    """
    known = labels >= 0
    y = np.where(known, labels, 0.0).astype(float)
    prior = float(np.clip(y[known].mean() if known.any() else 0.1, 0.01, 0.99))
    post = np.where(known, np.where(y > 0, 0.9, 0.1), prior)
    v = np.hstack([votes, (labels == 1)[:, None]]).astype(float)
    seen = np.ones_like(v)
    seen[:, -1] = known
    discount, found = np.ones(v.shape[1]), {}
    for step in range(steps + (sweeps if others else 0)):
        w1, w0 = post[:, None] * seen, (1 - post)[:, None] * seen
        top, one, low, zero = (w1 * v).sum(0), w1.sum(0), (w0 * v).sum(0), w0.sum(0)
        if step >= steps:
            more = [np.append(x, 0.0) for x in others(found)]
            top, one, low, zero = top + more[0], one + more[1], low + more[2], zero + more[3]
        a, b = (0.5 * prior + top) / (0.5 + one), (0.05 * prior + low) / (0.5 + zero)
        a, b = np.clip(a, 1e-3, 0.999), np.clip(b, 1e-4, 0.999)
        if step in (5, 15):  # correlations that the classes leave unexplained
            mean = post[:, None] * a + (1 - post)[:, None] * b
            r = (v - mean) * seen
            c = r.T @ r / np.sqrt(np.outer((r * r).sum(0), (r * r).sum(0)) + 1e-9)
            np.fill_diagonal(c, 0)
            c[-2:] = c[:, -2:] = 0  # silence and labels stand for themselves
            discount = 1 / (1 + np.where(np.abs(c) > 0.1, np.abs(c), 0).sum(1))
        found = {"prior": prior, "fires_if_1": a, "fires_if_0": b, "discount": discount}
        z = log_odds(v[:, :-1], found)
        z += known * np.where(labels == 1, math.log(a[-1] / b[-1]), math.log((1 - a[-1]) / (1 - b[-1]))) * discount[-1]  # only a label speaks when it doesn't fire
        post = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if not known.any():
            prior = float(np.clip(post.mean(), 0.01, 0.5))
    return post, found


def logistic(x: np.ndarray, target: np.ndarray, l2: float = 1e-5, steps: int = 600) -> np.ndarray:
    """Weights and bias (last) of logistic regression on soft labels, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = v = np.zeros(x.shape[1])
    rate = 4.0 / max(float((x * x).sum(1).mean()), 1.0)
    for t in range(steps):
        g = x.T @ (1 / (1 + np.exp(-(x @ v))) - target) / len(x)
        g[:-1] += l2 * v[:-1]
        new = v - rate * g
        v, w = new + t / (t + 3) * (new - w), new
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, unlabelled: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, dict]:
    """Sorted features, their weights (then PATTERNS, bias) and the label model's findings.

    Learns labels from about MAX_LABELLED labelled rows where learn holds (a sample by hash), and voters' rates also from all
    texts where unlabelled holds. A row without a label, or with one other than 0 and 1, counts as unlabelled; of several
    labels of an id the greatest counts. Null texts teach nothing.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    total = known.count()
    sampled = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(1 << 20)) < min(1.0, MAX_LABELLED / max(total, 1)) * (1 << 20)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), unlabelled.alias("free"))
    sample = stored(texts.join(F.broadcast(known.where(sampled)), "id").select("text", "label"), "toxic-sample")  # about MAX_LABELLED rows

    def voters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                h, doc, count, words, _ = gram_counts(part.column(0))
                for number, on in zip(features_of(h), tiers(count, words[doc])):
                    yield pa.RecordBatch.from_arrays([pa.array(number[on].view(np.int64)), part.column(1).take(pa.array(doc[on]))], ["feature", "label"])

    p, n = (float(sample.where(f"label = {y}").count()) for y in (1, 0))
    counted = sample.where("label >= 0").select("text", "label").mapInArrow(voters, "feature long, label int").groupBy("feature").agg(F.sum("label").alias("one"), F.sum(1 - F.col("label")).alias("zero"))
    t, part = F.col("one") + F.col("zero"), lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = 2 * (part(F.col("one"), t * p / (p + n)) + part(F.col("zero"), t * n / (p + n)) + part(p - F.col("one"), (p + n - t) * p / (p + n)) + part(n - F.col("zero"), (p + n - t) * n / (p + n))) if p and n else F.lit(0.0)
    mined = counted.where((F.col("one") * n > 3 * F.col("zero") * p) & (F.col("one") >= 3)).withColumn("g", g).where(F.col("g") > MIN_EVIDENCE).select("feature").collect()
    seeds = {w: int(x) for ws in LEXICONS.values() for w, x in zip(ws, word_hash(ws))}
    single = sorted(r["feature"] & (1 << 64) - 1 for r in mined)
    h = np.unique(np.array([*single, *seeds.values()], np.uint64))

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = presence(part.column(0), h)
                yield pa.RecordBatch.from_arrays([pa.array([np.packbits(x).tobytes() for x in p], pa.binary()), part.column(1)], ["x", "label"])

    got = sorted((bytes(r[0]), r[1]) for r in sample.select("text", "label").mapInArrow(fired, "x binary, label int").collect())
    width = len(h) + len(PATTERNS)
    if not got:
        return h, np.append(np.zeros(width), -3.0), {}
    unpacked = lambda rows: np.array([np.unpackbits(np.frombuffer(b, np.uint8), count=width) for b in rows], float).reshape(-1, width)
    x, label = unpacked([b for b, _ in got]), np.array([y for _, y in got])
    at = {int(w): i for i, w in enumerate(h)}
    voting = ([[at[seeds[w]] for w in ws] for ws in LEXICONS.values()], [at[f] for f in single], len(PATTERNS))

    free = texts.where("free").select("text", F.lit(-1).alias("label")).mapInArrow(fired, "x binary, label int")
    seen = stored(free.groupBy("x").agg(F.count("*").alias("n")), "toxic-patterns")  # most texts share a few patterns

    def others(found: dict) -> list[np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v, n = vote_matrix(unpacked(batch.column(0).to_pylist()), *voting).astype(float), batch.column(1).to_numpy()
                p = 1 / (1 + np.exp(-np.clip(log_odds(v, found), -40, 40)))
                each = np.stack([(p * n) @ v, np.full(v.shape[1], (p * n).sum()), ((1 - p) * n) @ v, np.full(v.shape[1], ((1 - p) * n).sum())], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(each))), *(pa.array(each[:, k]) for k in range(4))], ["voter", "s0", "s1", "s2", "s3"])

        rows = seen.mapInArrow(sums, "voter long, s0 double, s1 double, s2 double, s3 double").groupBy("voter").agg(*[F.round(F.sum(f"s{k}"), 6).alias(f"s{k}") for k in range(4)]).orderBy("voter").collect()
        size = len(LEXICONS) + len(single) + len(PATTERNS) + 1
        return [np.array([r[f"s{k}"] for r in rows]) if rows else np.zeros(size) for k in range(4)]

    post, found = label_model(vote_matrix(x, *voting), label, others=others)
    return h, logistic(x, post), found | {"voters": len(single), "rows": len(got)}


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, dict], text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5) of each whole text; a null text is empty.

    Columns of docs of these names give way to the result's; others, whatever their names, stay. Repeated rows and null ids
    each keep their row, texts of any length are read whole, and an empty table gives no rows.
    """
    docs = without(docs, "score", "predicted")
    h, w = model[0], model[1]  # as many as the labelled sample has evidence for
    schema = docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                z = presence(part.column(at).fill_null(""), h) @ w[:-1] + w[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema.names)

    return docs.mapInArrow(run, schema)
