"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of the letters of each word (with a space at either end), lower case.
x[b] = SCALE * tf[b] * idf[b], tf the share of a text's n-grams in bucket b. Weights are learned
with follow-the-regularised-leader (per-coordinate, L1 and L2 penalties), then one temperature is
fitted on rows kept from the training sample. A text's score is linear in its words, so each
distinct word of an Arrow batch is scored once.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Runs, batchwise, chunks, mix64, sliced, span_hashes, spread

UNDETERMINED = "und"
NGRAMS = (1, 2, 3, 4)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SCALE = 30.0
#: Words that a Python worker remembers.
CACHE_WORDS = 200_000
#: Characters of texts that are gone through together (a longer text alone).
CHUNK = 1 << 19
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word index and bucket of every n-gram of every word; words in order."""
    padded = [" " + (w if w.isalpha() else "".join(c for c in w if c.isalpha())) + " " for w in words]
    size = np.array([len(p) if len(p) > 2 else 0 for p in padded], np.int64)
    codes = np.frombuffer("".join(p for p in padded if len(p) > 2).encode("utf-32-le"), np.uint32).astype(np.uint64)
    which = np.repeat(np.arange(len(words)), size)
    ends = np.repeat(np.cumsum(size), size)
    at = np.arange(len(codes))
    idx, buckets, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        if n > len(codes):
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        keep = at[: len(h)] + n <= ends[: len(h)]
        if n == 1:
            keep &= codes != 32
        if n in NGRAMS:
            idx.append(which[: len(h)][keep])
            buckets.append((mix64(h[keep] + np.uint64(n << 56)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    if not idx:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    idx, buckets = np.concatenate(idx), np.concatenate(buckets)
    order = np.argsort(idx, kind="stable")
    return idx[order], buckets[order]


def _word_buckets(words: list[str]) -> list[np.ndarray]:
    idx, buckets = ngram_buckets(words)
    return np.split(buckets.astype(np.uint16), np.cumsum(np.bincount(idx, minlength=len(words)))[:-1])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter in the sense of words_of."""
    return np.array([(c := chr(i)).isalnum() and not c.isdecimal() for i in range(0x110000)])


def word_places(texts: list[str], known: Runs) -> tuple[np.ndarray, np.ndarray]:
    """The run numbers of all words of all texts in order, and the end of each text's words among them."""
    low = [t.lower() for t in texts]
    text, ends = " ".join(low), np.cumsum([len(t) + 1 for t in low])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = _letters()[codes]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    return known.places(span_hashes(codes, start, stop), sliced(text, start, stop)), np.searchsorted(start, ends)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, idf and scale included
    bias: np.ndarray
    temperature: float = 1.0
    figures: dict = field(default_factory=dict)

    def word_scores(self, words: list[str]) -> list[np.ndarray]:
        """For each word: its sum of weights by language, then its number of n-grams."""
        idx, buckets = ngram_buckets(words)
        out = np.zeros((len(words), len(self.languages) + 1))
        count = np.bincount(idx, minlength=len(words))
        if len(idx):
            some = np.flatnonzero(count)
            out[some, :-1] = np.add.reduceat(self.weights[buckets], np.concatenate([[0], np.cumsum(count[some])[:-1]]), axis=0)
        out[:, -1] = count
        return list(out)

    def predict(self, texts: list[str], known: Runs | None = None) -> list[tuple[str, float]]:
        """Language and probability of each text; of equally probable languages the first by name."""
        known = known or Runs(self.word_scores, np.float64, CACHE_WORDS)
        out = []
        for at in chunks(texts, CHUNK):
            places, ends = word_places(texts[at], known)
            width = len(self.languages) + 1
            rows, count = known.gather(places)[0].reshape(-1, width), np.diff(ends, prepend=0)
            sums = np.zeros((len(count), width))
            some = np.flatnonzero(count)
            if len(some):
                sums[some] = np.add.reduceat(rows, (ends - count)[some], axis=0)
            for s in sums:
                if not s[-1]:
                    out.append((UNDETERMINED, 0.0))
                    continue
                z = (s[:-1] / s[-1] + self.bias) / self.temperature
                p = np.exp(z - z.max())
                p /= p.sum()
                k = int(p.argmax())
                out.append((self.languages[k], float(p[k])))
        return out


def plain_prediction(model: LanguageModel, text: str) -> tuple[str, float]:
    """What predict gives for one text, word by word and n-gram by n-gram; for tests."""
    score, n = np.zeros(len(model.bias)), 0
    for word in words_of(text):
        for b in ngram_buckets([word])[1]:
            score, n = score + model.weights[b], n + 1
    if not n:
        return UNDETERMINED, 0.0
    z = (score / n + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.languages[int(p.argmax())], float(p.max())


def train_mask(key: Column) -> Column:
    """Rows that may be learned from: crc32 of the key as text is not 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 != 2, F.lit(True))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over every row of the one-column frame: texts per bucket, and texts."""

    def count(batches):
        import pyarrow as pa

        known = Runs(_word_buckets, np.uint16, CACHE_WORDS)
        df, n = np.zeros(BUCKETS, np.int64), 0
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in chunks(texts, CHUNK):
                places, ends = word_places(texts[at], known)
                buckets, stops = known.gather(places)
                stops = np.concatenate([[0], stops])[ends]
                for own in np.split(buckets, stops[:-1]):
                    seen[own] = True
                    df += seen
                    seen[own] = False
                n += len(ends)
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()]), pa.array([n], pa.int64())], names=["df", "n"])

    def add(batches):
        import pyarrow as pa

        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for raw, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                df, n = df + np.frombuffer(raw, np.int64), n + k
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()]), pa.array([n], pa.int64())], names=["df", "n"])

    kind = "df binary, n bigint"
    rows = spread(texts).transform(batchwise(count, kind)).repartition(16).transform(batchwise(add, kind)).collect()
    return sum((np.frombuffer(r["df"], np.int64) for r in rows), np.zeros(BUCKETS, np.int64)), sum(r["n"] for r in rows)


def _features(rows: DataFrame) -> list:
    """Collects (lang, u, distinct buckets, shares) of a bounded sample."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bs, ts = [], []
            for t in batch.column(2).to_pylist():
                _, b = ngram_buckets(words_of(t))
                b, n = np.unique(b, return_counts=True)
                bs.append(b.astype("<u2").tobytes())
                ts.append((n / max(1, n.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bs, pa.binary()), pa.array(ts, pa.binary())], names=["lang", "u", "b", "x"])

    return sorted(rows.transform(batchwise(run, "lang string, u double, b binary, x binary")).collect(), key=lambda r: (r["u"], r["lang"], r["b"]))


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 1500,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 1e-4,
) -> LanguageModel:
    """Learn from the text and non-null lang of rows that train_mask lets through.

    The document frequencies are counted over all such rows. The regression is fitted on a sample of
    about `per_language` rows of each language, drawn by a hash of the key; every fifth row of it
    only sets the temperature. Without any such row there are no languages, and all is undetermined.
    """
    rows = docs.where(train_mask(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    u = (F.pmod(F.xxhash64(F.coalesce(F.col("k"), F.lit("")), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, per_language / n))) for k, n in counts.items()))
    sample = rows.select("lang", u, "t").where(F.col("u") < F.element_at(share, F.col("lang")))
    df, n_docs = document_frequencies(rows.select("t"))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    # 6 bytes for each n-gram of the sample
    data = [(languages.index(r["lang"]), np.frombuffer(r["b"], "<u2"), np.frombuffer(r["x"], "<f4")) for r in _features(sample) if len(r["b"])]
    kept = [d for i, d in enumerate(data) if i % 5 == 4] or data
    data = [d for i, d in enumerate(data) if i % 5 != 4] or data

    # Follow the regularised leader: per-coordinate sums z of gradients and n of their squares; the last bucket is the bias.
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def solved(zb, nb):
        return np.where(np.abs(zb) <= l1, 0.0, -(zb - np.sign(zb) * l1) / ((beta + np.sqrt(nb)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            y, b, x = data[i]
            b, x = np.append(b.astype(np.int64), BUCKETS), np.append(x * (SCALE * idf[b]), 1.0)
            zb, nb = z[b], n[b]
            w = solved(zb, nb)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            z[b] = zb + g - step * w
            n[b] = nb + g * g
    w = solved(z, n)

    logits = np.array([(x * (SCALE * idf[b])) @ w[b] + w[BUCKETS] for _, b, x in kept]).reshape(len(kept), k)
    ys = np.array([y for y, _, _ in kept], np.int64)

    blur = k / (len(ys) + 2.0 * k)  # as if some rows were mislabelled, so that separable rows don't ask for certainty

    def loss(log_t: float) -> float:
        s = logits / math.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        aim = (1 - blur) * s[np.arange(len(ys)), ys] + blur * s.mean(axis=1)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - aim)) if len(ys) else 0.0

    lo, hi = math.log(0.05), math.log(20.0)
    for _ in range(60):  # golden section; the loss is unimodal in the log temperature
        a, c = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, c) if loss(a) < loss(c) else (a, hi)
    right = float(np.mean(logits.argmax(axis=1) == ys)) if len(ys) else 1.0
    figures = {"nonzero": int((w[:BUCKETS] != 0).sum()), "kept_accuracy": right, "rows": len(data)}
    return LanguageModel(languages, w[:BUCKETS] * (SCALE * idf)[:, None], w[BUCKETS], math.exp((lo + hi) / 2), figures)


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, keep..., lang_pred, score), one for each row; 'und' with score 0 if its text is null or has no letter.

    score: calibrated probability of the predicted language; of equally probable ones the first by name
    is predicted. Lang, source and key are not inputs, so rows that repeat a text are predicted alike.
    A text is scored whole, a very long one by itself. A model without languages finds all undetermined.
    An empty table gives no rows. Other columns than those in `keep` are ignored, whatever their names.
    """
    if not model.languages:
        return docs.select(key, *keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input
    cols = [key, *keep] if text in (key, *keep) else [key, *keep, text]
    at, kept = cols.index(text), 1 + len(keep)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        known = Runs(model.word_scores, np.float64, CACHE_WORDS)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                got = model.predict([t or "" for t in batch.column(at).to_pylist()], known)
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*(f"c{i}" for i in range(kept)), "lang_pred", "score"])

    rows = spread(docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(cols))))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(cols[:kept]))
    return rows.transform(batchwise(run, f"{kinds}, lang_pred string, score double")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(cols[:kept])), "lang_pred", "score")
