"""Quality classifier on supervised subword embeddings (operator 5).

Words are runs of non-space characters, case and punctuation kept. A word's vector is the mean of the learned vectors
of its hash bucket and of the buckets of its character 3- to 5-grams; a pair of neighbouring words has one bucket.
A document is the mean of its words' and pairs' vectors, a softmax layer over that gives the classes. Both layers
are trained by stochastic gradient descent in numpy, on a bounded, class-balanced sample of labelled documents.
Since the output is linear before the softmax, scoring needs a table of class logits for each bucket and no more.

Texts are scored whole, however long, a few at a time. Null and empty texts have no words and get the score of the bias alone. Rows without a label take no part in
training; without two classes to learn from, every score is the share of label 1 (0.5 without any). Repeated rows
are scored each for itself. Columns of the documents may have any names; one named as the result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.llm.common import Scratch, fresh, portions, tidy

CACHE_WORDS = 150_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    return (h ^ (h >> np.uint64(29))) * _M2


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)


def word_features(words: list[str], buckets: int, grams=(3, 4, 5)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: (owner, bucket) for all its features, and the words' 64-bit hashes."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    framed = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, framed), dtype=np.int64, count=len(framed))
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, found = [np.arange(len(words))], [_bucket(_mix(hashes), buckets)]
    for n in grams:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + code[k : len(code) - n + 1 + k]
        inside = owner[: len(h)] == owner[n - 1 :]
        owners.append(owner[: len(h)][inside])
        found.append(_bucket(_mix(h[inside]), buckets))
    return np.concatenate(owners), np.concatenate(found), hashes


def _pairs(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of neighbouring words; a word that repeats itself has one bucket, whichever word it is."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64)
    a, b = hashes[:-1], hashes[1:]
    return _bucket(_mix(np.where(a == b, np.uint64(1), a * np.uint64(3) + b)), buckets)


def document_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their weights in its mean."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    distinct, at = np.unique(np.array(words, dtype=object), return_inverse=True)
    owner, bucket, hashes = word_features(distinct.tolist(), buckets)
    times = np.bincount(at, minlength=len(distinct))
    weight = (times / np.bincount(owner, minlength=len(distinct)))[owner]
    pairs = _pairs(hashes[at], buckets)
    bucket, weight = np.concatenate([bucket, pairs]), np.concatenate([weight, np.ones(len(pairs))])
    ids, where = np.unique(bucket, return_inverse=True)
    return ids.astype(np.int32), (np.bincount(where, weights=weight) / (len(words) + len(pairs))).astype(np.float32)


def train(samples: list[tuple[str | None, int]], *, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Class logits of each bucket, and of the empty document. Samples are visited in an order that the seed fixes."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    labels = np.array([y for _, y in samples], dtype=np.int64)
    counts = np.bincount(labels, minlength=2)
    if counts.min() == 0:
        share = counts[1] / counts.sum() if counts.sum() else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros((buckets, 2), np.float32), np.array([np.log(1 - share), np.log(share)], np.float32)
    weigh = counts.sum() / (2 * counts)
    docs = [document_features((t or "").split(), buckets) for t, _ in samples]
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)).tolist():
            ids, weight = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            rows = vectors[ids]
            hidden = weight @ rows
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weigh[labels[i]]
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            if len(ids):  # the mean's small weights are undone, so that a step does not shrink with the text
                vectors[ids] = rows - lr * np.outer(weight / max(weight.max(), 1e-9), back)
    return (vectors @ out).astype(np.float32), bias


class Scorer:
    """Scores texts; keeps the logits of words it has met, up to a bound."""

    def __init__(self, logits: np.ndarray, bias: np.ndarray) -> None:
        self.gain = (logits[:, 1] - logits[:, 0]).astype(np.float64)
        self.bias = float(bias[1] - bias[0])
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.of_word = np.zeros(0)
        self.hashes = np.zeros(0, np.uint64)

    def _learn(self, docs: list[list[str]]) -> None:
        known = self.at
        new = list(dict.fromkeys(w for words in docs for w in words if w not in known))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            owner, bucket, hashes = word_features(part, len(self.gain))
            mean = np.bincount(owner, weights=self.gain[bucket], minlength=len(part)) / np.bincount(owner, minlength=len(part))
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            self.of_word, self.hashes = np.concatenate([self.of_word, mean]), np.concatenate([self.hashes, hashes])

    def score(self, texts: list[str | None]) -> list[float]:
        out = []
        for i in range(0, len(texts), 256):
            docs = [(t or "").split() for t in texts[i : i + 256]]
            if len(self.at) > CACHE_WORDS:
                self._reset()
            self._learn(docs)
            get = self.at.__getitem__
            for words in docs:
                z = self.bias
                if words:
                    at = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
                    pairs = _pairs(self.hashes[at], len(self.gain))
                    z += (self.of_word[at].sum() + self.gain[pairs].sum()) / (len(words) + len(pairs))
                out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def fit(
    docs: DataFrame, labels: DataFrame, keep, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4000, max_bytes: int = 64 << 20, buckets: int = 1 << 17,
    dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Learns from about max_docs labelled rows of docs (half of each class where there are so many) that `keep` admits.

    The sample is drawn by a hash of the id, at a rate that the counts of the classes fix, so it is the same each time.
    A document with several labels takes its largest. Sampled texts are learned from whole. As they meet on the driver, documents are taken
    in the order of a digest while their texts have at most max_bytes in all, and those of more than a 64th of that are passed over.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    known = known.where(keep(F.col("_id")))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    rates = {y: min(1.0, max_docs / 2 / n) for y, n in counts.items()}
    share = F.lit(0.0)
    for y, rate_of in rates.items():
        share = F.when(F.col("_y") == y, F.lit(rate_of)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(1_000_000))
    chosen = known.where(draw < share * 1_000_000)
    # what no class would draw is left out before the texts are moved
    drawn = docs.select(F.col(id_col).cast(known.schema["_id"].dataType).alias("_id"), F.col(text_col).cast("string").alias("_t")).where(draw < max(rates.values(), default=0.0) * 1_000_000)
    text = F.coalesce("_t", F.lit(""))
    sample = drawn.join(F.broadcast(chosen), "_id").select("_id", "_y", "_t", F.octet_length(text).alias("_n"), F.sha2(F.concat_ws(" ", F.lit(seed), "_id", text), 256).alias("_at"))
    sample = Scratch(docs.sparkSession, "quality").stage(sample.where(F.col("_n") <= max_bytes // 64), "sample")
    held, last = 0, ""
    for r in sorted(sample.select("_at", "_n").collect()):  # a digest and a length of each document
        held += r["_n"]
        if held > max_bytes:
            break
        last = r["_at"]
    rows = sample.where(F.col("_at") <= last).select("_id", "_y", "_t").collect()
    rows.sort(key=lambda r: (r["_id"], r["_t"] or ""))
    return train([(r["_t"], r["_y"]) for r in rows], buckets=buckets, dim=dim, epochs=epochs, rate=rate, seed=seed)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """The rows of docs with a double column score_col, 0 to 1: how likely label 1 is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pa.array([s for part in portions(texts) for s in scorer.score(part)], pa.float64())

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col], F.arrow_udf(run, T.DoubleType())(F.col(f"`{text_col}`").cast("string")).alias(score_col))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.3, *, text_col: str = "text") -> DataFrame:
    """The documents that score at least the threshold, with their own columns."""
    found = fresh(docs, "quality")
    return score(docs, model, text_col=text_col, score_col=found).where(F.col(found) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
