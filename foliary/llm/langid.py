"""Language identification by word-first backoff (operator 1).

A known word counts with its frequency in each language, on a log scale. An unseen word falls back to its character
n-grams, from the longest down, and takes the mean of those of the first length at which any is known. A document's
score for a language is the mean over its words; the best language wins, ties go to the one first in code-point order.

The model is learned from the whole texts of a bounded sample of `max_docs` documents, the same number of each language where
there are so many, drawn by a hash of the id at rates that the languages' counts fix. All words and n-grams of the sample are
kept, unless words_per_lang or grams_per_lang say otherwise; so what is broadcast follows the sample and not the table. Words
and n-grams stand in the model by 64-bit hashes, sorted, each with the languages that have it.

Null texts, and texts without a letter, are `und` with score 0, as is every text if there is nothing to learn from.
Repeated rows are judged each for itself. Columns of the documents may have any names; one named as the result column is
replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.llm.common import Scratch, portions, tidy

_WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 300_000
FLUSH = 300_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


class Framed:
    """Words with a space on either side, as one run of code points."""

    def __init__(self, words: list[str]) -> None:
        framed = [f" {w} " for w in words]
        self.code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, framed), dtype=np.int64, count=len(words)))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram: the word it is of, and its hash."""
        if len(self.code) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(len(self.code) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ (h >> np.uint64(31))) * _M1 + self.code[k : len(self.code) - n + 1 + k]
        h = (h ^ (h >> np.uint64(29))) * _M2
        inside = self.owner[: len(h)] == self.owner[n - 1 :]
        return self.owner[: len(h)][inside], (h ^ (h >> np.uint64(32)))[inside]


class _Table:
    """Sorted hashes; of each, the languages that have it and how much less than the penalty it costs there."""

    def __init__(self, hashes: np.ndarray, langs: np.ndarray, gain: np.ndarray) -> None:
        order = np.lexsort((langs, hashes))
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.ends = np.append(first, len(hashes))
        self.langs, self.gain = langs[order].astype(np.int32), gain[order].astype(np.float32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their rows; -1 for those that are not known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, rows: np.ndarray, owner: np.ndarray, out: np.ndarray, share: np.ndarray) -> None:
        """Takes what rows gain, times share, off the costs of their owners."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        each = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.ends[rows][each]
        place = owner[each] * out.shape[1] + self.langs[at]
        out -= np.bincount(place, weights=self.gain[at] * share[each], minlength=out.size).reshape(out.shape)


class Model:
    """Costs (negative log10 of relative frequencies, at most the penalty) of words and n-grams, by language."""

    def __init__(self, lang: np.ndarray, n: np.ndarray, hashes: np.ndarray, count: np.ndarray, langs: list[str], longest: int, penalty: float = 7.0) -> None:
        """Entries (lang as a place in the sorted langs, n with 0 for words, hash, count); totals are over the entries."""
        self.langs, self.penalty = langs, penalty
        self.tables = []
        for length in range(longest + 1):
            mine = n == length
            total = np.bincount(lang[mine], weights=count[mine], minlength=max(1, len(langs)))
            gain = np.maximum(0.0, penalty + np.log10(count[mine] / np.maximum(1, total[lang[mine]]))) if mine.any() else np.zeros(0)
            self.tables.append(_Table(hashes[mine], lang[mine], gain))

    def costs(self, words: list[str]) -> np.ndarray:
        """A row of costs for each word."""
        out = np.full((len(words), len(self.langs)), self.penalty)
        rows = self.tables[0].find(word_hashes(words))
        known = np.flatnonzero(rows >= 0)
        self.tables[0].add(rows[known], known, out, np.ones(len(known)))
        open_ = np.flatnonzero(rows < 0)
        for n in range(len(self.tables) - 1, 0, -1):
            if not len(open_):
                break
            owner, hashes = Framed([words[i] for i in open_.tolist()]).grams(n)
            rows = self.tables[n].find(hashes)
            owner, rows = owner[rows >= 0], rows[rows >= 0]
            times = np.bincount(owner, minlength=len(open_))
            self.tables[n].add(rows, open_[owner], out, 1.0 / times[owner])
            open_ = open_[times == 0]
        return out


class Identifier:
    """Judges texts; keeps the costs of words that it has met, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.most = max(1000, min(CACHE_WORDS, 20_000_000 // max(1, len(model.langs))))
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}  # places in the table; place 0 is for words without a letter
        self.table = np.zeros((1024, len(self.model.langs)))
        self.used = 1

    def _learn(self, docs: list[list[str]]) -> None:
        known = self.at
        new = list(dict.fromkeys(w for words in docs for w in words if w not in known))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            lettered = [w for w in part if any(map(str.isalpha, w))]
            known.update((w, 0) for w in part)
            while self.used + len(lettered) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(lettered)] = self.model.costs(lettered)
            known.update(zip(lettered, range(self.used, self.used + len(lettered)), strict=True))
            self.used += len(lettered)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        docs = [words_of(t) for t in texts]
        if len(self.at) > self.most:
            self._reset()
        self._learn(docs)
        out = []
        for words in docs:
            at = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
            at = at[at > 0]
            if not len(at):
                out.append(("und", 0.0))
                continue
            cost = self.table[at].mean(axis=0)
            like = 10.0 ** (cost.min() - cost)
            best = int(cost.argmin())
            out.append((self.model.langs[best], float(like[best] / like.sum())))
        return out


def _counts(batches, longest: int):
    """Partial counts of words (n = 0) and n-grams, by their hashes."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("hash", pa.int64()), ("count", pa.int64())])

    def out(lang: str, seen: Counter) -> Iterator[pa.RecordBatch]:
        words, times = list(seen), np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
        framed = Framed(words)
        for n in range(longest + 1):
            owner, hashes = framed.grams(n) if n else (np.arange(len(words)), word_hashes(words))
            found, at = np.unique(hashes, return_inverse=True)
            count = np.bincount(at, weights=times[owner], minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), n, np.int32)), pa.array(found.view(np.int64)), pa.array(count)], schema=schema)

    seen: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            mine = seen.setdefault(lang.as_py(), Counter())
            mine.update(words_of(text.as_py()))
            if len(mine) > FLUSH or len(seen) > 1000:
                for name, counts in seen.items():
                    yield from out(name, counts)
                seen = {}
    for name, counts in seen.items():
        yield from out(name, counts)


def fit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 8000, longest: int = 5, words_per_lang: int | None = None,
    grams_per_lang: int | None = None, seed: int = 11,
) -> Model:
    """Learns from the whole texts of about max_docs documents, dealt evenly to the languages.

    With more languages than max_docs some are not drawn. words_per_lang and grams_per_lang keep the most frequent of each
    length only, if they are given.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_t"), F.col(f"`{lang_col}`").cast("string").alias("_l")).where("_l is not null and _t is not null")
    # staged, so that the planner knows how small they are and does not move the documents by their language
    scratch = Scratch(docs.sparkSession, "languages")
    sizes = scratch.stage(known.groupBy("_l").count(), "sizes")
    n_langs = sizes.count()
    if not n_langs:
        return Model(*(np.zeros(0, np.int64) for _ in range(4)), [], longest)
    rates = sizes.select("_l", F.least(F.lit(1.0), F.lit(max_docs / n_langs) / F.col("count")).alias("_rate"))
    draw = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000))
    # drawn ids first, since they are few and bounded, so that texts of the sample alone are moved
    chosen = known.select("_id", "_l").join(rates, "_l").where(draw < F.col("_rate") * 1_000_000).select("_id", "_l").distinct()
    chosen = chosen.select(F.col("_id").alias("_of"), F.col("_l").alias("_in"))
    sample = known.join(F.broadcast(chosen), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_l") == F.col("_in"))).select("_l", "_t")
    sample = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # a bounded sample, wherever its rows lie
    partial = sample.mapInArrow(lambda it: _counts(it, longest), "lang string, n int, hash long, count long")
    summed = partial.groupBy("lang", "n", "hash").agg(F.sum("count").alias("count"))
    if words_per_lang or grams_per_lang:
        most = F.when(F.col("n") == 0, words_per_lang or 1 << 60).otherwise(grams_per_lang or 1 << 60)
        summed = summed.withColumn("r", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "hash"))).where(F.col("r") <= most).drop("r")
    found = summed.toArrow()
    scratch.close()
    langs = sorted(x for x in found.column("lang").unique().to_pylist())
    at = {lang: k for k, lang in enumerate(langs)}
    coded = found.column("lang").combine_chunks().dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
    lang = np.array([at[x] for x in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int64)
    return Model(lang, found.column("n").to_numpy(), found.column("hash").to_numpy().view(np.uint64), found.column("count").to_numpy(), langs, longest)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "_lang") -> DataFrame:
    """The rows of docs with a struct column `out` of lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = Identifier(shared.value)
        for texts in batches:
            found = [x for part in portions(texts) for x in judge(part)]
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], F.arrow_udf(run, kind)(F.col(f"`{text_col}`").cast("string")).alias(out))
