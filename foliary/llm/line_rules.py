"""Quality rules, and a labelling of each text's lines as content or boilerplate by a linear-chain conditional random field (operator 13).

Rules count words, characters, symbols, repeated lines and the words that lie in 8-word windows found twice or more; a text with too
few words or too many repeated ones fails. Every other text's lines are decoded by Viterbi: a line's features (length, shares of
capitals, digits, symbols and separators, end of a sentence, repeats in its text) and the label of the line before decide whether
it is content, and a text is kept if at least `min_share` of its words lie in content lines.

The field is trained here, by stochastic gradient descent on the conditional likelihood (forward and backward sums), from document labels alone:
lines of good documents begin as content, those of bad ones as boilerplate; after a first training, in which neighbours do not count, lines of
bad documents that decode as content are relabelled and the whole field is trained. It learns from whole documents of a bounded sample: `max_docs` documents drawn
by a hash of the id, half of each class, taken in that order while they have at most `max_lines` lines in all. Features are computed in
tasks; the driver gets 4 bytes a line. Without documents of both classes every line is content.

Null and empty texts have no words and fail. Texts are worked on whole, in slices, so a very long one costs memory in proportion to its
words. Repeated rows are judged each for itself. An empty table gives no rows. Columns of documents may have any names; one named as the result
column is replaced by it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import Scratch, portions, tidy

SLICE = 1 << 20
WINDOW = 8
SYMBOLS = "#*$%&|<>"
# classes of characters
_OTHER, _SPACE, _NEWLINE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _PIPE, _SHOUT, _END = range(10)
_KINDS = 10


def _classes() -> np.ndarray:
    out = np.full(0x3000, _OTHER, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        if c.isalpha():
            out[i] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            out[i] = _DIGIT
    for chars, kind in ((" \t\v\f\r", _SPACE), ("\n", _NEWLINE), (SYMBOLS, _SYMBOL), ("|", _PIPE), ("!", _SHOUT), (".?:;…。！？", _END)):
        for c in chars:
            out[ord(c) if ord(c) < len(out) else 0] = kind
    out[0] = _OTHER
    return out


_CLASS = _classes()
#: What a line's features say, in the order of their bits.
FEATURES = (
    "always", "no word", "under 4 words", "over 40 words", "capitals a third of the letters", "nearly all capitals", "digits a fifth", "symbols a fiftieth", "symbols an eighth", "three pipes", "exclamation marks a thirtieth",
    "letters under three fifths", "ends a sentence", "begins small", "repeats a line", "half in repeated windows", "words over 11 characters", "words under 3 characters", "first", "last",
)


class Lines:
    """What the rules count in a text, and the features of its lines as bits."""

    def __init__(self, text: str | None) -> None:
        text = text or ""
        n_lines = text.count("\n") + 1
        counts = np.zeros((n_lines, _KINDS), np.int64)
        first, last, word_line = np.full(n_lines, _OTHER, np.uint8), np.full(n_lines, _OTHER, np.uint8), []
        line, before = 0, True  # whether what came before a slice was space
        begun = np.zeros(n_lines, bool)
        for i in range(0, len(text), SLICE):
            code = np.frombuffer(text[i : i + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = np.where(code < len(_CLASS), _CLASS[np.minimum(code, len(_CLASS) - 1)], np.uint8(_LOWER))
            new = kind == _NEWLINE
            at = line + np.cumsum(new) - new
            counts[line : at[-1] + 1] += np.bincount((at - line) * _KINDS + kind, minlength=(at[-1] - line + 1) * _KINDS).reshape(-1, _KINDS)
            space = new | (kind == _SPACE)
            starts = ~space & np.concatenate([[before], space[:-1]])
            word_line.append(at[starts])
            solid = np.flatnonzero(~space)
            last[at[solid]] = kind[solid]  # the last one written stays
            opened = solid[::-1][~begun[at[solid[::-1]]]]
            first[at[opened]] = kind[opened]
            begun[at[solid]] = True
            line, before = int(at[-1] + new[-1]), bool(space[-1])
        self.word_line = np.concatenate(word_line) if word_line else np.zeros(0, np.int64)
        self.words = np.bincount(self.word_line, minlength=n_lines)
        self.n_words = len(self.word_line)
        self.word_chars = int(counts.sum() - counts[:, [_SPACE, _NEWLINE]].sum())
        self.n_symbols = int(counts[:, [_SYMBOL, _PIPE]].sum())
        self.repeated = repeated_words(text.encode("utf-8", "surrogatepass").split())
        self.n_repeat_words = int(self.repeated.sum())
        lines, seen = text.split("\n"), set()
        again = np.zeros(n_lines, bool)
        for k in np.flatnonzero(self.words).tolist():
            if lines[k] in seen:
                again[k] = True
            else:
                seen.add(lines[k])
        self.n_dup_lines = int(again.sum())
        self.features = self._features(counts, first, last, again)

    def _features(self, counts, first, last, again) -> np.ndarray:
        words = self.words
        chars = np.maximum(counts.sum(axis=1) - counts[:, _SPACE] - counts[:, _NEWLINE], 1)
        letters = counts[:, _LOWER] + counts[:, _UPPER]
        symbols = counts[:, _SYMBOL] + counts[:, _PIPE]
        covered = np.bincount(self.word_line, weights=self.repeated, minlength=len(words))
        some = words > 0
        size = chars / np.maximum(words, 1)
        edge = np.arange(len(words))
        facts = [
            np.ones(len(words), bool), ~some, some & (words < 4), words > 40, some & (counts[:, _UPPER] * 3 > letters), some & (counts[:, _UPPER] * 10 > 9 * letters), counts[:, _DIGIT] * 5 > chars, symbols * 50 > chars, symbols * 8 > chars,
            counts[:, _PIPE] > 2, counts[:, _SHOUT] * 30 > chars, some & (letters * 5 < 3 * chars), some & ((last == _END) | (last == _SHOUT)), some & (first == _LOWER), again, some & (covered * 2 > words), some & (size > 11),
            some & (size < 3), edge == 0, edge == len(words) - 1,
        ]
        return sum(f.astype(np.uint32) << np.uint32(k) for k, f in enumerate(facts)).astype(np.uint32)


def repeated_words(words: list[bytes]) -> np.ndarray:
    """Of each word whether a window of WINDOW words in which it lies is found twice or more. Windows are compared exactly, by the ranks of their halves."""
    out = np.zeros(len(words), bool)
    if len(words) <= WINDOW:
        return out
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return out
    width = 1
    while width < WINDOW:
        both = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        _, rank, times = np.unique(both, return_inverse=True, return_counts=True)
        width *= 2
        if len(times) == len(rank):
            return out
    hit = np.concatenate([(times[rank] > 1).astype(np.int8), np.zeros(WINDOW, np.int8)])
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(rank)] += hit[: len(rank)]
    edges[WINDOW : WINDOW + len(rank)] -= hit[: len(rank)]
    return np.cumsum(edges)[: len(words)] > 0


class Field:
    """A linear chain over two labels (0 boilerplate, 1 content): weights of the features by label, of neighbours, and of the first label."""

    def __init__(self, weights=None, pairs=None) -> None:
        self.weights = np.zeros((len(FEATURES), 2)) if weights is None else np.array(weights, dtype=float)
        self.pairs = np.zeros((2, 2)) if pairs is None else np.array(pairs, dtype=float)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Each line's score for each label."""
        distinct, at = np.unique(features, return_inverse=True)
        bits = (distinct[:, None] >> np.arange(len(FEATURES), dtype=np.uint32)) & 1
        return (bits @ self.weights)[at]

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels; of equally likely ones, content."""
        lines = self.scores(features)
        if len(lines) == 1:
            return (lines[:, 1] >= lines[:, 0]).astype(np.int8)
        (s00, s01), (s10, s11) = self.pairs.tolist()
        came0, came1 = bytearray(len(lines)), bytearray(len(lines))
        a, b = lines[0].tolist()
        for k, (x, y) in enumerate(lines[1:].tolist(), 1):
            a0, a1, b0, b1 = a + s00, b + s10, a + s01, b + s11
            came0[k], came1[k] = a1 >= a0, b1 >= b0
            a, b = (a1 if a1 >= a0 else a0) + x, (b1 if b1 >= b0 else b0) + y
        out = bytearray(len(lines))
        now = int(b >= a)
        for k in range(len(lines) - 1, -1, -1):
            out[k] = now
            now = came1[k] if now else came0[k]
        return np.frombuffer(out, np.int8)

    def marginals(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each line the probability of each label, and of each pair of labels the expected number of neighbours that have it."""
        lines = self.scores(features)
        lines = np.exp(lines - lines.max(axis=1, keepdims=True)).tolist()
        step = np.exp(self.pairs).tolist()
        (t00, t01), (t10, t11) = step
        forth, back = [], [(1.0, 1.0)] * len(lines)
        a, b = lines[0]
        for k, (x, y) in enumerate(lines):
            if k:
                a, b = (a * t00 + b * t10) * x, (a * t01 + b * t11) * y
            total = a + b
            a, b = a / total, b / total
            forth.append((a, b))
        for k in range(len(lines) - 2, -1, -1):
            x, y = lines[k + 1]
            u, v = x * back[k + 1][0], y * back[k + 1][1]
            p, q = t00 * u + t01 * v, t10 * u + t11 * v
            back[k] = (p / (p + q), q / (p + q))
        f, g, e = np.array(forth), np.array(back), np.array(lines)
        one = f * g
        one /= one.sum(axis=1, keepdims=True)
        two = f[:-1, :, None] * np.array(step)[None] * (e[1:] * g[1:])[:, None, :]
        two /= two.sum(axis=(1, 2), keepdims=True)
        return one, two.sum(axis=0)

    def learn(self, chains: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float, decay: float, seed: int, chained: bool) -> None:
        """Gradient steps on the likelihood of the chains (features, labels), each divided by its length's root; without `chained`, neighbours do not count."""
        rng, done, steps = np.random.default_rng(seed), 0, epochs * len(chains)
        bit = np.arange(len(FEATURES), dtype=np.uint32)
        for _ in range(epochs):
            for i in rng.permutation(len(chains)).tolist():
                features, labels = chains[i]
                size = rate * (1 - done / steps) / math.sqrt(len(features))
                done += 1
                if chained:
                    one, two = self.marginals(features)
                else:
                    gap = np.diff(self.scores(features), axis=1)
                    one = 1 / (1 + np.exp(np.hstack([gap, -gap])))
                lack = np.eye(2)[labels] - one
                self.weights += size * (((features[:, None] >> bit) & 1).T @ lack - decay * self.weights)
                if chained:
                    seen = np.bincount(labels[:-1].astype(np.int64) * 2 + labels[1:], minlength=4).reshape(2, 2)
                    self.pairs += size * (seen - two - decay * self.pairs)

    def dumps(self) -> str:
        return json.dumps({"weights": self.weights.tolist(), "pairs": self.pairs.tolist()})


def train(samples: list[tuple[np.ndarray, int]], *, epochs: int, rate: float, decay: float, rounds: int, seed: int) -> Field | None:
    """The field learned from (features, class of the document); None without both classes."""
    if len({y for _, y in samples}) < 2:
        return None
    labels = [np.full(len(f), y, np.int8) for f, y in samples]
    for k in range(rounds):  # a document's lines all begin with one label, which says nothing of neighbours
        field = Field()
        field.learn(list(zip((f for f, _ in samples), labels, strict=True)), epochs, rate, decay, seed, chained=k > 0)
        labels = [np.ones(len(f), np.int8) if y else field.viterbi(f) for f, y in samples]
    return field


_FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long"
_TYPES = pa.struct([(x.split()[0], pa.int64()) for x in _FACTS.split(", ")])


def fit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 2000, max_lines: int = 20_000, epochs: int = 5, rate: float = 0.5, decay: float = 1e-3,
    rounds: int = 2, seed: int = 11,
) -> Field | None:
    """The field of a sample of labelled documents. A document with several labels takes its largest."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    rates = {r["_y"]: min(1.0, max_docs / 2 / r["count"]) for r in known.groupBy("_y").count().collect()}
    share = F.lit(0.0)
    for y, of in rates.items():
        share = F.when(F.col("_y") == y, F.lit(of)).otherwise(share)
    draw = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000))
    chosen = known.where(draw < share * 1_000_000)  # about max_docs rows
    drawn = docs.select(F.col(f"`{id_col}`").cast(known.schema["_id"].dataType).alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_t")).where(draw < max(rates.values(), default=0.0) * 1_000_000)

    @tidy
    def lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([Lines(t).features.tobytes() for part in portions(texts) for t in part], pa.binary())

    found = drawn.join(F.broadcast(chosen), "_id").select(F.xxhash64("_id", F.lit(seed + 1)).alias("at"), "_id", "_y", F.arrow_udf(lines, "binary")("_t").alias("f"))
    found = scratch.stage(found, "line-features")
    held, taken = 0, []
    for r in sorted(found.select("at", "_id", "_y", (F.octet_length("f") / 4).cast("long").alias("n")).collect(), key=lambda r: (r["at"], r["_id"], r["n"])):
        if held + r["n"] <= max_lines:
            held += r["n"]
            taken.append((r["at"], r["_id"], r["n"]))
    keep = set(taken)
    most = max((n for _, _, n in taken), default=0)
    rows = [r for r in found.where(F.octet_length("f") <= 4 * most).collect() if (r["at"], r["_id"], len(r["f"]) // 4) in keep]
    rows.sort(key=lambda r: (r["at"], r["_id"], bytes(r["f"])))
    return train([(np.frombuffer(bytes(r["f"]), np.uint32), r["_y"]) for r in rows], epochs=epochs, rate=rate, decay=decay, rounds=rounds, seed=seed)


def judge(docs: DataFrame, field: Field | None, *, text_col: str = "text", out: str = "_rules", min_words: int = 20, repeats: tuple[int, int] = (30, 100), min_share: float = 0.5) -> DataFrame:
    """The rows of docs with a struct column `out`: the counts, content_words, base_failed, content_share and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = shared.value
        for texts in batches:
            found = []
            for part in portions(texts):
                for text in part:
                    x = Lines(text)
                    content = x.n_words if field is None else int(x.words[field.viterbi(x.features) == 1].sum())
                    found.append((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, content))
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * _TYPES.num_fields
            yield pa.StructArray.from_arrays(columns, names=[f.name for f in _TYPES])

    facts = F.arrow_udf(run, f"struct<{_FACTS.replace(' long', ':long')}>")(F.col(f"`{text_col}`").cast("string"))

    def verdict(x: Column) -> Column:
        n = x["n_words"]
        failed = (n < min_words) | (repeats[1] * x["n_repeat_words"] > repeats[0] * n)
        share = F.when(n > 0, x["content_words"] / n).otherwise(0.0)
        names = [f.name for f in _TYPES]
        return F.struct(*[x[c].alias(c) for c in names], failed.alias("base_failed"), share.alias("content_share"), (~failed & (share >= min_share)).alias("kept"))

    own = [c for c in docs.columns if c != out]
    return docs.select(*[F.col(f"`{c}`") for c in own], facts.alias(out)).select(*[F.col(f"`{c}`") for c in own], verdict(F.col(f"`{out}`")).alias(out))


def keep_good(docs: DataFrame, field: Field | None, **how) -> DataFrame:
    """The documents that the rules and the labelled lines keep, with their own columns."""
    from foliary.llm.common import fresh

    found = fresh(docs, "_rules")
    return judge(docs, field, out=found, **how).where(F.col(f"{found}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
