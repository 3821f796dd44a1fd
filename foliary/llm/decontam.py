"""Benchmark decontamination by a generalised suffix automaton (operator 9).

The words of all test items form one automaton. A document's words are streamed through it and the longest match
ending at each word is tracked: a match of at least `window` words holds a window of some item, and an item of
fewer words counts as one window. Words inside such matches are hit; a span is a run of hit words. Runs of words that cannot hold a window, by
the items' word pairs, leave the automaton in its start state and are skipped in bulk.

An automaton is built of at most `max_words` words and kept in arrays. More items make more automata, which the documents
pass in turn, each in a pass over the documents of its own: a worker holds one of them at a time, whatever the table of items.

Decontamination has two limits. Documents that reach the coverage limit go. From the others, spans over the length limit are
cut, from their first word's first byte to their last word's last, and what is left is searched again, since a cut can
bring the halves of a passage together.

Null and empty texts have no words. An empty table of items, or items without words, hit nothing. Items sharing an
id count once. Repeated document rows are judged each for itself. Columns of the documents may have any names; one named as
the result column is replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.llm.common import Scratch, fresh, tidy

#: Bytes that are no part of a word become spaces, A-Z become a-z.
_FOLD = bytes((c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20) for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first word, number of words) of each run of hit words."""
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    begins = np.flatnonzero(edges == 1)
    return list(zip(begins.tolist(), (np.flatnonzero(edges == -1) - begins).tolist(), strict=True))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less those spans; what separates them from their neighbours stays."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_FOLD))]
    kept, end = [], 0
    for first, n in spans:
        kept.append(text[end : at[first][0]])
        end = at[first + n - 1][1]
    return b"".join([*kept, text[end:]])


class Automaton:
    """Suffix automaton of many word sequences, with the items of each window."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.items: list[str] = []
        self._sequences: list[tuple[int, list[int]]] = []
        self.n_words = 0

    def add(self, item_id: str, text: bytes | None) -> None:
        words = words_of(text or b"")
        if not words:
            return
        ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
        self._sequences.append((len(self.items), ids))
        self.items.append(item_id)
        self.n_words += len(ids)
        last = 0
        for c in ids:
            last = self._extend(last, c)

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the strings of q that extend p by c; q itself if it holds no longer ones."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        cur = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, self.next[p][c], c)
        return cur

    def finish(self) -> Searcher:
        return Searcher(self, self._sequences)


def _grouped(pairs: set[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct first members, where the rest of each begins and ends, and the rests."""
    rows = np.array(sorted(pairs) or np.zeros((0, 2)), dtype=np.int64)
    at, first = np.unique(rows[:, 0], return_index=True)
    return at, np.append(first, len(rows)), rows[:, 1:]


class Searcher:
    """A finished automaton in arrays: for each state its link and length, the items of its windows and the short items that end in it."""

    def __init__(self, built: Automaton, sequences: list[tuple[int, list[int]]]) -> None:
        w = self.window = built.window
        self.vocab, self.items = built.vocab, built.items
        n, length, link = len(built.vocab), built.len, built.link
        self.length, self.link = np.array(length, dtype=np.int32), np.array(link, dtype=np.int32)
        size = sum(map(len, built.next))
        keys = np.fromiter((v * n + c for v, nxt in enumerate(built.next) for c in nxt), dtype=np.int64, count=size)
        to = np.fromiter((t for nxt in built.next for t in nxt.values()), dtype=np.int32, count=size)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        windows: set[tuple[int, int]] = set()
        short: set[tuple[int, int, int]] = set()
        for item, ids in sequences:
            v = 0
            for i, c in enumerate(ids):
                v = built.next[v][c]
                if i + 1 >= w or i + 1 == len(ids) < w:
                    m, u = min(w, len(ids)), v
                    while length[link[u]] >= m:
                        u = link[u]
                    if m == w:
                        windows.add((u, item))
                    else:
                        short.add((u, m, item))
        self.windows, self.short = _grouped(windows), _grouped(short)
        # the state at or above each along the links that holds the window of its last words, and one that short items end in
        self.window_state, self.short_state = np.full(len(length), -1, np.int32), np.full(len(length), -1, np.int32)
        short_at = set(self.short[0].tolist())
        for v in np.argsort(self.length, kind="stable").tolist():
            if v:
                up = link[v]
                self.window_state[v] = v if length[up] < w <= length[v] else self.window_state[up]
                self.short_state[v] = v if v in short_at else self.short_state[up]
        self.least = min([w, *(len(ids) for _, ids in sequences)])
        self.pairs = np.unique(np.array([a * n + b for _, ids in sequences for a, b in zip(ids, ids[1:], strict=False)], dtype=np.int64))

    def _runs(self, ids: np.ndarray):
        """Runs of at least `least` words whose neighbours are all word pairs of items."""
        known = ids >= 0
        if self.least >= 2 and len(self.pairs):
            at = np.flatnonzero(known[:-1] & known[1:])
            codes = ids[at] * len(self.vocab) + ids[at + 1]
            where = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            joined = np.zeros(len(ids) + 1, dtype=np.int8)
            joined[at[self.pairs[where] == codes] + 1] = 1
            edges = np.diff(joined)
            begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        else:
            edges = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
            begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a + 1 >= self.least:
                yield a, b + 1

    def _step(self, v: int, c: int) -> int:
        key = v * len(self.vocab) + c
        at = int(self.keys.searchsorted(key))
        return int(self.to[at]) if at < len(self.keys) and self.keys[at] == key else -1

    @staticmethod
    def _of(table, v: int) -> list[list[int]]:
        at = int(table[0].searchsorted(v))
        return table[2][table[1][at] : table[1][at + 1]].tolist()

    def scan(self, words: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        """Sets hit where words lie in an occurrence of a window, and adds the ids of the windows' items."""
        if not self.items or len(words) < self.least:
            return
        get, link, length = self.vocab.get, self.link, self.length
        ids = np.fromiter((get(x, -1) for x in words), dtype=np.int64, count=len(words))
        met = set()
        for a, b in self._runs(ids):
            v = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                to = self._step(v, c)
                while v and to < 0:
                    v = int(link[v])
                    size = int(length[v])
                    to = self._step(v, c)
                if to >= 0:
                    v, size = to, size + 1
                if size >= self.window:
                    hit[i - self.window + 1 : i + 1] = True
                    if (u := int(self.window_state[v])) not in met:
                        met.add(u)
                        found.update(self.items[x] for (x,) in self._of(self.windows, u))
                u = int(self.short_state[v])
                while u >= 0:
                    for m, item in self._of(self.short, u):
                        if m <= size:
                            hit[i - m + 1 : i + 1] = True
                            found.add(self.items[item])
                    u = int(self.short_state[link[u]])


def automata(items: DataFrame, id_col: str, text_col: str, window: int, max_words: int) -> Iterator[Searcher]:
    """Automata of at most max_words words each (one item may exceed it); at least one."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("binary").alias("t")).where("t is not null")
    current = Automaton(window)
    some = False
    for row in rows.toLocalIterator():
        current.add("" if row.i is None else row.i, bytes(row.t))
        if current.n_words >= max_words:
            yield current.finish()
            current, some = Automaton(window), True
    if current.items or not some:
        yield current.finish()


_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.LongType())]))
_HITS = T.StructType([T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))])
_SPAN_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
_HITS_ARROW = pa.struct([("spans", _SPAN_ARROW), ("items", pa.list_(pa.string()))])


def _judge(chunk, last: bool, num: int, den: int, most: int, spans: bool, alone: bool):
    """A function of (text, hits so far) that adds one automaton's hits; the last one gives the result, others the hits."""
    arrow = _HITS_ARROW
    kind = _HITS
    if last:
        arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
        kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
        if spans:
            arrow = pa.struct([*arrow, ("spans", _SPAN_ARROW), ("cleaned", pa.string())])
            kind = T.StructType([*kind, T.StructField("spans", _SPAN), T.StructField("cleaned", T.StringType())])

    def cleaned(text: bytes, hit: np.ndarray) -> str | None:
        cut = None
        while over := [x for x in spans_of(hit) if x[1] > most]:
            cut = text = without_spans(text, over)
            if not alone:
                break
            words = words_of(text)
            hit = np.zeros(len(words), dtype=bool)
            chunk.value.scan(words, hit, set())
        return cut if cut is None else cut.decode("utf-8", "replace")

    def judged(raw: bytes, before: dict | None) -> tuple:
        words = words_of(raw)
        hit, found = np.zeros(len(words), dtype=bool), set(before["items"] if before else ())
        for span in before["spans"] if before else ():
            hit[span["first"] : span["first"] + span["n"]] = True
        chunk.value.scan(words, hit, found)
        runs = [{"first": a, "n": b} for a, b in spans_of(hit)]
        if not last:
            return runs, sorted(found)
        n = int(hit.sum())
        bad = n > 0 and den * n >= num * len(words)
        more = (runs, cleaned(raw, hit) if n and not bad else None) if spans else ()
        return (len(words), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bad, *more)

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            texts, before = rows.field("text"), rows.field("hits")
            out = [judged(texts[i].as_py() or b"", before[i].as_py()) for i in range(len(rows))]
            cols = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], fields=list(arrow))

    # not deterministic, so that a filter on a field does not run it once more
    return F.arrow_udf(run, kind).asNondeterministic()


def scan(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, coverage: tuple[int, int] = (1, 20), max_words: int = 500_000,
    spans: bool = False, max_span: int | None = None, out: str = "_scan",
) -> DataFrame:
    """The rows of docs, each with a struct column `out`: n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: some word is hit, and hits are at least coverage[0] / coverage[1] of the words. With `spans` also
    spans, an array of (first, n) in words, and cleaned, the text less all spans of more than max_span words (by default
    window - 1) if there are any and the document is not contaminated, or else null. With one automaton cleaned is searched
    and cut until no such span is left; with several it is cut once.
    """
    return _scanned(docs, items, text_col, item_id, item_text, window, coverage, max_words, spans, max_span, out)[0]


def _scanned(docs, items, text_col, item_id, item_text, window, coverage, max_words, spans, max_span, out) -> tuple[DataFrame, bool]:
    """The result of scan, and whether one automaton held all items."""
    spark = docs.sparkSession
    own = [F.col(f"`{c}`") for c in docs.columns if c != out]
    hits = fresh(docs, "hits")
    most = window - 1 if max_span is None else max_span
    chunks, frame, scratch, k = automata(items, item_id, item_text, window, max_words), docs, None, 0
    now, ahead = next(chunks), next(chunks, None)
    alone = ahead is None
    while True:
        shared = spark.sparkContext.broadcast(now)
        judge = _judge(shared, ahead is None, *coverage, most, spans, alone)
        before = F.col(hits) if k else F.lit(None).cast(_HITS)
        given = judge(F.struct(F.col(f"`{text_col}`").cast("binary").alias("text"), before.alias("hits")))
        if ahead is None:
            return frame.select(*own, given.alias(out)), alone
        scratch = scratch or Scratch(spark, "scan")
        frame = scratch.stage(frame.select(*[F.col(f"`{c}`") for c in docs.columns], given.alias(hits)), f"pass-{k}")
        shared.destroy()
        if k:
            scratch.drop(f"pass-{k - 1}")
        k, now, ahead = k + 1, ahead, next(chunks, None)


def decontaminate(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", length_col: str | None = None, item_id: str = "item_id", item_text: str = "text", window: int = 13, coverage: tuple[int, int] = (1, 20), max_words: int = 500_000, max_span: int | None = None,
) -> DataFrame:
    """The documents that the coverage rule leaves, with their own columns and their texts less spans over the length limit.

    The rule judges a document as it comes; what cuts bring together is cut too, but not judged again. length_col, if named,
    follows the texts that are cut.
    """
    out = fresh(docs, "scan")

    def cut(frame: DataFrame, num: int, den: int) -> tuple[DataFrame, bool]:
        return _scanned(frame, items, text_col, item_id, item_text, window, (num, den), max_words, True, max_span, out)

    def applied(found: DataFrame) -> DataFrame:
        text = F.col(f"{out}.cleaned")
        new = {text_col: text.cast(docs.schema[text_col].dataType)}
        if length_col:
            new[length_col] = F.length(text).cast(docs.schema[length_col].dataType)
        return found.select(*[F.when(text.isNotNull(), new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])

    found, alone = cut(docs, *coverage)
    left = found.where(f"not {out}.contaminated")
    if alone:
        return applied(left)
    scratch, parts, k = Scratch(docs.sparkSession, "cuts"), [], 0
    while True:  # several automata: texts that were cut pass all of them once more
        left = scratch.stage(left, f"round-{k}")
        parts.append(left.where(f"{out}.cleaned is null").select(*[F.col(f"`{c}`") for c in docs.columns]))
        again = left.where(f"{out}.cleaned is not null")
        if again.isEmpty():
            return reduce(DataFrame.union, parts)
        left, k = cut(applied(again), 2, 1)[0], k + 1  # no share reaches twice the words
