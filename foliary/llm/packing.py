"""Cost-balanced sequence packing (operator 10).

A document is its token ids and an end id. Whole runs of `capacity` ids become sequences of their own; what
remains of each document is dealt, dearest first, to the cheapest sequence that has room, where a run of n ids
costs linear * n + quadratic * n * n. Everything happens within an input partition, in groups of a bounded number
of ids, so nothing is shuffled and memory does not follow the input.

Null text counts as the empty text, whose document is the end id alone. Repeated rows are packed each for itself.
Texts of any length and kind are encoded whole. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.common import tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts as the named tokenizer file gives them, special strings matched.

    With the same vocabulary as ranks they come five times as fast from another library. That one gives up on some texts,
    such as a million line ends on end; those go to the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, special: str, special_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id})

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast:
            try:
                return self.fast.encode(text, allowed_special="all")
            except ValueError:  # its pattern ran out of stack
                pass
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str | None, special: str, special_id: int) -> Encoder:
    return Encoder(tokenizer_path, ranks_path, special, special_id)


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Deals runs of ids to the fewest sequences that can hold them: (item, start, length, sequence, offset).

    Items go in descending cost, ties by position. Each takes the cheapest sequence with room for all of it; if none has
    that, it is cut to the room of the cheapest and its rest goes on. Sequences lie in heaps by room, and a tree over
    the rooms holds the least of each range.
    """
    n_seq = -(-sum(lengths) // capacity)
    room = [capacity] * n_seq
    size = 1 << capacity.bit_length()
    none = (float("inf"), -1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    heaps[capacity] = [(0.0, s) for s in range(n_seq)]
    least = [none] * (2 * size)

    def renew(r: int) -> None:
        i = size + r
        least[i] = heaps[r][0] if heaps[r] else none
        while i > 1:
            i //= 2
            least[i] = min(least[2 * i], least[2 * i + 1])

    def cheapest(r: int) -> tuple[float, int]:
        """Of the sequences with room for r ids or more."""
        i = size + r
        found = least[i]
        while i > 1:
            if i % 2 == 0:
                found = min(found, least[i + 1])
            i //= 2
        return found

    renew(capacity)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            cost, s = cheapest(left) if left <= capacity else none
            if s < 0:
                cost, s = least[1]
            heapq.heappop(heaps[room[s]])
            renew(room[s])
            take = min(left, room[s])
            out.append((item, start, take, s, capacity - room[s]))
            room[s] -= take
            start, left = start + take, left - take
            if room[s]:
                heapq.heappush(heaps[room[s]], (cost + linear * take + quadratic * take * take, s))
                renew(room[s])
    return out


class _Group:
    """Pieces of the documents of one group; sequence ids go on from `first`."""

    def __init__(self, capacity: int, linear: float, quadratic: float, with_ids: bool) -> None:
        self.capacity, self.linear, self.quadratic, self.with_ids = capacity, linear, quadratic, with_ids
        self.rests: list[tuple] = []
        self.rows: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray, sequence: int) -> int:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self._row(doc_id, at, ids[at : at + self.capacity], len(ids), sequence, 0)
            sequence += 1
        if whole < len(ids):
            self.rests.append((doc_id, whole, ids[whole:], len(ids)))
        self.tokens += len(ids)
        return sequence

    def _row(self, doc_id, start, ids, total, sequence, offset) -> None:
        row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset)
        self.rows.append((*row, ids.astype("int64").tolist()) if self.with_ids else row)

    def close(self, sequence: int, schema: pa.Schema) -> tuple[pa.RecordBatch, int]:
        used = 0
        for item, at, n, s, offset in balance([len(x[2]) for x in self.rests], self.capacity, self.linear, self.quadratic):
            doc_id, start, ids, total = self.rests[item]
            self._row(doc_id, start + at, ids[at : at + n], total, sequence + s, offset)
            used = max(used, s + 1)
        cols = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(schema)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)
        self.rests, self.rows, self.tokens = [], [], 0
        return batch, sequence + used


def pack(
    docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, special: str = "<|endoftext|>",
    special_id: int = 50256, linear: float = 1.0, quadratic: float = 1.0 / 1024, group_tokens: int = 4_000_000, with_ids: bool = False,
) -> DataFrame:
    """One row per piece. Columns: SCHEMA, and with `with_ids` the ids themselves.

    tokenizer_path names a file of `tokenizers`; ranks_path the same vocabulary as ranks, if there is one. Both lie on every executor.
    """
    schema = SCHEMA + (", ids array<long>" if with_ids else "")

    @tidy
    def run(batches):
        enc = encoder(tokenizer_path, ranks_path, special, special_id)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        arrow = pa.schema([(n, pa.int64()) for n in names] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
        sequence = TaskContext.get().partitionId() << 40
        group = _Group(capacity, linear, quadratic, with_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sequence = group.add(doc_id, np.asarray([*enc(text.as_py()), end_id], dtype="<u4"), sequence)
                if group.tokens >= group_tokens:
                    out, sequence = group.close(sequence, arrow)
                    yield out
        out, sequence = group.close(sequence, arrow)
        yield out

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
