import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foliary.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "quick ", "naïve", "été\n", "  x", "42", "don't", "　", "\x1c"]) for _ in range(rng.choice([0, 1, 30, 400, 3000])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "a <|endoftext|> b"), (3, rows[3][1]), (203, "é" * 5000), (None, "no id")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(2)
    got = packing.pack(frame, FILE, ranks_path=RANKS, capacity=256, group_tokens=20_000, with_ids=True).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(d), tok.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows)
    pieces = {}
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    seen = []
    for (d, n), rs in pieces.items():
        rs.sort(key=lambda r: r.start)
        copies = sum(r.start == 0 for r in rs)
        assert sum(r.length for r in rs) == n * copies
        if copies == 1:
            assert [r.start for r in rs] == list(np.cumsum([0] + [r.length for r in rs[:-1]]))
            seen.append((d, [x for r in rs for x in r.ids]))
    assert [x for x in want if x in seen] == sorted(seen) and len(seen) >= len(rows) - 2
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts[:-1]])) and sum(n for _, n in parts) <= 256
    assert sum(r.length for r in got) > 0.97 * 256 * len(sequences)


def test_balance():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    out = packing.balance(lengths, 100, 1.0, 0.01)
    cost, used = {}, {}
    for _, _, n, s, _ in out:
        cost[s] = cost.get(s, 0) + n + 0.01 * n * n
        used[s] = used.get(s, 0) + n
    assert max(used.values()) <= 100 and len(used) == -(-sum(lengths) // 100)
    assert packing.balance([], 100, 1.0, 1.0) == []


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_balance_takes_the_cheapest_with_room():
    def naive(lengths, capacity, linear, quadratic):
        n_seq = -(-sum(lengths) // capacity)
        room, cost, out = [capacity] * n_seq, [0.0] * n_seq, []
        for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            start, left = 0, lengths[item]
            while left:
                fit = [s for s in range(n_seq) if room[s] >= left] or [s for s in range(n_seq) if room[s]]
                s = min(fit, key=lambda s: (cost[s], s))
                take = min(left, room[s])
                out.append((item, start, take, s, capacity - room[s]))
                room[s], cost[s] = room[s] - take, cost[s] + linear * take + quadratic * take * take
                start, left = start + take, left - take
        return out

    rng = random.Random(4)
    for capacity, most, n in [(100, 100, 500), (100, 60, 700), (64, 64, 900), (7, 20, 200)]:
        lengths = [rng.randint(1, most) for _ in range(n)]
        assert packing.balance(lengths, capacity, 1.0, 1.0 / 64) == naive(lengths, capacity, 1.0, 1.0 / 64)


def test_ids_of_any_text():
    enc, tok = packing.Encoder(FILE, RANKS, "<|endoftext|>", 50256), Tokenizer.from_file(FILE)
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" + " \n" * 300_000 + "b", "x" * 200_000, "é" * 50_000, "<|endoftext|>" * 3 + " ", "1234567" * 9, "\u3000\x00 \u200b", ""):
        assert enc(text) == tok.encode(text, add_special_tokens=False).ids
    plain = packing.Encoder(FILE, None, "<|endoftext|>", 50256)
    assert plain("a <|endoftext|> b") == enc("a <|endoftext|> b")


def test_very_long_white_space(spark):
    frame = spark.createDataFrame([(1, " " * 1_000_000), (2, "after")], "doc_id long, text string")
    want = len(Tokenizer.from_file(FILE).encode(" " * 1_000_000, add_special_tokens=False).ids) + 1
    got = packing.pack(frame, FILE, ranks_path=RANKS).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {1: want, 2: len(Tokenizer.from_file(FILE).encode("after").ids) + 1}


def test_query_on_a_whole_table(spark):
    """Each document's ids by the named tokenizer file lie in its pieces once; sequences hold at most 1024, without gaps."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from foliary.llm import queries

    path = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = sorted(queries.op10_packing(spark, path).collect(), key=lambda r: (r.doc_id, r.start))
    done, sequences = dict.fromkeys(ids, 0), {}
    for r in rows:
        assert r.start == done[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        done[r.doc_id] += r.length
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert done == {d: len(x) for d, x in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= sum(map(len, ids.values())) / 1024 * 1.05 + 1
