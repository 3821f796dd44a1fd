"""Which sources of a language differ, and by which terms: an audit with exact integers (operator 11).

Terms are runs of letters (A-Z lower-cased alone). A language keeps the terms that at least `min_docs` of its documents hold. A
source's share of a term is p = 1 + floor(scale * (count + 1) / (N + V)), and the divergence of p from q is f = floor((p - q)^2 / q).

No pair of sources is ever summed over the whole vocabulary. A pair begins with V times f of two zero counts, and the inverted index
(the postings of each term: source and count) brings corrections for what is not zero alone. A term that one side lacks has a
correction that its count on the other side decides, so those come from the histogram of a source's counts, one for each distinct
count. Where both sides have a term, the posting gives what is left: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). Corrections that
are zero are not passed on, the others are summed before they are shuffled.

Documents are counted in tasks, which hold a bounded number of terms at a time; what is shuffled is a row for each (language, source,
term) and flush, so a source with very many documents is no hot key. Sources of a language are paired (the result has a row for each
pair) by a salted join, and postings find their source's totals with the large sources broadcast.

Null text, language and source count as ''. Empty texts have no terms, but make their group occur. Texts are counted whole, however
long. Each row is a document, repeated ones too. Equal values rank by the item's bytes. An empty table gives no rows; a language
without kept terms gives pairs of value 0 and no terms. Other columns of the documents may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.common import Scratch, spread_join, tidy

#: Letters stay, A-Z become a-z, all other ASCII separates; bytes of other scripts are letters.
FOLDED = bytes(c if c >= 0x80 or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))
HELD_TERMS, PIECE, SALTS = 200_000, 1 << 20, 16


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; cuts lie between terms."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while True:
            piece = text[start:end].translate(FOLDED)
            if end >= len(text):
                break
            if (cut := piece.rfind(b" ")) > 0:
                piece, end = piece[:cut], start + cut
                break
            end += len(piece)  # one term fills the piece
        yield piece.split()
        start = end


@tidy
def _counted(batches):
    """lang, source, term, n, df of the documents of a task; a group's row without a term says that it occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    names = ["lang", "source", "term", "n", "df"]

    def flushed():
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part]), pa.array([df[t] for t in part])], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.array([None], pa.string()), pa.array([0]), pa.array([0])], names=names)
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            n, df = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in term_lists(text.as_py()):
                n.update(words)
                new = set(words) - seen
                df.update(new)
                seen |= new
            size += len(n) - before
            if size >= HELD_TERMS:
                yield from flushed()
                size = 0
    yield from flushed()


def _share(count: str, total: str, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / total); the product does not fit a long, so it is a decimal."""
    return F.expr(f"1 + cast((cast({scale} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))) div cast(greatest({total}, 1) as decimal(20, 0)) as bigint)")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _pairs(left: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of left (lang, source, ...) with each other source of the language (other, q0), dealt by language and a hash of the source."""
    salt = F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return left.withColumn("_salt", salt).join(others, ["lang", "_salt"]).where("source <> other").drop("_salt")


def audit(
    docs: DataFrame, scratch: Scratch, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, scale: int = 1_000_000_000, top_terms: int = 200,
) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: how far each source is from the others of its language, and its terms that stand out most."""
    given = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = docs.select(given(lang_col).alias("lang"), given(source_col).alias("source"), given(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    counts = scratch.stage(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")

    of_term = Window.partitionBy("lang", "term")  # a term has a row for each source at most
    known = counts.where("term is not null").select("lang", "source", "term", "n", F.sum("df").over(of_term).alias("df"), F.sum("n").over(of_term).alias("n_lang"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    postings = scratch.stage(known.where(F.col("df") >= min_docs).drop("df"), "postings")
    of_source = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    of_lang = postings.groupBy("lang").agg(F.count_if("first").alias("V"), F.sum("n").alias("total_lang"))
    groups = counts.where("term is null").select("lang", "source").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = scratch.stage(groups.withColumn("p0", _share("0", "total + V", scale)), "groups")
    scratch.drop("counts")

    scored = spread_join(postings, groups.where("n_terms > 0"), ["lang", "source"], "n_terms")
    scored = scratch.stage(scored.select("lang", "source", "term", "p0", _share("n", "total + V", scale).alias("p"), _share("n_lang", "total_lang + V", scale).alias("q")), "scored")
    scratch.drop("postings")

    base = _pairs(groups.select("lang", "source", "p0", "V"), groups).select("lang", "source", "other", F.expr(f"V * {_f('p0', 'q0')}").alias("value"))
    hist = scratch.stage(scored.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("times")), "histograms")
    either = F.array(
        F.struct("source", "other", F.expr(f"times * ({_f('p', 'q0')} - {_f('p0', 'q0')})").alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.expr(f"times * ({_f('q0', 'p')} - {_f('q0', 'p0')})").alias("value")),
    )
    one_sided = _pairs(hist, groups).select("lang", F.inline(either)).where("value <> 0")
    a, b = scored.selectExpr("lang", "term", "source", "p", "p0"), scored.selectExpr("lang", "term", "source as other", "p as r", "p0 as r0")
    joint = lambda p, p0, q, q0: F.expr(f"{_f(p, q)} - {_f(p, q0)} - {_f(p0, q)} + {_f(p0, q0)}").alias("value")
    both = F.array(F.struct("source", "other", joint("p", "p0", "r", "r0")), F.struct(F.col("other").alias("source"), F.col("source").alias("other"), joint("r", "r0", "p", "p0")))
    two_sided = a.join(b, ["lang", "term"]).where("source < other").select("lang", F.inline(both)).where("value <> 0")
    summed = base.union(one_sided).union(two_sided).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    terms = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
