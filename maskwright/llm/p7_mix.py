"""Problem 7: mix sources to target weights.

Sizes are tokens of a public tokenizer. Every source gets an expected number of
copies per document - its share of the budget over what it has, at most its cap -
and documents are drawn by systematic sampling: the expected copies are summed up
in document order, one random offset is added per source, and a document is
emitted once for each integer that its interval crosses. The running sum is made
in two levels (inside blocks of a source, then over the block totals), so that a
source holding most of the corpus never lies in one task. Of what lies before a block
only the part beyond the last integer matters, so no sum grows with the corpus but
that of the block totals, which is a decimal.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.session import cut, table
from maskwright.llm.common import draw_key, draw_key_sql, squash

TOKENIZER = os.environ.get("MASKWRIGHT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Documents in a block, about: a source has as many blocks as it needs.
BLOCK_DOCS = 200_000
SEED = 7
#: Parts per copy: expected copies are whole multiples of 1/UNIT, so that sums are exact in any order.
UNIT = 10**9
# Fixed value: the published pre-token pattern of these byte-level vocabularies.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoder(path: str):
    """A worker's encoder, loaded once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def with_tokens(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """docs with n_tokens, the length of the text in tokens; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        encode = _encoder(tokenizer)
        return s.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return docs.withColumn("n_tokens", count(text))


def mix(docs: DataFrame, targets: DataFrame, *, fraction: float = 0.5, seed: int = SEED, tokenizer: str = TOKENIZER, size: str | None = None, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, copies of every drawn document; report per source of targets).

    The budget is `fraction` of the tokens of all documents (or of the units of `size`, an integer SQL expression).
    Report: available tokens, wanted (weight x budget), rate (expected copies, at most max_repeat), tokens drawn, actual share,
    shortfall: what the drawn tokens lack of wanted where every document was drawn max_repeat times; a source with documents
    to spare has none, though its draw may miss wanted by a document.
    Source names agree without case, spaces and separators. Documents of null, blank or untargeted sources are never drawn,
    but count towards the budget; null or blank texts have 0 tokens and are not drawn. A source without documents has a
    shortfall of all it wants. Empty tables give empty results. Extra columns are ignored.
    """
    sized = docs.select("doc_id", "source", "text")
    sized = with_tokens(sized, tokenizer=tokenizer) if size is None else sized.withColumn("n_tokens", F.coalesce(F.expr(size), F.lit(0)).cast("long"))
    sized = cut(sized.select("doc_id", squash("source").alias("k"), "n_tokens"))
    t = targets.select("source", squash("source").alias("k"), "target_weight", "max_repeat")
    have = sized.groupBy("k").agg(F.sum("n_tokens").alias("available"), F.sum((F.col("n_tokens") > 0).cast("long")).alias("documents"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    rate = F.when(F.col("available") > 0, F.least(F.col("wanted") / F.col("available"), F.col("max_repeat").cast("double"))).otherwise(0.0)
    plan = (
        t.join(have, "k", "left").crossJoin(F.broadcast(total))  # one row
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("wanted", F.col("target_weight") * F.lit(fraction) * F.col("total"))
        .withColumn("units", F.round(rate * UNIT).cast("long"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.coalesce("documents", F.lit(0)) / block_docs)).cast("long"))
    )
    plan = cut(plan)  # one row per target

    blocked = sized.where("n_tokens > 0").join(F.broadcast(plan.select("k", "source", "units", "blocks")), "k").withColumn("block", F.pmod(draw_key("doc_id", seed), F.col("blocks")))
    inside = Window.partitionBy("k", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("k", "block").agg(F.sum("units").cast("decimal(20,0)").alias("s"))
    offset = F.pmod(draw_key("k", seed), F.lit(UNIT))
    past = F.coalesce(F.sum("s").over(before), F.lit(0).cast("decimal(30,0)"))
    starts = totals.select("k", "block", F.pmod((past + offset.cast("decimal(20,0)")), F.lit(UNIT).cast("decimal(20,0)")).cast("long").alias("start"))  # a row per block
    upto = F.col("start") + F.sum("units").over(inside)
    crossed = F.expr(f"upto div {UNIT}") - F.expr(f"(upto - units) div {UNIT}")
    drawn = cut(
        blocked.join(starts, ["k", "block"])
        .withColumn("upto", upto).withColumn("copies", crossed.cast("int")).where("copies > 0")
        .select("doc_id", "source", "k", "n_tokens", "copies")
    )
    got = drawn.groupBy("k").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn"), F.max("copies").alias("most_copies"), F.min("copies").alias("fewest_copies"), F.count("*").alias("drawn_documents")
    )
    report = plan.join(F.broadcast(got), "k", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))  # a row per target
    used_up = (F.coalesce("drawn_documents", F.lit(0)) == F.coalesce("documents", F.lit(0))) & (F.coalesce("fewest_copies", F.col("max_repeat")) >= F.col("max_repeat"))
    every = Window.partitionBy()  # one row per target
    report = report.select(
        "source", "target_weight", "max_repeat", "available", "wanted", F.when(used_up, F.greatest(F.lit(0.0), F.col("wanted") - F.col("drawn"))).otherwise(0.0).alias("shortfall"),
        (F.col("units") / UNIT).alias("rate"), "drawn", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.col("drawn") / F.nullif(F.sum("drawn").over(every), F.lit(0))).alias("actual_share"),
    )
    return drawn.select("doc_id", "source", "copies", "n_tokens"), report


def _of(spark, d, **options):
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), **options)


def p7_found(spark, d):
    return _of(spark, d)[1].where("shortfall > 0").select("source")


def p7_shares(spark, d):
    return _of(spark, d)[1]


def p7_mix(spark, d):
    return _of(spark, d)[0]


def _rounded(report: DataFrame) -> DataFrame:
    return report.select("source", "available", F.round("wanted", 3).alias("wanted"), F.round("shortfall", 3).alias("shortfall"), F.round("rate", 6).alias("rate"), "drawn", "most_copies", F.round("actual_share", 9).alias("actual_share"))


def p7_shares_in_characters(spark, d):
    """The shares with sizes in characters, which SQL can count."""
    return _rounded(_of(spark, d, size="length(text)")[1])


def p7_mix_in_characters(spark, d):
    return _of(spark, d, size="length(text)")[0].select("doc_id", "source", "copies")


QUERIES = {"p7_found": p7_found, "p7_shares": p7_shares, "p7_mix": p7_mix, "p7_shares_in_characters": p7_shares_in_characters, "p7_mix_in_characters": p7_mix_in_characters}

_DOCS = """
WITH d AS (SELECT doc_id, regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') AS k, coalesce(length(text), 0) AS n FROM documents),
a AS (SELECT k, sum(n) AS n, count(*) FILTER (n > 0) AS docs FROM d GROUP BY 1), s AS (SELECT sum(n) AS n FROM d),
p AS (SELECT source, m.k, max_repeat, coalesce(a.n, 0) AS available, coalesce(docs, 0) AS docs, target_weight * 0.5 * s.n AS wanted
      FROM (SELECT *, regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') AS k FROM mix_targets) m LEFT JOIN a ON a.k = m.k, s)"""
#: In the test tables no source has more documents than a block: blocks follow from the counts.
_DRAWN = f"""{_DOCS},
u AS (SELECT *, CAST(round(CASE WHEN available > 0 THEN least(wanted / available, CAST(max_repeat AS DOUBLE)) ELSE 0 END * {UNIT}) AS BIGINT) AS units, greatest(1, CAST(ceil(docs / {BLOCK_DOCS}) AS BIGINT)) AS blocks FROM p),
w AS (SELECT doc_id, u.k, source, units, n, sum(CAST(units AS HUGEINT)) OVER (PARTITION BY u.k ORDER BY {draw_key_sql('doc_id', SEED)} % blocks, doc_id ROWS UNBOUNDED PRECEDING) + {draw_key_sql('u.k', SEED)} % {UNIT} AS upto
      FROM d JOIN u ON u.k = d.k WHERE n > 0),
c AS (SELECT doc_id, k, source, n, CAST(upto // {UNIT} - (upto - units) // {UNIT} AS INTEGER) AS copies FROM w WHERE upto // {UNIT} > (upto - units) // {UNIT})"""
ORACLE = {
    # the same question with sizes in characters: no case depends on the tokenizer
    "p7_found": _DOCS + " SELECT source FROM p WHERE available * max_repeat < wanted",
    "p7_mix_in_characters": _DRAWN + " SELECT doc_id, source, copies FROM c",
    "p7_shares_in_characters": _DRAWN
    + """, g AS (SELECT k, sum(copies * n) AS drawn, max(copies) AS most FROM c GROUP BY 1)
SELECT source, CAST(available AS BIGINT) AS available, round(wanted, 3) AS wanted, round(CASE WHEN available * max_repeat < wanted THEN wanted - available * max_repeat ELSE 0 END, 3) AS shortfall,
  round(units / 1e9, 6) AS rate, CAST(coalesce(drawn, 0) AS BIGINT) AS drawn, coalesce(most, 0) AS most_copies, round(coalesce(drawn, 0) / sum(coalesce(drawn, 0)) OVER (), 9) AS actual_share
FROM u LEFT JOIN g ON g.k = u.k""",
}
