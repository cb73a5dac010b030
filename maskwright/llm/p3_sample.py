"""Problem 3: a sample that matches target category proportions.

Categories are counted, integer quotas are allocated by largest remainder between
a floor and what there is, and the rows with the smallest random keys of each
category are taken. The random key is a digest of the row's id and a seed, so the
draw is repeatable. Rows are counted by the leading bits of their key; whole buckets
of keys are taken up to the one in which a category's limit lies, and only the rows
of that bucket are ranked. So no task ranks more than a small part of a category,
however large the sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.session import table
from maskwright.llm.common import draw_key, draw_key_sql, squash

#: Random keys have 60 bits; rows are counted by the leading 16 of them.
BUCKET = 1 << 44
SEED = 42


def categories(items: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """One row per distinct key and category (c_<dim>: the squashed name). Rows with a null key or dimension count nowhere;
    a name that is blank after squashing counts as null."""
    cols = [F.nullif(squash(d), F.lit("")).alias(f"c_{d}") for d in dims]
    return items.select(F.col(key).alias("key"), *cols).dropna().distinct()


def allocate(targets: list[dict], size: int) -> dict[int, int]:
    """Integer quotas that sum to the size, or to all there is.

    targets: dicts of id, share, floor, available. Every quota lies between min(floor, available) and available;
    within that the real-valued quotas are in proportion to the shares, and integers are made by largest remainder
    (ties to the smaller id).
    """
    low = {t["id"]: min(t["floor"], t["available"]) for t in targets}
    high = {t["id"]: t["available"] for t in targets}
    share = {t["id"]: max(0.0, t["share"]) for t in targets}
    total = max(sum(low.values()), min(size, sum(high.values())))

    def real(level: float) -> dict[int, float]:
        return {i: min(high[i], max(low[i], share[i] * level)) for i in low}

    a, b = 0.0, 1.0
    reach = sum(high[i] if share[i] > 0 else low[i] for i in low)
    while sum(real(b).values()) < min(total, reach) - 1e-9 and b < 1e18:
        b *= 2
    for _ in range(200):  # the sum grows with the level: bisect for the level that gives the total
        m = (a + b) / 2
        if sum(real(m).values()) < total:
            a = m
        else:
            b = m
    x = real(b)
    quota = {i: int(x[i] + 1e-9) for i in x}
    rest = min(total, reach) - sum(quota.values())
    for i in sorted(x, key=lambda i: (-(x[i] - quota[i]), i)):
        if rest > 0 and quota[i] < high[i] and share[i] > 0:
            quota[i] += 1
            rest -= 1
    return quota


def plan(items: DataFrame, targets: DataFrame, key: str, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct keys that belong to a target, and the report: available, wanted and quota of each target.

    wanted is max(min_rows, target_share x sample_size rounded half up).
    Only the targets (a table of fixed size) and their counts come to the driver. A target with a null or blank
    dimension matches nothing; targets of the same category share its rows in the order of target_id.
    """
    spark = items.sparkSession
    t = targets.select("target_id", *[squash(d).alias(f"c_{d}") for d in dims], "target_share", "min_rows", "sample_size")
    on = [f"c_{d}" for d in dims]
    rows = categories(items, key, dims).join(F.broadcast(t.select(*on).distinct()), on, "left_semi")
    counts = rows.groupBy(*on).agg(F.count("*").alias("available"))
    share = F.col("target_share").cast("decimal(20,10)")
    wanted = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("long"), F.floor(share * F.col("sample_size") + F.lit("0.5").cast("decimal(2,1)")).cast("long"))
    report = t.join(counts, on, "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("wanted", wanted)
    got = report.select("target_id", "target_share", "min_rows", "sample_size", "available", "wanted").orderBy("target_id").collect()
    size = max((r.sample_size or 0 for r in got), default=0)
    quota = allocate([{"id": r.target_id, "share": r.target_share or 0.0, "floor": r.min_rows or 0, "available": r.available} for r in got], size)
    schema = T.StructType([T.StructField("target_id", T.LongType()), T.StructField("available", T.LongType()), T.StructField("wanted", T.LongType()), T.StructField("quota", T.LongType())])
    made = spark.createDataFrame([(r.target_id, r.available, r.wanted, quota[r.target_id]) for r in got], schema)
    return rows, t.select("target_id", *on).join(F.broadcast(made), "target_id")


def draw(rows: DataFrame, report: DataFrame, limit: str, dims: list[str], seed: int = SEED) -> DataFrame:
    """(target_id, key): of each target the rows with the smallest random keys, as many as the report's limit column says."""
    on = [f"c_{d}" for d in dims]
    keyed = rows.join(F.broadcast(report.select("target_id", F.col(limit).alias("limit"), *on)), on)  # a row per target
    keyed = keyed.select("target_id", "key", "limit", draw_key("key", seed).alias("r")).withColumn("bucket", F.floor(F.col("r") / BUCKET))
    upto = Window.partitionBy("target_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = keyed.groupBy("target_id", "limit", "bucket").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))  # 65,536 rows a target at most
    # the bucket in which the limit lies, and how many of its rows are taken; a category that stays below its limit has none
    edge = counts.where("upto > limit AND upto - n <= limit").groupBy("target_id").agg(F.min(F.struct("bucket", (F.col("limit") - F.col("upto") + F.col("n")).alias("rest"))).alias("e"))
    marked = keyed.join(F.broadcast(edge.select("target_id", F.col("e.bucket").alias("at"), "e.rest")), "target_id", "left")  # a row per target
    whole = marked.where("at IS NULL OR bucket < at").select("target_id", "key")
    w = Window.partitionBy("target_id").orderBy("r", "key")
    part = marked.where("bucket = at").withColumn("i", F.row_number().over(w)).where("i <= rest").select("target_id", "key")
    return whole.unionByName(part)


def proportional_sample(items: DataFrame, targets: DataFrame, *, key: str = "sentence_id", dims: tuple[str, ...] = ("type", "language", "script"), seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sample: target_id and key of each drawn row; report: one row per target with what its quota drew).

    Nulls in a dimension or in the key: the row is in no category. Repeated rows count once. An empty table gives an
    empty sample and a report in which everything falls short. Extra columns are ignored.
    """
    rows, report = plan(items, targets, key, list(dims))
    return draw(rows, report, "quota", list(dims), seed).select("target_id", F.col("key").alias(key)), report


def shortfalls(items: DataFrame, targets: DataFrame, *, key: str = "sentence_id", dims: tuple[str, ...] = ("type", "language", "script"), seed: int = SEED) -> DataFrame:
    """The report with filled and shortfall: each target draws what it wants, apart from the others, and what the draw lacks of
    that is its shortfall. (In the sample itself a target may get less because floors of others take room; that is no shortfall.)"""
    rows, report = plan(items, targets, key, list(dims))
    drawn = draw(rows, report, "wanted", list(dims), seed).groupBy("target_id").agg(F.count("*").alias("filled"))
    report = report.join(F.broadcast(drawn), "target_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return report.withColumn("shortfall", F.col("wanted") - F.col("filled"))


def _tables(spark, d) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "items"), table(spark, d, "sample_targets")


def p3_found(spark, d):
    return shortfalls(*_tables(spark, d)).where("shortfall > 0").select("target_id")


def p3_report(spark, d):
    return shortfalls(*_tables(spark, d)).select("target_id", "available", "wanted", "filled", "shortfall")


def p3_reserve(spark, d):
    """The rows that each target draws by itself, up to what it wants."""
    rows, report = plan(*_tables(spark, d), "sentence_id", ["type", "language", "script"])
    return draw(rows, report, "wanted", ["type", "language", "script"]).select("target_id", F.col("key").alias("sentence_id"))


def p3_sample(spark, d):
    return proportional_sample(*_tables(spark, d))[0]


def p3_quotas(spark, d):
    """Quota of each target and what it drew: the two are equal, and together they are the sample's size if there are rows enough."""
    sample, report = proportional_sample(*_tables(spark, d))
    drawn = sample.groupBy("target_id").agg(F.count("*").alias("drawn"))
    return report.join(F.broadcast(drawn), "target_id", "left").select("target_id", "available", "wanted", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_reserve": p3_reserve, "p3_sample": p3_sample, "p3_quotas": p3_quotas}

_KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_REPORT = f"""
WITH i AS (SELECT DISTINCT sentence_id, {_KEY.format('type')} a, {_KEY.format('language')} b, {_KEY.format('script')} c FROM items
           WHERE sentence_id IS NOT NULL AND type IS NOT NULL AND language IS NOT NULL AND script IS NOT NULL),
n AS (SELECT a, b, c, count(*) AS k FROM i GROUP BY 1, 2, 3),
t AS (SELECT target_id, coalesce(k, 0) AS available,
             greatest(CAST(min_rows AS BIGINT), CAST(floor(CAST(target_share AS DECIMAL(18,8)) * sample_size + 0.5) AS BIGINT)) AS wanted
      FROM sample_targets LEFT JOIN n ON a = {_KEY.format('type')} AND b = {_KEY.format('language')} AND c = {_KEY.format('script')})
"""
_RANKED = _REPORT + f""", r AS (SELECT target_id, sentence_id, wanted, row_number() OVER (PARTITION BY target_id ORDER BY {draw_key_sql('sentence_id', SEED)}, sentence_id) AS i
  FROM i JOIN sample_targets s ON a = {_KEY.format('s.type')} AND b = {_KEY.format('s.language')} AND c = {_KEY.format('s.script')} JOIN t USING (target_id))
"""
ORACLE = {
    "p3_found": _REPORT + "SELECT target_id FROM t WHERE available < wanted",
    "p3_report": _REPORT + "SELECT target_id, available, wanted, least(available, wanted) AS filled, wanted - least(available, wanted) AS shortfall FROM t",
    "p3_reserve": _RANKED + "SELECT target_id, sentence_id FROM r WHERE i <= wanted",
}
