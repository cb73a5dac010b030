"""The engine's own queries, each over its whole tables, and the SQL that they are checked against.

Identifiers that need a fixed truth are built from keys of the tables, the same way
here and in SQL; draws are arithmetic where SQL must repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import charmap as cm
from maskwright.functions import lexicon as lx
from maskwright.functions import text as tx
from maskwright.functions.scan import scanned_counts
from maskwright.functions.session import cut, spread, table
from maskwright.operators import annotate, attacks, audit, detect, fuse, leaks, score, stats, synth
from maskwright.operators.normalize import STEPS, any_adversarial_signal, normalize
from maskwright.operators.redact import redact, run_systems
from maskwright.schema import ENTITY_TYPES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 9):
    return F.round(c, digits)


# ---------------------------------------------------------------- detectors on the corpus


def _offsets_sql(pattern: str, tbl: str, key: str) -> str:
    return f"""
WITH m AS (SELECT {key}, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {tbl} WHERE text IS NOT NULL),
u AS (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM m)
SELECT {key}, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start,
       CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS INTEGER) AS "end"
FROM u"""


_IP_RE2 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
_URL_RE2 = r"""\b(?:https?://[^\s<>"]+|www\.[^\s<>"]+)"""


def _spans(df: DataFrame, key: str, spans) -> DataFrame:
    return df.select(key, F.explode(spans).alias("s")).select(key, "s.start", "s.end")


@query(_offsets_sql(_IP_RE2, "documents", "doc_id"))
def ip_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", detect.ip_addresses(F.col("text")))


@query("""SELECT c_custkey, CAST(length(concat('page ', c_custkey, ' is ')) AS INTEGER) AS start, CAST(length(concat('page ', c_custkey, ' is ', CASE c_custkey % 3 WHEN 0 THEN concat('https://site', c_custkey, '.example/a?b=', c_custkey, '&c=[x]') WHEN 1 THEN concat('http://h', c_custkey) ELSE concat('www.w', c_custkey, '.test/ملف') END, CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE '' END)) AS INTEGER) AS "end" FROM customer
UNION ALL SELECT c_custkey, CAST(length(concat('page ', c_custkey, ' is ', 'www.w', c_custkey, '.test/ملف', CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE '' END, ' <')) AS INTEGER), CAST(length(concat('page ', c_custkey, ' is ', 'www.w', c_custkey, '.test/ملف', CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE '' END, ' <', 'www.again')) AS INTEGER) FROM customer WHERE c_custkey % 3 = 2""")
def url_spans(spark, d):
    """Addresses of pages in sentences built from keys: with paths, queries and letters of other scripts, closing dots kept, ended by a space or an angle bracket."""
    k = F.col("c_custkey").cast("string")
    url = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://site"), k, F.lit(".example/a?b="), k, F.lit("&c=[x]"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("http://h"), k)).otherwise(F.concat(F.lit("www.w"), k, F.lit(".test/ملف")))
    end = F.when(F.col("c_custkey") % 2 == 0, ".").otherwise("")
    after = F.when(F.col("c_custkey") % 3 == 2, " <www.again>, xwww.no").otherwise(" or http:/no")
    return _spans(_built(spark, d, [F.lit("page "), k, F.lit(" is "), url, end, after]), "c_custkey", detect.urls(F.col("text")))


_EMAILS_SQL = r"""
WITH p AS (SELECT doc_id, string_split(text, '@') AS p FROM documents WHERE contains(text, '@')),
i AS (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM p),
x AS (SELECT doc_id, i, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS BIGINT) AS n, regexp_replace(regexp_extract(right(p[i], 64), '[A-Za-z0-9._%+\-]*$'), '^[^A-Za-z0-9_]+', '') AS l, regexp_extract(left(p[i + 1], 255), '^[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b') AS r FROM i)
SELECT doc_id, CAST(n + i - 1 - length(l) AS INTEGER) AS start, CAST(n + i + length(r) AS INTEGER) AS "end" FROM x WHERE length(l) > 0 AND length(r) > 0"""


@query(_EMAILS_SQL.replace("\\\\", "\\"))
def email_spans(spark, d):
    return _spans(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", detect.emails(F.col("text")))


@query()
def entity_counts_by_lang(spark, d):
    """Spans per language and type over normalised documents, zeros included, before fusion."""
    n = spread(table(spark, d, "documents").select("lang", "text")).withColumn("n", F.coalesce(scanned_counts(F.col("text"), STEPS), F.array_repeat(F.lit(0), len(ENTITY_TYPES))))
    c = n.select(F.coalesce(F.lower(F.trim("lang")), F.lit("none")).alias("lang"), F.explode(F.map_from_arrays(F.array(*[F.lit(t) for t in ENTITY_TYPES]), "n")).alias("entity_type", "n"))
    return c.groupBy("lang", "entity_type").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


@query(f"""
SELECT coalesce(lang, 'none') AS lang, t AS entity_type, CAST(sum(CASE t WHEN 'IP_ADDRESS' THEN len(regexp_extract_all(text, '{_IP_RE2}')) ELSE len(regexp_extract_all(text, '{_URL_RE2}')) END) AS BIGINT) AS n
FROM documents, (VALUES ('IP_ADDRESS'), ('URL')) AS v(t) WHERE text IS NOT NULL GROUP BY 1, 2""")
def ip_url_counts(spark, d):
    spans = F.concat(detect.urls(F.col("text")), detect.ip_addresses(F.col("text")))
    c = table(spark, d, "documents").where("text IS NOT NULL").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.explode(detect.entity_counts(spans, ("IP_ADDRESS", "URL"))).alias("entity_type", "n"))
    return c.groupBy("lang", "entity_type").agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id, regexp_replace(text, '{_IP_RE2}', '[IP_ADDRESS]', 'g') AS redacted FROM documents")
def mask_ip(spark, d):
    df = table(spark, d, "documents").withColumn("s", detect.ip_addresses(F.col("text")))
    return df.select("doc_id", F.when(F.col("text").isNotNull(), fuse.mask(F.col("text"), fuse.resolve_overlaps(F.col("s")))).alias("redacted"))


@query()
def redact_documents(spark, d):
    return redact(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "redacted", F.size("spans").alias("n_spans"), any_adversarial_signal().alias("adversarial"))


@query()
def redact_messages(spark, d):
    return redact(spread(table(spark, d, "generated_record").select("record_id", "text")).distinct()).select("record_id", "redacted", F.size("spans").alias("n_spans"))


# ---------------------------------------------------------------- detectors on built identifiers

_BUILT = "concat('Customer ', c_custkey, ' has mobile {}, thanks')"


def _built(spark, d, parts: list) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.concat(*parts).alias("text"))


@query("""
WITH b AS (SELECT c_custkey, length(concat('Customer ', c_custkey, ' has mobile ')) AS a,
  CASE c_custkey % 4 WHEN 0 THEN concat('+9665', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) WHEN 1 THEN concat('00971 5', lpad(CAST(c_custkey AS VARCHAR), 8, '0'))
  WHEN 2 THEN concat('+973 (37) ', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) ELSE concat('05', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) END AS p FROM customer)
SELECT c_custkey, CAST(a AS INTEGER) AS start, CAST(a + length(p) AS INTEGER) AS "end" FROM b WHERE c_custkey % 4 <> 3""")
def phone_detect(spark, d):
    k = F.col("c_custkey")
    num = lambda n: F.lpad(k.cast("string"), n, "0")
    p = F.when(k % 4 == 0, F.concat(F.lit("+9665"), num(8))).when(k % 4 == 1, F.concat(F.lit("00971 5"), num(8))).when(k % 4 == 2, F.concat(F.lit("+973 (37) "), num(6))).otherwise(F.concat(F.lit("05"), num(8)))
    return _spans(_built(spark, d, [F.lit("Customer "), k.cast("string"), F.lit(" has mobile "), p, F.lit(", thanks")]), "c_custkey", detect.phones(F.col("text")))


@query("""
WITH b AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('SA', lpad(CAST(c_custkey AS VARCHAR), 22, '7')) WHEN 1 THEN concat('bh14bmag', lpad(CAST(c_custkey AS VARCHAR), 14, '3'))
  WHEN 2 THEN concat('JO94 CBJO ', lpad(CAST(c_custkey AS VARCHAR), 22, '5')) ELSE concat('SA', lpad(CAST(c_custkey AS VARCHAR), 21, '7')) END AS p FROM customer)
SELECT c_custkey, 8 AS start, CAST(8 + length(p) AS INTEGER) AS "end" FROM b WHERE c_custkey % 4 <> 3""")
def iban_detect(spark, d):
    k = F.col("c_custkey")
    num = lambda n, f: F.lpad(k.cast("string"), n, f)
    p = F.when(k % 4 == 0, F.concat(F.lit("SA"), num(22, "7"))).when(k % 4 == 1, F.concat(F.lit("bh14bmag"), num(14, "3"))).when(k % 4 == 2, F.concat(F.lit("JO94 CBJO "), num(22, "5"))).otherwise(F.concat(F.lit("SA"), num(21, "7")))
    return _spans(_built(spark, d, [F.lit("wire to "), p, F.lit(" today")]), "c_custkey", detect.ibans(F.col("text")))


@query("""
SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN length('national id ') WHEN 1 THEN 0 WHEN 3 THEN length('رقم الهُوِيّة ') END AS INTEGER) AS start,
  CAST(CASE c_custkey % 4 WHEN 0 THEN length('national id ') WHEN 1 THEN 0 WHEN 3 THEN length('رقم الهُوِيّة ') END + 10 AS INTEGER) AS "end" FROM customer WHERE c_custkey % 4 <> 2""")
def nid_context(spark, d):
    k = F.col("c_custkey")
    n = F.lpad(k.cast("string"), 10, "1")
    t = F.when(k % 4 == 0, F.concat(F.lit("national id "), n)).when(k % 4 == 1, F.concat(n, F.lit(" (civil ID) was matched"))).when(k % 4 == 2, F.concat(F.lit("Order "), n, F.lit(" shipped"))).otherwise(F.concat(F.lit("رقم الهُوِيّة "), n))
    return _spans(_built(spark, d, [t]), "c_custkey", detect.national_ids(F.col("text")))


_SHAPES = (
    ("see https://x.example/?to=c{}@mail.test", "see [URL]"), ("see c{}@mail.test", "see [EMAIL]"), ("a@b.co@c.org {}", "a@[EMAIL] {}"), ("at www.s.test/10.0.0.1 no {}", "at [URL] no {}"),
    ("x{}@mail.test,+966501234567", "[EMAIL],[PHONE]"), ("id: 1234567890 and {}", "id: [NATIONAL_ID] and {}"), ("+966501234567@mail.test {}", "[PHONE]@mail.test {}"), ("1.2.3.4.5 and {}", "[IP_ADDRESS].5 and {}"),
)


@query("SELECT c_custkey, CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN replace('{out}', '{{}}', CAST(c_custkey AS VARCHAR))" for i, (_, out) in enumerate(_SHAPES)) + " END AS redacted FROM customer")
def overlap_resolution(spark, d):
    """Rules that meet: the earlier one stays, of one type the longer; what only touches stays apart."""
    k, t = F.col("c_custkey"), None
    for i, (shape, _) in enumerate(_SHAPES):
        one = F.replace(F.lit(shape), F.lit("{}"), k.cast("string"))
        t = F.when(k % 8 == i, one) if t is None else t.when(k % 8 == i, one)
    df = table(spark, d, "customer").select("c_custkey", t.alias("t")).withColumn("s", detect.detect(F.col("t")))
    return df.select("c_custkey", fuse.mask(F.col("t"), fuse.fuse(F.col("t"), tx.no_spans(), F.col("s"))).alias("redacted"))


# ---------------------------------------------------------------- normalisation

_DIGITS = cm.ARABIC_INDIC + cm.EXT_ARABIC_INDIC
_SP = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"SELECT sentence_id, translate(text, '{_DIGITS}', '{cm.WESTERN * 2}') AS folded, len(regexp_extract_all(text, '[{_DIGITS}]')) AS n FROM items WHERE text IS NOT NULL")
def digits_fold(spark, d):
    return table(spark, d, "items").where("text IS NOT NULL").select("sentence_id", tx.fold_digits(F.col("text")).alias("folded"), F.regexp_count("text", F.lit(f"[{_DIGITS}]")).cast("long").alias("n"))


@query(f"SELECT record_id, regexp_replace(concat(text, '{cm.TATWEEL * 3}'), '{cm.TATWEEL}{{2,}}', '{cm.TATWEEL}', 'g') AS capped FROM generated_record")
def tatweel_cap(spark, d):
    return table(spark, d, "generated_record").select("record_id", F.when(F.col("text").isNotNull(), tx.cap_tatweel(F.concat("text", F.lit(cm.TATWEEL * 3)))).otherwise(F.lit(cm.TATWEEL)).alias("capped"))


@query(r"SELECT record_id, regexp_replace(text, '[\p{Cf}\x{34F}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{180B}-\x{180E}\x{FE00}-\x{FE0F}]', '', 'g') AS stripped FROM generated_record")
def invisible_strip(spark, d):
    return table(spark, d, "generated_record").select("record_id", tx.strip_invisible(F.col("text")).alias("stripped"))


@query(r"SELECT sentence_id, regexp_replace(text, '[\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g') AS stripped FROM sample_for_annotation")
def bidi_strip(spark, d):
    return table(spark, d, "sample_for_annotation").select("sentence_id", tx.strip_bidi(F.col("text")).alias("stripped"))


@query(f"""
WITH s AS (SELECT sentence_id, text, string_split_regex(text, '{_SP}') AS w, regexp_extract_all(text, '{_SP}') AS g FROM items),
f AS (SELECT sentence_id, text, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[A-Za-z0-9]') THEN translate(x, '{cm.CONFUSABLE_FROM}', '{cm.CONFUSABLE_TO}') ELSE x END) AS w, g FROM s)
SELECT sentence_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(range(1, len(w) + 1), lambda i: concat(w[i], coalesce(g[i], ''))), '') END AS folded FROM f""")
def confusable_fold(spark, d):
    return table(spark, d, "items").select("sentence_id", tx.fold_confusables(F.col("text")).alias("folded"))


@query()
def normalize_report(spark, d):
    """How many items each normalisation step touched."""
    r = normalize(spread(table(spark, d, "items").select("text"))).where("report IS NOT NULL")
    steps = {"nfkc": F.col("report.nfkc_changed"), "bidi": F.col("report.bidi_controls_stripped") > 0, "invisible": F.col("report.invisible_stripped") > 0, "digits": F.col("report.digits_folded") > 0, "tatweel": F.col("report.tatweel_runs_capped") > 0, "confusables": F.col("report.confusables_folded") > 0, "any": any_adversarial_signal()}
    return r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), v.cast("long").alias("hit")) for k, v in steps.items()])).alias("x")).groupBy("x.step").agg(F.sum("x.hit").alias("items"))


_NO_NFKC = ("bidi", "invisible", "digits", "tatweel", "confusables")


@query(rf"""
WITH a AS (SELECT text, regexp_replace(text, '[\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]', '', 'g') AS b FROM items WHERE text IS NOT NULL),
c AS (SELECT *, regexp_replace(b, '[\p{{Cf}}\x{{34F}}\x{{115F}}\x{{1160}}\x{{3164}}\x{{FFA0}}\x{{180B}}-\x{{180E}}\x{{FE00}}-\x{{FE0F}}]', '', 'g') AS c FROM a), e AS (SELECT *, translate(c, '{_DIGITS}', '{cm.WESTERN * 2}') AS d FROM c),
g AS (SELECT *, regexp_replace(d, '{cm.TATWEEL}{{2,}}', '{cm.TATWEEL}', 'g') AS t FROM e),
h AS (SELECT *, list_transform(string_split_regex(t, '{_SP}'), lambda x: CASE WHEN regexp_matches(x, '[A-Za-z0-9]') THEN translate(x, '{cm.CONFUSABLE_FROM}', '{cm.CONFUSABLE_TO}') ELSE x END) <> string_split_regex(t, '{_SP}') AS f FROM g),
r AS (SELECT length(text) - length(b) AS bidi, length(b) - length(c) AS invisible, len(regexp_extract_all(c, '[{_DIGITS}]')) AS digits, len(regexp_extract_all(d, '{cm.TATWEEL}{{2,}}')) AS tatweel, CAST(f AS INT) AS confusables FROM h)
SELECT step, count(*) FILTER (n > 0) AS items, CAST(CASE WHEN step = 'confusables' THEN 0 ELSE sum(n) END AS BIGINT) AS characters FROM (UNPIVOT r ON bidi, invisible, digits, tatweel, confusables INTO NAME step VALUE n) GROUP BY 1""")
def normalize_report_plain(spark, d):
    """How many items and how many characters each step touched, without compatibility forms, which SQL lacks."""
    r = normalize(spread(table(spark, d, "items").select("text")), steps=_NO_NFKC).where("report IS NOT NULL")
    names = {"bidi": "bidi_controls_stripped", "invisible": "invisible_stripped", "digits": "digits_folded", "tatweel": "tatweel_runs_capped", "confusables": "confusables_folded"}
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"report.{v}").cast("long").alias("n")) for k, v in names.items()]))
    return r.select(x.alias("x")).groupBy("x.step").agg(F.sum((F.col("x.n") > 0).cast("long")).alias("items"), F.sum(F.when(F.col("x.step") != "confusables", F.col("x.n")).otherwise(0)).alias("characters"))


@query(r"""
SELECT s AS digit_script, l AS context_language, count(*) AS n FROM (SELECT
 CASE WHEN k = 0 THEN 'none' WHEN k > 1 THEN 'mixed' WHEN regexp_matches(text, '[0-9]') THEN 'western' WHEN regexp_matches(text, '[\x{660}-\x{669}]') THEN 'arabic_indic'
      WHEN regexp_matches(text, '[\x{6F0}-\x{6F9}]') THEN 'ext_arabic_indic' ELSE 'fullwidth' END AS s,
 CASE WHEN ar > 0 AND la > 0 AND least(ar, la) / (ar + la) > 0.15 THEN 'code_mixed' WHEN ar > la THEN 'arabic' ELSE 'english' END AS l
 FROM (SELECT text, CAST(regexp_matches(text, '[0-9]') AS INT) + CAST(regexp_matches(text, '[\x{660}-\x{669}]') AS INT) + CAST(regexp_matches(text, '[\x{6F0}-\x{6F9}]') AS INT) + CAST(regexp_matches(text, '[\x{FF10}-\x{FF19}]') AS INT) AS k,
       len(regexp_extract_all(text, '[\x{600}-\x{6FF}]')) AS ar, len(regexp_extract_all(text, '[A-Za-z]')) AS la FROM items WHERE text IS NOT NULL)) GROUP BY 1, 2""")
def strata_of_items(spark, d):
    t = table(spark, d, "items").where("text IS NOT NULL")
    return t.select(tx.digit_script(F.col("text")).alias("digit_script"), tx.context_language(F.col("text")).alias("context_language")).groupBy("digit_script", "context_language").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- matching and metrics

_L = "CASE regexp_replace(lower(label), '[^a-z]', '', 'g') WHEN 'nationalid' THEN 'NATIONAL_ID' WHEN 'otherpii' THEN 'OTHER_PII' ELSE upper(regexp_replace(label, '[^A-Za-z]', '', 'g')) END"
_MARKS = f"m AS (SELECT DISTINCT sentence_id AS case_id, start, \"end\", {_L} AS type, annotator_id AS who FROM spans_b WHERE start IS NOT NULL AND label IS NOT NULL)"
_GOLD_PRED = f"{_MARKS}, g AS (SELECT case_id, start, \"end\", type FROM m GROUP BY ALL HAVING count(*) >= 3), p AS (SELECT case_id, start, \"end\", type FROM m WHERE who = 'an07')"
_OUTCOME = f"""{_GOLD_PRED}, o AS (SELECT coalesce(g.case_id, p.case_id) AS case_id, coalesce(g.type, p.type) AS type, CASE WHEN g.case_id IS NULL THEN 'fp' WHEN p.case_id IS NULL THEN 'fn' ELSE 'tp' END AS outcome
  FROM g FULL JOIN p ON g.case_id = p.case_id AND g.start = p.start AND g."end" = p."end" AND g.type = p.type),
c AS (SELECT coalesce(type, 'ALL') AS type, sum(CAST(outcome = 'tp' AS INT)) AS tp, sum(CAST(outcome = 'fp' AS INT)) AS fp, sum(CAST(outcome = 'fn' AS INT)) AS fn FROM o GROUP BY GROUPING SETS ((type), ()))"""


def _label(c: str = "label"):
    key = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.when(key == "nationalid", "NATIONAL_ID").when(key == "otherpii", "OTHER_PII").otherwise(F.upper(key))


def _marks(spark, d) -> DataFrame:
    m = table(spark, d, "spans_b").where("start IS NOT NULL AND label IS NOT NULL")
    return m.select(F.col("sentence_id").alias("case_id"), "start", "end", _label().alias("type"), F.col("annotator_id").alias("who")).distinct()


def _gold_pred(spark, d) -> tuple[DataFrame, DataFrame]:
    """Spans that three annotators agree on, and the marks of one of them."""
    m = _marks(spark, d)
    return m.groupBy(*score.KEY).agg(F.count("*").alias("n")).where("n >= 3").select(*score.KEY), m.where("who = 'an07'").select(*score.KEY)


@query(f"""WITH {_OUTCOME} SELECT type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""")
def prf_exact(spark, d):
    c = score.counts_with_total(score.match_exact(*_gold_pred(spark, d)))
    p, r, f = score.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("type", "tp", "fp", "fn", _r(p).alias("precision"), _r(r).alias("recall"), _r(f).alias("f1"))


@query(f"""WITH {_OUTCOME} SELECT type, round(greatest(0, (r + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(r * (1 - r) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n)), 9) AS lower,
round(least(1, (r + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(r * (1 - r) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n)), 9) AS upper FROM (SELECT type, tp + fn AS n, tp / nullif(tp + fn, 0) AS r FROM c) WHERE n > 0""")
def wilson_interval(spark, d):
    c = score.counts_with_total(score.match_exact(*_gold_pred(spark, d))).where("tp + fn > 0")
    lo, hi = score.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("type", _r(lo).alias("lower"), _r(hi).alias("upper"))


_IOU_PAIRS = f"""{_GOLD_PRED}, pr AS (SELECT case_id, type, g.start AS gs, g."end" AS ge, p.start AS ps, p."end" AS pe, greatest(0, least(p."end", g."end") - greatest(p.start, g.start)) AS i, (p."end" - p.start) + (g."end" - g.start) AS n FROM g JOIN p USING (case_id, type)),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, type, gs, ge ORDER BY i / (n - i) DESC, gs, ge, ps, pe) AS rg, row_number() OVER (PARTITION BY case_id, type, ps, pe ORDER BY i / (n - i) DESC, gs, ge, ps, pe) AS rp FROM pr WHERE i * 3 >= n),
c AS (SELECT coalesce(type, 'ALL') AS type, sum(t) AS tp, sum(p) - sum(t) AS fp, sum(g) - sum(t) AS fn FROM (SELECT type, 1 AS t, 0 AS g, 0 AS p FROM rk WHERE rg = 1 AND rp = 1 UNION ALL SELECT type, 0, 1, 0 FROM g UNION ALL SELECT type, 0, 0, 1 FROM p) GROUP BY GROUPING SETS ((type), ()))"""


@query(f"""WITH {_IOU_PAIRS} SELECT type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall,
round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) WHEN tp + fp + fn > 0 THEN 0 END, 9) AS f1 FROM c""")
def prf_iou(spark, d):
    """By IoU of one half, one to one. (In SQL one round of best pairs is enough for these spans.)"""
    c = score.counts_with_total(score.match_iou(*_gold_pred(spark, d)))
    p, r, f = score.prf(F.col("tp"), F.col("fp"), F.col("fn"), undefined=None)
    return c.select("type", "tp", "fp", "fn", _r(p).alias("precision"), _r(r).alias("recall"), _r(f).alias("f1"))


@query(f"""WITH {_GOLD_PRED} SELECT g.type, count(*) AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.case_id = g.case_id AND p.type = g.type AND greatest(0, least(p."end", g."end") - greatest(p.start, g.start)) * 2 >=
 (p."end" - p.start) + (g."end" - g.start) - greatest(0, least(p."end", g."end") - greatest(p.start, g.start)))) AS found FROM g GROUP BY 1""")
def lenient_recall(spark, d):
    """Gold spans for which some prediction of the type has an IoU of one half."""
    g, p = _gold_pred(spark, d)
    q = p.select("case_id", "type", F.col("start").alias("ps"), F.col("end").alias("pe"))
    ok = g.join(q, (g.case_id == q.case_id) & (g.type == q.type) & (score.iou(g.start, g.end, q.ps, q.pe) >= 0.5), "left_semi").withColumn("hit", F.lit(1))
    return g.join(ok, score.KEY, "left").groupBy("type").agg(F.count("*").alias("gold"), F.count("hit").alias("found"))


@query(f"""WITH {_GOLD_PRED}, n AS (SELECT DISTINCT sentence_id FROM sample_for_annotation WHERE sentence_id NOT IN (SELECT case_id FROM g))
SELECT (SELECT count(*) FROM n) AS negatives, count(DISTINCT case_id) AS flagged, count(*) AS spans FROM p WHERE case_id IN (SELECT sentence_id FROM n)""")
def fp_on_negatives(spark, d):
    return score.false_positives_on_negatives(table(spark, d, "sample_for_annotation").select(F.col("sentence_id").alias("case_id")), *_gold_pred(spark, d))


@query(f"""WITH {_MARKS}, w AS (SELECT who, type, count(*) AS n FROM m GROUP BY 1, 2), t AS (SELECT type, sum(n) AS n FROM w WHERE who = 'an07' GROUP BY 1), o AS (SELECT type, sum(n) AS n FROM w WHERE who = 'an14' GROUP BY 1)
SELECT t.type, round(CASE WHEN t.n = 0 THEN 0 ELSE greatest(0, (t.n - coalesce(o.n, 0)) / t.n) END, 9) AS asr, round(CASE WHEN r + 1 - q = 0 THEN 0 ELSE 2 * r * (1 - q) / (r + 1 - q) END, 9) AS pus
FROM (SELECT *, least(1.0, n / 1000) AS r, 0.25 AS q FROM t) t LEFT JOIN o ON t.type = o.type""")
def asr_and_utility(spark, d):
    m = _marks(spark, d)
    n = lambda who: m.where(F.col("who") == who).groupBy("type").agg(F.count("*").alias(who))
    j = n("an07").join(n("an14"), "type", "left").fillna(0)
    return j.select("type", _r(score.attack_success_rate(F.col("an07"), F.col("an14"))).alias("asr"), _r(score.privacy_utility(F.least(F.lit(1.0), F.col("an07") / 1000), F.lit(0.25))).alias("pus"))


@query(f"""WITH {_MARKS}, k AS (SELECT case_id, start, "end", type FROM m WHERE who IN ('an07', 'an21') GROUP BY ALL HAVING count(DISTINCT who) = 2)
SELECT who, count(*) AS n FROM m SEMI JOIN k ON m.case_id = k.case_id AND m.start = k.start AND m."end" = k."end" AND m.type = k.type GROUP BY 1""")
def common_subset(spark, d):
    """Marks shared by all of a set of systems, and who else made them."""
    m = _marks(spark, d)
    k = m.where(F.col("who").isin("an07", "an21")).groupBy(*score.KEY).agg(F.countDistinct("who").alias("n")).where("n = 2")
    return m.join(k, score.KEY, "left_semi").groupBy("who").agg(F.count("*").alias("n"))


@query()
def stratified_recall(spark, d):
    """Recall of the rules on reviewed items by type, country, digit script, language and format, for two ablations."""
    items = _latest(table(spark, d, "items"))
    gold = table(spark, d, "gold").select("sentence_id", "start", "end", _label().alias("type")).where(F.col("type").isin("PHONE", "IBAN", "EMAIL", "NATIONAL_ID")).distinct()
    g = gold.join(items, "sentence_id").withColumn("st", score.stratum(F.col("text"), F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")), F.col("type")))
    out = run_systems(items.join(gold, "sentence_id", "left_semi"), ("full", "no_stage1")).select("system", "sentence_id", F.explode("pred").alias("p")).select("system", "sentence_id", F.col("p.start").alias("ps"), F.col("p.end").alias("pe"), F.col("p.entity_type").alias("type"))
    sys = g.withColumn("system", F.explode(F.array(F.lit("full"), F.lit("no_stage1")))).withColumn("gid", F.struct("sentence_id", "start", "end", "type"))
    hit = sys.join(out, ["system", "sentence_id", "type"], "left").groupBy("system", "gid", "st", "type").agg(F.max((score.iou(F.col("gid.start"), F.col("gid.end"), F.col("ps"), F.col("pe")) >= 0.5).cast("int")).alias("hit"))
    dims = ["country", "digit_script", "context_language", "format"]
    long = hit.select("system", "hit", F.explode(F.array(F.struct(F.lit("type").alias("dim"), F.col("type").alias("value")), *[F.struct(F.lit(k).alias("dim"), F.col(f"st.{k}").alias("value")) for k in dims])).alias("x"))
    return long.groupBy("system", "x.dim", "x.value").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))


# ---------------------------------------------------------------- leak scorers


def _leak_cases(spark, d) -> DataFrame:
    """Cases of the scorer validation for identifiers of four types, built from keys."""
    k = F.col("c_custkey")
    number = lambda factor, n, fill: F.lpad((k * factor % (10**n if n < 18 else 10**9)).cast("string"), n, fill)
    ids = [
        ("EMAIL", F.concat(F.lit("user"), number(7919, 7, "0"), F.lit("@mail"), k.cast("string"), F.lit(".test")), F.concat(F.lit("Mail"), k.cast("string"), F.lit(" company"))),
        ("PHONE", F.concat(F.lit("+966"), number(104729, 9, "0")), F.lit("the customer")), ("IBAN", F.concat(F.lit("SA"), number(7919, 22, "73")), F.lit("the customer")), ("NATIONAL_ID", number(15485863, 10, "1"), F.lit("the customer")),
    ]
    each = F.array(*[F.struct(F.lit(t).alias("id_type"), v.alias("identifier"), s.alias("shared")) for t, v, s in ids])
    keys = spread(table(spark, d, "customer").select("c_custkey"))
    return synth.scorer_cases(keys.select(F.explode(each).alias("x")).select("x.*"))


def _canon_sql(c: str) -> str:
    return f"regexp_replace(lower(translate({c}, '{cm.ARABIC_INDIC}оае', '{cm.WESTERN}oae')), '[^a-z0-9]', '', 'g')"


_COPIES = "len(list_filter(range(1, length({0}) - 4), lambda j: {0}[j:j+5] = f))"
_SCORED = f"""WITH i AS (
 SELECT 'EMAIL' AS t, concat('user', lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0'), '@mail', c_custkey, '.test') AS v, concat('Mail', c_custkey, ' company') AS s FROM customer
 UNION ALL SELECT 'PHONE', concat('+966', lpad(CAST(c_custkey * 104729 % 1000000000 AS VARCHAR), 9, '0')), 'the customer' FROM customer
 UNION ALL SELECT 'IBAN', concat('SA', lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 22, '73')), 'the customer' FROM customer
 UNION ALL SELECT 'NATIONAL_ID', lpad(CAST(c_custkey * 15485863 % 10000000000 AS VARCHAR), 10, '1'), 'the customer' FROM customer),
p AS (SELECT t, v, concat('Please contact ', s, ' at ') AS l, concat('. Thanks, ', s, '.') AS r, concat('[', t, ']') AS g, greatest(8, length(v) // 2) AS h FROM i),
q AS (SELECT *, concat(l, r) AS x, v[1:h] AS keep, right(v, CAST(h AS BIGINT)) AS tail FROM p),
c AS (SELECT t, v, kind, leak,
  CASE kind WHEN 'repeated_context' THEN concat(x, ' Again: ', v, '.') WHEN 'repeat_first_survives' THEN concat('ID ; repeat ', v, '.') WHEN 'repeat_second_survives' THEN concat('ID ', v, '; repeat .') WHEN 'repeat_both_redacted' THEN concat('ID ', v, '; repeat .') ELSE x END AS ctx,
  CASE kind WHEN 'repeated_context' THEN concat(l, g, r, ' Again: ', g, '.') WHEN 'partial_prefix' THEN concat(l, keep, g, r) WHEN 'partial_suffix' THEN concat(l, g, tail, r)
    WHEN 'partial_lookalike' THEN concat(l, CASE t WHEN 'EMAIL' THEN translate(keep, 'ea', 'еа') ELSE translate(keep, '0123456789oae', '{cm.ARABIC_INDIC}оае') END, g, r)
    WHEN 'second_copy_unredacted' THEN concat(l, g, r, ' (cc: ', v, ')') WHEN 'repeat_second_survives' THEN concat('ID ', g, '; repeat ', v, '.') WHEN 'repeat_first_survives' THEN concat('ID ', v, '; repeat ', g, '.')
    WHEN 'repeat_both_redacted' THEN concat('ID ', g, '; repeat ', g, '.') WHEN 'short_fragment' THEN concat(l, g, right(v, 4), r) ELSE concat(l, g, r) END AS o
  FROM q, (VALUES ('fully_redacted_plain', FALSE), ('fully_redacted_shared', FALSE), ('repeated_context', FALSE), ('partial_prefix', TRUE), ('partial_suffix', TRUE), ('partial_lookalike', TRUE), ('second_copy_unredacted', TRUE),
    ('repeat_second_survives', TRUE), ('repeat_first_survives', TRUE), ('repeat_both_redacted', FALSE), ('short_fragment', FALSE)) AS k(kind, leak) WHERE kind <> 'fully_redacted_shared' OR t = 'EMAIL'),
n AS (SELECT kind, leak, {_canon_sql('v')} AS i, {_canon_sql('o')} AS o, {_canon_sql('ctx')} AS c FROM c),
f AS (SELECT kind, leak, o, c, replace(c, i, '') AS b, list_filter(list_distinct(list_transform(range(1, length(i) - 4), lambda j: i[j:j+5])), lambda f: contains(o, f)) AS there FROM n),
s AS (SELECT kind, leak, len(there) > 0 AS v1, len(list_filter(there, lambda f: {_COPIES.format('o')} > {_COPIES.format('c')})) > 0 AS v2a, len(list_filter(there, lambda f: {_COPIES.format('o')} > {_COPIES.format('b')})) > 0 AS v2 FROM f)"""


@query(f"{_SCORED} SELECT kind AS case_kind, count(*) AS n, CAST(sum(CAST(v2 = leak AS INT)) AS BIGINT) AS correct FROM s GROUP BY 1")
def leak_scorer_v2(spark, d):
    """The final scorer on constructed cases."""
    c = _leak_cases(spark, d).withColumn("leak", leaks.leaks(F.col("identifier"), F.col("output"), F.col("context")))
    return c.groupBy("case_kind").agg(F.count("*").alias("n"), F.sum((F.col("leak") == F.col("is_leak")).cast("long")).alias("correct"))


@query(f"{_SCORED} SELECT kind AS case_kind, count(*) AS n, CAST(sum(CAST(v1 AS INT)) AS BIGINT) AS flagged FROM s GROUP BY 1")
def leak_scorer_v1(spark, d):
    """The first scorer over-counts: it flags masked identifiers of which the text around shares a part."""
    c = _leak_cases(spark, d).withColumn("leak", leaks.leaks_v1(F.col("identifier"), F.col("output")))
    return c.groupBy("case_kind").agg(F.count("*").alias("n"), F.sum(F.col("leak").cast("long")).alias("flagged"))


_VERDICTS = " UNION ALL ".join(f"SELECT kind, '{v}' AS scorer, {v} AS leak, leak AS truth FROM s" for v in ("v1", "v2a", "v2"))


@query(f"""{_SCORED} SELECT kind AS case_kind, scorer, count(*) AS n, CAST(sum(CAST(leak = truth AS INT)) AS BIGINT) AS correct, CAST(sum(CAST(leak AND NOT truth AS INT)) AS BIGINT) AS false_positives,
CAST(sum(CAST(NOT leak AND truth AS INT)) AS BIGINT) AS false_negatives FROM ({_VERDICTS}) GROUP BY 1, 2""")
def leak_scorer_validation(spark, d):
    """Accuracy, false positives and negatives of the three scorers per kind of case."""
    v = _leak_cases(spark, d).withColumn("code", leaks.verdicts(F.col("identifier"), F.col("output"), F.col("context")))
    v = v.groupBy("case_kind", "is_leak", "code").agg(F.count("*").alias("k"))  # a few rows
    v = v.select("case_kind", "is_leak", "k", F.explode(F.array(*[F.struct(F.lit(s).alias("scorer"), (F.col("code").bitwiseAND(b) > 0).alias("leak")) for s, b in leaks.SCORERS.items()])).alias("x"))
    n = lambda c: F.sum(c.cast("long") * F.col("k"))
    return v.groupBy("case_kind", "x.scorer").agg(F.sum("k").alias("n"), n(F.col("x.leak") == F.col("is_leak")).alias("correct"), n(F.col("x.leak") & ~F.col("is_leak")).alias("false_positives"), n(~F.col("x.leak") & F.col("is_leak")).alias("false_negatives"))


@query("""WITH g AS (SELECT c_custkey, list_distinct(list_transform(range(1, length(c_name) - 1), lambda i: c_name[i:i+2])) AS a, list_distinct(list_transform(range(1, length(n_name) - 1), lambda i: n_name[i:i+2])) AS b
FROM (SELECT c_custkey, concat(c_mktsegment, c_name) AS c_name, concat(n_name, c_mktsegment) AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey))
SELECT c_custkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS similarity FROM g""")
def trigram_similarity(spark, d):
    j = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", _r(leaks.trigram_jaccard(F.concat("c_mktsegment", "c_name"), F.concat("n_name", "c_mktsegment"))).alias("similarity"))


# ---------------------------------------------------------------- attacks


def _latest(items: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, text): of a key sent with several texts the one that was loaded last."""
    order = F.struct(*[c for c in ("loaded_at", "text") if c in items.columns])
    return items.where("text IS NOT NULL").groupBy(key).agg(F.max_by("text", order).alias("text")).where(F.col(key).isNotNull())


def _attack_cases(spark, d) -> DataFrame:
    """Reviewed sentences with the identifiers that rules can find, as spans; overlapping ones leave the sentence out."""
    g = table(spark, d, "gold").select("sentence_id", "start", "end", _label().alias("entity_type")).where(F.col("entity_type").isin("PHONE", "IBAN", "EMAIL", "NATIONAL_ID")).distinct()
    packed = g.groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "entity_type"))).alias("gold"))
    meets = F.exists(F.sequence(F.lit(1), F.size("gold") - 1), lambda i: F.get("gold", i)["start"] < F.get("gold", i - 1)["end"])
    return _latest(table(spark, d, "items")).join(packed.where((F.size("gold") == 1) | ~meets), "sentence_id")


def _outcome(df: DataFrame, steps) -> DataFrame:
    """df: config, sentence_id, text, clean_text, gold (of the clean text), new_gold. One row per identifier: altered, leaked (a fragment
    can be read), leaked_whole (all of it), missed."""
    out = redact(spread(df), "text", steps, mask_format=("[", "]"))
    x = out.select("config", "sentence_id", "clean_text", "text", "redacted", "spans", F.explode(F.arrays_zip("gold", "new_gold")).alias("z"))
    ident = F.substring(F.col("clean_text"), F.col("z.gold.start") + 1, F.col("z.gold.end") - F.col("z.gold.start"))
    ctx = F.concat(F.substring(F.col("text"), F.lit(1), F.col("z.new_gold.start")), F.substring(F.col("text"), F.col("z.new_gold.end") + 1, F.length("text")))
    hit = F.exists("spans", lambda s: (s["entity_type"] == F.col("z.new_gold.entity_type")) & (score.iou(s["start"], s["end"], F.col("z.new_gold.start"), F.col("z.new_gold.end")) >= 0.5))
    y = x.select("config", "sentence_id", F.col("z.gold.start").alias("start"), F.col("z.new_gold.altered").alias("altered"), leaks.leaks_of(ident, F.col("redacted"), ctx, (leaks.FRAGMENT, WHOLE)).alias("l"), (~hit).alias("missed"))
    return y.select("config", "sentence_id", "start", "altered", F.get("l", 0).alias("leaked"), F.get("l", 1).alias("leaked_whole"), "missed")


#: A fragment longer than any identifier: the rule for whole identifiers.
WHOLE = 10**6


def _attacked(spark, d) -> DataFrame:
    """Outcomes of every identifier of reviewed sentences, clean and under all fixed configurations, with and without normalisation."""
    cases = _attack_cases(spark, d)
    draw = attacks.drawing(11, F.col("sentence_id"))
    rows = cases.select(F.lit("clean").alias("config"), "sentence_id", F.col("text").alias("clean_text"), "text", "gold", F.transform("gold", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), F.lit(False).alias("altered"))).alias("new_gold"))
    for cfg in attacks.FIXED:
        a = cases.withColumn("a", attacks.apply_fixed(F.col("text"), F.col("gold"), cfg, draw))
        rows = rows.unionByName(a.select(F.lit(cfg[0]).alias("config"), "sentence_id", F.col("text").alias("clean_text"), F.col("a.text").alias("text"), "gold", F.col("a.gold").alias("new_gold")))
    rows = cut(rows)
    out = None
    for system, steps in (("full", STEPS), ("no_stage1", ())):
        r = _outcome(rows, steps).withColumn("system", F.lit(system))
        out = r if out is None else out.unionByName(r)
    return cut(out)


@query()
def attack_matrix(spark, d):
    """Attack success of all fixed configurations on reviewed sentences, with and without normalisation.

    Identifiers that a system protects in the clean sentence count; an attack succeeds where a fragment can be read afterwards.
    """
    out = _attacked(spark, d)
    base = out.where("config = 'clean'").select("system", "sentence_id", "start", (~F.col("leaked")).alias("protected"))
    j = out.where("config <> 'clean'").join(base, ["system", "sentence_id", "start"])
    n = lambda c: F.sum(c.cast("long"))
    alt = F.col("altered") & F.col("protected")
    t = j.groupBy("system", "config").agg(F.count("*").alias("n_ids"), n(F.col("altered")).alias("n_altered"), n(F.col("protected")).alias("n_protected_clean"), n(alt).alias("n_protected_alt"), n(alt & F.col("leaked")).alias("n_leaked"), n(alt & F.col("missed")).alias("n_span_miss"))
    lo, hi = score.wilson(F.col("n_leaked"), F.col("n_protected_alt"))
    rate = lambda a, b: F.when(F.col(b) > 0, _r(F.col(a) / F.col(b)))
    return t.withColumn("asr_alt", rate("n_leaked", "n_protected_alt")).withColumn("asr_all", rate("n_leaked", "n_protected_clean")).withColumn("lower", _r(lo)).withColumn("upper", _r(hi)).withColumn("upper_if_zero", F.when(F.col("n_leaked") == 0, _r(score.upper_if_zero(F.col("n_protected_alt")))))


#: First and last query of each round: 50 in all.
ADAPTIVE_ROUNDS = ((1, 3), (4, 12), (13, 50))


@query()
def adaptive_attack(spark, d):
    """Up to 50 queries per identifier, by an attacker who uses any operator and inventory (open) and one who stays within the folded
    families (closed): the first that leaks, per type. Only identifiers that are protected as they stand (query 0) are attacked.
    Queries come in rounds; identifiers that have leaked take no part in the next."""
    ids = _attack_cases(spark, d).select("sentence_id", "text", F.explode("gold").alias("g"))
    ident = F.substring(F.col("text"), F.col("g.start") + 1, F.col("g.end") - F.col("g.start"))
    head, tail = F.substring(F.col("text"), F.lit(1), F.col("g.start")), F.substring(F.col("text"), F.col("g.end") + 1, F.length("text"))
    ids = cut(ids.select("sentence_id", "g", ident.alias("ident"), head.alias("head"), tail.alias("tail")))
    key = ["mode", "sentence_id", "g"]

    def leaked(a: DataFrame) -> DataFrame:
        a = cut(a.withColumn("attacked", F.concat("head", "new", "tail")))
        r = cut(redact(spread(a), "attacked"))
        return r.where(F.get(leaks.leaks_of(F.col("ident"), F.col("redacted"), F.concat("head", "tail")), 0))

    bare = cut(leaked(ids.withColumn("new", F.col("ident"))).select("sentence_id", "g"))
    left = ids.join(bare, ["sentence_id", "g"], "left_anti").withColumn("mode", F.explode(F.array(F.lit("open"), F.lit("closed"))))
    left = every = cut(left)
    draw = attacks.drawing(23, F.col("mode"), F.col("sentence_id"), F.col("g.start"), F.col("q"))
    new = F.when(F.col("mode") == "open", attacks.adaptive_query(F.col("ident"), F.col("g.entity_type"), draw, "open")).otherwise(attacks.adaptive_query(F.col("ident"), F.col("g.entity_type"), draw, "closed"))
    found = None
    for lo, hi in ADAPTIVE_ROUNDS:
        asked = left.withColumn("q", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("new", new).where("new <> ident")
        hit = cut(leaked(asked).groupBy(*key).agg(F.min("q").alias("first")))
        found = hit if found is None else found.unionByName(hit)
        left = cut(left.join(hit, key, "left_anti"))
    per = every.select(*key).join(found, key, "left").select("mode", F.col("g.entity_type").alias("entity_type"), "first")
    s = F.sort_array(F.collect_list("first"))
    return per.groupBy("mode", "entity_type").agg(F.count("*").alias("identifiers"), F.count("first").alias("evaded"), F.when(F.count("first") > 0, F.get(s, F.floor(F.size(s) / 2).cast("int"))).alias("median_queries"))


@query(f"""SELECT sentence_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN i % 2 = 0 AND regexp_matches(text[i:i], '[\\x{{621}}-\\x{{64A}}]') THEN concat(text[i:i], '{cm.TATWEEL}') ELSE text[i:i] END), '') END AS attacked FROM items""")
def tatweel_attack(spark, d):
    return table(spark, d, "items").select("sentence_id", attacks.tatweel(F.col("text")).alias("attacked"))


# ---------------------------------------------------------------- statistics


@query("""WITH s AS (SELECT round(o_totalprice / 1000) AS s, CAST(o_orderstatus = 'F' AS INT) AS l FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL),
r AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM s)
SELECT round((sum(rk * l) - sum(l) * (sum(l) + 1) / 2) / (sum(l) * (count(*) - sum(l))), 9) AS auc, CAST(sum(l) AS BIGINT) AS positives, CAST(count(*) - sum(l) AS BIGINT) AS negatives FROM r""")
def auc_tied(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("l"), F.round(F.col("o_totalprice") / 1000).alias("s"))
    return stats.auc(o, "l", "s").select(_r(F.col("auc")).alias("auc"), "positives", "negatives")


@query("""WITH r AS (SELECT sum(l) OVER w AS tp, sum(1 - l) OVER w AS fp, count(*) OVER w AS i, sum(l) OVER () AS p, sum(1 - l) OVER () AS n FROM (SELECT o_orderkey AS k, o_totalprice AS s, CAST(o_orderstatus = 'F' AS INT) AS l FROM orders) WINDOW w AS (ORDER BY s DESC, k ROWS UNBOUNDED PRECEDING))
SELECT round(min_by(tp, i) / max(p), 9) AS tpr FROM r WHERE fp >= n * 0.01""")
def tpr_at_one_percent(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("l"), "o_totalprice", "o_orderkey")
    return stats.tpr_at_fpr(o, "l", "o_totalprice", "o_orderkey").select(_r(F.col("tpr")).alias("tpr"))


@query("""WITH s AS (SELECT user_id AS e, event_id % 2 AS side, value AS x FROM events WHERE value IS NOT NULL), t AS (SELECT user_id AS e, avg(value) AS x FROM events GROUP BY 1),
g AS (SELECT e, side, avg(x) AS m, greatest(coalesce(var_samp(x), 0), 1e-8) AS v FROM s GROUP BY 1, 2),
p AS (SELECT t.e, exp(-((t.x - a.m) * (t.x - a.m)) / (2 * a.v)) / sqrt(2 * pi() * a.v) AS p, exp(-((t.x - b.m) * (t.x - b.m)) / (2 * b.v)) / sqrt(2 * pi() * b.v) AS q FROM t JOIN g a ON a.e = t.e AND a.side = 0 JOIN g b ON b.e = t.e AND b.side = 1)
SELECT count(*) AS examples, CAST(sum(CAST(p > q AS INT)) AS BIGINT) AS members, round(avg(least(p / q, 10)), 6) AS mean_ratio FROM p WHERE q > 0""")
def lira(spark, d):
    e = table(spark, d, "events")
    shadow = e.select(F.col("user_id").alias("example_id"), F.when(F.col("event_id") % 2 == 0, "in").otherwise("out").alias("membership"), F.col("value").alias("loss"))
    target = e.groupBy(F.col("user_id").alias("example_id")).agg(F.avg("value").alias("loss"))
    s = stats.lira(target, shadow).where("score < double('Infinity')")
    return s.agg(F.count("*").alias("examples"), F.sum((F.col("score") > 1).cast("long")).alias("members"), F.round(F.avg(F.least("score", F.lit(10.0))), 6).alias("mean_ratio"))


_BOTH = f"""{_MARKS}, t AS (SELECT DISTINCT a.sentence_id AS id FROM annotation_task a JOIN annotation_task b USING (sentence_id) WHERE a.annotator_id = 'an07' AND b.annotator_id <> 'an07' AND a.status = 'done' AND b.status = 'done'),
x AS (SELECT DISTINCT id, length(text) AS n FROM t JOIN sample_for_annotation s ON s.sentence_id = t.id WHERE text IS NOT NULL),
a AS (SELECT * FROM m WHERE who = 'an07'), b AS (SELECT case_id, start, "end", type FROM m WHERE who <> 'an07' GROUP BY ALL HAVING count(*) >= 2)"""


def _two(spark, d):
    """Sentences that one annotator and others finished; the marks of the one, and those that two others agree on."""
    m = _marks(spark, d).withColumnsRenamed({"case_id": "sentence_id", "type": "label"})
    done = table(spark, d, "annotation_task").where("status = 'done'").select("sentence_id", "annotator_id")
    ids = done.where("annotator_id = 'an07'").select("sentence_id").join(done.where("annotator_id <> 'an07'").select("sentence_id"), "sentence_id", "left_semi").distinct()
    texts = table(spark, d, "sample_for_annotation").select("sentence_id", "text").dropna().distinct().join(ids, "sentence_id", "left_semi")
    cols = ["sentence_id", "start", "end", "label"]
    return texts, m.where("who = 'an07'").select(*cols), m.where("who <> 'an07'").groupBy(*cols).agg(F.count("*").alias("n")).where("n >= 2").select(*cols)


def _chars_sql(name: str) -> str:
    return f"""{name}c AS (SELECT id, p, max_by(type, {{'s': start, 'e': "end", 't': type}}) AS l FROM (SELECT x.id, start, "end", type, unnest(range(greatest(0, start), least("end", n))) AS p FROM {name} JOIN x ON x.id = {name}.case_id) GROUP BY 1, 2)"""


@query(f"""WITH {_BOTH}, {_chars_sql('a')}, {_chars_sql('b')}, j AS (SELECT coalesce(ac.l, 'O') AS la, coalesce(bc.l, 'O') AS lb FROM ac FULL JOIN bc ON ac.id = bc.id AND ac.p = bc.p),
k AS (SELECT la, lb, count(*) AS n FROM j GROUP BY 1, 2 UNION ALL SELECT 'O', 'O', (SELECT sum(n) FROM x) - (SELECT count(*) FROM j)), tot AS (SELECT sum(n) AS t FROM k),
pe AS (SELECT sum(r.n * c.n) AS e FROM (SELECT la, sum(n) AS n FROM k GROUP BY 1) r JOIN (SELECT lb, sum(n) AS n FROM k GROUP BY 1) c ON la = lb)
SELECT CAST(t AS BIGINT) AS units, round((o / t - e / (t * t)) / (1 - e / (t * t)), 9) AS kappa FROM (SELECT sum(n) AS o FROM k WHERE la = lb), tot, pe""")
def kappa_char(spark, d):
    return stats.kappa_of_characters(*_two(spark, d)).select(F.col("units").cast("long").alias("units"), _r(F.col("kappa")).alias("kappa"))


@query(f"""WITH {_BOTH}, j AS (SELECT coalesce(a.type, b.type) AS label, a.case_id AS x, b.case_id AS y FROM a FULL JOIN b ON a.case_id = b.case_id AND a.start = b.start AND a."end" = b."end" AND a.type = b.type)
SELECT label, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS tp, count(*) FILTER (x IS NULL) AS fp, count(*) FILTER (y IS NULL) AS fn, round(2 * count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / (count(*) + count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)), 9) AS f1 FROM j GROUP BY 1""")
def annotator_span_f1(spark, d):
    _, a, b = _two(spark, d)
    return annotate.span_f1(a, b).select("label", "tp", "fp", "fn", _r(F.col("f1")).alias("f1"))


@query(f"""WITH {_BOTH} SELECT count(DISTINCT case_id) AS n FROM (SELECT coalesce(a.case_id, b.case_id) AS case_id FROM a FULL JOIN b ON a.case_id = b.case_id AND a.start = b.start AND a."end" = b."end" AND a.type = b.type WHERE a.case_id IS NULL OR b.case_id IS NULL)""")
def annotator_disagreements(spark, d):
    _, a, b = _two(spark, d)
    return annotate.disagreements(a, b).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT CAST(o_orderkey % 3 = 0 AS INT) AS h, CAST(o_orderkey % 5 < 2 AS INT) AS s FROM orders), c AS (SELECT count(*) AS n, sum(h * s) AS a, sum(h * (1 - s)) AS b, sum((1 - h) * s) AS c, sum((1 - h) * (1 - s)) AS d FROM t)
SELECT n, CAST(a + d AS BIGINT) AS agree, round(((a + d) / n - ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)) / (1 - ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)), 9) AS kappa FROM c""")
def review_kappa(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 3 == 0).alias("h"), (F.col("o_orderkey") % 5 < 2).alias("s"))
    return annotate.review_agreement(o, "h", "s").select("n", F.col("agree").cast("long").alias("agree"), _r(F.col("kappa")).alias("kappa"))


def _arith(b: str, i, n, seed: int):
    """Draws that SQL can repeat."""
    return F.pmod(F.col(b) * 7919 + i.cast("long") * 104729 + (F.col(b) * i) % 613, n)


@query("""WITH p AS (SELECT round(s_acctbal, 2) / 1000 - s_suppkey % 7 AS d FROM supplier), i AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM p),
b AS (SELECT r, sum(d) / max(n) AS m FROM (SELECT range AS r FROM range(400)), (SELECT range AS k FROM range((SELECT count(*) FROM p))) JOIN i ON i.i = (r * 7919 + k * 104729 + (r * k) % 613) % i.n GROUP BY 1),
s AS (SELECT list_sort(list(m)) AS s FROM b)
SELECT round((SELECT avg(d) FROM p), 6) AS observed_diff, round(s[11], 6) AS ci_lower, round(s[390], 6) AS ci_upper FROM s""")
def bootstrap_interval(spark, d):
    s = table(spark, d, "supplier").select((F.round("s_acctbal", 2) / 1000).alias("a"), (F.col("s_suppkey") % 7).cast("double").alias("b"))
    r = stats.paired_bootstrap(s, "a", "b", replicates=400, draw=_arith)
    return r.select(*[F.round(c, 6).alias(c) for c in ("observed_diff", "ci_lower", "ci_upper")])


@query()
def bootstrap_clusters(spark, d):
    """Two annotators against what three agree on: F1 and its difference over resampled sentence templates: texts with
    their gold spans and runs of digits masked, 4000 replicates."""
    gold, _ = _gold_pred(spark, d)
    m = _marks(spark, d)
    texts = _latest(table(spark, d, "sample_for_annotation")).withColumnRenamed("sentence_id", "case_id")
    packed = gold.groupBy("case_id").agg(F.collect_list(F.struct("start", "end")).alias("gold"))
    no_span = F.array().cast("array<struct<start:int,end:int>>")
    keyed = cut(texts.join(packed, "case_id", "left").select("case_id", annotate.cluster_key(F.col("text"), F.coalesce(F.col("gold").cast("array<struct<start:int,end:int>>"), no_span)).alias("cluster")))
    out = None
    for who in ("an07", "an21"):
        mine = m.where(F.col("who") == who).select(*score.KEY)
        seen = gold.join(mine.select("case_id").distinct(), "case_id", "left_semi")
        r = score.match_exact(seen, mine).join(keyed, "case_id").withColumn("system", F.lit(who))
        out = r if out is None else out.unionByName(r)
    return stats.cluster_bootstrap(score.counts(out, "cluster", "system"), "cluster", ("an07", "an21"), replicates=4000)


@query("""SELECT o_orderpriority AS shape, round(regr_slope(ln(o_totalprice), ln(o_orderkey + 1)), 9) AS slope FROM orders WHERE o_totalprice > 0 GROUP BY 1""")
def latency_slope(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 0").select(F.col("o_orderpriority").alias("shape"), (F.col("o_orderkey") + 1).alias("x"), F.col("o_totalprice").alias("y"))
    return stats.log_log_slope(o, "x", "y", "shape").select("shape", _r(F.col("slope")).alias("slope"))


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, list_sort(list(value))[greatest(1, CAST(floor(0.95 * count(value)) AS INT))] AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY 1""")
def latency_summary(spark, d):
    v = F.col("value")
    # the element at index int(0.95 n) - 1 of the sorted values, found by rank and not by gathering them
    from pyspark.sql import Window

    e = table(spark, d, "events").where("value IS NOT NULL")
    per = e.groupBy("event_type", "value").agg(F.count("*").alias("k"))
    run = per.withColumn("upto", F.sum("k").over(Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    tot = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.round(F.median(v), 6).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"))
    p95 = run.join(F.broadcast(tot.select("event_type", "n")), "event_type").where(F.col("upto") >= F.greatest(F.lit(1), F.floor(0.95 * F.col("n")))).groupBy("event_type").agg(F.min("value").alias("p95"))
    return tot.join(F.broadcast(p95), "event_type").select("event_type", "mean", "std", "median", "p95", "least", "most")


@query()
def reidentification(spark, d):
    """Masked identifiers of dev and test records guessed from training records with the most similar surroundings."""
    r = table(spark, d, "generated_record").select("record_id", F.lower(F.trim("split")).alias("split"), "text", "entities").where("text IS NOT NULL AND size(entities) > 0")
    r = r.groupBy("record_id").agg(F.max_by(F.struct("split", "text", "entities"), F.struct("text", "split")).alias("r")).select("record_id", "r.*")  # a record sent twice counts once
    spans = F.transform("entities", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), F.lit("regex").alias("origin"), F.lit(1.0).alias("score"), F.lit(False).alias("expanded")))
    rec = r.where("split IN ('dev', 'test')").select("record_id", F.col("text").alias("original"), spans.alias("spans")).withColumn("redacted", fuse.mask(F.col("original"), F.col("spans")))
    each = r.where("split = 'train'").select("record_id", "text", F.posexplode("entities").alias("i", "e"))
    lo, ord_ = F.greatest(F.lit(0), F.col("e.start") - 30), F.crc32("record_id") * 4096 + F.col("i")
    back = each.select(ord_.alias("ord"), F.substring("text", lo + 1, F.col("e.end") + 30 - lo).alias("context"), F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("entity_value"))
    return stats.prir(rec, back)


# ---------------------------------------------------------------- audit, sampling, corrections, generators


@query("""WITH e AS (SELECT o_custkey % 16 AS log_id, o_orderkey AS seq, sha256(concat(o_orderkey, '|', o_custkey)) AS h FROM orders),
l AS (SELECT *, CASE WHEN seq % 997 = 5 THEN 'x' ELSE coalesce(lag(h) OVER (PARTITION BY log_id ORDER BY seq), repeat('0', 64)) END AS prev, coalesce(lag(h) OVER (PARTITION BY log_id ORDER BY seq), repeat('0', 64)) AS want FROM e)
SELECT CAST(log_id AS VARCHAR) AS log_id, count(*) AS entries, bool_and(prev = want) AS intact, max_by(h, seq) AS head_hash FROM l GROUP BY 1""")
def chain_links(spark, d):
    """Links and heads of chains in which some entries were tampered with."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select((F.col("o_custkey") % 16).cast("string").alias("log_id"), F.col("o_orderkey").alias("seq"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), 256).alias("entry_hash"))
    prev = F.coalesce(F.lag("entry_hash").over(Window.partitionBy("log_id").orderBy("seq")), F.lit(audit.GENESIS))
    log = o.withColumn("previous_entry_hash", F.when(F.col("seq") % 997 == 5, "x").otherwise(prev))
    return audit.verify_links(log, "seq").join(audit.heads(log, "seq").select("log_id", "head_hash"), "log_id")


@query("""SELECT concat(coalesce(source, 'none'), '-', CAST(concat('0x', substr(md5(record_id), 1, 6)) AS BIGINT) % 64) AS log_id, count(*) AS entries, TRUE AS valid,
CAST(sum(CAST(coalesce(text, '') = '' AS INT)) AS BIGINT) AS without_text FROM (SELECT DISTINCT record_id, text, source, loaded_at FROM generated_record) GROUP BY 1""")
def audit_log(spark, d):
    """Redaction of messages, chained and signed per source and 64th part, then verified: links, hashes and signatures."""
    r = table(spark, d, "generated_record").select("record_id", "text", "source", "loaded_at").distinct()
    part = F.conv(F.substring(F.md5(F.col("record_id").cast("binary")), 1, 6), 16, 10).cast("long") % 64
    out = redact(spread(r)).withColumn("log_id", F.concat_ws("-", F.coalesce("source", F.lit("none")), part.cast("string")))
    out = out.select("log_id", F.unix_micros("loaded_at").alias("seq"), F.col("record_id").alias("transaction_id"), F.unix_timestamp("loaded_at").cast("double").alias("timestamp"), "normalized", "redacted", "spans")
    seed = b"\x01" * 32
    log = cut(audit.append(out, hash_key=b"demonstration key", seed=seed))
    empty = audit.keyed_digest(b"demonstration key", "")
    return audit.verify_chain(log, audit.public_key(seed)).join(log.groupBy("log_id").agg(F.sum((F.col("input_hash") == empty).cast("long")).alias("without_text")), "log_id")


@query("""SELECT status, task_id FROM (SELECT status, task_id, row_number() OVER (PARTITION BY status ORDER BY md5(CAST(task_id AS VARCHAR))) AS n FROM annotation_task) WHERE n <= 30""")
def review_sample(spark, d):
    """Thirty tasks of each status, in an order that no one chose."""
    from pyspark.sql import Window

    w = Window.partitionBy("status").orderBy(F.md5(F.col("task_id").cast("string").cast("binary")))
    return table(spark, d, "annotation_task").withColumn("n", F.row_number().over(w)).where("n <= 30").select("status", "task_id")


@query(f"""WITH g AS (SELECT DISTINCT sentence_id, start, "end", {_L} AS label FROM gold), r AS (SELECT DISTINCT sentence_id FROM g WHERE length(sentence_id) > 0 AND CAST(substr(sentence_id, 2) AS INT) % 10 = 3)
SELECT * FROM g WHERE sentence_id NOT IN (SELECT sentence_id FROM r) UNION ALL SELECT sentence_id, start, "end", label FROM g WHERE sentence_id IN (SELECT sentence_id FROM r) AND label <> 'PERSON'""")
def corrected_gold(spark, d):
    """Gold in which reviewed items got corrected spans: here, persons taken out of one item in ten."""
    g = table(spark, d, "gold").select("sentence_id", "start", "end", _label().alias("label")).distinct()
    rev = g.select("sentence_id").where(F.substring("sentence_id", 2, 20).cast("int") % 10 == 3)
    return annotate.apply_corrections(g, g.where("label <> 'PERSON'"), rev)


@query("""SELECT regexp_replace(lower(split), '[^a-z]', '', 'g') AS split, e.entity_type, count(*) AS n FROM (SELECT split, unnest(entities) AS e FROM generated_record) GROUP BY 1, 2""")
def corpus_breakdown(spark, d):
    r = table(spark, d, "generated_record").select(F.regexp_replace(F.lower("split"), "[^a-z]", "").alias("split"), F.explode("entities").alias("e"))
    return r.groupBy("split", "e.entity_type").agg(F.count("*").alias("n"))


@query(r"""WITH r AS (SELECT record_id, max_by({'t': text, 'e': entities}, {'l': loaded_at, 't': text}) AS x FROM generated_record WHERE text IS NOT NULL AND record_id IS NOT NULL GROUP BY 1),
m AS (SELECT record_id, x.e AS e, regexp_extract_all(x.t, '\S+') AS m, string_split_regex(x.t, '\S+') AS g FROM r), u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
t AS (SELECT record_id, e, i, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s FROM u),
p AS (SELECT *, lag(s) OVER (PARTITION BY record_id ORDER BY i) AS before, list_filter(coalesce(e, []), lambda x: x.start <= s AND s < x."end")[1] AS own FROM t)
SELECT CASE WHEN own IS NULL THEN 'O' WHEN before >= own.start THEN concat('I-', own.entity_type) ELSE concat('B-', own.entity_type) END AS tag, count(*) AS n FROM p GROUP BY 1""".replace("\\\\", "\\"))
def bio_tags(spark, d):
    r = table(spark, d, "generated_record").where("text IS NOT NULL AND record_id IS NOT NULL").groupBy("record_id").agg(F.max_by(F.struct("text", "entities"), F.struct("loaded_at", "text")).alias("r"))
    return annotate.to_bio(spread(r.select("record_id", "r.*"))).select(F.explode("tokens").alias("t")).groupBy("t.tag").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CAST((CAST(concat(lpad(CAST(c_custkey AS VARCHAR), 20, '4'), '281000') AS HUGEINT)) % 97 AS INTEGER) AS rest, lpad(CAST(98 - (CAST(concat(lpad(CAST(c_custkey AS VARCHAR), 20, '4'), '281000') AS HUGEINT)) % 97 AS VARCHAR), 2, '0') AS check_digits FROM customer""")
def iban_check_digits(spark, d):
    body = F.lpad(F.col("c_custkey").cast("string"), 20, "4")
    return table(spark, d, "customer").select("c_custkey", synth.mod97(F.concat(body, F.lit("SA00"))).alias("rest"), synth.iban_check_digits(F.lit("SA"), body).alias("check_digits"))


@query()
def generated_corpus(spark, d):
    """A corpus as long as the orders table is, and what the rules find of its identifiers."""
    n = table(spark, d, "orders").count()
    c = synth.corpus(spark, n)
    out = redact(c)
    per = out.select("split", F.explode("entities").alias("e"), "spans").withColumn("hit", F.exists("spans", lambda s: (s["start"] == F.col("e.start")) & (s["end"] == F.col("e.end")) & (s["entity_type"] == F.col("e.entity_type"))))
    return per.groupBy("split", "e.entity_type").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("found"))


@query()
def flagged_contexts(spark, d):
    """What rules flag in documents, with the text around, by type."""
    r = redact(spread(table(spark, d, "documents").select("doc_id", "text")))
    f = score.flagged_context(r, "doc_id", "normalized", "spans")
    return f.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"), F.min("context").alias("example"))


_CODES_SQL = "(?:966|971|964|962|965|973|20)"
_IBAN_SQL = "|".join([*[f"(?:{k})[0-9](?: ?[0-9]){{{n - 1}}}" for k, n in lx.IBAN_DIGITS.items()], *[f"(?:{k})[0-9] ?[0-9](?: ?[A-Za-z]){{4}}(?: ?[A-Za-z0-9]){{{n}}}" for k, n in lx.IBAN_AFTER_BANK.items()]])


@query(rf"""WITH t AS (SELECT DISTINCT sentence_id, text FROM items WHERE text IS NOT NULL),
x AS (SELECT regexp_matches(text, '(?:^|[^0-9])00{_CODES_SQL}[0-9 .\-]{{7,14}}[0-9]') AS a, regexp_matches(text, '\+{_CODES_SQL} ?\([0-9]{{2,3}}\)[0-9 .\-]{{5,12}}[0-9]') AS b,
 regexp_matches(text, '(?:^|[^0-9+])0?5[0-9][ \-]?[0-9]{{3}}[ \-]?[0-9]{{4}}(?:[^0-9]|$)') AS l, len(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9])(?:{_IBAN_SQL})(?:[^A-Za-z0-9]|$)')) AS i FROM t)
SELECT CASE WHEN l AND NOT a AND NOT b THEN 'ambiguous' ELSE 'scored' END AS verdict, CAST(CASE WHEN l AND NOT a AND NOT b THEN 0 ELSE CAST(a AS INT) + CAST(b AS INT) + i END AS INTEGER) AS spans, count(*) AS n FROM x GROUP BY 1, 2""")
def relabelled_items(spark, d):
    items = table(spark, d, "items").where("text IS NOT NULL").select(F.col("sentence_id").alias("case_id"), "text").distinct().withColumn("gold", F.array().cast("array<struct<start:int,end:int,type:string>>"))
    r = annotate.relabel(items)
    return r.groupBy("verdict", F.size("gold").alias("spans")).agg(F.count("*").alias("n"))
