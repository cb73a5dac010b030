"""Problem 8: the reading level of each document.

All words of the corpus are ranked by frequency within their script. A document's
coverage rank at a share is the size of the smallest such frequency-ranked
vocabulary that covers this share of its words. Coverage ranks at several shares,
word length and sentence length are calibrated on the graded passages: SQL
aggregates give the mean of every level and the pooled covariance, and the level
whose mean is nearest under that covariance is taken: a linear score per level, which
is a column expression. Latin and Arabic words are measured apart and their evidence
is added by their number of words, so that mixed documents need no model of their own.

Ranks reach the words in two ways at once. The most frequent words of each script, a
fixed number, are broadcast: they are nearly all that a text consists of. The rarer
words of a text are joined with their ranks; none of them is frequent, so no key of
that join is hot, and a stop word is never shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import charmap
from maskwright.functions.session import cut, table

SHARES = (0.3, 0.5, 0.65, 0.8, 0.9, 0.95)
#: Words of each script whose ranks are broadcast, those of highest rank; the others are joined.
HEAD_WORDS = 200_000
#: Words a sentence, above which a document is taken to lack punctuation, and sentence length says nothing.
LONGEST_MEAN = 35.0
FEATURES = [f"c{int(s * 100)}" for s in SHARES] + ["mean_rank", "word_len", "sentence_len"]
#: Characters that end a sentence.
STOPS = ".!?؟۔．！？"
#: Characters of text that are measured at once, and written words that a task remembers at most, about.
PIECE, REMEMBERED = 1 << 20, 400_000
_LATIN, _ARABIC, _STOP, _NOTHING = range(4)


@lru_cache(2)
def _words(stops: bool = False) -> re.Pattern:
    """Finds words: letters with inner marks, apostrophes and hyphens; and, if asked, runs of STOPS."""
    w = f"(?:[^\\W\\d_{charmap.TATWEEL}]++[{charmap.MARKS_CLASS}{charmap.TATWEEL}{charmap.invisible_py()}]*+)++"
    return re.compile(f"{w}(?:['’-]{w})*+" + f"|[{STOPS}]++" * stops)


class Tokens(dict):
    """A number for every word or run of STOPS as it is written, given when it is first met, with its kind and the number of its loose
    form; and of each loose form the length and the rank, 0 where rank does not know it."""

    def __init__(self, rank: Callable[[str], int | None]):
        super().__init__()
        self.rank, self.numbers, self.forms = rank, {}, []
        self.kind, self.form, self.size, self.ranked = array("b"), array("q"), array("q"), array("q")

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self.kind)
        word = "" if token[0] in STOPS else charmap.loose(token)
        form = self.numbers.setdefault(word, len(self.forms))
        if form == len(self.forms):
            self.forms.append(word)
            self.size.append(len(word))
            self.ranked.append(self.rank(word) or 0)
        self.form.append(form)
        self.kind.append(_STOP if token[0] in STOPS else _NOTHING if not word else _ARABIC if "؀" <= word[0] <= "ۿ" else _LATIN)
        return n


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, added up in each task before the shuffle."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written: Counter = Counter()
        find = _words().findall

        def told() -> pd.DataFrame:
            c: Counter = Counter()
            for w, n in written.items():
                c[charmap.loose(w)] += n
            del c[""]
            return pd.DataFrame({"word": list(c), "n": list(c.values())}, columns=["word", "n"]).astype({"word": object, "n": "int64"})

        for pdf in parts:
            for t in pdf[text]:
                if t:
                    written.update(find(t))
            if len(written) > 300_000:  # memory stays bounded; the rest of the sum is the shuffle's
                yield told()
                written.clear()
        yield told()

    return docs.select(text).where(F.col(text).isNotNull()).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ranks(counts: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """(word, rank, head): rank is one more than the number of more frequent words of its script; equal counts share a rank. head:
    it is among the head_words first, with all that share its rank.

    The running sum is over distinct counts, of which there are few, not over words.
    """
    counts = counts.withColumn("arabic", F.col("word").rlike(r"^[؀-ۿ]"))
    by_count = counts.groupBy("arabic", "n").agg(F.count("*").alias("words"))
    ranked = counts.sparkSession.sql(
        """SELECT arabic, n, words, coalesce(sum(words) OVER (PARTITION BY arabic ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS rank
           FROM {c}""", c=by_count)  # fmt: skip
    return counts.join(ranked, ["arabic", "n"]).select("word", "rank", (F.col("rank") + F.col("words") - 1 <= head_words).alias("head"))


def _coverage(rank: np.ndarray, k: np.ndarray) -> list[float]:
    """Log coverage rank at each share, and the mean log rank, of words with these ranks, k times each."""
    by = np.argsort(rank, kind="stable")
    r, upto = np.log(rank[by].astype(float)), np.cumsum(k[by])
    n = int(upto[-1])
    at = np.searchsorted(upto, [min(n, max(1, int(np.ceil(s * n)))) for s in SHARES])
    return [*map(float, r[at]), float((r * k[by]).sum() / n)]


def measured(texts: list[str], tokens: Tokens) -> tuple:
    """A row for each script in a text: the number of the text, arabic, n, and masked arrays of FEATURES, where the coverage is
    missing if tokens does not know the ranks of all words; then, for these rows alone, the ranks and counts of the words with a
    rank and the others with their counts, as lists."""
    find = _words(True).findall
    found = [find(t) for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    at = np.fromiter(map(tokens.__getitem__, chain.from_iterable(found)), np.int64, int(lengths.sum()))
    kind, doc = np.frombuffer(tokens.kind, np.int8)[at], np.repeat(np.arange(len(texts)), lengths)
    sentence = np.cumsum(kind == _STOP) + doc
    word = kind < _STOP
    kind, doc, sentence = kind[word], doc[word], sentence[word]
    form = np.frombuffer(tokens.form, np.int64)[at[word]]
    rank = np.frombuffer(tokens.ranked, np.int64)[form]
    group = doc * 2 + kind
    add = lambda g, w=None: np.bincount(g, w, 2 * len(texts))
    own = sum(add(group[kind == k][np.diff(sentence[kind == k], prepend=-1) != 0]) for k in (_LATIN, _ARABIC))
    every = add(group)
    at = np.flatnonzero(every)
    n, mean, partly = every[at], every[at] / own[at], add(group, rank == 0)[at] > 0
    base = int(rank.max(initial=0)) + 1
    by = np.sort(group * base + rank) % base
    begin = np.cumsum(n) - n
    cover = [np.log(np.maximum(1, by[begin + np.clip(np.ceil(s * n).astype(np.int64), 1, n) - 1])) for s in SHARES]
    cover.append(add(group, np.log(np.maximum(1, rank)))[at] / n)
    values = [*(np.ma.array(c, mask=partly) for c in cover), np.ma.array(add(group, np.frombuffer(tokens.size, np.int64)[form])[at] / n, mask=False), np.ma.array(np.log(mean), mask=mean > LONGEST_MEAN)]
    some = np.zeros(len(every), bool)
    some[at[partly]] = True
    pair, times = np.unique(group[some[group]] * len(tokens.forms) + form[some[group]], return_counts=True)
    whose, form = np.divmod(pair, max(1, len(tokens.forms)))
    rank = np.frombuffer(tokens.ranked, np.int64)[form]
    lists = []
    for x in (rank > 0, rank == 0):
        offsets = pa.array(np.concatenate([[0], np.cumsum(add(whose[x])[at])]), pa.int32())
        what = pa.array(rank[x]) if not lists else pa.array([tokens.forms[f] for f in form[x].tolist()], pa.string())
        lists += [pa.ListArray.from_arrays(offsets, what), pa.ListArray.from_arrays(offsets, pa.array(times[x], pa.int64()))]
    return at // 2, at % 2 == 1, n, values, lists


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """From where to where texts are measured at once."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


_COVER = FEATURES[: len(SHARES) + 1]
_KEYS = "id long, arabic boolean, n long, "
_DOUBLES = ", ".join(f"{f} double" for f in FEATURES)


def features(docs: DataFrame, ranked: DataFrame, n_words: int, key: str, text: str = "text") -> DataFrame:
    """(id, arabic, n, FEATURES): one row per text and script in it. ranked: word, rank, head; n_words: its rows. A word that is
    not in it comes after all that are."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    known = ranked.where("head").select("word", "rank").toPandas()  # HEAD_WORDS a script at most
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(known["word"], known["rank"].astype("int64"))))

    names = ["id", "arabic", "n", *FEATURES, "ranks", "counts", "words", "times"]

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value.get)
        for batch in parts:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1).to_pylist()
            for x, y in _pieces(texts):
                if len(tokens) > REMEMBERED:
                    tokens = Tokens(shared.value.get)
                which, arabic, n, values, lists = measured(texts[x:y], tokens)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(which + x)), pa.array(arabic), pa.array(n, pa.int64()), *(pa.array(v.data, pa.float64(), mask=np.ma.getmaskarray(v)) for v in values), *lists], names)

    got = docs.mapInArrow(measure, f"{_KEYS}{_DOUBLES}, ranks array<long>, counts array<long>, words array<string>, times array<long>")
    got = cut(got.withColumn("row", F.monotonically_increasing_id()))
    columns = ["id", "arabic", "n", *FEATURES]
    part = got.where("size(words) > 0")
    rare = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    rare = rare.join(ranked.where("NOT head").select("word", "rank"), "word", "left").select("row", F.coalesce("rank", F.lit(n_words + 1)).alias("rank"), "k")
    rest = rare.groupBy("row").agg(F.collect_list("rank").alias("ranks2"), F.collect_list("k").alias("counts2"))  # the words of one text

    def complete(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cover = [_coverage(np.concatenate([a, c]).astype(np.int64), np.concatenate([b, d]).astype(np.int64)) for a, b, c, d in zip(pdf["ranks"], pdf["counts"], pdf["ranks2"], pdf["counts2"])]
            pdf[_COVER] = np.array(cover, float).reshape(-1, len(_COVER))
            yield pdf[columns]

    return got.where("size(words) = 0").select(*columns).unionByName(part.join(rest, "row").select(*columns, "ranks", "counts", "ranks2", "counts2").mapInPandas(complete, _KEYS + _DOUBLES))


def calibrate(measured: DataFrame) -> dict:
    """From measured features with a level column: per script and with or without sentence length, the level means and the inverse
    of the pooled covariance. The moments are SQL aggregates; the driver gets one row per script and level."""
    out = {}
    for used in (FEATURES, FEATURES[:-1]):
        k = len(used)
        aggs = [F.count("*").alias("m")] + [F.avg(f).alias(f"m_{f}") for f in used]
        aggs += [F.covar_pop(a, b).alias(f"v_{i}_{j}") for i, a in enumerate(used) for j, b in enumerate(used) if i <= j]
        for arabic in (False, True):
            got = measured.where((F.col("arabic") == arabic) & (F.col("n") >= 8)).dropna(subset=used).groupBy("level").agg(*aggs).orderBy("level").collect()
            if not got:
                continue
            mean = np.array([[r[f"m_{f}"] for f in used] for r in got])
            pool = np.zeros((k, k))
            for r in got:
                pool += r["m"] * np.array([[r[f"v_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            pool = pool / max(1, sum(r["m"] for r in got) - len(got)) + np.diag(np.full(k, 0.003))
            out[arabic, k] = ([int(r["level"]) for r in got], mean, np.linalg.inv(pool))
    return out


def _scores(model: dict, levels: list[int]) -> list:
    """A column per level: the distance of a row's features from the level's mean, less what is the same for all levels, times n.
    The distance is quadratic, but its quadratic part does not depend on the level, so a linear score is left."""
    out = []
    for level in levels:
        score = None
        for (arabic, k), (lvs, mean, inv) in model.items():
            here = (F.col("arabic") == arabic) & (F.col(FEATURES[-1]).isNotNull() == (k == len(FEATURES)))
            if level in lvs:
                m = mean[lvs.index(level)]
                value = F.lit(float(m @ inv @ m))
                for f, w in zip(FEATURES, inv @ m):
                    value = value - F.lit(2.0 * float(w)) * F.col(f)
            else:
                value = F.lit(0.0)
            score = F.when(here, value) if score is None else score.when(here, value)
        out.append((score.otherwise(0.0) if score is not None else F.lit(0.0)) * F.col("n"))
    return out


def reading_levels(docs: DataFrame, graded: DataFrame, *, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, level, n_words, coverage_rank): a level for every document with non-blank text.

    Null and blank texts get no row. A text without any word (digits, signs) gets level 1, 0 words and a null coverage rank.
    A document is measured as a whole, so a few sentences of a neighbouring level do not move it; ties go to the lower level.
    The ranks come from all documents. Duplicate doc_ids give a row each when the text is the same row-wise table; extra
    columns are ignored. head_words changes the way that ranks take, not the result.
    """
    docs = docs.select("doc_id", "text")
    ranked = cut(ranks(word_counts(docs), head_words))
    n_words = ranked.count()
    small = features(graded.select(F.col("excerpt_id").cast("long").alias("excerpt_id"), "text"), ranked, n_words, "excerpt_id")
    model = calibrate(cut(small.join(graded.select(F.col("excerpt_id").cast("long").alias("id"), "level"), "id")))
    measured = features(docs, ranked, n_words, "doc_id")

    levels = sorted({lv for lvs, _, _ in model.values() for lv in lvs}) or [1]
    scored = measured.select("id", "n", "c80", *[c.alias(f"d{i}") for i, c in enumerate(_scores(model, levels))])
    per_doc = scored.groupBy("id").agg(F.sum("n").alias("n_words"), F.max(F.struct("n", F.round(F.exp("c80")).cast("long").alias("c"))).getField("c").alias("coverage_rank"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(len(levels))])
    best = F.array_min(F.array(*[F.struct(F.col(f"d{i}").alias("d"), F.lit(v).alias("level")) for i, v in enumerate(levels)])).getField("level")
    return (
        docs.where(F.col("text").rlike(r"[^\s\p{Z}\p{Cf}]")).select(F.col("doc_id").alias("id"))
        .join(per_doc.select("id", best.cast("int").alias("level"), "n_words", "coverage_rank"), "id", "left")
        .select(F.col("id").alias("doc_id"), F.coalesce("level", F.lit(1)).alias("level"), F.coalesce("n_words", F.lit(0)).alias("n_words"), "coverage_rank")
    )


def _of(spark, d):
    return reading_levels(table(spark, d, "documents"), table(spark, d, "graded_passage"))


def p8_found(spark, d):
    return _of(spark, d).select("doc_id", "level")


def p8_profile(spark, d):
    lv = _of(spark, d)
    src = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower("source"), "[^a-z]+", "").alias("source"))
    return lv.join(src, "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.avg("coverage_rank").alias("mean_coverage_rank"))


QUERIES = {"p8_found": p8_found, "p8_profile": p8_profile}
ORACLE: dict[str, str] = {}
