"""Problem 2: the same or nearly the same records across splits.

An exact set-similarity join between the evaluation splits and the training split.
A record is reduced to letters and digits in loose form; its shingles are runs of
five of these characters (the records are single messages, in which one changed
word breaks five of some twenty word shingles - so characters, and a similarity of
0.55 of them, stand for the small edits that the task allows, in records of any
length). Shingles are ordered from rare to common. Two records of n and m shingles
that share o of them share SHARED of the first n - o + SHARED of the one and the
first m - o + SHARED of the other. So the evaluation texts' prefixes are indexed and
the training texts' prefixes probe them; a match counts only if it lies in the
prefixes that the two lengths ask for, if what follows it can still suffice, and if
the parities of the two sets (below) do not already differ too much; every candidate
with that many matches is verified on its whole text.

Both records must carry the same identifiers and reference numbers. That condition
is part of the join key: a record's digits in order and its e-mail addresses,
however they are written, are hashed into every shingle, so that messages from one
template with different numbers never meet.

Texts that are equal after reduction are one class, named by a 128-bit digest. Inside
the join a class goes by a number that is unique in the run.

The order needs corpus frequencies; these are counted in a fixed number of hashed
buckets, which is all that is broadcast. Any fixed order keeps the filter exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.charmap import loose
from maskwright.functions.session import cut, table
from maskwright.llm.common import canonical_split

SIZE = 5
SIMILARITY = 0.55
#: Matches in the prefixes that make a candidate; the prefixes are longer by as many, less one. More of them cost a longer prefix
#: and leave fewer candidates; the result is the same for any number.
SHARED = 4
#: Words of 64 bits of a set's parities: bit i tells whether an odd number of its shingles falls in class i. Parities differ in no
#: more bits than the sets differ in shingles, so the filter loses nothing; in long texts it only filters less.
PARITY = 6
BUCKETS = 1 << 18

_DOT = r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\sdot\s)"
_MAIL = re.compile(rf"([a-z0-9][a-z0-9._%+\-]*)(?:\s*@\s*|\s*[\[(]\s*at\s*[\])]\s*|\sat\s)([a-z0-9\-]+(?:{_DOT}[a-z0-9\-]+)+)")
_DOT_WORD = re.compile(r"[\[(]\s*dot\s*[\])]|\sdot\s")
#: The international prefix 00 before a calling code of the region: written + elsewhere.
_ZEROS = re.compile(r"(?<![\d\-.])00(?=[\s.\-(]*(?:966|971|20|964|962|965|973))")


#: What may stand for the sign in an address.
_SIGN = re.compile(r"@|[\[(]\s*at\s*[\])]|\sat\s")


def _letters(s: str) -> str:
    return "".join(ch for ch in s if ch.isalnum())


def _identity(f: str, digits: str) -> str:
    mails = ",".join(sorted(_letters(_DOT_WORD.sub("", a + b)) for a, b in _MAIL.findall(f))) if _SIGN.search(f) else ""
    if "00" in digits:
        digits = "".join(ch for ch in _ZEROS.sub("", f) if ch.isdigit())
    return digits + "|" + mails


def reduce_text(text: str) -> tuple[str, str]:
    """(letters and digits in loose form, identity: digits in order and e-mail addresses)."""
    f = loose(text)
    return _letters(f), _identity(f, "".join(ch for ch in f if ch.isdigit()))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point of the first two planes: its loose form (LIMIT: deleted, LIMIT + 1: a text with it goes the slow way),
    and whether a loose character is a letter or digit, and a digit."""
    to, alnum, digit = np.zeros(LIMIT + 2, np.uint32), np.zeros(LIMIT + 2, bool), np.zeros(LIMIT + 2, bool)
    to[LIMIT:] = LIMIT + 1
    for c in range(LIMIT):
        ch = chr(c)
        f = loose(ch) if not 0xD800 <= c < 0xE000 and ch != "\u03a3" else "slow"  # the lower case of that sigma depends on its neighbours
        to[c] = LIMIT if f == "" else LIMIT + 1 if len(f) > 1 or ord(f) >= LIMIT else ord(f)
        alnum[c], digit[c] = ch.isalnum(), ch.isdigit()
    return to, alnum, digit


LIMIT = 0x20000


#: Characters that are worked on at once: long texts go in small groups, so that memory stays bounded.
AT_ONCE = 2_000_000


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in groups of about AT_ONCE characters."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > AT_ONCE:
            yield texts[lo:i]
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield texts[lo:]


def reduce_texts(texts: list[str]) -> tuple[list[str], list[str]]:
    """reduce_text of many texts, by table lookups over all their characters at once."""
    reduced: list[str] = []
    identities: list[str] = []
    for group in _groups(texts):
        a, b = _reduce_group(group)
        reduced += a
        identities += b
    return reduced, identities


def _reduce_group(texts: list[str]) -> tuple[list[str], list[str]]:
    to, alnum, digit = _tables()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    codes = to[np.minimum(codes, LIMIT)]
    slow = set(row[codes == LIMIT + 1].tolist())
    keep = codes < LIMIT
    codes, row = codes[keep], row[keep]

    def pieces(where: np.ndarray) -> list[str]:
        own = codes[where]
        ends = np.cumsum(np.bincount(row[where], minlength=len(texts))).tolist()
        whole = own.astype("<u4").tobytes().decode("utf-32-le")
        return [whole[a:b] for a, b in zip([0, *ends], ends)]

    full, reduced, digits = pieces(np.ones(len(codes), bool)), pieces(alnum[codes]), pieces(digit[codes])
    identities = [_identity(f, d) for f, d in zip(full, digits)]
    for i in slow:
        reduced[i], identities[i] = reduce_text(texts[i])
    return reduced, identities


def shingles(reduced: str) -> np.ndarray:
    """Hashes of the distinct runs of SIZE characters; a shorter text is one run. Two runs may share a hash with odds of 2^-63."""
    return shingle_sets([reduced])[0]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """shingles of many texts: the runs of all of them are hashed at once."""
    out = []
    for group in _groups(texts):
        c = np.frombuffer("".join(group).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        h, e = _hashed(c, SIZE), 0
        for n in map(len, group):
            e += n
            out.append(np.unique(h[e - n : e - SIZE + 1] if n >= SIZE else _hashed(c[e - n : e], max(1, n))))
    return out


def _hashed(c: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k numbers."""
    n = max(0, len(c) - k + 1)
    h = np.full(n, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ c[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _classes(records: DataFrame, key: str, text: str) -> DataFrame:
    """(side, record, c, k, identity, reduced): c names the reduced text with its identity, k the identity."""
    side = F.when(canonical_split("split") == "train", 0).when(canonical_split("split").isin("dev", "test"), 1)
    rows = records.select(F.col(key).alias("record"), side.alias("side"), F.col(text).alias("text")).dropna().distinct()

    def reduced_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            reduced, identities = reduce_texts(pdf.pop("text").tolist())
            yield pdf.assign(reduced=reduced, identity=identities)

    reduced = rows.mapInPandas(reduced_of, "record string, side int, reduced string, identity string").where("reduced <> ''")
    name = F.unhex(F.md5(F.concat_ws("|", "identity", "reduced").cast("binary")))
    return reduced.select("side", "record", name.alias("c"), F.xxhash64("identity").alias("k"), "identity", "reduced")


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for pdf in parts:
            for s in shingle_sets(pdf["reduced"].tolist()):
                n[(s % np.uint64(BUCKETS)).astype(np.int64)] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": at, "n": n[at]})

    got = texts.select("reduced").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[got["bucket"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def similar_classes(texts: DataFrame, similarity: float = SIMILARITY, shared: int = SHARED) -> DataFrame:
    """(h_a, h_b, similarity): pairs of a training (side 0) and an evaluation text (side 1) of equal identity and of at
    least this similarity. texts: side, h, k, identity, reduced, one row per h. Texts equal to each other are among the pairs."""
    common = texts.sparkSession.sparkContext.broadcast(_bucket_counts(texts))

    words = [f"parity{i}" for i in range(PARITY)]

    def prefixes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq = common.value
        for pdf in parts:
            tokens, first, sizes, parities, places = [], [], [], [], []
            for k, s in zip(pdf["k"], shingle_sets(pdf["reduced"].tolist())):
                classes = ((s >> np.uint64(20)) % np.uint64(64 * PARITY)).astype(np.int64)
                parities.append(np.packbits(np.bincount(classes, minlength=64 * PARITY).astype(np.uint8) & 1).view(np.int64))
                s = s[np.lexsort((s, freq[(s % np.uint64(BUCKETS)).astype(np.int64)]))]
                m = min(len(s), len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + shared)
                tokens.append((s[:m].view(np.int64) * np.int64(31)) ^ np.int64(k))
                places.append(np.arange(m, dtype=np.int32))
                first.append(m)
                sizes.append(len(s))
            if tokens:
                each = lambda v, t: np.repeat(np.asarray(v, t), first, axis=0)  # noqa: B023, E731
                own = each(parities, np.int64)
                yield pd.DataFrame(
                    {"token": np.concatenate(tokens), "side": each(pdf["side"], np.int32), "h": each(pdf["h"], np.int64), "size": each(sizes, np.int32), "pos": np.concatenate(places)}
                    | {w: own[:, i] for i, w in enumerate(words)}
                )

    index = texts.mapInPandas(prefixes, "token long, side int, h long, size int, pos int, " + ", ".join(f"{w} long" for w in words))
    a, b = index.where("side = 0").alias("a"), index.where("side = 1").alias("b")
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("a.size") + F.col("b.size")) - 1e-9).cast("int")
    unlike = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words])
    met = a.join(
        b,
        (F.col("a.token") == F.col("b.token"))
        & (F.least(F.col("a.size"), F.col("b.size")) >= need)
        # both in the prefix that this pair of lengths asks for
        & (F.col("a.pos") < F.col("a.size") - need + shared)
        & (F.col("b.pos") < F.col("b.size") - need + shared)
        # what came before, at most, and all that follows must suffice
        & (F.least(F.col("a.pos"), F.col("b.pos")) + F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos")) >= need)
        & (unlike <= F.col("a.size") + F.col("b.size") - 2 * need),
    )
    matches = met.groupBy(F.col("a.h").alias("h_a"), F.col("b.h").alias("h_b")).agg(F.count("*").alias("n"), F.first(F.least(F.lit(shared), need)).alias("least"))
    candidates = matches.where("n >= least").select("h_a", "h_b")
    side = lambda n, s: texts.where(f"side = {s}").select(F.col("h").alias(f"h_{n}"), F.col("identity").alias(f"i_{n}"), F.col("reduced").alias(f"t_{n}"))

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s: np.ndarray, u: np.ndarray) -> float:
            n = len(np.intersect1d(s, u, assume_unique=True))
            return n / (len(s) + len(u) - n)

        return pd.Series([one(s, u) for s, u in zip(shingle_sets(x.tolist()), shingle_sets(y.tolist()))], dtype=float)

    both = candidates.join(side("a", 0), "h_a").join(side("b", 1), "h_b").where("i_a = i_b")
    return both.select("h_a", "h_b", jaccard("t_a", "t_b").alias("similarity")).where(F.col("similarity") >= similarity - 1e-9)


def linked_classes(records: DataFrame, *, key: str = "record_id", text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members: side, record, c, one row per record and class; links: c_a, c_b, similarity, one row per pair of a training and an
    evaluation class). A record sent twice with different texts is a member of two classes."""
    rows = cut(_classes(records, key, text))
    # Only texts whose identity occurs on both sides can pair: a necessary condition, checked before anything is shingled.
    sides = rows.groupBy("k").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi").select("k")
    texts = rows.join(sides, "k", "left_semi").groupBy("side", "c").agg(F.first("k").alias("k"), F.first("identity").alias("identity"), F.first("reduced").alias("reduced"))
    texts = cut(texts.withColumn("h", F.monotonically_increasing_id()))
    pairs = cut(similar_classes(texts, similarity))
    named = lambda n, s: texts.where(f"side = {s}").select(F.col("h").alias(f"h_{n}"), F.col("c").alias(f"c_{n}"))
    links = pairs.join(named("a", 0), "h_a").join(named("b", 1), "h_b").select("c_a", "c_b", "similarity")
    return rows.select("side", "record", "c").distinct(), links


def overlaps(records: DataFrame, *, key: str = "record_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(train, evaluation, similarity): pairs of records across the splits.

    Split names agree without case and spaces; records of a null or other split, a null key or a null text have no part, nor
    have texts without letter or digit. Rows sent twice count once. Copies are joined as one text and expanded at the end.
    Empty tables give no pair. Extra columns are ignored.
    """
    members, links = linked_classes(records, key=key, text=text, similarity=similarity)
    train = members.where("side = 0").select(F.col("c").alias("c_a"), F.col("record").alias("train"))
    evaluation = members.where("side = 1").select(F.col("c").alias("c_b"), F.col("record").alias("evaluation"))
    return links.join(train, "c_a").join(evaluation, "c_b").groupBy("train", "evaluation").agg(F.max("similarity").alias("similarity")).where("train <> evaluation")


def partners(records: DataFrame, **options) -> DataFrame:
    """(evaluation, pairs): how many training records each evaluation record pairs with, as counting the rows of overlaps would
    give it, but from the sizes of classes: only records of several classes (sent twice with different texts, or in both splits)
    are looked at one by one, since they must not count twice or with themselves."""
    members, links = linked_classes(records, **options)
    members = cut(members)
    plain = members.groupBy("record").agg(F.count("*").alias("n")).where("n = 1").select("record")
    train, evaluation = members.where("side = 0"), members.where("side = 1")
    size = train.join(plain, "record", "left_semi").groupBy(F.col("c").alias("c_a")).agg(F.count("*").alias("single"))
    several = train.join(plain, "record", "left_anti").select(F.col("c").alias("c_a"), F.col("record").alias("train"))
    links = cut(links.select("c_a", "c_b").distinct())
    # evaluation records of one class: the class has the answer
    per_class = links.join(size, "c_a").groupBy("c_b").agg(F.sum("single").alias("pairs"))
    one = evaluation.join(plain, "record", "left_semi").select(F.col("record").alias("evaluation"), F.col("c").alias("c_b"))
    easy = one.join(per_class, "c_b").select("evaluation", "pairs")
    # records of several classes on the evaluation side: the distinct training classes they reach
    many = evaluation.join(plain, "record", "left_anti").select(F.col("record").alias("evaluation"), F.col("c").alias("c_b"))
    reach = many.join(links, "c_b").select("evaluation", "c_a").distinct()
    hard = reach.join(size, "c_a").groupBy("evaluation").agg(F.sum("single").alias("pairs"))
    # records of several classes on the training side, one by one
    meets = evaluation.select(F.col("record").alias("evaluation"), F.col("c").alias("c_b")).join(links.join(several, "c_a"), "c_b")
    rest = meets.select("evaluation", "train").distinct().where("train <> evaluation").groupBy("evaluation").agg(F.count("*").alias("pairs"))
    return easy.unionByName(hard).unionByName(rest).groupBy("evaluation").agg(F.sum("pairs").alias("pairs"))


def p2_found(spark, d):
    both = overlaps(table(spark, d, "generated_record"))
    return both.select(F.least("train", "evaluation").alias("record_a"), F.greatest("train", "evaluation").alias("record_b"))


def p2_report(spark, d):
    """Per evaluation split and source: records, records that recur in train, pairs."""
    records = table(spark, d, "generated_record")
    meta = records.select(F.col("record_id").alias("evaluation"), canonical_split("split").alias("split"), "source").where("split IN ('dev', 'test')").distinct()
    return meta.join(partners(records), "evaluation", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("pairs").alias("recurring"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLE: dict[str, str] = {}
