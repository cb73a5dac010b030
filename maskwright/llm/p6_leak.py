"""Problem 6: evaluation passages leaking into the corpus.

Each task builds FM-indexes over shards of its documents, a few hundred thousand
words at a time: the suffix array of the words' numbers by prefix doubling, its
Burrows-Wheeler transform in a wavelet matrix, and every SAMPLE-th suffix position.
All runs of PHRASE words of all passages are searched backwards at once, through
ranks in the matrix; their occurrences are located by walking to a sampled position.
Occurrences of one passage in one document that lie near a diagonal make a
candidate, which is aligned word by word; spans of the same document are merged for
removal. The passages are the stated query set: they are broadcast in blocks of
bounded size, and every shard is searched for all blocks while its index is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.charmap import loose, word_pattern
from maskwright.functions.session import table

PHRASE = 4
SAMPLE = 4
SHARD_WORDS = 400_000
#: Words of a block of passages.
PART_WORDS = 2_000_000
#: Occurrences of phrases in passages that are looked at together.
AT_ONCE = 4_000_000
#: Share of a passage's words under intact phrases near one diagonal, from which a candidate is aligned.
CANDIDATE = 0.22
BAND = 12
#: What a changed word costs in matching words.
COST = 2.5


def words_of(text: str) -> list[str]:
    """Words in loose form."""
    return [w for w in map(loose, word_pattern().findall(text)) if w]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers by prefix doubling; after the first sort only unresolved groups are sorted again."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = int(s.max() + 1).bit_length()
    m = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(m):  # the first m symbols in one number, 0 beyond the end
        key <<= bits
        if j < n:
            key[: n - j] += s[j:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    k = m
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while True:
        tied = ~(head & np.concatenate([head[1:], [True]]))
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        sub = order[slots]
        after = sub + k
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[sub] * np.int64(n + 1) + nxt
        by = np.argsort(key, kind="stable")
        sub, key = sub[by], key[by]
        order[slots] = sub
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[slots] = new
        rank[sub] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in an integer sequence, a bit level at a time."""

    def __init__(self, s: np.ndarray):
        self.bits = max(1, int(s.max()).bit_length()) if len(s) else 1
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            k = self.ones[level][i]
            i = np.where((c >> b) & 1, self.zeros[level] + k, i - k)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c occurs before its position i."""
        return self.down(c, i) - self.down(c, np.zeros_like(i))


class FMIndex:
    """Backward search over a sequence of numbers from 1 on; 0 separates texts."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        s = np.concatenate([s + 1, [0]]).astype(np.int64)  # one least symbol at the very end, and nowhere else
        order = suffix_array(s)
        self.n = len(s)
        self.bwt = s[order - 1]
        counts = np.bincount(s, minlength=int(s.max()) + 2)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        self.matrix = WaveletMatrix(self.bwt)
        self.sampled = order % sample == 0
        self.positions = order[self.sampled]
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.less[c] + self.matrix.rank(c, i)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of the suffixes that start with each pattern (a row of equal-length patterns)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live, patterns = np.arange(len(patterns)), patterns + 1
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            a, b = self.step(c, lo[live]), self.step(c, hi[live])
            lo[live], hi[live] = a, np.maximum(a, b)
            live = live[a < b]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        rows = rows.astype(np.int64).copy()
        while len(live):
            hit = self.sampled[rows[live]]
            done = live[hit]
            at[done] = self.positions[self.before[rows[done]]] + steps[done]
            live = live[~hit]
            rows[live] = self.step(self.bwt[rows[live]], rows[live])
            steps[live] += 1
        return at


def needed(size: np.ndarray | int) -> np.ndarray | int:
    """How many words of a passage a stretch must span: half of them."""
    return (size + 1) // 2


class _Passages:
    """A block of passages and the distinct phrases in them: runs of `phrase` words, and shorter passages whole."""

    def __init__(self, ids: list[int], texts: list[str], phrase: int):
        self.ids, self.phrase = ids, phrase
        own: dict[str, str] = {}
        self.words = [[own.setdefault(w, w) for w in words_of(t or "")] for t in texts]
        number = {w: i for i, w in enumerate(own)}
        self.vocabulary = list(own)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.longest = int(self.size.max()) if len(self.size) else 0
        seq = np.fromiter((number[w] for ws in self.words for w in ws), np.int64, int(self.size.sum()))
        starts = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if len(self.size) else np.zeros(0, np.int64)
        #: For each phrase length: (distinct phrases, first and number of their places, passage and offset of each place).
        self.groups: list[tuple[np.ndarray, ...]] = []
        for length in range(1, phrase + 1):
            its = np.flatnonzero(self.size == length) if length < phrase else np.flatnonzero(self.size >= phrase)
            runs = self.size[its] - length + 1
            if not runs.sum():
                continue
            passage, offset = np.repeat(its, runs), _ranges(np.zeros(len(its), np.int64), runs)
            at = starts[passage] + offset
            table = np.stack([seq[at + j] for j in range(length)], axis=1)
            by = np.lexsort(table.T[::-1])
            table, passage, offset = table[by], passage[by], offset[by]
            first = np.flatnonzero(np.concatenate([[True], (table[1:] != table[:-1]).any(1)]))
            self.groups.append((table[first], first, np.diff(np.append(first, len(table))), passage, offset))
        self._matchers: dict[int, SequenceMatcher] = {}

    def matcher(self, p: int) -> SequenceMatcher:
        """Of a passage, with what it prepares of it."""
        if p not in self._matchers:
            if len(self._matchers) > 2000:
                self._matchers.clear()
            self._matchers[p] = SequenceMatcher(None, [], self.words[p], autojunk=False)
        return self._matchers[p]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... count[i] times, one after the other."""
    total = int(count.sum())
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)


def _stretch(matcher: SequenceMatcher, d: list[str]) -> tuple[float, int, int]:
    """The best stretch of a passage (the matcher's second sequence) that document part d holds in order: (share of the passage,
    first and end word in d).

    A word in both counts 1 and a word changed, dropped or put in costs COST; the stretch is the run of matching blocks with the
    largest sum. Sentences of one pattern with other words in their places break into runs too short to pay for the gaps.
    """
    best, cur = (0.0, 0.0, 0, 0), None
    matcher.set_seq1(d)
    for b in matcher.get_matching_blocks():
        if not b.size:
            continue
        if cur:
            left = cur[0] - COST * max(b.b - cur[2], b.a - cur[4])
        cur = (left + b.size, cur[1], b.b + b.size, cur[3], b.a + b.size) if cur and left > 0 else (float(b.size), b.b, b.b + b.size, b.a, b.a + b.size)
        best = max(best, (cur[0], (cur[2] - cur[1]) / len(matcher.b), cur[3], cur[4]))
    return best[1:]


class _Shard:
    """Texts of some documents with their index. pieces: (document, first word, numbers of its words); texts: the words of each."""

    def __init__(self, pieces: list[tuple[int, int, np.ndarray]], texts: list[list[str]], number: dict[str, int]):
        self.pieces, self.texts, self.number = pieces, texts, number
        self.starts = np.cumsum([0] + [len(x) + 1 for _, _, x in pieces[:-1]])
        seq = np.zeros(sum(len(x) + 1 for _, _, x in pieces), np.int64)
        for s, (_, _, x) in zip(self.starts, pieces):
            seq[s : s + len(x)] = x
        self.index = FMIndex(seq)

    def places(self, ps: _Passages) -> Iterator[tuple[np.ndarray, ...]]:
        """(piece, passage, offset in the passage, position in the shard) of phrases of passages, about AT_ONCE at a time."""
        get = self.number.get
        to = np.fromiter((get(w, -1) for w in ps.vocabulary), np.int64, len(ps.vocabulary))
        for phrases, first, count, passages, offsets in ps.groups:
            ids = to[phrases]
            known = np.flatnonzero((ids >= 0).all(1))
            lo, hi = self.index.search(ids[known])
            hit = hi > lo
            known, lo, n = known[hit], lo[hit], (hi - lo)[hit]
            load = np.cumsum(n * count[known])
            for part in np.split(np.arange(len(known)), np.searchsorted(load, np.arange(AT_ONCE, load[-1], AT_ONCE))) if len(known) else ():
                if not len(part):
                    continue
                at = self.index.locate(_ranges(lo[part], n[part]))
                ph = np.repeat(known[part], n[part])
                ref, at = _ranges(first[ph], count[ph]), np.repeat(at, count[ph])
                yield np.searchsorted(self.starts, at, side="right") - 1, passages[ref], offsets[ref], at


def _search_shard(shard: _Shard, ps: _Passages) -> list[tuple[int, int, float, int, int]]:
    """Leaks in a shard: (document, passage, share, first word, end word)."""
    length = np.minimum(ps.phrase, ps.size)
    least = np.maximum(length, CANDIDATE * ps.size)  # words to be covered
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    only = None  # the places, if they are one portion; else they are looked up again
    for n, place in enumerate(shard.places(ps)):
        only = None if n else place
        u, k = np.unique(place[0] * len(ps.ids) + place[1], return_counts=True)
        pairs, back = np.unique(np.concatenate([pairs, u]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, k])).astype(np.int64)
    if not len(pairs):
        return []
    of = pairs % len(ps.ids)
    enough = pairs[counts * length[of] >= least[of]]  # too few phrases for any band otherwise
    kept: list[list[np.ndarray]] = [[], [], [], []]
    for piece, passage, offset, at in shard.places(ps) if only is None else (only,):
        pair = piece * len(ps.ids) + passage
        i = np.minimum(np.searchsorted(enough, pair), max(0, len(enough) - 1))
        keep = enough[i] == pair if len(enough) else np.zeros(len(pair), bool)
        for c, v in zip(kept, (piece, passage, offset, at)):
            c.append(v[keep])
    piece, passage, offset, at = map(np.concatenate, kept)
    if not len(at):
        return []
    diagonal = at - shard.starts[piece] - offset + ps.longest  # never negative
    pair = piece * len(ps.ids) + passage
    enough_words = needed(ps.size)
    out = []
    seen: set[tuple[int, int, int]] = set()
    for shift in (0, BAND // 2):  # two overlapping divisions into bands: a run of changes that shifts it stays in one of them
        band = (diagonal + shift) // BAND
        by = np.lexsort((offset, band, pair))
        pr, bd, off, size = pair[by], band[by], offset[by], length[passage[by]]
        new = np.concatenate([[True], (pr[1:] != pr[:-1]) | (bd[1:] != bd[:-1])])
        # words newly covered by each phrase after the one before it in the same band
        gain = np.where(new, size, np.minimum(size, off - np.concatenate([[0], off[:-1]])))
        first = np.flatnonzero(new)
        covered = np.add.reduceat(gain, first)
        q = passage[by][first]
        for g in first[covered >= least[q]]:
            i = by[g]
            pc, pa = int(piece[i]), int(passage[i])
            mid = int(band[i]) * BAND - shift - ps.longest
            key = (pc, pa, mid // (2 * BAND))
            if key in seen:
                continue
            seen.add(key)
            a = max(0, mid - BAND)
            b = mid + int(ps.size[pa]) + 2 * BAND
            share, x, y = _stretch(ps.matcher(pa), shard.texts[pc][a:b])
            if share * ps.size[pa] >= enough_words[pa] - 1e-9:
                doc, base, _ = shard.pieces[pc]
                out.append((doc, pa, share, base + a + x, base + a + y))
    return out


def leaks(docs: DataFrame, passages: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, passage_id, share, start, end): where documents hold a passage; start and end are word numbers.

    share is the part of the passage in one stretch. Null, empty and wordless texts hold nothing. A passage is found from an intact
    run of PHRASE of its words on, or whole if it has fewer. Equal texts under several ids are searched once a shard and reported
    for each. Texts of any length are searched whole, in overlapping pieces. A passage held several times gives its longest
    stretch. Extra columns are ignored.
    """
    spark = docs.sparkSession
    parts: list[list[tuple[int, str]]] = [[]]
    room = PART_WORDS
    for r in passages.select("passage_id", "text").where("text IS NOT NULL AND passage_id IS NOT NULL").orderBy("passage_id").toLocalIterator():  # the query set; the corpus never comes here
        room -= len(r.text) // 3
        if room < 0 and parts[-1]:
            parts.append([])
            room = PART_WORDS - len(r.text) // 3
        parts[-1].append((r.passage_id, r.text))
    shared = [spark.sparkContext.broadcast(([i for i, _ in p], [t for _, t in p])) for p in parts]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = [_Passages(*b.value, PHRASE) for b in shared]
        overlap = 3 * max(ps.longest for ps in blocks) + 2 * BAND
        step = max(SHARD_WORDS - overlap, SHARD_WORDS // 2)
        find = word_pattern().findall

        def flush():
            shard = _Shard(pieces, texts, number)
            rows = [(i, ps.ids[pa], share, a, b) for ps in blocks for doc, pa, share, a, b in _search_shard(shard, ps) for i in holders[doc]]
            return pd.DataFrame(rows, columns=["doc_id", "passage_id", "share", "start", "end"])

        pieces, texts, number, raw, holders = [], [], {}, {}, {}
        same: dict[str, int] = {}
        total = 0
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                if t in same:
                    holders[same[t]].append(i)
                    continue
                doc = len(holders)
                same[t] = doc
                holders[doc] = [i]
                ws: list[str] = []
                for w in find(t):
                    v = raw.get(w)
                    if v is None:
                        v = raw[w] = loose(w)
                    if v:
                        ws.append(v)
                for a in range(0, max(1, len(ws)), step if len(ws) > SHARD_WORDS else max(1, len(ws))):
                    own = ws[a : a + SHARD_WORDS]
                    pieces.append((doc, a, np.fromiter((number.setdefault(w, len(number) + 1) for w in own), np.int64, len(own))))
                    texts.append(own)
                    total += len(own)
                    if total >= SHARD_WORDS:
                        yield flush()
                        pieces, texts, number, raw = [], [], {}, {}
                        same = {}  # a later copy of a text of which a piece is gone is searched afresh
                        holders = {0: holders[doc]} if a + SHARD_WORDS < len(ws) else {}
                        doc = 0  # the rest of a long text
                        total = 0
        if pieces:
            yield flush()

    found = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).dropna().mapInPandas(search, "doc_id long, passage_id long, share double, start long, end long")
    best = F.max(F.struct("share", "start", "end")).alias("b")
    return found.groupBy("doc_id", "passage_id").agg(best).select("doc_id", "passage_id", "b.share", "b.start", "b.end")


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, passages): overlapping or touching leaks of a document as one span of word numbers."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start", "end", "passage_id")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    marked = found.withColumn("new", new).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("passages")).drop("span")


def _of(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "heldout_passage"))


def p6_found(spark, d):
    return _of(spark, d).select("doc_id", "passage_id")


def p6_removal(spark, d):
    return removal_spans(_of(spark, d))


def p6_leaked_items(spark, d):
    per = _of(spark, d).groupBy("passage_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))
    return table(spark, d, "heldout_passage").select("passage_id", "suite").join(per, "passage_id", "left").select("passage_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), "largest_share")


QUERIES = {"p6_found": p6_found, "p6_removal": p6_removal, "p6_leaked_items": p6_leaked_items}
ORACLE: dict[str, str] = {}
