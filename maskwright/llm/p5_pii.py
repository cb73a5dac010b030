"""Problem 5: personal information inside free text.

A linear-chain conditional random field over word-shape features labels the tokens
of a sentence (begin and inside of six identifier types, or outside). It is trained
on the driver from a bounded sample of reviewed sentences and decoded by Viterbi
over whole Arrow batches in numpy.

Text is first folded character by character to one alphabet without changing any
offset; numbers with their separators, e-mail addresses (also spelled out) and bank
account numbers are one token each. What a token adds to the score of its
neighbours' labels depends on the token alone, so it is computed once for each
distinct shape and word of a batch and then only looked up.
"""

from __future__ import annotations

import gc
import hashlib
import inspect
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import charmap
from maskwright.functions.session import shared_dir, table
from maskwright.llm.common import LABELS, canonical_label, squash

#: The model is fitted on at most so many reviewed sentences, and on so many that are labelled to hold nothing, those with the
#: smallest hash of their id.
TRAIN_SENTENCES = 4000
TRAIN_NEGATIVES = 900
ITERATIONS = 90
WINDOW = 3
#: Share of tokens whose own features are hidden in a training step, so that the words around them are learnt as well.
DROPOUT = 0.25
TAGS = ["O"] + [f"{b}-{x}" for x in LABELS for b in "BI"]
N = len(TAGS)
_KNOWN_TYPES = 200_000

Z = "​"  # stands for every character that draws nothing


@lru_cache(1)
def _aligned_table() -> dict[int, str]:
    """One character for one character: look-alikes, digits, spaces and accents folded, marks and invisible characters to Z."""
    src, dst = charmap.lookalike_pairs()
    t = {ord(a): b for a, b in zip(src, dst)}
    for k, v in charmap.presentation_pairs()[2].items():
        t[ord(k)] = v[0]
    for own in (charmap.ARABIC_INDIC, charmap.EXT_ARABIC_INDIC):
        t |= {ord(a): b for a, b in zip(own, charmap.WESTERN)}
    for a, b in charmap.invisible_ranges():
        t |= dict.fromkeys(range(a, b + 1), Z)
    for c in (*range(0x300, 0x370), *range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6DD), 0x640):
        t[c] = Z
    for c in (*range(0xC0, 0x250), *range(0x622, 0x627)):
        d = unicodedata.normalize("NFD", chr(c))[0]
        if d != chr(c):
            t[c] = d
    t[ord("ى")] = "ي"
    return t


def align(text: str) -> str:
    return text if text.isascii() else text.translate(_aligned_table())


@lru_cache(1)
def _aligned_codes() -> np.ndarray:
    """The same table as an array over the code points of the first two planes, beyond which nothing is folded."""
    out = np.arange(0x20000, dtype=np.uint32)
    for c, to in _aligned_table().items():
        if c < len(out):
            out[c] = ord(to)
    return out


def align_many(texts: list[str]) -> list[str]:
    """align of many texts, by one table lookup over all their characters; a batch that holds others, or is very long, goes one by one."""
    table = _aligned_codes()
    if sum(map(len, texts)) > 8_000_000:
        return [align(t) for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) and int(codes.max()) >= len(table):
        return [align(t) for t in texts]
    whole, at, out = table[codes].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), 0, []
    for n in map(len, texts):
        out.append(whole[at : at + n])
        at += n
    return out


_S = rf"[ {Z}]*"


def _patterns(z: str) -> tuple[re.Pattern, re.Pattern]:
    """Tokens of texts with and without addresses. z: what may stand between the characters of a token - characters that draw
    nothing, or nothing in texts that have none."""
    s = rf"[ {Z}]*"
    letters = rf"[^\W\d_](?:{z}[^\W\d_])*" if z else r"[^\W\d_]+"
    at = rf"(?:{s}@{s}|{s}[\[(]{s}(?:at|AT|At){s}[\])]{s})"
    dot = rf"(?:{z}\.{z}|{s}[\[(]{s}(?:dot|DOT|Dot){s}[\])]{s}| (?:dot|DOT) )"
    local = rf"[A-Za-z0-9](?:[A-Za-z0-9._%+\-{Z}]*[A-Za-z0-9])?"
    label = rf"[A-Za-z0-9](?:[A-Za-z0-9{Z}\-]*[A-Za-z0-9])?"
    domain = rf"{label}(?:{dot}{label})*{dot}[A-Za-z](?:{z}[A-Za-z])+(?![A-Za-z0-9])"
    # A bare word "at" is a sign only in capitals, or after a name with a digit or separator in it, and not before another sign.
    bare = rf"(?:{local}{s} AT {s}|(?=[A-Za-z]*[0-9._+])(?:{local}){s} at {s}){domain}(?!{at}|[0-9_+]|\.\w| AT )"
    # Between digits of one number: nothing, a comma, or a separator with a bracket and another one after that.
    num_sep = rf"{z}(?:,|(?:[ .\-/:]{z})?(?:[()]{z}(?:[ .\-]{z})?)?)"
    other = (
        rf"(?P<iban>[A-Za-z]{z}[A-Za-z]{z}\d{z}\d(?:[ \-{Z}]*[A-Za-z](?:{z}[A-Za-z]){{3}})?(?:[ \-{Z}]*\d){{8,}}(?![A-Za-z]))"
        rf"|(?P<num>(?:\({z})?\+?{z}(?<![A-Za-z0-9_])\(?{z}\d(?:{num_sep}\d)*)"
        rf"|(?P<initial>\b[A-Z]{z}\.(?= ?[A-Z]))"
        rf"|(?P<word>{letters}(?:{z}['’\-]{z}{letters})*)"
        rf"|(?P<mixed>[\w{Z}]*\w(?:[\-_][\w{Z}]*\w)*)"
        rf"|(?P<sign>[^\s{Z}])"
    )
    with_mail = re.compile(rf"(?P<mail>{local}{at}{domain}|{bare})|{other}")
    return with_mail, re.compile(other)


#: By whether a text has characters that draw nothing.
_TOKEN = {True: _patterns(f"{Z}*"), False: _patterns("")}
#: What every address holds in some form: a text without it needs no search for addresses.
_ANY_AT = re.compile(rf"@| at | AT |[\[(]{_S}(?:at|AT|At){_S}[\])]")
_SEP = re.compile(r"[^0-9A-Za-z+]+")
_CODES = ("966", "971", "964", "962", "965", "973", "20")


def tokens(text: str, aligned: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type key) of each token; the key holds all that its features use."""
    a = align(text) if aligned is None else aligned
    hidden = Z in a
    out = []
    for m in _TOKEN[hidden][0 if _ANY_AT.search(a) else 1].finditer(a):
        kind, w = m.lastgroup, m.group()
        if hidden:
            w = w.replace(Z, "")
        if kind == "word" or kind == "sign":
            key = w
        elif kind == "num":
            key = _number_key(w.rstrip(")") if "(" not in w else w)
        elif kind == "mail":
            key = f"\x01mail {'@' if '@' in w else 'at'}"
        elif kind == "iban":
            c = _SEP.sub("", w)
            key = f"\x01iban {c[:2].upper()} {len(c)} {'g' if len(c) < len(w) else 'c'}"
        elif kind == "initial":
            key = "\x01initial "
        else:
            key = "\x01mixed " + re.sub(r"\d", "9", w)[:24]
        out.append((*m.span(), key))
    return out


def _number_key(w: str) -> str:
    d = re.sub(r"\D", "", w)
    plus = "+" if "+" in w else "00" if d.startswith("00") else ""
    bare = d[2:] if plus == "00" else d
    code = next((c for c in _CODES if bare.startswith(c)), "") if plus else ""
    seps = "".join(sorted(set(re.sub(r"[\d+]", "", w))))
    groups = re.split(r"\D+", w.strip("+( "))
    form = "-".join(str(len(g)) for g in groups) if len(groups) <= 5 else f"{len(groups)}g"
    first = d[:1] if len(d) >= 9 else ""
    return f"\x01num {len(d)}|{plus}|{code}|{first if not plus else ''}|{d[:2] if len(d) >= 9 and d[:1] == '0' and not plus else ''}|{seps}|{form}"


def features_of(key: str) -> list[str]:
    """Feature names of a token type."""
    if key[0] == "\x01":
        kind, _, rest = key[1:].partition(" ")
        f = [f"k={kind}", f"K={key}"]
        if kind == "num":
            n, plus, code, first, two, seps, form = rest.split("|")
            f += [f"n={n}", f"n+={n}{plus}", f"c={plus}{code}", f"f={n}:{first}", f"t={two}:{n}", f"s={seps}", f"sf={seps}{form}", f"len={'s' if int(n) < 5 else 'm' if int(n) < 9 else 'l'}"]
        elif kind == "iban":
            f += [f"cc={rest[:2]}", f"l={rest.split()[1]}"]
        elif kind == "mixed":
            f += ["ms=" + re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Z]", "X", re.sub(r"[a-z]", "x", rest)))]
        return f
    low = key.lower()
    if len(key) == 1 and not key.isalnum():
        return [f"p={key}", "k=sign"]
    arabic = "؀" <= key[0] <= "ۿ"
    shape = "ar" if arabic else ("X" if key.isupper() else "Xx" if key[0].isupper() else "x") + ("-" if "-" in key else "")
    f = ["k=word", f"w={low}", f"sh={shape}", f"s3={low[-3:]}", f"p3={low[:3]}", f"s2={low[-2:]}", f"p2={low[:2]}"]
    if arabic and low.startswith("ال") and len(low) > 4:
        f += ["al", f"st={low[2:]}"]
    if arabic and len(low) > 3:
        f += [f"c={low[0]}:{low[1:]}"]
    if "-" in low:
        f += [f"h={low.partition('-')[0]}", f"ht={low.rpartition('-')[2]}"]
    return f


def _pad(seqs: list[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    out = np.full((len(seqs), int(n.max()) if len(n) else 0), fill, np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out, n


class Model:
    """Weights W[offset][feature, tag], transitions T[tag, tag], start scores."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.names, self.weights, self.trans, self.start = names, weights, trans, start
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.tables: np.ndarray | None = None

    def type_scores(self, keys: list[str]) -> np.ndarray:
        """[type, offset, tag]: what a token adds to the tag of the token at each offset before or after it."""
        out = np.zeros((len(keys), 2 * WINDOW + 1, N), np.float32)
        for i, k in enumerate(keys):
            ids = [self.names[f] for f in features_of(k) if f in self.names]
            if ids:
                out[i] = self.weights[:, ids].sum(1)
        return out

    def ids(self, seqs: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the types of each sequence; new ones are scored once."""
        if len(self.known) > _KNOWN_TYPES:
            self.known, self.tables = {}, None
        base = len(self.known)
        known = self.known
        out = [np.fromiter((known.setdefault(k, len(known)) for k in s), np.int64, len(s)) for s in seqs]
        fresh = list(known)[base:]
        if fresh or self.tables is None:
            new = self.type_scores(fresh)
            self.tables = new if self.tables is None else np.concatenate([self.tables, new])
        return out

    def decode(self, seqs: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each sequence, by Viterbi over sequences of like length together."""
        ids = self.ids(seqs)
        order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
        blank = np.zeros((1, 2 * WINDOW + 1, N), np.float32)
        tables = np.concatenate([self.tables, blank])
        for lo in range(0, len(order), 512):
            part = order[lo : lo + 512]
            while part:  # very long texts a few at a time
                take = max(1, min(len(part), 400_000 // len(ids[part[-1]])))
                now, part = part[-take:], part[:-take]
                x, n = _pad([ids[i] for i in now], len(tables) - 1)
                for i, t in zip(now, viterbi(emissions(x, tables), n, self.trans, self.start)):
                    out[i] = t
        return out


def emissions(x: np.ndarray, tables: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Scores of each tag at each token. own: where a token's own features count (everywhere, if not given)."""
    b, t = x.shape
    e = np.zeros((b, t, N), np.float32)
    for o in range(-WINDOW, WINDOW + 1):  # the token at position j speaks to position j - o
        lo, hi = max(0, o), min(t, t + o)
        if lo < hi:
            part = tables[x[:, lo:hi], o + WINDOW]
            e[:, lo - o : hi - o] += part if o or own is None else part * own[:, :, None]
    return e


def viterbi(e: np.ndarray, n: np.ndarray, trans: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    b, t, _ = e.shape
    back = np.zeros((b, t, N), np.int8)
    into = np.ascontiguousarray(trans.T)
    v = e[:, 0] + start
    best_end = np.zeros((b, t), np.int8)
    best_end[:, 0] = v.argmax(1)
    for j in range(1, t):
        m = v[:, None, :] + into  # the tag before in the last axis, where a maximum is found fastest
        k = m.argmax(2)
        back[:, j] = k
        v = np.take_along_axis(m, k[:, :, None], 2)[:, :, 0] + e[:, j]
        best_end[:, j] = v.argmax(1)
    out = np.zeros((b, t), np.int64)
    rows = np.arange(b)
    cur = best_end[rows, n - 1].astype(np.int64)
    for j in range(t - 1, -1, -1):
        cur = np.where(j == n - 1, best_end[rows, np.minimum(j, n - 1)], cur)
        out[:, j] = cur
        cur = np.where(j < n, back[rows, j, cur], cur)
    return [out[i, : n[i]] for i in range(b)]


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, a large penalty where not: inside only after begin or inside of its type."""
    pen = np.zeros((N, N), np.float32)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, s in enumerate(TAGS):
                if s[2:] != t[2:] or s == "O":
                    pen[i, j] = -1e4
    return pen


def train(seqs: list[list[str]], tags: list[np.ndarray], iterations: int = ITERATIONS, l2: float = 0.004) -> Model:
    """Maximum conditional likelihood with a Gaussian prior, by Adam on the full batch; features seen once are left out."""
    counts: dict[str, int] = {}
    types: dict[str, int] = {}
    for s in seqs:
        for k in s:
            if k not in types:
                types[k] = len(types)
            for f in features_of(k):
                counts[f] = counts.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c > 1))}
    fid, owner = [], []
    for k, i in types.items():
        own = [names[f] for f in features_of(k) if f in names]
        fid += own
        owner += [i] * len(own)
    fid, owner = np.array(fid, np.int64), np.array(owner, np.int64)
    by_f = np.argsort(fid, kind="stable")
    f_first = np.flatnonzero(np.concatenate([[True], np.diff(fid[by_f]) > 0])) if len(fid) else np.zeros(0, np.int64)
    o_first = np.flatnonzero(np.concatenate([[True], np.diff(owner) > 0])) if len(owner) else np.zeros(0, np.int64)
    width = 2 * WINDOW + 1
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    groups = []
    for lo in range(0, len(order), 256):
        part = [i for i in order[lo : lo + 256] if len(seqs[i])]
        if part:
            x, n = _pad([np.array([types[k] for k in seqs[i]]) for i in part], len(types))
            y, _ = _pad([tags[i] for i in part], -1)
            groups.append((x, n, y))
    total = max(1, sum(len(s) for s in seqs))
    W = np.zeros((width, max(1, len(names)), N), np.float32)
    T, S = np.zeros((N, N), np.float32), np.zeros(N, np.float32)
    rng = np.random.default_rng(5)
    pen = _allowed()
    pen0 = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)
    state = [np.zeros_like(a) for a in (W, W, T, T, S, S)]
    for it in range(1, iterations + 1):
        tables = np.zeros((len(types) + 1, width, N), np.float32)
        if len(fid):
            for o in range(width):
                tables[owner[o_first], o] = np.add.reduceat(W[o, fid], o_first, axis=0)
        g_tab = np.zeros_like(tables)
        gT, gS = np.zeros_like(T), np.zeros_like(S)
        M = np.exp(np.maximum(T + pen, -60.0)).astype(np.float32)
        for x, n, y in groups:
            own = rng.random(x.shape) >= DROPOUT
            e = emissions(x, tables, own)
            b, t, _ = e.shape
            real = np.arange(t)[None] < n[:, None]
            top = e.max(2, keepdims=True)
            x_e = np.exp(e - top)
            alpha, scale = np.zeros_like(e), np.ones((b, t), np.float32)
            a = x_e[:, 0] * np.exp(np.maximum(S + pen0, -60.0))
            for j in range(t):
                if j:
                    a = (alpha[:, j - 1] @ M) * x_e[:, j]
                scale[:, j] = a.sum(1) + 1e-30
                alpha[:, j] = a / scale[:, j : j + 1]
            beta = np.zeros_like(e)
            last = np.ones((b, N), np.float32)
            pair = np.zeros((N, N), np.float32)
            for j in range(t - 1, -1, -1):
                if j < t - 1:
                    nxt = beta[:, j + 1] * x_e[:, j + 1] / scale[:, j + 1 : j + 2]
                    on = (j + 1 < n)[:, None]
                    beta[:, j] = np.where(on, nxt @ M.T, last)
                    pair += (alpha[:, j] * on).T @ nxt
                else:
                    beta[:, j] = last
            p = alpha * beta
            p /= p.sum(2, keepdims=True) + 1e-30
            gold = np.zeros_like(p)
            bi, ji = np.nonzero(real)
            gold[bi, ji, y[bi, ji]] = 1
            d = (gold - p) * real[:, :, None]
            gS += d[:, 0].sum(0)
            np.add.at(gT, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
            gT -= pair * M
            for o in range(-WINDOW, WINDOW + 1):
                lo, hi = max(0, o), min(t, t + o)
                if lo < hi:
                    ds = d[:, lo - o : hi - o]
                    xs, ds = x[:, lo:hi].ravel(), (ds if o else ds * own[:, :, None]).reshape(-1, N)
                    for c in range(N):
                        g_tab[:, o + WINDOW, c] += np.bincount(xs, ds[:, c], len(types) + 1)
        gW = np.zeros_like(W)
        if len(fid):
            for o in range(width):
                gW[o, fid[by_f][f_first]] = np.add.reduceat(g_tab[owner[by_f], o], f_first, axis=0)
        rate = 0.12 * min(1.0, 2.5 * (1 - it / (iterations + 1)))
        for k, (v, g) in enumerate(((W, gW), (T, gT), (S, gS))):
            g = g / total * 50 - l2 * v / 50
            m1, m2 = state[2 * k], state[2 * k + 1]
            m1 += 0.15 * (g - m1)
            m2 += 0.02 * (g * g - m2)
            v += rate * (m1 / (1 - 0.85**it)) / (np.sqrt(m2 / (1 - 0.98**it)) + 1e-6)
    return Model(names, W, (T + pen).astype(np.float32), (S + pen0).astype(np.float32))


def tag_sentence(toks: list[tuple[int, int, str]], spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Tags of the tokens from spans: a token belongs to the span that holds its middle."""
    out = np.zeros(len(toks), np.int64)
    for s, e, label in spans:
        first = True
        for i, (a, b, _) in enumerate(toks):
            if s <= (a + b - 1) / 2 < e:
                out[i] = TAGS.index(f"{'B' if first else 'I'}-{label}")
                first = False
    return out


def spans_of(text: str, toks: list[tuple[int, int, str]], tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Labelled spans, from the first to the last token of each."""
    out: list[tuple[int, int, str]] = []
    for (a, b, _), t in zip(toks, tags):
        if not t:
            continue
        kind, label = TAGS[t][0], TAGS[t][2:]
        if kind == "I" and out and out[-1][2] == label:
            out[-1] = (out[-1][0], b, label)
        else:
            out.append((a, b, label))
    return out


def training_rows(items: DataFrame, gold: DataFrame, limit: int = TRAIN_SENTENCES, negatives: int = TRAIN_NEGATIVES) -> list:
    """At most `limit` reviewed sentences with their spans, and at most `negatives` unreviewed ones whose type is NEGATIVE, those
    with the smallest hash of the id. Both are bounded, whatever the size of the tables."""
    g = gold.select("sentence_id", "start", "end", canonical_label("label").alias("label")).dropna().where(F.col("label").isin(*LABELS)).distinct()
    ids = g.select("sentence_id").distinct().orderBy(F.xxhash64("sentence_id"), "sentence_id").limit(limit)
    t = items.select("sentence_id", "text").dropna().join(F.broadcast(ids), "sentence_id").groupBy("sentence_id").agg(F.min("text").alias("text"))
    s = g.join(F.broadcast(ids), "sentence_id").groupBy("sentence_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "label"))).alias("spans"))
    none = items.where(squash("type") == "negative").select("sentence_id", "text").dropna().join(g.select("sentence_id"), "sentence_id", "left_anti")
    none = none.groupBy("sentence_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("sentence_id"), "sentence_id").limit(negatives)
    both = t.join(s, "sentence_id").unionByName(none, allowMissingColumns=True)
    return both.select("sentence_id", "text", "spans").orderBy("sentence_id").collect()


def fit(rows: list, iterations: int = ITERATIONS) -> Model:
    seqs, tags = [], []
    for r in rows:
        toks = tokens(r["text"])
        seqs.append([k for _, _, k in toks])
        tags.append(tag_sentence(toks, [(x[0], x[1], x[2]) for x in r["spans"] or []]))
    return train(seqs, tags, iterations)


def save(model: Model, spark: SparkSession, path: str) -> None:
    """The model as one row of a table."""
    names = sorted(model.names, key=model.names.__getitem__)
    row = (names, *(bytes(np.ascontiguousarray(x, np.float32)) for x in (model.weights, model.trans, model.start)), list(model.weights.shape))
    spark.createDataFrame([row], "names array<string>, weights binary, trans binary, start binary, shape array<int>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model | None:
    """The model kept at a path; None if there is none, or one whose writing did not end."""
    try:
        r = spark.read.parquet(path).first()
    except AnalysisException:
        return None
    if r is None:
        return None
    numbers = lambda b, shape: np.frombuffer(b, np.float32).reshape(shape)
    return Model({n: i for i, n in enumerate(r.names)}, numbers(r.weights, r.shape), numbers(r.trans, (N, N)), numbers(r.start, N))


def model_of(items: DataFrame, gold: DataFrame) -> Model:
    """The model for these tables: fitted once and kept in the shared folder under a digest of its training rows, parameters and
    code, from where later queries load it."""
    spark = items.sparkSession
    rows = training_rows(items, gold)
    said = repr([(r["text"], [tuple(x) for x in r["spans"] or []]) for r in rows]) + f"|{ITERATIONS}|{WINDOW}|{DROPOUT}|{inspect.getsource(inspect.getmodule(fit))}"
    path = f"{shared_dir(spark).rstrip('/')}/p5-model-{hashlib.sha256(said.encode()).hexdigest()[:32]}"
    model = load(spark, path)
    if model is None:
        model = fit(rows)
        save(model, spark, path)
    return model


def detect(texts: DataFrame, model: Model) -> DataFrame:
    """(sentence_id, text_key, start, end, label) for every text. Null and blank texts hold nothing; texts of any length are decoded
    whole. Repeated rows give their spans once; a sentence_id with several texts gives the spans of each, told apart by text_key."""
    shared = texts.sparkSession.sparkContext.broadcast((model.names, model.weights, model.trans, model.start))

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        gc.freeze()  # the model and the tables live as long as the task: no need to look through them again and again
        for pdf in parts:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo : lo + 2048]
                texts_ = part["text"].tolist()
                toks = [tokens(t, a) for t, a in zip(texts_, align_many(texts_))]
                tags = m.decode([[k for _, _, k in x] for x in toks])
                found = [spans_of(t, x, y) for t, x, y in zip(part["text"], toks, tags)]
                each = np.fromiter(map(len, found), np.int64, len(found))
                start, end, label = zip(*(s for f in found for s in f)) if each.any() else ((), (), ())
                own = {c: np.repeat(part[c].to_numpy(), each) for c in ("sentence_id", "text_key")}
                yield pd.DataFrame(own | {"start": np.array(start, np.int32), "end": np.array(end, np.int32), "label": np.array(label, object)})

    own = texts.select("sentence_id", "text").dropna().distinct().withColumn("text_key", F.xxhash64("text"))
    return own.mapInPandas(find, "sentence_id string, text_key long, start int, end int, label string")


def mask(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(sentence_id, text, masked, n_spans): each span replaced by its type in brackets, the rest of the text kept. spans have the
    text_key of their text, so a sentence_id with several texts has each masked by its own."""
    packed = spans.groupBy("sentence_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end", "label"))).alias("s"))
    piece = F.expr(
        "aggregate(s, named_struct('out', '', 'at', 0), (a, x) -> if(x.start < a.at, a, named_struct('out', concat(a.out, substring(text, a.at + 1, x.start - a.at), '[', x.label, ']'), 'at', x.end)), "
        "a -> concat(a.out, substring(text, a.at + 1)))"
    )
    t = texts.select("sentence_id", "text").dropna(subset=["sentence_id"]).distinct().withColumn("text_key", F.xxhash64("text"))
    return t.join(packed, ["sentence_id", "text_key"], "left").select("sentence_id", "text", F.when(F.col("s").isNull(), F.col("text")).otherwise(piece).alias("masked"), F.coalesce(F.size("s"), F.lit(0)).alias("n_spans"))


def _texts(spark, d) -> DataFrame:
    return table(spark, d, "items").select("sentence_id", "text").unionByName(table(spark, d, "sample_for_annotation").select("sentence_id", "text"))


def _found(spark, d) -> DataFrame:
    reviewed = table(spark, d, "gold").select("sentence_id").distinct()
    model = model_of(table(spark, d, "items"), table(spark, d, "gold"))
    return detect(_texts(spark, d).join(reviewed, "sentence_id", "left_anti"), model)


def p5_found(spark, d):
    return _found(spark, d).select("sentence_id", "start", "end", "label").distinct()


def p5_masked(spark, d):
    """Every sentence with typed placeholders: the reviewed spans where there are any (they name a sentence, so they hold for each
    of its texts that is long enough), the model's elsewhere."""
    texts = _texts(spark, d)
    gold = table(spark, d, "gold").select("sentence_id", "start", "end", canonical_label("label").alias("label")).dropna().distinct()
    own = texts.dropna().distinct().withColumn("text_key", F.xxhash64("text"))
    reviewed = own.join(gold, "sentence_id").where(F.col("end") <= F.length("text")).select("sentence_id", "text_key", "start", "end", "label")
    return mask(texts, _found(spark, d).unionByName(reviewed)).select("sentence_id", "masked", "n_spans")


QUERIES = {"p5_found": p5_found, "p5_masked": p5_masked}
ORACLE: dict[str, str] = {}
