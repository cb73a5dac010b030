"""Copies of texts that are longer than a shard."""

import random

from maskwright.llm import p6_leak as p6


def test_p6_copies_of_a_text_longer_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(p6, "SHARD_WORDS", 2000)
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage = say(60)
    text = " ".join(say(40) + passage + say(4500))
    d = spark.createDataFrame([(1, text), (2, text), (3, "short one"), (4, text)], "doc_id long, text string").coalesce(1)
    p = spark.createDataFrame([(7, " ".join(passage))], "passage_id long, text string")
    assert {(r.doc_id, r.start, r.end) for r in p6.leaks(d, p).collect()} == {(i, 40, 100) for i in (1, 2, 4)}


def test_p6_short_passages(spark):
    """A passage of up to PHRASE words is found where it stands whole."""
    docs = [(1, "so the quick brown fox ran"), (2, "a quick brown dog"), (3, "Alpha! and omega"), (4, "the quick red fox ran")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame([(1, "alpha"), (2, "quick brown"), (3, "quick brown fox"), (4, "quick brown fox ran"), (5, "the quick brown fox ran"), (6, "")], "passage_id long, text string")
    got = {(r.doc_id, r.passage_id) for r in p6.leaks(d, p).collect()}
    assert got == {(3, 1), (1, 2), (2, 2), (1, 3), (1, 4), (1, 5)}


def test_p6_half_is_enough_and_less_is_not(spark):
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, passages, want = [], [], set()
    for n in (12, 20, 37, 60, 101):
        passage = say(n)
        passages.append((n, " ".join(passage)))
        for k in range(n // 4, n + 1):
            at = rng.randrange(n - k + 1)
            rows.append((n * 1000 + k, " ".join(say(15) + passage[at : at + k] + say(15))))
            if k >= p6.needed(n):
                want.add((n * 1000 + k, n))
    got = {(r.doc_id, r.passage_id) for r in p6.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(passages, "passage_id long, text string")).collect()}
    assert got == want


def test_p6_portions_and_blocks_give_the_same(spark, monkeypatch):
    """Set phrases that many passages hold, looked at in small portions and blocks."""
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(60)]
    phrase = vocab[:5]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [say(10) + phrase + say(10) for _ in range(40)]
    docs = [say(20) + phrase + say(10) + (rng.choice(passages)[: rng.randint(8, 25)] if i % 2 else []) for i in range(120)]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    p = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(passages)], "passage_id long, text string")
    whole = sorted(map(tuple, p6.leaks(d, p).collect()))
    for name, value in (("AT_ONCE", 50), ("PART_WORDS", 60)):
        monkeypatch.setattr(p6, name, value)
        assert sorted(map(tuple, p6.leaks(d, p).collect())) == whole
    assert whole


def test_p6_two_million_words_of_passages_fit(monkeypatch):
    """Sparse counting: a block of two million words against a shard of short texts stays far below a task's memory."""
    import resource

    import numpy as np

    rng = np.random.default_rng(3)
    texts = [" ".join(f"a{x}" for x in rng.integers(0, 30_000, 100)) for _ in range(20_000)]
    ps = p6._Passages(list(range(len(texts))), texts, p6.PHRASE)
    pieces, words, number = [], [], {}
    for i in range(4000):
        own = ps.words[i][:60] if i % 40 == 0 else [f"a{x}" for x in rng.integers(0, 30_000, 100)]
        pieces.append((i, 0, np.array([number.setdefault(w, len(number) + 1) for w in own])))
        words.append(own)
    got = p6._search_shard(p6._Shard(pieces, words, number), ps)
    assert {(d, p) for d, p, *_ in got} == {(i, i) for i in range(0, 4000, 40)}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 3 * 1024 * 1024
