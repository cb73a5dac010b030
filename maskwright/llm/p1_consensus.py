"""Problem 1: consensus spans from several annotators who disagree.

Marks of one sentence that overlap form an item; its options are the distinct marked
spans with their labels, and "nothing here". Everyone who finished the sentence
votes on each of its items. Ability and difficulty are latent: annotator j is right
on item i with probability s(a_j * b_i), s the logistic function. Expectation-
maximisation alternates the posterior of each item's true option with gradient steps
on a (over all items) and b (inside the item). A wrong vote is a miss with a learnt
share NU, else one of the other options; a wrong mark hardly ever coincides with
another, so marks that agree weigh more than agreeing misses.

Items live in files, one row each with its votes as arrays; a pass over them is
numpy over whole Arrow batches and sends one row per task and annotator back. Only
the annotators' abilities - a row per person - are held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.session import cut, table
from maskwright.llm.common import canonical_label

#: Rounds go on until no ability moves by TOLERANCE; a fit that needs more than ROUNDS says so in its report.
ROUNDS, TOLERANCE = 100, 0.01
INNER = 4
#: Options that a wrong mark is spread over besides those that were marked.
SPREAD = 8.0
PRIOR_MEAN, PRIOR_VAR = 1.5, 2.0
_ITEM = "sentence_id string, starts array<int>, ends array<int>, labels array<string>, annotators array<string>, choices array<int>"


def _items_of(done: list[str], marks: list[tuple[int, int, str, str]]) -> Iterator[tuple]:
    """Items of one sentence: overlapping marks chained, empty spans by their position."""
    marks = sorted(marks)
    i = 0
    while i < len(marks):
        j, end = i + 1, max(marks[i][1], marks[i][0] + 1)
        while j < len(marks) and marks[j][0] < end:
            end = max(end, marks[j][1])
            j += 1
        options = sorted({m[:3] for m in marks[i:j]})
        number = {o: k + 1 for k, o in enumerate(options)}
        votes = [(m[3], number[m[:3]]) for m in marks[i:j]]
        marked = {v[0] for v in votes}
        votes += [(a, 0) for a in done if a not in marked]
        yield [o[0] for o in options], [o[1] for o in options], [o[2] for o in options], [v[0] for v in votes], [v[1] for v in votes]
        i = j


def build_items(marks: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per item. Only tasks with status done (in any spelling) vote; marks need sentence, annotator, start, end and label."""
    done = tasks.where(F.lower(F.trim("status")) == "done").select("sentence_id", "annotator_id").dropna().distinct()
    m = marks.select("sentence_id", "annotator_id", "start", "end", canonical_label("label").alias("label")).dropna().where("label <> ''").distinct()
    m = m.join(done, ["sentence_id", "annotator_id"], "left_semi")
    packed = m.groupBy("sentence_id").agg(F.collect_list(F.struct("start", "end", "label", "annotator_id")).alias("marks"))
    packed = packed.join(done.groupBy("sentence_id").agg(F.collect_list("annotator_id").alias("done")), "sentence_id")

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for sid, ms, done_ in zip(pdf["sentence_id"], pdf["marks"], pdf["done"]):
                rows += [(sid, *r) for r in _items_of(sorted(done_), [(x["start"], x["end"], x["label"], x["annotator_id"]) for x in ms])]
            yield pd.DataFrame(rows, columns=["sentence_id", "starts", "ends", "labels", "annotators", "choices"])

    return packed.mapInPandas(split, _ITEM)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Batch:
    """The votes of a batch of items as flat arrays: slot = option of an item, option 0 first."""

    def __init__(self, b: pa.RecordBatch, ability: dict[str, float]):
        c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        ann = c["annotators"]
        sizes = np.diff(ann.offsets.to_numpy())
        self.n = len(sizes)
        self.item = np.repeat(np.arange(self.n), sizes)
        coded = ann.flatten().dictionary_encode()
        self.people, self.code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.a = np.array([ability.get(w, PRIOR_MEAN) for w in self.people], float)[self.code]
        self.choice = c["choices"].flatten().to_numpy(zero_copy_only=False)
        self.k = np.diff(c["starts"].offsets.to_numpy()) + 1
        self.first = np.concatenate([[0], np.cumsum(self.k)[:-1]])
        self.slot_item = np.repeat(np.arange(self.n), self.k)
        self.is_none = np.zeros(len(self.slot_item), bool)
        self.is_none[self.first] = True

    def posterior(self, beta: np.ndarray, nu: float) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each slot, probability of each vote to be right a priori)."""
        p = _sigmoid(self.a * beta[self.item])
        wrong = np.log1p(-p)
        others = np.log(self.k[self.item] - 1 + SPREAD)
        # A vote's log-likelihood when the truth is another option: by whether the truth is "nothing" and whether the vote is.
        vote_none = self.choice == 0
        if_none = wrong - others
        if_other = wrong + np.where(vote_none, np.log(nu), np.log1p(-nu) - others)
        n_slots = len(self.slot_item)
        base_other = np.bincount(self.item, if_other, self.n)
        base_none = np.bincount(self.item, np.where(vote_none, 0.0, if_none), self.n)
        score = np.where(self.is_none, base_none[self.slot_item], base_other[self.slot_item])
        slot = self.first[self.item] + self.choice
        score += np.bincount(slot, np.where(vote_none, np.log(p), np.log(p) - if_other), n_slots)
        top = np.maximum.reduceat(score, self.first)
        q = np.exp(score - top[self.slot_item])
        q /= np.add.reduceat(q, self.first)[self.slot_item]
        return q, p

    def settle(self, nu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log b, posterior, right a posteriori, right a priori) after INNER gradient steps on the items' own b."""
        logb = np.zeros(self.n)
        slot = self.first[self.item] + self.choice
        for _ in range(INNER):
            q, p = self.posterior(np.exp(logb), nu)
            step = np.bincount(self.item, (q[slot] - p) * self.a, self.n) * np.exp(logb) - logb / 0.25
            logb = np.clip(logb + 0.08 * step, -1.5, 1.5)
        q, p = self.posterior(np.exp(logb), nu)
        return logb, q, q[slot], p


def _pass(items: DataFrame, ability: dict[str, float], nu: float) -> list:
    """Gradient and curvature sums of each annotator's ability, with votes, expected right votes, and misses among wrong ones."""

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            x = _Batch(b, ability)
            logb, q, right, p = x.settle(nu)
            beta = np.exp(logb)[x.item]
            some = 1 - q[x.first][x.item]  # the item holds something
            total = lambda v: np.bincount(x.code, v, len(x.people))  # noqa: B023, E731
            sums_of = [total(v) for v in ((right - p) * beta, p * (1 - p) * beta**2, np.ones(len(right)), right, np.where(x.choice == 0, 1 - right, 0.0), np.where(x.choice > 0, np.maximum(0, some - right), 0.0))]
            yield pa.RecordBatch.from_arrays([pa.array(x.people, pa.string()), *map(pa.array, sums_of)], ["who", "g", "h", "n", "right", "miss", "slip"])

    return items.mapInArrow(sums, "who string, g double, h double, n double, right double, miss double, slip double").groupBy("who").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n", "right", "miss", "slip")]).orderBy("who").collect()


def fit(items: DataFrame, rounds: int = ROUNDS) -> tuple[dict[str, dict], float, list[dict]]:
    """({annotator: ability, votes, reliability}, share of misses among wrong votes, report: a row per round). The last row tells
    whether the fit has converged."""
    ability: dict[str, float] = {}
    nu, out, report = 0.5, {}, []
    for n in range(rounds):
        moved = 0.0
        rows = _pass(items, ability, nu)
        for r in rows:
            a = ability.get(r.who, PRIOR_MEAN)
            step = (r.g - (a - PRIOR_MEAN) / PRIOR_VAR) / (r.h + 1 / PRIOR_VAR)
            step = max(-1.0, min(1.0, step))
            ability[r.who] = a + step
            moved = max(moved, abs(step))
            out[r.who] = {"ability": ability[r.who], "votes": int(r.n), "reliability": r.right / r.n}
        miss, slip = sum(r.miss for r in rows), sum(r.slip for r in rows)
        if miss + slip > 0:
            nu = min(0.95, max(0.05, miss / (miss + slip)))
        report.append({"round": n + 1, "largest_step": moved, "miss_share": nu, "converged": moved < TOLERANCE})
        if moved < TOLERANCE:
            break
    return out, nu, report


def _accept(starts, ends, labels, score, none_score) -> Iterator[int]:
    """Options of an item that stand: best first, while they outweigh "nothing" and meet none accepted before."""
    taken: list[tuple[int, int]] = []
    for k in sorted(range(len(score)), key=lambda k: (-score[k], starts[k], ends[k], labels[k])):
        if score[k] > none_score[k] and all(ends[k] <= s or starts[k] >= e for s, e in taken):
            taken.append((starts[k], ends[k]))
            yield k


def consensus(marks: DataFrame, tasks: DataFrame, *, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans: sentence_id, start, end, label, confidence; annotators; agreement per label and overall).

    A span stands if the weighted votes for it exceed those for "nothing here" of people without any mark in its place and
    those of every overlapping span that stands. Remarks without a span, repeated rows and marks outside done tasks have no
    part; spans that end up as OTHER_PII or an unknown label are dropped. Null ids are skipped. Empty tables give empty results.
    """
    spark = marks.sparkSession
    items = cut(build_items(marks, tasks))
    people, nu, _ = fit(items, rounds)
    ability = {k: v["ability"] for k, v in people.items()}

    def decide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            if b.num_rows:
                x = _Batch(b, ability)
                logb, q, _, p = x.settle(nu)
                weight = np.log(p / (1 - p)) + np.log(x.k[x.item] - 1 + SPREAD) - np.log1p(-nu)
                none_weight = np.log(p / (1 - p)) - np.log(nu) + np.log(1.0)
                cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                sid = cols["sentence_id"].to_pylist()
                S, E, L = (cols[n].to_pylist() for n in ("starts", "ends", "labels"))
                at = np.concatenate([[0], np.cumsum(np.bincount(x.item, minlength=x.n))])
                for i in range(x.n):
                    lo, hi = at[i], at[i + 1]
                    ch, w, nw, who = x.choice[lo:hi], weight[lo:hi], none_weight[lo:hi], x.code[lo:hi]
                    k = x.k[i] - 1
                    score = [float(w[ch == o + 1].sum()) for o in range(k)]
                    against = []
                    for o in range(k):
                        near = {who[v] for v in range(hi - lo) if ch[v] and S[i][ch[v] - 1] < E[i][o] and E[i][ch[v] - 1] > S[i][o]}
                        near |= {who[v] for v in range(hi - lo) if ch[v] == o + 1}
                        seen: set[int] = set()
                        total = 0.0
                        for v in range(hi - lo):
                            if who[v] not in near and who[v] not in seen:
                                seen.add(who[v])
                                total += float(nw[v])
                        against.append(total)
                    for o in _accept(S[i], E[i], L[i], score, against):
                        rows.append((sid[i], S[i][o], E[i][o], L[i][o], float(q[x.first[i] + 1 + o])))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["sentence_id", "start", "end", "label", "confidence"]).astype({"sentence_id": object, "start": "int32", "end": "int32", "label": object, "confidence": float}), preserve_index=False)

    spans = items.mapInArrow(decide, "sentence_id string, start int, end int, label string, confidence double").where(F.col("label").isin("EMAIL", "PHONE", "IBAN", "NATIONAL_ID", "PERSON", "ADDRESS"))
    annotators = spark.createDataFrame([(k, v["votes"], v["ability"], v["reliability"]) for k, v in sorted(people.items())], "annotator_id string, votes long, ability double, reliability double")
    return spans, annotators, agreement(items)


def agreement(items: DataFrame) -> DataFrame:
    """Chance-corrected agreement (Fleiss) of the votes on what an item holds: of each label against the rest, and over all.

    Votes per item and label are counted; observed agreement is over pairs of votes on an item, the expected one from the
    shares of the labels. Items with one vote have no pair. Kappa is 1 where the expected agreement is 1.
    """
    chosen = F.transform("choices", lambda k: F.when(k == 0, F.lit("NOTHING")).otherwise(F.get("labels", k - 1)))
    votes = items.select(F.monotonically_increasing_id().alias("item"), chosen.alias("v"), F.size("choices").alias("n")).where("n > 1")
    counts = votes.select("item", "n", F.explode("v").alias("label")).groupBy("item", "n", "label").agg(F.count("*").alias("k"))
    one = counts.groupBy("label").agg(F.sum("k").alias("votes"), F.sum(F.col("k") * (F.col("k") - 1) / (F.col("n") - 1)).alias("same"))
    total = votes.agg(F.sum("n").alias("all_votes"))
    p = F.col("votes") / F.col("all_votes")
    per = one.crossJoin(F.broadcast(total)).select("label", "votes", "all_votes", "same", p.alias("p"))  # a row per label, one row
    kappa = lambda po, pe: F.when(pe >= 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe))
    labels = per.select("label", "votes", kappa(F.col("same") / F.col("votes"), F.col("p")).alias("kappa"))
    whole = per.agg(F.sum("votes").alias("votes"), F.sum("same").alias("same"), F.sum(F.col("p") ** 2).alias("pe"))
    whole = whole.where("votes IS NOT NULL").select(F.lit("ALL").alias("label"), "votes", kappa(F.col("same") / F.col("votes"), F.col("pe")).alias("kappa"))
    return labels.unionByName(whole)


def _of(spark, d):
    return consensus(table(spark, d, "spans_b"), table(spark, d, "annotation_task"))


def p1_found(spark, d):
    return _of(spark, d)[0].select("sentence_id", "start", "end", "label")


def p1_annotators(spark, d):
    return _of(spark, d)[1]


def p1_agreement(spark, d):
    return _of(spark, d)[2]


def p1_convergence(spark, d):
    """The rounds of the fit: the largest step of any ability, the share of misses among wrong votes, and whether it has converged."""
    report = fit(cut(build_items(table(spark, d, "spans_b"), table(spark, d, "annotation_task"))))[2]
    return spark.createDataFrame([(r["round"], r["largest_step"], r["miss_share"], r["converged"]) for r in report], "round int, largest_step double, miss_share double, converged boolean")


QUERIES = {"p1_convergence": p1_convergence, "p1_found": p1_found, "p1_annotators": p1_annotators, "p1_agreement": p1_agreement}
ORACLE: dict[str, str] = {}
