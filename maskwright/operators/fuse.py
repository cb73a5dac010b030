"""Stage 4: overlap resolution, growth of person spans, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import lexicon as lx
from maskwright.functions import text as tx
from maskwright.operators.detect import by_start
from maskwright.schema import SPANS_DDL


def overlaps(a: Column, b: Column) -> Column:
    """Half-open overlap: spans that only touch do not overlap."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve_overlaps(spans: Column) -> Column:
    """A left fold over spans by start, longer first, against the last one kept: of one type the better score, then the longer
    stays; of two types a rule's span beats a model's, the earlier of two rules' stays, the better score of two models' stays."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), i.alias("c"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])

    def step(acc: Column, c: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(c)).otherwise(tx.let(F.element_at(acc, -1), lambda k: against(acc, k, c)))

    def against(acc: Column, k: Column, c: Column) -> Column:
        size = lambda s: s["end"] - s["start"]
        same = c["entity_type"] == k["entity_type"]
        better = (c["score"] > k["score"]) | ((c["score"] == k["score"]) & (size(c) > size(k)))
        rule = lambda s: s["origin"] == "regex"
        wins = F.when(same, better).when(rule(c) & ~rule(k), True).when(rule(k), False).otherwise(c["score"] > k["score"])
        swapped = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(c))
        return F.when(~overlaps(c, k), F.concat(acc, F.array(c))).when(wins, swapped).otherwise(acc)

    return F.when(F.size(spans) > 1, F.aggregate(ordered, F.array().cast(SPANS_DDL), step)).otherwise(spans)


def _grow(text: Column, s: Column) -> Column:
    """A person span grown over adjacent tokens that are parts of names."""
    part = lambda t: F.trim(t).isin(*lx.NAME_PARTS)
    head = F.substring(text, F.lit(1), s["start"])
    tail = F.substring(text, s["end"] + 1, F.length(text))

    def left(acc: Column, _: Column) -> Column:
        # the last space before the final character ends the token before the span
        cut = F.length(acc["t"]) - F.length(F.regexp_extract(acc["t"], "(?s)[^ ]*.$", 0))
        ok = acc["go"] & (F.length(acc["t"]) > 0) & part(F.substring(acc["t"], cut + 1, F.length(acc["t"])))
        return F.struct(F.when(ok, F.substring(acc["t"], F.lit(1), cut)).otherwise(acc["t"]).alias("t"), ok.alias("go"))

    def right(acc: Column, _: Column) -> Column:
        token = F.regexp_extract(acc["t"], "^(?s).[^ ]*", 0)
        ok = acc["go"] & (token != "") & part(token)
        return F.struct(F.when(ok, F.substring(acc["t"], F.length(token) + 1, F.length(acc["t"]))).otherwise(acc["t"]).alias("t"), ok.alias("go"))

    begin = lambda t: F.struct(t.alias("t"), F.lit(True).alias("go"))
    start = F.length(F.aggregate(F.split(head, " "), begin(head), left, lambda a: a["t"]))
    end = F.length(text) - F.length(F.aggregate(F.split(tail, " "), begin(tail), right, lambda a: a["t"]))
    return tx.let(
        F.struct(start.cast("int").alias("a"), end.cast("int").alias("b")),
        lambda x: F.struct(
            x["a"].alias("start"), x["b"].alias("end"), s["entity_type"].alias("entity_type"), s["origin"].alias("origin"), s["score"].alias("score"),
            ((x["a"] != s["start"]) | (x["b"] != s["end"])).alias("expanded"),
        ),
    )


def expand_persons(text: Column, spans: Column) -> Column:
    """Person spans over kunya, nisbah and laqab next to them; others as they are. Grown spans may meet and are not resolved again."""
    grown = F.transform(spans, lambda s: F.when(s["entity_type"] == "PERSON", _grow(text, s)).otherwise(s))
    return F.when(F.exists(spans, lambda s: s["entity_type"] == "PERSON"), grown).otherwise(spans)


def fuse(text: Column, neural: Column, rules: Column, expand: bool = True) -> Column:
    """Union, resolution, growth, by start."""
    out = tx.let(F.concat(neural, rules), resolve_overlaps)
    return tx.let(tx.let(out, lambda s: expand_persons(text, s)), by_start) if expand else out


def mask(text: Column, spans: Column, before: str = "[", after: str = "]", constant: str | None = None) -> Column:
    """Text with each span replaced by its bracketed type, or by a constant. The fold runs from the right, so that offsets hold
    and overlapping (grown) spans give what replacing one after the other gives."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-i).alias("b"), s.alias("s")))
    back = F.reverse(F.transform(F.array_sort(keyed), lambda k: k["s"]))
    name = lambda s: F.lit(constant) if constant is not None else F.concat(F.lit(before), s["entity_type"], F.lit(after))
    step = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), name(s), F.substring(t, s["end"] + 1, F.length(t)))
    return F.when(F.size(spans) > 0, F.aggregate(back, text, step)).otherwise(text)


def drop_contained(spans: Column) -> Column:
    """Spans that do not lie strictly inside a longer one; equal spans once."""
    s = F.array_distinct(spans)
    inside = lambda x, o: (o["start"] <= x["start"]) & (o["end"] >= x["end"]) & ((o["end"] - o["start"]) > (x["end"] - x["start"]))
    return F.filter(s, lambda x: ~F.exists(s, lambda o: inside(x, o)))


def decode_bio(tokens: Column, threshold: float = 0.5) -> Column:
    """Spans from tokens (start, end, label, score) labelled B-, I- or O: a token below the threshold counts as O, an I- of another
    type begins a span, a span's score is its tokens' least."""
    begin = F.array().cast(SPANS_DDL)
    start = F.struct(begin.alias("out"), F.lit(False).alias("open"))

    def step(acc: Column, t: Column) -> Column:
        label = F.when(t["score"] < threshold, "O").otherwise(t["label"])
        kind, etype = F.substring(label, 1, 1), F.substring(label, 3, 100)
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        joins = (kind == "I") & acc["open"] & (last["entity_type"] == etype)
        one = lambda s, sc: F.struct(s.cast("int").alias("start"), t["end"].cast("int").alias("end"), etype.alias("entity_type"), F.lit("neural").alias("origin"), sc.cast("double").alias("score"), F.lit(False).alias("expanded"))
        grown = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(one(last["start"], F.least(last["score"], t["score"]))))
        fresh = F.concat(acc["out"], F.array(one(t["start"], t["score"])))
        out = F.when(label == "O", acc["out"]).when(joins, grown).otherwise(fresh)
        return F.struct(out.alias("out"), (label != "O").alias("open"))

    return F.aggregate(tokens, start, step, lambda a: a["out"])
