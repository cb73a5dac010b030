"""Stage 1: adversarial Unicode to plain text, with a report of what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import charmap as cm
from maskwright.functions import text as tx

STEPS = ("nfkc", "bidi", "invisible", "digits", "tatweel", "confusables")


def normalize(df: DataFrame, text: str = "text", steps=STEPS, out: str = "normalized", report: str | None = "report") -> DataFrame:
    """df with the normalised text and, unless report is None, a struct of counters.

    Steps run in the order of STEPS whatever order they are given in; an unknown one raises ValueError. Null text gives null
    text and a null report; empty text is unchanged. Each step is a projection, so nothing is shuffled.
    """
    steps = set(steps)
    if unknown := steps - set(STEPS):
        raise ValueError(f"unknown normalisation steps: {sorted(unknown)}")
    keep, cur = df.columns, F.col(text)
    names = {s: f"__{out}_{s}" for s in STEPS}
    prev = f"__{out}_0"
    df = df.withColumn(prev, cur)
    parts = []
    zero = F.lit(0)
    for s in STEPS:
        c, n = F.col(prev), zero
        if s == "nfkc":
            new = tx.nfkc(c) if s in steps else None
            parts.append(((F.col(names[s]) != c) if s in steps else F.lit(False)).alias("nfkc_changed"))
        elif s == "bidi":
            new, n = (tx.strip_bidi(c), F.regexp_count(c, F.lit(f"[{cm.BIDI_CLASS}]"))) if s in steps else (None, zero)
            parts.append(n.alias("bidi_controls_stripped"))
        elif s == "invisible":
            new, n = (tx.strip_invisible(c), F.regexp_count(c, F.lit(cm.invisible_java()))) if s in steps else (None, zero)
            parts.append(n.alias("invisible_stripped"))
        elif s == "digits":
            new, n = (tx.fold_digits(c), F.regexp_count(c, F.lit(f"[{cm.ARABIC_INDIC}{cm.EXT_ARABIC_INDIC}]"))) if s in steps else (None, zero)
            parts.append(n.alias("digits_folded"))
        elif s == "tatweel":
            new, n = (tx.cap_tatweel(c), F.regexp_count(c, F.lit(cm.TATWEEL + "{2,}"))) if s in steps else (None, zero)
            parts.append(n.alias("tatweel_runs_capped"))
        else:
            new = tx.fold_confusables(c) if s in steps else None
            parts.append((tx.changed_chars(c, F.col(names[s])) if s in steps else zero).alias("confusables_folded"))
        if new is not None:
            df = df.withColumn(names[s], new)
            prev = names[s]
    cols = [F.col(k) for k in keep if k not in (out, report)] + [F.col(prev).alias(out)]
    if report:
        cols.append(F.when(F.col(text).isNotNull(), F.struct(*parts)).alias(report))
    return df.select(*cols)


def any_adversarial_signal(report: str = "report"):
    r = F.col(report)
    counters = ("bidi_controls_stripped", "invisible_stripped", "digits_folded", "tatweel_runs_capped", "confusables_folded")
    out = r["nfkc_changed"]
    for k in counters:
        out = out | (r[k] > 0)
    return out
