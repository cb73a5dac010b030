"""Stages 1 to 4 end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.functions.scan import scanned
from maskwright.operators.detect import detect
from maskwright.operators.fuse import fuse, mask
from maskwright.operators.normalize import STEPS, normalize
from maskwright.schema import SCORED_TYPES

RESULTS = ("normalized", "report", "spans", "redacted")

#: Named subsets of the normalisation steps, for comparing what each contributes.
ABLATIONS = {
    "full": STEPS,
    "no_stage1": (),
    **{f"without_{s}": tuple(x for x in STEPS if x != s) for s in STEPS},
    **{f"only_{s}": (s,) for s in STEPS},
    "nfkc_and_digits": ("nfkc", "digits"),
}
#: The rules of the first release, which had four of the steps.
ARCHIVED = "archived_rules"


def redact(
    df: DataFrame, text: str = "text", steps=STEPS, ner: Callable[[Column], Column] | None = None, mask_format: tuple[str, str] = ("[", "]"), columns: bool = False
) -> DataFrame:
    """df with normalized, report, spans and redacted. Offsets are code points of the normalised text.

    ner: a column function that gives neural spans of the normalised text (none by default). With it, or if columns is set, all of
    it is column expressions; else one Arrow function does the same faster. Either way it is one narrow projection, so it runs
    unchanged on a stream. Null text gives nulls. Columns of df by the names of the results are replaced.
    """
    if ner is None and not columns:
        if steps is None:
            raise ValueError("steps must be given; the archived rules are run by run_system")
        if unknown := set(steps) - set(STEPS):
            raise ValueError(f"unknown normalisation steps: {sorted(unknown)}")
        return _scan(df, text, steps, mask_format)
    df = normalize(df, text, steps)
    c = F.col("normalized")
    df = df.withColumn("__rules", detect(c))
    df = df.withColumn("__neural", ner(c) if ner else tx.no_spans())
    df = df.withColumn("spans", fuse(c, F.col("__neural"), F.col("__rules")))
    return df.withColumn("redacted", mask(c, F.col("spans"), *mask_format)).drop("__rules", "__neural")


def _scan(df: DataFrame, text: str, steps, mask_format: tuple[str, str]) -> DataFrame:
    keep = [c for c in df.columns if c not in RESULTS and c != "__scan"]
    df = df.withColumn("__scan", scanned(F.col(text).cast("string"), steps, mask_format))
    return df.select(*keep, *[F.col(f"__scan.{c}").alias(c) for c in RESULTS])


def run_system(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """One ablation, or the archived rules: redacted; pred holds the spans of the four scored types, picked after fusion."""
    out = _scan(df, text, None, ("[", "]")) if name == ARCHIVED else redact(df, text, ABLATIONS[name])
    return out.withColumn("pred", F.filter("spans", lambda s: s["entity_type"].isin(*SCORED_TYPES))).withColumn("system", F.lit(name))


def run_systems(df: DataFrame, names, text: str = "text") -> DataFrame:
    out = None
    for n in names:
        one = run_system(df, n, text)
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Pipeline:
    """The stages with their options, for applying them to several tables: steps of normalisation, a column function that gives
    neural spans, mask format, and for the audit log the keys, the model's hash and the client's fingerprint."""

    steps: tuple[str, ...] = STEPS
    ner: Callable[[Column], Column] | None = None
    mask_format: tuple[str, str] = ("[", "]")
    hash_key: bytes | None = field(default=None, repr=False)
    seed: bytes | None = field(default=None, repr=False)
    model_hash: str = "rules"
    client: str = ""

    @classmethod
    def from_checkpoint(cls, path: str, load: Callable[[str], Callable[[Column], Column]], **options) -> Pipeline:
        """With a model kept at a path: load(path) gives the column function; the model's hash is that of its files."""
        from maskwright.sources.io import source_hash

        return cls(ner=load(path), model_hash=source_hash(path, ""), **options)

    def redact(self, df: DataFrame, text: str = "text") -> DataFrame:
        return redact(df, text, self.steps, self.ner, self.mask_format)

    def audit(self, redacted: DataFrame, heads: DataFrame | None = None) -> DataFrame:
        """Audit entries of redacted rows (log_id, seq, transaction_id, timestamp beside what redact gives)."""
        from maskwright.operators import audit

        if self.hash_key is None or self.seed is None:
            raise ValueError("an audit log needs a hash key and a seed")
        return audit.append(redacted, hash_key=self.hash_key, seed=self.seed, heads=heads, model=self.model_hash, client=self.client)
