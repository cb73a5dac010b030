"""Stage 5: a signed, hash-chained log of redactions that holds digests and offsets, never text.

A chain is serial, so logs are sharded: one group per log_id. Rows that are appended
together are chained in the order of seq, after all that the log held before; position
counts the entries of a log in the order in which they were chained, and is what
verification goes by. Only the hashes are made in that order: signatures are of single
entries and are made in parallel. Keys reach the workers in a broadcast, never as a
literal of a plan.

Signatures are Ed25519 as in RFC 8032, written out here since no library for it is at
hand. Big integers take time that depends on their values: sign where no one else can
time the process.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.session import spread
from maskwright.schema import AUDIT_DDL

GENESIS = "0" * 64
COLUMNS = [c.split()[0] for c in re.sub("<[^>]*>", "", AUDIT_DDL.replace("array<struct<", "array<").replace(">>", ">")).split(", ")]

# The curve of RFC 8032.
_P = 2**255 - 19
_Q = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_BY = 4 * pow(5, -1, _P) % _P


def _x_of(y: int, sign: int) -> int | None:
    x2 = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(x2, (_P + 3) // 8, _P)
    if (x * x - x2) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - x2) % _P:
        return None
    return _P - x if x & 1 != sign else x


_B = (_x_of(_BY, 0), _BY, 1, _x_of(_BY, 0) * _BY % _P)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _multiples(p) -> list[list[tuple]]:
    """Multiples of a point for each hexadecimal place of a scalar."""
    out = []
    for _ in range(64):
        row = [(0, 1, 1, 0)]
        for _ in range(15):
            row.append(_add(row[-1], p))
        out.append(row)
        p = _add(row[-1], p)
    return out


@lru_cache(1)
def _of_base() -> list[list[tuple]]:
    return _multiples(_B)


@lru_cache(8)
def _of_key(pub: bytes) -> list[list[tuple]] | None:
    """Multiples of a public key, which many signatures are checked against; None if it is no point."""
    p = _unpack(pub)
    return None if p is None else _multiples(p)


def _mul(s: int, table: list[list[tuple]]):
    q = (0, 1, 1, 0)
    for row in table:
        if s & 15:
            q = _add(q, row[s & 15])
        s >>= 4
    return q


def _mul_base(s: int):
    return _mul(s, _of_base())


def _pack(p) -> bytes:
    z = pow(p[2], -1, _P)
    return (p[1] * z % _P | (p[0] * z % _P & 1) << 255).to_bytes(32, "little")


def _unpack(b: bytes):
    y = int.from_bytes(b, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    x = _x_of(y, sign)
    return None if x is None else (x, y, 1, x * y % _P)


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little")
    return a & (1 << 254) - 8 | 1 << 254, h[32:]


def _hash_int(b: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b).digest(), "little") % _Q


@lru_cache(16)
def public_key(seed: bytes) -> bytes:
    return _pack(_mul_base(_secret(seed)[0]))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    pub = public_key(seed)
    r = _hash_int(prefix + message)
    point = _pack(_mul_base(r))
    return point + ((r + _hash_int(point + pub + message) * a) % _Q).to_bytes(32, "little")


def verify(pub: bytes, message: bytes, signature: bytes) -> bool:
    if len(signature) != 64:
        return False
    a, r, s = _of_key(pub), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _Q:
        return False
    x, y = _mul_base(s), _add(r, _mul(_hash_int(signature[:32] + pub + message), a))
    return (x[0] * y[2] - y[0] * x[2]) % _P == 0 and (x[1] * y[2] - y[1] * x[2]) % _P == 0


_FIELDS = ("transaction_id", "timestamp", "input_hash", "output_hash", "entity_labels", "model_version_hash", "client_cert_fingerprint", "previous_entry_hash")


def keyed_digest(key: bytes, text: str) -> str:
    return hmac.new(key, text.encode("utf-8"), hashlib.sha256).hexdigest()


def canonical_bytes(entry: dict) -> bytes:
    """The entry without its signature as compact JSON with sorted keys."""
    body = {k: entry[k] for k in _FIELDS}
    body["entity_labels"] = [{"entity_type": x["entity_type"], "start": int(x["start"]), "end": int(x["end"])} for x in body["entity_labels"]]
    return json.dumps(body, sort_keys=True, separators=(",", ":")).encode("utf-8")


def append(redacted: DataFrame, *, hash_key: bytes, seed: bytes, heads: DataFrame | None = None, model: str = "rules", client: str = "") -> DataFrame:
    """Audit entries of redacted rows, chained per log_id from the given heads (log_id, count, head_hash; from the beginning
    where there is none).

    redacted: log_id, seq, transaction_id, timestamp, normalized, redacted, spans. Null texts count as empty, null spans as none.
    A log is one group, as its chain is serial: choose log ids so that no log gets more at once than a task can hold.
    """
    keys = redacted.sparkSession.sparkContext.broadcast((hash_key, seed))

    def chained(pdf: pd.DataFrame, position: int, last: str) -> pd.DataFrame:
        key = keys.value[0]
        out = []
        for r in pdf.sort_values(["seq", "transaction_id"]).itertuples():
            position += 1
            spans = r.spans if r.spans is not None else []
            e = {
                "transaction_id": r.transaction_id, "timestamp": float(r.timestamp), "input_hash": keyed_digest(key, r.normalized or ""), "output_hash": keyed_digest(key, r.redacted or ""),
                "entity_labels": [{"entity_type": s["entity_type"], "start": int(s["start"]), "end": int(s["end"])} for s in spans],
                "model_version_hash": model, "client_cert_fingerprint": client, "previous_entry_hash": last,
            }
            last = hashlib.sha256(canonical_bytes(e)).hexdigest()
            out.append({"log_id": r.log_id, "position": position, "seq": r.seq, **e, "entry_hash": last, "signature": ""})
        return pd.DataFrame(out, columns=COLUMNS)

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        return chained(pdf, 0, GENESIS)

    def go_on(pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        return chained(pdf, int(head["count"].iloc[0]), head["head_hash"].iloc[0]) if len(head) else chained(pdf, 0, GENESIS)

    def signed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = keys.value[1]
        for pdf in parts:
            yield pdf.assign(signature=[sign(own, canonical_bytes(e)).hex() for e in pdf.to_dict("records")])

    own = redacted.select("log_id", "seq", "transaction_id", "timestamp", "normalized", "redacted", "spans").groupBy("log_id")
    chain = own.applyInPandas(begin, AUDIT_DDL) if heads is None else own.cogroup(heads.select("log_id", "count", "head_hash").groupBy("log_id")).applyInPandas(go_on, AUDIT_DDL)
    return spread(chain).mapInPandas(signed, AUDIT_DDL)


def verify_links(log: DataFrame, order: str = "position") -> DataFrame:
    """(log_id, entries, intact): whether each entry names the hash of the one before it, and the first the beginning."""
    w = Window.partitionBy("log_id").orderBy(order)
    before = F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))
    return log.withColumn("ok", F.col("previous_entry_hash") == before).groupBy("log_id").agg(F.count("*").alias("entries"), F.bool_and("ok").alias("intact"))


def verify_entries(log: DataFrame, pub: bytes) -> DataFrame:
    """(log_id, seq, hash_ok, signature_ok): content against stored hash, and signature; row by row, in Arrow batches."""

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for e in pdf.to_dict("records"):
                body = canonical_bytes(e)
                rows.append((e["log_id"], e["seq"], hashlib.sha256(body).hexdigest() == e["entry_hash"], _signed(pub, body, e["signature"])))
            yield pd.DataFrame(rows, columns=["log_id", "seq", "hash_ok", "signature_ok"])

    return log.mapInPandas(check, "log_id string, seq long, hash_ok boolean, signature_ok boolean")


def _signed(pub: bytes, body: bytes, signature: str) -> bool:
    try:
        return verify(pub, body, bytes.fromhex(signature))
    except ValueError:
        return False


def verify_chain(log: DataFrame, pub: bytes) -> DataFrame:
    """(log_id, entries, valid): links, hashes and signatures of the whole log."""
    e = verify_entries(log, pub).groupBy("log_id").agg(F.bool_and(F.col("hash_ok") & F.col("signature_ok")).alias("ok"))
    return verify_links(log).join(e, "log_id").select("log_id", "entries", (F.col("intact") & F.col("ok")).alias("valid"))


def heads(log: DataFrame, order: str = "position") -> DataFrame:
    """(log_id, count, head_hash)."""
    return log.groupBy("log_id").agg(F.count("*").alias("count"), F.max_by("entry_hash", order).alias("head_hash"))


def moved_heads(before: DataFrame, appended: DataFrame) -> DataFrame:
    """Heads after some entries more: (log_id, count, head_hash) of all logs."""
    new = appended.groupBy("log_id").agg(F.max("position").alias("n"), F.max_by("entry_hash", "position").alias("h"))
    both = before.join(new, "log_id", "full_outer")
    return both.select("log_id", F.coalesce("n", "count").alias("count"), F.coalesce("h", "head_hash").alias("head_hash"))


def _statement(count: int, head: str) -> bytes:
    return json.dumps({"count": int(count), "head_hash": head}, sort_keys=True, separators=(",", ":")).encode("utf-8")


def checkpoint(log: DataFrame, seed: bytes) -> DataFrame:
    """(log_id, count, head_hash, signature): a signed statement of how far each log goes."""
    keys = log.sparkSession.sparkContext.broadcast(seed)

    def attest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(signature=[sign(keys.value, _statement(c, h)).hex() for c, h in zip(pdf["count"], pdf["head_hash"])])

    return heads(log).mapInPandas(attest, "log_id string, count long, head_hash string, signature string")


def verify_checkpoint(log: DataFrame, statements: DataFrame, pub: bytes) -> DataFrame:
    """(log_id, valid): the statement is signed and the log still holds that many entries with that head at that count."""
    n = F.row_number().over(Window.partitionBy("log_id").orderBy("position"))
    at = log.select("log_id", "entry_hash", n.alias("n"))
    s = statements.alias("s").join(at.alias("l"), (F.col("s.log_id") == F.col("l.log_id")) & (F.col("s.count") == F.col("l.n")), "left").select("s.*", F.col("l.entry_hash").alias("there"))

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ok = [_signed(pub, _statement(c, h), g) and (t if c else GENESIS) == h for c, h, g, t in zip(pdf["count"], pdf["head_hash"], pdf["signature"], pdf["there"])]
            yield pd.DataFrame({"log_id": pdf["log_id"], "valid": ok})

    return s.mapInPandas(check, "log_id string, valid boolean")
