"""Operator 8: secret scans with structural confirmation.

Base spans come from three patterns (assignments of a long value to a secret-like name, access key ids, hex runs).
Further spans are reported only once their structure is confirmed: base64 or hex candidates are decoded and parsed as

* `jwt`: a signed token, whose header is a JSON object that names an algorithm and whose payload is a JSON object;
* `key`: a DER private key (PKCS#1, PKCS#8, SEC1, DSA), whose nested lengths fill each other exactly, or an OpenSSH
  private key, whose length-prefixed strings end with it; in PEM armour (the span covers it) or bare; in armour also an
  encrypted key, whose header names a cipher and an initial vector and whose body has whole cipher blocks;
* `nested`: printable text that in turn holds an assignment, an access key id, a signed token or an armoured key.

Spans are in code points, the end exclusive, ordered by start, then kind as listed, then end. Null and empty texts have
none. Rows are independent: repeated rows, ties and extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, held, slices, small_batches, table

KINDS = ("assign", "access", "hex", "jwt", "key", "nested")
BASE_KINDS = KINDS[:3]
SPAN = "array<struct<kind:string,start:int,end:int>>"

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Every hex run of 16 or more and every base64 candidate lies in one of these runs.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
HEX = re.compile(r"[0-9a-f]{16,}")
ANY_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){16,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
ARMOUR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----")
ENCRYPTED = re.compile(r"^Proc-Type: *4, *ENCRYPTED *$", re.M)
DEK_INFO = re.compile(r"^DEK-Info: *([A-Z0-9-]+), *([0-9A-Fa-f]+) *$", re.M)
ARMOUR_HEADER = re.compile(r"^[A-Za-z-]+: .*$", re.M)
LEAST_BASE64 = 24


def decoded(text: str) -> bytes | None:
    """Strict base64 in either alphabet, padding optional."""
    body = text.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, value) pairs that fill `data` exactly in DER, or None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 128:
            wide = size & 127
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            size = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + size > len(data):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    outer = items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    parts = items(outer[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if tags[0] == 0x02 and len(parts[0][1]) == 1 and parts[0][1][0] <= 2:
        if set(tags) == {0x02} and len(tags) in (6, 9):  # DSA, PKCS#1
            return sum(len(v) for _, v in parts) >= 48
        if tags[1:3] == [0x30, 0x04]:  # PKCS#8
            inner = items(parts[1][1])
            return bool(inner) and inner[0][0] == 0x06 and len(parts[2][1]) >= 16
        if tags[1:2] == [0x04] and set(tags[2:]) <= {0xA0, 0xA1}:  # SEC1
            return len(parts[1][1]) >= 16 and all(items(v) for _, v in parts[2:])
    if tags == [0x30, 0x04]:  # PKCS#8, encrypted
        inner = items(parts[0][1])
        return bool(inner) and inner[0][0] == 0x06 and len(parts[1][1]) >= 16 and all(t in (0x06, 0x30, 0x05) for t, _ in inner)
    return False


def is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(string() is None for _ in range(3)):  # cipher, key derivation, its options
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 64 or any(string() is None for _ in range(keys)):
        return False
    return string() is not None and at == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def is_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        head, body = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str) and head["alg"].lower() != "none"


def is_encrypted_key(header: str, data: bytes | None) -> bool:
    """A cipher with its initial vector in the header, and whole cipher blocks."""
    cipher = DEK_INFO.search(header)
    if not data or not cipher or not ENCRYPTED.search(header):
        return False
    block = len(cipher[2]) // 2
    return block == (16 if cipher[1].startswith(("AES", "CAMELLIA")) else 8) and len(data) >= 32 and len(data) % block == 0


def armoured(text: str) -> list[tuple[int, int]]:
    """Spans from a BEGIN line to the END line of its label with no other line of the kind between, if there is a key."""
    found, begun = [], None
    for m in ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun:
            if begun[2] == m[2]:
                inside = text[begun.end() : m.start()]
                header = "\n".join(ARMOUR_HEADER.findall(inside))
                data = decoded("".join(ARMOUR_HEADER.sub("", inside).split()))
                if is_key(data) or is_encrypted_key(header, data):
                    found.append((begun.start(), m.end()))
            begun = None
    return found


def assigned(text: str) -> list[tuple[int, int]]:
    lower = text.lower()
    if not any(n in lower for n in NAMES):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12]


def access_ids(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in JWT.finditer(text) if is_token(m[0])] if "eyJ" in text else []


def is_nested(data: bytes | None) -> bool:
    if not data or len(data) < 12:
        return False
    try:
        text = data.decode("ascii")
    except UnicodeDecodeError:
        return False
    if not all(c.isprintable() or c in "\t\r\n" for c in text):
        return False
    return bool(assigned(text) or access_ids(text) or tokens(text) or armoured(text))


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every span, in order."""
    if not text:
        return []
    spans = [(a, 0, b) for a, b in assigned(text)] + [(a, 1, b) for a, b in access_ids(text)]
    jwts, keys = tokens(text), armoured(text) if "-----BEGIN" in text else []
    spans += [(a, 3, b) for a, b in jwts] + [(a, 4, b) for a, b in keys]
    covered = [*jwts, *keys]
    for m in RUN.finditer(text):
        run, at = m[0], m.start()
        spans += [(at + h.start(), 2, at + h.end()) for h in HEX.finditer(run)]
        if any(a <= at < b for a, b in covered):
            continue
        candidates = [(h.start(), h.end(), bytes.fromhex(h[0])) for h in ANY_HEX.finditer(run)]
        if len(run) >= LEAST_BASE64:
            candidates.append((0, len(run), decoded(run)))
        for a, b, data in candidates:
            if is_key(data):
                spans.append((at + a, 4, at + b))
            elif is_nested(data):
                spans.append((at + a, 5, at + b))
    return sorted(set(spans))


def find_secrets(text: Column) -> Column:
    """array<struct<kind,start,end>> of the spans of `text`."""

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPAN)
    def find(texts: pa.Array) -> pa.Array:
        held("secrets", bool)  # what another operator keeps in this worker goes
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for part in slices(texts) for t in part], kind)

    return find(text)


def redacted(text: str | None, spans: list[dict] | None) -> str | None:
    """`text` with each maximal stretch of overlapping spans replaced by the kind of its first, in angle brackets."""
    if not text or not spans:
        return text
    out, done, at = [], 0, 0
    while at < len(spans):
        start, end, kind = spans[at]["start"], spans[at]["end"], spans[at]["kind"]
        at += 1
        while at < len(spans) and spans[at]["start"] < end:
            end = max(end, spans[at]["end"])
            at += 1
        out += [text[done:start], f"<{kind}>"]
        done = end
    return "".join([*out, text[done:]])


def redact(text: Column, spans: Column) -> Column:
    @F.arrow_udf("string")
    def replace(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([redacted(t, s) for part, spans in zip(slices(texts), slices(found), strict=True) for t, s in zip(part, spans, strict=True)], pa.string())

    return replace(text, spans)


def without_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with the secrets of `text` replaced, and `n_chars`, where there is one, counted anew in changed rows."""
    small_batches(docs.sparkSession)
    spans = free_name(docs, "spans")
    found = docs.withColumn(spans, find_secrets(F.col("text")))
    new = free_name(found, "replaced")
    changed = F.size(spans) > 0
    found = found.withColumn(new, F.when(changed, redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    out = {"text": F.col(new).alias("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*[out.get(c, F.col(f"`{c}`")) for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", find_secrets(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return docs.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
