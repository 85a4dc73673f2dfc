"""Signed tokens, keyed hashes and request fingerprints as column expressions."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def b64url(data: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def unb64url(text: Column) -> Column:
    padded = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("="))
    return F.unbase64(padded)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC by its definition: two hashes with padded keys; no Python on the executors."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def sign_token(payload_json: Column, key: bytes) -> Column:
    body = b64url(F.encode(payload_json, "UTF-8"))
    return F.concat(body, F.lit("."), b64url(hmac_sha256(body, key)))


def verify_token(token: Column, key: bytes, now: Column, version: str) -> Column:
    """struct<payload, problem>: the payload's JSON, or why the token is refused; the signature comes first."""
    body, signature = F.substring_index(token, ".", 1), F.substring_index(token, ".", -1)
    payload = F.decode(unb64url(body), "UTF-8")
    expiry = F.get_json_object(payload, "$.exp").cast("long")
    problem = (
        F.when(~token.contains("."), "malformed token")
        .when(signature != b64url(hmac_sha256(body, key)), "bad signature")
        .when(~F.coalesce(F.get_json_object(payload, "$.v") == version, F.lit(False)), "issued under a different policy")
        .when(expiry.isNull() | (now >= expiry), "expired")
    )
    return F.struct(F.when(problem.isNull(), payload).alias("payload"), problem.alias("problem"))


def derived_key(secret: str, label: str) -> bytes:
    """A key of its own for each use of one secret."""
    return hmac.new(secret.encode(), label.encode(), hashlib.sha256).digest()


def client_key(address: Column, at: Column, salt: str) -> Column:
    """A pseudonym that changes every UTC day."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.date_format(at, "yyyy-MM-dd"), address), 256), 1, 24)


def client_address(forwarded: Column, remote: Column) -> Column:
    """The first forwarded address, or else the remote one."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(forwarded, ",", 1)), F.lit("")), remote)


@F.pandas_udf(StringType())
def fingerprint(payload_json: pd.Series) -> pd.Series:
    """SHA-256 of a JSON object with sorted keys, in Python's own spelling of JSON."""
    return payload_json.map(lambda p: None if p is None else hashlib.sha256(json.dumps(json.loads(p), sort_keys=True).encode()).hexdigest())
