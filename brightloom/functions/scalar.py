"""Scalar expressions."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_path(file: Column, bucket: str | None = None, region: str = "us-east-1") -> Column:
    """The url in a bucket if one is set, else the local path; the default picture where there is no file. '' counts as none."""
    there = file.isNotNull() & (file != "")
    target = F.concat(F.lit(f"https://{bucket}.s3.{region}.amazonaws.com/profile_pics/"), file) if bucket else F.concat(F.lit("/media/profile_pics/"), file)
    return F.when(there, target).otherwise(F.lit("/static/profile_pics/default.jpg"))


def long_date(ts: Column) -> Column:
    """April 03, 2025."""
    return F.date_format(ts, "MMMM dd, yyyy")


def shortened(text: Column, limit: int = 50) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def truncated(x: Column, digits: int) -> Column:
    """Without the digits beyond, as cutting its text does: towards 0."""
    scaled = x * 10**digits
    return F.when(x < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / 10**digits


def html_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def joined_messages(errors: Column) -> Column:
    """The msg fields of an array of structs in one sentence list."""
    return F.array_join(F.transform(errors, lambda e: e["msg"]), ". ")


def debug_flag(text: Column) -> Column:
    """False for names of production modes, else the text's boolean, null where it is none."""
    low = F.lower(text)
    return F.when(low.isin("release", "prod", "production"), F.lit(False)).otherwise(low.try_cast("boolean"))


def reset_token() -> str:
    """A random url-safe token; made by the driver, as Spark's generators aren't cryptographic."""
    return secrets.token_urlsafe(32)


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def picture_name() -> Column:
    return F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(".jpg"))


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC by its definition, on Catalyst expressions alone."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def jwt(subject: Column, expires: Column, key: bytes) -> Column:
    """A signed token with the claims sub and exp."""
    head = base64url(F.lit(b'{"alg":"HS256","typ":"JWT"}'))
    body = base64url(F.to_json(F.struct(subject.cast("string").alias("sub"), expires.cast("long").alias("exp"))).cast("binary"))
    signed = F.concat(head, F.lit("."), body)
    return F.concat(signed, F.lit("."), base64url(hmac_sha256(signed, key)))


def jwt_subject(token: Column, key: bytes, now: Column) -> Column:
    """The subject of a token that is signed with the key and not expired, and has both claims; else null."""
    parts = F.split(token, r"\.")
    signed = F.concat(parts[0], F.lit("."), parts[1])
    body = F.translate(parts[1], "-_", "+/")
    body = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    claims = F.from_json(F.try_to_binary(body, F.lit("base64")).cast("string"), "sub string, exp long")
    ok = (F.size(parts) == 3) & (base64url(hmac_sha256(signed, key)) == parts[2]) & claims["sub"].isNotNull() & (claims["exp"] > now.cast("long"))
    return F.when(ok, claims["sub"])


def id_or_null(text: Column) -> Column:
    return text.try_cast("int")
