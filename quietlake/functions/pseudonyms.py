"""Keyed pseudonymous ids as a Spark expression, and their key file."""

from __future__ import annotations

import hashlib
import os
import secrets
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LENGTH = 16


def _pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and the outer block of HMAC-SHA256."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Lowercase hex of HMAC-SHA256 of a value's text, from two nested sha2 calls."""
    inner, outer = (F.unhex(F.lit(pad.hex())) for pad in _pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("string").cast("binary")), 256))), 256)


def pseudo_id(value: Column, key: bytes) -> Column:
    """The first 16 digits of the keyed hash; 12345 and '12345' are the same id."""
    return F.substring(hmac_sha256(value, key), 1, LENGTH)


def duckdb_pseudo_id(value: str, key: bytes) -> str:
    """The same in DuckDB SQL."""
    inner, outer = (pad.hex() for pad in _pads(key))
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}::VARCHAR)))), 1, {LENGTH})"


def register(spark: SparkSession, key: bytes, name: str = "pseudo_id") -> None:
    """A SQL function of the same meaning, for a session that may see the key: its definition holds it."""
    if not name.isidentifier():
        raise ValueError("a function's name is letters, digits and underscores")
    inner, outer = (pad.hex() for pad in _pads(key))
    body = f"substr(sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), cast(v AS BINARY)), 256))), 256), 1, {LENGTH})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS STRING RETURN {body}")


def create_key(path: str | Path) -> Path:
    """A new key of 64 hex digits that only its owner can read; an existing file stays."""
    file = Path(path).expanduser()
    if not file.exists():
        file.parent.mkdir(parents=True, exist_ok=True)
        with os.fdopen(os.open(file, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w") as out:
            out.write(secrets.token_hex(32) + "\n")
    return file


def load_key(path: str | Path) -> bytes:
    file = Path(path).expanduser()
    if not file.exists():
        raise FileNotFoundError(f"no key file {file}")
    if file.stat().st_mode & 0o077:
        raise PermissionError(f"{file} is open to others; its mode must be 0600")
    return file.read_text(encoding="utf-8").strip().encode()
