"""Artifact audit and column encryption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: marks text encrypted by this scheme.
ENCRYPTED_PREFIX = "enc:v1:"


def verify_checksums(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registered path and sha256 against actual bytes; match stays null without both hashes."""
    actual = files.select("path", F.sha2("content", 256).alias("actual_sha256"))
    joined = registry.join(actual, "path", "left")
    expected = F.lower("expected_sha256")
    return joined.select(
        "path",
        F.col("actual_sha256").isNotNull().alias("exists"),
        "expected_sha256",
        F.when(F.coalesce(expected, F.lit("")) != "", F.col("actual_sha256")).alias("actual_sha256"),
        F.when(F.coalesce(expected, F.lit("")) != "", expected == F.col("actual_sha256")).alias("sha256_match"),
    )


def encrypt_text(col: Column, key: bytes) -> Column:
    sealed = F.base64(F.aes_encrypt(col.cast("binary"), F.lit(key), F.lit("GCM")))
    url_safe = F.translate(F.regexp_replace(sealed, r"\s", ""), "+/", "-_")
    text = F.coalesce(col, F.lit(""))
    return F.when((text == "") | text.startswith(ENCRYPTED_PREFIX), text).otherwise(
        F.concat(F.lit(ENCRYPTED_PREFIX), url_safe)
    )


def decrypt_text(col: Column, key: bytes) -> Column:
    """Plain text passes; a wrong key or damaged text gives an empty string."""
    text = F.coalesce(col, F.lit(""))
    body = F.translate(F.substr(text, F.lit(len(ENCRYPTED_PREFIX) + 1)), "-_", "+/")
    opened = F.try_aes_decrypt(F.try_to_binary(body, F.lit("base64")), F.lit(key), F.lit("GCM"))
    return F.when(text.startswith(ENCRYPTED_PREFIX), F.coalesce(opened.cast("string"), F.lit(""))).otherwise(text)


def encrypt_columns(df: DataFrame, cols: Sequence[str], key: bytes) -> DataFrame:
    return df.withColumns({c: encrypt_text(F.col(c), key) for c in cols})


def decrypt_columns(df: DataFrame, cols: Sequence[str], key: bytes) -> DataFrame:
    return df.withColumns({c: decrypt_text(F.col(c), key) for c in cols})
