"""Encrypted fields, beside older ones that are plain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an encrypted field begins with.
MARK = "aes:"


def encrypted(text: Column, key: Column) -> Column:
    """A field as marked base64 of its AES-GCM form; null stays null."""
    return F.concat(F.lit(MARK), F.base64(F.aes_encrypt(text, key)))


def decrypted(field: Column, key: Column) -> Column:
    """What was encrypted with the key. Fields without the mark, from before encryption, fall through as they are, and so do those of another key."""
    plain = F.try_aes_decrypt(F.unbase64(F.substring(field, len(MARK) + 1, 1 << 30)), key).cast("string")
    return F.when(F.startswith(field, F.lit(MARK)), F.coalesce(plain, field)).otherwise(field)
