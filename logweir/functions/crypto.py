"""Fields encrypted under a key of their subject; without the key they read as redacted. Export and forgetting of a subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import subject_hash

REDACTED = "[REDACTED]"


def encrypted(rows: DataFrame, fields: list[str], subject: str, keys: DataFrame) -> DataFrame:
    """Fields as base64 of AES-GCM under the key of the row's subject. keys: subject_hash, key. A subject without a key is an error."""
    found = rows.withColumn("_h", subject_hash(F.col(subject))).join(keys.select(F.col("subject_hash").alias("_h"), F.col("key").alias("_k")), "_h", "left")
    key = F.coalesce("_k", F.raise_error(F.lit("no key for a subject")).cast("binary"))
    return found.withColumns({f: F.base64(F.aes_encrypt(F.col(f), key, F.lit("GCM"))) for f in fields}).select(*rows.columns)


def decrypted(rows: DataFrame, fields: list[str], subject: str, keys: DataFrame) -> DataFrame:
    """Fields in clear text, or [REDACTED] where the subject has no key any more. A wrong key is an error."""
    found = rows.withColumn("_h", subject_hash(F.col(subject))).join(keys.select(F.col("subject_hash").alias("_h"), F.col("key").alias("_k")), "_h", "left")

    def clear(f: str) -> Column:
        return F.when(F.col(f).isNull(), None).when(F.col("_k").isNull(), REDACTED).otherwise(F.aes_decrypt(F.unbase64(F.col(f)), F.col("_k"), F.lit("GCM")).cast("string"))

    return found.withColumns({f: clear(f) for f in fields}).select(*rows.columns)


def forgotten(keys: DataFrame, subjects: DataFrame) -> DataFrame:
    """The keys that are left when subjects (subject) are forgotten."""
    return keys.join(subjects.select(subject_hash(F.col("subject")).alias("subject_hash")), "subject_hash", "left_anti")


def export(subject: str, sections: dict[str, DataFrame]) -> DataFrame:
    """(section, row) as JSON for every row that the sections, filtered to the subject, hold; a section that fails fails the export."""
    parts = [rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns)).alias("row")) for name, rows in sections.items() if rows is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
