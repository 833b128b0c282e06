"""Encrypted columns for the dictionary and the allowlist."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.runtime import path_exists
from recallspark.schemas import ALLOWLIST, DICTIONARY, empty
from recallspark.sources.config_files import load_allowlist, load_dictionary

# Key derivation.
SALT_BYTES = 16
KDF_ROUNDS = 600_000

PROTECTED_SUFFIX = ".enc"


def derive_key(password: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, KDF_ROUNDS)


def _secret(spark: SparkSession, key: bytes) -> Column:
    # A scalar subquery keeps the key out of the printed plan.
    return spark.createDataFrame([(bytearray(key),)], "key binary").scalar()


def encrypt_columns(df: DataFrame, columns: list[str], password: str) -> DataFrame:
    """Replace text columns by ciphertexts; add the `salt` of the key."""
    salt = os.urandom(SALT_BYTES)
    key = _secret(df.sparkSession, derive_key(password, salt))
    return df.withColumns(
        {c: F.aes_encrypt(F.col(c).cast("binary"), key, F.lit("GCM")) for c in columns}
    ).withColumn("salt", F.lit(bytearray(salt)))


def decrypt_columns(df: DataFrame, columns: list[str], password: str) -> DataFrame:
    """Undo `encrypt_columns`; a wrong password fails the job.

    Every write has its own salt: one key is derived for each and joined to its rows.
    """
    salts = [bytes(row["salt"]) for row in df.select("salt").distinct().collect()]
    keys = [(bytearray(salt), bytearray(derive_key(password, salt))) for salt in salts]
    # Rows of a table, unlike literals, stay out of the printed plan.
    keyed = F.broadcast(df.sparkSession.createDataFrame(keys, "salt binary, _key binary"))
    return (
        df.join(keyed, "salt")
        .withColumns({c: F.aes_decrypt(F.col(c), F.col("_key"), F.lit("GCM")).cast("string") for c in columns})
        .drop("salt", "_key")
    )


def write_protected(df: DataFrame, columns: list[str], password: str, path: str) -> str:
    target = path + PROTECTED_SUFFIX
    encrypt_columns(df, columns, password).write.parquet(target)
    return target


def load_configuration(
    spark: SparkSession, dictionary_path: str, allowlist_path: str, password: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Dictionary and allowlist: each from its protected copy if there is one and a
    password is given, else from the plain file, else empty."""

    def protected(path: str) -> bool:
        return password is not None and path_exists(spark, path + PROTECTED_SUFFIX)

    if protected(dictionary_path):
        stored = spark.read.parquet(dictionary_path + PROTECTED_SUFFIX)
        dictionary = decrypt_columns(stored, ["real_value", "placeholder"], password)
        dictionary = dictionary.select(*DICTIONARY.names)
    else:
        dictionary = load_dictionary(spark, dictionary_path)
    if protected(allowlist_path):
        stored = spark.read.parquet(allowlist_path + PROTECTED_SUFFIX)
        allowlist = decrypt_columns(stored, ["word"], password).select(*ALLOWLIST.names)
    else:
        allowlist = load_allowlist(spark, allowlist_path)
    return dictionary, allowlist
