"""Accounts: what a user's row shows, password hashes, signed tokens, and keyed updates of stored tables.

Password hashes are PBKDF2 (HMAC-SHA-256) with a random salt and their parameters in the text, as the box has no
bcrypt; as there, bytes beyond the 72nd of a password do not count. Tokens are JSON web tokens signed by HS256.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import etl

#: Bytes of a password that count; rounds of a hash.
MAX_BYTES, ROUNDS = 72, 10_000
#: Columns of a user that a response may hold.
SHOWN = ["id", "email", "name"]


def public_users(users: DataFrame) -> DataFrame:
    """Users without their password hash and times."""
    return users.select(*SHOWN)


def password_hash(password: str, salt: bytes | None = None, rounds: int = ROUNDS) -> str:
    if not password:
        raise ValueError("an empty password")
    salt = os.urandom(16) if salt is None else salt
    made = hashlib.pbkdf2_hmac("sha256", password.encode()[:MAX_BYTES], salt, rounds)
    return f"pbkdf2${rounds}${salt.hex()}${made.hex()}"


def password_fits(password: str | None, stored: str | None) -> bool:
    """Whether a password is the one that was hashed; false for anything empty or malformed."""
    try:
        _, rounds, salt, _ = (stored or "").split("$")
        return bool(password) and hmac.compare_digest(password_hash(password, bytes.fromhex(salt), int(rounds)), stored)
    except ValueError:
        return False


@F.pandas_udf(T.StringType())
def hashed_password(password: pd.Series) -> pd.Series:
    return password.map(lambda p: password_hash(p) if p else None)


@F.pandas_udf(T.BooleanType())
def verified(password: pd.Series, stored: pd.Series) -> pd.Series:
    return pd.Series([password_fits(p, s) for p, s in zip(password, stored, strict=True)])


def _part(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _signature(body: str, secret: str) -> str:
    return _part(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest())


def token_of(claims: dict, secret: str, expires: int) -> str:
    """A signed token; expires: seconds since 1970."""
    body = ".".join(_part(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, claims | {"exp": expires}))
    return f"{body}.{_signature(body, secret)}"


def claims_of(token: str | None, secret: str, now: int) -> dict | None:
    """The claims of a token with a right signature that has not expired; else null."""
    try:
        head, claims, signature = (token or "").split(".")
        read = lambda x: json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)))
        if read(head).get("alg") != "HS256" or not hmac.compare_digest(signature, _signature(f"{head}.{claims}", secret)):
            return None
        out = read(claims)
        return out if out.get("exp", now + 1) > now else None
    except (ValueError, AttributeError, TypeError):
        return None


def access_token(subject: Column, secret: str, expires: Column) -> Column:
    make = F.pandas_udf(lambda s, e: pd.Series([token_of({"sub": x}, secret, int(t)) for x, t in zip(s, e, strict=True)]), T.StringType())
    return make(subject, expires)


def token_subject(token: Column, secret: str, now: Column) -> Column:
    read = F.pandas_udf(lambda s, n: pd.Series([(claims_of(x, secret, int(t)) or {}).get("sub") for x, t in zip(s, n, strict=True)]), T.StringType())
    return read(token, now)


def driver_url(url: Column) -> Column:
    """A PostgreSQL address with the scheme that names its synchronous driver."""
    return F.regexp_replace(F.trim(url), "^postgres(?:ql)?://", "postgresql+psycopg://")


# Stored tables in versions: a write makes a new folder, which counts once it is complete.


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm, folder = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def save_version(df: DataFrame, path: str) -> None:
    done = _versions(df.sparkSession, path)
    df.write.mode("overwrite").parquet(f"{path}/v={(done or [0])[-1] + 1}")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]}")


def update_rows(spark: SparkSession, path: str, changes: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """Keyed UPDATE of a stored table: non-null values of changes replace those of the same key.

    Returns the keys whose row differs. A dry run writes nothing; else a new version is written whole, so a run
    that fails leaves the table as it was. All rows go in one write, not in commits of some hundred rows.
    """
    known = read_version(spark, path)
    new = etl.partial_update(known, changes, key)
    fields = [c for c in changes.columns if c != key and c in known.columns]
    differs = [~F.col(c).eqNullSafe(F.col(f"new_{i}")) for i, c in enumerate(fields)]
    named = changes.select(key, *[F.col(c).alias(f"new_{i}") for i, c in enumerate(fields)])
    test = F.lit(False)
    for i, x in enumerate(differs):
        test = test | (F.col(f"new_{i}").isNotNull() & x)
    changed = known.join(named, key).where(test).select(key)
    if not dry_run:
        save_version(new, path)
    return changed
