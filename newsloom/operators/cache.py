"""User profiles and the encrypted cache table.

``EncryptedCache`` is a Parquet table of immutable versions: a write appends a row, the
newest row of a key counts, a delete appends a row without value, and ``compact`` rewrites
the table.  Keys are HMAC-SHA-256 digests; values are AES-GCM ciphertexts that the JVM's
own functions make and open.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.graph import work_dir, written
from newsloom.schema import PROFILE

PROFILE_NAMESPACE = "user_profile"
PROFILE_VERSION, MAX_ID = 1, 256
_LISTS = tuple("interests categories languages preferred_sources blocked_sources".split())
Names = tuple[str, ...]


class CacheError(Exception):
    """The cache can't do what was asked."""


class CacheKeyError(CacheError):
    """The encryption key is missing or unusable."""


class InvalidUserProfile(ValueError):
    """A profile breaks its rules."""


class FeedCache(Protocol):
    def get(self, space: str, name: str, otherwise: Any = None, /) -> Any: ...

    def set(self, space: str, name: str, content: Any, /, ttl: int | None = None) -> None: ...


class FeedCacheDeletable(FeedCache, Protocol):
    def delete(self, namespace: str, key: str) -> None: ...


@dataclass(frozen=True)
class UserProfile:
    user_id: str
    interests: Names = ()
    categories: Names = ()
    languages: Names = ()
    preferred_sources: Names = ()
    blocked_sources: Names = ()
    schema_version: int = PROFILE_VERSION

    def validate(self) -> UserProfile:
        if self.schema_version != PROFILE_VERSION:
            raise InvalidUserProfile(f"schema version {self.schema_version} is not known")
        if not isinstance(self.user_id, str) or not self.user_id.strip():
            raise InvalidUserProfile("user_id must not be blank")
        if len(self.user_id) > MAX_ID:
            raise InvalidUserProfile(f"user_id has more than {MAX_ID} characters")
        for name in _LISTS:
            values = getattr(self, name)
            if not isinstance(values, tuple) or any(not isinstance(v, str) or not v.strip() for v in values):
                raise InvalidUserProfile(f"{name} must be a tuple of non-blank texts")
        return self

    def to_dict(self) -> dict:
        self.validate()
        return {"user_id": self.user_id, **{n: list(getattr(self, n)) for n in _LISTS}, "schema_version": self.schema_version}

    @staticmethod
    def from_dict(data: Any) -> UserProfile:
        if not isinstance(data, dict):
            raise InvalidUserProfile("a profile is a mapping")
        lists = {n: data.get(n, []) for n in _LISTS}
        if any(not isinstance(v, list | tuple) for v in lists.values()):
            raise InvalidUserProfile("a profile's lists must be lists")
        return UserProfile(data.get("user_id", ""), *[tuple(lists[n]) for n in _LISTS], data.get("schema_version", PROFILE_VERSION)).validate()


def store_user_profile(cache: FeedCache, profile: UserProfile, ttl: int | None = None) -> None:
    cache.set(PROFILE_NAMESPACE, profile.user_id, profile.to_dict(), ttl=ttl)


def load_user_profile(cache: FeedCache, user_id: str) -> UserProfile | None:
    found = cache.get(PROFILE_NAMESPACE, user_id)
    try:
        profile = UserProfile.from_dict(found)
    except InvalidUserProfile:
        return None
    return profile if profile.user_id == user_id else None


def profiles_frame(spark: SparkSession, profiles: list[UserProfile]) -> DataFrame:
    return spark.createDataFrame([tuple(p.to_dict()[f] for f in PROFILE.names) for p in profiles], PROFILE)


_TABLE = "namespace string, cache_key string, value binary, expires_at double, created_at double, version long"


class EncryptedCache:
    def __init__(self, spark: SparkSession, path: str, key: bytes | str | None):
        raw = key.encode() if isinstance(key, str) else key
        if not raw:
            raise CacheKeyError("an encryption key is required")
        try:
            raw = raw if len(raw) in (16, 24, 32) else base64.urlsafe_b64decode(raw)
        except ValueError:
            raw = b""
        if len(raw) not in (16, 24, 32):
            raise CacheKeyError("the key must have 16, 24 or 32 bytes, plain or in base64")
        self.spark, self.path, self._key = spark, path, raw
        self._aes = hashlib.sha256(b"value" + raw).hexdigest()[:32]

    def opaque(self, namespace: str, key: str) -> str:
        return hmac.new(self._key, f"{namespace}\x00{key}".encode(), hashlib.sha256).hexdigest()

    def _table(self) -> DataFrame:
        try:
            return self.spark.read.schema(_TABLE).parquet(self.path)
        except Exception as e:  # the table is made by the first write
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], _TABLE)
            raise

    def _newest(self, namespace: str | None = None, digest: str | None = None) -> DataFrame:
        """The newest row of each key; of one namespace or key only where given, so that
        the filter reaches the scan and nothing else is aggregated."""
        t = self._table()
        if namespace is not None:
            t = t.where(F.col("namespace") == namespace)
        if digest is not None:
            t = t.where(F.col("cache_key") == digest)
        last = t.groupBy("namespace", "cache_key").agg(F.max_by(F.struct("value", "expires_at", "created_at"), "version").alias("r"))
        return last.select("namespace", "cache_key", "r.*").where("value IS NOT NULL")

    def _append(self, namespace: str, digest: str, text: str | None, expires: float | None) -> None:
        row = self.spark.createDataFrame(
            [(namespace, digest, text, expires, time.time(), time.time_ns())],
            "namespace string, cache_key string, text string, expires_at double, created_at double, version long"
        )
        value = F.aes_encrypt(F.col("text"), F.lit(self._aes))
        row.select("namespace", "cache_key", value.alias("value"), "expires_at", "created_at", "version").write.mode("append").parquet(self.path)

    def set(self, namespace: str, key: str, content: Any, ttl: float | None = None) -> None:
        if not (namespace and key):
            raise ValueError("namespace and key must not be empty")
        self._append(namespace, self.opaque(namespace, key), json.dumps(content), None if ttl is None else time.time() + ttl)

    def get(self, namespace: str, key: str, default=None):
        digest = self.opaque(namespace, key)
        mine = self._newest(namespace, digest)
        row = mine.select("expires_at", F.try_aes_decrypt("value", F.lit(self._aes)).cast("string").alias("text")).first()
        if row is None:
            return default
        try:
            if row["expires_at"] is None or row["expires_at"] > time.time():
                return json.loads(row["text"])
        except (TypeError, ValueError):
            pass
        self._append(namespace, digest, None, None)  # expired or unreadable
        return default

    def exists(self, namespace: str, key: str) -> bool:
        missing = object()
        return self.get(namespace, key, missing) is not missing

    def delete(self, namespace: str, key: str) -> bool:
        had = self.exists(namespace, key)
        self._append(namespace, self.opaque(namespace, key), None, None)
        return had

    def compact(self, files: int = 1) -> None:
        """Rewrite the table with the newest rows alone, in few files, sorted so that row
        groups can be skipped.  No other writer may be at work."""
        newest = self._newest().withColumn("version", F.lit(time.time_ns())).select(*(f.split()[0] for f in _TABLE.split(", ")))
        aside = written(
            newest.repartitionByRange(files, "namespace", "cache_key").sortWithinPartitions("namespace", "cache_key"),
            work_dir(self.spark, "cache")
        )
        aside.repartitionByRange(files, "namespace", "cache_key").sortWithinPartitions("namespace", "cache_key").write.mode("overwrite").parquet(self.path)

    def _drop(self, condition, namespace: str | None = None) -> int:
        rows = self._newest(namespace).where(condition).select("namespace", "cache_key")
        n = rows.count()
        if n:
            rows.select(
                "namespace", "cache_key", F.lit(None).cast("binary").alias("value"),
                F.lit(None).cast("double").alias("expires_at"), F.lit(time.time()).alias("created_at"),
                F.lit(time.time_ns()).alias("version")
            ).write.mode("append").parquet(self.path)
        return n

    def clear_namespace(self, namespace: str) -> int:
        return self._drop(F.lit(True), namespace)

    def purge_expired(self) -> int:
        return self._drop(F.col("expires_at") <= time.time())

    def stats(self) -> dict[str, Any]:
        row = cache_stats(self._newest(), F.lit(time.time())).first()
        return {"entries": row["entries"], "expired": row["expired"], "namespaces": list(row["namespaces"])}


def cache_stats(rows: DataFrame, now) -> DataFrame:
    """entries, expired, and the sorted namespaces of live cache rows."""
    return rows.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum((F.col("expires_at") <= now).cast("long")), F.lit(0)).alias("expired"),
        F.array_sort(F.collect_set("namespace")).alias("namespaces")
    )
