"""Catalogs that are loaded once: callers share a load, failures are counted and tried again."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import catalog_tables
from .readers import catalog


def checked(document: DataFrame) -> int:
    """The number of entries of a catalog; another version is an error."""
    return catalog_tables(document)["entries"].count()


@dataclass(frozen=True)
class LoadCounts:
    attempts: int = 0
    failures: int = 0


class CatalogStore:
    """The catalog of a path, read at the first call and held in Spark's storage until it is invalidated.

    Callers that come while it is being read wait for that read. A failed read is
    raised to all that waited, counted, and not remembered: the next call reads
    again. The catalog is one document, so a read is one row.
    """

    def __init__(self, spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame] = catalog, check: Callable[[DataFrame], object] = checked):
        self._spark, self._path, self._read, self._check = spark, path, read, check
        self._lock, self._loading, self._held = Lock(), None, None
        self._counts = LoadCounts()

    @property
    def counts(self) -> LoadCounts:
        return self._counts

    def get(self) -> DataFrame:
        with self._lock:
            if self._held is not None:
                return self._held
            mine = self._loading is None
            if mine:
                self._loading = Future()
                self._counts = LoadCounts(self._counts.attempts + 1, self._counts.failures)
            waiting = self._loading
        if not mine:
            return waiting.result()
        df = None
        try:
            df = self._read(self._spark, self._path).persist()
            self._check(df)
        except BaseException as e:
            if df is not None:
                df.unpersist()
            with self._lock:
                self._loading, self._counts = None, LoadCounts(self._counts.attempts, self._counts.failures + 1)
            waiting.set_exception(e)
            raise
        with self._lock:
            self._held, self._loading = df, None
        waiting.set_result(df)
        return df

    def invalidate(self) -> None:
        """Forget what is held; the next call reads anew."""
        with self._lock:
            held, self._held = self._held, None
        if held is not None:
            held.unpersist()
