"""Helpers that the operators of this subpackage have in common.

Intermediate results that are read more than once are written as Parquet below
the folder named by ``spark.checkpoint.dir`` (shared by driver and executors), so
a lost executor never takes the only copy of anything with it.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..staging import bounded_broadcast, new_path, release, stage

__all__ = ["WORD", "BoundedMemo", "ascii_lower", "bounded_broadcast", "byte_chunks", "free_name", "new_path", "release", "setting", "stage"]

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
#: ``bytes.split()`` splits at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that every engine agrees on the result."""
    return F.translate(text, _UPPER, _UPPER.lower())


def byte_chunks(batches, limit: int, column: str | None = None, field: str | None = None):
    """Cut record batches so that a column (the first binary one by default) holds about ``limit`` bytes.

    ``field``: of a struct column, the field that counts.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if column is None:
            at = next((i for i, f in enumerate(batch.schema) if pa.types.is_binary(f.type) or pa.types.is_large_binary(f.type)), None)
            counted = None if at is None else batch.column(at)
        else:
            counted = batch.column(column) if field is None else batch.column(column).field(field)
        if counted is None:
            yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(counted), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def setting(name: str, default: str) -> str:
    """A setting of the running session, as the tokenizers' places are."""
    session = SparkSession.getActiveSession()
    return session.conf.get(name, default) if session is not None else default


def free_name(taken: list[str], base: str) -> str:
    """``base``, with underscores before it until no column of ``taken`` has that name in any case."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base = f"_{base}"
    return base


class BoundedMemo(dict):
    """What ``make`` returned for a key, for about ``limit`` bytes of keys and values; long keys are made each time.

    A task owns its memo and drops it when it ends, so that a worker that is used again holds none.
    """

    LONGEST = 64
    #: what an entry takes besides the characters of its key and value
    ENTRY = 200

    def __init__(self, make, limit: int = 24 << 20):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.LONGEST:
            if self.held >= self.limit:
                self.clear()
                self.held = 0
            self[key] = value
            self.held += self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        return value
