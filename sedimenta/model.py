"""Schemas, bounds and configuration."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MUTATION = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("tomb", T.BooleanType(), False),
        T.StructField("commit", T.LongType(), False),
        T.StructField("ord", T.LongType(), False),
    ]
)
"""A row of the change log. (commit, ord) is the only authority on recency, and unique for a key."""

ENTRY = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])

MAX_FIELD = 65_535
"""Longest key or value of the byte formats, whose lengths have 16 bits."""


@dataclass(frozen=True)
class Bound:
    """One end of a range of keys: "included", "excluded" or "unbounded"."""

    kind: str = "unbounded"
    key: bytes | str | None = None

    def __post_init__(self):
        if self.kind not in ("included", "excluded", "unbounded"):
            raise ValueError(f"no such bound: {self.kind}")
        if (self.key is None) != (self.kind == "unbounded"):
            raise ValueError("a bound has a key unless it is unbounded")

    def lower(self, key: Column) -> Column | None:
        """The keys above this end, or None where all are."""
        return {"included": lambda: key >= F.lit(self.key), "excluded": lambda: key > F.lit(self.key), "unbounded": lambda: None}[self.kind]()

    def upper(self, key: Column) -> Column | None:
        return {"included": lambda: key <= F.lit(self.key), "excluded": lambda: key < F.lit(self.key), "unbounded": lambda: None}[self.kind]()


def included(key: bytes | str) -> Bound:
    return Bound("included", key)


def excluded(key: bytes | str) -> Bound:
    return Bound("excluded", key)


unbounded = Bound()


def within(key: Column, lo: Bound = unbounded, hi: Bound = unbounded) -> Column:
    """The range predicate; true everywhere if both ends are open. Inverted ranges hold nothing."""
    parts = [p for p in (lo.lower(key), hi.upper(key)) if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


@dataclass(frozen=True)
class Config:
    """Sizes that drive freezing and compaction. base_level_bytes is the least target of the last level."""

    memtable_size_limit: int = 4 * 1024 * 1024
    base_level_bytes: int = 200 * 1024 * 1024
    max_l0_files: int = 4
    level_multiplier: int = 10
    num_levels: int = 7
    target_file_bytes: int = 256 * 1024 * 1024

    def __post_init__(self):
        if self.level_multiplier < 1 or self.num_levels < 2 or self.max_l0_files < 1 or min(self.memtable_size_limit, self.base_level_bytes, self.target_file_bytes) < 1:
            raise ValueError(f"not a usable configuration: {asdict(self)}")

    def max_level_files(self, level: int) -> int:
        """Files that a level may hold by its depth."""
        return self.max_l0_files * self.level_multiplier**level
