"""Exact duplicates through a sharded cuckoo-filter index of live digests.

Texts are compared after deleting ASCII white space. A digest's shard owns a cuckoo filter and
a bucket of stored keys. A key that the filter does not know is new; a hit is verified against
the stored digest, byte length and a second checksum. Deleting the last live copy takes the
fingerprint out again, and a filter that overflows is rebuilt twice as large from the stored keys.

Defined results: null text counts as empty, and all empty texts are equal. Of equal texts the
one with the most code points stays, then the smallest doc_id, null ids last. Rows that repeat
a doc_id with equal text are one document and share their result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import fresh, parts, stage

SHARD_KEYS = 50_000  # stored keys a shard is planned for
SALTS = 8            # rows of one digest that reach its shard at most

_ENTRY = ("shard int, kind string, key binary, n_bytes bigint, seal bigint, live bigint, "
          "neg_chars bigint, no_id boolean, keep_id bigint, stale boolean, filter binary")


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, four slots a bucket."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int = 64):
        self.table = np.zeros((buckets, self.SLOTS), np.uint16)

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy()
        return out

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mask = len(self.table) - 1
        mark = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[2:10], "little") & mask
        return mark, one, one ^ self._step(mark, mask)

    @staticmethod
    def _step(mark: int, mask: int) -> int:
        return (mark * 0x5BD1E995) & mask

    def __contains__(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        return mark in self.table[one].tolist() or mark in self.table[two].tolist()

    def add(self, key: bytes) -> bool:
        """False on overflow; the filter must then be rebuilt from the stored keys."""
        mark, at, two = self._places(key)
        for place in (at, two):
            row = self.table[place].tolist()
            if 0 in row:
                self.table[place, row.index(0)] = mark
                return True
        mask = len(self.table) - 1
        for kick in range(self.KICKS):
            slot = (kick + mark) % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= self._step(mark, mask)
            row = self.table[at].tolist()
            if 0 in row:
                self.table[at, row.index(0)] = mark
                return True
        return False

    def remove(self, key: bytes) -> None:
        mark, one, two = self._places(key)
        for place in (one, two):
            row = self.table[place].tolist()
            if mark in row:
                self.table[place, row.index(mark)] = 0
                return

    @classmethod
    def built(cls, keys, buckets: int) -> CuckooFilter:
        """A filter of all ``keys``, doubled until they fit."""
        while True:
            out = cls(buckets)
            if all(out.add(k) for k in keys):
                return out
            buckets *= 2


class Shard:
    """One shard: the filter in front of the stored keys."""

    def __init__(self, entries: pd.DataFrame):
        self.keys: dict[bytes, list] = {}
        raw = None
        for e in entries.itertuples(index=False):
            if e.kind == "filter":
                raw = bytes(e.filter)
            else:
                self.keys[bytes(e.key)] = [e.n_bytes, e.seal, e.live,
                                           (e.neg_chars, e.no_id, e.keep_id), e.stale]
        self.filter = CuckooFilter.load(raw) if raw else CuckooFilter.built(self.keys, 64)
        self.resizes = 0

    def stored(self, key: bytes, n_bytes: int, seal: int) -> list | None:
        """The verified entry of a key, or None where the filter or the bucket has none."""
        if key not in self.filter:
            return None
        entry = self.keys.get(key)
        if entry is not None and (entry[0], entry[1]) != (n_bytes, seal):
            raise ValueError("two texts with one SHA-256 digest")
        return entry

    def insert(self, key, n_bytes, seal, n, rank) -> None:
        entry = self.stored(key, n_bytes, seal)
        if entry is None:
            self.keys[key] = [n_bytes, seal, n, rank, False]
            if not self.filter.add(key):
                self.filter = CuckooFilter.built(self.keys, 2 * len(self.filter.table))
                self.resizes += 1
        else:
            entry[2] += n
            entry[3] = min(entry[3], rank)

    def delete(self, key, n_bytes, seal, n, rank) -> None:
        entry = self.stored(key, n_bytes, seal)
        if entry is None:
            return
        entry[2] -= n
        if entry[2] <= 0:
            del self.keys[key]
            self.filter.remove(key)
        elif rank == entry[3]:
            entry[4] = True

    def rows(self, shard: int) -> pd.DataFrame:
        out = [(shard, "key", k, *e[:3], *e[3], e[4], None) for k, e in self.keys.items()]
        out.append((shard, "filter", None, 0, 0, 0, 0, False, 0, False, self.filter.dump()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ENTRY.split(", ")])


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_bytes, seal, n_chars) of every row, from whole texts."""
    norm = normalised(F.col(text_col))
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), norm.alias("norm"),
                        F.char_length(F.coalesce(text_col, F.lit(""))).cast("bigint")
                        .alias("n_chars"))
            .select("doc_id", F.unhex(F.sha2("norm", 256)).alias("key"),
                    F.octet_length("norm").cast("bigint").alias("n_bytes"),
                    F.xxhash64("norm").alias("seal"), "n_chars"))


def apply_changes(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None,
                  shards: int | None = None) -> DataFrame:
    """The index after ``deletes`` and then ``inserts`` (both as ``signatures`` returns).

    The number of shards is kept over the index's life; without one it follows the first
    batch. Copies are counted per digest and salt before they go to their shard, so a digest
    that holds a third of all rows sends ``SALTS`` rows. ``stale`` marks digests whose kept
    row was deleted; ``refreshed`` picks their next one.
    """
    if shards is None:
        shards = parts(inserts.count() if index is None
                       else index.agg(F.max("shard") + 1).first()[0], SHARD_KEYS if index is None else 1)

    def grouped(rows: DataFrame, sign: int) -> DataFrame:
        exact = [] if sign > 0 else ["doc_id"]
        return (rows.groupBy("key", "n_bytes", "seal", *exact,
                             F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(SALTS)).alias("salt"))
                .agg(F.count("*").alias("n"),
                     F.min(F.struct((-F.col("n_chars")).alias("neg_chars"),
                                    F.col("doc_id").isNull().alias("no_id"),
                                    F.coalesce("doc_id", F.lit(0)).alias("keep_id"))).alias("best"))
                .select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"),
                        F.lit(sign).alias("sign"), "key", "n_bytes", "seal", "n", "best.*"))

    changes = grouped(inserts, 1)
    if deletes is not None:
        changes = changes.unionByName(grouped(deletes, -1))

    def one(number: int, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(old)
        for c in new.sort_values("sign", kind="stable").itertuples(index=False):
            change = shard.delete if c.sign < 0 else shard.insert
            change(bytes(c.key), c.n_bytes, c.seal, c.n, (c.neg_chars, c.no_id, c.keep_id))
        return shard.rows(number)

    if index is None:
        return changes.groupBy("shard").applyInPandas(
            lambda key, new: one(int(key[0]), new.iloc[:0].assign(kind=[], filter=[], live=[], stale=[]),
                                 new), _ENTRY)
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(
        lambda key, old, new: one(int(key[0]), old, new), _ENTRY)


def refreshed(index: DataFrame, live: DataFrame) -> DataFrame:
    """The index with the next row to keep for stale digests, from the ``live`` signatures."""
    due = index.filter("stale").select("key")
    best = (live.join(due, "key", "left_semi").groupBy("key")
            .agg(F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"),
                                F.coalesce("doc_id", F.lit(0)).alias("i"))).alias("b")))
    hit = F.col("b").isNotNull()
    return (index.join(best, "key", "left")
            .withColumns({"neg_chars": F.when(hit, F.col("b.c")).otherwise(F.col("neg_chars")),
                          "no_id": F.when(hit, F.col("b.z")).otherwise(F.col("no_id")),
                          "keep_id": F.when(hit, F.col("b.i")).otherwise(F.col("keep_id")),
                          "stale": F.when(hit, False).otherwise(F.col("stale"))})
            .select(index.columns))


def kept_keys(index: DataFrame) -> DataFrame:
    """(key, keep_id, group_size) of every live digest."""
    return index.filter("kind = 'key'").select(
        "key", F.when(~F.col("no_id"), F.col("keep_id")).alias("keep_id"),
        F.col("live").alias("group_size"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                ) -> tuple[DataFrame, DataFrame]:
    """(signatures, index) of a table, both written: texts are read once."""
    rows = stage(signatures(docs, id_col, text_col), "exact-rows")
    return rows, stage(apply_changes(None, rows), "exact-index")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, index = build_index(docs, id_col, text_col)
    keys = kept_keys(index)
    return (rows.join(keys, "key")
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("key")).alias("text_sha256")))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                       ) -> DataFrame:
    """``docs`` without the rows that are not kept; all columns as they are."""
    _, index = build_index(docs, id_col, text_col)
    key, kept, own = (fresh(docs, c) for c in ("_key", "_kept_id", "_own_key"))
    keep = kept_keys(index).select(F.col("key").alias(key), F.col("keep_id").alias(kept))
    rows = docs.withColumn(own, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    return (rows.join(keep, (F.col(own) == F.col(key))
                      & F.col(id_col).cast("bigint").eqNullSafe(F.col(kept)), "left_semi")
            .select(docs.columns))
