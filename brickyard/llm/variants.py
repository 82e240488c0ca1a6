"""Spelling variants: words one edit apart, found by FM-index search schemes.

1. Runs of letters are cut from whole texts on their bytes, hashed and counted per slice of a
   batch; a word becomes a string once per slice. The counts are summed by Spark.
2. Two words one edit apart agree in the first or in the second half of either. So words meet
   in shards by their first two or three code points (the second half has the error) and by
   their last three (the first half has it). Shards are hashes of these keys; one that holds
   more than ``SHARD_WORDS`` is split into parts, and each part of the indexed words meets each
   part of the asking ones, so no task ever holds a hot shard.
3. A task indexes its words, delimited, as the two directions of a bidirectional FM-index:
   suffix ranks of the words extend a match to the left, those of the reversed words extend it
   to the right. Since a scheme starts at the delimiter and runs to one side, each needs one
   direction only.
4. A scheme matches its half exactly from the delimiter on, then extends across the other half
   with one error: for a wide interval of suffix ranks by every replaced, left-out or put-in
   symbol; an interval of at most ``VERIFY`` ranks has its words compared.
5. Per word: near words counted, the most frequent one kept; roots by doubling along the forms.

Defined results: null text has no words. A null doc_id changes no run. Rows that repeat a
doc_id all count. Ties of forms go to the smallest word in code-point order. Very long runs are
words like any other. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm import words as W
from brickyard.llm.common import parts, stage

# Fixed by the contract of the registered query.
LEAST_POINTS, LEAST_TIMES, EVERY, TIMES = 5, 3, 97, 2

SHARD_WORDS = 1 << 15   # indexed words of a task, and asking words
VERIFY = 64             # suffix ranks in an interval whose words are compared one by one
BROADCAST_ROWS = 1 << 17  # counted split shards up to which they are broadcast
QUERIES = 1 << 13       # words searched at once
SLICE = 1 << 21         # bytes of text cut at once
_LONG = 64              # bytes above which a run's checksum is computed by itself

_U8 = np.uint8
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = (_TABLE >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (_TABLE & np.uint32(1)))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_BREAK = np.array([True, False])


# Words and their counts

def _checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, continued from ``seed`` (a finished CRC-32)."""
    out, size = seed.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), end - start
    by = np.argsort(-size, kind="stable")
    by = by[np.searchsorted(-size[by], -_LONG):]
    state, first, size = out[by], start[by], size[by]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        state[:n] = _TABLE[(state[:n] ^ data[first[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[by] = state
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(end - start > _LONG):
        out[i] = zlib.crc32(data[start[i]:end[i]].tobytes(), int(seed[i]))
    return out


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(bounds),
                                       pa.py_buffer(data[W.ragged(start, size)].tobytes()))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for at, data, offsets in W.texts(batch.column("text"), SLICE):
            low = W.LOWER[data]
            mark = _LETTER[low]
            mark[1:] |= low[:-1] == 0xC3
            start, end, row = W.spans(mark.astype(_U8), offsets, _BREAK)
            pairs = np.concatenate(([0], np.cumsum(low == 0xC3)))
            points = (end - start) - (pairs[end] - pairs[start])
            long = points >= LEAST_POINTS
            start, end, row, points = start[long], end[long], row[long], points[long]
            named = [ids[at + r] for r in range(len(offsets) - 1)]
            seeds = np.array([zlib.crc32(b"%d:" % i) if i is not None else 0 for i in named], np.uint32)
            known = np.array([i is not None for i in named], bool)
            crc = _checksums(low, start, end, seeds[row]) if len(row) else np.zeros(0, np.uint32)
            cut = (crc % np.uint32(EVERY) == 0) & known[row]
            shorter = []
            for i in np.flatnonzero(cut & (points > LEAST_POINTS)):
                run, p = low[start[i]:end[i]].tobytes().decode(), int(crc[i]) % int(points[i])
                shorter.append(run[:p] + run[p + 1:])
            start, end = start[~cut], end[~cut]
            _, first, times = np.unique(W.hashes(low, start, end), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_strings(low, start[first], end[first]),
                                              pa.array(times, pa.int64())], names=["word", "n"])
            if shorter:
                yield pa.RecordBatch.from_arrays([pa.array(shorter, pa.string()),
                                                  pa.array([1] * len(shorter), pa.int64())],
                                                 names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least five code points that occur at least three times."""
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _counts, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


# One shard

class Direction:
    """FM-index of delimited words; a match starts at a word's end and extends to the left.

    ``words``: sorted byte strings without zero bytes. Suffixes are compared up to the
    delimiter; ties keep the order of the words, so the rank of a delimiter is a word's number.
    """

    def __init__(self, words: list[bytes]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", _U8)
        n = self.n = len(self.text)
        self.first = 1 + np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
        at = np.flatnonzero(self.text == 0)
        stop = at[np.searchsorted(at, np.arange(n))]
        rank, step = self.text.astype(np.int64), 1
        while step <= (size.max() if len(size) else 0):
            ahead = np.minimum(np.arange(n) + step, n - 1)
            key = rank * (n + 256) + np.where(np.arange(n) + step <= stop, rank[ahead] + 1, 0)
            by = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[by] = np.cumsum(np.concatenate(([0], key[by][1:] != key[by][:-1])))
            step *= 2
        self.suffix = np.argsort(rank, kind="stable")
        before = self.text[self.suffix - 1].astype(np.int64)
        before[self.suffix == 0] = 256  # no symbol
        self.before = before
        self.ranks = np.sort(before * (n + 1) + np.arange(n))
        self.letters = np.unique(self.text[self.text > 0]).astype(np.int64)

    def left(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the first suffix that is ``symbol`` and a suffix of rank ``at`` or more."""
        return np.searchsorted(self.ranks, symbol * (self.n + 1) + at) + (symbol > 0)

    def word(self, rank: np.ndarray) -> np.ndarray:
        """Number of the word in which the suffix of this rank starts."""
        return np.searchsorted(self.first, self.suffix[rank], "right") - 1


def _symbols(index: Direction, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, letter): the letters that stand before the suffixes of each interval."""
    narrow = high - low <= len(index.letters)
    size = np.where(narrow, high - low, 0)
    state = np.repeat(np.arange(len(low)), size)
    letter = index.before[W.ragged(low, size)]
    both = np.unique((state * 512 + letter)[(letter > 0) & (letter < 256)])
    wide = np.flatnonzero(~narrow)
    return (np.concatenate((both // 512, np.repeat(wide, len(index.letters)))),
            np.concatenate((both % 512, np.tile(index.letters, len(wide)))))


def _agree(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, most: np.ndarray, step: int
           ) -> np.ndarray:
    """How many symbols agree from x[i], y[j] on in direction ``step``, at most ``most``."""
    out, live = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
    while len(live):
        k = out[live]
        live = live[x[i[live] + step * k] == y[j[live] + step * k]]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def _searched(index: Direction, asking: list[bytes], loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word number): words one edit from each query, which lies in its first ``loose`` symbols.

    The other symbols agree. A query may find a word more than once.
    """
    text = np.frombuffer(b"".join(asking), _U8)
    size = np.fromiter(map(len, asking), np.int64, len(asking))
    base = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def wanted(q: np.ndarray, j: np.ndarray) -> np.ndarray:
        return text[base[q] + j - 1].astype(np.int64)

    def step(q, j, low, high):
        """Match the next symbol of each query; states without a suffix left go."""
        c = wanted(q, j)
        low, high = index.left(c, low), index.left(c, high)
        live = high > low
        return q[live], j[live] - 1, low[live], high[live]

    def compared(q, j, low, high, errors: int) -> None:
        """Compare what stands before the suffixes of narrow intervals with the query's rest."""
        many = high - low
        rank = W.ragged(low, many)
        q, j, word = np.repeat(q, many), np.repeat(j, many), index.word(rank)
        rest = index.suffix[rank] - index.first[word]
        fits = np.abs(rest - j) <= errors
        q, j, word, rest = q[fits], j[fits], word[fits], rest[fits]
        less = np.minimum(rest, j)
        head = _agree(text, base[q], index.text, index.first[word], less, 1)
        if errors:
            part = np.flatnonzero((rest != j) | (head < j))
            q, j, word, rest, less, head = (x[part] for x in (q, j, word, rest, less, head))
            tail = _agree(text, base[q] + j - 1, index.text, index.first[word] + rest - 1, less, -1)
            hit = head + tail >= less - (rest == j)
        else:
            hit = head == j
        found.append((q[hit], word[hit]))

    def narrow(q, j, low, high, errors):
        few = high - low <= VERIFY
        if few.any():
            compared(q[few], j[few], low[few], high[few], errors)
        return q[~few], j[~few], low[~few], high[~few]

    def ended(q, j, low, high):
        """States whose query is used up: the word that the delimiter before them starts."""
        done = j == 0
        zero = np.zeros(int(done.sum()), np.int64)
        a, b = index.left(zero, low[done]), index.left(zero, high[done])
        found.append((q[done][b > a], a[b > a]))
        return q[~done], j[~done], low[~done], high[~done]

    q = np.arange(len(asking))
    zero = np.zeros(len(q), np.int64)
    state = (q, size.copy(), zero, np.full(len(q), len(index.first) + 1))
    exact = [np.zeros(0, np.int64)] * 4
    while len(state[0]):  # the exact half, from the delimiter on
        ready = state[1] <= loose[state[0]]
        exact = [np.concatenate((a, b[ready])) for a, b in zip(exact, state)]
        state = step(*(x[~ready] for x in state))
    off = [np.zeros(0, np.int64)] * 4
    while len(exact[0]) or len(off[0]):
        q, j, low, high = narrow(*exact, 1)
        more = [off]
        if len(q):
            inner = j < loose[q]
            right = np.where(inner, text[base[q] + np.minimum(j, size[q] - 1)], 0)
            here = np.where(j > 0, wanted(q, np.maximum(j, 1)), 0)
            out = (j > 0) & ~(inner & (here == right))  # of equal symbols the last one is left out
            more.append([q[out], j[out] - 1, low[out], high[out]])
            s, c = _symbols(index, low, high)
            a, b = index.left(c, low[s]), index.left(c, high[s])
            live = b > a
            s, c, a, b = s[live], c[live], a[live], b[live]
            put = ~(inner[s] & (c == right[s]))
            more.append([q[s][put], j[s][put], a[put], b[put]])
            other = (j[s] > 0) & (c != here[s])
            more.append([q[s][other], j[s][other] - 1, a[other], b[other]])
        on = j > 0
        exact = step(q[on], j[on], low[on], high[on])
        state = [np.concatenate(x) for x in zip(*more)]
        off = step(*ended(*narrow(*state, 0)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (q, q)


def near_words(indexed: list[bytes], asking: list[bytes], front: bool
               ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (asking word, indexed word) numbers, one edit apart.

    ``front``: pairs that agree in the first half of the asking word. Else those that agree in
    its second half, but for the pairs that agree in the first one too.
    """
    if not indexed or not asking:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = sorted(range(len(indexed)), key=(lambda i: indexed[i][::-1]) if front else indexed.__getitem__)
    index = Direction([indexed[i][::-1] if front else indexed[i] for i in order])
    number = np.array(order, np.int64)
    out = []
    for a in range(0, len(asking), QUERIES):
        some = asking[a:a + QUERIES]
        size = np.fromiter(map(len, some), np.int64, len(some))
        if front:
            q, word = _searched(index, [w[::-1] for w in some], size - size // 2)
        else:
            q, word = _searched(index, some, size // 2)
        pair = np.unique(q * len(indexed) + word)
        q, word = pair // len(indexed), pair % len(indexed)
        if not front and len(q):
            base = np.concatenate(([0], np.cumsum(size)[:-1]))
            half = size[q] // 2
            same = _agree(np.frombuffer(b"".join(some), _U8), base[q], index.text, index.first[word],
                          half, 1) == half
            q, word = q[~same], word[~same]
        out.append((q + a, number[word]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _shard(table: pa.Table) -> pa.Table:
    """Near words of one part of a shard: (word, n_near, best_n, best)."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    times = table.column("n").to_numpy()
    indexed, asks = table.column("indexed").to_numpy(), table.column("asks").to_numpy()
    own, ask = np.flatnonzero(indexed), np.flatnonzero(asks)
    front = table.column("family")[0].as_py() < 2
    q, near = near_words([words[i] for i in own], [words[i] for i in ask], front)
    q, near = ask[q], own[near]
    by = sorted(range(len(own)), key=lambda i: words[own[i]])
    place = np.zeros(len(words), np.int64)
    place[own[by]] = np.arange(len(own))
    by = np.lexsort((place[near], -times[near], q))
    q, near = q[by], near[by]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))[:len(q)])
    return pa.table({"word": pa.array([words[i].decode("latin-1") for i in q[first]], pa.string()),
                     "n_near": pa.array(np.diff(np.append(first, len(q))), pa.int64()),
                     "best_n": pa.array(times[near[first]], pa.int64()),
                     "best": pa.array([words[i].decode("latin-1") for i in near[first]], pa.string())})


# All words

def _sharded(words: DataFrame, shard_words: int) -> DataFrame:
    """Indexed and asking words of each part of each shard; words are in up to three families.

    Family 0: asking words of five code points by their first two; 1: longer ones by their
    first three; 2: all by their last three. A word is indexed where near words ask.
    """
    size, shards = F.length("word"), parts(words.count(), shard_words / 4)
    keys = F.filter(F.array(
        F.when(size <= 6, F.struct(F.lit(0).alias("family"), F.substring("word", 1, 2).alias("key"),
                                   (size == 5).alias("asks"))),
        F.struct(F.lit(1).alias("family"), F.substring("word", 1, 3).alias("key"), (size > 5).alias("asks")),
        F.struct(F.lit(2).alias("family"), F.substring("word", -3, 3).alias("key"), F.lit(True).alias("asks"))),
        lambda k: k.isNotNull())
    rows = words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*").withColumn(
        "shard", F.pmod(F.xxhash64("family", "key"), F.lit(shards)))
    rows = stage(rows.drop("key"), "variant-rows")
    cells = stage(rows.groupBy("family", "shard").agg(
        F.ceil(F.count("*") / shard_words).alias("cells")).filter("cells > 1"), "variant-cells")
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells
    rows = rows.join(cells, ["family", "shard"], "left").withColumn(
        "cells", F.coalesce("cells", F.lit(1).cast("bigint")))
    own = F.pmod(F.xxhash64(F.lit("part"), F.col("word")), F.col("cells"))

    def cell(x: Column, y: Column, indexed: Column, asks: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), indexed.alias("indexed"), asks.alias("asks"))

    # Row x of the grid holds the indexed words of part x, column y the asking ones of part y.
    yes, no = F.lit(True), F.lit(False)
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1), lambda i: i != own)
    places = F.concat(F.array(cell(own, own, yes, F.col("asks"))),
                      F.transform(others, lambda i: cell(own, i, yes, no)),
                      F.when(F.col("asks"), F.transform(others, lambda i: cell(i, own, no, yes)))
                      .otherwise(F.array().cast("array<struct<x:bigint,y:bigint,indexed:boolean,asks:boolean>>")))
    rows = rows.select("word", "n", "family", "shard", F.explode(places).alias("p")).select(
        "word", "n", "family", "shard", "p.*")
    # Searching is much work on few bytes; a set number of tasks is not merged by size.
    return rows.repartition(3 * shards, "family", "shard", "x", "y")


def nearest(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, n_near, best, best_n) of (word, n): near words and the most frequent of them."""
    pairs = _sharded(words, shard_words).groupBy("family", "shard", "x", "y").applyInArrow(
        _shard, "word string, n_near bigint, best_n bigint, best string")
    near = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(
        F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root``, the last word along ``form``, which is null at the end of every path."""
    steps = stage(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant-steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = stage(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("went")), "variant-roots")
        steps = on.drop("went")
        if on.filter("went").isEmpty():
            break
    return forms.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, times: int = TIMES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per word: word, n, n_near, form (null: none), form_n, root."""
    words = stage(vocabulary(docs), "variant-words")
    fits = F.col("best_n") >= times * F.col("n")
    forms = stage(nearest(words, shard_words).select(
        "word", "n", "n_near", F.when(fits, F.col("best")).alias("form"),
        F.when(fits, F.col("best_n")).alias("form_n")), "variant-forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
