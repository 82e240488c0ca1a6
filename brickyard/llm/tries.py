"""Conversation prefix trie: all prefixes of all conversations by ROLLUP over turn columns.

Conversations share prefixes (a common first turn, a regenerated answer). Each distinct
sequence of first d turns is a node of depth d; its members are the conversations that start
with it.

1. Turns become 16-byte digests of (role, text) with a word count; the texts go no further.
   They are numbered inside ranges of (conversation, turn), so that one conversation of any
   length is sorted by many tasks.
2. ``BLOCK`` turns at a time become positional columns t1 .. tB of one row (conversation,
   block). The block of a long conversation carries the node where its prior block ended, an
   XOR of one 128-bit hash per (depth, turn): a running value, known without following the
   conversation turn by turn.
3. One ``GROUP BY block, node, ROLLUP (t1 .. tB)`` makes the nodes of every depth at once;
   grouping_id tells a column that was rolled up from a conversation that ended before it.
   Counts are combined before the shuffle, so a first turn that everybody shares costs one row
   a task.
4. Sums over subtrees need no walk. The smallest member names a node, and a conversation names
   nodes from some depth on without a gap. So what a subtree holds is the sum over its members
   of what each of them names, less what its own first member names above it: a second ROLLUP
   over the same blocks, with the sums each conversation got from the nodes it names.
5. The ids of conversations that end at a node are joined to text by ranges of ids and hashed
   piece by piece in order; no list of all of them is ever held.

Defined results: turns are ordered by ``turn``, null first, then by the digest of role and text
(repeated rows stay); null role or text is empty. Rows without a conv_id belong to no
conversation. A table without conversations has no nodes, not even a root. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.llm.common import parts, stage

BLOCK = 8               # turn columns of one ROLLUP
CHUNK = 1024            # blocks of a conversation under one partial running value
RANGE = 1 << 10         # conversation ids in one piece of text to hash
RANGE_ROWS = 1 << 20    # turns a range is planned for
SHARE_EVERY, SHARE_MOST = 20, 4  # fixed by the contract of the registered query


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, words): the turns of each conversation, numbered from 1."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(
        F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        digest.alias("id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    ranges = parts(rows.count(), RANGE_ROWS, 4)
    rows = stage(rows.repartitionByRange(ranges, "conv_id", F.col("turn").asc_nulls_first(), "id")
                 .withColumn("part", F.spark_partition_id()), "trie-turns")
    sizes = rows.groupBy("conv_id", "part").count()
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("part")
                                 .rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "id")
    return (rows.withColumn("at", F.row_number().over(place)).join(starts, ["conv_id", "part"])
            .select("conv_id", (F.col("at") + F.col("before")).alias("pos"), "id", "words"))


def with_shared_heads(turns: DataFrame, every: int = SHARE_EVERY, most: int = SHARE_MOST) -> DataFrame:
    """Replace each conversation's first h turns by those of conversation c - c % every.

    h = crc32(decimal c) % most. All turns if the other has fewer, none if it is absent. Rows
    (conv_id, pos, id, words); a conversation without turns is one row with null ``pos``.
    """
    turns = stage(turns, "trie-numbered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most))
    convs = turns.filter("pos = 1").select("conv_id", h.alias("h"), base.alias("base"))
    lent = (convs.join(heads.select(F.col("conv_id").alias("base"), "pos", "id", "words"), "base")
            .filter("pos <= h"))
    taken = lent.groupBy("conv_id").agg(F.count("*").alias("taken"))
    own = turns.filter(F.col("pos") > h).join(taken, "conv_id", "left").select(
        "conv_id", (F.col("pos") - h + F.coalesce("taken", F.lit(0))).alias("pos"), "id", "words")
    none = convs.select("conv_id", *[F.lit(None).cast(t).alias(n) for n, t in
                                     (("pos", "bigint"), ("id", "binary"), ("words", "bigint"))])
    return own.unionByName(lent.select(own.columns)).unionByName(none)


def _lane(lane: int, depth: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(lane), depth, turn)


def _xor(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def blocks_of(turns: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block: turn and word columns, the node and words before it."""
    block = F.floor((F.coalesce("pos", F.lit(1)) - 1) / width).cast("bigint")
    slot = (F.col("pos") - 1) % width
    rows = turns.withColumn("block", block).groupBy("conv_id", "block").agg(
        *[F.max(F.when(slot == i, F.col(c))).alias(f"{c[0]}{i + 1}")
          for c in ("id", "words") for i in range(width)])
    depth = [F.col("block") * width + i + 1 for i in range(width)]
    own = {f"_n{lane}": _xor([F.when(F.col(f"i{i + 1}").isNotNull(), _lane(lane, depth[i], F.col(f"i{i + 1}")))
                              .otherwise(F.lit(0).cast("bigint")) for i in range(width)]) for lane in (1, 2)}
    own["_w"] = sum((F.coalesce(f"w{i + 1}", F.lit(0)) for i in range(width)), F.lit(0).cast("bigint"))
    rows = stage(rows.withColumns(own), "trie-rows")
    # Two running values: over the chunks of a conversation, and over the blocks of a chunk.
    chunk = F.floor(F.col("block") / CHUNK).cast("bigint")
    long = rows.filter("block > 0").select("conv_id").distinct()
    several = (rows.join(long, "conv_id", "left_semi")
               .select("conv_id", "block", chunk.alias("chunk"), *own))
    before = (Window.unboundedPreceding, -1)
    total = {"_n1": F.bit_xor, "_n2": F.bit_xor, "_w": F.sum}
    chunks = several.groupBy("conv_id", "chunk").agg(*[f(c).alias(c) for c, f in total.items()])
    over = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(*before)
    chunks = chunks.select("conv_id", "chunk", *[F.coalesce(f(c).over(over), F.lit(0)).alias(f"c{c}")
                                                 for c, f in total.items()])
    over = Window.partitionBy("conv_id", "chunk").orderBy("block").rowsBetween(*before)
    inner = several.select("conv_id", "block", "chunk", *[F.coalesce(f(c).over(over), F.lit(0)).alias(f"b{c}")
                                                          for c, f in total.items()])
    starts = inner.join(chunks, ["conv_id", "chunk"]).filter("block > 0").select(
        "conv_id", "block", F.col("b_n1").bitwiseXOR(F.col("c_n1")).alias("k1"),
        F.col("b_n2").bitwiseXOR(F.col("c_n2")).alias("k2"), (F.col("b_w") + F.col("c_w")).alias("words"))
    first, later = rows.filter("block = 0"), rows.filter("block > 0")
    zero = F.lit(0).cast("bigint")
    out = first.withColumns({"k1": zero, "k2": zero, "words": zero}).unionByName(
        later.join(starts, ["conv_id", "block"]))
    return stage(out, "trie-blocks")


def _rolled(blocks: DataFrame, width: int, aggregates: dict[str, str]) -> DataFrame:
    """The nodes of all depths: node (p1, p2), its parent's (q1, q2), depth and ``aggregates``.

    ``words`` counts the words of its last turn, ``above`` those of the turns before it.
    """
    spark, turns = blocks.sparkSession, [f"i{i + 1}" for i in range(width)]
    kept = ", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())
    rolled = spark.sql(f"""
        SELECT block, k1, k2, {", ".join(turns)}, grouping_id() AS rolled,
          max(words) AS start, {", ".join(f"max(w{i + 1}) AS w{i + 1}" for i in range(width))}, {kept}
        FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP ({", ".join(turns)})""", blocks=blocks)
    level = F.lit(width) - F.bit_count("rolled")
    last = F.coalesce(*[F.when(F.col("level") == i + 1, F.col(t)) for i, t in enumerate(turns)])
    rolled = rolled.withColumn("level", level).filter(
        last.isNotNull() | ((F.col("block") == 0) & (F.col("level") == 0)))

    def path(lane: int, upto: Column) -> Column:
        steps = [F.when(upto > i, _lane(lane, F.col("block") * width + i + 1, F.col(t)))
                 .otherwise(F.lit(0).cast("bigint")) for i, t in enumerate(turns)]
        return _xor([F.col(f"k{lane}"), *steps])

    words = F.coalesce(*[F.when(F.col("level") == i + 1, F.col(f"w{i + 1}")) for i in range(width)], F.lit(0))
    above = sum((F.when(F.col("level") > i + 1, F.col(f"w{i + 1}")).otherwise(0) for i in range(width)),
                F.col("start"))
    return rolled.select(
        (F.col("block") * width + F.col("level")).alias("depth"),
        path(1, F.col("level")).alias("p1"), path(2, F.col("level")).alias("p2"),
        path(1, F.col("level") - 1).alias("q1"), path(2, F.col("level") - 1).alias("q2"),
        words.alias("words"), above.alias("above"), *aggregates)


def _ends(blocks: DataFrame, width: int) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the nodes where conversations end."""
    depth = F.col("block") * width + sum(F.col(f"i{i + 1}").isNotNull().cast("int") for i in range(width))
    last = blocks.select(
        "conv_id", depth.alias("depth"), F.col("k1").bitwiseXOR(F.col("_n1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("_n2")).alias("p2")).groupBy("conv_id").agg(
        F.max_by(F.struct("depth", "p1", "p2"), "depth").alias("e")).select("conv_id", "e.*")
    ranges = F.floor(F.col("conv_id") / RANGE).cast("bigint")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = (last.groupBy("depth", "p1", "p2", ranges.alias("range")).agg(ids.alias("ids"))
              .repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "range"))
    return pieces.mapInArrow(_hashed, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node; the rows come in order of node and range."""
    node, digest, done = None, None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          names=["depth", "p1", "p2", "ends_sha256"])
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "p1", "p2", "ids"))):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield flush()
        done.clear()
    if node is not None:
        done.append((*node, digest.hexdigest()))
        yield flush()


def prefix_trie(turns: DataFrame, width: int = BLOCK) -> DataFrame:
    """One row per node of the trie of (conv_id, pos, id, words).

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree: (n_convs - 1) * words of the last turn), ends_sha256.
    """
    blocks, key = blocks_of(turns, width), ["depth", "p1", "p2"]
    nodes = stage(_rolled(blocks, width, {"conv_id": "min(conv_id)", "n_convs": "count(*)"}), "trie-nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"),
                                             F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(kids, key, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "trie-children")
    # What each conversation's own nodes hold: their words, the first one's words above, a leaf.
    named = stage(nodes.groupBy("conv_id").agg(
        F.sum("words").alias("named"), F.min("above").alias("skipped"),
        F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaf")), "trie-named")
    whole = blocks.groupBy("conv_id").agg(F.sum("_w").alias("whole"))
    own = stage(whole.join(named, "conv_id", "left").select(
        "conv_id", (F.col("whole") - F.coalesce("named", F.lit(0))).alias("spare"),
        F.coalesce("leaf", F.lit(0)).alias("leaf")), "trie-own")
    sums = _rolled(blocks.join(own, "conv_id"), width,
                   {"n_leaves": "sum(leaf)", "spare": "sum(spare)"}).select(*key, "n_leaves", "spare")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"),
                           F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    saved = F.col("spare") - (F.col("n_convs") - 1) * F.col("above") - F.col("skipped")
    return (nodes.join(sums, key).join(named.select("conv_id", "skipped"), "conv_id")
            .join(parents, ["depth", "q1", "q2"], "left").join(_ends(blocks, width), key, "left")
            .select("conv_id", "depth",
                    F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
                    "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, width: int = BLOCK) -> DataFrame:
    """The trie of the conversations with shared heads (see ``with_shared_heads``)."""
    return prefix_trie(with_shared_heads(turns_of(conversations)), width)
