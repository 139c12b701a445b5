"""Prefix trie of conversations by partition refinement.

All conversations start in one class. A class is split by its members' next
turn; a class of one member is retired, and what is left of that conversation
is a unary chain that is emitted from its length alone. Conversations that end
leave their class. Splitting goes on turn by turn inside a block of depths, and
blocks double from 8 to 256 turns, so rounds grow with the logarithm of the
longest shared prefix (and by a block each beyond 504 turns); of a retired
conversation at most the rest of one block was hashed in vain.

A class is named by a chain of 128-bit hashes of its turns, so a split is one
aggregation with partial sums, whatever the size of a class. Only retired
conversations are taken out, by their own id.

Folding back needs no rounds. The smallest member of a class *owns* its node,
and stays the owner further down, so each conversation owns the end of its
path: from the first depth at which no smaller member is beside it. Hence a
conversation adds to each node above one child (where its own part starts),
one leaf (where it ends in a childless node of its own) and, for saved tokens,
the bytes of the turns that others own: one sum over members for each node,
from what each conversation knows of itself.

Skew: turns are numbered and moved by (conversation, range), members meet their
class by a broadcast where it is large, conversations of many turns are cut in
chunks of 4,096 depths, and the ids that end at one node are joined in chunks
before one task digests them in order, as SHA-256 asks for.

Defined results: a null role or text is empty; turns stand by number, null
first, turns of one number by the hash of role and text; repeated rows are
repeated turns; rows without a conv_id belong to no conversation and give
nothing; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.durable import materialize, new_path
from corrobora.llm.ranks import hot_join, numbered, ordered

#: Depths of the first block and of the largest; ids or depths handled as one row.
FIRST, LARGEST, CHUNK = 8, 256, 4096
#: The share of a conversation's start that it takes from another: at most this many turns, from the first of as many conversations.
LENT, FAMILY = 8, 5
_STEP = "array<struct<depth:bigint,key:binary,cum:bigint,bytes:bigint>>"


def block_ends() -> list[int]:
    """Last depths of the blocks that double; later ones have ``LARGEST`` depths each."""
    ends, size = [], FIRST
    while size < LARGEST:
        ends.append((ends[-1] if ends else 0) + size)
        size *= 2
    return ends


def _block(depth: Column) -> Column:
    ends = block_ends()
    number = F.lit(len(ends)) + F.floor((depth - ends[-1] - 1) / LARGEST)
    for i, end in reversed(list(enumerate(ends))):
        number = F.when(depth <= end, i).otherwise(number)
    return number.cast("int")


def _turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, key, bytes) in order, without their texts, and the starts of conversations; see :mod:`corrobora.llm.ranks`."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    own = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    return ordered(own, "conv_id", [F.col("turn").asc_nulls_first(), F.col("key")])


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (c, depth, key, bytes) and (c, length)."""
    placed, starts = _turns(turns)
    rows = numbered(placed, starts, "conv_id").select(F.col("conv_id").alias("c"), (F.col("node") + 1).alias("depth"), "key", "bytes")
    return rows, starts.groupBy(F.col("conv_id").alias("c")).agg(F.first("n").alias("length"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first crc32(c) % 9 turns of conversation c - c % 5 and go on with their own after as many: (c, depth, key, bytes) and (c, length)."""
    placed, starts = _turns(turns)
    share = (F.crc32(F.col("conv_id").cast("string")) % (LENT + 1)).alias("h")
    convs = starts.groupBy("conv_id").agg(F.first("n").alias("n")).select("conv_id", "n", share, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = materialize(convs.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    lent = convs.where("k > 0").groupBy(F.col("base").alias("conv_id")).agg(F.collect_list(F.struct(F.col("conv_id").alias("c"), "k")).alias("takers"))  # a family at most
    known = materialize(starts.join(convs.select("conv_id", "h", "k"), "conv_id").join(lent, "conv_id", "left"), "starts")
    rows = numbered(placed, known, "conv_id").withColumn("at", F.col("node") + 1)
    given = F.transform(F.filter(F.coalesce("takers", F.array().cast("array<struct<c:bigint,k:bigint>>")), lambda t: F.col("at") <= t["k"]), lambda t: F.struct(t["c"].alias("c"), F.col("at").alias("depth")))
    kept = F.when(F.col("at") > F.col("h"), F.array(F.struct(F.col("conv_id").alias("c"), (F.col("k") + F.col("at") - F.col("h")).alias("depth")))).otherwise(F.array().cast("array<struct<c:bigint,depth:bigint>>"))
    placed_rows = rows.select(F.explode(F.concat(kept, given)).alias("x"), "key", "bytes").select("x.c", "x.depth", "key", "bytes")
    return placed_rows, convs.select(F.col("conv_id").alias("c"), "length")


def _refine(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (c, length, depth, key, cum, bytes) of all classes that were split, and the classes (depth, key, n, m, far)."""
    spark = rows.sparkSession
    path = new_path(spark, "turns")
    rows.withColumn("block", _block(F.col("depth"))).write.partitionBy("block").parquet(path)
    blocks = spark.read.schema("c long, depth long, key binary, bytes long, block int").parquet(path)

    root = convs.select("c", "length", F.lit(0).cast("long").alias("depth"), F.unhex(F.md5(F.lit(""))).alias("key"), F.lit(0).cast("long").alias("cum"), F.lit(0).cast("long").alias("bytes"))
    members, classes, hi, number = materialize(root, "members"), None, 0, 0
    all_members, ends = members, block_ends()
    while True:
        split = members.groupBy("depth", "key").agg(F.count("*").alias("n"), F.min("c").alias("m"), F.max("length").alias("far"))
        split = materialize(split, "classes")
        classes = split if classes is None else classes.union(split)
        retired = split.where("n = 1").select(F.col("m").alias("c")).distinct()
        active = members.where((F.col("depth") == hi) & (F.col("length") > hi)).select("c", "length", "key", "cum").join(retired, "c", "left_anti")
        if active.isEmpty():
            return all_members, classes
        hi = ends[number] if number < len(ends) else hi + LARGEST
        turns = blocks.where(F.col("block") == number).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("depth", "key", "bytes"))).alias("turns"))
        before = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.col("key"), F.col("cum"), F.lit(0).cast("long").alias("bytes"))).cast(_STEP)

        def grow(done: Column, t: Column) -> Column:
            last = F.element_at(done, -1)
            step = F.struct(t["depth"].alias("depth"), F.unhex(F.md5(F.concat(last["key"], t["key"]))).alias("key"), (last["cum"] + t["bytes"]).alias("cum"), t["bytes"].alias("bytes"))
            return F.concat(done, F.array(step)).cast(_STEP)

        steps = F.slice(F.aggregate("turns", before, grow), F.lit(2), F.size("turns"))
        members = materialize(active.join(turns, "c").select("c", "length", F.explode(steps).alias("s")).select("c", "length", "s.*"), "members")
        all_members, number = all_members.union(members), number + 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each (m, depth) over its ids, given joined in chunks and in order; holds one state."""
    key, state = None, hashlib.sha256()

    def out(found: list[tuple]) -> pa.RecordBatch:
        m, depth, digest = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest)], ["m", "depth", "ends_sha256"])

    for batch in batches:
        found = []
        for m, depth, ids in zip(batch.column("m").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (m, depth) != key:
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = (m, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if found:
            yield out(found)
    if key is not None:
        yield out([(*key, state.hexdigest())])


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``rows`` (c, depth from 1, key, bytes), where ``convs`` (c, length) has every conversation once."""
    convs = materialize(convs, "lengths")
    members, classes = _refine(rows, convs)
    shared = materialize(hot_join(members, classes.where("n > 1").withColumn("size", F.col("n")), ["depth", "key"], "size"), "shared")

    other = F.col("m") != F.col("c")  # depths that a smaller member owns
    each = shared.groupBy("c").agg(
        F.max("depth").alias("last"), F.coalesce(F.max(F.when(other, F.col("depth"))) + 1, F.lit(0)).alias("own"), F.max_by(F.when(other, F.col("m")), F.when(other, F.col("depth"))).alias("above"),
        F.coalesce(F.max(F.when(other, F.col("cum"))), F.lit(0)).alias("lent"), F.max(F.when(F.col("depth") == F.col("length"), F.col("far"))).alias("far"),
    )
    known = convs.join(each, "c", "left").select("c", "length", F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("own", F.lit(0)).alias("own"), "above", F.coalesce("lent", F.lit(0)).alias("lent"), "far")
    ends_alone = (F.col("own") <= F.col("length")) & ((F.col("last") < F.col("length")) | (F.col("far") == F.col("length")))
    known = materialize(known.withColumn("leaf", F.coalesce(ends_alone, F.lit(False)).cast("long")).drop("far"), "known")

    chunk = F.expr(f"depth div {CHUNK}")
    pieces = known.where("last >= 0").select("c", "own", "above", "lent", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {CHUNK}"))).alias("chunk"))
    told = shared.withColumn("chunk", chunk).join(pieces, ["c", "chunk"])
    owner = ~other
    nodes = told.groupBy("m", "depth").agg(
        F.max(F.when(owner, F.when(F.col("depth") == F.col("own"), F.col("above")).otherwise(F.col("m")))).alias("parent_conv_id"), F.first("n").alias("n_convs"),
        F.count_if(F.when(owner, F.col("length") > F.col("depth")).otherwise((F.col("own") == F.col("depth") + 1) & (F.col("own") <= F.col("length")))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.coalesce(F.sum(F.when(other, F.col("lent"))), F.lit(0)).alias("lent"), F.first(F.col("cum") - F.col("bytes")).alias("before"),
    )
    ended = shared.where("depth = length").groupBy("m", "depth", F.expr(f"c div {CHUNK}").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    digests = ended.repartition("m", "depth").sortWithinPartitions("m", "depth", "chunk").select("m", "depth", "ids").mapInArrow(_digests, "m long, depth long, ends_sha256 string")
    none = F.sha2(F.lit(""), 256)
    branching = nodes.join(digests, ["m", "depth"], "left").select(
        F.col("m").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("lent") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )

    tails = known.where("last < length").withColumn("first", F.col("last") + 1)
    tails = tails.withColumn("piece", F.explode(F.sequence(F.expr(f"first div {CHUNK}"), F.expr(f"length div {CHUNK}")))).repartition("c", "piece")
    depths = F.sequence(F.greatest(F.col("first"), F.col("piece") * CHUNK), F.least(F.col("length"), F.col("piece") * CHUNK + CHUNK - 1))
    chains = tails.withColumn("depth", F.explode(depths)).select(
        F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("own"), F.col("above")).otherwise(F.col("c")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.sha2(F.col("c").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return branching.union(chains)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(*plain(turns))


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations."""
    return trie(*rebuilt(turns))
