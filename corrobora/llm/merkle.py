"""Merkle manifest of a dataset, as parent-preimage paths.

Every row is a leaf, the rows of a source make a tree of fan-in three, and the
sources' subroots make the root likewise. What is stored of a tree is, for each
parent, its preimage: the joined hashes of its children. A leaf joins its
ancestors' preimages; in each, the 64 characters of its own child are cut out
for the siblings (the proof), or replaced by the hash below it to fold the path
up to the root.

Levels are built four at a time: a block of 81 neighbouring nodes holds four
levels whole, so a tree of n leaves takes log81(n) shuffles, each of a table 81
times smaller than the last, and the preimages of a block are one stored row.
Going down, a block takes its ancestors' preimages from the block above it, so
long paths are carried by blocks, never by leaves, and a leaf meets its path in
one join on (source, block). A source of any size is split over blocks and
ranges; no task sees a whole tree.

Defined results: a null field is ``-`` in the leaf; a null source is a tree of
its own and comes first; rows of a source stand by doc_id, null first, rows of
one doc_id by their leaf, and rows that are equal in all five fields are equal
leaves, one after the other; a null doc_id is never tampered with; an empty
table gives no rows; extra columns are not read. All hashes are lowercase hex.
Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.durable import materialize
from corrobora.llm.ranks import numbered, ordered

FAN, LEVELS = 3, 4
BLOCK = FAN**LEVELS
HEX = 64
PATH = "array<struct<preimage:string,slot:int>>"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value with its UTF-8 byte count before it, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | str = "text") -> Column:
    """The leaf of a row, with ``text`` as its text."""
    return digest(F.concat(*(field(F.col(name)) for name in FIELDS[:-1]), field(F.col(text) if isinstance(text, str) else text)))


def _joined(hashes: Column) -> Column:
    """Preimages of the parents of a run of nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FAN).cast("int")), lambda i: F.array_join(F.slice(hashes, i * FAN + 1, F.lit(FAN)), ""))


def _blocks(nodes: DataFrame) -> DataFrame:
    """From (tree, node, hash, n): a row for each block with ``parents``, the preimages of its levels, and ``top``, the hash they end in."""
    block = F.expr(f"node div {BLOCK}").alias("block")
    rows = nodes.select("tree", block, "n", F.struct("node", "hash").alias("x")).groupBy("tree", "block").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list("x")), lambda x: x["hash"]).alias("h0"))
    for j in range(LEVELS):
        more = F.col("n") > FAN**j  # a tree ends where one node is left
        rows = rows.withColumn(f"p{j}", F.when(more, _joined(F.col(f"h{j}"))).otherwise(F.array().cast("array<string>")))
        rows = rows.withColumn(f"h{j + 1}", F.when(more, F.transform(f"p{j}", digest)).otherwise(F.col(f"h{j}")))
    return rows.select("tree", "block", "n", F.array(*(f"p{j}" for j in range(LEVELS))).alias("parents"), F.get(f"h{LEVELS}", 0).alias("top"))


def grow(nodes: DataFrame) -> list[DataFrame]:
    """The stored blocks of all trees, lowest first. ``nodes``: tree, node (from 0), hash, n (nodes of the tree)."""
    floors = []
    while True:
        floors.append(materialize(_blocks(nodes), "merkle"))
        taller = floors[-1].where(F.col("n") > BLOCK)
        if taller.isEmpty():
            return floors
        nodes = taller.select("tree", F.col("block").alias("node"), F.col("top").alias("hash"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"))


def tops(floors: list[DataFrame]) -> DataFrame:
    """(tree, hash): where each tree ends."""
    out = None
    for floor in floors:
        ended = floor.where(F.col("n") <= BLOCK).select("tree", F.col("top").alias("hash"))
        out = ended if out is None else out.union(ended)
    return out


def _steps(node: Column) -> Column:
    """The ancestors' preimages inside the block of ``parents``, and the node's slot in each."""
    place = F.pmod(node, F.lit(BLOCK)).cast("int")
    steps = [
        F.struct(F.get(F.col("parents")[j], F.floor(place / FAN ** (j + 1)).cast("int")).alias("preimage"), (F.floor(place / FAN**j) % FAN).cast("int").alias("slot"))
        for j in range(LEVELS)
    ]
    return F.filter(F.array(*steps), lambda s: s["preimage"].isNotNull())


def paths(floors: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(tree, block, parents, up, further columns of ``ends``) for the lowest blocks. ``ends``: tree, up (the path above the tree) and what else a leaf needs."""
    extra = [c for c in ends.columns if c != "tree"]
    above = None
    for floor in reversed(floors):
        here = floor.where(F.col("n") <= BLOCK).join(ends, "tree").select("tree", "block", "parents", *extra)
        if above is not None:
            upper = above.withColumnRenamed("block", "over")
            inner = floor.where(F.col("n") > BLOCK).select("tree", "block", F.col("parents").alias("own"), F.expr(f"block div {BLOCK}").alias("over"))
            lifted = inner.join(upper, ["tree", "over"]).withColumn("up", F.concat(_steps(F.col("block")), F.col("up")))
            here = here.union(lifted.select("tree", "block", F.col("own").alias("parents"), *extra))
        above = materialize(here, "paths") if floor is not floors[0] else here
    return above


def with_path(nodes: DataFrame, floors: list[DataFrame], ends: DataFrame) -> DataFrame:
    """``nodes`` (tree, node, ...) with ``path``, from the lowest ancestor to the root, and the further columns of ``ends``."""
    lowest = paths(floors, ends)
    joined = nodes.withColumn("block", F.expr(f"node div {BLOCK}")).join(lowest, ["tree", "block"])
    return joined.withColumn("path", F.concat(_steps(F.col("node")), F.col("up"))).drop("parents", "up", "block")


def siblings(path: str = "path") -> Column:
    """The hashes beside the path, level by level, left to right: every preimage without its own slot."""
    return F.array_join(F.transform(path, lambda s: F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * HEX), F.substr(s["preimage"], s["slot"] * HEX + HEX + 1))), "")


def fold(start: Column, path: str = "path") -> Column:
    """The root that ``start`` leads to: it is spliced into its slot of each preimage in turn."""
    return F.aggregate(path, start, lambda below, s: digest(F.concat(F.substr(s["preimage"], F.lit(1), s["slot"] * HEX), below, F.substr(s["preimage"], s["slot"] * HEX + HEX + 1))))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree, doc_id and leaf of each row, and the leaf that its text ``tampered`` would have (null where that is null)."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(tampered))
    return docs.select(*FIELDS).select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), other.alias("tampered"))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Each row's doc_id, leaf, subroot, root, its path, and the leaf of the tampered text."""
    rows = materialize(leaves(docs, tampered), "leaves")
    placed, starts = ordered(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    nodes = numbered(placed, starts, "tree")
    floors = grow(nodes.select("tree", "node", F.col("leaf").alias("hash"), "n"))

    subroots = tops(floors).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash")
    roots = numbered(*ordered(subroots, "tree", [F.col("source")]), "tree")
    crown = grow(roots.select("tree", "node", "hash", "n"))
    end = tops(crown).select("tree", F.col("hash").alias("root"), F.array().cast(PATH).alias("up"))
    ends = with_path(roots, crown, end).select(F.col("source").alias("tree"), F.col("path").alias("up"), F.col("hash").alias("subroot"), "root")
    return with_path(nodes.drop("n"), floors, materialize(ends, "subroots")).select("doc_id", "leaf", "subroot", "root", "path", "tampered")


def without_newlines() -> Column:
    """The tampering of the report: newlines go where the crc32 of the decimal doc_id is even."""
    even = F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def merkle_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, the proof's digest, and the root that the tampered rows fold to."""
    found = manifest(docs, without_newlines())
    folded = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf")))
    return folded.select("doc_id", "leaf", "subroot", "root", digest(siblings()).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
