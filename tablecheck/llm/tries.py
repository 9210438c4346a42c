"""Prefix tries of conversations from padded matrices of turn ids.

1. A turn is named by 128 bits of its role and text; a conversation is the sequence
   of its turns' names, so texts are read once and never shuffled.
2. Sequences are dealt into shards by range over (sequence, conv_id). A node's members
   are neighbours in that order: copies of one conversation, or a first turn that a
   third of all conversations share, spread over as many shards as they need.
3. Inside a shard, tiles of a few columns are sorted with numpy's lexsort; a tile holds
   only the rows that reach it, so one long conversation pads no short one. Change
   masks, OR-accumulated over the columns, mark where nodes start, and reduceat
   aggregates each depth, first downwards (members), then upwards (subtrees).
4. Only the nodes on the path to a shard's first or last row can go on in the next
   shard. The longest common prefix of neighbouring rows says which do; their sums are
   kept linear, so that adding up the shards' shares completes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .base import cut, query, table

WIDTH = 16  # bytes that name a turn
TURNS = 200_000  # of a shard, about
CELLS = 65_536  # of a tile, at least 8 columns
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = [
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
]
NODES = (
    "key binary, parent_key binary, turn_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string"
)


def turn_key(role: Column, text: Column) -> Column:
    """The name of a turn: 128 bits of SHA-256 over role and text. Null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 2 * WIDTH))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, seq (the turns' names one after another) and sizes (UTF-8 bytes of
    their texts) of every conv_id. Turns are ordered by turn, null first, then role,
    then name, so repeated rows stay and ties have one order. Rows without conv_id
    belong to no conversation. One conversation's names (16 bytes a turn) must fit into
    a task."""
    text = F.coalesce(F.col("text"), F.lit(""))
    item = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        turn_key(F.col("role"), F.col("text")).alias("key"),
        F.octet_length(text).alias("size"),
    )
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), item.alias("t"))
    # Dealt by the conversation that lends its head, so that lending needs no exchange.
    near = rows.withColumn("lender", F.col("conv_id") - F.col("conv_id") % 5).repartition("lender")
    lists = near.groupBy("lender", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    names = F.unhex(F.array_join(F.transform("t.key", lambda k: F.hex(k)), ""))
    return lists.select("lender", "conv_id", names.alias("seq"), F.col("t.size").alias("sizes"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with its first h turns taken from conversation c - c % 5 (none
    if there is none, all if it has fewer), h = crc32 of the decimal c, modulo 9, and its
    own turns after the first h. Columns conv_id, seq, sizes."""
    convs = conversations(turns)
    own = F.col("conv_id") == F.col("lender")
    head = F.struct(F.substring("seq", 1, 8 * WIDTH).alias("seq"), F.slice("sizes", 1, 8).alias("sizes"))
    lent = F.first(F.when(own, head), ignorenulls=True).over(Window.partitionBy("lender"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    made = convs.select("conv_id", "seq", "sizes", lent.alias("lent"), h.alias("h"))
    seq = F.concat(
        F.coalesce(F.substring(F.col("lent.seq"), F.lit(1), F.col("h") * WIDTH), F.lit(b"")),
        F.substring(F.col("seq"), F.col("h") * WIDTH + 1, F.octet_length("seq")),
    )
    own_sizes = F.slice("sizes", F.col("h") + 1, F.greatest(F.size("sizes"), F.lit(1)))
    sizes = F.concat(F.coalesce(F.slice(F.col("lent.sizes"), F.lit(1), F.col("h")), F.array().cast("array<int>")), own_sizes)
    return made.select("conv_id", seq.alias("seq"), sizes.alias("sizes"))


class Shard:
    """The nodes of one shard. `left` and `right`: how many turns its first (last) row
    shares with the row before (after) it in another shard, -1 without such a row."""

    def __init__(self, convs: np.ndarray, seqs: list[bytes], sizes: pa.ListArray, left: int, right: int) -> None:
        order = np.argsort(convs, kind="stable")
        self.lens = np.array([len(s) for s in seqs], np.int64) // WIDTH
        self.starts = np.cumsum(self.lens) - self.lens
        names = np.frombuffer(b"".join(seqs), ">u8").astype(np.uint64).reshape(-1, 2)
        self.high, self.low = names[:, 0], names[:, 1]
        self.sizes = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.convs, self.order, self.seqs = convs, order, seqs
        self.left, self.right = left, right
        self.levels: list[dict[str, np.ndarray]] = []
        self._descend()
        self._ascend()

    def _level(self, rows: np.ndarray, first: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Adds the nodes of one depth. `rows`: places in the order of the rows that reach
        it; `first`: where in `rows` a node starts. Returns each row's node."""
        depth = len(self.levels)
        members = np.diff(np.append(first, len(rows)))
        at = self.order[rows]
        size = np.zeros(len(first), np.int64)
        if depth:
            size = self.sizes[self.starts[at[first]] + depth - 1]
        node = np.repeat(np.arange(len(first)), members)
        self.levels.append(
            {
                "place": rows[first],
                "n_convs": members,
                "conv_id": np.minimum.reduceat(self.convs[at], first) if len(first) else members,
                "size": size,
                "parent": parent,
            }
        )
        return node

    def _descend(self) -> None:
        rows = np.arange(len(self.order))
        node = self._level(rows, np.zeros(1, np.int64), np.full(1, -1))
        below = 0
        while (going := self.lens[self.order[rows]] > below).any():
            rows, node = rows[going], node[going]
            width = max(8, CELLS // len(rows))
            width = min(width, int(self.lens[self.order[rows]].max()) - below)
            at = self.order[rows]
            cells = below + np.arange(width)
            inside = cells < self.lens[at][:, None]
            index = np.where(inside, self.starts[at][:, None] + cells, 0)
            high, low = np.where(inside, self.high[index], 0), np.where(inside, self.low[index], 0)
            # The last key counts most: nodes so far, then the columns from left to right.
            keys = [column for j in range(width - 1, -1, -1) for column in (low[:, j], high[:, j])]
            sort = np.lexsort([*keys, node])
            self.order[rows] = at[sort]
            high, low, inside = high[sort], low[sort], inside[sort]
            change = np.ones((len(rows), width), bool)
            change[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
            change[1:, 0] |= node[1:] != node[:-1]
            change = np.logical_or.accumulate(change, axis=1)
            for j in range(width):
                reach = np.flatnonzero(inside[:, j])
                first = np.flatnonzero(change[reach, j])
                made = self._level(rows[reach], first, node[reach[first]])
                node = np.zeros(len(rows), np.int64)
                node[reach] = made
            below += width

    def _ascend(self) -> None:
        """Sums over subtrees. Shares of nodes that go on in another shard stay linear:
        bytes are taken off where a node begins, a leaf is counted where its last row is."""
        deeper: dict[str, np.ndarray] | None = None
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            n = len(level["n_convs"])
            begins, goes_on = np.ones(n, bool), np.zeros(n, bool)
            if depth <= self.left:
                begins[0] = False
            if depth <= self.right:
                goes_on[-1] = True
            level["open"] = ~begins | goes_on
            level["begins"] = begins
            level["saved"] = (level["n_convs"] - begins) * level["size"]
            level["children"] = np.zeros(n, np.int64)
            level["leaves"] = np.zeros(n, np.int64)
            childless = np.ones(n, bool)
            if deeper is not None:
                cuts = np.flatnonzero(np.diff(deeper["parent"], prepend=-1))
                above = deeper["parent"][cuts]
                level["children"][above] = np.add.reduceat(deeper["begins"].astype(np.int64), cuts)
                level["leaves"][above] = np.add.reduceat(deeper["leaves"], cuts)
                level["saved"][above] += np.add.reduceat(deeper["saved"], cuts)
                childless[above] = False
            level["leaves"][childless & ~goes_on] = 1
            deeper = level

    def _ends(self, depth: int) -> list[str | None]:
        """The conv_ids whose conversations end at each node, None where none does."""
        level = self.levels[depth]
        out: list[str | None] = [None] * len(level["place"])
        # A node's first rows are those that end there, by ascending conv_id.
        stop = level["place"] + level["n_convs"]
        for i in np.flatnonzero(self.lens[self.order[level["place"]]] == depth):
            mine = self.order[level["place"][i] : stop[i]]
            mine = mine[: np.searchsorted(self.lens[mine] > depth, True)]
            out[i] = ",".join(map(str, self.convs[mine].tolist()))
        return out

    def tables(self) -> Iterator[pa.Table]:
        """The nodes, one table per depth."""
        kinds = {f.split(" ")[0]: f.split(" ")[1] for f in NODES.split(", ")}
        types = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        edges = [self.seqs[self.order[0]], self.seqs[self.order[-1]]]
        paths = [hashlib.blake2b(digest_size=WIDTH) for _ in edges]
        above: list[bytes | None] = []
        for depth, level in enumerate(self.levels):
            n = len(level["n_convs"])
            if depth:
                for path, seq in zip(paths, edges):
                    path.update(seq[(depth - 1) * WIDTH : depth * WIDTH])
            keys: list[bytes | None] = [None] * n
            if level["open"][0]:
                keys[0] = (paths[0] if depth <= self.left else paths[1]).digest()
            if level["open"][-1]:
                keys[-1] = (paths[1] if depth <= self.right else paths[0]).digest()
            ends = self._ends(depth)
            parent = level["parent"]
            at = self.order[level["place"]]
            higher = self.levels[depth - 1] if depth else None
            out = {
                "key": keys,
                "parent_key": [above[p] for p in parent] if depth else [None] * n,
                "turn_key": [self.seqs[i][(depth - 1) * WIDTH : depth * WIDTH] for i in at] if depth else [None] * n,
                "conv_id": level["conv_id"],
                "depth": np.full(n, depth),
                "parent_conv_id": higher["conv_id"][parent] if higher else [None] * n,
                "n_convs": level["n_convs"],
                "n_children": level["children"],
                "n_leaves": level["leaves"],
                "saved_tokens": level["saved"],
                "ends_sha256": [
                    None if k else NO_ENDS if e is None else hashlib.sha256(e.encode()).hexdigest()
                    for k, e in zip(keys, ends)
                ],
                "ends": [e if k else None for k, e in zip(keys, ends)],
            }
            above = keys
            yield pa.table({name: pa.array(values, types[kinds[name]]) for name, values in out.items()})


def _shard_nodes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(list(rows)).combine_chunks()
    left, right = whole["left"][0].as_py(), whole["right"][0].as_py()
    sizes = pa.concat_arrays(whole["sizes"].chunks)
    held: list[pa.Table] = []
    for part in Shard(whole["conv_id"].to_numpy(), whole["seq"].to_pylist(), sizes, left, right).tables():
        held.append(part)
        if sum(t.num_rows for t in held) >= 8192:
            yield from pa.concat_tables(held).combine_chunks().to_batches(16384)
            held = []
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches(16384)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many turns the last row of a shard shares with the first row of the next."""
    for batch in batches:
        shared = []
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if a is None or b is None:
                shared.append(-1)
                continue
            n = min(len(a), len(b)) // WIDTH
            x, y = (np.frombuffer(v[: n * WIDTH], np.uint64).reshape(-1, 2) for v in (a, b))
            differ = np.flatnonzero((x != y).any(1))
            shared.append(int(differ[0]) if len(differ) else n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.int64())], names=["number", "shared"])


def sharded(convs: DataFrame) -> DataFrame:
    """The rows of `convs` (conv_id, seq, sizes) in shards by range, with the shard's
    part and what its edges share with its neighbours (left, right)."""
    spark = convs.sparkSession
    convs = cut(convs)
    size = convs.agg(F.sum(F.octet_length("seq")).alias("n")).first().n or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (WIDTH * TURNS) + 1)
    dealt = cut(convs.repartitionByRange(n, "seq", "conv_id").withColumn("part", F.spark_partition_id()))
    edge = F.struct("seq", "conv_id")
    edges = dealt.groupBy("part").agg(F.min(edge)["seq"].alias("head"), F.max(edge)["seq"].alias("tail"))
    # One small row per shard numbers them without gaps.
    numbers = dealt.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("number"))
    edges = cut(edges.join(numbers, "part"))
    after = edges.select((F.col("number") - 1).alias("number"), F.col("head").alias("next"))
    shared = cut(
        edges.join(after, "number", "left").select("number", "tail", "next").mapInArrow(_common, "number int, shared long")
    )
    before = shared.select((F.col("number") + 1).alias("number"), F.col("shared").alias("left"))
    around = (
        edges.select("part", "number")
        .join(before, "number", "left")
        .join(shared.withColumnRenamed("shared", "right"), "number")
        .select("part", F.coalesce("left", F.lit(-1)).alias("left"), "right")
    )
    return dealt.join(cut(around), "part")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each key, which arrive in order; one piece is held."""
    key, running, done = None, None, []
    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        if done:
            yield _pairs(done)
            done = []
    if key is not None:
        yield _pairs([(key, running.hexdigest())])


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, values = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], names=["key", "digest"])


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie over `convs` (conv_id, seq, sizes): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 as the
    contract of op11 defines them, and turn_key, the name of the node's last turn.

    Conversations without turns are members of the root alone; copies share all nodes; an
    empty table has no node. conv_ids are distinct.
    """
    nodes = cut(sharded(convs).groupBy("part").applyInArrow(_shard_nodes, NODES))
    shares = nodes.where("key is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = shares.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.first("turn_key").alias("turn_key"),
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *sums,
    )
    # Shards follow each other by conv_id where a sequence's copies fill several.
    at = F.split_part("ends", F.lit(","), F.lit(1)).cast("long")
    pieces = shares.where("ends is not null").select("key", at.alias("at"), "ends")
    ordered = pieces.repartition("key").sortWithinPartitions("key", "at").select("key", "ends")
    digests = ordered.mapInArrow(_digests, "key binary, digest string")
    whole = cut(
        whole.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(NO_ENDS))).drop("digest")
    )
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("open_parent"))
    rest = nodes.where("key is null").drop("key", "ends").unionByName(
        whole.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long"))
    )
    named = rest.where("parent_key is not null").join(parents, "parent_key", "left")
    columns = [*COLUMNS, "turn_key"]
    return (
        rest.where("parent_key is null")
        .select(columns)
        .unionByName(named.withColumn("parent_conv_id", F.col("open_parent")).select(columns))
    )


SQL = """
WITH turn_rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'txt': txt} ORDER BY turn NULLS FIRST, role, txt) AS turns
  FROM turn_rows GROUP BY conv_id),
crc AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
    lambda x, y: list_reduce(
      list_prepend(xor(x, y), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda a, b: xor(a >> 1, (a & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 9 AS h
  FROM own),
made AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
paths AS (
  SELECT conv_id, turns, d.depth AS depth, turns[1:d.depth] AS path
  FROM made, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS depth) d),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(strlen(any_value(path)[depth].txt), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
  FROM paths GROUP BY path, depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]),
lines AS (
  SELECT path[1:a.depth] AS top, a.depth AS depth, saved, n_children
  FROM linked, LATERAL (SELECT unnest(range(0, linked.depth + 1)) AS depth) a),
below AS (
  SELECT top, depth, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM lines GROUP BY top, depth)
SELECT n.conv_id, n.depth::BIGINT AS depth, n.parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM linked n JOIN below b ON b.top = n.path AND b.depth = n.depth
"""


@query("op11_prefix_trie", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, folder, "conversations"))).select(COLUMNS)
