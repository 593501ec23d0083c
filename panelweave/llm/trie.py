"""Operator 12: prefix trie of conversations, in double arrays per prefix shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import discard, stage, staged

#: Bytes of a turn's digest: the first half of its SHA-256. Turns are compared by it.
WIDE = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """Half of the SHA-256 of a turn, the role's length before both so that no two turns spell alike."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, WIDE)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): each conversation's turns in order, as one binary of their digests, and their texts' code points.

    Turns without a number come first; turns of one number, and repeated rows, all count, in order of their digests. Null roles and texts
    are empty; rows without a conv_id are left out. A task holds 20 bytes a turn of one conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    at = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), turn_digest(role, text).alias("d"), F.length(text).alias("n"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), at.alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    joined = F.unhex(F.array_join(F.transform("ts", lambda t: F.hex(t["d"])), ""))  # as hex: a long conversation is copied once, not once a turn
    return turns.select("conv_id", joined.alias("seq"), F.col("ts.n").alias("sizes"))


def with_shared_heads(turns: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """The first `head` turns of each conversation replaced by those of conversation `base` (all, if it has fewer; none, if it is absent). head is at most `most`."""
    own = F.struct(F.substring("seq", 1, most * WIDE).alias("seq"), F.slice("sizes", 1, most).alias("sizes"))
    rows = turns.select("conv_id", "seq", "sizes", base.alias("base"), head.cast("int").alias("h"))
    both = rows.withColumn("theirs", F.max(F.when(F.col("conv_id") == F.col("base"), own)).over(Window.partitionBy("base")))
    seq = F.concat(F.coalesce(F.expr(f"substring(theirs.seq, 1, h * {WIDE})"), F.unhex(F.lit(""))), F.expr(f"substring(seq, h * {WIDE} + 1)"))
    none = F.array().cast("array<int>")
    sizes = F.concat(F.coalesce(F.expr("slice(theirs.sizes, 1, h)"), none), F.when(F.size("sizes") > F.col("h"), F.expr("slice(sizes, h + 1, size(sizes))")).otherwise(none))
    return both.select("conv_id", seq.alias("seq"), sizes.alias("sizes"))


def members_of(keyed: DataFrame, parts: int) -> DataFrame:
    """(key, rep, n, ends): each key's least id, how many rows have it, and the SHA-256 of their ids in order, comma-joined.

    Rows (key, conv_id) are ordered by key and id over all tasks; each task joins a batch's ids of a key into one piece, and the
    pieces of a key run through the hash one after another, as SHA-256 demands: a key of any size is never gathered.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            out: list[tuple[bytes, int, int, str]] = []
            a = 0
            for b in range(1, len(key) + 1):
                if b == len(key) or key[b] != key[a]:
                    out.append((key[a], ids[a], b - a, ",".join(map(str, ids[a:b]))))
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "first", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rep, n, h = None, 0, 0, None
        for batch in batches:
            out: list[tuple[bytes, int, int, str]] = []
            for k, first, some, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "n", "ids")), strict=True):
                if k == key:
                    h.update(b",")
                    n += some
                else:
                    if h is not None:
                        out.append((key, rep, n, h.hexdigest()))
                    key, rep, n, h = k, first, some, hashlib.sha256()
                h.update(ids.encode())
            yield _members(out)
        if h is not None:
            yield _members([(key, rep, n, h.hexdigest())])

    pieces = keyed.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, n long, ids string")
    dealt = pieces.repartition(parts, "key").sortWithinPartitions("key", "first")
    return dealt.mapInArrow(digest, "key binary, rep long, n long, ends string")


def _members(rows: list[tuple[bytes, int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "rep", "n", "ends"])


class DoubleArray:
    """A trie in two arrays: the child of node s by code c is t = base[s] + c if check[t] == s. Node 0 is the root.

    Built from distinct sequences of codes in lexicographic order, given as one flat array with each sequence's start, level by level. Codes
    are numbered so that siblings lie close together. A node's children are put into the first free places that take all of them;
    after `tries` of those, behind all places in use.
    """

    def __init__(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, tries: int = 32) -> None:
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.end = self.free = 1  # places from `end` on are free; before `free` none is
        at = np.zeros(len(start), np.int64)  # the node each sequence has come to
        depth, live = 0, np.flatnonzero(length > 0)
        while len(live):
            c, node = codes[start[live] + depth], at[live]
            new = np.r_[True, (node[1:] != node[:-1]) | (c[1:] != c[:-1])]  # in order, so equal children lie side by side
            parent, code = node[new], c[new]
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(parent)], strict=True):
                self._place(int(parent[a]), code[a:b], tries)
            at[live] = self.base[node] + c
            depth += 1
            live = live[length[live] > depth]
        self.base, self.check = self.base[: self.end], self.check[: self.end]

    def _place(self, node: int, codes: np.ndarray, tries: int) -> None:
        low = int(codes.min())
        offset = codes - low
        span = int(offset.max()) + 1
        while self.end + 2 * span + 2 > len(self.check):
            self.base, self.check = np.r_[self.base, np.zeros_like(self.base)], np.r_[self.check, np.full_like(self.check, -1)]
        t = self.free
        for _ in range(tries):
            while t < self.end and self.check[t] >= 0:
                t += 1
            if t >= self.end or (self.check[t + offset] < 0).all():
                break
            t += 1
        else:
            t = self.end
        t = min(t, self.end)
        self.base[node] = t - low
        self.check[t + offset] = node
        self.end = max(self.end, t + span)
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """The places in use but for the root, and their parents."""
        t = np.flatnonzero(self.check[1:] >= 0) + 1
        return t, self.check[t]

    def walk(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each depth from 0 on, the sequences that reach it and the nodes they reach, by way of base and check."""
        node, live, depth = np.zeros(len(start), np.int64), np.arange(len(start)), 0
        while len(live):
            yield live, node[live]
            live = live[length[live] > depth]
            t = self.base[node[live]] + codes[start[live] + depth]
            if (self.check[t] != node[live]).any():
                raise ValueError("a sequence leaves the trie")
            node[live] = t
            depth += 1


NODES = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, size long, n_children long, n_leaves long, saved long, ends string"


def shard_nodes(seqs: list[bytes], sizes: list[np.ndarray], rep: np.ndarray, n: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """The nodes of one shard: distinct sequences that lie side by side in lexicographic order.

    Nodes on the path of the shard's first or last sequence may be other shards' too: they carry a key, the digest of their
    sequence, and count children, leaves and savings only as far as those have no key. All other nodes are whole.
    """
    length = np.array([len(s) // WIDE for s in seqs], np.int64)
    start = np.r_[0, np.cumsum(length)[:-1]]
    digests = np.frombuffer(b"".join(seqs), np.dtype((np.void, WIDE)))
    _, place, codes = np.unique(digests, return_index=True, return_inverse=True)
    codes = np.argsort(np.argsort(place))[codes].astype(np.int64) + 1  # dense turn ids in order of first sight: siblings lie close
    text = np.concatenate(sizes).astype(np.int64) if len(digests) else np.zeros(0, np.int64)
    trie = DoubleArray(codes, start, length)
    count = len(trie.check)
    convs, least, depth, size = np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64), np.zeros(count, np.int64)
    end_of, shared = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
    for d, (live, node) in enumerate(trie.walk(codes, start, length)):
        np.add.at(convs, node, n[live])
        np.minimum.at(least, node, rep[live])
        depth[node] = d
        if d:
            size[node] = text[start[live] + d - 1]
        done = length[live] == d
        end_of[node[done]] = live[done]
        for edge in {0, len(seqs) - 1}:
            shared[node[live == edge]] = edge
    place, parent = trie.nodes()
    used = np.r_[0, place]
    children, leaves, saved = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    np.add.at(children, parent, shared[place] < 0)
    own = shared < 0
    leaves[used] = (own & (children == 0))[used]
    saved[used] = np.where(own, (convs - 1) * size, 0)[used]
    above = np.zeros(count, np.int64)
    above[place] = parent
    by_depth = used[np.argsort(depth[used], kind="stable")]
    cut = np.r_[0, np.cumsum(np.bincount(depth[used]))]
    for d in range(int(depth.max()), 0, -1):  # from the deepest nodes up
        at = by_depth[cut[d] : cut[d + 1]]
        at = at[own[at]]
        np.add.at(leaves, above[at], leaves[at])
        np.add.at(saved, above[at], saved[at])
    keys: dict[int, bytes] = {}
    for edge in {0, len(seqs) - 1}:
        h, node = hashlib.sha256(), 0
        keys[0] = h.digest()[:WIDE]
        for k in range(length[edge]):
            h.update(seqs[edge][k * WIDE : (k + 1) * WIDE])
            node = int(trie.base[node] + codes[start[edge] + k])
            keys[node] = h.copy().digest()[:WIDE]
    key = [keys.get(s) for s in used.tolist()]
    up = [None if s == 0 else keys.get(p) for s, p in zip(used.tolist(), above[used].tolist(), strict=True)]
    inner = pa.array(least[above[used]], pa.int64(), mask=np.array([u is not None or s == 0 for u, s in zip(up, used.tolist(), strict=True)]))
    ends_at = [ends[e] if e >= 0 else None for e in end_of[used].tolist()]
    columns = [pa.array(key, pa.binary()), pa.array(up, pa.binary()), pa.array(least[used]), pa.array(depth[used]), inner, pa.array(convs[used]), pa.array(size[used]), pa.array(children[used]), pa.array(leaves[used]), pa.array(saved[used]), pa.array(ends_at, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in NODES.split(", ")])


def _merge_shared(edges: DataFrame) -> DataFrame:
    """Shared nodes of all shards, one row each and whole: counts summed, subtrees' leaves and savings summed over all shared nodes below.

    Each step adds what lies twice as far below as the one before (a node's sum within a distance, plus the same of those at that distance),
    so the steps grow with the logarithm of the depth.
    """
    merged = edges.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.first("size").alias("size"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"),
    )
    merged = stage(merged, "shared")
    below = merged.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    whole = merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = whole.select("key", F.col("parent_key").alias("up"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("l"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("s"))
    cur, reach, deepest = stage(own, "sums"), 1, merged.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        mark = staged() - 1
        add = cur.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("l").alias("al"), F.sum("s").alias("as"))
        over = cur.select(F.col("key").alias("up"), F.col("up").alias("next"))
        step = cur.join(add, "key", "left").join(over, "up", "left")
        cur = stage(step.select("key", F.col("next").alias("up"), (F.col("l") + F.coalesce("al", F.lit(0))).alias("l"), (F.col("s") + F.coalesce("as", F.lit(0))).alias("s")), "sums")
        discard(edges.sparkSession, mark, keep=1)
        reach *= 2
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    sums = whole.drop("n_leaves", "saved").join(cur.select("key", F.col("l").alias("n_leaves"), F.col("s").alias("saved")), "key")
    return sums.join(parents, "parent_key", "left")


def prefix_trie(conversations: DataFrame, *, head: Column | None = None, base: Column | None = None, most_head: int = 5, shard_rows: int = 100_000, most_broadcast: int = 100_000) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the nodes of all conversations' prefix trie.

    conversations: (conv_id, turn, role, text). A conversation is its turns in order; with `head` and `base` (columns of conv_id) its
    first turns come from another. A node of depth d is a distinct sequence of first d turns; the root has none. conv_id is the least id of a
    node's members, those that start with its sequence. saved_tokens sums, over a node's subtree, members but one times the code points of
    the last turn's text. ends_sha256 hashes the ids of the conversations that end there. An empty table has no nodes; rows without a
    conv_id are left out; what else counts is said by `turn_sequences`. Other columns, whatever their names, are left out.

    Equal conversations become one sequence with a count first. The sequences are dealt to shards by ranges in lexicographic order,
    so a prefix of any number of conversations is spread over as many shards as it needs; each shard packs its trie into BASE and CHECK
    arrays over dense turn ids, and only nodes on its first and last path may be shared and are merged over all shards.
    """
    spark, mark = conversations.sparkSession, staged()
    turns = turn_sequences(conversations)
    if head is not None:
        turns = with_shared_heads(turns, head, base, most_head)
    convs = stage(turns.withColumn("key", F.substring(F.unhex(F.sha2("seq", 256)), 1, WIDE)), "convs")
    total = convs.count()
    members = stage(members_of(convs, max(8, total // 500_000)), "members")
    unique = convs.select(F.col("conv_id").alias("rep"), "key", "seq", "sizes").join(members, ["key", "rep"]).drop("key")
    parts = max(8, members.count() // shard_rows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            sizes = [np.asarray(x, np.int64) for x in table.column("sizes").to_pylist()]
            nodes = shard_nodes(table.column("seq").to_pylist(), sizes, table.column("rep").to_numpy(), table.column("n").to_numpy(), table.column("ends").to_pylist())
            for a in range(0, nodes.num_rows, 20_000):
                yield nodes.slice(a, 20_000)

    nodes = stage(unique.repartitionByRange(parts, "seq").sortWithinPartitions("seq").mapInArrow(build, NODES), "nodes")
    shared = stage(_merge_shared(nodes.filter("key is not null")), "merged")
    inner = nodes.filter("key is null").drop("key", "size")
    names = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    if shared.count() <= most_broadcast:
        inner = inner.join(F.broadcast(names), "parent_key", "left")
    else:  # a node's many children are dealt over salts
        salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        inner = inner.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(32)).cast("int")).join(salted, ["parent_key", "salt"], "left").drop("salt")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    whole = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns).unionByName(shared.select(*columns))
    out = whole.select(*columns[:6], F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    out = stage(out, "trie")
    discard(spark, mark, keep=1)
    return out
