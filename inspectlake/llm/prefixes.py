"""Conversation prefix trie: every shared beginning of conversations, without a stack.

The turns of a conversation become a path of digests (16 bytes of SHA-256 of role and
text).  Distinct paths are sorted over the whole table; ``lcp`` of a path is the number
of turns it shares with the path before it.  The paths that share the first d turns of
path i form an interval around i, whose ends are found independently of each other by
binary searches in a sparse table of range minima of lcp.  A node of the trie is the
depth d and the interval's first path.

Rows are dealt into at most about ``MOST_BLOCKS`` blocks of the sorted order, which grow
with the table, so the range minima over whole blocks (two numbers a block) have a proven
bound and are in every task.  A search that leaves its block goes on in the table over
blocks.  A node that goes on into later blocks is *open*: each of these blocks adds its
part of it, and the parts are summed by node.  Open nodes are those on the borders of
blocks, so they are few.

Defined cases: rows with a null conversation id take no part; a null role or text is empty;
turns come in order, null first, those of one turn number by role and digest, and repeated
rows are repeated turns; an empty table has no nodes, not even a root; other columns are
not read.  Texts are compared whole, by their digests.  The digests of one conversation
are one row, which bounds its turns (2 GB, some hundred million turns).
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

#: Greatest number of blocks (besides one for each partition of the sort) and their least rows.
MOST_BLOCKS = 65_536
LEAST_ROWS = 256
#: Conversation ids that are joined to one piece of text before their digest is made.
IDS_PER_PIECE = 2_000

WORDS = r"[^\x20\x09-\x0D]+"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def paths_of(turns, conv="conv_id", turn="turn", role="role", text="text"):
    """(conv_id, turns): the (digest in hex, words) of the turns of every conversation in order."""
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    digest = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)
    one = F.struct("turn", "role", digest.alias("digest"), F.regexp_count("text", F.lit(WORDS)).alias("words"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_borrowed_heads(conversations, every=20, most=4):
    """Conversations whose first h turns are those of the one whose id is the last multiple of ``every``.

    h is the CRC-32 of the id in decimal, modulo ``most``; own turns follow after the first h.
    """
    own = conversations.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every)
    heads = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    none = F.slice("turns", 1, 0)
    rows = own.join(heads, "_base", "left").withColumn("_h", h)
    borrowed = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h"))
    return rows.select("conv_id", F.concat(borrowed, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _in_pieces(conversations):
    """(path, first_id, copies, ids, words): runs of equal paths in sorted order, ids joined."""
    rows = conversations.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), "conv_id", F.transform("turns", lambda t: t["words"]).alias("words")
    )

    def work(batches):
        path, ids, words = None, [], None

        def piece():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in ((path, pa.binary()), (ids[0], pa.int64()), (len(ids), pa.int64()), (",".join(map(str, ids)), pa.string()), (words, pa.list_(pa.int32())))],
                names=["path", "first_id", "copies", "ids", "words"],
            )

        for batch in batches:
            done = []
            for p, i, w in zip(*(c.to_pylist() for c in batch.columns)):
                if p != path or len(ids) == IDS_PER_PIECE:
                    if ids:
                        done.append(piece())
                    path, ids, words = p, [], w
                ids.append(i)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if ids:
            yield piece()

    # Ids in the sort key deal a path of very many conversations over tasks.
    return rows.orderBy("path", "conv_id").mapInArrow(work, "path binary, first_id bigint, copies bigint, ids string, words array<int>")


def distinct_paths(conversations):
    """(path, conv_id, copies, ends, words) of each distinct path: its least id, its number of ids and their digest."""

    def work(batches):
        path, row, state = None, None, None
        schema = pa.schema([("path", pa.binary()), ("conv_id", pa.int64()), ("copies", pa.int64()), ("ends", pa.string()), ("words", pa.list_(pa.int32()))])
        for batch in batches:
            done = []
            for p, first, n, ids, words in zip(*(c.to_pylist() for c in batch.columns)):
                if p != path:
                    if row:
                        done.append(row | {"ends": state.hexdigest()})
                    path, state, row = p, hashlib.sha256(ids.encode()), {"path": p, "conv_id": first, "copies": n, "words": words}
                else:
                    state.update(b"," + ids.encode())
                    row["copies"] += n
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if row:
            yield pa.RecordBatch.from_pylist([row | {"ends": state.hexdigest()}], schema)

    pieces = _in_pieces(conversations).repartition("path").sortWithinPartitions("path", "first_id")
    return pieces.mapInArrow(work, "path binary, conv_id bigint, copies bigint, ends string, words array<int>")


def _shared_turns(one, other):
    n = min(len(one), len(other)) // 16
    a, b = (np.frombuffer(x, np.uint64, 2 * n).reshape(n, 2) for x in (one, other))
    differ = (a != b).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def _sorted_rows(paths):
    """The distinct paths in order: (part, place) in the sort, lcp within the part (-1 at its start), the words after it.

    Only the first and last row of a part keep their path.
    """
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("lcp", pa.int64()), ("length", pa.int64()), ("copies", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string()), ("words", pa.list_(pa.int32())), ("path", pa.binary())])

    def work(batches):
        part, place, last, held = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            done = []
            for path, i, n, ends, words in zip(*(c.to_pylist() for c in batch.columns)):
                if held:
                    done.append(held | ({} if held["place"] == 0 else {"path": None}))
                lcp = -1 if last is None else _shared_turns(last, path)
                held = {"part": part, "place": place, "lcp": lcp, "length": len(path) // 16, "copies": n, "conv_id": i, "ends": ends, "words": words[max(0, lcp) :], "path": path}
                place, last = place + 1, path
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([held], schema)

    kinds = "part int, place bigint, lcp bigint, length bigint, copies bigint, conv_id bigint, ends string, words array<int>, path binary"
    return paths.select("path", "conv_id", "copies", "ends", "words").orderBy("path").mapInArrow(work, kinds)


def _in_blocks(rows, least_rows):
    """The rows with their block and their lcp across parts; None without rows.

    The driver sees two paths and a count of each part of the sort.
    """
    parts = {}
    for r in rows.where("path is not null").select("part", "place", "path").orderBy("part", "place").collect():
        first, _, _ = parts.get(r.part, (bytes(r.path), None, None))
        parts[r.part] = (first, bytes(r.path), r.place + 1)
    if not parts:
        return None
    size = max(least_rows, -(-sum(n for _, _, n in parts.values()) // MOST_BLOCKS))
    at, last, found = 0, None, []
    for part, (first, end, n) in sorted(parts.items()):
        found.append((part, at, -1 if last is None else _shared_turns(last, first)))
        at, last = at + -(-n // size), end
    starts = rows.sparkSession.createDataFrame(found, "part int, _first long, _lcp long")
    start = F.col("place") == 0
    lcp = F.when(start, F.col("_lcp")).otherwise(F.col("lcp"))
    # One row for each partition of the sort.
    return rows.drop("path").join(F.broadcast(starts), "part").select(
        (F.col("_first") + F.floor(F.col("place") / size)).alias("block"),
        (F.col("place") % size).cast("int").alias("row"),
        lcp.alias("lcp"),
        "length",
        "copies",
        "conv_id",
        "ends",
        F.when(start & (F.col("_lcp") > 0), F.slice("words", F.col("_lcp").cast("int") + 1, F.greatest(F.size("words"), F.lit(1)))).otherwise(F.col("words")).alias("words"),
    )


def sparse_table(values):
    """Row k: minima of the 2^k values from each place on."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def right_end(table, at, depth):
    """The last place from ``at`` on up to which all values after ``at`` are at least ``depth``."""
    at, n = at.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        ahead = at + (1 << k) < n
        go = ahead & (table[k][np.where(ahead, at + 1, 0)] >= depth)
        at += go << k
    return at


def left_end(table, at, depth):
    """The first place before which a value below ``depth`` stands, going left from ``at``."""
    at = at.copy()
    for k in range(len(table) - 1, -1, -1):
        room = at - (1 << k) >= 0
        go = room & (table[k][np.where(room, at - (1 << k) + 1, 0)] >= depth)
        at -= go << k
    return at


def range_least(table, a, b):
    """The least value of places a to b, both included."""
    k = np.frexp((b - a + 1).astype(float))[1] - 1
    out = np.empty(len(a), dtype=table[0].dtype)
    for level in np.unique(k):
        own = k == level
        out[own] = np.minimum(table[level][a[own]], table[level][b[own] - (1 << level) + 1])
    return out


class Borders:
    """Range minima over whole blocks: ``first`` is the lcp of a block's first row, ``inner`` the least of the others."""

    def __init__(self, first, inner):
        self.first = np.append(first, -1)
        self.table = sparse_table(np.minimum(first, inner))

    def start(self, block, depth):
        """The block in which the node of that depth at the start of ``block`` begins."""
        at = np.asarray(block).copy()
        for k in range(len(self.table) - 1, -1, -1):
            room = at - (1 << k) >= 0
            go = room & (self.table[k][np.where(room, at - (1 << k), 0)] >= depth)
            at -= go << k
        return at - 1

    def end(self, block, depth):
        """The first block after ``block`` in which the open node of that depth ends."""
        return right_end(self.table, np.asarray(block), depth) + 1


_PART = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("n_children", pa.int64()), ("words", pa.int64()), ("ends", pa.string()), ("parent_block", pa.int64()), ("parent_conv_id", pa.int64())])
_PART_DDL = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in _PART)
NO_IDS = hashlib.sha256(b"").hexdigest()


def _block_parts(table, borders):
    """Closed nodes, open nodes that begin here, and parts of open nodes of earlier blocks."""
    table = table.sort_by("row")
    block = table.column("block")[0].as_py()
    lcp, length, copies, ids = (table.column(c).to_numpy() for c in ("lcp", "length", "copies", "conv_id"))
    ends = np.array(table.column("ends").to_pylist(), dtype=object)
    n = len(lcp)
    after = int(borders.first[block + 1])
    minima, least = sparse_table(lcp), sparse_table(ids)
    # A candidate is a depth at which row i is the first of its node.
    per_row = length - lcp
    offset = np.concatenate(([0], np.cumsum(per_row)))
    row = np.repeat(np.arange(n), per_row)
    depth = lcp[row] + 1 + np.arange(len(row)) - offset[row]
    words = np.array([w for ws in table.column("words").to_pylist() for w in ws], dtype=np.int64)
    if lcp[0] < 0:
        words = np.concatenate(([0], words))  # the root has no text
    right = right_end(minima, row, depth)
    is_open = (right == n - 1) & (after >= depth)
    sums = np.concatenate(([0], np.cumsum(copies)))
    n_convs = sums[right + 1] - sums[row]
    leaf = np.append(lcp[1:], after) < length
    leaves = np.concatenate(([0], np.cumsum(leaf)))
    term = np.where(is_open, 0, (n_convs - 1) * words)
    terms = np.concatenate(([0], np.cumsum(term)))
    # Candidates are in the order of rows and depths, so a subtree is a stretch of them.
    saved = terms[offset[right + 1]] - terms[np.arange(len(row))]
    least_id = range_least(least, row, right)
    # The parent holds row i too; both its ends are searched from there.
    up = depth - 1
    p_left, p_right = left_end(minima, row, up), right_end(minima, row, up)
    root = depth == 0
    p_before = ~root & (p_left == 0) & (lcp[0] >= up)
    p_open = ~root & ~p_before & (p_right == n - 1) & (after >= up)
    p_here = ~root & ~p_before & ~p_open
    parent = np.where(p_here, offset[p_left] + up - lcp[p_left] - 1, 0)
    n_children = np.bincount(parent[p_here], minlength=len(row))
    parent_block = np.where(p_open, block, -1)
    parent_block[p_before] = borders.start(np.full(int(p_before.sum()), block), up[p_before])
    last = np.where(depth == length[row], ends[row], NO_IDS)
    nodes = pa.table(
        [
            pa.array(np.where(is_open, "open", "node"), pa.string()), pa.array(np.full(len(row), block)), pa.array(depth), pa.array(n_convs), pa.array(least_id),
            pa.array(leaves[right + 1] - leaves[row]), pa.array(saved), pa.array(n_children), pa.array(words), pa.array(last, pa.string()),
            pa.array(parent_block, pa.int64(), mask=parent_block < 0), pa.array(least_id[parent], pa.int64(), mask=~p_here),
        ],
        schema=_PART,
    )
    # Parts of nodes that begin in earlier blocks.
    d = np.arange(0, lcp[0] + 1)
    to = right_end(minima, np.zeros(len(d), np.int64), d)
    owner = borders.start(np.full(len(d), block), d)
    # Children here of open nodes, by block and depth of the parent.
    key, count = np.unique(np.stack([parent_block, up])[:, parent_block >= 0], axis=1, return_counts=True)
    more = [
        (owner, d, sums[to + 1], range_least(least, np.zeros(len(d), np.int64), to) if len(d) else d, leaves[to + 1], terms[offset[to + 1]], np.zeros(len(d), np.int64)),
        (key[0], key[1], *[np.zeros(len(count), np.int64)] * 1, None, *[np.zeros(len(count), np.int64)] * 2, count),
    ]
    tables = [nodes]
    for where, deep, convs, low, leafs, save, children in more:
        none = pa.nulls(len(deep), pa.int64())
        tables.append(
            pa.table(
                [
                    pa.array(["part"] * len(deep), pa.string()), pa.array(where, pa.int64()), pa.array(deep, pa.int64()), pa.array(convs, pa.int64()),
                    none if low is None else pa.array(low, pa.int64()), pa.array(leafs, pa.int64()), pa.array(save, pa.int64()), pa.array(children, pa.int64()),
                    none, pa.nulls(len(deep), pa.string()), none, none,
                ],
                schema=_PART,
            )
        )
    return pa.concat_tables(tables)


def trie(conversations, save, least_rows=LEAST_ROWS):
    """One row for each distinct beginning of the conversations (``paths_of``).

    conv_id and parent_conv_id: least ids of the node and its parent (null for the root);
    n_convs: conversations that begin so; n_children; n_leaves and saved_tokens: leaves of
    its subtree, and words that need not be stored again in it; ends_sha256: digest of the
    ids of the conversations that end there, in order.
    """
    spark = conversations.sparkSession
    sorted_rows = save(_sorted_rows(save(distinct_paths(conversations))))
    rows = _in_blocks(sorted_rows, least_rows)
    if rows is None:
        names = ", ".join(f"{c} bigint" for c in NODE)
        return spark.createDataFrame([], f"{names}, ends_sha256 string")
    least = F.min(F.when(F.col("row") > 0, F.col("lcp")))
    # At most about MOST_BLOCKS rows of two numbers.
    summary = rows.groupBy("block").agg(F.max(F.when(F.col("row") == 0, F.col("lcp"))).alias("first"), F.coalesce(least, F.lit(1 << 60)).alias("inner")).toArrow().sort_by("block")
    borders = spark.sparkContext.broadcast(Borders(summary.column("first").to_numpy(), summary.column("inner").to_numpy()))

    def in_block(table):
        return _block_parts(table, borders.value)

    parts = save(rows.groupBy("block").applyInArrow(in_block, _PART_DDL))
    opened = parts.where("kind <> 'node'").groupBy("block", "depth").agg(
        *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens", "n_children")],
        *[F.min(c).alias(c) for c in ("conv_id", "words", "ends", "parent_block")],
    )
    opened = save(opened.withColumn("term", (F.col("n_convs") - 1) * F.col("words")))
    of_block = opened.groupBy("block").agg(F.sum("term").alias("term")).toArrow()
    terms = np.zeros(summary.num_rows + 1, np.int64)
    terms[of_block.column("block").to_numpy() + 1] = of_block.column("term").to_numpy()
    shared = spark.sparkContext.broadcast(np.cumsum(terms))

    def between(batches):
        """Terms of open nodes that begin in later blocks, up to the end of each node."""
        for batch in batches:
            block, depth = (batch.column(k).to_numpy() for k in (0, 1))
            sums = shared.value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums[borders.value.end(block, depth)] - sums[block + 1])], names=["block", "depth", "later"])

    later = opened.select("block", "depth").mapInArrow(between, "block bigint, depth bigint, later bigint")
    window = "sum(term) over (partition by block order by depth desc rows between unbounded preceding and current row)"
    opened = save(opened.withColumn("below", F.expr(window)).join(later, ["block", "depth"]).withColumn("saved_tokens", F.col("saved_tokens") + F.col("below") + F.col("later")))
    parents = opened.select(F.col("block").alias("parent_block"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent"))
    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "parent_block"]
    nodes = parts.where("kind = 'node'").select(*names, "parent_conv_id")
    nodes = nodes.unionByName(opened.select(*names, F.lit(None).cast("long").alias("parent_conv_id")))
    nodes = nodes.join(parents, ["parent_block", "depth"], "left")
    return nodes.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")
    )
