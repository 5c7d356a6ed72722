"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles.  Equal sets form a class; classes are joined:

* A class is embedded as ``COORDINATES`` minima of its shingles, so two classes agree in
  a coordinate with probability equal to their similarity.
* In every run a set is split recursively: a bucket picks two coordinates, and the sets
  go on to the buckets of their values there.  Small buckets, and those that no longer
  shrink, are compared pair by pair on the embeddings; the runs repeat until a pair at
  the threshold is met with probability ``recall``.
* Pairs that look similar connect classes to candidate clusters; within a cluster all
  pairs are checked exactly on their shingles, so a link missed by all runs is still
  found if its ends are in one cluster.

A bucket or cluster too large for one task is dealt over pairs of blocks, each pair of
members in exactly one, so nothing is capped and no pair is emitted: tasks return links
counted per member, and one edge per member to the least of its component.

Defined cases: a null text is an empty one; a text with fewer words than a shingle has
one shingle of all its words; texts without words form one class without links; rows
that share an id are one document (of different texts the one with the least key
counts); null ids take no part; empty tables give an empty result; other columns are
not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inspectlake.llm.arrays import mixed, portions, shingle_sets
from inspectlake.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
#: Coordinates that a bucket splits on, members compared in one task, levels of splitting.
BRANCHES = 2
BUCKET = 1024
LEVELS = 5
#: Shingles and members of a block of a cluster.
BLOCK_SHINGLES = 400_000
BLOCK_MEMBERS = 512

_ODD = (mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_SHIFT = mixed(np.arange(101, COORDINATES + 101, dtype=np.uint64)).astype(np.uint32)


def embedding(shingles):
    """The minimum of each of ``COORDINATES`` scramblings of the shingles."""
    low = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, ((x[at : at + 2048, None] * _ODD) ^ _SHIFT).min(axis=0), out=low)
    return low


def set_key(shingles):
    """Two 64-bit numbers that stand for the whole set."""
    with np.errstate(over="ignore"):
        return int(np.add.reduce(mixed(shingles)).view(np.int64)), int(np.bitwise_xor.reduce(shingles).view(np.int64))


def signatures(docs, key="doc_id", text="text", width=SHINGLE):
    """(doc_id, c1, c2, n, sketch) of every row."""

    def work(batches):
        for batch in batches:
            rows = []
            for part in portions(batch.column(1)):
                for s in shingle_sets(part, width):
                    rows.append((*(set_key(s) if len(s) else (0, 0)), len(s), embedding(s).view(np.int32)))
            c1, c2, n, sketch = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()), pa.array(list(sketch), pa.list_(pa.int32()))],
                names=["doc_id", "c1", "c2", "n", "sketch"],
            )

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text)
    return rows.mapInArrow(work, "doc_id bigint, c1 bigint, c2 bigint, n bigint, sketch array<int>")


def runs_for(recall=0.9999, similarity=SIMILARITY, branches=BRANCHES):
    """Runs after which a pair at the threshold was in a common leaf with probability ``recall``.

    A pair lives on in a child with probability ``similarity``; the chance that some
    path lives through any number of levels is the fixed point of s = 1 - (1 - similarity * s) ** branches.
    """
    alive = 1.0
    for _ in range(200):
        alive = 1 - (1 - similarity * alive) ** branches
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _children(rows, level):
    """(path, class_id, parent_n): every member's two buckets of the next level."""
    first = F.pmod(F.xxhash64("path", F.lit(level)), F.lit(COORDINATES)).cast("int")
    step = 1 + F.pmod(F.xxhash64("path", F.lit(-level)), F.lit(COORDINATES - 1)).cast("int")
    paths = [F.xxhash64("path", at, F.get("sketch", at)) for at in (first, F.pmod(first + step, F.lit(COORDINATES)))]
    return rows.select(F.explode(F.array(*paths)).alias("path"), "class_id", F.col("size").alias("parent"))


def _sized(rows):
    """Rows of the buckets with two members or more, with the bucket's size."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, "path")


def leaves(reps, recall, similarity, save):
    """(path, class_id, size): the buckets to compare, over all runs."""
    n = reps.count()
    runs = runs_for(recall, similarity)
    starts = F.explode(F.array(*[F.xxhash64(F.lit(r), F.lit("run")) for r in range(runs)]))
    rows = reps.select("class_id", "sketch", F.lit(n).cast("long").alias("size"), starts.alias("path"))
    found = []
    for level in range(1, LEVELS + 1):
        sized = save(_sized(_children(rows, level)))
        done = (F.col("size") <= BUCKET) | (2 * F.col("size") >= F.col("parent")) | F.lit(level == LEVELS)
        found.append(sized.where(done).select("path", "class_id", "size"))
        wide = sized.where(~done)
        if level == LEVELS or wide.isEmpty():
            break
        rows = wide.select("path", "class_id", "size").join(reps.select("class_id", "sketch"), "class_id")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _block_pairs(rows, group, blocks, member):
    """Each row once for every pair of blocks that its own block is part of: columns bi <= bj, own."""
    own = F.pmod(F.xxhash64(F.lit(5), F.col(member)), F.col(blocks))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return dealt.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")}).drop("other")


def _groups(batches, keys):
    """Tables of the rows that follow each other with equal keys."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1 if batch.num_rows > 1 else []
        edges = [0, *cut, batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == 0 and held and any(held[-1].column(k)[-1].as_py() != table.column(k)[0].as_py() for k in keys):
                yield pa.concat_tables(held)
                held = []
            elif a:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def local_components(near):
    """Component number of each row of a symmetric boolean matrix."""
    label = np.full(len(near), -1)
    for start in range(len(near)):
        if label[start] < 0:
            label[start] = start
            front = np.array([start])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (label < 0))
                label[front] = start
    return label


def _roots(ids, label):
    """The least id of each row's component."""
    _, inverse = np.unique(label, return_inverse=True)
    low = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, inverse, ids)
    return low[inverse]


def _agreement(sketches, least):
    """Which pairs agree in at least ``least`` coordinates."""
    n = len(sketches)
    near = np.zeros((n, n), dtype=bool)
    step = max(1, 4_000_000 // (n * COORDINATES))
    for at in range(0, n, step):
        near[at : at + step] = (sketches[at : at + step, None, :] == sketches[None, :, :]).sum(axis=2) >= least
    np.fill_diagonal(near, False)
    return near


def candidate_edges(found, reps, similarity):
    """(a, b): every class that looks similar to another in a leaf, with the least of its component there."""
    least = COORDINATES * similarity - 4 * math.sqrt(COORDINATES * similarity * (1 - similarity))

    def work(batches):
        a, b = [], []
        for group in _groups(batches, ["path", "bi", "bj"]):
            if group.num_rows < 2:
                continue
            ids = group.column("class_id").to_numpy()
            sketches = group.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(ids), COORDINATES)
            near = _agreement(sketches, least)
            linked = near.any(axis=1)
            if linked.any():
                roots = _roots(ids, local_components(near))
                a += ids[linked].tolist()
                b += roots[linked].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = _block_pairs(found.withColumn("blocks", F.ceil(F.col("size") / BUCKET)), "path", "blocks", "class_id")
    rows = rows.select("path", "bi", "bj", "class_id").join(reps.select("class_id", "sketch"), "class_id")
    dealt = rows.repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj")
    return dealt.mapInArrow(work, "a bigint, b bigint").where("a <> b").distinct()


def _shared_counts(sets):
    """Number of common shingles of every pair."""
    n = len(sets)
    common = np.zeros((n, n), dtype=np.float64)
    if n == 2:
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return common
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    kept = count[place] > 1
    _, place = np.unique(place[kept], return_inverse=True)
    row = row[kept]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    width = max(256, 4_000_000 // n)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [low, low + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[row[a:b], place[a:b] - low] = 1
        common += part @ part.T
    return common


def _checked(similarity, width):
    def work(batches):
        for group in _groups(batches, ["cluster", "bi", "bj"]):
            ids, c1, c2 = (group.column(c).to_numpy() for c in ("class_id", "c1", "c2"))
            own = group.column("own").to_numpy()
            sets, at = [], {}
            k = 0
            for part in portions(group.column("text")):
                for s in shingle_sets(part, width):
                    # A row of the same id with another text, or met before, is not the class.
                    if ids[k] not in at and len(s) and set_key(s) == (c1[k], c2[k]):
                        at[ids[k]] = k
                        sets.append(s)
                    k += 1
            rows = np.array(list(at.values()), dtype=int)
            if len(rows) < 2:
                continue
            ids, own = ids[rows], own[rows]
            size = np.array([len(s) for s in sets], dtype=float)
            common = _shared_counts(sets)
            near = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
            np.fill_diagonal(near, False)
            if group.column("bi")[0].as_py() != group.column("bj")[0].as_py():
                near &= own[:, None] != own[None, :]
            links = near.sum(axis=1)
            linked = links > 0
            if linked.any():
                roots = _roots(ids, local_components(near))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[linked]), pa.array(links[linked].astype(np.int64)), pa.array(roots[linked])], names=["class_id", "links", "root"]
                )

    return work


def jaccard_join(docs, save, key="doc_id", text="text", width=SHINGLE, similarity=SIMILARITY, recall=0.9999):
    """(doc_id, class_id, group_id, n_links, n_copies) of every document.

    ``class_id`` is the least id with the same shingles, ``n_copies`` the number of such
    documents, ``n_links`` the number of other classes whose Jaccard similarity is at
    least ``similarity``, ``group_id`` the least id that links lead to.  ``save`` writes
    a frame to shared storage and reads it back.
    """
    rows = signatures(docs, key, text, width)
    rows = save(rows.groupBy("doc_id").agg(F.min(F.struct("c1", "c2", "n", "sketch")).alias("s")).select("doc_id", "s.*"))
    classes = rows.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    members = save(rows.drop("sketch").join(classes, ["c1", "c2"]))
    reps = save(rows.join(members.where("doc_id = class_id and n > 0").select("doc_id", "class_id"), "doc_id").select("class_id", "c1", "c2", "n", "sketch"))
    edges = candidate_edges(leaves(reps, recall, similarity, save), reps, similarity)
    inside = components(edges, save)
    clusters = inside.select(F.col("node").alias("class_id"), F.col("root").alias("cluster")).unionByName(
        inside.select(F.col("root").alias("class_id"), F.col("root").alias("cluster")).distinct()
    )
    clusters = clusters.join(reps.drop("sketch"), "class_id")
    sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    clusters = save(clusters.join(sizes, "cluster"))
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("class_id"), F.col(text).alias("text"))
    dealt = _block_pairs(clusters, "cluster", "blocks", "class_id").select("cluster", "bi", "bj", "own", "class_id", "c1", "c2")
    # Candidates grow with the documents, so the texts meet them in a merge join at every size.
    dealt = dealt.join(texts.hint("merge"), "class_id").repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj")
    checked = save(dealt.mapInArrow(_checked(similarity, width), "class_id bigint, links bigint, root bigint"))
    linked = checked.groupBy("class_id").agg(F.sum("links").alias("n_links"))
    # A cluster in several blocks has a root per block pair: their edges join up.
    groups = components(checked.select(F.col("class_id").alias("a"), F.col("root").alias("b")), save)
    linked = linked.join(groups.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    out = members.join(linked, "class_id", "left")
    return out.select(
        "doc_id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )
