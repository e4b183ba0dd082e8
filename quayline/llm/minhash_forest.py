"""MinHash near-dedup with an LSH forest.

One MinHash signature per distinct shingle set; each tree of the forest is a sort of the
documents by the signature read from another starting place.  Documents that share the first
``depth`` values form a region of that order; within a region, rows are sorted by the following
values, and every row meets the ``reach`` rows before it, which are those of longest common
prefix.  So the depth adapts: a region of at most ``reach + 1`` rows is compared whole, a denser
one only between neighbours whose prefixes agree far deeper.

What neighbours alone would miss in dense regions is looked for exactly: members of a dense
region that the links so far leave outside its largest component are compared with all members
of the other components in it, in blocks (``_dense_rest``).

All links are confirmed on full shingle sets.  Exact copies (equal sets) are collapsed before
the trees, so a group of any number of copies is one row there.  Each candidate document's set
travels once to the block where its pairs are confirmed.

At the 0.8 threshold and 24 trees of depth 4, a pair of exactly 0.8 shares no region at all with
probability (1 - 0.8**4)**24 = 3e-6, one of 0.85 with 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, mix, shingle_sets, single, slices
from .components import connected_components, contract

DENSE_REACH = 3
BLOCK = 256  # documents of one label that share a confirmation block
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, size=(2, 512), dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray, values: int) -> np.ndarray:
    """``values`` minima of independently scrambled 32-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    xor, mul = _SEEDS[0, :values], _SEEDS[1, :values] | np.uint32(1)
    best = np.full(values, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 512):
        np.minimum(best, ((x[lo:lo + 512] ^ xor) * mul).min(axis=0), out=best)
    return best


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.RecordBatch]]:
    for batch in batches:
        texts = single(batch.column("text"))
        for lo, hi in slices(texts):
            yield texts.slice(lo, hi - lo), batch.slice(lo, hi - lo)


def _profile(k: int, values: int):
    def run(batches):
        for texts, part in _texts(batches):
            size, digest, sig = [], [], []
            for s in shingle_sets(texts, k):
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s, values).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [single(part.column("doc_id")), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(sig, pa.binary())], ["doc_id", "n", "digest", "sig"])
    return run


def _sets(k: int):
    """(doc_id, text) -> (doc, shingle set as bytes)."""
    def run(batches):
        for texts, part in _texts(batches):
            rows = pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], ["doc", "shingles"])
    return run


def _region(prefix: np.ndarray, tree: int) -> np.ndarray:
    """Key of the region: hash of the prefix, with the tree's number in the low 6 bits."""
    key = np.full(len(prefix), tree + 1, dtype=np.uint64)
    for c in range(prefix.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + prefix[:, c].astype(np.uint64))
    return (key & ~np.uint64(63)) | np.uint64(tree)


def _trees(trees: int, depth: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1)
            doc, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            bits = np.packbits((sig & 1).astype(np.uint8), axis=1)
            pad = np.zeros((len(doc), 16), dtype=np.uint8)
            pad[:, :min(16, bits.shape[1])] = bits[:, :16]
            lo, hi = pad.view(np.int64)[:, 0], pad.view(np.int64)[:, 1]
            wide = sig.astype(np.uint64)
            for t in range(trees):
                at = [(t * depth + i) % sig.shape[1] for i in range(depth + 4)]
                key = _region(wide[:, at[:depth]], t)
                follow = np.zeros(len(doc), dtype=np.uint64)
                for c in at[depth:]:
                    follow = (follow << np.uint64(16)) | (wide[:, c] >> np.uint64(16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(follow.view(np.int64)), pa.array(doc), pa.array(n),
                     pa.array(lo), pa.array(hi)], ["key", "follow", "doc", "n", "lo", "hi"])
    return run


def _short(batches):
    """Signatures cut to 16 bits a value."""
    for batch in batches:
        sig = [(np.frombuffer(x, dtype=np.uint32) >> 16).astype(np.uint16).tobytes() for x in batch.column("sig").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sig, pa.binary())], ["doc", "sig"])


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)


def _neighbours(reach: int, percent: int, cut: int):
    """Rows sorted by (key, follow) -> candidate pairs (a, b) of one region, a < b; and, with a null
    ``b``, members of regions for ``_dense_rest``: of those of more than ``reach + 1`` rows, and of the task's
    first and last region whatever their size, since other tasks may hold rows of these."""
    def members(doc, key, n):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.nulls(len(doc), pa.int64()), pa.array(key), pa.array(n)], _FOUND)

    def run(batches):
        held = head = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key, _, doc, n, lo, hi = cols
            fresh = 0 if held is None else len(held[0])
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
            dense = np.repeat(np.diff(edge), np.diff(edge)) > reach + 1
            found = [np.empty((2, 0), dtype=np.int64)]
            for lag in range(1, min(reach, len(key) - 1) + 1):
                i = np.arange(max(fresh, lag), len(key))
                i = i[(key[i] == key[i - lag]) & (~dense[i] | (lag <= DENSE_REACH))]
                j = i - lag
                near = np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])
                i, j = i[near], j[near]
                near = (_ones(lo[i] ^ lo[j]) + _ones(hi[i] ^ hi[j]) <= cut) & (doc[i] != doc[j])
                i, j = i[near], j[near]
                found.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none, none], _FOUND)
            if len(key):
                head = key[0] if head is None else head
                dense = dense | (key == head)
            yield members(doc[dense], key[dense], n[dense])
            held = [c[-reach - 1:] for c in cols]
        if held is not None and len(held[0]):  # rows of a longer last region that are not held are out already
            last = held[0] == held[0][-1]
            yield members(held[2][last], held[0][last], held[3][last])
    return run


_FOUND = ["a", "b", "key", "n"]


def _runs(batch: pa.RecordBatch):
    """Cut a batch sorted by (key, block, kind) where one of them changes."""
    cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("sig", "shingles")}
    edge = np.flatnonzero((np.diff(cols["key"]) != 0) | (np.diff(cols["block"]) != 0) | (np.diff(cols["kind"]) != 0)) + 1
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
        if hi > lo:
            yield {c: x[lo:hi] for c, x in cols.items()}, batch.slice(lo, hi - lo)


def _least(values: int, percent: int) -> float:
    """Equal signature values below which the similarity is ruled out (4.5 deviations)."""
    chance = percent / 100
    return values * chance - 4.5 * (values * chance * (1 - chance)) ** 0.5


def _plausible(values: int, percent: int):
    """Rows sorted by (key, block, kind): first the region's documents outside its largest component
    (kind 0), then the members of the block -> those rows that have a partner in another component
    whose signature does not rule the similarity out.  Rows, not pairs."""
    least = _least(values, percent)

    def run(batches):
        at, minor, hit = None, None, None

        def rest():  # the minor documents of the block that found a partner
            if minor is not None and hit.any():
                yield _rows({c: v[hit] for c, v in minor.items()})

        for batch in batches:
            for part, rows in _runs(batch):
                part["sig"] = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint16).reshape(rows.num_rows, -1)
                here = (part["key"][0], part["block"][0])
                if here != at:
                    yield from rest()
                    at, minor, hit = here, None, None
                if part["kind"][0] == 0:
                    minor = part if minor is None else {c: np.concatenate([minor[c], x]) for c, x in part.items()}
                    hit = np.zeros(len(minor["doc"]), dtype=bool)
                    continue
                found = np.zeros(len(part["doc"]), dtype=bool)
                for x in range(0, len(minor["doc"]) if minor else 0, 512):
                    m = slice(x, x + 512)
                    i, j = np.nonzero((minor["root"][m, None] != part["root"])
                                      & (np.minimum(minor["n"][m, None], part["n"]) * 100 >= percent * np.maximum(minor["n"][m, None], part["n"])))
                    for k in range(0, len(i), 8192):
                        u, v = i[k:k + 8192] + x, j[k:k + 8192]
                        close = (minor["sig"][u] == part["sig"][v]).sum(axis=1) >= least
                        hit[u[close]] = True
                        found[v[close]] = True
                if found.any():
                    yield _rows({c: v[found] for c, v in part.items()})
        yield from rest()
    return run


def _rows(x: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[c]) for c in ("key", "block", "kind", "doc", "root")],
                                      ["key", "block", "kind", "doc", "root"])


def _join_components(trees: int, depth: int, percent: int):
    """Rows as for ``_plausible``, with full sets -> one confirmed link per pair of components and block.

    A pair is looked at only in the first tree where the two share a region; once two components are
    linked in the block, their other pairs are passed over."""
    values = trees * depth
    least = _least(values, percent)

    def run(batches):
        at, minor, linked = None, [], set()
        for batch in batches:
            links = []
            for part, rows in _runs(batch):
                here = (part["key"][0], part["block"][0])
                if here != at:
                    at, minor, linked, sigs = here, [], set(), None
                own = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
                sig = np.stack([signature(x, values) for x in own])
                if part["kind"][0] == 0:
                    minor += list(zip(part["doc"].tolist(), part["root"].tolist(), own))
                    sigs = sig if sigs is None else np.concatenate([sigs, sig])
                    continue
                for doc, root, x, y in zip(part["doc"].tolist(), part["root"].tolist(), own, sig):
                    if not minor:
                        break
                    same = sigs == y
                    for i in np.flatnonzero(same.sum(axis=1) >= least).tolist():
                        other, other_root, z = minor[i]
                        pair = (min(root, other_root), max(root, other_root))
                        if root == other_root or pair in linked:
                            continue
                        if same[i].reshape(trees, depth).all(axis=1).argmax() == here[0] & 63 and _similar(x, z, percent):
                            linked.add(pair)
                            links.append((min(doc, other), max(doc, other)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()),
                                              pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
    return run


def _dense_rest(members: DataFrame, signatures: DataFrame, sets: DataFrame, joined: DataFrame, trees: int, depth: int,
                percent: int) -> DataFrame:
    """Confirmed links that neighbour search left in dense regions: each document outside the region's
    largest component (by the links so far) is compared with all members of other components.

    First by signatures, to find the rows with a plausible partner; only their sets are then moved.
    ``joined`` are the links so far, contracted; two names for one component cost work, not correctness."""
    roots = joined.groupBy(F.col("u").alias("doc")).agg(F.min("v").alias("root"))
    rows = materialize(members.join(roots, "doc", "left")
                       .select("key", "doc", F.coalesce("root", "doc").alias("root"), "n"))
    count = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    region = (count.groupBy("key").agg(F.sum("c").alias("total"), F.count("*").alias("parts"),
                                       F.max_by("root", F.struct("c", "root")).alias("main"))
              .where("parts > 1").select("key", "main", F.ceil(F.col("total") / 512).cast("int").alias("blocks")))
    open_rows = rows.join(region, "key").join(signatures, "doc")
    member = open_rows.withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int")).withColumn("kind", F.lit(1))
    minor = (open_rows.where("root != main").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
             .withColumn("kind", F.lit(0)))
    cols = ["key", "block", "kind", "doc", "root", "n", "sig"]
    order = ["key", "block", "kind"]
    tasks = minor.select(*cols).unionByName(member.select(*cols)).repartition("key", "block").sortWithinPartitions(*order)
    hits = materialize(arrow_map(tasks, _plausible(trees * depth, percent), "key long, block int, kind int, doc long, root long"))
    tasks = hits.join(sets, "doc").repartition("key", "block").sortWithinPartitions(*order)
    return arrow_map(tasks, _join_components(trees, depth, percent), "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y)
    common = both - len(np.unique(np.concatenate([x, y])))
    return 100 * common >= percent * (both - common)


def _confirm(percent: int):
    """Rows sorted by (key, b): first the sets of a block (b null), then its pairs -> confirmed pairs."""
    def run(batches):
        at, sets = None, {}
        for batch in batches:
            out = []
            for key, doc, b, shingles in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "b", "shingles"))):
                if key != at:
                    at, sets = key, {}
                if b is None:
                    sets.setdefault(doc, []).append(np.frombuffer(shingles, dtype=np.uint64))
                elif any(_similar(x, y, percent) for x in sets[doc] for y in sets[b]):
                    out.append((doc, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                              pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    A document's label is the smallest neighbour of itself or of a smaller neighbour; documents of one
    label (in parts of about BLOCK, split by hash) share a block.  A pair is checked in the block of its
    ends' blocks, and a set is sent once to each block where it has a pair.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label"))
    label = (pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
             .join(near.select(F.col("a").alias("b"), "label"), "b").select("a", "label")
             .unionByName(near).groupBy("a").agg(F.min("label").alias("label")))
    size = label.groupBy("label").agg(F.count("*").alias("size"))
    block = label.join(size, "label").select(
        "a", F.xxhash64("label", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / BLOCK))).alias("block"))
    keyed = (pairs.join(block.withColumnRenamed("block", "ba"), "a")
             .join(block.select(F.col("a").alias("b"), F.col("block").alias("bb")), "b")
             .select(F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb")).alias("key"), "a", "b"))
    keyed = materialize(keyed)
    need = (keyed.select("key", F.col("a").alias("doc")).unionByName(keyed.select("key", F.col("b").alias("doc")))
            .distinct())
    rows = (sets.join(need, "doc").select("key", "doc", F.lit(None).cast("long").alias("b"), "shingles")
            .unionByName(keyed.select("key", F.col("a").alias("doc"), "b", F.lit(None).cast("binary").alias("shingles")))
            .repartition("key").sortWithinPartitions("key", F.col("b").asc_nulls_first()))
    return arrow_map(rows, _confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 80, trees: int = 24, depth: int = 4, reach: int = 15) -> DataFrame:
    """Groups of near-duplicate documents: ``doc_id, n_shingles, component_id, kept`` per row.

    Words are runs without ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a text of fewer than ``k``
    words is one shingle.  Two documents are linked when ``100 * common >= percent * union`` of
    their shingle sets; ``component_id`` is the smallest id that links reach, ``kept`` marks the
    document of that id.  A null, empty or blank text has no shingle and stays alone.  Rows that
    repeat an id are one node with several texts (each row is returned).  A row with a null id is
    returned unlinked, with a null component and a null ``kept``.  Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = materialize(arrow_map(docs, _profile(k, trees * depth),
                                    "doc_id long, n long, digest binary, sig binary"))
    full = profile.where("n > 0 and doc_id is not null")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = (full.select("doc_id", "n", "digest", "sig")
            .join(classes.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), ["doc_id", "digest"], "left_semi"))
    # a bit of the signature differs with probability (1 - similarity) / 2: five deviations above the mean
    chance = (100 - percent) / 200
    bits = min(trees * depth, 128)
    cut = int(np.ceil(bits * chance + 5 * (bits * chance * (1 - chance)) ** 0.5))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forest = (arrow_map(reps, _trees(trees, depth), "key long, follow long, doc long, n long, lo long, hi long")
              .repartitionByRange(parts, "key", "follow").sortWithinPartitions("key", "follow", "doc"))
    found = materialize(arrow_map(forest, _neighbours(reach, percent, cut),
                                  "a long, b long, key long, n long"))
    pairs = materialize(found.where("b is not null").select("a", "b").distinct())
    members = found.where("b is null").select("key", F.col("a").alias("doc"), "n").distinct()
    wanted = (found.select(F.col("a").alias("doc_id")).unionByName(found.where("b is not null").select(F.col("b").alias("doc_id")))
              .distinct())
    sets = materialize(arrow_map(docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), _sets(k),
                                 "doc long, shingles binary"))
    links = _confirmed(pairs, sets, percent)
    signatures = arrow_map(reps.select("doc_id", "sig"), _short, "doc long, sig binary")
    joined = contract(links, rounds=2)
    rest = _dense_rest(members, signatures, sets, joined, trees, depth, percent)
    links = joined.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(rest)
    repeated = full.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    same_id = (full.select("doc_id", "digest").join(repeated, "doc_id").join(classes, "digest")
               .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = connected_components(links.unionByName(same_id))
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("root", "rep").alias("component"))
    rows = profile.select("doc_id", "n", "digest")
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return (rows.join(named, "digest", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"),
                    (F.col("doc_id") == linked).alias("kept")))
