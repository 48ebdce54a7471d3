"""Near-duplicate groups by a chosen-path similarity join over 5-word shingles.

Every distinct shingle set (a class of documents) walks down independent trees. At a node it goes to
the child named by its minwise shingle under the hash function of that tree and level. Nodes of at
most ``NODE`` sets are compared exhaustively; larger ones branch again, down to ``DEPTH`` levels,
where groups of close copies remain. Compared first are sketches of 384 minwise values, a byte
each, whose cut lies five standard deviations under the threshold; what passes is confirmed on the
full sets.

Links are confirmed in two rounds, as components are what is asked for: first each set against the
smaller-numbered set of its node that its sketch resembles most, then every set against the
components, other than its own, of those that its sketch resembles in a node. What comes out of a node
is a set and a component, never all pairs; the full sets of the component then pass by those of the
sets that ask for it, and one link is enough to join the two. No task holds a node or a component: the
first round cuts a node of more than ``BLOCK`` sets into blocks, the second compares blocks of the sets
outside its largest component with blocks of all its sets, and components are cut likewise.

A pair of similarity s meets in a root's child of one tree with probability s, so in one of ``TREES``
trees with 1 - (1 - s)^16 (over 0.9999999 at 0.8); where all nodes above are large it must agree at
every level, with s^4 a tree and 1 - (1 - s^4)^16 in all (0.9998 at 0.8, 0.99999 at 0.85), and groups so large are
linked over many pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, pieces, scratch_scope, table, written
from .components import components
from .filters import filter_of, has, pairs
from .shingles import shingle_hashes

TREES, DEPTH, NODE, BLOCK, SKETCH = 16, 4, 40, 2000, 384
#: Rows whose minima a task holds at once, 3.5 KB each.
SIGNED = 4000
#: Bytes of full sets that a task holds at most, unless one set has more.
HELD = 64 << 20
PERCENT = 80
_CHOICES = TREES * DEPTH
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**63, SKETCH + _CHOICES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, SKETCH + _CHOICES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = "id long, n long, set_id binary, sketch binary, roots array<long>, branches array<int>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, SIGNED):
        for first, hashes, counts in shingle_hashes(batch.column(1)):
            rows = np.flatnonzero(counts)
            ids = batch.column(0).slice(first, len(counts))
            n, names = np.zeros(len(counts), np.int64), [None] * len(counts)
            at = np.concatenate([[0], np.cumsum(counts)])
            for r in rows.tolist():
                own = np.unique(hashes[at[r] : at[r + 1]])
                n[r], names[r] = len(own), xxhash.xxh3_128_digest(own.tobytes())
            least = np.empty((len(rows), SKETCH + _CHOICES), np.uint64)
            for k in range(SKETCH + _CHOICES if len(rows) else 0):
                least[:, k] = np.minimum.reduceat((hashes ^ _XOR[k]) * _MUL[k], at[rows])
            back = np.full(len(counts), -1)
            back[rows] = np.arange(len(rows))
            # the minimum's low bits: its high ones are all near zero
            sketch = (least[:, :SKETCH] & np.uint64(0xFF)).astype(np.uint8)
            roots = least[:, SKETCH : SKETCH + TREES].astype(np.int64)
            more = (least[:, SKETCH + TREES :] & np.uint64(0x7FFFFFFF)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(names, pa.binary()), pa.array([sketch[b].tobytes() if b >= 0 else None for b in back.tolist()], pa.binary()),
                 pa.array([roots[b] if b >= 0 else None for b in back.tolist()], pa.list_(pa.int64())), pa.array([more[b] if b >= 0 else None for b in back.tolist()], pa.list_(pa.int32()))],
                ["id", "n", "set_id", "sketch", "roots", "branches"],
            )


def _leaves(sets: DataFrame) -> DataFrame:
    """(node, id, size) for every node with two sets or more that doesn't branch further."""
    level = sets.select("id", F.posexplode("roots").alias("tree", "token"))
    level = level.select("id", "tree", F.xxhash64(F.lit(1), "tree", "token").alias("node"))
    out = None
    for depth in range(1, DEPTH + 1):
        level = written(level, f"level{depth}")
        sizes = written(level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        sized = level.join(sizes, "node")
        leaf = sized.where(f"size <= {NODE}" if depth < DEPTH else "true").select("node", "id", "size")
        out = leaf if out is None else out.unionAll(leaf)
        if depth == DEPTH:
            break
        large = sized.where(f"size > {NODE}").select("id", "tree", "node")
        token = F.expr(f"branches[{(depth - 1) * TREES} + tree]")
        level = large.join(sets.select("id", "branches"), "id").select("id", "tree", F.xxhash64("node", token).alias("node"))
    return out


def _blocks(rows) -> F.Column:
    return F.ceil(rows / F.lit(BLOCK))


def _dealt(blocks) -> F.Column:
    """The block of a set."""
    return F.pmod(F.xxhash64(F.lit(5), "id"), blocks)


def _resemblance(sketches: np.ndarray, sizes: np.ndarray, one: int, least: int, percent: int) -> np.ndarray:
    """Values each sketch has in common with that of ``one``; 0 where they or the sizes rule a link out."""
    n = sizes[one]
    same = (sketches == sketches[one]).sum(axis=1)
    return np.where((same >= least) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)), same, 0)


def _first_links(block: dict, least: int, percent: int) -> Iterator[tuple[int, int]]:
    """Each set with the one of smaller number in the block that it resembles most; (a, a) marks one
    that only larger ones resemble."""
    ids, sketches, sizes = block["id"], block["sketch"], block["n"]
    named = np.zeros(len(ids), bool)
    for i in range(len(ids) - 1, -1, -1):
        same = _resemblance(sketches, sizes, i, least, percent)
        best = int(np.argmax(same[:i])) if i else 0
        if i and same[best]:
            named[[i, best]] = True
            yield ids[i], ids[best]
        elif not named[i] and same[i + 1 :].any():
            yield ids[i], ids[i]


def _other_components(block: dict, least: int, percent: int) -> Iterator[tuple[int, int]]:
    """Every asking set with the other components of sets that it resembles. Of two asking sets the
    larger asks."""
    ids, component, asks = block["id"], block["component"], block["asks"]
    others = np.flatnonzero(~asks)
    sketches, sizes = block["sketch"][others], block["n"][others]
    rest = component[others] == block["giant"][0]
    for i in np.flatnonzero(asks):
        n = block["n"][i]
        alike = (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (component[others] != component[i]) & (rest | (ids[others] < ids[i]))
        alike[alike] = (sketches[alike] == block["sketch"][i]).sum(axis=1) >= least
        for c in np.unique(component[others][alike]).tolist():
            yield ids[i], c


def _by_block(work, least: int, percent: int):
    """Rows come sorted by block and id; ``work`` gets a block at a time (520 bytes a set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out(part: list[dict]) -> Iterator[pa.RecordBatch]:
            block = {k: np.concatenate([x[k] for x in part]) for k in part[0]}
            links = list(work(block, least, percent)) if len(block["id"]) > 1 else []
            if links:
                x = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = {k: np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in batch.schema.names if k != "sketch"}
            now["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            cuts = np.flatnonzero(np.diff(now["block"])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = {k: v[a:b] for k, v in now.items()}
                if held and held[0]["block"][0] != part["block"][0]:
                    yield from out(held)
                    held = []
                held.append(part)
        if held:
            yield from out(held)

    return run


def _full_sets(packed):
    """(id, text) -> the shingle sets of the ids in a filter, where the texts lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has(packed.value, pairs(batch.column(0).to_numpy()))))
            for first, hashes, counts in shingle_hashes(batch.column(1)):
                at = np.concatenate([[0], np.cumsum(counts)])
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
    return bool(both) and 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _answer(least: int, percent: int):
    """(block, member, id, n, sketch, set), each block's asking sets before its component's members: these
    pass by one at a time. The first link that an asking set finds is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asks, open_ = None, [], None
        for batch in batches:
            a, b = [], []
            columns = [c.to_pylist() for c in batch.columns]
            for own, member, i, n, sketch, full in zip(*columns):
                if own != block:
                    block, asks, open_ = own, [], None
                if not member:
                    asks.append((i, n, np.frombuffer(sketch, np.uint8), np.frombuffer(full, np.uint64)))
                    continue
                if open_ is None:
                    open_ = np.ones(len(asks), bool)
                    sizes, sketches = np.array([x[1] for x in asks]), np.array([x[2] for x in asks]).reshape(-1, SKETCH)
                near = np.flatnonzero(open_ & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
                if not len(near):
                    continue
                near = near[(sketches[near] == np.frombuffer(sketch, np.uint8)).sum(axis=1) >= least]
                y = np.frombuffer(full, np.uint64)
                for k in near.tolist():
                    if _linked(asks[k][3], y, percent):
                        open_[k] = False
                        a.append(max(asks[k][0], i))
                        b.append(min(asks[k][0], i))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row (key, ``n_shingles``, ``component_id``, ``kept``) for each row of ``docs``.

    Linked are documents whose distinct shingles overlap in ``percent`` of their union or more;
    component_id is the smallest key reachable over links, kept whether it is the row's own. Without
    words (null, empty) a document has 0 shingles and is its own component. Rows with equal keys are
    one document. A row with a null key belongs to the component of the keys whose set equals its
    own, else to none (component_id null), and is kept only in that case. The key is a long.
    """
    ids = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signatures = written(ids.mapInArrow(_signatures, SIGNATURE), "signatures")
    classes = written(signatures.where("n > 0 and id is not null").groupBy("set_id").agg(F.min("id").alias("id")), "classes")
    scope = f"near_dup-{uuid.uuid4().hex}"
    with scratch_scope(scope):
        labels = _labels(ids, signatures, classes, percent)
    labels = written(labels, "labels")
    drop_written(docs.sparkSession, scope)

    classes = classes.join(labels, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    out = signatures.select("id", "n", "set_id").join(classes, "set_id", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _labels(ids: DataFrame, signatures: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, component) of each class that is linked to a smaller one."""
    sets = signatures.where("n > 0").join(classes, ["set_id", "id"], "left_semi").dropDuplicates(["set_id"])
    sets = written(sets.select("id", "n", "sketch", "roots", "branches"), "sets")
    leaves = written(_leaves(sets), "leaves")

    least = int(SKETCH * percent / 100 - 5 * (SKETCH * percent / 100 * (1 - percent / 100)) ** 0.5)
    block = F.when(F.col("size") <= BLOCK, F.col("node")).otherwise(F.xxhash64("node", _dealt(_blocks(F.col("size")))))
    described = leaves.select("id", block.alias("block")).join(sets.select("id", "n", "sketch"), "id")
    sort = lambda df: df.repartition("block").sortWithinPartitions("block", "id")
    first = written(sort(described).mapInArrow(_by_block(_first_links, least, percent), "a long, b long").distinct(), "links")

    def full_sets(wanted: DataFrame) -> DataFrame:
        packed = filter_of(written(wanted, "wanted"), "id")
        sets = ids.where("id is not null").mapInArrow(_full_sets(packed), "id long, set binary")
        sets = written(sets.dropDuplicates(["id", "set"]), "full")
        packed.unpersist()  # written by now
        return sets

    full = full_sets(first.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # many pairs can share b, the smaller one, but few share a: a's set is what moves with a pair
    left = first.where("a <> b").join(full.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(full.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    links = written(both.mapInArrow(_confirm(percent), "a long, b long"), "confirmed")
    labels = components(links)

    of = written(sets.select("id", "n").join(labels, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component")), "named")
    named = written(leaves.join(of.select("id", "component"), "id"), "members")
    shares = named.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("node").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("components")).where("components > 1")
    mixed = written(mixed.select("node", F.col("most.component").alias("giant"), F.col("most.n").alias("in_giant")), "mixed")
    apart = named.join(mixed, "node")
    columns = ["id", "component", "giant"]
    answers, asks = _crossed(apart, apart.where("component <> giant"), "node", _blocks(F.col("size")), _blocks(F.col("size") - F.col("in_giant")), columns)
    rows = answers.withColumn("asks", F.lit(False)).unionAll(asks.withColumn("asks", F.lit(True))).join(sets.select("id", "n", "sketch"), "id")
    asked = written(sort(rows).mapInArrow(_by_block(_other_components, least, percent), "id long, component long").distinct(), "asked")
    if not asked.head(1):
        return labels

    asking = asked.join(of.select("id", "n"), "id")
    counts = asking.groupBy("component").agg(F.count(F.lit(1)).alias("asking"), F.sum("n").alias("held"))
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    counts = written(counts.join(sizes, "component"), "counts")
    blocks = F.greatest(_blocks(F.col("asking")), F.ceil(F.col("held") * 8 / HELD))
    target, need = of.select("id", "component").join(counts, "component"), asked.join(counts, "component")
    answers, asks = _crossed(target, need, "component", _blocks(F.col("size")), blocks, ["id"])
    rows = written(answers.withColumn("member", F.lit(True)).unionAll(asks.withColumn("member", F.lit(False))), "meetings")
    full = full_sets(rows.select("id").distinct())
    rows = rows.join(sets.select("id", "n", "sketch"), "id").join(full, "id").select("block", "member", "id", "n", "sketch", "set")
    more = written(rows.repartition("block").sortWithinPartitions("block", "member", "id").mapInArrow(_answer(least, percent), "a long, b long"), "confirmed")
    return components(links.unionAll(more)) if more.head(1) else labels


def _crossed(every: DataFrame, asking: DataFrame, group: str, blocks: F.Column, asking_blocks: F.Column, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a group and those of it that ask, so dealt that each asking one meets each row in one block."""
    block = lambda x, y: F.xxhash64(group, x, y).alias("block")
    one = every.select(group, *columns, _dealt(blocks).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), asking_blocks.cast("long") - 1)).alias("y"))
    two = asking.select(group, *columns, F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("x"), _dealt(asking_blocks).alias("y"))
    return tuple(x.select(*columns, block("x", "y")) for x in (one, two))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
