"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection; connected groups of near duplicates.

Equal sets become one class (a node).  Two sets with Jaccard similarity of at least t share one of their first
n - ceil(t n) + 1 members in any common order (prefix filter); members that many sets hold come last in the order, so
they seldom count.  A tile is what shares such a member, and tiles with the same least node are one: sets that are much
alike share many members, but few least nodes.  A tile too large for one block is cut by size band, and a band dealt to
blocks, so that sets of similar size meet in one block, or one pair of blocks.
In a block bitmaps first bound the overlap of pairs from above; what they cannot tell apart is then intersected exactly.
Both walk the block breadth first, so a pair that is already in one group is not compared again, and a block gives a tree
for each of its groups, never all its pairs.  No link between different texts is lost: every pair of similar size that
shares a tile is compared exactly, excluded by its bitmaps, or in one group already.

Null texts and texts without words have the empty set, size 0, and are linked with nothing.  Repeated rows are in one
class.  A null id counts as the largest.  Texts of any length are read whole, and a block holds a bounded number of
members, but never less than one pair of sets.  The least id names a group whatever the order of rows, so ties do not
matter.  An empty table gives no rows.  Only the id and text columns are read, under names of their own, so other columns
may have any name.  Links, groups and sets stay in tables; nothing of them goes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import bounded, discard, packed, release, saved, small_batches, unpacked

PERCENT = 80
#: Members that LOCAL sets among about POOL members of one task hold, FREQUENT in all, go to the end of the order, up to MOST
#: of them.  The order only decides how large tiles get, never what is found.
POOL, LOCAL, FREQUENT, MOST = 1_500_000, 2, 6, 1_000_000
#: A frequent member's tile is dealt to sub-tiles of about so many sets while it is gathered.
SUBTILE = 50_000
#: A block holds about so many sets at most, and so many members of sets.
BLOCK, BLOCK_MEMBERS = 2_048, 1 << 19
#: Text that is made into sets at once, in bytes.
AT_ONCE = 4 << 20
BROADCAST_ROWS = 1_000_000


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches in slices of bounded text, with the texts."""
    for batch in rows:
        texts = batch.column("__text")
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + AT_ONCE, side="right")))
            yield batch.slice(at, end - at), texts.slice(at, end - at).to_pylist()
            at = end


def digests(docs: DataFrame, id_type: str, salt: int) -> DataFrame:
    """A row per document (kind 0: id, k1, k2, n, s1, s2, bits), and rows of locally frequent members (kind 1: s1 member, s2 count)."""
    names = ["kind", "id", "k1", "k2", "n", "s1", "s2", "bits"]

    def often(pool: list[np.ndarray], id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        members = np.sort(np.concatenate(pool))
        edges = np.flatnonzero(np.concatenate(([True], members[1:] != members[:-1], [True]))) if len(members) else np.zeros(1, np.int64)
        counts = np.diff(edges)
        found, counts = members[edges[:-1]][counts >= LOCAL], counts[counts >= LOCAL]
        for at in range(0, len(found), 50_000):
            k = len(found[at : at + 50_000])
            none = pa.nulls(k, pa.int64())
            yield pa.record_batch([pa.array(np.ones(k, np.int32)), pa.nulls(k, id_kind), none, none, none, pa.array(found[at : at + k].view(np.int64)), pa.array(counts[at : at + k].astype(np.int64)), pa.nulls(k, pa.binary())], names=names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[np.ndarray] = []
        held, id_kind, seen = 0, None, set()
        for batch, texts in _batches(rows):
            sets = S.shingle_sets(texts)
            sums = [S.signature(s, salt) for s in sets]
            id_kind = batch.column("__id").type
            told = [batch.column(c) for c in ("__id", "__k1", "__k2")]
            made = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [a for a, _ in sums], [b for _, b in sums])]
            yield pa.record_batch([pa.array(np.zeros(len(sets), np.int32)), *told, *made, pa.array([S.bitmap(s) for s in sets], pa.binary())], names=names)
            for s, (a, _) in zip(sets, sums, strict=True):
                if a not in seen:  # a copy makes no member more frequent
                    seen.add(a)
                    pool.append(s)
                    held += len(s)
            if held > POOL:
                yield from often(pool, id_kind)
                pool, held, seen = [], 0, set()
        if pool:
            yield from often(pool, id_kind)
        del pool, seen
        release()

    return docs.mapInArrow(run, f"kind int, id {id_type}, k1 long, k2 long, n long, s1 long, s2 long, bits binary")


def tiles(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int, salt: int) -> DataFrame:
    """Rows (deal, member, node): the prefix of each set; deal is 0, or names a sub-tile of a very frequent member from 1."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        seen: set[int] = set()
        for _, texts in _batches(rows):
            deals, members, nodes = [], [], []
            for s in S.shingle_sets(texts):
                if not len(s):
                    continue
                node = S.signature(s, salt)[0]
                if node in seen:  # a copy adds nothing to a tile
                    continue
                if len(seen) < 100_000:
                    seen.add(node)
                at = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
                rank = np.where(often[at] == s, times[at], 0) if len(often) else np.zeros(len(s), np.int64)
                chosen = np.lexsort((s, rank))[: prefix_size(len(s), percent)]
                deals.append(np.where(rank[chosen] > SUBTILE, 1 + node % (1 + rank[chosen] // SUBTILE), 0))
                members.append(s[chosen].view(np.int64))
                nodes.append(np.full(len(chosen), node, np.int64))
            if nodes:
                yield pa.record_batch([pa.array(np.concatenate(deals).astype(np.int32)), pa.array(np.concatenate(members)), pa.array(np.concatenate(nodes))], names=["deal", "member", "node"])
        del seen
        release()

    return docs.mapInArrow(run, "deal int, member long, node long")


def shared_tiles(rows: DataFrame) -> DataFrame:
    """(member, deal, first, node) of tiles with several nodes, or with sub-tiles; one shuffle, then runs of a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, first node, whether its row was given out, last node
        for batch in batches:
            deal, member, node = (batch.column(c).to_numpy() for c in ("deal", "member", "node"))
            if not len(node):
                continue
            fresh = np.ones(len(node), dtype=bool)  # not a repeat of the row before
            fresh[1:] = (deal[1:] != deal[:-1]) | (member[1:] != member[:-1]) | (node[1:] != node[:-1])
            same = last is not None and last[0] == (member[0], deal[0])
            if same and last[3] == node[0]:
                fresh[0] = False
            end_key, end_node = (member[-1], deal[-1]), node[-1]
            deal, member, node = deal[fresh], member[fresh], node[fresh]
            if not len(node):
                continue
            begins = np.ones(len(node), dtype=bool)
            begins[1:] = (member[1:] != member[:-1]) | (deal[1:] != deal[:-1])
            begins[0] = not same
            run_of = np.cumsum(begins) - (0 if same else 1)
            starts = np.flatnonzero(begins)
            firsts = np.concatenate(([last[1]], node[starts])) if same else node[starts]
            first = firsts[run_of]
            sizes = np.bincount(run_of, minlength=len(firsts))
            if same:
                sizes[0] += 1
            keep = (sizes[run_of] > 1) | (deal > 0)
            extra = []
            given = True
            if same:
                if not last[2] and sizes[0] > 1:  # the first row of a run that the batch before could not know to be shared
                    extra = [(last[0][0], last[0][1], last[1], last[1])]
                given = last[2] or sizes[0] > 1
            k = run_of[-1]
            whole = given if same and k == 0 else bool(keep[-1])
            last = (end_key, firsts[k], whole, end_node)
            out = [np.concatenate((np.array([e[i] for e in extra], dtype=x.dtype), x[keep])) for i, x in enumerate((member, deal, first, node))]
            if len(out[0]):
                yield pa.record_batch([pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2]), pa.array(out[3])], names=["member", "deal", "first", "node"])

    dealt = rows.repartition("member", "deal").sortWithinPartitions("member", "deal", "node")
    return dealt.mapInArrow(run, "member long, deal int, first long, node long")


def tiles_by_least(shared: DataFrame) -> DataFrame:
    """Distinct (first, node): tiles with the same least node joined; sub-tiles of a member come under the least of all."""
    dealt = shared.filter("deal > 0")
    heads = dealt.groupBy("member").agg(F.min("first").alias("head"))
    whole = dealt.join(bounded(heads, BROADCAST_ROWS), "member").select(F.col("head").alias("first"), "node")
    return shared.filter("deal = 0").select("first", "node").union(whole).distinct()


KEYS = ["first", "band", "i", "j", "across"]


def placed(rows: DataFrame, percent: int) -> DataFrame:
    """rows (first, node, n) dealt to blocks: KEYS, side, node.

    A tile that fits is one block.  Of others, bands of sizes are wide enough for similar sizes to fall in the same or the
    next one; a band is dealt to blocks, and two blocks of a band, or of neighbouring bands, meet in a block of two sides.
    """
    blocks = lambda: F.ceil(F.greatest(F.sum("n") / BLOCK_MEMBERS, F.count("*") / BLOCK)).cast("int")
    large = saved(rows.groupBy("first").agg(blocks().alias("blocks")).filter("blocks > 1").select("first"), "large")
    large = bounded(large, BROADCAST_ROWS)
    one = [F.lit(x).alias(c) for c, x in (("band", -1), ("i", 0), ("j", 0), ("across", 0), ("side", 0))]
    small = rows.join(large, "first", "left_anti").select("first", *one, "node")
    banded = rows.join(large, "first", "left_semi").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int"))
    counts = banded.groupBy("first", "band").agg(blocks().alias("blocks"))
    after = counts.select("first", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_next"))
    before = counts.select("first", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_last"))
    plan = saved(counts.join(after, ["first", "band"], "left").join(before, ["first", "band"], "left").na.fill(0), "plan")
    banded = banded.join(bounded(plan, BROADCAST_ROWS), ["first", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    none = F.array().cast("array<struct<band:int,i:int,j:int,across:int,side:int>>")

    def block(band: Column, i: Column, j: Column, across: int, side: Column) -> Column:
        return F.struct(band.alias("band"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(across).alias("across"), side.cast("int").alias("side"))

    own, band = F.col("own"), F.col("band")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    within = F.transform(to("blocks"), lambda k: block(band, F.least(own, k), F.greatest(own, k), 0, F.when(own > k, 1).otherwise(0)))
    up = F.when(F.col("blocks_next") > 0, F.transform(to("blocks_next"), lambda k: block(band, own, k, 1, F.lit(0)))).otherwise(none)
    down = F.when(F.col("blocks_last") > 0, F.transform(to("blocks_last"), lambda k: block(band - 1, k, own, 1, F.lit(1)))).otherwise(none)
    dealt = banded.select("first", "node", F.explode_outer(F.concat(within, up, down)).alias("t"))
    return small.union(dealt.select("first", "t.band", "t.i", "t.j", "t.across", "t.side", "node"))


Test = Callable[[int, np.ndarray], np.ndarray]


def walk(n: np.ndarray, side: np.ndarray, two_sided: bool, test: Test, percent: int) -> list[list[int]]:
    """Groups of a block, each of two sets or more.  test(i, others): which of others, all of similar size, i is linked with.

    Breadth first: each set is tested once, against what no group has taken.  Of two sets that end in different groups, the
    one that was taken first was tested against the other.
    """
    order = np.argsort(n, kind="stable")
    sizes = n[order]
    low = np.searchsorted(sizes, -(-percent * n // 100), side="left")
    high = np.searchsorted(sizes, 100 * n // percent, side="right")
    free = np.ones(len(n), dtype=bool)
    out = []
    for start in range(len(n)):
        if not free[start]:
            continue
        free[start] = False
        group = [start]
        for i in group:  # grows meanwhile
            near = order[low[i] : high[i]]
            near = near[free[near]]
            if two_sided:
                near = near[side[near] != side[i]]
            if len(near):
                found = near[test(i, near)]
                free[found] = False
                group += found.tolist()
        if len(group) > 1:
            out.append(group)
    return out


def by_block(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in keys, each node of a run once; rows come sorted by keys and node, node the first of columns."""
    key, part = None, []
    for batch in batches:
        named = [batch.column(c).to_pylist() for c in keys]
        for at, now in enumerate(zip(*named, strict=True)):
            if now != key:
                if len(part) > 1:
                    yield key, part
                key, part = now, []
            row = tuple(batch.column(c)[at].as_py() for c in columns)
            if not part or part[-1][0] != row[0]:
                part.append(row)
    if len(part) > 1:
        yield key, part


def candidates(blocks: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """KEYS, part, side, node: the sets of blocks that bitmaps leave with a partner, and the group they leave them in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_block(batches, KEYS, ["node", "side", "n", "bits"]):
            n, side = (np.array([r[k] for r in rows], dtype=np.int64) for k in (2, 1))
            maps = S.Bitmaps(n, [r[3] for r in rows])
            groups = walk(n, side, key[2] != key[3] or key[4] > 0, lambda i, j, n=n, maps=maps: S.similar(maps.most_shared(i, j), n[i], n[j], percent), percent)
            if groups:
                at = np.concatenate(groups)
                part = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
                fixed = [pa.array(np.full(len(at), x), kind) for x, kind in zip(key, (pa.int64(), *[pa.int32()] * 4), strict=True)]
                yield pa.record_batch([*fixed, pa.array(part, pa.int32()), pa.array(side[at], pa.int32()), pa.array([rows[k][0] for k in at], pa.int64())], names=[*KEYS, "part", "side", "node"])

    rows = blocks.join(classes.select("node", "n", "bits"), "node").repartition(*KEYS).sortWithinPartitions(*KEYS, "node")
    return rows.mapInArrow(run, "first long, band int, i int, j int, across int, part int, side int, node long")


def sets_of(docs: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """node, grams: the set of each node whose document is wanted (__want, an id)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batches(rows):
            sets = [s for s in S.shingle_sets(texts) if len(s)]
            yield pa.record_batch([pa.array([S.signature(s, salt)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    found = docs.join(bounded(wanted, BROADCAST_ROWS), F.col("__id").eqNullSafe(F.col("__want")), "left_semi")
    return found.mapInArrow(run, "node long, grams binary").groupBy("node").agg(F.first("grams").alias("grams"))


def links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): ties that join the sets of each group of a block, by exact intersection; no node has more than three of a group."""
    keys = [*KEYS, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_block(batches, keys, ["node", "side", "grams"]):
            grams = [np.frombuffer(r[2], np.uint64) for r in rows]
            n, side = np.array([len(g) for g in grams]), np.array([r[1] for r in rows])
            maps = S.Bitmaps(n, [S.bitmap(g) for g in grams])

            def test(i: int, others: np.ndarray, n=n, maps=maps, grams=grams) -> np.ndarray:
                out = S.similar(maps.most_shared(i, others), n[i], n[others], percent)
                left = others[out]
                out[out] = S.similar(S.shared_with(grams[i], [grams[j] for j in left]), n[i], n[left], percent)
                return out

            a, b = [], []
            for group in walk(n, side, key[2] != key[3] or key[4] > 0, test, percent):
                nodes = sorted(rows[i][0] for i in group)
                a += [nodes[(k - 1) // 2] for k in range(1, len(nodes))]
                b += nodes[1:]
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = near.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys, "node")
    return rows.mapInArrow(run, "a long, b long").distinct()


def components(ties: DataFrame) -> DataFrame:
    """node -> root, for every node with a tie: the least node reachable.  Labels fall to the least neighbour's, then jump to their label's label."""
    both = saved(ties.select("a", "b").union(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ties")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = saved(labels.join(seen, "node").select("node", F.least("root", "low").alias("next"), F.col("root").alias("old")), "step")
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("far"))
        new = saved(step.join(jump, F.col("next") == F.col("at")).select("node", F.col("far").alias("root"), "old"), "labels")
        discard(labels, step)
        labels = new.select("node", "root")
        if not new.filter("root <> old").limit(1).count():
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """__id, __k1, __k2 (hashes of the text), n, node, root, component for every row.

    n is the size of its set, node its class, root its group, and component the least id of the group (its own id for the
    empty set, whose node and root are null).
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), F.xxhash64(text, F.lit(1)).alias("__k1"), F.xxhash64(F.lit(2), text).alias("__k2"))
    id_type = slim.schema["__id"].dataType.simpleString()
    for salt in range(8):  # sums of 64 bits name classes; should two classes have one sum, others are taken
        both = saved(digests(slim, id_type, salt), "digests")
        rows = both.filter("kind = 0").select(F.col("id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "n", F.col("s1").alias("node"), "s2", "bits")
        named = rows.filter("n > 0").groupBy("node").agg(F.min("__id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("s2").alias("s2"), F.max("s2").alias("s2_high"))
        classes = saved(named, "classes")
        if not classes.filter("s2 <> s2_high").limit(1).count():
            break
        discard(both, classes)
    found = both.filter("kind = 1").groupBy("s1").agg(F.sum("s2").alias("times")).filter(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "s1").limit(MOST).toPandas()
    members, times = found["s1"].to_numpy(dtype=np.int64).view(np.uint64), found["times"].to_numpy(dtype=np.int64)
    order = np.argsort(members)
    runs = saved(shared_tiles(tiles(slim, (members[order], times[order]), percent, salt)), "runs")
    shared = saved(tiles_by_least(runs), "tiles")
    discard(runs)
    sized = shared.join(classes.select("node", "n"), "node").select("first", "node", "n")
    near = saved(candidates(placed(sized, percent), classes, percent), "near")
    wanted = saved(classes.join(near.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("__want")).distinct(), "wanted")
    ties = saved(links(near, sets_of(slim, wanted, salt), percent), "links")
    roots = components(ties)
    root = classes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = saved(root.groupBy("root").agg(F.min("rep").alias("component")), "least")  # a table, so that a group of many can be split where it is joined
    by_node = root.join(least, "root").select("node", "root", "component")
    out = rows.select("__id", "__k1", "__k2", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    out = out.join(by_node, "node", "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("__id")))
    discard(shared, near, wanted, ties)
    return out.select("__id", "__k1", "__k2", "n", "node", "root", "component")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return near_duplicates(docs, id_col, text_col).select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that with the least id (null last), then the least hash of its text.

    Rows are told apart by id and text, so two texts under one id do not share a fate; of rows that agree in both, one stays
    if they are in a group.  Rows without words are in no group and all stay.
    """
    key = F.struct(F.col("__id").isNull().alias("last"), "__id", "__k1", "__k2")
    rows = near_duplicates(docs, id_col, text_col).filter("root is not null").select("root", key.alias("key"))
    rows = saved(rows.groupBy("root", "key").agg(F.count("*").alias("times")), "keys")
    kept = saved(rows.groupBy("root").agg(F.min("key").alias("least"), F.sum("times").alias("all")).filter("all > 1"), "kept")
    both = saved(rows.join(kept, "root").select("key.__id", "key.__k1", "key.__k2", (F.col("key") == F.col("least")).alias("stays"), "times"), "fates")
    names, text = docs.columns, F.col(text_col)
    keyed = packed(docs, F.col(id_col).alias("__id"), F.xxhash64(text, F.lit(1)).alias("__k1"), F.xxhash64(F.lit(2), text).alias("__k2"))

    def without(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        right = bounded(keys.select(F.col("__id").alias("__rid"), F.col("__k1").alias("__r1"), F.col("__k2").alias("__r2")), BROADCAST_ROWS)
        return left.join(right, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")) & F.col("__id").eqNullSafe(F.col("__rid")), how)

    out = without(keyed, both.filter("not stays or times > 1"), "left_anti").select("__row")
    repeated = both.filter("stays and times > 1")
    if repeated.limit(1).count():  # one of the rows that agree in id and text
        some = without(keyed, repeated, "left_semi").groupBy("__id", "__k1", "__k2").agg(F.first("__row").alias("__row"))
        out = out.union(some.select("__row"))
    return unpacked(out, names)
