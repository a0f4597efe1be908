"""N-gram Jaccard join.

A document is its set of distinct word n-grams, kept as a sorted array of 64-bit hashes; equal sets are one set.

1. Of every set the smallest hashes, a few more than it may lack in a linked one, are counted. Two linked sets have a
   share of these in common, so a set too few of whose smallest hashes stand in any other set links with nothing. Most
   sets end here, and only the few hashes that were counted have been moved.
2. Of the sets left, the n-grams are ordered by the number of sets that have them. Of two linked sets, each has a common
   n-gram among its rarest ones, one more than it may lack; so these are the set's keys, unless no other set has them.
   Sets fall into size bands, and a key is one of its band: two sets that link lie in one band, or in neighbouring ones,
   where the smaller also stands in the upper band.
3. Sets that share a key, directly or through others, form a tile; almost only near copies do. Inside a tile, hashed
   bitmaps bound the overlap of a pair from above by counting bits, and what passes is verified exactly by
   intersecting the sorted arrays. A tile is searched from set to set, so sets already linked are not compared again,
   and large tiles are cut into bounded ones (see ``_tiles``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import join_counted, lower_words, slices, stored, text_or_empty
from spindrift.llm.components import components
from spindrift.llm.prefilter import maybe_in, table_size

GOLDEN = 0x9E3779B97F4A7C15
#: Word hashes remembered by a task; the memory starts anew beyond this.
KNOWN_WORDS = 150_000
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(words: list[bytes], n: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; with fewer words, of the whole sequence as one; empty without words."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    count = len(words) - n + 1
    total = np.full(count, n, np.uint64)
    for i in range(n):
        total = mixed(total * np.uint64(GOLDEN) + hashes[i : i + count])
    return np.unique(total)


class Bands:
    """Size bands for linking at 100 * |x & y| >= percent * |x | y|: the smaller of two linked sets has at least percent / 100 of the larger's size."""

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent, self.ratio = percent, ratio

    def edges(self, band: int) -> tuple[int, int]:
        return int(self.ratio**band), int(self.ratio ** (band + 1))

    def of(self, n: int) -> list[int]:
        """Bands that a set of n elements stands in."""
        band = 0
        while self.edges(band)[1] <= n:
            band += 1
        return [band, band + 1] if 100 * n >= self.percent * self.edges(band)[1] else [band]


def lacking(n: int, percent: int) -> int:
    """How many of its n elements a set may lack in a linked one: it has at least percent / 100 of the larger one's in common."""
    return n - -(-percent * n // 100)


def spare(n: int) -> int:
    """How many of its smallest hashes a set of n elements counts beyond those that it may lack in a linked one."""
    return 1 + n // 10


def counted(sets: np.ndarray, percent: int) -> np.ndarray:
    """The smallest hashes of a set. Two sets share at least the lesser one's ``spare`` of these if they link: what
    both have in common is all that they have up to some hash, but for what either lacks."""
    return sets[: lacking(len(sets), percent) + spare(len(sets))]


def least_shared(n: int, percent: int) -> int:
    """How many of its counted hashes a set of n elements shares with any set it links with, which has at least percent / 100 of its size."""
    return spare(-(-percent * n // 100))


def _signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, cid, need, keys): cid is a 64-bit digest of the whole set and stands for all documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in slices(batches):
            sizes, cids, needs, keys = [], [], [], []
            for text in batch.column("text"):
                s = shingles(lower_words(text.as_py()), n, known)
                sizes.append(len(s))
                cids.append(digest(s))
                needs.append(least_shared(len(s), percent))
                keys.append(counted(s, percent).view(np.int64))
            columns = [pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), pa.array(needs, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "cid", "need", "keys"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, cid bigint, need bigint, keys array<bigint>")


def digest(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else np.uint64(0)
        return int(mixed(np.array([total + np.uint64(len(s)) * np.uint64(GOLDEN)], np.uint64)).view(np.int64)[0])


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(cid, s, size, bands): the sorted array of each text as bytes, its length and the size bands that it stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bands = _Words(), Bands(percent)
        for batch in slices(batches):
            found = [shingles(lower_words(t.as_py()), n, known) for t in batch.column("text")]
            columns = ([digest(s) for s in found], pa.int64()), ([s.tobytes() for s in found], pa.binary()), ([len(s) for s in found], pa.int64()), ([bands.of(len(s)) for s in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["cid", "s", "size", "bands"])

    return docs.select("text").mapInArrow(run, "cid bigint, s binary, size bigint, bands array<int>")


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words per set, about four bits an element of the largest."""
    words = 1 << max(0, int(np.ceil(np.log2(max(map(len, sets)) / 16))))
    maps = np.zeros((len(sets), words), np.uint64)
    for row, s in zip(maps, sets):
        bit = s & np.uint64(64 * words - 1)
        np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return maps


def links_of(pivot: int, others: np.ndarray, sets: list[np.ndarray], maps: np.ndarray, percent: int) -> np.ndarray:
    """Those of others that link with pivot."""
    if not len(others):
        return others
    a, sizes = sets[pivot], np.array([len(sets[o]) for o in others])
    near = np.minimum(sizes, len(a)) * 100 >= percent * np.maximum(sizes, len(a))
    others, sizes = others[near], sizes[near]
    if not len(others):
        return others
    # Each bit that one map has and the other lacks is an element that the other set lacks.
    mine = np.bitwise_count(maps[pivot] & ~maps[others]).sum(axis=1, dtype=np.int64)
    theirs = np.bitwise_count(maps[others] & ~maps[pivot]).sum(axis=1, dtype=np.int64)
    at_most = np.minimum(len(a) - mine, sizes - theirs)
    may = 100 * at_most >= percent * (len(a) + sizes - at_most)
    others, sizes = others[may], sizes[may]
    if not len(others):
        return others
    flat = np.concatenate([sets[o] for o in others])
    place = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    common = np.add.reduceat((a[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return others[100 * common >= percent * (len(a) + sizes - common)]


def search_tile(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join what links between sets of different labels, of each pair at least one in left."""
    maps = _bitmaps(sets)
    parent = {label: label for label in labels.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    seen = np.zeros(len(ids), bool)
    order = [int(i) for i in np.flatnonzero(left)]
    queue: list[int] = []
    done = np.zeros(len(ids), bool)
    while order or queue:
        pivot = queue.pop() if queue else order.pop()
        if done[pivot]:
            continue
        done[pivot] = seen[pivot] = True
        mine = root(int(labels[pivot]))
        others = np.array([o for o in np.flatnonzero(~done) if root(int(labels[o])) != mine], np.int64)
        for o in links_of(pivot, others, sets, maps, percent).tolist():
            a, b = root(int(labels[pivot])), root(int(labels[o]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((int(ids[pivot]), int(ids[o])))
            if left[o] and not seen[o]:
                seen[o] = True
                queue.append(o)
    return edges


def _keys(members: DataFrame, percent: int) -> DataFrame:
    """members (cid, s, size, bands) -> (k0, cid): for each band of a set, those of its rarest n-grams that another set has.

    ``lacking`` + 1 of a set's n-grams, in the order of their number of sets and then their hash, are its rarest; those
    that no other set has come first and need not be keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.frombuffer(raw.as_buffer(), np.int64) for raw in batch.column("s")]
            cid = np.repeat(batch.column("cid").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(cid)], ["k0", "cid"])

    grams = members.select("cid", "s").mapInArrow(run, "k0 bigint, cid bigint")
    common = stored(grams.groupBy("k0").agg(F.count("*").alias("n_rows")).filter("n_rows > 1"), "jaccard-common")
    met = join_counted(grams, common.withColumn("sets", F.col("n_rows")), ["k0"])
    of_set = met.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("sets", "k0"))).alias("shared")).join(members.select("cid", "size", "bands"), "cid")
    rarest = F.expr(f"size - (({percent} * size + 99) div 100) + 1 - (size - size(shared))")
    keys = of_set.select("cid", "bands", F.explode(F.slice("shared", F.lit(1), F.greatest(rarest, F.lit(0)).cast("int"))).alias("key"))
    return keys.select("cid", "key", F.explode("bands").alias("band")).select(F.xxhash64("key.k0", "band").alias("k0"), "cid")


def _stars(keys: DataFrame, fan: int = 64) -> DataFrame:
    """(u, v): edges that connect the sets (cid) of each key (k0). The sets of a key are dealt over ``fan`` groups, each a star, and the stars' centres are joined in another one."""
    dealt = keys.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(fan)))
    centres = stored(dealt.groupBy("k0", "salt").agg(F.min("cid").alias("centre"), F.count("*").alias("n_rows")), "jaccard-centres")
    first = centres.groupBy("k0").agg(F.min("centre").alias("first"), F.count("*").alias("n")).filter("n > 1")
    outer = join_counted(dealt.select("k0", "salt", "cid"), centres, ["k0", "salt"]).select(F.col("centre").alias("u"), F.col("cid").alias("v"))
    inner = centres.join(first, "k0").select(F.col("first").alias("u"), F.col("centre").alias("v"))
    return outer.unionByName(inner).filter("u <> v").distinct()


def _tile_edges(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """members: keys, cid, label, is_left, s -> (u, v): labels of sets that link."""

    def run(_, frame):
        frame = frame.sort_values("cid", kind="stable")
        sets = [np.frombuffer(s, np.uint64) for s in frame["s"]]
        label = frame["label"].to_numpy()
        edges = search_tile(label, label, sets, frame["is_left"].to_numpy(), percent)
        return pd.DataFrame(edges, columns=["u", "v"], dtype=np.int64)

    return members.groupBy(*keys).applyInPandas(run, "u bigint, v bigint")


def _tiles(members: DataFrame, percent: int, capacity: int) -> DataFrame:
    """(cid, label) for members (group, cid, s): sets of one label are joined by links inside their group.

    Groups of one tile (see ``link``) are searched whole. Larger ones are dealt over several tiles by hash,
    then the smallest set of each label found stands for it in a next round, as long as rounds join a quarter of what
    is left. What then still has several labels in a large group is compared exactly: all sets outside the group's
    largest label with all sets of the group, tile by tile.
    """
    members = members.withColumn("label", F.col("cid")).withColumn("is_left", F.lit(True))
    block = lambda of: F.pmod(F.xxhash64("cid"), F.col(of))
    found = stored(_tile_edges(members.withColumn("block", block("tiles")), ["group", "block"], percent), "jaccard-edges")
    labels = stored(components(found), "jaccard-labels")
    large = members.filter("tiles > 1")
    if not large.take(1):
        return labels
    in_tiles = lambda f: F.ceil(F.sum(F.octet_length(f)) / capacity).cast("bigint")
    left = None
    while True:
        now = stored(_labelled(large, labels), "jaccard-labelled")
        heads = now.filter("cid = label")
        several = heads.groupBy("group").agg(in_tiles("s").alias("tiles"), F.count("*").alias("heads")).filter("heads > 1")
        count = several.agg(F.sum("heads")).first()[0] or 0
        if count == 0 or (left is not None and count > 0.75 * left):
            break
        left = count
        heads = heads.drop("tiles").join(several, "group").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(left)), F.col("tiles")))
        labels = _merged(labels, _tile_edges(heads, ["group", "block"], percent))
    if count:
        sizes = now.groupBy("group", "label").count()
        giant = sizes.groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("giant"), F.count("*").alias("labels")).filter("labels > 1")
        rest = now.join(giant, "group").withColumn("block", block("tiles")).withColumn("is_left", F.col("label") != F.col("giant"))
        rest = rest.join(rest.filter("is_left").groupBy("group").agg(in_tiles("s").alias("cells")), "group").withColumn("cell", block("cells"))
        outer = rest.filter("is_left").withColumn("block", F.explode(F.expr("sequence(0L, tiles - 1)")))
        inner = rest.withColumn("is_left", F.lit(False)).withColumn("cell", F.explode(F.expr("sequence(0L, cells - 1)")))
        both = outer.unionByName(inner).groupBy("group", "block", "cell", "cid", "label").agg(F.max("is_left").alias("is_left"), F.first("s").alias("s"))
        labels = _merged(labels, _tile_edges(both, ["group", "block", "cell"], percent))
    return labels


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after edges between labels: components are sought among the labels alone, of which there are far fewer than nodes."""
    more = stored(components(stored(edges, "jaccard-edges")), "jaccard-merged")
    counts = labels.groupBy("label").agg(F.count("*").alias("n_rows"))
    above = stored(counts.join(more.select(F.col("node").alias("label"), F.col("label").alias("above")), "label"), "jaccard-above")
    moved = join_counted(labels, above, ["label"], "left").select("node", F.coalesce("above", "label").alias("label"))
    return stored(moved.unionByName(more.join(labels, "node", "left_anti").select("node", "label")), "jaccard-labels")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.drop("label").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _shared_counts(seen: DataFrame) -> DataFrame:
    """(cid, n): how many counted hashes of the set are in other sets too, summed over its copies.

    Read off the bit table of the shared hashes where there is one, which may count a few too many but moves nothing;
    where the table would be too large, by a join.
    """
    keys = seen.select(F.explode("keys").alias("k0"), "cid")
    shared = keys.groupBy("k0").agg(F.min("cid").alias("one"), F.max("cid").alias("other")).filter("one <> other")
    shared = stored(shared.select("k0"), "jaccard-shared")
    sifted = maybe_in(keys, shared).filter("maybe")
    if not table_size(shared.count()):
        sifted = stored(sifted.select("k0", "cid"), "jaccard-sifted")
        sifted = join_counted(sifted, sifted.groupBy("k0").agg(F.count("*").alias("n_rows")).join(shared, "k0"), ["k0"])
    return sifted.groupBy("cid").agg(F.count("*").alias("n"))


def link(docs: DataFrame, n: int = 5, percent: int = 80, capacity: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty texts, and texts
    without words, have no n-grams and link with nothing; texts of fewer than n words have one, the whole sequence. Rows that repeat are rows of one
    set; equal sets are one node however many documents have it. A null doc_id joins in but never names a component
    that has another id. doc_id is of an integer type. Hashes of 64 bits stand for n-grams and for sets.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    seen = stored(_signatures(docs, n, percent), "jaccard-sets")
    no_id = F.coalesce("doc_id", F.lit(-(2**63)))
    own = seen.filter("n_shingles > 0").groupBy("cid").agg(F.min(no_id).alias("first_id"), F.min("doc_id").alias("own_id"), F.count("*").alias("n_rows"), F.first("need").alias("need"))
    alive = stored(own.join(_shared_counts(seen), "cid").filter("n >= need * n_rows").drop("n", "need"), "jaccard-alive")
    wanted = stored(alive.select(F.col("first_id").alias("k0")).distinct(), "jaccard-wanted")
    texts = maybe_in(docs.select(no_id.alias("k0"), "text"), wanted).filter("maybe").join(wanted, "k0", "left_semi")
    members = stored(_sets(texts, n, percent).join(alive.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]), "jaccard-members")
    stars = stored(_stars(stored(_keys(members, percent), "jaccard-keys")), "jaccard-stars")
    groups = stored(components(stars), "jaccard-groups").select(F.col("node").alias("cid"), F.col("label").alias("group"))
    grouped = stored(members.select("cid", "s").join(groups, "cid"), "jaccard-grouped")
    totals = stored(grouped.groupBy("group").agg(F.ceil(F.sum(F.octet_length("s")) / capacity).cast("bigint").alias("tiles"), F.count("*").alias("n_rows")), "jaccard-totals")
    tiled = stored(join_counted(grouped, totals, ["group"]), "jaccard-tiled")
    labels = stored(_tiles(tiled, percent, capacity), "jaccard-links").select(F.col("node").alias("cid"), F.col("label").alias("linked"))
    # Ids of components are found among sets, and rows then look up their set's: neither gathers a set's copies.
    linked = stored(labels.join(alive, "cid"), "jaccard-linked")
    named = linked.groupBy("linked").agg(F.min("own_id").alias("component_id"), F.count("*").alias("n_rows"))
    named = join_counted(linked.select("cid", "linked", F.col("n_rows").alias("copies")), stored(named, "jaccard-names"), ["linked"]).select("cid", "component_id", F.col("copies").alias("n_rows"))
    # Sets without links take the smallest id of their copies.
    single = own.join(labels, "cid", "left_anti").filter("n_rows > 1").select("cid", F.col("own_id").alias("component_id"), "n_rows")
    named = stored(named.unionByName(single), "jaccard-components")
    rows = seen.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cid")).alias("k0"))
    sifted = stored(maybe_in(rows, named.select(F.col("cid").alias("k0"))), "jaccard-rows")
    met = join_counted(sifted.filter("maybe").select("doc_id", "n_shingles", F.col("k0").alias("cid")), named, ["cid"], "left")
    alone = sifted.filter("not maybe").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return met.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(alone)
