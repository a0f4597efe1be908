"""Line de-duplication by a segment-partition edit join, in DataFrame functions only.

A line of length n is cut into max_edits + 1 segments. If another line is within max_edits edits, at least one segment
of the shorter one stands unchanged in the longer one, shifted by no more than the edits allow; so every line gives the
substrings that could be such a segment, for its own length and each length it may have come from, as keys of the
length, the segment's number and the substring. Lines that share a key are candidates. Counts of letters rule most of
them out; a bit-parallel edit distance in the band of the threshold decides on the others.

In each key's group the line with the smallest digest is compared with all others first. Only lines that this leaves
standing are compared with the rest of their groups, inside the join, which keeps near pairs only. Large groups are
dealt over cells, so no task has all of one. Of the near pairs, the line with the smallest digest stays and those near it
go, then the smallest of what is left, and so on: a line that goes is always near one that stays. Lines near a first line
that went itself are compared again with what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import HEAVY, join_counted, stored
from spindrift.llm.prefilter import maybe_in, packed


def probes(max_edits: int) -> list[tuple[int, int, int]]:
    """(shorter, i, shift): which substrings of a line may be segment i of a line that is ``shorter`` characters shorter, and how far they are shifted."""
    parts = max_edits + 1
    return [
        (shorter, i, shift)
        for shorter in range(max_edits + 1)
        for i in range(1, parts + 1)
        for shift in range(max(-(i - 1), shorter - (parts - i)), min(i - 1, shorter + (parts - i)) + 1)
    ]


def segment_keys(lines: DataFrame, max_edits: int) -> DataFrame:
    """(h, k0) of lines (h, line, n): a row for each probe. One small expression a row, which the compiler takes well."""
    table = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("shorter", "i", "shift"), p)]) for p in probes(max_edits)])
    rows = lines.select("h", "line", "n", F.explode(table).alias("p")).withColumn("target", F.col("n") - F.col("p.shorter"))
    parts = max_edits + 1
    key = F.expr(f"xxhash64(p.i, target, substring(line, cast((p.i - 1) * target div {parts} as int) + 1 + p.shift, cast(p.i * target div {parts} - (p.i - 1) * target div {parts} as int)))")
    return rows.select("h", key.alias("k0"))


#: Letters counted to rule pairs out before their distance is computed: an edit changes the counts by two at most in all.
COUNTED = "eatinrsohdlu"
#: Lines that are looked at, about, to find out which keys are hot.
SEEN = 100_000
#: Lines of a key that one cell of its group holds, about.
CELL = 1000


def letter_counts(line: str) -> Column:
    return F.array(*[F.length(line) - F.length(F.translate(line, c, "")) for c in COUNTED])


def may_be_close(a: str, b: str, max_edits: int) -> Column:
    return sum((F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(len(COUNTED))), F.lit(0)) <= 2 * max_edits


def within(a: str, b: str, max_edits: int) -> Column:
    """Whether the edit distance of two text columns (of one character or more) is at most max_edits.

    The bits of a number stand for the cells of one column of the distance table that lie in the band of 2 * max_edits + 1
    diagonals: in ``vp`` those one more than the cell above them, in ``vn`` those one less. For each character of b,
    ``mask`` has a bit for each of the band's characters of a that equal it, and a few bit operations make the next
    column, whose band stands one row lower. ``score`` follows the band's lowest diagonal. Time and memory are in
    proportion to the lengths.
    """
    k, width = max_edits, 2 * max_edits + 1
    whole = (1 << width) - 1
    equal = " | ".join(f"if(get(p.a, j - {k + 1 - r}) = get(p.b, j - 1), {1 << r}, 0)" for r in range(width))
    masks = f"transform(sequence(1, size(p.b)), j -> {equal})"
    # Bound in turn, as one-element arrays, so that nothing is computed twice: d0, then hp.
    d0 = "((((mask & c.vp) + c.vp) ^ c.vp) | mask | c.vn)"
    hp = "(c.vn | ~(d0 | c.vp))"
    vp = f"(((d0 & c.vp) | ~(shiftright(d0, 1) | hp)) & {whole})"
    step = f"transform(array({d0} & {whole}), d0 -> transform(array({hp} & {whole}), hp -> named_struct('vp', {vp}, 'vn', shiftright(d0, 1) & hp, 'score', c.score + 1 - shiftright(d0, {width - 1})))[0])[0]"
    start = f"named_struct('vp', {((1 << (k + 1)) - 1) << k}, 'vn', 0, 'score', {k})"
    # The lowest diagonal ends below the last row; what lies between is taken off.
    below = f"({(1 << 2 * k) - 1} & ~(shiftleft(1, size(p.a) - size(p.b) + {k}) - 1))"
    last = f"c.score - bit_count(c.vp & {below}) + bit_count(c.vn & {below})"
    distance = f"aggregate({masks}, {start}, (c, mask) -> {step}, c -> {last})"
    return F.expr(f"transform(array(named_struct('a', split({a}, ''), 'b', split({b}, ''))), p -> if(abs(size(p.a) - size(p.b)) > {k}, {k} + 1, {distance}))[0] <= {k}")


#: Characters that make a line blank if it has no others.
BLANK = " \t\n\x0b\f\r"


def _lines(docs: DataFrame) -> DataFrame:
    """(k0, k1, pos, line, h, g): all lines but blank ones. k0 and k1 name a document; h and g name a line."""
    exploded = docs.select("k0", "k1", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.btrim("line", F.lit(BLANK)) != "")
    return exploded.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line"))


def _once(lines: DataFrame, distinct: DataFrame, min_chars: int) -> DataFrame:
    """(h, g, n, line): every line of min_chars characters or more once. Only lines that occur twice or more are moved."""
    rows = lines.select(F.struct("k0", "k1", "pos").alias("place"), F.col("h").alias("k0"), F.col("g").alias("k1"), F.length("line").alias("n"), "line").filter(F.col("n") >= min_chars)
    repeated = stored(distinct.filter("n_rows > 1").select(F.col("h").alias("k0"), F.col("g").alias("k1"), "first", "n_rows"), "lines-repeated")
    sifted = maybe_in(rows, repeated.select("k0", "k1"))
    maybe = stored(sifted.filter("maybe").drop("maybe"), "lines-maybe")
    firsts = join_counted(maybe, repeated, ["k0", "k1"], "left").filter(F.col("first").isNull() | (F.col("first") == F.col("place")))
    both = sifted.filter("not maybe").select("k0", "k1", "n", "line").unionByName(firsts.select("k0", "k1", "n", "line"))
    return stored(both.withColumnsRenamed({"k0": "h", "k1": "g"}), "lines-once")


def _hot_keys(lines: DataFrame, max_edits: int) -> DataFrame | None:
    """(k0) of keys that seem to have more than one in HEAVY of the rows, told from some lines; None if there are none.

    It decides only how rows are dealt. Keys that it misses are shuffled like all others.
    """
    some = segment_keys(lines.select("h", "line", "n").sample(min(1.0, SEEN / max(1, lines.count())), 5), max_edits)
    counts = stored(some.groupBy("k0").agg(F.count("*").alias("n")).filter("n > 20"), "lines-some")
    hot = counts.filter(F.col("n") > SEEN * len(probes(max_edits)) / HEAVY).select("k0")
    return hot if hot.take(1) else None


def _members(lines: DataFrame, max_edits: int) -> DataFrame:
    """(key, pivot, h): the lines of each key that several have, and the smallest of them."""
    keys, hot = segment_keys(lines.select("h", "line", "n"), max_edits), _hot_keys(lines, max_edits)
    # Dealt by key once, for the counts and for the join with them; the few shared keys of a partition are looked up, its many keys need no sort.
    light = (keys if hot is None else keys.join(F.broadcast(hot), "k0", "left_anti")).repartition("k0")
    ends = F.min("h").alias("pivot"), F.max("h").alias("last")
    shared = light.groupBy("k0").agg(*ends).filter("pivot <> last").select("k0", "pivot")
    members = light.join(shared.hint("shuffle_hash"), "k0")
    if hot is not None:
        # Rows of hot keys stay where they are: at most HEAVY pivots are found by partial sums and sent to them.
        heavy = keys.join(F.broadcast(hot), "k0", "left_semi")
        pivots = stored(heavy.groupBy("k0").agg(*ends).filter("pivot <> last").select("k0", "pivot"), "lines-hot")
        members = members.unionByName(heavy.join(F.broadcast(pivots), "k0"))
    return stored(members.select(F.col("k0").alias("key"), "pivot", "h").distinct(), "lines-members")


def decided(edges: DataFrame, asking: DataFrame) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(h) of lines that go, and the edges and asking lines still undecided, of edges (h, other) with other < h and asking (h), whose edges are not all known.

    A line stays once all its edges are known and none leads to a line that may stay; lines with an edge to it go. A line with edges from
    many others is met through ``join_counted``; digests are random, so the rounds grow with the logarithm of the lines.
    """
    gone = None
    while edges.take(1):
        blocked = edges.select(F.col("h").alias("other")).unionByName(asking.select(F.col("h").alias("other"))).distinct().withColumn("blocked", F.lit(True))
        others = stored(edges.groupBy("other").agg(F.count("*").alias("n_rows")).join(blocked, "other", "left"), "lines-others")
        free = others.filter("blocked is null").drop("blocked")
        if not free.take(1):
            break
        now = stored(join_counted(edges, free, ["other"]).select("h").distinct(), "lines-gone-now")
        gone = now if gone is None else gone.unionByName(now)
        asking = stored(asking.join(now, "h", "left_anti"), "lines-asking")
        left = stored(edges.join(now, "h", "left_anti"), "lines-edges")
        # A line that went drives out no other.
        staying = left.groupBy("other").agg(F.count("*").alias("n_rows")).join(now.withColumnRenamed("h", "other"), "other", "left_anti")
        edges = stored(join_counted(left, stored(staying, "lines-others"), ["other"]), "lines-edges")
    return gone, edges, asking


def _near(lines: DataFrame, max_edits: int) -> DataFrame:
    """lines (h, g, n, line) -> (h, g): those that go, each within max_edits of one that stays and has a smaller digest."""
    members = _members(lines, max_edits)
    wanted = stored(members.select(F.col("h").alias("k0")).distinct(), "lines-wanted")
    texts = maybe_in(lines.select(F.col("h").alias("k0"), "g", "line"), wanted).filter("maybe")
    texts = stored(texts.join(wanted, "k0", "left_semi").select(F.col("k0").alias("h"), "g", "line", letter_counts("line").alias("counts")), "lines-texts")
    others = texts.select(F.col("h").alias("other"), F.col("line").alias("other_line"), F.col("counts").alias("other_counts"))
    # As conditions of the joins, so that pairs too far apart are never made into rows.
    close = may_be_close("counts", "other_counts", max_edits) & (F.abs(F.length("line") - F.length("other_line")) <= max_edits) & within("line", "other_line", max_edits)
    asking, gone, edges, unknown = members, None, None, None
    while True:
        stars = stored(asking.filter("h <> pivot").select("h", F.col("pivot").alias("other")).distinct().join(texts, "h"), "lines-stars")
        pivots = stored(stars.groupBy("other").agg(F.count("*").alias("n_rows")).join(others, "other"), "lines-pivots")
        near = stored(join_counted(stars, pivots, ["other"]).filter(close).select("h", "other"), "lines-near")
        met = near.select("h").distinct()
        # A key of two lines is done with; so is one all of whose lines are near its first.
        sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 2").select("key", F.ceil(F.col("size") / CELL).cast("int").alias("cells"), F.col("size").alias("n_rows"))
        sizes = stored(sizes, "lines-sizes")
        standing = stored(join_counted(asking.filter("h <> pivot").join(met, "h", "left_anti"), sizes, ["key"]), "lines-standing")
        open_keys = stored(sizes.join(standing.select("key").distinct(), "key", "left_semi"), "lines-open")
        rest = join_counted(members.select("key", F.col("h").alias("other")), open_keys, ["key"]).withColumn("cell", F.expr("cast(pmod(xxhash64(other), cells) as int)")).drop("cells")
        dealt = standing.select("key", "pivot", "h", F.explode(F.expr("sequence(0, cells - 1)")).alias("cell"))
        both = dealt.join(texts, "h").join(rest.join(others, "other"), ["key", "cell"]).filter((F.col("other") < F.col("h")) & (F.col("other") != F.col("pivot")) & close)
        found = near.unionByName(both.select("h", "other")).distinct()
        edges = stored(found if edges is None else edges.unionByName(found).distinct(), "lines-edges")
        # Lines near a first line are not compared with others before that line is known to go.
        unknown = stored(met if unknown is None else unknown.join(asking.select("h"), "h", "left_anti").unionByName(met), "lines-unknown")
        now, edges, unknown = decided(edges, unknown)
        gone = gone if now is None else now if gone is None else gone.unionByName(now)
        again = stored(unknown.join(edges, "h", "left_anti"), "lines-again")
        if not again.take(1):
            break
        left = members.drop("pivot") if now is None else members.drop("pivot").join(now, "h", "left_anti")
        left = stored(left, "lines-left")
        heads = stored(left.groupBy("key").agg(F.min("h").alias("pivot"), F.count("*").alias("n_rows")).filter("n_rows > 1"), "lines-heads")
        members = stored(join_counted(left, heads, ["key"]), "lines-members")
        asking = stored(again.join(members, "h", "left").filter("key is not null"), "lines-asking")
        unknown = stored(unknown.join(again, "h", "left_anti"), "lines-unknown")
    if gone is None:
        return texts.select("h", "g").filter("false")
    return stored(texts.select("h", "g").join(gone.distinct(), "h", "left_semi"), "lines-near")


def dedup(docs: DataFrame, max_edits: int = 2, min_chars: int = 24) -> DataFrame:
    """The same rows and columns with repeated lines left out of ``text``, and n_lines, n_exact, n_near (long) added (in place of columns of these names).

    Lines are what ``\\n`` separates. Of equal lines the first stays, by document (doc_id, then the text's digest) and
    place, whatever their length; of lines within ``max_edits`` edits, one with a smaller digest drives out the others if it stays itself, so every line left out has one
    that stays within max_edits (or an equal one).
    Near are only lines of ``min_chars`` characters or more: in shorter ones, so many edits make another line. Blank lines always stay.
    n_exact counts lines left out as equal to an earlier one, n_near those left out as near another. A null text stays
    null with no lines; rows that repeat are one document and all get its text; null ids come first. doc_id is of an
    integer type. Digests of lines have 128 bits for equality and 64 where only candidates are meant.
    """
    named = packed(docs, F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")).withColumn("text", F.col("row.text"))
    texts = named.select("k0", "k1", "text")
    lines = _lines(texts)
    place = F.struct("k0", "k1", "pos")
    distinct = stored(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n_rows")), "lines-distinct")
    near = _near(_once(lines, distinct, min_chars), max_edits)
    marked = distinct.join(near.withColumn("near", F.lit(True)), ["h", "g"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    acted = stored(marked.filter("near or n_rows > 1").select(F.col("h").alias("k0"), F.col("g").alias("k1"), "first", "near", "n_rows"), "lines-acted")
    sifted = maybe_in(lines.select(place.alias("place"), F.col("h").alias("k0"), F.col("g").alias("k1")), acted.select("k0", "k1")).filter("maybe")
    sifted = stored(sifted.select("place", "k0", "k1"), "lines-sifted")
    gone = join_counted(sifted, acted, ["k0", "k1"]).filter(F.col("near") | (F.col("place") != F.col("first"))).select("place.*", "near")
    drops = gone.groupBy("k0", "k1").agg(F.collect_set("pos").alias("gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("pos")))).alias("near"))
    drops = stored(drops, "lines-gone")
    sifted = maybe_in(named, drops.select("k0", "k1"))
    nothing = sifted.filter(~F.col("maybe")).withColumn("gone", F.lit(None).cast("array<int>")).withColumn("near", F.lit(0))
    some = sifted.filter("maybe").join(drops, ["k0", "k1"], "left").select(nothing.columns)
    both = nothing.unionByName(some).withColumn("lines", F.split("text", "\n", -1)).withColumn("left", F.expr("array_except(sequence(0, size(lines) - 1), gone)"))
    new_text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    added = {"n_lines": count(F.size("lines")), "n_exact": count(F.size("gone") - F.col("near")), "n_near": count(F.col("near"))}
    kept = [new_text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return both.select(*kept, *[v.alias(k) for k, v in added.items()])
