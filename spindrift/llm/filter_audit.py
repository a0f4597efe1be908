"""Audit of how filters interact, with decision diagrams.

Each row has a mask of the filters that it fails, a bit a filter. Per part, the masks are counted in Spark; the counts
are a function of the filters' outcomes and become an ordered decision diagram: a level for each filter, a pass and a
fail edge a node, equal subdiagrams shared, and each node weighted with the rows below it. Swapping two adjacent levels
gives the diagram of another order by relinking these two levels alone, and all orders follow from one another by such
swaps. In each order, the path of pass edges reads what every step keeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import join_counted, stored
from spindrift.llm.imatch import SPACE

FILTERS = "ABCDE"
Weight = tuple[int, ...]


class Diagram:
    """A count-weighted decision diagram over the outcomes of filters.

    A node is a number, with its two children (pass, fail) and its weight, the sum of theirs; a leaf has a weight only.
    Nodes with equal children are one. Levels are not skipped, so ``levels[i]`` names the filter that nodes at depth i ask for.
    """

    def __init__(self, n: int, counts: dict[int, Weight]):
        self.levels = list(range(n))
        self.weights: list[Weight] = []
        self.children: list[tuple[int, int] | None] = []
        self._nodes: dict[tuple, int] = {}
        zero = tuple(0 for _ in next(iter(counts.values()), (0,)))

        def build(depth: int, mask: int) -> int:
            if depth == n:
                return self._leaf(counts.get(mask, zero))
            return self._node(build(depth + 1, mask), build(depth + 1, mask | 1 << depth))

        self.root = build(0, 0)

    def _new(self, key: tuple, weight: Weight, children: tuple[int, int] | None) -> int:
        if key not in self._nodes:
            self._nodes[key] = len(self.weights)
            self.weights.append(weight)
            self.children.append(children)
        return self._nodes[key]

    def _leaf(self, weight: Weight) -> int:
        return self._new(("leaf", weight), weight, None)

    def _node(self, passed: int, failed: int) -> int:
        return self._new((passed, failed), tuple(map(sum, zip(self.weights[passed], self.weights[failed]))), (passed, failed))

    def swap(self, depth: int) -> None:
        """The levels at depth and depth + 1 change places. What lies below them stays; what lies above is linked anew."""
        known: dict[tuple[int, int], int] = {}

        def again(node: int, at: int) -> int:
            if (node, at) not in known:
                passed, failed = self.children[node]
                if at < depth:
                    known[node, at] = self._node(again(passed, at + 1), again(failed, at + 1))
                else:
                    (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
                    known[node, at] = self._node(self._node(pp, fp), self._node(pf, ff))
            return known[node, at]

        self.root = again(self.root, 0)
        self.levels[depth], self.levels[depth + 1] = self.levels[depth + 1], self.levels[depth]

    def path(self) -> list[tuple[Weight, Weight]]:
        """For each level in order, the weights that pass and fail it, of what passes all levels above."""
        out, node = [], self.root
        while self.children[node] is not None:
            passed, failed = self.children[node]
            out.append((self.weights[passed], self.weights[failed]))
            node = passed
        return out


def swaps(n: int) -> Iterator[int]:
    """Depths whose swaps, one after the other, lead through all orders of n levels once."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    for _ in range(math.factorial(n - 1)):
        # The last level wanders through all places; between its walks the others take a step, one lower if it stands on top.
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is not None:
            yield step + 1 if down else step
        down = not down


def all_orders(n: int, counts: dict[int, Weight]) -> list[tuple[tuple[int, ...], list[tuple[Weight, Weight]]]]:
    """Every order of the filters with the diagram's path of pass edges in it."""
    diagram = Diagram(n, counts)
    out = [(tuple(diagram.levels), diagram.path())]
    for depth in swaps(n):
        diagram.swap(depth)
        out.append((tuple(diagram.levels), diagram.path()))
    return out


def steps(names: str, counts: dict[int, Weight]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders; counts: mask -> (rows, good, toxic)."""
    orders = all_orders(len(names), counts)
    # What a filter fails in all stands first in its orders, and what it alone fails stands last.
    fails = {levels[0]: path[0][1][0] for levels, path in orders}
    alone = {levels[-1]: path[-1][1][0] for levels, path in orders}
    shapley = dict.fromkeys(range(len(names)), 0)
    for levels, path in orders:
        for f, (_, failed) in zip(levels, path):
            shapley[f] += failed[0]
    return [
        ("".join(names[f] for f in levels), at + 1, kept[0], lost[0], fails[f] - lost[0], alone[f], lost[1], lost[2], shapley[f])
        for levels, path in sorted(orders)
        for at, (f, (kept, lost)) in enumerate(zip(levels, path))
    ]


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of masks (part, mask, n, good, toxic).

    A row stands for n documents. Bit i of a mask tells that they fail filter names[i]; a null mask fails none. good and toxic (booleans, null: false) mark what
    is counted as lost. A null part is the empty string. Rows that repeat count as often as they stand. Only counts
    by part and mask are gathered: at most two to the number of filters for each part, whatever its rows. An empty table gives no rows.
    """
    flag = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    counts = masks.groupBy(F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce("mask", F.lit(0)).cast("int").alias("mask")).agg(F.sum("n").alias("n"), flag("good"), flag("toxic"))
    fields = "filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = steps(names, {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in frame.itertuples()})
        columns = [f.split()[0] for f in fields.split(", ")]
        return pd.DataFrame(found, columns=columns).assign(part=key[0])[["part", *columns]]

    return counts.groupBy("part").applyInPandas(run, f"part string, {fields}")


def content_filters(text: Column) -> list[Column]:
    """Failures of filters A to D: under 100 words; under 80 % of the words distinct; over 10 % of the code points A-Z; a symbol of ``#$%&*|``."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)).cast("bigint") < 80 * F.size(words).cast("bigint"),
        100 * capitals.cast("bigint") > 10 * F.length(text).cast("bigint"),
        text.rlike(r"[#$%&*|]"),
    ]


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of docs (doc_id, text, lang); labels: (doc_id, quality, toxic). n documents have the row's values.

    Filter E is failed by a document whose text equals that of a smaller doc_id anywhere in the table. A null text is an empty one, and equal to empty ones; a
    null doc_id is not smaller or larger than any and has no label. Of repeated labels, one with quality 1 or toxic 1 is enough. Digests of 128 bits stand for
    texts. Other columns are left out.
    """
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(content_filters(text))), F.lit(0))
    rows = docs.select("doc_id", F.col("lang").alias("part"), mask.alias("mask"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    rows = stored(rows, "audit-rows")
    groups = rows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")).filter("n_rows > 1")
    copied = join_counted(rows, stored(groups, "audit-groups"), ["h", "g"], "left")
    repeats = F.when(F.col("first") < F.col("doc_id"), 1 << len(FILTERS) - 1).otherwise(0)
    # Rows of one id are summed up before they look for its label, so an id that many have moves no more than any other.
    summed = copied.groupBy("doc_id", "part", (F.col("mask") + repeats).alias("mask")).agg(F.count("*").alias("n"))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return summed.join(known, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
