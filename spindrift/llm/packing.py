"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt by hash over shards of bounded size. Of a shard's best-fit plan, bins without room stay; all other
pieces are bred on several islands, each a row of its own with its own seed, unless no plan could have fewer bins. A
plan is a set of bins; crossover injects whole well-filled bins of one parent into the other, removes the bins that held one of
their pieces, lets displaced pieces replace smaller ones where that fills a bin better, and puts the rest back by best
fit, largest first. After each epoch the islands of a shard exchange their best plans through a shuffle, and the best
plan of the last epoch is the shard's. The pieces of underfilled sequences of all shards are then packed again
together. Only lengths travel; ids never do.
"""

from __future__ import annotations

import json
import random
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import slices, stored, text_or_empty

#: Words whose ids a task remembers; the memory starts anew beyond this.
KNOWN_WORDS = 250_000
#: Below this code point (dotted capital I aside), lower-casing a whole text equals lower-casing its characters.
PLAIN_BELOW = 0x250
#: White space to Python but not to the tokenizer, and the byte that marks the end of a word here.
SEPARATORS = "\x1c\x1d\x1e\x1f\0"
MARK = "</w>"  # the end of a word in the vocabulary


@lru_cache(maxsize=2)
def _model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


# How a tokenizer must treat text before its merges for its words to be looked up one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [{"type": "Split", "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def _reads_words(path: str) -> bool:
    """Whether the file normalises as NORMALIZERS say and then keeps what a pattern finds, one that neither finds nor looks at white space around it."""
    whole = _model(path)
    normalizers, splitters = ((whole.get(k) or {}).get(k2, []) for k, k2 in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    if normalizers != NORMALIZERS or [{k: v for k, v in x.items() if k != "pattern"} for x in splitters] != SPLITTERS or whole.get("post_processor"):
        return False
    import regex

    pattern = splitters[0]["pattern"].get("Regex", "")
    probe = "".join(c + x + c + c for c in " \t\n\r\x0b\x0c\x85\xa0\u2003" for x in ("a", "é", "1", "!", "'s", "'", "a1!"))
    looks = ("(?", "$", "\\b", "\\B", "\\A", "\\Z")
    return not any(x in pattern for x in looks) and "^" not in pattern.replace("[^", "") and not any(c.isspace() for m in regex.finditer(pattern, probe) for c in m[0])


@lru_cache(maxsize=2)
def by_ranks(path: str) -> bool:
    """Whether merging the neighbours whose union comes first in the vocabulary gives the same ids as the merge list.

    It does if the merges before each one, applied to its union alone, leave just its two halves. This is tried for
    every merge of the file. Other kinds of tokenizers go through their library text by text.
    """
    if not _reads_words(path):
        return False
    model = _model(path)["model"]
    if model.get("end_of_word_suffix") != MARK or model.get("ignore_merges") or model.get("dropout"):
        return False
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    first = len(model["vocab"]) - len(merges)
    rank = {pair: i for i, pair in enumerate(merges)}
    for i, (left, right) in enumerate(merges):
        if model["vocab"].get(left + right) != first + i:
            return False
        parts = list((left + right).removesuffix(MARK))
        if right.endswith(MARK):
            parts[-1] += MARK
        while len(parts) > 1:
            least = min(rank.get(pair, i) for pair in zip(parts, parts[1:]))
            if least >= i:
                break
            joined: list[str] = []
            for part in parts:
                if joined and rank.get((joined[-1], part)) == least:
                    joined[-1] += part
                else:
                    joined.append(part)
            parts = joined
        if parts != [left, right]:
            return False
    return True


class _Ids(dict):
    """Word (what white space separates) -> its ids as bytes of little-endian unsigned 32-bit numbers.

    With ``fast``, words are split as the tokenizer does and merged by rank, the end of a word being a zero byte.
    """

    def __init__(self, path: str, fast: bool):
        import regex
        import tiktoken

        super().__init__()
        self.path, self.fast, self.tokenizer = path, fast, None
        if fast:
            names = _byte_names()
            raw = {}
            for token, at in _model(path)["model"]["vocab"].items():
                if all(c in names for c in token.removesuffix(MARK)):
                    raw[bytes(names[c] for c in token.removesuffix(MARK)) + b"\0" * token.endswith(MARK)] = at
            splits = _model(path)["pre_tokenizer"]["pretokenizers"]
            self.splitter = regex.compile(next(s["pattern"]["Regex"] for s in splits if s["type"] == "Split"))
            self.ranks = tiktoken.Encoding("ranks", pat_str=r"[^\x00]*\x00", mergeable_ranks=raw, special_tokens={})
            _model.cache_clear()  # a large table, not needed any more

    def whole(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > KNOWN_WORDS:
            self.clear()
        parts = self.splitter.findall(word)
        ids = self[word] = np.array(self.ranks.encode_ordinary("\0".join(parts) + "\0"), "<u4").tobytes() if parts else b""
        return ids


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow from code point 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) not in " \xa0\xad"]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _known(path: str, fast: bool) -> _Ids:
    return _Ids(path, fast)


def _is_plain(text: str) -> bool:
    if "<|" in text or any(c in text for c in SEPARATORS):
        return False
    return text.isascii() or (max(text) < chr(PLAIN_BELOW) and "\u0130" not in text)


def ids_of(text: str, path: str, fast: bool) -> bytes:
    """Ids of the text without special tokens.

    The vocabulary never merges over white space, so with ``fast`` (see by_ranks) each word's ids are looked up. Texts
    with characters outside the plain range, or with something like a special token, go through the tokenizer whole.
    """
    known = _known(path, fast)
    text = unicodedata.normalize("NFC", text)
    return b"".join(map(known.__getitem__, text.lower().split())) if fast and _is_plain(text) else known.whole(text)


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut into pieces of ``size``.

    A null text is empty and is one piece, the end id. Rows stay where they are read and repeated rows stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches, 2000):
            rows, numbers, starts, lengths, sums, raw = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = ids_of(text.as_py(), tokenizer, fast) + end
                for number, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(raw, pa.binary())] if with_ids else [])], [*names])

    fast = by_ranks(tokenizer)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return docs.mapInArrow(run, schema)


Plan = list[list[int]]


def fill(bin_: list[int], lengths: list[int]) -> int:
    return sum(lengths[i] for i in bin_)


def best_fit(items: list[int], lengths: list[int], size: int, bins: Plan) -> Plan:
    """Add items, in the order given, each to the bin with the least room that still holds it."""
    room = [(size - fill(b, lengths), n) for n, b in enumerate(bins)]
    room.sort()
    for item in items:
        at = bisect_left(room, (lengths[item], -1))
        if at < len(room):
            left, n = room.pop(at)
            bins[n].append(item)
        else:
            left, n = size, len(bins)
            bins.append([item])
        if left > lengths[item]:
            insort(room, (left - lengths[item], n))
    return bins


def decreasing(items: list[int], lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: -lengths[i])


def fitness(plan: Plan, lengths: list[int], size: int) -> tuple[int, int]:
    """Fewer bins first, then fuller ones (a larger sum of squared fills)."""
    return len(plan), -sum(fill(b, lengths) ** 2 for b in plan)


def put_back(displaced: list[int], bins: Plan, lengths: list[int], size: int) -> Plan:
    """Displaced items first take the place of one or two smaller ones where a bin is filled better by it; what is then displaced goes in by best fit."""
    loose = sorted((lengths[i], i) for i in displaced)
    for n in sorted(range(len(bins)), key=lambda n: -fill(bins[n], lengths)):
        b = bins[n]
        room = size - fill(b, lengths)
        if not room or not loose or len(b) > 12:
            continue
        best = (0, None, ())
        for out in (*((x,) for x in b), *combinations(b, 2)):
            given = sum(lengths[x] for x in out)
            at = bisect_left(loose, (room + given + 1, -1)) - 1
            if at >= 0 and loose[at][0] - given > best[0]:
                best = (loose[at][0] - given, at, out)
        if best[2]:
            bins[n] = [x for x in b if x not in best[2]] + [loose.pop(best[1])[1]]
            for x in best[2]:
                insort(loose, (lengths[x], x))
    return best_fit([i for _, i in reversed(loose)], lengths, size, bins)


def cross(one: Plan, other: Plan, lengths: list[int], size: int, rng: random.Random, least_fill: float = 0.98) -> Plan:
    """other, with some well-filled bins of one injected whole; bins that hold one of their items are removed, and what that displaces is put back."""
    full = [b for b in one if fill(b, lengths) >= least_fill * size]
    chosen = rng.sample(full, max(1, len(full) // 3)) if full else []
    taken = {i for b in chosen for i in b}
    kept, displaced = [], []
    for b in other:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return put_back(displaced, [*map(list, chosen), *kept], lengths, size)


def mutate(plan: Plan, lengths: list[int], size: int, rng: random.Random) -> Plan:
    """Empty the worst-filled bin and a few others, and put their items back."""
    worst = min(range(len(plan)), key=lambda n: fill(plan[n], lengths))
    gone = {worst, *(rng.randrange(len(plan)) for _ in range(1 + len(plan) // 30))}
    return put_back([i for n in gone for i in plan[n]], [list(b) for n, b in enumerate(plan) if n not in gone], lengths, size)


def breed(lengths: list[int], size: int, seed: int, elites: list[Plan], population: int, generations: int) -> Plan:
    """One epoch on one island; starts from best-fit plans of differently shuffled orders and the elites it was sent.

    Each generation crosses the better of two drawn plans with another, mutates the child now and then and puts it in
    the place of the worst plan. Ends early when a plan has as few bins as the sum of lengths needs.
    """
    rng = random.Random(seed)
    least = -(-sum(lengths) // size)
    rate = lambda p: (fitness(p, lengths, size), p)
    plans = [rate([list(b) for b in e]) for e in elites[:population]]
    while len(plans) < population:
        jitter = 0.25 * len(plans) / population
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + jitter * rng.random()))
        plans.append(rate(best_fit(order, lengths, size, [])))
    for _ in range(generations):
        plans.sort(key=lambda p: p[0])
        if plans[0][0][0] <= least:
            break
        one, other = (plans[min(rng.randrange(len(plans)), rng.randrange(len(plans)))][1] for _ in range(2))
        child = cross(one, other, lengths, size, rng)
        plans[-1] = rate(mutate(child, lengths, size, rng) if rng.random() < 0.7 else child)
    return min(plans, key=lambda p: p[0])[1]


def settle(lengths: list[int], size: int, seed: int, reopened: float = 0.1) -> tuple[Plan, list[int]]:
    """Bins that stay, and the items left to breed: of a best-fit plan the bins without room stay, but for a share of them whose items help the others to mix. All stay if no plan can have fewer."""
    plan = best_fit(decreasing(list(range(len(lengths))), lengths), lengths, size, [])
    if len(plan) <= -(-sum(lengths) // size):
        return plan, []
    rng = random.Random(seed)
    stay = [fill(b, lengths) == size and (len(b) == 1 or rng.random() >= reopened) for b in plan]
    return [b for b, s in zip(plan, stay) if s], sorted(i for b, s in zip(plan, stay) if not s for i in b)


def _numbers(plan: Plan, n: int) -> list[int]:
    """The bin of each of n items, -1 where it has none."""
    of = [-1] * n
    for number, members in enumerate(plan):
        for item in members:
            of[item] = number
    return of


def _bins(of: list[int]) -> Plan:
    plan: Plan = [[] for _ in range(max(of, default=-1) + 1)]
    for item, number in enumerate(of):
        plan[number].append(item)
    return plan


def _settled(shards: DataFrame, size: int) -> DataFrame:
    """(shard, lengths) -> with settled (the bin of each item, -1 for open ones) and open (lengths of the open ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            settled, opened = [], []
            for shard, lengths in zip(batch.column("shard").to_pylist(), batch.column("lengths").to_pylist()):
                plan, items = settle(lengths, size, shard)
                settled.append(_numbers(plan, len(lengths)))
                opened.append([lengths[i] for i in items])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(settled, pa.list_(pa.int32())), pa.array(opened, pa.list_(pa.int64()))], ["shard", "lengths", "settled", "open"])

    return shards.select("shard", "lengths").mapInArrow(run, "shard bigint, lengths array<bigint>, settled array<int>, open array<bigint>")


def _epoch(islands: DataFrame, size: int, population: int, generations: int) -> DataFrame:
    """islands: shard, island, open, seed, elites (array of plans, each one bin number per item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = []
            for lengths, seed, elites in zip(batch.column("open").to_pylist(), batch.column("seed").to_pylist(), batch.column("elites").to_pylist()):
                best = breed(lengths, size, seed, [_bins(e) for e in elites], population, generations)
                plans.append((_numbers(best, len(lengths)), *fitness(best, lengths, size)))
            columns = [pa.array(x, t) for x, t in zip(list(zip(*plans)) or [[]] * 3, (pa.list_(pa.int32()), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("island"), batch.column("open"), *columns], ["shard", "island", "open", "plan", "bins", "spread"])

    return islands.mapInArrow(run, "shard bigint, island int, open array<bigint>, plan array<int>, bins bigint, spread bigint")


def _plans(settled: DataFrame, shards: int, size: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """(shard, plan, room): the bin of each item, and the room that is left in it."""
    # A number of tasks of our own: only lengths travel, and adaptive execution would breed many islands in one task.
    tasks = min(shards * islands, 4096)
    now = settled.filter("size(open) > 0").select("shard", "open", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.expr("cast(array() as array<array<int>>)").alias("elites"))
    for epoch in range(epochs):
        dealt = now.withColumn("seed", F.xxhash64("shard", "island", F.lit(epoch))).repartition(tasks, "shard", "island")
        bred = _epoch(dealt.select("shard", "island", "open", "seed", "elites"), size, population, generations)
        best = bred.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bins", "spread", "island", "plan"))).alias("best"), F.first("open").alias("open"))
        if epoch < epochs - 1:
            now = best.select("shard", "open", F.explode("best.island").alias("island"), F.expr("transform(best, x -> x.plan)").alias("elites"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans, rooms = [], []
            for lengths, of, own in zip(batch.column("lengths").to_pylist(), batch.column("settled").to_pylist(), batch.column("bred").to_pylist()):
                first, bred = max(of, default=-1) + 1, iter(own or ())
                of = [n if n >= 0 else first + next(bred) for n in of]
                used = np.bincount(np.array(of, np.int64), np.array(lengths, float)) if of else np.zeros(0)
                plans.append(of)
                rooms.append([size - int(used[n]) for n in of])
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(plans, pa.list_(pa.int32())), pa.array(rooms, pa.list_(pa.int64()))], ["shard", "plan", "room"])

    joined = settled.join(best.select("shard", F.expr("best[0].plan").alias("bred")), "shard", "left").select("shard", "lengths", "settled", "bred")
    return joined.mapInArrow(run, "shard bigint, plan array<int>, room array<bigint>")


def pack(
    cut: DataFrame,
    size: int = 2048,
    shard_pieces: int = 8000,
    islands: int = 3,
    epochs: int = 2,
    population: int = 8,
    generations: int = 25,
    least_fill: float = 0.98,
) -> DataFrame:
    """Add sequence_id and offset (in place of columns of these names) to a table of pieces with a ``length`` of at most ``size``; other columns stay.

    Every piece is placed, offsets of a sequence run from 0 without gaps, and no sequence exceeds size. Pieces of
    sequences filled to less than ``least_fill`` of size are dealt anew over fewer shards and packed again, until one
    shard is left or most pieces stay in such sequences; so it is the last shard, not each, that leaves some sequences partly
    filled. Pieces that repeat are placed each. An empty table gives no rows.
    """
    columns = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    pending = stored(cut.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")), "packing-pieces")
    count, done = pending.count(), []
    while True:
        shards = max(1, -(-count // shard_pieces))
        # The hash of the whole row deals; what is equal in all columns is dealt on by a random number, kept by the written table.
        dealt = pending.withColumn("shard", F.pmod(F.xxhash64("row", F.floor(F.rand(11) * shards)), F.lit(shards)))
        whole = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("row.length").alias("key"), "row"))).alias("items"))
        whole = stored(whole.select("shard", "items", F.expr("transform(items, x -> x.key)").alias("lengths")), "packing-shards")
        settled = stored(_settled(whole, size), "packing-settled")
        plans = stored(_plans(settled, shards, size, islands, epochs, population, generations), "packing-plans")
        placed = whole.join(plans, "shard").select("shard", F.expr("inline(transform(items, (x, i) -> struct(x.row as row, plan[i] as bin, room[i] as room, i as at)))")).withColumn("level", F.lit(len(done)))
        if shards == 1:
            done.append(placed)
            break
        loose = F.col("room") > (1 - least_fill) * size
        left = stored(placed.filter(loose).select("row"), "packing-loose")
        left_count = left.count()
        if 2 * left_count > count:
            done.append(placed)
            break
        done.append(placed.filter(~loose))
        if not left_count:
            break
        pending, count = left, left_count
    every = reduce(DataFrame.unionByName, done)
    in_bin = "over (partition by level, shard, bin order by at rows between unbounded preceding and 1 preceding)"
    number = F.col("level").cast("long") * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 20) + F.col("bin")
    return every.select(*[F.col("row")[c].alias(c) for c in columns], number.alias("sequence_id"), F.expr(f"coalesce(sum(row.length) {in_bin}, 0L)").alias("offset"))
