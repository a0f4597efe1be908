"""Language-model scoring with Brown classes.

Training counts words over the whole training side in Spark. Every word with at least one in ``per`` of the training tokens is an item of
the clustering, and so are the endings of all rarer words, hashed to a bounded number; the corpus is then written once as
item numbers. Exchange clustering moves an item to the class that raises the average mutual information of neighbouring
classes most: first one by one among the most frequent items, whose bigram table is small, then for all items at once,
round by round, from Spark's counts of each item's neighbouring classes. Every word has one class by its item, known or not.

    p(text) = product of p(class | previous class) * p(word | class)

Transitions are smoothed towards the class's own share, emissions by one count more for each word of the class and one
for unknown words. The items' counts travel with the scoring task (a bounded table); counts of all other words are
joined, as (text, word) pairs summed up per text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import lower_words, stored, text_or_empty

END = b""  # no word is empty
#: Words a task counts before it hands the counts on.
FLUSH = 300_000
STRIP = b".,!?;:\"'()#*$%&|<>"


class Items(dict):
    """Word -> item: its own if frequent, else that of its ending. Remembers a bounded number of words."""

    def __init__(self, frequent: list[bytes], endings: int):
        super().__init__({END: 0} | {w: i + 1 for i, w in enumerate(frequent)})
        self.fixed, self.endings = dict(self), endings
        self.size = len(self.fixed) + endings

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
            self.update(self.fixed)
        item = self.fixed.get(word)
        if item is None:
            item = len(self.fixed) + self.ending(word)
        self[word] = item
        return item

    def ending(self, word: bytes) -> int:
        import zlib

        plain = word.strip(STRIP)
        return zlib.crc32(plain[-3:] + (b"\x00" if plain != word else b"")) % self.endings


def count_words(texts: DataFrame) -> DataFrame:
    """(word, h, c) over all texts, the end mark of each text included as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(lower_words(text.as_py()))
                if len(counts) > FLUSH:
                    yield out(counts)
                    counts.clear()
            counts[END] += batch.num_rows
        if counts:
            yield out(counts)

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")).select("word", F.xxhash64("word").alias("h"), "c")


def as_items(texts: DataFrame, frequent: list[bytes], endings: int, texts_a_block: int = 1000) -> DataFrame:
    """(n, planes): blocks of texts as item numbers, an end mark before, between and after them. The numbers' lowest bytes come first, then the next ones, as high bytes compress well."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, endings)
        for whole in batches:
            for batch in (whole.slice(at, texts_a_block) for at in range(0, whole.num_rows, texts_a_block)):
                words = [END]
                for text in batch.column("text"):
                    words += lower_words(text.as_py())
                    words.append(END)
                numbers = np.fromiter(map(items.__getitem__, words), np.uint32, len(words))
                yield pa.RecordBatch.from_arrays([pa.array([len(numbers)], pa.int64()), pa.array([numbers.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary())], ["n", "planes"])

    return texts.mapInArrow(run, "n bigint, planes binary")


def _numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for planes in batch.column("planes"):
        yield np.frombuffer(planes.as_buffer(), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)


def count_pairs(blocks: DataFrame, to: np.ndarray, size: int) -> np.ndarray:
    """How often items of one group are followed by those of another; ``to`` is each item's group, one of ``size``."""
    sent = blocks.sparkSession.sparkContext.broadcast(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size**2, np.int64)
        for batch in batches:
            for numbers in _numbers(batch):
                of = sent.value[numbers]
                np.add.at(total, of[:-1] * size + of[1:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total[at])], ["i", "j", "n"])

    cells = blocks.mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((size, size))
    counts[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("n").to_numpy()
    return counts


#: Items whose counts travel as one row.
TOGETHER = 1000


def count_neighbours(blocks: DataFrame, of: np.ndarray, classes: int) -> DataFrame:
    """(part, counts): for TOGETHER items a row, how often each is followed by each class, then how often each class precedes it, as 32-bit numbers; rows of a part are to be added up. A task holds two numbers an item and class."""
    sent = blocks.sparkSession.sparkContext.broadcast(of)
    width = 2 * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value) * width, np.int32)
        for batch in batches:
            for numbers in _numbers(batch):
                near = sent.value[numbers]
                np.add.at(total, numbers[:-1] * width + near[1:], 1)
                np.add.at(total, numbers[1:] * width + classes + near[:-1], 1)
        for part in range(-(-len(sent.value) // TOGETHER)):
            counts = total[part * TOGETHER * width : (part + 1) * TOGETHER * width]
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["part", "counts"])

    return blocks.mapInArrow(run, "part int, counts binary")


def added_up(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Item numbers and their summed counts, from all rows of the parts that a task has."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts")):
            counts = np.frombuffer(raw.as_buffer(), np.int32)
            totals[part] = totals[part] + counts if part in totals else counts.astype(np.int64)
    for part, counts in totals.items():
        counts = counts.reshape(-1, 2 * classes)
        yield part * TOGETHER + np.arange(len(counts)), counts


def gains(neighbours: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each item (row) and class: what the item's bigrams add to the mutual information in that class, at the class table as it stands.

    With n(k, j) the table, that is the sum of log(n(k, j) / left(k)) over the classes that follow the item and of
    log(n(j, k)) over those before it, less log(right(k)) for each of the latter: the change of
    sum n log n - sum left log left - sum right log right for a small item.
    """
    classes = len(table)
    smooth = table + 0.5
    after = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    before = np.log(smooth / smooth.sum(axis=0, keepdims=True))
    return neighbours[:, :classes] @ after.T + neighbours[:, classes:] @ before


def information(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def exchange_all(blocks: DataFrame, of: np.ndarray, classes: int, rounds: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of exchange of all items at once, from classes ``of``; the classes and the class table of the round with the most mutual information.

    The first round moves the items from number ``first`` on, the next ones every other item in turn, so that
    neighbours do not all move at the same time. The end mark keeps its class, which takes no other item.
    """
    best = None
    for at in range(rounds + 1):
        table = count_pairs(blocks, of, classes)
        if best is None or information(table) > best[0]:
            best = information(table), of, table
        if at == rounds:
            break
        sent = blocks.sparkSession.sparkContext.broadcast((of, table))

        def run(batches: Iterator[pa.RecordBatch], at: int = at, sent=sent) -> Iterator[pa.RecordBatch]:
            of, table = sent.value
            for item, counts in added_up(batches, classes):
                gain = gains(counts.astype(float), table)
                gain[:, 0] = -np.inf
                moving = (item > 0) & (item >= first if at == 0 else item % 2 == at % 2)
                own = of[item]
                chosen = gain.argmax(axis=1)
                better = moving & (gain[np.arange(len(item)), chosen] > gain[np.arange(len(item)), own] + 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(item[better].astype(np.int32)), pa.array(chosen[better].astype(np.int32))], ["item", "k"])

        # Rows of a part meet in one task, which adds them up as they come; each task of the counting sends one.
        parts = -(-len(of) // TOGETHER)
        moves = count_neighbours(blocks, of, classes).repartition(min(parts, 4096), "part").mapInArrow(run, "item int, k int").toArrow()
        of = of.copy()
        of[moves.column("item").to_numpy()] = moves.column("k").to_numpy()
    return best[1], best[2]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(counts: np.ndarray, classes: int, rounds: int = 6) -> np.ndarray:
    """Class of each item. counts[i, j]: how often item j follows item i.

    Starts with the most frequent items dealt over the classes in turn. The end mark, item 0, keeps a class of its own.
    """
    size = len(counts)
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    order = [int(i) for i in np.argsort(-weight, kind="stable") if i]
    of = np.zeros(size, np.int64)
    for rank, item in enumerate(order):
        of[item] = 1 + rank % (classes - 1)
    member = np.eye(classes)[of]
    table = member.T @ counts @ member
    for _ in range(rounds):
        moved = 0
        for w in order:
            if weight[w] == 0:
                continue
            own, twin = of[w], counts[w, w]
            out = np.bincount(of, counts[w], classes)  # to classes
            into = np.bincount(of, counts[:, w], classes)
            out[own] -= twin
            into[own] -= twin
            table[own] -= out
            table[:, own] -= into
            table[own, own] -= twin
            # Change of sum x log x over class bigrams, less that over the classes' sums, if w joins each class.
            rows = (_xlogx(table + out) - _xlogx(table)).sum(axis=1)
            columns = (_xlogx(table + into[:, None]) - _xlogx(table)).sum(axis=0)
            d = np.arange(classes)
            both = _xlogx(table[d, d] + out + into + twin) - _xlogx(table[d, d])
            alone = (_xlogx(table[d, d] + out) - _xlogx(table[d, d])) + (_xlogx(table[d, d] + into) - _xlogx(table[d, d]))
            left, right = table.sum(axis=1), table.sum(axis=0)
            sums = _xlogx(left + out.sum() + twin) - _xlogx(left) + _xlogx(right + into.sum() + twin) - _xlogx(right)
            gain = rows + columns - alone + both - sums
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            best = own if gain[best] <= gain[own] + 1e-9 else best
            table[best] += out
            table[:, best] += into
            table[best, best] += twin
            moved += best != own
            of[w] = best
        if moved * 100 < len(order):
            break
    return of


class Model:
    """What scoring needs of the training side; everything but the word table is of bounded size."""

    def __init__(self, words: DataFrame, train_tokens: int, vocabulary: int, frequent: list[bytes], counts: np.ndarray, endings: int, of: np.ndarray, transitions: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray):
        self.words, self.train_tokens, self.vocabulary = words, train_tokens, vocabulary
        self.frequent, self.counts, self.endings, self.of, self.transitions = frequent, counts, endings, of, transitions
        self.class_tokens, self.class_words = class_tokens, class_words


def fit(docs: DataFrame, classes: int = 48, per: int = 1_000_000, seeds: int = 600, endings: int = 300, rounds: int = 3, pull: float = 50.0) -> Model:
    """Learn from all rows of docs.

    Clustered are all words with two tokens and one in ``per`` of the tokens or more, so at most ``per`` words; of
    these, ``seeds`` start the classes. A word that is rarer has the class of its ending.
    """
    texts = docs.select(text_or_empty().alias("text"))
    words = stored(count_words(texts), "lm-words")
    train_tokens, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # At most ``per`` rows, by the threshold.
    table = words.filter((F.col("c") >= max(2.0, train_tokens / per)) & (F.octet_length("word") > 0)).select("word", "c").toArrow()
    ranked = sorted(zip(table.column("c").to_pylist(), map(bytes, table.column("word").to_pylist())), key=lambda x: (-x[0], x[1]))
    frequent, items = [w for _, w in ranked], Items([w for _, w in ranked], endings)
    blocks = stored(as_items(texts, frequent, endings), "lm-items")
    # The seeds and the endings are items of the first clustering; all other words are one more item there.
    seeds = min(seeds, len(frequent))
    to = np.full(items.size, seeds + 1)
    to[: seeds + 1] = np.arange(seeds + 1)
    to[len(frequent) + 1 :] = seeds + 2 + np.arange(endings)
    first = exchange(count_pairs(blocks, to, seeds + 2 + endings), classes)
    of = first[to]
    # A word that is no seed starts in the class of its ending.
    of[seeds + 1 : len(frequent) + 1] = [first[seeds + 2 + items.ending(w)] for w in frequent[seeds:]]
    of, pairs = exchange_all(blocks, of, classes, rounds, seeds + 1)
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + classes)
    transitions = np.log10((pairs + pull * share) / (pairs.sum(axis=1, keepdims=True) + pull))
    class_tokens, class_words = _class_sizes(words, frequent, endings, of, classes)
    ends = words.filter(F.octet_length("word") == 0).select("c").first()
    counts = np.array([ends.c if ends else 0, *(c for c, _ in ranked)], float)
    return Model(words, train_tokens, vocabulary, frequent, counts, endings, of, transitions, class_tokens, class_words)


def _class_sizes(words: DataFrame, frequent: list[bytes], endings: int, of: np.ndarray, classes: int) -> np.ndarray:
    """Tokens and distinct words of each class."""
    sent = words.sparkSession.sparkContext.broadcast((frequent, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value[0], endings)
        total = np.zeros((2, classes), np.int64)
        for batch in batches:
            line = sent.value[1][np.fromiter(map(items.__getitem__, batch.column("word").to_pylist()), np.int64, batch.num_rows)]
            total[0] += np.bincount(line, batch.column("c").to_numpy(), classes).astype(np.int64)
            total[1] += np.bincount(line, minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(total[0]), pa.array(total[1])], ["k", "tokens", "words"])

    found = words.select("word", "c").mapInArrow(run, "k bigint, tokens bigint, words bigint").groupBy("k").agg(F.sum("tokens"), F.sum("words")).collect()
    sizes = np.zeros((2, classes))
    for k, tokens, distinct in found:
        sizes[:, k] = tokens, distinct
    return sizes


def perplexity(scored: DataFrame) -> float | None:
    """Of scored texts by the class model, per token; none without tokens."""
    total, tokens = scored.agg(F.sum("score"), F.sum("n_tokens")).first()
    return 10 ** (-total / tokens) if tokens else None


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row per row of docs; a null text is empty, with the end mark alone.

    base_score: sum of log10((c + 1) / (N + V + 1)) over tokens; score: log10 probability under the class model. Rows
    that repeat are scored together and returned as often as they come. Counts of words that are no items are joined by
    a 64-bit hash.
    """
    m, spark = model, docs.sparkSession
    class_norm = np.log10(np.maximum(m.class_tokens + m.class_words + 1, 1))
    base_norm = float(np.log10(m.train_tokens + m.vocabulary + 1))
    sent = spark.sparkContext.broadcast((m.frequent, m.endings, m.of, m.transitions, m.counts, class_norm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, endings, of, transitions, counts, norm = sent.value
        items = Items(frequent, endings)
        log_c = np.log10(counts + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                yield lookups(whole.slice(at, 1000), items, of, transitions, counts, log_c, norm)

    def lookups(batch: pa.RecordBatch, items: Items, of: np.ndarray, transitions: np.ndarray, counts: np.ndarray, log_c: np.ndarray, norm: np.ndarray) -> pa.RecordBatch:
        """A row for each text (kind 0), and one for each of its distinct words whose count is to be joined (kind 1)."""
        import xxhash

        columns: list[list] = [[] for _ in range(8)]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            key = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
            words = [*lower_words(text), END]
            numbers = np.fromiter(map(items.__getitem__, words), np.int64, len(words))
            own = numbers[numbers < len(counts)]
            rest = Counter(words[i] for i in np.flatnonzero(numbers >= len(counts)).tolist())
            line = of[numbers]
            before = np.concatenate([of[:1], line[:-1]])
            fixed = float(transitions[before, line].sum() - norm[line].sum())
            for values in ((doc_id, key, 0, None, len(words), int((counts[own] > 0).sum()), float(log_c[own].sum()), fixed), *((doc_id, key, 1, w, n, 0, 0.0, 0.0) for w, n in rest.items())):
                for column, value in zip(columns, values):
                    column.append(value)
        types = (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "key", "kind", "word", "n", "known", "log_c", "fixed"])

    docs = docs.select("doc_id", text_or_empty().alias("text"))
    rows = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key bigint, kind int, word binary, n bigint, known bigint, log_c double, fixed double")
    # A text's own row joins nothing; its hash is that of its key, so such rows don't meet in one task.
    hashed = rows.withColumn("h", F.when(F.col("kind") == 1, F.xxhash64("word")).otherwise(F.xxhash64("key", "doc_id"))).drop("word")
    joined = hashed.join(m.words.select("h", "c"), "h", "left").withColumn("c", F.when(F.col("kind") == 1, F.col("c")))
    is_text = F.col("kind") == 0
    per_copy = lambda c: F.sum(c) / F.sum(is_text.cast("int"))
    summed = joined.groupBy("doc_id", "key").agg(
        F.sum(is_text.cast("int")).alias("copies"),
        per_copy(F.when(is_text, F.col("n"))).cast("bigint").alias("n_tokens"),
        per_copy(F.when(is_text, F.col("known")).when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).cast("bigint").alias("n_known"),
        per_copy(F.when(is_text, F.col("log_c")).otherwise(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1))).alias("log_c"),
        per_copy(F.col("fixed")).alias("fixed"),
    )
    rows = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", "n_tokens", "n_known", (F.col("log_c") - F.col("n_tokens") * base_norm).alias("base_score"), (F.col("log_c") + F.col("fixed")).alias("score"))
