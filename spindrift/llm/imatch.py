"""I-Match fingerprints in DataFrame functions only.

The terms of a text are its distinct words. A lexicon keeps the terms whose inverse document frequency lies in a band,
so neither the words of the language nor one-off misprints decide. Of each text the lexicon's terms are sorted and
hashed: all of them, as I-Match does, and those in each of several random subsets of the lexicon. A subset's hash
survives an edit that touches none of its terms, so the share of equal hashes tells how much two texts have in common.
Subsets come in three sizes (a 64th, a 256th and a 1024th of the lexicon), so that short and long texts both fill
some of them with few terms.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import stored, text_or_empty
from spindrift.llm.prefilter import maybe_in

#: Separators of words, as a pattern of both Java and DuckDB.
SPACE = r"[\x20\x09-\x0D]+"
#: A term is in the lexicon if at least one document in RARE and at most one in COMMON has it.
RARE, COMMON = 2000, 4
#: Bits of a term's number: the first 15 hexadecimal digits of its MD5.
BITS = 60
#: Bytes of text that a slot of the order of documents holds, about, and the largest number of slots.
SLOT_BYTES, SLOTS = 8 << 20, 10_000
#: Slots of the lexicon's table that are one entry of its outer list.
PAGE = 1024
NO_ID = -(2**63)


def words(text: Column) -> Column:
    """Distinct words of a text, A-Z lower-cased."""
    # lower() is the faster one, but also lowers letters beyond A-Z.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.array_distinct(F.split(lowered, SPACE)), "")


def number(word: Column) -> Column:
    """The number of a word as a term."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def lexicon(documents: DataFrame) -> DataFrame:
    """(key, term) of the words in the band, of documents (text), null texts as empty ones: a fast 64-bit hash to look them up by, and their number.

    Counts cover all documents. A document has few distinct words, so the terms that one in RARE has are fewer than
    RARE times their mean number, however many documents there are.
    """
    n = documents.select(F.count("*").alias("n"))
    counts = documents.select(F.explode(words(text_or_empty())).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    kept = counts.filter((F.col("df") * RARE >= n.scalar()) & (F.col("df") * COMMON <= n.scalar()))
    return kept.groupBy(F.xxhash64("word").alias("key")).agg(F.min(number(F.col("word"))).alias("term"))


class Lexicon:
    """A lexicon as one hash table, held by the tasks as the value of a session variable. Its size is bounded as ``lexicon`` says, whatever the corpus."""

    def __init__(self, kept: DataFrame):
        spark, kept = kept.sparkSession, stored(kept, "imatch-lexicon")
        self.slots = max(PAGE, 1 << max(0, (kept.count() - 1).bit_length()))
        self.name = f"lexicon_{uuid.uuid4().hex}"
        slot = F.col("key").bitwiseAND(F.lit(self.slots - 1))
        filled = kept.groupBy(slot.alias("slot")).agg(F.map_from_entries(F.collect_list(F.struct("key", "term"))).alias("terms"))
        # In two steps, as a map of all slots would be built a second time for every look into it.
        page = filled.groupBy(F.floor(F.col("slot") / PAGE).alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot") % PAGE, "terms"))).alias("m"))
        none = F.create_map().cast("map<bigint,bigint>")
        full = page.select("page", F.transform(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda i: F.coalesce(F.col("m")[i.cast("bigint")], none)).alias("lists"))
        numbers = spark.range(self.slots // PAGE).withColumnRenamed("id", "page")
        pages = stored(numbers.join(full, "page", "left").select("page", F.coalesce("lists", F.array().cast("array<map<bigint,bigint>>")).alias("lists")), "imatch-pages")
        # Pages in the order of their numbers.
        table = pages.agg(F.map_from_entries(F.collect_list(F.struct("page", "lists"))).alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(self.slots // PAGE - 1)), lambda p: F.col("m")[p.cast("bigint")]).alias("table"))
        view = f"{self.name}_rows"
        table.createTempView(view)
        spark.sql(f"declare variable {self.name} array<array<map<bigint,bigint>>>")
        spark.sql(f"set variable {self.name} = (select table from {view})")
        spark.catalog.dropTempView(view)

    def of(self, found: str) -> Column:
        """Sorted numbers of those of an array column of words that are in the lexicon; of all of them if none is."""
        place = lambda key, mask, shift: F.shiftright(key.bitwiseAND(F.lit(mask)), shift).cast("int")
        term = lambda key: F.get(F.get(F.expr(self.name), place(key, self.slots - 1, PAGE.bit_length() - 1)), place(key, PAGE - 1, 0))[key]
        kept = F.array_compact(F.transform(F.transform(F.col(found), lambda w: F.xxhash64(w)), term))
        return F.sort_array(F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, k).otherwise(F.transform(F.col(found), number)))[0])


def hashed(found: Column) -> Column:
    """The hash of sorted terms, '' for none."""
    return F.when(F.size(found) > 0, F.substring(F.md5(F.array_join(found.cast("array<string>"), ",").cast("binary")), 1, 8)).otherwise("")


def fingerprint(found: str) -> Column:
    """Hashes of a column of sorted terms: of all, then for each 64th of the lexicon of its terms, of those in a quarter and of those in a sixteenth of it."""
    part = lambda found, shift, width: F.filter(found, lambda t: t.bitwiseAND(F.lit(((1 << width) - 1) << shift)) == 0)
    # The sixteenth is a quarter of the quarter.
    sizes = lambda b: F.transform(F.array(part(b, 52, 2)), lambda q: F.transform(F.array(b, q, part(q, 50, 2)), hashed))[0]
    # A term's first six bits name its 64th, so the 64ths of sorted terms are slices of them, found by bisection.
    a, numbers = F.col(found), lambda n: F.sequence(F.lit(0), F.lit(n))
    steps = F.filter(F.array(*[F.lit(1 << s) for s in reversed(range(31))]), lambda s: s <= F.size(a))

    def cut(g: Column, steps: Column) -> Column:
        bound = F.shiftleft(g.cast("bigint"), BITS - 6)
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(a, at + s - 1) < bound, F.lit(False)), at + s).otherwise(at))

    cuts = F.transform(F.array(steps), lambda s: F.transform(numbers(64), lambda g: cut(g, s)))[0]
    of = lambda c: F.flatten(F.transform(numbers(63), lambda g: F.transform(F.array(F.slice(a, F.get(c, g) + 1, F.get(c, g + 1) - F.get(c, g))), sizes)[0]))
    return F.concat(F.array(hashed(a)), F.transform(F.array(cuts), of)[0])


def likeness(a: str, b: str) -> Column:
    """The share of equal hashes among those that either fingerprint has; 1 for two without terms."""
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "") | (y != "")), lambda f: f))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "") & (x == y)), lambda e: e))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal / filled)


def _below(bounds: Column, n: int, value: Column, inclusive: bool) -> Column:
    """How many of n sorted bounds lie below a value, by bisection."""
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(n.bit_length()))])

    def step(at: Column, s: Column) -> Column:
        bound = F.get(bounds, at + s - 1)
        return F.when((at + s <= n) & ((bound <= value) if inclusive else (bound < value)), at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """(k0, k1, text, times, next_text, and each other column with its next one) of docs (k0, k1, text, times), one row a key: the next row's, by ascending key; after the last, the first's.

    Rows are dealt over slots, which are ranges of k0; a k0 that has more rows than a slot takes is dealt further by k1. The
    first row of each slot is also sent to the slot before it. So every text is moved once, and no window spans more than a slot.
    """
    sizes = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()[0] or 0
    n = min(SLOTS, -(-sizes // slot_bytes))
    placed = docs.withColumn("slot", F.lit(0))
    if n > 1:
        cuts = docs.agg(F.percentile_approx("k0", [i / n for i in range(1, n)], 100_000)).first()[0]
        # Written as SQL text: one literal, however many cuts.
        bounds = F.expr(f"array({', '.join(f'{c}L' if c > NO_ID else f'({c + 1}L - 1L)' for c in cuts)})")
        first, after = _below(bounds, len(cuts), F.col("k0"), False), _below(bounds, len(cuts), F.col("k0"), True)
        share = F.greatest(F.lit(0.0), F.least(F.col("k1") / F.lit(2.0**64) + 0.5, F.lit(1 - 2.0**-53)))
        placed = docs.withColumn("_f", first).withColumn("_m", after - F.col("_f")).withColumn("slot", (F.col("_f") + F.floor(share * F.greatest(F.col("_m"), F.lit(1)))).cast("int")).drop("_f", "_m")
    heads = placed.groupBy("slot").agg(F.min(F.struct("k0", "k1")).alias("head"))
    # As many rows as there are slots.
    everywhere = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("slot").over(Window.orderBy("slot")), F.max("slot").over(everywhere))
    guests = stored(heads.select("head.*", before.alias("before")), "imatch-heads")
    seats = F.when(F.col("before").isNull(), F.array(F.struct("slot", F.lit(False).alias("guest")))).otherwise(F.array(F.struct("slot", F.lit(False).alias("guest")), F.struct(F.col("before").alias("slot"), F.lit(True).alias("guest"))))
    seated = placed.join(F.broadcast(guests), ["k0", "k1"], "left").withColumn("seat", F.explode(seats)).select(*docs.columns, "seat.*")
    return seated.repartition("slot")


def fingerprints(docs: DataFrame, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's, by ascending doc_id (null ids first), then by a digest of the text; after the last comes the first. Rows that
    repeat id and text are one document in this order and all get its values; a document alone is next to itself. A null text is an empty one. Texts without
    words have an empty fingerprint, and two of these are alike (1.0). Texts without a term of the lexicon are
    fingerprinted by all their terms. doc_id is of an integer type; other columns are left out. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k0"), text_or_empty().alias("text")).withColumn("k1", F.xxhash64("text"))
    lex = Lexicon(lexicon(rows))
    # Rows that repeat are looked for by their keys alone, and only these are gathered.
    repeated = stored(rows.groupBy("k0", "k1").count().filter("count > 1").select("k0", "k1"), "imatch-repeated")
    once = rows.withColumn("times", F.lit(1).cast("bigint"))
    if repeated.take(1):
        sifted = maybe_in(rows, repeated)
        gathered = sifted.filter("maybe").groupBy("k0", "k1").agg(F.first("text").alias("text"), F.count("*").alias("times"))
        once = sifted.filter("not maybe").select("k0", "k1", "text", F.lit(1).cast("bigint").alias("times")).unionByName(gathered)
    seated = with_next(once.select("k0", "k1", "text", "times"), slot_bytes)
    own = seated.withColumn("words", words(F.col("text"))).withColumn("kept", lex.of("words")).withColumn("mark", fingerprint("kept")).drop("words", "kept")
    order = Window.partitionBy("slot").orderBy("guest", "k0", "k1")
    both = own.withColumn("next_text", F.lead("text").over(order)).withColumn("next_mark", F.lead("mark").over(order)).filter("not guest")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = both.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    marked = edited.withColumn("words", words(F.col("edited"))).withColumn("kept", lex.of("words")).withColumn("edited_mark", fingerprint("kept"))
    doc_id = F.when(F.col("k0") > NO_ID, F.col("k0")).cast(kind).alias("doc_id")
    shown = lambda mark: F.array_join(mark, ",")
    result = marked.select(
        doc_id, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("mark").alias("fingerprint"), shown("edited_mark").alias("edited_fingerprint"),
        likeness("mark", "edited_mark").alias("near_edited"), likeness("mark", "next_mark").alias("near_next"), F.explode(F.expr("array_repeat(0, cast(times as int))")).alias("_"),
    )
    return result.drop("_")
