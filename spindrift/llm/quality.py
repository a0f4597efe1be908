"""Quality by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the counts of vote
patterns estimates how often each rule votes and is right on good and on bad documents, and the share of good ones; a document's
posterior probability of being good replaces the all-rules-must-pass filter. There are at most 3 ** rules patterns,
so what reaches the driver does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import stored, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
OTHERS = "0123456789.,;:!?'\"()-"
CAPITALS = "".join(chr(c) for c in range(0x100) if chr(c).isupper())
WINDOW = 8
#: Counted per text, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_letters")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of consecutive words found twice or more in the text, the first one included.

    Windows are numbered exactly by doubling: two halves' numbers make the number of a window twice as long.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        codes = codes[:-width] * (int(codes.max()) + 1) + codes[width:]
        codes = np.unique(codes, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(codes)[codes] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def counts_of(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    letters = len(text) - sum(map(text.count, OTHERS + SYMBOLS + SPACES))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(x.rstrip(SPACES)[-1] in ".!?\"'" for x in lines),
        sum(map(text.count, CAPITALS)),
        letters,
    )


def rules() -> dict[str, Column]:
    """Name -> vote. Bounds are parameters of the rules; a rule abstains where its measure says little."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_line = lambda c: F.col(c) / F.greatest(F.col("n_lines"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    capitals = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))
    return {
        "word_length": vote((per_word("word_chars") < 2.5) | (per_word("word_chars") > 12), per_word("word_chars").between(3, 9)),
        "symbols": vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.02),
        "dup_lines": vote(per_line("n_dup_lines") > 0.3, (F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0)),
        "repeats": vote(per_word("n_repeat_words") > 0.2, (F.col("n_words") >= 50) & (per_word("n_repeat_words") < 0.05)),
        "endings": vote((F.col("n_lines") >= 1) & (per_line("n_ended_lines") < 0.3), per_line("n_ended_lines") > 0.7),
        "capitals": vote(capitals > 0.5, capitals < 0.2),
    }


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS...), one row per input row; a null text is empty. Rows stay where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(counts_of(t.as_py()) for t in batch.column("text")))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *COUNTS])

    docs = docs.select("doc_id", text_or_empty().alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.mapInArrow(run, schema)


#: What is believed of a rule before any document is seen: worth so many votes in each class, so many of them right, and one abstention.
BELIEF, RIGHT = 4.0, 0.75


def monotone_ratios(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log ratios of the chances of votes -1, 0, 1 on good and on bad documents, from their weights there, never falling from -1 to 1.

    Neighbouring votes whose ratio falls are taken as one. As the ratios' mean over bad documents is one, a bad vote
    then never speaks for a document and a good vote never against it: each rule is better than chance or says nothing.
    """
    bad, good = bad / bad.sum(), good / good.sum()
    blocks: list[list[float]] = []
    for b, g in zip(bad, good):
        blocks.append([b, g, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] > blocks[-1][1] * blocks[-2][0]:
            b2, g2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b2, blocks[-1][1] + g2, blocks[-1][2] + n2]
    return np.array([np.log(g / b) for b, g, n in blocks for _ in range(n)])


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, most_false: float = 0.01, rounds: int = 60) -> tuple[float, np.ndarray]:
    """Share of good documents and, per rule, the log ratios of votes -1, 0, 1 (see monotone_ratios).

    Starts from "bad if any rule says bad". In turn, each document's chance of being good follows from the rules'
    ratios, and these from how often each vote, abstentions included, falls on good and on bad documents. No rule is
    taken to call more than ``most_false`` of the good documents bad: else the two classes might come to mean
    something else, and junk that a single rule sees would be good documents on which it errs.
    """
    if not patterns:
        return 0.5, np.zeros((n_rules, 3))
    votes, weight = np.array([p for p, _ in patterns]), np.array([float(n) for _, n in patterns])
    good = np.where((votes < 0).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        share = np.clip((weight * good).sum() / weight.sum(), 0.01, 0.99)
        ratio = np.zeros((n_rules, 3))
        for r in range(n_rules):
            seen = [np.bincount(votes[:, r] + 1, weight * m, 3) for m in (1 - good, good)]
            wrong_last = BELIEF * np.array([RIGHT, 0, 1 - RIGHT]) + np.array([0, 1, 0])
            bad, fine = seen[0] + wrong_last, seen[1] + wrong_last[::-1]
            fine[0] = min(fine[0], most_false * fine.sum())
            ratio[r] = monotone_ratios(bad, fine)
        logit = np.log(share / (1 - share)) + ratio[np.arange(n_rules), votes + 1].sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return float(share), ratio


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, ``p_good`` and ``kept`` for every row of docs.

    ``base_failed``: under 20 words, or over 30 % of the words repeated. ``kept`` is false if base_failed, else
    whether p_good reaches the threshold: a bad vote that the other rules outweigh does not reject. The rules are
    judged on documents that pass the base. Null and empty texts fail. Repeated rows get equal results; an empty table
    gives no rows.
    """
    votes = rules()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    seen = stored(measure(docs), "quality-counts").withColumns({f"vote_{k}": v for k, v in votes.items()})
    names = [f"vote_{k}" for k in votes]
    patterns = [(tuple(r[:-1]), r[-1]) for r in seen.filter(~failed).groupBy(names).count().collect()]
    share, ratio = estimate(patterns, len(names))
    logit = F.lit(float(np.log(share / (1 - share))))
    for name, (bad, none, good) in zip(names, ratio):
        logit += F.when(F.col(name) < 0, float(bad)).when(F.col(name) > 0, float(good)).otherwise(float(none))
    return seen.withColumn("p_good", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold))
