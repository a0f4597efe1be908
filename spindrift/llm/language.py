"""Language identification by Bayesian evidence fusion.

For every row the log evidence for each language is the sum of
  - the text's likelihood under byte-trigram models (tempered, as trigrams overlap and repeat),
  - the declared markup language, believed to be right with a fixed chance,
  - the address suffix (country domain or a path part that names a language), likewise,
  - the prior of its host, smoothed towards that of its domain, that one towards the corpus.
Host, domain and corpus priors are grouped sums of the rows' posteriors without any prior. A row's own share is taken out
of its host's and its domain's, as it counts already.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import join_counted, slices, stored

BUCKETS = 1 << 16
#: Chance that a declared language, or one that the address names, is the text's.
DECLARED_RIGHT, ADDRESS_RIGHT = 0.9, 0.8
# Country suffixes that name one of the usual languages.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
# Labels under a country's domain that are not names of their own.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ne", "net", "or", "org")
CLOSING = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
OPENING = re.compile(r"(?i)<(script|style)\b")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the text's byte trigrams; runs of white space, digits and punctuation are one blank, A-Z lower-cased."""
    raw = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    raw = np.where((raw >= 97) & (raw <= 122) | (raw >= 128), raw, 32)
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    return ((raw[:-2] * 961 + raw[1:-1]) * 31 + raw[2:]) * 40503 % BUCKETS if len(raw) > 2 else np.zeros(0, np.int64)


def plain(html: str) -> str:
    """The text between tags, its entities decoded; scripts, styles and comments are left out, each as far as its end, or its tag alone if it has none.

    One pass: an end that was once looked for in vain is not looked for again.
    """
    out, at, without_end = [], 0, set()
    while (start := html.find("<", at)) >= 0:
        end = -1
        if (opened := OPENING.match(html, start)) and (name := opened[1].lower()) not in without_end:
            closed = CLOSING[name].search(html, opened.end())
            end = closed.end() if closed else -1
            if not closed:
                without_end.add(name)
        elif html.startswith("<!--", start) and "<!--" not in without_end:
            end = html.find("-->", start + 4) + 3
            if end < 3:
                end = -1
                without_end.add("<!--")
        if end < 0:
            end = html.find(">", start) + 1
            if not end:
                break
        out += [html[at:start], " "]
        at = end
    return markup.unescape("".join([*out, html[at:]]))


class Model:
    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p


def fit(labelled: DataFrame, rows: int = 8000) -> Model:
    """Trigram shares of each language, from about ``rows`` random rows of (text, lang), all if there are fewer; rows without a language or a text are left out."""
    usable = labelled.select("text", "lang").filter("text is not null and lang is not null")
    # Rows are drawn where they are read: no text is moved to choose among them.
    sample = usable.sample(min(1.0, rows / max(1, usable.count())), seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "k", "n"])

    cells = sample.mapInArrow(run, "lang string, k bigint, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(cells["lang"].unique())
    total = np.full((len(languages), BUCKETS), 0.5)
    for i, lang in enumerate(languages):
        own = cells[cells["lang"] == lang]
        total[i, own["k"].to_numpy()] += own["n"].to_numpy()
    return Model(languages, np.log(total / total.sum(axis=1, keepdims=True)))


def address(url: Column, languages: list[str]) -> tuple[Column, Column, Column]:
    """Host, registrable part of the host, and the language that the first path part names, if it is one of ``languages``, else the suffix (or null).

    The registrable part is the host's last two labels, or three where the last but one is none that can be registered.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    path = F.lower(F.regexp_extract(url, r"://[^/]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1))
    named = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    labels = rf"([^.]+\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]*\.?[^.]*)$"
    return host, F.regexp_extract(host, labels, 1), F.coalesce(F.when(path.isin(languages), path) if languages else F.lit(None).cast("string"), F.try_element_at(named, suffix))


def declared(html: Column) -> Column:
    """The main subtag of the html element's language, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))


def _likelihoods(rows: DataFrame, text: str, is_html: bool, model: Model, temper: float, most: float) -> DataFrame:
    """Replace the text column by ``ll``, the tempered log-likelihoods less their highest, and ``seen``, its number of trigrams."""
    kept = [c for c in rows.columns if c != text]
    sent = rows.sparkSession.sparkContext.broadcast((model.log_p.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = sent.value
        for batch in slices(batches):
            lls, seen = [], []
            for value in batch.column(text):
                t = value.as_py() or ""
                found = trigrams(plain(t) if is_html else t)
                ll = log_p[:, found].sum(axis=1, dtype=np.float64) * min(temper, most / max(1, len(found)))
                lls.append(np.maximum(ll - ll.max(initial=-np.inf), -60.0) if len(ll) else ll)
                seen.append(int(np.count_nonzero(found)) if t.strip() else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lls, pa.list_(pa.float64())), pa.array(seen, pa.int64())], [*kept, "ll", "seen"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, ll array<double>, seen bigint")


def identify(rows: DataFrame, model: Model, text: str, is_html: bool = False, temper: float = 0.1, most: float = 200.0, strength: float = 10.0, least: float = 0.5) -> DataFrame:
    """Fuse the evidence; rows hold ``host``, ``domain``, ``declared``, ``hinted`` and a text column, all of which may be null.

    Other columns stay (the text column is left out). Added, in place of columns of these names: ``language``, ``posterior``, ``text_language`` (by the
    text alone), ``accepted``: the text has letters and the posterior reaches ``least``. Without any evidence the
    priors decide; ties go to the language first in the alphabet. Repeated rows get equal results; an empty table
    gives no rows. A model without languages gives null and accepts nothing.
    """
    names = model.languages
    languages = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    n = max(1, len(names))
    sources, results = ("host", "domain", "declared", "hinted"), ("language", "posterior", "text_language", "accepted")
    bare = [c for c in rows.columns if c not in (*sources, *results, text)]
    packed = rows.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in bare]).alias("row"), *sources, F.col(text).alias("text"))
    seen = _likelihoods(packed, "text", is_html, model, temper, most)
    hint = lambda c, right: F.when(F.col(c).isNotNull() & F.array_contains(languages, F.col(c)), F.transform(languages, lambda x: F.when(x == F.col(c), np.log(right)).otherwise(np.log((1 - right) / max(1, n - 1)))))
    flat = F.array_repeat(F.lit(0.0), len(names))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    evidence = add(add(F.col("ll"), F.coalesce(hint("declared", DECLARED_RIGHT), flat)), F.coalesce(hint("hinted", ADDRESS_RIGHT), flat))
    soft = lambda c: F.transform(c, lambda x: F.exp(x - F.array_max(c)))
    whole = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    seen = seen.withColumns({"evidence": evidence, "host": F.coalesce("host", F.lit("")), "domain": F.coalesce("domain", F.lit(""))}).withColumn("own", soft(F.col("evidence")))
    seen = stored(seen.withColumn("own", F.expr("transform(own, x -> x / aggregate(own, 0d, (a, y) -> a + y))")), "language-evidence")
    shares = [F.sum(F.get(F.col("own"), F.lit(i))).alias(f"w{i}") for i in range(len(names))]
    hosts = stored(seen.groupBy("host", "domain").agg(F.count("*").alias("n_rows"), *shares), "language-hosts")
    sums = lambda *keys: hosts.groupBy(*keys).agg(F.sum("n_rows").alias("domain_rows"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(names))])
    shared = lambda c: (F.array(*[f"w{i}" for i in range(len(names))]) if names else F.array().cast("array<double>")).alias(c)
    corpus = sums().first()
    everyone = [(corpus[f"w{i}"] or 0.0) + 1.0 for i in range(len(names))]
    overall = F.array(*[F.lit(x / sum(everyone)) for x in everyone]) if names else F.array().cast("array<double>")
    domains = sums("domain").select("domain", "domain_rows", shared("domain_sums"))
    priors = stored(hosts.select("host", "domain", "n_rows", F.col("n_rows").alias("host_rows"), shared("host_sums")).join(domains, "domain"), "language-priors")
    met = join_counted(seen, priors, ["host", "domain"])
    # Sums less the row's own share; rounding must not leave less than nothing.
    others = lambda sums, rows, above: F.zip_with(F.zip_with(sums, "own", lambda x, y: F.greatest(x - y, F.lit(0.0))), above, lambda x, p: (x + strength * p) / (F.col(rows) - 1 + strength))
    prior = others("host_sums", "host_rows", others("domain_sums", "domain_rows", overall))
    fused = met.withColumn("fused", add(F.col("evidence"), F.transform(prior, lambda p: F.log(p))))
    best = lambda c: F.get(languages, F.array_position(F.col(c), F.array_max(c)).cast("int") - 1)
    out = fused.withColumns({"language": best("fused"), "text_language": best("ll"), "posterior": F.when(F.size("fused") > 0, F.lit(1.0) / whole(soft(F.col("fused"))))})
    out = out.withColumn("accepted", (F.col("seen") > 0) & F.coalesce(F.col("posterior") >= least, F.lit(False)))
    return out.select(*([F.col("row")[c].alias(c) for c in bare]), *sources, *results)


def pages(table: DataFrame, model: Model) -> DataFrame:
    """Identify raw web pages (page_id, url, html)."""
    host, domain, hinted = address(F.col("url"), model.languages)
    rows = table.select("page_id", "html", host.alias("host"), domain.alias("domain"), declared(F.col("html")).alias("declared"), hinted.alias("hinted"))
    return identify(rows, model, "html", is_html=True)
