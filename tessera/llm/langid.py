"""Language identification by Bayesian fusion of evidence.

The posterior of a language l for a document is proportional to

  P(text | l) * P(declared | l) * P(suffix | l) * P(l | host)

text      naive Bayes over hashed byte trigrams of the lower-cased text. Neighbouring trigrams
          depend on each other, so the log likelihood is divided by ``DAMP``.
declared  the primary subtag of the declared markup language: right with 1 - ``DECLARED_ERROR``,
          else any other language alike. A missing or foreign declaration says nothing.
suffix    the last label of the host: country labels speak for languages, see SUFFIX.
host      the prior of the host, smoothed towards that of its site (its last two labels), which is
          smoothed towards its suffix, which is smoothed towards the whole corpus. The counts are
          sums of the posteriors without host evidence over all other rows, by grouped aggregation:
          a row's own posterior is taken out of each sum before its prior is made.

A row is kept if its best language has at least ``LEAST_POSTERIOR`` and its text looks like that
language: the mean log likelihood of its trigrams is not under the model's own by more than a margin
for its length. Texts under ``LEAST_TRIGRAMS`` trigrams are not held to the second test.

The text model is fitted on a bounded sample of labelled rows: per language the ``SAMPLE`` rows with
the least hash of their id (of rows that share an id, the greatest text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.words import LOWER, as_bytes
from tessera.session import Scratch, ship, join_checked

LANGUAGES = ("en", "fr", "de", "es")
SAMPLE = 500
#: Parts in which a language's rows are cut to the sample first.
PARTS = 64
SLOTS = 1 << 16
DAMP = 4.0
DECLARED_ERROR = 0.05
#: Strength, in rows, with which a host's counts are drawn to its site's, and so on upwards.
SMOOTHING = 20.0
LEAST_POSTERIOR = 0.5
LEAST_TRIGRAMS = 60
#: Margin under the model's mean log likelihood: this much, and this much over the root of the trigrams.
MARGIN, MARGIN_ROOT = 2.0, 24.0
#: Country labels and the languages that they speak for, with P(label | language) relative to others'.
SUFFIX = {
    "uk": ("en",), "us": ("en",), "ie": ("en",), "au": ("en",), "nz": ("en",),
    "fr": ("fr",), "be": ("fr",), "ch": ("de", "fr"), "ca": ("en", "fr"),
    "de": ("de",), "at": ("de",), "li": ("de",),
    "es": ("es",), "mx": ("es",), "ar": ("es",), "cl": ("es",), "co": ("es",), "pe": ("es",),
}
SUFFIX_ODDS = 8.0


def trigrams(text: bytes) -> np.ndarray:
    """Slots of the byte trigrams of the lower-cased text with white space as one blank, blanks at both ends."""
    t = text.translate(LOWER).split()
    if not t:
        return np.empty(0, np.int64)
    a = np.frombuffer(b" " + b" ".join(t) + b" ", np.uint8).astype(np.int64)
    return ((a[:-2] * 40503 + a[1:-1] * 2654435761 + a[2:] * 2246822519) >> 7) & (SLOTS - 1)


@dataclass
class TextModel:
    """logs[slot, language] = log P(trigram | language); mean[language] is what the model expects of its own texts."""

    languages: tuple[str, ...]
    logs: np.ndarray
    mean: np.ndarray

    def sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood per text and language, trigrams per text)."""
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            g = trigrams(t)
            n[i] = len(g)
            if len(g):
                out[i] = self.logs[g].sum(axis=0, dtype=np.float64)
        return out, n


def fit(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> TextModel:
    """Fit the text model on at most ``sample`` rows of each language.

    Rows of other or no declared language are left out. A language without rows gets the mean of
    the others and is never the best by its text alone.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{doc_id}`").alias("_id"), F.lower(F.substring_index(F.col(f"`{lang}`"), "-", 1)).alias("_lang")).where(F.col("_lang").isin(*languages) & F.col("_id").isNotNull())
    order = [F.xxhash64("_id"), F.col("_id")]
    first = rows.distinct().withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(PARTS)))
    for by in (["_lang", "_part"], ["_lang"]):  # a language's rows meet in one task only when each part has been cut
        first = first.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= sample)
    ids = first.select("_id", "_lang")  # at most sample rows a language
    code = F.lower(F.substring_index(F.col(f"`{lang}`"), "-", 1))
    labelled_rows = labelled.select(F.col(f"`{doc_id}`").alias("_id"), code.alias("_lang"), F.col(f"`{text}`").cast("string").alias("_text")).where(F.col("_lang").isin(*languages))
    taken = labelled_rows.join(F.broadcast(ids), ["_id", "_lang"], "left_semi").groupBy("_id", "_lang").agg(F.max("_text").alias("_text"))
    taken = Scratch(labelled.sparkSession).write(taken.select("_lang", "_text"), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                own = counts.setdefault(name, np.zeros(SLOTS, np.int64))
                own += np.bincount(trigrams(t), minlength=SLOTS)
        for name, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([own.astype("<i4").tobytes()], pa.binary())], ["lang", "counts"])

    counts = {x: np.zeros(SLOTS) for x in languages}
    for name, raw in taken.repartition(8).mapInArrow(run, "lang string, counts binary").collect():
        counts[name] += np.frombuffer(bytes(raw), "<i4")
    total = sum(counts.values())
    base = (total + 0.05) / (total.sum() + 0.05 * SLOTS)
    logs, mean = np.empty((SLOTS, len(languages)), np.float32), np.zeros(len(languages))
    for k, x in enumerate(languages):
        p = (counts[x] + 50.0 * base) / (counts[x].sum() + 50.0)
        logs[:, k] = np.log(p)
        mean[k] = float((p * np.log(p)).sum())
    return TextModel(tuple(languages), logs, mean)


def _host_parts(host: F.Column):
    """(host, site, suffix) in lower case without port; empty where unknown."""
    h = F.coalesce(F.lower(F.regexp_replace(host, ":\\d+$", "")), F.lit(""))
    return h, F.substring_index(h, ".", -2), F.when(F.instr(h, ".") > 0, F.substring_index(h, ".", -1)).otherwise(F.lit(""))


def _evidence(model: TextModel, declared: str | None, suffix: str) -> np.ndarray:
    """Log evidence of the declared language and the suffix, per language."""
    out = np.zeros(len(model.languages))
    d = (declared or "").split("-")[0].split("_")[0].strip().lower()
    if d in model.languages and len(model.languages) > 1:
        out += np.log(DECLARED_ERROR / (len(model.languages) - 1))
        out[model.languages.index(d)] = np.log(1 - DECLARED_ERROR)
    if suffix in SUFFIX:
        out += np.log([SUFFIX_ODDS if x in SUFFIX[suffix] else 1.0 for x in model.languages])
    return out


def _score(docs: DataFrame, model: TextModel, text: F.Column, declared: F.Column, host: F.Column, keep: list[str]) -> DataFrame:
    """keep, the host parts, and per row: _log (log evidence without host), _mean (of trigrams, per language), _n."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    h, site, suffix = _host_parts(host)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], h.alias("_host"), site.alias("_site"), suffix.alias("_suffix"), declared.cast("string").alias("_declared"), text.cast("string").alias("_body"))
    schema = src.drop("_body", "_declared").withColumn("_log", F.array().cast("array<double>")).withColumn("_mean", F.array().cast("array<double>")).withColumn("_n", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            sums, n = m.sums(as_bytes(b.column(b.num_columns - 1)))
            seen: dict = {}
            extra = np.zeros_like(sums)
            for i, key in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 3).to_pylist())):
                if key not in seen:
                    seen[key] = _evidence(m, *key)
                extra[i] = seen[key]
            logs, means = sums / DAMP + extra, sums / np.maximum(n, 1)[:, None]
            width = len(m.languages)
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.ListArray.from_arrays(ends, pa.array(logs.ravel())), pa.ListArray.from_arrays(ends, pa.array(means.ravel())), pa.array(n)], schema.names)

    return src.mapInArrow(run, schema)


LEVELS = ("corpus", "suffix", "site", "host")


def _posterior(logs: F.Column) -> F.Column:
    """Log evidence as probabilities."""
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def host_counts(scored: DataFrame, width: int) -> DataFrame:
    """(_host, corpus, suffix, site, host): per host, the sums of the rows' posteriors at each level, as arrays."""
    c = [f"_c{k}" for k in range(width)]
    hosts = scored.withColumn("_p", _posterior(F.col("_log"))).groupBy("_host", "_site", "_suffix").agg(*[F.sum(F.col("_p")[k]).alias(x) for k, x in enumerate(c)])

    def up(by: list[str], to: str) -> DataFrame:
        return hosts.groupBy(*by).agg(F.array(*[F.sum(x) for x in c]).alias(to))

    total = hosts.agg(*[F.sum(x).alias(x) for x in c]).first()
    joined = hosts.join(up(["_suffix"], "suffix"), "_suffix").join(up(["_site"], "site"), "_site")
    return joined.select("_host", F.array(*[F.lit(total[x] or 0.0) for x in c]).alias("corpus"), "suffix", "site", F.array(*c).alias("host"))


def _prior(own: F.Column, width: int) -> F.Column:
    """The prior of a row's host without the row itself, drawn from level to level towards the one above."""
    p = F.array(*[F.lit(1.0 / width)] * width)
    for level in LEVELS:
        rest = F.zip_with(level, own, lambda x, y: F.greatest(x - y, F.lit(0.0)))
        size = F.aggregate(rest, F.lit(0.0), lambda a, y: a + y)
        p = F.zip_with(rest, p, lambda x, y: (x + SMOOTHING * y) / (size + SMOOTHING))  # noqa: B023
    return p


def _decide(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows of _score with host_counts -> lang, posterior, _likely, kept."""
    width = len(model.languages)
    rows = rows.withColumn("_own", _posterior(F.col("_log"))).withColumn("_prior", _prior(F.col("_own"), width))
    total = F.zip_with("_log", "_prior", lambda x, y: x + F.log(y))
    rows = rows.withColumn("_total", total).withColumn("_top", F.array_max("_total"))
    rows = rows.withColumn("_best", F.array_position("_total", F.col("_top")).cast("int") - 1)
    z = sum((F.exp(F.col("_total")[k] - F.col("_top")) for k in range(width)), F.lit(0.0))
    rows = rows.withColumn("posterior", F.lit(1.0) / z)
    names, means = F.array(*[F.lit(x) for x in model.languages]), F.array(*[F.lit(float(x)) for x in model.mean])
    short = means[F.col("_best")] - F.element_at("_mean", F.col("_best") + 1)  # how far the text falls short of the model
    rows = rows.withColumn("lang", names[F.col("_best")]).withColumn("shortfall", F.when(F.col("_n") > 0, short))
    unlike = (F.col("_n") >= LEAST_TRIGRAMS) & (F.col("shortfall") > MARGIN + MARGIN_ROOT / F.sqrt("_n"))
    return rows.withColumn("kept", (F.col("posterior") >= LEAST_POSTERIOR) & (F.col("_n") > 0) & ~unlike)


def identify(docs: DataFrame, text: str = "text", declared: F.Column | None = None, host: F.Column | None = None, doc_id: str = "doc_id", model: TextModel | None = None, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(doc_id, lang, posterior, shortfall, n_trigrams, kept) for every row of docs.

    declared and host are columns of docs; without them that evidence is left out. model is fitted
    on docs by the declared language where it isn't given. A null or blank text has no trigrams: its
    language comes from the other evidence and it is not kept. Of equal languages the first of
    ``languages`` wins. Repeated rows stay.
    """
    spark = docs.sparkSession
    declared = F.lit(None).cast("string") if declared is None else declared
    host = F.lit(None).cast("string") if host is None else host
    if model is None:
        model = fit(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), declared.alias("lang")), languages)
    scratch = Scratch(spark)
    scored = scratch.write(_score(docs, model, F.col(f"`{text}`"), declared, host, [doc_id]), "scored")
    counts = scratch.write(host_counts(scored, len(model.languages)), "counts")
    out = _decide(join_checked(spark, scored, counts, ["_host"], "inner", 200_000), model)
    return out.select(F.col(f"`{doc_id}`"), "lang", F.round("posterior", 6).alias("posterior"), F.round("shortfall", 6).alias("shortfall"), F.col("_n").alias("n_trigrams"), "kept")


def keep_known(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", doc_id: str = "doc_id", languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The rows of docs that identify() keeps, with the found language in the column ``declared``.

    Scores are made once and joined to the rows by their id; rows that share an id share the
    verdict of one of them (kept if any is kept, the greatest posterior's language). Rows without an
    id are kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found = identify(docs, text, F.col(f"`{declared}`"), F.col(f"`{host}`"), doc_id, None, languages)
    found = scratch.write(found.select(F.col(f"`{doc_id}`").alias("id"), "lang", "posterior", "kept"), "languages")
    best = found.where("id is not null").groupBy("id").agg(F.max_by("lang", F.struct("posterior", "lang")).alias("told"), F.max("kept").alias("keep"))
    packed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stated = packed.select("id", F.lower(F.col(f"row.`{declared}`")).alias("l"))
    changed = best.join(stated, "id").where(~F.col("keep") | ~F.col("told").eqNullSafe(F.col("l"))).select("id", "told", "keep").dropDuplicates(["id"])
    changed = scratch.write(changed, "changed")
    out = join_checked(spark, packed, changed, ["id"], "left").where(F.coalesce("keep", F.lit(True)))
    return out.select(*[F.coalesce("told", F.col(f"row.`{c}`")).alias(c) if c == declared else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
