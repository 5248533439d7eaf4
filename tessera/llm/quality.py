"""Quality rules by distribution divergence, in DataFrame functions only.

Every document has two histograms: of character classes and of common words (the function words of
the supported languages, and all other words together). Both are compared with references, one per
language, by the Jensen-Shannon distance (base 2, so from 0 to 1). A reference is the sum of the
histograms of all documents of the corpus that declare the language, have ``MIN_WORDS`` words and no
more than one symbol for every ``REFERENCE_SYMBOLS`` words (else listings of symbols would be held
for language).
The document takes the language whose two distances have the least sum, so a wrong declaration does
no harm.

A document that declares a language without a reference is not judged by distance: what is far from
all four languages may be good text of a fifth. Short documents stray from any reference by chance.
So documents under ``GUARD_CHARS`` characters or ``MIN_WORDS`` words are not judged by distance, and
the limits fall with the root of the length.

The base rules come first: fewer than ``MIN_WORDS`` words, or over half of the words in three-word
windows that repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
GUARD_CHARS = 200
REFERENCE_SYMBOLS = 10
#: Limit of a distance: the first plus the second over the root of the words.
LIMIT_CHARS = (0.08, 0.8)
LIMIT_WORDS = (0.2, 2.0)
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Common words of the languages.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for"),
    "fr": ("le", "la", "les", "et", "un", "une", "que", "qui", "dans", "pour"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "auf"),
    "es": ("el", "los", "las", "del", "y", "se", "por", "con", "para", "su"),
}
WORDS = tuple(dict.fromkeys(w for ws in COMMON.values() for w in ws))
CLASSES = ("vowels", "letters", "blanks", "symbols", "digits", "marks", "foreign")


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, keep: list[str], made: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` of df and those of ``made``, worked out once per row.

    They leave through a generator of one row: the optimizer would otherwise write their expressions
    into every place that names them, and evaluate them there again.
    """
    row = F.array(F.struct(*[c.alias(k) for k, c in made.items()]))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.explode(row).alias("_made")).select(*[F.col(f"`{c}`") for c in keep], "_made.*")


def _repeated(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more, from an array of words.

    Sorting by the 64-bit hash of their words brings equal windows together, so a text of n words
    costs n log n; neighbours of equal hash are then compared by their words.
    """

    def windows(ws):
        one = lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), one))

    def starts(ws, s):
        def equal(x, y):
            out = x.h.eqNullSafe(y.h)
            for k in range(3):
                out = out & F.get(ws, x.p + k).eqNullSafe(F.get(ws, y.p + k))
            return out

        same = lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x.p))

    def covered(p):
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), x - F.get(p, i - 1)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) >= 3, let(let(words, lambda ws: let(windows(ws), lambda s: starts(ws, s))), covered)).otherwise(F.lit(0).cast("long"))


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def histograms(docs: DataFrame, text: str = "text", base: bool = True) -> DataFrame:
    """docs with _n_words, _chars (long array by CLASSES) and _common (long array by WORDS, then other words).

    With base also _n_dup_lines and _n_repeat_words.
    """
    df = docs.withColumn("_t", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    df = df.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    df = df.withColumn("_t1", _removed(F.col("_t"), "[aeiouAEIOU]+"))
    df = df.withColumn("_t2", _removed(F.col("_t1"), "[A-Za-z]+"))
    df = df.withColumn("_t3", _removed(F.col("_t2"), SPACE))
    df = df.withColumn("_t4", _removed(F.col("_t3"), "[#*$%&|<>]+"))
    df = df.withColumn("_t5", _removed(F.col("_t4"), "[0-9]+"))
    df = df.withColumn("_t6", _removed(F.col("_t5"), "[\\x21-\\x7E]+"))
    chain = [F.char_length(c).cast("long") for c in ("_t", "_t1", "_t2", "_t3", "_t4", "_t5", "_t6")]
    made = {
        "_n_words": F.size("_w").cast("long"),
        "_chars": F.array(*[a - b for a, b in zip(chain, chain[1:])], chain[-1]),
        "_common": let(F.filter("_w", lambda w: w.isin(*WORDS)), lambda c: F.array(*[(F.size(c) - F.size(F.array_remove(c, w))).cast("long") for w in WORDS], (F.size("_w") - F.size(c)).cast("long"))),
    }
    if base:
        lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        made["_n_dup_lines"] = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        made["_n_repeat_words"] = _repeated(F.col("_w"))
    return once(df, docs.columns, made)


def _code(lang: str) -> Column:
    """The primary subtag of a declared language."""
    return F.lower(F.substring_index(F.col(f"`{lang}`").cast("string"), "-", 1))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[list[int], list[int]]]:
    """Language -> (character classes, common words), summed over the whole corpus.

    At most one row per supported language comes to the driver. A language without documents of
    ``MIN_WORDS`` words has no reference.
    """
    src = docs.select(_code(lang).alias("_lang"), F.col(f"`{text}`").alias("_text")).where(F.col("_lang").isin(*COMMON))
    h = histograms(src, "_text", base=False)
    h = h.where((F.col("_n_words") >= MIN_WORDS) & (F.col("_chars")[CLASSES.index("symbols")] * REFERENCE_SYMBOLS <= F.col("_n_words")))
    sums = h.groupBy("_lang").agg(*[F.sum(F.col("_chars")[k]) for k in range(len(CLASSES))], *[F.sum(F.col("_common")[k]) for k in range(len(WORDS) + 1)])
    return {r[0]: (list(r[1 : 1 + len(CLASSES)]), list(r[1 + len(CLASSES) :])) for r in sums.collect()}


def _shares(counts: Column) -> Column:
    """An array of counts as shares of their sum."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(n, lambda n: F.transform(counts, lambda x: x / F.greatest(n, F.lit(1))))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def term(a, p, q):
        m = (p + q) / 2
        return a + F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    total = F.aggregate(F.arrays_zip(p.alias("p"), q.alias("q")), F.lit(0.0), lambda a, x: term(a, x["p"], x["q"]))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(docs: DataFrame, refs: dict[str, tuple[list[int], list[int]]], text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _base_failed, _nearest, _js_chars, _js_words, _kept."""
    h = histograms(docs, text)
    chars, n = F.col("_chars"), F.col("_n_words")
    total = F.aggregate(chars, F.lit(0).cast("long"), lambda a, x: a + x)
    h = h.withColumns({
        "_n_chars": total,
        "_word_chars": total - chars[CLASSES.index("blanks")],
        "_n_symbols": chars[CLASSES.index("symbols")],
        "_base_failed": (n < MIN_WORDS) | (100 * F.col("_n_repeat_words") > 50 * n),
    })
    share = lambda x: F.array(*[F.lit(v / (float(sum(x)) or 1.0)) for v in x])
    known = F.array(*[F.struct(F.lit(x).alias("lang"), share(c).alias("c"), share(w).alias("w")) for x, (c, w) in sorted(refs.items())])

    def nearest(mine):
        one = lambda r: let(F.struct(F.round(_distance(mine.c, r.c), 6).alias("a"), F.round(_distance(mine.w, r.w), 6).alias("b")), lambda d: F.struct(F.round(d.a + d.b, 6).alias("sum"), r.lang.alias("lang"), d.a.alias("a"), d.b.alias("b")))
        return F.array_min(F.transform(known, one))

    if refs:
        h = h.withColumn("_least", F.when(n > 0, let(F.struct(_shares(chars).alias("c"), _shares(F.col("_common")).alias("w")), nearest)))
        h = h.withColumns({"_nearest": F.col("_least.lang"), "_js_chars": F.col("_least.a"), "_js_words": F.col("_least.b")}).drop("_least")
    else:
        h = h.withColumns({"_nearest": F.lit(None).cast("string"), "_js_chars": F.lit(None).cast("double"), "_js_words": F.lit(None).cast("double")})
    limit = lambda x: x[0] + x[1] / F.sqrt(n)
    strays = (F.col("_js_chars") > limit(LIMIT_CHARS)) | (F.col("_js_words") > limit(LIMIT_WORDS))
    stated = _code(lang)
    judged = (F.col("_n_chars") >= GUARD_CHARS) & F.col("_js_chars").isNotNull() & (stated.isNull() | stated.isin("", *refs))
    return h.withColumn("_kept", ~F.col("_base_failed") & ~F.coalesce(judged & strays, F.lit(False))).drop("_chars", "_common")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", refs: dict[str, tuple[list[int], list[int]]] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang_nearest, js_chars, js_words).

    One row for every row of docs, repeated rows included. A null or blank text has no words and
    fails the base rules; its distances are null. Without any reference (no document declares a
    supported language) only the base rules count. refs takes references of another, trusted corpus;
    by default they are those of docs.
    """
    refs = references(docs, text, lang) if refs is None else refs
    rows = judge(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang")), refs, "_text", "_lang")
    return rows.select(
        "doc_id",
        *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        F.col("_kept").alias("kept"),
        F.col("_nearest").alias("lang_nearest"),
        F.col("_js_chars").alias("js_chars"),
        F.col("_js_words").alias("js_words"),
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", refs: dict[str, tuple[list[int], list[int]]] | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with their columns, whatever those are called.

    The verdict passes once(), so that the filter is not pushed into the judgement.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang"))
    judged = once(judge(packed, references(docs, text, lang) if refs is None else refs, "_text", "_lang"), ["_row"], {"_keep": F.col("_kept")})
    return judged.where("_keep").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lower(split_part(lang, '-', 1)) AS l FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d)),
nw AS (SELECT r, count(*) AS n FROM w GROUP BY r),
tri AS (SELECT r, i, w || chr(32) || lead(w, 1) OVER o || chr(32) || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM ln WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
ch AS (SELECT r, l, doc_id, t, length(t) AS n,
  length(regexp_replace(t, '[^aeiouAEIOU]+', '', 'g')) AS c1, length(regexp_replace(t, '[^B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]+', '', 'g')) AS c2,
  length(regexp_replace(t, '[^\\x20\\x09-\\x0D]+', '', 'g')) AS c3, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS c4,
  length(regexp_replace(t, '[^0-9]+', '', 'g')) AS c5 FROM d),
ch2 AS (SELECT *, length(regexp_replace(t, '[^\\x21-\\x7E]+', '', 'g')) - c1 - c2 - c4 - c5 AS c6 FROM ch),
cls AS (SELECT r, l, doc_id, n, [c1, c2, c3, c4, c5, c6, n - c1 - c2 - c3 - c4 - c5 - c6] AS c, c3, c4 FROM ch2),
voc AS (SELECT unnest([{", ".join(f"'{x}'" for x in WORDS)}]) AS w, unnest(range(1, {len(WORDS) + 1})) AS k),
cw AS (SELECT r, coalesce(k, {len(WORDS) + 1}) AS k, count(*) AS n FROM w LEFT JOIN voc USING (w) GROUP BY ALL),
ok AS (SELECT cls.r, l FROM cls JOIN nw USING (r) WHERE nw.n >= {MIN_WORDS} AND c4 * {REFERENCE_SYMBOLS} <= nw.n AND l IN ({", ".join(f"'{x}'" for x in COMMON)})),
refc AS (SELECT l, k, sum(c[k]) AS q FROM ok JOIN cls USING (r, l), range(1, {len(CLASSES) + 1}) AS g(k) GROUP BY l, k),
refw AS (SELECT l, k, sum(n) AS q FROM ok JOIN cw USING (r) GROUP BY l, k),
qc AS (SELECT l, k, q / sum(q) OVER (PARTITION BY l) AS q FROM refc),
qw AS (SELECT l, k, q / sum(q) OVER (PARTITION BY l) AS q FROM refw),
langs AS (SELECT DISTINCT l FROM ok),
pc AS (SELECT r, k, c[k] / n AS p FROM cls, range(1, {len(CLASSES) + 1}) AS g(k) WHERE n > 0),
pw AS (SELECT r, cw.k, cw.n / nw.n AS p FROM cw JOIN nw USING (r)),
jc AS (SELECT r, qc.l, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS a FROM pc JOIN qc USING (k) GROUP BY r, qc.l),
jw AS (SELECT x.r, x.l, sqrt(greatest((sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + coalesce(q, 0))) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + 1 - sum(coalesce(q, 0))) / 2, 0)) AS b
  FROM (SELECT r, l, k, p FROM pw, langs) AS x LEFT JOIN qw ON qw.l = x.l AND qw.k = x.k GROUP BY x.r, x.l),
best AS (SELECT r, min(struct_pack(s := round(round(a, 6) + round(b, 6), 6), l := l, a := round(a, 6), b := round(b, 6))) AS m FROM jc JOIN jw USING (r, l) GROUP BY r),
f AS (SELECT cls.r, doc_id, cls.l, cls.n AS n_chars, coalesce(nw.n, 0) AS n_words, cls.n - c3 AS word_chars, c4 AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  m.l AS lang_nearest, m.a AS js_chars, m.b AS js_words
  FROM cls LEFT JOIN nw USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN best USING (r)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_chars >= {GUARD_CHARS} AND (l IS NULL OR l = '' OR l IN (SELECT l FROM langs)) AND (js_chars > {LIMIT_CHARS[0]} + {LIMIT_CHARS[1]} / sqrt(n_words) OR js_words > {LIMIT_WORDS[0]} + {LIMIT_WORDS[1]} / sqrt(n_words)), false) AS kept,
  lang_nearest, js_chars, js_words FROM g
"""
