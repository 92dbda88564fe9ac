"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Every document gets measures (symbols a word, letters a word, the share of repeated lines and of
words in repeated 3-word windows). For each language and source a mergeable quantile sketch of
every measure is built: counts of logarithmic buckets, so that a bucket's value is within
ACCURACY of all it holds. Sketches merge by adding counts; sums do not depend on the order of
rows, so results repeat exactly. Word length has its quartiles, widened by FENCE times their
distance, as limits. The other measures are nought for most documents, so that their quartiles say
nothing: their limit is a high quantile of the sketch. Floors only keep the sketch's own error and
single characters from deciding. Limits are shrunk by size: a group's count as its documents, its
language's as LEAST, and likewise the language's towards those of all. Documents join the limits of
their language and source.

Nulls: a null text has no words and fails; null language or source form a group of their own.
Empty texts fail the base rules. Empty tables give empty results. Ties and repeated rows are
counted each. Texts are measured whole; a text of any length is one row's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\f\r"
ACCURACY, FENCE, LEAST = 0.01, 3.0, 100
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: measure -> (share of the documents under the high limit, or None for fences about the quartiles; least high limit)
MEASURES = {"symbol_ratio": (0.95, 0.01), "word_length": (None, 0.0), "dup_line_ratio": (0.98, 0.01), "repeat_ratio": (0.98, 0.01)}
#: Values up to this count as nought in a sketch.
NOUGHT = 1e-4


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_words", F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]")))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    windows = F.slice(F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))), 1, F.greatest(F.size("_words") - 2, F.lit(0)))
    df = df.withColumn("_windows", windows)
    # windows sorted by hash beside their places; equal neighbours are windows found twice or more
    at = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_at", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), at))
    again = F.filter("_at", lambda x, i: F.coalesce(x["h"] == F.get("_at", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_at", i + 1)["h"], F.lit(False)))
    df = df.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_again", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_again", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return (
        df.withColumn("word_chars", _without(text, SPACE).cast("long"))
        .withColumn("n_symbols", (F.char_length(text) - _without(text, "#*$%&|<>")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
        .drop("_words", "_lines", "_windows", "_at", "_again")
    )


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbol_ratio": F.col("n_symbols") / words, "word_length": F.col("word_chars") / words, "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"), "repeat_ratio": F.col("n_repeat_words") / words}


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketches: keys, measure, bucket, n. The rows of a group are a few hundred at most
    for each measure, whatever its size: counts are summed before the shuffle."""
    growth = (1 + ACCURACY) / (1 - ACCURACY)
    bucket = lambda v: F.when(v > NOUGHT, F.ceil(F.log(v) / F.log(F.lit(growth)))).cast("int")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in _ratios().items()]))
    return measured.where(~F.col("base_failed")).select(*keys, pairs.alias("_p")).groupBy(*keys, "_p.measure", "_p.bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts added."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, size, q1, q3, top (upper edge of the high quantile's bucket) of each sketch. The buckets of one group and measure come
    together in one array, a few hundred at most by their definition."""
    growth = (1 + ACCURACY) / (1 - ACCURACY)
    sums = sketch.groupBy(*keys, "measure").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct(F.coalesce("bucket", F.lit(-(1 << 30))).alias("b"), F.col("n").alias("n")))).alias("_s"))

    def bucket(share: float | Column) -> Column:
        need = F.ceil(F.col("size") * share)
        empty = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("b"))
        step = lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.when(a["b"].isNotNull(), a["b"]).when(a["sum"] + x["n"] >= need, x["b"]).alias("b"))
        return F.aggregate("_s", empty, step)["b"]

    def quantile(share: float) -> Column:
        b = bucket(share)
        return F.when(b > -(1 << 30), 2 * F.pow(F.lit(growth), b) / (growth + 1)).otherwise(0.0)

    high = F.create_map(*[x for k, (share, _) in MEASURES.items() for x in (F.lit(k), F.lit(share or 0.75))])[F.col("measure")]
    b = bucket(high)
    top = F.when(b > -(1 << 30), F.pow(F.lit(growth), b)).otherwise(0.0)
    return sums.withColumn("q1", quantile(0.25)).withColumn("q3", quantile(0.75)).withColumn("top", top).drop("_s")


def _limits(quartile: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row a group: its size and the low and high limit of each measure."""
    wide = F.greatest(F.col("q3") - F.col("q1"), 2 * ACCURACY * F.col("q3")) * FENCE
    fenced = F.col("measure").isin([k for k, (share, _) in MEASURES.items() if share is None])
    rows = quartile.select(*keys, "measure", "size", (F.col("q1") - wide).alias("low"), F.when(fenced, F.col("q3") + wide).otherwise(F.col("top")).alias("high"))
    picks = [F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{prefix}{k}_{side}") for k in MEASURES for side in ("low", "high")]
    return rows.groupBy(*keys).agg(F.max("size").alias(f"{prefix}size"), *picks)


def _keyed(measured: DataFrame) -> DataFrame:
    return measured.withColumns({"_lang": F.coalesce("lang", F.lit("\x00")), "_source": F.coalesce("source", F.lit("\x00"))})


def limits(measured: DataFrame) -> DataFrame:
    """_lang, _source and the low and high limit of each measure: a row for each language and source."""
    fine = common.checkpointed(sketches(_keyed(measured), ["_lang", "_source"]))
    by_lang = merge(fine, ["_lang"])
    own = _limits(quartiles(fine, ["_lang", "_source"]), ["_lang", "_source"], "s_")
    lang = _limits(quartiles(by_lang, ["_lang"]), ["_lang"], "l_")
    everything = _limits(quartiles(merge(by_lang.withColumn("_all", F.lit(0)), ["_all"]), ["_all"]), ["_all"], "a_")
    joined = own.join(lang, "_lang", "left").withColumn("_all", F.lit(0)).join(everything, "_all", "left")
    chosen = {}
    for k in MEASURES:
        for side in ("low", "high"):
            wider = (F.col("l_size") * F.col(f"l_{k}_{side}") + LEAST * F.col(f"a_{k}_{side}")) / (F.col("l_size") + LEAST)
            own_side = (F.col("s_size") * F.col(f"s_{k}_{side}") + LEAST * wider) / (F.col("s_size") + LEAST)
            # rounding must not put a limit under the equal limits it is made of
            chosen[f"{k}_{side}"] = F.greatest(own_side * (1 + 1e-9), F.lit(MEASURES[k][1])) if side == "high" else own_side * (1 - 1e-9)
    return joined.select(F.col("_lang"), F.col("_source"), *[c.alias(f"_{n}") for n, c in chosen.items()])


def verdicts(measured: DataFrame, given: DataFrame) -> DataFrame:
    """measured with kept, by the limits given.

    Spark broadcasts the limits only below its size threshold; else both sides are shuffled and
    hot groups are split by the skew join."""
    good = ~F.col("base_failed")
    for k, v in _ratios().items():
        good = good & (v <= F.col(f"_{k}_high"))
        if MEASURES[k][0] is None:
            good = good & (v >= F.col(f"_{k}_low"))
    joined = _keyed(measured).join(given, ["_lang", "_source"], "left")
    return joined.withColumn("kept", F.coalesce(good, F.lit(False))).select(*measured.columns, "kept")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row of docs(doc_id, text, lang, source).
    Texts are read once; only narrow rows are written, shuffled and joined."""
    measured = common.checkpointed(measures(common.need(docs, "doc_id", "text", "lang", "source")).drop("text"))
    return verdicts(measured, limits(measured))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their columns as they are. The texts, with their measures
    beside them, are written once, compressed, and read for the sketches (measures only) and the
    verdict; without that cut the optimizer would inline the measures into every condition."""
    whole = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"), "text", "lang", "source")
    measured = common.written(measures(whole).drop("text"))
    return verdicts(measured, limits(measured)).where("kept").select("_doc.*")


#: The same rows for DuckDB: measures, sketches, quantiles and limits as above.
ORACLE_SQL = {
    "op7_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM rep, range(0, 3) x(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup, count(*) AS n_lines FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT r, doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat, 0) AS n_repeat FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat > 50 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS nw FROM m),
v AS (SELECT r, lang, source, unnest([{'k': 'symbol_ratio', 'v': n_symbols / nw}, {'k': 'word_length', 'v': word_chars / nw}, {'k': 'dup_line_ratio', 'v': n_dup / greatest(n_lines, 1)::DOUBLE}, {'k': 'repeat_ratio', 'v': n_repeat / nw}]) AS x FROM f WHERE NOT base_failed),
share(k, part, least, fenced) AS (VALUES ('symbol_ratio', 0.95::DOUBLE, 0.01::DOUBLE, false), ('word_length', 0.75, 0.0, true), ('dup_line_ratio', 0.98, 0.01, false), ('repeat_ratio', 0.98, 0.01, false)),
b AS (SELECT lang, source, x.k AS k, CASE WHEN x.v > 1e-4 THEN ceil(ln(x.v) / ln(1.01::DOUBLE / 0.99::DOUBLE))::INT ELSE -1000000 END AS b, count(*) AS n FROM v GROUP BY lang, source, x.k, 4),
g AS (SELECT 3 - (lang IS NULL)::INT - (source IS NULL)::INT AS fine, lang, source, k, b, n FROM (SELECT lang, source, k, b, sum(n) AS n FROM b GROUP BY GROUPING SETS ((lang, source, k, b), (lang, k, b), (k, b)))),
c AS (SELECT *, sum(n) OVER (PARTITION BY fine, lang, source, k ORDER BY b) AS upto, sum(n) OVER (PARTITION BY fine, lang, source, k) AS size FROM g JOIN share USING (k)),
q AS (SELECT fine, lang, source, k, any_value(fenced) AS fenced, any_value(size)::DOUBLE AS size, min(b) FILTER (WHERE upto >= ceil(size * 0.25::DOUBLE)) AS b1, min(b) FILTER (WHERE upto >= ceil(size * 0.75::DOUBLE)) AS b3, min(b) FILTER (WHERE upto >= ceil(size * part)) AS bt FROM c GROUP BY fine, lang, source, k),
p AS (SELECT *, 1.01::DOUBLE / 0.99::DOUBLE AS growth, CASE WHEN b1 > -1000000 THEN 2 * pow(growth, b1) / (growth + 1) ELSE 0 END AS q1, CASE WHEN b3 > -1000000 THEN 2 * pow(growth, b3) / (growth + 1) ELSE 0 END AS q3, CASE WHEN bt > -1000000 THEN pow(growth, bt) ELSE 0 END AS top FROM q),
l AS (SELECT fine, lang, source, k, size, q1 - greatest(q3 - q1, 0.02::DOUBLE * q3) * 3 AS low, CASE WHEN fenced THEN q3 + greatest(q3 - q1, 0.02::DOUBLE * q3) * 3 ELSE top END AS high FROM p),
o AS (SELECT s.lang, s.source, s.k, (s.size * s.low + 100 * ((a.size * a.low + 100 * e.low) / (a.size + 100))) / (s.size + 100) * (1 - 1e-9::DOUBLE) AS low, greatest((s.size * s.high + 100 * ((a.size * a.high + 100 * e.high) / (a.size + 100))) / (s.size + 100) * (1 + 1e-9::DOUBLE), share.least) AS high, share.fenced
  FROM l s JOIN l a ON a.fine = 2 AND a.lang = s.lang AND a.k = s.k JOIN l e ON e.fine = 1 AND e.k = s.k JOIN share ON share.k = s.k WHERE s.fine = 3),
j AS (SELECT v.r, bool_and(x.v <= o.high AND (NOT o.fenced OR x.v >= o.low)) AS good FROM v JOIN o ON o.lang = v.lang AND o.source = v.source AND o.k = x.k GROUP BY v.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words, base_failed, coalesce(good, false) AS kept FROM f LEFT JOIN j USING (r)
"""
}
