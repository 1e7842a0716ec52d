"""Line dedup by distinct-site spread, with DataFrame functions only.

Each line's sites go into a HyperLogLog sketch per line hash; partial sketches merge in the aggregation, so a line that a
third of all documents share is combined before the shuffle.  Lines whose estimate is near the threshold get an exact
distinct count.  A line on at least ``min_sites`` sites is boilerplate: every occurrence but the first (smallest doc_id,
then line) is taken out, so that no text vanishes from the corpus.

Cases: a line is compared without blanks at its ends; empty lines are kept and never counted; a null text counts as empty and
comes back empty; a null site is no site; documents without a doc_id are counted as sites but returned unchanged; rows
that repeat a doc_id and its text are one document, those with another text are documents of their own; a text may become empty; other columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.tables import sized
from lyceum.sources.staging import stage

MIN_SITES = 5
#: log2 of a sketch's registers: a relative standard error of 1.6 %.
LOG_K = 12
#: Estimates within this share of the threshold are counted exactly: more than six standard errors.
MARGIN = 0.1


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """Non-empty lines: ``d`` doc_id, ``x`` hash of the text, ``i`` line number from 0, ``s`` site, and ``h``, ``n`` as the line's key."""
    exploded = docs.select(
        F.col("doc_id").alias("d"), F.xxhash64("text").alias("x"), F.col(site).cast("string").alias("s"), F.posexplode(F.split(F.col("text"), "\n")).alias("i", "t")
    ).withColumn("t", F.trim("t"))
    return exploded.filter("t <> ''").select("d", "x", "i", "s", F.xxhash64("t").alias("h"), F.length("t").alias("n"))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Keys ``h, n`` of lines on at least ``min_sites`` sites, with their first place ``d0, i0, x0``; staged."""
    lines = _lines(docs, site)
    spread = stage(
        lines.groupBy("h", "n")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("s", LOG_K)).alias("sites"),
            F.min(F.when(F.col("d").isNotNull(), F.struct("d", "i", "x"))).alias("first"),
        )
        .filter(F.col("sites") >= min_sites * (1 - MARGIN)),
        "line-spread",
    )
    near = spread.filter(F.col("sites") <= min_sites * (1 + MARGIN)).select("h", "n")
    exact = (
        lines.join(sized(near, 16), ["h", "n"]).groupBy("h", "n", "s").agg(F.lit(1).alias("x"))
        .groupBy("h", "n").agg(F.count("s").alias("exact"))
    )
    far = spread.filter(F.col("sites") > min_sites * (1 + MARGIN))
    close = spread.join(exact.filter(F.col("exact") >= min_sites), ["h", "n"]).select(*far.columns)
    both = far.union(close)
    return stage(both.select("h", "n", F.col("first.d").alias("d0"), F.col("first.i").alias("i0"), F.col("first.x").alias("x0")), "boilerplate")


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the repeated boilerplate lines taken out of ``text``; all rows and columns stay."""
    return _without(docs, removed_lines(docs, site, min_sites))


def removed_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``__d, __x`` (doc_id and hash of the text) and the sorted numbers ``__gone`` of its lines to take out, for documents that have any;
    staged."""
    found = boilerplate(docs, site, min_sites)
    hits = _lines(docs.filter("doc_id is not null"), site).join(sized(found, 40), ["h", "n"])
    later = hits.filter((F.col("d") != F.col("d0")) | (F.col("i") != F.col("i0")) | (F.col("x") != F.col("x0")))
    return stage(later.groupBy(F.col("d").alias("__d"), F.col("x").alias("__x")).agg(F.sort_array(F.collect_set("i")).alias("__gone")), "removed-lines")


def _kept(text: Column, gone: Column) -> Column:
    """Lines whose numbers are not in ``gone`` (sorted): one mark per line up to the last of these, in a single pass."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, F.lit(1), F.size(gone) - 1))
    marks = F.flatten(F.zip_with(gone, before, lambda g, p: F.concat(F.array_repeat(F.lit(False), g - p - 1), F.array(F.lit(True)))))
    lines = F.zip_with(F.split(text, "\n"), marks, lambda t, out: F.when(~F.coalesce(out, F.lit(False)), t))
    return F.when(gone.isNull(), text).otherwise(F.array_join(lines, "\n"))  # nulls are left out


def _without(docs: DataFrame, gone: DataFrame, extra: bool = False) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    numbers = gone.agg(F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()[0]
    row = 64 + 4 * numbers // max(1, gone.count())
    same = (docs["doc_id"] == gone["__d"]) & (F.xxhash64(docs["text"]) == gone["__x"])
    out = docs.join(sized(gone, row), same, "left")
    columns = [_kept(text, F.col("__gone")).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns]
    if extra:
        filled = F.size(F.filter(F.split(text, "\n"), lambda t: F.trim(t) != ""))
        columns = [docs["doc_id"], filled.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"), columns[docs.columns.index("text")]]
    return out.select(*columns)


def report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id``, its non-empty lines, how many were taken out and the text that is left, for every row."""
    chosen = docs.select("doc_id", "text", site)
    return _without(chosen, removed_lines(chosen, site, min_sites), extra=True)


def with_lengths(docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """``docs`` with the length of each text, if they have such a column."""
    return docs.withColumn(length, F.length("text").cast(docs.schema[length].dataType)) if length in docs.columns else docs
