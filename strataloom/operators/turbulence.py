"""Turbulence of an ordered sequence of categories: sliding scores, hot zones, tiers, redundant code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sequence_ratio

# Categories in the order that decides ties, the points of a keyword and the keywords of each.
KEYWORDS = (
    ("Daten", 2, ("::create", "::find", "::where", "->save", "->delete", "migration", "schema::", "$fillable", "belongsto", "hasmany")),
    ("UI", 2, ("blade", "<div", "<form", "wire:", "@if", "@foreach", "class=", "x-data")),
    ("Sicherheit", 2, ("auth::", "validate", "authorize", "policy", "gate::", "middleware", "sanctum", "abort(403")),
    ("KI", 3, ("langdock", "agent", "ollama", "embedding", "llm", "openai", "anthropic", "chat/completions")),
    ("Logik", 1, ("",)),
    ("Config", 1, ("route::", "config(", "env(", "return [")),
)
# Names that tell nothing.
NAMELESS = ("unbekannt", "nicht_erkannt")
NAMELESS_START = ("block_", "fehler_")
FUNCTION_HEAD = r"(?U)(?:function|public|private|protected)\s+(\w+)\s*\("


def heuristic_category(code: Column, keywords=KEYWORDS) -> Column:
    """The category with most points for keywords in a text; the first of equal ones. Logik has its point from the start."""
    low = F.lower(code)
    scores = []
    for i, (name, points, words) in enumerate(keywords):
        hits = F.lit(0)
        for w in words:
            hits = hits + F.when(F.contains(low, F.lit(w)), points).otherwise(0)
        scores.append(F.struct(hits.alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name")))
    return F.array_max(F.array(*scores))["name"]


def functional_name(code: Column, start_line: Column) -> Column:
    """The first function's name, else the block's place."""
    name = F.regexp_extract(code, FUNCTION_HEAD, 1)
    return F.when(name != "", name).otherwise(F.concat(F.lit("block_"), start_line.cast("string")))


def turbulence(rows: DataFrame, file: str = "file", order: str = "pos", category: str = "category", window: int = 5) -> DataFrame:
    """rows with score: in the frame around each, changes by places between, times distinct categories by six."""
    half = window // 2
    frame = Window.partitionBy(file).orderBy(order).rowsBetween(-half, half)
    seen = F.collect_list(category).over(frame)
    pairs = F.arrays_zip(F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))).alias("a"), F.slice(seen, 2, F.size(seen)).alias("b"))
    changes = F.size(F.filter(pairs, lambda p: p["a"] != p["b"]))
    score = changes / F.greatest(F.lit(1), F.size(seen) - 1) * (F.size(F.array_distinct(seen)) / 6.0)
    alone = F.count(F.lit(1)).over(Window.partitionBy(file)) < 2
    return rows.withColumn("score", F.when(alone, F.lit(0.0)).otherwise(score))


def file_scores(scored: DataFrame, file: str = "file") -> DataFrame:
    """(file, n, turbulence, tier): the mean score; fewer than three chunks are stable."""
    out = scored.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 3).alias("turbulence"))
    t = F.col("turbulence")
    return out.withColumn("tier", F.when(F.col("n") < 3, "stable").when(t < 0.2, "skip").when(t < 0.5, "light").otherwise("deep"))


def hot_zones(scored: DataFrame, file: str = "file", order: str = "pos", least: float = 0.5) -> DataFrame:
    """Maximal runs of scores above least: start, end, peak_score of the last five scores up to the run's end, zone_max."""
    w = Window.partitionBy(file).orderBy(order)
    rows = scored.withColumns({"_hot": F.col("score") > least, "_peak": F.max("score").over(w.rowsBetween(-4, 0))})
    rows = rows.withColumn("_new", F.when(F.col("_hot") & ~F.coalesce(F.lag("_hot").over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("zone", F.sum("_new").over(w)).where("_hot")
    return rows.groupBy(file, "zone").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.round(F.max_by("_peak", order), 3).alias("peak_score"), F.round(F.max("score"), 3).alias("zone_max")
    )


def severity(score: Column) -> Column:
    return F.when(score > 0.7, "high").otherwise("medium")


def _prefix(name: Column, least: float) -> Column:
    """The rarest characters of a name (each with its number) of which two names with a ratio of least share one.

    A ratio of least means at least n * least / (2 - least) common characters of a name of n, so one of the first
    n - that + 1 in any fixed order is common."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    n = F.size(chars)
    numbered = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((-F.size(F.filter(F.slice(chars, F.lit(1), i), lambda c: c == F.element_at(chars, i)))).alias("k"), F.element_at(chars, i).alias("c")))
    need = F.ceil(n * F.lit(least / (2 - least)) - 1e-9).cast("int")
    return F.when(n == 0, F.array().cast("array<struct<k:int,c:string>>")).otherwise(F.slice(F.array_sort(numbered), F.lit(1), n - need + 1))


def redundancies(chunks: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of like functions of two files, from chunks(ord, file, name, code): 0.35 name + 0.65 code similarity, by difflib.

    Names that tell nothing are left out; of pairs with the same two (file, name) the first counts. Names are compared once
    each, not once a chunk: those that share a character of their prefixes and have lengths that allow the ratio. Chunks with
    one name meet by that name. The pairs themselves are the result, and as many as there are.
    """
    named = chunks.where(F.col("name").isNotNull() & (F.col("name") != "") & ~F.col("name").isin(*NAMELESS))
    for start in NAMELESS_START:
        named = named.where(~F.col("name").startswith(start))
    named = named.withColumn("low", F.lower("name"))
    names = named.select("low").distinct()
    keyed = names.select("low", F.length("low").alias("len"), F.explode(_prefix(F.col("low"), least)).alias("t"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = a.join(b, F.col("a.t") == F.col("b.t")).where(f"a.low <> b.low AND a.len >= b.len * {least / (2 - least)} - 1e-9 AND b.len >= a.len * {least / (2 - least)} - 1e-9")
    near = near.select(F.col("a.low").alias("n1"), F.col("b.low").alias("n2")).distinct().withColumn("name_score", sequence_ratio("n1", "n2")).where(F.col("name_score") >= least)
    alike = near.union(names.select(F.col("low").alias("n1"), F.col("low").alias("n2"), F.lit(1.0).alias("name_score")))
    left = named.select("ord", F.col("file").alias("f1"), F.col("name").alias("m1"), F.col("low").alias("n1"), F.lower(F.substring("code", 1, 600)).alias("c1"))
    right = named.select(F.col("ord").alias("other"), F.col("file").alias("f2"), F.col("name").alias("m2"), F.col("low").alias("n2"), F.lower(F.substring("code", 1, 600)).alias("c2"))
    pairs = left.join(alike, "n1").join(right, "n2").where("ord < other AND f1 <> f2")
    one, two = F.concat_ws(":", F.col("f1").cast("string"), "m1"), F.concat_ws(":", F.col("f2").cast("string"), "m2")
    first = pairs.groupBy(F.least(one, two).alias("k1"), F.greatest(one, two).alias("k2")).agg(F.min_by(F.struct("ord", "other", "name_score", "c1", "c2"), F.struct("ord", "other")).alias("p")).select("p.*")
    return first.select("ord", "other", F.round(0.35 * F.col("name_score") + 0.65 * sequence_ratio("c1", "c2"), 2).alias("score"))
