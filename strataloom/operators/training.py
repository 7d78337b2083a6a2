"""Training-data queries: pairs by category and by source, automatic ratings, exports and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signal_score, split_prompt, stripped
from .feedback import best_signal


def auto_rating(labels: Column, level: Column, quality: Column) -> Column:
    """Stars without a model: five for labelled functions, classes and blocks, down to two for what tells nothing."""
    labelled, fine = F.size(labels) > 0, F.coalesce(level.isin("function", "class", "block"), F.lit(False))
    some = fine | F.coalesce(level.isin("section", "view_fact", "view_decision"), F.lit(False))
    return F.when(labelled & fine, "5").when(labelled | (fine & (F.coalesce(quality, F.lit(0.0)) > 0)), "4").when(some, "3").otherwise("2")


def auto_feedback(chunks: DataFrame, feedback: DataFrame, batch: int | None = None) -> DataFrame:
    """Ratings of chunks that have none."""
    rows = chunks.join(feedback.select("chunk_id"), "chunk_id", "left_anti")
    rows = rows.orderBy("chunk_id").limit(batch) if batch else rows
    return rows.select("chunk_id", auto_rating(F.col("category_labels"), F.col("chunk_level"), F.col("quality_score")).alias("signal"))


def category_pairs(chunks: DataFrame, feedback: DataFrame, limit: int | None = None, least_chars: int = 50) -> DataFrame:
    """(chunk_id, text, labels) of labelled chunks with a positive rating or none, best first; texts cut to 800."""
    signals = best_signal(feedback)
    rows = chunks.where((F.size("category_labels") > 0) & (F.length("text") >= least_chars)).join(signals, "chunk_id", "left")
    rows = rows.where(F.col("signal").isNull() | F.col("signal").isin("positive", "4", "5"))
    rows = rows.select("chunk_id", F.substring("text", 1, 800).alias("text"), F.array_join("category_labels", ",").alias("labels"), "quality_score")
    return rows.orderBy(F.desc("quality_score"), "chunk_id").limit(limit) if limit else rows


# The order of levels in a context.
LEVELS = {"file": 0, "class": 1, "function": 2, "block": 3, "section": 4}


def context_pairs(chunks: DataFrame, feedback: DataFrame, budget: int = 3000) -> DataFrame:
    """Of each source (source_id, context, chunks, labels, avg_rating, prompt, completion): its chunks by level, rating and age,
    files cut to 500 and others to 300 characters, until the budget is first exceeded; sources without any text are left out.

    The running sum finds the prefix first, so what is gathered into one text is bounded by the budget; labels are a vocabulary."""
    scores = feedback.groupBy("chunk_id").agg(F.sum(signal_score(F.col("signal"))).alias("rating"))
    rows = chunks.join(scores, "chunk_id", "left").withColumn("level", F.coalesce("chunk_level", F.lit("")))
    all_labels = rows.select("source_id", F.explode("category_labels").alias("label")).where("trim(label) <> ''").groupBy("source_id").agg(F.sort_array(F.collect_set(F.trim("label"))).alias("labels"))
    whole = rows.groupBy("source_id").agg(F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), 6).alias("avg_rating"), F.count(F.lit(1)).alias("chunks"))
    part = F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.when(F.col("level") == "file", 500).otherwise(300))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("level")], F.lit(9))
    rows = rows.withColumns({"part": part, "_rank": rank, "rating": F.coalesce("rating", F.lit(0.0))}).where("part <> ''")
    order = Window.partitionBy("source_id").orderBy("_rank", F.desc("rating"), *(["created_at"] if "created_at" in chunks.columns else []), "chunk_id")
    taken = rows.withColumns({"_run": F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_n": F.row_number().over(order)}).where(F.col("_run") <= budget)
    entry = F.concat(F.lit("### ["), "level", F.lit("] "), F.element_at(F.split("source_id", "/"), -1), F.lit("\n"), "part")
    context = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", entry.alias("e")))), lambda x: x["e"]), "\n\n")
    out = whole.join(taken.groupBy("source_id").agg(context.alias("context")), "source_id").join(all_labels, "source_id", "left")
    out = out.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    listed = F.array_join("labels", ", ")
    hint = F.when(F.size("labels") > 0, F.concat(F.lit(" (Kategorien: "), listed, F.lit(")"))).otherwise("")
    task = F.concat(F.lit("Analysiere den Code in `"), "source_id", F.lit("`"), hint, F.lit(" und beschreibe die Hauptverantwortlichkeiten."))
    known = F.when(F.size("labels") > 0, F.concat(F.lit(" Erkannte Labels: "), listed, F.lit("."))).otherwise("")
    return out.withColumns(
        {
            "prompt": F.concat(F.lit("<memory_context>\n"), "context", F.lit("\n</memory_context>\n\nAufgabe: "), task),
            "completion": F.concat(F.lit("Der Memory-Kontext für `"), "source_id", F.lit("` enthält "), F.col("chunks").cast("string"), F.lit(" Chunk(s) über "), F.size("labels").cast("string"), F.lit(" Kategorie(n)."), known),
        }
    )


def prompt_hash(system: Column, user: Column) -> Column:
    return F.substring(F.sha2(F.concat(system, F.lit("\n"), user), 256), 1, 16)


def export_diff(entries: DataFrame, exported: DataFrame) -> DataFrame:
    """Entries(system, user, ...) whose prompt was not exported yet, each prompt once."""
    return entries.withColumn("prompt_hash", prompt_hash(F.col("system"), F.col("user"))).dropDuplicates(["prompt_hash"]).join(exported.select("prompt_hash"), "prompt_hash", "left_anti")


def formatted(entries: DataFrame, form: str) -> DataFrame:
    """Log entries as raw rows, alpaca rows (the prompt cut at its first file line) or sharegpt conversations."""
    prompt, response = F.coalesce("prompt", F.lit("")), F.coalesce("raw_response", F.lit(""))
    if form == "raw":
        return entries.select(prompt.alias("prompt"), response.alias("response"))
    if form == "alpaca":
        at = F.instr(prompt, "\nDatei:")
        head = F.when(at > 0, F.substring(prompt, F.lit(1), at - 1)).otherwise(prompt)
        return entries.select(stripped(head).alias("instruction"), F.when(at > 0, stripped(F.substring(prompt, at + 1, F.length(prompt)))).otherwise("").alias("input"), response.alias("output"))
    if form == "sharegpt":
        turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
        return entries.select(F.array(turn("human", prompt), turn("gpt", response)).alias("conversations"))
    raise ValueError(f"no such form: {form}")


def prepared(samples: DataFrame, partial: bool = False, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Chat messages of annotated samples (prompt_hash, prompt, raw_response, quality) that are good, or with partial nearly so,
    and have an answer of ten characters or more; validation marks a seeded share of them, at least one."""
    from .dedup import split_train

    rows = samples.where(F.col("quality").isin("good", *["partial"] * partial) & (stripped(F.col("prompt")) != "") & (F.length(stripped(F.col("raw_response"))) >= 10))
    parts = split_prompt(stripped(F.col("prompt")))
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(say("system", parts["system"]), say("user", parts["user"]), say("assistant", stripped(F.col("raw_response"))))
    return split_train(rows.select("prompt_hash", "quality", messages.alias("messages")), "prompt_hash", share, seed)


def labelled_log(log: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Log rows with a label from the verdicts(run_id, filename, verdict) on their file."""
    fine = F.col("verdict").isin("confirmed", "refined")
    v = verdicts.groupBy("run_id", "filename").agg(F.bool_and(fine).alias("all_ok"), F.bool_and(F.col("verdict") == "rejected").alias("all_bad"))
    rows = log.join(v, ["run_id", "filename"], "left")
    label = F.when(~F.col("parsed_ok"), "negative").when(F.col("findings_count") == 0, "neutral").when(F.col("all_bad"), "negative").when(F.col("all_ok"), "positive").otherwise("candidate")
    return rows.withColumn("label", label)


def importance_pairs(contexts: DataFrame) -> DataFrame:
    """One row a shown file of (repo, shown, truth): high if it is in the truth."""
    return contexts.select("repo", "truth", F.posexplode("shown").alias("pos", "file")).select("repo", "pos", "file", F.when(F.array_contains("truth", F.col("file")), "high").otherwise("low").alias("importance"))
