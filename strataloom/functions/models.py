"""Model calls behind one replaceable interface; what comes with the engine is deterministic and needs no network.

A Model has three functions over lists of texts. They run in Arrow batches, and over distinct texts only where a caller asks
for it, so that a text which occurs often is sent once. An error in one text gives that text's neutral value, not a failed job.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


def stub_vector(text: str, size: int = 64) -> list[float]:
    """Hashed words with signs, scaled to length 1: equal texts are equal, texts with common words are near."""
    out = [0.0] * size
    for word in re.findall("[a-z0-9]+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        out[h % size] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / n for x in out]


def stub_reply(prompt: str) -> str:
    """The first sentence of the prompt's last paragraph: enough for a summary, and the same each time."""
    last = [p for p in prompt.split("\n\n") if p.strip()]
    return re.split(r"(?<=[.!?])\s", last[-1].strip())[0][:500] if last else ""


@dataclass(frozen=True)
class Model:
    embed: Callable[[list[str]], list[list[float]]] = lambda texts: [stub_vector(t) for t in texts]
    reply: Callable[[list[str]], list[str]] = lambda prompts: [stub_reply(p) for p in prompts]


STUB = Model()


def _safely(call, texts: list[str], neutral) -> list:
    try:
        return list(call(texts))
    except Exception:
        out = []
        for t in texts:
            try:
                out.append(call([t])[0])
            except Exception:
                out.append(neutral)
        return out


def reply(prompt: Column, model: Model = STUB, batch: int = 10) -> Column:
    """A model's answer to a prompt; "" for a null prompt or a failed call."""

    def run(prompts: pd.Series) -> pd.Series:
        asked = [p or "" for p in prompts]
        return pd.Series([x for i in range(0, len(asked), batch) for x in _safely(model.reply, asked[i : i + batch], "")], dtype=object)

    return F.pandas_udf(run, StringType())(prompt)


def embed(text: Column, model: Model = STUB, batch: int = 10) -> Column:
    """A text's vector; null for a failed call."""

    def run(texts: pd.Series) -> pd.Series:
        asked = [t or "" for t in texts]
        return pd.Series([x for i in range(0, len(asked), batch) for x in _safely(model.embed, asked[i : i + batch], None)], dtype=object)

    return F.pandas_udf(run, ArrayType(FloatType()))(text)


def embedded(rows: DataFrame, text: str, model: Model = STUB) -> DataFrame:
    """rows with embedding, asked for once for each distinct text."""
    known = rows.select(text).distinct().withColumn("embedding", embed(F.col(text), model))
    return rows.join(known, text, "left")


def verdicts(findings: DataFrame, prompt: Column, model: Model = STUB) -> DataFrame:
    """findings with a verdict: rejected where the reply says so, confirmed or refined where it does, else confirmed.

    A failed call keeps its finding, with the verdict error."""
    answer = F.lower(reply(prompt, model))
    word = F.when(answer == "", "error").when(answer.rlike("reject|verworfen|abgelehnt"), "rejected").when(answer.rlike("refine|präzis"), "refined").otherwise("confirmed")
    return findings.withColumn("verdict", word)


def kept(judged: DataFrame) -> DataFrame:
    return judged.where("verdict <> 'rejected'")


def categorized(chunks: DataFrame, labels: list[str], prompt: Column, path: Column, model: Model = STUB, mode: str = "hybrid", most: int = 5) -> DataFrame:
    """chunks with category_labels, category_source and category_confidence from a reply's label line.

    inductive keeps what the reply says, deductive known labels only, hybrid also plausible new ones that are marked [neu].
    Tests get the label tests where it is known. A failed or empty reply leaves it to the path, with a confidence of 0.5.
    """
    from .text import is_test_path, label_line, path_labels, plausible_label

    said = F.transform(F.split(label_line(F.col("_said")), "[,\n]"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-•*]\s*", "")))
    said = F.filter(said, lambda x: (x != "") & (F.length(x) <= 60) & (F.size(F.split(F.trim(x), r"\s+")) <= 4))
    known = F.array(*[F.lit(x.lower()) for x in labels if x]) if labels else F.array().cast("array<string>")
    inner = lambda x: F.lower(F.trim(F.substring(x, 6, 100)))
    marked = lambda x: F.lower(x).startswith("[neu]")

    def one(x: Column) -> Column:
        mine = F.when(F.array_contains(known, F.lower(x)), F.lower(x))
        if mode == "inductive":
            return x
        if mode == "deductive":
            return mine
        return F.when(marked(x), F.when(F.array_contains(known, inner(x)), inner(x)).when(plausible_label(inner(x)), x)).otherwise(mine)

    found = F.filter(F.transform(said, one), lambda x: x.isNotNull())
    if "tests" in {x.lower() for x in labels}:
        found = F.when(is_test_path(path) & ~F.array_contains(found, "tests") & ~F.array_contains(found, "[neu]tests"), F.array_append(found, F.lit("tests"))).otherwise(found)
    rows = chunks.withColumn("_said", reply(prompt, model))
    failed = F.col("_said") == ""
    rows = rows.withColumn("category_labels", F.when(failed, path_labels(path)).otherwise(F.slice(found, 1, most)))
    some = F.size("category_labels") > 0
    return rows.withColumns(
        {"category_source": F.when(failed, "fallback").otherwise(mode), "category_confidence": F.when(~some, 0.0).when(failed, 0.5).otherwise(1.0)}
    ).drop("_said")


def views(sources: DataFrame, model: Model = STUB, kinds: tuple[str, ...] = ("facts", "decisions", "entities", "keywords")) -> DataFrame:
    """Chunks (source_id, level, ordinal, text): a model's views of each text that are not empty, and the whole text."""
    asked = [F.struct(F.lit(f"view_{k}").alias("level"), reply(F.concat(F.lit(f"List the {k} of this text.\n\n"), F.col("text")), model).alias("text")) for k in kinds]
    whole = F.struct(F.lit("view_full").alias("level"), F.col("text").alias("text"))
    rows = sources.select("source_id", F.posexplode(F.array(*asked, whole)).alias("ordinal", "v"))
    return rows.select("source_id", "v.level", "ordinal", "v.text").where("length(trim(text)) > 0")


def advice(candidates: DataFrame, query: str, model: Model = STUB) -> DataFrame:
    """(chunk_id, advice): the relevance that a reply states, cut to 0..1; 0.5 where it is no number."""
    answer = reply(F.concat(F.lit(f"Rate from 0 to 1 how relevant this is to: {query}\n\n"), F.substring("text", 1, 300)), model)
    number = F.trim(answer).try_cast("double")
    return candidates.select("chunk_id", F.when(number.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).alias("advice"))


def batches(texts: list[str], size: int) -> Iterator[list[str]]:
    for i in range(0, len(texts), size):
        yield texts[i : i + size]
