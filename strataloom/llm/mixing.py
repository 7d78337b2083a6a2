"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts by source, language and topic are raked until they have the wanted share of each source, each language and each
topic; a document is then drawn with the ratio of its cell's raked to its actual tokens, scaled by one factor for all cells, the
largest ratio to 1, so that what is drawn has the wanted shares. mixing_weights rakes a fixed number of rounds, as its SQL does,
and sample_mixture to convergence.

What is raked are cells, the combinations of a source, a language and a topic at hand, in short plans with written tables between
them; their number does not grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 12
#: Rounds a plan; where raking goes on to convergence, until no key's share is off by more than MISS, or so many plans.
TURN, MISS, MOST_TURNS = 2, 1e-6, 128
#: Without a stated target, a key's share is its share of tokens to this power, scaled to 1.
TEMPERATURE = 0.7
_KEYS = [f"_{d}" for d in DIMENSIONS]
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """The topic where none is given: a coarse one by what a text mentions."""
    return (
        F.when(text.contains("icens"), "legal").when(text.contains("@"), "contact").when(text.rlike("[0-9]{4}"), "record").otherwise("prose")
    )


def _described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    of = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    keys = {"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_topic": of}
    return docs.withColumns(keys | {"_tokens": F.regexp_count(text, F.lit(WORD)).cast("long")})


def _targeted(described: DataFrame, targets: dict[str, dict[str, float]] | None, temperature: float) -> DataFrame:
    """(_source, _lang, _topic, tokens, w, _t of each key): cells with their share of tokens and the wanted shares of their keys."""
    cells = described.groupBy(*_KEYS).agg(F.sum("_tokens").alias("tokens")).where("tokens > 0")
    cells = cells.withColumn("w", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    for key, d in zip(_KEYS, DIMENSIONS, strict=True):
        stated = (targets or {}).get(d) or {}
        mine = Window.partitionBy(key)
        cells = cells.withColumn("_m", F.sum("w").over(mine))
        given = F.lit(None).cast("double")
        for k, v in stated.items():
            given = F.when(F.col(key) == k, F.lit(float(v))).otherwise(given)
        cells = cells.withColumns({"_given": given, "_free": F.when(given.isNull(), F.pow("_m", F.lit(temperature)))})
        # each key once, though it stands in several cells
        cells = cells.withColumn("_once", F.row_number().over(mine.orderBy(*_KEYS)) == 1)
        total = Window.partitionBy()
        cells = cells.withColumns({"_g": F.sum(F.when(F.col("_once"), F.col("_given"))).over(total), "_f": F.sum(F.when(F.col("_once"), F.col("_free"))).over(total)})
        left = F.greatest(F.lit(0.0), 1 - F.coalesce("_g", F.lit(0.0)))
        cells = cells.withColumn(f"_t{key}", F.coalesce("_given", F.col("_free") / F.col("_f") * left)).drop("_m", "_given", "_free", "_once", "_g", "_f")
    return cells


def _raked(cells: DataFrame, rounds: int) -> DataFrame:
    for _ in range(rounds):
        for key in _KEYS:
            cells = cells.withColumn("w", F.col("w") * F.col(f"_t{key}") / F.sum("w").over(Window.partitionBy(key)))
    return cells


def _rates(cells: DataFrame) -> DataFrame:
    """(_source, _lang, _topic, tokens, ratio, _rate): raked by actual tokens, and that by its largest value."""
    every = Window.partitionBy()
    cells = cells.withColumn("ratio", F.col("w") / (F.col("tokens") / F.sum("tokens").over(every)))
    return cells.select(*_KEYS, "tokens", "ratio", (F.col("ratio") / F.max("ratio").over(every)).alias("_rate"))


def _miss(cells: DataFrame) -> float:
    """The most by which the raked share of any source, language or topic is off its wanted one."""
    whole, offs = Window.partitionBy("d"), None
    for key in _KEYS:
        sums = cells.groupBy(key).agg(F.sum("w").alias("w"), F.first(f"_t{key}").alias("t")).select(F.lit(key).alias("d"), "w", "t")
        offs = sums if offs is None else offs.unionByName(sums)
    off = F.abs(F.col("w") / F.sum("w").over(whole) - F.col("t") / F.sum("t").over(whole))
    return offs.select(off.alias("off")).agg(F.max("off")).first()[0] or 0.0


def raked(described: DataFrame, targets=None, temperature: float = TEMPERATURE, rounds: int | None = None, turn: int = TURN, tables: Tables | None = None) -> DataFrame:
    """(_source, _lang, _topic, tokens, ratio, _rate), raked so many rounds, or to convergence.

    targets: shares by key, for any of source, lang and topic; keys without one share what is left by their tempered tokens.
    """
    tables = tables or Tables(described.sparkSession, "mixing")
    cells = tables.write(_targeted(described, targets, temperature), "cells")
    for n in range(-(-rounds // turn) if rounds else MOST_TURNS):
        cells = tables.write(_raked(cells, min(turn, rounds - n * turn) if rounds else turn), "raked")
        if not rounds and _miss(cells) <= MISS:
            break
    return _rates(cells)


def _draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 up to 1 that is fixed by the id and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def _weighed(described: DataFrame, rates: DataFrame) -> DataFrame:
    # a cell holds any number of documents: only the small side is looked up, and a hot one is split by adaptive execution
    return described.join(rates, _KEYS, "left").withColumn("_p", F.coalesce("_rate", F.lit(1.0)))


def mixing_weights(docs: DataFrame, targets=None, rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: int = 0, topic: Column | None = None) -> DataFrame:
    """For every row of docs(doc_id, text, lang, source, ...): doc_id, source, lang, topic, n_tokens, probability, sampled.

    n_tokens are the words [^\\x20\\x09-\\x0D]+ of the whole text, which are counted once. probability is the ratio of the raked to
    the actual tokens of the row's source, language and topic, by the largest such ratio, rounded to 6 places: the scarcest cell
    is taken whole, every other in proportion. sampled is drawn by a hash of doc_id, so rows that repeat an id share the draw.
    topic is a column of docs, or one by what a text mentions. Null texts are empty, null sources, languages and topics are the
    key ''; texts without words have probability 1, as they weigh nothing. An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    tables = Tables(docs.sparkSession, "mixing")
    described = _described(docs, topic).select(F.col("doc_id").cast("long").alias("doc_id"), *_KEYS, "_tokens")
    described = tables.write(described, "described")
    p = F.round("_p", 6)
    return _weighed(described, raked(described, targets, temperature, rounds, tables=tables).select(*_KEYS, "_rate")).select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), p.alias("probability"), (_draw(F.col("doc_id"), seed) < p).alias("sampled"),
    )


def sample_mixture(docs: DataFrame, targets=None, temperature: float = TEMPERATURE, seed: int = 0, topic: Column | None = None) -> DataFrame:
    """The drawn rows of docs, with all their columns, whatever their names; their tokens have the wanted shares, but for chance.

    No row is drawn twice, so the scarcest cell is taken whole and every other one in proportion to it: of all tokens, one by the
    largest ratio is drawn. Rows that repeat an id share the draw, and texts without words, null ones too, all stay; null sources,
    languages and topics are a key of their own. Wanted shares that no weights of the cells at hand can have are come near to. An
    empty table gives an empty result.
    """
    of = topic_of(F.coalesce(F.col("text"), F.lit(""))) if topic is None else topic
    rows = docs.select("doc_id", "text", "lang", "source", of.alias("_of"), F.struct(*docs.columns).alias("row"))
    described = _described(rows, F.col("_of"))
    found = _weighed(described, raked(described, targets, temperature).select(*_KEYS, "_rate"))
    return found.where(_draw(F.col("doc_id"), seed) < F.col("_p")).select("row.*")


def oracle(documents: str = "documents", rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: int = 0) -> str:
    """DuckDB SQL for mixing_weights without stated targets."""
    keys = DIMENSIONS
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
 CASE WHEN contains(t, 'icens') THEN 'legal' WHEN contains(t, '@') THEN 'contact' WHEN regexp_matches(t, '[0-9]{{4}}') THEN 'record' ELSE 'prose' END AS topic,
 len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM {documents}))""",
        "c0 AS (SELECT *, tokens / sum(tokens) OVER () AS w FROM (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL) WHERE tokens > 0)",
    ]
    for k in keys:
        steps.append(f"t_{k} AS (SELECT {k}, pow(m, {temperature}) / sum(pow(m, {temperature})) OVER () AS t FROM (SELECT {k}, sum(w) AS m FROM c0 GROUP BY {k}))")
    n = 0
    for _ in range(rounds):
        for k in keys:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.* REPLACE (w * t / sum(w) OVER (PARTITION BY {k}) AS w) FROM c{n} JOIN t_{k} USING ({k}))")
            n += 1
    steps.append(f"r AS (SELECT source, lang, topic, ratio / max(ratio) OVER () AS rate FROM (SELECT *, w / (tokens / sum(tokens) OVER ()) AS ratio FROM c{n}))")
    steps.append("p AS (SELECT d.*, round(coalesce(rate, 1.0), 6) AS probability FROM d LEFT JOIN r USING (source, lang, topic))")
    drawn = f"('0x' || md5('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT / 4294967296.0 < probability AS sampled"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, n_tokens, probability, {drawn} FROM p"


ORACLE = oracle()
