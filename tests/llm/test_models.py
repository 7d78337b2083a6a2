import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import mixing, quality, registry, url_filter
from strataloom.llm.common import Tables, documents, table

from .test_dedup import frame


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    rows = registry.op4_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_votes_against_plain_loops():
    """Each score against cosines and votes that are computed one by one."""
    import pyarrow as pa

    from strataloom.llm import arrays

    texts = ["spam spam spam spam", "a fine text about rivers", "1234 5678 $$$$ ####", "another fine text about hills", "BUY NOW!!! BUY", "", "rivers and hills"] + ["漢字 かな %d" % i for i in range(4)]
    raw, at = arrays.column_bytes(pa.array(texts))
    model = quality.fit(np.concatenate(list(quality.features(raw, at))), np.array([0, 1, 0, 1, 0, 1, 1, 0, 0, 0, 0]), 6)
    got = np.concatenate([model.score(x, 4) for x in quality.features(raw, at)])
    vectors = model.latent(np.concatenate(list(quality.features(raw, at))))
    for v, score in zip(vectors, got, strict=True):
        cosines = [(round(sum(float(a) * float(b) for a, b in zip(v, w, strict=True)), 4), q) for w, q in zip(model.vectors, model.quality, strict=True)]
        least = sorted((c for c, _ in cosines), reverse=True)[3]
        cosines = [x for x in cosines if x[0] >= least]
        weights = [math.exp(12 * c) for c, _ in cosines]
        plain = sum(w * q for w, (_, q) in zip(weights, cosines, strict=True)) / sum(weights)
        assert score == pytest.approx(plain, abs=2e-3)
    # a block's bounds don't change a score
    one = [model.score(next(quality.features(raw[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))), 4)[0] for i in range(len(texts))]
    assert one == pytest.approx(got.tolist(), abs=2e-5)


def test_quality_repeats_and_clashes(spark):
    docs = frame(spark, [(3, "a plain text"), (3, "a plain text"), (None, "a plain text"), (5, "x" * 300)]).withColumns({"quality": F.lit(9), "score": F.lit("s"), "held_out": F.lit(1)})
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id != 5}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [None]
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "a plain text"), (4, "a plain text"), (5, "x" * 300_000)])
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (4, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[3].score == got[4].score and got[1].score == got[2].score
    none = quality.quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs.where("false"), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


@pytest.mark.parametrize("name", ["op5_source_mixing", "op9_url_filter", "op10_exact_dedup"])
def test_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, cur.fetchall()))


def test_rules(spark):
    urls = ["http://a.Example.ORG/es/x", "http://example.org/en/12?q", "http://example.org/de", "http://x.com/fr/1#t", "http://com/de/", "http://mycom/de/", "no url", None, "http://org", "ftp://u@h:1/p//?a", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.url_verdicts(pages, labels).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1")
    assert got[2] == ("example.org", "/de", "org/")
    assert got[3] == ("x.com", "/fr/1", "com/fr/")
    assert got[4] == ("com", "/de/", "com/de/")
    assert got[5] == ("mycom", "/de/", None)
    assert got[6] == got[7] == ("", "", None)
    assert got[8] == ("org", "", None)
    assert got[9] == ("u@h:1", "/p//", None)
    assert got[10] == ("b:", "//c/d", None)
    assert url_filter.url_verdicts(pages.where("false"), labels).count() == 0


def test_reputation_shrinks(spark):
    pages = spark.createDataFrame([(i, f"http://{'good' if i < 100 else 'bad'}.x.com/p") for i in range(200)] + [(200, "http://new.x.com/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(200)] + [(5, None)], "doc_id long, quality int")
    got = {r.host: r for r in url_filter.host_reputation(pages, labels).collect()}
    assert got["good.x.com"].bound > 0.8 > got["new.x.com"].bound > got["bad.x.com"].bound
    assert (got["new.x.com"].n, got["good.x.com"].good) == (0, 100)


def test_raking(spark):
    rows = [(i, "w " * (10 + i % 7), "ab"[i % 3 == 0], ["en", "de"][i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cells = mixing.raked(mixing._described(docs), {"source": {"a": 0.2, "b": 0.8}}, rounds=20)
    total = cells.agg(F.sum(F.col("tokens") * F.col("ratio")).alias("t")).first().t
    share = {r._source: r.t / total for r in cells.groupBy("_source").agg(F.sum(F.col("tokens") * F.col("ratio")).alias("t")).collect()}
    assert share["a"] == pytest.approx(0.2, abs=1e-6) and share["b"] == pytest.approx(0.8, abs=1e-6)
    got = mixing.mixing_weights(docs, {"source": {"a": 0.2, "b": 0.8}}, rounds=20).collect()
    assert max(r.probability for r in got) == 1
    tokens = {k: sum(r.n_tokens * r.probability for r in got if r.source == k) for k in "ab"}
    assert tokens["a"] / sum(tokens.values()) == pytest.approx(0.2, abs=1e-4)
    assert all(r.topic == r.lang for r in mixing.mixing_weights(docs, topic=F.col("lang")).collect())


def test_drawn_marginals_of_the_query(spark):
    """The tokens to be drawn of the query's own tables have the wanted share of each key to within 1 %."""
    got = registry.op5_source_mixing(spark, "/root/testdata/sf0.01").collect()
    every, drawn = sum(r.n_tokens for r in got), sum(r.n_tokens * r.probability for r in got)
    for d in mixing.DIMENSIONS:
        have, take = {}, {}
        for r in got:
            have[r[d]] = have.get(r[d], 0) + r.n_tokens / every
            take[r[d]] = take.get(r[d], 0) + r.n_tokens * r.probability / drawn
        scale = sum(v**mixing.TEMPERATURE for v in have.values())
        for k, v in have.items():
            assert take[k] == pytest.approx(v**mixing.TEMPERATURE / scale, rel=0.01), (d, k)


def test_drawn_shares(spark):
    """The tokens of the drawn rows, not only the raked weights, have the wanted shares, though a cell's ratio is above 1."""
    rows = [(i, "w " * (10 + i % 7), "ab"[i % 3 == 0], ["en", "de"][i % 2]) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    drawn = mixing.sample_mixture(docs, {"source": {"a": 0.2, "b": 0.8}}).collect()
    assert len({r.doc_id for r in drawn}) == len(drawn)
    tokens = lambda s: sum(len(r.text.split()) for r in drawn if r.source == s)
    assert tokens("a") / (tokens("a") + tokens("b")) == pytest.approx(0.2, abs=0.02)
    assert sum(r.source == "b" for r in drawn) == 3000
    # a hot source and many small ones, by the default exponent
    rows = [(i, "w w w", "hot" if i % 3 == 0 else f"s{i % 67}", "en") for i in range(20100)]
    drawn = mixing.sample_mixture(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    want = (1 / 3) ** 0.7 / ((1 / 3) ** 0.7 + 67 * (2 / 3 / 67) ** 0.7)
    assert sum(r.source == "hot" for r in drawn) / len(drawn) == pytest.approx(want, abs=0.01)


def test_raking_goes_on_to_convergence(spark):
    cells = [("a", "en", 1000), ("a", "de", 1), ("b", "en", 1), ("b", "de", 30)]
    docs = spark.createDataFrame([(i, "w " * n, s, lang) for i, (s, lang, n) in enumerate(cells)], "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.3, "b": 0.7}, "lang": {"en": 0.6, "de": 0.4}}
    described = mixing._described(docs)
    assert mixing._miss(mixing._raked(mixing._targeted(described, targets, 0.7), 1)) > 0.05
    rate = {(r._source, r._lang): r._rate for r in mixing.raked(described, targets, 0.7, turn=1).collect()}
    drawn = {k: rate[k] * n for *k, n in cells for k in [tuple(k)]}
    assert max(rate.values()) == 1
    assert (drawn["a", "en"] + drawn["a", "de"]) / sum(drawn.values()) == pytest.approx(0.3, abs=1e-5)
    assert (drawn["a", "en"] + drawn["b", "en"]) / sum(drawn.values()) == pytest.approx(0.6, abs=1e-5)


def test_mixing_edges(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (3, "a b", None, "en"), (3, "a b", None, "en"), (None, "c", "s", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, ratio string")
    got = mixing.mixing_weights(docs).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    assert len({r.sampled for r in got if r.doc_id == 3}) == 1
    assert mixing.sample_mixture(docs).columns == docs.columns
    assert mixing.mixing_weights(docs.where("false")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, tables = documents(spark, sf), Tables(spark, "test")
    want = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = tables.write(stage(spark, docs, sf), name)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            rows = out.collect()
            ids = [r.doc_id for r in rows]
            assert len(set(ids)) == len(ids) and set(ids) <= want
            if name == "exact":
                by = {}
                for r in docs.collect():
                    by[r.text] = max(by.get(r.text, -1), r.doc_id)
                assert set(ids) == set(by.values())
            if name == "near":
                from . import brute

                comp = brute.near([(r.doc_id, r.text) for r in docs.collect()])
                assert set(ids) == {c for _, c in comp.values()}
            want = set(ids)
        docs = out
    assert {r.doc_id for r in docs.collect()} == want
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
