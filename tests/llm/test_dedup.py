import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.llm import arrays, exact_dedup, near_dedup, substring_dedup, suffix_dedup, windows
from strataloom.llm.common import Tables
from strataloom.llm.components import connected_components

from . import brute

SCHEMA = "doc_id long, text string, key string, rep long, lang string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "x", 7, "en") for k, t in rows], SCHEMA)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(200)] + ["the", "of", "é", "漢字"]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, "ONE two"), (6, "one TWO")]
    base = rng.choices(vocabulary, k=120)
    for i in range(7, n):
        kind = rng.randrange(6)
        if kind == 0:
            words = list(base)
            for _ in range(rng.randrange(0, 14)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind == 1 and i > 10:
            rows.append((i, rng.choice(rows)[1]))
            continue
        elif kind == 2:
            words = rng.choices(vocabulary, k=30) + [passage] + rng.choices(vocabulary, k=20)
        elif kind == 3:
            words = ["spam"] * rng.randrange(1, 90)
        else:
            words = rng.choices(vocabulary, k=rng.randrange(1, 150))
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    want = brute.near(rows)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_large_group(spark, monkeypatch):
    """Copies of different distance to one text, in blocks smaller than their number."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 4)
    rng = random.Random(9)
    base = ["b%d" % i for i in range(60)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(60)] = "c%d" % rng.randrange(9999)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near(rows)


def test_near_keeps_columns(spark):
    rows = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (3, "z")]
    clash = frame(spark, rows).withColumns({"_kept_id": F.lit(1), "_sha256": F.lit("s"), "row": F.lit("r"), "_maybe": F.lit(False)})
    assert near_dedup.drop_near_duplicates(clash).columns == clash.columns
    assert sorted((r.doc_id, r.row, r._sha256) for r in exact_dedup.drop_copies(clash).collect()) == [(2, "r", "s"), (3, "r", "s")]
    kept = near_dedup.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "rep", "lang"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("hot", [None, 1])
def test_repeated_bytes(spark, hot):
    rows = corpus(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_strings(frame(spark, rows), 200, hot).collect()}
    assert got == brute.repeated_bytes(rows, 200)


@pytest.mark.parametrize("hot", [None, 1])
def test_earlier_words(spark, hot):
    rows = corpus(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.earlier_passages(frame(spark, rows), 20, hot).collect()}
    assert got == brute.earlier_words(rows, 20)


def thue_morse():
    """Two different words of 1024 letters that have one polynomial hash modulo 2**64, whatever its base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_hashes_that_can_be_made_equal(spark):
    a, b = thue_morse()
    rows = [(1, a), (2, b)]
    assert sorted(r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()) == [1, 2]
    assert brute.near(rows)[2][1] == 2
    tail = " ".join("t%d" % i for i in range(19))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.earlier_passages(frame(spark, rows)).collect()}
    assert got == brute.earlier_words(rows, 20) and got[2][1] == 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_strings(frame(spark, rows)).collect()}
    assert got == brute.repeated_bytes(rows, 200)


@pytest.mark.parametrize("hot", [None, 1])
def test_repeated_and_missing_ids(spark, hot):
    """Texts under one doc_id are told apart; rows without one take part, after the others."""
    rng = random.Random(8)
    some = [" ".join(rng.choices(["w%d" % i for i in range(500)], k=n)) for n in (60, 300, 40, 90)]
    rows = [(7, some[0]), (7, some[1]), (7, "x " + some[0] + " y"), (None, some[1]), (None, some[2]), (None, "z " + some[2]), (9, some[3]), (9, some[3]), (None, None)]
    got = suffix_dedup.repeated_strings(frame(spark, rows), hot=hot).collect()
    want = brute.repeated_bytes(list(enumerate(t for _, t in rows)), 200)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want.values())
    got = substring_dedup.earlier_passages(frame(spark, rows), hot=hot).collect()
    assert len(got) == len(rows)
    cut = {}
    for r in got:
        cut.setdefault((r.doc_id, r.n_words), []).append(r.n_removed)
    # which of two texts of one id, or without one, comes first is settled by their hashes
    assert sorted([cut[7, 60][0], cut[7, 62][0]]) == [0, 60] and cut[7, 300] == [0] and cut[None, 300] == [300]
    assert sorted([cut[None, 40][0], cut[None, 41][0]]) == [0, 40] and cut[9, 90] == [0, 0] and cut[None, 0] == [0]


@pytest.mark.parametrize("hot", [None, 3])
def test_common_passage(spark, hot, monkeypatch):
    """A passage of many documents, in surroundings of their own, and a phrase of which a task holds many copies."""
    monkeypatch.setattr(windows, "HELD", 50)
    rng = random.Random(6)
    own = lambda: " ".join("o%d" % rng.randrange(10**6) for _ in range(30))
    passage, line = own(), own()[:60]
    rows = [(i, f"{own()} {passage} {own()} {line} {own()}" if i % 2 else passage) for i in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_strings(frame(spark, rows), hot=hot).collect()}
    assert got == brute.repeated_bytes(rows, 200)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.earlier_passages(frame(spark, rows), hot=hot).collect()}
    assert got == brute.earlier_words(rows, 20)


def test_suffix_order():
    data = np.frombuffer((b"abracadabra" * 40 + b"xyz" * 50 + b"abracadabra" * 3), np.uint8)
    for width in (3, 8, 20, 50):
        rank = arrays.Suffixes(arrays.byte_symbols(data, min(8, width)), min(8, width)).upto(width)
        heads = [data[i : i + width].tobytes() for i in range(len(data) - width + 1)]
        assert sorted(range(len(heads)), key=lambda i: (heads[i], i)) == sorted(range(len(heads)), key=lambda i: (rank[i], i))
        assert len(set(heads)) == len({rank[i] for i in range(len(heads))})


def test_greedy_factors():
    """Against a plain parse, with factors whose ends other factors cross."""
    rng = random.Random(4)
    for _ in range(60):
        phrases = [[rng.randrange(2) for _ in range(rng.randrange(3, 14))] for _ in range(5)]
        group, row, begin = [], [], [0]
        names = {}
        for r, p in enumerate(phrases):
            for i in range(len(p) - 2):
                group.append(names.setdefault(tuple(p[i : i + 3]), len(names)))
                row.append(r)
            begin.append(len(group))
        group, row, begin = (np.array(x) for x in (group, row, begin))
        source = np.array([list(group).index(g) for g in group])
        hits = np.flatnonzero(source < np.arange(len(group)))
        found = substring_dedup.greedy_factors(group, source, hits, begin, row)
        assert sorted(x for i, m in found for x in range(i, i + m)) == hits.tolist()
        for i, m in found:
            r = source[i]
            assert (group[i : i + m] == group[r : r + m]).all()
            longer = i + m < begin[row[i] + 1] and r + m < begin[row[r] + 1]
            assert not longer or group[i + m] != group[r + m]


def test_long_texts_in_stretches(spark, monkeypatch):
    """Texts longer than a segment, with repeats across its bounds."""
    monkeypatch.setattr(windows, "SEGMENT", 1000)
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    values[2000:2900] = values[500:1400]
    kind = windows.word_kind(20, 5)
    whole = windows.phrases(kind, values, np.array([0, 3000]))
    parts = [windows.phrases(kind, values[lo:hi], np.array([0, hi - lo])) for lo, hi in windows._stretches(kind, 3000)]
    assert (whole[2] - whole[1] + 1).sum() == sum((p[2] - p[1] + 1).sum() for p in parts) == 2981
    monkeypatch.undo()
    text = " ".join("t%d" % v for v in values)
    got = substring_dedup.earlier_passages(frame(spark, [(1, text)])).first()
    assert (got.n_words, got.n_removed, got.kept_sha256) == brute.earlier_words([(1, text)], 20)[1]


@pytest.mark.parametrize("most", [exact_dedup.MOST_BITS, exact_dedup.PER_BITMAP])
def test_exact(spark, most):
    rows = corpus(5)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_copies(frame(spark, rows), most).collect()}
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    want = {k: (max(groups[t or ""]), len(groups[t or ""]), k == max(groups[t or ""])) for k, t in rows}
    assert got == want
    kept = exact_dedup.drop_copies(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(max(g) for g in groups.values())


def test_filters_by_range(spark):
    """With a small bound there are many filters, and few rows that have no copy go on."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 40, F.col("id") % 20).otherwise(F.col("id"))).alias("text"))
    most = exact_dedup.PER_BITMAP
    assert exact_dedup.ranges(4000, most) == 2 and exact_dedup.ranges(0, most) == 1 and exact_dedup.ranges(10**9) == 60
    hashes = docs.select("doc_id", *[c.alias(k) for k, c in exact_dedup._hashes(F.col("text")).items()])
    assert 40 <= exact_dedup.possible_copies(hashes, 4000).where("_maybe").count() < 120
    for bits in (most, exact_dedup.MOST_BITS):
        tables = Tables(spark, "t")
        groups = exact_dedup.repeated_texts(hashes, tables, 4000, bits)
        assert sorted((r.keep_id, r.group_size) for r in groups.collect()) == [(i + 20, 2) for i in range(20)]
        alone, maybe = exact_dedup._with_groups(hashes, groups, 20, bits)
        assert 40 <= maybe.count() < 60 and alone.count() + maybe.count() == 4000
        assert exact_dedup.drop_copies(docs, bits).count() == 3980


def test_repeated_rows(spark):
    rows = [(1, "same text"), (1, "same text"), (2, "other")]
    assert sorted(r.group_size for r in exact_dedup.exact_copies(frame(spark, rows)).collect()) == [1, 2, 2]
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(frame(spark, rows)).collect()) == [1, 2]
    assert [r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).orderBy("doc_id").collect()] == [1, 1, 2]


@pytest.mark.parametrize("most", [exact_dedup.MOST_BITS, exact_dedup.PER_BITMAP])
def test_rows_without_ids_pass_both_stages(spark, most):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, "only here " + long), (None, "twice " + long[::-1]), (None, "twice " + long[::-1]), (None, "has an id"), (4, "has an id"), (None, None), (None, "")]
    rows += [(10 + i, f"filler number {i} of its own {i * i}") for i in range(3000)]
    want = ["4 has an id", "None None", "None only here " + long, "None twice " + long[::-1]]
    kept = exact_dedup.drop_copies(frame(spark, rows), most).where("doc_id < 10 OR doc_id IS NULL").collect()
    assert sorted(f"{r.doc_id} {r.text or None}" for r in kept) == want
    near = [*rows[:7], (None, "only here " + long + " once more"), (5, "near " + long.upper()), (None, "near " + long.upper() + " too"), (6, "near " + long.upper())]
    got = near_dedup.drop_near_duplicates(frame(spark, near))
    assert got.columns == frame(spark, near).columns
    texts = sorted(f"{r.doc_id} {r.text}" for r in got.collect())
    alone = [x for x in texts if "only here" in x or "near" in x]
    assert "4 has an id" in texts and "None has an id" not in texts
    assert texts.count("None twice " + long[::-1]) == 1 and "None None" in texts and "None " in texts
    assert len(alone) == 1 and alone[0] == "5 near " + long.upper()


def test_null_ids(spark):
    rows = [(None, "a b c"), (4, "a b c"), (None, None)]
    assert sorted((r.doc_id is None, r.kept) for r in exact_dedup.exact_copies(frame(spark, rows)).collect()) == [(False, True), (True, False), (True, False)]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got if r.kept) == [4] and len(got) == 3


@pytest.mark.parametrize("run", [near_dedup.near_duplicates, exact_dedup.exact_copies, suffix_dedup.repeated_strings, substring_dedup.earlier_passages])
def test_empty(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Tables(spark, "t")).collect()}
    want = brute.components([x for x in links if x[0] != x[1]])
    assert got == want


def test_words_and_hashes():
    texts = ["", "a  b", "é\tx", None, "end "]
    raw, at = arrays.column_bytes(pa.array(texts))
    start, end, first = arrays.words(raw, at)
    assert [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == ["a", "b", "é", "x", "end"]
    assert first.tolist() == [0, 0, 2, 4, 4, 5]
    assert len(set(arrays.word_hashes(raw, start, end).tolist())) == 5
    assert arrays.joined(raw, start, end)[0].tobytes().decode() == "a b é x end "
    x = np.arange(50, dtype=np.uint64)
    assert arrays.sliding_min(x[::-1].copy(), 7).tolist() == [int(x[::-1][i : i + 7].min()) for i in range(44)]
    grams = arrays.Rolling(np.concatenate([x, x]), arrays.WORDS).grams(6)
    assert grams[3] == grams[53] != grams[4]
