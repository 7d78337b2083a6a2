import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm import packing, tiff, token_counts
from strataloom.llm.bpe import WordBpe

from .test_dedup import corpus, frame

ODD = ["a<|endoftext|>b C'est <|startoftext|>", "x\n <|endoftext|> y", " lead", "trail ", "a  b\n\n c\t\td", "É İstanbul ΣΑΣ ß ﬁ ẞ", "it's 'll WE'RE 'S", "漢字 かな 1234 ½\x1cz \x85", "é" * 50 + "abc" * 400, "!!''s ...'re", "👍🏽👨‍👩‍👧 z", "e\u0301 a\u0300b", "they're 'real 'run ''re've ll'll", "x<|endoftext|>'re<|start <|startoftext|>"]


@pytest.fixture(scope="module")
def texts():
    return [t or "" for _, t in corpus(11, 30)] + ODD


def test_counts(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None), (0, texts[0])]
    counted = token_counts.token_counts(frame(spark, rows), path, 20, prefixes=True)
    got = counted.withColumns({"half": token_counts.tokens_before(F.col("prefix_tokens"), 17), "fit": token_counts.chars_within(F.col("prefix_tokens"), 9)}).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] if r.doc_id < len(texts) else ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n(t), n(t) > 20)
        assert len(r.prefix_tokens) == len(t) and (r.prefix_tokens or [0])[-1] == r.n_tokens
        assert r.half == n(t[:17])
        assert n(t[: r.fit]) <= 9 and all(c > 9 for c in r.prefix_tokens[r.fit :])
        head = t.encode()[: r.bytes_in_limit].decode()
        assert n(head) <= 20
        assert all(n(t[:i]) > 20 for i in range(len(head) + 1, min(len(t), len(head) + 12) + 1))
    assert token_counts.token_counts(frame(spark, []), path).count() == 0


def test_every_prefix(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, bpe = Tokenizer.from_file(path), WordBpe(path)
    rng = random.Random(1)
    for t in texts:
        counts = bpe.prefixes(t)
        for i in range(1, len(t) + 1) if len(t) < 60 else {rng.randint(1, len(t)) for _ in range(20)}:
            assert counts[i - 1] == len(lib.encode(t[:i], add_special_tokens=False).ids), (t[:i],)


def test_long_texts(spark):
    """A text of a megabyte, and one without white space, against the library."""
    path, pack = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "some words and 1234, don't! " * 40_000), (2, "abcdefghij" * 3000), (3, "é" * 4000)]
    lib, other = Tokenizer.from_file(path), Tokenizer.from_file(pack)
    got = token_counts.token_counts(frame(spark, rows), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(lib.encode(t, add_special_tokens=False).ids) for k, t in rows}
    packed = packing.pack_sequences(frame(spark, rows), pack).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: (r.n, r.m) for r in packed} == {k: (len(other.encode(t, add_special_tokens=False).ids) + 1,) * 2 for k, t in rows}


def test_word_programme():
    bpe = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    for word in ("internationalisation", "é" * 9, "zzzzqqqq", "the"):
        raw = word.encode()
        assert bpe.word_end(raw) == bpe.word_prefixes(raw)[-1]
        assert bpe.word_prefixes(raw) == [0, *(len(bpe.engine.encode_single_piece(raw[:i] + bpe.END)) for i in range(1, len(raw) + 1))]


def test_packing(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    long = " ".join("word%d" % i for i in range(900))
    rows = [(i, t) for i, t in enumerate([*texts, long, None])]
    got = packing.pack_sequences(frame(spark, rows), path, 64, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == ids
        at = 0
        for p in pieces:
            assert (p.start, p.doc_tokens, p.length) == (at, len(ids), len(p.ids))
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
            at += p.length
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack_sequences(frame(spark, []), path).count() == 0


def test_cheapest_sequence_that_has_room():
    """Against a scan of all open sequences, among them many that are cheap but nearly full."""
    rng = random.Random(11)
    for sizes in ([*[9] * 160, *[1000] * 3, *[500] * 24, 60, 30], [rng.choice((3, 5, 40, 90, 300, 700, 1000)) for _ in range(600)], [rng.randrange(1, 1024) for _ in range(900)]):
        free, cost = [1024] * (sum(sizes) // 1024), [0.0] * (sum(sizes) // 1024)
        for item, start, m, s, offset in packing.balance(sizes, 1024):
            if not any(free):
                break
            rest = sizes[item] - start
            fit = [x for x in range(len(free)) if free[x] >= rest] or [x for x in range(len(free)) if free[x]]
            assert (s, offset, m) == (min(fit, key=lambda x: (cost[x], x)), 1024 - free[s], min(rest, free[s]))
            free[s] -= m
            cost[s] += m + m * m / 512


def test_balance():
    rng = random.Random(3)
    for n in (0, 1, 5, 300):
        sizes = [rng.randrange(1, 64) for _ in range(n)]
        out = packing.balance(sizes, 64)
        cover = {}
        for item, start, m, _, _ in out:
            cover.setdefault(item, []).append((start, m))
        for i, size in enumerate(sizes):
            at = 0
            for start, m in sorted(cover[i]):
                assert start == at and m > 0
                at += m
            assert at == size


def test_codecs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 300, 9000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), b"a" * n, rng.integers(97, 100, n, dtype=np.uint8).tobytes()):
            assert tiff.unlzw(tiff.lzw(data)) == data
            assert tiff.unpackbits(tiff.packbits(data)) == data


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages(spark, kind, predictor, tile):
    rng = np.random.default_rng(kind + predictor)
    pages = [rng.integers(0, 9, (h, w), dtype=np.uint8) for h, w in ((7, 50), (1, 1), (70, 33))]
    data = tiff.encode(pages, kind, predictor, tile, rows=16)
    got = list(tiff.decode(data))
    assert [(p.height, p.width) for p in got] == [p.shape for p in pages]
    assert all(p.pixels == q.tobytes() for p, q in zip(got, pages, strict=True))


def test_pages_table(spark):
    good = tiff.encode([np.zeros((4, 4), np.uint8)] * 2)
    loop = bytearray(tiff.encode([np.zeros((4, 4), np.uint8)]))
    loop[-4:] = loop[4:8]
    rows = [(1, good), (2, b"no tiff"), (3, None), (4, good[:30]), (5, bytes(loop))]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "id long, content binary")).orderBy("id", "page").collect()
    assert [(r.id, r.page, r.error is None) for r in got] == [(1, 0, True), (1, 1, True), (2, 0, False), (3, 0, False), (4, 0, False), (5, 0, True), (5, 1, False)]
    assert tiff.tiff_pages(spark.createDataFrame([], "id long, content binary")).count() == 0


def test_stored_documents(spark, texts):
    import hashlib

    rows = [(i, t) for i, t in enumerate([*texts, "x" * 80_000, None])]
    got = {r.doc_id: r for r in tiff.stored_documents(frame(spark, rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(tiff.stored_form(payload)).hexdigest()
