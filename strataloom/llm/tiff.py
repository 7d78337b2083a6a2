"""TIFF columns: image directories are walked, strips and tiles decoded, predictors undone, one row for each page.

PackBits, LZW, deflate and plain data of 8-bit samples in either byte order. The encoder writes the same forms.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import portions
from .common import arrow_rows, texts

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)
MOST_PIXELS = 1 << 28  # a directory that claims more bytes than this is an error, not an allocation


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in [*_RUN.finditer(data), None]:
        end = m.start() if m else len(data)
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out += part
        if m:
            out.append(257 - (m.end() - m.start()))
            out.append(data[m.start()])
            at = m.end()
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += 2 + k
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2
        else:
            i += 1
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bits down, wider one code early."""
    singles = {bytes([b]): b for b in range(256)}
    table, following, width = dict(singles), 258, 9
    acc, bits, out, word = 256, 9, bytearray(), b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        acc, bits = (acc << width) | table[word], bits + width
        table[longer] = following
        following += 1
        if following == 4094:
            acc, bits = (acc << 12) | 256, bits + 12
            table, following, width = dict(singles), 258, 9
        elif following + 1 > 1 << width:
            width += 1
        word = data[i : i + 1]
        if bits > 512:
            keep = bits & 7
            out += (acc >> keep).to_bytes(bits >> 3, "big")
            acc, bits = acc & ((1 << keep) - 1), keep
    if word:
        acc, bits = (acc << width) | table[word], bits + width
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    acc, bits = (acc << width) | 257, bits + width
    pad = -bits % 8
    return bytes(out + (acc << pad).to_bytes((bits + pad) >> 3, "big"))


def unlzw(data: bytes) -> bytes:
    singles = [bytes([b]) for b in range(256)] + [b"", b""]
    table, width, last = list(singles), 9, b""
    acc = bits = at = 0
    out = []
    while True:
        while bits < width:
            chunk = data[at : at + 32]
            if not chunk:
                return b"".join(out)
            acc, bits, at = (acc << (8 * len(chunk))) | int.from_bytes(chunk, "big"), bits + 8 * len(chunk), at + len(chunk)
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            table, width, last = list(singles), 9, b""
            continue
        if code == 257:
            return b"".join(out)
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError(f"LZW code {code} is not in the table")
        out.append(word)
        if last:
            table.append(last + word[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = word


def _compress(kind: int, data: bytes) -> bytes:
    return {NONE: lambda d: d, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits}[kind](data)


def _expand(kind: int, data: bytes) -> bytes:
    if kind not in NAMES:
        raise ValueError(f"compression {kind}")
    return {NONE: lambda d: d, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}[kind](data)


def encode(pages: list[np.ndarray], compression: int = NONE, predictor: int = 1, tile: tuple[int, int] | None = None, rows: int = 64) -> bytes:
    """A little-endian file of grey pages (height x width, uint8), in strips of some rows or in tiles (width, length)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        h, w = page.shape
        if tile:
            tw, tl = tile
            full = np.pad(page, ((0, -h % tl), (0, -w % tw)), mode="edge")
            blocks = [full[y : y + tl, x : x + tw] for y in range(0, full.shape[0], tl) for x in range(0, full.shape[1], tw)]
        else:
            blocks = [page[y : y + rows] for y in range(0, h, rows)]
        at, size = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate((b[:, :1], b[:, 1:] - b[:, :-1]), axis=1)
            data = _compress(compression, b.tobytes())
            at.append(len(out))
            size.append(len(data))
            out += data
        tags = {256: w, 257: h, 258: 8, 259: compression, 262: 1, 277: 1, 317: predictor}
        tags |= {322: tile[0], 323: tile[1], 324: at, 325: size} if tile else {273: at, 278: rows, 279: size}
        entries = b""
        for tag, value in sorted(tags.items()):
            values = value if isinstance(value, list) else [value]
            field = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                out += b"\0" * (len(out) % 2)
                place = len(out)
                out += field
                field = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, 4, len(values)) + field
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


def _tags(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = _SIZES.get(kind, 1) * count
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        if kind in (1, 3, 4):
            if place + size > len(data):
                raise ValueError(f"tag {tag} lies outside the file")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, place))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode(data: bytes) -> Iterator[Page]:
    """The pages of a file, one at a time; ValueError or struct.error where it is not one that this reads."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        tags, at = _tags(data, order, at)
        one = lambda t, d=None: tags.get(t, [d])[0]
        w, h, s = one(256), one(257), one(277, 1)
        kind, predictor = one(259, 1), one(317, 1)
        if not w or not h or w * h * s > MOST_PIXELS:
            raise ValueError(f"page of {w} x {h} x {s}")
        if set(tags.get(258, [1])) != {8} or one(284, 1) != 1 or predictor not in (1, 2):
            raise ValueError("samples are not 8 bits, together, plain or differences")
        tiled = 322 in tags
        bw, bl = (one(322), one(323)) if tiled else (w, min(h, one(278, h)))
        if not bw or not bl or bw * bl * s > MOST_PIXELS:
            raise ValueError(f"block of {bw} x {bl}")
        across = -(-w // bw)
        page = np.zeros((h, w, s), dtype=np.uint8)
        places, sizes = tags.get(324 if tiled else 273, []), tags.get(325 if tiled else 279, [])
        if len(places) != len(sizes) or len(places) != across * -(-h // bl):
            raise ValueError("blocks are missing")
        for i, (p, n) in enumerate(zip(places, sizes, strict=True)):
            y, x = i // across * bl, i % across * bw
            rows = bl if tiled else min(bl, h - y)
            block = np.frombuffer(_expand(kind, data[p : p + n]), dtype=np.uint8)
            if len(block) < rows * bw * s:
                raise ValueError("a block is too short")
            block = block[: rows * bw * s].reshape(rows, bw, s)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            page[y : y + rows, x : x + bw] = block[: h - y, : w - x]
        yield Page(w, h, s, kind, predictor, tiled, page.tobytes())


PAGES = "id long, page int, width int, height int, samples int, compression string, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(files: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """One row for each page of the files of a binary column: id, page (from 0), its form and its pixels row by row.

    A file that is null, empty, broken or of another form gives the pages before the fault and a row with its error and null
    pixels; no file ends the job. Repeated rows are decoded each; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = 0
                try:
                    for p in decode(data.as_py() or b""):
                        row = (key, n, p.width, p.height, p.samples, NAMES[p.compression], p.predictor, p.tiled, p.pixels, None)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)
                        n += 1
                except (ValueError, struct.error, zlib.error, IndexError) as e:
                    row = (key, n, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    arrow_rows(files.sparkSession)
    return files.select(F.col(id_column).cast("long").alias("id"), F.col(content).alias("content")).mapInArrow(run, PAGES)


UNIT, WIDTH = 576, 64
PAGE_BYTES = UNIT * 64
FORMS = ((LZW, 2, None), (LZW, 1, (32, 48)), (PACKBITS, 1, None), (PACKBITS, 1, (32, 48)), (NONE, 1, None), (NONE, 2, (64, 16)), (DEFLATE, 1, None), (DEFLATE, 2, None), (DEFLATE, 1, (32, 48)), (DEFLATE, 2, (64, 48)), (DEFLATE, 1, None), (DEFLATE, 1, (64, 16)))
STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_form(payload: bytes) -> bytes:
    """A payload, of a multiple of UNIT bytes, as a file whose form follows from the payload alone."""
    kind, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
    pages = [np.frombuffer(payload[i : i + PAGE_BYTES], np.uint8).reshape(-1, WIDTH) for i in range(0, len(payload), PAGE_BYTES)]
    return encode(pages, kind, predictor, tile)


def stored_documents(docs: DataFrame) -> DataFrame:
    """Every row of docs(doc_id, text, ...) stored as a TIFF file and read back: sizes, checksums and a feature.

    The UTF-8 bytes, with bytes 255 up to a positive multiple of 576, are grey pages 64 pixels wide; payload_* and tail_crc32
    are of what decode() gives back, media_* of the file; feature tells the form, pages, mean and deviation of the pixels.
    Null texts are empty; equal texts give equal values; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in portions(batch):
                rows = []
                for i, doc in enumerate(part.column(0).to_pylist()):
                    text = raw[at[i] : at[i + 1]].tobytes()
                    media = stored_form(text + b"\xff" * (-len(text) % UNIT or UNIT * (not text)))
                    pages = list(decode(media))
                    back = b"".join(p.pixels for p in pages)
                    x = np.frombuffer(back, np.uint8)
                    p = pages[0]
                    feature = f"{NAMES[p.compression]} {'tiles' if p.tiled else 'strips'} predictor={p.predictor} pages={len(pages)} width={p.width} mean={x.mean(dtype=np.float64):.4f} deviation={x.std(dtype=np.float64):.4f}"
                    rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in STORED.split(", ")])

    arrow_rows(docs.sparkSession)
    return texts(docs).mapInArrow(run, STORED)
