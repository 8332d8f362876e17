"""TIFF pages: walk the image directories, decode strips or tiles, undo the predictor, one row a page.

Baseline grey or RGB images of 8 bits a sample, either byte order, chunky samples; PackBits, LZW, deflate or no
compression; strips or tiles; no predictor or horizontal differencing. The writer makes the same kinds (multi-page, for
tests and for storing payloads without loss).

Cases: a null or empty content, a broken file and a page of an unsupported kind, without a size, with missing or short
strips or of more than ``most_bytes`` pixels (a column value has an end) give one row each with ``error`` set and null
pixels, never a failed job; memory follows the decoded strips and not what a header claims. A directory chain that comes
back to itself ends with an error row. Texts: null counts as empty, and any length is one page. Repeated rows stay rows with
equal results; an empty table gives an empty one; other columns pass through, but one that is called like a made column
(``page``, ``width``, ``n_bytes`` and so on) is replaced by it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, slices

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of a value by TIFF field type.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
PAGE_SCHEMA = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"


def unpack_bits(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


def unpack_lzw(data: bytes, most: int) -> bytes:
    """TIFF's LZW: most significant bit first, 256 clears, 257 ends, codes widen one entry early."""
    out, table, bits, held, width, before = bytearray(), [], 0, 0, 9, b""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        if len(out) >= most:
            break
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, before = list(start), 9, b""
                continue
            if not table:
                raise ValueError("LZW data without a clear code")
            if not before:
                now = table[code]
            else:
                now = table[code] if code < len(table) else before + before[:1]
                table.append(before + now[:1])
            out += now
            before = now
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256)
    size = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        word = data[i : i + 1]
        if size == 4094:
            put(256)
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        else:
            width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    if word:
        put(table[word])
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most) if most else b""


#: Each takes the data and the number of bytes that are wanted of it, and stops there.
UNPACK = {NONE: lambda data, most: data[:most], LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}


def write_tiff(pages: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 1024, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages of uint8 samples, (height, width) or (height, width, 3), as one file."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        cube = page.reshape(page.shape[0], page.shape[1], -1)
        height, width, samples = cube.shape
        rows, cols = tile or (min(strip_rows, height), width)
        places, sizes = [], []
        for y in range(0, height, rows):
            for x in range(0, width, cols):
                part = cube[y : y + rows, x : x + cols]
                if tile:
                    part = np.pad(part, ((0, rows - part.shape[0]), (0, cols - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1)
                packed = PACK[compression](part.tobytes())
                places.append(len(out))
                sizes.append(len(packed))
                out += packed
        out += b"\0" * (len(out) % 2)
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [compression]), (262, 3, [2 if samples == 3 else 1]), (277, 3, [samples]), (317, 3, [predictor])]
        tags += [(322, 4, [cols]), (323, 4, [rows]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [rows]), (279, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{'HI'[kind == 4]}", *values)
            if len(raw) > 4:
                entries.append((tag, kind, len(values), struct.pack(order + "I", len(out))))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append((tag, kind, len(values), raw.ljust(4, b"\0")))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", *e[:3]) + e[3] for e in entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def read_pages(data: bytes, most_bytes: int = 1 << 30) -> Iterator[dict]:
    """Each page as a dict of PAGE_SCHEMA's columns. A broken page is a page with an error; a broken chain raises."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF header")
    at, seen, page = struct.unpack(order + "I", data[4:8])[0], set(), 0
    while at:
        if at in seen:
            raise ValueError("the directories form a ring")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in (1, 3, 4):
                size = TYPE_BYTES[kind] * n
                place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                if place + size <= len(data):  # else the tag counts as absent
                    tags[tag] = struct.unpack_from(f"{order}{n}{'?B?HI'[kind]}", data, place)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
        yield _page(data, tags, page, most_bytes)
        page += 1


def _page(data: bytes, tags: dict[int, tuple[int, ...]], page: int, most_bytes: int) -> dict:
    one = lambda tag, default=None: (tags.get(tag) or (default,))[0]
    width, height, samples, how, predictor = one(256), one(257), one(277, 1), one(259, 1), one(317, 1)
    head = {"page": page, "width": width, "height": height, "samples": samples, "compression": how, "predictor": predictor, "pixels": None}
    if how not in UNPACK or predictor not in (1, 2) or set(tags.get(258, (1,))) != {8} or one(284, 1) != 1:
        return head | {"error": "unsupported compression, predictor, sample size or layout"}
    try:
        tiled = 324 in tags
        cols, rows = (one(322), one(323)) if tiled else (width, min(one(278) or height or 0, height or 0))
        places, sizes = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
        if not (width and height and samples and cols and rows and places and sizes):
            raise ValueError("a size, strip or tile tag is missing or zero")
        if width * height * samples > most_bytes or cols * rows * samples > most_bytes:
            raise ValueError(f"more than {most_bytes} bytes of pixels")
        across, down = -(-width // cols), -(-height // rows)
        if min(len(places), len(sizes)) < across * down:
            raise ValueError(f"{min(len(places), len(sizes))} of {across * down} strips or tiles")
        parts = []
        for i in range(across * down):  # all of them before the image, so that its size is paid for by their bytes
            tall = rows if tiled else min(rows, height - i * rows)
            part = np.frombuffer(UNPACK[how](data[places[i] : places[i] + sizes[i]], tall * cols * samples), np.uint8)
            if len(part) < tall * cols * samples:
                raise ValueError(f"strip or tile {i} is short")
            parts.append(part[: tall * cols * samples].reshape(tall, cols, samples))
        image = np.empty((height, width, samples), np.uint8)
        for i, part in enumerate(parts):
            y, x = i // across * rows, i % across * cols
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            image[y : y + rows, x : x + cols] = part[: height - y, : width - x]
        return head | {"pixels": image.tobytes(), "error": None}
    except Exception as e:  # noqa: BLE001  whatever is wrong with a page is its row's error, never the job's
        return head | {"error": f"page {page}: {e}"}


def tiff_pages(df: DataFrame, *, content_col: str = "content", most_bytes: int = 1 << 30) -> DataFrame:
    """One row a page: the other columns of ``df``, then PAGE_SCHEMA."""
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    kept = [c for c in df.columns if c not in (*names, content_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found: list[dict] = []
                try:
                    for page in read_pages(batch.column(len(kept))[i].as_py() or b"", most_bytes):
                        found.append(page)
                except Exception as e:  # noqa: BLE001
                    found.append({"error": str(e)})
                own = [pa.array([_fitting(p.get(n), t) for p in found], t) for n, t in zip(names, [pa.int32()] * 6 + [pa.binary(), pa.string()])]
                row = pa.array([i] * len(found))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(row) for j in range(len(kept))), *own], names=[*kept, *names])

    rows = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{content_col}`").alias("__in"))
    return arrow_map(rows, _gathered(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), PAGE_SCHEMA]))


def _fitting(value, kind: pa.DataType):
    """Header values beyond an int become null."""
    return None if kind == pa.int32() and value is not None and value > 2**31 - 1 else value


def _gathered(run, least: int = 4 << 20):
    """The same rows in batches of at least ``least`` bytes, but for the last."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= least or len(held) >= 4096:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gathered


def payload(text: str | None, block: int = 64) -> bytes:
    """UTF-8 bytes of a text, filled with zeros to a positive multiple of ``block``."""
    raw = (text or "").encode()
    return raw.ljust(max(block, -(-len(raw) // block) * block), b"\0")


def texts_as_tiff(docs: DataFrame, *, text_col: str = "text", width: int = 64) -> DataFrame:
    """Store each whole text as a grey page of ``width`` columns: adds n_bytes and content; the text goes."""
    kept = [c for c in docs.columns if c not in (text_col, "n_bytes", "content")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            sizes, files = [], []
            for text in part.column(len(kept)):
                text = text.as_py()
                data = payload(text, width)
                sizes.append(len((text or "").encode()))
                files.append(write_tiff([np.frombuffer(data, np.uint8).reshape(-1, width)]))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=[*kept, "n_bytes", "content"])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias("__in"))
    return arrow_map(rows, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "n_bytes long, content binary"]))


def average_hash(pixels: bytes, width: int, height: int, samples: int) -> str:
    """64 bits: which of 8 x 8 fields are brighter than the mean of the fields; rows and columns repeat on small pages."""
    image = np.frombuffer(pixels, np.uint8).reshape(height, width * samples)
    sums = np.add.reduceat(image, np.arange(8) * height // 8, axis=0, dtype=np.int64)
    fields = np.add.reduceat(sums, np.arange(8) * (width * samples) // 8, axis=1)
    tall, wide = np.diff(np.append(np.arange(8) * height // 8, height)), np.diff(np.append(np.arange(8) * (width * samples) // 8, width * samples))
    mean = fields / np.maximum(tall, 1)[:, None] / np.maximum(wide, 1)[None]
    return np.packbits(mean.ravel() > mean.mean()).tobytes().hex()


def page_features(pages: DataFrame) -> DataFrame:
    """Add ``feature`` (the average hash) to rows of pages; null for pages without pixels. The pixels stay."""
    kept = [c for c in pages.columns if c != "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pick = [batch.column(kept.index(c)) for c in ("pixels", "width", "height", "samples")]
            found = [average_hash(*(x.as_py() for x in row)) if row[0].is_valid else None for row in zip(*pick)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(found, pa.string())], names=[*kept, "feature"])

    return arrow_map(pages.select(*(F.col(f"`{c}`") for c in kept)), run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept), "feature string"]))
