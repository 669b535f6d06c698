"""Media columns: baseline JPEG parsed in numpy, down to DC-only luminance thumbnails.

``read_images`` parses markers, undoes byte stuffing, Huffman-decodes all restart intervals of many images side by side
(one numpy lane per interval, AC coefficients are skipped) and keeps each block's DC coefficient: the image at an eighth of
its size. ``write_payload`` is the lossless inverse for bytes: one byte is the DC level of one 8x8 block (quantiser 8), 64
blocks a row, one restart interval a row, so the thumbnail read back is the payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import load

ROW = 64
#: Rows of blocks in an image; a longer payload becomes several images, one after the other. The format ends at 65535 lines.
MAX_ROWS = 8191
#: Payload bytes worked on together: bounds memory, whatever the length of texts or batches.
TOGETHER = 600_000
#: Code lengths (1 to 16 bits) and symbols of our tables; DC sizes 0 to 8, AC end-of-block and a filler.
DC_BITS, DC_SYMBOLS = (0, 2, 2, 2, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0), (5, 7, 3, 4, 6, 0, 2, 1, 8)
AC_BITS, AC_SYMBOLS = (1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0x00, 0xF0)


class UnsupportedJpeg(ValueError):
    """Not a baseline JPEG, or a damaged one."""


def _codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    code, i = 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            yield symbols[i], code, length
            code, i = code + 1, i + 1
        code <<= 1


@lru_cache(64)
def _lookup(bits: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """length << 8 | symbol for each 16-bit window; 0 where no code matches."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in _codes(bits, symbols):
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """For each difference -255..255: the bits of its code, its amplitude and an end-of-block, and how many they are."""
    dc = {s: (c, n) for s, c, n in _codes(DC_BITS, DC_SYMBOLS)}
    end, end_n = next((c, n) for s, c, n in _codes(AC_BITS, AC_SYMBOLS) if s == 0)
    word, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        word[d + 255] = ((code << size | (d if d >= 0 else d + (1 << size) - 1)) << end_n) | end
        length[d + 255] = n + size + end_n
    return word, length


_WORD, _LENGTH = _encoder()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    quant = bytes([0, 8, *[1] * 63])
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    tables = bytes([0x00, *DC_BITS, *DC_SYMBOLS, 0x10, *AC_BITS, *AC_SYMBOLS])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDD, ROW.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def write_images(frames: list[bytes]) -> list[bytes]:
    """One JPEG for each of ``frames`` (bytes, a positive multiple of 64, at most MAX_ROWS rows)."""
    rows = np.array([len(f) // ROW for f in frames])
    x = np.frombuffer(b"".join(frames), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    diff = np.diff(x, axis=1, prepend=np.int16(0)) + 255
    length, word = _LENGTH[diff], _WORD[diff]
    ends = np.cumsum(length, axis=1)
    size = (ends[:, -1] + 7) >> 3
    start = np.cumsum(size) - size
    at = (ends - length) + (start << 3)[:, None]
    pad = (size << 3) - ends[:, -1]
    shifted = (word << (24 - (at & 7) - length)).ravel()
    byte = (at >> 3).ravel()
    total = int(size.sum())
    out = sum(np.bincount(byte + i, (shifted >> 16 - 8 * i) & 255, total + 2) for i in range(3)).astype(np.uint8)[:total]
    out[start + size - 1] |= ((1 << pad) - 1).astype(np.uint8)
    stuffed = out == 255
    row_of_start = np.zeros(total, np.int64)
    row_of_start[start[1:]] = 1
    place = np.arange(total) + np.cumsum(stuffed) - stuffed + 2 * np.cumsum(row_of_start)
    flat = np.zeros(int(place[-1]) + 4, np.uint8)
    flat[place] = out
    last_row, first_row = np.cumsum(rows) - 1, np.cumsum(rows) - rows
    last = start + size - 1
    row_end = place[last] + 1 + stuffed[last]
    number = np.arange(len(size)) - np.repeat(first_row, rows)
    flat[row_end], flat[row_end + 1] = 255, 0xD0 + (number & 7)
    whole = flat.tobytes()
    return [_header(int(n)) + whole[int(place[start[a]]) : int(row_end[b])] + b"\xff\xd9" for n, a, b in zip(rows, first_row, last_row, strict=True)]


def frames_of(payload: bytes, max_rows: int = MAX_ROWS) -> list[bytes]:
    return [payload[i : i + max_rows * ROW] for i in range(0, len(payload), max_rows * ROW)]


@dataclass
class Image:
    width: int
    height: int
    components: list[tuple[int, int, int, int]]
    quant: dict[int, int]
    restart: int = 0
    #: (component indices, DC and AC tables of each, intervals of entropy-coded bytes without stuffing)
    scans: list[tuple[list[int], list[tuple], list[np.ndarray]]] = field(default_factory=list)
    end: int = 0
    thumbnail: np.ndarray | None = None


def _intervals(data: np.ndarray, at: int) -> tuple[list[np.ndarray], int]:
    """The restart intervals of the scan at ``at``, stuffing removed; where the marker after it is."""
    window, found = 1 << 16, None
    while found is None:
        part = data[at : at + window]
        ff = np.flatnonzero(part[:-1] == 255)
        after = part[ff + 1]
        stop = np.flatnonzero((after != 0) & ((after < 0xD0) | (after > 0xD7)))
        if len(stop):
            found = int(ff[stop[0]])
        elif at + window >= len(data):
            raise UnsupportedJpeg("a scan doesn't end")
        window *= 8
    part, keep = data[at : at + found], ff < found
    ff, after = ff[keep], after[keep]
    marks = ff[after != 0]
    mask = np.ones(len(part), bool)
    mask[ff[after == 0] + 1] = False
    bounds = [0, *(marks + 2).tolist()], [*marks.tolist(), len(part)]
    return [part[a:b][mask[a:b]] for a, b in zip(*bounds, strict=True)], at + found


def parse_image(data: np.ndarray, at: int = 0) -> Image:
    """Markers of the image at ``at`` (uint8 array); UnsupportedJpeg unless it is sequential, Huffman-coded, 8 bits."""
    raw, n = data, len(data)
    image, quant, tables, restart = None, {}, {}, 0
    if n < at + 4 or raw[at] != 0xFF or raw[at + 1] != 0xD8:
        raise UnsupportedJpeg("no image starts here")
    at += 2
    while True:
        if at + 2 > n or raw[at] != 0xFF:
            raise UnsupportedJpeg("a marker is missing")
        marker = int(raw[at + 1])
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        if at + 4 > n:
            raise UnsupportedJpeg("cut short")
        size = int(raw[at + 2]) << 8 | int(raw[at + 3])
        body = raw[at + 4 : at + 2 + size].tobytes()
        if size < 2 or len(body) != size - 2:
            raise UnsupportedJpeg("cut short")
        at += 2 + size
        try:
            if marker == 0xDB:
                while body:
                    wide, which = body[0] >> 4, body[0] & 15
                    quant[which] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    bits = tuple(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = bits, tuple(body[17 : 17 + sum(bits)])
                    body = body[17 + sum(bits) :]
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise UnsupportedJpeg("not of 8 bits")
                parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts, quant)
                if not image.width or not image.height or not parts or not all(p[1] and p[2] for p in parts):
                    raise UnsupportedJpeg("no size")
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise UnsupportedJpeg("not baseline")
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                ids = [p[0] for p in image.components]
                which = [ids.index(body[1 + 2 * i]) for i in range(body[0])]
                coded = [(tables[0, body[2 + 2 * i] >> 4], tables[1, body[2 + 2 * i] & 15]) for i in range(body[0])]
                intervals, at = _intervals(raw, at)
                image.restart = restart
                image.scans.append((which, coded, intervals))
        except (IndexError, KeyError, ValueError, AttributeError) as e:
            raise e if isinstance(e, UnsupportedJpeg) else UnsupportedJpeg("damaged") from e
    if image is None or not image.scans:
        raise UnsupportedJpeg("no scan")
    image.end = at + 2
    return image


def _decode(intervals: list[np.ndarray], blocks: np.ndarray, pattern: list[int], coded: list[tuple]) -> np.ndarray:
    """Quantised DC values [interval, block], 0 beyond an interval's ``blocks``; pattern: the component of a MCU's blocks."""
    tables = np.concatenate([_lookup(*t) for pair in coded for t in pair])
    sizes = np.fromiter(map(len, intervals), np.int64, len(intervals))
    data = np.concatenate([*intervals, np.full(16, 255, np.uint8)]).astype(np.int64)
    words = sum(data[i : len(data) - 8 + i] << (40 - 8 * i) for i in range(6))
    first = np.cumsum(sizes) - sizes
    pos, limit = first << 3, (first + sizes) << 3
    out = np.zeros((len(intervals), int(blocks.max(initial=0))), np.int32)
    per, n_comp = np.array(pattern), len(coded)
    lane = np.flatnonzero(blocks > 0)
    pos, limit, left = pos[lane], limit[lane], blocks[lane]
    block, k, pred = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.zeros((n_comp, len(lane)), np.int64)
    while len(lane):
        comp = per[block % len(per)]
        at_dc = k == 0
        w, shift = words[np.minimum(pos >> 3, len(words) - 1)], pos & 7
        entry = tables[((2 * comp + ~at_dc) << 16) + ((w >> (32 - shift)) & 0xFFFF)] if n_comp > 1 or not at_dc.all() else tables[(w >> (32 - shift)) & 0xFFFF]
        length, symbol = entry >> 8, entry & 255
        size = symbol & 15
        value = (w >> (48 - shift - length - size)) & ((1 << size) - 1)
        diff = np.where(value >> np.maximum(size - 1, 0), value, value - (1 << size) + 1)
        diff[size == 0] = 0
        if (length == 0).any() or (size[at_dc] > 11).any():
            raise UnsupportedJpeg("no such code")
        pos = pos + length + size
        if at_dc.all():
            cols = np.arange(len(lane))
            pred[comp, cols] += diff
            out[lane, block] = pred[comp, cols]
            k = np.ones(len(lane), np.int64)
        else:
            dc = np.flatnonzero(at_dc)
            pred[comp[dc], dc] += diff[dc]
            out[lane[dc], block[dc]] = pred[comp[dc], dc]
            k = np.where(at_dc, 1, np.where(symbol == 0, 64, k + (symbol >> 4) + 1))
        # the end of a block often follows its DC value at once
        used = shift + length + size
        ahead = tables[((2 * comp + 1) << 16) + ((w >> np.maximum(32 - used, 0)) & 0xFFFF)]
        closes = at_dc & (used <= 32) & ((ahead & 255) == 0) & (ahead > 0)
        pos = pos + np.where(closes, ahead >> 8, 0)
        done = closes | (k >= 64)
        block, k = block + done, np.where(done, 0, k)
        if (pos > limit).any():
            raise UnsupportedJpeg("an interval ends early")
        if (block >= left).any():
            go = block < left
            lane, pos, limit, left, block, k, pred = lane[go], pos[go], limit[go], left[go], block[go], k[go], pred[:, go]
    return out


def _geometry(image: Image, which: list[int]) -> tuple[int, int, list[int]]:
    """MCUs across and down, and the component (its place in the scan) of each block of a MCU."""
    h_max, v_max = max(p[1] for p in image.components), max(p[2] for p in image.components)
    if len(which) == 1:
        _, h, v, _ = image.components[which[0]]
        return -(-image.width * h // (8 * h_max)), -(-image.height * v // (8 * v_max)), [0]
    return -(-image.width // (8 * h_max)), -(-image.height // (8 * v_max)), [i for i, c in enumerate(which) for _ in range(image.components[c][1] * image.components[c][2])]


def read_images(media: list[np.ndarray]) -> list[list[Image] | str]:
    """For each array of bytes its images, one after the other, with luminance thumbnails; what is wrong with it otherwise."""
    out: list[list[Image] | str] = []
    jobs: dict[tuple, list[tuple[int, Image, list[int], list[np.ndarray]]]] = {}
    for i, data in enumerate(media):
        try:
            images, at, mine = [], 0, []
            while at < len(data) or not images:
                image = parse_image(data, at)
                scan = next((s for s in image.scans if 0 in s[0]), None)
                if scan is None or image.components[0][3] not in image.quant:
                    raise UnsupportedJpeg("no luminance")
                across, down, pattern = _geometry(image, scan[0])
                every = image.restart or across * down
                if len(scan[2]) != -(-across * down // every):
                    raise UnsupportedJpeg("intervals are missing")
                mine.append(((tuple(pattern), tuple(scan[1])), (i, image, scan[0], scan[2])))
                images.append(image)
                at = image.end
            for key, job in mine:
                jobs.setdefault(key, []).append(job)
            out.append(images)
        except UnsupportedJpeg as e:
            out.append(str(e))
    for (pattern, coded), job in jobs.items():
        def counts(image: Image, which: list[int], pattern: tuple[int, ...] = pattern) -> np.ndarray:
            across, down, _ = _geometry(image, which)
            every, total = image.restart or across * down, across * down
            return np.minimum(every, total - np.arange(0, total, every)) * len(pattern)

        each = [counts(image, which) for _, image, which, _ in job]
        try:
            dc = _decode([x for *_, parts in job for x in parts], np.concatenate(each), list(pattern), list(coded))
            rows = np.split(dc, np.cumsum([len(e) for e in each])[:-1])
        except UnsupportedJpeg:  # one of them is damaged: find out which
            rows = []
            for (i, _, _, parts), e in zip(job, each, strict=True):
                try:
                    rows.append(_decode(parts, e, list(pattern), list(coded)))
                except UnsupportedJpeg as wrong:
                    out[i] = str(wrong)
                    rows.append(None)
        for (_, image, which, _), e, r in zip(job, each, rows, strict=True):
            if r is not None:
                flat = np.concatenate([x[:n] for x, n in zip(r, e, strict=True)]) if len(e) > 1 and e[-1] != e[0] else r.ravel()
                image.thumbnail = _thumbnail(image, which, pattern, flat)
    return out


def _thumbnail(image: Image, which: list[int], pattern: tuple[int, ...], dc: np.ndarray) -> np.ndarray:
    across, down, _ = _geometry(image, which)
    _, h, v, q = image.components[0]
    if len(which) == 1:
        grid = dc.reshape(down, across)
    else:
        own = dc.reshape(down, across, len(pattern))[:, :, [i for i, c in enumerate(pattern) if which[c] == 0]]
        grid = own.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return np.clip((grid * image.quant[q] + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid of means lie above the mean of all."""
    down, across = (np.arange(9) * n // 8 for n in thumbnail.shape)
    sums = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(thumbnail, 0, np.int64), 1, out=sums[1:, 1:])
    top, left = np.minimum(down[:-1], thumbnail.shape[0] - 1), np.minimum(across[:-1], thumbnail.shape[1] - 1)
    bottom, right = np.maximum(down[1:], top + 1), np.maximum(across[1:], left + 1)
    area = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    cells = np.outer(bottom - top, right - left)
    return f"{int.from_bytes(np.packbits(area * thumbnail.size > cells * sums[-1, -1]).tobytes(), 'big'):016x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % ROW if raw else ROW)


def _together(items: list[tuple[int, bytes]]) -> Iterator[list[int]]:
    held, size = [], 0
    for i, (_, p) in enumerate(items):
        held.append(i)
        size += len(p)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def store_payload(payloads: list[bytes], max_rows: int = MAX_ROWS) -> list[bytes]:
    """The stored form (one or more JPEGs, one after the other) of each payload."""
    frames = [frames_of(p, max_rows) for p in payloads]
    flat, made, size, part = [f for x in frames for f in x], [], 0, []
    for f in flat:
        part.append(f)
        size += len(f)
        if size >= TOGETHER:
            made += write_images(part)
            part, size = [], 0
    if part:
        made += write_images(part)
    ends = np.cumsum([len(x) for x in frames])
    return [b"".join(made[e - len(x) : e]) for e, x in zip(ends, frames, strict=True)]


def describe(images: list[Image]) -> str:
    """Dimensions of the first image, how many there are, and the hash of the thumbnails, one under the other."""
    wide = max(i.thumbnail.shape[1] for i in images)
    stack = images[0].thumbnail if len(images) == 1 else np.vstack([np.pad(i.thumbnail, ((0, 0), (0, wide - i.thumbnail.shape[1]))) for i in images])
    return f"{images[0].width}x{images[0].height}x{len(images)}:{average_hash(stack)}"


def media_features(media: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """(id_col, width, height, images, thumbnail binary, thumbnail_sha256, thumbnail_hash, error) of a column of JPEGs.

    Null, empty, damaged or other than baseline media have null features and an ``error``; several images in one value are
    counted, and the first one described. Other columns of ``media`` are ignored.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value in b.column(1):
                found = read_images([np.frombuffer(value.as_py() or b"", np.uint8)])[0]
                if isinstance(found, str):
                    rows.append((None, None, None, None, None, None, found))
                else:
                    t = found[0].thumbnail
                    rows.append((found[0].width, found[0].height, len(found), t.tobytes(), hashlib.sha256(t.tobytes()).hexdigest(), average_hash(t), None))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "width", "height", "images", "thumbnail", "thumbnail_sha256", "thumbnail_hash", "error"])

    out = media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("m")).mapInArrow(run, f"id {kind}, width int, height int, images int, thumbnail binary, thumbnail_sha256 string, thumbnail_hash string, error string")
    return out.withColumnRenamed("id", id_col)


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as JPEG, read back from the stored bytes, and digested.

    Columns: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, if
    ``keep_media``, media (the JPEG). A null text counts as empty; an empty one is 64 zero bytes; any length is held whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [payload_of(t.as_py()) for t in b.column(1)]
            rows = []
            for group in _together(items):
                media = store_payload([items[i][1] for i in group])
                for i, m, images in zip(group, media, read_images([np.frombuffer(m, np.uint8) for m in media]), strict=True):
                    back = b"".join(x.thumbnail.tobytes() for x in images)
                    rows.append((items[i][0], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(m), hashlib.sha256(m).hexdigest(), describe(images), m if keep_media else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())[: 7 + keep_media]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 7 + keep_media]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", *names])

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a JPEG column, read back."""
    return stored_texts(load(spark, sf_dir, "documents"))
