"""GIF columns: writing bytes as 8-bit samples, and reading any GIF into timed frames.

The reader handles LZW code streams of any code size, deferred clear codes, local and global palettes, transparency,
disposal and interlace. A run of codes between two clear codes is decoded as arrays: code widths follow from the position
alone, the string of a code is a copy of what an earlier code of the run wrote plus one byte, and copies are resolved by
pointer doubling. Runs of equal length, as simple writers make them, are cut many at a time.

Defined results: a null or empty text is one block of zero bytes; broken data ends with what was read before the fault and
missing samples are 0; equal texts give equal media and features; only the id and the text are read, so other columns
cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import columns as C

WIDTH, FRAME_ROWS, DELAY = 64, 1024, 4  # samples a row, rows a frame, hundredths of a second
RUN = 254  # literals between clear codes, so that all codes keep nine bits
HISTOGRAM_BINS = 16
MAX_CODES = 4096


def _blocks(data: bytes) -> bytes:
    """Data in sub-blocks of at most 255 bytes."""
    whole = len(data) // 255
    body = np.full((whole, 256), 255, dtype=np.uint8)
    body[:, 1:] = np.frombuffer(data, dtype=np.uint8, count=whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _literal_codes(samples: np.ndarray) -> bytes:
    """The samples as nine-bit literal codes with a clear code before every run."""
    n = len(samples)
    runs = -(-n // RUN)
    codes = np.full((runs, RUN + 1), 256, dtype=np.uint16)
    flat = np.zeros(runs * RUN, dtype=np.uint16)
    flat[:n] = samples
    codes[:, 1:] = flat.reshape(runs, RUN)
    line = codes.ravel()[: n + runs + 1] if n < runs * RUN else np.append(codes.ravel(), 0)
    line[n + runs] = 257
    full = np.zeros((-(-len(line) // 8), 8), dtype=np.uint16)
    full.ravel()[: len(line)] = line
    out = np.empty((len(full), 9), dtype=np.uint8)
    out[:, 0] = full[:, 0] & 255
    for j in range(1, 8):
        out[:, j] = ((full[:, j - 1] >> (9 - j)) | (full[:, j] << j)) & 255
    out[:, 8] = full[:, 7] >> 1
    return out.tobytes()[: -(-len(line) * 9 // 8)]


def write_gif(payload: bytes) -> bytes:
    """A grey animation whose samples are the bytes of ``payload`` (a multiple of the row width), read row by row."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    rows = len(samples) // WIDTH
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), grey]
    for at in range(0, rows, FRAME_ROWS):
        part = samples[at * WIDTH : (at + FRAME_ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0"]
        out += [b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(_literal_codes(part))]
    return b"".join([*out, b"\x3b"])


@lru_cache(maxsize=16)
def _grid(size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of the first ``count`` codes after a clear code, for a code size."""
    ahead = np.maximum(np.arange(count) - 1, 0) + (1 << size) + 2
    width = np.clip(np.floor(np.log2(ahead)).astype(np.int64) + 1, size + 1, 12)
    return np.cumsum(width) - width, width


def _codes(data: np.ndarray, bits: np.ndarray, width: np.ndarray) -> np.ndarray:
    byte = bits >> 3
    value = data[byte].astype(np.uint32) | (data[byte + 1].astype(np.uint32) << 8) | (data[byte + 2].astype(np.uint32) << 16)
    return ((value >> (bits & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)).astype(np.int64)


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """What a run of codes without clear codes stands for."""
    if not (codes >= clear).any():
        return codes.astype(np.uint8)
    entry = codes - (clear + 2)
    bad = np.flatnonzero(entry >= np.arange(len(codes)))
    if len(bad):  # a code that does not exist yet
        codes, entry = codes[: bad[0]], entry[: bad[0]]
    size = [1] * len(codes)
    for i in np.flatnonzero(entry >= 0).tolist():
        size[i] = size[entry[i]] + 1
    size = np.array(size, dtype=np.int64)
    start = np.cumsum(size) - size
    total = int(size.sum())
    owner = np.repeat(np.arange(len(codes)), size)
    source = np.arange(total)
    copied = entry[owner] >= 0
    source[copied] = (start[np.maximum(entry, 0)[owner]] + np.arange(total) - start[owner])[copied]
    while not np.array_equal(further := source[source], source):
        source = further
    value = np.zeros(total, dtype=np.uint8)
    value[start[entry < 0]] = codes[entry < 0]
    return value[source]


def read_lzw(stream: bytes, size: int, wanted: int) -> np.ndarray:
    """Samples of a code stream; missing ones are 0."""
    data = np.frombuffer(stream + bytes(4), dtype=np.uint8)
    end, clear = len(stream) * 8, 1 << size
    at, have, out = 0, 0, []
    while at < end and have < wanted:
        # codes up to the next clear or end code
        count = 300
        while True:
            offset, width = _grid(size, count)
            inside = int(np.searchsorted(at + offset + width, end, side="right"))
            codes = _codes(data, at + offset[:inside], width[:inside])
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stops) or inside < count:
                break
            count *= 8
        stop = int(stops[0]) if len(stops) else inside
        out.append(_expand(codes[:stop], clear))
        have += len(out[-1])
        if not len(stops) or codes[stop] == clear + 1:
            break
        length = int(offset[stop] + width[stop])
        at += length
        # further runs of the same length
        more = min((end - at) // length, 4096)
        if more > 0 and stop > 0:
            grid = at + np.arange(more)[:, None] * length + offset[None, : stop + 1]
            table = _codes(data, grid, width[: stop + 1])
            same = (table[:, stop] == clear) & ~((table[:, :stop] == clear) | (table[:, :stop] == clear + 1)).any(axis=1)
            same = int(np.argmin(same)) if not same.all() else more
            body = table[:same, :stop]
            plain = not (body >= clear).any()
            out += [body.astype(np.uint8).ravel()] if plain else [_expand(row, clear) for row in body]
            have += sum(map(len, out[-1:] if plain else out[len(out) - same :])) if same else 0
            at += same * length
    got = np.concatenate(out)[:wanted] if out else np.zeros(0, np.uint8)
    return got if len(got) == wanted else np.append(got, np.zeros(wanted - len(got), np.uint8))


def read_frames(media: bytes) -> Iterator[dict]:
    """Frames in order: ``delay``, place and size, ``samples`` (palette indices) and ``canvas`` (RGB, after disposal of the
    frame before and with transparent samples left out)."""
    if media[:3] != b"GIF" or len(media) < 13:
        return
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", media, 6)
    at = 13
    common = None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        common = np.frombuffer(media[at : at + n].ljust(n, b"\0"), dtype=np.uint8).reshape(-1, 3)
        at += n
    canvas = np.zeros((height, width, 3), dtype=np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(media) and media[at] in (0x21, 0x2C):
        if media[at] == 0x21:
            if media[at + 1 : at + 3] == b"\xf9\x04":
                packed, delay, index = struct.unpack_from("<BHB", media, at + 3)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            at += 2
            while at < len(media) and media[at]:
                at += media[at] + 1
            at += 1
            continue
        x, y, w, h, packed = struct.unpack_from("<HHHHB", media, at + 1)
        at += 10
        palette = common
        if packed & 0x80:
            n = 3 << ((packed & 7) + 1)
            palette = np.frombuffer(media[at : at + n].ljust(n, b"\0"), dtype=np.uint8).reshape(-1, 3)
            at += n
        size, at, parts = media[at], at + 1, []
        while at < len(media) and (n := media[at]):
            parts.append(media[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        samples = read_lzw(b"".join(parts), size, w * h).reshape(h, w)
        if packed & 0x40:
            rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            straight = np.empty_like(samples)
            straight[rows] = samples
            samples = straight
        colours = np.zeros((256, 3), dtype=np.uint8)
        if palette is not None:
            colours[: len(palette)] = palette
        before = canvas.copy() if disposal == 3 else None
        spot = canvas[y : y + h, x : x + w]
        seen = samples[: spot.shape[0], : spot.shape[1]]
        if transparent is None:
            spot[:] = colours[seen]
        else:
            shown = seen != transparent
            spot[shown] = colours[seen[shown]]
        yield {"delay": delay, "x": x, "y": y, "width": w, "height": h, "samples": samples, "canvas": canvas}
        if disposal == 2:
            spot[:] = colours[background] if transparent is None else 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of the mean of the colour channels in equal bins."""
    grey = pixels.reshape(-1, 3).astype(np.uint16).sum(axis=1) // 3
    return np.bincount(grey * HISTOGRAM_BINS >> 8, minlength=HISTOGRAM_BINS)


def store(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, ``n_bytes`` and ``media``: the text's bytes, filled with zero bytes to whole rows, as an animation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.split(batches, "text"):
            raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
            media = [write_gif(x.ljust(max(1, -(-len(x) // WIDTH)) * WIDTH, b"\0")) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], [id_column, "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, media binary")


def frames(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per timed frame: ``frame``, ``at_ms``, ``delay_ms``, ``width``, ``height``, ``pixels`` (RGB of the frame's
    part of the canvas) and ``histogram``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.split(batches, column):
            ids, rows = [], []
            for i, x in enumerate(batch.column(column).to_pylist()):
                at = 0
                for n, f in enumerate(read_frames(x or b"")):
                    shown = f["canvas"][f["y"] : f["y"] + f["height"], f["x"] : f["x"] + f["width"]]
                    ids.append(i)
                    rows.append((n, at, f["delay"] * 10, f["width"], f["height"], shown.tobytes(), histogram(shown).tolist()))
                    at += f["delay"] * 10
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            cells = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(id_column).take(pa.array(ids, pa.int64())), *cells], [id_column, "frame", "at_ms", "delay_ms", "width", "height", "pixels", "histogram"])

    kind = media.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, frame int, at_ms long, delay_ms int, width int, height int, pixels binary, histogram array<long>"
    return media.select(id_column, column).mapInArrow(run, schema)


def features(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with what is read back from each animation: ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` and
    ``feature`` (frames, canvas, running time and histogram of all frames)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.split(batches, column):
            out = [read_back(x or b"") for x in batch.column(column).to_pylist()]
            kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string()}
            yield C.extend(batch, {n: pa.array([x[j] for x in out], k) for j, (n, k) in enumerate(kinds.items())})

    return C.map_batches(media, run, {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "feature": "string"})


def read_back(media: bytes) -> tuple[int, str, int, str]:
    """Frame by frame, so that only one frame is held at a time."""
    digest, n, tail, count, time, width, height = hashlib.sha256(), 0, b"", 0, 0, 0, 0
    bins = np.zeros(HISTOGRAM_BINS, dtype=np.int64)
    for f in read_frames(media):
        shown = f["canvas"][f["y"] : f["y"] + f["height"], f["x"] : f["x"] + f["width"]]
        part = np.ascontiguousarray(shown[:, :, 0]).tobytes()
        digest.update(part)
        n, tail = n + len(part), (tail + part)[-WIDTH:]
        bins += np.bincount(shown[:, :, 0].ravel() >> 4, minlength=HISTOGRAM_BINS) if (shown[:, :, 0] == shown[:, :, 1]).all() else histogram(shown)
        count, time, width, height = count + 1, time + f["delay"] * 10, max(width, f["width"]), max(height, f["height"])
    return n, digest.hexdigest(), zlib.crc32(tail), f"{count}x{width}x{height}@{time}:" + ",".join(map(str, bins.tolist()))
