"""GIF media columns.

Any GIF decodes to timed frames: LZW code streams, global and local palettes,
interlacing, transparency and the disposal of earlier frames are applied, and each frame
gets a colour-histogram column. Bytes are stored losslessly as 8-bit samples of a
grey palette, ``WIDTH`` by up to ``HEIGHT`` a frame, LZW-coded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.kernels import slices

WIDTH, HEIGHT, DELAY_CS = 64, 256, 4
BINS = 8
MOST = 1 << 25  # pixels of an image or a canvas that a task draws
_GREY = bytes(v for k in range(256) for v in (k, k, k))


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """Code stream of samples of ``depth`` bits, with a clear code whenever the table fills."""
    clear, done = 1 << depth, (1 << depth) + 1
    codes, widths = [clear], [depth + 1]
    fixed = _widths(depth)
    table: dict[int, int] = {}
    get, put, free = table.get, codes.append, done + 1
    prefix = data[0] if data else -1
    for sample in data[1:]:
        key = prefix << 8 | sample
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = sample
        if free < 4096:
            table[key] = free
            free += 1
        else:
            put(clear)
            widths += fixed[: len(codes) - len(widths)]
            table.clear()
            free = done + 1
    if prefix >= 0:
        put(prefix)
    put(done)
    widths += fixed[: len(codes) - len(widths)]
    bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, count=12, bitorder="little")
    return np.packbits(bits[_BITS[np.array(widths)]], bitorder="little").tobytes()


_schedules: dict[int, tuple[list[int], np.ndarray, np.ndarray, list[bytes]]] = {}
_BITS = np.arange(12) < np.arange(13)[:, None]  # the bits of a code by its width
_FULL = np.full(4096, 12), np.arange(4097) * 12


def _widths(depth: int) -> list[int]:
    """Widths of the codes after a clear code: the n-th is read when the table has grown by n - 1."""
    return _schedule(depth)[0]


def _schedule(depth: int) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
    """Widths as a list and an array, the bits before each code, and a fresh table."""
    if depth not in _schedules:
        sizes = (1 << depth) + 2 + np.maximum(np.arange(4096 + 4096) - 1, 0)
        widths = np.minimum([int(s).bit_length() for s in sizes.tolist()], 12)
        _schedules[depth] = widths.tolist(), widths, np.concatenate([[0], np.cumsum(widths)]), [bytes([k]) for k in range(1 << depth)] + [b"", b""]
    return _schedules[depth]


def lzw_decode(stream: bytes, depth: int, wanted: int) -> np.ndarray:
    """At most ``wanted`` samples; a broken stream ends early."""
    clear, done = 1 << depth, (1 << depth) + 1
    total = 8 * len(stream)
    data = np.frombuffer(stream + b"\0\0", np.uint8).astype(np.int64)
    # codes are cut stretch by stretch: their widths are known until the next clear code
    _, widths, begin, base = _schedule(depth)
    out: list[bytes] = []
    at, size = 0, 0
    while size < wanted:
        count = int(np.searchsorted(begin, total - at, "right")) - 1
        if count <= 0:
            break
        n = min(count, len(widths))
        places = begin[:n] + at
        low = places >> 3
        codes = (data[low] | data[low + 1] << 8 | data[low + 2] << 16) >> (places & 7) & ((1 << widths[:n]) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == done))
        end = int(stops[0]) if len(stops) else n
        table, last, free = list(base), b"", len(base)
        add, write = table.append, out.append
        for code in codes[:end].tolist():
            if code < free:
                entry = table[code]
                if last and free < 4096:
                    add(last + entry[:1])
                    free += 1
            elif last and code == free < 4096:
                entry = last + last[:1]
                add(entry)
                free += 1
            else:
                return _samples(out, wanted)
            write(entry)
            last = entry
        size = sum(map(len, out))
        if not len(stops):
            if n < len(widths):
                break
            at += int(begin[n])  # a table that stays full: go on at 12 bits
            widths, begin = _FULL
            base = table
            continue
        if codes[end] == done:
            break
        at += int(begin[end + 1])
        _, widths, begin, base = _schedule(depth)
    return _samples(out, wanted)


def _samples(parts: list[bytes], wanted: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8)[:wanted]


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)) + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF of the payload's bytes as grey samples; its length must be a multiple of WIDTH."""
    per = WIDTH * HEIGHT
    rows = min(HEIGHT, len(payload) // WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, rows, 0xF7, 0, 0), _GREY]
    for k in range(0, len(payload), per):
        part = payload[k : k + per]
        out += [b"!\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0), b",", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


class Frame:
    """One image: the pixels as they lie in the file, their colours, and the canvas once it is drawn."""

    def __init__(self, left, top, indices, palette, transparent, disposal, delay):
        self.left, self.top, self.indices, self.palette = left, top, indices, palette
        self.transparent, self.disposal, self.delay = transparent, disposal, delay
        self.canvas = None

    def colours(self) -> np.ndarray:
        return self.palette[self.indices]


def parse(media: bytes) -> tuple[int, int, list[Frame]]:
    """Screen size and frames, not yet drawn; ends where the file breaks off."""
    if len(media) < 13 or media[:3] != b"GIF":
        return 0, 0, []
    width, height, flags = struct.unpack_from("<HHB", media, 6)
    at, frames = 13, []
    control = (0, 0, None)

    def palette(flags, at):
        n = 2 << (flags & 7)
        table = np.zeros((256, 3), np.uint8)
        raw = np.frombuffer(media[at : at + 3 * n], np.uint8)
        table[: len(raw) // 3] = raw[: len(raw) // 3 * 3].reshape(-1, 3)
        return table, at + 3 * n

    def sub_blocks(at):
        parts = []
        while at < len(media) and media[at]:
            parts.append(media[at + 1 : at + 1 + media[at]])
            at += 1 + media[at]
        return b"".join(parts), at + 1

    common = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        common, at = palette(flags, at)
    while at < len(media):
        kind = media[at]
        if kind == 0x21 and at + 1 < len(media):
            label = media[at + 1]
            block, at = sub_blocks(at + 2)
            if label == 0xF9 and len(block) >= 4:
                bits, delay, clear = struct.unpack_from("<BHB", block)
                control = (bits >> 2 & 7, delay, clear if bits & 1 else None)
        elif kind == 0x2C and at + 10 <= len(media):
            left, top, w, h, bits = struct.unpack_from("<HHHHB", media, at + 1)
            at += 10
            own = common
            if bits & 0x80:
                own, at = palette(bits, at)
            depth = media[at] if at < len(media) else 8
            stream, at = sub_blocks(at + 1)
            if not 2 <= depth <= 8 or w * h > MOST:
                break
            samples = lzw_decode(stream, depth, w * h)
            pixels = np.zeros(w * h, np.uint8)
            pixels[: len(samples)] = samples
            pixels = pixels.reshape(h, w)
            if bits & 0x40:
                lines = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                woven = np.empty_like(pixels)
                woven[lines] = pixels
                pixels = woven
            frames.append(Frame(left, top, pixels, own, control[2], control[0], control[1]))
            control = (0, 0, None)
        else:
            break
    return width, height, frames


def draw(width: int, height: int, frames: list[Frame]):
    """Frames one after another, each with its RGBA canvas: transparency on drawing, disposal after it.

    The canvas ends where no frame reaches further, whatever the screen's size is said to be; beyond MOST pixels nothing is drawn.
    """
    height = min(height, max((f.top + f.indices.shape[0] for f in frames), default=0))
    width = min(width, max((f.left + f.indices.shape[1] for f in frames), default=0))
    if width * height > MOST:
        return
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        y, x = slice(f.top, min(height, f.top + f.indices.shape[0])), slice(f.left, min(width, f.left + f.indices.shape[1]))
        part = f.indices[: max(0, y.stop - y.start), : max(0, x.stop - x.start)]
        seen = np.ones(part.shape, bool) if f.transparent is None else part != f.transparent
        if part.size:
            area = canvas[y, x]
            area[seen] = np.concatenate([f.palette[part[seen]], np.full((int(seen.sum()), 1), 255, np.uint8)], 1)
        f.canvas = canvas.copy()
        yield f
        if f.disposal == 2 and part.size:
            canvas[y, x] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of visible pixels by BINS steps of red, of green and of blue."""
    rgb = rgba.reshape(-1, rgba.shape[-1])
    if rgb.shape[1] == 4:
        rgb = rgb[rgb[:, 3] > 0]
    return np.concatenate([np.bincount(rgb[:, c] // (256 // BINS), minlength=BINS) for c in range(3)])


def frames(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """One row per frame: key, frame, start_ms, delay_ms, disposal, width, height, histogram (3 * BINS counts of the drawn canvas).

    Null, empty and broken media give the frames before the break, or no row. An image of more than MOST pixels counts as a break.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for k, blob in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist(), strict=True):
                width, height, images = parse(blob or b"")
                start = 0
                for number, f in enumerate(draw(width, height, images)):
                    rows.append((k, number, start, f.delay * 10, f.disposal, width, height, histogram(f.canvas).tolist()))
                    start += f.delay * 10
            types = (batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "frame", "start_ms", "delay_ms", "disposal", "width", "height", "histogram"])

    kind = media.schema[key].dataType.simpleString()
    out = media.select(key, column).mapInArrow(run, f"key {kind}, frame int, start_ms long, delay_ms long, disposal int, width int, height int, histogram array<long>")
    return out.withColumnRenamed("key", key)


def stored(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media: each text's UTF-8 bytes with zeros up to a positive multiple of 64, as a GIF. A null text is empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = [encode(t + bytes(-len(t) % 64 if t else 64)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def read_back(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload's length, digest and tail, the stored form's, and the features, all from the stored bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for blob in batch.column("media").to_pylist():
                _, _, images = parse(blob)
                samples = [f.colours()[:, :, 0] for f in images]
                payload = b"".join(s.tobytes() for s in samples)
                counts = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=BINS)
                feature = f"frames={len(images)};ms={sum(f.delay for f in images) * 10};histogram={','.join(map(str, counts.tolist()))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[key, "n_bytes", *names])

    kind = media.schema[key].dataType.simpleString()
    return media.mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_gif_media(spark, sf_dir: str) -> DataFrame:
    return read_back(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")))
