"""ISO base media containers: nested boxes, sample tables, codec, duration and keyframe byte ranges.

The walker reads box headers and tables only; sample payloads are never decoded. ``mux`` writes a container whose
samples are fixed-size units of raw 8-bit data, which the query uses to store and read back whole texts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Box types that hold other boxes (fixed values of the format).
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: Bytes in a sample, samples in a second and samples from one keyframe to the next, as ``mux`` writes them.
UNIT, RATE, KEY_EVERY = 192, 8_000, 8
#: A track that promises more samples than this and than its file has bytes is damaged.
MOST_SAMPLES = 1 << 24


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, payload start, payload end) of the boxes in a range; ends at the first malformed header."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def find(data: memoryview, path: tuple[bytes, ...], start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Payload ranges of the boxes at a path of nested types."""
    for kind, a, b in boxes(data, start, end):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            elif kind in NESTED:
                yield from find(data, path[1:], a, b)


def _table(data: memoryview, at: tuple[int, int], kind: str, columns: int) -> np.ndarray:
    """Rows of a full box that holds a count and then rows of big-endian numbers; rows beyond its end are ignored."""
    a, b = at
    count = struct.unpack_from(">I", data, a + 4)[0]
    width = np.dtype(kind).itemsize * columns
    count = min(count, (b - a - 8) // width)
    return np.frombuffer(data, kind, count * columns, a + 8).reshape(count, columns).astype(np.int64)


def track(data: memoryview, a: int, b: int) -> dict | None:
    """Codec, timing and byte range of each sample of one ``trak``; None where a required table is missing."""

    def one(*path):
        return next(find(data, path, a, b), None)

    header, stsd = one(b"mdia", b"mdhd"), one(b"mdia", b"minf", b"stbl", b"stsd")
    stts, stsc, stsz = (one(b"mdia", b"minf", b"stbl", k) for k in (b"stts", b"stsc", b"stsz"))
    stz2 = one(b"mdia", b"minf", b"stbl", b"stz2")
    stco, co64, stss = (one(b"mdia", b"minf", b"stbl", k) for k in (b"stco", b"co64", b"stss"))
    if not (header and stsd and stts and stsc and (stsz or stz2) and (stco or co64)):
        return None
    wide = data[header[0]] == 1
    timescale, duration = struct.unpack_from(">IQ" if wide else ">II", data, header[0] + (20 if wide else 12))
    codec = bytes(data[stsd[0] + 12 : stsd[0] + 16]).decode("latin-1") if stsd[1] - stsd[0] >= 16 else ""
    fixed, count = struct.unpack_from(">II", data, (stsz or stz2)[0] + 4)
    if not stsz:
        bits, at = fixed & 0xFF, stz2[0] + 12
        if bits not in (4, 8, 16):
            return None
        raw = np.frombuffer(data, ">u2" if bits == 16 else "u1", min(-(-count * bits // 8), stz2[1] - at) // (2 if bits == 16 else 1), at).astype(np.int64)
        sizes = (np.stack([raw >> 4, raw & 15], 1).ravel() if bits == 4 else raw)[:count]
    elif count > max(len(data), MOST_SAMPLES):
        return None
    elif fixed:
        sizes = np.full(count, fixed, np.int64)
    else:
        sizes = np.frombuffer(data, ">u4", min(count, (stsz[1] - stsz[0] - 12) // 4), stsz[0] + 12).astype(np.int64)
    chunks = _table(data, stco, ">u4", 1)[:, 0] if stco else _table(data, co64, ">u8", 1)[:, 0]
    runs = _table(data, stsc, ">u4", 3)
    # samples per chunk: each run of the table holds from its first chunk to the next run's
    per_chunk = runs[np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), "right") - 1, 1] if len(runs) else np.zeros(len(chunks), np.int64)
    upto = np.cumsum(per_chunk)
    sizes = sizes[: int(upto[-1]) if len(upto) else 0]
    chunk_of = np.searchsorted(upto, np.arange(len(sizes)), "right")
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = (upto - per_chunk)[chunk_of]
    offsets = chunks[chunk_of] + before[:-1] - before[np.minimum(first, len(sizes))] if len(sizes) else sizes
    keys = _table(data, stss, ">u4", 1)[:, 0] - 1 if stss else np.arange(len(sizes))
    times = _table(data, stts, ">u4", 2)
    return {
        "codec": codec,
        "timescale": timescale,
        "duration": duration,
        "ticks": int((times[:, 0] * times[:, 1]).sum()),
        "offsets": offsets,
        "sizes": sizes,
        "keys": keys[(keys >= 0) & (keys < len(sizes))],
    }


def probe(content: bytes | None) -> dict | None:
    """Of the first complete track only (``probe_tracks`` gives all): codec, duration in seconds, number of samples and
    keyframe byte ranges.

    None for null, for data that is no container, and for truncated tables.
    """
    if content is None:
        return None
    data = memoryview(content)
    try:
        for a, b in find(data, (b"moov", b"trak")):
            t = track(data, a, b)
            if t:
                keys = t["keys"]
                return {
                    "codec": t["codec"],
                    "seconds": t["duration"] / t["timescale"] if t["timescale"] else None,
                    "samples": len(t["sizes"]),
                    "keyframes": [{"start": int(o), "length": int(n)} for o, n in zip(t["offsets"][keys], t["sizes"][keys])],
                }
    except (struct.error, ValueError, IndexError):
        return None
    return None


def probe_tracks(content: bytes | None) -> list[dict] | None:
    """All tracks in file order: handler type, the fields of ``probe``, complete and fragmented; None for no container.

    A track with missing or truncated tables has null fields. Samples of movie fragments are not listed: tracks of a
    file with fragments are marked, and not complete.
    """
    if content is None:
        return None
    data, out = memoryview(content), []
    fragmented = any(k == b"moof" for k, _, _ in boxes(data)) or next(find(data, (b"moov", b"mvex")), None) is not None
    for a, b in find(data, (b"moov", b"trak")):
        try:
            at, t = next(find(data, (b"mdia", b"hdlr"), a, b), None), track(data, a, b)
        except (struct.error, ValueError, IndexError):
            t = None
        keys = t["keys"] if t else []
        out.append({
            "handler": bytes(data[at[0] + 8 : at[0] + 12]).decode("latin-1") if at else None,
            "codec": t["codec"] if t else None,
            "seconds": t["duration"] / t["timescale"] if t and t["timescale"] else None,
            "samples": len(t["sizes"]) if t else None,
            "keyframes": [{"start": int(o), "length": int(n)} for o, n in zip(t["offsets"][keys], t["sizes"][keys])] if t else None,
            "complete": t is not None and not fragmented,
            "fragmented": fragmented,
        })
    return out or None


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE, key_every: int = KEY_EVERY) -> bytes:
    """A container with one track of raw 8-bit samples of ``unit`` bytes; the payload is a multiple of the unit."""
    n = len(payload) // unit
    keys = np.arange(1, n + 1, key_every, dtype=">u4")
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H8x2H4xI", 1, 1, 8, (rate & 0xFFFF) << 16))

    def moov(at: int) -> bytes:
        tables = _box(
            b"stbl",
            _box(b"stsd", struct.pack(">II", 0, 1), entry),
            _box(b"stts", struct.pack(">4I", 0, 1, n, unit)),
            _box(b"stsc", struct.pack(">5I", 0, 1, 1, n, 1)),
            _box(b"stsz", struct.pack(">3I", 0, unit, n)),
            _box(b"co64", struct.pack(">IIQ", 0, 1, at)),
            _box(b"stss", struct.pack(">II", 0, len(keys)), keys.tobytes()),
        )
        media = _box(
            b"mdia",
            _box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, rate, n * unit, 0x55C4, 0)),
            _box(b"hdlr", struct.pack(">II4s12x", 0, 0, b"soun"), b"\0"),
            _box(b"minf", _box(b"smhd", bytes(8)), tables),
        )
        head = _box(b"mvhd", struct.pack(">IQQIQIH10x", 1 << 24, 0, 0, rate, n * unit, 0x10000, 0x100), unity, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", head, _box(b"trak", _box(b"tkhd", struct.pack(">IQQIIQ8xHHHH", 1 << 24 | 7, 0, 0, 1, 0, n * unit, 0, 0, 0x100, 0), unity, bytes(8)), media))

    at = len(ftyp) + len(moov(0)) + 16
    return b"".join([ftyp, moov(at), struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16), payload])


def padded(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    """Length of the text's UTF-8 bytes, and those bytes filled with blanks to a positive multiple of the unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // unit)) * unit, b" ")


def probe_media_tracks(df: DataFrame, content_col: str) -> DataFrame:
    """The input with an array column ``tracks``: one struct of ``probe_tracks`` per track; null for no container."""

    @F.pandas_udf("array<struct<handler: string, codec: string, seconds: double, samples: long, keyframes: array<struct<start: long, length: long>>, complete: boolean, fragmented: boolean>>")
    def tracks(contents):
        import pandas as pd

        return pd.Series([probe_tracks(None if x is None else bytes(x)) for x in contents], dtype=object)

    return df.withColumn("tracks", tracks(F.col(content_col)))


def probe_media(df: DataFrame, content_col: str) -> DataFrame:
    """The input with a struct column ``media`` of the first complete track only (``probe_media_tracks`` gives all): codec,
    seconds, samples, keyframes (start and length in the file).

    Null, empty, foreign and truncated contents give a null struct. A column named ``media`` is replaced.
    """

    @F.pandas_udf("codec string, seconds double, samples long, keyframes array<struct<start: long, length: long>>")
    def run(contents):
        import pandas as pd

        none = {"codec": None, "seconds": None, "samples": None, "keyframes": None}
        return pd.DataFrame([probe(None if x is None else bytes(x)) or none for x in contents], columns=list(none))

    found = run(F.col(content_col))
    return df.select(*[c for c in df.columns if c != "media"], found.alias("media")).withColumn("media", F.when(F.col("media.samples").isNotNull(), F.col("media")))


def mux_texts(docs: DataFrame, text_col: str = "text", content_col: str = "content") -> DataFrame:
    """The input with a binary container of each whole text; null counts as empty."""

    @F.pandas_udf("binary")
    def run(texts):
        return texts.map(lambda t: mux(padded(t)[1]))

    return docs.select(*[c for c in docs.columns if c != content_col], run(F.col(text_col)).alias(content_col))


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text stored in a container, read back through its tables, and what the tables say.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, keyframes (all
    byte ranges in the container, array of start and length). The payload
    hashed is the bytes that the sample tables point to. The feature names the codec, the duration in ticks and
    seconds, the samples, and the number and total length of keyframes with the first and last one's byte range.
    Null and empty texts store one unit of blanks. Equal texts give equal rows but for the id.
    """

    def run(batches):
        for batch in batches:
            rows, ranges = [], []
            for text in batch.column(1).to_pylist():
                n, payload = padded(text)
                media = mux(payload)
                data = memoryview(media)
                t = next(x for x in (track(data, a, b) for a, b in find(data, (b"moov", b"trak"))) if x)
                sizes, offsets, keys = t["sizes"], t["offsets"], t["keys"]
                # neighbouring samples are read as one range
                breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
                spans = [(int(offsets[i]), int(offsets[j - 1] + sizes[j - 1])) for i, j in zip([0, *breaks], [*breaks, len(sizes)])]
                back = b"".join([data[a:b] for a, b in spans])
                first, last = keys[0], keys[-1]
                ranges.append((offsets[keys], sizes[keys]))
                rows.append(
                    (
                        n,
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-16:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        f"codec={t['codec'].strip()};ticks={t['duration']};seconds={t['duration'] / t['timescale']:.6f};samples={len(sizes)};"
                        f"keyframes={len(keys)};key_bytes={int(sizes[keys].sum())};"
                        f"first_key={offsets[first]}+{sizes[first]};last_key={offsets[last]}+{sizes[last]}",
                    )
                )
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            start, length = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*ranges) if ranges else ((), ())))
            ends = np.cumsum([0, *[len(x) for x, _ in ranges]]).astype(np.int32)
            keyframes = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(start), pa.array(length)], ["start", "length"]))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([batch.column(0), *[pa.array(x, k) for x, k in zip(columns, kinds)], keyframes], names=["id", *names, "keyframes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(
            run,
            f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes array<struct<start: long, length: long>>",
        )
        .withColumnRenamed("id", id_col)
    )
