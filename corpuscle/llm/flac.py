"""FLAC media columns: encode and decode mono 8-bit streams, many frames at a time.

Frames of a batch are worked on in lockstep: step t handles the t-th residual of
every frame, so Rice codes and linear predictors are decoded with a few array
operations a step. Each stream has a STREAMINFO block with the MD5 of its
samples and a SEEKTABLE with the sample number and byte offset of every frame;
CRC-8 of headers and CRC-16 of frames are verified on reading.
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

from corpuscle.llm import _arrays as A

RATE, FRAME, ORDER, PRECISION, SHIFT = 8000, 2048, 4, 10, 8


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, out = 1 << (width - 1), []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c & top else c << 1
        out.append(c & ((1 << width) - 1))
    return np.array(out, dtype=np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8 = bytes(CRC8.astype(np.uint8))
#: State of two bytes at once: crc16 of the pair, from a zero state.
_PAIRS = ((CRC16[np.arange(65536) >> 8] << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(CRC16[np.arange(65536) >> 8] >> np.uint32(8)) ^ (np.arange(65536, dtype=np.uint32) & np.uint32(255))]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans; leading zero bytes don't change a zero state, so spans are right-aligned."""
    out = np.zeros(len(start), dtype=np.uint32)
    order = np.argsort(end - start, kind="stable")
    for a in range(0, len(order), 1024):
        rows = order[a : a + 1024]
        size = end[rows] - start[rows]
        width = int(size.max()) + (int(size.max()) & 1)
        cells = np.zeros((len(rows), width), dtype=np.uint8)
        cells[np.arange(width)[None, :] >= (width - size)[:, None]] = data[A.ragged(start[rows], size)]
        pairs = np.ascontiguousarray(cells.view(">u2").T).astype(np.uint32)
        c = np.zeros(len(rows), dtype=np.uint32)
        for p in pairs:
            c = _PAIRS[c ^ p]
        out[rows] = c
    return out


def _utf8_number(n: int) -> bytes:
    """The frame number in FLAC's UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    out, lead = [], 0x3F
    while n > lead:
        out.append(0x80 | (n & 0x3F))
        n >>= 6
        lead >>= 1
    return bytes([(~lead << 1) & 0xFF | n, *reversed(out)])


class _Bits:
    """A bit buffer that fields are scattered into."""

    def __init__(self, size: int) -> None:
        self.bits = np.zeros(size, dtype=np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            self.bits[at + b] = (value >> (width - 1 - b)) & 1


def _predictors(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors, (frames, ORDER), by least squares on each frame's autocorrelation."""
    f = x.astype(np.float64)
    auto = np.empty((len(first), ORDER + 1))
    inside = np.arange(len(x)) - np.repeat(first, size)
    for j in range(ORDER + 1):
        p = f.copy()
        p[j:] *= f[: len(f) - j]
        if j:
            p[inside < j] = 0
        auto[:, j] = np.add.reduceat(p, first)
    i = np.arange(ORDER)
    m = auto[:, np.abs(i[:, None] - i[None, :])] + np.eye(ORDER) * (auto[:, :1, None] * 1e-6 + 1e-3)
    c = np.linalg.solve(m, auto[:, 1:, None])[:, :, 0]
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(c * (1 << SHIFT)), -limit - 1, limit).astype(np.int64), inside


def encode(payload: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """FLAC streams of the payload rows (each of at least 16 bytes), and each stream's frame sizes."""
    x = payload.astype(np.int64) - 128
    rows = len(offs) - 1
    per = -(-np.diff(offs) // FRAME)
    row = np.repeat(np.arange(rows), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    first = offs[row] + number * FRAME
    size = np.minimum(FRAME, offs[row + 1] - first)
    coef, inside = _predictors(x, first, size)
    frame = np.repeat(np.arange(len(row)), size)

    prev = np.zeros((ORDER, len(x)), dtype=np.int64)
    for j in range(ORDER):
        prev[j, j + 1 :] = x[: len(x) - j - 1]
    guess = np.zeros(len(x), dtype=np.int64)
    for j in range(ORDER):
        guess += coef[frame, j] * prev[j]
    options = [(0, x), (1, x - prev[0]), (2, x - 2 * prev[0] + prev[1]), (ORDER, x - (guess >> SHIFT))]
    costs = np.stack([np.add.reduceat(np.where(inside < o, 128, np.abs(r)), first) for o, r in options])
    best = costs.argmin(axis=0)
    order = np.array([o for o, _ in options])[best]
    residual = np.choose(best[frame], [r for _, r in options])
    constant = (np.maximum.reduceat(x, first) == np.minimum.reduceat(x, first))

    parts = np.ones(len(row), dtype=np.int64)
    for p in (1, 2, 3):
        parts = np.where((size % (1 << p) == 0) & (size >> p >= 256), 1 << p, parts)
    zigzag = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    coded = (inside >= order[frame]) & ~constant[frame]
    zigzag[~coded] = 0
    pfirst = np.repeat(first, parts) + A.ragged(np.zeros(len(parts), np.int64), parts) * np.repeat(size // parts, parts)
    pframe = np.repeat(np.arange(len(row)), parts)
    psize = np.repeat(size // parts, parts)
    pcount = np.add.reduceat(coded.astype(np.int64), pfirst)
    mean = np.add.reduceat(zigzag, pfirst) / np.maximum(1, pcount)
    about = np.clip(np.floor(np.log2(np.maximum(1.0, mean * 0.7))), 0, 14).astype(np.int64)
    near = np.clip(about + np.array([[0], [-1], [1]]), 0, 14)  # of these the one of the fewest bits
    bits = np.stack([np.add.reduceat(zigzag >> np.repeat(n, psize), pfirst) + n * pcount for n in near])
    rice = np.choose(bits.argmin(axis=0), near)
    k = np.repeat(rice, psize)
    length = np.where(coded, (zigzag >> k) + 1 + k, 0)

    lpc = best == 3
    head = np.array([7 + len(_utf8_number(int(n))) for n in number])
    prelude = np.where(constant, 16, 8 + 8 * order + np.where(lpc, 9 + PRECISION * ORDER, 0) + 6 + 4 * parts)
    body_bits = prelude + np.add.reduceat(length, first)
    frame_bytes = head + -(-body_bits // 8) + 2
    frame_end = np.cumsum(frame_bytes)
    frame_at = frame_end - frame_bytes
    out = _Bits(8 * int(frame_end[-1]))
    bit = 8 * (frame_at + head)

    kind = np.where(constant, 0, np.where(lpc, 32 + ORDER - 1, 8 + order))
    out.put(bit, kind << 1, 8)
    sample = lambda j: (x[first + j] & 0xFF)
    out.put(bit[constant] + 8, sample(0)[constant], 8)
    at = bit + 8
    for j in range(ORDER):
        some = (j < order) & ~constant
        out.put(at[some], sample(j)[some], 8)
        at = at + 8 * some
    some = lpc & ~constant
    out.put(at[some], np.full(int(some.sum()), PRECISION - 1), 4)
    out.put(at[some] + 4, np.full(int(some.sum()), SHIFT), 5)
    for j in range(ORDER):
        out.put(at[some] + 9 + PRECISION * j, coef[some, j] & ((1 << PRECISION) - 1), PRECISION)
    at = at + (9 + PRECISION * ORDER) * some
    out.put(at[~constant] + 2, np.log2(parts[~constant]).astype(np.int64), 4)
    at = at + 6

    # every sample's code begins after the codes before it and the parameters up to its partition
    before = np.cumsum(length) - length
    pno = np.arange(len(pframe)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = before - np.repeat(before[first], size) + at[frame] + np.repeat(4 * (pno + 1), psize)
    keep = ~constant[pframe]
    out.put((start[pfirst] - 4)[keep], rice[keep], 4)
    start, z, k = start[coded], zigzag[coded], k[coded]
    stop = start + (z >> k)
    out.bits[stop] = 1
    for b in range(int(k.max(initial=0))):
        some = np.flatnonzero(k > b)
        out.bits[stop[some] + 1 + b] = (z[some] >> (k[some] - 1 - b)) & 1
    data = np.packbits(out.bits)

    for f, (n, s, h, p) in enumerate(zip(number.tolist(), size.tolist(), head.tolist(), frame_at.tolist(), strict=True)):
        header = b"\xff\xf8\x74\x02" + _utf8_number(n) + struct.pack(">H", s - 1)
        data[p : p + h] = np.frombuffer(header + bytes([crc8(header)]), dtype=np.uint8)
    check = crc16(data, frame_at, frame_end - 2)
    data[frame_end - 2], data[frame_end - 1] = check >> 8, check & 255

    raw, signed, streams, sizes, f = data.tobytes(), (payload ^ np.uint8(0x80)).tobytes(), [], [], 0
    for r in range(rows):
        g = f + int(per[r])
        own = frame_bytes[f:g]
        total = int(offs[r + 1] - offs[r])
        block = min(FRAME, total)
        info = struct.pack(">HH", block, block) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + hashlib.md5(signed[offs[r] : offs[r + 1]]).digest()
        points = b"".join(struct.pack(">QQH", n * FRAME, int(frame_at[f + n] - frame_at[f]), int(size[f + n])) for n in range(g - f))
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[frame_at[f] : frame_end[g - 1]])
        sizes.append(own)
        f = g
    return streams, sizes


def read_metadata(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """(total samples, MD5, seek points (sample, offset, samples), place of the first frame) of a stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise ValueError("only mono streams of 8-bit samples are read here")
            total, md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + size
    return total, md5, points, at


#: Predictors of the fixed subframes, most recent sample first.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


def decode(streams: list[bytes]) -> np.ndarray:
    """All samples of the streams as unsigned bytes, one stream after the other."""
    if not streams:
        return np.zeros(0, dtype=np.uint8)
    data = np.frombuffer(b"".join(streams) + bytes(8), dtype=np.uint8)
    raw = data.tobytes()
    starts, ends, want, base = [], [], [], 0
    for s in streams:
        total, md5, points, at = read_metadata(s)
        if sum(p[2] for p in points) != total:
            raise ValueError("the seek table doesn't cover the stream")
        offsets = [base + at + p[1] for p in points]
        starts += offsets
        ends += [*offsets[1:], base + len(s)]
        want.append((total, md5))
        base += len(s)
    start, end = np.array(starts), np.array(ends)
    if (crc16(data, start, end) != 0).any():
        raise ValueError("CRC-16 of a frame doesn't agree")

    n = len(start)
    size, order, shift = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    parts, bit, kind = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    coefs: list[tuple[int, ...]] = []
    warm: list[tuple[int, ...]] = []
    for f, a in enumerate(starts):
        if raw[a] != 0xFF or raw[a + 1] & 0xFE != 0xF8:
            raise ValueError("no frame where the seek table says")
        h = a + 5
        while raw[h] & 0xC0 == 0x80:
            h += 1
        code = raw[a + 2] >> 4
        if code == 7:
            size[f], h = int.from_bytes(raw[h : h + 2], "big") + 1, h + 2
        elif code == 6:
            size[f], h = raw[h] + 1, h + 1
        else:
            size[f] = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
        h += {12: 1, 13: 2, 14: 2}.get(raw[a + 2] & 15, 0)
        if crc8(raw[a:h]) != raw[h]:
            raise ValueError("CRC-8 of a frame header doesn't agree")
        kind[f], p = raw[h + 1] >> 1, 8 * (h + 2)
        if raw[h + 1] & 1:
            raise ValueError("wasted bits are not read here")
        order[f] = kind[f] - 8 if 8 <= kind[f] <= 12 else kind[f] - 31 if kind[f] >= 32 else 0
        o = int(order[f])
        b = h + 2
        warm.append(tuple(_signed(v, 8) for v in raw[b : b + (o if kind[f] >= 8 else 1)]))
        p += 8 * o
        own: tuple[int, ...] = _FIXED[o] if 8 <= kind[f] <= 12 else ()
        if kind[f] >= 32:
            width = 9 + 15 * o
            word = int.from_bytes(raw[b + o : b + o + -(-width // 8) + 1], "big")
            bits = 8 * (-(-width // 8) + 1)
            precision = (word >> (bits - 4) & 15) + 1
            shift[f] = word >> (bits - 9) & 31
            own = tuple(_signed(word >> (bits - 9 - precision * (j + 1)) & (1 << precision) - 1, precision) for j in range(o))
            p += 9 + precision * o
        coefs.append(own)
        if kind[f] >= 8:
            word = int.from_bytes(raw[p >> 3 : (p >> 3) + 2], "big") >> (10 - (p & 7))
            if word >> 4 & 3:
                raise ValueError("five-bit Rice parameters are not read here")
            parts[f] = 1 << (word & 15)
            p += 6
        bit[f] = p

    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.int64)
    for f in np.flatnonzero(kind == 0):
        out[first[f] : first[f] + size[f]] = warm[f][0]
    for f in np.flatnonzero(kind == 1):
        b = int(bit[f]) >> 3
        out[first[f] : first[f] + size[f]] = data[b : b + size[f]].view(np.int8)
    coded = np.flatnonzero(kind >= 8)
    if len(coded):
        coded = coded[np.argsort(order[coded] - size[coded], kind="stable")]  # most residuals first
        residual = _residuals(data, bit[coded], size[coded] - order[coded], size[coded] // parts[coded], order[coded])
        depth = max(1, int(order[coded].max()))
        c = np.zeros((depth, len(coded)), dtype=np.int64)
        x = np.zeros((depth + len(residual), len(coded)), dtype=np.int64)
        for i, f in enumerate(coded):
            for j, v in enumerate(coefs[f]):
                c[depth - 1 - j, i] = v
            for j, v in enumerate(warm[f]):
                x[depth - len(warm[f]) + j, i] = v
        counts = size[coded] - order[coded]
        active = len(coded) - np.searchsorted(counts[::-1], np.arange(len(residual)), side="right")
        down = shift[coded]
        for t in range(len(residual)):
            m = active[t]
            x[depth + t, :m] = residual[t, :m] + ((c[:, :m] * x[t : t + depth, :m]).sum(axis=0) >> down[:m])
        for o in np.unique(order[coded]):
            some = np.flatnonzero(order[coded] == o)
            rows = coded[some]
            cells = x[depth - o :, some].T
            out[A.ragged(first[rows], size[rows])] = cells[np.arange(cells.shape[1])[None, :] < size[rows][:, None]]
    samples = (out + 128).astype(np.uint8)
    signed, at = (samples ^ np.uint8(0x80)).tobytes(), 0
    for total, md5 in want:
        if hashlib.md5(signed[at : at + total]).digest() != md5:
            raise ValueError("MD5 of the samples doesn't agree")
        at += total
    return samples


def _residuals(data: np.ndarray, bit: np.ndarray, counts: np.ndarray, part: np.ndarray, order: np.ndarray) -> np.ndarray:
    """(steps, frames) residuals; frames come with falling counts, part is the samples of a partition."""
    n_bits = 8 * len(data)
    place = np.where(np.unpackbits(data).view(bool), np.arange(n_bits, dtype=np.int32), np.int32(n_bits))
    following = np.minimum.accumulate(place[::-1])[::-1]  # the next 1 at or after each bit
    del place
    steps, n = int(counts[0]), len(bit)
    word = np.zeros(len(data), dtype=np.uint32)
    for b in range(4):
        word[: len(data) - b] |= data[b:].astype(np.uint32) << np.uint32(24 - 8 * b)
    active = n - np.searchsorted(counts[::-1], np.arange(steps), side="right")
    due = np.zeros(n, dtype=np.int64)
    switches = set(np.unique(np.concatenate([np.unique(p * np.arange(0, (c + o) // p + 1) - o) for p, c, o in {(int(p), int(c), int(o)) for p, c, o in zip(part, counts, order, strict=True)}])).tolist()) | {0}
    high, rest, width = np.zeros((steps, n), np.int32), np.zeros((steps, n), np.int32), np.zeros((steps, n), np.uint8)
    raw = np.zeros(n, dtype=bool)
    any_raw, raw_cells = False, None
    pos, k = bit.astype(np.int64), np.zeros(n, np.int64)
    due[:] = 0
    for t in range(steps):
        m = active[t]
        if t in switches:
            turn = np.flatnonzero(due[:m] == t)
            if len(turn):
                p = pos[turn]
                k[turn] = (word[p >> 3] >> (28 - (p & 7)).astype(np.uint32)) & 15
                pos[turn] = p + 4
                due[turn] = np.where(due[turn] == 0, part[turn] - order[turn], due[turn] + part[turn])
                raw[turn] = k[turn] == 15
                if raw[turn].any():  # escaped partition: samples as plain signed numbers
                    if raw_cells is None:
                        any_raw, raw_cells = True, np.zeros((steps, n), dtype=bool)
                    e = turn[raw[turn]]
                    p = pos[e]
                    k[e] = (word[p >> 3] >> (27 - (p & 7)).astype(np.uint32)) & 31
                    pos[e] = p + 5
        p = pos[:m]
        stop = following[p]
        if any_raw:
            stop = np.where(raw[:m], p - 1, stop)
            raw_cells[t, :m] = raw[:m]
        high[t, :m] = stop - p
        rest[t, :m] = stop + 1
        width[t, :m] = k[:m]
        pos[:m] = stop + 1 + k[:m]
    w = width.astype(np.uint32)
    low = (word[rest >> 3] >> np.where(w > 0, np.uint32(32) - (rest & 7).astype(np.uint32) - w, np.uint32(0))) & ((np.uint32(1) << w) - np.uint32(1))
    value = (high.astype(np.int64) << w.astype(np.int64)) | low.astype(np.int64)
    out = np.where(value & 1, -(value >> 1) - 1, value >> 1)
    if any_raw:
        low = low.astype(np.int64)
        signed = np.where((w > 0) & (low >> np.maximum(w.astype(np.int64) - 1, 0) & 1 == 1), low - (1 << w.astype(np.int64)), low)
        out = np.where(raw_cells, signed, out)
    return out


def padded(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, payload, its offsets, unpadded sizes): UTF-8 with zeros up to a positive multiple of 64."""
    for i, j, data, offs in A.blocks(column, 2 << 20):
        size = np.diff(offs)
        full = np.maximum(64, -(-size // 64) * 64)
        ends = np.concatenate([[0], np.cumsum(full)])
        payload = np.zeros(int(ends[-1]), dtype=np.uint8)
        payload[A.ragged(ends[:-1], size)] = data
        yield i, j, payload, ends, size


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded, as a FLAC stream of 8-bit samples.

    A null text counts as empty and is stored as 64 zeros. Rows are independent:
    repeated ids and rows stay rows, equal texts have equal streams, and a text of
    any length is one stream (one longer than a block forms a block of its own).
    Other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, payload, offs, size in padded(batch.column(1)):
                streams, _ = encode(payload, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(streams, pa.binary())], names=["doc_id", "n_bytes", "media"])
        A.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, byte_offset, n_samples, pcm) of (doc_id, media): a row for each frame.

    first_sample and byte_offset are those of the seek table, so a range of
    samples can be read from the blocks that it touches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pcm = decode([stream]).tobytes()
                out += [(doc, b, p[0], p[1], p[2], pcm[p[0] : p[0] + p[2]]) for b, p in enumerate(read_metadata(stream)[2])]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=["doc_id", "block", "first_sample", "byte_offset", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, first_sample long, byte_offset long, n_samples long, pcm binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Of (doc_id, n_bytes, media): sizes and digests of payload and stored form, and features of the samples.

    feature holds the sum and the sum of squares of the samples, and how often
    their sign changes, all of the decoded stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _ in A.blocks(batch.column(2), 2 << 20):
                streams = batch.column(2).slice(i, j - i).to_pylist()
                samples = decode(streams)
                size = np.array([read_metadata(s)[0] for s in streams])
                ends = np.cumsum(size)
                first = ends - size
                x = samples.astype(np.int64) - 128
                total, power = np.add.reduceat(x, first), np.add.reduceat(x * x, first)
                turn = np.zeros(len(x), dtype=np.int64)
                turn[1:] = (x[1:] < 0) != (x[:-1] < 0)
                turn[first] = 0
                turns = np.add.reduceat(turn, first)
                raw = samples.tobytes()
                payloads = [raw[a:b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(size, pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                        pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
                        pa.array([f"sum={a};power={b};turns={c}" for a, b, c in zip(total, power, turns, strict=True)]),
                    ],
                    names=[f.split()[0] for f in FEATURES.split(", ")],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
