"""Media columns as FLAC streams: write PCM, decode it again, verify every checksum.

``write`` turns 8-bit PCM into a mono stream: STREAMINFO with the MD5 of the samples, a seek table with a point for
every frame, and frames of 4096 samples coded as constant, or by the fixed linear predictor (order 0 to 4) and
Rice parameter that need the fewest bits. ``read_blocks`` decodes one-channel streams of any predictor kind
(constant, verbatim, fixed, LPC, wasted bits, escaped and partitioned Rice residuals), verifies the CRC-8 of every frame header,
the CRC-16 of every frame and the MD5 of the samples, and returns PCM blocks with their first sample.

Rice codes have no fixed length, so a decoder walks from code to code. All frames of a batch are walked together, one code
of every frame a step; a full seek table lets the frames of one long stream take part at the same time.

Defined results: a null binary is an empty payload; an empty payload is a stream without frames. A stream whose
checksums or syntax are wrong gives ok = false and no blocks, and the task goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
RATE = 8000
#: Bytes of payload that are coded together in a task.
TOGETHER = 1_500_000


class BadStream(ValueError):
    pass


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = np.arange(256, dtype=np.uint32) << np.uint32(width - 8)
    for _ in range(8):
        out = np.where(out & np.uint32(top), (out << np.uint32(1)) ^ np.uint32(poly), out << np.uint32(1)) & np.uint32(mask)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_by_distance = CRC16.astype(np.uint16)[None, :]  # row d: what a byte adds that d bytes follow


def _distance_rows(n: int) -> np.ndarray:
    global _by_distance
    if len(_by_distance) < n:
        rows = [*_by_distance]
        table = CRC16.astype(np.uint16)
        while len(rows) < max(n, 2 * len(_by_distance), 1024):
            last = rows[-1]
            rows.append((last << np.uint16(8)) ^ table[last >> np.uint16(8)])
        _by_distance = np.array(rows)
    return _by_distance


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def crc16_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of slices that follow each other: a CRC is the xor of what every byte adds at its distance to the end."""
    rows = _distance_rows(int((ends - starts).max()))
    distance = np.repeat(ends, ends - starts) - np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)]) - 1
    cover = np.concatenate([data[a:b] for a, b in zip(starts, ends, strict=True)])
    at = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    return np.bitwise_xor.reduceat(rows[distance, cover], at)


def _coded_number(n: int) -> bytes:
    """A frame number, coded as UTF-8 codes a character, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more + 6 - more):
        more += 1
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | (n >> (6 * more)), *((0x80 | ((n >> (6 * k)) & 0x3F)) for k in range(more - 1, -1, -1))])


def _fixed_residual(x: np.ndarray, order: int) -> np.ndarray:
    return np.diff(x, order) if order else x


def _plan(x: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Order, Rice parameter and zigzag residual with the fewest bits (by the mean, which is near the best)."""
    best = None
    for order in range(min(4, len(x) - 1) + 1):
        r = _fixed_residual(x, order)
        u = (r << 1) ^ (r >> 31)
        total = int(u.sum())
        k = max(0, min(14, int(np.log2(max(1.0, total / max(1, len(u)) * 0.6931)))))
        bits = 8 * order + len(u) * (k + 1) + (total >> k)
        if best is None or bits < best[0]:
            best = (bits, order, k, u)
    return best[1:]


def _header(number: int, size: int) -> bytes:
    head = bytes([0xFF, 0xF8, (7 << 4) | 4, (0 << 4) | (1 << 1)]) + _coded_number(number) + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def write(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """FLAC streams of 8-bit unsigned payloads; FLAC's 8-bit samples are signed, so 128 is taken off."""
    frames: list[tuple[int, bytes, np.ndarray]] = []  # payload, header and the bits of the subframe
    for p, data in enumerate(payloads):
        x = np.frombuffer(data, np.uint8).astype(np.int32) - 128
        for number, at in enumerate(range(0, len(x), block)):
            part = x[at : at + block]
            head = _header(number, len(part))
            if (part == part[0]).all():
                body = np.unpackbits(np.array([0, part[0] & 0xFF], np.uint8))
            else:
                order, k, u = _plan(part)
                q = u >> k
                codes = np.cumsum(q + 1 + k)
                lead = 8 + 8 * order + 6 + 4
                body = np.zeros(lead + int(codes[-1]), np.uint8)
                _put(body, np.array([0]), np.array([(8 | order) << 1]), 8)
                for j in range(order):
                    _put(body, np.array([8 + 8 * j]), np.array([int(part[j]) & 0xFF]), 8)
                _put(body, np.array([lead - 4]), np.array([k]), 4)  # method 0, partition order 0 before it
                ones = lead + codes - k - 1
                body[ones] = 1
                _put(body, ones + 1, u, k)
            frames.append((p, head, np.packbits(body)))
    out = [[] for _ in payloads]
    if frames:
        whole = [np.concatenate([np.frombuffer(h, np.uint8), b]) for _, h, b in frames]
        ends = np.cumsum([len(w) for w in whole])
        sums = crc16_many(np.concatenate(whole), ends - [len(w) for w in whole], ends)
        for (p, _, _), w, s in zip(frames, whole, sums.tolist(), strict=True):
            out[p].append(w.tobytes() + s.to_bytes(2, "big"))
    return [_stream(data, parts, block) for data, parts in zip(payloads, out, strict=True)]


def _stream(data: bytes, frames: list[bytes], block: int) -> bytes:
    sizes = [len(f) for f in frames] or [0]
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(data)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(data, np.uint8) ^ 0x80).tobytes()).digest()
    points, at = [], 0
    for i, f in enumerate(frames):
        points.append((i * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, len(data) - i * block).to_bytes(2, "big"))
        at += len(f)
    table = b"".join(points)
    if len(table) >= 1 << 24:  # a metadata block's limit; a reader then walks from frame to frame
        table = b""
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + b"".join(frames)


class _Stream:
    """Metadata of a stream, and where its frames are."""

    def __init__(self, data: bytes):
        self.data, self.blocks, self.error = data, [], None
        try:
            self._metadata()
        except (BadStream, IndexError, ValueError) as e:
            self.error = str(e) or "cut off"

    def _metadata(self) -> None:
        d = self.data
        if d[:4] != b"fLaC":
            raise BadStream("no stream marker")
        at, last, points, seen = 4, False, [], False
        while not last:
            last, kind, size = d[at] >> 7, d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
            body = d[at + 4 : at + 4 + size]
            if len(body) < size:
                raise BadStream("metadata is cut off")
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.channels, self.bits, self.total, self.md5, seen = ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1), body[18:34], True
            elif kind == 3:
                points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            at += 4 + size
        if not seen or self.channels != 1 or self.bits > 16:
            raise BadStream("only streams of one channel and up to 16 bits are read")
        points = [p for p in points if p[0] != (1 << 64) - 1]
        full = bool(points) and all(a[0] + a[2] == b[0] and a[1] < b[1] for a, b in zip(points, points[1:], strict=False)) and points[0][:2] == (0, 0) and points[-1][0] + points[-1][2] == self.total
        begins = [at + p[1] for p in points] if full else [at]
        self.frames = list(zip(begins, [*begins[1:], len(d)], strict=True)) if at < len(d) else []
        self.walk = not full


def _frame_header(d: bytes, at: int, bits: int) -> tuple[int, int, int]:
    """Number of samples, bits a sample and the header's length."""
    if d[at] != 0xFF or d[at + 1] & 0xFE != 0xF8:
        raise BadStream("no frame sync")
    size_code, rate_code, bits_code, end = d[at + 2] >> 4, d[at + 2] & 15, (d[at + 3] >> 1) & 7, at + 5
    lead = d[at + 4]
    while lead & 0xC0 == 0xC0:
        lead, end = (lead << 1) & 0xFF, end + 1
    extra = {6: 1, 7: 2}.get(size_code, 0)
    if extra:
        n = int.from_bytes(d[end : end + extra], "big") + 1
    elif size_code == 1:
        n = 192
    elif 2 <= size_code <= 5:
        n = 576 << (size_code - 2)
    elif size_code >= 8:
        n = 256 << (size_code - 8)
    else:
        raise BadStream("reserved block size")
    end += extra + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(d[at:end]) != d[end]:
        raise BadStream("a frame header's CRC-8 is wrong")
    return n, {0: bits, 1: 8, 2: 12, 4: 16}.get(bits_code) or _reserved(), end + 1 - at


def _reserved() -> int:
    raise BadStream("sample size is not read")


class _Lane:
    """One frame being decoded: a cursor in bits into the batch's bits, its samples as far as known."""

    __slots__ = ("base", "bits", "cursor", "end", "error", "limit", "lpc", "n", "order", "out", "parts", "raw", "shift", "size", "start", "stream", "wasted", "width")


def _integer(data: np.ndarray, at: int, width: int, signed: bool = True) -> int:
    first = at >> 3
    word = int.from_bytes(data[first : first + 8].tobytes().ljust(8, b"\0"), "big")
    value = (word >> (64 - (at & 7) - width)) & ((1 << width) - 1)
    return value - (1 << width) if signed and value >> (width - 1) else value


def _open(lane: _Lane, data: np.ndarray) -> None:
    """Read a subframe's header up to its Rice parameters."""
    at = lane.cursor
    head = _integer(data, at, 8, False)
    at, kind, lane.wasted = at + 8, (head >> 1) & 63, 0
    if head >> 7:
        raise BadStream("a padding bit is set")
    if head & 1:
        while not _integer(data, at + lane.wasted, 1, False):
            lane.wasted += 1
        lane.wasted += 1
        at += lane.wasted
    width, lane.parts, lane.lpc, lane.shift = lane.width - lane.wasted, [], None, 0
    if kind == 0:
        lane.out, lane.order, lane.cursor = np.full(lane.n, _integer(data, at, width), np.int64), -1, at + width
        return
    if kind == 1:
        lane.out, lane.order, lane.cursor = np.array([_integer(data, at + i * width, width) for i in range(lane.n)], np.int64), -1, at + lane.n * width
        return
    if not (8 <= kind <= 12 or kind >= 32):
        raise BadStream("reserved subframe")
    lane.order = kind - 8 if kind < 32 else kind - 31
    lane.out = np.zeros(lane.n, np.int64)
    for i in range(lane.order):
        lane.out[i] = _integer(data, at + i * width, width)
    at += lane.order * width
    if kind >= 32:
        precision, lane.shift = _integer(data, at, 4, False) + 1, _integer(data, at + 4, 5)
        lane.lpc = [_integer(data, at + 9 + i * precision, precision) for i in range(lane.order)]
        at += 9 + lane.order * precision
    method, partitions = _integer(data, at, 2, False), 1 << _integer(data, at + 2, 4, False)
    if method > 1 or lane.n % partitions:
        raise BadStream("reserved residual coding")
    lane.raw = 4 + method
    each = lane.n // partitions
    lane.parts = [(i * each + (0 if i else lane.order), (i + 1) * each) for i in range(partitions)][::-1]
    lane.cursor = at + 6


def _walk(lanes: list[_Lane], data: np.ndarray) -> None:
    """Decode the residuals of all lanes, partition by partition, one code of every lane a step."""
    bits = np.unpackbits(data)
    place = np.arange(len(bits), dtype=np.int32)
    far = np.int32(len(bits))
    next_one = np.minimum.accumulate(np.where(bits, place, far)[::-1])[::-1]
    next_one = np.append(next_one, far)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    live = [x for x in lanes if x.parts]
    while live:
        todo = []
        for x in live:
            a, b = x.parts.pop()
            k = _integer(data, x.cursor, x.raw, False)
            x.cursor += x.raw
            if k == (1 << x.raw) - 1:  # escaped: plain numbers of a given width
                width = _integer(data, x.cursor, 5, False)
                x.cursor += 5
                if width:
                    x.out[a:b] = [_integer(data, x.cursor + i * width, width) for i in range(b - a)]
                x.cursor += width * (b - a)
            elif b > a:
                todo.append((x, a, b, k))
        if todo:
            todo.sort(key=lambda t: t[1] - t[2])
            counts = np.array([b - a for _, a, b, _ in todo])
            k = np.array([t[3] for t in todo], np.int32)
            at = np.array([t[0].cursor for t in todo], np.int32)
            steps = int(counts[0])
            ones = np.zeros((steps, len(todo)), np.int32)
            active = np.searchsorted(-counts, -np.arange(steps), "left")
            jump, top = k + 1, far
            for i in range(steps):
                m = active[i]
                row = ones[i, :m]
                np.take(next_one, at[:m], out=row, mode="clip")
                at[:m] = np.minimum(row + jump[:m], top)
            for j, (x, a, b, kk) in enumerate(todo):
                one = ones[: b - a, j].astype(np.int64)
                first = np.concatenate([[x.cursor], one[:-1] + 1 + kk])
                x.cursor = int(one[-1]) + 1 + kk
                if x.cursor > x.limit:
                    x.error = "a frame is cut off"
                    x.parts = []
                    continue
                u = (one - first) << kk
                if kk:
                    low = one + 1
                    byte = low >> 3
                    word = np.zeros(len(low), np.int64)
                    for s in range((kk + 14) // 8):
                        word = (word << 8) | padded[byte + s]
                    u |= (word >> (8 * ((kk + 14) // 8) - (low & 7) - kk)) & ((1 << kk) - 1)
                x.out[a:b] = (u >> 1) ^ -(u & 1)
        live = [x for x in live if x.parts]


def _predict(lane: _Lane) -> np.ndarray:
    x = lane.out
    if lane.lpc is not None:
        warm, values = lane.order, x.tolist()
        for i in range(warm, lane.n):
            values[i] += sum(c * values[i - 1 - j] for j, c in enumerate(lane.lpc)) >> lane.shift
        x = np.array(values, np.int64)
    elif lane.order > 0:
        first, rest = x[: lane.order], x[lane.order :]
        for o in range(lane.order - 1, -1, -1):  # sum the differences back, from the highest order down
            rest = np.cumsum(np.concatenate([np.diff(first, o)[-1:], rest]))[1:]
        x = np.concatenate([first, rest])
    return x << lane.wasted


def _decode_together(jobs: list[tuple[_Stream, int, int]]) -> None:
    """Decode frames that begin at known bytes; each stream gets its blocks and where its frames ended."""
    pieces, lanes, at = [], [], 0
    for s, begin, end in jobs:
        pieces.append(np.frombuffer(s.data, np.uint8, end - begin, begin))
        lane = _Lane()
        lane.stream, lane.start, lane.base, lane.limit, lane.error, lane.parts = s, begin, at, (at + end - begin) * 8, None, []
        lanes.append(lane)
        at += end - begin
    data = np.concatenate(pieces)
    for lane in lanes:
        try:
            lane.n, lane.width, head = _frame_header(lane.stream.data, lane.start, lane.stream.bits)
            lane.cursor = (lane.base + head) * 8
            _open(lane, data)
        except (BadStream, IndexError, OverflowError) as e:
            lane.error, lane.parts = str(e) or "cut off", []
    _walk([x for x in lanes if x.error is None], data)
    good = [x for x in lanes if x.error is None]
    for x in good:
        x.size = (x.cursor + 7) // 8 - x.base
        if (x.base + x.size + 2) * 8 > x.limit:
            x.error = "a frame is cut off"
    good = [x for x in good if x.error is None]
    if good:
        begins = np.array([x.base for x in good])
        sums = crc16_many(data, begins, begins + [x.size for x in good])
        for x, crc in zip(good, sums.tolist(), strict=True):
            if crc != int.from_bytes(data[x.base + x.size : x.base + x.size + 2].tobytes(), "big"):
                x.error = "a frame's CRC-16 is wrong"
            else:
                x.stream.blocks.append((x.start, x.start + x.size + 2, _predict(x)))
    for x in lanes:
        if x.error is not None and x.stream.error is None:
            x.stream.error = x.error


def read(streams: list[bytes]) -> list[tuple[bool, str | None, list[tuple[int, np.ndarray]]]]:
    """ok, error and blocks (first sample, samples) of each stream."""
    opened = [_Stream(d) for d in streams]
    jobs = [(s, a, b) for s in opened if s.error is None for a, b in s.frames]
    while jobs:
        _decode_together(jobs)
        # Without a seek table a frame's end is known only now; go on behind it.
        jobs = [(s, s.blocks[-1][1], len(s.data)) for s in {id(j[0]): j[0] for j in jobs}.values() if s.walk and s.error is None and s.blocks[-1][1] < len(s.data)]
    out = []
    for s in opened:
        blocks, at = [], 0
        for _, _, x in sorted(s.blocks, key=lambda b: b[0]):
            blocks.append((at, x))
            at += len(x)
        if s.error is None:
            pcm = np.concatenate([x for _, x in blocks]) if blocks else np.zeros(0, np.int64)
            raw = pcm.astype(np.int8 if s.bits <= 8 else "<i2").tobytes()
            if at != s.total:
                s.error = "the number of samples is wrong"
            elif any(s.md5) and hashlib.md5(raw).digest() != s.md5:
                s.error = "the MD5 of the samples is wrong"
        out.append((s.error is None, s.error, blocks if s.error is None else []))
    return out


def _batches(sizes: list[int], together: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and (to == at or size < together):
            size += sizes[to]
            to += 1
        yield at, to
        at = to


_BLOCKS = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())]))


def store(docs: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """Store binary payloads as FLAC streams and read the stored bytes back.

    Returns id_col, media (the stream), ok, error, blocks (array of first_sample, n_samples, pcm: the payload's bytes).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _batches(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), TOGETHER):
                media = write([x or b"" for x in batch.column(1).slice(a, b - a).to_pylist()])
                found = read(media)
                blocks = [[{"first_sample": at, "n_samples": len(x), "pcm": (x + 128).astype(np.uint8).tobytes()} for at, x in f[2]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(media, pa.binary()), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.string()), pa.array(blocks, _BLOCKS)],
                    [id_col, "media", "ok", "error", "blocks"],
                )

    schema = f"{id_col} {kind}, media binary, ok boolean, error string, blocks array<struct<first_sample: long, n_samples: long, pcm: binary>>"
    return docs.select(id_col, payload_col).mapInArrow(run, schema)


def read_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decode stored streams: id_col, ok, error, first_sample, n_samples, samples (array<int>), a row for each block.

    A stream without blocks (empty or broken) is one row with null block columns.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _batches(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), TOGETHER):
                ids = batch.column(0).slice(a, b - a).to_pylist()
                rows = [(i, ok, error, at, None if x is None else len(x), None if x is None else x.tolist()) for i, (ok, error, blocks) in zip(ids, read([x or b"" for x in batch.column(1).slice(a, b - a).to_pylist()]), strict=True) for at, x in blocks or [(None, None)]]
                types = [batch.schema.field(0).type, pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [id_col, "ok", "error", "first_sample", "n_samples", "samples"])

    return media.select(id_col, media_col).mapInArrow(run, f"{id_col} {kind}, ok boolean, error string, first_sample long, n_samples long, samples array<int>")


def text_payload(text_col: str = "text"):
    """UTF-8 bytes and zeros up to a positive multiple of 64."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n = F.length(raw)
    padded = F.greatest(F.lit(64), F.ceil(n / 64).cast("int") * 64)
    return raw, n, F.concat(raw, F.unhex(F.repeat(F.lit("00"), padded - n)))


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a stream and describe what was read back."""
    _, n, payload = text_payload()
    stored = store(docs.select(F.struct("doc_id", n.cast("long").alias("n_bytes")).alias("doc"), payload.alias("payload")), "doc")
    pcm = F.unhex(F.array_join(F.transform("blocks", lambda b: F.hex(b["pcm"])), ""))
    rows = stored.select("doc", "media", "ok", F.size("blocks").alias("frames"), pcm.alias("pcm"))
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"),
        F.col("doc.n_bytes").alias("n_bytes"),
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("ratio="), F.format_number(F.length("media") / F.length("pcm"), 4)), F.concat(F.lit("crc="), F.crc32("pcm"))).alias("feature"),
        F.col("ok").alias("verified"),
    )
