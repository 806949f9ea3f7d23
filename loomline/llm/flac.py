"""FLAC for byte payloads: frames coded and decoded many at a time.

A payload is one channel of 8-bit samples (byte minus 128). Frames are independent, so
both directions work on a few thousand frames in step: sample t of every frame at once,
in numpy. Predictors: constant, verbatim, fixed orders 0 to 4, and LPC of any order up
to 32; residuals: Rice partitions with escape codes. Every frame header's CRC-8 and
frame's CRC-16 is verified, and the MD5 of STREAMINFO over the decoded samples.

A seek table lists every frame, so that any sample range decodes without what precedes
it. ``decode_stream`` also takes streams without one (it then walks frame by frame), and
those of other encoders with several channels or up to 24 bits.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 512
#: Frames that are in step at once; bounds memory whatever the payload's length.
LANES = 2048
LPC_ORDER, LPC_PRECISION = 4, 10
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
# Block sizes by their code in a frame header.
BLOCK_CODES = {1: 192, **{n: 576 << (n - 2) for n in range(2, 6)}, **{n: 256 << (n - 8) for n in range(8, 16)}}
# Bits of a sample by their code.
SIZE_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
ESCAPE = {0: 15, 1: 31}


class FlacError(ValueError):
    """A stream that is damaged or not FLAC."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    t = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        t = np.where(t & top, (t << 1) ^ poly, t << 1) & mask
    return t


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_at_distance = CRC16.astype(np.uint16)[None, :]


def _distance_table(n: int) -> np.ndarray:
    """Row d: what each byte value adds to a CRC-16 when d bytes follow it."""
    global _at_distance
    if len(_at_distance) < n:
        rows = np.empty((max(n, 2 * len(_at_distance)), 256), np.uint16)
        rows[: len(_at_distance)] = _at_distance
        for d in range(len(_at_distance), len(rows)):
            last = rows[d - 1].astype(np.int64)
            rows[d] = ((last << 8) & 0xFFFF) ^ CRC16[last >> 8]
        _at_distance = rows
    return _at_distance


def crc16_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each slice; slices lie end to end in order."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    if lengths.max() > 1 << 16:
        return np.array([_crc16_slow(data[a : a + n]) for a, n in zip(starts, lengths, strict=True)], np.uint16)
    table = _distance_table(int(lengths.max()))
    first, total = starts[0], int(lengths.sum())
    ends = np.repeat(starts + lengths - 1, lengths)
    distance = ends - np.arange(first, first + total)
    return np.bitwise_xor.reduceat(table[distance, data[first : first + total]], starts - first)


def _crc16_slow(data) -> int:
    c = 0
    for b in bytes(data):
        c = ((c << 8) & 0xFFFF) ^ int(CRC16[(c >> 8) ^ b])
    return c


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def _coded_number(v: int) -> bytes:
    """A frame number in FLAC's extension of UTF-8, up to 36 bits."""
    if v < 0x80:
        return bytes([v])
    n = next(n for n in range(2, 8) if v < 1 << (5 * n + 1))
    tail = [0x80 | (v >> (6 * i)) & 0x3F for i in range(n - 1)][::-1]
    return bytes([(0xFF00 >> n) & 0xFF | v >> (6 * (n - 1)), *tail])


def _header(number: int, size: int) -> bytes:
    code = next((c for c, n in BLOCK_CODES.items() if n == size), 6 if size <= 256 else 7)
    tail = b"" if code not in (6, 7) else (size - 1).to_bytes(code - 5, "big")
    head = bytes([0xFF, 0xF8, code << 4, 1 << 1]) + _coded_number(number) + tail
    return head + bytes([_crc8(head)])


# ---------------------------------------------------------------- encoding


def _lpc_coefficients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised LPC coefficients (frames x order) and their shifts, by Levinson's recursion."""
    f, n = x.shape
    w = x * np.hanning(n + 2)[1:-1].astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", w[:, : n - k], w[:, k:]) for k in range(LPC_ORDER + 1)], 1).astype(np.float64)
    err = np.maximum(r[:, 0] * (1 + 1e-9), 1e-9)
    a = np.zeros((f, LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    peak = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_PRECISION - 2 - np.floor(np.log2(peak)).astype(np.int64), 0, 15)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _predicted(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = coefs.shape[1]
    coefs, shift = coefs.astype(np.int32), shift.astype(np.int32)
    total = coefs[:, :1] * x[:, order - 1 : -1]
    for j in range(1, order):
        total += coefs[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    return total >> shift[:, None]


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


class _Bits:
    """Bits of many frames, each from its own byte-aligned place."""

    def __init__(self, starts: np.ndarray, total: int):
        self.bits, self.at = np.zeros(total, np.uint8), starts.copy()

    def put(self, rows: np.ndarray, values, width: int) -> None:
        at, values = self.at[rows], np.broadcast_to(np.asarray(values, np.int64), rows.shape)
        for b in range(width):
            self.bits[at + b] = (values >> (width - 1 - b)) & 1
        self.at[rows] += width


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of equal size (a row of x each, samples -128..127) as FLAC frames."""
    f, n = x.shape
    rows = np.arange(f)
    constant = (x == x[:, :1]).all(1)
    best_cost = np.full(f, np.inf)
    order = np.zeros(f, np.int64)
    kind = np.zeros(f, np.int64)  # 0 fixed, 1 lpc
    residual = np.zeros((f, n), np.int32)
    d = x
    for o in range(min(5, n)):
        cost = np.abs(d).sum(1) + 8 * o
        take = cost < best_cost
        best_cost[take], order[take] = cost[take], o
        if take.any():
            residual[take, o:] = d[take]
        d = d[:, 1:] - d[:, :-1]
    coefs, shift = np.zeros((f, LPC_ORDER), np.int64), np.zeros(f, np.int64)
    if n >= 64:
        coefs, shift = _lpc_coefficients(x)
        d = x[:, LPC_ORDER:] - _predicted(x, coefs, shift)
        cost = np.abs(d).sum(1) + 8 * LPC_ORDER + 5 * LPC_ORDER
        take = cost < best_cost
        kind[take], order[take] = 1, LPC_ORDER
        residual[take, LPC_ORDER:] = d[take]
    parts = 4 if n % 4 == 0 and n // 4 > 8 else 1
    part_order, size = parts.bit_length() - 1, n // parts
    live = np.arange(n)[None, :] >= order[:, None]
    u = _zigzag(residual)
    u[:, :LPC_ORDER] *= live[:, :LPC_ORDER]
    u = np.minimum(u, 32767).astype(np.int16)
    count = live.reshape(f, parts, size).sum(2)
    folded = u.reshape(f, parts, size)
    # Residuals of 8-bit samples that beat verbatim coding need no larger parameter.
    bits_k = np.stack([(folded >> k).sum(2, dtype=np.int32) + count * (k + 1) for k in range(9)], 0)
    k_part = bits_k.argmin(0)
    head_bits = np.where(kind == 1, 9 + LPC_PRECISION * LPC_ORDER, 0) + 8 * order
    body = 8 + head_bits + 6 + 4 * parts + np.take_along_axis(bits_k, k_part[None], 0)[0].sum(1)
    verbatim = ~constant & (body >= 8 + 8 * n)
    coded = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))
    heads = [_header(int(i), n) for i in numbers]
    head_len = np.array([len(h) for h in heads])
    length = head_len + (body + 7) // 8
    offset = np.concatenate([[0], np.cumsum(length + 2)])
    out = _Bits((offset[:-1] + head_len) * 8, int(offset[-1]) * 8)

    type_code = np.where(constant, 0, np.where(verbatim, 1, np.where(kind == 1, 0x20 | (order - 1), 8 | order)))
    out.put(rows, type_code << 1, 8)
    out.put(rows[constant], x[constant, 0] & 0xFF, 8)
    for t in range(n) if verbatim.any() else ():
        out.put(rows[verbatim], x[verbatim, t] & 0xFF, 8)
    for t in range(int(order[coded].max()) if coded.any() else 0):
        warm = rows[coded & (order > t)]
        out.put(warm, x[warm, t] & 0xFF, 8)
    lpc = rows[coded & (kind == 1)]
    out.put(lpc, LPC_PRECISION - 1, 4)
    out.put(lpc, shift[lpc], 5)
    for j in range(LPC_ORDER):
        out.put(lpc, coefs[lpc, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
    those = rows[coded]
    out.put(those, 0, 2)
    out.put(those, part_order, 4)
    for p in range(parts):
        k = k_part[those, p]
        out.put(those, k, 4)
        mine = folded[those, p]
        for kk in np.unique(k):
            same = np.flatnonzero(k == kk)
            value = mine[same].astype(np.int32)
            width = (value >> kk) + (1 + kk)
            if p == 0:  # warm-up samples have no code
                width[:, :LPC_ORDER] *= live[those[same], :LPC_ORDER]
            ends = np.cumsum(width, 1)
            stop = out.at[those[same]][:, None] + (ends - (kk + 1))
            if p == 0:
                coded_here = width > 0
                stop, value = stop[coded_here], value[coded_here]
            out.bits[stop] = 1
            for b in range(kk):
                stop += 1
                out.bits[stop] = (value >> (kk - 1 - b)) & 1
            out.at[those[same]] += ends[:, -1]
    data = np.packbits(out.bits)
    for h, a in zip(heads, offset, strict=False):
        data[a : a + len(h)] = np.frombuffer(h, np.uint8)
    # A frame's CRC over the frame without its own two bytes, which are zero so far:
    # two zero bytes more shift the CRC; so it is taken over the exact length.
    crc = _frame_crcs(data, offset[:-1], length)
    data[offset[:-1] + length], data[offset[:-1] + length + 1] = crc >> 8, crc & 0xFF
    blob = data.tobytes()
    return [blob[a:b] for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)]


def _frame_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of slices that have gaps of two bytes between them."""
    keep = np.ones(int(starts[-1] + lengths[-1]) if len(starts) else 0, bool)
    gaps = (starts + lengths)[:-1]
    keep[gaps] = keep[gaps + 1] = False
    packed = data[: len(keep)][keep]
    return crc16_of(packed, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths)


def encode_many(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """Each payload as a FLAC stream with STREAMINFO and a seek table of every frame."""
    where, flat = [], np.frombuffer(b"".join(payloads), np.uint8)
    base = 0
    for i, p in enumerate(payloads):
        where += [(i, no, base + a, min(block, len(p) - a)) for no, a in enumerate(range(0, len(p), block))]
        base += len(p)
    frames: list[bytes] = [b""] * len(where)
    sizes = np.array([w[3] for w in where], np.int64)
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        for a in range(0, len(mine), LANES):
            part = mine[a : a + LANES]
            at = np.array([where[j][2] for j in part])
            x = flat[at[:, None] + np.arange(size)].astype(np.int32) - 128
            for j, blob in zip(part, encode_frames(x, np.array([where[j][1] for j in part])), strict=True):
                frames[j] = blob
    out, j = [], 0
    for p in payloads:
        n = -(-len(p) // block)
        out.append(_stream(p, frames[j : j + n], block))
        j += n
    return out


def _stream(payload: bytes, frames: list[bytes], block: int) -> bytes:
    samples = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    sizes = [len(f) for f in frames] or [0]
    packed = 44100 << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += packed.to_bytes(8, "big") + hashlib.md5(samples).digest()
    points, offset = [], 0
    for i, f in enumerate(frames):
        points.append(struct.pack(">QQH", i * block, offset, min(block, len(payload) - i * block)))
        offset += len(f)
    table = b"".join(points)
    head = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info
    # A metadata block holds 2^24 - 1 bytes; longer tables go on in further blocks.
    room = (1 << 24) // 18 * 18 - 18
    pieces = [table[a : a + room] for a in range(0, len(table), room)] or [b""]
    for i, piece in enumerate(pieces):
        head += bytes([3 | (0x80 if i == len(pieces) - 1 else 0)]) + len(piece).to_bytes(3, "big") + piece
    return head + b"".join(frames)


# ---------------------------------------------------------------- decoding


def parse_metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """STREAMINFO, seek points (sample, byte offset from the first frame, samples), and where frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("no fLaC mark")
    at, info, points, last = 4, {}, [], False
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata is cut off")
        kind, size = stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body, at = bool(stream[at] & 0x80), stream[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"min_block": int.from_bytes(body[:2], "big"), "max_block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points += [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
    if not info:
        raise FlacError("no STREAMINFO")
    return info, points, at


_LEADING = np.full(1 << 16, 16, np.int64)
for _b in range(16):
    _LEADING[1 << _b : 2 << _b] = 15 - _b


def _windows(data: np.ndarray) -> np.ndarray:
    """At each byte, the 64 bits from there."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    n = len(data) + 8
    w = np.zeros(n, np.uint64)
    for j in range(8):
        w |= padded[j : j + n] << np.uint64(56 - 8 * j)
    return w


def _take(w: np.ndarray, at: np.ndarray, width) -> np.ndarray:
    """Unsigned values of up to 56 bits at bit positions."""
    x = w[at >> 3] << (at & 7).astype(np.uint64)
    return ((x >> np.uint64(1)) >> (np.uint64(63) - np.asarray(width, np.uint64))).astype(np.int64)


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = 8) -> list[np.ndarray]:
    """Samples of each one-channel frame; frames lie in data in order, end to end. Verifies both CRCs."""
    f = len(starts)
    if not f:
        return []
    if (ends - starts < 6).any():
        raise FlacError("a frame is too short")
    # Headers, in step.
    if ((data[starts] != 0xFF) | (data[starts + 1] & 0xFE != 0xF8)).any():
        raise FlacError("no frame sync")
    code = (data[starts + 2] >> 4).astype(np.int64)
    lead = data[starts + 4].astype(np.int64)
    extra = np.maximum(_LEADING[(~lead & 0xFF) << 8] - 1, 0)
    tail = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    head = 4 + 1 + extra + tail
    crc = np.zeros(f, np.int64)
    for i in range(int(head.max())):
        on = head > i
        crc[on] = CRC8[crc[on] ^ data[starts[on] + i]]
    if (crc != data[starts + head]).any():
        raise FlacError("a frame header fails its CRC-8")
    sums = crc16_of(data, starts, ends - starts)
    if sums.any():  # a frame followed by its own CRC-16 has the CRC 0
        raise FlacError("a frame fails its CRC-16")
    size = np.zeros(f, np.int64)
    for c, n in BLOCK_CODES.items():
        size[code == c] = n
    at_tail = starts + 5 + extra
    size[code == 6] = data[at_tail[code == 6]].astype(np.int64) + 1
    wide = at_tail[code == 7]
    size[code == 7] = (data[wide].astype(np.int64) << 8 | data[np.minimum(wide + 1, len(data) - 1)]) + 1
    pos = (starts + head + 1) * 8
    w = _windows(data)
    kind = _take(w, pos, 8)
    wasted, kind = kind & 1, kind >> 1 & 63
    pos = pos + 8
    order = np.where(kind >= 32, (kind & 31) + 1, np.where(kind >= 8, kind - 8, 0))
    odd = (wasted > 0) | ((kind > 1) & (kind < 8)) | ((kind > 12) & (kind < 32))
    coded = (kind >= 8) & ~odd
    out: list[np.ndarray | None] = [None] * f
    for i in np.flatnonzero(~odd & (kind == 0)):
        out[i] = np.full(size[i], _signed(_take(w, pos[i : i + 1], bits), bits)[0])
    for i in np.flatnonzero(~odd & (kind == 1)):
        out[i] = _signed(_take(w, pos[i] + bits * np.arange(size[i]), bits), bits)
    lanes = np.flatnonzero(coded)
    lanes = lanes[np.argsort(-size[lanes], kind="stable")]
    if len(lanes):
        left = _decode_lanes(w, pos[lanes], size[lanes], kind[lanes], order[lanes], bits, lanes, out)
        odd[left] = True
    for i in np.flatnonzero(odd):
        reader = _Reader(data[starts[i] : ends[i]].tobytes(), int(head[i] + 1) * 8)
        out[i] = np.array(_subframe(reader, int(size[i]), bits), np.int64)
    return out


def _signed(v: np.ndarray, bits: int) -> np.ndarray:
    return v - ((v >> (bits - 1)) << bits)


def _decode_lanes(w, pos, size, kind, order, bits, names, out) -> list[int]:
    """Predicted subframes in step, longest first. Returns the frames left to the scalar decoder."""
    f, n = len(pos), int(size.max())
    # 8-bit samples and their residuals fit 32 bits with room for any 15-bit predictor.
    kept = np.int32 if bits == 8 else np.int64
    samples = np.zeros((n, f), kept)
    top = int(order.max())
    for t in range(top):
        on = order > t
        samples[t, on] = _signed(_take(w, pos[on], bits), bits)
        pos = pos + bits * on
    coefs, shift = np.zeros((top, f), kept), np.zeros(f, np.int64)
    for o, values in FIXED.items():
        for j, v in enumerate(values):
            coefs[j, kind == 8 + o] = v
    lpc = kind >= 32
    precision = np.where(lpc, _take(w, pos, 4) + 1, 0)
    pos = pos + 4 * lpc
    shift = np.where(lpc, _take(w, pos, 5), 0)
    pos = pos + 5 * lpc
    for j in range(top):
        on = lpc & (order > j)
        v = _take(w, pos[on], precision[on])
        coefs[j, on] = v - ((v >> (precision[on] - 1)) << precision[on])
        pos = pos + precision * on
    method, part_order = _take(w, pos, 2), _take(w, pos + 2, 4)
    pos = pos + 6
    part = size >> part_order
    left = (method > 1) | (part <= order) | (part << part_order != size) | (shift > 15) | (precision > 15)
    k = np.zeros(f, np.int64)
    k_width = np.where(method == 1, 5, 4)
    turns = {0} | {int(t) for t in np.unique(order)}
    for p in np.unique(part):
        turns |= set(range(0, n, max(1, int(p))))
    # How many lanes still have a sample t: lanes stand longest first.
    active = np.searchsorted(-size, -np.arange(n), side="left")
    residual = np.zeros((n, f), kept)
    for t in range(n):
        a = int(active[t])
        if t in turns:
            turn = np.flatnonzero((t == order[:a]) | ((t > order[:a]) & (t % part[:a] == 0)))
            k[turn] = _take(w, pos[turn], k_width[turn])
            pos[turn] += k_width[turn]
            left[turn] |= k[turn] == np.where(method[turn] == 1, 31, 15)
        p, kk = pos[:a], k[:a].astype(np.uint64)
        p = np.minimum(p, (len(w) - 1) * 8)
        x = w[p >> 3] << (p & 7).astype(np.uint64)
        q = _LEADING[x >> np.uint64(48)]
        far = np.flatnonzero(q == 16)
        if len(far):
            q[far] = _unary(w, p[far])
            x[far] = w[np.minimum(p[far] + q[far], (len(w) - 1) * 8) >> 3] << ((p[far] + q[far]) & 7).astype(np.uint64)
            rest = x << (q + 1).astype(np.uint64)
            rest[far] = x[far] << np.uint64(1)
        else:
            rest = x << (q + 1).astype(np.uint64)
        low = ((rest >> np.uint64(1)) >> (np.uint64(63) - kk)).astype(np.int64)
        u = (q << k[:a]) | low
        step = q + 1 + k[:a]
        if t < top:
            on = order[:a] <= t
            residual[t, :a] = np.where(on, (u >> 1) ^ -(u & 1), 0)
            pos[:a] += np.where(on, step, 0)
        else:
            residual[t, :a] = (u >> 1) ^ -(u & 1)
            pos[:a] += step
    for o in np.unique(order):
        those = np.flatnonzero(order == o)
        if o == 0:
            samples[:, those] = residual[:, those]
            continue
        s, r = np.ascontiguousarray(samples[:, those]), residual[:, those]
        c, sh = coefs[:o, those], shift[those].astype(kept)
        for t in range(int(o), n):
            total = c[0] * s[t - 1]
            for j in range(1, int(o)):
                total += c[j] * s[t - 1 - j]
            s[t] = r[t] + (total >> sh)
        samples[:, those] = s
    flat = np.ascontiguousarray(samples.T)
    for i, name in enumerate(names):
        if not left[i]:
            out[name] = flat[i, : size[i]]
    return [int(names[i]) for i in np.flatnonzero(left)]


def _unary(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Zeros before the next one, however many."""
    q = np.zeros(len(at), np.int64)
    on = np.arange(len(at))
    end = (len(w) - 1) * 8
    while len(on):
        p = np.minimum(at[on] + q[on], end)
        lead = _LEADING[(w[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(48)]
        q[on] += lead
        if ((lead == 16) & (p >= end)).any():
            raise FlacError("a residual runs past the frame")
        on = on[lead == 16]
    return q


class _Reader:
    """Bits of one frame, for what the lanes leave: escapes, wasted bits, other channels."""

    def __init__(self, data: bytes, at: int = 0):
        self.value, self.n, self.at = int.from_bytes(data, "big"), len(data) * 8, at

    def take(self, width: int) -> int:
        self.at += width
        if self.at > self.n:
            raise FlacError("a frame is cut off")
        return self.value >> (self.n - self.at) & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        v = self.take(width)
        return v - (v >> (width - 1) << width) if width else 0

    def unary(self) -> int:
        q = 0
        while not self.take(1):
            q += 1
        return q


def _subframe(r: _Reader, n: int, bits: int) -> list[int]:
    r.take(1)
    kind, wasted = r.take(6), 0
    if r.take(1):
        wasted = r.unary() + 1
        bits -= wasted
    if kind == 0:
        s = [r.signed(bits)] * n
    elif kind == 1:
        s = [r.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else (kind & 31) + 1
        s = [r.signed(bits) for _ in range(order)]
        coefs, shift = FIXED.get(order, ()), 0
        if kind >= 32:
            precision, shift = r.take(4) + 1, r.signed(5)
            coefs = [r.signed(precision) for _ in range(order)]
        method, part_order = r.take(2), r.take(4)
        if method > 1:
            raise FlacError("unknown residual coding")
        for p in range(1 << part_order):
            k = r.take(5 if method else 4)
            raw = r.take(5) if k == ESCAPE[method] else None
            for _ in range((n >> part_order) - (order if p == 0 else 0)):
                if raw is None:
                    u = r.unary() << k | r.take(k)
                    e = u >> 1 ^ -(u & 1)
                else:
                    e = r.signed(raw)
                s.append(e + (sum(c * v for c, v in zip(coefs, s[: -order - 1 : -1], strict=True)) >> shift if order else 0))
    else:
        raise FlacError("reserved subframe type")
    return [v << wasted for v in s]


def walk_frames(stream: bytes, at: int, info: dict) -> list[list[list[int]]]:
    """Channels of each frame, one frame after the other, for any stream."""
    out = []
    while at < len(stream):
        if at + 6 > len(stream) or stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8:
            raise FlacError("no frame sync")
        code, rate, channel, size_code = stream[at + 2] >> 4, stream[at + 2] & 15, stream[at + 3] >> 4, stream[at + 3] >> 1 & 7
        p, lead = at + 5, stream[at + 4]
        while lead & 0xC0 >= 0xC0 and lead & 0x80:
            lead, p = lead << 1 & 0xFF, p + 1
        if code in (6, 7):
            n, p = int.from_bytes(stream[p : p + code - 5], "big") + 1, p + code - 5
        else:
            n = BLOCK_CODES[code]
        p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if _crc8(stream[at:p]) != stream[p]:
            raise FlacError("a frame header fails its CRC-8")
        bits = SIZE_CODES.get(size_code, info["bits"])
        # The reader's number grows with its bytes, so it gets no more than a frame can take.
        bound = p + 1 + (n * (bits + 1) // 8 + 64) * (channel + 1 if channel < 8 else 2) * 2
        r = _Reader(stream[p + 1 : bound])
        count = channel + 1 if channel < 8 else 2
        side = {8: 1, 9: 0, 10: 1}.get(channel)
        chans = [_subframe(r, n, bits + (c == side)) for c in range(count)]
        if channel == 8:
            chans[1] = [a - b for a, b in zip(*chans, strict=True)]
        elif channel == 9:
            chans[0] = [a + b for a, b in zip(*chans, strict=True)]
        elif channel == 10:
            mids = [m << 1 | s & 1 for m, s in zip(*chans, strict=True)]
            chans = [[m + s >> 1 for m, s in zip(mids, chans[1], strict=True)], [m - s >> 1 for m, s in zip(mids, chans[1], strict=True)]]
        end = p + 1 + (r.at + 7) // 8
        if _crc16_slow(stream[at:end]) != int.from_bytes(stream[end : end + 2], "big"):
            raise FlacError("a frame fails its CRC-16")
        out.append(chans)
        at = end + 2
    return out


def decode_stream(stream: bytes) -> tuple[dict, list[tuple[int, np.ndarray]]]:
    """STREAMINFO and PCM blocks as (first sample, samples x channels); verifies the MD5 where given."""
    info, _, at = parse_metadata(stream)
    blocks, first, digest = [], 0, hashlib.md5()
    width = (info["bits"] + 7) // 8
    for chans in walk_frames(stream, at, info):
        pcm = np.array(chans, np.int64).T
        blocks.append((first, pcm))
        first += len(pcm)
        digest.update(np.ascontiguousarray(pcm).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    if info["md5"] != bytes(16) and digest.digest() != info["md5"]:
        raise FlacError("the decoded samples fail the MD5")
    return info, blocks


def decode_many(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """PCM blocks (first sample, samples) of one-channel streams whose seek tables list all frames."""
    parsed, spans = [], []
    for i, stream in enumerate(streams):
        info, points, at = parse_metadata(stream)
        if info["channels"] != 1 or sum(p[2] for p in points) != info["samples"]:
            raise FlacError("not one channel with a seek point for every frame")
        stops = [at + p[1] for p in points[1:]] + [len(stream)]
        spans += [(i, p[0], at + p[1], b, p[2], info["bits"]) for p, b in zip(points, stops, strict=True)]
        parsed.append(info)
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    for a in range(0, len(spans), LANES):
        part = spans[a : a + LANES]
        lengths = np.array([s[3] - s[2] for s in part], np.int64)
        data = np.frombuffer(b"".join(streams[s[0]][s[2] : s[3]] for s in part), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        if len({s[5] for s in part}) != 1:
            raise FlacError("streams of several sample sizes in one call")
        for s, pcm in zip(part, decode_frames(data, starts, starts + lengths, part[0][5]), strict=True):
            if len(pcm) != s[4]:
                raise FlacError("a frame's size is not the seek table's")
            out[s[0]].append((s[1], pcm))
    for info, blocks in zip(parsed, out, strict=True):
        digest = hashlib.md5()
        for _, pcm in blocks:
            digest.update(pcm.astype(np.int8).tobytes() if info["bits"] == 8 else pcm.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : (info["bits"] + 7) // 8].tobytes())
        if info["md5"] != bytes(16) and digest.digest() != info["md5"]:
            raise FlacError("the decoded samples fail the MD5")
    return out
