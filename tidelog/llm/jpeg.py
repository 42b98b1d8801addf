"""Progressive JPEG in numpy: an encoder of coefficient blocks and a decoder of many files at once.

The decoder takes any 8-bit Huffman-coded progressive file with one or three components. Each restart interval of each file is a lane, and
lanes with the same scan parameters advance together, a symbol of each at a time. Spectral-selection and successive-approximation scans
accumulate in coefficient arrays, which are then dequantised, inverse-transformed, upsampled and turned into RGB.
"""

from __future__ import annotations

import functools
import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Natural place of each coefficient in zigzag order: diagonals of rising row + column, alternately upwards and downwards.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
#: Bits of the fixed-point inverse transform; sums stay below 2**53, so double-precision products are exact in any order.
SCALE = 13
_T = np.round(np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * (1 << SCALE))
_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")

# ---------------------------------------------------------------- Huffman tables


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(the 16 counts and the symbols as a file has them, symbol -> (code, length))."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in order:
        n = lengths[s]
        code <<= n - last
        codes[s], last = (code, n), n
        code += 1
        counts[n - 1] += 1
    return bytes(counts) + bytes(order), codes


@functools.lru_cache(64)
def lookup(table: bytes) -> np.ndarray:
    """length * 256 + symbol for every 16 bits that may come next; 0 where no code fits."""
    out, at, code = np.zeros(1 << 16, np.uint16), 16, 0
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


# Short codes for what text makes: runs of no zeros and six or seven bits.
DC_TABLE, DC_CODES = canonical({s: 4 for s in range(12)})
AC_TABLE, AC_CODES = canonical({0x07: 1, 0x06: 2, 0x00: 4, 0x08: 4, 0x05: 5} | {s: 12 for r in range(16) for s in range(16 * r, 16 * r + 11) if s not in (0x07, 0x06, 0x00, 0x08, 0x05) and (s & 15 or r in (0, 15))})
FINE_TABLE, FINE_CODES = canonical({0x00: 2, 0x01: 2} | {16 * r + 1: 5 for r in range(1, 16)})
#: Bands of the scans: the first is sent without its lowest bit and refined later.
LOW, HIGH = (1, 5), (6, 63)


def _code_arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], size[s] = c, n
    return code, size


_DC, _AC, _FINE = map(_code_arrays, (DC_CODES, AC_CODES, FINE_CODES))
_SIZE = np.array([abs(v).bit_length() for v in range(-2048, 2048)], np.int64)

# ---------------------------------------------------------------- bits


def _pack(values: np.ndarray, sizes: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each owner's values (up to 24 bits each, in order) as bytes, the last padded with ones; and the bytes of each."""
    bits = np.bincount(owner, weights=sizes, minlength=owners).astype(np.int64)
    room = (bits + 7) >> 3
    start = (np.cumsum(room) - room) * 8
    ends = np.cumsum(sizes)
    before = np.concatenate([[0], np.cumsum(bits)[:-1]])
    at = ends - sizes - before[owner] + start[owner]
    pad = room * 8 - bits
    values, sizes = np.concatenate([values, (1 << pad) - 1]), np.concatenate([sizes, pad])
    at = np.concatenate([at, start + bits])
    word = values << (32 - sizes - (at & 7))
    total, byte = int(room.sum()), at >> 3
    out = np.zeros(total + 4)
    for k in range(4):
        part = (word >> (24 - 8 * k)) & 255
        if k < 3:
            out += np.bincount(byte + k, weights=part, minlength=total + 4)
        elif part.any():
            out += np.bincount(byte + k, weights=part, minlength=total + 4)
    return out[:total].astype(np.uint8), room


def _intervals(body: np.ndarray, room: np.ndarray, per_file: np.ndarray) -> list[bytes]:
    """Entropy data of each file: stuffed, with a restart marker between its intervals."""
    files = len(per_file)
    first = np.cumsum(per_file) - per_file
    number = np.arange(len(room)) - np.repeat(first, per_file)
    mark = number + 1 < np.repeat(per_file, per_file)
    ff = body == 255
    stuffed = np.cumsum(ff)
    owner = np.repeat(np.arange(len(room)), room)
    marks_before = np.cumsum(mark) - mark
    at = np.arange(len(body)) + stuffed - ff + 2 * marks_before[owner]
    out = np.zeros(len(body) + int(stuffed[-1] if len(body) else 0) + 2 * int(mark.sum()), np.uint8)
    out[at] = body
    last = np.cumsum(room) - 1
    after = at[last] + 1 + ff[last]
    out[after[mark]] = 255
    out[after[mark] + 1] = 0xD0 + number[mark] % 8
    ends = (after + 2 * mark)[np.cumsum(per_file) - 1]
    cuts = np.concatenate([[0], ends]).tolist()
    raw = out.tobytes()
    return [raw[cuts[i] : cuts[i + 1]] for i in range(files)]


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _ac_first(blocks: np.ndarray, band: tuple[int, int], low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, sizes, owner) of a first AC scan with an interval for each block."""
    part = blocks[:, band[0] : band[1] + 1]
    if low:
        part = np.sign(part) * (np.abs(part) >> low)
    width = part.shape[1]
    flat = np.flatnonzero(part)
    owner, k = flat // width, flat % width
    v = part.ravel()[flat].astype(np.int64)
    lead = np.ones(len(flat), bool)
    lead[1:] = owner[1:] != owner[:-1]
    run = np.where(lead, k, k - np.concatenate([[0], k[:-1]]) - 1)
    size = _SIZE[v + 2048]
    symbol = (run & 15) << 4 | size
    code, n = _AC
    values, sizes = code[symbol] << size | _extra(v, size), n[symbol] + size
    last = np.full(len(part), -1)
    last[owner] = k
    ends = np.flatnonzero(last < width - 1)
    long = np.flatnonzero(run > 15)
    if len(ends) or len(long):
        zrl, eob = AC_CODES[0xF0], AC_CODES[0x00]
        more = np.repeat(long, run[long] >> 4)
        values = np.concatenate([values, np.full(len(more), zrl[0]), np.full(len(ends), eob[0])])
        sizes = np.concatenate([sizes, np.full(len(more), zrl[1]), np.full(len(ends), eob[1])])
        place = np.concatenate([2 * flat + 1, 2 * flat[more], 2 * (ends * width + width - 1) + 2])
        owner = np.concatenate([owner, owner[more], ends])
        order = np.lexsort((place, owner))
        values, sizes, owner = values[order], sizes[order], owner[order]
    return values, sizes, owner


def _ac_refine(blocks: np.ndarray, band: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the refinement of bit 0 in a band of up to 5 coefficients."""
    n = len(blocks)
    acc, bits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    held, held_n, run = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    code, size = _FINE
    for k in range(band[0], band[1] + 1):
        v = blocks[:, k].astype(np.int64)
        m = np.abs(v)
        old, new = m > 1, m == 1
        held = np.where(old, held << 1 | (m & 1), held)
        held_n += old
        symbol = run << 4 | 1
        add = size[symbol] + 1 + held_n
        acc = np.where(new, (acc << add) | ((code[symbol] << 1 | (v > 0)) << held_n) | held, acc)
        bits += np.where(new, add, 0)
        held, held_n = np.where(new, 0, held), np.where(new, 0, held_n)
        run = np.where(new, 0, run + (m == 0))
    tail = (run > 0) | (held_n > 0)
    c, s = FINE_CODES[0x00]
    acc = np.where(tail, ((acc << s) | c) << held_n | held, acc)
    bits += np.where(tail, s + held_n, 0)
    top = np.maximum(bits - 24, 0)
    values = np.stack([acc >> top, acc & ((1 << top) - 1)], 1).ravel()
    sizes = np.stack([bits - top, top], 1).ravel()
    return values, sizes, np.repeat(np.arange(n), 2)


# ---------------------------------------------------------------- writing

_HEAD = b"\xff\xd8\xff\xdb\x00\x43\x00" + b"\x01" * 64
_DRI = b"\xff\xdd\x00\x04\x00\x01"
_DHT = lambda kind, table: b"\xff\xc4" + struct.pack(">HB", 3 + len(table), kind) + table
_SOS = lambda comps, ss, se, a: b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(comps), len(comps)) + bytes(x for c in comps for x in (c, 0)) + bytes((ss, se, a))


def grid(mcus: int) -> tuple[int, int]:
    """(across, down) of the image that holds so many MCUs."""
    across = max(1, int(np.ceil(np.sqrt(mcus))))
    return across, max(1, -(-mcus // across))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A 4:2:0 progressive file for each payload (a positive multiple of 64 bytes): 64 bytes in a row are the signed coefficients of a block in zigzag
    order, six blocks an MCU; blocks of zeros fill the last rows. Quantisers are 1, so coefficients are stored exactly."""
    shapes = [grid(-(-len(p) // 384)) for p in payloads]
    mcus = np.array([a * d for a, d in shapes])
    body = b"".join(p + bytes(384 * int(m) - len(p)) for p, m in zip(payloads, mcus.tolist(), strict=True))
    blocks = np.frombuffer(body, np.int8).reshape(-1, 6, 64).astype(np.int16)

    dc = blocks[:, :, 0].astype(np.int64)
    high = dc >> 1
    diff = high.copy()
    diff[:, 1:4] -= high[:, 0:3]
    size = _SIZE[diff + 2048]
    owner = np.repeat(np.arange(len(blocks)), 6)
    values, sizes = (_DC[0][size] << size | _extra(diff, size)).ravel(), (_DC[1][size] + size).ravel()
    scans = [(_DHT(0x00, DC_TABLE) + _SOS((1, 2, 3), 0, 0, 0x01), _intervals(*_pack(values, sizes, owner, len(blocks)), mcus))]
    # Planes in raster order of blocks: luma has two rows and columns of blocks to an MCU.
    start, luma = np.cumsum(mcus) - mcus, []
    for (a, d), s in zip(shapes, start.tolist(), strict=True):
        luma.append((np.arange(s * 4, (s + a * d) * 4).reshape(d, a, 2, 2).transpose(0, 2, 1, 3)).ravel())
    planes = [blocks[:, :4].reshape(-1, 64)[np.concatenate(luma)], blocks[:, 4], blocks[:, 5]]
    for c, plane in enumerate(planes):
        count = mcus * (4 if c == 0 else 1)
        for band, low in ((LOW, 1), (HIGH, 0)):
            scans.append((_SOS((c + 1,), *band, low), _intervals(*_pack(*_ac_first(plane, band, low), len(plane)), count)))
    scans[1] = (_DHT(0x10, AC_TABLE) + scans[1][0], scans[1][1])
    for c, plane in enumerate(planes):
        count = mcus * (4 if c == 0 else 1)
        scans.append((_SOS((c + 1,), *LOW, 0x10), _intervals(*_pack(*_ac_refine(plane, LOW), len(plane)), count)))
    scans[7] = (_DHT(0x10, FINE_TABLE) + scans[7][0], scans[7][1])
    scans.append((_SOS((1, 2, 3), 0, 0, 0x10), _intervals(*_pack((dc & 1).ravel(), np.ones(dc.size, np.int64), owner, len(blocks)), mcus)))
    out = []
    for i, (a, d) in enumerate(shapes):
        sof = b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 16 * d, 16 * a, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
        out.append(_HEAD + sof + _DRI + b"".join(h + data[i] for h, data in scans) + b"\xff\xd9")
    return out


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    across: int = 0  # blocks that the image covers
    down: int = 0
    stride: int = 0  # blocks stored in a row
    rows: int = 0
    base: int = 0


@dataclass
class Scan:
    comps: list[int]
    tables: tuple[bytes, ...]
    ss: int
    se: int
    ah: int
    al: int
    restart: int
    data: bytes


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    comps: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    mcus: tuple[int, int] = (0, 0)


def parse(raw: bytes) -> Picture:
    pic, tables, restart, at = Picture(), {}, 0, 2
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(raw):
        while raw[at] == 255 and raw[at + 1] == 255:
            at += 1
        kind = raw[at + 1]
        if kind == 0xD9:
            return pic
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                pic.quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xC2:
            if body[0] != 8:
                raise ValueError("only 8-bit samples are read")
            pic.height, pic.width = struct.unpack(">HH", body[1:5])
            pic.comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            hmax, vmax = max(c.h for c in pic.comps), max(c.v for c in pic.comps)
            pic.mcus = (-(-pic.width // (8 * hmax)), -(-pic.height // (8 * vmax)))
            for c in pic.comps:
                c.across, c.down = -(-(-(-pic.width * c.h // hmax)) // 8), -(-(-(-pic.height * c.v // vmax)) // 8)
                c.stride, c.rows = pic.mcus[0] * c.h, pic.mcus[1] * c.v
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman-coded file")
        elif kind == 0xDA:
            n = body[0]
            ids = {c.ident: i for i, c in enumerate(pic.comps)}
            comps = [ids[body[1 + 2 * i]] for i in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            use = tuple(b"" if ss == 0 and a >> 4 else tables[0x10 * (ss > 0) + (body[2 + 2 * i] & 15 if ss else body[2 + 2 * i] >> 4)] for i in range(n))
            stop = _MARK.search(raw, at)
            stop = stop.start() if stop else len(raw)
            pic.scans.append(Scan(comps, use, ss, se, a >> 4, a & 15, restart, raw[at:stop]))
            at = stop
    raise ValueError("the file ends early")


class Lanes:
    """The restart intervals of many scans' data, unstuffed, with 64 bits to be had from any bit."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts) + bytes(2), np.uint8)
        ff = np.flatnonzero(data[:-1] == 255)
        after = data[ff + 1]
        restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(data), bool)
        keep[ff[after == 0] + 1] = False
        keep[restarts] = keep[restarts + 1] = False
        place = np.cumsum(keep) - keep
        first = np.cumsum(sizes) - sizes
        at = np.concatenate([first, restarts + 2])
        order = np.argsort(at, kind="stable")
        self.part = np.concatenate([np.arange(len(parts)), np.searchsorted(first, restarts, "right") - 1])[order]
        self.number = np.arange(len(order)) - np.searchsorted(self.part, self.part)
        self.pos = place[at[order]].astype(np.int64) * 8
        body = np.concatenate([data[keep], np.zeros(24, np.uint8)])
        n = (len(body) - 8) // 8 * 8
        self.words = np.empty(n, np.uint64)
        for o in range(8):
            self.words[o::8] = body[o : o + n].view(">u8")

    def peek(self, pos: np.ndarray) -> np.ndarray:
        return self.words[pos >> 3] << (pos & 7).astype(np.uint64)


_U = np.uint64


def _take(word: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits (0 to 16) of each word after `skip`."""
    return (((word << skip.astype(_U)) >> _U(32)) >> (32 - n).astype(_U)).astype(np.int64)


def _signed(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << n >> 1), v - (1 << n) + 1, v)


def _symbol(word: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = table[word >> _U(48)].astype(np.int64)
    if not e.all():
        raise ValueError("no such code")
    return e >> 8, e & 255


def _dc_scan(pics: list[Picture], scans: list[Scan], out: np.ndarray) -> None:
    lanes, one = Lanes([s.data for s in scans]), scans[0]
    alone = len(one.comps) == 1
    dims = np.array([(p.comps[s.comps[0]].across, p.comps[s.comps[0]].down) if alone else p.mcus for p, s in zip(pics, scans, strict=True)])
    every = dims[:, 0] * dims[:, 1]
    step = np.array([s.restart for s in scans])
    step = np.where(step > 0, step, every)
    begin = lanes.number * step[lanes.part]
    count = np.minimum(step[lanes.part], every[lanes.part] - begin)
    pos, pred = lanes.pos.copy(), np.zeros((len(one.comps), len(lanes.part)), np.int64)
    for i in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > i)
        unit = begin[live] + i
        row, col = unit // dims[lanes.part[live], 0], unit % dims[lanes.part[live], 0]
        for j, c in enumerate(one.comps):
            info = np.array([(p.comps[c].base, p.comps[c].stride) for p in pics])[lanes.part[live]]
            h, v = (1, 1) if alone else (pics[0].comps[c].h, pics[0].comps[c].v)
            for y in range(v):
                for x in range(h):
                    at = (info[:, 0] + (row * v + y) * info[:, 1] + col * h + x) * 64
                    word = lanes.peek(pos[live])
                    if one.ah:
                        out[at] |= ((word >> _U(63)).astype(np.int64) << one.al).astype(out.dtype)
                        pos[live] += 1
                    else:
                        n, s = _symbol(word, lookup(one.tables[j]))
                        pred[j, live] += _signed(_take(word, n, s), s)
                        out[at] = pred[j, live] << one.al
                        pos[live] += n + s


def _ac_lanes(pics: list[Picture], scans: list[Scan]) -> tuple[Lanes, np.ndarray, np.ndarray, object]:
    lanes = Lanes([s.data for s in scans])
    comps = [p.comps[s.comps[0]] for p, s in zip(pics, scans, strict=True)]
    across, base, stride = (np.array([getattr(c, n) for c in comps])[lanes.part] for n in ("across", "base", "stride"))
    every = np.array([c.across * c.down for c in comps])[lanes.part]
    step = np.array([s.restart for s in scans])[lanes.part]
    step = np.where(step > 0, step, every)
    begin = lanes.number * step
    count = np.minimum(step, every - begin)
    place = lambda lane, b: (base[lane] + (begin[lane] + b) // across[lane] * stride[lane] + (begin[lane] + b) % across[lane]) * 64
    return lanes, count, begin, place


def _ac_first_scan(pics: list[Picture], scans: list[Scan], out: np.ndarray) -> None:
    lanes, count, _, place = _ac_lanes(pics, scans)
    one, table = scans[0], lookup(scans[0].tables[0])
    lane = np.flatnonzero(count > 0)
    pos, block, k = lanes.pos[lane], np.zeros(len(lane), np.int64), np.full(len(lane), one.ss)
    at = place(lane, block)
    while len(lane):
        word = lanes.peek(pos)
        n, sym = _symbol(word, table)
        s, r = sym & 15, sym >> 4
        got = s > 0
        if got.all():
            k += r
            out[at + k] = _signed(_take(word, n, s), s) << one.al
            pos += n + s
            k += 1
            skip = 0
        else:
            k = np.where(got | (r == 15), k + r, k)
            v = _signed(_take(word, n, s), s) << one.al
            out[(at + k)[got]] = v[got]
            ends = ~got & (r < 15)
            skip = np.where(ends, (1 << r) + _take(word, n, np.where(ends, r, 0)), 0)
            pos += n + np.where(ends, r, s)
            k = np.where(ends, one.se, k) + 1
        if (over := k > one.se).any():
            block = block + np.where(over, np.maximum(skip, 1), 0)
            k = np.where(over, one.ss, k)
            live = block < count[lane]
            if not live.all():
                lane, pos, block, k = lane[live], pos[live], block[live], k[live]
            at = place(lane, block)


def _ac_refine_scan(pics: list[Picture], scans: list[Scan], out: np.ndarray) -> None:
    lanes, count, _, place = _ac_lanes(pics, scans)
    one, table = scans[0], lookup(scans[0].tables[0])
    lane = np.flatnonzero(count > 0)
    size = len(lane)
    pos, block, k = lanes.pos[lane], np.zeros(size, np.int64), np.full(size, one.ss)
    run, value, left, reading = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size, bool)
    bit = 1 << one.al
    while len(lane):
        ask = np.flatnonzero(reading & (left == 0))
        if len(ask):
            word = lanes.peek(pos[ask])
            n, sym = _symbol(word, table)
            s, r = sym & 15, sym >> 4
            ends = (s == 0) & (r < 15)
            more = _take(word, n, np.where(s > 0, 1, np.where(ends, r, 0)))
            left[ask] = np.where(ends, (1 << r) + more, 0)
            value[ask] = np.where(s > 0, np.where(more > 0, bit, -bit), 0)
            run[ask], reading[ask] = r, False
            pos[ask] += n + np.where(s > 0, 1, np.where(ends, r, 0))
        at = place(lane, block) + k
        old = out[at].astype(np.int64)
        known = old != 0
        b = (lanes.peek(pos) >> _U(63)).astype(np.int64)
        out[at] = np.where(known & (b > 0), old + np.where(old > 0, bit, -bit), old)
        pos += known
        closing = left > 0
        stop = ~known & ~closing & (run == 0)
        put = stop & (value != 0)
        out[at[put]] = value[put]
        run -= ~known & ~closing & (run > 0)
        reading |= stop
        k += 1
        over = k > one.se
        if over.any():
            left -= over & closing
            reading |= over
            block += over
            k[over] = one.ss
            live = block < count[lane]
            if not live.all():
                lane, pos, block, k, run, value, left, reading = (x[live] for x in (lane, pos, block, k, run, value, left, reading))


def coefficients(raws: list[bytes]) -> tuple[list[Picture], np.ndarray]:
    """(the parsed files, their accumulated coefficients: blocks x 64 in zigzag order; each component's blocks begin at its base)."""
    pics, total = [parse(r) for r in raws], 0
    for p in pics:
        for c in p.comps:
            c.base, total = total, total + c.stride * c.rows
    out = np.zeros(total * 64, np.int32)
    for turn in range(max((len(p.scans) for p in pics), default=0)):
        groups: dict[tuple, list[Picture]] = {}
        for p in pics:
            if turn < len(p.scans):
                s = p.scans[turn]
                key = (tuple(s.comps), s.tables, s.ss, s.se, s.ah, s.al, tuple((c.h, c.v) for c in p.comps))
                groups.setdefault(key, []).append(p)
        for key, own in groups.items():
            scan = _dc_scan if key[2] == 0 else _ac_refine_scan if key[4] else _ac_first_scan
            scan(own, [p.scans[turn] for p in own], out)
    return pics, out.reshape(-1, 64)


def inverse(blocks: np.ndarray) -> np.ndarray:
    """Samples (before the shift by 128) of dequantised blocks in zigzag order, blocks x 8 x 8, rounded; exact integers throughout."""
    natural = np.zeros(blocks.shape, np.float64)
    natural[:, ZIGZAG] = blocks
    half = (natural.reshape(-1, 8) @ _T).reshape(-1, 8, 8).transpose(0, 2, 1)
    full = (np.ascontiguousarray(half).reshape(-1, 8) @ _T).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.floor((full + (1 << 2 * SCALE - 1)) / (1 << 2 * SCALE))


def tensors(pics: list[Picture], blocks: np.ndarray) -> list[np.ndarray]:
    """Each file as height x width x 3 bytes of RGB; chroma is upsampled by repeating."""
    scale = np.empty((len(blocks), 64))
    for p in pics:
        for c in p.comps:
            scale[c.base : c.base + c.stride * c.rows] = p.quants[c.quant]
    samples = np.clip(inverse(blocks * scale) + 128, 0, 255).astype(np.float32)
    out = []
    for p in pics:
        hmax, vmax = max(c.h for c in p.comps), max(c.v for c in p.comps)
        planes = []
        for c in p.comps:
            plane = samples[c.base : c.base + c.stride * c.rows].reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
            if (hmax, vmax) != (c.h, c.v):
                plane = np.repeat(np.repeat(plane, vmax // c.v, 0), hmax // c.h, 1)
            planes.append(plane[: p.height, : p.width])
        y = planes[0]
        rgb = np.empty((p.height, p.width, 3), np.uint8)
        if len(planes) == 1:
            rgb[:] = y[:, :, None]
        else:
            cb, cr = planes[1] - 128, planes[2] - 128
            for k, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
                rgb[:, :, k] = np.clip(np.floor(x + np.float32(0.5)), 0, 255)
        out.append(rgb)
    return out


def payloads(pics: list[Picture], blocks: np.ndarray) -> list[bytes]:
    """What encode() stored, with the blocks of zeros that fill the last rows."""
    out = []
    for p in pics:
        a, d = p.mcus
        y, cb, cr = p.comps
        mcus = np.empty((a * d, 6, 64), np.int8)
        mcus[:, :4] = blocks[y.base : y.base + 4 * a * d].reshape(d, 2, a, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
        mcus[:, 4], mcus[:, 5] = blocks[cb.base : cb.base + a * d], blocks[cr.base : cr.base + a * d]
        out.append(mcus.tobytes())
    return out
