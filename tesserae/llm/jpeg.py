"""Progressive JPEG in NumPy, for batches of images at once.

A scan's restart intervals can be read independently, so the decoder reads those of all images of a
batch side by side: each step takes one Huffman symbol of every interval. Spectral selection and
successive approximation add up in one coefficient array; the inverse transform is exact integer
arithmetic, so equal files give equal pixels on every machine.

The encoder here stores bytes as coefficients, so that what was stored is read back exactly. Its
images are 4:2:0: 16 x 16 pixels hold four Y blocks, one Cb and one Cr block of 64 coefficients.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

# The zigzag order is built from its rule below; the Huffman code lengths are a choice of this encoder.
AC_LENGTHS = {3: [0x02, 0x03, 0x04], 4: [0x01, 0x05, 0x06, 0x00], 5: [0x07, 0x08, 0x11, 0x12]}
REST_LENGTH = 10  # of all other AC symbols
DC_LENGTH = 4  # of the DC sizes 0 to 11

#: (components, first and last coefficient, high and low bit) of each scan.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((1,), 1, 63, 0, 1),
    ((2,), 1, 63, 0, 1),
    ((0,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 63, 1, 0),
    ((1,), 1, 63, 1, 0),
    ((2,), 1, 63, 1, 0),
)
#: Blocks (MCUs where components are interleaved) in a restart interval.
INTERVAL = 4


def _zigzag() -> np.ndarray:
    """The natural place of each zigzag place."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_SIZE = np.array([int(i).bit_length() for i in range(1 << 12)], dtype=np.int64)


def ac_table() -> list[list[int]]:
    """The symbols of each code length from 1 to 16."""
    named = {s for group in AC_LENGTHS.values() for s in group}
    every = [16 * r + s for r in range(16) for s in range(11) if s or r in (0, 15)]
    rest = [s for s in every if s not in named]
    return [AC_LENGTHS.get(n, rest if n == REST_LENGTH else []) for n in range(1, 17)]


def dc_table() -> list[list[int]]:
    return [list(range(12)) if n == DC_LENGTH else [] for n in range(1, 17)]


@functools.lru_cache(64)
def _codes(table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """code and length by symbol, and (symbol << 8 | length) by the next 16 bits; table: 16 counts, then symbols."""
    code, length, look = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    now, at = 0, 16
    for n in range(1, 17):
        for s in table[at : at + table[n - 1]]:
            code[s], length[s] = now, n
            look[now << (16 - n) : (now + 1) << (16 - n)] = s << 8 | n
            now += 1
        at += table[n - 1]
        now <<= 1
    return code, length, look


def _flat(table: list[list[int]]) -> bytes:
    return bytes(len(x) for x in table) + bytes(s for x in table for s in x)


DC, AC = _flat(dc_table()), _flat(ac_table())


@functools.lru_cache(512)
def scan_rows(w: int, h: int, comps: tuple[int, ...], sampling: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Block rows (the MCU order of all components) in the order of a scan over w x h MCUs, and each one's component."""
    sizes = [a * b for a, b in sampling]
    first, total = np.concatenate(([0], np.cumsum(sizes)[:-1])), sum(sizes)
    mcu = np.arange(w * h)
    if len(comps) > 1:
        inside = np.concatenate([first[c] + np.arange(sizes[c]) for c in comps])
        comp = np.concatenate([np.full(sizes[c], c) for c in comps])
        return (mcu[:, None] * total + inside).ravel(), np.tile(comp, w * h)
    (a, b), c = sampling[comps[0]], comps[0]
    r, k = np.divmod(np.arange(w * a * h * b), w * a)
    rows = (r // b * w + k // a) * total + first[c] + r % b * a + k % a
    return rows, np.full(len(rows), c)


_YCC = ((2, 2), (1, 1), (1, 1))


# ---------------------------------------------------------------- encoder


def grid(n_blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks."""
    m = -(-n_blocks // 6)
    w = int(np.ceil(np.sqrt(m)))
    return w, -(-m // w)


class _Bits:
    """Codes laid one after the other, each restart interval from a byte of its own."""

    def __init__(self, length: np.ndarray, lane: np.ndarray, lanes: int):
        # every interval has a code, and they come in order
        total = np.add.reduceat(length, np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1]))))
        self.size = (total + 7) >> 3
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        before = np.cumsum(length) - length
        self.at = before + (8 * self.begin[:-1] - (np.cumsum(total) - total))[lane]
        self.total = total

    def bytes_of(self, bits_or_words: np.ndarray) -> np.ndarray:
        out = bits_or_words
        pad = (8 * self.size - self.total).astype(np.int64)
        last = self.begin[1:][pad > 0] - 1
        out[last] |= ((1 << pad[pad > 0]) - 1).astype(np.uint8)
        return out


def _pack(value: np.ndarray, length: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and where each interval begins; codes of at most 32 bits."""
    b = _Bits(length, lane, lanes)
    word, shift = b.at >> 5, b.at & 31
    wide = value << (64 - shift - length).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out = np.zeros(int(b.begin[-1] + 3 >> 2) + 2, dtype=np.uint64)
    out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return b.bytes_of(out.astype(">u4").view(np.uint8)[: b.begin[-1]].copy()), b.begin


def _dc_first(v, comp, lane, lanes, low):
    dc = v[:, 0].astype(np.int64) >> low
    diff = dc.copy()
    for c in np.unique(comp):
        own = np.flatnonzero(comp == c)
        same = lane[own[1:]] == lane[own[:-1]]
        diff[own[1:]] -= np.where(same, dc[own[:-1]], 0)
    size = _SIZE[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    code, length, _ = _codes(DC)
    return _pack(code[size] << size.astype(np.uint64) | extra, length[size] + size, lane, lanes)


def _ac_first(v, first, last, lane, lanes, low):
    band = v[:, first : last + 1]
    n, k = band.shape
    size_of = np.abs(band) >> low
    row, place = np.nonzero(size_of)
    at = row * k + place
    mag = size_of.ravel()[at].astype(np.int64)
    new = np.concatenate(([True], row[1:] != row[:-1])) if len(at) else np.zeros(0, dtype=bool)
    run = place - np.where(new, 0, np.concatenate(([0], place[:-1] + 1))[: len(at)])
    size = _SIZE[mag]
    extra = np.where(band.ravel()[at] < 0, (1 << size) - 1 - mag, mag).view(np.uint64)
    code, length, _ = _codes(AC)
    symbol = (run & 15) << 4 | size
    value, bits = code[symbol] << size.astype(np.uint64) | extra, length[symbol] + size
    # 16 zeros at a time come before; an end of block comes after the last one but at the band's end
    tail = np.full(n, -1)
    tail[row] = place
    ends = np.flatnonzero(tail < k - 1)
    zeros = np.flatnonzero(run >> 4)
    where = np.concatenate((np.repeat(zeros, run[zeros] >> 4), np.searchsorted(row, ends, side="right")))
    what = np.concatenate((np.full(int((run[zeros] >> 4).sum()), 0xF0), np.zeros(len(ends), dtype=np.int64)))
    whose = np.concatenate((np.repeat(row[zeros], run[zeros] >> 4), ends))
    order = np.lexsort((whose, where))
    where, what, whose = where[order], what[order], whose[order]
    row, value, bits = np.insert(row, where, whose), np.insert(value, where, code[what]), np.insert(bits, where, length[what])
    return _pack(value, bits, lane[row], lanes)


def _dc_refine(v, lane, lanes, low):
    return _pack((v[:, 0] >> low & 1).astype(np.uint64), np.ones(len(v), dtype=np.int64), lane, lanes)


def _ac_refine(v, first, last, lane, lanes, low):
    band = np.abs(v[:, first : last + 1]) >> low
    n, k = band.shape
    new, known = band == 1, band > 1
    row, place = np.nonzero(new)
    zeros = np.cumsum(band == 0, axis=1, dtype=np.int16)
    # events: each newly set coefficient, then the end of block of each row that has places left
    tail = np.full(n, -1)
    tail[row] = place
    ends = np.flatnonzero(tail < k - 1)
    at = np.concatenate((row * (k + 1) + place, ends * (k + 1) + k))
    order = np.argsort(at, kind="stable")
    at = at[order]
    e_row, e_place = at // (k + 1), at % (k + 1)
    is_end = e_place == k
    fresh = np.concatenate(([True], e_row[1:] != e_row[:-1]))
    seen = np.where(is_end, 0, zeros[e_row, np.minimum(e_place, k - 1)]).astype(np.int64)  # zeros of the row up to the event
    base = np.where(fresh, 0, np.concatenate(([0], seen[:-1])))
    run = np.where(is_end, 0, seen - base)
    long = run >> 4
    begin = np.cumsum(long + 1) - (long + 1)  # each event's first symbol: runs of 16 come before it
    symbols = np.full(int((long + 1).sum()), 0xF0)
    own = begin + long
    symbols[own] = np.where(is_end, 0, (run & 15) << 4 | 1)
    code, length, _ = _codes(AC)
    value, bits = code[symbols], length[symbols].copy()
    sign = (v[e_row, first + np.minimum(e_place, k - 1)] > 0).astype(np.uint64)
    value[own] = np.where(is_end, value[own], value[own] << np.uint64(1) | sign)
    bits[own] += ~is_end
    s_row = np.repeat(e_row, long + 1)
    # the bits of known coefficients follow the symbol under which they are passed
    c_row, c_place = np.nonzero(known)
    event = np.searchsorted(at, c_row * (k + 1) + c_place)
    passed = np.minimum((zeros[c_row, c_place] - base[event]) >> 4, long[event])
    under = begin[event] + np.where(is_end[event], 0, passed)
    after = np.concatenate(([0], np.cumsum(np.bincount(under, minlength=len(symbols)))))  # bits before each symbol
    s_len = bits + np.diff(after)  # a symbol and the bits behind it
    b = _Bits(s_len, lane[s_row], lanes)
    out = np.zeros(8 * int(b.begin[-1]), dtype=np.uint8)
    out[b.at[under] + bits[under] + np.arange(len(under)) - after[under]] = band[c_row, c_place] & 1
    for i in range(int(bits.max(initial=0))):
        use = np.flatnonzero(bits > i)
        out[b.at[use] + i] = value[use] >> (bits[use] - 1 - i).astype(np.uint64) & np.uint64(1)
    return b.bytes_of(np.packbits(out)), b.begin


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """One progressive JPEG a payload (lengths: multiples of 64), whose coefficients are its bytes less 128."""
    sizes = [len(p) // 64 for p in payloads]
    grids = [grid(n) for n in sizes]
    blocks = np.array([6 * w * h for w, h in grids])
    base = np.concatenate(([0], np.cumsum(blocks)))
    v = np.zeros((int(base[-1]), 64), dtype=np.int32)
    stored = np.repeat(base[:-1], sizes) + np.concatenate([np.arange(n) for n in sizes])
    v[stored] = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, 64).astype(np.int32) - 128
    scans = []
    for comps, first, last, high, low in SCRIPT:
        parts = [scan_rows(w, h, comps, _YCC) for w, h in grids]
        n = np.array([len(r) for r, _ in parts])
        rows = np.concatenate([r + x for (r, _), x in zip(parts, base[:-1].tolist(), strict=True)])
        step = INTERVAL * (6 if len(comps) > 1 else 1)
        lanes = -(-n // step)
        lane = np.repeat(np.concatenate(([0], np.cumsum(lanes)[:-1])), n) + (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)) // step
        total = int(lanes.sum())
        own = v[rows]
        if last == 0:
            comp = np.concatenate([c for _, c in parts])
            got = _dc_refine(own, lane, total, low) if high else _dc_first(own, comp, lane, total, low)
        else:
            got = (_ac_refine if high else _ac_first)(own, first, last, lane, total, low)
        scans.append(_stuffed(*got, lanes))
    tables = _segment(0xC4, b"\x00" + DC) + _segment(0xC4, b"\x10" + AC)
    out = []
    for i, (p, (w, h)) in enumerate(zip(payloads, grids, strict=True)):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"".join(bytes((c + 1, x << 4 | y, 0)) for c, (x, y) in enumerate(_YCC))
        parts = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(p))), _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC2, frame), tables, _segment(0xDD, struct.pack(">H", INTERVAL))]
        for (comps, first, last, high, low), (data, cut) in zip(SCRIPT, scans, strict=True):
            parts += [_segment(0xDA, bytes([len(comps)]) + b"".join(bytes((c + 1, 0)) for c in comps) + bytes((first, last, high << 4 | low))), data[cut[i] : cut[i + 1]]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def _stuffed(data: np.ndarray, begin: np.ndarray, lanes: np.ndarray) -> tuple[bytes, list[int]]:
    """The scan's bytes with zeros behind 255s and restart markers, and where each image's part begins."""
    ff = np.flatnonzero(data == 255) + 1
    first = np.cumsum(lanes) - lanes
    nth = np.arange(len(begin) - 1) - np.repeat(first, lanes)
    marks = np.flatnonzero(nth > 0)  # a marker stands before each interval but the first
    where = np.concatenate((ff, np.repeat(begin[marks], 2)))
    what = np.concatenate((np.zeros(len(ff)), np.stack((np.full(len(marks), 255), 0xD0 + (nth[marks] - 1) % 8), axis=1).ravel())).astype(np.uint8)
    order = np.argsort(where, kind="stable")
    where, what = where[order], what[order]
    out = np.insert(data, where, what)
    edges = np.concatenate((begin[first], begin[-1:]))
    return out.tobytes(), (edges + np.searchsorted(where, edges, side="right")).tolist()


# ---------------------------------------------------------------- decoder


class Image:
    """What the headers of one file say, and its scans."""

    __slots__ = ("width", "height", "sampling", "quant", "scans", "comment", "w", "h")


def read_headers(data: bytes, at: int, stop: int, ends: np.ndarray) -> Image:
    """Walk the segments of the file at data[at:stop]; ends: places of all markers that can end a scan."""
    out = Image()
    out.scans, out.comment = [], b""
    quant, tables, interval = {}, {}, 0
    if stop - at < 4 or data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at += 2
    while True:
        if at + 2 > stop:
            raise ValueError("the file ends before its end marker")
        marker = data[at + 1]
        if marker == 0xD9:
            return out
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                tables[body[0]] = body[1:size]
                body = body[size:]
        elif marker == 0xC2:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            comps = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            ids = [c[0] for c in comps]
            out.sampling = tuple((c[1] >> 4, c[1] & 15) for c in comps)
            out.quant = [c[2] for c in comps]
            out.w = -(-out.width // (8 * max(a for a, _ in out.sampling)))
            out.h = -(-out.height // (8 * max(b for _, b in out.sampling)))
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive file")
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            n = body[0]
            chosen = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            use = tuple((tables.get(body[2 + 2 * i] >> 4), tables.get(0x10 | body[2 + 2 * i] & 15)) for i in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            end = int(ends[np.searchsorted(ends, at)])
            out.scans.append(((chosen, first, last, bits >> 4, bits & 15), use, interval, at, end))
            out.quant = [quant[q] if not isinstance(q, np.ndarray) else q for q in out.quant]
            at = end


def decode_coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """Images, all coefficients in zigzag order (blocks in MCU order) and each image's first block."""
    data = b"".join(files) + b"\0" * 16
    raw = np.frombuffer(data, dtype=np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    kind = raw[ff + 1]
    ends = ff[(kind != 0) & (kind != 255) & ~((kind >= 0xD0) & (kind <= 0xD7))]
    restarts = ff[(kind >= 0xD0) & (kind <= 0xD7)]
    stuffed = ff[kind == 0] + 1
    keep = np.ones(len(raw), dtype=bool)
    keep[stuffed] = False
    plain = np.concatenate((raw[keep], np.zeros(16, dtype=np.uint8)))
    wide = np.zeros(len(plain) - 8, dtype=np.uint64)  # the eight bytes from each place
    for i in range(8):
        wide = (wide << np.uint64(8)) | plain[i : i + len(wide)]
    starts = np.concatenate(([0], np.cumsum([len(f) for f in files])))
    images = [read_headers(data, int(s), int(e), ends) for s, e in zip(starts[:-1], starts[1:], strict=True)]
    blocks = np.array([i.w * i.h * sum(a * b for a, b in i.sampling) for i in images])
    base = np.concatenate(([0], np.cumsum(blocks)))
    v = np.zeros((int(base[-1]), 64), dtype=np.int32)
    for nth in range(max((len(i.scans) for i in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, image in enumerate(images):
            if nth < len(image.scans):
                groups.setdefault(image.scans[nth][:2], []).append(i)
        for ((comps, first, last, high, low), tables), members in groups.items():
            parts = [scan_rows(images[i].w, images[i].h, comps, images[i].sampling) for i in members]
            rows = [r + x for (r, _), x in zip(parts, base[members].tolist(), strict=True)]
            comp = [c for _, c in parts]
            n = np.array([len(r) for r in rows])
            at, end = (np.array([images[i].scans[nth][x] for i in members]) for x in (3, 4))
            unit = [sum(a * b for a, b in (images[i].sampling[x] for x in comps)) if len(comps) > 1 else 1 for i in members]
            step = np.array([images[i].scans[nth][2] * u for i, u in zip(members, unit, strict=True)])
            step = np.where(step > 0, step, n)
            count = -(-n // step)
            mark = np.searchsorted(restarts, at)
            if (np.searchsorted(restarts, end) - mark != count - 1).any():
                raise ValueError("restart markers are missing")
            which = np.repeat(np.arange(len(members)), count)
            inside = np.arange(len(which)) - (np.cumsum(count) - count)[which]
            at = np.where(inside > 0, np.append(restarts, 0)[np.maximum(mark[which] + inside - 1, 0)] + 2, at[which])
            cut = inside * step[which]
            lanes = (8 * (at - np.searchsorted(stuffed, at)), (np.cumsum(n) - n)[which] + cut, np.minimum(n[which] - cut, step[which]))
            rows = np.concatenate(rows)
            if last == 0:
                (_dc_bits if high else _dc_values)(v, wide, lanes, rows, np.concatenate(comp), [_codes(t[0])[2] for t in tables] if not high else None, comps, low)
            elif high:
                _ac_bits(v, wide, plain, lanes, rows, _codes(tables[0][1])[2], first, last, low)
            else:
                _ac_values(v, wide, lanes, rows, _codes(tables[0][1])[2], first, last, low)
    return images, v, base


def _peek(wide, p):
    return wide[p >> 3] << (p & 7).astype(np.uint64)


def _extend(x, taken, size):
    """The signed value in the size bits of x behind the taken ones."""
    size_u = size.astype(np.uint64)
    bits = ((x << taken.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - size_u)).astype(np.int64)
    return np.where((bits << 1 >> size) == 0, bits - (1 << size) + 1, bits)


def _dc_values(v, wide, lanes, rows, comp, looks, comps, low):
    p, at, left = (x.copy() for x in lanes)
    looks = dict(zip(comps, looks, strict=True))
    last = np.zeros((len(p), max(comps) + 1), dtype=np.int64)
    live = np.arange(len(p))
    while len(live):
        row = at[live]
        c = comp[row]
        x = _peek(wide, p[live])
        top = (x >> np.uint64(48)).astype(np.int64)
        got = np.zeros(len(live), dtype=np.int64)
        for k, look in looks.items():
            own = c == k
            got[own] = look[top[own]]
        size, n = got >> 8, got & 255
        last[live, c] += np.where(size > 0, _extend(x, n, size), 0)
        v[rows[row], 0] = last[live, c] << low
        p[live] += n + size
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]


def _dc_bits(v, wide, lanes, rows, comp, looks, comps, low):
    p, at, n = lanes
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(p, n) + i
    v[rows[np.repeat(at, n) + i], 0] |= (_peek(wide, place) >> np.uint64(63)).astype(np.int64) << low


def _ac_values(v, wide, lanes, rows, look, first, last, low):
    p, at, left = (x.copy() for x in lanes)
    k = np.full(len(p), first)
    flat = v.reshape(-1)
    keep = left > 0
    p, at, k, end = p[keep], at[keep], k[keep], (at + left)[keep]
    while len(p):
        x = _peek(wide, p)
        got = look[(x >> np.uint64(48)).astype(np.int64)]
        n, symbol = got & 255, got >> 8
        run, size = symbol >> 4, symbol & 15
        some = size > 0
        place = k + run
        use = np.flatnonzero(some)
        flat[rows[at[use]] * 64 + place[use]] = _extend(x[use], n[use], size[use]) << low
        p = p + n + size
        k = np.where(some, place + 1, k + 16)
        stop = np.flatnonzero(~some & (run < 15))
        over = k > last
        if len(stop):  # an end of block, or of a run of blocks
            r = run[stop].astype(np.uint64)
            more = ((x[stop] << n[stop].astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - r)).astype(np.int64) + (1 << run[stop])
            at[stop] += more - 1
            p[stop] += run[stop]
            over[stop] = True
        at = at + over
        k = np.where(over, first, k)
        live = at < end
        if not live.all():
            p, at, k, end = p[live], at[live], k[live], end[live]


def _ac_bits(v, wide, plain, lanes, rows, look, first, last, low):
    """Later bits: symbols pass over zeros; each known coefficient that is passed takes one bit."""
    p, at, left = (x.copy() for x in lanes)
    end = at + left
    own = v[rows, first : last + 1]
    width = last - first + 1
    known = own != 0
    zero_count = np.zeros((len(rows), width + 1), dtype=np.int64)
    np.cumsum(~known, axis=1, out=zero_count[:, 1:])
    zero_place = np.full((len(rows), width + 17), width, dtype=np.int64)  # the place of a row's n-th zero
    r, c = np.nonzero(~known)
    zero_place[r, zero_count[r, c]] = c
    k, run_left = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
    passed: list[tuple[np.ndarray, ...]] = []  # (row, from, to, bit of the first)
    fresh: list[tuple[np.ndarray, ...]] = []
    live = np.flatnonzero(at < end)
    while len(live):
        block = at[live]
        ask = run_left[live] == 0
        x = _peek(wide, p[live])
        got = np.where(ask, look[(x >> np.uint64(48)).astype(np.int64)], 0)
        n, symbol = got & 255, got >> 8
        run, size = symbol >> 4, symbol & 15
        stop = ask & (size == 0) & (run < 15)
        extra = np.where(stop, run, 0)
        more = ((x << n.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - extra.astype(np.uint64))).astype(np.int64)
        run_left[live] = np.where(stop, more + (1 << extra), run_left[live])
        done = ~ask | stop  # the rest of the block is passed
        sign = (x << n.astype(np.uint64) >> np.uint64(63)).astype(np.int64)
        bit = p[live] + n + extra + (size > 0)
        nth = zero_count[block, k[live]] + run
        to = np.where(done, width, zero_place[block, np.minimum(nth, width)])
        start = k[live]
        take = (to - start) - (zero_count[block, to] - zero_count[block, start])
        some = np.flatnonzero(take)
        passed.append((block[some], start[some], to[some], bit[some], take[some]))
        new = np.flatnonzero((size > 0) & ~done & (to < width))
        fresh.append((block[new], to[new], np.where(sign[new] > 0, 1, -1)))
        p[live] = bit + take
        run_left[live] -= done
        k[live] = np.where(done, width, to + 1)
        over = k[live] >= width
        at[live] += over
        k[live] = np.where(over, 0, k[live])
        live = live[at[live] < end[live]]
    block, start, to, bit, take = (np.concatenate(x) for x in zip(*passed, strict=True))
    # every passed stretch: the places of its known coefficients, in order, take its bits in order
    order = np.lexsort((start, block))
    block, start, bit, take = block[order], start[order], bit[order], take[order]
    r, c = np.nonzero(known)
    place = np.repeat(bit, take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    on = (plain[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
    r, c = r[on], c[on]
    was = own[r, c]
    own[r, c] = was + np.where(was > 0, 1 << low, -(1 << low))
    block, to, sign = (np.concatenate(x) for x in zip(*fresh, strict=True))
    own[block, to] = sign << low
    v[rows, first : last + 1] = own


# ---------------------------------------------------------------- pixels


def _basis() -> np.ndarray:
    """The 8 x 8 inverse transform as integers: samples = coefficients @ basis, scaled by 2**16."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 1 / 2)
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(both * 2**16)[ZIGZAG]  # rows in zigzag order


_BASIS = _basis()


def samples(v: np.ndarray) -> np.ndarray:
    """8 x 8 samples of dequantised blocks. The products are whole numbers below 2**53, so sums are exact in any order."""
    out = np.floor((v.astype(np.float64) @ _BASIS) * 2.0**-16 + 128.5)
    return np.clip(out, 0, 255).astype(np.uint8)


def tensors(images: list[Image], v: np.ndarray, base: np.ndarray):
    """The (height, width, 3) RGB array of each image."""
    flat = samples(v) if all((q == 1).all() for i in images for q in i.quant) else None
    for i, image in enumerate(images):
        planes = []
        high, wide = max(b for _, b in image.sampling), max(a for a, _ in image.sampling)
        for c, (a, b) in enumerate(image.sampling):
            rows, _ = scan_rows(image.w, image.h, (c,), image.sampling)
            own = flat[base[i] + rows] if flat is not None else samples(v[base[i] + rows] * image.quant[c])
            plane = own.reshape(image.h * b, image.w * a, 8, 8).transpose(0, 2, 1, 3).reshape(image.h * b * 8, image.w * a * 8)
            if b < high:
                plane = np.repeat(plane, high // b, axis=0)
            if a < wide:
                plane = np.repeat(plane, wide // a, axis=1)
            planes.append(plane[: image.height, : image.width])
        if len(planes) == 1:
            yield np.repeat(planes[0][:, :, None], 3, axis=2)
            continue
        y, cb, cr = (p.astype(np.int32) for p in planes)
        cb -= 128
        cr -= 128
        y = (y << 16) + (1 << 15)
        rgb = np.stack((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb), axis=2) >> 16
        yield np.clip(rgb, 0, 255).astype(np.uint8)


def payloads_of(images: list[Image], v: np.ndarray, base: np.ndarray) -> list[bytes | None]:
    """The bytes that encode() stored; None for a file without its comment."""
    sizes = [struct.unpack(">Q", i.comment)[0] if len(i.comment) == 8 else -1 for i in images]
    whole = zip(sizes, base[:-1].tolist(), base[1:].tolist(), strict=True)
    return [(v[a : a + n // 64] + 128).astype(np.uint8).tobytes() if n >= 0 and n % 64 == 0 and a + n // 64 <= b else None for n, a, b in whole]
