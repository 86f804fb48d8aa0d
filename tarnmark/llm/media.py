"""Media columns: progressive JPEG, decoded in numpy.

The decoder reads any baseline-precision progressive JPEG with Huffman coding:
scans of spectral selection and successive approximation accumulate in
coefficient arrays, which are dequantised, inverse-transformed, upsampled where
chroma is subsampled, and turned into full-resolution RGB tensors. Entropy
decoding runs in lockstep: the restart segments of a scan, over all images of a
batch, are decoded side by side, one symbol of each at a step.

Payloads are stored losslessly in the format's own unit, quantised transform
coefficients: each 64 bytes are one block (coefficient = byte - 104, so common
letters are short codes; quantisers are 1), six blocks one 4:2:0 unit of luma
and chroma. Entropy coding loses nothing, so the bytes come back from the
coefficient arrays. The number of payload blocks stands in a comment segment.

The transform uses integer-valued factors in double precision: sums are exact,
so equal bytes give equal pixels on every machine.

Defined results: null and empty texts have a payload of 64 zero bytes; repeated
rows are stored each; other columns are ignored. A stream that is not
progressive JPEG, or is broken or cut off anywhere, raises ValueError with the
reason; ``tensors`` gives such a row nulls and the reason instead. Pictures that
stop after some of their scans, but with an end marker, are whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmark.llm.common import per_batch, text_or_empty, utf8

#: The byte that becomes coefficient zero.
CENTRE = 104
#: Payload bytes that one lockstep batch takes.
BATCH_BYTES = 2_000_000
#: (components, first coefficient, last, previous bit position, bit position) of each scan.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1)] + [((c,), a, b, 0, 0) for c in range(3) for a, b in ((1, 31), (32, 63))] + [((0, 1, 2), 0, 0, 1, 0)]


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()
#: Code lengths of the stored form: sizes of differences; (run, size) pairs with 12 bits unless named here.
DC_LENGTHS = dict.fromkeys(range(12), 4)
AC_LENGTHS = dict.fromkeys([16 * r + s for r in range(16) for s in range(1, 9)], 12) | {
    0x03: 2, 0x04: 2, 0x02: 3, 0x07: 3, 0x01: 4, 0x05: 6, 0x06: 6, 0x13: 7, 0x14: 7, 0x12: 8, 0x17: 8, 0x11: 8, 0x00: 9, 0xF0: 11,
}


def huffman_table(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table as a segment body (16 counts, then symbols), and symbol -> (code, length)."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(1 for s in symbols if lengths[s] == n) for n in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        codes[s], last = (code, lengths[s]), lengths[s]
        code += 1
    return bytes(counts) + bytes(symbols), codes


@functools.lru_cache(maxsize=64)
def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length * 256 + symbol; 0 where there is no code."""
    table, code, at = np.zeros(65536, dtype=np.int64), 0, 16
    if len(body) < 16 or len(body) < 16 + sum(body[:16]):
        raise ValueError("code table cut off")
    for n in range(1, 17):
        if code + body[n - 1] > 1 << n:
            raise ValueError("more codes than their lengths allow")
        for _ in range(body[n - 1]):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


_DC_BODY, _DC_CODES = huffman_table(DC_LENGTHS)
_AC_BODY, _AC_CODES = huffman_table(AC_LENGTHS)
_DC = np.array([_DC_CODES.get(s, (0, 0)) for s in range(16)], dtype=np.int64)
_AC = np.array([_AC_CODES.get(s, (0, 0)) for s in range(256)], dtype=np.int64)
_SIZE = np.array([int(abs(v)).bit_length() for v in range(-2048, 2049)], dtype=np.int64)


# ------------------------------------------------------------------- encoding


def _write_rows(value: np.ndarray, bits: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row, in order, padded with ones to whole bytes: (bytes, first byte of each row)."""
    row_bits = np.bincount(row, weights=bits, minlength=n_rows).astype(np.int64)
    row_bytes = (row_bits + 7) // 8
    first = np.concatenate([[0], np.cumsum(row_bytes)])
    before = np.concatenate([[0], np.cumsum(bits)])[:-1]
    row_before = np.concatenate([[0], np.cumsum(row_bits)])[:-1]
    at = first[row] * 8 + before - row_before[row]
    total = int(first[-1])
    out, byte, shift = np.zeros(total + 8), at >> 3, at & 7
    short = bits <= 24
    for some, lanes in ((short, 4), (~short, 8)):
        if some.any():
            word = value[some] << (8 * lanes - 1 - shift[some] - bits[some])  # one bit less than full: stays positive
            for lane in range(lanes):
                part = (word >> (8 * (lanes - 1 - lane) - 1)) & 255 if lane < lanes - 1 else (word << 1) & 255
                out += np.bincount(byte[some] + lane, weights=part, minlength=total + 8)
    out = out[:total].astype(np.uint8)
    pad = row_bytes * 8 - row_bits
    out[first[1:][row_bytes > 0] - 1] |= ((1 << pad[row_bytes > 0]) - 1).astype(np.uint8)
    return out, first


def _with_markers(data: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Stuffing after 0xFF and a restart marker before each row; (bytes, where each row begins after its marker)."""
    full = data == 255
    rows = len(first) - 1
    row_of = np.repeat(np.arange(rows), np.diff(first))
    stuffed = np.cumsum(full) - full
    at = np.arange(len(data)) + stuffed + 2 * (row_of + 1)
    out = np.zeros(len(data) + int(full.sum()) + 2 * rows, dtype=np.uint8)
    out[at] = data
    upto = np.concatenate([[0], np.cumsum(full)])
    begin = first[:-1] + upto[first[:-1]] + 2 * (np.arange(rows) + 1)
    out[begin - 2], out[begin - 1] = 255, 0xD0 + (number - 1) % 8
    return out.tobytes(), np.concatenate([begin, [len(out) + 2]])


def _magnitude(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < 0, value + (1 << size) - 1, value)


def _shape(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of 16-pixel units that hold so many blocks."""
    units = max(1, -(-n_blocks // 6))
    columns = max(min(units, 256), -(-units // 4095))
    return columns, -(-units // columns)


def _luma_order(columns: int, rows: int) -> np.ndarray:
    """Unit-order number of each luma block in raster order."""
    r, c = np.divmod(np.arange(4 * columns * rows), 2 * columns)
    return ((r // 2) * columns + c // 2) * 6 + (r % 2) * 2 + c % 2


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """Each payload (whole blocks of 64 bytes) as a progressive JPEG."""
    shapes = [_shape(len(p) // 64) for p in payloads]
    units = np.array([c * r for c, r in shapes])
    base = np.concatenate([[0], np.cumsum(units)])
    blocks = np.zeros((int(base[-1]) * 6, 64), dtype=np.int64)
    for p, b in zip(payloads, base):
        part = np.frombuffer(p, dtype=np.uint8).reshape(-1, 64)
        blocks[6 * b : 6 * b + len(part)] = part.astype(np.int64) - CENTRE
    orders = [
        np.concatenate([6 * b + _luma_order(*s) for b, s in zip(base, shapes)]),
        np.arange(base[-1]) * 6 + 4,
        np.arange(base[-1]) * 6 + 5,
    ]
    scans: list[list[bytes]] = [[] for _ in payloads]
    for components, ss, se, ah, al in SCRIPT:
        if ss == 0:
            dc, per_doc = blocks[:, 0].reshape(-1, 6), units
            if ah == 0:
                v = dc >> al
                diff = v.copy()
                diff[:, 1:4] -= v[:, 0:3]  # chroma predictions start anew with each restart
                diff = diff.ravel()
                size = _SIZE[diff + 2048]
                value, bits = (_DC[size, 0] << size) | _magnitude(diff, size), _DC[size, 1] + size
            else:
                value = ((dc >> al) & 1).ravel()
                bits = np.ones(len(value), dtype=np.int64)
            data, first = _write_rows(value, bits, np.repeat(np.arange(len(dc)), 6), len(dc))
        else:
            (c,) = components
            order, per_doc = orders[c], units * (4 if c == 0 else 1)
            band = blocks[order, ss : se + 1]
            row, col = np.nonzero(band)
            v = band[row, col]
            previous = np.concatenate([[-1], col[:-1]])
            previous[np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]] = -1
            run = col - previous[: len(col)] - 1
            size = _SIZE[v + 2048]
            symbol = (run & 15) * 16 + size
            value, bits = (_AC[symbol, 0] << size) | _magnitude(v, size), _AC[symbol, 1] + size
            zrl_code, zrl_bits = _AC_CODES[0xF0]
            for _ in range(3):
                more = run >= 16
                if not more.any():
                    break
                value, bits, run = np.where(more, value | (zrl_code << bits), value), bits + more * zrl_bits, np.where(more, run - 16, run)
            last = np.full(len(band), -1)
            last[row] = col
            ends = np.nonzero(last < se - ss)[0]  # rows with an end-of-block code
            code, n = _AC_CODES[0]
            merged = np.argsort(np.concatenate([row * 65 + col, ends * 65 + 64]), kind="stable")
            value = np.concatenate([value, np.full(len(ends), code)])[merged]
            bits = np.concatenate([bits, np.full(len(ends), n)])[merged]
            data, first = _write_rows(value, bits, np.concatenate([row, ends])[merged], len(band))
        doc_row = np.concatenate([[0], np.cumsum(per_doc)])
        number = np.arange(doc_row[-1]) - np.repeat(doc_row[:-1], per_doc)
        stream, begin = _with_markers(data, first, number)
        head = _scan_header(components, ss, se, ah, al)
        for d in range(len(payloads)):
            scans[d] += [head, stream[begin[doc_row[d]] : begin[doc_row[d + 1]] - 2]]
    return [_file_header(len(p) // 64, *s) + b"".join(parts) + b"\xff\xd9" for p, s, parts in zip(payloads, shapes, scans)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _scan_header(components: tuple[int, ...], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + bytes([ss, se, ah * 16 + al]))


def _file_header(n_blocks: int, columns: int, rows: int) -> bytes:
    frame = struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return (
        b"\xff\xd8" + _segment(0xFE, b"payload-blocks=%d" % n_blocks) + _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC2, frame)
        + _segment(0xC4, bytes([0]) + _DC_BODY + bytes([16]) + _AC_BODY) + _segment(0xDD, struct.pack(">H", 1))
    )


# ------------------------------------------------------------------- decoding

_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class _Image:
    """Frame, tables and scans of one stream; component arrays of blocks in raster order, padded to whole units."""

    def __init__(self, data: bytes):
        try:
            self._read(data)
        except (struct.error, IndexError, StopIteration, KeyError, TypeError, ZeroDivisionError) as e:
            raise ValueError(f"broken segment: {type(e).__name__}") from None

    def _read(self, data: bytes) -> None:
        self.data, self.scans, self.quantisers, self.payload_blocks = data, [], {}, None
        tables, restart, at, ended = {}, 0, 2, False
        self.components: list[dict] = []
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        while at < len(data):
            if data[at] != 255:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 255:
                at += 1
                continue
            if marker == 0xD9:
                ended = True
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise ValueError("segment cut off")
            at += 2 + size
            if marker == 0xFE and (m := re.fullmatch(rb"payload-blocks=(\d+)", body)):
                self.payload_blocks = int(m[1])
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    wide, name = body[k] >> 4, body[k] & 15
                    n = 128 if wide else 64
                    self.quantisers[name] = np.frombuffer(body[k + 1 : k + 1 + n], dtype=">u2" if wide else "u1").astype(np.float64)
                    k += 1 + n
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive frame with Huffman coding")
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = 16 + sum(body[k + 1 : k + 17])
                    tables[body[k]] = body[k + 1 : k + 1 + n]
                    k += 1 + n
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                n = body[0]
                chosen = [(next(i for i, c in enumerate(self.components) if c["id"] == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
                ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
                end = m.start() if (m := _SCAN_END.search(data, at)) else len(data)
                if not 0 <= ss <= se < 64 or (ss and n != 1) or (approx >> 4 and approx >> 4 != (approx & 15) + 1):
                    raise ValueError("no progressive scan")
                need = tuple(tables.get(t >> 4) if ss == 0 else tables.get(16 + (t & 15)) for _, t in chosen)
                if None in need and (ss or not approx >> 4):
                    raise ValueError("a scan without its table")
                self.scans.append((tuple(c for c, _ in chosen), ss, se, approx >> 4, approx & 15, need, restart, (at, end)))
                at = end
        if not self.components:
            raise ValueError("no progressive frame")
        if not ended:
            raise ValueError("no end marker")
        if any(c["q"] not in self.quantisers or len(self.quantisers[c["q"]]) != 64 for c in self.components):
            raise ValueError("a component without its quantiser")

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        if n not in (1, 3) or not self.width * self.height or not all(1 <= p[k] <= 4 for p in parts for k in (1, 2)):
            raise ValueError("no frame of one or three components")
        self.h, self.v = max(p[1] for p in parts), max(p[2] for p in parts)
        self.columns, self.rows = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for name, h, v, q in parts:
            across, down = -(-(-(-self.width * h // self.h)) // 8), -(-(-(-self.height * v // self.v)) // 8)
            self.components.append({"id": name, "h": h, "v": v, "q": q, "wide": self.columns * h, "high": self.rows * v, "across": across, "down": down})
        if sum(c["wide"] * c["high"] for c in self.components) > 8 * len(self.data):  # each block has a code
            raise ValueError("more blocks than bits")

    def block_order(self, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """(component, block) of a scan's blocks in order, and blocks for each unit that restarts count."""
        if len(components) == 1:
            c = self.components[components[0]]
            order = (np.arange(c["down"])[:, None] * c["wide"] + np.arange(c["across"])).ravel()
            return np.full(len(order), components[0]), order, 1
        unit = [(c, y, x) for c in components for y in range(self.components[c]["v"]) for x in range(self.components[c]["h"])]
        r, col = np.divmod(np.arange(self.columns * self.rows), self.columns)
        blocks = [(r * self.components[c]["v"] + y) * self.components[c]["wide"] + col * self.components[c]["h"] + x for c, y, x in unit]
        return np.tile([c for c, _, _ in unit], len(r)), np.stack(blocks, axis=1).ravel(), len(unit)


class _Bits:
    """Many bit streams side by side in one array of unstuffed bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.full(8, 255, dtype=np.uint8)]).astype(np.int64)
        n = len(data) + 3
        self.ahead = (padded[:n] << 32) | (padded[1 : n + 1] << 24) | (padded[2 : n + 2] << 16) | (padded[3 : n + 3] << 8) | padded[4 : n + 4]
        self.at = starts * 8

    def peek(self, which: np.ndarray) -> np.ndarray:
        """The next 32 bits of each stream."""
        at = self.at[which]
        return (self.ahead[np.minimum(at >> 3, len(self.ahead) - 1)] >> (8 - (at & 7))) & 0xFFFFFFFF


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)


def _split(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unstuffed bytes of all streams, the first byte of each restart segment, and segments for each stream."""
    data = np.frombuffer(b"".join(s + b"\xff\xd0" for s in streams), dtype=np.uint8)
    follows = np.zeros(len(data), dtype=bool)
    follows[1:] = data[:-1] == 255
    stuffing, marker = follows & (data == 0), follows & (data >= 0xD0) & (data <= 0xD7)
    keep = ~(stuffing | marker)
    keep[:-1] &= ~marker[1:]
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    ends = np.nonzero(marker)[0]  # each segment ends at a marker: its own, or the one put after each stream
    starts = np.concatenate([[0], ends[:-1] + 1])
    bounds = np.cumsum([len(s) + 2 for s in streams])
    per_stream = np.diff(np.concatenate([[0], np.searchsorted(ends, bounds)]))
    return data[keep], kept_before[starts], per_stream


def _dc_scan(bits: _Bits, coefficients, place, first, count, component, tables, ah: int, al: int) -> None:
    """tables: of each place in a unit's component number."""
    live = np.nonzero(count > 0)[0]
    predicted = np.zeros((len(count), 1 + int(component.max(initial=0))), dtype=np.int64)
    step = 0
    while len(live):
        j = first[live] + step
        word = bits.peek(live)
        if ah:
            coefficients[place[j], 0] |= (word >> 31) << al
            bits.at[live] += 1
        else:
            comp = component[j]
            entry = np.zeros(len(live), dtype=np.int64)
            for c, table in tables.items():
                own = comp == c
                entry[own] = _lookup(table)[word[own] >> 16]
            n, size = entry >> 8, entry & 255
            if not entry.all() or size.max() > 16 or (n + size).max() > 32:
                raise ValueError("unknown code")
            diff = _extend((word >> (32 - n - size)) & ((1 << size) - 1), size)
            value = predicted[live, comp] + diff
            predicted[live, comp] = value
            coefficients[place[j], 0] = value << al
            bits.at[live] += n + size
        step += 1
        live = live[count[live] > step]


def _ac_first(bits: _Bits, coefficients, place, first, count, table: bytes, ss: int, se: int, al: int) -> None:
    lookup = _lookup(table)
    live = np.nonzero(count > 0)[0]
    block, last = first.copy(), first + count
    k = np.full(len(count), ss)
    flat = coefficients.reshape(-1)
    while len(live):
        word = bits.peek(live)
        entry = lookup[word >> 16]
        if not entry.all():
            raise ValueError("unknown code")
        n, run, size = entry >> 8, (entry >> 4) & 15, entry & 15
        at = k[live] + run
        extra = (word >> (32 - n - size)) & ((1 << size) - 1)
        if ((size > 0) & (at > se)).any():
            raise ValueError("a coefficient beyond its band")
        some = size > 0
        hit = live[some]
        flat[place[block[hit]] * 64 + at[some]] = _extend(extra[some], size[some]) << al
        used, following = n + size, at + 1
        ends = (size == 0) & (run < 15)
        if ends.any():  # the rest of this block, and of as many more as the run says
            r = run[ends]
            more = (1 << r) + ((word[ends] >> (32 - n[ends] - r)) & ((1 << r) - 1)) - 1
            block[live[ends]] += more
            used[ends] += r
            following[ends] = se + 1
        bits.at[live] += used
        over = following > se
        k[live] = np.where(over, ss, following)
        block[live] += over
        if over.any():
            live = live[block[live] < last[live]]


def _ac_refine(data: np.ndarray, start: int, coefficients, places: np.ndarray, table: bytes, ss: int, se: int, al: int) -> int:
    """One segment, and the bit after it; correction bits make each step depend on what is known, so symbols come one by one."""
    lookup, at = _lookup(table), start * 8
    raw = data.tobytes() + b"\xff" * 8

    def read(n: int) -> int:
        nonlocal at
        out = (int.from_bytes(raw[at >> 3 : (at >> 3) + 5], "big") >> (40 - (at & 7) - n)) & ((1 << n) - 1)
        at += n
        return out

    bit, skip = 1 << al, 0
    for place in places:
        block, k = coefficients[place], ss

        def correct(k: int) -> None:
            if read(1) and not abs(int(block[k])) & bit:
                block[k] += bit if block[k] > 0 else -bit

        if not skip:
            while k <= se:
                entry = int(lookup[(int.from_bytes(raw[at >> 3 : (at >> 3) + 4], "big") >> (16 - (at & 7))) & 0xFFFF])
                if not entry:
                    raise ValueError("unknown code")
                at += entry >> 8
                run, size, value = (entry >> 4) & 15, entry & 15, 0
                if size:
                    value = bit if read(1) else -bit
                elif run < 15:
                    skip = (1 << run) + (read(run) if run else 0)
                    break
                while k <= se:
                    if block[k]:
                        correct(k)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if size and k <= se:
                    block[k] = value
                k += 1
        if skip:
            for k in range(k, se + 1):
                if block[k]:
                    correct(k)
            skip -= 1
        if at >> 3 > len(raw):
            break
    return at


def decode_coefficients(streams: list[bytes]) -> list[tuple[_Image, list[np.ndarray]]]:
    """Each stream's frame and, for each component, its blocks of coefficients in scan order (zigzag)."""
    images = [_Image(s) for s in streams]
    sizes = [[c["wide"] * c["high"] for c in im.components] for im in images]
    offsets, total = [], 0
    for s in sizes:
        offsets.append(np.concatenate([[total], total + np.cumsum(s)]))
        total = int(offsets[-1][-1])
    coefficients = np.zeros((total, 64), dtype=np.int32)
    for turn in range(max((len(im.scans) for im in images), default=0)):
        groups = defaultdict(list)
        for i, im in enumerate(images):
            if turn < len(im.scans):
                groups[im.scans[turn][:6]].append(i)
        for (components, ss, se, ah, al, tables), members in groups.items():
            spans = [images[i].scans[turn][7] for i in members]
            data, starts, per_stream = _split([images[i].data[a:b] for i, (a, b) in zip(members, spans)])
            places, comps, first, count, at = [], [], [], [], 0
            for i, n_segments in zip(members, per_stream):
                comp, block, per_unit = images[i].block_order(components)
                place = offsets[i][comp] + block
                step = images[i].scans[turn][6] * per_unit or len(place)
                if n_segments * step < len(place):
                    raise ValueError("restart segments are missing")
                begin = np.minimum(np.arange(n_segments) * step, len(place))
                first.append(at + begin)
                count.append(np.minimum(step, len(place) - begin))
                places.append(place)
                comps.append(comp)
                at += len(place)
            place, first, count = np.concatenate(places), np.concatenate(first), np.concatenate(count)
            bits = _Bits(data, starts)
            if ss == 0:
                _dc_scan(bits, coefficients, place, first, count, np.concatenate(comps), dict(zip(components, tables)), ah, al)
            elif ah == 0:
                _ac_first(bits, coefficients, place, first, count, tables[0], ss, se, al)
            else:
                for k, (s, f, n) in enumerate(zip(starts, first, count)):
                    bits.at[k] = _ac_refine(data, int(s), coefficients, place[f : f + n], tables[0], ss, se, al)
            if (bits.at > 8 * np.concatenate([starts[1:], [len(data)]])).any():
                raise ValueError("a scan ends early")
    return [(im, [coefficients[o[c] : o[c + 1]] for c in range(len(im.components))]) for im, o in zip(images, offsets)]


_SCALE = 4096
_BASIS = np.array([[round(_SCALE * (np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)) for x in range(8)] for u in range(8)], dtype=np.float64)


def _plane(blocks: np.ndarray, component: dict, quantiser: np.ndarray) -> np.ndarray:
    """Samples of a component: dequantised, inverse-transformed, levelled and clamped."""
    natural = np.zeros((len(blocks), 64))
    natural[:, ZIGZAG] = blocks * quantiser
    samples = _BASIS.T @ natural.reshape(-1, 8, 8) @ _BASIS
    samples = np.clip(np.floor(samples / (_SCALE * _SCALE) + 128.5), 0, 255).astype(np.uint8)
    high, wide = component["high"], component["wide"]
    return samples.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8)


def to_rgb(image: _Image, coefficients: list[np.ndarray]) -> np.ndarray:
    """Full-resolution RGB tensor (height, width, 3); chroma is upsampled by replication."""
    planes = []
    for c, blocks in zip(image.components, coefficients):
        plane = _plane(blocks, c, image.quantisers[c["q"]])
        y, x = np.arange(image.height) * c["v"] // image.v, np.arange(image.width) * c["h"] // image.h
        planes.append(plane[y[:, None], x].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0] * 65536 + 32768, planes[1] - 128, planes[2] - 128
    # fixed values: the colour matrix of JPEG files, times 65536
    rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2) >> 16
    return np.clip(rgb, 0, 255).astype(np.uint8)


def payload_of(image: _Image, coefficients: list[np.ndarray]) -> bytes:
    """The bytes that encode_batch stored."""
    units = image.columns * image.rows
    blocks = np.zeros((units * 6, 64), dtype=np.int32)
    blocks[_luma_order(image.columns, image.rows)] = coefficients[0]
    blocks[4::6], blocks[5::6] = coefficients[1], coefficients[2]
    return (blocks[: image.payload_blocks] + CENTRE).astype(np.uint8).tobytes()


def feature_of(rgb: np.ndarray) -> str:
    """Size, and mean and standard deviation of each channel, from exact sums."""
    x = rgb.reshape(-1, 3).astype(np.int64)
    n, s, q = len(x), x.sum(axis=0), (x * x).sum(axis=0)
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ";".join(f"{a / n:.3f},{max(0.0, b / n - (a / n) ** 2) ** 0.5:.3f}" for a, b in zip(s.tolist(), q.tolist()))


# ------------------------------------------------------------------ DataFrame


def pad_payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def _in_batches(items: list[bytes]):
    """Index ranges of at most BATCH_BYTES."""
    start = size = 0
    for i, x in enumerate(items):
        if i > start and size + len(x) > BATCH_BYTES:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(items):
        yield start, len(items)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text of each row stored as a media column."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column(1))
            media = []
            for a, b in _in_batches(texts):
                media += encode_batch([pad_payload(t) for t in texts[a:b]])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(per_batch(make), "doc_id long, n_bytes long, media binary")


def decode_each(streams: list[bytes]) -> list[tuple[np.ndarray | None, str | None]]:
    """(RGB tensor, None) of each stream, or (None, reason) where it is broken; whole batches are decoded at once."""
    out: list[tuple[np.ndarray | None, str | None]] = []
    for a, b in _in_batches(streams):
        try:
            out += [(to_rgb(*x), None) for x in decode_coefficients(streams[a:b])]
        except ValueError as e:
            if b - a == 1:
                out.append((None, str(e)))
            else:
                for s in streams[a:b]:
                    out += decode_each([s])
    return out


def tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """height, width, rgb (row-major bytes) and error of a column of progressive JPEGs, beside the other columns.

    A null stays null; a broken stream has nulls and its reason in ``error``.
    Columns of these four names that media has already are replaced.
    """
    at, names = media.columns.index(column), media.columns
    stay = [k for k, x in enumerate(names) if x not in ("height", "width", "rgb", "error")]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = batch.column(at).to_pylist()
            decoded = iter(decode_each([m for m in found if m is not None]))
            out = [(None, None) if m is None else next(decoded) for m in found]
            more = [pa.array([None if x is None else x.shape[k] for x, _ in out], pa.int32()) for k in (0, 1)]
            more += [pa.array([None if x is None else x.tobytes() for x, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in stay), *more], names=[*(names[k] for k in stay), "height", "width", "rgb", "error"])

        return step

    kinds = "".join(f"`{names[k]}` {media.schema[k].dataType.simpleString()}, " for k in stay)
    return media.mapInArrow(per_batch(make), f"{kinds}height int, width int, rgb binary, error string")


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: payload and media digests, and a feature of the pixels."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            streams, rows = batch.column(2).to_pylist(), []
            for a, b in _in_batches(streams):
                for stream, found in zip(streams[a:b], decode_coefficients(streams[a:b])):
                    payload = payload_of(*found)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature_of(to_rgb(*found))))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

        return step

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(per_batch(make), schema)


def media_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: all documents stored as media and read back."""
    return digests(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
