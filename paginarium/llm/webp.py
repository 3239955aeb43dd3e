"""Lossless WebP (VP8L) columns: bytes stored as grey images, decoded to pixel arrays.

``decode_all`` reads any lossless WebP files side by side: prefix codes (simple and
normal), length and distance codes, colour cache, meta prefix codes, and the inverse
predictor, cross-colour, subtract-green and colour-indexing transforms. All files
advance by one symbol per numpy step, whatever their transforms.

``encode_grey`` writes files: samples lie in the green channel under the
subtract-green transform (so pixels are grey), before it a palette of up to sixteen
values or a predictor where that needs fewer bits; runs become back-references, one
prefix code of at most ``LONGEST`` bits per file. A colour cache never pays for grey
pixels, whose literals are one symbol, so the writer leaves it out.

Defined cases: a null text is empty and gives one row of 576 bytes 255; texts above
one file's height are stored as several files one after another, coded and decoded a
few at a time however long the text; equal texts give equal files; rows with a null or
repeated doc_id are rows like others; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.llm.common import settle

ROW = 576
#: Rows of one file; longer payloads are several files, which decode side by side.
TALLEST = 8
LONGEST = 12
RUN = 16
#: Payload bytes coded together in a task, and rows of a batch taken at a time.
AT_ONCE, ROWS_AT_ONCE = 2_000_000, 2000

# Fixed values of the format: order of the lengths of the code length code, and the
# (x, y) offsets that the first 120 distance codes stand for.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: What of a file is kept as one number while its header is read.
HEAD_BITS = 1600

_REVERSED: dict[int, np.ndarray] = {}


def reversed_bits(width: int) -> np.ndarray:
    """Every number of ``width`` bits with its bits in reverse."""
    if width not in _REVERSED:
        at, out = np.arange(1 << width), np.zeros(1 << width, np.int64)
        for k in range(width):
            out |= (at >> k & 1) << (width - 1 - k)
        _REVERSED[width] = out
    return _REVERSED[width]


class Code:
    """A canonical prefix code as one table: index by the next ``width`` bits. Entries: symbol | length << 12."""

    def __init__(self, lengths: Sequence[int]):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.width, self.symbol, self.length = 0, np.array([int(used[0]) if len(used) else 0]), np.array([0])
            self.entries = self.symbol.astype(np.int32)
            return
        used = used[np.argsort(lengths[used], kind="stable")]
        self.width = int(lengths[used[-1]])
        spread = 1 << (self.width - lengths[used])
        if int(spread.sum()) != 1 << self.width:
            raise ValueError("not a complete prefix code")
        back = reversed_bits(self.width)
        self.symbol, self.length = np.repeat(used, spread)[back], np.repeat(lengths[used], spread)[back]
        self.entries = (self.symbol | self.length << 12).astype(np.int32)


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.raw, self.at, self.end = data[at:], 0, 8 * (len(data) - at)
        self.head = int.from_bytes(self.raw[: HEAD_BITS // 8], "little")

    def peek(self, n: int) -> int:
        if self.at < HEAD_BITS - 64:
            return self.head >> self.at & ((1 << n) - 1)
        first = self.at >> 3
        return int.from_bytes(self.raw[first : first + 9], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end + 64:
            raise ValueError("the image ends early")
        return out

    def symbol(self, code: Code) -> int:
        entry = int(code.entries[self.peek(code.width)])
        self.at += entry >> 12
        return entry & 4095


@lru_cache(maxsize=256)
def _kept_code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.int64))


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _kept_code(lengths.tobytes())
    of_lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[k]] = bits.read(3)
    code = _kept_code(np.array(of_lengths, np.int64).tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last, entries = 0, 8, code.entries.tolist()
    while at < size and left:
        left -= 1
        entry = entries[bits.peek(code.width)]
        bits.at += entry >> 12
        s = entry & 4095
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        times = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + times > size:
            raise ValueError("more code lengths than symbols")
        lengths[at : at + times] = last if s == 16 else 0
        at += times
    return Code(lengths)


def far(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


class Coded:
    """What precedes the symbols of an entropy-coded image: cache size, groups of codes, and which block uses which."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.width, self.height = width, height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        self.groups_of, self.shift, self.across = None, 0, 0
        if main and bits.read(1):
            self.shift = bits.read(3) + 2
            self.across = (width + (1 << self.shift) - 1) >> self.shift
            self.groups_of = read_image(bits, self.across, (height + (1 << self.shift) - 1) >> self.shift) >> 8 & 0xFFFF
        sizes = (280 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)
        self.groups = [[read_code(bits, n) for n in sizes] for _ in range(1 + (int(self.groups_of.max()) if self.groups_of is not None else 0))]


def read_image(bits: Bits, width: int, height: int) -> np.ndarray:
    """The small entropy-coded image of a transform or of block numbers, as a flat array of ARGB numbers."""
    head = Coded(bits, width, height, False)
    (pixels,), (bits.at,) = read_symbols([(bits.raw, bits.at, head)])
    return pixels


def _hashed(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return (0x1E35A7BD * pixels & 0xFFFFFFFF) >> (32 - cache_bits)


def read_symbols(parts: Sequence[tuple[bytes, int, Coded]]) -> tuple[list[np.ndarray], list[int]]:
    """The pixels of images given as (data, position of the first symbol, head), and where each ends.

    All images advance together, one symbol of each per numpy step; references and
    cached colours are resolved image by image.
    """
    raw = b"".join(data + b"\0" * 8 for data, _, _ in parts) + b"\0" * 8
    window = np.ndarray((len(raw) - 8,), "<i8", raw, 0, (1,))  # the eight bytes from every byte on
    sizes = np.array([len(data) + 8 for data, _, _ in parts])
    origin = 8 * (np.cumsum(sizes) - sizes)
    limit = origin + 8 * sizes
    pos = origin + np.array([at for _, at, _ in parts])
    heads = [h for _, _, h in parts]
    groups = [g for h in heads for g in h.groups]
    group = np.cumsum([0] + [len(h.groups) for h in heads[:-1]])
    codes = [[g[c] for g in groups] for c in range(4)]
    table, rows, mask = [], [], []
    for own in codes:
        table.append(np.concatenate([c.entries for c in own]))
        entries = np.array([len(c.entries) for c in own])
        rows.append(np.cumsum(entries) - entries), mask.append(entries - 1)
    far_codes = [g[4] for g in groups]
    # the red, blue and alpha of groups whose codes have one symbol each; -1 where they must be read
    fixed = np.array([int(r.symbol[0]) << 16 | int(b.symbol[0]) | int(a.symbol[0]) << 24 if not r.width + b.width + a.width else -1 for _, r, b, a, _ in groups])
    blocked = [h.groups_of is not None for h in heads]
    any_blocked, any_read = any(blocked), bool((fixed < 0).any())
    total = np.array([h.width * h.height for h in heads])
    ends = np.cumsum(total)
    first = ends - total
    pixels = np.zeros(int(total.sum()), np.int64)
    lane, to, end = np.arange(len(heads)), first.copy(), ends.copy()
    own_fixed, own_row, own_mask = fixed[group], rows[0][group], mask[0][group]
    caches: dict[int, list] = {}

    def number(k: int, s: int) -> int:
        """The value of a length or distance prefix, its extra bits read at lane k."""
        if s < 4:
            return s + 1
        extra, at = (s - 2) >> 1, int(pos[k])
        pos[k] += extra
        return ((2 + (s & 1)) << extra) + (int(window[at >> 3]) >> (at & 7) & ((1 << extra) - 1)) + 1

    steps = int((end - to).min())  # until an image can end, unless a reference ends one before
    while len(to):
        if any_blocked:
            now = group.copy()
            for k in np.flatnonzero([blocked[j] for j in lane]):
                h, at = heads[lane[k]], int(to[k] - first[lane[k]])
                now[k] += h.groups_of[(at // h.width >> h.shift) * h.across + (at % h.width >> h.shift)]
            own_fixed, own_row, own_mask = fixed[now], rows[0][now], mask[0][now]
        else:
            now = group
        found = table[0][own_row + (window[pos >> 3] >> (pos & 7) & own_mask)]
        pos += found >> 12
        symbol = found & 4095
        if any_read:
            value = np.where(own_fixed < 0, 0, own_fixed) | symbol << 8
            k = np.flatnonzero((own_fixed < 0) & (symbol < 256))
            for c, up in ((1, 16), (2, 0), (3, 24)):
                more = table[c][rows[c][now[k]] + (window[pos[k] >> 3] >> (pos[k] & 7) & mask[c][now[k]])]
                pos[k] += more >> 12
                value[k] |= (more & 4095).astype(np.int64) << up
            pixels[to] = value
        else:
            pixels[to] = own_fixed | symbol << 8  # overwritten where the symbol is no literal
        to += 1
        steps -= 1
        for k in (found & 3840).nonzero()[0]:
            s, here, begin, h = int(symbol[k]), int(to[k]) - 1, int(first[lane[k]]), heads[lane[k]]
            if s < 280:
                length = number(k, s - 256)
                code = far_codes[now[k]]
                at = int(pos[k])
                entry = int(code.entries[int(window[at >> 3]) >> (at & 7) & (len(code.entries) - 1)])
                pos[k] += entry >> 12
                distance = far(number(k, entry & 4095), h.width)
                if distance > here - begin or here + length > end[k]:
                    raise ValueError("a reference leaves the image")
                if distance >= length:
                    pixels[here : here + length] = pixels[here - distance : here - distance + length]
                else:
                    pixels[here : here + length] = np.resize(pixels[here - distance : here], length)
                to[k] += length - 1
                steps = min(steps, int(end[k] - to[k]))
            else:
                cache, upto = caches.setdefault(int(lane[k]), [np.zeros(1 << h.cache_bits, np.int64), begin])
                recent = pixels[upto:here]
                cache[_hashed(recent, h.cache_bits)] = recent  # of pixels with one place, the last stays
                caches[int(lane[k])][1] = here
                pixels[here] = cache[s - 280]
        if steps <= 0:
            going = to < end
            gone = ~going
            sizes[lane[gone]] = pos[gone]  # from here on: where the image ended
            pos, lane, to, end, group, own_fixed, own_row, own_mask = (x[going] for x in (pos, lane, to, end, group, own_fixed, own_row, own_mask))
            steps = int((end - to).min()) if len(to) else 0
    if (sizes > limit).any():
        raise ValueError("an image ends early")
    return [pixels[a:b] for a, b in zip(first, ends)], (sizes - origin).tolist()


def channels(image: np.ndarray) -> np.ndarray:
    """(n, 4): alpha, red, green, blue."""
    return np.stack([image >> s & 255 for s in (24, 16, 8, 0)], axis=-1)


def joined(parts: np.ndarray) -> np.ndarray:
    parts = parts & 255
    return parts[..., 0] << 24 | parts[..., 1] << 16 | parts[..., 2] << 8 | parts[..., 3]


def predicted(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, top_left))
        by_top = sum(abs(x - c) for x, c in zip(left, top_left))
        return left if by_left < by_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, top_left)]
    if mode == 13:
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(half(left, top), top_left)]
    return [255, 0, 0, 0]


def undo_predictor(image: np.ndarray, width: int, height: int, modes: np.ndarray, shift: int) -> np.ndarray:
    """Row by row; a row whose blocks agree in a mode without the pixel to the left is one step, the others go by pixel."""
    px = channels(image).reshape(height, width, 4)
    across = (width + (1 << shift) - 1) >> shift
    of_block = (modes >> 8 & 15).reshape(-1, across)
    px[0, 0, 0] += 255
    px[0] = np.cumsum(px[0], axis=0) & 255
    for y in range(1, height):
        row, top = px[y], px[y - 1]
        row[0] = (row[0] + top[0]) & 255
        own = of_block[y >> shift]
        mode = int(own[0]) if (own == own[0]).all() else -1
        if mode == 1:
            px[y] = np.cumsum(row, axis=0) & 255
        elif mode in (0, 2, 3, 4, 8, 9) or mode > 13:
            right = np.append(top[1:], row[:1], axis=0)
            guess = {2: top, 3: right, 4: np.roll(top, 1, axis=0), 8: (np.roll(top, 1, axis=0) + top) >> 1, 9: (top + right) >> 1}.get(mode, np.array([255, 0, 0, 0]))
            px[y, 1:] = (row + guess)[1:] & 255
        else:
            done, above, first = row.tolist(), top.tolist(), row[0].tolist()
            for x in range(1, width):
                guess = predicted(int(own[x >> shift]), done[x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < width else first)
                done[x] = [(a + b) & 255 for a, b in zip(done[x], guess)]
            px[y] = done
    return joined(px.reshape(-1, 4))


def undo_cross_colour(image: np.ndarray, width: int, height: int, elements: np.ndarray, shift: int) -> np.ndarray:
    at = np.arange(width * height)
    across = (width + (1 << shift) - 1) >> shift
    own = channels(elements[(at // width >> shift) * across + (at % width >> shift)])
    signed = lambda x: (x & 255) - ((x & 128) << 1)
    moved = lambda t, c: signed(t) * signed(c) >> 5
    px = channels(image)
    green = px[:, 2]
    px[:, 1] = (px[:, 1] + moved(own[:, 3], green)) & 255
    px[:, 3] = px[:, 3] + moved(own[:, 2], green) + moved(own[:, 1], px[:, 1])
    return joined(px)


def undo_subtract_green(image: np.ndarray) -> np.ndarray:
    green = image >> 8 & 255
    return (image & 0xFF00FF00) | ((image & 0xFF00FF) + green * 0x10001) & 0xFF00FF


def undo_palette(image: np.ndarray, width: int, height: int, table: np.ndarray, shift: int) -> np.ndarray:
    index = (image >> 8 & 255).reshape(height, -1)
    if shift:
        per, bits = 1 << shift, 8 >> shift
        index = (index[:, :, None] >> (np.arange(per) * bits) & ((1 << bits) - 1)).reshape(height, -1)[:, :width]
    padded = np.zeros(256, np.int64)
    padded[: len(table)] = table
    return padded[index.ravel()]


def chunk_of(file: bytes) -> bytes:
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(file):
        size = struct.unpack_from("<I", file, at + 4)[0]
        if file[at : at + 4] == b"VP8L":
            return file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def head_of(file: bytes):
    """(data, position of the main image's symbols, its head, width, height, inverse transforms in reading order)."""
    data = chunk_of(file)
    if data[:1] != b"\x2f":
        raise ValueError("no lossless signature")
    bits = Bits(data, 1)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            shift = bits.read(3) + 2
            block = read_image(bits, (coded + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift)
            undo.append((undo_predictor if kind == 0 else undo_cross_colour, (coded, height, block, shift)))
        elif kind == 2:
            undo.append((undo_subtract_green, ()))
        else:
            n = bits.read(8) + 1
            table = joined(np.cumsum(channels(read_image(bits, n, 1)), axis=0))
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((undo_palette, (coded, height, table, shift)))
            coded = (coded + (1 << shift) - 1) >> shift
    head = Coded(bits, coded, height, True)
    return bits.raw, bits.at, head, width, height, undo


def decode_all(files: Sequence[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, ARGB numbers row by row) of lossless WebP files, decoded side by side."""
    if not files:
        return []
    heads = [head_of(f) for f in files]
    images, _ = read_symbols([h[:3] for h in heads])
    out = []
    for (_, _, _, width, height, undo), image in zip(heads, images):
        for f, args in reversed(undo):
            image = f(image, *args)
        out.append((width, height, image))
    return out


def decode(file: bytes) -> tuple[int, int, np.ndarray]:
    return decode_all([file])[0]


def prefix_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Huffman code lengths; counts are flattened until no code is longer than allowed."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 2:
        lengths[used] = 1
        return lengths
    weight = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weight, kind="stable")
        n = len(used)
        leaf, parent = weight[order].tolist(), [0] * (2 * n - 1)
        made: list[int] = []
        i = j = 0
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if i < n and (j >= len(made) or leaf[i] <= made[j]):
                    total += leaf[i]
                    parent[i] = k
                    i += 1
                else:
                    total += made[j]
                    parent[n + j] = k
                    j += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= longest:
            lengths[used[order]] = depth[:n]
            return lengths
        weight = weight // 2 + 1 + (weight.sum() >> longest)


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol as it is written, first bit lowest."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    out = np.zeros(len(lengths), np.int64)
    if len(used) > 1:
        width = int(lengths[used[-1]])
        spread = 1 << (width - lengths[used])
        out[used] = reversed_bits(width)[np.cumsum(spread) - spread]
    return out


def run_tokens(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, extra bits, how many): bytes, with runs as references to the byte before."""
    starts = np.append(0, np.flatnonzero(payload[1:] != payload[:-1]) + 1)
    lengths = np.diff(np.append(starts, len(payload)))
    long = np.flatnonzero(lengths >= RUN)
    if not len(long):
        return payload.astype(np.int64), np.zeros(len(payload), np.int64), np.zeros(len(payload), np.int64)
    parts, at = [], 0
    for k in long:
        first, left = int(starts[k]) + 1, int(lengths[k]) - 1
        literal = payload[at:first].astype(np.int64)
        parts.append((literal, np.zeros(len(literal), np.int64), np.zeros(len(literal), np.int64)))
        at = first + left
        refs = []
        while left:
            take = min(left, 4096)
            left -= take
            v = take - 1
            if v < 4:
                refs.append((256 + v, 0, 0))
            else:
                high = v.bit_length() - 1
                extra = high - 1
                refs.append((256 + 2 * high + (v >> extra & 1), v & ((1 << extra) - 1), extra))
        parts.append(tuple(np.array(c, np.int64) for c in zip(*refs)))
    literal = payload[at:].astype(np.int64)
    parts.append((literal, np.zeros(len(literal), np.int64), np.zeros(len(literal), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def code_tokens(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(value, bits) of a prefix code: simple where it has one or two small symbols, else normal."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and used.sum() < 256:
        return [(1, 1), (0, 1), (1, 1), (int(used.sum()), 8)]
    if len(used) == 2 and used[1] < 256:
        return [(1, 1), (1, 1), (1, 1), (int(used[0]), 8), (int(used[1]), 8)]
    # sixteen symbols of four bits: the lengths 0 to 12 and the three repeats
    out = [(0, 1), (15, 4)] + [(4 if k <= 12 or k >= 16 else 0, 3) for k in LENGTH_ORDER]
    out.append((0, 1))
    word = _length_words()
    gaps = np.diff(np.append(used, len(lengths)), prepend=-1) - 1
    for gap, n in zip(gaps.tolist(), [*lengths[used].tolist(), None]):
        while gap:
            zeros = min(gap, 138)
            if zeros >= 11:
                out += [(word[18], 4), (zeros - 11, 7)]
            elif zeros >= 3:
                out += [(word[17], 4), (zeros - 3, 3)]
            else:
                out.append((word[0], 4))
                zeros = 1
            gap -= zeros
        if n is not None:
            out.append((word[n], 4))
    return out


@lru_cache(maxsize=1)
def _length_words() -> list[int]:
    return code_words(np.array([4] * 13 + [0] * 3 + [4] * 3)).tolist()


def only(symbol: int) -> list[tuple[int, int]]:
    """A code whose one symbol takes no bits."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def palette_tokens(values: np.ndarray) -> list[tuple[int, int]]:
    """The colour-indexing transform: grey values as opaque greens, each coded as the step from the last."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    lengths = prefix_lengths(np.bincount(steps, minlength=280))
    words, single = code_words(lengths), np.count_nonzero(lengths) == 1
    out = [(1, 1), (3, 2), (len(values) - 1, 8), (0, 1)] + code_tokens(lengths) + only(0) * 2
    out += [(1, 1), (1, 1), (0, 1), (0, 1), (255, 8)] if len(values) > 1 else only(255)  # alpha: 255, then steps of 0
    out += only(0)
    for k, s in enumerate(steps.tolist()):
        if not single:
            out.append((int(words[s]), int(lengths[s])))
        if len(values) > 1:
            out.append((0 if k else 1, 1))
    return out


def predictor_tokens(mode: int, height: int) -> list[tuple[int, int]]:
    """The predictor transform with one mode for all blocks (of 512 pixels a side)."""
    return [(1, 1), (0, 2), (7, 3), (0, 1)] + only(mode) + only(0) * 2 + only(255) + only(0)


def residuals(rows: np.ndarray, is_first: np.ndarray, mode: int) -> np.ndarray:
    """What the predictor leaves of grey rows: left (1), top (2) or the mean of top left and top (8).

    ``is_first``: a file's first rows, which are predicted from the left; the first
    column is predicted from above.
    """
    out = rows.copy()
    later = np.flatnonzero(~is_first)
    out[:, 1:] -= rows[:, :-1]
    out[later, 0] -= rows[later - 1, 0]
    if mode != 1:
        top = rows[later - 1]
        guess = top[:, 1:] if mode == 2 else ((top[:, :-1].astype(np.uint16) + top[:, 1:]) >> 1).astype(np.uint8)
        out[later, 1:] = rows[later, 1:] - guess
    return out


def bits_needed(values: np.ndarray, file: np.ndarray, n_files: int) -> np.ndarray:
    """Per file the entropy of its values' own distribution, in bits for all of them; runs count once."""
    new = np.append(True, (values[1:] != values[:-1]) | (file[1:] != file[:-1]))
    counts = np.bincount(file[new] * 256 + values[new], minlength=256 * n_files).reshape(n_files, 256)
    n = counts.sum(axis=1)
    log = lambda x: x * np.log2(np.maximum(x, 1))
    return log(n) - log(counts).sum(axis=1) + 6 * np.count_nonzero(counts, axis=1)


def transformed(payloads: list[np.ndarray]):
    """Per file (header bits of the transforms, bytes of the green channel to code, alpha), in the form that needs fewest bits.

    Candidates: the samples as they are, an index into at most sixteen values with
    two to eight samples a pixel, and what a predictor leaves. All are followed by
    the subtract-green transform, which makes the pixels grey.
    """
    n, green = len(payloads), [(1, 1), (2, 2)]
    flat = np.concatenate(payloads)
    sizes = np.array([len(p) for p in payloads])
    first = np.cumsum(sizes) - sizes
    file = np.repeat(np.arange(n), sizes)
    rows, is_first = flat.reshape(-1, ROW), np.zeros(len(flat) // ROW, bool)
    is_first[first // ROW] = True
    modes = (1, 2, 8)
    rests = [residuals(rows, is_first, m).ravel() for m in modes]
    costs = np.stack([bits_needed(flat, file, n)] + [bits_needed(r, file, n) + 60 for r in rests])
    kinds = np.bincount(file * 256 + flat, minlength=256 * n).reshape(n, 256) > 0
    few = kinds.sum(axis=1) <= 16
    choice, least = costs.argmin(axis=0), costs.min(axis=0)
    for k in range(n):
        own = slice(first[k], first[k] + sizes[k])
        if few[k]:
            values = np.flatnonzero(kinds[k])
            shift = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
            per, bits = 1 << shift, 8 >> shift
            index = np.searchsorted(values, payloads[k]).reshape(-1, per)  # ROW is a multiple of eight
            bundled = (index << (np.arange(per) * bits)).sum(axis=1).astype(np.uint8)
            if bits_needed(bundled, np.zeros(len(bundled), np.int64), 1)[0] + 12 * len(values) < least[k]:
                yield green + palette_tokens(values), bundled, 255
                continue
        if choice[k]:
            yield predictor_tokens(modes[choice[k] - 1], len(payloads[k]) // ROW) + green, rests[choice[k] - 1][own], 0
        else:
            yield green, payloads[k], 255


def encode_grey(payloads: list[np.ndarray]) -> list[bytes]:
    """One file for each payload (a multiple of ROW bytes, at most ROW * TALLEST)."""
    values, widths, counts = [], [], []
    for payload, (tokens, green, alpha) in zip(payloads, transformed(payloads)):
        symbols, extra, n_extra = run_tokens(green)
        lengths = prefix_lengths(np.bincount(symbols, minlength=280))
        words = code_words(lengths)
        single = np.count_nonzero(lengths) == 1
        n_code = np.zeros_like(symbols) if single else lengths[symbols]
        head = [(0x2F, 8), (ROW - 1, 14), (len(payload) // ROW - 1, 14), (0, 1), (0, 3), *tokens, (0, 1)]
        head += [(0, 1), (0, 1)]  # no cache (a grey literal is one symbol as it is), one group of codes
        head += code_tokens(lengths) + only(0) * 2 + only(alpha)
        head += [(1, 1), (0, 1), (0, 1), (1, 1)]  # distance symbol 1: one pixel to the left
        head = np.array(head, np.int64)
        # a symbol's code and its extra bits (at most 12 + 10) go out as one number
        values.append(np.append(head[:, 0], words[symbols] | extra << n_code))
        widths.append(np.append(head[:, 1], n_code + n_extra))
        counts.append(len(values[-1]))
    bits = [int(w.sum()) for w in widths]
    words32 = np.array([-(-b // 32) + 1 for b in bits])
    base = 32 * (np.cumsum(words32) - words32)
    value, width = np.concatenate(values).astype(np.uint64), np.concatenate(widths)
    ends = np.cumsum(width)
    before = np.cumsum(bits) - bits
    start = ends - width + np.repeat(base - before, counts)
    word = start >> 5
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    sums = np.zeros(int(words32.sum()), np.uint64)
    sums[word[first]] = np.add.reduceat(value << (start & 31).astype(np.uint64), first)
    low = (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low[1:] += (sums[:-1] >> np.uint64(32)).astype(np.uint32)
    raw, out = low.astype("<u4").tobytes(), []
    for b, n in zip(base, bits):
        data = raw[b >> 3 : (b >> 3) + (n + 7) // 8]
        pad = b"\0" * (len(data) & 1)
        out.append(b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad)
    return out


def decode_grey(files: Sequence[bytes]) -> list[np.ndarray]:
    """The samples of grey images."""
    return [(px >> 8 & 255).astype(np.uint8) for _, _, px in decode_all(files)]


def samples_in(file: bytes) -> int:
    """Width times height, from the first bytes of a simple file."""
    size = int.from_bytes(file[21:25], "little")
    return ((size & 0x3FFF) + 1) * ((size >> 14 & 0x3FFF) + 1)


def files_in(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + size])
        at += size
    return out


def payload_of(text: str | None) -> tuple[int, np.ndarray]:
    raw = (text or "").encode()
    padded = raw + b"\xff" * (-len(raw) % ROW if raw else ROW)
    return len(raw), np.frombuffer(padded, np.uint8)


def parts_of(payload: np.ndarray) -> list[np.ndarray]:
    return [payload[at : at + ROW * TALLEST] for at in range(0, len(payload), ROW * TALLEST)]


def together(parts: list[tuple[int, int]]):
    """(from, to) of consecutive parts of about ``AT_ONCE`` bytes; ``parts``: (row, bytes)."""
    begin = size = 0
    for k, (_, n) in enumerate(parts):
        if size and size + n > AT_ONCE:
            yield begin, k
            begin, size = k, 0
        size += n
    if size:
        yield begin, len(parts)


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as one or more files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.slice(low, ROWS_AT_ONCE)
                payloads = [payload_of(t) for t in some.column(1).to_pylist()]
                parts = [(k, part) for k, (_, p) in enumerate(payloads) for part in parts_of(p)]
                media: list[list[bytes]] = [[] for _ in payloads]
                for begin, end in together([(k, len(p)) for k, p in parts]):
                    for (k, _), file in zip(parts[begin:end], encode_grey([p for _, p in parts[begin:end]])):
                        media[k].append(file)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).cast(pa.int64()), pa.array([n for n, _ in payloads], pa.int64()), pa.array([b"".join(m) for m in media], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


class Summary:
    """Digests and statistics of samples that come part by part."""

    def __init__(self):
        self.n, self.sha, self.tail, self.counts = 0, hashlib.sha256(), b"", np.zeros(256, np.int64)

    def add(self, samples: np.ndarray) -> None:
        raw = samples.tobytes()
        self.n += len(raw)
        self.sha.update(raw)
        self.tail = (self.tail + raw[-32:])[-32:]
        self.counts += np.bincount(samples, minlength=256)

    def feature(self) -> str:
        share = self.counts / self.n
        value = np.arange(256)
        mean = float((share * value).sum())
        deviation = float(np.sqrt(max((share * (value - mean) ** 2).sum(), 0)))
        some = share[share > 0]
        return f"{ROW}x{self.n // ROW} mean {mean:.4f} deviation {deviation:.4f} values {len(some)} entropy {-(some * np.log2(some)).sum():.4f}"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of the decoded samples of each stored row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.slice(low, ROWS_AT_ONCE)
                held = some.column(2).to_pylist()
                files = [(k, f) for k, m in enumerate(held) for f in files_in(m)]
                found = [Summary() for _ in held]
                for begin, end in together([(k, samples_in(f)) for k, f in files]):
                    for (k, _), samples in zip(files[begin:end], decode_grey([f for _, f in files[begin:end]])):
                        found[k].add(samples)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0), some.column(1), pa.array([s.n for s in found], pa.int64()), pa.array([s.sha.hexdigest() for s in found]),
                        pa.array([zlib.crc32(s.tail) for s in found], pa.int64()), pa.array(list(map(len, held)), pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in held], pa.string()), pa.array([s.feature() for s in found], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return features(settle(spark, stored(docs), "media", compression="none"))
