"""The WebP coder: round trips of stored rows, and hand-made files for every feature of the format."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from paginarium.llm import webp

R = np.random.default_rng(9)


class Writer:
    """A plain bit writer for test files."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, bits):
        self.value |= int(value) << self.n
        self.n += bits

    def code(self, lengths):
        """A normal code with given lengths (0 to 12), and its words."""
        lengths = np.asarray(lengths, np.int64)
        self.put(0, 1), self.put(15, 4)
        for k in webp.LENGTH_ORDER:
            self.put(4 if k <= 12 or k >= 16 else 0, 3)
        self.put(0, 1)
        words = webp.code_words(np.array([4] * 13 + [0] * 3 + [4] * 3))
        for n in lengths:
            self.put(words[n], 4)
        single = np.count_nonzero(lengths) <= 1
        return [(int(c), 0 if single else int(n)) for c, n in zip(webp.code_words(lengths), lengths)]

    def file(self):
        data = self.value.to_bytes((self.n + 7) // 8, "little")
        pad = b"\0" * (len(data) & 1)
        return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def start(width, height):
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    return w


def put_image(w, pixels, main, cache_bits=0, tokens=None):
    """Literal pixels, or given tokens: ("px", argb), ("copy", length, distance code), ("cache", index)."""
    tokens = tokens or [("px", int(p)) for p in pixels]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    coded = []
    for t in tokens:
        if t[0] == "px":
            coded.append([(0, t[1] >> 8 & 255), (1, t[1] >> 16 & 255), (2, t[1] & 255), (3, t[1] >> 24 & 255)])
        elif t[0] == "copy":
            parts = []
            for group, base, v in ((0, 256, t[1] - 1), (4, 0, t[2] - 1)):
                if v < 4:
                    parts.append((group, base + v))
                else:
                    high = v.bit_length() - 1
                    parts += [(group, base + 2 * high + (v >> (high - 1) & 1)), ("raw", v & ((1 << (high - 1)) - 1), high - 1)]
            coded.append(parts)
        else:
            coded.append([(0, 280 + t[1])])
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    words = []
    for g, size in enumerate(sizes):
        counts = np.zeros(size, np.int64)
        for parts in coded:
            for p in parts:
                if p[0] == g:
                    counts[p[1]] += 1
        words.append(w.code(webp.prefix_lengths(counts) if counts.any() else counts))
    for parts in coded:
        for p in parts:
            if p[0] == "raw":
                w.put(p[1], p[2])
            else:
                w.put(*words[p[0]][p[1]])


def noise(n, low=0, high=256):
    return webp.joined(R.integers(low, high, (n, 4)))


def test_literals():
    px = noise(60)
    w = start(10, 6)
    w.put(0, 1)
    put_image(w, px, True)
    assert webp.decode(w.file())[:2] == (10, 6) and (webp.decode(w.file())[2] == px).all()


def test_copies_and_cache():
    w = start(8, 4)
    w.put(0, 1)
    a, b = 0xFF102030, 0x80FF00FF
    slot = lambda c: (0x1E35A7BD * c & 0xFFFFFFFF) >> 28
    assert slot(a) != slot(b)
    # two pixels, eight from two back, one from the row above (code 1), the cached b, the rest one back
    tokens = [("px", a), ("px", b), ("copy", 8, 122), ("copy", 1, 1), ("cache", slot(b)), ("copy", 20, 2)]
    put_image(w, None, True, 4, tokens)
    expected = [a, b] * 5
    expected.append(expected[2])
    expected.append(b)
    expected += [b] * 20
    assert webp.decode(w.file())[2].tolist() == expected


def test_subtract_green_and_cross_colour():
    px = noise(64)
    w = start(8, 8)
    w.put(1, 1), w.put(2, 2)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    elements = noise(4)
    put_image(w, elements, False)
    w.put(0, 1)
    signed = lambda v: v - 256 if v > 127 else v
    coded = []
    for at, c in enumerate(webp.channels(px).tolist()):
        e = webp.channels(elements)[(at // 8 >> 2) * 2 + (at % 8 >> 2)].tolist()
        alpha, red, green, blue = c[0], (c[1] - c[2]) & 255, c[2], (c[3] - c[2]) & 255
        new_blue = blue - (signed(e[2]) * signed(green) >> 5) - (signed(e[1]) * signed(red) >> 5)
        new_red = red - (signed(e[3]) * signed(green) >> 5)
        coded.append(alpha << 24 | (new_red & 255) << 16 | green << 8 | new_blue & 255)
    put_image(w, coded, True)
    assert (webp.decode(w.file())[2] == px).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 7, 6
    px = noise(width * height)
    c = webp.channels(px).tolist()
    coded = []
    for at in range(width * height):
        y, x = divmod(at, width)
        guess = [255, 0, 0, 0] if not at else c[at - 1] if not y else c[at - width] if not x else webp.predicted(mode, c[at - 1], c[at - width], c[at - width - 1], c[at - width + 1])
        coded.append([(v - g) & 255 for v, g in zip(c[at], guess)])
    w = start(width, height)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    put_image(w, [0xFF000000 | mode << 8] * 4, False)
    w.put(0, 1)
    put_image(w, webp.joined(np.array(coded)), True)
    assert (webp.decode(w.file())[2] == px).all()


@pytest.mark.parametrize("colours", [2, 4, 11, 200])
def test_palettes(colours):
    table, width, height = noise(colours), 13, 9
    index = R.integers(0, colours, width * height)
    shift = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, bits = 1 << shift, 8 >> shift
    across = -(-width // per)
    coded = []
    for y in range(height):
        for k in range(across):
            v = 0
            for j, i in enumerate(index[y * width + k * per : min((y * width + k * per) + per, (y + 1) * width)]):
                v |= int(i) << (j * bits)
            coded.append(0xFF000000 | v << 8)
    w = start(width, height)
    w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
    c = webp.channels(table)
    put_image(w, webp.joined(np.diff(c, axis=0, prepend=0)), False)
    w.put(0, 1)
    put_image(w, coded, True)
    assert (webp.decode(w.file())[2] == table[index]).all()


def test_meta_codes():
    """Two groups of codes, chosen by blocks of four pixels."""
    w = start(8, 4)
    w.put(0, 1), w.put(0, 1), w.put(1, 1), w.put(0, 3)
    put_image(w, [0xFF000000, 0xFF000100], False)
    colours = (0xFF112233, 0x44556677)
    for c in colours:
        for size, v in ((280, c >> 8 & 255), (256, c >> 16 & 255), (256, c & 255), (256, c >> 24)):
            lengths = np.zeros(size, np.int64)
            lengths[v] = 1
            w.code(lengths)
        w.code(np.zeros(40, np.int64))
    assert webp.decode(w.file())[2].tolist() == ([colours[0]] * 4 + [colours[1]] * 4) * 4


def test_grey_round_trip():
    payloads = [webp.payload_of(t)[1] for t in ("", "a", "ab" * 288, "é" * 700, "x y z " * 90 + "q" * 900)] + [R.integers(0, 256, 576 * 5).astype(np.uint8), np.zeros(576, np.uint8)]
    files = webp.encode_grey(payloads)
    back = webp.decode_grey(files)  # side by side
    for payload, plain, file in zip(payloads, back, files):
        width, height, px = webp.decode(file)
        assert (plain == payload).all() and (width, height) == (576, len(payload) // 576)
        assert (webp.channels(px) == np.stack([np.full(len(payload), 255), payload, payload, payload], axis=1)).all()


def test_broken_files():
    file = webp.encode_grey([webp.payload_of("some text")[1]])[0]
    for bad in (b"", b"RIFFxxxx", file[:30], b"RIFF" + file[4:12] + b"VP8 " + file[16:]):
        with pytest.raises(Exception):
            webp.decode(bad)


def test_stored_rows(spark):
    rows = [(1, "text", "clash"), (2, None, None), (3, "", "m"), (4, "ü" * 60_000, "m"), (None, "text", "m"), (1, "text", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string").repartition(2)
    found = webp.features(webp.stored(docs)).collect()
    assert len(found) == len(rows)
    for r in found:
        own = [t for i, t, _ in rows if i == r["doc_id"]][0]
        raw = (own or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(r["media_sha256"], r["feature"]) for r in found if r["doc_id"] in (1, None)}) == 1
    assert webp.features(webp.stored(docs.where("doc_id = -1"))).count() == 0
