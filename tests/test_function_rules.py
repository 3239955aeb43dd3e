"""Sampled functions, calculator programs, page images in two versions and typed JSON against plain walks."""

from __future__ import annotations

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.errors import PySparkException

from paginarium.functions import calculator
from paginarium.operators import objects, raster

f4 = np.float32


def results(spark, programs, inputs=(), n=1):
    """The last n values that each program leaves for each row of inputs, None where there are fewer."""
    names = [f"i{k}" for k in range(max((len(r) for r in inputs), default=0))]
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(inputs or [()])], ", ".join(["id long", *(f"{c} double" for c in names)]))
    out = []
    for program in programs:
        got = calculator.calculated(rows, program, [(c, -1e30, 1e30) for c in names], [(f"o{k}", -1e30, 1e30) for k in range(n)]).orderBy("id").collect()
        out.append([None if r["o0"] is None else [r[f"o{k}"] for k in range(n)] for r in got])
    return out


def test_programs_without_inputs(spark):
    cases = {
        "{7.5 2 div}": 3.75, "{-7 2 idiv}": -3, "{-7 2 mod}": -1, "{3 0 div}": 0, "{3 0 idiv}": 0, "{3 0 mod}": 0, "{2.5 round}": 3, "{-2.5 round}": -2, "{-2.1 floor}": -3, "{-2.1 ceiling}": -2, "{-2.9 cvi}": -2, "{-3e9 truncate}": -2147483648.0,
        "{12 10 and}": 8, "{12 10 or}": 14, "{12 10 xor}": 6, "{5 not}": 0, "{0 not}": 1, "{3 4 bitshift}": 48, "{-48 -4 bitshift}": -3, "{3 40 bitshift}": 0, "{3 -40 bitshift}": 0, "{30 sin}": 0.5, "{120 cos}": -0.5, "{-1 1 atan}": 315, "{0 ln}": -1e30,
        "{2 5 exp}": 32, "{100 log}": 2, "{9 sqrt}": 3, "{4 true {8} if}": 8, "{4 false {8} if}": 4, "{4 0.9 {8} if}": 4, "{1 {5} {6} ifelse}": 5, "{0 {5} {6} ifelse}": 6, "{5 6 if 7}": 6, "{5 1 {if 3} if 8}": 8, "{word}": 0, "{4 % 9 9\n 2 sub}": 2,
        "{8 9 1 index}": 8, "{8 9 2 index}": 9, "{1 2 3 3 1 roll}": 2, "{1 2 3 3 -1 roll}": 1, "{1 2 3 4 1 roll}": 3, "{1 2 2 copy pop}": 1, "{6 3 copy}": 6, "{pop 5}": 5, "{add}": 0, "{" + "1 " * 105 + "}": 1, "{1e99}": 0,
    }
    for (program, want), (got,) in zip(cases.items(), results(spark, cases)):
        assert got is not None and math.isclose(got[0], want, rel_tol=1e-6, abs_tol=1e-6), (program, got)
    assert results(spark, ["{1}"], n=2) == [[None]]
    for wrong in ("1 2 add", "{1 2 add", "", "{" * 130 + "}" * 130):
        with pytest.raises(ValueError):
            calculator.parsed(wrong)
    assert calculator.parsed("{" * 129 + "}" * 129) is not None


def walked(program, stack):
    """A plain walk in single precision over what the random programs use."""
    def pop():
        return stack.pop() if stack else f4(0)

    for k, item in enumerate(program):
        if isinstance(item, list):
            continue
        if item in ("if", "ifelse"):
            yes = int(pop()) != 0
            body = program[k - (1 if item == "if" else 2)] if yes else program[k - 1] if item == "ifelse" else []
            walked(body, stack)
        elif item == "dup":
            a = pop()
            stack += [a, a]
        elif item == "exch":
            b, a = pop(), pop()
            stack += [b, a]
        elif item == "pop":
            pop()
        elif item == "index":
            n = int(pop())
            if 0 <= n < len(stack):
                stack.append(stack[-1 - n])
        elif item == "copy":
            n = int(pop())
            if 0 < n <= len(stack):
                stack += stack[-n:]
        elif item == "roll":
            j, n = int(pop()), int(pop())
            if 0 < n <= len(stack):
                top = stack[-n:]
                stack[-n:] = [top[(i - j) % n] for i in range(n)]
        elif isinstance(item, str):
            b, a = pop(), (pop() if item in ("add", "sub", "gt", "le") else None)
            stack.append({"add": lambda: a + b, "sub": lambda: a - b, "gt": lambda: f4(a > b), "le": lambda: f4(a <= b), "neg": lambda: -b, "abs": lambda: abs(b), "floor": lambda: f4(math.floor(b))}[item]())
        else:
            stack.append(f4(item))
    return stack


def spelled(rng, depth=0):
    words = []
    for _ in range(rng.randint(2, 5)):
        pick = rng.random()
        if pick < 0.3:
            words.append(str(rng.choice([-1, 0, 1, 2, 3, 0.5])))
        elif pick < 0.5 and depth < 2:
            words += [spelled(rng, depth + 1), "if"] if rng.random() < 0.5 else [spelled(rng, depth + 1), spelled(rng, depth + 1), "ifelse"]
        else:
            words.append(rng.choice(["dup", "exch", "pop", "index", "copy", "roll", "add", "sub", "gt", "le", "neg", "abs", "floor"]))
    return "{ " + " ".join(words) + " }"


def test_random_programs_equal_a_plain_walk(spark):
    rng = random.Random(5)
    inputs = [(rng.choice([-2, -0.5, 0, 1, 2, 3.25]), rng.choice([-1, 0, 1, 2]), rng.choice([0, 1, 2, 3])) for _ in range(12)]
    programs = [spelled(rng) for _ in range(12)]
    for program, got in zip(programs, results(spark, programs, inputs, 2)):
        for row, values in zip(inputs, got):
            stack = walked(calculator.parsed(program), [f4(v) for v in row])
            assert (values is None) == (len(stack) < 2), (program, row, values, stack)
            assert values is None or [float(v) for v in stack[-2:]] == values, (program, row)


def test_long_program_stays_small(spark):
    rows = spark.createDataFrame([(0.5,), (None,)], "x double")
    out = calculator.calculated(rows, "{" + " dup mul" * 30 + "}", [("x", 0, 1)], [("y", 0, 1)])
    assert {r["y"] for r in out.collect()} == {0.0, None}
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_sampled_equals_every_corner(spark):
    rng = random.Random(3)
    sizes, bits, outs = (3, 1, 2, 4), 4, 2
    samples = [rng.randrange(16) for _ in range(math.prod(sizes) * outs)]
    inputs = [tuple(rng.choice([-1.0, 0.0, 0.3, 0.5, 0.99, 1.0, 2.0]) for _ in sizes) for _ in range(30)] + [(None, 0.0, 0.0, 0.0), (float("nan"), 0.2, 0.2, 0.2)]
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(inputs)], "id long, a double, b double, c double, d double")
    encode = [(0.0, 2.0), (0.0, 5.0), (1.0, 0.0), (-1.0, 4.0)]
    got = calculator.sampled(rows, [(c, 0, 1) for c in "abcd"], sizes, samples, bits, [("p", 0, 1), ("q", -4, 2)], encode=encode, decode=[(0.0, 1.5), (-5.0, 2.0)]).orderBy("id").collect()
    for r, row in zip(got, inputs):
        if None in row:
            assert r["p"] is None and r["q"] is None
            continue
        place = [0.0 if math.isnan(x) else min(max(e0 + min(max(x, 0), 1) * (e1 - e0), 0), n - 1) for x, n, (e0, e1) in zip(row, sizes, encode)]
        for k, (name, d, lo, hi) in enumerate((("p", (0.0, 1.5), 0, 1), ("q", (-5.0, 2.0), -4, 2))):
            total = 0.0
            for point in product(*(range(n) for n in sizes)):
                weight = math.prod(max(0.0, 1 - abs(x - i)) for x, i in zip(place, point))
                at = sum(i * math.prod(sizes[:j]) for j, i in enumerate(point))
                total += weight * samples[at * outs + k]
            assert math.isclose(r[name], min(max(d[0] + total / 15 * (d[1] - d[0]), lo), hi), abs_tol=1e-9)
    assert calculator.packed_samples(b"\x12\x34\x56", 12, 3) == [0x123, 0x456, 0] and calculator.packed_samples(b"\xa5", 1, 8) == [1, 0, 1, 0, 0, 1, 0, 1]
    for bad in (dict(sizes=(0,)), dict(samples=[1]), dict(bits=5)):
        with pytest.raises(ValueError):
            calculator.sampled(**{"rows": rows, "inputs": [("a", 0, 1)], "sizes": (2,), "samples": [1, 2], "bits": 8, "outputs": [("p", 0, 1)], **bad})


def plain_similarity(a, b):
    h, w = a.shape
    wh, ww, scores = min(8, h), min(8, w), []
    for y in range(h - wh + 1):
        for x in range(w - ww + 1):
            p, q = a[y:y + wh, x:x + ww].ravel(), b[y:y + wh, x:x + ww].ravel()
            n = max(len(p) - 1, 1)
            va, vb, c = ((p - p.mean()) ** 2).sum() / n, ((q - q.mean()) ** 2).sum() / n, ((p - p.mean()) * (q - q.mean())).sum() / n
            scores.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (va + vb + 58.5225)))
    return float(np.mean(scores))


def test_images_equal_direct_computation(spark):
    rng = np.random.default_rng(2)
    pairs = {0: (600, 20), 1: (8, 8), 2: (3, 5), 3: (1, 1), 4: (9, 30), 5: (263, 8), 6: (264, 9), 7: (16, 16)}
    left, right, images = [], [], {}
    for k, (h, w) in pairs.items():
        a = rng.integers(0, 256, (h, w)).astype(float)
        b = np.clip(a + rng.integers(-40, 40, (h, w)) * (rng.random((h, w)) < 0.3), 0, 255) if k != 7 else a.copy()
        if k == 3:
            b = 255 - a
        images[k] = a, b
        left += [(k, y, [int(v) for v in r]) for y, r in enumerate(a)]
        right += [(k, y + 0, [int(v) for v in r]) for y, r in enumerate(b)]
    left += [(20, 0, [255, 0]), (20, 1, [255, 255]), (21, 0, [1, 2]), (21, 5, [1, 2]), (22, 0, []), (None, 0, [1]), (23, None, [1]), (24, 0, None)]
    right += [(20, 0, [255]), (21, 0, [1, 2]), (21, 5, [1, 3]), (22, 0, [])]
    frame = lambda rows: spark.createDataFrame(rows, "image long, y long, samples array<int>")
    got = {r["image"]: r for r in raster.compared(frame(left), frame(right)).collect()}
    for k, (a, b) in images.items():
        r, at = got[k], np.argwhere(a != b)
        assert (r["differing"], r["largest"]) == (len(at), int(abs(a - b).max()))
        assert (r["x0"], r["y0"], r["x1"], r["y1"]) == ((at[:, 1].min(), at[:, 0].min(), at[:, 1].max() + 1, at[:, 0].max() + 1) if len(at) else (None,) * 4)
        assert r["ssim"] == 1.0 if k == 7 else math.isclose(r["ssim"], plain_similarity(a, b), abs_tol=1e-9)
    # Beyond an edge is white; sizes that differ and rows that lack have no score.
    assert tuple(got[20])[1:] == (1, 255, 1, 0, 2, 1, None) and got[21]["ssim"] is None and got[21]["differing"] == 1 and got[22]["differing"] == 0
    assert set(got) == {*pairs, 20, 21, 22}
    assert raster.compared(frame([]), frame([])).count() == 0


def test_band_holds_no_whole_image(spark):
    rows = spark.createDataFrame([(0, y, [y % 7, y % 5, 3, 4, 5, 6, 7, 8]) for y in range(3000)], "image long, y long, samples array<int>")
    import re

    plan = raster.similarity(raster.paired(rows, rows.selectExpr("image", "y", "transform(samples, s -> s + 1) samples")))._jdf.queryExecution().optimizedPlan().toString()
    assert all("band" in w for w in re.findall(r"windowspecdefinition\([^)]*", plan)) and "windowspecdefinition" in plan


def test_objects_there_and_back(spark):
    rows = spark.createDataFrame([
        (1, '{"A": {"name": "T"}, "B": [1, null, {"ref": [3, 0]}, [true, -2.5]], "C": [], "D": {}, "E": "bare", "F": {"hex": "00ff"}, "G": {"string": "x y"}}'),
        (2, "[null]"), (3, "{broken"), (4, None), (5, "5"), (6, '{"ref": [1]}'), (7, '{"ref": [1, 2, 3]}'), (8, '{"name": 4}'), (9, '{"name": "a", "ref": [1, 0]}'), (10, '{"ref": [1, 0]}'), (11, ""),
    ], "doc long, j string")
    got = {}
    for r in objects.leaves(rows, "doc", "j").collect():
        got.setdefault(r["key"], {})[r["path"]] = (r["kind"], r["value"])
    assert got == {
        1: {"/A": ("name", "T"), "/B[0]": ("int", "1"), "/B[1]": ("null", None), "/B[2]": ("ref", "3 0"), "/B[3][0]": ("bool", "true"), "/B[3][1]": ("real", "-2.5"), "/C": ("array", None), "/D": ("dict", None), "/E": ("text", "bare"), "/F": ("hex", "00ff"), "/G": ("string", "x y")},
        2: {"[0]": ("null", None)}, 3: {"": ("broken", "{broken")}, 5: {"": ("int", "5")}, 6: {"/ref[0]": ("int", "1")}, 7: {f"/ref[{k}]": ("int", str(k + 1)) for k in range(3)}, 8: {"/name": ("int", "4")},
        9: {"/name": ("text", "a"), "/ref[0]": ("int", "1"), "/ref[1]": ("int", "0")}, 10: {"": ("ref", "1 0")}, 11: {"": ("broken", "")},
    }
    deep = spark.createDataFrame([(1, "[" * 5 + "1" + "]" * 5)], "doc long, j string")
    assert [r["path"] for r in objects.leaves(deep, "doc", "j", 5).collect()] == ["[0]" * 5]
    with pytest.raises(PySparkException, match="more than 4 levels"):
        objects.leaves(deep, "doc", "j", 4).collect()
