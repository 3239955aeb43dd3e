"""Trees, names under limits, codecs and lines from right to left against plain walks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from paginarium.functions import codecs
from paginarium.operators import bidi, lookup, trees


def test_parents_by_depth_keep_a_stack(spark):
    r = random.Random(3)
    rows = [(g, k, r.choice([1, 1, 2, 3, 4, 6, 9, 0, None])) for g in (1, 2, None) for k in range(60)]
    found = {(x.g, x.k): (x.parent, list(x.path), x.below) for x in trees.parents_by_depth(spark.createDataFrame(rows, "g int, k int, d int"), "g", "k", "d", 6).collect()}
    for g in (1, 2, None):
        stack, want = [], {}
        for _, k, d in (x for x in rows if x[0] == g):
            d = 6 if d is None else min(max(d, 1), 6)
            while stack and stack[-1][1] >= d:
                stack.pop()
            want[k] = [s[0] for s in stack]
            stack.append((k, d))
        for k, path in want.items():
            below = sum(k in other for other in want.values())
            assert found[g, k] == (path[-1] if path else None, path, below)


def test_rooted_matches_walks(spark):
    r = random.Random(5)
    parent = {k: r.choice([None, -7, *range(k)]) if k else None for k in range(80)}
    parent.update({k: k - 1 for k in range(100, 150)})  # a chain under a parent that is no node
    parent.update({200: 202, 201: 200, 202: 201, 203: 201, 204: 204, 205: 204})
    rows = [*parent.items(), (None, 3), (5, parent[5])]
    found = {x.node: x for x in trees.rooted(spark.createDataFrame(rows, "node int, up int"), "node", "up").collect()}
    assert set(found) == set(parent)
    paths = {}
    for k in parent:
        path = [k]
        while parent[path[-1]] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        paths[k] = None if parent[path[-1]] in parent else path
    for k, path in paths.items():
        if path is None:
            assert (found[k].root, found[k].depth, found[k].below) == (None, None, None)
        else:
            assert (found[k].root, found[k].depth) == (path[-1], len(path) - 1)
            assert found[k].below == sum(k in p[1:] for p in paths.values() if p)


def test_rooted_of_a_star_and_of_nothing(spark):
    star = spark.range(1, 3001).select("id", F.lit(0).cast("long").alias("up")).union(spark.createDataFrame([(0, None)], "id long, up long"))
    found = trees.rooted(star, "id", "up")
    assert found.where("node = 0").first().below == 3000
    assert found.where("root = 0 AND depth = 1 AND below = 0").count() == 3000
    assert trees.rooted(spark.createDataFrame([], "id long, up long"), "id", "up").count() == 0


def walk(tree, entries, node, key):
    """What a reader finds for a key below a node, in tree order."""
    low, high = tree[node][2:]
    if low is not None or high is not None:
        low, high = sorted((low or "", high or ""))
        if not low <= key <= high:
            return None
    for _, name, value in sorted((e[1:] for e in entries if e[0] == node), key=lambda e: e[0]):
        if name == key:
            return node, value
    kids = sorted((n for n, (up, *_) in tree.items() if up == node), key=lambda n: tree[n][1])
    return next((found for n in kids if (found := walk(tree, entries, n, key))), None)


def test_names_under_limits_match_the_walk(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 3)))
    limit = lambda: r.choice([None, None, None, word(), word()])
    tree = {"n0": (None, 0, None, None)}
    for k in range(1, 40):
        tree[f"n{k}"] = (f"n{r.randrange(k)}", k, limit(), limit())
    inner = {up for up, *_ in tree.values()}
    leaves = [n for n in tree if n not in inner]
    entries = [(leaf, at, word(), r.randrange(1000)) for leaf in leaves for at in range(6)] + [("nowhere", 0, "a", 1), (leaves[0], 9, None, 2)]
    looping = {"c1": ("c2", 1, None, None), "c2": ("c1", 2, None, None)}
    nodes = spark.createDataFrame([(n, *rest) for n, rest in {**tree, **looping}.items()], "node string, parent string, place int, low string, high string")
    table = spark.createDataFrame([*entries, ("c1", 0, "only in a circle", 3)], "leaf string, at int, name string, value int")
    asked = sorted({e[2] for e in entries if e[2]} | {"zz", "", "only in a circle"})
    keys = spark.createDataFrame([*((k, k) for k in asked), (None, None), ("a", "again")], "name string, value string")
    found = trees.names_under_limits(keys.withColumnRenamed("value", "note"), "name", table, nodes).collect()
    assert len(found) == len(asked) + 2
    for x in found:
        assert (x.leaf, x.value) == ((x.name is not None and walk(tree, entries, "n0", x.name)) or (None, None))
    plan = trees.names_under_limits(keys.select("name"), "name", table, nodes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_reachable_goes_on_past_any_depth(spark):
    found = lookup.reachable(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(40, 0)], "src int, dst int"), spark.createDataFrame([(0,)], "node int"))
    assert {x.node: x.steps for x in found.collect()} == {k: k for k in range(41)}


def test_text_strings_match_python(spark):
    r = random.Random(2)
    signs = [*map(chr, range(0x30, 0x50)), "\t", "\n", "\x18", "\x7f", "\xa0", "\xad", "é", "ÿ", *codecs.MARKED]
    texts = ["".join(r.choice(signs[:40] if k % 2 else signs) for _ in range(r.randint(0, 12))) for k in range(300)] + [None, "", "Ω", "\U0001f3a8"]
    own = {**{chr(k): k for k in [*range(0x18), *range(0x20, 0x7F), *range(0xA1, 0x100)] if k != 0xAD}, **dict(zip(codecs.MARKED, [*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0]))}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codecs.text_bytes(F.col("t")).alias("b"), codecs.bytes_text(codecs.text_bytes(F.col("t"))).alias("back")).collect()
    for x in rows:
        if x.t is None:
            assert x.b is None and x.back is None
            continue
        want = bytes(own[c] for c in x.t) if all(c in own for c in x.t) else b"\xfe\xff" + x.t.encode("utf-16-be")
        assert bytes(x.b) == want and x.back == x.t


def test_broken_bytes_read_as_python_does(spark):
    r = random.Random(4)
    units = lambda: b"".join(r.choice([b"\x00A", b"\xd8\x3c", b"\xdf\xa8", b"\x26\x3a"]) for _ in range(r.randint(0, 9)))
    data = [b"\xfe\xff" + units() + (b"A" if k % 3 == 0 else b"") for k in range(100)]
    data += [b"\xff\xfe" + b"".join(d[k + 1 : k + 2] + d[k : k + 1] for k in range(0, len(d), 2)) for d in (units() for _ in range(100))]
    data += [b"\xef\xbb\xbf" + bytes(r.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0xFF]) for _ in range(r.randint(0, 9))) for _ in range(200)]
    rows = spark.createDataFrame([(bytearray(d),) for d in data], "b binary").select("b", codecs.bytes_text(F.col("b")).alias("t")).collect()
    for x in rows:
        d = bytes(x.b)
        if d.startswith(b"\xef\xbb\xbf"):
            want = d[3:].decode("utf-8", "replace")
        else:
            order = "big" if d[0] == 0xFE else "little"
            codes = [int.from_bytes(d[k : k + 2], order) for k in range(2, len(d) - 1, 2)]
            want, k = "", 0
            while k < len(codes):
                if 0xD800 <= codes[k] < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000:
                    want, k = want + chr(0x10000 + ((codes[k] - 0xD800) << 10) + codes[k + 1] - 0xDC00), k + 2
                else:
                    want, k = want + ("�" if 0xD800 <= codes[k] < 0xE000 else chr(codes[k])), k + 1
        assert x.t == want, d


def plain_order(text, rtl):
    """Levels by loops over one line, then runs turned round from the highest level down."""
    kinds = []
    for c in text:
        kinds.append("R" if "א" <= c <= "ת" or c in "ابجد" else "N" if c.isdigit() else "S" if c in ",.+-/:" else "T" if c in "$%" else "L" if c.isalpha() else "O")
    seen = list(kinds)
    for i, k in enumerate(seen):
        if k == "S" and 0 < i < len(seen) - 1 and seen[i - 1] == seen[i + 1] == "N":
            kinds[i] = "N"
    i = 0
    while i < len(kinds):
        j = i
        while j < len(kinds) and seen[j] == "T":
            j += 1
        if j > i and ((i and kinds[i - 1] == "N") or (j < len(kinds) and kinds[j] == "N")):
            kinds[i:j] = ["N"] * (j - i)
        i = max(j, i + 1)
    kinds = [k if k in "LRN" else "O" for k in kinds]
    near = lambda i, step: next((kinds[j] for j in range(i + step, len(kinds) if step > 0 else -1, step) if kinds[j] in "LR"), None)
    first = list(kinds)
    if not rtl:
        for i, k in enumerate(kinds):
            if k == "N" and (near(i, -1) == "L" or (near(i, -1) is None and near(i, 1) in (None, "L"))):
                first[i] = "L"
    whole, strong, settled = "R" if rtl else "L", {"L": "L", "R": "R", "N": "R"}, list(first)
    i = 0
    while i < len(first):
        j = i
        while j < len(first) and first[j] == "O":
            j += 1
        if j > i:
            a, b = strong[first[i - 1]] if i else whole, strong[first[j]] if j < len(first) else whole
            settled[i:j] = [a if a == b else whole] * (j - i)
        i = max(j, i + 1)
    level = [2 * rtl if s == "L" else 1 if s == "R" else 2 for s in settled]
    units = list(zip(level, text))
    for least in (2, 1):
        i = 0
        while i < len(units):
            j = i
            while j < len(units) and units[j][0] >= least:
                j += 1
            units[i:j] = units[i:j][::-1]
            i = max(j, i + 1)
    turned = {"(": ")", ")": "(", "[": "]", "]": "["}
    return "".join(turned.get(c, c) if v == 1 else c for v, c in units)


def test_logical_order_matches_the_walk(spark):
    r = random.Random(8)
    lines = [(r.randrange(12), k, "".join(r.choice("אבגדהabc12,.$%-() [") for _ in range(r.randint(0, 14)))) for k in range(400)]
    lines += [(1, 400 + k, t) for k, t in enumerate(["3/5.", "אב", "3/5.", "", "(1)", "ab", "3/5."])] + [(99, 0, None)]
    found = {(x.d, x.k): (x.t, x.right_to_left) for x in bidi.logical_order(spark.createDataFrame(lines, "d int, k int, t string"), "d", "k", "t").withColumnRenamed("text", "t").collect()}
    assert len(found) == len(lines)
    right = {}
    for d, k, t in sorted(lines, key=lambda x: (x[0], x[1])):
        t = t or ""
        rights, lefts = sum("א" <= c <= "ת" for c in t), sum(c in "abc" for c in t)
        right[d] = rights > lefts if rights + lefts else right.get(d, False)
        turns = rights > 0 or (lefts == 0 and right[d])
        assert found[d, k] == (plain_order(t, right[d]) if turns else t, right[d]), t


def test_lines_without_such_letters_stay_whole(spark):
    plan = bidi.logical_order(spark.createDataFrame([(1, 1, "abc")], "d int, k int, t string"), "d", "k", "t")
    assert plan.first().text == "abc"
    runs = bidi.segments(spark.createDataFrame([(1, "ab אב 1"), (2, " a"), (3, ""), (4, None)], "k int, t string"), ["k"], "t").orderBy("k", "n").collect()
    assert [(x.k, x.first, x.length, x.direction) for x in runs] == [
        (1, 0, 0, "neutral"), (1, 0, 2, "left"), (1, 2, 1, "neutral"), (1, 3, 2, "right"), (1, 5, 1, "neutral"), (1, 6, 1, "weak"), (2, 0, 1, "neutral"), (2, 1, 1, "left"),
    ]


def test_elements_of_awkward_pages(spark):
    from paginarium.operators import structure

    pages = [(1, "<!DOCTYPE html><div><p>a<br>b</p><script>var t='<p>';</script><ul><li>x<li>y</ul></div>"), (2, "</div></p><p><b>z</b>"), (3, ""), (4, None), (5, "<!-- <p> --><i>1 < 2</i>")]
    found = structure.elements(spark.createDataFrame(pages, "page_id int, html string"), "page_id", "html").orderBy("page_id", "n").collect()
    assert [(x.page_id, x.tag, x.depth) for x in found] == [
        (1, "div", 1), (1, "p", 2), (1, "ul", 2), (1, "li", 3), (1, "li", 4), (2, "p", -1), (2, "b", 0), (5, "i", 1),
    ]
