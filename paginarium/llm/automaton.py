"""Byte-pair encoding by a deterministic tokenization automaton.

Compilation goes through the merges in order. Before the first merge there is one
state with an arc per byte. The gadget of merge k, ``u v -> w``, leaves the state
that u leads to, makes a copy of it without the arc v, lets u lead to the copy from
then on, and adds an arc w wherever u and then v could be read; w leads where v
leads. Every arc with one label leads to one state, so a state is named by the label
read last, and what the gadgets have changed is kept as (u, v) -> k together with
each label's left and right part. Whether the state after a has the arc b follows
from that record: some gadget (y, x), with y a right part of a that a had not yet
left behind at time k and x a left part of b that b had not grown out of at k, cuts
it. Cells of the transition table are worked out when first needed and kept.

The automaton accepts exactly one segmentation of every word, so a path that spells
the word is the encoding. Encoding tries the longest arc first; where that path ends
early, a linear pass over all byte positions finds the path. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from paginarium.llm.tokens import WordEncoder, one_by_one

#: Transition cells kept per process.
CELLS = 2_000_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenAutomaton:
    def __init__(self, path: str):
        import regex

        model = json.load(open(path, encoding="utf-8"))
        vocab, symbol = model["model"]["vocab"], byte_symbols()
        self.specials = {x["content"]: x["id"] for x in model["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.label: list[bytes] = [b""] * size
        for text, k in vocab.items():
            self.label[k] = bytes(symbol[c] for c in text)
        for text, k in self.specials.items():
            self.label[k] = text.encode()
        self.never = len(model["model"]["merges"])
        self.gadget: dict[int, int] = {}
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        for k, (u, v) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]):
            self._merge(k, vocab[u], vocab[v], vocab[u + v])
        # labels by their bytes; one that no gadget makes, unless it is a byte, is on no path
        self.arc_of = {self.label[k]: k for k in vocab.values() if self.made[k] >= 0 or len(self.label[k]) == 1}
        self.longest = max(map(len, self.arc_of), default=1)
        self.step, self.token = {}, [-1]
        for label, k in self.arc_of.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(self.token)
                    self.token.append(-1)
                node = self.step[key]
            self.token[node] = k
        self.cells: dict[int, bool] = {}
        self.presplit = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None

    def _merge(self, k: int, u: int, v: int, w: int) -> None:
        self.gadget.setdefault(u << 20 | v, k)
        if self.made[w] < 0:
            self.left[w], self.right[w], self.made[w] = u, v, k

    def has_arc(self, a: int, b: int) -> bool:
        """Whether the state after label a has the arc b."""
        key = a << 20 | b
        known = self.cells.get(key)
        if known is None:
            known = self._cell(a, b)
            if len(self.cells) >= CELLS:
                self.cells.clear()
            self.cells[key] = known
        return known

    def _cell(self, a: int, b: int) -> bool:
        y, until_y = a, self.never
        while y >= 0:
            x, until_x = b, self.never
            while x >= 0:
                k = self.gadget.get(y << 20 | x, -1)
                if 0 <= k < until_y and k <= until_x:
                    return False
                until_x, x = self.made[x], self.left[x]
            until_y, y = self.made[y], self.right[y]
        return True

    def word(self, w: bytes) -> list[int]:
        """The path that spells the bytes of a pre-split word."""
        n, step, token, cells, path, at, last = len(w), self.step, self.token, self.cells, [], 0, -1
        while at < n:
            found, node, k = [], 0, at
            while k < n:
                node = step.get(node << 8 | w[k])
                if node is None:
                    break
                k += 1
                if token[node] >= 0:
                    found.append(token[node])
            while found:
                t = found.pop()
                if last < 0:
                    break
                arc = cells.get(last << 20 | t)
                if arc or (arc is None and self.has_arc(last, t)):
                    break
            else:
                return self._all_positions(w)
            path.append(t)
            last = t
            at += len(self.label[t])
        return path

    def _all_positions(self, w: bytes) -> list[int]:
        n, last = len(w), {0: -1}
        for at in range(n):
            a = last.get(at)
            if a is None:
                continue
            for end in range(at + 1, min(n, at + self.longest) + 1):
                t = self.arc_of.get(w[at:end])
                if t is not None and end not in last and (a < 0 or self.has_arc(a, t)):
                    last[end] = t
        path, at = [], n
        while at:
            path.append(last[at])
            at -= len(self.label[last[at]])
        return path[::-1]

    def text(self, text: str) -> list[int]:
        """Special strings stand for themselves; the rest is pre-split into words."""
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else (text,):
            if part in self.specials:
                ids.append(self.specials[part])
            else:
                for w in self.presplit.findall(part):
                    ids += self.word(w.encode())
        return ids

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


_AUTOMATA: dict[str, tuple[TokenAutomaton, WordEncoder]] = {}


def automaton(path: str) -> tuple[TokenAutomaton, WordEncoder]:
    if path not in _AUTOMATA:
        a = TokenAutomaton(path)
        _AUTOMATA[path] = a, WordEncoder(one_by_one(a.text), spaced=True)
    return _AUTOMATA[path]


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: ids (array), decoded text and their digests.

    A null text counts as empty (no ids, empty text); repeated rows give repeated rows, a
    null doc_id stays null; a text of any length is encoded whole; an empty table gives no
    rows; other columns, whatever their names, are not read. No shuffle: each row depends
    on itself alone.
    """
    from pyspark.sql import functions as F

    def run(batches):
        import pyarrow as pa

        a, encoder = automaton(path)
        decimal = [str(k) for k in range(len(a.label))]
        for batch in batches:
            ids_of = batch.column(0)
            for k, flat, counts in encoder.batches(batch.column(1)):
                rows, at = [], 0
                for n in counts:
                    ids = flat[at : at + n].tolist()
                    at += n
                    # invalid UTF-8 can't occur in an encoding of a string
                    decoded = a.decode(ids)
                    decoded.decode("utf-8")
                    joined = ",".join(map(decimal.__getitem__, ids)).encode()
                    rows.append((int(n), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                cols = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(k, len(rows)).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
