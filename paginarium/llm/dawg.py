"""Repair of damaged conversations over a suffix-shared automaton.

A conversation is a string of signs, one a row: its role (system, user, assistant,
other) and its first fault. What the cheapest repair of the rest costs depends on that
rest alone and on the grammar's state (nothing yet, after system, after user, after
assistant), so the strings of all conversations are minimised from the end: equal rests
are one node. The distinct strings are sorted by their reverse, in Spark; then
conversations with a common rest lie next to each other, and a task walks them with one
stack of nodes, the rest that neighbours share being kept. A node is thus worked out
once for all conversations (once a task for nodes on the border of two tasks): for each
grammar state its cost-to-go and the edit its best audit starts with. The edits
of one node and state start with different initials, so the ASCII-least of equally cheap
audits is the one whose first edit is least, and the best audit suffix needs no more
room than a letter and the state it leads to; a conversation's audit is read off the
stack.

Order within a conversation: turn (nulls first), role, digest of the text; rows equal in
all of these are adjacent. The strings are built from ranges of rows, not from whole
conversations, so a conversation with a third of all rows is dealt over many tasks until
its string (a byte a row, as its audit) is put together. SHA-256 takes a repaired text in
order, so there a conversation's texts pass one task, one row at a time from
Spark's sort, and are never held together.

Defined cases: a null role or text is one space, and so are null ids and turns where the
damage is drawn; rows with a null conv_id are one conversation; null turns come first
and have no part in the gaps; repeated rows are rows of their own (duplicates, unless
blank); roles besides the three can be deleted or given a role only; a conversation whose
rows are all dropped has zeros, an empty audit and the hash of the empty string; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paginarium.llm.common import settle

WHITE = " \t\n\x0b\f\r"
#: Signs: none, blank, duplicate, truncated, each by role (system, user, assistant, other).
SIGNS = "ABCDEFGHIJKLMNOP"
ROLES = "suao"
#: What the automaton tells apart: rows that may stay, rows that must go, truncated rows that may stay at a price.
REDUCED = "suaoxxxxxxxxSUAO"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The grammar ``(s?(ua)+)?``: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; it may end in 0 or 3.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that a rerole or an insertion gives in a state.
GIVES = "uuau"
NAMES = {"u": "user", "a": "assistant"}
#: Signs of a conversation that leave a task in one row at most.
CHUNK = 1 << 20
KEY, PLACE = ["no_id", "conv"], ["has_turn", "at_turn", "role", "digest"]


def keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``keyed`` rows with the damage done: ``n`` copies of each (0: dropped), its place and digest."""
    said = lambda present, value: F.when(present, value.cast("string")).otherwise(" ")
    draw = F.crc32(F.concat(said(~F.col("no_id"), F.col("conv")), F.lit(":"), said(F.col("turn").isNotNull(), F.col("turn"))).cast("binary")) % 20
    each = rows.withColumn("draw", draw)
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    each = each.withColumn("text", text).withColumn("role", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")))
    return each.select(
        *KEY, F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).cast("long").alias("at_turn"), "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).cast("long").alias("n"), "text",
    )


def signs(rows: DataFrame) -> DataFrame:
    """One row for each place of a conversation (rows equal in turn, role and text together) with its signs."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    light = rows.where("n > 0").select(*KEY, *PLACE, "n", (last == "").alias("blank"), (~last.isin(*".!?")).alias("cut"))
    places = light.groupBy(*KEY, *PLACE).agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    said = [*KEY, "role", "digest"]
    first = places.groupBy(*said).agg(F.min(F.struct("has_turn", "at_turn")).alias("first"))
    each = places.join(first, said)

    def sign(fault: int) -> Column:
        initial = F.left("role", F.lit(1))
        at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        return F.substring(F.lit(SIGNS), at + 4 * fault + 1, F.lit(1))

    again = F.repeat(sign(2), F.col("n").cast("int"))
    own = F.concat(F.when(F.col("cut"), sign(3)).otherwise(sign(0)), F.repeat(sign(2), (F.col("n") - 1).cast("int")))
    met = F.struct("has_turn", "at_turn") == F.col("first")
    return each.select(*KEY, *PLACE, F.when(F.col("blank"), F.repeat(sign(1), F.col("n").cast("int"))).when(met, own).otherwise(again).alias("signs"))


def strings(places: DataFrame) -> DataFrame:
    """The string of signs of every conversation, put together from ranges of its places."""

    def run(batches):
        key, place, held, size = None, None, [], 0

        def flush():
            columns = [[x] for x in (*key, *place, "".join(held))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        names = [*KEY, *PLACE, "signs"]
        kinds = [pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if held and (row[:2] != key or size >= CHUNK):
                    yield flush()
                    held, size = [], 0
                if not held:
                    key, place = row[:2], row[2:6]
                held.append(row[6])
                size += len(row[6])
        if held:
            yield flush()

    order = [*KEY, *PLACE]
    parts = places.select(*order, "signs").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.mapInArrow(run, "no_id boolean, conv long, has_turn boolean, at_turn long, role string, digest binary, signs string")
    together = F.array_sort(F.collect_list(F.struct(*PLACE, "signs")))
    return parts.groupBy(*KEY).agg(F.array_join(F.transform(together, lambda x: x.signs), "").alias("signs"))


def node(sign: str, rest: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Of a node: cost-to-go in each state and the initials of the edits that are best there.

    ``rest`` has the costs of the node that its one arc, labelled ``sign``, leads to.
    """
    stays, price = sign.lower() != "x", TRUNCATED if sign.isupper() else 0
    options = []
    for state in range(4):
        found = [(DELETE + rest[state], "D")]
        if stays:
            if (state, sign.lower()) in STEPS:
                found.append((KEEP + price + rest[STEPS[state, sign.lower()]], "K"))
            found.append((REROLE + price + rest[STEPS[state, GIVES[state]]], "R"))
        options.append(min(found))
    return inserted(options)


def inserted(options: list[tuple[int, str]]) -> tuple[tuple[int, ...], str]:
    """The best of each state's option and of insertions before it (after user an assistant, else a user)."""
    better = lambda state, to: min(options[state], (INSERT + to, "I"))
    after_user, after_assistant = better(2, options[3][0]), better(3, options[2][0])
    found = [better(0, after_user[0]), better(1, after_user[0]), after_user, after_assistant]
    return tuple(c for c, _ in found), "".join(e for _, e in found)


FAR = 1 << 40
#: (A blank stands for the audit's end.)
END = inserted([(0, " "), (FAR, " "), (FAR, " "), (0, " ")])


class Rests:
    """The nodes from the end to a string's begin, kept while strings sorted by their reverse go by."""

    def __init__(self) -> None:
        self.costs, self.edits, self.string = array("q", END[0]), [END[1]], ""
        self.interned: dict[str, str] = {}

    def enter(self, string: str) -> None:
        same = 0
        for x, y in zip(reversed(string), reversed(self.string)):
            if x != y:
                break
            same += 1
        del self.costs[4 * (same + 1) :], self.edits[same + 1 :]
        for sign in reversed(string[: len(string) - same]):
            now, best = node(sign, tuple(self.costs[-4:]))
            self.costs.extend(now)
            self.edits.append(self.interned.setdefault(best, best))
        self.string = string

    def audit(self) -> str:
        state, at, done = 0, len(self.string), []
        while edit := self.edits[at][state]:
            if edit == " ":
                break
            done.append(edit)
            if edit in "IR":
                state = STEPS[state, GIVES[state]]
            elif edit == "K":
                state = STEPS[state, self.string[len(self.string) - at].lower()]
            at -= edit != "I"
        return "".join(done)


def audits(reduced: DataFrame) -> DataFrame:
    """(reduced, cost, audit) of distinct strings; see the module for how nodes are shared."""

    def run(batches):
        rests = Rests()
        for batch in batches:
            found = []
            for string in batch.column(0).to_pylist():
                rests.enter(string)
                found.append((string, rests.costs[-4], rests.audit()))
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["reduced", "cost", "audit"])

    dealt = reduced.select("reduced", F.reverse("reduced").alias("backwards")).repartitionByRange("backwards").sortWithinPartitions("backwards")
    return dealt.select("reduced").mapInArrow(run, "reduced string, cost long, audit string")


class Repaired:
    """The hash of a conversation's repaired rows, fed with its damaged rows in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.empty = audit, 0, 0, hashlib.sha256(), True

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def give(self, text: str) -> None:
        given = GIVES[self.state]
        self.state = STEPS[self.state, given]
        self.write(NAMES[given], text)

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.give("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.give(text)
        elif edit == "K":
            self.state = STEPS[self.state, role[0]]
            self.write(role, text)

    def digest(self) -> str:
        self.insert()
        return self.hash.hexdigest()


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(no_id, conv, repaired_sha256): each audit, sent ahead of its conversation's rows, carried out on them."""

    def run(batches):
        key, now = None, None
        for batch in batches:
            done = []
            for no_id, conv, ahead, role, n, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if ahead:
                    if now is not None:
                        done.append((*key, now.digest()))
                    key, now = (no_id, conv), Repaired(text)
                else:
                    for _ in range(n):
                        now.row(role, text)
            yield made(done)
        if now is not None:
            yield made([(*key, now.digest())])

    def made(done):
        columns = zip(*done) if done else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.string()))], names=[*KEY, "repaired_sha256"])

    no = F.lit(False)
    ahead = found.select(*KEY, F.lit(True).alias("ahead"), no.alias("has_turn"), F.lit(0).cast("long").alias("at_turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("n"), F.col("audit").alias("text"))
    both = ahead.union(rows.where("n > 0").select(*KEY, no, *PLACE, "n", "text"))
    dealt = both.repartition(*KEY).sortWithinPartitions(*KEY, F.desc("ahead"), *PLACE)
    return dealt.select(*KEY, "ahead", "role", "n", "text").mapInArrow(run, "no_id boolean, conv long, repaired_sha256 string")


def repaired(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Per conv_id what is wrong with its damaged rows and how they are repaired at least cost."""
    rows = damaged(keyed(conversations))
    turn = F.when((F.col("n") > 0) & F.col("has_turn"), F.col("at_turn"))
    extent = rows.groupBy(*KEY).agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0)).alias("gaps"))
    facts = settle(spark, extent.join(strings(signs(rows)), KEY, "left").withColumn("signs", F.coalesce("signs", F.lit(""))), "signs")

    def count(fault: int) -> Column:
        return (F.length("signs") - F.length(F.translate("signs", SIGNS[4 * fault : 4 * fault + 4], ""))).cast("long")

    roles = F.translate("signs", SIGNS, ROLES * 4)
    legal = F.regexp_count(roles, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    facts = facts.withColumn("reduced", F.translate("signs", SIGNS, REDUCED))
    facts = facts.select(*KEY, "gaps", count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"), (F.greatest(F.length("signs") - 1, F.lit(0)) - legal).cast("long").alias("illegal"), "reduced")
    found = settle(spark, facts.join(audits(facts.select("reduced").distinct()), "reduced").drop("reduced"), "audits")
    told = found.join(digests(rows, found), KEY)
    return told.select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# The same by SQL: every row from a conversation's end backwards, four states carried as (cost, audit, text).


def _best(options: str) -> str:
    return f"list_min({options})"


def _next(state: int, role: str) -> str | None:
    to = STEPS.get((state, role))
    return None if to is None else f"w[{to + 1}]"


def _step(state: int) -> str:
    options = [f"{{'c': w[{state + 1}].c + 2, 'a': 'D' || w[{state + 1}].a, 't': w[{state + 1}].t}}"]
    for role in "sua":
        if to := _next(state, role):
            options.append(f"CASE WHEN stays AND left(role, 1) = '{role}' THEN {{'c': {to}.c + price, 'a': 'K' || {to}.a, 't': chr(10) || role || ':' || text || {to}.t}} END")
    given = GIVES[state]
    to = _next(state, given)
    options.append(f"CASE WHEN stays THEN {{'c': {to}.c + price + 1, 'a': 'R' || {to}.a, 't': chr(10) || '{NAMES[given]}:' || text || {to}.t}} END")
    return _best(f"[{', '.join(options)}]")


def _inserted(b: str, state: int, to: str) -> str:
    return _best(f"[{b}[{state + 1}], {{'c': {to}.c + 5, 'a': 'I' || {to}.a, 't': chr(10) || '{NAMES[GIVES[state]]}:' || {to}.t}}]")


_FAR = "{'c': 1000000000, 'a': '', 't': ''}"
_ENDED = "{'c': 0, 'a': '', 't': ''}"
ORACLE = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),
bits(i, v) AS (SELECT range, range FROM range(256)),
shifted AS (SELECT i, 0 AS k, v FROM bits UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM shifted WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM shifted WHERE k = 8),
drawn AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(x, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: xor(h >> 8, tab[(xor(h, c) & 255) + 1])), 4294967295) % 20 AS draw FROM k, crc_table),
done AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM done),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM ordered),
faulted AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
priced AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS price FROM faulted),
every AS (SELECT c.conv_id, coalesce(max(i), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN priced p ON p.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
walk AS (
  SELECT conv_id, n AS i, [{_ENDED}, {_FAR}, {_FAR}, {_ENDED}] AS b, false AS ready FROM every
  UNION ALL
  SELECT e.conv_id, e.i, e.b, e.ready FROM (
    SELECT z.conv_id, z.i, CASE WHEN z.ready THEN z.b ELSE [{_inserted('z.b', 0, 'z.u')}, {_inserted('z.b', 1, 'z.u')}, z.u, z.a] END AS b, true AS ready
    FROM (SELECT *, {_inserted('b', 2, 'b[4]')} AS u, {_inserted('b', 3, 'b[3]')} AS a FROM walk WHERE NOT ready) z
    UNION ALL
    SELECT w.conv_id, w.i - 1, [{', '.join(_step(s) for s in range(4))}], false
    FROM (SELECT conv_id, i, b AS w FROM walk WHERE ready AND i > 0) w JOIN priced p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i
  ) e
),
ends AS (SELECT conv_id, b[1] AS r FROM walk WHERE ready AND i = 0),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulted GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(r.c AS BIGINT) AS cost, r.a AS audit, sha256(substr(r.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""
