"""Repair of the role structure of conversations by a generalised LR parser.

The roles of a sound conversation are `(s?(ua)+)?` by their initials. SLR tables of that grammar drive a graph-structured
stack over the rows of a conversation in order: each stack may keep a row, rerole it, delete it, or insert a row before
it, at a price, and of stacks with equal tops that of the least (cost, audit) stays. An audit is the initials of the edits.
The tops are as many as the parser has states, so a row costs a bounded amount of work, however long the conversation.

Conversations are sorted within partitions and pass through a task row by row, never gathered: a stack carries its cost,
a hash of its repaired text so far and how its audit compares to the other stacks' audits, and a row leaves a few bytes
behind to read the audit back from. The digest of a conversation is one of all its text in order, so the rows of one
conversation, however many, follow each other in one task; nothing else meets there. Rows that repeat an earlier role and
text are found before, by groups of (conversation, role, digest of the text) that hold more than one row.

Defined cases: null roles and texts are one space; a row with an empty role has no initial and can't be kept. Null conversation ids make up a conversation, null turns come first.
Rows of one turn are in order of role, then text. A conversation that has lost its rows has zeros, an empty audit and the
hash of nothing. Texts are hashed as they pass, whatever their length. Columns beside the four are not read. Empty tables
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .periodic_runs import CRC_TABLE, crc_sql
from .store import table

#: The role grammar: heads and bodies, the start symbol first. End of input is "$".
GRAMMAR = [("S", "C"), ("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua")]
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


class Parser:
    """SLR tables of a grammar of one-letter symbols. Stacks are tuples of states."""

    def __init__(self, grammar: list[tuple[str, str]]):
        self.grammar = grammar
        heads = {h for h, _ in grammar}
        empty, first, follow = set(), {h: set() for h in heads}, {h: set() for h in heads}
        follow[grammar[0][0]].add("$")

        def begins(symbols: str) -> tuple[set, bool]:
            out: set = set()
            for x in symbols:
                out |= first[x] if x in heads else {x}
                if x not in empty:
                    return out, False
            return out, True

        size = -1
        while size != (size := len(empty) + sum(len(s) for d in (first, follow) for s in d.values())):
            for head, body in grammar:
                got, nothing = begins(body)
                first[head] |= got
                if nothing:
                    empty.add(head)
                for k, x in enumerate(body):
                    if x in heads:
                        got, nothing = begins(body[k + 1 :])
                        follow[x] |= got | (follow[head] if nothing else set())

        def closed(items: set) -> frozenset:
            items, new = set(items), list(items)
            while new:
                rule, dot = new.pop()
                if (x := grammar[rule][1][dot : dot + 1]) in heads:
                    more = {(r, 0) for r, (h, _) in enumerate(grammar) if h == x} - items
                    items |= more
                    new += more
            return frozenset(items)

        states, self.goto, self.reduce = [closed({(0, 0)})], {}, {}
        for i, items in enumerate(states):  # states grow meanwhile
            for x in {grammar[r][1][d] for r, d in items if d < len(grammar[r][1])}:
                to = closed({(r, d + 1) for r, d in items if grammar[r][1][d : d + 1] == x})
                if to not in states:
                    states.append(to)
                self.goto[i, x] = states.index(to)
            for r, d in items:
                if d == len(grammar[r][1]):
                    for x in follow[grammar[r][0]]:
                        if (i, x) in self.goto or self.reduce.setdefault((i, x), r) != r:
                            raise ValueError("the grammar is not SLR")
        self.size = len(states)
        self.known: dict[tuple, tuple | None] = {}

    def move(self, stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
        """The stack after its reductions before a symbol and the symbol's shift; None if it fits not. For "$", the stack itself if all is accepted."""
        key = (stack, symbol)
        if key not in self.known:
            at: tuple | None = stack
            while (rule := self.reduce.get((at[-1], symbol))) is not None:
                head, body = self.grammar[rule]
                if rule == 0:
                    break
                at = at[: len(at) - len(body)]
                at = (*at, self.goto[at[-1], head])
            if symbol == "$":
                self.known[key] = stack if rule == 0 else None
            else:
                to = self.goto.get((at[-1], symbol))
                self.known[key] = None if to is None else (*at, to)
        return self.known[key]


class Top:
    """A stack of the graph: its cost, and its edits since `parent`, a number of the tops before."""

    __slots__ = ("cost", "edits", "parent", "stack")

    def __init__(self, stack, cost, parent, edits):
        self.stack, self.cost, self.parent, self.edits = stack, cost, parent, edits


class Repair:
    """One conversation's graph-structured stack. Feed it rows, then ask for its end."""

    def __init__(self, parser: Parser):
        self.parser = parser
        self.tops = [Top((0,), 0, 0, "")]
        self.hashes = [(hashlib.sha256(), False)]
        #: What is left of two tops' audits behind their common beginning, cut where they differ.
        self.rest = {(0, 0): ("", "")}
        self.steps: list[bytes] = []
        self.codes: dict[tuple[int, str], int] = {}

    def less(self, a: Top, b: Top) -> bool:
        if a.cost != b.cost:
            return a.cost < b.cost
        x, y = self.rest[a.parent, b.parent]
        return x + a.edits < y + b.edits

    def best(self, candidates: list[Top]) -> list[Top]:
        out: dict[int, Top] = {}
        for c in candidates:
            if (old := out.get(c.stack[-1])) is None or self.less(c, old):
                out[c.stack[-1]] = c
        return list(out.values())

    def inserted(self, tops: list[Top]) -> list[Top]:
        """The tops and those that inserted rows lead to."""
        out = new = self.best(tops)
        while new:
            more = [Top(s, t.cost + INSERT, t.parent, t.edits + "I") for t in new for x in ROLES if (s := self.parser.move(t.stack, x))]
            both = self.best(out + more)
            new = [t for t in both if not any(t is o for o in out)]
            out = both
        return out

    def kept_on(self, tops: list[Top], role: str, text: str) -> None:
        """These tops take the place of those before: hashes and comparisons of audits go on."""
        hashes = []
        for t in tops:
            h, some = self.hashes[t.parent]
            if t.edits.strip("D"):
                h = h.copy()
                # The roles of edits follow from the parser's states: a user's row comes before an assistant's.
                stack = self.before[t.parent]
                for e in t.edits:
                    if e == "D":
                        continue
                    x = role[:1] if e == "K" else next(x for x in ROLES if self.parser.move(stack, x))
                    stack = self.parser.move(stack, x)
                    h.update(f"{chr(10) * some}{role if e == 'K' else ROLES[x]}:".encode())
                    if e != "I":
                        h.update(text.encode())
                    some = True
            hashes.append((h, some))
        rest = {}
        for i, a in enumerate(tops):
            for j, b in enumerate(tops):
                x, y = self.rest[a.parent, b.parent]
                x, y = x + a.edits, y + b.edits
                k = 0
                while k < min(len(x), len(y)) and x[k] == y[k]:
                    k += 1
                rest[i, j] = (x[k : k + 1], y[k : k + 1]) if k < min(len(x), len(y)) else (x[k:], y[k:])
        self.steps.append(bytes(self.codes.setdefault((t.parent, t.edits), len(self.codes)) for t in tops))
        self.tops, self.hashes, self.rest = [Top(t.stack, t.cost, i, "") for i, t in enumerate(tops)], hashes, rest

    @property
    def before(self) -> list[tuple]:
        return [t.stack for t in self.tops]

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        move, more, out = self.parser.move, TRUNCATED if truncated else 0, []
        for t in self.inserted(self.tops):
            out.append(Top(t.stack, t.cost + DELETE, t.parent, t.edits + "D"))
            if not must_go:
                if s := move(t.stack, role[:1]):
                    out.append(Top(s, t.cost + more, t.parent, t.edits + "K"))
                out += [Top(s, t.cost + REROLE + more, t.parent, t.edits + "R") for x in ROLES if (s := move(t.stack, x))]
        self.kept_on(self.best(out), role, text)

    def end(self) -> tuple[int, str, str]:
        """Cost, audit, and hash of the repaired text."""
        whole = None
        for t in self.inserted(self.tops):
            if self.parser.move(t.stack, "$") and (whole is None or self.less(t, whole)):
                whole = t
        self.kept_on([whole], "", "")
        told, at, out = {v: k for k, v in self.codes.items()}, 0, []
        for step in reversed(self.steps):
            at, edits = told[step[at]]
            out.append(edits)
        return whole.cost, "".join(reversed(out)), self.hashes[0][0].hexdigest()


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (copies) with blank, again (the role and text of a row of an earlier turn) and truncated."""
    rows = rows.withColumn("_digest", F.md5(F.col("text")))
    key = ["conv_id", "role", "_digest"]
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    groups = rows.filter("n > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), F.min(order).alias("_first")).filter("_rows > 1")
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in key], "_first")
    met = rows.join(groups, rows["conv_id"].eqNullSafe(groups["_conv_id"]) & (rows["role"] == groups["_role"]) & (rows["_digest"] == groups["__digest"]), "left")
    return met.select(
        "conv_id", "turn", "role", "text", "n", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        F.coalesce(order > F.col("_first"), F.lit(False)).alias("again"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )


REPORT = "conv_id {0}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def repair(rows: DataFrame) -> DataFrame:
    """A report of each conversation: its faults, the cheapest edits and the digest of what they leave. rows are conv_id, turn, role,
    text and, if there are copies that follow each other, n, how many: 0 for a row that is gone while its conversation is to be told."""
    rows = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "n")
    schema = REPORT.format(rows.schema["conv_id"].dataType.simpleString())
    kind = {"bigint": pa.int64(), "string": pa.string()}
    dealt = flagged(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, out, conv, at = Parser(GRAMMAR), [], None, None
        turns = counts = last = None

        def done():
            lowest, highest, distinct, _ = turns
            gaps = highest - lowest + 1 - distinct if distinct else 0
            return (conv, gaps, *(counts[k] for k in ("blank", "duplicate", "truncated", "illegal")), *at.end())

        def batch_of(told):
            cols = list(zip(*told, strict=True))
            kinds = [like, *[kind["bigint"]] * 6, kind["string"], kind["string"]]
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            like, c = batch.schema.field("conv_id").type, {k: batch.column(k) for k in batch.schema.names}
            for i in range(batch.num_rows):
                own, turn, role, text, n, blank, again, truncated = (c[k][i].as_py() for k in ("conv_id", "turn", "role", "text", "n", "blank", "again", "truncated"))
                if at is None or own != conv:
                    if at is not None:
                        out.append(done())
                        if len(out) >= 1000:
                            yield batch_of(out)
                            out = []
                    conv, at, last = own, Repair(parser), None
                    turns, counts = [None, None, 0, None], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                for _ in range(n):
                    if turn is not None and turn != turns[3]:
                        turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1, turn]
                    row = (turn, role, text)
                    fault = "blank" if blank else "duplicate" if again or row == last else "truncated" if truncated else None
                    if fault:
                        counts[fault] += 1
                    if last is not None and last[1][:1] + role[:1] not in LEGAL:
                        counts["illegal"] += 1
                    at.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
                    last = row
        if at is not None:
            out.append(done())
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows that the report's audits leave: conv_id, seq from 0, role, text, edit (K, R or I) and the turn they had. rows as for repair()."""
    rows = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_copy"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("_k", F.row_number().over(place)).withColumnRenamed("conv_id", "_conv")
    edits = report.select("conv_id", F.posexplode(F.split("audit", "")).alias("_at", "edit")).filter("edit <> ''")
    by_place = Window.partitionBy("conv_id").orderBy("_at")
    edits = edits.withColumn("_of", F.sum((F.col("edit") != "I").cast("int")).over(by_place))
    met = edits.join(rows, edits["conv_id"].eqNullSafe(rows["_conv"]) & (edits["_of"] == rows["_k"]) & (edits["edit"] != "I"), "left").filter("edit <> 'D'")
    met = met.withColumn("seq", F.row_number().over(by_place) - 1)
    system = F.max(F.when((F.col("seq") == 0) & (F.col("edit") == "K"), F.substring("role", 1, 1) == "s")).over(Window.partitionBy("conv_id"))
    turn_of = (F.col("seq") - F.coalesce(system, F.lit(False)).cast("int")) % 2
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.when(turn_of == 0, "user").otherwise("assistant"))
    return met.select("conv_id", F.col("seq").cast("long").alias("seq"), role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit", "turn")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with some rows dropped (n is 0), emptied, cut, repeated (n is 2) or given to the user, by hash of conversation and turn."""
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(h == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("n"))


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged conversation's faults, cheapest repair and its digest."""
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _add(state: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {state} = '~' THEN '~' ELSE printf('%012d', CAST({state}[1:12] AS BIGINT) + {cost}) || {state}[13:] || '{edit}' END"


def _bind(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


_INSERT = lambda s, body: _bind(f"least({s}[3], {_add(f'{s}[1]', '5', 'I')}, {_add(f'{s}[2]', '5', 'I')}, {_add(f'{s}[4]', '5', 'I')})", "u", _bind(f"[{s}[1], {s}[2], u, least({s}[4], {_add('u', '5', 'I')})]", "v", body))
_COST = "(CASE WHEN r[3] = '1' THEN 5 ELSE 0 END)"


def _taken(kept: str, frm: list[int]) -> str:
    """States that a row leads to from these states, kept if its initial is so, else reroled."""
    keep = [f"CASE WHEN r[2] = '0' AND r[1] = '{kept}' THEN {_add(f'v[{s}]', _COST, 'K')} ELSE '~' END" for s in frm]
    turn = [f"CASE WHEN r[2] = '0' THEN {_add(f'v[{s}]', f'({_COST} + 1)', 'R')} ELSE '~' END" for s in frm if kept != "s"]
    return ", ".join(keep + turn)


_STEP = _INSERT("s", f"[{_add('v[1]', '2', 'D')}, least({_add('v[2]', '2', 'D')}, {_taken('s', [1])}), least({_add('v[3]', '2', 'D')}, {_taken('u', [1, 2, 4])}), least({_add('v[4]', '2', 'D')}, {_taken('a', [3])})]")

#: The same dynamic programme over the grammar's four states, folded over the rows as lists: (cost, audit) as text that orders so. Row texts are put together by the audit's places.
OP12_SQL = rf"""WITH {CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations, crc),
ids AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM c)),
d0 AS (SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c JOIN ids ON ids.conv_id IS NOT DISTINCT FROM c.conv_id),
d AS (SELECT k, turn, role, text, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d0),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault, lag(role[1]) OVER (PARTITION BY k ORDER BY n) || role[1] AS pair FROM d),
g AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list([role[1], CASE WHEN fault IN ('blank', 'duplicate') THEN '1' ELSE '0' END, CASE WHEN fault = 'truncated' THEN '1' ELSE '0' END] ORDER BY n) AS folded, list(role ORDER BY n) AS roles, list(text ORDER BY n) AS texts FROM f GROUP BY k),
o AS (SELECT *, list_reduce(folded, lambda s, r: {_STEP}, ['000000000000', '~', '~', '~']) AS s FROM g),
w AS (SELECT *, {_INSERT("s", "least(v[1], v[4])")} AS whole FROM o),
a AS (SELECT *, string_split(whole[13:], '') AS edits FROM w),
e AS (SELECT k, unnest(edits) AS edit, unnest(range(len(edits))) AS pos, roles, texts FROM a WHERE whole[13:] <> ''),
p AS (SELECT *, CAST(sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS BIGINT) AS place FROM e),
q AS (SELECT k, pos, edit, roles[place] AS role, texts[place] AS text, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS seq FROM p WHERE edit <> 'D'),
y AS (SELECT *, (seq - CAST(first_value(edit = 'K' AND role[1] = 's') OVER (PARTITION BY k ORDER BY pos) AS INTEGER)) % 2 AS parity FROM q),
z AS (SELECT k, string_agg((CASE WHEN edit = 'K' THEN role WHEN parity = 0 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY pos) AS body FROM y GROUP BY k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(whole[1:12] AS BIGINT), 0) AS cost, coalesce(whole[13:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN a USING (k) LEFT JOIN z USING (k)"""
