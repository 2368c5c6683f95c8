"""Conversation structure repair: a Viterbi search with survivor coalescence.

A sound conversation is ``(s?(ua)+)?`` in the initials of its roles. Rows may be kept
(K, 0), given the role user or assistant (R, 1), deleted (D, 2; the only choice for a
blank row or a duplicate), and empty user or assistant rows may be inserted anywhere
(I, 5); a truncated row that stays adds 5. The cheapest edits are found; of equally cheap
ones the audit (their initials in order) that sorts first.

The search reads a conversation row by row. After each row at most four survivors are
left, one per state of the pattern: nothing yet, after s, after u, after a. They are the
leaves of a tree of backpointers that counts references: a node nobody refers to goes,
and as soon as all survivors share an ancestor, the edits up to it are certain and are
emitted. A survivor that another one can follow through to the end for less (or for the
same and with an audit that sorts before) can never win and is dropped at once; without
that, "nothing yet" would stay to the end as a path of deletions. So a task holds the
unresolved rows of one conversation only, however long the conversation is.

Ties are settled by the complete unresolved audits. Two survivors of one row have read
the same number of rows, so neither audit is the beginning of the other, and they differ
(an audit decides its state). Their order is therefore fixed for good by what they hold
now, and every survivor carries its rank in that order: comparing (rank, edits of this
row) compares the whole suffixes.

A row repeats an earlier one if its conversation has a row of that role and text at a
smaller turn (found by an aggregate joined back, which holds no conversation together),
or if it follows an equal row of its own turn.

SHA-256 of a whole conversation is sequential by definition; a conversation is one
stream through one task, with bounded memory.

Defined results. A null role or text counts as one space. Rows of a conversation are
ordered by turn (null first), then role, text. Rows with a null conversation id are one
conversation. Equal rows are duplicates of the first. A role that begins with s, u or a
can be kept; any other, the empty one included, must be replaced or deleted. A
conversation without rows has zeros, an empty audit and the hash of nothing. An empty
table gives an empty table. Columns other than the four named are neither read nor
passed on, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import read, ship

# Fixed values of the contract: costs of the edits, white space, the end of a sentence.
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> {initial of the next role: next state}
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
#: MIMIC[q][p]: whatever follows state p can follow state q at so much more at most: after
#: an assistant the same rows may follow as at the start (a kept s is deleted instead) or
#: after s; other states get there by inserting what is missing.
MIMIC = {
    START: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {START: 2 * INSERT + DELETE, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}
LEGAL = {"su", "ua", "au"}


def _inserts(state: int) -> list[tuple[int, tuple[str, ...]]]:
    """States reached by inserting, each with the initials inserted on the shortest way."""
    found, way = {state: ()}, state
    path: tuple[str, ...] = ()
    while True:
        initial = next(i for i in NEXT[way] if i in ROLES)
        way, path = NEXT[way][initial], (*path, initial)
        if way in found:
            return list(found.items())
        found[way] = path


@cache
def moves(initial: str, gone: bool, cut: bool) -> list[tuple[int, int, int, str, tuple[str, ...]]]:
    """What one row allows: (state before, state after, cost, edits, role initials of the
    edits, "" for the row's own), the best one for each pair of states."""
    best: dict[tuple[int, int], tuple] = {}
    for state in NEXT:
        for ready, put in _inserts(state):
            head, cost = "I" * len(put), INSERT * len(put)
            choices = [(ready, cost + DELETE, head + "D", (*put, ""))]
            if not gone:
                extra = cost + (CUT if cut else 0)
                if initial in NEXT[ready]:
                    choices.append((NEXT[ready][initial], extra, head + "K", (*put, "")))
                choices += [
                    (after, extra + REROLE, head + "R", (*put, i)) for i, after in NEXT[ready].items() if i in ROLES
                ]
            for after, c, edits, roles in choices:
                key = (state, after)
                if key not in best or (c, edits) < best[key][:2]:
                    best[key] = (c, edits, roles)
    return [(a, b, *v) for (a, b), v in sorted(best.items())]


class Node:
    """One edit in the tree of backpointers. ``kids`` are the nodes that refer to it."""

    __slots__ = ("parent", "edit", "initial", "row", "kids", "leaf")

    def __init__(self, parent: Node | None, edit: str, initial: str, row):
        self.parent, self.edit, self.initial, self.row = parent, edit, initial, row
        self.kids: list[Node] = []
        self.leaf = False
        if parent is not None:
            parent.kids.append(self)


class Repair:
    """The search over one conversation. ``emit(edit, initial, row)`` is called for each
    edit in order once it is certain; ``initial`` is the role an I or R gives."""

    def __init__(self, emit: Callable[[str, str, tuple | None], None]):
        self.emit = emit
        self.root = Node(None, "", "", None)
        self.root.leaf = True
        self.survivors = {START: (0, 0, self.root)}  # state -> cost, rank, leaf
        self.cost = 0

    def step(self, initial: str, gone: bool, cut: bool, row) -> None:
        best: dict[int, tuple] = {}
        for before, after, cost, edits, roles in moves(initial, gone, cut):
            held = self.survivors.get(before)
            if held is None:
                continue
            key = (held[0] + cost, held[1], edits)
            if after not in best or key < best[after][0]:
                best[after] = (key, held[2], edits, roles)
        order = sorted(best, key=lambda state: best[state][0][1:])
        # (cost, rank) of what another survivor would end with in this one's place
        worth = {state: (best[state][0][0], rank) for rank, state in enumerate(order)}
        order = [
            p
            for p in order
            if not any(q != p and (worth[q][0] + MIMIC[q][p], worth[q][1]) < worth[p] for q in order)
        ]
        old = [leaf for _, _, leaf in self.survivors.values()]
        self.survivors = {}
        for rank, state in enumerate(order):
            key, leaf, edits, roles = best[state]
            for e, i in zip(edits, roles, strict=True):
                leaf = Node(leaf, e, i, row if e != "I" else None)
            leaf.leaf = True
            self.survivors[state] = (key[0], rank, leaf)
        for leaf in old:
            leaf.leaf = False
            self._release(leaf)
        self._settle()

    def _release(self, node: Node) -> None:
        while not node.kids and not node.leaf and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            node.parent = None
            node = parent

    def _settle(self) -> None:
        """Emit what all survivors share."""
        while len(self.root.kids) == 1 and not self.root.leaf:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.emit(self.root.edit, self.root.initial, self.root.row)
            self.root.row = None

    def finish(self) -> int:
        """Emit the rest; the cost of all edits."""
        ends = []
        for state, (cost, rank, leaf) in self.survivors.items():
            for after, put in _inserts(state):
                if after in (START, ASSISTANT):
                    ends.append((cost + INSERT * len(put), rank, len(put), put, leaf))
        cost, _, _, put, leaf = min(ends, key=lambda e: e[:3])
        for i in put:
            leaf = Node(leaf, "I", i, None)
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.parent
        for node in reversed(path):
            self.emit(node.edit, node.initial, node.row)
        return cost


class Report:
    """Counts, audit and hash of one conversation, filled row by row."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.before = self.role = None
        self.rows = 0
        self.audit = bytearray()
        self.hash = hashlib.sha256()
        self.lines = 0
        self.search = Repair(self.put)

    def put(self, edit: str, initial: str, row) -> None:
        self.audit += edit.encode()
        if edit != "D":
            role, text = row if row else ("", "")
            line = f"{ROLES[initial] if initial else role}:{text}".encode()
            self.hash.update(b"\n" + line if self.lines else line)
            self.lines += 1

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.rows:
            self.illegal += self.role + initial not in LEGAL
        self.role = initial
        self.rows += 1
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        gone = fault in ("blank", "duplicate")
        self.search.step(initial if initial in ("s", "u", "a") else "", gone, fault == "truncated", (role, text))

    def result(self) -> tuple:
        cost = self.search.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (
            self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
            self.audit.decode(), self.hash.hexdigest(),
        )


class Lines(Report):
    """The repaired rows of one conversation instead of its report."""

    def __init__(self, conv_id):
        super().__init__(conv_id)
        self.out: list[tuple] = []

    def put(self, edit: str, initial: str, row) -> None:
        if edit != "D":
            role, text = row if row else ("", "")
            self.out.append((self.conv_id, self.lines, edit, ROLES[initial] if initial else role, text))
            self.lines += 1


def faults(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, lost=None) -> DataFrame:
    """(conv_id, turn, role, text, lost, fault, again): the first fault of each row.
    ``again`` marks rows that an earlier turn has; rows where ``lost`` holds only stand
    for their conversation."""
    lost = F.lit(False) if lost is None else lost
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
        lost.alias("lost"),
    )
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("content", content)
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = rows.withColumn(
        "fault",
        F.when(trimmed == "", F.lit("blank")).when(~F.substring(trimmed, -1, 1).isin(*ENDS), F.lit("truncated")),
    )
    # a null turn comes before all others
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
    met = rows.filter(~F.col("lost")).groupBy("conv_id", "content").agg(first, F.count(F.lit(1)).alias("n"))
    met = met.filter("n > 1").select(F.col("conv_id").alias("c"), F.col("content").alias("h"), "first.turn", "n")
    met = met.withColumnRenamed("turn", "first_turn")
    joined = rows.join(met, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("content") == F.col("h")), "left")
    again = F.col("n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return joined.select("conv_id", "turn", "role", "text", "lost", "fault", again.alias("again"))


def _stream(make: type[Report], names: list[str], schema: T.StructType) -> Callable:
    """Rows sorted by conversation and turn, through one ``make`` a conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, done = None, None, []
        for batch in batches:
            for conv_id, turn, role, text, lost, fault, again in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        result = now.result()
                        done += now.out if make is Lines else [result]
                    now, last = make(conv_id), None
                if not lost:
                    if fault != "blank" and (again or last == (turn, role, text)):
                        fault = "duplicate"
                    last = (turn, role, text)
                    now.add(turn, role, text, fault)
                if make is Lines and len(now.out) > 1000:
                    done += now.out
                    now.out = []
                if len(done) > 1000:
                    yield pack(done)
                    done = []
        if now is not None:
            result = now.result()
            done += now.out if make is Lines else [result]
        if done:
            yield pack(done)

    return run


_COLUMNS = ["conv_id", "turn", "role", "text", "lost", "fault", "again"]


def _run(rows: DataFrame, make: type[Report], fields: list[tuple[str, str]]) -> DataFrame:
    ship(rows.sparkSession)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(", ".join([f"conv_id {conv_type}", *(f"{n} {t}" for n, t in fields)]))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.select(*_COLUMNS).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(_stream(make, _COLUMNS, schema), schema)


def repaired(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The repaired conversations: (conv_id, position, edit, role, text), edit K, R or I."""
    rows = faults(turns, conv_col, turn_col, role_col, text_col)
    return _run(rows, Lines, [("position", "long"), ("edit", "string"), ("role", "string"), ("text", "string")])


def report(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    lost=None,
) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and the hash of its repaired
    rows. Rows where ``lost`` (a column) holds are gone, their conversations stay."""
    rows = faults(turns, conv_col, turn_col, role_col, text_col, lost)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return _run(rows, Report, [*((c, "long") for c in counts), ("audit", "string"), ("repaired_sha256", "string")])


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of "conv_id:turn" a row in twenty each is lost
    (``lost``), emptied, stripped of sentence ends, repeated, or made the user's. Nulls,
    in the key too, are one space."""
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)
    )
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, F.lit("")).when(
        F.col("kind") == 2, F.translate("text", ".!?", "")
    ).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: repair report of every damaged conversation."""
    damaged = damage(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return report(damaged, lost=F.col("lost"))


def crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned crc32 of an ASCII text."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen({text})::BIGINT), "
        f"lambda i: ascii(substr({text}, i::BIGINT + 1, 1))::UBIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0,1,2,3,4,5,6,7]::UBIGINT[]), "
        "lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), "
        "4294967295::UBIGINT)"
    )


def _best(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _put(state: str, cost, edit: str, line: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}}"


def _sql() -> str:
    """The search as a recursive query: per conversation and row the four states, each
    the least (cost, audit, repaired text)."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    # inserting: user from all but the state after u, then assistant
    closed = f"""SELECT * REPLACE ({_best("a", _put("u", 5, "I", assistant))} AS a) FROM (
      SELECT * REPLACE ({_best("u", _put("n", 5, "I", user), _put("s", 5, "I", user), _put("a", 5, "I", user))} AS u)
      FROM ({{rows}}))"""
    never = 1_000_000_000

    def stay(state: str) -> str:
        return _put(state, 2, "D", "''")

    def keep(state: str, initial: str) -> str:
        cost = f"(CASE WHEN gone OR initial <> '{initial}' THEN {never} ELSE cut END)"
        return _put(state, cost, "K", "chr(10) || role || ':' || text")

    def give(state: str, role: str) -> str:
        return _put(state, f"(CASE WHEN gone THEN {never} ELSE cut + 1 END)", "R", f"chr(10) || '{role}:' || text")

    step = f"""SELECT conv_id, i,
    {stay("n")} AS n,
    {_best(stay("s"), keep("n", "s"))} AS s,
    {_best(stay("u"), *(f(x, y) for x in "nsa" for f, y in ((keep, "u"), (give, "user"))))} AS u,
    {_best(stay("a"), keep("u", "a"), give("u", "assistant"))} AS a
  FROM ({closed.replace("{rows}", "SELECT p.conv_id, r.i, p.n, p.s, p.u, p.a, r.gone, r.cut, r.initial, r.role, r.text "
                            "FROM search p JOIN numbered r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1")})"""
    empty = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    none = f"{{'c': {never}::BIGINT, 'a': '', 't': ''}}"
    return f"""WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("k")} % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, {white}) AS trimmed FROM damaged),
faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM ordered),
numbered AS (
  SELECT conv_id, i, role, text, left(role, 1) AS initial, fault IN ('blank', 'duplicate') AS gone,
    CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut FROM faulty),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
search AS (
  SELECT conv_id, 0::BIGINT AS i, {empty} AS n, {none} AS s, {none} AS u, {none} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  {step}),
ends AS (
  SELECT conv_id, i, {_best("n", "a")} AS e FROM ({closed.replace("{rows}", "SELECT * FROM search")}))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.e.c::BIGINT AS cost, e.e.a AS audit,
  sha256(substr(e.e.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
WHERE e.i = coalesce(c.n, 0)"""


ORACLE_SQL = _sql()
