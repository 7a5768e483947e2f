"""Conversation structure repair by a weighted generalised LR parse.

The roles of a sound conversation follow a small grammar: nothing, or pairs of user and assistant after at most one system turn.  The parser is an
SLR automaton of that grammar over a graph-structured stack.  A row may be kept, given another role or deleted, and turns without text may be
inserted; each action has a cost and a letter in the audit.  Stacks are interned nodes (state, node below), so parses that come to equal stack tops
meet in one node, where the least (cost, audit) stays.

Audits that meet have handled the same rows, and those of equal cost are never prefixes of each other; so their order is that of their parents'
audits, then of the last letters, and ranks take the place of whole strings.  A row leaves a few bytes behind, for the audit; each top carries the
running hash of its repaired text.  A conversation is read as a sorted stream and never held as a whole, but its rows pass through one task, because
the hash of the repaired text reads them in order.  What can be told of a row without its neighbours, and repeated rows, are found before that.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The grammar, its terminals (initials of roles) and the costs of the edits.
GRAMMAR = (("C", ()), ("C", ("P",)), ("C", ("S", "P")), ("S", ("s",)), ("P", ("T",)), ("P", ("P", "T")), ("T", ("u", "a")))
END, KEEP, REROLE, DELETE, INSERT, TRUNCATED = "$", 0, 2, 3, 2, 1
#: Roles that rows may be given and that may be inserted.
ROLES = {"u": "user", "a": "assistant"}
ILLEGAL_UNLESS = {"su", "ua", "au"}
#: White space at the end of a text.
SPACE = " \t\n\x0b\x0c\r"


class Automaton:
    """SLR(1) automaton of a grammar whose first rule's left side is the start symbol."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...]):
        self.rules = (("start", (rules[0][0],)), *rules)
        self.heads = {a for a, _ in self.rules}
        empty, first = set(), {}
        follow: dict[str, set[str]] = {"start": {END}}
        while True:
            size = len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))
            for head, body in self.rules:
                if all(x in empty for x in body):
                    empty.add(head)
                for i, x in enumerate(body):
                    if all(y in empty for y in body[:i]):
                        first.setdefault(head, set()).update(first.get(x, set()) if x in self.heads else {x})
                    after = follow.setdefault(x, set())
                    for y in body[i + 1 :]:
                        after |= first.get(y, set()) if y in self.heads else {y}
                        if y not in empty:
                            break
                    else:
                        after |= follow.get(head, set())
            if size == (len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))):
                break
        self.follow = follow
        self.states = [self._closed({(0, 0)})]
        self.go: dict[tuple[int, str], int] = {}
        for i, items in enumerate(self.states):  # grows while it is read
            for x in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                to = self._closed({(r, d + 1) for r, d in items if d < len(self.rules[r][1]) and self.rules[r][1][d] == x})
                if to not in self.states:
                    self.states.append(to)
                self.go[i, x] = self.states.index(to)

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        items, todo = set(items), list(items)
        for r, d in todo:
            body = self.rules[r][1]
            for k, (head, _) in enumerate(self.rules):
                if d < len(body) and head == body[d] and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)

    def reductions(self, state: int, ahead: str) -> list[int]:
        return [r for r, d in self.states[state] if r and d == len(self.rules[r][1]) and ahead in self.follow[self.rules[r][0]]]


class Stacks:
    """The graph-structured stack: interned nodes (state, node below), and where a symbol leads from each."""

    def __init__(self, automaton: Automaton):
        self.lr, self.nodes, self.place = automaton, [(0, -1)], {(0, -1): 0}
        self.known: dict[tuple[int, str], tuple[int, ...]] = {}

    def _push(self, below: int, symbol: str) -> int | None:
        state = self.lr.go.get((self.nodes[below][0], symbol))
        if state is None:
            return None
        node = (state, below)
        if node not in self.place:
            self.place[node] = len(self.nodes)
            self.nodes.append(node)
        return self.place[node]

    def _reduced(self, top: int, ahead: str) -> set[int]:
        """All stacks that reductions lead to before ``ahead``, ``top`` included."""
        seen, todo = {top}, [top]
        for node in todo:
            for r in self.lr.reductions(self.nodes[node][0], ahead):
                head, body = self.lr.rules[r]
                below = node
                for _ in body:
                    below = self.nodes[below][1]
                to = self._push(below, head)
                if to is not None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    def shift(self, top: int, symbol: str) -> tuple[int, ...]:
        """Stack tops after ``symbol``, reductions that nothing can follow but all do made at once, so that equal parses meet."""
        if (top, symbol) not in self.known:
            tops = {to for node in self._reduced(top, symbol) if (to := self._push(node, symbol)) is not None}
            self.known[top, symbol] = tuple(sorted({self._settled(t) for t in tops}))
        return self.known[top, symbol]

    def _settled(self, top: int) -> int:
        while True:
            state = self.nodes[top][0]
            items = self.lr.states[state]
            if len(items) != 1 or (only := next(iter(items)))[1] < len(self.lr.rules[only[0]][1]) or not only[0]:
                return top
            head, body = self.lr.rules[only[0]]
            below = top
            for _ in body:
                below = self.nodes[below][1]
            if head == self.lr.rules[0][1][0]:
                return top  # the whole is only reduced at its end
            top = self._push(below, head)

    def accepts(self, top: int) -> bool:
        if (top, END) not in self.known:
            whole = self._push(0, self.lr.rules[0][1][0])
            self.known[top, END] = (1,) if whole in self._reduced(top, END) else ()
        return bool(self.known[top, END])


class Repair:
    """The parse of one conversation, row by row."""

    #: Letters before a row's action in an audit, and the action: a byte of the trace.
    ACTIONS = "DKR"

    def __init__(self, stacks: Stacks):
        self.stacks = stacks
        #: Stack top: (cost, rank among the tops' audits, hash of the repaired text or None before its first line).
        self.tops: dict[int, tuple[int, int, object]] = {0: (0, 0, None)}
        self.order = [0]
        #: For each row and rank: the parent's rank, and 3 * inserts + action.
        self.parents, self.pieces, self.starts = array("B"), array("B"), array("Q")

    @staticmethod
    def _line(state, line: bytes):
        if state is None:
            return hashlib.sha256(line)
        state = state.copy()
        state.update(b"\n" + line)
        return state

    def _inserted(self) -> dict[int, tuple[int, int, int, tuple[str, ...]]]:
        """Tops reached by inserts alone: (cost, rank, number of inserts, their initials)."""
        best = {top: (cost, rank, 0, ()) for top, (cost, rank, _) in self.tops.items()}
        todo = list(best)
        for top in todo:
            cost, rank, n, made = best[top]
            for x in ROLES:
                for to in self.stacks.shift(top, x):
                    new = (cost + INSERT, rank, n + 1, (*made, x))
                    if to not in best or new[:3] < best[to][:3]:
                        best[to] = new
                        todo.append(to)
        return best

    def _hash(self, rank: int, inserted: tuple[str, ...], line: bytes | None):
        state = self.tops[self.order[rank]][2]
        for x in inserted:
            state = self._line(state, f"{ROLES[x]}:".encode())
        return state if line is None else self._line(state, line)

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}

        def offer(to: int, cost: int, rank: int, made: tuple[str, ...], action: str, line: str | None) -> None:
            new = (cost, rank, "I" * len(made) + action, made, line)
            if to not in best or new[:3] < best[to][:3]:
                best[to] = new

        for top, (cost, rank, _, made) in self._inserted().items():
            offer(top, cost + DELETE, rank, made, "D", None)
            if must_go:
                continue
            for to in self.stacks.shift(top, role[:1]) if role[:1] in ("s", "u", "a") else ():
                offer(to, cost + KEEP + TRUNCATED * truncated, rank, made, "K", f"{role}:{text}")
            for x, name in ROLES.items():
                for to in self.stacks.shift(top, x):
                    offer(to, cost + REROLE + TRUNCATED * truncated, rank, made, "R", f"{name}:{text}")
        ranked = sorted(best.items(), key=lambda b: b[1][1:3])
        self.starts.append(len(self.parents))
        tops = {}
        for rank, (to, (cost, parent, piece, made, line)) in enumerate(ranked):
            self.parents.append(parent)
            self.pieces.append(3 * (len(piece) - 1) + self.ACTIONS.index(piece[-1]))
            tops[to] = (cost, rank, self._hash(parent, made, None if line is None else line.encode("utf-8", "surrogatepass")))
        self.tops, self.order = tops, [to for to, _ in ranked]

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the cheapest parse."""
        cost, rank, n, made = min(v for top, v in self._inserted().items() if self.stacks.accepts(top))
        state = self._hash(rank, made, None)
        pieces = ["I" * n]
        for start in reversed(self.starts):
            piece = self.pieces[start + rank]
            pieces.append("I" * (piece // 3) + self.ACTIONS[piece % 3])
            rank = self.parents[start + rank]
        return cost, "".join(reversed(pieces)), (state or hashlib.sha256()).hexdigest()


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by conversation and place; a row out for each conversation."""
    stacks, out = Stacks(Automaton(GRAMMAR)), []
    conv, parse, kind = None, None, None

    def close() -> None:
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        out.append((conv, gaps, *faults, *parse.end()))

    def made() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        kind = batch["conv"].type
        columns = [batch[c].to_pylist() for c in ("conv", "turn", "role", "text", "copies", "again", "blank", "truncated")]
        for c, turn, role, text, copies, again, is_blank, is_cut in zip(*columns, strict=True):
            if parse is None or c != conv:
                if parse is not None:
                    close()
                conv, parse, before = c, Repair(stacks), None
                turns, faults = [None, None, 0], [0, 0, 0, 0]
            for copy in range(copies):
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                repeated = not is_blank and (again or copy > 0)
                cut = is_cut and not is_blank and not repeated
                illegal = before is not None and before + role[:1] not in ILLEGAL_UNLESS
                faults = [n + fault for n, fault in zip(faults, (is_blank, repeated, cut, illegal), strict=True)]
                parse.row(role, text, is_blank or repeated, cut)
                before = role[:1]
        if len(out) >= 1000:
            yield made()
            out.clear()
    if parse is not None:
        close()
    if out:
        yield made()


def _filled(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, role0, text0, copies) after damage by the crc32 of ``conv_id:turn``; equal rows are one, with the number of
    copies that are left of them, which is 0 for dropped ones."""
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", _filled("role").alias("role0"), _filled("text").alias("text0"))
    rows = rows.groupBy("conv", "turn", "role0", "text0").agg(F.count("*").alias("n"))
    harm = F.crc32(F.concat_ws(":", _filled("conv"), _filled("turn"))) % 20
    text = F.when(harm.isin(0, 1), F.lit("")).when(harm == 2, F.translate("text0", ".!?", "")).otherwise(F.col("text0"))
    role = F.when(harm == 4, F.lit("user")).otherwise(F.col("role0"))
    copies = F.when(harm == 0, F.lit(0)).when(harm == 3, 2 * F.col("n")).otherwise(F.col("n"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), "role0", "text0", copies.cast("long").alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation of ``rows`` (conv, turn, role, text, role0, text0, copies).

    Rows come by turn, nulls first; those of one turn by ``role0``, then ``text0`` (in code-point order), copies beside each other.  A conversation
    of which no copy is left has zeros, an empty audit and the hash of an empty text.  A null ``conv`` is a conversation."""
    place = [F.col("turn").asc_nulls_first(), F.col("role0"), F.col("text0")]
    left = F.col("copies") > 0
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    # Whether the role and text were there before: dealt by all three, so a long conversation is spread here.
    nth = F.row_number().over(Window.partitionBy("conv", "role", "text", left).orderBy(*place))
    marked = rows.select(
        "conv", "turn", "role", "text", "copies", "role0", "text0", (left & (nth > 1)).alias("again"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated")
    )
    ordered = marked.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *place)
    slim = ordered.select("conv", "turn", "role", "text", "copies", "again", "blank", "truncated")
    return slim.mapInArrow(_parsed, T.StructType([rows.schema["conv"], *T._parse_datatype_string(_OUT)]))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations`` (conv_id, turn, role, text), after :func:`damaged`.

    Null roles and texts are one space, so such texts are blank; further columns do not matter; an empty table gives no rows."""
    return repair(damaged(conversations)).withColumnRenamed("conv", "conv_id")
