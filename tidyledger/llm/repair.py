"""Repair of a chat's structure: the cheapest edits of its turns into system?, (user, assistant)+, or nothing."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The costs of edits, the edits in the order that decides ties, and the roles of the grammar.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
EDITS = "DIKR"
ROLES = {"u": "user", "a": "assistant"}
FOLLOWS = frozenset({"su", "ua", "au"})
SPACE = " \t\n\x0b\x0c\r"
GONE = "d"  # sign of a turn that has to go; the others are s, u, a and x, in upper case where truncated

NEVER = 1 << 60
REMEMBERED = 64  # turns of a chat whose repair is remembered
BITS = {edit: 1 << n for n, edit in enumerate(EDITS)}


def _cost(sign: str, symbol: str) -> int:
    """Of keeping or reroling a turn as a symbol of the target; only a system turn can be one."""
    if sign == GONE:
        return NEVER
    same = sign.lower() == symbol
    if symbol == "s" and not same:
        return NEVER
    return (KEEP if same else REROLE) + TRUNCATED * sign.isupper()


def _reached(signs: str) -> list[tuple[int, int, int, int]]:
    """Least cost of the edits of the first i turns by where they leave the grammar.

    Places: nothing yet, behind the system turn, behind a user's, behind an assistant's.
    """
    def filled(none: int, system: int, user: int, assistant: int) -> tuple[int, int, int, int]:
        user = min(user, min(none, system, assistant) + INSERT)
        assistant = min(assistant, user + INSERT)
        return none, system, min(user, assistant + INSERT), assistant

    found = [filled(0, NEVER, NEVER, NEVER)]
    for sign in signs:
        none, system, user, assistant = found[-1]
        as_user, as_assistant = _cost(sign, "u"), _cost(sign, "a")
        found.append(filled(
            none + DELETE,
            min(system + DELETE, none + _cost(sign, "s")),
            min(user + DELETE, min(none, system, assistant) + as_user),
            min(assistant + DELETE, user + as_assistant),
        ))
    return found


class Alignment:
    """Wagner-Fischer matrix of turns against the grammar string, for all its feasible lengths at once.

    Targets of different lengths end alike, so row i has the cost of aligning turns i and later with the last k
    symbols of (user, assistant)*, for each k. The incumbent is the cheapest repair of any length by the grammar's
    places alone. A cell whose rest costs more than the incumbent leaves after the least cost of getting to it lies
    outside the band and is not kept (Ukkonen's cut-off, by grammar place in addition to length).
    """

    def __init__(self, signs: str):
        self.signs = signs
        reached = _reached(signs)
        self.incumbent = min(reached[-1][0], reached[-1][3])
        # Least cost of standing before turn i with an even or odd number of symbols left.
        self._to = [(min(none, system, assistant), user) for none, system, user, assistant in reached]
        self._rows: list[tuple[int, list[int], bytearray]] = []
        bound = self.incumbent - min(self._to[-1])
        ends = list(range(0, max(bound, 0) + 1, INSERT))
        self._rows.append((0, ends, bytearray([0] + [BITS["I"]] * (len(ends) - 1))))
        for i in range(len(signs) - 1, -1, -1):
            self._rows.append(self._row(i, *self._rows[-1][:2]))
        self._rows.reverse()

    def _row(self, i: int, low: int, after: list[int]) -> tuple[int, list[int], bytearray]:
        sign, (even, odd) = self.signs[i], self._to[i]
        by_symbol = (_cost(sign, "u"), _cost(sign, "a"))
        took = BITS["K"] if sign.lower() == "u" else BITS["R"], BITS["K"] if sign.lower() == "a" else BITS["R"]
        left = (self.incumbent - even, self.incumbent - odd)
        costs, edits, k, before, width = [], bytearray(), low, NEVER, len(after)
        while True:
            place = k - low
            gone = after[place] + DELETE if place < width else NEVER
            taken = after[place - 1] + by_symbol[k & 1] if 0 < place <= width else NEVER
            put = before + INSERT
            least = min(gone, taken, put)
            if place > width and least > max(left):
                break
            before = least
            costs.append(least)
            edits.append(
                BITS["D"] * (gone == least) | BITS["I"] * (put == least) | took[k & 1] * (taken == least)
            )
            k += 1
        inside = [n for n, cost in enumerate(costs) if cost <= left[(low + n) & 1]]
        if not inside:
            return low, [], bytearray()
        first, last = inside[0], inside[-1] + 1
        kept = [c if c <= left[(low + first + n) & 1] else NEVER for n, c in enumerate(costs[first:last])]
        return low + first, kept, edits[first:last]

    def _starts(self, i: int, least: int, spent: int) -> list[int]:
        """Even numbers of symbols, ``least`` or more, from which the rest of the incumbent is what turns i.. cost."""
        low, costs, _ = self._rows[i]
        return [low + n for n, c in enumerate(costs) if not (low + n) & 1 and low + n >= least and c + spent == self.incumbent]

    def _backtraced(self, i: int, lengths: list[int]) -> str:
        """Least audit over targets of some lengths, traced side by side: the first to fall behind drop out.

        Targets in step have the same edits behind them, hence stand at the same turn.
        """
        audit = []
        while i < len(self.signs) or 0 not in lengths:
            low, _, edits = self._rows[i]
            open_to = [edits[k - low] for k in lengths]
            edit = next(e for e in EDITS if any(m & BITS[e] for m in open_to))
            lengths = [k for k, m in zip(lengths, open_to) if m & BITS[edit]]
            if edit != "D":
                lengths = [k - 1 for k in lengths]
            i += edit != "I"
            audit.append(edit)
        return "".join(audit)

    def audit(self) -> str:
        audits = []
        plain = self._starts(0, 0, 0)
        if plain:
            audits.append(self._backtraced(0, plain))
        # With a system turn kept all turns before it go; of equal costs the later one has the lesser audit.
        for i in range(min(len(self.signs), self.incumbent // DELETE + 1) - 1, -1, -1):
            if self.signs[i] in "sS":
                spent = i * DELETE + _cost(self.signs[i], "s")
                lengths = self._starts(i + 1, 2, spent)
                if lengths:
                    audits.append("D" * i + "K" + self._backtraced(i + 1, lengths))
                    break
        return min(audits)


def repair(signs: str) -> tuple[int, str]:
    """(cost, audit): the cheapest edits, of equal ones those of the ASCII-least initials."""
    found = Alignment(signs)
    return found.incumbent, found.audit()


_remembered = functools.lru_cache(maxsize=20_000)(repair)


def plan(audit: str, signs: str) -> tuple[list[int], list[str | None]]:
    """Turn and new role of each turn of the repaired chat; -1 is an inserted one, no new role means its own."""
    turns, roles, at, symbol = [], [], 0, "u"
    for edit in audit:
        if edit != "D":
            system = edit == "K" and signs[at] in "sS"
            turns.append(-1 if edit == "I" else at)
            roles.append(None if edit == "K" else ROLES[symbol])
            symbol = symbol if system else "a" if symbol == "u" else "u"
        at += edit != "I"
    return turns, roles


FOUND = (
    "struct<blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " places array<int>, roles array<string>>"
)


def _repaired(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for initials, states, digests in batches:
        out = []
        for own, state, digest in zip(initials.to_pylist(), states.to_pylist(), digests.to_pylist()):
            seen, signs, faults = set(), [], [0, 0, 0]
            for initial, fault, text in zip(own, state, digest):
                if fault != 1 and text in seen:
                    fault = 2
                seen.add(text)
                if fault:
                    faults[fault - 1] += 1
                role = initial if initial in ("s", "u", "a") else "x"
                signs.append(GONE if fault in (1, 2) else role.upper() if fault else role)
            signs = "".join(signs)
            cost, audit = (_remembered if len(signs) <= REMEMBERED else repair)(signs)
            illegal = sum(a + b not in FOLLOWS for a, b in zip(own, own[1:]))
            places, roles = plan(audit, signs)
            out.append((*faults, illegal, cost, audit, places, roles))
        types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
        names = ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "places", "roles")
        columns = list(zip(*out)) if out else [[]] * len(names)
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _state(text: Column) -> Column:
    """1: blank, 3: truncated (its last sign that is no space ends no sentence), 0: neither."""
    bare = F.rtrim(text, F.lit(SPACE))
    return F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3)


def repaired_chats(
    turns: DataFrame, chat: str = "chat_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Chats of any source with what is wrong in them and the cheapest repair. The library itself keeps no chats.

    Returns one row per chat: (chat_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns). A chat's
    turns are taken by turn number, missing ones first, on a tie by role, then text. ``gaps``: turn numbers missing
    between the first and the last. Of a turn the first fault counts: blank, duplicate (role and text seen before in
    the chat), truncated (last sign that is no space none of .!?). ``illegal``: neighbours whose role initials are not
    su, ua or au. ``audit`` has the initials of the edits in order: Keep (0), Rerole to user or assistant (2),
    Delete (3, all blank and duplicate turns), Insert an empty turn of user or assistant (2), with 1 more for each
    truncated turn that stays; ``cost`` is the least sum that leads to ``(system? (user assistant)+)?``, of equal
    audits the ASCII-least. ``turns`` is the repaired array<struct<role, text>>.

    Missing roles and texts are empty, a missing chat id is a chat of its own, repeated rows are turns of their own.
    Other columns are not read. An empty table gives no rows. The alignment gets three small values a turn, its text
    stays in Spark. A chat is one row of the result and so one task's work, in time proportional to its turns times
    the lengths that the cheapest repairs may still have.
    """
    listed = turns.select(
        turns[chat].alias("chat_id"),
        turns[turn].cast("long").alias("turn"),
        F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
    )
    told = listed.withColumn("state", _state(F.col("text"))).withColumn(
        "digest", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    )
    chats = told.groupBy("chat_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "state", "digest"))).alias("rows")
    )
    numbers = F.filter(F.col("rows.turn"), lambda n: n.isNotNull())
    span = F.try_subtract(F.array_max(numbers), F.array_min(numbers)) + 1 - F.size(F.array_distinct(numbers))
    initials = F.transform(F.col("rows.role"), lambda r: F.substring(r, 1, 1))
    found = F.arrow_udf(_repaired, FOUND)(initials, F.col("rows.state"), F.col("rows.digest"))
    done = chats.withColumn("found", found)

    def made(place: Column, renamed: Column) -> Column:
        own = F.get("rows", place)  # nothing at -1
        return F.struct(
            F.coalesce(renamed, own["role"]).alias("role"), F.coalesce(own["text"], F.lit("")).alias("text")
        )

    return done.select(
        "chat_id",
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *[f"found.{c}" for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")],
        F.zip_with("found.places", "found.roles", made).alias("turns"),
    )
