"""Repair of conversations: the cheapest edits that give roles of the form ``(s?(ua)+)?``.

Rows of a conversation are taken by turn (nulls first; equal turns by role, then by
a digest of the row).  A row is blank, a duplicate (role and text seen earlier in its
conversation) or truncated (its last character that is not white space is none of ``.!?``);
the first of these counts.  Edits: Keep a row (0), give it the role user or assistant
(Rerole, 3), Delete it (4; blank rows and duplicates have to go), Insert an empty message of
the user or the assistant anywhere (3).  A truncated row that stays costs 3 more.

One integer weighs a way of editing what is left of a conversation: its high
digits are the cost, its low digits, of a fixed width, the letters of the edits,
the first one highest, zeros behind the last.  So the least integer has the least cost and of
equal costs the audit that comes first in ASCII, a shorter one before those it begins.  The least
integer of each place and automaton state follows from those of the next place, from the end
on; the letters of the result say which edits to make, as the state tells the role of each.

A conversation is worked on in one task, whose rows stream through in order:
first initials and faults (a few bytes a row), then, its audit before them, the texts.
No task holds the texts of a conversation.  The integers have 7 bits a row, so time
grows with the square of a single conversation's rows (README).

Null conv_ids are one conversation.  Other nulls are one space, so null texts are blank
and a row with a null role has to be rewritten or deleted; an empty role has no
initial and can't be kept, nor can roles with other initials.  Turns that are null count in
no gap.  Repeated rows are duplicates of each other.  A conversation all of whose rows the damage
drops has a row of zeros.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\f\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Letters of the edits by their digit; in ASCII order.
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: States: nothing yet, after the system, the user, the assistant; the state that each role's initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state behind an inserted or rewritten row.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = "conv_id bigint, place bigint, role string, text string, " + SUMMARY
RESULT = "conv_id bigint, " + SUMMARY + ", repaired_sha256 string"


def cheapest(initials: list[str], faults: list[int] | bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, of equal costs the first audit in ASCII."""
    n = len(initials)
    # deleting all that is left and inserting a pair bounds the cost of any rest, and so its inserts
    width = n + (4 * n + 6) // 3 + 2
    high, top, letters = 3 * width, 3 * (width - 1), (1 << 3 * width) - 1

    def edit(cost: int, digit: int, rest: int | None) -> int | None:
        """The weight of an edit and what follows it."""
        return None if rest is None else (cost + (rest >> high) << high) | digit << top | (rest & letters) >> 3

    def least(*ways: int | None) -> int | None:
        return min((w for w in ways if w is not None), default=None)

    def inserted(v: list[int | None]) -> list[int | None]:
        user, assistant = least(v[USER], edit(3, INSERT, v[ASSISTANT])), least(v[ASSISTANT], edit(3, INSERT, v[USER]))
        return [least(v[START], edit(3, INSERT, user)), least(v[SYSTEM], edit(3, INSERT, user)), user, assistant]

    best = inserted([0, None, None, 0])
    for initial, fault in zip(reversed(initials), reversed(faults)):
        ways = []
        for state in range(4):
            way = edit(4, DELETE, best[state])
            if fault in (SOUND, TRUNCATED):
                more = 3 if fault == TRUNCATED else 0
                kept = STEPS[state].get(initial)
                way = least(way, None if kept is None else edit(more, KEEP, best[kept]), edit(3 + more, REROLE, best[NEXT[state]]))
            ways.append(way)
        best = inserted(ways)
    found, digits = best[START] >> high, oct(best[START] & letters | 1 << high)[3:]
    return found, "".join(LETTERS[int(d)] for d in digits.rstrip("0"))


def _rows(batches: Iterator[pa.RecordBatch], most: int = 2_000) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield from batch.slice(at, most).to_pylist()


def _batches(rows: Iterator[dict], ddl: str, most_rows: int = 5_000, most_chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    schema, held, chars = common.arrow_schema(ddl), [], 0
    for row in rows:
        held.append(row)
        chars += len(row.get("text") or "") + len(row["audit"] or "")
        if len(held) >= most_rows or chars >= most_chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _summarised(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows (conv_id, present, turn, initial, fault) in order; a row for each conversation."""

    def row() -> dict:
        cost, audit = cheapest(initials, faults)
        counts = {name: faults.count(bytes([k])) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
        return {"conv_id": conv, "gaps": last - first + 1 - turns if turns else 0, **counts, "illegal": illegal, "cost": cost, "audit": audit}

    conv, begun = None, False
    for r in rows:
        if not begun or r["conv_id"] != conv:
            if begun:
                yield row()
            conv, begun = r["conv_id"], True
            initials: list[str] = []
            faults, first, last, turns = bytearray(), None, None, 0
        if not r["present"]:
            continue
        initials.append(r["initial"])
        faults.append(r["fault"])
        if (turn := r["turn"]) is not None and turn != last:
            first, last, turns = turn if first is None else first, turn, turns + 1
    if begun:
        yield row()


def _repaired(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows of a conversation behind its summary; the summary (place -1) and the repaired rows."""
    none = dict.fromkeys(x.split()[0] for x in SUMMARY.split(", "))

    def message(role: str, text: str) -> dict:
        nonlocal place
        place += 1
        return {"conv_id": conv, "place": place - 1, "role": role, "text": text, **none}

    def inserts() -> Iterator[dict]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield message(ROLES[state], "")

    conv, audit, at, state, place = None, "", 0, START, 0
    for r in rows:
        if r["summary"]:
            conv, audit, at, state, place = r["conv_id"], r["audit"], 0, START, 0
            yield {"conv_id": conv, "place": -1, "role": None, "text": None, **{k: r[k] for k in none}}
        else:
            letter, at = audit[at], at + 1
            if letter == "K":
                state = STEPS[state][r["role"][:1]]
                yield message(r["role"], r["text"])
            elif letter == "R":
                state = NEXT[state]
                yield message(ROLES[state], r["text"])
        yield from inserts()  # behind the summary: those before the first row


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """The summaries with the hash of the repaired rows, which follow each one."""
    held, seen = None, None
    for r in rows:
        if r["place"] < 0:
            if held:
                yield held | {"repaired_sha256": seen.hexdigest()}
            held, seen = {k: r[k] for k in ("conv_id", *(x.split()[0] for x in SUMMARY.split(", ")))}, hashlib.sha256()
        else:
            seen.update((("\n" if r["place"] else "") + r["role"] + ":").encode())
            seen.update(r["text"].encode())
    if held:
        yield held | {"repaired_sha256": seen.hexdigest()}


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, present, turn, role, text): rows dropped (not present), emptied, without ends of sentences, repeated or given to the user, by crc32(conv_id:turn) % 20."""
    space = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", (F.col("kind") != 0).alias("present"), "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def whole(conversations: DataFrame) -> DataFrame:
    """The same columns without any damage."""
    space = F.lit(" ")
    return conversations.select("conv_id", F.lit(True).alias("present"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def _marked(rows: DataFrame) -> DataFrame:
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumn("digest", digest)


def _order() -> list:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, faults, cost and audit of each conversation of ``rows`` (as ``damage`` and ``whole`` give them)."""
    end = F.rtrim("text", F.lit(SPACE))
    last = F.substring(end, -1, 1)
    flags = _marked(rows).select("conv_id", "present", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), F.when(end == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND).alias("own"))
    # one exchange: what is dealt by conv_id is dealt by any keys with it
    dealt = flags.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("own") == BLANK, BLANK).when(seen, DUPLICATE).otherwise(F.col("own"))
    ordered = dealt.withColumn("fault", fault).sortWithinPartitions("conv_id", *_order()).select("conv_id", "present", "turn", "initial", "fault")
    return ordered.mapInArrow(lambda it: _batches(_summarised(_rows(it)), "conv_id bigint, " + SUMMARY), "conv_id bigint, " + SUMMARY)


def _repairs(rows: DataFrame) -> DataFrame:
    """Summaries (place -1) and repaired rows, in order within the partitions."""
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    kinds = {x.split()[0]: x.split()[1] for x in SUMMARY.split(", ")}
    found = summaries(rows).select("conv_id", F.lit(True).alias("summary"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), *names)
    texts = _marked(rows.where("present")).select("conv_id", F.lit(False).alias("summary"), F.col("turn").cast("bigint").alias("turn"), "role", "text", "digest", *(F.lit(None).cast(kinds[n]).alias(n) for n in names))
    common.small_batches(rows.sparkSession)
    ordered = found.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("summary"), *_order())
    return ordered.drop("turn", "digest").mapInArrow(lambda it: _batches(_repaired(_rows(it)), REPAIRED), REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations."""
    return _repairs(rows).where("place >= 0").select("conv_id", "place", "role", "text")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """Damages the conversations; a row for each with what was wrong, the edits and a hash of its repaired form."""
    return _repairs(damage(conversations)).mapInArrow(lambda it: _batches(_digests(_rows(it)), RESULT), RESULT)
