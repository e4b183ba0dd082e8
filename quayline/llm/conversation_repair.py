"""Conversation structure repair by Knuth's lightest-derivation agenda.

A repaired conversation has role initials ``(s?(ua)+)?``.  Repairs are deductions of a weighted hypergraph:

* item ``(i, q)``: rows i.. can be edited so that a conversation in state q becomes legal.  States: 0 nothing yet,
  1 after system, 2 after user, 3 after assistant; legal ends are 0 and 3;
* axioms: the legal ends after the last row, and for every row the edits it allows, each with its cost and letter;
* deductions: (i, q) follows from an edit of row i and the item (i + 1, q') behind it (Keep, Rerole, Delete), or from
  an Insert and (i, q').  Costs add up, the letter goes before the audit.

The agenda pops items by (cost, rows covered, audit).  Costs never fall and a deduction that adds no cost covers one
more row, so the functions are superior; a letter put before two audits keeps their order, so they are
monotone: a popped item is final, and the search ends when the goal (0, 0) is popped.  No two deductions of one item
have the same letter (the state says which role a Rerole or Insert gives), so two audits of equal cost are compared
by their first letters and kept as back pointers: memory is linear in the rows.

Spark shuffles the rows by conversation and sorts them by turn; a task walks its sorted rows and holds one
conversation at a time.  A conversation is one repaired text, so it is never cut between tasks.

Defined results: nulls in role or text are one space, a null id is a conversation of its own, null turns come first;
rows of one turn are taken in order of role, then text (UTF-8 bytes); repeated rows are duplicates; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from hashlib import blake2b
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, single

#: Fixed values of the contract: costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
WHITE = r"\x20\x09-\x0D"


def lightest_repair(rows: list[tuple[str, str]]) -> tuple[int, str, list[str | None]]:
    """(cost, audit, target initials) for rows of (role initial, fault), faults ``""``, ``"blank"``, ``"duplicate"``
    or ``"truncated"``; the targets are the initials of the letters of the audit, None for a Delete."""
    n, states = len(rows), len(NEXT)
    far = 1 << 62
    # item (i, q) has the number i * states + q
    best = [(far, "")] * (states * (n + 1))
    tails, roles = [-1] * len(best), [None] * len(best)
    final = bytearray(len(best))
    agenda: list[tuple[int, int, str, int]] = []
    # (state before, initial) of the steps into a state: deductions run against the text
    into = [[(p, i) for p in range(states) for i, t in NEXT[p].items() if t == q] for q in range(states)]

    def offer(i, q, cost, letter, tail, role):
        item = i * states + q
        if not final[item] and (cost, letter) < best[item]:
            best[item], tails[item], roles[item] = (cost, letter), tail, role
            heapq.heappush(agenda, (cost, n - i, letter, item))

    for q in ENDS:
        offer(n, q, 0, "", -1, None)
    while agenda:
        cost, _, letter, item = heapq.heappop(agenda)
        if final[item] or best[item] != (cost, letter):
            continue
        final[item] = 1
        if item == 0:
            break
        i, q = divmod(item, states)
        for p, initial in into[q]:
            if initial in ROLES:
                offer(i, p, cost + INSERT, "I", item, initial)
        if i == 0:
            continue
        own, fault = rows[i - 1]
        offer(i - 1, q, cost + DELETE, "D", item, None)
        if fault in ("blank", "duplicate"):
            continue
        stay = TRUNCATED if fault == "truncated" else 0
        for p, initial in into[q]:
            if initial == own:
                offer(i - 1, p, cost + stay, "K", item, initial)
            if initial in ROLES:
                offer(i - 1, p, cost + REROLE + stay, "R", item, initial)
    item, audit, targets = 0, [], []
    while tails[item] >= 0:
        audit.append(best[item][1])
        targets.append(roles[item])
        item = tails[item]
    return best[0][0], "".join(audit), targets


def apply_repair(rows: list[tuple[str, str]], audit: str, targets: list[str | None]) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit leaves."""
    out, source = [], iter(rows)
    for letter, target in zip(audit, targets):
        role, text = ("", "") if letter == "I" else next(source)
        if letter != "D":
            out.append((role if letter == "K" else ROLES[target], text))
    return out


def repair_one(rows: list[tuple[str, str, bool, bool]]) -> dict:
    """Faults, cost, audit and repaired rows of (role, text, blank, truncated) rows in turn order."""
    seen, faults = set(), []
    for role, text, blank, truncated in rows:
        key = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        faults.append("blank" if blank else "duplicate" if key in seen else "truncated" if truncated else "")
        seen.add(key)
    initials = [r[0][:1] for r in rows]
    cost, audit, targets = lightest_repair(list(zip(initials, faults)))
    kept = apply_repair([r[:2] for r in rows], audit, targets)
    return {"blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(a + b not in LEGAL for a, b in pairwise(initials)), "cost": cost, "audit": audit,
            "repaired": [{"role": r, "text": t} for r, t in kept]}


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) per conversation of
    ``rows`` (conv_id, turn, role, text); ``repaired`` is the array of (role, text) after the edits.  Rows for which
    ``present`` is false only say that their conversation exists."""
    text = F.coalesce("text", F.lit(" "))
    ready = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        (~F.rlike(text, F.lit(f"[^{WHITE}]"))).alias("blank"),
        (~F.substring(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), -1, 1).isin(".", "!", "?")).alias("truncated"),
        (F.lit(True) if present is None else present).alias("present"))
    ordered = ready.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in FIELDS)

    def run(batches):
        ident, turns, held, began, done, ids = None, [], [], False, [], []

        def close():
            out = repair_one(held)
            out["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
            ids.append(ident)
            done.append(out)

        def emit(id_type):
            arrays = [pa.array(ids, id_type), *[pa.array([d[c] for d in done], pa.int64()) for c in FIELDS],
                      pa.array([d["audit"] for d in done], pa.string()),
                      pa.array([d["repaired"] for d in done], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
            ids.clear()
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *FIELDS, "audit", "repaired"])

        id_type = pa.int64()
        for batch in batches:
            column = single(batch.column("conv_id"))
            id_type = column.type
            cols = [single(batch.column(c)).to_pylist() for c in ("turn", "role", "text", "blank", "truncated", "present")]
            for conv, turn, role, text, blank, truncated, here in zip(column.to_pylist(), *cols):
                if not began or conv != ident:
                    if began:
                        close()
                    ident, began, turns, held = conv, True, [], []
                if here:
                    held.append((role, text, blank, truncated))
                    if turn is not None:
                        turns.append(turn)
            if done:
                yield emit(id_type)
        if began:
            close()
            yield emit(id_type)

    return arrow_map(ordered, run, f"conv_id {kind}, {counts}, audit string, "
                                   "repaired array<struct<role:string,text:string>>")


def damage(rows: DataFrame) -> DataFrame:
    """The conversations of the contract's test: rows dropped (``present`` false), emptied, stripped of sentence ends,
    repeated or given to the user by the crc32 of ``conv_id:turn`` (nulls: one space) modulo 20."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), (F.col("kind") != 0).alias("present"), "kind")
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.withColumn("copy", F.explode(times)).drop("kind", "copy")
