r"""Chat formatting: checked turn order, marked turns, loss flags, and the way back.

A template names, per role, the control strings around a turn and whether the
loss counts its text; a finite-state machine over roles says which turn orders
are well formed.  ``segments`` gives the pieces of the formatted text, each with
its flag; ``format_conversations`` joins them.  Control strings inside texts are
broken up by a backslash behind their first character, and backslashes are
doubled, so texts come back exactly.

Rules for odd rows: a null text is an empty one; a null role, or one that the
template does not name, gets the template's ``other`` marks, with its name
written as the turn's first line (a null role reads back as an empty name) and
no loss; turns go by turn number (nulls first), then role and text, so repeated
turns have one order and are all kept; rows with a null conv_id form one
conversation.  A conversation with a wrong order is formatted all the same and
reported by ``valid`` and ``bad_turn``.  No rows, no result.

A conversation is one training text, so its turns meet in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (control string before the text, control string behind it, loss counts)
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
OTHER = ("<turn>", "</turn>", False)
#: state -> role -> next state; a missing entry is a wrong turn.
MACHINE = {
    "start": {"system": "briefed", "user": "asked"},
    "briefed": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
FINAL = ("answered",)


def control_strings(template: dict = TEMPLATE, other: tuple = OTHER) -> list[str]:
    return sorted({mark for open_, close, _ in [*template.values(), other] for mark in (open_, close)})


def quoted(text: str) -> str:
    """A text as a regular expression without the use of quoting marks."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def escape(text: Column, controls: list[str]) -> Column:
    parts = "|".join(f"(?<={quoted(c[0])})(?={quoted(c[1:])})" for c in controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), parts, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def by_role(role: Column, template: dict, at: int, otherwise: object) -> Column:
    found = reduce(
        lambda chain, name: chain.when(role == name, F.lit(template[name][at])), list(template)[1:],
        F.when(role == next(iter(template)), F.lit(next(iter(template.values()))[at])))
    return found.otherwise(F.lit(otherwise))


def next_state(state: Column, role: Column, machine: dict) -> Column:
    """One step of the machine; ``bad`` has no way out."""
    steps = F.create_map(*[
        F.lit(x) for source, moves in machine.items() for name, target in moves.items()
        for x in (f"{source}>{name}", target)])
    return F.coalesce(F.try_element_at(steps, F.concat(state, F.lit(">"), F.coalesce(role, F.lit("")))), F.lit("bad"))


def conversations(turns: DataFrame, machine: dict = MACHINE, final: tuple = FINAL) -> DataFrame:
    """``conv_id, turns, valid, bad_turn`` with the turns in order as role and text.

    ``bad_turn`` is the number, from 0, of the first turn that the machine has
    no step for; null with ``valid`` false means that the end came too early.
    """
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.col("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad"))

    def step(at: Column, turn: Column) -> Column:
        state = F.when(at["state"] == "bad", F.lit("bad")).otherwise(next_state(at["state"], turn["role"], machine))
        return F.struct(
            state.alias("state"), (at["seen"] + 1).alias("seen"),
            F.when(at["bad"].isNotNull(), at["bad"]).when(state == "bad", at["seen"]).alias("bad"))

    run = F.aggregate("turns", start, step)
    return rows.withColumn("_run", run).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.col("_run.state").isin(*final).alias("valid"), F.col("_run.bad").alias("bad_turn"))


def segments(frame: DataFrame, template: dict = TEMPLATE, other: tuple = OTHER) -> DataFrame:
    """Adds ``segments``: per turn the mark, the text and the closing mark, each with its loss flag."""
    controls = control_strings(template, other)

    def pieces(turn: Column) -> Column:
        known = F.coalesce(turn["role"].isin(*template), F.lit(False))
        name = F.concat(F.coalesce(turn["role"], F.lit("")), F.lit("\n"))
        text = F.when(known, turn["text"]).otherwise(F.concat(name, turn["text"]))
        loss = by_role(turn["role"], template, 2, other[2])
        return F.array(
            F.struct(by_role(turn["role"], template, 0, other[0]).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(text, controls).alias("text"), loss.alias("loss")),
            F.struct(by_role(turn["role"], template, 1, other[1]).alias("text"), F.lit(False).alias("loss")))

    return frame.withColumn("segments", F.flatten(F.transform("turns", pieces)))


def format_conversations(turns: DataFrame, template: dict = TEMPLATE, other: tuple = OTHER,
                         machine: dict = MACHINE, final: tuple = FINAL) -> DataFrame:
    """``conv_id, valid, bad_turn, segments, formatted, loss_spans``.

    ``loss_spans`` holds the places (from 0, in code points) and lengths of the
    pieces of ``formatted`` under the loss mask, in order.
    """
    frame = segments(conversations(turns, machine, final), template, other).drop("turns")
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    span = "array<struct<start:int,length:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(held: Column, s: Column) -> Column:
        size = F.length(s["text"])
        spans = F.when(s["loss"], F.concat(held["spans"], F.array(F.struct(
            held["at"].alias("start"), size.alias("length"))).cast(span))).otherwise(held["spans"])
        return F.struct((held["at"] + size).alias("at"), spans.alias("spans"))

    return frame.withColumns({
        "formatted": formatted, "loss_spans": F.aggregate("segments", start, step, lambda held: held["spans"])})


def read_turns(formatted: Column, template: dict = TEMPLATE, other: tuple = OTHER) -> Column:
    """The turns, as role and text, out of a formatted conversation."""
    marks = [*template.values(), other]
    opens, closes = ("|".join(quoted(m[i]) for m in marks) for i in (0, 1))
    pattern = F.lit(f"(?s)({opens})(.*?)({closes})")
    roles = {open_: (name,) for name, (open_, _, _) in template.items()}
    pairs = F.arrays_zip(
        F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("mark"),
        F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("body"))

    def turn(p: Column) -> Column:
        body = unescape(p["body"])
        name = F.substring_index(body, "\n", 1)
        known = by_role(p["mark"], roles, 0, None)
        text = F.when(known.isNotNull(), body).otherwise(F.substring(body, F.length(name) + 2, F.length(body)))
        return F.struct(F.coalesce(known, name).alias("role"), text.alias("text"))

    return F.transform(pairs, turn)


def read_back(formatted: DataFrame, template: dict = TEMPLATE, other: tuple = OTHER) -> DataFrame:
    """Digests of each conversation, taken from its formatted text and loss spans only."""
    loss = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    rows = formatted.withColumns({
        "_turns": read_turns(F.col("formatted"), template, other), "_loss": F.array_join(loss, "")})
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn")
