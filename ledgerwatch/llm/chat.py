"""Chat formatting from event logs, in DataFrame functions only.

A log has one row per event of a conversation: a turn is opened, streamed deltas are appended, an edit replaces what the
turn has said so far, a regeneration throws the answer away and starts it again. The events of a turn are folded in
sequence into the final message; the messages of a conversation are rendered into one string with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import materialize, prepare

#: Kinds of events.
OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
#: Marks of the template: begin of a turn, end of its role, end of its text.
BEGIN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: What a text must not hold in the clear: the escape character first, then the template's marks and those of other chat
#: templates. Each is written as a backslash and its letter, so an escaped text holds none of them.
CONTROL = [("\\", "a"), (BEGIN, "b"), (SAYS, "c"), (END, "d"), ("<s>", "e"), ("</s>", "f"), ("[INST]", "g"), ("[/INST]", "h"), ("<<SYS>>", "i"), ("<</SYS>>", "j"), ("<|", "k"), ("|>", "l")]


def escape(text: Column) -> Column:
    for mark, letter in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit("\\" + letter))
    return text


def unescape(text: Column) -> Column:
    """Backslashes come last: until then each one in the text starts an escape."""
    for mark, letter in reversed(CONTROL):
        text = F.replace(text, F.lit("\\" + letter), F.lit(mark))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, copy, role, text) of a log (conv_id, seq, turn, copy, kind, role, text).

    Within a turn, in order of seq: the last edit or regeneration decides where the text begins (an edit with its own
    text, a regeneration with none), later deltas are appended. The role is that of the last event that names one. Null
    texts are empty, a null role is kept as null. Events of equal seq are ordered by kind, role and text. ``copy`` tells
    repeated turns apart. The group is one turn of one conversation, so a conversation of any length is many groups.
    """
    step = F.struct(
        F.col("seq"), F.col("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    log = F.array_sort(F.collect_list(step))
    folded = events.groupBy("conv_id", "turn", "copy").agg(log.alias("log"))
    last = F.aggregate(
        F.sequence(F.lit(1), F.size("log")),
        F.lit(0),
        lambda at, i: F.when(F.element_at("log", i)["kind"].isin(EDIT, REGENERATE), i).otherwise(at),
    )
    said = F.col("log")
    parts = F.filter(said, lambda e, i: (i + 1 >= F.col("last")) & e["kind"].isin(DELTA, EDIT))
    roles = F.filter(said, lambda e: e["role"].isNotNull())
    return folded.withColumn("last", last).select(
        "conv_id", "turn", "copy",
        F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"]).alias("role"),
        F.array_join(F.transform(parts, lambda e: e["text"]), "").alias("text"),
    )


def format_conversations(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_mask.

    Turns are rendered in order of turn, copy; ``loss_mask`` lists, for each turn of the ``trained`` role, the number of
    the turn and the start and length (code points) of its text within the rendered turn. A null role is rendered as an
    empty one. A conversation becomes one string, which is the output asked for; the only other state is its turns.
    """
    head = F.concat(F.lit(BEGIN), escape(F.coalesce("role", F.lit(""))), F.lit(SAYS))
    text = escape(F.coalesce("text", F.lit("")))
    turn = F.struct(
        F.col("turn"), F.col("copy"), F.concat(head, text, F.lit(END)).alias("piece"), F.length(head).alias("start"),
        F.length(text).alias("chars"), F.coalesce(F.col("role") == trained, F.lit(False)).alias("loss"),
    )
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform(
        F.col("turns"),
        lambda t, i: F.struct((i + 1).alias("turn"), (t["start"] + 1).alias("start"), t["chars"].alias("chars"), t["loss"].alias("loss")),
    )
    return grouped.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter(mask, lambda m: m["loss"]), lambda m: m.dropFields("loss")).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and masked texts parsed from the formatted strings: conv_id, formatted, turns, masked."""
    pieces = formatted.withColumn("pieces", F.slice(F.split("formatted", r"<\|turn\|>"), 2, 2_000_000_000))

    def parse(piece: Column) -> Column:
        sides = F.split(piece, r"<\|says\|>")
        return F.struct(
            unescape(sides[0]).alias("role"),
            unescape(F.replace(sides[1], F.lit(END), F.lit(""))).alias("text"),
        )

    skip = len(BEGIN)
    masked = F.transform(
        "loss_mask", lambda m: unescape(F.substring(F.element_at("pieces", m["turn"]), m["start"] - skip, m["chars"]))
    )
    return pieces.select("conv_id", "formatted", F.transform("pieces", parse).alias("turns"), masked.alias("masked"))


def digests(parsed: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what read_back() found."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("masked", "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def log_of_turns(rows: DataFrame, delta_chars: int = 400) -> DataFrame:
    """An event log of finished turns (conv_id, turn, role, text): each turn is opened, said in deltas of at most
    ``delta_chars``, and an assistant's turn is first drafted, then regenerated and said again.

    Repeated rows and rows that share a turn stay apart by ``copy``, in order of role and text.
    """
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    ranked = rows.select("conv_id", "turn", role, text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    places = ranked.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("role", "text", "times"))).alias("same"))
    one = places.select("conv_id", "turn", F.posexplode("same").alias("place", "m")).select(
        "conv_id", "turn", "place", F.col("m.role").alias("role"), F.col("m.text").alias("text"),
        F.explode(F.sequence(F.lit(1), F.col("m.times").cast("int"))).alias("time"),
    ).withColumn("copy", F.struct("place", "time"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / delta_chars).cast("int") - 1, F.lit(0)))
    event = lambda kind, r, t: F.struct(F.lit(kind).alias("kind"), r.alias("role"), t.alias("text"))
    none = F.lit(None).cast("string")
    deltas = F.transform(cuts, lambda i: event(DELTA, none, F.substring(F.col("text"), i * delta_chars + 1, F.lit(delta_chars))))
    draft = F.when(
        F.col("role") == "assistant",
        F.array(event(DELTA, none, F.substring(F.col("text"), 1, 20)), event(REGENERATE, none, none)),
    ).otherwise(F.array().cast("array<struct<kind:string,role:string,text:string>>"))
    script = F.concat(F.array(event(OPEN, F.col("role"), none)), draft, deltas)
    return one.select("conv_id", "turn", "copy", F.posexplode(script).alias("seq", "e")).select(
        "conv_id", "turn", "copy", F.col("seq").cast("long").alias("seq"), "e.kind", "e.role", "e.text"
    )


def chat(rows: DataFrame) -> DataFrame:
    """Event log, fold, rendering, written output and digests of a table of turns."""
    prepare(rows.sparkSession)
    formatted = materialize(format_conversations(fold_events(log_of_turns(rows))), "chat")
    return digests(read_back(formatted))
