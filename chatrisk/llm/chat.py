"""Chat formatting with Spark expressions only.

Turns are collected as structs in pieces of bounded length, sorted, and adjacent turns of one role are merged
by an array aggregation; the pieces of a conversation are then put in order and merged where they meet. In the
formatted text every merged turn has one header, and the texts inside it are kept apart by a separator:

    <|im_start|>user\nfirst text<|im_sep|>second text<|im_end|>

Texts and roles cannot hold a control string: `&` becomes `&amp;` and `<|` becomes `&lt;|`, in a role also a
line break `&#10;`. Reading turns these back, so every text is restored exactly.

Rows are put in order of turn, role and text, null turns first. Null texts and roles are empty. A null
conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives an empty
result. Columns other than conv_id, turn, role and text are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Turn numbers in one piece.
PIECE_TURNS = 256
_TURNS = "array<struct<role:string,texts:array<string>>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _merged(turns: Column) -> Column:
    """Sorted turns with neighbours of one role joined into one struct."""

    def step(done: Column, turn: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(
            F.array_append(done, fresh)
        )

    return F.aggregate(turns, F.array().cast(_TURNS), step)


def formatted(conversations: DataFrame, piece_turns: int = PIECE_TURNS, trained_role: str = "assistant") -> DataFrame:
    """A row per conversation: conv_id, n_turns, segments (text, loss) and formatted, their concatenation.

    `loss` marks the segments that are trained on: the texts of `trained_role`, without headers and ends.
    """
    # `&` of a role is escaped before its line breaks are, so that `&#10;` in the data stays apart from them.
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    pieces = (
        conversations.select("conv_id", F.floor(F.col("turn") / piece_turns).alias("piece"), turn.alias("row"))
        .groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select("conv_id", "piece", F.size("rows").alias("n"), _merged(F.col("rows")).alias("turns"))
    )
    whole = pieces.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("piece", "turns"))).alias("pieces"),
    ).select("conv_id", "n_turns", F.flatten(F.transform("pieces", lambda p: p["turns"])).alias("turns"))

    def written(turn: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("turns", i - 1)["role"])
        after = F.get("turns", i + 1)["role"]
        head = F.when(F.coalesce(before == turn["role"], F.lit(False)), F.lit(SEP)).otherwise(
            F.concat(F.lit(START), turn["role"], F.lit("\n"))
        )
        tail = F.when(F.coalesce(after == turn["role"], F.lit(False)), F.lit("")).otherwise(F.lit(END + "\n"))
        loss = turn["role"] == trained_role
        texts = F.flatten(F.transform(turn["texts"], lambda t, j: F.array(
            F.struct(F.when(j > 0, F.lit(SEP)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
            F.struct(t.alias("text"), loss.alias("loss")),
        )))
        mark = lambda t: F.array(F.struct(t.alias("text"), F.lit(False).alias("loss")))
        return F.concat(mark(head), texts, mark(tail))

    segments = F.filter(F.flatten(F.transform("turns", written)), lambda s: (s["text"] != "") | s["loss"])
    return whole.select("conv_id", "n_turns", segments.alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds, in order, one per original row."""
    blocks = F.filter(F.split(text, "<\\|im_start\\|>"), lambda b: b != "")

    def parsed(block: Column) -> Column:
        role = unescaped(F.replace(F.substring_index(block, "\n", 1), F.lit("&#10;"), F.lit("\n")))
        body = F.substring_index(F.substr(block, F.instr(block, "\n") + 1), END, 1)
        return F.transform(
            F.split(body, "<\\|im_sep\\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, parsed))


def with_digest(chats: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the formatted text."""
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return chats.withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", F.array_join(learned, "")).select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
