"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar of a formatted chat (LEVEL is the digit 0, 1 or 2):

    chat      := turn*
    turn      := user | assistant | other
    user      := '[INST]' LEVEL text '[/INST]'
    assistant := '<s>' LEVEL text '</s>'
    other     := '<<SYS>>' LEVEL role '\\n' text '<</SYS>>'

Level 0 writes role and text as they are. Level 1 breaks each control string by
a backslash behind its first character. Level 2 first doubles the backslashes
(and puts one before a line feed in a role), then does the same. A turn is
formatted at each level in order, parsed again, and compared with its source;
the first level that gives the source back, and leaves no control string in the
body, is used. Level 2 always does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: How each kind of turn opens and closes.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), None: ("<<SYS>>", "<</SYS>>")}

_TAILS = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"
_CONTROL = rf"[<\[](?={_TAILS})"
_BROKEN = rf"([<\[])\\(?={_TAILS})"
_TURN_END = r"(?<=\[/INST\]|</s>|<</SYS>>)"
_ROLE = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"


def _break(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(?={_TAILS})", r"$1\\")


def escape(c: Column, level: int, role: bool = False) -> Column:
    if level == 0:
        return c
    if level == 2:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        if role:
            c = F.replace(c, F.lit("\n"), F.lit("\\\n"))
    return _break(c)


def unescape(c: Column, level: Column) -> Column:
    return (
        F.when(level == "0", c)
        .when(level == "1", F.regexp_replace(c, _BROKEN, "$1"))
        .otherwise(F.regexp_replace(c, r"(?s)\\(.)", "$1"))
    )


def render_turn(role: Column, text: Column, level: int) -> Column:
    """One turn of the grammar, formatted at a level."""
    body = escape(text, level)
    out = F.concat(F.lit(f"{MARKS[None][0]}{level}"), escape(role, level, True), F.lit("\n"), body, F.lit(MARKS[None][1]))
    for name in ("user", "assistant"):
        a, z = MARKS[name]
        out = F.when(role == name, F.concat(F.lit(f"{a}{level}"), body, F.lit(z))).otherwise(out)
    return out


def split_turns(chat: Column) -> Column:
    """The turns of a formatted chat, still formatted: it is cut behind each closing string."""
    return F.filter(F.split(chat, _TURN_END), lambda x: x != "")


def parse_turn(turn: Column) -> Column:
    """struct(role, text, loss): what one formatted turn says; null where it breaks the grammar."""

    def inner(name):
        a, z = MARKS[name]
        body = F.substring(turn, F.lit(len(a) + 2), F.length(turn) - len(a) - len(z) - 1)
        return turn.startswith(a) & turn.endswith(z), body, F.substring(turn, len(a) + 1, 1)

    def said(role, text, loss):
        return F.struct(role.alias("role"), text.alias("text"), F.lit(loss).alias("loss"))

    out = F.lit(None)
    fits, body, level = inner(None)
    role = F.when(level == "2", F.regexp_extract(body, _ROLE, 1)).otherwise(F.substring_index(body, "\n", 1))
    text = F.substring(body, F.length(role) + 2, F.length(body))
    out = F.when(fits, said(unescape(role, level), unescape(text, level), False))
    for name in ("user", "assistant"):
        fits, body, level = inner(name)
        out = F.when(fits, said(F.lit(name), unescape(body, level), name == "assistant")).otherwise(out)
    return out


def parse_chat(chat: Column) -> Column:
    """array<struct(role, text, loss)>: the deterministic parser."""
    return F.transform(split_turns(chat), parse_turn)


def formatted_turn(role: Column, text: Column) -> Column:
    """A turn at the lowest level whose parse gives the source back."""

    def good(level):
        turn = render_turn(role, text, level)
        back = parse_chat(turn)
        same = (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text)
        if level == 0:  # no control string stays inside, though some would not mislead the parser
            same = ~text.rlike(_CONTROL) & ~role.rlike(_CONTROL) & same
        return same

    return (
        F.when(good(0), render_turn(role, text, 0)).when(good(1), render_turn(role, text, 1)).otherwise(render_turn(role, text, 2))
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: conv_id, chat (the formatted text), turns (the parse of it), identical.

    Rows go by turn, then role, then text (for repeated turn numbers); a null
    turn comes first. A null role or text counts as empty. Repeated rows are
    turns of their own. A null conv_id is a conversation of its own. An empty
    table gives no rows. Other columns are not read, so their names may clash.
    `identical` says that the parse equals the source turns.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("line", formatted_turn(F.col("role"), F.col("text")))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "line"))).alias("source"))
    chats = chats.select("conv_id", "source", F.array_join("source.line", "").alias("chat"))
    chats = chats.withColumn("turns", parse_chat(F.col("chat")))
    same = F.transform("source", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))) == F.transform(
        "turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))
    )
    return chats.select("conv_id", "chat", "turns", same.alias("identical"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digest columns of format_chats' output, all derived from the formatted text's parse."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("chat").cast("long").alias("formatted_chars"),
        "identical",
    )
