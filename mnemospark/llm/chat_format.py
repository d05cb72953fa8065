r"""Chat formatting with a grammar round trip, by DataFrame functions only.

A formatted conversation is the turns one after the other, nothing between:

    turn       ::=  "[INST]" role "\n" text "[/INST]"    a turn that is given
                 |  "<s>" role "\n" text "</s>"          a turn to learn, of role "assistant"

with the role as in a URL, so that it holds neither line ends nor marks, and no mark within a
text.  The parser takes the first closing mark after an opening one, rejects what has other
marks, and takes one backslash from whatever looks like an escaped mark.  Every formatted
conversation is parsed again and compared with its source: plain first; where recovered and
source turns differ, conflicting content is escaped (a backslash behind the first character of
each mark and of what looks like an escaped mark) and the conversation is parsed and compared
again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The role whose texts are learned.
LEARNED = "assistant"
GIVEN_MARKS, LEARNED_MARKS = ("[INST]", "[/INST]"), ("<s>", "</s>")

#: A mark, or a mark with backslashes behind its first character.
_MARK = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"
_MARKS = r"</?s>|\[/?INST\]"
_TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def rendered(role: Column, text: Column) -> Column:
    """One turn by the grammar; the text as it is."""
    head = F.concat(F.url_encode(role), F.lit("\n"))
    given, learned = (F.concat(F.lit(a), head, text, F.lit(b)) for a, b in (GIVEN_MARKS, LEARNED_MARKS))
    return F.when(role == LEARNED, learned).otherwise(given)


def pieces(formatted: Column) -> Column:
    """The turns that the parser finds, as they are written."""
    return F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))


def _head(piece: Column) -> Column:
    """Code points before the text of a turn."""
    return F.instr(piece, "\n")


def _text_length(piece: Column) -> Column:
    closing = F.when(piece.startswith(LEARNED_MARKS[0]), len(LEARNED_MARKS[1])).otherwise(len(GIVEN_MARKS[1]))
    return F.length(piece) - _head(piece) - closing


def _turn(piece: Column) -> Column:
    opening = F.when(piece.startswith(LEARNED_MARKS[0]), len(LEARNED_MARKS[0])).otherwise(len(GIVEN_MARKS[0]))
    role = F.try_url_decode(F.substring(piece, opening + 1, _head(piece) - opening - 1))
    return F.struct(role.alias("role"), unescape(F.substring(piece, _head(piece) + 1, _text_length(piece))).alias("text"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``role`` and ``text``; null if it is none, that is if
    the turns found are not all of it, it has other marks than theirs, or a role has no end."""
    found = pieces(formatted)
    whole = (F.array_join(found, "") == formatted) & (F.regexp_count(formatted, F.lit(_MARKS)) == 2 * F.size(found))
    return F.when(whole & F.forall(found, lambda p: _head(p) > 0), F.transform(found, _turn))


def loss_mask(formatted: Column) -> Column:
    """One entry a turn: its code points, and where in it the text to learn begins and how long it
    is (0 for turns that are given).  Entries follow each other, so offsets are running sums."""

    def of(piece: Column) -> Column:
        learned = piece.startswith(LEARNED_MARKS[0])
        return F.struct(F.length(piece).alias("chars"), _head(piece).alias("start"), F.when(learned, _text_length(piece)).otherwise(0).alias("length"))

    return F.transform(pieces(formatted), of)


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    parts = F.zip_with(pieces(formatted), mask, lambda p, m: unescape(F.substring(p, m["start"] + 1, m["length"])))
    return F.array_join(parts, "")


def formatted(conversations: DataFrame) -> DataFrame:
    """One formatted text per conversation.

    Returns ``conv_id``, ``formatted``, ``mask`` (the loss mask, see :func:`loss_mask`), ``escaped``
    (whether content had to be escaped) and ``identical`` (whether the parser gives back the
    source, role by role and text by text: always, or the method has failed).

    Turns are ordered by ``turn``, a null one first, ties by role and text, so reruns agree; rows
    that repeat a turn are turns of their own.  Null texts and roles count as empty; a role is
    any text.  A null ``conv_id`` is a conversation of its own.  Extra columns are not read.  An
    empty table gives no rows.  A conversation is one text, so its turns meet in one row, as the
    result does: 2 GB of it is the limit of a value in Spark.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    source = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = F.array_join(F.transform("source", lambda t: rendered(t["role"], t["text"])), "")
    safe = F.array_join(F.transform("source", lambda t: rendered(t["role"], escape(t["text"]))), "")
    first = source.select("conv_id", "source", plain.alias("plain"))
    told = first.select("*", (~parsed(F.col("plain")).eqNullSafe(F.col("source"))).alias("escaped"))
    told = told.select("conv_id", "source", "escaped", F.when(F.col("escaped"), safe).otherwise(F.col("plain")).alias("formatted"))
    return told.select("conv_id", "formatted", loss_mask(F.col("formatted")).alias("mask"), "escaped", parsed(F.col("formatted")).eqNullSafe(F.col("source")).alias("identical"))


def digests(chats: DataFrame) -> DataFrame:
    """What formatted conversations hold, read back from them: ``conv_id``, ``n_turns``,
    ``turns_sha256`` (role, line end, text, line end of every turn), ``loss_chars`` and
    ``loss_sha256`` (the text under the loss mask), ``formatted_chars``; and ``escaped`` and
    ``identical`` as :func:`formatted` tells them."""
    read = chats.select("*", parsed(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("mask")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "identical",
    )


def planted(conversations: DataFrame, conv_id: int, text: str) -> DataFrame:
    """The four columns of ``conversations`` and one conversation more: a user and an assistant,
    both saying ``text``."""
    both = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", LEARNED))]))
    rows = conversations.sparkSession.range(1).select(both.alias("r")).select(F.lit(conv_id).cast("long").alias("conv_id"), "r.turn", "r.role", F.lit(text).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").union(rows)
