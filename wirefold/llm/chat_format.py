"""Chat formatting by a grammar that survives a round trip, in DataFrame functions only.

Grammar of a formatted conversation (``E`` is the escape level 0, 1 or 2)::

    conversation := "<s>" turn*  |  "<s:E>" turn*
    turn         := "[INST] " text " [/INST]"          user
                  | "[SYS] " text " [/SYS]"            system
                  | "[OUT] " text "</s>"               assistant
                  | "[TURN " hex(role) "] " text " [/TURN]"   any other role

The parser is deterministic: it cuts the text at every control string and
requires opening and closing ones in turn with nothing between turns.  A
conversation is rendered with its texts as they are, reparsed and compared to
its source; where the two differ, its texts are escaped (level 1: a backslash
after the first character of every control-like string, backslashes doubled;
level 2: codes for every backslash, ``[`` and ``<``) and the trip is made
again, until the recovered turns are identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import materialize

HEADER = r"<s(?::[12])?>"
OPEN = r"\[(?:INST|SYS|OUT|TURN [0-9A-F]*)\] "
CLOSE = r" \[/(?:INST|SYS|TURN)\]|</s>"
CONTROL = f"{HEADER}|{OPEN}|{CLOSE}"
CONTROL_LIKE = r"([\[<])(?=/?(?:INST|SYS|OUT|TURN|s[:>]))"
LEVELS = (0, 1, 2)
CODES = (("\\", "\\0"), ("[", "\\1"), ("<", "\\2"))  # level 2, in the order of replacement


def escape(text: Column, level: int) -> Column:
    """Reversibly break control strings inside ``text``; level 0 leaves it as it is."""
    if level == 0:
        return text
    if level == 1:
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL_LIKE, r"$1\\")
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, level: Column) -> Column:
    """The text before ``escape``."""
    coded = text
    for plain, code in reversed(CODES):
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return F.when(level == 0, text).when(level == 1, F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(coded)


def _opening(role: Column) -> Column:
    return (F.when(role == "user", "[INST] ").when(role == "assistant", "[OUT] ").when(role == "system", "[SYS] ")
            .otherwise(F.concat(F.lit("[TURN "), F.hex(F.encode(role, "UTF-8")), F.lit("] "))))


def _closing(role: Column) -> Column:
    return (F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").when(role == "system", " [/SYS]")
            .otherwise(" [/TURN]"))


def render(turns: Column, level: int) -> Column:
    """The formatted conversation of an array of (role, text)."""
    header = "<s>" if level == 0 else f"<s:{level}>"
    return F.concat(F.lit(header), F.array_join(F.transform(
        turns, lambda t: F.concat(_opening(t["role"]), escape(t["text"], level), _closing(t["role"]))), ""))


def _role(opening: Column) -> Column:
    return (F.when(opening == "[INST] ", "user").when(opening == "[OUT] ", "assistant").when(opening == "[SYS] ", "system")
            .otherwise(F.decode(F.unhex(F.regexp_extract(opening, "TURN ([0-9A-F]*)", 1)), "UTF-8")))


def parse(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Add ``turns`` (array of role, raw, text; null if the text doesn't follow the grammar) and ``level``.

    ``raw`` is a turn's text as it stands in the formatted conversation.
    """
    tokens, pieces = F.col("_tokens"), F.col("_pieces")
    cut = df.withColumns({
        "_tokens": F.regexp_extract_all(F.col(formatted), F.lit(CONTROL), F.lit(0)),
        "_pieces": F.split(F.col(formatted), CONTROL, -1),
    })
    cut = cut.withColumns({
        "_kinds": F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^(?:{OPEN})$"), "o")
                                           .when(t.rlike(f"^(?:{CLOSE})$"), "c").otherwise("h")), ""),
        "_gaps": F.array_join(F.filter(pieces, lambda p, i: (i == 0) | (i % 2 == 1)), ""),
        "_triples": F.arrays_zip(
            F.filter(tokens, lambda t, i: i % 2 == 1).alias("open"),
            F.filter(pieces, lambda p, i: (i % 2 == 0) & (i > 0)).alias("raw"),
            F.filter(tokens, lambda t, i: (i % 2 == 0) & (i > 0)).alias("close")),
        "level": F.coalesce(F.regexp_extract(F.get(tokens, F.lit(0)), r"<s:([12])>", 1).try_cast("int"), F.lit(0)),
    })
    ok = cut["_kinds"].rlike("^h(?:oc)*$") & (F.col("_gaps") == "")
    turns = F.when(ok, F.transform("_triples", lambda t: F.struct(
        _role(t["open"]).alias("role"), t["raw"].alias("raw"), unescape(t["raw"], F.col("level")).alias("text"))))
    paired = F.forall("_triples", lambda t: _closing(_role(t["open"])) == t["close"])
    return cut.withColumn("turns", F.when(ok & paired, turns)).drop("_tokens", "_pieces", "_kinds", "_gaps", "_triples")


def conversation_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text") -> DataFrame:
    """``(conv_id, source)``: each conversation's (role, text) in order; null roles and texts are empty."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("source")).withColumn(
        "source", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def format_conversations(rows: DataFrame, **columns: str) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``, a row per conversation; loss spans are code points, end exclusive.

    Turns are ordered by turn number (nulls first), then role and text;
    repeated rows are turns of their own; the rows of a null id form one
    conversation.  Texts of any length are kept whole.  An empty table gives an
    empty result.  The loss spans cover the assistant texts as they stand in
    ``formatted`` (escaped).  A conversation is one cell, as its format asks;
    more than 2 GB in one can't be formatted.
    """
    source = conversation_turns(rows, **columns)
    same = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("source")
    for level in LEVELS:
        if level == 0:
            trip = parse(source.withColumn("formatted", render(F.col("source"), 0)))
        else:
            again = render(F.col("source"), level)
            trip = parse(trip.withColumn("formatted", F.when(F.col("identical"), F.col("formatted")).otherwise(again))
                         .drop("turns", "level", "identical"))
        trip = trip.withColumn("identical", F.coalesce(same, F.lit(False)))
    checked = trip.withColumn("formatted", F.when(F.col("identical"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation doesn't survive the round trip"))))
    return checked.select("conv_id", "formatted", loss_spans("turns", "level").alias("loss_spans"))


def loss_spans(turns: str, level: str) -> Column:
    """(start, end) of the assistant texts in the formatted conversation."""
    header = F.when(F.col(level) == 0, 3).otherwise(5)
    state = F.struct(header.cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_opening(t["role"]))
        end = start + F.length(t["raw"])
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
                       ).otherwise(acc["spans"])
        return F.struct((end + F.length(_closing(t["role"]))).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, state, step, lambda acc: acc["spans"])


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from their text and loss spans alone."""
    parsed = parse(formatted)
    under_mask = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), F.col("level"))), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.withColumn("loss", under_mask).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_digests(rows: DataFrame, **columns: str) -> DataFrame:
    """Format, write below ``spark.checkpoint.dir``, read back and digest."""
    return digest_formatted(materialize(format_conversations(rows, **columns), "chat"))
