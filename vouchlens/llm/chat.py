"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``### Role: text``, a line break, ``</turn>`` and a line break. A
deterministic parser reads turns back: an end mark or header counts only without a
backslash before it, and one backslash is taken from a mark that has some. Each turn is
rendered as it stands, parsed and compared with its source; where that differs, its text
is escaped (one more backslash before every control string) until it comes back
identical. The whole conversation is then parsed and compared once more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
#: A role of lower-case letters is written with a capital; any other one as = and its bytes in hexadecimal.
ROLE = r"(?:[A-Z][a-z0-9_]*|=[0-9A-F]*)"
HEADER = rf"### {ROLE}: "
CONTROL = rf"(?:{END}|{HEADER})"
MARK = rf"(?<!\\)({CONTROL})"
#: Backslashes that run into a control string; one more, or one less, escapes it or takes the escape away.
ESCAPABLE = rf"(?<!\\)(\\*+{CONTROL})"
ESCAPED = rf"(?<!\\)\\(\\*+{CONTROL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


#: What a text goes through, one after the other, until it is read back as it was.
LEVELS = (lambda text: text, escape)


def header(role: Column) -> Column:
    plain = role.rlike("^[a-z][a-z0-9_]*$") & ~role.contains("\n")
    name = F.when(plain, F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 1 << 30)))
    return F.concat(F.lit("### "), F.coalesce(name, F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8")))), F.lit(": "))


def rendered(role: Column, body: Column) -> Column:
    return F.concat(header(role), body, F.lit(f"\n{END}\n"))


def parsed(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; null for what the grammar doesn't have."""
    units = F.split(formatted, rf"(?<!\\){END}\n")

    def turn(unit: Column) -> Column:
        name = F.regexp_extract(unit, rf"^### ({ROLE}): ", 1)
        body = F.substring(unit, F.length(name) + 7, F.length(unit) - F.length(name) - 7)
        whole = (name != "") & unit.endswith("\n") & ~body.rlike(MARK)
        role = F.when(
            name.startswith("="), F.decode(F.unhex(F.substring(name, 2, 1 << 30)), "UTF-8")
        ).otherwise(F.lower(name))
        return F.when(whole, F.struct(role.alias("role"), unescape(body).alias("text")))

    found = F.transform(F.slice(units, 1, F.size(units) - 1), turn)
    return F.when(F.element_at(units, -1) == "", found)


def round_trip(role: Column, body: Column, text: Column) -> Column:
    """Whether the turn alone is read back as one turn of this role and text."""
    return F.coalesce(parsed(rendered(role, body)) == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))


def format_chats(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """conv_id, n_turns, formatted, loss (array of start, end, start_byte, end_byte in formatted) and turns.

    ``loss`` holds what a model learns: the texts of ``loss_role`` as they stand in
    ``formatted``, ends exclusive, in code points and in bytes. ``turns`` are the roles
    and texts that the parser reads back; a conversation that isn't read back as it was
    raises an error.

    Turns are ordered by turn, then role and text, so ties and repeated rows (each is a
    turn) have one order; a null turn comes first. Null roles and texts are empty. Rows
    without a conversation id are one conversation with a null id. Long texts are whole,
    an empty table gives an empty result, other columns are not looked at. A conversation
    is one row, so one task holds the turns of any one conversation.
    """
    source = turns.select(
        F.col(id_column).cast("long").alias("conv_id"),
        F.col(turn_column).cast("long").alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    bodies = [level(text) for level in LEVELS]
    tried = reduce(
        lambda later, body: F.when(round_trip(role, body, text), body).otherwise(later), bodies[::-1], F.lit(None)
    )
    order = ["turn", "role", "text"]
    ahead = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def before(size: Column) -> Column:
        return F.coalesce(F.sum(size).over(ahead), F.lit(0))

    pieces = source.withColumn("body", tried).select(
        "conv_id", *order, "body", header(role).alias("head"), rendered(role, F.col("body")).alias("unit")
    )
    placed = pieces.withColumns(
        {
            "at": before(F.length("unit")) + F.length("head"),
            "at_byte": before(F.octet_length("unit")) + F.octet_length("head"),
        }
    )
    span = F.struct(
        F.col("at").alias("start"),
        (F.col("at") + F.length("body")).alias("end"),
        F.col("at_byte").alias("start_byte"),
        (F.col("at_byte") + F.octet_length("body")).alias("end_byte"),
    )
    members = placed.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(F.struct("at", *order, "unit", F.when(role == loss_role, span).alias("span")))
        ).alias("all"),
        F.count("unit").alias("good"),
    )
    whole = members.select(
        "conv_id",
        F.size("all").cast("long").alias("n_turns"),
        F.when(F.col("good") == F.size("all"), F.array_join(F.col("all.unit"), "")).alias("formatted"),
        F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss"),
        F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    back = whole.withColumn("turns", parsed(F.col("formatted")))
    failed = F.raise_error(F.concat(F.lit("not read back as it was: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    return back.select(
        "conv_id", "n_turns", F.when(same, F.col("formatted")).otherwise(failed.cast("string")).alias("formatted"), "loss", "turns"
    )


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    raw = formatted.cast("binary")

    def piece(s: Column) -> Column:
        part = F.substring(raw, (s["start_byte"] + 1).cast("int"), (s["end_byte"] - s["start_byte"]).cast("int"))
        return unescape(F.decode(part, "UTF-8"))

    return F.array_join(F.transform(loss, piece), "")
