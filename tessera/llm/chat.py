"""Chat formatting with a grammar round trip: what is rendered is parsed again and must give back the turns.

The template is a regular grammar. A turn is one of

    [SYSTEM] text [/SYSTEM]     [INST] text [/INST]     <s>text</s>     [ROLE]name[TURN] text [/TURN]

for the system, the user, the assistant and any other role. No name or text may hold one of these nine control strings;
one that does, or that looks like an escaped one, is escaped by a backslash after the control string's first character
(`</s>` becomes `<\\/s>`, and `<\\/s>` becomes `<\\\\/s>`). Taking off one backslash undoes that, and changes nothing in
a text that needed no escape. Everything is built-in functions: a conversation stays in the JVM from scan to result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The template (fixed values): opening and closing string by role, then those of any other role.
TEMPLATE = {"system": ("[SYSTEM] ", " [/SYSTEM]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE = "[ROLE]", "[TURN] ", " [/TURN]"
#: The role whose texts the loss is taken of.
LEARNED = "assistant"

_ANGLE, _SQUARE = "/?s>", r"(?:/?(?:SYSTEM|INST|TURN)|ROLE)\]"
#: A control string with any number of backslashes after its first character.
CONTROL = rf"<\\*{_ANGLE}|\[\\*{_SQUARE}"
_BARE = rf"<{_ANGLE}|\[{_SQUARE}"
_ESCAPE = rf"(?<=<)(?=\\*{_ANGLE})|(?<=\[)(?=\\*{_SQUARE})"
_UNESCAPE = rf"(?<=<)\\(?=\\*{_ANGLE})|(?<=\[)\\(?=\\*{_SQUARE})"
#: One turn, from where the last one ended to the first closing string of its kind.
_TURN = r"(?s)\G(?:<s>.*?</s>|\[INST\] .*? \[/INST\]|\[SYSTEM\] .*? \[/SYSTEM\]|\[ROLE\].*?\[TURN\] .*? \[/TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template; role and text are escaped already where they must be."""
    out = F.concat(F.lit(OTHER_OPEN), role, F.lit(OTHER_NAMED), text, F.lit(OTHER_CLOSE))
    for name, (before, after) in TEMPLATE.items():
        out = F.when(role == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
    return out


def _part(piece: Column, start: Column, end: Column) -> Column:
    """The characters of piece from `start` (of 0) to before `end`."""
    return F.substring(piece, start + F.lit(1), end - start)


def _read_turn(piece: Column) -> Column:
    """role, text (unescaped), ok, chars (of the piece), skip (characters before the text) and shown (of the text as it stands). ok: no bare control string in role or text."""

    def named(role: Column, skip: Column, tail: int) -> Column:
        shown = _part(piece, skip, F.length(piece) - F.lit(tail))
        return F.struct(
            unescape(role).alias("role"),
            unescape(shown).alias("text"),
            (~F.regexp_like(role, F.lit(_BARE)) & ~F.regexp_like(shown, F.lit(_BARE))).alias("ok"),
            F.length(piece).alias("chars"),
            skip.cast("int").alias("skip"),
            F.length(shown).alias("shown"),
        )

    at = F.instr(piece, OTHER_NAMED) - F.lit(1)
    out = named(_part(piece, F.lit(len(OTHER_OPEN)), at), at + F.lit(len(OTHER_NAMED)), len(OTHER_CLOSE))
    for name, (before, after) in TEMPLATE.items():
        out = F.when(F.startswith(piece, F.lit(before)), named(F.lit(name), F.lit(len(before)), len(after))).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation (see _read_turn), or null where it is none."""
    pieces = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    whole = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda n, x: n + F.length(x)) == F.length(formatted)
    return _let(pieces, lambda p: F.when(whole(p), _let(F.transform(p, _read_turn), lambda turns: F.when(F.forall(turns, lambda t: t["ok"]), turns))))


def _source(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _attempt(turns: Column) -> Column:
    """turns of (role, text, show_role, show_text) rendered and read back: with formatted, read, same."""
    formatted = F.array_join(F.transform(turns, lambda t: rendered(t["show_role"], t["show_text"])), "")

    def compared(f: Column) -> Column:
        def told(read: Column) -> Column:
            return F.struct(turns.alias("turns"), f.alias("formatted"), read.alias("read"), F.coalesce(_source(read) == _source(turns), F.lit(False)).alias("same"))

        return _let(parse(f), told)

    return _let(formatted, compared)


def _escaped(turns: Column) -> Column:
    """turns with those escaped that do not come back when they are rendered and parsed alone."""

    def one(t: Column) -> Column:
        alone = parse(rendered(t["show_role"], t["show_text"]))
        back = lambda x: F.coalesce((F.size(x) == 1) & (_source(x) == _source(F.array(t))), F.lit(False))
        return _let(alone, lambda x: F.when(back(x), t).otherwise(t.withField("show_role", escape(t["show_role"])).withField("show_text", escape(t["show_text"]))))

    return F.transform(turns, one)


#: Escaping is one to one and leaves no bare control string, so that one round is enough; the second would find a fault in that.
ROUNDS = 2


def format_turns(turns: Column) -> Column:
    """An ordered array of (role, text) as a struct of formatted, read (its turns, read back) and same."""
    start = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["role"].alias("show_role"), t["text"].alias("show_text")))
    tried = reduce(lambda last, _: _let(last, lambda a: F.when(a["same"], a).otherwise(_attempt(_escaped(a["turns"])))), range(ROUNDS), _let(start, _attempt))
    return _let(tried, lambda a: F.struct(a["formatted"], a["read"], a["same"]))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (as read back), loss (the mask) for each conversation.

    conversations: conv_id, turn, role, text; other columns are ignored. Rows are ordered by turn, null first, rows of
    one turn by role and text; repeated rows are turns of their own. A null role or text counts as the empty one; rows
    with a null conv_id are one conversation. Without rows there is no conversation. loss has an entry for each turn:
    chars (code points that it takes in `formatted`), skip and keep: of these, after `skip` of them, `keep` are learned
    (0 but for the assistant). The formatted text of a conversation is one value, as its hash is: its turns meet in one row.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    # arrays sort nulls inside of structs first
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    made = grouped.select("conv_id", format_turns(F.col("turns")).alias("f"))
    checked = F.when(F.col("f.same"), F.col("f.formatted")).otherwise(F.raise_error(F.lit("a conversation does not come back from its own format")).cast("string"))
    loss = F.transform("f.read", lambda t: F.struct(t["chars"], t["skip"], F.when(t["role"] == LEARNED, t["shown"]).otherwise(0).alias("keep")))
    turns = F.transform("f.read", lambda t: F.struct(t["role"], t["text"]))
    return made.select("conv_id", checked.alias("formatted"), turns.alias("turns"), loss.alias("loss"))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped turn by turn, as read from a formatted conversation."""
    pieces = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    kept = F.zip_with(pieces, loss, lambda p, m: F.when(m["keep"] > 0, unescape(F.substring(p, m["skip"] + F.lit(1), m["keep"]))).otherwise(""))
    return F.array_join(kept, "")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what format_conversations() gives."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = learned_text(F.col("formatted"), F.col("loss"))
    both = _let(learned, lambda x: F.struct(F.length(x).cast("long").alias("chars"), F.sha2(x, 256).alias("sha256")))
    rows = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), both.alias("l"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.col("l.chars").alias("loss_chars"), F.col("l.sha256").alias("loss_sha256"), "formatted_chars")


def clashing_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings (a fixed value)."""
    return spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)")


def formatted_digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The digests of all conversations and of the clashing one."""
    names = ["conv_id", "turn", "role", "text"]
    return digests(format_conversations(conversations.select(*names).unionByName(clashing_conversation(spark))))
