"""Chat formatting by a finite-state machine over roles. Native: DataFrame functions only.

A declarative template gives each role its opening and closing strings and whether its text is trained
on. Control strings inside texts are broken up by a backslash, so the formatted text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How one role is written."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``turns`` by role; ``steps`` are the machine's moves (state, role) -> state.

    ``named`` writes a turn of any other role: its name goes between ``named.opens`` and ``separator``.
    """

    turns: dict[str, Turn]
    steps: dict[tuple[str, str], str]
    accepts: tuple[str, ...]
    begins: str = "<s>"
    start: str = "start"
    named: Turn = field(default_factory=lambda: Turn("[ROLE]", "[/ROLE]"))
    separator: str = "[TEXT]"

    @property
    def control(self) -> list[str]:
        """Strings that must not occur inside a text."""
        found = re.findall(
            r"<<?/?\w+>>?|\[/?\w+\]",
            "".join(t.opens + t.closes for t in (*self.turns.values(), self.named)) + self.separator + self.begins,
        )
        return list(dict.fromkeys(found))


#: Turns between instruction marks, the loss on what the assistant says.
INSTRUCTIONS = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn(" ", " </s>", loss=True),
    },
    steps={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    accepts=("assistant",),
)


def escape(text: Column, template: Template) -> Column:
    """Double each backslash, then put one after the first character of each control string."""
    inner = "|".join(re.escape(x[1:]) for x in template.control)
    heads = "".join(sorted({re.escape(x[0]) for x in template.control}))
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([{heads}])(?={inner})", r"$1\\")


def unescape(text: Column) -> Column:
    """A doubled backslash is one backslash, a single one goes."""
    return F.regexp_replace(text, r"(?s)\\(\\?)", "$1")


def _by_role(role: Column, template: Template, pick, otherwise: Column) -> Column:
    out = otherwise
    for name, turn in template.turns.items():
        out = F.when(role == name, pick(turn)).otherwise(out)
    return out


def segments(turns: Column, template: Template) -> Column:
    """array<struct<role, text>> -> array<struct<text, loss>>, three segments a turn, after ``begins``."""
    named = template.named

    def of(turn: Column) -> Column:
        role = turn["role"]
        name = F.when(role.isNull(), "null").otherwise(F.concat(F.lit("="), escape(role, template)))
        opens = _by_role(role, template, lambda t: F.lit(t.opens), F.concat(F.lit(named.opens), name, F.lit(template.separator)))
        closes = _by_role(role, template, lambda t: F.lit(t.closes), F.lit(named.closes))
        loss = _by_role(role, template, lambda t: F.lit(t.loss), F.lit(named.loss))
        part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(
            part(opens, F.lit(False)), part(escape(turn["text"], template), loss), part(closes, F.lit(False))
        )

    begin = F.array(F.struct(F.lit(template.begins).alias("text"), F.lit(False).alias("loss")))
    return F.concat(begin, F.flatten(F.transform(turns, of)))


def final_state(turns: Column, template: Template) -> Column:
    """Run the machine over the roles; any move that isn't listed leads to ``error``, which stays."""

    def step(state: Column, turn: Column) -> Column:
        out = F.lit("error")
        for (was, role), now in template.steps.items():
            out = F.when((state == was) & (turn["role"] == role), F.lit(now)).otherwise(out)
        return out

    return F.aggregate(turns, F.lit(template.start), step)


def format_chats(
    conversations: DataFrame,
    template: Template = INSTRUCTIONS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments, formatted.

    Turns go by turn number (null first), ties by role and then text. Null text counts as empty; a null
    or unknown role is written with its name and makes the conversation invalid, as does a wrong order.
    Invalid conversations are formatted too. Rows with a null conv_id form one conversation. A
    conversation is one training example and so is held in one row; other columns are not read.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.col(role_col).cast("string").alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    parts = chats.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        final_state(F.col("_turns"), template).isin(*template.accepts).alias("valid"),
        segments(F.col("_turns"), template).alias("segments"),
    )
    return parts.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = INSTRUCTIONS) -> Column:
    """Parse a formatted text into array<struct<role, text, loss>> with the original strings."""
    body = F.substring(formatted, len(template.begins) + 1, 2**31 - 1)
    named = template.named
    forms = [re.escape(t.opens) + r"(?:.*?)" + re.escape(t.closes) for t in template.turns.values()]
    forms.append(re.escape(named.opens) + r"(?:.*?)" + re.escape(named.closes))
    # openings that start with a control string go first; a plain one would also fit inside them
    forms.sort(key=lambda x: x.startswith(("\\ ", " ")))
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)\G(?:" + "|".join(forms) + ")"), F.lit(0))

    def of(piece: Column) -> Column:
        head = F.instr(piece, template.separator)
        raw = F.substr(piece, F.lit(len(named.opens) + 1), head - len(named.opens) - 1)
        name = F.when(raw != "null", unescape(F.substr(raw, F.lit(2))))
        inner = F.substr(piece, head + len(template.separator), F.length(piece) - head - len(template.separator) - len(named.closes) + 1)
        out = F.struct(name.alias("role"), unescape(inner).alias("text"), F.lit(named.loss).alias("loss"))
        for role, t in sorted(template.turns.items(), key=lambda x: -len(x[1].opens)):
            text = F.substr(piece, F.lit(len(t.opens) + 1), F.length(piece) - len(t.opens) - len(t.closes))
            out = F.when(
                F.startswith(piece, F.lit(t.opens)),
                F.struct(F.lit(role).alias("role"), unescape(text).alias("text"), F.lit(t.loss).alias("loss")),
            ).otherwise(out)
        return out

    return F.transform(pieces, of)
