r"""Chat formatting by a grammar round trip: render, parse the rendered text, compare the turns, escape what conflicts until they are equal.

Everything is a DataFrame expression. A turn is an opening mark, its text and a closing mark:

    system      <<SYS>>text<</SYS>>
    user        [INST]text[/INST]
    assistant   <s>text</s>
    other role  [ROLE]role[/ROLE]<s>text</s>

The parser is deterministic: a mark opens a turn, and the next control string of any kind has to be the one that closes it. A
control string inside a text has backslashes put after its first character, one more than it has (`[INST]` becomes `[\INST]`,
`[\INST]` becomes `[\\INST]`), and the parser takes one away; so what isn't escaped and has `[\INST]` comes back changed, and conflicts.
A conversation is rendered as it is; if the parser doesn't give the same turns, those that fail alone are escaped; then all are;
then it is an error.

Defined results: rows go by turn, nulls first, then by role and text; a null text or role counts as empty; an empty role is another
role; repeated rows are turns of their own; rows with a null conv_id are one conversation; an empty table gives an empty result; further
columns are not read. A conversation becomes one row, so it must fit in a task's memory; its digest has to be made in one place anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
ROLE_OPEN, ROLE_CLOSE = "[ROLE]", "[/ROLE]"
#: A control string after its first character, and with it.
TAIL = r"(</?SYS>>|/?s>|/?INST\]|/?ROLE\])"
CONTROL = r"(?:<</?SYS>>|</?s>|\[/?INST\]|\[/?ROLE\])"
#: A turn as the parser reads it: an opening mark, and what comes up to the next control string.
PIECE = rf"(?s)(?:<<SYS>>|\[INST\]|(?:\[ROLE\].*?{CONTROL})?<s>).*?{CONTROL}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, "$1$2$3")


def _by_role(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = F.when(role == "system", marks["system"])
    for name in ("user", "assistant"):
        out = out.when(role == name, marks[name])
    return out.otherwise(other)


def opening(role: Column, escaped: Column) -> Column:
    name = F.when(escaped, escape(role)).otherwise(role)
    return _by_role(role, OPEN, F.concat(F.lit(ROLE_OPEN), name, F.lit(ROLE_CLOSE + OPEN["assistant"])))


def closing(role: Column) -> Column:
    return _by_role(role, CLOSE, F.lit(CLOSE["assistant"]))


def segments(turns: Column) -> Column:
    """What is written for turns of (role, text, escaped): pieces of text, and which of them the loss covers."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def one(t: Column) -> Column:
        body = F.when(t["escaped"], escape(t["text"])).otherwise(t["text"])
        return F.array(piece(opening(t["role"], t["escaped"]), F.lit(False)), piece(body, t["role"] == "assistant"), piece(closing(t["role"]), F.lit(False)))

    return F.flatten(F.transform(turns, one))


def joined(pieces: Column) -> Column:
    """The formatted conversation: all segments' texts, one after the other."""
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def parse(formatted: Column) -> Column:
    """Turns of (role, text) as the grammar reads a formatted conversation; where it can't, a turn is null or text is left over, which is another null."""

    def content(piece: Column, start: str, end: str) -> Column:
        return F.substring(piece, len(start) + 1, F.length(piece) - len(start) - len(end))

    def turn(role: Column, raw: Column, more: Column | None = None) -> Column:
        clean = ~raw.rlike(CONTROL) if more is None else ~raw.rlike(CONTROL) & ~more.rlike(CONTROL)
        return F.when(clean, F.struct(role.alias("role"), unescape(raw).alias("text")))

    def read(piece: Column) -> Column:
        out = F.when(~piece.endswith(CLOSE["assistant"]) & ~piece.startswith(OPEN["system"]) & ~piece.startswith(OPEN["user"]), F.lit(None))
        for role in ("system", "user", "assistant"):
            out = out.when(piece.startswith(OPEN[role]), F.when(piece.endswith(CLOSE[role]), turn(F.lit(role), content(piece, OPEN[role], CLOSE[role]))))
        name = F.substring_index(F.substring(piece, len(ROLE_OPEN) + 1, F.length(piece)), ROLE_CLOSE, 1)
        start = F.length(name) + len(ROLE_OPEN + ROLE_CLOSE + OPEN["assistant"])
        raw = F.substring(piece, start + 1, F.length(piece) - start - len(CLOSE["assistant"]))
        return out.otherwise(turn(unescape(name), raw, name))

    pieces = F.regexp_extract_all(formatted, F.lit(PIECE), F.lit(0))
    whole = F.array_join(pieces, "") == formatted
    return F.when(whole, F.transform(pieces, read))


def _same(turns: Column) -> Column:
    """Whether turns of (role, text, escaped) come back from what is written for them."""
    plain = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(parse(joined(segments(turns))).eqNullSafe(plain), F.lit(False))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, rounds (0: nothing was escaped), segments: array of (text, loss).

    The segments' texts, joined, are the formatted conversation (`joined`); the loss covers those with `loss`, the texts of assistants.
    """

    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    row = F.struct(col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"))
    rows = turns.select(col(conv).alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def with_mark(mark) -> Column:  # noqa: ANN001
        return F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"), mark(r).alias("escaped")))

    def fails_alone(r: Column) -> Column:
        return ~_same(F.array(F.struct(r["role"].alias("role"), r["text"].alias("text"), F.lit(False).alias("escaped"))))

    tried = rows.select("conv_id", "rows", with_mark(lambda r: F.lit(False)).alias("turns")).withColumn("same", _same(F.col("turns")))
    tried = tried.select("conv_id", "rows", F.lit(0).alias("rounds"), "same", F.when(F.col("same"), F.col("turns")).otherwise(with_mark(fails_alone)).alias("turns"))
    tried = tried.withColumn("again", F.col("same") | _same(F.col("turns")))
    tried = tried.select(
        "conv_id", F.when(F.col("same"), 0).when(F.col("again"), 1).otherwise(2).alias("rounds"),
        F.when(F.col("again"), F.col("turns")).otherwise(with_mark(lambda r: F.lit(True))).alias("turns"),
    )
    right = (F.col("rounds") < 2) | _same(F.col("turns"))
    return tried.select("conv_id", "rounds", F.when(right, segments(F.col("turns"))).otherwise(F.raise_error(F.lit("a conversation doesn't come back from its formatted text"))).alias("segments"))


def format_digest(formatted: DataFrame) -> DataFrame:
    """The rows of `format_conversations` read back: turns by the parser, text under the loss mask by the segments."""
    read = formatted.select("conv_id", "segments", joined(F.col("segments")).alias("formatted"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = read.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss.alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts are control strings; the query adds it to its table.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    rows = [(PROBE_ID, k, role, PROBE_TEXT) for k, role in enumerate(("user", "assistant"))]
    probe = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def format_sql() -> str:
    """DuckDB SQL for `format_digest(format_conversations(with_probe(conversations)))`."""
    tail = TAIL.replace("(", "(?:", 1)
    escaped = r"regexp_replace({0}, '([<\[])(\\*)(" + tail + r")', '\1\\\2\3', 'g')"
    marks = " ".join(f"WHEN '{role}' THEN {len(OPEN[role] + CLOSE[role])}" for role in OPEN)
    other = f"{len(ROLE_OPEN + ROLE_CLOSE + OPEN['assistant'] + CLOSE['assistant'])} + length({escaped.format('role')})"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, k, role, '{PROBE_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' {order}), '') AS loss,
    sum(length({escaped.format('text')}) + CASE role {marks} ELSE {other} END) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g"""
