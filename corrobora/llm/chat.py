"""Relational chat formatting, in Spark expressions only.

The turns of a conversation are collected as structs, sorted by turn, and runs
of one role are merged by an array aggregation: a run opens with its role's
header and its turns are parted by a separator, so each can be read back. Texts
are escaped so that no control string can occur in them.

Control characters are U+0001 (escape), U+0002 (header), U+0003 (end of header),
U+0004 (turn separator) and U+0005 (end of run). In texts and roles each of
these five becomes U+0001 followed by a letter, which is undone on reading.

The loss mask covers exactly the assistant's texts. ``format_conversations``
returns the formatted text and ``spans``, the mask as (start, length) in code
points; reading back uses these alone.

Defined results: a null text is an empty one; a null role is the role ``''``;
turns are ordered by number, then role and text, nulls first; repeated rows
are repeated turns; a null conv_id is one conversation; an empty table gives
no rows; other columns are not read. One conversation is one output row, so
its turns meet in one task by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE, HEADER, BODY, SPLIT, END = "\x01", "\x02", "\x03", "\x04", "\x05"
#: Turns, or spans, that are summed up or cut together, so that a long conversation costs no square of its turns.
CHUNK = 256
_CODES = {ESCAPE: "e", HEADER: "h", BODY: "b", SPLIT: "s", END: "n"}


def escape(text: Column) -> Column:
    """Control characters as U+0001 and a letter; the escape itself first."""
    for c, letter in _CODES.items():
        text = F.replace(text, F.lit(c), F.lit(ESCAPE + letter))
    return text


def unescape(text: Column) -> Column:
    for c, letter in reversed(_CODES.items()):
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(c))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and spans: the loss mask's (start from 0, length) in code points."""
    role = escape(F.coalesce(F.col("role"), F.lit("")))
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), escape(text).alias("text"))
    gathered = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # what stands before each turn: a separator inside a run, else the end of the run before and a header
    marked = F.transform(
        "ts",
        lambda t, i: F.struct(
            F.when(i == 0, F.concat(F.lit(HEADER), t["role"], F.lit(BODY)))
            .when(F.get("ts", i - 1)["role"] == t["role"], F.lit(SPLIT))
            .otherwise(F.concat(F.lit(END + HEADER), t["role"], F.lit(BODY)))
            .alias("lead"),
            t["text"].alias("text"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    rows = gathered.select("conv_id", marked.alias("ms"))
    sizes = F.transform("ms", lambda m: F.struct(F.char_length(m["lead"]).alias("lead"), F.char_length(m["text"]).alias("text"), m["loss"].alias("loss")))
    formatted = F.concat(F.array_join(F.transform("ms", lambda m: F.concat(m["lead"], m["text"])), ""), F.lit(END))
    rows = rows.select("conv_id", formatted.alias("formatted"), _chunks(sizes).alias("chunks"))
    # where chunks start, then turns inside them: arrays that grow one by one stay short
    totals = F.transform("chunks", lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["lead"] + x["text"]))
    starts = F.aggregate(
        totals, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"],
    )
    spans = F.transform(
        F.arrays_zip("chunks", starts.alias("start")),
        lambda z: F.aggregate(
            z["chunks"],
            F.struct(z["start"].alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["lead"] + x["text"]).alias("at"),
                F.when(x["loss"], F.array_append(acc["out"], F.struct((acc["at"] + x["lead"]).alias("start"), x["text"].alias("length")))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        ),
    )
    return rows.select("conv_id", "formatted", F.flatten(spans).alias("spans"))


def _chunks(items: Column) -> Column:
    """An array in pieces of ``CHUNK``."""
    return F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) in order, and the text under the loss mask, unescaped."""
    runs = F.filter(F.split(F.col("formatted"), f"{END}", -1), lambda r: r != "")
    turns = F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.split(F.substring_index(r, BODY, -1), SPLIT, -1),
                lambda t: F.struct(unescape(F.substring_index(F.substr(r, F.lit(2)), BODY, 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    # a chunk of spans is cut from the whole text first, then each span from that
    cut = F.transform(
        _chunks(F.col("spans")),
        lambda c: F.transform(
            F.array(F.substr("formatted", c[0]["start"] + 1, F.element_at(c, -1)["start"] + F.element_at(c, -1)["length"] - c[0]["start"])),
            lambda part: F.array_join(F.transform(c, lambda s: F.substr(part, s["start"] - c[0]["start"] + 1, s["length"])), ""),
        )[0],
    )
    loss = F.when(F.size("spans") > 0, F.array_join(cut, "")).otherwise("")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), unescape(loss).alias("loss"))


def chat_digest(turns: DataFrame) -> DataFrame:
    """Digests of what is read back from each formatted conversation."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_conversations(turns)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose two texts look like control strings."""
    probe = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    made = F.array(*(F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in rows))
    own = turns.sparkSession.range(1).select(F.inline(made))
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)


#: The same digests in DuckDB: sizes of the marks are those of the template above.
CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
), marked AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same, row_number() OVER w AS k,
    length(regexp_replace(role, '[^\x01-\x05]', '', 'g')) AS role_marks, length(regexp_replace(text, '[^\x01-\x05]', '', 'g')) AS text_marks
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + text_marks + CASE WHEN same THEN 1 ELSE 3 + length(role) + role_marks END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
