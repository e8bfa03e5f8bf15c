r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent
turns of one role become a block; blocks are written one after another:

    <s>role[INST]text[/INST][INST]text[/INST]</s>

so that a block's turns stay apart.  In roles and texts a backslash is doubled
and a control string gets one after its first character, which is undone
without loss.  The loss mask is a list of spans, in code points of the whole
formatted string, one for each assistant turn.

Defined results: a null text or role is empty; a null turn comes first; rows
that share a turn are ordered by role, then text, and repeated rows all stay;
a null conversation id is a conversation of its own; very long texts stay
whole; an empty table gives an empty table; other columns are left behind.
A conversation is one row of the result, so its turns meet in one task; the
work there is in proportion to their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (OPEN, CLOSE, BEGIN, END)
#: Places of a span list, or characters of a text, that are worked through at a time.
STEP = 512
LEARNT_ROLE = "assistant"


def _marked(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: Column) -> Column:
    """Text in which no control string is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(_marked(c)))
    return text


def unescape(text: Column) -> Column:
    """What escape() was given."""
    for c in CONTROLS:
        text = F.replace(text, F.lit(_marked(c)), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def prefix_sums(values: Column) -> Column:
    """Sum of all values before each place of an array<bigint>.

    Sums are taken within runs of STEP places and then over runs, so that the
    arrays copied along the way stay short.
    """
    zero = F.array().cast("array<bigint>")

    def running(a: Column) -> Column:
        return F.aggregate(a, F.struct(F.lit(0).cast("bigint").alias("sum"), zero.alias("seen")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["seen"], F.array(s["sum"])).alias("seen")), lambda s: s["seen"])

    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int"))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda k: F.slice(values, k * STEP + 1, F.lit(STEP)))
    totals = running(F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda s, x: s + x)))
    return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), totals.alias("total")), lambda z: F.transform(running(z["run"]), lambda x: x + z["total"])))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start, length: code points, from 0) and n_blocks.

    turns: conv_id, turn, role, text.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    one = one.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == LEARNT_ROLE).alias("learnt"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    places = F.sequence(F.lit(1), F.size("turns"))
    one = one.withColumn("firsts", F.filter(places, lambda i: (i == 1) | (F.get(F.col("turns"), i - 1)["role"] != F.get(F.col("turns"), i - 2)["role"])))
    one = one.withColumn("blocks", F.transform("firsts", lambda i, k: F.slice("turns", i, F.coalesce(F.get(F.col("firsts"), k + 1), F.size("turns") + 1) - i)))
    block = lambda b: F.concat(F.lit(OPEN), b[0]["role"], F.lit(BEGIN), F.array_join(F.transform(b, lambda t: t["text"]), END + BEGIN), F.lit(END + CLOSE))
    inner, edge = len(END + BEGIN), len(END + CLOSE)
    before = F.flatten(F.transform("blocks", lambda b, k: F.transform(b, lambda t, i: F.when(i > 0, F.lit(inner)).otherwise(F.when(k > 0, F.lit(edge)).otherwise(F.lit(0)) + len(OPEN + BEGIN) + F.length(t["role"])).cast("bigint"))))
    one = one.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"), F.size("blocks").cast("long").alias("n_blocks"), before.alias("before"), F.transform("turns", lambda t: F.struct(t["learnt"].alias("learnt"), F.length(t["text"]).cast("bigint").alias("length"))).alias("turns"))
    steps = F.zip_with("before", "turns", lambda b, t: b + t["length"])
    one = one.withColumn("ahead", prefix_sums(steps))
    spans = F.transform("turns", lambda t, i: F.struct(t["learnt"].alias("learnt"), (F.get(F.col("ahead"), i) + F.get(F.col("before"), i)).alias("start"), t["length"].alias("length")))
    return one.select("conv_id", "formatted", F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"), "n_blocks")


def read_chats(chats: DataFrame) -> DataFrame:
    """chats with turns (role, text) and learnt (the text of each loss span), read from the formatted strings alone."""
    cut = lambda c: "".join("\\" + x if x in "[]/" else x for x in c)  # noqa: E731  a control string as a regular expression

    def turns(b: Column) -> Column:
        parts = F.split(b, cut(BEGIN), -1)
        return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: F.struct(unescape(F.substr(parts[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(F.left(p, F.length(p) - len(END))).alias("text")))

    blocks = F.split("formatted", cut(CLOSE), -1)
    found = chats.withColumn("_parts", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{STEP * 8}}}"), F.lit(0)))
    first, last = lambda s: F.floor(s["start"] / (STEP * 8)), lambda s: F.floor((s["start"] + s["length"]) / (STEP * 8))
    spanned = lambda s: F.substr(F.array_join(F.slice("_parts", (first(s) + 1).cast("int"), (last(s) - first(s) + 1).cast("int")), ""), (s["start"] - first(s) * (STEP * 8) + 1).cast("int"), s["length"].cast("int"))
    return found.select(*chats.columns, F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns)).alias("turns"), F.transform("loss_spans", lambda s: unescape(spanned(s))).alias("learnt"))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, counts and digests of what is read back from its formatted string."""
    read = read_chats(format_chats(turns))
    sha = lambda parts: F.sha2(F.array_join(parts, "").cast("binary"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        F.aggregate("learnt", F.lit(0).cast("long"), lambda s, t: s + F.length(t)).alias("loss_chars"),
        sha(F.col("learnt")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


def with_injection(turns: DataFrame) -> DataFrame:
    """turns and conversation -1, whose texts look like control strings."""
    row = lambda i, role: F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    added = turns.sparkSession.range(1).select(F.inline(F.array(row(0, "user"), row(1, LEARNT_ROLE))))
    return turns.select("conv_id", "turn", "role", "text").unionByName(added)


def _sql_escape(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{_marked(c)}')"
    return out


ORACLE_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNT_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARNT_ROLE}'), '')) AS loss_sha256,
  sum(length({_sql_escape("text")}) + CASE WHEN opens = 1 THEN {len(OPEN + BEGIN + END + CLOSE)} + length({_sql_escape("role")}) ELSE {len(END + BEGIN)} END)::BIGINT AS formatted_chars,
  sum(opens)::BIGINT AS n_blocks
FROM marked GROUP BY conv_id
"""
