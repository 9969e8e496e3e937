"""Chat formatting by Spark expressions only: sorted turn structs, merged runs of one role, a loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Marks of the template. A block is ``<|role|>`` texts ``<|end|>``; texts of adjacent turns of one role share a
#: block and are parted by ``<|also|>``.
OPEN, CLOSE, END, ALSO = "<|", "|>", "<|end|>", "<|also|>"
#: Control strings that never stand in formatted text as themselves: the template's and those of common chat models.
CONTROLS = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(c: Column) -> Column:
    """``&`` becomes ``&amp;``, then the i-th control string ``&ci;``; so no control string is left."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for i, control in enumerate(CONTROLS):
        c = F.replace(c, F.lit(control), F.lit(f"&c{i};"))
    return c


#: Pieces that lengths are added up over at a time.
RUN = 128


def unescape(c: Column) -> Column:
    for i, control in enumerate(CONTROLS):
        c = F.replace(c, F.lit(f"&c{i};"), F.lit(control))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def format_conversations(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of ``conversations`` (conv_id, turn, role, text).

    Turns go by turn, then role, then text (nulls first; repeated rows stay repeated). A null text or role is empty; rows
    with a null conv_id form one conversation. Adjacent turns of one role are merged into one block. ``loss_spans``
    lists (start, length) in code points of each text of role ``learn``, in order, marks excluded. One row per
    conversation carries its turns, as the result itself does; an empty table gives an empty result.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))
    kept = conversations.groupBy("conv_id").agg(F.sort_array(turns).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)
        mark = F.when(i == 0, F.concat(F.lit(OPEN), escape(t.role), F.lit(CLOSE))).when(
            before.role == t.role, F.lit(ALSO)
        ).otherwise(F.concat(F.lit(END), F.lit(OPEN), escape(t.role), F.lit(CLOSE)))
        return F.struct(mark.alias("mark"), escape(t.text).alias("text"), (t.role == learn).alias("learn"))

    pieces = kept.select("conv_id", F.transform("turns", piece).alias("pieces"))
    zero = F.lit(0).cast("bigint")
    added = lambda x: F.aggregate(x, zero, lambda a, n: a + n)
    pieces = pieces.withColumn("sizes", F.transform("pieces", lambda p: (F.length(p.mark) + F.length(p.text)).cast("bigint")))
    # Where a piece begins: what earlier runs of RUN pieces take, and the pieces before it in its own.
    runs = F.sequence(F.lit(0), F.expr(f"(size(pieces) - 1) div {RUN}").cast("int"))
    pieces = pieces.withColumn("runs", F.transform(runs, lambda r: added(F.slice("sizes", r * RUN + 1, RUN))))
    upto = F.aggregate("runs", F.array(zero), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    pieces = pieces.withColumn("before", upto)

    def span(p: Column, i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        start = F.get("before", run) + added(F.slice("sizes", run * RUN + 1, i - run * RUN)) + F.length(p.mark)
        return F.when(p.learn, F.struct(start.cast("bigint").alias("start"), F.length(p.text).cast("bigint").alias("length")))

    joined = F.array_join(F.transform("pieces", lambda p: F.concat(p.mark, p.text)), "")
    return pieces.select("conv_id", F.concat(joined, F.lit(END)).alias("formatted"), F.array_compact(F.transform("pieces", span)).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns of (role, text), loss_texts, formatted) parsed from the output of ``format_conversations``."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, CLOSE, 1)
        role = unescape(F.replace(head, F.lit(OPEN), F.lit("")))
        rest = F.substr(block, F.length(head) + F.lit(len(CLOSE) + 1), F.length(block))
        return F.transform(
            F.split(rest, r"<\|also\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    loss = F.transform(
        "loss_spans",
        lambda s: unescape(F.substr("formatted", (s.start + 1).cast("int"), s.length.cast("int"))),
    )
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_texts"), "formatted")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the contract, taken from the formatted texts."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    back = read_back(format_conversations(rows))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = """
WITH esc AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
long AS (SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', '')))
   + 2 * (length(text) - length(replace(text, '<|', ''))) // 2 + 2 * (length(text) - length(replace(text, '|>', ''))) // 2
   + 0 * (length(text) - length(replace(text, '</s>', ''))) // 4 + 1 * (length(text) - length(replace(text, '<s>', ''))) // 3
   - 2 * (length(text) - length(replace(text, '[INST]', ''))) // 6 - 3 * (length(text) - length(replace(text, '[/INST]', ''))) // 7
   - 3 * (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 - 4 * (length(text) - length(replace(text, '<</SYS>>', ''))) // 8
   AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prior FROM esc)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN prior = role THEN 8 ELSE length(role) + 4 + 7 END) AS BIGINT) AS formatted_chars
FROM long GROUP BY conv_id
"""
