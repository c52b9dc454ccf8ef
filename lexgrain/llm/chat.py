r"""Chat formatting of reply trees, with DataFrame operations only.

Nodes are replies that name their parent.  Self-joins double the distance of a table of
jumps (node, the node so far above it), log2(depth) tables, each written to the shared
folder.  From the leaves these jumps, longest first, reach every node above once: each
round joins what is reached to one table, so all root-to-leaf paths are enumerated with
a row a step and no path is held as a whole.  Branches are ranked by summed score and
each chosen path is formatted as one conversation:

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Reversible escape of roles and texts: backslashes are doubled, then a backslash is
put after the first character of every control string of CONTROLS (in a role, also
before every line end), so none is left;
dropping each backslash and keeping the character after it restores the text.  The
loss mask is an array of [start, stop) places (code points) in the formatted string,
one for each assistant text, none of the marks.

Results for odd input: a null text or role counts as empty; an empty table gives an
empty result; nodes whose parent does not exist are roots; a cycle raises an error
after as many rounds as MAX_ROUNDS allows; ties of score rank by leaf; conversation
rows that repeat a turn are ordered by role and text; extra columns are ignored.
One conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MAX_ROUNDS = 24
MASKED = "assistant"


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def steps(nodes: DataFrame) -> DataFrame:
    """leaf, node, above (how far above the leaf, from 0): a row for each step of each root-to-leaf path of nodes(node, parent)."""
    known = nodes.select(F.col("node").alias("up")).distinct()
    jump = nodes.select("node", F.col("parent").alias("up")).join(known, "up").select("node", "up")
    jumps: list[DataFrame] = []
    while True:
        jump = table(jump, "jumps")
        if jump.isEmpty():
            break
        if len(jumps) == MAX_ROUNDS:
            raise ValueError("the replies form a cycle")
        jumps.append(jump)
        jump = jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))
    inner = nodes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    reached = nodes.join(inner, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        here = F.struct("node", "above")
        there = F.struct(F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        both = F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there)))
        reached = reached.join(jumps[k], "node", "left").select("leaf", both.alias("s")).select("leaf", "s.node", "s.above")
    return reached


def format_paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, score, rank, formatted, loss: one row a root-to-leaf path of nodes(tree, node, parent, role, text, score).

    best: only so many best-scored paths a tree."""
    path = steps(nodes.select("node", "parent")).select("leaf", "node", (-F.col("above")).alias("i")).join(nodes.drop("parent"), "node")
    role, text = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    parts = path.select("tree", "leaf", "i", "score", head.alias("head"), text.alias("body"), (F.col("role") == MASKED).alias("masked"))
    part = F.struct("i", F.concat("head", "body", F.lit(END + "\n")).alias("s"), F.char_length("head").cast("long").alias("h"), F.char_length("body").cast("long").alias("b"), F.coalesce("masked", F.lit(False)).alias("m"))
    held = parts.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(part)).alias("ps"))
    # one pass over the turns: length so far, spans of the loss
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("loss"))
    tail = len(END) + 1

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["h"]
        span = F.array(F.struct(start.alias("start"), (start + p["b"]).alias("stop")))
        return F.struct((start + p["b"] + tail).alias("at"), F.when(p["m"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    out = held.select("tree", "leaf", "score", F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("formatted"), F.aggregate("ps", zero, step)["loss"].alias("loss"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.col("score").desc(), F.col("leaf").asc())))
    return out.where(F.col("rank") <= best) if best else out


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of structs role, text) and loss_text, both parsed from formatted and loss."""
    escaped_end = END.replace("|", r"\|")
    turns = F.slice(F.split("formatted", escaped_end + "\n"), 1, F.greatest(F.size(F.split("formatted", escaped_end + "\n")) - 1, F.lit(0)))

    shape = r"(?s)^<\|im_start\|>((?:\\.|[^\\\n])*)\n(.*)$"

    def turn(t: Column) -> Column:
        return F.struct(unescape(F.regexp_extract(t, shape, 1)).alias("role"), unescape(F.regexp_extract(t, shape, 2)).alias("text"))

    loss = F.array_join(F.transform("loss", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))), "")
    return formatted.withColumns({"turns": F.transform(turns, turn), "loss_text": unescape(loss)})


def as_nodes(conversations: DataFrame) -> DataFrame:
    """Reply nodes of rows (conv_id, turn, role, text): each turn answers the one before; node identifiers are (conv_id, place)."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("place"))
    node = lambda p: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.format_string("%012d", p))
    return rows.select(F.col("conv_id").alias("tree"), node(F.col("place")).alias("node"), F.when(F.col("place") > 1, node(F.col("place") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
