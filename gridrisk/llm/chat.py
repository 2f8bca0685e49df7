"""Chat formatting in budgeted windows, in Spark SQL expressions only.

A conversation's turns are put in order and their token counts summed; with a quota q, a turn that
lies inside one multiple of q joins the window of that multiple and a turn across a border is a
window of its own.  So windows are turn-aligned, hold at most q tokens unless a single turn has more
(never cut, marked ``over_budget``), and follow from prefix sums alone, without a sequential scan.
Each window starts with the conversation's system turn and repeats the turns just before it, as far as
``history`` and the budget leave room.  The loss mask covers assistant texts only, and a repeated one not again.

A window's text is, for each turn, ``<turn ROLE>TEXT</turn>`` and a line feed.  In roles and texts
``\\``, ``<``, ``>`` and ``#`` are written ``\\\\``, ``\\l``, ``\\g`` and ``\\h``, so no text can form a
mark (or a heading that other templates use) and every text can be read back.

Prefix sums are taken in two levels, within blocks of ``BLOCK`` turn numbers and over blocks, so a very
long conversation is spread over tasks; a window's group is bounded by the budget.

Defined results: null roles and texts count as empty, null turn numbers come first, equal turn numbers
go by role and text, repeated rows are turns of their own, and rows with a null conversation id form
one conversation.  The system turn is the first one if its role is ``system``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
BLOCK = 256
#: Tokens of a turn's marks.
MARK_TOKENS = 4

_OPEN, _CLOSE = "<turn ", "</turn>\n"


def count_tokens(text: Column) -> Column:
    """The default count: a token for every four characters begun."""
    return F.ceil(F.length(text) / 4).cast("long") + MARK_TOKENS


def escape(text: Column) -> Column:
    for sign, name in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ("#", "\\h")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def unescape(text: Column) -> Column:
    def names(part: Column) -> Column:
        for sign, name in (("<", "\\l"), (">", "\\g"), ("#", "\\h")):
            part = F.replace(part, F.lit(name), F.lit(sign))
        return part

    # pairs of backslashes first, from the left: what is left of a run belongs to a name
    return F.array_join(F.transform(F.split(text, r"\\\\"), names), "\\")


def _turns(rows: DataFrame, tokens) -> DataFrame:
    """Turns with their window's quota, tokens before them and their place in the conversation."""
    block = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / BLOCK)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    t = rows.withColumn("n", tokens(F.col("text"))).withColumn("block", F.when(F.col("turn").isNotNull(), block))
    inside = Window.partitionBy("conv", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = Window.partitionBy("conv", "block").orderBy(*order)
    t = t.select("*", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("in_block"),
                 F.row_number().over(numbered).alias("k"))
    earlier = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("conv", "block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    blocks = blocks.select(F.col("conv").alias("c"), F.col("block").alias("b"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("blocks_before"),
                           F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    t = t.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    return t.select("conv", "role", "text", "n", (F.col("blocks_before") + F.col("in_block")).alias("before"),
                    (F.col("rows_before") + F.col("k")).alias("place"))


def windows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, tokens=count_tokens) -> DataFrame:
    """``conv``, ``window`` (ascending in the conversation), ``text``, ``n_tokens``, ``n_repeated`` (leading turns
    that are repeats), ``loss`` (array of start, length in code points) and ``over_budget``."""
    quota = max(1, budget - history)  # the system turn takes its tokens from the history's share
    history = min(history, quota)
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    t = _turns(rows, tokens)
    first_part, last_part = F.floor(F.col("before") / quota), F.floor((F.col("before") + F.col("n") - 1) / quota)
    t = t.withColumn("window", first_part + last_part)

    # of each window: where it starts, the starts of the next three (within q tokens no more can start),
    # and the conversation's system turn
    system = F.struct("role", "text", "n")
    w = t.groupBy("conv", "window").agg(
        F.min("before").alias("start"), F.sum("n").alias("size"),
        F.max(F.when((F.col("place") == 1) & (F.col("role") == "system"), system)).alias("system"))
    along = Window.partitionBy("conv").orderBy("window")
    w = w.withColumn("system", F.first("system", ignorenulls=True).over(along))
    # the tokens left for repeated turns
    room = F.least(F.lit(history), F.lit(budget) - F.col("size")) - F.coalesce(F.col("system.n"), F.lit(0))
    w = w.withColumn("to", F.struct("window", "start", room.alias("room")))
    w = w.select(F.col("conv").alias("c"), F.col("window").alias("own"), "start", "system",
                 F.array(*[F.lead("to", i).over(along) for i in (1, 2, 3)]).alias("later"))
    placed = t.join(w, F.col("conv").eqNullSafe(F.col("c")) & (F.col("window") == F.col("own")))
    is_system = (F.col("place") == 1) & (F.col("role") == "system")
    again = F.filter("later", lambda x: x.isNotNull() & ~is_system & (x["start"] - F.col("before") <= x["room"]))
    repeats = placed.select("conv", F.explode(again).alias("to"), "role", "text", "n", "place")
    repeats = repeats.select("conv", "to.window", "role", "text", "n", F.col("place").cast("long").alias("place"),
                             F.lit(True).alias("repeated"))
    heads = (w.filter("system is not null and start > 0")
              .select(F.col("c").alias("conv"), F.col("own").alias("window"), "system.role", "system.text", "system.n",
                      F.lit(1).cast("long").alias("place"), F.lit(True).alias("repeated")))
    own = t.select("conv", "window", "role", "text", "n", F.col("place").cast("long").alias("place"),
                   F.lit(False).alias("repeated"))
    every = own.unionByName(repeats).unionByName(heads)

    head = F.concat(F.lit(_OPEN), escape(F.col("role")), F.lit(">"))
    every = every.withColumn("body", escape(F.col("text"))).withColumn("head", head)
    every = every.withColumn("piece", F.concat("head", "body", F.lit(_CLOSE)))
    so_far = Window.partitionBy("conv", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(so_far), F.lit(0)) + F.length("head")
    every = every.withColumn("start", start.cast("long"))
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    span = F.struct(F.col("start"), F.length("body").cast("long").alias("length"))
    out = every.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(target, span))).alias("loss"),
        F.sum("n").alias("n_tokens"), F.sum(F.col("repeated").cast("long")).alias("n_repeated"))
    return out.select("conv", "window", F.array_join(F.col("pieces")["piece"], "").alias("text"), "n_tokens", "n_repeated",
                      "loss", (F.col("n_tokens") > budget).alias("over_budget"))


def read_turns(text: Column) -> Column:
    """The turns of a window's text: array of role and text, unescaped."""
    def turn(piece: Column) -> Column:
        head = F.locate(">", piece)
        role = F.substr(piece, F.lit(len(_OPEN) + 1), head - len(_OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, head + 1)).alias("text"))

    pieces = F.split(text, _CLOSE)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one string."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substr(text, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
