"""Chat formatting in budgeted windows.

A conversation is cut into blocks of BLOCK turns, the unit of work, so that one very long
conversation spreads over many tasks. Inside a block, prefix sums of turn tokens choose windows
of whole turns within the budget. Each window begins with the conversation's system turn, where
it does not hold it itself, and with the last turns before it, as far as the history budget and
HISTORY_TURNS go, also across blocks. Loss spans cover the assistant texts that are new in a
window; repeated ones are masked.

A turn's block follows from its place in the conversation, not from its number. Conversations of
one block need no places. The turns of longer ones are sorted over all tasks by range and written;
a turn's place is its place in its part of the sorted rows and the conversation's turns in the
parts before, so no conversation is ever in one task, nor all turns of one number.

The template is <|im_start|>role, a line break, the text, <|im_end|> and a line break. Inside
texts "&" becomes "&amp;" and "<|" becomes "&lt;|", so no text can hold a control string, and
readback() undoes both. Tokens are estimated as a quarter of the UTF-8 bytes, rounded up, and
OVERHEAD for the marks. A single turn beyond the budget has a window of its own, whole.

Defined cases. Null texts and roles are empty. Turns are ordered by turn (null first), role, the
text's first HEAD characters and its hash; repeated rows are turns of their own. Numbers may have
gaps and repeat. Rows of a null conv_id are one conversation. The system turn is the first turn whose role is "system". An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeloom.llm.text import total, whole
from plumeloom.plans.storage import written

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
BLOCK, HEAD = 64, 64
BUDGET, HISTORY_BUDGET, HISTORY_TURNS, OVERHEAD = 2048, 256, 4, 4


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def piece(turn: Column) -> Column:
    role = F.replace(escaped(turn["role"]), F.lit("\n"), F.lit("&#10;"))
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), escaped(turn["text"]), F.lit(END))


def tokens(turn: Column) -> Column:
    return F.ceil(F.octet_length(turn["text"]) / 4).cast("long") + OVERHEAD


def _running(array: Column) -> Column:
    """0 and the running sums of an array."""
    return F.aggregate(array, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


#: The order of a conversation's turns.
ORDER = ("turn", "role", "head", "hash")
#: monotonically_increasing_id() has the part in its upper bits.
PART_BITS = 33


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of long conversations with place, from 0, and n, the conversation's turns."""
    keys = ["conv_id", *ORDER, "_n"]  # equal rows, too, may fall into several parts
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows.drop("_n"), "chat-turns").withColumn("part", F.shiftright("at", PART_BITS))
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    of = Window.partitionBy("conv_id")  # a row for each part that the conversation is in
    before = F.sum("here").over(of.orderBy("part")) - F.col("here")
    runs = runs.select(F.col("conv_id").alias("_id"), F.col("part").alias("_part"), (before - F.col("first")).alias("shift"), F.sum("here").over(of).alias("n"))
    met = rows.join(runs, rows["conv_id"].eqNullSafe(runs["_id"]) & (F.col("part") == F.col("_part")))
    return met.withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "_id", "_part", "shift")


def _blocks(turns: DataFrame) -> DataFrame:
    """One row per block: conv_id, block, fresh, prior, system, several (whether the conversation
    has other blocks). Conversations of one block are gathered as they are."""
    rows = turns.select("conv_id", "turn", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"))
    rows = rows.withColumns({"head": F.left("text", F.lit(HEAD)), "hash": F.xxhash64("text")})
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    long = counts.filter(F.col("n") > BLOCK).select(F.col("conv_id").alias("_long"))
    in_long = rows["conv_id"].eqNullSafe(long["_long"])
    turn = F.struct(*ORDER, "text").alias("turn")
    short = rows.join(long, in_long, "left_anti").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(1).alias("fresh"), turn, F.lit(None).cast("string").alias("system"), F.lit(False).alias("several"))

    placed = _placed(rows.join(long, in_long, "left_semi")).withColumn("block", F.expr(f"place div {BLOCK}"))
    own, later = F.struct("block", F.lit(1).alias("fresh")), F.struct((F.col("block") + 1).alias("block"), F.lit(0).alias("fresh"))
    travels = (F.expr(f"place % {BLOCK}") >= BLOCK - HISTORY_TURNS) & ((F.col("block") + 1) * BLOCK < F.col("n"))
    spread = placed.withColumn("to", F.explode(F.when(travels, F.array(own, later)).otherwise(F.array(own))))
    spread = spread.select("conv_id", "to.block", "to.fresh", turn, F.lit(None).cast("string").alias("system"), F.lit(True).alias("several"))
    first = placed.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("place", "text")).alias("s"), F.max("n").alias("n"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}")))
    frames = first.select("conv_id", every.alias("block"), F.lit(None).cast("int").alias("fresh"), F.lit(None).cast(spread.schema["turn"].dataType).alias("turn"), F.col("s.text").alias("system"), F.lit(True).alias("several"))

    gather = lambda fresh: F.sort_array(F.collect_list(F.when(F.col("fresh") == fresh, F.col("turn"))))
    out = short.unionByName(spread).unionByName(frames).groupBy("conv_id", "block").agg(gather(1).alias("fresh"), gather(0).alias("prior"), F.max("system").alias("system"), F.max("several").alias("several"))
    inside = F.get(F.filter("fresh", lambda t: t["role"] == "system"), F.lit(0))["text"]
    return out.withColumn("system", F.when(F.col("several"), F.col("system")).otherwise(inside))


def windowed(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY_BUDGET) -> DataFrame:
    """One row per block: conv_id, block, several and windows, an array of structs of text,
    fresh_at (where the new turns begin) and loss (spans), in code points from 0."""
    out = _blocks(turns)
    head = F.struct(F.lit("system").alias("role"), F.col("system").alias("text"))
    out = out.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(tokens(head), F.lit(0))).cast("long"))
    out = out.withColumn("all", F.concat("prior", "fresh"))
    out = out.withColumn("sums", _running(F.transform("all", tokens)))
    skip = F.size("prior")

    def open_or_not(starts: Column, i: Column) -> Column:
        used = F.get("sums", i + 1) - F.get("sums", F.element_at(starts, -1))
        return F.when(used > F.col("room"), F.array_append(starts, i)).otherwise(starts)

    starts = F.aggregate(F.filter(F.sequence(skip, F.size("all") - 1), lambda i: i > skip), F.array(skip), open_or_not)
    out = out.withColumn("starts", starts)

    def window(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("all"))
        fresh = F.slice("all", begin + 1, end - begin)
        oldest = F.greatest(F.lit(0), begin - HISTORY_TURNS)
        near = F.transform(F.slice("all", oldest + 1, begin - oldest), lambda t, j: F.struct(t.alias("t"), (F.get("sums", begin) - F.get("sums", oldest + j)).alias("back")))
        kept = F.filter(near, lambda x: (x["back"] <= history) & (x["t"]["role"] != "system"))
        repeated = F.concat(F.lit(""), F.array_join(F.transform(kept, lambda x: piece(x["t"])), ""))
        has_own = F.exists(fresh, lambda t: (t["role"] == "system") & (t["text"] == F.col("system")))
        system = F.when(F.col("system").isNull() | has_own, F.lit("")).otherwise(piece(head))
        return F.struct(F.concat(system, repeated).alias("old"), F.transform(fresh, piece).alias("pieces"), fresh.alias("fresh"))

    out = out.withColumn("parts", F.transform("starts", window))

    def finished(w: Column) -> Column:
        at = _running(F.transform(w["pieces"], lambda p: F.length(p).cast("long")))

        def span(t: Column, i: Column) -> Column:
            end = F.length(w["old"]) + F.get(at, i + 1) - len(END)
            return F.when(t["role"] == "assistant", F.struct((end - F.length(escaped(t["text"]))).alias("start"), end.alias("end")))

        loss = F.filter(F.transform(w["fresh"], span), lambda s: s.isNotNull())
        return F.struct(F.concat(w["old"], F.array_join(w["pieces"], "")).alias("text"), F.length(w["old"]).alias("fresh_at"), loss.alias("loss"))

    return out.select("conv_id", "block", "several", F.transform("parts", finished).alias("windows"))


def formatted(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY_BUDGET) -> DataFrame:
    """One row per window: conv_id, block, number, text, fresh_at, loss."""
    of = windowed(turns, budget, history)
    return of.select("conv_id", "block", F.posexplode("windows").alias("number", "w")).select("conv_id", "block", "number", "w.*")


def readback(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows' texts and masks alone: n_turns, turns (text), loss
    (text) digests and sizes.

    Conversations of one block are digested where they are. The digest of a conversation of
    several blocks needs its whole text in one row, which its definition asks for.
    """

    def turns(w: Column) -> Column:
        marked = F.split(F.substr(w["text"], w["fresh_at"] + 1), F.lit(r"<\|im_end\|>\n"))
        bare = F.transform(F.slice(marked, F.lit(1), F.size(marked) - 1), lambda p: F.substr(p, F.lit(len(BEGIN) + 1)))
        return F.transform(bare, lambda p: F.concat(unescaped(F.substring_index(p, "\n", 1)), F.lit("\n"), unescaped(F.substr(p, F.instr(p, "\n") + 1)), F.lit("\n")))

    def losses(w: Column) -> Column:
        return F.transform(w["loss"], lambda s: unescaped(F.substr(w["text"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))

    out = windows.withColumn("turns", F.flatten(F.transform("windows", turns)))
    out = out.withColumn("loss", F.array_join(F.flatten(F.transform("windows", losses)), ""))
    chars = total(F.transform("windows", lambda w: F.length(w["text"])))
    out = out.select("conv_id", "block", "several", F.size("turns").alias("n"), F.array_join("turns", "").alias("turns"), "loss", chars.alias("chars"))
    whole_or_digest = lambda c: F.when(F.col("several"), F.col(c)).otherwise(F.sha2(c, 256)).alias(c)
    part = F.struct("block", whole_or_digest("turns"), whole_or_digest("loss"))
    out = out.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum(F.length("loss")).cast("long").alias("loss_chars"), F.sum("chars").cast("long").alias("formatted_chars"), F.max("several").alias("several"), F.sort_array(F.collect_list(part)).alias("parts"))
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    digest = lambda c: F.when(F.col("several"), F.sha2(joined(c), 256)).otherwise(joined(c))
    return out.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), "loss_chars", digest("loss").alias("loss_sha256"), "formatted_chars")
