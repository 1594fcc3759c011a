r"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

Template of a turn: ``<s>`` role ``[INST]`` text ``</s>``. Inside roles and
texts ``<``, ``[`` and ``\`` are followed by a ``\``, so no control string can
occur there, and removing that ``\`` restores them exactly.

A conversation that exceeds the token budget is cut into windows by prefix sums
of its turns' tokens: a window takes the longest run of whole turns that fits.
Every window starts with the conversation's system turn, then repeats a limited
history; both are outside the loss mask when repeated, so each assistant text
is a target exactly once.

Scale: a conversation of up to SEGMENT turns is one row while it is cut. A
longer one is dealt over tasks by ranges of its turns, numbered by prefix
counts of those ranges, and cut in segments of SEGMENT turns that each know the
system turn and the history before them. So no row and no task holds a whole
long conversation, and its windows are the same however it was dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import stored

TOKENS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
BUDGET = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 128
SEGMENT = 1024
ROLES_TRAINED = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)([<\[\\])\\", "$1")


def _segments(rows: DataFrame, segment: int, history_turns: int) -> DataFrame:
    """(conv_id, segment, lead, turns, head): up to ``segment`` turns in order, after ``lead`` turns of the segment before, and the system turn."""
    turn = F.struct("turn", "role", "text", "tokens")
    head = F.when(F.col("turns")[0]["role"] == "system", F.col("turns")[0])
    long = stored(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > segment).select(F.col("conv_id").alias("l_id")), "chat-long")
    is_long = F.col("conv_id").eqNullSafe(F.col("l_id"))
    split = not long.isEmpty()
    short = rows.join(long, is_long, "left_anti") if split else rows
    whole = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    told = ["conv_id", "segment", "lead", "turns", "head"]
    whole = whole.withColumns({"segment": F.lit(0).cast("long"), "lead": F.lit(0), "head": head}).select(*told)
    if not split:
        return whole

    dealt = rows.join(long, is_long, "left_semi").repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = stored(dealt.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "chat-turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = dealt.groupBy("conv_id", "range").count().select(F.col("conv_id").alias("o_id"), F.col("range").alias("o_range"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("inner", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("at")) - 1)
    placed = placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("o_id")) & (F.col("range") == F.col("o_range"))).withColumn("i", (F.col("inner") + F.col("offset")).cast("long"))
    mine, next_ = F.expr(f"i div {segment}"), F.expr(f"i div {segment} + 1")
    leads = F.col("i") % segment >= segment - history_turns
    parts = placed.withColumn("segment", F.explode(F.when(leads, F.array(mine, next_)).otherwise(F.array(mine))))
    parts = parts.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("i", turn.alias("t")))).alias("p"))
    parts = parts.withColumn("lead", F.size(F.filter("p", lambda x: x["i"] < F.col("segment") * segment))).where(F.size("p") > F.col("lead"))
    parts = parts.select("conv_id", "segment", "lead", F.col("p.t").alias("turns"))
    first = parts.where("segment = 0").withColumn("head", head)
    heads = placed.where("i = 0 and role = 'system'").select(F.col("conv_id").alias("h_id"), turn.alias("head"))
    later = parts.where("segment > 0").join(heads, F.col("conv_id").eqNullSafe(F.col("h_id")), "left")
    return whole.unionByName(first.select(*told)).unionByName(later.select(*told))


def windows(turns: DataFrame, *, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, segment: int = SEGMENT) -> DataFrame:
    """One row for each window: conv_id, window, text, loss (array of from, until), repeated, tokens.

    ``turns`` has conv_id, turn, role, text; null roles and texts are empty,
    turns go by (turn, role, text) with nulls first, a null conv_id is a
    conversation of its own and repeated rows are turns of their own.
    ``window`` is the number of its first new turn. ``loss`` has code point
    offsets into ``text``, end exclusive, over escaped target texts;
    ``repeated`` counts the leading turns that an earlier window had. Tokens
    are an estimate: words and single marks of role and text, counted by a
    regular expression, and 4 for the template. A turn that alone exceeds the
    room left gets a window of its own, over budget: no turn is cut. A window
    ends at every ``segment``-th turn at the latest. Other columns are ignored;
    an empty table gives no rows.
    """
    segment = max(segment, history_turns + 2)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", (F.regexp_count("text", F.lit(TOKENS)) + F.regexp_count("role", F.lit(TOKENS)) + 4).cast("long"))
    c = _segments(rows, segment, history_turns)
    c = c.withColumn("room", F.expr(f"greatest(1, {budget} - coalesce(head.tokens, 0) - {history_tokens})"))
    c = c.withColumn("own_head", F.expr("if(segment = 0 and head is not null, 1, 0)"))
    # A window starts at the first turn and wherever the turns since the last start no longer fit. The system turn is no part of the sum, and no window is it alone.
    c = c.withColumn("starts", F.expr(f"""
        aggregate(sequence(lead, size(turns) - 1), named_struct('sum', 0L, 'starts', cast(array() as array<int>)), (a, i) ->
          if(size(a.starts) = 0, named_struct('sum', if(own_head = 1, 0L, turns[i].tokens), 'starts', array(i)),
          if(a.sum > 0 and a.sum + turns[i].tokens > room + if(segment = 0 and size(a.starts) = 1, {history_tokens}, 0),
             named_struct('sum', turns[i].tokens, 'starts', concat(a.starts, array(i))),
             named_struct('sum', a.sum + turns[i].tokens, 'starts', a.starts))), a -> a.starts)"""))
    c = c.withColumn("spans", F.expr(f"""
        transform(starts, (s, w) -> named_struct('s', s, 'until', if(w + 1 < size(starts), starts[w + 1], size(turns)),
          'again', if(head is null or (segment = 0 and w = 0), 0, 1), 'past',
          if(segment = 0 and w = 0, 0, array_max(filter(sequence(0, least({history_turns}, s - own_head)),
            k -> k = 0 or aggregate(slice(turns, s - k + 1, k), 0L, (a, t) -> a + t.tokens) <= {history_tokens})))))"""))
    shown = f"""transform(spans, x -> named_struct('window', segment * {segment} - lead + x.s, 'repeated', x.again + x.past, 'turns',
        concat(if(x.again = 1, array(head), slice(turns, 1, 0)), slice(turns, x.s - x.past + 1, x.past + x.until - x.s))))"""
    # The outer form keeps the planner from testing the array's size by computing it twice.
    w = c.withColumn("shown", F.expr(shown)).select("conv_id", F.explode_outer("shown").alias("w"))
    w = w.select("conv_id", "w.window", "w.repeated", F.transform("w.turns", lambda t: F.struct(
        escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), t["role"].isin(*ROLES_TRAINED).alias("trained"), t["tokens"].alias("tokens"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("<s>"), p["role"], F.lit("[INST]"), p["text"], F.lit("</s>"))), "")
    loss = """aggregate(sequence(0, size(parts) - 1), named_struct('at', 0, 'found', cast(array() as array<struct<from:int,until:int>>)), (a, i) -> named_struct(
          'at', a.at + 13 + char_length(parts[i].role) + char_length(parts[i].text),
          'found', if(i >= repeated and parts[i].trained, concat(a.found, array(named_struct(
            'from', a.at + 9 + char_length(parts[i].role), 'until', a.at + 9 + char_length(parts[i].role) + char_length(parts[i].text)))), a.found)), a -> a.found)"""
    return w.select("conv_id", "window", text.alias("text"), F.expr(loss).alias("loss"), "repeated", F.expr("aggregate(parts, 0L, (a, p) -> a + p.tokens)").alias("tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets) parsed from the window texts and loss masks alone.

    ``turns`` are the (role, text) that the window is first to show; ``targets``
    are the unescaped texts under its loss mask, in order.
    """
    pieces = F.expr("filter(split(text, '</s>', -1), (p, i) -> i >= repeated and p <> '')")
    # '<s>' opens a piece; the first '[INST]' ends its role, since neither holds a bare control string.
    turn = F.transform(pieces, lambda p: F.struct(
        unescaped(F.regexp_replace(F.regexp_extract(p, r"(?s)^<s>(.*?)\[INST\]", 1), "^$", "")).alias("role"),
        unescaped(F.regexp_replace(p, r"(?s)^<s>.*?\[INST\]", "")).alias("text")))
    targets = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["from"] + 1, s["until"] - s["from"])))
    return formatted.select("conv_id", "window", turn.alias("turns"), targets.alias("targets"), F.char_length("text").alias("n_points"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, read back from windows.

    A digest runs over all texts of a conversation, and SQL has no digest in
    parts, so here (not in ``windows``) the texts of one conversation meet in
    one row: of at most 2 GB, by hand, 100,000 turns of 55 MB pass in a heap of 1 GB and 200,000 of 110 MB do not.
    """
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read_back(formatted).select("conv_id", "window", "n_points", F.size("turns").alias("n"), told.alias("told"), F.array_join("targets", "").alias("loss"))
    whole = lambda part: F.sha2(F.expr(f"listagg({part}, '') within group (order by window)").cast("binary"), 256)
    return parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        whole("told").alias("turns_sha256"),
        F.sum(F.char_length("loss")).cast("long").alias("loss_chars"),
        whole("loss").alias("loss_sha256"),
        F.sum("n_points").cast("long").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
