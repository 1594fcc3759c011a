"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source is one long stream of words: its documents in a seeded order. The
stream is cut into blocks of ``block`` words. The mix has as many seats as its
budget has blocks; sources win seats by the highest quotients target / (2k + 1).
A source's blocks lie in equal shards of RUN blocks or more, at most ``SHARDS``,
which share the seats of their source in the same way; so each shard has an
integer quota. The blocks that a shard takes once more than the others follow
each other, from a seeded place and around its end: with documents in a seeded
order that is as random a choice as any, and it cuts three documents of a shard
at most. All others are taken whole or not at all. A block is taken at most
twice, so no document passes twice its size.

Scale: words are counted once and stored; prefix sums are taken per (source,
hash bucket of ids), a bucket for each ROWS rows of the table, and put together
from bucket totals, so a source with a third of all rows has windows as small as
any other. Texts take no part in it. What is kept per source is its quotas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import WORD, field, joined, n_words, numbered, stored, text_of

BLOCK = 32
SHARDS, RUN = 1024, 1024
#: About how many rows share a window, and the fewest buckets.
ROWS, BUCKETS = 50_000, 256
#: As many sources as this have their quotas sent to all tasks: 24 kB each at most.
SOURCES = 1024
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share
    share[0] / share[1] of all words by weight; a target stops at ``cap`` times
    its source's size and the excess is reshared. The common level is found in
    closed form: with sources sorted by size / weight those below the level are
    full. One row for each source goes through one sort, never one per document.
    """
    up, down = share
    per = sizes.groupBy("source").agg(F.sum("size").cast("decimal(38,0)").alias("n"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", pick.cast("decimal(20,0)"))
    # n1 / w1 < n2 / w2 as doubles may tie wrongly only where the level is the same either way.
    by_fill = Window.orderBy((F.col("n") / F.col("w")).cast("double"), F.col("source").isNull(), F.col("source"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.select(
        "source", "n", "w",
        F.sum("n").over(everything).alias("all_n"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("full_n"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("full_w"),
    )
    # level = top / bottom once the sources before this one are full
    per = per.withColumn("top", (up * F.col("all_n") - down * cap * F.col("full_n")).cast("decimal(28,0)"))
    per = per.withColumn("bottom", (down * (F.col("all_w") - F.col("full_w"))).cast("decimal(20,0)"))
    open_ = F.col("w").cast("double") * F.col("top").cast("double") / F.col("bottom").cast("double") <= cap * F.col("n").cast("double")
    level = F.first(F.when(open_, F.struct("top", "bottom")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    share_of = (F.col("w").cast("double") * F.col("level.top").cast("double")) / F.col("level.bottom").cast("double")
    full = (F.col("n") * cap).cast("double")
    return per.select("source", F.col("n").cast("long").alias("source_size"), F.coalesce(F.least(share_of, full), full).alias("target"))


def _seats(parties: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds ``quota`` by Sainte-Lague: each group's ``seats`` go to the highest target / (2k + 1).

    ``target``, ``cap`` (most seats of a party) and ``seats`` (of its group) are
    columns. Rounding a party's exact share is at most (its share of the group
    x parties / 2 + 1) seats off, so only quotients that near are listed: a few
    for each party, whatever the number of seats.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    p = parties.withColumn("__sum", F.sum("target").over(w)).withColumn("__m", F.count("*").over(w))
    part = F.when(F.col("__sum") > 0, F.col("target") / F.col("__sum")).otherwise(0.0)
    ideal = part * F.col("seats")
    slack = F.ceil(part * F.col("__m")) + 2
    p = p.withColumn("__lo", F.greatest(F.lit(0).cast("long"), F.least(F.col("cap"), F.floor(ideal) - slack)))
    p = p.withColumn("__hi", F.greatest(F.col("__lo"), F.least(F.col("cap"), F.ceil(ideal) + slack)))
    p = p.withColumn("__left", F.col("seats") - F.sum("__lo").over(w))
    listed = p.where("__hi > __lo").select(*group, key, "target", "__left", F.explode(F.expr("sequence(__lo, __hi - 1)")).alias("__k"))
    rank = Window.partitionBy(*group).orderBy((F.col("target") / (2 * F.col("__k") + 1)).desc(), F.col("__k"), F.col(key).isNull(), key)
    won = listed.withColumn("__r", F.row_number().over(rank)).where("__r <= __left").groupBy(*group, key).agg(F.count("*").alias("__won"))
    same = [F.col(f"__p.{c}").eqNullSafe(F.col(f"__w.{c}")) for c in [*group, key]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    p = p.alias("__p").join(won.alias("__w"), on, "left")
    return p.select(*[F.col(f"__p.{c}") for c in parties.columns], (F.col("__lo") + F.coalesce("__won", F.lit(0))).alias("quota"))


def _plan(totals: DataFrame, block: int, seed: int, weights: tuple[int, ...]) -> DataFrame:
    """One row for each source: totals, target, blocks of a shard, and quotas of its shards (at most SHARDS of them)."""
    targets = source_targets(totals, weights)
    s = targets.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("cap", 2 * F.col("blocks"))
    # The last block of a stream may be short: a target is that share of the source's blocks.
    s = s.withColumn("words", F.col("target")).withColumn("target", F.when(F.col("source_size") > 0, F.col("words") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    s = s.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy())).cast("long"))
    s = _seats(s, [], "source").withColumn("target", F.col("words")).drop("seats", "cap", "words")
    # Shards: equal runs of blocks; the last may be shorter.
    s = s.withColumn("run", F.greatest(F.lit(RUN).cast("long"), F.ceil(F.col("blocks") / SHARDS)))
    shards = s.where("blocks > 0").select("source", "quota", "run", "blocks", F.explode(F.expr("sequence(0L, (blocks - 1) div run)")).alias("shard"))
    shards = shards.withColumn("held", F.least(F.col("run"), F.col("blocks") - F.col("shard") * F.col("run")))
    shards = shards.select("source", "shard", F.col("held").cast("double").alias("target"), (2 * F.col("held")).alias("cap"), F.col("quota").alias("seats"), "held")
    quotas = _seats(shards, ["source"], "shard")
    turn = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("held"))
    quotas = quotas.groupBy(F.col("source").alias("q_source")).agg(F.array_sort(F.collect_list(F.struct("shard", "held", "quota", turn.alias("turn")))).alias("shards"))
    s = s.join(quotas, F.col("source").eqNullSafe(F.col("q_source")), "left")
    return s.select(_named("source"), "source_size", "target", "run", "shards")


def _named(source: str):
    """A source's name that is never null, to join and to group by."""
    return F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0")).alias("s_key")


def mix(docs: DataFrame, *, block: int = BLOCK, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, picks (and ``keep``).

    ``picks`` lists the document's runs of words (from, until, copies) in its
    own word numbers, copies 0 included; ``taken`` sums them up. Null texts have
    size 0 and take nothing; a null source is a source of its own, sorted last.
    Repeated rows are rows of their own. Rows with the same id and size are
    interchangeable, so reruns agree on any partitioning. An empty table gives
    no rows; other columns than ``keep`` are neither read nor clash.
    """
    rows = docs.select("doc_id", "source", n_words(text_of()).alias("size"), *keep)
    rows = stored(rows.withColumns({"turn": F.xxhash64(F.lit(seed + 1), "doc_id"), "s_key": _named("source")}), "mix-sizes")
    buckets = max(BUCKETS, rows.count() // ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)).cast("int"))
    totals = stored(rows.groupBy("source", "s_key", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-buckets")
    plan = _plan(totals, block, seed, weights).join(totals.groupBy("s_key").agg(F.sum("n").alias("n")), "s_key")
    plan = stored(plan, "mix-plan")

    before = Window.partitionBy("s_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("s_key", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("offset"))
    inside = Window.partitionBy("s_key", "bucket").orderBy("turn", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).join(offsets, ["s_key", "bucket"])
    rows = rows.select("doc_id", "size", *keep, "s_key", (F.col("inner") + F.col("offset")).alias("start"))
    if plan.count() <= SOURCES:
        rows = rows.join(F.broadcast(plan), "s_key")
    else:
        rows = joined(stored(rows, "mix-starts"), plan, ["s_key"], "n")
    # Of a shard the blocks [turn, turn + rest) are taken once more than the others; past the shard's end they go on at its start.
    picks = f"""if(size = 0, cast(array() as array<struct<from:bigint,until:bigint,copies:int>>), flatten(transform(
        sequence(start div ({block} * run), (start + size - 1) div ({block} * run)), k -> transform(array(shards[cast(k as int)]), q -> filter(transform(array(
            named_struct('a', 0L, 'b', greatest(0L, q.turn + q.quota % q.held - q.held), 'more', 1),
            named_struct('a', greatest(0L, q.turn + q.quota % q.held - q.held), 'b', q.turn, 'more', 0),
            named_struct('a', q.turn, 'b', least(q.held, q.turn + q.quota % q.held), 'more', 1),
            named_struct('a', least(q.held, q.turn + q.quota % q.held), 'b', q.held, 'more', 0)),
          s -> named_struct(
            'from', greatest({block} * (k * run + s.a), start) - start,
            'until', least({block} * (k * run + s.b), start + size) - start,
            'copies', cast(q.quota div q.held + s.more as int))),
          s -> s.from < s.until))[0])))"""
    taken = F.expr("aggregate(picks, 0L, (t, p) -> t + (p.until - p.from) * p.copies)")
    rows = rows.withColumn("picks", F.expr(picks)).withColumn("taken", taken)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "picks", *keep)


def mixed_documents(docs: DataFrame, *, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row for each pass over a document that takes words of it.

    A pass that takes the whole text leaves it as it is; one that takes a part
    (of three documents a shard at most) joins its words by a space. The second
    pass has an id of its own, -1 - doc_id of a number and doc_id + "#2" of a
    text, so ids stay unique where those of ``docs`` are and are not negative.
    ``n_chars``, if there, is counted anew. Documents of which nothing is taken,
    null and empty texts among them, have no row; repeated rows are documents of
    their own; other columns, whatever their names, keep their values. An empty
    table gives no rows.
    """
    rows = numbered(docs, "mix-rows")
    found = mix(rows.select("key", *[field(c).alias(c) for c in ("doc_id", "source", "text")]), block=block, seed=seed, keep=("key",))
    found = found.select("key", "picks").where(F.exists("picks", lambda p: p["copies"] > 0))
    found = rows.join(found, "key").withColumn("pass", F.explode(F.sequence(F.lit(1), F.array_max(F.col("picks.copies")))))
    whole = F.forall("picks", lambda p: p["copies"] >= F.col("pass"))
    words = F.when(~whole, F.regexp_extract_all(field("text"), F.lit(WORD), 0))
    found = found.withColumn("all", whole).withColumn("words", words)
    part = F.expr("array_join(flatten(transform(filter(picks, p -> p.copies >= pass), p -> slice(words, cast(p.from as int) + 1, cast(p.until - p.from as int)))), ' ')")
    found = found.withColumn("part", F.when(F.col("all"), field("text")).otherwise(part))
    columns = {c: field(c) for c in docs.columns} | {"text": F.col("part")}
    kind = docs.schema["doc_id"].dataType
    second = F.concat("whole.doc_id", F.lit("#2")) if kind.typeName() == "string" else (-1 - F.col("whole.doc_id")).cast(kind)
    columns["doc_id"] = F.when(F.col("pass") == 1, F.col("whole.doc_id")).otherwise(second)
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length("part").cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])
