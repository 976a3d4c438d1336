"""Quotation linking of conversations, in DataFrame functions only.

Lines that start with ``>`` are quotes; the number of ``>`` (spaces between them allowed)
is the quote level. Quoted lines of one level that follow each other form a passage; a
passage and the own, unquoted lines of a message are normalised (lower case, all white
space, line ends too, as single spaces) and hashed. Within its conversation a passage is
joined to the original message: the first earlier one that holds it, word for word and in
whatever lines. Two rules go by lines. A passage of one line is joined first to a message
that has this line as a whole; and where no message holds a passage of several lines, each
line is joined by itself to the first earlier message that has it as a whole. A message
replies to the original of its outermost quotes that have one (the latest, if several
passages have), else to the message before it. ``n_quotes`` counts the linked quoted lines.

Reply order: a message comes behind the one it answers, and the answers to a message in
the order of their turns, but for the one that goes on with the next turn, which is last. Runs
of messages that answer the one before form a segment; a segment hangs on the message that its
first one answers. Segments are cut into pieces behind such messages, each piece knows the
one that follows it in this order, and pointer doubling along this list gives each piece its rank:
a few numbers a piece, however deep replies go. Conversations are returned one row a
message, without the quotes, with a gapless position.

Nothing here needs a whole conversation in one task: running values go by blocks of turns
first, and positions by ranges of the sorted order.

Defined results: a null text is an empty body; blank quoted lines link nothing; rows that
repeat a (conv_id, turn) all stay and share their links, ordered by role and body; a null
turn comes first and answers nothing; a null conv_id is a conversation; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import saved

BLOCK = 1024  # turns that one window holds
ANCHOR = 4  # words: by its first ones a passage finds the places to compare it with
_QUOTE = "^(?:>[ ]?)+"


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[\\s]+", " ")))


def parse(messages: DataFrame) -> DataFrame:
    """id, conv_id, turn, role, body (without quotes), hashes of own lines, and quoted lines with their places and levels."""
    c = F.col
    quoted = lambda l: l.startswith(">")
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    d = messages.select(F.monotonically_increasing_id().alias("id"), "conv_id", c("turn").cast("long").alias("turn"), "role", lines.alias("lines"))
    own = F.filter("lines", lambda l: ~quoted(l))
    level = lambda l: F.length(F.regexp_replace(F.regexp_extract(l, _QUOTE, 0), " ", ""))
    places = F.filter(F.transform("lines", lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda x: quoted(x["l"]))
    quotes = F.transform(places, lambda x: F.struct(x["i"].alias("i"), level(x["l"]).alias("level"), _normal(F.regexp_replace(x["l"], _QUOTE, "")).alias("line")))
    return d.select("id", "conv_id", "turn", "role", F.trim(F.regexp_replace(F.array_join(own, "\n"), "^\\n+|\\n+$", "")).alias("body"),
                    F.array_distinct(F.transform(F.filter(F.transform(own, _normal), lambda l: l != ""), lambda l: F.xxhash64(l, F.length(l)))).alias("own"),
                    quotes.alias("quotes"))


def _words(words: Column, at: Column | int, n: Column) -> Column:
    """Hash of ``n`` words."""
    return F.xxhash64(F.array_join(F.slice(words, at, n), " "), n)


def passages(parsed: DataFrame) -> DataFrame:
    """id, conv_id, turn, level, lines (hashes), n, k, anchor and h: words, and hashes of the first k and of all, of each quoted passage."""
    c = F.col
    q = parsed.filter(F.size("quotes") > 0).select("id", "conv_id", "turn", F.explode("quotes").alias("q"))
    q = q.select("id", "conv_id", "turn", "q.*")
    # Places less their rank in the level are the same within a run.
    q = q.withColumn("run", c("i") - F.row_number().over(Window.partitionBy("id", "level").orderBy("i"))).filter("line != ''")
    p = q.groupBy("id", "level", "run").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))
    p = p.select("id", "conv_id", "turn", "level", F.array_distinct(F.transform("x.line", lambda l: F.xxhash64(l, F.length(l)))).alias("lines"),
                 F.size("x").alias("n_lines"), F.split(F.array_join("x.line", " "), " ").alias("w"))
    p = p.withColumn("n", F.size("w")).withColumn("k", F.least(F.size("w"), F.lit(ANCHOR)))
    return saved(p.select("id", "conv_id", "turn", "level", F.monotonically_increasing_id().alias("passage"), "lines", "n_lines", "n", "k",
                          _words(c("w"), 1, c("k")).alias("anchor"), _words(c("w"), 1, c("n")).alias("h")), "passages")


def first_holders(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """c2, n2, h2, origin: the first turn that holds each passage in its own words."""
    c = F.col
    keys = wanted.select(c("conv_id").alias("cw"), c("k").alias("kw"), c("anchor").alias("aw"), c("n").alias("n")).distinct()
    m = parsed.filter("turn is not null").join(keys.select("cw").distinct(), c("conv_id").eqNullSafe(c("cw")), "left_semi")
    m = saved(m.select("id", "conv_id", "turn", F.split(_normal(c("body")), " ").alias("w")), "own")
    # Places at which a passage's first words are, then all its words there: a message is compared with no other passages.
    at = m.select("id", "conv_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda p: F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(ANCHOR)), lambda k: p + k - 1 <= F.size("w")),
        lambda k: F.struct(p.alias("p"), k.alias("k"), _words(c("w"), p, k).alias("a")))))).alias("x"))
    at = at.join(keys, c("conv_id").eqNullSafe(c("cw")) & (c("x.k") == c("kw")) & (c("x.a") == c("aw"))).select(c("id").alias("id2"), c("x.p").alias("p"), "n")
    at = at.groupBy("id2").agg(F.collect_set(F.struct("p", "n")).alias("at"))
    full = saved(m.join(at, c("id") == c("id2")).select("conv_id", "turn", "w", "at"), "places")
    held = full.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.filter("at", lambda x: x["p"] + x["n"] - 1 <= F.size("w")), lambda x: F.struct(
        x["n"].alias("n"), _words(c("w"), x["p"], x["n"]).alias("h"))))).alias("x"))
    return held.groupBy(c("conv_id").alias("c2"), c("x.n").alias("n2"), c("x.h").alias("h2")).agg(F.min("turn").alias("origin"))


def quote_links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, origin, n_quotes (linked) of the messages with a linked quote.

    Originals are reduced to the first turn of each line, and of each passage, before the
    join, so each quoted one meets one row, however common it is.
    """
    c = F.col
    p = passages(parsed)
    quotes = p.select("id", "conv_id", "turn", "level", "passage", "n_lines", F.explode("lines").alias("h"))
    wanted = quotes.select(c("conv_id").alias("cw"), c("h").alias("hw")).distinct()
    lines = parsed.select("conv_id", "turn", F.explode("own").alias("h")).filter("turn is not null")
    lines = lines.join(wanted, c("conv_id").eqNullSafe(c("cw")) & (c("h") == c("hw")), "left_semi")
    first = lines.groupBy(c("conv_id").alias("c2"), c("h").alias("h2")).agg(F.min("turn").alias("origin"))
    by_line = saved(quotes.join(first, c("conv_id").eqNullSafe(c("c2")) & (c("h") == c("h2")) & (c("origin") < c("turn")))
                    .select("id", "conv_id", "turn", "level", "passage", "n_lines", "h", "origin"), "line_hits")
    whole = by_line.filter("n_lines = 1").select("passage")
    wanted = p.join(whole, "passage", "left_anti")
    first = first_holders(parsed, wanted)
    held = saved(wanted.join(first, c("conv_id").eqNullSafe(c("c2")) & (c("n") == c("n2")) & (wanted["h"] == c("h2")) & (c("origin") < c("turn")))
                 .select("id", "conv_id", "turn", "level", "passage", F.explode("lines").alias("h"), "origin"), "held")
    rest = by_line.join(held.select("passage").distinct(), "passage", "left_anti")
    hits = held.unionByName(rest.drop("n_lines"))
    hits = hits.groupBy("conv_id", "turn", "level", "id", "h").agg(F.max("origin").alias("origin"))
    by_level = hits.groupBy("conv_id", "turn", "level").agg(F.max("origin").alias("origin"), F.count(F.lit(1)).alias("n"))
    # Outermost level first; both numbers fit one ordering struct.
    return by_level.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "origin")).alias("best"), F.sum("n").alias("n_quotes")).select("conv_id", "turn", c("best.origin").alias("origin"), "n_quotes")


def reply_links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, n_quotes, seg (first turn of the segment) of every distinct turn."""
    c = F.col
    links = quote_links(parsed).select(c("conv_id").alias("c1"), c("turn").alias("t1"), "origin", "n_quotes")
    turns = parsed.select("conv_id", "turn").filter("turn is not null").distinct()
    turns = turns.withColumn("block", F.floor(c("turn") / BLOCK))
    own = Window.partitionBy("conv_id", "block").orderBy("turn")
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = turns.groupBy(c("conv_id").alias("c2"), c("block").alias("b2")).agg(F.max("turn").alias("last"))
    lasts = lasts.withColumn("carried", F.max("last").over(Window.partitionBy("c2").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    t = turns.join(lasts, c("conv_id").eqNullSafe(c("c2")) & (c("block") == c("b2"))).drop("c2", "b2")
    t = t.withColumn("before", F.coalesce(F.lag("turn").over(own), c("carried"))).drop("carried")
    t = t.join(links, c("conv_id").eqNullSafe(c("c1")) & (c("turn") == c("t1")), "left").drop("c1", "t1")
    t = t.withColumn("reply_to", F.coalesce("origin", "before")).withColumn("start", F.when(c("before").isNull() | (c("reply_to") != c("before")), c("turn")))
    t = saved(t, "replies")
    starts = t.groupBy("conv_id", "block").agg(F.max("start").alias("s")).withColumn("carried", F.max("s").over(over))
    starts = starts.select(c("conv_id").alias("c2"), c("block").alias("b2"), "carried")
    run = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(starts, c("conv_id").eqNullSafe(c("c2")) & (c("block") == c("b2")))
    return saved(t.withColumn("seg", F.coalesce(F.max("start").over(run), c("carried"))).select("conv_id", "turn", "reply_to", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), "seg"), "segments")


def _by_blocks(rows: DataFrame, keys: list[str], value: str, name: str, ahead: bool) -> DataFrame:
    """``rows`` with ``name``: the next greater ``value`` of the same keys, or with ``ahead`` off the greatest
    ``mark`` up to and with the row's. Windows hold a block of turns, then a row a block."""
    c = F.col
    rows = rows.withColumn("_b", F.floor(c(value) / BLOCK))
    inside, over = Window.partitionBy(*keys, "_b").orderBy(value), Window.partitionBy(*keys).orderBy("_b")
    if ahead:
        edge, own = F.min(value), F.lead(value).over(inside)
        carried = F.lead("_e").over(over)
    else:
        edge, own = F.max("mark"), F.max("mark").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        carried = F.max("_e").over(over.rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(*keys, "_b").agg(edge.alias("_e")).withColumn("_c", carried)
    blocks = blocks.select(*[c(k).alias(f"_{k}") for k in keys], c("_b").alias("_b2"), "_c")
    same = c("_b") == c("_b2")
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"_{k}"))
    return rows.withColumn("_own", own).join(blocks, same, "left").withColumn(name, F.coalesce("_own", "_c")).drop("_b", "_b2", "_c", "_own", *[f"_{k}" for k in keys])


def _follow(table: DataFrame, pointer: str, step) -> DataFrame:
    """Rounds of pointer doubling over (conv_id, id, pointer, ...) until no pointer is left."""
    c = F.col
    while not table.filter(c(pointer).isNotNull()).isEmpty():
        on = table.select(*[c(x).alias(f"{x}_2") for x in table.columns])
        j = table.join(on, c("conv_id").eqNullSafe(c("conv_id_2")) & (c(pointer) == c("id_2")), "left")
        table = saved(step(j).select(*table.columns), "pointers")
    return table


def piece_ranks(turns: DataFrame) -> DataFrame | None:
    """conv_id, turn, rank of every turn of a conversation with a segment that hangs on another: the order
    of the pieces. None where there is no such segment at all."""
    c = F.col
    same = lambda x: c("conv_id").eqNullSafe(c(x))
    at = turns.select(c("conv_id").alias("c2"), c("turn").alias("t2"), c("seg").alias("parent"))
    side = (turns.filter("turn = seg and reply_to is not null").select("conv_id", c("seg").alias("id"), c("reply_to").alias("on"))
            .join(at, same("c2") & (c("on") == c("t2"))).drop("c2", "t2"))
    side = saved(side, "side")
    if side.isEmpty():
        return None
    t = turns.join(side.select(c("conv_id").alias("c2")).distinct(), same("c2"), "left_semi")
    branches = side.groupBy(c("conv_id").alias("c2"), c("on").alias("b2")).agg(F.min("id").alias("first_side"))
    # The turn that goes on in the segment of a message others hang on begins a piece.
    on = saved(t.filter("turn <> seg").join(branches, same("c2") & (c("reply_to") == c("b2"))).select("conv_id", c("reply_to").alias("branch"), c("turn").alias("goes_on")), "goes-on")
    on2 = on.select(c("conv_id").alias("c2"), c("branch").alias("b2"), "goes_on")
    marked = t.join(on2.select("c2", c("goes_on").alias("g2")), same("c2") & (c("turn") == c("g2")), "left")
    marked = marked.select("conv_id", "turn", "seg", F.when((c("turn") == c("seg")) | c("g2").isNotNull(), c("turn")).alias("mark"))
    pieces = saved(_by_blocks(marked, ["conv_id"], "turn", "piece", ahead=False).select("conv_id", "turn", "seg", "piece"), "pieces")

    # Where the order goes on behind a segment and all that hangs on it: the next segment on the same message,
    # what goes on behind that message, or where its segment's order goes on.
    exits = _by_blocks(side, ["conv_id", "on"], "id", "sibling", ahead=True).join(on2, same("c2") & (c("on") == c("b2")), "left")
    exits = saved(exits.select("conv_id", "id", F.coalesce("sibling", "goes_on").alias("target"), F.when(F.coalesce("sibling", "goes_on").isNull(), c("parent")).alias("up")), "exits")
    exits = _follow(exits, "up", lambda j: j.withColumn("target", F.coalesce("target", "target_2")).withColumn("up", F.when(c("target").isNull(), c("up_2"))))

    ends = pieces.join(branches, same("c2") & (c("turn") == c("b2"))).select(c("conv_id").alias("c3"), c("piece").alias("p3"), "first_side")
    way = exits.select(c("conv_id").alias("c4"), c("id").alias("s4"), "target")
    links = (pieces.filter("turn = piece").select("conv_id", c("piece").alias("id"), "seg").join(ends, same("c3") & (c("id") == c("p3")), "left")
             .join(way, same("c4") & (c("seg") == c("s4")), "left"))
    links = saved(links.select("conv_id", "id", F.coalesce("first_side", "target").alias("next"), F.coalesce("first_side", "target").isNotNull().cast("long").alias("left")), "list")
    links = _follow(links, "next", lambda j: j.withColumn("left", c("left") + F.coalesce("left_2", F.lit(0))).withColumn("next", c("next_2")))
    rank = links.select(c("conv_id").alias("c2"), c("id").alias("p2"), (-c("left")).alias("rank"))
    return pieces.join(rank, same("c2") & (c("piece") == c("p2"))).select("conv_id", "turn", "rank")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, body, reply_to, n_quotes of every message, in reply order by position."""
    c = F.col
    parsed = saved(parse(messages), "parsed")
    turns = reply_links(parsed)
    t = turns.select(c("conv_id").alias("c1"), c("turn").alias("t1"), "reply_to", "n_quotes")
    m = parsed.select("conv_id", "turn", "role", "body").join(t, c("conv_id").eqNullSafe(c("c1")) & (c("turn") == c("t1")), "left")
    m = m.select("conv_id", "turn", "role", "body", "reply_to", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"))
    ranks = piece_ranks(turns)
    if ranks is None:
        m = m.withColumn("rank", F.lit(0).cast("long"))
    else:
        ranks = ranks.select(c("conv_id").alias("c1"), c("turn").alias("t1"), "rank")
        m = m.join(ranks, c("conv_id").eqNullSafe(c("c1")) & (c("turn") == c("t1")), "left").drop("c1", "t1")
        # A null turn comes first.
        m = m.withColumn("rank", F.when(c("turn").isNull(), F.lit(-(1 << 62))).otherwise(F.coalesce("rank", F.lit(0))).cast("long"))
    order = ("conv_id", "rank", "turn", "role", "body")
    m = saved(m.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    parts = m.groupBy(c("conv_id").alias("c2"), c("part").alias("p2")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("c2", "p2", F.coalesce(F.sum("n").over(Window.partitionBy("c2").orderBy("p2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    m = m.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("rank", "turn", "role", "body")))
    return (m.join(parts, c("conv_id").eqNullSafe(c("c2")) & (c("part") == c("p2")))
            .select("conv_id", (c("ahead") + c("i") - 1).cast("long").alias("position"), "turn", "role", "body", "reply_to", "n_quotes"))
