"""Quotation linking in conversations (DataFrame functions only).

A line's quote level is the number of ``>`` before its text, blanks between them
ignored. Consecutive lines of one level form a passage, those of level 0 a block
that ends at a blank line. A passage is normalised as a whole (words joined by one
blank, A-Z lower-cased), so that wrapping does not matter, and hashed to 128 bits.

A passage's origin is the first message of the conversation with a block of the same
hash. A passage that is no whole block is looked for by its windows of ``WINDOW``
words (all its words, if fewer): each meets the first message that has it unquoted,
the message that most windows name (ties: the later one) is the origin if its
unquoted words hold the whole passage. Firsts are aggregated with map-side minima, so
a window that everybody quotes meets one row and no pairs are formed; hot keys are
skewed joins, which AQE splits.

Nested levels are followed: a passage of level n > 1 came through the first message
that quotes it at level n - 1, or else from its origin. A message replies to the
message that most quoted words of its lowest linked level came from (ties: the later
one). Replies form trees; their reading order, a reply after what it quotes
and before the next reply to the same message, is the order of an Euler tour, which
list ranking by pointer jumping numbers in rounds of the size's logarithm.

Defined cases: null text has no lines; passages without words are not counted; a
quote of a later or the same turn links nothing; messages with a null conversation or
turn link nothing; repeated rows of one conversation and turn share their place in
the thread, and their links if their texts are equal; a message in no thread is its
own root at depth and position 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import WORD, ascii_lower, release, text_key, written

QUOTE = r"^([\x20\t]*>)+"
WINDOW = 5


def quote_level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, QUOTE, 0), " \t", ""))


def normalised(line: Column) -> Column:
    return ascii_lower(F.array_join(F.regexp_extract_all(F.regexp_replace(line, QUOTE, ""), F.lit(WORD), F.lit(0)), " "))


_MESSAGE = ["conv", "turn", "k"]
_PASSAGE = [*_MESSAGE, "run"]
_HASH = ["h1", "h2"]


def _joined(parts: str) -> Column:
    """Texts of an array of (place, norm), in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["norm"]), " ")


def _runs(messages: DataFrame) -> DataFrame:
    """(conv, turn, k, run, level, norm): blocks (level 0) and passages of distinct messages."""
    lines = messages.select(*_MESSAGE, F.posexplode(F.split("text", "\r?\n", -1)).alias("at", "line"))
    lines = lines.select(*_MESSAGE, "at", quote_level(F.col("line")).alias("level"), normalised(F.col("line")).alias("norm"))
    lines = lines.withColumn("level", F.when((F.col("level") == 0) & (F.col("norm") == ""), -1).otherwise(F.col("level")))
    order = Window.partitionBy(*_MESSAGE).orderBy("at")
    lines = lines.withColumn("new", F.coalesce(F.lag("level").over(order) != F.col("level"), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    runs = lines.filter("level >= 0 and norm != ''").groupBy(*_PASSAGE, "level").agg(F.collect_list(F.struct("at", "norm")).alias("l"))
    return runs.select(*_PASSAGE, "level", _joined("l").alias("norm")).withColumns({h: F.xxhash64(F.lit(i), "norm") for i, h in enumerate(_HASH)})


def _windows(norm: Column, size: Column) -> Column:
    """Hashes of the distinct windows of so many words."""
    # The words are bound by a lambda, so that they are split once.
    of = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(size, F.array_join(F.slice(w, i + 1, size), " ")))
    cut = F.flatten(F.transform(F.array(F.split(norm, " ")), lambda w: F.when(F.size(w) >= size, of(w)).otherwise(F.array().cast("array<long>"))))
    return F.array_distinct(cut)


def _origins(passages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Passages with origin, the turn that they come from, or null."""
    first = blocks.groupBy("conv", *_HASH).agg(F.min("turn").alias("origin"))
    whole = passages.join(first, ["conv", *_HASH], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    whole = written(whole, "passages")
    open_ = whole.filter("origin is null").withColumn("size", F.least(F.size(F.split("norm", " ")), F.lit(WINDOW)))
    asked = open_.select(*_PASSAGE, "size", F.explode(_windows(F.col("norm"), F.col("size"))).alias("g"))
    wanted = asked.select("conv", "size", "g").distinct()
    bodies = blocks.join(open_.select("conv").distinct(), "conv", "left_semi").groupBy(*_MESSAGE).agg(F.collect_list(F.struct("run", "norm")).alias("l"))
    bodies = bodies.select(*_MESSAGE, _joined("l").alias("body"))
    sizes = [bodies.select("conv", "turn", F.lit(n).alias("size"), F.explode(_windows(F.col("body"), F.lit(n))).alias("g")) for n in range(1, WINDOW + 1)]
    held = reduce(DataFrame.union, sizes).join(wanted, ["conv", "size", "g"], "left_semi").groupBy("conv", "size", "g").agg(F.min("turn").alias("origin"))
    votes = asked.join(held, ["conv", "size", "g"]).filter("origin < turn").groupBy(*_PASSAGE, "origin").agg(F.count("*").alias("n"))
    best = votes.groupBy(*_PASSAGE).agg(F.max(F.struct("n", "origin")).alias("b")).select(*_PASSAGE, F.col("b.origin").alias("named"))
    texts = bodies.select(F.col("conv").alias("bc"), F.col("turn").alias("bt"), "body")
    pair = open_.select(*_PASSAGE, "norm").join(best, _PASSAGE)
    pair = pair.join(texts, (F.col("conv") == F.col("bc")) & (F.col("named") == F.col("bt"))).filter(F.concat(F.lit(" "), "body", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("norm"), F.lit(" "))))
    inside = pair.select(*_PASSAGE, "named").distinct()
    return whole.join(inside, _PASSAGE, "left").withColumn("origin", F.coalesce("origin", "named")).drop("named")


def without_quotes(text: Column) -> Column:
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), lambda x: quote_level(x) == 0), "\n")


def link_quotes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """All columns, with quotes gone from the text, plus n_quoted (passages),
    n_linked, max_level, reply_to (turn or null), root (first turn of the thread),
    depth and position (place in the thread's reading order)."""
    ident = conversations.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
    quoting = ident.filter(F.col("text").rlike(r"(?m)^[\x20\t]*>")).select("conv").distinct()
    messages = ident.filter("conv is not null and turn is not null").join(quoting, "conv", "left_semi").dropDuplicates(_MESSAGE)
    runs = written(_runs(messages), "runs")
    linked = _origins(runs.filter("level > 0"), runs.filter("level = 0"))
    through = runs.filter("level > 0").groupBy("conv", *_HASH, (F.col("level") + 1).alias("level")).agg(F.min("turn").alias("via"))
    linked = linked.join(through, ["conv", *_HASH, "level"], "left")
    via = F.when(F.col("via") < F.col("turn"), F.col("via"))
    linked = linked.withColumn("from", F.when(F.col("origin").isNotNull(), F.coalesce(via, "origin"))).withColumn("words", F.size(F.split("norm", " ")))
    by = linked.groupBy(*_MESSAGE, "from").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.max("level").alias("high"), F.min("level").alias("low"))
    some = F.col("from").isNotNull()
    best = F.max(F.when(some, F.struct((-F.col("low")).alias("near"), "words", "from")))
    per = by.groupBy(*_MESSAGE).agg(F.sum("n").alias("n_quoted"), F.sum(F.when(some, F.col("n"))).alias("n_linked"), F.max("high").alias("max_level"), best.alias("best"))
    per = written(per.select(*_MESSAGE, "n_quoted", "n_linked", "max_level", F.col("best.from").alias("reply_to")), "quotes")
    places = threads(per.filter("reply_to is not null").groupBy("conv", "turn").agg(F.min("reply_to").alias("up")))
    full = conversations.withColumns({"__c": F.col(conv_col).cast("string"), "__t": F.col(turn_col).cast("long"), "__k": text_key(F.col(text_col))})
    per = per.select(*[F.col(x).alias(f"__p_{x}") for x in per.columns])
    places = places.select(*[F.col(x).alias(f"__r_{x}") for x in places.columns])
    out = full.join(per, (F.col("__c") == F.col("__p_conv")) & (F.col("__t") == F.col("__p_turn")) & (F.col("__k") == F.col("__p_k")), "left")
    out = out.join(places, (F.col("__c") == F.col("__r_conv")) & (F.col("__t") == F.col("__r_turn")), "left")
    new = {
        text_col: without_quotes(F.col(text_col)),
        "n_quoted": F.coalesce("__p_n_quoted", F.lit(0)).cast("long"),
        "n_linked": F.coalesce("__p_n_linked", F.lit(0)).cast("long"),
        "max_level": F.coalesce("__p_max_level", F.lit(0)).cast("int"),
        "reply_to": F.col("__p_reply_to").cast("long"),
        "root": F.coalesce("__r_root", "__t").cast("long"),
        "depth": F.coalesce("__r_depth", F.lit(0)).cast("int"),
        "position": F.coalesce("__r_position", F.lit(0)).cast("long"),
    }
    return out.withColumns(new).select(*dict.fromkeys([*conversations.columns, *list(new)[1:]]))


def threads(up: DataFrame) -> DataFrame:
    """(conv, turn, root, depth, position) of all messages in trees of replies, from
    (conv, turn, up) with up < turn. Every message is an event where the tour enters it and
    one where it leaves it; pointers to later events double their reach in each round."""
    up = written(up, "replies")
    nodes = up.select("conv", "turn").union(up.select("conv", "up")).distinct()
    child = up.groupBy("conv", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    sibling = up.withColumn("sibling", F.lead("turn").over(Window.partitionBy("conv", "up").orderBy("turn")))
    enter = nodes.join(child, ["conv", "turn"], "left").select("conv", (2 * F.col("turn")).alias("e"), F.coalesce(2 * F.col("child"), 2 * F.col("turn") + 1).alias("next"), F.lit(1).cast("long").alias("pos"), F.lit(1).cast("long").alias("deep"))
    leave = nodes.join(sibling, ["conv", "turn"], "left").select("conv", (2 * F.col("turn") + 1).alias("e"), F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1).alias("next"), F.lit(0).cast("long").alias("pos"), F.lit(-1).cast("long").alias("deep"))
    at = written(enter.union(leave).withColumn("last", F.col("e")), "tour")
    while not at.filter("next is not null").isEmpty():
        on = at.select("conv", F.col("e").alias("next"), F.col("next").alias("next2"), F.col("pos").alias("pos2"), F.col("deep").alias("deep2"), F.col("last").alias("last2"))
        zero = F.lit(0)
        step = at.join(on, ["conv", "next"], "left").select("conv", "e", F.col("next2").alias("next"), (F.col("pos") + F.coalesce("pos2", zero)).alias("pos"), (F.col("deep") + F.coalesce("deep2", zero)).alias("deep"), F.coalesce("last2", "last").alias("last"))
        after = written(step, "tour")
        release(at)
        at = after
    # Sums run to the end of the tour: entered messages from here on, and minus the depth.
    entered = at.filter("e % 2 = 0").select("conv", F.shiftright("e", 1).alias("turn"), F.shiftright("last", 1).alias("root"), (-F.col("deep")).alias("depth"), "pos")
    whole = entered.filter("turn = root").select("conv", "root", F.col("pos").alias("whole"))
    return entered.join(whole, ["conv", "root"]).select("conv", "turn", "root", "depth", (F.col("whole") - F.col("pos")).alias("position"))


def transcripts(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = 64) -> DataFrame:
    """(conv, root, part, messages): threads in reading order, cut every ``part``
    messages so that no row grows with a conversation."""
    cut = F.floor(F.col("position") / part).cast("long")
    rows = linked.select(F.col(conv_col).alias("conv"), "root", cut.alias("part"), F.struct("position", F.col(turn_col).alias("turn"), F.col("reply_to").alias("reply_to"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("m"))
    return rows.groupBy("conv", "root", "part").agg(F.array_sort(F.collect_list("m")).alias("messages"))
