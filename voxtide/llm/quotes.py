"""Quotation linking: conversations in reply order, without the quotes.

A line's level is the number of `>` it begins with; a passage is a run of lines of one level. The
normalised text of each quoted passage, of its paragraphs and of its lines is hashed and joined to
the same units of what messages say themselves. A message replies to the message of its own
conversation that its outermost linked quote comes from. Everything runs on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.session import materialize

LINE_END = r"\r\n|\n|\r"
MARKS = r"^((?:[ \t]*>)+)"
ATTRIBUTION = r"(?i)\bwrote:[ \t]*$"  # the line that introduces a quote


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def leveled_lines(text: Column) -> Column:
    """The lines as an array of (level, body), in order."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.transform(lines, lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(line, MARKS + "[ \t]?", "").alias("body"),
    ))


def _runs(df: DataFrame) -> DataFrame:
    """Column `lines` turned into `runs`: (level, body) with the bodies of a run joined by line ends."""
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    level = lambda i: F.get(F.col("lines"), i)["level"]
    begin = F.filter(places, lambda i: (i == 0) | (level(i) != level(i - 1)))
    df = df.withColumn("begin", begin)
    end = F.concat(F.slice("begin", 2, F.size("begin")), F.array(F.size("lines")))
    run = lambda s: F.slice("lines", s["begin"] + 1, s["b"] - s["begin"])
    introduced = lambda s, own: (
        (s["b"] < F.size("lines")) & (level(s["b"]) > level(s["begin"])) & F.element_at(own, -1).rlike(ATTRIBUTION)
    )

    def body(s: Column) -> Column:
        own = F.transform(run(s), lambda x: x["body"])
        return F.array_join(F.when(introduced(s, own), F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own), "\n")

    df = df.withColumn("spans", F.arrays_zip("begin", end.alias("b")))
    return df.withColumn("runs", F.transform("spans", lambda s: F.struct(level(s["begin"]).alias("level"), body(s).alias("body")))).drop("begin", "spans")


def _units(text: Column) -> Column:
    """The text, its paragraphs and its lines: distinct (size, hash) of those that hold a letter or digit."""
    whole = F.array(text)
    paragraphs, lines = F.split(text, r"\n[ \t]*\n", -1), F.split(text, r"\n", -1)
    units = F.transform(F.concat(whole, paragraphs, lines), normalised)
    units = F.array_distinct(F.filter(units, lambda u: u.rlike(r"[\p{L}\p{N}]")))
    return F.transform(units, lambda u: F.struct(F.length(u).alias("size"), F.md5(u).alias("hash")))


def _placed_units(text: Column) -> Column:
    """The same units, each with its rank (0 the text, 1 a paragraph, 2 a line) and its paragraph's place."""
    paragraphs = F.split(text, r"\n[ \t]*\n", -1)
    placed = lambda body, rank, at: F.struct(normalised(body).alias("body"), F.lit(rank).alias("rank"), at.alias("paragraph"))
    units = F.concat(
        F.array(placed(text, 0, F.lit(-1))), F.transform(paragraphs, lambda p, i: placed(p, 1, i)),
        F.flatten(F.transform(paragraphs, lambda p, i: F.transform(F.split(p, r"\n", -1), lambda line: placed(line, 2, i)))),
    )
    units = F.array_distinct(F.filter(units, lambda u: u["body"].rlike(r"[\p{L}\p{N}]")))
    return F.transform(units, lambda u: F.struct(F.length(u["body"]).alias("size"), F.md5(u["body"]).alias("hash"), u["rank"].alias("rank"), u["paragraph"].alias("paragraph")))


def _outermost(hit: DataFrame) -> DataFrame:
    """The linked units that lie in no longer linked unit of their passage.

    A unit said in this conversation gives way to one said in this conversation only.
    """
    passage = ["conv", "turn", "place", "passage"]
    hit = hit.distinct()  # rows that repeat a message
    best = lambda rank, by: F.max(F.when(F.col("rank") == rank, F.col("same").cast("int"))).over(W.partitionBy(*by))
    hit = hit.withColumn("_text", best(0, passage)).withColumn("_paragraph", best(1, [*passage, "paragraph"]))
    around = F.greatest(F.when(F.col("rank") > 0, F.col("_text")), F.when(F.col("rank") > 1, F.col("_paragraph")))
    return hit.where(around.isNull() | (F.col("same").cast("int") > around)).drop("_text", "_paragraph")


def _depths(links: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) for messages with a parent, by doubling the reach of their pointers."""
    state = materialize(links.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).alias("depth")), "reach")
    while True:
        above = state.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        state = state.join(above, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("t")), "left").select(
            "conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            F.col("up2").isNotNull().alias("moved"),
        )
        state = materialize(state, "reach")
        if not state.where("moved").limit(1).count():
            return state.select("conv", "turn", F.col("up").alias("thread"), "depth")


def link_quotations(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", keep: tuple[str, ...] = ("role",),
    every_part: bool = False,
) -> DataFrame:
    """(conv, turn, *keep, text, n_quotes, n_linked, sources, parent, thread, depth) for every message.

    text is what the message says itself: lines of level 0, without a line ending in `wrote:` before
    a quote, trimmed. n_quotes counts its quoted passages, n_linked those whose source is known;
    sources lists them as sorted, distinct `conv:turn`. A passage's source is the first message of
    the same conversation, before this one, that says the passage, else the longest part of it; if
    there is none, the first message of any other conversation that does. With every_part, a passage
    has the sources of all its parts (the passage, paragraphs, lines) that lie in no longer linked
    part; a part said in this conversation gives way only to a longer one said there, too. parent is
    the turn replied to: the source, in this conversation, of the quote of lowest level (the later
    one if there are several). thread and depth lead to the first message of the chain. In reply order a conversation
    is sorted by (thread, depth, turn).

    Null and empty texts say and quote nothing. Messages whose conversation or turn is null are
    returned with thread = turn and depth 0, and are no sources. Rows that repeat a conversation and
    turn are one message with several texts: each row is returned, with the links of all. An empty
    table gives an empty result. No conversation is gathered anywhere: joins are on hashes or on
    (conversation, turn), and each hash keeps its first message only.
    """
    base = messages.select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.struct(*[F.col(k) for k in keep]).alias("kept") if keep else F.lit(0).alias("kept"),
        leveled_lines(F.col(text)).alias("lines"),
    )
    parsed = _runs(base)
    said = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"])
    parsed = parsed.select(
        "conv", "turn", "kept", F.regexp_replace(F.array_join(said, "\n"), r"^\s+|\s+$", "").alias("said"),
        F.filter("runs", lambda r: (r["level"] > 0) & r["body"].rlike(r"[\p{L}\p{N}]")).alias("quotes"),
    )
    parsed = materialize(parsed, "messages")
    known = parsed.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())

    asked = known.where(F.size("quotes") > 0).select("conv", "turn", F.posexplode("quotes").alias("place", "quote"))
    asked = asked.select("conv", "turn", "place", F.col("quote.level").alias("level"), F.md5("quote.body").alias("passage"), F.explode(_placed_units(F.col("quote.body"))).alias("unit"))
    asked = materialize(asked.select("conv", "turn", "place", "level", "passage", "unit.*"), "quotes")
    # hashes nobody quotes need no first message
    quoted = asked.select("hash").distinct()
    says = known.select("conv", "turn", F.explode(_units(F.col("said"))).alias("unit")).select("conv", "turn", "unit.hash")
    says = says.join(materialize(quoted, "hashes"), "hash")
    here = materialize(says.groupBy("hash", F.col("conv").alias("own")).agg(F.min("turn").alias("first")), "firsts")
    two = here.groupBy("hash").agg(F.min(F.struct("own", "first")).alias("one"))
    # a conversation is no source of its own quote here, so the second conversation is kept as well
    other = here.join(two, "hash").where(F.col("own") != F.col("one.own")).groupBy("hash").agg(F.min(F.struct("own", "first")).alias("two"))
    anywhere = materialize(two.join(other, "hash", "left"), "anywhere")

    found = asked.join(here, (asked["hash"] == here["hash"]) & (asked["conv"] == here["own"]) & (here["first"] < asked["turn"]), "left")
    found = found.select(asked["*"], F.col("first"))
    found = found.join(anywhere, "hash", "left")
    away = F.when(F.col("one.own") != F.col("conv"), F.col("one")).otherwise(F.col("two"))
    found = found.withColumn("away", F.when(F.col("first").isNull(), away))
    hit = found.where(F.col("first").isNotNull() | F.col("away").isNotNull())
    hit = hit.select(
        "conv", "turn", "place", "passage", "rank", "paragraph", F.col("first").isNotNull().alias("same"), "size", "hash",
        F.coalesce("first", F.col("away.first")).alias("source"), F.coalesce(F.when(F.col("first").isNotNull(), F.col("conv")), F.col("away.own")).alias("from"), "level",
    )
    if every_part:
        best = _outermost(hit)
    else:  # in the same conversation first, then the longest part
        best = hit.groupBy("conv", "turn", "place").agg(F.max(F.struct("same", "size", "hash", "source", "from", "level")).alias("b")).select("conv", "turn", "place", "b.*")
    links = best.groupBy("conv", "turn").agg(
        F.size(F.collect_set("place")).alias("n_linked"),
        F.array_sort(F.collect_set(F.concat_ws(":", "from", "source"))).alias("sources"),
        F.min(F.when(F.col("same"), F.struct(F.col("level"), (-F.col("source")).alias("back")))).alias("p"),
    ).select("conv", "turn", "n_linked", "sources", (-F.col("p.back")).alias("parent"))
    links = materialize(links, "links")
    depths = _depths(links.where(F.col("parent").isNotNull()))
    out = parsed.join(links, ["conv", "turn"], "left").join(depths, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), *[F.col(f"kept.{k}").alias(k) for k in keep], F.col("said").alias(text),
        F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "parent",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
