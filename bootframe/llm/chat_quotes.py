"""Chat formatting by quotation linking (DataFrame functions only).

Lines that start with ``>`` are quotes, as many levels deep as they have such marks. Runs of
lines of one level are passages. A passage, and each of its lines and sentences, is normalised and
hashed and joined with the first message of the conversation that says it in its own words (the
nearest earlier one for short words, which many messages say); the message
whose words are quoted most, at the outermost level that is found, is the one replied to.
Conversations come out in reply order and without quotes.

Scale: joins are on (conversation, hash), with one original a hash, so a line that many
messages quote costs a row each. Only messages with quotes are taken apart by window, each
message on its own. Reply paths grow by pointer jumping. Nothing is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, stored

_QUOTE = r"^[ \t]?((?:>[ \t]?)+)"
_WROTE = r"(?i)^\s*(on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb\b.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)\s*:\s*$"


def quote_level(line: Column) -> Column:
    """Number of quote marks in front of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 1), "[^>]", ""))


def normal(line: Column) -> Column:
    """Lower case, runs of anything but letters and digits to one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    """The text cut after marks that end a sentence."""
    return F.split(text, r"(?<=[.!?…])\s+|(?<=[。！？])\s*")


def own_text(text: Column) -> Column:
    """The text without quoted lines, lines that announce a quote, and blank ends."""
    lines = F.split(text, "\r?\n", -1)
    mine = F.filter(lines, lambda x: (quote_level(x) == 0) & ~x.rlike(_WROTE))
    return F.regexp_replace(F.array_join(mine, "\n"), r"^\s+|\s+$", "")


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", min_chars: int = 1, short_chars: int = 12) -> DataFrame:
    """``messages`` with what they reply to.

    New columns: reply_to (turn of the message whose words it quotes, null if it quotes none
    that came before), quote_levels (deepest level), quoted_lines, matched_lines (of them,
    lines, sentences or passages found in an earlier message), thread (turn at the start of its chain of replies), path
    (turns from there to itself: rows ordered by conversation and path are in reply
    order), own (text without quotes). Matches shorter than ``min_chars`` normalised characters
    don't count; those shorter than ``short_chars`` are taken from the nearest earlier message
    that says them, others from the first. Input columns pass through; those named like a new one are replaced.

    Null texts have a null own text and quote nothing. Rows with a null conversation or turn are
    answered with null reply_to and a path of their turn alone. Rows that repeat a turn are
    one message said twice: each keeps its own text, and they share thread and path, by the latest
    turn that any of them replies to.
    """
    work = Workspace(messages.sparkSession, "quotes")
    new = {"reply_to", "quote_levels", "quoted_lines", "matched_lines", "thread", "path", "own"}
    kept = [c for c in messages.columns if c.lower() not in new]
    conv, turn, text = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    said = messages.select(conv.cast("string").alias("c"), turn.alias("t"), text.alias("x")).where("c is not null and t is not null and x is not null")
    quoting = said.where(F.col("x").rlike(r"(?m)^[ \t]?>")).withColumn("m", F.xxhash64("x")).distinct()
    lines = quoting.select("c", "t", "m", F.posexplode(F.split("x", "\r?\n", -1)).alias("n", "line")).withColumn("level", quote_level(F.col("line")))
    inside = Window.partitionBy("c", "t", "m").orderBy("n")
    changes = (F.col("level") != F.lag("level", 1, -1).over(inside)).cast("int")
    runs = lines.withColumn("change", changes).withColumn("run", F.sum("change").over(inside)).where("level > 0")
    runs = runs.withColumn("words", normal(F.regexp_replace("line", _QUOTE, "")))
    passages = runs.groupBy("c", "t", "m", "run", "level").agg(F.sort_array(F.collect_list(F.struct("n", "words", F.regexp_replace("line", _QUOTE, "").alias("raw")))).alias("ls"))
    whole = F.trim(F.array_join(F.filter(F.transform("ls", lambda x: x["words"]), lambda w: w != ""), " "))
    keys = passages.select("c", "t", "m", "level", F.explode(F.array_distinct(F.concat(F.array(whole), F.transform("ls", lambda x: x["words"]), F.transform(sentences(F.array_join(F.transform("ls", lambda x: x["raw"]), "\n")), normal)))).alias("words"))
    keys = work.stored(keys.where(F.length("words") >= min_chars).select("c", "t", "m", "level", F.sha2("words", 256).alias("key"), F.length("words").alias("chars")), "quoted")
    # what is said in own words in conversations that hold quotes: the whole, its paragraphs, lines and sentences
    own = said.join(quoting.select("c").distinct(), "c", "left_semi").select("c", "t", own_text(F.col("x")).alias("o"))
    units = F.concat(F.array(F.col("o")), F.split("o", r"\n[ \t]*\n"), F.split("o", "\n"), sentences(F.col("o")), F.flatten(F.transform(F.split("o", "\n"), sentences)))
    spoken = own.select("c", "t", F.explode(F.array_distinct(F.transform(units, normal))).alias("words")).where(F.length("words") >= min_chars)
    long = F.length("words") >= short_chars
    first = spoken.where(long).groupBy("c", F.sha2("words", 256).alias("key")).agg(F.min("t").alias("of"))
    met = keys.where(F.col("chars") >= short_chars).join(first, ["c", "key"]).where("of < t").select("c", "t", "m", "level", "chars", "of")
    # short words: of those who said them before the quoting message, the nearest
    brief = keys.where(F.col("chars") < short_chars)
    sayers = spoken.where(~long).select("c", "t", F.sha2("words", 256).alias("key")).distinct().join(brief.select("c", "key").distinct(), ["c", "key"], "left_semi")
    both = brief.withColumn("said", F.lit(None).cast("long")).unionByName(sayers.withColumn("said", F.col("t")), allowMissingColumns=True)
    before = Window.partitionBy("c", "key").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("of", F.max("said").over(before)).where("level is not null and of is not null")
    hits = work.stored(met.unionAll(near.select("c", "t", "m", "level", "chars", "of")), "hits")
    score = hits.groupBy("c", "t", "m", "level", "of").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    best = score.groupBy("c", "t", "m").agg(F.max_by("of", F.struct(-F.col("level"), "chars", "of")).alias("reply_to"), F.sum("n").alias("matched"))
    counts = runs.where("words <> ''").groupBy("c", "t", "m").agg(F.max("level").alias("levels"), F.count("*").alias("quoted"))
    per = work.stored(counts.join(best, ["c", "t", "m"], "left"), "replies")
    # paths from the start of each chain: every step joins a path with the path of the message it starts from
    paths = work.stored(per.where("reply_to is not null").groupBy("c", "t").agg(F.max("reply_to").alias("up")).withColumn("path", F.array("t")), "paths")
    while paths.where("up is not null").take(1):
        above = paths.select(F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        met = paths.join(above, (F.col("c") == F.col("c2")) & (F.col("up") == F.col("t2")), "left")
        # a message that quotes none starts the chain
        whole_path = F.when(F.col("up").isNull(), F.col("path")).when(F.col("t2").isNull(), F.concat(F.array("up"), "path")).otherwise(F.concat("path2", "path"))
        paths = work.stored(met.select("c", "t", F.when(F.col("t2").isNotNull(), F.col("up2")).alias("up"), whole_path.alias("path")), "paths")
    linked = stored(per.join(paths.select("c", "t", "path"), ["c", "t"], "left").select(F.col("c").alias("__c"), F.col("t").alias("__t"), F.col("m").alias("__m"), F.col("levels").alias("__levels"), F.col("quoted").alias("__quoted"), F.col("reply_to").alias("__reply_to"), F.col("matched").alias("__matched"), F.col("path").alias("__of")), "reply-links")
    work.close()
    rows = messages.select(*[F.col(f"`{c}`") for c in kept]).withColumn("__own", own_text(text)).withColumn("__mm", F.xxhash64(text))
    by_turn = linked.where("__of is not null").select(F.col("__c").alias("__c3"), F.col("__t").alias("__t3"), F.col("__of").alias("__path")).distinct()
    rows = rows.join(linked.drop("__of"), (conv.cast("string") == F.col("__c")) & (turn == F.col("__t")) & (F.col("__mm") == F.col("__m")), "left")
    rows = rows.join(by_turn, (conv.cast("string") == F.col("__c3")) & (turn == F.col("__t3")), "left")
    path = F.coalesce("__path", F.array(turn))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept], F.col("__reply_to").alias("reply_to"), F.coalesce("__levels", F.lit(0)).cast("int").alias("quote_levels"), F.coalesce("__quoted", F.lit(0)).cast("long").alias("quoted_lines"),
        F.coalesce("__matched", F.lit(0)).cast("long").alias("matched_lines"), path[0].alias("thread"), path.alias("path"), F.col("__own").alias("own"),
    )


def chats(ordered: DataFrame, conv_col: str = "conv_id", role_col: str = "role") -> DataFrame:
    """One row a thread of :func:`reply_order`: conversation, thread, messages (array of role
    and content in reply order; messages that only quote are left out). A thread's messages
    meet in one row, so it suits threads that a reader could follow."""
    spoken = ordered.where("own <> ''")
    return spoken.groupBy(conv_col, "thread").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("path"), F.col(role_col).alias("role"), F.col("own").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
