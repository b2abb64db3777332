"""Conversations without quotes, in reply order, by linking quoted passages to the messages they come from.

A line that begins with quote marks has their number as its level; lines of one level that follow each other are a
passage, and the line before it that names its author goes with it. Passages, their paragraphs and their lines are
hashed in a normal form, as are the bodies of all messages, their paragraphs and lines. For each hash the earliest
message that holds it is found once, by an aggregate, so a passage that a third of all messages hold costs a row each.
A quote links to the earliest message of its own conversation that holds it, if that stands before the quoting one, or
else to the earliest message of another conversation. Messages stand in the order of conversation and turn, and a parent
stands before its reply: the parent of a message is the latest message before it that its quotes of level 1 link to;
without one it replies to the turn before it. So every message has a root, and among the messages of a root a position
with parents first. Runs of turns that reply to the turn before share the root of their first, so roots are found by
doubling over linked messages alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugework.functions.shipping import ship
from gaugework.llm.common import cut, slices, stored
from gaugework.operators.evidence import place

MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: Lines that announce a quote in mail of several languages.
ATTRIBUTION = re.compile(r"(?i)^[ \t]*(?:on|am|le|el|il)\b.{0,300}\b(?:wrote|schrieb|écrit|escribió|ha scritto)\b.{0,100}:[ \t]*$|^[ \t]*[^:\n]{1,120}\b(?:wrote|writes|schrieb|said):[ \t]*$")
#: Shorter lines and paragraphs are too common to say which other conversation they come from; they link within their own.
LEAST_CHARS = 12
#: Marks of digests of shorter units: any such unit, for its own conversation; a whole text, for other conversations.
SHORT, SHORT_WHOLE = "~", "="


def normal(text: str) -> str:
    """Case folded, white space runs one space, none at the ends."""
    return " ".join(text.casefold().split())


def digest(text: str) -> str:
    return hashlib.sha256(normal(text).encode()).hexdigest()


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages as (level, text) in order."""
    if ">" not in text:
        return text.strip(), []
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        m = MARK.match(line)
        level = m.group(1).count(">") if m else 0
        if level:
            while body and not before and not body[-1].strip():
                body.pop()
            if body and not before and ATTRIBUTION.match(body[-1]):
                body.pop()
            if level != before:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        else:
            body.append(line)
        before = level
    return re.sub(r"\n{3,}", "\n\n", "\n".join(body)).strip(), [(n, "\n".join(ls).strip()) for n, ls in passages if any(x.strip() for x in ls)]


def units(text: str) -> list[str]:
    """Digests by which a text can be found: the whole, its paragraphs, its lines; without repeats, the longest first."""
    paragraphs = re.split(r"\n\s*\n", text)
    lines = text.split("\n")
    found = [text, *(paragraphs if len(paragraphs) > 1 else []), *(lines if len(lines) > 1 else [])]
    out: list[str] = []
    for i, x in enumerate(found):
        n = len(normal(x))
        if n >= LEAST_CHARS:
            out.append(digest(x))
        elif n:
            out += [SHORT + digest(x), *([] if i else [SHORT_WHOLE + digest(x)])]
    return list(dict.fromkeys(out))


def parsed(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, body, own digests, quotes as structs of level, rank of the unit, digest) of each message."""
    quote = pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("rank", pa.int32()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            found = [parse(t or "") for t in batch.column(3).to_pylist()]
            quotes = [[{"passage": i, "level": n, "rank": k, "digest": d} for i, (n, p) in enumerate(q) for k, d in enumerate(units(p))] for _, q in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array([b for b, _ in found], type=pa.string()), pa.array([units(b) for b, _ in found], type=pa.list_(pa.string())), pa.array([len(q) for _, q in found], type=pa.int64()), pa.array([max((n for n, _ in q), default=0) for _, q in found], type=pa.int64()), pa.array(quotes, type=pa.list_(quote))],
                names=["conv", "turn", "role", "body", "units", "n_quotes", "quote_depth", "quotes"],
            )

    ship(messages.sparkSession)
    rows = messages.select(F.col(conversation).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "conv bigint, turn bigint, role string, body string, units array<string>, n_quotes bigint, quote_depth bigint, quotes array<struct<passage:int,level:int,rank:int,digest:string>>")


def threads(turns: DataFrame) -> DataFrame:
    """(vc, vt, linked, reply_conv, reply_turn, root_conv, root_turn, position) of distinct messages (conv, turn, rc, rt).

    (rc, rt) is the linked parent, which stands before its message, or null. Messages are dealt by ranges of conversation
    and turn, so a conversation that holds a third of them is spread over many tasks; what one range hands on to the next
    is a row for each range.
    """
    ranged = stored(turns.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn").withColumn("range", F.spark_partition_id()))
    here, order = F.struct("conv", "turn"), Window.partitionBy("range").orderBy("conv", "turn")
    last = ranged.groupBy("range").agg(F.max(here).alias("last"))
    last = last.select(F.col("range").alias("r"), F.lag("last").over(Window.orderBy("range")).alias("carried"))
    placed = ranged.withColumn("lagged", F.lag(here).over(order)).join(F.broadcast(last), F.col("range") == F.col("r"))
    near = F.coalesce("lagged", "carried")
    placed = placed.withColumn("previous", F.when(near["conv"] == F.col("conv"), near["turn"])).select("conv", "turn", "rc", "rt", "previous", "range")
    # A head is linked or the first of its conversation; the turns after it, up to the next head, hang on it.
    head = F.when(F.col("rt").isNotNull() | F.col("previous").isNull(), here)
    flagged = stored(placed.withColumn("head", head))
    upto = flagged.groupBy("range").agg(F.max("head").alias("last"))
    upto = upto.select(F.col("range").alias("r"), F.max("last").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    headed = flagged.withColumn("own", F.max("head").over(order)).join(F.broadcast(upto), F.col("range") == F.col("r"))
    headed = stored(headed.select("conv", "turn", "rc", "rt", "previous", F.coalesce("own", "carried").alias("head")))
    parents = headed.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("head").alias("up"))
    linked = headed.filter("rt is not null").select("conv", "turn", "rc", "rt")
    jumps = cut(linked.join(parents, (F.col("rc") == F.col("c")) & (F.col("rt") == F.col("t"))).select(F.struct("conv", "turn").alias("node"), "up"))
    while True:
        further = jumps.toDF("at", "beyond")
        stepped = cut(jumps.join(further, F.col("up") == F.col("at"), "left").select("node", F.coalesce("beyond", "up").alias("up"), F.col("beyond").isNotNull().alias("moved")))
        jumps, moving = stepped.select("node", "up"), not stepped.filter("moved").isEmpty()
        if not moving:
            break
    rooted = headed.join(jumps, F.col("head") == F.col("node"), "left").select("conv", "turn", "rc", "rt", "previous", F.coalesce("up", "head").alias("root"))
    numbered = place(rooted, ["root", "conv", "turn"])
    firsts = stored(numbered.groupBy("root").agg(F.min("place").alias("first")).withColumnRenamed("root", "of"))
    numbered = numbered.join(firsts, F.col("root") == F.col("of"))
    known = F.col("rt").isNotNull()
    return numbered.select(
        F.col("conv").alias("vc"), F.col("turn").alias("vt"), known.alias("linked"), F.when(known, F.col("rc")).when(F.col("previous").isNotNull(), F.col("conv")).alias("reply_conv"),
        F.coalesce("rt", "previous").alias("reply_turn"), F.col("root.conv").alias("root_conv"), F.col("root.turn").alias("root_turn"), (F.col("place") - F.col("first")).alias("position"),
    )


def conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: conversation, turn, role, text without quotes, n_quotes, quote_depth, n_linked, reply_conv, reply_turn, linked, root_conv, root_turn, position.

    Sorted by root and position a thread stands in reply order, parents first. ``linked`` says whether a quote, not the
    order of turns, gave the parent; n_linked counts all passages whose source is known, also where that stands later,
    in another conversation, and so can't be the parent. A null text is an empty one; a null conversation or turn has no
    parent, no root and is no one's parent; rows that repeat a conversation and turn are messages of their own with the
    same links and position; an empty table gives no rows. Further columns are left out before anything is added.
    """
    rows = stored(parsed(messages, conversation, turn, role, text))
    quoting = rows.filter("n_quotes > 0 and conv is not null and turn is not null")
    quotes = quoting.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.*").distinct()
    wanted = quotes.select("digest").distinct()
    held = rows.filter("conv is not null and turn is not null").select("conv", "turn", F.explode("units").alias("unit"))
    held = held.join(wanted.withColumnRenamed("digest", "wanted"), F.col("unit") == F.col("wanted"), "left_semi")
    own = held.groupBy("conv", "unit").agg(F.min("turn").alias("first_turn")).select(F.col("conv").alias("own_conv"), F.col("unit").alias("own_unit"), "first_turn")
    # Of any unit the two earliest conversations, as the first may be the quoting one itself.
    others = own.filter(~F.col("own_unit").startswith(SHORT))
    anywhere = others.groupBy("own_unit").agg(F.min(F.struct("own_conv", "first_turn")).alias("least"))
    second = others.join(anywhere.select(F.col("own_unit").alias("u"), F.col("least.own_conv").alias("c")), (F.col("own_unit") == F.col("u")) & (F.col("own_conv") != F.col("c")))
    second = second.groupBy("own_unit").agg(F.min(F.struct("own_conv", "first_turn")).alias("next")).withColumnRenamed("own_unit", "next_unit")
    anywhere = anywhere.join(second, F.col("own_unit") == F.col("next_unit"), "left").select(F.col("own_unit").alias("any_unit"), "least", "next")
    found = quotes.join(own, (F.col("conv") == F.col("own_conv")) & (F.col("digest") == F.col("own_unit")) & (F.col("first_turn") < F.col("turn")) & ~F.col("digest").startswith(SHORT_WHOLE), "left").join(anywhere, F.col("digest") == F.col("any_unit"), "left")
    other = F.when(F.col("least.own_conv") != F.col("conv"), F.col("least")).otherwise(F.col("next"))
    short = F.col("digest").startswith(SHORT) | F.col("digest").startswith(SHORT_WHOLE)
    found = found.select("conv", "turn", "passage", "level", "rank", short.alias("short"), F.when(F.col("first_turn").isNotNull(), F.struct(F.lit(1).alias("same"), F.col("conv").alias("c"), F.col("first_turn").alias("t"))).when(other.isNotNull(), F.struct(F.lit(0).alias("same"), other["own_conv"].alias("c"), other["first_turn"].alias("t"))).alias("source"))
    # The longest unit of a passage that is found anywhere says where the passage comes from; short units speak last.
    passages = found.filter("source is not null").groupBy("conv", "turn", "passage", "level").agg(F.max_by("source", F.struct(~F.col("short"), F.col("source.same"), -F.col("rank"))).alias("source"))
    earlier = F.when((F.col("source.c") < F.col("conv")) | ((F.col("source.c") == F.col("conv")) & (F.col("source.t") < F.col("turn"))), F.struct((-F.col("level")).alias("level"), F.col("source")))
    per = passages.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"), F.max(earlier).alias("nearest"))
    per = per.select(F.col("conv").alias("pc"), F.col("turn").alias("pt"), "n_linked", F.col("nearest.source.c").alias("rc"), F.col("nearest.source.t").alias("rt"))
    turns = rows.filter("conv is not null and turn is not null").select("conv", "turn").distinct().join(per, (F.col("conv") == F.col("pc")) & (F.col("turn") == F.col("pt")), "left")
    turns = stored(turns.select("conv", "turn", "rc", "rt", "n_linked"))
    found = threads(turns.select("conv", "turn", "rc", "rt"))
    counts = turns.filter("n_linked is not null").select(F.col("conv").alias("pc"), F.col("turn").alias("pt"), "n_linked")
    out = rows.join(found, (F.col("conv") == F.col("vc")) & (F.col("turn") == F.col("vt")), "left").join(counts, (F.col("conv") == F.col("pc")) & (F.col("turn") == F.col("pt")), "left")
    return out.select(
        F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), F.col("body").alias(text), "n_quotes", "quote_depth", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        "reply_conv", "reply_turn", F.coalesce("linked", F.lit(False)).alias("linked"), "root_conv", "root_turn", "position",
    )
