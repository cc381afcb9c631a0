"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes; the marks count the level.  Lines of one level, up to an empty line or
a change of level, are a passage, hashed by its words.  Unquoted passages and whole messages are hashed alike, and
quoted passages are joined to those of earlier messages of the conversation.  A message replies to the latest one
that its shallowest matched quote comes from, or else to the message before it.  Conversations are then put in reply
order, depth first, without quotes and without the lines that introduce them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.llm.shared import written

MIN_WORDS = 2

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_WORDS = re.compile(r"\w+")
_OPENS = re.compile(r"\s*(?:On|Am|Le|El)\b")
_VERB = re.compile(r"\b(?:wrote|schrieb|écrit|escribió)\b")
_NAMED = ("wrote", "schrieb", "a écrit", "escribió")


def introduces(lines: list[str]) -> int:
    """How many of the last lines introduce a quote: one, two where one is broken, or none.  Lines may be of any length."""
    last = lines[-1].strip() if lines else ""
    if not last.endswith(":") or not _VERB.search(last):
        return 0
    if _OPENS.match(last):
        return 1
    # a sentence that ends isn't the beginning of the last line's
    if len(lines) > 1 and _OPENS.match(lines[-2]) and not lines[-2].rstrip().endswith((".", "!", "?", ":", ";")):
        return 2
    said = last[:-1].rstrip()
    return int(said.endswith(_NAMED) and said not in _NAMED)


def passage_hash(text: str) -> int | None:
    """64-bit hash of the words in lower case; None for too few to tell messages apart."""
    words = _WORDS.findall(text.lower())
    if len(words) < MIN_WORDS:
        return None
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def parse(text: str) -> tuple[str, list[tuple[int, int]], list[int]]:
    """(text without quotes, (level, hash) of each quoted passage, hashes of the unquoted passages and of all of them)."""
    if ">" not in text:
        body = text.strip()
        own = [passage_hash(p) for p in re.split(r"\n[ \t]*\n", body)] if "\n" in body else []
        return body, [], list(dict.fromkeys(h for h in [*own, passage_hash(body)] if h is not None))
    passages: list[tuple[int, list[str]]] = []
    kept: list[str] = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        rest = line[m.end() :] if m else line
        if level:
            if (not passages or passages[-1][0] == 0) and kept:
                while kept and not kept[-1].strip():
                    kept.pop()
                n = introduces(kept)
                del kept[len(kept) - n :]
                for _ in range(n):
                    if passages and passages[-1][1]:
                        passages[-1][1].pop()
        else:
            kept.append(line)
        # a quoted line can be introduced too, in the level below the next
        if rest.strip() and passages and passages[-1][0] == level:
            passages[-1][1].append(rest)
        elif rest.strip():
            passages.append((level, [rest]))
        else:
            passages.append((level, []))
    quotes: list[tuple[int, int]] = []
    own: list[int | None] = []
    for i, (level, lines) in enumerate(passages):
        if level and lines and i + 1 < len(passages) and passages[i + 1][0] > level:
            lines = lines[: len(lines) - introduces(lines)]
        h = passage_hash("\n".join(lines))
        if level and h is not None:
            quotes.append((level, h))
        elif not level:
            own.append(h)
    # a level's passages together are a quote of a whole message
    for level in sorted({q for q, _ in passages if q}):
        mine = []
        for i, (q, lines) in enumerate(passages):
            if q == level:
                n = introduces(lines) if i + 1 < len(passages) and passages[i + 1][0] > level else 0
                mine += lines[: len(lines) - n]
        h = passage_hash("\n".join(mine))
        if h is not None:
            quotes.append((level, h))
    body = re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(kept)).strip()
    return body, list(dict.fromkeys(quotes)), list(dict.fromkeys(h for h in [*own, passage_hash(body)] if h is not None))


_PARSED = "conv_id long, turn long, role string, body string, quotes array<struct<level:int,hash:long>>, own array<long>"
_QUOTE = pa.struct([("level", pa.int32()), ("hash", pa.int64())])
_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("body", pa.string()), ("quotes", pa.list_(_QUOTE)), ("own", pa.list_(pa.int64()))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [parse(t or "") for t in b.column("text").to_pylist()]
        quotes = [[{"level": q, "hash": h} for q, h in d[1]] for d in done]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role").cast(pa.string()), pa.array([d[0] for d in done], pa.string()), pa.array(quotes, pa.list_(_QUOTE)), pa.array([d[2] for d in done], pa.list_(pa.int64()))], schema=_ARROW)


def reply_order(parents: list[int]) -> list[int]:
    """Positions depth first; parents[i] < i, or -1; replies to one message stay in order."""
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        children.setdefault(p, []).append(i)
    out, stack = [], children.get(-1, [])[::-1]
    while stack:
        i = stack.pop()
        out.append(i)
        stack += children.get(i, [])[::-1]
    return out


_SKELETON = "mid long, position int, depth int, reply_to long"
_OUT = pa.schema([("mid", pa.int64()), ("position", pa.int32()), ("depth", pa.int32()), ("reply_to", pa.int64())])


def _ordered(turn: np.ndarray, asked: list[int | None], mid: np.ndarray) -> pa.RecordBatch:
    """Places of the messages of a conversation, which come in order of turn; asked: the turn that each replies to, if known."""
    first = np.searchsorted(turn, turn, "left")
    at = dict(zip(turn[first].tolist(), first.tolist(), strict=True))
    parents = [at.get(a, -1) if a is not None else i - 1 for i, a in enumerate(asked)]
    depth = np.zeros(len(turn), np.int32)
    for i, p in enumerate(parents):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    order = np.array(reply_order(parents))
    above = np.array(parents)[order]
    reply_to = pa.array(turn[np.maximum(above, 0)], mask=above < 0)
    return pa.RecordBatch.from_arrays([pa.array(mid[order]), pa.array(np.arange(len(order), dtype=np.int32)), pa.array(depth[order]), reply_to], schema=_OUT)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by conversation and turn; only their numbers are held, never their texts."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        return _ordered(t.column("turn").to_numpy(), t.column("asked").to_pylist(), t.column("mid").to_numpy())

    for b in batches:
        conv = b.column("conv_id").to_numpy()
        cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(conv)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and hi > lo and held[0].column("conv_id")[0].as_py() != conv[lo]:
                yield whole()
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
    if held:
        yield whole()


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, position, depth, turn, reply_to, role, text, n_linked) of every message, in reply order by position.

    ``reply_to`` is the turn replied to, null for the first message; ``n_linked`` counts the quoted passages that
    were found in earlier messages.  Rows with a null conv_id or turn have no place and are left out.  A null or
    empty text, or one of quotes alone, gives an empty text; a null role stays null.  Repeated rows count once; of
    different messages of one turn the order is by role and by the text's hash, and a quote of either links to the
    turn.  Very long texts are parsed whole.  An empty table gives no rows.  Other columns are ignored.

    A task orders whole conversations, of whose messages it holds four numbers each.
    """
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").where("conv_id is not null and turn is not null").distinct()
    parsed = written(rows.mapInArrow(_parse, _PARSED).withColumn("mid", F.monotonically_increasing_id()), "messages")  # it is read four times
    keys = ["conv_id", "turn"]
    quoted = parsed.where(F.size("quotes") > 0).select(*keys, F.explode("quotes").alias("q")).select("conv_id", "turn", "q.hash", "q.level").distinct()
    own = parsed.select("conv_id", F.col("turn").alias("source"), F.explode("own").alias("hash")).distinct()
    # the latest earlier message with a passage, by one pass over those that have or quote it, however many they are
    events = quoted.withColumn("source", F.lit(None).cast("long")).unionByName(own.select("conv_id", F.col("source").alias("turn"), "hash", F.lit(None).cast("int").alias("level"), "source"))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    links = events.withColumn("source", F.max("source").over(before)).where("level is not null and source is not null")
    parent = links.groupBy(*keys).agg(F.max(F.struct(-F.col("level"), "source")).alias("best"), F.count_distinct("hash").cast("int").alias("n_linked"))
    parent = parent.select(*keys, F.col("best.source").alias("asked"), "n_linked")
    asked = parsed.select(*keys, "role", F.xxhash64("body").alias("h"), "mid").join(parent.select(*keys, "asked"), keys, "left")
    places = asked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h", "mid").select("conv_id", "turn", "asked", "mid").mapInArrow(_place, _SKELETON)
    whole = parsed.join(places, "mid").join(parent.select(*keys, "n_linked"), keys, "left")
    return whole.select("conv_id", "position", "depth", "turn", "reply_to", "role", F.col("body").alias("text"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def quoting(messages: DataFrame) -> DataFrame:
    """The messages as mail clients send them: each but the first of a conversation quotes one before it, and what that quotes.

    Turns count from 0.  Rows with a null conv_id, turn or text go.
    """
    known = messages.where("conv_id is not null and turn is not null and text is not null").select("conv_id", "turn", "role", "text")
    source = F.expr("(turn * 7 + conv_id) % turn")
    known = known.withColumn("source", F.when(F.col("turn") > 0, source))
    said = known.select("conv_id", F.col("turn").alias("source"), F.col("text").alias("first"), F.col("source").alias("deeper"))
    below = known.select("conv_id", F.col("turn").alias("deeper"), F.col("text").alias("second"))
    joined = known.join(said, ["conv_id", "source"], "left").join(below, ["conv_id", "deeper"], "left")

    def marked(text: Column, marks: str) -> Column:
        return F.concat(F.lit(marks), F.regexp_replace(text, "\n", "\n" + marks))

    nested = F.when(F.col("second").isNotNull(), F.concat(F.lit("> On Sunday, someone\n> <a@b.c> wrote:\n"), marked(F.col("second"), "> > "), F.lit("\n")))
    quote = F.concat(F.lit("On Monday, someone wrote:\n"), F.coalesce(nested, F.lit("")), marked(F.col("first"), "> "), F.lit("\n\n"))
    return joined.select("conv_id", "turn", "role", F.concat(F.coalesce(quote, F.lit("")), "text").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def quoting_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations of the table once their messages quote each other."""
    return conversations(quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
