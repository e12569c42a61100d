"""Quotation linking: quoted passages lead back to the messages that they come from.

A message is parsed line by line: the marks in front of a line give its quote level, neighbouring lines
of one level are a passage, lines that announce a quotation ("... wrote:") belong to none. Passages are normalised to
their lower-cased words and hashed whole, by paragraphs, by lines, and by every window of WINDOW words: a quotation that
was wrapped anew, cut or joined still has the paragraphs or the windows of what it quotes. Fewer words than a
window have to be a whole line, paragraph or message. A quoted unit is joined to the first message of its conversation
that has it among the units of its own text; a passage belongs to the earlier message that most of its words come from, the later one in a tie, and a message
answers the one that its shallowest linked passage belongs to, the last such passage in a tie.

Answers make trees: a thread is named by the turn at its root, and depth is the number of answers down from there, both
by doubling pointers. A reply-ordered conversation has its threads one behind the other, in each of them the messages
without quotations by turn, so that an answer always stands behind what it answers.

Own units that a bitmap of the quoted ones lacks are not shuffled. The others are summed up to one row for each conversation
and hash before the join, so a frequent line is one row on one side and adaptive execution can split the other. Nothing gathers a conversation in one task.

Null and empty texts have no passages. Messages without quotations keep their text as it is. Rows of
one conversation and turn are parts of one message where links are concerned, and stay separate rows. Messages without
a conv_id or without a turn are linked to nothing: they are threads of their own. Originals in other conversations are not
looked for.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, freed, marked, materialise, scratch, slot_of, smaller_batches, table, text_chunks
from .ngram_join import MIX, mixed

MARKS = re.compile(r"^(?:[ \t]*[>|])+[ \t]?")
INTRO = re.compile(r"^.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)
WORDS = re.compile(r"\w+").findall
WINDOW = 8
#: Characters whose units are held at once: every word begins a window.
CHUNK = 500_000
UNITS = "array<struct<h:bigint,words:int>>"
PARSED = f"id bigint, conv_id {{conv}}, turn {{turn}}, role {{role}}, own {UNITS}, quotes array<struct<level:int,units:{UNITS}>>, clean string"


@lru_cache(maxsize=200_000)
def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def words_hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def window_hashes(words: list[str]) -> list[int]:
    """Hashes of all windows of WINDOW words."""
    if len(words) < WINDOW:
        return []
    h = np.fromiter(map(word_hash, words), np.uint64, len(words))
    n = len(h) - WINDOW + 1
    out = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        out = mixed(out * MIX + h[k : k + n])
    return out.view(np.int64).tolist()


def units_of(lines: list[str]) -> list[dict]:
    """The hashed units of these lines and their words: all of them, paragraphs, lines and windows, which add one word each."""
    cut = [WORDS(line.lower()) for line in lines]
    every = [w for own in cut for w in own]
    if not every:
        return []
    found = dict.fromkeys(window_hashes(every), 1)
    paragraph: list[str] = []
    for own in [*cut, []]:
        if own:
            found[words_hash(own)] = len(own)
            paragraph += own
        elif paragraph:
            found[words_hash(paragraph)] = len(paragraph)
            paragraph = []
    found[words_hash(every)] = len(every)
    return [{"h": h, "words": n} for h, n in found.items()]


def parse(text: str | None) -> tuple[list[dict], list[dict], str]:
    """(units of the own text, quoted passages with level and units, text without quotations)."""
    lines = (text or "").split("\n")
    levels = [sum(map(m[0].count, ">|")) if (m := MARKS.match(x)) and ">" in m[0] else 0 for x in lines]
    if not any(levels):
        return units_of(lines), [], text or ""
    passages, kept, last = [], [], 0
    for i, (line, level) in enumerate(zip(lines, levels, strict=True)):
        if level:
            if level != last or not passages:
                passages.append({"level": level, "lines": []})
            passages[-1]["lines"].append(MARKS.sub("", line))
        elif not (INTRO.match(line) and any(levels[i + 1 : i + 3])):
            kept.append(line)
        last = level
    quotes = [{"level": p["level"], "units": u} for p in passages if (u := units_of(p["lines"]))]
    return units_of(kept), quotes, re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")


def parsed(messages: DataFrame) -> DataFrame:
    smaller_batches(messages.sparkSession)
    kinds = {n: messages.schema[c].dataType.simpleString() for n, c in (("conv", "conv_id"), ("turn", "turn"), ("role", "role"))}
    units = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int32())]))
    quote = pa.list_(pa.struct([("level", pa.int32()), ("units", units)]))

    def run(batches):
        for part, texts in text_chunks(batches, 4, CHUNK):
            made = [parse(t) for t in texts]
            columns = [pa.array([m[0] for m in made], units), pa.array([m[1] for m in made], quote), pa.array([m[2] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], names=["id", "conv_id", "turn", "role", "own", "quotes", "clean"])

    return messages.select(F.monotonically_increasing_id().alias("id"), "conv_id", "turn", "role", "text").mapInArrow(freed(run), PARSED.format(**kinds))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth of messages (conv_id, turn, reply_to) that answer an earlier one: rounds double the way up."""
    found = materialise(links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("bigint").alias("depth")))
    while True:
        above = found.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"), F.col("depth").alias("more"))
        joined = materialise(found.join(above, ["conv_id", "thread"], "left"))
        found = joined.select("conv_id", "turn", F.coalesce("up", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if joined.filter("up IS NOT NULL").isEmpty():
            return found
        found = materialise(found)


def link_quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean (text without quotations), n_quotes, max_level, n_linked, reply_to (a turn, or null), thread and depth."""
    with scratch(messages.sparkSession):
        return materialise(find_links(messages), stays=True)


def find_links(messages: DataFrame) -> DataFrame:
    own = materialise(parsed(messages))
    quoting = own.filter(F.size("quotes") > 0).select("id", "conv_id", "turn", F.posexplode("quotes").alias("passage", "q"))
    quoted = quoting.select("id", "conv_id", "turn", "passage", "q.level", F.inline("q.units"))
    needed = materialise(quoted.select("conv_id", "h").distinct())
    marks = materialise(bitmap(needed.select(slot_of("h").alias("slot")).distinct()))
    said = marked(own.select("conv_id", "turn", F.explode("own.h").alias("h")), slot_of("h"), marks).join(needed, ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("said"))
    found = quoted.join(said, ["conv_id", "h"]).filter("said < turn").groupBy("id", "passage", "level", "said").agg(F.sum("words").alias("n"))
    best = found.groupBy("id", "passage", "level").agg(F.max(F.struct("n", "said")).alias("b"))
    links = best.groupBy("id").agg(F.count("*").alias("n_linked"), F.max(F.struct(-F.col("level"), F.col("passage"), F.col("b.said").alias("said"))).alias("r"))
    levels = F.coalesce(F.array_max("quotes.level"), F.lit(0))
    joined = own.join(links, "id", "left")
    linked = joined.select("conv_id", "turn", "role", "clean", F.size("quotes").cast("bigint").alias("n_quotes"), levels.alias("max_level"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("r.said").alias("reply_to"))
    linked = materialise(linked)
    # parts of one message answer what the latest of their links leads to
    up = threads(linked.filter("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to")))
    return linked.join(up, ["conv_id", "turn"], "left").withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0))}).select(*linked.columns, "thread", "depth")


def conversations(linked: DataFrame) -> DataFrame:
    """Messages in reply order, sorted over all partitions: by conversation, thread and turn."""
    return linked.orderBy("conv_id", "thread", "turn")


def op1_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """The messages in reply order; the digest columns stand for the texts without quotations."""
    linked = conversations(link_quotations(table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "turn", "role", "n_quotes", "max_level", "n_linked", "reply_to", "thread", "depth", F.length("clean").cast("bigint").alias("clean_chars"), F.sha2("clean", 256).alias("clean_sha256"))
