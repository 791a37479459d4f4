"""Multi-party perspective rotation of dialogues.

Every participant of a conversation gets the whole dialogue rendered from their side: their own turns as the
assistant's, everyone else's as turns of named users. Loss spans cover the participant's own words and their end marks,
nothing else. Roles in ``context`` (system prompts) are instructions: rendered as they are, never rotated or trained on.

A rendering is cut between turns into chunks of ``CHUNK_TURNS`` turn numbers, so a conversation of any length is spread
over many tasks; ``start`` is the place of a chunk in the whole rendering, and the chunks of a (conversation, speaker)
in order are the rendering. The text crosses the network once, by conversation and chunk; who speaks and how long
chunks are is worked out from small counts.

Equal and null turn numbers can fill a chunk with any number of turns. If a chunk has more than ``CHUNK_TURNS`` turns or,
with several turns, more than ``CHUNK_CHARS`` characters of text, turns are numbered inside their chunk, equal ones as one
row with a count, by running totals in ranges of (conversation, chunk, turn, role, text), and chunks are cut by that
number and by characters. The rows of such a chunk have one chunk number and rising ``start``.

Defined cases: turns are ordered by turn, then role, then text, a null turn number last; a null text is empty; a null
role speaks as an unnamed user and is no participant; rows without a conversation id form one conversation; repeated
rows are repeated turns; marks of the format inside texts and names are broken up by a space; a conversation without
participants and an empty table give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

CHUNK_TURNS = 64
CHUNK_CHARS = 4_000_000
CONTEXT = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_LAST = (1 << 62) - 1


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _header(role: Column, speaker: Column, context: Sequence[str]) -> Column:
    """The opening line of a turn; an empty role has no name."""
    who = (
        F.when(role == speaker, F.lit("assistant"))
        .when(role.isin(*context), role)
        .when(role == "", F.lit("user"))
        .otherwise(F.concat(F.lit("user name="), role))
    )
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def _cut(rows: DataFrame, place: Sequence[str], chunk_turns: int, chunk_chars: int) -> DataFrame:
    """The rows, equal ones of a piece as one with ``copies``, with the ``piece`` and ``cut`` of their chunk.

    A piece has at most ``chunk_turns`` turns; the turns of a cut start in the same ``chunk_chars`` characters of the chunk.
    """
    order = [*place, "turn", "role", "text"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = rows.groupBy(*order).agg(F.count("*").alias("n"))
    # written, so a row's range does not change when a lost executor recomputes others
    dealt = keep(same.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()))
    size = F.char_length("text").cast("bigint")
    dealt = dealt.withColumn("size", size).withColumn("chars", F.col("n") * F.col("size"))
    earlier = Window.partitionBy(*place).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part", *place).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    total = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    starts = starts.select("part", *place, total("n", earlier).alias("n0"), total("chars", earlier).alias("chars0"))
    inside = Window.partitionBy("part", *place).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.join(starts, ["part", *place]).select(
        *order, "n", "size", (F.col("n0") + total("n", inside)).alias("first"), (F.col("chars0") + total("chars", inside)).alias("at")
    )
    end = F.col("first") + F.col("n")
    pieces = F.sequence(F.floor(F.col("first") / chunk_turns), F.floor((end - 1) / chunk_turns))
    low = F.greatest("first", F.col("piece") * chunk_turns)
    found = numbered.withColumn("piece", F.explode(pieces)).withColumn("low", low)
    high = F.least(F.col("first") + F.col("n"), (F.col("piece") + 1) * chunk_turns)
    cuts = F.transform(
        F.sequence(F.col("low"), high - 1), lambda i: F.floor((F.col("at") + (i - F.col("first")) * F.col("size")) / chunk_chars)
    )
    found = found.withColumn("cuts", cuts).withColumn("cut", F.explode(F.array_distinct("cuts")))
    return found.select(*order, "piece", "cut", F.size(F.filter("cuts", lambda c: c == F.col("cut"))).alias("copies"))


def rotate(
    turns: DataFrame, context: Sequence[str] = CONTEXT, chunk_turns: int = CHUNK_TURNS, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """(conv_id, speaker, chunk, start, n_turns, text, loss_spans) for every participant of every conversation.

    ``turns`` has conv_id, turn, role and text. ``loss_spans`` are (start, end) in the text of the chunk; ``start`` is the
    number of characters before the chunk. In order of chunk and start the texts are the whole rendering.
    """
    rows = turns.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(_LAST)).alias("turn"),
        F.translate(_clean(F.col("role")), "\n", " ").alias("role"),
        _clean(F.col("text")).alias("text"),
    ).withColumn("chunk", F.floor(F.col("turn") / chunk_turns))
    key, place = ["none", "conv"], ["none", "conv", "chunk"]
    chars = F.sum(F.char_length("text").cast("bigint"))
    load = rows.groupBy(*place).agg(F.count("*").alias("n"), chars.alias("chars"))
    large = not load.filter((F.col("n") > chunk_turns) | ((F.col("n") > 1) & (F.col("chars") > chunk_chars))).isEmpty()
    if large:
        rows = _cut(rows, place, chunk_turns, chunk_chars)
        place += ["piece", "cut"]
    copies = F.col("copies") if large else F.lit(1)

    # lengths by role: one row per conversation, chunk and role
    sizes = rows.groupBy(*place, "role").agg(
        F.sum(copies).alias("n"),
        F.sum(copies * F.char_length("text").cast("bigint")).alias("chars"),
    )
    speakers = sizes.filter((F.col("role") != "") & ~F.col("role").isin(*context)).select(*key, F.col("role").alias("speaker"))
    # a header is counted for every turn; own turns have the assistant's
    nobody = F.lit("\n")
    as_other = F.col("chars") + F.col("n") * (F.char_length(_header(F.col("role"), nobody, context)) + len(CLOSE))
    own_gain = F.col("n") * (len(OPEN) + len("assistant\n") - F.char_length(_header(F.col("role"), nobody, context)))
    chunks = sizes.groupBy(*place).agg(F.sum(as_other).alias("length"))
    gains = sizes.select(*place, F.col("role").alias("speaker"), own_gain.alias("gain"))
    sides = chunks.join(speakers.distinct(), key).join(gains, [*place, "speaker"], "left")
    before = Window.partitionBy(*key, "speaker").orderBy(*place[2:]).rowsBetween(Window.unboundedPreceding, -1)
    own_length = F.col("length") + F.coalesce("gain", F.lit(0))
    sides = sides.select(*place, "speaker", F.coalesce(F.sum(own_length).over(before), F.lit(0)).alias("start"))

    held = rows.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", copies.alias("copies")))).alias("turns"))
    if large:
        held = held.withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["copies"]))))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            _header(t["role"], F.col("speaker"), context).alias("head"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            (t["role"] == F.col("speaker")).alias("own"),
        ),
    )
    shown = held.join(sides, place).withColumn("parts", parts)
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda done, p: F.struct(
            (done["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).alias("at"),
            F.when(
                p["own"],
                F.concat(
                    done["spans"],
                    F.array(
                        F.struct(
                            (done["at"] + F.char_length(p["head"])).alias("start"),
                            # the line break after the end mark is not learnt
                            (done["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) - 1).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(done["spans"])
            .alias("spans"),
        ),
        lambda done: done["spans"],
    )
    return shown.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        "speaker",
        "chunk",
        "start",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        spans.alias("loss_spans"),
    )


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every participant's side."""
    spans = F.transform("loss_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    done = rotate(table(spark, sf_dir, "conversations"))
    return done.withColumn("loss_spans", F.array_join(spans, ","))


_SQL = """
WITH rows AS (
  SELECT conv_id, coalesce(turn, 4611686018427387903) AS turn,
    replace(replace(coalesce(role, ''), '<|im_', '<| im_'), chr(10), ' ') AS role,
    replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows WHERE role NOT IN ('', 'system')),
shown AS (
  SELECT r.*, speaker, CAST(floor(turn / 64) AS BIGINT) AS chunk, role = speaker AS own,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role WHEN role = '' THEN 'user'
      ELSE 'user name=' || role END || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body
  FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, row_number() OVER w AS seq, sum(length(head) + length(body)) OVER w - length(head) - length(body) AS pos
  FROM shown WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
chunks AS (
  SELECT conv_id, speaker, chunk, min(pos) AS start, count(*) AS n_turns, string_agg(head || body, '' ORDER BY seq) AS text
  FROM placed GROUP BY conv_id, speaker, chunk),
spans AS (
  SELECT p.conv_id, p.speaker, p.chunk, string_agg(CAST(CAST(pos - start + length(head) AS BIGINT) AS VARCHAR) || ':' ||
    CAST(CAST(pos - start + length(head) + length(body) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY seq) AS loss_spans
  FROM placed p JOIN chunks c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.speaker = c.speaker AND p.chunk = c.chunk
  WHERE own GROUP BY p.conv_id, p.speaker, p.chunk)
SELECT c.conv_id, c.speaker, c.chunk, CAST(c.start AS BIGINT) AS start, c.n_turns, c.text, coalesce(loss_spans, '') AS loss_spans
FROM chunks c LEFT JOIN spans s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.speaker = s.speaker AND c.chunk = s.chunk
"""

QUERIES = {"op1_chat_perspectives": (op1_chat_perspectives, _SQL)}
