"""Multi-party dialogues seen from each participant in turn.

For every participant the dialogue is rendered with that speaker as the
assistant and all others as named users; system turns stay system turns.  The
mask has the character spans that the speaker says, with the end marker, so
only they are trained on.

DataFrame functions throughout.  A dialogue is rendered whole.  One of up to 256 turn
numbers, which is nearly every one, is one row; the rendering of a longer one is
dealt over rows that follow each other, in order of ``segment``, ``part_turn`` and ``part_digest``:
their texts, joined in that order, are the whole.  So no group is without bound: a
segment has 256 turn numbers; where more than MOST turns share these, each turn number is a
part, and where more than MOST share one number, the first digits of the turns' digests part them
further.  Participants are those of the whole dialogue.  Equal rows are summed up before
anything is grouped.

Defined results.  Rows equal in conv_id, turn, role and text are one turn
(``n_rows`` has them all).  Turns with one number come in order of the MD5 of role and
text; null turns come in a segment of their own, numbered null and first.  A null role is
``unknown``, a null text empty, a null conv_id a dialogue of its own.  Dialogues
of system turns only have no participant and give no row.  Markers inside a text or a
role are broken up, and line breaks in a role are blanks, so neither can forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turn numbers in a segment; turns in a part.
SEGMENT, MOST = 256, 1024


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def _name(role: Column) -> Column:
    """A role as it is shown: on one line, without markers."""
    return _unmarked(F.regexp_replace(role, "[\r\n]", " "))


def _parts(turns: DataFrame, segment: int, most: int) -> DataFrame:
    """``turns`` with segment, part_turn and part_digest; only full segments are looked at closer."""
    turns = turns.withColumn("segment", F.floor(F.col("turn") / segment))
    each = turns.groupBy("conv_id", "segment", "turn").agg(F.count("*").alias("here"))
    full = each.groupBy("conv_id", "segment").agg(F.sum("here").alias("all")).where(F.col("all") > most)
    full = full.withColumnsRenamed({"conv_id": "c", "segment": "s"})
    each = each.join(full, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("segment").eqNullSafe(F.col("s")))
    # sixteen times as many parts with each digit
    digits = F.when(F.col("here") > most, F.ceil(F.log(F.col("here") / most) / F.log(F.lit(16.0))).cast("int")).otherwise(0)
    each = each.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), digits.alias("digits"))
    found = turns.join(each, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left").drop("c", "t")
    return found.withColumn("part_turn", F.when(F.col("digits").isNotNull(), F.col("turn"))).withColumn("part_digest", F.substring("digest", F.lit(1), F.coalesce("digits", F.lit(0)))).drop("digits")


def _head(role: Column, speaker: Column) -> Column:
    name = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), _name(role)))
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def perspectives(conversations: DataFrame, segment: int = SEGMENT, most: int = MOST) -> DataFrame:
    """conv_id, segment, part_turn, part_digest, speaker, text, mask (half-open character spans in this text), n_turns, n_own, n_rows."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN))
    text = _unmarked(F.coalesce(F.col("text").cast("string"), F.lit("")))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    turns = _parts(turns.withColumn("digest", F.md5(F.concat("role", F.lit("\n"), "text").cast("binary"))), segment, most)
    people = conversations.select("conv_id", role.alias("speaker")).where(F.col("speaker") != SYSTEM).distinct()
    grouped = turns.groupBy("conv_id", "segment", "part_turn", "part_digest").agg(F.array_sort(F.collect_list(F.struct("turn", "digest", "role", "text"))).alias("turns"), F.sum("n").alias("n_rows"))
    seen = grouped.join(people.withColumnRenamed("conv_id", "who_conv"), F.col("conv_id").eqNullSafe(F.col("who_conv"))).drop("who_conv")
    speaker = F.col("speaker")
    pieces = F.transform("turns", lambda t: F.concat(_head(t["role"], speaker), t["text"], F.lit(CLOSE + "\n")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t["role"], speaker))
        end = begin + F.length(t["text"]) + len(CLOSE)
        own = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == speaker, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    mask = F.aggregate("turns", start, step, lambda s: s["spans"])
    return seen.select(
        "conv_id", "segment", "part_turn", "part_digest", "speaker", F.array_join(pieces, "").alias("text"), mask.alias("mask"), F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("turns", lambda t: t["role"] == speaker)).cast("long").alias("n_own"), "n_rows"
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return perspectives(common.read_table(spark, sf_dir, "conversations")).withColumn("mask", shown)


OP6_SQL = f"""
with turns as (
  select conv_id, cast(turn as bigint) as turn, coalesce(role, '{UNKNOWN}') as role, replace(coalesce(text, ''), '<|im_', '< |im_') as text, count(*) as n
  from conversations group by 1, 2, 3, 4),
marked as (select *, md5(role || chr(10) || text) as digest, cast(floor(turn / {SEGMENT}) as bigint) as segment from turns),
sized as (select *, count(*) over (partition by conv_id, segment) as whole, count(*) over (partition by conv_id, turn) as here from marked),
parted as (
  select * exclude (whole, here), case when whole > {MOST} then turn end as part_turn,
    case when whole > {MOST} and here > {MOST} then substr(digest, 1, cast(ceil(ln(here / {MOST}e0) / ln(16e0)) as bigint)) else '' end as part_digest
  from sized),
people as (select distinct conv_id, role as speaker from turns where role <> '{SYSTEM}'),
pieces as (
  select t.*, speaker, role = speaker as own,
    '{OPEN}' || case when role = '{SYSTEM}' then '{SYSTEM}' when role = speaker then 'assistant'
      else 'user name=' || replace(replace(replace(role, chr(10), ' '), chr(13), ' '), '<|im_', '< |im_') end || chr(10) as head,
    text || '{CLOSE}' as body
  from parted t join people p on t.conv_id is not distinct from p.conv_id),
placed as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, segment, part_turn, part_digest, speaker order by turn, digest, role, text rows between unbounded preceding and 1 preceding), 0) + length(head) as start
  from pieces)
select conv_id, segment, part_turn, part_digest, speaker, string_agg(head || body || chr(10), '' order by turn, digest, role, text) as text,
  coalesce(string_agg(case when own then cast(cast(start as bigint) as varchar) || ':' || cast(cast(start as bigint) + length(body) as varchar) end, ',' order by turn, digest, role, text), '') as mask,
  count(*) as n_turns, count_if(own) as n_own, cast(sum(n) as bigint) as n_rows
from placed group by conv_id, segment, part_turn, part_digest, speaker
"""
