"""Reading a source around a passage: which chunks show it, what of it each of them shows, and the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.intervals import overlapping
from lectern.operators.positions import cumulative
from lectern.operators.visibility import document_visible

#: Bounds of one window: chunks around the passage on either side, chunks that show it, and its characters.
CONTEXT, MOST_CHUNKS, MOST_CHARACTERS = 10, 200, 200_000


def numbered_chunks(blocks: DataFrame) -> DataFrame:
    """(version_id, ordinal, chunk_id, char_start, char_end, text): the chunks of every version in reading order from 0.

    A version of any size: ordinals are counted by range.
    """
    rows = blocks.where("version_id IS NOT NULL").select("version_id", F.col("id").alias("chunk_id"), "char_start", "char_end", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("_one"))
    placed = cumulative(rows, ["version_id"], ["char_start", "chunk_id"], "_one")
    return placed.select("version_id", F.col("below").cast("int").alias("ordinal"), "chunk_id", "char_start", "char_end", "text")


def refused(start: Column, end: Column, context: int) -> Column:
    """Why a range can't be shown, or null."""
    if not 0 <= context <= CONTEXT:
        raise ValueError(f"context must be between 0 and {CONTEXT}")
    return F.when(start.isNull() | end.isNull() | (start < 0) | (end <= start) | (end - start > MOST_CHARACTERS), "invalid_range")


def passage_windows(asked: DataFrame, versions: DataFrame, chunks: DataFrame, context: int = 2) -> DataFrame:
    """(request_id, reason, focus, next_from, has_more, ordinal, chunk_id, local_start, local_end).

    ``asked`` (request_id, tenant_id, document_id, version_no, start, end,
    allowed): a stretch of a version of a document.  One row for each chunk
    that shows it and for those around; ``local_start`` and ``local_end`` say
    what of the stretch the chunk shows that none before it does (null for
    none).  A request that can't be answered has one row with a ``reason``:
    ``invalid_range``, ``not_found`` (also if it may not be seen),
    ``too_many_chunks`` or ``unresolved`` (a part of it is in no chunk, nor
    between two neighbours).  ``chunks`` as `numbered_chunks` gives them;
    chunks whose offsets don't fit their text show nothing.
    """
    checked = asked.withColumn("reason", refused(F.col("start"), F.col("end"), context))
    v = versions.select("version_id", "tenant_id", "document_id", "version_no", "acl")
    known = checked.where("reason IS NULL").join(v, ["tenant_id", "document_id", "version_no"]).where(document_visible(F.col("acl"), F.col("allowed")))
    known = known.select("request_id", "version_id", "start", "end")
    fitting = chunks.where("char_start >= 0 AND char_end = char_start + length(text) AND char_end > char_start")
    shown = overlapping(known, fitting.select("version_id", "ordinal", "chunk_id", "char_start", "char_end"), ["version_id"], ("start", "end"), ("char_start", "char_end"))
    sizes = shown.groupBy("request_id").agg(F.count("*").alias("_n"))
    few = shown.join(sizes.where(F.col("_n") <= MOST_CHUNKS), "request_id")
    # At most MOST_CHUNKS rows of a request from here on.
    order = Window.partitionBy("request_id").orderBy("ordinal")
    reach = F.max(F.least("char_end", "end")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = few.withColumn("_reach", F.coalesce(reach, F.col("start"))).withColumn("_before", F.lag("ordinal").over(order))
    own = own.withColumn("_from", F.greatest("char_start", "start", "_reach")).withColumn("_to", F.least("char_end", "end"))
    # A gap is explained if it lies between neighbours; before the first or after the last chunk it is not.
    open_gap = (F.col("_from") > F.col("_reach")) & ~F.coalesce(F.col("_before") + 1 == F.col("ordinal"), F.lit(False))
    own = own.withColumn("_gap", open_gap)
    marked = own.where("_to > _from")
    spread = own.groupBy("request_id", "version_id", "end").agg(F.max("_gap").alias("_gap"), F.max("_to").alias("_last"))
    found = marked.groupBy("request_id").agg(F.min("ordinal").alias("focus"), F.max("ordinal").alias("_until"))
    found = spread.where("NOT _gap AND _last = end").join(found, "request_id")
    last = chunks.groupBy("version_id").agg(F.max("ordinal").alias("_most"))
    wanted = found.join(last, "version_id").select(
        "request_id", "version_id", "focus", F.least(F.col("_until") + context, F.col("_most")).alias("_high"), "_most",
        F.explode(F.sequence(F.greatest(F.col("focus") - context, F.lit(0)), F.least(F.col("_until") + context, F.col("_most")))).alias("ordinal"),
    )
    window = wanted.join(chunks.select("version_id", "ordinal", "chunk_id"), ["version_id", "ordinal"])
    local = marked.select("request_id", "ordinal", (F.col("_from") - F.col("char_start")).alias("local_start"), (F.col("_to") - F.col("char_start")).alias("local_end"))
    rows = window.join(local, ["request_id", "ordinal"], "left").select(
        "request_id", F.lit(None).cast("string").alias("reason"), "focus", (F.col("_high") + 1).alias("next_from"), (F.col("_high") < F.col("_most")).alias("has_more"), "ordinal", "chunk_id", "local_start", "local_end"
    )
    many = sizes.where(F.col("_n") > MOST_CHUNKS).select("request_id", F.lit("too_many_chunks").alias("_why"))
    seen = known.select("request_id", F.lit("unresolved").alias("_else")).distinct()
    failed = checked.join(found.select("request_id"), "request_id", "left_anti").join(many, "request_id", "left").join(seen, "request_id", "left")
    why = F.coalesce("reason", "_why", "_else", F.lit("not_found"))
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:]]
    return rows.unionByName(failed.select("request_id", why.alias("reason"), *nothing))


def excerpts(passages: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(passage_id, excerpt): the text of [start, end) of every passage, put together from the chunks that hold it.

    Each chunk is cut to the passage; what lies between chunks adds nothing.
    A passage has at most MOST_CHARACTERS, longer ones are left out.
    """
    asked = passages.where(refused(F.col("start"), F.col("end"), 0).isNull()).select("passage_id", *keys, "start", "end")
    held = chunks.select(*keys, "chunk_id", "char_start", (F.col("char_start") + F.length("text")).alias("_end"), "text").where("_end > char_start")
    cut = overlapping(asked, held, keys, ("start", "end"), ("char_start", "_end"))
    low, high = F.greatest(F.col("start") - F.col("char_start"), F.lit(0)), F.least(F.col("end"), F.col("_end")) - F.col("char_start")
    parts = cut.select("passage_id", F.struct("char_start", "chunk_id", F.substring(F.col("text"), low + 1, high - low).alias("t")).alias("p"))
    return parts.groupBy("passage_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("excerpt"))


def _clean(spans: Column, text: Column) -> Column:
    return F.array_sort(F.filter(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")), lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text))))


_SEGMENT = "array<struct<text:string,hit:boolean,anchor:boolean>>"


def segments(text: Column, spans: Column, clip: bool = False) -> Column:
    """A text in pieces (text, hit, anchor), of which those in ``spans`` (start, end) are hits; the first hit is the anchor.

    Spans that aren't within the text are dropped.  One that begins in the one
    before is dropped too, or with ``clip`` cut to what is left of it.  No
    piece for null and empty texts.
    """

    def piece(start: Column, end: Column, hit: bool, first: Column) -> Column:
        part = F.substring(text, start + 1, end - start)
        one = F.array(F.struct(part.alias("text"), F.lit(hit).alias("hit"), (first & F.lit(hit)).alias("anchor")))
        return F.when(end > start, one).otherwise(F.array()).cast(_SEGMENT)

    zero = F.struct(F.lit(0).alias("at"), F.lit(True).alias("first"), F.array().cast(_SEGMENT).alias("pieces"))

    def step(state: Column, span: Column) -> Column:
        start = F.greatest(span["start"], state["at"])
        use = (span["end"] > start) if clip else (span["start"] >= state["at"])
        pieces = F.concat(state["pieces"], piece(state["at"], start, False, F.lit(False)), piece(start, span["end"], True, state["first"]))
        return F.struct(F.when(use, span["end"]).otherwise(state["at"]).alias("at"), (state["first"] & ~use).alias("first"), F.when(use, pieces).otherwise(state["pieces"]).alias("pieces"))

    done = F.aggregate(_clean(spans, text), zero, step, lambda s: F.concat(s["pieces"], piece(s["at"], F.length(text), False, F.lit(False))))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, done).otherwise(F.array().cast(_SEGMENT))
