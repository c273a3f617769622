"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become lower-case tokens (runs of letters and digits), each a 64-bit hash. A document is contaminated by an item
when ``WINDOW`` consecutive tokens of the two, laid side by side, agree in all but at most ``SUBSTITUTED`` places. Fixed
masks of the places kept find the candidates: with a window in four blocks of three tokens and two substitutions, two
blocks stay whole, and up to a shift two whole blocks are one of three shapes - next to each other, one apart, two apart.
So the three masks together miss nothing. Every hit is then verified in place, on the tokens around it.

All masks keep their first three tokens, so one probe for three tokens passes over most positions before the masks are
hashed. Items of fewer tokens than a window (but ``FEWEST`` at least) have to occur whole; shorter ones take no part.

The benchmark's seeds are broadcast only when it has at most ``BROADCAST_TOKENS`` tokens, which is counted first; a larger
one is joined by shuffle on keys alone. Positions travel in blocks of ``BLOCK`` with the tokens near them, so neither a very long
text nor a large benchmark multiplies whole texts; verified hits are shuffled after a partial aggregation by document.

Defined cases: null and empty texts and items contain nothing; an item with a null item_id is found like others and counts in
n_hits, while ``items`` lists the ids that there are; rows are told apart by doc_id and text, so equal rows agree
and a null doc_id is a value like others; an empty benchmark contaminates nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import jobs

WINDOW = 12
SUBSTITUTED = 2
FEWEST = 5
BLOCK = 64  # positions whose tokens travel together
#: Token places that a mask keeps; a fixed design, see above.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 6, 7, 8), (0, 1, 2, 9, 10, 11))
LEAD = 3
BROADCAST_TOKENS = 200_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text, in order."""
    cut = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(cut, lambda t: t != ""), lambda t: F.xxhash64(t))


def _key(places: tuple[int, ...], number: int) -> Column:
    """Hash of the kept tokens behind position ``at``, with the number of the mask; null where the mask does not fit."""
    kept = [F.get("tokens", F.col("at") + k) for k in places]
    return F.when(kept[-1].isNotNull(), F.xxhash64(F.lit(number), *kept))


def _seeds(tokenized: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """One row per position and mask that fits there, without the first probe."""
    keys = F.array_compact(F.array(*(_key(places, number) for number, places in enumerate(masks))))
    return tokenized.withColumn("key", F.explode(keys))


def _blocks(tokenized: DataFrame) -> DataFrame:
    """BLOCK consecutive positions each (``first`` .. ``last`` of the block's own tokens), with the tokens that windows around them reach.

    So a position carries the tokens near it, never the whole text.
    """
    numbers = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / BLOCK).cast("int"))

    def block(b: Column) -> Column:
        start = F.greatest(b * BLOCK - (WINDOW - 1), F.lit(0))
        return F.struct(
            start.alias("base"),
            (b * BLOCK - start).alias("first"),
            F.slice("tokens", start + 1, b * BLOCK - start + BLOCK + WINDOW - 1).alias("tokens"),
        )

    cut = tokenized.where(F.size("tokens") > 0).withColumn("block", F.explode(F.transform(numbers, block)))
    return cut.select(*(c for c in tokenized.columns if c != "tokens"), "block.*")


def _positions(blocks: DataFrame, fewest: int) -> DataFrame:
    last = F.least(F.col("first") + BLOCK, F.size("tokens") - fewest + 1) - 1
    return blocks.where(last >= F.col("first")).withColumn("at", F.explode(F.sequence(F.col("first"), last)))


def _verified() -> Column:
    """Whether the hit lies in a window that agrees well enough, or covers a short item whole."""
    agree = F.transform(
        F.sequence(F.lit(1 - WINDOW), F.lit(WINDOW - 1)),
        lambda k: F.coalesce(
            (F.when((F.col("at") + k >= 0) & (F.col("place") + k >= 0), F.get("tokens", F.col("at") + k) == F.get("item", F.col("place") + k))).cast("int"),
            F.lit(0),
        ),
    )
    window = F.exists(
        F.sequence(F.lit(1), F.lit(WINDOW)),
        lambda start: F.aggregate(F.slice(agree, start, WINDOW), F.lit(0), lambda a, x: a + x) >= WINDOW - SUBSTITUTED,
    )
    whole = (F.size("item") < WINDOW) & (F.col("place") == 0) & (F.slice("tokens", F.col("at") + 1, F.size("item")) == F.col("item"))
    return F.when(F.size("item") < WINDOW, whole).otherwise(window)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, n_hits, items) of the contaminated documents; ``mark`` tells texts of one doc_id apart."""
    benchmark = jobs.with_columns(benchmark, item_id="long", text="string")
    items = benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= FEWEST).distinct()
    # A number of its own stands for an item, so that a null item_id is found like any other.
    items = jobs.staged(items.withColumn("item_no", F.monotonically_increasing_id()), "benchmark-tokens")
    total, shorts = items.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)), F.collect_set(F.when(F.size("tokens") < WINDOW, F.size("tokens")))).first()
    few = total <= BROADCAST_TOKENS
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    masks = [*MASKS, *(tuple(range(n)) for n in sorted(shorts))]  # whole short items, of WINDOW - FEWEST lengths at most
    lead = _key(tuple(range(LEAD)), -1).alias("lead")

    item_positions = _positions(_blocks(items), FEWEST)
    seeds = _seeds(item_positions, masks).select("key", "item_no", (F.col("base") + F.col("at")).alias("place")).distinct()
    leads = item_positions.select(lead).distinct()

    docs = jobs.with_columns(docs, doc_id="long", text="string").where("text IS NOT NULL")
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), tokens(F.col("text")).alias("tokens"))
    blocks = _blocks(docs)
    if few:
        at = _positions(blocks, FEWEST).withColumn("lead", lead).join(small(leads), "lead").drop("lead")
    else:  # only keys are shuffled; the tokens come back for the positions that may hit
        probes = _positions(blocks, FEWEST).select(F.col("doc_id").alias("p_id"), F.col("mark").alias("p_mark"), F.col("base").alias("p_base"), "at", lead)
        probes = probes.join(leads, "lead", "left_semi").drop("lead").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("mark") == F.col("p_mark")) & (F.col("base") == F.col("p_base"))
        at = blocks.join(probes, same).drop("p_id", "p_mark", "p_base")
    hits = _seeds(at, masks).join(small(seeds), "key")
    hits = hits.join(small(items.select("item_no", "item_id", F.col("tokens").alias("item"))), "item_no").where(_verified())
    return hits.groupBy("doc_id", "mark").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_set("item_id")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns kept."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_found_id"), F.col("mark").alias("_found_mark"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_found_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_found_mark"))
    return docs.join(found, same, "left_anti")
