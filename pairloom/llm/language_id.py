"""Language identification by Bayesian fusion of a text's likelihood with what is declared about it.

Evidence on a row's language, multiplied as likelihoods (log-likelihoods are added):

* *text*: byte trigrams of its words under one multinomial model per declared language, however many there are, learned from
  a sample of rows with their declared language as (noisy) label: about ``SAMPLED`` of all, and about ``EACH`` of every
  language that has fewer among these (all, if it has fewer at all). Trigrams are not independent, so the sum is damped to ``WORTH`` trigrams;
* *declared* markup language: how often the rows of a language declare it, over all rows;
* *suffix* of the address: how often the rows of a language have it;
* *host* prior: languages of the host's rows, smoothed by those of its parent domain, and these by those of all rows. Each
  level is one grouped aggregation of the text's posteriors over all rows, pre-aggregated before its shuffle.

A row is accepted when its text has letters and its best language has a posterior of at least ``CONFIDENT``.

Only the trigram tables, BUCKETS numbers per declared language, and the table of declared languages are sent to tasks. Host and domain tables grow with the data and are joined by Spark; a hot host is one row there,
and the rows' side of that join is split by Spark's skew handling.

Defined cases: null and empty texts, or texts without letters, rest on the other evidence and are not accepted; a null or
unknown declared language, and an address without host or suffix, say nothing; null ids are kept; equal rows get equal
results; without any declared language there is no language to choose, and nothing is accepted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import jobs, packed
from pairloom.workspace import travels_with_tasks

travels_with_tasks(__name__)

SAMPLED = 12_000
#: Rows of a declared language that are learned from at every size of the table, if it has so many.
EACH = 200
BUCKETS = 1 << 14
#: Trigrams that a long text counts as; pseudo-rows by which a host or domain is drawn towards the level above.
WORTH = 40.0
PSEUDO = 20.0
CONFIDENT = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _trigrams(piece: packed.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every byte trigram that has a letter in its middle, A-Z lower-cased, blanks made equal."""
    data = packed.LOWER[piece.data]
    data = np.where(packed.WHITE[data], 32, data).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    key = (key * np.uint32(2654435761)) >> np.uint32(18)
    inside = _LETTER[piece.data[1:-1]]
    for cut in piece.bounds[1:-1].tolist():  # not across documents
        inside[max(0, cut - 2) : cut] = False
    at = np.flatnonzero(inside)
    row = np.repeat(np.arange(len(piece.bounds) - 1), np.diff(piece.bounds))
    return row[at], key[at].astype(np.int64)


def _count(batches, languages: list[str]):
    """Trigram counts per language and bucket."""
    for batch in batches:
        label = pa.compute.index_in(batch.column("declared"), pa.array(languages)).to_numpy(zero_copy_only=False).astype(np.int64)
        for piece in packed.pieces(batch, size=8 * packed.PIECE):
            row, key = _trigrams(piece)
            place, n = np.unique(label[piece.first + row] * BUCKETS + key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place // BUCKETS), pa.array(place % BUCKETS), pa.array(n)], names=["language", "bucket", "n"])


def _likelihoods(batches, shipped):
    """Damped log-likelihood of each row's text per language (less its largest), and its number of trigrams."""
    table = shipped.value
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        out = np.zeros((batch.num_rows, table.shape[0]))
        for piece in packed.pieces(batch):
            row, key = _trigrams(piece)
            rows = piece.last - piece.first
            size[piece.first : piece.last] = np.bincount(row, minlength=rows)
            for k in range(table.shape[0]):
                out[piece.first : piece.last, k] = np.bincount(row, weights=table[k][key], minlength=rows)
        out *= np.minimum(1.0, WORTH / np.maximum(size, 1))[:, None]
        out -= out.max(axis=1, keepdims=True)
        rest = [batch.column(c) for c in ("id", "declared", "host", "domain", "suffix")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(size), packed.list_array(out.ravel(), np.full(len(out), out.shape[1]))], names=["id", "declared", "host", "domain", "suffix", "letters", "text"])


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _plus(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + F.coalesce(b, F.lit(0.0)))


def parts_of(address: Column) -> tuple[Column, Column, Column]:
    """Host, parent domain and suffix of an address; a bare name is a host without domain and suffix."""
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", F.regexp_replace(host, r"\.+$", ""))
    labels = F.split(host, r"\.")
    dotted = F.size(labels) > 1
    return host, F.when(dotted, F.concat_ws(".", F.slice(labels, -2, 2))), F.when(dotted, F.element_at(labels, -1))


def identified(rows: DataFrame) -> DataFrame:
    """From (id, text, declared, address): id, language, confidence, text_language, letters and accepted."""
    spark = rows.sparkSession
    rows = jobs.with_columns(rows, id="long", text="string", declared="string", address="string")
    host, domain, suffix = parts_of(F.col("address"))
    declared = F.lower(F.regexp_extract("declared", r"^\s*([A-Za-z]{2,8})", 1))  # en-GB is en
    rows = rows.select("id", "text", F.when(declared != "", declared).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))

    known = rows.where("declared IS NOT NULL").groupBy("declared").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["declared"] for r in known)
    if not languages:
        none = F.lit(None).cast("string")
        return rows.select("id", none.alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"), F.lit(0).cast("long").alias("letters"), F.lit(False).alias("accepted"))
    share = min(1.0, SAMPLED / sum(r["n"] for r in known))
    shares = spark.createDataFrame([(r["declared"], int(min(1.0, max(share, EACH / r["n"])) * (1 << 20)) + 1) for r in known], "declared string, share long")
    sample = rows.join(F.broadcast(shares), "declared").where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 20)) < F.col("share"))
    counts = np.zeros((len(languages), BUCKETS))
    made = sample.mapInArrow(lambda batches: _count(batches, languages), "language long, bucket long, n long")
    made = made.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[made.column("language").to_numpy(), made.column("bucket").to_numpy()] = made.column("n").to_numpy()
    shared = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    table = np.log((counts + 2000 * shared) / (counts.sum(axis=1, keepdims=True) + 2000))
    shipped = spark.sparkContext.broadcast(table)

    kept = "id long, declared string, host string, domain string, suffix string, letters long, text array<double>"
    scores = jobs.staged(rows.mapInArrow(lambda batches: _likelihoods(batches, shipped), kept), "language-scores")
    width = len(languages)
    soft = scores.where("letters > 0").withColumn("p", _softmax(F.col("text")))
    sums = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(width)]
    listed = F.array(*(F.col(f"s{k}") for k in range(width)))

    def tally(*by: str) -> DataFrame:
        given = [F.col(c).isNotNull() for c in by]
        some = soft if not by else soft.where(given[0])
        return some.groupBy(*by).agg(*sums).select(*by, listed.alias("sums"))

    everything = tally().first()["sums"]
    overall = np.array([x or 0.0 for x in everything]) + 1.0
    top = F.array(*(F.lit(float(x)) for x in overall / overall.sum()))

    def drawn(sums: Column, parent: Column) -> Column:
        total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(sums, parent, lambda n, p: (n + PSEUDO * p) / (total + PSEUDO))

    def given_language(by: str) -> DataFrame:
        """log P(value | language), by value, from all rows."""
        part = tally(by)
        totals = F.array(*(F.lit(float(x)) for x in overall))
        return part.select(by, F.zip_with("sums", totals, lambda n, t: F.log((n + 0.5) / (t + 0.5))).alias(f"by_{by}"))

    domains = tally("domain").select("domain", drawn(F.col("sums"), top).alias("domain_prior"))
    parents = soft.where("host IS NOT NULL").groupBy("host").agg(F.first("domain").alias("domain"), *sums).select("host", "domain", listed.alias("sums"))
    hosts = parents.join(domains, "domain", "left").select("host", drawn(F.col("sums"), F.coalesce("domain_prior", top)).alias("prior"))
    out = scores.join(hosts, "host", "left").join(given_language("declared"), "declared", "left").join(given_language("suffix"), "suffix", "left")

    nothing = F.array(*(F.lit(0.0) for _ in languages))
    prior = F.transform(F.coalesce("prior", top), lambda p: F.log(p))
    fused = _plus(_plus(_plus(prior, F.col("text")), F.coalesce("by_declared", nothing)), F.coalesce("by_suffix", nothing))
    out = out.withColumn("posterior", _softmax(fused))
    names = F.array(*(F.lit(x) for x in languages))
    best = lambda values: F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))
    confidence = F.array_max("posterior")
    return out.select(
        "id",
        best(F.col("posterior")).alias("language"),
        confidence.alias("confidence"),
        F.when(F.col("letters") > 0, best(F.col("text"))).alias("text_language"),
        "letters",
        ((F.col("letters") > 0) & (confidence >= CONFIDENT)).alias("accepted"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """Rows for ``identified``: the language column is what is declared, the source takes the part of the host."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("address"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Rows for ``identified``: text without markup, the language that the markup declares, and the address."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.select(F.col("page_id").alias("id"), bare.alias("text"), declared.alias("declared"), F.col("url").alias("address"))
