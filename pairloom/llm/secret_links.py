"""Secret scan with linking of multipart credentials, in DataFrame functions only.

Patterns of six kinds find spans in code points (end exclusive, leftmost and non-overlapping per kind). ``assign``,
``access`` and ``hex`` are reported wherever they stand. The other three are weak: ``blob`` (a long run of base64
characters), ``user`` (an account name behind a keyword) and ``endpoint`` (an address). Their spans are parts of one
credential only together, so identifiers (access, user), secrets (assign, hex, blob) and endpoints are interval-joined
within a document: two parts are in one scope when at most ``SCOPE`` code points lie between them.

* a blob is reported with an identifier in its scope,
* a user with a secret and an endpoint in its scope,
* an endpoint with an identifier and a secret in its scope.

The interval join asks only whether a part of a role is in reach, so it is a running maximum of ends and a running minimum
of starts over a document's spans in order, linear in their number, and never lists pairs. Only spans are shuffled, once, by
document; their positions are running sums of the lengths between and in the matches.

Defined cases: null and empty texts have no spans (base_sha256 is that of no bytes). Rows are told apart by doc_id and text,
so equal rows have equal results, and a null doc_id is a value like others. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm import jobs

SCOPE = 200


@dataclass(frozen=True)
class Kind:
    """A pattern, the group whose length counts, its least length, and the role of its spans in a credential."""

    name: str
    pattern: str
    group: int
    least: int
    role: str


#: In the order in which spans with the same start are listed; the first three are the base kinds.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "identifier"),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, "secret"),
    Kind("blob", r"[A-Za-z0-9+/]{40,}={0,2}", 0, 40, "secret"),
    Kind("user", r"""(?i)(user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3, "identifier"),
    Kind("endpoint", r"""(?:https?|s3|ftp)://[^\x20\x09-\x0D"'<>]+""", 0, 10, "endpoint"),
)
BASE = 3


def _matches(text: Column, number: int) -> Column:
    """Matches of a kind: lengths of the stretch before and of the match, and whether it is long enough."""
    kind = KINDS[number]
    pattern = F.lit(kind.pattern)
    before = F.transform(F.split(text, kind.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(kind.group)), F.char_length) if kind.group else whole
    found = F.transform(
        F.arrays_zip(before.alias("before"), whole.alias("whole"), counted.alias("counted")),
        lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("place"), x["before"].alias("before"), x["whole"].alias("whole"), (x["counted"] >= kind.least).alias("enough")),
    )
    found = F.filter(found, lambda x: x["whole"].isNotNull())  # the stretch behind the last match has none
    return F.when(text.rlike(kind.pattern), found).otherwise(F.array().cast("array<struct<kind:int,place:int,before:int,whole:int,enough:boolean>>"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, kind, start, end) of every reported span; ``mark`` tells texts of one doc_id apart."""
    text = F.col("text")
    found = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.explode(F.concat(*(_matches(text, k) for k in range(len(KINDS))))).alias("m"))
    key = [F.col("doc_id"), F.col("mark")]
    found = found.select("doc_id", "mark", "m.*").distinct().repartition(*key)
    upto = Window.partitionBy(*key, "kind").orderBy("place")
    end = F.sum(F.col("before").cast("long") + F.col("whole")).over(upto)
    found = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("whole")).where("enough")

    order = Window.partitionBy(*key).orderBy("start", "kind")
    back = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("kind"))  # running backwards keeps each window linear
    ahead, behind = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, back))

    def near(role: str) -> Column:
        own = F.col("kind").isin([k for k, kind in enumerate(KINDS) if kind.role == role])
        left = F.max(F.when(own, F.col("end"))).over(ahead) >= F.col("start") - SCOPE
        right = F.min(F.when(own, F.col("start"))).over(behind) <= F.col("end") + SCOPE
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    needs = {"blob": ("identifier",), "user": ("secret", "endpoint"), "endpoint": ("identifier", "secret")}
    roles = ("identifier", "secret", "endpoint")
    found = found.select("doc_id", "mark", "kind", "start", "end", *(near(role).alias(role) for role in roles))
    linked = F.col("kind") < BASE
    for number, kind in enumerate(KINDS[BASE:], start=BASE):
        complete = F.col("kind") == number
        for role in needs[kind.name]:
            complete = complete & F.col(role)
        linked = linked | complete
    return found.where(linked).select("doc_id", "mark", "kind", "start", "end")


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_linked, the number of weak spans reported."""
    docs = jobs.with_columns(docs, doc_id="long", text="string")
    found = spans(docs)
    name = F.element_at(F.array(*(F.lit(kind.name) for kind in KINDS)), F.col("kind") + 1)
    shown = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    listed = found.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "kind", shown.alias("shown")))).alias("listed"))
    count = lambda test: F.coalesce(F.size(F.filter("listed", test)), F.lit(0)).cast("long")
    of_kind = lambda k: count(lambda x: x["kind"] == k)
    joined = lambda items: F.coalesce(F.array_join(F.transform(items, lambda x: x["shown"]), ","), F.lit(""))
    left, right = docs.select("doc_id", F.xxhash64("text").alias("mark")).alias("l"), listed.alias("r")
    match = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.mark") == F.col("r.mark"))
    return left.join(right, match, "left").select(
        "l.doc_id",
        *(of_kind(k).alias(f"n_{KINDS[k].name}") for k in range(BASE)),
        F.sha2(joined(F.filter("listed", lambda x: x["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("listed")).alias("spans"),
        count(lambda x: x["kind"] >= BASE).alias("n_linked"),
    )
