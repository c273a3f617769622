"""Secret links, contiguous shards and decontamination against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from pairloom.llm import contiguous_shards, decontaminate, secret_links
from tests.llm.conftest import SF, frame

KINDS = secret_links.KINDS


def secrets_by_force(text):
    text, spans = text or "", []
    for number, kind in enumerate(KINDS):
        for m in re.finditer(kind.pattern, text, re.ASCII):
            if len(m.group(kind.group)) >= kind.least:
                spans.append((m.start(), number, m.end()))
    spans.sort()

    def near(span, role):
        return any(o is not span and KINDS[o[1]].role == role and o[2] >= span[0] - 200 and o[0] <= span[2] + 200 for o in spans)

    needs = {3: ("identifier",), 4: ("secret", "endpoint"), 5: ("identifier", "secret")}
    told = [s for s in spans if s[1] < 3 or all(near(s, role) for role in needs[s[1]])]
    base = [s for s in spans if s[1] < 3]
    listed = lambda some: ",".join(f"{KINDS[k].name}:{a}:{b}" for a, k, b in some)
    counts = tuple(sum(s[1] == k for s in spans) for k in range(3))
    return (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(told), len(told) - len(base))


def test_secrets(spark, docs, texts):
    rng = random.Random(4)
    parts = ["AKIA" + "Q7" * 9, "password=hunter2hunter2", "0f" * 20, "user: maria", "https://db.example.org/x", "Zz9/" * 12, "ü plain words " * 20]
    made = [(8000 + k, " ".join(rng.choices(parts, k=rng.randint(1, 9)))) for k in range(150)]
    made += [(8001, "secret=abcdefg"), (None, "secret=abcdef"), (None, None), (8001, "secret=abcdefg")]
    df = docs.select("doc_id", "text", "mark", "start").unionByName(frame(spark, made), allowMissingColumns=True)
    got = collections.Counter(tuple(r) for r in secret_links.scanned(df).collect())
    assert got == collections.Counter((doc, *secrets_by_force(text)) for doc, text in texts + made)
    assert sum(r[6] for r in got) > 100


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for size in sizes:
            if filled + size > middle:
                used, filled = used + 1, 0
            filled += size
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(docs, texts, shards):
    got = contiguous_shards.sharded(docs, shards).toPandas()
    text = dict(texts)
    groups = collections.OrderedDict()
    for doc, mine in sorted(texts, key=lambda r: r[0]):
        groups[mine] = groups.get(mine, 0) + len((mine or "").encode()) + 1
    assert got.groupby("shard")["size"].sum().max() == smallest_capacity(list(groups.values()), shards)
    assert got["shard"].between(0, shards - 1).all() and set(got["law"]) == {"bytes"}
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    where = collections.defaultdict(set)
    for r in got.itertuples():
        mine = text[r.doc_id]
        assert (r.size, r.text_crc32) == (len((mine or "").encode()) + 1, zlib.crc32((mine or "").encode()))
        where[mine].add(r.shard)
    assert len(got) == len(texts) and all(len(v) == 1 for v in where.values())


def test_shards_of_one_hot_group_and_nameless_rows(spark):
    rows = [(k, "same") for k in range(50)] + [(100 + k, f"t{k}") for k in range(30)] + [(None, None), (None, "q"), (3, "same")]
    got = contiguous_shards.sharded(frame(spark, rows), 4).toPandas()
    assert got.groupby("shard")["size"].sum().max() == 51 * 5  # the hot group alone
    assert len(got) == len(rows)


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def leaks_by_force(rows, items):
    out = {}
    for doc, text in rows:
        mine = tokens(text)
        for item, wanted in items:
            want = tokens(wanted)
            if len(want) < decontaminate.FEWEST:
                continue
            if len(want) < 12:
                hit = any(mine[p : p + len(want)] == want for p in range(len(mine)))
            else:
                places = collections.defaultdict(list)
                for q, t in enumerate(want):
                    places[t].append(q)
                shifts = {p - q for p, t in enumerate(mine) for q in places.get(t, ())}
                hit = any(
                    sum(mine[s + q + k] == want[q + k] for k in range(12)) >= 10
                    for s in shifts
                    for q in range(max(0, -s), min(len(want), len(mine) - s) - 11)
                )
            if hit:
                out.setdefault(doc, set()).add(item)
    return {doc: sorted(found) for doc, found in out.items()}


def test_decontamination(spark, docs, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rng = random.Random(6)
    made = []
    for k, (_, text) in enumerate(items):
        words = text.split()
        for at in rng.sample(range(len(words)), k % 9):
            words[at] = "zzz"
        made.append((9000 + k, "Hello there " + " ".join(words[rng.randint(0, 4) :]) + " and more"))
    items += [(900, "one two three four five six"), (901, "short one"), (902, None), (903, "")]
    made += [(9900, "x one TWO three, four five six y"), (9901, "one two three four five seven"), (9902, "one two three four five six")]
    rows = [r for r in texts if r[0] < 5016] + made
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, place string")
    df = docs.where("doc_id < 5016").unionByName(frame(spark, made), allowMissingColumns=True)
    want = leaks_by_force(rows, items)
    got = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(df, benchmark).collect()}
    assert got == want and len(got) > 20
    clean = decontaminate.clean(df, benchmark)
    assert clean.columns == df.columns
    assert sorted(r[0] for r in clean.select("doc_id").collect()) == sorted(doc for doc, _ in rows if doc not in want)


def test_large_benchmarks_are_not_broadcast(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    small = {r["doc_id"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_TOKENS", 0)
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, benchmark).collect()} == small


def test_empty_tables(spark, docs, no_docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert secret_links.scanned(no_docs).count() == 0
    assert contiguous_shards.sharded(no_docs).count() == 0
    assert decontaminate.contaminated(no_docs, benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.where("false")).count() == docs.count()


@pytest.mark.parametrize("make", ["secrets", "shards", "leaks"])
def test_no_python_in_the_plan(spark, docs, make):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    df = {"secrets": lambda: secret_links.scanned(docs), "shards": lambda: contiguous_shards.sharded(docs), "leaks": lambda: decontaminate.contaminated(docs, benchmark)}[make]()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_spans_in_one_text(spark):
    """Windows over one text's spans must not be quadratic."""
    import time

    count = 60_000
    text = " ".join(f"token=abcdef{k % 10} user=bob{k % 7}" for k in range(count // 2))
    start = time.perf_counter()
    row = secret_links.scanned(frame(spark, [(1, text)])).first()
    assert row["n_assign"] == count // 2
    assert time.perf_counter() - start < 60


def test_very_long_text_full_of_probes(spark):
    """A text of a million tokens, most of which begin like the benchmark: positions must not carry the whole text."""
    item = "alpha beta gamma " + " ".join(f"i{k}" for k in range(20))
    text = " ".join(f"alpha beta gamma x{k} y{k}" for k in range(200_000))
    docs = frame(spark, [(1, text), (2, text + " " + item), (3, "none of it")])
    for bound in (decontaminate.BROADCAST_TOKENS, 0):
        items = frame(spark, [(None, item), (8, "delta " * 30)], "item_id long, text string")
        saved, decontaminate.BROADCAST_TOKENS = decontaminate.BROADCAST_TOKENS, bound
        try:
            found = decontaminate.contaminated(docs, items).collect()
        finally:
            decontaminate.BROADCAST_TOKENS = saved
        assert [(r["doc_id"], r["n_hits"] > 0, r["items"]) for r in found] == [(2, True, [])]
