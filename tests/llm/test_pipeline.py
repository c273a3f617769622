"""The pipeline's stages against brute force, and every query of the folder on the smallest tables."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pairloom.llm import language_id, soft_mixing
from pairloom.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF, frame
from tests.llm.test_native_operators import leaks_by_force, smallest_capacity
from tests.llm.test_text_operators import lowered
from tools.compare import compare, database

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and returns, over the smallest table with some rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    more = [(4000, "123 456 !!", "en", "src1", 10), (4001, None, None, None, None), (4002, first["text"], "en", "src0", 1), (first["doc_id"], first["text"], "en", "src0", 1), (None, "the and of that was", "en", "src0", 1)]
    given = docs.unionByName(frame(spark, more, SCHEMA))
    out = [given.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def ids(df):
    return collections.Counter(r[0] for r in df.select("doc_id").collect())


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontaminate", "mix", "shard"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} <= set(stages[-1].columns)


def test_language_stage(stages):
    found = {r["id"]: r for r in language_id.identified(language_id.of_documents(stages[0])).collect()}
    kept = ids(stages[1])
    assert not {4000, 4001} & set(kept)
    assert kept == collections.Counter({d: n for d, n in ids(stages[0]).items() if found[d]["accepted"]})


def test_near_duplicate_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    sets = {}
    for doc, text in rows:
        words = lowered(text)
        sets[doc] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = sorted(d for d in sets if d is not None)
    for a in named:
        for b in named:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {d for d in named if find(d) == d} | ({None} & set(sets))
    assert ids(stages[2]) == collections.Counter(want)
    assert len(want) < len(rows)


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    leaks = leaks_by_force(rows, items)
    assert leaks and ids(stages[3]) == collections.Counter(d for d, _ in rows if d not in leaks)


def test_mixing_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    copies = {r["doc_id"]: r["copies"] for r in soft_mixing.rated(stages[3], labels).collect()}
    assert ids(stages[4]) == collections.Counter({d: n for d, n in copies.items() if n})


def test_sharding_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[4].collect()]
    got = stages[5].toPandas()
    groups = collections.OrderedDict()
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        groups[text] = groups.get(text, 0) + len(text.encode()) + 1
    assert got.groupby("shard")["size"].sum().max() == smallest_capacity(list(groups.values()), 8)
    assert len(got) == len(rows)


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == stages[-1].columns and out.count() > 100


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query(spark, name):
    out = entry.queries()[name](spark, SF)
    assert out.count() > 0 and ("doc_id" in out.columns or "page_id" in out.columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    verdict, *_ = compare(spark, database(SF), name, SF)
    assert verdict == "equal"


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 11))
    assert "pipeline" in entry.queries()
