"""Toxicity, language identification and mixing: behaviour on made-up corpora with known answers, and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import language_id, soft_mixing, toxicity
from tests.llm.conftest import SF, frame


def corpus(size=1200, seed=8):
    """(doc_id, text, quality, toxic): long ordinary texts, a tenth of them with two of five insults, some of symbols."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(3000)])
    weight = 1 / np.arange(1, 3001)
    weight /= weight.sum()
    out = []
    for k in range(size):
        text = list(rng.choice(words, 200, p=weight))
        toxic, low = k % 10 == 3, k % 7 == 5
        if toxic:
            for at in rng.integers(0, 200, 2):
                text[at] = str(rng.choice(["scum", "fool", "moron", "clod", "dolt"]))
        if low:
            text = [w + "%%%" for w in text]
        out.append((k, " ".join(text), int(not low), int(toxic)))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus()
    docs = frame(spark, [(r[0], r[1]) for r in rows] + [(5004, None), (5005, ""), (5006, " \n"), (None, "scum w1 w2"), (7, rows[7][1])])
    docs = docs.withColumns({"toxic": F.lit("x"), "mean": F.lit(1), "best": F.lit(None).cast("int"), "copies": F.lit(3), "domain": F.lit("d")})
    labels = frame(spark, [(r[0], r[2], r[3]) for r in rows] + [(None, 1, 1), (5004, None, None), (5005, 1, 0), (5005, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, rows = labelled
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(rows) + 5
    truth = {r[0]: r[3] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    hits = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 200 and hits / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (5004, 5005, 5006)}
    assert len(blank) == 1 and blank.pop() < 0.3
    assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1


def plain_ratios(rows, labels):
    """doc_id to the log ratios of its words, from counts in dictionaries, as the docstring of the operator defines them."""
    words = {k: (t or "").lower().split() for k, t in rows}
    pairs = {k: list(zip(["", *w], w)) for k, w in words.items()}
    learned = [k for k in words if k in labels and zlib.crc32(str(k).encode()) % 4 < 2]
    stems = {k: {w[: toxicity.STEM] for w in words[k]} for k in words}

    def level(counts, spread):
        """Discounted parts, what is left for the next order, and the shared part of each entry."""
        total, docs = max(1, sum(counts.values())), Counter(x for k in words for x in spread[k])
        left = sum(min(n, toxicity.DISCOUNT) for n in counts.values()) / total
        every = sum(docs.values())
        return lambda x: max(counts[x] - toxicity.DISCOUNT, 0) / total, min(1, max(left, 1e-3)), lambda x: (docs[x] + 1) / (every + 1)

    def model(kind):
        mine = [k for k in learned if labels[k] == kind]
        joint = Counter(p for k in mine for p in set(pairs[k]))
        after = Counter(w for _, w in joint)
        stem_high, stem_left, stem_shared = level(Counter(x for k in mine for x in stems[k]), stems)
        high, left, shared = level(after, {k: set(words[k]) for k in words})
        heads, given = Counter(), Counter()
        for (before, _), n in joint.items():
            heads[before] += n
            given[before] += min(n, toxicity.DISCOUNT)

        def p(before, word):
            stem = word[: toxicity.STEM]
            lean = min(50, max(0.02, stem_high(stem) / stem_shared(stem) + stem_left))
            back = given[before] / heads[before] if heads[before] else 1
            own = max(joint[before, word] - toxicity.DISCOUNT, 0) / max(1, heads[before])
            return own + back * (high(word) + left * shared(word) * lean)

        return p

    toxic, ordinary = model(1), model(0)
    return {k: [math.log(toxic(*x)) - math.log(ordinary(*x)) for x in pairs[k]] for k in words}


def test_toxicity_models_equal_plain_counting(spark):
    draw = random.Random(5)
    pool = [f"{a}{b}" for a in ("insult", "stone", "river", "glass") for b in "abcdef"]
    rows, labels = [], {}
    for k in range(400):
        labels[k] = int(draw.random() < 0.4)
        weights = [3 if (w[0] == "i") == bool(labels[k]) else 1 for w in pool]
        rows.append((k, " ".join(draw.choices(pool, weights, k=draw.randint(1, 4)))))  # too short to count as copies
    rows += [(400, None), (401, ""), (402, " \t"), (403, "Insulta INSULTA unheard of"), (404, " ".join(draw.choices(pool, k=3000)))]
    docs = frame(spark, rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, frame(spark, list(labels.items()), "doc_id long, toxic int")).collect()}
    for k, ratios in plain_ratios(rows, labels).items():
        assert got[k]["mean"] == pytest.approx(sum(ratios) / len(ratios) if ratios else 0, abs=1e-9)
        assert got[k]["best"] == pytest.approx(max(ratios, default=0), abs=1e-9)


def test_toxicity_never_reads_held_out_labels(labelled):
    docs, labels, _ = labelled
    held = toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda with_labels: sorted((str(r["doc_id"]), round(r["score"], 9)) for r in toxicity.scored(docs, with_labels).collect())
    assert scores(labels) == scores(turned)


def test_models_without_labels_or_rows(labelled, no_docs):
    docs, labels, _ = labelled
    none = labels.where("false")
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert {r["rate"] for r in soft_mixing.rated(docs, none).collect()} == {1.0}
    assert toxicity.scored(no_docs, labels).count() == 0
    assert soft_mixing.rated(no_docs, labels).count() == 0
    assert language_id.identified(language_id.of_documents(no_docs)).count() == 0


def test_mixing_meets_targets(labelled):
    docs, labels, rows = labelled
    got = soft_mixing.rated(docs, labels, {"good": 0.6, "low": 0.3, "toxic": 0.05, "low_toxic": 0.05}).toPandas()
    posterior, tokens = np.stack(got["posterior"]), got["tokens"].to_numpy()
    assert np.allclose(posterior.sum(axis=1), 1) and (got["rate"] >= 0).all()
    reached = (posterior * (tokens * got["rate"].to_numpy())[:, None]).sum(axis=0) / tokens.sum()
    natural = (posterior * tokens[:, None]).sum(axis=0) / tokens.sum()
    wanted = np.array([0.6, 0.3, 0.05, 0.05])
    assert list(got["domains"][0]) == list(soft_mixing.DOMAINS)
    if got["miss"][0] <= soft_mixing.MISSED:
        assert np.abs(reached / wanted - 1).max() <= 0.011
    else:
        assert np.abs(reached - wanted).sum() < 0.25 * np.abs(natural - wanted).sum()
    truth = {r[0]: r for r in rows}
    kinds = list(soft_mixing.DOMAINS.values())
    hits = [kinds[p.argmax()][0] == truth[d][2] for d, p in zip(got["doc_id"], posterior) if d in truth]
    assert np.mean(hits) > 0.95
    assert (abs(got["copies"] - got["rate"]) < 1).all()


def test_mixing_meets_each_small_target(spark):
    rng = np.random.default_rng(2)
    p, tokens = rng.dirichlet([0.5, 0.3, 0.1, 0.05], 600), rng.integers(1, 500, 600)
    rows = spark.createDataFrame([(k, int(t), [float(x) for x in q]) for k, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, posterior array<double>")
    weights = np.array([0.9, 0.08, 0.015, 0.005])
    reached = lambda pull: (p * (tokens * np.clip(1 + p @ pull, 0, soft_mixing.MOST))[:, None]).sum(axis=0) / tokens.sum()
    assert np.abs(reached(soft_mixing.fitted_pull(rows, weights)) / weights - 1).max() > 0.1
    pull, miss = soft_mixing.closest_pull(rows, weights)
    assert abs(np.abs(reached(pull) / weights - 1).max() - miss) < 1e-6
    assert miss <= soft_mixing.MISSED


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_meets_the_registered_targets(spark, sf):
    """From the returned rates and posteriors, over the given tables; nearly all rows stay."""
    import warnings

    folder = f"/root/testdata/{sf}"
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = soft_mixing.rated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), strict=True).toPandas()
    posterior, tokens, rate = np.stack(got["posterior"]), got["tokens"].to_numpy(), got["rate"].to_numpy()
    reached = (posterior * (tokens * rate)[:, None]).sum(axis=0) / tokens.sum()
    wanted = np.array([soft_mixing.TARGETS[name] for name in got["domains"][0]])
    assert np.abs(reached / (wanted / wanted.sum()) - 1).max() <= soft_mixing.MISSED + 1e-9
    assert rate.max() <= soft_mixing.MOST and (rate == 0).mean() < 0.2
    assert 0.9 * len(got) < got["copies"].sum() < 1.1 * len(got)


def test_targets_out_of_reach_are_told(spark, labelled):
    docs, labels, _ = labelled
    with pytest.raises(ValueError, match="reach the targets"):
        soft_mixing.rated(docs, labels, {"good": 0.0001, "low": 0.0001, "toxic": 0.0001, "low_toxic": 0.9997}, strict=True)
    with pytest.warns(UserWarning, match="reach the targets"):
        got = soft_mixing.rated(docs, labels, {"good": 0.0001, "low": 0.0001, "toxic": 0.0001, "low_toxic": 0.9997})
    assert got.first()["miss"] > soft_mixing.MISSED and got.agg(F.max("rate")).first()[0] <= soft_mixing.MOST


def test_mixing_is_the_least_squares_optimum(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rng.integers(1, 500, 400)
    rows = spark.createDataFrame([(k, int(t), [float(x) for x in q]) for k, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, posterior array<double>")
    weights = np.array([0.85, 0.149, 0.001])
    pull = soft_mixing.fitted_pull(rows, weights)
    rate = np.maximum(0, 1 + p @ pull)
    total = tokens.sum()
    gradient = p @ ((p * (tokens * rate)[:, None]).sum(axis=0) - weights * total) / total + soft_mixing.RIDGE * (rate - 1)
    assert (rate == 0).any() and rate.max() < soft_mixing.MOST
    assert np.abs(gradient[rate > 0]).max() < 1e-5 and gradient[rate == 0].min() > -1e-5


def test_mixed_rows_keep_their_columns(labelled):
    docs, labels, _ = labelled
    out = soft_mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in soft_mixing.rated(docs, labels).collect()}
    seen = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(seen.get(d, 0) == n * (2 if d == 7 else 1) for d, n in copies.items())


def test_languages_of_documents(spark, docs):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identified(language_id.of_documents(given)).withColumnRenamed("id", "doc_id").join(given, "doc_id").collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.98
    assert np.mean([r["text_language"] == r["lang"] for r in got]) > 0.95
    odd = {r["id"]: r for r in language_id.identified(language_id.of_documents(docs)).collect()}
    assert not any(odd[d]["accepted"] for d in (5004, 5005, 5006))
    assert odd[5004]["text_language"] is None and odd[5000]["language"] == "en"


def test_languages_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = language_id.of_pages(pages)
    wrong = rows.where("id = 3").withColumns({"declared": F.lit("en-GB"), "id": F.lit(-1)})
    bare = rows.where("id < 3").withColumns({"declared": F.lit(None).cast("string"), "address": F.lit(None).cast("string"), "id": -2 - F.col("id")})
    got = {r["id"]: r for r in language_id.identified(rows.union(wrong).union(bare)).collect()}
    truth = {r["id"]: r["declared"] for r in rows.collect()}
    assert np.mean([got[i]["language"] == truth[i] for i in truth]) > 0.95
    assert got[-1]["text_language"] == truth[3]
    assert all(got[-2 - i]["language"] == truth[i] for i in range(3))


def test_host_prior_decides_a_short_text(spark):
    rows = [(k, "der die das und nicht mit " * 20, "de", "http://a.example.de/x") for k in range(60)]
    rows += [(100 + k, "le la les et pas avec " * 20, "fr", "http://b.example.fr/x") for k in range(60)]
    rows += [(900, "x", None, "http://a.example.de/y"), (901, "x", None, "http://new.example.fr"), (902, None, "FR", None), (903, "7", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, address string")
    got = {r["id"]: r for r in language_id.identified(df).collect()}
    assert got[900]["language"] == "de" and got[901]["language"] == "fr" and got[902]["language"] == "fr"
    assert not got[902]["accepted"] and not got[903]["accepted"]


def test_many_and_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLED", 200)
    rng = np.random.default_rng(4)
    names = [f"{a}{b}" for a in "pqrstuvw" for b in "abcdefghij"]
    words = {n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for n in names}
    text = lambda n: " ".join(rng.choice(words[n], 60))
    rows = [(k, text(names[0]), names[0], None) for k in range(2000)]
    rows += [(10_000 + 100 * i + j, text(n), n, None) for i, n in enumerate(names[1:]) for j in range(4)]
    rows += [(50_000 + i, text(n), None, None) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, address string").repartition(4)
    got = {r["id"]: r["text_language"] for r in language_id.identified(df).collect()}
    assert [got[50_000 + i] for i in range(len(names))] == names


def test_no_declared_language(spark):
    df = spark.createDataFrame([(1, "some text", None, "h")], "id long, text string, declared string, address string")
    row = language_id.identified(df).first()
    assert row["language"] is None and not row["accepted"]


@pytest.mark.parametrize("address,parts", [
    ("https://www.thering.example.org/de/1.html", ("www.thering.example.org", "example.org", "org")),
    ("src7", ("src7", None, None)), ("http://u:p@Host.NET:80/?q", ("host.net", "host.net", "net")), ("", (None, None, None)), (None, (None, None, None)),
])
def test_parts_of_an_address(spark, address, parts):
    df = spark.createDataFrame([(address,)], "a string")
    assert tuple(df.select(*language_id.parts_of(F.col("a"))).first()) == parts
