"""Suffix deduplication, repetition rules, Jaccard join and compact windows against brute force."""

import collections
import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import compact_windows, jaccard_join, jobs, packed, repetition, suffix_dedup
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]


def removed_by_force(rows):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        for i in range(len(data) - 99):
            first.setdefault(data[i : i + 100], (doc, i))
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 99):
            if first[data[i : i + 100]] != (doc, i):
                gone[i : i + 100] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def removed(texts):
    return removed_by_force(texts)


@pytest.mark.parametrize("blocks", [1, 3])
def test_suffix_dedup(docs, removed, blocks):
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.deduplicated(docs, blocks).collect()}
    assert got == removed
    assert sum(v[1] > 0 for v in removed.values()) > 20


def test_suffix_dedup_repeated_and_nameless_rows(spark):
    long = "".join(map(chr, np.random.default_rng(9).integers(97, 123, 300)))
    rows = [(1, long), (1, long), (None, long), (2, long), (None, None)]
    got = sorted(map(str, (tuple(r)[:3] for r in suffix_dedup.deduplicated(frame(spark, rows)).collect())))
    assert got == sorted(map(str, [(1, 300, 0), (1, 300, 0), (None, 300, 0), (2, 300, 300), (None, 0, 0)]))


def test_suffix_order_keeps_equal_prefixes_together():
    rng = np.random.default_rng(5)
    strings = [rng.integers(97, 99, 400).astype(np.uint8) for _ in range(4)]
    strings += [strings[0], np.concatenate([strings[1][7:], strings[2][:50]]), np.full(300, 97, np.uint8)]
    data, bounds = np.concatenate(strings), np.append(0, np.cumsum([len(s) for s in strings]))
    starts = np.concatenate([np.arange(a, b - suffix_dedup.LENGTH + 1) for a, b in zip(bounds, bounds[1:])])
    order = suffix_dedup.suffix_order(data, bounds, starts)
    assert sorted(order) == sorted(starts)
    heads = [data[i : i + suffix_dedup.LENGTH].tobytes() for i in order]
    assert heads == sorted(heads)


def test_long_texts_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packed, "PIECE", 1 << 10)
    rng = np.random.default_rng(1)
    base = "".join(map(chr, rng.integers(97, 123, 9000)))
    rows = [(1, base), (2, "!" * 50 + base[3000:7000] + "?" * 50), (3, base[:4000])]
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.deduplicated(frame(spark, rows)).collect()}
    assert got == removed_by_force(rows)


def test_repetition(docs, texts):
    def by_force(text):
        words = WORD.findall(text or "")
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        spans = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        longest = 0
        while spans and longest < 200:
            size = max(5, longest + 1)
            if max(collections.Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)).values(), default=0) < 2:
                break
            longest = size
        failed = len(words) < 10 or 100 * len(spans) > 20 * len(words)
        symbols = sum((text or "").count(c) for c in "#*$%&|<>")
        return len(words), sum(map(len, words)), symbols, dup, len(spans), sum(len(words[i]) for i in spans), longest, failed

    got = {r[0]: r for r in repetition.judged(docs).collect()}
    assert len(got) == len(texts)
    for doc, text in texts:
        want = by_force(text)
        mine = tuple(got[doc])[1:9]
        assert mine[:6] + mine[7:] == want[:6] + want[7:], doc
        assert min(mine[6], 200) == want[6], doc
        assert not (want[7] and got[doc]["kept"])
    assert got[5000]["longest_repeat"] == 4999 and not got[5000]["kept"]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, texts, width, percent):
    words = [f"v{k}" for k in range(400)]
    rng = np.random.default_rng(2)
    family = []
    for k in range(60):  # copies of one text with more and more words changed, chained by their likeness
        copy = list(words)
        for at in rng.integers(0, 400, k // 3):
            copy[at] = f"e{k}_{at}"
        family.append((6000 + k, " ".join(copy)))
    rows = texts + family

    def shingles(text):
        found = lowered(text)
        if not found:
            return frozenset()
        return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))

    sets = [(doc, shingles(text)) for doc, text in rows]
    parent = {doc: doc for doc, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, links = collections.defaultdict(list), 0
    for number, (doc, mine) in enumerate(sets):
        shared = collections.Counter(j for s in mine for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(mine) + len(sets[j][1]) - n):
                a, b = sorted((find(doc), find(sets[j][0])))
                parent[b] = a
                links += 1
        for s in mine:
            holders[s].append(number)
    df = docs.select("doc_id", "text", "bucket", "root").unionByName(frame(spark, family), allowMissingColumns=True)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.linked(df, width, percent).collect()}
    assert got == {doc: (len(mine), find(doc)) for doc, mine in sets}
    assert links > 50


def test_jaccard_splits_families(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    words = [f"v{k}" for k in range(300)]
    rows = [(k, " ".join(words[:k] + ["x"] + words[k + 1 :])) for k in range(40)] + [(None, "a b c")]
    got = {r[0]: r[2] for r in jaccard_join.linked(frame(spark, rows), 3, 90).collect()}
    assert got == {**{k: 0 for k in range(40)}, None: None}


def test_components(spark, rows):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 90), (90, 95), (7, 7)] + [(200, 200 + k) for k in range(1, 40)]
    got = rows(jobs.components(spark.createDataFrame(edges, "a long, b long")))
    want = [(k, 0) for k in range(31)] + [(k, 90) for k in (90, 95, 100)] + [(200 + k, 200) for k in range(40)]
    assert got == sorted(want, key=repr)
    assert jobs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows_are_the_cartesian_tree(monkeypatch):
    monkeypatch.setattr(compact_windows, "LEAST", 4)
    rng = np.random.default_rng(7)
    tokens, bounds = rng.integers(0, 1 << 62, 70).astype(np.uint64), np.array([0, 3, 3, 40, 70])
    rows, found = compact_windows.compact_windows(tokens, bounds)
    got = sorted(zip(rows, found["function"], found["left"], found["pivot"], found["right"]))
    want = []
    for f in range(compact_windows.FUNCTIONS):
        hashes = packed.mix(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) % (1 << 64)))
        for row in range(4):
            values = hashes[bounds[row] : bounds[row + 1]].tolist()
            for c, value in enumerate(values):
                left = max([k + 1 for k in range(c) if values[k] < value], default=0)
                right = min([k - 1 for k in range(c + 1, len(values)) if values[k] < value], default=len(values) - 1)
                if right - left + 1 >= 4:
                    want.append((row, f, left, c, right))
    assert got == sorted(want)


def test_passages(spark, docs, texts):
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    passage, edited = fresh(80), None
    edited = list(passage)
    edited[40] = "changed"
    planted = [(7000 + k, " ".join(fresh(60) + (edited if k == 3 else passage) + fresh(90))) for k in range(4)]
    planted += [(7100, " ".join(fresh(300))), (7101, " ".join(fresh(40) + passage[:20] + fresh(100))), (None, " ".join(passage))]
    df = docs.select("doc_id", "text", "start", "end").unionByName(frame(spark, planted), allowMissingColumns=True)
    got = compact_windows.passages(df).collect()
    found = {r.doc_id for r in got} | {r.other_doc_id for r in got}
    assert {7000, 7001, 7002, 7003} <= found and not {7100, 7101, None} & found

    words = {doc: lowered(text) for doc, text in texts + planted}
    shared = collections.defaultdict(set)
    for doc, mine in words.items():
        for i in range(len(mine) - 54):
            shared[tuple(mine[i : i + 55])].add(doc)
    copies = set().union(*(v for v in shared.values() if len(v - {None}) > 1)) - {None}
    assert copies <= found
    for r in got:
        cut = lambda doc, start, n: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(words[doc][start : start + n])
        a, b = cut(r.doc_id, r.start_word, r.n_words), cut(r.other_doc_id, r.other_start_word, r.other_n_words)
        assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_passages_whose_earliest_relative_is_a_variant(spark):
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, pairs = [], []
    for k in range(20):
        passage = fresh(56)
        variants = [list(passage) for _ in range(2)]
        for at in (20, 38):
            variants[0][at] = "changed"
        variants[0][5] = "changed"
        variants[1][45:] = fresh(11)  # a fragment of 45 words
        rows += [(10 * k + j, " ".join(fresh(40) + part + fresh(40))) for j, part in enumerate([variants[k % 2], passage, passage])]
        rows += [(10 * k + 3 + j, " ".join(fresh(30) + part + fresh(30))) for j, part in enumerate([variants[(k + 1) % 2], passage])]
        pairs += [{10 * k + 1, 10 * k + 2, 10 * k + 4}]
    got = compact_windows.passages(frame(spark, rows)).collect()
    found = [{r.doc_id, r.other_doc_id} for r in got]
    for copies in pairs:
        assert copies <= set().union(*(f for f in found if f <= copies)), copies


def test_passages_whose_hub_accepts_them_are_paired(spark):
    rng = np.random.default_rng(13)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, want = [], set()
    for k in range(8):  # one edit each against the earliest, which is similar enough to all of them
        passage = fresh(100)
        for j in range(4):
            part = list(passage)
            if j:
                part[20 * j] = f"edit{k}x{j}"
            rows.append((10 * k + j, " ".join(fresh(40) + part + fresh(40))))
        want |= {(10 * k + j, 10 * k + i) for j in range(4) for i in range(j)}
    got = compact_windows.passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.other_doc_id) for r in got} == want
    assert {(r.doc_id, r.class_id) for r in got} == {(10 * k + j, 10 * k) for k in range(8) for j in range(1, 4)}


def test_hot_passages_are_one_class(spark):
    rng = np.random.default_rng(17)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    passage, other = fresh(70), " ".join(fresh(60))
    rows = [(k, " ".join(fresh(30) + passage[:35] + ([f"e{k}"] if k % 3 else []) + passage[35:] + fresh(30))) for k in range(3 * compact_windows.LIMIT)]
    rows += [(1000 + k, other if k % 2 else other.upper()) for k in range(3 * compact_windows.LIMIT)]
    got = compact_windows.passages(frame(spark, rows)).collect()
    for start, last in ((0, 3 * compact_windows.LIMIT), (1000, 1000 + 3 * compact_windows.LIMIT)):
        assert {r.doc_id for r in got if r.class_id == start} == set(range(start + 1, last))
    copies = [r for r in got if r.doc_id > 1000]
    assert {(r.start_word, r.n_words, r.other_doc_id, r.similarity) for r in copies} == {(0, 60, 1000, 1.0)} and len(copies) == 3 * compact_windows.LIMIT - 1


def test_all_pairs_of_a_hot_passage_are_rows(spark, monkeypatch):
    """A passage that more texts have than a group may have windows: every two of them are a row, also those that the earliest one refuses."""
    monkeypatch.setattr(compact_windows, "LIMIT", 8)
    monkeypatch.setattr(compact_windows, "TILE", 5)
    monkeypatch.setattr(compact_windows, "LINKS", 7)
    rng = np.random.default_rng(31)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    passage, n = fresh(120), 23
    part = [list(passage) for _ in range(n)]
    part[0][70:] = fresh(50)  # the earliest has a little more than half of it
    rows = [(k, " ".join(fresh(30) + part[k] + fresh(30))) for k in range(n)]
    got = compact_windows.passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.other_doc_id) for r in got} == {(j, i) for j in range(n) for i in range(j)}
    whole = {(r.doc_id, r.other_doc_id) for r in got if r.n_words >= 110}
    assert whole == {(j, i) for j in range(n) for i in range(1, j)}
    assert {r.class_id for r in got} == {0}


def test_similar_runs_by_force():
    rng = np.random.default_rng(19)
    parts = []
    for _ in range(60):
        a = rng.integers(0, 1 << 32, 150)
        b = np.delete(a.copy(), rng.integers(0, 150, int(rng.integers(0, 8))))
        b[rng.integers(0, len(b), int(rng.integers(0, 12)))] = 5
        parts += [a, np.concatenate([rng.integers(0, 1 << 32, 9), b])]
    size = np.array([len(x) for x in parts])
    start = np.cumsum(size) - size
    tokens = np.concatenate(parts)
    of, first, last, other, stop, similarity = compact_windows.similar_runs(tokens, start[::2], size[::2], start[1::2], size[1::2], np.full(60, 9))
    assert len(set(of.tolist())) > 20 and (last - first >= compact_windows.SHORTEST).all() and (similarity >= compact_windows.SIMILAR).all()
    for k, i, j, x, y, s in zip(of, first, last, other, stop, similarity):
        a, b = set(parts[2 * k][i:j].tolist()), set(parts[2 * k + 1][x:y].tolist())
        assert abs(len(a & b) / len(a | b) - s) < 1e-12


def test_passages_at_different_shifts(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, want = [], []
    for k in range(6):
        long, short = fresh(200), fresh(110)
        between = [fresh(90), fresh(30), None][k % 3]
        hub = short + long if between is None else long + between + short
        rows += [(10 * k, " ".join(fresh(20) + hub + fresh(20))), (10 * k + 1, " ".join(fresh(20) + long + short + fresh(20)))]
        want += [(10 * k + 1, 20, 220), (10 * k + 1, 220, 330)]
    got = compact_windows.passages(frame(spark, rows)).collect()
    for doc, start, end in want:
        covered = {w for r in got if r.doc_id == doc for w in range(r.start_word, r.start_word + r.n_words)}
        assert len(covered & set(range(start, end))) > 0.85 * (end - start), (doc, start, end)


def bucket_of(rng, n, rows=8, docs=2000):
    """The table of one bucket as ``_scan`` makes it: entries with repeated keys, some hot, and whole texts with copies."""
    batches = []
    for _ in range(rows):
        entry = np.zeros(n // rows, compact_windows.ENTRY)
        entry["key"] = packed.mix(rng.integers(0, n // 3, len(entry)).astype(np.uint64))
        entry["key"][:100] = 7
        entry["far"], entry["pivot"] = rng.integers(0, 9, len(entry)), rng.integers(0, 5000, len(entry))
        entry["back"], entry["ahead"] = rng.integers(0, 90, len(entry)), rng.integers(0, 90, len(entry))
        entry["owner"], entry["function"] = rng.integers(0, docs, len(entry)), entry["key"] % np.uint64(compact_windows.FUNCTIONS)
        ids = rng.integers(0, 50_000, docs)
        whole = np.zeros(40, compact_windows.WHOLE)
        whole["doc"], whole["same"], whole["size"] = rng.integers(0, 50_000, 40), rng.integers(0, 30, 40), 60
        pairs = np.stack([ids, ids // 2], axis=1).ravel()
        for held, part, copies in ((pairs, entry.tobytes(), b""), ([], b"", whole.tobytes())):
            columns = [pa.array([held], pa.list_(pa.int64())), pa.array([part], pa.binary()), pa.array([copies], pa.binary())]
            batches.append(pa.RecordBatch.from_arrays(columns, names=["docs", "entries", "wholes"]))
    return pa.Table.from_batches(batches).combine_chunks()


def links_of(table):
    return np.concatenate([np.frombuffer(x.as_buffer(), compact_windows.LINK) for x in table.column("links")])


def test_a_bucket_is_linked_in_slices_with_little_beside_it():
    table = bucket_of(np.random.default_rng(23), 1 << 19)
    tracemalloc.start()
    got = compact_windows._link_bucket(table, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * table.nbytes, (peak, table.nbytes)
    doc, same, entry = [], [], []
    for row in table.to_pylist():
        mine = np.frombuffer(row["entries"], compact_windows.ENTRY)
        ids = np.array(row["docs"], np.int64)
        doc.append(ids[2 * mine["owner"].astype(int)])
        same.append(ids[2 * mine["owner"].astype(int) + 1])
        entry.append(mine)
    whole = np.concatenate([np.frombuffer(row["wholes"], compact_windows.WHOLE) for row in table.to_pylist()])
    want = np.concatenate([compact_windows.linked(*map(np.concatenate, (doc, same, entry))), compact_windows._equal_texts(whole)])
    assert len(want) > 100_000 and len(want[want["function"] == compact_windows.EQUAL]) > 200
    assert np.array_equal(np.sort(links_of(got)), np.sort(want))


def test_links_of_a_part_are_joined_in_slices(monkeypatch):
    rng = np.random.default_rng(29)
    link = np.zeros(30_000, compact_windows.LINK)
    link["doc"], link["hub"] = rng.integers(100, 200, 30_000), rng.integers(0, 40, 30_000)
    link["start"], link["function"] = rng.integers(0, 900, 30_000), rng.integers(0, compact_windows.EQUAL + 1, 30_000)
    link["other"], link["size"] = link["start"] + rng.integers(0, 20, 30_000), rng.integers(46, 90, 30_000)
    rows = pa.array([link[i : i + 1000].tobytes() for i in range(0, 30_000, 1000)], pa.binary())
    table = pa.Table.from_batches([pa.RecordBatch.from_arrays([part], names=["links"]) for part in (rows[:10], rows[10:])])
    whole = sorted(map(repr, compact_windows._interval_join(table).to_pylist()))
    parts = []
    agreeing = compact_windows._agreeing
    monkeypatch.setattr(compact_windows, "_agreeing", lambda link: parts.append(len(link)) or agreeing(link))
    monkeypatch.setattr(compact_windows, "LINKS", 2000)
    assert sorted(map(repr, compact_windows._interval_join(table).to_pylist())) == whole and len(whole) > 4000
    assert sum(parts) == 30_000 and len(parts) > 10 and max(parts) < 4000


def test_empty_tables(no_docs):
    assert suffix_dedup.deduplicated(no_docs).count() == 0
    assert repetition.judged(no_docs).count() == 0
    assert jaccard_join.linked(no_docs).count() == 0
    assert compact_windows.passages(no_docs).count() == 0
