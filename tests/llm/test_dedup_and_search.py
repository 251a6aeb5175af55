"""Near duplicates, repeats, fingerprints and neighbours against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from armlift.llm import near, neighbours, repeats
from armlift.llm.bwt import merge, transform
from armlift.llm.components import components
from armlift.llm.fingerprints import fingerprints
from tests.conftest import SMALL, by

SCHEMA = "doc_id bigint, text string, class string, band string, k1 string"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (6, "one two"), (None, "one two"), (7, "y " * 30_000)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "b", "k") for r in rows], SCHEMA)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500 + i, 500 + (i + 1) % 7) for i in range(7)]
    links += [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(90)] + [(2000, 2000)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in found} == roots(nodes, [x for x in links if x[0] != x[1]]) and len(found) == len(nodes)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def plain_groups(rows, width):
    sets = {d: shingles(t, width) for d, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return sets, roots(ids, links)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_are_those_of_all_pairs(spark, width):
    rnd = random.Random(width)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(300))
    base = [word() for _ in range(60)]
    for i in range(120):  # a family around one text, from close copies to strangers
        copy = [w if rnd.random() > rnd.choice((0.01, 0.05, 0.1, 0.2)) else word() for w in base]
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000 + i, " ".join("abcdefghij"[: i + 1])) for i in range(10)]  # tiny sets around the threshold
    sets, groups = plain_groups(rows, width)
    found = by(near.near_duplicates(table(spark, rows), width).collect(), "doc_id")
    assert {d: r["component_id"] for d, r in found.items()} == groups
    assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (d == groups[d]) for d, r in found.items())


def test_near_duplicates_of_odd_tables(spark):
    assert near.near_duplicates(table(spark, [])).collect() == []
    found = near.near_duplicates(table(spark, ODD), 2).collect()
    assert len(found) == len(ODD)
    assert all(r.component_id == r.doc_id and r.kept for r in found if r.doc_id in (1, 2, 3, 7))
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id in (4, 5)} == {(4, 4), (5, 4)}
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found if r.doc_id in (6, None)) == {(6, 6, True): 2, (None, 6, False): 1}


def test_minima_and_maxima_estimate_the_similarity():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    one, two = (near.signature(np.unique(np.concatenate([shared, x])), near.FINE_FACTORS, near.FINE_SHIFTS) for x in (a, b))
    for x, y in zip(one, two):
        assert abs(np.mean(x == y) - 0.8) < 0.06


def test_transforms_merge_to_the_order_of_all_suffixes():
    rnd = random.Random(2)
    for _ in range(60):
        codes = rnd.choice((2, 50))
        shards = [[[rnd.randint(1, codes) for _ in range(rnd.randint(1, 7))] for _ in range(rnd.randint(1, 3))] for _ in range(4)]
        symbols, suffixes, befores = [], [], []
        for strings in shards:
            flat = np.array([s for x in strings for s in [*x, 0]])
            starts = np.cumsum([0] + [len(x) + 1 for x in strings[:-1]])
            order, before = transform(flat, starts)
            suffixes.append(order + len(symbols))
            befores.append(before)
            symbols += flat.tolist()
        order, common = merge(befores, 30)
        listed = [symbols[i : symbols.index(0, i) + 1] for i in np.concatenate(suffixes)[order]]
        assert listed == sorted(listed)
        for k in range(1, len(listed)):
            a, b = listed[k - 1], listed[k]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == same if a != b else common[k] >= same


def plain_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for (doc, _), text in zip(rows, texts):
        gone = [False] * len(text)
        for i in range(len(text) - length + 1):
            if times[text[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield (doc is None, doc or 0, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def repeat_rows():
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))
    passage, line = letters(400), letters(110)
    rows = []
    for i in range(60):
        a = rnd.randrange(0, 300)
        parts = [letters(rnd.randrange(0, 200)), passage[a : a + rnd.randrange(60, 300)], letters(rnd.randrange(0, 120))]
        if i % 3 == 0:
            parts.append(line)
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 150), (101, "x" * 400), (102, "\0" * 130 + letters(90)), (103, "\0" * 97), (None, passage), (104, passage)]
    return rows + [(105, None), (106, ""), (107, letters(95)), (107, letters(95))]


@pytest.mark.parametrize("many, shard", [(20_000, 100_000), (3, 100_000), (20_000, 50)])
def test_repeats_are_those_of_all_windows(spark, monkeypatch, many, shard):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "SHARD_SYMBOLS", shard)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 40_000)
    rows = repeat_rows()
    found = repeats.remove_repeats(table(spark, rows), 96).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in found) == sorted(plain_repeats(rows, 96))


def test_repeats_of_odd_tables(spark):
    assert repeats.remove_repeats(table(spark, [])).collect() == []
    found = repeats.remove_repeats(table(spark, ODD)).collect()
    assert sorted(r.n_removed for r in found) == [0] * (len(ODD) - 1) + [60_000]


def test_what_is_left_can_be_read_from_the_result(spark, tmp_path):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    passage, copy = words(90), words(80)
    assert len(passage.encode()) >= 400 and len(copy.encode()) >= 400
    rows = [(i, f"{words(30)} é{passage}ê {words(20)}") for i in range(3)] + [(3, words(100)), (4, copy), (4, copy), (5, None)]
    # the last byte of a character is the same here and there, the first is not: the cut goes through it
    rows += [(6, f"{words(4)} \u00e9{'z' * 399}"), (7, f"{words(4)} \u0129{'z' * 399}")]
    texts = {i: (t or "").encode() for i, t in rows}
    starts = Counter(t[a : a + 400] for _, t in ((i, (t or "").encode()) for i, t in rows) for a in range(len(t) - 399))
    found = repeats.without_repeats(table(spark, rows)).collect()
    assert len(found) == len(rows)
    kept = {}
    for r in found:
        text = texts[r.doc_id]
        gone = {b for a in range(len(text) - 399) if starts[text[a : a + 400]] > 1 for b in range(a, a + 400)}
        kept[r.doc_id] = bytes(b for i, b in enumerate(text) if i not in gone)
        assert (r.n_bytes, bytes(r.kept)) == (len(text), kept[r.doc_id])
        assert {b for s in r.spans for b in range(s.start, s.end)} == gone
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert kept[4] == b"" and kept[3] == texts[3] and kept[6][-1] == 0xC3
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for r in repeats.op10_remove_repeats(spark, str(tmp_path)).collect():
        assert r.text == kept[r.doc_id].decode(errors="replace") and (passage not in r.text)
        assert (r.n_removed, r.kept_sha256) == (len(texts[r.doc_id]) - len(kept[r.doc_id]), hashlib.sha256(kept[r.doc_id]).hexdigest())


def test_fingerprints_of_edited_and_next_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    found = by(fingerprints(docs).collect(), "doc_id")
    known = {}
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        quarter, r = len(text) // 4, found[doc]
        edited = text[: len(text) - quarter] + following[:quarter]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert known.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if edited == text:
            assert r["edited_fingerprint"] == r["fingerprint"] and r["near_edited"] == 1
        assert (r["near_next"] == 1) == (text == following) or text[:50] == following[:50]
    assert np.mean([r["near_edited"] for r in found.values()]) > 0.4
    assert np.mean([r["near_next"] for r in found.values()]) < 0.02


def test_an_edited_text_has_the_fingerprint_of_that_text(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(80)) for _ in range(40)]
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, texts[1:] + texts[:1])]
    first = table(spark, [(i, t) for i, t in enumerate(texts)])
    # the same lexicon for both: every text and every edited text once
    both = table(spark, [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(edited)])
    found = by(fingerprints(both, (0.0, 1.0)).collect(), "doc_id")
    again = by(fingerprints(first, (0.0, 1.0)).collect(), "doc_id")
    # with every term of two texts or more in the lexicon, texts made of common terms agree
    same = [found[1000 + i]["fingerprint"] == again[i]["edited_fingerprint"] for i in range(40)]
    assert np.mean(same) > 0.5


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints(table(spark, [])).collect() == []
    found = fingerprints(table(spark, ODD)).collect()
    assert len(found) == len(ODD)
    prints = defaultdict(set)
    for r, in [(r,) for r in found]:
        prints[r.doc_id].add(r.fingerprint)
    assert prints[6] == prints[None] and prints[1] == prints[2] and all(len(p) == 1 for p in prints.values())
    one = fingerprints(table(spark, [(1, "a b c d")])).first()
    assert one.near_next == 1 and one.n_chars == 7


@pytest.mark.parametrize("changed", [0, 0.2])
def test_fingerprints_of_a_group_of_a_third_of_all_rows(spark, changed):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(300))
    template = [f"t{i}" if changed else word() for i in range(100)]
    rows = [(i, " ".join(word() for _ in range(100))) for i in range(400)]
    rows += [(1000 + i, " ".join(word() if rnd.random() < changed else w for w in template)) for i in range(200)]
    found = by(fingerprints(table(spark, rows)).collect(), "doc_id")
    group = [found[1000 + i] for i in range(199)]
    assert np.mean([r["near_edited"] for r in group]) > 0.4
    # two of the group have some 0.64 of their words in common, 0.47 of those that either has
    assert np.mean([r["near_next"] for r in group]) > 0.3
    assert np.mean([found[i]["near_next"] for i in range(399)]) < 0.05
    # a copied group counts as one text, so the rare words it uses stay in the lexicon
    assert changed or all(not r["fingerprint"].startswith("all:") for r in found.values())


def test_fingerprints_of_words_no_other_text_has(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(100))) for i in range(30)]
    found = fingerprints(table(spark, rows)).collect()
    assert np.mean([r.near_edited for r in found]) > 0.4 and max(r.near_next for r in found) < 0.1


def vectors_of(rows):
    ids = np.array([i for i, _ in rows])
    return ids, np.array([v for _, v in rows], float)


def plain_nearest(ids, vectors, query, k):
    scores = (vectors * vectors[ids == query][0]).sum(axis=1)
    order = np.lexsort([ids, -scores])
    return [int(ids[i]) for i in order if ids[i] != query][:k]


def test_neighbours_reach_the_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    ids, vectors = vectors_of(rows)
    found = defaultdict(list)
    for r in neighbours.op6_nearest_neighbours(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for query, near_rows in found.items():
        hits += len({r.vec_id for r in near_rows} & set(plain_nearest(ids, vectors, query, 20)))
        assert [r["rank"] for r in near_rows] == list(range(1, 21))
        exact = (vectors[np.searchsorted(ids, [r.vec_id for r in near_rows])] * vectors[ids == query][0]).sum(axis=1)
        assert np.allclose([r.score for r in near_rows], exact, rtol=1e-12)
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_of_a_common_vector_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    usable = neighbours.usable(df)
    found = by(neighbours.search(usable, usable.where("vec_id % 20 = 0"), k=7).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("n")).collect(), "query_id")
    ids, vectors = vectors_of(rows)
    hits = sum(len({x.vec_id for x in r["n"]} & set(plain_nearest(ids, vectors, q, 7))) for q, r in found.items())
    assert len(found) == 30 and hits >= 0.9 * 7 * 30
    # all ties of the common vector go to the smallest ids
    best = plain_nearest(ids, vectors, 60, 7)
    assert [x.vec_id for x in found[60]["n"]] == best


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    usable = neighbours.usable(df)
    found = neighbours.search(usable, usable.where("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 20), (20, 1, 0)]
    none = neighbours.usable(df.limit(0))
    assert neighbours.search(none, none).collect() == []
