"""Ranked search, vector links and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from armlift.llm import caps, search, spelling, tiles
from tests.conftest import SMALL, by
from tests.llm.test_dedup_and_search import roots

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    found = []
    for item, text in sorted(set(items), key=str):
        if text is None:
            continue
        scores = []
        for d, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms_of(text)
                if t in c
            )
            scores += [(-score, d is None, d)] * (score > 0)
        found += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(found, key=str)


def ranking_rows(seed=3):
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.expovariate(0.05))}"
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(100)]  # a third of the rows are one text
    docs += [(500, None), (501, ""), (502, " .,\n"), (503, "Ünï w1 ünï W1"), (None, "w1 w2"), (503, "w1"), (504, "w3 " * 30_000)]
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 120)))) for i in range(30)]
    items += [(31, None), (32, "..."), (33, "w1 w1 w2"), (33, "w1 w1 w2"), (33, "w3"), (34, "nowhere"), (None, "w5 Ünï")]
    return docs, items


DOC = "doc_id bigint, text string, n bigint, slots string, item string, score string"
ITEM = "item_id bigint, text string, block string"


@pytest.mark.parametrize("sizes", [None, (16, 40, 64, 4)])
def test_ranking_is_that_of_all_pairs(spark, monkeypatch, sizes):
    docs, items = ranking_rows()
    if sizes:  # small blocks of documents, entries and items
        for name, size in zip(("BLOCK_DOCS", "BLOCK_ENTRIES", "MASK_CELLS", "STEP_DOCS"), sizes):
            monkeypatch.setattr(search, name, size)
        monkeypatch.setattr(search, "BLOCK_CHARS", 2000)
    df = spark.createDataFrame([(*d, 0, "s", "i", "x") for d in docs], DOC).repartition(3)
    found = search.search(df, spark.createDataFrame([(*i, "b") for i in items], ITEM), 7).collect()
    # two texts under one id share the id's ranks
    assert sorted(map(tuple, found), key=str) == plain_ranking(docs, items, 7)


def test_ranking_of_empty_tables(spark):
    docs, items = ranking_rows()
    df, asked = spark.createDataFrame([(*d, 0, "", "", "") for d in docs], DOC), spark.createDataFrame([(*i, "b") for i in items], ITEM)
    assert search.search(df.limit(0), asked).collect() == []
    assert search.search(df, asked.limit(0)).collect() == []
    assert search.search(df.where("doc_id = 500"), asked).collect() == []


def test_later_masks_are_left_out_safely():
    # the bound of a mask is never below a score of its documents
    import pyarrow as pa

    rng = np.random.default_rng(4)
    lists = [np.sort(rng.choice(12, rng.integers(1, 9), replace=False)).tolist() for _ in range(400)]
    rows = pa.table({
        "doc_id": pa.array(range(400)), "n": pa.array(rng.integers(9, 300, 400)),
        "slots": pa.array(lists, pa.list_(pa.int32())), "tfs": pa.array([rng.integers(1, 9, len(x)).tolist() for x in lists], pa.list_(pa.int32())),
    })
    block = search.Block(rows, rng.integers(0, 5000, 12), 400, 60_000)
    times, slots = np.zeros(12, np.int64), np.array([1, 4, 5, 9])
    times[slots] = [1, 2, 1, 3]
    best, evaluated = search.Best(5), []
    whole = block.scores
    block.scores = lambda docs, t: evaluated.extend(docs) or whole(docs, t)
    search.STEP_DOCS, kept = 8, search.STEP_DOCS
    block.search(0, slots, times[slots], times, best)
    search.STEP_DOCS = kept
    scores = whole(np.arange(400), times)
    order = np.lexsort([np.arange(400), -scores])[:5]
    assert best.kept[0][1].tolist() == order.tolist() and best.kept[0][0].tolist() == scores[order].tolist()
    assert len(evaluated) < 200 and len(set(evaluated)) == len(evaluated)


# --- vectors


def plain_links(rows, least=0.93):
    ids = list(range(len(rows)))
    good = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(v)
    links = [
        (a, b) for a in good for b in good
        if a != b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least
    ]
    root = roots(ids, links)
    members = defaultdict(list)
    for i in ids:
        members[root[i]].append(rows[i][0])
    least_id = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    n = Counter(a for a, _ in links)
    return Counter((rows[i][0], n[i], least_id[root[i]], rows[i][0] == least_id[root[i]]) for i in ids)


VECTOR = "vec_id bigint, embedding array<double>, label int, class string, filter string, links string"


def vector_rows(length=64, seed=2):
    rng, rows = np.random.default_rng(seed), []
    rows += [(int(i), rng.standard_normal(length).tolist(), int(i % 3)) for i in range(200)]
    base = rng.standard_normal(length)
    for i in range(150):  # near copies of one vector, on both sides of the threshold
        noise = rng.standard_normal(length) * rng.choice([0.02, 0.2, 0.35])
        rows.append((1000 + i, ((base + noise) * rng.choice([0.001, 1, 50])).tolist(), 1))
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(120)]  # copies of one vector
    rows += [(2500, rows[3][1], 2 - rows[3][2]), (1000, rows[200][1], 1), (None, rows[200][1], 1), (1, rows[1][1], None)]
    odd = [None, [], [0.0] * length, [None] + [1.0] * (length - 1), [math.nan] * length, [math.inf] + [1.0] * (length - 1)]
    rows += [(3000 + i, v, 1) for i, v in enumerate(odd)] + [(None, None, None)]
    rows += [(3100 + i, [1.0, 2.0, 2.0 + i / 1000], 1) for i in range(3)] + [(3200 + i, [float(i - 1)], 1) for i in range(4)]
    return rows


@pytest.mark.parametrize("block", [1000, 16])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK_ROWS", block)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "c", "f", "l") for r in rows], VECTOR).repartition(5)
    found = caps.near_vectors(df)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(tuple(r) for r in found.collect()) == plain_links(rows)
    assert caps.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("length, directions", [(2, 256), (3, 512), (7, 256), (8, 256), (64, 256), (64, 2048), (300, 512)])
def test_filters_find_pairs_at_the_threshold(length, directions):
    rng = np.random.default_rng(length)
    x, z = rng.standard_normal((2, 600, length))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z
    code, lists = caps.Code.of(length, 0.93, directions), []
    for side in (x, y):
        rows, filters = code.passed(side)
        sets = [set() for _ in side]
        for r, f in zip(rows.tolist(), filters.tolist()):
            sets[r].add(f)
        lists.append(sets)
    missed = sum(not (a & b) for a, b in zip(*lists))
    assert missed <= 2
    assert all(len(s) >= caps.CODES for side in lists for s in side)
    if length >= 8:
        assert np.mean([len(s) for s in lists[0]]) < 4 * caps.CODES * caps.PASSED


def test_list_decoding_finds_every_passed_filter():
    code, rng = caps.Code.of(10), np.random.default_rng(1)
    units = rng.standard_normal((5, 10))
    units /= np.linalg.norm(units, axis=1)[:, None]
    rows, filters = code.passed(units)
    found = set(zip(rows.tolist(), filters.tolist()))
    for number, (first, second) in enumerate(code.parts):
        for i, u in enumerate(units):
            products = (first @ u)[:, None] + (second @ u)[None, :]
            limit = min(code.threshold, products.max() - 1e-9)
            for a, b in zip(*np.nonzero(products >= limit + 1e-12)):
                assert (i, (number * code.directions + a) * code.directions + b) in found


# --- spelling


def plain_spelling(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (a, b), words in holes.items():
        for w in words:
            near[w] |= words - {w}
            if a + b in n:
                near[w].add(a + b), near[a + b].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w] or "", n[form[w]] if form[w] else 0, root(w)) for w in n)


def spelling_rows(spark):
    rnd = random.Random(6)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    words = ["chained", "chainéd", "xchained", "chaine", "chaineds", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÉCLAIRées", "éclairées", "×÷×÷×÷×"]
    for i in range(200):
        rows.append((5000 + i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40)))))
    rows += [(6000 + i, "chained " * 9 ** (3 - i // 10)) for i in range(40)]  # chains of forms
    rows += [(7000, "chaines chaines"), (7001, "chainest chainest")]
    prefix = "".join(rnd.choice("abcdef") for _ in range(9))
    rows += [(8000 + i, f"{prefix}{chr(97 + i % 26)}{chr(97 + i // 26)} " * 2) for i in range(300)]  # one tile of many words
    rows += [(None, "nullnull nullnull"), (9000, None), (9001, ""), (9002, "z" * 30_000 + " " + "z" * 30_001), (9003, "z" * 30_000 + " " + "z" * 30_001)]
    return rows


@pytest.mark.parametrize("block", [512, 24])
def test_spellings_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_ROWS", block)
    monkeypatch.setattr(spelling, "HELD_WORDS", 300)
    rows = spelling_rows(spark)
    df = spark.createDataFrame([(*r, "w", "t", 1) for r in rows], "doc_id bigint, text string, word string, tile string, n int").repartition(4)
    found = spelling.spelling_variants(df)
    assert sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in found.collect()) == plain_spelling(rows)
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", 10**i, 1, f"w{i + 1:02}" if i < 17 else None, 10 ** (i + 1) if i < 17 else None) for i in range(18)]
    forms = spark.createDataFrame(chain, "word string, n bigint, n_near bigint, form string, form_n bigint")
    assert {r.root for r in spelling.with_roots(forms).collect()} == {"w17"}


def test_block_pairs_meet_every_two_rows_once(spark):
    rows = [(k, i) for k, n in ((1, 1), (2, 2), (3, 50)) for i in range(n)]
    paired, partitions = tiles.block_pairs(spark.createDataFrame(rows, "k int, i bigint"), ["k"], ["i"], 8)
    met = Counter()
    for run in by_run(tiles.in_runs(paired, partitions).collect()):
        sides = [[(r.k, r.i) for r in run if r._side == s] for s in (0, 1)]
        pairs = [(a, b) for a in sides[0] for b in sides[1]] if sides[1] else [(a, b) for j, a in enumerate(sides[0]) for b in sides[0][:j]]
        met.update(frozenset(p) for p in pairs)
    assert set(met.values()) == {1} and len(met) == 1 + 50 * 49 // 2


def by_run(rows):
    found = defaultdict(list)
    for r in rows:
        found[r._run].append(r)
    return found.values()
