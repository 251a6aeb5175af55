"""Sharding and mixing against plain Python."""

import zlib
from collections import Counter, defaultdict

import pytest

from armlift.llm.mixing import mix, source_targets, word_counts
from armlift.llm.ordering import with_position
from armlift.llm.sharding import MULTIPLIERS, OFFSETS, PRIME, op1_shard_documents, permuted, shard, sides
from tests.conftest import MEDIUM, SMALL


def feistel(x, n, seed):
    a, b = sides(n)

    def value(half, i):
        first = ((half + seed) % PRIME * MULTIPLIERS[i] + OFFSETS[i]) % PRIME
        return (first * first + OFFSETS[-1 - i]) % PRIME * MULTIPLIERS[-1 - i] % PRIME

    while True:
        left, right = divmod(x, b)
        for i in range(len(MULTIPLIERS)):
            if i % 2 == 0:
                left = (left + value(right, i)) % a
            else:
                right = (right + value(left, i)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000])
def test_permutation_is_the_cycle_walked_network(spark, n):
    found = {r.id: r._f_permuted for r in permuted(spark.range(n), "id", n, 7).collect()}
    assert found == {x: feistel(x, n, 7) for x in range(n)}
    assert sorted(found.values()) == list(range(n))


def test_shards_are_even_and_gapless(spark):
    rows = op1_shard_documents(spark, MEDIUM).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    order = {d: i for i, d in enumerate(sorted(texts))}
    for r in rows:
        text = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.grown_shard) == (len(text) + 1, zlib.crc32(text), None)
        slots[r.shard].append(r.slot)
        assert r.slot * 8 + r.shard == feistel(order[r.doc_id], len(rows), 1)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_of_odd_tables(spark):
    schema = "doc_id bigint, text string, shard int, position string"
    assert shard(spark.createDataFrame([], schema), ["doc_id"], 4).collect() == []
    rows = [(None, None, 9, "x"), (1, "", 9, "x"), (1, "", 9, "x"), (2, "a" * 100_000, 9, "x")]
    found = shard(spark.createDataFrame(rows, schema), ["doc_id"], 3).collect()
    assert sorted(r.slot * 3 + r.shard for r in found) == [0, 1, 2, 3]
    assert {r.position for r in found} == {"x"}


def test_positions_and_totals_inside_groups(spark):
    rows = [(g, i % 7, i) for i in range(300) for g in ("a", None) if g or i < 50]
    df = spark.createDataFrame(rows, "g string, k int, v bigint")
    for g, members in (("a", 300), (None, 50)):
        found = sorted((r._p_position, r.k, r.v, r._p_total) for r in with_position(df, ["k", "v"], "v", "g").collect() if r.g == g)
        assert [f[0] for f in found] == list(range(members))
        assert [f[1:3] for f in found] == sorted((k, v) for h, k, v in rows if h == g)
        total = 0
        for _, _, v, before in found:
            assert before == total
            total += v


def level_by_hand(sizes, weights=(1, 2, 3), passes=3):
    """Targets by handing out the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > passes * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: passes * sizes[s] for s in over}


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1000, "c": 1, None: 40}, {"x": 5}, {"a": 1, "b": 1, "c": 1, "d": 5000}, {"a": 0, "b": 7}]
)
def test_targets_fill_up_to_capacity(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    found = {r.source: r.target for r in source_targets(df).collect()}
    assert found == pytest.approx(level_by_hand(sizes))


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = word_counts(docs)
    by_source = defaultdict(lambda: [0, 0.0, 0])
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mix(sizes).collect()
    assert sorted(r.doc_id for r in rows) == sorted(source)
    for r in rows:
        entry = by_source[source[r.doc_id]]
        entry[0] += r["size"] * r.copies
        entry[1], entry[2] = r.target, max(entry[2], r["size"])
        assert 0 <= r.copies <= 3
    total = sum(r["size"] for r in rows)
    assert sum(e[0] for e in by_source.values()) <= total
    assert all(abs(taken - target) <= 2 * largest for taken, target, largest in by_source.values())
    assert sorted(map(tuple, mix(sizes).collect())) == sorted(map(tuple, rows))


def test_mix_of_odd_tables(spark):
    schema = "doc_id bigint, source string, text string, target int"
    assert mix(word_counts(spark.createDataFrame([], schema))).collect() == []
    rows = [(1, None, None, 1), (1, None, "", 1), (None, "a", "x y z", 1), (2, "a", "x y z", 1), (2, "a", "x y z", 1)]
    found = mix(word_counts(spark.createDataFrame(rows, schema))).collect()
    assert len(found) == 5 and sum(r["size"] * r.copies for r in found) <= 9
    assert all(r.copies == 0 for r in found if r["size"] == 0)
