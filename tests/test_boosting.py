"""Boosted trees against a plain version that recounts every node from its rows."""

import numpy as np
import pytest

from armlift.operators import boosting, uplift
from armlift.operators.boosting import GRADIENT_STEP, TreeSettings, mixed_units
from armlift.schema import Roles

ROLES = Roles(features=("a", "b", "c", "d"), metrics=("visit", "conversion"))
EDGES = {"a": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], "b": [0.25, 0.5, 0.75], "c": [0.0], "d": []}


def plain_splits(codes, g, h, rows, settings):
    """Best split of a node by (gain, first feature, first bin)."""
    best, total = None, (g[rows].sum(), h[rows].sum())
    for f, x in codes.items():
        for last in range(len(EDGES[ROLES.features[f]])):
            left = rows & (x <= last)
            right = rows & (x > last)
            if min(left.sum(), right.sum()) < settings.min_leaf or min(h[left].sum(), h[right].sum()) < 1e-3:
                continue
            score = lambda m: g[m].sum() ** 2 / h[m].sum()
            gain = score(left) + score(right) - total[0] ** 2 / total[1]
            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                best = gain, f, last, left, right
    return best


def plain_tree(codes, margin, y, sampled, settings):
    """Step values of all rows after best-first growth, one leaf at a time."""
    p = 1 / (1 + np.exp(-margin))
    g, h = (np.rint(v / GRADIENT_STEP) * GRADIENT_STEP for v in (p - y, p * (1 - p)))
    everywhere = np.ones(len(y), bool)
    leaves = [(everywhere, 0)]
    while len(leaves) < settings.leaves:
        options = []
        for i, (rows, depth) in enumerate(leaves):
            split = plain_splits(codes, g, h, rows & sampled, settings) if depth < settings.depth else None
            if split:
                options.append((split[0], -i, split))
        if not options:
            break
        _, i, (_, f, last, _, _) = max(options, key=lambda o: o[:2])
        rows, depth = leaves.pop(-i)
        leaves += [(rows & (codes[f] <= last), depth + 1), (rows & (codes[f] > last), depth + 1)]
    step = np.zeros(len(y))
    for rows, _ in leaves:
        used = rows & sampled
        step[rows] = -g[used].sum() / h[used].sum() * settings.step
    return step, len(leaves)


def table(spark, n=1500, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 7, n).astype(float), rng.random(n).round(2), rng.integers(0, 2, n).astype(float)
    a[::50] = np.nan
    t = (rng.random(n) < 0.7).astype(int)
    visit = (rng.random(n) < 0.2 + 0.3 * (np.nan_to_num(a) > 3) + 0.2 * t * (b > 0.5)).astype(int)
    sale = visit * (rng.random(n) < 0.5)
    rows = [(int(i), *(float(v) for v in (a[i], b[i], c[i])), 1.0, int(t[i]), int(visit[i]), int(sale[i])) for i in range(n)]
    schema = "unit_id bigint, a double, b double, c double, d double, treatment int, visit int, conversion int"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("settings", [
    TreeSettings(n_trees=4, at_once=1, step=0.3, leaves=6, min_leaf=20, row_share=1.0, feature_share=1.0),
    TreeSettings(n_trees=5, at_once=2, step=0.1, leaves=31, depth=4, min_leaf=5, row_share=0.6, feature_share=0.75, task_rows=400),
])
def test_forest_is_that_of_recounted_nodes(spark, settings):
    df = table(spark)
    model = uplift.fit_t_learner(df, settings, seed=3, roles=ROLES, edges=EDGES)
    rows = df.selectExpr("*", "xxhash64(unit_id) as unit").toPandas().sort_values("unit_id")
    scored = model.score(df).toPandas().sort_values("unit_id")
    for arm in (0, 1):
        part, found = rows[rows.treatment == arm], scored[scored.treatment == arm]
        codes = {i: np.where(np.isnan(part[f]), 0, np.searchsorted(EDGES[f], part[f])) for i, f in enumerate(ROLES.features)}
        units = part.unit.to_numpy(np.int64).view(np.uint64)
        for metric in ROLES.metrics:
            y = part[metric].to_numpy(float)
            margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
            steps = []
            for number in range(settings.n_trees):
                rng = np.random.default_rng([3, number])
                used = np.sort(rng.choice(4, max(1, int(settings.feature_share * 4)), replace=False))
                sampled = mixed_units(units, 3, number) < settings.row_share * 2.0**64
                step, leaves = plain_tree({f: codes[f] for f in used}, margin, y, sampled, settings)
                m = model.forest.models.index((ROLES.metrics.index(metric), arm))
                tree = model.forest.rounds[number][m]
                assert sum(f < 0 for f in tree.feature) == leaves
                steps.append(step)
                if len(steps) == settings.at_once or number == settings.n_trees - 1:
                    for step in steps:
                        margin = margin + step
                    steps = []
            assert np.allclose(found[f"p{arm}_{metric}"], 1 / (1 + np.exp(-margin)), rtol=1e-9)


def test_layout_does_not_change_the_trees(spark):
    df, settings = table(spark), TreeSettings(n_trees=3, leaves=8, min_leaf=10)
    forests = [
        uplift.fit_t_learner(d, s, roles=ROLES, edges=EDGES).forest
        for d, s in ((df, settings), (df.repartition(7), TreeSettings(n_trees=3, leaves=8, min_leaf=10, task_rows=90, least_rows=50)))
    ]
    assert forests[0].rounds == forests[1].rounds and forests[0].start == forests[1].start


def test_margins_renewed_from_the_stored_rows_are_the_same(spark, monkeypatch):
    df, settings = table(spark, 400), TreeSettings(n_trees=5, at_once=2, leaves=4, min_leaf=10)
    once = uplift.fit_t_learner(df, settings, roles=ROLES, edges=EDGES).forest
    monkeypatch.setattr(boosting, "RENEWED", 2)
    assert uplift.fit_t_learner(df, settings, roles=ROLES, edges=EDGES).forest.rounds == once.rounds


def test_arms_without_rows_outcomes_or_splits(spark):
    df = table(spark, 300)
    settings = TreeSettings(n_trees=2, leaves=4, min_leaf=10)
    only = uplift.fit_t_learner(df.where("treatment = 1").selectExpr("* except (visit)", "0 as visit"), settings, roles=ROLES, edges=EDGES)
    chances = only.score(df).selectExpr("min(p0_visit) as a", "max(p0_visit) as b", "max(p1_visit) as c", "count(1) as n").first()
    assert chances.a == chances.b == 0.5 and chances.c < 0.01 and chances.n == 300
    none = uplift.fit_t_learner(df.limit(0), settings, roles=ROLES, edges=EDGES)
    assert none.score(df).where("uplift_visit <> 0").count() == 0 and none.score(df.limit(0)).count() == 0
    odd = df.selectExpr("* except (visit, a, treatment)", "if(unit_id < 50, null, visit) as visit", "if(unit_id < 9, null, a) as a",
                        "if(unit_id = 60, null, treatment) as treatment")
    assert uplift.fit_t_learner(odd, settings, roles=ROLES, edges=EDGES).score(odd).where("uplift_visit is null").count() == 0


def test_forest_table_has_every_node(spark):
    model = uplift.fit_t_learner(table(spark, 500), TreeSettings(n_trees=2, leaves=4, min_leaf=10), roles=ROLES, edges=EDGES)
    rows = model.forest.table(spark).toPandas()
    assert (rows[rows.tree < 0].groupby("model").size() == 1).all() and rows.model.nunique() == 4
    nodes = rows[rows.tree >= 0]
    assert nodes.feature.isna().equals(~nodes.value.isna())
    assert len(nodes) == sum(len(t.feature) for trees in model.forest.rounds for t in trees)


def grown_by_hand(rng, n_splits, n_bins=9, n_features=4):
    tree, leaves = boosting.Tree(), [0]
    for _ in range(n_splits):
        node = leaves.pop(rng.integers(len(leaves)))
        first = len(tree.feature)
        tree.feature[node], tree.bin[node] = int(rng.integers(n_features)), int(rng.integers(n_bins - 1))
        tree.left[node], tree.right[node] = first, first + 1
        for line, empty in ((tree.feature, -1), (tree.bin, 0), (tree.left, -1), (tree.right, -1)):
            line += [empty, empty]
        tree.value += rng.random(2).tolist()
        leaves += [first, first + 1]
    return tree


@pytest.mark.parametrize("n_splits", [0, 1, 30, 63, 80])
def test_leaf_values_are_those_of_a_walk(n_splits):
    rng = np.random.default_rng(n_splits)
    tree, codes = grown_by_hand(rng, n_splits), rng.integers(0, 9, (4, 500))
    expected = np.zeros(500)
    for node, rows in tree.parted(lambda feature, last, rows: codes[feature][rows] <= last, 500):
        expected[rows] = tree.value[node]
    assert np.array_equal(boosting.LeafValues(tree, [9] * 4).of(list(codes.astype(np.intp))), expected)


def test_rows_stored_with_margins_grow_the_same_trees(spark, monkeypatch):
    df = table(spark, 800)
    settings = TreeSettings(n_trees=6, at_once=1, step=0.2, leaves=5, min_leaf=20)
    whole = uplift.fit_t_learner(df, settings, roles=ROLES, edges=EDGES).forest
    kept = []
    release = boosting.release
    monkeypatch.setattr(boosting, "RENEWED", 2)
    monkeypatch.setattr(boosting, "release", lambda *tables: kept.extend(tables) or release(*tables))
    again = uplift.fit_t_learner(df, settings, roles=ROLES, edges=EDGES).forest
    assert again.rounds == whole.rounds and again.start == whole.start
    # margins come from the stored rows, which are deleted once newer ones are there
    assert len(kept) == 2


@pytest.mark.parametrize("n_splits", [1, 30, 80])
def test_leaf_values_over_shared_columns_are_those_of_a_walk(n_splits):
    rng = np.random.default_rng(n_splits)
    sizes = [9, 300, 9, 9]
    columns = boosting.Columns(sizes)
    assert [mine for _, mine in columns.shared()] == [[0, 2, 3]]
    tree, codes = grown_by_hand(rng, n_splits), np.stack([rng.integers(0, size, 500) for size in sizes])
    expected = np.zeros(500)
    for node, rows in tree.parted(lambda feature, last, rows: codes[feature][rows] <= last, 500):
        expected[rows] = tree.value[node]
    found = np.zeros((2, 500))
    boosting.add_values(found, codes.astype(np.uint16), [(1, boosting.LeafValues(tree, sizes).by_column(columns))], columns)
    assert np.array_equal(found[1], expected) and not found[0].any()


def block_by_hand(rng, arm, n, sizes, outcomes=(0.0, 1.0, np.nan, -1.0)):
    codes = np.stack([rng.integers(0, size, n) for size in sizes]).astype(np.uint16)
    units = rng.integers(0, 2**63, n).astype(np.uint64)
    return boosting.Block(arm, codes, units, rng.choice(outcomes, (2, n)), rng.normal(size=(2, n)))


@pytest.mark.parametrize("outcomes", [(0.0, 1.0), (0.0, 1.0, np.nan, -1.0), (0.0, 7.0)])
def test_sums_over_parts_and_blocks_are_those_of_recounted_rows(monkeypatch, outcomes):
    monkeypatch.setattr(boosting, "PART_ROWS", 70)
    monkeypatch.setattr(boosting, "SUMMED_ROWS", 50)
    rng, sizes, models, numbers = np.random.default_rng(5), [9, 300, 9, 9], [(0, 0), (0, 1), (1, 0), (1, 1)], range(3, 8)
    settings = TreeSettings(feature_share=0.75, row_share=0.6)
    blocks = [block_by_hand(rng, arm, n, sizes, outcomes) for arm, n in ((0, 90), (1, 333), (1, 170), (0, 0))]
    columns = boosting.Columns(sizes)
    used = [boosting.used_features(number, 4, settings, 2) for number in numbers]
    grown = [[grown_by_hand(rng, 6) for _ in models] for _ in numbers]
    leaves = lambda tree: [node for node, feature in enumerate(tree.feature) if feature < 0]
    wants = [[[0]] * 4 for _ in numbers], [[leaves(t)[1::2] if m != 2 else [] for m, t in enumerate(trees)] for trees in grown]
    trees = [[boosting.Tree() for _ in models] for _ in numbers], grown
    for function, mine, wanted in zip((boosting.root_sums, boosting.node_sums), trees, wants):
        plans = [boosting.Plan(u, t, w) for u, t, w in zip(used, mine, wanted)]
        ready = (b.ready(numbers, settings, 2) for b in blocks)
        found = dict(function(ready, plans, models, columns))
        for p, number in enumerate(numbers):
            for m, (metric, arm) in enumerate(models):
                expected = np.zeros((3, len(wanted[p][m]), sum(sizes[f] for f in used[p])))
                for b in blocks:
                    chance = 1 / (1 + np.exp(-b.margins[metric]))
                    usable = (b.outcomes[metric] >= 0) & (mixed_units(b.units, 2, number) < 0.6 * 2.0**64) & (b.arm == arm)
                    weights = np.rint((chance - b.outcomes[metric]) / GRADIENT_STEP), np.rint(chance * (1 - chance) / GRADIENT_STEP)
                    parts = mine[p][m].parted(lambda f, last, rows, b=b: b.codes[f][rows] <= last, len(b.units), set(wanted[p][m]))
                    for node, rows in parts:
                        rows, at, start = rows[usable[rows]], wanted[p][m].index(node), 0
                        for f in used[p]:
                            for k, weight in enumerate((*weights, np.ones(len(b.units)))):
                                np.add.at(expected[k, at], start + b.codes[f][rows].astype(int), weight[rows])
                            start += sizes[f]
                assert np.array_equal(found.get(p * 4 + m, np.zeros_like(expected)), expected)


def test_full_blocks_of_equal_hessians_add_up_exactly(monkeypatch):
    n = 2 * boosting.SUMMED_ROWS + 7
    outcomes = np.ones((1, n))
    block = boosting.Block(1, np.zeros((1, n), np.uint8), np.arange(n, dtype=np.uint64), outcomes, np.zeros((1, n)))
    plans = [boosting.Plan(np.array([0]), [boosting.Tree()], [[0]])]
    settings = TreeSettings(row_share=1.0)
    found = dict(boosting.root_sums([block.ready([0], settings, 1)], plans, [(0, 1)], boosting.Columns([1])))
    assert found[0].ravel().tolist() == [-0.5 / GRADIENT_STEP * n, 0.25 / GRADIENT_STEP * n, n]


def test_tasks_do_not_grow_with_the_rows_they_can_go_through(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 20_000)
    df = spark.range(450_000).selectExpr("id as unit_id", "cast(id % 7 as double) as a", "0.5D as b", "0D as c", "1D as d",
                                         "cast(id % 2 as int) as treatment", "1 as visit", "0 as conversion")
    blocks, partitions = boosting.binned_blocks(df, ROLES.features, "treatment", ROLES.metrics, "unit_id", EDGES, TreeSettings())
    cores = spark.sparkContext.defaultParallelism
    assert partitions == cores == blocks.getNumPartitions()
    sizes = blocks.map(lambda b: (b.arm, len(b.units), b.codes.dtype.itemsize)).collect()
    # a block is done with before the next one is read
    assert sum(n for _, n, _ in sizes) == 450_000 and len(sizes) > 2 * cores and all(n <= 30_000 and size == 1 for _, n, size in sizes)


def test_many_blocks_and_tasks_grow_the_same_trees(spark, monkeypatch):
    df, settings = table(spark, 900), TreeSettings(n_trees=3, leaves=8, min_leaf=10)
    once = uplift.fit_t_learner(df, settings, roles=ROLES, edges=EDGES).forest
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    many = TreeSettings(n_trees=3, leaves=8, min_leaf=10, task_rows=40)
    assert uplift.fit_t_learner(df, many, roles=ROLES, edges=EDGES).forest.rounds == once.rounds


def test_scores_carry_the_named_columns_only(spark):
    df = table(spark, 300)
    model = uplift.fit_t_learner(df, TreeSettings(n_trees=2, leaves=4, min_leaf=10), roles=ROLES, edges=EDGES)
    parts = [f"p{arm}_{m}" for m in ROLES.metrics for arm in (0, 1)]
    scores = [f"uplift_{m}" for m in ROLES.metrics]
    few = model.score(df, ("unit_id", "b"))
    assert few.columns == ["unit_id", "b", *parts, *scores]
    whole = model.score(df)
    assert whole.columns == [*df.columns, *parts, *scores]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.select(few.columns).collect()))
