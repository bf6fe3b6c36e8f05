"""Trees walked level by level against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F
from quirelay.operators import trees as T


def plain(rows):
    """{(tree, id): (level, root, number in document order)} by recursion."""
    children, out = {}, {}
    for tree, id, parent, pos, _ in rows:
        children.setdefault((tree, parent), []).append((pos, id))

    def down(tree, id, level, root, order):
        order.append(id)
        out[tree, id] = [level, root, len(order) - 1]
        for _, c in sorted(children.get((tree, id), [])):
            down(tree, c, level + 1, root, order)

    for tree in {r[0] for r in rows}:
        order = []
        for _, id in sorted(children.get((tree, None), [])):
            down(tree, id, 0, id, order)
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "wide"])
def test_against_recursion(spark, shape):
    rng = random.Random(6)
    rows = []
    for tree in range(3):
        for id in range(120 if shape == "chain" else 60):
            parent = None if id == 0 or (shape == "random" and id % 25 == 0) else id - 1 if shape == "chain" else 0 if shape == "wide" else rng.randrange(id)
            rows.append((tree, id, parent, rng.randrange(4), rng.choice("ab")))
    rows += [(0, 900, 901, 0, "a"), (0, 901, 900, 0, "a")]  # a circle that no root reaches
    nodes = spark.createDataFrame(rows, "tree long, id long, parent long, pos long, tag string")
    walk = T.walked(nodes).persist()
    want = plain(rows)
    assert {(r["tree"], r["id"]): [r["level"], r["root"]] for r in walk.collect()} == {k: v[:2] for k, v in want.items()}
    found = T.find_all(T.with_parent(walk, ["tag"]), F.col("tag") == "a").collect()
    tags = {(t, i): g for t, i, _, _, g in rows}
    up = {(t, i): p for t, i, p, _, _ in rows}
    for tree in range(3):
        mine = sorted((r["number"], r["id"], r["parent_tag"]) for r in found if r["tree"] == tree)
        order = [i for (t, i), v in sorted(want.items(), key=lambda x: x[1][2]) if t == tree and v[0] > 0 and tags[t, i] == "a"]
        assert mine == [(k, i, tags[tree, up[tree, i]]) for k, i in enumerate(order)]
    sums = {(r["tree"], r["id"]): (r["size"], r["total"]) for r in T.rolled_up(walk, F.col("id")).collect()}

    def below(tree, id):
        return [id] + [x for (t, i), p in up.items() if t == tree and p == id and (t, i) in want for x in below(t, i)]

    if shape != "chain":
        assert all(sums[k] == (len(b := below(*k)), sum(b)) for k in want)
    walk.unpersist()


def test_a_tree_that_is_too_deep_is_an_error(spark):
    nodes = spark.range(30).selectExpr("0L as tree", "id", "nullif(id, 0) - 1 as parent", "0L as pos")
    assert T.walked(nodes, depth=40).agg(F.max("level")).first()[0] == 29
    with pytest.raises(Exception, match="(?i)recursion"):
        T.walked(nodes, depth=10).count()
    assert T.walked(nodes.limit(0)).count() == 0
