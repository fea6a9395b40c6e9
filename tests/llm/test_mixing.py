import math

from quillspark.llm import mixing
from quillspark.llm.queries import OP4_SQL, op4_mixing

from ..compare import same


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Sharing by weight, again and again, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, left = sum(sizes.values()), {s: 0.0 for s in names}, set(names)
    while left:
        share = (total - sum(out[s] for s in names if s not in left)) / sum(w[s] for s in left)
        over = {s for s in left if w[s] * share > cap * sizes[s]}
        for s in over or left:
            out[s] = min(cap * sizes[s], w[s] * share)
        left = left - over if over else set()
    return out


def test_query_equals_its_sql(spark, duck, sf):
    same(spark, duck, sf, op4_mixing, OP4_SQL)


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 3 + ["b"] * 200 + [None] * 5 + ["ç"] * 40)] + [(900, None, "z"), (901, "", "z"), (5, "w w", "b")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    plan = mixing.mixing_plan(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes) and len(plan) == len(rows)
    for r in plan:
        assert math.isclose(r.target, want[by_size[r.source_size]], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.copies <= 3 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in plan)
    assert sorted(mixing.mixing_plan(df).collect()) == sorted(plan)


def test_empty_table_and_no_words(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], df.schema)
    assert [(r.target, r.copies) for r in mixing.mixing_plan(none).collect()] == [(0.0, 0), (0.0, 0)]


def test_no_python_in_the_plan(spark, sf):
    plan = op4_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
