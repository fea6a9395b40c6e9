import random

import pytest

from quillspark.operators import assembly as Y
from quillspark.operators import chunking as C
from quillspark.sources import readers as S


@pytest.mark.parametrize("cell", [1, 7, 64, 4096])
def test_overlaps_equal_a_range_join(spark, cell):
    rng = random.Random(cell)
    spans, blocks = ([(rng.randrange(3), n, a, a + rng.randrange(60)) for n in range(60) for a in [rng.randrange(400)]] for _ in "ab")
    blocks += [(1, 900, 0, 5000), (None, 901, 0, 10), (2, 902, None, 10)]
    got = Y.overlaps(spark.createDataFrame(spans, "d int, ordinal int, start int, end int"), spark.createDataFrame(blocks, "d int, block_no int, start int, end int"), "d", cell)
    want = sorted((d, n, m) for d, n, a, b in spans for e, m, x, y in blocks if d == e and x is not None and x < b and a < y and a < b and x < y)
    assert sorted((r.d, r.ordinal, r.block_no) for r in got.collect()) == want


def test_facts_of_a_chunk(spark):
    blocks = [
        (1, 0, 0, 10, "heading", 1, [], None, None),
        (1, 1, 11, 50, "paragraph", 1, ["A"], "", None),
        (1, 2, 51, 90, "paragraph", 3, ["A", "B"], "de", 0.5),
        (1, 3, 91, 99, "code", 4, ["C"], "en", 0.9),
        (1, 4, 100, 120, "table", None, None, "fr", 0.9),
        (1, 5, 121, 140, "list", 5, ["D"], "fr", 0.9),
    ]
    df = spark.createDataFrame([(*b, "clash") for b in blocks], "d int, block_no int, start int, end int, block_type string, page int, heading_path array<string>, language string, confidence double, content string")
    spans = spark.createDataFrame([(1, 0, 0, 60, "x"), (1, 1, 52, 53, "x"), (1, 2, 95, 130, "x"), (1, 3, 125, 126, "x"), (1, 4, 500, 600, "x"), (2, 0, 0, 5, "x")], "d int, ordinal int, start int, end int, content string")
    got = {(r.d, r.ordinal): (r.page_from, r.page_to, r.heading_path, r.section, r.language, r.block_type, r.blocks) for r in Y.assemble(spans, df, "d").collect()}
    assert got == {
        (1, 0): (1, 3, ["A"], "A", "de", "heading", 3),
        (1, 1): (3, 3, ["A", "B"], "B", "de", "ocr", 1),
        (1, 2): (4, 5, ["C"], "C", "en", "code", 3),
        (1, 3): (5, 5, ["D"], "D", "fr", "ocr", 1),
        (1, 4): (None, None, [], None, None, None, 0),
        (2, 0): (None, None, [], None, None, None, 0),
    }
    assert {r.block_type for r in Y.assemble(spans, df, "d", ocr=False).filter("ordinal = 3").collect()} == {"list"}
    assert Y.assemble(spans.limit(0), df, "d").count() == 0


def test_recursive_chunks_break_before_headings(spark):
    step = "The {} requires that all staff complete step {} before the deadline."
    text = "\n\n".join(part for k in range(4) for part in (f"{k + 1}. Scope of part {k + 1}", " ".join(step.format(w, i) for i, w in enumerate(["manual", "policy", "notice", "guide"])), "```\ncode here\n```"))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, t string")
    heads = [r.start for r in S.text_to_blocks(df, "d", "t").filter("block_type = 'heading'").collect()]
    assert len(heads) == 4
    rows = sorted(Y.recursive_chunks(df, "d", "t", C.Config(60, 20, 120, 0.1)).collect(), key=lambda r: r.ordinal)
    assert all(text[r.start : r.end] == r.content for r in rows)
    # a heading opens a chunk unless what stands before it is under the least size
    inside = [C.estimate(text[r.start : h]) for r in rows for h in heads if r.start < h < r.end]
    assert {r.start for r in rows} & set(heads) >= {0, 654} and all(n < 20 for n in inside)
    plain = C.chunk(df, "d", "t", C.Config(60, 20, 120, 0.1)).collect()
    assert not {r.start for r in plain} >= {0, 654}
    blocks = S.text_to_blocks(df, "d", "t").collect()
    for r in rows:
        own = [b for b in blocks if b.d == r.d and b.start < r.end and r.start < b.start + len(b.text)]
        assert r.blocks == len(own) and r.block_type == ("code" if any(b.block_type == "code" for b in own) else own[0].block_type)
