import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions.geometry import Rect, rect_contains, rects_intersect
from quirefold.operators import layout as L

RECTS = "node_id string, title string, x double, y double, width double, height double"
VIEWS = "viewport_id int, x double, y double, width double, height double"


def test_rectangles(spark):
    """Overlap and containment; touching edges count."""
    a = Rect.literal(-30, 5, 90, 45)
    row = spark.range(1).select(
        rects_intersect(a, Rect.literal(55, 41, 33, 8)), rects_intersect(a, Rect.literal(61, 60, 7, 9)),
        rects_intersect(a, Rect.literal(60, 50, 3, 4)), rect_contains(Rect.literal(2, 3, 11, 6), F.lit(4.0), F.lit(8.5)),
        rect_contains(Rect.literal(2, 3, 11, 6), F.lit(13.5), F.lit(8.5)), rect_contains(a, F.lit(60.0), F.lit(5.0)),
    ).first()
    assert list(row) == [True, False, True, True, False, True]


def test_viewport(spark):
    nodes = spark.createDataFrame([("v", "near", 12.0, 40.0, 9.0, 6.0), ("h", "far", 512.0, 77.0, 9.0, 6.0)], RECTS)
    assert [r["title"] for r in L.viewport_nodes(nodes, -5, 20, 60, 50).collect()] == ["near"]
    views = spark.createDataFrame([(1, -5.0, 20.0, 60.0, 50.0)], VIEWS)
    assert [r["title"] for r in L.viewport_join(nodes, views).collect()] == ["near"]


@pytest.mark.parametrize("bound", [1000, 0])
def test_grid_join_equals_nested_loop(spark, bound):
    rng = random.Random(8)

    def rect(scale):
        return (float(rng.randint(-600, 600)), float(rng.randint(-600, 600)), float(rng.choice([0, 1, 16, 64, scale])), float(rng.choice([0, 3, 16, scale])))

    # Half of all nodes sit in one spot.
    nodes = [(f"n{i}", "t", *((5.0, 5.0, 2.0, 2.0) if i % 2 else rect(150))) for i in range(600)]
    views = [(i, *rect(300)) for i in range(60)] + [(60, -1e6, -1e6, 3e6, 3e6), (61, 1e7, 1e7, 5.0, 5.0)]

    def meets(a, b):
        return a[0] <= b[0] + b[2] and a[0] + a[2] >= b[0] and a[1] <= b[1] + b[3] and a[1] + a[3] >= b[1]

    expected = sorted((v[0], n[0]) for n in nodes for v in views if meets(n[2:], v[1:]))
    joined = L.viewport_join(spark.createDataFrame(nodes, RECTS), spark.createDataFrame(views, VIEWS), broadcast_bound=bound)
    assert sorted((r["viewport_id"], r["node_id"]) for r in joined.collect()) == expected
    assert len([v for v, _ in expected if v == 60]) == 600


@pytest.mark.parametrize("bound", [1000, 0])
def test_huge_and_far_rectangles(spark, bound):
    """Whatever the size, a rectangle is filed in four cells of a grid at most."""
    sides = [0.0, 1.0, 1e3, 1e18, 1.2e18, 1e22, 1e30, 1e300]
    nodes = [(f"n{i}", "t", x, x, side, 1.0) for i, (x, side) in enumerate((x, s) for s in sides for x in (-1e300, -1e25, -5.0, 0.0, 7.0, 1e25, 1e300))]
    views = [(i, x, -1e301, side, 2e301) for i, (x, side) in enumerate((x, s) for s in sides for x in (-1e30, -3.0, 2.0, 1e26))]
    expected = sorted((v[0], n[0]) for n in nodes for v in views if n[2] <= v[1] + v[3] and n[2] + n[4] >= v[1] and n[3] <= v[2] + v[4] and n[3] + n[5] >= v[2])
    joined = L.viewport_join(spark.createDataFrame(nodes, RECTS), spark.createDataFrame(views, VIEWS), broadcast_bound=bound)
    assert sorted((r["viewport_id"], r["node_id"]) for r in joined.collect()) == expected
    rects = spark.createDataFrame(nodes, RECTS)
    filed = L._filed(rects, Rect.named(), F.array(L._level(Rect.named())))
    assert filed.groupBy("node_id").count().agg(F.max("count")).first()[0] <= 4


DOCS = "document_id string, title string, low_quality_pages array<int>, imported_at long"
SECTIONS = "document_id string, level int, title string, chunk_start_ordinal int"


def test_mindmap(spark):
    docs = spark.createDataFrame([("a", "A", [], 10), ("b", "B", [1, 2], 20), ("c", "C", [], 5)], DOCS)
    sections = spark.createDataFrame([("a", 2, "second", 4), ("a", 0, "first", 1), ("c", 3, "late", 0)], SECTIONS)
    nodes = {r["node_id"]: tuple(r)[1:] for r in L.mindmap_nodes(docs, sections, limit=2).collect()}
    every = {r["node_id"]: tuple(r)[1:] for r in L.mindmap_nodes(docs, sections, limit=10**9).collect()}
    assert len(every) == 7 and nodes.items() <= every.items() and every["c/0"] == ("late", 820.0, 762.0, 210.0, 52.0)
    assert nodes == {
        "b/root": ("B • LQ 2", 70.0, 80.0, 260.0, 62.0), "b/none": ("(no outline)", 380.0, 160.0, 180.0, 52.0),
        "a/root": ("A • Clean", 70.0, 380.0, 260.0, 62.0), "a/0": ("first", 380.0, 462.0, 210.0, 52.0), "a/1": ("second", 600.0, 534.0, 210.0, 52.0),
    }


def test_placeholders_without_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    nodes = L.mindmap_nodes(docs, spark.createDataFrame([], SECTIONS)).orderBy("x").collect()
    assert [(r["title"], r["x"], r["y"], r["width"], r["height"]) for r in nodes] == [
        ("Import a document", 120.0, 120.0, 260.0, 66.0), ("Build local knowledge graph", 430.0, 210.0, 280.0, 66.0), ("Run semantic search", 780.0, 300.0, 240.0, 66.0),
    ]


def test_nodes_outside_the_index(spark):
    docs = spark.createDataFrame([(f"d{i:02}", "t", [], 100 - i) for i in range(40)], DOCS)
    marked = L.nodes_out_of_bounds(L.mindmap_nodes(docs, spark.createDataFrame([], SECTIONS)))
    lost = {r["node_id"] for r in marked.where(~F.col("kept")).collect() if r["node_id"].endswith("root")}
    assert lost == {f"d{i}/root" for i in range(31, 40)}
