"""Mind-map node table and range queries on rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.geometry import Rect, rects_intersect
from quirefold.functions.report import quality_badge
from quirefold.operators.sections import few, recent_with_index, with_section_index
from quirefold.session import cut_lineage

# Node positions and sizes, in world units.
ROOT_X, ROOT_WIDTH, ROOT_HEIGHT = 70.0, 260.0, 62.0
DOCUMENT_STEP, TOP_MARGIN = 300.0, 80.0
SECTION_X, LEVEL_STEP, SECTION_WIDTH, SECTION_HEIGHT = 380.0, 220.0, 210.0, 52.0
SECTION_OFFSET, SECTION_STEP = 82.0, 72.0
NO_OUTLINE_TITLE, NO_OUTLINE_OFFSET, NO_OUTLINE_WIDTH = "(no outline)", 80.0, 180.0
PLACEHOLDERS = [
    ("Import a document", 120.0, 120.0, 260.0, 66.0),
    ("Build local knowledge graph", 430.0, 210.0, 280.0, 66.0),
    ("Run semantic search", 780.0, 300.0, 240.0, 66.0),
]
INDEX_BOUNDARY = (-800.0, -800.0, 10000.0, 10000.0)

NODE_COLUMNS = ["node_id", "title", "x", "y", "width", "height"]

# A broadcast viewport table has at most this many viewports.
BROADCAST_VIEWPORTS = 1000
# Rectangles are filed by size in grids of cell size 4**level.
CELL_BASE = 4.0
TOP_LEVEL = 30
FARTHEST = float(1 << 60)


def _node(node_id: Column, title: Column, x: Column, y: Column, width: float, height: float) -> list[Column]:
    values = [node_id, title, x, y, F.lit(width), F.lit(height)]
    return [value.alias(name) for name, value in zip(NODE_COLUMNS, values)]


def mindmap_nodes(documents: DataFrame, sections: DataFrame, limit: int | None = None) -> DataFrame:
    """Positions of documents, newest first, and of their sections, or placeholders without documents.

    With a ``limit`` only the newest documents are laid out; they are cut first and are the
    broadcast side everywhere while they are few.
    """
    # The few documents and their sections are used several times; the big tables are read once.
    recent = cut_lineage(
        recent_with_index(documents, limit).select("document_id", "title", "low_quality_pages", "recency_index")
    )
    keys = few(recent.select("document_id"), limit)
    placed = recent.select(
        "document_id",
        "title",
        F.size("low_quality_pages").alias("low_count"),
        (F.col("recency_index") * DOCUMENT_STEP + TOP_MARGIN).alias("base_y"),
    )
    key = F.col("document_id").cast("string")
    roots = placed.select(*_node(
        F.concat(key, F.lit("/root")), quality_badge(F.col("title"), F.col("low_count")),
        F.lit(ROOT_X), F.col("base_y"), ROOT_WIDTH, ROOT_HEIGHT,
    ))

    bases = few(placed.select("document_id", "base_y"), limit)
    shown = cut_lineage(sections.join(keys, "document_id", "left_semi"))
    own = with_section_index(shown).join(bases, "document_id")
    section_nodes = own.select(*_node(
        F.concat(key, F.lit("/"), F.col("section_index").cast("string")), F.col("title"),
        F.lit(SECTION_X) + F.greatest(F.lit(0), F.col("level") - 1) * LEVEL_STEP,
        F.col("base_y") + SECTION_OFFSET + F.col("section_index") * SECTION_STEP,
        SECTION_WIDTH, SECTION_HEIGHT,
    ))

    with_outline = shown.select("document_id").distinct()
    orphans = placed.join(with_outline, "document_id", "left_anti").select(*_node(
        F.concat(key, F.lit("/none")), F.lit(NO_OUTLINE_TITLE),
        F.lit(SECTION_X), F.col("base_y") + NO_OUTLINE_OFFSET, NO_OUTLINE_WIDTH, SECTION_HEIGHT,
    ))

    fixed = F.array(*[
        F.struct(*[F.lit(value).alias(name) for name, value in zip(NODE_COLUMNS, (f"placeholder/{i}", *row))])
        for i, row in enumerate(PLACEHOLDERS)
    ])
    counted = recent.agg(F.count(F.lit(1)).alias("n"))
    placeholders = counted.where(F.col("n") == 0).select(F.inline(fixed))
    return roots.unionByName(section_nodes).unionByName(orphans).unionByName(placeholders)


def _level(rect: Rect) -> Column:
    """Smallest grid whose cells are at least as long as the rectangle, so it meets at most 2 x 2.

    Longer rectangles than a cell of the top grid go to the one above, which is a single cell.
    """
    longest = F.greatest(rect.width, rect.height, F.lit(1.0))
    return F.least(F.ceil(F.log(CELL_BASE, longest)), F.lit(TOP_LEVEL + 1)).cast("int")


def _cell(value: Column, level: Column) -> Column:
    # Places that are too far off for a number of a cell share the last one.
    place = F.greatest(F.least(value / F.pow(F.lit(CELL_BASE), level), F.lit(FARTHEST)), F.lit(-FARTHEST))
    return F.when(level > TOP_LEVEL, F.lit(0).cast("long")).otherwise(F.floor(place).cast("long"))


def _filed(df: DataFrame, rect: Rect, levels: Column) -> DataFrame:
    """Explode a rectangle to the cells it meets in every grid of ``levels``, none of them below its own: four at most in each."""
    leveled = df.withColumn("_own", _level(rect)).withColumn("_grid", F.explode(levels))
    columns = leveled.withColumn(
        "_cx", F.explode(F.sequence(_cell(rect.x, F.col("_grid")), _cell(rect.right, F.col("_grid"))))
    )
    return columns.withColumn(
        "_cy", F.explode(F.sequence(_cell(rect.y, F.col("_grid")), _cell(rect.bottom, F.col("_grid"))))
    )


def viewport_join(nodes: DataFrame, viewports: DataFrame, broadcast_bound: int = BROADCAST_VIEWPORTS) -> DataFrame:
    """Pairs of nodes and viewports that meet: ``(viewport_id, node columns)``.

    An equi-join on grid cells: each pair is looked at in the grid of the larger of
    the two, where both meet few cells, and only in the cell that holds the corner of
    their overlap, so it comes out once. Few viewports are broadcast; a large table
    is shuffled by cell, which adaptive execution splits where a cell is crowded.
    """
    view = viewports.select("viewport_id", *[F.col(n).alias("v_" + n) for n in ("x", "y", "width", "height")])
    v_rect, n_rect = Rect.named("v_"), Rect.named()
    # At most TOP_LEVEL + 2 values each.
    sizes = sorted(row[0] for row in view.select(_level(v_rect)).distinct().collect())
    node_sizes = sorted(row[0] for row in nodes.select(_level(n_rect)).distinct().collect())
    node_levels = F.array_distinct(
        F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda size: F.greatest(size, _level(n_rect)))
    )
    filed_nodes = _filed(nodes, n_rect, node_levels).withColumnRenamed("_own", "_node_level")
    view_levels = F.array_distinct(
        F.transform(F.array(*map(F.lit, node_sizes)).cast("array<int>"), lambda size: F.greatest(size, _level(v_rect)))
    )
    filed_views = _filed(view, v_rect, view_levels).withColumnRenamed("_own", "_view_level")
    if len(viewports.select("viewport_id").limit(broadcast_bound + 1).take(broadcast_bound + 1)) <= broadcast_bound:
        filed_views = F.broadcast(filed_views)
    grid = F.col("_grid")
    corner_x, corner_y = F.greatest(n_rect.x, v_rect.x), F.greatest(n_rect.y, v_rect.y)
    return (
        filed_nodes.join(filed_views, ["_grid", "_cx", "_cy"])
        .where(grid == F.greatest("_node_level", "_view_level"))
        .where((_cell(corner_x, grid) == F.col("_cx")) & (_cell(corner_y, grid) == F.col("_cy")))
        .where(rects_intersect(n_rect, v_rect))
        .select("viewport_id", *nodes.columns)
    )


def viewport_nodes(nodes: DataFrame, x: float, y: float, width: float, height: float) -> DataFrame:
    """Nodes that meet one viewport: a plain filter."""
    return nodes.where(rects_intersect(Rect.named(), Rect.literal(x, y, width, height)))


def nodes_out_of_bounds(nodes: DataFrame, boundary: tuple[float, float, float, float] = INDEX_BOUNDARY) -> DataFrame:
    """All nodes, marked ``kept`` if they meet the index boundary."""
    return nodes.withColumn("kept", rects_intersect(Rect.named(), Rect.literal(*boundary)))
