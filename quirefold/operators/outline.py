"""Heading trees: nodes, parents, path ids, content, prompts, attached children, Markdown.

A document is one row; its lines, headings and the text between them are arrays of
that row, so building the tree needs no shuffle. Only the levels of the headings visit Python,
in Arrow batches; text never does.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions import text as X

# A heading line: marks, then white space.
HEADING_LINE = r"^#+[\p{Z}\t\x0B\f\r\x{85}]"

DEFAULT_SYSTEM_PROMPT = (
    "You build mind maps from documents. Answer with a JSON list of objects "
    '{"topic": string, "details": [string]} and nothing else.'
)
DEFAULT_USER_TEMPLATE = "Section: %s\nText:\n%s\n\nList the key points of this section as child nodes."
DEFAULT_SCHEMA_NAME = "mindmap_children"

CHILDREN_TYPE = "array<struct<topic:string,details:array<string>>>"


def _lines(text: Column) -> Column:
    return F.split(X.normalize_newlines(text), "\n", -1)


def _headings(lines: Column, max_level: int | None) -> Column:
    """Heading lines as structs ``(line_no, level, topic)``, line numbers from 0."""
    numbered = F.transform(lines, lambda line, no: F.struct(no.alias("line_no"), line.alias("line")))
    marked = F.filter(numbered, lambda item: item["line"].rlike(HEADING_LINE))

    def describe(item: Column) -> Column:
        rest = F.ltrim(item["line"], F.lit("#"))
        return F.struct(
            item["line_no"].alias("line_no"),
            (F.char_length(item["line"]) - F.char_length(rest)).alias("level"),
            X.trim_unicode(rest).alias("topic"),
        )

    headings = F.transform(marked, describe)
    return headings if max_level is None else F.filter(headings, lambda item: item["level"] <= max_level)


def _with_content(lines: Column, headings: Column) -> Column:
    """Headings with the lines up to the next heading, joined by LF."""

    def body(both: Column) -> Column:
        def of_heading(item: Column, index: Column) -> Column:
            last = F.coalesce(F.try_element_at(both["headings"], index + 2)["line_no"], F.size(both["lines"]))
            own = F.slice(both["lines"], item["line_no"] + 2, last - item["line_no"] - 1)
            return F.struct(
                item["line_no"].alias("line_no"),
                item["level"].alias("level"),
                item["topic"].alias("topic"),
                F.array_join(own, "\n").alias("content"),
            )

        return F.transform(both["headings"], of_heading)

    return X.let(F.struct(lines.alias("lines"), headings.alias("headings")), body)


PLACES = T.StructType([
    T.StructField("parents", T.ArrayType(T.IntegerType())), T.StructField("paths", T.ArrayType(T.StringType())),
])


def nearest_smaller(levels: np.ndarray) -> np.ndarray:
    """For each heading the place of the latest earlier one of a smaller level, -1 without one.

    The latest heading of each level before a place is a running maximum; a parent is the
    greatest of those of the smaller levels. Each level takes one pass, whatever the number of headings.
    """
    places = np.arange(len(levels), dtype=np.int32)
    parents = np.full(len(levels), -1, np.int32)
    below = np.full(len(levels), -1, np.int32)  # latest heading so far of the levels gone through
    for level in np.unique(levels):
        own = levels == level
        parents[own] = below[own]
        np.maximum(below, np.maximum.accumulate(np.where(own, places, -1)), out=below)
    return parents


def path_ids(parents: np.ndarray) -> np.ndarray:
    """Path of each heading: the path of its parent and its number among the children, joined by a dot."""
    order = np.argsort(parents, kind="stable")
    grouped = parents[order]
    first = np.searchsorted(grouped, grouped)
    numbers = np.empty(len(parents), np.int64)
    numbers[order] = np.arange(len(parents)) - first + 1
    paths = numbers.astype(str).astype(object)
    # Generation by generation: the paths of the parents are whole when their children's are joined.
    generation = np.flatnonzero(parents < 0)
    while len(generation):
        ends = np.searchsorted(grouped, generation, side="right")
        starts = np.searchsorted(grouped, generation, side="left")
        counts = ends - starts
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        children = order[np.repeat(starts, counts) + within]
        paths[children] = paths[parents[children]] + "." + paths[children]
        generation = children
    return paths


@F.pandas_udf(PLACES)
def _places(levels: pd.Series) -> pd.DataFrame:
    """Parent position and path id of each heading, from the heading levels of a document."""
    parents = [nearest_smaller(np.asarray(own, np.int32)) for own in levels]
    return pd.DataFrame({"parents": parents, "paths": [path_ids(p) for p in parents]})


def skeleton_nodes(docs: DataFrame, text: str = "md", max_level: int | None = None) -> DataFrame:
    """Heading lines in order: ``(document_id, node_index, line_no, level, topic)``."""
    return docs.select(
        "document_id", F.posexplode(_headings(_lines(F.col(text)), max_level)).alias("node_index", "n")
    ).select("document_id", "node_index", "n.line_no", "n.level", "n.topic")


def skeleton_content(docs: DataFrame, text: str = "md", max_level: int | None = None) -> DataFrame:
    """Nodes with the text below each heading; lines before the first heading are dropped."""

    def nodes(lines: Column) -> Column:
        return _with_content(lines, _headings(lines, max_level))

    return docs.select(
        "document_id", F.posexplode(X.let(_lines(F.col(text)), nodes)).alias("node_index", "n")
    ).select("document_id", "node_index", "n.line_no", "n.level", "n.topic", "n.content")


def skeleton(docs: DataFrame, text: str = "md", max_level: int | None = None) -> DataFrame:
    """Full node table: ``skeleton_content`` plus ``node_id`` (path) and ``parent_id``."""

    def nodes(lines: Column) -> Column:
        return _with_content(lines, _headings(lines, max_level))

    listed = docs.select("document_id", X.let(_lines(F.col(text)), nodes).alias("nodes")).where(F.size("nodes") > 0)
    placed = listed.withColumn("places", _places(F.col("nodes.level")))
    rows = placed.select(
        "document_id", F.posexplode(F.arrays_zip("nodes", "places.parents", "places.paths")).alias("node_index", "z")
    )
    parent = F.col("z.parents")
    return rows.select(
        "document_id",
        "node_index",
        F.col("z.nodes.line_no").alias("line_no"),
        F.col("z.nodes.level").alias("level"),
        F.col("z.nodes.topic").alias("topic"),
        F.col("z.nodes.content").alias("content"),
        F.when(parent >= 0, parent).alias("parent_index"),
        F.col("z.paths").alias("node_id"),
        F.when(parent >= 0, F.regexp_replace(F.col("z.paths"), r"\.[0-9]+$", "")).otherwise(F.lit("root")).alias("parent_id"),
    )


def skeleton_subchunks(nodes: DataFrame, limit: int = X.DEFAULT_CHUNK_LIMIT, key: str = "node_index") -> DataFrame:
    """Content of each node cut to pieces that keep the node's id; blank content gives none."""
    content = X.trim_unicode(F.col("content"))
    return nodes.where(content != "").select(
        "document_id", key, F.posexplode(X.pack_words(content, limit)).alias("piece_index", "text")
    )


def refine_prompts(
    nodes: DataFrame,
    system_prompt: str = DEFAULT_SYSTEM_PROMPT,
    user_template: str = DEFAULT_USER_TEMPLATE,
    schema_name: str = DEFAULT_SCHEMA_NAME,
    limit: int | None = None,
) -> DataFrame:
    """One request per node with content, for an external scorer.

    With ``limit`` content is cut to pieces of at most that length and each piece is a
    request of its own under the node's id, told apart by ``piece_index``.
    """
    content = X.trim_unicode(F.col("content"))
    pieces = F.array(content) if limit is None else X.pack_words(content, limit)
    rows = nodes.where(content != "").select("document_id", "node_id", "topic", F.posexplode(pieces).alias("piece_index", "piece"))
    numbered = [] if limit is None else ["piece_index"]
    return rows.select(
        "document_id",
        "node_id",
        *numbered,
        F.lit(system_prompt).alias("system_prompt"),
        F.format_string(user_template, F.col("topic"), F.col("piece")).alias("user_prompt"),
        F.lit(schema_name).alias("schema_name"),
    )


def refine(prompts: DataFrame, answer: Callable[[Column, Column], Column]) -> DataFrame:
    """Responses of a scorer, given as a function of the two prompt columns (any Column, also a pandas UDF)."""
    return prompts.select(
        "document_id", "node_id", answer(F.col("system_prompt"), F.col("user_prompt")).alias("response")
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses with their list of children; null where the JSON cannot be read."""
    return responses.withColumn("children", F.from_json("response", CHILDREN_TYPE, {"mode": "PERMISSIVE"}))


def rejected_responses(responses: DataFrame) -> DataFrame:
    return parse_responses(responses).where(F.col("children").isNull()).drop("children")


def attach_children(nodes: DataFrame, responses: DataFrame) -> DataFrame:
    """Child rows for the nodes that got a readable response."""
    parents = nodes.select("document_id", "node_id", "line_no", F.col("level").alias("parent_level"))
    listed = parse_responses(responses).where(F.col("children").isNotNull()).select("document_id", "node_id", "children")
    rows = listed.join(parents, ["document_id", "node_id"]).select(
        "document_id", "node_id", "line_no", "parent_level", F.posexplode("children").alias("child_index", "child")
    )
    return rows.where(F.col("child.topic").isNotNull()).select(
        "document_id",
        F.concat(F.col("node_id"), F.lit("/"), (F.col("child_index") + 1).cast("string")).alias("node_id"),
        F.col("node_id").alias("parent_id"),
        "line_no",
        (F.col("child_index") + 1).alias("child_no"),
        (F.col("parent_level") + 1).alias("level"),
        F.col("child.topic").alias("topic"),
        F.coalesce("child.details", F.array().cast("array<string>")).alias("details"),
    )


def tree_lines(nodes: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """The tree as Markdown lines in document order: ``(document_id, line_no, child_no, line)``.

    Attached children follow their node; their details are list items below them.
    """
    heading = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("topic"))
    own = nodes.select("document_id", "line_no", F.lit(0).alias("child_no"), heading.alias("line"))
    if children is None:
        return own
    items = F.transform("details", lambda detail: F.concat(F.lit("- "), detail))
    lines = F.array_join(F.concat(F.array(heading), items), "\n")
    return own.unionByName(children.select("document_id", "line_no", "child_no", lines.alias("line")))


def tree_markdown(lines: DataFrame, block: int = 4096) -> DataFrame:
    """One Markdown text per document, joined in blocks of lines first."""
    parts = (
        lines.withColumn("_block", F.floor(F.col("line_no") / F.lit(block)))
        .groupBy("document_id", "_block")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "child_no", "line"))).alias("_lines"))
        .select("document_id", "_block", F.array_join("_lines.line", "\n").alias("_text"))
    )
    return parts.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_text"))).alias("_parts")
    ).select("document_id", F.array_join("_parts._text", "\n").alias("markdown"))
