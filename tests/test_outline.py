import json
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from quirefold.operators import outline as O

DOC = "document_id long, md string"


def heading(line):
    """Level and topic of a heading line, else None."""
    marks = len(line) - len(line.lstrip("#"))
    return (marks, line[marks:].strip()) if marks and line[marks : marks + 1] in (" ", "\t") else None


def expected_nodes(text, max_level=None):
    """By definition: the parent is the nearest earlier heading of a smaller level."""
    lines = text.split("\n")
    found = [(no, *heading(line)) for no, line in enumerate(lines) if heading(line)]
    found = [f for f in found if max_level is None or f[1] <= max_level]
    parents = [next((j for j in range(i - 1, -1, -1) if found[j][1] < found[i][1]), None) for i in range(len(found))]
    paths, nodes = [], []
    for i, (no, level, topic) in enumerate(found):
        number = str(parents[: i + 1].count(parents[i]))
        paths.append(number if parents[i] is None else paths[parents[i]] + "." + number)
        end = found[i + 1][0] if i + 1 < len(found) else len(lines)
        nodes.append({"line": no, "level": level, "topic": topic, "parent": parents[i], "path": paths[i], "content": "\n".join(lines[no + 1 : end])})
    return nodes


def test_tree_by_definition(spark):
    rng = random.Random(11)
    texts = ["", "no heading", "#tag\n# A\n#\tB  \n##  \ntext\n\n####### deep\nx\n# C"]
    for _ in range(60):
        texts.append("\n".join(rng.choice(["#" * rng.randint(1, 9) + f" h{i}", f"line {i}", "", "#nospace"]) for i in range(rng.randint(1, 80))))
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    for max_level in (None, 3):
        got = {}
        for r in O.skeleton(docs, max_level=max_level).orderBy("document_id", "node_index").collect():
            got.setdefault(r["document_id"], []).append(
                {"line": r["line_no"], "level": r["level"], "topic": r["topic"], "parent": r["parent_index"], "path": r["node_id"], "content": r["content"]}
            )
        for i, text in enumerate(texts):
            assert got.get(i, []) == expected_nodes(text, max_level), (i, max_level)
    flat = O.skeleton_nodes(docs).count()
    assert flat == O.skeleton_content(docs).count() == sum(len(expected_nodes(t)) for t in texts)


def seconds_of(function, *values):
    began = time.perf_counter()
    function(*values)
    return time.perf_counter() - began


def test_a_million_headings_in_linear_time():
    levels = np.random.default_rng(2).integers(1, 7, 1_000_000)
    build = lambda own: O.path_ids(O.nearest_smaller(own))
    build(levels[:1000])
    small, large = seconds_of(build, levels[:100_000]), seconds_of(build, levels)
    assert large < 60 and large < 40 * max(small, 0.05)


def test_one_document_of_many_headings(spark):
    """A chain of 300 levels, and 60,000 headings in one row."""
    chain = "\n".join("#" * i + " h" for i in range(1, 301))
    flat = "\n".join("#" * (1 + i % 3) + f" h{i}" for i in range(60_000))
    nodes = O.skeleton(spark.createDataFrame([(1, chain), (2, flat)], DOC))
    deepest = nodes.where("document_id = 1 AND node_index = 299").first()
    assert deepest["node_id"] == ".".join(["1"] * 300) and deepest["parent_index"] == 298
    last = nodes.where("document_id = 2 AND node_index = 59999").first()
    assert last["node_id"] == "20000.1.1" and last["parent_id"] == "20000.1"


def test_subchunks_and_prompts(spark):
    long = " ".join(["word"] * 100)
    docs = spark.createDataFrame([(1, f"lost\n# A\n\n{long}\n## B\n\n# C\nshort")], DOC)
    nodes = O.skeleton(docs)
    pieces = O.skeleton_subchunks(nodes, limit=200, key="node_id").orderBy("node_id", "piece_index").collect()
    assert [(p["node_id"], p["piece_index"]) for p in pieces] == [("1", 0), ("1", 1), ("1", 2), ("2", 0)]
    prompts = {r["node_id"]: r for r in O.refine_prompts(nodes, user_template="%s|%s").collect()}
    assert set(prompts) == {"1", "2"} and prompts["2"]["user_prompt"] == "C|short"
    assert prompts["1"]["system_prompt"] == O.DEFAULT_SYSTEM_PROMPT
    cut = O.refine_prompts(nodes, user_template="%s|%s", limit=200).orderBy("node_id", "piece_index").collect()
    assert [(r["node_id"], r["piece_index"]) for r in cut] == [("1", 0), ("1", 1), ("1", 2), ("2", 0)]
    # Only the levels visit Python, in Arrow batches.
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and re.search(r"ArrowEvalPython \[_places\(nodes#\d+\.level\)", plan)


def test_children_and_markdown(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\nz")], DOC)
    nodes = O.skeleton(docs)
    answers = [
        (1, "1", json.dumps([{"topic": "p", "details": ["d1", "d2"]}, {"topic": "q"}])), (1, "1.1", "[{broken"), (1, "2", "[]"), (1, "9", json.dumps([{"topic": "nobody"}])),
    ]
    responses = spark.createDataFrame(answers, "document_id long, node_id string, response string")
    children = O.attach_children(nodes, responses)
    assert [(r["node_id"], r["parent_id"], r["level"], r["topic"], r["details"]) for r in children.orderBy("node_id").collect()] == [
        ("1/1", "1", 2, "p", ["d1", "d2"]), ("1/2", "1", 2, "q", []),
    ]
    assert [r["node_id"] for r in O.rejected_responses(responses).collect()] == ["1.1"]
    text = O.tree_markdown(O.tree_lines(nodes, children), block=2).first()["markdown"]
    assert text == "# A\n## p\n- d1\n- d2\n## q\n## B\n# C"
    answered = O.refine(O.refine_prompts(nodes), lambda system, user: F.lit('[{"topic":"t","details":["d"]}]'))
    assert O.attach_children(nodes, answered).count() == 3
    assert O.tree_markdown(O.tree_lines(nodes)).first()["markdown"] == "# A\n## B\n# C"
