"""The registered queries as SQL for the given tables, stated independently of the Spark code."""

from __future__ import annotations

from quirefold.catalog.fixtures import EPOCH, JOB_PROGRESS, JOB_STATUS, LITERAL_QUERIES
from quirefold.functions.text import DEFAULT_CHUNK_LIMIT
from quirefold.operators.layout import INDEX_BOUNDARY
from quirefold.operators.outline import DEFAULT_SCHEMA_NAME, DEFAULT_SYSTEM_PROMPT
from quirefold.operators.search import KEYWORD_WEIGHT, VECTOR_WEIGHT

_SPACE = r"[\p{Z}\t\n\x0B\f\r\x{85}]"
LF, CR = "chr(10)", "chr(13)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def strip_marks(x: str) -> str:
    return f"regexp_replace({x}, '^[# ]+|[# ]+$', '', 'g')"


def norm(x: str) -> str:
    return f"replace(replace({x}, {CR} || {LF}, {LF}), {CR}, {LF})"


def pack(x: str, limit: int = DEFAULT_CHUNK_LIMIT) -> str:
    """Greedy filling stated as a fold over the words."""
    words = f"list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: {{'p': []::VARCHAR[], 'c': w}})"
    step = (
        f"lambda a, b: CASE WHEN length(a.c) + 1 + length(b.c) > {limit} "
        "THEN {'p': list_append(a.p, a.c), 'c': b.c} ELSE {'p': a.p, 'c': a.c || ' ' || b.c} END"
    )
    folded = f"list_reduce({words}, {step})"
    return (
        f"CASE WHEN length({x}) <= {limit} OR regexp_full_match({x}, ' *') THEN [{x}] "
        f"ELSE list_append(({folded}).p, ({folded}).c) END"
    )


def quality(trimmed: str) -> str:
    return f"CASE WHEN length({trimmed}) > 240 THEN 0.92::DOUBLE WHEN length({trimmed}) > 80 THEN 0.74::DOUBLE ELSE 0.45::DOUBLE END"


def stem(path: str) -> str:
    return f"regexp_replace(regexp_extract({path}, '([^/]*)$', 1), '^(.+)\\.[^./]+$', '\\1')"


def extension(path: str) -> str:
    return f"lower(regexp_extract(regexp_extract({path}, '([^/]*)$', 1), '^.+\\.([^./]+)$', 1))"


CTE: dict[str, str] = {}

CTE["md"] = f"""SELECT doc_id AS document_id, array_to_string(list_transform(string_split(text, {LF}), lambda l, i:
  CASE WHEN (i - 1) % 5 = 0 THEN repeat('#', (1 + ((i - 1) // 5) % 3)::INT) || ' ' || l ELSE l END), {LF} || {LF}) AS md FROM documents"""

CTE["segs"] = f"""SELECT document_id, unnest(range(len(s)))::BIGINT AS segment_index, unnest(s) AS segment FROM (
  SELECT document_id, list_filter(list_transform(string_split(md, {LF} || {LF}), lambda p: {trim('p')}), lambda p: p <> '') AS s FROM md)"""

CTE["pieces"] = f"""SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY segment_index, piece_index) - 1 AS ordinal FROM (
  SELECT document_id, segment_index, segment, unnest(range(len(ps)))::BIGINT AS piece_index, unnest(ps) AS text
  FROM (SELECT *, {pack('segment')} AS ps FROM segs))"""

CTE["chunks"] = "SELECT document_id, ordinal, text FROM pieces"

CTE["heads"] = f"""SELECT document_id, segment_index, length(regexp_extract(segment, '^(#+)', 1))::BIGINT AS level,
  {trim(strip_marks('segment'))} AS title FROM segs WHERE starts_with(segment, '#') AND {trim(strip_marks('segment'))} <> ''"""

CTE["sections"] = """SELECT h.document_id, h.level, h.title, p.ordinal AS chunk_start_ordinal
  FROM heads h JOIN pieces p ON p.document_id = h.document_id AND p.segment_index = h.segment_index AND p.piece_index = 0"""

CTE["turns"] = f"SELECT conv_id AS document_id, turn AS page_index, {trim('text')} AS text FROM conversations"

CTE["lines"] = f"""SELECT doc_id AS document_id, unnest(range(len(ls)))::BIGINT AS page_index, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(text, {LF}) AS ls FROM documents)"""

CTE["pages"] = f"SELECT document_id, page_index, {trim('text')} AS text FROM lines"

CTE["pages2"] = f"""SELECT document_id, page_index,
  {trim("CASE WHEN page_index % 2 = 0 THEN text || ' ' || text ELSE text END")} AS text FROM lines"""

CTE["scores"] = f"SELECT document_id, page_index, {quality('text')} AS quality_score FROM pages"

CTE["pchunks"] = f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_index, i) - 1 AS ordinal, text,
  page_index AS source_page_index FROM (SELECT document_id, page_index, unnest(range(len(ps))) AS i, unnest(ps) AS text
  FROM (SELECT *, {pack('text')} AS ps FROM pages WHERE text <> ''))"""

CTE["tchunks"] = CTE["pchunks"].replace("FROM pages", "FROM turns")

CTE["docs"] = f"""SELECT doc_id AS document_id, source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.pdf' ELSE '.md' END AS source_path,
  'Document ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'markdown' END AS source_type,
  {EPOCH} + doc_id * 60 AS imported FROM documents"""

CTE["low"] = "SELECT document_id, page_index FROM pages WHERE document_id % 3 = 0 AND length(text) <= 80"
CTE["low2"] = "SELECT document_id, page_index FROM pages2 WHERE document_id % 3 = 0 AND length(text) <= 80"

CTE["recs"] = """SELECT d.*, coalesce(l.pages, []::BIGINT[]) AS pages FROM docs d
  LEFT JOIN (SELECT document_id, list(page_index ORDER BY page_index) AS pages FROM low GROUP BY 1) l USING (document_id)"""

CTE["still"] = "SELECT document_id, list(page_index ORDER BY page_index) AS still FROM low2 GROUP BY 1"

CTE["resolved"] = """SELECT r.*, CASE WHEN source_type = 'pdf' THEN list_filter(pages, lambda p: NOT list_contains(coalesce(still, []::BIGINT[]), p))
  ELSE []::BIGINT[] END AS resolved FROM recs r LEFT JOIN still USING (document_id)"""

CTE["applied"] = f"""SELECT document_id, title, pages AS before_pages, list_filter(pages, lambda p: NOT list_contains(resolved, p)) AS after_pages,
  CASE WHEN len(pages) > 0 THEN {EPOCH + 10**8} ELSE imported END AS imported FROM resolved"""

CTE["compared"] = """SELECT *, list_filter(before_pages, lambda p: NOT list_contains(after_pages, p)) AS gone,
  greatest(len(before_pages), len(after_pages)) AS before_count, len(after_pages) AS after_count FROM applied"""

CTE["ratios"] = """SELECT *, greatest(0, before_count - after_count) AS resolved_count,
  CASE WHEN before_count > 0 THEN greatest(0, before_count - after_count)::DOUBLE / before_count ELSE 0.0::DOUBLE END AS ratio FROM compared"""

_LITERALS = ", ".join(f"({q}, '{kw}', {v}, {k})" for q, kw, v, k in LITERAL_QUERIES)
CTE["queries"] = f"""SELECT q.query_id, q.keyword AS raw, lower({trim('q.keyword')}) AS kw, q.k, e.embedding::DOUBLE[] AS embedding FROM (
  SELECT * FROM (VALUES {_LITERALS}) t(query_id, keyword, vec_id, k)
  UNION ALL SELECT item_id + 100, ' ' || split_part(text, ' ', 1), item_id, item_id % 20 + 5 FROM benchmark) q
  LEFT JOIN embeddings e USING (vec_id)"""

CTE["kwhits"] = f"""SELECT query_id, rank, document_id, ordinal FROM (
  SELECT q.query_id, q.k, c.document_id, c.ordinal, row_number() OVER (PARTITION BY q.query_id ORDER BY c.ordinal, c.document_id) AS rank
  FROM queries q JOIN chunks c ON q.kw <> '' AND contains(lower(c.text), q.kw)) WHERE rank <= k"""

CTE["vechits"] = f"""SELECT query_id, rank, document_id, ordinal, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM (
  SELECT q.query_id, q.k, e.vec_id AS document_id, 0::BIGINT AS ordinal,
    round(list_cosine_similarity(q.embedding, e.embedding::DOUBLE[]), 6) AS score
  FROM queries q JOIN embeddings e ON q.embedding IS NOT NULL)) WHERE rank <= k"""

CTE["fused"] = f"""SELECT query_id, document_id, ordinal, coalesce({KEYWORD_WEIGHT}::DOUBLE * (1.0::DOUBLE / k.rank), 0) + coalesce({VECTOR_WEIGHT}::DOUBLE * (1.0::DOUBLE / v.rank), 0) AS score
  FROM kwhits k FULL OUTER JOIN vechits v USING (query_id, document_id, ordinal)"""

CTE["hybrid"] = f"""SELECT query_id, rank, document_id, ordinal, score FROM (
  SELECT f.*, q.k, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, ordinal) AS rank
  FROM fused f JOIN queries q USING (query_id)) WHERE rank <= k"""

CTE["ordered"] = "SELECT *, row_number() OVER (ORDER BY imported DESC, document_id) - 1 AS recency_index FROM recs"

CTE["recent"] = "SELECT * FROM ordered WHERE recency_index < 80"

CTE["some_sections"] = "SELECT * FROM sections JOIN (SELECT document_id FROM docs WHERE source_type = 'markdown') USING (document_id)"

CTE["nodes"] = """SELECT document_id || '/root' AS node_id,
    title || ' • ' || CASE WHEN len(pages) = 0 THEN 'Clean' ELSE 'LQ ' || len(pages) END AS title,
    70::DOUBLE AS x, recency_index * 300.0::DOUBLE + 80 AS y, 260::DOUBLE AS width, 62::DOUBLE AS height FROM ordered
  UNION ALL SELECT document_id || '/' || i, title, 380 + greatest(0, level - 1) * 220.0::DOUBLE, recency_index * 300.0::DOUBLE + 80 + 82 + 72 * i, 210, 52
    FROM (SELECT s.document_id, s.title, s.level, r.recency_index,
      row_number() OVER (PARTITION BY s.document_id ORDER BY s.chunk_start_ordinal) - 1 AS i
      FROM some_sections s JOIN ordered r USING (document_id))
  UNION ALL SELECT document_id || '/none', '(no outline)', 380, recency_index * 300.0::DOUBLE + 80 + 80, 180, 52
    FROM ordered WHERE document_id NOT IN (SELECT document_id FROM some_sections)"""

_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in JOB_STATUS.items())
_PROGRESS = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in JOB_PROGRESS.items())
CTE["jobs"] = f"""SELECT *, CASE status {_PROGRESS} END AS progress, 'Document ' || job_id AS document_title, 'in/' || job_id || '.md' AS source_path,
  {EPOCH} + seq * 60 AS created, CASE status WHEN 'queued' THEN 'Queued' WHEN 'parsing' THEN 'Parsing ' || job_id || '.md'
    WHEN 'indexed' THEN 'Indexed ' || seq % 40 || ' chunks' || CASE WHEN seq % 3 > 0 THEN ' (' || seq % 3 || ' pages flagged for VLM fallback)' ELSE '' END
    ELSE 'Empty markdown document' END AS message FROM (
  SELECT user_id AS job_id, event_id AS seq, CASE event_type {_CASES} END AS status FROM events)"""

CTE["rjobs"] = """SELECT *, CASE status WHEN 'queued' THEN 0.0::DOUBLE WHEN 'running' THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS progress,
  CASE status WHEN 'queued' THEN 'Queued' WHEN 'running' THEN 'Re-parsing PDF' WHEN 'failed' THEN 'PDF has no extractable text'
    ELSE 'Resolved ' || job_id % 4 || ', remaining ' || job_id % 3 END AS message,
  list_sort(list_distinct([job_id % 5, job_id % 3])) AS given FROM (
  SELECT user_id AS document_id, event_id AS job_id, ts, CASE event_type WHEN 'click' THEN 'running'
  WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status FROM events)"""

CTE["requests"] = """SELECT user_id AS document_id, min(event_id) FILTER (event_id % 2 = 0) AS first0, min(event_id) FILTER (event_id % 2 = 1) AS first1
  FROM events WHERE event_type NOT IN ('purchase', 'error') GROUP BY 1"""

CTE["legible"] = "SELECT document_id, bool_or(text <> '') AS readable FROM pages2 GROUP BY 1"

# Both micro-batches of a document: the pages before the first, between them and after the second.
CTE["runs"] = """SELECT *, CASE WHEN first0 IS NOT NULL AND readable THEN left_over ELSE pages END AS between FROM (
  SELECT r.*, first0, first1, readable, list_filter(pages, lambda p: NOT list_contains(resolved, p)) AS left_over
  FROM resolved r JOIN requests USING (document_id) JOIN legible USING (document_id))"""

CTE["newest"] = "SELECT document_id, unnest(arg_max({'s': status, 'p': progress, 'm': message, 'g': given}, (ts, job_id))) FROM rjobs GROUP BY 1"

CTE["latest"] = "SELECT document_id, arg_max(job_id, (ts, job_id)) AS job_id, arg_max(status, (ts, job_id)) AS status FROM rjobs GROUP BY 1"

_NAMES = "['.md', '.MD', '.txt', '.pdf', '.docx', '']"
CTE["files"] = f"""SELECT source || '/' || doc_id || ({_NAMES})[(doc_id % 6 + 1)::INT] AS source_path, doc_id % 10 = 7 AS broken, text,
  CASE doc_id % 6 WHEN 0 THEN 'md' WHEN 1 THEN 'md' WHEN 2 THEN 'txt' WHEN 3 THEN 'pdf' WHEN 4 THEN 'docx' ELSE '' END AS ext FROM documents"""

CTE["corpus"] = """SELECT source_path, CASE WHEN ext IN ('md', 'txt') THEN 'markdown' WHEN ext = 'pdf' THEN 'pdf' END AS source_type,
  CASE WHEN ext IN ('md', 'txt') AND NOT broken THEN text END AS text,
  CASE WHEN ext = 'pdf' THEN NULL WHEN ext NOT IN ('md', 'txt') THEN 'Unsupported file type: .' || ext WHEN broken THEN 'Unsupported text encoding' END AS reject_reason
  FROM files"""

CTE["mdlines"] = f"""SELECT document_id, unnest(range(len(ls)))::BIGINT AS line_no, unnest(ls) AS line
  FROM (SELECT document_id, string_split(md, {LF}) AS ls FROM md)"""

CTE["sk"] = f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY line_no) - 1 AS node_index, line_no,
  length(regexp_extract(line, '^(#+)', 1))::BIGINT AS level, {trim(r"regexp_extract(line, '^#+\s+(.*)$', 1, 's')")} AS topic
  FROM mdlines WHERE regexp_matches(line, '^#+\\s')"""

CTE["parents"] = """SELECT a.document_id, a.node_index, any_value(a.level) AS level, max(b.node_index) AS parent_index
  FROM sk a LEFT JOIN sk b ON b.document_id = a.document_id AND b.node_index < a.node_index AND b.level < a.level GROUP BY 1, 2"""

CTE["siblings"] = """SELECT *, row_number() OVER (PARTITION BY document_id, parent_index ORDER BY node_index) AS place FROM parents"""

CTE["paths"] = """SELECT document_id, node_index, level, place::VARCHAR AS node_id, 'root' AS parent_id FROM siblings WHERE parent_index IS NULL
  UNION ALL SELECT s.document_id, s.node_index, s.level, p.node_id || '.' || s.place, p.node_id
  FROM siblings s JOIN paths p ON p.document_id = s.document_id AND p.node_index = s.parent_index"""


def content(level: int | None) -> str:
    """Lines below each heading up to the next one that counts."""
    heading = "regexp_matches(line, '^#+\\s')"
    if level is not None:
        heading += f" AND length(regexp_extract(line, '^(#+)', 1)) <= {level}"
    return f"""SELECT document_id, node_index - 1 AS node_index, coalesce(string_agg(line, {LF} ORDER BY line_no) FILTER (NOT is_head), '') AS content,
  max(length(regexp_extract(line, '^(#+)', 1))) FILTER (is_head) AS level FROM (
  SELECT *, sum(is_head::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS node_index FROM (
  SELECT *, ({heading}) AS is_head FROM mdlines)) WHERE node_index > 0 GROUP BY 1, 2"""


CTE["content"] = content(None)
CTE["content2"] = content(2)

CTE["tree"] = """SELECT p.document_id, p.node_index, p.node_id, p.level, s.line_no, s.topic, c.content
  FROM paths p JOIN sk s USING (document_id, node_index) JOIN content c USING (document_id, node_index)"""

CTE["answers"] = """SELECT *, regexp_replace(topic, '["\\\\]', '', 'g') AS child FROM tree"""

# Which views each view reads.
_NEEDS = {
    "md": [], "segs": ["md"], "pieces": ["segs"], "chunks": ["pieces"], "heads": ["segs"], "sections": ["heads", "pieces"],
    "turns": [], "lines": [], "pages": ["lines"], "pages2": ["lines"], "scores": ["pages"], "pchunks": ["pages"],
    "tchunks": ["turns"], "docs": [], "low": ["pages"], "low2": ["pages2"], "recs": ["docs", "low"], "still": ["low2"],
    "resolved": ["recs", "still"], "applied": ["resolved"], "compared": ["applied"], "ratios": ["compared"], "queries": [],
    "kwhits": ["queries", "chunks"], "vechits": ["queries"], "fused": ["kwhits", "vechits"], "hybrid": ["fused", "queries"],
    "ordered": ["recs"], "recent": ["ordered"], "some_sections": ["sections", "docs"], "nodes": ["ordered", "some_sections"], "jobs": [], "rjobs": [],
    "latest": ["rjobs"], "newest": ["rjobs"], "requests": [], "legible": ["pages2"], "runs": ["resolved", "requests", "legible"], "files": [], "corpus": ["files"], "mdlines": ["md"], "sk": ["mdlines"], "parents": ["sk"],
    "siblings": ["parents"], "paths": ["siblings"], "content": ["mdlines"], "content2": ["mdlines"],
    "tree": ["paths", "sk", "content"], "answers": ["tree"],
}


def sql(select: str, *views: str) -> str:
    """``select`` with the named views and all they need in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    if not ordered:
        return select
    # A table of the same name is hidden by a view, so views get a prefix-free name of their own.
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS (\n  {CTE[name]})" for name in ordered) + "\n" + select


ORACLE: dict[str, str] = {}

# --- sources and sinks -------------------------------------------------------

ORACLE["read_corpus"] = sql(
    "SELECT source_path, source_type, md5(text) AS text_md5, length(text)::BIGINT AS n, reject_reason FROM corpus", "corpus")
ORACLE["route_source_type"] = sql(
    """SELECT source_path, CASE WHEN ext IN ('md', 'txt') THEN 'markdown' WHEN ext = 'pdf' THEN 'pdf' END AS source_type,
  CASE WHEN ext NOT IN ('md', 'txt', 'pdf') THEN 'Unsupported file type: .' || ext END AS reject_reason FROM files""", "files")
ORACLE["page_source"] = sql("SELECT *, text = '' AS is_empty FROM turns", "turns")
_PARA = f"list_filter(list_transform(string_split(replace(text, {LF}, {LF} || {LF}), {LF} || {LF}), lambda p: {trim('p')}), lambda p: p <> '')"
ORACLE["import_files_stream"] = f"""WITH f AS (SELECT 'in/' || doc_id || CASE WHEN doc_id % 13 = 6 THEN '.docx' ELSE '.md' END AS source_path,
  doc_id % 13 = 6 AS unknown, doc_id % 11 = 5 AS blank, {_PARA} AS segs FROM documents),
 n AS (SELECT *, list_sum(list_transform(segs, lambda s: len({pack('s')}))) AS chunks FROM f)
SELECT source_path, CASE WHEN unknown OR blank THEN 'failed' ELSE 'indexed' END AS status, 1.0::DOUBLE AS progress,
  CASE WHEN unknown THEN 'Unsupported file type: .docx' WHEN blank THEN 'Empty markdown document' ELSE 'Indexed ' || chunks::BIGINT || ' chunks' END AS message FROM n"""
ORACLE["upsert_chunks"] = sql(
    f"""SELECT document_id || '/' || ordinal AS chunk_id, document_id, ordinal,
  md5(CASE WHEN document_id % 2 = 1 THEN text || ' v1' ELSE text END) AS text_md5, {EPOCH}::BIGINT AS created,
  CASE WHEN document_id % 2 = 1 THEN {EPOCH + 3600} ELSE {EPOCH} END::BIGINT AS updated FROM chunks
UNION ALL SELECT 'new/' || document_id || '/0', document_id, ordinal, md5(text), {EPOCH + 3600}, {EPOCH + 3600} FROM chunks
  WHERE document_id % 2 = 1 AND ordinal = 0""", "chunks")
ORACLE["upsert_documents"] = sql(
    f"""SELECT document_id, source_path, CASE WHEN document_id % 2 = 1 THEN title || ' v1' ELSE title END AS title, source_type,
  to_json(pages)::VARCHAR AS low_pages, imported, (CASE WHEN document_id % 2 = 1 THEN {EPOCH + 10**8} ELSE imported END)::BIGINT AS updated FROM recs
UNION ALL SELECT document_id + 1000000000, source_path, title, source_type, to_json(pages)::VARCHAR, imported, {EPOCH + 10**8} FROM recs WHERE document_id % 2 = 1""", "recs")
ORACLE["replace_sections"] = sql(
    """SELECT * FROM sections WHERE document_id % 3 <> 0
UNION ALL SELECT document_id, 1, 'Redone', 0 FROM docs WHERE document_id % 6 = 0""", "sections", "docs")
ORACLE["evolve_schema"] = sql(
    """SELECT document_id, ordinal, NULL::BIGINT AS source_page_index, md5(text) AS text_md5 FROM chunks
UNION ALL SELECT document_id, ordinal, source_page_index, md5(text) FROM tchunks""", "chunks", "tchunks")
ORACLE["store_by_workspace"] = sql(
    """SELECT d.lang AS workspace_id, c.document_id, count(*) AS chunks, sum(c.ordinal)::BIGINT AS ordinals, sum(length(c.text))::BIGINT AS characters
FROM chunks c JOIN documents d ON d.doc_id = c.document_id GROUP BY 1, 2""", "chunks")
ORACLE["documents_interchange"] = sql(
    """SELECT document_id, title, to_json(pages)::VARCHAR AS low_pages, len(pages)::BIGINT AS pages, coalesce(list_sum(pages), 0)::BIGINT AS page_sum FROM recs""", "recs")
ORACLE["artifact_audit"] = """SELECT doc_id::VARCHAR AS model_id, sha256(text) AS actual_sha256,
  CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' ELSE 'not_found' END AS state FROM documents"""
ORACLE["outline_export"] = sql(
    f"""SELECT document_id, string_agg(repeat('  ', greatest(0, level - 1)::INT) || '• ' || title, {LF} ORDER BY i) AS outline FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_start_ordinal) AS i FROM sections) WHERE i <= 10 GROUP BY 1""", "sections")

# --- chunking ----------------------------------------------------------------

ORACLE["normalize_newlines"] = sql("SELECT document_id, md5(md) AS md_md5 FROM md", "md")
_WRAPPED = "chr(12288) || chr(160) || chr(9) || chr(11) || text || chr(133) || chr(8233) || ' ' || chr(13) || chr(10)"
ORACLE["trim_unicode"] = f"SELECT doc_id, md5({trim(_WRAPPED)}) AS text_md5, length({trim(_WRAPPED)})::BIGINT AS n FROM documents"
ORACLE["document_title"] = sql(
    f"""SELECT document_id, coalesce((list_transform(list_filter(list_transform(regexp_split_to_array(t, '[\\n\\x0B\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
  lambda l: {trim('l')}), lambda l: starts_with(l, '#')), lambda l: {strip_marks('l')}))[1], {stem('source_path')}) AS title FROM (
  SELECT document_id, source_path, CASE WHEN document_id % 9 = 1 THEN '##' || {LF} ELSE '' END ||
    CASE WHEN document_id % 4 = 0 THEN replace(md, '#', '') ELSE md END AS t FROM md JOIN docs USING (document_id))""", "md", "docs")
ORACLE["file_stem"] = sql(f"SELECT document_id, {stem('source_path')} AS stem, {extension('source_path')} AS extension FROM docs", "docs")
ORACLE["md_segments"] = sql("SELECT * FROM segs", "segs")
ORACLE["md_headings"] = sql("SELECT * FROM heads", "heads")
ORACLE["pack_words"] = f"""SELECT doc_id, unnest(range(len(ps)))::BIGINT AS piece_index, unnest(ps) AS piece
FROM (SELECT doc_id, {pack('text', 200)} AS ps FROM documents)"""
ORACLE["md_chunks"] = sql("SELECT * FROM chunks", "chunks")
ORACLE["md_sections"] = sql("SELECT * FROM sections", "sections")
ORACLE["page_quality"] = sql("SELECT * FROM scores", "scores")
ORACLE["route_pages"] = sql("SELECT *, quality_score < 0.65 AS requires_fallback FROM scores", "scores")
ORACLE["page_chunks"] = sql("SELECT * FROM pchunks", "pchunks")
ORACLE["page_sections"] = sql(
    f"SELECT document_id, 1::BIGINT AS level, {stem('source_path')} AS title, 0::BIGINT AS chunk_start_ordinal FROM docs WHERE source_type = 'pdf'", "docs")
_COUNTS = """(SELECT document_id, count(*) AS n FROM chunks WHERE document_id % 3 <> 0 GROUP BY 1
  UNION ALL SELECT document_id, count(*) FROM pchunks WHERE document_id % 3 = 0 GROUP BY 1)"""
ORACLE["document_record"] = sql(
    f"""SELECT document_id, source_path, title, source_type, coalesce(n, 0)::BIGINT AS chunk_count, to_json(pages)::VARCHAR AS low_pages,
  len(pages)::BIGINT AS fallback_page_count, imported FROM recs LEFT JOIN {_COUNTS} c USING (document_id)""", "recs", "chunks", "pchunks")
ORACLE["import_batch"] = sql(
    f"""SELECT source_path, CASE WHEN source_type = 'pdf' THEN {stem('source_path')} ELSE
  {strip_marks(f"split_part(md, {LF}, 1)")} END AS title, source_type, coalesce(n, 0)::BIGINT AS chunk_count, to_json(pages)::VARCHAR AS low_pages,
  coalesce(n, 0)::BIGINT AS stored_chunks, CASE WHEN source_type = 'pdf' THEN 1 ELSE coalesce(s, 0) END::BIGINT AS stored_sections
FROM recs JOIN md USING (document_id) LEFT JOIN {_COUNTS} c USING (document_id)
  LEFT JOIN (SELECT document_id, count(*) AS s FROM sections GROUP BY 1) USING (document_id)
WHERE CASE WHEN source_type = 'pdf' THEN n > 0 ELSE {trim('md')} <> '' END""", "recs", "md", "chunks", "pchunks", "sections")

# --- predicates --------------------------------------------------------------

ORACLE["keyword_filter"] = sql("SELECT document_id, ordinal FROM chunks WHERE contains(lower(text), 'the')", "chunks")
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["keyword_like"] = sql(f"SELECT document_id, ordinal FROM chunks WHERE {_FOLDED} LIKE '%a_e%the%'", "chunks")
ORACLE["page_filter"] = sql(
    CTE["kwhits"].replace("JOIN chunks c", "JOIN pchunks c").replace("SELECT query_id, rank, document_id, ordinal FROM", "SELECT query_id, rank, document_id, ordinal, source_page_index FROM")
    .replace("c.ordinal, row_number", "c.ordinal, c.source_page_index, row_number") + " AND source_page_index = 0", "queries", "pchunks")
ORACLE["valid_rows"] = """SELECT doc_id, document_id, source_type, CASE WHEN document_id IS NULL OR shape = 2 THEN 'malformed document_id'
  WHEN shape = 3 THEN 'unknown source_type' END AS reject_reason FROM (
  SELECT doc_id, doc_id % 5 AS shape, CASE WHEN doc_id % 5 = 3 THEN 'epub' ELSE 'markdown' END AS source_type,
  CASE doc_id % 5 WHEN 0 THEN sha256(doc_id::VARCHAR) WHEN 1 THEN upper(regexp_replace(md5(doc_id::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'))
    WHEN 2 THEN doc_id::VARCHAR WHEN 3 THEN sha256(doc_id::VARCHAR) END AS document_id FROM documents)"""
ORACLE["rect_contains"] = """SELECT event_id, coalesce(user_id >= 10 AND user_id <= 50 AND value >= 10 AND value <= 30, false) AS inside FROM events"""

# --- joins -------------------------------------------------------------------

ORACLE["chunk_section_asof"] = sql(
    """SELECT c.document_id, c.ordinal, s.title AS section_title, s.level AS section_level, s.chunk_start_ordinal AS section_start
FROM chunks c ASOF LEFT JOIN sections s ON s.document_id = c.document_id AND s.chunk_start_ordinal <= c.ordinal""", "chunks", "sections")
ORACLE["docs_with_sections"] = sql(
    "SELECT r.document_id, r.source_path, s.level, s.chunk_start_ordinal FROM recent r LEFT JOIN some_sections s USING (document_id)", "recent", "some_sections")
ORACLE["hybrid_fuse"] = sql("SELECT query_id, document_id, ordinal, round(score, 6) AS score FROM fused", "fused")
ORACLE["doc_latest_job"] = sql("SELECT document_id, job_id, status FROM docs LEFT JOIN latest USING (document_id)", "docs", "latest")
ORACLE["active_job_semi"] = sql(
    "SELECT document_id, coalesce(status IN ('queued', 'running'), false) AS busy FROM docs LEFT JOIN latest USING (document_id)", "docs", "latest")
ORACLE["viewport_join"] = """WITH n AS (SELECT l_orderkey || '/' || l_linenumber AS node_id, l_partkey * 7.0::DOUBLE AS x, l_suppkey * 131.0::DOUBLE AS y,
  l_quantity::DOUBLE AS width, l_linenumber * 10.0::DOUBLE AS height FROM lineitem),
 v AS (SELECT s_suppkey AS viewport_id, s_suppkey * 60.0::DOUBLE - 100 AS x, s_suppkey * 131.0::DOUBLE - CASE WHEN s_suppkey % 5 = 0 THEN 1e7 ELSE 0 END AS y,
  pow(2, s_suppkey % 12)::DOUBLE AS width, (s_suppkey % 4) * 50.0::DOUBLE AS height FROM supplier)
SELECT v.viewport_id, n.node_id FROM n JOIN v ON n.x <= v.x + v.width AND n.x + n.width >= v.x AND n.y <= v.y + v.height AND n.y + n.height >= v.y"""

# --- aggregations and re-parse -----------------------------------------------

ORACLE["import_summary"] = sql(
    """SELECT document_id, coalesce(c, 0)::BIGINT AS chunks, coalesce(s, 0)::BIGINT AS sections, coalesce(l, 0)::BIGINT AS fallback_pages FROM docs
  LEFT JOIN (SELECT document_id, count(*) AS c FROM chunks GROUP BY 1) USING (document_id)
  LEFT JOIN (SELECT document_id, count(*) AS s FROM sections GROUP BY 1) USING (document_id)
  LEFT JOIN (SELECT document_id, count(*) AS l FROM low GROUP BY 1) USING (document_id)""", "docs", "chunks", "sections", "low")
ORACLE["resolved_pages"] = sql(
    "SELECT document_id, source_type, to_json(pages)::VARCHAR AS requested, to_json(resolved)::VARCHAR AS resolved FROM resolved", "resolved")
ORACLE["reparse_apply"] = sql("SELECT document_id, title, to_json(after_pages)::VARCHAR AS low_pages, imported::BIGINT AS imported FROM applied", "applied")
ORACLE["reparse_comparison"] = sql(
    """SELECT document_id, before_count::BIGINT AS before_count, after_count::BIGINT AS after_count, resolved_count::BIGINT AS resolved_count,
  round(ratio, 6) AS resolved_ratio, to_json(before_pages)::VARCHAR AS before_pages, to_json(after_pages)::VARCHAR AS after_pages,
  to_json(gone)::VARCHAR AS resolved_pages, to_json(after_pages)::VARCHAR AS remaining_pages FROM ratios""", "ratios")
ORACLE["reparse_scope"] = sql(
    """SELECT document_id, 'resolved' AS scope, unnest(gone) AS page_index FROM compared
UNION ALL SELECT document_id, 'remaining', unnest(after_pages) FROM compared
UNION ALL SELECT document_id, 'input', unnest(before_pages) FROM compared""", "compared")
ORACLE["rate_percent"] = sql("SELECT document_id, round(ratio * 100)::BIGINT AS rate FROM ratios", "ratios")

# --- windows and top-k -------------------------------------------------------

ORACLE["reciprocal_rank"] = sql("SELECT query_id, document_id, ordinal, round(1.0::DOUBLE / rank, 6) AS score FROM kwhits", "kwhits")
ORACLE["recency_index"] = sql("SELECT document_id, recency_index FROM recent", "recent")
ORACLE["section_index"] = sql(
    "SELECT document_id, chunk_start_ordinal, row_number() OVER (PARTITION BY document_id ORDER BY chunk_start_ordinal) - 1 AS section_index FROM sections", "sections")
ORACLE["keyword_topk"] = sql("SELECT * FROM kwhits", "kwhits")
ORACLE["keyword_topk_like"] = sql(
    CTE["kwhits"].replace("contains(lower(c.text), q.kw)", f"{_FOLDED.replace('text', 'c.text')} LIKE '%' || {_FOLDED.replace('text', 'q.kw')} || '%'"), "queries", "chunks")
ORACLE["keyword_topk_sections"] = sql(
    """SELECT c.document_id, c.ordinal, md5(c.text) AS text_md5, s.title AS section_title, s.level AS section_level
FROM (SELECT * FROM chunks WHERE contains(lower(text), 'the') ORDER BY ordinal, document_id LIMIT 30) c
  ASOF LEFT JOIN sections s ON s.document_id = c.document_id AND s.chunk_start_ordinal <= c.ordinal""", "chunks", "sections")
ORACLE["vector_topk_stub"] = sql(
    f"""SELECT q.query_id, c.rank, c.document_id, c.ordinal FROM queries q JOIN (
  SELECT *, row_number() OVER (ORDER BY ordinal, document_id) AS rank FROM chunks) c ON q.embedding IS NOT NULL AND c.rank <= q.k""", "queries", "chunks")
ORACLE["vector_topk"] = sql("SELECT * FROM vechits", "vechits")
ORACLE["hybrid_search"] = sql("SELECT query_id, rank, document_id, ordinal, round(score, 6) AS score FROM hybrid", "hybrid")
ORACLE["recent_documents"] = sql("SELECT document_id, title, imported FROM recent", "recent")
ORACLE["sections_of_document"] = sql("SELECT * FROM sections WHERE document_id = 7", "sections")

# --- sets and report columns -------------------------------------------------

ORACLE["distinct_pages"] = sql("SELECT document_id, to_json(pages)::VARCHAR AS pages FROM recs", "recs")
ORACLE["pages_except"] = sql(
    "SELECT document_id, to_json(list_filter(pages, lambda p: NOT list_contains(still, p)))::VARCHAR AS pages FROM recs JOIN still USING (document_id)", "recs", "still")
ORACLE["result_view"] = sql(
    """SELECT query_id, rank, printf('%.3f', score) AS score_label, NULL::VARCHAR AS page_label, '#' || ordinal AS ordinal_label, md5(text) AS text_md5
FROM hybrid JOIN chunks USING (document_id, ordinal)""", "hybrid", "chunks")
ORACLE["search_with_sections"] = sql(
    """SELECT h.query_id, h.rank, h.document_id, h.ordinal, h.score_label, h.ordinal_label, h.text_md5, s.title AS section_title, s.level AS section_level
FROM (SELECT query_id, rank, document_id, ordinal, printf('%.3f', score) AS score_label, '#' || ordinal AS ordinal_label, md5(text) AS text_md5
  FROM hybrid JOIN chunks USING (document_id, ordinal)) h
  ASOF LEFT JOIN sections s ON s.document_id = h.document_id AND s.chunk_start_ordinal <= h.ordinal""", "hybrid", "chunks", "sections")
ORACLE["page_label_list"] = sql(
    """SELECT document_id, CASE WHEN len(pages) = 0 THEN 'none' ELSE array_to_string(list_transform(pages, lambda p: (p + 1)::VARCHAR), ', ') END AS pages FROM recs""", "recs")
ORACLE["quality_badge"] = sql(
    "SELECT document_id, title || ' • ' || CASE WHEN len(pages) = 0 THEN 'Clean' ELSE 'LQ ' || len(pages) END AS badge FROM recs", "recs")
ORACLE["job_message"] = sql(
    f"""SELECT document_id, 'Indexed ' || coalesce(n, 0) || ' chunks' ||
  CASE WHEN len(before_pages) > 0 THEN ' (' || len(before_pages) || ' pages flagged for VLM fallback)' ELSE '' END AS import_message,
  'Resolved ' || len(gone) || ', remaining ' || len(after_pages) AS reparse_message
FROM compared LEFT JOIN {_COUNTS} c USING (document_id)""", "compared", "chunks", "pchunks")

# --- jobs --------------------------------------------------------------------

ORACLE["job_snapshot"] = sql(
    """SELECT job_id, arg_max(status, seq) AS status, arg_max(progress, seq) AS progress, arg_max(message, seq) AS message,
  arg_min(document_title, seq) AS document_title, arg_min(source_path, seq) AS source_path, arg_min(created, seq) AS created,
  min(seq) AS enqueued, max(seq) AS updated FROM jobs GROUP BY 1""", "jobs")
ORACLE["job_snapshot_stream"] = ORACLE["job_snapshot"]
ORACLE["admit_reparse"] = """SELECT document_id, seq, low AND coalesce(previous = 'finish', true) AS admitted FROM (
  SELECT *, lag(kind) OVER (PARTITION BY document_id ORDER BY seq) AS previous FROM (
  SELECT user_id AS document_id, event_id AS seq, user_id % 7 <> 0 AS low,
    CASE WHEN event_type IN ('purchase', 'error') THEN 'finish' ELSE 'enqueue' END AS kind FROM events)) WHERE kind = 'enqueue'"""
ORACLE["admit_reparse_stream"] = ORACLE["admit_reparse"]
_RUN = """SELECT document_id || ':' || {seq} AS job_id, document_id::VARCHAR AS document_id, title AS document_title, source_path, to_json({before})::VARCHAR AS pages,
  CASE WHEN readable THEN 'completed' ELSE 'failed' END AS status, 1.0::DOUBLE AS progress,
  CASE WHEN readable THEN 'Resolved ' || len({before}) - len(left_over) || ', remaining ' || len(left_over) ELSE 'PDF has no extractable text' END AS message,
  {at}::BIGINT AS created, to_json(after)::VARCHAR AS low_pages, stored::BIGINT AS imported FROM final WHERE {seq} IS NOT NULL AND len({before}) > 0"""
CTE["final"] = f"""SELECT *, CASE WHEN readable AND (first0 IS NOT NULL OR first1 IS NOT NULL) THEN left_over ELSE pages END AS after,
  CASE WHEN NOT readable THEN imported WHEN first1 IS NOT NULL AND len(between) > 0 THEN {EPOCH + 10**8 + 1}
    WHEN first0 IS NOT NULL AND len(pages) > 0 THEN {EPOCH + 10**8} ELSE imported END AS stored FROM runs"""
_NEEDS["final"] = ["runs"]
ORACLE["reparse_job"] = sql(
    _RUN.format(seq="first0", before="pages", at=EPOCH + 10**8) + "\nUNION ALL " + _RUN.format(seq="first1", before="between", at=EPOCH + 10**8 + 1), "final")
ORACLE["job_comparison"] = sql(
    """SELECT document_id, s AS status, p AS progress, m AS message, greatest(len(g), len(pages))::BIGINT AS before_count, len(pages)::BIGINT AS after_count,
  greatest(0, greatest(len(g), len(pages)) - len(pages))::BIGINT AS resolved_count,
  round(greatest(0, greatest(len(g), len(pages)) - len(pages)) / greatest(len(g), len(pages))::DOUBLE, 6) AS resolved_ratio,
  to_json(g)::VARCHAR AS before_pages, to_json(pages)::VARCHAR AS after_pages,
  to_json(list_filter(g, lambda x: NOT list_contains(pages, x)))::VARCHAR AS resolved_pages FROM recs JOIN newest USING (document_id)""", "recs", "newest")
ORACLE["keyword_filter_stored"] = ORACLE["keyword_filter"]
ORACLE["import_outcomes"] = sql(
    f"""SELECT source_path, CASE WHEN reason IS NULL THEN 'indexed' ELSE 'failed' END AS status, 1.0::DOUBLE AS progress,
  coalesce(reason, 'Indexed ' || len({pack('text')}) || ' chunks') AS message FROM (
  SELECT *, coalesce(reject_reason, CASE WHEN source_type = 'pdf' THEN 'PDF has no extractable text' END) AS reason FROM corpus)""", "corpus")

# --- layout ------------------------------------------------------------------

ORACLE["mindmap_nodes"] = sql("SELECT * FROM nodes", "nodes")
ORACLE["viewport_nodes"] = sql("SELECT * FROM nodes WHERE x <= 630 AND x + width >= 330 AND y <= 5400 AND y + height >= 400", "nodes")
_BX, _BY, _BW, _BH = INDEX_BOUNDARY
ORACLE["nodes_out_of_bounds"] = sql(
    f"SELECT node_id, x, y, (x <= {_BX + _BW} AND x + width >= {_BX} AND y <= {_BY + _BH} AND y + height >= {_BY}) AS kept FROM nodes", "nodes")

# --- heading tree ------------------------------------------------------------

ORACLE["skeleton_nodes"] = sql("SELECT * FROM sk", "sk")
ORACLE["skeleton_parent"] = sql("SELECT document_id, node_index, level, parent_index FROM parents", "parents")
ORACLE["skeleton_path"] = sql("SELECT document_id, node_index, node_id, parent_id FROM paths", "paths")
ORACLE["skeleton_content"] = sql("SELECT document_id, node_index::BIGINT AS node_index, level::BIGINT AS level, content FROM content2", "content2")
ORACLE["skeleton_subchunks"] = sql(
    f"""SELECT document_id, node_index::BIGINT AS node_index, unnest(range(len(ps)))::BIGINT AS piece_index, unnest(ps) AS text FROM (
  SELECT document_id, node_index, {pack('t')} AS ps FROM (SELECT document_id, node_index, {trim('content')} AS t FROM content) WHERE t <> '')""", "content")
_USER = f"'Section: ' || topic || {LF} || 'Text:' || {LF} || {trim('content')} || {LF} || {LF} || 'List the key points of this section as child nodes.'"
ORACLE["refine_prompts"] = sql(
    f"""SELECT document_id, node_id, '{DEFAULT_SYSTEM_PROMPT}' AS system_prompt, {_USER} AS user_prompt, '{DEFAULT_SCHEMA_NAME}' AS schema_name
FROM tree WHERE {trim('content')} <> ''""", "tree")
ORACLE["refine_prompts_cut"] = sql(
    f"""SELECT document_id, node_id, unnest(range(len(ps)))::BIGINT AS piece_index, '{DEFAULT_SYSTEM_PROMPT}' AS system_prompt,
  'Section: ' || topic || {LF} || 'Text:' || {LF} || unnest(ps) || {LF} || {LF} || 'List the key points of this section as child nodes.' AS user_prompt,
  '{DEFAULT_SCHEMA_NAME}' AS schema_name FROM (
  SELECT document_id, node_id, topic, {pack('t', 300)} AS ps FROM (SELECT document_id, node_id, topic, {trim('content')} AS t FROM tree) WHERE t <> '')""", "tree")
ORACLE["attach_children"] = sql(
    """SELECT document_id, node_id || '/1' AS node_id, node_id AS parent_id, level + 1 AS level, child AS topic, '["one","two"]' AS details FROM answers WHERE node_index % 4 <> 3
UNION ALL SELECT document_id, node_id || '/2', node_id, level + 1, 'more', '[]' FROM answers WHERE node_index % 4 <> 3""", "answers")
ORACLE["rejected_responses"] = sql("SELECT document_id, node_id FROM answers WHERE node_index % 4 = 3", "answers")
ORACLE["tree_markdown"] = sql(
    f"""SELECT document_id, string_agg(line, {LF} ORDER BY line_no, n) AS markdown FROM (
  SELECT document_id, line_no, 0 AS n, repeat('#', level::INT) || ' ' || topic AS line FROM answers
  UNION ALL SELECT document_id, line_no, 1, repeat('#', level::INT + 1) || ' ' || child || {LF} || '- one' || {LF} || '- two' FROM answers WHERE node_index % 4 <> 3
  UNION ALL SELECT document_id, line_no, 2, repeat('#', level::INT + 1) || ' more' FROM answers WHERE node_index % 4 <> 3) GROUP BY 1""", "answers")
