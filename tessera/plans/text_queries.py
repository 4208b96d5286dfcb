"""Tokenisers, chunking, structure, redaction and line tools."""

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking
from ..operators import operations as ops
from ..sources import corpus as c
from . import sql
from .catalog import query


def _docs(spark, d):
    return c.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")


@query(f"SELECT doc_id AS document_id, len(x) AS n_tokens, md5(array_to_string(x, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql.tok('text')} AS x FROM documents)")
def tokenise(spark, d):
    x = t.tokens(F.col("text"))
    return _docs(spark, d).select("document_id", F.size(x).alias("n_tokens"), F.md5(F.array_join(x, " ")).alias("tokens_md5"))


@query(r"SELECT doc_id AS document_id, len(x) AS n_tokens, md5(lower(array_to_string(x, ' '))) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[\x{3400}-\x{9FFF}]') AS x FROM documents)")
def tokenise_baseline(spark, d):
    x = t.baseline_tokens(F.col("text"))
    return _docs(spark, d).select("document_id", F.size(x).alias("n_tokens"), F.md5(F.array_join(x, " ")).alias("tokens_md5"))


@query(r"SELECT conv_id, turn, array_to_string(regexp_extract_all(replace(lower(text), ',', ''), '[A-Za-z0-9]+|[\x{3400}-\x{9FFF}]'), ' ') AS answer FROM conversations")
def answer_normal_form(spark, d):
    return c.table(spark, d, "conversations").select("conv_id", "turn", t.normal_answer(F.col("text")).alias("answer"))


@query(
    f"SELECT doc_id AS document_id, len(x) AS n_phrases, md5(array_to_string(list_sort(x), '|')) AS phrases_md5 FROM (SELECT doc_id, list_distinct({sql.PHRASES}) AS x FROM documents)"
)
def phrases(spark, d):
    x = t.phrases(F.col("text"))
    return _docs(spark, d).select("document_id", F.size(x).alias("n_phrases"), F.md5(F.array_join(F.array_sort(x), "|")).alias("phrases_md5"))


@query("SELECT doc_id AS document_id, (unnest(range(CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 900)::BIGINT + 1 END)))::INT AS idx, md5(substring(text, idx * 900 + 1, 1000)) AS text_md5 FROM documents WHERE length(text) > 0")
def hard_split(spark, d):
    return chunking.hard_split(_docs(spark, d)).select("document_id", "idx", F.md5("text").alias("text_md5"))


@query(f"WITH {sql.PASSAGES} SELECT chunk_id, previous_id, next_id FROM passages")
def block_links(spark, d):
    return c.passages(spark, d).select("chunk_id", "previous_id", "next_id")


_BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]"


@query(
    rf"""WITH RECURSIVE p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')), lambda x: x <> '') AS ps FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)),
    r AS (SELECT doc_id, ps, 0 AS i, '' AS cur, []::VARCHAR[] AS emit FROM p WHERE len(ps) > 0
      UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(x) > 600 THEN '' WHEN cur = '' THEN x WHEN length(cur) + 1 + length(x) <= 600 THEN cur || chr(10) || x ELSE right(cur, 100) || chr(10) || x END,
        CASE WHEN length(x) > 600 THEN list_concat(CASE WHEN cur <> '' THEN [cur] ELSE [] END, list_transform(range(0, ceil((length(x) - 600) / 500)::BIGINT + 1), lambda k: substring(x, k * 500 + 1, 600))) WHEN cur <> '' AND length(cur) + 1 + length(x) > 600 THEN [cur] ELSE [] END
      FROM (SELECT *, ps[i + 1] AS x FROM r WHERE i < len(ps))),
    e AS (SELECT doc_id, i, unnest(emit) AS text, generate_subscripts(emit, 1) AS j FROM r UNION ALL SELECT doc_id, i + 1, cur, 1 FROM r WHERE i = len(ps) AND cur <> '' UNION ALL SELECT doc_id, 0, text, 1 FROM p WHERE len(ps) = 0)
    SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS idx, md5(text) AS text_md5 FROM e"""
)
def paragraph_chunks(spark, d):
    chunks = chunking.paragraph_chunks(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), 600, 100)
    return _docs(spark, d).select("document_id", F.posexplode(chunks).alias("idx", "text")).withColumn("text_md5", F.md5("text")).drop("text")


#: The level of a heading line.
_HEAD = r"""CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN length(regexp_extract(line, '^(#+)', 1)) WHEN regexp_matches(line, '^(?:\d+(?:\.\d+){0,5}|[一二三四五六七八九十]+)[.、：:\s]+\S') AND length(line) <= 160 THEN CASE WHEN regexp_extract(line, '^(\d+(?:\.\d+)*)', 1) = '' THEN 1 ELSE least(6, len(string_split(regexp_extract(line, '^(\d+(?:\.\d+)*)', 1), '.'))) END WHEN length(line) BETWEEN 1 AND 100 AND regexp_matches(line, '\p{L}') AND line = upper(line) AND NOT contains(line, 'ß') AND NOT regexp_matches(line, '[。！？.!?；;]$') THEN 1 END"""


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
    h AS (SELECT *, ((_HEAD_) IS NOT NULL)::INT AS is_head FROM l),
    s AS (SELECT *, sum(is_head) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)
    SELECT doc_id AS document_id, section::BIGINT AS section, min(n)::INT AS first_line, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM s GROUP BY ALL""".replace("_HEAD_", _HEAD)
)
def heading_groups(spark, d):
    return chunking.sections(_docs(spark, d))


@query(
    r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t]+', ' ', 'g')) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), h AS (SELECT *, _HEAD_ AS level FROM l),
    o AS (SELECT *, level IS NOT NULL OR lag(line = '' OR level IS NOT NULL OR regexp_matches(line, '[。！？.!?；;]$'), 1, true) OVER (PARTITION BY doc_id ORDER BY n) AS opens FROM h),
    g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM o)
    SELECT doc_id AS document_id, block::BIGINT AS block, min(n)::INT AS first_line, max(level)::INT AS level, md5(string_agg(line, ' ' ORDER BY n)) AS text_md5 FROM g WHERE line <> '' GROUP BY ALL""".replace("_HEAD_", _HEAD)
)
def page_groups(spark, d):
    return chunking.page_groups(_docs(spark, d)).withColumn("text_md5", F.md5("text")).drop("text")


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id AS document_id, n::INT AS line_no, line[:500] AS line FROM l WHERE regexp_matches(line, '(?i)licen[cs]ed? under')")
def grep_lines(spark, d):
    return chunking.grep(_docs(spark, d), r"licen[cs]ed? under", ignore_case=True)


@query("SELECT doc_id AS document_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS body, len(string_split(text, chr(10))) > 4 AS truncated FROM documents")
def read_lines(spark, d):
    lines = F.split("text", "\n")
    return _docs(spark, d).select("document_id", F.array_join(F.slice(lines, 2, 3), "\n").alias("body"), (F.size(lines) > 4).alias("truncated"))


#: RE2 has no look-behind: what stands before a word is matched with it and put back.
_BEFORE = r"(^|[^\p{L}\p{N}_])"
_VALUE = ops.SECRET_VALUE.replace(r"(?:\bBearer", r"(?:\bBearer").replace(r"\b", _BEFORE).replace("'", "''")
_ASSIGNED = ops.SECRET_ASSIGNMENT.replace(r"\b", _BEFORE)
_STRIP = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


@query(f"SELECT doc_id AS document_id, regexp_matches(text, '{_VALUE}') AS secret_like FROM documents")
def secret_scan(spark, d):
    return _docs(spark, d).select("document_id", ops.secret_like(F.col("text")).alias("secret_like"))


@query(f"SELECT doc_id AS document_id, md5(left(regexp_replace(regexp_replace(regexp_replace(text, '{_VALUE}', '\\1\\2\\3[REDACTED]', 'g'), '{_ASSIGNED}', '\\1\\2=[REDACTED]', 'g'), '{_STRIP}', '', 'g'), 500)) AS redacted_md5 FROM documents")
def redact(spark, d):
    return _docs(spark, d).select("document_id", F.md5(ops.redacted(F.col("text"))).alias("redacted_md5"))


@query(f"""SELECT event_id, len(list_filter(regexp_extract_all(j, '"((?:[^"\\\\]|\\\\.)*)"\\s*:', 1), lambda k: regexp_matches(k, '{ops.SECRET_KEY}'))) > 0 OR regexp_matches(j, '{_VALUE}') AS secret
    FROM (SELECT event_id, '{{"a":[{{"' || CASE event_id % 4 WHEN 0 THEN 'api_key' WHEN 1 THEN 'apikeys' WHEN 2 THEN 'note' ELSE 'user-token' END || '": ' || props || '}}],"b":"' || CASE WHEN event_id % 7 = 0 THEN 'password: hunter' ELSE event_type END || '"}}' AS j FROM events)""")
def secret_tree(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("api_key", "apikeys", "note", "user-token"))), (F.col("event_id") % 4 + 1).cast("int"))
    tree = F.concat(F.lit('{"a":[{"'), name, F.lit('": '), "props", F.lit('}],"b":"'), F.when(F.col("event_id") % 7 == 0, "password: hunter").otherwise(F.col("event_type")), F.lit('"}'))
    return c.table(spark, d, "events").select("event_id", ops.secret_tree(tree).alias("secret"))


@query(r"SELECT doc_id AS document_id, md5(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t\x0B\x0C\x1c-\x1f\x85\p{Z}]+$', '', 'g')) AS plain_md5, md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x0B\x1c-\x1f\x85\p{Z}]', '', 'g')) AS key_md5 FROM documents")
def plain_texts(spark, d):
    return _docs(spark, d).select("document_id", F.md5(t.plain(F.col("text"))).alias("plain_md5"), F.md5(t.comparison_key(F.col("text"))).alias("key_md5"))


@query("SELECT event_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS id FROM (SELECT event_id, sha1('\\x6B\\xA7\\xB8\\x11\\x9D\\xAD\\x11\\xD1\\x80\\xB4\\x00\\xC0\\x4F\\xD4\\x30\\xC8'::BLOB || ('event:' || event_id)::BLOB) AS h FROM events)")
def name_uuids(spark, d):
    return c.table(spark, d, "events").select("event_id", t.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("event:"), "event_id")).alias("id"))


@query(r"SELECT page_id, path <> '' AND NOT regexp_matches(path, '^(?:/|~|[A-Za-z]:)|[\\\x00]|(?:^|/)\.\.(?:/|$)') AS safe, regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS slug FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '../' WHEN 1 THEN '/' ELSE '' END || coalesce(split_part(url, '://', 2), '') AS path, coalesce(split_part(split_part(url, '://', 2), '/', 1), '') AS name FROM pages)")
def path_checks(spark, d):
    rest = F.coalesce(F.split_part("url", F.lit("://"), F.lit(2)), F.lit(""))
    path = F.concat(F.when(F.col("page_id") % 5 == 0, "../").when(F.col("page_id") % 5 == 1, "/").otherwise(""), rest)
    return c.table(spark, d, "pages").select("page_id", t.safe_path(path).alias("safe"), t.slug(F.split_part(rest, F.lit("/"), F.lit(1))).alias("slug"))


@query(
    r"""WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM conversations),
    s AS (SELECT conv_id, turn, words, 1 AS i, 1 AS lines, length(words[1]) AS used FROM w WHERE len(words) > 0
      UNION ALL SELECT conv_id, turn, words, i + 1, CASE WHEN used + 1 + length(words[i + 1]) <= 60 THEN lines ELSE lines + 1 END, CASE WHEN used + 1 + length(words[i + 1]) <= 60 THEN used + 1 + length(words[i + 1]) ELSE length(words[i + 1]) END FROM s WHERE i < len(words)),
    l AS (SELECT conv_id, turn, lines, string_agg(words[i], ' ' ORDER BY i) AS line FROM s GROUP BY ALL)
    SELECT conv_id, turn, max(lines)::INT AS n_lines, md5(string_agg(line, chr(10) ORDER BY lines)) AS lines_md5 FROM l GROUP BY ALL"""
)
def wrapped_lines(spark, d):
    lines = chunking.wrapped(F.col("text"), 60)
    return c.table(spark, d, "conversations").select("conv_id", "turn", F.size(lines).alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("lines_md5")).where("n_lines > 0")


@query("SELECT l_orderkey AS page, l_linenumber AS block_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 5, l_partkey % 4, l_partkey % 2, l_linenumber)::INT AS reading_order FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)")
def layout_order(spark, d):
    lines = c.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    blocks = lines.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block_id"), (F.col("s") % 5).alias("top"), (F.col("p") % 4).alias("x0"), F.when(F.col("p") % 2 == 0, "paragraph").otherwise("table").alias("kind"))
    return chunking.layout_order(blocks).select("page", "block_id", "reading_order")


@query("SELECT n_nationkey AS id, '| ' || n_name || ' | ' || n_regionkey || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a\\|b |  |' AS markdown FROM nation")
def table_render(spark, d):
    rows = F.array(F.array("n_name", F.col("n_regionkey").cast("string")), F.array(F.lit(" a|b ")))
    return c.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), chunking.table_markdown(rows).alias("markdown"))


@query("SELECT doc_id AS document_id, substring(sha256(source || ':' || doc_id || ':' || text), 1, 24) AS chunk_key, length(text[:300]) - length(replace(text[:300], chr(10), '')) + 1 AS line_no FROM documents")
def content_ids(spark, d):
    head = F.substring("text", 1, 300)
    key = F.substring(F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string"), "text"), 256), 1, 24)
    return c.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), key.alias("chunk_key"), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line_no"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(list_concat([trim(regexp_replace(q, '\\s+', ' ', 'g'))], list_transform(regexp_extract_all(q, '''([^'']+)''', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))))), '|') AS parts FROM (SELECT item_id, 'Who said ''' || text[:20] || ''' first' AS q FROM benchmark)")
def quoted_subqueries(spark, d):
    q = F.concat(F.lit("Who said '"), F.substring("text", 1, 20), F.lit("' first"))
    return c.table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(t.subqueries(q)), "|").alias("parts"))
