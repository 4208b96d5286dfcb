"""DuckDB statements of the derived relations, for the oracle side of each query."""

TOKENS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9_ı]+|[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}]')"


def tok(column: str) -> str:
    return TOKENS.format(column)


CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, 't' || (doc_id % 3) AS tenant_id, text, source AS kb, doc_id // 6 AS logical_id, doc_id % 2 AS version_order,
    (doc_id % 2 + 1) || '.' || (doc_id % 11) AS version,
    CASE doc_id % 4 WHEN 0 THEN ['tenant'] WHEN 1 THEN ['user:u1'] WHEN 2 THEN ['role:reviewer', 'user:u2'] ELSE ['group:g1'] END AS acl,
    CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 60)::INT) END AS valid_from,
    CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-02-01' + to_days((doc_id % 60)::INT) END AS valid_until FROM documents)"""
#: What the principal of the queries may see at their instant.
SEEN = "tenant_id = 't1' AND list_has_any(acl, ['tenant', 'tenant:t1', 'user:u1', 'role:reviewer', 'group:g2'])"
VALID = "(valid_from IS NULL OR valid_from <= TIMESTAMP '2024-02-15') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-15')"
SCOPED = f"{CHUNKS}, scoped AS (SELECT * FROM chunks WHERE {SEEN} AND {VALID})"
QUERIES = "queries AS (SELECT item_id AS query_id, item_id % 4 AS category, text AS query FROM benchmark)"
TERMS = f"""qt AS (SELECT query_id, t.term, min(t.pos) - 1 AS pos FROM (SELECT query_id, unnest(list_zip(range(1, len(x) + 1), x)) AS z FROM (SELECT query_id, {tok('query')} AS x FROM queries)) s,
    LATERAL (SELECT z[2] AS term, z[1] AS pos) t GROUP BY ALL)"""


def ascii_words(column: str) -> str:
    """A text in which letters and digits beyond ASCII are underscores: RE2 knows word boundaries of ASCII words only."""
    return rf"regexp_replace({column}, '[^\P{{L}}A-Za-z]|[^\P{{N}}0-9]', '_', 'g')"


PHRASES = rf"regexp_extract_all({ascii_words('text')}, '\b[A-Z][a-zA-Z]*(?:[ -][A-Z][a-zA-Z]*){{0,2}}\b')"


def docs(source: str, where: str = "true", extra: str = "") -> str:
    """docs(chunk_id, tokens, length) of a relation."""
    return f"docs AS (SELECT chunk_id, {extra} {tok('text')} AS tokens, len({tok('text')}) AS length FROM {source} WHERE {where})"


TF = "tf AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, length, unnest(tokens) AS term FROM docs) WHERE term IN (SELECT term FROM qt) GROUP BY ALL)"


def bm25_parts(k1: float = 1.5, b: float = 0.75) -> str:
    return f"""{TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(length) AS a FROM docs),
    parts AS (SELECT query_id, chunk_id, qt.term, tf.tf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf,
        ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * ({k1} + 1) / (tf.tf + {k1} * (1 - {b} + {b} * length / a)) AS part
        FROM qt JOIN tf ON qt.term = tf.term JOIN df ON df.term = tf.term CROSS JOIN st)"""


BM25 = "scored AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL HAVING round(sum(part), 6) > 0), hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"
GOVERNED = f"{SCOPED}, {QUERIES}, {TERMS}, {docs('scoped')}, {bm25_parts()}, {BM25}"
RELEVANCE = f"""win AS (SELECT case_id, unnest(list_transform(range(1, len(t) - 11), lambda i: array_to_string(list_slice(t, i, i + 12), ' '))) AS w FROM (SELECT item_id AS case_id, {tok('text')} AS t FROM benchmark)),
    dwin AS (SELECT doc, unnest(list_transform(range(1, len(t) - 11), lambda i: array_to_string(list_slice(t, i, i + 12), ' '))) AS w FROM (SELECT doc_id AS doc, {tok('text')} AS t FROM documents)),
    relevant AS (SELECT DISTINCT case_id, doc FROM win JOIN dwin USING (w))"""
AUDIT = """audit AS (SELECT event_id AS sequence, event_id, 't' || (user_id % 3) AS tenant_id, user_id AS run_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'tool.execute' ELSE 'run.' || event_type END AS action, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS tool,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome, value AS duration_ms, (props->>'$.k')::BIGINT AS total_tokens,
    event_type = 'error' AND event_id % 2 = 0 AS safety_violation, ts AS occurred_at FROM events)"""
JOBS = """jobs AS (SELECT o_orderkey AS run_id, 't' || (o_custkey % 3) AS tenant_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'leased' ELSE 'completed' END AS status,
    o_orderpriority[1]::INT AS priority, (o_orderkey % 4)::INT AS attempt, 3 AS max_attempts, (o_orderkey % 5)::INT AS lease_version, o_orderdate AS available_at, o_orderdate AS created_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days((o_orderkey % 30)::INT) END AS lease_expires_at FROM orders)"""
MEMORY = """memory AS (SELECT conv_id || '-' || turn AS memory_id, 't1' AS tenant_id, text AS content, ['user', 'org', 'agent', 'task', 'tenant'][turn % 5 + 1] AS scope,
    CASE WHEN turn % 5 = 4 THEN 't1' WHEN conv_id % 2 = 0 THEN ['user', 'org', 'agent', 'task', 'tenant'][turn % 5 + 1][1] || '1' ELSE 'other' END AS scope_id,
    (conv_id % 10) / 10 AS importance, TIMESTAMP '2024-02-15' - to_days((turn % 40)::INT) AS updated_at,
    CASE WHEN conv_id % 3 = 0 THEN TIMESTAMP '2024-02-15' + to_days((conv_id % 5 - 2)::INT) END AS expires_at FROM conversations)"""
PASSAGES = """passages AS (SELECT *, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM (
    SELECT document_id, idx, idx * 900 AS start, substring(body, idx * 900 + 1, 1000) AS text, document_id || '::chunk::' || lpad(idx::VARCHAR, 4, '0') AS chunk_id FROM (
    SELECT doc_id AS document_id, text AS body, unnest(range(CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 900)::BIGINT + 1 END)) AS idx FROM documents WHERE length(text) > 0))
    WINDOW w AS (PARTITION BY document_id ORDER BY idx))"""
