"""DuckDB SQL for the registered queries: the same results by another engine's means."""

from __future__ import annotations

from .operators.resolve import BUILTIN_EXCEPTIONS

NATION = "AFRICA.NATION_0"

_BASE = {
    "nations": "SELECT n_nationkey, r_name || '.' || n_name AS nation_id FROM nation JOIN region ON n_regionkey = r_regionkey",
    "customers": "SELECT c_custkey, nation_id || '.' || c_name AS customer_id FROM customer JOIN nations ON c_nationkey = n_nationkey",
    "suppliers": "SELECT s_suppkey, nation_id || '.' || s_name AS supplier_id FROM supplier JOIN nations ON s_nationkey = n_nationkey",
    "parts": "SELECT p_partkey, 'catalog.' || p_brand || '.P' || p_partkey AS part_id, 'catalog.' || p_brand AS brand_id FROM part",
    "ords": "SELECT o_orderkey, customer_id || '.O' || o_orderkey AS order_id FROM orders JOIN customers ON o_custkey = c_custkey",
    "turns": "SELECT conv_id, turn, 'conv.' || conv_id || '.t' || turn AS turn_id FROM conversations",
    "links": "SELECT DISTINCT 'page.' || page_id AS src, 'url:' || href AS dst, 'page.' || page_id AS chunk_id FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)",
    "supplies": "SELECT DISTINCT supplier_id AS src, part_id AS dst, l_orderkey || ':' || l_linenumber AS chunk_id FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey JOIN parts ON l_partkey = p_partkey",
    "contained": "SELECT DISTINCT order_id AS src, part_id AS dst, l_orderkey || ':' || l_linenumber AS chunk_id FROM lineitem JOIN ords ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey",
    "nexts": "SELECT b AS src, event_type AS dst, CAST(event_id AS VARCHAR) AS chunk_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL",
    "trans": "SELECT DISTINCT src, dst, src || '>' || dst AS chunk_id FROM nexts",
    "replies": "SELECT t.turn_id AS src, p.turn_id AS dst, t.turn_id AS chunk_id FROM turns t JOIN turns p ON t.conv_id = p.conv_id AND t.turn = p.turn + 1",
    "labelled": """SELECT r_name AS id, 'Region' AS label FROM region UNION ALL SELECT nation_id, 'Nation' FROM nations
        UNION ALL SELECT customer_id, 'Customer' FROM customers UNION ALL SELECT supplier_id, 'Supplier' FROM suppliers
        UNION ALL SELECT order_id, 'Order' FROM ords UNION ALL SELECT 'catalog', 'Catalog' UNION ALL SELECT DISTINCT brand_id, 'Brand' FROM parts
        UNION ALL SELECT part_id, 'Part' FROM parts UNION ALL SELECT DISTINCT event_type, 'EventType' FROM events
        UNION ALL SELECT turn_id, 'Turn' FROM turns UNION ALL SELECT 'page.' || page_id, 'Page' FROM pages UNION ALL SELECT DISTINCT dst, 'Url' FROM links""",
    "dotted": "SELECT id, label FROM labelled WHERE label IN ('Region','Nation','Customer','Supplier','Order','Catalog','Brand','Part')",
    "defined": "SELECT c.id AS src, p.id AS dst, c.id AS chunk_id FROM dotted c JOIN dotted p ON p.id = regexp_replace(c.id, '\\.[^.]*$', '') AND c.id LIKE '%.%'",
    "edges": """SELECT src, 'DEFINED_IN' AS rel, dst, chunk_id, 'ast' AS source FROM defined UNION ALL SELECT src, 'SUPPLIES', dst, chunk_id, 'ast' FROM supplies
        UNION ALL SELECT src, 'CONTAINS', dst, chunk_id, 'ast' FROM contained UNION ALL SELECT src, 'NEXT', dst, chunk_id, NULL FROM nexts
        UNION ALL SELECT src, 'REPLIES', dst, chunk_id, 'ast' FROM replies UNION ALL SELECT src, 'LINKS', dst, chunk_id, 'llm' FROM links""",
    "places": "SELECT id, label FROM labelled WHERE label IN ('Region','Nation','Customer','Supplier')",
    "placed": "SELECT c.id AS src, p.id AS dst, c.label AS src_label, p.label AS dst_label FROM places c JOIN places p ON p.id = regexp_replace(c.id, '\\.[^.]*$', '') AND c.id LIKE '%.%'",
    "near": f"""SELECT 'DEFINED_IN' AS relationship, dst AS neighbor, src AS chunk_id, TRUE AS outgoing, src_label AS entity_labels, dst_label AS neighbor_labels, 'ast' AS source FROM placed WHERE src = '{NATION}'
        UNION ALL SELECT 'DEFINED_IN', src, src, FALSE, dst_label, src_label, 'ast' FROM placed WHERE dst = '{NATION}' AND src <> '{NATION}'""",
    "calls": """SELECT [src, dst] AS chain, [chunk_id] AS chunk_ids, [src] AS starts, 1 AS hops FROM trans WHERE src = 'click' AND src <> dst
        UNION ALL SELECT list_append(chain, t.dst), list_append(chunk_ids, t.chunk_id), list_append(starts, t.src), hops + 1 FROM calls JOIN trans t ON t.src = chain[-1] WHERE hops < 5 AND NOT list_contains(chain, t.dst)""",
    "scored": """SELECT CAST(doc_id AS INT) AS ord, 'doc ' || n_chars AS statement, CASE WHEN lang <> 'en' THEN CAST(doc_id AS VARCHAR) END AS chunk_id, source AS relationship,
        CASE WHEN CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 2 = 0 THEN 'ast' ELSE 'llm' END AS source, round((n_chars % 997) / 997.0::DOUBLE, 6) AS score FROM documents""",
    "answers": """SELECT o_orderkey, 'The order is ' || o_orderstatus || ' with priority ' || o_orderpriority || '. ' || CASE WHEN o_orderkey % 5 = 0 THEN 'It does not contain Total.'
        WHEN o_orderkey % 7 = 0 THEN 'No information is given. However, Total is known.' WHEN o_orderkey % 11 = 0 THEN 'I cannot answer that.' ELSE 'Total is known.' END AS answer FROM orders""",
    "runs": """SELECT l_linenumber AS run, l_partkey || '-' || CAST(l_quantity AS INT) AS id, l_linestatus AS category, CASE WHEN l_suppkey % 2 = 0 THEN 'hybrid' ELSE 'baseline' END AS system,
        CASE l_returnflag WHEN 'A' THEN 'correct' WHEN 'N' THEN 'partial' ELSE 'incorrect' END AS verdict, CASE WHEN l_tax > 0.04 THEN round(l_discount, 3) END AS credit, CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS latency_ms FROM lineitem""",
    "per_run": """SELECT run, category, system, count(*) AS n, round(avg(CASE WHEN verdict = 'correct' THEN 100.0::DOUBLE ELSE 0 END), 1) AS accuracy
        FROM (SELECT * FROM runs UNION ALL SELECT * REPLACE ('pooled' AS category) FROM runs) GROUP BY run, category, system""",
    "ends": "SELECT * FROM defined",
    "up": "SELECT src AS id, dst AS ancestor, 1 AS depth FROM defined UNION ALL SELECT u.id, d.dst, u.depth + 1 FROM up u JOIN defined d ON d.src = u.ancestor",
    "emb": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "pairs": "SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS query_label, greatest(round(1 - list_cosine_similarity(q.v, e.v), 6), 0) AS dist FROM emb q JOIN emb e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INT) AS rank FROM pairs",
}
_NEEDS = {
    "customers": ["nations"], "suppliers": ["nations"], "ords": ["customers"], "supplies": ["suppliers", "parts"], "contained": ["ords", "parts"], "trans": ["nexts"], "replies": ["turns"],
    "labelled": ["nations", "customers", "suppliers", "ords", "parts", "turns", "links"], "dotted": ["labelled"], "defined": ["dotted"], "edges": ["defined", "supplies", "contained", "nexts", "replies", "links"],
    "places": ["labelled"], "placed": ["places"], "near": ["placed"], "calls": ["trans"], "per_run": ["runs"], "up": ["defined"], "pairs": ["emb"], "ranked": ["pairs"],
}
_RECURSIVE = {"calls", "up"}


def _with(names: list[str], body: str, extra: str = "") -> str:
    """The query ``body`` after the common tables that it needs, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in _NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    tables = ", ".join(f"{n} AS ({_BASE[n]})" for n in order) + (f", {extra}" if extra and order else extra)
    return f"WITH {'RECURSIVE ' if _RECURSIVE & set(order) or 'RECURSE' in extra else ''}{tables.replace('RECURSE ', '')} {body}"


_NEIGHBORS = "SELECT * FROM near"
_EDGES = "SELECT src AS entity, dst AS neighbor, {chunk} AS chunk_id, 'ast' AS source, {a} AS entity_labels, {b} AS neighbor_labels FROM {t} WHERE {w}"
_PHRASE = "CASE WHEN {s} = 'Nation' AND {o} = 'Region' THEN 'is a nation of' WHEN {s} = 'Customer' AND {o} = 'Nation' THEN 'is a customer in' WHEN {s} = 'Supplier' AND {o} = 'Nation' THEN 'is a supplier in' ELSE 'is defined in' END"
_STATED = f"""SELECT CASE WHEN outgoing THEN '{NATION} ' || {_PHRASE.format(s='entity_labels', o='neighbor_labels')} || ' ' || neighbor || '.'
    ELSE neighbor || ' ' || {_PHRASE.format(s='neighbor_labels', o='entity_labels')} || ' {NATION}.' END AS statement, chunk_id, relationship, source,
    CASE WHEN outgoing THEN '{NATION}' ELSE neighbor END AS subject, CASE WHEN outgoing THEN neighbor ELSE '{NATION}' END AS object FROM near"""
_COUNTS = f"""SELECT CAST(count_if(NOT outgoing) AS VARCHAR) || ' things are defined in {NATION}.' AS statement FROM near
    UNION ALL SELECT '{NATION} is defined in ' || count(*) || CASE WHEN count(*) = 1 THEN ' thing.' ELSE ' things.' END FROM near WHERE outgoing HAVING count(*) > 0"""
_LISTING = f"""SELECT kind, CAST(count(DISTINCT leaf) AS BIGINT) AS n, count(DISTINCT leaf) || ' ' || kind || ' are defined in {NATION}: ' || list_aggregate(list_sort(list(DISTINCT leaf)), 'string_agg', ', ') || '.' AS statement
    FROM (SELECT CASE neighbor_labels WHEN 'Customer' THEN 'customers' WHEN 'Supplier' THEN 'suppliers' WHEN 'Nation' THEN 'nations' END AS kind, split_part(neighbor, '.', -1) AS leaf FROM near WHERE NOT outgoing) WHERE kind IS NOT NULL GROUP BY kind"""
_TRAILS = """walk AS (
    SELECT ['click', n] AS chain, [chunk_id] AS chunk_ids, [s] AS starts, 1 AS hops FROM step WHERE pos = 'click'
    UNION ALL SELECT list_append(chain, n), list_append(chunk_ids, t.chunk_id), list_append(starts, s), hops + 1 FROM walk JOIN step t ON t.pos = chain[-1]
    WHERE hops < {h} AND NOT list_contains(chunk_ids, t.chunk_id))"""
_STEP = "RECURSE step AS (SELECT src AS pos, dst AS n, src AS s, chunk_id FROM trans UNION ALL SELECT dst, src, src, chunk_id FROM trans WHERE src <> dst), "
_SIZES = "sizes AS (SELECT DISTINCT 'catalog.' || p_brand AS brand, 'S' || p_size AS leaf FROM part)"
_MODULES = "m AS (SELECT n_name AS n, replace(lower(r_name), ' ', '_') AS r, 'atlas.' || n_name AS m, 'atlas.' || n_name || '.' || n_name AS c, 'atlas.' || n_name || '.' || n_name || '.act' AS f, replace(lower(r_name), ' ', '_') || '.Base' AS base FROM nation JOIN region ON n_regionkey = r_regionkey)"
_LINE_PAIRS = "s AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b FROM lineitem WHERE l_discount >= 0.05)"
_SUPPLIER_NAME = "(SELECT min(s_name) FROM supplier)"
_SCORE = "SELECT *, round(score, 1) AS band, CASE WHEN source IN ('ast','jedi','override') THEN 0 ELSE 1 END AS unproven FROM scored WHERE chunk_id IS NOT NULL"
_RESOLVE = """SELECT surface, canonical_id, method, candidates FROM ({})"""
_PACK = """RECURSE ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
  fold AS (SELECT doc_id, l, 1 AS i, 1 AS n, length(l[1]) AS size, length(l[1]) AS largest FROM ls
    UNION ALL SELECT doc_id, l, i + 1, CASE WHEN fits THEN n ELSE n + 1 END, CASE WHEN fits THEN size + 2 + length(l[i + 1]) ELSE length(l[i + 1]) END,
      greatest(largest, CASE WHEN fits THEN size + 2 + length(l[i + 1]) ELSE length(l[i + 1]) END)
    FROM (SELECT *, size + 2 + length(l[i + 1]) <= 600 OR regexp_matches(l[i + 1], '^[ \\t]') AS fits FROM fold WHERE i < len(l)))"""
_STATES = {
    "total": "regexp_matches(answer, '(^|[^A-Za-z0-9_])Total($|[^A-Za-z0-9_])')",
    "priority": "regexp_matches(lower(answer), '(^|[^a-z0-9_])priority($|[^a-z0-9_])')",
    "prior": "regexp_matches(lower(answer), '(^|[^a-z0-9_])prior($|[^a-z0-9_])')",
}
_NEGATED = "len(list_filter(string_split(replace(lower(answer), chr(10), '. '), '.'), lambda s: contains(s, 'total'))) > 0 AND len(list_filter(string_split(replace(lower(answer), chr(10), '. '), '.'), lambda s: contains(s, 'total') AND NOT (contains(s, 'does not') OR contains(s, 'no information') OR contains(s, 'cannot') OR contains(s, 'is not')))) = 0"
_CREDIT = f"""SELECT o_orderkey, round((CASE WHEN {_STATES['total']} AND NOT ({_NEGATED}) THEN 1 ELSE 0 END + 1 + 1) / 4.0::DOUBLE, 3) AS credit FROM answers"""
_CONTEXT = f"""l AS (SELECT 0 AS kind, statement, chunk_id FROM ({_STATED}) UNION ALL SELECT 1, statement, NULL FROM ({_COUNTS}) UNION ALL SELECT 2, statement, NULL FROM ({_LISTING})),
  n AS (SELECT *, row_number() OVER (ORDER BY kind, statement) AS ord FROM l), d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY statement ORDER BY ord) = 1),
  k AS (SELECT vec_id, greatest(round(1 - list_cosine_similarity(v, (SELECT v FROM emb WHERE vec_id = 0)), 6), 0) AS dist FROM emb ORDER BY dist, vec_id LIMIT 5), p AS (SELECT vec_id, row_number() OVER (ORDER BY dist, vec_id) AS ord FROM k)"""
_CONTEXT_ROWS = """SELECT CAST(0 AS INT) AS section, min(ord) AS ord, '- DEFINED_IN: the place that holds the thing; location only.' AS text FROM d WHERE kind < 2 HAVING count(*) > 0
  UNION ALL SELECT 1, ord, CASE WHEN chunk_id IS NULL THEN statement ELSE '[' || chunk_id || '] (code) ' || statement END FROM d
  UNION ALL SELECT 2, ord, '[' || p.vec_id || '] ' || lang || ' ' || source FROM p JOIN documents ON doc_id = p.vec_id"""
_KNN = "greatest(round(1 - list_cosine_similarity(v, (SELECT v FROM emb WHERE vec_id = {})), 6), 0)"


def oracle_sql() -> dict[str, str]:
    q = {
        "graph_nodes": _with(["labelled"], "SELECT label, count(*) AS n, count(DISTINCT id) AS ids FROM labelled GROUP BY label"),
        "graph_edges_by_rel": _with(["edges"], "SELECT rel, count(*) AS evidence, count(DISTINCT (src, dst)) AS pairs FROM edges GROUP BY rel"),
        "defined_in": _with(["defined"], "SELECT src, dst FROM defined"),
        "node_degree": _with(["supplies", "labelled"], "SELECT id, label AS labels, count(e) AS degree FROM labelled LEFT JOIN (SELECT src AS e FROM supplies UNION ALL SELECT dst FROM supplies) ON e = id WHERE label IN ('Supplier','Part','Nation') GROUP BY id, label"),
        "status_by_source": _with(["edges"], "SELECT coalesce(source, 'llm') AS source, count(*) AS n FROM edges GROUP BY 1"),
        "status_by_type": _with(["edges"], "SELECT rel, count(*) AS n, CAST(count_if(rel NOT IN ('NEXT','LINKS')) AS BIGINT) AS parser_edges, CAST(count_if(rel IN ('NEXT','LINKS')) AS BIGINT) AS model_edges FROM edges GROUP BY rel"),
        "status_by_repo": _with(["places"], "SELECT split_part(id, '.', 1) AS repo, label, count(*) AS n FROM places GROUP BY 1, 2"),
        "package_roots": _with(["labelled"], "SELECT id, label FROM labelled WHERE label IN ('Region','Nation','Catalog','Brand') AND id NOT LIKE '%.%'"),
        "hybrid_context": _with(["near", "emb"], _CONTEXT_ROWS, _CONTEXT),
        "t1_neighbors": _with(["near"], _NEIGHBORS),
        "t8_related_by": _with(["near"], _NEIGHBORS),
        "t8_counts": _with(["near"], _COUNTS),
        "t8_listing": _with(["near"], _LISTING),
        "t8_facts": _with(["near"], _STATED),
        "t6_count_rel": _with(["supplies"], "SELECT count(*) AS count FROM supplies"),
        "t7_docs": _with(["links"], "SELECT dst AS doc_section, dst AS chunk_id FROM links WHERE src = 'page.1'"),
        "t9_from": _with(["placed"], _EDGES.format(chunk="src", a="src_label", b="dst_label", t="placed", w=f"src IN ('{NATION}', 'AFRICA.NATION_5')")),
        "t9_to": _with(["placed"], _EDGES.format(chunk="src", a="src_label", b="dst_label", t="placed", w=f"dst IN ('{NATION}', 'AFRICA')")),
        "t10_two_step": _with(["supplies"], _EDGES.format(chunk="chunk_id", a="'Supplier'", b="'Part'", t="supplies", w=f"regexp_replace(src, '\\.[^.]*$', '') = '{NATION}'")),
        "t11_package": _with(["supplies"], _EDGES.format(chunk="chunk_id", a="'Supplier'", b="'Part'", t="supplies", w="src LIKE 'ASIA.%'") + " ORDER BY src, dst, chunk_id LIMIT 100"),
        "t12_suffix": _with(["supplies"], _EDGES.format(chunk="chunk_id", a="'Supplier'", b="'Part'", t="supplies", w=f"ends_with(src, '.' || {_SUPPLIER_NAME})")),
        "t13_suffix": _with(["placed"], _EDGES.format(chunk="src", a="src_label", b="dst_label", t="placed", w=f"src_label = 'Supplier' AND ends_with(src, '.' || {_SUPPLIER_NAME})") + " ORDER BY src, dst LIMIT 100"),
        "t3_trails": _with(["trans"], "SELECT array_to_string(chain, '|') AS chain, array_to_string(chunk_ids, '|') AS chunk_ids, array_to_string(starts, '|') AS starts, array_to_string(list_transform(starts, lambda x: 'llm'), '|') AS sources FROM walk", _STEP + _TRAILS.format(h=3)),
        "t3_edges": _with(["trans"], "SELECT DISTINCT t.src, t.dst, t.chunk_id, 'llm' AS source FROM (SELECT unnest(chunk_ids) AS c FROM walk) JOIN trans t ON t.chunk_id = c", _STEP + _TRAILS.format(h=2)),
        "t5_paths": _with(["calls"], "SELECT array_to_string(chain, '|') AS chain, array_to_string(chunk_ids, '|') AS chunk_ids, array_to_string(starts, '|') AS starts, array_to_string(list_transform(starts, lambda x: 'llm'), '|') AS sources FROM calls"),
        "t5_maximal": _with(["calls"], "SELECT array_to_string(chain, '|') AS chain FROM calls a WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE len(b.chain) > len(a.chain) AND b.chain[1:len(a.chain)] = a.chain)"),
        "t5_facts": _with(["calls"], "SELECT chain[1] || ' is followed by ' || array_to_string(chain[2:], ', which is followed by ') || '.' AS statement, chunk_ids[1] AS chunk_id, 'NEXT' AS relationship, 'llm' AS source, chain[1] AS subject, chain[-1] AS object FROM calls a WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE len(b.chain) > len(a.chain) AND b.chain[1:len(a.chain)] = a.chain)"),
        "t5_replies": _with(["replies"], "SELECT CAST(hops AS INT) AS hops, count(*) AS walks, count(DISTINCT start) AS starts FROM w GROUP BY hops", "RECURSE w AS (SELECT src AS start, dst AS pos, 1 AS hops FROM replies UNION ALL SELECT start, r.dst, hops + 1 FROM w JOIN replies r ON r.src = pos WHERE hops < 5)"),
        "path_prefix_prune": _with(["replies"], "SELECT chain FROM w a WHERE hops = 3 OR NOT EXISTS (SELECT 1 FROM replies r WHERE r.src = a.pos)", "RECURSE w AS (SELECT src || '|' || dst AS chain, dst AS pos, 1 AS hops FROM replies UNION ALL SELECT chain || '|' || r.dst, r.dst, hops + 1 FROM w JOIN replies r ON r.src = pos WHERE hops < 3)"),
        "t2_shortest": _with(["customers"], """SELECT CASE WHEN a = b THEN NULL WHEN split_part(a, '.', 1) = split_part(b, '.', 1) THEN a || '|' || split_part(a, '.', 1) || '|' || b ELSE a || '|' || split_part(a, '.', 1) || '|' || split_part(b, '.', 1) || '|' || b END AS chain,
            CASE WHEN split_part(a, '.', 1) = split_part(b, '.', 1) THEN 'DEFINED_IN|DEFINED_IN' ELSE 'DEFINED_IN|NEXT|DEFINED_IN' END AS rels
            FROM (SELECT regexp_replace(min(customer_id), '\\.[^.]*$', '') AS a, regexp_replace(max(customer_id), '\\.[^.]*$', '') AS b FROM customers)"""),
        "ancestors": _with(["up"], "SELECT id, ancestor, CAST(min(depth) AS INT) AS depth FROM up GROUP BY id, ancestor"),
        "override_closure": "SELECT DISTINCT r_name AS src, 'catalog.' || p_brand || '.m' || p_size AS dst FROM region JOIN part ON p_size = r_regionkey + 1",
        "generalised_match": _with(["ords", "customers", "up"], """SELECT (SELECT count(*) FROM s) AS observed, (SELECT count(*) FROM g) AS in_graph, count(DISTINCT (a, b)) AS confirmed,
            round(count(DISTINCT (a, b)) / nullif((SELECT count(*) FROM s), 0)::DOUBLE, 3) AS recall, round(count(DISTINCT (fa, fb)) / nullif((SELECT count(*) FROM g), 0)::DOUBLE, 3) AS observed_precision
            FROM f SEMI JOIN g ON fa = g.a AND fb = g.b""", """s AS (SELECT DISTINCT order_id AS a, regexp_replace(order_id, '\\.[^.]*$', '') AS b FROM ords),
            n AS (SELECT DISTINCT regexp_replace(customer_id, '\\.[^.]*$', '') AS a FROM customers JOIN customer USING (c_custkey) WHERE c_mktsegment = 'BUILDING'), g AS (SELECT a, regexp_replace(a, '\\.[^.]*$', '') AS b FROM n),
            u AS (SELECT DISTINCT id, ancestor FROM up UNION SELECT a, a FROM s UNION SELECT b, b FROM s), f AS (SELECT DISTINCT s.a, s.b, x.ancestor AS fa, y.ancestor AS fb FROM s JOIN u x ON x.id = s.a JOIN u y ON y.id = s.b)"""),
        "oracle_recall_precision": """WITH s AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_discount >= 0.05), h AS (SELECT * FROM s INTERSECT SELECT * FROM g)
            SELECT (SELECT count(*) FROM s) AS observed, (SELECT count(*) FROM g) AS in_graph, count(*) AS confirmed, round(count(*) / nullif((SELECT count(*) FROM s), 0)::DOUBLE, 3) AS recall, round(count(*) / nullif((SELECT count(*) FROM g), 0)::DOUBLE, 3) AS observed_precision FROM h""",
        "member_summary": _with(["nations"], "SELECT split_part(nation_id, '.', 1) AS base, count(*) AS n, list_aggregate(list_sort(list(DISTINCT split_part(nation_id, '.', -1))), 'string_agg', ', ') AS names FROM nations GROUP BY 1"),
        "multi_base_members": "SELECT CAST(o_custkey AS VARCHAR) AS id, count(DISTINCT o_orderpriority) AS bases FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1",
        "edge_upsert": """SELECT CAST(l_suppkey AS VARCHAR) AS src, 'SUPPLIES' AS rel, CAST(l_partkey AS VARCHAR) AS dst, l_orderkey || ':' || l_linenumber AS chunk_id, l_discount AS confidence FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_discount DESC) = 1""",
        "node_label_merge": "SELECT CAST(c_nationkey AS VARCHAR) AS id, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS labels, max_by(c_name, c_custkey) AS last FROM customer GROUP BY c_nationkey",
        "twin_delete": _with(["supplies"], "SELECT chunk_id = 'ast' AS placeholder, count(*) AS n, count(DISTINCT (src, dst)) AS pairs FROM m WHERE chunk_id <> 'ast' OR NOT EXISTS (SELECT 1 FROM m r WHERE r.src = m.src AND r.dst = m.dst AND r.chunk_id <> 'ast') GROUP BY 1", "m AS (SELECT DISTINCT src, dst, CASE WHEN CAST(split_part(chunk_id, ':', 1) AS BIGINT) % 3 = 0 THEN 'ast' ELSE chunk_id END AS chunk_id FROM supplies)"),
        "slice_replace": _with(["replies", "links"], "SELECT 'REPLIES' AS rel, 'ast' AS source, count(*) AS n, min(src) AS first FROM replies WHERE CAST(regexp_extract(src, 't([0-9]+)$', 1) AS INT) % 2 = 0 HAVING count(*) > 0 UNION ALL SELECT 'LINKS', 'llm', count(*), min(src) FROM links HAVING count(*) > 0"),
        "external_type_inference": _with(["links"], "SELECT DISTINCT dst AS id, 'Url' AS label FROM links WHERE dst NOT IN (SELECT 'url:' || url FROM pages WHERE url IS NOT NULL)"),
        "endpoint_plausibility": _with(["labelled"], "SELECT c.id AS src, p.id AS dst FROM k c JOIN k p ON p.id = regexp_replace(c.id, '\\.[^.]*$', '') AND c.id LIKE '%.%' WHERE c.label NOT IN ('Catalog','Brand') AND p.label NOT IN ('Catalog','Brand')", "k AS (SELECT * FROM labelled WHERE label IN ('Region','Nation','Customer','Catalog','Brand'))"),
        "resolve_self_reference": _with(["customers"], "SELECT 'self.' || split_part(customer_id, '.', -1) AS surface, regexp_replace(customer_id, '\\.[^.]*$', '') AS cls, customer_id AS canonical_id, 'self_reference' AS method FROM customers UNION ALL SELECT DISTINCT 'self.no_one', regexp_replace(customer_id, '\\.[^.]*$', ''), NULL, 'self_reference' FROM customers"),
        "resolve_import_alias": _with(["customers"], "SELECT 'c' || c_custkey AS surface, regexp_replace(customer_id, '\\.[^.]*$', '') AS module, customer_id AS canonical_id, 'import_alias' AS method FROM customers"),
        "resolve_same_module": _with(["customers"], "SELECT split_part(customer_id, '.', -1) AS surface, regexp_replace(customer_id, '\\.[^.]*$', '') AS module, customer_id AS canonical_id, 'same_module' AS method FROM customers"),
        "resolve_reexport": _with(["customers"], "SELECT 'firm.c' || c_custkey AS surface, customer_id AS canonical_id, 'reexport' AS method FROM customers"),
        "resolve_public_api": f"WITH {_SIZES} SELECT leaf AS surface, min(brand) || '.' || leaf AS canonical_id, CASE WHEN count(*) = 1 THEN 'normalized' ELSE 'public_api' END AS method FROM sizes GROUP BY leaf",
        "resolve_call_graph": f"""WITH {_SIZES} SELECT leaf AS surface, CASE WHEN count(*) = 1 OR min(brand) = (SELECT min(brand) FROM sizes) THEN min(brand) || '.' || leaf END AS canonical_id,
            CASE WHEN count(*) = 1 THEN 'normalized' WHEN min(brand) = (SELECT min(brand) FROM sizes) THEN 'call_graph' ELSE 'ambiguous' END AS method FROM sizes GROUP BY leaf""",
        "resolve_builtin": f"SELECT surface, r_name AS module, 'builtins.' || surface AS canonical_id, 'builtin' AS method FROM region, (SELECT unnest([{', '.join(repr(x) for x in BUILTIN_EXCEPTIONS)}]) AS surface)",
        "nearest_ancestor": _with(["ords", "parts"], "SELECT ancestor, count(*) AS n, min(id) AS first FROM (SELECT order_id AS id, split_part(order_id, '.', 1) || '.' || split_part(order_id, '.', 2) AS ancestor FROM ords UNION ALL SELECT part_id, NULL FROM parts) GROUP BY ancestor"),
        "edges_by_source_and_all": _with(["replies", "links", "nexts"], "SELECT tag, count(*) AS pairs, min(src) AS first FROM (SELECT DISTINCT tag, src, dst FROM e UNION ALL SELECT DISTINCT 'all', src, dst FROM e) GROUP BY tag", "e AS (SELECT 'ast' AS tag, src, dst FROM replies UNION ALL SELECT 'llm', src, dst FROM links UNION ALL SELECT 'llm', src, dst FROM nexts)"),
        "oracle_unmatched": f"WITH {_LINE_PAIRS} SELECT 'missing' AS kind, a, b FROM (SELECT * FROM s EXCEPT SELECT * FROM g) UNION ALL SELECT 'unconfirmed', a, b FROM (SELECT * FROM g EXCEPT SELECT * FROM s)",
        "oracle_constructors": f"""WITH {_LINE_PAIRS}, k AS (SELECT * FROM s WHERE length(b) % 2 = 0), h AS (SELECT * FROM k INTERSECT SELECT * FROM g)
            SELECT (SELECT count(*) FROM k) AS observed, (SELECT count(*) FROM g) AS in_graph, (SELECT count(*) FROM h) AS confirmed,
            round((SELECT count(*) FROM h) / nullif((SELECT count(*) FROM k), 0), 3) AS recall, round((SELECT count(*) FROM h) / nullif((SELECT count(*) FROM g), 0), 3) AS observed_precision""",
        "oracle_in_packages": _with(["customers"], """SELECT count(*) AS observed, count_if(hit) AS in_graph, count_if(hit) AS confirmed, round(count_if(hit) / nullif(count(*), 0), 3) AS recall, CASE WHEN count_if(hit) > 0 THEN 1.0::DOUBLE END AS observed_precision
            FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS hit FROM customers WHERE split_part(customer_id, '.', 1) IN ('ASIA', 'EUROPE'))"""),
        "content_keys": "SELECT substr(sha256(text), 1, 12) AS key, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "reading_cost": "SELECT chunks, CAST(floor(chars / 3.5) AS BIGINT) AS est_input_tokens, chunks * 150 AS est_output_tokens, round((chars / 3.5) / 1e6 * 2.5::DOUBLE + (chunks * 150) / 1e6 * 10.0::DOUBLE, 2) AS est_cost_usd FROM (SELECT count(*) AS chunks, coalesce(CAST(sum(length(text)) AS BIGINT), 0)::DOUBLE AS chars FROM documents)",
        "bench_summary_credit": _with(["runs"], """SELECT category, system, count(*) AS n, round(avg(CASE WHEN verdict = 'correct' THEN 100.0::DOUBLE ELSE 0 END), 1) AS accuracy, round(avg(CASE WHEN verdict = 'partial' THEN 100.0::DOUBLE ELSE 0 END), 1) AS partial,
            round(avg(coalesce(credit, CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0 END)::DOUBLE) * 100, 1) AS score, list_sort(list(latency_ms))[count(*) // 2 + 1] AS median_latency_ms FROM runs GROUP BY category, system"""),
        "edge_upsert_endpoints": _with(["supplies"], "SELECT supplier_id AS id, 'Supplier' AS labels FROM suppliers UNION ALL SELECT DISTINCT dst, '' FROM supplies"),
        "label_if_unlabelled": _with(["supplies"], "SELECT 'Supplier' AS labels, count(*) AS n, min(supplier_id) AS first FROM suppliers UNION ALL SELECT 'Part', count(DISTINCT dst), min(dst) FROM supplies"),
        "t5_call_chain": _with(["parts"], """SELECT array_to_string(chain, '|') AS chain, array_to_string(ids, '|') AS chunk_ids, array_to_string(ids, '|') AS starts, array_to_string(list_transform(ids, lambda x: 'ast'), '|') AS sources FROM w ORDER BY len(chain), chain, ids LIMIT 500""",
            "RECURSE c AS (SELECT a.part_id AS src, b.part_id AS dst FROM parts a JOIN parts b ON b.p_partkey = a.p_partkey + 1), w AS (SELECT [src, dst] AS chain, [src] AS ids, 1 AS hops FROM c JOIN parts ON part_id = src WHERE brand_id = (SELECT min(brand_id) FROM parts) UNION ALL SELECT list_append(chain, c.dst), list_append(ids, c.src), hops + 1 FROM w JOIN c ON c.src = chain[-1] WHERE hops < 5)"),
        "ingest_edges": f"""WITH {_MODULES} SELECT CASE WHEN rel = 'DEFINED_IN_M' THEN c WHEN rel = 'INHERITS_FROM' THEN c WHEN part = '' THEN f ELSE f || part END AS src, CASE rel WHEN 'DEFINED_IN_M' THEN 'DEFINED_IN' ELSE rel END AS rel,
            CASE dst WHEN 'm' THEN m WHEN 'c' THEN c WHEN 'f' THEN f WHEN 'base' THEN base WHEN 'given' THEN f || '.given' WHEN 'rest' THEN f || '.rest' ELSE dst END AS dst, source FROM m, (VALUES ('DEFINED_IN_M', '', 'm', 'ast'), ('DEFINED_IN', '', 'c', 'ast'),
            ('DEFINED_IN', '.given', 'f', 'ast'), ('DEFINED_IN', '.rest', 'f', 'ast'), ('HAS_PARAMETER', '', 'given', 'ast'), ('HAS_PARAMETER', '', 'rest', 'ast'), ('INHERITS_FROM', '', 'base', 'ast'), ('RAISES', '', 'builtins.KeyError', 'ast'),
            ('STORED_ON', '.given', 'c', 'ast'), ('CALLS', '', 'builtins.KeyError', 'names'), ('PASSES_TO', '.given', 'builtins.KeyError', 'names')) v(rel, part, dst, source)""",
        "chunk_files_by_kind": f"""WITH {_MODULES}, k AS (SELECT 'code' AS of, 'code' AS kind, '.py' AS ending, c AS section, 2 AS start_line, 2 AS end_line, n, length('class ' || n || '(Base):') AS chars FROM m
            UNION ALL SELECT 'code', 'code', '.py', f, 3, 6, n, length('    def act(self, given, rest=1) -> Reply:') + length('        self.kept = given') + length('        helper(given)') + length('        raise KeyError(given)') + 3 FROM m
            UNION ALL SELECT 'md', 'doc', '.md', n, 3, 3, n, length('first ' || r) FROM m UNION ALL SELECT 'md', 'doc', '.md', n || ' > Deeper', 7, 7, n, 6 FROM m
            UNION ALL SELECT 'rst', 'doc', '.rst', n, 4, 4, n, length('first ' || r) FROM m UNION ALL SELECT 'rst', 'doc', '.rst', n || ' > Deeper', 9, 9, n, 6 FROM m
            UNION ALL SELECT 'changelog', 'changelog', '.rst', '1.2.0', 7, 7, n, length('- ' || n) FROM m UNION ALL SELECT 'changelog', 'changelog', '.rst', '1.1.0', 12, 12, n, length('- ' || r) FROM m)
            SELECT of, kind, 'atlas/' || n || ending AS path, section, start_line, end_line, substr(sha1('atlas:atlas/' || n || ending || ':' || start_line || ':' || end_line), 1, 16) AS chunk_id, CAST(chars AS INT) AS chars FROM k""",
        "structure_nodes": "SELECT 'DocSection' AS label, 2 * count(*) AS n, min(n_name) AS first FROM nation UNION ALL SELECT 'Release', 2, '1.1.0' WHERE (SELECT count(*) FROM nation) > 0",
        "extract_facts": """WITH m AS (SELECT 'atlas.' || n_name AS m, 'atlas.' || n_name || '.' || n_name AS c, 'atlas.' || n_name || '.' || n_name || '.act' AS f, replace(lower(r_name), ' ', '_') || '.Base' AS base FROM nation JOIN region ON n_regionkey = r_regionkey)
            SELECT 'node' AS kind, m AS owner, '' AS surfaces, 'Module' AS a, NULL AS b FROM m UNION ALL SELECT 'node', c, '', 'Class', NULL FROM m UNION ALL SELECT 'node', f, '', 'Function', NULL FROM m
            UNION ALL SELECT 'alias', m, '', 'Base', base FROM m UNION ALL SELECT 'inherits', c, 'Base', NULL, NULL FROM m
            UNION ALL SELECT kind, f, surfaces, a, b FROM m, (VALUES ('param', '', 'given', NULL), ('param', '', 'rest', '1'), ('returns', 'Reply', NULL, NULL), ('stores', '', 'given', 'kept'), ('calls', 'helper', NULL, NULL),
            ('passes', 'helper', 'given', '#0'), ('calls', 'KeyError', NULL, NULL), ('passes', 'KeyError', 'given', '#0'), ('raises', 'KeyError', NULL, NULL)) v(kind, surfaces, a, b)""",
        "resolve_exact": _with(["nations"], "SELECT nation_id AS surface, nation_id AS canonical_id, 'exact' AS method, '' AS candidates FROM nations"),
        "resolve_folded": _with(["nations"], "SELECT replace(lower(split_part(nation_id, '.', -1)), '_', '-') AS surface, nation_id AS canonical_id, 'normalized' AS method, '' AS candidates FROM nations"),
        "resolve_suffix": _with(["customers"], "SELECT split_part(customer_id, '.', 2) || '.' || split_part(customer_id, '.', 3) AS surface, customer_id AS canonical_id, 'qualified' AS method FROM customers"),
        "resolve_ambiguous": "SELECT 's' || p_size AS surface, CASE WHEN count(DISTINCT p_brand) = 1 THEN min('catalog.' || p_brand || '.S' || p_size) END AS canonical_id, CASE WHEN count(DISTINCT p_brand) = 1 THEN 'normalized' ELSE 'ambiguous' END AS method, CASE WHEN count(DISTINCT p_brand) = 1 THEN '' ELSE array_to_string(list_sort(list(DISTINCT 'catalog.' || p_brand || '.S' || p_size)), ',') END AS candidates FROM part GROUP BY p_size",
        "resolve_method_mix": _with(["customers"], "SELECT 'exact' AS method, count(*) AS n FROM customers UNION ALL SELECT 'normalized', 2 * count(*) + count(*) FROM customers UNION ALL SELECT 'qualified', count(*) FROM customers"),
        "doc_index_unambiguous": "WITH k AS (SELECT DISTINCT unnest([lower(p_brand || ' > ' || p_name), lower(p_name)]) AS key, CAST(p_partkey AS VARCHAR) AS id FROM part) SELECT regexp_replace(trim(key), '\\s+', ' ', 'g') AS key, min(id) AS id FROM k GROUP BY 1 HAVING count(DISTINCT id) = 1",
        "chunk_ids": "SELECT doc_id, substr(sha1(source || ':' || doc_id || ':1:' || len(string_split(text, chr(10)))), 1, 16) AS chunk_id FROM documents",
        "chunk_pack": _with([], "SELECT doc_id, CAST(n AS BIGINT) AS chunks, CAST(largest AS INT) AS largest, CAST(i - 1 AS INT) AS last FROM fold WHERE i = len(l)", _PACK),
        "knn_top5": _with(["emb"], f"SELECT vec_id, label, {_KNN.format(0)} AS dist FROM emb ORDER BY dist, vec_id LIMIT 5"),
        "knn_batch": _with(["ranked"], "SELECT query_id, vec_id, dist, rank FROM ranked WHERE rank <= 5"),
        "knn_batch_recall_at_k": _with(["ranked"], "SELECT round(avg(h), 6) AS recall FROM (SELECT query_id, max(CASE WHEN label = query_label AND rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS h FROM ranked GROUP BY query_id HAVING bool_or(label = query_label))"),
        "deeper_seeds": _with(["emb"], f"SELECT vec_id, dist FROM (SELECT vec_id, label, {_KNN.format(1)} AS dist FROM emb ORDER BY dist, vec_id LIMIT 20) WHERE label % 2 = 1 ORDER BY dist, vec_id LIMIT 3"),
        "rank_band_top8": _with(["scored"], "SELECT row_number() OVER (ORDER BY band DESC, unproven, score DESC, ord) AS ord, statement, chunk_id, source, score FROM s QUALIFY ord <= 8", f"s AS ({_SCORE})").replace("AS ord, statement", "AS place, statement").replace("QUALIFY ord <= 8", "QUALIFY place <= 8").replace("SELECT row_number()", "SELECT place AS ord, statement, chunk_id, source, score FROM (SELECT row_number()") + ")",
        "dedupe_statement": _with(["scored"], "SELECT ord, statement, chunk_id FROM scored QUALIFY row_number() OVER (PARTITION BY statement ORDER BY ord) = 1"),
        "passage_antijoin": _with(["scored"], "SELECT lang, count(*) AS n FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT chunk_id FROM scored WHERE chunk_id IS NOT NULL) GROUP BY lang"),
        "legend_rels": "SELECT source AS relationship, min(doc_id) AS first FROM documents GROUP BY source",
        "citations_valid": """SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN '' WHEN n_chars % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || ',' || (doc_id + 1) END AS cited,
            n_chars % 3 <> 0 AND (n_chars % 2 = 0 OR doc_id % 2 = 1) AS valid FROM documents""",
        "grade_terms": _with(["answers"], f"SELECT o_orderkey, {_STATES['total']} AS total, {_STATES['priority']} AS priority, {_STATES['prior']} AS prior FROM answers"),
        "grade_refusal": _with(["answers"], "SELECT o_orderkey, (contains(lower(answer), 'does not contain') OR contains(lower(answer), 'no information') OR contains(lower(answer), 'cannot answer')) AND NOT contains(lower(answer), 'however') AS refusal FROM answers"),
        "negated_near": _with(["answers"], f"SELECT o_orderkey, {_NEGATED} AS negated FROM answers"),
        "credit_share": _with(["answers"], f"SELECT o_orderkey, credit, CASE WHEN credit >= 1 THEN 'correct' WHEN credit > 0 THEN 'partial' ELSE 'incorrect' END AS verdict FROM ({_CREDIT})"),
        "bench_summary": _with(["runs"], "SELECT category, system, count(*) AS n, round(avg(CASE WHEN verdict = 'correct' THEN 100.0::DOUBLE ELSE 0 END), 1) AS accuracy, round(avg(CASE WHEN verdict = 'partial' THEN 100.0::DOUBLE ELSE 0 END), 1) AS partial, round(avg(CASE verdict WHEN 'correct' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 ELSE 0 END) * 100, 1) AS score FROM runs GROUP BY category, system"),
        "upper_median_latency": _with(["runs"], "SELECT category, system, list_sort(list(latency_ms))[count(*) // 2 + 1] AS median_latency_ms FROM runs GROUP BY category, system"),
        "runs_mean_min_max": _with(["per_run"], "SELECT category, system, round(avg(accuracy), 1) AS mean, min(accuracy) AS min, max(accuracy) AS max, array_to_string(list(CAST(accuracy AS VARCHAR) ORDER BY run), ',') AS values FROM per_run GROUP BY category, system"),
        "pooled_delta": _with(["per_run"], "SELECT category, round(avg(d), 1) AS mean, min(d) AS min, max(d) AS max FROM (SELECT a.category, round(a.accuracy - b.accuracy, 1) AS d FROM per_run a JOIN per_run b ON a.run = b.run AND a.category = b.category AND a.system = 'hybrid' AND b.system = 'baseline') GROUP BY category"),
        "stability_buckets": _with(["runs"], "SELECT system, bucket, count(*) AS n FROM (SELECT id, system, CASE WHEN bool_and(verdict = 'correct') THEN 'always' WHEN NOT bool_or(verdict = 'correct') THEN 'never' ELSE 'flipping' END AS bucket FROM runs GROUP BY id, system) GROUP BY system, bucket"),
        "flip_rate": _with(["runs"], "SELECT system, count(*) AS keys, CAST(count_if(k > 1) AS BIGINT) AS unstable, round(avg(CASE WHEN k > 1 THEN 100.0::DOUBLE ELSE 0 END), 1) AS rate FROM (SELECT id, system, count(DISTINCT verdict) AS k FROM runs GROUP BY id, system) GROUP BY system"),
        "layer_instability": _with(["runs"], "SELECT system, round(avg(CASE WHEN c > 1 THEN 100.0::DOUBLE ELSE 0 END), 1) AS category, round(avg(CASE WHEN v > 1 THEN 100.0::DOUBLE ELSE 0 END), 1) AS verdict FROM (SELECT id, system, count(DISTINCT category) AS c, count(DISTINCT verdict) AS v FROM runs GROUP BY id, system) GROUP BY system"),
        "majority_vote": "SELECT user_id, event_type AS vote, count(*) AS votes FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) = 1",
        "routing_log_rollup": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY 1, 2",
    }
    return q
