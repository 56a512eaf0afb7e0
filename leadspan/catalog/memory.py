"""Queries for text memory: chunks, walks, clusters, retrieval, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadspan.catalog import snippets as S
from leadspan.catalog.registry import now, query
from leadspan.operators import entities as E
from leadspan.operators import graph as G
from leadspan.operators import memory as M
from leadspan.operators import vectors as VX
from leadspan.operators.chunks import chunk_documents
from leadspan.sources.html import html_to_markdown


def nodes(v):
    return v.memory_nodes.withColumn("archived_at", F.lit(None).cast("timestamp"))


def _html_sql() -> str:
    out = "html"
    steps = [
        (r"(?i)<script(?s:.*?)</script>", ""), (r"(?i)<style(?s:.*?)</style>", ""), (r"(?i)<noscript(?s:.*?)</noscript>", ""),
        *[(rf"(?i)<h{n}[^>]*>((?s:.*?))</h{n}>", "' || chr(10) || '" + "#" * n + r" \1' || chr(10) || '") for n in (1, 2, 3, 4)],
        (r"(?i)</p>", "' || chr(10) || chr(10) || '"), (r"(?i)<br\s*/?>", "' || chr(10) || '"), (r"(?i)</div>", "' || chr(10) || '"),
        (r'(?i)<a[^>]*href="([^"]*)"[^>]*>((?s:.*?))</a>', r"[\2](\1)"),
        (r"(?i)<(?:strong[^>]*>((?s:.*?))</strong>|b[^>]*>((?s:.*?))</b>)", r"**\1\2**"), (r"(?i)<(?:em[^>]*>((?s:.*?))</em>|i[^>]*>((?s:.*?))</i>)", r"*\1\2*"),
        (r"(?i)<li[^>]*>((?s:.*?))</li>", r"- \1' || chr(10) || '"), (r"<[^>]+>", ""),
    ]
    for pattern, replacement in steps:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        out = f"replace({out}, '{entity}', '{char}')"
    return rf"SELECT page_id, trim(regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS markdown FROM pages"


@query("html_to_markdown", _html_sql())
def _(v):
    return v.pages.select("page_id", html_to_markdown(F.col("html")).alias("markdown"))


# sequential inside a document: checked on fixtures in the tests
@query("chunk_documents")
def _(v):
    pages = v.pages.select(F.col("page_id").alias("doc_id"), html_to_markdown(F.col("html")).alias("text"))
    both = v.documents.select("doc_id", "text").union(pages.select((F.col("doc_id") + 10**12).alias("doc_id"), "text"))
    return chunk_documents(both, "doc_id", "text").withColumn("heading_path", F.array_join("heading_path", " > "))


ANCHORS = "anchors AS (SELECT n_nationkey AS query_id, 'entity' AS type, CAST(n_nationkey % 10 AS BIGINT) AS id FROM nation UNION ALL SELECT n_nationkey, 'node', CAST(n_nationkey * 20 AS BIGINT) FROM nation)"


def _anchors(v):
    k = F.col("n_nationkey")
    return v.nation.select(k.alias("query_id"), F.lit("entity").alias("type"), (k % 10).cast("bigint").alias("id")).union(v.nation.select(k, F.lit("node"), (k * 20).cast("bigint")))


@query("graph_walk", f"""WITH RECURSIVE {ANCHORS}, hops AS (SELECT from_type AS ft, from_id AS fi, to_type AS tt, to_id AS ti FROM memory_edges UNION ALL SELECT to_type, to_id, from_type, from_id FROM memory_edges),
    w AS (SELECT query_id, type, id, 0 AS d FROM anchors UNION SELECT w.query_id, h.tt, h.ti, w.d + 1 FROM w JOIN hops h ON h.ft = w.type AND h.fi = w.id WHERE w.d < 2) SELECT DISTINCT query_id, id AS node_id FROM w WHERE type = 'node'""", ("memory_edges",))
def _(v):
    return G.walk(v.memory_edges, _anchors(v), 2, incoming=True)


@query("canonical_head", """WITH RECURSIVE p AS (SELECT to_id AS node, arg_max(from_id, {'c': created_at, 'e': edge_id}) AS par FROM memory_edges WHERE relation = 'supersedes' GROUP BY 1),
    w AS (SELECT vec_id AS start, vec_id AS cur, [vec_id] AS seen, false AS stop FROM embeddings UNION ALL SELECT w.start, p.par, list_append(w.seen, p.par), list_contains(w.seen, p.par) FROM w JOIN p ON p.node = w.cur WHERE NOT w.stop)
    SELECT start AS node_id, arg_max(cur, len(seen)) AS head_id FROM w GROUP BY 1""", ("memory_edges",))
def _(v):
    return G.canonical_head(v.memory_edges, v.embeddings.select(F.col("vec_id").alias("node_id")))


CLUSTERS = """v AS (SELECT node_id, CAST(vector AS DOUBLE[]) AS x FROM memory_embeddings), pr AS (SELECT a.node_id AS a, b.node_id AS b FROM v a JOIN v b ON a.node_id <> b.node_id WHERE list_cosine_similarity(a.x, b.x) >= 0.85),
    reach AS (SELECT a AS node_id, a AS r FROM pr UNION SELECT reach.node_id, pr.b FROM reach JOIN pr ON pr.a = reach.r), clusters AS (SELECT node_id, min(r) AS cluster_id FROM reach GROUP BY 1)"""


@query("similar_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT node_id, cluster_id FROM clusters", ("memory_embeddings",))
def _(v):
    return VX.similar_clusters(v.memory_embeddings)


VEC_NODES = f"""vn AS (SELECT e.node_id, 't' AS tenant_id, ['hypothesis', 'validated', 'proven'][e.label % 3 + 1] AS confidence, CAST(e.node_id % 15 AS BIGINT) AS access_count, CAST(e.node_id % 90 AS BIGINT) AS confidence_score,
    TIMESTAMP '2024-01-01' + to_days(CAST(e.node_id % 360 AS INTEGER)) AS created_at, CASE WHEN e.node_id % 9 = 0 THEN NULL ELSE {S.NOW} - to_days(CAST(e.node_id % 600 AS INTEGER)) END AS last_accessed_at FROM memory_embeddings e)"""


def _vec_nodes(v):
    n = F.col("node_id")
    return v.memory_embeddings.select(
        "node_id", F.lit("t").alias("tenant_id"), F.element_at(F.lit(["hypothesis", "validated", "proven"]), (F.col("label") % 3 + 1).cast("int")).alias("confidence"), (n % 15).alias("access_count"),
        (n % 90).alias("confidence_score"), F.timestamp_add("DAY", (n % 360).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
        F.when(n % 9 != 0, F.timestamp_add("DAY", (-(n % 600)).cast("int"), now())).alias("last_accessed_at"), F.lit(None).cast("timestamp").alias("archived_at"),
    )


HEADS = f"""heads AS (SELECT c.cluster_id, arg_max(n.node_id, {{'a': CASE n.confidence WHEN 'proven' THEN 3 WHEN 'validated' THEN 2 ELSE 1 END, 'b': n.access_count, 'c': -epoch_us(n.created_at), 'd': -n.node_id}}) AS head_id, count(*) AS members FROM clusters c JOIN vn n ON n.node_id = c.node_id GROUP BY 1 HAVING count(*) >= 2),
    lost AS (SELECT c.node_id, h.head_id FROM clusters c JOIN heads h ON h.cluster_id = c.cluster_id WHERE c.node_id <> h.head_id)"""


@query("cluster_head", f"WITH RECURSIVE {CLUSTERS}, {VEC_NODES}, {HEADS} SELECT * FROM heads", ("memory_embeddings",))
def _(v):
    return M.cluster_head(_vec_nodes(v).join(VX.similar_clusters(v.memory_embeddings), "node_id"))


@query("fold_clusters", f"WITH RECURSIVE {CLUSTERS}, {VEC_NODES}, {HEADS} SELECT from_id, to_id, relation FROM memory_edges UNION ALL SELECT head_id, node_id, 'supersedes' FROM lost", ("memory_embeddings", "memory_edges"))
def _(v):
    _, edges = M.fold_clusters(_vec_nodes(v), VX.similar_clusters(v.memory_embeddings), v.memory_edges, now())
    return edges.select("from_id", "to_id", "relation")


MAINTAIN = f"""{CLUSTERS}, {VEC_NODES}, {HEADS}, a AS (SELECT vn.*, l.node_id IS NOT NULL AS gone FROM vn LEFT JOIN lost l ON l.node_id = vn.node_id),
    b AS (SELECT *, CASE WHEN gone THEN 0 WHEN confidence = 'validated' AND access_count >= 10 AND (epoch_us({S.NOW}) - epoch_us(created_at)) / 8.64e10 >= 14 THEN 2 WHEN confidence = 'hypothesis' AND access_count >= 3 THEN 1 ELSE 0 END AS up FROM a),
    c AS (SELECT node_id, gone, last_accessed_at, CASE up WHEN 2 THEN 'proven' WHEN 1 THEN 'validated' ELSE confidence END AS confidence, CASE up WHEN 2 THEN least(100, 80 + access_count) WHEN 1 THEN least(79, 40 + 5 * access_count) ELSE confidence_score END AS score FROM b),
    ce AS (SELECT from_id AS x, to_id AS y FROM memory_edges WHERE relation = 'contradicts' AND from_id IN (SELECT node_id FROM c WHERE NOT gone)), e AS (SELECT x AS n FROM ce UNION SELECT y FROM ce),
    f AS (SELECT c.*, NOT gone AND node_id IN (SELECT n FROM e) AND (confidence <> 'hypothesis' OR score > 1) AS hit FROM c)
    SELECT node_id, CASE WHEN hit THEN 'hypothesis' ELSE confidence END AS confidence, CAST(CASE WHEN hit THEN floor(score / 2) ELSE score END AS BIGINT) AS confidence_score, gone OR coalesce(last_accessed_at < {S.NOW} - INTERVAL 365 DAY, false) AS archived FROM f"""


@query("maintain_memory", f"WITH RECURSIVE {MAINTAIN}", ("memory_embeddings", "memory_edges"))
def _(v):
    out, _ = M.maintain_memory(_vec_nodes(v), v.memory_embeddings, v.memory_edges, now())
    return out.select("node_id", "confidence", F.col("confidence_score").cast("bigint").alias("confidence_score"), F.col("archived_at").isNotNull().alias("archived"))


@query("promote_by_access", f"""SELECT node_id, CASE WHEN confidence = 'validated' AND access_count >= 10 AND (epoch_us({S.NOW}) - epoch_us(created_at)) / 8.64e10 >= 14 THEN 'proven' WHEN confidence = 'hypothesis' AND access_count >= 3 THEN 'validated' ELSE confidence END AS confidence,
    CASE WHEN confidence = 'validated' AND access_count >= 10 AND (epoch_us({S.NOW}) - epoch_us(created_at)) / 8.64e10 >= 14 THEN least(100, 80 + access_count) WHEN confidence = 'hypothesis' AND access_count >= 3 THEN least(79, 40 + 5 * access_count) ELSE confidence_score END AS confidence_score FROM memory_nodes""", ("memory_nodes",))
def _(v):
    return M.promote_by_access(nodes(v), now()).select("node_id", "confidence", "confidence_score")


@query("flag_contradictions", """WITH c AS (SELECT from_id AS x, to_id AS y FROM memory_edges WHERE relation = 'contradicts' AND from_id IN (SELECT node_id FROM memory_nodes)), e AS (SELECT x AS n FROM c UNION SELECT y FROM c)
    SELECT node_id, CASE WHEN node_id IN (SELECT n FROM e) AND (confidence <> 'hypothesis' OR confidence_score > 1) THEN 'hypothesis' ELSE confidence END AS confidence, CAST(CASE WHEN node_id IN (SELECT n FROM e) AND (confidence <> 'hypothesis' OR confidence_score > 1) THEN floor(confidence_score / 2) ELSE confidence_score END AS BIGINT) AS confidence_score FROM memory_nodes""", ("memory_nodes", "memory_edges"))
def _(v):
    return M.flag_contradictions(nodes(v), v.memory_edges).select("node_id", "confidence", F.col("confidence_score").cast("bigint").alias("confidence_score"))


@query("archive_stale", f"SELECT node_id, coalesce(last_accessed_at < {S.NOW} - INTERVAL 365 DAY, false) AS archived FROM memory_nodes", ("memory_nodes",))
def _(v):
    return M.archive_stale(nodes(v), now()).select("node_id", F.col("archived_at").isNotNull().alias("archived"))


@query("missing_embeddings", "SELECT node_id FROM memory_nodes WHERE node_id NOT IN (SELECT node_id FROM memory_embeddings)", ("memory_nodes", "memory_embeddings"))
def _(v):
    return M.missing_embeddings(nodes(v), v.memory_embeddings).select("node_id")


@query("dense_rank", """WITH q AS (SELECT n_nationkey AS query_id, embedding AS qv FROM nation JOIN embeddings ON vec_id = n_nationkey), s AS (SELECT query_id, node_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(vector AS DOUBLE[])) AS sim FROM q, memory_embeddings)
    SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) AS dense_rank, round(sim, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) <= 10""", ("memory_embeddings",))
def _(v):
    q = v.nation.join(v.embeddings, F.col("vec_id") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("query_id"), F.col("embedding").alias("vector"))
    return M.dense_rank(q, v.memory_embeddings, 10).select("query_id", "node_id", "dense_rank", F.round("similarity", 5).alias("similarity"))


@query("dense_rank_all", """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, node_id, list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(vector AS DOUBLE[])) AS sim FROM q, memory_embeddings)
    SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) AS dense_rank, round(sim, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node_id) <= 10""", ("memory_embeddings",))
def _(v):
    q = v.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return M.dense_rank(q, v.memory_embeddings, 10).select("query_id", "node_id", "dense_rank", F.round("similarity", 5).alias("similarity"))


QUERY_ROWS = "q AS (SELECT item_id AS query_id, 't' || (item_id % 3) AS tenant_id, text AS qtext FROM benchmark)"
RETRIEVE = f"""{QUERY_ROWS}, cand AS (SELECT * FROM memory_nodes),
    t AS (SELECT node_id, {S.tokens('content')} AS tk FROM cand), qt AS (SELECT query_id, tenant_id, list_distinct({S.tokens('qtext')}) AS qk FROM q),
    s AS (SELECT qt.query_id, c.*, CASE WHEN len(t.tk) = 0 OR len(qk) = 0 THEN 0.0 ELSE len(list_distinct(list_intersect(qk, t.tk))) / greatest(1, log2(len(t.tk) + 2)) END AS kw FROM qt JOIN cand c ON c.tenant_id = qt.tenant_id JOIN t ON t.node_id = c.node_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, created_at DESC, node_id) AS kr FROM s),
    sc AS (SELECT *, 1.0::DOUBLE / (60 + kr) + CASE confidence WHEN 'proven' THEN 0.4 WHEN 'validated' THEN 0.2 ELSE 0.0 END + CASE WHEN last_accessed_at IS NULL THEN 0.0 ELSE -0.2 * (1 - exp(-((epoch_us({S.NOW}) - epoch_us(last_accessed_at)) / 8.64e10) / 90)) END
      + CASE WHEN access_count <= 0 THEN 0.0 ELSE least(0.15, log2(access_count + 1) * 0.03) END AS score FROM r WHERE kw > 0),
    tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, node_id) AS position, CAST(ceil(len(content) * 0.28::DOUBLE) AS BIGINT) AS need FROM sc),
    b AS (SELECT *, sum(need) OVER (PARTITION BY query_id ORDER BY position) AS used FROM tp WHERE position <= 12)"""


@query("retrieve_keyword", f"WITH {RETRIEVE} SELECT query_id, node_id, position, kr AS keyword_rank, round(score, 5) AS score FROM b WHERE position = 1 OR used <= 4000", ("memory_nodes",))
def _(v):
    out = M.retrieve(_queries(v), nodes(v), now())
    return out.select("query_id", "node_id", "position", "keyword_rank", F.round("score", 5).alias("score"))


def _queries(v):
    return v.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("t"), F.col("item_id") % 3).alias("tenant_id"), "text")


HYBRID = f"""WITH RECURSIVE q AS (SELECT item_id AS query_id, 't' || (item_id % 3) AS tenant_id, text AS qtext, CAST(embedding AS DOUBLE[]) AS qv FROM benchmark JOIN embeddings ON vec_id = item_id),
    anchors AS (SELECT item_id AS query_id, 'entity' AS type, CAST(item_id % 10 AS BIGINT) AS id FROM benchmark), hops AS (SELECT from_type AS ft, from_id AS fi, to_type AS tt, to_id AS ti FROM memory_edges UNION ALL SELECT to_type, to_id, from_type, from_id FROM memory_edges),
    w AS (SELECT query_id, type, id, 0 AS d FROM anchors UNION SELECT w.query_id, h.tt, h.ti, w.d + 1 FROM w JOIN hops h ON h.ft = w.type AND h.fi = w.id WHERE w.d < 2),
    near AS (SELECT DISTINCT w.query_id, w.id AS node_id FROM w JOIN q ON q.query_id = w.query_id JOIN memory_nodes n ON n.node_id = w.id AND n.tenant_id = q.tenant_id WHERE w.type = 'node'),
    chosen AS (SELECT * FROM near UNION ALL SELECT q.query_id, n.node_id FROM q JOIN memory_nodes n ON n.tenant_id = q.tenant_id WHERE q.query_id NOT IN (SELECT query_id FROM near)),
    t AS (SELECT node_id, {S.tokens('content')} AS tk FROM memory_nodes), qt AS (SELECT query_id, qv, list_distinct({S.tokens('qtext')}) AS qk FROM q),
    s AS (SELECT c.query_id, n.*, CASE WHEN len(t.tk) = 0 OR len(qk) = 0 THEN 0.0 ELSE len(list_distinct(list_intersect(qk, t.tk))) / greatest(1, log2(len(t.tk) + 2)) END AS kw, CASE WHEN e.vector IS NOT NULL THEN list_cosine_similarity(qt.qv, CAST(e.vector AS DOUBLE[])) END AS sim
      FROM chosen c JOIN qt ON qt.query_id = c.query_id JOIN memory_nodes n ON n.node_id = c.node_id JOIN t ON t.node_id = c.node_id LEFT JOIN memory_embeddings e ON e.node_id = c.node_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, created_at DESC, node_id) AS kr, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, created_at DESC, node_id) AS dr FROM s),
    sc AS (SELECT *, CASE WHEN sim IS NOT NULL THEN 1.0::DOUBLE / (60 + dr) ELSE 0 END + CASE WHEN kw > 0 THEN 1.0::DOUBLE / (60 + kr) ELSE 0 END + CASE confidence WHEN 'proven' THEN 0.4 WHEN 'validated' THEN 0.2 ELSE 0.0 END
      + CASE WHEN last_accessed_at IS NULL THEN 0.0 ELSE -0.2 * (1 - exp(-((epoch_us({S.NOW}) - epoch_us(last_accessed_at)) / 8.64e10) / 90)) END + CASE WHEN access_count <= 0 THEN 0.0 ELSE least(0.15, log2(access_count + 1) * 0.03) END AS score FROM r WHERE kw > 0 OR sim IS NOT NULL),
    tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, node_id) AS position, CAST(ceil(len(content) * 0.28::DOUBLE) AS BIGINT) AS need FROM sc),
    b AS (SELECT *, sum(need) OVER (PARTITION BY query_id ORDER BY position) AS used FROM tp WHERE position <= 12)
    SELECT query_id, node_id, position, CASE WHEN kw > 0 THEN kr END AS keyword_rank, CASE WHEN sim IS NOT NULL THEN dr END AS dense_rank, round(score, 5) AS score FROM b WHERE position = 1 OR used <= 4000"""


@query("retrieve_hybrid", HYBRID, ("memory_nodes", "memory_embeddings", "memory_edges"))
def _(v):
    q = _queries(v).join(v.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    anchors = v.benchmark.select(F.col("item_id").alias("query_id"), F.lit("entity").alias("type"), (F.col("item_id") % 10).alias("id"))
    out = M.retrieve(q, nodes(v), now(), v.memory_embeddings, v.memory_edges, anchors)
    return out.select("query_id", "node_id", "position", "keyword_rank", "dense_rank", F.round("score", 5).alias("score"))


@query("touch_nodes", f"WITH {RETRIEVE}, hit AS (SELECT DISTINCT node_id FROM b WHERE position = 1 OR used <= 4000) SELECT node_id, access_count + CASE WHEN node_id IN (SELECT node_id FROM hit) THEN 1 ELSE 0 END AS access_count FROM memory_nodes", ("memory_nodes",))
def _(v):
    return M.touch(nodes(v), M.retrieve(_queries(v), nodes(v), now()), now()).select("node_id", "access_count")


HASH = r"sha256(trim(regexp_replace(text, '[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')))"


@query("upsert_nodes", f"""WITH st AS (SELECT item_id AS node_id, {HASH} AS source_hash FROM benchmark), inc AS (SELECT doc_id + 1000000 AS node_id, {HASH} AS source_hash FROM documents UNION ALL SELECT item_id + 2000000, {HASH} FROM benchmark)
    SELECT node_id, source_hash FROM st UNION ALL SELECT min(node_id), source_hash FROM inc WHERE source_hash NOT IN (SELECT source_hash FROM st) GROUP BY source_hash""")
def _(v):
    from leadspan.functions.normalize import content_hash

    t = F.lit("t").alias("tenant_id")
    stored = v.benchmark.select(F.col("item_id").alias("node_id"), t, F.col("text").alias("content"), content_hash(F.col("text")).alias("source_hash"), F.lit(None).cast("timestamp").alias("archived_at"))
    inc = v.documents.select((F.col("doc_id") + 1000000).alias("node_id"), t, F.col("text").alias("content")).union(v.benchmark.select((F.col("item_id") + 2000000), t, "text"))
    return M.upsert_nodes(stored, inc, "node_id").select("node_id", "source_hash")


@query("index_candidates", """SELECT node_id, CASE confidence WHEN 'proven' THEN 300 WHEN 'validated' THEN 200 ELSE 100 END + confidence_score AS index_rank FROM memory_nodes""", ("memory_nodes",))
def _(v):
    return M.index_candidates(nodes(v)).select("node_id", "index_rank")


@query("framework_candidates", """WITH n AS (SELECT *, source_type = 'src1' AS ans FROM memory_nodes), r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY CASE WHEN ans THEN 0 ELSE 1 END, CASE confidence WHEN 'proven' THEN 3 WHEN 'validated' THEN 2 ELSE 1 END DESC, confidence_score DESC, node_id) AS position FROM n) SELECT node_id, position FROM r""", ("memory_nodes",))
def _(v):
    named = nodes(v).withColumn("source_type", F.when(F.col("source_type") == "src1", "interview_answer").otherwise(F.col("source_type")))
    return M.framework_candidates(named).select("node_id", "position")


@query("replace_index", """WITH c AS (SELECT tenant_id, node_id FROM memory_nodes), e AS (SELECT 't' || (p_partkey % 3) AS tenant_id, 'entry' || p_partkey AS name, unnest([p_partkey % 700, p_partkey * 3 % 700, 900000]) AS node_id FROM part)
    SELECT e.tenant_id, e.name, count(*) AS ids FROM e JOIN c ON c.tenant_id = e.tenant_id AND c.node_id = e.node_id GROUP BY 1, 2""", ("memory_nodes",))
def _(v):
    k = F.col("p_partkey")
    entries = v.part.select(F.concat(F.lit("t"), k % 3).alias("tenant_id"), F.concat(F.lit("entry"), k).alias("name"), F.array(k % 700, k * 3 % 700, F.lit(900000).cast("bigint")).alias("node_ids"))
    return M.replace_index(entries, M.newest_nodes(nodes(v))).select("tenant_id", "name", F.size("node_ids").cast("bigint").alias("ids"))


ENTITIES = """WITH RECURSIVE inc AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, type ORDER BY seq) AS step, list_filter(coalesce(aliases, []), lambda a: a <> name) AS al FROM mentions),
    g AS (SELECT tenant_id, type FROM entities UNION SELECT tenant_id, type FROM mentions),
    first AS (SELECT g.tenant_id, g.type, list({'id': entity_id, 'name': name, 'al': list_filter(coalesce(aliases, []), lambda a: a <> name), 'p': properties} ORDER BY entity_id) FILTER (entity_id IS NOT NULL) AS es FROM g LEFT JOIN entities e ON e.tenant_id = g.tenant_id AND e.type = g.type GROUP BY 1, 2),
    r AS (SELECT tenant_id, type, CAST(0 AS BIGINT) AS step, coalesce(es, []) AS es, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS into_id, false AS inserted FROM first
      UNION ALL SELECT tenant_id, type, step + 1, CASE WHEN hit > 0 THEN list_transform(es, lambda e, k: CASE WHEN k = hit THEN {'id': e.id, 'name': e.name, 'al': list_distinct(list_concat(e.al, list_filter(list_append(al, name), lambda a: a <> e.name))), 'p': e.p} ELSE e END)
          ELSE list_append(es, {'id': entity_id, 'name': name, 'al': al, 'p': properties}) END, seq, CASE WHEN hit > 0 THEN es[hit].id ELSE entity_id END, hit = 0
        FROM (SELECT r.tenant_id, r.type, r.step, r.es, i.seq, i.name, i.al, i.entity_id, i.properties, coalesce(list_position(list_transform(r.es, lambda e: e.name = i.name OR list_contains(e.al, i.name) OR list_has_any(e.al, i.al)), true), 0) AS hit
              FROM r JOIN inc i ON i.tenant_id = r.tenant_id AND i.type = r.type AND i.step = r.step + 1))"""


@query("upsert_entities", f"""{ENTITIES}, last AS (SELECT tenant_id, type, unnest(es) AS e FROM r QUALIFY step = max(step) OVER (PARTITION BY tenant_id, type))
    SELECT e.id AS entity_id, tenant_id, type, e.name AS name, array_to_string(list_sort(list_distinct(e.al)), '|') AS aliases, e.p AS properties FROM last""", ("entities", "mentions"))
def _(v):
    return E.upsert_entities(v.entities, v.mentions)[0].withColumn("aliases", F.array_join("aliases", "|"))


@query("resolve_mentions", f"{ENTITIES} SELECT seq, tenant_id, type, into_id AS entity_id, inserted FROM r WHERE step > 0", ("entities", "mentions"))
def _(v):
    return E.upsert_entities(v.entities, v.mentions)[1]
