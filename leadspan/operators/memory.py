"""Text memory: retrieval ranking, graph walks, maintenance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspan.functions.normalize import approx_tokens, content_hash, tokens
from leadspan.functions.similarity import cosine
from leadspan.operators.graph import walk
from leadspan.operators.ranking import computed, earliest_by, ordinals, top_k
from leadspan.operators.vectors import similar_clusters


def rerank_terms(now: Column) -> dict[str, Column]:
    """Confidence, recency and access terms added to the fused rank score."""
    age_days = (F.unix_micros(now) - F.unix_micros("last_accessed_at")) / F.lit(8.64e10)
    return {
        "confidence_boost": F.when(F.col("confidence") == "proven", 0.4).when(F.col("confidence") == "validated", 0.2).otherwise(0.0),
        "recency_decay": F.coalesce(F.lit(-0.2) * (F.lit(1.0) - F.exp(-age_days / 90.0)), F.lit(0.0)),
        "access_boost": F.when(F.col("access_count") <= 0, 0.0).otherwise(F.least(F.lit(0.15), F.log2(F.col("access_count") + 1.0) * 0.03)),
    }


def confidence_rank() -> Column:
    return F.when(F.col("confidence") == "proven", 3).when(F.col("confidence") == "validated", 2).otherwise(1)


QUERY_TILE_VALUES = 2**18  # components of a tile of queries: 4,096 vectors of 64
NODE_TILE_VALUES = 2**21
CHUNK_NODES = 1024  # vectors compared with a tile of queries at a time


def _tiles(vectors: DataFrame, values: int) -> dict[int, int]:
    """Number of tiles for each length of vectors (one row a length), so that a tile holds about ``values`` components."""
    counts = vectors.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter("size > 0")
    return {r["size"]: -(-r["n"] * r["size"] // values) for r in counts.collect()}


def dense_rank(queries: DataFrame, embeddings: DataFrame, k: int, query_values: int = QUERY_TILE_VALUES, node_values: int = NODE_TILE_VALUES) -> DataFrame:
    """Top ``k`` nodes per query by cosine (12 decimals, ties to the smaller node). Vectors of another length are skipped.

    Queries and vectors fall into tiles of bounded size; every tile of queries meets every tile of vectors in a task of its own,
    which keeps the best k of each query. Nothing passes through the driver.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(embeddings.dtypes)["node_id"]
    ask_tiles, node_tiles = _tiles(queries, query_values), _tiles(embeddings, node_values)
    of = lambda tiles: F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") for both in ({0: 0} | tiles).items() for x in both]), F.size("vector").cast("bigint"))
    here = lambda key, tiles: F.pmod(F.xxhash64(key), of(tiles))
    every = lambda tiles: F.explode(F.sequence(F.lit(0).cast("bigint"), of(tiles) - 1))
    met = of(ask_tiles).isNotNull() & of(node_tiles).isNotNull() & (F.size("vector") > 0)
    asks = queries.filter(met).select("query_id", "vector", F.size("vector").alias("size"), here("query_id", ask_tiles).alias("q"), every(node_tiles).alias("v"))
    nodes = embeddings.filter(met).select("node_id", "vector", F.size("vector").alias("size"), here("node_id", node_tiles).alias("v"), every(ask_tiles).alias("q"))
    sides = [df.select(F.struct("size", "q", "v").alias("_tile"), key, "vector") for df, key in ((asks, "query_id"), (nodes, "node_id"))]
    best = sides[0].groupBy("_tile").cogroup(sides[1].groupBy("_tile")).applyInPandas(_best_of(k), f"query_id {kinds[0]}, node_id {kinds[1]}, similarity double")
    return top_k(best, ["query_id"], [F.col("similarity").desc(), F.col("node_id")], k, "dense_rank")


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=float)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best_of(k: int):
    """The k most similar nodes of a tile to each query of another, by similarity and then by node."""

    def best(asks: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": asks["query_id"][:0], "node_id": nodes["node_id"][:0], "similarity": pd.Series(dtype=float)})
        if not len(asks) or not len(nodes):
            return none
        # in order of node, so that of equal similarities the first ones stay
        nodes = nodes.sort_values("node_id", kind="stable")
        q, n, ids = _unit(asks["vector"]), _unit(nodes["vector"]), nodes["node_id"].to_numpy()
        held = np.full((len(q), k), -np.inf)
        at = np.zeros((len(q), k), dtype=np.int64)
        for first in range(0, len(n), CHUNK_NODES):
            scores = np.round(q @ n[first : first + CHUNK_NODES].T, 12)
            rows = np.flatnonzero((scores > held[:, -1:]).any(axis=1))
            if len(rows):
                both = np.concatenate([held[rows], scores[rows]], axis=1)
                places = np.concatenate([at[rows], np.broadcast_to(np.arange(first, first + scores.shape[1]), (len(rows), scores.shape[1]))], axis=1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                held[rows], at[rows] = np.take_along_axis(both, order, axis=1), np.take_along_axis(places, order, axis=1)
        some = held > -np.inf
        return pd.DataFrame({"query_id": np.repeat(asks["query_id"].to_numpy(), some.sum(axis=1)), "node_id": ids[at[some]], "similarity": held[some]})

    return best


def newest_nodes(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """The active nodes, or the newest ``limit`` of each tenant."""
    if limit is None:
        return nodes.filter("archived_at IS NULL")
    return top_k(nodes.filter("archived_at IS NULL"), ["tenant_id"], [F.col("created_at").desc(), F.col("node_id")], limit).drop("rn")


def retrieve(
    queries: DataFrame, nodes: DataFrame, now: Column, embeddings: DataFrame | None = None, edges: DataFrame | None = None, anchors: DataFrame | None = None,
    top: int = 12, token_budget: int = 4000, graph_depth: int = 2, candidates: int | None = None,
) -> DataFrame:
    """Hybrid retrieval for a batch of queries (query_id, tenant_id, text and, with embeddings, vector).

    Candidates are the active nodes around a query's anchors, else all active nodes of the tenant (or its newest
    ``candidates``). Dense and keyword ranks are fused by 1/(60 + rank), then confidence, recency and access are added; the best ``top`` are kept
    as long as their tokens fit the budget (the first always is).
    """
    active = nodes.filter("archived_at IS NULL")
    recent = queries.select("query_id", "tenant_id").join(newest_nodes(active, candidates).select("tenant_id", "node_id"), "tenant_id").select("query_id", "node_id")
    if anchors is not None and edges is not None:
        near = walk(edges, anchors, graph_depth, incoming=True).join(active.select("node_id"), "node_id", "left_semi").select("query_id", "node_id")
        near = near.join(queries.select("query_id", "tenant_id"), "query_id").join(active.select("node_id", "tenant_id"), ["node_id", "tenant_id"]).select("query_id", "node_id")
        chosen = near.union(recent.join(near.select("query_id").distinct(), "query_id", "left_anti"))
    else:
        chosen = recent
    keyword = _keyword_scores(queries, active, None if candidates is None and anchors is None else chosen)
    # terms and sizes are worked out once per node, texts do not travel with the pairs
    slim_nodes = active.select("node_id", "created_at", approx_tokens(F.col("content")).alias("tokens_needed"), *[c.alias(n) for n, c in rerank_terms(now).items()])
    if embeddings is None:  # without vectors only nodes with a hit can be returned
        hits = keyword if candidates is None and anchors is None else keyword.join(chosen, ["query_id", "node_id"], "left_semi")
        rows = hits.join(slim_nodes, "node_id")
    else:
        rows = chosen.join(slim_nodes, "node_id").join(keyword, ["query_id", "node_id"], "left").fillna(0.0, ["keyword"])
    if embeddings is not None:
        vectors = embeddings.select("node_id", F.col("vector").alias("_v"))
        rows = rows.join(queries.select("query_id", F.col("vector").alias("_qv")), "query_id").join(vectors, "node_id", "left")
        rows = rows.withColumn("similarity", cosine(F.col("_qv"), F.col("_v")))
    else:
        rows = rows.withColumn("similarity", F.lit(None).cast("double"))
    slim = rows.select("query_id", "node_id", "keyword", "similarity", "tokens_needed", "created_at", *rerank_terms(now))
    slim = slim.withColumn("_newer", -F.unix_micros("created_at"))
    place = (lambda df, score, name: ordinals(df.withColumn("_s", -F.coalesce(F.col(score), F.lit(-9.0))), ["query_id"], ["_s", "_newer", "node_id"], name).drop("_s")) if anchors is not None else (
        lambda df, score, name: df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc_nulls_last(), "_newer", "node_id")) - 1)
    )
    ranked = place(place(slim, "keyword", "_k"), "similarity", "_d")
    keyword_rank = F.when(F.col("keyword") > 0, F.col("_k") + 1)
    dense = F.when(F.col("similarity").isNotNull(), F.col("_d") + 1)
    part = lambda r: F.coalesce(1.0 / (60.0 + r), F.lit(0.0))
    scored = computed(ranked, keyword_rank=keyword_rank, dense_rank=dense)
    scored = computed(scored, rrf=part(F.col("dense_rank")) + part(F.col("keyword_rank")))
    scored = computed(scored, score=F.col("rrf") + F.col("confidence_boost") + F.col("recency_decay") + F.col("access_boost"))
    relevant = scored.filter("dense_rank IS NOT NULL OR keyword_rank IS NOT NULL")
    best = top_k(relevant, ["query_id"], [F.col("score").desc(), F.col("_newer"), F.col("node_id")], top, "position")
    return take_budget(best, token_budget).select("query_id", "node_id", "position", "score", "rrf", "keyword_rank", "dense_rank", "tokens_needed")


def _keyword_scores(queries: DataFrame, nodes: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Keyword score of each candidate with at least one hit.

    Every text is split once; its distinct words meet the query words in an equi-join, and hits are counted per pair.
    """
    needed = nodes if chosen is None else nodes.join(chosen.select("node_id").distinct(), "node_id", "left_semi")
    needed = needed.select("node_id", "tenant_id", tokens(F.col("content")).alias("_t"))
    words = needed.select("node_id", "tenant_id", F.size("_t").alias("_n"), F.explode(F.array_distinct("_t")).alias("word"))
    asked = queries.select("query_id", "tenant_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    hits = words.join(asked, ["tenant_id", "word"]).groupBy("query_id", "node_id", "_n").agg(F.count(F.lit(1)).alias("_h"))
    score = F.col("_h") / F.greatest(F.lit(1.0), F.log2(F.col("_n") + 2.0))
    return hits.select("query_id", "node_id", score.alias("keyword"))


def take_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Prefix of each query's list whose tokens fit; the first row is always kept. Lists are already cut to top k."""
    w = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_used", F.sum("tokens_needed").over(w)).filter((F.col("position") == 1) | (F.col("_used") <= budget)).drop("_used")


def touch(nodes: DataFrame, returned: DataFrame, now: Column) -> DataFrame:
    """Next snapshot: one more access and the time of it for every returned node."""
    hit = returned.select("node_id").distinct().withColumn("_hit", F.lit(True))
    j = nodes.join(hit, "node_id", "left")
    return j.withColumn("access_count", F.col("access_count") + F.when(F.col("_hit"), 1).otherwise(0)).withColumn(
        "last_accessed_at", F.when(F.col("_hit"), now).otherwise(F.col("last_accessed_at"))
    ).drop("_hit")


def missing_embeddings(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    return nodes.filter("archived_at IS NULL").join(embeddings.select("node_id"), "node_id", "left_anti")


def cluster_head(members: DataFrame) -> DataFrame:
    """Head per cluster of active nodes: confidence, then accesses, then the oldest."""
    order = F.struct(confidence_rank(), F.col("access_count"), -F.unix_micros("created_at"), -F.col("node_id"))
    return members.groupBy("cluster_id").agg(F.max_by("node_id", order).alias("head_id"), F.count(F.lit(1)).alias("members")).filter("members >= 2")


def fold_clusters(nodes: DataFrame, clusters: DataFrame, edges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after folding: everyone but the head is archived and superseded by it."""
    members = nodes.filter("archived_at IS NULL").join(clusters, "node_id")
    heads = cluster_head(members)
    losers = members.join(heads, "cluster_id").filter("node_id <> head_id").select("node_id", "head_id")
    marked = nodes.join(losers.select("node_id", F.lit(True).alias("_lost")), "node_id", "left").withColumn(
        "archived_at", F.when(F.col("_lost"), now).otherwise(F.col("archived_at"))
    ).drop("_lost")
    new = losers.select(
        F.lit("node").alias("from_type"), F.col("head_id").alias("from_id"), F.lit("node").alias("to_type"), F.col("node_id").alias("to_id"),
        F.lit("supersedes").alias("relation"), now.alias("created_at"),
    )
    return marked, edges.unionByName(new, allowMissingColumns=True)


def promote_by_access(nodes: DataFrame, now: Column) -> DataFrame:
    """Often used nodes move up one level, active ones only."""
    n, age = F.col("access_count"), (F.unix_micros(now) - F.unix_micros("created_at")) / F.lit(8.64e10)
    live = F.col("archived_at").isNull()
    to_proven = live & (F.col("confidence") == "validated") & (n >= 10) & (age >= 14)
    to_validated = live & (F.col("confidence") == "hypothesis") & (n >= 3)
    up = nodes.withColumn("_p", F.when(to_proven, 2).when(to_validated, 1).otherwise(0))
    return (
        up.withColumn("confidence", F.when(F.col("_p") == 2, "proven").when(F.col("_p") == 1, "validated").otherwise(F.col("confidence")))
        .withColumn("confidence_score", F.when(F.col("_p") == 2, F.least(F.lit(100), n + 80)).when(F.col("_p") == 1, F.least(F.lit(79), n * 5 + 40)).otherwise(F.col("confidence_score")))
        .drop("_p")
    )


def flag_contradictions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both ends of a contradiction (between active nodes' edges) fall back to hypothesis with half the score."""
    live = nodes.filter("archived_at IS NULL").select("node_id")
    c = edges.filter("relation = 'contradicts' AND from_type = 'node' AND to_type = 'node'").join(live.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi")
    ends = c.select(F.col("from_id").alias("node_id")).union(c.select("to_id")).distinct().join(live, "node_id", "left_semi").withColumn("_hit", F.lit(True))
    j = nodes.join(ends, "node_id", "left")
    drop = F.col("_hit") & ((F.col("confidence") != "hypothesis") | (F.col("confidence_score") > 1))
    return j.withColumn("_drop", F.coalesce(drop, F.lit(False))).withColumn(
        "confidence_score", F.when(F.col("_drop"), F.floor(F.col("confidence_score") / 2)).otherwise(F.col("confidence_score"))
    ).withColumn("confidence", F.when(F.col("_drop"), "hypothesis").otherwise(F.col("confidence"))).drop("_hit", "_drop")


def archive_stale(nodes: DataFrame, now: Column, days: int = 365) -> DataFrame:
    stale = F.col("archived_at").isNull() & (F.col("last_accessed_at") < F.timestamp_add("DAY", F.lit(-days), now))
    return nodes.withColumn("archived_at", F.when(stale, now).otherwise(F.col("archived_at")))


def maintain_memory(nodes: DataFrame, embeddings: DataFrame, edges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """One maintenance pass: fold near-copies, promote, weigh contradictions, archive. A second pass changes nothing
    but what new accesses or age bring."""
    clusters = similar_clusters(embeddings)
    nodes, edges = fold_clusters(nodes, clusters, edges, now)
    nodes = promote_by_access(nodes, now)
    nodes = flag_contradictions(nodes, edges)
    return archive_stale(nodes, now), edges


def upsert_nodes(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Stored nodes plus the first incoming row of every (tenant, content hash) not active yet."""
    new = incoming.withColumn("source_hash", content_hash(F.col("content")))
    first = earliest_by(new, ["tenant_id", "source_hash"], F.col(order))
    known = stored.filter("archived_at IS NULL").select("tenant_id", "source_hash")
    return stored.unionByName(first.join(known, ["tenant_id", "source_hash"], "left_anti"), allowMissingColumns=True)


def index_candidates(nodes: DataFrame, limit: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Active nodes of each tenant with their index rank (level, then score), the best ``limit`` if given."""
    rank = confidence_rank() * 100 + F.col("confidence_score")
    body = F.col("content") if max_chars is None else F.when(F.length("content") > max_chars, F.concat(F.substring("content", 1, max_chars), F.lit("…"))).otherwise(F.col("content"))
    ranked = nodes.filter("archived_at IS NULL").withColumn("index_rank", rank).withColumn("content", body)
    if limit is None:
        return ranked
    return top_k(ranked, ["tenant_id"], [F.col("index_rank").desc(), F.col("created_at").desc(), F.col("node_id")], limit).drop("rn")


def framework_candidates(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Active nodes of each tenant with their position: interview answers first, then by level and score; the first ``limit`` if given."""
    is_answer = F.col("source_type") == "interview_answer"
    active = nodes.filter("archived_at IS NULL")
    order = [F.when(is_answer, 0).otherwise(1), confidence_rank().desc(), F.col("confidence_score").desc(), F.col("node_id")]
    if limit is not None:
        return top_k(active, ["tenant_id"], order, limit, "position")
    placed = active.withColumns({"_answer": F.when(is_answer, 0).otherwise(1), "_level": -confidence_rank(), "_score": -F.col("confidence_score")})
    numbered = ordinals(placed, ["tenant_id"], ["_answer", "_level", "_score", "node_id"], "_at")
    return numbered.withColumn("position", F.col("_at") + 1).drop("_answer", "_level", "_score", "_at")


def replace_index(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """New index rows of the tenants in ``entries``: ids that are no candidates are dropped, then empty entries."""
    ids = entries.select("tenant_id", "name", F.posexplode("node_ids").alias("_at", "node_id"))
    valid = ids.join(candidates.select("tenant_id", "node_id"), ["tenant_id", "node_id"], "left_semi")
    kept = valid.groupBy("tenant_id", "name").agg(F.array_sort(F.collect_list(F.struct("_at", "node_id"))).alias("_v"))
    return entries.drop("node_ids").join(kept.select("tenant_id", "name", F.col("_v.node_id").alias("node_ids")), ["tenant_id", "name"])


def write_index(entries: DataFrame, candidates: DataFrame, path: str) -> None:
    """Replaces the index of the tenants in ``entries`` below ``path``; the files of other tenants are not touched.

    A tenant whose entries are all dropped is left with a marker row, so that its old index goes too.
    """
    rows = replace_index(entries, candidates)
    marker = entries.select("tenant_id").distinct()
    rows.unionByName(marker, allowMissingColumns=True).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("name IS NOT NULL")
