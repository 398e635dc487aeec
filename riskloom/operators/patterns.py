"""Pattern queries on the graph: filtered label scans, expansion, versions, paths, raw SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions.filters import matches
from riskloom.functions.ordering import in_blocks
from riskloom.graph import AuditGraph
from riskloom.session import cut_lineage

MAX_DOUBLINGS = 40

# Properties by which a label finds its earlier versions.
BUSINESS_KEYS = {
    "Process": ("name", "version"),
    "Audit": ("audit_date",),
    "FailureMode": ("code",),
    "Document": ("content_hash",),
    "Requirement": ("code",),
    "Incident": ("code",),
    "ProcedureStep": ("step_number", "process_id"),
}


def query_by_pattern(graph: AuditGraph, label: str, filters: Mapping[str, object] | None = None,
                     limit: int | None = None) -> DataFrame:
    """Nodes of a label that satisfy every filter, lowest ids first."""
    rows = graph.node(label).filter(matches(filters))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def with_provenance(graph: AuditGraph, entities: DataFrame) -> DataFrame:
    """Entities ⟕ their extraction records, one row per record."""
    records = graph.extractions.select(
        F.col("entity_id").alias("id"), F.col("id").alias("extraction_id"), "source_document_id",
        "extracted_by", "extracted_at", "confidence", "section", "page_number",
        F.when((F.col("line_range_start") != 0) & (F.col("line_range_end") != 0), F.col("line_range_start")).alias("line_start"),
        F.when((F.col("line_range_start") != 0) & (F.col("line_range_end") != 0), F.col("line_range_end")).alias("line_end"))
    return entities.join(records, "id", "left")


def entities_by_ids(graph: AuditGraph, ids: DataFrame | Sequence[str]) -> DataFrame:
    """(id, type) of the listed entities that exist."""
    if isinstance(ids, DataFrame):
        return graph.entities().join(ids.select("id").distinct(), "id", "left_semi").select("id", "type")
    return graph.entities().filter(F.col("id").isin(list(ids))).select("id", "type")


def hops(graph: AuditGraph, rel_types: Sequence[str] = (), direction: str = "both", also: Sequence[str] = (),
         ids: Sequence[str] | None = None) -> DataFrame:
    """Edges seen from a node: (id, neighbour_id, neighbour_type, rel_type, src, dst, direction) and ``also`` columns of the edge.

    Both directions come from one scan of the edges. With ``ids``, a few given ones, only what is seen from these nodes.
    """
    views = {
        "out": F.struct(F.col("src").alias("id"), F.col("dst").alias("neighbour_id"), F.col("dst_label").alias("neighbour_type"),
                        F.lit("out").alias("direction")),
        "in": F.struct(F.col("dst").alias("id"), F.col("src").alias("neighbour_id"), F.col("src_label").alias("neighbour_type"),
                       F.lit("in").alias("direction")),
    }
    chosen = list(views.values()) if direction == "both" else [views[direction]]
    edges = graph.edges(*rel_types)
    if ids is not None:
        edges = edges.filter(F.col("src").isin(*ids) | F.col("dst").isin(*ids))
    seen = edges.select("src", "dst", "rel_type", *also, F.inline(F.array(*chosen))).select(
        "id", "neighbour_id", "neighbour_type", "rel_type", "src", "dst", "direction", *also)
    return seen if ids is None else seen.filter(F.col("id").isin(*ids))


def expand_relationships(graph: AuditGraph, seeds: DataFrame, rel_types: Sequence[str] = (),
                         direction: str = "both", also: Sequence[str] = ()) -> DataFrame:
    """The hops that start at one of the seed ids."""
    if graph.adjacency is not None:
        return graph.adjacency.walk(seeds.select("id").distinct(), rel_types, direction).select(
            "id", "neighbour_id", "neighbour_type", "rel_type", "src", "dst", "direction", *also)
    return hops(graph, rel_types, direction, also).join(seeds.select("id").distinct(), "id", "left_semi")


def expanded_entities(expansion: DataFrame) -> DataFrame:
    """Distinct neighbours of an expansion as (id, type)."""
    return expansion.select(F.col("neighbour_id").alias("id"), F.col("neighbour_type").alias("type")).distinct()


def reachable(graph: AuditGraph, seeds: DataFrame, depth: int = 1, rel_types: Sequence[str] = ()) -> DataFrame:
    """(seed_id, id, type, depth): entities within ``depth`` hops of each seed, at their least depth."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    seeds = seeds.select(F.col("id").alias("seed_id")).distinct()
    found = seeds.select("seed_id", F.col("seed_id").alias("id"), F.lit(None).cast("string").alias("type"),
                         F.lit(0).alias("depth"))
    frontier = found
    for step in range(1, depth + 1):
        at = frontier.select("seed_id", "id")
        onward = (graph.adjacency.walk(at, rel_types) if graph.adjacency is not None
                  else at.join(hops(graph, rel_types).select("id", "neighbour_id", "neighbour_type"), "id"))
        frontier = (
            onward.select("seed_id", F.col("neighbour_id").alias("id"), F.col("neighbour_type").alias("type")).distinct()
            .join(found.select("seed_id", "id"), ["seed_id", "id"], "left_anti")
            .withColumn("depth", F.lit(step)))
        if step < depth:
            frontier = cut_lineage(frontier)
        found = found.unionByName(frontier)
    return found.filter("depth > 0")


def graph_pattern(graph: AuditGraph, label: str, filters: Mapping[str, object] | None = None,
                  relationships: Sequence[Mapping[str, str]] = (), include_chunks: bool = False,
                  limit: int | None = None) -> DataFrame:
    """Pattern scan, optional typed expansion, optional chunk context, as tagged rows.

    Each relationship is ``{"type": ..., "direction": "in"|"out"|"both", "target_type": ...}``.
    Rows: (part, id, type, other_id, detail) with part 'entity', 'relationship' or 'chunk'.
    """
    found = query_by_pattern(graph, label, filters, limit).select("id", F.lit(label).alias("type"))
    none = F.lit(None).cast("string")
    entities, parts = found, []
    for rel in relationships:
        expansion = expand_relationships(graph, found, (rel["type"],), rel.get("direction", "both"))
        if rel.get("target_type"):
            expansion = expansion.filter(F.col("neighbour_type") == rel["target_type"])
        entities = entities.unionByName(expanded_entities(expansion))
        parts.append(expansion.select(F.lit("relationship").alias("part"), F.col("src").alias("id"),
                                      F.col("rel_type").alias("type"), F.col("dst").alias("other_id"),
                                      F.col("direction").alias("detail")).distinct())
    entities = entities.distinct()
    if include_chunks:
        parts.append(chunks_of(graph, entities).select(
            F.lit("chunk").alias("part"), F.col("graph_node_id").alias("id"), none.alias("type"),
            F.col("id").alias("other_id"), F.coalesce("context", F.lit("")).alias("detail")))
    out = entities.select(F.lit("entity").alias("part"), "id", "type", none.alias("other_id"), none.alias("detail"))
    for part in parts:
        out = out.unionByName(part)
    return out


def chunks_of(graph: AuditGraph, nodes: DataFrame) -> DataFrame:
    """Chunks owned by the given graph nodes."""
    owners = nodes.select(F.col("id").alias("graph_node_id")).distinct()
    return graph.chunks.join(owners, "graph_node_id", "left_semi")


def related_ids(graph: AuditGraph, label: str, filters: Mapping[str, object] | None = None,
                relationship: Mapping[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Distinct ids of a label with the filters and, if given, an edge of a type / direction / target."""
    nodes = graph.node(label).filter(matches(filters)).select("id")
    if relationship:
        nodes = nodes.join(edge_ends(graph, relationship, label).distinct(), "id", "left_semi")
    return nodes if limit is None else nodes.orderBy("id").limit(limit)


def edge_ends(graph: AuditGraph, relationship: Mapping[str, str], label: str | None = None) -> DataFrame:
    """Ids at the asking end of the edges of a type / direction / target, once per edge.

    With the ``label`` that asks, of edges that have it at that end only: kinds of edges that never do are not read.
    """
    edges = all_edges(graph, relationship["type"])
    target, direction = relationship.get("target_label"), relationship.get("direction", "both")
    ends = []
    if direction in ("out", "both"):
        out = edges.filter(F.col("dst_label") == target) if target else edges
        out = out.filter(F.col("src_label") == label) if label else out
        ends.append(out.select(F.col("src").alias("id")))
    if direction in ("in", "both"):
        into = edges.filter(F.col("src_label") == target) if target else edges
        into = into.filter(F.col("dst_label") == label) if label else into
        ends.append(into.select(F.col("dst").alias("id")))
    return ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])


def all_edges(graph: AuditGraph, rel_type: str) -> DataFrame:
    """Edges of a type, with the provenance edges derived from the extraction table."""
    ext = graph.extractions
    if rel_type == "EXTRACTED_FROM":
        return ext.select(F.col("entity_id").alias("src"), F.col("id").alias("dst"),
                          F.col("entity_type").alias("src_label"), F.lit("Extraction").alias("dst_label"))
    if rel_type == "SOURCED_FROM":
        return ext.select(F.col("id").alias("src"), F.col("source_document_id").alias("dst"),
                          F.lit("Extraction").alias("src_label"), F.lit("Document").alias("dst_label"))
    if rel_type not in schemas.RELATIONSHIP_TYPES:
        return graph.spark.createDataFrame([], "src string, dst string, src_label string, dst_label string")
    return graph.edge(rel_type).select("src", "dst", "src_label", "dst_label")


def path_steps(graph: AuditGraph, path: Sequence[tuple[str, str, str]]) -> list[DataFrame]:
    """The (src, dst) pairs of each step of a path, without those from which its end cannot be reached.

    A step matches an edge in either direction, as long as the labels fit. From the last step back, each is reduced to the
    pairs that end where the next one begins.
    """
    steps: list[DataFrame] = []
    for source, rel_type, target in reversed(path):
        edges = all_edges(graph, rel_type)
        forward = edges.filter((F.col("src_label") == source) & (F.col("dst_label") == target)).select("src", "dst")
        backward = edges.filter((F.col("dst_label") == source) & (F.col("src_label") == target)).select(
            F.col("dst").alias("src"), F.col("src").alias("dst"))
        step = forward.unionByName(backward)
        if steps:
            step = step.join(steps[0].select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        steps.insert(0, step)
    return steps


def match_path(graph: AuditGraph, path: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(start_id, end_id) pairs connected by a chain of (from label, relationship, to label) steps.

    Pairs are made distinct after every step and each reaches the end of the path, so the chain never carries a row that
    leads nowhere, nor more rows than it has pairs.
    """
    first, *rest = path_steps(graph, path)
    pairs = first.select(F.col("src").alias("start_id"), F.col("dst").alias("end_id")).distinct()
    for step in rest:
        pairs = (pairs.join(step.withColumnRenamed("src", "end_id"), "end_id")
                 .select("start_id", F.col("dst").alias("end_id")).distinct())
    return pairs


def path_reach(graph: AuditGraph, path: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Distinct end entities per start entity of a path."""
    return match_path(graph, path).groupBy("start_id").agg(F.count(F.lit(1)).alias("ends"))


# --- versions -----------------------------------------------------------------

def latest_versions(graph: AuditGraph, label: str) -> DataFrame:
    """Nodes no newer version supersedes."""
    superseded = graph.edge("SUPERSEDES", dst_label=label).select(F.col("dst").alias("id")).distinct()
    return graph.node(label).join(superseded, "id", "left_anti")


def find_latest(graph: AuditGraph, label: str, **key: object) -> DataFrame:
    """The latest version with the given business key, at most one row."""
    wanted = BUSINESS_KEYS.get(label)
    if wanted is None:
        return graph.node(label).limit(0)
    if set(key) != set(wanted):
        raise ValueError(f"{label} is identified by {wanted}")
    return latest_versions(graph, label).filter(matches(key)).orderBy("id").limit(1)


def version_chains(graph: AuditGraph, label: str) -> DataFrame:
    """(id, latest_id, depth): every node with the newest version that leads to it.

    Path doubling: each round joins the pointers with themselves, so a chain of length n takes
    log2(n) rounds. Rounds are checkpointed.
    """
    jumps = graph.edge("SUPERSEDES", dst_label=label).select(
        F.col("dst").alias("id"), F.col("src").alias("head"), F.lit(1).cast("bigint").alias("hops")).distinct()
    jumps = cut_lineage(jumps)
    for _ in range(MAX_DOUBLINGS):
        onward = jumps.select(F.col("id").alias("head"), F.col("head").alias("next"), F.col("hops").alias("more"))
        stepped = jumps.join(onward, "head", "left")
        moved = cut_lineage(stepped.select(
            "id", F.coalesce("next", "head").alias("head"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.col("next").isNotNull().alias("moved")))
        jumps = moved.select("id", "head", "hops").distinct()
        if moved.filter("moved").isEmpty():
            break
    else:
        raise ValueError("SUPERSEDES contains a cycle")
    return (graph.node(label).select("id").join(jumps, "id", "left")
            .select("id", F.coalesce("head", "id").alias("latest_id"), F.coalesce("hops", F.lit(0)).alias("depth")))


# --- raw access ------------------------------------------------------------------

def page(rows: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of an ordered result."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_index(rows: DataFrame, key: str, page_rows: int) -> DataFrame:
    """(page, first): the first key of every page of ``page_rows`` rows in order of ``key``, pages counted from 0.

    Keys must be unique; null keys are on no page. Only the keys are sorted, in range partitions whose counts give each its
    place; write the result and keep it beside the table.
    """
    keys = in_blocks(rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("first")), ["first"], [])
    sizes = keys.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    offsets = sizes.select("_block", (F.sum("n").over(Window.orderBy("_block")) - F.col("n")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy("first")) - 1
    placed = keys.withColumn("place", place).join(offsets, "_block").withColumn("place", F.col("place") + F.col("offset"))
    return placed.filter(F.col("place") % page_rows == 0).select(F.floor(F.col("place") / page_rows).alias("page"), "first")


def page_by_key(rows: DataFrame, index: DataFrame, key: str, number: int) -> DataFrame:
    """One page by a range of keys that the index names, two of its rows; a late page reads no more than the first.

    Filters on the key reach the scan, and files that are sorted or partitioned by it are skipped.
    """
    bounds = {r.page: r.first for r in index.filter(F.col("page").isin(number, number + 1)).collect()}
    if number not in bounds:
        return rows.limit(0)
    found = rows.filter(F.col(key) >= F.lit(bounds[number]))
    return (found.filter(F.col(key) < F.lit(bounds[number + 1])) if number + 1 in bounds else found).orderBy(key)


def run_query(graph: AuditGraph, sql: str, **params: object) -> DataFrame:
    """Parameterised SQL (``:name``) over the graph tables, registered as temp views by label."""
    for label in schemas.LABELS:
        graph.node(label).createOrReplaceTempView(label)
    graph.edges().createOrReplaceTempView("Edge")
    graph.extractions.createOrReplaceTempView("Extraction")
    graph.chunks.createOrReplaceTempView("Chunk")
    return graph.spark.sql(sql, args=params)
