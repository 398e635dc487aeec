"""Reads a sales-style star schema as an audit graph.

Orders become documents, parts failure modes / risks / requirements, suppliers controls and
procedure steps, nations processes, customers audits, events findings and incidents; line items
carry most relationships and the extraction provenance. Every table is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.graph import AuditGraph
from riskloom.session import spread

EPOCH = "2024-01-01"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, spread for per-document text work."""
    return spread(read_table(spark, sf_dir, "documents"))


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _key(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), column)


def _day(offset: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), offset.cast("int")).cast("timestamp_ntz")


def _edges(pairs: DataFrame, rel_type: str | Column, src_label: str, dst_label: str) -> DataFrame:
    rel = F.lit(rel_type) if isinstance(rel_type, str) else rel_type
    return pairs.select(
        "src", "dst", rel.alias("rel_type"),
        F.lit(src_label).alias("src_label"), F.lit(dst_label).alias("dst_label"),
        F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("extraction_id"),
        F.lit("CONFIRMED").alias("status"),
    )


def load_graph(spark: SparkSession, sf_dir: str) -> AuditGraph:
    t = lambda name: read_table(spark, sf_dir, name)

    def documents() -> DataFrame:
        o = t("orders")
        return o.select(
            _key("doc", "o_orderkey").alias("id"),
            F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
            _pick(schemas.DOCUMENT_TYPES, F.col("o_orderkey")).alias("document_type"),
            F.when(F.col("o_orderstatus") == "F", "PROCESSED")
             .when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILED").alias("status"),
            F.lit(None).cast("string").alias("storage_path"),
            F.sha2(_key("doc", "o_orderkey"), 256).alias("content_hash"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("note-"), "o_orderkey", F.lit(".txt")))
             .otherwise(F.concat(F.lit("Safety ST "), F.col("o_custkey") % 12 + 1, F.lit(" rev.pdf")))
             .alias("file_name"),
            F.col("o_orderdate").alias("uploaded_at"),
            F.lit(None).cast("string").alias("error"),
        )

    def failure_modes() -> DataFrame:
        key = F.col("p_partkey")
        severity = (F.col("p_size") % 10 + 1).cast("int")
        occurrence = (key % 10 + 1).cast("int")
        detection = (F.floor(key / 10) % 10 + 1).cast("int")
        return t("part").select(
            _key("fm", "p_partkey").alias("id"), _day(key % 60).alias("created_at"),
            _day(key % 60).alias("updated_at"),
            _key("FM", "p_partkey").alias("code"), F.col("p_name").alias("description"),
            severity.alias("severity"), occurrence.alias("occurrence"), detection.alias("detection"),
            F.when(key % 17 != 0, severity * occurrence * detection).cast("int").alias("rpn"),
        )

    def risks() -> DataFrame:
        day = _day(F.col("p_partkey") % 90)
        return t("part").select(
            _key("risk", "p_partkey").alias("id"), day.alias("created_at"), day.alias("updated_at"),
            _pick(schemas.RISK_LEVELS, F.col("p_size")).alias("level"),
            F.col("p_name").alias("description"),
            ((F.col("p_size") % 5 + 1) / 5).alias("likelihood"),
            ((F.col("p_partkey") % 5 + 1) / 5).alias("impact"),
        )

    def controls() -> DataFrame:
        day = _day(F.col("s_suppkey") % 60)
        return t("supplier").select(
            _key("ctl", "s_suppkey").alias("id"), day.alias("created_at"), day.alias("updated_at"),
            _pick(schemas.CONTROL_TYPES, F.col("s_suppkey")).alias("control_type"),
            F.col("s_name").alias("description"),
            F.when(F.col("s_suppkey") % 13 != 0, F.round((F.col("s_acctbal") + 1000) / 110, 2))
             .alias("effectiveness"),
        )

    def processes() -> DataFrame:
        day = _day(F.col("n_nationkey"))
        return t("nation").select(
            _key("proc", "n_nationkey").alias("id"), day.alias("created_at"), day.alias("updated_at"),
            F.col("n_name").alias("name"), F.concat(F.lit("1."), "n_regionkey").alias("version"),
            F.lit(None).cast("string").alias("description"),
        )

    def audits() -> DataFrame:
        day = _day(F.col("c_custkey") % 365)
        return t("customer").select(
            _key("aud", "c_custkey").alias("id"), day.alias("created_at"), day.alias("updated_at"),
            F.col("c_name").alias("auditor"),
            F.date_format(day, "yyyy-MM-dd").alias("audit_date"), F.col("c_mktsegment").alias("scope"),
        )

    def procedure_steps() -> DataFrame:
        day = _day(F.col("s_suppkey") % 60)
        none = F.lit(None).cast("string")
        return t("supplier").select(
            _key("step", "s_suppkey").alias("id"), day.alias("created_at"), day.alias("updated_at"),
            (F.col("s_suppkey") % 9 + 1).cast("int").alias("step_number"),
            _key("proc", "s_nationkey").alias("process_id"), F.col("s_name").alias("description"),
            none.alias("responsible_role"), none.alias("frequency"), none.alias("evidence"),
        )

    def findings() -> DataFrame:
        kind = F.col("event_type")
        return t("events").select(
            _key("fnd", "event_id").alias("id"), F.col("ts").alias("created_at"),
            (F.col("ts") + F.make_dt_interval(hours=F.floor("value").cast("int"))).alias("updated_at"),
            F.when(kind == "signup", "RESOLVED").when(kind == "purchase", "CLOSED")
             .when(kind == "click", "IN_PROGRESS").otherwise("OPEN").alias("status"),
            _pick(schemas.FINDING_PRIORITIES, F.col("event_id")).alias("priority"),
            kind.alias("description"),
        )

    def requirements() -> DataFrame:
        day = _day(F.col("p_partkey") % 60)
        return t("part").select(
            _key("req", "p_partkey").alias("id"), day.alias("created_at"), day.alias("updated_at"),
            _pick(schemas.REQUIREMENT_TYPES, F.col("p_partkey")).alias("requirement_type"),
            _key("REQ", "p_partkey").alias("code"), F.col("p_name").alias("description"),
            F.col("p_brand").alias("source"),
        )

    def incidents() -> DataFrame:
        none = F.lit(None).cast("string")
        return t("events").filter("event_type = 'error'").select(
            _key("inc", "event_id").alias("id"), F.col("ts").alias("created_at"),
            F.col("ts").alias("updated_at"), _key("INC", "event_id").alias("code"),
            F.col("event_type").alias("description"),
            _pick(("MINOR", "MODERATE", "SERIOUS", "PSIF"), F.col("user_id")).alias("severity"),
            F.lit("OPEN").alias("status"), F.col("ts").alias("occurred_at"),
            none.alias("location"), none.alias("root_cause"), none.alias("process_id"),
        )

    def line_pairs(condition: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
        # Numbers are cheaper to make distinct than the ids built from them.
        pairs = t("lineitem").filter(condition).select(src[1], dst[1]).distinct()
        return pairs.select(_key(*src).alias("src"), _key(*dst).alias("dst"))

    def identifies() -> DataFrame:
        pairs = line_pairs("true", ("doc", "l_orderkey"), ("fm", "l_partkey"))
        return _edges(pairs, "IDENTIFIES", "Document", "FailureMode")

    def implies() -> DataFrame:
        pairs = t("part").filter("p_size > 5").select(
            _key("fm", "p_partkey").alias("src"),
            _key("risk", F.col("p_partkey") - F.col("p_partkey") % 4).alias("dst"))
        return _edges(pairs, "IMPLIES", "FailureMode", "Risk")

    def mitigates() -> DataFrame:
        on_mode = line_pairs("l_returnflag = 'R' and l_linenumber = 1",
                             ("ctl", "l_suppkey"), ("fm", "l_partkey"))
        on_risk = line_pairs("l_returnflag = 'A' and l_linenumber = 2 and l_quantity >= 40",
                             ("ctl", "l_suppkey"), ("risk", "l_partkey"))
        return _edges(on_mode, "MITIGATES", "Control", "FailureMode").unionByName(
            _edges(on_risk, "MITIGATES", "Control", "Risk"))

    def implements() -> DataFrame:
        pairs = t("supplier").filter("s_acctbal > 2000").select(
            _key("step", "s_suppkey").alias("src"), _key("ctl", "s_suppkey").alias("dst"))
        return _edges(pairs, "IMPLEMENTS", "ProcedureStep", "Control")

    def uses() -> DataFrame:
        return _edges(t("orders").select(_key("aud", "o_custkey").alias("src"),
                                         _key("doc", "o_orderkey").alias("dst")),
                      "USES", "Audit", "Document")

    def evaluates() -> DataFrame:
        return _edges(t("customer").select(_key("aud", "c_custkey").alias("src"),
                                           _key("proc", "c_nationkey").alias("dst")),
                      "EVALUATES", "Audit", "Process")

    def relates_to() -> DataFrame:
        return _edges(t("orders").select(_key("doc", "o_orderkey").alias("src"),
                                         _key("proc", F.col("o_custkey") % 25).alias("dst")),
                      "RELATES_TO", "Document", "Process")

    def satisfies(rel_type: str, line_status: str) -> DataFrame:
        pairs = line_pairs(f"l_linenumber = 3 and l_quantity >= 40 and l_linestatus = '{line_status}'",
                           ("doc", "l_orderkey"), ("req", "l_partkey"))
        return _edges(pairs, rel_type, "Document", "Requirement")

    def addresses() -> DataFrame:
        return _edges(t("events").select(_key("fnd", "event_id").alias("src"),
                                         _key("fm", F.col("event_id") % 200).alias("dst")),
                      "ADDRESSES", "Finding", "FailureMode")

    def references() -> DataFrame:
        return _edges(t("events").filter("value > 10").select(
            _key("fnd", "event_id").alias("src"), _key("ctl", F.col("user_id") % 10).alias("dst")),
            "REFERENCES", "Finding", "Control")

    def supersedes() -> DataFrame:
        return _edges(t("part").filter("p_size > 40 and p_partkey > 0").select(
            _key("fm", "p_partkey").alias("src"), _key("fm", F.col("p_partkey") - 1).alias("dst")),
            "SUPERSEDES", "FailureMode", "FailureMode")

    def extractions() -> DataFrame:
        def branch(condition: str, label: str, prefix: str, key: str) -> DataFrame:
            lines = t("lineitem").filter(condition).groupBy("l_orderkey", key).agg(
                F.min("l_discount").alias("discount"), F.min("l_linenumber").alias("line"),
                F.min("l_shipdate").alias("shipped"))
            return lines.select(
                F.concat(F.lit("ext-"), "l_orderkey", F.lit(f"-{prefix}-"), key).alias("id"),
                _key(prefix, key).alias("entity_id"), F.lit(label).alias("entity_type"),
                _key("doc", "l_orderkey").alias("source_document_id"),
                F.lit("extractor").alias("extracted_by"), F.col("shipped").alias("extracted_at"),
                F.round(1 - 4 * F.col("discount"), 2).alias("confidence"),
                F.concat(F.lit("Item "), "line").alias("section"),
                F.col("line").alias("page_number"), (F.col("line") * 10).alias("line_range_start"),
                (F.col("line") * 10 + 5).alias("line_range_end"),
            )
        return (branch("true", "Control", "ctl", "l_suppkey")
                .unionByName(branch("true", "FailureMode", "fm", "l_partkey"))
                .unionByName(branch("l_returnflag = 'N'", "Risk", "risk", "l_partkey")))

    def chunks() -> DataFrame:
        # Every text is a chunk, with or without an embedding; an embedding without a text is one too.
        vec = F.col("vec_id")
        tokens = (vec * 37 % 900 + 20).cast("int")
        texts = t("documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
        return t("embeddings").join(texts, "vec_id", "full").select(
            _key("chk", "vec_id").alias("id"), "embedding",
            _key("doc", F.floor(vec / 5)).alias("graph_node_id"),
            _key("doc", F.floor(vec / 5)).alias("document_id"),
            F.coalesce("text", F.lit("")).alias("chunk_text"), (vec % 5).cast("int").alias("chunk_index"),
            F.concat(F.lit("type_"), "label").alias("semantic_type"), F.col("lang").alias("context"),
            tokens.alias("tokens"), (tokens > 800).alias("is_oversized"),
            F.lit(0).alias("split_depth"), F.lit(0).alias("start_char"),
            F.length(F.coalesce("text", F.lit(""))).alias("end_char"),
            _pick(schemas.DOCUMENT_TYPES, F.floor(vec / 5)).alias("document_type"),
        )

    return AuditGraph(
        spark,
        nodes={
            "Process": processes, "Audit": audits, "Document": documents, "FailureMode": failure_modes,
            "Risk": risks, "Control": controls, "Finding": findings, "Requirement": requirements,
            "ProcedureStep": procedure_steps, "Incident": incidents,
        },
        edges={
            "IDENTIFIES": identifies, "IMPLIES": implies, "MITIGATES": mitigates,
            "IMPLEMENTS": implements, "USES": uses, "EVALUATES": evaluates, "RELATES_TO": relates_to,
            "SATISFIES": lambda: satisfies("SATISFIES", "F"),
            "FAILS_TO_SATISFY": lambda: satisfies("FAILS_TO_SATISFY", "O"),
            "ADDRESSES": addresses, "REFERENCES": references, "SUPERSEDES": supersedes,
        },
        extractions=extractions,
        chunks=chunks,
        unique=("IDENTIFIES", "MITIGATES", "extractions"),  # made distinct above, as numbers
    )
