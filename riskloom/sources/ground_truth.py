"""Evaluation questions with the entities and keywords a good answer draws on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: (id, category, label, property filters, (relationship, direction, target), keywords) ---
GROUND_TRUTH = (
    (1, "local_similarity", "Control", {"description": {"$contains": "queda"}}, None, ("arnês", "ancoragem", "plataforma", "altura", "epi")),
    (2, "local_similarity", "Document", {"name": {"$contains": "altura"}}, None, ("escada", "portátil", "sapatas", "degrau", "apoio")),
    (3, "local_similarity", "Requirement", {"description": {"$contains": "emergência"}}, None,
     ("emergência", "resgate", "socorro", "primeiros", "vítima")),
    (4, "local_similarity", "Requirement", {}, ("SOURCED_FROM", "out", "Document"), ("investigação", "causa", "raiz", "corretiva", "incidente")),
    (5, "local_similarity", "FailureMode", {}, None, ("fm-", "fmea", "modo", "falha", "rpn", "severidade")),
    (6, "global_understanding", "Risk", {}, None, ("queda", "elétrico", "prensamento", "esmagamento", "risco")),
    (7, "global_understanding", "Process", {}, ("CONTAINS", "out", "Control"), ("processo", "controle", "trabalho", "altura", "operação")),
    (8, "global_understanding", "Requirement", {}, ("SATISFIES", "in", None), ("conformidade", "norma", "requisito", "padrão", "nr-")),
    (9, "global_understanding", "Control", {}, None, ("documento", "comum", "controle", "procedimento")),
    (10, "global_understanding", "FailureMode", {}, None, ("lacuna", "ausência", "controle", "mitigação", "falha")),
    (11, "multi_hop", "FailureMode", {"severity": {"$gte": 7}}, ("MITIGATES", "in", "Control"), ("severidade", "alto", "controle", "crítico", "mitigação")),
    (12, "multi_hop", "Risk", {"description": {"$contains": "queda"}}, None, ("queda", "fps altura", "hira", "documento", "origem")),
    (13, "multi_hop", "Finding", {}, ("REFERENCES", "out", "Control"), ("ponte rolante", "içamento", "carga", "operador", "controle")),
    (14, "multi_hop", "Audit", {}, ("USES", "out", "Document"), ("auditoria", "processo", "mudança", "risco", "documento")),
    (15, "multi_hop", "FailureMode", {}, None, ("causa", "raiz", "humano", "equipamento", "procedimento", "comum")),
    (16, "aggregation", "Risk", {}, None, ("alto", "médio", "baixo", "severidade", "distribuição")),
    (17, "aggregation", "FailureMode", {"rpn": {"$gt": 100}}, None, ("rpn", "100", "modo", "falha", "crítico")),
    (18, "aggregation", "Document", {}, ("IDENTIFIES", "out", None), ("documento", "entidade", "maior", "fmea", "identificado")),
    (19, "aggregation", "Control", {}, None, ("preventivo", "detectivo", "corretivo", "tipo", "controle")),
    (20, "aggregation", "Extraction", {"confidence": {"$gt": 0.9}}, None, ("confiança", "extração", "0.9", "alta", "qualidade")),
)
EXPECTED_PATHS = {
    11: (("FailureMode", "MITIGATES", "Control"),),
    12: (("Risk", "EXTRACTED_FROM", "Extraction"), ("Extraction", "SOURCED_FROM", "Document")),
    13: (("Finding", "REFERENCES", "Control"), ("Control", "MITIGATES", "Risk")),
    14: (("Audit", "USES", "Document"), ("Document", "IDENTIFIES", "FailureMode")),
}
# Question 19 names the control types it expects, each with no count to match.
EXPECTED_DISTRIBUTION = {19: {"PREVENTIVE": 0, "DETECTIVE": 0, "CORRECTIVE": 0}}
# -----------------------------------------------------------------------------------------------------


def questions(spark: SparkSession) -> DataFrame:
    """(question_id, category): twenty rows."""
    return spark.createDataFrame([(q, category) for q, category, *_ in GROUND_TRUTH], "question_id int, category string")


def keywords(spark: SparkSession) -> DataFrame:
    """(question_id, keyword), one row per required keyword."""
    return spark.createDataFrame([(row[0], k) for row in GROUND_TRUTH for k in row[5]], "question_id int, keyword string")
