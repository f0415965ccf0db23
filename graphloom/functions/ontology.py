"""Fixed values of the knowledge-graph ontology, and tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Node types with their codes.
NODE_CODES = {
    "Material": "CHM",
    "Property": "PRO",
    "Application": "APL",
    "SynthesisMethod": "SYN",
    "CharacterizationMethod": "CMT",
    "FailureMode": "FLR",
    "Mechanism": "MEC",
    "Condition": "CND",
    "Source": "SRC",
    "Equipment": "EQP",
    "BusinessMetric": "BIZ",
    "InternalExperiment": "EXP",
    "Constraint": "CST",
    "HypothesisRecord": "HYP",
}
#: Types that graph rules accept besides.
TEXT_TYPES = ["Chunk", "Assessment", "Concept"]

# Edge types with the types of source and target; * is any type but those after the minus sign.
ONTOLOGY = {
    "IMPROVES": ("Material SynthesisMethod Condition Mechanism", "Property"),
    "DEGRADES": ("Material Condition FailureMode Mechanism", "Property"),
    "CAUSES": ("Mechanism FailureMode Condition Material", "Property FailureMode"),
    "MITIGATES": ("Material SynthesisMethod Mechanism", "FailureMode"),
    "REQUIRES_CONDITION": ("SynthesisMethod Material CharacterizationMethod", "Condition"),
    "SYNTHESIZED_BY": ("Material", "SynthesisMethod"),
    "CHARACTERIZED_BY": ("Material Property", "CharacterizationMethod"),
    "HAS_FAILURE_MODE": ("Material Application", "FailureMode"),
    "APPLIED_IN": ("Material", "Application"),
    "SUBCLASS_OF": ("* - Source InternalExperiment HypothesisRecord", "* - Source InternalExperiment HypothesisRecord"),
    "REQUIRES_EQUIPMENT": ("SynthesisMethod CharacterizationMethod", "Equipment"),
    "USES_FEEDSTOCK": ("SynthesisMethod Material", "Material"),
    "IMPACTS_COST": ("Material SynthesisMethod Equipment", "BusinessMetric"),
    "HAS_REGULATION": ("Material Application SynthesisMethod", "Constraint"),
    "SUBSTITUTE_FOR": ("Material", "Material"),
    "ANALOGOUS_TO": ("Material Mechanism", "Material Mechanism"),
    "TESTED_BY": ("HypothesisRecord", "InternalExperiment"),
    "CONFIRMS": ("InternalExperiment", "HypothesisRecord"),
    "REFUTES": ("InternalExperiment", "HypothesisRecord"),
    "SUPPORTED_BY": ("* - Source", "Source"),
}
#: The schema's edge types.
ONTOLOGY_TYPES = [
    "IMPROVES", "DEGRADES", "CAUSES", "MITIGATES", "REQUIRES_CONDITION", "SYNTHESIZED_BY", "CHARACTERIZED_BY", "HAS_FAILURE_MODE", "APPLIED_IN", "SUPPORTED_BY", "SUBCLASS_OF",
    "REQUIRES_EQUIPMENT", "USES_FEEDSTOCK", "IMPACTS_COST", "HAS_REGULATION", "ANALOGOUS_TO", "SUBSTITUTE_FOR", "TESTED_BY", "CONFIRMS", "REFUTES",
]
CAUSAL = ["IMPROVES", "DEGRADES", "CAUSES", "MITIGATES", "REQUIRES_CONDITION", "HAS_FAILURE_MODE"]
BUSINESS = ["IMPACTS_COST", "HAS_REGULATION", "SUBSTITUTE_FOR", "REQUIRES_EQUIPMENT"]
ONTOLOGICAL_EDGES = ["SYNTHESIZED_BY", "CHARACTERIZED_BY", "IMPROVES", "DEGRADES", "CAUSES", "REQUIRES_CONDITION", "HAS_FAILURE_MODE", "MITIGATES", "APPLIED_IN", "SUBCLASS_OF", "MENTIONS"]
IMPORTANT_EDGES = ["SYNTHESIZED_BY", "IMPROVES", "APPLIED_IN", "REQUIRES_CONDITION"]


def types_of(spec: str) -> list[str]:
    """The node types that a specification names."""
    if not spec.startswith("*"):
        return spec.split()
    without = spec.partition("-")[2].split()
    return [t for t in NODE_CODES if t not in without]


def rules() -> list[tuple[str, str, str]]:
    """All allowed (edge type, source type, target type)."""
    return [(e, s, t) for e, (a, b) in ONTOLOGY.items() for s in types_of(a) for t in types_of(b) if e != "SUBCLASS_OF" or s == t]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "type string, source_type string, target_type string")


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NODE_CODES.items()), "type string, code string")


def values(rows: list[tuple]) -> str:
    """Rows as a VALUES list of SQL."""
    return "(values " + ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"
