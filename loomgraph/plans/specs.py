"""Specs of the graph and of question routing: data only. Callers may pass their own in place of these."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _ordered(*names: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(names))


@dataclass(frozen=True)
class NodeSpec:
    label: str
    optional: tuple[str, ...] = ()
    required: tuple[str, ...] = ("id", "label")
    description: str = ""

    @property
    def columns(self) -> tuple[str, ...]:
        return _ordered(*self.required, *self.optional)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType(), c not in self.required) for c in self.columns])


@dataclass(frozen=True)
class EdgeSpec:
    type: str
    source: str
    target: str
    properties: tuple[str, ...] = ()
    description: str = ""

    @property
    def columns(self) -> tuple[str, ...]:
        return _ordered("source_id", "target_id", *self.properties)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType(), c not in ("source_id", "target_id")) for c in self.columns])


@dataclass(frozen=True)
class Catalog:
    nodes: dict[str, NodeSpec] = field(default_factory=dict)
    edges: dict[str, EdgeSpec] = field(default_factory=dict)

    def node(self, label: str) -> NodeSpec:
        if label not in self.nodes:
            raise KeyError(f"no node label {label!r}; there are {sorted(self.nodes)}")
        return self.nodes[label]

    def edge(self, type_: str) -> EdgeSpec:
        if type_ not in self.edges:
            raise KeyError(f"no edge type {type_!r}; there are {sorted(self.edges)}")
        return self.edges[type_]

    def listing(self, spark: SparkSession) -> DataFrame:
        """A row for each label and type with its columns, sorted."""
        rows = [("node", s.label, None, None, list(s.columns)) for s in self.nodes.values()]
        rows += [("edge", s.type, s.source, s.target, list(s.columns)) for s in self.edges.values()]
        return spark.createDataFrame(rows, "kind string, name string, source string, target string, columns array<string>").orderBy("kind", "name")


_ORIGIN = ("source", "raw_source_ids")
# Labels and types of a biomedical graph, with their properties.
BIOMEDICAL = Catalog(
    {
        s.label: s
        for s in (
            NodeSpec("Disease", ("iri", "mondo_id", "umls_cui", "mesh_id", "synonyms", "category", *_ORIGIN)),
            NodeSpec("Protein", ("iri", "uniprot_id", "hgnc_id", "gene_symbol", "synonyms", *_ORIGIN)),
            NodeSpec("Gene", ("iri", "hgnc_id", "entrez_id", "ensembl_id", "chromosome", "synonyms", *_ORIGIN)),
            NodeSpec("Pathway", ("iri", "go_id", "namespace", "synonyms", *_ORIGIN)),
            NodeSpec("Biomarker", ("iri", "analyte", "analyte_class", "fluid", "units", "assay_type", *_ORIGIN)),
            NodeSpec("Phenotype", ("iri", "hpo_id", "umls_cui", "mesh_id", "synonyms", *_ORIGIN)),
            NodeSpec("Drug", ("iri", "chebi_id", "atc_code", "drug_type", "drug_class", "primary_indication", "secondary_indications", "mechanism_summary", "status_overall", "approved_regions", *_ORIGIN)),
            NodeSpec("RiskFactor", ("category", "direction", "short_summary", *_ORIGIN)),
            NodeSpec("Study", ("citation", "year", "pubmed_id", "doi", *_ORIGIN)),
            NodeSpec("Mechanism", ("category", "description", *_ORIGIN)),
            NodeSpec("Company", ("country", *_ORIGIN)),
            NodeSpec("TherapyType", ("category", *_ORIGIN)),
            NodeSpec("Fluid", ("category", *_ORIGIN)),
            NodeSpec("Trial", ("indication", "trial_phase_max", "has_phase3", "status", "trial_count", "notes", *_ORIGIN)),
            NodeSpec("EncyclopediaEntity", ("url", "synonyms", "short_summary", "category", "has_function_section", "has_pathology_section", "has_genetics_section", "has_therapeutics_section", *_ORIGIN)),
        )
    },
    {
        s.type: s
        for s in (
            EdgeSpec("HAS_BIOMARKER", "Disease", "Biomarker", ("direction", "comparison", "disease_group", "control_group", "effect_size_type", "effect_size", "ci_lower", "ci_upper", "p_value", "n_studies", "n_cases", "n_controls", "study_id", "source", "source_text")),
            EdgeSpec("INCREASES_RISK_OF", "RiskFactor", "Disease", ("direction", "outcome", "population", "effect_size_type", "effect_size", "ci_lower", "ci_upper", "p_value", "n_studies", "quality_flags", "study_id", "source", "source_text")),
            EdgeSpec("TREATS", "Drug", "Disease", ("status", "indication", "trial_phase_max", "has_phase3", "trial_count", "approved_regions", "source")),
            EdgeSpec("TARGETS_PROTEIN", "Drug", "Protein", ("action_type", "is_primary_target", "source", "target_notes")),
            EdgeSpec("AFFECTS_PATHWAY", "Drug", "Pathway", ("action_type", "is_primary_target", "source", "target_notes")),
            EdgeSpec("ENCODES", "Gene", "Protein", ("source",)),
            EdgeSpec("INVOLVED_IN_PATHWAY", "Protein", "Pathway", ("evidence_code", "source")),
            EdgeSpec("HAS_PHENOTYPE", "Disease", "Phenotype", ("onset", "frequency", "source")),
            EdgeSpec("INVOLVES_PATHOLOGY", "Disease", "Mechanism", ("role", "source")),
            EdgeSpec("TARGETS_PATHOLOGY", "Drug", "Mechanism", ("action_type", "is_primary_target", "source", "target_notes")),
            EdgeSpec("REFLECTS_PATHOLOGY", "Biomarker", "Mechanism", ("analyte_core", "analyte_class", "fluid", "source")),
            EdgeSpec("REPRESENTS_GENE", "EncyclopediaEntity", "Gene", ("match_strategy", "source")),
            EdgeSpec("ASSOCIATED_WITH_DISEASE", "Gene", "Disease", ("evidence_type", "source")),
            EdgeSpec("DEVELOPED_BY", "Drug", "Company", ("role", "source")),
            EdgeSpec("HAS_THERAPY_TYPE", "Drug", "TherapyType", ("source",)),
            EdgeSpec("MEASURED_IN", "Biomarker", "Fluid", ("source",)),
            EdgeSpec("HAS_TRIAL", "Drug", "Trial", ("source",)),
            EdgeSpec("FOR_DISEASE", "Trial", "Disease", ("indication_label", "source")),
        )
    },
)


@dataclass(frozen=True)
class Routing:
    """keywords: by intent, in the order that settles ties; patterns: of ids, in the order of their results."""

    keywords: dict[str, tuple[str, ...]]
    general: tuple[str, tuple[str, ...], str]
    other: tuple[str, str]
    overrides: tuple[tuple[tuple[str, ...], str, bool, str], ...]
    patterns: tuple[str, ...]
    strategies: dict[str, str]


# Words, id patterns and strategy names of question routing.
QUESTIONS = Routing(
    keywords={
        "BIOMARKER": ("biomarker", "marker", "csf", "plasma", "serum", "fluid", "cutoff", "sensitivity", "specificity"),
        "DRUG_TRIAL": ("drug", "treat", "treatment", "therapy", "therapeutic", "compound", "trial", "phase", "phase 2", "phase 3", "approved", "approval", "status", "dosage", "dose", "company"),
        "PHENOTYPE": ("symptom", "sign", "clinical feature", "cognitive", "memory", "language", "aphasia", "behavior", "behaviour", "phenotype", "presentation"),
        "PATHWAY": ("pathway", "pathways", "go:", "signaling", "signalling", "microglial", "synaptic", "amyloid cascade"),
        "GENE_PROTEIN": ("gene", "genes", "protein", "proteins", "encode", "encodes", "mutation", "variant", "variants", "hgnc", "uniprot"),
    },
    general=("GENERAL_AD", ("alzheimer",), "No intent's words were found; the subject is, so the question is taken as a general one."),
    other=("OTHER", "Neither an intent's words nor the subject were found."),
    overrides=(
        (("biomarker",), "BIOMARKER", False, " The word biomarker decides: BIOMARKER."),
        (("trial", "phase"), "DRUG_TRIAL", True, " A trial or a phase is named: DRUG_TRIAL."),
    ),
    patterns=(r"MONDO:\d+", r"CHEBI:\d+", r"HP:\d+", r"GO:\d+", r"HGNC:\d+", r"PR:\d+"),
    strategies={
        "BIOMARKER": "AD_BIOMARKERS_V1",
        "PHENOTYPE": "AD_PHENOTYPES_V1",
        "DRUG_TRIAL": "AD_DRUGS_PATHWAYS_V1",
        "PATHWAY": "AD_DRUGS_PATHWAYS_V1",
        "GENE_PROTEIN": "AD_GENES_GENERAL_V1",
        "GENERAL_AD": "AD_GENERAL_V1",
        "OTHER": "AD_GENERAL_V1",
    },
)
