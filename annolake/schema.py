"""Record types and the fixed dimensions of the annotation scheme."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Entity labels (NA: none).
LABELS = ["anatomical location", "animal", "biomedical technique", "bacteria", "chemical", "dietary supplement", "DDF", "drug", "food", "gene", "human", "microbiome", "statistical technique"]

#: Relation predicates (NA: none).
PREDICATES = ["administered", "affect", "change abundance", "change effect", "change expression", "compared to", "impact", "influence", "interact", "is a", "is linked to", "located in", "part of", "produced by", "strike", "target", "used by"]

#: Head label, tail label and the predicates that they allow.
VALID_RELATIONS = [
    ("anatomical location", "human", ["located in"]),
    ("anatomical location", "animal", ["located in"]),
    ("bacteria", "bacteria", ["interact"]),
    ("bacteria", "chemical", ["interact"]),
    ("bacteria", "drug", ["interact"]),
    ("bacteria", "DDF", ["influence"]),
    ("bacteria", "gene", ["change expression"]),
    ("bacteria", "human", ["located in"]),
    ("bacteria", "animal", ["located in"]),
    ("bacteria", "microbiome", ["part of"]),
    ("chemical", "anatomical location", ["located in"]),
    ("chemical", "human", ["located in", "administered"]),
    ("chemical", "animal", ["located in", "administered"]),
    ("chemical", "chemical", ["interact", "part of"]),
    ("chemical", "microbiome", ["impact", "produced by"]),
    ("chemical", "bacteria", ["impact"]),
    ("chemical", "DDF", ["influence"]),
    ("chemical", "gene", ["change expression"]),
    ("dietary supplement", "bacteria", ["impact"]),
    ("dietary supplement", "microbiome", ["impact"]),
    ("dietary supplement", "DDF", ["influence"]),
    ("dietary supplement", "gene", ["change expression"]),
    ("dietary supplement", "human", ["administered"]),
    ("dietary supplement", "animal", ["administered"]),
    ("drug", "bacteria", ["impact"]),
    ("drug", "microbiome", ["impact"]),
    ("drug", "gene", ["change expression"]),
    ("drug", "human", ["administered"]),
    ("drug", "animal", ["administered"]),
    ("drug", "chemical", ["interact"]),
    ("drug", "drug", ["interact"]),
    ("drug", "DDF", ["change effect"]),
    ("food", "bacteria", ["impact"]),
    ("food", "microbiome", ["impact"]),
    ("food", "DDF", ["influence"]),
    ("food", "gene", ["change expression"]),
    ("food", "human", ["administered"]),
    ("food", "animal", ["administered"]),
    ("DDF", "anatomical location", ["strike"]),
    ("DDF", "bacteria", ["change abundance"]),
    ("DDF", "microbiome", ["change abundance"]),
    ("DDF", "chemical", ["interact"]),
    ("DDF", "DDF", ["affect", "is a"]),
    ("DDF", "human", ["target"]),
    ("DDF", "animal", ["target"]),
    ("human", "biomedical technique", ["used by"]),
    ("animal", "biomedical technique", ["used by"]),
    ("microbiome", "biomedical technique", ["used by"]),
    ("microbiome", "anatomical location", ["located in"]),
    ("microbiome", "human", ["located in"]),
    ("microbiome", "animal", ["located in"]),
    ("microbiome", "gene", ["change expression"]),
    ("microbiome", "DDF", ["is linked to"]),
    ("microbiome", "microbiome", ["compared to"]),
]


def valid_triples() -> list[tuple[str, str, str]]:
    """(head, tail, predicate) rows, predicates in alphabetical order."""
    return [(head, tail, p) for head, tail, predicates in VALID_RELATIONS for p in sorted(predicates)]


def valid_relations(spark: SparkSession) -> DataFrame:
    """head, tail, predicates (array): one row for each pair of labels that can be related."""
    return spark.createDataFrame([(head, tail, sorted(predicates)) for head, tail, predicates in VALID_RELATIONS], "head string, tail string, predicates array<string>")


ENTITY = "start_idx int, end_idx int, location string, text_span string, label string, uri string, uri_source string, predicted_label string, confscore double"
RELATION = "subject_start_idx int, subject_end_idx int, subject_location string, subject_text_span string, subject_label string, subject_uri string, predicate string, confscore double, object_start_idx int, object_end_idx int, object_location string, object_text_span string, object_label string, object_uri string"
PAPER = f"struct<metadata: struct<title: string, abstract: string>, title: string, abstract: string, entities: array<struct<{ENTITY.replace(' ', ': ').replace(',:', ',')}>>, relations: array<struct<{RELATION.replace(' ', ': ').replace(',:', ',')}>>>"
