"""Entry documents (front matter plus body), the ledger file, and catalogued facet projection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evitrace.operators.ordered import sequence_breaks

from evitrace.functions.text import body_sections, normalize_body

LEDGER_SCHEMA = (
    "sequence bigint, action string, identity string, reviewedContentDigest string, semanticsDigest string, "
    "reviewedBy string, reviewedAt string, mechanism string, chunkId string, rationale string"
)

ENTRY_SCHEMA = (
    "schemaVersion int, subject struct<metadataType:string,fullName:string,namespace:string>, "
    "profile struct<id:string,version:string,digest:string>, "
    "scope struct<sourceApiVersion:string,sourceTreeDigest:string,packageVersionId:string,collectorVersion:string>, "
    "source struct<fragments:array<struct<path:string,sourceDigest:string>>>, "
    "lifecycle struct<state:string,contentDigest:string>, "
    "typeFacts variant, "
    "intentionalErrors array<struct<elementApiName:string,elementLabel:string,messageTemplate:string,resolvedDefaultText:string>>, "
    "extractionCoverage map<string,string>, assurance map<string,string>, limitations array<string>, "
    "keywords array<string>, candidateKeywords array<string>, sensitivity string, "
    "approval struct<reviewedContentDigest:string,reviewedBy:string,reviewedAt:string,mechanism:string>"
)


class BrokenLedger(ValueError):
    """The numbering of an append-only ledger has a gap or a number twice."""


def read_ledger(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """The append-only JSON-lines ledger under its declared schema.

    A ledger whose numbers do not run from one without a gap or copy is refused, unless the caller
    wants it unchecked to look for the break.
    """
    rows = spark.read.schema(LEDGER_SCHEMA).json(path)
    if checked:
        broken = sequence_breaks(rows, "sequence", start=1).orderBy("sequence").first()
        if broken or not rows.filter("sequence IS NULL").isEmpty():
            raise BrokenLedger(f"ledger numbering is broken at {broken['sequence'] if broken else 'a record without a number'}")
    return rows


@F.pandas_udf(T.StringType())
def _yaml_to_json(texts: pd.Series) -> pd.Series:
    """Front matter as JSON; duplicate keys, anchors, aliases and merges are refused."""
    import json

    import yaml  # part of the worker image where entries are read

    class Strict(yaml.SafeLoader):
        def compose_node(self, parent, index):
            event = self.peek_event()
            if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
                raise yaml.YAMLError("anchors and aliases are not allowed")
            return super().compose_node(parent, index)

        def construct_mapping(self, node, deep=False):
            keys = [k.value for k, _ in node.value]
            if len(keys) != len(set(keys)) or "<<" in keys:
                raise yaml.YAMLError("duplicate or merge key")
            return super().construct_mapping(node, deep)

    def one(text):
        try:
            return None if text is None else json.dumps(yaml.load(text, Strict), default=str, ensure_ascii=False)
        except yaml.YAMLError:
            return None

    return texts.map(one)


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.md`` entry below ``root``: path, parsed front matter, body, purpose, problem.

    The first ``---`` block is the front matter. A document that does not parse stays as a row
    with its problem, so that it can be reported.
    """
    texts = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )
    parts = texts.select(
        "path", F.sha2("value", 256).alias("file_sha"),
        F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1).alias("front"),
        F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "").alias("body"),
    )
    parsed = parts.withColumn("json", _yaml_to_json(F.nullif(F.col("front"), F.lit("")))).withColumn(
        "entry", F.from_json("json", ENTRY_SCHEMA)
    )
    purpose = F.array_join(
        F.filter(F.split("body", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("## ")), "\n"
    )
    return parsed.select(
        "path", "file_sha", "entry.*", normalize_body(F.col("body")).alias("body"), purpose.alias("purpose"),
        body_sections(F.col("body")).alias("sections"),
        F.when(F.col("front") == "", "no front matter").when(F.col("json").isNull(), "front matter does not parse")
        .alias("problem"),
    )


def identity(metadata_type: Column, namespace: Column, full_name: Column) -> Column:
    return F.concat_ws(":", metadata_type, F.coalesce(namespace, F.lit("c")), full_name)


# Facet keys of the common types, with kind and fact path.
FACET_CATALOGUE = {
    "CustomField": {
        "field.object": ("string", "object"), "field.type": ("string", "type"), "field.required": ("boolean", "required"),
        "field.unique": ("boolean", "unique"), "field.externalId": ("boolean", "externalId"),
        "field.encrypted": ("boolean", "encrypted"), "field.referenceTo": ("string", "referenceTo"),
        "field.controllingField": ("string", "controllingField"), "field.length": ("number", "length"),
        "field.precision": ("number", "precision"), "field.scale": ("number", "scale"),
    },
    "CustomObject": {
        "object.kind": ("string", "objectKind"), "object.sharingModel": ("string", "sharingModel"),
        "object.deploymentStatus": ("string", "deploymentStatus"), "object.eventType": ("string", "eventType"),
        "object.customSettingsType": ("string", "customSettingsType"),
    },
    "Flow": {"flow.processType": ("string", "processType"), "flow.status": ("string", "status")},
    "ApexClass": {
        "apex.kind": ("string", "declarationKind"), "apex.sharing": ("string", "sharingModel"),
        "apex.isTest": ("boolean", "isTest"), "apex.apiVersion": ("string", "apiVersion"),
        "apex.superclass": ("string", "superclass"),
    },
    "ApexTrigger": {"trigger.object": ("string", "object"), "trigger.events": ("string", "events")},
    "ValidationRule": {
        "validationRule.active": ("boolean", "active"), "validationRule.errorDisplayField": ("string", "errorDisplayField"),
    },
    "PermissionSet": {"permissionSet.label": ("string", "label"), "permissionSet.license": ("string", "license")},
    "RecordType": {"recordType.active": ("boolean", "active")},
    "ListView": {"listView.filterScope": ("string", "filterScope"), "listView.queue": ("string", "queue")},
    "QuickAction": {"quickAction.actionType": ("string", "type")},
    "Role": {"role.label": ("string", "name"), "role.caseAccessLevel": ("string", "caseAccessLevel")},
    "DuplicateRule": {
        "duplicateRule.active": ("boolean", "isActive"), "duplicateRule.actionOnInsert": ("string", "actionOnInsert"),
        "duplicateRule.actionOnUpdate": ("string", "actionOnUpdate"),
    },
    "GlobalValueSet": {"valueSet.sorted": ("boolean", "sorted"), "valueSet.masterLabel": ("string", "masterLabel")},
    "Profile": {"profile.custom": ("boolean", "custom"), "profile.userLicense": ("string", "userLicense")},
    "FlexiPage": {"flexiPage.pageType": ("string", "type"), "flexiPage.object": ("string", "sobjectType")},
    "Report": {"report.reportType": ("string", "reportType"), "report.format": ("string", "format")},
    "CustomLabel": {"customLabel.language": ("string", "language"), "customLabel.protected": ("boolean", "protected")},
    "FlowDefinition": {"flowDefinition.activeVersionNumber": ("number", "activeVersionNumber")},
}


def facet_rows(components: DataFrame) -> DataFrame:
    """Typed facets of components, long form: one join with the catalogue serves every type.

    ``components``: component_id, metadata_type, facts (string map). Absent facts give no row.
    """
    catalogue = [
        (kind, key, value_kind, fact)
        for kind, facets in FACET_CATALOGUE.items() for key, (value_kind, fact) in facets.items()
    ]
    spark = components.sparkSession
    rules = F.broadcast(spark.createDataFrame(catalogue, "metadata_type string, facet string, value_kind string, fact string"))
    said = F.try_element_at("facts", F.col("fact"))
    return components.join(rules, "metadata_type").select(
        "component_id", "facet", "value_kind", said.alias("text"),
        F.when(F.col("value_kind") == "number", said.try_cast("double")).alias("number"),
        F.when(F.col("value_kind") == "boolean", F.lower(said) == "true").alias("flag"),
    ).filter(F.col("text").isNotNull())
