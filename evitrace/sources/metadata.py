"""Collecting components and edges from a tree of metadata and source files.

Markup is shredded into element rows by one small Arrow helper; which elements mean which edge
is a table of rules that Spark joins to those rows. Code files are read with regular
expressions in the JVM. Nothing is dropped: files no route knows come back as generic files and
files that do not parse come back as diagnostics.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evitrace.functions.text import safe_literal
from evitrace.operators.graph import assurance, capped_edges, truncated_families
from evitrace.session import cut_lineage
from evitrace.sources import fields, markup

# Component type by file suffix (``<name>.<suffix>-meta.xml``).
SUFFIX_TYPES = {
    "object": "CustomObject", "field": "CustomField", "recordType": "RecordType",
    "businessProcess": "BusinessProcess", "listView": "ListView", "fieldSet": "FieldSet",
    "sharingRules": "SharingRules", "queue": "Queue", "assignmentRules": "AssignmentRules",
    "autoResponseRules": "AutoResponseRules", "escalationRules": "EscalationRules",
    "flow": "Flow", "workflow": "Workflow", "approvalProcess": "ApprovalProcess",
    "validationRule": "ValidationRule", "duplicateRule": "DuplicateRule",
    "permissionset": "PermissionSet", "profile": "Profile", "layout": "Layout",
    "flexipage": "FlexiPage", "quickAction": "QuickAction", "app": "CustomApplication",
    "md": "CustomMetadata", "permissionsetgroup": "PermissionSetGroup", "tab": "CustomTab",
    "reportType": "ReportType", "report": "Report", "dashboard": "Dashboard",
    "pathAssistant": "PathAssistant", "flowDefinition": "FlowDefinition",
    "compactLayout": "CompactLayout", "webLink": "WebLink", "role": "Role",
    "mutingpermissionset": "MutingPermissionSet", "delegateGroup": "DelegateGroup",
    "platformEventChannel": "PlatformEventChannel",
    "platformEventChannelMember": "PlatformEventChannelMember", "resource": "StaticResource",
    "globalValueSet": "GlobalValueSet", "standardValueSet": "StandardValueSet",
    "namedCredential": "NamedCredential", "externalCredential": "ExternalCredential",
    "remoteSite": "RemoteSiteSetting", "dataSource": "ExternalDataSource",
    "externalServiceRegistration": "ExternalServiceRegistration", "connectedApp": "ConnectedApp",
    "authprovider": "AuthProvider", "cspTrustedSite": "CspTrustedSite",
    "corsWhitelistOrigin": "CorsWhitelistOrigin",
}
# Files that declare several components, by suffix: element and type.
MULTI_TYPES = {
    "labels": ("labels", "CustomLabel"),
    "matchingRule": ("matchingRules", "MatchingRule"),
    "matchingRules": ("matchingRules", "MatchingRule"),
}
# Code files by folder and suffix.
CODE_TYPES = {"cls": "ApexClass", "trigger": "ApexTrigger", "page": "ApexPage", "component": "ApexComponent"}
IN_OBJECT_FOLDER = (
    "CustomField", "RecordType", "BusinessProcess", "ListView", "FieldSet", "ValidationRule",
    "CompactLayout", "WebLink",
)
ROUTING = ("AssignmentRules", "AutoResponseRules", "EscalationRules")
ACCESS = ("PermissionSet", "Profile", "MutingPermissionSet")
MAX_EDGES = 300
# Which grants survive the edge cap longest.
GRANT_PRIORITY = {
    "grants-user-permission": 0, "grants-object-view-all": 1, "grants-object-modify-all": 1,
    "grants-object-permission": 1, "grants-class-access": 2, "grants-custom-permission": 3,
    "grants-record-type": 4, "grants-flow-access": 5, "grants-field-edit": 6, "grants-field-read": 6,
}

_TEXT = ""  # the element's own text instead of a child's
# Rules: types, element, parent element (or None), child holding the target, child that must be
# true (or None; a leading ! means must not be true), kind, how the target is written.
# "own" prefixes the owning object unless the text is already qualified; "head" keeps what
# stands before the dot.
EDGE_RULES = [
    (("CustomField",), "referenceTo", None, _TEXT, None, "relationship", "plain"),
    (("CustomField",), "valueSet", None, "valueSetName", None, "uses-value-set", "plain"),
    (("CustomField",), "valueSet", None, "controllingField", None, "picklist-dependency", "own"),
    (("CustomField",), "summaryForeignKey", None, _TEXT, None, "references-field", "plain"),
    (("CustomField",), "summarizedField", None, _TEXT, None, "references-field", "plain"),
    (("CustomField",), "summarizedField", None, _TEXT, None, "operates-on", "head"),
    (("CustomField",), "summaryFilterItems", None, "field", None, "references-field", "plain"),
    (("CustomField",), "filterItems", "lookupFilter", "field", None, "filters-field", "unbound"),
    (("RecordType",), "businessProcess", None, _TEXT, None, "uses-business-process", "own"),
    (("RecordType",), "picklistValues", None, "picklist", None, "references-field", "own"),
    (("ListView",), "columns", None, _TEXT, None, "references-field", "own"),
    (("ListView",), "filters", None, "field", None, "filters-field", "own"),
    (("FieldSet",), "displayedFields", None, "field", None, "places-field", "own"),
    (("FieldSet",), "availableFields", None, "field", None, "references-field", "own"),
    (("CompactLayout",), "fields", None, _TEXT, None, "places-field", "own"),
    (("SharingRules",), "criteriaItems", None, "field", None, "filters-field", "own"),
    (("Queue",), "sobjectType", None, _TEXT, None, "serves-object", "plain"),
    (("Role",), "parentRole", None, _TEXT, None, "reports-to", "plain"),
    (("DelegateGroup",), "permissionSets", None, _TEXT, None, "grants-to-permission-set", "plain"),
    (("DelegateGroup",), "profiles", None, _TEXT, None, "grants-to-profile", "plain"),
    (("PermissionSetGroup",), "permissionSets", None, _TEXT, None, "includes-permission-set", "plain"),
    (("PermissionSetGroup",), "mutingPermissionSets", None, _TEXT, None, "mutes-permission-set", "plain"),
    (ACCESS, "userPermissions", None, "name", "enabled", "grants-user-permission", "plain"),
    (ACCESS, "objectPermissions", None, "object", None, "grants-object-permission", "plain"),
    (ACCESS, "objectPermissions", None, "object", "viewAllRecords", "grants-object-view-all", "plain"),
    (ACCESS, "objectPermissions", None, "object", "modifyAllRecords", "grants-object-modify-all", "plain"),
    (ACCESS, "classAccesses", None, "apexClass", "enabled", "grants-class-access", "plain"),
    (ACCESS, "customPermissions", None, "name", "enabled", "grants-custom-permission", "plain"),
    (ACCESS, "recordTypeVisibilities", None, "recordType", "visible", "grants-record-type", "plain"),
    (ACCESS, "flowAccesses", None, "flow", "enabled", "grants-flow-access", "plain"),
    (ACCESS, "fieldPermissions", None, "field", "editable", "grants-field-edit", "plain"),
    (ACCESS, "fieldPermissions", None, "field", "readable&!editable", "grants-field-read", "plain"),
    (("Profile",), "layoutAssignments", None, "layout", None, "assigns-layout", "plain"),
    (("Layout",), "layoutItems", None, "field", None, "places-field", "own"),
    (("Layout",), "layoutItems", None, "page", None, "displays-component", "plain"),
    (("Layout",), "layoutItems", None, "component", None, "displays-component", "plain"),
    (("Layout",), "relatedLists", None, "relatedList", None, "related-list", "plain"),
    (("Layout",), "quickActionName", None, _TEXT, None, "action", "plain"),
    (("Flow",), "start", None, "object", None, "operates-on", "plain"),
    (("Flow",), "flowName", "subflows", _TEXT, None, "subflow", "plain"),
    (("Flow",), "actionName", "actionCalls", _TEXT, None, "action", "plain"),
    (("Flow",), "recordLookups", None, "object", None, "queries-object", "plain"),
    (("Flow",), "recordCreates", None, "object", None, "dml-object", "plain"),
    (("Flow",), "recordUpdates", None, "object", None, "dml-object", "plain"),
    (("Flow",), "recordDeletes", None, "object", None, "dml-object", "plain"),
    (("Workflow",), "criteriaItems", None, "field", None, "filters-field", "own"),
    (("Workflow",), "fieldUpdates", None, "field", None, "writes-field", "own"),
    (("Workflow",), "template", "alerts", _TEXT, None, "uses-template", "plain"),
    (("ApprovalProcess",), "criteriaItems", None, "field", None, "filters-field", "own"),
    (("ApprovalProcess",), "emailTemplate", None, _TEXT, None, "uses-template", "plain"),
    (("ApprovalProcess",), "field", "approvalPageFields", _TEXT, None, "references-field", "own"),
    (("DuplicateRule",), "duplicateRuleMatchRules", None, "matchingRule", None, "uses-matching-rule", "match"),
    (("DuplicateRule",), "mappingFields", None, "inputField", None, "references-field", "own"),
    (("DuplicateRule",), "duplicateRuleFilterItems", None, "field", None, "filters-field", "own"),
    (("MatchingRule",), "matchingRuleItems", None, "fieldName", None, "references-field", "own"),
    (ROUTING, "criteriaItems", None, "field", None, "filters-field", "own"),
    (ROUTING, "ruleEntry", None, "assignedTo", None, "assigns-to", "plain"),
    (ROUTING, "ruleEntry", None, "template", None, "uses-template", "plain"),
    (("QuickAction",), "quickActionLayoutItems", None, "field", None, "places-field", "own"),
    (("QuickAction",), "fieldOverrides", None, "field", None, "references-field", "own"),
    (("QuickAction",), "targetParentField", None, _TEXT, None, "references-field", "own"),
    (("QuickAction",), "flowDefinition", None, _TEXT, None, "launches-flow", "plain"),
    (("QuickAction",), "lightningComponent", None, _TEXT, None, "displays-component", "plain"),
    (("QuickAction",), "lightningWebComponent", None, _TEXT, None, "displays-component", "plain"),
    (("QuickAction",), "page", None, _TEXT, None, "displays-component", "plain"),
    (("CustomApplication",), "tabs", None, _TEXT, None, "displays-component", "plain"),
    (("CustomApplication",), "utilityBar", None, _TEXT, None, "displays-component", "plain"),
    (("CustomApplication",), "actionOverrides", None, "content", None, "overrides-view", "plain"),
    (("CustomApplication",), "profileActionOverrides", None, "content", None, "overrides-view", "plain"),
    (("CustomTab",), "flexiPage", None, _TEXT, None, "displays-component", "plain"),
    (("CustomTab",), "page", None, _TEXT, None, "displays-component", "plain"),
    (("CustomTab",), "lwcComponent", None, _TEXT, None, "displays-component", "plain"),
    (("CustomTab",), "auraComponent", None, _TEXT, None, "displays-component", "plain"),
    (("FlexiPage",), "componentInstance", None, "componentName", None, "displays-component", "plain"),
    (("FlexiPage",), "sobjectType", None, _TEXT, None, "operates-on", "plain"),
    (("FlexiPage",), "fieldInstance", None, "fieldItem", None, "places-field", "record"),
    (("ReportType",), "baseObject", None, _TEXT, None, "operates-on", "plain"),
    (("Dashboard",), "report", None, _TEXT, None, "displays-component", "plain"),
    (("PathAssistant",), "entityName", None, _TEXT, None, "operates-on", "plain"),
    (("PathAssistant",), "fieldNames", None, _TEXT, None, "places-field", "entity"),
    (("WebLink",), "page", None, _TEXT, None, "displays-component", "plain"),
    (("PlatformEventChannelMember",), "eventChannel", None, _TEXT, None, "relationship", "plain"),
    (("PlatformEventChannelMember",), "selectedEntity", None, _TEXT, None, "operates-on", "plain"),
    (("NamedCredential",), "externalCredential", None, _TEXT, None, "uses-external-credential", "plain"),
    (("NamedCredential", "ExternalCredential", "ExternalDataSource"), "authProvider", None, _TEXT, None, "references-auth-provider", "plain"),
    (("ExternalDataSource", "ExternalServiceRegistration"), "namedCredential", None, _TEXT, None, "uses-named-credential", "plain"),
    (("ConnectedApp",), "profileName", None, _TEXT, None, "grants-to-profile", "plain"),
    (("ConnectedApp",), "permissionsetName", None, _TEXT, None, "grants-to-permission-set", "plain"),
    (("AuthProvider",), "registrationHandler", None, _TEXT, None, "invokes-class", "plain"),
]
CRITERIA = ("filters", "criteriaItems", "filterItems", "summaryFilterItems")

_ELEMENT = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("top", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("up", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("kids", T.MapType(T.StringType(), T.StringType())),
])
_SHREDDED = T.StructType([
    T.StructField("elements", T.ArrayType(_ELEMENT)), T.StructField("error", T.StringType()),
])


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _elements(content: bytes) -> list[tuple]:
    """Every element: own number, parent, child of the root it is under, names, text, children."""
    rows: list[tuple] = []
    stack = [(ET.fromstring(content), -1, -1, None)]
    while stack:
        node, parent, top, up = stack.pop()
        number, kids = len(rows), {}
        for child in node:
            said = (child.text or "").strip()
            if said:
                kids.setdefault(_name(child.tag), said)
        top = number if parent == 0 else top
        rows.append((number, parent, top, _name(node.tag), up, (node.text or "").strip() or None, kids))
        stack.extend((child, number, top, _name(node.tag)) for child in reversed(node))
    return rows


@F.pandas_udf(_SHREDDED)
def shred(contents: pd.Series) -> pd.DataFrame:
    out = []
    for content in contents:
        try:
            out.append((_elements(content), None))
        except ET.ParseError as error:
            out.append(([], str(error)))
    return pd.DataFrame(out, columns=["elements", "error"])


def route(files: DataFrame) -> DataFrame:
    """Adds ``suffix``, ``metadata_type``, ``stem``, ``object_name`` from the path alone."""
    base = F.substring_index("path", "/", -1)
    suffix = F.regexp_extract(base, r"\.([A-Za-z]+)-meta\.xml$", 1)
    code = F.regexp_extract("path", r"(?:classes|triggers|pages|components)/[^/]*\.(cls|trigger|page|component)$", 1)
    known = F.create_map(*[F.lit(x) for kv in SUFFIX_TYPES.items() for x in kv])
    coded = F.create_map(*[F.lit(x) for kv in CODE_TYPES.items() for x in kv])
    kind = F.coalesce(
        F.try_element_at(known, suffix), F.try_element_at(coded, code),
        F.when(suffix.isin(*MULTI_TYPES), F.lit("many")),
        F.when((suffix != "") & ~suffix.isin("cls", "trigger", "page", "component"), F.initcap(suffix)),
    )
    stem = F.when(suffix != "", F.regexp_replace(base, r"\.[A-Za-z]+-meta\.xml$", "")).otherwise(F.regexp_replace(base, r"\.[A-Za-z]+$", ""))
    folder = F.regexp_extract("path", r"(?:^|/)objects/([^/]+)/", 1)
    owner = (
        F.when(kind.isin(*IN_OBJECT_FOLDER, "CustomObject"), folder)
        .when(kind == "Layout", F.substring_index(stem, "-", 1))
        .when(kind.isin("ApprovalProcess", "DuplicateRule", "QuickAction") & stem.contains("."), F.substring_index(stem, ".", 1))
        .when(kind.isin("Workflow", "SharingRules", "MatchingRule", *ROUTING) | suffix.isin("matchingRule", "matchingRules"), stem)
        .when(kind == "CustomMetadata", F.concat(F.substring_index(stem, ".", 1), F.lit("__mdt")))
    )
    return files.withColumn("suffix", suffix).withColumn("metadata_type", kind).withColumn("stem", stem).withColumn(
        "object_name", F.nullif(owner, F.lit(""))
    )


def elements(routed: DataFrame) -> DataFrame:
    """Element rows of every markup file (``ord`` null where the file does not parse)."""
    marked = routed.filter(F.col("path").endswith("-meta.xml") & F.col("metadata_type").isNotNull())
    shredded = marked.withColumn("s", shred("content")).drop("content")
    return shredded.select(
        *[c for c in shredded.columns if c != "s"], F.col("s.error").alias("error"),
        F.explode_outer("s.elements").alias("e"),
    ).select("*", "e.*").drop("e")


def diagnostics(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("error").isNotNull()).select("path", F.lit("error").alias("severity"), F.col("error").alias("message"))


def _object_kind(name: Column, facts: Column) -> Column:
    return (
        F.when(name.endswith("__mdt"), "customMetadataType")
        .when(name.endswith("__e") | F.try_element_at(facts, F.lit("eventType")).isNotNull(), "platformEvent")
        .when(name.endswith("__b"), "bigObject")
        .when(F.try_element_at(facts, F.lit("customSettingsType")).isNotNull(), "customSetting")
        .when(name.endswith("__c") | name.endswith("__x"), "customObject")
        .otherwise("standardObjectExtension")
    )


def components(nodes: DataFrame) -> DataFrame:
    """Component rows of markup files: one per file, or one per declared element.

    ``facts`` are the texts directly under the component's element, kept only where present and
    fit to keep; ``top`` says which elements belong to the component (null: the whole file).
    """
    whole = nodes.filter((F.col("parent") == -1) & (F.col("metadata_type") != "many")).withColumn("part", F.lit(None).cast("int"))
    many = F.create_map(*[F.lit(x) for k, (tag, kind) in MULTI_TYPES.items() for x in (f"{k}/{tag}", kind)])
    kind_of = F.try_element_at(many, F.concat_ws("/", "suffix", "tag"))
    parts = nodes.filter((F.col("metadata_type") == "many") & kind_of.isNotNull()).withColumn("metadata_type", kind_of).withColumn("part", F.col("ord"))
    rows = whole.unionByName(parts)
    declared = F.try_element_at("kids", F.lit("fullName"))
    own = F.coalesce(declared, F.col("stem"))
    name = (
        F.when(F.col("metadata_type") == "CustomObject", F.coalesce("object_name", "stem"))
        .when(F.col("metadata_type").isin(*IN_OBJECT_FOLDER, "MatchingRule"), F.concat_ws(".", "object_name", own))
        .when(F.col("part").isNotNull(), own).otherwise(F.col("stem"))
    )
    kept = F.map_filter(
        F.transform_values("kids", lambda k, v: F.when(k.isin("formula", "errorConditionFormula", "description", "inlineHelpText"), v).otherwise(safe_literal(v))),
        lambda k, v: v.isNotNull(),
    )
    facts = F.when(F.col("metadata_type") == "CustomObject", F.map_concat(
        kept, F.create_map(F.lit("objectKind"), _object_kind(F.coalesce("object_name", "stem"), F.col("kids")))
    )).otherwise(kept)
    return rows.select(
        F.concat_ws(":", "metadata_type", name).alias("component_id"), "metadata_type", name.alias("name"), "path",
        "sha256", "object_name", facts.alias("facts"), F.col("part").alias("part"),
    )


def rules_table(spark) -> DataFrame:
    rows = [
        (kind, tag, up, child, test, edge, form)
        for kinds, tag, up, child, test, edge, form in EDGE_RULES for kind in kinds
    ]
    return spark.createDataFrame(
        rows, "rule_type string, rule_tag string, rule_up string, child string, test string, kind string, form string"
    )


def markup_edges(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Edges of markup components: the rules joined to the elements, then the owning object.

    The rules are a fixed table of about a hundred rows; components meet their elements by path.
    """
    held = comps.select("path", "part", "component_id", F.col("metadata_type").alias("ctype"), F.col("object_name").alias("owner"))
    rules = F.broadcast(rules_table(nodes.sparkSession))
    rows = nodes.filter(F.col("ord").isNotNull()).select("path", "ord", "top", "tag", "up", "text", "kids", "object_name")
    inside = rows.join(held, "path").filter(F.col("part").isNull() | (F.col("top") == F.col("part")))
    matched = inside.join(rules, (F.col("ctype") == F.col("rule_type")) & (F.col("tag") == F.col("rule_tag"))).filter(
        F.col("rule_up").isNull() | (F.col("rule_up") == F.col("up"))
    )
    said = F.when(F.col("child") == _TEXT, F.col("text")).otherwise(F.try_element_at("kids", F.col("child")))
    yes = lambda c: F.coalesce(F.lower(F.try_element_at("kids", c)) == "true", F.lit(False))
    test = (
        F.when(F.col("test").isNull(), True)
        .when(F.col("test").contains("&!"), yes(F.substring_index("test", "&!", 1)) & ~yes(F.substring_index("test", "&!", -1)))
        .otherwise(yes(F.col("test")))
    )
    own = F.when(said.contains(".") | F.col("owner").isNull(), said).otherwise(F.concat_ws(".", "owner", said))
    target = (
        F.when(F.col("form") == "own", own)
        .when(F.col("form") == "head", F.when(said.contains("."), F.substring_index(said, ".", 1)))
        .when(F.col("form") == "unbound", F.when(~said.startswith("$"), said))
        .when(F.col("form") == "match", F.concat_ws(".", F.coalesce(F.try_element_at("kids", F.lit("matchRuleSObjectType")), F.col("owner")), said))
        .when(F.col("form") == "record", F.regexp_replace(said, "^Record[.]", ""))
        .otherwise(said)
    )
    found = matched.filter(test).select("component_id", "kind", target.alias("target"), F.col("ord").alias("position")).filter(
        F.coalesce("target", F.lit("")) != ""
    )
    owned = comps.filter(F.col("object_name").isNotNull() & (F.col("metadata_type") != "CustomObject"))
    contained = owned.filter(F.col("metadata_type").isin("CustomField", "RecordType", "ValidationRule", "CustomMetadata")).select(
        "component_id", F.lit("belongs-to").alias("kind"), F.col("object_name").alias("target"), F.lit(-2).alias("position")
    )
    operated = owned.filter(F.col("metadata_type") != "CustomField").select(
        "component_id", F.lit("operates-on").alias("kind"), F.col("object_name").alias("target"), F.lit(-1).alias("position")
    )
    tokens = nodes.filter(F.col("text").isNotNull()).select(
        "path", "top", F.col("ord").alias("position"),
        F.explode(F.concat(
            F.transform(F.regexp_extract_all("text", F.lit(r"\$Label\.([A-Za-z][A-Za-z0-9_]*)"), F.lit(1)), lambda v: F.struct(F.lit("uses-label").alias("kind"), v.alias("target"))),
            F.transform(F.regexp_extract_all("text", F.lit(r"\$Permission\.([A-Za-z][A-Za-z0-9_]*)"), F.lit(1)), lambda v: F.struct(F.lit("references-custom-permission").alias("kind"), v.alias("target"))),
        )).alias("t"),
    ).join(held.filter(F.col("ctype").isin("Flow", "ValidationRule", "EmailTemplate")).select("path", "part", "component_id"), "path").select(
        "component_id", "t.kind", "t.target", "position"
    )
    return found.unionByName(contained).unionByName(operated).unionByName(tokens).groupBy("component_id", "kind", "target").agg(
        F.min("position").alias("position")
    )


# What the code patterns look for, and platform types that are no components.
_CODE = {
    "object-token": r"\b([A-Za-z][A-Za-z0-9_]*__(?:c|mdt|e|x|b))\b",
    "queries-object": r"(?i)\bSELECT\b[\s\S]{0,600}?\bFROM\s+([A-Za-z][A-Za-z0-9_]*)",
    "uses-named-credential": r"['\"]callout:([A-Za-z][A-Za-z0-9_]*)",
    "uses-label": r"\b(?:System\.)?Label\.([A-Za-z][A-Za-z0-9_]*)",
}
_INVOKES = (r"\b([A-Z][A-Za-z0-9_]{2,})\.[A-Za-z_][A-Za-z0-9_]*\s*\(", r"\bnew\s+([A-Z][A-Za-z0-9_]{2,})\s*\(")
_ENDPOINT = r"['\"](https?://[^'\"\s]+)['\"]"
_CLASS = r"(?i)\b(?:public|private|protected|global)?\s*(?:with\s+sharing|without\s+sharing|inherited\s+sharing)?\s*(?:abstract\s+|virtual\s+)?(class|interface|enum)\s+([A-Za-z][A-Za-z0-9_]*)"
_TRIGGER = r"(?i)\btrigger\s+([A-Za-z][A-Za-z0-9_]*)\s+on\s+([A-Za-z][A-Za-z0-9_]*)\s*\(([^)]+)\)"
SYSTEM_TYPES = (
    "System", "Database", "Schema", "String", "Integer", "Decimal", "Double", "Boolean", "Date",
    "Datetime", "Time", "Math", "JSON", "Test", "Limits", "UserInfo", "Trigger", "List", "Map",
    "Set", "Id", "Blob", "Long", "Object", "SObject", "Type", "Label", "ApexPages",
    "PageReference", "Http", "HttpRequest", "HttpResponse", "Messaging", "Address", "Pattern",
    "Matcher", "Exception", "DmlException", "SObjectType", "SObjectField",
)


def code_lines(source: Column) -> Column:
    """Source without its comment-only lines."""
    return F.array_join(F.filter(F.split(source, r"\r\n|\n|\r"), lambda x: ~x.rlike(r"^\s*(?:\*|//|/\*)")), "\n")


def code_components(routed: DataFrame) -> DataFrame:
    files = routed.filter(F.col("metadata_type").isin("ApexClass", "ApexTrigger") & ~F.col("path").endswith("-meta.xml"))
    lines = files.select(
        "path", "sha256", "metadata_type", "stem", code_lines(F.decode("content", "UTF-8")).alias("source")
    )
    trigger = F.col("metadata_type") == "ApexTrigger"
    name = F.when(trigger, F.regexp_extract("source", _TRIGGER, 1)).otherwise(F.regexp_extract("source", _CLASS, 2))
    named = F.coalesce(F.nullif(name, F.lit("")), F.col("stem"))
    events = F.array_sort(F.transform(F.split(F.regexp_extract("source", _TRIGGER, 3), ","), lambda e: F.trim(e)))
    sharing = F.coalesce(F.nullif(F.lower(F.regexp_extract("source", r"(?i)\b(with|without|inherited)\s+sharing\b", 1)), F.lit("")), F.lit("omitted"))
    facts = F.when(trigger, F.create_map(
        F.lit("object"), F.regexp_extract("source", _TRIGGER, 2), F.lit("events"), F.array_join(events, ", "),
    )).otherwise(F.create_map(
        F.lit("declarationKind"), F.coalesce(F.nullif(F.lower(F.regexp_extract("source", _CLASS, 1)), F.lit("")), F.lit("unknown")),
        F.lit("sharingModel"), sharing,
        F.lit("superclass"), F.regexp_extract("source", r"\bextends\s+([A-Za-z][A-Za-z0-9_]*)", 1),
        F.lit("isTest"), F.col("source").rlike(r"(?i)@isTest\b|\btestMethod\b").cast("string"),
    ))
    return lines.select(
        F.concat_ws(":", "metadata_type", named).alias("component_id"), "metadata_type", named.alias("name"), "path", "sha256",
        F.when(trigger, F.nullif(F.regexp_extract("source", _TRIGGER, 2), F.lit(""))).alias("object_name"),
        F.map_filter(facts, lambda k, v: v != "").alias("facts"), "source",
    )


def code_edges(code: DataFrame) -> DataFrame:
    """Edges read from code by pattern; which of them are inferred follows from kind and flag."""
    def found(kind: str, values: Column, flag: bool = False) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(
            F.lit(kind).alias("kind"), v.alias("target"), F.lit(flag).alias("flag")
        ))

    every = lambda pattern: F.regexp_extract_all("source", F.lit(pattern), F.lit(1))
    calls = F.filter(F.concat(*[every(p) for p in _INVOKES]), lambda v: ~v.isin(*SYSTEM_TYPES) & (v != F.col("name")))
    hosts = F.filter(F.transform(every(_ENDPOINT), lambda u: F.lower(F.try_parse_url(u, F.lit("HOST")))), lambda h: h.isNotNull())
    owner = F.array_compact(F.array("object_name"))
    blocks = [found(kind, every(p), kind == "queries-object") for kind, p in _CODE.items()] + [
        found("invokes-class", calls), found("callout-endpoint", hosts), found("belongs-to", owner), found("operates-on", owner),
    ]
    return code.select("component_id", F.explode(F.concat(*blocks)).alias("e")).select("component_id", "e.*")


def criteria(nodes: DataFrame) -> DataFrame:
    """Filter rows of automation metadata: field, operator, a value fit to keep, reference."""
    kid = lambda n: F.try_element_at("kids", F.lit(n))
    rows = nodes.filter(F.col("tag").isin(*CRITERIA) & kid("field").isNotNull())
    typed = nodes.filter((F.col("tag") == "value") & F.col("up").isin(*CRITERIA)).select(
        "path", F.col("parent").alias("ord"), F.col("kids").alias("typed")
    )
    joined = rows.join(typed, ["path", "ord"], "left")
    literal = F.get(F.map_values(F.map_filter("typed", lambda k, v: k != "elementReference")), F.lit(0))
    return joined.select(
        "path", "ord", kid("field").alias("field"), F.coalesce(kid("operator"), kid("operation")).alias("operator"),
        safe_literal(F.coalesce(kid("value"), kid("valueField"), literal)).alias("value"),
        F.coalesce(kid("elementReference"), F.try_element_at("typed", F.lit("elementReference"))).alias("element_reference"),
    )


def page_components(routed: DataFrame) -> DataFrame:
    """Page and component markup files, with their source."""
    pages = routed.filter(F.col("metadata_type").isin("ApexPage", "ApexComponent") & ~F.col("path").endswith("-meta.xml"))
    return pages.select(
        F.concat_ws(":", "metadata_type", "stem").alias("component_id"), "metadata_type", F.col("stem").alias("name"), "path", "sha256",
        F.lit(None).cast("string").alias("object_name"), F.create_map().cast("map<string,string>").alias("facts"),
        F.decode("content", "UTF-8").alias("source"),
    )


def bundle_files(files: DataFrame) -> DataFrame:
    """Files of web and Aura component bundles, named after their folder."""
    inside = r"(?:^|/)(lwc|aura)/([^/]+)/"
    kind = F.when(F.regexp_extract("path", inside, 1) == "lwc", "LightningComponentBundle").otherwise("AuraDefinitionBundle")
    return files.filter(F.col("path").rlike(inside)).select(
        kind.alias("metadata_type"), F.regexp_extract("path", inside, 2).alias("name"), "path", "sha256", "content"
    ).withColumn("component_id", F.concat_ws(":", "metadata_type", "name"))


def bundle_components(bundles: DataFrame) -> DataFrame:
    """One component per bundle, located at its description file when it has one."""
    described = F.struct((~F.col("path").endswith("-meta.xml")).alias("after"), "path", "sha256")
    return bundles.groupBy("component_id", "metadata_type", "name").agg(F.min(described).alias("d")).select(
        "component_id", "metadata_type", "name", "d.path", "d.sha256", F.lit(None).cast("string").alias("object_name"),
        F.create_map().cast("map<string,string>").alias("facts"),
    )


def collect(files: DataFrame, max_edges: int | None = None) -> dict[str, DataFrame]:
    """Components, edges, generic files, diagnostics and truncated kinds of a scanned tree.

    All edges are kept unless ``max_edges`` per component is given (``MAX_EDGES`` is the usual one);
    what that drops is stated per component and kind.
    """
    bundles = bundle_files(files)
    routed = route(files.filter(~F.col("path").rlike(r"(?:^|/)(lwc|aura)/[^/]+/")))
    # Markup is parsed once; every rule reads the written elements.
    nodes = cut_lineage(elements(routed))
    marked = components(nodes)
    code = code_components(routed)
    pages = page_components(routed)
    declared = markup_edges(nodes, marked)
    served = declared if max_edges is None else cut_lineage(capped_edges(declared, "component_id", "position", GRANT_PRIORITY, max_edges))
    truncated = truncated_families(declared, served, "component_id")
    kept = served.select("component_id", "kind", "target", F.lit(False).alias("flag"))
    scripts = bundles.filter(F.col("path").rlike(r"\.(js|html|cmp|app|evt)$")).select("component_id", F.decode("content", "UTF-8").alias("source"))
    found = kept
    formulas = marked.filter(F.col("metadata_type").isin("CustomField", "ValidationRule")).select(
        "component_id", "object_name",
        F.coalesce(F.try_element_at("facts", F.lit("formula")), F.try_element_at("facts", F.lit("errorConditionFormula"))).alias("formula"),
    ).filter(F.col("formula").isNotNull())
    inferred = [
        (fields.formula_references(formulas, fields.relationship_targets(nodes)), "references-field"),
        (fields.soql_fields(code), "soql-field"), (fields.variable_fields(code), "var-field-ref"),
    ]
    for rows, kind in inferred:
        found = found.unionByName(rows.select("component_id", F.lit(kind).alias("kind"), "target", F.lit(True).alias("flag")))
    for more in (code_edges(code), markup.page_edges(pages), markup.bundle_edges(scripts), markup.page_edges(
            scripts.filter(F.col("component_id").startswith("AuraDefinitionBundle")))):
        found = found.unionByName(more)
    edges = found.select(
        F.col("component_id").alias("source"), "kind", "target", assurance(F.col("kind"), F.col("flag")).alias("assurance")
    )
    comps = marked.drop("part").unionByName(code.drop("source")).unionByName(pages.drop("source")).unionByName(bundle_components(bundles))
    companions = routed.filter(F.col("metadata_type").isin(*CODE_TYPES.values())).select(F.concat("path", F.lit("-meta.xml")).alias("path"))
    handled = comps.select("path").unionByName(companions).unionByName(bundles.select("path"))
    generic = files.select("path", "sha256").join(handled, "path", "left_anti")
    return {"components": comps, "edges": edges, "generic": generic, "diagnostics": diagnostics(nodes), "truncated": truncated}
