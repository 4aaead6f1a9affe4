import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evitrace.functions import digest
from evitrace.operators.search import Corpus, Request, text_search
from evitrace.operators import postings, records
from evitrace.sources import documents, fields, flows, generation, markup, metadata, soql, tree
from evitrace.streaming import index as index_stream
from evitrace.streaming import ledger as stream
from evitrace.vocab import OBJECT_KINDS


def _put(root, path, text):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, encoding="utf-8")


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "force-app"
    ns = 'xmlns="http://example.org/m"'
    _put(root, "objects/Ticket__c/Ticket__c.object-meta.xml", f"<CustomObject {ns}><label>Ticket</label></CustomObject>")
    _put(root, "objects/Ticket__c/fields/Account__c.field-meta.xml", f"<CustomField {ns}><fullName>Account__c</fullName><type>Lookup</type><required>true</required><length>18</length><referenceTo>Account</referenceTo></CustomField>")
    _put(root, "permissionsets/Ops.permissionset-meta.xml", "<PermissionSet>" + "".join(
        f"<fieldPermissions><field>T.F{i}</field><readable>true</readable><editable>{'true' if i % 2 else 'false'}</editable></fieldPermissions>" for i in range(320)
    ) + "<userPermissions><name>ViewAllData</name><enabled>true</enabled></userPermissions></PermissionSet>")
    _put(root, "classes/Svc.cls", "// class for all\npublic with sharing class Svc { void a(){ Helper.go(); new Worker(); System.debug([SELECT Id FROM Ticket__c]); } }")
    _put(root, "classes/Svc.cls-meta.xml", "<ApexClass><apiVersion>60.0</apiVersion></ApexClass>")
    _put(root, "labels/CustomLabels.labels-meta.xml", "<CustomLabels><labels><fullName>A</fullName></labels><labels><fullName>B</fullName></labels></CustomLabels>")
    _put(root, "flows/Bad.flow-meta.xml", "<Flow><a></Flow>")
    _put(root, "notes/readme.txt", "hello")
    _put(root, "lwc/caseTile/caseTile.js", "import m from '@salesforce/apex/Svc.load'; import F from '@salesforce/schema/Ticket__c.Account__c'; const f = ['Ticket__c.Name'];")
    _put(root, "lwc/caseTile/caseTile.html", "<template><c-case-row></c-case-row></template>")
    _put(root, "lwc/caseTile/caseTile.js-meta.xml", "<LightningComponentBundle/>")
    _put(root, "pages/Edit.page", '<apex:page standardController="Ticket__c"><apex:inputField value="{!Ticket__c.Account__c}"/><apex:outputField value="{!Other.X}"/></apex:page>')
    _put(root, "flows/Route.flow-meta.xml", """<Flow><start><object>Ticket__c</object><connector><targetReference>D</targetReference></connector></start>
 <decisions><name>D</name><rules><name>Yes</name><connector><targetReference>Stop</targetReference></connector></rules>
  <defaultConnector><targetReference>Up</targetReference></defaultConnector></decisions>
 <recordUpdates><name>Up</name><object>Ticket__c</object><connector><targetReference>D</targetReference></connector>
  <faultConnector><targetReference>Stop</targetReference></faultConnector></recordUpdates>
 <customErrors><name>Stop</name><customErrorMessages><errorMessage>{!$Label.A} now</errorMessage><fieldSelection>Account__c</fieldSelection></customErrorMessages></customErrors></Flow>""")
    return root


def test_collector(spark, source):
    out = metadata.collect(tree.scan(spark, str(source)))
    names = {r.component_id for r in out["components"].collect()}
    assert names == {"CustomObject:Ticket__c", "CustomField:Ticket__c.Account__c", "PermissionSet:Ops", "ApexClass:Svc", "CustomLabel:A", "CustomLabel:B",
                     "LightningComponentBundle:caseTile", "ApexPage:Edit", "Flow:Route"}
    edges = {(r.source, r.kind, r.target, r.assurance) for r in out["edges"].collect()}
    assert ("CustomField:Ticket__c.Account__c", "belongs-to", "Ticket__c", "source-exact") in edges
    assert ("CustomField:Ticket__c.Account__c", "relationship", "Account", "source-exact") in edges
    assert {t for s, k, t, _ in edges if k == "invokes-class"} == {"Helper", "Worker"}
    assert ("ApexClass:Svc", "queries-object", "Ticket__c", "source-derived-heuristic") in edges
    assert {("apex-method", "Svc.load"), ("schema", "Ticket__c.Account__c"), ("references-field", "Ticket__c.Name"), ("embeds-component", "caseRow")} == {
        (k, t) for s, k, t, _ in edges if s == "LightningComponentBundle:caseTile"}
    assert {("operates-on", "Ticket__c"), ("writes-field", "Ticket__c.Account__c")} <= {(k, t) for s, k, t, _ in edges if s == "ApexPage:Edit"}
    grants = [k for s, k, _, _ in edges if s == "PermissionSet:Ops"]
    assert len(grants) == 321 and out["truncated"].isEmpty()
    capped = metadata.collect(tree.scan(spark, str(source)), max_edges=300)
    grants = [r.kind for r in capped["edges"].filter("source = 'PermissionSet:Ops'").collect()]
    assert len(grants) == 300 and "grants-user-permission" in grants  # the cap cuts field grants first
    assert sum(r.dropped for r in capped["truncated"].collect()) == 21
    assert [r.path for r in out["diagnostics"].collect()] == ["flows/Bad.flow-meta.xml"]
    assert {r.path for r in out["generic"].collect()} == {"flows/Bad.flow-meta.xml", "notes/readme.txt"}
    facets = {r.facet: (r.text, r.number, r.flag) for r in documents.facet_rows(out["components"]).filter("component_id like 'CustomField%'").collect()}
    assert facets["field.required"] == ("true", None, True) and facets["field.length"] == ("18", 18.0, None)


def test_formula_and_code_fields(spark):
    formulas = spark.createDataFrame([("F", "Case__c", "Owner__r.Unit__r.Name__c & Status__c & Lost__r.X__c & Owner__r.Name")], "component_id string, object_name string, formula string")
    targets = spark.createDataFrame([("Case__c", "Owner", "Person__c"), ("Person__c", "Unit", "Unit__c")], "object string, stem string, target string")
    assert {r.target for r in fields.formula_references(formulas, targets).collect()} == {"Unit__c.Name__c", "Case__c.Status__c", "Person__c.Name"}
    code = spark.createDataFrame([("C", "Ticket__c t = [SELECT Id, Owner.Name, (SELECT Id FROM Kids) FROM Ticket__c WHERE Status__c = :s AND Kind LIKE 'x']; t.Done__c = 1; t.clone(); Helper h = null; h.x = 2; for (Ticket__c u : l) { u.Name = ''; }", None)],
                                 "component_id string, source string, object_name string")
    assert {r.target for r in fields.soql_fields(code).collect()} == {"Ticket__c.Id", "Ticket__c.Status__c", "Ticket__c.Kind"}
    assert {r.target for r in fields.variable_fields(code).collect()} == {"Ticket__c.Done__c", "Ticket__c.Name"}


def test_flow_error_surfaces(spark, source):
    nodes = metadata.elements(metadata.route(tree.scan(spark, str(source), "*.flow-meta.xml")))
    labels = spark.createDataFrame([("A", "Stopped")], "name string, value string")
    rows = {r.kind: r for r in flows.resolved_messages(flows.error_surfaces(nodes), labels).collect()}
    assert rows["custom-error"].paths == [["D=Yes"], ["D=default"]]
    assert rows["custom-error"].resolved == "Stopped now" and rows["custom-error"].field_selection == "Account__c"
    assert rows["fault-path"].fault_target == "Stop" and rows["fault-path"].paths == [["D=default"]]


def test_component_objects(spark, source):
    out = metadata.collect(tree.scan(spark, str(source)))
    pairs = {(r.component_id, r.object_name) for r in markup.component_objects(out["components"], out["edges"], OBJECT_KINDS).collect()}
    assert ("CustomField:Ticket__c.Account__c", "Ticket__c") in pairs and ("Flow:Route", "Ticket__c") in pairs


def test_probe_definitions(spark):
    probes = spark.createDataFrame([
        ("ok", "record-sample", "SELECT Id FROM Case LIMIT 10", "Case"), ("far", "record-sample", "SELECT A.B.C.D FROM Case LIMIT 60", "Case"),
        ("other", "field-fill", "SELECT COUNT(Id) FROM Lead LIMIT 1", "Case"), ("ok", "field-fill", "SELECT COUNT(Id) FROM Case LIMIT 1", "Case"),
    ], "label string, kind string, query string, own_object string")
    got = {(r.label, r.problem) for r in soql.probe_problems(probes).collect()}
    assert got == {("far", "sample too large"), ("far", "path too long"), ("other", "reads another object"), ("ok", "label used twice")}


def test_rule_definitions(spark):
    text = "intro\n- **SAFE-A-1 — first**\n  more\n\n- **MP-B — other**\n- **SAFE-A-1 — again**"
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text.split("\n"))], "source string, line int, text string")
    got = {r.rule_id: r.declarations for r in records.rule_definitions(lines).collect()}
    assert got == {"SAFE-A-1": 2, "MP-B": 1}


def test_ids_are_never_reused(spark):
    new = spark.createDataFrame([("s", "node", 1), ("s", "node", 2), ("s", "claim", 1)], "slug string, kind string, ord int")
    used = spark.createDataFrame([("s", "node", 4), ("s", "node", 9)], "slug string, kind string, number int")
    got = {(r.kind, r.ord): r.id for r in records.allocate_ids(new, used, {"node": "FN", "claim": "FC"}).collect()}
    assert got == {("node", 1): "FN-010", ("node", 2): "FN-011", ("claim", 1): "FC-001"}


def test_tree_digest_and_drift(spark, source):
    files = tree.scan(spark, str(source))
    first = tree.tree_digest(files).first()
    assert first.files == 13 and first.digest == tree.tree_digest(files.repartition(7)).first().digest
    sha = files.filter("path = 'notes/readme.txt'").first().sha256
    recorded = spark.createDataFrame([("a", "notes/readme.txt", f"sha256:{sha}"), ("b", "notes/readme.txt", "sha256:0"), ("c", "nope", "x")], "identity string, path string, digest string")
    assert {r.identity: r.state for r in tree.drift(recorded, files).collect()} == {"a": "fine", "b": "changed", "c": "gone"}
    assert {r.identity: r.fragments_current for r in tree.fragments_current(recorded, files).collect()} == {"a": True, "b": False, "c": False}


def test_entry_documents(spark, tmp_path):
    pytest.importorskip("yaml")
    front = "schemaVersion: 1\nsubject:\n  metadataType: Flow\n  fullName: F1\ntypeFacts:\n  label: Übersicht\n"
    _put(tmp_path, "a/f1.md", f"---\n{front}---\n## Purpose\n\nRoutes cases.  \nMore.\n")
    _put(tmp_path, "a/bad.md", "---\nx: 1\nx: 2\n---\nbody")
    _put(tmp_path, "a/none.md", "no front matter")
    rows = {r.path.rsplit("/", 1)[1]: r for r in documents.read_entries(spark, str(tmp_path)).collect()}
    good = rows["f1.md"]
    assert good.subject.fullName == "F1" and good.purpose == "Routes cases.  \nMore." and good.sections["Purpose"].startswith("Routes")
    assert rows["bad.md"].problem == "front matter does not parse" and rows["none.md"].problem == "no front matter"


def test_canonical_digest_bytes(spark):
    row = spark.range(1).select(
        digest.canonical_json({"b": F.lit("ü/"), "a": F.lit(None).cast("string"), "c": F.struct(F.lit(1).alias("x"))}).alias("j"),
        digest.canonical_digest({"b": F.lit(1)}).alias("d"), digest.stable_id("KN", F.lit("a b"), F.lit("d")).alias("i"),
    ).first()
    assert row.j == json.dumps({"a": None, "b": "ü/", "c": {"x": 1}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert row.d.startswith("sha256:") and row.i.startswith("KN-A-B-")


def _corpus(df):
    return Corpus(df, {}, {"identity": F.col("full_name"), "purpose": F.col("purpose")})


def _entries(spark, extra=()):
    rows = [(f"T:c:{n}", n, "T", None, lane, p) for n, lane, p in (
        ("A", "approved-current", "route the queue"), ("B", "approved-current", "queue of cases"), ("C", "draft", "queue"), ("D", "approved-current", "none"),
        ("E", "approved-current", "other words entirely"), *extra,
    )]
    return spark.createDataFrame(rows, "identity string, full_name string, metadata_type string, namespace string, lane string, purpose string")


def test_chains_of_any_length(spark):
    up = spark.createDataFrame([(f"O{i}", "Up", f"O{i - 1}") for i in range(1, 30)] + [("O5", "Twin", "A"), ("O5", "Twin", "B")], "object string, stem string, target string")
    chain = lambda n: ".".join(["Up__r"] * n)
    rows = [("O29", chain(29)), ("O29", chain(29)), ("O29", chain(30)), ("O7", "Up__r.Up__r.Twin__r"), ("O3", "Down__r"), (None, chain(1)), ("O2", chain(2))]
    got = sorted((r.start, r.chain, r.end) for r in fields.chain_ends(spark.createDataFrame(rows, "start string, chain string"), up).collect())
    assert got == sorted([("O29", chain(29), "O0"), ("O7", rows[3][1], "A"), ("O7", rows[3][1], "B"), ("O2", chain(2), "O0")])
    formulas = spark.createDataFrame([("f", "O29", f"{chain(25)}.Name & {chain(30)}.Name + Own__c"), ("g", "O1", None)], "component_id string, object_name string, formula string")
    assert {tuple(r) for r in fields.formula_references(formulas, up).collect()} == {("f", "O4.Name"), ("f", "O29.Own__c")}
    nothing = spark.createDataFrame([], "start string, chain string")
    assert fields.chain_ends(nothing, up).collect() == []


def test_generation_answers_as_the_scan_does_and_refuses_stale(spark, tmp_path):
    entries = _entries(spark)
    home = str(tmp_path / "index")
    with pytest.raises(generation.StaleIndex):
        generation.load(spark, home)
    built = generation.build(_corpus(entries), home)
    assert built == generation.build(_corpus(entries.repartition(5)), home)
    request = Request(text="route cases queue")
    manifest = generation.load(spark, home, _corpus(entries))
    got = [(r.identity, r.score) for r in generation.search(spark, manifest, request).collect()]
    assert got == [(r.identity, r.score) for r in text_search(_corpus(entries), request).collect()]
    changed = _entries(spark, [("F", "draft", "new")])
    with pytest.raises(generation.StaleIndex):
        generation.load(spark, home, _corpus(changed))
    assert generation.build(_corpus(changed), home)["generation"] != built["generation"]
    assert built["laneCounts"]["revoked"] == 0 and built["entries"] == 5


def test_verification_of_served_rows(spark):
    entries = _entries(spark)
    recorded = entries.select("identity", F.when(F.col("full_name") == "B", "old").otherwise(F.sha2("purpose", 256)).alias("digest"))
    hits = spark.createDataFrame([("T:c:A",), ("T:c:B",), ("T:c:Z",)], "identity string")
    got = {r.identity: r.verification for r in generation.verify(hits, entries, recorded).collect()}
    assert got == {"T:c:A": "verified", "T:c:B": "changed", "T:c:Z": "gone"}


def test_changed_entries(spark):
    stamps = generation.stamps(_corpus(_entries(spark)))
    after = _entries(spark, [("F", "draft", "new")]).filter("full_name <> 'D'").withColumn("lane", F.when(F.col("full_name") == "C", "revoked").otherwise(F.col("lane")))
    got = {(r.identity, r.change) for r in generation.changed_entries(stamps, _corpus(after)).collect()}
    assert got == {("T:c:F", "new"), ("T:c:D", "removed"), ("T:c:C", "changed")}


def test_copies_of_an_identity_are_compared_as_a_whole(spark):
    one = _entries(spark)
    copy, nameless = one.filter("full_name = 'A'"), one.filter("full_name = 'B'").withColumn("identity", F.lit(None).cast("string"))
    before = one.unionByName(copy).unionByName(nameless)
    changes = lambda was, now: {(r.identity, r.change) for r in generation.changed_entries(generation.stamps(_corpus(was)), _corpus(now)).collect()}
    assert changes(before, before) == set()
    assert changes(before, one) == {("T:c:A", "changed"), (None, "removed")} and changes(one, before) == {("T:c:A", "changed"), (None, "new")}
    rows = lambda df: sorted(map(str, df.select("token", "identity", "field", "tf", "size").collect()))
    postings_of = lambda df: postings.token_postings(df, _corpus(df).fields)
    for was, now in ((before, one), (one, before)):
        assert rows(generation.incremental(postings_of(was), generation.stamps(_corpus(was)), _corpus(now))) == rows(postings_of(now))


def test_an_update_redoes_changed_entries_alone(spark, tmp_path, monkeypatch):
    from evitrace.plans.maintenance import QUERIES

    texts = [(i, f"words of text {i}", lang, "src", 15) for i, lang in enumerate(["en", "es", "de", "en", None, "fr"])]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given, real = [], generation.incremental
    monkeypatch.setattr(generation, "incremental", lambda previous, stamped, corpus: given.append((stamped, corpus)) or real(previous, stamped, corpus))
    row = QUERIES["incremental_equals_full"](spark, str(tmp_path)).first()
    assert row.differing == 0 and row.postings > 0
    got = {(r.identity.rsplit(".", 1)[1], r.change) for r in generation.changed_entries(*given[0]).collect()}
    assert got == {("1", "new"), ("4", "new"), ("2", "changed")}


def test_an_update_keeps_packed_postings(spark, tmp_path, monkeypatch):
    first = _entries(spark)
    home = str(tmp_path / "index")
    generation.build(_corpus(first), home)
    later = _entries(spark, [("F", "draft", "new words")]).filter("full_name <> 'D'").withColumn("lane", F.when(F.col("full_name") == "C", "revoked").otherwise(F.col("lane")))
    analysed, real = [], postings.token_postings
    monkeypatch.setattr(postings, "token_postings", lambda entries, *rest, **more: analysed.append(entries) or real(entries, *rest, **more))
    generation.update(_corpus(later), home)
    assert [sorted(r.full_name for r in e.collect()) for e in analysed] == [["C", "F"]]
    monkeypatch.undo()
    updated = generation.load(spark, home, _corpus(later))["home"]
    columns = ["token", "identity", "lane", "field", "tf", "size"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    want = rows(real(later, _corpus(later).fields, keep=["lane"]))
    assert rows(spark.read.parquet(f"{updated}/tokens")) == want
    assert rows(postings.unpacked(spark.read.parquet(f"{updated}/postings"), list(_corpus(later).fields))) == want


def test_differing_postings_are_counted(spark):
    from evitrace.plans.maintenance import _differing

    def sides(one, other):
        fields = {"t": F.col("t"), "u": F.col("u")}
        made = [spark.createDataFrame(rows, "identity string, t string, u string") for rows in (one, other)]
        counted = [Counter((r.token, r.identity, r.field, r.tf) for r in postings.token_postings(m, fields).collect()) for m in made]
        every = counted[0].keys() | counted[1].keys()
        got = _differing(*(postings.token_postings(m, fields, packed=True) for m in made), list(fields)).collect()
        assert [tuple(r) for r in got] == [(sum(counted[0][k] != counted[1][k] for k in every), len(every))]

    rows = [("a", "one two two", "three"), ("a", "one two two", "three"), ("b", "four", None), (None, "five", "six"), ("c", "", "")]
    sides(rows, rows)
    sides(rows, rows[1:])
    sides(rows[:3], [*rows, ("a", "one two", "three"), ("b", "four more", "")])
    sides([], [])


def test_ledger_stream_is_idempotent_and_flags_gaps(spark, tmp_path):
    schema = "identity string, sequence bigint, action string"
    for i, batch in enumerate(([("a", 1, "approve"), ("b", 2, "approve")], [("a", 4, "revoke"), ("a", 3, "approve")], [("b", 6, "approve"), ("a", 4, "revoke")])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    records = stream.read_stream(spark, str(tmp_path / "in"), schema)
    stream.upsert_latest(records, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.identity, r.sequence, r.action) for r in stream.read_latest(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", 4, "revoke"), ("b", 6, "approve")}
    query = stream.numbering_stream(records).writeStream.format("memory").queryName("numbering").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    row = stream.numbering_verdict(spark.table("numbering")).first()
    assert (row.lowest, row.highest, row.records, row.missing, row.verdict) == (1, 6, 6, 1, "gap+replay")
    twice = spark.createDataFrame([(1,), (1,), (4,), (4,)], "sequence bigint")
    assert stream.numbering_verdict(stream.numbering_stream(twice)).first().verdict == "gap+replay"
    late = stream.numbering_verdict(stream.numbering_stream(twice.selectExpr("sequence + 3 AS sequence").distinct())).first()
    assert (late.missing, late.verdict) == (5, "gap")
    latest = stream.latest_stream(records).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    latest.awaitTermination()
    assert {(r.identity, r.sequence) for r in spark.table("newest").collect()} == {("a", 4), ("b", 6)}


def test_index_stream_keeps_the_newest_projection(spark, tmp_path):
    entries = _entries(spark)
    entries.filter("full_name = 'A'").coalesce(1).write.parquet(str(tmp_path / "in"))
    entries.filter("full_name = 'A'").withColumn("purpose", F.lit("rewritten")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = stream.read_stream(spark, str(tmp_path / "in"), entries.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    writer = index_stream.index_stream(changes, _corpus, str(tmp_path / "out"), str(tmp_path / "ck"))
    writer.trigger(availableNow=True).start().awaitTermination()
    batches = spark.read.parquet(str(tmp_path / "out"))
    assert batches.select("batch_id").distinct().count() == 2
    assert index_stream.current_postings(batches).filter("field = 'purpose'").select("token").distinct().count() in (1, 3)


def test_index_stream_forgets_emptied_and_removed_entries(spark, tmp_path):
    first = _entries(spark).withColumn("gone", F.lit(False))
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    later = first.filter("full_name IN ('A', 'B')").withColumn("gone", F.col("full_name") == "B").withColumn("purpose", F.lit("")).withColumn("full_name", F.lit(""))
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = stream.read_stream(spark, str(tmp_path / "in"), first.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    index_stream.index_stream(changes, _corpus, str(tmp_path / "out"), str(tmp_path / "ck"), "gone").trigger(availableNow=True).start().awaitTermination()
    batches = spark.read.parquet(str(tmp_path / "out"))
    held = {r.identity for r in index_stream.current_postings(batches).select("identity").distinct().collect()}
    order = {r.identity: r.batch_id for r in batches.groupBy("identity").agg(F.max("batch_id").alias("batch_id")).collect()}
    assert set(order) == {f"T:c:{n}" for n in "ABCDE"} and {f"T:c:{n}" for n in "CDE"} <= held
    if order["T:c:A"] == 1 and batches.filter("batch_id = 1").select("identity").distinct().count() == 2:
        assert held == {f"T:c:{n}" for n in "CDE"}
    index_stream.compact(batches, str(tmp_path / "small"))
    again = spark.read.parquet(str(tmp_path / "small"))
    assert index_stream.current_postings(again).count() == index_stream.current_postings(batches).count()


def test_broken_ledgers_are_refused(spark, tmp_path):
    for name, numbers in (("good", (1, 2, 3)), ("gap", (1, 3)), ("late", (2, 3)), ("twice", (1, 2, 2))):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"sequence": n}) + "\n" for n in numbers))
    assert documents.read_ledger(spark, str(tmp_path / "good.jsonl")).count() == 3
    for name in ("gap", "late", "twice"):
        with pytest.raises(documents.BrokenLedger):
            documents.read_ledger(spark, str(tmp_path / f"{name}.jsonl"))
        assert documents.read_ledger(spark, str(tmp_path / f"{name}.jsonl"), checked=False).count() >= 2


def test_formulas_are_searched_once_for_their_chains(spark):
    from evitrace.sources import fields

    formulas = spark.createDataFrame([(1, "A", "Up__r.Up__r.Name <> Own__c")], "component_id int, object_name string, formula string")
    targets = spark.createDataFrame([("A", "Up", "B"), ("B", "Up", "C")], "object string, stem string, target string")
    found = fields.formula_references(formulas, targets)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {r.target for r in found.collect()} == {"C.Name", "A.Own__c"}
