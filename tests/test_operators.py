import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evitrace.operators import coverage, features, gaps, graph, lanes, ledger, ordered, probe, profile, reconcile, resolve, traverse
from evitrace.vocab import TRANSITIONS, STATE_PAIRS

DAY = datetime(2024, 1, 1)


def _overlaps(windows):
    windows = sorted(windows)
    return sum(b[0] <= a[1] for a, b in zip(windows, windows[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_adjacent_overlaps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    windows = []
    for _ in range(400):
        low = rng.choice([7, rng.randint(0, 60)])  # one start holds half of the rows
        windows.append((low, low + rng.randint(-3, 9)))
    df = spark.createDataFrame([(DAY + timedelta(days=a), DAY + timedelta(days=b)) for a, b in windows], "low timestamp, high timestamp")
    row = ordered.adjacent_overlaps(df, "low", "high", slices=5).first()
    assert (row.windows, row.overlaps) == (400, _overlaps(windows))


def test_overlaps_of_nothing(spark):
    df = spark.createDataFrame([], "low timestamp, high timestamp")
    assert tuple(ordered.adjacent_overlaps(df, "low", "high").first()) == (0, 0)


def test_prefix_and_previous_across_chunks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), i, rng.randint(0, 99)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v int")
    got = {(r.k, r.i): (r.low, r.total) for r in ordered.prefix(df, ["k"], "i", 50, low=("min", F.col("v")), total=("sum", F.col("v"))).collect()}
    before = {(r.k, r.i): r.previous for r in ordered.previous(df, ["k"], "i", "v", 50).collect()}
    for k, i, _ in rows:
        earlier = [(j, v) for q, j, v in rows if q == k and j < i]
        assert got[(k, i)] == (min((v for _, v in earlier), default=None), sum(v for _, v in earlier))
        assert before[(k, i)] == (max(earlier)[1] if earlier else None)


def test_sequence_breaks(spark):
    numbers = [1, 2, 3, 6, 6, 7, 21, 22]
    df = spark.createDataFrame([(n,) for n in numbers], "sequence bigint")
    got = {(r.previous, r.sequence, r.missing, r.copies) for r in ordered.sequence_breaks(df, "sequence", bucket=5).collect()}
    assert got == {(3, 6, 2, 2), (7, 21, 13, 1)}


def test_convergence_of_the_documented_sequence(spark):
    df = spark.createDataFrame([("w", i, s) for i, s in enumerate((3, 2, 3, 2))], "k string, i bigint, size int")
    rows = ordered.convergence(df, "k", "i", "size", cap=9, chunk=2).sort("i").collect()
    assert [r.blocked for r in rows] == [False, False, False, True]
    assert [r.rounds_without_shrink for r in rows] == [0, 0, 1, 2]


def test_ledger_append_numbers_in_order(spark):
    df = spark.createDataFrame([(f"e{i:03d}",) for i in random.Random(1).sample(range(200), 200)], "identity string")
    rows = ledger.append(40, df, ["identity"]).sort("sequence").collect()
    assert [(r.sequence, r.identity) for r in rows] == [(41 + i, f"e{i:03d}") for i in range(200)]


LANE_CASES = [
    # path_ok, state, problems, content, approved, by, current -> lane
    ("a", False, "draft", 1, "d", "d", "r", True, "not-effective"), ("b", True, "draft", 1, "d", "d", "r", True, "draft"),
    ("c", True, "approved", 1, "d", "d", "r", True, "not-effective"), ("d", True, "approved", 0, "d", "d", "r", True, "not-effective"),
    ("e", True, "approved", 0, "d", "d", "r", True, "revoked"), ("f", True, "approved", 0, "d", "d", "r", True, "not-effective"),
    ("g", True, "approved", 0, "d", "x", "r", True, "not-effective"), ("h", True, "approved", 0, "d", "d", "z", True, "not-effective"),
    ("i", True, "approved", 0, "d", "d", "r", False, "approved-drifted"), ("j", True, "approved", 0, "d", "d", "r", True, "approved-current"),
]


def test_lane_cascade_order(spark):
    entries = spark.createDataFrame(
        [(i, p, s, n, c, a, by, "t", "m", cur) for i, p, s, n, c, a, by, cur, _ in LANE_CASES],
        "identity string, path_ok boolean, state string, problems int, content_digest string, approved_digest string, reviewed_by string, "
        "reviewed_at string, mechanism string, fragments_current boolean",
    )
    log = [(i, 1, "approve", "old" if i == "f" else "d", "r", "t", "m") for i in "aefghij"] + [("e", 2, "revoke", "d", "r", "t", "m")]
    records = spark.createDataFrame(log, "identity string, sequence int, action string, ledger_digest string, reviewed_by string, reviewed_at string, mechanism string")
    got = {r.identity: r.lane for r in lanes.compute(entries, records).collect()}
    assert got == {c[0]: c[-1] for c in LANE_CASES}


GRAPH = [  # identity, full_name, lane
    ("Obj:c:Case__c", "Case__c", "approved-current"), ("Fld:c:Case__c.Status__c", "Case__c.Status__c", "approved-current"),
    ("Fld:c:Acct__c.Name__c", "Acct__c.Name__c", "approved-current"), ("Fld:c:Case__c.Name__c", "Case__c.Name__c", "approved-current"),
    ("Cls:c:Svc", "Svc", "approved-current"), ("Cls:ns:Svc", "Svc", "approved-current"), ("Flw:c:F1", "F1", "approved-current"),
    ("Flw:c:F2", "F2", "draft"),
]
EDGES = [
    ("Fld:c:Case__c.Status__c", "belongs-to", "Case__c", "source-exact"), ("Flw:c:F1", "writes-field", "Case__c.Status__c", "source-exact"),
    ("Flw:c:F1", "reads-field", "Case__c.Status__c", "source-exact"), ("Flw:c:F2", "reads-field", "Case__c.Status__c", "source-exact"),
    ("Flw:c:F1", "object-token", "STATUS__c", "source-derived-heuristic"), ("Flw:c:F1", "invokes-class", "Svc", "source-derived-heuristic"),
    ("Flw:c:F1", "references-field", "Name__c", "source-exact"), ("Flw:c:F1", "references-field", "Gone__c", "source-exact"),
    ("Flw:c:F1", "operates-on", "ns__Thing__c", "source-exact"), ("Cls:c:Svc", "operates-on", "Flw:c:F1", "source-exact"),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(GRAPH, "identity string, full_name string, lane string")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "source string, kind string, target string, assurance string").withColumn("target_key", F.lower("target"))


def test_resolution_stages(entries, edges):
    rows = {r.target_key: r for r in graph.resolve_targets(entries, edges).collect()}
    got = {k: (r.resolution, r.target_identity, r.decidable) for k, r in rows.items()}
    assert got["case__c"] == ("resolved", "Obj:c:Case__c", True)
    assert got["status__c"] == ("resolved-by-member", "Fld:c:Case__c.Status__c", True)
    assert got["svc"] == ("ambiguous", None, False) and rows["svc"].candidates == 2
    assert got["name__c"][0] == "ambiguous" and got["gone__c"] == ("no-entry", None, True)
    assert got["ns__thing__c"] == ("no-entry", None, False) and got["flw:c:f1"][:2] == ("resolved", "Flw:c:F1")
    few = graph.resolve_targets(entries, edges.filter("target_key = 'svc'"), few=edges.filter("target_key = 'svc'").select("target_key").distinct())
    assert few.first().candidates == 2


def test_walk_keeps_one_row_per_edge_and_marks_owner_hops(spark, entries, edges):
    anchors = spark.createDataFrame([("Fld:c:Case__c.Status__c",)], "node string")
    rows = traverse.walk(edges, entries, anchors, 2, "incoming").collect()
    first = sorted((r.node, r.path[0].kind, r.path[0].owner_ward) for r in rows if r.hop == 1)
    assert first == [("Flw:c:F1", "reads-field", False), ("Flw:c:F1", "writes-field", False), ("Obj:c:Case__c", "belongs-to", True)]
    # F1 was reached by two edges, so what points at it is reached twice.
    assert sorted(r.node for r in rows if r.hop == 2) == ["Cls:c:Svc", "Cls:c:Svc"]
    single = traverse.walk(edges, entries, anchors, 2, "incoming", distinct_nodes=True).collect()
    assert sorted(r.node for r in single) == ["Cls:c:Svc", "Flw:c:F1", "Obj:c:Case__c"]
    halted = traverse.walk(edges, entries, anchors, 2, "incoming", stop_at=["F1"]).collect()
    assert max(r.hop for r in halted) == 1


def test_forward_walk_keeps_unresolved_nodes(spark, entries, edges):
    anchors = spark.createDataFrame([("Flw:c:F1",)], "node string")
    rows = {r.node: r for r in traverse.walk(edges, entries, anchors, 1, "outgoing", include_heuristic=True).collect()}
    assert not rows["Gone__c"].resolved and rows["Gone__c"].lifecycle is None
    assert rows["Svc"].min_assurance == "source-derived-heuristic"
    assert "Svc" not in {r.node for r in traverse.walk(edges, entries, anchors, 1, "outgoing").collect()}


def test_closure_survives_cycles(spark):
    depends = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "id string, depends_on string")
    starts = spark.createDataFrame([("a",), ("x",)], "start string")
    got = {(r.start, r.id) for r in traverse.closure(starts, depends).collect()}
    assert got == {("a", n) for n in "abcd"} | {("x", "x"), ("x", "y")}


def test_closure_of_a_long_chain_from_one_start(spark):
    depends = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)] + [("n5", "n25"), (None, "n1"), ("n3", None)], "id string, depends_on string")
    starts = spark.createDataFrame([("n10",), ("n10",), ("lone",), (None,)], "start string")
    got = [(r.start, r.id) for r in traverse.closure(starts, depends).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {("n10", f"n{i}") for i in range(10, 31)} | {("lone", "lone"), (None, None)}


def test_fill_rules_differ_by_operator(spark):
    df = spark.createDataFrame([(None, None, []), ("", 0, ["a"]), ("x", 1, None)], "s string, n int, l array<string>")
    fill = {r.field: r.filled for r in profile.field_fill(df, ["s", "n", "l"]).collect()}
    assert fill == {"s": 1, "n": 2, "l": 1}
    shape = profile.relationship_shape(df, "n").first()
    assert (shape.filled, shape.distinct_parents, shape.total) == (1, 1, 3)


def test_upper_median(spark):
    for counts in ([1, 2, 3, 9], [4], [1, 1, 7]):
        rows = [(f"p{i}",) for i, n in enumerate(counts) for _ in range(n)]
        got = profile.relationship_shape(spark.createDataFrame(rows, "p string"), "p").first()
        assert got.fan_out_median == sorted(counts)[len(counts) // 2]


def test_effectivity_open_ends(spark):
    rows = [(DAY, None), (None, DAY), (None, None), (DAY + timedelta(9), DAY + timedelta(10)), (DAY - timedelta(9), DAY - timedelta(3))]
    got = profile.config_effectivity(spark.createDataFrame(rows, "a timestamp, b timestamp"), "a", "b", DAY + timedelta(1)).first()
    assert (got.active, got.future, got.expired, got.unbounded) == (1, 1, 2, 1)
    assert got.overlapping_windows == _overlaps([(0, 9999), (-9999, 0), (9, 10), (-9, -3)])


def test_suppression_folds_small_groups(spark):
    rows = [("open",)] * 40 + [("new",)] * 12 + [("odd",)] * 3 + [(None,)] * 2
    got = {(r.key, r.record_count, r.groups) for r in probe.distribution(spark.createDataFrame(rows, "k string"), "k").collect()}
    assert got == {("open", 40, 1), ("new", 12, 1), (None, 5, 2)}


def test_record_sample(spark):
    rows = [(i, "s" if i % 5 else None, ({"type": "Acct"}, f"n{i}") if i % 5 else None) for i in range(25)]
    df = spark.createDataFrame(rows, "Id int, Status string, Owner struct<attributes:struct<type:string>,Name:string>")
    fill = {r.field: (r.populated_count, r.sample_size) for r in probe.record_sample(df).collect()}
    assert fill == {"Id": (25, 25), "Status": (20, 25), "Owner.Name": (20, 25)}
    nested = probe.record_structure(df).first()
    assert (nested.path, nested.target_object, nested.populated) == ("Owner", "Acct", 20)
    assert probe.record_sample(df.union(df).union(df)).collect() == []
    assert probe.strip_attributes(df).schema["Owner"].dataType.names == ["Name"]


def test_iso_parsing(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00.000+0200",), ("2024-01-01T08:00:00Z",), ("2024-01-01T08:00:00",), ("no",)], "t string")
    got = [r[0] for r in df.select(probe.iso_utc(probe.parse_iso(F.col("t")))).collect()]
    assert got == ["2024-01-01T08:00:00Z"] * 3 + [None]


def test_one_sided_rows_are_no_mismatch(spark):
    left = spark.createDataFrame([("a", 1, "text"), ("b", 2, "text"), ("d", None, "id")], "name string, length int, family string")
    right = spark.createDataFrame([("a", 1, "text"), ("c", 3, "text"), ("d", 5, "number")], "name string, length int, family string")
    rows = {r.name: r for r in reconcile.reconcile(left, right, ["name"], ["length"], "family").collect()}
    assert rows["a"].contested == [] and rows["b"].right_coverage == "missing" and rows["c"].contested == []
    assert rows["d"].contested == ["family", "length"] and rows["d"].length is None
    assert reconcile.compare_lists(left, left).count() == 0


def test_resolution_cascade(spark):
    comps = spark.createDataFrame([
        ("ApexClass:A", "ApexClass", "A", "force-app/m/classes/A.cls"), ("Lwc:tile", "LightningComponentBundle", "tile", "force-app/m/lwc/tile/tile.js-meta.xml"),
        ("L:x", "CustomLabel", "x", "force-app/m/labels/C.labels-meta.xml"), ("L:y", "CustomLabel", "y", "force-app/m/labels/C.labels-meta.xml"),
        ("Flow:A", "Flow", "A", "force-app/m/flows/A.flow-meta.xml"),
    ], "component_id string, metadata_type string, name string, path string")
    asked = [
        ("path", "C:\\w\\force-app\\m\\classes\\a.cls"), ("path", "force-app/m/classes/A.cls-meta.xml"), ("path", "force-app/m/lwc/tile/tile.html"),
        ("path", "./force-app/m/labels/C.labels-meta.xml"), ("path", "force-app/m/"), ("path", "../x"), ("path", "force-app/m/none"),
        ("name", "a"), ("name", "flow:a"), ("name", "C.labels-meta.xml"), ("name", "tyle"),
    ]
    selections, matches = resolve.resolve(spark.createDataFrame(asked, "kind string, input string"), comps)
    got = [{(r.kind, r.input): (r.resolution, r.matches) for r in selections.collect()}[a] for a in asked]
    assert got == [
        ("resolved", 1), ("resolved", 1), ("resolved", 1), ("expanded", 2), ("expanded", 5), ("unsupported", 0), ("unmatched", 0),
        ("ambiguous", 2), ("resolved", 1), ("expanded", 2), ("unmatched", 0),
    ]
    assert matches.filter("input = 'a'").count() == 2
    near = resolve.suggestions(["tyle"], comps).collect()
    assert near[0].suggestion == "tile"


def test_edge_cap_prefers_priority_then_order(spark):
    rows = [("c", "low", i) for i in range(5)] + [("c", "high", 10 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "component string, kind string, position int")
    kept = graph.capped_edges(df, "component", "position", {"high": 1}, cap=5)
    assert sorted((r.kind, r.position) for r in kept.collect()) == [("high", 10), ("high", 11), ("high", 12), ("low", 0), ("low", 1)]
    assert [(r.kind, r.dropped) for r in graph.truncated_families(df, kept, "component").collect()] == [("low", 3)]


def test_truncation_is_reported_only_where_relevant(spark):
    df = spark.createDataFrame([("a", "grants-field-edit", 5), ("b", "odd-family", 2)], "component string, kind string, dropped bigint")
    kinds = lambda asked: {r.kind for r in graph.truncation_gaps(df, asked).collect()}
    assert kinds(["grants-field-read"]) == {"grants-field-edit", "odd-family"}
    assert kinds(["grants-class-access"]) == {"odd-family"} and kinds([]) == {"grants-field-edit", "odd-family"}


def test_stored_edges_disclose_the_undecidable(spark):
    edges = spark.createDataFrame([
        ("s", "reads-field", "Case__c.Gone__c", "source-exact"), ("s", "object-token", "Gone__c", "source-derived-heuristic"),
        ("s", "object-token", "Status__c", "source-derived-heuristic"), ("s", "operates-on", "Account", "source-exact"),
    ], "source string, kind string, target string, assurance string")
    live = spark.createDataFrame([("Case__c",), ("Case__c.Status__c",)], "name string")
    got = {(r.component, r.verdict) for r in coverage.stored_edge_health(edges, live).collect()}
    assert got == {("Case__c", "fine"), ("Case__c.Gone__c", "gone"), ("Gone__c", "undecidable"), ("Status__c", "fine")}


def test_verification_reasons(spark):
    checklist = spark.createDataFrame([(c,) for c in "abcde"], "item_id string")
    verdicts = spark.createDataFrame([
        ("a", "ok", "fine", None), ("b", "perhaps", "s", None), ("c", "ok", "", None), ("d", "violation", "s", ""),
    ], "item_id string, verdict string, sentence string, addressed_by string")
    got = {r.gap_id: r.why for r in gaps.verification(checklist, verdicts).collect()}
    assert got == {"verify:b": "not a verdict", "verify:c": "no sentence", "verify:d:unaddressed": "unaddressed", "verify:e": "no verdict"}


def test_feature_narrative_and_lane(spark):
    docs = spark.createDataFrame([("s", {"Purpose and boundary": "x", "Odd": "y", "Evidence map": ""})], "slug string, sections map<string,string>")
    got = {(r.problem, r.detail) for r in features.narrative_violations(docs, ["Purpose and boundary", "Domain and data model", "Evidence map"]).collect()}
    assert got == {("core section missing or empty", "Domain and data model"), ("core section missing or empty", "Evidence map"), ("unknown section", "Odd")}


def test_transition_table_is_closed():
    assert set(TRANSITIONS) <= set(STATE_PAIRS) and {t for ts in TRANSITIONS.values() for t in ts} <= set(STATE_PAIRS)


def test_selection_sends_no_table_to_the_driver(spark):
    from evitrace.operators import resolve

    inputs = spark.createDataFrame([("path", "force-app/a"), ("path", "force-app/a/x.cls"), ("name", "X"), ("path", "force-app/n")], "kind string, input string")
    components = spark.createDataFrame(
        [("C:x", "ApexClass", "x", "force-app/a/x.cls"), ("C:y", "ApexClass", "y", "force-app/a/y.cls")],
        "component_id string, metadata_type string, name string, path string")
    selections, matches = resolve.resolve(inputs, components, spark.createDataFrame([("force-app/n",)], "path string"))
    for answer in (selections, matches):
        assert "Broadcast" not in answer._jdf.queryExecution().executedPlan().toString()
    assert {(r.input, r.resolution, r.matches) for r in selections.collect()} == {
        ("force-app/a", "expanded", 2), ("force-app/a/x.cls", "resolved", 1), ("X", "resolved", 1), ("force-app/n", "unsupported", 0)}
    assert {(r.input, r.component_id) for r in matches.collect()} == {
        ("force-app/a", "C:x"), ("force-app/a", "C:y"), ("force-app/a/x.cls", "C:x"), ("X", "C:x")}


def test_edges_with_numbered_targets_fold_without_python(spark):
    from evitrace.functions.analyze import fold_key
    from evitrace.plans.corpus import graph_edges

    edges = graph_edges(spark, "/root/testdata/sf0.001")
    assert edges._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 3
    rows = edges.select("target", "target_key").distinct().collect()
    assert rows and all(r.target_key == fold_key(r.target) for r in rows)
