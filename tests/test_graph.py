from __future__ import annotations

import json

import pytest

from motifold.functions import predicates as P
from motifold.operators import ingest, properties, signatures
from motifold.plans.engine import Engine
from motifold.plans.graph import from_records
from motifold.sources import networks, records, storage

NODES = [
    ("o1", ["Officer"], {"name": "Ann", "countries": ["France"], "age": 25.7}),
    ("o2", ["Officer"], {"name": "Bob", "countries": ["Russia", "France"]}),
    ("o3", ["Officer"], {"name": "Cid", "countries": []}),
    ("e1", ["Entity"], {"name": "X", "jurisdiction": "BVI", "countries": ["Panama"]}),
    ("e2", ["Entity"], {"name": "Y", "jurisdiction": "SAM", "countries": ["Samoa", "France"]}),
    ("a1", ["Address"], {"countries": ["France"]}),
    ("i1", ["Intermediary"], {"name": "Int"}),
]
# fixed names of edge types
D, S, R, I = "director of", "shareholder of", "registered address", "intermediary of"
EDGES = [("o1", D, "e1"), ("o2", S, "e1"), ("o1", S, "e1"), ("o2", D, "e2"), ("e1", R, "a1"), ("i1", I, "e2"), ("o3", S, "e2"), ("o2", S, "e1"), ("o1", D, "o1"), ("o1", D, "zz")]
NODE_SCHEMA = "node_id string, labels array<string>, static_props struct<name:string,countries:array<string>,age:double,jurisdiction:string>, is_active boolean"
M1 = "MATCH (o:Officer)-[:`director of`]->(e:Entity)"
M2 = "MATCH (o:Officer)-[:`shareholder of`]->(e:Entity)"
M4 = "MATCH (q1:Officer)-[e1:`director of`]->(q2:Entity)<-[e2:`shareholder of`]-(q3:Officer), (q2)-[e3:`registered address`]->(q4:Address)"
CASES = {
    f"{M1} RETURN o, e": ["o1 e1", "o2 e2"],
    f"{M2} RETURN o, e": ["o1 e1", "o2 e1", "o3 e2"],
    "MATCH (o)-[x:`director of`]->(e), (o)-[y:`shareholder of`]->(e) RETURN o, e": ["o1 e1"],
    f"{M4} RETURN q1": ["o1 e1 o1 a1", "o1 e1 o2 a1"],
    f"{M4} WHERE q1.name <> q3.name AND (q2.countries CONTAINS 'France' OR q4.countries CONTAINS 'France') RETURN q1": ["o1 e1 o2 a1"],
    f"{M2} WHERE o.countries CONTAINS 'ran' RETURN o": ["o1 e1", "o2 e1"],
    f"{M2} WHERE o.countries IN ['France'] RETURN o": ["o1 e1"],
    f"{M2} WHERE NOT o.countries CONTAINS 'France' RETURN o": ["o3 e2"],
    f"{M1} WHERE o.age > 25 RETURN o": ["o1 e1"],
    f"{M1} WHERE NOT o.age > 100 RETURN o": ["o1 e1", "o2 e2"],
    f"{M1} WHERE o.age IS NULL RETURN o": ["o2 e2"],
    f"{M1} WHERE o.name IS NULL RETURN o": [],
    "MATCH (o:Officer)-[]->(e:Entity) RETURN o": ["o1 e1", "o2 e1", "o2 e2", "o3 e2"],
    "MATCH (e:Entity)-[:`director of`]-(o:Officer) RETURN o": ["e1 o1", "e2 o2"],
    "MATCH (x:Nope)-[:`director of`]->(e:Entity) RETURN x": [],
    f"{M1} WHERE e.jurisdiction IN ['BVI'] RETURN o": ["o1 e1"],
    f"{M1} WHERE o.age = 25 RETURN o": [],
    f"{M1}, (i:Intermediary)-[:`intermediary of`]->(f:Entity) RETURN o": ["o1 e1 i1 e2", "o2 e2 i1 e2"],
    "MATCH (a)-[:`director of`]->(a) RETURN a": [],
    "MATCH (i:Intermediary) RETURN i": ["i1"],
}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, labels, (p.get("name"), p.get("countries"), p.get("age"), p.get("jurisdiction")), True) for i, labels, p in NODES]
    nodes = spark.createDataFrame(rows, NODE_SCHEMA)
    edges = spark.createDataFrame([(f"x{k}", a, b, t, (float(k),)) for k, (a, t, b) in enumerate(EDGES)], "edge_id string, source_id string, target_id string, edge_type string, static_props struct<weight:double>")
    return nodes, edges


@pytest.fixture(scope="module")
def graph(frames):
    return from_records([frames[0]], frames[1])


@pytest.mark.parametrize("text", CASES)
def test_micro_graph(graph, text):
    assert sorted(" ".join(r) for r in Engine(graph).bindings(text).collect()) == CASES[text]


def test_modes_and_results(graph):
    loose = Engine(graph, strict_labels=False)
    assert sorted(r[0] for r in loose.bindings("MATCH (x:Nope)-[:`director of`]->(e:Entity) RETURN x").select("x").collect()) == ["o1", "o2"]
    assert Engine(graph, need_edge=True).run("MATCH (a) RETURN a") == (None, "Query must contain at least one edge")
    wary = Engine(graph, products=False)
    assert wary.run("MATCH (a)-[]->(b), (c)-[]->(d) RETURN a")[1] == "The pattern's parts share no node, and products are refused"
    assert wary.parse("MATCH (a)-[]->(b), (c)-[]->(d), (d)-[]->(a), (a) RETURN a").connected and not wary.parse("MATCH (a) RETURN a").edges
    found, error, stages = Engine(graph).run_with_timings(f"{M1} RETURN o")
    assert error is None and found[1] == 2 and "Matching" in stages.seconds and "total" in str(stages)
    rows = Engine(graph).query(f"{M1} RETURN o.name AS n, e ORDER BY n DESC LIMIT 1").collect()
    assert [tuple(r) for r in rows] == [("Bob", "e2")]
    with pytest.raises(ValueError, match="edge x"):
        Engine(graph).query("MATCH (a)-[x:`director of`]->(b) RETURN x")


def test_plans_use_no_python_and_no_product(graph):
    plan = Engine(graph).bindings(f"{M4} WHERE q1.name <> q3.name AND q2.jurisdiction = 'BVI' RETURN q1")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "UDF" not in plan


def test_ingest_signatures(frames):
    nodes, edges = ingest.nodes_of([frames[0]]), ingest.edges_of(frames[1])
    pairs = ingest.pairs(ingest.labelled_edges(edges, nodes)).cache()
    assert {(r.source_id, r.target_id): r.edge_types for r in pairs.collect()} == {("o1", "e1"): [D, S], ("o2", "e1"): [S, S], ("o2", "e2"): [D], ("o3", "e2"): [S], ("e1", "a1"): [R], ("i1", "e2"): [I]}
    table = ingest.label_pairs(pairs)
    assert table.count() == table.select("pair_id").distinct().count() == 6
    assert {"shareholder of": 2} in [r[0] for r in table.select("edge_1_2_types").collect()]
    assert ingest.edges_matches(pairs).count() == 8
    layout = signatures.load_layout(ingest.label_dictionary(nodes), ingest.type_dictionary(edges))
    assert layout.labels == {"Address": 0, "Entity": 1, "Intermediary": 2, "Officer": 3} and layout.width == 16
    from motifold.plans.cypher import parse

    queries = signatures.query_matrix(parse(f"{M2}, (u)-[]->(v) RETURN o"), layout)
    assert queries[1][2] == []
    domain = signatures.compatibility_domain(signatures.target_matrix(table, layout), ingest.node_pair_matches(pairs), queries)
    assert domain.where("q1 = 'o'").count() == 3 and domain.where("q1 = 'u'").count() == 6


def test_masks_beyond_one_word(spark):
    layout = signatures.Layout({f"L{i:03}": i for i in range(80)}, {"T": 0})
    assert len(layout.mask(["L079"], ["L079"])) == 3 and layout.mask(["L063"]) == [-(1 << 63)]
    frame = spark.createDataFrame([(1, ["L000", "L079"], ["L063"], {"T": 2})], "pair_id long, src_labels array<string>, dst_labels array<string>, edge_1_2_types map<string,int>")
    mask = signatures.target_matrix(frame, layout).first().target_bitmask
    assert mask == layout.mask(["L000", "L079"], ["L063"], ["T"])


def test_unpivot_keeps_types(spark):
    df = spark.createDataFrame([("n", ("s", 1, True, [1, 2], None, (5,)), "2001-01-01", None)], "node_id string, dynamic_props struct<a:string,b:int,c:boolean,d:array<int>,e:double,f:struct<x:int>>, `from` string, `to` string")
    rows = {r.property_name: r for r in ingest.unpivot(df, "node_id", "dynamic_props").collect()}
    assert set(rows) == {"a", "b", "c", "d", "f"}
    assert (rows["b"].numeric_value, rows["c"].string_value, rows["d"].numeric_values, rows["f"].string_value) == (1.0, "true", [1.0, 2.0], '{"x":5}')
    assert str(rows["a"]["from"]) == "2001-01-01 00:00:00" and rows["a"]["to"] is None
    assert properties.valid_at(ingest.unpivot(df, "node_id", "dynamic_props"), "2000-01-01").count() == 0


def test_property_pivots(graph):
    typed = {r.node_id: r for r in properties.load(graph.node_props, "node_id", {"age": P.Kind.DOUBLE, "countries": P.Kind.STRINGS}).collect()}
    assert typed["o1"].age == 25.7 and typed["o2"].countries__array == ["Russia", "France"] and "i1" not in typed
    edge = properties.load(graph.edge_props, "edge_id", {"weight": P.Kind.DOUBLE}).collect()
    assert len(edge) == 10
    assert properties.load_untyped(graph.edge_props, "edge_id", ["weight"]).columns == ["edge_id", "weight__string", "weight__numeric"]


def test_json_records_round_trip(spark, tmp_path, frames):
    (tmp_path / "path_1_officer_nodes_static_props_1.json").write_text(json.dumps([{"node_id": "o1", "labels": ["Officer"], "static_props": {"name": "Ann"}, "is_active": True}]))
    (tmp_path / "path_1_person_static_props_2.json").write_text(json.dumps([{"node_id": "e1", "labels": ["Entity"], "static_props": {"name": "X"}, "is_active": True}]))
    (tmp_path / "path_1_edges_static_props_1.json").write_text(json.dumps([{"edge_id": "k", "source_id": "o1", "target_id": "e1", "edge_type": D, "static_props": {"since": 3}}]))
    (tmp_path / "path_1_edges_static_props_2.json").write_text("[]")
    (tmp_path / "path_1_entity_nodes_dynamic_props_1.json").write_text(json.dumps([{"node_id": "e1", "labels": ["Entity"], "is_active": True, "from": "2001-01-01", "to": None, "dynamic_props": {"status": "Active"}}]))
    graph = records.read_graph(spark, str(tmp_path))
    assert [tuple(r) for r in Engine(graph).query(f"{M1} WHERE o.name = 'Ann' RETURN o, e.name").collect()] == [("o1", "X")]
    folder = str(tmp_path / "out")
    records.write_json(frames[0].repartition(3), folder, "person_nodes_static_props")
    files = records.write_json(frames[0].limit(0), folder, "empty_nodes_static_props")
    assert all(f.rsplit("/", 1)[-1].startswith("path_") for f in files)
    history = spark.createDataFrame([("o1", "new", "2001-01-01", None), ("o1", "old", None, "2001-01-01")], "id string, status string, `begin` string, `end` string")
    records.write_json(records.dynamic_node_records(history, "id", "Officer", ["status"], "begin", "end"), folder, "officer_nodes_dynamic_props")
    for _ in range(2):  # a batch written again replaces the first
        records.write_json(frames[1], folder, "edges_static_props")
    again = records.read_graph(spark, folder)
    assert again.nodes.count() == len(NODES) and again.node_props.count() == 15 and again.edges.count() == 8
    for text in CASES:
        assert sorted(" ".join(r) for r in Engine(again).bindings(text).collect()) == CASES[text]
    held = lambda when: [r[0] for r in Engine(again.as_of(when)).query(f"{M1} WHERE o.name = 'Ann' RETURN o.status").collect()]
    assert (held("2000-06-01"), held("2001-01-01")) == (["old"], ["new"])
    records.upload(spark, files[0].removeprefix("file:"), str(tmp_path / "there.json"))
    assert (tmp_path / "there.json").exists()


def test_dynamic_edges(spark):
    edges = spark.createDataFrame([("k", "a", "b", "T", 5, "2001-01-01", "2002-01-01")], "edge_id string, source_id string, target_id string, edge_type string, share int, b string, e string")
    nodes = spark.createDataFrame([("a", ["X"], None), ("b", ["X"], None)], "node_id string, labels array<string>, static_props struct<n:int>")
    graph = from_records([nodes], None, [], records.dynamic_edge_records(edges, ["share"], "b", "e"))
    assert graph.edge_props is None and graph.edge_history.count() == 1
    assert [r.numeric_value for r in graph.as_of("2001-06-01").edge_props.collect()] == [5.0] and graph.as_of("2002-01-01").edge_props.count() == 0


def test_storage(spark, tmp_path, frames):
    storage.create(spark, "graph_test")
    try:
        nodes, edges = ingest.nodes_of([frames[0]]), ingest.edges_of(frames[1])
        pairs = ingest.pairs(ingest.labelled_edges(edges, nodes))
        storage.append(ingest.label_pairs(pairs), "graph_test", "node_label_pair")
        storage.append(ingest.node_pair_matches(pairs), "graph_test", "node_pair_matches")
        storage.append(ingest.numbered(ingest.unpivot(frames[0], "node_id", "static_props"), "snproperty_id"), "graph_test", "node_static_props")
        storage.overwrite(ingest.label_dictionary(nodes), "graph_test", "metadata_node_labels")
        sizes = {t["table"]: t["rows"] for t in storage.describe(spark, "graph_test")}
        assert len(sizes) == 10 and sizes["node_label_pair"] == 6 and sizes["node_pair_matches"] == 6 and sizes["metadata_node_labels"] == 4
        assert ingest.max_id(spark.table("graph_test.node_static_props"), "snproperty_id").first()[0] > 0
    finally:
        storage.drop(spark, "graph_test")
    assert not spark.catalog.databaseExists("graph_test")
    storage.write_bulk_csv(ingest.nodes_of([frames[0]]), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id:ID", "labels:LABELS"]


def test_stored_graph(spark, tmp_path, frames):
    folder = str(tmp_path / "records")
    history = spark.createDataFrame([("e1", "Active", "2001-01-01", "2002-01-01")], "id string, status string, b string, e string")
    records.write_json(frames[0], folder, "person_nodes_static_props")
    records.write_json(frames[1], folder, "edges_static_props")
    records.write_json(records.dynamic_node_records(history, "id", "Entity", ["status"], "b", "e"), folder, "entity_nodes_dynamic_props")
    storage.load_folder(spark, folder, "graph_stored")
    try:
        more = spark.createDataFrame([("o9", ["Officer"], ("Zed",)), ("b9", ["Bank"], ("Yen",))], "node_id string, labels array<string>, static_props struct<name:string>")
        link = spark.createDataFrame([("y", "o9", "b9", D)], "edge_id string, source_id string, target_id string, edge_type string")
        engine = Engine.of_database(spark, "graph_stored")
        for text in CASES:
            assert sorted(" ".join(r) for r in engine.bindings(text).collect()) == CASES[text]
        assert Engine.of_database(spark, "graph_stored", as_of="2001-05-05").run(f"{M1} WHERE e.status = 'Active' RETURN o")[0][1] == 1
        assert engine.run(f"{M1} WHERE e.status = 'Active' RETURN o")[0][1] == 0
        storage.load(spark, "graph_stored", [more], link)
        sizes = {t["table"]: t["rows"] for t in storage.describe(spark, "graph_stored")}
        assert (sizes["node_label_pair"], sizes["target_bit_matrix"], sizes["node_pair_matches"], sizes["metadata_node_labels"], sizes["metadata_edge_types"]) == (7, 7, 7, 5, 4)
        ids = spark.table("graph_stored.node_static_props")
        assert ids.select("snproperty_id").distinct().count() == ids.count() == 17
        assert [tuple(r) for r in Engine.of_database(spark, "graph_stored").query(f"MATCH (o:Officer)-[:`{D}`]->(b:Bank) RETURN o.name, b.name").collect()] == [("Zed", "Yen")]
        from motifold.plans.cypher import parse

        assert sorted((r.t1, r.t2) for r in storage.stored_domain(spark, "graph_stored", parse(f"{M1} RETURN o")).collect()) == [("o1", "e1"), ("o2", "e2")]
    finally:
        storage.drop(spark, "graph_stored")


def test_labels_of_all_occurrences(graph):
    pattern = Engine(graph).parse(f"MATCH (a)-[:`{D}`]->(b:Entity), (a:Officer)-[]->(c), (b:Other) RETURN a")
    assert pattern.nodes["a"].labels == {"Officer"} and pattern.nodes["b"].labels == {"Entity", "Other"}


def test_csv_and_loaders(spark, tmp_path):
    (tmp_path / "Entity.csv").write_text('node_id,name,countries,status,incorporation_date\n1,"A ""quoted"", name\nover two lines","PAN; VGB",Active,23-MAR-2006\n2,B,,,\n')
    (tmp_path / "relations.csv").write_text("node_1,node_2,rel_type,start_date,end_date\n1,2,owner of,3-MAR-2006,\n")
    rows = networks.read_csv(spark, str(tmp_path / "Entity.csv"))
    assert rows.count() == networks.row_count(rows) == 2 and rows.first()["name"] == 'A "quoted", name\nover two lines'
    networks.load_offshore(spark, {"Entity": str(tmp_path / "Entity.csv")}, str(tmp_path / "relations.csv"), str(tmp_path / "off"))
    graph = records.read_graph(spark, str(tmp_path / "off"))
    assert [tuple(r) for r in Engine(graph.as_of("2010-01-01")).query("MATCH (a:Entity)-[:`owner of`]->(b) WHERE a.status = 'Active' RETURN a, b").collect()] == [("1", "2")]
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "1.").write_text("Date: Mon, 14 May 2001 16:39:00 -0700 (PDT)\nFrom: a@x.com\nTo: b@x.com\n\nhello\n")
    networks.load_mail(spark, str(tmp_path / "mail"), str(tmp_path / "mails"))
    assert records.read_graph(spark, str(tmp_path / "mails")).edges.count() == 1
    (tmp_path / "incidents.csv").write_text("eventid,motive,country,country_txt\n1,M,5,Peru\n2,,5,Perù\n")
    networks.load_incidents(spark, str(tmp_path / "incidents.csv"), str(tmp_path / "inc"))
    graph = records.read_graph(spark, str(tmp_path / "inc"))
    assert [r[0] for r in Engine(graph).query("MATCH (i:Incident)-[:OCCURRED_IN]->(c:Country) RETURN DISTINCT c.country").collect()] == ["Peru"]


def test_offshore_network(spark):
    entity = spark.createDataFrame([("1", " X ", "PAN;;VGB ", "23-MAR-2006", "1-JAN-2010", "3-FEB-2009", "Active"), ("1", "X", "", "", "", "", ""), ("2", "Y", None, "junk", "", "", "Dead")], "node_id string, name string, countries string, incorporation_date string, inactivation_date string, struck_off_date string, status string")
    nodes = networks.offshore_nodes(entity, "Entity")
    assert nodes.count() == 2 and nodes.where("node_id = 2").first().static_props.countries == []
    status = networks.offshore_entity_status(entity).collect()
    assert [(r["node_id"], r["from"], r["to"]) for r in status] == [(1, "2006-03-23", "2009-02-03")]
    static, dynamic = networks.offshore_edges(spark.createDataFrame([("1", "2", "director of", "3-MAR-2006", None), ("1", "2", "director of", "3-MAR-2006", None), ("1", "1", "x", None, None), (None, "1", "x", None, None), ("2", "1", "y", "", "")], "node_1 string, node_2 string, rel_type string, start_date string, end_date string"))
    assert static.count() == 2 and [r["from"] for r in dynamic.collect()] == ["2006-03-03"]


def test_mail_network(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "1.").write_text("Date: Mon, 14 May 2001 16:39:00 -0700 (PDT)\nFrom: A@x.com\nTo: b@x.com,\n\tC@x.com\nX-cc: d@x.com\nX-bcc: \n\nTo: nobody@x.com\n")
    (tmp_path / "inbox" / "2.").write_text("Date: nonsense\nFrom: a@x.com\nTo: b@x.com\n\nx")
    (tmp_path / "inbox" / "note.txt").write_text("From: a@x.com\nTo: b@x.com\n\nx")
    people, edges = networks.mail_graph(networks.parse_mail(networks.read_mail(spark, str(tmp_path))))
    assert sorted(r[0] for r in people.select("node_id").collect()) == ["a@x.com", "b@x.com", "c@x.com", "d@x.com"]
    assert sorted((r.edge_type, r.target_id, r.static_props.timestamp) for r in edges.collect()) == [("CC", "d@x.com", "2001-05-14T16:39:00-07:00"), ("TO", "b@x.com", "2001-05-14T16:39:00-07:00"), ("TO", "c@x.com", "2001-05-14T16:39:00-07:00")]


def test_incident_network(spark):
    rows = spark.createDataFrame([("1", "M", "5", "Peru", "g", "t1", "t2", "9, 8"), ("2", None, "5", "Peru", "g", None, None, None)], "eventid string, motive string, country string, country_txt string, gname string, target1 string, target2 string, related string")
    nodes, edges = networks.incident_graph(rows)
    assert len(nodes) == 16 and nodes["Country"].count() == 1 and nodes["Target"].count() == 2 and nodes["Weapon"].count() == 0
    types = sorted(r[0] for r in edges.where("source_id = '1'").select("edge_type").collect())
    assert types == ["IS_CARRIED_OUT_BY", "IS_CAUSED_BY", "IS_MEANT_TO", "IS_MEANT_TO", "IS_RELATED_TO", "IS_RELATED_TO", "OCCURRED_IN"]
    assert edges.where("edge_type = 'HAS_NATIONALITY'").count() == 2
