import json
import random

import pytest
from pyspark.sql import functions as F

from tomeweave.operators import graph
from tomeweave.session import cut_lineage
from tomeweave.sources import files


def edges_df(spark, pairs):
    return spark.createDataFrame([(a, "t", b) for a, b in pairs], "src string, type string, dst string")


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rng = random.Random(2)
    if shape == "random":
        pairs = [(f"v{rng.randint(0, 80):03d}", f"v{rng.randint(0, 80):03d}") for _ in range(60)]
    elif shape == "chain":
        order = list(range(40))
        rng.shuffle(order)
        pairs = [(f"v{a:03d}", f"v{b:03d}") for a, b in zip(order, order[1:])] + [("z", "z")]
    else:
        pairs = [("hub", f"v{i:03d}") for i in range(60)] + [("x", "y")]
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in graph.components(edges_df(spark, pairs)).collect()}
    assert got == {v: root(v) for v in parent}


def test_hops(spark):
    rng = random.Random(6)
    pairs = [(f"v{rng.randint(0, 40)}", f"v{rng.randint(0, 40)}") for _ in range(45)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start = pairs[0][0]
    want, front = {start: 0}, {start}
    for hop in (1, 2, 3):
        front = {n for v in front for n in near[v]} - set(want)
        want.update({v: hop for v in front})
    got = graph.within_hops(edges_df(spark, pairs), spark.createDataFrame([(start,)], "id string"), 3)
    assert {r.id: r.hop for r in got.collect()} == want


def test_checks_and_stats(spark):
    v = spark.createDataFrame([("a", "person"), ("b", "person"), ("c", "place"), ("d", "ghost")], "id string, type string")
    e = spark.createDataFrame([("a", "knows", "b"), ("a", "lives", "c"), ("c", "knows", "a"), ("a", "knows", "zz")], "src string, type string, dst string")
    assert [(r.endpoint, r.n_edges) for r in graph.dangling(e, v).collect()] == [("zz", 1)]
    onto = spark.createDataFrame([("knows", "person", "person"), ("lives", "person", "place")], "type string, source_type string, target_type string")
    assert {(r.src, r.dst) for r in graph.nonconforming(e, v, onto).collect()} == {("c", "a"), ("a", "zz")}
    types = spark.createDataFrame([("person",), ("place",)], "name string")
    assert [r.id for r in graph.unknown_types(v, types).collect()] == ["d"]
    stats = {(r.metric, r.name): r.value for r in graph.graph_stats(v, e).collect()}
    assert stats[("vertices", "person")] == 2 and stats[("edges", "knows")] == 3 and stats[("density", "all")] == round(4 / 12, 12)


def test_composition_merge_and_rename(spark):
    e = edges_df(spark, [("a", "b"), ("b", "c"), ("b", "d"), ("a", "x")])
    got = graph.composed_edges(e, "t", "t", "grand").collect()
    assert {(r.src, r.type, r.dst) for r in got} == {("a", "grand", "c"), ("a", "grand", "d")}
    m = spark.createDataFrame([("h", "Harry", 0.5, 1), ("h", "H. P.", 0.9, 2), ("h", "Harry", 0.9, 3), ("r", "Ron", 1.0, 4)], "id string, name string, score double, n long")
    merged = {r.id: (r.n_mentions, r.n_names, r.canonical_name, r.first_mention) for r in graph.merge_entities(m, "id", "name", F.col("score"), "n").collect()}
    assert merged == {"h": (3, 2, "H. P.", 1), "r": (1, 1, "Ron", 4)}
    assert {(r.id, r.name, r.n) for r in graph.entity_names(m, "id", "name").collect()} == {("h", "Harry", 2), ("h", "H. P.", 1), ("r", "Ron", 1)}
    s = spark.createDataFrame([("a", "t", "b", 0.2, 1, "x"), ("a", "t", "b", 0.7, 3, "y"), ("a", "t", "b", 0.7, 2, "z")], "src string, type string, dst string, score double, n long, text string")
    best = graph.resolve_edges(s, "src", "type", "dst", F.col("score"), "n", ["text", "score"]).first()
    assert (best.text, best.n_statements) == ("z", 3)
    rules = spark.createDataFrame([("H. P.", "Harry")], "alias string, canonical string")
    by_rows = graph.rename_by_table(m, "name", rules, "alias", "canonical")
    by_map = m.withColumn("name", graph.rename_canonical(F.col("name"), {"H. P.": "Harry"}))
    assert {r.name for r in by_rows.collect()} == {r.name for r in by_map.collect()} == {"Harry", "Ron"}


def test_extract_files(spark, tmp_path):
    entity = {"id": "a", "type": "person", "name": "A", "aliases": ["AA"], "attributes": {"age": 3}, "description": "d",
              "mentions": [{"file_name": "old", "chunk_id": "o"}], "confidence": None}
    other = {**entity, "id": "b", "attributes": "{bad json", "mentions": None, "confidence": {"score": 0.5, "needs_review": True, "review_reason": "r"}}
    rel = {"source_id": "a", "target_id": "c", "type": "knows", "description": "d", "evidence": "e", "properties": None, "source_ref": None, "confidence": None}
    prop = {"proposal_type": "new_entity_type", "name": "spell", "description": "d", "confidence": 0.5}
    for n in ("01", "02"):
        (tmp_path / f"s_section_{n}_extracted.json").write_text(json.dumps({"entities": [entity, other], "relationships": [rel], "schema_proposals": [prop]}, indent=2))
    rows = files.extracts(spark, str(tmp_path))
    stamped = graph.stamp_provenance(rows, F.col("file_name"), F.col("section_id"))
    v = graph.vertices(stamped, "section_id").where("section_id = 's_section_01'").orderBy("id").collect()
    assert [len(r.mentions) for r in v] == [2, 1] and v[0].mentions[1].chunk_id == "s_section_01"
    assert [r.confidence.score for r in v] == [1.0, 0.5] and json.loads(v[0].attributes) == {"age": 3} and v[1].attributes == "{bad json"
    e = graph.edges(stamped, "section_id")
    assert e.count() == 2 and e.first().confidence.score == 1.0 and e.first().source_ref.file_name.endswith(".json")
    assert graph.dangling(e, graph.vertices(stamped), "source_id", "target_id").first().endpoint == "c"
    tally = graph.proposal_tally(rows).first()
    assert (tally["name"], tally.n, tally.avg_confidence) == ("spell", 2, 0.5)
    done = rows.select("section_id")
    sections = spark.createDataFrame([("s_section_01",), ("s_section_03",)], "section_id string")
    assert [r[0] for r in files.pending_sections(sections, done).collect()] == ["s_section_03"]


def test_graph_context(spark):
    reached = spark.createDataFrame([("a", 0), ("b", 1)], "id string, hop int")
    mentions = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("b", "c2"), ("z", "c3")], "entity string, chunk_id string")
    chunks = spark.createDataFrame([("c1", "x"), ("c2", "y"), ("c3", "z")], "chunk_id string, text string")
    got = graph.graph_context(reached, mentions, chunks, "entity", "chunk_id").collect()
    assert [(r.chunk_id, r.hop, r.n_entities, r.text) for r in got] == [("c1", 0, 2, "x"), ("c2", 1, 1, "y")]


def test_ties_of_any_type(spark):
    rows = [("a", "x", 1.0, "c2"), ("a", "y", 1.0, "c1"), ("a", "z", None, "c0"), ("b", "q", None, "c9")]
    mentions = spark.createDataFrame(rows, "entity string, name string, score double, chunk string")
    merged = {r.entity: r for r in graph.merge_entities(mentions, "entity", "name", F.col("score"), "chunk").collect()}
    assert merged["a"].canonical_name == "y" and merged["a"].first_mention == "c0" and merged["b"].canonical_name == "q"


def test_vertices_listed_in_many_places(spark):
    vertices = spark.createDataFrame([("a", "person"), ("a", "person"), ("a", "place"), ("b", "person"), ("c", "thing")], "id string, type string")
    edges = spark.createDataFrame([("a", "knows", "b"), ("a", "knows", "c"), ("a", "eats", "c"), ("a", "knows", "gone")], "src string, type string, dst string")
    ontology = spark.createDataFrame([("knows", "person", "person"), ("eats", "person", "thing"), ("eats", "place", "thing")], "type string, source_type string, target_type string")
    got = sorted(tuple(r) for r in graph.nonconforming(edges, vertices, ontology).collect())
    assert got == [("a", "knows", "c", "person|place", "thing"), ("a", "knows", "gone", "person|place", None)]


def test_finished_edges_leave_the_list(spark, monkeypatch):
    written = []

    def cut(df, label):
        out = cut_lineage(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(graph, "cut_lineage", cut)
    # Stars, a chain whose ids rise, and ends that are null.
    pairs = [(f"c{k % 20:02d}", f"o{k:04d}") for k in range(400)] + [(f"p{k:04d}", f"p{k + 1:04d}") for k in range(200)] + [("x", None), (None, "y"), ("z", "z")]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    want = {f"o{k:04d}": f"c{k % 20:02d}" for k in range(400)} | {f"c{k:02d}": f"c{k:02d}" for k in range(20)}
    assert found == want | {f"p{k:04d}": "p0000" for k in range(201)} | {"x": "x", "y": "y", "z": "z", None: None}
    left = [n for label, n in written if label == "pairs"]
    assert left[0] == len(pairs) and left[1] < 200 and left[-1] == 0 and len(left) < 30
