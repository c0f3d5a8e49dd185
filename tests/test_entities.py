import json

from pyspark.sql import functions as F

from tomeweave.operators import entities

SCHEMA = (
    "id string, type string, name string, aliases array<string>, attributes string, "
    "mentions array<struct<file_name:string,chunk_id:string>>, score double"
)


def statements(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("attributes", F.parse_json("attributes"))


def rows_of(spark):
    m = lambda *places: [{"file_name": f, "chunk_id": c} for f, c in places]
    return statements(spark, [
        ("hermione", "Person", "Hermione", ["Hermione  Granger", " the girl"], '{"house": "G", "age": 11}', m(("b", "2"), ("a", "1")), 0.9),
        ("hermione_granger", "Person", "hermione granger", [], '{"house": "R", "cat": {"name": "C"}}', m(("a", "1")), 0.5),
        ("hermione", "Witch", "Hermione", None, None, None, None),
        ("ron", "Person", "Ron", ["the boy"], '"not an object"', m(("a", "1")), 0.8),
        ("harry", "Person", "Harry", ["the boy", ""], "{}", [], 0.7),
        ("draco", "Person", "Draco", ["the boy", "THE GIRL"], "{}", None, 0.1),
        (None, "Person", "Nobody", ["Ron"], "{}", None, 1.0),
    ])


def test_aliases_join_ids_through_others(spark):
    merged = entities.merge(rows_of(spark))
    assert {r.entity for r in merged.members.collect()} == {"hermione"}
    assert merged.members.count() == 5
    one = merged.entities.first()
    assert (one.type, one.name, one.score, one.n_ids, one.n_statements, one.n_conflicts) == ("Person", "Hermione", 0.9, 5, 6, 1)
    full = merged.entities.select(F.to_json("attributes")).first()[0]
    assert json.loads(full) == {"age": 11, "cat": {"name": "C"}, "house": "G"}
    assert [(r.position, r.file_name, r.chunk_id, r.n) for r in merged.mentions.orderBy("position").collect()] == [(0, "a", "1", 3), (1, "b", "2", 1)]
    assert {r.alias: r.n for r in merged.aliases.collect()}["the boy"] == 3


def test_ambiguous_aliases_link_nothing(spark):
    merged = entities.merge(rows_of(spark), max_ids=2)
    groups = {}
    for r in merged.members.collect():
        groups.setdefault(r.entity, set()).add(r.id)
    # "the boy" names three, "the girl" and "hermione granger" two each.
    assert groups == {"hermione": {"hermione", "hermione_granger", "draco"}, "ron": {"ron"}, "harry": {"harry"}}


def test_no_statements(spark):
    merged = entities.merge(rows_of(spark).limit(0))
    assert [df.count() for df in (merged.members, merged.entities, merged.aliases, merged.mentions, merged.attributes)] == [0] * 5


def test_relationships(spark):
    members = spark.createDataFrame([("a", "a"), ("a2", "a"), ("b", "b")], "id string, entity string")
    ref = lambda f, c: {"file_name": f, "chunk_id": c}
    stated = spark.createDataFrame(
        [
            ("a", "b", "knows", "d1", "e1", 0.2, ref("f", "1")), ("a2", "b", "knows", "d2", "e2", 0.7, ref("f", "1")), ("a2", "b", "knows", "d0", "e0", None, ref("g", "1")),
            ("a", "a2", "is", "x", "y", 1.0, ref("f", "1")), ("b", "zed", "knows", "d", "e", 0.1, None),
        ],
        "source_id string, target_id string, type string, description string, evidence string, score double, source_ref struct<file_name:string,chunk_id:string>",
    )
    got = {(r.source_id, r.type, r.target_id): (r.description, r.evidence, r.score, r.n_statements, r.n_sources) for r in entities.merge_relationships(stated, members).collect()}
    assert got == {("a", "knows", "b"): ("d2", "e2", 0.7, 3, 2), ("b", "knows", "zed"): ("d", "e", 0.1, 1, 1)}
