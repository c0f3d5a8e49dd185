"""Books to chunks, vectors, sections, extractions and question-answer pairs, end to end."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_models_sources import epub

from tomeweave import cli, jobs
from tomeweave.models.boundary import HashedEmbedder, TemplateGenerator
from tomeweave.operators.tables import TableStore

# The model functions below live in this module, which the workers cannot import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pairs(prompt):
    ids = re.findall(r"CHUNK_ID: (\S+) ===|\[Chunk ID: (\S+)\]", prompt)
    ids = [a or b for a, b in ids]
    good = {"question": "What happens here then?", "answer": "A" * 60, "complexity": "complex", "evidence_quote": "q" * 25}
    return json.dumps({"qa_pairs": [{**good, "source_chunk_ids": [ids[0], "made_up"]}, {**good, "answer": "short", "source_chunk_ids": ids[:1]},
                                    {**good, "source_chunk_ids": ["made_up"]}, {**good, "source_chunk_ids": ids[-1:]}]})


def extraction(prompt):
    return json.dumps({"entities": [{"id": "a", "type": "t", "name": "A"}], "relationships": [], "schema_proposals": []})


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    series = root / "wheel_of_time"
    series.mkdir()
    for b in range(3):
        paras = [f"<p>Chapter {c}</p><p>{'word%d ' % c * 900}</p>" for c in range(4)]
        (series / f"book{b}.epub").write_bytes(epub(paras))
    store = TableStore(spark, str(root / "store"))
    summary = jobs.ingest(spark, str(series), "Wheel of Time", store).first()
    return root, store, summary


def test_ingest(world):
    root, store, summary = world
    chunks = store.read("rag_chunks").orderBy("chunk_id").collect()
    assert summary.total_chunks == len(chunks) > 15
    assert chunks[0].chunk_id == "wheel_of_time_rag_00000" and chunks[0].metadata.book_name == "book0"
    assert {c.metadata.book_name for c in chunks} == {"book0", "book1", "book2"}


def test_embed_and_load(world):
    root, store, summary = world
    path = str(root / "emb")
    jobs.embed(store, "Wheel of Time", path, HashedEmbedder(8))
    jobs.embed(store, "Wheel of Time", path, HashedEmbedder(8))
    assert jobs.load_vectors(store, path) == summary.total_chunks
    assert jobs.load_vectors(store, path) == store.read("vectors").count() == summary.total_chunks
    texts = store.read("rag_chunks").select("chunk_id", "text_content")
    got = jobs.embed_with_cache(store, texts, "text_content", HashedEmbedder(8))
    assert got.where(F.col("embedding").isNull()).count() == 0
    assert store.read("embedding_cache").count() == texts.select("text_content").distinct().count()


def test_sections_and_extraction(spark, world):
    root, store, _ = world
    rows = jobs.pack_series(spark, str(root), "wheel_of_time", 6_000, 0.1, store).collect()
    assert all(r.token_count <= 5_400 for r in rows) and rows[0].chunk_id.startswith("wheel_of_time_section_0")
    sections = store.read("graph_chunks").select(
        F.col("chunk_id").alias("section_id"), "series", F.concat("chunk_id", F.lit(".txt")).alias("file_name"), F.col("text_content").alias("text")
    )
    model = TemplateGenerator(extraction)
    onto = TemplateGenerator(lambda p: '{"entity_types": [{"name": "t"}], "canonical_renaming_rules": {"x": "A"}}')
    with pytest.raises(ValueError):
        jobs.extract_series(store, "wheel_of_time", model)
    assert jobs.generate_ontology(store, ["wheel_of_time"], onto) == 1
    assert store.read("schemas").first().canonical_renaming_rules == {"x": "A"}
    assert jobs.extract_series(store, "wheel_of_time", model) == len(rows)
    assert jobs.extract_entities(store, sections, "{}", model) == 0
    one = store.read("extraction_results").first()
    assert one.entities[0].confidence.score == 1.0 and one.entities[0].mentions[0].chunk_id == one.chunk_id


def test_pairs(world):
    root, store, summary = world
    model = TemplateGenerator(pairs)
    n = -(-summary.total_chunks // 8)
    assert jobs.generate_category_pairs(store, "wheel_of_time", "lore", model) == 3 * n
    assert jobs.generate_category_pairs(store, "wheel_of_time", "lore", model) == 0
    assert jobs.generate_category_pairs(store, "wheel_of_time", "lore", TemplateGenerator(lambda p: json.dumps({"qa_pairs": json.loads(pairs(p))["qa_pairs"][:1]})), skip_processed=False) == n
    assert store.read("qa_pairs").where("category = 'lore'").count() == n  # no stale pairs of a batch are left
    batches = -(-summary.total_chunks // 5)
    assert jobs.generate_evaluation_pairs(store, "wheel_of_time", model, batch_size=5) == 2 * batches
    assert jobs.generate_evaluation_pairs(store, "wheel_of_time", model, batch_size=5) == 0
    row = store.read("qa_pairs").where("category = 'rag_evaluation'").orderBy("qa_id").first()
    assert row.qa_id == "wheel_of_time_rag_eval_0000_0000" and row.metadata.source_chunk_ids == ["wheel_of_time_rag_00000"]
    assert row.metadata.included_books == ["book0"]
    report = {(r.dimension, r.value): r.n for r in jobs.qa_report(store, "wheel_of_time").collect()}
    assert report[("category", "rag_evaluation")] == 2 * batches and report[("total", "total_qa_pairs")] == 2 * batches + n


def test_judge(world):
    root, store, _ = world
    seen = jobs.judge_quality(store, "template", "absent", TemplateGenerator(lambda p: p), 3)
    assert seen.count("\nQ: ") == 3 and "[Chunk ID: wheel_of_time_rag_" in seen and "Model absent" in seen


def test_cli(world, capsys):
    root, store, summary = world
    assert cli.main(["stats", "--store", store.root]) == 0
    assert "rag_chunks" in capsys.readouterr().out
    assert cli.main(["ingest", "--dir", str(root / "wheel_of_time"), "--universe", "Wheel of Time", "--output", str(root / "out.json")]) == 0
    assert str(summary.total_chunks) in capsys.readouterr().out and (root / "out.json").exists()
    assert cli.main(["embed", "--store", store.root, "--universe", "Wheel of Time", "--path", str(root / "emb")]) == 0
    assert cli.main(["load", "--store", store.root, "--path", str(root / "emb")]) == 0
    assert capsys.readouterr().out.strip() == str(summary.total_chunks)
    assert cli.main(["stats", "--store", store.root, "--series", "wheel_of_time"]) == 0
    assert cli.main(["sections", "--root", str(root), "--series", "nope", "--context-window", "10"]) == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["qna"])
