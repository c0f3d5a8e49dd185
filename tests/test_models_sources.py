import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tomeweave.models import boundary, udfs
from tomeweave.operators import analyze, incremental
from tomeweave.sources import files
from tomeweave.streaming import jobs


def test_retry_and_fallback():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("quota exceeded" if len(calls) == 1 else "timeout")
        return "ok"

    assert boundary.Retry(sleep=waits.append)(call) == "ok" and waits == [60.0, 4.0, 8.0]
    with pytest.raises(RuntimeError):
        boundary.Retry(attempts=2, sleep=waits.append)(lambda: (_ for _ in ()).throw(RuntimeError("x")))

    class Broken:
        name = "broken"

        def generate(self, prompts):
            raise RuntimeError("503")

    chain = boundary.Fallback([Broken(), boundary.TemplateGenerator(name="second")])
    assert chain.generate(["p"])[0]["model"] == "second"
    with pytest.raises(RuntimeError):
        boundary.Fallback([Broken()]).generate(["p"])


def test_provider_choice():
    assert boundary.choose_provider(["google", "google_vertex"], "google", "embedding") == ("google_vertex", True)
    assert boundary.choose_provider(["google"], "google", "embedding") == ("google", True)
    assert boundary.choose_provider(["other"], "google") == ("other", False)
    with pytest.raises(ValueError):
        boundary.choose_provider([], "google")


def test_embedder_is_deterministic():
    a, b, c = boundary.HashedEmbedder(16).embed(["one two", "two ONE", ""])
    assert a == b and math.isclose(sum(x * x for x in a), 1.0) and not any(c)


def test_generation_and_ledger(spark):
    def reply(prompt):
        if "bad" in prompt:
            raise RuntimeError("deadline")
        return '{"name": "%s"}' % prompt

    df = spark.createDataFrame([("x y",), ("bad",)], "p string")
    out = df.withColumn("r", udfs.generate_column(F.col("p"), boundary.TemplateGenerator(reply)))
    parsed = udfs.structured(out.withColumn("content", F.col("r.content")), "content", "name STRING").orderBy("p").collect()
    assert parsed[1].parsed.name == "x y" and parsed[0].r.error == "deadline" and parsed[0].parsed is None
    ledger = udfs.usage_rows(out, "r", "local", F.lit("secret-key")).collect()
    assert len(ledger) == 1 and ledger[0].total_tokens == 5 and ledger[0].api_key_last4 == "...-key"


def epub(pages, manifest=True):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        if manifest:
            items = "".join(f'<item id="i{i}" href="t{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(pages)))
            z.writestr("OPS/a.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}<item href="c.css" media-type="text/css"/></manifest></package>')
        for i, p in reversed(list(enumerate(pages))):
            z.writestr(f"OPS/t{i}.xhtml", p)
    return buffer.getvalue()


def test_books(spark, tmp_path):
    root = tmp_path / "harry_potter"
    (root / "sub dir").mkdir(parents=True)
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><p>One <b>bold</b>&amp;</p><!-- no --><script>x</script></body></html>"
    (root / "b+1.epub").write_bytes(epub([page, "<p> </p>", "<p>Two</p>"]))
    (root / "sub dir" / "a.epub").write_bytes(b"not a zip")
    (root / "notes.txt").write_text("no")
    found = files.series_files(spark, str(tmp_path), "Harry_Potter")
    rows = {r.book_name: r.text for r in files.books(found).collect()}
    assert rows == {"b+1": "T One bold &\n\nTwo", "a": None}
    assert [r.book_name for r in files.unreadable(files.books(found)).collect()] == ["a"]
    nested = {r.book_name for r in files.books(found, nested=True).collect()}
    assert nested == {"harry_potter_b+1.epub", "sub dir_a.epub"}
    ordered = files.ordered_books(found).orderBy("book_order").collect()
    assert [(r.book_order, r.book_name) for r in ordered] == [(0, "b+1"), (1, "a")]
    assert files.book_files(spark, str(tmp_path / "absent")).count() == 0
    with pytest.raises(ValueError):
        files.series_files(spark, str(tmp_path), "unknown")
    with pytest.raises(FileNotFoundError):
        files.series_files(spark, str(tmp_path), "asoiaf")


def test_sections_and_settings(spark, tmp_path):
    for name in ("p_section_02.txt", "p_section_01.txt", "q_section_01.txt"):
        (tmp_path / name).write_text(f"{name}\nline two")
    rows = files.section_texts(spark, str(tmp_path), "p").collect()
    assert [(r.section_id, r.text.split("\n")[1]) for r in rows] == [("p_section_01", "line two"), ("p_section_02", "line two")]
    df = spark.createDataFrame([("asoiaf",), ("My Series",)], "series string")
    got = {r.series: (r.ontology_file, r.prefix) for r in files.with_settings(df, "series").collect()}
    assert got == {"asoiaf": ("a_song_of_ice_and_fire_schema.json", "asoiaf"), "My Series": ("my_series_schema.json", "my_series")}
    sections = spark.createDataFrame([("s", "s_section_01", "t")], "series string, chunk_id string, text_content string")
    files.write_sections(sections, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().series == "s"


def test_ontology(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"series_name": "S", "entity_types": [{"name": "person"}], "canonical_renaming_rules": {"a b": "A"}}')
    row = files.ontologies(spark, str(tmp_path)).first()
    assert row.canonical_renaming_rules == {"a b": "A"} and row.entity_types[0].name == "person"


def test_export_and_flatten(spark, tmp_path):
    docs = spark.createDataFrame([("abc", ("b", "1"))], "page_content string, metadata struct<book_name:string,n:string>")
    flat = analyze.flatten_documents(docs)
    assert flat.columns == ["text", "length", "book_name", "n"] and flat.first().length == 3
    for name, read in (("x.json", spark.read.json), ("x.csv", lambda p: spark.read.csv(p, header=True)), ("x.parquet", spark.read.parquet), ("x.odd", spark.read.json)):
        analyze.export(flat, str(tmp_path / name))
        assert read(str(tmp_path / name)).first()["book_name"] == "b"


def test_embed_arrivals(spark, tmp_path):
    schema = "chunk_id string, series string, text_content string, character_count bigint, metadata struct<book_name:string,chapter_number:string,chapter_title:string,universe:string>"
    chunks = spark.createDataFrame([(f"c{i}", "s", f"text {i}", 5, None) for i in range(4)], schema)
    chunks.where("chunk_id < 'c2'").coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = jobs.file_stream(spark, str(tmp_path / "in"), chunks)
        jobs.embed_arrivals(stream, str(tmp_path / "out"), str(tmp_path / "cp"), boundary.HashedEmbedder(4)).awaitTermination()
        chunks.where("chunk_id >= 'c1'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.chunk_id for r in got.collect()) == ["c0", "c1", "c2", "c3"]


def test_required_columns(spark):
    with pytest.raises(ValueError):
        incremental.vector_rows(spark.range(1))


def test_every_text_is_embedded_once(spark, tmp_path):
    """Calls are counted in files, since they happen in worker processes."""

    class Counting:
        name = "counting"

        def embed(self, texts):
            import uuid

            (tmp_path / uuid.uuid4().hex).write_text("\n".join(texts))
            if "bad" in texts:
                raise RuntimeError("refused " + "x" * 600)
            return [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([(f"text {k}",) for k in range(47)] + [("bad",)], "text string").coalesce(1)
    misses = texts.withColumn("text_hash", F.md5("text"))
    rows = incremental.cache_rows(misses, Counting()).collect()
    assert len(rows) == 47
    sizes = sorted(len(f.read_text().split("\n")) for f in tmp_path.iterdir())
    assert sizes == [1] * 8 + [8, 20, 20]  # three requests, and the texts of the failed one by one
    error = texts.where("text = 'bad'").select(udfs.embed_column(F.col("text"), Counting()).alias("e")).first().e.error
    assert len(error) > 600


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from tomeweave.session import scratch_root

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(conf={}, sparkContext=context))
