import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tomeweave.sources import files
from tomeweave.sources.named_files import write_files


def book(*pages):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, html in pages:
            archive.writestr(name, html)
    return out.getvalue()


def test_files_appear_all_or_none(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"f{k}.bin", bytes([k])) for k in range(20)] + [("empty", None)], "name string, content binary").repartition(4)
    write_files(rows, folder)
    assert sorted(os.listdir(folder)) == sorted(["_SUCCESS", "empty", *[f"f{k}.bin" for k in range(20)]])
    assert open(f"{folder}/f7.bin", "rb").read() == b"\x07"
    write_files(rows.where("name = 'f7.bin'").withColumn("content", F.lit(b"new")), folder)
    assert open(f"{folder}/f7.bin", "rb").read() == b"new" and len(os.listdir(folder)) == 22
    bad = str(tmp_path / "bad")
    for names in (["a", "../b"], ["a", "a"], ["a", None]):
        with pytest.raises(Exception, match="name"):
            write_files(spark.createDataFrame([(n, b"x") for n in names], "name string, content binary").repartition(2), bad)
        assert not os.path.exists(bad) or not [f for f in os.listdir(bad) if not f.startswith(".staging")]


def test_one_level_is_listed_and_no_other(spark, tmp_path):
    for place in ("top.epub", "one/a.epub", "one/b.epub", "one/c.txt", "two/d.epub", "two/deep/e.epub"):
        path = tmp_path / place
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(book(("p.html", "<p>x</p>")))
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())
    assert names(files.book_listing(spark, str(tmp_path))) == ["top.epub"]
    assert names(files.book_listing(spark, str(tmp_path), nested=True)) == ["a.epub", "b.epub", "d.epub"]
    assert files.book_listing(spark, str(tmp_path / "none")).count() == 0 and files.book_listing(spark, str(tmp_path / "one/c.txt")).count() == 0
    found = files.books(files.book_listing(spark, str(tmp_path), nested=True), nested=True)
    assert sorted(r.book_name for r in found.collect()) == ["one_a.epub", "one_b.epub", "two_d.epub"]


def test_entries_and_rejects(spark, tmp_path):
    whole = book(("b.xhtml", "<p>second é</p>"), ("a.xhtml", "<p>first</p><script>x</script>"), ("note.txt", "no page"))
    broken = bytearray(whole)
    at = whole.index(b"second")
    broken[at : at + 6] = b"SECOND"  # the checksum of one entry no longer fits
    for name, content in (("good", whole), ("half", bytes(broken)), ("none", b"not a zip")):
        (tmp_path / f"{name}.epub").write_bytes(content)
    entries = files.book_entries(files.book_listing(spark, str(tmp_path))).cache()
    texts = {(r.path.rsplit("/", 1)[1], r["at"]): (r.entry, r.text) for r in files.entry_texts(entries).collect()}
    assert texts == {("good.epub", 0): ("b.xhtml", "second é"), ("good.epub", 1): ("a.xhtml", "first"), ("half.epub", 1): ("a.xhtml", "first")}
    lost = {(r.path.rsplit("/", 1)[1], r.entry) for r in files.rejected(entries).collect()}
    assert lost == {("half.epub", "b.xhtml"), ("none.epub", None)}
    together = {r.book_name: r.text for r in files.books(files.book_listing(spark, str(tmp_path))).collect()}
    assert together["good"] == "second é\n\nfirst" and together["none"] is None


def test_section_files_round_trip(spark, tmp_path):
    folder = str(tmp_path / "sections")
    sections = spark.createDataFrame(
        [("s_section_01", "s", "one\n\ntwo é", 3, 10, ["a", "b"]), ("s_section_02", "s", " \n", 1, 2, ["c"]), ("s_section_03", "s", "three", 2, 5, ["d"])],
        "chunk_id string, series string, text_content string, token_count bigint, character_count bigint, included_books array<string>",
    )
    files.write_section_files(sections, folder, 1000, 0.1)
    assert sorted(os.listdir(folder)) == ["_SUCCESS", "s_section_01.meta.json", "s_section_01.txt", "s_section_03.meta.json", "s_section_03.txt"]
    assert json.load(open(f"{folder}/s_section_01.meta.json"))["context_window_used"] == 1000
    got = {r.chunk_id: (r.text_content, r.token_count, list(r.included_books or []), r.safety_margin, r.status) for r in files.section_files(spark, folder, "s").collect()}
    assert got == {"s_section_01": ("one\n\ntwo é", 3, ["a", "b"], 0.1, "ok"), "s_section_03": ("three", 2, ["d"], 0.1, "ok")}
    os.remove(f"{folder}/s_section_03.meta.json")
    open(f"{folder}/s_section_01.txt", "w").write("changed")
    for name in (".s_section_01.txt.crc", ".s_section_03.meta.json.crc"):
        assert not os.path.exists(f"{folder}/{name}")
    assert {r.chunk_id: r.status for r in files.section_files(spark, folder, "s").collect()} == {"s_section_01": "texts differ", "s_section_03": "no metadata file"}
