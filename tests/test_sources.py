from __future__ import annotations

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from maskwright import settings
from maskwright.operators import manifest, ranking
from maskwright.sources import directory, media, responses


def test_directory_and_bad_shape(spark, tmp_path):
    people = [{"id": "a", "name": "A", "aliases": ["x"], "references": [{"path": "p.jpg", "source": "s"}]}, {"id": "b", "name": "B"}]
    (tmp_path / "people.json").write_text(json.dumps(people))
    (tmp_path / "bad.json").write_text(json.dumps({"id": "a"}))
    got = directory.read_directory(spark, str(tmp_path / "people.json")).collect()
    assert [(r.person_ord, r.id, r.aliases) for r in got] == [(0, "a", ["x"]), (1, "b", None)]
    with pytest.raises(Exception, match="not an array"):
        directory.read_directory(spark, str(tmp_path / "bad.json")).collect()
    files = spark.createDataFrame([("q.jpg",)], "path string")
    dangling = manifest.dangling_references(directory.read_directory(spark, str(tmp_path / "people.json")), files)
    assert [(r.id, r.path) for r in dangling.collect()] == [("a", "p.jpg")]


def test_gallery_store_revisions(spark, tmp_path):
    folder = str(tmp_path / "store")
    gallery, identity, meta = directory.read_gallery(spark, folder)
    assert (gallery.count(), tuple(meta.first())) == (0, (True, 0))
    for revision in (1, 2):
        rows = spark.createDataFrame([("a", 0, "embedding", revision, [1.0])], directory.GALLERY)
        people = spark.createDataFrame([("a", 0, "A", 0.4, 1)], directory.IDENTITY)
        directory.write_gallery(folder, revision, rows, people, enabled=revision == 1)
    gallery, identity, meta = directory.read_gallery(spark, folder)
    assert (gallery.first().ord, tuple(meta.first())) == (2, (False, 2))
    assert directory.read_gallery(spark, folder, 1)[0].first().ord == 1
    assert directory.redacted_view(meta).columns == ["enabled", "revision"]
    with pytest.raises(ValueError, match="committed already"):
        directory.write_gallery(folder, 2, rows, people, retry=True)
    (tmp_path / "store" / "revision=3").mkdir()
    (tmp_path / "store" / "revision=3" / "_claim").write_bytes(b"")  # another writer, or one that failed
    with pytest.raises(ValueError, match="by another"):
        directory.write_gallery(folder, 3, rows, people)
    assert tuple(directory.read_gallery(spark, folder)[2].first()) == (False, 2)
    directory.write_gallery(folder, 3, rows, people, retry=True)
    assert tuple(directory.read_gallery(spark, folder)[2].first()) == (True, 3)


def test_image_bytes_and_frames(spark, tmp_path):
    for name, data in (("a.jpg", b"xx"), ("b.svg", b"<svg/>"), ("c.png", b"")):
        (tmp_path / name).write_bytes(data)
    good, bad = media.read_image_bytes(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in good.collect()] == ["a.jpg"]
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in bad.collect()} == {("b.svg", "svg-refused")}
    fault = media.image_fault(F.lit(0), F.lit("image/png"))
    assert spark.range(1).select(fault.alias("f")).first().f == "empty"
    rows = [(1, base64.b64encode(b"abc").decode()), (2, ""), (3, None), (4, "!!!"), (5, "A" * (settings.MAX_BASE64_CHARS + 4))]
    got = media.decode_frames(spark.createDataFrame(rows, "i int, payload string")).select("i", "fault", "content").collect()
    assert {r.i: r.fault for r in got} == {1: None, 2: "empty", 3: "empty", 4: "malformed", 5: "too-long"}
    assert bytes(next(r.content for r in got if r.i == 1)) == b"abc"


def test_ledger_fails_closed(spark, tmp_path):
    body = b"content"
    (tmp_path / "ok.json").write_text(json.dumps([{"path": "a", "bytes": 7, "sha256": hashlib.sha256(body).hexdigest(), "shipped": True},
                                                  {"path": "gone", "bytes": 1, "sha256": "0", "shipped": False}]))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "broken.json").write_text("[{")
    ledger = manifest.read_ledger(spark, str(tmp_path / "ok.json"))
    files = spark.createDataFrame([("a", 7, bytearray(body))], "path string, length bigint, content binary")
    assert manifest.reconcile(manifest.hash_files(files), ledger).count() == 0
    for bad in ("empty.json", "broken.json"):
        with pytest.raises(Exception):
            manifest.read_ledger(spark, str(tmp_path / bad)).collect()


def test_responses(spark):
    ency = {"query": {"pages": {"-1": {"title": "Last"}, "12": {"title": "Twelve", "original": {"source": "https://h/t.jpg"},
            "thumbnail": {"source": "https://h/s.jpg"}, "images": [{"title": "File:In.jpg"}, {"title": "Category:x"}]},
            "3": {"title": "Three", "original": {"source": "https://h/3.jpg"}}}}}
    raw = spark.createDataFrame([("n", json.dumps(ency)), ("m", "not json"), ("k", "{}")], "name string, body string")
    got = responses.encyclopedia_candidates(raw).orderBy("ord").collect()
    assert [(r.url, r.filename, r.thumb_url) for r in got] == [
        ("https://h/3.jpg", "Three", None), ("https://h/t.jpg", "Twelve", "https://h/s.jpg"), ("", "In.jpg", None)
    ]
    repo = {"query": {"pages": {"1": {"title": "File:In.jpg", "imageinfo": [{"url": "https://h/in.jpg",
            "extmetadata": {"ImageDescription": {"value": "<b>D</b>" + "x" * 600}, "Categories": {"value": "a|b"}}}]},
            "2": {"title": "File:None.jpg"}}}}
    info = responses.repository_candidates(spark.createDataFrame([("n", json.dumps(repo))], "name string, body string"))
    r = info.first()
    assert (info.count(), r.filename, len(r.caption), r.caption[:3]) == (1, "In.jpg", 500, "D x")
    unresolved = responses.encyclopedia_candidates(raw)
    titles = ranking.resolve_titles(unresolved, info).collect()
    assert [(t.name, t.url, t.page_title) for t in titles] == [("n", "https://h/in.jpg", "n")]
    search = spark.createDataFrame([("n", json.dumps({"search": [{"id": "Q5"}, {"id": "Q6"}]})), ("m", json.dumps({"search": []}))], "name string, body string")
    claim = lambda *v: [{"mainsnak": {"datavalue": {"value": x}}} for x in v]
    entity = {"entities": {"Q5": {"claims": {"P18": claim("A.jpg", "B.jpg"), "P373": claim("Cat", "Cat2")}}, "Q6": {"claims": {}}}}
    images, categories = responses.knowledge_claims(search, spark.createDataFrame([("n", json.dumps(entity))], "name string, body string"))
    assert [r.title for r in images.orderBy("ord").collect()] == ["File:A.jpg", "File:B.jpg"]
    assert [(r.name, r.category) for r in categories.collect()] == [("n", "Cat")]


def test_discovery_and_vectors(spark):
    pages = spark.createDataFrame([(1, "https://s.com/a", '<IMG alt="x" src="i.png"><img data-src="no"><img src=\'j.png?a=1&amp;b\'><img src=k.png><video src="v">')], "page_id int, url string, html string")
    assert [r.media_url for r in media.discover_media(pages).collect()] == [
        "https://s.com/i.png", "https://s.com/j.png?a=1&b", "https://s.com/k.png"
    ]
    assert [r.ref for r in media.discover_media(pages, tag="video").collect()] == ["v"]
    v = media.random_unit_vectors(spark, 20, 4, 7)
    again = media.random_unit_vectors(spark, 20, 4, 7)
    assert sorted(v.collect()) == sorted(again.collect())
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    assert v.where(F.abs(norm - 1) > 1e-5).count() == 0


def test_truncated_directory_and_object_ledgers_fail(spark, tmp_path):
    people = json.dumps([{"id": "a", "name": "A", "aliases": [], "references": []}])
    (tmp_path / "cut.json").write_text(people[:-5])
    with pytest.raises(Exception, match="cut short"):
        directory.read_directory(spark, str(tmp_path / "cut.json")).collect()
    (tmp_path / "ledger.json").write_text(json.dumps({"models": [{"path": "a", "bytes": 1, "sha256": "x", "shipped": True}]}))
    with pytest.raises(Exception, match="malformed"):
        manifest.read_ledger(spark, str(tmp_path / "ledger.json")).collect()
    rows = manifest.read_ledger(spark, str(tmp_path / "ledger.json"), root="models").collect()
    assert [(r.path, r.bytes, r.shipped) for r in rows] == [("a", 1, True)]
    (tmp_path / "pathless.json").write_text(json.dumps({"models": [{"bytes": 1}]}))
    with pytest.raises(Exception, match="malformed"):
        manifest.read_ledger(spark, str(tmp_path / "pathless.json"), root="models").collect()


def test_only_string_claims_name_files(spark):
    claim = lambda v: {"mainsnak": {"datavalue": {"value": v}}}
    entity = {"entities": {"Q1": {"claims": {"P18": [claim({"id": "Q5"}), claim(7), claim("x.jpg"), {}, claim(None)], "P373": [claim(3), claim("Cat")]}}}}
    search = spark.createDataFrame([("n", json.dumps({"search": [{"id": "Q1"}]}))], "name string, body string")
    images, categories = responses.knowledge_claims(search, spark.createDataFrame([("n", json.dumps(entity))], "name string, body string"))
    assert [(r.ord, r.title) for r in images.collect()] == [(0, "File:x.jpg")]
    assert [r.category for r in categories.collect()] == ["Cat"]
