from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.operators import gallery, ranking


def values(spark, build, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_names_and_ids(spark):
    assert values(spark, text.normalize_name, [" A  B\t", "﻿É x"]) == ["a b", "é x"]

    def model(name):
        h = 0
        for ch in name:
            h = (h * 31 + ord(ch)) % 2**32
        digits = ""
        while h:
            h, r = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
        return "person-" + (digits or "0")

    odd = ["李小龙", "😀 😀", "!!", "", " 山田 太郎 山田 太郎"]
    assert values(spark, text.identity_id, ["Mara  Quill", "-J. Doe-"] + odd) == [
        "mara-quill", "j-doe"
    ] + [model(n) for n in odd]


def test_an_id_beside_a_new_name_is_that_of_the_old_one(spark):
    named = spark.createDataFrame([("Ç Ç ",)], "name string")
    both = named.select(text.normalize_name(F.col("name")).alias("name"), text.identity_id(F.col("name")).alias("id"))
    assert [r.id for r in both.collect()] == values(spark, text.identity_id, ["Ç Ç "])


def test_urls(spark):
    urls = [
        "https://A.b:443/x/../y/./z.JPG?q=1#f", "http://u:p@h.c:8080", "nonsense", "https://h/a.b/c",
        "https://h/p.jpeg", "http://h/p.jpeg",
    ]
    assert values(spark, text.url_key, urls) == [
        "https://a.b/y/z.JPG", "http://h.c:8080/", "nonsense", "https://h/a.b/c", "https://h/p.jpeg", "http://h/p.jpeg"
    ]
    assert values(spark, text.url_extension, urls) == ["jpg", "", "", "b/c", "jpeg", "jpeg"]
    assert values(spark, text.is_usable_photo, urls) == [True, False, False, False, True, False]
    base = F.lit("https://s.com/d/p.html?x#y")
    refs = ["", "q.png", "/r.png", "//o.org/i.png", "?z", "#k", "data:abc", "http://e.f/g"]
    assert values(spark, lambda r: text.resolve_url(base, r), refs) == [
        "", "https://s.com/d/q.png", "https://s.com/r.png", "https://o.org/i.png", "https://s.com/d/p.html?z",
        "https://s.com/d/p.html?x#k", "data:abc", "http://e.f/g",
    ]


def test_text_pieces(spark):
    assert values(spark, text.normalize_text, ["Mara_King-(Quill).JPG", "Ünï + x"]) == ["mara king quill jpg", "n x"]
    assert values(spark, text.strip_initials, ["a b cc d", "tovi j brandt", "7 x y2"]) == ["cc", "tovi brandt", "7 y2"]
    assert values(spark, text.strip_html, ["<b>a</b>&amp;b &#39;", "x<br/>y"]) == ["a b &#39;", "x y"]
    assert values(spark, text.file_title_to_name, ["file:A.jpg ", "xFile:a"]) == ["A.jpg", "xFile:a"]
    term = lambda t: lambda h: text.has_term(h, F.lit(t))
    assert values(spark, term("map"), ["a map b", "mapper map", "map", "roadmap", ""]) == [True, False, True, False, False]
    df = spark.createDataFrame([("<i>d</i>", "a|b"), (None, "c"), ("", None)], "d string, c string")
    assert [r[0] for r in df.select(text.build_caption(F.col("d"), F.col("c"))).collect()] == ["d a b", "c", ""]


def score(spark, name, filename, caption="", aliases=(), rules=ranking.Rules()):
    df = spark.createDataFrame([(name, filename, caption)], "name string, filename string, caption string")
    al = spark.createDataFrame([(name, list(aliases))], "name string, aliases array<string>")
    return round(ranking.score_candidates(df, al, rules).first().score, 9)


@pytest.mark.parametrize(
    "filename, caption, aliases, want",
    [
        ("Mara_Quill.jpg", "", (), 0.9),
        ("Mara_K._Quill_portrait.jpg", "", (), 0.95),
        ("x.jpg", "Mara Quill", (), 0.75),
        ("Quill, Mara.jpg", "", (), 0.15),
        ("Quill.jpg", "", (), 0.05),
        ("x.jpg", "the countess of l", ("Countess",), 0.1),
        ("x.jpg", "the co", ("Co",), 0.0),
        ("Mara_Quill.jpg", "signature", (), 0.09),
        ("Mara_Quill.jpg", "look-alike", (), 0.045),
        ("Mara_Quill.jpg", "AI-generated", (), 0.045),
        ("Mara_Quill.jpg", "with wife", (), 0.54),
        ("Mara_Quill.jpg", "her and wife", (), 0.9),
        ("Mara Quill III.jpg", "", (), 0.09),
        ("Mara Quill and Orsk.jpg", "", (), 0.45),
        ("Orsk with Mara Quill.jpg", "", (), 0.45),
        ("Maraquill mara quillxyz.jpg", "", (), 0.9),
        ("", "", (), 0.0),
    ],
)
def test_scores(spark, filename, caption, aliases, want):
    assert score(spark, "Mara Quill", filename, caption, aliases) == pytest.approx(want)


def test_rank_drops_copies_before_the_floor(spark):
    rows = [
        ("nn mm", 0, 0, "https://h/a.jpg?1", "zz", ""), ("nn mm", 1, 0, "https://h/a.jpg?2", "nn mm", ""),
        ("nn mm", 1, 1, "https://h/b.jpg", "nn mm", ""), ("nn mm", 0, 5, "https://h/c.png", "nn mm", ""),
        ("nn mm", 2, 0, "http://h/d.jpg", "nn mm", ""), ("nn mm", 2, 1, "https://h/e.svg", "nn mm", ""),
    ]
    df = spark.createDataFrame(rows, "name string, source_ord int, ord int, url string, filename string, caption string")
    ranked = ranking.rank_candidates(df).orderBy("rank").collect()
    assert [(r["rank"], r.url) for r in ranked] == [(1, "https://h/c.png"), (2, "https://h/b.jpg")]
    assert ranking.rank_candidates(df, limit=1).count() == 1
    open_floor = ranking.rank_candidates(df, floor=0.0).count()
    assert open_floor == 3


def test_people_and_targets(spark):
    people = spark.createDataFrame(
        [(0, "p0", "Ann Lee", ["al", None]), (1, "p1", "AL", None)], "person_ord int, id string, name string, aliases array<string>"
    )
    req = spark.createDataFrame([("  AL ",), ("ann  lee",), ("zed",)], "name string")
    assert {r.name: r.person_id for r in gallery.find_people(req, people).collect()} == {
        "  AL ": "p0", "ann  lee": "p0", "zed": None
    }
    ids = spark.createDataFrame([("ann-lee", 0, "Other"), ("z", 1, "Bo  B")], "identity_id string, identity_ord int, name string")
    requests = spark.createDataFrame(
        [(1, "Ann Lee", "z", None), (2, "Ann Lee", "gone", "z"), (3, "Ann Lee", "", "z"), (4, "Ann Lee", None, "no"),
         (5, "bo b", None, None), (6, "new", None, None)],
        "request_id int, name string, explicit_id string, canonical_id string",
    )
    got = {r.request_id: (r.identity_id, r.error) for r in gallery.choose_target(requests, ids).collect()}
    assert got == {
        1: ("z", None), 2: (None, "no such identity"), 3: ("z", None), 4: ("ann-lee", None), 5: ("z", None), 6: (None, None)
    }


def test_a_crowded_title_is_dealt_out(spark):
    names = [(f"n{i}", "a.jpg" if i < 60 else f"{i}.jpg", i, "") for i in range(80)]
    files = [("x", "a.jpg" if i < 70 else f"{i}.jpg", i, f"u{i % 50}", "p") for i in range(90)]
    unresolved = spark.createDataFrame([*names, ("none", None, 99, "")], "name string, filename string, ord int, url string")
    info = spark.createDataFrame(files, "name string, filename string, ord int, url string, page_title string")
    found = ranking.resolve_titles(unresolved, info, meet_rows=16, meet_pairs=100)
    got = sorted((r.name, r.filename, r.ord, r.url, r.page_title) for r in found.collect())
    assert got == sorted((n, f, o, u, n) for n, f, o, _ in names for _, g, _, u, _ in files if f == g)
    places = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in places) < len(got) / 4

    kinds = names[:3], files[:5]
    expanded = ranking.expand_categories(
        spark.createDataFrame([(n, "c") for n, *_ in kinds[0]], "name string, category string"),
        spark.createDataFrame([("c", f"u{i}") for i in range(5)], "category string, url string"), meet_rows=2, meet_pairs=4,
    )
    assert sorted(map(tuple, expanded.collect())) == sorted((n, f"u{i}") for n, *_ in kinds[0] for i in range(5))


def test_lookups_spread_requests_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(gallery, "LOOKUP_ROWS", 20)
    rows = [(i, f"n{i % 7}", "i3" if i % 10 == 0 else "", None) for i in range(300)] + [(300, None, "i9", ""), (301, "x", None, "i1")]
    requests = spark.createDataFrame(rows, "request_id long, name string, explicit_id string, canonical_id string")
    identities = spark.createDataFrame([(f"i{i}", i, f"N{i}") for i in range(5)], "identity_id string, identity_ord int, name string")
    found = gallery.choose_target(requests, identities)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 4
    got = {r.request_id: (r.identity_id, r.error) for r in found.collect()}
    want = {
        i: ("i3", None) if i % 10 == 0 else (f"i{i % 7}" if i % 7 < 5 else None, None) for i in range(300)
    } | {300: (None, "no such identity"), 301: ("i1", None)}
    assert got == want
