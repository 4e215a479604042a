from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

from maskwright.llm import paragraph_dedup as pdup
from maskwright.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(docs, min_words):
    found = []
    for doc, text in docs:
        for line, value in enumerate((text or "").split("\n")):
            words = WORDS.findall(value.translate(LOWER))
            if len(words) >= min_words and words:
                found.append(((doc, line), len(words), {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}))
    root = list(range(len(found)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = defaultdict(list)
    for k, (_, _, shingles) in enumerate(found):
        common = defaultdict(int)
        for s in shingles:
            for j in holders[s]:
                common[j] += 1
            holders[s].append(k)
        for j, n in common.items():
            if n >= 0.8 * (len(shingles) + len(found[j][2]) - n):
                a, b = top(k), top(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for k in range(len(found)):
        groups[top(k)].append(k)
    out = set()
    for members in groups.values():
        if len(members) > 1:
            keep = min(found[k][0] for k in members)
            out |= {(*found[k][0], found[k][1], *keep, found[k][0] != keep) for k in members}
    return out


def test_tuning_reaches_the_recall():
    bands, rows = pdup.tune(0.8, 0.999, 40)
    assert bands * rows <= 40 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    expected = brute_force(docs.collect(), 20)
    assert {tuple(r) for r in pdup.find_repeats(docs).collect()} == expected
    some = docs.where("doc_id < 300")
    for size in (1, 4):
        assert {tuple(r) for r in pdup.find_repeats(some, min_words=4, group_rows=size * 2).collect()} == brute_force(some.collect(), 4)


def test_large_groups_are_cut_into_chunks():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 100 - k], rng.integers(0, 1 << 60, k).astype(np.uint64)))) for k in (0, 3, 6, 60)]
    assert pdup.similar_sets(sets, 0.8).tolist() == [0, 0, 0, 3]


def test_rows_dealt_for_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Variants of one line, most of them too far apart to be linked, that share band keys."""
    rng = np.random.default_rng(5)
    core = [f"c{k}" for k in range(24)]
    extra = lambda n: [f"u{k}" for k in rng.integers(0, 1 << 40, n)]
    rows = [(k, " ".join(core + extra(int(rng.integers(0, 12))))) for k in range(800)]
    dealt, compare = [], pdup._compare

    def counted(members, *rest):
        dealt[-1] += members.count()
        return compare(members, *rest)

    monkeypatch.setattr(pdup, "_compare", counted)
    for n in (400, 800):
        dealt.append(0)
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        assert {tuple(r) for r in pdup.find_repeats(docs, group_rows=16).collect()} == brute_force(rows[:n], 20)
    assert dealt[1] < 3 * dealt[0] and dealt[1] < 40 * 800, dealt


def test_rare_shingles_are_told_without_a_row_for_every_shingle(spark, monkeypatch):
    """Linked sets share a kept shingle within reach, also if many shingles share a slot."""
    rng = np.random.default_rng(6)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    sets = [np.unique(np.concatenate((rng.permutation(base)[: rng.integers(30, 61)], rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, 9))))).view(np.uint64)) for _ in range(150)]
    df = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "id long, shingles binary")
    linked = [(a, b) for b in range(150) for a in range(b) if (n := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(linked) > 100
    for most in (pdup.MAX_SLOTS, pdup.SLOT_RANGES):
        monkeypatch.setattr(pdup, "MAX_SLOTS", most)
        made = pdup._rare_first(df, 0.8)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
        keys = defaultdict(dict)
        for r in made.collect():
            assert r.size == len(sets[r.id]) and r.key in sets[r.id].view(np.int64)
            keys[r.id][r.key] = r.reach
        assert all(len(own) <= 0.2 * len(sets[k]) + 1 for k, own in keys.items())
        for a, b in linked:
            shared = keys[a].keys() & keys[b].keys()
            assert any(keys[a][s] >= len(sets[b]) and keys[b][s] >= len(sets[a]) for s in shared)


def test_odd_rows(spark):
    line = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (None, line, "x"), (3, line, None), (4, "short\n" + line.upper(), "y"), (5, "q " * 60_000, "y")],
        "doc_id long, text string, line string",
    )
    assert {tuple(r) for r in pdup.find_repeats(docs).collect()} == {(3, 0, 30, 3, 0, False), (4, 1, 30, 3, 0, True)}
    assert pdup.find_repeats(docs.limit(0)).count() == 0


def test_query_finds_repeats_inside_lines_and_across_short_ones(spark, tmp_path):
    rng = np.random.default_rng(1)
    fill = lambda n: [f"u{k}" for k in rng.integers(0, 1 << 40, n)]
    passage, short = fill(120), fill(7)
    broken = "\n".join(" ".join(passage[k : k + 4]) for k in range(0, 120, 4))
    rows = [
        (1, " ".join(fill(90) + passage + fill(70))), (2, " ".join(fill(33)) + "\n" + broken + "\n" + " ".join(fill(40))),
        (3, " ".join(fill(150))), (4, " ".join(short) + "\n" + " ".join(fill(60))), (5, " ".join(fill(50)) + "\n" + " ".join(short)),
        (6, "q " * 60_000), (7, None), (None, " ".join(passage)),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op6_paragraph_dedup(spark, str(tmp_path)).collect()
    removed = [r for r in found if r.removed]
    pieces = [r for r in removed if r.unit == "piece" and r.doc_id == 2]
    assert sum(r.n_words for r in pieces) >= 50 and {r.keep_doc_id for r in pieces} == {1}
    assert {(r.doc_id, r.line, r.keep_doc_id, r.keep_line) for r in removed if r.unit == "line"} == {(5, 1, 4, 0)}
    assert {r.doc_id for r in found if r.unit == "piece"} == {1, 2, 6}


def test_pieces_cover_all_words_once():
    hashes = np.random.default_rng(2).integers(0, 1 << 62, 3000).astype(np.uint64)
    for text in (hashes, hashes[:12], hashes[:3], hashes[:0], np.repeat(hashes[:1], 333)):
        sizes = np.diff(np.append(pdup.piece_starts(text, 5), len(text)))
        assert sizes.sum() == len(text) and (sizes <= 50).all() and (len(text) < 5 or (sizes >= 5).all())


def test_recall_of_passages_inside_lines_and_across_them(spark):
    """Passages of 51 to 150 words, each planted in two documents: in the middle of a long
    line, or across lines of some words. One is found if a piece of it is removed."""
    rng = np.random.default_rng(11)
    fill = lambda n: [f"u{k}" for k in rng.integers(0, 1 << 40, n)]
    rows, sizes = [], {}
    for k in range(400):
        passage = fill(int(rng.integers(51, 151)))
        sizes[k] = len(passage)
        width = int(rng.integers(3, 15))
        lines = "\n".join(" ".join(passage[i : i + width]) for i in range(0, len(passage), width))
        shapes = [" ".join(passage), lines if k % 2 else " ".join(passage)]
        for n, text in enumerate(shapes):
            rows.append((2 * k + n, f"{' '.join(fill(int(rng.integers(20, 200))))} {text} {' '.join(fill(int(rng.integers(20, 200))))}"))
    found = pdup.find_pieces(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect()
    assert all(r.keep_doc_id == r.doc_id - 1 for r in found)
    caught = {r.doc_id // 2 for r in found}
    by_layout = [np.mean([k in caught for k in sizes if k % 2 == odd]) for odd in (0, 1)]
    assert min(by_layout) >= 0.9, by_layout
