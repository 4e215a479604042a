"""Benchmark decontamination with a generalised suffix automaton of the test items.

Benchmark items and documents are lower-cased (A-Z) and split into words. The automaton
holds every run of words of every item; a document is streamed through it while the
longest suffix that is such a run is tracked. A match of ``window`` words or more covers
document words; an item of fewer words must match as a whole.

Items are cut into overlapping pieces and dealt into shards of at most about
``shard_words`` words, so what is shipped to the executors is bounded; each shard is one
pass over the documents and the covered spans of all passes are merged per document.

Stretches that cannot hold a window (a word, or two words in a row, that no item has)
are skipped by array look-ups; only the remaining stretches are streamed.

Defined cases: a null or empty text has no words and no hits; an item without words
never occurs; an item with a null id covers words but is not listed; rows of one item_id
are one item; repeated document rows are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.lineage import cut
from maskwright.llm import textbytes as tb

WINDOW = 10
SHARD_WORDS = 100_000
PIECE_WORDS = 5_000


class Automaton:
    """Suffix automaton over words of several items; state 0 is the root."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set] = {}          # window state -> items with that window
        self.short: dict[int, list] = {}         # state -> (words, item) of whole short items
        self.shortest = window
        self.vocabulary: set[bytes] = set()
        self.follows: set[tuple[bytes, bytes]] = set()

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        state = self._add(length[last] + 1)
        walk = last
        while walk != -1 and word not in nxt[walk]:
            nxt[walk][word] = state
            walk = link[walk]
        if walk == -1:
            link[state] = 0
        else:
            other = nxt[walk][word]
            link[state] = other if length[walk] + 1 == length[other] else self._split(walk, word, other)
        return state

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, walk: int, word: bytes, other: int) -> int:
        """A copy of ``other`` for the shorter runs that also occur after ``walk``."""
        clone = self._add(self.length[walk] + 1)
        self.next[clone] = dict(self.next[other])
        self.link[clone], self.link[other] = self.link[other], clone
        while walk != -1 and self.next[walk].get(word) == other:
            self.next[walk][word] = clone
            walk = self.link[walk]
        return clone

    def add(self, item: str | None, words: list[bytes]) -> None:
        state = 0
        for word in words:
            state = self._extend(state, word)
        self.vocabulary.update(words)
        self.follows.update(zip(words, words[1:]))
        self.shortest = min(self.shortest, len(words))

    def finish(self, items: list[tuple[str | None, list[bytes]]]) -> Automaton:
        """Say which items each window or short item stands for, once all are in."""
        for item, words in items:
            if len(words) < self.window:
                state = 0
                for word in words:
                    state = self.next[state][word]
                self.short.setdefault(state, []).append((len(words), item))
            else:
                for at, state, _ in self.stream(words):
                    if at + 1 >= self.window:
                        self.items.setdefault(self.holding(state, self.window), set()).add(item)
        return self

    def holding(self, state: int, length: int) -> int:
        """The suffix of ``state``'s run that has ``length`` words, as a state."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length of the longest match that ends there)."""
        state = matched = 0
        for at, word in enumerate(words):
            while word not in self.next[state] and state:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            yield at, state, matched

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Covered (start, end) stretches of ``words``, unmerged, and the items found."""
        spans, found = [], set()
        for at, state, matched in self.stream(words):
            if matched >= self.window:
                spans.append((at + 1 - matched, at + 1))
                found |= self.items.get(self.holding(state, self.window), set())
            if matched >= self.shortest and self.short:
                up = state
                while up > 0:
                    for length, item in self.short.get(up, ()):
                        if length <= matched:
                            spans.append((at + 1 - length, at + 1))
                            found.add(item)
                    up = self.link[up]
        return spans, found


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    data = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    return tb.span_hashes(tb.prefix_sums(data), starts, ends)


class Matcher:
    """The automaton with the look-up arrays that decide what is streamed through it."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.vocabulary = np.sort(_word_hashes(sorted(automaton.vocabulary)))
        pairs = sorted(automaton.follows)
        self.pairs = np.sort(tb.chain(_word_hashes([a for a, _ in pairs]), _word_hashes([b for _, b in pairs])))

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, list, set, np.ndarray, np.ndarray]]:
        """Per text: words, merged spans in words, items, and each word's byte bounds."""
        data, bounds = tb.flatten(texts)
        data = tb.LOWER[data]
        starts, ends, firsts = tb.words(data, bounds, tb.ALPHANUMERIC)
        found: dict[int, tuple[list, set]] = {}
        if len(starts):
            hashes = tb.span_hashes(tb.prefix_sums(data), starts, ends)
            known = _member(self.vocabulary, hashes)
            linked = np.zeros(len(starts), dtype=bool)  # goes on from the word before
            linked[1:] = known[1:] & known[:-1]
            linked[firsts[(firsts > 0) & (firsts < len(starts))]] = False
            both = np.flatnonzero(linked)
            linked[both] = _member(self.pairs, tb.chain(hashes[both - 1], hashes[both]))
            heads = np.flatnonzero(known & ~linked)
            run = np.cumsum(known & ~linked)[known]
            sizes = np.bincount(run - 1, minlength=len(heads)) if len(heads) else np.zeros(0, int)
            keep = sizes >= self.automaton.shortest
            rows = np.searchsorted(firsts, heads[keep], side="right") - 1
            for row, head, size in zip(rows.tolist(), heads[keep].tolist(), sizes[keep].tolist()):
                stretch = [data[a:b].tobytes() for a, b in zip(starts[head : head + size], ends[head : head + size])]
                spans, items = self.automaton.hits(stretch)
                if spans:
                    held = found.setdefault(row, ([], set()))
                    base = head - int(firsts[row])
                    held[0].extend((a + base, b + base) for a, b in spans)
                    held[1].update(items)
        for row in range(len(bounds) - 1):
            spans, items = found.get(row, ([], set()))
            inner = slice(firsts[row], firsts[row + 1])
            yield int(firsts[row + 1] - firsts[row]), merge(spans), items, starts[inner] - bounds[row], ends[inner] - bounds[row]


def _member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _words_of(text: bytes) -> list[bytes]:
    data = tb.LOWER[np.frombuffer(text, dtype=np.uint8)]
    starts, ends, _ = tb.words(data, np.array([0, len(data)]), tb.ALPHANUMERIC)
    return [data[a:b].tobytes() for a, b in zip(starts, ends)]


def _pieces(window: int, size: int):
    """Items as pieces of at most ``size`` words that share ``window - 1`` words, so that
    every window lies in a piece."""

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words_of(text.encode()) if text else []
                step = max(1, size - window + 1)
                for at in range(0, max(len(words) - window + 1, 1) if words else 0, step):
                    piece = words[at : at + size]
                    out.append({"item_id": item, "words": b" ".join(piece), "n": len(piece)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("item_id", pa.string()), ("words", pa.binary()), ("n", pa.int64())]
            ))

    return run


def _matchers(benchmark: DataFrame, window: int, shard_words: int, piece_words: int) -> Iterator[Matcher]:
    """One matcher per shard; only one shard is on the driver at a time."""
    pieces = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(
        _pieces(window, max(piece_words, window)), "item_id string, words binary, n long"
    )
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = -(-total // shard_words)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(max(shards, 1))))
    dealt = cut(dealt) if shards > 1 else dealt
    for shard in range(shards):
        rows = dealt.where(F.col("shard") == shard).select("item_id", "words").collect()
        items = sorted(((r.item_id, bytes(r.words).split(b" ")) for r in rows), key=lambda x: (x[0] or "", x[1]))
        if items:
            automaton = Automaton(window)
            for item, words in items:
                automaton.add(item, words)
            yield Matcher(automaton.finish(items))


SPANS = "n_words long, spans array<struct<start: int, end: int>>, items array<string>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """Per row of ``docs``: all its columns, ``n_words``, the merged covered ``spans`` (in
    words) and the sorted ``items`` found. One shard is one map over the rows."""
    matchers = _matchers(benchmark, window, shard_words, piece_words)
    first = next(matchers, None)
    if first is None:
        first = Matcher(Automaton(window))
    second = next(matchers, None)
    if second is None:
        return _one_pass(docs, first)
    keyed = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    slim = keyed.select("__row", "text")
    found = None
    for matcher in _chain(first, second, matchers):
        part = cut(_one_pass(slim, matcher).drop("text"))
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("__row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).select(
        "__row", "n_words",
        F.expr(
            "aggregate(s, cast(array() as array<struct<start: int, end: int>>), (acc, x) ->"
            " if(size(acc) > 0 and x.start <= element_at(acc, -1).end,"
            " concat(slice(acc, 1, size(acc) - 1), array(named_struct('start',"
            " element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))),"
            " concat(acc, array(x))))"
        ).alias("spans"),
        "items",
    )
    return keyed.join(merged, "__row").drop("__row")


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def _one_pass(docs: DataFrame, matcher: Matcher) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(matcher)
    kept = docs.drop("n_words", "spans", "items")
    schema = tb.schema(kept.schema.fields, SPANS)

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                counts, spans, items = [], [], []
                for n, own, found, _, _ in held.value.texts(part.column("text")):
                    counts.append(n)
                    spans.append([{"start": a, "end": b} for a, b in own])
                    items.append(sorted(x for x in found if x is not None))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(counts, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))],
                    names=[*part.schema.names, "n_words", "spans", "items"],
                )

    return kept.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_span: int = WINDOW,
    max_coverage: float = 0.5,
    **limits,
) -> DataFrame:
    """``docs`` without what they share with the benchmark.

    Covered spans of ``min_span`` words or more are cut out of the text, with what lies
    between their words; a document of which a larger share than ``max_coverage`` of the
    words is covered is dropped whole. Other texts come back unchanged, byte for byte.
    """
    hits = find_hits(tb.pack(docs), benchmark, window, **limits)
    covered = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")
    kept = hits.where((covered == 0) | (covered <= F.col("n_words") * F.lit(float(max_coverage))))
    spans = F.expr(f"filter(spans, x -> x.end - x.start >= {int(min_span)})")
    replaced = {}
    if max_coverage > 0:
        hit = F.size(spans) > 0
        kept = kept.withColumn("text", F.when(hit, _without("text", spans)).otherwise(F.col("text")))
        if "n_chars" in docs.columns:
            count = F.length("text").cast(docs.schema["n_chars"].dataType)
            replaced["n_chars"] = F.when(hit, count).otherwise(F.col("__rest.n_chars"))
    return tb.unpack(kept, docs.columns, **replaced)


def _without(text: str, spans) -> F.Column:
    @F.pandas_udf("string")
    def cut_words(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for value, own in zip(texts, all_spans):
            if value is None or not len(own):
                out.append(value)
                continue
            raw = value.encode()
            data = np.frombuffer(raw, dtype=np.uint8)
            starts, ends, _ = tb.words(data, np.array([0, len(data)]), tb.ALPHANUMERIC)
            parts, at = [], 0
            for span in own:
                parts.append(raw[at : starts[span["start"]]])
                at = int(ends[span["end"] - 1])
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pd.Series(out)

    return cut_words(F.col(text), spans)


def report(hits: DataFrame) -> DataFrame:
    """The contract's columns of ``find_hits``."""
    ids = F.array_join("items", ",")
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
