"""Repeated byte strings by bucket-pointer refinement of suffix buckets.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a
document of smaller id, or before in the same one.

Spreading the work. Every window of ``length`` bytes is keyed by its least-hashed
``gram`` (leftmost of equals), so equal windows share a key wherever they lie. Neighbouring
windows of one anchor make one fragment. Fragments meet by key: of equal fragments the
earliest stays and the others are covered whole, without shipping any text; a key left
with one fragment is done. Only fragments with rivals fetch their bytes.

Refining. A task sorts the suffixes of its fragments to depth ``length``: buckets of equal
8-byte prefixes, then refined by the bucket pointers of the suffix that many bytes later,
doubling the depth; refined pointers are written back and reused, and buckets of one drop
out. The windows of a bucket are equal strings, of which the first stays.

Up to ``ship_docs`` ids of documents with rival fragments are shipped so that
other texts stay where they are.

A key with more than ``hot_rows`` distinct fragments skips the task: its windows are keyed
by their own hash, which a map-side combined minimum and a join settle in parts.

Defined cases: a null text is empty; texts below ``length`` bytes stay whole; rows of one
id and one text are one document. Rows without an id, which come after all others, and
rows that share an id but not the text are told apart by ``tag``, a hash of the text, in
whose order they come. Anchors, equal fragments and tags are 64 bits of hash each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.lineage import cut
from maskwright.llm import textbytes as tb

LENGTH = 100
GRAM = 24
HOT_ROWS = 20_000
SHIP_DOCS = 2_000_000
CHUNK_BYTES = 1 << 20

_NO_ID = (1 << 63) - 1


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every stretch of ``width`` values."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def fragments_of(texts: pa.Array, length: int, gram: int):
    """Row, start and number of windows, anchor hash and content hash of every fragment."""
    data, bounds = tb.flatten(texts)
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = tb.prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = tb.span_hashes(sums, at, at + gram)
    low = np.uint64(max(1, int(len(data)).bit_length()))
    placed = ((hashes >> low) << low) | at.astype(np.uint64)
    place = (_least(placed, length - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(place), dtype=bool)  # windows that do not cross texts
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= length:
            inside[a : b - length + 1] = True
    head = inside.copy()
    head[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(head)
    after = np.append(starts[1:], len(place))
    counted = np.concatenate(([0], np.cumsum(inside)))
    windows = counted[after] - counted[starts]
    rows = np.searchsorted(bounds, starts, side="right") - 1
    content = tb.span_hashes(sums, starts, starts + windows + length - 1)
    return rows, starts - bounds[rows], windows, hashes[place[starts]], content


def _fragments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Fragments, and (``gone``) the stretches that repeat an earlier fragment of the same
    block, merged; so text that repeats itself adds few rows to a key."""

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                rows, starts, windows, keys, content = fragments_of(part.column("text"), length, gram)
                doc, tag = (part.column(c).to_numpy()[rows] for c in ("doc", "tag"))
                order = np.lexsort((starts, tag, doc, content, keys))
                doc, tag, starts, windows = doc[order], tag[order], starts[order], windows[order]
                keys, content = keys[order].view(np.int64), content[order].view(np.int64)
                again = np.zeros(len(keys), dtype=bool)
                again[1:] = (keys[1:] == keys[:-1]) & (content[1:] == content[:-1])
                owner = np.maximum.accumulate(np.where(again, 0, np.arange(len(keys))))
                # not a repeated row
                later = again & ((doc != doc[owner]) | (tag != tag[owner]) | (starts != starts[owner]))
                spans = _merged(doc[later], tag[later], starts[later], starts[later] + windows[later])
                n = len(spans)
                names = ["key", "content", "doc", "tag", "start", "windows", "gone"]
                columns = [
                    (keys, (spans[:, 0] ^ spans[:, 1]) * 31 + spans[:, 2], np.int64), (content, spans[:, 2], np.int64),
                    (doc, spans[:, 0], np.int64), (tag, spans[:, 1], np.int64), (starts, spans[:, 2], np.int32),
                    (windows, spans[:, 3] - spans[:, 2], np.int32), (again[~again], np.ones(n, bool), bool),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((a if name == "gone" else a[~again], b)).astype(kind))
                     for name, (a, b, kind) in zip(names, columns)],
                    names=names,
                )

    return docs.mapInArrow(run, "key long, content long, doc long, tag long, start int, windows int, gone boolean")


def _merged(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(doc, tag, start, end) of runs of windows that follow each other."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    if not len(doc):
        return np.zeros((0, 4), dtype=np.int64)
    head = np.ones(len(doc), dtype=bool)
    head[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1])
    last = np.append(head[1:], True)
    return np.column_stack([doc[head], tag[head], start[head], end[last]])


def _rivals(batches):
    """From fragments sorted by key, content and place: ``rival`` false for those with an
    earlier equal, true for the others of a key that has several."""
    last, alone, place = None, None, None
    for batch in batches:
        table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]])
        settled = batch.column("gone").to_numpy(zero_copy_only=False).astype(bool)
        if settled.any():
            yield _met(table[settled][:, [0, 2, 3, 4, 5]], np.zeros((0, 5), dtype=np.int64))
            table = table[~settled]
        fresh = np.ones(len(table), dtype=bool)  # a repeated row is at the same place, not later
        fresh[1:] = (table[1:, :5] != table[:-1, :5]).any(1)
        if len(table):
            fresh[0] = place is None or (table[0, :5] != place).any()
            place = table[-1, :5]
        table = table[fresh]
        if not len(table):
            continue
        key, content, doc, tag, start, windows = table.T
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_set = new_key | np.concatenate(([True], content[1:] != content[:-1]))
        if last is not None and key[0] == last[0]:
            new_key[0], new_set[0] = False, content[0] != last[1]
        group = np.cumsum(new_key)
        owners = np.flatnonzero(new_set)
        counts = np.bincount(group[owners], minlength=group[-1] + 1)
        wanted = counts >= 2
        rows = [np.column_stack([key, doc, tag, start, windows])[owners]]
        chosen = group[owners]
        if not new_key[0]:  # goes on with the key of the batch before
            wanted[0] = counts[0] >= 1
            if wanted[0] and alone is not None:
                rows, chosen = [alone, *rows], np.concatenate(([0], chosen))
                alone = None
        rows = np.concatenate(rows)
        if group[-1] > 0:
            alone = rows[-1:] if counts[group[-1]] == 1 else None
        rivals = rows[wanted[chosen]]
        gone = ~new_set
        gone_rows = np.column_stack([key, doc, tag, start, windows])[gone]
        last = (key[-1], content[-1])
        yield _met(gone_rows, rivals)


def _met(gone: np.ndarray, rivals: np.ndarray) -> pa.RecordBatch:
    both = np.concatenate([gone, rivals])
    kinds = [np.int64, np.int64, np.int64, np.int32, np.int32]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(both[:, k].astype(kind)) for k, kind in enumerate(kinds)), pa.array(np.arange(len(both)) >= len(gone))],
        names=["key", "doc", "tag", "start", "windows", "rival"],
    )


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``(key, hot, doc, tag, start, bytes)`` of wanted fragments."""
    per_doc = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "hot", "start", "windows")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                data, bounds = tb.flatten(part.column("text"))
                raw = data.tobytes()
                lists = part.column("wanted")
                inner = lists.flatten()
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets))
                starts = inner.field("start").to_numpy()
                windows = inner.field("windows").to_numpy()
                begin = bounds[rows] + starts
                end = begin + windows + length - 1
                held = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
                doc, tag = (part.column(c).take(pa.array(rows)) for c in ("doc", "tag"))
                yield pa.RecordBatch.from_arrays(
                    [inner.field("key"), inner.field("hot"), doc, tag, inner.field("start"), held],
                    names=["key", "hot", "doc", "tag", "start", "bytes"],
                )

    return docs.join(per_doc, ["doc", "tag"]).select("doc", "tag", "text", "wanted").mapInArrow(
        run, "key long, hot boolean, doc long, tag long, start int, bytes binary"
    )


def refine(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of all suffixes of ``data`` sorted to depth ``length``.

    ``ends`` says for each position where its fragment ends. Suffixes with fewer bytes left
    than the depth reached keep the pointer they had; nothing of full depth looks at them.
    """
    left = ends - np.arange(len(data))
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    prefix = np.zeros(len(data), dtype=np.uint64)
    depth = min(8, length)
    for k in range(depth):
        prefix = (prefix << np.uint64(8)) | padded[k : k + len(data)]
    pointer = _buckets(prefix)
    active = np.flatnonzero(left >= depth)
    while depth < length:
        step = min(depth, length - depth)
        active = active[left[active] >= depth + step]
        sizes = np.bincount(pointer, minlength=len(data) + 1)
        active = active[sizes[pointer[active]] > 1]  # buckets of one are sorted
        if not len(active):
            break
        finer = _buckets(pointer[active].astype(np.uint64) * np.uint64(len(data) + 1) + pointer[active + step].astype(np.uint64))
        # a refined bucket starts where it did, moved on by what sorts before it
        pointer[active] = _nest(pointer[active], finer)
        depth += step
    return pointer


def _buckets(keys: np.ndarray) -> np.ndarray:
    """The place of each key's bucket in sorted order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    heads = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    places = np.flatnonzero(heads)
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.repeat(places, np.diff(np.append(places, len(keys))))
    return out


def _nest(coarse: np.ndarray, finer: np.ndarray) -> np.ndarray:
    """``finer`` counts places among all active suffixes; count them inside each bucket."""
    first = np.full(int(coarse.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, coarse, finer)
    return coarse + finer - first[coarse]


def _repeated(key, doc, tag, start, raw, length: int):
    """Covered (doc, tag, start, end) runs among whole keys of fragments in order of place."""
    sizes = np.array([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    upto = np.cumsum(sizes)
    fragment = np.repeat(np.arange(len(raw)), sizes)
    windows = np.flatnonzero(upto[fragment] - np.arange(len(data)) >= length)
    pointer = refine(data, upto[fragment], length)[windows]
    # equal windows share a key, and a key's fragments are in order of place
    _, first = np.unique(pointer, return_index=True)
    again = np.ones(len(windows), dtype=bool)
    again[first] = False
    hit = windows[again]
    if not len(hit):
        return np.zeros((0, 4), dtype=np.int64)
    own = fragment[hit]
    head = np.concatenate(([True], (hit[1:] > hit[:-1] + length) | (own[1:] != own[:-1])))
    tail = np.concatenate((head[1:], [True]))
    base = start[own] - (upto - sizes)[own]
    return np.column_stack([doc[own[head]], tag[own[head]], (hit + base)[head], (hit + base)[tail] + length])


def _refine_keys(length: int, chunk: int):
    """Rows sorted by key, document and start, refined several whole keys at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < chunk:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            stop = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if stop:
                yield from parts(table.slice(0, stop))
            held = table.slice(stop).to_batches()
            size = sum(b.nbytes for b in held) if stop else 0
        if held:
            yield from parts(pa.Table.from_batches(held))

    def parts(table):
        place = np.column_stack([table.column(c).to_numpy() for c in ("key", "doc", "tag", "start")])
        fresh = np.concatenate(([True], (place[1:] != place[:-1]).any(1)))  # rows may be repeated
        table, (key, doc, tag, start) = table.filter(pa.array(fresh)), place[fresh].T
        raw = table.column("bytes").to_pylist()
        sizes = np.cumsum([len(x) for x in raw])
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        at = 0
        while at < len(key):  # as many keys as fit in a chunk, one at least
            base = sizes[at - 1] if at else 0
            full = int(np.searchsorted(sizes, base + chunk))
            nexts = heads[heads > at]
            fit = nexts[nexts <= full]
            stop = len(key) if full >= len(key) else int(fit[-1] if len(fit) else nexts[0] if len(nexts) else len(key))
            found = _repeated(key[at:stop], doc[at:stop], tag[at:stop], start[at:stop], raw[at:stop], length)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(found[:, k].astype(kind)) for k, kind in enumerate((np.int64, np.int64, np.int32, np.int32)))],
                names=["doc", "tag", "start", "end"],
            )
            at = stop

    return run


def _hot_windows(fragments: DataFrame, length: int) -> DataFrame:
    """Covered windows of hot keys, by the hash of every window."""

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, "bytes", 1 << 18):
                data, bounds = tb.flatten(part.column("bytes"))
                sums = tb.prefix_sums(data)
                counts = np.diff(bounds) - length + 1
                rows = np.repeat(np.arange(len(counts)), counts)
                inner = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = bounds[rows] + inner
                starts = part.column("start").to_numpy()[rows] + inner
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tb.span_hashes(sums, at, at + length).view(np.int64)),
                        *(part.column(c).take(pa.array(rows)) for c in ("doc", "tag")), pa.array(starts.astype(np.int32)),
                    ],
                    names=["window", "doc", "tag", "start"],
                )

    windows = cut(fragments.mapInArrow(run, "window long, doc long, tag long, start int"))
    firsts = cut(windows.groupBy("window").agg(F.min(F.struct("doc", "tag", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    return windows.join(firsts, "window").where(
        "doc <> first.doc or tag <> first.tag or start <> first.start"
    ).select("doc", "tag", "start", (F.col("start") + length).alias("end"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__doc`` and ``__tag``, which rows of one id and one text share. The
    tag is 0 where the id alone will do; without an id it is not negative, else negative."""
    own, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    tag = F.xxhash64(text)
    mixed = cut(
        docs.where(own.isNotNull()).groupBy(own.alias("__id")).agg(F.min(tag).alias("a"), F.max(tag).alias("b"))
        .where("a <> b").select("__id")
    )
    named = docs.withColumn("__doc", F.coalesce(own, F.lit(_NO_ID)))
    unnamed = tag.bitwiseAND(F.lit(_NO_ID))
    if mixed.isEmpty():
        return named.withColumn("__tag", F.when(own.isNull(), unnamed).when(own == _NO_ID, -1).otherwise(0).cast("long"))
    shared = tag.bitwiseOR(F.lit(-_NO_ID - 1))
    several = named.join(mixed, own == F.col("__id"), "left")
    by_id = F.when(F.col("__id").isNotNull(), shared).when(own == _NO_ID, -1).otherwise(0)
    return several.withColumn("__tag", F.when(own.isNull(), unnamed).otherwise(by_id).cast("long")).drop("__id")


def find_spans(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    hot_rows: int = HOT_ROWS,
    ship_docs: int = SHIP_DOCS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(doc, tag, spans)`` of documents with covered bytes, by the keys of ``_keyed``; spans may overlap."""
    return _spans(_keyed(docs.select("doc_id", "text")), length, gram, hot_rows, ship_docs, chunk_bytes)


def _spans(
    rows: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    hot_rows: int = HOT_ROWS,
    ship_docs: int = SHIP_DOCS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    keyed = rows.select(F.col("__doc").alias("doc"), F.col("__tag").alias("tag"), "text")
    met = cut(
        _fragments(keyed, length, gram)
        .repartition("key").sortWithinPartitions("key", "content", "doc", "tag", "start")
        .mapInArrow(_rivals, "key long, doc long, tag long, start int, windows int, rival boolean")
    )
    whole = met.where("not rival").select("doc", "tag", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end"))
    rivals = met.where("rival").drop("rival")
    hot = cut(rivals.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("key"))
    asked = cut(rivals.select("doc", "tag").distinct())
    if asked.count() <= ship_docs:  # else the join below reads all texts
        keyed = keyed.join(F.broadcast(asked), ["doc", "tag"], "left_semi")
    spread = None
    if hot.isEmpty():
        fragments = _with_bytes(keyed, rivals.withColumn("hot", F.lit(False)), length)
    else:  # texts are fetched once for both ways
        marked = rivals.join(hot.withColumn("hot", F.lit(True)), "key", "left")
        fragments = cut(_with_bytes(keyed, marked.withColumn("hot", F.col("hot").isNotNull()), length))
        spread = _hot_windows(fragments.where("hot"), length)
    refined = (
        fragments.where("not hot").drop("hot")
        .repartition("key").sortWithinPartitions("key", "doc", "tag", "start")
        .mapInArrow(_refine_keys(length, chunk_bytes), "doc long, tag long, start int, end int")
    )
    spans = whole.unionByName(refined)
    spans = spans if spread is None else spans.unionByName(spread)
    return spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without text, with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the
    remaining bytes."""
    others = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    keyed = _keyed(others)
    spans = _spans(keyed, **options).select(
        F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans")
    )
    joined = keyed.join(spans, ["__doc", "__tag"], "left")
    fields = [f for f in others.schema if f.name != "text"]
    schema = tb.schema(fields, "n_bytes long, n_removed long, n_spans long, kept binary")

    def run(batches):
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                out = [_without(*row) for row in zip(part.column("text").to_pylist(), part.column("__spans").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in fields)]
                    + [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
                    + [pa.array([r[3] for r in out], pa.binary())],
                    names=[*(f.name for f in fields), "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return joined.select(*[F.col(f"`{c}`") for c in others.columns], F.col("__spans")).mapInArrow(run, schema)


def _without(text, spans):
    raw = (text or "").encode()
    if not spans:
        return len(raw), 0, 0, raw
    parts, at, removed, count = [], 0, 0, 0
    reach = -1
    for a, b in sorted((s["start"], min(s["end"], len(raw))) for s in spans):
        if a >= b:
            continue
        if a > reach:
            parts.append(raw[at:a])
            count += 1
            removed += b - a
            at = reach = b
        elif b > reach:
            removed += b - reach
            at = reach = b
    return len(raw), removed, count, b"".join([*parts, raw[at:]])


def report(found: DataFrame) -> DataFrame:
    """The contract's columns of ``drop_repeats``."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
