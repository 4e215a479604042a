"""Repeated paragraphs: MinHash banding, exact Jaccard, removal by components.

Paragraphs are lines of at least ``min_words`` words, lower-cased (A-Z), seen as sets of
five-word shingles. Equal word sequences collapse into one class first. Class signatures
are cut into bands, tuned so that a pair at the threshold shares a band with probability
``recall``; classes that share a band are compared by the exact Jaccard similarity of
their shingle sets, and linked classes form components. The paragraph of the smallest
(doc_id, line) of a component stays, all others are removals.

``find_repeats`` compares whole lines. ``find_pieces`` does the same for pieces of a
document's words, taken across its lines: cut where the hash of a five-word shingle is the
least within ``RADIUS`` words, so at the same words in every document, some 25 words apart
and 50 at most. It finds repeats inside longer lines, or laid out in shorter ones, that
hold or nearly hold a piece; a shorter one may lie across two. Pieces are only compared
with pieces, as they lie in the lines.

Lines and pieces are found in the same words, and texts are read twice: for the band keys,
then for the paragraphs whose class shares a key or has copies, as a Bloom filter of fixed
size lets them through, and their shingle sets; texts never cross a shuffle. Band groups
with the same members are compared once. Classes of groups of more than ``group_rows`` meet
instead by the rarest of their shingles, of which any linked pair shares one. Where still
more than that meet, each is compared with some pivots and a chunk of the others, and then,
chunk by chunk, only with classes of other components; memory is bounded throughout, and a
task returns one spanning star per linked set, never its pairs. Seconds stay quadratic only
in classes of a crowded shingle that the pivots leave outside its largest component.

Defined cases: a null text has no paragraphs; rows with a null id are ignored; repeated
rows of one id are one document; paragraphs below ``min_words`` are never touched; one of
fewer than five words is one shingle. Shingles and classes are told apart by 64 and 128
bits of hash.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.lineage import cut, freeing_shuffles
from maskwright.llm import bloom
from maskwright.llm import textbytes as tb
from maskwright.operators.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
MAX_HASHES = 40
MIN_WORDS = 20
GROUP_ROWS = 256
RADIUS = 12
MAX_PIECE = 50
RECENT = 100_000
PIVOTS = 8
MAX_SLOTS, SLOT_RANGES = 1 << 22, 64  # of the counts of shingles
LINE, PIECE = 0, 1  # kinds of paragraphs

_STEP = 0xD6E8FEB86659FD93
_SECOND = np.uint64(_STEP)


def tune(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band for which ``max_hashes`` reach ``recall``."""
    best = (ceil(log(1 - recall) / log(1 - similarity)), 1)
    for rows in range(2, max_hashes + 1):
        bands = ceil(log(1 - recall) / log(1 - similarity**rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def piece_starts(hashes: np.ndarray, size: int) -> np.ndarray:
    """Where the pieces of one text begin, from the hashes of its words."""
    if len(hashes) < 2 * size:
        return np.zeros(min(len(hashes), 1), dtype=np.int64)
    return _cuts(_shingles(hashes, size), len(hashes), size)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each word on."""
    count = max(len(words) - size + 1, 0)
    return tb.chain(*(words[k : count + k] for k in range(size)))


def _cuts(shingle: np.ndarray, n: int, size: int) -> np.ndarray:
    """Where the pieces of a text of ``n`` words, 2 * ``size`` at least, begin."""
    full = np.full(RADIUS, np.iinfo(np.uint64).max, dtype=np.uint64)
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate((full, shingle, full)), RADIUS)
    before, after = near[: len(shingle)].min(1), near[RADIUS + 1 :].min(1)
    heads = np.flatnonzero((shingle < before) & (shingle <= after))
    heads = np.concatenate(([0], heads[(heads >= size) & (heads <= n - size)], [n]))
    parts = -(-np.diff(heads) // MAX_PIECE)  # stretches without a cut, in equal parts
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(heads[:-1], parts) + inner * np.repeat(np.diff(heads), parts) // np.repeat(parts, parts)


class Paragraphs:
    """The lines and pieces of a block of texts, as arrays over its words. ``units`` gives
    the least number of words of each kind that is wanted; shingles are ``shingle[at : at + made]``."""

    def __init__(self, texts: pa.Array, units: dict[int, int], size: int):
        data, bounds = tb.flatten(texts)
        data = tb.LOWER[data]
        breaks = np.flatnonzero(data == 0x0A) + 1
        lines = np.unique(np.concatenate((bounds, breaks)))
        starts, ends, firsts = tb.words(data, lines, tb.NOT_SPACE)
        self.words = tb.span_hashes(tb.prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        full = _shingles(self.words, size)
        kinds = []
        for unit, least in units.items():
            if unit == PIECE:
                owns = np.searchsorted(starts, bounds)
                heads = [np.zeros(0, np.int64)]
                for a, b in zip(owns[:-1].tolist(), owns[1:].tolist()):
                    if b - a >= 2 * size:
                        heads.append(a + _cuts(full[a : b - size + 1], b - a, size))
                    elif b > a:
                        heads.append(np.array([a]))
                first = np.concatenate(heads)
                last = np.minimum(np.append(first[1:], len(starts)), owns[np.searchsorted(owns, first, side="right")])
                used = np.searchsorted(firsts, first, side="right") - 1
                keep = last - first >= max(least, 1)
                kinds.append((unit, first[keep], (last - first)[keep], used[keep]))
            else:
                counts = np.diff(firsts)
                used = np.flatnonzero(counts >= max(least, 1))
                kinds.append((unit, firsts[:-1][used], counts[used], used))
        self.unit = np.concatenate([np.full(len(first), unit, dtype=np.int8) for unit, first, _, _ in kinds])
        self.first, self.n_words, used = (np.concatenate(x) for x in list(zip(*kinds))[1:])
        self.word = self.first - firsts[:-1][used]
        self.text = np.searchsorted(bounds, lines[:-1][used], side="right") - 1
        newlines = lambda at: np.searchsorted(breaks, at, side="right")
        self.line = newlines(lines[:-1][used]) - newlines(bounds[:-1][self.text])
        self.made = np.maximum(self.n_words - size + 1, 1)
        short = self.n_words < size
        self.at = np.where(short, len(full) + np.cumsum(short) - 1, self.first)
        self.shingle = np.concatenate((full, self._short(np.flatnonzero(short), size)))

    def _short(self, which: np.ndarray, size: int) -> np.ndarray:
        """The only shingle of each paragraph of fewer words than one has."""
        first, last = self.first[which], (self.first + self.n_words)[which]
        out = self.words[first]
        for k in range(1, size):
            at = first + k
            out = tb.chain(out, np.where(at < last, self.words[np.minimum(at, len(self.words) - 1)], np.uint64(k)))
        return out

    def only(self, which: np.ndarray) -> Paragraphs:
        """Some of the paragraphs, in the same words."""
        out = object.__new__(Paragraphs)
        out.words, out.shingle = self.words, self.shingle
        for name in ("unit", "first", "n_words", "word", "text", "line", "at", "made"):
            setattr(out, name, getattr(self, name)[which])
        return out

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each paragraph's word sequence; a line and a piece differ."""
        last = self.first + self.n_words
        out = []
        for words in (self.words, tb.mix(self.words ^ _SECOND)):
            sums = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum(words * tb.powers(len(words), tb._STEP), out=sums[1:])
            out.append(tb.span_hashes(sums, self.first, last))
        return out[0] + self.unit.astype(np.uint64), out[1]

    def sets(self) -> list[bytes]:
        """The sorted shingle set of each paragraph."""
        return [np.unique(self.shingle[a:b]).tobytes() for a, b in zip(self.at.tolist(), (self.at + self.made).tolist())]

    def bands(self, bands: int, rows: int) -> np.ndarray:
        out = np.zeros((len(self.first), bands), dtype=np.uint64)
        if not len(self.first):
            return out
        # places are hashed once, whichever paragraphs they are in; every other range is the gap
        # to the next paragraph, and short in their order
        order = np.lexsort((self.at, self.unit))
        ranges = np.column_stack((self.at, self.at + self.made))[order].ravel()
        places = np.append(self.shingle, np.uint64(0))
        hashed, spare, low = np.empty_like(places), np.empty_like(places), np.empty(len(order), dtype=np.uint64)
        for k in range(bands * rows):
            np.add(places, np.uint64((k + 1) * _STEP % (1 << 64)), out=hashed)
            _mix_in_place(hashed, spare)
            low[order] = np.minimum.reduceat(hashed, ranges)[::2]
            band = k // rows
            out[:, band] = tb.chain(out[:, band] if k % rows else np.full(len(low), band, np.uint64), low)
        return out + self.unit.astype(np.uint64)[:, None]


def _mix_in_place(x: np.ndarray, spare: np.ndarray) -> None:
    """``tb.mix`` without new arrays."""
    for shift, times in ((30, tb._MIX_A), (27, tb._MIX_B), (31, None)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if times is not None:
            np.multiply(x, times, out=x)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def paragraphs(docs: DataFrame, units: dict[int, int], size: int, wanted, compared) -> DataFrame:
    """``(doc_id, unit, line, word, n_words, a, b, id, shingles)`` of the paragraphs whose class
    may be in the filter ``wanted``; (a, b) is a paragraph's class, ``id`` one number of both.
    The sorted shingle set of classes that may be in ``compared`` is given with a first copy
    in a block, unless it was with one of the ``RECENT`` classes before."""

    def run(batches):
        recent = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                found = Paragraphs(part.column("text"), units, size)
                a, b = found.classes()
                ids = class_id(a, b)
                at = np.flatnonzero(bloom.has(wanted.value, ids))
                if not len(at):
                    continue
                found, a, b, ids = found.only(at), a[at], b[at], ids[at]
                new, first = np.unique(ids, return_index=True)
                live = bloom.has(compared.value, new) & ~np.isin(new, recent)
                recent = np.concatenate((recent, new[live]))[-RECENT:]
                sets = np.full(len(ids), None, dtype=object)
                sets[first[live]] = found.only(first[live]).sets()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(found.text)),
                        pa.array(found.unit),
                        *(pa.array(x.astype(np.int32)) for x in (found.line, found.word, found.n_words)),
                        *map(_signed, [a, b, ids]),
                        pa.array(sets, pa.binary()),
                    ],
                    names=["doc_id", "unit", "line", "word", "n_words", "a", "b", "id", "shingles"],
                )

    return _usable(docs).mapInArrow(
        run, "doc_id long, unit byte, line int, word int, n_words int, a long, b long, id long, shingles binary"
    )


def _usable(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")


def class_id(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number of a class's two."""
    return tb.chain(a, b)


def band_keys(docs: DataFrame, units: dict[int, int], size: int, bands: int, rows: int) -> DataFrame:
    """``(key, id)``: the band keys of every class. A task gives them once for many copies of
    a class: those of a block, and of the ``RECENT`` classes it has met; that there are
    copies is told by two equal rows, under the class itself as a key."""

    def run(batches):
        recent = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for part in tb.blocks(batch, "text"):
                found = Paragraphs(part.column("text"), units, size)
                if not len(found.first):
                    continue
                ids, at, copies = np.unique(class_id(*found.classes()), return_index=True, return_counts=True)
                met = np.isin(ids, recent)
                repeated = ids[met | (copies > 1)]
                ids, at = ids[~met], at[~met]
                recent = np.concatenate((recent, ids))[-RECENT:]
                keys = found.only(at).bands(bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate((keys.ravel(), repeated, repeated))), _signed(np.concatenate((np.repeat(ids, bands), repeated, repeated)))],
                    names=["key", "id"],
                )

    return _usable(docs).mapInArrow(run, "key long, id long")


def _groups(limit: int):
    """From rows sorted by key: members of keys with several, under a group id that is
    equal for equal sets of up to ``limit`` members; larger sets keep their key and are marked. A member
    that is there twice is a class with copies, and comes out without a group too."""

    def flush(key, members, closed):
        if closed and len(members) < 2:
            return None
        ids = np.array(members, dtype=np.int64).view(np.uint64)
        group = int(tb.mix(ids).sum(dtype=np.uint64)) if closed and len(members) <= limit else int(key)
        large = np.full(len(ids), not closed or len(members) > limit)
        return np.full(len(ids), group, dtype=np.uint64 if group >= 0 else np.int64).view(np.int64), ids.view(np.int64), large

    def run(batches):
        key, members, large, before = None, [], False, (None, None)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            new = np.ones(len(keys), dtype=bool)  # a class that several tasks have named
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            new[:1] &= [(k, i) != before for k, i in zip(keys[:1].tolist(), ids[:1].tolist())]
            before = (int(keys[-1]), int(ids[-1])) if len(keys) else before
            if not new.all():
                twice = pa.array(np.unique(ids[~new]))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(twice), pa.int64()), twice, pa.nulls(len(twice), pa.bool_())], names=["grp", "id", "large"])
            keys, ids = keys[new], ids[new]
            if not len(keys):
                continue
            heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ends = np.append(heads[1:], len(keys))
            if key is not None and keys[0] != key:
                if members and (got := flush(key, members, not large)) is not None:
                    out.append(got)
                key, members, large = None, [], False
            # keys of one class hold no pair; the last one of a batch may go on in the next
            live = np.flatnonzero((ends - heads > 1) | (ends == len(keys)) | (heads == 0))
            for a, b in zip(heads[live].tolist(), ends[live].tolist()):
                if key is not None and keys[a] == key:
                    members.extend(ids[a:b].tolist())
                else:
                    if members and (got := flush(key, members, not large)) is not None:
                        out.append(got)
                    key, members, large = keys[a], ids[a:b].tolist(), False
                if len(members) > 50 * limit:  # hand on what is there, under the key itself
                    out.append(flush(key, members, False))
                    members, large = [], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["grp", "id", "large"])
                out = []
        if members and (got := flush(key, members, not large)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["grp", "id", "large"])

    return run


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The least index each set is linked to, by exact Jaccard over sorted hash sets."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if both >= similarity * (len(sets[0]) + len(sets[1]) - both) else 1])
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes.astype(int))
    common = np.zeros((m, m), dtype=np.float64)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    width = min(4096, int(ids[-1]) + 1)
    for low in range(0, int(ids[-1]) + 1, width):
        a, b = np.searchsorted(ids, (low, low + width))
        block = np.zeros((m, width), dtype=np.float32)
        block[owner[a:b], ids[a:b] - low] = 1
        common += block @ block.T
    linked = common >= similarity * (sizes[:, None] + sizes[None] - common)
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        lower = np.where(linked, label[None], m).min(1)
        if (lower == label).all():
            return label
        label = lower


def _verify(similarity: float):
    """Rows sorted by group: whole groups compared, spanning stars out."""

    def stars(members):
        if len(members) < 2:
            return []
        label = similar_sets([np.frombuffer(raw, dtype=np.uint64) for _, raw in members], similarity)
        return [(members[k][0], members[label[k]][0]) for k in np.flatnonzero(label != np.arange(len(members)))]

    def run(batches):
        key, members = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("grp", "i", "j", "id", "shingles")]
            for grp, i, j, own, raw in zip(*columns):
                if (grp, i, j) != key:
                    out.extend(stars(members))
                    key, members = (grp, i, j), []
                members.append((own, raw))
            yield _links(out)
        yield _links(stars(members))

    return run


def _links(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["node", "root"]
    )


def _compare(dealt: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Links ``(node, root)`` among the classes dealt to each ``(grp, i, j)``."""
    return (
        dealt.join(shingles, "id").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "id")
        .mapInArrow(_verify(similarity), "node long, root long")
    )


def _slots(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    """The two slots of each shingle."""
    mixed = tb.mix(keys.view(np.uint64))
    return [((mixed >> np.uint64(shift)) & np.uint64(slots - 1)).astype(np.int64) for shift in (0, 32)]


def _shingle_counts(shingles: DataFrame):
    """In how many classes shingles are, counted in up to ``MAX_SLOTS`` slots of their hash, two
    for each, ready to be shipped; the lesser of the two is the count or above it. A task hands on
    one row a range of slots, with those that it has met."""
    total = shingles.agg(F.sum(F.expr("length(shingles) div 8"))).first()[0] or 0
    slots = SLOT_RANGES
    while slots < min(MAX_SLOTS, 16 * total):
        slots *= 2
    width = slots // SLOT_RANGES

    def count(batches):
        held = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for part in tb.blocks(batch, "shingles"):
                keys = np.frombuffer(b"".join(part.column("shingles").to_pylist()), dtype=np.int64)
                for at in _slots(keys, slots):
                    np.add.at(held, at, 1)
        for k in range(SLOT_RANGES):
            own = held[k * width : (k + 1) * width]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([at.astype(np.int32).tobytes()]), pa.array([own[at].tobytes()])], names=["part", "at", "n"]
                )

    def add(batches):
        held = {}
        for batch in batches:
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(k, np.zeros(width, dtype=np.int64))
                own[np.frombuffer(at, dtype=np.int32)] += np.frombuffer(n, dtype=np.int64)
        for k, own in held.items():
            counts = np.minimum(own, np.iinfo(np.int32).max).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts.tobytes()])], names=["part", "n"])

    counted = (
        shingles.select("shingles").mapInArrow(count, "part int, at binary, n binary")
        .repartition("part").mapInArrow(add, "part int, n binary").toArrow()
    )
    out = np.zeros((SLOT_RANGES, width), dtype=np.int32)
    for k, n in zip(*(c.to_pylist() for c in counted.columns)):
        out[k] = np.frombuffer(n, dtype=np.int32)
    return shingles.sparkSession.sparkContext.broadcast(out.ravel())


def _rare_first(shingles: DataFrame, similarity: float) -> DataFrame:
    """``(key, id, size, usual, reach)``: the shingles of each class, rarest first, by which any set
    linked to it shares one with it. Any order that holds for all classes will do, so the
    counts of slots serve. ``usual`` is the mean count of its shingles; a partner
    whose first shared shingle this is has at most ``reach`` shingles."""
    counts = _shingle_counts(shingles)

    def prefixes(batches):
        for batch in batches:
            for part in tb.blocks(batch, "shingles"):
                raw = part.column("shingles").to_pylist()
                keys = np.frombuffer(b"".join(raw), dtype=np.int64)
                sizes = np.array([len(x) // 8 for x in raw])
                if not len(keys):
                    continue
                owner, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
                n = np.minimum(*(counts.value[at] for at in _slots(keys, len(counts.value)))).astype(np.int64)
                usual = np.bincount(owner, weights=n, minlength=len(sizes)) / np.maximum(sizes, 1)
                order = np.lexsort((keys, n, owner))
                place, size = np.arange(len(keys)) - first[owner], sizes[owner]
                # a count of one is of a shingle that is in no other class
                at = np.flatnonzero((place <= size - np.ceil(size * similarity - 1e-9)) & (n[order] > 1))
                own, size = owner[at], size[at]
                reach = (size - place[at]) * ((1 + similarity) / similarity) - size + 1e-6
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[order[at]]), part.column("id").take(pa.array(own)),
                        pa.array(size), pa.array(usual[own]), pa.array(reach),
                    ],
                    names=["key", "id", "size", "usual", "reach"],
                )

    return shingles.select("id", "shingles").mapInArrow(prefixes, "key long, id long, size long, usual double, reach double")


def _large_links(shingles: DataFrame, links: DataFrame, similarity: float, group_rows: int) -> DataFrame:
    """Links among the classes of large band groups, known ``links`` and what they lack.

    Linked sets share one of their rarest shingles, so classes meet by those. Where still too
    many meet, each is compared with some pivots and a chunk of the others; after that only
    classes of different components are, chunk by chunk."""
    half = max(1, group_rows // 2)
    prefixes = cut(_rare_first(shingles, similarity))
    grouped = cut(
        prefixes.select("key", "id").repartition("key").sortWithinPartitions("key", "id")
        .mapInArrow(_groups(group_rows), "grp long, id long, large boolean").distinct()
    )
    flat = lambda rows: rows.select("grp", "id", F.lit(0).alias("i"), F.lit(0).alias("j"))
    links = links.unionByName(_compare(flat(grouped.where("not large")), shingles, similarity))
    crowded = grouped.where("large").select("grp", "id").join(prefixes.withColumnRenamed("key", "grp"), ["grp", "id"])
    crowd = cut(crowded.groupBy("grp").agg(
        F.count("*").alias("n"),
        F.array_distinct(F.array(
            F.max_by("id", F.struct("usual", "id")), *(F.min_by("id", F.xxhash64(F.lit(k), "id")) for k in range(PIVOTS - 1))
        )).alias("pivots"),
    ))
    if crowd.isEmpty():
        return links
    own = F.pmod(F.xxhash64("id", "grp"), F.ceil(F.col("n") / half)).cast("int")
    first = crowded.join(crowd, "grp").where(~F.array_contains("pivots", F.col("id"))).select(
        "grp", "id", own.alias("i"), F.lit(0).alias("j")
    ).unionByName(
        crowd.select("grp", F.explode("pivots").alias("id"), "n").select(
            "grp", "id", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / half) - 1).cast("int"))).alias("i"), F.lit(0).alias("j")
        )
    )
    links = cut(links.unionByName(_compare(first, shingles, similarity)).distinct())
    known = cut(connected_components(links, []))
    stars = known.select("node", F.col("component").alias("root"))
    apart = crowded.join(known, F.col("id") == F.col("node"), "left").select(
        "grp", "id", "size", "reach", F.coalesce("component", "id").alias("component")
    )
    parts = apart.groupBy("grp", "component").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    most = parts.groupBy("grp").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.min("size").alias("least"), F.count("*").alias("parts")
    ).where("parts > 1")
    # a class whose partners would have to be smaller than any that is there has none
    apart = cut(apart.join(most, "grp").where("reach >= least").withColumn("rest", F.expr("component <> main")))
    chunks = cut(apart.groupBy("grp").agg(
        F.ceil(F.count(F.when(F.col("rest"), 1)) / half).cast("int").alias("r"),
        F.ceil(F.count(F.when(~F.col("rest"), 1)) / half).cast("int").alias("m"),
    ).where("r > 0"))
    # chunks 0 to r - 1 are of the rest, r to r + m - 1 of the main component, which do not meet each other
    dealt = apart.join(chunks, "grp").withColumn(
        "own", F.expr("if(rest, pmod(xxhash64(id, grp), r), r + pmod(xxhash64(id, grp), greatest(m, 1)))").cast("int")
    ).withColumn("other", F.explode(F.expr("sequence(0, if(rest, r + m, r) - 1)"))).select(
        "grp", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    return stars.unionByName(_compare(dealt, shingles, similarity))


def find_repeats(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    size: int = SHINGLE,
    max_hashes: int = MAX_HASHES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(doc_id, line, n_words, keep_doc_id, keep_line, removed)`` of every paragraph that
    has a repeat; the kept paragraph of each component is among them."""
    return repeats(docs, {LINE: min_words}, similarity, recall, size, max_hashes, group_rows).drop("unit", "word", "keep_word")


def find_pieces(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    size: int = SHINGLE,
    max_hashes: int = MAX_HASHES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(doc_id, line, word, n_words, keep_doc_id, keep_line, keep_word, removed)`` of every
    piece that has a repeat; ``word`` is its first word's place in ``line``."""
    return repeats(docs, {PIECE: size}, similarity, recall, size, max_hashes, group_rows).drop("unit")


def repeats(
    docs: DataFrame,
    units: dict[int, int],
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    size: int = SHINGLE,
    max_hashes: int = MAX_HASHES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """What ``find_repeats`` and ``find_pieces`` give, with ``unit``, of the kinds in ``units``
    (``LINE``, ``PIECE``: the least number of words) in one go."""
    with freeing_shuffles(docs.sparkSession):
        found, kept = _found_and_kept(docs.select("doc_id", "text"), units, similarity, recall, size, max_hashes, group_rows)
    return (
        found.drop("id", "shingles").join(kept, ["a", "b"])
        .select(
            "unit", "doc_id", "line", "word", "n_words",
            *(F.col(f"keep.{c}").alias(f"keep_{c}") for c in ("doc_id", "line", "word")),
            (F.struct("doc_id", "line", "word") != F.col("keep")).alias("removed"),
        )
    )


def _found_and_kept(
    docs: DataFrame, units: dict[int, int], similarity: float, recall: float, size: int, max_hashes: int, group_rows: int
) -> tuple[DataFrame, DataFrame]:
    """The paragraphs that may have a repeat, and ``(a, b, keep)`` of every class that has one."""
    bands, rows = tune(similarity, recall, max_hashes)
    grouped = cut(
        band_keys(docs, units, size, bands, rows)
        .repartition("key").sortWithinPartitions("key", "id")
        .mapInArrow(_groups(group_rows), "grp long, id long, large boolean").distinct()
    )
    members = grouped.where("grp is not null")
    wanted, compared = (bloom.build(x.select("id").distinct()) for x in (grouped, members))
    found = cut(paragraphs(docs, units, size, wanted, compared))
    classes = cut(found.groupBy("a", "b").agg(
        F.min(F.struct("doc_id", "line", "word")).alias("first"), F.count("*").alias("n"), F.first("id").alias("id")
    ))
    shingles = cut(found.where("shingles is not null").select("id", "shingles").dropDuplicates(["id"]))
    links = _compare(
        members.where("not large").select("grp", "id", F.lit(0).alias("i"), F.lit(0).alias("j")), shingles, similarity
    )
    crowded = members.where("large").select("id").distinct()
    if not crowded.isEmpty():
        links = _large_links(cut(shingles.join(crowded, "id", "left_semi")), links, similarity, group_rows)
    joined = connected_components(cut(links.distinct()), [])
    linked = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or component is not null").select(
        "a", "b", "first", F.coalesce("component", "id").alias("component")
    )
    return found, cut(linked.join(linked.groupBy("component").agg(F.min("first").alias("keep")), "component").select("a", "b", "keep"))
