"""From candidate faces to a consistent gallery per name.

Face rows carry ``keys`` (usually the name), an integer order ``ord`` unique within the
keys, and ``embedding``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright import settings
from maskwright.functions import text, vectors
from maskwright.lineage import cut
from maskwright.operators import blocks, greedy
from maskwright.operators.components import connected_components


def single_face_only(faces: DataFrame, image: list[str]) -> tuple[DataFrame, DataFrame]:
    """Images with exactly one face, and a reject row "N faces" for every other count.

    ``faces`` has one row per detected face; an image without a face has one row with a
    null ``embedding``. Counting is an aggregation joined back, so an image with very
    many faces never sits in one task.
    """
    counts = faces.groupBy(*image).agg(F.count("embedding").alias("__faces"))
    single = counts.where("__faces = 1").select(*image)
    kept = faces.where("embedding is not null").join(single, image, "left_semi")
    rejected = counts.where("__faces <> 1").select(
        *image, F.concat(F.col("__faces").cast("string"), F.lit(" faces")).alias("reason")
    )
    return kept, rejected


def drop_near_duplicates(
    faces: DataFrame, keys: list[str], minimum: float = settings.DUPLICATE_COSINE, **sizes
) -> tuple[DataFrame, DataFrame]:
    """First-come removal: a face leaves when it is too close to an earlier kept one."""
    kept = cut(
        greedy.keep_first_come(
            faces, keys, "ord", F.col("embedding"), greedy.cosine_conflict(minimum), **sizes
        )
    )
    unique = faces.join(kept, [*keys, "ord"], "left_semi")
    dropped = faces.join(kept, [*keys, "ord"], "left_anti").select(
        *keys, "ord", F.lit("duplicate").alias("reason")
    )
    return unique, dropped


def _local_links(task: pa.Table, keys: list[str], minimum: float) -> pa.Table:
    """Links and neighbour counts inside one pair of blocks: a star per local component."""
    ords = task["__ord"].to_numpy()
    block = task[blocks.BLOCK].to_numpy()
    copies = task["__copies"].to_numpy()
    unit = blocks.unit_rows(blocks.matrix(task["embedding"]))
    i_block = task[blocks.LEFT][0].as_py()
    same = i_block == task[blocks.RIGHT][0].as_py()
    left = np.nonzero(block == i_block)[0]
    right = left if same else np.nonzero(block != i_block)[0]
    label = ords.copy()
    degree = np.zeros(len(ords), dtype=np.int64)
    i, j, _ = blocks.pairs_at_least(unit[left], unit[right], minimum)
    a, b = left[i], right[j]
    if same:
        itself = a == b
        np.add.at(degree, a[itself], copies[a[itself]] - 1)
        a, b = a[a < b], b[a < b]
    np.add.at(degree, a, copies[b])
    np.add.at(degree, b, copies[a])
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    # The same vector meets itself in (b, b) only; elsewhere a zero count is no news.
    out = np.nonzero((degree > 0) | (label != ords))[0]
    linked_self = np.zeros(len(ords), dtype=bool)
    if same:
        linked_self[left] = blocks.exact_dots(unit[left], unit[left]) >= minimum
        out = np.arange(len(ords))
    picked = task.select([*keys, "__ord"]).take(pa.array(out))
    return (
        picked.append_column("root", pa.array(label[out], pa.int64()))
        .append_column("degree", pa.array(degree[out], pa.int64()))
        .append_column("alike", pa.array(linked_self[out]))
    )


def similarity_graph(
    faces: DataFrame,
    keys: list[str],
    minimum: float,
    block_rows: int = settings.BLOCK_ROWS,
) -> DataFrame:
    """``(keys, ord, degree, component)``: neighbours at ``minimum`` cosine, and the
    connected component, named by its lowest ``ord``.

    Exact copies are collapsed first and counted in, and each task returns one star per
    local component, so the links handed on grow with the rows and not with the pairs.
    """
    rows = faces.select(*keys, F.col("ord").cast("bigint").alias("ord"), "embedding")
    distinct = rows.groupBy(*keys, "embedding").agg(
        F.min("ord").alias("__ord"), F.count("*").alias("__copies")
    )
    schema = T.StructType(
        [
            *[faces.schema[k] for k in keys],
            T.StructField("__ord", T.LongType()),
            T.StructField("root", T.LongType()),
            T.StructField("degree", T.LongType()),
            T.StructField("alike", T.BooleanType()),
        ]
    )
    spread = blocks.near_blocks(distinct, keys, "__ord", "embedding", minimum, block_rows)
    columns = [*keys, "__ord", "embedding", "__copies", blocks.BLOCK, blocks.LEFT, blocks.RIGHT]
    partial = (
        spread.select(*columns)
        .groupBy(*keys, blocks.LEFT, blocks.RIGHT)
        .applyInArrow(lambda task: _local_links(task, keys, minimum), schema)
    )
    partial = cut(partial)
    nodes = partial.groupBy(*keys, "__ord").agg(
        F.sum("degree").alias("degree"), F.max("alike").alias("alike")
    )
    comps = connected_components(
        partial.where("root <> __ord").select(*keys, F.col("__ord").alias("node"), "root"), keys
    )
    named = nodes.join(
        comps.select(*keys, F.col("node").alias("__ord"), "component"), [*keys, "__ord"], "left"
    ).withColumn("component", F.coalesce("component", "__ord"))
    member = rows.join(distinct.drop("__copies"), [*keys, "embedding"]).select(*keys, "ord", "__ord")
    return member.join(named, [*keys, "__ord"]).select(
        *keys,
        "ord",
        "degree",
        F.when(F.col("alike"), F.col("component")).otherwise(F.col("ord")).alias("component"),
    )


def pick_cluster(
    graph: DataFrame, keys: list[str], min_cluster: int = settings.MIN_CLUSTER
) -> DataFrame:
    """``(keys, ord, kept, reason)``: the dominant component stays.

    Largest component, ties to the one with the lowest ``ord``. When even that has fewer
    than ``min_cluster`` members, the component of the best-connected face is kept and
    the rest are "small-cluster" instead of "outlier".
    """
    sizes = graph.groupBy(*keys, "component").agg(
        F.count("*").alias("members"),
        F.max(F.struct(F.col("degree"), (-F.col("ord")).alias("low"))).alias("hub"),
    )
    top = sizes.groupBy(*keys).agg(
        F.max(F.struct("members", (-F.col("component")).alias("low"))).alias("large"),
        F.max(F.struct("hub", F.col("component"))).alias("dense"),
    )
    weak = F.col("large.members") < min_cluster
    choice = top.select(
        *keys,
        F.when(weak, F.col("dense.component")).otherwise(-F.col("large.low")).alias("__chosen"),
        F.when(weak, "small-cluster").otherwise("outlier").alias("__reason"),
    )
    kept = F.col("component") == F.col("__chosen")
    return graph.join(choice, keys).select(
        *keys, "ord", kept.alias("kept"), F.when(~kept, F.col("__reason")).alias("reason")
    )


def _spread_picks(unit: np.ndarray, norms: np.ndarray, k: int) -> list[int]:
    """Farthest-point order over one group already in ``ord`` order."""
    picks = [int(np.argmax(norms))]
    distance = 1.0 - blocks.exact_dots(unit, np.broadcast_to(unit[picks[0]], unit.shape))
    distance[picks[0]] = -np.inf
    while len(picks) < min(k, len(unit)):
        pick = int(np.argmax(distance))
        picks.append(pick)
        closer = 1.0 - blocks.exact_dots(unit, np.broadcast_to(unit[pick], unit.shape))
        distance = np.where(closer < distance, closer, distance)
        distance[pick] = -np.inf
    return picks


def _grouped_prototypes(faces: DataFrame, keys: list[str], k: int) -> DataFrame:
    schema = T.StructType([*[faces.schema[c] for c in keys], T.StructField("ord", T.LongType())])

    def select(group: pa.Table) -> pa.Table:
        group = group.sort_by("ord")
        raw = blocks.matrix(group["embedding"])
        unit = blocks.unit_rows(raw)
        picks = _spread_picks(unit, np.sqrt(blocks.exact_dots(raw, raw)), k)
        nearest = {
            int(np.argmax(blocks.exact_dots(unit, np.broadcast_to(unit[p], unit.shape))))
            for p in picks
        }
        return group.select([*keys, "ord"]).take(pa.array(sorted(nearest)))

    return faces.select(*keys, "ord", "embedding").groupBy(*keys).applyInArrow(select, schema)


def _round_prototypes(faces: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The same picks for groups too large for a task: k rounds, each one scan that brings
    the running distance to the nearest pick up to date and aggregates the next pick."""
    state = cut(
        faces.select(
            *keys,
            "ord",
            vectors.l2_norm(F.col("embedding")).alias("__score"),
            vectors.l2_normalize(F.col("embedding")).alias("__unit"),
            F.lit(float("inf")).alias("__gap"),
            F.lit(False).alias("__taken"),
        )
    )
    best = F.max_by(F.struct("ord", "__unit"), F.struct("__score", -F.col("ord"))).alias("__pick")
    picks = None
    for _ in range(k):
        pick = cut(state.where("not __taken").groupBy(*keys).agg(best))
        if pick.isEmpty():
            break
        picks = pick if picks is None else picks.unionByName(pick)
        nearer = F.lit(1.0) - vectors.dot(F.col("__unit"), F.col("__pick.__unit"))
        state = cut(
            # a group without a further pick has all its rows taken
            state.join(pick, keys)
            .withColumn("__gap", F.least("__gap", nearer))
            .withColumn("__taken", F.col("__taken") | (F.col("ord") == F.col("__pick.ord")))
            .select(*keys, "ord", F.col("__gap").alias("__score"), "__unit", "__gap", "__taken")
        )
    rows = faces.select(*keys, "ord", vectors.l2_normalize(F.col("embedding")).alias("__unit"))
    score = vectors.dot(F.col("__pick.__unit"), F.col("__unit"))
    return (
        rows.join(picks, keys)
        .withColumn("__score", score)
        .groupBy(*keys, F.col("__pick.ord").alias("__i"))
        .agg(F.max_by("ord", F.struct("__score", -F.col("ord"))).alias("ord"))
        .select(*keys, "ord")
        .distinct()
    )


def prototypes(
    faces: DataFrame,
    keys: list[str],
    k: int = settings.MAX_PROTOTYPES,
    group_rows: int = settings.GROUP_ROWS,
) -> DataFrame:
    """``(keys, ord)`` of up to ``k`` diverse faces per group.

    Farthest-point sampling seeded with the largest norm, each pick mapped back to the
    first nearest row, so exact copies collapse and fewer than ``k`` may remain.
    """
    rows = faces.select(*keys, F.col("ord").cast("bigint").alias("ord"), "embedding")
    small, large = blocks.split_by_size(rows, keys, group_rows)
    chosen = _grouped_prototypes(small, keys, k)
    if large is not None:
        chosen = chosen.unionByName(_round_prototypes(large, keys, k))
    return chosen


def cluster_faces(
    faces: DataFrame,
    keys: list[str],
    radius: float = settings.CLUSTER_RADIUS,
    min_cluster: int = settings.MIN_CLUSTER,
    max_prototypes: int = settings.MAX_PROTOTYPES,
    block_rows: int = settings.BLOCK_ROWS,
    group_rows: int = settings.GROUP_ROWS,
) -> DataFrame:
    """``(keys, ord, kept, reason, is_prototype)`` of every face."""
    graph = similarity_graph(faces, keys, 1.0 - radius, block_rows)
    verdict = pick_cluster(graph, keys, min_cluster)
    members = faces.join(verdict.where("kept").select(*keys, "ord"), [*keys, "ord"], "left_semi")
    chosen = prototypes(members, keys, max_prototypes, group_rows).withColumn("__p", F.lit(True))
    return verdict.join(chosen, [*keys, "ord"], "left").select(
        *keys, "ord", "kept", "reason", F.coalesce("__p", F.lit(False)).alias("is_prototype")
    )


def build_preview(
    candidates: DataFrame,
    faces: DataFrame,
    complete: DataFrame | None = None,
    duplicate: float = settings.DUPLICATE_COSINE,
    radius: float = settings.CLUSTER_RADIUS,
    min_cluster: int = settings.MIN_CLUSTER,
    max_prototypes: int = settings.MAX_PROTOTYPES,
    min_references: int = settings.MIN_REFERENCES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faces to confirm, every rejection with its reason, and one count row per name.

    ``candidates(name, ord, url, thumb_url, filename, source, score)`` are the ranked
    photos, ``faces(name, ord, embedding)`` the faces found in them (a null embedding for
    none). Kept are the prototypes of the dominant cluster, all names in one job.
    """
    keys = ["name"]
    single, wrong_count = single_face_only(faces, ["name", "ord"])
    unique, duplicates = drop_near_duplicates(single.select("name", "ord", "embedding"), keys, duplicate)
    unique = cut(unique)
    verdict = cut(cluster_faces(unique, keys, radius, min_cluster, max_prototypes))
    detail = ["url", "thumb_url", "filename", "source", "score"]
    kept = (
        verdict.where("is_prototype")
        .select("name", "ord")
        .join(candidates.select("name", "ord", *detail), ["name", "ord"])
        .join(unique, ["name", "ord"])
    )
    outside = verdict.where("not kept").select("name", "ord", "reason")
    counted = (
        candidates.groupBy("name")
        .agg(F.count("*").alias("candidates_tried"))
        .join(single.groupBy("name").agg(F.count("*").alias("faces_found")), "name", "left")
        .join(
            verdict.groupBy("name").agg(F.count_if("is_prototype").alias("kept_count")), "name", "left"
        )
        .na.fill(0, ["faces_found", "kept_count"])
    )
    few = counted.where(F.col("kept_count") < min_references).select(
        "name",
        F.lit("").alias("url"),
        F.format_string(
            "too-few-consistent-faces: %d kept, need %d", "kept_count", F.lit(min_references)
        ).alias("reason"),
    )
    rejected = (
        wrong_count.select("name", "ord", "reason")
        .unionByName(duplicates)
        .unionByName(outside)
        .join(candidates.select("name", "ord", "url"), ["name", "ord"], "left")
        .select("name", F.coalesce("url", F.lit("")).alias("url"), "reason")
        .unionByName(few)
    )
    if complete is not None:
        late = complete.where("not complete").select(
            "name", F.lit("").alias("url"), F.lit("search-incomplete").alias("reason")
        )
        rejected = rejected.unionByName(late)
    return kept, rejected, counted


def curated_preview(references: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All single-face references of directory people: score 1, no dedup, no clustering.

    ``references(identity_id, name, ord, path, source)``, ``faces(identity_id, ord, embedding)``.
    """
    key = ["identity_id", "ord"]
    single, wrong = single_face_only(faces, key)
    named = references.select(
        *key,
        "name",
        F.col("path").alias("url"),
        F.col("path").alias("thumb_url"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.coalesce("source", F.lit("curated")).alias("source"),
        F.lit(1.0).alias("score"),
    )
    rejected = wrong.join(named.select(*key, "url"), key, "left").select("identity_id", "url", "reason")
    return named.join(single.select(*key, "embedding"), key), rejected


def sanitize_preview(
    faces: DataFrame, width: int, tolerance: float | None = settings.NORM_TOLERANCE
) -> DataFrame:
    """Confirmed faces with usable vectors; missing texts empty, a non-finite score 0."""
    usable = faces.where(vectors.is_valid_embedding(F.col("embedding"), width, tolerance))
    for name in ("url", "filename", "source"):
        usable = usable.withColumn(name, F.coalesce(name, F.lit("")))
    return usable.withColumn("score", vectors.finite_or(F.col("score").cast("double"), 0.0))


def confirm(
    faces: DataFrame,
    directory_ids: DataFrame | None = None,
    explicit_ids: DataFrame | None = None,
    threshold: float = settings.PRODUCTION_THRESHOLD,
    now_ms: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Identity rows and their gallery rows from confirmed, sanitised faces.

    ``faces(name, ord, url, embedding)``. The id is the explicit one, else the
    directory's, else the name's slug. A name without a usable face yields no row.
    """
    trimmed = faces.withColumn("name", text.web_trim(F.col("name"))).where("name <> ''")
    names = trimmed.groupBy("name").agg(F.count("*").alias("references"))
    chosen = F.lit(None).cast("string")
    if directory_ids is not None:
        wanted = directory_ids.select("name", F.col("identity_id").alias("__directory"))
        names = names.join(wanted, "name", "left")
        chosen = F.coalesce(F.col("__directory"), chosen)
    if explicit_ids is not None:
        given = explicit_ids.select("name", F.col("identity_id").alias("__explicit"))
        names = names.join(given, "name", "left")
        chosen = F.coalesce(F.when(F.col("__explicit") != "", F.col("__explicit")), chosen)
    identities = names.select(
        F.coalesce(chosen, text.identity_id(F.col("name"))).alias("identity_id"),
        "name",
        F.lit(float(threshold)).alias("threshold"),
        F.lit(now_ms).cast("bigint").alias("created_at"),
        "references",
    )
    gallery = trimmed.join(identities.select("name", "identity_id"), "name").select(
        "identity_id", F.lit("embedding").alias("kind"), "ord", "embedding", F.col("url").alias("source")
    )
    return identities, gallery


def similar_pairs(
    faces: DataFrame, keys: list[str], minimum: float, block_rows: int = settings.BLOCK_ROWS, copies: bool = False
) -> DataFrame:
    """``(keys, ord_a, ord_b, cosine)`` of vectors at least ``minimum`` alike, ``ord_a`` the
    lesser. Scores are of unit-length rows.

    With ``copies`` all pairs of rows: copies of a vector are rows like any others, so ``n`` of
    them give all their ``n(n-1)/2`` pairs, and a task hands on those of two bounded blocks.
    Without, a copy is represented by the lowest ``ord`` carrying the vector.
    """
    rows = faces.select(*keys, F.col("ord").cast("bigint").alias("__ord"), "embedding")
    if not copies:
        rows = rows.groupBy(*keys, "embedding").agg(F.min("__ord").alias("__ord"))
    schema = T.StructType(
        [
            *[faces.schema[k] for k in keys],
            T.StructField("ord_a", T.LongType()),
            T.StructField("ord_b", T.LongType()),
            T.StructField("cosine", T.DoubleType()),
        ]
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = pa.Table.from_batches(batches)
        ords, block = task["__ord"].to_numpy(), task[blocks.BLOCK].to_numpy()
        unit = blocks.unit_rows(blocks.matrix(task["embedding"]))
        i_block = task[blocks.LEFT][0].as_py()
        same = i_block == task[blocks.RIGHT][0].as_py()
        left = np.nonzero(block == i_block)[0]
        right = left if same else np.nonzero(block != i_block)[0]
        task = task.select(keys)
        # strip by strip, so that a task never holds all its pairs
        for part in blocks.strips(len(left), len(right), 1_000_000):
            own = left[part]
            i, j, s = blocks.pairs_at_least(unit[own], unit[right], minimum)
            a, b = ords[own[i]], ords[right[j]]
            once = a < b if same else a != b
            i, s, a, b = i[once], s[once], a[once], b[once]
            found = (
                task.take(pa.array(own[i]))
                .append_column("ord_a", pa.array(np.minimum(a, b), pa.int64()))
                .append_column("ord_b", pa.array(np.maximum(a, b), pa.int64()))
                .append_column("cosine", pa.array(s, pa.float64()))
            )
            yield from found.combine_chunks().to_batches(100_000)

    spread = blocks.near_blocks(rows, keys, "__ord", "embedding", minimum, block_rows)
    columns = [*keys, "__ord", "embedding", blocks.BLOCK, blocks.LEFT, blocks.RIGHT]
    return (
        spread.select(*columns)
        .groupBy(*keys, blocks.LEFT, blocks.RIGHT)
        .applyInArrow(pairs, schema)
    )
