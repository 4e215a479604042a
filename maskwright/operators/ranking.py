"""Scoring, deduplicating and ranking candidate photos by the text around them."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright import settings
from maskwright.functions import text
from maskwright.functions.bind import let
from maskwright.operators import blocks, terms

# The vocabulary and weights scores depend on. All of it can be replaced
# by passing other Rules.
NON_PHOTO = (
    "signature", "autograph", "logo", "seal", "coat of arms", "flag", "map", "chart",
    "diagram", "schematic", "poster", "book cover", "album", "soundtrack", "manuscript",
    "banknote", "stamp", "coin", "grave", "tomb", "headstone", "memorial", "plaque",
    "fleuron", "ornament", "blue plaque", "caricature", "cartoon", "drawing", "sketch",
    "illustration", "engraving", "engraved", "lithograph", "etching", "woodcut", "aquatint",
)
LOOKALIKE = (
    "impersonator", "impersonators", "impersonation", "lookalike", "look-alike",
    "look alike", "wax figure", "waxwork", "wax museum", "tussauds", "statue", "mannequin",
    "dummy", "puppet", "cosplay", "mask",
)
FABRICATED = (
    "ai generated", "midjourney", "stable diffusion", "dall e", "deepfake", "cgi render",
    "generated image",
)
CROWD = (
    "family", "crowd", "audience", "delegation", "group photo", "cabinet meeting",
    "with wife", "with husband", " and wife", " and husband",
)
COMPOSITION = ("portrait", "headshot", "closeup", "close up", "official", "photo")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")
JOINERS = ("and", "with")


@dataclass(frozen=True)
class Rules:
    """Scoring vocabulary and weights."""

    full_name: float = 0.75
    all_tokens: float = 0.15
    coverage: float = 0.1
    file_name: float = 0.15
    alias: float = 0.1
    composition: float = 0.05
    composition_terms: tuple[str, ...] = COMPOSITION
    negative: tuple[tuple[tuple[str, ...], float], ...] = field(
        default=((NON_PHOTO, 0.1), (LOOKALIKE, 0.05), (FABRICATED, 0.05), (CROWD, 0.6))
    )
    suffix: float = 0.1
    co_subject: float = 0.5

    def groups(self) -> list[tuple[str, str, float, tuple[str, ...]]]:
        """The vocabulary as groups of a rule table (see ``terms.table``): a ``bonus`` is
        added, a ``penalty`` multiplies, in the order of groups."""
        return [
            ("file", "bonus", self.composition, self.composition_terms),
            *(("hay", "penalty", factor, terms) for terms, factor in self.negative),
        ]

    def best_without_full_name(self) -> float:
        return max(self.all_tokens, self.coverage) + self.file_name + self.alias + self.composition


def _any_term(haystack: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(
        F.array(*[F.lit(t) for t in terms]), lambda t: text.has_term(haystack, t)
    )


def _texts(name: Column, filename: Column, caption: Column) -> Column:
    """The normalised texts of a candidate, as one struct."""
    file, caption = F.coalesce(filename, F.lit("")), F.coalesce(caption, F.lit(""))
    hay = text.normalize_text(F.concat(file, F.lit(" "), caption))
    name_tokens = text.tokens(text.normalize_text(name))
    return let(
        F.struct(hay.alias("hay"), name_tokens.alias("want")),
        lambda t: F.struct(
            t["hay"].alias("hay"),
            text.strip_initials(text.normalize_text(file)).alias("file"),
            text.strip_initials(t["hay"]).alias("contig"),
            text.tokens(t["hay"]).alias("present"),
            t["want"].alias("want"),
            F.array_join(t["want"], " ").alias("full"),
        ),
    )


def _score(texts: Column, aliases: Column, rules: Rules, found: tuple[Column, Column] | None = None) -> Column:
    """``found``: bonuses and penalties of a rule table, in place of those of ``rules``."""

    def judge(t: Column) -> Column:
        hay, contig, file = t["hay"], t["contig"], t["file"]
        full, wanted, present = t["full"], t["want"], t["present"]
        at = F.instr(contig, full)
        hit = F.contains(contig, full)
        covered = F.size(F.filter(wanted, lambda w: F.array_contains(present, w)))
        total = F.size(wanted)
        base = (
            F.when(hit, rules.full_name)
            .when(covered == total, rules.all_tokens)
            .otherwise(rules.coverage * (covered / F.greatest(total, F.lit(1))))
        )
        cleaned = F.transform(aliases, lambda a: text.strip_initials(text.normalize_text(a)))
        alias_hit = F.exists(cleaned, lambda a: (F.length(a) >= 3) & F.contains(contig, a))
        score = base + F.when(F.contains(file, full), rules.file_name).otherwise(0.0)
        score = score + F.when(
            F.when(hit, False).otherwise(F.coalesce(alias_hit, F.lit(False))), rules.alias
        ).otherwise(0.0)
        if found is None:
            score = score + F.when(
                _any_term(file, rules.composition_terms), rules.composition
            ).otherwise(0.0)
            for words, factor in rules.negative:
                score = score * F.when(_any_term(hay, words), factor).otherwise(1.0)
        else:
            score = F.aggregate(found[0], score, lambda total, x: total + x)
            score = F.aggregate(found[1], score, lambda total, x: total * x)
        following = F.split(F.trim(F.substring(contig, at + F.length(full), F.length(contig))), " ")[0]
        preceding = F.element_at(F.split(F.trim(F.substring(contig, F.lit(1), at - 1)), " "), -1)
        score = score * F.when(hit & following.isin(*SUFFIXES), rules.suffix).otherwise(1.0)
        score = score * F.when(
            hit & (following.isin(*JOINERS) | preceding.isin(*JOINERS)), rules.co_subject
        ).otherwise(1.0)
        clamp = lambda s: F.when(F.isnan(s), 0.0).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
        )
        return F.when((hay == "") | (total == 0), 0.0).otherwise(let(score, clamp))

    return let(texts, judge)


def score_candidates(
    candidates: DataFrame,
    aliases: DataFrame | None = None,
    rules: Rules = Rules(),
    floor: float | None = None,
    table: DataFrame | None = None,
) -> DataFrame:
    """Add ``score`` (0..1) to ``candidates(name, filename, caption, ...)``.

    ``table`` is a rule table of the user's own (see ``terms``) for the targets ``hay``
    (file name and caption, normalised) and ``file`` (file name, without single letters),
    in place of the terms in ``rules``. The page title is never scored. Without a contiguous full-name hit a score cannot
    reach ``rules.best_without_full_name()``; when ``floor`` is above that, rows without
    the hit are dropped before the costly part.
    """
    rows = candidates
    texts = _texts(F.col("name"), F.col("filename"), F.col("caption"))
    if table is not None:
        held = table.groupBy("group_ord").agg(F.first("kind").alias("kind"), F.first("weight").alias("weight")).orderBy("group_ord").collect()
        bonuses = {r.group_ord: r.weight for r in held if r.kind == "bonus"}
        best = dataclasses.replace(rules, composition=sum(max(0.0, w) for w in bonuses.values())).best_without_full_name()
        penalties = {r.group_ord: r.weight for r in held if r.kind == "penalty"}
        best *= math.prod(max(1.0, w) for w in penalties.values())
    else:
        best = rules.best_without_full_name()
    if floor is not None and floor > best + 1e-9:
        hit = let(texts, lambda t: (t["full"] != "") & F.contains(t["contig"], t["full"]))
        rows = rows.where(hit)
    if aliases is not None:
        rows = rows.join(
            aliases.select("name", F.col("aliases").alias("__aliases")), "name", "left"
        )
    else:
        rows = rows.withColumn("__aliases", F.array().cast("array<string>"))
    found = None
    if table is not None:
        rows = terms.find_groups(
            rows.withColumns({"__hay": let(texts, lambda t: t["hay"]), "__file": let(texts, lambda t: t["file"])}),
            table.withColumn("target", F.concat(F.lit("__"), "target")), ["__hay", "__file"], "__groups",
        )
        weights = lambda of: F.transform(
            F.filter("__groups", lambda g: g.isin(*of)) if of else F.array().cast("array<int>"),
            lambda g: F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), g) if of else F.lit(1.0),
        )
        found = (weights(bonuses), weights(penalties))
    scored = rows.withColumn("score", _score(texts, F.col("__aliases"), rules, found)).drop("__aliases")
    if table is not None:
        scored = scored.drop("__groups", "__hay", "__file")
    return scored if floor is None else scored.where(F.col("score") >= floor)


def first_per_url(candidates: DataFrame) -> DataFrame:
    """Usable photos only, the first of each URL key per name in source order."""
    usable = candidates.where(text.is_usable_photo(F.col("url"))).withColumn(
        "__key", text.url_key(F.col("url"))
    )
    first = Window.partitionBy("name", "__key").orderBy("source_ord", "ord")
    return (
        usable.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__key")
    )


def rank_candidates(
    candidates: DataFrame,
    aliases: DataFrame | None = None,
    floor: float = settings.RELEVANCE_FLOOR,
    limit: int = settings.CANDIDATE_LIMIT,
    rules: Rules = Rules(),
) -> DataFrame:
    """Best candidates per name: ``rank`` 1.. by score, ties in source order.

    The URL dedup runs before the floor, so a dropped first copy does not let a later
    copy in. A top-k report: both row_number filters are applied map-side as well.
    """
    scored = score_candidates(first_per_url(candidates), aliases, rules, floor)
    order = Window.partitionBy("name").orderBy(F.desc("score"), "source_ord", "ord")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def resolve_titles(unresolved: DataFrame, imageinfo: DataFrame, **sizes) -> DataFrame:
    """Article image titles without a URL, joined to the repository's image records; one title
    may be that of many names and many records."""
    wanted = (
        unresolved.where("url = ''")
        .groupBy("name", F.col("filename").alias("__title"))
        .agg(F.min("ord").alias("__ord"))
    )
    own = [c for c in ("name", "ord", "page_title") if c in imageinfo.columns]
    info = imageinfo.withColumn("__title", F.col("filename")).withColumnsRenamed({c: "__own_" + c for c in own})
    return (
        blocks.dealt_join(wanted, info, "__title", **sizes)
        .withColumn("ord", F.col("__ord"))
        .withColumn("page_title", F.col("name"))
        .drop("__title", "__ord", *["__own_" + c for c in own])
    )


def expand_categories(categories: DataFrame, category_files: DataFrame, **sizes) -> DataFrame:
    """Files of each name's repository category."""
    return blocks.dealt_join(categories.select("name", "category"), category_files, "category", **sizes).drop("category")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources in their fixed order, as ``source_ord``."""
    out = None
    for position, source in enumerate(sources):
        part = source.withColumn("source_ord", F.lit(position))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def query_ledger(names: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """What was asked for each name: three fixed questions, and one per category found."""
    asked = names.select(
        "name",
        F.explode(
            F.array(
                F.struct(F.lit("encyclopedia").alias("endpoint"), F.col("name").alias("term")),
                F.struct(F.lit("knowledge").alias("endpoint"), F.col("name").alias("term")),
                F.struct(F.lit("repository").alias("endpoint"), F.col("name").alias("term")),
            )
        ).alias("q"),
    ).select("name", "q.endpoint", "q.term")
    if categories is None:
        return asked
    return asked.unionByName(
        categories.select(
            "name",
            F.lit("repository").alias("endpoint"),
            F.concat(F.lit("incategory:"), "category").alias("term"),
        )
    )


def completeness(names: DataFrame, responses: DataFrame, expected: int) -> DataFrame:
    """``(name, sources, complete)``: whether every expected source answered."""
    landed = responses.groupBy("name").agg(F.count_distinct("source").alias("sources"))
    return names.join(landed, "name", "left").select(
        "name",
        F.coalesce("sources", F.lit(0)).alias("sources"),
        (F.coalesce("sources", F.lit(0)) >= expected).alias("complete"),
    )
