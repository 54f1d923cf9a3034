"""From readings to the best catalogue items, nested by reading and image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import match as M
from ..storage import cut


RAW = ("imprint_raw", "shape_guess", "color_guess")


def clean_readings(readings: DataFrame) -> DataFrame:
    """imprint from imprint_raw; missing guesses become empty strings."""
    return readings.select(
        "reading_id",
        T.post_fix_imprint(F.col("imprint_raw")).alias("imprint"),
        F.coalesce("shape_guess", F.lit("")).alias("shape_guess"),
        F.coalesce("color_guess", F.lit("")).alias("color_guess"),
    )


def raw_queries(readings: DataFrame) -> DataFrame:
    """Distinct (imprint_raw, shape_guess, color_guess) of readings with their imprint; nulls are empty strings.

    Readings repeat, so a text is cleaned once and not for each of them.
    """
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in RAW]
    return readings.select(*filled).distinct().withColumn("imprint", T.post_fix_imprint(F.col("imprint_raw")))


def best_of_queries(queries: DataFrame, items: DataFrame, ladder: bool = True, k: int = M.TOP) -> tuple[DataFrame, DataFrame]:
    """(imprint, shape_guess, color_guess, mode, item_idx, score, rank) of distinct queries, and the queries' modes."""
    imprints = queries.select("imprint").distinct()
    classes = cut(M.item_classes(items, k))
    seeds, text_scores = met_looks(imprints, classes)
    pairs = M.class_pairs(queries, M.best_by_class(seeds, classes, k))
    if ladder:
        pairs = cut(M.class_ladder(pairs))
    else:
        pairs = pairs.withColumn("mode", F.lit("single"))
    hit = M.topk_candidates(M.class_items(pairs), k)
    found = seeds.select("imprint").distinct()
    missed = cut(queries.join(found, "imprint", "left_anti"))
    rest, modes = M.fallback_topk(missed, classes, text_scores, ladder, k)
    # A query with candidates keeps its mode even where none of them scores.
    hit_modes = pairs.select(*M.QUERY, "mode").distinct() if ladder else queries.join(found, "imprint", "left_semi").withColumn("mode", F.lit("single"))
    columns = [*M.QUERY, "mode", "item_idx", "score", "rank"]
    return hit.select(*columns).union(rest.select(*columns)), hit_modes.union(modes)


def met_looks(imprints: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imprint, look, text_score) of the looks that seed an imprint, and of those that its text scores with."""
    looks = classes.select("look").distinct()
    text_scores = cut(M.look_scores(imprints, looks))
    seeds = M.seed_looks(imprints, looks).join(text_scores, ["imprint", "look"], "left")
    return cut(seeds.fillna(0, ["text_score"])), text_scores


def _candidates(best: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each query: its candidates by rank."""
    shown = items.select("item_idx", T.candidate_view().alias("view"))
    one = F.struct(F.col("rank"), F.struct("view.item_name", "view.entp_name", "score", T.match_level(F.col("score")).alias("match_level"), "view.imprint", "view.color", "view.shape", "item_idx").alias("candidate"))
    nested = best.join(shown, "item_idx").groupBy(*M.QUERY).agg(F.array_sort(F.collect_list(one)).alias("ranked"))
    return nested.select(*M.QUERY, F.col("ranked.candidate").alias("candidates"))


CANDIDATES = "array<struct<item_name:string,entp_name:string,score:int,match_level:string,imprint:string,color:string,shape:string,item_idx:bigint>>"


def identify_batch(readings: DataFrame, items: DataFrame, ladder: bool = True, k: int = M.TOP) -> DataFrame:
    """reading_id, ocr_text, ocr_variants, shape_guess, color_guess, candidates, note for every reading.

    The ladder is that of images with several regions; without it this is the one-pill path.
    """
    raw = cut(raw_queries(readings))
    queries = cut(raw.select(*M.QUERY).distinct())
    best, modes = best_of_queries(queries, items, ladder, k)
    answers = modes.join(_candidates(best, items), list(M.QUERY), "left")
    answers = answers.withColumn("ocr_variants", T.ocr_variants(F.col("imprint")))
    note = T.pill_note(F.col("imprint"), F.col("mode"), "batch" if ladder else "single")
    filled = readings.select("reading_id", *[F.coalesce(c, F.lit("")).alias(c) for c in RAW])
    out = filled.join(raw.join(answers, list(M.QUERY)), list(RAW))
    return out.select(
        "reading_id",
        F.col("imprint").alias("ocr_text"),
        "ocr_variants",
        F.nullif("shape_guess", F.lit("")).alias("shape_guess"),
        F.nullif("color_guess", F.lit("")).alias("color_guess"),
        F.coalesce("candidates", F.array().cast(CANDIDATES)).alias("candidates"),
        note.alias("note"),
    )


def identify_one_batch(readings: DataFrame, items: DataFrame, k: int = M.TOP) -> DataFrame:
    """The one-pill path: all candidates of an imprint are scored."""
    return identify_batch(readings, items, ladder=False, k=k)


def nest_response(results: DataFrame, regions: DataFrame, note: str = "") -> DataFrame:
    """(image_id, pills, and the first pill's fields) from results and (reading_id, image_id, roi_index)."""
    pill = F.struct("roi_index", "reading_id", "ocr_text", "ocr_variants", "color_guess", "shape_guess", "candidates", "note")
    pills = results.join(regions, "reading_id").groupBy("image_id").agg(F.array_sort(F.collect_list(pill)).alias("pills"))
    first = F.get("pills", F.lit(0))
    flat = [first.getField(c).alias(c) for c in ("ocr_text", "ocr_variants", "color_guess", "shape_guess", "candidates")]
    return pills.select("image_id", "pills", *flat, F.lit(note).alias("note"))
