"""What meets in joins grows with distinct prints, readings and regions, not with how often they repeat."""

from pyspark.sql import functions as F
from test_contract import test_rows as same_rows

from imprintmatch.operators import match as M
from imprintmatch.plans import identify as I


def test_seeds_by_looks(spark):
    """Repeated items add no pair; counts and sums are those of all items."""
    prints = [("DW-1", None), ("dw1", "PAC"), ("AB 12", " 12"), (None, None), ("", "X"), ("12 AB", None)]
    items = spark.createDataFrame([(k, *prints[k % 6]) for k in range(120)], "item_idx long, print_front string, print_back string")
    imprints = spark.createDataFrame([("AB 12",), ("PAC",), ("DW1",), ("ZZ",), ("",)], "imprint string")
    looks = M.print_looks(items)
    assert looks.agg(F.sum("n"), F.sum("idx_sum")).first()[:] == (120, sum(range(120)))
    pairs = M.seed_candidates(imprints, M.build_print_index(looks))
    assert pairs.count() == M.seed_candidates(imprints, M.build_print_index(items.filter("item_idx < 6"))).count() - 1  # two orders of AB 12 are one look
    by_look = pairs.join(looks, "item_idx").groupBy("imprint").agg(F.sum("n"), F.sum("idx_sum"))
    by_item = M.seed_candidates(imprints, M.build_print_index(items)).groupBy("imprint").agg(F.count("*"), F.sum("item_idx"))
    assert by_look.count() > 2 and sorted(by_look.collect()) == sorted(by_item.collect())


def test_raw_queries_are_the_readings_queries(spark):
    rows = [(i, *r) for i, r in enumerate(3 * [("d-w1 ", None, "x"), (None, "", None), ("", None, ""), ("ab?12", "s", None), ("?ab 12", "s", "")])]
    readings = spark.createDataFrame(rows, "reading_id long, imprint_raw string, shape_guess string, color_guess string")
    raw = I.raw_queries(readings)
    assert raw.count() == 4
    assert set(raw.select(*M.QUERY).collect()) == set(I.clean_readings(readings).select(*M.QUERY).collect())


def test_seed_candidates_rows(spark):
    same_rows(spark, "seed_candidates")


def test_counts_of_classes_read_no_text_scores(spark):
    """Flags are counted from seeds and classes alone, and agree with the classes that hold the best items."""
    items = spark.createDataFrame([(k, f"A{k % 3}", ["PAC", None][k % 2], ["원형", "타원형", None][k % 3], "하양", None) for k in range(90)], "item_idx long, print_front string, print_back string, drug_shape string, color_class1 string, color_class2 string")
    queries = spark.createDataFrame([("A1", "원형", ""), ("A1 PAC", "", "흰색"), ("ZZ", "", "")], "imprint string, shape_guess string, color_guess string")
    classes = M.item_classes(items)
    seeds, _ = I.met_looks(queries.select("imprint").distinct(), classes)
    pairs = M.class_pairs(queries, M.best_by_class(seeds, classes))
    counts = M.class_counts(queries, M.seed_looks(queries.select("imprint").distinct(), classes.select("look").distinct()), classes)
    assert sorted(map(str, counts.collect())) == sorted(map(str, pairs.select(*counts.columns).collect())) and counts.count() > 3
    # The best five of a class: of equal texts the lowest items, over all looks.
    best = {(r.imprint, r.drug_shape): [(b.less, b.item_idx) for b in r.best] for r in pairs.collect()}
    text = {(r.imprint, r.item_idx): r.text_score for r in M.text_score_join(queries.select("imprint").distinct(), items).collect()}
    own = {(r.imprint, r.item_idx, r.drug_shape) for r in M.seed_candidates(queries.select("imprint"), M.build_print_index(items)).join(items, "item_idx").collect()}
    for (imprint, shape), got in best.items():
        assert got == sorted((-text.get((i, k), 0), k) for i, k, s in own if (i, s) == (imprint, shape))[:5]
