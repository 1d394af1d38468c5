"""What lets the steps grow with their input: code the JVM compiles, no broadcast of large sides, boxes that move once."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from secondpass.functions import digests, geometry
from secondpass.operators import resampling, routing, spatial, tables
from secondpass.session import pin


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_box_code_stays_small_enough_to_be_compiled(spark):
    rows = spark.range(8).selectExpr(
        "double(id) AS xa", "double(id + 1) AS ya", "double(id + 2) AS xb", "if(id = 3, double('NaN'), double(id + 3)) AS yb",
        "element_at(array('TopLeft', 'BOTTOM-LEFT', 'center'), int(id % 3 + 1)) AS origin")
    box = geometry.to_top_left(*[F.col(c) for c in ("xa", "ya", "xb", "yb", "origin")], F.lit(100.0))
    boxes = rows.select(box.alias("b")).select("b.*")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan(boxes, "codegen"))]
    assert sizes and max(sizes) < 8000  # longer methods are interpreted
    assert [tuple(r) for r in boxes.collect()] == [
        (0, 1, 2, 3), (1, 96, 3, 98), (None,) * 4, (None,) * 4, (4, 93, 6, 95), (None,) * 4, (6, 7, 8, 9), (7, 90, 9, 92)]


def grid_boxes(spark, keys, shift):
    return spark.range(keys * 12).selectExpr(
        "id % 12 AS n", "concat('k', id div 12) AS k", f"double(id % 3 * 100 + {shift}) AS x0", "double(id % 12 div 3 * 20) AS y0",
        f"double(id % 3 * 100 + {shift} + 90) AS x1", "double(id % 12 div 3 * 20 + 18) AS y1")


def test_bounded_box_pairs_equal_tiled_ones(spark):
    a, b = grid_boxes(spark, 5, 0).withColumnRenamed("n", "i"), grid_boxes(spark, 5, 40).withColumnRenamed("n", "j")
    tiled, plain = spatial.box_pairs(a, b, "k", 1024.0), spatial.box_pairs(a, b, "k", 1024.0, bounded=True)
    assert sorted(map(tuple, plain.select(*tiled.columns).collect())) == sorted(map(tuple, tiled.collect())) != []
    assert "Generate" in plan(tiled) and "Generate" not in plan(plain)  # a box moves once


def test_bounded_attach_text_equals_tiled_one(spark):
    cells = grid_boxes(spark, 3, 0).selectExpr("k", "int(n) AS cell_no", *spatial.SIDES)
    records = grid_boxes(spark, 3, 40).selectExpr("k", "n AS record_no", "concat(' t', n, ' ') AS text", *spatial.SIDES)
    for least in (0.0, 0.5, 0.8):
        some, other = (spatial.attach_text(records, cells, "k", least, 1024.0, bounded=b) for b in (True, False))
        for x, y in zip(some, other):
            assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())) != []


def test_merged_spans_are_not_broadcast(spark):
    objects = pin(spark.sql("""SELECT concat('s', id) AS sample_id, o.* FROM range(20), VALUES
      (0, 'table', 0D, 0D, 190D, 18D), (1, 'table row', 0D, 0D, 190D, 18D), (2, 'table column', 0D, 0D, 90D, 18D),
      (3, 'table column', 100D, 0D, 190D, 18D), (4, 'table spanning cell', 0D, 0D, 190D, 18D) AS o(object_no, category, x0, y0, x1, y1)"""))
    grid, _ = spatial.base_grid(objects, bounded=True)
    merged, problems = spatial.merge_spans(grid, objects, bounded=True)
    assert "BroadcastExchange" not in plan(merged)
    assert problems.count() == 0 and [r["column_end"] for r in merged.collect()] == [2] * 20


def test_overlaps_of_bounded_tables_move_each_cell_once(spark):
    cells = spark.range(60).selectExpr(
        "concat('k', id div 6) AS sample_id", "id % 6 AS cell_no", "int(id % 6 div 3) AS row_start", "int(id % 6 div 3 + 1) AS row_end",
        "int(if(id = 8, 1, id % 3)) AS column_start", "int(id % 3 + 1) AS column_end", "'x' AS text")
    found = tables.validate_cells(cells, bounded=True)
    assert [tuple(r) for r in found.collect()] == [("k1", 2, "cells overlap")]
    assert [tuple(r) for r in tables.validate_cells(cells).collect()] == [("k1", 2, "cells overlap")]


def test_hashes_of_many_texts_equal_the_library():
    texts = [b"", b"0", "é\U0001f600".encode(), *[b"%d" % i for i in range(1200)], *[b"x" * n for n in range(40, 70)]]
    tails = digests.Tails(texts)
    for prefix in (b"", b"s:0:", b"protocol:4999:", b"p" * 53, b"p" * 90):
        assert tails.bits(prefix).tolist() == [int(hashlib.md5(prefix + t).hexdigest()[:13], 16) for t in texts]


def test_bootstraps_draw_by_the_published_hash(spark, monkeypatch):
    rows = [(f"r{i:03d}", float(i * i % 17), 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "sample_id string, a double, b double")
    def bits(repetition, position):
        return int(hashlib.md5(f"s:{repetition}:{position}".encode()).hexdigest()[:13], 16)
    values = [a - b for _, a, b in rows]
    means = [np.mean([values[bits(k, i) % 90] for i in range(90)]) for k in range(30)]
    bounds = resampling._poisson_bounds()
    weights = [[sum((bits(k, name) + 0.5) / (1 << 52) >= b for b in bounds) for name, _, _ in rows] for k in range(30)]
    weighted = [np.dot(w, values) / sum(w) for w in weights]
    for method, wanted in (("draws", means), ("poisson", weighted)):
        row = resampling.paired_bootstrap(df, "a", "b", "s", 30, method=method).first()
        assert (row["lower"], row["upper"]) == pytest.approx(tuple(np.percentile(wanted, [2.5, 97.5])))
        assert row["replicates"] == 30 and row["observed"] == pytest.approx(np.mean(values))
    # Neither a row per draw nor one task that holds an array in the driver.
    asked = plan(resampling.paired_bootstrap(df, "a", "b", "s", 30, method="poisson"))
    assert "Generate" not in asked and "MapInArrow" in asked
    none = resampling.paired_bootstrap(df.where("a < 0"), "a", "b", "s", 30).first()
    assert none["observed"] is None and none["lower"] is None and none["replicates"] == 30


def test_random_keys_are_compared_without_parsing_them(spark):
    keys = spark.range(500).selectExpr("string(id) AS i").select(routing.random_key("s", F.lit(1), "i").alias("k"))
    for bound in (0.0, 16.0**12 + 0.5, 16.0**13 / 3, 16.0**13 - 1, 16.0**13):
        wrong = keys.where(routing._below(F.col("k"), bound) != (routing._prefix(F.col("k")) < bound))
        assert wrong.count() == 0
    assert "conv(" not in plan(keys.where(routing._below(F.col("k"), 16.0**12)))


def test_permutation_reliance_moves_no_wide_rows_times_units(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from secondpass.operators import aggregates, learning

    n, repetitions = 240, 2
    draw = np.random.default_rng(3)
    names = ["a", "b"]
    rows = [(f"s{i:03d}", f"g{i % 4}", i % 2, float(draw.integers(0, 6)), None if i % 17 == 0 else float(draw.integers(0, 9)),
             float(draw.integers(0, 8)), 0.5, 0.5, "success", 0.75, 0.5, 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, issuer string, fold int, benefit double, a double, b double, primary_con double, "
                               "primary_top double, expert_status string, expert_con double, expert_top double, expert_seconds double")
    models = {(f, "p"): learning.RidgeModel(("a", "b"), {"a": 4.0, "b": 3.0}, [0.5 + f, -0.25], 0.1, {}) for f in range(2)}
    units = {name: (name,) for name in names} | {f"{name}{i}": (name,) for name in names for i in range(4)}

    pinned, real = [], learning.pin
    monkeypatch.setattr(learning, "pin", lambda part, *args: pinned.append(real(part, *args)) or pinned[-1])
    found = {(r["unit"], r["measure"]): r["mean"] for r in learning.permutation_reliance(
        df, models, "benefit", 20, repetitions, "seed", features=names, units=units).collect()}
    assert max(part.count() for part in pinned) <= n * repetitions

    # The plain way: every permuted table predicted, measured and ranked by itself.
    donors = df.select(F.col("sample_id").alias("donor"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    moved = learning.within_group_permutation(df, "issuer", repetitions, "seed").join(donors, "donor").join(df, "sample_id")
    plain = learning.held_out_predictions(df.withColumn("repetition", F.lit(-1)), models, ["repetition", "benefit"])
    assert found.keys() == {(u, m) for u in units for m in ("mse_increase", "spearman_drop", "quality_drop")}
    before = (aggregates.mean_squared_error(plain, "prediction", "benefit").first()["mse"],
              aggregates.spearman(plain, "prediction", "benefit").first()["value"])
    for name in names:
        swapped = moved.withColumn(name, F.col(f"_{name}"))
        after = learning.held_out_predictions(swapped, models, ["repetition", "benefit"])
        mse = aggregates.mean_squared_error(after, "prediction", "benefit", ["repetition"]).agg(F.avg("mse")).first()[0]
        rank = aggregates.spearman(after, "prediction", "benefit", ["repetition"]).agg(F.avg("value")).first()[0]
        assert abs(found[name, "mse_increase"] - (mse - before[0])) < 1e-9
        assert abs(found[name, "spearman_drop"] - (before[1] - rank)) < 1e-9


def test_cell_features_need_no_python_for_plain_texts(spark):
    from pyspark.sql import functions as F

    from secondpass.functions import text
    from secondpass.operators import features

    texts = ["", " ", None, "12", "-3%", " 4 5 ", "A", "a1", "1998-01-02", "x 7", "é", "é 1", "½", "１", "12abc", "1\n2", " 5", "12_", "+", "(3)"]
    rows = [(f"t{i}", i, r, r + 1, 0, 1, value, 0.0, 0.0, 1.0, 1.0) for i, value in enumerate(texts) for r in (0,)]
    cells = spark.createDataFrame(rows, "sample_id string, i int, row_start int, row_end int, column_start int, column_end int, text string, "
                                  "x0 double, y0 double, x1 double, y1 double")
    normal = text.normalize_text(F.col("text"))
    wanted = {r["sample_id"]: (r["e"], r["n"]) for r in cells.select(
        "sample_id", (normal == "").cast("double").alias("e"), text.is_numeric_looking(normal).cast("double").alias("n")).collect()}
    found = {r["sample_id"]: (r["empty_cell_ratio"], r["numeric_looking_cell_ratio"]) for r in features.cell_features(cells).collect()}
    assert found == wanted

    odd = features.undecided_texts(cells).select("text").collect()
    assert {r["text"] for r in odd} == {"a1", "x 7", "é", "é 1", "½", "１", "12abc", " 5", "12_", "(3)", " 4 5 ", "1\n2", " "}
