import random

import numpy as np
import pandas as pd
import pytest

from labtables.functions.status import good_barcode
from labtables.operators import plate as P
from labtables.plans.plate_report import PlateInputs, grids, overview, plate_stats


def test_pivot_types_fills_missing_with_zero(spark):
    long = spark.createDataFrame(
        [("a", "exon", 3), ("a", "intron", 4), ("b", "exon", 5), ("b", "other", 9), ("c", "other", 1)],
        "bc string, type string, n long",
    )
    out = P.pivot_types(long, ["bc"], "type", "n", {"exon": "exon", "intron": "intron"}, with_total="total")
    assert {r.bc: (r.exon, r.intron, r.total) for r in out.collect()} == {
        "a": (3, 4, 7),
        "b": (5, 0, 14),
        "c": (0, 0, 1),
    }


def test_bad_barcode_is_dropped(spark):
    df = spark.createDataFrame([("bad",), ("Bad",), ("AC",), (None,)], "bc string")
    assert {r.bc for r in df.where(good_barcode("bc")).collect()} == {"Bad", "AC", None}


@pytest.mark.parametrize(
    ("reagent", "barcodes"), [("1.5", ["A1", "A2"]), ("1.0", ["N1", "N2"]), ("9", ["A1", "A2"])]
)
def test_reagent_selects_the_barcode_column(spark, reagent, barcodes):
    lookup = spark.createDataFrame(
        [("1A", "A1", "A1", "N1"), ("1A", "B1", "A2", "N2"), ("2A", "A1", "C", "D")],
        "BCset string, WellID string, XC string, XC_NovaSeq string",
    )
    assert sorted(r.barcode for r in P.wells_for_set(lookup, "1A", reagent).collect()) == barcodes


def test_cell_counts_keeps_empty_cells(spark):
    cells = spark.createDataFrame([("x",), ("y",), ("z",)], "cell string")
    counts = spark.createDataFrame(
        [("x", "g1", 3), ("x", "g2", 0), ("x", "g3", 2), ("y", "g1", 0)], "cell string, gene string, count long"
    )
    found = {r.cell: (r.umi_reads, r.umi_genes) for r in P.cell_counts(cells, counts, ["cell"], "count").collect()}
    assert found == {"x": (5, 2), "y": (0, 0), "z": (0, 0)}


def test_array_cell_counts(spark):
    df = spark.createDataFrame([("x", [3, 0, 2]), ("y", []), ("z", [0, None])], "cell string, n array<long>")
    found = {r.cell: (r.umi_reads, r.umi_genes) for r in P.array_cell_counts(df, ["cell"], "n").collect()}
    assert found == {"x": (5, 2), "y": (0, 0), "z": (0, 0)}


def test_join_counts_needs_both_sides_of_a_plate(spark):
    stats = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 3)], "plate string, bc string, n long")
    counts = spark.createDataFrame([("p", "b", 5), ("p", "c", 6), ("r", "a", 7)], "plate string, bc string, m long")
    found = {(r.plate, r.bc): (r.n, r.m) for r in P.join_counts(stats, counts, "plate", ["plate", "bc"]).collect()}
    assert found == {("p", "a"): (1, None), ("p", "b"): (2, 5), ("p", "c"): (None, 6)}


def test_plates_of_all_tables(spark):
    def plates(*names):
        return spark.createDataFrame([(n, 1) for n in names], "plate string, x int")

    tables = [plates("p", "p", "q", None), plates("p", "q", "r", None), plates("q", "p", "s")]
    assert {r.plate for r in P.plates_of_all(tables, "plate").collect()} == {"p", "q"}
    assert P.plates_of_all([*tables, plates()], "plate").collect() == []


def test_a_plate_without_wells_takes_no_part(spark):
    plates = spark.createDataFrame([("p", "S0"), ("q", "unknown")], "plate string, barcode_set string")
    lookup = spark.createDataFrame([("S0", "A1", "b", "")], "BCset string, WellID string, XC string, XC_NovaSeq string")
    long = spark.createDataFrame([(p, "b", 3, "exon") for p in ("p", "q", "x")], "plate string, barcode string, n long, type string")
    wells = long.select("plate", "barcode")
    inputs = PlateInputs(plates, lookup, long, long, wells.selectExpr("*", "1 AS tagged"), wells, wells.selectExpr("*", "2 AS count"))
    assert [(r.plate, r.well, r.umi_reads) for r in plate_stats(inputs, {"exon": "exon"}).collect()] == [("p", "A1", 2)]


def test_overview_rounds_like_python(spark):
    totals = [0, 999_999, 6_000_000, 18_999_999, 30_000_001, 123_456_789]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(totals)], "plate long, reads long")
    for row in P.plate_overview(df, "plate", "reads").collect():
        millions = int(totals[row.plate] / 1000000)
        assert row.filtered_reads_m == millions
        assert row.avg_reads_per_cell_k == round(millions / 384 * 1000, 2)


def test_null_share_gate(spark):
    rows = [("p", None, i) for i in range(2)] + [("p", 1, i) for i in range(8)]
    rows += [("q", None, 1)] + [("q", 1, None)] + [("q", 1, 1)] * 2
    df = spark.createDataFrame(rows, "plate string, a long, b long")
    found = {r.plate: (r.n_nulls, r.n_values, r.null_percent, r.passes) for r in P.null_share(df, ["plate"], ["a", "b"]).collect()}
    assert found == {"p": (2, 20, 10.0, True), "q": (2, 8, 25.0, False)}


def loop_grid(rows):
    layout = np.zeros((16, 24))
    for _, well, value in rows:
        if well is not None:
            layout[ord(well[0]) - 65, int(well[1:]) - 1] = value
    return layout


def test_grid_and_sizes_against_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for at in range(300):
        well = None if rng.random() < 0.1 else f"{chr(65 + rng.randrange(16))}{rng.randrange(24) + 1}"
        rows.append((at, well, rng.randrange(0, 50)))
    df = spark.createDataFrame([("p", *r) for r in rows], "plate string, at long, well string, v long")
    grid = P.plate_grid(df, "plate", "well", "at", ["v"])
    sized = P.scaled_size(grid, "plate", "v").toPandas()
    expected = loop_grid(rows)
    assert len(sized) == 384
    size = (expected - expected.min()) / (expected.max() - expected.min()) * 190 + 10
    for row in sized.itertuples():
        assert row.v == expected[row.row, row.col]
        assert row.size == pytest.approx(size[row.row, row.col])
    legend = P.size_legend(grid, "plate", "v").first()
    assert (legend.legend_min, legend.legend_mid, legend.legend_max) == (
        int(expected.min()),
        int(expected.max() / 2),
        int(expected.max()),
    )


def test_log_of_zero_and_flat_plates_are_null(spark):
    df = spark.createDataFrame([("p", 1, "A1", 4), ("p", 2, "A2", 16), ("q", 1, None, 5)], "plate string, at long, well string, v long")
    grid = P.plate_grid(df, "plate", "well", "at", ["v"])
    logs = P.scaled_size(grid, "plate", "v", log=True)
    p = {(r.row, r.col): r.size for r in logs.where("plate = 'p'").collect()}
    assert (p[0, 0], p[0, 1], p[5, 5]) == (10.0, 200.0, None)
    flat = P.scaled_size(grid, "plate", "v").where("plate = 'q'").collect()
    assert len(flat) == 384
    assert all(r.size is None and r.v == 0 for r in flat)


def pandas_report(plates, lookup, reads, genes, umi, counts):
    """The report of each plate with pandas, one plate at a time."""
    out = {}
    for plate, barcode_set in plates:
        wells = lookup[lookup.BCset == barcode_set].set_index("XC")[["WellID"]]
        r = reads[(reads.plate == plate) & (reads.barcode != "bad")].groupby("barcode").n.sum().rename("total_reads")
        g = genes[genes.plate == plate].pivot_table(index="barcode", columns="type", values="n", aggfunc="sum").fillna(0)
        u = umi[umi.plate == plate].set_index("barcode")[["tagged"]]
        stats = wells.join(r).join(u).join(g)
        c = counts[counts.plate == plate].groupby("barcode")["count"].agg(["sum", lambda x: int((x != 0).sum())])
        if stats.empty or c.empty:
            continue
        both = pd.concat([stats, c], axis=1)
        share = both.isna().sum().sum() / both.size * 100
        out[plate] = (share, int(both.total_reads.sum() / 1000))
    return out


def test_plate_report_against_pandas(spark):
    rng = random.Random(5)
    lookup = pd.DataFrame(
        [(f"S{s}", f"{chr(65 + i // 4)}{i % 4 + 1}", f"bc{s}_{i}", "") for s in range(2) for i in range(12)],
        columns=["BCset", "WellID", "XC", "XC_NovaSeq"],
    )
    plates = [(f"p{i}", f"S{i % 2}") for i in range(6)]
    reads, genes, umi, counts = [], [], [], []
    for plate, barcode_set in plates[:5]:  # the last plate has no data
        for i in range(12):
            barcode = f"bc{barcode_set[1]}_{i}"
            if rng.random() < (0.5 if plate == "p0" else 0.02):
                continue
            reads += [(plate, barcode, rng.randrange(5000), t) for t in ("x", "y")]
            genes += [(plate, barcode, rng.randrange(50), t) for t in ("exon", "intron")]
            umi.append((plate, barcode, rng.randrange(90)))
            counts += [(plate, barcode, g, rng.choice([0, 0, 3])) for g in ("g1", "g2", "g3")]
        reads.append((plate, "bad", 10**6, "x"))
    frames = [
        pd.DataFrame(reads, columns=["plate", "barcode", "n", "type"]),
        pd.DataFrame(genes, columns=["plate", "barcode", "n", "type"]),
        pd.DataFrame(umi, columns=["plate", "barcode", "tagged"]),
        pd.DataFrame(counts, columns=["plate", "barcode", "gene", "count"]),
    ]
    expected = pandas_report(plates, lookup, *frames)
    r, g, u, c = (spark.createDataFrame(f) for f in frames)
    inputs = PlateInputs(
        plates=spark.createDataFrame(plates, "plate string, barcode_set string"),
        lookup=spark.createDataFrame(lookup),
        reads=r,
        genes=g,
        umi=u,
        cells=c.select("plate", "barcode").distinct(),
        counts=c,
    )
    stats = plate_stats(inputs, {"exon": "exon", "intron": "intron"})
    found = {x.plate: x.filtered_reads_m for x in overview(stats, unit=1000).collect()}
    assert found == {p: m for p, (share, m) in expected.items() if share <= 10}
    assert "p0" in expected and "p0" not in found  # too many nulls
    assert "p5" not in found  # no data at all
    grid = grids(stats, "total_reads", "exon")
    assert {x.plate: x["count"] for x in grid.groupBy("plate").count().collect()} == {p: 384 for p in expected}
