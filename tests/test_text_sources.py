"""Text readers (S1-S4) on files written to a fresh temporary folder."""

import numpy as np
import pytest

from conftest import dense
from tessera.sources import text as TX


def test_edge_list(spark, tmp_path):
    p = tmp_path / "edges.txt"
    p.write_text("# comment\n0 1\n1\t2\n\n2   0\n# end\n")
    e = TX.read_edge_list(spark, str(p))
    assert sorted(map(tuple, e.collect())) == [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)]


def test_triplets_one_based(spark, tmp_path):
    p = tmp_path / "r.txt"
    p.write_text("1 1 5\n2 3 4.5\n")
    assert sorted(map(tuple, TX.read_triplets(spark, str(p)).collect())) == [(0, 0, 5.0), (1, 2, 4.5)]


def test_dense_and_genotypes(spark, tmp_path):
    p = tmp_path / "d.tsv"
    p.write_text("Sample\tx\ty\tz\n1\t1.5\t0\tNaN\n2\t0\t2\t3\n")
    t = TX.read_dense_table(spark, str(p), 2, 3)
    rows = sorted((r["i"], r["j"], r["v"]) for r in t.collect())
    assert rows[2] == (0, 2, None) and rows[0] == (0, 0, 1.5)
    m = TX.read_dense(spark, str(p), 2, 3)
    np.testing.assert_allclose(dense(m), [[1.5, 0, 0], [0, 2, 3]])
    g = tmp_path / "g.tsv"
    g.write_text("Sample\ta\tb\tc\n1\t0\t-1\t2\n2\tNaN\t1\t1\n")
    z = {(r["snp"], r["sample"]): r["g"] for r in TX.read_genotypes(spark, str(g), 2, 3).collect()}
    assert z[(0, 1)] == 0 and z[(1, 0)] == 0 and z[(0, 2)] == 2
    n = {(r["snp"], r["sample"]): r["g"] for r in TX.read_genotypes(spark, str(g), missing="null").collect()}
    assert n[(0, 1)] is None and n[(1, 0)] is None
    try:
        TX.read_dense_table(spark, str(p), 3, 3)
        raise AssertionError("row count check did not fire")
    except ValueError:
        pass


@pytest.fixture(params=[4000, 1 << 20])
def byte_ranges(spark, request):
    """Byte ranges shorter than a line, and longer than a file."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, (request.param, 1, 1)):
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_wide_lines_equal_short_ones(spark, tmp_path, byte_ranges):
    rng = np.random.default_rng(1)
    d, n = tmp_path / "wide", 900
    d.mkdir()
    for f, (rows, end) in enumerate(((range(0, 3), "\n"), (range(3, 4), ""), (range(4, 5), "\n"))):
        lines = ["Sample\t" + "\t".join(map(str, range(n)))]
        lines += ["\t".join([str(r + 1), *("NaN" if x < 0.1 else f"{x:.3f}" for x in rng.random(n))]) for r in rows]
        lines += ["# comment\tand\tmore", "", "9999\t" + "\t".join(["NA"] * n)]
        (d / f"part-{f}.tsv").write_text(("\r\n" if f == 1 else "\n").join(lines) + end)
    got = sorted(map(tuple, TX.read_wide_table(spark, str(d), 5, n).collect()), key=str)
    with pytest.raises(ValueError):
        TX.read_wide_table(spark, str(d), 6, n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    assert got == sorted(map(tuple, TX.read_dense_table(spark, str(d), 5, n).collect()), key=str)
    assert len(got) == 5 * n


def test_wide_genotypes(spark, tmp_path):
    rng = np.random.default_rng(2)
    lines = ["Sample\t" + "\t".join(map(str, range(50)))] + ["\t".join([str(r + 1), *rng.choice(["0", "1", "2", "-1", "NaN"], 50)]) for r in range(9)]
    (tmp_path / "g.tsv").write_text("\n".join(lines) + "\n")
    for missing in ("zero", "null"):
        want = sorted(map(tuple, TX.read_genotypes(spark, str(tmp_path / "g.tsv"), 9, 50, missing).collect()), key=str)
        assert sorted(map(tuple, TX.read_wide_genotypes(spark, str(tmp_path / "g.tsv"), 9, 50, missing).collect()), key=str) == want


def test_wide_line_without_an_index_raises(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("x\t1\t2\n")
    with pytest.raises(Exception, match="not an index"):
        TX.read_wide_table(spark, str(tmp_path / "d.tsv"), check=False).collect()
