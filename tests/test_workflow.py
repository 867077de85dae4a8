"""The steps end to end on a small made-up tissue, and the command line."""

import gzip

import numpy as np
import pytest

from tessella import cli, workflow


@pytest.fixture(scope="module")
def tissue(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tissue")
    rng = np.random.default_rng(42)
    n, g = 60, 40
    x = rng.poisson(1.5, (n, g)).astype(float)
    kind = np.arange(n) % 2
    x[kind == 1, :10] += rng.poisson(4, ((kind == 1).sum(), 10))
    at = rng.uniform(0, 100, (n, 2))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(root / name))
    save([(f"c{i}", f"G{j}", float(x[i, j])) for i in range(n) for j in range(g) if x[i, j]], "cell string, gene string, value double", "expr")
    save([(f"c{i}", "AB"[kind[i]], float(at[i, 0]), float(at[i, 1])) for i in range(n)], "cell string, annotation string, x double, y double", "cells")
    snps = range(400)
    save([(f"rs{s}", f"G{(s * 7 + j) % g}", float(rng.exponential())) for s in snps for j in range(3)] + [(f"rs{s}", "Unmapped", float(rng.exponential())) for s in snps], "snp string, feature string, w double", "weights")
    save([(f"rs{s}", float(1 + rng.exponential())) for s in snps], "snp string, l2 double", "w_ld")
    save([(f"rs{s}", float(rng.normal() * 1.3), 50000.0, s) for s in snps], "snp string, z double, n double, row_idx long", "trait")
    return root


def test_all_steps(spark, tissue):
    args = ["--project", str(tissue / "out"), "--expr", str(tissue / "expr"), "--cells", str(tissue / "cells"), "--weights", str(tissue / "weights"), "--w-ld", str(tissue / "w_ld"), "--trait", f"height={tissue / 'trait'}"]
    small = ["--n-variable-genes", "20", "--n-components", "5", "--spatial-neighbours", "12", "--homogeneous-neighbours", "5", "--n-blocks", "20", "--min-cells", "5", "--min-genes", "5"]
    cli.main(["quick-mode", *args, *small])
    latent = spark.read.parquet(str(tissue / "out/latent"))
    assert latent.count() == 60 and len(latent.head()["emb_niche"]) == 5
    assert spark.read.parquet(str(tissue / "out/gss")).where("score < 0").count() == 0
    cells = spark.read.parquet(str(tissue / "out/ldsc/trait=height"))
    assert cells.count() == 60 and cells.where("p between 0 and 1").count() > 50
    regions = spark.read.parquet(str(tissue / "out/cauchy")).collect()
    assert {r["annotation"] for r in regions} == {"A", "B"} and all(0 <= r["p_cauchy"] <= 1 for r in regions)
    assert any("window.REGIONS = " in r[0] for r in spark.read.text(str(tissue / "out/report/regions")).collect())


def small(tissue, out, **more):
    given = dict(expr=str(tissue / "expr"), cells=str(tissue / "cells"), weights=str(tissue / "weights"), w_ld=str(tissue / "w_ld"), sumstats={"height": str(tissue / "trait")}, n_variable_genes=20, n_components=5, spatial_neighbours=12, homogeneous_neighbours=5, n_blocks=20, min_cells=5, min_genes=5)
    return workflow.Config(project=str(tissue / out), **{**given, **more})


@pytest.fixture(scope="module")
def single_cells(spark, tissue):
    """Cells of three kinds without places, with embeddings of their own and two samples."""
    rng = np.random.default_rng(99)
    centre = rng.normal(size=(3, 6)) * 3
    rows = [(f"c{i}", "ABC"[i % 3], "sampleA" if i < 25 else "sampleB", i, (centre[i % 3] + rng.normal(size=6) * 0.5).tolist()) for i in range(60)]
    spark.createDataFrame(rows, "cell string, annotation string, sample string, row long, X_own array<double>").write.parquet(str(tissue / "single"))
    return str(tissue / "single")


def test_single_cells_without_places(spark, tissue, single_cells):
    c = small(tissue, "scrna", cells=single_cells, dataset="scrna", by_sample=True)
    workflow.run(spark, c)
    latent = spark.read.parquet(c.at("latent"))
    assert "emb_niche" not in latent.columns and latent.count() == 60
    assert spark.read.parquet(c.at("ldsc/trait=height")).count() == 60
    assert {r["annotation"] for r in spark.read.parquet(c.at("cauchy")).collect()} == {"A", "B", "C"}
    by_sample = spark.read.parquet(c.at("cauchy_by_sample")).collect()
    assert {(r["annotation"], r["sample"]) for r in by_sample} == {(a, s) for a in "ABC" for s in ("sampleA", "sampleB")}


def test_homologs_and_genes_of_several_samples(spark, tissue, single_cells):
    path = tissue / "homologs.tsv"
    path.write_text("mouse\thuman\n" + "".join(f"G{j}\tH{j}\n" for j in range(30)))
    c = small(tissue, "homologs", cells=single_cells, homologs=str(path))
    expr = workflow.expression(spark, c)
    assert {r[0] for r in expr.select("gene").distinct().collect()} == {f"H{j}" for j in range(30)}
    cells = spark.read.parquet(single_cells)
    genes = workflow.variable(expr, cells, 10)
    assert len(genes) == len(set(genes)) == 10
    first = workflow.variable(expr, cells.where("sample = 'sampleA'"), 10)
    assert len(set(first) & set(genes)) >= 3


def test_own_embeddings(spark, tissue, single_cells):
    c = small(tissue, "own", cells=single_cells, dataset="scrna", own_embeddings=True, emb_cell="X_own", stop="latent_to_gene")
    workflow.run(spark, c)
    latent = spark.read.parquet(c.at("latent"))
    assert latent.where("emb_cell = X_own").count() == 60
    assert spark.read.parquet(c.at("gss")).select("cell").distinct().count() > 50


@pytest.mark.parametrize("more, cells", [({}, 60), ({"sample": "sampleA"}, 25), ({"cells_to": 25}, 25), ({"sample": "sampleB", "cells_from": 5, "cells_to": 15}, 10)])
def test_own_scores_of_a_sample_or_a_range(spark, tissue, single_cells, more, cells):
    rng = np.random.default_rng(20)
    path = str(tissue / "scores")
    spark.createDataFrame([(f"c{i}", f"G{j}", float(rng.uniform())) for i in range(60) for j in range(40)], "cell string, gene string, score double").write.mode("overwrite").parquet(path)
    c = small(tissue, "scores_" + "_".join(map(str, more.values())), cells=single_cells, own_scores=path, start="spatial_ldsc", stop="cauchy", **more)
    workflow.run(spark, c)
    got = {r["cell"] for r in spark.read.parquet(c.at("ldsc/trait=height")).collect()}
    assert len(got) == cells
    if more == {"cells_to": 25}:
        assert got == {f"c{i}" for i in range(25)}


def test_high_quality_pool(spark, tissue):
    c = small(tissue, "quality", high_quality=True, stop="latent_to_gene")
    workflow.run(spark, c)
    latent = spark.read.parquet(c.at("latent"))
    kept = latent.where("high_quality").count()
    assert 0 < kept < 60 and latent.count() == 60
    assert spark.read.parquet(c.at("gss")).select("cell").distinct().count() > 50


def test_settings():
    with pytest.raises(ValueError):
        workflow.Config("x", start="report", stop="cauchy")
    with pytest.raises(ValueError):
        workflow.Config("x", homogeneous_neighbours=50, spatial_neighbours=20)
    with pytest.raises(ValueError):
        workflow.Config("x", dataset="bulk")
    with pytest.raises(ValueError):
        workflow.Config("x", cells_from=9, cells_to=3)


def test_format_sumstats(spark, tmp_path):
    with gzip.open(tmp_path / "raw.txt.gz", "wt") as f:
        f.write("rsid ea nea beta se pval n eaf info\nrs1 A C 0.5 0.1 1e-6 1000 0.3 0.99\nrs1 A C 0.7 0.1 1e-6 1000 0.3 0.99\nrs2 A T 0.5 0.1 0.01 1000 0.3 0.99\n")
    cli.main(["format-sumstats", "--sumstats", str(tmp_path / "raw.txt.gz"), "--out", str(tmp_path / "clean")])
    rows = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "clean")).collect()
    assert [r["SNP"] for r in rows] == ["rs1"] and float(rows[0]["Z"]) == pytest.approx(4.892, abs=1e-3)


@pytest.mark.parametrize("command", ["quick-mode", "find-latent", "latent-to-gene", "spatial-ldsc", "cauchy-combination", "ldscore-weight-matrix", "format-sumstats", "report-view"])
def test_help(command, capsys):
    with pytest.raises(SystemExit) as end:
        cli.main([command, "--help"])
    assert end.value.code == 0 and "usage" in capsys.readouterr().out
