"""Readers, sinks, the PLINK source and the streaming sums."""

import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import expression
from tessella.sources import plink, readers, sinks
from tessella.streaming import incremental


def test_whitespace_and_suffixes(spark, tmp_path):
    with gzip.open(tmp_path / "a.sumstats.gz", "wt") as f:
        f.write("SNP  A1 Z\tN\nrs1 A 1.5  100\nrs2 C . 200\nrs1 A 2.5 100\n")
    df = readers.read_whitespace(spark, str(tmp_path / "a.sumstats.gz"))
    assert df.columns == ["SNP", "A1", "Z", "N"] and df.where("Z IS NULL").count() == 1
    assert [tuple(r) for r in readers.read_sumstats(spark, str(tmp_path / "a.sumstats.gz")).collect()] == [("rs1", 1.5, 100.0)]
    pa_table = pa.table({"HUMAN_GENE_SYM": ["g1", "g2"], "spot_0": [1.0, 2.0], "spot_1": [3.0, 4.0]})
    import pyarrow.feather as feather

    feather.write_feather(pa_table, str(tmp_path / "m.feather"))
    wide = readers.read_any(spark, str(tmp_path / "m.feather"), "HUMAN_GENE_SYM string, spot_0 double, spot_1 double")
    long = readers.wide_to_long(wide, "HUMAN_GENE_SYM")
    assert sorted(map(tuple, long.collect())) == [("spot_0", "g1", 1.0), ("spot_0", "g2", 2.0), ("spot_1", "g1", 3.0), ("spot_1", "g2", 4.0)]
    with pytest.raises(ValueError):
        readers.read_any(spark, str(tmp_path / "m.feather"))


def test_chromosome_files(spark, tmp_path):
    for c in (1, 2, 23):
        with gzip.open(tmp_path / f"w.{c}.l2.ldscore.gz", "wt") as f:
            f.write(f"CHR SNP BP CM L2\n{c} rs{c} 10 0.1 {c}.5\n")
    df = readers.regression_weights(spark, str(tmp_path / "w."), ".l2.ldscore")
    assert sorted(map(tuple, df.collect())) == [("rs1", 1.5), ("rs2", 2.5)]
    assert readers.missing_chromosomes(readers.read_by_chromosome(spark, str(tmp_path / "w."), ".l2.ldscore")) == list(range(3, 23))


def test_small_files(spark, tmp_path):
    (tmp_path / "g.bed").write_text("chr1\t5\t9\tG1\t0\t+\n")
    assert readers.read_bed(spark, str(tmp_path / "g.bed")).head()["f_chrom"] == "1"
    (tmp_path / "m.tsv").write_text("SNP\tFeature\nrs1\ta\nrs1\tb\n")
    assert tuple(readers.read_mapping(spark, str(tmp_path / "m.tsv")).head()) == ("rs1", "b")
    (tmp_path / "hm.3.snp").write_text("rs1\nrs9\n")
    assert readers.read_snp_list(spark, str(tmp_path), 3).count() == 2
    with pytest.raises(FileNotFoundError, match="chr4.snp"):
        readers.read_snp_list(spark, str(tmp_path), 4)
    (tmp_path / "h.tsv").write_text("mouse\thuman\nActb\tACTB\n")
    names, species = readers.read_homologs(spark, str(tmp_path / "h.tsv"))
    assert species == "mouse" and readers.rename_homologs(spark.createDataFrame([("Actb", 1.0)], "gene string, value double"), names).head()["gene"] == "ACTB"
    assert readers.sample_manifest(paths=["/x/a.h5ad", "b.parquet"], relative_to="/r") == [("a", "/x/a.h5ad"), ("b", "/r/b.parquet")]
    with pytest.raises(ValueError):
        readers.sample_manifest(mapping={"a": "b"}, paths=["c"])
    with pytest.raises(ValueError):
        readers.trait_manifest("a", "b", {"c": "d"})
    panel = spark.createDataFrame([("rs1", 0), ("rs2", 1)], "snp string, row_idx long")
    (tmp_path / "thin.annot").write_text("X\n1\n2\n")
    assert sorted(map(tuple, readers.read_annotations(spark, str(tmp_path / "thin.annot"), panel).collect())) == [("rs1", 1.0), ("rs2", 2.0)]


def test_plink(spark, tmp_path):
    (tmp_path / "p.bim").write_text("1 rs1 0.5 100 A C\n1 rs2 0.6 200 G T\n2 rs3 0 5 A G\n")
    (tmp_path / "p.fam").write_text("".join(f"f{i} i{i} 0 0 1 -9\n" for i in range(5)))
    (tmp_path / "p.bed").write_bytes(b"\x6c\x1b\x01" + bytes([0b11100100, 0b00, 0b0, 0b11, 0b01010101, 0b01]))
    rows = plink.read_plink(spark, str(tmp_path / "p"), 2).orderBy("row_idx").collect()
    assert [r["snp"] for r in rows] == ["rs1", "rs2", "rs3"]
    assert rows[0]["dosages"] == [2.0, None, 1.0, 0.0, 2.0] and rows[1]["dosages"] == [2.0] * 4 + [0.0] and rows[2]["dosages"] == [None] * 5
    assert plink.read_samples(spark, str(tmp_path / "p")).count() == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.26), ("b", 2.0)], "k string, v double")
    made = []
    for _ in range(2):
        assert sinks.once(spark, str(tmp_path / "t"), lambda: made.append(1) or df).count() == 2
    assert made == [1] and readers.read_complete(spark, str(tmp_path / "t")).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_complete(spark, str(tmp_path))
    sinks.write_text(df, str(tmp_path / "x"), digits=3)
    assert readers.read_delimited(spark, str(tmp_path / "x")).orderBy("k").head()["v"] == "1.260"
    assert json.loads(sinks.columnar_json(df, digits=1).head()[0]) == {"k": ["a", "b"], "v": [1.3, 2.0]}
    sinks.write_script(df, str(tmp_path / "js"), "DATA", by="k")
    assert any("window.DATA['a'] = " in r[0] for r in spark.read.text(str(tmp_path / "js")).collect())


def test_probe(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert readers.probe(df, ["a"], ["b", "c"]) == ["c"]
    with pytest.raises(ValueError):
        readers.probe(df, ["z"])


def test_streaming_sums_equal_batch(spark, tmp_path):
    rows = [(c, f"g{g}", float(1 + (c * g) % 5)) for c in range(20) for g in range(6) if (c + g) % 3]
    ranks = expression.log_ranks(spark.createDataFrame(rows, "cell long, gene string, value double"), 6)
    for half in (0, 1):
        ranks.where(F.col("cell") % 2 == half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ranks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.keep_stats(stream, str(tmp_path / "sums"), str(tmp_path / "check"))
    q.awaitTermination(60)
    got = {r["gene"]: (round(r["g_mean"], 9), round(r["frac"], 9)) for r in incremental.merged_stats(spark.read.parquet(str(tmp_path / "sums"))).collect()}
    assert got == {r["gene"]: (round(r["g_mean"], 9), round(r["frac"], 9)) for r in expression.gene_stats(ranks).collect()}


def test_lists_without_repeats():
    assert readers.unique_in_order(["b", "a", "b", "c", "a"]) == ["b", "a", "c"]
