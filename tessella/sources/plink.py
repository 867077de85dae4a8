"""PLINK 1 genotypes as a Python data source: ``spark.read.format("plink").load(prefix)``.

A row for each variant: snp, chrom, pos, cm, a1, a2, row_idx, dosages (array<float>: copies of a1, null if missing).
Each task decodes a range of variants of the SNP-major .bed file; the prefix's three files must be readable by all
executors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the file format.
MAGIC = b"\x6c\x1b\x01"
DOSAGE = (2.0, None, 1.0, 0.0)  # by two-bit code

SCHEMA = "snp string, chrom string, pos long, cm double, a1 string, a2 string, row_idx long, dosages array<float>"


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def count_lines(path: str) -> int:
    with open(path) as f:
        return sum(1 for line in f if line.strip())


class PlinkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.prefix = options["path"].removeprefix("file:")
        self.step = int(options.get("variantsPerTask", 2000))

    def partitions(self) -> list[InputPartition]:
        n = count_lines(f"{self.prefix}.bim")
        return [Range(i, min(n, i + self.step)) for i in range(0, n, self.step)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        n = count_lines(f"{self.prefix}.fam")
        width = -(-n // 4)
        table = [[DOSAGE[b >> s & 3] for s in (0, 2, 4, 6)] for b in range(256)]
        with open(f"{self.prefix}.bim") as bim, open(f"{self.prefix}.bed", "rb") as bed:
            if bed.read(3) != MAGIC:
                raise ValueError(f"{self.prefix}.bed is not a SNP-major PLINK 1 file")
            bed.seek(3 + partition.lo * width)
            for i, line in enumerate(x for x in bim if x.strip()):
                if i < partition.lo:
                    continue
                if i >= partition.hi:
                    return
                chrom, snp, cm, pos, a1, a2 = line.split()
                yield snp, chrom, int(pos), float(cm), a1, a2, i, [d for b in bed.read(width) for d in table[b]][:n]


class Plink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plink"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PlinkReader(self.options)


def read_plink(spark: SparkSession, prefix: str, variants_per_task: int = 2000) -> DataFrame:
    spark.dataSource.register(Plink)
    return spark.read.format("plink").option("variantsPerTask", variants_per_task).load(prefix)


def read_samples(spark: SparkSession, prefix: str) -> DataFrame:
    """The .fam table."""
    parts = "split(trim(value), '\\\\s+')"
    names = ("fid", "iid", "father", "mother", "gender", "trait")
    return spark.read.text(f"{prefix}.fam").where("trim(value) <> ''").selectExpr(*(f"{parts}[{i}] AS {n}" for i, n in enumerate(names)))
