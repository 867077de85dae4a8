"""Command line: ``python -m tessella.cli COMMAND [options]``."""

from __future__ import annotations

import argparse
import dataclasses
import functools
import http.server

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella import workflow
from tessella.operators import ldscores, relational, sumstats
from tessella.sources import plink, readers, sinks

PROJECT = ("quick-mode", "find-latent", "latent-to-gene", "spatial-ldsc", "cauchy-combination")


def session() -> SparkSession:
    return SparkSession.builder.appName("tessella").getOrCreate()


def project(args: argparse.Namespace) -> None:
    values = {f.name: getattr(args, f.name) for f in dataclasses.fields(workflow.Config) if f.name != "sumstats"}
    config = workflow.Config(**values, sumstats=dict(x.split("=", 1) for x in args.trait))
    step = {"find-latent": workflow.find_latent, "latent-to-gene": workflow.latent_to_gene, "spatial-ldsc": workflow.spatial_ldsc, "cauchy-combination": workflow.cauchy}
    step.get(args.command, workflow.run)(session(), config)


def weight_matrix(args: argparse.Namespace) -> None:
    spark = session()
    geno = ldscores.variant_filter(plink.read_plink(spark, args.bfile), args.maf_min)
    variants = geno.select("snp", "chrom", "pos", "cm", "row_idx")
    targets = variants.join(spark.read.text(args.snps).select(F.trim("value").alias("snp")), "snp", "left_semi") if args.snps else variants
    mapping = relational.map_features(variants, readers.read_bed(spark, args.bed), args.strategy, args.feature_window)
    l2 = ldscores.ld_r2(geno, ldscores.ld_pairs(targets, variants, args.ld_wind, args.ld_unit, args.batch))
    sinks.write_table(ldscores.ld_weights(l2, mapping), f"{args.out}/weights")
    sinks.write_table(ldscores.regression_weights(geno, variants, targets.select("snp"), args.maf_min, args.ld_wind, args.ld_unit), f"{args.out}/w_ld")


NUMBERS = ("N", "BETA", "SE", "OR", "SE_OR", "Z", "P", "INFO", "FRQ")


def format_sumstats(args: argparse.Namespace) -> None:
    spark = session()
    df = sumstats.rename(readers.read_whitespace(spark, args.sumstats), dict(x.split("=", 1) for x in args.name))
    df = df.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in NUMBERS if c in df.columns}).withColumn("row_idx", F.monotonically_increasing_id())
    if args.dbsnp:
        df = sumstats.to_rsid(df.drop("SNP"), readers.read_variant_names(spark, args.dbsnp))
    out = sumstats.clean(df, args.info_min, args.maf_min, args.format, order=["row_idx"])
    columns = ["SNP", "A1", "A2", "Z", "N"] if args.format == "z" else ["SNP", *sumstats.COJO]
    sinks.write_text(sumstats.printed(out.select(*(c for c in columns if c in out.columns))), args.out)


def view(args: argparse.Namespace) -> None:
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=args.folder)
    with http.server.ThreadingHTTPServer(("127.0.0.1", args.port), handler) as server:
        server.serve_forever()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tessella", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in PROJECT:
        p = commands.add_parser(name)
        for f in dataclasses.fields(workflow.Config):
            flag = "--" + f.name.replace("_", "-")
            if f.name == "sumstats":
                p.add_argument("--trait", action="append", default=[], metavar="NAME=PATH")
            elif isinstance(f.default, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
            elif f.default is dataclasses.MISSING:
                p.add_argument(flag, required=True)
            else:
                p.add_argument(flag, type=type(f.default), default=f.default)
        p.set_defaults(run=project)
    p = commands.add_parser("ldscore-weight-matrix")
    p.add_argument("--bfile", required=True)
    p.add_argument("--bed", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--snps")
    p.add_argument("--strategy", choices=relational.STRATEGIES, default="score")
    p.add_argument("--feature-window", type=int, default=0)
    p.add_argument("--ld-wind", type=float, default=1.0)
    p.add_argument("--ld-unit", choices=("SNP", "KB", "CM"), default="CM")
    p.add_argument("--maf-min", type=float, default=0.01)
    p.add_argument("--batch", type=int, default=50)
    p.set_defaults(run=weight_matrix)
    p = commands.add_parser("format-sumstats")
    p.add_argument("--sumstats", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--name", action="append", default=[], metavar="COLUMN=NAME")
    p.add_argument("--dbsnp")
    p.add_argument("--format", choices=("z", "cojo"), default="z")
    p.add_argument("--info-min", type=float, default=0.9)
    p.add_argument("--maf-min", type=float, default=0.01)
    p.set_defaults(run=format_sumstats)
    p = commands.add_parser("report-view")
    p.add_argument("folder")
    p.add_argument("--port", type=int, default=8000)
    p.set_defaults(run=view)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
