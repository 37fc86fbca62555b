"""python -m claimgraph batch|single: patents to RDF/XML."""

from __future__ import annotations

import argparse


def positive(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise argparse.ArgumentTypeError(f"{text} is not above 0")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("claimgraph", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    b = commands.add_parser("batch", help="all XML files below a folder")
    b.add_argument("-i", "--input", required=True)
    b.add_argument("-o", "--output", required=True)
    b.add_argument("-l", "--limit", type=positive, default=1000, help="documents with results")
    b.add_argument("-c", "--chunksize", type=positive, default=500, help="documents per file")
    s = commands.add_parser("single", help="one XML file, shown")
    s.add_argument("-p", "--path", required=True)
    s.add_argument("-o", "--output", help="folder for its RDF/XML")
    s.add_argument("-g", "--graph", action="store_true", help="print the graph in DOT")
    for c in (b, s):
        c.add_argument("--annotator", default="rules")
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .operators.graph import dot
    from .plans import claims
    from .sources import patents

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("claimgraph").getOrCreate()
    if args.command == "batch":
        claims.batch(spark, args.input, args.output, args.limit, args.chunksize, args.annotator)
        return
    files = spark.read.text(args.path, wholetext=True).selectExpr("_metadata.file_path as path", "value")
    found = claims.records(patents.read_patents(files), args.annotator)
    for row in found.toJSON().take(1):
        print(row)
    if args.graph:
        t = claims.tables(found)
        for row in dot(t["terms"], t["edges"]).take(1):  # a record of facts alone has no graph
            print(row.dot)
    if args.output:
        claims.ontology(found, args.output, 1, 1)


if __name__ == "__main__":
    main()
