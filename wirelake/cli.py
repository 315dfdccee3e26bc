"""Command line: python -m wirelake.cli ingest|export|explain|sanitize …"""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import SparkSession

from .functions.pseudonym import parse_seed
from .operators import ingest, retention, sanitize
from .plans.search import Scope, explain_sql
from .plans.store import ParquetStore
from .sources import pcap


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wirelake")
    sub = p.add_subparsers(dest="mode", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("store")
    a.add_argument("files", nargs="+")
    a.add_argument("--sensor", default="")
    a.add_argument("--no-streams", action="store_true")
    a.add_argument("--max-storage")
    a = sub.add_parser("export")
    a.add_argument("store")
    a.add_argument("out")
    a.add_argument("--filter", default="")
    a.add_argument("--session", action="append", default=[])
    a.add_argument("--from-ns", type=int)
    a.add_argument("--to-ns", type=int)
    a = sub.add_parser("explain")
    a.add_argument("filter")
    a.add_argument("--component", action="append", default=[])
    a = sub.add_parser("sanitize")
    a.add_argument("file")
    a.add_argument("out")
    a.add_argument("--seed", required=True)
    args = p.parse_args(argv)
    if args.mode == "explain":
        print(explain_sql(args.filter, tuple(args.component)))
        return 0
    spark = SparkSession.builder.appName("wirelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.mode == "ingest":
        files = pcap.resolve(args.files)
        if files == ["-"]:
            files = [pcap.spool(sys.stdin.buffer, tempfile.mkdtemp())]
        most = retention.parse_size(args.max_storage) if args.max_storage else None
        print(ingest.ingest(ParquetStore(spark, args.store), pcap.read_files(spark, files), args.sensor, not args.no_streams, most))
    elif args.mode == "export":
        print(ingest.export(ParquetStore(spark, args.store), args.out, args.filter, Scope(tuple(int(s) for s in args.session), args.from_ns, args.to_ns)))
    else:
        files = pcap.read_files(spark, [args.file])
        head = pcap.captures(files).first()
        meta = pcap.Meta(head.endianness, head.time_res, head.snaplen, head.linktype, bytes(head.global_header_raw))
        rows = sanitize.sanitize(pcap.read_frames(files).orderBy("packet_id"), parse_seed(args.seed))
        print(pcap.write_pcap(rows, args.out, meta, head.snaplen, head.linktype))
    return 0


if __name__ == "__main__":
    sys.exit(main())
