"""Command line: a linkage run over tab-separated records, and the check of a result file.

    python -m linkwright run --data FOLDER --work FOLDER [--preset M-v3] [--feat FEAT-v4 ...] [--leave-out COUNTRY]
    python -m linkwright check --results FILE --entities FILE --targets FILE FILE

``--data`` holds train_source1.tsv to train_source3.tsv and train_ground_truth.tsv; stage tables and outputs go to ``--work``.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import functions as F

from .operators import universe
from .operators.decide import union_all
from .plans import registry
from .plans.linkage import Inputs, Linkage
from .session import materialise, session
from .sources import records as rec


def inputs(spark, folder: str) -> tuple[Inputs, object, object]:
    """(inputs by row ids, ids of the entities, ids of the targets) of the training split."""
    one, rest = rec.load_split(spark, folder, "train")
    q = materialise(rec.with_rid(one), "entities").withColumn("src", F.lit(1))
    t = materialise(rec.with_rid(rest), "targets")
    links = rec.load_truth(spark, f"{folder}/train_ground_truth.tsv")
    a, b = q.select(F.col("entity_id").alias("q"), F.col("rid").alias("qr")), t.select(F.col("entity_id").alias("t"), F.col("rid").alias("tr"))
    truth = materialise(links.join(a, "q").join(b, "t").select(F.col("qr").alias("q"), F.col("tr").alias("t")), "truth")
    roles = q.select(F.col("rid").alias("q")).withColumn("role", role(F.col("q")))
    raw = ("rid", "country", "src", "business_name", "business_address")
    return Inputs(q.select(*raw), t.select(*raw), truth, roles), q.select("rid", "entity_id"), t.select("rid", "entity_id")


def role(q):
    """20 % of the entities decide, 5 % stop learners early, 30 % are learned from, the rest can be."""
    x = universe.hash_share(q, 13)
    return F.when(x < 0.2, "EVAL").when(x < 0.25, "ES").when(x < 0.55, "FIT").otherwise("REST")


def run(args) -> None:
    spark = session(shuffle_partitions=args.partitions)
    versions = registry.resolve(args.preset, block=args.block, feat=args.feat, match=args.match)
    x, q_ids, t_ids = inputs(spark, args.data)
    plan = Linkage(spark, args.work, versions, scope=args.data)
    if args.leave_out:
        countries = [r.country for r in x.entities.select("country").distinct().collect()]
        plan.match = registry.without_country(plan.match, countries, args.leave_out)
        plan.v = replace(plan.v, match=f"{plan.v.match}-without-{args.leave_out}")
    got = plan.run(x)
    named = rec.to_ids(got["links"].select("q", "t"), q_ids, t_ids)
    lists = rec.match_lists(named.select(F.col("s1_id").alias("q"), F.col("cand_id").alias("t")), q_ids.select(F.col("entity_id").alias("q")))
    rec.write_lists(lists, f"{args.work}/matching_results")
    for name in ("rules", "recall", "quality"):
        got[name].show(60, truncate=False)


def check(args) -> None:
    spark = session()
    ids = lambda *paths: union_all([rec.read_tsv(spark, p).select(F.col("entity_id").alias("id")) for p in paths])
    rec.check_file(spark, args.results, ["source1_entity_id", "matched_entity_ids"]).show(truncate=False)
    rec.validate(rec.read_tsv(spark, args.results, rec.TRUTH), ids(args.entities), ids(*args.targets)).show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="linkwright")
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("run")
    one.add_argument("--data", required=True)
    one.add_argument("--work", required=True)
    one.add_argument("--preset", default=registry.DEFAULT_PRESET, choices=sorted(registry.PRESETS))
    for part, table in (("block", registry.BLOCK), ("feat", registry.FEAT), ("match", registry.MATCH)):
        one.add_argument(f"--{part}", choices=sorted(table))
    one.add_argument("--leave-out")
    one.add_argument("--partitions", type=int, default=8)
    one.set_defaults(do=run)
    two = commands.add_parser("check")
    two.add_argument("--results", required=True)
    two.add_argument("--entities", required=True)
    two.add_argument("--targets", nargs="+", required=True)
    two.set_defaults(do=check)
    args = parser.parse_args(argv)
    args.do(args)


if __name__ == "__main__":
    main()
