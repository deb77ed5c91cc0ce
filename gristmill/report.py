"""The precision report of a run's labels: python -m gristmill.report ROOT [--set-baseline]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gristmill.operators import stores
from gristmill.plans import views


def report(spark: SparkSession, root: str, set_baseline: bool = False) -> str:
    """The latest labels below ``root``, against the baseline that lies there."""
    root = root.rstrip("/")
    labels = views.labels(stores.read_labels(spark, f"{root}/labels"))
    now = stores.report_against(labels, f"{root}/baseline", set_baseline).first().asDict()
    reasons = [(r["reason"], r["n"]) for r in stores.false_positive_reasons(labels).collect()]
    before = None if now["delta"] is None else {"precision": now["precision"] - now["delta"]}
    return views.report_text(now, reasons, before)


def main(arguments: list[str]) -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("root")
    options.add_argument("--set-baseline", action="store_true")
    chosen = options.parse_args(arguments)
    print(report(SparkSession.builder.appName("report").getOrCreate(), chosen.root, chosen.set_baseline))


if __name__ == "__main__":
    main(sys.argv[1:])
