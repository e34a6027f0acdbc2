"""python -m sparksieve DOMAIN_RULES PREFIX_RULES URLS OUT: writes passing tags to OUT/tags and prints the counters."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans.engine import counters, passing_tags, verdicts
from .sources.text import counter_lines, read_domain_rules, read_prefix_rules, read_urls, write_tags


def main(args: list[str]) -> int:
    if len(args) != 4:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("sparksieve").getOrCreate()
    judged = verdicts(read_urls(spark, args[2]), read_domain_rules(spark, args[0]), read_prefix_rules(spark, args[1])).persist()
    write_tags(passing_tags(judged), f"{args[3]}/tags")
    for row in counter_lines(counters(judged)).collect():
        print(row.value)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
