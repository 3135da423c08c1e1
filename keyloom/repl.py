"""``python -m keyloom.repl <db-root>``: statements from the terminal."""

import sys

from pyspark.sql import SparkSession

from keyloom.plans.engine import Engine
from keyloom.server import repl

if __name__ == "__main__":
    repl(Engine(SparkSession.builder.getOrCreate(), sys.argv[1]))
