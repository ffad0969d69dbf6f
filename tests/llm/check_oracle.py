"""python tests/llm/check_oracle.py SF_DIR NAME...: queries beside their SQL."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]
sys.path[:0] = [os.path.join(sys.path[0], "tests")]

import oracle  # noqa: E402
from coterie.llm.queries import ORACLES, QUERIES  # noqa: E402


def differs(spark, connection, sf_dir, name):
    """What differs between a query and its SQL, or None."""
    return oracle.compare(spark, connection, sf_dir, name)


if __name__ == "__main__":
    oracle.QUERIES, oracle.ORACLES = QUERIES, ORACLES
    from coterie.session import local_session

    spark = local_session("llm-oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    for name in sys.argv[2:] or list(QUERIES):
        began = time.time()
        if name in ORACLES:
            said = differs(spark, oracle.connect(folder), folder, name) or "ok"
        else:
            said = f"{QUERIES[name](spark, folder).count()} rows"
        print(name, said, round(time.time() - began, 1), flush=True)
    spark.stop()
