"""Compare queries with their SQL twins: python tests/run_oracles.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from siftguard.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                said = compare(spark, con, queries[name], oracles[name], sf_dir) or "ok"
            else:
                said = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            said = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {time.time() - start:6.1f}s  {said}", flush=True)


if __name__ == "__main__":
    main()
