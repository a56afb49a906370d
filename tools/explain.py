"""Print the formatted physical plan of registered queries.

Usage: python tools/explain.py <sf_dir> <query> [<query> ...]
(Building a query may run its planning jobs: size checks and materialized inputs.)
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidecast.plans import registry  # noqa: E402
from tidecast.session import ensure_local_checkpoint_dir, local_session  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8, 8, app="tidecast-explain")
    ensure_local_checkpoint_dir(spark)
    registry.load_all()
    for name in names:
        print(f"===== {name}")
        registry.QUERIES[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
