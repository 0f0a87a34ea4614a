"""python -m lodestone verify|dump|stats|repair|backup ROOT [TARGET]"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .sources.store import Database


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("verify", "dump", "stats", "repair", "backup"):
        print(__doc__)
        return 2
    db = Database(SparkSession.builder.getOrCreate(), args[1])
    if args[0] == "verify":
        found = db.verify()
        print("\n".join(found) or "no findings")
        return int(bool(found))
    if args[0] == "repair":
        print("\n".join(db.repair()) or "nothing to repair")
    elif args[0] == "stats":
        print(json.dumps(db.metrics()))
    elif args[0] == "dump":
        print(json.dumps(db.state.trees, indent=1))
    else:
        print("\n".join(db.backup(args[2])))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
