"""Plan review: a one-line summary of each catalogue query's physical plan (development tool).

    python -m acadspark.plans.explain /root/testdata/sf0.1 [name ...]

Reports shuffles, join strategies, windows and anything that should not be
there (nested-loop or cartesian joins, Python evaluation). ``--full`` prints
the formatted plan instead.
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

BAD = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summary(text: str) -> dict:
    ops = re.findall(r"^\(\d+\) (\w+)", text, flags=re.M)
    count = lambda name: sum(1 for o in ops if o == name)
    return {
        "exchanges": count("Exchange"),
        "broadcasts": count("BroadcastExchange"),
        "smj": count("SortMergeJoin"),
        "bhj": count("BroadcastHashJoin"),
        "windows": count("Window"),
        "aggregates": count("HashAggregate") + count("ObjectHashAggregate") + count("SortAggregate"),
        "scans": count("Scan"),
        "bad": sorted({o for o in ops if o in BAD}),
    }


def main(argv: list[str]) -> int:
    from ..session import local_session
    from .catalog import queries

    full = "--full" in argv
    args = [a for a in argv if a != "--full"]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    names = args[1:] or list(queries())
    spark = local_session(8)
    qs = queries()
    bad = 0
    for n in names:
        text = plan_text(qs[n](spark, sf_dir))
        if full:
            print(f"== {n} ==\n{text}")
            continue
        s = summary(text)
        bad += bool(s["bad"])
        print(n, s, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
