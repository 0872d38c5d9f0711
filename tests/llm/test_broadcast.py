"""What joins send to the driver and from there to every worker stays small, whatever size Spark gives it."""

from __future__ import annotations

import random

import pytest

from quire.llm import similar, simhash
from quire.llm.frames import written


def _broadcasts(df) -> list[str]:
    """The plans below each broadcast of the plan that ran."""
    lines = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line or "BroadcastQueryStage" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i + 1 : end]))
    return found


def test_fuzzy_keys_are_not_broadcast(spark):
    """Each fingerprint has 43 keys, to which Spark gives the size of the fingerprints: less than that of the counts of keys."""
    rng = random.Random(3)
    fps = [rng.getrandbits(62) for _ in range(3000)]
    fps += [fps[0] ^ 1, fps[1] ^ 0b111 << 40]
    found = simhash.links(written(spark.createDataFrame([(f,) for f in fps], "fp long"), "fps"))
    assert {frozenset(r) for r in found.collect()} == {frozenset((fps[0], fps[0] ^ 1)), frozenset((fps[1], fps[1] ^ 0b111 << 40))}
    assert not [plan for plan in _broadcasts(found) if "MapInArrow" in plan]


@pytest.mark.parametrize("few", [100_000, 10])
def test_rows_of_blocks_that_meet_are_counted(spark, monkeypatch, few):
    """Members of a large key are repeated for every block that theirs meets; Spark would give them the size that they had before."""
    monkeypatch.setattr(similar, "FEW_ROWS", few, raising=False)
    sets = [list(range(10 * i, 10 * i + 20)) for i in range(40)] + [list(range(19))]  # the last is like the first
    open_ = written(spark.createDataFrame([(1, i, i) for i in range(len(sets))], "key long, node long, class long"), "open")
    of_node = written(spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "node long, hashes array<long>"), "sets")
    sizes = of_node.selectExpr("node", "size(hashes) as size")
    seen = {}

    def seeing(df, name, f=similar.written):
        seen[name] = df
        return f(df, name)

    monkeypatch.setattr(similar, "written", seeing)
    assert {frozenset(r) for r in similar._compared(open_, sizes, of_node, 50).collect()} == {frozenset((0, 40))}
    met = seen["compared"]
    met.collect()
    sent = _broadcasts(met)
    assert not [plan for plan in sent if "Generate" in plan]
    assert bool(sent) == (few > 10)
