"""Which nodes of a covering graph are seeds: those that no seed of higher rank covers.

Two ways. ``settled`` takes any order of ranks: rounds over the links that are still open, the last of them in one task
once few are left. ``settled_in_time`` takes nodes that rank by time and cover only a short time ahead: blocks of time
are settled each in its own task, and a chain that runs through many blocks is a function from the seeds open at a
block's start to those open at its end, so its length costs no rounds.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.operators.lineage import dropped, written

#: Links that one task may settle by itself, and those of a block of time.
REST_LINKS, BLOCK_LINKS = 100_000, 100_000
#: Sets of seeds open at a block's start that are followed at once.
MOST_STATES = 512


def _rest(links: pd.DataFrame) -> pd.DataFrame:
    """Seeds of a whole graph without open ends: nodes in an order in which coverers come first."""
    ahead, waits = defaultdict(list), defaultdict(int)
    for a, b in zip(links["a"], links["b"], strict=True):
        ahead[a].append(b)
        waits[b] += 1
    covered: set = set()
    todo = deque(x for x in ahead if x not in waits)
    out = []
    while todo:
        x = todo.popleft()
        out.append((x, x not in covered))
        for y in ahead.get(x, ()):
            if x not in covered:
                covered.add(y)
            waits[y] -= 1
            if not waits[y]:
                todo.append(y)
    return pd.DataFrame(out, columns=["a", "seed"])


def settled(edges: DataFrame, rest_links: int = REST_LINKS) -> DataFrame:
    """a, seed of every node of the covering ``edges`` (a, b; a ranks before b, a pair once).

    A round settles the nodes that no open link leads to, and those that a seed covers; links of settled nodes go, so
    that rounds shrink. At most ``rest_links`` open links are settled in one task.
    """
    kind = edges.schema["a"].dataType.simpleString()
    found: list[DataFrame] = []
    links = written(edges.select("a", "b"), "links")
    while (n := links.count()) > rest_links:
        heads = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        seeds = written(heads, "heads")
        covered = written(links.join(seeds, "a", "left_semi").select("b").distinct(), "covered")
        found += [seeds.select("a", F.lit(True).alias("seed")), covered.select(F.col("b").alias("a"), F.lit(False).alias("seed"))]
        left = links.join(covered, "b", "left_anti").join(covered.select(F.col("b").alias("a")), "a", "left_anti")
        # Nodes whose links have all gone are settled too: no open link leads to them, and they cover nobody else.
        alone = links.select(F.explode(F.array("a", "b")).alias("a")).distinct().join(covered.select(F.col("b").alias("a")), "a", "left_anti").join(seeds, "a", "left_anti")
        old, links = links, written(left, "links")
        still = links.select(F.explode(F.array("a", "b")).alias("a")).distinct()
        found.append(written(alone.join(still, "a", "left_anti").select("a", F.lit(True).alias("seed")), "alone"))
        dropped(old)
    if n:
        found.append(links.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_rest, f"a {kind}, seed boolean"))
    if not found:
        return edges.select("a", F.lit(True).alias("seed")).where("FALSE")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _independent(nodes: list, covers: dict, most: int) -> list[frozenset] | None:
    """All sets of ``nodes`` of which none covers another; None for more than ``most``."""
    sets: list[frozenset] = [frozenset()]
    for x in nodes:
        # Nodes are in order of rank, so those that may cover x are in the sets already.
        sets += [s | {x} for s in sets if not s & covers[x]]
        if len(sets) > most:
            return None
    return sets


def _block(most: int):
    """Seeds of a block's nodes as far as they do not depend on open nodes before it, and tables of those that do."""

    def run(links: pd.DataFrame) -> pd.DataFrame:
        k = links["block"].iloc[0]
        at, seed_of, covers, later = {}, {}, defaultdict(set), set()
        for a, b, us_a, us_b, block_a, block_b, seed_a in zip(*[links[c] for c in ("a", "b", "us_a", "us_b", "block_a", "block_b", "a_seed")], strict=True):
            at[a], at[b] = (us_a, block_a), (us_b, block_b)
            if seed_a is not None and seed_a == seed_a:
                seed_of[a] = bool(seed_a)
            if block_b <= k:
                covers[b].add(a)
            elif block_a == k:
                later.add(a)
        order = sorted(at, key=lambda x: (at[x][0], x))
        mine = [x for x in order if at[x][1] == k]
        # Parts of the block that share no node, with the open nodes before the block that cover them.
        part = {x: x for x in order}

        def head(x):
            while part[x] != x:
                part[x] = part[part[x]]
                x = part[x]
            return x

        for x in mine:
            for c in covers[x]:
                # A settled node ties nothing together.
                if c not in seed_of:
                    part[head(c)] = head(x)
        parts, before = defaultdict(list), defaultdict(list)
        for x in mine:
            parts[head(x)].append(x)
        for x in order:
            if at[x][1] < k and x not in seed_of and head(x) in parts:
                before[head(x)].append(x)
        out = []
        for p, nodes in parts.items():
            entries = before[p]
            states = _independent(entries, covers, most)
            known = states is not None
            # Bit s of a node's masks: it is surely, or possibly, a seed where the s-th set is open.
            every = (1 << len(states)) - 1 if known else 1
            sure, maybe = {}, {}
            for x in entries:
                sure[x] = sum(1 << s for s, held in enumerate(states) if x in held) if known else 0
                maybe[x] = sure[x] if known else 1
            for x in nodes:
                by, perhaps = 0, 0
                for c in covers[x]:
                    if c in seed_of:
                        by |= every if seed_of[c] else 0
                        perhaps |= every if seed_of[c] else 0
                    else:
                        by |= sure[c]
                        perhaps |= maybe[c]
                if x in seed_of:
                    sure[x] = maybe[x] = every if seed_of[x] else 0
                else:
                    sure[x], maybe[x] = every & ~perhaps, every & ~by
                if x not in seed_of and (sure[x] == every or maybe[x] == 0):
                    out.append((x, sure[x] == every, k, None, None, None, None))
            exits = [x for x in nodes if x in later and sure[x] != every and maybe[x] != 0]
            if exits and known:
                bits = lambda m: "".join("1" if m >> s & 1 else "0" for s in range(len(states)))
                out.append((None, None, k, entries, ["".join("1" if x in held else "0" for x in entries) for held in states], exits, [bits(sure[x]) for x in exits]))
            elif exits:
                out.append((None, None, k, None, None, exits, None))
        return pd.DataFrame(out, columns=["node", "seed", "block", "entries", "states", "exits", "answers"], dtype=object)

    return run


def _followed(rows: pd.DataFrame) -> pd.DataFrame:
    """Seeds of the open ends of all blocks, taken in order of time from table to table."""
    seed = {x: bool(s) for x, s in zip(rows["node"], rows["seed"], strict=True) if x is not None and x == x}
    out = []
    tables = rows[rows["exits"].notna()].sort_values("block", kind="stable")
    for entries, states, exits, answers in zip(tables["entries"], tables["states"], tables["exits"], tables["answers"], strict=True):
        # Parts without a table, and what follows from them, stay open.
        if entries is None or any(x not in seed for x in entries):
            continue
        s = list(states).index("".join("1" if seed[x] else "0" for x in entries))
        for x, answer in zip(exits, answers, strict=True):
            seed[x] = answer[s] == "1"
            out.append((x, seed[x]))
    return pd.DataFrame(out, columns=["node", "seed"])


def settled_in_time(edges: DataFrame, window_us: int, block_links: int = BLOCK_LINKS, most_states: int = MOST_STATES) -> DataFrame:
    """a, seed of every node of the covering ``edges`` (a, b, us_a, us_b; microseconds, a before b by time, then id).

    No link is longer than ``window_us``. A block of some ``block_links`` links follows all sets of seeds that may be
    open at its start together; its open ends become a table, one task follows the tables (a row for each block and
    chain through it, not for each node), and a second pass settles the blocks. Only where more than ``most_states``
    sets may be open are there further passes, each at least a block long.
    """
    kind = edges.schema["a"].dataType.simpleString()
    links = written(edges.select("a", "b", "us_a", "us_b"), "links")
    n = links.count()
    count = max(1, -(-n // block_links))
    cuts = links.agg(F.percentile_approx("us_b", [k / count for k in range(1, count)], 20 * count)).first()[0] if count > 1 else []
    bounds = np.array(sorted(set(cuts)), "int64")
    # A bound for each block: a binary search, as blocks may be thousands.
    block = F.pandas_udf(lambda us: pd.Series(np.searchsorted(bounds, us.to_numpy(), "right").astype("int32")), "int") if count > 1 else lambda us: F.lit(0)
    schema = f"node {kind}, seed boolean, block int, entries array<{kind}>, states array<string>, exits array<{kind}>, answers array<string>"
    known = None
    while True:
        state = known.select(F.col("node").alias("a"), F.col("seed").alias("a_seed")) if known is not None else None
        # Links to settled nodes go; those from settled ones tell the open nodes.
        open_ = links.withColumn("a_seed", F.lit(None).cast("boolean")) if state is None else links.join(state, "a", "left").join(state.select(F.col("a").alias("b")), "b", "left_anti")
        placed = open_.withColumns({"block_a": block(F.col("us_a")), "block_b": block(F.col("us_b"))})
        # A block also sees the links just before it, which tell what seeds may be open together, and those out of it.
        near = placed.withColumn("block", F.explode(F.sequence("block_a", block(F.col("us_b") + window_us))))
        passed = written(near.groupBy("block").applyInPandas(_block(most_states), schema), "blocks")
        fresh = passed.where("node IS NOT NULL").select("node", "seed")
        known = fresh if known is None else known.unionByName(fresh)
        if count == 1 or passed.where("exits IS NOT NULL").isEmpty() and open_.join(known.select(F.col("node").alias("b")), "b", "left_anti").isEmpty():
            break
        tables = passed.where("exits IS NOT NULL")
        entries = tables.select(F.explode("entries").alias("node")).distinct()
        told = known.join(entries, "node", "left_semi").select("*", *[F.lit(None).cast(passed.schema[c].dataType).alias(c) for c in ("block", "entries", "states", "exits", "answers")])
        ends = tables.unionByName(told).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_followed, f"node {kind}, seed boolean")
        known = written(known.unionByName(ends), "known")
    return known.select(F.col("node").alias("a"), "seed")
