"""Near-duplicate texts by SetSketch registers.

Equal shingle sets are one node. Nodes that agree on a band of registers share a bucket; pairs from buckets that the
registers make plausible are confirmed on whole texts. Links are followed to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import sketch
from ledgerloom.llm.common import hot_join, map_rows, written

#: Pairs of a bucket are compared in blocks of so many members; a larger bucket is several blocks.
BLOCK = 1024
#: Partners a member names when all members of a bucket are compared by registers. Buckets in which a member had more
#: are then compared by whole sets, with all partners.
PARTNERS = 2
#: Fewer equal registers make no pair plausible: three quarters of them less six standard deviations.
LEAST_EQUAL = round(0.75 * sketch.REGISTERS - 6 * (0.75 * 0.25 * sketch.REGISTERS) ** 0.5)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), digest of the set, registers for every row, written once."""
    def each(row, sketcher):
        found = sketcher.shingles(row["text"])
        some = len(found) > 0
        yield {"doc_id": row["doc_id"], "n": len(found), "digest": sketch.digest(found) if some else None,
               "registers": sketcher.registers(found).tobytes() if some else None}

    return written(map_rows(docs.select("doc_id", "text"), each, "doc_id bigint, n bigint, digest binary, registers binary",
                            setup=sketch.Sketcher), "dup-signatures")


def buckets(nodes: DataFrame) -> DataFrame:
    """key, id, leader, size: buckets of at least two nodes; the key hashes a band's place and registers."""
    width = 2 * sketch.BAND_ROWS
    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("registers", 1 + width * j, width)) for j in range(sketch.BANDS)])
    rows = nodes.select("id", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("leader")).where("size > 1")
    return written(rows.join(shared, "key"), "dup-buckets")


def _sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers allow a similar pair."""
    side = {x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
            for x in "ab"}

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                registers = [np.frombuffer(b"".join(batch.column(f"r_{x}").to_pylist()), np.uint16)
                             .reshape(-1, sketch.REGISTERS) for x in "ab"]
                sizes = [batch.column(f"n_{x}").to_numpy().astype(float) for x in "ab"]
                import pyarrow as pa

                yield batch.select(["a", "b"]).filter(pa.array(sketch.plausible(*registers, *sizes)))

    return pairs.join(side["b"], "b").join(side["a"], "a").mapInArrow(keep, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets are similar."""
    def each(row, state):
        sketcher, last = state
        if last.get("id") != row["a"] or last["text"] != row["text_a"]:
            last.update(id=row["a"], text=row["text_a"], set=sketcher.shingles(row["text_a"]))
        if sketch.overlap(last["set"], sketcher.shingles(row["text_b"])):
            yield {"a": row["a"], "b": row["b"]}

    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"))
    return map_rows(both, each, "a bigint, b bigint", setup=lambda: (sketch.Sketcher(), {}))


def _blocks(members: DataFrame, columns: list[str]) -> DataFrame:
    """Members (key, id, size, component, n, registers and columns) dealt by pairs of blocks of their bucket."""
    block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = (members.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
            .select("key", "low", "high", "block", "id", "component", "n", "registers", *columns))
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def _plausible_partners(group: list[dict]) -> Iterator[tuple[dict, list[dict]]]:
    """Each member of a pair of blocks with the plausible partners of other components, the most alike first."""
    low, high = group[0]["low"], group[0]["high"]
    left = [r for r in group if r["block"] == low]
    right = left if low == high else [r for r in group if r["block"] == high]
    if not left or not right:
        return
    registers = np.frombuffer(b"".join(r["registers"] for r in right), np.uint16).reshape(len(right), -1)
    component = np.array([r["component"] for r in right])
    ids, sizes = np.array([r["id"] for r in right]), np.array([r["n"] for r in right], float)
    for r in left:
        mine = np.frombuffer(r["registers"], np.uint16)
        ratio = np.minimum(sizes, r["n"]) / np.maximum(sizes, r["n"])
        there = np.flatnonzero((component != r["component"]) & (ratio >= 0.75) & ((ids > r["id"]) | (low != high)))
        same = (registers[there] == mine).sum(1)
        near = same >= LEAST_EQUAL
        there, same = there[near], same[near]
        if len(there):
            ok = sketch.plausible(np.broadcast_to(mine, (len(there), len(mine))), registers[there],
                                  np.full(len(there), float(r["n"])), sizes[there])
            order = np.argsort(-same[ok], kind="stable")
            if len(order):
                yield r, [right[k] for k in there[ok][order]]


def _by_group(rows: DataFrame, compare, schema: str, setup=lambda: None) -> DataFrame:
    """compare(rows of a pair of blocks, state) over sorted rows; a task holds one pair of blocks at a time."""
    def each(row, state):
        place = (row["key"], row["low"], row["high"])
        if state["place"] != place:
            if len(state["rows"]) > 1:
                yield from compare(state["rows"], state["own"])
            state.update(place=place, rows=[])
        state["rows"].append(row)

    def finish(state):
        if len(state["rows"]) > 1:
            yield from compare(state["rows"], state["own"])

    return map_rows(rows, each, schema, finish=finish, setup=lambda: {"place": None, "rows": [], "own": setup()})


def _named_partners(members: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """key, a, b, cut: the `partners` most plausible pairs of each member, and whether it had more."""
    def compare(group, _):
        for r, others in _plausible_partners(group):
            for o in others[:partners]:
                yield {"key": r["key"], "a": min(r["id"], o["id"]), "b": max(r["id"], o["id"]),
                       "cut": len(others) > partners}

    return _by_group(_blocks(members, []), compare, "key bigint, a bigint, b bigint, cut boolean")


def _linked_members(members: DataFrame) -> DataFrame:
    """a, b: links between components inside pairs of blocks, confirmed on whole sets; members have a text.

    A link is left out if the links before it already join its two components, so a group gives fewer links than it has
    members however many of its pairs are similar.
    """
    def compare(group, sketcher):
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        sets: dict[int, np.ndarray] = {}
        for r, others in _plausible_partners(group):
            for o in others:
                x, y = root(r["component"]), root(o["component"])
                if x == y:
                    continue
                for m in (r, o):
                    if m["id"] not in sets:
                        sets[m["id"]] = sketcher.shingles(m["text"])
                if sketch.overlap(sets[r["id"]], sets[o["id"]]):
                    joined[max(x, y)] = min(x, y)
                    yield {"a": min(r["id"], o["id"]), "b": max(r["id"], o["id"])}

    return _by_group(_blocks(members, ["text"]), compare, "a bigint, b bigint", setup=sketch.Sketcher).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (least id reachable) of every node in links (a, b).

    Each round takes the least component among neighbours, then the component of the component, until no label
    changes. Labels of each round are written, so a round starts from files.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("id"), F.least("a", "b").alias("component"), F.lit(True).alias("changed")), "dup-labels")
    while labels.where("changed").limit(1).count():
        near = (both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c")))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("now"))
        over = labels.select(F.col("id").alias("now"), F.col("component").alias("further"))
        labels = written(step.join(over, "now").select(
            "id", F.least("now", "further").alias("component"),
            (F.least("now", "further") != F.col("was")).alias("changed")), "dup-labels")
    return labels.select("id", "component")


def link_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents are linked if 100 * intersection >= 75 * union of their sets of five-word shingles (A-Z in lower case; a
    shorter text is one shingle). component_id is the least doc_id reachable, kept whether it is the row's own. A null
    text or one without words is linked with nothing. Rows with the same doc_id count as one document; rows without one
    are linked with nothing, have no component_id and are kept. Other columns are ignored; an empty table gives no rows.

    A link of similarity s is a candidate with probability 1 - (1 - s^4)^32: all but five in a million at 0.75. Of a
    bucket, first every node is compared with the least one. Where a bucket still has several components, all its
    members are compared by registers, in blocks, and each names its most plausible partners in other components. Where
    one had more than it may name, the bucket's members are compared again with all of them, by whole sets.
    """
    signed = signatures(docs)
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"))
    classes = written(classes.where("id IS NOT NULL"), "dup-classes")
    rows = signed.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "digest")
    # many rows may have one digest: Spark's skew-join handling splits such partitions of the narrow rows
    member = written(rows.join(classes, "digest").select("doc_id", "n", "id"), "dup-members")
    nodes = (signed.where("n > 0").join(classes.withColumnRenamed("id", "doc_id"), ["doc_id", "digest"], "left_semi")
             .dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("id"), "n", "registers"))
    nodes = written(nodes, "dup-nodes")
    shared = buckets(nodes)
    wanted = shared.select("id").distinct()
    texts = written(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "text")
                    .join(wanted, "id", "left_semi").dropDuplicates(["id", "text"]), "dup-texts")

    stars = shared.where("id != leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(
        F.count("*").alias("bands"))
    # a node's most likely leaders come first; what they leave open is compared below
    likely = Window.partitionBy("b").orderBy(F.desc("bands"), "a")
    stars = stars.withColumn("rank", F.row_number().over(likely)).where("rank <= 4").select("a", "b")
    # a node in two shingle sets (one doc_id, two texts) is linked with itself
    links = written(_confirmed(_sketched(stars, nodes), texts), "dup-links")
    found = components(links)

    def open_members(of: DataFrame) -> DataFrame:
        """Members, with registers, of the buckets that hold several components."""
        named = of.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        keys = (named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                .where("low != high").select("key"))
        # a bucket of near copies may hold a large share of the rows
        named = hot_join(named, keys, ["key"], "id")
        return named.select("key", "id", "size", "component").join(nodes, "id")

    pairs = written(_named_partners(open_members(shared)), "dup-pairs")
    more = written(_confirmed(pairs.groupBy("a", "b").agg(F.lit(1)).select("a", "b"), texts), "dup-links")
    if more.limit(1).count():
        links = links.unionByName(more)
        found = components(links)
    cut = written(pairs.where("cut").select("key").distinct(), "dup-cut")
    if cut.limit(1).count():
        crowded = open_members(shared.join(cut, "key", "left_semi")).join(texts, "id")
        more = written(_linked_members(crowded), "dup-links")
        found = components(links.unionByName(more))
    named = (member.join(found, "id", "left")
             .select("doc_id", "n", F.coalesce("component", "id").alias("component_id")))
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
