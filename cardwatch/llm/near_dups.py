"""Near-duplicate documents by bottom-k sketches of one hash function.

Texts with equal shingle sets form a class; only one of each class goes on. The
``SKETCH`` smallest hashes of its set are its sketch. Inverted lists of retained
values, taken rarest first, give the pairs; the overlap in the union's sketch
drops those far from the limit; full sets confirm the rest.

A value that more than ``LIST_ROWS`` classes hold (a passage that thousands
share, a large family of edited copies) never gives all pairs. Classes that
meet in such lists form a family. Its members are compared with a few pivots
first. What then is outside the family's main component, and only that, meets
members of other components with which it shares one of the rarest quarter of
the values of both full sets, as linked sets do, and whose size is near enough.
Where more than ``LIST_ROWS`` hold such a value, blocks of bounded size are
compared, and two blocks give no more links than join them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.components import components
from cardwatch.llm.words import distinct_per_text, in_batches, mix, shingle_hashes, slices
from cardwatch.session import remove, stage, stage_at

WIDTH = 5
#: A link: ``PART`` * intersection >= ``OF`` * union.
PART, OF = 100, 75
#: Hashes kept in a sketch.
SKETCH = 64
#: Of ``SKETCH`` values of a union, two texts at the limit share 48 on average; under 30 is five deviations off.
SHARED = 30
#: Sets this small, and all they can be linked with, are whole in their sketch.
WHOLE = 47
#: Up to so many classes in a list, all pairs of it are taken.
LIST_ROWS = 64
#: Members of a family that all others are compared with first.
PIVOTS = 8
#: Ids that are sent to every task at most: 8 MB.
BROADCAST_IDS = 1_000_000
#: Members of a block, and bytes of their sets; a block outside the main component is compared with one of all.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 22
#: Values are ordered by counts of so many hashed buckets; any order gives all links, that from the rarest the fewest candidates.
ORDER_BUCKETS = 1 << 18
#: Counts of so many buckets reach the driver as one row.
RUN = 1 << 12
#: Values of two blocks that are multiplied at once.
_VALUES_AT_ONCE = 1 << 12


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in slices(batch.column("text")):
            h, at = distinct_per_text(*shingle_hashes(words, WIDTH), words.texts)
            n = np.diff(at)
            prints = []
            for salt in (0x51ED270B9, 0xA24BAED4963):
                sums = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ np.uint64(salt)), out=sums[1:])
                prints.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
            part = np.minimum(n, SKETCH)
            ends = np.cumsum(part)
            take = np.arange(ends[-1]) - np.repeat(ends - part, part) + np.repeat(at[:-1], part)
            sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(h[take].view(np.int64)))
            ids = batch.column("doc_id").slice(i, j - i)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(prints[0]), pa.array(prints[1]), sketch], ["doc_id", "n_shingles", "p1", "p2", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in slices(batch.column("text")):
            h, at = distinct_per_text(*shingle_hashes(words, WIDTH), words.texts)
            full = pa.Array.from_buffers(pa.binary(), words.texts, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), full], ["doc_id", "shingles"])


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return PART * both >= OF * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _incidence(sets: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(shared)), np.float32)
    for row, values in zip(out, sets):
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        row[at[shared[at] == values]] = 1
    return out


def _block_links(pdf):
    """Links between a block of rows outside (``outer``) and a block of members, as a forest."""
    import pandas as pd

    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    sides = [pdf[~pdf["outer"]], pdf[pdf["outer"]]]
    inner, outer = ([np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in sides)
    if inner and outer:
        shared = np.intersect1d(np.concatenate(inner), np.concatenate(outer))
        both = np.zeros((len(outer), len(inner)), np.float32)
        for k in range(0, len(shared), _VALUES_AT_ONCE):
            part = shared[k : k + _VALUES_AT_ONCE]
            both += _incidence(outer, part) @ _incidence(inner, part).T
        both = both.astype(np.int64)
        union = np.array([len(x) for x in outer])[:, None] + np.array([len(x) for x in inner])[None, :] - both
        inner_ids, ids = (side["node"].to_numpy() for side in sides)
        for i, j in zip(*np.nonzero(PART * both >= OF * union)):
            a, b = find(int(ids[i])), find(int(inner_ids[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(inner_ids[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose overlap in the sketch of their union is not far below the limit."""
    side = classes.select(F.col("node"), "sketch")
    u = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(F.col("u"), F.col("sa")), F.col("sb")))
    return (
        pairs.join(side.toDF("a", "sa"), "a")
        .join(side.toDF("b", "sb"), "b")
        .withColumn("u", u)
        .filter(F.when(F.size("u") < SKETCH, PART * shared >= OF * F.size("u")).otherwise(shared >= SHARED))
        .select("a", "b")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return (
        pairs.join(sets.toDF("a", "x"), "a")
        .join(sets.toDF("b", "y"), "b")
        .mapInArrow(_confirm, "a long, b long")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id, kept.

    Words are runs outside ASCII white space of the text with A-Z in lower case;
    its set holds the distinct runs of five words, a shorter text being one run.
    Two documents are linked from 0.75 of Jaccard similarity on full sets;
    ``component_id`` is the smallest doc_id that links reach, ``kept`` whether
    that is the document itself.

    A text that is null, empty or white space has an empty set, no links and is
    kept. Copies share a class, so links between them cost nothing. Rows with
    one doc_id are one document with several texts. A null doc_id takes part in
    no link and keeps a null component and ``kept`` true. Other columns are not
    read. An empty table gives no rows.
    """
    docs = in_batches(docs)
    found = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_signatures, "doc_id long, n_shingles long, p1 long, p2 long, sketch array<long>"),
        "signatures",
    )
    links, classes = _links(docs, found)
    reached = components(links)
    names = (
        classes.join(reached, "node", "left")
        .select("p1", "p2", "n_shingles", "copies", F.coalesce("component", "node").alias("component"), "node")
        .filter("copies > 1 or component != node")
        .select("p1", "p2", "n_shingles", "component")
    )
    return _named(found, names)


def _named(found: DataFrame, names: DataFrame) -> DataFrame:
    named = found.select("doc_id", "n_shingles", "p1", "p2").join(names, ["p1", "p2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return named.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _links(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    classes = stage(
        found.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("p1", "p2", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")),
        "classes",
    )
    values = classes.select("node", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("rows")).filter("rows > 1")
    # A text needs its rarest values only: two linked texts share so many that one of these is among them.
    need = F.when(F.col("n_shingles") <= WHOLE, F.ceil(F.col("n_shingles") * OF / PART)).otherwise(SHARED)
    room = F.least("n_shingles", F.lit(SKETCH)) - need + 1
    held = values.join(common, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rows", "value"))).alias("held"))
    lists, lists_at = stage_at(
        held.join(classes.select("node", "n_shingles"), "node")
        .withColumn("alone", F.least("n_shingles", F.lit(SKETCH)) - F.size("held"))
        .withColumn("take", F.greatest(room - F.col("alone"), F.lit(0)).cast("int"))
        .filter("take > 0")
        .select("node", F.explode(F.slice("held", 1, F.col("take"))).alias("v"))
        .select("node", F.col("v.value").alias("value")),
        "lists",
    )
    sizes = lists.groupBy("value").agg(F.count("*").alias("rows"), F.min("node").alias("least")).filter("rows > 1")
    # What several steps read is staged: a plan that repeats it costs the driver memory, whatever the rows.
    sized = stage(lists.join(sizes, "value").select("value", "node", "rows", "least"), "sized")
    remove(docs.sparkSession, lists_at)
    short = sized.filter(F.col("rows") <= LIST_ROWS).select("value", "node")
    pairs = short.toDF("value", "a").join(short.toDF("value", "b"), "value").filter("a < b").select("a", "b")

    hot = sized.filter(F.col("rows") > LIST_ROWS)
    family = stage(components(hot.select(F.col("node").alias("a"), F.col("least").alias("b"))).toDF("node", "family"), "families")
    weight = hot.groupBy("node").agg(F.count("*").alias("lists"))
    place = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    pivots = stage(
        family.join(weight, "node")
        .groupBy("family", place.alias("place"))
        .agg(F.max_by("node", F.struct("lists", -F.col("node"))).alias("pivot"))
        .select("family", "pivot"),
        "pivots",
    )
    starred = family.join(pivots, "family").filter("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    pairs = stage(_near(pairs.union(starred).distinct(), classes), "pairs")

    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(family.select("node")).distinct()
    sets = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(asked.hint("merge"), "doc_id")  # ids grow with the data: one plan at every size
        .mapInArrow(_sets, "doc_id long, shingles binary"),
        "sets",
    )
    sure = stage(_confirmed(pairs, sets), "links")
    return sure.union(_family_links(family, sure, sets)).union(stage(_own_links(found, classes), "own-links")), classes


def _own_links(found: DataFrame, classes: DataFrame) -> DataFrame:
    """A document with several texts joins the classes of all of them."""
    several = found.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1 and doc_id is not null").select("doc_id")
    mine = found.join(several, "doc_id").join(classes, ["p1", "p2", "n_shingles"]).select("doc_id", "node")
    return mine.filter("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def _bucket(values: np.ndarray) -> np.ndarray:
    return (mix(values) % np.uint64(ORDER_BUCKETS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ORDER_BUCKETS, np.int64)
    for batch in batches:
        for x in batch.column("shingles"):
            np.add.at(total, _bucket(np.frombuffer(x.as_py(), np.uint64)), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def _run(pdf):
    """The counts (bucket, n) of one run of buckets as bytes."""
    import pandas as pd

    counts = np.zeros(RUN, np.int64)
    counts[pdf["bucket"].to_numpy(np.int64) % RUN] = pdf["n"].to_numpy(np.int64)
    return pd.DataFrame({"run": [int(pdf["bucket"].iloc[0]) // RUN], "counts": [counts.tobytes()]})


def _prefix(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest values of a set, of which any set linked with it has one among its own."""
    order = np.lexsort((values, counts[_bucket(values)]))
    return values[order[: len(values) - -(-len(values) * OF // PART) + 1]]


def _family_links(family: DataFrame, sure: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of a family's members outside its main component with members of other components."""
    known = stage(family.join(components(sure), "node", "left").select("node", "family", F.coalesce("component", "node").alias("component")), "known")
    by = known.groupBy("family", "component").agg(F.count("*").alias("rows"))
    main = by.groupBy("family").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    counts = np.zeros(ORDER_BUCKETS, np.int64)
    summed = sets.select("shingles").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.groupBy(F.floor(F.col("bucket") / RUN)).applyInPandas(_run, "run long, counts binary").collect():
        counts[r["run"] * RUN : (r["run"] + 1) * RUN] = np.frombuffer(r["counts"], np.int64)
    shared = family.sparkSession.sparkContext.broadcast(counts)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("shingles")]
            for k in range(0, len(full), 64):
                some = [_prefix(x, shared.value) for x in full[k : k + 64]]
                at = pa.array(np.repeat(np.arange(k, k + len(some)), [len(x) for x in some]))
                n = pa.array([len(x) for x in full], pa.int64()).take(at)
                columns = [batch.column(c).take(at) for c in ("family", "node", "component", "outer")]
                yield pa.RecordBatch.from_arrays([*columns, n, pa.array(np.concatenate(some).view(np.int64))], ["family", "node", "component", "outer", "n", "value"])

    members = known.join(main, "family").select("family", "node", "component", (F.col("component") != F.col("main")).alias("outer"))
    full = sets.withColumnRenamed("doc_id", "node")
    postings = stage(
        members.join(full, "node").select("family", "node", "component", "outer", "shingles")
        .mapInArrow(rare, "family long, node long, component long, outer boolean, n long, value long"),
        "postings",
    )
    shared.destroy()
    lists = postings.groupBy("family", "value").agg(F.count("*").alias("rows"), F.min("component").alias("first"), F.max("component").alias("last")).filter("first != last")
    met = stage(postings.join(lists.select("family", "value", "rows"), ["family", "value"]), "met")
    short = met.filter(F.col("rows") <= LIST_ROWS)
    one = short.filter("outer").select("family", "value", F.col("node").alias("x"), F.col("component").alias("xc"), F.col("n").alias("xn"))
    two = short.select("family", "value", F.col("node").alias("y"), F.col("component").alias("yc"), F.col("n").alias("yn"))
    near = (PART * F.least("xn", "yn") >= OF * F.greatest("xn", "yn")) & (F.col("xc") != F.col("yc"))
    pairs = one.join(two, ["family", "value"]).filter(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    hot = met.filter(F.col("rows") > LIST_ROWS).select("family", "node", "outer", "n").distinct()
    return stage(_confirmed(pairs, sets), "family-links").union(stage(_hot_links(stage(hot, "hot"), full), "hot-links"))


def _hot_links(hot: DataFrame, full: DataFrame) -> DataFrame:
    """Links of the members outside with all members of ``hot`` (family, node, outer, n), by blocks of sizes that can be linked."""
    # The sizes of linked sets are in one class or in two next to each other.
    placed = hot.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(PART / OF))).cast("int"))
    cells = placed.groupBy("family", "size").agg(*[
        F.ceil(F.greatest(F.count(F.when(side, 1)) / BLOCK_ROWS, F.sum(F.when(side, F.col("n") * 8).otherwise(0)) / BLOCK_BYTES)).cast("int").alias(name)
        for name, side in (("outer_blocks", F.col("outer")), ("all_blocks", F.lit(True)))
    ])
    cells = stage(cells, "cells")
    mine = F.pmod(F.xxhash64("node"), F.col("own")).cast("int")

    def dealt(rows: DataFrame, own: str, other: str, outer: bool) -> DataFrame:
        to = cells.filter(F.col(other) > 0).select("family", F.col("size").alias("to"), F.col(other).alias("others"))
        at = (
            rows.join(cells.select("family", "size", F.col(own).alias("own")), ["family", "size"])
            .withColumn("to", F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)])))
            .join(to, ["family", "to"])
            .select("family", "node", "size", mine.alias("block"), "to", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
        )
        names = ("size", "block", "to", "other") if outer else ("to", "other", "size", "block")
        return at.select("family", *[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], "node", F.lit(outer).alias("outer"))

    rows = dealt(placed.filter("outer"), "outer_blocks", "all_blocks", True).union(dealt(placed, "all_blocks", "outer_blocks", False))
    return rows.join(full, "node").groupBy("family", "k0", "k1", "k2", "k3").applyInPandas(_block_links, "a long, b long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) of which one document of each component stays, that with the smallest doc_id.

    Of rows with one doc_id one stays. Rows with a null doc_id are in no
    component and all stay. Lists of ids go to the scan while they are short
    and are joined by a shuffle beyond that; the rows are the same.
    """
    found = stage(near_duplicates(docs), "components")
    named = found.filter("doc_id is not null")
    lost = named.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("kept").alias("kept"))
    gone = stage(lost.filter("not kept or rows > 1").select("doc_id", "kept"), "gone")
    twice = gone.filter("kept").select("doc_id")
    once = docs.join(_sized(gone.select("doc_id")), "doc_id", "left_anti")
    return once.union(docs.join(_sized(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


def _sized(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
