"""Near-duplicate detection with bottom-k sketches.

A document's set holds the hashes of its distinct word shingles (:mod:`.textsets`).  One hash function
orders all shingles; the sketch keeps the ``SKETCH`` smallest.

1. Equal sets form one class; only its smallest id goes on, so exact copies never meet in pairs.
2. Two sets above the similarity share at least ``SHARED`` values of their sketches (the chance of fewer is
   below one in a million for a pair at the threshold).  With the rarest retained values first, it is enough to look up
   each sketch's first ``SKETCH - SHARED + 1`` values in the inverted lists.
3. The members of an inverted list form a group under the list's most typical member; lists with the same
   centre form one group.  In groups above ``BLOCK`` members all are first compared with the centre alone, block by block:
   those that are linked with it are settled, as two of them need no link of their own.  The others are compared with
   all members, dealt out as pairs of blocks, so no task holds an unbounded group and none is capped.
4. Inside a group the bottom-k sketch of the union estimates the similarity; documents with no partner
   above the threshold less a slack leave.
5. Full sets of the rest are compared exactly; each block emits a spanning forest of its links only.
6. Connected components run over these links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.llm.common import by_group, column, components, int64, list_array, lists, lookup, trim
from varloom.llm.textsets import mix64, shingle_sets

#: Values that a sketch retains, and values that two similar sketches share at least.
SKETCH = 48
SHARED = 24
#: Members of a block.
BLOCK = 512

#: The least likeness that may be asked for.
LEAST_PERCENT = 60


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, fp_a, fp_b, sketch): set size, 128-bit fingerprint of the whole set, bottom-k sketch."""

    def run(batches):
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for first, end, h, o in shingle_sets(texts, words):
                sums = [
                    np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(salt)), dtype=np.uint64)))
                    for salt in (0x51ED270B, 0xA0761D6478BD642F)
                ]
                fps = [(s[o[1:]] - s[o[:-1]]).view(np.int64) for s in sums]
                n = np.diff(o)
                k = np.minimum(n, SKETCH)
                out = np.concatenate(([0], np.cumsum(k)))
                pick = np.repeat(o[:-1] - out[:-1], k) + np.arange(out[-1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(n, pa.int64()), *map(pa.array, fps), list_array(h[pick].view(np.int64), out, pa.int64())],
                    names=["doc_id", "n", "fp_a", "fp_b", "sketch"],
                )
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, fp_a long, fp_b long, sketch array<long>"
    )


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): whole sets."""

    def run(batches):
        for batch in batches:
            ids = column(batch, "doc_id")
            for first, end, h, o in shingle_sets(column(batch, "text"), words):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), list_array(h.view(np.int64), o, pa.int64())], names=["doc_id", "shingles"]
                )
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def overlaps(values: np.ndarray, offsets: np.ndarray):
    """For each list i in turn: (i, how many values each list has in common with it)."""
    m = len(offsets) - 1
    owner = np.repeat(np.arange(m), np.diff(offsets))
    _, ids = np.unique(values, return_inverse=True)
    count = np.bincount(ids)
    if m * len(count) <= 1 << 21:
        table = np.zeros((m, len(count)), np.float32)
        table[owner, ids] = 1
        common = (table @ table.T).astype(np.int64)
        yield from enumerate(common)
        return
    order = np.argsort(ids, kind="stable")
    post, start = owner[order], np.concatenate(([0], np.cumsum(count)))
    for i in range(m):
        mine = ids[offsets[i] : offsets[i + 1]]
        width = count[mine]
        before = np.cumsum(width) - width
        yield i, np.bincount(post[np.repeat(start[mine] - before, width) + np.arange(width.sum())], minlength=m)


def _maybe(i: int, j: int, common: int, n: np.ndarray, values: np.ndarray, offsets: np.ndarray, low: float) -> bool:
    """Whether the similarity of i and j may reach the threshold, by their sketches and what these have in common."""
    if n[i] <= SKETCH and n[j] <= SKETCH:
        return common / (n[i] + n[j] - common) >= low - 1e-9
    # the union's bottom-k: up to the smaller of the two last values of cut sketches
    cut = min(int(values[offsets[x + 1] - 1]) for x in (i, j) if n[x] > SKETCH)
    a, b = (values[offsets[x] : offsets[x + 1]] for x in (i, j))
    a, b = a[a <= cut], b[b <= cut]
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both >= union * low - 6.5 * np.sqrt(union * low * (1 - low)) - 1


def _promising(percent: int):
    """Members of a group with a partner whose estimated similarity may reach the threshold."""
    low = percent / 100

    def run(table: pa.Table) -> pa.RecordBatch | None:
        batch = table.combine_chunks().to_batches()[0]
        m = batch.num_rows
        if m < 2:
            return None
        ids, n = int64(column(batch, "rep")), int64(column(batch, "n"))
        block = int64(column(batch, "own"))
        cross = int64(column(batch, "i"))[0] != int64(column(batch, "j"))[0]
        values, offsets = lists(column(batch, "sketch"))
        k, unsigned = np.diff(offsets), values.view(np.uint64)
        good = np.zeros(m, dtype=bool)
        for i, common in overlaps(values, offsets):
            near = common >= np.minimum(SHARED, np.minimum(k, k[i]) * (low - 0.08))
            near &= (np.minimum(n, n[i]) >= low * np.maximum(n, n[i])) & (common > 0)
            near[i] = False
            if cross:
                near &= block != block[i]
            for j in np.flatnonzero(near & ~(good & good[i])):
                if _maybe(i, j, common[j], n, unsigned, offsets, low):
                    good[[i, j]] = True
        if not good.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(int64(column(batch, "center"))[good]), pa.array(ids[good])], names=["center", "rep"])

    return run


def _with_center(values: np.ndarray, offsets: np.ndarray, center: int) -> np.ndarray:
    """How many values each list has in common with the center's."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(owner[np.isin(values, values[offsets[center] : offsets[center + 1]])], minlength=len(offsets) - 1)


def _like_center(percent: int):
    """Members of a block whose estimated similarity to the center may reach the threshold, and the center."""
    low = percent / 100

    def run(table: pa.Table) -> pa.RecordBatch | None:
        batch = table.combine_chunks().to_batches()[0]
        ids, n, center = int64(column(batch, "rep")), int64(column(batch, "n")), int64(column(batch, "center"))
        c = int(np.flatnonzero(ids == center)[0])
        values, offsets = lists(column(batch, "sketch"))
        k, common = np.diff(offsets), _with_center(values, offsets, c)
        near = (common >= np.minimum(SHARED, np.minimum(k, k[c]) * (low - 0.08))) & (np.minimum(n, n[c]) >= low * np.maximum(n, n[c])) & (common > 0)
        good = np.array([j for j in np.flatnonzero(near) if j == c or _maybe(c, j, common[j], n, values.view(np.uint64), offsets, low)], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(center[good]), pa.array(ids[good])], names=["center", "rep"]) if len(good) > 1 else None

    return run


def _linked_with_center(percent: int):
    """The exact links of a block's members with the center."""

    def run(table: pa.Table) -> pa.RecordBatch | None:
        batch = table.combine_chunks().to_batches()[0]
        ids, center = int64(column(batch, "rep")), int64(column(batch, "center"))
        c = int(np.flatnonzero(ids == center)[0])
        values, offsets = lists(column(batch, "shingles"))
        n, common = np.diff(offsets), _with_center(values, offsets, c)
        linked = 100 * common >= percent * (n + n[c] - common)
        linked[c] = False
        return pa.RecordBatch.from_arrays([pa.array(center[linked]), pa.array(ids[linked])], names=["center", "rep"]) if linked.any() else None

    return run


def _links(percent: int):
    """A spanning forest of the exact links inside one group."""

    def run(table: pa.Table) -> pa.RecordBatch | None:
        batch = table.combine_chunks().to_batches()[0]
        m = batch.num_rows
        if m < 2:
            return None
        ids, block = int64(column(batch, "rep")), int64(column(batch, "own"))
        cross = int64(column(batch, "i"))[0] != int64(column(batch, "j"))[0]
        values, offsets = lists(column(batch, "shingles"))
        n = np.diff(offsets)
        root = np.arange(m)

        found: list[tuple[int, int]] = []
        for i, common in overlaps(values, offsets):
            linked = 100 * common >= percent * (n + n[i] - common)
            linked[i] = False
            if cross:
                linked &= block != block[i]
            for j in np.flatnonzero(linked & (root != root[i])):
                if root[j] != root[i]:
                    found.append((int(ids[i]), int(ids[j])))
                    root[root == root[j]] = root[i]
        if not found:
            return None
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _dealt(groups: DataFrame) -> DataFrame:
    """(center, rep, settled) as rows of pairs of blocks, of which one at least holds rows that aren't settled.

    A group of at most BLOCK members is one pair.
    """
    sizes = groups.groupBy("center").agg(F.count_if(~F.col("settled")).alias("u"), F.count_if("settled").alias("s")).filter("u > 0 and u + s > 1")
    blocks = sizes.select("center", F.ceil(F.col("u") / BLOCK).cast("int").alias("open"), F.ceil(F.col("s") / BLOCK).cast("int").alias("shut"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(F.col("settled"), F.col("open") + place(F.col("shut"))).otherwise(place(F.col("open")))
    others = F.when(F.col("settled"), F.sequence(F.lit(0), F.col("open") - 1)).otherwise(F.sequence(F.lit(0), F.col("open") + F.col("shut") - 1))
    dealt = groups.join(blocks, "center").withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.select("center", "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _around_centers(groups: DataFrame) -> DataFrame:
    """(center, rep, i): the members of groups above BLOCK by blocks, with the center in each."""
    sizes = groups.groupBy("center").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK)
    blocks = sizes.select("center", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    place = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.when(F.col("rep") == F.col("center"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(place)
    return groups.join(blocks, "center").select("center", "rep", F.explode(every).alias("i"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` has doc_id and text.  Documents are linked if 100 * intersection >= percent * union of their
    sets of distinct ``words``-word shingles; component_id is the smallest doc_id reachable.

    A null or wordless text has the empty set and is linked with nothing.  Repeated rows give a row each; rows
    that share a doc_id are one document.  A row whose doc_id is null takes part through the copies of its text
    that have ids; without such it has no component, and it is never kept.  ``percent`` is at least LEAST_PERCENT: for less alike
    sets the sketches' filter would lose links.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100")
    folder = shared_folder(docs.sparkSession)
    all_docs = materialize(sketches(docs, words), folder, "sketches")
    classes = materialize(
        all_docs.filter("n > 0")
        .groupBy("fp_a", "fp_b")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .filter("rep is not null"),
        folder,
        "classes",
    )

    values = classes.select("rep", "n", F.explode("sketch").alias("v"))
    known = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = F.least(F.col("n"), F.lit(SKETCH)).cast("int")
    needed = F.when(F.col("n") <= SKETCH, F.ceil(F.col("n") * (percent / 100 - 0.08))).otherwise(F.lit(SHARED)).cast("int")
    posts = (
        values.join(known, "v")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
        .withColumn("alone", held - F.size("s"))
        .withColumn("slots", held - needed + 1 - F.col("alone"))
        .filter("slots > 0")
        .select("rep", "alone", F.explode(F.slice("s", F.lit(1), F.col("slots"))).alias("e"))
        .select("rep", "alone", F.col("e.v").alias("v"))
    )
    posts = materialize(posts, folder, "posts")
    centers = (
        posts.groupBy("v")
        .agg(F.min(F.struct("alone", "rep")).alias("c"), F.count(F.lit(1)).alias("_m"))
        .filter("_m > 1")
        .select("v", F.col("c.rep").alias("center"))
    )
    groups = materialize(posts.join(centers, "v").select("center", "rep").distinct(), folder, "groups")

    one = classes.select("rep", "n", "sketch")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sets_of(rows: DataFrame) -> DataFrame:
        wanted = rows.select(F.col("rep").alias("doc_id")).distinct()
        return full_sets(texts.join(wanted, "doc_id", "left_semi"), words).withColumnRenamed("doc_id", "rep").dropDuplicates(["rep"])

    around = materialize(_around_centers(groups), folder, "around")
    like = by_group(around.join(one, "rep"), ["center", "i"], _like_center(percent), "center long, rep long")
    like = materialize(like.distinct(), folder, "like")
    around = around.join(like, ["center", "rep"], "left_semi")
    settled = by_group(around.join(sets_of(like), "rep"), ["center", "i"], _linked_with_center(percent), "center long, rep long")
    settled = materialize(settled.distinct(), folder, "settled")

    def marked(rows: DataFrame, name: str) -> DataFrame:
        known = settled.withColumn("settled", F.lit(True))
        joined = rows.join(known, ["center", "rep"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
        return materialize(joined.select("center", "rep", "settled"), folder, name)

    near = by_group(_dealt(marked(groups, "marked")).join(one, "rep"), ["center", "i", "j"], _promising(percent), "center long, rep long")
    near = marked(near.distinct(), "near")
    # in order, so that a task that is run again finds the same forest
    links = by_group(_dealt(near).join(sets_of(near), "rep"), ["center", "i", "j"], _links(percent), "a long, b long", "rep")
    links = links.unionByName(settled.select(F.col("center").alias("a"), F.col("rep").alias("b")))
    found = components(links, folder, "components")

    named = (
        classes.join(found, F.col("rep") == F.col("node"), "left")
        .filter("copies > 1 or component is not null")
        .select("fp_a", "fp_b", F.coalesce("component", "rep").alias("component"))
    )
    named = materialize(named, folder, "named")
    out = lookup(all_docs.select("doc_id", "n", "fp_a", "fp_b"), named, ["fp_a", "fp_b"])
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
