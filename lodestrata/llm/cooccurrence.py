"""Items that appear together: pair counts and how far they exceed chance, by a blocked Gram matrix.

Baskets are the rows of a sparse binary matrix, items its columns. The matrix is cut into blocks of baskets; each block
gives the product of its transpose with itself, summed inside the task, so what travels are compact partial counts. A
basket of very many items is also cut into blocks of items, one task per pair of blocks, so no basket is one task's work.
Counts are then held against the expected marginals.

Three facts thin the matrix without losing a case, since n(a,b) <= min(n(a), n(b)):
an item in fewer than ``least`` baskets has no case; n(a,b)*N >= lift*n(a)*n(b) needs max(n(a), n(b)) <= N/lift, which
takes out the items that are in most baskets; and n(a,b) >= max(n(a), n(b))/2 needs counts within a factor of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import checkpointed

#: Items of one item block; a larger basket is cut into blocks.
ITEM_BLOCK = 1024
#: Products gathered in a task before they are summed.
GATHER = 1 << 21
#: Summed partial counts that a task holds before it hands them on.
HOLD = 1 << 22
#: Hashes that are tried for ids that no two items share.
SEEDS = 4
#: Large baskets that are broadcast; 24 bytes each.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Bounds:
    """A pair is a case from ``least`` common baskets, ``1/share`` of each item's baskets and ``lift`` times chance on."""

    least: int = 5
    share: int = 2
    lift: int = 4


DEFAULT = Bounds()


def item_hash(seed: int) -> Column:
    """The id of an item inside its cell."""
    return F.xxhash64(F.lit(seed), "item")


def item_rows(parts: DataFrame) -> DataFrame:
    """``scope, basket, kind, item`` of ``scope, basket, file, component``: files and components by commit.

    Null items are left out, and of the components ``''`` and ``Unknown``. Rows are not yet distinct.
    """
    named = F.array(
        F.struct(F.lit("file").alias("kind"), F.col("file").alias("item")),
        F.struct(
            F.lit("component").alias("kind"),
            F.when(~F.col("component").isin("", "Unknown"), F.col("component")).alias("item"),
        ),
    )
    return (
        parts.select("scope", "basket", F.explode(named).alias("x"))
        .select("scope", "basket", "x.kind", "x.item")
        .where(F.col("item").isNotNull())
    )


def _products(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of item pairs from rows sorted by basket: ``cell, basket, item, n, block`` per row.

    ``cell`` is the scope and kind, ``block`` 0 for rows of a basket in one block, else 1 and 2 for the two item blocks
    whose rows are multiplied, 3 for a block with itself.
    """
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def summed(parts):
        c, a, b, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, a, c))
        c, a, b, k = c[order], a[order], b[order], k[order]
        new = np.ones(len(c), dtype=bool)
        new[1:] = (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        return c[at], a[at], b[at], np.add.reduceat(k, at) if len(at) else k

    def out(parts):
        c, a, b, k = summed(parts)
        for i in range(0, len(c), 200_000):
            s = slice(i, i + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (c, a, b, k)], ["cell", "a", "b", "n_ab"])

    def multiply(cell, item, n, side, starts):
        """Cells of the products of the baskets that begin at ``starts``, a bounded number at a time.

        The product is symmetric, so only its upper half is made.
        """
        sizes = np.diff(starts)
        at = 0
        while at < len(sizes):
            # baskets of together at most GATHER products, one at least
            work = np.cumsum(sizes[at:] ** 2)
            take = max(1, int(np.searchsorted(work, GATHER, side="right")))
            lo, hi = starts[at], starts[at + take]
            size = sizes[at : at + take]
            ends = np.repeat(starts[at + 1 : at + take + 1], size)
            rows = np.arange(lo, hi)
            # each row with the later rows of its basket: every pair once
            later = ends - rows - 1
            left = np.repeat(rows, later)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
            i, j = item[left], item[right]
            near = (n[left] <= share * n[right]) & (n[right] <= share * n[left])
            # rows of two item blocks are multiplied across only
            ok = near & ((side[left] != side[right]) | (side[left] == 0) | (side[left] == 3))
            left, i, j = left[ok], i[ok], j[ok]
            low, high = np.minimum(i, j), np.maximum(i, j)
            if len(low):
                yield summed([(cell[left], low, high, np.ones(len(low), dtype=np.int64))])
            at += take

    rest: list[np.ndarray] | None = None

    def flush(cols):
        nonlocal held
        cell, basket, item, n, side, part = cols
        new = np.ones(len(cell), dtype=bool)
        new[1:] = (basket[1:] != basket[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
        starts = np.append(np.flatnonzero(new), len(cell))
        for made in multiply(cell, item, n, side, starts):
            kept.append(made)
            held += len(made[0])
            if held > HOLD:
                one = summed(kept)
                kept.clear()
                if len(one[0]) > HOLD // 2:
                    yield from out([one])
                    held = 0
                else:
                    kept.append(one)
                    held = len(one[0])

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "basket", "item", "n", "side", "part")]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        # the last basket may go on in the next batch
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[5] == cols[5][-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = [c[cut:] for c in cols]
        if cut:
            yield from flush([c[:cut] for c in cols])
    if rest is not None and len(rest[0]):
        yield from flush(rest)
    if kept:
        yield from out(kept)


def _large_baskets(per_basket: DataFrame, item_block: int) -> DataFrame | None:
    """The baskets with more rows than an item block, or None if there are none.

    Their number is counted first. Few of them (24 bytes each) are broadcast; beyond the limit the join shuffles.
    """
    large = per_basket.where(F.col("n_rows") > item_block).select("basket", "n_rows")
    known = large.count()
    if not known:
        return None
    return F.broadcast(large) if known <= BROADCAST_ROWS else large


def pair_counts(
    rows: DataFrame, per_basket: DataFrame, bounds: Bounds, item_block: int = ITEM_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Counts of item pairs, and the items they are about.

    ``rows`` has ``scope, basket, kind, item`` with ``basket`` a 64-bit id, ``per_basket`` has ``scope, basket, n_rows``
    of every basket. Pairs are counted between items of one scope and kind. Returns ``cell, a, b, n_ab`` over all pairs
    that can still be a case, and ``cell, id, kind, item, n_item, n_baskets`` of their items. Ids are 64-bit hashes inside
    a cell, and cells are 64-bit hashes, too; should two items of one cell share an id, another hash is taken.
    """
    for seed in range(SEEDS):
        cell = F.xxhash64(F.lit(seed), "scope", "kind").alias("cell")
        hashed = rows.select("scope", "kind", "basket", "item", cell, item_hash(seed).alias("id"))
        # Names travel once per task and item, not with every row; text is a key here, as an aggregate of text would sort.
        distinct_names = hashed.groupBy("scope", "kind", "item").agg(F.first("cell").alias("cell"), F.first("id").alias("id"))
        names = checkpointed(
            distinct_names.groupBy("cell", "id").agg(
                F.min("scope").alias("scope"), F.min("kind").alias("kind"), F.min("item").alias("item"), F.count(F.lit(1)).alias("_names")
            )
        )
        if names.where(F.col("_names") > 1).isEmpty():
            break
    else:
        raise ValueError("items share their ids under every hash")
    incidence = hashed.select("cell", "basket", "id").distinct()
    totals = per_basket.groupBy(F.col("scope").alias("b_scope")).agg(F.count(F.lit(1)).alias("n_baskets"))
    sizes = incidence.groupBy("cell", "id").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= bounds.least)
    items = (
        names.join(sizes, ["cell", "id"])
        .join(totals, F.col("scope").eqNullSafe(F.col("b_scope")))
        .where(F.col("n_item") * bounds.lift <= F.col("n_baskets"))
        .select("cell", "id", "kind", "item", "n_item", "n_baskets")
    )
    thin = incidence.join(items.select("cell", "id", F.col("n_item").cast("int").alias("n")), ["cell", "id"])
    large = _large_baskets(per_basket, item_block)
    blocks = [
        (thin if large is None else thin.join(large, "basket", "left_anti"))
        .select("cell", "basket", F.col("id").alias("item"), "n", F.lit(0).alias("side"), F.lit(0).alias("part"))
        .repartition("cell", "basket")
    ]
    if large is not None:
        # item blocks, and one part for each pair of blocks
        k = F.ceil(F.col("n_rows") / item_block).cast("int")
        block = F.pmod(F.col("id"), k.cast("long")).cast("int")
        side = F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2)
        blocks.append(
            thin.join(large, "basket")
            .select("cell", "basket", F.col("id").alias("item"), "n", k.alias("k"), block.alias("block"))
            .select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
            .select(
                "cell",
                "basket",
                "item",
                "n",
                side.alias("side"),
                (1 + F.least("block", "other") * F.col("k") + F.greatest("block", "other")).alias("part"),
            )
            .repartition("cell", "basket", "part")
        )
    share = bounds.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _products(batches, share)

    partial = None
    for rows_of_blocks in blocks:
        one = rows_of_blocks.sortWithinPartitions("cell", "basket", "part").mapInArrow(
            run, "cell long, a long, b long, n_ab long"
        )
        partial = one if partial is None else partial.unionByName(one)
    counts = partial.groupBy("cell", "a", "b").agg(F.sum("n_ab").alias("n_ab")).where(F.col("n_ab") >= bounds.least)
    return counts, items


def together(parts: DataFrame, bounds: Bounds = DEFAULT, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Pairs of files and of components of one repository that change together more than chance would have it.

    ``item_kind, item_a, item_b, repo_cell, n_ab, n_a, n_b, n_commits, lift`` with ``item_a < item_b`` in byte order;
    n counts distinct commits, of the repository for ``n_commits`` (all its rows). ``lift`` is n(a,b)*N / (n(a)*n(b)).

    Defined cases: repeated rows count once; null and unnamed items do not count; rows without commit hash do not count;
    a null repository is a repository; no rows give no rows; further columns are ignored.
    """
    basket = F.xxhash64("repo", "commit_hash")
    parts = parts.where(F.col("commit_hash").isNotNull()).select(
        F.col("repo").alias("scope"), basket.alias("basket"), "file", "component"
    )
    per_basket = parts.groupBy("scope", "basket").agg(F.count(F.lit(1)).alias("n_rows"))
    counts, items = pair_counts(item_rows(parts), per_basket, bounds, item_block)
    a = items.select("cell", F.col("id").alias("a"), "kind", F.col("item").alias("name_a"), F.col("n_item").alias("n_a"), "n_baskets")
    b = items.select("cell", F.col("id").alias("b"), F.col("item").alias("name_b"), F.col("n_item").alias("n_b"))
    met = (
        counts.join(a, ["cell", "a"])
        .where(F.col("n_ab") * bounds.share >= F.col("n_a"))
        .join(b, ["cell", "b"])
        .where(
            (F.col("n_ab") * bounds.share >= F.col("n_b"))
            & (F.col("n_ab") * F.col("n_baskets") >= bounds.lift * F.col("n_a") * F.col("n_b"))
        )
    )
    swap = F.col("name_a") > F.col("name_b")
    return met.select(
        F.col("kind").alias("item_kind"),
        F.least("name_a", "name_b").alias("item_a"),
        F.greatest("name_a", "name_b").alias("item_b"),
        F.col("cell").alias("repo_cell"),
        "n_ab",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        F.col("n_baskets").alias("n_commits"),
        F.round(F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b")), 6).alias("lift"),
    )
