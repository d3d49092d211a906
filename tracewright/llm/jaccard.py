"""Near duplicates: an exact n-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix A has a row per document and a column per hashed n-gram; overlaps are the entries
of A times its transpose. Columns are counted in an exchange over all documents; a column with one
entry adds to no overlap, and a document needs three quarters of its entries in other columns, or it
is linked with nothing and its row is dropped. Equal rows are merged.

The product is cut into blocks by the columns of each row's rarest entries: rows that agree on none of
these can't overlap enough (the size bound). Of each such column the row with the fewest entries of
its own is the centre, and a sparse product of all rows with their centres accumulates overlap counts.
With r entries of the centre c missing in a row and s others in their place, two rows a and b overlap
in |c| - r(a) - r(b) + x entries, x being the differences they share. Rows linked with the centre are
connected already; of columns that hold the same rows one is taken. Any other link needs an x that sizes bound from above, which leaves few rows; these
meet again around a new centre, and what is left then is multiplied out in blocks
of bounded size, where overlap counts accumulate over the columns and a task gives a spanning forest
of its links. A large group of near copies thus costs its size, not its square, hot columns are split
by rows, and no link between different components is lost. Entries are 64-bit hashes of n-grams.

Null and empty texts have no n-grams and are linked with nothing; shorter texts have one, their whole
word sequence. Rows with equal ids count as one document. Rows without an id are linked with nothing
and have no component. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import Answers, exchange, numbered, total_capped
from .storage import as_scan, written
from .words import LOWERED, Block, mixed, window_hashes

#: Rounds of products with centres before blocks are multiplied out.
CENTRES = 2
#: Rows, and entries, of a side of a block that is multiplied out, about.
BLOCK_ROWS, BLOCK_ENTRIES = 512, 1 << 19
#: Columns of a block with more rows are multiplied densely, so many at a time.
DENSE_ROWS, DENSE_COLUMNS = 16, 2048
#: Texts that go to a Python worker at once.
BATCH_ROWS = 1024
#: Entries in one step of a product with centres.
STEP_ENTRIES = 1 << 19


def ngram_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and their bounds."""
    hashes, bounds = block.words(LOWERED)
    counts = np.diff(bounds)
    whole = window_hashes(hashes, n)
    short = {k: window_hashes(hashes, k) for k in range(1, n) if (counts == k).any()}
    sets, ends = [], [0]
    for a, size in zip(bounds[:-1].tolist(), counts.tolist()):
        if size >= n:
            grams = np.sort(whole[a : a + size - n + 1])
            grams = grams[np.append(True, grams[1:] != grams[:-1])]
        elif size:
            grams = mixed(short[size][a : a + 1] + np.uint64(size))
        else:
            grams = whole[:0]
        sets.append(grams)
        ends.append(ends[-1] + len(grams))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array(ends)


def _least_overlap(n: int, percent: int) -> int:
    """Entries that a set of n shares with any set it links with, at least."""
    return -(-percent * n // 100)


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a binary column of rows, and their bounds."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), np.uint64), (at - at[0]) // 8


def overlaps(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Overlap of each row of left with the row of right beside it: a sparse product, step by step."""
    a, at_a = _entries(left)
    b, at_b = _entries(right)
    out = np.zeros(len(left), np.int64)
    both = at_a + at_b
    low = 0
    while low < len(out):
        to = max(low + 1, int(np.searchsorted(both, both[low] + STEP_ENTRIES)) - 1)
        sides = [(a, at_a), (b, at_b)]
        row = np.concatenate([np.repeat(np.arange(to - low, dtype=np.uint64), np.diff(at[low : to + 1])) for _, at in sides])
        entry = np.concatenate([x[at[low] : at[to]] for x, at in sides])
        order = np.lexsort((entry, row))
        row, entry = row[order], entry[order]
        same = (row[1:] == row[:-1]) & (entry[1:] == entry[:-1])
        out[low:to] = np.bincount(row[1:][same].astype(np.int64), minlength=to - low)
        low = to
    return out


def block_forest(rows: list[np.ndarray], sizes: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows, as pairs of row numbers; side: 0 or 1, links go across sides only."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    _, column, held = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    least, most = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    open_ = (100 * least >= percent * most) & ~np.eye(n, dtype=bool)
    if side is not None:
        open_ &= side[:, None] != side[None, :]
    counts = np.zeros((n, n), np.int32)
    heavy = held[column] > DENSE_ROWS
    order = np.lexsort((row[~heavy], column[~heavy]))
    r, c = row[~heavy][order], column[~heavy][order]
    for step in range(1, DENSE_ROWS):  # columns of few rows: pairs along the column
        at = np.flatnonzero(c[step:] == c[:-step]) if len(c) > step else c[:0]
        if not len(at):
            break
        np.add.at(counts, (r[at], r[at + step]), 1)
    counts += counts.T
    rest = np.bincount(row[heavy], minlength=n)
    need = lambda o: (100 + percent) * o >= percent * (sizes[:, None] + sizes[None, :])
    open_ &= need(counts + np.minimum.outer(rest, rest))  # what the other columns can still add
    live = np.flatnonzero(open_.any(axis=1))
    if not len(live):
        return []
    place = np.full(n, -1)
    place[live] = np.arange(len(live))
    keep = heavy & (place[row] >= 0)
    r, (names, c) = place[row[keep]], np.unique(column[keep], return_inverse=True)
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    dense = np.zeros((len(live), len(live)), np.float32)
    for low in range(0, len(names), DENSE_COLUMNS):
        x, y = np.searchsorted(c, [low, low + DENSE_COLUMNS])
        part = np.zeros((len(live), DENSE_COLUMNS), np.float32)
        part[r[x:y], c[x:y] - low] = 1
        dense += part @ part.T
    counts[np.ix_(live, live)] += dense.astype(np.int32)
    linked = open_ & need(counts)
    label = np.arange(n)
    found = []
    for start in range(n):  # a walk from each row not reached yet
        if label[start] != start:
            continue
        label[start], stack = -1, [start]
        while stack:
            x = stack.pop()
            new = np.flatnonzero(linked[x] & (label >= 0))
            label[new] = -1
            found += [(x, int(y)) for y in new]
            stack += new.tolist()
    return found


def _columns(rows: DataFrame) -> DataFrame:
    """Columns (gram, c, rows) of two rows or more, one of those that hold the same rows; c: the row with the least lead."""
    by = F.xxhash64("doc")
    held = rows.groupBy("gram").agg(F.min(F.struct("lead", "doc")).alias("c"), F.count(F.lit(1)).alias("rows"), F.bit_xor(by).alias("x"), F.sum(F.pmod(by, F.lit(1 << 31))).alias("y"))
    held = held.where("rows >= 2").select("gram", F.col("c.doc").alias("c"), "rows", "x", "y")
    return held.groupBy("c", "rows", "x", "y").agg(F.min("gram").alias("gram")).select("gram", "c", "rows")


def _linked_pairs(live: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect all linked rows of each column of live (gram, doc, lead); rows are multiplied out in blocks."""
    live = live.join(_columns(live).select("gram", "c"), "gram").select(F.col("c").alias("gram"), "doc").distinct()  # columns of one centre hold much the same rows
    live = written(live, "live")
    sized = live.join(matrix.select(F.col("doc_id").alias("doc"), "n", "row"), "doc")
    sizes = live.join(matrix.select(F.col("doc_id").alias("doc"), "n"), "doc").groupBy("gram")
    sizes = sizes.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_ENTRIES)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    dealt = sized.join(sizes, "gram").select("gram", "doc", "n", "row", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("gram", "doc", "n", "row", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc", kind="stable")
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        docs = group["doc"].to_numpy()
        pairs = block_forest([np.frombuffer(r, np.uint64) for r in group["row"]], group["n"].to_numpy(np.int64), percent, None if i == j else (group["own"] == j).to_numpy(np.int8))
        return pd.DataFrame([(docs[x], docs[y]) for x, y in pairs], columns=["a", "b"], dtype="int64")

    return dealt.groupBy("gram", "i", "j").applyInPandas(multiply, "a long, b long").distinct()


def linked_components(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    given = as_scan(docs, "documents", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), batch_rows=BATCH_ROWS)

    def column_keys(part: int, number: int, block: Block) -> tuple[np.ndarray, np.ndarray]:
        entries, bounds = ngram_sets(block, n)
        keys, counts = np.unique(entries[np.repeat(block.known, np.diff(bounds))], return_counts=True)
        return keys, np.minimum(counts, 255)

    counted = exchange(given, column_keys, total_capped, "columns")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = None
        for part, number, block in numbered(batches):
            answers = answers or Answers(counted, part)
            entries, bounds = ngram_sets(block, n)
            used = np.repeat(block.known, np.diff(bounds))
            keys, at = np.unique(entries[used], return_inverse=True)
            held_by = np.zeros(len(entries), np.uint8)
            held_by[used] = answers.of(number, block, len(keys))[at]
            sizes, hashed, shared_rows = np.diff(bounds), [], []
            for known, a, b in zip(block.known.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                size, key, row = b - a, None, None
                shared = held_by[a:b] >= 2
                if known and size and int(shared.sum()) >= _least_overlap(size, percent):
                    grams = entries[a:b]
                    key = np.array([mixed(grams).sum(), mixed(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(), size], np.uint64).tobytes()
                    grams, common = grams[shared], held_by[a:b][shared]
                    row = grams[np.argsort(common, kind="stable")].tobytes()  # rarest first, then by hash
                hashed.append(key)
                shared_rows.append(row)
            yield pa.RecordBatch.from_arrays([block.id_column(), pa.array(sizes, pa.int64()), pa.array(hashed, pa.binary()), pa.array(shared_rows, pa.binary())], names=["doc_id", "n_shingles", "key", "row"])

    table = written(given.mapInArrow(rows, "doc_id long, n_shingles long, key binary, row binary"), "rows")
    kept = table.where("key is not null")
    merged = written(kept.groupBy("key").agg(F.min("doc_id").alias("first")), "merged")
    members = kept.select("doc_id", "key").join(merged, "key").where("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    firsts = merged.select(F.col("key").alias("first_key"), F.col("first").alias("doc_id"))
    matrix = kept.join(firsts, "doc_id").where(F.col("key") == F.col("first_key")).select("doc_id", F.col("n_shingles").alias("n"), "row").dropDuplicates(["doc_id", "n", "row"])
    matrix = written(matrix, "matrix")

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, at = _entries(batch.column(2))
            size = batch.column(1).to_numpy()
            alone = size - np.diff(at)  # entries in columns of their own come before these
            m = size + (-percent * size // 100) + 1 - alone
            row = np.repeat(np.arange(len(m)), m)
            place = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            columns = [pa.array(grams[place].view(np.int64)), pa.array(batch.column(0).to_numpy()[row]), pa.array(alone[row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "doc", "lead"])

    def around_centres(rows: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
        """(links with centres, rows of columns that may have more): rows are (gram, doc, lead), the least lead being the centre."""
        centres = _columns(rows).select("gram", "c", (F.col("rows") >= 3).alias("more"))
        beside = rows.join(centres, "gram").where("doc != c").select(F.when(F.col("more"), F.col("gram")).alias("gram"), F.col("doc").alias("a"), "c", F.when(F.col("more"), F.col("lead")).alias("lead"))
        beside = written(beside, "beside")
        left = matrix.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("row").alias("ra"))
        right = matrix.select(F.col("doc_id").alias("c"), F.col("n").alias("nc"), F.col("row").alias("rc"))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, c, na, nc, ra, rc = batch.columns
                sizes, of_centre = na.to_numpy(), nc.to_numpy()
                shared = overlaps(ra, rc)
                differ = 100 * (of_centre - shared) + percent * (sizes - shared)
                common = of_centre + np.diff(_entries(ra)[1]) - 2 * shared  # differences that another row can share
                excess = differ - (100 - percent) * of_centre
                yield pa.RecordBatch.from_arrays([a, c, pa.array(excess), pa.array((100 + percent) * common - differ)], names=["a", "c", "excess", "slack"])

        joined = beside.select("a", "c").distinct().join(left, "a").join(right, "c").select("a", "c", "na", "nc", "ra", "rc")
        found = written(joined.mapInArrow(product, "a long, c long, excess long, slack long"), "products")
        links = found.where("excess <= 0").select("a", F.col("c").alias("b"))
        # a link of two rows needs the slack of each to reach the excess of the other
        several = beside.where("gram is not null")
        apart = several.join(found.where("excess > 0"), ["a", "c"]).select("gram").distinct()
        placed = written(several.join(apart, "gram", "left_semi").join(found, ["a", "c"]), "placed")
        bounds = placed.groupBy("gram").agg(F.max("slack").alias("most"))
        able = placed.join(bounds, "gram").where("excess <= most")
        needs = able.where("excess > 0").groupBy("gram").agg(F.min("excess").alias("least"))
        lead = F.when(F.col("excess") > 0, F.col("lead")).otherwise(1 << 30).cast("int")  # the next centre is a row apart from this one
        rest = able.join(needs, "gram").where("excess > 0 or slack >= least").select("gram", F.col("a").alias("doc"), lead.alias("lead"))
        return links, written(rest, f"rest-{round_}")

    live = matrix.mapInArrow(rarest, "gram long, doc long, lead int")
    live = written(live, "rarest")
    links = members
    for round_ in range(CENTRES):
        more, live = around_centres(live, round_)
        links = links.union(more)
        if live.isEmpty():
            break
    else:
        links = links.union(written(_linked_pairs(live, matrix, percent), "links"))
    final = written(components(links), "components")
    return table.join(final, table.doc_id == final.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
