"""Which inverted lists a drawing is put into, so that near copies meet in one and unlike drawings seldom do.

A list's length is measured, not guessed: the tokens of all drawings are counted in ``2**CELL_BITS`` cells by hash, a table whose
size doesn't depend on the corpus. A cell's count is at least that of any token in it. Elements (tokens, or blocks of them) are ordered
by that count, rare ones first, in the same way for all drawings. An element whose count is beyond ``long_list`` above the common level
of the cells has a long list: it is never read through, but cut into the lists of that element with each later one of the drawing.

The searches see to it that near copies share two elements at least of those they are put into lists by. Let x and y be the
first two that are shared. If x isn't long, both are in the list of x; if it is, both are in the list of x with y. The lists of two are as many as
the square of the elements, so drawings of more than ``WIDEST`` of them stay in long lists, and with them those that are just small enough not
to but may have such a near copy: then both are in the list of x.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.drawing import ROWS, in_order, lists, mix

#: Logarithm of the number of cells that tokens are counted in: 262,144 counts go to the driver, whatever the corpus.
CELL_BITS = 18
#: Counts are told apart by so many steps for each doubling.
STEPS = 8
LONG_LIST = 1000
#: Elements of a drawing up to which its long lists are cut into lists of two.
WIDEST = 64
#: Tokens that a worker holds at once, but for a single longer drawing.
TOKENS = 200_000

#: For joined drawings (offsets, tokens, each token's rank, the rank of long lists): each list's drawing, in order, and its key.
Keys = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def required(n: np.ndarray, share: float) -> np.ndarray:
    """The least overlap of drawings of ``n`` commands with any near copy of their size or below."""
    return np.ceil(np.round(n * share, 9)).astype(np.int64)


def ranks(sets: DataFrame, long_list: int = LONG_LIST) -> tuple[np.ndarray, int]:
    """The rank of each cell by its count, and the rank from which a list is long. ``sets``: with a column ``tokens``."""
    cell = F.col("token").bitwiseAND(F.lit(2**CELL_BITS - 1))
    counted = sets.select(F.explode("tokens").alias("token")).groupBy(cell.cast("int").alias("cell")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(2**CELL_BITS, np.int64)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    limit = long_list + 2 * int(counts.mean())
    rank = lambda x: np.floor(STEPS * np.log2(np.maximum(x, 1))).astype(np.uint16)
    return rank(counts), int(rank(np.array([limit]))[0]) + 1


def extended(row: np.ndarray, element: np.ndarray, long_: np.ndarray, kept: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of elements given in order, drawing by drawing: those of elements that aren't long, and of long ones (of drawings that
    are ``kept`` in such) too, and those of long ones (of drawings that are ``cut``) with each later element of the drawing."""
    alone = ~long_ | kept
    rows, keys = [row[alone]], [element[alone]]
    first = np.flatnonzero(long_ & cut)
    if len(first):
        later = np.searchsorted(row, row[first], side="right") - first - 1
        one = np.repeat(first, later)
        other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later)
        rows.append(row[one])
        keys.append(mix(element[one] + mix(element[other])))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = in_order(row, key)
    return row[order], key[order]


def kept_and_cut(n: np.ndarray, share: float, elements: Callable[[np.ndarray], np.ndarray], widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Which drawings of ``n`` commands stay in long lists, and for which these are cut. ``elements``: how many a drawing is listed by at most,
    which grows with ``n``. Drawings that near copies may share only one element with are kept, too."""
    wide = elements(n) > widest
    may_be = elements(np.floor(np.round(n / share, 9)).astype(np.int64)) > widest
    return may_be | (required(n, share) < 2), ~wide


def _parts(lengths: np.ndarray) -> Iterator[slice]:
    begin, size = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if size and (size + n > TOKENS or k - begin >= ROWS):
            yield slice(begin, k)
            begin, size = k, 0
        size += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def keyed(sets: DataFrame, keep: list[str], keys: Keys, rank: np.ndarray, long_: int) -> DataFrame:
    """The columns ``keep`` of ``sets`` and ``keys``: the lists that a drawing is in. A drawing without any is left out."""
    kept = sets.select(*keep, "tokens")
    fields = [f"`{c}` {t}" for c, t in kept.select(*keep).dtypes]
    mask = np.uint64(2**CELL_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(keep))
            ends = held.offsets.to_numpy()
            tokens = held.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
            ends = ends - ends[0]
            for part in _parts(np.diff(ends)):
                some = tokens[ends[part.start] : ends[part.stop]]
                offsets = ends[part.start : part.stop + 1] - ends[part.start]
                row, key = keys(offsets, some, rank[(some & mask).astype(np.int64)], long_)
                many = np.bincount(row, minlength=part.stop - part.start)
                full = np.flatnonzero(many)
                take = pa.array(full + part.start)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keep))), lists(many[full], key.view(np.int64))], names=[*keep, "keys"])

    return kept.mapInArrow(run, ", ".join([*fields, "keys array<bigint>"]))
