"""Operator 3: best-fit packing of token pieces into sequences, improved by swap-based local search.

Texts become token ids and an end id; only a longer document is cut, with the short piece first.
Pieces, without their ids, are written to the shared folder and dealt by hash into blocks of a
bounded number of rows, so that no task grows with the input. In a block, best fit on falling
lengths gives the start; then all underfull bins move pieces and exchange one for one and two for one
with each other as long as the sum of squared fills grows, which fills the fuller bins and empties
others; and a bin is emptied by a chain of steps. The search ends when neither is left to do, or at Martello
and Toth's lower bound; nothing else ends it.

Null and empty texts are one end id. Repeated rows are packed as often as they occur, and are spread
over the blocks. Ties in length are taken in order of doc_id and piece, null last. A very long text is
cut into as many pieces as it takes; its ids are held by one task alone and only while it is cut. Columns
other than doc_id and text aren't read; pack() keeps those of its input. An empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import doc_texts, small_batches, stage, table
from emberline.llm.tokens import BytePairIds, columns, held

CAPACITY, END_ID = 1024, 2
BLOCK_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: as it is, or the short piece and then full ones."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids adds the ids themselves."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(BytePairIds, path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(*columns(batch, "doc_id", "text"), strict=True):
                ids = np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n]
                    rows.append((doc_id, k, s, n, zlib.crc32(part.tobytes()), part.astype("i4")) if with_ids else (doc_id, k, s, n, zlib.crc32(part.tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(5 + with_ids)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return doc_texts(docs).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices; lengths in falling order. Each piece goes where the least room is left."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = {}
    gaps = 0  # a bit for each gap that some bin has
    for i, n in enumerate(lengths):
        fits = gaps >> n << n
        if fits:
            gap = (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if gap > n:
            by_gap.setdefault(gap - n, []).append(b)
            gaps |= 1 << (gap - n)
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Martello and Toth's bound: for each threshold, pieces that leave less than it share a bin with none of the others."""
    x = np.sort(np.asarray(lengths, "i8"))[::-1]
    total = np.concatenate(([0], np.cumsum(x)))
    half = int((x > capacity // 2).sum())
    least = -(-int(total[-1]) // capacity)
    for k in np.unique(x[x <= capacity // 2]):
        alone, small = int((x > capacity - k).sum()), int((x >= k).sum())
        over = total[small] - total[half] - ((half - alone) * capacity - (total[half] - total[alone]))
        least = max(least, half + max(0, -(-int(over) // capacity)))
    return least


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Move a piece, or exchange one for one, two for one or one for two, among all underfull bins while the sum of squared
    fills grows; then empty a bin by a chain of such steps, which may each shrink the sum; until neither is
    left to do or there are as few bins as the lower bound says.

    A step takes d tokens more into a bin of fill f than it gives back to one of fill g; the sum of squares grows by
    2d(f - g + d). For each bin, fullest first, the step of most growth is taken."""
    fills = [sum(lengths[i] for i in b) for b in bins]
    full = [b for b, f in zip(bins, fills, strict=True) if f == capacity]
    held = [list(b) for b, f in zip(bins, fills, strict=True) if f < capacity]
    fill = np.array([f for f in fills if f < capacity], "i8")
    bound, live = lower_bound([lengths[i] for b in held for i in b], capacity), len(held)

    def parcels(k: int) -> list[tuple[int, int, int, int]]:
        """(size, bin, piece, second piece or -1) of what bin k can give."""
        b = held[k] if fill[k] < capacity else []
        return [(lengths[i], k, i, -1) for i in b] + [(lengths[i] + lengths[j], k, i, j) for n, i in enumerate(b) for j in b[n + 1 :]]

    offers = np.array([p for k in range(live) for p in parcels(k)], "i8").reshape(-1, 4)

    def best_step(k: int) -> tuple[int, tuple, np.ndarray] | None:
        size, where, single = offers[:, 0], offers[:, 1], offers[:, 3] < 0
        ahead, other, best = fill[k] - fill[where], where != k, (0, None, None)
        for give in [(0, k, -1, -1), *parcels(k)]:
            d = size - give[0]
            gain = np.where(other & (d > 0) & (d <= capacity - fill[k]) & (single if give[3] >= 0 else True), d * (ahead + d), 0)
            at = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[at] > best[0]:
                best = int(gain[at]), give, offers[at]
        return best if best[1] else None

    def exchange(k: int, other: int, give: list[int], take: list[int]) -> None:
        nonlocal offers, live
        for i in give:
            held[k].remove(i)
            held[other].append(i)
        for i in take:
            held[other].remove(i)
            held[k].append(i)
        d = sum(lengths[i] for i in take) - sum(lengths[i] for i in give)
        fill[k] += d
        fill[other] -= d
        live -= (not held[other]) + (not held[k])
        rest = offers[(offers[:, 1] != k) & (offers[:, 1] != other)]
        offers = np.concatenate((rest, np.array(parcels(k) + parcels(other), "i8").reshape(-1, 4)))

    def climbed() -> bool:
        """Take steps until a pass over the bins finds none."""
        any_step, stuck = False, set()
        for k in np.argsort(-fill, kind="stable").tolist():
            kind = tuple(sorted(lengths[i] for i in held[k]))  # bins of equal pieces have equal steps
            if not held[k] or fill[k] == capacity or kind in stuck or live <= bound:
                continue
            step = best_step(k)
            if step is None:
                stuck.add(kind)
                continue
            _, give, take = step
            exchange(k, int(take[1]), [i for i in give[2:] if i >= 0], [i for i in take[2:].tolist() if i >= 0])
            any_step, stuck = True, set()
        return any_step

    def emptied(k: int) -> bool:
        """Give away all of bin k, piece by piece: a move where it fits best, or an exchange for the smallest piece or
        pair that makes room. The sum of squares has grown when the bin is empty; if it can't be, nothing is done."""
        nonlocal held, fill, offers, live
        before = [list(b) for b in held], fill.copy(), offers, live
        while held[k]:
            size, where = offers[:, 0], offers[:, 1]
            room = capacity - fill
            open_room = np.where((room > 0) & (fill > 0) & (np.arange(len(fill)) != k), room, 0)
            best: tuple[int, int, list[int], list[int]] | None = None
            for _, _, i, j in sorted(parcels(k), reverse=True):
                if j < 0 and (fits := open_room >= lengths[i]).any():
                    best = 0, int(np.argmin(np.where(fits, open_room, capacity + 1))), [i], []
                    break
                give = [i, j] if j >= 0 else [i]
                total = sum(lengths[x] for x in give)
                ok = (where != k) & (size < total) & (total - size <= open_room[where]) & ((offers[:, 3] < 0) | (j < 0))
                if ok.any():
                    at = int(np.argmin(np.where(ok, size, capacity + 1)))
                    if best is None or total - size[at] > best[0]:
                        best = int(total - size[at]), int(where[at]), give, [x for x in offers[at, 2:].tolist() if x >= 0]
            if best is None:
                held, fill, offers, live = before
                return False
            exchange(k, *best[1:])
        return True

    while live > bound:
        if climbed():
            continue
        tried: set[tuple[int, ...]] = set()
        for k in np.argsort(fill, kind="stable").tolist():
            kind = tuple(sorted(lengths[i] for i in held[k]))
            if held[k] and fill[k] < capacity and kind not in tried:
                tried.add(kind)
                if emptied(k):
                    break
        else:
            break
    return full + [b for b in held if b]


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pieces and the sequence_id and offset of each. pieces: doc_id, piece, length and any others."""
    blocks = max(1, -(-pieces.count() // block_rows))
    names = pieces.columns

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = block["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.zeros(len(block), "i8"), np.zeros(len(block), "i8")
        base = int(block["_block"].iloc[0]) << 32
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
        block["sequence_id"], block["offset"] = sequence, offset
        return block[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    # the place of a row spreads equal rows, which any columns would put into one block
    salt = [F.col(f"`{c}`") for c in ("doc_id", "piece", "start", "length", "ids_crc32") if c in names] + [F.monotonically_increasing_id()]
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(*salt), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(stage(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
