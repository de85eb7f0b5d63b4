"""Problem 5: splitting oversized token rows at natural boundaries, by dynamic programming over boundary positions.

Only rows over the limit leave the JVM; each is an independent unit of work. Cut penalties grade the boundaries (turn,
paragraph or line, sentence, word, character, none); the programme minimises cut penalties plus squared size imbalance over
all sequences of cuts whose pieces, overlap included, stay within the limit.

The programme runs first over the better boundaries alone. Whoever cuts at a worse kind pays that kind's penalty at least;
so if the best of the better ones costs no more, it is the best of all, and else the next kind joins in. The outcome is that
of the programme over all positions.

Of repeated deliveries the latest counts. Pieces, not tokens, are shuffled to find it: every delivery goes to its key with
its time and length, those over the limit with their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cut penalties by kind of boundary.
KINDS = ("role", "line", "sentence", "word", "character", "none")
PENALTY = np.array([0.0, 0.15, 0.3, 1.0, 6.0, 60.0])
#: Weight of the squared relative size imbalance.
BALANCE = 2.0
#: The first programme takes the kinds up to sentence, the second those up to word, the third up to character.
STAGES = (2, 3, 4, 5)
BYTE = 3


def boundary_kinds(tokens: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """The kind of each position 1..n-1 as a cut between tokens i-1 and i; index 0 is unused."""
    n = len(tokens)
    kind = np.full(n, 4, np.int8)
    if n < 2:
        return kind
    byte = tokens - BYTE
    here, before = byte[1:], byte[:-1]
    k = np.full(n - 1, 4, np.int8)
    k[(here & 0xC0) == 0x80] = 5
    blank = (before == 32) | (before == 9) | (before == 10) | (before == 13)
    inner = ~((here == 32) | (here == 9) | (here == 10) | (here == 13))
    k[blank & inner] = 3
    end = np.isin(byte, (46, 33, 63))
    # U+0964 is E0 A5 A4; U+3002 is E3 80 82
    end[2:] |= ((byte[:-2] == 0xE0) & (byte[1:-1] == 0xA5) & (byte[2:] == 0xA4)) | ((byte[:-2] == 0xE3) & (byte[1:-1] == 0x80) & (byte[2:] == 0x82))
    after = np.zeros(n - 1, bool)
    after[1:] = end[:-2]
    k[blank & inner & after] = 2
    k[before == 10] = 1
    k[roles[1:] != roles[:-1]] = 0
    kind[1:] = k
    return kind


def _programme(at: np.ndarray, penalty: np.ndarray, n: int, limit: int, overlap: int, ideal: float) -> tuple[float, list[int]]:
    """Least cost and its cuts among the positions `at`; infinite if none keeps the pieces within the limit."""
    room = limit - overlap
    cuts = np.concatenate(([0], at, [n]))
    cost = np.concatenate(([0.0], penalty, [0.0]))
    # Imbalance by the distance of two cuts; the first piece has no overlap before it.
    imbalance = BALANCE * ((np.arange(room + 1) + overlap) / ideal - 1.0) ** 2
    best, back = np.full(len(cuts), np.inf), np.zeros(len(cuts), np.int64)
    best[0] = 0.0
    lows = np.searchsorted(cuts, cuts - room)
    place, first = cuts.tolist(), (BALANCE * (cuts / ideal - 1.0) ** 2).tolist()
    for i in range(1, len(cuts)):
        low, c = max(1, int(lows[i])), place[i]
        if c <= limit:
            best[i], back[i] = first[i], 0
        if low < i:
            total = best[low:i] + imbalance[c - cuts[low:i]]
            j = int(total.argmin())
            if total[j] < best[i]:
                best[i], back[i] = total[j], low + j
        best[i] += cost[i]
    if not np.isfinite(best[-1]):
        return np.inf, []
    out, i = [], len(cuts) - 1
    while i := int(back[i]):
        out.append(place[i])
    return float(best[-1]), out[::-1]


def cut_positions(kind: np.ndarray, n: int, limit: int, overlap: int, stages: tuple[int, ...] = STAGES) -> list[int]:
    """The cuts c1 < c2 < ... of least cost; piece i is [c_i - overlap, c_{i+1}), the first starts at 0."""
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    ideal = (n + (pieces - 1) * overlap) / pieces
    for worst in stages:
        at = np.flatnonzero(kind[1:] <= worst) + 1
        total, cuts = _programme(at, PENALTY[kind[at]], n, limit, overlap, ideal)
        # A cut of a kind left out costs its penalty alone, and nothing costs less than 0.
        if worst == len(PENALTY) - 1 or total <= PENALTY[worst + 1]:
            return cuts
    raise ValueError("the last stage takes every position")


def split_row(tokens: np.ndarray, roles: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the cut at the end) of one row of non-pad tokens. The last piece's kind is 'end'."""
    n, limit = len(tokens), max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    if n <= limit:
        return [(0, n, "end")]
    kind = boundary_kinds(tokens, roles)
    cuts = cut_positions(kind, n, limit, overlap)
    starts = [0] + [max(0, c - overlap) for c in cuts]
    return [(s, e, KINDS[kind[e]] if e < n else "end") for s, e in zip(starts, [*cuts, n])]


def _codes(roles: pa.Array) -> tuple[np.ndarray, int]:
    """Roles as small numbers, and the number of role pad (-1 if absent)."""
    d = roles.dictionary_encode()
    names = d.dictionary.to_pylist()
    return d.indices.fill_null(len(names)).to_numpy(zero_copy_only=False), names.index("pad") if "pad" in names else -1


_PIECE = pa.struct([("token_start", pa.int32()), ("token_end", pa.int32()), ("cut_kind", pa.string())])
_KEPT = ("shard_id", "row_id", "_keyless", "written_at", "_n", "lane", "_content")


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, roles = batch.column("tokens"), batch.column("roles")
        limit, overlap = batch.column("piece_limit").to_pylist(), batch.column("piece_overlap").to_pylist()
        pieces = []
        for i in range(batch.num_rows):
            t = tokens[i].values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if roles[i].is_valid and len(roles[i].values) == len(t):
                r, pad = _codes(roles[i].values)
                if pad >= 0:
                    t, r = t[r != pad], r[r != pad]
            else:
                r = np.zeros(len(t), np.int64)
            pieces.append([{"token_start": a, "token_end": b, "cut_kind": k} for a, b, k in split_row(t, r, limit[i], overlap[i] or 0)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(pieces, pa.list_(_PIECE))], names=[*_KEPT, "_pieces"])


def non_pad_count() -> F.Column:
    """Tokens of a row, those with role pad not counted; 0 for a null array. Without roles every token counts."""
    pads = F.coalesce(F.size("roles") - F.size(F.array_remove("roles", "pad")), F.lit(0))
    return F.coalesce(F.size("tokens"), F.lit(0)) - F.when(F.col("roles").isNull() | F.col("tokens").isNull(), F.lit(0)).otherwise(pads)


def split_oversized(shard_rows: DataFrame, lane_config: DataFrame) -> DataFrame:
    """Pieces of every row with more non-pad tokens than its lane's piece_limit; offsets count non-pad tokens.

    Rows delivered twice (same shard_id and row_id) count as the one written last, then the longer, then the larger lane,
    then by content: if that one is within its limit, the row has no pieces. Null token arrays have no tokens; null roles mean
    one role throughout; null tokens in an array count as pad bytes without natural boundary. Lanes without configuration or
    with a null limit have no limit. piece_overlap is taken as 0 if null and is held below the limit. Rows without a shard_id
    or row_id are told apart by their content. Empty tables give no rows. lane_config has one row per lane and is broadcast
    (of repeated lanes, the smallest limit and overlap hold).
    """
    config = lane_config.where(F.col("lane").isNotNull()).groupBy("lane").agg(F.min("piece_limit").alias("piece_limit"), F.min("piece_overlap").alias("piece_overlap"))
    keyless = F.when(F.col("shard_id").isNull() | F.col("row_id").isNull(), F.xxhash64("tokens", "lane"))
    rows = shard_rows.select("shard_id", "row_id", "lane", "tokens", "roles", "written_at", non_pad_count().alias("_n")).join(F.broadcast(config), "lane", "left")
    over = F.coalesce(F.col("_n") > F.col("piece_limit"), F.lit(False))
    pieces = "array<struct<token_start:int,token_end:int,cut_kind:string>>"
    key = ["shard_id", "row_id", keyless.alias("_keyless"), "written_at", "_n", "lane"]
    short = rows.where(~over).select(*key, F.lit(None).cast("long").alias("_content"), F.lit(None).cast(pieces).alias("_pieces"))
    long = rows.where(over).select(*key, F.xxhash64("tokens", "roles").alias("_content"), "tokens", "roles", "piece_limit", "piece_overlap")
    cut = long.mapInArrow(_map, f"shard_id string, row_id int, _keyless long, written_at timestamp, _n int, lane string, _content long, _pieces {pieces}")
    latest = short.unionByName(cut).groupBy("shard_id", "row_id", "_keyless").agg(F.max(F.struct("written_at", "_n", "lane", "_content", "_pieces")).alias("r"))
    out = latest.where("r._pieces is not null").select("shard_id", "row_id", "r.lane", F.col("r._n").alias("n_tokens"), F.size("r._pieces").alias("pieces"), F.posexplode("r._pieces").alias("piece", "p"))
    return out.select("shard_id", "row_id", "lane", "n_tokens", "piece", "pieces", "p.token_start", "p.token_end", "p.cut_kind")
