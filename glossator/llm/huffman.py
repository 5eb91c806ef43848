"""Canonical length-limited Huffman coding of small whole numbers, in numpy.

Lengths come from package-merge, so none exceeds the limit and the total is the least possible under it. Codes are canonical:
by length, then by symbol. The stream is cut into blocks of ``BLOCK`` ids; a checkpoint holds each block's first bit. A block
is decoded by looking 16 bits up in a table, all blocks of a chunk side by side.
"""

from __future__ import annotations

import numpy as np

LIMIT, BLOCK = 16, 512
#: Ids that are encoded at once, whole blocks.
SEGMENT = BLOCK << 9


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """uint8 length by symbol, 0 where the count is 0; a lone symbol gets length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    # package-merge: levels from the longest code up; a package keeps only how many leaves lie below each cut
    levels = []  # per level: is the item at each place a leaf?
    previous = np.zeros(0, np.int64)
    for _ in range(limit):
        packages = previous[: len(previous) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < len(leaves))
        previous = both[at]
    take = 2 * len(leaves) - 2
    lengths = np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """uint32 code by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    n = lengths[order].astype(int)
    for size in np.unique(n):
        code <<= int(size) - last
        at = order[n == size]
        codes[at] = code + np.arange(len(at))
        code += len(at)
        last = int(size)
    return codes


def table_of(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length by the next ``limit`` bits."""
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    symbol, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    order = used[np.argsort(codes[used].astype(np.int64) << (limit - lengths[used].astype(np.int64)))]
    spans = np.left_shift(1, limit - lengths[order].astype(np.int64))
    n = int(spans.sum())
    symbol[:n], size[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbol, size


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream, most significant bit first, and the first bit of each block of BLOCK ids."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    total = int(np.bincount(ids, minlength=len(lengths)) @ lengths.astype(np.int64))
    out, checkpoints, base = np.zeros((total >> 4) + 2, np.uint16), [], 0
    for i in range(0, len(ids), SEGMENT):
        part = ids[i : i + SEGMENT]
        n = lengths[part].astype(np.int64)
        if not n.all():
            raise ValueError("an id without a code")
        ends = base + np.cumsum(n)
        at = ends - n
        word, room = at >> 4, 32 - (at & 15) - n
        both = codes[part].astype(np.uint64) << room.astype(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        high, low = np.add.reduceat(both >> np.uint64(16), cut), np.add.reduceat(both & np.uint64(0xFFFF), cut)
        out[word[cut]] |= high.astype(np.uint16)
        out[word[cut] + 1] |= low.astype(np.uint16)
        checkpoints.append(at[::BLOCK].astype(np.uint64))
        base = int(ends[-1])
    return out.astype(">u2").tobytes()[: (total + 7) // 8], np.concatenate(checkpoints)


def decode(stream: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a stream; its blocks advance together, an id each a step."""
    if not n:
        return np.zeros(0, np.uint32)
    symbol, size = table
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]  # 24 bits from each byte
    at = checkpoints.astype(np.int64)
    blocks = len(at)
    out = np.zeros((BLOCK, blocks), np.uint32)
    last = n - (blocks - 1) * BLOCK
    for k in range(BLOCK):
        if k == last:
            at = at[:-1]  # the last block is done
            if not len(at):
                break
        seen = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[k, : len(at)] = symbol[seen]
        at = at + size[seen]
    return out.T.reshape(-1)[:n] if blocks > 1 else out[:n, 0]
