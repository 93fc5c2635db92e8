"""Items over a size limit, cut into pieces at natural boundaries by content-defined chunking.

A rolling hash over the bytes marks landmarks. Each landmark snaps to the nearest natural boundary around it: the end
of a cell, else of a paragraph, else of a line. A piece ends at the first snapped landmark of the best kind between
its least and its greatest size, so where a cut lies depends on the bytes around it and an edit alters the pieces
next to it only. Each piece but the first repeats a stated amount of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.tokenizers import count_tokens, token_lengths

#: Kinds of boundaries, the best first.
KINDS = ("cell", "paragraph", "line", "landmark", "limit")

#: Bytes that stand for a token of a vocabulary where distances in bytes are set.
BYTES_PER_TOKEN = 4.0

_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_WINDOW = 32


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each byte; doubling the window takes one step, so five do."""
    h = _GEAR[data]
    width = 1
    with np.errstate(over="ignore"):
        while width < _WINDOW:
            add = h.copy()
            add[width:] += h[:-width] << np.uint32(width) if width < len(h) else np.uint32(0)
            h = add
            width *= 2
    return h


def char_starts(data: np.ndarray) -> np.ndarray:
    """Byte offset of each character, and the length at the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def natural_boundaries(data: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
    """Sorted byte offsets at which a piece may end: of cells, of paragraphs, of lines."""
    ends = np.flatnonzero(data == 10) + 1
    lines = ends[ends < len(data)]
    blank = lines[(lines >= 2) & (data[np.maximum(lines - 2, 0)] == 10)]
    return [np.unique(cells[(cells > 0) & (cells < len(data))]), blank, lines]


def _nearest(sorted_: np.ndarray, at: np.ndarray) -> np.ndarray:
    i = np.clip(np.searchsorted(sorted_, at), 1, max(1, len(sorted_) - 1))
    left, right = sorted_[i - 1], sorted_[np.minimum(i, len(sorted_) - 1)]
    return np.where(at - left <= right - at, left, right)


def cuts(data: np.ndarray, cells: np.ndarray, *, limit: int, overlap: int, sizes: np.ndarray | None = None, excess=None) -> list[tuple[int, int, str]]:
    """[(start, end, kind)] of the pieces without their overlaps; kind tells what the piece ends at, '' for the last.

    ``sizes``: tokens begun before each byte, with one more entry for the end; without it a token is a byte.
    ``excess(start, end)``: tokens by which a piece with its overlap is over the limit when it is encoded by itself; such a
    piece, and no other, is cut again with that much less room.
    """
    n = len(data)
    bytes_ = sizes is None
    sizes = np.arange(n + 1) if bytes_ else sizes
    if sizes[n] <= limit and (excess is None or excess(0, n) <= 0):
        return [(0, n, "")]
    most = limit - overlap
    # spacing of landmarks and the reach of the snap are in bytes, as the hash is, and don't depend on the text
    scale = 1.0 if bytes_ else BYTES_PER_TOKEN
    spacing = 1 << max(4, int(np.log2(max(16.0, limit * scale / 16))))
    marks = np.flatnonzero((rolling_hash(data) >> np.uint32(8)) % np.uint32(spacing) == 0) + 1
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    marks = marks[marks < n]
    marks = np.unique(heads[np.minimum(np.searchsorted(heads, marks), len(heads) - 1)])
    natural = natural_boundaries(data, cells)
    reach = limit * scale / 8
    left = marks
    snapped: list[np.ndarray] = []
    for b in natural:
        if not len(b) or not len(left):
            snapped.append(left[:0])
            continue
        to = _nearest(b, left)
        near = np.abs(to - left) <= reach
        snapped.append(np.unique(to[near]))
        left = left[~near]
    snapped.append(left)
    def end_of(start: int, room: int) -> tuple[int, str]:
        """Where the piece from ``start`` ends that has at most ``room`` tokens: at n, or at a boundary, the best kind first."""
        if sizes[n] - sizes[start] <= room:
            return n, ""
        low = int(np.searchsorted(sizes, sizes[start] + max(1, limit // 4, overlap)))
        high = int(np.searchsorted(sizes, sizes[start] + room, side="right")) - 1
        for name, found in zip(KINDS, snapped):
            i = int(np.searchsorted(found, low))
            if name != "landmark" and i < len(found) and found[i] <= high:
                return int(found[i]), name
        # no landmark with a boundary near it: any boundary is better than none
        for name, found in zip(KINDS, natural):
            i = int(np.searchsorted(found, high, side="right")) - 1
            if i >= 0 and found[i] >= low:
                return int(found[i]), name
        i = int(np.searchsorted(snapped[-1], low))
        if i < len(snapped[-1]) and snapped[-1][i] <= high:
            return int(snapped[-1][i]), "landmark"
        i = int(np.searchsorted(heads, high, side="right")) - 1
        if heads[i] <= start:  # not even one character has room; the next one is taken all the same
            return int(heads[i + 1]) if i + 1 < len(heads) else n, "limit"
        return int(heads[i]), "limit"

    out = []
    start = 0
    while start < n:
        room = limit if start == 0 else most
        end, kind = end_of(start, room)
        while excess is not None and (over := excess(start, end)) > 0 and room > 1:
            room = max(1, min(room, int(sizes[end] - sizes[start])) - over)
            end, kind = end_of(start, room)
        out.append((start, end, kind))
        start = end
    return out


def split_text(text: str, cell_ends: list[int], *, limit: int, overlap: int, tokenizer: str | None = None) -> list[tuple[int, int, int, str]]:
    """[(byte start, byte end, overlap bytes, kind)] of a text's pieces; start counts from the overlap's first byte.

    ``cell_ends`` are character offsets. A piece never has more than ``limit`` tokens, with a tokenizer when it is encoded
    by itself, as encodings may change at its borders. The limit must hold twice the overlap and 16 tokens, so that
    every character, of at most four bytes and as many tokens, has room.
    """
    if not 0 <= 2 * overlap <= limit - 16:
        raise ValueError("the limit must be at least 16 tokens more than twice the overlap")
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts = char_starts(data)
    ends = np.array([c for c in cell_ends if 0 < c < len(starts)], dtype=np.int64)
    cells = starts[ends] if len(ends) else ends
    # a cell that ends in front of its line break ends behind it
    cells = np.array([c + 1 if c < len(data) and data[c] == 10 else c for c in cells.tolist()], dtype=np.int64)
    sizes = None
    if tokenizer is not None:
        begun = np.zeros(len(data) + 1, np.int64)
        begun[np.concatenate([[0], np.cumsum(token_lengths(tokenizer, text))[:-1]]).astype(np.int64)] = 1
        sizes = np.concatenate([[0], np.cumsum(begun[:-1])])

    def back_of(start: int) -> int:
        if not start:
            return start
        back = start - overlap if sizes is None else int(np.searchsorted(sizes, sizes[start] - overlap))
        return min(start, int(starts[np.searchsorted(starts, max(back, 0))]))

    def excess(start: int, end: int) -> int:
        return count_tokens(tokenizer, raw[back_of(start) : end].decode("utf-8", "surrogatepass")) - limit

    found = cuts(data, cells, limit=limit, overlap=overlap, sizes=sizes, excess=None if sizes is None else excess)
    out = []
    for start, end, kind in found:
        back = back_of(start)
        # one character with an overlap that is longer by itself: the overlap gives way
        while sizes is not None and back < start and count_tokens(tokenizer, raw[back:end].decode("utf-8", "surrogatepass")) > limit:
            back = int(starts[np.searchsorted(starts, start - (start - back) // 2)]) if start - back > 8 else start
        out.append((back, end, start - back, kind))
    return out


_PIECES = "doc_id long, cell_no int, piece_no int, byte_start long, n_bytes int, n_overlap int, n_tokens int, ends_at string, text string"


def oversized_pieces(documents: DataFrame, *, limit: int = 8192, overlap: int = 256, tokenizer: str | None = None, with_text: bool = True) -> DataFrame:
    """Pieces of every item over the limit: whole texts (cell_no 0) and single cell bodies (their cell_no).

    (doc_id, cell_no, piece_no from 1, byte_start, n_bytes, n_overlap, n_tokens, ends_at, text). byte_start and n_bytes
    cover the piece with its overlap, so pieces without their first n_overlap bytes joined are the item. The limit holds
    for whole pieces; a token is one byte of UTF-8 if no tokenizer is given. The overlap is shortened to the next character
    where it would begin inside one. Items at or below the limit, null and empty texts have no pieces. Cells that are null
    or lie outside the text end where the text does. Texts of any length are cut whole; repeated ids are cut each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []

            def put(doc_id, cell_no, text, ends):
                raw = text.encode("utf-8", "surrogatepass")
                if tokenizer is None and len(raw) <= limit or tokenizer is not None and count_tokens(tokenizer, text) <= limit:
                    return
                for i, (a, b, o, kind) in enumerate(split_text(text, ends, limit=limit, overlap=overlap, tokenizer=tokenizer), 1):
                    part = raw[a:b].decode("utf-8", "surrogatepass") if with_text or tokenizer is not None else None
                    rows.append((doc_id, cell_no, i, a, b - a, o, b - a if tokenizer is None else count_tokens(tokenizer, part), kind, part if with_text else None))  # noqa: B023

            for doc_id, text, nos, froms, lens in zip(pdf["doc_id"], pdf["text"], pdf["nos"], pdf["froms"], pdf["lens"]):
                cells = [(int(c), int(f), int(f + n)) for c, f, n in zip(nos, froms, lens) if f >= 0 and n >= 0] if nos is not None else []
                put(doc_id, 0, text, [e for _, _, e in cells])
                for no, a, b in cells:
                    if b - a > limit // 4 or tokenizer is not None:  # a character has at most 4 bytes
                        put(doc_id, no, text[a:b], [])
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])

    cells = F.filter("cells", lambda c: c["cell_no"].isNotNull() & c["char_start"].isNotNull() & c["char_len"].isNotNull())
    # a token is at least one byte, so an item over the limit has more bytes than that, and so has its document
    big = documents.where(F.octet_length("text") > limit)
    each = lambda f: F.transform(cells, lambda c: c[f].cast("long"))
    return big.select(F.col("doc_id").cast("long").alias("doc_id"), "text", each("cell_no").alias("nos"), each("char_start").alias("froms"), each("char_len").alias("lens")).mapInPandas(run, _PIECES)


def oversized_items(documents: DataFrame, *, limit: int = 8192, overlap: int = 256) -> DataFrame:
    """(doc_id, cell_no) of the items that were cut: those with a first piece."""
    return oversized_pieces(documents, limit=limit, overlap=overlap, with_text=False).where("piece_no = 1").select("doc_id", "cell_no")
