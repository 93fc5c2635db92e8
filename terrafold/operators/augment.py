"""Augmentations of square tiles and their boxes: the same moves for pixels and labels, chosen by the sample's hash.

A move is one of MOVES; a step is a move, a pair (move, share of the samples it is applied to), or a list of steps, nested
as one likes. Which samples a step moves depends on the key, the seed and the step's place only, so pixels and boxes of a
sample are moved alike wherever they are worked out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOVES = ("hflip", "vflip", "rot90", "rot180", "rot270", "transpose")

Step = str | tuple[str, float] | list


def flat(steps: list[Step]) -> list[tuple[str, float]]:
    """The moves of nested steps in order, each with its share."""
    out: list[tuple[str, float]] = []
    for s in steps:
        if isinstance(s, list):
            out.extend(flat(s))
            continue
        move, share = (s, 1.0) if isinstance(s, str) else s
        if move not in MOVES:
            raise ValueError(f"unknown move {move!r}; one of {', '.join(MOVES)}")
        if not 0.0 <= share <= 1.0:
            raise ValueError(f"share {share} of {move}")
        out.append((move, float(share)))
    return out


def _applies(key: Column, seed: int, at: int, share: float) -> Column:
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(at)), 11).cast("double") / float(1 << 53)
    return u < share


def _moved(move: str, y: Column, x: Column, top: Column) -> tuple[Column, Column]:
    """Where a place (y, x) goes; ``top`` is its largest coordinate."""
    return {"hflip": (y, top - x), "vflip": (top - y, x), "rot90": (top - x, y), "rot180": (top - y, top - x), "rot270": (x, top - y), "transpose": (x, y)}[move]


def move_pixels(y: Column, x: Column, key: Column, steps: list[Step], *, size: int, seed: int = 7) -> tuple[Column, Column]:
    """(y, x) of a pixel of a tile of ``size`` by ``size`` after the steps; rot90 turns against the clock."""
    top = F.lit(size - 1)
    at = F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"))
    for i, (move, share) in enumerate(flat(steps)):
        at = _step(at, lambda p: _moved(move, p["y"], p["x"], top), ("y", "x"), _applies(key, seed, i, share))  # noqa: B023
    return at["y"], at["x"]


def move_boxes(cx: Column, cy: Column, w: Column, h: Column, key: Column, steps: list[Step], *, seed: int = 7) -> tuple[Column, Column, Column, Column]:
    """(cx, cy, w, h) of a box in shares of the tile after the same steps."""
    at = F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))
    one = F.lit(1.0)

    def turned(move: str, p: Column) -> tuple[Column, ...]:
        y, x = _moved(move, p["cy"], p["cx"], one)
        sides = (p["h"], p["w"]) if move in ("rot90", "rot270", "transpose") else (p["w"], p["h"])
        return (x, y, *sides)

    for i, (move, share) in enumerate(flat(steps)):
        at = _step(at, lambda p: turned(move, p), ("cx", "cy", "w", "h"), _applies(key, seed, i, share))  # noqa: B023
    return at["cx"], at["cy"], at["w"], at["h"]


def _step(at: Column, move, names: tuple[str, ...], applies: Column) -> Column:
    """The struct moved where the step applies; bound once, so a chain of steps grows by one link each."""
    return F.get(F.transform(F.array(at), lambda p: F.when(applies, F.struct(*[c.alias(n) for c, n in zip(move(p), names)])).otherwise(p)), F.lit(0))
