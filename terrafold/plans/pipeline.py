"""Pipelines of named sources, and chains of column steps wired by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


class Pipeline:
    """Samples from several sources. Subclasses give the sources, and may change tiles and add context columns."""

    def sources(self) -> dict[str, DataFrame]:
        """Name -> tiles (by columns, ord, start, end and more)."""
        raise NotImplementedError

    def preprocess(self, samples: DataFrame) -> DataFrame:
        """Aligned samples with a struct column per source; rows whose column ``error`` is set are skipped."""
        return samples

    def context(self, samples: DataFrame) -> DataFrame:
        """Adds columns a model needs beside the tiles."""
        return samples

    def stream(self, by: list[str], *, render: Callable[[DataFrame], DataFrame] | None = None) -> Iterator[Row]:
        """Rendered samples one after the other, nothing written; partitions are worked out as they are asked for."""
        out = self.ingest(by)
        yield from (render(out) if render else out).toLocalIterator()

    def ingest(self, by: list[str]) -> DataFrame:
        from terrafold.operators.align import align_sources

        src = self.sources()
        if not src:
            raise ValueError("a pipeline needs at least one source")
        tiles = None
        for name, df in src.items():
            named = df.withColumn("source", F.lit(name))
            tiles = named if tiles is None else tiles.unionByName(named, allowMissingColumns=True)
        out = self.preprocess(align_sources(tiles, by, list(src)))
        if "error" in out.columns:
            out = out.where("error IS NULL").drop("error")
        return self.context(out)


@dataclass(frozen=True)
class SourceOptions:
    """How scenes of a collection become tiles. As many strides as slots if none are given."""

    collection: str
    bands: tuple[str, ...] | None = None
    max_nodata: float = 0.0
    resampling: str = "bilinear"
    group: str = "solar_day"
    dtype: str = "int16"
    frequency: str = "scene"
    reducer: str = "median"
    slots: int = 1
    strides: int | None = None
    fallback: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.max_nodata <= 1 or self.slots < 1 or (1 if self.strides is None else self.strides) < 1:
            raise ValueError("max_nodata lies in 0 to 1, slots and strides are at least 1")
        if self.group not in ("solar_day", "id", "time"):
            raise ValueError("group must be solar_day, id or time")

    def group_of(self, ts: Column, item: Column, lon: Column) -> Column:
        """What scenes of one step share: the day by the sun, the item itself, or the time."""
        from terrafold.operators.tiles import solar_day

        return {"solar_day": lambda: solar_day(ts, lon), "id": lambda: item, "time": lambda: ts}[self.group]()

    def steps(self, scenes: DataFrame, by: list[str]) -> DataFrame:
        """Steps of scenes (by, ts, item_id, value): reduced by bucket, empty ones filled if asked for, and cut into slots."""
        from terrafold.operators import temporal

        if self.fallback:
            s = temporal.fill_nearest(temporal.all_buckets(scenes, by, frequency=self.frequency), scenes, by)
        else:
            s = temporal.reduce_scenes(scenes, by, frequency=self.frequency, reducer=self.reducer)
        return temporal.slots(s, by, slots=self.slots, strides=self.strides)


class ScenePipeline(Pipeline):
    """One source as it comes: the scenes of a collection whose share of nodata is small enough, one step to a sample."""

    options = SourceOptions("sentinel-2-l1c", bands=("coastal", "blue", "green", "red", "rededge1", "rededge2", "rededge3", "nir", "nir08", "nir09", "cirrus", "swir16", "swir22"), max_nodata=0.1)

    def __init__(self, scenes: DataFrame, by: list[str]) -> None:
        """scenes: (by, collection, ts, null_share and what the tiles hold)."""
        self.scenes, self.by = scenes, by

    def sources(self) -> dict[str, DataFrame]:
        s = self.scenes.where((F.col("collection") == self.options.collection) & (F.col("null_share") <= self.options.max_nodata) & F.col("ts").isNotNull())
        tiles = s.withColumn("ord", F.row_number().over(Window.partitionBy(*self.by).orderBy("ts"))).withColumn("start", F.col("ts")).withColumn("end", F.col("ts"))
        return {self.options.collection: tiles.drop("ts", "collection")}


@dataclass(frozen=True)
class Step:
    """A function of columns: it takes those its parameters name and gives the named ones."""

    name: str
    takes: tuple[str, ...]
    gives: tuple[str, ...]
    run: Callable[..., Column | tuple[Column, ...]]


def step(*gives: str) -> Callable[[Callable], Step]:
    """Makes a function a step. It must have named parameters only, and must not give what it takes."""
    if not gives or not all(isinstance(g, str) and g.isidentifier() for g in gives):
        raise TypeError("a step must name the columns it gives")
    if len(set(gives)) != len(gives):
        raise TypeError("a step gives each column once")

    def make(f: Callable) -> Step:
        ps = inspect.signature(f).parameters.values()
        if any(p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD) for p in ps):
            raise TypeError(f"{f.__name__} must name its parameters")
        takes = tuple(p.name for p in ps)
        if set(takes) & set(gives):
            raise TypeError(f"{f.__name__} gives what it takes")
        return Step(f.__name__, takes, gives, f)

    return make


def plan_steps(steps: list[Step], have: set[str], want: set[str]) -> list[Step]:
    """The steps needed to get the wanted columns, each after those it builds on.

    A column that two steps give, one that none gives, and steps in a circle raise TypeError.
    """
    giver: dict[str, Step] = {}
    for s in steps:
        for g in s.gives:
            if g in giver:
                raise TypeError(f"{g} is given by {giver[g].name} and {s.name}")
            giver[g] = s
    order: list[Step] = []
    state: dict[str, int] = {}

    def visit(column: str, path: tuple[str, ...]) -> None:
        if column in have:
            return
        s = giver.get(column)
        if s is None:
            raise TypeError(f"nothing gives {column}")
        if state.get(s.name) == 2:
            return
        if state.get(s.name) == 1:
            raise TypeError(f"steps in a circle: {' > '.join((*path, s.name))}")
        state[s.name] = 1
        for t in s.takes:
            visit(t, (*path, s.name))
        state[s.name] = 2
        order.append(s)

    for w in sorted(want):
        visit(w, ())
    return order


def run_steps(df: DataFrame, steps: list[Step], want: set[str]) -> DataFrame:
    """The frame with the wanted columns added; steps that nothing needs don't run."""
    for s in plan_steps(steps, set(df.columns), want):
        out = s.run(*[F.col(t) for t in s.takes])
        out = out if isinstance(out, tuple) else (out,)
        if len(out) != len(s.gives):
            raise TypeError(f"{s.name} gives {len(out)} columns, not {len(s.gives)}")
        df = df.withColumns(dict(zip(s.gives, out)))
    return df


class Registry:
    """Functions by stage and name, without regard to case. A name is taken once in its stage."""

    def __init__(self) -> None:
        self._stages: dict[str, dict[str, Callable]] = {}

    def register(self, stage: str, name: str) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            taken = self._stages.setdefault(stage.lower(), {})
            if name.lower() in taken:
                raise ValueError(f"{stage} already has {name!r}")
            taken[name.lower()] = f
            return f

        return put

    def build(self, stage: str, name: str, **options):
        """Calls the function with the options it knows."""
        f = self._stages.get(stage.lower(), {}).get(name.lower())
        if f is None:
            raise ValueError(f"{stage} has no {name!r}; known: {', '.join(self.names(stage))}")
        known = inspect.signature(f).parameters
        return f(**{k: v for k, v in options.items() if k in known})

    def build_all(self, stages: dict[str, tuple[str, dict]]) -> dict[str, object]:
        """Builds the stages in the order given. A parameter called STAGE_ATTRIBUTE that isn't among the options takes that
        attribute of the stage built before; an attribute the stage doesn't have raises."""
        built: dict[str, object] = {}
        for stage, (name, options) in stages.items():
            f = self._stages.get(stage.lower(), {}).get(name.lower())
            wired = {}
            for p in inspect.signature(f).parameters if f else ():
                owner = max((s for s in built if p.startswith(s + "_")), key=len, default=None)
                if owner is None or p in options:
                    continue
                attribute = p[len(owner) + 1 :]
                if not hasattr(built[owner], attribute):
                    raise AttributeError(f"{stage} {name} asks for {attribute} of {owner}, which has none")
                wired[p] = getattr(built[owner], attribute)
            built[stage] = self.build(stage, name, **wired, **options)
        return built

    def names(self, stage: str) -> list[str]:
        return sorted(self._stages.get(stage.lower(), {}))
