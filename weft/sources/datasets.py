"""Points with known shapes, a simulated car, and edge lists from files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.graph import Graph


def _uniform(seed: int, *key) -> Column:
    """A number in (0, 1) that depends on its key only: the same again after a lost task."""
    return (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, *key) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed * 2 + 1, *key))) * F.cos(2 * math.pi * _uniform(seed * 2 + 2, *key))


def swiss_roll(spark: SparkSession, radians: float, num_points: int, *, radius: float = 1.0, theta_noise: float = 0.1, radius_noise: float = 0.01, seed: int = 0) -> DataFrame:
    """``id, x, theta``: points of a rolled-up sheet: angles evenly from 1 to ``radians``, radii by the root, both with noise; the
    middle coordinate at random from -1 to 1."""
    share = F.col("id") / max(num_points - 1, 1)
    theta = 1 + (radians - 1) * share + theta_noise * _normal(seed, F.col("id"), F.lit(0))
    r = radius * F.sqrt(share) + radius_noise * _normal(seed, F.col("id"), F.lit(1))
    own = spark.range(num_points).select("id", theta.alias("theta"), r.alias("r"))
    y = 2 * _uniform(seed, F.col("id"), F.lit(2)) - 1
    return own.select("id", F.array(F.col("r") * F.sin("theta"), y, F.col("r") * F.cos("theta")).alias("x"), "theta")


def error_ratio(graph: Graph, truth: DataFrame, *, max_delta_theta: float = 0.1) -> DataFrame:
    """One row ``errors, edges, ratio``: edges whose ends differ by more than the bound in the first coordinate of ``truth`` (``id, x``)."""
    first = lambda end: truth.select(F.col("id").alias(end), F.col("x")[0].cast("double").alias(f"t_{end}"))
    own = graph.edges.join(first("src"), "src").join(first("dst"), "dst")
    bad = F.count_if(F.abs(F.col("t_src") - F.col("t_dst")) > max_delta_theta)
    return own.agg(bad.alias("errors"), F.count("*").alias("edges"), F.coalesce(F.try_divide(bad, F.count("*")), F.lit(0.0)).alias("ratio"))


class ParameterizedShape:
    """A shape given by parameters: name -> (low, high, whether it grows along the shape). ``evaluate`` gives the coordinates as columns."""

    def __init__(self, **parameters: tuple[float, float, bool]):
        for name, (low, high, grows) in parameters.items():
            if low > high:
                raise ValueError(f"{name}: {low} is beyond {high}")
            if not isinstance(grows, bool):
                raise ValueError(f"{name}: whether it grows is true or false")
        self.parameters = parameters

    def evaluate(self, **values: Column) -> list[Column]:
        raise NotImplementedError

    def point_cloud(self, spark: SparkSession, num_points: int, *, seed: int = 0) -> DataFrame:
        """``id, x``: growing parameters evenly from end to end, others at random."""
        values = {}
        for k, (name, (low, high, grows)) in enumerate(self.parameters.items()):
            share = F.col("id") / max(num_points - 1, 1) if grows else _uniform(seed, F.col("id"), F.lit(k))
            values[name] = low + (high - low) * share
        own = spark.range(num_points).withColumn("half", F.col("id") < num_points // 2)
        return own.select("id", F.array(*self.evaluate(**values)).alias("x"))

    def trajectories(self, spark: SparkSession, num_traj: int, points_per_traj: int, *, seed: int = 0) -> DataFrame:
        """``traj_id, step, x``: parameters move by random steps, growing ones forward."""
        own = spark.range(num_traj * points_per_traj).select(F.floor(F.col("id") / points_per_traj).alias("traj_id"), (F.col("id") % points_per_traj).cast("int").alias("step"))
        so_far = Window.partitionBy("traj_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for k, (name, (low, high, grows)) in enumerate(self.parameters.items()):
            step = (high - low) / points_per_traj
            move = _normal(seed, F.col("traj_id"), F.col("step"), F.lit(k))
            own = own.withColumn(name, F.sum(step + step / 3 * move if grows else step * move).over(so_far))
        own = own.withColumn("half", F.col("step") < points_per_traj // 2)
        return own.select("traj_id", "step", F.array(*self.evaluate(**{n: F.col(n) for n in self.parameters})).alias("x"))


class MobiusStrip(ParameterizedShape):
    def __init__(self, radius: float = 1.0, max_width: float = 1.0):
        super().__init__(theta=(0, 2 * math.pi, True), width=(-max_width / 2, max_width / 2, False))
        self.radius = radius

    def evaluate(self, theta: Column, width: Column) -> list[Column]:
        out = self.radius + width * F.cos(theta / 2)
        return [out * F.cos(theta), out * F.sin(theta), width * F.sin(theta / 2)]


class FigureEight(ParameterizedShape):
    def __init__(self, radius: float = 1.0, dimension: int = 2):
        if dimension not in (2, 3):
            raise ValueError("a figure of eight has two or three dimensions")
        super().__init__(theta=(0, 2 * math.pi, True), width=(0, 1, False))
        self.radius, self.dimension = radius, dimension

    def evaluate(self, theta: Column, width: Column) -> list[Column]:
        x = self.radius * F.sin(theta)
        return [x, x * F.cos(theta), width][: self.dimension]


class SCurve(ParameterizedShape):
    def __init__(self, radius: float = 1.0):
        super().__init__(theta=(-math.pi - 1, math.pi + 1, True), width=(-1, 1, False))

    def evaluate(self, theta: Column, width: Column) -> list[Column]:
        return [F.sin(theta), width, F.when(F.col("half"), 2 - F.cos(theta)).otherwise(F.cos(theta))]


# The car's world.
POSITION, VELOCITY, GOAL, PUSH, GRAVITY = (-1.2, 0.5), (-0.07, 0.07), 0.5, 0.001, -0.0025
TRACE = "traj_id long, step int, state array<float>, action int, reward double, next_state array<float>, next_action int"


def _drive(state: tuple[float, float], action: int) -> tuple[float, float]:
    speed = min(VELOCITY[1], max(VELOCITY[0], state[1] + PUSH * (1, 0, -1)[action] + GRAVITY * math.cos(3 * state[0])))
    place = state[0] + speed
    return (place, speed) if POSITION[0] <= place <= POSITION[1] else (min(max(place, POSITION[0]), POSITION[1]), 0.0)


def mountain_car_traces(spark: SparkSession, num_traj: int, *, max_steps: int = 40, seed: int = 0) -> DataFrame:
    """Episodes of a car in a valley under random linear policies, see ``TRACE``; states by the world's extent. Each episode
    depends on its number and the seed only."""

    def worker(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("traj_id", pa.int64()), ("step", pa.int32()), ("state", pa.list_(pa.float32())), ("action", pa.int32()), ("reward", pa.float64()), ("next_state", pa.list_(pa.float32())), ("next_action", pa.int32())])
        size = (POSITION[1] - POSITION[0], VELOCITY[1] - VELOCITY[0])
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, t])
                slope, bias = rng.normal(0, 0.01), rng.normal(0, 0.005)
                policy = lambda s: 0 if s[0] * slope + s[1] + bias > 0 else 2  # noqa: B023, E731
                state = (rng.uniform(*POSITION), rng.uniform(*VELOCITY))
                action = policy(state)
                for step in range(max_steps):
                    if state[0] >= GOAL:
                        break
                    new = _drive(state, action)
                    then = policy(new)
                    scaled = lambda s: [s[0] / size[0], s[1] / size[1]]
                    rows.append({"traj_id": t, "step": step, "state": scaled(state), "action": action, "reward": -1.0, "next_state": scaled(new), "next_action": then})
                    state, action = new, then
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.range(num_traj).mapInArrow(worker, TRACE)


def mountain_car_trajectories(traces: DataFrame) -> DataFrame:
    """``traj_id, step, x`` of traces, without a final state that ends an episode."""
    last = Window.partitionBy("traj_id").orderBy(F.desc("step"))
    own = traces.withColumn("_r", F.row_number().over(last)).where(~((F.col("_r") == 1) & (F.col("reward") == 0)))
    return own.select("traj_id", "step", F.col("state").cast("array<double>").alias("x"))


def basis_contours(coords: DataFrame, traces: DataFrame, column: int) -> DataFrame:
    """``position, velocity, value``: what a contour plot of one embedding coordinate over the car's states needs."""
    states = traces.select("traj_id", "step", "state")
    from weft.operators.manifold import stacked_points

    own = stacked_points(states.withColumn("x", F.col("state")))
    return own.join(coords, "id").select(F.col("x")[0].alias("position"), F.col("x")[1].alias("velocity"), F.col("coords")[column].alias("value"))


# -- files ---------------------------------------------------------------------------------------------------------------------


def read_edges(spark: SparkSession, path: str, *, src: str = "src", dst: str = "dst", weight: str | None = None, format: str = "parquet", **options) -> Graph:
    """A graph from a table of edges; only the named columns are read, and repeated weighted edges add up."""
    own = spark.read.format(format).options(**options).load(path).select(F.col(src).alias("src"), F.col(dst).alias("dst"), *([F.col(weight).alias("weight")] if weight else []))
    if weight:
        own = own.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    ids = own.select(F.col("src").alias("id")).union(own.select("dst")).distinct()
    return Graph.from_edge_pairs(own, vertices=ids, weights="weight" if weight else None)


def read_points(spark: SparkSession, path: str, *, id_col: str = "id", x_col: str = "x", format: str = "parquet", **options) -> DataFrame:
    """``id, x`` from a table of points."""
    return spark.read.format(format).options(**options).load(path).select(F.col(id_col).cast("long").alias("id"), F.col(x_col).cast("array<double>").alias("x"))


def write_edges(graph: Graph, path: str, *, format: str = "parquet", mode: str = "error") -> None:
    graph.edges.write.format(format).mode(mode).save(path)
