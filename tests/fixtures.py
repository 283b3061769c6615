"""Small inputs whose answers are known."""

import numpy as np

from tessera.sources.frame import boxes, points

CITIES = [(0, -74.0, 40.7), (1, -0.1, 51.5), (2, 139.7, 35.7)]


def box_frame(spark, rows, node_size=16):
    rows = [(k, *map(float, r)) for k, r in enumerate(rows)]
    return boxes(spark.createDataFrame(rows, "id long, min_x double, min_y double, max_x double, max_y double"), node_size=node_size)


def point_frame(spark, rows, node_size=64):
    rows = [(k, *map(float, r)) for k, r in enumerate(rows)]
    return points(spark.createDataFrame(rows, "id long, x double, y double"), node_size=node_size)


def random_boxes(n, seed, side=10.0, span=1000.0):
    rng = np.random.default_rng(seed)
    low = rng.uniform(0, span, (n, 2))
    size = rng.exponential(side, (n, 2))
    return np.concatenate([low, low + size], 1).round(3)


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())
