"""Mini-batches for a training process outside of Spark, from files that Spark has prepared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions.physics import col
from ..operators.masks import all_finite
from ..operators.training import scaling
from .chunks import file_system


class Batches:
    """Features and targets of all finite rows, standardised, as arrays of float32.

    Spark writes them once, rows dealt to files by a hash, so that a file is a random part of the table. An epoch goes through
    the files in an order that its seed sets and mixes the rows of each read, so its memory is that of READ rows; every row
    comes once. scale=False leaves the values as they are. `features` and `targets` hold the scalings.
    """

    #: Rows that are read, and mixed, at once.
    READ = 1 << 16

    def __init__(self, df: DataFrame, features: list[str], targets: list[str], size: int = 512, rows_a_file: int = 1_000_000, scale: bool = True, path: str | None = None):
        spark, names = df.sparkSession, [*features, *targets]
        rows = df.where(all_finite(names)).select(*(col(c).alias(c) for c in names))
        self.size, self.path = size, path or shared.folder(spark, "batches")
        same = lambda columns: {c: (0.0, 1.0) for c in columns}
        self.features = scaling(rows, features) if scale else same(features)
        self.targets = scaling(rows, targets, population=True) if scale else same(targets)
        self.rows = rows.count()
        fixed = [((F.col(c) - m) / s).cast("float").alias(f"c{k}") for k, (c, (m, s)) in enumerate((self.features | self.targets).items())]
        dealt = rows.withColumn("_h", F.xxhash64(*names)).repartition(-(-self.rows // rows_a_file) or 1, "_h").sortWithinPartitions("_h")
        dealt.select(*fixed).write.mode("overwrite").parquet(self.path)
        fs, root = file_system(self.path)
        self.files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))

    def __len__(self) -> int:
        return self.rows

    def epoch(self, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(x, y) of mini-batches of `size` rows; the last may be smaller."""
        rng, (fs, _) = np.random.default_rng(seed), file_system(self.path)
        held = np.zeros((0, len(self.features) + len(self.targets)), np.float32)
        for f in rng.permutation(len(self.files)):
            for batch in pq.ParquetFile(self.files[f], filesystem=fs).iter_batches(self.READ):
                block = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
                held = np.concatenate([held, block[rng.permutation(len(block))]])
                whole = len(held) - len(held) % self.size
                for a in range(0, whole, self.size):
                    yield self._parted(held[a : a + self.size])
                held = held[whole:]
        if len(held):
            yield self._parted(held)

    def _parted(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, : len(self.features)], rows[:, len(self.features) :]
