"""A prompt store of loads that count once, clustered by id.

Every load has an id of its own and a folder of its own. It is visible from the moment its
line is in the ledger, which is written last and as a whole. A load that broke off before
that is written anew under the same folder and the same ids; one that is in the ledger is
not loaded again. Ids are dense over all loads, so a crash leaves neither gaps nor doubles.

Files are partitioned by block of ids, then by tier: the first rows, a range of ids or a
tier are read without listing or opening the files of the rest. One loader at a time.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptweave.operators.labeling import AUDIT_COUNTS, audit_steps
from promptweave.operators.row_ids import numbered
from promptweave.sources.prompt_table import summarise

BLOCK_ROWS = 1 << 20
LEDGER = "load string, first long, n long, block_rows long, " + ", ".join(f"{c} long" for c in AUDIT_COUNTS)
_DATA = "id long, user_prompt string, load string, id_block long, Target_Tier string"


class PromptStore:
    """Prompts under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, block_rows: int = BLOCK_ROWS):
        """Open a folder, new or not; ``block_rows`` is the number of ids per block of a new one."""
        self.spark = spark
        self.path = path.rstrip("/")
        known = self.loads().agg(F.max("block_rows")).first()[0]
        self.block_rows = known or block_rows

    def loads(self) -> DataFrame:
        """The ledger: one row per load, with its ids and, if it was audited, its audit's counts."""
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.path}/loads/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def _write(self, labeled: DataFrame, key: str | None, load: str, first: int) -> int:
        """Write a load's files in place of any that an earlier try left; returns the number of rows."""
        columns = dict.fromkeys([*([key] if key else []), "user_prompt", "Target_Tier"])
        with_ids, n = numbered(labeled.select(*columns), key, "__id", first)
        block = F.floor(F.col("__id") / self.block_rows).alias("id_block")
        (
            with_ids.select(F.col("__id").alias("id"), "user_prompt", block, "Target_Tier")
            .repartitionByRange("id")
            .sortWithinPartitions("id_block", "Target_Tier", "id")
            .write.mode("overwrite")
            .partitionBy("id_block", "Target_Tier")
            .parquet(f"{self.path}/data/load={load}")
        )
        return n

    def load(
        self,
        labeled: DataFrame,
        key: str | None,
        load: str,
        audit: dict[str, int] | None = None,
    ) -> int:
        """Store ``(user_prompt, Target_Tier)`` in the order of ``key`` once; returns the load's number of rows.

        The number is known from giving ids, without reading the rows again. ``audit`` are the counts of the labelling that
        feeds the load; they go into the ledger.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", load):
            raise ValueError(f"load {load!r} is no plain name")
        ledger = {r["load"]: r for r in self.loads().collect()}
        if load in ledger:
            return ledger[load]["n"]
        first = max((r["first"] + r["n"] for r in ledger.values()), default=0)
        n = self._write(labeled, key, load, first)
        row = (load, first, n, self.block_rows, *[(audit or {}).get(c) for c in AUDIT_COUNTS])
        self.spark.createDataFrame([row], LEDGER).coalesce(1).write.parquet(f"{self.path}/loads/{load}")
        return n

    def prompts(self, tier: str | None = None, first: int = 0, last: int | None = None) -> DataFrame:
        """``(id, user_prompt, Target_Tier)`` of committed loads, of one tier or a range of ids if given."""
        ledger = [r for r in self.loads().collect() if r["n"] and r["first"] + r["n"] > first]
        ledger = [r for r in ledger if last is None or r["first"] <= last]
        if not ledger:
            return self.spark.createDataFrame([], "id long, user_prompt string, Target_Tier string")
        paths = [f"{self.path}/data/load={r['load']}" for r in ledger]
        rows = self.spark.read.schema(_DATA).option("basePath", f"{self.path}/data").parquet(*paths)
        if first:
            rows = rows.where((F.col("id_block") >= first // self.block_rows) & (F.col("id") >= first))
        if last is not None:
            rows = rows.where((F.col("id_block") <= last // self.block_rows) & (F.col("id") <= last))
        if tier is not None:
            rows = rows.where(F.col("Target_Tier") == F.lit(tier))
        return rows.select("id", "user_prompt", "Target_Tier")

    def head(self, n: int, tier: str | None = None) -> DataFrame:
        """The first ``n`` rows that have a prompt, by id; reads only the blocks it takes to find them."""
        total = self.loads().agg(F.sum("n")).first()[0] or 0
        last = max(n, 1) - 1
        while True:
            rows = self.prompts(tier, 0, last).where(F.col("user_prompt").isNotNull())
            if last + 1 >= total or rows.count() >= n:
                return rows.orderBy("id").limit(n)
            last = min(total, 4 * (last + self.block_rows)) - 1

    def summary(self) -> DataFrame:
        """Prompts and percent per tier, largest first."""
        return summarise(self.prompts().where(F.col("user_prompt").isNotNull()))

    def audit(self) -> DataFrame:
        """The drop audit summed over all audited loads."""
        return audit_steps(self.loads().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in AUDIT_COUNTS]))
