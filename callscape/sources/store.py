"""A store of the seven relations: a folder of Parquet tables, partitioned by project."""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.functions.cluster import cut_lineage, let_go
from callscape.schema import RELATIONS, Graph
from callscape.sources import ingest

FOLDER = ".callscape"


class NotSetUp(RuntimeError):
    """The store has no such table yet."""


def resolve(explicit: str | None = None) -> str:
    """The store's folder: the one given, else one in the working folder or at home that is there, else a new one here."""
    if explicit:
        return explicit
    for base in (Path.cwd(), Path.home()):
        if (base / FOLDER).is_dir():
            return str(base / FOLDER)
    return os.path.join(os.getcwd(), FOLDER)


class Store:
    """Tables under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def setup(self, dry_run: bool = False) -> dict[str, str]:
        """Make the tables that are missing: created, exists or would_create for each; nothing is ever dropped."""
        done = {}
        for name, r in RELATIONS.items():
            if self.exists(name):
                done[name] = "exists"
            elif dry_run:
                done[name] = "would_create"
            else:
                fs, p = self._fs(self.path(name))
                fs.mkdirs(p)
                self.spark.createDataFrame([], r.struct).drop("project").write.mode("append").parquet(self.path(name) + "/project=__none__")
                done[name] = "created"
        return done

    def table(self, name: str) -> DataFrame:
        if name not in RELATIONS:
            raise KeyError(f"no such relation: {name}")
        if not self.exists(name):
            raise NotSetUp(f"{self.folder} has no table {name}: run setup first")
        return self.spark.read.schema(RELATIONS[name].struct).parquet(self.path(name)).select(*RELATIONS[name].columns)

    def graph(self) -> Graph:
        return Graph(**{n: self.table(n) for n in RELATIONS})

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows over those of equal keys; of equal keys among the new rows the last one of the last file stays.

        rows may name their files in `_file`. The partitions of the projects that rows name are written anew, aside
        first, and put in place as the last step of the job; those of other projects are not touched.
        """
        r = RELATIONS[name]
        if "_file" not in rows.columns:
            rows = rows.withColumn("_file", F.lit(""))
        new = cut_lineage(rows.select(*r.columns, F.struct(F.lit(1).alias("new"), "_file", F.monotonically_increasing_id().alias("at")).alias("_order")))
        old = self.table(name).join(new.select("project").distinct(), "project", "left_semi")
        both = new.unionByName(old.withColumn("_order", F.struct(F.lit(0).alias("new"), F.lit("").alias("_file"), F.lit(0).cast("bigint").alias("at"))))
        values = F.struct(*[c for c in r.columns if c not in r.key])
        kept = cut_lineage(both.groupBy(*r.key).agg(F.max_by(values, "_order").alias("_v")).select(*r.key, "_v.*").select(*r.columns))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(self.path(name))
        let_go(new, kept)

    def clear(self, project: str) -> None:
        """All rows of a project, in all tables; the folder has the name that Spark gave it on writing."""
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project) if project else "__HIVE_DEFAULT_PARTITION__"
        for name in RELATIONS:
            fs, p = self._fs(f"{self.path(name)}/project={escaped}")
            if fs.exists(p):
                fs.delete(p, True)

    def import_graph(self, docs: DataFrame, project: str | Column, names: Sequence[str] = tuple(RELATIONS)) -> dict[str, int]:
        """The relations (or those named) of typed documents into a project (a name, or a column of docs); the number of rows of each as they came, before equal keys met."""
        docs, counts = cut_lineage(docs), {}
        for name, df in ingest.graph(docs, project).relations().items():
            if name not in names:
                continue
            counts[name] = df.count()
            if counts[name]:
                self.upsert(name, df)
        let_go(docs)
        return counts

    def import_json(self, files: str | Sequence[str], project: str = "default", clear: bool = False) -> dict[str, int]:
        """Files into a project, each parsed once; see import_graph()."""
        docs = ingest.read_graphs(self.spark, files)
        self.setup()
        if clear:
            self.clear(project)
        return self.import_graph(docs, project)
