"""The graph on disk: versioned Parquet snapshots behind a pointer, numbered migrations, and a backup manifest.

Commit N writes the tables that changed under ``v=N``, and then ``CURRENT.N``, which says for every table
what commit wrote it last; the pointer of the greatest number counts, so readers see the old state or
the new one, and a crash in between leaves the old.  Of two writers at once the later fails.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import search
from weft.operators.graph import TABLES, Graph, empty
from weft.sources import jsonl

#: version, description, how it is undone.
STEPS = ((1, "base tables", "drop all tables"), (2, "canonical names, session state, embeddings", "drop canonical_name, session_state, embeddings"))


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _current(self) -> tuple[int, dict[str, int]]:
        """The last commit, and by table the commit that wrote it."""
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return 0, {}
        found = [f.getPath().getName() for f in fs.listStatus(path(self.root))]
        last = max((int(n.split(".")[1]) for n in found if re.fullmatch(r"CURRENT\.\d+", n)), default=0)
        return (last, json.loads(self.spark.read.text(f"{self.root}/CURRENT.{last}", wholetext=True).first().value)) if last else (0, {})

    def version(self) -> int:
        """The current snapshot; 0 where there is none."""
        return self._current()[0]

    def table(self, name: str) -> DataFrame:
        v = self._current()[1].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/v={v}/{name}") if v else empty(self.spark, name)

    def graph(self) -> Graph:
        return Graph(self.table("entities"), self.table("relationships"), self.table("memory_ids"))

    def commit(self, **tables: DataFrame) -> int:
        """Writes the given tables, keeps pointing at the others, and moves the pointer; returns the new version."""
        v, at = self._current()
        for name, df in tables.items():
            df.select(*(F.col(f.name).cast(f.dataType) for f in empty(self.spark, name).schema)).write.mode("overwrite").parquet(f"{self.root}/v={v + 1}/{name}")
        fs, path = self._fs()
        new = f"{self.root}/.new-{uuid.uuid4().hex}"
        jsonl.write_text(self.spark, new, json.dumps(at | dict.fromkeys(tables, v + 1)))
        if fs.exists(path(f"{self.root}/CURRENT.{v + 1}")) or not fs.rename(path(new), path(f"{self.root}/CURRENT.{v + 1}")):
            raise RuntimeError(f"another writer made version {v + 1} of {self.root}")
        return v + 1

    def vacuum(self) -> None:
        """Deletes what the last commit doesn't point at: older pointers, and tables that were written again since."""
        last, at = self._current()
        fs, path = self._fs()
        for f in fs.listStatus(path(self.root)) if last else []:
            name = f.getPath().getName()
            if re.fullmatch(r"CURRENT\.\d+", name) and name != f"CURRENT.{last}" or name.startswith(".new-"):
                fs.delete(f.getPath(), False)
            elif name.startswith("v="):
                for t in fs.listStatus(f.getPath()):
                    if at.get(t.getPath().getName()) != int(name[2:]):
                        fs.delete(t.getPath(), True)

    def commit_graph(self, g: Graph) -> int:
        """The three tables, and the search index of the entities."""
        found = search.index(g.entities)
        corpus = self.spark.createDataFrame([(found.n, float(found.mean))], TABLES["corpus"])
        return self.commit(entities=g.entities, relationships=g.relationships, memory_ids=g.memory_ids, postings=found.postings, corpus=corpus)

    def index(self) -> search.Index | None:
        """The index that was written with the entities; None where there is none."""
        row = self.table("corpus").first()
        return None if row is None else search.Index(self.table("postings"), row.n, row.mean)

    def schema_version(self) -> int:
        return self.table("schema_meta").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def migrate(self, now: datetime) -> int:
        """Applies the steps above the current schema version; returns the version then."""
        have = self.schema_version()
        new = [(v, now, hashlib.sha256(text.encode()).hexdigest(), text, undo) for v, text, undo in STEPS if v > have]
        if new:
            self.commit(schema_meta=self.table("schema_meta").unionByName(self.spark.createDataFrame(new, TABLES["schema_meta"])))
        return max([have, *(r[0] for r in new)])

    def last_backup(self) -> datetime | None:
        return self.table("manifest").agg(F.max("created_at")).first()[0]

    def record_backup(self, row: dict) -> int:
        return self.commit(manifest=self.table("manifest").unionByName(self.spark.createDataFrame([tuple(row[f.name] for f in empty(self.spark, "manifest").schema)], TABLES["manifest"])))
