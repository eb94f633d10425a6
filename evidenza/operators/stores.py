"""Several keyed tables that change together: buckets of rows, and one commit record that names the versions of all.

Rows lie in buckets by a hash of their bucket columns. A change reads and writes only the buckets that its rows fall in;
a commit is one small file, created only if no other writer has made the commit of that number, that names the folder of
every bucket of every table. Readers take the last commit, so a writer that dies before its commit leaves the old state,
and two tables never show states of different commits. The file system's rename must not
replace a file, as that of HDFS does not. Folders that no kept commit names are removed by `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import one_each, upsert

#: A commit names at most this many folders a table, whatever the table's size.
BUCKETS = 256


class Conflict(RuntimeError):
    """Another writer made the commit first: read again and repeat the change."""


@dataclass
class Table:
    """The schema, the key, and the columns that decide the bucket (the key, if none are given)."""

    schema: str
    key: list[str]
    bucketed: list[str] = field(default_factory=list)


class Stores:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], buckets: int = BUCKETS):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        system, path = self._file("commits")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in system.listStatus(path) if f.getPath().getName().endswith(".json")) if system.exists(path) else []

    def state(self, number: int | None = None) -> dict:
        """The commit of a number, or the last one; before the first, number 0 without buckets."""
        numbers = self._numbers()
        if number is None and not numbers:
            return {"number": 0, "tables": {}, "batches": {}, "buckets": self.buckets}
        number = numbers[-1] if number is None else number
        found = json.loads(self.spark.read.text(f"{self.path}/commits/{number:020d}.json", wholetext=True).first()[0])
        if found["buckets"] != self.buckets:
            raise ValueError(f"the tables have {found['buckets']} buckets, not {self.buckets}")
        return found

    def _commit(self, base: dict, tables: dict, batches: dict | None = None) -> int:
        number = base["number"] + 1
        entry = {"number": number, "tables": base["tables"] | tables, "batches": base["batches"] | (batches or {}), "buckets": self.buckets}
        # Written whole under a name of its own and then renamed, which fails if the commit is there already.
        system, made = self._file(f"commits/{uuid.uuid4().hex}.tmp")
        out = system.create(made, False)
        out.write(json.dumps(entry).encode())
        out.close()
        _, final = self._file(f"commits/{number:020d}.json")
        if system.exists(final) or not system.rename(made, final):
            system.delete(made, False)
            raise Conflict(f"commit {number} is there already")
        return number

    def _bucket(self, name: str):
        table = self.tables[name]
        return F.pmod(F.xxhash64(*(table.bucketed or table.key)), F.lit(self.buckets)).cast("int")

    def _rows(self, name: str, folders: dict[str, str]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.tables[name].schema)
        found = sorted(set(folders.values()))
        return self.spark.read.schema(empty.schema).parquet(*found) if found else empty

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """A table as the last commit has it, or the one given: pass one state to read several tables alike."""
        return self._rows(name, (state or self.state())["tables"].get(name, {}))

    def _rewritten(self, name: str, base: dict, hit: list[int], change: Callable[[DataFrame], DataFrame]) -> dict[str, str]:
        """The table's folders after `change` of the rows of the buckets hit, which are written anew; others stay as they are."""
        folders = dict(base["tables"].get(name, {}))
        old = self._rows(name, {b: f for b, f in folders.items() if int(b) in hit})
        made = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
        rows = change(old).withColumn("_bucket", self._bucket(name))
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(made)
        system, path = self._file(made.removeprefix(f"{self.path}/"))
        there = {int(f.getPath().getName().split("=")[1]) for f in system.listStatus(path) if f.getPath().getName().startswith("_bucket=")}
        return {b: f for b, f in folders.items() if int(b) not in hit} | {str(b): f"{made}/_bucket={b}" for b in there}

    def _hit(self, name: str, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(name).alias("b")).distinct().collect()]  # at most `buckets` numbers

    def merge(self, name: str, new: DataFrame, order: list | None = None, batch: int | None = None) -> int:
        """Upserts rows by the table's key (of new rows that repeat a key, the first in `order`) and returns the commit's number.

        Only buckets that new rows fall in are read and written. A batch of a number that a
        commit has counted for this table changes nothing.
        """
        base, table = self.state(), self.tables[name]
        if table.bucketed and not set(table.bucketed) <= set(table.key):
            raise ValueError("a merge by key needs buckets that the key decides")
        if batch is not None and batch <= base["batches"].get(name, -1):
            return base["number"]
        columns = self.spark.createDataFrame([], table.schema).columns
        folders = self._rewritten(name, base, self._hit(name, new), lambda old: upsert(old, one_each(new, table.key, order).select(*columns), table.key))
        return self._commit(base, {name: folders}, None if batch is None else {name: batch})

    def replace_document(self, rows: dict[str, DataFrame], document: str = "document_id") -> int:
        """Puts the rows given, all of one document, in place of that document's rows in all of their tables, in one commit.

        Tables are bucketed by the document. Rows of no or of several documents, or of different ones in two tables, are
        an error, and nothing changes; so does a null document.
        """
        ids = [r[0] for d in rows.values() for r in d.select(document).distinct().limit(2).collect()]
        if len(set(ids)) != 1 or None in ids:
            raise ValueError("a replacement holds the rows of exactly one document")
        if any((self.tables[n].bucketed or self.tables[n].key) != [document] for n in rows):
            raise ValueError(f"tables of documents are bucketed by {document}")
        base, one = self.state(), ids[0]
        changed = {}
        for name, new in rows.items():
            columns = self.spark.createDataFrame([], self.tables[name].schema).columns
            probe = self.spark.createDataFrame([(one,)], f"`{document}` {new.schema[document].dataType.simpleString()}")
            keep = lambda old, n=new, c=columns: old.filter(~F.col(document).eqNullSafe(F.lit(one))).unionByName(n.select(*c))
            changed[name] = self._rewritten(name, base, self._hit(name, probe), keep)
        return self._commit(base, changed)

    def vacuum(self, keep: int = 2) -> int:
        """Removes folders that none of the last `keep` commits names, and older commits; not while a writer is at work."""
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for t in self.state(n)["tables"].values() for f in t.values()}
        gone = 0
        for name in self.tables:
            system, path = self._file(f"data/{name}")
            for version in system.listStatus(path) if system.exists(path) else []:
                for part in system.listStatus(version.getPath()):
                    if part.isDirectory() and f"{self.path}/data/{name}/{version.getPath().getName()}/{part.getPath().getName()}" not in named:
                        system.delete(part.getPath(), True)
                        gone += 1
                if not any(x.isDirectory() for x in system.listStatus(version.getPath())):
                    system.delete(version.getPath(), True)
        for n in numbers[:-keep]:
            system, path = self._file(f"commits/{n:020d}.json")
            system.delete(path, False)
        return gone
