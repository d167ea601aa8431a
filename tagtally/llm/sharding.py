"""Sharded storage of a growing corpus by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. A version of the corpus is an immutable, numbered manifest that names
segments: a segment lists shards that came, with their rows and bytes, and shards that went. A commit writes one segment
and a short manifest; segments of similar size are merged as they gather, so a manifest names a number of segments that grows with the
logarithm of the commits, and what a commit writes does not grow with the corpus. Readers take the newest manifest and read
exactly its shards, so they never see half of a change. Compaction looks at shards below the target size in tiers (powers of ``fan`` of their size), and
merges runs of at least ``fan`` shards of a tier, in order of arrival, into files near the target size; the new
manifest replaces the merged shards by the merged files. A commit writes the manifest under a temporary name and
gives it the next number; that fails if another writer was first, and the change is tried again on top.

Files are listed, read and moved through Spark's own file-system layer. The name of a manifest is given once: on
HDFS and stores with an atomic rename by a rename that fails where the target exists, on a local disk by a hard link.
A store that has neither needs one writer at a time. Plans have one line for each shard, never for rows. A writer that dies
before its commit leaves files that no manifest names; ``vacuum`` lists the folders and removes what no kept version
names, once it is older than a grace time, which must be longer than any write takes.

Defined results: appending no rows adds no shard; repeated rows stay; nulls too. The schema of the corpus is the union
of the appended ones, by name: a column that some rows were written without is null there, and a column that comes
again with another type is an error that changes nothing. Columns may have any names; ``read`` adds a column only if asked for one.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tagtally.llm._common import checkpoint_folder, hinted


def merged_schema(old: StructType | None, new: StructType) -> StructType:
    """The fields of both by name, nullable; the same name with two types is an error."""
    fields = {f.name: f for f in (old.fields if old else [])}
    for f in new.fields:
        if f.name in fields and fields[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the corpus and {f.dataType.simpleString()} in the new rows")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType(list(fields.values()))


class Shards:
    """A corpus under one folder: ``shards/`` holds immutable files, ``segments/`` lists of them, ``manifests/`` the numbered versions."""

    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = 128 << 20, fan: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target, self.fan, self.least = target_bytes, fan, least_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))

    # -- manifests

    def version(self) -> int:
        """Number of the newest manifest; 0 before the first commit."""
        return max([0, *self._versions()])

    def _versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _store(self, name: str, made: dict) -> None:
        stream = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()

    def root(self, version: int | None = None) -> dict:
        """A manifest as it is stored: version, schema, next number of arrival, and its segments."""
        version = self.version() if version is None else version
        return self._load(f"manifests/v{version:08d}.json") if version else {"version": 0, "schema": None, "next": 1, "segments": []}

    def manifest(self, version: int | None = None) -> dict:
        """A version with all its shards in order of arrival."""
        root = self.root(version)
        return {k: v for k, v in root.items() if k != "segments"} | {"shards": self._shards(root["segments"])}

    def _shards(self, segments: list[dict]) -> list[dict]:
        came, gone = {}, set()
        for x in segments:
            segment = self._load(f"segments/{x['name']}.json")
            came |= {s["file"]: s for s in segment["came"]}
            gone |= set(segment["gone"])
        return sorted((s for f, s in came.items() if f not in gone), key=lambda s: s["arrival"])

    def _segment(self, came: list[dict], gone: list[str]) -> dict:
        name = uuid.uuid4().hex
        self._store(f"segments/{name}.json", {"came": came, "gone": gone})
        return {"name": name, "lines": len(came) + len(gone)}

    def _gathered(self, segments: list[dict]) -> list[dict]:
        """Segments with the last ones merged while each is not much larger than all behind it; shards that came and went in them are forgotten."""
        at, behind = len(segments), 0
        while at > 0 and segments[at - 1]["lines"] <= self.fan * max(behind, 1):
            at -= 1
            behind += segments[at]["lines"]
        if len(segments) - at <= self.fan:
            return segments
        came, gone = {}, []
        for x in segments[at:]:
            segment = self._load(f"segments/{x['name']}.json")
            came |= {s["file"]: s for s in segment["came"]}
            gone += [f for f in segment["gone"] if came.pop(f, None) is None]
        return [*segments[:at], self._segment(list(came.values()), gone)]

    def _commit(self, made: dict) -> bool:
        """Publish a manifest as the next version; False if another writer has published that number."""
        name = self._path(f"{self.folder}/manifests/v{made['version']:08d}.json")
        draft = f"manifests/.{uuid.uuid4().hex}"
        self._store(draft, made | {"at": time.time()})
        draft = self._path(f"{self.folder}/{draft}")
        try:
            self._publish(draft, name)
        except Exception as e:
            if not self._fs.exists(name):  # no other writer was first: a fault of the store
                raise e
            return False
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)
        return True

    def _publish(self, draft, name) -> None:
        """Give the draft its name in one step that fails if the name is taken."""
        jvm = self.spark.sparkContext._jvm
        if self._fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Path.of(p.toUri())
            draft, name = (self._fs.makeQualified(p) for p in (draft, name))
            jvm.java.nio.file.Files.createLink(local(name), local(draft))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
            options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            options[0] = jvm.java.lang.Enum.valueOf(kind, "NONE")
            context.rename(draft, name, options)

    def _change(self, change) -> dict | None:
        """Apply ``change(root) -> schema, next arrival, shards that come, files that go`` to the newest until a commit goes through; None if it gives up."""
        while True:
            last = self.root()
            parts = change(last)
            if parts is None:
                return None
            schema, after, came, gone = parts
            segments = self._gathered([*last["segments"], self._segment(came, gone)])
            made = {"version": last["version"] + 1, "schema": schema, "next": after, "segments": segments}
            if self._commit(made):
                return made

    # -- writing

    def _listed(self, folder: str) -> list[dict]:
        """The data files of a folder of shards, in order of name, with bytes, and rows from their footers."""
        where = self._path(f"{self.folder}/shards/{folder}")
        files = [f for f in self._fs.listStatus(where) if f.getPath().getName().endswith(".parquet")] if self._fs.exists(where) else []
        if not files:
            return []
        # No column is read, so footers give the counts; a number comes back for each file.
        counted = self.spark.read.parquet(*[f.getPath().toString() for f in files]).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        rows = {r["f"]: r["count"] for r in counted}
        named = sorted((f.getPath().getName(), f.getLen()) for f in files)
        return [{"file": f"{folder}/{name}", "bytes": size, "rows": rows.get(name, 0)} for name, size in named if rows.get(name, 0)]

    def stage(self, rows: DataFrame, by: str | None = None) -> dict:
        """Write rows as immutable files that no version names yet: lists of files by the value of an integer column ``by``, which stays in the rows."""
        name = f"in-{uuid.uuid4().hex}"
        if by is None:
            rows.write.mode("errorifexists").parquet(f"{self.folder}/shards/{name}")
            return {None: self._listed(name)}
        part = f"part_{uuid.uuid4().hex}"
        rows.withColumn(part, F.col(f"`{by}`")).write.mode("errorifexists").partitionBy(part).parquet(f"{self.folder}/shards/{name}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/shards/{name}")) if f.isDirectory()]
        return {int(f.split("=")[1]): self._listed(f"{name}/{f}") for f in found if f.startswith(f"{part}=")}

    def adopt(self, files: list[dict], schema: StructType) -> dict:
        """Commit staged files as the next arrivals; no files are no change."""
        if not files:
            return self.root()

        def change(last: dict):
            known = StructType.fromJson(json.loads(last["schema"])) if last["schema"] else None
            at = last["next"]
            return merged_schema(known, schema).json(), at + len(files), [s | {"arrival": at + i} for i, s in enumerate(files)], []

        return self._change(change)

    def append(self, rows: DataFrame) -> dict:
        """Add rows as small shards, one for each input partition that has rows, and commit."""
        last = self.root()
        merged_schema(StructType.fromJson(json.loads(last["schema"])) if last["schema"] else None, rows.schema)  # fails before anything is written
        return self.manifest(self.adopt(self.stage(rows)[None], rows.schema)["version"])

    def plan(self, manifest: dict) -> list[list[dict]]:
        """Groups of shards to merge: of one tier, neighbours in order of arrival, near the target size together."""
        tiers: dict[int, list[dict]] = {}
        for s in manifest["shards"]:
            if s["bytes"] < self.target / 2:
                tier, size = 0, self.least
                while s["bytes"] >= size * self.fan:
                    tier, size = tier + 1, size * self.fan
                tiers.setdefault(tier, []).append(s)
        groups = []
        for _, shards in sorted(tiers.items()):
            run, size = [], 0
            for s in sorted(shards, key=lambda s: s["arrival"]):
                run.append(s)
                size += s["bytes"]
                if size >= self.target:
                    groups.append(run)
                    run, size = [], 0
            if len(run) >= self.fan:
                groups.append(run)
        return [g for g in groups if len(g) >= 2]

    def compact(self) -> dict:
        """Merge what the plan says in one job, a task for each merged file, and commit the exchange.

        If another writer has meanwhile taken away one of the shards, the merged files go and the plan is made anew.
        """
        while True:
            last = self.manifest()
            groups = self.plan(last)
            if not groups:
                return last
            out, new = self._merged(groups, StructType.fromJson(json.loads(last["schema"])))
            gone = {s["file"] for g in groups for s in g}

            def change(now: dict):
                if not gone <= {s["file"] for s in self._shards(now["segments"])}:
                    return None
                return now["schema"], now["next"], new, sorted(gone)

            made = self._change(change)
            if made is not None:
                return self.manifest(made["version"])
            self._fs.delete(self._path(f"{self.folder}/shards/{out}"), True)

    def _merged(self, groups: list[list[dict]], schema: StructType) -> tuple[str, list[dict]]:
        """Write each group of shards as one file; the folder and the new shards."""
        mark = uuid.uuid4().hex
        file, number = f"file_{mark}", f"group_{mark}"  # beside columns of any names
        listed = [(s["file"], i) for i, g in enumerate(groups) for s in g]
        lookup = hinted(self.spark.createDataFrame(listed, f"{file} string, {number} int"), len(listed))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/shards/{name}" for name, _ in listed])
        rows = rows.withColumn(file, F.element_at(F.split(F.col("_metadata.file_path"), "/shards/"), -1)).join(lookup, file).drop(file)
        # A group is near the target size by construction, and each has a task of its own.
        rows = rows.repartitionById(len(groups), F.col(number))
        out = f"out-{mark}"
        rows.write.mode("errorifexists").partitionBy(number).parquet(f"{self.folder}/shards/{out}")
        new = []
        for i, g in enumerate(groups):
            where = self._path(f"{self.folder}/shards/{out}/{number}={i}")
            files = [f for f in self._fs.listStatus(where) if f.getPath().getName().endswith(".parquet")] if self._fs.exists(where) else []
            # One task writes a group, so its file has the rows of the shards it replaces.
            new += [{"file": f"{out}/{number}={i}/{f.getPath().getName()}", "bytes": f.getLen(), "rows": sum(s["rows"] for s in g), "arrival": min(s["arrival"] for s in g)} for f in files]
        return out, new

    def vacuum(self, keep_versions: int = 1, older_than: float = 86_400.0) -> int:
        """Delete what no kept version names and is older than ``older_than`` seconds: shards, segments, manifests, drafts. Returns how many shards.

        Kept are the newest ``keep_versions`` and those that were the newest within that time: who began to read one may still do
        so. Files of a writer that died before its commit are named nowhere; the folders are listed, so they go as well.
        """
        newest, now = self.version(), time.time()
        roots = {v: self.root(v) for v in sorted(self._versions())}
        after = {v: w for v, w in zip(roots, list(roots)[1:])}
        kept = {v for v in roots if v > newest - max(1, keep_versions) or (v in after and roots[after[v]]["at"] > now - older_than)}
        segments = {x["name"]: x for v in kept for x in roots[v]["segments"]}
        live = {s["file"] for v in kept for s in self._shards(roots[v]["segments"])}
        old = lambda f: f.getModificationTime() / 1000 <= now - older_than
        gone = 0
        for f in self._files("shards"):
            name = f.getPath().toString().split("/shards/", 1)[1]
            if name.endswith(".parquet") and not f.getPath().getName().startswith(".") and name not in live and old(f):
                gone += bool(self._fs.delete(f.getPath(), False))
        for f in self._fs.listStatus(self._path(f"{self.folder}/segments")) if self._fs.exists(self._path(f"{self.folder}/segments")) else []:
            if f.getPath().getName().removesuffix(".json") not in segments and not f.getPath().getName().endswith(".crc") and old(f):
                self._fs.delete(f.getPath(), False)
        for f in self._fs.listStatus(self._path(f"{self.folder}/manifests")):
            name = f.getPath().getName()
            if (name.startswith("v") and int(name[1:-5]) not in kept or name.startswith(".") and not name.endswith(".crc")) and old(f):
                self._fs.delete(f.getPath(), False)
        return gone

    def _files(self, folder: str):
        where = self._path(f"{self.folder}/{folder}")
        found = self._fs.listFiles(where, True) if self._fs.exists(where) else None
        while found is not None and found.hasNext():
            yield found.next()

    # -- reading

    def read(self, version: int | None = None, file_column: str | None = None) -> DataFrame:
        """The rows of a version with their own columns, and on request one that names the file which holds them."""
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m["schema"])) if m["schema"] else StructType([])
        if file_column in schema.names:
            raise ValueError(f"the corpus has a column {file_column}")
        if not m["shards"]:
            return self.spark.createDataFrame([], StructType([*schema.fields, *([StructField(file_column, StringType())] if file_column else [])]))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/shards/{s['file']}" for s in m["shards"]])
        return rows.withColumn(file_column, F.element_at(F.split(F.col("_metadata.file_path"), "/shards/"), -1)) if file_column else rows


def shard_report(docs: DataFrame, arrivals: int = 6, target_bytes: int = 32 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Append ``docs`` in ``arrivals`` batches with compaction between them, and say for each row where it went.

    Returns the id, ``arrival`` (its batch), ``shard`` (number of its file in the last manifest by order of
    arrival), ``text_sha256`` (read back), ``shard_rows`` and ``version``. The store stays in the checkpoint folder,
    which the result reads.
    """
    spark = docs.sparkSession
    store = Shards(spark, f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}", target_bytes, least_bytes=256 << 10)
    mark = uuid.uuid4().hex
    arrival, file = f"arrival_{mark}", f"file_{mark}"
    # All batches are written in one pass over the input, and committed one after the other.
    rows = docs.withColumn(arrival, F.pmod(F.xxhash64(id_column), F.lit(arrivals)).cast("int"))
    staged = store.stage(rows, arrival)
    for k in range(arrivals):
        store.adopt(staged.get(k, []), rows.schema)
        if k % 3 == 2:
            store.compact()
    store.compact()
    store.vacuum(older_than=0)  # nobody else reads or writes this store
    last = store.manifest()
    out = f"{dict(docs.dtypes)[id_column]}, arrival int, shard int, text_sha256 string, shard_rows long, version int"
    if not last["shards"]:
        return spark.createDataFrame([], f"`{id_column}` {out}")
    placed = spark.createDataFrame([(s["file"], i, s["rows"]) for i, s in enumerate(last["shards"])], "name string, number int, shard_rows long")
    rows = store.read(file_column=file)
    rows = rows.select(id_column, F.col(arrival).alias("arrival"), F.col(file).alias("file"), F.sha2(F.coalesce(F.col(f"`{text_column}`"), F.lit("")), 256).alias("text_sha256"))
    rows = rows.join(hinted(placed, len(last["shards"])), F.col("file") == F.col("name"))
    return rows.select(id_column, "arrival", F.col("number").alias("shard"), "text_sha256", "shard_rows", F.lit(last["version"]).alias("version"))
