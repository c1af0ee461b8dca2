"""The engine: index statements, and queries that use what they have made.

``Engine.sql`` takes the index statements and any Spark SQL; ``Engine.table`` is the
DataFrame way.  Spark plans a query first; from its plan the engine takes the filters,
columns and files of each scan, decides for every file, and gives Spark a smaller source
for the same query.  The query's own filter always runs, so an index can leave rows
unread but never decide that a row matches.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import build, statistics
from .operators.statistics import FULL, SKIP, USE
from .plans import ddl, names, planner
from .plans.intervals import KeySet
from .plans.predicates import FileEntry, ScanInfo, relation_of, scans
from .sources import files, rows
from .sources.cache import TableCache
from .sources.catalog import Catalog, IndexDef, TableEntry

PREFIX = "spark.quern."
#: Settings and their values where unset.
DEFAULTS = {
    "parquet.enabled": "true",
    "orc.enabled": "true",
    "index.enabled": "true",
    "index.executor.selection": "true",
    "index.file.policy": "true",
    "index.size.ratio": "0.7",
    "index.statistics.policy": "true",
    "index.max.use": "1",
    "index.disabled": "",
    "statistics.kinds": "BLOOM,MINMAX,PARTBYVALUE,SAMPLE",
    "statistics.full.scan.threshold": "0.2",
    "statistics.part.num": "5",
    "statistics.sample.rate": "0.05",
    "statistics.sample.min": "24",
    "statistics.sample.max": "1000",
    "statistics.bloom.bits": str(1 << 20),
    "statistics.bloom.hashes": "3",
    "cache.enabled": "true",
    "cache.table.list.enabled": "false",
    "cache.table.list": "",
    "parquet.data.cache": "false",
    "parquet.binary.cache": "false",
    "orc.data.cache": "false",
    "orc.binary.cache": "false",
    "row.reads": "true",
}
#: Files whose names a filter lists in the plan; more are joined.
LISTED_FILES = 200
#: Option of a relation by which the plan tells the places apart that name a table.
OCCURRENCE = "quern.occurrence"
REPORT = "table string, index string, file string, decision string, reason string, coverage double"
#: Messages of CHECK and CREATE that tools read (fixed values of the interface).
NO_META, NO_DATA_FILE = "Meta file not found in partition: {}", "Data file: {} not found!"
NO_INDEX = "Missing index:{},\nindexColumn(s): {}, indexType: {}\nfor Data File: {}\nof table: {}"
AMBIGUOUS = "\nAmbiguous Index(different indices have the same name):\nindex name:{}"
SHOW = "table string, key_name string, seq_in_index int, column_name string, collation string, index_type string, enabled boolean"


class Engine:
    """``index_dir`` holds all index files; data files are never changed."""

    def __init__(self, spark: SparkSession, index_dir: str):
        self.spark = spark
        self.catalog = Catalog(spark, index_dir)
        self.cache = TableCache(spark)
        self.metrics: Counter[str] = Counter()
        self._report: list[tuple] = []
        self._manifests: dict[str, dict[str, dict]] = {}
        self._data: dict[str, DataFrame] = {}

    # Settings

    def get(self, key: str) -> str:
        return self.spark.conf.get(PREFIX + key, DEFAULTS[key])

    def set(self, key: str, value) -> None:
        if key not in DEFAULTS:
            raise KeyError(key)
        self.spark.conf.set(PREFIX + key, str(value).lower() if isinstance(value, bool) else str(value))

    def _on(self, key: str) -> bool:
        return self.get(key).lower() == "true"

    def _options(self) -> statistics.Options:
        return statistics.Options(tuple(k.strip() for k in self.get("statistics.kinds").split(",") if k.strip()), int(self.get("statistics.part.num")), float(self.get("statistics.sample.rate")), int(self.get("statistics.sample.min")), int(self.get("statistics.sample.max")), int(self.get("statistics.bloom.bits")), int(self.get("statistics.bloom.hashes")), float(self.get("statistics.full.scan.threshold")))

    @property
    def disabled(self) -> list[str]:
        return [n.strip() for n in self.get("index.disabled").split(",") if n.strip()]

    # Statements

    def sql(self, text: str) -> DataFrame:
        statement = ddl.parse(text)
        if statement:
            return getattr(self, f"_{statement.kind}")(statement)
        return self._query(text)

    def register(self, name: str, path: str, fmt: str = "parquet") -> DataFrame:
        """A temporary view ``name`` over the files at ``path``."""
        df = self.spark.read.format(fmt).load(path)
        df.createOrReplaceTempView(name)
        return df

    def _relation(self, table: str):
        df = self.spark.table(table)
        found = relation_of(df)
        if not found:
            raise AnalysisException(f"{table} is not a plain Parquet or ORC relation: it can't be indexed")
        return df, *found

    def _in_partitions(self, df: DataFrame, spec: dict[str, str], partition_columns: list[str]) -> DataFrame:
        """``df`` within a partition specification; unknown keys are refused, some keys may be left out."""
        known = {c.lower(): c for c in partition_columns}
        for key, value in spec.items():
            if key.lower() not in known:
                raise AnalysisException(f"{key} is not a partition column ({', '.join(partition_columns) or 'there are none'})")
            column = known[key.lower()]
            df = df.where(F.col(f"`{column}`") == F.lit(value).cast(df.schema[column].dataType))
        return df

    def _files(self, df: DataFrame) -> list[FileEntry]:
        found = scans(df)
        return found[0].files if found else []

    def _create(self, s: ddl.Statement) -> DataFrame:
        df, roots, fmt, partition_columns = self._relation(s.table)
        columns = {f.name.lower(): f for f in df.schema.fields}
        for c, _ in s.columns:
            if c.lower() not in columns:
                raise AnalysisException(f"Column {c} is not in {s.table}")
            if not isinstance(columns[c.lower()].dataType, build.KEY_TYPES):
                raise AnalysisException(f"An index can't have a key of type {columns[c.lower()].dataType.simpleString()}")
            if columns[c.lower()].name in partition_columns:
                raise AnalysisException(f"{c} is a partition column")
        if s.using == "BITMAP" and len(s.columns) != 1:
            raise AnalysisException("A bitmap index has one single column")
        index = IndexDef(s.index, s.using, [[columns[c.lower()].name, a] for c, a in s.columns], time.time())
        entry = self.catalog.load(roots) or TableEntry(s.table, list(roots), fmt, df.schema.json(), partition_columns)
        chosen = self._files(self._in_partitions(df, s.partition, partition_columns))
        known: dict[str, dict] = {}
        if s.index in entry.indexes:
            old = entry.indexes[s.index]
            known = self._manifest(old)
            repeated = [f for f in chosen if files.plain(f.path) in known]
            if repeated and not s.lenient:
                raise AnalysisException(f"Index {s.index} exists on {s.table}")
            if not old.same_definition(index):
                raise AnalysisException(AMBIGUOUS.format(s.index))
            index = old
            chosen = [f for f in chosen if files.plain(f.path) not in known]
        if chosen:
            self._extend(entry, index, chosen, known)
        return self._nothing()

    def _extend(self, entry: TableEntry, index: IndexDef, fresh: list[FileEntry], kept: dict[str, dict]) -> None:
        """Indexes ``fresh`` files in a new generation and writes a manifest of these and the ``kept`` ones."""
        generation = self.catalog.new_id()
        folder = self.catalog.folder(entry.roots, index.name)
        schema = T.StructType.fromJson(json.loads(entry.schema))
        keyed = build.keyed_rows(self.spark, entry.format, [f.path for f in fresh], index.names, tuple(entry.roots), schema)
        data = f"{folder}/data-{generation}"
        with build.small_reads(self.spark):
            schema = build.write(keyed, index.kind, index.columns, data)
            entries = self._data[data] = self.spark.read.schema(schema).parquet(data)
            # Twice as many ranges as files of the index: a bound falls into each, so each has a task of its own.
            made = len(entries.inputFiles())
            tasks = 2 * made if made > 1 else 1
            self._write_manifest(entry, index, fresh, kept, statistics.build(entries, len(index.columns), self._options(), generation, keyed, tasks), generation)

    def _write_manifest(self, entry: TableEntry, index: IndexDef, fresh: list[FileEntry], kept: dict[str, dict], stats: DataFrame, generation: str) -> None:
        folder = self.catalog.folder(entry.roots, index.name)
        # A file without rows has no entries; its row says so.
        sizes = self.spark.createDataFrame([(files.plain(f.path), f.size, f.modified) for f in fresh], "file string, size long, modified long")
        stats = sizes.join(stats, "file", "left").withColumns({"gen": F.lit(generation), **{c: F.coalesce(c, F.lit(0)) for c in ("rows", "entries", "index_bytes", "dense", *(f"nulls{i}" for i in range(len(index.columns))))}})
        if kept:
            old = self.spark.read.parquet(index.manifest)
            stats = old.join(self.spark.createDataFrame([(f,) for f in kept], "file string"), "file", "left_semi").unionByName(stats, allowMissingColumns=True)
        manifest = f"{folder}/manifest-{generation}"
        # Dealt out, not coalesced: else the tasks that write it would do all the joins and windows before.
        stats.repartition(max(1, min(64, (len(kept) + len(fresh)) // 5000))).write.parquet(manifest)
        index.manifest = manifest
        index.generations = [g for g in index.generations if any(r["gen"] == g for r in kept.values())] + [generation]
        entry.indexes[index.name] = index
        self.catalog.save(entry)

    def _manifest(self, index: IndexDef) -> dict[str, dict]:
        """What the driver must know of each file, read once: some numbers, the least and greatest key and a few
        cut points, as its own list of files has.  Bloom bits and samples stay where they are."""
        if index.manifest not in self._manifests:
            self._manifests[index.manifest] = {r["file"]: r.asDict(recursive=True) for r in self.spark.read.parquet(index.manifest).drop("bloom", "sample").collect()}
        return self._manifests[index.manifest]

    def _judged(self, df: DataFrame, c: planner.Chosen, info: ScanInfo, options: statistics.Options) -> dict[str, dict]:
        """For the files that their least and greatest keys leave: whether a Bloom filter may hold the keys, and the
        sample's share.  Only these two go to the driver."""
        asked = [k for k in ("BLOOM", "SAMPLE") if k in options.kinds]
        left = [files.plain(f.path) for f in info.files]
        left = [f for f in left if f in c.manifest and not any(s.is_empty for s in c.sets) and statistics.may_hold(c.manifest[f], c.sets)]
        if c.index.kind != "BTREE" or not asked or not left:
            return {}
        places = self._bloom_places(df, c, options) if "BLOOM" in asked else None
        rows_ = self.spark.read.parquet(c.index.manifest)
        if len(left) <= LISTED_FILES:
            rows_ = rows_.where(F.col("file").isin(left))
        elif len(left) < len(c.manifest):
            rows_ = rows_.join(self.spark.createDataFrame([(f,) for f in left], "file string"), "file", "left_semi")
        held = statistics.bloom_may_hold(F.col("bloom"), places) if places is not None else F.lit(True)
        hits = F.filter("sample", lambda x: reduce(Column.__and__, [key_filter(x[f"k{i}"], s) for i, s in enumerate(c.sets)]))
        share = F.when(F.size("sample") > 0, F.size(hits) / F.size("sample")) if "SAMPLE" in asked else F.lit(None).cast("double")
        return {r["file"]: {"held": r["held"], "share": r["share"]} for r in rows_.select("file", F.coalesce(held, F.lit(True)).alias("held"), share.alias("share")).collect()}

    def _drop(self, s: ddl.Statement) -> DataFrame:
        df, roots, _, partition_columns = self._relation(s.table)
        entry = self.catalog.load(roots)
        index = entry.indexes.get(s.index) if entry else None
        if index is None:
            if not s.lenient:
                raise AnalysisException(f"Index {s.index} does not exist on {s.table}")
            return self._nothing()
        known = self._manifest(index)
        gone = {files.plain(f.path) for f in self._files(self._in_partitions(df, s.partition, partition_columns))} if s.partition else set(known)
        if s.partition and not gone & set(known):
            if not s.lenient:
                raise AnalysisException(f"Index {s.index} does not exist on {s.table} in that partition")
            return self._nothing()
        kept = {f: r for f, r in known.items() if f not in gone}
        if kept:
            self._retain(entry, index, kept)
        else:
            self._forget(entry, index, index.generations)
            del entry.indexes[s.index]
            self.catalog.save(entry)
            files.delete(self.spark, self.catalog.folder(roots, s.index))
        return self._nothing()

    def _refresh(self, s: ddl.Statement) -> DataFrame:
        """Indexes files that are new or have changed, for every index of the table; forgets files that are gone."""
        df, roots, _, partition_columns = self._relation(s.table)
        entry = self.catalog.load(roots)
        if entry is None:
            return self._nothing()
        present = {files.plain(f.path): f for f in self._files(df)}
        selected = {files.plain(f.path) for f in self._files(self._in_partitions(df, s.partition, partition_columns))}
        for index in list(entry.indexes.values()):
            known = self._manifest(index)
            same = lambda f: f in present and (known[f]["size"], known[f]["modified"]) == (present[f].size, present[f].modified)  # noqa: E731, B023
            kept = {f: r for f, r in known.items() if f not in selected and f in present or same(f)}
            fresh = [present[f] for f in sorted(selected) if f not in kept]
            if fresh:
                self._extend(entry, index, fresh, kept)
            elif len(kept) != len(known):  # files are gone, and nothing is new
                self._retain(entry, index, kept)
        return self._nothing()

    def _retain(self, entry: TableEntry, index: IndexDef, kept: dict[str, dict]) -> None:
        """A manifest of the ``kept`` files only; generations that no file needs go."""
        folder = self.catalog.folder(entry.roots, index.name)
        manifest = f"{folder}/manifest-{self.catalog.new_id()}"
        self.spark.read.parquet(index.manifest).join(self.spark.createDataFrame([(f,) for f in kept], "file string"), "file", "left_semi").repartition(max(1, min(64, len(kept) // 5000))).write.parquet(manifest)
        unused = [g for g in index.generations if all(r["gen"] != g for r in kept.values())]
        self._forget(entry, index, unused)
        index.manifest, index.generations = manifest, [g for g in index.generations if g not in unused]
        self.catalog.save(entry)
        for g in unused:
            files.delete(self.spark, f"{folder}/data-{g}")

    def _forget(self, entry: TableEntry, index: IndexDef, generations: list[str]) -> None:
        """What is remembered of an index's files goes with them."""
        self._manifests.pop(index.manifest, None)
        for g in generations:
            self._data.pop(f"{self.catalog.folder(entry.roots, index.name)}/data-{g}", None)

    def _show(self, s: ddl.Statement) -> DataFrame:
        _, roots, _, _ = self._relation(s.table)
        entry, off = self.catalog.load(roots), set(self.disabled)
        found = [(s.table, i.name, at, c, "A" if ascending else "D", i.kind, i.name not in off) for i in (entry.indexes.values() if entry else ()) for at, (c, ascending) in enumerate(i.columns)]
        return self.spark.createDataFrame(found, SHOW)

    def _check(self, s: ddl.Statement) -> DataFrame:
        """What is wrong with the indexes: partitions without any, data files or index files that are gone."""
        df, roots, _, partition_columns = self._relation(s.table)
        entry = self.catalog.load(roots)
        present = {files.plain(f.path) for f in self._files(self._in_partitions(df, s.partition, partition_columns))}
        every = {files.plain(f.path) for f in self._files(df)} if s.partition else present
        folder = lambda f: f.rsplit("/", 1)[0]
        known = {i.name: self._manifest(i) for i in entry.indexes.values()} if entry else {}
        covered = {folder(f) for m in known.values() for f in m}
        said = [NO_META.format(p) for p in sorted({folder(f) for f in present} - covered)]
        inside = {folder(f) for f in present}
        listed = sorted({f for m in known.values() for f in m if not s.partition or folder(f) in inside})
        said += [NO_DATA_FILE.format(f) for f in listed if f not in every]
        for i in entry.indexes.values() if entry else ():
            lost = {g for g in i.generations if not files.exists(self.spark, f"{self.catalog.folder(roots, i.name)}/data-{g}")}
            kind = {"BTREE": "BTree", "BITMAP": "Bitmap"}[i.kind]
            said += [NO_INDEX.format(i.name, ",".join(i.names), kind, f, s.table) for f in listed if f in every and f in known[i.name] and known[i.name][f]["gen"] in lost]
        return self.spark.createDataFrame([(m,) for m in said], "`Analysis Result` string")

    def _disable(self, s: ddl.Statement) -> DataFrame:
        self.set("index.disabled", ", ".join(dict.fromkeys([*self.disabled, s.index])))
        return self._nothing()

    def _enable(self, s: ddl.Statement) -> DataFrame:
        self.set("index.disabled", ", ".join(n for n in self.disabled if n != s.index))
        return self._nothing()

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([]))

    # Queries

    def table(self, name: str) -> IndexedTable:
        return IndexedTable(self, name)

    def _query(self, text: str) -> DataFrame:
        """A query in which the indexed or kept tables are replaced by views of what must be read.

        Each place that names such a table gets a view of its own, so a table that is named
        twice is planned twice.  Views have names of their own: other sessions and threads
        never see them in a table's place.  Whatever can't be read from the plan is run as it is.
        """
        self._report = []
        views: list[str] = []
        try:
            parsed = names.parse(self.spark, text)
            found = self._sources(parsed, text, views) if parsed else {}
            text = names.replaced(text, found)
        except Exception:  # noqa: BLE001  the plain text gives the result, or says what is wrong with it
            self._report, found = [], {}
        try:
            return self.spark.sql(text)
        finally:
            # An analysed plan no longer needs its views; dropped here, what they read stays in the cache.
            catalog = self.spark._jsparkSession.sessionState().catalog()
            for v in views:
                catalog.dropTempView(v)

    def _sources(self, parsed: names.Parsed, text: str, views: list[str]) -> dict[names.Occurrence, str]:
        """The view to read for each occurrence that has one."""

        def view(df: DataFrame) -> str:
            views.append(f"quern_{uuid.uuid4().hex}")
            df.createOrReplaceTempView(views[-1])
            return views[-1]

        tagged: dict[names.Occurrence, tuple[str, DataFrame]] = {}
        for n, o in enumerate(parsed.found):
            df = self.spark.table(o.name)
            relation = relation_of(df)
            if relation and (self.catalog.load(relation[0]) or any(self._on(f"{relation[1]}.{k}.cache") for k in ("data", "binary"))):
                # Told apart in the plan by an option of the relation.
                read = self._reader(df, relation[0], relation[1], relation[2]).option(OCCURRENCE, str(n)).load(list(relation[0]))
                tagged[o] = view(read.select(*[F.col(f"`{c}`") for c in df.columns])), df
        if not tagged:
            return {}
        by_place = {str(n): o for n, o in enumerate(parsed.found)}
        query = text[parsed.query :]
        moved = {replace(o, begin=o.begin - parsed.query, end=o.end - parsed.query): v for o, (v, _) in tagged.items()}
        scanned: dict[str, list[ScanInfo]] = {}
        for info in scans(self.spark.sql(names.replaced(query, moved))):
            scanned.setdefault(info.occurrence, []).append(info)
        found = {}
        for n, infos in scanned.items():
            if n in by_place and by_place[n] in tagged and all((i.keys, i.opens_index) == (infos[0].keys, infos[0].opens_index) for i in infos):
                o = by_place[n]
                info = replace(infos[0], required=sorted({c for i in infos for c in i.required}))
                source = self._source(plain_name(o.name), tagged[o][1], info)
                if source is not None:
                    found[o] = view(source)
        return found

    def _reader(self, df: DataFrame, roots, fmt: str, partition_columns: list[str]):
        reader = self.spark.read.format(fmt).schema(df.schema)
        return reader.option("basePath", roots[0]) if partition_columns and len(roots) == 1 else reader

    def _source(self, name: str, df: DataFrame, info: ScanInfo) -> DataFrame | None:
        """What to read instead of the table, with its whole schema; None to read it as it is."""
        if not self._on("cache.enabled") or not self._on(f"{info.format}.enabled"):
            return None
        if self._on("cache.table.list.enabled") and name.lower() not in self._hot_tables():
            return None
        level = TableCache.level(self._on(f"{info.format}.data.cache"), self._on(f"{info.format}.binary.cache"))
        if level:
            return self.cache.table(name, info.roots, df, level)
        entry = self.catalog.load(info.roots)
        if not entry or not self._on("index.enabled"):
            return None
        chosen = planner.choose(list(entry.indexes.values()), info, set(self.disabled), int(self.get("index.max.use")))
        if not chosen:
            return None
        return self._indexed(name, df, info, chosen)

    def _hot_tables(self) -> set[str]:
        return {t.strip().lower().rsplit(".", 1)[-1] for t in self.get("cache.table.list").split(";") if t.strip()}

    def _indexed(self, name: str, df: DataFrame, info: ScanInfo, chosen: list[planner.Chosen]) -> DataFrame:
        options = self._options()
        selecting = self._on("index.executor.selection")
        for c in chosen:
            c.manifest = self._manifest(c.index)
            if selecting and self._on("index.statistics.policy"):
                c.judged = self._judged(df, c, info, options)
        decisions = planner.decide(info, chosen, options, selecting and self._on("index.statistics.policy"), selecting and self._on("index.file.policy"), float(self.get("index.size.ratio")))
        self._report += [(name, d.index, files.plain(d.file.path), d.what, d.reason, d.coverage) for d in decisions]
        self._count(decisions, chosen)
        use = [d for d in decisions if d.what == USE]
        full = [d.file.path for d in decisions if d.what == FULL]
        parts = []
        if full or not use:
            parts.append(self._plain_read(df, info, full))
        if use:
            parts.append(self._index_read(df, info, chosen, use))
        return reduce(DataFrame.unionByName, parts)

    def _count(self, decisions: list[planner.Decision], chosen: list[planner.Chosen]) -> None:
        for d in decisions:
            kind = {SKIP: "skip", USE: "hit", FULL: "miss" if d.reason in ("not indexed", "changed since") else "ignore"}[d.what]
            known = chosen[0].manifest.get(files.plain(d.file.path))
            self.metrics["total_files"] += 1
            self.metrics[f"{kind}_files"] += 1
            self.metrics[f"{kind}_rows"] += known["rows"] if known else 0

    def _bloom_places(self, df: DataFrame, c: planner.Chosen, options: statistics.Options) -> list[list[int]] | None:
        if any(s.null or not s.all_points or not s.intervals for s in c.sets):
            return None
        values = [()]
        for s in c.sets:
            values = [(*v, i.lo) for v in values for i in s.intervals]
        if len(values) > 1000:
            return None
        return statistics.bloom_places(self.spark, values, [df.schema[n].dataType for n in c.index.names[: len(c.sets)]], options)

    def _plain_read(self, df: DataFrame, info: ScanInfo, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], df.schema)
        return self._reader(df, info.roots, info.format, info.partition_columns).load(paths).select(*[F.col(f"`{c}`") for c in df.columns])

    def entries(self, roots, index: IndexDef, wanted: list[str] | None = None) -> DataFrame:
        """Entries of ``index``, of the files ``wanted`` (all of its manifest by default) in their generation."""
        folder, manifest = self.catalog.folder(roots, index.name), self._manifest(index)
        wanted = list(manifest) if wanted is None else [f for f in wanted if f in manifest]
        by_generation: dict[str, list[str]] = {}
        for f in wanted:
            by_generation.setdefault(manifest[f]["gen"], []).append(f)
        parts = []
        for g, listed in by_generation.items():
            path = f"{folder}/data-{g}"
            if path not in self._data:  # a generation never changes: its file list and schema are read once
                self._data[path] = self.spark.read.parquet(path)
            df = self._data[path]
            if len(listed) <= LISTED_FILES:
                df = df.where(F.col("file").isin(listed))
            else:
                df = df.join(self.spark.createDataFrame([(f,) for f in listed], "file string"), "file", "left_semi")
            parts.append(df)
        if not parts:
            raise ValueError("no file of the index is wanted")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _index_read(self, df: DataFrame, info: ScanInfo, chosen: list[planner.Chosen], use: list[planner.Decision]) -> DataFrame:
        """Rows that the indexes name.  Files that use the same indexes are read together.

        Where rows can't be read alone (ORC, or a store that only Spark opens), the files that
        hold a matching key are read whole instead.
        """
        by_indexes: dict[str, list[FileEntry]] = {}
        for d in use:
            by_indexes.setdefault(d.index, []).append(d.file)
        parts = []
        for names, entries_of in by_indexes.items():
            used = [c for c in chosen if c.index.name in names.split(",")]
            found = []
            for c in used:
                hits = self.entries(info.roots, c.index, [files.plain(f.path) for f in entries_of])
                found.append(hits.where(reduce(Column.__and__, [key_filter(F.col(f"k{i}"), s) for i, s in enumerate(c.sets)])))
            single = info.format == "parquet" and self._on("row.reads") and all(files.is_local(f.path) for f in entries_of)
            if not single:
                held = {r["file"] for f in found[:1] for r in f.select("file").distinct().collect()}
                for f in found[1:]:
                    held &= {r["file"] for r in f.select("file").distinct().collect()}
                parts.append(self._plain_read(df, info, [f.path for f in entries_of if files.plain(f.path) in held]))
                continue
            # A row has one key in each index, so those that all of them name are listed as often.
            wanted = reduce(DataFrame.unionByName, map(rows.pieces, found))
            held = sum(used[0].manifest[files.plain(f.path)]["rows"] for f in entries_of)
            parts.append(self.fetch(df, info.partition_columns, set(info.required), wanted, len(entries_of), held, len(used)))
        return reduce(DataFrame.unionByName, parts)

    def fetch(self, df: DataFrame, partition_columns: list[str], required: set[str], wanted: DataFrame, n_files: int, held: int, need: int = 1) -> DataFrame:
        """The rows ``wanted`` (as ``read_rows`` takes them) with the schema of ``df``; columns that aren't required are null.
        The ``n_files`` have ``held`` rows, each of which may be wanted: so many tasks share them."""
        data = T.StructType([f for f in df.schema.fields if f.name in required and f.name not in partition_columns])
        read = rows.read_rows(wanted, data, max(1, min(n_files, 4 * self.spark.sparkContext.defaultParallelism), held // rows.SHARE), need)
        columns = []
        for f in df.schema.fields:
            if f.name in partition_columns:
                columns.append(rows.partition_value(F.col("file"), f.name, f.dataType).alias(f.name))
            elif f.name in required:
                columns.append(F.col(f"`{f.name}`"))
            else:
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        return read.select(*columns)

    # Reports

    def last_scan_report(self) -> DataFrame:
        """A row for each file that the last query decided on."""
        return self.spark.createDataFrame(self._report, REPORT)

    def cache_stats(self) -> DataFrame:
        return self.cache.stats()

    # Reads in index order

    def _index(self, table: str, index: str) -> tuple[DataFrame, tuple, list[str], IndexDef]:
        df, roots, _, partition_columns = self._relation(table)
        entry = self.catalog.load(roots)
        if not entry or index not in entry.indexes:
            raise AnalysisException(f"Index {index} does not exist on {table}")
        return df, roots, partition_columns, entry.indexes[index]

    def _row_entries(self, roots, index: IndexDef) -> DataFrame:
        found = self.entries(roots, index)
        keys = [f"k{i}" for i in range(len(index.columns))]
        if index.kind == "BTREE":
            return found.select(*keys, "file", F.explode("row_ids").alias("row"))
        return rows.decode_bitmaps(found, ["k0"])

    def file_top(self, table: str, index: str, k: int, ascending: bool = True) -> DataFrame:
        """The first ``k`` rows of each file in key order (null keys last, ties by row)."""
        df, roots, partition_columns, found = self._index(table, index)
        order_by = [F.col(f"k{i}").asc_nulls_last() if ascending else F.col(f"k{i}").desc_nulls_last() for i in range(len(found.columns))]
        ranked = self._row_entries(roots, found).withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy(*order_by, "row"))).where(F.col("at") <= k)
        manifest = self._manifest(found)
        return self.fetch(df, partition_columns, set(df.columns), ranked.select("file", "row"), len(manifest), sum(r["rows"] for r in manifest.values()))

    def key_limit(self, table: str, index: str, n: int) -> DataFrame:
        """At most ``n`` rows of each file for each key, the first ones."""
        df, roots, partition_columns, found = self._index(table, index)
        if found.kind == "BTREE":
            some = self.entries(roots, found).select("file", F.explode(F.slice("row_ids", 1, n)).alias("row"))
        else:
            ranked = self._row_entries(roots, found)
            some = ranked.withColumn("at", F.row_number().over(Window.partitionBy("file", "k0").orderBy("row"))).where(F.col("at") <= n).select("file", "row")
        manifest = self._manifest(found)
        return self.fetch(df, partition_columns, set(df.columns), some, len(manifest), sum(r["rows"] for r in manifest.values()))


def plain_name(name: str) -> str:
    """The last part of a quoted name."""
    return name.rsplit("`.`", 1)[-1].strip("`").replace("``", "`")


def key_filter(key: Column, keys: KeySet) -> Column:
    """``keys`` as a condition on an index's key column; points become one IN."""
    points = [i.lo for i in keys.intervals if i.is_point]
    found = [key.isin(points)] if points else []
    for i in keys.intervals:
        if not i.is_point:
            both = []
            if i.lo is not None:
                both.append(key >= F.lit(i.lo) if i.lo_in else key > F.lit(i.lo))
            if i.hi is not None:
                both.append(key <= F.lit(i.hi) if i.hi_in else key < F.lit(i.hi))
            found.append(reduce(Column.__and__, both) if both else key.isNotNull())
    if keys.null:
        found.append(key.isNull())
    return reduce(Column.__or__, found) if found else F.lit(False)


class IndexedTable:
    """A table with a filter and a projection, read through its indexes."""

    def __init__(self, engine: Engine, name: str, conditions: tuple = (), columns: tuple = ()):
        self.engine, self.name, self.conditions, self.columns = engine, name, conditions, columns

    def where(self, condition) -> IndexedTable:
        return IndexedTable(self.engine, self.name, (*self.conditions, condition), self.columns)

    def select(self, *columns) -> IndexedTable:
        return IndexedTable(self.engine, self.name, self.conditions, columns)

    def _apply(self, df: DataFrame) -> DataFrame:
        df = reduce(DataFrame.where, self.conditions, df)
        return df.select(*self.columns) if self.columns else df

    def df(self) -> DataFrame:
        engine, base = self.engine, self.engine.spark.table(self.name)
        plain = self._apply(base)
        engine._report = []
        found = scans(plain)
        if len(found) != 1:
            return plain
        source = engine._source(self.name, base, found[0])
        return plain if source is None else self._apply(source)
