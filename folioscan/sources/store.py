"""An index on shared storage: immutable segments and a manifest that is swapped at once.

Records are added as Parquet segments with their postings, lengths and vocabulary. A commit writes what is new, works out
which records its deletions kill and what the vocabulary loses by them, and swaps the manifest. Its cost follows the change: of
what was there before only ids, titles and write numbers are read, and those only if something is deleted. The
vocabularies of the segments add up when they are read; ``optimize`` merges all. The path must be on storage that
driver and executors share: a folder, or anything that Hadoop has a file system for.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.topics import TopicError, checked
from folioscan.operators.index import Index, build_index, in_order, lengths_of, ordered, vocabulary_of
from folioscan.operators.match import LITERAL_TERMS
from folioscan.schema import DOCUMENT, ENGINE_VERSION, FORMAT, META_FILE, SCHEMA_VERSION, STORED, DocumentInput, IndexCompatibility
from folioscan.sources.files import files_at

MANIFEST = "manifest.json"
LOCK = "writer.lock"
#: A writer that is gone gives up its lock so many seconds after it last told that it lives.
LOCK_SECONDS = 600
_EMPTY = {"version": 0, "next_row": 0, "next_seq": 0, "segments": [], "dead": [], "vocabulary": [], "outdated": [], "batch": None}
_KEYS = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("seq", T.LongType())])
_SEGMENT = T.StructType([*STORED.fields, T.StructField("seq", T.LongType())])
_POSTINGS = "term string, row_id long, positions array<int>"


class WriterLocked(RuntimeError):
    """Another engine writes to the index."""


class SchemaMismatch(RuntimeError):
    """The index on disk has another schema than this version works with."""


def _schema_json() -> list[dict]:
    return [{"name": f.name, "type": f.dataType.simpleString(), "indexed": f.name in ("id", "title", "text", "topics", "file_path")} for f in DOCUMENT.fields]


def check_index_compatibility(path: str, spark: SparkSession | None = None) -> IndexCompatibility:
    """Whether this version can work with the index at ``path``, from its metadata alone."""
    files = files_at(path, spark)

    def told(compatible: bool, status: str, version: int | None = None, reason: str | None = None) -> IndexCompatibility:
        return IndexCompatibility(compatible, status, version, SCHEMA_VERSION, ENGINE_VERSION, files.path(META_FILE), reason)

    if not files.exists():
        return told(False, "missing_index", reason="there is no such folder")
    if not files.is_folder():
        return told(False, "invalid_index_path", reason="the path is no folder")
    if files.exists(META_FILE):
        try:
            found = json.loads(files.read(META_FILE))
            form, version = found["format"], int(found["schema_version"])
        except (OSError, ValueError, KeyError, TypeError) as e:
            return told(False, "invalid_metadata", reason=f"the metadata can't be read: {e}")
        if form != FORMAT:
            return told(False, "invalid_format", version, f"the format isn't {FORMAT}")
        if version < SCHEMA_VERSION:
            return told(False, "rebuild_required", version, "the index has an older schema")
        if version > SCHEMA_VERSION:
            return told(False, "engine_too_old", version, "the index has a newer schema")
        return told(True, "compatible", version)
    if not files.exists(MANIFEST):
        return told(False, "missing_metadata", reason="there is neither metadata nor a manifest")
    try:
        fields = json.loads(files.read(MANIFEST))["schema"]
        ids = [f for f in fields if f["name"] == "id"]
    except (OSError, ValueError, KeyError, TypeError) as e:
        return told(False, "invalid_manifest", reason=f"the manifest can't be read: {e}")
    if fields == _schema_json():
        return told(True, "legacy_compatible", SCHEMA_VERSION, "the metadata is missing, but the schema is the current one")
    return told(False, "rebuild_required", 1 if ids and ids[0].get("indexed") is False else None, "the metadata is missing and the schema is another")


@dataclass
class _Op:
    """A write that waits: an added frame, deleted keys, or a clearing."""

    kind: str
    rows: DataFrame | None = None
    field: str = ""
    keys: DataFrame | None = None


@dataclass
class Store:
    spark: SparkSession
    path: str
    lock_seconds: float = LOCK_SECONDS
    _pending: list[_Op] = field(default_factory=list)
    _staged: list[str] = field(default_factory=list)
    _seen: tuple[str, Index] | None = None
    _beat: threading.Event | None = None

    def __post_init__(self) -> None:
        self._files = files_at(self.path, self.spark)
        self._owner = uuid.uuid4().hex
        self._files.make()
        if not self._files.exists(MANIFEST) and not self._files.exists(META_FILE):
            try:
                self._lock()
                self._swap(_EMPTY)
            except WriterLocked:
                pass
        state = check_index_compatibility(self.path, self.spark)
        if not state.compatible and state.status != "missing_metadata":
            raise SchemaMismatch(f"{state.status}: {state.reason}")
        if state.status != "compatible":
            try:
                self._write_meta()
            except OSError:
                pass  # a read-only folder; the index works without

    def _write_meta(self) -> None:
        meta = {"format": FORMAT, "schema_version": SCHEMA_VERSION, "engine_version": ENGINE_VERSION, "created_at_unix_seconds": int(time.time())}
        self._files.replace(META_FILE, json.dumps(meta, indent=2) + "\n")

    # the writer's lock -----------------------------------------------------------------------------------------

    def _holder(self) -> dict:
        """What the lock says; no owner if there is none or it is no lock of ours."""
        try:
            return json.loads(self._files.read(LOCK))
        except (OSError, ValueError):
            return {}

    def _claim(self) -> str:
        return json.dumps({"owner": self._owner, "until": time.time() + self.lock_seconds})

    def _lock(self) -> None:
        """Hold the lock, or raise. The lock of a writer that no longer tells that it lives is taken over."""
        if self._beat is not None:
            if self._holder().get("owner") == self._owner:
                return
            self._stop()
            raise WriterLocked(f"another engine took over the writing to {self.path}")
        if not self._files.create(LOCK, self._claim()):
            held = self._holder()
            if held and held.get("until", 0) > time.time():
                raise WriterLocked(f"another engine writes to {self.path}")
            self._files.delete(LOCK)
            if not self._files.create(LOCK, self._claim()):
                raise WriterLocked(f"another engine writes to {self.path}")
        self._beat = threading.Event()
        threading.Thread(target=self._keep, args=(self._beat,), daemon=True).start()

    def _keep(self, over: threading.Event) -> None:
        while not over.wait(self.lock_seconds / 3):
            try:
                if self._holder().get("owner") != self._owner:
                    return
                self._files.replace(LOCK, self._claim())
            except Exception:  # noqa: BLE001  the session may be ending; without a sign of life the lock runs out
                return

    def _stop(self) -> None:
        if self._beat is not None:
            self._beat.set()
            self._beat = None

    def close(self) -> None:
        """Give up the writer's lock; writes that wait are dropped."""
        self._drop_pending()
        if self._beat is not None:
            self._stop()
            if self._holder().get("owner") == self._owner:
                self._files.delete(LOCK)

    def _drop_pending(self) -> None:
        self._pending = []
        for name in self._staged:
            self._files.delete(name)
        self._staged = []

    # manifest and tables ---------------------------------------------------------------------------------------

    def _manifest(self) -> dict:
        try:
            return _EMPTY | json.loads(self._files.read(MANIFEST))
        except FileNotFoundError:
            return json.loads(json.dumps(_EMPTY))

    def _swap(self, manifest: dict) -> None:
        self._files.replace(MANIFEST, json.dumps(manifest | {"schema": _schema_json()}, indent=1))

    def _read(self, names: Sequence[str], part: str, schema: T.StructType | str) -> DataFrame:
        paths = [f"{self.path}/{n}/{part}" if part else f"{self.path}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _written(self, frame: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.path}/{name}")
        return name

    def _live(self, frame: DataFrame, manifest: dict) -> DataFrame:
        if not manifest["dead"]:
            return frame
        return frame.join(self._read(manifest["dead"], "", "row_id long"), "row_id", "left_anti")

    def _vocabulary(self, manifest: dict) -> DataFrame:
        """Terms and their records: what each segment brought and each deletion took, added up."""
        parts = self._read(manifest["vocabulary"], "", "term string, df long")
        if len(manifest["vocabulary"]) < 2:
            return parts
        return parts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def index(self) -> Index:
        """The index as last committed, by whichever engine."""
        manifest = self._manifest()
        key = str(manifest["version"])
        if self._seen is None or self._seen[0] != key:
            tables = [self._live(self._read(manifest["segments"], part, schema), manifest) for part, schema in (("docs", _SEGMENT), ("postings", _POSTINGS), ("lengths", "row_id long, dl long"))]
            self._seen = key, Index(tables[0].drop("seq"), tables[1].select("term", "row_id", "positions"), self._vocabulary(manifest), tables[2])
        return self._seen[1]

    def segments(self) -> int:
        return len(self._manifest()["segments"])

    def last_batch(self) -> int | None:
        return self._manifest().get("batch")

    # writes ----------------------------------------------------------------------------------------------------

    def _frame(self, docs: Sequence[DocumentInput]) -> DataFrame:
        return self.spark.createDataFrame([d.values() for d in docs], DOCUMENT)

    def _checked(self, docs: Sequence[DocumentInput] | DataFrame) -> list[tuple[DataFrame, Exception | None]]:
        """The records that can be written, and the error of the first that can't."""
        if isinstance(docs, DataFrame):
            frame = docs.select(*[F.col(f.name).cast(f.dataType) for f in DOCUMENT.fields])
            if frame.where(~F.coalesce(F.col("topics").startswith("/"), F.lit(False))).limit(1).count():
                raise TopicError("a topic path starts with a slash")
            return [(frame, None)]
        good: list[DocumentInput] = []
        error = None
        for d in docs:
            try:
                checked(d.topics)
            except TopicError as e:
                error = e
                break
            good.append(d)
        return [(self._frame(good), error)]

    def add(self, docs: Sequence[DocumentInput] | DataFrame) -> None:
        """Add records without looking for duplicates. Of a list, what precedes a bad record stays."""
        self._lock()
        for frame, error in self._checked(docs):
            self._pending.append(_Op("add", rows=frame))
            if error:
                raise error

    def upsert(self, docs: Sequence[DocumentInput] | DataFrame, order: Sequence[str] = ()) -> None:
        """Replace all records with these ids; of a repeated id the last record holds. The deletion of a list's bad record stays.

        Records of a frame are in the order of the columns ``order``, without them in that of its partitions. A frame is
        evaluated once, into a table of its own that goes with the commit.
        """
        self._lock()
        if not isinstance(docs, DataFrame):
            bad = next((i for i, d in enumerate(docs) if not d.topics.startswith("/")), None)
            tried = docs if bad is None else docs[: bad + 1]
            self.delete(id=[d.id for d in tried])
            last = {d.id: d for d in (docs if bad is None else docs[:bad])}
            if bad is not None and docs[bad].id in last:
                del last[docs[bad].id]
            self._pending.append(_Op("add", rows=self._frame(list(last.values()))))
            if bad is not None:
                checked(docs[bad].topics)
            return
        place = F.struct(*order) if order else F.monotonically_increasing_id()
        columns = [F.col(f.name).cast(f.dataType) for f in DOCUMENT.fields]
        self._staged.append(self._written(docs.select(*columns, place.alias("n")), "staged"))
        staged = self.spark.read.parquet(f"{self.path}/{self._staged[-1]}")
        frame = self._checked(staged.drop("n"))[0][0]
        last = staged.groupBy("id").agg(F.max_by(F.struct(*DOCUMENT.fieldNames()), "n").alias("d")).select("d.*")
        self._pending.append(_Op("delete", field="id", keys=frame.select("id").distinct()))
        self._pending.append(_Op("add", rows=last))

    def delete(self, id: Sequence[int] = (), title: Sequence[str] = ()) -> None:
        self._lock()
        for name, values in (("id", id), ("title", title)):
            if values:
                keys = self.spark.createDataFrame([(v,) for v in values], T.StructType([f for f in _KEYS.fields if f.name == name]))
                self._pending.append(_Op("delete", field=name, keys=keys))

    def clear(self) -> None:
        self._lock()
        self._pending.append(_Op("clear"))

    def rollback(self) -> None:
        """Drop the writes since the last commit."""
        self._lock()
        self._drop_pending()

    def _write_segment(self, rows: DataFrame, manifest: dict) -> None:
        """Write records with ids of their own from the manifest's next on, their postings, lengths and vocabulary."""
        name = f"segments/{uuid.uuid4().hex}"
        out = f"{self.path}/{name}"
        rows.write.parquet(f"{out}/docs")
        docs = self._read([name], "docs", _SEGMENT)
        top = docs.agg(F.max("row_id").alias("m")).first().m
        if top is None:
            self._files.delete(name)
            return
        ordered(build_index(docs).postings).write.parquet(f"{out}/postings")
        postings = self._read([name], "postings", _POSTINGS)
        lengths_of(docs, postings).write.parquet(f"{out}/lengths")
        manifest["vocabulary"].append(self._written(in_order(vocabulary_of(postings)), "vocabulary"))
        manifest["segments"].append(name)
        manifest["next_row"] = top + 1

    def _write_dead(self, keys: DataFrame, manifest: dict) -> None:
        """Write which records ``(id, title, seq)`` kill, those written before, and what the vocabulary loses by them."""
        docs = self._read(manifest["segments"], "docs", _SEGMENT)
        killed = []
        for name in ("id", "title"):
            newest = keys.where(F.col(name).isNotNull()).groupBy(name).agg(F.max("seq").alias("until"))
            killed.append(docs.select("row_id", name, "seq").join(newest, name).where(F.col("seq") < F.col("until")).select("row_id"))
        new = self._written(self._live(reduce(DataFrame.unionByName, killed).distinct(), manifest), "dead")
        dead = self._read([new], "", "row_id long")
        few = dead.limit(LITERAL_TERMS + 1).collect()
        if not few:
            self._files.delete(new)
            return
        # the texts of few records are found by their numbers, which lie in order; those of many by a join
        gone = docs.where(F.col("row_id").isin([r.row_id for r in few])) if len(few) <= LITERAL_TERMS else docs.join(dead, "row_id", "left_semi")
        lost = vocabulary_of(build_index(gone.select("row_id", "text")).postings).select("term", (-F.col("df")).alias("df"))
        manifest["vocabulary"].append(self._written(lost, "vocabulary"))
        manifest["dead"].append(new)

    def commit(self, batch: int | None = None) -> None:
        """Make the pending writes visible, all at once."""
        self._lock()
        manifest = self._manifest()
        added: DataFrame | None = None
        deleted: list[DataFrame] = []
        for op in self._pending:
            seq = manifest["next_seq"]
            manifest["next_seq"] += 1
            if op.kind == "clear":
                manifest["outdated"] = self._tables(manifest)
                manifest |= {"segments": [], "dead": [], "vocabulary": []}
                added, deleted = None, []
            elif op.kind == "add":
                rows = op.rows.withColumn("seq", F.lit(seq).cast("long"))
                added = rows if added is None else added.unionByName(rows)
            else:
                columns = [F.col(f.name) if f.name == op.field else F.lit(seq if f.name == "seq" else None).cast(f.dataType).alias(f.name) for f in _KEYS.fields]
                deleted.append(op.keys.select(*columns))
        if added is not None:
            numbered = added.select((F.monotonically_increasing_id() + F.lit(manifest["next_row"])).alias("row_id"), *DOCUMENT.fieldNames(), "seq")
            self._write_segment(numbered, manifest)
        if deleted and manifest["segments"]:
            self._write_dead(reduce(DataFrame.unionByName, deleted), manifest)
        self._finish(manifest, batch)
        self._drop_pending()

    @staticmethod
    def _tables(manifest: dict) -> list[str]:
        return [*manifest["segments"], *manifest["dead"], *manifest["vocabulary"]]

    def _finish(self, manifest: dict, batch: int | None) -> None:
        manifest["version"] += 1
        if batch is not None:
            manifest["batch"] = batch
        self._lock()  # still ours
        self._swap(manifest)

    def optimize(self) -> None:
        """Merge all segments into one without the dead records. With one segment or none nothing happens: what is pending stays.

        The files replaced go at the next call, so engines that still read the version before it don't miss them.
        """
        self._lock()
        if self.segments() <= 1:
            return
        self.commit()
        manifest = self._manifest()
        live = self._live(self._read(manifest["segments"], "docs", _SEGMENT), manifest)
        outdated, top = manifest["outdated"], manifest["next_row"]
        manifest |= {"outdated": self._tables(manifest), "segments": [], "dead": [], "vocabulary": []}
        self._write_segment(live.select(*_SEGMENT.fieldNames()), manifest)
        manifest["next_row"] = max(top, manifest["next_row"])
        self._finish(manifest, None)
        for name in outdated:
            self._files.delete(name)
