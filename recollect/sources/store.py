"""The memories table: versioned Parquet folders per project, and a manifest.

A project's rows live in buckets by file path. Rows are added as new folders; a
delete or update rewrites only the buckets it touches. A commit publishes the next
manifest, so readers always see one complete version. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from functools import reduce
from urllib.parse import quote

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.embedding import Embedder, embed
from recollect.operators.numbering import number_rows
from recollect.schema import DEFAULT_PROJECT, MEMORIES, SCHEMA_VERSION, USER_COLUMNS
from recollect.session import Scratch, broadcast_if_small
from recollect.sources.hadoop import ControlFiles

#: A bucket with this many folders is rewritten into one by the next commit that touches it.
FOLDERS_PER_BUCKET = 16
#: A project gets a bucket per this many rows, so that a small change rewrites little
#: and a small project stays one folder. It is dealt out anew when it has outgrown
#: its buckets fourfold.
ROWS_PER_BUCKET = 250_000
REGROW = 4
#: Manifests kept for inspection, attempts after another writer's commit, and the hours for which
#: vacuum leaves a folder alone that no version names (yet).
KEPT_MANIFESTS, RETRIES, GRACE_HOURS = 20, 5, 24


def project_slug(project: str) -> str:
    """A path segment per project; different projects never share one."""
    return quote(project, safe="-_").replace(".", "%2E").replace("~", "%7E").replace("%", "~")


class ConcurrentCommit(RuntimeError):
    """Another writer published first."""


class MemoryStore:
    def __init__(self, spark: SparkSession, home: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark = spark
        self.home = home.rstrip("/")
        self.files = ControlFiles(spark, home)
        self._rows_per_bucket = rows_per_bucket
        self._manifest = self._load()

    # -- manifest -----------------------------------------------------------

    def _load(self) -> dict:
        versions = [n for n in self.files.names("manifest") if n.endswith(".json") and not n.startswith((".", "_"))]
        if versions:
            return json.loads(self.files.read(f"manifest/{versions[-1]}"))
        return {"version": 0, "next_id": 1, "meta": {"schema_version": str(SCHEMA_VERSION)}, "projects": {}}

    def reload(self) -> None:
        """Go on from the newest version, whoever wrote it."""
        self._manifest = self._load()

    def _publish(self, manifest: dict) -> None:
        manifest["version"] = self._manifest["version"] + 1
        if not self.files.publish(f"manifest/{manifest['version']:012d}.json", json.dumps(manifest, ensure_ascii=False)):
            # The handle is usable again: what comes next is planned on the newest version.
            self.reload()
            raise ConcurrentCommit(f"version {manifest['version']} exists")
        self._manifest = manifest
        self._prune()

    def _prune(self) -> None:
        """Keep the newest manifests; a reader loads only the last one."""
        versions = [n for n in self.files.names("manifest") if n.endswith(".json")]
        for old in versions[:-KEPT_MANIFESTS]:
            self.files.drop(f"manifest/{old}")
            self.files.drop(f"manifest/{old}.claim")

    def _retried(self, commit):
        """``commit`` planned and written anew after another writer came first."""
        for _ in range(RETRIES):
            try:
                return commit()
            except ConcurrentCommit:
                continue
        return commit()

    def _draft(self) -> dict:
        return json.loads(json.dumps(self._manifest))

    def get_meta(self, key: str) -> str | None:
        return self._manifest["meta"].get(key)

    def set_meta(self, key: str, value: str) -> None:
        draft = self._draft()
        draft["meta"][key] = value
        self._publish(draft)

    # -- reading ------------------------------------------------------------

    def folders(self, project: str, buckets: set[int] | None = None) -> list[str]:
        entry = self._entry(project)
        base = f"{self.home}/memories/{project_slug(project)}"
        return [
            f"{base}/{folder}/bucket={bucket}"
            for bucket, folders in entry["buckets"].items()
            if buckets is None or int(bucket) in buckets
            for folder in folders
        ]

    def _scan(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], MEMORIES)
        return self.spark.read.schema(MEMORIES).parquet(*folders)

    def rows(self, project: str) -> DataFrame:
        """All columns of one project; other projects' folders are not touched."""
        return self._scan(self.folders(project))

    def rows_of(self, projects: list[str]) -> DataFrame:
        return self._scan([f for p in projects for f in self.folders(p)])

    def all_rows(self) -> DataFrame:
        return self.rows_of(list(self._manifest["projects"]))

    def projects(self) -> list[str]:
        return sorted(p for p in self._manifest["projects"] if self.folders(p))

    def bytes(self, project: str) -> int:
        """The size of the project's live folders."""
        base = f"memories/{project_slug(project)}"
        entry = self._entry(project)
        return sum(
            self.files.bytes_under(f"{base}/{folder}/bucket={bucket}")
            for bucket, folders in entry["buckets"].items()
            for folder in folders
        )

    # -- writing ------------------------------------------------------------

    def _entry(self, project: str) -> dict:
        return self._manifest["projects"].get(project, {"count": 0, "added": 0, "buckets": {}})

    def _bucket(self, count: int) -> Column:
        key = F.coalesce(F.col("file_path"), F.col("id").cast("string"))
        return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")

    def _bucket_count(self, project: str, n_new: int) -> int:
        """Buckets for the next version: as before, or more once they are outgrown."""
        entry = self._entry(project)
        wanted = max(1, -(-(entry["added"] + n_new) // self._rows_per_bucket))
        return wanted if wanted > REGROW * entry["count"] or not entry["count"] else entry["count"]

    def _write_folder(self, project: str, rows: DataFrame, count: int) -> tuple[str, list[int]]:
        """Write ``rows`` as a new folder that no version names yet; its name and its buckets."""
        folder = f"v{self._manifest['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        base = f"memories/{project_slug(project)}"
        (
            rows.select(*MEMORIES.fieldNames())
            .withColumn("bucket", self._bucket(count))
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "id")
            .write.partitionBy("bucket")
            .parquet(f"{self.home}/{base}/{folder}")
        )
        names = self.files.names(f"{base}/{folder}")
        return folder, sorted(int(name.split("=")[1]) for name in names if name.startswith("bucket="))

    def _adopt(self, draft: dict, project: str, written: tuple[str, list[int]], replaced: set[int], count: int, n_new: int) -> None:
        """Enter a written folder into ``draft``; ``replaced`` buckets keep nothing older."""
        folder, buckets = written
        entry = draft["projects"].setdefault(project, self._entry(project))
        entry["count"], entry["added"] = count, entry["added"] + n_new
        for bucket in replaced:
            entry["buckets"].pop(str(bucket), None)
        for bucket in buckets:
            entry["buckets"].setdefault(str(bucket), []).append(folder)

    def _write(self, project: str, rows: DataFrame, replaced: set[int], count: int, n_new: int, next_id: int) -> None:
        draft = self._draft()
        self._adopt(draft, project, self._write_folder(project, rows, count), replaced, count, n_new)
        draft["next_id"] = next_id
        self._publish(draft)

    def insert(self, rows: list[dict], embedder: Embedder) -> list[int]:
        """A few hand-written rows, each into its own project, as one commit; ids follow the list."""
        return self._retried(lambda: self._insert(rows, embedder))

    def _insert(self, rows: list[dict], embedder: Embedder) -> list[int]:
        now, first = _now(), self._manifest["next_id"]
        vectors = embedder.encode([row["text"] for row in rows])
        full = [
            {
                "kind": "manual",
                "tags": [],
                **row,
                "project": row.get("project") or DEFAULT_PROJECT,
                "id": first + i,
                "embedding": vector.tolist(),
                "created_at": now,
                "updated_at": now,
            }
            for i, (row, vector) in enumerate(zip(rows, vectors))
        ]
        groups: dict[str, list[tuple]] = {}
        for row in full:
            groups.setdefault(row["project"], []).append(tuple(row.get(name) for name in MEMORIES.fieldNames()))
        draft = self._draft()
        for project, tuples in groups.items():
            count = self._entry(project)["count"] or 1
            written = self._write_folder(project, self.spark.createDataFrame(tuples, MEMORIES), count)
            self._adopt(draft, project, written, set(), count, len(tuples))
        draft["next_id"] = first + len(rows)
        self._publish(draft)
        return [row["id"] for row in full]

    def insert_many(self, rows: DataFrame, embedder: Embedder) -> int:
        """Bulk insert of ``text`` and optionally ``project, kind, tags`` and the other columns of
        the table, each row into its own project, as one commit; how many there were.

        Ids follow project and text. Numbering and embedding are spread over the tasks.
        """
        return self._retried(lambda: self._insert_many(rows, embedder))

    def _insert_many(self, rows: DataFrame, embedder: Embedder) -> int:
        given = {f.name: f.dataType for f in MEMORIES.fields}
        optional = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast(given[name])
        blank = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
        filled = {
            "text": F.col("text"),
            "project": F.coalesce(blank(optional("project")), F.lit(DEFAULT_PROJECT)),
            "kind": F.coalesce(optional("kind"), F.lit("manual")),
            "tags": F.coalesce(optional("tags"), F.array().cast("array<string>")),
            **{c: optional(c) for c in ("file_path", "line_start", "line_end", "content_hash")},
        }
        now = F.lit(_now())
        with Scratch(self.spark) as scratch:
            named = rows.select(*[column.alias(name) for name, column in filled.items()])
            numbered, n = number_rows(named, [F.col("project"), F.col("text")], "id", self._manifest["next_id"], scratch)
            full = numbered.withColumns({"embedding": embed(F.col("text"), embedder), "created_at": now, "updated_at": now})
            full = scratch.keep(full.select(*MEMORIES.fieldNames()))  # in order of project already
            draft = self._draft()
            self._adopt_all(draft, full)
            draft["next_id"] += n
            self._publish(draft)
            return n

    def _adopt_all(self, draft: dict, rows: DataFrame) -> None:
        """Complete rows, kept in order of project, entered project by project."""
        sizes = {r.project: r.n for r in rows.groupBy("project").agg(F.count("*").alias("n")).collect()}
        counts = {p: self._bucket_count(p, n) for p, n in sizes.items()}
        for project in sizes:  # a project that outgrew its buckets is dealt out anew
            entry = self._entry(project)
            replaced = set(map(int, entry["buckets"])) if counts[project] != entry["count"] else set()
            own = rows.where(F.col("project") == project)
            if replaced:
                own = own.unionByName(self.rows(project).select(*own.columns))
            self._adopt(draft, project, self._write_folder(project, own, counts[project]), replaced, counts[project], sizes[project])

    def apply(
        self,
        project: str,
        inserts: DataFrame | None = None,
        updates: DataFrame | None = None,
        deletes: DataFrame | None = None,
        embedder: Embedder | None = None,
        scratch: Scratch | None = None,
        spent: Accumulator | None = None,
    ) -> int:
        """One commit of new rows, moved line ranges and deletions; returns the rows inserted.
        ``spent`` adds up the milliseconds of embedding.

        ``inserts``: the table's columns but for ``id, project, embedding`` and the
        timestamps, plus ``embed_text``, ``ordinal``. ``updates``: ``id, file_path,
        line_start, line_end``. ``deletes``: ``id, file_path``.
        """
        now = F.lit(_now())
        old_count = self._entry(project)["count"]
        fresh, n_new = None, 0
        if inserts is not None:
            order = [F.col(c) for c in ("file_path", "line_start", "ordinal")]
            fresh, n_new = number_rows(inserts, order, "id", self._manifest["next_id"], scratch)
        count = self._bucket_count(project, n_new)
        if count != old_count:
            replaced = {int(b) for b in self._entry(project)["buckets"]}
        else:
            changed = [d for d in (updates, deletes) if d is not None]
            replaced = {b for d in changed for b in self._buckets_of(d, count)}
            replaced |= self._crowded(project) & self._buckets_of(fresh, count) if n_new else set()
        parts = []
        if n_new:
            # Embedding comes after the exchange, so it runs once per row.
            columns = {"embedding": embed(F.col("embed_text"), embedder, spent), "project": F.lit(project)}
            parts.append(fresh.withColumns({**columns, "created_at": now, "updated_at": now}))
        if replaced:
            kept = self._scan(self.folders(project, replaced))
            if deletes is not None:
                kept = without_ids(kept, broadcast_if_small(deletes.select("id")))
            if updates is not None:
                kept = with_ranges(kept, broadcast_if_small(updates.select("id", "line_start", "line_end")), now)
            parts.append(kept)
        if parts:
            rows = reduce(DataFrame.unionByName, [p.select(*MEMORIES.fieldNames()) for p in parts])
            self._write(project, rows, replaced, count, n_new, self._manifest["next_id"] + n_new)
        return n_new

    def _buckets_of(self, rows: DataFrame, count: int) -> set[int]:
        """Which buckets ``rows`` fall into; at most one value per bucket comes back."""
        return {r.b for r in rows.select(self._bucket(count).alias("b")).distinct().collect()}

    def _crowded(self, project: str) -> set[int]:
        buckets = self._entry(project)["buckets"]
        return {int(b) for b, folders in buckets.items() if len(folders) >= FOLDERS_PER_BUCKET}

    def remove(self, id: int, project: str) -> dict | None:
        """Delete one row of one project; the row, or None where it is not there."""
        found = self.rows(project).where(F.col("id") == id).select(*USER_COLUMNS)
        row = next(iter(found.take(1)), None)
        if row is None:
            return None
        self.apply(project, deletes=self.spark.createDataFrame([(id, row.file_path)], "id long, file_path string"))
        return row.asDict()

    def remove_many(self, ids: DataFrame, project: str) -> int:
        """Delete the rows of ``project`` whose ``id`` is listed; how many there were."""
        doomed = self.rows(project).select("id", "file_path").join(ids.select("id").distinct(), "id", "left_semi")
        n = doomed.count()
        if n:
            self.apply(project, deletes=doomed)
        return n

    def clear_project(self, project: str) -> DataFrame:
        """Drop a project; the ids it held, still readable until ``vacuum``."""
        ids = self.rows(project).select("id")
        draft = self._draft()
        draft["projects"].pop(project, None)
        self._publish(draft)
        return ids

    def load(self, rows: DataFrame, next_id: int, meta: dict[str, str]) -> None:
        """Adopt complete rows with their ids, and ``meta``, as one commit (migration)."""
        with Scratch(self.spark) as scratch:
            # In order of project, so that the scan for each reads its own part of the files.
            dealt = rows.select(*MEMORIES.fieldNames()).repartitionByRange("project", "id")
            kept = scratch.keep(dealt.sortWithinPartitions("project", "id"))
            draft = self._draft()
            self._adopt_all(draft, kept)
            draft["next_id"] = max(next_id, draft["next_id"])
            draft["meta"].update(meta)
            self._publish(draft)

    def vacuum(self, grace_hours: float = GRACE_HOURS) -> int:
        """Delete data folders that the newest version does not use and that are older than the
        grace period, within which another writer may be about to publish them."""
        self.reload()
        removed = 0
        for slug in self.files.names("memories"):
            live = {
                folder
                for project, entry in self._manifest["projects"].items()
                if project_slug(project) == slug
                for folders in entry["buckets"].values()
                for folder in folders
            }
            for folder in self.files.names(f"memories/{slug}"):
                if folder not in live and self.files.age_hours(f"memories/{slug}/{folder}") >= grace_hours:
                    removed += self.files.drop(f"memories/{slug}/{folder}")
        return removed


def _now() -> dt.datetime:
    now = dt.datetime.now(dt.timezone.utc)
    return now.replace(microsecond=now.microsecond // 1000 * 1000)


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "id", "left_anti")


def with_ranges(rows: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Rows with new line ranges where ``updates(id, line_start, line_end)`` has one.

    Text and vector stay as they are.
    """
    new, old = updates.alias("new"), rows.alias("old")
    moved = F.col("new.id").isNotNull()
    changed = {
        "line_start": F.coalesce("new.line_start", "old.line_start"),
        "line_end": F.coalesce("new.line_end", "old.line_end"),
        "updated_at": F.when(moved, now).otherwise(F.col("old.updated_at")),
    }
    columns = [changed.get(c, F.col(f"old.{c}")).alias(c) for c in rows.columns]
    return old.join(new, F.col("old.id") == F.col("new.id"), "left").select(*columns)
