"""The six operations on one store, with text answers."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.embedding import Embedder, HashingEmbedder
from recollect.functions.patterns import split_patterns
from recollect.functions.text import SPACE, iso_millis
from recollect.operators import aggregates, listing
from recollect.operators.knn import fetch_count, nearest
from recollect.operators.packing import recall_stats
from recollect.plans import recall as plan
from recollect.plans.ingest import ingest_tree
from recollect.render import hit_line, list_line, recall_header
from recollect.schema import DEFAULT_PROJECT, KIND_CODE, KIND_MANUAL, USER_COLUMNS
from recollect.session import prepare
from recollect.sources.chunker import ChunkOptions
from recollect.sources.store import MemoryStore

_SPACES = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), SPACE)
# The argument ranges of the operations.
LIMITS = {
    "limit": (1, 200),
    "list_limit": (1, 1000),
    "max_tokens": (1, 200_000),
    "min_score": (-1, 1),
    "batch_size": (1, 256),
    "chunk_overlap": (0, None),
}

# Answers by which clients tell what happened.
ANSWERS = {
    "nothing stored": "No memories stored in project '{project}' yet.",
    "nothing found": "No matching memories in project '{project}'{above}.",
    "no such id": "No memory found with id={id} in project '{project}'.",
    "deleted": "Deleted memory (id={id}) from project '{project}'.",
    "nothing listed": "No memories{tagged} in project '{project}'.",
    "no projects": "No memories stored in any project yet.",
}


def project_name(raw: str | None) -> str:
    return re.sub(rf"\A[{_SPACES}]+|[{_SPACES}]+\Z", "", raw or "") or DEFAULT_PROJECT


def tag_list(raw: str | None) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(rf"[,{_SPACES}]+", (raw or "").lower()) if t))


def _checked(name: str, value, bounds: tuple | None = None):
    low, high = bounds or LIMITS.get(name, (1, None))
    if value is not None and (value < low or (high is not None and value > high)):
        raise ValueError(f"{name} must be between {low} and {high or 'any'}: {value}")
    return value


@dataclass
class RecallResult:
    hits: list[dict] = field(default_factory=list)
    candidates: int = 0
    survivors: int = 0
    tokens_used: int = 0
    truncated: int = 0
    embed_ms: int = 0
    search_ms: int = 0


class Engine:
    def __init__(self, spark: SparkSession, home: str, embedder: Embedder | None = None):
        self.spark = prepare(spark)
        self.store = MemoryStore(spark, home)
        self.embedder = embedder or HashingEmbedder()
        self._warm: dict[str, tuple[list[str], DataFrame]] = {}

    # -- vectors kept in executor memory between searches ---------------------------

    def warm(self, project: str | None = None) -> int:
        """Keep a project's ids and vectors cached on the executors; how many there are.

        The cache follows the table: after a change the next search reads the table again.
        """
        name = project_name(project)
        self.cool(name)
        vectors = self.store.rows(name).select("project", "id", "embedding", "content_hash").persist()
        self._warm[name] = (self.store.folders(name), vectors)
        return vectors.count()

    def cool(self, project: str | None = None) -> None:
        _, vectors = self._warm.pop(project_name(project), (None, None))
        if vectors is not None:
            vectors.unpersist()

    def _vectors(self, project: str) -> DataFrame:
        folders, vectors = self._warm.get(project, (None, None))
        if vectors is not None and folders == self.store.folders(project):
            return vectors
        self.cool(project)
        return self.store.rows(project)

    # -- operations -------------------------------------------------------------------

    def remember(self, text: str, tags: str | None = None, project: str | None = None) -> str:
        if not text:
            raise ValueError("text is empty")
        name, labels = project_name(project), tag_list(tags)
        (id,) = self.store.insert([{"text": text, "tags": labels, "project": name, "kind": KIND_MANUAL}], self.embedder)
        tagged = f", tags={','.join(labels)}" if labels else ""
        return f"Remembered (id={id}, project={name}{tagged}): {text}"

    def search(
        self,
        query: str,
        limit: int | None = None,
        project: str | None = None,
        max_tokens: int | None = None,
        min_score: float | None = None,
    ) -> RecallResult:
        """One query. Scores come first; texts are then read for the ids found alone, which reach
        the Parquet scan as a filter. Where the first round, of 400 rows at most, does not answer the
        question, it is asked as in ``recall_many``: only the answer comes to the driver."""
        if not query:
            raise ValueError("query is empty")
        _checked("limit", limit), _checked("max_tokens", max_tokens), _checked("min_score", min_score)
        name, wanted = project_name(project), limit or plan.DEFAULT_LIMIT
        started = time.monotonic()
        vector = self.embedder.encode([query])[0]
        embedded = time.monotonic()
        fetch = fetch_count(wanted, max_tokens is not None)
        found = nearest(self._vectors(name), name, vector, fetch)
        scored = [(id, score) for id, score in found if min_score is None or score >= min_score]
        result = self._answer(name, scored, len(found), wanted, max_tokens)
        full = result.truncated > 0 if max_tokens is not None else result.survivors >= wanted
        if not full and len(found) == fetch and len(scored) == len(found):
            result = self._asked_fully(name, query, wanted, max_tokens, min_score)
        result.embed_ms = round(1000 * (embedded - started))
        result.search_ms = round(1000 * (time.monotonic() - embedded))
        return result

    def _asked_fully(self, name: str, query: str, wanted: int, max_tokens: int | None, min_score: float | None) -> RecallResult:
        asked = self.spark.createDataFrame(
            [(0, name, query, wanted, max_tokens, min_score)],
            "query_id long, project string, query string, limit int, max_tokens long, min_score double",
        )
        answer = plan.recall_all(self.store.rows(name), asked, self.embedder)
        hits = answer.hits.where("chosen").orderBy("rank").collect()  # the limit or the budget bounds them
        counts = recall_stats(answer.hits, answer.queries).first()
        return RecallResult(
            [h.asDict() for h in hits], counts.candidates, counts.survivors, counts.tokens_used, counts.truncated
        )

    def _answer(self, name: str, scored: list[tuple[int, float]], candidates: int, wanted: int, max_tokens: int | None) -> RecallResult:
        if not scored:
            return RecallResult(candidates=candidates)
        ids, scores = zip(*scored)
        hits = self.spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())}))
        rows = self.store.rows(name).where(F.col("id").isin(list(ids))).select(*USER_COLUMNS)
        asked = {"query_id": F.lit(0), "limit": F.lit(wanted), "max_tokens": F.lit(max_tokens).cast("long"), "candidates": F.lit(candidates)}
        # One query is one group: a single exchange brings its rows together.
        found = rows.join(F.broadcast(hits), "id").withColumns(asked).repartition(1)
        packed = plan.survivors(plan.weigh(found)).collect()
        result = RecallResult(candidates=candidates, survivors=len(packed))
        result.hits = [r.asDict() for r in sorted(packed, key=lambda r: r["rank"]) if r.chosen]
        result.tokens_used = sum(h["cost"] for h in result.hits)
        result.truncated = len(packed) - len(result.hits) if max_tokens is not None else 0
        return result

    def recall(
        self,
        query: str,
        limit: int | None = None,
        project: str | None = None,
        max_tokens: int | None = None,
        min_score: float | None = None,
        include_text: bool = True,
    ) -> str:
        name = project_name(project)
        result = self.search(query, limit, name, max_tokens, min_score)
        if not result.candidates:
            return ANSWERS["nothing stored"].format(project=name)
        if not result.hits:
            bar = f" above score={min_score}" if min_score is not None else ""
            return ANSWERS["nothing found"].format(project=name, above=bar)
        header = recall_header(name, len(result.hits), result.tokens_used, max_tokens, result.survivors)
        return "\n".join([header, *(hit_line(h, include_text) for h in result.hits)])

    def _asked_rows(self, queries: DataFrame) -> DataFrame:
        """The rows of the asked projects; no other project's folders are opened."""
        known = self.store.projects()
        asked = queries.select("project").distinct().where(F.col("project").isin(known)).collect() if known else []
        return self.store.rows_of(sorted(r.project for r in asked))

    def recall_many(self, queries: DataFrame) -> DataFrame:
        """Many queries as one job: ``query_id, project, query`` and optionally ``limit,
        max_tokens, min_score``. All survivors; the answer is ``where(chosen)``."""
        return plan.recall(self._asked_rows(queries), queries, self.embedder)

    def recall_many_stats(self, queries: DataFrame) -> DataFrame:
        """A row for every query, also for one that finds nothing."""
        answer = plan.recall_all(self._asked_rows(queries), queries, self.embedder)
        return recall_stats(answer.hits, answer.queries)

    def forget(self, id: int, project: str | None = None) -> str:
        _checked("id", id)
        name = project_name(project)
        if self.store.remove(id, name) is None:
            return ANSWERS["no such id"].format(id=id, project=name)
        return ANSWERS["deleted"].format(id=id, project=name)

    def list_memories(
        self, limit: int | None = None, tag: str | None = None, project: str | None = None, kind: str | None = None, width: int = 200
    ) -> str:
        _checked("limit", limit, LIMITS["list_limit"])
        if kind not in (None, KIND_MANUAL, KIND_CODE):
            raise ValueError(f"unknown kind: {kind}")
        name = project_name(project)
        rows = self.store.rows(name)
        newest = listing.newest_first(rows.select(*USER_COLUMNS), limit or 20, tag, kind)
        found = [r.asDict() for r in newest.withColumn("created_at", iso_millis(F.col("created_at"))).collect()]
        if not found:
            tagged = f" tagged '{tag}'" if tag else ""
            return ANSWERS["nothing listed"].format(tagged=tagged, project=name)
        return "\n".join([f"# {rows.count()} memories in project '{name}'", *(list_line(r, width) for r in found)])

    def ingest_codebase(
        self,
        path: str,
        project: str,
        include: str | None = None,
        exclude: str | None = None,
        respect_gitignore: bool = True,
        max_file_bytes: int | None = None,
        max_files: int | None = None,
        chunk_lines: int | None = None,
        chunk_overlap: int | None = None,
        dry_run: bool = False,
        path_prefix: str | None = None,
        batch_size: int | None = None,
    ) -> str:
        """``batch_size``: texts that the model gets at once, where the embedder has a model."""
        if not path or not project:
            raise ValueError("path and project are required")
        for name, value in [
            ("max_file_bytes", max_file_bytes), ("max_files", max_files), ("chunk_lines", chunk_lines), ("chunk_overlap", chunk_overlap),
            ("batch_size", batch_size),
        ]:
            _checked(name, value)
        embedder = self.embedder
        if batch_size is not None and hasattr(embedder, "batch_size"):
            embedder = replace(embedder, batch_size=batch_size)
        summary = ingest_tree(
            self.store,
            project_name(project),
            path,
            embedder,
            include=split_patterns(include),
            exclude=split_patterns(exclude),
            respect_gitignore=respect_gitignore,
            max_file_bytes=max_file_bytes,
            max_files=max_files,
            options=ChunkOptions.of(window=chunk_lines, overlap=chunk_overlap),
            dry_run=dry_run,
            path_prefix=path_prefix,
        )
        return json.dumps(summary, indent=2)

    def list_projects(self) -> str:
        vectors = F.count_if(F.size("embedding") > 0).alias("indexed")
        counts = self.store.all_rows().groupBy("project").agg(F.count("*").alias("n"), vectors).orderBy("project").collect()
        if not counts:
            return ANSWERS["no projects"]
        return "\n".join(f"{r.project}: {r.n} memories ({r.indexed} indexed)" for r in counts)

    def index_stats(self, project: str | None = None) -> dict:
        """Searchable rows, their fingerprint, and the bytes of the project's folders."""
        name = project_name(project)
        rows = self.store.rows(name)
        digest = aggregates.id_digest(rows.select("project", "id")).first()
        return {"live": rows.count(), "digest": digest.digest if digest else None, "bytes": self.store.bytes(name)}
