"""The registered queries. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.catalog import views as V
from recollect.functions import text as X
from recollect.functions.patterns import path_filter
from recollect.functions.vectors import decode_float32, dot, encode_float32
from recollect.operators import aggregates, cells, diff, listing, overlap
from recollect.operators.dedup import SIMILARITY, greedy_dedup
from recollect.operators.independent import greedy_dedup_spread
from recollect.operators.knn import top_k
from recollect.operators.numbering import first_rows, number_rows
from recollect.operators.packing import pack_long, recall_stats
from recollect.operators.similarity import similar_rows
from recollect.plans import recall as R
from recollect.plans.ingest import stored_chunks
from recollect.session import Scratch, spread
from recollect.sources import legacy
from recollect.sources.chunker import chunk_code_files, chunk_text_files
from recollect.sources.ignore import ignored_paths as judge_paths
from recollect.sources.ignore import rule_table
from recollect.sources.store import with_ranges, without_ids
from recollect.sources.walk import looks_binary

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- reads ------------------------------------------------------------------


@query
def list_newest(spark, sf):
    rows = V.table(spark, sf, "events").select(
        C("event_id").alias("id"), C("ts").alias("created_at"), F.array("event_type").alias("tags"), C("value")
    )
    return listing.newest_first(rows, 20, tag=" Click ").select("id", X.iso_millis(C("created_at")).alias("created_at"), "value")


@query
def list_third_page(spark, sf):
    """Pages of 50 events by key: the third, found from the last rows of those before."""
    rows = V.table(spark, sf, "events").select(C("event_id").alias("id"), C("ts").alias("created_at"), "event_type")
    after = None
    for _ in range(2):
        last = listing.newest_first(rows, 50, after=after).orderBy("created_at", "id").first()
        after = (last.created_at, last.id)
    return listing.newest_first(rows, 50, after=after).select("id", X.iso_millis(C("created_at")).alias("created_at"), "event_type")


@query
def point_get(spark, sf):
    return V.notes(spark, sf).where((C("project") == "src3") & (C("id") == 23)).select("id", "project", "content_hash")


@query
def get_by_ids(spark, sf):
    wanted = V.table(spark, sf, "benchmark").select(C("item_id").alias("pos"), (C("item_id") * 37).alias("id"))
    return listing.by_ids(V.notes(spark, sf).drop("tags"), wanted).select("pos", "id", "project", "kind", "content_hash")


@query
def ids_for_project(spark, sf):
    return V.notes(spark, sf).where(C("project") == "src5").select("id").orderBy("id")


@query
def vectors_for_project(spark, sf):
    rows = V.vectors(spark, sf).where(C("project") == "2")
    return rows.select("id", F.size("embedding").alias("dim"), F.round(dot(C("embedding"), C("embedding")), 5).alias("norm"))


@query
def chunks_for_file(spark, sf):
    return stored_chunks(V.turns(spark, sf)).where(C("file_path") == "conv/7")


@query
def ingested_files(spark, sf):
    return stored_chunks(V.turns(spark, sf)).select("file_path").distinct()


@query
def file_gate(spark, sf):
    """A size limit and the test for binary content over raw pages; every tenth page is repeated to
    more than half a megabyte, every seventh ends in a NUL."""
    number, html = C("page_id"), C("html")
    long = F.when(number % 10 == 3, F.repeat(html, F.ceil(600_000 / F.greatest(F.length(html), F.lit(1))).cast("int"))).otherwise(html)
    raw = F.when(number % 7 == 2, F.concat(long, F.lit("\0"))).otherwise(long).cast("binary")
    return V.table(spark, sf, "pages").select(
        "page_id",
        F.octet_length(raw).cast("long").alias("size"),
        (F.octet_length(raw) > 524_288).alias("too_large"),
        looks_binary(raw).alias("binary"),
    )


@query
def path_patterns(spark, sf):
    path = F.regexp_extract("url", r"^https?://(.*)$", 1)
    keep = path_filter(path, include=["*.example.*/e?/**", "ththth"], exclude=["**#top", "page=2"])
    return V.table(spark, sf, "pages").select("page_id", keep.alias("keep"))


#: Ignore files of a site map: rules of the root, of a domain's folder and of a language's below it.
IGNORE_FILES = [
    ("", "spam-farm.*\n*#top\n/*.net/fr/\n[0-4]*.html\n!m.*.net/**/*#top\n"),
    ("blog.ththan.example.net", "*\n!en/\n!en/?[0-5]*\n"),
    ("ththin.example.com/en", "# one page\n6??*\n!671?utm_source=feed\n"),
]


@query
def ignored_paths(spark, sf):
    """Page addresses as files, judged by ignore rules of several folders."""
    paths = V.table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://(.*)$", 1).alias("rel_path"))
    rules = rule_table(spark.createDataFrame(IGNORE_FILES, "base string, content string"))
    return judge_paths(paths, rules)


@query
def first_files(spark, sf):
    """The walk's file cap: the first rows by path."""
    paths = V.page_files(spark, sf).select("rel_path")
    return first_rows(paths, [C("rel_path")], 100)


# -- writes as transformations ---------------------------------------------------


@query
def assign_ids(spark, sf):
    numbered, _ = number_rows(V.notes(spark, sf).select("project", C("id").alias("seq")), [C("project"), C("seq")], "id", 1000)
    return numbered.select("id", "project", "seq")


@query
def remove_many(spark, sf):
    toxic = V.table(spark, sf, "labels").where(C("toxic") == 1).select(C("doc_id").alias("id"))
    return without_ids(V.notes(spark, sf).select("id", "project"), toxic)


@query
def update_ranges(spark, sf):
    rows = V.turns(spark, sf).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    moves = rows.where(F.array_contains("tags", "assistant")).select(
        "id", (C("line_start") + 3).alias("line_start"), (C("line_end") + 3).alias("line_end")
    )
    moved = with_ranges(rows, moves, F.lit("2024-02-02").cast("timestamp"))
    return moved.select("id", "file_path", "line_start", "line_end", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query
def migrate_v1(spark, sf):
    old = V.table(spark, sf, "documents").select(
        C("doc_id").alias("id"),
        "text",
        F.concat(F.lit('["'), C("lang"), F.lit('", "'), C("source"), F.lit('"]')).alias("tags"),
        encode_float32(F.array(F.lit(0.5).cast("float"), C("n_chars").cast("float"))).alias("embedding"),
        F.lit("2024-05-06T07:08:09.123Z").alias("created_at"),
    )
    new = legacy.upgrade(old)
    return new.select(
        "id",
        "project",
        "kind",
        F.array_join("tags", "|").alias("tags"),
        X.content_hash(C("text")).alias("text_hash"),
        C("embedding")[1].cast("double").alias("second"),
        X.iso_millis(C("created_at")).alias("created_at"),
        (C("updated_at") == C("created_at")).alias("same_time"),
    )


@query
def decode_tags(spark, sf):
    raw = F.when(C("lang") == "en", F.concat(F.lit('["'), C("source"), F.lit('", 1, null, ["x"], "b"]'))).otherwise(
        F.concat(F.lit('{"a": "'), C("lang"))
    )
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(legacy.decode_tags(raw), "|").alias("tags"))


# -- aggregates -----------------------------------------------------------------


@query
def count_all(spark, sf):
    return V.notes(spark, sf).agg(F.count("*").alias("n"))


@query
def count_project(spark, sf):
    return V.notes(spark, sf).where(C("project") == "src7").agg(F.count("*").alias("n"))


@query
def project_counts(spark, sf):
    return aggregates.project_counts(V.notes(spark, sf))


@query
def distinct_projects(spark, sf):
    return V.notes(spark, sf).select("project").distinct().orderBy("project")


@query
def max_id(spark, sf):
    return V.notes(spark, sf).agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))


@query
def project_sizes(spark, sf):
    """Rows per project beside indexed vectors per project, 0 where there are none."""
    indexed = V.vectors(spark, sf).groupBy(F.concat(F.lit("src"), C("project")).alias("project")).agg(F.count("*").alias("indexed"))
    counts = V.notes(spark, sf).groupBy("project").agg(F.count("*").alias("count"))
    return counts.join(indexed, "project", "left").select("project", "count", F.coalesce("indexed", F.lit(0)).alias("indexed"))


@query
def index_digest(spark, sf):
    """Ids are spread out, so that all levels of the tree are formed."""
    return aggregates.id_digest(V.notes(spark, sf).withColumn("id", C("id") * 97))


@query
def value_percentiles(spark, sf):
    return aggregates.nearest_rank(V.table(spark, sf, "events"), "event_type", "value", [50, 95, 99])


@query
def exact_duplicates(spark, sf):
    return aggregates.exact_duplicates(V.notes(spark, sf))


# -- scalar functions -------------------------------------------------------------


@query
def estimate_tokens(spark, sf):
    return V.documents(spark, sf).select(
        "doc_id",
        X.utf16_length(C("text")).alias("units"),
        X.word_count(C("text")).alias("words"),
        X.estimate_tokens(C("text")).alias("tokens"),
    )


@query
def content_hashes(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", X.content_hash(C("text")).alias("content_hash"))


@query
def hit_costs(spark, sf):
    columns = [C(c) for c in ["id", "kind", "file_path", "line_start", "line_end"]]
    rows = V.notes(spark, sf, True).unionByName(V.turns(spark, sf))
    return rows.select("id", X.hit_header(*columns).alias("header"), X.hit_cost(*columns, C("text")).alias("cost"))


@query
def parse_tags(spark, sf):
    raw = F.concat_ws(", ", F.upper("lang"), C("source"), C("lang"), F.lit(" ,\t"), F.substring_index("text", "\n", 1))
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(X.parse_tags(raw), "|").alias("tags"))


@query
def normalize_project(spark, sf):
    raw = F.when(C("lang") == "en", F.concat(F.lit("\t\ufeff "), C("source"), F.lit("  \n"))).when(C("lang") == "fr", F.lit(" \t "))
    return V.table(spark, sf, "documents").select("doc_id", X.normalize_project(raw).alias("project"))


@query
def detect_language(spark, sf):
    """File names derived from page addresses."""
    names = V.table(spark, sf, "pages").select(
        "page_id", F.explode(F.array(*[F.concat("url", F.lit(e)) for e in ["", ".go", ".TSX", ".pyi", ".mjs", ".md", "."]])).alias("path")
    )
    return names.select("page_id", "path", X.detect_language(C("path")).alias("lang"))


@query
def normalize_newlines(spark, sf):
    mixed = F.regexp_replace(F.regexp_replace("text", r"\. ", ".\r"), "\n", "\r\n")
    return V.documents(spark, sf).select("doc_id", X.content_hash(X.normalize_newlines(mixed)).alias("hash"))


@query
def embed_texts(spark, sf):
    text = X.embed_text(C("file_path"), C("line_start"), C("line_end"), C("tags")[0], F.nullif(C("tags")[0], F.lit("user")), C("text"))
    windows = F.transform(X.windows(text, 300), lambda w: F.sha2(w, 256))
    return V.turns(spark, sf).select(
        "id", X.content_hash(text).alias("hash"), X.content_hash(X.clip(text, 1200)).alias("clip_hash"),
        F.size(windows).alias("windows"), F.sha2(F.array_join(windows, ","), 256).alias("windows_hash"),
    )


@query
def shingle_counts(spark, sf):
    return V.documents(spark, sf).select("doc_id", F.size(X.shingles(C("text"))).alias("shingles"))


@query
def neighbour_jaccard(spark, sf):
    """Word-shingle similarity of each turn to the next."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = V.table(spark, sf, "conversations").withColumn("following", F.lead("text").over(by_turn)).where("following IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(X.jaccard(X.shingles(C("text")), X.shingles(C("following"))), 9).alias("similarity"))


@query
def cosine_to_next(spark, sf):
    following = V.vectors(spark, sf).select((C("id") - 1).alias("id"), C("embedding").alias("next"))
    pairs = V.vectors(spark, sf).join(following, "id")
    return pairs.select("id", F.round(dot(C("embedding"), C("next")), 6).alias("score"))


@query
def vector_codec(spark, sf):
    """float32 vectors to bytes and back."""
    blob = encode_float32(C("embedding"))
    back = decode_float32(blob)
    return V.vectors(spark, sf).select("id", F.octet_length(blob).alias("bytes"), F.round(dot(back, C("embedding")), 5).alias("norm"))


@query
def hash_embedding(spark, sf):
    """A fingerprint of each note's vector: occupied dimensions and a weighted sum."""
    places = F.transform(
        "embedding", lambda v, i: F.round(v.cast("double") * 1000000).cast("long") * (i + 1)
    )
    rows = V.embedded(V.notes(spark, sf, True))
    return rows.select(
        "id",
        F.size(F.filter("embedding", lambda v: v != 0)).alias("occupied"),
        F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x).alias("weighted"),
    )


# -- search -----------------------------------------------------------------------


def _asked_vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All vectors as one namespace, and every twentieth of them as a question."""
    everything = V.vectors(spark, sf).withColumn("project", F.lit("all"))
    return everything, everything.where(C("id") % 20 == 0).select(C("id").alias("query_id"), "project", "embedding")


@query
def knn_top_k(spark, sf):
    """The ten nearest vectors, themselves included, to every vector whose id 20 divides."""
    everything, asked = _asked_vectors(spark, sf)
    found = top_k(spread(everything, "id"), asked.withColumn("fetch_k", F.lit(10)))
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query
def knn_cells(spark, sf):
    """The same questions for five vectors with a score of 0.9 or more, by cells that can hold such."""
    everything, asked = _asked_vectors(spark, sf)
    scratch = Scratch(spark)
    found = cells.search(cells.build(everything, scratch), asked.withColumns({"fetch_k": F.lit(5), "min_score": F.lit(0.9)}), scratch)
    return found.hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _every_vector(spark, sf, k: int) -> DataFrame:
    rows = V.vectors(spark, sf)
    return rows.select(C("id").alias("query_id"), "project", "embedding", F.lit(k).alias("fetch_k"))


@query
def knn_per_project(spark, sf):
    """For every vector its five nearest within its project."""
    found = top_k(spread(V.vectors(spark, sf), "id"), _every_vector(spark, sf, 5))
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query
def knn_min_score(spark, sf):
    """As above, twelve nearest, then only scores from 0.3 on; candidates counted before."""
    found = top_k(spread(V.vectors(spark, sf), "id"), _every_vector(spark, sf, 12))
    return found.where(C("score") >= 0.3).select("query_id", "id", "candidates", F.round("score", 6).alias("score"))


def _memories(rows: DataFrame) -> DataFrame:
    """``rows`` with vectors, kept: rounds of a search read what is stored, they don't embed anew."""
    return Scratch(rows.sparkSession).keep(V.embedded(rows))


def _note_recall(spark, sf, **options) -> DataFrame:
    asked = V.questions(spark, sf).withColumn("project", F.concat(F.lit("src"), (C("query_id") % 20).cast("string")))
    for name, value in options.items():
        asked = asked.withColumn(name, F.lit(value))
    return R.recall(_memories(V.notes(spark, sf, True)), asked, V.EMBEDDER)


def _turn_recall(spark, sf, **options) -> DataFrame:
    asked = V.questions(spark, sf).withColumn("project", F.lit("talk"))
    for name, value in options.items():
        asked = asked.withColumn(name, F.lit(value))
    return R.recall(_memories(V.turns(spark, sf, True)), asked, V.EMBEDDER)


@query
def recall_notes(spark, sf):
    """Every benchmark text asked in its project with a budget of 2,000 tokens."""
    return _note_recall(spark, sf, max_tokens=2000).where("chosen").select("query_id", "rank", "id", "score", "cost", "running_tokens")


@query
def recall_notes_stats(spark, sf):
    """A row for every query, also where nothing scores enough or the project does not exist."""
    asked = V.questions(spark, sf)
    number = C("query_id")
    project = F.when(number % 5 == 4, "nowhere").otherwise(F.concat(F.lit("src"), (number % 20).cast("string")))
    score = F.when(number % 5 == 3, 0.99).otherwise(-1.0)
    asked = asked.withColumns({"project": project, "min_score": score, "max_tokens": F.lit(2000)})
    answer = R.recall_all(_memories(V.notes(spark, sf, True)), asked, V.EMBEDDER)
    return recall_stats(answer.hits, answer.queries).drop("project")


@query
def recall_copies(spark, sf):
    """One text has more copies than the first round fetches; twenty different texts are asked for."""
    notes = V.notes(spark, sf, True).withColumn("project", F.lit("all"))
    first = notes.select(F.min_by("text", "id").alias("text"), F.min_by("content_hash", "id").alias("content_hash"))
    copies = notes.drop("text", "content_hash").withColumn("id", C("id") + 10_000_000).join(F.broadcast(first))
    memories = _memories(notes.unionByName(copies))
    asked = first.select(F.lit(0).alias("query_id"), F.lit("all").alias("project"), C("text").alias("query"), F.lit(20).alias("limit"))
    return R.recall(memories, asked, V.EMBEDDER).where("chosen").select("query_id", "rank", "id", "score", "cost")


@query
def recall_same_id(spark, sf):
    """Each query_id in two projects: two questions."""
    asked = V.questions(spark, sf)
    both = F.explode(F.array(F.lit("src1"), F.lit("src2")))
    asked = asked.withColumns({"project": both, "limit": F.lit(3)})
    answer = R.recall(_memories(V.notes(spark, sf, True)), asked, V.EMBEDDER)
    return answer.where("chosen").select("project", "query_id", "rank", "id", "score")


@query
def recall_turns(spark, sf):
    """Overlapping chunks, ten results a query, scores from 0.02 on."""
    return _turn_recall(spark, sf, limit=10, min_score=0.02).where("chosen").select("query_id", "rank", "id", "score", "cost")


@query
def dedup_greedy(spark, sf):
    """Survivors among the notes that are fetched first for each query, 400 texts."""
    asked = V.questions(spark, sf).withColumn("project", F.concat(F.lit("src"), (C("query_id") % 20).cast("string")))
    asked = R.plan_queries(asked.withColumn("max_tokens", F.lit(1)), V.EMBEDDER)
    scored = R.candidates(_memories(V.notes(spark, sf, True)), asked)
    return greedy_dedup(scored).select("query_id", "id", "score")


@query
def dedup_long_list(spark, sf):
    """All notes and turns as the candidates of one question, in an order of their own."""
    columns = ["id", "text", "content_hash", "file_path", "line_start", "line_end"]
    notes = V.notes(spark, sf, True).select(*columns)
    turns = V.turns(spark, sf, True).select(-C("id") - 1, *columns[1:]).toDF(*columns)
    score = F.pmod(C("id") * 7919, F.lit(1000)) / 1000
    rows = notes.unionByName(turns).withColumns({"project": F.lit("all"), "query_id": F.lit(0), "score": score})
    return greedy_dedup_spread(rows, Scratch(spark)).select("id", "score")


@query
def similar_notes(spark, sf):
    """All pairs of notes of different shingles that are alike by 0.85 or more; equal ones are one, named by the first."""
    rows = V.notes(spark, sf, True).select("id", X.shingle_hashes(C("text")).alias("grams"))
    return similar_rows(rows, Scratch(spark), SIMILARITY).withColumn("similarity", F.round("similarity", 9))


@query
def overlap_pairs(spark, sf):
    """Turns of one conversation whose lines overlap."""
    return overlap.overlap_pairs(V.turns(spark, sf), "id", ["file_path"])


@query
def pack_budget(spark, sf):
    """Notes of each project in id order, packed into 5,000 tokens."""
    cost = X.hit_cost(*[C(c) for c in ["id", "kind", "file_path", "line_start", "line_end", "text"]])
    ranked = V.notes(spark, sf, True).select(
        "project",
        F.substring("project", 4, 9).cast("long").alias("query_id"),
        "id",
        F.lit(0.0).alias("score"),
        cost.alias("cost"),
        F.lit(5).alias("limit"),
        F.lit(5000).cast("long").alias("max_tokens"),
    )
    return pack_long(ranked).where("chosen").select("query_id", "rank", "id", "cost", "running_tokens")


# -- ingestion --------------------------------------------------------------------


def _next_run(spark, sf) -> DataFrame:
    """The conversations as a later run finds them: system turns gone, turns moved up,
    long texts edited."""
    kept = V.table(spark, sf, "conversations").where(C("role") != "system")
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    text = F.when(F.length("text") > 400, F.concat("text", F.lit(" (edited)"))).otherwise(C("text"))
    rows = kept.withColumn("position", position).withColumn("content", text)
    return rows.select(
        F.concat(F.lit("conv/"), C("conv_id").cast("string")).alias("rel_path"),
        C("position").alias("ordinal"),
        "content",
        X.content_hash(C("content")).alias("content_hash"),
        (C("position") * 5 + 1).alias("start_line"),
        (C("position") * 5 + 8).alias("end_line"),
        F.lit("").alias("unit"),
        C("role").alias("unit_kind"),
        F.lit("text").alias("lang"),
    )


def _diff(spark, sf) -> DataFrame:
    return diff.classify(_next_run(spark, sf), stored_chunks(V.turns(spark, sf)))


@query
def ingest_diff(spark, sf):
    numbers = [F.coalesce(c, F.lit(-1)).alias(c) for c in ["id", "start_line", "end_line"]]
    return _diff(spark, sf).select("rel_path", "content_hash", "status", *numbers)


@query
def ingest_totals(spark, sf):
    return diff.totals(diff.file_changes(_diff(spark, sf)))


@query
def stale_chunks(spark, sf):
    return diff.stale_chunks(stored_chunks(V.turns(spark, sf)), _next_run(spark, sf)).select("id", "file_path")


@query
def vanished_files(spark, sf):
    """Files of a first run, one per customer with orders, missing from a run with one per event user."""
    stored = V.table(spark, sf, "orders").select(F.concat(F.lit("c/"), C("o_custkey").cast("string")).alias("file_path"))
    fresh = V.table(spark, sf, "events").select(F.concat(F.lit("c/"), C("user_id").cast("string")).alias("rel_path"))
    return diff.vanished_files(stored, fresh)


@query
def range_overlaps(spark, sf):
    rows = V.turns(spark, sf).select("id", "file_path", "line_start", "line_end")
    return overlap.overlap_counts(rows).select("id", "overlaps")


def _line_windows(spark, sf) -> DataFrame:
    files = V.documents(spark, sf).select(
        F.concat(F.lit("doc/"), C("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), C("text").alias("content")
    )
    return chunk_text_files(files)


@query
def line_windows(spark, sf):
    chunks = _line_windows(spark, sf)
    return chunks.select("rel_path", "start_line", "end_line", X.content_hash(C("content")).alias("hash"))


@query
def chunk_languages(spark, sf):
    """Chunks per language: documents as text files, conversations as Go files."""
    return diff.by_language(_line_windows(spark, sf).unionByName(chunk_code_files(_go_files(spark, sf))))


def _go_files(spark, sf) -> DataFrame:
    """A Go file per conversation: a documented function per turn, the text in literals."""
    quoted = F.regexp_replace(F.regexp_replace("text", r"[\\\"]", "'"), "\n", " { ")
    function = F.concat(
        F.lit("// Turn"), C("turn").cast("string"), F.lit(" is said by the "), C("role"), F.lit(".\nfunc Turn"),
        C("turn").cast("string"), F.lit('(w Writer) {\n\tw.Say("'), quoted, F.lit('")\n}\n'),
    )
    functions = V.table(spark, sf, "conversations").select("conv_id", "turn", function.alias("body"))
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("turn", "body"))), lambda s: s["body"])
    return functions.groupBy("conv_id").agg(bodies.alias("bodies")).select(
        F.concat(F.lit("talk/"), C("conv_id").cast("string"), F.lit(".go")).alias("rel_path"),
        F.concat(F.lit("package talk\n\n"), F.array_join("bodies", "\n")).alias("content"),
    )


@query
def code_chunks(spark, sf):
    chunks = chunk_code_files(_go_files(spark, sf))
    return chunks.select("rel_path", "ordinal", "start_line", "end_line", "unit_kind", "unit", X.content_hash(C("content")).alias("hash"))


def _python_files(spark, sf) -> DataFrame:
    """A Python module per order status and priority: a decorated class per order month, values as methods."""
    orders = V.table(spark, sf, "orders").select(
        F.concat_ws("/", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("module"),
        F.date_format("o_orderdate", "yyyyMM").alias("month"),
    )
    months = orders.groupBy("module", "month").agg(F.count("*").alias("n"))
    body = F.concat(
        F.lit("@register\nclass Month"), C("month"), F.lit(':\n    """Orders (of the month."""\n\n    def count(self):\n        return '),
        C("n").cast("string"), F.lit("\n"),
    )
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("month", body.alias("body")))), lambda s: s["body"])
    return months.groupBy("module").agg(bodies.alias("bodies")).select(
        F.concat(F.lit("orders/"), C("module"), F.lit(".py")).alias("rel_path"),
        F.concat(F.lit('"""Orders {\nby month."""\nimport base\n\n'), F.array_join("bodies", "\n")).alias("content"),
    )


@query
def python_chunks(spark, sf):
    chunks = chunk_code_files(_python_files(spark, sf))
    return chunks.select("rel_path", "ordinal", "start_line", "end_line", "unit_kind", "unit", X.content_hash(C("content")).alias("hash"))


def _chunk_rows(files: DataFrame) -> DataFrame:
    return chunk_code_files(files).select(
        "rel_path", "ordinal", "start_line", "end_line", "unit_kind", "unit", X.content_hash(C("content")).alias("hash")
    )


@query
def ts_chunks(spark, sf):
    """A TypeScript file per conversation: a typed arrow function for every turn."""
    said = F.regexp_replace(F.regexp_replace("text", r"[\\\\\"]", "'"), "\n", " { ")
    turn = C("turn").cast("string")
    body = F.concat(
        F.lit("/** "), C("role"), F.lit(" */\nexport const turn"), turn,
        F.lit(": (w: Writer) => Promise<void> = async (w) => {\n  await w.say(\""), said, F.lit("\");\n};\n"),
    )
    turns = V.table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("turn", "body"))), lambda s: s["body"])
    files = turns.groupBy("conv_id").agg(bodies.alias("bodies")).select(
        F.concat(F.lit("talk/"), C("conv_id").cast("string"), F.lit(".ts")).alias("rel_path"),
        F.concat(F.lit("import { Writer } from './writer';\n\n"), F.array_join("bodies", "\n")).alias("content"),
    )
    return _chunk_rows(files)


@query
def go_forms(spark, sf):
    """A Go file per supplier with every form of declaration; small neighbours become a block."""
    text = (
        "package s\n\ntype A# struct {\n\tx int\n}\ntype B# interface {\n}\ntype C# = int\nvar (\n\ta = 1\n)\n"
        "const D# = 2\nfunc E#() {\n}\nfunc (r *A#) F#() {\n}\n"
    )
    key = C("s_suppkey").cast("string")
    files = V.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), key, F.lit(".go")).alias("rel_path"), F.replace(F.lit(text), F.lit("#"), key).alias("content")
    )
    return _chunk_rows(files)


@query
def oversize_pieces(spark, sf):
    """A function per page, with a line for every ten characters of it."""
    lines = F.floor(F.length("html") / 10).cast("int")
    files = V.table(spark, sf, "pages").select(
        F.concat(F.lit("p"), C("page_id").cast("string"), F.lit(".go")).alias("rel_path"),
        F.concat(F.lit("func Big() {\n"), F.repeat(F.lit("\twork()\n"), lines), F.lit("}\n")).alias("content"),
    )
    return _chunk_rows(files).drop("hash")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall_notes(spark, sf_dir)
