"""The command surface: an index in a folder, kept current and searched."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, fields, replace
from dataclasses import replace as replace_request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chunking import chunked
from .functions.scalar import ancestors, namespace, usable_vector
from .operators import status, upkeep
from .operators.filters import DEFAULT_EXCLUSIONS, Exclusions, sensitive
from .operators.fusion import search
from .operators.lexical import LexicalIndex, posted
from .operators.vector import Cells, file_queries
from .request import Request
from .runtime import discard, materialize
from .sources.extract import extract
from .sources.scan import scan_local, stat_of, with_contents
from .store import SCHEMAS, Replace, Store
from .streaming import changes

#: Texts to vectors; loaded once by each worker.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class Settings:
    results_count: int = 100
    dimensions: int = 256
    max_text_mb: int = 32
    audio_seconds: int = 60
    video_seconds: int = 30
    frames_per_second: float = 1.0
    show_offline: bool = False
    pause_media: bool = False
    sensitive_files: bool = False
    embed_batch: int = 4
    #: Cells of the vector index that a search reads; 0 reads all vectors.
    probes: int = 0
    enabled_kinds: tuple[str, ...] = ("text", "code", "document", "pdf", "image", "audio", "video")
    exclusions: tuple[str, ...] = DEFAULT_EXCLUSIONS

    def __post_init__(self):
        for name, low, high in (("results_count", 1, 500), ("audio_seconds", 10, 120), ("video_seconds", 10, 60), ("frames_per_second", 0.1, 4)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} lies between {low} and {high}")
        if self.dimensions < 1 or self.max_text_mb < 1 or self.embed_batch < 1:
            raise ValueError("dimensions, max_text_mb and embed_batch are positive")

    def fingerprint(self) -> str:
        """What stored vectors depend on; others aren't mixed with them."""
        return hashlib.sha256(json.dumps([self.dimensions, self.audio_seconds, self.video_seconds, self.frames_per_second]).encode()).hexdigest()


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.store, self.embedder, self.paused = spark, Store(spark, path), embedder, False

    # settings

    def settings(self) -> Settings:
        stored = {r["key"]: json.loads(r["value"]) for r in self.store.read("settings").collect()}
        known = {f.name for f in fields(Settings)}
        return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored.items() if k in known})

    def update_settings(self, **changes) -> Settings:
        """Store settings; where vectors depend on them, vectors are dropped and all files queued, in the same commit."""
        old = self.settings()
        new = replace(old, **changes)
        rows = self.spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(new).items()], "key string, value string")
        rows = rows.unionByName(self.store.read("settings").where("key = 'index_stopped'"))
        if new.fingerprint() != old.fingerprint():
            f, c = upkeep.reset_semantics(self.store.read("files"), self.store.read("chunks"))
            none = {t: self.store.read(t).where("false") for t in ("pivots", "cells")}
            self.store.commit(settings=rows, files=f, chunks=c, jobs=self._jobs(f), **none)
        else:
            self.store.commit(settings=rows)
        return new

    def reset_settings(self) -> Settings:
        return self.update_settings(**asdict(Settings()))

    # corpus

    def add_root(self, path: str, exclusions: Sequence[str] = ()) -> int:
        """A new location; refused if it lies in another one, or another one in it."""
        path = path.rstrip("/")
        roots = self.store.read("roots")
        known = [(r["id"], r["path"]) for r in roots.collect()]
        for _, p in known:
            if p == path or path.startswith(p + "/") or p.startswith(path + "/"):
                raise ValueError(f"{path} and {p} overlap")
        number = max((i for i, _ in known), default=0) + 1
        row = self.spark.createDataFrame([(number, path, True, json.dumps(list(exclusions)))], roots.schema)
        self.store.commit(roots=roots.unionByName(row))
        return number

    def remove_root(self, root_id: int) -> None:
        files = self.store.read("files")
        r, f, _ = upkeep.cascade(self.roots_table(), files, self.store.read("chunks"), [root_id])
        lost = files.where(F.col("root_id") == root_id).select(F.col("id").alias("file_id"))
        self.store.commit(roots=r, files=f, jobs=self._jobs(f), **self._content(lost))

    def roots_table(self) -> DataFrame:
        return self.store.read("roots")

    def roots(self) -> DataFrame:
        return status.root_counts(self.roots_table(), self.store.read("files"))

    def _jobs(self, files: DataFrame) -> DataFrame:
        q = upkeep.job_queue(files, self.settings().pause_media)
        return q.select("file_id", F.lit("queued").alias("state"), "priority", "kind", F.lit(True).alias("online"))

    # index

    def scan(self, root_id: int) -> dict[str, int]:
        """Compare a location with the index and queue what is new or changed; how many paths of each status.

        What an error hides is not deleted, but what is excluded now goes in any case. A file found under another path
        with the identity of one that is gone keeps its id and content. A location that can't be reached goes offline
        and keeps its content, until a scan finds it again.
        """
        root = self.roots_table().where(F.col("id") == root_id).first()
        if root is None:
            raise ValueError(f"no root {root_id}")
        files, s = self.store.read("files"), self.settings()
        online = os.path.isdir(root["path"])
        roots = self.roots_table().withColumn("online", F.when(F.col("id") == root_id, online).otherwise(F.col("online")))
        if not online:
            self.store.commit(roots=roots, files=upkeep.root_offline(files, roots))
            self.log("offline", root["path"])
            return {}
        rules = Exclusions([*s.exclusions, *json.loads(root["exclusions"] or "[]")])
        found = materialize(scan_local(self.spark, root["path"], rules, sensitive_files=s.sensitive_files), "scan")
        errors = found.where("error IS NOT NULL").count()
        seen = found.where("error IS NULL").withColumn("root_id", F.lit(root_id).cast("long"))
        mine, others = files.where(F.col("root_id") == root_id), files.where(F.col("root_id") != root_id)
        left_out = rules.matches(F.col("path"), F.lit(root["path"])) if s.sensitive_files else rules.matches(F.col("path"), F.lit(root["path"])) | sensitive(F.col("name"))
        excluded = mine.where(left_out)
        mine, pairs = upkeep.renamed(mine.where(~left_out), seen)
        result = {r["status"]: r["count"] for r in upkeep.scan_diff(seen, mine).groupBy("status").count().collect()}
        result |= {k: n for k, n in (("renamed", pairs.count()), ("excluded", excluded.count())) if n}
        gone = materialize(upkeep.tombstones(mine, seen, errors).select("id").unionByName(excluded.select("id")), "gone")
        kept = mine.join(gone, "id", "left_anti").withColumn("online", F.lit(True))
        after = materialize(upkeep.upsert(others.unionByName(kept), seen, time.time_ns()), "files")
        lost = gone.select(F.col("id").alias("file_id"))
        self.store.commit(roots=roots, files=after, jobs=self._jobs(after), **(self._content(lost) if not gone.isEmpty() else {}))
        self.log("scan", root["path"], f"{result}, {errors} errors")
        return result

    def _content(self, gone: DataFrame, chunks: DataFrame | None = None) -> dict[str, Replace]:
        """What becomes of the chunks and the word index where files go or come: only their buckets are written."""
        if chunks is None:
            chunks = self.spark.createDataFrame([], SCHEMAS["chunks"])
        postings, lengths = posted(chunks, carry=("file_id",))
        made = {t: Replace(gone, rows) for t, rows in (("chunks", chunks), ("postings", postings), ("lengths", lengths))}
        pivots = self.store.read("pivots")
        if not pivots.isEmpty():
            made["cells"] = Replace(gone, Cells(pivots).placed(chunks).where("cell IS NOT NULL"))
        return made

    def index_vectors(self) -> bool:
        """Make the vector index where it is missing, or where its signature isn't that of the chunks' vectors; whether it was made.

        Commits keep it current afterwards. Its pivots are chosen anew only here.
        """
        chunks = self.store.read("chunks")
        usable = chunks.where(usable_vector(F.col("vector"), F.size("vector")))
        if status.signature(usable).first() == status.signature(self.store.read("cells")).first():
            return False
        cells = Cells.of(usable)
        self.store.commit(pivots=cells.frame, cells=cells.placed(usable).where("cell IS NOT NULL"))
        return True

    def control(self, action: str) -> None:
        """``pause`` until ``resume``; ``stop`` until ``resume`` too, also for engines opened later on this index."""
        if action not in ("pause", "resume", "stop"):
            raise ValueError("an index is paused, resumed or stopped")
        self.paused = action == "pause"
        if action != "pause":
            kept = self.store.read("settings").where(F.col("key") != "index_stopped")
            self.store.commit(settings=kept.unionByName(self.spark.createDataFrame([("index_stopped", json.dumps(action == "stop"))], kept.schema)))

    def stopped(self) -> bool:
        row = self.store.read("settings").where("key = 'index_stopped'").first()
        return bool(row and json.loads(row["value"]))

    def recover(self) -> None:
        """After a restart: jobs that were under way are queued, and with an embedder the files that waited for one."""
        jobs = self.store.read("jobs")
        if not jobs.where("state = 'active'").isEmpty():
            self.store.commit(jobs=upkeep.restarted(jobs))
        if self.embedder is not None:
            waiting = upkeep.waiting_for_model(self.store.read("files")).select("id")
            if not waiting.isEmpty():
                self._queue_files(waiting)

    def index(self, batch: int = 50_000, progress: Callable[[int, int], None] | None = None) -> int:
        """Read, cut, embed and commit all queued files, ``batch`` at a time in the order of the queue; how many.

        Between batches ``progress`` hears how many are done and left, and a pause or stop takes hold; what is left stays
        queued. A file that can't be read becomes a row with its error.
        """
        total, last = 0, None
        while not self.paused and not self.stopped():
            n, left = self._index_some(batch)
            total += n
            if progress is not None and n:
                progress(total, left)
            if not left or not n and left == last:  # files that change while they are read wait for the next call
                break
            last = left
        if total:
            self.log("indexed", "", f"{total} files")
        return total

    def _index_some(self, batch: int) -> tuple[int, int]:
        s, version = self.settings(), self.store.version()
        manifest = self.store.manifest(version)
        files, chunks = self.store.read("files", manifest=manifest), self.store.read("chunks", manifest=manifest)
        queue = upkeep.job_queue(files, s.pause_media)
        next_ = queue.limit(batch).select(F.col("file_id").alias("id"))
        columns = ("root_id", "path", "name", "extension", "kind", "size", "mtime_ns", "semantic", F.col("content_hash").alias("old_hash"))
        todo = materialize(files.join(next_, "id", "left_semi").select(F.col("id").alias("file_id"), *columns), "todo")
        if todo.isEmpty():
            return 0, 0
        parts = materialize(with_contents(todo, s.max_text_mb << 20), "contents")
        digest = F.sha2("content", 256)
        # content that is known and has its vectors is done
        known = F.coalesce(F.col("semantic") & (digest == F.col("old_hash")), F.lit(False))
        same = parts.where(known).select("file_id")
        enabled = parts.where(~known).where(F.col("kind").isin(*s.enabled_kinds))
        texts = materialize(extract(enabled.where("content IS NOT NULL").drop("size", "mtime_ns", "semantic", "old_hash", "name")), "texts")
        fresh = materialize(self._embedded(upkeep.reuse(self._cut(texts), chunks)), "fresh")
        # what changed while it was read is dropped and stays queued, with its new size and time
        now = materialize(stat_of(todo.select("file_id", "path")), "now")
        moved = upkeep.edited(todo, now.where("size IS NOT NULL"))
        again = materialize(now.join(moved, "path", "left_semi"), "again")
        done = todo.join(again.select("file_id"), "file_id", "left_anti")
        changed = done.join(same, "file_id", "left_anti").select("file_id")
        new = upkeep.with_ids(fresh.join(changed, "file_id", "left_semi"), ["file_id", "seq"], chunks).withColumnRenamed("__id", "id")
        new = materialize(new, "numbered")
        failed = texts.where("error IS NOT NULL").select("file_id", "error")
        failed = failed.unionByName(enabled.where("read_error IS NOT NULL").select("file_id", F.col("read_error").alias("error")))
        if self.embedder is None:
            failed = failed.unionByName(new.select("file_id", F.lit(f"{upkeep.NO_MODEL}; words are searchable").alias("error")))
        failed = failed.groupBy("file_id").agg(F.min("error").alias("error"))
        states = upkeep.file_states(changed.withColumnRenamed("file_id", "id"), new, failed).join(failed, "file_id", "left")
        states = states.join(parts.select("file_id", digest.alias("content_hash")), "file_id", "left")
        states = states.unionByName(same.join(done.select("file_id"), "file_id").join(parts.select("file_id", digest.alias("content_hash")), "file_id").select(
            "file_id", F.lit("indexed").alias("state"), F.lit(True).alias("semantic"), F.lit(None).cast("string").alias("error"), "content_hash"
        ))
        taken = ("state", "semantic", "error", "content_hash")
        states = states.select(F.col("file_id").alias("id"), *[F.col(c).alias(f"new_{c}") for c in taken], F.lit(int(time.time())).alias("new_last_indexed"))
        again = again.select(F.col("file_id").alias("id"), *[F.col(c).alias(f"now_{c}") for c in ("size", "mtime_ns")])
        took, late = F.col("new_state").isNotNull(), F.col("now_size").isNotNull()
        value = {c: F.when(took, F.col(f"new_{c}")).otherwise(F.col(c)) for c in (*taken, "last_indexed")} | {c: F.when(late, F.col(f"now_{c}")).otherwise(F.col(c)) for c in ("size", "mtime_ns")}
        after = materialize(files.join(states, "id", "left").join(again, "id", "left").select(*[value.get(c, F.col(c)).alias(c) for c in files.columns]), "files")
        self.store.commit(files=after, jobs=self._jobs(after), **self._content(changed, new))
        n, left = done.count(), upkeep.job_queue(after, s.pause_media).count()
        for step in (parts, texts, fresh, new, todo):
            discard(step)
        return n, left

    def _cut(self, texts: DataFrame) -> DataFrame:
        """The chunks of extracted texts, without ids and vectors."""
        body = texts.where("text IS NOT NULL").withColumnsRenamed({"line_start": "base", "heading": "of_part"}).drop("line_end", "error")
        modality = F.when(F.col("kind") == "code", "code").otherwise("text")
        made = chunked(body.withColumn("modality", modality), modality=F.col("modality"), extension=F.col("extension"))
        # a part's chunks are numbered already; only parts are counted up within a file, not chunks
        parts_of = made.groupBy("file_id", "part").agg(F.count(F.lit(1)).alias("n"))
        made = made.join(parts_of.withColumn("before", F.coalesce(F.sum("n").over(_earlier_parts()), F.lit(0))).drop("n"), ["file_id", "part"])
        offset = F.coalesce(F.col("base"), F.lit(1)) - 1
        return made.select(
            "file_id", (F.col("before") + F.col("seq")).alias("seq"), "modality", "text", F.coalesce("of_part", "heading").alias("heading"), "page",
            (F.col("line_start") + offset).alias("line_start"), (F.col("line_end") + offset).alias("line_end"), F.lit(None).cast("double").alias("start_sec"),
            F.lit(None).cast("double").alias("end_sec"), "hash", namespace(F.col("modality")).alias("namespace"), F.lit(None).cast("array<float>").alias("vector"),
        )

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        if self.embedder is None:
            return chunks
        embed, n, limit = self.embedder, self.settings().dimensions, self.settings().embed_batch

        @F.pandas_udf("array<float>")
        def vectors(text: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(text), index=text.index, dtype=object)
            known = text[text.notna() & (text.str.strip() != "")]
            for some in embedding_batches(list(known), limit):
                for i, v in zip(known.index[some], embed(list(known.iloc[some]))):
                    out[i] = [float(x) for x in v][:n]
            return out

        return chunks.withColumn("vector", F.when(F.col("vector").isNull(), vectors("text")).otherwise(F.col("vector")))

    def changed(self, events: DataFrame, run: int | None = None) -> int:
        """Take in change events (``path``, ``recursive``): only what they name is looked at; how many paths.

        Paths that lie below a changed folder are covered by it. A folder's location is scanned, as are all locations
        where more paths wait than :func:`~trawl.streaming.changes.overflowed` allows; single files are looked at alone.
        """
        waiting = events.groupBy("path").agg(F.bool_or("recursive").alias("recursive"))
        n = waiting.count()
        if changes.overflowed(n):
            for r in self.roots_table().collect():
                self.scan(r["id"])
            return n
        seen = materialize(stat_of(changes.covered(waiting)), "changed")
        roots = self.roots_table().select(F.col("id").alias("root_id"), F.col("path").alias("root"))
        # a location for each path, by an equi-join on its ancestors
        above = seen.withColumn("root", F.explode(ancestors(F.col("path")))).join(roots, "root").drop("root")
        for r in above.where("folder AND recursive").select("root_id").distinct().collect():
            self.scan(r["root_id"])
        settings = self.settings()
        rules = Exclusions([*settings.exclusions])
        there = above.where("NOT folder").where(~rules.matches(F.col("path")))
        there = there if settings.sensitive_files else there.where(~sensitive(F.col("name")))
        missing = seen.where("size IS NULL AND NOT folder").select("path", F.lit(False).alias("exists"))
        files = self.store.read("files")
        after = materialize(changes.apply_batch(files, missing, there.where("size IS NOT NULL"), run or time.time_ns()), "files")
        gone = materialize(files.join(after.select("id"), "id", "left_anti").select(F.col("id").alias("file_id")), "gone")
        self.store.commit(files=after, jobs=self._jobs(after), **(self._content(gone) if not gone.isEmpty() else {}))
        return n

    def watch(self, events: DataFrame, checkpoint: str, trigger: dict | None = None):
        """A streaming query that takes in events (``path``, ``kind``) and works off what they queue, batch by batch.

        A stopped or paused index takes the changes in and leaves their content queued.
        """

        def take(batch: DataFrame, number: int) -> None:
            self.changed(batch)
            self.index()

        return changes.apply_changes(changes.intake(events), take, checkpoint, trigger)

    def idle(self) -> list[int]:
        """Scan again the locations that were away or had errors; which."""
        again = [r["id"] for r in upkeep.to_reconcile(*(self.store.read(t) for t in ("roots", "files", "activity"))).orderBy("id").collect()]
        for i in again:
            self.scan(i)
        return again

    def start_index(self, root_id: int | None = None) -> dict[str, int]:
        """Scan one location or all, then work off the queue."""
        if self.stopped():
            self.control("resume")
        self.recover()
        total: dict[str, int] = {}
        for r in self.roots_table().collect():
            if root_id in (None, r["id"]):
                for k, v in self.scan(r["id"]).items():
                    total[k] = total.get(k, 0) + v
        return total | {"indexed": self.index()}

    def retry(self, file_id: int) -> None:
        self._queue(F.col("id") == file_id)

    def rebuild(self) -> None:
        self._queue(F.lit(True))

    def _queue_files(self, ids: DataFrame) -> None:
        """Queue the files of these ids, however many."""
        marked = self.store.read("files").join(ids.select("id", F.lit(True).alias("__again")), "id", "left")
        again = F.coalesce("__again", F.lit(False))
        files = marked.withColumns({"error": F.when(~again, F.col("error")), "state": F.when(again, "queued").otherwise(F.col("state"))}).drop("__again")
        files = materialize(files, "files")
        self.store.commit(files=files, jobs=self._jobs(files))

    def _queue(self, which) -> None:
        files = self.store.read("files")
        again = {"error": F.when(~which, F.col("error")), "state": F.when(which, "queued").otherwise(F.col("state")), "content_hash": F.when(~which, F.col("content_hash"))}
        files = files.withColumns(again)
        self.store.commit(files=files, jobs=self._jobs(files))

    def clear(self) -> None:
        """Forget what was indexed; locations and settings stay."""
        empty = {t: self.spark.createDataFrame([], self.store.read(t).schema) for t in ("files", "chunks", "jobs", "postings", "lengths", "pivots", "cells")}
        self.store.commit(**empty)

    def compact(self) -> int:
        """Rewrite the tables in larger files and drop the old ones; how many folders went."""
        self.store.compact()
        return self.store.vacuum()

    def move_index(self, path: str) -> None:
        self.store = self.store.copy_to(path)

    # query

    def search(self, request: Request, like_file: int | None = None, query_vectors: list[tuple[int, str, list[float]]] | None = None) -> DataFrame:
        """Ranked files; ``like_file`` asks with a file's own vectors, an embedder with those of the text."""
        manifest = self.store.manifest()  # one for all tables, so a commit meanwhile mixes nothing
        files, chunks, postings, lengths = (self.store.read(t, manifest=manifest) for t in ("files", "chunks", "postings", "lengths"))
        queries = query_vectors
        if like_file is not None:
            queries = file_queries(chunks, like_file)
        elif queries is None and self.embedder is not None and request.mode != "exact" and request.query:
            v = list(self.embedder([request.query])[0])[: self.settings().dimensions]
            queries = [(0, "general", v), (1, "code", v)]
        self.spark.sparkContext.addJobTag("trawl-search") if hasattr(self.spark.sparkContext, "addJobTag") else None
        index, vectors, probes = LexicalIndex(postings, lengths, True, chunks.select("id", "text", "heading")), None, self.settings().probes
        if probes and queries and "cells" in manifest:
            near = Cells(self.store.read("pivots", manifest=manifest)).near(queries, probes)
            vectors = self.store.read("cells", manifest=manifest).where(F.col("cell").isin(near))
        return search(files, chunks, request, queries, index=index, vectors=vectors)

    def search_in_phases(self, request: Request, **options) -> Iterator[DataFrame]:
        """First what names and words find, then, where vectors are asked for, everything."""
        if request.mode == "smart":
            yield self.search(replace_request(request, mode="exact"), **options)
        yield self.search(request, **options)

    def cancel_search(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag("trawl-search")

    def preview(self, file_id: int) -> str:
        return status.preview(self.store.read("chunks"), file_id).first()["preview"]

    # status

    def status(self) -> DataFrame:
        return status.counts(*(self.store.read(t) for t in ("files", "chunks", "jobs")))

    def health(self) -> DataFrame:
        return status.health(*(self.store.read(t) for t in ("roots", "files", "chunks", "jobs", "activity")))

    def activity(self, n: int = 500) -> DataFrame:
        return status.last_activity(self.store.read("activity"), n)

    def log(self, kind: str, path: str, message: str = "", file_id: int | None = None) -> None:
        log = self.store.read("activity")
        top = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        row = self.spark.createDataFrame([(top + 1, int(time.time()), kind, file_id, path, message)], log.schema)
        self.store.commit(activity=status.trimmed(log.unionByName(row)))

    def storage_info(self) -> dict[str, int]:
        """Bytes of each table and of what no table uses any more."""
        return self.store.sizes()

    def benchmark(self, texts: Sequence[str] = ("a short text to embed",), batches: Sequence[int] = (1, 4, 8, 16, 32)) -> dict[str, float]:
        """Seconds of a status row and, with an embedder, texts a second for each size of batch."""
        start = time.perf_counter()
        self.status().collect()
        out = {"status": time.perf_counter() - start}
        for n in batches if self.embedder is not None else ():
            some = [texts[i % len(texts)] for i in range(n)]
            start = time.perf_counter()
            self.embedder(some)
            out[f"embed_{n}"] = n / max(time.perf_counter() - start, 1e-9)
        return out

    def export_diagnostics(self) -> str:
        """Counts, health and settings as JSON."""
        return json.dumps(
            {
                "status": self.status().first().asDict(),
                "health": {r["check"]: r["orphans"] for r in self.health().collect()},
                "settings": asdict(self.settings()),
                "fingerprint": self.settings().fingerprint(),
            },
            indent=1,
        )


def _earlier_parts():
    from pyspark.sql import Window

    return Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def embedding_batches(texts: Sequence[str], limit: int, spread: int = 1200) -> Iterator[list[int]]:
    """Places of texts that are embedded together: up to ``limit`` in a row whose lengths are less than ``spread`` from the first's."""
    batch: list[int] = []
    for i, t in enumerate(texts):
        if batch and (len(batch) >= limit or abs(len(t) - len(texts[batch[0]])) >= spread):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch
