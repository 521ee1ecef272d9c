"""Computations in order, each published on its own: a failure stays with its computation."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import atlas, catalogue, consent, graph, lifecycle, neighbours, rarity
from lodestack.plans import status
from lodestack.sources.lens import Catalogue
from lodestack.sources.snapshots import SnapshotStore

#: Exit codes of the nightly job; fixed values.
DONE, BUSY, FAILED, REFUSED = 0, 75, 1, 2
SUMMARY_DAYS = 7


class Jobs:
    """The scheduled computations over one catalogue and one store."""

    def __init__(self, spark: SparkSession, catalogue_: Catalogue, store: SnapshotStore, now: datetime, enrich: Callable[[], int] = lambda: 0):
        self.spark, self.c, self.store, self.now, self.enrich = spark, catalogue_, store, now, enrich
        self.month = date(now.year, now.month, 1)

    def artist_centrality(self) -> None:
        self.store.publish({"artist_centrality": catalogue.artist_centrality(self.c.artists, self.c.by_artist)})

    def genre_trends(self) -> None:
        self.store.publish({"genre_trends": catalogue.genre_trends(self.c.releases, self.c.in_genre)})

    def style_year_counts(self) -> None:
        """Three tables of one state, published together."""
        c = self.c
        self.store.publish(
            {
                "style_year_counts": catalogue.style_year_counts(c.releases, c.in_style, c.derived_from),
                "genre_year_counts": catalogue.genre_year_counts(c.releases, c.in_genre),
                "style_parents": catalogue.style_parents(catalogue.style_genre_shares(c.in_style, c.in_genre)),
            }
        )

    def style_atlas(self) -> None:
        """Once a month: sectors and layout, pinned to the month before."""
        month, version = self.month, self.store.version()
        old = self.store.read("genre_atlas_sectors", version)
        if old is not None and old.where(F.col("month") == F.lit(month)).take(1):
            return
        before = []
        if old is not None:
            last = old.where(F.col("month") < F.lit(month)).agg(F.max("month")).first()[0]
            rows = old.where(F.col("month") == F.lit(last)).collect() if last else []  # one row a genre
            before = [atlas.Sector(r["genre"], r["ring_order"], r["sector_start"], r["sector_end"]) for r in rows]
        shares = graph.kept(catalogue.style_genre_shares(self.c.in_style, self.c.in_genre), "shares")  # a layout reads them several times
        years = catalogue.style_year_counts(self.c.releases, self.c.in_style, self.c.derived_from)
        grid = lifecycle.dense(years.select("style", F.col("year").alias("period"), F.col("release_count").alias("n")), month.year - 1)
        sectors, nodes, _ = atlas.layout(catalogue.style_parents(shares), shares, lifecycle.emergence(lifecycle.stages(grid)), before)
        dated = lambda df: df.withColumn("month", F.lit(month))
        if not self.store.folder.create(f"once/atlas-{month}", "taken"):
            return
        try:
            layout = self.store.read("style_atlas_layout", version)
            tables = {"genre_atlas_sectors": (old, dated(sectors)), "style_atlas_layout": (layout, dated(nodes))}
            self.store.publish({t: new if was is None else was.unionByName(new) for t, (was, new) in tables.items()})
        except BaseException:
            self.store.folder.delete(f"once/atlas-{month}")
            raise

    def style_landmarks(self) -> None:
        self.store.publish({"style_landmark_masters": catalogue.style_landmarks(self.c.in_style, self.c.derived_from, self.c.masters)})

    def style_cotags(self) -> None:
        self.store.publish({"style_cotags": catalogue.style_cotags(self.c.in_style)})

    def label_longevity(self) -> None:
        self.store.publish({"label_longevity": catalogue.label_longevity(self.c.releases, self.c.on_label, self.c.labels, self.now.year)})

    def anniversaries(self) -> None:
        rows = catalogue.anniversaries(self.c.masters, self.now.year, self.now.month)
        if rows.take(1):
            self.store.upsert("monthly_anniversaries", rows, ["master_id", "computed_year", "computed_month"], ["title", "artist_name", "anniversary"])

    def data_completeness(self) -> None:
        self.store.publish({"data_completeness": catalogue.data_completeness(self.c)})

    def community_enrichment(self) -> int:
        """Asks the catalogue's owner to enrich entities; how many were. The caller gives the way to ask."""
        return self.enrich()

    def release_rarity(self) -> None:
        c = self.c
        signals = rarity.quality_signals(c.releases, c.by_artist, c.on_label, c.in_genre)
        scored = rarity.release_rarity(c.releases, signals, c.by_artist, c.on_label)
        self.store.publish({"release_rarity": scored}, expected={"release_rarity": c.releases.count()})

    def activity_summary(self) -> None:
        """The last days again, whole: consent that was revoked since takes its rows away, even all of them."""
        until = datetime(self.now.year, self.now.month, self.now.day, tzinfo=timezone.utc) + timedelta(days=1)
        since = until - timedelta(days=SUMMARY_DAYS)
        who = consent.eligible_subjects(self.c.user_subjects, self.c.grants, ["analytics"], self.now)
        read = lambda rows: consent.consented(rows, who, ["analytics"], since, until)
        self.store.replace_window("activity_summary", consent.activity_summary(read(self.c.events), read(self.c.impressions)), "summary_date", since.date(), until.date())

    NAMES = (
        "artist_centrality", "genre_trends", "style_year_counts", "style_atlas", "style_landmarks", "style_cotags", "label_longevity", "anniversaries",
        "data_completeness", "community_enrichment", "release_rarity", "activity_summary",
    )

    def run(self, names: tuple[str, ...] = NAMES) -> dict[str, str]:
        """Runs computations one after the other: {name: "completed" or the error}."""
        self.store.sweep()
        return {name: recorded(self.store, name, getattr(self, name)) for name in names}


def recorded(store: SnapshotStore, name: str, work: Callable[[], int | None]) -> str:
    """Runs a computation with a line in the log before and after it; what it returns is its number of rows."""
    run = uuid.uuid4().hex
    store.log(name, "running", run)
    try:
        rows = work()
    except Exception as error:
        store.log(name, "failed", run, error=str(error)[:500])
        return str(error)
    except BaseException:
        store.log(name, "interrupted", run)
        raise
    store.log(name, "completed", run, rows=rows)
    return "completed"


class Refused(ValueError):
    """The job was asked for what it doesn't do."""


@dataclass(frozen=True)
class JobStatus:
    """How a run of the nightly job ended. status: done, paused, skipped, checked, busy or failed."""

    status: str
    exit_code: int
    model_version: str | None = None
    published: bool = False
    already_published: bool = False
    blocks_done: int | None = None
    blocks_total: int | None = None
    eta_s: float | None = None
    decision: str | None = None  # of the load check: run or skip
    reason: str | None = None
    error: str | None = None
    elapsed_s: float = 0.0

    def to_json(self) -> str:
        return json.dumps({"kind": "similar_artists_status"} | asdict(self), sort_keys=True)


def target(store: SnapshotStore, requested: str | None) -> str | None:
    """The version of vectors to work on: the one asked for, or the only one that isn't published; None if all are."""
    known, published = set(store.embedding_versions()), {r["model_version"] for r in store.published_versions().collect()}
    if requested is not None:
        if requested not in known | published:
            raise Refused(f"no vectors of version {requested}")
        return requested
    waiting = sorted(known - published)
    if len(waiting) > 1:
        raise Refused(f"{len(waiting)} versions have no published release; name one")
    return waiting[0] if waiting else None


def stop_at(deadline: datetime | None, max_runtime_s: float | None, now: datetime) -> float | None:
    """The earlier of the two ends as a reading of the monotonic clock."""
    if deadline is not None and deadline.tzinfo is None:
        raise Refused("a deadline needs a time zone")
    if max_runtime_s is not None and max_runtime_s <= 0:
        raise Refused("the longest run time must be positive")
    left = None if deadline is None else (deadline - now).total_seconds()
    ends = [x for x in (left, max_runtime_s) if x is not None]
    return time.monotonic() + min(ends) if ends else None


def load_check(store: SnapshotStore, latches: DataFrame | None, now: datetime) -> tuple[str, str | None]:
    """("skip" or "run", why): a loader whose latch is open, or a run that writes vectors, means that the vectors may be half there. An
    open latch past its bound doesn't block, and is named."""
    rows = [] if latches is None else status.latches(latches.where("refreshed_at IS NULL AND open"), now.astimezone(timezone.utc).replace(tzinfo=None)).collect()  # a row for each loader and version
    busy = [f"{r['loader']} {r['version']} is being loaded" for r in rows if r["blocks"]]
    if store.folder.exists("locks/embeddings"):
        busy.append("vectors are being written")
    stale = [f"the latch of {r['loader']} {r['version']} is stale and ignored" for r in rows if not r["blocks"]]
    return ("skip", "; ".join(busy)) if busy else ("run", "; ".join(stale) or None)


def similar_artists(
    store: SnapshotStore, requested: str | None = None, k: int = 50, latches: DataFrame | None = None, deadline: datetime | None = None,
    max_runtime_s: float | None = None, check_only: bool = False, block: int = neighbours.BLOCK, now: datetime | None = None,
) -> JobStatus:
    """The exact neighbours of one version of vectors, computed in blocks that stay when the deadline comes, and their release once all
    are there. Exit codes: DONE (also if a load is in progress or nothing waits), BUSY if another run holds the lock or the deadline
    came, REFUSED for what it doesn't do, FAILED with the error otherwise."""
    began, now = time.monotonic(), now or datetime.now(timezone.utc)
    end = lambda how, code, **more: JobStatus(how, code, elapsed_s=round(time.monotonic() - began, 1), **more)
    held = False
    try:
        limit = stop_at(deadline, max_runtime_s, now)
        held = store.lock("similar-artists")
        if not held:
            return end("busy", BUSY)
        name = target(store, requested)
        if name is None:
            return end("done", DONE)
        if name in {r["model_version"] for r in store.published_versions().collect()}:
            return end("done", DONE, model_version=name, already_published=True)
        decision, reason = load_check(store, latches, now)
        told = {"model_version": name, "decision": decision, "reason": reason}
        if check_only or decision == "skip":
            return end("checked" if check_only else "skipped", DONE, **told)
        vectors = store.read(store.embedding_versions()[name])
        spool = f"spool/{uuid.uuid5(uuid.NAMESPACE_OID, f'{name}:{k}:{block}').hex}"
        total = max(1, -(-vectors.count() // block))
        parts = lambda: sum(store.folder.exists(f"{spool}/part-{i}/_SUCCESS") for i in range(total))
        before = parts()
        pairs = neighbours.spooled_top_k(vectors, f"{store.folder.root}/{spool}", k, block, lambda: limit is not None and time.monotonic() >= limit)
        if pairs is None:
            done = parts()
            eta = (time.monotonic() - began) / (done - before) * (total - done) if done > before else None
            return end("paused", BUSY, blocks_done=done, blocks_total=total, eta_s=eta, **told)
        store.write_release(neighbours.neighbour_lists(pairs), name, k)
        store.publish_release(name)
        store.folder.delete(spool)
        return end("done", DONE, published=True, blocks_done=total, blocks_total=total, **told)
    except Exception as error:
        return end("failed", REFUSED if isinstance(error, Refused) else FAILED, error=f"{type(error).__name__}: {str(error)[:500]}")
    finally:
        if held:
            store.unlock("similar-artists")


def similar_artists_job(store: SnapshotStore, edges: DataFrame, dump: str, config: graph.FastRP = graph.FastRP(), k: int = 50) -> JobStatus:
    """Embeddings of a dump, unless they are there, then similar_artists() of them. BUSY if another run writes vectors."""
    if not store.lock("embeddings"):
        return JobStatus("busy", BUSY)
    try:
        name, _ = store.write_embeddings(neighbours.half_precision(graph.fastrp(edges, config, ("a",)).withColumnRenamed("vertex", "id")), config.model_version, dump)
    except Exception as error:
        return JobStatus("failed", FAILED, error=f"{type(error).__name__}: {str(error)[:500]}")
    finally:
        store.unlock("embeddings")
    return similar_artists(store, name, k)
