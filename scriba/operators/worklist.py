"""Lists of files that wait, run and are done, and what a service's routes mean.

``files (list, pos, input, state)``: the files of each list in the order they came;
``state`` is one of ``running``, ``needs_model``, ``queued`` and the settled ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriba.functions.columns import ColumnLike, col, first_that_holds, lookup
from scriba.functions.paths import last_component, recovery
from scriba.functions.text import trim_ws

RUNNING, NEEDS_MODEL, QUEUED = "running", "needs_model", "queued"
#: Unfinished files run in this order.
_FIRST = (RUNNING, NEEDS_MODEL, QUEUED)


def newly_asked(asked: DataFrame, files: DataFrame, order: str, *by: str, key: str = "input") -> DataFrame:
    """What of ``asked`` isn't in ``files`` yet, each input once, the first of them: a file that is listed keeps its row."""
    fresh = asked.join(files.select(*by, key).distinct(), [*by, key], "left_anti")
    rest = [c for c in fresh.columns if c not in (*by, key)]
    return fresh.groupBy(*by, key).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*by, key, "_x.*").select(*asked.columns)


def restored(asked: DataFrame, files: DataFrame, ready: DataFrame, order: str, by: str = "list") -> DataFrame:
    """``newly_asked`` files with the ``state`` they come back in: queued, but where ``ready (by, ready)`` says that the model isn't there and no listed file waits for it, the first one waits for it."""
    fresh = newly_asked(asked, files, order, by)
    waits = files.where(F.col("state") == NEEDS_MODEL).select(by).distinct().withColumn("_waits", F.lit(True))
    first = fresh.groupBy(by).agg(F.min(order).alias("_first"))
    rows = fresh.join(first, by).join(waits, by, "left").join(ready.select(by, F.col("ready").alias("_ready")), by, "left")
    asks = ~F.coalesce("_ready", F.lit(False)) & F.col("_waits").isNull() & (F.col(order) == F.col("_first"))
    return rows.withColumn("state", F.when(asks, NEEDS_MODEL).otherwise(QUEUED)).drop("_first", "_waits", "_ready")


def pending(files: DataFrame, *by: str) -> DataFrame:
    """How many files are worked on or wait, for the slot or for a model."""
    return files.groupBy(*by).agg(F.count_if(F.col("state").isin(*_FIRST)).alias("pending"))


def unfinished(files: DataFrame, by: str = "list", order: str = "pos") -> DataFrame:
    """Files that aren't settled, with their ``place`` from 0: what runs, what waits for a model, then the queue in order."""
    rank = F.array_position(F.array(*map(F.lit, _FIRST)), F.col("state"))
    open_ = files.where(F.col("state").isin(*_FIRST))
    place = F.row_number().over(Window.partitionBy(by).orderBy(rank, order)) - 1
    return open_.withColumn("place", place)


def advanced(files: DataFrame, by: str = "list", order: str = "pos", checked: bool = True) -> DataFrame:
    """``files`` after the next queued one of each list has started.

    There is one slot. ``checked``: nothing starts while a file runs or waits for a
    model; otherwise the caller knows that the slot is free.
    """
    held = files.groupBy(by).agg(F.bool_or(F.col("state").isin(RUNNING, NEEDS_MODEL)).alias("_held"), F.min(F.when(F.col("state") == QUEUED, F.col(order))).alias("_next"))
    rows = files.join(held, by)
    starts = (F.col("state") == QUEUED) & (F.col(order) == F.col("_next")) & (F.lit(not checked) | ~F.col("_held"))
    return rows.withColumn("state", F.when(F.coalesce(starts, F.lit(False)), RUNNING).otherwise(F.col("state"))).drop("_held", "_next")


def matching(files: DataFrame, needle: ColumnLike, name: str = "name") -> DataFrame:
    """Files whose name contains the needle, whatever the case and the white space around it; an empty one finds all. Rows keep their ``pos``."""
    sought = F.lower(trim_ws(needle))
    return files.where((sought == "") | F.lower(col(name)).contains(sought))


def newest_first(jobs: DataFrame, job: str = "job") -> DataFrame:
    return jobs.orderBy(F.desc(job))


def zipped(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of the same position, as far as both sides go."""
    return left.join(right, pos)


def job_id(path: ColumnLike) -> Column:
    """The number in ``/jobs/<number>``; null for any other path."""
    return F.nullif(F.regexp_extract(col(path), r"^/jobs/\+?([0-9]+)$", 1), F.lit("")).try_cast("bigint")


def route(method: ColumnLike, path: ColumnLike) -> Column:
    """What a request asks for; ``unknown`` paths answer 404 and other methods 405."""
    method, path = col(method), col(path)
    one = job_id(path).isNotNull()
    get, post, delete = (method == x for x in ("GET", "POST", "DELETE"))
    cases = [(get & (path == "/health"), "health"), (get & (path == "/models"), "models"), (get & (path == "/jobs"), "list"), (post & (path == "/jobs"), "submit"), (get & one, "view"), (delete & one, "cancel"), (get | post | delete, "unknown")]
    return first_that_holds(cases, "unsupported")


def cancelled_after(chunks: DataFrame, requests: DataFrame, job: str = "job", at: str = "at") -> DataFrame:
    """The chunks that a job still works on: a request to cancel is looked at once before each chunk, so those that begin at or after it aren't begun."""
    asked = requests.groupBy(job).agg(F.min(at).alias("_asked"))
    return chunks.join(asked, job, "left").where(F.col("_asked").isNull() | (F.col(at) < F.col("_asked"))).drop("_asked")


def settled_deltas(deltas: DataFrame, by: str = "job", order: str = "seq") -> DataFrame:
    """``(by, text)``: what a job's ``deltas (by, order, text, stable)`` add up to, the stable ones in order and the last unstable one after them; an unstable one is replaced by what follows it. A task holds the text of a job."""
    last = deltas.groupBy(by).agg(F.max(order).alias("_last"))
    kept = deltas.join(last, by).where(F.col("stable") | (F.col(order) == F.col("_last")))
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "").alias("text"))


# The states of entries, and what a screen shows in each.
_ENTRY_STATES = {RUNNING: "working", NEEDS_MODEL: "needsModel", QUEUED: "queued", "done": "done", "failed": "failed"}


def entry_views(files: DataFrame) -> DataFrame:
    """What a list shows of ``files (list, pos, input, state, engine, output)``: a name, a state, and whether there is a result to open."""
    state = F.coalesce(lookup("state", _ENTRY_STATES), F.lit("queued"))
    return files.select("list", "pos", last_component("input").alias("name"), "engine", state.alias("state"), ((state == "done") & F.col("output").isNotNull()).alias("has_result"))


def screen_views(files: DataFrame) -> DataFrame:
    """What a window shows of ``files (list, pos, input, state, position_ms, fraction, output, kind)``; what doesn't belong to a state is null."""
    state = F.coalesce(lookup("state", _ENTRY_STATES), F.lit("empty"))
    only = lambda which, value: F.when(state == which, value)
    return files.select(
        "list", "pos", state.alias("state"), F.when(state != "empty", last_component("input")).alias("file"), only("working", F.col("position_ms")).alias("elapsed_ms"), only("working", F.col("fraction")).alias("fraction"),
        only("done", F.col("output")).alias("exported"), only("failed", recovery("kind")).alias("recovery"),
    )


def download_views(downloads: DataFrame, models: DataFrame) -> DataFrame:
    """What a window shows of ``downloads (id, state, file, received, total)``: the file in flight and, from ``models (id, known_bytes, total_bytes)``, the whole model; only while it is fetched."""
    fetching = F.col("state") == "fetching"
    rows = downloads.join(models.select("id", F.col("known_bytes").alias("_known"), F.col("total_bytes").alias("_all")), "id", "left")
    kept = {"file": F.col("file"), "received_bytes": F.col("received"), "total_bytes": F.col("total"), "model_total_bytes": F.col("_all")}
    return rows.select("id", "state", *(F.when(fetching, v).alias(k) for k, v in kept.items()))
