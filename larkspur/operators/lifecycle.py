"""Writes as pure functions (current, incoming) -> next, versions, activation and supersession."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.vector import fingerprint, vector_problem
from larkspur.operators.errors import ModelConflict, Refused


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert_last_wins(current: DataFrame, incoming: DataFrame, keys: Sequence[str], batch: str, keep: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key; columns in ``keep`` stay as they were on rows that exist already."""
    newest = latest(incoming, keys, [F.col(batch).desc()])
    old = current.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in current.columns if c not in keys], F.lit(True).alias("_had"))
    joined = old.join(newest.withColumn("_new", F.lit(True)), list(keys), "full")
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
    return joined.select(*out)


def upsert_first_wins(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of keys that are not there yet, the earliest of each key; what exists is untouched."""
    fresh = incoming.join(current.select(*keys).distinct(), list(keys), "left_anti")
    return current.unionByName(latest(fresh, keys, [F.col(order)]).select(*current.columns))


def upsert_counts(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows a first-wins upsert inserts, and how many it passes over because their key is there or came before."""
    fresh = incoming.join(current.select(*keys).distinct(), list(keys), "left_anti").select(*keys).distinct().agg(F.count("*").alias("inserted"))
    total = incoming.agg(F.count("*").alias("_total"))
    return fresh.crossJoin(total).select("inserted", (F.col("_total") - F.col("inserted")).alias("skipped"))  # one row each


def guard_versions(current: DataFrame, incoming: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(next state, conflicts): a row is taken only with a version above the stored one."""
    stored = current.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    judged = incoming.join(stored, F.col(key) == F.col("_k"), "left")
    stale = F.coalesce(F.col(version) <= F.col("_v"), F.lit(False))
    taken = latest(judged.where(~stale).select(*current.columns), [key], [F.col(version).desc()])
    rest = current.join(taken.select(key), key, "left_anti")
    return rest.unionByName(taken), judged.where(stale).select(*incoming.columns)


def replay_versions(events: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """Every write of a history marked accepted or conflict: accepted only above all earlier accepted ones."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("accepted", F.col(version) > F.coalesce(F.max(version).over(before), F.lit(-1)))


def bulk_update(current: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keyed update: a value that is given replaces the old one."""
    new = updates.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = current.join(new, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns])


def replace_for_keys(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of the incoming keys are replaced."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def check_positions(rows: Sequence[int]) -> None:
    if any(p <= 0 for p in rows) or len(set(rows)) != len(rows):
        raise Refused("positions are positive and unique")


def append_sequence(current: DataFrame, incoming: DataFrame, key: str, order: Sequence[str], seq: str = "seq") -> DataFrame:
    """Incoming rows numbered on from the highest number of their key."""
    last = current.groupBy(key).agg(F.max(seq).alias("_last"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return incoming.join(last, key, "left").withColumn(seq, (F.coalesce("_last", F.lit(0)) + rank).cast("long")).drop("_last")


def soft_delete(df: DataFrame, condition: Column, at: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(condition & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


def hard_delete(children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the keys that go (cascade)."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in children.items()}


def assign_versions(history: DataFrame, batch: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """version = highest version of the group + row number in the batch: sees the history and its own batch."""
    top = history.groupBy(*group).agg(F.max("version").alias("_top"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return batch.join(top, list(group), "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + rank).cast("int")).drop("_top")


def backfill_sequence(calls: DataFrame, run: str, created: str, call: str, latency_ms: str) -> DataFrame:
    """Calls numbered per run by creation time and id, with the start reckoned back from the latency."""
    w = Window.partitionBy(run).orderBy(created, call)
    started = F.timestamp_micros(F.unix_micros(F.col(created).cast("timestamp")) - F.round(F.col(latency_ms) * 1000).cast("long"))
    return calls.withColumn("seq", F.row_number().over(w)).withColumn("started_at", started)


def superseded(listed: DataFrame, live: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Keys of live rows that share a group with a listed row and are not listed themselves."""
    groups = listed.select(*group).distinct()
    return live.join(groups, list(group), "left_semi").join(listed.select(key), key, "left_anti").select(key)


def activate(docs: DataFrame, page: DataFrame, key: str, group: Sequence[str]) -> DataFrame:
    """Documents of the page that have a vector become active; live ones they displace are retired."""
    able = docs.join(page.select(key), key, "left_semi").where(F.col("embedding").isNotNull())
    gone = superseded(able, docs.where("is_active"), group, key)
    marks = able.select(key, F.lit(True).alias("_on")).unionByName(gone.select(key, F.lit(False).alias("_on")))
    return docs.join(marks, key, "left").withColumn("is_active", F.coalesce("_on", "is_active")).drop("_on")


def quality_gate(docs: DataFrame, size: int, page: str, key: str) -> DataFrame:
    """problem of each vector: the first quality fault, else 'duplicate' for a repeat within its page, else null."""
    marked = docs.withColumn("_fault", vector_problem(F.col("embedding"), size)).withColumn("_print", fingerprint(F.col("embedding")))
    rank = F.row_number().over(Window.partitionBy(page, "_fault", "_print").orderBy(key))
    return marked.withColumn("problem", F.coalesce("_fault", F.when(rank > 1, "duplicate"))).drop("_fault", "_print")


def check_model(docs: DataFrame, model: str, size: int, force: bool = False) -> None:
    """Refused while live documents come from another model or size, unless forced."""
    other = docs.where("is_active").where(~F.col("embedding_model").eqNullSafe(F.lit(model)) | ~F.col("embedding_dimensions").eqNullSafe(F.lit(size)))
    if not force and not other.limit(1).isEmpty():
        raise ModelConflict("live documents come from another model")


def uncached(bundles: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bundles whose digest isn't cached under all keys."""
    return bundles.join(cache.select(*keys).distinct(), list(keys), "left_anti")


CONFIDENCE = {"constraint": 1.0, "preference": 0.9, "fact": 0.8}


def numbered_rows(df: DataFrame, name: str) -> DataFrame:
    """df with the numbers 1 to n: rows are numbered within buckets of a hash, and each bucket starts behind those before it.

    One bucket's rows are sorted by one task, and only bucket counts meet in one; which row gets which number
    follows from its columns, so that a task that runs again gives the same numbers.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*df.columns), F.lit(4096)))
    counts = df.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = counts.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[c for c in df.columns if c != "_bucket"]))
    return df.withColumn(name, inside).join(F.broadcast(before), F.col("_bucket") == F.col("_b")).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_bucket", "_b", "_before")


def save_memories(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """An equal (user, type, content) refreshes its row and undoes its deletion; others are new rows, numbered on behind the last id."""
    keys = ["user_id", "type", "content"]
    newest = latest(incoming, keys, [F.col("at").desc()])
    touched = current.join(newest.select(*keys, F.col("at").alias("_at")), keys, "left")
    kept = touched.withColumn("updated_at", F.coalesce("_at", "updated_at")).withColumn("deleted_at", F.when(F.col("_at").isNull(), F.col("deleted_at"))).drop("_at").select(*current.columns)
    fresh = newest.join(current.select(*keys).distinct(), keys, "left_anti")
    top = current.agg(F.coalesce(F.max("memory_id"), F.lit(0)).alias("_top"))
    weights = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    numbered = numbered_rows(fresh, "_n").crossJoin(F.broadcast(top)).select(  # one row
        (F.col("_top") + F.col("_n")).alias("memory_id"), *keys, F.coalesce(F.element_at(weights, F.col("type")), F.lit(0.8)).alias("confidence"),
        F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return kept.unionByName(numbered.select(*current.columns))
