"""Update and delete commands in sequence, each with its code, as a parallel prefix over versions.

What a run of commands on one row does is a map from the version before to the version after (or to deleted); versions that no command of
the run expects pass through. Commands are dealt by ranges of (id, seq), so a hot row's commands lie in several parts and no
part is larger than its share. Only rows that reach over a part's end need more: their parts' maps are composed in pairs, and pairs of
pairs, up to the whole; then the version at the start of each part comes down again. Each part then runs by itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

DELETED = -1
_MAP = "id long, part int, v long, out long"


def _runs(batches):
    """Rows (id, part, ...) in order, as lists of one id and part."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if held:
                    yield held
                key, held = row[:2], []
            held.append(row)
    if held:
        yield held


def _batches(rows, schema: str, size: int = 5000):
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _maps(batches):
    """Each run as its map, found from its end: a command sends the version it expects to where the next one leads."""

    def rows():
        for run in _runs(batches):
            leads: dict[int, int] = {}
            for _, _, _, op, expected in reversed(run):
                if op == "delete":
                    leads[expected] = DELETED
                elif op == "update":
                    leads[expected] = leads.get(expected + 1, expected + 1)
            yield from ((*run[0][:2], v, out) for v, out in leads.items())

    yield from _batches(rows(), _MAP)


_RESULT = "seq long, id long, error int, version_after long"


def _replayed(batches):
    """Codes of runs whose version at the start is known."""

    def rows():
        for run in _runs(batches):
            version = run[0][5]
            for id_, _, seq, op, expected, _ in run:
                error = 404 if version == DELETED else 400 if op == "blocked" else 409 if expected != version else None
                if error is None:
                    version = DELETED if op == "delete" else version + 1
                yield seq, id_, error, (expected + 1 if error is None else None)

    yield from _batches(rows(), _RESULT)


def _composed(maps: DataFrame) -> DataFrame:
    """Maps (id, seg, v, out) of pairs of neighbours: first the even one, then the odd one."""
    pair = F.expr("seg div 2").cast("int")
    even, odd = (maps.filter(f"seg % 2 = {k}").withColumn("pair", pair).drop("seg") for k in (0, 1))
    then = odd.select("id", "pair", F.col("v").alias("out"), F.col("out").alias("then"))
    through = even.join(then, ["id", "pair", "out"], "left").select("id", "pair", "v", F.coalesce("then", "out").alias("out"))
    passed = odd.join(even.select("id", "pair", "v"), ["id", "pair", "v"], "left_anti").select("id", "pair", "v", "out")
    return through.unionByName(passed).withColumnRenamed("pair", "seg")


def _starts(maps: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, part, start): the version before each part of the rows in spans (id, first, last, version)."""
    levels, most = [stored(maps.join(spans.select("id", "first"), "id").select("id", (F.col("part") - F.col("first")).alias("seg"), "v", "out"), "maps")], spans.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0
    while most:
        levels.append(stored(_composed(levels[-1]), "maps"))
        most //= 2
    at = spans.select("id", F.lit(0).alias("seg"), F.col("version").alias("start"))
    for level in reversed(levels[:-1]):
        left = at.select("id", (F.col("seg") * 2).alias("seg"), "start")
        after = level.select("id", "seg", F.col("v").alias("start"), "out")
        right = left.join(after, ["id", "seg", "start"], "left").select("id", (F.col("seg") + 1).alias("seg"), F.coalesce("out", "start").alias("start"))
        at = stored(left.unionByName(right), "starts")
    return at.join(spans.select("id", "first", "last"), "id").filter("seg <= last - first").select("id", (F.col("seg") + F.col("first")).alias("part"), "start")


def sequenced(contexts: DataFrame, commands: DataFrame, parts: int | None = None) -> DataFrame:
    """Commands (seq, id, op update or delete, expected, sets_status) in order of seq with `error` and `version_after`.

    428 without an expected version, 400 for an update that sets the status, 404 where the row is missing or deleted by then, 403 where a
    column `writable` of contexts says no, 400 for an update of a skill, 409 where the ones before it left another version; null: accepted,
    and the version is one more. An accepted delete ends the row. seqs are unique; a null id is missing; an empty table gives no rows.
    """
    spark = commands.sparkSession
    writes = F.col("writable") if "writable" in contexts.columns else F.lit(True)
    rows = contexts.select("id", F.col("version").cast("long").alias("__version"), F.col("status").alias("__status"), F.col("context_type").alias("__type"), writes.alias("__writes"))
    update = F.col("op") == "update"
    missing = F.col("__status").isNull() | (F.col("__status") == "deleted")
    fixed = F.when(F.col("expected").isNull(), 428).when(update & F.col("sets_status"), 400).when(missing, 404).when(~F.col("__writes"), 403)
    joined = commands.join(rows, "id", "left").select("seq", F.col("id").cast("long").alias("id"), F.when(update & (F.col("__type") == "skill"), "blocked").otherwise(F.col("op")).alias("op"), F.col("expected").cast("long").alias("expected"), "__version", fixed.alias("error"))
    judged = stored(joined, "judged")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = judged.filter("error is null").select("id", "seq", "op", "expected", "__version").repartitionByRange(n, "id", "seq").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "dealt")
    spans = dealt.groupBy("id").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.first("__version").alias("version")).filter("last > first")
    spans = stored(spans, "spans")  # a part has two ends, so these are no more than parts
    wide = dealt.join(spans.select("id"), "id", "left_semi").select("id", "part", "seq", "op", "expected").repartition(n, "id", "part").sortWithinPartitions("id", "part", "seq")
    starts = _starts(wide.mapInArrow(_maps, _MAP), spans)
    ready = dealt.join(starts, ["id", "part"], "left").select("id", "part", "seq", "op", "expected", F.coalesce("start", "__version").alias("start"))
    ran = ready.repartition(n, "id", "part").sortWithinPartitions("id", "part", "seq").mapInArrow(_replayed, _RESULT)
    return ran.unionByName(judged.filter("error is not null").select("seq", "id", "error", F.lit(None).cast("long").alias("version_after")))


def events(results: DataFrame, commands: DataFrame) -> DataFrame:
    """The change events of accepted commands: seq, id, change_type modified or deleted."""
    kind = F.when(F.col("op") == "delete", "deleted").otherwise("modified")
    return results.filter("error is null").select("seq").join(commands.select("seq", "id", "op"), "seq").select("seq", "id", kind.alias("change_type"))


def applied(contexts: DataFrame, results: DataFrame, commands: DataFrame) -> DataFrame:
    """contexts after accepted commands (their content column is l2_content): an update makes a row active, a delete keeps its content."""
    good = results.filter("error is null").select("seq", "version_after").join(commands.select("seq", "id", "op", "content"), "seq")
    update = F.col("op") == "update"
    last = good.groupBy("id").agg(F.max("version_after").alias("__version"), F.bool_or(~update).alias("__deleted"), F.max_by(F.when(update, F.col("content")), F.when(update, F.col("seq"))).alias("__content"))
    status = F.when(F.col("__deleted"), "deleted").when(F.col("__version").isNotNull(), "active").otherwise(F.col("status"))
    changed = {"version": F.coalesce("__version", "version").cast("int"), "status": status, "l2_content": F.coalesce("__content", "l2_content")}
    return contexts.join(last, "id", "left").withColumns(changed).select(*contexts.columns)
