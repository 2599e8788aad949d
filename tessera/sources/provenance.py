"""What a table was made from and what it holds: content hashes of input files, digests of rows that no order changes, manifests."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at once; digests of parts are hashed again into a file's own.
PART = 8 << 20
#: Facts that an export must state.
FACTS = frozenset({"seed", "config", "checkpoint", "data_manifest", "command", "start_utc", "upstream_commit"})
#: Facts that name files, whose content is hashed.
FILES = ("config", "checkpoint", "data_manifest")


class ProvenanceError(ValueError):
    """A table is not what its record says."""


def content_hashes(spark: SparkSession, paths: list[str], part: int = PART) -> DataFrame:
    """file, bytes, parts, digest of every file below ``paths``, hidden ones left out as Spark leaves them.

    The digest is the SHA-256 of the parts' SHA-256 digests, one after another in lower-case hex; parts are rows, so they
    are hashed apart. Spark reads a file as a whole, which bounds it to 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.col("path").alias("file"), F.col("length").alias("bytes"), "content")
    pieces = files.select("file", "bytes", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / part))), lambda i: F.sha2(F.substring(F.col("content"), (i * part + 1).cast("int"), F.lit(part)), 256))).alias("i", "hash"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "hash"))), lambda x: x["hash"]), "")
    return pieces.groupBy("file", "bytes").agg(F.count("*").alias("parts"), F.sha2(joined.cast("binary"), 256).alias("digest"))


def row_text(columns: list[str]) -> Column:
    """A row as text in which null differs from every value: the JSON of its columns in the order of their names."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def multiset_digest(text: Column) -> list[Column]:
    """Aggregates rows and digest: sums of four 60-bit parts of each row's SHA-256, modulo 2^60, in hex.

    The order of rows does not matter, their number does: a repeated row is added again.
    """
    h = F.sha2(text.cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) % F.lit(1 << 60).cast("decimal(38,0)") for i in range(4)]
    return [F.count("*").alias("rows"), F.concat(*[F.lpad(F.lower(F.hex(F.coalesce(p, F.lit(0)).cast("long"))), 15, "0") for p in parts]).alias("digest")]


def table_digest(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, rows and digest of a table's rows, whatever their order and partitions."""
    made = multiset_digest(row_text(df.columns))
    return df.groupBy(*by).agg(*made) if by else df.agg(*made)


def export(df: DataFrame, path: str, facts: dict[str, str]) -> dict:
    """Write ``df`` to ``path``/rows, read it back for its digest, and commit the record at ``path``/record last.

    ``facts`` must hold FACTS; the files that FILES name are hashed. A table whose record is missing was not finished.
    """
    missing = FACTS - facts.keys()
    if missing:
        raise ProvenanceError(f"facts are missing: {sorted(missing)}")
    spark = df.sparkSession
    record = dict(facts)
    inputs = {r.file: r.digest for r in content_hashes(spark, [facts[k] for k in FILES]).collect()}  # a few named files
    for key in FILES:
        own = [d for f, d in inputs.items() if f.endswith(facts[key].split(":", 1)[-1].lstrip("/"))]
        if len(own) != 1:
            raise ProvenanceError(f"{key} is not one file: {facts[key]}")
        record[f"{key}_digest"] = own[0]
    df.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    held = table_digest(rows).first()
    record |= {"rows": held["rows"], "rows_digest": held.digest, "schema": rows.schema.simpleString(), "end_utc": datetime.now(UTC).isoformat()}
    content_hashes(spark, [f"{path}/rows"]).select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), "bytes", "digest").coalesce(1).write.json(f"{path}/files")
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/record")
    return record


def problems(spark: SparkSession, path: str) -> DataFrame:
    """problem, what: files of an export that are changed, missing or new, inputs whose content changed, and rows that differ.

    No row means that the export is what its record says. An export without a record raises.
    """
    try:
        record = json.loads(spark.read.text(f"{path}/record").first().value)
    except Exception as e:  # noqa: BLE001
        raise ProvenanceError(f"no record at {path}: {type(e).__name__}") from None
    then = spark.read.schema("file string, bytes long, digest string").json(f"{path}/files").withColumnRenamed("digest", "was")
    now = content_hashes(spark, [f"{path}/rows"]).select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), "digest")
    both = then.select("file", "was").join(now, "file", "full")
    kind = F.when(F.col("digest").isNull(), "file is missing").when(F.col("was").isNull(), "file is new").otherwise("file changed")
    out = both.where(~F.col("was").eqNullSafe(F.col("digest"))).select(kind.alias("problem"), F.col("file").alias("what"))
    digests = {r.file: r.digest for r in content_hashes(spark, [record[k] for k in FILES]).collect()}
    changed = [(f"{k} changed", record[k]) for k in FILES if record[f"{k}_digest"] not in digests.values()]
    held = table_digest(spark.read.schema(spark.read.parquet(f"{path}/rows").schema).parquet(f"{path}/rows")).first() if out.isEmpty() else None
    if held and (held["rows"], held.digest) != (record["rows"], record["rows_digest"]):
        changed.append(("rows differ", f"{held['rows']} rows"))
    return out.unionByName(spark.createDataFrame(changed, "problem string, what string"))


def manifest_problems(cells: DataFrame, manifest: DataFrame, key: str, hashes: list[str], counts: list[str]) -> DataFrame:
    """problem, what, n: how a table of cells departs from the manifest that binds it.

    ``cells``: key, hashes, counts; ``manifest``: key, hashes. Reported: a null or repeated key on either side, a cell that is
    missing or unknown, a hash that is null or another, a count that is null or negative. No row means that all is bound.
    """
    told = []
    for side, rows in (("cells", cells), ("manifest", manifest)):
        told.append(rows.where(F.col(key).isNull()).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(f"{side}: key is null").alias("problem"), F.lit(None).cast("string").alias("what"), "n"))
        told.append(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"{side}: key repeated").alias("problem"), F.col(key).cast("string").alias("what"), "n"))
    a = cells.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.lit(True).alias("_a"), *[F.col(c) for c in (*hashes, *counts)])
    b = manifest.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.lit(True).alias("_b"), *[F.col(h).alias(f"_{h}") for h in hashes])
    both = a.join(b, "_key", "full")
    faults = [F.when(F.col("_a").isNull(), F.lit("cell is missing")), F.when(F.col("_b").isNull(), F.lit("cell is unknown"))]
    known = F.col("_a") & F.col("_b")
    faults += [F.when(known & (F.col(h).isNull() | ~F.col(h).eqNullSafe(F.col(f"_{h}"))), F.lit(f"{h} differs")) for h in hashes]
    faults += [F.when(F.col("_a") & (F.col(c).isNull() | (F.col(c) < 0)), F.lit(f"{c} is not a count")) for c in counts]
    told.append(both.select(F.col("_key").cast("string").alias("what"), F.explode(F.array_compact(F.array(*faults))).alias("problem")).groupBy("problem", "what").agg(F.count("*").alias("n")))
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out.select("problem", "what", "n")


def bound_cells(cells: DataFrame, manifest: DataFrame, key: str, hashes: list[str], counts: list[str]) -> DataFrame:
    """``cells`` if the manifest binds them, else an error that names the first problems."""
    wrong = manifest_problems(cells, manifest, key, hashes, counts).orderBy("problem", "what").limit(5).collect()
    if wrong:
        raise ProvenanceError("; ".join(f"{r.problem}: {r.what} ({r.n})" for r in wrong))
    return cells


def cell_of(manifest: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``wanted`` (key) with the manifest's columns, or an error that names a key without or with several entries."""
    n = manifest.groupBy(key).agg(F.count("*").alias("_n"))
    odd = wanted.select(key).distinct().join(n, key, "left").where("_n is null or _n > 1").orderBy(key).first()
    if odd:
        raise ProvenanceError(f"{key} {odd[0]} has {odd._n or 0} entries")
    return wanted.join(manifest, key)
