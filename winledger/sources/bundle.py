"""Signed export bundles: guarded sections as JSON files, a table of their digests and a manifest of its root."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winledger.operators.egress import ContentLeak, quarantine
from winledger.plans.ordered import held, ranked

MANIFEST, DIGESTS = "manifest", "digests"
ROWS_PER_FILE = 500_000
"""Keeps a file small enough to be hashed in one piece."""
FANOUT = 256
"""Digests that are folded into one."""


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256) of every file of a bundle's sections, hashed where the files are read.

    File names are relative to the bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "part-*").load(folder)
    inside = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return files.select(inside.alias("file"), F.sha2("content", 256).alias("sha256")).filter(
        ~F.split("file", "/")[0].isin(MANIFEST, DIGESTS))


def row_digests(df: DataFrame) -> DataFrame:
    """(n, sha256) of the rows of a section as JSON without NULL fields; ``n`` numbers them by digest."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"})
    hashed = df.select(F.sha2(line, 256).alias("sha256"))
    return ranked(hashed, {"_sha": F.col("sha256")}, "n")


def merkle_root(leaves: DataFrame, number: Column, digest: str = "sha256") -> str:
    """The root of a tree of digests: ``FANOUT`` of them, in the order of ``number`` from 1, are hashed together into one
    of the next level, until one is left. Nothing but that one comes to the driver; no leaves hash as the empty text."""
    level = held(leaves.select((number - 1).cast("long").alias("i"), F.col(digest).alias("d")))
    left = level.count()
    if not left:
        return leaves.sparkSession.sql("select sha2('', 256) as d").head()["d"]
    while True:
        folded = level.groupBy(F.floor(F.col("i") / FANOUT).cast("long").alias("i")).agg(F.sha2(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("i", "d"))), lambda e: e["d"]), ""), 256).alias("d"))
        left = -(-left // FANOUT)
        if left == 1:
            return folded.head()["d"]
        level = held(folded)


def _files_root(digests: DataFrame) -> str:
    numbered = ranked(digests, {"_file": F.col("file")}, "n")
    return merkle_root(numbered.withColumn("sha256", F.sha2(F.concat_ws(":", "file", "sha256"), 256)), F.col("n"))


def write_bundle(
    sections: Mapping[str, DataFrame], folder: str, extra: Mapping[str, object] | None = None
) -> dict:
    """Write every section under ``folder`` and sign the result; the manifest. Refused, before anything is
    written, when the guard finds content in any section.

    The manifest names each section's rows and the root of its rows' digests, which does not depend on files, and the
    root of the table of file digests."""
    if {MANIFEST, DIGESTS} & set(sections):
        raise ValueError(f"'{MANIFEST}' and '{DIGESTS}' are reserved")
    spark = next(iter(sections.values())).sparkSession
    for name, df in sections.items():
        _, blocked = quarantine(df, name=name)
        first = blocked.select("findings").take(3)
        if first:
            shown = "; ".join(x for r in first for x in r["findings"][:3])
            raise ContentLeak(f"{name} blocked from export, suspected content: {shown}")
    told = {}
    for name, df in sections.items():
        df.write.mode("errorifexists").option("maxRecordsPerFile", ROWS_PER_FILE).option(
            "ignoreNullFields", "true").json(f"{folder}/{name}")
        rows = row_digests(spark.read.schema(df.schema).json(f"{folder}/{name}"))
        told[name] = {"rows": rows.count(), "root": merkle_root(rows, F.col("n"))}
    digests = file_digests(spark, folder)
    digests.write.mode("errorifexists").json(f"{folder}/{DIGESTS}")
    manifest = {**(extra or {}), "sections": told, "content_sha256": _files_root(_listed(spark, folder))}
    text = json.dumps(manifest, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{MANIFEST}")
    return manifest


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, sha256 string").json(f"{folder}/{DIGESTS}")


def verify_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of a bundle as rows (file, problem); none when it is intact."""
    try:
        rows = spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).collect()
        manifest = json.loads("".join(r["value"] for r in rows))
        listed = _listed(spark, folder)
    except ValueError:
        return _problems(spark, [("manifest", "invalid manifest json")])
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return _problems(spark, [("manifest", "missing manifest")])
    missing = [("manifest", f"manifest missing {k}") for k in ("sections", "content_sha256") if k not in manifest]
    if not missing and _files_root(listed) != manifest["content_sha256"]:
        missing.append(("manifest", "content digest mismatch"))
    joined = listed.withColumnRenamed("sha256", "want").join(file_digests(spark, folder), "file", "full_outer")
    problem = (
        F.when(F.col("sha256").isNull(), "manifest lists missing file")
        .when(F.col("want").isNull(), "file not in manifest")
        .when(F.col("want") != F.col("sha256"), "digest mismatch")
    )
    found = joined.select("file", problem.alias("problem")).filter(F.col("problem").isNotNull())
    return found.unionByName(_problems(spark, missing))


def _problems(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "file string, problem string")
