"""Which query stands for which row of the inventory, and whether Spark's own surface has moved away from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The DataFrame methods that each row of the inventory rests on.
CLAIMS = {
    "R5": "select selectExpr", "R6": "filter where", "R7": "join crossJoin", "R8": "groupBy groupby agg cube rollup groupingSets count", "R9": "sort orderBy sortWithinPartitions", "R10": "limit",
    "R11": "offset", "R12": "tail", "R13": "distinct dropDuplicates drop_duplicates dropDuplicatesWithinWatermark", "R14": "drop", "R15": "union unionAll unionByName intersect intersectAll exceptAll subtract",
    "R16": "alias", "R17": "toDF", "R18": "withColumn withColumns", "R19": "withColumnRenamed withColumnsRenamed", "R20": "sample randomSplit", "R21": "hint", "R22": "repartition coalesce",
    "R23": "repartitionByRange repartitionById", "R24": "dropna na", "R25": "fillna", "R26": "unpivot melt", "R27": "transpose", "R28": "replace", "R29": "sampleBy stat", "R30": "approxQuantile", "R31": "observe",
    "R33": "lateralJoin", "R35": "to", "R38": "show", "R42": "describe", "R43": "summary", "R44": "crosstab", "R45": "cov", "R46": "corr", "R47": "freqItems", "E9": "colRegex", "E14": "exists scalar asTable",
    "D5": "withWatermark isStreaming", "D4": "write writeStream",
}
#: What is no relation: actions, properties, plans, caching, views, writers and functions on partitions. They are used as they are.
BESIDE = frozenset(
    "cache checkpoint collect columns createGlobalTempView createOrReplaceGlobalTempView createOrReplaceTempView createTempView dtypes executionInfo explain first foreach foreachPartition head inputFiles isEmpty"
    " isLocal localCheckpoint mapInArrow mapInPandas mergeInto metadataColumn pandas_api persist plot printSchema rdd registerTempTable sameSemantics schema semanticHash sparkSession storageLevel take toArrow toJSON"
    " toLocalIterator toPandas transform unpersist withMetadata writeTo".split()
)


def inventory() -> list[str]:
    return [*(f"R{k}" for k in range(1, 48)), *(f"E{k}" for k in range(1, 15)), *(f"F{k}" for k in range(1, 74)), *(f"D{k}" for k in range(1, 13))]


def covered() -> dict[str, list[str]]:
    from ..queries import ROWS

    out: dict[str, list[str]] = {r: [] for r in inventory()}
    for name, rows in ROWS.items():
        for r in rows:
            out[r].append(name)
    return out


def drift(spark: SparkSession | None = None) -> list[str]:
    """What keeps the inventory and the installed Spark from being the same surface; empty if nothing does.

    Methods that Spark offers and no row claims, methods that a row claims and Spark lacks, and with a session functions of
    the named library that its registry lacks.
    """
    from ..functions import NAMES

    offered = {n for n in dir(DataFrame) if not n.startswith("_")}
    claimed = {m: row for row, methods in CLAIMS.items() for m in methods.split()}
    out = [f"DataFrame.{m} is no row's" for m in sorted(offered - claimed.keys() - BESIDE)]
    out += [f"DataFrame.{m} of {claimed[m]} is gone" for m in sorted(claimed.keys() - offered)]
    if spark is not None:
        here = {"create_map": "map"}
        out += [f"function {n} is gone" for names in NAMES.values() for n in names.split() if not spark.catalog.functionExists(here.get(n, n))]
    return out


def report() -> str:
    """A line for each row: its queries, with a star for those that SQL checks; then what has drifted."""
    from ..queries import ORACLES

    found = covered()
    lines = [f"{row}: {', '.join(q + '*' * (q in ORACLES) for q in queries) or 'none'}" for row, queries in found.items()]
    return "\n".join([*lines, *(f"drift: {x}" for x in drift()), f"{sum(map(bool, found.values()))} of {len(found)} rows"])
