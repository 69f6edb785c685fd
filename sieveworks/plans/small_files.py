"""Problem 5: tiny files into few well-sized ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators.blockcopy import TARGET_BYTES, consolidate
from sieveworks.session import scratch_path, table
from sieveworks.sources.shards import scan_records


#: Records of a piece at most: the parsed records land in files as small as frequent writers leave them.
PIECE_ROWS = 5000


def _compacted(spark: SparkSession, d: str, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    """What the merged files hold, and what each was made of.

    The tiny files are texts in many formats, whose bytes can't be copied into
    one file as they are. They are parsed and land as many small parquet pieces,
    whose encoded blocks are then copied into well-sized files.
    """
    pieces, merged = scratch_path(spark, "pieces"), scratch_path(spark, "merged")
    scan_records(table(spark, d, "raw_shards")).write.option("maxRecordsPerFile", PIECE_ROWS).parquet(pieces)
    made = consolidate(spark, pieces, merged, target_bytes)
    return spark.read.parquet(merged), made


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d)[0].select("rel_path", "run")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """Totals (rows only, as the pieces depend on the cluster): tiny files with text, pieces and blocks that were merged, merged files, and records."""
    tiny = table(spark, d, "raw_shards").agg(F.count_if(F.length("payload") > 0).alias("tiny_files"))
    made = _compacted(spark, d)[1].agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("files", "pieces"), ("blocks", "blocks"), ("rows", "rows"))], F.count("*").alias("merged_files"))
    return tiny.join(F.broadcast(made))


#: From the statement of the problem: a line counts if it gives path, run and bytes and is closed as its format demands.
#: Lines are told apart by their separator and taken apart as lists and maps.
SQL = {
    "p5_found": r"""
WITH lines AS (SELECT rtrim(unnest(string_split_regex(ltrim(payload, chr(65279)), '\r\n|\n|\r'))) AS line FROM raw_shards),
objects AS (SELECT line ->> 'rel_path' AS p, line ->> 'run' AS r, line ->> 'bytes' AS b FROM lines WHERE left(line, 1) = '{' AND json_valid(line)),
pairs AS (SELECT map_from_entries(list_transform(string_split(line[:-2], ';'), lambda x: (x[:position('=' IN x) - 1], x[position('=' IN x) + 1:]))) AS m FROM lines WHERE right(line, 1) = ';' AND regexp_matches(line, '^\w+=')),
fields AS (SELECT CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9)) ELSE list_concat([array_to_string(string_split(line, ',')[:-3], ',')], string_split(line, ',')[-2:]) END AS f
  FROM lines WHERE left(line, 1) NOT IN ('{', '#') AND right(line, 1) <> ';' AND (contains(line, chr(9)) OR contains(line, ','))),
every_line AS (SELECT p, r, b FROM objects UNION ALL SELECT m['rel_path'], m['run'], m['bytes'] FROM pairs
  UNION ALL SELECT CASE WHEN left(f[1], 1) = '"' THEN CASE WHEN length(f[1]) > 1 AND right(f[1], 1) = '"' THEN replace(f[1][2:-2], '""', '"') END ELSE f[1] END, f[2], f[3] FROM fields WHERE len(f) = 3)
SELECT DISTINCT regexp_replace(trim(replace(p, chr(92), '/')), '^(\./+)+', '') AS rel_path, r::INTEGER AS run
FROM every_line WHERE p <> '' AND regexp_matches(r, '^\d+$') AND regexp_matches(b, '^\d+$')""",
}


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_files)}
